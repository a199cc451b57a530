"""Scoring a class raster: dense confusion matrix, row percentages, per-class and mean metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions import pixels as px


def confusion(pairs: DataFrame, n: int, empty: int | None = None, count: str | None = None) -> DataFrame:
    """(ref, pred, n) for every pair of the n classes; a missing class is the empty one, or left out.

    `count` names a column of how often a row's pair occurs. Counts are combined map-side; the dense grid of n * n zeros is a literal. Classes outside 0..n-1 are an error.
    """
    pairs = pairs.select("ref", "pred", (F.lit(1) if count is None else F.col(count)).cast("long").alias("times"))
    if empty is not None:
        pairs = pairs.select(F.coalesce("ref", F.lit(empty)).alias("ref"), F.coalesce("pred", F.lit(empty)).alias("pred"), "times")
    pairs = pairs.select(F.col("ref").cast("int").alias("ref"), F.col("pred").cast("int").alias("pred"), "times").dropna()
    ok = F.col("ref").between(0, n - 1) & F.col("pred").between(0, n - 1)
    counts = pairs.groupBy("ref", "pred").agg(F.sum("times").alias("c"))
    counts = counts.select(F.when(ok, F.col("ref")).otherwise(F.raise_error(F.lit("class out of range"))).alias("ref"), "pred", "c")
    ids = F.sequence(F.lit(0), F.lit(n - 1))
    dense = pairs.sparkSession.range(1).select(F.explode(ids).alias("ref")).select("ref", F.explode(ids).alias("pred"))
    return dense.join(counts, ["ref", "pred"], "left").select("ref", "pred", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def percent(cm: DataFrame) -> DataFrame:
    """cm with each count as a percentage of its row, 0 in empty rows."""
    total = F.sum("n").over(Window.partitionBy("ref"))
    return cm.withColumn("percent", F.coalesce(F.col("n") * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)))


def metrics(cm: DataFrame) -> DataFrame:
    """IoU, precision, recall and Dice of every class; NULL where a denominator is 0."""
    diagonal = F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0)
    rows = cm.groupBy(F.col("ref").alias("class_id")).agg(F.sum(diagonal).alias("tp"), F.sum("n").alias("in_ref"))
    cols = cm.groupBy(F.col("pred").alias("class_id")).agg(F.sum("n").alias("in_pred"))
    ratio = lambda a, b: a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    tp, ref, pred = F.col("tp"), F.col("in_ref"), F.col("in_pred")
    return rows.join(cols, "class_id").select(
        "class_id", ratio(tp, ref + pred - tp).alias("iou"), ratio(tp, pred).alias("precision"), ratio(tp, ref).alias("recall"), ratio(2 * tp, ref + pred).alias("dice")
    )


def summary(per_class: DataFrame, names: dict[int, str], excluded: tuple[str, ...] = ("Autre",)) -> DataFrame:
    """Means over the classes that aren't excluded by name; a class without a value doesn't count."""
    left_out = [k for k, v in names.items() if v in excluded]
    kept = per_class.filter(~F.col("class_id").isin(*left_out)) if left_out else per_class
    return kept.agg(*(F.avg(c).alias(f"mean_{c}") for c in ("iou", "precision", "recall", "dice")))


METRICS = ("iou", "precision", "recall", "dice")
# The report's titles and widths.
TITLE, MEANS = "==== Segmentation Performance Report ====", "==== Global Means (excluding 'Autre') ===="
HEADINGS, WIDTHS = ("IoU", "Precision", "Recall", "Dice"), (10, 15, 15, 15)


def report(per_class: DataFrame, names: dict[int, str], excluded: tuple[str, ...] = ("Autre",)) -> DataFrame:
    """(pos, line): the report's lines in order: a heading, a line of fixed widths per class, and the means."""
    name = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("class_id"))
    text = lambda c: F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.3f", px.rounded(c, 3)))
    line = F.concat(F.rpad(name, F.greatest(F.length(name), F.lit(20)), F.lit(" ")), *(F.lpad(text(c), w, " ") for c, w in zip(METRICS, WIDTHS, strict=True)))
    heading = "Class".ljust(20) + "".join(h.rjust(w) for h, w in zip(HEADINGS, WIDTHS, strict=True))
    first = [TITLE, "", heading, "-" * 75]
    fixed = lambda lines, at: per_class.sparkSession.createDataFrame([(at + i, x) for i, x in enumerate(lines)], "pos int, line string")
    body = per_class.select((F.col("class_id") + len(first)).cast("int").alias("pos"), line.alias("line"))
    last = len(first) + max(names) + 1
    means = summary(per_class, names, excluded).select(F.explode(F.array(*(
        F.struct(F.lit(last + 2 + i).alias("pos"), F.concat(F.lit(f"Mean {h}".ljust(15) + ": "), text(f"mean_{c}")).alias("line")) for i, (h, c) in enumerate(zip(HEADINGS, METRICS, strict=True))
    ))).alias("m")).select("m.*")
    return fixed(first, 0).unionByName(body).unionByName(fixed(["", MEANS], last)).unionByName(means)
