"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, its source's target over its source's
size. The whole part is taken; the fractions are made whole in pairs: words move from one document's
fraction to the other's, either way with the odds that keep both expectations, until one is whole. Words
are preserved exactly. Pairing runs in a reduction tree: buckets first, then the buckets' single leftovers
together, until one group is left a source, whose very last document is drawn and offset within the group.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm import common

WEIGHTS, SHARE, CAP, SEED, FAN_IN = (3, 1, 2), 1.5, 2.0, 42, 64
UNITS_A_BUCKET = 50_000


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with `rank` from 0 in the given order, numbered over range partitions rather than in one task."""
    parts = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = common.written(parts, "ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("rank", within - 1).join(offsets, "part").withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) with target: shares by weight, none above cap times its source's size.

    Sources stand in code point order with null last, and the weights repeat along them. A source over its
    cap stops there; the excess goes to the others by weight until none is above.
    """
    order = sizes.withColumn("last", F.col("source").isNull())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = common.written(ranked(order, "last", "source").select("source", "source_size", weight.alias("weight")), "sources")
    limit = cap * F.col("source_size")
    total = share * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, seen = 0.0, -1
    while True:
        full = limit <= level * F.col("weight")
        capped, rest, n = table.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if n == seen or not rest:
            break
        level, seen = (total - capped) / rest, n
    return table.withColumn("target", F.least(limit, level * F.col("weight")))


def _unit(seed: int, *key) -> float:
    return xxhash.xxh64_intdigest(":".join(map(str, (seed, *key))).encode()) / 2**64


def _move(first: list, second: list, draw: float) -> None:
    """One pivotal step on [row, fraction] pairs: words move one way or the other until a fraction is whole."""
    (a, p), (b, q) = first, second
    up, down = min((1 - p) * a["mass"], q * b["mass"]), min(p * a["mass"], (1 - q) * b["mass"])
    moved = up if draw * (up + down) < down else -down
    first[1], second[1] = (0.0 if f < 1e-9 else 1.0 if f > 1 - 1e-9 else f for f in (p + moved / a["mass"], q - moved / b["mass"]))
    if 0 < first[1] < 1 and 0 < second[1] < 1:  # rounding alone: the step ends with one whole
        second[1] = float(second[1] > 0.5)


def _whole(group: list[list], seed: int) -> None:
    """Settle a source's last group: its leftover is drawn, and what that adds or takes is offset by others.

    Documents of the group change sides, largest first, wherever that brings the source nearer its target,
    so the source misses by about its least document instead of its last one.
    """
    open_ = next((g for g in group if 0 < g[1] < 1), None)
    if open_ is None:
        return
    row, p = open_
    open_[1] = float(_unit(seed, "last", row["doc_id"], row["size"]) < p)
    over = (open_[1] - p) * row["mass"]
    for g in sorted((g for g in group if g is not open_), key=lambda g: (-g[0]["mass"], _unit(seed, "side", g[0]["doc_id"], g[0]["size"]))):
        change = -g[0]["mass"] if g[1] == 1 else g[0]["mass"]
        if abs(over + change) < abs(over):
            g[1], over = 1 - g[1], over + change


def _pivot(last: bool, level: int, seed: int):
    """A step of the tree over rows sorted by group; each group leaves one undecided row at most.

    Only the undecided row is held, but for the last level, whose groups have FAN_IN rows at most.
    """

    def settled(row, fraction):
        return dict(row) | {"copies": row["copies"] + int(fraction), "fraction": None}

    def finished(held, group):
        if last:
            _whole(group, seed)
            return [settled(*g) for g in group]
        return [dict(held[0]) | {"fraction": held[1]}] if held else []

    def step(batches):
        key, held, group, schema = None, None, [], None
        for batch in batches:
            out, schema = [], batch.schema
            for row in batch.to_pylist():
                if (row["source"], row["bucket"]) != key:
                    out += finished(held, group)
                    key, held, group = (row["source"], row["bucket"]), None, []
                if row["mass"] == 0:
                    out.append(settled(row, _unit(seed, "none", row["doc_id"], row["source"]) < row["fraction"]))
                    continue
                now = [row, row["fraction"]]
                if last:
                    group.append(now)
                pair = [g for g in (held, now) if g and 0 < g[1] < 1]
                if len(pair) == 2:
                    _move(*pair, _unit(seed, level, pair[0][0]["doc_id"], row["doc_id"], row["size"]))
                if not last:
                    out += [settled(*g) for g in (held, now) if g and g[1] in (0, 1)]
                held = next((g for g in pair if 0 < g[1] < 1), None)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if schema is not None:
            yield pa.RecordBatch.from_pylist(finished(held, group), schema=schema)

    return step


def rounded(units: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """units (doc_id, source, size, mass, bucket, copies, fraction) with every fraction settled into copies.

    Groups are (source, bucket); a task holds one undecided unit at a time. Each level joins FAN_IN buckets.
    """
    schema, done, level = units.schema, None, 0
    while True:
        last = buckets <= 1
        sorted_ = units.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("mass"), "doc_id", "size")
        table = common.written(sorted_.mapInArrow(_pivot(last, level, seed), schema), f"pivot{level}")
        settled = table.filter("fraction is null")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        buckets, level = -(-buckets // FAN_IN), level + 1
        units = table.filter("fraction is not null").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))


def copies(narrow: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size) rows, read twice, to distinct ones with source_size, target and copies.

    Rows equal in all three share one decision, and weigh as many as they are.
    """
    units = narrow.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = common.written(targets(sizes, weights, share, cap), "targets")
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(0.0)
    buckets = max(FAN_IN, -(-narrow.count() // UNITS_A_BUCKET))
    keyed = units.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight")
    keyed = keyed.withColumn("expected", expected).withColumn("copies", F.floor("expected").cast("long"))
    units = keyed.select("doc_id", "source", "size", (F.col("size") * F.col("n")).alias("mass"), F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).alias("bucket"), "copies", (F.col("expected") - F.col("copies")).alias("fraction"))
    whole = rounded(units, buckets, seed).select("doc_id", "source", "size", "copies")
    return whole.join(aims.drop("weight").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def decide(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, source, size), written, and their decisions."""
    narrow = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), common.n_words(F.col("text")).alias("size")), "sizes")
    return narrow, copies(narrow, **options)


@common.tidied
def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: documents as often as they were taken, in their own columns.

    Null texts and sources are a size of 0 and a source of their own; repeated rows share one decision; an
    empty table mixes to no rows; other columns stay.
    """
    _, decisions = decide(docs, **options)
    names = {c: common.fresh(docs, f"mix_{c}") for c in ("doc_id", "source", "size", "copies")}
    d = decisions.select(*(F.col(c).alias(n) for c, n in names.items())).filter(F.col(names["copies"]) > 0)
    on = docs["doc_id"].cast("long").eqNullSafe(d[names["doc_id"]]) & docs["source"].eqNullSafe(d[names["source"]]) & (common.n_words(docs["text"]) == d[names["size"]])
    many = docs.join(d, on).select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copies"]))).alias(names["copies"]))
    return many.drop(names["copies"])


@common.tidied
def op3_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow, decisions = decide(common.documents(spark, sf_dir))
    d = decisions.select(*(F.col(c).alias(f"d_{c}") for c in decisions.columns))
    on = narrow.doc_id.eqNullSafe(d.d_doc_id) & narrow.source.eqNullSafe(d.d_source) & (narrow.size == d.d_size)
    taken = (F.col("size") * F.col("d_copies")).alias("taken")
    return narrow.join(d, on).select("doc_id", "size", F.col("d_source_size").alias("source_size"), F.col("d_target").alias("target"), taken, "source")


QUERIES = {"op3_pivotal_mixing": op3_pivotal_mixing}
ORACLES: dict = {}
