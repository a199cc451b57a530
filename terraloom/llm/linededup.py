"""Line dedup by a suffix array over line sequences, in DataFrame functions alone.

Lines are numbered by content and every document is a sequence of them. Prefix doubling ranks all suffixes:
the rank of a position at width 2w refines its rank at width w by the rank w lines on, within its group
alone, so no global sort is needed. Positions of equal rank at a width share that many lines: they are a
longest-common-prefix interval. A run of m lines is named by its length and two ranks of the widest power
of two that fits, one at each end; of all runs with one name, the first in document order stays.

A run counts once it has `min_words` words. Whatever of a longer repeat matters is the union of its shortest
such runs, counted forward from each line and backward from each line; so no width over `min_words` lines is
needed. Lines without a word neither count nor break a run, and are never deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm import common

MIN_WORDS = 50
#: Least number of buckets of the first numbering and of blocks of later ones, as a power of two; see `_parts`.
LEAST_BITS = 8


def _parts(n: int) -> int:
    """Bits of about the square root of n: as many parts as rows in each, so that neither outgrows a window."""
    return max(LEAST_BITS, -(-max(1, n).bit_length() // 2))


def lines(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Lines with a word: k (row), o (order), raw (line number), idx (number among these), h and g, words.

    h and g are 96 bits of two hashes: unequal lines that agree in both aren't to be expected in any corpus.
    """
    entry = lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), common.n_words(x).cast("int").alias("words"), i.alias("raw"))
    split = F.transform(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n"), entry)
    some = F.transform(F.filter(split, lambda x: x["words"] > 0), lambda x, i: F.struct(*(x[c].alias(c) for c in ("h", "g", "words", "raw")), i.alias("idx")))
    return rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.inline(some))


def _first_ranks(active: DataFrame, n: int) -> DataFrame:
    """(h, g, rank): how many of the n positions hold a lesser line; by buckets of h, and within them."""
    counts = active.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.shiftright("h", 64 - _parts(n)))
    counts = common.written(counts, "linecounts")
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("b"))  # about the square root of n rows
    base = sums.select("bucket", F.coalesce(F.sum("b").over(up_to(Window.orderBy("bucket"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(up_to(Window.partitionBy("bucket").orderBy("h", "g"))), F.lit(0))
    return counts.withColumn("within", within).join(base, "bucket").select("h", "g", (F.col("base") + F.col("within")).alias("rank"))


def _refined(ranks: DataFrame, width: int, n: int) -> DataFrame:
    """Ranks at twice the width: within each group, by how many members have a lesser rank `width` lines on.

    Members are counted by (rank, next rank) before anything is ordered, and a group's next ranks are summed
    by blocks first. There are about as many blocks as a block has next ranks, the square root of all `n` positions,
    and no window holds more rows than that, whatever share of the positions one line has.
    """
    ahead = Window.partitionBy("k").orderBy("idx")
    follows = F.lead("idx", width).over(ahead) == F.col("idx") + width
    pairs = ranks.withColumn("next", F.coalesce(F.when(follows, F.lead("rank", width).over(ahead)), F.lit(-1)))
    pairs = common.written(pairs, f"pairs{width}")
    counts = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"))
    counts = common.written(counts.withColumn("block", F.floor(F.col("next") / ((n >> _parts(n)) + 1))), f"counts{width}")
    up_to = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("rank", "block").agg(F.sum("n").alias("s"))
    base = F.coalesce(F.sum("s").over(up_to("rank").orderBy("block")), F.lit(0))
    base = sums.select(F.col("rank").alias("br"), F.col("block").alias("bb"), base.alias("base"))
    within = F.coalesce(F.sum("n").over(up_to("rank", "block").orderBy("next")), F.lit(0))
    finer = counts.withColumn("within", within).join(base, (F.col("rank") == F.col("br")) & (F.col("block") == F.col("bb")))
    finer = finer.select(F.col("rank").alias("r"), F.col("next").alias("x"), (F.col("rank") + F.col("base") + F.col("within")).alias("finer"))
    finer = common.written(finer, f"finer{width}")
    joined = pairs.join(finer, (pairs.rank == finer.r) & (pairs.next == finer.x))
    return joined.withColumn("rank", F.col("finer")).drop("next", "r", "x", "finer")


def _runs(active: DataFrame, least: int) -> DataFrame:
    """(k, o, start, m): the shortest runs of `least` words from every line on, and up to every line."""
    segment = Window.partitionBy("k", "seg")
    upto = F.sum("words").over(segment.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    placed = active.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    forward = segment.orderBy("before").rangeBetween(0, least - 1)
    backward = segment.orderBy("upto").rangeBetween(-(least - 1), 0)
    both = placed.select(
        "k", "o", "idx",
        F.count(F.lit(1)).over(forward).alias("fm"), F.sum("words").over(forward).alias("fw"),
        F.count(F.lit(1)).over(backward).alias("bm"), F.sum("words").over(backward).alias("bw"),
    )
    ahead = both.filter(F.col("fw") >= least).select("k", "o", F.col("idx").alias("start"), F.col("fm").cast("int").alias("m"))
    back = both.filter(F.col("bw") >= least).select("k", "o", (F.col("idx") - F.col("bm") + 1).cast("int").alias("start"), F.col("bm").cast("int").alias("m"))
    return ahead.unionByName(back).distinct()


def later_copies(rows: DataFrame, key: str, order: str, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(k, deleted): the line numbers to delete of every row that has any; rows in order of (`order`, `key`)."""
    table = common.written(lines(rows, key, text, order), "lines")
    # A line that occurs once is in no repeated run, and a segment without enough words holds none.
    often = table.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias("often"), F.col("g").alias("also"))
    often = common.written(often, "often")  # joined as a table, so that a very common line's rows can be split
    repeated = table.join(often, (table.h == often.often) & (table.g == often.also)).drop("often", "also")
    by_row = Window.partitionBy("k").orderBy("idx")
    cut = F.when(F.lag("idx").over(by_row) == F.col("idx") - 1, 0).otherwise(1)
    segments = repeated.withColumn("cut", cut).withColumn("seg", F.sum("cut").over(by_row.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")
    enough = F.sum("words").over(Window.partitionBy("k", "seg")) >= min_words
    active = common.written(segments.withColumn("enough", enough).filter("enough").drop("enough"), "active")
    runs = common.written(_runs(active, min_words), "runs")
    widest, n = runs.agg(F.max("m")).first()[0], active.count()
    if widest is None:
        return runs.select("k", F.array("start").alias("deleted"))
    first = common.written(_first_ranks(active, n).withColumnsRenamed({"h": "line", "g": "also"}), "first")
    ranks = active.join(first, (active.h == first.line) & (active.g == first.also)).select("k", "idx", "rank")
    named, width = None, 1
    while True:
        ranks = common.written(ranks, f"ranks{width}")
        here = runs.filter((F.col("m") >= width) & (F.col("m") < 2 * width))
        head, tail = (ranks.select(F.col("k").alias("rk"), F.col("idx").alias("ri"), F.col("rank").alias(r)) for r in ("head", "tail"))
        part = here.join(head, (here.k == head.rk) & (here.start == head.ri)).drop("rk", "ri")
        part = part.join(tail, (part.k == tail.rk) & (part.start + part.m - width == tail.ri)).drop("rk", "ri")
        named = part if named is None else named.unionByName(part)
        if 2 * width > widest:
            break
        ranks = _refined(ranks, width, n)
        width *= 2
    named = common.written(named, "named")
    place = F.struct(F.col("o").isNull().alias("last"), "o", "k", "start")
    firsts = named.groupBy("m", "head", "tail").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = common.written(firsts, "firsts")
    copies = named.join(firsts, ["m", "head", "tail"]).filter((F.col("k") != F.col("first.k")) | (F.col("start") != F.col("first.start")))
    gone = copies.select("k", F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("idx")).distinct()
    raw = gone.join(table.select(F.col("k").alias("tk"), F.col("idx").alias("ti"), "raw"), (F.col("k") == F.col("tk")) & (F.col("idx") == F.col("ti")))
    return raw.groupBy("k").agg(F.array_sort(F.collect_list("raw")).alias("deleted"))


def _left(text: Column, deleted: Column) -> Column:
    """text without the deleted lines; its lines are split once, as the one element of an array."""

    def kept(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), deleted)
        return F.when(F.size(stay) == 0, F.lit("")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))

    return F.get(F.transform(F.array(F.split(text, "\n")), kept), F.lit(0))


@common.tidied
def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated line runs deleted, and `deleted` (or the next free name): the line numbers, null where none.

    The first copy by doc_id (null last, then row) stays. Null texts stay null; a text whose lines all go is
    empty; repeated rows keep their lines once; an empty table stays empty; other columns stay.
    """
    rows, key = common.keyed(docs)
    taken = {c: common.fresh(docs, c) for c in ("order_", "del_key", "deleted")}
    gone = later_copies(rows.withColumn(taken["order_"], F.col("doc_id")), key, taken["order_"], min_words=min_words)
    gone = gone.select(F.col("k").alias(taken["del_key"]), F.col("deleted").alias(taken["deleted"]))
    joined = rows.join(gone, F.col(key) == F.col(taken["del_key"]), "left")
    deleted = F.col(taken["deleted"])
    text = F.when(deleted.isNull(), F.col("text")).otherwise(_left(F.col("text"), deleted))
    return joined.withColumn("text", text).drop(key, taken["del_key"])


@common.tidied
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after line dedup, with the numbers of the lines deleted."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = dedup(docs)
    removed = F.coalesce(F.size("deleted"), F.lit(0)).cast("long")
    numbers = F.coalesce(F.array_join(F.transform("deleted", lambda i: i.cast("string")), ","), F.lit(""))
    return out.select("doc_id", F.when(F.col("deleted").isNull(), F.lit(0).cast("long")).otherwise(removed).alias("n_deleted"), numbers.alias("deleted_lines"), "text")


#: Every run of enough words that ends as soon as it has them, from each line on and up to each line, by its very text.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, text FROM documents),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS raw FROM d),
s AS (SELECT k, raw, line, CAST(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
p AS (SELECT *, row_number() OVER o AS idx, sum(words) OVER o AS upto, sum(words) OVER o - words AS before FROM s WINDOW o AS (PARTITION BY k ORDER BY raw)),
r AS (SELECT k, idx AS first, idx + count(*) OVER f - 1 AS last, sum(words) OVER f AS n FROM p WINDOW f AS (PARTITION BY k ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
    UNION ALL SELECT k, idx - count(*) OVER b + 1, idx, sum(words) OVER b FROM p WINDOW b AS (PARTITION BY k ORDER BY upto RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
u AS (SELECT DISTINCT k, first, last FROM r WHERE n >= {MIN_WORDS}),
t AS (SELECT u.k, u.first, u.last, string_agg(p.line, chr(10) ORDER BY p.idx) AS body FROM u JOIN p ON u.k = p.k AND p.idx BETWEEN u.first AND u.last GROUP BY ALL),
c AS (SELECT k, first, last FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY k, first) AS nth FROM t) WHERE nth > 1),
g AS (SELECT DISTINCT p.k, p.raw FROM c JOIN p ON c.k = p.k AND p.idx BETWEEN c.first AND c.last),
x AS (SELECT k, count(*) AS n, string_agg(CAST(raw AS VARCHAR), ',' ORDER BY raw) AS numbers FROM g GROUP BY k),
y AS (SELECT l.k, string_agg(l.line, chr(10) ORDER BY l.raw) FILTER (WHERE g.raw IS NULL) AS rest FROM l LEFT JOIN g ON l.k = g.k AND l.raw = g.raw GROUP BY l.k)
SELECT d.doc_id, coalesce(x.n, 0) AS n_deleted, coalesce(x.numbers, '') AS deleted_lines, CASE WHEN d.text IS NOT NULL THEN coalesce(y.rest, '') END AS text
FROM d LEFT JOIN x ON d.k = x.k LEFT JOIN y ON d.k = y.k"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": ORACLE}
