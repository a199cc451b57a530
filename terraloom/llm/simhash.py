"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within twice the half radius have a common variant within the half radius of each. Every
distinct fingerprint emits its variants; those that meet on one are verified. All that meet on a variant lie
within that small ball, so a meeting has at most as many members as the ball has points, and linking each
to one of them keeps every component without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm import common, graph

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of lower-cased words; bit b is set where over half the shingles' hashes set it."""
    if not words:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = min(shingle, len(words)) - 1
    hashes = np.array([digest(text[a:b], seed) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def words(texts: pa.Array) -> Iterator[list[bytes]]:
    """The lower-cased words of each text."""
    for text in pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")):
        # bytes.split() cuts at exactly the six blanks that separate words
        yield text.as_buffer().to_pybytes().split() if len(text.as_py()) else []


def fingerprints(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; null and wordless texts have 0."""

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, found in enumerate(words(batch.column(1))):
                out[i] = fingerprint(found, shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) of at most `radius` differing bits; all components, not all pairs.

    With half of the radius, rounded up, as the ball's radius, two fingerprints within `radius` meet on a
    variant that one of them reaches in `radius` less that half: an inner member of the meeting. Every member
    is within `radius` of every inner one, so linking all to the least inner one loses no component.
    """
    if radius < 0:
        raise ValueError("the radius can't be negative")
    half = -(-radius // 2)
    flips = F.array(F.col("variant"), *(F.col("variant").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(BITS)))
    emitted = distinct.select("fp", F.col("fp").alias("variant"))
    for step in range(half):
        emitted = emitted.select("fp", F.explode(flips).alias("variant"))
        if step:
            emitted = emitted.distinct()
    inner = F.bit_count(F.col("fp").bitwiseXOR(F.col("variant"))) <= radius - half
    head = F.min(F.when(inner, F.col("fp"))).over(Window.partitionBy("variant"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius
    edges = emitted.select("fp", head.alias("b")).filter((F.col("b") != F.col("fp")) & close)
    return edges.select(F.col("fp").alias("a"), "b").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id reachable by links.

    Equal fingerprints are one node, however many documents have them. Wordless and null texts share
    fingerprint 0; repeated rows and null ids are kept, and a component of null ids alone has a null id.
    """
    return classed(common.written(fingerprints(docs, id_col, **options), "fingerprints"))


def classed(rows: DataFrame, more: DataFrame | None = None, radius: int = RADIUS) -> DataFrame:
    """The same of given (doc_id, fp), by the edges (a, b) of `more` between fingerprints too."""
    distinct = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = links(distinct.select("fp"), radius)
    parts = graph.components(edges if more is None else edges.unionByName(more))
    joined = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    joined = common.written(joined, "classes")
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(ids, "component").select(F.col("fp").alias("f"), "component_id")
    return rows.join(by_fp, rows.fp == by_fp.f).select("doc_id", "fp", "component_id")


@common.tidied
def dedup(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the first by doc_id, in the documents' own columns.

    Ids that are null or repeated are replaced by row numbers for the choice alone.
    """
    rows, key = common.keyed(docs)
    kept = classes(rows, id_col=key, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("keep_key"))
    return rows.join(kept, rows[key] == kept.keep_key, "left_semi").drop(key)


@common.tidied
def op7_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_ball": op7_simhash_ball}
ORACLES: dict = {}
