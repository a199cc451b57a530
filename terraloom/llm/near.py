"""Near copies by word shingles: banded minimum hashes bring texts together, an exact check links them.

A SimHash ball of 2 bits holds hardly any near copy. Two texts here are linked when their sets of five-word
shingles have a Jaccard similarity of 0.8 or more. At 0.8 a pair misses every band once in 150,000 times.
Texts that share a band are first compared along a chain and with the band's first, so a large group of
copies costs a chain, not its pairs. Then the texts of a band that are not connected by now are held against
each other within tasks, in blocks: by their signatures, and where these agree nearly enough, by their
shingles. A pair that shares several bands is looked at in the first of them alone. Only marks of members and
one edge a member leave a task, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm import common, graph, simhash

SHINGLE, SEED = 5, 43
#: Similarity from which two texts are near copies, in percent.
SIMILAR = 80
BANDS, ROWS = 30, 5
#: Share of equal signature rows, in percent, below which two texts aren't checked: at a similarity of 0.8 the
#: share of 150 rows is less than this once in 100,000 times.
LEAST_EQUAL = 66
#: Members of open bands that a group holds, and their shingles in all. A band of over BLOCK members is compared in pairs of COPIES blocks at
#: most, and its chain is cut after about CHAIN members.
BUNDLE, SHINGLES, BLOCK, COPIES, CHAIN = 4096, 1 << 20, 512, 16, 4096
_RNG = np.random.default_rng(SEED)
_XOR, _TIMES = (_RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of all runs of five words; a shorter text is one shingle, no words have none."""
    if not words:
        return np.zeros(0, np.uint64)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = min(SHINGLE, len(words)) - 1
    return np.unique(np.array([digest(text[a:b], SEED) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)], np.uint64))


def bands(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """One key a band, of its rows' least hashes, and 32 bits of each row as a signature."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for lo in range(0, len(hashes), 128):
            least = np.minimum(least, ((hashes[lo : lo + 128] ^ _XOR) * _TIMES).min(axis=1))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], (least >> np.uint64(32)).astype("<u4").tobytes()


def sketches(docs: DataFrame, id_col: str) -> DataFrame:
    """(doc_id, fp, node, n, bands, sig): each text's fingerprint, its hash, how many shingles, keys and signature; wordless texts have none."""

    def run(batches):
        for batch in batches:
            found = []
            for words in simhash.words(batch.column(1)):
                hashes = shingles(words)
                keys, sig = bands(hashes) if words else ([], b"")
                keys = np.array(keys, np.uint64).view(np.int64)
                node = np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).view(np.int64)
                found.append((np.uint64(simhash.fingerprint(words)).view(np.int64), node, len(hashes), keys, sig))
            fp, node, n, keys, sig = zip(*found, strict=True) if found else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "fp", "node", "n", "bands", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, node long, n long, bands array<long>, sig binary")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, h): the shingles of (node, text)."""

    def run(batches):
        for batch in batches:
            found = [shingles(words).view(np.int64) for words in simhash.words(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "h"])

    return docs.select("node", F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, h array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are near copies."""
    x, y = (sets.select(F.col("node").alias(f"{c}n"), F.col("h").alias(f"{c}h")) for c in "xy")
    both = pairs.join(x, F.col("a") == F.col("xn")).join(y, F.col("b") == F.col("yn"))
    same = F.size(F.array_intersect("xh", "yh"))
    return both.filter(100 * same >= SIMILAR * (F.size("xh") + F.size("yh") - same)).select("a", "b")


def _agreement(left: np.ndarray, right: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two blocks' signatures, pair by pair: how many rows agree, and whether a band before this one does."""
    equal, before = np.zeros((len(left), len(right)), np.uint8), np.zeros((len(left), len(right)), bool)
    for k in range(BANDS):
        all_ = np.ones(equal.shape, bool)
        for row in range(k * ROWS, (k + 1) * ROWS):
            same = left[:, row, None] == right[None, :, row]
            equal += same
            all_ &= same
        if k < band:
            before |= all_
    return equal, before


def _compared(members: DataFrame, run, schema: str) -> DataFrame:
    """run over the members (band, pos, node, n, c, sig, ...) of open bands: small bands together, pairs of blocks of large ones."""
    sizes = common.written(members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")), "sizes")
    n, shingles = sizes.agg(F.sum("size"), F.sum("shingles")).first()
    bundles = max(1, (n or 0) // BUNDLE, (shingles or 0) // SHINGLES)
    full = members.join(sizes, "band").withColumn("blocks", F.least(F.lit(COPIES), F.ceil(F.col("size") / BLOCK)).cast("int"))
    full = full.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("x"), F.greatest("mine", o).alias("y")))
    spread = full.drop("size", "shingles").select("*", F.inline(pairs))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("band"), F.lit(bundles))).otherwise(F.xxhash64("band", "x", "y"))
    return spread.withColumn("group_", group).drop("blocks").groupBy("group_").applyInArrow(run, schema)


def _open_pairs(table: pa.Table):
    """Row pairs of a group's table, sorted by band and blocks, that have to be checked: (table, band, i, j) by tiles."""
    table = table.sort_by([("band", "ascending"), ("x", "ascending"), ("y", "ascending")]).combine_chunks()
    t = {c: table.column(c).to_numpy() for c in ("band", "pos", "n", "c", "mine", "x", "y")}
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(len(table), -1)
    new = np.flatnonzero(np.concatenate([[True], *([np.any([np.diff(t[c]) != 0 for c in ("band", "x", "y")], axis=0)] if len(table) > 1 else [])]))
    for lo, hi in zip(new, [*new[1:], len(table)], strict=True):
        rows, same = np.arange(lo, hi), t["x"][lo] == t["y"][lo]
        mine = rows[t["mine"][rows] == t["x"][lo]]
        theirs = mine if same else rows[t["mine"][rows] == t["y"][lo]]
        for a in range(0, len(mine), BLOCK):
            for b in range(a if same else 0, len(theirs), BLOCK):
                i, j = mine[a : a + BLOCK], theirs[b : b + BLOCK]
                equal, before = _agreement(sig[i], sig[j], int(t["pos"][lo]))
                some = (100 * equal.astype(np.int32) >= LEAST_EQUAL * sig.shape[1]) & ~before
                some &= t["c"][i][:, None] != t["c"][j][None, :]
                some &= 100 * np.minimum(t["n"][i][:, None], t["n"][j][None, :]) >= SIMILAR * np.maximum(t["n"][i][:, None], t["n"][j][None, :])
                p, q = np.nonzero(some)
                if len(p):
                    yield table, t["band"][lo], i[p], j[q]


def _marked(table: pa.Table) -> pa.Table:
    """(band, node) of the members that have a pair to check."""
    nodes, found = table.column("node"), [(np.zeros(0, np.int64),) * 2]
    for table_, band, i, j in _open_pairs(table):
        nodes = table_.column("node").to_numpy()
        own = np.unique(np.concatenate([nodes[i], nodes[j]]))
        found.append((np.full(len(own), band), own))
    both = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], axis=1), axis=0)
    return pa.table({"band": both[:, 0], "node": both[:, 1]})


def _checked(table: pa.Table) -> pa.Table:
    """(a, b): every member with a near copy, and the least member of its group in this task."""
    edges: list[tuple[int, int]] = []
    for table_, _, i, j in _open_pairs(table):
        nodes, sets = table_.column("node").to_numpy(), table_.column("h").chunk(0)
        flat, at = sets.flatten().to_numpy().view(np.uint64), sets.offsets.to_numpy() - sets.offsets[0].as_py()
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]]
            place = np.minimum(np.searchsorted(a, b), len(a) - 1)
            both = int((a[place] == b).sum())
            if 100 * both >= SIMILAR * (len(a) + len(b) - both):
                edges.append((int(nodes[x]), int(nodes[y])))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    ends = [(x, find(x)) for x in root]
    return pa.table({"a": pa.array([x for x, _ in ends], pa.int64()), "b": pa.array([y for _, y in ends], pa.int64())})


def links(docs: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints of near copies; `table` holds the sketches of docs by `key`."""
    first = table.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "fp", "n", "bands", "sig")).alias("x"))
    texts = common.written(first.select("node", "x.*"), "texts")
    each = texts.select("node", "n", F.posexplode("bands").alias("pos", "band"))
    sized = each.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("head")).filter("size > 1")
    sized = common.written(sized, "bands")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHAIN))  # a chain of a hot band is cut into parts
    chain = Window.partitionBy("band", "part").orderBy("node")
    met = each.join(sized, "band").withColumn("part", part).withColumn("before", F.struct(F.lag("node").over(chain).alias("node"), F.lag("n").over(chain).alias("n")))
    met = common.written(met.drop("part", "size"), "met")
    like = lambda n, m: 100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)
    pairs = met.select(F.col("node").alias("a"), "n", F.explode(F.array("before", "head")).alias("o"))
    pairs = pairs.filter(F.col("o.node").isNotNull() & (F.col("o.node") != F.col("a")) & like(F.col("n"), F.col("o.n"))).select("a", F.col("o.node").alias("b")).distinct()
    pairs = common.written(pairs, "pairs")
    of_text = lambda nodes: docs.select(F.col(key).alias("key_"), "text").join(nodes.join(texts.select("node", F.col("doc_id").alias("id_")), "node"), F.col("key_") == F.col("id_"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = common.written(_sets(of_text(ends)), "sets")
    edges = common.written(_verified(pairs, sets), "near")

    parts = graph.components(edges).withColumnRenamed("node", "p")
    placed = met.join(parts, F.col("node") == F.col("p"), "left").select("band", "pos", "node", "n", F.coalesce("component", "node").alias("c"))
    placed = common.written(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select(F.col("band").alias("mixed"))
    open_ = placed.join(mixed, F.col("band") == F.col("mixed"), "left_semi").join(texts.select(F.col("node").alias("t"), "sig"), F.col("node") == F.col("t")).drop("t")
    open_ = common.written(open_, "open")
    marked = common.written(_compared(open_, _marked, "band long, node long").distinct(), "marked")
    more = common.written(_sets(of_text(marked.select("node").distinct())).withColumnRenamed("node", "t"), "sets")
    left = open_.join(marked, ["band", "node"], "left_semi").join(more, F.col("node") == F.col("t")).drop("t")
    edges = edges.unionByName(common.written(_compared(common.written(left, "left"), _checked, "a long, b long"), "near"))
    of = lambda c, to: texts.select(F.col("node").alias(c), F.col("fp").alias(to))
    return common.written(edges.join(of("a", "fa"), "a").join(of("b", "fb"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b")), "nearlinks")


@common.tidied
def dedup(docs: DataFrame) -> DataFrame:
    """One document of each class, the first by doc_id, in the documents' own columns.

    A class is all that near copies and fingerprints within simhash's radius connect. Ids that are null or
    repeated are replaced by row numbers for the choice alone; wordless and null texts are one class.
    """
    rows, key = common.keyed(docs)
    table = common.written(sketches(rows, key), "sketches")
    kept = simhash.classed(table.select("doc_id", "fp"), links(rows, key, table)).filter("doc_id = component_id").select(F.col("doc_id").alias("keep_key"))
    return rows.join(kept, rows[key] == kept.keep_key, "left_semi").drop(key)
