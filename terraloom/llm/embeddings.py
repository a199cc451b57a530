"""Embedding near-dedup by a forest of random-projection trees with spill.

Equal vectors of a label are one point. Every tree splits its label's points again and again: along random
directions it takes the cut that the fewest points lie near, and points near it go to both sides. Points go
down the trees as ids with a few projections; their vectors meet them once, in the leaves. Leaves are
compared whole, in double precision. A pair that shares several leaves is counted in the first of them
alone, so only counts and one link to the leaf's component leave a leaf, never its pairs.

How near is near to a cut follows from the threshold and the number of dimensions: the projections of two
vectors r apart differ by r / sqrt(dimensions) typically, and both sides take what lies within MARGIN times that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import common, graph

LEAST_COSINE, TREES, LEAF, MARGIN, SEED = 0.98, 4, 256, 0.7, 42
#: Points a node's cuts are fitted on, directions tried at each level, levels cut at once, and rounds in all.
SAMPLE, DIRECTIONS, STEP, ROUNDS = 1024, 6, 4, 12
#: A cut that sends more than this share of a node to one side, or more than MOST_BOTH to the two together,
#: doesn't divide it; such a node is a leaf, whatever its size.
WORST, MOST_BOTH = 0.85, 1.6
#: Rows of leaves that one group holds. A leaf of over BLOCK points is compared in pairs of blocks: COPIES blocks
#: at most, as long as a block of that size has BLOCK_VALUES numbers at most.
BUNDLE, BLOCK, COPIES, BLOCK_VALUES = 4096, 1024, 16, 1 << 24
#: Edges of a group that are gathered before they are reduced to one for each point.
EDGES = 1 << 22


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()


def points(vectors: DataFrame) -> DataFrame:
    """(vec_id, h, g, label, dim, v) of every row; h and g are 128 bits that name the label and the vector.

    They and the label are null where the vector can't link: its label is null, or it is null, empty, zero or
    holds a component that is null or not finite.
    """
    kind = "double" if "array<double>" in dict(vectors.dtypes)["embedding"] else "float"
    schema = f"vec_id long, h long, g long, label long, dim int, v array<{kind}>"

    def name(batches):
        for batch in batches:
            ids, labels, v = batch.columns
            sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
            flat, at = _rows(v)
            flat = flat.astype(kind) + np.dtype(kind).type(0)  # minus zero is zero
            good = np.concatenate([[0], np.cumsum(np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            a, b = at[:-1], at[1:]
            able = (sizes > 0) & (good[b] - good[a] == sizes) & (some[b] > some[a]) & labels.is_valid().to_numpy(zero_copy_only=False)
            names = np.zeros((batch.num_rows, 3), np.uint64)
            groups: dict = {}
            for i, text in zip(np.flatnonzero(able).tolist(), labels.filter(pa.array(able)).to_pylist(), strict=True):
                key = groups.get((text, sizes[i]))
                if key is None:
                    key = groups[(text, sizes[i])] = xxhash.xxh64_intdigest(f"{sizes[i]}:{text}")
                full = xxhash.xxh3_128_intdigest(flat[a[i] : b[i]].tobytes(), key)
                names[i] = full >> 64, full & (2**64 - 1), key
            h, g, label = (pa.array(np.ascontiguousarray(names[:, k]).view(np.int64), mask=~able) for k in range(3))
            yield pa.RecordBatch.from_arrays([ids, h, g, label, pa.array(sizes.astype(np.int32)), v], names=["vec_id", "h", "g", "label", "dim", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    return rows.mapInArrow(name, schema)


# --- trees -----------------------------------------------------------------------------------------------


def _directions(seed: int, tree: int, depth: int, dim: int) -> np.ndarray:
    """The directions of a tree's next STEP levels, as columns; all nodes of a level try the same ones."""
    d = np.random.default_rng([seed, tree, depth, dim]).standard_normal((dim, STEP * DIRECTIONS))
    return d / np.linalg.norm(d, axis=0)


def _projected(distinct: DataFrame, trees: int, depth: int, seed: int) -> DataFrame:
    """(pid, tree, p): every point's projections at the next STEP levels of each tree."""

    def project(batches):
        for batch in batches:
            flat, at = _rows(batch.column(1))
            sizes = np.diff(at)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                v = flat[at[rows][:, None] + np.arange(dim)].astype(float)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                for tree in range(trees):
                    p = (v @ _directions(seed, tree, depth, int(dim))).astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), tree, np.int32)), lists], names=["pid", "tree", "p"])

    return distinct.select("pid", "v").mapInArrow(project, "pid long, tree int, p array<float>")


def _cut(p: np.ndarray, spill: float):
    """(direction, threshold) that divides the sample with the least spill, or None if nothing does; p: (points, directions)."""
    best = None
    for d in range(p.shape[1]):
        q = np.sort(p[:, d])
        at = q[(np.linspace(0.25, 0.75, 21) * (len(q) - 1)).astype(int)]
        left, right = np.searchsorted(q, at + spill, side="right"), len(q) - np.searchsorted(q, at - spill, side="left")
        i = np.argmin(np.maximum(left, right) + 0.5 * (left + right))
        worst, both = max(left[i], right[i]) / len(q), (left[i] + right[i]) / len(q)
        if worst <= WORST and both <= MOST_BOTH and (best is None or both < best[0]):
            best = both, d, float(at[i])
    return best and best[1:]


def _grow(p: np.ndarray, leaf: float, spill: float) -> np.ndarray:
    """A node's next STEP levels, fitted on a sample: (direction or -1, low, high) at each place of a heap."""
    heap = np.full((2**STEP - 1, 3), -1, np.float32)

    def cut(p: np.ndarray, level: int, place: int) -> None:
        found = _cut(p[:, level * DIRECTIONS : (level + 1) * DIRECTIONS], spill) if level < STEP and len(p) > leaf else None
        if found:
            d, t = found
            heap[place] = d, t - spill, t + spill
            q = p[:, level * DIRECTIONS + d]
            cut(p[q <= heap[place, 2]], level + 1, 2 * place + 1)
            cut(p[q >= heap[place, 1]], level + 1, 2 * place + 2)

    cut(p, 0, 0)
    return heap


def _walk(p: np.ndarray, heaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places that rows reach; a place within the heap is a leaf."""
    rows, place, out = np.arange(len(p)), np.zeros(len(p), np.int64), []
    for level in range(STEP):
        d, low, high = heaps[rows, place].T
        ended = d < 0
        out.append((rows[ended], place[ended]))
        rows, place, d, low, high = (x[~ended] for x in (rows, place, d.astype(np.int64), low, high))
        q = p[rows, level * DIRECTIONS + d]
        left, right = q <= high, q >= low
        rows, place = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * place[left] + 1, 2 * place[right] + 2])
    return tuple(np.concatenate(x) for x in zip(*out, (rows, place), strict=True))


def _moved(batches):
    """Rows (pid, tree, node, p, heap) to the nodes they reach: (pid, tree, node, final)."""
    for batch in batches:
        p, heap = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (3, 4))
        rows, place = _walk(p, heap.reshape(len(heap), -1, 3))
        node = batch.column(2).to_numpy()[rows].view(np.uint64)
        with np.errstate(over="ignore"):
            below = (node ^ (node >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            below ^= below >> np.uint64(29)
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(below.view(np.int64)), pa.array(place < 2**STEP - 1)], names=["pid", "tree", "node", "final"])


def leaves(distinct: DataFrame, least: float = LEAST_COSINE, trees: int = TREES, leaf: int | None = None, margin: float = MARGIN, seed: int = SEED) -> DataFrame:
    """(pid, leaf, n): every point once for each leaf it lies in, and the leaf's size; leaf numbers grow with the tree.

    Nodes over `leaf` points, LEAF if not given, are cut STEP levels a round, on SAMPLE points each drawn by hash; all points
    then descend. Rounds end when no node is over `leaf` or no cut divides it. Only ids, projections and cuts
    move; cuts are joined, so Spark broadcasts them only where they are small.
    """
    leaf = leaf or LEAF
    spill = F.lit(margin * float(np.sqrt(2 - 2 * least))) / F.sqrt(F.col("dim").cast("double"))
    rows = distinct.select("pid", F.explode(F.array(*(F.lit(t) for t in range(trees)))).alias("tree"), F.xxhash64("label", "dim").alias("node"))
    done = None
    for depth in range(ROUNDS):
        sizes = common.written(rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")), "nodes")
        sized = rows.join(sizes, ["tree", "node"])
        if sizes.filter(F.col("n") > leaf).isEmpty():
            done = sized if done is None else done.unionByName(sized)
            break
        small = sized.filter(F.col("n") <= leaf)
        done = small if done is None else done.unionByName(small)
        large = sized.filter(F.col("n") > leaf).join(distinct.select("pid", spill.alias("spill")), "pid")
        here = common.written(large.join(_projected(distinct, trees, depth, seed), ["pid", "tree"]), "projected")
        lot = F.pmod(F.xxhash64("pid", "tree", F.lit(depth)), F.lit(1 << 30)) / float(1 << 30)
        drawn = here.filter(lot < SAMPLE / F.col("n")).select("tree", "node", "n", "spill", "p")

        def fit(key, frame):
            heap = _grow(np.stack(frame["p"].to_list()), leaf * len(frame) / int(frame["n"].iloc[0]), float(frame["spill"].iloc[0]))
            return pd.DataFrame({"tree": [int(key[0])], "node": [int(key[1])], "heap": [heap.ravel()]})

        cuts = common.written(drawn.groupBy("tree", "node").applyInPandas(fit, "tree int, node long, heap array<float>"), "cuts")
        none = F.array_repeat(F.lit(-1.0).cast("float"), 3 * (2**STEP - 1))  # a node without a sample isn't cut
        heaped = here.join(cuts, ["tree", "node"], "left").select("pid", "tree", "node", "p", F.coalesce("heap", none).alias("heap"))
        below = heaped.mapInArrow(_moved, "pid long, tree int, node long, final boolean")
        below = common.written(below, f"level{depth}")
        common.discard(here)
        ended = below.filter("final").drop("final")
        done = done.unionByName(ended.join(common.written(ended.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")), "ended"), ["tree", "node"]))
        rows = below.filter("not final").drop("final")
    else:
        done = done.unionByName(rows.join(common.written(rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")), "ended"), ["tree", "node"]))
    # Numbers that sort by tree: the tree in the top bits.
    return done.select("pid", (F.col("tree").cast("long") * F.lit(1 << 56) + F.shiftrightunsigned("node", 8)).alias("leaf"), "n")


# --- leaves ----------------------------------------------------------------------------------------------


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n indices reaches over the edges i, j."""
    root = np.arange(n)
    while True:  # the least index spreads along edges, and along its own chain
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


class _Side:
    """Points of a leaf's block: unit vectors, weights, ids, and which leaves before this one each is in."""

    def __init__(self, table: dict, rows: np.ndarray, own: int):
        flat, at = table["v"]
        v = flat[at[rows][:, None] + np.arange(at[rows[0] + 1] - at[rows[0]])].astype(float)
        v /= np.abs(v).max(axis=1, keepdims=True)
        self.v, self.pid, self.mult = v / np.linalg.norm(v, axis=1, keepdims=True), table["pid"][rows], table["mult"][rows]
        leaves, at = table["leaves"]
        width = int((at[rows + 1] - at[rows]).max())
        padded = np.where(np.arange(width) < (at[rows + 1] - at[rows])[:, None], leaves[np.minimum(at[rows][:, None] + np.arange(width), len(leaves) - 1)], own)
        self.before = np.where(padded < own, padded, -1)

    def __len__(self):
        return len(self.pid)


def _linked(left: _Side, right: _Side, same: bool, least: float):
    """(ids, links, roots) of the points with a link between the two sides that no leaf before holds, by tiles."""
    ids = np.concatenate([left.pid, *([] if same else [right.pid])])
    shift, counts = 0 if same else len(left), np.zeros(len(ids), np.int64)
    edges: list = []
    for a in range(0, len(left), BLOCK):
        for b in range(a if same else 0, len(right), BLOCK):
            i, j = np.nonzero(left.v[a : a + BLOCK] @ right.v[b : b + BLOCK].T >= least)
            i, j = i + a, j + b
            if same:
                i, j = i[i < j], j[i < j]
            first = np.ones(len(i), bool)
            for x in range(left.before.shape[1]):
                mine = left.before[i, x]
                some = np.flatnonzero((mine >= 0) & first)
                if len(some):
                    first[some] = (right.before[j[some]] != mine[some, None]).all(axis=1)
            i, j = i[first], j[first]
            if len(i):
                counts += np.bincount(i, right.mult[j], len(ids)).astype(np.int64)
                counts += np.bincount(j + shift, left.mult[i], len(ids)).astype(np.int64)
                edges.append((i, j + shift))
                if sum(len(e[0]) for e in edges) > EDGES:
                    edges = [(np.arange(len(ids)), _least(len(ids), *(np.concatenate(e) for e in zip(*edges, strict=True))))]
    if not edges:
        return ids[:0], counts[:0], ids[:0]
    root = _least(len(ids), *(np.concatenate(e) for e in zip(*edges, strict=True)))
    some = counts > 0
    return ids[some], counts[some], ids[root][some]


def links(distinct: DataFrame, in_leaves: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(pid, n, a): how many vectors of other points each point links with, leaf by leaf, and link edges.

    Vectors meet their leaves once. Small leaves share a group; the blocks of a large one meet in pairs, each
    pair a group. Edges tie the linked points of a group's leaf to the least of their component there.
    """
    several = common.written(in_leaves.filter("n > 1"), "inleaves")
    bundles = max(1, several.count() // BUNDLE)
    each = several.groupBy("pid").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"), F.collect_set(F.struct("leaf", "n")).alias("at"))
    full = distinct.select("pid", "v", "mult", "dim").join(each, "pid").select("pid", "v", "mult", "dim", "leaves", F.inline("at"))
    wide = F.greatest(F.lit(BLOCK), F.least(F.ceil(F.col("n") / COPIES), F.floor(F.lit(BLOCK_VALUES) / F.col("dim"))))
    full = full.withColumn("blocks", F.ceil(F.col("n") / wide).cast("int")).withColumn("mine", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("x"), F.greatest("mine", o).alias("y")))
    spread = full.select("pid", "v", "mult", "leaf", "mine", "leaves", "blocks", F.inline(pairs))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("leaf"), F.lit(bundles))).otherwise(F.xxhash64("leaf", "x", "y"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("leaf", "ascending"), ("x", "ascending"), ("y", "ascending")]).combine_chunks()
        column = lambda c: table.column(c).chunk(0)
        t = {c: column(c).to_numpy() for c in ("pid", "mult", "leaf", "mine", "x", "y")} | {c: _rows(column(c)) for c in ("v", "leaves")}
        new = np.flatnonzero(np.concatenate([[True], *([np.any([np.diff(t[c]) != 0 for c in ("leaf", "x", "y")], axis=0)] if len(table) > 1 else [])]))
        found = []
        for lo, hi in zip(new, [*new[1:], len(table)], strict=True):
            leaf, x, y = (int(t[c][lo]) for c in ("leaf", "x", "y"))
            rows = np.arange(lo, hi)
            mine, theirs = rows[t["mine"][rows] == x], rows[t["mine"][rows] == y]
            if len(mine) and len(theirs):
                left = _Side(t, mine, leaf)
                found.append(_linked(left, left if x == y else _Side(t, theirs, leaf), x == y, least))
        pid, n, a = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((),) * 3))
        return pa.table({"pid": pid, "n": n, "a": a})

    return spread.withColumn("group_", group).drop("blocks").groupBy("group_").applyInArrow(run, "pid long, n long, a long")


@common.tidied
def classes(vectors: DataFrame, least: float = LEAST_COSINE, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors link only within their label, by cosine. Null labels, and vectors that are null, empty, zero or
    hold a null or non-finite component, link with nothing and are kept. Repeated rows link with each other
    like any other two vectors; null vec_ids link too, and a component of null ids alone has a null id.
    """
    rows = common.written(points(vectors), "points")
    able = rows.filter("h is not null")
    distinct = able.groupBy("h", "g").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("v").alias("v"), F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"))
    distinct = common.written(distinct.withColumn("pid", F.monotonically_increasing_id()), "distinct")
    found = common.written(links(distinct, leaves(distinct, least, **options), least), "links")
    n = found.groupBy("pid").agg(F.sum("n").alias("n"))
    parts = graph.components(found.select(F.col("pid").alias("a"), F.col("a").alias("b")))
    whole = distinct.drop("v", "label", "dim").join(n, "pid", "left").join(parts, F.col("pid") == F.col("node"), "left")
    whole = whole.select("h", "g", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "pid").alias("component"))
    whole = common.written(whole, "whole")
    lowest = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    known = whole.join(lowest, "component").select("h", "g", "n_links", "component_id")
    linked = able.select("vec_id", "h", "g").join(known, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
near AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= {LEAST_COSINE}),
reach AS (SELECT r AS a, r AS b FROM e UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
part AS (SELECT reach.a, min(e.vec_id) AS component_id FROM reach JOIN e ON reach.b = e.r GROUP BY reach.a),
deg AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, part.component_id, e.vec_id IS NOT DISTINCT FROM part.component_id AS kept
FROM e JOIN part ON e.r = part.a LEFT JOIN deg ON e.r = deg.a"""

QUERIES = {"op2_projection_forest": op2_projection_forest}
ORACLES = {"op2_projection_forest": ORACLE}
