"""Best-fit packing of tokenized documents into fixed-length sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the whole problem is a histogram of at most `capacity`
entries, whatever the corpus size. The driver plans on that histogram alone: large lengths are rounded up
within groups of equal cardinality, a linear program over configurations of those few sizes is solved by
column generation, the actual lengths take the places of their rounded ones, and everything else goes
best-fit, largest first, into the space that is left. The plan is a table of intervals of ranks; a document
finds its place by its length and its rank among equals.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm import common, tokens

CAPACITY, END_ID, GROUPS = 4096, 1, 64
#: Turns that pieces take in each task; ranks of one length are counted over as many buckets of turns as keep
#: a bucket near BUCKET_ROWS, within these bounds.
TURNS, LEAST_BUCKETS, BUCKET_ROWS = 65_536, 256, 1_000_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, bucket and, if asked for, ids.

    Null and empty texts are one end id. Texts are cut only where longer than the capacity.
    """

    def cut(batches):
        coder, turn = tokens.encoder(tokenizer), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                ids, bounds = coder.encode(batch.column(1))
                n = np.diff(bounds) + 1
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                first = np.repeat(np.cumsum(count) - count, count)
                piece = np.arange(len(row)) - first
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                crc, out = np.empty(len(row), np.int64), []
                ended = np.insert(ids, bounds[1:], END_ID).astype("<u4")
                base = (bounds[:-1] + np.arange(len(n)))[row] + start
                for i, (a, m) in enumerate(zip(base.tolist(), length.tolist(), strict=True)):
                    crc[i] = zlib.crc32(ended[a : a + m].tobytes())
                cols = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array((turn + np.arange(len(row))) % TURNS, pa.int32())]
                turn += len(row)
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ended.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bucket"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Columns and values of the configuration LP's optimum: min sum x, patterns x >= counts."""
    k = len(sizes)
    pats = [np.eye(k, dtype=int)[j] * (capacity // sizes[j]) for j in range(k)]
    inverse = np.diag([1.0 / p[j] for j, p in enumerate(pats)])
    x = inverse @ np.array(counts, float)
    for _ in range(60 * k):
        price = np.maximum(inverse.sum(axis=0), 0)
        best, choice = np.zeros(capacity + 1), []
        for s, y in zip(sizes, price, strict=True):
            for _ in range(capacity // s):
                more = best[:-s] + y
                better = more > best[s:] + 1e-12
                if not better.any():
                    break
                choice.append((s, better))
                best = best.copy()
                best[s:] = np.where(better, more, best[s:])
        if best[-1] <= 1 + 1e-7:
            break
        column, at, where = np.zeros(k, int), capacity, {s: j for j, s in enumerate(sizes)}
        for s, better in reversed(choice):
            if at >= s and better[at - s]:
                column[where[s]] += 1
                at -= s
        change = inverse @ column
        rows = np.flatnonzero(change > 1e-9)
        if not len(rows):
            break
        out = rows[np.argmin(x[rows] / change[rows])]
        step = x[out] / change[out]
        x = np.maximum(x - step * change, 0)
        x[out] = step
        inverse[out] /= change[out]
        others = np.arange(k) != out
        inverse[others] -= np.outer(change[others], inverse[out])
        pats[out] = column
    return [(p.tolist(), v) for p, v in zip(pats, x, strict=True)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """Intervals (length, first rank, items, first sequence, items a sequence, first offset), and the sequences."""
    out, bins, taken = [], 0, dict.fromkeys(histogram, 0)
    if n := histogram.get(capacity, 0):
        out.append((capacity, 0, n, 0, 1, 0))
        bins, taken[capacity] = n, n
    large = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if capacity // 8 < s < capacity]
    free: dict[int, list[tuple[int, int]]] = {}  # space left: runs of (first sequence, sequences)

    def leave(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in free:
                insort(spaces, space)
            free.setdefault(space, []).append((first, count))

    spaces: list[int] = []
    total = sum(n for _, n in large)
    if total:
        # Groups of equal cardinality by falling length, as streams of (length, first rank, items).
        share, streams = -(-total // groups), [[]]
        room = share
        for s, n in large:
            at = 0
            while at < n:
                if not room:
                    streams.append([])
                    room = share
                take = min(room, n - at)
                streams[-1].append((s, at, take))
                at, room = at + take, room - take
        merged: dict[int, list] = {}
        for g in streams:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        lines = [list(reversed(merged[s])) for s in sizes]
        counts = [sum(x[2] for x in merged[s]) for s in sizes]
        for pattern, value in sorted(configurations(sizes, counts, capacity), key=lambda p: -p[1]):
            runs = int(value + 1e-6)
            slots = [j for j, a in enumerate(pattern) for _ in range(a)]
            runs = min([runs, *(counts[j] // pattern[j] for j in set(slots))])
            if not runs or not slots:
                continue
            filled = []
            for j in slots:
                counts[j] -= runs
                need, segments = runs, []
                while need:
                    s, at, n = lines[j].pop()
                    take = min(need, n)
                    segments.append((s, at, take))
                    if n > take:
                        lines[j].append((s, at + take, n - take))
                    need -= take
                filled.append(segments)
            cuts = sorted({0, runs, *(int(c) for g in filled for c in np.cumsum([x[2] for x in g]))})
            places, done = [0] * len(filled), [0] * len(filled)
            for a, b in zip(cuts, cuts[1:], strict=False):
                offset = 0
                for i, g in enumerate(filled):
                    s, at, n = g[places[i]]
                    out.append((s, at + done[i], b - a, bins + a, 1, offset))
                    offset += s
                    done[i] += b - a
                    if done[i] == n:
                        places[i], done[i] = places[i] + 1, 0
                leave(capacity - offset, bins + a, b - a)
            bins += runs
        rest: dict[int, list[tuple[int, int]]] = {}
        for line in lines:
            for s, at, n in line:
                rest.setdefault(s, []).append((at, n))
    else:
        rest = {}
    for s, n in histogram.items():
        if s <= capacity // 8:
            rest.setdefault(s, []).append((0, n))
    for s in sorted(rest, reverse=True):
        for at, n in rest[s]:
            while n:
                i = bisect_left(spaces, s)
                if i < len(spaces):
                    space = spaces[i]
                    first, count = free[space].pop()
                    if not free[space]:
                        del free[space], spaces[i]
                else:
                    space, first, count = capacity, bins, -(-n // (capacity // s))
                    bins += count
                fit = space // s
                full = min(count, n // fit)
                if full:
                    out.append((s, at, full * fit, first, fit, capacity - space))
                    leave(space - fit * s, first, full)
                    at, n, first, count = at + full * fit, n - full * fit, first + full, count - full
                if n and count:
                    out.append((s, at, n, first, fit, capacity - space))
                    leave(space - n * s, first, 1)
                    first, count, n = first + 1, count - 1, 0
                leave(space, first, count)
    return out, bins


def place(rows: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """rows (length, bucket, ...) with sequence_id and offset added.

    The ranks among rows of one length are dealt over buckets, so that a length which a third of all rows
    share still goes to many tasks. Only the histogram (at most `capacity` entries) reaches the driver.
    """
    spark = rows.sparkSession
    buckets = min(TURNS, max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.col("bucket") % buckets)
    each = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in each.groupBy("length").agg(F.sum("n")).collect()}
    intervals, _ = plan(histogram, capacity, groups)
    table = np.array(sorted(intervals), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("rank", within - 1)
    ranked = ranked.join(offsets, (ranked.length == offsets.l) & (ranked.bucket == offsets.b)).withColumn("rank", F.col("rank") + F.col("before")).drop("l", "b", "before", "bucket")

    def look(batches):
        t = shared.value
        keys = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            length = batch.column(at_length).to_numpy()
            rank = batch.column(at_rank).to_numpy()
            i = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            nth = rank - t[i, 1]
            sequence, slot = t[i, 3] + nth // t[i, 4], nth % t[i, 4]
            cols = [c for j, c in enumerate(batch.columns) if j != at_rank]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(t[i, 5] + slot * length)], names=names)

    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    names = [f.name for f in kept] + ["sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(look, schema)


@common.tidied
def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, keep_ids: bool = False) -> DataFrame:
    """Pack every document (doc_id, text, any other columns) into sequences of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.
    Null and empty texts are one end id; repeated rows and null doc_ids are packed like any other; an empty
    table packs to no rows; other columns, whatever their names, are left out.
    """
    rows = common.written(pieces(docs, tokenizer or tokens.default_path(), capacity, keep_ids), "pieces")
    return place(rows, capacity, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves from pack(keep_ids=True): sequence_id, ids, doc_ids; each at most one capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


@common.tidied
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict = {}
