"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

A word's probability is its class's, given the words before it, times its own within the class. Frequent
words fill classes of a few members each; the next ones are classed by how often they occur; all others, the
never seen among them, are one class. Both softmaxes read hashed features of the context: the word before,
the two before as one, and the one before the last alone (a skip). The model grows with the training tokens:
the hash buckets with their third root, so that it still fits a task, and the classes' members with their eighth.

Training runs over every training document: tasks gather observed and expected feature counts in dense
blocks, the blocks are added up in a tree, and the weights take a gradient step, observed minus expected
over their logarithmic mean. Scoring runs in numpy batches. Only the words of `table` travel to the tasks;
counts of all other words stay in a distributed table and meet the documents' words in a join.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import common

FOLDS, HELD_OUT = 7, 2
#: Most words whose counts are sent to every task, and their least count: rarer ones stand for the unseen.
TABLE, LEAST = 400_000, 4
HEAD_CLASSES, COUNT_CLASSES = 24, 7
#: Context features, and least hash buckets of each.
FEATURES, LEAST_BUCKETS = 3, 256
ROUNDS, RATE, PRIOR = 2, 0.5, 30.0
#: Documents of a numpy batch; parameter rows of a block; blocks added up at once.
BATCH_DOCS, BLOCK, FAN_IN = 1000, 2048, 64
#: Splits of the input that a task of the gradient reads.
SPLITS = 4
#: Tokens whose softmax is taken at once; their rows fit a core's cache.
SLICE = 1 << 15

CLASSES = HEAD_CLASSES + COUNT_CLASSES + 1
RARE = CLASSES - 1
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_EMPTY = np.uint64(xxhash.xxh64_intdigest(b"", 0))
#: No word holds a line break, so these are no word's hashes.
END, START = (np.uint64(xxhash.xxh64_intdigest(x, 0)) for x in (b"\nend", b"\nstart"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == HELD_OUT


@dataclass
class Words:
    """A batch's tokens: distinct hashes, each token's place among them, and each document's first token."""

    distinct: np.ndarray
    index: np.ndarray
    starts: np.ndarray


def tokens(texts: pa.Array) -> Words:
    """Words of whole texts, A-Z lower-cased, and one end for each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts)))), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(w, 0) for w in coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)]
    distinct = np.array([*hashes, END], np.uint64)
    index = coded.indices.to_numpy().astype(np.int64)
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    word = distinct[index] != _EMPTY
    at = np.concatenate([[0], np.cumsum(word)])[bounds]
    index = np.insert(index[word], at[1:], len(hashes))
    return Words(distinct, index, at[:-1] + np.arange(len(texts)))


def shape(n: int) -> tuple[int, int]:
    """(buckets, members) of a model of n training tokens: powers of two, about 13 third and 2 eighth roots of them."""
    bits = np.log2(max(2, n))
    return max(LEAST_BUCKETS, 1 << round(bits / 3 + 3.75)), 1 << round(bits / 8 + 1)


def contexts(w: Words, buckets: int) -> np.ndarray:
    """Buckets (FEATURES, tokens) of the context features; members read half as many, one for two."""
    h = w.distinct[w.index]
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[w.starts] = START
    two[w.starts] = START
    second = w.starts + 1
    two[second[second < len(h)]] = START
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    with np.errstate(over="ignore"):
        mixed = (one * _MIX[0], (one * _MIX[1]) ^ (two * _MIX[2] + _MIX[0]), two * _MIX[3])
        mixed = tuple((m ^ (m >> np.uint64(29))) * _MIX[1] for m in mixed)
    return np.stack([(m >> bits).astype(np.int32) for m in mixed])


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often every token occurs in docs."""

    def count(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2 * BATCH_DOCS):
                w = tokens(batch.column(0).slice(lo, 2 * BATCH_DOCS))
                n = np.bincount(w.index, minlength=len(w.distinct))
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(w.distinct[some].view(np.int64)), pa.array(n[some])], names=["h", "c"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words: sorted hashes with count, class, member number and log10 share of their class."""

    hashes: np.ndarray
    count: np.ndarray
    cls: np.ndarray
    member: np.ndarray
    share: np.ndarray
    class_p: np.ndarray
    member_q: np.ndarray
    n: int
    v: int
    rare_mass: float
    buckets: int
    members: int

    def look(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct word's place in the table, and whether it is there."""
        at = np.minimum(np.searchsorted(self.hashes, w.distinct), len(self.hashes) - 1)
        return at, self.hashes[at] == w.distinct


def lexicon(counts: DataFrame, table: int = TABLE) -> Lexicon:
    """The words whose counts reach a bound that at most `table` words reach, classed; the bound follows the data."""
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    step = F.floor(F.log2("c") * 16)
    sizes = sorted(((int(r[0]), r[1]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for s, k in sizes:
        if total + k > table or 2 ** (s / 16) < LEAST - 0.5:
            break
        total, least = total + k, s
    top = counts.filter(step >= least).toPandas() if least is not None else pd.DataFrame({"h": [], "c": []})
    hashes, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.lexsort((hashes, -c))
    hashes, c = hashes[order], c[order]
    if not len(hashes):  # nothing to train on: one entry that no token equals
        hashes, c = np.array([START], np.uint64), np.array([0], np.int64)
    buckets, members = shape(n)
    rank, head = np.arange(len(c)), HEAD_CLASSES * members
    low, high = (np.log2(max(1, x)) for x in (c[-1], c[min(head, len(c) - 1)]))
    band = np.clip(((high - np.log2(np.maximum(c, 1))) / max(1e-9, high - low) * COUNT_CLASSES).astype(int), 0, COUNT_CLASSES - 1)
    cls = np.where(rank < head, rank // members, HEAD_CLASSES + band)
    mass = np.bincount(cls, c + 1.0, CLASSES)
    rare_mass = float(n - c.sum()) + (v - int((c > 0).sum())) + 1.0
    mass[RARE] = rare_mass
    q = np.full(head, 1e-30)
    q[: min(head, len(c))] = c[:head] + 1.0
    q = q.reshape(HEAD_CLASSES, members)
    share = np.log10((c + 1.0) / mass[cls])
    by = np.argsort(hashes)
    member = np.where(rank < head, rank, -1)
    return Lexicon(hashes[by], c[by], cls[by].astype(np.int16), member[by].astype(np.int32), share[by], np.maximum(mass, 1e-30) / mass.sum(), q / q.sum(axis=1, keepdims=True), n, v, rare_mass, buckets, members)


@dataclass
class Weights:
    classes: np.ndarray  # (FEATURES, buckets, CLASSES)
    members: np.ndarray  # (FEATURES, buckets / 2, HEAD_CLASSES, members)


def _labels(lex: Lexicon, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, known = lex.look(w)
    cls = np.where(known, lex.cls[at], RARE)[w.index]
    member = np.where(known, lex.member[at], -1)[w.index]
    return at, known, cls, member


def _class_p(lex: Lexicon, weights: Weights, features: np.ndarray) -> np.ndarray:
    z = weights.classes[0].take(features[0], axis=0)
    z += weights.classes[1].take(features[1], axis=0)
    z += weights.classes[2].take(features[2], axis=0)
    z += np.log(lex.class_p).astype(np.float32)
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _member_rows(features: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Rows of the member weights, feature by feature, that tokens of a head class read."""
    return (features >> 1).astype(np.int64) * HEAD_CLASSES + cls


def _member_p(lex: Lexicon, weights: Weights, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    z = np.log(lex.member_q).astype(np.float32).take(cls, axis=0)
    for k in range(FEATURES):
        z += weights.members[k].reshape(-1, lex.members).take(rows[k], axis=0)
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _add_rows(total: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
    """total[keys] += rows, by sorting the keys."""
    order = np.argsort(keys.astype(np.uint16 if len(total) <= 1 << 16 else np.uint32), kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total[keys[first]] += np.add.reduceat(rows[order], first, axis=0)


def _gather(docs: DataFrame, lex, weights) -> DataFrame:
    """(kind, block, part, data): blocks of observed counts without weights, of expected ones with them."""

    def run(batches):
        lexicon_, fitted = lex.value, weights and weights.value
        buckets, width = lexicon_.buckets, lexicon_.members
        classes = np.zeros((FEATURES, buckets, CLASSES))
        members = np.zeros((FEATURES, buckets // 2 * HEAD_CLASSES, width))
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_DOCS):
                w = tokens(batch.column(0).slice(lo, BATCH_DOCS))
                features = contexts(w, buckets)
                _, _, cls, member = _labels(lexicon_, w)
                some = np.flatnonzero(member >= 0)
                if fitted is None:
                    rows = _member_rows(features[:, some], cls[some])
                    for k in range(FEATURES):
                        classes[k] += np.bincount(features[k].astype(np.int64) * CLASSES + cls, minlength=buckets * CLASSES).reshape(buckets, CLASSES)
                        members[k] += np.bincount(rows[k] * width + member[some] % width, minlength=members[k].size).reshape(members[k].shape)
                    continue
                for at in range(0, len(w.index), SLICE):
                    part = slice(at, at + SLICE)
                    p = _class_p(lexicon_, fitted, features[:, part])
                    for k in range(FEATURES):
                        _add_rows(classes[k], features[k, part], p)
                for at in range(0, len(some), SLICE):
                    part = some[at : at + SLICE]
                    own = cls[part].astype(np.int64)
                    rows = _member_rows(features[:, part], own)
                    p = _member_p(lexicon_, fitted, rows, own)
                    for k in range(FEATURES):
                        _add_rows(members[k], rows[k], p)
        part = TaskContext.get().partitionId()
        for kind, rows in (("classes", classes.reshape(-1, CLASSES)), ("members", members.reshape(-1, width))):
            size = BLOCK
            for block in range(0, len(rows), size):
                data = rows[block : block + size].astype(np.float32)
                if data.any():
                    yield pa.RecordBatch.from_pydict({"kind": [kind], "block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([zlib.compress(data.tobytes(), 1)], pa.binary())})

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return _joined(texts).mapInArrow(run, "kind string, block int, part int, data binary")


def _joined(texts: DataFrame) -> DataFrame:
    """texts with SPLITS splits a task, as every task sends a whole model's blocks; two tasks a core stay, if there are so many."""
    splits = texts._jdf.queryExecution().toRdd().getNumPartitions()
    least = 2 * texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(max(least, splits // SPLITS)) if splits > least else texts


def _added(blocks: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """The blocks' sums, FAN_IN at a time in a tree; as many as the model has reach the driver."""

    def add(key, frame):
        total = sum(np.frombuffer(zlib.decompress(d), np.float32).astype(np.float64) for d in frame["data"])
        return pd.DataFrame({"kind": [key[0]], "block": [key[1]], "part": [key[2]], "data": [zlib.compress(total.astype(np.float32).tobytes(), 1)]})

    blocks = common.written(blocks, "blocks")
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        up = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        lower, blocks = blocks, common.written(up.groupBy("kind", "block", "part").applyInPandas(add, blocks.schema), "blocks")
        common.discard(lower)
        parts = -(-parts // FAN_IN)
    return {(r["kind"], r["block"]): np.frombuffer(zlib.decompress(r["data"]), np.float32) for r in blocks.collect()}


def _dense(found: dict, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    classes, members = np.zeros((FEATURES * lex.buckets, CLASSES), np.float32), np.zeros((FEATURES * (lex.buckets // 2) * HEAD_CLASSES, lex.members), np.float32)
    for (kind, block), data in found.items():
        into = classes if kind == "classes" else members
        rows = data.reshape(-1, into.shape[1])
        into[block : block + len(rows)] = rows
    return classes.reshape(FEATURES, lex.buckets, CLASSES), members.reshape(FEATURES, lex.buckets // 2, HEAD_CLASSES, lex.members)


def train(docs: DataFrame, lex: Lexicon, shared, rounds: int = ROUNDS) -> Weights:
    """Weights after `rounds` gradient steps, each over every training document; the first starts from zero."""
    spark = docs.sparkSession
    seen_c, seen_m = _dense(_added(_gather(docs, shared, None)), lex)
    classes, members = np.zeros_like(seen_c), np.zeros_like(seen_m)
    class_p, member_q = lex.class_p.astype(np.float32), lex.member_q.astype(np.float32)
    prior_c, prior_m, rate = np.float32(PRIOR) * class_p, np.float32(PRIOR) * member_q, np.float32(RATE)
    for step in range(rounds):
        if step == 0:  # zero weights expect the shares
            want_c, want_m = seen_c.sum(axis=2, keepdims=True) * class_p, seen_m.sum(axis=3, keepdims=True) * member_q
        else:
            want_c, want_m = _dense(_added(_gather(docs, shared, spark.sparkContext.broadcast(Weights(classes, members)))), lex)
        classes += rate * np.log((seen_c + prior_c) / (want_c + prior_c))
        members += rate * np.log((seen_m + prior_m) / (want_m + prior_m))
    return Weights(classes, members)


@common.tidied
def score(docs: DataFrame, table: int = TABLE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Null and empty texts are one end token. Repeated rows are trained on and scored as they are; null ids
    count as empty text in the split; with no training documents every token is unknown; other columns are
    left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.filter(~held_out(F.col("doc_id")))
    counts = common.written(word_counts(training), "counts")
    lex = lexicon(counts, table)
    shared = spark.sparkContext.broadcast(lex)
    fitted = spark.sparkContext.broadcast(train(training, lex, shared, rounds))
    slot = np.log10(lex.n + lex.v + 1.0)

    def run(batches):
        lexicon_, weights = shared.value, fitted.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_DOCS):
                w = tokens(batch.column(2).slice(lo, BATCH_DOCS))
                features = contexts(w, lexicon_.buckets)
                at, known, cls, member = _labels(lexicon_, w)
                here = known[w.index]
                p = np.zeros(len(w.index))
                for a in range(0, len(w.index), SLICE):
                    part = slice(a, a + SLICE)
                    n = len(w.index[part])
                    p[part] = np.log10(_class_p(lexicon_, weights, features[:, part])[np.arange(n), cls[part]].astype(np.float64))
                share = np.where(known, lexicon_.share[at], 0.0)[w.index]
                some = np.flatnonzero(member >= 0)
                for a in range(0, len(some), SLICE):
                    part = some[a : a + SLICE]
                    own = cls[part].astype(np.int64)
                    q = _member_p(lexicon_, weights, _member_rows(features[:, part], own), own)
                    share[part] = np.log10(np.maximum(q[np.arange(len(part)), member[part] % lexicon_.members], 1e-30).astype(np.float64))
                base = np.where(known, np.log10(lexicon_.count[at] + 1.0), 0.0)[w.index]
                total = lambda x, s=w.starts: np.add.reduceat(x, s)
                ends = np.append(w.starts[1:], len(w.index))
                rare = np.flatnonzero(~here)
                lists = np.concatenate([[0], np.searchsorted(rare, ends)])
                hashes = w.distinct[w.index[rare]].view(np.int64)
                m = len(w.starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(m)), batch.column(0).slice(lo, m), batch.column(1).slice(lo, m), pa.array(ends - w.starts),
                        pa.array(total(here.astype(np.int64))), pa.array(total(base)), pa.array(total(p + share)),
                        pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(hashes)),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_here", "base", "score", "rare"],
                )
                row += m

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_here long, base double, score double, rare array<long>"
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)
    rows = common.written(rows, "scored")
    words = rows.select("row", F.explode("rare").alias("h"))
    met = words.join(counts.withColumnRenamed("h", "w"), words.h == F.col("w"))  # words never seen add log10(1)
    found = met.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("gain"), F.count(F.lit(1)).alias("more")).withColumnRenamed("row", "r")
    out = rows.join(found, rows.row == found.r, "left")
    gain, n_rare = F.coalesce("gain", F.lit(0.0)), F.size("rare")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_here") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(lex.n).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * float(slot)).alias("base_score"), (F.col("score") + gain - n_rare * float(np.log10(lex.rare_mass))).alias("score"),
    )


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))


QUERIES = {"op10_maxent_lm": op10_maxent_lm}
ORACLES: dict = {}
