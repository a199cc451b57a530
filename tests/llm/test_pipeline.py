import collections
import itertools
import pathlib
import re

import corpus_pipeline
from pyspark.sql import functions as F

from terraloom.llm import common, mixing, packing, quality
from tests.llm.test_near import brute_shingles, similar
from tests.llm.test_text_operators import WORD, brute_fingerprint, brute_lines, check_packing


def staged(spark, docs, n):
    """What the first n stages keep, each read from Parquet."""
    for name, stage in corpus_pipeline.STAGES[:n]:
        docs = common.written(stage(spark, docs, ""), name)
    return docs


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]


def test_each_stage_equals_brute_force_on_what_the_one_before_kept(spark, docs):
    before = docs
    after = staged(spark, before, 1)
    assert after.columns == docs.columns
    kept = {tuple(r) for r in quality.judge(before, ["doc_id", "text"], corpus_pipeline.MIN_WORDS).filter("kept").select("doc_id", "text").collect()}
    rows = plain(before)
    assert collections.Counter(plain(after)) == collections.Counter(r for r in rows if r[:2] in kept)

    before, rows = after, plain(after)
    after = common.written(corpus_pipeline.line_dedup(spark, before, ""), "t")
    gone, want = brute_lines(rows, 50), collections.Counter()
    for i, r in enumerate(rows):
        text = "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in gone[i])
        if not gone[i] or WORD.search(text):
            want[(r[0], text, *r[2:])] += 1
    assert after.columns == docs.columns and collections.Counter(plain(after)) == want
    assert after.filter(F.col("n_chars") != F.length("text")).count() == 0

    before, rows = after, plain(after)
    after = common.written(corpus_pipeline.simhash_dedup(spark, before, ""), "t")
    sets, prints = [brute_shingles(r[1]) for r in rows], [brute_fingerprint(r[1]) for r in rows]
    groups = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if similar(sets[a], sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2:
            groups = [groups[a] if g == groups[b] else g for g in groups]
    of = collections.defaultdict(set)
    for r, g in zip(rows, groups, strict=True):
        of[g].add(r)
    got = plain(after)
    assert after.columns == docs.columns and len(got) == len(of) and all(len(s & set(got)) == 1 for s in of.values())

    before, rows = after, plain(after)
    after = common.written(corpus_pipeline.source_mixing(spark, before, ""), "t")
    copies = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mixing.decide(before)[1].collect()}
    want = collections.Counter()
    for r in rows:
        want[r] += copies[(r[0], r[3], len(WORD.findall(r[1])))]
    assert after.columns == docs.columns and collections.Counter(plain(after)) == +want

    rows = plain(after)
    packed = corpus_pipeline.sequence_packing(spark, after, "")
    check_packing([tuple(r) for r in packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()], rows)


def test_run_over_a_folder(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    with common.collected() as tables:
        out = corpus_pipeline.run(spark, str(tmp_path))
        other = corpus_pipeline.run(spark, str(tmp_path))  # two runs side by side
    assert out.count() > 0 and out.filter("length > 4096").count() == 0
    order = lambda d: sorted(map(tuple, d.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert order(out) == order(other)
    left = [t for t in tables if pathlib.Path(t._terraloom_path.removeprefix("file://")).exists()]
    assert len(tables) > 20 and len(left) == 2  # the results alone
    for t in left:
        common.discard(t)


def test_a_stage_keeps_what_the_one_before_still_needs(spark, docs):
    """Stages called one after the other, before any result has been read."""
    first = corpus_pipeline.quality_rules(spark, docs, "")
    second = corpus_pipeline.line_dedup(spark, first, "")
    third = corpus_pipeline.simhash_dedup(spark, second, "")
    assert 0 < third.count() <= second.count() <= first.count() <= docs.count()


def test_run_over_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "source_mixing", "sequence_packing"]
    assert packing.CAPACITY == 4096 and re.fullmatch(WORD.pattern, "word")
