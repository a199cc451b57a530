import itertools
import random

import corpus_pipeline
import pytest

from terraloom.llm import near
from tests.llm.test_text_operators import brute_fingerprint


def brute_shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a and b) and 10 * len(a & b) >= 8 * len(a | b)


def near_corpus():
    """Texts, copies at similarities about 0.8, a chain whose ends are unlike, and a group that shares most of a text."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def changed(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = rng.choice(vocabulary)
        return words

    texts = []
    for _ in range(40):
        base = text(rng.randint(60, 400))
        texts += [base, changed(base, rng.randint(1, max(1, len(base) // 30)))]
    step = text(200)
    for _ in range(5):
        texts.append(step)
        step = changed(step, 3)
    base = text(300)  # alike, mostly under the similarity, with some copies among them
    family = [changed(base, rng.randint(8, 20)) for _ in range(60)]
    texts += family + [changed(t, 2) for t in family[:10]]
    hot = text(150)
    texts += [changed(hot, rng.randint(0, 4)) for _ in range(40)]
    texts += [["Short", "text"], ["short", "TEXT"], ["short", "texts"]]
    return [" ".join(x) for x in texts]


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 8, "COPIES": 3, "BUNDLE": 20, "CHAIN": 5}])
def test_near_copies_equal_brute_force(spark, monkeypatch, limits):
    """With the limits as they are, and so small that bands are compared in blocks and chains are cut."""
    for name, value in limits.items():
        monkeypatch.setattr(near, name, value)
    texts = [*near_corpus(), "", None]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets, prints = [brute_shingles(t or "") for t in texts], [brute_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if similar(sets[a], sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    out = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({find(i) for i in range(len(texts))})
    assert corpus_pipeline.simhash_dedup(spark, docs.limit(0), "").count() == 0
