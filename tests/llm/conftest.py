import random

import pytest

EXTRA = "row_key string, deleted string, copies string, bucket string, size string, h string, n string, rank string, component string"
N_EXTRA = EXTRA.count(",") + 1


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): clean text, copies, shared passages, junk, blanks, nulls and a long one."""
    rng = random.Random(5)
    words = "the of and to in is that it for was on are with as by river stone cloud morning paper window quiet garden mountain letter".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passage = [sentence(30), sentence(25), sentence(9)]
    rows = []
    for i in range(60):
        lines = [sentence(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
        if i % 7 == 0:
            lines[1:1] = passage
        if i % 5 == 0:
            lines.insert(0, "A common line.")
        rows.append((i, "\n".join(lines), "en", f"src{i % 3}" if i % 4 else "hot"))
    rows += [(100 + i, rows[3][1], "en", "hot") for i in range(8)]
    rows += [(120, rows[4][1].replace("river", "rivers", 1), "en", "src1"), (121, rows[5][1] + "\nOne more line here.", "en", "src2")]
    rows += [(130, " | ".join(sentence(1) for _ in range(120)), "en", "src1"), (131, "$$$ %%% " * 60, None, "src1")]
    rows += [(140, "", "en", None), (141, None, None, None), (142, " \n\t\n ", "en", "src0"), (143, "word", "xx", "src2")]
    rows += [(150, sentence(6000), "en", "src1"), (151, "\n".join(["Same line again and again."] * 40), "en", "src0")]
    rows += [(None, "A text without an id, and some more words.", "en", "src0"), (7, rows[7][1], "en", "src1")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(*r, len(r[1] or ""), *["x"] * N_EXTRA) for r in corpus]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
