"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histograms of character classes and of common words are held against those of its language, by
Jensen-Shannon distance. Both come from the documents themselves: a language's common words are those in most
of its documents, and its shares are those of the documents that pass the base rules. Short texts, whose
histograms say little, have more room, and very short ones are spared. Words and letter case differ by
language: a document without a language is held against the words of the nearest one, one of a language too
rare for histograms against none, and both against the corpus's digits and symbols.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm import common

CLASSES = ("lower", "upper", "digit", "symbol", "other")
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Common words of a language, and the least share of its documents, in percent, that hold one.
COMMON, LEAST_PERCENT = 25, 1
#: Guards: texts with fewer words are spared the test of each histogram; a language with fewer words in
#: passing documents has no reference of its own.
GUARD_CLASS, GUARD_WORD, GUARD_LANGUAGE = 20, 20, 10_000
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a kept document of very many words; a text of n words
#: has 1 + 2 / sqrt(n) times as much room.
MAX_CLASS, MAX_WORD = 0.235, 0.29
#: Words without a letter or digit are marks, as menus and tables have between their entries: one bin of the words'.
_LETTERED = r"[\p{L}\p{N}][^\x20\x09-\x0D]*+"
_BLANKS = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, common.BLANK))


def common_words(docs: DataFrame) -> DataFrame:
    """(lang_, tops): each language's COMMON words in most of its documents, as they are spelt, in code point order.

    A word counts once a document. Only words in LEAST_PERCENT of a language's documents are ranked: as many as
    a hundred documents have words, so a window holds a bounded number of rows whatever the vocabulary.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang_"), F.col("text").cast("string").alias("t_")).filter(F.col("lang_").isNotNull() & F.col("t_").isNotNull())
    n = rows.groupBy(F.col("lang_").alias("l_")).agg(F.count(F.lit(1)).alias("n_docs"))
    held = rows.select("lang_", F.explode(F.array_distinct(_words(F.col("t_")))).alias("word")).groupBy("lang_", "word").agg(F.count(F.lit(1)).alias("n"))
    often = held.filter("n > 1").join(n, F.col("lang_") == F.col("l_")).filter(100 * F.col("n") >= LEAST_PERCENT * F.col("n_docs"))
    # Written, as Spark would otherwise count the words by language alone, a language's whole vocabulary in one task.
    often = common.written(often.filter(F.col("word").rlike(r"[\p{L}\p{N}]")), "often")
    rank = F.row_number().over(Window.partitionBy("lang_").orderBy(F.desc("n"), "word"))
    top = often.withColumn("rank", rank).filter(F.col("rank") <= COMMON)
    return top.groupBy("lang_").agg(F.array_sort(F.collect_list("word")).alias("tops"))


def _removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def features(docs: DataFrame, carry: list[str], tops: DataFrame) -> DataFrame:
    """docs' carried columns, lang_, the base counts, the class counts and the common words' counts.

    The common words are those of the document's language, or of all languages together where it has none of
    its own. Null text counts as empty. What comes out is narrow but for what is carried.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(*carry, F.col("lang").cast("string").alias("lang_"), text.alias("t_"))
    every = tops.agg(F.array_distinct(F.flatten(F.collect_list("tops"))).alias("every_"))  # one row, COMMON words a language
    d = d.join(_sized(tops.withColumnRenamed("lang_", "l_")), F.col("lang_") == F.col("l_"), "left").join(F.broadcast(every), F.lit(True), "left")
    d = d.withColumn("tops", F.coalesce("tops", "every_")).drop("l_", "every_")
    words = [w for r in every.collect() for w in r[0] or []] if tops.count() <= MAX_LITERAL_LANGUAGES else []
    some = F.filter("w_", lambda w: w.isin(*words)) if words else F.col("w_")
    d = d.withColumns({"w_": _words(F.col("t_")), "nl_": _removed(F.col("t_"), r"\p{Ll}+")})
    d = d.withColumns({"nw_": _removed(F.col("nl_"), common.BLANK), "n_words": F.size("w_").cast("long")})
    gram = lambda w, i: F.xxhash64(w, F.get("w_", i + 1), F.get("w_", i + 2))
    grams = F.transform(F.slice("w_", 1, F.greatest(F.size("w_") - 2, F.lit(0))), gram)
    lines = F.filter(F.split("t_", "\n"), lambda x: x.rlike(common.WORD))
    d = d.withColumns({"g_": grams, "l_": lines})
    d = d.withColumn("again_", F.size("g_") > F.size(F.array_distinct("g_")))
    none = F.array().cast("array<struct<g:bigint,p:int>>")
    d = d.withColumn("s_", F.when(F.col("again_"), F.sort_array(F.transform("g_", lambda g, i: F.struct(g.alias("g"), i.alias("p"))))).otherwise(none))
    same = lambda x, i: F.coalesce(x["g"] == F.get("s_", i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get("s_", i + 1)["g"], F.lit(False))
    d = d.withColumn("p_", F.sort_array(F.transform(F.filter("s_", same), lambda x: x["p"])))
    step = lambda p, i: F.least(F.lit(3), F.coalesce(F.get("p_", i + 1), p + 3) - p)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    length, size = F.length, lambda c: F.length(c).cast("long")
    upper, digit, symbol = r"\p{Lu}+", r"\p{Nd}+", r"[#*$%&|<>]+"
    fell = lambda p: (length("nw_") - length(_removed(F.col("nw_"), p))).cast("long")
    counts = {"lower": size("t_") - size("nl_"), "upper": fell(upper), "digit": fell(digit), "symbol": fell(symbol)}
    d = d.withColumns({"n_" + k: v for k, v in counts.items()} | {
        "word_chars": size("t_") - size("nl_") + size("nw_"),
        "n_symbols": counts["symbol"],
        "n_marks": F.col("n_words") - F.regexp_count("t_", F.lit(_LETTERED)),
        "n_dup_lines": (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long"),
        "n_repeat_words": total(F.transform("p_", step)),
        "c_": F.sort_array(F.filter(some, lambda w: F.array_contains("tops", w))),
    })
    d = d.withColumn("e_", F.filter(F.transform("c_", lambda w, i: F.when((i == 0) | (w != F.get("c_", i - 1)), i)), lambda i: i.isNotNull()))
    entry = lambda i, k: F.struct(F.get("c_", i).alias("word"), (F.coalesce(F.get("e_", k + 1), F.size("c_")) - i).cast("long").alias("n"))
    out = d.withColumn("common", F.transform("e_", entry))
    classes = F.array(*(F.col("n_" + c) for c in CLASSES[:-1]), F.col("word_chars") - F.col("n_lower") - F.col("n_upper") - F.col("n_digit") - F.col("n_symbol"))
    return out.select(*carry, "lang_", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", classes.alias("classes"), "common", "n_marks")


#: Languages whose reference rows, of COMMON words each, are broadcast; more are joined by a shuffle. Words of
#: fewer are looked up in one set before the document's own language is.
MAX_BROADCAST_LANGUAGES, MAX_LITERAL_LANGUAGES = 1_000, 200


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_LANGUAGES else table


def base_failed(min_words: int = MIN_WORDS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def references(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(language, shares of classes and of common words) of languages with enough words, and the whole corpus's class shares.

    Only documents that pass the base rules count.
    """
    each = found.select("lang_", "n_words", "n_marks", "classes", "common", base_failed().alias("f_")).filter("not f_ and n_words > 0").drop("f_")
    classes = [F.sum(F.get("classes", F.lit(i))).alias(f"k{i}") for i in range(len(CLASSES))]
    totals = common.written(each.groupBy("lang_").agg(F.sum("n_words").alias("words"), F.sum("n_marks").alias("marks"), *classes), "classes")
    words = each.filter("lang_ is not null").select("lang_", F.explode("common").alias("c")).groupBy("lang_", F.col("c.word").alias("word")).agg(F.sum("c.n").alias("n"))
    counts = words.groupBy(F.col("lang_").alias("l_")).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
    chars = sum(F.col(f"k{i}") for i in range(len(CLASSES)))
    shares = F.array(*(F.col(f"k{i}") / F.when(chars > 0, chars) for i in range(len(CLASSES))))
    words_of = F.transform_values(F.coalesce("counts", F.create_map().cast("map<string,bigint>")), lambda _, n: n / F.col("words"))
    known = totals.filter((F.col("words") >= GUARD_LANGUAGE) & F.col("lang_").isNotNull()).join(counts, F.col("lang_") == F.col("l_"), "left")
    pooled = totals.agg(*(F.sum(f"k{i}").alias(f"k{i}") for i in range(len(CLASSES))))
    return known.select(F.col("lang_").alias("ref_lang"), shares.alias("ref_classes"), F.struct(words_of.alias("words"), (F.col("marks") / F.col("words")).alias("marks")).alias("ref_words")), pooled.select(shares.alias("all_classes"))


def _part(p: Column, q: Column) -> Column:
    """p's and q's terms of twice their Jensen-Shannon divergence in bits."""
    half = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / half)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / half)).otherwise(0.0)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def class_distance(of: Callable[[str], Column] = F.col) -> Column:
    """Over the classes, or what `of` makes of a document's counts and of the reference's shares."""
    terms = F.zip_with(of("classes"), of("ref_classes"), lambda n, q: _part(n / F.col("word_chars"), q))
    return F.when(F.col("word_chars") > 0, F.sqrt(F.greatest(_sum(terms) / 2, F.lit(0.0)))).otherwise(0.0)


def _any_language(classes: Column) -> Column:
    """Digits, symbols, and all the rest as one: scripts without case have their letters in `other`."""
    at = {c: F.get(classes, F.lit(i)) for i, c in enumerate(CLASSES)}
    return F.array(at["lower"] + at["upper"] + at["other"], at["digit"], at["symbol"])


def word_distance(ref: Column | None = None) -> Column:
    """Over the common words, marks, and all others as one; words of the reference that the text lacks count q each."""
    ref = F.col("ref_words") if ref is None else ref
    share = lambda e: F.coalesce(F.try_element_at(ref["words"], e["word"]), F.lit(0.0))
    met = F.aggregate("common", F.lit(0.0), lambda x, e: x + share(e))
    terms = F.aggregate("common", F.lit(0.0), lambda x, e: x + _part(e["n"] / F.col("n_words"), share(e)))
    own = F.aggregate("common", F.lit(0).cast("long"), lambda x, e: x + e["n"]) / F.col("n_words")
    of = F.aggregate(F.map_values(ref["words"]), F.lit(0.0), lambda x, y: x + y)
    marks = F.col("n_marks") / F.col("n_words")
    total = terms + (of - met) + _part(marks, ref["marks"]) + _part(1 - own - marks, 1 - of - ref["marks"])
    return F.when(F.col("n_words") > 0, F.sqrt(F.greatest(total / 2, F.lit(0.0)))).otherwise(0.0)


def judge(docs: DataFrame, carry: list[str], min_words: int = MIN_WORDS) -> DataFrame:
    """docs' carried columns with the base counts, class_distance, word_distance, base_failed and kept.

    Null and empty texts have no words and fail the base rule; repeated rows are judged alike; an empty table
    gives no rows. For null languages and rare ones class_distance is over digits, symbols and the rest, to the
    whole corpus, and word_distance is to the nearest language (null: no test) for null ones and null for rare ones.
    """
    tops = common.written(common_words(docs), "tops")
    found = common.written(features(docs, carry, tops), "features")
    own, pool = references(found)
    own, pool = common.written(own, "references"), common.written(pool, "pool")
    every = own.agg(F.collect_list("ref_words").alias("every_words"))  # one row, empty without languages
    rows = found.join(_sized(own), found.lang_ == own.ref_lang, "left").join(F.broadcast(pool), F.lit(True), "left").join(F.broadcast(every), F.lit(True), "left")  # one row each
    known = F.col("ref_lang").isNotNull()
    ref = lambda c: F.col(c) if c == "classes" else F.col("all_classes")
    nearest = F.when(F.col("lang_").isNull(), F.array_min(F.transform("every_words", word_distance)))
    rows = rows.withColumns({
        "class_distance": F.when(known, class_distance()).otherwise(class_distance(lambda c: _any_language(ref(c)))),
        "word_distance": F.when(known, word_distance()).otherwise(nearest),
        "base_failed": base_failed(min_words),
    })
    room = 1 + 2 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    fits = lambda c, guard, most: (F.col("n_words") < guard) | F.coalesce(F.col(c) <= most * room, F.lit(True))
    kept = ~F.col("base_failed") & fits("class_distance", GUARD_CLASS, MAX_CLASS) & fits("word_distance", GUARD_WORD, MAX_WORD)
    return rows.withColumn("kept", kept).drop("lang_", "ref_lang", "ref_classes", "ref_words", "all_classes", "every_words", "classes", "common", "n_marks")


@common.tidied
def keep(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that pass, in their own columns; fewer words than `min_words` fail."""
    alias = {c: f"doc_{i}_" for i, c in enumerate(docs.columns)}
    renamed = docs.select("*", *(F.col(f"`{c}`").alias(a) for c, a in alias.items()))
    return judge(renamed, list(alias.values()), min_words).filter("kept").select(*(F.col(a).alias(c) for c, a in alias.items()))


@common.tidied
def op4_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs, ["doc_id"]).select(*columns)


def _oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    fell = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    part = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)"
    kinds = range(len(CLASSES))
    rest = lambda c: f"({c}0 + {c}1 + {c}4)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text IS NULL AS no_text, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{word}') AS ws FROM d),
df AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(ws)) AS word FROM w WHERE lang IS NOT NULL) WHERE regexp_matches(word, '[\\p{{L}}\\p{{N}}]') GROUP BY ALL HAVING count(*) > 1),
top AS (SELECT lang, word FROM (SELECT df.lang, df.word, row_number() OVER (PARTITION BY df.lang ORDER BY n DESC, word) AS rank
    FROM df JOIN (SELECT lang, count(*) AS docs FROM d WHERE lang IS NOT NULL AND NOT no_text GROUP BY lang) s ON df.lang = s.lang WHERE 100 * n >= {LEAST_PERCENT} * docs) WHERE rank <= {COMMON}),
b AS (SELECT rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, len(list_filter(ws, lambda x: NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS marks, CAST({fell(common.BLANK)} AS BIGINT) AS blank, CAST(length(t) AS BIGINT) AS chars,
    CAST({fell("[#*$%&|<>]+")} AS BIGINT) AS n_symbols, CAST({fell(chr(92) + "p{Ll}+")} AS BIGINT) AS k0, CAST({fell(chr(92) + "p{Lu}+")} AS BIGINT) AS k1, CAST({fell(chr(92) + "p{Nd}+")} AS BIGINT) AS k2,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM w),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
e AS (SELECT b.rid, doc_id, lang, n_words, marks, chars - blank AS word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    k0, k1, k2, n_symbols AS k3, chars - blank - k0 - k1 - k2 - n_symbols AS k4 FROM b LEFT JOIN r ON b.rid = r.rid),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM e),
c AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(ws) AS word FROM w) WHERE word IN (SELECT word FROM top) GROUP BY ALL),
good AS (SELECT * FROM f WHERE NOT base_failed AND n_words > 0),
tot AS (SELECT lang, sum(n_words) AS words, sum(marks) AS marks, {", ".join(f"sum(k{i}) AS s{i}" for i in kinds)} FROM good GROUP BY lang),
ref AS (SELECT lang, words, marks / words AS mq, {", ".join(f"s{i} / (s0 + s1 + s2 + s3 + s4) AS q{i}" for i in kinds)} FROM tot WHERE words >= {GUARD_LANGUAGE} AND lang IS NOT NULL),
pool AS (SELECT {", ".join(f"sum(s{i}) / sum(s0 + s1 + s2 + s3 + s4) AS q{i}" for i in kinds)} FROM tot),
rw AS (SELECT ref.lang, c.word, sum(c.n) / any_value(ref.words) AS q FROM c JOIN good ON c.rid = good.rid JOIN ref ON good.lang = ref.lang JOIN top ON top.lang = ref.lang AND top.word = c.word GROUP BY ref.lang, c.word),
ro AS (SELECT ref.lang, any_value(ref.mq) AS mq, coalesce(sum(q), 0) AS q FROM ref LEFT JOIN rw ON ref.lang = rw.lang GROUP BY ref.lang),
m AS (SELECT f.rid, ref.lang, f.lang IS NULL AS other, f.n_words, f.marks FROM f JOIN ref ON f.lang = ref.lang OR f.lang IS NULL WHERE f.n_words > 0),
x AS (SELECT m.rid, m.lang, sum({part("(c.n / m.n_words)", "coalesce(rw.q, 0)")}) AS terms, sum(c.n) / any_value(m.n_words) AS own, sum(coalesce(rw.q, 0)) AS met
    FROM m JOIN c ON m.rid = c.rid LEFT JOIN rw ON rw.lang = m.lang AND rw.word = c.word
    WHERE m.other OR EXISTS (SELECT 1 FROM top WHERE top.lang = m.lang AND top.word = c.word) GROUP BY m.rid, m.lang),
wd AS (SELECT m.rid, min(sqrt(greatest((coalesce(x.terms, 0) + (ro.q - coalesce(x.met, 0)) + {part("(m.marks / m.n_words)", "ro.mq")} + {part("(1 - coalesce(x.own, 0) - m.marks / m.n_words)", "(1 - ro.q - ro.mq)")}) / 2, 0))) AS wd
    FROM m JOIN ro ON ro.lang = m.lang LEFT JOIN x ON x.rid = m.rid AND x.lang = m.lang GROUP BY m.rid),
cd AS (SELECT f.rid, sqrt(greatest(CASE WHEN ref.lang IS NOT NULL THEN {" + ".join(part(f"(k{i} / word_chars)", f"ref.q{i}") for i in kinds)}
    ELSE {" + ".join(part(f"({k} / word_chars)", q) for k, q in ((rest("k"), rest("pool.q")), ("k2", "pool.q2"), ("k3", "pool.q3")))} END / 2, 0)) AS cd
    FROM f CROSS JOIN pool LEFT JOIN ref ON f.lang = ref.lang WHERE word_chars > 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND (n_words < {GUARD_CLASS} OR coalesce(cd <= {MAX_CLASS} * (1 + 2 / sqrt(greatest(n_words, 1))), true))
    AND (n_words < {GUARD_WORD} OR coalesce(wd <= {MAX_WORD} * (1 + 2 / sqrt(greatest(n_words, 1))), true)) AS kept
FROM f LEFT JOIN wd ON f.rid = wd.rid LEFT JOIN cd ON f.rid = cd.rid"""


QUERIES = {"op4_distribution_divergence": op4_distribution_divergence}
ORACLES = {"op4_distribution_divergence": _oracle()}
