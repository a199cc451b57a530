"""URL filters: host and path rules first, then pattern rules found through their rarest literal token.

A pattern rule is a regular expression over the lower-cased url. Every url that matches it holds all of its
literal tokens, so it is filed under the one that is rarest among the urls themselves; a url's own tokens
fetch the few rules filed under them, and only those run. Rules without such a token are tried on every url.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (verdict, host, path) rules of the contract, longest first wins.
HOST_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Default pattern rules; each blocks. A rule list is a bounded parameter, not data.
PATTERN_RULES = (
    r"\bcheap-pills\b",
    r"\bspam-farm\b",
    r"\bcasino-win\b",
    r"\badult-x\b",
    r"\bfree-bets\b",
    r"\bads-track\b",
    r"\bonline-pharmacy\b",
    r"\bpayday-loans?\b",
    r"^[a-z]+://([^/?#]*\.)?doubleclick\.",
    r"^[a-z]+://ad[sv]?[0-9]*\.",
)
MAX_RULES = 1_000_000
TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def read_rules(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Pattern rules of a text file, one a line; blank lines and those that begin with # are left out.

    More than MAX_RULES are an error: the rules are broadcast.
    """
    lines = [r[0].strip() for r in spark.read.text(path).limit(MAX_RULES + 1).collect()]
    if len(lines) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: they are broadcast to every task")
    return tuple(x for x in lines if x and not x.startswith("#"))


def literal_tokens(pattern: str) -> list[str]:
    """Tokens of a lower-cased url that every match holds whole: literal runs between boundaries or separators."""
    found, run, open_left = [], "", False

    def close(open_right: bool) -> None:
        nonlocal run
        if run and open_left and open_right:
            found.append(run)
        run = ""

    parsed = parser.parse(pattern, re.ASCII)
    folded = bool(parsed.state.flags & re.IGNORECASE)
    for kind, value in parsed:
        char = chr(value).translate(_UPPER) if kind is op.LITERAL and folded else chr(value) if kind is op.LITERAL else ""
        if TOKEN.fullmatch(char):
            run += char
        elif kind is op.LITERAL and not char.isalnum() or kind is op.AT and value in (op.AT_BOUNDARY, op.AT_END, op.AT_END_STRING, op.AT_BEGINNING, op.AT_BEGINNING_STRING):
            close(True)
            open_left = True
        else:  # among them a letter that lower-cased urls can't hold, so that the rule is tried on all and never matches
            close(False)
            open_left = False
    close(False)
    return found


def token_counts(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many urls hold each of the rules' tokens; as many counts as tokens at most reach the driver."""

    def count(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for t in wanted.intersection(TOKEN.findall((url or "").translate(_UPPER))):
                    counts[t] = counts.get(t, 0) + 1
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = urls.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return dict(map(tuple, rows.collect()))


def indexed(patterns, counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token, and those that have none."""
    index, always = {}, []
    for i, p in enumerate(patterns):
        tokens = literal_tokens(p)
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def split_url(url: str | None) -> tuple[str, str]:
    """Host, lower-cased in A-Z, and path; both empty without "://"."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_UPPER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def judge(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERN_RULES, id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every url.

    The longest host rule that fits decides; without one, the first pattern that matches blocks, and
    anything else is allowed. Null urls and urls without "://" have an empty host and path, and only a
    pattern can block them. Repeated rows are judged alike; other columns are left out.
    """
    if len(host_rules) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: they are broadcast to every task")
    urls = pages.select(F.col("url").cast("string").alias("url"))
    wanted = {t for p in patterns for t in literal_tokens(p)}
    index, always = indexed(patterns, token_counts(urls, wanted) if wanted else {})
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in host_rules:
        by_host.setdefault(host, []).append((path, host + path, verdict))
    shared = pages.sparkSession.sparkContext.broadcast((by_host, index, always, tuple(patterns)))

    def run(batches):
        hosts, filed, anyway, sources = shared.value
        rules = [re.compile(p, re.ASCII) for p in sources]
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                best, at = None, 0
                while host:
                    for start, rule, verdict in hosts.get(host[at:], ()):
                        if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                            best = rule, verdict
                    dot = host.find(".", at)
                    if dot < 0:
                        break
                    at = dot + 1
                if best:
                    out.append((host, path, *best, None))
                    continue
                low = (url or "").translate(_UPPER)
                tried = set(anyway)
                for t in set(TOKEN.findall(low)):
                    tried.update(filed.get(t, ()))
                hit = next((sources[i] for i in sorted(tried) if rules[i].search(low)), None)
                out.append((host, path, None, "block" if hit else "allow", hit))
            cols = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string")


def op9_url_pattern_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in HOST_RULES)
    matches = " OR ".join(f"regexp_matches(low, '{p}')" for p in PATTERN_RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH u AS (SELECT page_id, {lower.format("coalesce(url, '')")} AS low,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, low, {lower.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE {fits} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN {matches} THEN 'block' ELSE 'allow' END AS verdict FROM r"""


QUERIES = {"op9_url_pattern_rules": op9_url_pattern_rules}
ORACLES = {"op9_url_pattern_rules": _oracle()}
