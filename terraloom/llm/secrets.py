"""Secret scans with structural confirmation.

The base kinds are patterns alone. The method's own kinds report a candidate only once it is decoded and
its structure holds: key encodings whose nested lengths account for every byte, and signed tokens whose
header is a JSON object that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import common

# The base patterns and least lengths of the contract, in listed order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: Text that may hold a span of each kind; run over whole columns, so that most texts never reach Python.
_MAY = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "signed": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.",
    "key": r"M[A-Za-z0-9+/_-]{39}|b3BlbnNzaC1rZXkt|(?:30|6[fF]70656[eE]7373682[dD])[0-9a-fA-F]{38}",
}
HEX = re.compile(r"[0-9a-f]{32,}")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: A run of base64 whose lines may be broken as key files break them, or by the written-out breaks of strings; a
#: key may begin on any of its lines, with 40 characters at least, and after a '=', as in NAME=MII...
_CODED = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))(?:M[A-Za-z0-9+/_-]{39}|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]*+(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/_-]++)*+={0,2}")
_BREAK = re.compile(r"\r?\n|(?:\\r)?\\n")
_KEY_START = re.compile(r"M[A-Za-z0-9+/_-]{39}|b3BlbnNzaC1rZXkt")
_HEX_CODED = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[fF]70656[eE]7373682[dD])[0-9A-Fa-f]{38,}(?![0-9A-Fa-f])")
_OPENSSH = b"openssh-key-v1\0"
#: Elements of a sequence that any private key has, and some.
MOST_ELEMENTS = 16


class Coded:
    """Bytes of a base64 run from one of its characters on; only what is read is decoded."""

    def __init__(self, body: str, first: int, size: int | None = None):
        self.body, self.first = body, first
        self.size = (len(body) - first) * 3 // 4 if size is None else size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice):
        if isinstance(at, int):
            return self[at : at + 1][0]
        a, b = max(0, at.start or 0), min(self.size, self.size if at.stop is None else at.stop)
        if a >= b:
            return b""
        piece = self.body[self.first + a // 3 * 4 : self.first - (-b // 3) * 4]
        return base64.b64decode(piece + "=" * (-len(piece) % 4))[a % 3 : a % 3 + b - a]


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the element at `at`, if its length is well formed and inside."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
    return (tag, at, at + size) if at + size <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[at:end] exactly, or None; no key has more than MOST_ELEMENTS."""
    out = []
    while at < end:
        x = _tlv(data, at, end)
        if x is None or len(out) == MOST_ELEMENTS:
            return None
        out.append(x)
        at = x[2]
    return out


def _number(data: bytes, x: tuple[int, int, int]) -> int | None:
    return int.from_bytes(data[x[1] : x[2]], "big") if x[0] == 2 and x[2] - x[1] == 1 else None


def der_key(data: bytes) -> bool:
    """A private key in distinguished encoding: a sequence that fills the bytes, with the fields of a key."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _elements(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags, version = [x[0] for x in parts], _number(data, parts[0])
    if version in (0, 1) and len(parts) >= 9 and tags[:9] == [2] * 9:  # RSA: modulus, exponents, primes, coefficient
        return parts[1][2] - parts[1][1] >= 32
    if version == 0 and len(parts) == 6 and tags == [2] * 6:  # DSA
        return parts[1][2] - parts[1][1] >= 32
    if version in (0, 1) and len(parts) >= 3 and tags[1:3] == [0x30, 4]:  # wrapped key with its algorithm
        inner = _elements(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 6 and parts[2][2] - parts[2][1] >= 16
    if version == 1 and tags[1] == 4 and parts[1][2] - parts[1][1] >= 16:  # elliptic curve
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    return False


def openssh_end(data: bytes) -> int | None:
    """Where an OpenSSH private key ends: magic, three counted strings, a count of keys, and a string each and one more."""
    if data[: len(_OPENSSH)] != _OPENSSH:
        return None
    at = len(_OPENSSH)

    def skip(at: int, n: int) -> int | None:
        for _ in range(n):
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at if at <= len(data) else None

    at = skip(at, 3)
    if at is None or not 1 <= (n := int.from_bytes(data[at : at + 4], "big")) <= 16:
        return None
    return skip(at + 4, n + 1)


def openssh_key(data: bytes) -> bool:
    return openssh_end(data) == len(data)


def coded_keys(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the keys in a base64 run: whole lines from a key's first to the one its lengths end on.

    Ordinary words may follow on the next lines. Only the lengths and heads are decoded, so a run costs its size.
    """
    edges = [start, *(x for m in _BREAK.finditer(text, start, end) for x in m.span()), end]
    body, lines, ends = [], [], {}
    size = 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        lines.append((a, size))
        piece = text[a:b].rstrip("=")
        body.append(piece)
        size += len(piece)
        ends[size] = b
    whole, found, upto = "".join(body).replace("-", "+").replace("_", "/"), [], 0
    for a, first in lines:
        if first < upto or not _KEY_START.match(text, a, end):
            continue
        data = Coded(whole, first)
        top = _tlv(data, 0, len(data))
        der = top is not None and top[0] == 0x30
        total = top[2] if der else openssh_end(data)
        last = total and first - (-total * 4 // 3)
        if last in ends and (not der or der_key(Coded(whole, first, total))):
            found.append((a, ends[last]))
            upto = last
    return found


def _decoded(text: str) -> bytes | None:
    text = re.sub(r"[\r\n=]", "", text).replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def signed_token(header: str, payload: str) -> bool:
    """A signed token's first part: base64 of a JSON object with an algorithm; the payload decodes too."""
    raw = _decoded(header)
    try:
        found = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str) and _decoded(payload) is not None


def scan(text: str, may: set[str] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in one text, by start, then kind as listed."""
    may, out = set(_MAY) if may is None else may, []
    if "assign" in may:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "access" in may:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if "hex" in may:  # the runs of this length are those of the base pattern that pass
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "signed" in may:
        out += [(m.start(), m.end(), "signed") for m in _SIGNED.finditer(text) if signed_token(m[1], m[2])]
    if "key" in may:
        out += [(a, b, "key") for m in _CODED.finditer(text) for a, b in coded_keys(text, m.start(), m.end())]
        for m in _HEX_CODED.finditer(text):
            if len(m[0]) % 2 == 0 and (der_key(data := bytes.fromhex(m[0])) or openssh_key(data)):
                out.append((m.start(), m.end(), "key"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


#: Kinds as listed: the base ones, then the method's.
KINDS = ("assign", "access", "hex", "signed", "key")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every document; spans: array of (kind, start, end) in code points, end exclusive.

    Null and empty texts have none. Texts are scanned whole, one batch in memory at a time; repeated rows
    and null doc_ids are rows like any other; other columns are left out.
    """

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            masks = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in _MAY.items()}
            spans = [[] for _ in range(batch.num_rows)]
            for i in sorted({int(j) for m in masks.values() for j in m.nonzero()[0]}):
                found = scan(texts[i].as_py(), {k for k, m in masks.items() if m[i]})
                spans[i] = [{"kind": k, "start": a, "end": b} for a, b, k in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES: dict = {}
