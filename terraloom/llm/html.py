"""Main-text extraction by a recurrent block labeller.

A page is cut into leaf blocks in page order. Each block is read as a hashed bag of its tag path (element
names, class and id words), a hashed bag of its own words and a few shape figures. A bidirectional LSTM in
numpy reads the whole sequence of a page and labels every block as main text or not. It is trained here, on
pages composed from templates whose labels are known, and sent to the tasks; pages are never cut.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH_DIMS, WORD_DIMS, SHAPE_DIMS, HIDDEN = 4096, 64, 6, 16
#: The training set's bound, passes over it, and its seed.
TRAIN_PAGES, EPOCHS, SEED = 800, 8, 42
#: Blocks scored at once: pages are batched by length up to this many, a longer page alone.
BATCH_BLOCKS = 16_384

# Elements that end a block, have no content, or hold text that isn't shown.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav object ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("script style title textarea template noscript svg math xmp noembed noframes".split())
_CLOSED_BY_SIBLING = {"p": BLOCKS - {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
_LISTS = frozenset("ul ol dl table select menu".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
#: The same for what follows a quote that is never closed: a tag ends at its first angle bracket.
_LOOSE_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>""", re.S)
_OPENS = re.compile("</?[A-Za-z]")
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {t: re.compile(rf"</{t}\b", re.I) for t in HIDDEN_TEXT}


@lru_cache(4096)
def _known_names(tag: str, attributes: str) -> tuple[str, ...]:
    return _read_names(tag, attributes)


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's name and its class words' tokens; those of short attributes are remembered."""
    return (_known_names if len(attributes) < 500 else _read_names)(tag, attributes)


def _read_names(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for m in _ATTR.finditer(attributes):
        out += ["." + w.lower() for w in _NAME.findall(m[2] or m[3] or m[4] or "")]
    return tuple(dict.fromkeys(out))


@lru_cache(4096)
def _bins(names: tuple[str, ...]) -> frozenset:
    return frozenset(crc32(n.encode()) % PATH_DIMS for n in names)


class Element:
    """An open element: its names and its parent's, and the bins of all names on its path, one set where it adds none."""

    __slots__ = ("tag", "names", "above", "bins", "_own")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None):
        own, bins = _bins(names), parent.bins if parent else frozenset({0})
        self.tag, self.names, self.above = tag, names, parent.names if parent else ()
        self.bins, self._own = bins if own <= bins else bins | own, None

    def path_bins(self) -> np.ndarray:
        """Bins of the path: every name of every element, and the innermost two elements' names apart."""
        if self._own is None:
            inner = {crc32(f"{depth}{n}".encode()) % PATH_DIMS for depth, names in enumerate((self.names, self.above)) for n in names}
            self._own = np.array(sorted(self.bins | inner), np.int32)
        return self._own


_NO_PATH = np.array([0], np.int32)


class _Open:
    """The stack of open elements, with where each tag and the blocks stand in it."""

    def __init__(self):
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def cut(self, at: int) -> None:
        """Close all elements from place `at` on."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag closes the innermost element of its name; an inline one doesn't close the block around it."""
        places = self.places.get(tag)
        if places and (tag in BLOCKS or not self.blocks or self.blocks[-1] < places[-1]):
            self.cut(places[-1])

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            i = len(self.blocks) - 1
            while i >= 0:
                above = self.stack[self.blocks[i]].tag
                if tag in _CLOSED_BY_SIBLING.get(above, ()):
                    self.cut(self.blocks[i])
                elif above in _LISTS or above not in _CLOSED_BY_SIBLING:
                    break
                i -= 1
            self.blocks.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, _names(tag, attributes), self.stack[-1] if self.stack else None))


def blocks(page: str) -> list[tuple[Element | None, str, float]]:
    """(innermost element, text, share of characters inside links) of every leaf block with text, in page order.

    One pass: after a quote that is never closed, tags end at their first angle bracket, and an element of
    hidden text that is never closed is looked for once.
    """
    out: list = []
    opened = _Open()
    text: list[str] = []
    linked, anchors = 0, 0

    def flush():
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((opened.stack[-1] if opened.stack else None, joined, min(1.0, linked / max(1, len(joined)))))
            text.clear()
        linked = 0

    def push(piece: str):
        nonlocal linked
        piece = entities.unescape(piece)
        text.append(piece)
        if anchors:
            linked += len(piece)

    at, size, tags, last, unclosed = 0, len(page), _TAG, page.rfind(">"), set()
    while at < size:
        m, start = None, at
        while m is None and (lt := page.find("<", start)) >= 0:
            if lt > last and (lt := page.find("<!--", lt)) < 0:
                break
            m = tags.match(page, lt)
            if m is None and tags is _TAG and _OPENS.match(page, lt):
                tags = _LOOSE_TAG
                m = tags.match(page, lt)
            start = lt + 1
        if m is None:
            push(page[at:])
            break
        if lt > at:
            push(page[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in HIDDEN_TEXT and not closing:
            end = None if tag in unclosed else _ENDS[tag].search(page, at)
            if end is None:
                unclosed.add(tag)
                if tag not in ("svg", "math", "template", "noscript"):
                    break
                continue
            gt = page.find(">", end.end())
            at = size if gt < 0 else gt + 1
            continue
        if tag == "br":
            push(" ")
            continue
        if tag in BLOCKS:
            flush()
            anchors = 0
        if closing:
            if tag == "a":
                anchors = max(0, anchors - 1)
            opened.close(tag)
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag == "a":
            anchors += 1
        opened.open(tag, m[3])
    flush()
    return out


@dataclass
class Page:
    """A page's blocks as the network reads them: bins of each path, and word bag and shape as dense rows."""

    bins: list
    dense: np.ndarray

    def __len__(self):
        return len(self.bins)


def vectors(found: list) -> Page:
    x = np.zeros((len(found), WORD_DIMS + SHAPE_DIMS), np.float32)
    for i, (_, text, linked) in enumerate(found):
        words = text.lower().split()
        bag = np.bincount([crc32(w.encode("utf-8", "replace")) % WORD_DIMS for w in words], minlength=WORD_DIMS)
        n = len(words)
        x[i, :WORD_DIMS] = bag / np.linalg.norm(bag)
        x[i, WORD_DIMS:] = (np.log1p(n) / 4, np.log1p(len(text)) / 6, linked, text[-1] in ".!?:;\"'…", i / max(1, len(found) - 1), n <= 3)
    return Page([path.path_bins() if path else _NO_PATH for path, _, _ in found], x)


class Batch:
    """Pages side by side, padded to the longest; only real blocks are held, with their places."""

    def __init__(self, pages: list[Page]):
        self.shape = len(pages), max(map(len, pages))
        self.bins = np.concatenate([b for p in pages for b in p.bins])
        self.counts = np.array([len(b) for p in pages for b in p.bins])
        self.starts = np.cumsum(self.counts) - self.counts
        self.dense = np.concatenate([p.dense for p in pages])
        self.at = np.concatenate([i * self.shape[1] + np.arange(len(p)) for i, p in enumerate(pages)])
        self.mask = np.zeros(self.shape, np.float32)
        self.mask.reshape(-1)[self.at] = 1

    def project(self, w: np.ndarray) -> np.ndarray:
        rows = self.dense @ w[PATH_DIMS:] + np.add.reduceat(w[self.bins], self.starts, axis=0)
        out = np.zeros((self.shape[0] * self.shape[1], w.shape[1]), rows.dtype)
        out[self.at] = rows
        return out.reshape(*self.shape, -1)

    def gradient(self, w: np.ndarray, dz: np.ndarray) -> np.ndarray:
        rows, g = dz.reshape(-1, w.shape[1])[self.at], np.zeros_like(w)
        g[PATH_DIMS:] = self.dense.T @ rows
        order = np.argsort(self.bins, kind="stable")
        bins = self.bins[order]
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        g[bins[first]] = np.add.reduceat(np.repeat(rows, self.counts, axis=0)[order], first, axis=0)
        return g


# --- the network -----------------------------------------------------------------------------------------


def _weights(seed: int) -> dict[str, np.ndarray]:
    rng, dims = np.random.default_rng(seed), PATH_DIMS + WORD_DIMS + SHAPE_DIMS
    w = {}
    for way in "fb":
        w["x" + way] = (rng.standard_normal((dims, 4 * HIDDEN)) * 0.1).astype(np.float32)
        w["h" + way] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        w["c" + way] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # forget gates open
    w["o"] = (rng.standard_normal((2 * HIDDEN, 1)) * 0.1).astype(np.float32)
    w["d"] = np.zeros(1, np.float32)
    return w


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(w: dict, x: Batch, way: str, taped: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states (pages, blocks, HIDDEN) one way, and the steps if taped; past a page's end the state stays at zero."""
    (b, t), mask = x.shape, x.mask
    pre = x.project(w["x" + way]) + w["c" + way]
    h, c, out, tape = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32), np.zeros((b, t, HIDDEN), np.float32), []
    for k in range(t) if way == "f" else range(t - 1, -1, -1):
        z = pre[:, k] + h @ w["h" + way]
        i, f, o = (_sigmoid(z[:, n * HIDDEN : (n + 1) * HIDDEN]) for n in (0, 1, 2))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[:, k, None]
        now = (f * c + i * g) * m
        if taped:
            tape.append((k, h, c, i, f, o, g, now))
        c = now
        h = o * np.tanh(c) * m
        out[:, k] = h
    return out, tape


def logits(w: dict, x: Batch) -> np.ndarray:
    both = np.concatenate([_run(w, x, way)[0] for way in "fb"], axis=2)
    return (both @ w["o"] + w["d"])[..., 0]


def _gradients(w: dict, x: Batch, y: np.ndarray) -> dict[str, np.ndarray]:
    runs, mask = {way: _run(w, x, way, taped=True) for way in "fb"}, x.mask
    both = np.concatenate([runs[way][0] for way in "fb"], axis=2)
    d = (_sigmoid((both @ w["o"] + w["d"])[..., 0]) - y) * mask / mask.sum()
    grads = {"o": np.einsum("bth,bt->h", both, d)[:, None], "d": d.sum(keepdims=True).reshape(1)}
    back = d[..., None] * w["o"][:, 0]
    pages = x.shape[0]
    for n, way in enumerate("fb"):
        dh_out = back[..., n * HIDDEN : (n + 1) * HIDDEN]
        dz_all, gh = np.zeros((*x.shape, 4 * HIDDEN), w["o"].dtype), np.zeros_like(w["h" + way])
        dh, dc = np.zeros((pages, HIDDEN), w["o"].dtype), np.zeros((pages, HIDDEN), w["o"].dtype)
        for k, h, c, i, f, o, g, now in reversed(runs[way][1]):
            m = mask[:, k, None]
            dh = (dh + dh_out[:, k]) * m
            tanh = np.tanh(now)
            dc = (dc + dh * o * (1 - tanh**2)) * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dz_all[:, k] = dz
            gh += h.T @ dz
            dh, dc = dz @ w["h" + way].T, dc * f
        grads["x" + way], grads["h" + way], grads["c" + way] = x.gradient(w["x" + way], dz_all), gh, dz_all.sum(axis=(0, 1))
    return grads


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights fitted on `pages` composed pages by Adam, deterministic in its arguments."""
    from terraloom.llm.html_pages import compose

    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, labels = compose(rng)
        found = blocks(page)
        y = np.array([labels.get(text, 0.0) for _, text, _ in found], np.float32)
        if found:
            data.append((vectors(found), y))
    data.sort(key=lambda d: len(d[0]))
    batches = []
    for lo in range(0, len(data), 25):
        x = Batch([d[0] for d in data[lo : lo + 25]])
        y = np.zeros(x.shape, np.float32)
        y.reshape(-1)[x.at] = np.concatenate([d[1] for d in data[lo : lo + 25]])
        batches.append((x, y))
    w = _weights(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        for n in rng.permutation(len(batches)):
            step += 1
            for k, g in _gradients(w, *batches[n]).items():
                g = np.clip(g, -1, 1).astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                rate = 0.02 * min(1.0, 20 / step**0.75)
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8) + 1e-5 * w[k]
    return w


@lru_cache(4)
def model(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    return train(pages, epochs, seed)


def label(w: dict, pages: list[list]) -> list[np.ndarray]:
    """Whether each block of each page is main text, page by page."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(pages[order[hi]]) <= BATCH_BLOCKS:
            hi += 1
        found = logits(w, Batch([vectors(pages[i]) for i in order[lo:hi]])) > 0
        for row, i in enumerate(order[lo:hi]):
            out[i] = found[row, : len(pages[i])]
        lo = hi
    return out


def extract(pages: DataFrame, weights: dict | None = None, id_col: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars): each page's main text, blocks joined by one line break.

    Null and empty html give an empty text, as do pages without main text; null ids and urls and repeated
    rows are kept; other columns are left out.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or model())

    def run(batches):
        for batch in batches:
            ids, urls, texts = batch.column(0), batch.column(1), []
            source = batch.column(2)
            for lo in range(0, batch.num_rows, 500):
                found = [blocks(source[i].as_py() or "") for i in range(lo, min(lo + 500, batch.num_rows))]
                texts += ["\n".join(b[1] for b, y in zip(f, is_main, strict=True) if y) for f, is_main in zip(found, label(shared.value, found), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_block_labeller": op5_block_labeller}
ORACLES: dict = {}
