import collections
import html as entities
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import embeddings, graph, html, lm, urls
from terraloom.llm.html_pages import compose

# --- graph -------------------------------------------------------------------------------------------------


def brute_components(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 120)] + [(1000, x) for x in range(1001, 1200)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2))] + [(5000, 5000), (-7, 6000), (-7, 6000)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: v for k, v in brute_components([e for e in edges if e[0] != e[1]]).items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings --------------------------------------------------------------------------------------------


def brute_links(rows, least=0.98):
    n, out = len(rows), []
    able = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if a else None for r, a in zip(rows, able, strict=True)]
    near = [[i != j and able[i] and able[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least for j in range(n)] for i in range(n)]
    parts = brute_components([(i, j) for i in range(n) for j in range(n) if near[i][j]])
    ids = {}
    for i in range(n):
        if rows[i][0] is not None:
            c = parts.get(i, i)
            ids[c] = min(rows[i][0], ids.get(c, rows[i][0]))
    for i in range(n):
        c = ids.get(parts.get(i, i))
        out.append((rows[i][0], sum(near[i]), c, rows[i][0] == c))
    return collections.Counter(out)


def vectors():
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1, None):
        base = rng.standard_normal((25, 16))
        for b in base:
            rows.append((k, [float(np.float32(x)) for x in b], label))
            k += 1
        for b in base[:6]:
            for _ in range(8):
                rows.append((k, [float(np.float32(x)) for x in b + rng.normal(0, 0.1, 16)], label))
                k += 1
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (901, rows[0][1], 0), (902, [2 * x for x in rows[0][1]], 0), (None, rows[1][1], 0)]
    rows += [(910, None, 0), (911, [], 0), (912, [0.0] * 16, 0), (913, [None, *[1.0] * 15], 0), (914, [float("nan")] * 16, 0), (915, [float("inf")] * 16, 1), (916, rows[0][1][:8], 0), (None, [0.0] * 16, 1)]
    return rows


@pytest.mark.parametrize("options", [{}, {"leaf": 20, "trees": 6, "margin": 1.4}])
def test_embedding_links_equal_brute_force(spark, options):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, pid int, mult int")
    got = collections.Counter(tuple(r) for r in embeddings.classes(frame, **options).collect())
    assert got == brute_links(rows)


@pytest.mark.parametrize("dim", [16, 64, 256, 1024])
def test_cuts_divide_at_any_dimension(dim):
    """Vectors without clusters are cut level by level, and few of them go both ways."""
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((1024, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    spill = embeddings.MARGIN * math.sqrt(2 - 2 * embeddings.LEAST_COSINE) / math.sqrt(dim)
    p = (v @ embeddings._directions(1, 0, 0, dim)).astype(np.float32)
    heap = embeddings._grow(p, 60, spill)
    assert (heap[:, 0] >= 0).all()
    rows, place = embeddings._walk(p, np.repeat(heap[None], len(p), axis=0))
    assert set(rows) == set(range(1024)) and len(rows) < 1.2**embeddings.STEP * 1024


@pytest.mark.parametrize("dim", [48, 512])
def test_forest_recall_where_labels_exceed_a_leaf(spark, dim):
    """Labels of ten leaves, with the default parameters, against all pairs."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((2300, dim))
    x = np.concatenate([base, *(base[k * 100 : k * 100 + 100] + rng.normal(0, s, (100, dim)) for k, s in enumerate((0.05, 0.1, 0.15, 0.18)))]).astype(np.float32)
    x = np.concatenate([x, base[0] + rng.normal(0, 0.09, (400, dim))]).astype(np.float32)  # near copies of one vector, more than a leaf
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r[0]: r[1:] for r in embeddings.classes(frame).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    n = np.array([got[i][0] for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.99 * want.sum() > 0


def test_embedding_blocks_count_each_pair_once(spark, monkeypatch):
    rows = vectors()
    for name, value in (("BLOCK", 16), ("COPIES", 3), ("EDGES", 10)):
        monkeypatch.setattr(embeddings, name, value)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert collections.Counter(tuple(r) for r in embeddings.classes(frame).collect()) == brute_links(rows)


def test_embeddings_of_nothing(spark):
    assert embeddings.classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- urls --------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/1?x#y", "https://a.example.com/en/7", "https://example.com/en/70", "https://com/en/", "https://xcom/en/1", "https://b.net/de/8", "https://example.net/de/81",
    "https://www.spam-farm.org/x", "https://spam-farming.org/", "https://ok.org/read?u=cheap-pills", "ftp://ads1.host/x", "https://x.org/es/1/", "https://x.org?es", "https://x.org#/es/", "https://é.net/de/", "x://CHEAP-PILLS.fr",
    "http://doubleclick.net/", "https://payday-loan.io/a://b", "http://a.b.c.net/de/" + "z" * 5000, "https://casino_win.com/fr", "https://user@host.com:80/en/",
]


def brute_judge(url):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match("[^/?#]*", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match("[^?#]*", rest[len(raw) :])[0]
    fits = [(h + p, v) for v, h, p in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda f: len(f[0]))
    return host, path, None, "block" if any(re.search(p, low, re.A) for p in urls.PATTERN_RULES) else "allow"


def test_urls_equal_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS])] + [(None, URLS[5], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string")
    got = collections.Counter(tuple(r[:5]) for r in urls.judge(pages).collect())
    assert got == collections.Counter((r[0], *brute_judge(r[1])) for r in rows)
    assert urls.judge(pages.limit(0)).count() == 0


def test_literal_tokens_are_whole_and_required():
    found = urls.literal_tokens
    assert found(r"\bspam-farm\b") == ["spam", "farm"]
    assert found(r"farm\b") == [] and found(r"/ad(s|v)/track/") == ["track"]
    assert found(r"\bloans?\b") == [] and found(r"(a|b)") == []
    assert found(r"^[a-z]+://ad[sv]?[0-9]*\.") == []
    index, always = urls.indexed([r"\bspam-farm\b", r"(a|b)"], {"spam": 9, "farm": 2})
    assert index == {"farm": [0]} and always == [1]


def test_index_equals_trying_every_rule(spark, tmp_path):
    """Thousands of rules, folded case and anchors among them: what the index fetches holds all that match."""
    assert urls.literal_tokens(r"(?i)\bAds\b") == ["ads"] and urls.literal_tokens(r"\bAds\b") == []
    assert urls.literal_tokens(r"^http://www\.") == ["http", "www"] and urls.literal_tokens(r"/end$") == ["end"]
    rng = random.Random(8)
    words = [f"{a}{b}{n}" for a in "abcde" for b in ("ds", "log", "x") for n in range(40)]
    forms = [r"(?i)\b{0}\b", r"\b{1}-{0}\b", r"/{1}/{2}/", r"(?i)^https?://{0}\.", r"{1}$", r"\b{1}s?\b", r"[&?]{1}=", r"(?i){0}_{0}", r"\b{0}\b"]
    rules = tuple(rng.choice(forms).format(w.title(), w, rng.choice(words)) for w in rng.choices(words, k=3000))
    spell = lambda: rng.choice((str, str.upper, str.title))(rng.choice(words))
    rows = [(i, f"{rng.choice(('http', 'HTTPS'))}://{spell()}.xyz/{spell()}-{spell()}/{spell()}/{spell()}_{spell()}?{spell()}={spell()}") for i in range(300)]
    (tmp_path / "rules.txt").write_text("# rules\n\n" + "\n".join(rules) + "\n")
    rules = urls.read_rules(spark, str(tmp_path / "rules.txt"))
    assert len(rules) == 3000
    got = dict(urls.judge(spark.createDataFrame(rows, "page_id long, url string"), patterns=rules).select("page_id", "pattern").collect())
    compiled = [re.compile(r, re.A) for r in rules]
    assert got == {i: next((r.pattern for r in compiled if r.search(u.lower())), None) for i, u in rows}


# --- html --------------------------------------------------------------------------------------------------


def test_blocks_of_untidy_pages():
    texts = lambda p: [t for _, t, _ in html.blocks(p)]
    assert texts("") == [] and texts("plain &amp; simple") == ["plain & simple"]
    assert texts('<p>a <b>b<br>c<p>d</b> e<div>f</div>g<script>var t="</p>";x()</script> h<!-- <p>no</p> -->i') == ["a b c", "d e", "f", "g hi"]
    assert texts("<style>p{}</style><ul><li>1<li>2<ul><li>3</ul></ul><p title='a>b'>x &lt;p&gt; 3 < 4</p>") == ["1", "2", "3", "x <p> 3 < 4"]
    assert texts("<p>&eacute;&#233;&#xe9;&nbsp;&nbsp;z\n\t y</p><textarea>no</textarea><title>no</title>") == ["ééé z y"]
    assert texts("<p>open <script>never closed") == ["open"]
    assert len(html.blocks("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1
    assert texts("<p>&am<b>p;lt;</b> &lt;<i>b</i></p>") == ["&amp;lt; <b"]
    assert texts('<p title="open>one</p><p class=a>two</p> < 3') == ["one", "two", "< 3"]
    assert texts("<p>a <!-- b < c") == ["a"] and texts("<p>a <b c < d") == ["a <b c < d"]


@pytest.mark.parametrize("part", ['<a href="x>t ', "<a 'x ", "<div>text ", "<b>", "<svg>", "</section></b>", "<p><b>x", "<i><div><b></i>", "<!x ", "<li><td>a", "<div class=c{}>x "])
def test_blocks_in_linear_time(part):
    """Untidy pages cost their size: 16 times as long, less than 64 times the time."""

    def seconds(n):
        page = "".join(part.replace("{}", str(i % 100)) for i in range(n)) + ("'" if part.startswith("<a ") else "")
        start = time.process_time()
        html.vectors(html.blocks(page))
        return time.process_time() - start

    seconds(1000)
    assert seconds(32_000) < max(64 * seconds(2000), 1)


def test_labels_on_held_out_pages():
    rng, right, total = np.random.default_rng(99), 0, 0
    weights = html.model()
    for _ in range(120):
        page, labels = compose(rng)
        found = html.blocks(page)
        got = html.label(weights, [found])[0]
        right += sum(bool(labels[t]) == bool(y) for (_, t, _), y in zip(found, got, strict=True))
        total += len(found)
    assert right / total > 0.97


def test_extract_equals_the_articles_of_the_tables_pages(spark):
    """The pages' own markup tells the main text: headings and paragraphs of the one article, as another parser reads them."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("p", "h1", "div", "article"):
                self.blocks.append("")
            elif tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "div", "article"):
                self.blocks.append("")
            self.inside &= tag != "article"

        def handle_data(self, data):
            self.blocks[-1] += data if self.inside else ""

    folder = "/root/testdata/sf0.01/pages.parquet"
    got = {r.page_id: r.text for r in html.extract(spark.read.parquet(folder)).collect()}
    for r in spark.read.parquet(folder).collect():
        parser = Article()
        parser.feed(r.html)
        parser.close()
        assert got[r.page_id] == "\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t), r.page_id


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in html._weights(1).items()}
    path = html.Element("p", ("p",), html.Element("div", ("div", ".a"), None))
    pages = [html.vectors([(path, f"Some words {i} {k}.", 0.1 * k) for k in range(n)]) for i, n in enumerate((5, 3))]
    x = html.Batch(pages)
    x.dense = x.dense.astype(float)
    y = rng.integers(0, 2, (2, 5)).astype(float)

    def loss():
        z = html.logits(w, x)
        return ((np.logaddexp(0, z) - y * z) * x.mask).sum() / x.mask.sum()

    grads = html._gradients(w, x, y)
    for k in w:
        at = np.unravel_index(np.argmax(np.abs(grads[k])), w[k].shape)
        keep = w[k][at]
        w[k][at] = keep + 1e-3
        up = loss()
        w[k][at] = keep - 1e-3
        down = loss()
        w[k][at] = keep
        assert math.isclose((up - down) / 2e-3, grads[k][at], rel_tol=0.02, abs_tol=1e-5), k


def test_extract_pages(spark):
    main = "<h1>Title &amp; more</h1><p>First  paragraph,\nwith words.<p>Second one."
    page = f'<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now.</div><article>{main}</article><div class="comments"><p>Nice text, thanks a lot.</p></div><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, "x"), (2, "v", None, "x"), (3, "w", "", "x"), (4, "z", page.replace("Second one.", "Second one. " * 20_000), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = collections.Counter(tuple(r) for r in html.extract(pages).collect())
    want = entities.unescape("Title &amp; more\nFirst paragraph, with words.\nSecond one.")
    long = want + " " + " ".join(["Second one."] * 19_999)
    assert got == collections.Counter([(1, "u", want, len(want))] * 2 + [(None, None, want, len(want)), (2, "v", "", 0), (3, "w", "", 0), (4, "z", long, len(long))])
    assert html.extract(pages.limit(0)).count() == 0


def test_lm_tree_adds_every_part(spark):
    """Blocks of more parts than one level adds up."""
    import zlib

    data = zlib.compress(np.ones(4, np.float32).tobytes())
    blocks = spark.range(200).select(F.lit("classes").alias("kind"), (F.col("id") % 2).cast("int").alias("block"), F.col("id").cast("int").alias("part"), F.lit(data).alias("data"))
    found = lm._added(blocks)
    assert {k: v.tolist() for k, v in found.items()} == {("classes", 0): [100.0] * 4, ("classes", 1): [100.0] * 4}
