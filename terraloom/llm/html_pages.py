"""Composed training pages: templates with known main text, in invented words so that markup carries the labels."""

from __future__ import annotations

import numpy as np

# Class words by the part of a page they mark.
MAIN = "content article post entry story body main text page single prose markdown blog news document reader".split()
PARTS = {
    "nav": "nav menu navbar breadcrumb breadcrumbs navigation toolbar tabs pagination topbar links".split(),
    "header": "header masthead banner top branding logo site title tagline hero".split(),
    "footer": "footer copyright legal bottom credits colophon imprint".split(),
    "aside": "sidebar aside widget related recommended popular trending teaser rail side more promoted".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner dfp outbrain taboola".split(),
    "notice": "cookie consent notice alert gdpr privacy popup modal newsletter subscribe paywall disclaimer message overlay".split(),
    "form": "form search login signup signin contact subscribe newsletter register survey poll".split(),
    "comments": "comments comment reply replies discussion disqus thread respond feedback reactions".split(),
    "share": "share social sharing follow tags tag meta byline buttons toolbox rating".split(),
}
# Words that pages' other parts often say.
SAYS = {
    "nav": "home about contact news sports login menu next previous search archive".split(),
    "header": "welcome search sign in menu site".split(),
    "footer": "© copyright all rights reserved privacy terms imprint contact".split(),
    "aside": "related popular more trending read also latest".split(),
    "ad": "buy now sale offer sponsored advertisement free shipping discount".split(),
    "notice": "cookies accept we use consent privacy subscribe newsletter agree".split(),
    "form": "email name submit password send search your".split(),
    "comments": "reply said comment comments posted ago like thanks".split(),
    "share": "share tweet facebook email print follow tags".split(),
}
_PARTS = list(PARTS)
_SYLLABLES = "an be co da el fi go hu in ja ko le mi no or pa qu re sa ti un ve wi xo ye zu sch ein ción eau ère ño ß ü th er ing ed ly".split()


def _pool(n: int = 6000, seed: int = 7) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), k)) for k in rng.integers(1, 5, n)]


_POOL = _pool()


def _word(rng: np.random.Generator) -> str:
    return _POOL[int(rng.integers(len(_POOL)))]


def _words(rng: np.random.Generator, low: int, high: int, says: list[str] = ()) -> str:
    n = int(rng.integers(low, high + 1))
    out = [_POOL[i] for i in rng.integers(0, len(_POOL), n)]
    if says:
        for i in np.flatnonzero(rng.random(n) < 0.35):
            out[i] = says[int(rng.integers(len(says)))]
    return " ".join(out)


def _sentences(rng: np.random.Generator, n: int) -> str:
    return " ".join(_words(rng, 1, 18).capitalize() + "...?!"[int(rng.integers(5))] for _ in range(n))


def _pick(rng: np.random.Generator, words: list[str]) -> str:
    name = str(rng.choice(words))
    if rng.random() < 0.4:
        extra = _word(rng).encode("ascii", "ignore").decode() or "x"
        name = rng.choice([f"{name}-{extra}", f"{extra}-{name}", f"{name}_{extra}", f"{name} {extra}"])
    return f' {rng.choice(["class", "class", "class", "id"])}="{name}"'


class _Page:
    def __init__(self, rng: np.random.Generator):
        self.rng, self.labels, self.seen = rng, {}, set()

    def leaf(self, text: str, main: bool) -> str:
        text = " ".join(text.split())
        while text in self.seen:
            text += " " + _word(self.rng)
        self.seen.add(text)
        self.labels[text] = float(main)
        return text

    def part(self, kind: str) -> str:
        """A part that is not main text, in its own element or in a marked div."""
        rng, says = self.rng, SAYS[kind]
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = own if own and rng.random() < 0.6 else str(rng.choice(["div", "section", "div", "aside" if kind in ("ad", "share") else "div"]))
        mark = "" if tag == own and rng.random() < 0.6 else _pick(rng, PARTS[kind])
        n, out = int(rng.integers(1, 6)), []
        shape = rng.random()
        if kind == "nav" or kind in ("aside", "footer", "share", "header") and shape < 0.4:
            items = "".join(f'<li><a href="/{i}">{self.leaf(_words(rng, 1, 6, says), False)}</a></li>' for i in range(n + 1))
            out.append(f"<ul>{items}</ul>")
        elif kind == "form":
            out += [f"<p>{self.leaf(_words(rng, 1, 8, says), False)}</p>", '<input name="q"><button>', self.leaf(_words(rng, 1, 2, says), False), "</button>"]
        elif kind == "comments" or shape > 0.7:
            # As long and as well written as main text: only its place tells it apart.
            inner = _pick(rng, PARTS[kind]) if kind == "comments" else ""
            out += [f"<div{inner}><p>{self.leaf(_sentences(rng, int(rng.integers(1, 6))), False)}</p></div>" for _ in range(n)]
        elif shape < 0.55:
            out.append(self.leaf(_words(rng, 2, 30, says) + "." if rng.random() < 0.5 else _sentences(rng, int(rng.integers(1, 5))), False))
        else:
            out += [f"<p>{self.leaf(_words(rng, 2, 14, says), False)}</p>" for _ in range(n)]
        return f"<{tag}{mark}>{''.join(out)}</{tag}>"

    def main(self) -> str:
        rng, out = self.rng, []
        end = "</p>" if rng.random() < 0.7 else ""
        if rng.random() < 0.8:
            out.append(f"<h1>{self.leaf(_words(rng, 1, 14), True)}</h1>")
        for _ in range(int(rng.integers(1, 12) if rng.random() < 0.85 else rng.integers(12, 90))):
            r = rng.random()
            if r < 0.66:
                body = self.leaf(_sentences(rng, int(rng.integers(1, 7))), True)
                out.append(f"<p><b>{body}<br>{end}" if r < 0.12 else f"<p>{body}{end}")
            elif r < 0.74:
                out.append(f"<h{rng.integers(2, 5)}>{self.leaf(_words(rng, 1, 8), True)}</h2>".replace("</h2>", ""))
                out[-1] += f"</h{out[-1][2]}>"
            elif r < 0.81:
                out.append("<ul>" + "".join(f"<li>{self.leaf(_words(rng, 1, 20), True)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif r < 0.84:
                out.append(f"<blockquote><p>{self.leaf(_sentences(rng, 2), True)}</p></blockquote>")
            elif r < 0.87:  # text of the main part itself, set apart by a division
                out.append(f"<div></div>{self.leaf(_sentences(rng, int(rng.integers(1, 5))), True)}<div></div>")
            elif r < 0.89:
                out.append("<table><tr>" + "".join(f"<td>{self.leaf(_words(rng, 1, 4), True)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(self.part(str(rng.choice(["ad", "share", "aside", "notice", "form", "comments", "nav"]))))
        body = "".join(out)
        r = rng.random()
        if r < 0.45:
            tags = "<article>", "</article>"
        elif r < 0.6:
            tags = "<main>", "</main>"
        elif r < 0.7:
            tags = f"<article{_pick(rng, MAIN)}>", "</article>"
        elif r < 0.95:
            tags = f"<div{_pick(rng, MAIN)}>", "</div>"
        else:
            tags = "<div>", "</div>"
        if rng.random() < 0.25:
            tags = tags[0] + f"<div{_pick(rng, MAIN)}>", "</div>" + tags[1]
        return tags[0] + body + tags[1]


def compose(rng: np.random.Generator) -> tuple[str, dict[str, float]]:
    """(html, {block text: 1 main, 0 not}) of a random page."""
    page = _Page(rng)
    before = [k for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.5]
    after = [k for k in ("share", "comments", "aside", "ad", "form", "notice", "nav", "footer") if rng.random() < 0.45]
    parts = [page.part(k) for k in rng.permutation(before)] if before else []
    body = "".join([*parts, page.main() if rng.random() < 0.97 else "", *(page.part(k) for k in after)])
    if rng.random() < 0.3:
        body = f'<div{rng.choice(["", " class=wrapper", " id=page", " class=container"])}>{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 2, 8)}</title></head><body>{body}</body></html>", page.labels
