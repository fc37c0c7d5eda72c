"""Main-text extraction with a recurrent block labeller.

Method: a page becomes its sequence of leaf blocks, the runs of text between
block-level tags. Each block has a vector of its hashed tag path (tags, classes,
ids, roles), its hashed words and its lengths and link share. A bidirectional
LSTM in numpy reads the whole sequence both ways and labels every block as main
text or not; the blocks labelled main text, in page order, are the text.

The network is trained here, from a fixed seed, on pages that ``sample_page``
composes from rules: articles among menus, headers, footers, sidebars, notices,
adverts, forms and comments, under varying markup. No supplied page is used.

A page is split in one pass, whose time follows its length whatever its markup:
open elements are found by name, a block shares the path of its element, and a
tag is read without going back. A page of very many blocks is read by the network
in chunks, forth and back, with the state carried on between them.

Defined cases: a null or empty page has an empty text; markup that is not closed
is closed by what follows, a tag that the page ends in is no text, and a quote
that is not closed does not count; comments, scripts, styles, templates and
frames hold no blocks, other elements do; character references are decoded in
text, once; repeated pages are read each; pages of any length are read whole;
other columns are ignored.
"""

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.text import Words, buffers, lean, slices, strings

#: Fixed values of HTML: elements that break the flow of text, that never hold any, whose contents are not text, and that end an open paragraph.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noframes noembed iframe".split())
ENDS_P = BLOCK - frozenset("button body caption head html legend optgroup option select tbody td textarea tfoot th thead title tr".split())
#: An opening tag also ends an open element of these kinds, up to the element that holds them.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}

#: A tag; the quantifiers do not give back, so that a tag is read once. Quotes count after an equals sign only.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]+))""", re.I)
_SHUT = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}

PATH_DIM, WORD_DIM, HIDDEN = 64, 16, 12
DIM = PATH_DIM + WORD_DIM + 6
#: Blocks that are labelled together, padding included, and of one long page in a chunk.
CELLS, CHUNK = 1 << 14, 1 << 12


_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_AFTER_LT = _LETTERS | frozenset("/!?")


class Step:
    """An open element on the path of those that follow."""

    __slots__ = ("_counts", "depth", "key", "name", "tag", "up")

    def __init__(self, up: "Step | None", tag: str, name: str):
        self.up, self.tag, self.name, self._counts = up, tag, name, None
        self.depth = up.depth + 1 if up else 0
        above = up.key if up else ""
        #: The whole path, for those that are short enough to be remembered.
        self.key = f"{above}\0{name}" if above is not None and len(above) + len(name) < 1000 else None

    def counts(self) -> np.ndarray:
        """Per hashed tag or name how often the path has it, 2 at most."""
        if self.key is not None:
            return _remembered(self.key)[0]
        new, step = [], self
        while step is not None and step._counts is None and step.key is None:
            new.append(step)
            step = step.up
        counts = np.zeros(PATH_DIM, np.uint8) if step is None else step.counts() if step.key is not None else step._counts
        for step in reversed(new):
            counts = step._counts = np.minimum(counts + _marks(step.name)[0], 2)
        return counts

    def vector(self) -> np.ndarray:
        return _remembered(self.key)[1] if self.key is not None else np.minimum(self.counts() + _marks(self.name)[1], 2)


@lru_cache(20_000)
def _remembered(key: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts and vector of a path."""
    names = key.split("\0")[1:]
    counts = np.zeros(PATH_DIM, np.uint8)
    for name in names:
        counts = np.minimum(counts + _marks(name)[0], 2)
    return counts, np.minimum(counts + _marks(names[-1])[1], 2)


@lru_cache(20_000)
def _marks(name: str) -> tuple[np.ndarray, np.ndarray]:
    """What an element adds to a path: by itself, and where it is the last."""
    own, last = np.zeros(PATH_DIM, np.uint8), np.zeros(PATH_DIM, np.uint8)
    tag, *names = re.split(r"[^a-z0-9]+", name.lower())
    for x in (tag, *(f"named {n}" for n in names)):
        at = zlib.crc32(x.encode()) % PATH_DIM
        own[at] = min(own[at] + 1, 2)
    last[zlib.crc32(f"last {tag}".encode()) % PATH_DIM] = 1
    return own, last


@dataclass(slots=True)
class Block:
    path: Step | None
    text: str
    linked: int  # characters within links


_ZEROS, _HUGE = re.compile(r"&#0++(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def _plain(text: str) -> str:
    """With character references decoded, each run of white space one space, trimmed."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))  # beyond any code point, and too long for a number
    return " ".join(html.unescape(text).split())


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[Step] = []
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    parts: list[str] = []
    linked = in_link = at = 0
    never_shut: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = _plain("".join(parts)) if parts else ""
        parts.clear()
        if text:
            out.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
        linked = 0

    def close(i: int) -> None:
        nonlocal in_link
        flush()
        while len(stack) > i:
            opened[stack.pop().tag].pop()
        in_link = 0

    last = lambda tags: max((opened[t][-1] for t in tags if opened.get(t)), default=-1)
    end = len(page)
    while at < end:
        lt = page.find("<", at)
        stop = end if lt < 0 else lt
        following = page[lt + 1 : lt + 2] if lt >= 0 else ""
        is_tag = following in _AFTER_LT
        if lt >= 0 and not is_tag:
            stop = lt + 1  # a sign, not markup
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                linked += stop - at
        at = stop
        if not is_tag:
            continue
        if page.startswith("<!--", lt):
            at = page.find("-->", lt + 2)
            at = end if at < 0 else at + 3
            continue
        if following in "!?" or following == "/" and page[lt + 2 : lt + 3] not in _LETTERS:
            at = page.find(">", lt)
            at = end if at < 0 else at + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            break
        at, closing, tag = m.end(), m[1], m[2].lower()
        if tag in RAW:
            if not closing and not m[3].endswith("/") and tag not in never_shut:
                shut = _SHUT[tag].search(page, at)
                if shut:
                    at = page.find(">", shut.end() - 1)
                    at = end if at < 0 else at + 1
                elif tag in ("script", "style"):
                    break
                else:
                    never_shut.add(tag)
            continue
        if tag not in BLOCK:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        if closing:
            if opened.get(tag):
                close(opened[tag][-1])
            else:
                flush()
            continue
        flush()
        if tag in ENDS_P and opened.get("p"):
            close(opened["p"][-1])
        elif tag in SIBLINGS:
            kinds, holders = SIBLINGS[tag]
            if (i := last(kinds)) > last(holders):
                close(i)
        in_link = 0
        if tag not in VOID:
            names = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(m[3])) if "=" in m[3] else ""
            opened.setdefault(tag, []).append(len(stack))
            stack.append(Step(stack[-1] if stack else None, tag, f"{tag} {names}" if names else tag))
    flush()
    return out


_NO_PATH = np.minimum(_marks("")[0] + _marks("")[1], 2)


def vectors(found: list[Block]) -> np.ndarray:
    """(n, DIM) of blocks that may come from several pages."""
    out = np.zeros((len(found), DIM), np.float32)
    if not found:
        return out
    data, at = buffers(strings(pa.array([b.text for b in found])))
    words = Words(data, at)
    cell = words.doc * WORD_DIM + (words.hashes(lower=True) >> np.uint64(40)).astype(np.int64) % WORD_DIM
    bag = np.bincount(cell, minlength=len(found) * WORD_DIM).reshape(len(found), WORD_DIM)
    out[:, :PATH_DIM] = [b.path.vector() if b.path else _NO_PATH for b in found]
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = bag / np.maximum(words.count, 1)[:, None]
    size = np.array([len(b.text) for b in found], np.float32)
    stops = np.bincount(np.searchsorted(at, np.flatnonzero(np.isin(data, [0x2E, 0x2C, 0x21, 0x3F])), "right") - 1, minlength=len(found))[: len(found)]
    extra = np.stack([np.log1p(words.count) / 5, np.log1p(size) / 8, np.array([b.linked for b in found]) / size, np.minimum(stops / np.maximum(words.count, 1), 1), words.count >= 8, np.array([b.path.depth if b.path else 0 for b in found]) / 10], axis=1)
    out[:, PATH_DIM + WORD_DIM :] = extra
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BiLstm:
    """Two LSTMs over (time, batch, DIM), one reading backwards, and a logistic output."""

    def __init__(self, rng: np.random.Generator):
        self.w = []
        for _ in range(2):
            self.w += [rng.normal(0, 0.15, (DIM, 4 * HIDDEN)), rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)), np.zeros(4 * HIDDEN)]
            self.w[-1][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.w += [rng.normal(0, 0.15, (2 * HIDDEN,)), np.zeros(())]
        self.w = [w.astype(np.float32) for w in self.w]

    @staticmethod
    def _flip(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each sequence of (time, batch, ...) turned round within its own length."""
        t = np.arange(x.shape[0])[:, None]
        source = np.where(t < length, length - 1 - t, t)
        return np.take_along_axis(x, source.reshape(source.shape + (1,) * (x.ndim - 2)), axis=0)

    def _read(self, x: np.ndarray, wx, wh, b, kept: list | None, state: list | None = None) -> np.ndarray:
        """Outputs of all steps; ``state`` is what reading starts from, and is replaced by what it ends with."""
        steps, n, _ = x.shape
        ahead = x @ wx + b
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            z = ahead[t] + h @ wh
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = (h, c), f * c + i * g
            th = np.tanh(c)
            h = o * th
            if kept is not None:
                kept.append((i, f, o, g, th, *before))
            out[t] = h
        if state is not None:
            state[:] = h, c
        return out

    def long_logits(self, found: list[Block]) -> np.ndarray:
        """Logits of one page of any number of blocks, whose vectors are made chunk by chunk."""
        out = np.full(len(found), self.w[7], np.float32)
        cuts = range(0, len(found), CHUNK)
        for order, weights, mix in ((cuts, self.w[0:3], self.w[6][:HIDDEN]), (reversed(cuts), self.w[3:6], self.w[6][HIDDEN:])):
            state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
            turn = slice(None, None, 1 if order is cuts else -1)
            for at in order:
                x = vectors(found[at : at + CHUNK])[turn, None]
                out[at : at + CHUNK] += (self._read(x, *weights, None, state)[:, 0] @ mix)[turn]
        return out

    def forward(self, x: np.ndarray, length: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Logits (time, batch); those past a sequence's length have no meaning."""
        keep = [[], []] if kept is not None else [None, None]
        right = self._read(x, *self.w[0:3], keep[0])
        back = self._flip(x, length)
        left = self._flip(self._read(back, *self.w[3:6], keep[1]), length)
        both = np.concatenate([right, left], axis=2)
        if kept is not None:
            kept += [keep, back, both]
        return both @ self.w[6] + self.w[7]

    def _unread(self, x, wx, wh, kept, grad) -> list[np.ndarray]:
        gz = np.empty((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        gwh = np.zeros_like(wh)
        dh_next, dc_next = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, th, h, c = kept[t]
            dh = grad[t] + dh_next
            dc = dh * o * (1 - th * th) + dc_next
            z = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            gz[t] = z
            gwh += h.T @ z
            dh_next, dc_next = z @ wh.T, dc * f
        return [x.reshape(-1, DIM).T @ gz.reshape(-1, 4 * HIDDEN), gwh, gz.sum((0, 1))]

    def gradients(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        kept: list = []
        z = self.forward(x, length, kept)
        (right, left), back, both = kept
        mask = np.arange(len(x))[:, None] < length
        p = _sigmoid(z)
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / mask.sum()
        dz = mask * (p - y) / mask.sum()
        d = dz[:, :, None] * self.w[6]
        out = self._unread(x, self.w[0], self.w[1], right, d[:, :, :HIDDEN])
        out += self._unread(back, self.w[3], self.w[4], left, self._flip(d[:, :, HIDDEN:], length))
        return float(loss), [*out, (dz[:, :, None] * both).sum((0, 1)), dz.sum()]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in pages])
    x = np.zeros((length.max(), len(pages), pages[0].shape[1]), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, length


_SYLLABLES = "an be co da el fi go ha in ju ka lo mi no or pa qu re sa te un vi wo xe ya zu ção ée über ñan".split()


def _prose(rng, lo: int, hi: int) -> str:
    words = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
    style = rng.randrange(8)
    if style == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if style == 1:
        return " ".join(w + rng.choice(["***", "&amp;&amp;", "%%%", "###", ""]) for w in words)
    for k in range(len(words)):
        if rng.random() < 0.12:
            words[k] += rng.choice([".", ",", "."])
    return (" ".join(words)).capitalize() + rng.choice([".", ".", ""])


def sample_page(rng: random.Random) -> str:
    """A composed page; what is main text stands between the control characters \\x02 and \\x03 of each block."""
    pick = lambda *x: rng.choice(x)
    chance = lambda p: rng.random() < p
    main = lambda: f"\x02{_prose(rng, 1, 4) if chance(0.2) else _prose(rng, 3, 70)}\x03"
    short = lambda: _prose(rng, 1, 4)
    links = lambda n: "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(n)) + "</ul>"
    named = lambda tag, names, body: f'<{tag} {pick("class", "id")}="{pick(*names)}">{body}</{tag}>'

    def menu() -> str:
        return pick(f"<nav>{links(rng.randrange(2, 9))}</nav>", named("div", ["menu", "nav", "navbar", "navigation", "breadcrumb", "top-menu"], links(rng.randrange(2, 9))), f'<nav class="main-nav">{" ".join(f"<a>{short()}</a>" for _ in range(rng.randrange(2, 7)))}</nav>')

    def header() -> str:
        return pick(f"<header>{pick('', f'<h1>{short()}</h1>', f'<p>{short()}</p>', f'<div>{short()}</div>')}{pick('', menu())}</header>", named("div", ["header", "masthead", "banner", "site-header", "top"], f"<p>{short()}</p>"))

    def footer() -> str:
        body = f"&copy; {short()} &middot; {_prose(rng, 2, 25)}"
        return pick(f"<footer>{body}</footer>", f"<footer><p>{body}</p></footer>", f"<footer>{links(4)}<p>{body}</p></footer>", named("div", ["footer", "site-footer", "copyright", "legal", "bottom"], f"<p>{body}</p>"))

    def advert() -> str:
        return named(pick("div", "aside", "section", "div"), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot"], pick(_prose(rng, 2, 30), f"<p>{_prose(rng, 2, 30)}</p>", f"<h3>{short()}</h3><p>{_prose(rng, 4, 25)}</p>"))

    def sidebar() -> str:
        body = pick(f"<h3>{short()}</h3>{links(rng.randrange(2, 7))}", f"<p>{_prose(rng, 3, 30)}</p>", f"<h2>{short()}</h2><p>{_prose(rng, 4, 30)}</p>{links(3)}")
        return pick(f"<aside>{body}</aside>", named("div", ["sidebar", "related", "widget", "side", "recommended", "trending", "share", "social", "tags"], body), named("aside", ["sidebar", "related"], body))

    def notice() -> str:
        return named(pick("div", "section", "div"), ["cookie", "cookie-notice", "cookies", "consent", "gdpr", "notice", "alert", "newsletter", "popup", "modal", "subscribe"], pick(f"<p>{_prose(rng, 4, 35)}</p><button>{short()}</button>", _prose(rng, 4, 30), f"<p>{_prose(rng, 4, 35)}</p>"))

    def form() -> str:
        return f"<form>{pick('', f'<label>{short()}</label>')}<p>{_prose(rng, 1, 12)}</p><input><select><option>{short()}</option><option>{short()}</select><button>{short()}</button></form>"

    def comments() -> str:
        one = lambda: pick(f'<div class="comment"><p>{_prose(rng, 2, 45)}</p></div>', f"<li><b>{short()}</b><p>{_prose(rng, 2, 45)}</p></li>", f'<article class="comment"><p>{_prose(rng, 2, 45)}</p></article>')
        body = f"{pick('', f'<h2>{short()}</h2>', f'<h3>{short()}</h3>')}{''.join(one() for _ in range(rng.randrange(1, 8)))}"
        return named(pick("div", "section", "ol"), ["comments", "comment-list", "responses", "discussion", "replies", "reader-comments"], body)

    def body() -> str:
        out = []
        if chance(0.8):
            out.append(f"<h1>{main()}</h1>")
        for _ in range(rng.randrange(1, 12) if chance(0.9) else rng.randrange(12, 60)):
            out.append(pick(
                f"<p>{main()}</p>", f"<p>{main()}</p>", f"<p>{main()}</p>", f"<p>{main()}", f"<p><b>{main()}<br>", f"<h2>{main()}</h2>", f"<h3>{main()}</h3>",
                f"<ul>{''.join(f'<li>{main()}</li>' for _ in range(rng.randrange(1, 5)))}</ul>", f"<ol><li>{main()}<li>{main()}</ol>", f"<blockquote>{main()}</blockquote>", f"<blockquote><p>{main()}</p></blockquote>",
                f"<pre>{main()}</pre>", f"<table><tr><td>{main()}<td>{main()}</tr></table>", f"<div>{main()}</div>", f"<section><h2>{main()}</h2><p>{main()}</p></section>", f"<figure><figcaption>{main()}</figcaption></figure>",
            ))
            if chance(0.06):
                out.append(pick(advert, sidebar, notice, form)())
        if chance(0.1):
            out.insert(0, main())  # text that stands in the article itself
        return "".join(out)

    inner = body()
    article = pick(f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f"<main>{inner}</main>", named("div", ["content", "article", "post", "entry", "main", "story", "article-body", "post-content"], inner), f'<article class="post">{inner}</article>', f'<div id="page"><article>{inner}</article></div>')
    above = [f() for f in (header, menu, advert, notice) if chance(0.5)]
    below = [f() for f in (sidebar, comments, form, advert, menu, notice) if chance(0.35)]
    rng.shuffle(above)
    rng.shuffle(below)
    foot = footer() if chance(0.85) else ""
    title = f"<head><meta charset=utf-8><title>{short()}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
    wrap = pick("{}", "{}", '<div id="wrapper">{}</div>', '<div class="container">{}</div>')
    return f"<!DOCTYPE html><html>{title}<body>{wrap.format(''.join(above) + article + ''.join(below))}{foot}{pick('</body></html>', '')}"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a composed page and whether each is main text."""
    found = blocks(page)
    y = np.array(["\x02" in b.text for b in found], float)
    for b in found:
        b.text = b.text.replace("\x02", "").replace("\x03", "") or "."
    return found, y


@lru_cache(1)
def trained(n_pages: int = 700, steps: int = 260, seed: int = 5) -> BiLstm:
    composer, rng = random.Random(seed), np.random.default_rng(seed)
    pages = [labelled(sample_page(composer)) for _ in range(n_pages)]
    data = [(vectors(b), y) for b, y in pages if b]
    model = BiLstm(rng)
    m, v = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w]
    by_length = sorted(range(len(data)), key=lambda i: len(data[i][0]))
    size = 32
    for step in range(1, steps + 1):
        at = rng.integers(0, max(len(by_length) - size, 1))
        chosen = by_length[at : at + size]  # pages of like length
        x, length = _padded([data[i][0] for i in chosen])
        x[:, :, PATH_DIM:] *= rng.random((1, size, 1)) < 0.7  # markup has to do without words at times
        y = np.zeros(x.shape[:2], np.float32)
        for k, i in enumerate(chosen):
            y[: len(data[i][1]), k] = data[i][1]
        _, grads = model.gradients(x, length, y)
        norm = np.sqrt(sum((g * g).sum() for g in grads))
        rate = 0.02 * (1 - step / (steps + 1)) + 0.001
        for k, g in enumerate(grads):
            g = g * min(1.0, 2.0 / (norm + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            model.w[k] = model.w[k] - np.float32(rate) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def extract(pages: list[str], model: BiLstm) -> list[str]:
    """The main text of each page."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    written = lambda i, main: "\n\n".join(b.text for b, yes in zip(found[i], main, strict=False) if yes)
    order = [i for i in np.argsort([len(p) for p in found], kind="stable") if found[i]]
    while order and len(found[order[-1]]) > CELLS:
        i = order.pop()
        out[i] = written(i, model.long_logits(found[i]) > 0)
    while order:
        # pages of like length together, as many as the padded cells allow
        longest = len(found[order[-1]])
        take = max(1, min(len(order), CELLS // longest))
        chosen, order = order[-take:], order[:-take]
        flat = vectors([b for i in chosen for b in found[i]])
        at = np.concatenate([[0], np.cumsum([len(found[i]) for i in chosen])])
        x, length = _padded([flat[at[k] : at[k + 1]] for k in range(take)])
        main = model.forward(x, length) > 0
        for k, i in enumerate(chosen):
            out[i] = written(i, main[:, k])
    return out


def extracted(pages: DataFrame, keys: list[str], column: str = "html", most: int = 2 << 20) -> DataFrame:
    """``keys`` of each page with ``text`` and ``n_chars``, in one pass without a shuffle."""
    spec = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    shipped = pages.sparkSession.sparkContext.broadcast(trained())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = strings(batch.column(batch.num_columns - 1))
            for lo, hi in slices(sources, most):
                texts = extract(sources.slice(lo, hi - lo).to_pylist(), shipped.value)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keys, "text", "n_chars"])

    return pages.select(*keys, column).mapInArrow(run, f"{spec}, text string, n_chars long")
