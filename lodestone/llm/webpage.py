"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaves: runs of text between the tags that break lines. Each leaf has a vector of its tag
path (tags, words of classes and ids), of its hashed words and of a few measures; a bidirectional LSTM in numpy reads the
whole sequence in both directions and labels every leaf, so a leaf is judged in the context of all the others.

No page of a corpus is labelled, so the labeller is trained on pages made from a seed (``made_page``), whose leaves are
known to be article or not: containers with telling, vague, scrambled or no names, and all the furniture that isn't article
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments) before, inside and after it. Training takes
place once for each driver process; the labeller is a few hundred kilobytes, whatever the corpus.

A leaf's white space becomes single spaces; leaves are joined in page order by a line feed. Scripts, styles, templates and
the head have no leaves. Nothing is capped: a page of any length is read whole, in steps of bounded memory. Null and empty
pages have an empty text. Repeated rows each have their result, an empty table has none, and columns besides page_id, url
and html aren't read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that break lines (fixed values of HTML).
BLOCK = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Tags whose text isn't shown, or is typed in by the reader, and tags without content (fixed values of HTML).
SILENT = frozenset("script style noscript template head title textarea iframe object svg math canvas audio video datalist noembed noframes".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag that closes an open one of the same kind, and where the search for it ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol menu dl table tbody thead tfoot tr div section article aside nav header footer main form blockquote fieldset figure td th".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z))", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TEXT = re.compile(r"[^\W_]+|©|»|›|\|")

PATH, WORDS, MEASURES, HIDDEN = 256, 192, 18, 24
WIDTH = PATH + WORDS + MEASURES
SEED, PAGES, EPOCHS, BATCH, RATE = 12, 1500, 9, 16, 0.01
#: Leaves read at a time, over all pages of a batch.
STEP = 8192


class Leaf(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int
    depth: int


class _Hashes(dict):
    """Bucket of a string; a cache of bounded size."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, x: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[x] = k = zlib.crc32(x.encode("utf-8", "surrogatepass")) % self.buckets
        return k


def _names(attributes: str) -> tuple[str, ...]:
    """Words of classes, ids and roles, each with its first four letters."""
    out: list[str] = []
    for m in _NAME.finditer(attributes):
        for w in _WORD.findall(m[1]):
            out += (f"c:{w.lower()}", f"c4:{w.lower()[:4]}")
    return tuple(out)


def leaves(html: str) -> list[Leaf]:
    """The leaves of a page in order. Tags that are left open close with what holds them, and a page may end anywhere."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    blocks: list[str] = ["body"]
    held: dict[str, int] = {}  # what the open tags say, and how many of them
    parts: list[str] = []
    linked, silent, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Leaf(text, (*held, f"l:{blocks[-1]}", f"l2:{'/'.join(blocks[-2:])}"), min(linked, len(text)), len(stack)))
        parts.clear()
        linked = 0

    def open_(tag: str, names: tuple[str, ...]) -> None:
        nonlocal silent
        own = (f"t:{tag}", *names)
        stack.append((tag, own))
        for x in own:
            held[x] = held.get(x, 0) + 1
        if tag in BLOCK:
            blocks.append(tag)
        silent += tag in SILENT

    def close(k: int) -> None:
        nonlocal silent
        while len(stack) > k:
            tag, own = stack.pop()
            for x in own:
                held[x] -= 1
                if not held[x]:
                    del held[x]
            if tag in BLOCK:
                blocks.pop()
            silent -= tag in SILENT

    def say(x: str) -> None:
        nonlocal linked
        if x and not silent:
            x = unescape(x)
            parts.append(x)
            if "t:a" in held:
                linked += len(x.strip())

    while at < len(html):
        lt = html.find("<", at)
        m = _TAG.match(html, lt) if lt >= 0 else None
        if lt < 0:
            say(html[at:])
            break
        if m is None:  # a sign that opens no tag
            say(html[at : lt + 1])
            at = lt + 1
            continue
        say(html[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            if f"t:{tag}" in held:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in HOLDS:
                    break
        if tag in VOID:
            continue
        if tag == "body":
            close(0)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        open_(tag, _names(m[3]))
    flush()
    return out


_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def vectors(parts: list[tuple[list[Leaf], int, int, int]], path: _Hashes, words: _Hashes) -> np.ndarray:
    """Rows for the leaves from ``lo`` to ``hi`` of each (page, lo, hi, length of the page's longest leaf)."""
    marks, n_marks, said, n_said, measures = [], [], [], [], []
    for page, lo, hi, longest in parts:
        for k in range(lo, hi):
            text, own, linked, depth = page[k]
            marks += [path[p] for p in own]
            n_marks.append(len(own))
            found = {words[w] for w in _TEXT.findall(text.lower())}
            said += found
            n_said.append(len(found))
            raw, n = text.encode("utf-8", "replace"), len(text)
            gaps = text.count(" ")
            stops = sum(map(text.count, (". ", "! ", "? ", "… "))) + (text[-1] in ".!?…")
            digits, upper = len(raw) - len(raw.translate(None, _DIGITS)), len(raw) - len(raw.translate(None, _UPPER))
            measures.append((n, gaps + 1, linked / n, text[-1] in ".!?…:;\"”»)", stops, text.count(",") / (gaps + 1), digits / n, upper / n, n / longest, k / len(page), (len(page) - k) / len(page), len(page), depth))
    x = np.zeros((len(n_marks), WIDTH), np.float32)
    x[np.repeat(np.arange(len(x)), n_marks), marks] = 1
    x[np.repeat(np.arange(len(x)), n_said), np.array(said, np.int64) + PATH] = np.repeat(1 / np.sqrt(np.maximum(n_said, 1)), n_said)
    n, size, linked, ends, stops, commas, digits, upper, share, first, last, leaves_, depth = np.array(measures, np.float32).reshape(-1, 13).T
    own = (np.log1p(n) / 6, np.log1p(size) / 5, linked, linked > 0, ends, np.minimum(stops, 8) / 4, stops > 0, commas, digits, upper, size < 4, n > 200, share, first, last, np.log1p(leaves_) / 5, depth / 12, np.ones(len(x)))
    x[:, PATH + WORDS :] = np.stack(own, axis=1)
    return x


class Labeller:
    """Weights of the two directions (input, hidden, bias), and of the output over both and over the leaf itself."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w |= {f"x{d}": rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * h)), f"h{d}": rng.normal(0, h**-0.5, (h, 4 * h)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], h)}
        self.w |= {"o": rng.normal(0, 0.1, 2 * h), "s": np.zeros(WIDTH), "ob": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _step(self, d: str, z: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        n = HIDDEN
        z = z + h @ self.w[f"h{d}"]
        gate = 1 / (1 + np.exp(-z[:, : 3 * n]))
        new = np.tanh(z[:, 3 * n :])
        i, f, o = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :]
        c2 = f * c + i * new
        t = np.tanh(c2)
        return o * t, c2, i, f, o, new, t

    def read(self, pages: list[list[Leaf]], path: _Hashes, words: _Hashes) -> list[np.ndarray]:
        """Log odds of every leaf of every page; ``STEP`` leaves at a time are vectors, in each direction."""
        order = sorted(range(len(pages)), key=lambda k: -len(pages[k]))
        sizes = np.array([len(pages[k]) for k in order], np.int64)
        longest = [max((len(x.text) for x in pages[k]), default=1) for k in order]
        out = [np.full(len(pages[k]), self.w["ob"][0], np.float32) for k in order]
        top = int(sizes[0]) if len(sizes) else 0
        span = max(1, STEP // max(1, len(pages)), top if sizes.sum() <= STEP else 0)
        whole = None
        for d in "fb":
            h, c = np.zeros((2, len(pages), HIDDEN), np.float32)
            w = self.w["o"][:HIDDEN] if d == "f" else self.w["o"][HIDDEN:]
            for lo in range(0, top, span):
                steps = min(span, top - lo)
                live = np.searchsorted(-sizes, -np.arange(lo, lo + steps), side="left").tolist()  # pages that have a leaf at each step
                cuts = [(lo, min(int(n), lo + steps)) if d == "f" else (max(0, int(n) - lo - steps), int(n) - lo) for n in sizes[: live[0]]]
                if whole is None or span < top:
                    whole = vectors([(pages[order[r]], a, b, longest[r]) for r, (a, b) in enumerate(cuts)], path, words)
                y = whole @ self.w[f"x{d}"] + self.w[f"b{d}"]
                own = whole @ self.w["s"] if d == "f" else None
                z = np.zeros((steps, live[0], 4 * HIDDEN), np.float32)
                at = 0
                for r, (a, b) in enumerate(cuts):
                    z[: b - a, r] = y[at : at + b - a] if d == "f" else y[at : at + b - a][::-1]
                    if own is not None:
                        out[r][a:b] += own[at : at + b - a]
                    at += b - a
                said = np.zeros((steps, live[0]), np.float32)
                for t, n in enumerate(live):
                    h[:n], c[:n] = self._step(d, z[t, :n], h[:n], c[:n])[:2]
                    said[t, :n] = h[:n] @ w
                for r, (a, b) in enumerate(cuts):
                    out[r][a:b] += said[: b - a, r] if d == "f" else said[: b - a, r][::-1]
        back = [np.empty(0, np.float32)] * len(pages)
        for r, k in enumerate(order):
            back[k] = out[r]
        return back

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over a batch (steps, pages, width) of labels ``y``, where ``mask`` has leaves (from the first on)."""
        steps, n, _ = x.shape
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        sizes = mask.sum(axis=0).astype(int)
        turn = np.where(mask > 0, sizes[None, :] - 1 - np.arange(steps)[:, None], np.arange(steps)[:, None])
        flip = lambda a: np.take_along_axis(a, turn.reshape(steps, n, *[1] * (a.ndim - 2)), axis=0)
        logit = x @ self.w["s"] + self.w["ob"]
        kept = {}
        for k, d in enumerate("fb"):
            xs = x if d == "f" else flip(x)
            z = xs @ self.w[f"x{d}"] + self.w[f"b{d}"]
            h = c = np.zeros((n, HIDDEN), np.float32)
            own = []
            hs = np.zeros((steps, n, HIDDEN), np.float32)
            for t in range(steps):
                before = (h, c)
                h, c, *gates = self._step(d, z[t], h, c)
                hs[t] = h
                own.append((before, c, gates))
            kept[d] = (xs, own, hs)
            logit = logit + (hs if d == "f" else flip(hs)) @ self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
        p = 1 / (1 + np.exp(-logit))
        total = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total
        e = (p - y) * mask / total
        g["ob"][0] = e.sum()
        g["s"] = np.tensordot(e, x, axes=([0, 1], [0, 1]))
        for k, d in enumerate("fb"):
            xs, own, hs = kept[d]
            es = e if d == "f" else flip(e)
            wo = self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            g["o"][k * HIDDEN : (k + 1) * HIDDEN] = np.tensordot(es, hs, axes=([0, 1], [0, 1]))
            dz = np.zeros((steps, n, 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                (h0, c0), _, (i, f, o, new, tc) = own[t]
                dh = dh + es[t][:, None] * wo
                dc = dc + dh * o * (1 - tc * tc)
                dz[t] = np.concatenate([dc * new * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], axis=1) * mask[t][:, None]
                g[f"h{d}"] += h0.T @ dz[t]
                dh, dc = dz[t] @ self.w[f"h{d}"].T, dc * f
            g[f"x{d}"] = np.tensordot(xs, dz, axes=([0, 1], [0, 1]))
            g[f"b{d}"] = dz.sum(axis=(0, 1))
        return float(loss), g

    def fit(self, pages: list[tuple[list[Leaf], np.ndarray]], epochs: int, rng: np.random.Generator) -> None:
        """Adam over batches of pages of about one length."""
        path, words = _Hashes(PATH), _Hashes(WORDS)
        pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
        batches = []
        for k in range(0, len(pages), BATCH):
            own = pages[k : k + BATCH]
            x = np.zeros((max(len(p) for p, _ in own), len(own), WIDTH), np.float16)
            y, mask = np.zeros((2, *x.shape[:2]), np.float32)
            for j, (p, labels) in enumerate(own):
                x[: len(p), j] = vectors([(p, 0, len(p), max(len(a.text) for a in p))], path, words)
                y[: len(p), j], mask[: len(p), j] = labels, 1
            batches.append((x, y, mask))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        t = 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + RATE / 20
            for b in rng.permutation(len(batches)):
                x, y, mask = batches[b]
                x = x.astype(np.float32)
                x[:, :, : PATH + WORDS] *= rng.random((1, 1, PATH + WORDS)) > 0.1  # no single bucket decides
                _, g = self.gradients(x, y, mask)
                norm = sum(float((a * a).sum()) for a in g.values()) ** 0.5
                t += 1
                for k, a in g.items():
                    a = a * min(1, 1 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


#: What made pages say and are named. Plain lists of words that pages use; they only feed training.
_SYLLABLES = "an en er in re th on le la ou ai de es st nd ing tion ment que der ein sch ge lich ung ver os as ar cion ado por ve ti ka ro mi su ne ta lo pe".split()
_CONTENT = "content main post entry story article body text page single blog news read copy prose document paper mainContent articleBody post-content entry-content story-text article__body td-post-content rich-text".split()
_VAGUE = "wrap wrapper container inner outer row col box layout grid site block section group flex holder module center left wide".split()
_FURNITURE = {
    "nav": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs links site-nav pagination pager tabs toc skip-link".split(),
    "header": "header masthead top topbar branding logo site-header banner-top head hero-top tagline".split(),
    "footer": "footer bottom colophon site-footer copyright legal foot page-footer credits imprint".split(),
    "aside": "sidebar aside side widget rail related secondary side-bar rightcol recommended popular trending see-also more-stories read-next".split(),
    "notice": "cookie cookies notice consent gdpr alert banner popup modal privacy message paywall announcement disclaimer cookie-banner overlay warning toast".split(),
    "ad": "ad ads advert advertisement sponsored promo sponsor banner-ad adsense commercial ad-slot ad-box promotion partner dfp adunit".split(),
    "form": "form search newsletter subscribe signup login contact-form searchform search-box register subscription poll".split(),
    "comments": "comments comment-list comments-area discussion replies respond disqus comment thread reader-comments responses feedback".split(),
    "share": "share social sharing share-buttons tools follow social-links tags tag-list post-meta-tags".split(),
}
_PHRASES = {
    "nav": "home;about;contact;news;sports;world;business;products;blog;log in;sign up;next;previous;categories;archive;help;startseite;accueil;inicio;kontakt;menu;more;skip to content".split(";"),
    "header": "welcome to our site;daily news;your source for everything;the journal;since 1998;search;sign in".split(";"),
    "footer": "© 2024 all rights reserved;copyright;terms of use;privacy policy;contact us;imprint;powered by;made with love;alle rechte vorbehalten;tous droits réservés;sitemap".split(";"),
    "aside": "related articles;most read;popular posts;recent posts;you may also like;trending now;about the author;see also;read more;recommended for you".split(";"),
    "notice": "we use cookies to improve your experience;accept all;this site uses cookies;by continuing you agree to our privacy policy;please enable javascript;subscribe to continue reading;manage preferences;ok;got it".split(";"),
    "ad": "advertisement;sponsored;buy now and save 50%;limited time offer;shop now;click here;free shipping on all orders;anzeige;publicité;try it free today;best deals".split(";"),
    "form": "your email;subscribe;name;password;search;submit;enter your e-mail address;send;sign up for our newsletter;remember me;message".split(";"),
    "comments": "reply;comments;leave a comment;3 comments;great article thanks;i disagree with this;posted 2 hours ago;report;says;like;thank you for sharing;first".split(";"),
    "share": "share;tweet;facebook;email;print;twitter;pin it;whatsapp;copy link;tags".split(";"),
}


class _Maker:
    """One page: pieces of HTML, and for each leaf whether it is article."""

    def __init__(self, rng: random.Random):
        self.rng, self.parts = rng, []
        self.labels: list[int] = []
        self.own = rng.sample(_SYLLABLES, rng.randrange(8, 30))
        self.vocabulary = ["".join(rng.choice(self.own) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(60, 400))]
        self.named = rng.choice(["telling", "telling", "telling", "vague", "scrambled", "none"])
        self.marks = rng.choice(["", "", "", " ***", "%%%", "&amp;&amp;", "###"])
        self.tidy = rng.random() < 0.6

    def words(self, n: int) -> str:
        rng = self.rng
        out = [rng.choice(self.vocabulary) for _ in range(n)]
        for k in range(1, n):
            if rng.random() < 0.12:
                out[k] += rng.choice([",", ".", ".", ";", "!", "?", ":"])
            if out[k - 1][-1] in ".!?":
                out[k] = out[k].capitalize()
        if self.marks and rng.random() < 0.7:
            out = [w + self.marks for w in out]
        return (" ".join(out).capitalize() + rng.choice([".", ".", ".", "", "?"])) if n else ""

    def leaf(self, label: int) -> None:
        self.labels.append(label)

    def name(self, kind: str | None) -> str:
        """Attributes of a container: telling (its kind's), vague, scrambled or none."""
        rng = self.rng
        if self.named == "none" or rng.random() < 0.1:
            return ""
        if self.named == "scrambled":
            words = ["css-" + "".join(rng.choice("abcdefghij0123456789") for _ in range(6))]
        elif self.named == "vague" or kind is None or rng.random() < 0.15:
            words = rng.sample(_VAGUE, rng.randrange(1, 3))
        else:
            words = [rng.choice(_CONTENT if kind == "content" else _FURNITURE[kind])] + rng.sample(_VAGUE, rng.random() < 0.3)
        words = [w + rng.choice(["", "", "", "1", "-2", "s"]) for w in words]
        return f' {rng.choice(["class", "class", "class", "id"])}="{" ".join(words)}"'

    def put(self, *html: str) -> None:
        self.parts += html
        if self.tidy and self.rng.random() < 0.5:
            self.parts.append("\n")

    def said(self, kind: str, most: int = 12) -> str:
        return self.rng.choice(_PHRASES[kind]).capitalize() if self.rng.random() < 0.55 else self.words(self.rng.randrange(1, most))

    def links(self, kind: str, n: int) -> None:
        rng = self.rng
        style = rng.randrange(3)
        if style < 2:
            tag = rng.choice(["ul", "ul", "ol"])
            self.put(f"<{tag}>")
            for _ in range(n):
                self.put(f'<li><a href="/{rng.randrange(99)}">{self.said(kind, 5 if style else 12)}</a></li>' if self.tidy or rng.random() < 0.8 else f'<li><a href="#">{self.said(kind, 5)}</a>')
                self.leaf(0)
            self.put(f"</{tag}>")
        else:
            self.put(rng.choice([" | ", " ", " · "]).join(f'<a href="/{k}">{self.said(kind, 4)}</a>' for k in range(n)))
            self.leaf(0)

    def furniture(self, kind: str) -> None:
        """Something that isn't article, in one of its usual forms."""
        rng = self.rng
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = own if own and rng.random() < 0.6 else rng.choice(["div", "div", "section", "div"])
        if kind == "comments" and rng.random() < 0.5:
            tag = "section"
        plain = self.named in ("none", "scrambled", "vague") and tag in ("div", "section") and kind not in ("nav", "footer", "header", "share", "form")
        mark = self.name(kind) if not plain or rng.random() < 0.5 else f' class="{rng.choice(_FURNITURE[kind])}"'
        if tag != own and not mark and kind not in ("nav", "footer", "header", "share"):
            mark = f' class="{rng.choice(_FURNITURE[kind])}"'
        self.put(f"<{tag}{mark}>")
        inner = rng.random() < 0.25
        if inner:
            self.put(f"<div{self.name(None)}>")
        if kind in ("nav", "share"):
            if rng.random() < 0.2:
                self.heading(rng.choice(["h3", "h4", "span", "p"]), kind)
            self.links(kind, rng.randrange(1 if kind == "share" else 2, 12))
        elif kind == "header":
            if rng.random() < 0.8:
                self.heading(rng.choice(["h1", "h2", "p", "div"]), kind, link=rng.random() < 0.5)
            if rng.random() < 0.5:
                self.heading("p", kind)
            if rng.random() < 0.5:
                self.links("nav", rng.randrange(2, 9))
        elif kind == "footer":
            for _ in range(rng.randrange(1, 4)):
                if rng.random() < 0.5:
                    self.put(f"<p>{rng.choice(['&copy; ', '', 'Copyright '])}{self.said(kind, 20)} &middot; {self.words(rng.randrange(1, 16))}</p>")
                    self.leaf(0)
                elif rng.random() < 0.6:
                    self.put("<div>")
                    self.links(kind, rng.randrange(1, 8))
                    self.put("</div>")
                else:
                    self.put(f"&copy; site{rng.randrange(99)}.example.net &middot; {self.words(rng.randrange(1, 16))}")
                    self.leaf(0)
                    break
        elif kind == "aside":
            for _ in range(rng.randrange(1, 4)):
                self.heading(rng.choice(["h2", "h3", "h4", "p"]), kind)
                if rng.random() < 0.7:
                    self.links(kind, rng.randrange(1, 9))
                else:
                    for _ in range(rng.randrange(1, 4)):
                        self.put(f"<p>{self.words(rng.randrange(3, 50))}</p>")
                        self.leaf(0)
        elif kind in ("notice", "ad"):
            form = rng.randrange(3)
            if form == 0:
                self.put(f"{self.said(kind, 30)} {self.words(rng.randrange(0, 25))}")
                self.leaf(0)
            else:
                for _ in range(rng.randrange(1, 3)):
                    self.put(f"<p>{self.said(kind, 25)} {self.words(rng.randrange(0, 25))}</p>")
                    self.leaf(0)
                if form == 2:
                    self.put(f"<button>{self.said(kind, 3)}</button>" if kind == "notice" else f'<p><a href="//x.example">{self.said(kind, 5)}</a></p>')
                    self.leaf(0)
        elif kind == "form":
            if tag != "form":
                self.put("<form>")
            if rng.random() < 0.6:
                self.heading(rng.choice(["h3", "p", "legend", "h2"]), kind)
            for _ in range(rng.randrange(1, 4)):
                self.put(f"<div><label>{self.said(kind, 4)}</label><input name=x></div>" if rng.random() < 0.6 else f"<p>{self.said(kind, 12)} <input></p>")
                self.leaf(0)
            self.put(f"<button>{self.said(kind, 3)}</button>")
            self.leaf(0)
            if tag != "form":
                self.put("</form>")
        else:
            self.heading(rng.choice(["h2", "h3"]), kind)
            item, holder = rng.choice([("li", "ol"), ("div", "div"), ("article", "div"), ("li", "ul"), ("div", "section")])
            self.put(f"<{holder}{self.name(kind)}>")
            for _ in range(rng.randrange(1, 7)):
                self.put(f"<{item}{self.name(kind)}>")
                if rng.random() < 0.7:
                    self.put(f"<{(h := rng.choice(['h4', 'p', 'div', 'cite']))}>{self.words(rng.randrange(1, 3))}{rng.choice(['', ' says:', ' 2 hours ago', ' 12.05.2023'])}</{h}>")
                    if h != "cite":
                        self.leaf(0)
                        cited = False
                    else:
                        cited = True
                else:
                    cited = False
                bodies = rng.randrange(1, 3)
                for k in range(bodies):
                    body = self.said(kind, 40) if rng.random() < 0.4 else self.words(rng.randrange(3, 70))
                    if cited and k == 0:
                        self.put(f" {body}")
                    else:
                        self.put(f"<p>{body}</p>")
                    self.leaf(0)
                if rng.random() < 0.5:
                    self.put('<div><a href="#r">Reply</a></div>')
                    self.leaf(0)
                self.put(f"</{item}>")
            self.put(f"</{holder}>")
            if rng.random() < 0.3:
                self.put("<form>")
                self.heading("h3", "comments")
                self.put("<textarea>x</textarea><button>Post comment</button></form>")
                self.leaf(0)
        if inner:
            self.put("</div>")
        self.put(f"</{tag}>")

    def heading(self, tag: str, kind: str, link: bool = False) -> None:
        text = self.said(kind, 6)
        self.put(f"<{tag}>" + (f'<a href="/">{text}</a>' if link else text) + f"</{tag}>")
        self.leaf(0)

    def paragraph(self) -> None:
        rng = self.rng
        text = self.words(rng.choice([1, 2, 3, 6, 12, 25, 40, 60, 90, 160, 220]))
        roll = rng.random()
        if rng.random() < 0.04:
            text = " ".join([self.words(rng.randrange(1, 4))] * rng.randrange(2, 120))
        if roll < 0.15:
            text += f' <a href="/x{rng.randrange(9)}">{self.words(rng.randrange(1, 6))}</a> {self.words(rng.randrange(0, 12))}'
        elif roll < 0.25:
            text = f"<{(i := rng.choice(['b', 'i', 'em', 'strong', 'span']))}>{text}</{i}>"
        elif roll < 0.33:
            self.put(f"<p><b>{text}<br>")
            self.leaf(1)
            return
        elif roll < 0.4:
            text = f"{text}<br>{self.words(rng.randrange(3, 30))}"
        tag = self.para
        self.put(f"<{tag}>{text}</{tag}>" if rng.random() < 0.85 or tag != "p" else f"<p>{text}")
        self.leaf(1)

    def article(self) -> None:
        rng = self.rng
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "div", "section", "td"])
        around = 0 if tag == "td" else rng.choice([0, 0, 1, 1, 2, 3])
        for _ in range(around):
            self.put(f"<{rng.choice(['div', 'div', 'main', 'section'])}{self.name(rng.choice([None, 'content']))}>")
        opened = "<table><tr><td" if tag == "td" else f"<{tag}"
        self.put(f"{opened}{self.name('content')}>")
        self.para = rng.choice(["p", "p", "p", "p", "div"])
        head = rng.random() < 0.15
        if rng.random() < 0.8:
            self.put("<header>" if head else "", f"<{(h := rng.choice(['h1', 'h1', 'h1', 'h2']))}>{self.words(rng.randrange(1, 14))}</{h}>")
            self.leaf(1)
            if rng.random() < 0.2:
                self.put(f"<p class=byline>By {self.words(2)} {rng.choice(['', 'on 3 May 2023'])}</p>")
                self.leaf(1)
            self.put("</header>" if head else "")
        if rng.random() < 0.06 and self.para == "p":
            self.put(self.words(rng.randrange(20, 300)))
            self.leaf(1)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9, 14, 22, 30])):
            roll = rng.random()
            if rng.random() < 0.02:
                text = self.words(rng.randrange(1, 40))
                for _ in range(rng.randrange(3, 25)):
                    self.put(f"<{self.para}>{text}</{self.para}>")
                    self.leaf(1)
            if roll < 0.72:
                self.paragraph()
            elif roll < 0.8:
                self.put(f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{self.words(rng.randrange(1, 9))}</{h}>")
                self.leaf(1)
            elif roll < 0.84:
                self.put(f"<{(t := rng.choice(['ul', 'ol']))}>")
                for _ in range(rng.randrange(1, 7)):
                    text = self.words(rng.randrange(1, 25))
                    self.put(f"<li>{text}</li>" if rng.random() < 0.85 else f'<li><a href="/y">{text}</a> {self.words(3)}</li>')
                    self.leaf(1)
                self.put(f"</{t}>")
            elif roll < 0.87:
                self.put(f"<blockquote>{self.words(rng.randrange(4, 60))}</blockquote>")
                self.leaf(1)
            elif roll < 0.89:
                self.put(f"<figure><img src=x><figcaption>{self.words(rng.randrange(2, 20))}</figcaption></figure>")
                self.leaf(1)
            elif roll < 0.905:
                self.put("<table>")
                for _ in range(rng.randrange(1, 5)):
                    self.put("<tr>")
                    for _ in range(3):
                        self.put(f"<td>{self.words(rng.randrange(1, 4))}</td>")
                        self.leaf(1)
                    self.put("</tr>")
                self.put("</table>")
            elif roll < 0.915:
                self.put(f"<pre>{self.words(rng.randrange(2, 30))}</pre>")
                self.leaf(1)
            else:
                self.furniture(rng.choice(["ad", "ad", "notice", "form", "share", "aside"]))
        if rng.random() < 0.15:
            self.furniture(rng.choice(["share", "aside", "comments"]))
        self.put("</td></tr></table>" if tag == "td" else f"</{tag}>")
        for _ in range(around):
            self.put("</div>")

    def page(self) -> str:
        rng = self.rng
        self.put("<!DOCTYPE html><html><head><meta charset=utf-8><title>", self.words(4), "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body" + self.name(None) + ">")
        before = [k for k, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.75), ("ad", 0.35), ("form", 0.15), ("aside", 0.2), ("share", 0.1)) if rng.random() < p]
        if rng.random() < 0.3:
            rng.shuffle(before)
        for k in before:
            self.furniture(k)
            if rng.random() < 0.2:
                self.put("<!-- ad -->")
        if rng.random() < 0.96:
            self.article()
        after = [k for k, p in (("share", 0.15), ("ad", 0.2), ("comments", 0.35), ("form", 0.15), ("aside", 0.35), ("nav", 0.2), ("footer", 0.85), ("notice", 0.2)) if rng.random() < p]
        for k in after:
            self.furniture(k)
        self.put("<script>track()</script>", "</body></html>" if rng.random() < 0.8 else "")
        return "".join(self.parts)


def made_page(seed: int) -> tuple[str, list[int]]:
    """A page made from ``seed``, and whether each of its leaves is article."""
    maker = _Maker(random.Random(seed))
    return maker.page(), maker.labels


@lru_cache(maxsize=2)
def labeller(seed: int = SEED, pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    """A labeller trained on ``pages`` made pages; the same for the same arguments."""
    made = []
    for k in range(pages):
        html, labels = made_page(seed * 1_000_003 + k)
        found = leaves(html)
        if len(found) == len(labels):
            made.append((found, np.array(labels, np.float32)))
    rng = np.random.default_rng(seed)
    model = Labeller(rng)
    model.fit(made, epochs, rng)
    return model


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text (the leaves labelled as article), n_chars, n_blocks and n_kept of every row of ``pages``."""
    model = model or labeller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, words = _Hashes(PATH), _Hashes(WORDS)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [leaves(x or "") for x in part.column(2).to_pylist()]
                odds = model.read(found, path, words)
                kept = [[leaf.text for leaf, o in zip(page, own, strict=True) if o > 0] for page, own in zip(found, odds, strict=True)]
                text = ["\n".join(x) for x in kept]
                sizes = [pa.array(list(map(len, x)), pa.int64()) for x in (text, found, kept)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), *sizes], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    types = dict(pages.select("page_id", "url").dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long, n_blocks long, n_kept long")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
