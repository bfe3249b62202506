"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text between block-level
tags).  Each block is described by its tag path (tags, classes and ids of all
ancestors, hashed), its words (hashed) and a few shape figures.  A
bidirectional LSTM in numpy reads the whole sequence, so every block is judged
in the context of its document, and labels it as article text or not.

The labeller is trained here, on ``TRAIN_PAGES`` generated pages (a documented
bound) of many layouts: articles in semantic, plain and table containers or in
none, short pages, titles and leads before the container, lists, tables, bylines
and threads, among menus, headers, footers, sidebars, notices, adverts, forms and
reader comments.  Bylines, captions and the posts of a thread count as text.
Training is deterministic and takes about half a minute once an application.

Scripts, styles, comments of the markup and the head never give blocks.
Character references are decoded, white space in a block becomes one space,
blocks are joined in page order by a blank line.  Null and empty pages, and
pages without article blocks, give an empty text; a tag cut off at the end of
a page is dropped.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 3000
EPOCHS = 12
HIDDEN = 20
PATH_DIM, WORD_DIM, SHAPE_DIM = 256, 96, 8
DIM = PATH_DIM + WORD_DIM + SHAPE_DIM

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[/a-zA-Z])[^<>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAMED = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
# fixed values: elements that don't end a block, and elements without content
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SAME_CLOSES = frozenset("li dt dd td th tr option p".split())


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path, text, share of the text in links) of the leaf blocks in page order."""
    out, stack, text, linked, total = [], [], [], 0, 0
    opened = Counter()  # names on the stack

    def flush():
        nonlocal linked, total
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                path = tuple(w for s in stack if s[0] not in INLINE for w in s[1])
                out.append((path, joined, linked / max(1, total)))
            text.clear()
            linked = total = 0

    def close(k):
        opened.subtract(s[0] for s in stack[k:])
        del stack[k:]

    for m in _TOKEN.finditer(page):
        name = m[3]
        if name is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                raw = html.unescape(raw) if "&" in raw else raw
                if not opened["head"] and not opened["title"]:
                    text.append(raw)
                    total += len(raw)
                    if opened["a"]:
                        linked += len(raw)
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    close(k)
                    break
                if inline and stack[k][0] not in INLINE:
                    break  # a stray end tag of an inline element ends nothing outside its block
        elif name not in VOID:
            if name in SAME_CLOSES or not inline:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name and name in SAME_CLOSES or stack[k][0] == "p" and not inline:
                        close(k)
                        break
                    if stack[k][0] not in INLINE and stack[k][0] != "p":
                        break
            marks = [name]
            for a in _NAMED.finditer(m[4]):
                marks += ["." + w for w in _PART.findall((a[2] or a[3] or a[4] or "").lower())]
            stack.append((name, marks))
            opened[name] += 1
    flush()
    return out


class _Slots(dict):
    """Word -> slot of the hashed vector; bounded by starting anew."""

    def __init__(self, dim):
        self.dim = dim

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        self[word] = slot = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.dim
        return slot


_WORDS = _Slots(WORD_DIM)


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for w in path:
        v[zlib.crc32(w.encode()) % PATH_DIM] = 1
    last = [w for w in path if not w.startswith(".")][-2:]
    for k, w in enumerate(reversed(last)):
        v[zlib.crc32(f"{k}>{w}".encode()) % PATH_DIM] = 1
    return v


def describe(page: list[tuple]) -> np.ndarray:
    """The feature vectors of a page's blocks."""
    x = np.zeros((len(page), DIM), np.float32)
    for k, (path, text, linked) in enumerate(page):
        words = text.lower().split()
        x[k, :PATH_DIM] = _path_vector(path)
        slots = np.bincount([_WORDS[w] for w in words], minlength=WORD_DIM)
        x[k, PATH_DIM: PATH_DIM + WORD_DIM] = np.sqrt(slots / len(words))
        n = len(text)
        x[k, PATH_DIM + WORD_DIM:] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, linked, text[-1] in ".!?…\"", "©" in text,
                                      text.count(".") / len(words), k / len(page), 1.0 / (1 + len(page)))
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = r.normal(0, 0.08, (DIM, 4 * HIDDEN)).astype(np.float32)
            self.p["U" + d] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p["c" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.p["V"] = r.normal(0, 0.2, (2 * HIDDEN, 1)).astype(np.float32)
        self.p["v"] = np.zeros(1, np.float32)

    def _pass(self, x, mask, d, keep):
        """x: (steps, pages, DIM); states (steps, pages, HIDDEN), and what backpropagation needs."""
        z = x @ self.p["W" + d] + self.p["c" + d]
        steps, pages = x.shape[:2]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, saved = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + h @ self.p["U" + d]
            gates = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN: 2 * HIDDEN], gates[:, 2 * HIDDEN:]
            a = np.tanh(g[:, 3 * HIDDEN:])
            new = f * c + i * a
            m = mask[t][:, None]
            tc = np.tanh(new)
            if keep:
                saved.append((t, h, c, i, f, o, a, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, saved

    def forward(self, x, mask, keep=False):
        f, sf = self._pass(x, mask, "f", keep)
        b, sb = self._pass(x, mask, "b", keep)
        both = np.concatenate([f, b], 2)
        return (both @ self.p["V"])[..., 0] + self.p["v"], both, (sf, sb)

    def gradients(self, x, mask, y):
        logit, both, saved = self.forward(x, mask, True)
        e = ((_sigmoid(logit) - y) * mask / mask.sum()).astype(np.float32)
        g = {"V": np.einsum("tph,tp->h", both, e)[:, None], "v": np.array([e.sum()], np.float32)}
        back = e[..., None] * self.p["V"][:, 0]
        for d, steps, part in (("f", saved[0], back[..., :HIDDEN]), ("b", saved[1], back[..., HIDDEN:])):
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            u = np.zeros_like(self.p["U" + d])
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            for t, h, c, i, f, o, a, tc, m in reversed(steps):
                dh = dh + part[t]
                live, rest_h, rest_c = dh * m, dh * (1 - m), dc * (1 - m)
                dn = dc * m + live * o * (1 - tc * tc)
                dg = np.concatenate([dn * a * i * (1 - i), dn * c * f * (1 - f), live * tc * o * (1 - o), dn * i * (1 - a * a)], 1)
                dz[t] = dg
                u += h.T @ dg
                dh, dc = dg @ self.p["U" + d].T + rest_h, dn * f + rest_c
            g["U" + d], g["c" + d] = u, dz.sum((0, 1))
            g["W" + d] = x.reshape(-1, DIM).T @ dz.reshape(-1, 4 * HIDDEN)
        return g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is article text; pages of like length run together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            longest, take = 0, []
            while at < len(order) and len(take) < 64 and len(pages[order[at]]) * (len(take) + 1) <= 8192 or not take:
                take.append(order[at])
                longest = len(pages[order[at]])
                at += 1
                if at == len(order):
                    break
            x, mask = _padded([pages[k] for k in take], longest)
            logit = self.forward(x, mask)[0]
            for j, k in enumerate(take):
                out[k] = logit[: len(pages[k]), j] > 0
        return out


def _padded(pages, steps):
    x = np.zeros((steps, len(pages), DIM), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


# fixed values: words of page furniture, and class names in use for each kind of element
_PHRASES = {
    "menu": "home about contact news products services blog shop login register account search help archive topics start kontakt "
            "inicio accueil suche noticias",
    "notice": "this site uses cookies to improve your experience accept all settings privacy policy consent we value your privacy "
              "agree continue cookie einstellungen akzeptieren",
    "ad": "advertisement sponsored buy now limited offer save today click here free shipping best deal sale discount anzeige publicité",
    "side": "related articles most read popular trending latest posts tags categories recommended you may also like follow us",
    "form": "name email message send submit subscribe newsletter sign up password your comment remember me",
    "comment": "reply said wrote says great article thanks for sharing i agree disagree posted by user comments ago guest like report",
    "footer": "copyright all rights reserved terms of use privacy imprint contact sitemap impressum powered by",
    "share": "share tweet facebook twitter linkedin print email whatsapp pin it",
}
# fixed values: frequent words of some languages
_FREQUENT = ("the of and to in a is that for it as was with be on by at from are this have not or which one you were all their has will more "
             "its new can we after his they said who de la le et les des en un une du que est pour qui dans sur pas el los las por con para una "
             "del se al der die und das ist den von zu mit auf für nicht ein eine im dem")
_CLASSES = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs main-menu links",
    "header": "header masthead top topbar site-header logo branding page-header",
    "notice": "cookie cookies notice consent banner gdpr alert popup cookie-notice modal paywall",
    "ad": "ad ads advert advertisement sponsored promo promotion adsense banner-ad adbox ad-slot teaser-ad",
    "side": "sidebar side widget related aside rail recommended popular teaser more-news tags",
    "form": "form newsletter subscribe search-form login signup contact-form",
    "comment": "comments comment comment-list replies discussion responses disqus comment-body reader-comments",
    "footer": "footer site-footer bottom copyright legal colophon foot",
    "share": "share social sharing social-links toolbar share-buttons",
    "article": "article post entry content entry-content article-body post-content story story-body text main-content body-text "
               "article-content page-content richtext",
}
_CONTENT = ""  # marks article text in generated pages


class _Writer:
    """Random pages with known labels."""

    def __init__(self, rng):
        self.r = rng
        parts = "the an er on re ti en es le ou de la que ich sch un ge ver os ar ción mo ta li su ké ße ü ne ra ko".split()
        invented = ["".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(1500)]
        numbers = [str(n) for n in rng.integers(1, 2030, 60)]
        furniture = sorted({x for own in _PHRASES.values() for x in own.split()})
        pools = ((_FREQUENT.split(), 0.42), (invented, 0.46), (furniture, 0.08), (numbers, 0.04))
        self.pool = np.array([x for words, _ in pools for x in words], object)
        weights = np.concatenate([share * (v := 1 / (3 + np.arange(len(words)))) / v.sum() for words, share in pools])
        self.upto = np.cumsum(weights / weights.sum())
        self.names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(800)]
        self.style = None

    def pick(self, *options):
        return options[self.r.integers(len(options))]

    def chance(self, p):
        return self.r.random() < p

    def words(self, n):
        """Prose of all kinds of words: none of them is a sign of furniture by itself."""
        at = np.minimum(np.searchsorted(self.upto, self.r.random(n)), len(self.pool) - 1)
        ends = self.r.random(n)
        out = [x + ("." if e < 0.1 else "," if e < 0.18 else "") for x, e in zip(self.pool[at], ends)]
        out[-1] = out[-1].rstrip(".,")
        return (" ".join(out) + ("." if n > 3 or self.chance(0.5) else "")).capitalize()

    def phrase(self, kind, n):
        if self.chance(0.5):
            return self.words(n)
        own = _PHRASES[kind].split()
        return " ".join(own[int(i)] for i in self.r.integers(0, len(own), n)).capitalize()

    def named(self, kind):
        own = _CLASSES[kind].split()
        names = " ".join(self.pick(*own) for _ in range(self.r.integers(1, 3)))
        extra = self.pick("", "", "", " " + self.pick(*self.names))
        return f' {self.pick("class", "class", "class", "id")}="{names}{extra}"'

    def box(self, kind, tag, inner):
        """An element of a kind: by its own tag, or as a div or section with a telling class."""
        if tag and self.chance(0.55):
            return f"<{tag}{self.named(kind) if self.chance(0.4) else ''}>{inner}</{tag}>"
        t = self.pick("div", "div", "section", "ul" if kind == "menu" else "div")
        return f"<{t}{self.named(kind)}>{inner}</{t}>"

    def lines(self, kind, least, most, words):
        form = self.pick("li", "p", "div", "a", "plain")
        out = []
        for _ in range(self.r.integers(least, most + 1)):
            t = self.phrase(kind, self.r.integers(1, words + 1))
            t = f'<a href="/x">{t}</a>' if self.chance(0.5 if kind != "menu" else 0.95) else t
            out.append(t + " " if form == "plain" else f"<{form}>{t}</{form}>")
        inner = "".join(out)
        return f"<ul>{inner}</ul>" if form == "li" else inner

    def furniture(self, kind):
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        if kind == "header":
            inner = self.pick("", "", "<div>", "<div>", "<h1>") + self.phrase("menu", self.r.integers(1, 5))
            inner += self.furniture("menu") if self.chance(0.5) else ""
        elif kind == "menu":
            inner = self.lines("menu", 2, 9, 2)
        elif kind == "comment":
            tag = None
            inner = f"<h{self.r.integers(2, 4)}>{self.phrase('comment', 2)}</h2>" if self.chance(0.6) else ""
            for _ in range(self.r.integers(1, 5)):
                body = f"<p>{self.words(self.r.integers(3, 60)) if self.chance(0.7) else self.phrase('comment', 12)}</p>"
                inner += self.pick(f'<div class="comment">{body}</div>', f"<li>{body}</li>", body)
        elif kind == "form":
            inner = "".join(f"<label>{self.phrase('form', 2)}</label><input>" for _ in range(self.r.integers(1, 4)))
            inner += f"<button>{self.phrase('form', 1)}</button>"
        elif kind == "footer":
            inner = self.pick("&copy; ", "", "(c) ") + self.phrase("footer", self.r.integers(2, 14)) + self.pick("", " &middot; " + self.words(6))
            inner = self.pick(inner, f"<p>{inner}</p>", inner + self.lines("footer", 1, 4, 2))
        elif kind == "side":
            inner = self.pick("", f"<h3>{self.phrase('side', 2)}</h3>") + self.lines("side", 1, 6, 9)
        else:
            inner = self.lines(kind, 1, 2, 14)
        return self.box(kind, tag, inner)

    def prose(self, least, most):
        text = self.words(int(np.clip(self.r.lognormal(3, 1.4), least, most)))
        if self.style is not None:
            text = self.styled(text)
        cut = text.split(" ")
        marked = self.r.binomial(len(cut), 0.15) if self.linked else int(self.chance(0.15))
        for k in self.r.integers(0, len(cut), marked):
            cut[k] = self.pick(f"<b>{cut[k]}</b>", f'<a href="/y">{cut[k]}</a>', f"<em>{cut[k]}</em>", f"{cut[k]}<br>", f"<span>{cut[k]}</span>",
                               f'<a href="/z">{cut[k]}</a>')
        return _CONTENT + " ".join(cut)

    def styled(self, text):
        """Odd prose: symbols after words, separators, capitals, numbers and addresses."""
        if self.style == "symbols":
            return " ".join(w + html.escape(self.pick(*"!#$%&*+=~^?") * int(self.r.integers(1, 4))) for w in text.split())
        if self.style == "separators":
            return f" {self.pick(*'|/-;:')} ".join(text.split())
        if self.style == "capitals":
            return text.upper()
        return " ".join(self.pick(w, w, w, str(self.r.integers(10**6)), "a@b.example", "http://c.example/d") for w in text.split())

    def plain_name(self):
        """Attributes that say nothing about the kind of an element."""
        if self.chance(0.6):
            return ""
        return f' {self.pick("class", "id")}="{self.pick(*self.names)}{self.pick("", "", "-" + self.pick(*self.names))}"'

    def title(self):
        h = f"<h1{self.plain_name()}>{self.prose(1, 14)}</h1>" if self.chance(0.88) else f"<h2>{self.prose(1, 14)}</h2>"
        return f"<header>{h}</header>" if self.chance(0.12) else h

    def byline(self):
        t = self.pick("p", "div", "span", "address", "time")
        return f'<{t} class="{self.pick("byline", "author", "meta", "date", "dateline", "info")}">{_CONTENT}{self.pick("By ", "Von ", "", "")}{self.words(self.r.integers(2, 6))}</{t}>'

    def passage(self, most=160):
        """One element of an article."""
        roll = self.r.random()
        if roll < 0.68:
            return self.pick("<p>", "<p>", "<p>", "<p><b>", f"<p{self.plain_name()}>") + self.prose(1, most) + self.pick("</p>", "</p>", "<br>")
        if roll < 0.75:
            k = self.r.integers(2, 5)
            return f"<h{k}{self.plain_name()}>{self.prose(1, 9)}</h{k}>"
        if roll < 0.82:
            t = self.pick("ul", "ul", "ol")
            return f"<{t}{self.plain_name()}>" + "".join(f"<li>{self.prose(1, 20)}</li>" for _ in range(self.r.integers(2, 7))) + f"</{t}>"
        if roll < 0.85:
            return f"<blockquote>{self.pick('<p>', '')}{self.prose(5, 50)}</blockquote>"
        if roll < 0.91:
            return f"<div{self.plain_name()}>{self.prose(3, 90)}</div>"
        if roll < 0.95:
            cell = self.pick("td", "td", "th")
            return f"<table{self.plain_name()}>" + "".join(
                f"<tr><{cell}>{self.prose(1, 6)}</{cell}><td>{self.prose(1, 6)}</td></tr>" for _ in range(self.r.integers(2, 5))) + "</table>"
        if roll < 0.97:
            return f"<figure><img src=i><figcaption>{self.prose(2, 15)}</figcaption></figure>"
        if roll < 0.985:
            return "<dl>" + "".join(f"<dt>{self.prose(1, 4)}</dt><dd>{self.prose(2, 25)}</dd>" for _ in range(self.r.integers(1, 4))) + "</dl>"
        return f"<pre>{self.prose(2, 40)}</pre>"

    def wrapped(self, inner, own=0.35, told=0.35):
        """An article in its element, in one with a telling name, with another name, or in none."""
        roll = self.r.random()
        if roll < own:
            return f"<article{self.plain_name()}>{inner}</article>"
        if roll < own + told:
            return f"<{(t := self.pick('div', 'section', 'main'))}{self.named('article')}>{inner}</{t}>"
        if roll < own + told + 0.13:
            t = self.pick("div", "div", "section")
            return f"<{t}{self.plain_name()}>{inner}</{t}>"
        return inner

    def article(self):
        self.style = self.pick("symbols", "separators", "capitals", "numbers") if self.chance(0.25) else None
        self.linked = self.chance(0.2)
        opening = [self.title()] if self.chance(0.85) else []
        if self.chance(0.2):
            opening.append(self.byline())
        out = []
        for _ in range(int(self.r.integers(1, 25)) if self.chance(0.75) else int(self.r.integers(1, 4))):
            out.append(self.passage() if self.chance(0.93) else self.furniture(self.pick("ad", "share", "ad", "side", "notice", "form")))
        if self.chance(0.08):  # the same paragraph again and again
            k = int(self.r.integers(len(out)))
            out[k:k + 1] = [out[k]] * int(self.r.integers(2, 90))
        if self.chance(0.2):  # the title, and perhaps a lead, stand before the container
            inner = "".join(opening) + (f"<p{self.plain_name()}>{self.prose(5, 60)}</p>" if self.chance(0.5) else "") + self.wrapped("".join(out))
        else:
            inner = self.wrapped("".join(opening + out))
        if self.chance(0.1):  # parts in elements of their own
            t = self.pick("section", "section", "div")
            inner = "".join(f"<{t}{self.plain_name()}>{x}</{t}>" for x in opening + out)
        return f"<main>{inner}</main>" if self.chance(0.2) else self.pick(inner, inner, f'<div class="wrap container">{inner}</div>')

    def thread(self):
        """Posts of a discussion that is itself the page's matter."""
        self.style, self.linked = None, False
        mark = self.pick("post", "message", "topic", "thread", "postbody", "answer", "question", "entry")
        t = self.pick("div", "div", "article", "li", "section")
        posts = []
        for _ in range(int(self.r.integers(1, 9))):
            who = f'<div class="{self.pick("author", "username", "poster", "meta")}">{_CONTENT}{self.words(self.r.integers(1, 4))}</div>' if self.chance(0.5) else ""
            posts.append(f'<{t} class="{mark}">{who}' + "".join(f"<p>{self.prose(2, 80)}</p>" for _ in range(self.r.integers(1, 4))) + f"</{t}>")
        inner = "".join(posts)
        return self.title() + (f'<div class="{self.pick("thread", "topic", "posts", "messages")}">{inner}</div>' if self.chance(0.5) else inner)

    def bare(self):
        """A short page without any container."""
        self.style, self.linked = None, self.chance(0.1)
        return (self.title() if self.chance(0.8) else "") + "".join(
            self.pick(f"<p>{self.prose(2, 40)}</p>", f"<p>{self.prose(2, 40)}</p>", self.prose(2, 40) + "<br><br>", f"<div>{self.prose(2, 40)}</div>", self.passage(40))
            for _ in range(self.r.integers(1, 6)))

    def page(self):
        before = [k for k, p in (("header", 0.5), ("menu", 0.7), ("notice", 0.25), ("ad", 0.45), ("form", 0.15), ("side", 0.2)) if self.chance(p)]
        after = [k for k, p in (("share", 0.25), ("side", 0.35), ("comment", 0.4), ("ad", 0.25), ("form", 0.25), ("menu", 0.15),
                                ("notice", 0.15), ("footer", 0.8)) if self.chance(p)]
        form = self.r.random()
        matter = self.bare() if form < 0.1 else self.thread() if form < 0.18 else self.article()
        if form < 0.06 or 0.18 < form < 0.22:  # hardly anything around it
            before, after = before[:1] if self.chance(0.3) else [], after[-1:] if self.chance(0.4) else []
        first, last = ("".join(map(self.furniture, kinds)) for kinds in (before, after))
        if 0.22 < form < 0.28:  # laid out by a table
            cut = int(self.r.integers(0, 2))
            body = f"<table><tr><td>{first if cut else ''}</td><td>{'' if cut else first}{matter}</td></tr><tr><td>{last}</td></tr></table>"
        else:
            body = first + matter + last
        return f"<html><head><title>x</title></head><body>{body}</body></html>"


def training_pages(n: int, seed: int):
    """Feature vectors and labels of generated pages."""
    write = _Writer(np.random.default_rng(seed))
    xs, ys = [], []
    for _ in range(n):
        found = blocks(write.page())
        if found:
            xs.append(describe([(p, t.replace(_CONTENT, "") or "x", a) for p, t, a in found]))
            ys.append(np.array([_CONTENT in t for _, t, _ in found], np.float32))
    return xs, ys


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    xs, ys = training_pages(pages, 11)
    net, rng = Labeller(), np.random.default_rng(3)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}  # of the last half of the steps
    step, batch = 0, 32
    order = np.argsort([len(x) for x in xs], kind="stable")
    starts = np.arange(0, len(xs), batch)
    for epoch in range(epochs):
        for at in rng.permutation(starts):
            take = order[at: at + batch]
            steps = max(len(xs[k]) for k in take)
            x, mask = _padded([xs[k] for k in take], steps)
            x[..., :PATH_DIM + WORD_DIM] *= rng.random(x[..., :PATH_DIM + WORD_DIM].shape, np.float32) > 0.1
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(take):
                y[: len(ys[k]), j] = ys[k]
            step += 1
            rate = 0.02 * (1 - step / (epochs * len(starts) + 1)) + 0.0005
            for k, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
            if epoch >= epochs // 2:
                for k, v in net.p.items():
                    mean[k] += v
    seen = (epochs - epochs // 2) * len(starts)
    if seen:
        net.p = {k: v / np.float32(seen) for k, v in mean.items()}
    return net


def main_text(pages: list[str | None], net: Labeller) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    kept = net.label([describe(f) for f in found])
    return ["\n\n".join(t for (_, t, _), k in zip(f, keep) if k) for f, keep in zip(found, kept)]


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages with ``text`` and ``n_chars`` in place of the html (and of columns of those names)."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    source = pages.select(F.col(f"`{html_col}`").alias("t"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"))
    net = pages.sparkSession.sparkContext.broadcast(trained())  # about 200 KB

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = main_text(part.column(0).to_pylist(), net.value)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=["r", "text", "n_chars"])

    inner = source.schema["r"].dataType.simpleString()
    return source.mapInArrow(run, f"r {inner}, text string, n_chars long").select("r.*", "text", "n_chars")
