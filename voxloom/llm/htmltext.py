"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags. A bidirectional LSTM in
numpy reads the whole sequence of a page's blocks - hashed tokens of the tag path, hashed words,
and a few measures - and decides for each block whether it belongs to the article. It is trained
on the driver on pages that this module generates from a grammar of layouts, of which every
block's part is known; the parameters travel as arrays. Each page is read whole: its tags in one
pass that takes linear time on any input, its blocks in parts of bounded size, between which the
network's state is carried on.

Defined results: a null or empty html gives an empty text, as does a page without an article;
a null page_id or url stays; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where markup may begin.
OPENING = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*+)")
#: What follows a tag's name. A quoted value, which comes after an equals sign only, may hold any character. Nothing here can be read in two ways.
REST = re.compile(r"(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)?+)*+")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>][^\s<>]*+)))?+")
COMMENT_END = re.compile(r"--!?>")
#: Elements whose content is no text of the page: these end at their own end tag only, or with the page.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: These too, but where their end tag is missing, only the tag itself is passed over.
SKIPPED = frozenset("svg template noscript select".split())
#: Tags inside a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that may stand in a head; any other that starts ends it, as its end and the body's start may be left out.
HEAD = frozenset("html head base basefont bgsound link meta".split())
#: A tag that starts ends an open one of these.
CLOSES = {t: frozenset(o.split()) for t, o in {"li": "li p", "p": "p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "option": "option", **dict.fromkeys("div ul ol table section article aside footer header nav form h1 h2 h3 h4 h5 h6 pre blockquote figure main".split(), "p")}.items()}
BARRIER = frozenset("table ul ol dl div article section aside body main nav footer header form blockquote".split())
PATHS, WORDS, MEASURES = 1024, 512, 6
LETTERS = re.compile(r"[^\W\d_]+")


def path_tokens(tag: str, rest: str) -> frozenset[int]:
    values = tuple(m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest) if m[1].lower() in ("class", "id", "role")) if rest else ()
    return hashed(tag, values) if sum(map(len, values)) < 200 else hashed.__wrapped__(tag, values)


@lru_cache(1 << 14)
def both(above: frozenset[int], own: frozenset[int]) -> frozenset[int]:
    return above | own


class Tags:
    """The tags of a page in one pass; what was scanned once isn't scanned again, whatever the page holds."""

    def __init__(self, page: str):
        self.page = page
        self.ends: dict[str, re.Pattern] = {}
        self.endless: set[str] = set()  # names without an end tag in the rest of the page

    def __iter__(self):
        """(start, end, closing, name, rest) of each tag, name "" for what is left out with all that it holds."""
        page, at = self.page, 0
        while m := OPENING.search(page, at):
            start = m.start()
            if page.startswith("<!--", start):
                short = next((k for k in (">", "->") if page.startswith(k, start + 4)), None)
                end = COMMENT_END.search(page, start + 4)
                at = start + 4 + len(short) if short else end.end() if end else len(page)
                yield start, at, False, "", ""
                continue
            name = NAME.match(page, start + 1)
            if not name:  # a declaration, or an end tag without a name
                at = page.find(">", start) + 1 or len(page)
                yield start, at, False, "", ""
                continue
            rest = REST.match(page, name.end())
            if rest.end() == len(page):  # the page ends within a tag
                yield start, len(page), False, "", ""
                return
            if page[rest.end()] == "<":  # no tag; up to here it is text
                at = rest.end()
                continue
            at, tag = rest.end() + 1, name[2].lower()
            if not name[1] and (tag in RAW or tag in SKIPPED) and not (tag in SKIPPED and rest[0].endswith("/")):
                at = self.after(tag, at)
                yield start, at, False, tag, None
            else:
                yield start, at, bool(name[1]), tag, rest[0]

    def after(self, tag: str, at: int) -> int:
        """Where an element ends whose content starts at `at`."""
        found, depth, to = self.ends.get(tag), 1, at
        if found is None:
            found = self.ends[tag] = re.compile(rf"<(/?){tag}(?=[\s/>])([^>]*+)>", re.I)
        while tag not in self.endless:
            m = found.search(self.page, to)
            if not m:
                self.endless.add(tag)
            elif m[1]:
                depth, to = depth - 1, m.end()
                if depth == 0:
                    return to
            else:
                to = m.end()
                depth += tag in SKIPPED and not m[2].endswith("/")
        return len(self.page) if tag in RAW else at


@lru_cache(1 << 16)
def hashed(tag: str, values: tuple[str, ...]) -> frozenset[int]:
    names = [tag]
    for value in values:
        names += [n for n in re.split(r"[^a-z0-9]+", value.lower()) if n]
    return frozenset(zlib.crc32(n.encode("utf-8", "surrogatepass")) % PATHS for n in names)


def parse(page: str | None) -> list[tuple[str, frozenset[int], frozenset[int], float]]:
    """The blocks: text, hashed tokens of the path, those of its last element, share of the text in links."""
    blocks: list[tuple[str, frozenset[int], frozenset[int], float]] = []
    none: frozenset[int] = frozenset()
    stack: list[tuple[str, frozenset[int], frozenset[int]]] = []  # tag, tokens down to it, its own
    parts: list[str] = []
    linked = links = 0
    head = False

    def end() -> None:
        nonlocal linked
        if parts:
            whole = " ".join("".join(parts).split())
            if whole:
                element = next((e for e in reversed(stack) if e[0] not in INLINE), ("", none, none))
                blocks.append((whole, stack[-1][1] if stack else none, element[2], min(1.0, linked / len(whole))))
            parts.clear()
        linked = 0

    def shut(k: int) -> None:
        nonlocal links
        links -= sum(e[0] == "a" for e in stack[k:])
        del stack[k:]

    at, page = 0, page or ""
    for start, stop, closing, tag, rest in Tags(page):
        if start > at:
            head = head and page[at:start].isspace()  # other text can't stand in a head
            if not head:
                parts.append(html.unescape(page[at:start]))
                linked += links and start - at
        at = stop
        if not tag:
            continue
        if rest is None:  # left out as a whole
            head = head and tag not in ("svg", "textarea", "iframe", "select")  # these can't stand in a head
            continue
        if tag == "head" or (head and not closing and tag not in HEAD):
            head = tag == "head" and not closing
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            end()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    shut(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
        elif tag not in VOID:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(tag, ()):
                    shut(k)
                    break
                if stack[k][0] in BARRIER:
                    break
            own = path_tokens(tag, rest)
            above = stack[-1][1] if stack else none
            stack.append((tag, above if own <= above else both(above, own), own))
            links += tag == "a"
    if at < len(page) and not (head and page[at:].isspace()):
        parts.append(html.unescape(page[at:]))
        linked += links and len(page) - at
    end()
    return blocks


def measures(text: str, link: float, k: int, n: int) -> list[float]:
    stops = sum(map(text.count, ".!?,;"))
    return [np.log1p(len(text)) / 6, link, min(stops, 20) / 20, stops / (1 + text.count(" ")), k / max(1, n - 1), float(link > 0.6)]


def as_arrays(pages: list[list], before: int = 0, total: int | None = None) -> tuple:
    """Padded inputs of pages of blocks: flat token lists with their cells, measures, and the mask.

    A part of one page comes with the number of blocks before it and their total.
    """
    n, width = len(pages), max(map(len, pages))
    mask = np.zeros((n, width))
    some = np.zeros((n, width, MEASURES))
    cells: tuple[list[int], list[int], list[float], list[int], list[int], list[float]] = ([], [], [], [], [], [])
    for i, blocks in enumerate(pages):
        mask[i, : len(blocks)] = 1
        for k, (text, path, last, link) in enumerate(blocks):
            cell = i * width + k
            some[i, k] = measures(text, link, before + k, total or len(blocks))
            tokens = [*path, *(PATHS + t for t in last)]
            cells[0].extend([cell] * len(tokens))
            cells[1].extend(tokens)
            cells[2].extend([1.0] * len(tokens))
            words = {zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in LETTERS.findall(text.lower())}
            cells[3].extend([cell] * len(words))
            cells[4].extend(words)
            cells[5].extend([1.0 / max(1, len(words))] * len(words))
    return tuple(np.array(c) for c in cells), some, mask


class Labeller:
    """Embeddings, an LSTM each way, and a logistic output for each block."""

    def __init__(self, size: int = 16, wide: int = 16, words: int = 6, seed: int = 3):
        r = np.random.default_rng(seed)
        d = wide + words + MEASURES
        self.size = size
        self.p = {"path": r.normal(0, 0.3, (2 * PATHS, wide)), "word": r.normal(0, 0.3, (WORDS, words)), "o": r.normal(0, 0.3, 2 * size + d), "ob": np.zeros(1)}
        for way in "fb":
            self.p |= {f"{way}x": r.normal(0, d**-0.5, (d, 4 * size)), f"{way}h": r.normal(0, size**-0.5, (size, 4 * size)), f"{way}b": np.concatenate([np.zeros(size), np.ones(size), np.zeros(2 * size)])}

    def read(self, inputs: tuple) -> np.ndarray:
        """What the network sees of each block."""
        (pc, pt, pw, wc, wt, ww), some, mask = inputs
        n, width = mask.shape
        path, word = self.p["path"], self.p["word"]
        x = np.zeros((n * width, path.shape[1] + word.shape[1]))
        if len(pc):
            np.add.at(x[:, : path.shape[1]], pc, path[pt] * pw[:, None])
        if len(wc):
            np.add.at(x[:, path.shape[1] :], wc, word[wt] * ww[:, None])
        return np.concatenate([np.tanh(x).reshape(n, width, -1), some], 2)

    def walk(self, way: str, x: np.ndarray, mask: np.ndarray, state: tuple | None = None, trail: list | None = None) -> tuple[np.ndarray, tuple]:
        """The hidden states of one direction, and the last state."""
        n, width = mask.shape
        s = self.size
        gx = x @ self.p[f"{way}x"] + self.p[f"{way}b"]
        h, c = state or (np.zeros((n, s)), np.zeros((n, s)))
        hs = np.zeros((n, width, s))
        for t in range(width) if way == "f" else range(width - 1, -1, -1):
            a = gx[:, t] + h @ self.p[f"{way}h"]
            g = 1 / (1 + np.exp(-np.clip(a[:, : 3 * s], -30, 30)))
            i, f, o, u = g[:, :s], g[:, s : 2 * s], g[:, 2 * s :], np.tanh(a[:, 3 * s :])
            m = mask[:, t : t + 1]
            c2 = m * (f * c + i * u) + (1 - m) * c
            tc = np.tanh(c2)
            h2 = m * (o * tc) + (1 - m) * h
            if trail is not None:
                trail.append((t, h, c, i, f, o, u, tc, m))
            h, c = h2, c2
            hs[:, t] = h
        return hs, (h, c)

    def long_page(self, blocks: list, step: int) -> np.ndarray:
        """run() over one page in parts: the state goes from part to part, and of each block one number stays."""
        n, s = len(blocks), self.size
        raw = np.full(n, self.p["ob"][0])
        starts = range(0, n, step)
        for k, way in enumerate("fb"):
            state = None
            for at in starts if way == "f" else reversed(starts):
                inputs = as_arrays([blocks[at : at + step]], at, n)
                x = self.read(inputs)
                hs, state = self.walk(way, x, inputs[2], state)
                raw[at : at + step] += hs[0] @ self.p["o"][k * s : (k + 1) * s]
                if way == "f":
                    raw[at : at + step] += x[0] @ self.p["o"][2 * s :]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def run(self, inputs: tuple, learn: bool = False) -> tuple:
        mask = inputs[2]
        x = self.read(inputs)
        out, kept = [], {}
        for way in "fb":
            kept[way] = []
            out.append(self.walk(way, x, mask, trail=kept[way] if learn else None)[0])
        z = np.concatenate([*out, x], 2)
        raw = z @ self.p["o"] + self.p["ob"]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30))), x, z, kept

    def gradient(self, inputs: tuple, y: np.ndarray) -> tuple[float, dict]:
        (pc, pt, pw, wc, wt, ww), _, mask = inputs
        p, x, z, kept = self.run(inputs, True)
        n, width = mask.shape
        total, s = mask.sum(), self.size
        d = mask * (p - y) / total
        grad = {"o": np.einsum("nt,ntk->k", d, z), "ob": np.array([d.sum()])}
        dz = d[:, :, None] * self.p["o"]
        dx = dz[:, :, 2 * s :].copy()
        for at, way in enumerate("fb"):
            dhs = dz[:, :, at * s : (at + 1) * s]
            wx, wh = self.p[f"{way}x"], self.p[f"{way}h"]
            gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * s)
            dh, dc = np.zeros((n, s)), np.zeros((n, s))
            for t, h, c, i, f, o, u, tc, m in reversed(kept[way]):
                dh = dh + dhs[:, t]
                new = dh * m
                dct = dc * m + new * o * (1 - tc**2)
                a = np.concatenate([dct * u * i * (1 - i), dct * c * f * (1 - f), new * tc * o * (1 - o), dct * i * (1 - u**2)], 1)
                gx += x[:, t].T @ a
                gh += h.T @ a
                gb += a.sum(0)
                dx[:, t] += a @ wx.T
                dh = dh * (1 - m) + a @ wh.T
                dc = dc * (1 - m) + dct * f
            grad |= {f"{way}x": gx, f"{way}h": gh, f"{way}b": gb}
        wide, words = self.p["path"].shape[1], self.p["word"].shape[1]
        de = dx[:, :, : wide + words].reshape(n * width, -1) * (1 - x[:, :, : wide + words].reshape(n * width, -1) ** 2)
        grad["path"], grad["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        if len(pc):
            np.add.at(grad["path"], pt, de[pc, :wide] * pw[:, None])
        if len(wc):
            np.add.at(grad["word"], wt, de[wc, wide:] * ww[:, None])
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total
        return float(loss), grad

    def fit(self, pages: list[list], labels: list[list[int]], epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                inputs = as_arrays([pages[k] for k in some])
                inputs[0][5][:] *= r.random(inputs[0][5].shape) < r.choice((0.1, 0.5, 1.0))  # no word may decide alone
                y = np.zeros_like(inputs[2])
                for row, k in enumerate(some):
                    y[row, : len(labels[k])] = labels[k]
                _, grad = self.gradient(inputs, y)
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= rate * (0.5 if epoch >= epochs - 2 else 1) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def label(self, pages: list[list], cells: int = 1 << 15) -> list[np.ndarray]:
        """For each page, the chance of each block; pages of similar length share a run."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order and len(pages[order[-1]]) > cells:
            out[order[-1]] = self.long_page(pages[order[-1]], cells)
            order.pop()
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= cells:
                end += 1
            some = order[at:end]
            chance = self.run(as_arrays([pages[k] for k in some]))[0]
            for row, k in enumerate(some):
                out[k] = chance[row, : len(pages[k])]
            at = end
        return out


def generated_page(r: random.Random) -> tuple[list, list[int]]:
    """A page of a random layout: its blocks, and which of them belong to the article.

    Words carry a mark while the page is built, so that each parsed block can be told apart.
    """
    alphabet = "".join(r.sample("abcdefghijklmnopqrstuvwxyzéèüöäßñçó", 16))
    word = lambda: "".join(r.choices(alphabet, k=r.randint(2, 9)))
    hint = {
        "nav": "nav menu navbar navigation breadcrumb breadcrumbs links toc pagination topnav".split(), "header": "header masthead site-header topbar branding logo".split(),
        "footer": "footer colophon site-footer copyright bottom legal".split(), "side": "sidebar aside widget related rail recommended trending popular tags share social".split(),
        "notice": "cookie cookies consent gdpr notice banner alert newsletter popup modal subscribe paywall".split(), "ad": "ad ads advert advertisement sponsor sponsored promo banner adsbox commercial".split(),
        "comments": "comments comment replies reply disqus respond discussion responses".split(), "form": "form search login signup contact subscribe".split(),
    }
    main = "content post entry main story article body text page post-content entry-content article-body".split()
    phrase = {
        "notice": "we use cookies to improve your experience accept all|subscribe to our newsletter|this site uses cookies|wir verwenden cookies|nous utilisons des cookies", "ad": "advertisement|sponsored|buy now|anzeige|publicité|limited offer",
        "comments": "leave a reply|reply|posted by|great post thanks|comments", "footer": "copyright all rights reserved|privacy policy terms|impressum|contact us",
    }

    def words(low: int, high: int, stop: bool = True) -> str:
        some = [word() for _ in range(r.randint(low, high))]
        if r.random() < 0.04:  # figures, signs and years are blocks too
            some = [r.choice(("%d" % r.randint(0, 2100), "***", "%d.%d" % (r.randint(0, 99), r.randint(0, 99)), "---", "$$")) for _ in range(r.randint(1, 4))]
        elif r.random() < 0.06:  # noisy texts belong to articles too
            some = [w + r.choice(("###", "%%%", "&amp;&amp;&amp;", "***", "$$$", "!!")) for w in some]
        elif r.random() < 0.06:
            some = " | ".join(some).split(" ")
        elif r.random() < 0.05:
            some = [r.choice((word(), "the", "le", "of", "von"))] * len(some)
        elif stop:
            some = [w + (r.choice(".,;") if r.random() < 0.12 else "") for w in some]
            some[-1] += "."
        return " ".join(some).capitalize()

    def junk_text(part: str) -> str:
        return r.choice(phrase[part].split("|")) if part in phrase and r.random() < 0.4 else words(1, 30)

    def tagged(part: str, inner: str) -> str:
        native = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}
        tag = native[part] if part in native and r.random() < 0.6 else r.choice(("div", "section", "div"))
        named = tag not in ("nav", "footer", "aside", "form", "header") or r.random() < 0.4
        name = f' {r.choice(("class", "id"))}="{r.choice(hint[part])}{r.choice(("", "", "-box", " wide", "-1"))}"' if named else ""
        return f"<{tag}{name}>{inner}</{tag}>"

    def junk(part: str) -> str:
        if part == "nav":
            items = "".join(f'<li><a href="/{word()}">{words(1, 2, False)}</a></li>' for _ in range(r.randint(2, 9)))
            return tagged(part, f"<ul>{items}</ul>" if r.random() < 0.7 else re.sub("</?li>", " ", items))
        if part == "header":
            return tagged(part, r.choice((f"<h1>{words(1, 4, False)}</h1><p>{words(2, 8)}</p>", f"<div>{words(1, 4, False)}</div>", f'<a href="/">{words(1, 3, False)}</a>')))
        if part == "footer":
            return tagged(part, r.choice((f"&copy; {word()}.example.com &middot; {words(1, 25)}", f"<p>{junk_text(part)}</p>", f'<p>{junk_text(part)}</p><a href="/">{words(1, 3)}</a>')))
        if part == "side":
            return tagged(part, f"<h3>{words(1, 4, False)}</h3>" + "".join(r.choice((f'<li><a href="/x">{words(2, 9, False)}</a></li>', f"<p>{words(3, 30)}</p>")) for _ in range(r.randint(1, 5))))
        if part == "comments":
            each = lambda: f'<{(t := r.choice(("div", "li", "article", "p")))} class="comment">{r.choice((words(3, 60), f"<p>{words(3, 60)}</p>", f"<b>{word()}</b><p>{words(3, 40)}</p>"))}</{t}>'
            return tagged(part, f"<h3>{junk_text(part)}</h3>" + "".join(each() for _ in range(r.randint(1, 5))))
        if part == "form":
            return tagged(part, f"<label>{words(1, 3, False)}</label><input type='text'><button>{words(1, 2, False)}</button>" + (f"<p>{words(2, 15)}</p>" if r.random() < 0.4 else ""))
        return tagged(part, r.choice((junk_text(part), f"<p>{junk_text(part)}</p>", f"<span>{junk_text(part)}</span> <a href='/x'>{words(1, 3)}</a>")))

    def paragraph() -> str:
        kind, some = r.random(), words(1, 12) if r.random() < 0.45 else words(5, 120)
        if r.random() < 0.08:  # what usually stands elsewhere can stand in an article
            some = r.choice("|".join(phrase.values()).split("|")).capitalize() + r.choice((".", "", " " + words(1, 6)))
        if kind < 0.12:
            return f"<p><b>{some}<br>"
        if kind < 0.2:
            return f"<p><a href='/{word()}'>{word()}</a> {some} <em>{word()}</em></p>"
        if kind < 0.26:
            return f"<h2>{words(1, 8, False)}</h2><p>{some}</p>"
        if kind < 0.31:
            return "<ul>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
        if kind < 0.35:
            return f"<blockquote>{some}</blockquote>"
        if kind < 0.38:
            return f"<div>{some}</div>"
        if kind < 0.41:
            return f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>"
        return f"<p>{some}</p>"

    def table_layout(pieces: list[tuple[str, int]]) -> list[tuple[str, int | None]]:
        cell = lambda: f"<td{r.choice(('', '', ' valign=top', ' bgcolor=#eeeeee', ' width=160'))}>"
        links = lambda low, high, between: between.join(f'<a href="/{word()}">{words(1, 2, False)}</a>' for _ in range(r.randint(low, high)))
        menu = lambda: links(2, 7, r.choice((" | ", "<br>", " &middot; ", " ")))
        line = lambda part: f"{r.choice(('', '<font size=1>', '<small>', '<center>'))}{junk_text(part)}"
        out: list[tuple[str, int | None]] = [("<table>", None)]
        for _ in range(r.randint(0, 2)):
            out += [(f"<tr>{cell()}", None), (r.choice((menu, menu, lambda: f"<b>{words(1, 4, False)}</b>", lambda: line("notice")))(), 0), ("</td></tr>", None)]
        out.append(("<tr>", None))
        if r.random() < 0.5:
            out += [(cell(), None), (menu(), 0), ("</td>", None)]
        out += [(cell(), None), *pieces, ("</td>", None)]
        if r.random() < 0.3:
            out += [(cell(), None), (r.choice((menu, lambda: line("ad")))(), 0), ("</td>", None)]
        out.append(("</tr>", None))
        if r.random() < 0.7:
            out += [(f"<tr>{cell()}", None), (r.choice((menu, lambda: line("footer"), lambda: line("footer"), lambda: f"&copy; {word()} {menu()}"))(), 0), ("</td></tr>", None)]
        return [*out, ("</table>", None)]

    inside = "".join(paragraph() for _ in range(r.choice((0, 1, 2, 3, 5, 8, 14, 25))))
    title = f"<h1>{words(1, 12, False)}</h1>" if r.random() < 0.8 else ""
    title = f"<header>{title}<p>{words(1, 6)}</p></header>" if title and r.random() < 0.15 else title
    pieces = [(f"{title}{inside}", 1)]
    if r.random() < 0.25:  # something else within the article
        more = [paragraph() for _ in range(r.randint(1, 4))]
        pieces += [(junk(r.choice(("ad", "side", "notice", "form", "nav"))), 0), ("".join(more), 1)]
    if r.random() < 0.15:
        pieces.append((junk("comments"), 0))
    opened = r.choice(("<article>", "<article>", f'<article class="{r.choice(main)}">', f'<div class="{r.choice(main)}">', f'<div id="{r.choice(main)}">', "<main>", f'<section class="{r.choice(main)}">'))
    if r.random() < 0.08:  # an article in no element of its own
        opened, inside_first = "", words(1, 30) if r.random() < 0.5 else ""
        pieces[0] = (inside_first + pieces[0][0], 1)
    elif r.random() < 0.2:
        opened = r.choice((f'<main id="{r.choice(main)}">', '<div class="wrapper">', f'<div class="{r.choice(main)}">')) + opened
    shut = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))
    before = [p for p in ("header", "nav", "notice", "ad", "form", "nav", "side") if r.random() < 0.35]
    after = [p for p in ("ad", "comments", "side", "form", "notice", "nav", "footer") if r.random() < 0.35]
    if r.random() < 0.35:
        before, after = ["nav", "ad"], ["footer"]
    if r.random() < 0.06:
        pieces = []
    if r.random() < 0.12:  # a layout of tables, whose cells have no names
        parts = table_layout(pieces)
    else:
        parts = [(junk(p), 0) for p in before] + [(opened, None)] * bool(pieces) + pieces + [(shut, None)] * bool(pieces) + [(junk(p), 0) for p in after]
    marked = lambda p: re.sub(r"(^|>)([^<>]+)", lambda m: m[1] + "\x02" + m[2], p)
    page = "<body>" + "".join(p if kind is None else f"{p}" if kind == 0 else marked(p) for p, kind in parts) + r.choice(("</body></html>", ""))
    blocks = parse(page)
    labels = [int("\x02" in b[0]) for b in blocks]
    return [(" ".join(b[0].replace("\x02", " ").split()), *b[1:]) for b in blocks], labels


#: The arrays that trained() finds with its own arguments, made by `python -m voxloom.llm.htmltext`; only the driver reads them.
ARRAYS = Path(__file__).with_name("labeller.npz")


@cache
def trained(pages: int = 1600, seed: int = 17) -> Labeller:
    """The labeller, fitted on so many generated pages; the same for the same arguments. Arrays that were saved for them are read."""
    if ARRAYS.exists():
        with np.load(ARRAYS) as saved:
            if saved["made_of"].tolist() == [pages, seed]:
                model = Labeller()
                model.p = {k: saved[k].astype(float) for k in model.p}
                return model
    return fitted(pages, seed)


def fitted(pages: int, seed: int) -> Labeller:
    r = random.Random(seed)
    made = [p for p in (generated_page(r) for _ in range(pages)) if p[0]]
    model = Labeller()
    model.fit([p for p, _ in made], [y for _, y in made])
    return model


def main_text(pages: list[str | None], model: Labeller) -> list[str]:
    parsed = [parse(p) for p in pages]
    return ["\n".join(b[0] for b, c in zip(blocks, chance, strict=False) if c >= 0.5) for blocks, chance in zip(parsed, model.label(parsed), strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None, rows: int = 256) -> DataFrame:
    """page_id, url, text and n_chars for each row."""
    model = model or trained()

    def of(htmls: pd.Series) -> pd.Series:
        some = htmls.tolist()
        return pd.Series([t for k in range(0, len(some), rows) for t in main_text(some[k : k + rows], model)], dtype=object)

    return pages.select("page_id", "url", F.pandas_udf(of, "string")("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


if __name__ == "__main__":
    np.savez_compressed(ARRAYS, made_of=np.array([1600, 17]), **{k: v.astype(np.float32) for k, v in fitted(1600, 17).p.items()})
