"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

Each block's features are its ancestors' tags and class and id words, and its text's length, punctuation and share of
links. The field is trained on labelled pages, drawn here from page layouts with known roles, and decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag's name ends at white space, a slash or the tag's end.
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: From a place within a tag: what separates attributes, a name, and an equals sign if a value follows.
KEY = re.compile(r"[\s/]*+([^\s/>=]?[^\s/>=]*+)(\s*+=\s*+)?")
BARE = re.compile(r"[^\s>]*+")
#: Elements whose content is no text of the page, with their end tags. Where there is none, the first two run to the end of
#: the page, as in browsers; of the others only the tag is skipped, so that no text is lost.
RAW = ("script", "style")
HIDDEN = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in (*RAW, "textarea", "template", "svg", "iframe", "select")}
NAMED = frozenset(("class", "id", "role"))
WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end tag of an inline element, p or li doesn't reach out of these.
BARRIER = frozenset("article main body table".split())


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]  # features of the ancestors
    linked: float  # share of characters in links
    label: bool


class Scanner:
    """Tags of a page, in one pass. What is searched for in vain is never searched for again, so time is linear in the page."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def attributes(self, at: int) -> tuple[int, list[tuple[str, str]], bool]:
        """(where the tag that is open at `at` ends, its attributes, whether a slash closes it). A quote without its fellow is a sign like others."""
        page, out, n = self.page, [], len(self.page)
        while at < n and page[at] != ">":
            m = KEY.match(page, at)
            key, value, at = m[1], "", m.end()
            if m[2] and at < n:
                if page[at] in "\"'" and (end := self.find(page[at], at + 1)) >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    v = BARE.match(page, at)
                    value, at = v[0], v.end()
            if key:
                out.append((key.lower(), value))
            elif m.end() == m.start():  # nothing of a tag, such as an equals sign
                at += 1
        return min(at + 1, n), out, page[at - 1] == "/"

    def hidden(self, name: str, at: int) -> int:
        """Where the end tag of this element ends, or -1."""
        if name in self.missing:
            return -1
        m = HIDDEN[name].search(self.page, at)
        if not m:
            self.missing.add(name)
        return m.end() if m else -1


def blocks(page: str, known: frozenset[str] | dict | None = None) -> list[Block]:
    """The page's leaf blocks: text between the tags of elements that aren't inline, character references decoded and
    white space (also the non-breaking kind) as one space. Features of ancestors are only those in `known`, if given."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    where: dict[str, list[int]] = defaultdict(list)  # of each element's name the places in the stack
    solid: list[int] = []  # places of elements neither inline nor p
    barriers: list[int] = []
    path: dict[str, int] = {}  # features of the stack and how often they occur
    marked = at = linked = 0
    text: list[str] = []
    scan, n = Scanner(page), len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            if t:
                out.append(Block(t, tuple(path), min(1.0, linked / max(1, sum(map(len, text)))), marked > 0))
            text.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal marked
        if any(x[0] not in INLINE for x in stack[depth:]):
            flush()
        while len(stack) > depth:
            name, own, label = stack.pop()
            where[name].pop()
            marked -= label
            for places in (solid, barriers):
                if places and places[-1] == len(stack):
                    places.pop()
            for f in own:
                path[f] -= 1
                if not path[f]:
                    del path[f]

    def add(t: str) -> None:
        nonlocal linked
        text.append(t)
        if where["a"]:
            linked += len(t)

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            add(page[at:begin])
        if begin >= n - 1:
            if begin < n:
                add("<")
            break
        ch = page[begin + 1]
        if ch in "!?":
            comment = page.startswith("<!--", begin)
            end = scan.find("-->" if comment else ">", begin + 2)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        closing = ch == "/"
        m = NAME.match(page, begin + 1 + closing)
        if not m:
            add("<")
            at = begin + 1
            continue
        name = m[0].lower()
        at, attributes, closed = scan.attributes(m.end())
        if closing:
            if where[name] and not (name in INLINE or name in ("p", "li")) or where[name] and (not barriers or barriers[-1] < where[name][-1]):
                leave(where[name][-1])
            continue
        if name in HIDDEN:
            if not (name == "svg" and closed):
                end = scan.hidden(name, at)
                at = end if end >= 0 else n if name in RAW else at
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE:
            flush()
            ends = {"p"} if name in CLOSES_P else SIBLING.get(name, ())
            last = max((where[e][-1] for e in ends if where[e]), default=-1)
            if last >= 0 and (not solid or solid[-1] <= last):
                leave(last)
        if name in VOID or closed:
            continue
        own, label = {f"tag:{name}"}, False
        for key, value in attributes:
            if key == "data-y":
                label = True
            elif key in NAMED:
                own |= {f"name:{w}" for w in WORD.findall(value.lower())}
        kept = tuple(f for f in sorted(own) if known is None or f in known)
        where[name].append(len(stack))
        if name not in INLINE and name != "p":
            solid.append(len(stack))
        if name in BARRIER:
            barriers.append(len(stack))
        stack.append((name, kept, label))
        marked += label
        for f in kept:
            path[f] = path.get(f, 0) + 1
    flush()
    return out


def features(all_blocks: list[Block]) -> list[list[str]]:
    """Names of a block's features: its ancestors', and of its text the length, stops and links, its place and its neighbours' length."""
    out = []
    sizes = [0, *(min(len(b.text), 2000).bit_length() // 2 for b in all_blocks), 0]
    for i, b in enumerate(all_blocks):
        n = len(b.text)
        stops = sum(map(b.text.count, ".!?,;:"))
        out.append(["bias", *b.path, f"size:{min(n, 2000).bit_length()}", f"linked:{int(b.linked * 4)}", f"stops:{min(stops, 8)}", "first" if i == 0 else "later", f"before:{sizes[i]}", f"after:{sizes[i + 2]}", *(["copyright"] if "©" in b.text else [])])
    return out


class Field(NamedTuple):
    index: dict[str, int]
    weight: np.ndarray  # feature x label
    move: np.ndarray  # label x label


def train(pages: list[str], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3, least: int = 4) -> Field:
    """Maximum likelihood by Adam over all pages; a block is labelled main text if an ancestor has data-y.
    A feature of fewer than `least` pages, such as a name of one page's own, says nothing."""
    seen = [b for b in map(blocks, pages) if b]
    names = [features(b) for b in seen]
    pages_of = Counter(f for page in names for f in {f for block in page for f in block})
    index = {f: i for i, f in enumerate(sorted(f for f, k in pages_of.items() if k >= least))}
    t = max(map(len, seen))
    x, y, on = np.zeros((len(seen), t, len(index)), np.float32), np.zeros((len(seen), t), int), np.zeros((len(seen), t), bool)
    for p, (own, b) in enumerate(zip(names, seen, strict=True)):
        on[p, : len(b)] = True
        for i, block in enumerate(own):
            x[p, i, [index[f] for f in block if f in index]] = 1
            y[p, i] = b[i].label
    w, a = np.zeros((len(index), 2)), np.zeros((2, 2))
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, a)]
    gold, both = np.eye(2)[y] * on[..., None], on[:, 1:] & on[:, :-1]
    moved = np.einsum("pti,ptj->ij", gold[:, :-1] * both[..., None], gold[:, 1:])
    lse = lambda v, axis: np.log(np.exp(v - v.max(axis=axis, keepdims=True)).sum(axis=axis)) + v.max(axis=axis)
    for step in range(1, rounds + 1):
        e = (x @ w) * on[..., None]
        f, r = [e[:, 0]], [np.zeros((len(seen), 2))]
        for i in range(1, t):
            f.append(np.where(on[:, i, None], lse(f[-1][:, :, None] + a, 1) + e[:, i], f[-1]))
        for i in range(t - 1, 0, -1):
            r.append(np.where(on[:, i, None], lse(a + (e[:, i] + r[-1])[:, None, :], 2), r[-1]))
        f, r, z = np.stack(f, 1), np.stack(r[::-1], 1), lse(f[-1], 1)
        node = np.exp(f + r - z[:, None, None]) * on[..., None]
        edge = np.exp(f[:, :-1, :, None] + a + (e + r)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        grads = [np.einsum("ptf,ptl->fl", x, gold - node, optimize=True) - decay * len(seen) * w, moved - edge.sum(axis=(0, 1))]
        for v, g, s in zip((w, a), grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            v += rate * s[0] / (1 - 0.9**step) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return Field(index, w, a)


def decode(field: Field, all_blocks: list[Block]) -> list[bool]:
    """Viterbi: the likeliest labels."""
    index, weight, move = field.index, field.weight.tolist(), field.move.tolist()
    back, s0, s1 = [], 0.0, 0.0
    for i, block in enumerate(features(all_blocks)):
        e0 = e1 = 0.0
        for f in block:
            k = index.get(f)
            if k is not None:
                e0 += weight[k][0]
                e1 += weight[k][1]
        if i:
            a, b, c, d = s0 + move[0][0], s1 + move[1][0], s0 + move[0][1], s1 + move[1][1]
            back.append((b > a, d > c))
            s0, s1 = max(a, b), max(c, d)
        s0, s1 = s0 + e0, s1 + e1
    out = [s1 > s0] if all_blocks else []
    for at in reversed(back):
        out.append(at[out[-1]])
    return out[::-1]


def labelled_pages(n: int = 300, seed: int = 11) -> list[str]:
    """Pages of made-up words in varied layouts, the main text's container marked with data-y."""
    rng = random.Random(seed)
    syllables = "ba ce di fo gu la me ni or pu ra se ti vo za al en is ot um".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda k: " ".join(phrase(3, 18).capitalize() + rng.choice(".... !?") for _ in range(rng.randint(1, k)))
    pick = rng.choice

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(rng.randint(2, k))) + "</ul>"

    def named(tags: str, names: str, inner: str) -> str:
        """Names that tell the role, now and then made-up ones or none."""
        tag, kind = pick(tags.split()), rng.random()
        telling = tag not in ("div", "section", "ul")
        attr = "" if telling and kind < 0.5 or kind < 0.04 else f' {pick(("class", "id"))}="{phrase(1, 2) if kind > 0.85 else pick(names.split())}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def around() -> list:
        para = lambda: pick(("<p>{}</p>", "{}", "<span>{}</span>", "<p>{}<br>")).format(prose(3))
        return [
            lambda: named("nav nav div ul", "nav menu navbar navigation breadcrumb breadcrumbs main-menu top-nav", links(8)),
            lambda: named("header header div", "header masthead banner site-header topbar top", pick((f"<h1>{phrase(1, 4)}</h1>", f"<p>{phrase(2, 6)}</p>", links(5), f'<a href="/">{phrase(1, 3)}</a>'))),
            lambda: named("aside aside div", "sidebar side-bar related widget aside recommended popular trending newsletter", f"<h3>{phrase(1, 3)}</h3>" + pick((links(6), para()))),
            lambda: named("div section", "ad ads advert advertisement sponsored promo sponsor banner-ad adsbox", para()),
            lambda: named("div section", "cookie cookies notice cookie-notice consent gdpr alert cookie-banner notification popup modal", para() + f"<button>{phrase(1, 2)}</button>"),
            lambda: named("form form div", "form search subscribe signup login contact-form", f"<form><label>{phrase(1, 3)}</label><input type=text><button>{phrase(1, 2)}</button>{pick(('', para()))}</form>"),
            lambda: named("section div", "comments comment-list reader-comments discussion comment replies responses disqus", f"<h3>{phrase(1, 2)}</h3>" + "".join(f'<div class="{pick(("comment", "reply", "comment-body"))}"><b>{word()}</b><p>{prose(5)}</p></div>' for _ in range(rng.randint(1, 4)))),
            lambda: named("div div section", "share social share-buttons tags meta byline pagination pager toolbar related-posts", pick((links(4), phrase(1, 6)))),
            lambda: named("footer footer div", "footer site-footer copyright bottom legal colophon", pick((f"<p>&copy; {phrase(1, 5)}</p>", f"&copy; {word()}.example &middot; {prose(2)}", links(6), para()))),
        ]

    def body() -> str:
        out = [f"<h1>{phrase(2, 8)}</h1>"] * (rng.random() < 0.7)
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.62:
                out.append(f"<p>{prose(pick((1, 2, 8)))}</p>")
            elif kind < 0.7:
                out.append(f"<p><b>{prose(2)}<br><p>{prose(3)}</p>")
            elif kind < 0.76:
                out.append(f"<h2>{phrase(1, 5)}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{prose(2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote><p>{prose(3)}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<pre><code>{phrase(2, 9)}</code></pre>")
            elif kind < 0.95:
                out.append(f"<table><tr><th>{word()}</th><td>{phrase(1, 4)}</td></tr></table>")
            else:
                out.append(f"<figure><figcaption>{phrase(2, 8)}</figcaption></figure>" if rng.random() < 0.5 else f'<p>{prose(2)} <a href="/x">{phrase(1, 3)}</a> {prose(2)}</p>')
        return "".join(out)

    pages = []
    for _ in range(n):
        kinds = around()
        pre = [f() for f in rng.sample([*kinds[:6], kinds[7]], rng.randint(0, 4))]
        post = [f() for f in rng.sample(kinds[2:], rng.randint(0, 5))]
        tag, kind = pick(("article", "article", "main", "div", "div", "section")), rng.random()
        told = pick("content main-content post article entry-content post-content story article-body main text".split())
        attr = "" if tag in ("article", "main") and kind < 0.6 or kind < 0.15 else f' {pick(("class", "id"))}="{phrase(1, 3) if kind > 0.7 else told}"'
        main = f"<{tag}{attr}"
        inner = body()
        if rng.random() < 0.25:
            cut = inner.find("<p>", len(inner) // 2)
            if cut > 0:
                # An inset without the mark: closed before, opened anew after.
                inner = inner[:cut] + f"</{tag}>" + rng.choice(kinds[2:])() + main + " data-y=1>" + inner[cut:]
        core = f"{main} data-y=1>{inner}</{tag}>"
        bare = rng.random()
        if bare < 0.15:  # no container at all: blocks of the body itself
            core = re.sub(r"<(p|h1|h2|ul|blockquote|pre|table|figure)>", r"<\1 data-y=1>", inner) if tag not in inner else core
        for _ in range(rng.randint(0, 2)):
            core = f'<{pick(("main", "div", "div"))} {pick(("class", "id"))}="{pick("wrapper container page site layout row column grid".split())}">{core}</{"div"}>'
        if bare < 0.06:
            pages.append(core)
            continue
        pages.append(f"<!DOCTYPE html><html><head><title>{phrase(1, 6)}</title></head><body>{''.join(pre)}{core}{''.join(post)}</body></html>")
    return pages


@lru_cache(1)
def default_field() -> Field:
    return train(labelled_pages())


def main_text(field: Field, page: str) -> str:
    found = blocks(page, field.index)
    return " ".join(b.text for b, y in zip(found, decode(field, found), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (page_id, url, text, n_chars) per row of pages; n_chars in code points.

    A null or empty page has an empty text, and so has one whose blocks are all labelled otherwise. Null and repeated
    ids each give a row; other columns are ignored; an empty table gives an empty one. Rows are worked on apart: no shuffle."""
    model = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                own = b.slice(i, 200)
                out = [main_text(model, x.as_py() or "") for x in own.column("html")]
                yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
