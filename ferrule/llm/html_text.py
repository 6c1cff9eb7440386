"""Main text of web pages: boosted trees over DOM nodes, decoded so that no kept node lies under a dropped one.

The nodes are block elements, and inline elements with a class, id, role or label; other inline markup belongs to the node
around it. The model learns from the pages that name
their parts (an article or main element, class and id names, navigation, footer, ...): such names give the labels of a
bounded sample. Each sampled page is also laid out anew in other ways that pages are built (named and nameless
wrappers, side bars, notices, forms, reader comments), and half of these layouts hide the names, so the trees learn
names, densities, depth and siblings rather than one layout.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.boosting import Boosted, fit
from ferrule.llm.common import drawn, table

#: Pages that the model is fitted on, drawn by hash whatever their length (never over twice as many), and nodes of a page and its layouts, drawn too.
TRAIN_PAGES, TRAIN_NODES = 500, 1500
#: Other layouts of each sampled page.
LAYOUTS = 4
#: Pages whose nodes are scored together.
GROUP = 128
#: Elements by kind.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("button head iframe noscript script select style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = BLOCKS - {"html", "body"}
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav footer aside form header menu dialog".split())
HEADINGS, LISTS, TABLES = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("li ul ol dl dt dd menu".split()), frozenset("table tbody td tfoot th thead tr".split())
#: Words of class, id, role and label names that tell a page's parts.
GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())
BAD_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form header legal login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup promo promotion recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar widget".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in UNSEEN}
#: Elements that hold running text; shares of their own odds and of their like siblings' (the rest is their parent's); log odds that count as out of the question.
PROSE = frozenset("blockquote dd dl dt h1 h2 h3 h4 h5 h6 li ol p pre table ul".split())
OWN, LIKE, FAR = 0.25, 0.4, 2.5
_HASHED = 16
N_FEATURES = 26 + _HASHED
#: Columns that tell names, hidden in half of the training rows.
_NAMED = [*range(17, 23), *range(26, 26 + _HASHED)]


class Page:
    """The block elements of a page in page order: parents come before children."""

    def __init__(self, text: str) -> None:
        self.tag, self.parent, self.depth, self.names = ["#"], [-1], [0], [()]
        self.chars, self.linked, self.marks, self.at = [0], [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []  # (block, text), a None-text piece ends a block
        self.length = max(1, len(text))
        stack, link, pos, n = [0], False, 0, len(text)
        self.open: Counter[str] = Counter()  # open nodes by element
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack they are
        plain: Counter[str] = Counter()  # open inline elements that are no nodes, since the last node of that element
        held: list[int] = []  # what ``plain`` was before each open inline node
        once: set[str] = set()
        unclosed: set[str] = set()  # elements without an end tag from here on
        while pos < n:
            m = _TAG.search(text, pos)
            end = m.start() if m else n
            if end > pos:
                self._text(stack[-1], html.unescape(text[pos:end]), link)
            if not m:
                break
            pos = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing = m[1] or m[4]
            if name == "head":
                continue  # may end without an end tag; what it holds unseen is skipped by itself
            if name in UNSEEN:
                if not closing and not (m[3] or m[6] or "").endswith("/") and name not in unclosed:
                    shut = _CLOSE[name].search(text, pos)
                    if shut:
                        pos = shut.end()
                    elif name in ("script", "style"):  # by HTML's rules the rest is code
                        break
                    else:  # only the tag is skipped
                        unclosed.add(name)
            elif name in BLOCKS:
                self.pieces.append((-1, ""))
                if closing:
                    if self.open[name]:
                        self._close(stack, name)
                    continue
                link = False
                self._imply(stack, name)
                if name in ("html", "body"):
                    if name in once:
                        continue
                    once.add(name)
                self._node(stack, name, _ATTR.findall(m[3] or m[6] or ""), pos)
            elif name == "br":
                self.pieces.append((stack[-1], " "))
            elif name not in VOID and not (m[3] or m[6] or "").endswith("/"):
                if name == "a":
                    link = not closing
                found = _ATTR.findall(m[3] or m[6] or "") if not closing else ()
                if found:
                    self._node(stack, name, found, pos)
                    held.append(plain[name])
                    plain[name] = 0
                elif not closing:
                    plain[name] += self.open[name] > 0
                elif plain[name]:
                    plain[name] -= 1
                elif self.open[name]:
                    self._close(stack, name)
                    plain[name] = held.pop() if held else 0

    def _node(self, stack: list[int], name: str, found: list, pos: int) -> None:
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.depth.append(len(stack))
        self.names.append(tuple(w.lower() for f in found for w in _NAME.findall(" ".join(f))))
        for x in (self.chars, self.linked, self.marks):
            x.append(0)
        self.at.append(pos)
        if name != "hr":
            self.places[name].append(len(stack))
            stack.append(len(self.tag) - 1)
            self.open[name] += 1

    def _close(self, stack: list[int], name: str) -> None:
        """Close the innermost open node of that name, which there is, and all in it."""
        while True:
            tag = self._pop(stack)
            if tag == name:
                break

    def _pop(self, stack: list[int]) -> str:
        tag = self.tag[stack.pop()]
        self.open[tag] -= 1
        self.places[tag].pop()
        return tag

    def _imply(self, stack: list[int], name: str) -> None:
        """Close what a start tag closes: the innermost such element, unless one that holds it off is open in it."""
        shut = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(name, ())
        if name in ENDS_P:
            shut = (*shut, "p")
        if not any(self.open[t] for t in shut):
            return
        stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}.get(name, ("td", "th", "table"))
        top = lambda tags: max((self.places[t][-1] for t in tags if self.open[t]), default=-1)
        if (k := top(shut)) > top(stop):
            while len(stack) > k:
                self._pop(stack)

    def _text(self, node: int, text: str, link: bool) -> None:
        self.pieces.append((node, text))
        size = len(text) - text.count(" ") if text.strip() else 0
        self.chars[node] += size
        self.linked[node] += size * link
        self.marks[node] += sum(map(text.count, ".,;:!?"))

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        own = np.array([self.chars, self.linked, self.marks], float)
        sub = [list(map(float, x)) for x in (self.chars, self.linked, self.marks)]
        nodes, kids, index = [1.0] * n, [0] * n, [0] * n
        good = [float(t in GOOD_TAGS) + sum(w in GOOD_NAMES for w in ws) for t, ws in zip(self.tag, self.names)]
        bad = [float(t in BAD_TAGS) + sum(w in BAD_NAMES for w in ws) for t, ws in zip(self.tag, self.names)]
        over_good, over_bad, before, after, last = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [-1] * n
        for k in range(1, n):
            p = parent[k]
            index[k] = kids[p]
            kids[p] += 1
            over_good[k], over_bad[k] = over_good[p] + good[p], over_bad[p] + bad[p]
            if last[p] >= 0:
                before[k] = self.chars[last[p]]
                after[last[p]] = self.chars[k]
            last[p] = k
        for k in range(n - 1, 0, -1):
            p = parent[k]
            nodes[p] += nodes[k]
            for s in sub:
                s[p] += s[k]
        total, linked, marks = map(np.array, sub)
        nodes, kids, index = map(np.array, (nodes, kids, index))
        up = np.maximum(parent, 0)
        x = np.zeros((n, N_FEATURES), np.float32)
        cols = [
            np.log1p(own[0]), np.log1p(total), linked / np.maximum(total, 1), own[1] / np.maximum(own[0], 1), own[2] / np.maximum(own[0], 1), marks / np.maximum(total, 1),
            np.log1p(nodes), total / nodes, self.depth, index, kids[up], np.log1p(kids), np.log1p(before), np.log1p(after), np.array(self.at) / self.length, total / max(1.0, total[0]), np.log1p(total[up] / nodes[up]),
            good, bad, over_good, over_bad, [t in GOOD_TAGS for t in self.tag], [t in BAD_TAGS for t in self.tag], [t in HEADINGS for t in self.tag], [2 * (t in LISTS) + (t in TABLES) for t in self.tag], [t not in BLOCKS for t in self.tag],
        ]
        for k, c in enumerate(cols):
            x[:, k] = c
        for k, ws in enumerate(self.names):
            for w in ws:
                x[k, 26 + zlib.crc32(w.encode()) % _HASHED] = 1
        return x

    def seeds(self) -> np.ndarray | None:
        """Labels by names: 1 where the subtree holds content text; None where the page names no content."""
        n = len(self.tag)
        in_good, in_bad = np.zeros(n, bool), np.zeros(n, bool)
        for k in range(1, n):
            p = self.parent[k]
            in_good[k] = in_good[p] or self.tag[k] in GOOD_TAGS
            in_bad[k] = in_bad[p] or self.tag[k] in BAD_TAGS or any(w in BAD_NAMES for w in self.names[k])
        own = in_good & ~in_bad & (np.array(self.chars) > 0)
        if not own.any():
            return None
        for k in range(n - 1, 0, -1):
            own[self.parent[k]] |= own[k]
        return own.astype(float)

    def together(self, p: np.ndarray) -> np.ndarray:
        """Chances in which the nameless text blocks of one parent lean on each other: prose is kept or dropped as a whole.

        A block's log odds are mixed with the mean of its like among its siblings, by characters, and with its parent's. Names speak for themselves. Where
        no node of a page is likely, the odds are raised so that the likeliest is, unless it is far from it.
        """
        odds = np.log(np.clip(p, 1e-4, 1 - 1e-4) / np.clip(1 - p, 1e-4, 1))
        plain = np.array([t in PROSE and not ws for t, ws in zip(self.tag, self.names)])
        own = np.flatnonzero(plain)
        if len(own):
            parent, weight = np.array(self.parent)[own], 1.0 + np.array(self.chars, float)[own]
            n = len(self.tag)
            mean = np.bincount(parent, weight * odds[own], n) / np.maximum(np.bincount(parent, weight, n), 1)
            page = np.array([t in ("#", "html", "body") for t in self.tag])
            above = np.where(page[parent], mean[parent], odds[parent])  # what a page as a whole is tells nothing
            odds[own] = OWN * odds[own] + LIKE * mean[parent] + (1 - OWN - LIKE) * above
        # a nameless wrapper around one thing is what that thing is
        inner, holds = [0] * len(self.tag), [c > 0 for c in self.chars]
        for k in range(len(self.tag) - 1, 0, -1):
            if inner[k] > 0 and not self.chars[k] and not self.names[k] and self.tag[k] not in BAD_TAGS:
                odds[k] = odds[inner[k]]
            if holds[k]:
                up = self.parent[k]
                holds[up], inner[up] = True, -1 if inner[up] else k
        text = np.array(self.chars) > 0
        if text.any() and -FAR < (best := odds[text].max()) < 0:
            odds += 1 - best
        return 1 / (1 + np.exp(-odds))

    def decode(self, p: np.ndarray) -> str:
        """Best consistent labels, then the kept blocks' text.

        A dropped node drops all below it; an open node may keep some children and drop others. The labels with the
        largest total log chance are found from the leaves up.
        """
        p = np.clip(p, 0.01, 0.99)
        p[0] = 0.5  # the page itself is no choice
        weight = 1 + np.array(self.chars) / 40
        keep, drop = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
        for k in range(len(p) - 1, 0, -1):
            keep[self.parent[k]] += max(keep[k], drop[k])
            drop[self.parent[k]] += drop[k]
        opened = [True] * len(p)
        for k in range(1, len(p)):
            opened[k] = opened[self.parent[k]] and keep[k] >= drop[k]
        blocks, held = [], []
        for node, text in [*self.pieces, (-1, "")]:
            if node < 0:
                if block := " ".join("".join(held).split()):
                    blocks.append(block)
                held = []
            elif opened[node]:
                held.append(text)
        return "\n\n".join(blocks)


_KEEP, _DROP = "trainkeep", "traindrop"
_WRAPS = ("article", "main", 'div class="post-content"', 'div id="content"', 'section class="entry"', 'div class="story-body"', "div", "div", "div", "section", "section", "td", "body")
_EDGES = ("nav", "header", "footer", "aside", 'div class="menu"', 'div id="sidebar"', 'div class="top-nav"', 'ul class="navbar"', 'ul class="menu"', 'div class="related"', 'div class="breadcrumbs"', 'div id="footer"', 'div class="social-share"', "div")
_WITHIN = ('div class="ad"', 'div class="cookie-notice"', "form", "aside", 'div class="newsletter-signup"', 'p class="notice"', 'div class="promo"')
_INLINE_KEPT = ('span class="highlight"', 'a class="link"', 'em class="term"', 'strong id="key"', 'span class="dropcap"', 'code class="literal"', 'time class="date"', 'span class="caps"')
_INLINE_DROPPED = ('span class="ad"', 'span class="promo"', 'a class="share-link"', 'a class="sponsored"', 'span class="comment-count"', 'small class="notice"', 'label class="newsletter"')
_AFTER = ('div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="replies"')


def laid_out(kept: list[str], other: list[str], rng: np.random.Generator) -> str:
    """A page of the same texts in another layout; its parts carry marks that tell what is content."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rich = pick((0.3, 1.0, 3.0))  # how often the text holds more than paragraphs
    clean = lambda t: html.escape(t[: int(rng.integers(20, 2000))])

    def part(kind: str, inner: str, mark: str) -> str:
        tag, _, attrs = kind.partition(" ")
        named = attrs.replace('="', f'="{mark} ') if attrs else f'class="{mark}"'
        return f"<{tag} {named}>{inner}</{tag}>"

    links = lambda: "".join(f"<li><a href=x>{clean(w)[:30]}</a></li>" for w in pick(other).split()[: int(rng.integers(2, 9))])
    lines = lambda: "".join(f"<p>{clean(pick(other))}</p>" for _ in range(int(rng.integers(1, 4))))
    tag = pick(("p", "p", "p", "div", "li", "blockquote"))
    short = lambda: clean(pick(kept))[: int(rng.integers(8, 90))]

    def content() -> list[str]:
        """Now and then: a heading, a list, a table, a short block, all of the text and none with a name."""
        kind, many = rng.random() / rich, range(int(rng.integers(1, 5)))
        if kind < 0.05:
            level = pick(("h2", "h3", "h4"))
            return [f"<{level}>{short()[:50]}</{level}>"]
        if kind < 0.09:
            return [f"<ul>{''.join(f'<li>{short()}</li>' for _ in many)}</ul>"]
        if kind < 0.13:
            return [f"<table>{''.join(f'<tr><td>{short()}</td><td>{short()[:20]}</td></tr>' for _ in many)}</table>"]
        block = pick(("p", "p", "div"))
        return [f"<{block}>{short()}</{block}>"] if kind < 0.18 else []

    body = [f"<{pick(('h1', 'h2'))}>{clean(kept[0])[:60]}</h1>"] * int(rng.integers(0, 2))
    for text in kept:
        words = clean(text)
        if rng.random() < 0.25:  # a named inline element, of the text or not
            at, to = sorted(int(x) for x in rng.integers(0, len(words) + 1, 2))
            mine = rng.random() < 0.6
            end = min(to, at + 60) if mine else at
            inner = words[at:end] if mine else clean(pick(other))[:80]
            words = words[:at] + part(pick(_INLINE_KEPT if mine else _INLINE_DROPPED), inner, _KEEP if mine else _DROP) + words[end:]
        body.append(f"<{tag}>{words}</{tag}>")
        body += content()
        if rng.random() < 0.08:
            body.append(part(pick(_WITHIN), pick((lines, links))(), _DROP))
    middle = part(pick(_WRAPS), "".join(body), _KEEP)

    def edge() -> str:  # prose without any name around it is taken for content, so it is no edge
        kind = pick(_EDGES)
        return part(kind, (links if kind == "div" else pick((links, links, lines)))(), _DROP)

    out = [edge() for _ in range(int(rng.integers(0, 4)))] + [middle]
    if rng.random() < 0.3:
        out.append(part(pick(_AFTER), "".join(f"<p>{clean(pick(kept))[:150]}</p>" for _ in range(int(rng.integers(1, 6)))), _DROP))
    out += [edge() for _ in range(int(rng.integers(0, 4)))]
    wrapped = "".join(out)
    return f"<html><body>{wrapped}</body></html>" if rng.random() < 0.5 else f'<body><div class="wrap"><div>{wrapped}</div></div></body>'


def _layouts(page: Page, y: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[Page, np.ndarray]]:
    texts = (page.decode(y), page.decode(1 - np.where(np.array(page.chars) > 0, y, 0)))
    kept, other = ([t for t in text.split("\n\n") if t] for text in texts)
    for _ in range(LAYOUTS if kept and other else 0):
        new = Page(laid_out(kept, other, rng))
        n = len(new.tag)
        mark = [0] * n
        for k in range(1, n):
            mark[k] = 1 if _KEEP in new.names[k] else -1 if _DROP in new.names[k] else mark[new.parent[k]]
            new.names[k] = tuple(w for w in new.names[k] if w not in (_KEEP, _DROP))
        label = np.array([m > 0 and c > 0 for m, c in zip(mark, new.chars)])
        for k in range(n - 1, 0, -1):
            label[new.parent[k]] |= label[k]
        yield new, label.astype(float)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> the features and labels of their nodes and of their other layouts, as bytes."""
    for b in batches:
        for order, text in zip(b.column(0).to_pylist(), b.column(1)):
            page, rng = Page(text.as_py()), np.random.default_rng(order % 2**63)
            if (y := page.seeds()) is None:
                continue
            xs, ys = [], []
            for k, (p, label) in enumerate([*_layouts(page, y, rng), *[(page, y)] * LAYOUTS]):
                x = p.features()
                if k % 2 and k < LAYOUTS:
                    x[:, _NAMED] = 0
                xs.append(x)
                ys.append(label)
            x, y = np.concatenate(xs), np.concatenate(ys)
            if len(x) > TRAIN_NODES:
                some = np.sort(rng.choice(len(x), TRAIN_NODES, replace=False))
                x, y = x[some], y[some]
            yield pa.record_batch([pa.array([order]), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["page", "x", "y"])


def train(pages: DataFrame, html_col: str = "html", rows: int = TRAIN_PAGES) -> Boosted:
    """Fit on about ``rows`` pages, drawn by hash, that name their content; of each at most TRAIN_NODES nodes, drawn too.

    None: every node is as likely content as not. Pages are read and laid out in tasks; numbers alone reach the driver.
    """
    own = pages.select(F.col(f"`{html_col}`").alias("whole")).where("whole is not null")
    sample = drawn(own, F.col("whole"), own.count(), rows).select(F.xxhash64("whole").alias("page"), "whole").repartition(12, "page")
    found = sample.mapInArrow(_examples, "page long, x binary, y binary").collect()  # TRAIN_NODES rows of numbers a page at most
    found.sort(key=lambda r: r["page"])
    x = np.frombuffer(b"".join(r["x"] for r in found), np.float32).reshape(-1, N_FEATURES)
    return fit(x, np.frombuffer(b"".join(r["y"] for r in found)))


def extract(pages: DataFrame, model: Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` -> (id, url, text, n_blocks): main text of each whole page.

    Character references are decoded, white space inside a block is one space, blocks are joined by two newlines in page
    order. Elements that end tags leave open end where HTML ends them. A null or empty page has an empty text; one row per row; other columns are not read; an empty table gives an
    empty result.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)  # TREES trees of depth DEPTH
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for at in range(0, b.num_rows, GROUP):
                part = b.slice(at, GROUP)
                group = [Page(x.as_py() or "") for x in part.column(2)]
                xs = [g.features() for g in group]
                p = np.split(m.predict(np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1])
                texts = [g.decode(g.together(q)) for g, q in zip(group, p)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([t.count("\n\n") + bool(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_blocks"])

    return pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(work, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract(pages, train(pages))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks")
