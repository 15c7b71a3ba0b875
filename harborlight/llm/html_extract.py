"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: its block elements, and a leaf for every run of text in one. Each node is content (its text, or some
text below it, belongs to the article) or not. Node potentials come from a logistic model of tags, class and id words,
links and lengths; parent-child potentials connect the DOM. Sum-product messages go upward and downward once, and leaves
whose marginal is above one half are the text. Both kinds of potentials are trained from labelled pages
(:mod:`.html_training`).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_training
from .common import map_arrow
from .wordscan import texts

# Element names by their role in HTML.
BLOCKS = frozenset(
    "html body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption form fieldset legend address details summary dialog center hgroup search menu noscript".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp template".split())
#: Skipped elements that a page may forget to close: then they end at the next block. The first ones may hold one another.
NESTING = frozenset("svg math object noscript".split())
FORGETTABLE = NESTING | frozenset("select button datalist audio video canvas".split())
SKIPPED = frozenset("head script style textarea iframe noembed noframes template svg math select button datalist object audio video canvas noscript".split())
#: Elements that leave the head open. A noscript of the head ends at its own end tag, unless one of the others comes first.
METADATA = frozenset("html head title meta link base basefont bgsound script style template noframes noscript".split())
_NOSCRIPT_END = re.compile(r"(?i)<(/?noscript|/?head|/?body)\b")
_CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Blocks whose end tags pages do not leave out.
_ALWAYS_CLOSED = BLOCKS - frozenset("html body p li dt dd tr td th thead tbody tfoot caption noscript".split())
_STOP_AT = frozenset("ul ol dl table td th div article section body html blockquote".split())
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"(?i)\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


@dataclass
class Page:
    """Nodes in page order (a parent before its children)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    links: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, words: tuple[str, ...] = (), text: str | None = None, links: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.links.append(links)
        return len(self.parent) - 1


def _attribute_words(attrs: str) -> tuple[str, ...]:
    if not attrs or "=" not in attrs:
        return ()
    found = []
    for m in _ATTR.finditer(attrs):
        for w in _PIECE.findall(m[1] or m[2] or m[3] or ""):
            w = w.lower()
            found.append(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w)
    return tuple(dict.fromkeys(found))


def _tags(source: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, is an end tag, attributes) of the tags of a page, without those inside raw text and comments."""
    out, pos, n = [], 0, len(source)
    while pos < n and (m := _MARK.search(source, pos)):
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing and not attrs.endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, pos)
            pos = end.end() if end else n
        out.append((m.start(), pos, name, closing, attrs))
    return out


def _forgotten(tags: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Numbers of the tags that open an element which is never closed, or not before the block around it ends.

    An element that cannot hold its like is not closed either if the next of its kind opens first.
    """
    lost: set[int] = set()
    waiting: list[int] = []  # open blocks and forgettable elements
    open_now: Counter = Counter()
    for i, (_, _, name, closing, attrs) in enumerate(tags):
        if name not in FORGETTABLE and name not in _ALWAYS_CLOSED:
            continue
        if closing:
            while open_now[name]:
                x = waiting.pop()
                other = tags[x][2]
                open_now[other] -= 1
                if other == name:
                    break
                if other in FORGETTABLE:
                    lost.add(x)
        elif not attrs.endswith("/"):
            if open_now[name] and name in FORGETTABLE - NESTING:
                for j in range(len(waiting) - 1, -1, -1):
                    other = tags[waiting[j]][2]
                    if other == name:
                        lost.add(waiting.pop(j))
                        open_now[name] -= 1
                        break
                    if other in BLOCKS:
                        break
            waiting.append(i)
            open_now[name] += 1
    return lost | {x for x in waiting if tags[x][2] in FORGETTABLE}


def parse(source: str) -> Page:
    """The tree of a page. Unclosed and stray tags are mended as browsers do; comments, scripts and the like are left out.

    A button, drawing, player and the like that is never closed ends at the next block (where browsers would let it go on):
    what is left out must not take the rest of the page with it.
    """
    page = Page()
    stack: list[tuple[str, int]] = [("html", page.add(-1, "html"))]
    skip = 0  # depth of skipped elements
    skipped: list[str] = []
    muted = False  # inside an element that was never closed
    in_head = True  # until an end of the head that the page may leave to be understood
    piece: list[str] = []
    linked = 0
    in_link = False

    def flush():
        nonlocal linked
        if piece:
            t = _SPACE.sub(" ", "".join(piece)).strip()
            if t:
                page.add(stack[-1][1], "#text", (), t, min(linked, len(t)))
            piece.clear()
        linked = 0

    def leave_head():
        nonlocal skip, in_head
        if in_head:
            skip, in_head = 0, False
            skipped.clear()

    def say(raw: str):
        nonlocal linked
        if in_head and raw.strip(" \t\n\f\r\ufeff"):
            leave_head()
        if raw and not skip and not muted:
            t = html.unescape(raw) if "&" in raw else raw
            piece.append(t)
            if in_link:
                linked += len(t.strip())

    tags = _tags(source)
    forgotten = _forgotten(tags) if any(t[2] in FORGETTABLE for t in tags) else ()
    pos = 0
    for i, (start, end, name, closing, attrs) in enumerate(tags):
        if start < pos:
            continue
        say(source[pos:start])
        pos = end
        if not name:
            continue
        if in_head and (name in ("body", "html", "br") if closing else name not in METADATA):
            leave_head()
        elif in_head and name == "noscript" and not closing:
            stop = _NOSCRIPT_END.search(source, pos)
            if stop and stop[1].lower() == "/noscript":
                pos = stop.start()
        if name in BLOCKS and name != "noscript":
            muted = False
        if name in RAW and not closing and not attrs.endswith("/"):
            continue
        if name in SKIPPED:
            flush() if name in ("head", "noscript") else None
            if i in forgotten and not in_head and not skip:
                muted = True
            elif not closing and not attrs.endswith("/"):
                skipped.append(name)
                skip += 1
            elif closing and name in skipped:
                while skipped.pop() != name:
                    skip -= 1
                skip -= 1
            continue
        if skip:
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            piece.append(" ")
        elif name == "hr":
            flush()
        elif name in BLOCKS:
            flush()
            if closing:
                for j in range(len(stack) - 1, 0, -1):
                    if stack[j][0] == name:
                        del stack[j:]
                        break
            else:
                while len(stack) > 1:
                    for j in range(len(stack) - 1, 0, -1):
                        if name in _CLOSED_BY.get(stack[j][0], ()):
                            del stack[j:]
                            break
                        if stack[j][0] in _STOP_AT:
                            j = 0
                            break
                    else:
                        j = 0
                    if not j:
                        break
                if name == "html":
                    continue
                stack.append((name, page.add(stack[-1][1], name, _attribute_words(attrs))))
    say(source[pos:])
    flush()
    return page


def node_features(page: Page) -> list[list[str]]:
    """Names of the features of each node; what holds for an ancestor is handed down."""
    above: list[frozenset[str]] = []
    out = []
    for i, tag in enumerate(page.tag):
        p = page.parent[i]
        inherited = above[p] if p >= 0 else frozenset()
        if tag == "#text":
            t = page.text[i]
            share = page.links[i] / len(t)
            f = [
                "leaf",
                f"in={page.tag[p]}",
                f"links={0 if not page.links[i] else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
                f"length={min(8, len(t).bit_length())}",
                f"sentences={sum(1 for _ in islice(_SENTENCE.finditer(t), 3))}",
            ]
            above.append(inherited)
        else:
            f = [f"tag={tag}", *(f"own={w}" for w in page.words[i])]
            above.append(inherited | {f"under={tag}", *(f"within={w}" for w in page.words[i])})
        out.append(f + sorted(inherited))
    return out


@dataclass
class TreeModel:
    weights: dict[str, float]
    bias: float
    #: edges[leaf][parent label][child label]: probability of the child's label.
    edges: tuple

    def potentials(self, page: Page) -> list[float]:
        get = self.weights.get
        out = []
        for f in node_features(page):
            z = self.bias + sum(get(x, 0.0) for x in f)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out

    def marginals(self, page: Page) -> list[float]:
        """Probability that each node is content: one upward and one downward pass of sum-product messages."""
        n = len(page.parent)
        one = self.potentials(page)
        b0, b1 = [1 - p for p in one], list(one)  # node potential times the messages from below
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        kinds = [self.edges[t == "#text"] for t in page.tag]
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = kinds[i]
            m0, m1 = a * b0[i] + b * b1[i], c * b0[i] + d * b1[i]
            s = m0 + m1
            up[i] = m0, m1 = m0 / s, m1 / s
            p = page.parent[i]
            x, y = b0[p] * m0, b1[p] * m1
            s = x + y
            b0[p], b1[p] = x / s, y / s
        # beliefs: potential, messages from below and the message from above
        for i in range(1, n):
            (a, b), (c, d) = kinds[i]
            p = page.parent[i]
            q0, q1 = b0[p] / max(up[i][0], 1e-300), b1[p] / max(up[i][1], 1e-300)  # the parent without this child
            s = q0 + q1
            q0, q1 = q0 / s, q1 / s
            x, y = b0[i] * (q0 * a + q1 * c), b1[i] * (q0 * b + q1 * d)
            s = x + y
            b0[i], b1[i] = (x / s, y / s) if s > 0 else (0.5, 0.5)
        return b1

    def extract(self, source: str) -> str:
        page = parse(source)
        return "\n".join(page.text[i] for i, m in enumerate(self.marginals(page)) if page.tag[i] == "#text" and m > 0.5)


def _labelled(source: str) -> tuple[Page, list[int]]:
    """A training page and its labels: leaves that carry the mark are content, and so is all above them."""
    page = parse(source)
    labels = [0] * len(page.parent)
    for i, t in enumerate(page.text):
        if t is not None and html_training.MARK in t:
            page.text[i] = t.replace(html_training.MARK, "").strip() or "x"
            j = i
            while j >= 0 and not labels[j]:
                labels[j] = 1
                j = page.parent[j]
    return page, labels


def train(pages: list[str], *, ridge: float = 0.3, rounds: int = 25, least: int = 12) -> TreeModel:
    """Node weights by penalised logistic regression (of features seen ``least`` times), edges by smoothed counts."""
    seen: Counter = Counter()
    rows, ys = [], []
    counts = [[[0.5, 0.5], [0.5, 0.5]] for _ in range(2)]
    for source in pages:
        page, labels = _labelled(source)
        for i, f in enumerate(node_features(page)):
            rows.append(f)
            seen.update(f)
            ys.append(labels[i])
            if page.parent[i] >= 0:
                counts[page.tag[i] == "#text"][labels[page.parent[i]]][labels[i]] += 1
    names = {f: j for j, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    x = np.zeros((len(rows), len(names) + 1))
    for i, r in enumerate(rows):
        x[i, [names[f] for f in r if f in names]] = 1
    x[:, -1] = 1
    y = np.array(ys, float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    edges = tuple(tuple(tuple(v / sum(row) for v in row) for row in kind) for kind in counts)
    return TreeModel({k: float(w[j]) for k, j in names.items()}, float(w[-1]), edges)


@lru_cache(maxsize=2)
def default_model(n_pages: int = html_training.PAGES) -> TreeModel:
    return train(html_training.pages(n_pages))


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    * The whole page is read; a null or empty one gives an empty text. Character references are decoded, white space inside
      a block becomes one space, blocks are joined by one newline.
    * Narrow: a page is parsed where it lies, one at a time.
    """
    model = model or default_model()

    def make():
        def one(batch):
            out = [model.extract((t or b"").decode("utf-8", "replace")) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

        return one

    plain = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return map_arrow(plain, make, "page_id long, url string, text string, n_chars long")
