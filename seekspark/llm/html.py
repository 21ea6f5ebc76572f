"""Operator 8: main-content extraction with gradient-boosted trees over DOM nodes.

A tolerant parser makes a tree of each page; every element gets features of its subtree (text
density, link share, tags), its attribute tokens (log-odds of class and id tokens, learned in training),
its depth, its siblings and its place in the page. Boosted trees give the probability that the
element is to be kept. Decoding then takes the most probable labelling of the whole tree in which no
kept element has a dropped ancestor (an exact two-state dynamic programme from the leaves up), so
choices never contradict each other. The text of kept elements is returned, one line for each block.

Training labels come from the pages of a bounded sample that mark their content with main or article:
what lies inside, or holds it, is kept, the rest dropped. Tag names that carry the label are no
features, so the model also serves pages without such tags.

Defined results: a null page gives null text, an empty one an empty text. Without a labelled page
in the sample everything but scripts, styles and the head is kept. A page that breaks off is read to
its end, and a very long one is read whole. Equal pages, and so repeated rows, give equal text; of equally probable
labellings the one that drops is taken; other columns aren't read. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, least_hashes, pieces, trim

#: Production parameters. SAMPLE bounds the pages that train.
SAMPLE, TREES, DEPTH, RATE, BINS, LEAST = 400, 40, 4, 0.2, 64, 20
_PAGE_CHARS = 2 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_DROPPED = _RAW - {"textarea"} | {"head"}
_BLOCK = frozenset("address article aside blockquote body details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul br".split())
#: Starting one of these ends an open element of the second kind, up to one of the third.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_CLOSES_P = _BLOCK - {"br", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "dt", "dd"}
_CONTENT = frozenset({"main", "article"})
_SPACES = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?]")

FEATURES = ["depth", "children", "siblings", "place", "before", "length", "own", "links", "density", "elements", "marks", "words", "paragraphs", "items", "same", "token", "above", "share", "next_length", "previous_length"]


class Page:
    """Elements in document order: parent, tag, tokens (class and id), and text pieces (element, text)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.tokens = [-1], ["#page"], [[]]
        self.pieces: list[tuple[int, str]] = []
        self.blocks: list[int] = []  # a block's start or end lies before so many pieces
        stack, at = [0], 0
        for m in _TOKEN.finditer(html):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(stack[-1], html[at : m.start()])
            at = m.end()
            name = (m.group(2) or "").lower()
            if not name:
                if m.group().startswith("<![CDATA["):
                    self._text(stack[-1], m.group()[9:].removesuffix("]]>"))
                continue
            if name in _BLOCK:
                self.blocks.append(len(self.pieces))
            if m.group(1):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if name in _CLOSES_P:
                self._end(stack, {"p"}, {"table", "td", "th", "button"})
            if name in _ENDS:
                self._end(stack, *_ENDS[name])
            node = len(self.parent)
            self.parent.append(stack[-1])
            self.tag.append(name)
            own = []
            for a, v in _ATTRIBUTE.findall(m.group(3)):
                if a.lower() in ("class", "id", "role"):
                    own += re.split(r"[\s_-]+", v.strip("\"'").lower())
            self.tokens.append([t for t in own if t])
            if name in _RAW:
                end = re.compile(rf"</{name}\s*>|$(?![\s\S])", re.I).search(html, at)
                if name == "textarea":
                    self._text(node, html[at : end.start()])
                at = end.end()
            elif name not in _VOID and not m.group(3).endswith("/"):
                stack.append(node)
        if at < len(html):
            self._text(stack[-1], html[at:])

    def _text(self, node: int, raw: str) -> None:
        text = _SPACES.sub(" ", unescape(raw))
        if text:
            self.pieces.append((node, text))

    def _end(self, stack: list[int], which: set[str], until: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in which:
                del stack[k:]
                return
            if self.tag[stack[k]] in until:
                return

    def dropped(self) -> np.ndarray:
        """Elements that never have content, and those within."""
        out = np.zeros(len(self.tag), bool)
        for i, (t, p) in enumerate(zip(self.tag, self.parent)):
            out[i] = t in _DROPPED or p >= 0 and out[p]
        return out

    def labels(self) -> np.ndarray | None:
        """True for what lies in main or article or holds one; None without such an element."""
        n = len(self.tag)
        inside = np.zeros(n, bool)
        for i in range(1, n):
            inside[i] = inside[self.parent[i]] or self.tag[i] in _CONTENT
        if not inside.any():
            return None
        for i in range(n - 1, 0, -1):
            if inside[i]:
                inside[self.parent[i]] = True
        return inside

    def features(self, odds: dict[str, float]) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own, marks, words = np.zeros(n), np.zeros(n), np.zeros(n)
        first = np.full(n, -1.0)
        seen = 0
        for i, t in self.pieces:
            k = len(t.strip())
            own[i] += k
            marks[i] += len(_MARKS.findall(t))
            words[i] += t.count(" ") + 1 if k else 0
            if first[i] < 0:
                first[i] = seen
            seen += k
        tags = self.tag
        link = np.array([t == "a" for t in tags])
        for i in range(1, n):
            link[i] |= link[parent[i]]
        sums = np.stack([own, own * link, np.ones(n), marks, words, np.array([t == "p" for t in tags], float), np.array([t == "li" for t in tags], float)])
        depth, children, place = np.zeros(n), np.zeros(n), np.zeros(n)
        token, above = np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            token[i] = sum(odds.get(t, 0.0) for t in self.tokens[i])
            above[i] = above[p] + token[i]
        for i in range(n - 1, 0, -1):
            sums[:, parent[i]] += sums[:, i]
            if first[i] >= 0 and (first[parent[i]] < 0 or first[i] < first[parent[i]]):
                first[parent[i]] = first[i]
        length, links, size, marks, words, paragraphs, items = sums
        brother: dict[tuple[int, str], int] = {}
        last: dict[int, int] = {}
        previous, following = np.zeros(n), np.zeros(n)
        for i in range(1, n):
            brother[parent[i], tags[i]] = brother.get((parent[i], tags[i]), 0) + 1
            if (b := last.get(parent[i])) is not None:
                previous[i], following[b] = length[b], length[i]
            last[parent[i]] = i
        same = np.array([brother.get((parent[i], tags[i]), 1) for i in range(n)], float)
        siblings = children[np.maximum(parent, 0)]
        all_text = max(1.0, length[0])
        per = np.maximum(length, 1)
        return np.stack([depth, children, siblings, (place + 1) / np.maximum(siblings, 1), np.maximum(first, 0) / all_text, np.log1p(length), np.log1p(own), links / per, size / per, np.log1p(size), marks / per, words / per, paragraphs / size, items / size, same, token, above, length / all_text, np.log1p(following), np.log1p(previous)], 1)

    def text(self, kept: np.ndarray) -> str:
        """The text of kept elements, a line for each block."""
        lines, now, breaks = [], [], iter(self.blocks)
        edge = next(breaks, None)
        for k, (i, t) in enumerate(self.pieces):
            if edge is not None and edge <= k:
                lines.append("".join(now))
                now = []
                while edge is not None and edge <= k:
                    edge = next(breaks, None)
            if kept[i]:
                now.append(t)
        lines.append("".join(now))
        return "\n".join(s for x in lines if (s := _SPACES.sub(" ", x).strip()))


def decoded(parent: Sequence[int], p: np.ndarray) -> np.ndarray:
    """The most probable labelling in which an element is kept only if its parent is; the root is kept.

    Parents come before their children. Of equal labellings the one that drops.
    """
    n = len(parent)
    keep, drop = np.log(np.clip(p, 1e-6, 1)), np.log(np.clip(1 - p, 1e-6, 1))
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    out = np.zeros(n, bool)
    out[:1] = True
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] > drop[i]
    return out


class Boosted:
    """Gradient-boosted trees for log-loss: complete trees of DEPTH levels, as arrays."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = LEAST) -> Boosted:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        rate_y = y.mean().clip(1e-3, 1 - 1e-3)
        base = float(np.log(rate_y / (1 - rate_y)))
        f = np.full(n, base)
        inner = (1 << depth) - 1
        feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth))
        for t in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                m, low = 1 << level, (1 << level) - 1
                best = np.full(m, 1e-6)
                for j in range(d):
                    key = node * bins + binned[:, j]
                    G, H, C = (np.bincount(key, w, minlength=m * bins).reshape(m, bins).cumsum(1) for w in (g, h, np.ones(n)))
                    gain = G**2 / (H + 1) + (G[:, -1:] - G) ** 2 / (H[:, -1:] - H + 1) - G[:, -1:] ** 2 / (H[:, -1:] + 1)
                    gain[(C < least) | (C[:, -1:] - C < least)] = 0
                    at = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(m), at] > best).tolist():
                        if at[k] < len(edges[j]):
                            best[k], feature[t, low + k], cut[t, low + k] = gain[k, at[k]], j, edges[j][at[k]]
                node = node * 2 + (x[np.arange(n), feature[t, low + node]] > cut[t, low + node])
            G, H = np.bincount(node, g, minlength=1 << depth), np.bincount(node, h, minlength=1 << depth)
            leaf[t] = rate * G / (H + 1)
            f += leaf[t][node]
        return cls(base, feature, cut, leaf)

    def probability(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for level in range(int(np.log2(len(leaf)))):
                at = (1 << level) - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            f += leaf[node]
        return 1 / (1 + np.exp(-f))


class Extractor:
    def __init__(self, odds: dict[str, float], model: Boosted | None):
        self.odds, self.model = odds, model

    @classmethod
    def trained(cls, pages: Sequence[str]) -> Extractor:
        """From the pages that mark their content."""
        own = [(p, y) for p in map(Page, pages) if (y := p.labels()) is not None]
        if not own:
            return cls({}, None)
        count: dict[str, list[float]] = {}
        for p, y in own:
            for tokens, kept in zip(p.tokens, y.tolist()):
                for t in set(tokens):
                    count.setdefault(t, [1.0, 1.0])[kept] += 1
        odds = {t: float(np.log(c[1] / c[0])) for t, c in count.items() if sum(c) >= 7}
        # what never has content needs no judgement
        use = [(p.features(odds), y, ~p.dropped()) for p, y in own]
        x, y = np.concatenate([f[u][1:] for f, _, u in use]), np.concatenate([y[u][1:] for _, y, u in use])
        return cls(odds, Boosted.fitted(x, y.astype(float)))

    def extract(self, pages: Sequence[str]) -> list[tuple[str, int, int]]:
        """(text, elements kept, elements) of each page."""
        parsed = [Page(p) for p in pages]
        if not parsed:
            return []
        x = [p.features(self.odds) for p in parsed]
        p = self.model.probability(np.concatenate(x)) if self.model else np.full(sum(map(len, x)), 0.75)
        out, at = [], 0
        for page, own in zip(parsed, x):
            q = np.where(page.dropped(), 0.0, p[at : at + len(own)])
            at += len(own)
            kept = decoded(page.parent, q)
            out.append((page.text(kept), int(kept.sum()) - 1, len(kept) - 1))
        return out


def train(pages: DataFrame, sample: int = SAMPLE) -> Extractor:
    """An extractor from at most `sample` different pages, those of least hash."""
    picked = least_hashes(pages.select("html").filter("html IS NOT NULL"), sample).collect()
    return Extractor.trained([r["html"] for r in picked])


def extract_pages(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """(page_id, url, text, n_kept, n_elements) of each page."""
    lean(pages.sparkSession)
    extractor = extractor or train(pages)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            pages = column.to_pylist()
            found: list = []
            for low, high in pieces([len(p or "") for p in pages], _PAGE_CHARS):
                found += extractor.extract([p or "" for p in pages[low:high]])
            trim()
            kinds = [("text", pa.string()), ("n_kept", pa.int32()), ("n_elements", pa.int32())]
            yield pa.array([None if p is None else dict(zip(("text", "n_kept", "n_elements"), f)) for p, f in zip(pages, found)], pa.struct(kinds))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_kept", T.IntegerType()), T.StructField("n_elements", T.IntegerType())])
    found = pages.select("page_id", "url", F.arrow_udf(run, kind).asNondeterministic()("html").alias("found"))
    return found.select("page_id", "url", "found.text", "found.n_kept", "found.n_elements")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
