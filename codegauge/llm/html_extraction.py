"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every text block is a node that is content or not; an element is content if any text below
it is.  Node potentials come from tag, attribute cues and text statistics, edge potentials couple parent and child.
Sum-product message passing, once up and once down the tree, gives exact marginals; text blocks with a content
marginal above one half are the page's text.  Weights are trained on labelled pages by the exact likelihood gradient.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.common import slices
from codegauge.llm.html_dom import CONTENT_CUE, CUES, GROUPS, TAG_GROUPS, Tree, parse
from codegauge.llm.html_pages import MARK, labelled_page

TRAINING_PAGES = 400
SEED = 11
SLICE_BYTES = 2 << 20
_NUMBERS = 9
_TEXT_GROUP = TAG_GROUPS["#text"]
# columns of a node's features: own group, group of a text block's element, cues, numbers, 1
NODE_FEATURES = 2 * GROUPS + len(CUES) + 1 + _NUMBERS + 1
_ASIDE_GROUPS = [TAG_GROUPS[t] for t in ("nav", "header", "footer", "aside", "form", "dialog")]
_PARENTS = [[TAG_GROUPS[t] for t in tags] for tags in (
    ("article",), ("main",), ("section",), ("div",), ("p", "h1", "h2", "blockquote", "figure"), ("ul", "li", "table", "tr", "td"),
    ("nav", "header", "footer", "aside", "form", "dialog"))]
# an edge's features: 1; the child is a text block, has a cue other than content, is an element made for other things;
# the parent is the root, has the content cue, has another cue, is of one of the kinds above
EDGE_FEATURES = 7 + len(_PARENTS)


@dataclass
class Forest:
    """Trees of several pages in one array; ``levels`` are the nodes by depth, roots first, siblings side by side, and
    ``heads`` the places in a level where the children of another parent begin."""
    parent: np.ndarray
    features: np.ndarray
    edge: np.ndarray
    levels: list[np.ndarray]
    heads: list[np.ndarray]
    is_text: np.ndarray
    page: np.ndarray

    def upwards(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, heads, parents at the heads) from the deepest level to the children of the roots."""
        for level, heads in zip(reversed(self.levels[1:]), reversed(self.heads[1:])):
            yield level, heads, self.parent[level[heads]]


def forest(trees: list[Tree]) -> Forest:
    sizes = np.array([len(t.parent) for t in trees])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    page = np.repeat(np.arange(len(trees)), sizes)
    raw = np.array([p for t in trees for p in t.parent], dtype=np.int64)
    root = raw < 0
    parent = np.where(root, -1, raw + base[page])
    n = len(parent)
    group = np.array([g for t in trees for g in t.group], dtype=np.int64)
    cues = np.array([c for t in trees for c in t.cues], dtype=np.int64)
    chars = np.array([len(x) for t in trees for x in t.text], dtype=float)
    links = np.array([x for t in trees for x in t.links], dtype=float)
    marks = np.array([x.count(". ") + x.count(", ") + x.endswith((".", "!", "?")) for t in trees for x in t.text], dtype=float)
    is_text = group == _TEXT_GROUP
    depth = np.zeros(n, dtype=np.int64)
    levels, heads, now = [], [], np.flatnonzero(root)
    order = np.argsort(parent, kind="stable")
    ranked = parent[order]
    while len(now):
        levels.append(now)
        heads.append(np.concatenate(([0], np.flatnonzero(np.diff(parent[now])) + 1)))
        low, high = np.searchsorted(ranked, now), np.searchsorted(ranked, now, side="right")
        counts = high - low
        at = np.arange(counts.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        now = order[at]
        depth[now] = len(levels)
    below = np.stack([chars, links, is_text.astype(float)], axis=1)
    for level, head in zip(reversed(levels[1:]), reversed(heads[1:])):
        below[parent[level[head]]] += np.add.reduceat(below[level], head)
    up = np.where(root, np.arange(n), parent)
    whole = below[base[page]]
    place = (np.arange(n) - base[page]) / sizes[page]
    dense = np.minimum(below[:, 1] / (below[:, 0] + 1), 1)
    features = np.zeros((n, NODE_FEATURES))
    features[np.arange(n), group] = 1
    text_nodes = np.flatnonzero(is_text)
    features[text_nodes, GROUPS + group[up[text_nodes]]] = 1
    c = 2 * GROUPS
    for bit in range(len(CUES) + 1):
        features[:, c + bit] = cues >> bit & 1
    c += len(CUES) + 1
    features[:, c:c + _NUMBERS] = np.stack([
        dense, dense * is_text, np.log1p(below[:, 0]) / 5, is_text * np.log1p(chars) / 5, np.log1p(below[:, 2]),
        below[:, 0] / (whole[:, 0] + 1), np.minimum(marks, 5) / 5, place, np.minimum(depth, 8) / 8], axis=1)
    features[:, -1] = 1
    has_cue = (cues & ~(1 << CONTENT_CUE | 1 << CONTENT_CUE + 1)) > 0
    edge = np.stack([
        np.ones(n), is_text, has_cue, np.isin(group, _ASIDE_GROUPS), parent[up] < 0, cues[up] >> CONTENT_CUE & 1, has_cue[up],
        *(np.isin(group[up], kinds) for kinds in _PARENTS)], axis=1).astype(float)
    return Forest(parent, features, edge, levels, heads, is_text, page)


@dataclass
class Weights:
    node: np.ndarray       # NODE_FEATURES
    edge: np.ndarray       # EDGE_FEATURES x parent label x child label


def marginals(f: Forest, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """P(node is content) and P(parent's label, node's label) by one upward and one downward pass, in logarithms."""
    n = len(f.parent)
    local = np.zeros((n, 2))
    local[:, 1] = f.features @ w.node
    couple = np.tensordot(f.edge, w.edge, axes=1)            # n x parent label x child label
    gathered = local.copy()                                  # local evidence and all messages from below
    upward = np.zeros((n, 2))
    for level, heads, parents in f.upwards():
        both = couple[level] + gathered[level][:, None, :]
        message = np.logaddexp(both[:, :, 0], both[:, :, 1])
        upward[level] = message
        gathered[parents] += np.add.reduceat(message, heads)
    downward = np.zeros((n, 2))
    pair = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        up = f.parent[level]
        rest = gathered[up] + downward[up] - upward[level]   # the parent without this child
        both = couple[level] + rest[:, :, None]
        downward[level] = np.logaddexp(both[:, 0], both[:, 1])
        both = both + gathered[level][:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        pair[level] = both / both.sum(axis=(1, 2), keepdims=True)
    belief = gathered + downward
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


def _labels(trees: list[Tree], f: Forest) -> np.ndarray:
    text = [x for t in trees for x in t.text]
    y = np.array([x.startswith(MARK) for x in text]).astype(float)
    for level, heads, parents in f.upwards():
        y[parents] = np.maximum(y[parents], np.maximum.reduceat(y[level], heads))
    return y


def train(pages: list[str], rounds: int = 150, rate: float = 0.15, ridge: float = 2e-4) -> Weights:
    """Maximum likelihood weights for pages whose content blocks begin with ``MARK`` (Adam on exact gradients)."""
    trees = [parse(p, {}) for p in pages]
    f = forest([_unmarked(t) for t in trees])
    y = _labels(trees, f)
    inner = f.parent >= 0
    truth = np.zeros((len(y), 2, 2))
    truth[np.flatnonzero(inner), y[f.parent[inner]].astype(int), y[inner].astype(int)] = 1
    w = Weights(np.zeros(NODE_FEATURES), np.zeros((EDGE_FEATURES, 2, 2)))
    first = [np.zeros_like(w.node), np.zeros_like(w.edge)]
    second = [np.zeros_like(w.node), np.zeros_like(w.edge)]
    for step in range(1, rounds + 1):
        p, pair = marginals(f, w)
        gradients = [f.features.T @ (y - p) / len(y) - ridge * w.node,
                     np.tensordot(f.edge[inner].T, (truth - pair)[inner], axes=1) / len(y) - ridge * w.edge]
        for k, (g, value) in enumerate(zip(gradients, (w.node, w.edge))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            value += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return w


def _unmarked(tree: Tree) -> Tree:
    return Tree(tree.parent, tree.group, tree.cues, [x.removeprefix(MARK) for x in tree.text], tree.links)


@functools.cache
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Weights:
    """Weights from ``pages`` labelled pages."""
    rng = random.Random(seed)
    return train([labelled_page(rng) for _ in range(pages)])


def page_texts(pages: list[str], weights: Weights, known: dict[str, int]) -> list[str]:
    trees = [parse(p, known) for p in pages]
    if not trees:
        return []
    f = forest(trees)
    p, _ = marginals(f, weights)
    keep = (p > 0.5) & f.is_text
    out, start = [], 0
    for tree in trees:
        size = len(tree.parent)
        out.append("\n".join(tree.text[k] for k in np.flatnonzero(keep[start:start + size]).tolist()))
        start += size
    return out


def _extract(weights: Weights):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in slices(batches, "html", SLICE_BYTES):
            texts = page_texts([x or "" for x in batch.column("html").to_pylist()], weights, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return run


def extract_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html; more columns are ignored).

    ``text`` holds the content blocks in page order, one to a line: character references decoded, runs of white
    space made one space (a line break is white space), trimmed.  A page without content, with a null or an empty
    html has an empty text.  Null and repeated ids and urls pass through; an empty table gives no rows.  Broken
    markup is read as far as it goes.
    """
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return known.mapInArrow(_extract(weights or trained()), "page_id long, url string, text string, n_chars long")
