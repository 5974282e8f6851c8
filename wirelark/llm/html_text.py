"""Main text of web pages by a tree-structured graphical model.

Every node of a page's tree (elements with visible text, and texts) has a hidden label: part of the main text or not. A node potential
depends on what can be seen of the node (its element, the words of its class and id, how much text it has and how much of
that are links, how much of the page's text that is, where it stands); a parent-child potential, of each kind of
child, on the labels of both. Messages are passed from the leaves to the root and back (sum-product in logarithms, all trees of a
batch together, one level at a time), which gives the exact marginal of every node. Texts whose marginal is at least
``KEEP`` are the main text.

The weights maximise the likelihood of labelled pages; its gradient is the difference of the labels and the marginals that the same
messages give. The labelled pages are those of ``html_examples`` and a sample of the given table: pages that name their main part
themselves by exactly one ``article`` or ``main`` element, of which what stands in ``nav``, ``aside``, ``footer``, ``form`` or a list of comments is not main
text. The sample is bounded by ``SAMPLE`` pages and ``SAMPLE_CHARS`` characters of each page it takes (longer ones are not taken).

Text: character references are decoded, white space (of any kind) becomes one space, blocks and line breaks are separated by one.
Scripts, styles, comments, form controls and the page's head are no text.

Nulls and edge cases: a null, empty or blank page, and one without tags that holds nothing, has an empty text; a page that is plain text is judged like
any other; unclosed and stray tags are read as browsers do; repeated rows, null ids and urls stay as they are. Extra columns
are left out. An empty table gives an empty result. Very long and very deep pages take time in proportion to their length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wirelark.llm.common import small_batches
from wirelark.llm.html_examples import labelled_pages
from wirelark.llm.html_tree import INLINE, UNSEEN, Tree, parse

KEEP = 0.5
SAMPLE, SAMPLE_CHARS, WRITTEN = 200, 20_000, 600
STEPS, RATE, DECAY = 250, 0.1, 2e-3
LEAST_PAGES = 3
# Elements whose text is not main text when a page names its main part itself.
ASIDE = frozenset("nav aside footer form menu dialog".split())
ASIDE_CUES = frozenset("comment comments ad ads advert advertisement share social related sidebar cookie newsletter promo".split())
KINDS = {"#text": 0, **dict.fromkeys(INLINE, 1), **dict.fromkeys("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption caption".split(), 2)}
OTHER_KIND, N_KINDS = 3, 4
_ENDS = str.maketrans({c: None for c in ".!?;:,。！？、，"})


@dataclass
class Forest:
    """Nodes of many trees: parents (-1: a root), depth and kind of each, and features as pairs of node and name."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    nodes: np.ndarray
    features: list[str]
    #: Number of the node in its own tree.
    origin: np.ndarray
    first: list[int]


def _step(x: float, *limits: float) -> int:
    return sum(x >= limit for limit in limits)


def visible(tree: Tree) -> list[bool]:
    """Which nodes hold visible text."""
    n = len(tree.parent)
    hidden, seen = [False] * n, [False] * n
    for i in range(1, n):
        hidden[i] = hidden[tree.parent[i]] or tree.tag[i] in UNSEEN
    for i in range(n - 1, 0, -1):
        seen[i] = seen[i] or (tree.tag[i] == "#text" and not hidden[i] and not tree.text[i].isspace())
        if seen[i]:
            seen[tree.parent[i]] = True
    return seen


def node_features(tree: Tree, seen: list[bool]) -> list[list[str]]:
    """What can be seen of every node that holds visible text."""
    n = len(tree.parent)
    size, links, marks, start, blocks = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    total = 0
    for i in range(n):
        if i and tree.tag[i] == "a":
            linked[i] = True
        elif i:
            linked[i] = linked[tree.parent[i]]
        start[i] = total
        if tree.tag[i] == "#text" and seen[i]:
            text = tree.text[i]
            size[i] = len(text)
            links[i] = size[i] if linked[i] else 0
            marks[i] = len(text) - len(text.translate(_ENDS))
            total += size[i]
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        size[p] += size[i]
        links[p] += links[i]
        marks[p] += marks[i]
        blocks[p] += blocks[i] + (tree.tag[i] in ("p", "li", "h1", "h2", "h3"))
    block = [0] * n
    made: list[list[str]] = [[] for _ in range(n)]
    for i in range(n):
        tag = tree.tag[i]
        block[i] = i if tag != "#text" and tag not in INLINE else block[tree.parent[i]]
        if not seen[i]:
            continue
        b = block[i]
        middle = (start[i] + size[i] / 2) / max(1, total)
        length = _step(size[b], 12, 30, 60, 120, 250, 500, 1000, 2500)
        link = _step(links[b] / max(1, size[b]), 0.01, 0.2, 0.5, 0.8)
        stops = _step(marks[b] / max(1, size[b]), 0.002, 0.01, 0.02)
        own = "text" if tag == "#text" else "inline" if tag in INLINE else "block"
        found = made[i]
        found.append(f"is {own}")
        if own == "block":
            found += [f"tag {tag}", f"size {length}", f"links {link}", f"size {length} stops {stops}", f"at {_step(middle, 0.03, 0.1, 0.9, 0.97)}"]
            found += [f"share {_step(size[i] / max(1, total), 0.02, 0.1, 0.3, 0.6, 0.95)}", f"blocks {_step(blocks[i], 1, 3, 8)} links {link}"]
        else:
            found += [f"{own} in {tree.tag[b]}", f"{own} of {length}", f"{own} links {link}", f"{own} stops {stops}"]
        found += [f"cue {c}" for c in tree.cues[i] if not c.startswith("data-label-")]
    return made


def forest(trees: list[Tree]) -> Forest:
    """The nodes with visible text of ``trees`` as one forest."""
    parent, depth, kind, nodes, names, origin, first = [], [], [], [], [], [], []
    for tree in trees:
        seen = visible(tree)
        first.append(len(parent))
        place: dict[int, int] = {}
        for i, features in enumerate(node_features(tree, seen)):
            if not seen[i]:
                continue
            at = place[i] = len(parent)
            up = place[tree.parent[i]] if i else -1
            parent.append(up)
            depth.append(depth[up] + 1 if i else 0)
            kind.append(KINDS.get(tree.tag[i], OTHER_KIND))
            origin.append(i)
            nodes.extend([at] * len(features))
            names.extend(features)
    first.append(len(parent))
    return Forest(*(np.array(x, dtype=np.int64) for x in (parent, depth, kind, nodes)), names, np.array(origin, dtype=np.int64), first)


@dataclass
class TreeModel:
    """Weights of features and of (kind of child, label of parent, label of child)."""

    names: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray

    def known(self, name: str) -> int:
        """The number of a feature, or -1. A word of a class that is not known stands for a known word that it begins with."""
        number = self.names.get(name, -1)
        if number < 0 and name.startswith("cue "):
            for end in range(len(name) - 1, 7, -1):
                if (number := self.names.get(name[:end], -1)) >= 0:
                    break
            self.names[name] = number
        return number

    def potentials(self, trees: Forest) -> np.ndarray:
        numbers = np.array([self.known(n) for n in trees.features], dtype=np.int64)
        real = numbers >= 0
        return np.bincount(trees.nodes[real], weights=self.weights[numbers[real]], minlength=len(trees.parent))


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def marginals(trees: Forest, potential: np.ndarray, pairs: np.ndarray, by_level: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The probability of label 1 of every node, and the summed probabilities of (kind, parent label, child label) over all edges."""
    n = len(potential)
    by_level = levels(trees.depth) if by_level is None else by_level
    belief = np.stack([np.zeros(n), potential], axis=1)
    up = np.zeros((n, 2))
    for nodes in reversed(by_level[1:]):
        w, b = pairs[trees.kind[nodes]], belief[nodes]
        up[nodes] = _sum(w[:, :, 0] + b[:, None, 0], w[:, :, 1] + b[:, None, 1])
        np.add.at(belief, trees.parent[nodes], up[nodes])
    down = np.zeros((n, 2))
    edges = np.zeros((N_KINDS, 2, 2))
    for nodes in by_level[1:]:
        parent = trees.parent[nodes]
        rest = belief[parent] + down[parent] - up[nodes]
        joint = rest[:, :, None] + pairs[trees.kind[nodes]]
        down[nodes] = _sum(joint[:, 0], joint[:, 1])
        joint = joint + belief[nodes][:, None]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        np.add.at(edges, trees.kind[nodes], joint / joint.sum(axis=(1, 2), keepdims=True))
    both = belief + down
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), edges


def learned(trees: Forest, labels: np.ndarray, least: int = LEAST_PAGES, steps: int = STEPS) -> TreeModel:
    """Weights of greatest likelihood for the ``labels`` of the nodes. Features of fewer than ``least`` trees are left out."""
    tree_of = np.searchsorted(np.array(trees.first), trees.nodes, side="right")
    pages = Counter(name for name, _ in set(zip(trees.features, tree_of.tolist(), strict=True)))
    names = {name: i for i, name in enumerate(sorted(n for n, c in pages.items() if c >= least))}
    numbers = np.array([names.get(n, -1) for n in trees.features], dtype=np.int64)
    nodes, numbers = trees.nodes[numbers >= 0], numbers[numbers >= 0]
    n, size = len(labels), len(names)
    inner = trees.parent >= 0
    seen_edges = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen_edges, (trees.kind[inner], labels[trees.parent[inner]], labels[inner]), 1)
    parameters = np.zeros(size + N_KINDS * 4)
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    by_level, count = levels(trees.depth), max(1, len(trees.first) - 1)
    for step in range(1, steps + 1):
        weights, pairs = parameters[:size], parameters[size:].reshape(N_KINDS, 2, 2)
        potential = np.bincount(nodes, weights=weights[numbers], minlength=n)
        probable, edges = marginals(trees, potential, pairs, by_level)
        slope = np.bincount(numbers, weights=(labels - probable)[nodes], minlength=size)
        gradient = np.concatenate([slope, (seen_edges - edges).ravel()]) / count - DECAY * parameters
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        parameters = parameters + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return TreeModel(names, parameters[:size], parameters[size:].reshape(N_KINDS, 2, 2))


def marked(tree: Tree) -> list[bool] | None:
    """Which nodes belong to the main text by marks (see ``html_examples``), or else by the page's own names; None if it has neither."""
    n, by_mark = len(tree.parent), any("data-label-main" in c for c in tree.cues)
    mains = [i for i in range(n) if tree.tag[i] == "article"] or [i for i in range(n) if tree.tag[i] == "main"]
    if not by_mark and len(mains) != 1:
        return None
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[tree.parent[i]]
        if by_mark:
            inside[i] = (inside[i] or "data-label-main" in tree.cues[i]) and "data-label-not" not in tree.cues[i]
        else:
            inside[i] = (inside[i] or i == mains[0]) and not (tree.tag[i] in ASIDE or ASIDE_CUES.intersection(tree.cues[i]))
    return inside


def node_labels(tree: Tree, main: list[bool]) -> list[int]:
    """The labels of the nodes with visible text."""
    return [int(m) for m, seen in zip(main, visible(tree), strict=True) if seen]


def fitted(pages: DataFrame | None, sample: int = SAMPLE, written: int = WRITTEN) -> TreeModel:
    """The model learned from ``written`` pages of ``html_examples`` and from up to ``sample`` of ``pages`` that name their main part themselves.

    The sample is the pages with the least hashes of their text, equal ones once, so reruns agree. The hashes are ranked first (``sample`` numbers a
    task), then at most ``sample`` times ``SAMPLE_CHARS`` characters reach the driver.
    """
    found = labelled_pages(written)
    if pages is not None:
        names_itself = F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= SAMPLE_CHARS)
        hashed = pages.where(names_itself).select("html", F.xxhash64("html").alias("hash"))
        least = [r[0] for r in hashed.groupBy("hash").count().orderBy("hash").limit(sample).collect()]
        chosen = hashed.where(F.col("hash").isin(least)).groupBy("hash").agg(F.min("html").alias("html"))
        found += [r[0] for r in chosen.orderBy("hash").select("html").collect()]
    trees, labels = [], []
    for tree in map(parse, found):
        if (main := marked(tree)) is not None:
            trees.append(tree)
            labels.extend(node_labels(tree, main))
    return learned(forest(trees), np.array(labels, dtype=np.int64))


def main_texts(pages: list[str], model: TreeModel, keep: float = KEEP) -> list[str]:
    """The main text of each page."""
    trees = [parse(p) for p in pages]
    nodes = forest(trees)
    probable, _ = marginals(nodes, model.potentials(nodes), model.pairs)
    out = []
    for number, tree in enumerate(trees):
        a, b = nodes.first[number], nodes.first[number + 1]
        kept = {i for i, p in zip(nodes.origin[a:b].tolist(), probable[a:b].tolist(), strict=True) if p >= keep}
        pieces = []
        for i, tag in enumerate(tree.tag):
            if tag == "#text" and (i in kept or tree.text[i].isspace()):
                pieces.append((" " if tree.apart[i] else "") + tree.text[i])
            elif tag == "#text" and tree.apart[i]:
                pieces.append(" ")
        out.append(" ".join("".join(pieces).split()))
    return out


def extracted(pages: DataFrame, model: TreeModel) -> DataFrame:
    """``page_id``, ``url`` and ``text``, the main text of ``html``, of every row of ``pages``."""
    small_batches(pages.sparkSession)
    own = pages.select("page_id", "url", "html")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, texts, some, size = batch.column(2).to_pylist(), [], [], 0
            for page in html:
                some.append(page or "")
                size += len(some[-1])
                if size > 1 << 18:
                    texts.extend(main_texts(some, model))
                    some, size = [], 0
            texts.extend(main_texts(some, model))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return own.mapInArrow(of, StructType(own.schema.fields[:2]).add("text", "string"))


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    return extracted(pages, fitted(pages)).withColumn("n_chars", F.length("text").cast("long"))


#: For pages that name their main part by one ``article`` element without other parts in it, as those of the given table do.
ORACLE = """
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS inner_html FROM pages),
plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM articles),
decoded AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS t
  FROM plain)
SELECT page_id, url, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS BIGINT) AS n_chars
FROM decoded
"""
