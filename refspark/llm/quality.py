"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

Trees are grown by histograms on the logistic loss, with monotonic constraints on chosen statistics, and flattened into
numpy node arrays, so a batch of documents goes down all trees together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, text_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 8

#: The statistics, and +1 where more of it may only raise the score for low quality (0: free).
FEATURES = {
    "log_words": 0, "word_chars": 0, "symbols": 1, "dup_lines": 1, "repeat_words": 1, "upper": 1, "digits": 0, "punct": 0,
    "pipes": 1, "bangs": 1, "distinct": 0, "line_words": 0, "top_word": 1, "run": 1,
}


def statistics(text: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and FEATURES in order."""
    words = text.split()  # at \x20 and \x09-\x0D
    n = len(words)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(count.sum() - count[0x80:0xC0].sum())
    word_chars = points - int(count[list(SPACES)].sum())
    n_symbols = int(count[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = repeat_words(seq, len(ids))
    some = max(n, 1)
    chars = max(word_chars, 1)
    features = [
        math.log1p(n), word_chars / some, n_symbols / some, dup / max(len(lines), 1), repeated / some, float(count[65:91].sum()) / chars, float(count[48:58].sum()) / chars,
        float(count[33:48].sum() + count[58:65].sum()) / chars, float(count[124]) / some, float(count[33]) / some, len(ids) / some ** 0.75, min(n / max(len(lines), 1), 200.0),
        float(np.bincount(seq).max()) / some if n else 0.0, float((seq[1:] == seq[:-1]).sum()) / some,
    ]
    return n, word_chars, n_symbols, dup, repeated, features


def repeat_words(seq: np.ndarray, distinct: int) -> int:
    """Words of seq (numbers below `distinct`) that lie in a window of WINDOW words found twice or more. Exact: windows are numbered by doubling, pairs of equal halves alike."""
    if len(seq) <= WINDOW:
        return 0
    code, size, width = seq, max(distinct, 1), 1
    while width < WINDOW:
        pair = code[:-width] * size + code[width:]
        _, code = np.unique(pair, return_inverse=True)
        if len(_) == len(pair):
            return 0  # shorter windows are all distinct already
        size, width = len(_), 2 * width
    twice = np.bincount(code)[code] > 1
    edge = np.zeros(len(seq) + 1, np.int64)
    edge[: len(twice)] += twice
    edge[WINDOW : WINDOW + len(twice)] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


@dataclass
class Trees:
    """All trees' nodes in flat arrays: feature (-1 at a leaf), threshold (<= goes left), left, right, value; roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; rows and trees advance together, one level a step."""
        out = np.full(len(x), self.start)
        if not len(self.roots) or not len(x):
            return out
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        while True:
            feature = self.feature[at]
            if (feature < 0).all():
                return out + self.value[at].sum(1)
            value = np.take_along_axis(x, np.maximum(feature, 0), 1)
            down = np.where(value <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(feature < 0, at, down)


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for P(y = 1). monotone: +1, -1 or 0 for each column.

    A split on a constrained column must order its children's values that way, and each child is then bounded by their middle,
    so that no deeper split undoes the order. Without rows of both kinds there are no trees, only the constant.
    """
    n = len(y)
    rate_one = (y.sum() + 0.5) / (n + 1.0)
    start = float(np.log(rate_one / (1 - rate_one)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    if not n or y.min() == y.max():
        trees = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros(x.shape, int)
    score = np.full(n, start)

    def add(value: float) -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", value)):
            nodes[k].append(v)
        return len(nodes["value"]) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        leaf = lambda a, b: np.clip(-a / (b + ridge), low, high)
        gain_of = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        at = add(float(leaf(total_g, total_h)) * rate)
        if level == depth:
            return at
        best = (1e-6, -1, -1, 0.0, 0.0)
        own = gain_of(total_g, total_h, leaf(total_g, total_h))
        for j, e in enumerate(edges):
            if not len(e):
                continue
            a = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
            b = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
            k = np.cumsum(np.bincount(binned[rows, j], minlength=len(e) + 1))[:-1]
            u, v = leaf(a, b), leaf(total_g - a, total_h - b)
            gain = gain_of(a, b, u) + gain_of(total_g - a, total_h - b, v) - own
            gain[(k < least) | (len(rows) - k < least) | (monotone[j] * (v - u) < 0)] = -1
            s = int(gain.argmax())
            if gain[s] > best[0]:
                best = (float(gain[s]), j, s, float(u[s]), float(v[s]))
        _, j, s, u, v = best
        if j < 0:
            return at
        middle = (u + v) / 2
        l_low, l_high, r_low, r_high = low, high, low, high
        if monotone[j] > 0:
            l_high, r_low = middle, middle
        elif monotone[j] < 0:
            l_low, r_high = middle, middle
        go = binned[rows, j] <= s
        nodes["feature"][at], nodes["threshold"][at] = j, float(edges[j][s])
        nodes["left"][at] = grow(rows[go], g, h, l_low, l_high, level + 1)
        nodes["right"][at] = grow(rows[~go], g, h, r_low, r_high, level + 1)
        return at

    def flat(own: list[int]) -> Trees:
        return Trees(np.array(nodes["feature"], np.int64), np.array(nodes["threshold"]), np.array(nodes["left"], np.int64), np.array(nodes["right"], np.int64), np.array(nodes["value"]), np.array(own, np.int64), 0.0)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, 0))
        score += flat(roots[-1:]).score(x)
    model = flat(roots)
    model.start = start
    return model


STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns `keep`, STATS and `features`."""

    def make():
        def work(batch):
            rows = [statistics(t) for t in text_bytes(batch.column(text))]
            return [list(c) for c in zip(*rows, strict=True)]

        return work

    return map_columns(docs, [text], keep, f"{STATS}, features array<double>", make)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most_rows: int = 8000) -> Trees:
    """Trees for P(quality = 0), from at most most_rows labelled documents: those whose ids have the smallest hashes.

    Labels with a null id or quality are left out; contradicting labels of one document both count. The sample's statistics, some
    kilobytes a hundred rows, are what the driver gets.
    """
    known = labels.select(F.col(doc_id).alias("__id"), "quality").filter("__id is not null and quality is not null")
    sample = known.orderBy(F.xxhash64("__id", F.lit(17)), "__id", "quality").limit(most_rows)
    own = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(sample), "__id")
    rows = features(own, ["__id", "quality"]).select("__id", "quality", "features").collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    x = np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES))
    return fit_trees(x, np.array([r[1] == 0 for r in rows], float), np.array(list(FEATURES.values())))


def assess(docs: DataFrame, model: Trees, keep: list[str] | None = None, text: str = "text", reject: float = 0.5) -> DataFrame:
    """docs (or its columns `keep`) with STATS, base_failed, low_quality (the trees' probability) and kept, without a shuffle.

    Null and empty texts have no words, so they fail the base rules. kept is false if those fail or low_quality is over `reject`.
    Columns of docs that have a result's name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch):
            rows = [statistics(t) for t in text_bytes(batch.column(text))]
            low = 1 / (1 + np.exp(-shared.value.score(np.array([r[5] for r in rows], float))))
            failed = np.array([base_failed(r[0], r[4]) for r in rows])
            return [*[list(c) for c in list(zip(*rows, strict=True))[:5]], pa.array(failed), pa.array(low), pa.array(~failed & (low <= reject))]

        return work

    return map_columns(docs, [text], docs.columns if keep is None else keep, f"{STATS}, base_failed boolean, low_quality double, kept boolean", make)


def quality_digest(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The row of each document that op3's contract asks for, with the score."""
    return assess(docs, train(docs, labels, doc_id), [doc_id])
