"""Toxicity by a classifier chain of linear models over hashed word features.

The labels only say toxic or not, so the categories are found: the toxic documents of the sample are parted into KINDS by the words that
mark them as toxic (spherical k-means). Categories are predicted one after another, toxic itself last. Each link is a logistic regression over the text's hashed words and word beginnings
and over the probabilities of all earlier categories; for training those are out-of-fold predictions, so a link learns
from earlier probabilities such as it will meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, text_bytes

BITS = 18
#: Beginnings of so many bytes are features besides whole words: they reach inflected and compound forms.
STARTS = (4, 5)
#: Word characters as in decontamination: A-Z is folded; other ASCII but digits parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
#: Categories that toxic documents are parted into.
KINDS = 2


class Hasher:
    """Sorted distinct feature numbers of a text; a word's are remembered, up to `limit` words."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.limit = limit

    def __call__(self, text: bytes) -> np.ndarray:
        known, out = self.known, []
        for w in set(text.translate(_FOLD).split()):
            got = known.get(w)
            if got is None:
                h = xxhash.xxh32_intdigest
                got = tuple({h(b"w" + w) & ((1 << BITS) - 1), *(h(b"s" + w[:n]) & ((1 << BITS) - 1) for n in STARTS if len(w) > n)})
                if len(known) >= self.limit:
                    known.clear()
                known[w] = got
            out += got
        return np.unique(np.array(out, np.int32))


def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All rows' features one after another, and the row of each."""
    return np.concatenate([*rows, np.empty(0, np.int32)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


@dataclass
class Link:
    """One category's model: a dense weight for each hashed feature, a weight for each earlier probability's log odds, and the intercept."""

    name: str
    weights: np.ndarray
    earlier: np.ndarray
    start: float

    def predict(self, features: np.ndarray, row: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        z = self.start + np.bincount(row, self.weights[features], n) + log_odds(earlier) @ self.earlier
        return 1 / (1 + np.exp(-z))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def telling(features: np.ndarray, row: np.ndarray, n: int, y: np.ndarray) -> np.ndarray:
    """The chi-squared statistic of each hashed feature against y (0 or 1), above 0 if it speaks for y, below if against."""
    seen = np.bincount(features, minlength=1 << BITS).astype(float)
    hits = np.bincount(features, y[row], 1 << BITS)
    rate = y.mean()
    return np.where(seen >= 3, np.sign(hits - seen * rate) * (hits - seen * rate) ** 2 / np.maximum(seen * rate * (1 - rate), 1e-9), 0)


def toxic_kinds(rows: list[np.ndarray], toxic: np.ndarray, kinds: int = KINDS, most_features: int = 1000, steps: int = 20) -> np.ndarray:
    """The kind, 0 to kinds - 1, of each toxic row and -1 of the others: spherical k-means over the features that speak most for toxic.

    The first centre is the row with most of them, each further one the row least like those before; ties go to the earlier row.
    """
    out = np.full(len(rows), -1)
    on = np.flatnonzero(toxic > 0)
    if not len(on) or len(on) == len(rows):
        out[on] = 0
        return out
    chi = telling(*flat(rows), len(rows), toxic)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:most_features])
    chosen = chosen[chi[chosen] > 0]
    x = np.zeros((len(on), len(chosen)), np.float32)
    for k, i in enumerate(on):
        own = np.intersect1d(chosen, rows[i])
        x[k, np.searchsorted(chosen, own)] = np.sqrt(chi[own])
    size = np.linalg.norm(x, axis=1)
    x /= np.maximum(size, 1e-9)[:, None]
    centres = x[[int(size.argmax())]]
    while len(centres) < kinds:
        centres = np.vstack((centres, x[int((x @ centres.T).max(1).argmin())]))
    for _ in range(steps):
        near = (x @ centres.T).argmax(1)
        sums = np.stack([x[near == k].sum(0) for k in range(kinds)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    out[on] = (x @ centres.T).argmax(1)
    return out


def fit_link(name: str, features: np.ndarray, row: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray, most_features: int = 2000, steps: int = 200, ridge: float = 1e-4, least_chi: float = 25.0) -> Link:
    """Logistic regression by Adam; of the features those with the greatest chi-squared statistics, at least least_chi."""
    weights = np.zeros(1 << BITS)
    if not n or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1)
        return Link(name, weights, np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    rate = y.mean()
    chi = np.abs(telling(features, row, n, y))
    chosen = np.sort(np.argsort(-chi, kind="stable")[:most_features])
    chosen = chosen[chi[chosen] > least_chi]
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    on = place[features] >= 0
    column, own = place[features[on]], row[on]
    e = log_odds(earlier)
    k, m = len(chosen), e.shape[1]
    w, mean, square = np.zeros(k + m + 1), np.zeros(k + m + 1), np.zeros(k + m + 1)
    w[-1] = np.log(rate / (1 - rate))
    for step in range(1, steps + 1):  # Adam
        z = np.bincount(own, w[column], n) + e @ w[k : k + m] + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        g = np.concatenate((np.bincount(column, d[own], k) + ridge * w[:k], e.T @ d + ridge * w[k : k + m], [d.sum()]))
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w - 0.1 * min(1.0, 2.0 - 2.0 * step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    weights[chosen] = w[:k]
    return Link(name, weights, w[k : k + m], float(w[-1]))


def fit_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray], folds: int = 4) -> list[Link]:
    """A link for each category in order; row i is of fold i % folds."""
    n = len(rows)
    features, row = flat(rows)
    fold = np.arange(n) % folds
    earlier, chain = np.zeros((n, 0)), []
    for name, y in labels.items():
        chain.append(fit_link(name, features, row, n, earlier, y))
        held_out = np.zeros(n)
        for k in range(folds):
            out = fold == k
            number = np.cumsum(~out) - 1
            on = ~out[row]
            part = fit_link(name, features[on], number[row[on]], int((~out).sum()), earlier[~out], y[~out])
            number = np.cumsum(out) - 1
            held_out[out] = part.predict(features[~on], number[row[~on]], int(out.sum()), earlier[out])
        earlier = np.column_stack((earlier, held_out))
    return chain


def predict_chain(chain: list[Link], rows: list[np.ndarray]) -> np.ndarray:
    """A column of probabilities for each link."""
    features, row = flat(rows)
    p = np.zeros((len(rows), 0))
    for link in chain:
        p = np.column_stack((p, link.predict(features, row, len(rows), p)))
    return p


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most_rows: int = 6000) -> list[Link]:
    """The chain, from at most most_rows labelled documents: those whose ids have the smallest hashes, and of these whole texts.

    Labels with a null id or label are left out; repeated and contradicting ones are each a row, so their document has both. The driver
    gets the sample's feature numbers, some kilobytes a document. Without labels every link is a constant.
    """
    known = labels.select(F.col(doc_id).alias("__id"), F.col("toxic").cast("int").alias("toxic")).filter("__id is not null and toxic is not null")
    sample = known.orderBy(F.xxhash64("__id", F.lit(29)), "__id", "toxic").limit(most_rows)
    own = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(sample), "__id")

    def make():
        hasher = Hasher()

        return lambda batch: [[hasher(t) for t in text_bytes(batch.column("text"))]]

    rows = map_columns(own, ["text"], ["__id", "toxic"], "features array<int>", make).collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[1], r[2]))
    toxic = np.array([float(r[1]) for r in rows])
    features = [np.array(r[2], np.int32) for r in rows]
    kind = toxic_kinds(features, toxic)
    return fit_chain(features, {f"kind_{k + 1}": (kind == k).astype(float) for k in range(KINDS)} | {"toxic": toxic})


def score(docs: DataFrame, chain: list[Link], keep: list[str] | None = None, text: str = "text", least: float = 0.3) -> DataFrame:
    """docs (or its columns `keep`) with p_<category> of every link and toxic (the last probability is `least` or more), without a shuffle.

    Whole texts are read, however long; repeated rows are each scored. Null and empty texts get the links' intercepts alone; an empty
    table gives no rows. Columns of docs with a result's name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    fields = ", ".join(f"p_{link.name} double" for link in chain) + ", toxic boolean"

    def make():
        hasher = Hasher()

        def work(batch: pa.RecordBatch) -> list:
            p = predict_chain(shared.value, [hasher(t) for t in text_bytes(batch.column(text))])
            return [*[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= least)]

        return work

    return map_columns(docs, [text], docs.columns if keep is None else keep, fields, make)


def toxicity_digest(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, each category's probability and toxic of every document."""
    return score(docs, train(docs, labels, doc_id), [doc_id])
