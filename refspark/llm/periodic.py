"""Periodic runs of words, found over a grammar of the texts.

Re-Pair replaces repeated pairs of neighbouring symbols until no pair occurs twice. Here a round replaces, everywhere, each pair that is
more frequent than the pairs overlapping it, so that a round is a few array operations over all texts of an Arrow batch, which share one
grammar. What is left of a text is paired up in a balanced tree. A run lies wholly in some lowest node and crosses the boundary between
its two children. For every rule runs are sought once, around that boundary, in its first place of derivation, and then carried to all
others; those cut short by the end of a node lie in the whole run of the same period, which its own lowest node gives.

Around a boundary: two places q words apart, one of them the boundary, whose matches to the left and to the right make up a run of
`shortest` words or more, agree on three words to one side at least. So the partners are looked up among the places of equal
triples, and the matches are measured by prefix hashes. Each run is checked word by word at the end; should hashes have collided, all is
done again with another base.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, text_bytes

PRIME = (1 << 31) - 1
#: Candidates measured at a time.
CHUNK = 1 << 20


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i as many rows as counts[i]: i, and the row's number among them."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def derive(words: np.ndarray, begins: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The derivation nodes of at least `shortest` words: rule, start, middle and end of each, places in the concatenated texts.

    words: ids from 0; begins: the places at which texts start. Nodes of one rule derive the same words.
    """
    n, known = len(words), int(words.max(initial=-1)) + 1
    sym, pos = words.astype(np.int64), np.arange(n)
    first = np.zeros(n, bool)
    first[begins] = True
    fresh = np.ones(n, bool)  # pairs that may occur twice
    random = np.random.default_rng(1)
    found: list[tuple[np.ndarray, ...]] = []

    def note(rule: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        start, middle, end = pos[at], pos[at + 1], size
        long = end - start >= shortest
        if long.any():
            found.append((rule[long], start[long], middle[long], end[long]))

    while len(sym) > 1:
        at = np.flatnonzero(fresh[:-1] & ~first[1:])
        if not len(at):
            break
        pair, which = np.unique(sym[at] * known + sym[at + 1], return_inverse=True)
        apart = np.ones(len(at), bool)  # of aaa only the first aa counts, of aaaa the first and the third
        same = (np.diff(at) == 1) & (which[1:] == which[:-1])
        if same.any():
            plateau = np.flatnonzero(np.append(True, ~same))
            apart = (np.arange(len(at)) - np.repeat(plateau, np.diff(np.append(plateau, len(at))))) % 2 == 0
        count = np.bincount(which[apart], minlength=len(pair))
        fresh[at[count[which] < 2]] = False
        rank = np.full(len(sym) + 1, -1)
        order = count * len(pair) + random.permutation(len(pair))  # equally frequent pairs by lot, or long repeats would take a round for each word
        rank[at] = np.where(count >= 2, order, -1)[which]
        own = rank[at]
        chosen = np.flatnonzero(apart & (own >= 0) & (own >= rank[at - 1]) & (own >= rank[at + 1]))
        used = np.bincount(which[chosen], minlength=len(pair))
        chosen = chosen[used[which[chosen]] >= 2]
        if not len(chosen):
            break
        name = np.cumsum(used >= 2) - 1 + known
        put, new = at[chosen], name[which[chosen]]
        note(new, put, np.append(pos, n)[put + 2])
        known += int((used >= 2).sum())
        sym[put] = new
        fresh[put] = True
        left = put[put > 0] - 1
        fresh[left] = True
        stay = np.ones(len(sym), bool)
        stay[put + 1] = False
        gone = left[~stay[left]]  # the pair before begins with a symbol that has just been made
        fresh[gone - 1] = True
        sym, pos, first, fresh = sym[stay], pos[stay], first[stay], fresh[stay]
    while not first.all():  # what is left, as a balanced tree of rules that occur once
        head = np.flatnonzero(first)
        place = np.arange(len(pos)) - np.repeat(head, np.diff(np.append(head, len(pos))))
        put = np.flatnonzero((place % 2 == 0) & ~np.append(first[1:], True))
        note(known + np.arange(len(put)), put, np.append(pos, n)[put + 2])
        known += len(put)
        stay = np.ones(len(pos), bool)
        stay[put + 1] = False
        pos, first = pos[stay], first[stay]
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Matches:
    """How far two places of `words` agree, to the right and to the left."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        power = np.ones(n + 1, np.int64)
        done = 1
        step = base
        while done <= n:  # powers 0 .. done - 1 give the next done
            power[done : 2 * done] = power[: min(done, n + 1 - done)] * step % PRIME
            done, step = 2 * done, step * step % PRIME
        code = np.random.default_rng(base).integers(1, PRIME, int(words.max(initial=0)) + 1)
        self.power = power
        self.sum = np.append(0, np.cumsum(code[words] * power[:n] % PRIME)) % PRIME

    def _equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """i < j: whether as many words from i as from j on are equal."""
        s = self.sum
        return (s[i + size] - s[i]) % PRIME * self.power[j - i] % PRIME == (s[j + size] - s[j]) % PRIME

    def right(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        got = np.zeros(len(i), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            on = np.flatnonzero(got + (1 << k) <= most)
            size = np.full(len(on), 1 << k)
            got[on[self._equal(i[on] + got[on], j[on] + got[on], size)]] += 1 << k
        return got

    def left(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        got = np.zeros(len(i), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            on = np.flatnonzero(got + (1 << k) <= most)
            back = got[on] + (1 << k)
            got[on[self._equal(i[on] - back, j[on] - back, np.full(len(on), 1 << k))]] += 1 << k
        return got


def crossing(matches: Matches, order: np.ndarray, key: np.ndarray, group: np.ndarray, node: tuple[np.ndarray, ...], shortest: int) -> tuple[np.ndarray, ...]:
    """node number, start, end and period of the stretches around the middles of nodes (start, middle, end) that nothing in the node extends.

    order: places by triple; group: each place's triple; key: group * (n + 1) + place along order.
    """
    start, middle, end = node
    n, out = len(group), []
    for back in (0, 3):  # the triple after the middle, and the one before
        anchor = middle - back
        at = np.flatnonzero(anchor >= start)
        low = np.searchsorted(key, group[anchor[at]] * (n + 1) + start[at])
        high = np.searchsorted(key, group[anchor[at]] * (n + 1) + end[at])
        at, low, size = at[high - low > 1], low[high - low > 1], (high - low)[high - low > 1]
        for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1):
            which, k = spread(size[some])
            partner, x = order[low[some][which] + k], at[some][which]
            period = np.abs(partner - anchor[x])
            before = partner < anchor[x]
            i = np.where(before, middle[x] - period, middle[x])
            ok = (period > 0) & (i + period <= end[x])
            i, x, period = i[ok], x[ok], period[ok]
            j = i + period
            begin, stop = i - matches.left(i, j, i - start[x]), j + matches.right(i, j, end[x] - j)
            ok = stop - begin >= np.maximum(shortest, 2 * period)
            out.append((x[ok], begin[ok], stop[ok], period[ok]))
    x, begin, stop, period = (np.concatenate(c) for c in zip(*out, strict=True))
    by = np.lexsort((period, stop, begin, x))  # of an interval's periods the smallest
    x, begin, stop, period = x[by], begin[by], stop[by], period[by]
    new = np.append(True, (np.diff(x) != 0) | (np.diff(begin) != 0) | (np.diff(stop) != 0))[: len(x)]
    return x[new], begin[new], stop[new], period[new]


def runs_of(words: np.ndarray, begins: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs in the concatenated texts that start at `begins`, by start, then period."""
    empty = (np.empty(0, np.int64),) * 3
    n = len(words)
    rule, start, middle, end = derive(words, begins, shortest)
    if not len(rule):
        return empty
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # equal triples have equal values; others seldom do, and are found out by measuring
    mixed ^= mixed >> np.uint64(29)
    triple = mixed.copy()
    triple[:-1] += mixed[1:] * np.uint64(0xBF58476D1CE4E5B9)
    triple[:-2] += mixed[2:] * np.uint64(0x94D049BB133111EB)
    order = np.argsort(triple, kind="stable")
    sorted_ = triple[order]
    number = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1])).astype(np.int64)
    group = np.empty(n, np.int64)
    group[order] = number
    key = number * (n + 1) + order
    before, after = np.full(n, -1), np.full(n, n)  # the next places with the same triple
    tied = np.flatnonzero(number[1:] == number[:-1])
    before[order[tied + 1]], after[order[tied]] = order[tied], order[tied + 1]
    by = np.argsort(rule, kind="stable")
    rule, start, middle, end = rule[by], start[by], middle[by], end[by]
    head = np.flatnonzero(np.append(True, rule[1:] != rule[:-1]))  # a rule's first derivation stands for all
    places = np.diff(np.append(head, len(rule)))
    s, m, e = start[head], middle[head], end[head]
    back = np.maximum(m - 3, 0)
    hopeful = (before[m] >= s) | (after[m] < e) | (m - 3 >= s) & ((before[back] >= s) | (after[back] < e))
    head, places, s, m, e = head[hopeful], places[hopeful], s[hopeful], m[hopeful], e[hopeful]
    if not len(head):
        return empty
    for base in range(1_000_003, PRIME, 2_000_006):
        x, begin, stop, period = crossing(Matches(words, base), order, key, group, (s, m, e), shortest)
        if not len(x):
            return empty
        which, k = spread(places[x])
        shift = start[head[x[which]] + k] - s[x[which]]
        begin, stop, period = begin[which] + shift, stop[which] + shift, period[which]
        by = np.lexsort((-stop, begin, period))
        begin, stop, period = begin[by], stop[by], period[by]
        far = stop + np.cumsum(np.append(0, np.diff(period) != 0)) * (n + 1)
        whole = np.append(True, far[1:] > np.maximum.accumulate(far)[:-1])  # others lie in one of the same period
        begin, stop, period = begin[whole], stop[whole], period[whole]
        by = np.lexsort((period, stop, begin))
        begin, stop, period = begin[by], stop[by], period[by]
        least = np.append(True, (np.diff(begin) != 0) | (np.diff(stop) != 0))
        begin, stop, period = begin[least], stop[least], period[least]
        if all(np.array_equal(words[a : b - q], words[a + q : b]) for a, b, q in zip(begin.tolist(), stop.tolist(), period.tolist(), strict=True)):
            by = np.lexsort((period, begin))
            return begin[by], (stop - begin)[by], period[by]
    raise AssertionError("no base without collisions")


RUNS = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", shortest: int = 12, change: Callable[[list, int], np.ndarray | None] | None = None) -> DataFrame:
    """The columns `keep` of docs, n_words, runs (by start, then period) and collapsed, the text without what repeats in runs.

    Words are separated by ASCII white space. A run is a stretch of words with smallest period q and at least max(shortest, 2 q) words that
    neither neighbour extends; a word goes if some run has it after that run's first q words, and the others are joined by single spaces.
    change(the row's values of `keep`, number of words) may give the word numbers that stand for the text. Null and empty texts have no words
    and no runs, repeated rows each have theirs, an empty table gives no rows; other columns of docs aren't read, and a kept column with a
    name of the result is left out. A batch is some megabytes of text, a longer text is a batch of its own.
    """
    if shortest < 6:
        raise ValueError("runs of under six words need not agree on three words beside a boundary")

    def make():
        def work(batch: pa.RecordBatch) -> list:
            rows = [b.split() for b in text_bytes(batch.column(text))]
            if change:
                columns = [batch.column(c).to_pylist() for c in keep]
                for k, row in enumerate(rows):
                    took = change([c[k] for c in columns], len(row))
                    if took is not None:
                        rows[k] = [row[i] for i in took.tolist()]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            begins = np.cumsum(sizes) - sizes
            words = pa.array([w for row in rows for w in row], pa.large_binary()).dictionary_encode().indices.to_numpy()
            start, length, period = runs_of(words, np.unique(begins[sizes > 0]), shortest)
            of = np.searchsorted(begins, start, "right") - 1
            edges = np.searchsorted(of, np.arange(len(rows) + 1))
            local = start - begins[of]
            delta = np.zeros(len(words) + 1, np.int64)
            np.add.at(delta, start + period, 1)
            np.add.at(delta, start + length, -1)
            stays = np.cumsum(delta[:-1]) == 0
            collapsed = []
            for k in range(len(rows)):
                row = rows[k]
                if edges[k] < edges[k + 1]:
                    row = [row[i] for i in np.flatnonzero(stays[begins[k] : begins[k] + sizes[k]]).tolist()]
                collapsed.append(b" ".join(row))
            structs = pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), structs), pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False)]

        return work

    return map_columns(docs, list(dict.fromkeys([text, *keep])), keep, RUNS, make)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """op11's contract: the word numbers of a text of n words after every tenth document (by the CRC of its id) is made periodic from some word on."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def run_digest(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The row of each document that op11's contract asks for. A null doc_id has no CRC, so its text is taken as it is."""
    found = periodic_runs(docs, [doc_id], change=lambda key, n: planted(key[0], n))
    best = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return (
        found.withColumn("best", F.get(best, F.lit(0)))
        .select(
            doc_id, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
            F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
        )
    )
