"""SentencePiece encoding by a max-plus scan, and decoding.

A text's segmentation is the path of greatest total score through the lattice of the vocabulary's pieces; of equally good paths
that whose last piece is longest, then the last but one, and so on. A giant text is cut into chunks of `chunk` characters. A piece
may cross a cut, so a cut has S states: how many characters the piece that crosses it reaches beyond it. Each chunk yields the
S x S matrix of best scores from each entry to each exit state. Matrices combine under (max, +), which is associative, so runs of
FAN are combined in a tree of Spark groups, and going down again gives every cut its vector of best scores. With it each chunk alone
knows, for each exit state, the entry state of its path; following those from the last cut back fixes all states, and each chunk is
traced back alone. The vectors are those of a pass over the whole text, so the ids are the same however a text is cut.

Pieces hold the space mark only at their start, so every path parts before a word: the distinct words of a batch are solved once, all
words of about a length together by array operations.

The scores are log-probabilities under Zipf's law of the pieces' ranks in the model file: those of a file for merges are
ranks and no log-probabilities, and a best path needs the latter. Scores are whole numbers, so no sum is rounded.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_columns

MARK = "▁"
#: Whole-number scores are log-probabilities times this.
UNIT = 1 << 20
FAR = -(1 << 60)
#: Matrices combined in one group.
FAN = 16
#: Bytes of text that are encoded at a time: a worker's arrays take some forty times as much.
TEXT_BYTES = 4 << 20
#: Characters of the longest word solved by array operations, and cells of one such array.
LONG, CELLS = 64, 1 << 17
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


class Vocabulary:
    """Pieces of a SentencePiece file with byte fallback and no normalization but the dummy prefix."""

    def __init__(self, file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        self.piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        special = {i for i in range(len(self.piece)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        plain = sorted((i for i in range(len(self.piece)) if i not in special), key=lambda i: (-sp.get_score(i), i))
        self.score = {self.piece[i]: round(-math.log(k + 2) * UNIT) for k, i in enumerate(plain)}
        self.id = {self.piece[i]: i for i in plain}
        self.unknown = min(self.score.values()) - 10 * UNIT
        self.states = max(map(len, self.score))
        self.raw = [bytes([int(p[3:5], 16)]) if i in self.byte.values() else b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        self.trie: dict = {}
        for p, s in self.score.items():
            at = self.trie
            for c in p:
                at = at.setdefault(c, {})
            at[""] = s
        self._flatten()
        self.pieces = pa.array(self.raw, pa.large_binary())
        self.raw_bytes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))

    def _flatten(self) -> None:
        """The trie as arrays: letters' code points ascending; node * letters + letter of each child ascending, its node; each node's piece."""
        self.letters = np.array(sorted({ord(c) for p in self.score for c in p}), np.uint32)
        code = {chr(c): i for i, c in enumerate(self.letters.tolist())}
        node: dict[str, int] = {"": 0}
        keys, piece = [], [-1]
        for p in sorted(self.score, key=len):
            for k in range(1, len(p) + 1):
                if p[:k] not in node:
                    node[p[:k]] = len(piece)
                    keys.append(node[p[: k - 1]] * len(code) + code[p[k - 1]])
                    piece.append(-1)
            piece[node[p]] = self.id[p]
        keys = np.array(keys, np.int64)
        up = np.argsort(keys)
        self.child_key, self.child_node, self.node_piece = keys[up], (up + 1).astype(np.int32), np.array(piece, np.int32)
        self.piece_score = np.array([self.score.get(p, 0) for p in self.piece], np.int64)

    def _forward(self, text: str, best: list[int], stop: int) -> list[int]:
        """best[p]: greatest score of a path to p. Given for entries; lengthened to all of text by pieces that start before `stop`. The length of the last piece of each best path; ties take the longest."""
        last = [0] * len(best)
        unknown = self.unknown
        for p in range(stop):
            here = best[p]
            if here <= FAR:
                continue
            at, q, one = self.trie, p, False
            for c in text[p : p + self.states]:
                at = at.get(c)
                if at is None:
                    break
                q += 1
                s = at.get("")
                if s is not None:
                    if q == p + 1:
                        one = True
                    s += here
                    if s > best[q]:  # an earlier start, so a longer piece, was seen first
                        best[q], last[q] = s, q - p
            if not one and here + unknown > best[p + 1]:
                best[p + 1], last[p + 1] = here + unknown, 1
        return last

    def _ids(self, text: str, last: list[int], start: int, end: int) -> list[int]:
        out: list[int] = []
        while end > start:
            p = text[end - last[end] : end]
            i = self.id.get(p)
            out += [i] if i is not None else [self.byte[b] for b in reversed(p.encode())]
            end -= last[end]
        return out[::-1]

    def word(self, text: str) -> tuple[bytes, int]:
        """Ids (little-endian 32 bits) and score of a piece of text that no path crosses at either end."""
        best = [FAR] * (len(text) + 1)
        best[0] = 0
        last = self._forward(text, best, len(text))
        return np.array(self._ids(text, last, 0, len(text)), "<u4").tobytes(), best[-1]

    def _solve(self, letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """word() of many words of known letters at once: the ids one after another, how many each word has, scores, and which words hold
        a letter that is no piece (their ids are to be taken from word() instead). letters: codes; start, size: each word's.
        """
        n, most = len(size), int(size.max())
        at = (start[:, None] + np.arange(most)).ravel()
        inside = (np.arange(most) < size[:, None]).ravel()
        cell = np.flatnonzero(inside)  # word * most + place
        where, left = at[cell], (size[:, None] - np.arange(most)).ravel()[cell]
        node = np.zeros(len(cell), np.int32)
        found = []
        single = np.zeros(n * most, bool)
        for depth in range(1, self.states + 1):
            on = left >= depth
            cell, where, left, node = cell[on], where[on], left[on], node[on]
            key = node.astype(np.int64) * len(self.letters) + letters[where + depth - 1]
            k = np.minimum(np.searchsorted(self.child_key, key), len(self.child_key) - 1)
            on = self.child_key[k] == key
            cell, where, left, node = cell[on], where[on], left[on], self.child_node[k[on]]
            if not len(cell):
                break
            piece = self.node_piece[node]
            end = piece >= 0
            found.append((cell[end], piece[end], depth))
            if depth == 1:
                single[cell[end]] = True
        odd = (~single & inside).reshape(n, most).any(axis=1)
        best = np.full((n, most + 1), FAR, np.int64)
        best[:, 0] = 0
        last, by = np.zeros((n, most + 1), np.int8), np.zeros((n, most + 1), np.int32)
        orders = [np.argsort(c % most, kind="stable") for c, _, _ in found]
        found = [(c[o], p[o], d, np.searchsorted(c[o] % most, np.arange(most + 1))) for (c, p, d), o in zip(found, orders, strict=True)]
        for place in range(most):  # of equal scores the earlier place, so the longer piece, stays
            for c, p, d, edge in found:
                a, b = edge[place], edge[place + 1]
                if a < b:
                    w, own = c[a:b] // most, p[a:b]
                    s = best[w, place] + self.piece_score[own]
                    up = s > best[w, place + d]
                    w = w[up]
                    best[w, place + d], last[w, place + d], by[w, place + d] = s[up], d, own[up]
        here, row, steps = size.copy(), np.arange(n), []
        row = row[~odd]
        while len(row):
            steps.append((row, by[row, here[row]]))
            here[row] -= last[row, here[row]]
            row = row[here[row] > 0]
        of = np.concatenate([r for r, _ in steps]) if steps else np.empty(0, np.int64)
        ids = np.concatenate([i for _, i in steps]) if steps else np.empty(0, np.int32)
        turn = np.concatenate([np.full(len(r), -k) for k, (r, _) in enumerate(steps)]) if steps else of
        return ids[np.lexsort((turn, of))].astype(np.uint32), np.bincount(of, minlength=n), best[np.arange(n), size], odd

    def words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """word() of all words, UTF-8 with a space for the mark: ids one after another, where each word's start, and scores."""
        texts = words.cast(pa.large_string())
        size = pc.utf8_length(texts).to_numpy().astype(np.int64)
        n = len(size)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: np.frombuffer(texts.buffers()[1], np.int64)[n]]
        points = np.frombuffer(raw.tobytes().decode().replace(" ", MARK).encode("utf-32-le"), np.uint32)
        letters = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        start = np.cumsum(size) - size
        strange = np.append(0, np.cumsum(self.letters[letters] != points))
        alone = (strange[start + size] > strange[start]) | (size > LONG)
        order = np.argsort(size, kind="stable")
        order = order[~alone[order]]
        counts, scores = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ids_of, place_of = [], []
        k = 0
        while k < len(order):
            width = int(size[order[k]]) + 1
            few = max(1, CELLS // width)
            part = order[k : k + few]
            part = part[size[part] <= width + 3]
            k += len(part)
            ids, count, score, odd = self._solve(letters, start[part], size[part])
            counts[part], scores[part] = count, score
            alone[part[odd]] = True
            ids_of.append(ids)
            place_of.append(np.repeat(part, count))
        rest = np.flatnonzero(alone)
        for i, t in zip(rest.tolist(), texts.take(pa.array(rest)).to_pylist(), strict=True):
            got, scores[i] = self.word(t.replace(" ", MARK))
            ids_of.append(np.frombuffer(got, "<u4"))
            counts[i] = len(ids_of[-1])
            place_of.append(np.full(counts[i], i))
        edges = np.append(0, np.cumsum(counts))
        if not ids_of:
            return np.empty(0, np.uint32), edges, scores
        place, ids = np.concatenate(place_of), np.concatenate(ids_of)
        return ids[np.argsort(place, kind="stable")].astype(np.uint32), edges, scores

    def encode_all(self, texts: pa.LargeBinaryArray, prefix: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, how many each has, and scores. texts: UTF-8 with spaces for marks, no nulls; not cut within words."""
        if prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(b"", pa.large_binary()), pc.binary_join_element_wise(pa.scalar(b"", pa.large_binary()), texts, pa.scalar(b" ", pa.large_binary())))
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        edge = np.zeros(len(b) + 1, bool)
        edge[1:-1] = (b[1:] == 0x20) & (b[:-1] != 0x20)
        edge[at] = True
        cuts = np.flatnonzero(edge)
        words = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(b)]).dictionary_encode()
        if not len(words.dictionary):
            return np.empty(0, np.uint32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        ids, edges, scores = self.words(words.dictionary)
        which = words.indices.to_numpy()
        got = pa.LargeListArray.from_arrays(pa.array(edges), pa.array(ids)).take(words.indices).flatten().to_numpy()
        to = np.searchsorted(cuts, at)
        total = lambda x: np.diff(np.append(0, np.cumsum(x))[to])
        return got, total(np.diff(edges)[which]), total(scores[which])

    def encode(self, text: str) -> bytes:
        """Ids of one whole text, one after another."""
        return self.encode_all(pa.array([text.replace(MARK, " ").encode()], pa.large_binary()))[0].astype("<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids' text: the dummy prefix is taken off again."""
        return self.decode_all(ids, np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """decode() of many texts' ids, which stand one after another."""
        raw = self.pieces.take(pa.array(ids))
        data = (raw.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        stop = np.append(0, np.cumsum(self.raw_bytes[ids]))[np.append(0, np.cumsum(counts))].tolist()
        return [data[a:b].removeprefix(b" ") for a, b in zip(stop[:-1], stop[1:], strict=True)]

    # A chunk is (text, right): text is the marked chunk, right up to states - 1 characters that follow it.

    def _parts(self, text: str) -> tuple[int, int]:
        """Where the first and the last word starts within text that lie beyond all entry states; equal to len(text) if there is none."""
        first = next((m.start() for m in re.finditer(f"(?<!{MARK}){MARK}", text) if m.start() >= self.states), None)
        if first is None:
            return len(text), len(text)
        final = len(text)
        while True:  # the last mark that no mark precedes
            final = text.rindex(MARK, first, final)
            if final == first or text[final - 1] != MARK:
                return first, final

    def _middle(self, text: str) -> tuple[bytes, int]:
        ids, _, scores = self.encode_all(pa.array([text.replace(MARK, " ").encode()], pa.large_binary()), prefix=False)
        return ids.astype("<u4").tobytes(), int(scores[0])

    def _run(self, text: str, right: str, entry: list[int]) -> tuple[list[int], list[int]]:
        """best and last of _forward over text and right, given the best scores at the entry states."""
        best = [FAR] * (len(text) + self.states + 1)
        best[: len(entry)] = entry
        return best, self._forward(text + right, best, len(text))

    def _exits(self, best: list[int], n: int, right: str) -> np.ndarray:
        out = np.array(best[n : n + self.states], np.int64)
        out[len(right) + 1 :] = FAR
        return out

    def _unit(self, i: int) -> list[int]:
        return [0 if i == k else FAR for k in range(self.states)]

    def matrix(self, text: str, right: str) -> np.ndarray:
        """Best score from each entry state to each exit state."""
        S = self.states
        first, final = self._parts(text)
        if first == len(text):
            return np.stack([self._exits(self._run(text, right, self._unit(i))[0], len(text), right) for i in range(S)])
        _, middle = self._middle(text[first:final])
        tail = self._exits(self._run(text[final:], right, [0])[0], len(text) - final, right)
        head = np.array([self._run(text[:first], "", self._unit(i))[0][first] for i in range(S)], np.int64)
        return np.maximum(np.where((tail > FAR) & (head[:, None] > FAR), head[:, None] + middle + tail, FAR), FAR)

    def _path(self, text: str, right: str, entry: list[int], leave: int):
        """The chunk's best path to an exit state: its entry state, and a function for its ids, with the piece that crosses the exit."""
        first, final = self._parts(text)
        back = lambda last, end: next(e for e in self._ends(last, end) if not last[e])
        if first == len(text):
            _, last = self._run(text, right, entry)
            start = back(last, len(text) + leave)
            return start, lambda: np.array(self._ids(text + right, last, start, len(text) + leave), "<u4").tobytes()
        _, last = self._run(text[:first], "", entry)
        start = back(last, first)

        def ids() -> bytes:
            rest = text[final:]
            _, after = self._run(rest, right, [0])
            return np.array(self._ids(text, last, start, first), "<u4").tobytes() + self._middle(text[first:final])[0] + np.array(self._ids(rest + right, after, 0, len(rest) + leave), "<u4").tobytes()

        return start, ids

    @staticmethod
    def _ends(last: list[int], end: int):
        while True:
            yield end
            end -= last[end]

    def entries(self, text: str, right: str, entry: list[int], exits: np.ndarray) -> list[int]:
        """The entry state of the best path to each exit state; -1 if none leads there."""
        first, _ = self._parts(text)
        if first < len(text):  # all paths meet at a word
            return [self._path(text, right, entry, 0)[0]] * self.states
        _, last = self._run(text, right, entry)
        return [next(e for e in self._ends(last, len(text) + j) if not last[e]) if exits[j] > FAR else -1 for j in range(self.states)]

    def trace(self, text: str, right: str, entry: list[int], leave: int) -> bytes:
        """Ids of the best path to an exit state, with the piece that crosses the exit and without that which crosses the entry."""
        return self._path(text, right, entry, leave)[1]()


@lru_cache(maxsize=2)
def vocabulary(file: str) -> Vocabulary:
    """One for each Python worker, so that what it remembers serves all its tasks."""
    return Vocabulary(file)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), FAR)


def through(before: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The best scores at a chunk's exit states from those at its entry states."""
    return np.maximum((before[:, None] + matrix).max(0), FAR)


def _side(flat) -> np.ndarray:
    m = np.asarray(flat, np.int64)
    side = math.isqrt(len(m))
    return m.reshape(side, side)


def cut_vectors(scores: DataFrame) -> DataFrame:
    """__row, __k, before: for each chunk the best scores at its entry states. scores: __row, __k and matrix, read from files.

    Matrices are combined in groups of FAN, level upon level; then each group hands its vector down to its members. No group holds more than FAN.
    """
    up = F.floor(F.col("__k") / FAN).cast("int")
    levels, top = [scores], scores.agg(F.max("__k")).first()[0] or 0

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__k")
        return pd.DataFrame({"__row": pdf["__row"].iloc[:1], "__k": pdf["__k"].iloc[:1] // FAN, "matrix": [reduce(combine, map(_side, pdf["matrix"])).ravel()]})

    while top:
        levels.append(cut(levels[-1].groupBy("__row", up).applyInPandas(join, "__row bigint, __k int, matrix array<bigint>"), "combined"))
        top //= FAN

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__k")
        now = np.asarray(pdf["before"].iloc[0], np.int64)
        out = []
        for m in pdf["matrix"]:
            out.append(now)
            now = through(now, _side(m))
        return pd.DataFrame({"__row": pdf["__row"], "__k": pdf["__k"], "before": out})

    first = F.transform(F.sequence(F.lit(1), F.sqrt(F.size("matrix")).cast("int")), lambda i: F.when(i == 1, F.lit(0)).otherwise(F.lit(FAR)).cast("long"))
    vectors = levels[-1].select("__row", "__k", first.alias("before"))
    for level in levels[-2::-1]:
        given = level.withColumn("__up", up).join(vectors.select("__row", F.col("__k").alias("__up"), "before"), ["__row", "__up"])
        vectors = cut(given.groupBy("__row", "__up").applyInPandas(hand_down, "__row bigint, __k int, before array<bigint>"), "vectors")
    return vectors


RESULT = "n_pieces bigint, ids_crc32 bigint, round_trip boolean"


def _results(v: Vocabulary, texts: pa.LargeBinaryArray, ids: np.ndarray, counts: np.ndarray, with_ids: bool) -> list:
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    stop = np.cumsum(counts)
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stop - counts).tolist(), stop.tolist(), strict=True)]
    same = [a == b for a, b in zip(v.decode_all(ids, counts), texts.to_pylist(), strict=True)]
    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, stop).astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
    return [pa.array(counts), crc, same, *lists]


def _plain(column: pa.Array) -> pa.LargeBinaryArray:
    """Texts as UTF-8 with spaces for marks; null as empty, what isn't UTF-8 as replacement characters."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pc.fill_null(column.cast(pa.large_binary()), b"")
    try:
        binary.cast(pa.large_string())
    except pa.ArrowInvalid:
        binary = pa.array([t.decode("utf-8", "replace").encode() for t in binary.to_pylist()], pa.large_binary())
    return pc.replace_substring(binary, MARK.encode(), b" ")


def encode(docs: DataFrame, file: str, keep: list[str] | None = None, text: str = "text", chunk: int = 1 << 15, ids: bool = False) -> DataFrame:
    """docs (or its columns `keep`) with RESULT, and with `ids` also piece_ids: the unsigned crc32 of the ids as little-endian 32-bit
    integers, and whether decoding them gives the text again.

    Null and empty texts have no pieces. A space mark in a text is read as a space, as in SentencePiece. Texts of over `chunk`
    characters go through the chunks of the scan, dealt over all tasks; their ids don't depend on `chunk`. Repeated rows are each
    encoded. Columns of docs with a result's name are replaced; an empty table gives no rows.
    """
    fields = RESULT + (", piece_ids array<int>" if ids else "")
    names = [x.split()[0] for x in fields.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), F.col(f"`{text}`").cast("string").alias("__text"))
    long = F.length(F.coalesce("__text", F.lit(""))) > chunk

    def small():
        v = vocabulary(file)

        def work(batch: pa.RecordBatch) -> list:
            texts = _plain(batch.column("__text"))
            got, counts, _ = v.encode_all(texts)
            return _results(v, texts, got, counts, ids)

        return work

    few = map_columns(own.filter(~long), ["__text"], ["__keep"], fields, small, TEXT_BYTES).select("__keep.*", *names)
    giant = cut(own.filter(long).withColumn("__row", F.monotonically_increasing_id()), "giant")  # written once, so the numbers stay
    if giant.isEmpty():
        return few
    reach = vocabulary(file).states - 1
    marked = F.concat(F.lit(MARK), F.translate(F.col("__text"), " ", MARK))
    parts = giant.select("__row", marked.alias("t")).select("__row", "t", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / chunk).cast("int"))).alias("__k"))
    parts = parts.select("__row", "__k", F.substring("t", F.col("__k") * chunk + 1, F.lit(chunk)).alias("chunk"), F.substring("t", (F.col("__k") + 1) * chunk + 1, F.lit(reach)).alias("right"))
    parts = cut(parts.repartition(F.col("__row"), F.col("__k")), "chunks")

    def each(batch: pa.RecordBatch, *columns: str):
        return zip(*(batch.column(c).to_pylist() for c in ("chunk", "right", *columns)), strict=True)

    def matrices():
        v = vocabulary(file)
        return lambda b: [[v.matrix(t, r).ravel() for t, r in each(b)]]

    def entries():
        v = vocabulary(file)
        return lambda b: [[v.entries(t, r, before, through(np.array(before, np.int64), _side(m))) for t, r, before, m in each(b, "before", "matrix")]]

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        """From the last cut back; a row of S small numbers for each chunk of one text."""
        pdf = pdf.sort_values("__k")
        leave = [0]
        for table in pdf["entry_of"].iloc[:0:-1]:
            leave.append(int(table[leave[-1]]))
        return pd.DataFrame({"__row": pdf["__row"], "__k": pdf["__k"], "leave": leave[::-1]})

    def traces():
        v = vocabulary(file)
        return lambda b: [[v.trace(*x) for x in each(b, "before", "leave")]]

    scores = cut(map_columns(parts, ["chunk", "right"], ["__row", "__k"], "matrix array<bigint>", matrices), "matrices")
    vectors = cut_vectors(scores)
    known = parts.join(vectors, ["__row", "__k"])
    tables = map_columns(known.join(scores, ["__row", "__k"]), ["chunk", "right", "before", "matrix"], ["__row", "__k"], "entry_of array<int>", entries)
    leaves = tables.groupBy("__row").applyInPandas(follow, "__row bigint, __k int, leave int")
    traced = map_columns(known.join(leaves, ["__row", "__k"]), ["chunk", "right", "before", "leave"], ["__row", "__k"], "part binary", traces)
    whole = traced.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__k", "part"))).alias("__parts"))  # one text's ids, as long as the text itself

    def close():
        v = vocabulary(file)

        def work(b: pa.RecordBatch) -> list:
            got = [b"".join(x["part"] for x in p) for p in b.column("__parts").to_pylist()]
            return _results(v, _plain(b.column("__text")), np.frombuffer(b"".join(got), "<u4"), np.array([len(x) // 4 for x in got], np.int64), ids)

        return work

    return few.union(map_columns(giant.join(whole, "__row"), ["__text", "__parts"], ["__keep"], fields, close).select("__keep.*", *names))


def decode(docs: DataFrame, file: str, ids: str = "piece_ids", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with `text`, which the ids stand for; null or no ids give an empty text. A column of that name is replaced."""

    def make():
        v = vocabulary(file)

        def work(batch: pa.RecordBatch) -> list:
            lists = pc.fill_null(batch.column(0).cast(pa.large_list(pa.int32())), [])
            counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
            return [[t.decode("utf-8", "replace") for t in v.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)]]

        return work

    return map_columns(docs, [ids], docs.columns if keep is None else keep, f"{text} string", make)


def piece_digest(docs: DataFrame, file: str, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and round_trip of every document."""
    return encode(docs, file, [doc_id])
