"""Secret scans with a trigram inverted index over each shard of texts.

From each rule's regex a Boolean query over trigrams is derived: any match must hold the query's trigrams. The shard's
index has, for each trigram of its lower-cased bytes, the sorted documents; postings are intersected and united as the
query says, and only those documents are searched by the regex. A rule without a mandatory trigram searches all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, text_bytes

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Rule:
    """kind: a name without ':' or ','. A match counts if group `group` has at least `least` characters; others still consume their text."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False


#: The three base rules, in the order of their listing.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Publicly documented credential formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
)
MOST_STRINGS = 64


def trigram_query(pattern: str):
    """None: no mandatory trigram. Else nested ("and" | "or", parts); a part is a query or a trigram (lower-case bytes).

    The pattern is walked left to right with the set of strings that can stand there exactly; where that set would become too
    large or open-ended, what it demands is added to the query and a new set begins.
    """

    def demand(strings: set[bytes]):
        if any(len(s) < 3 for s in strings):
            return None
        options = {("and", frozenset(s[i : i + 3] for i in range(len(s) - 2))) for s in strings}
        return ("or", frozenset(options)) if len(options) > 1 else next(iter(options))

    def both(kind: str, parts: list):
        if kind == "or" and any(p is None for p in parts):
            return None
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else (kind, frozenset(parts))

    def literal(code: int) -> set[bytes]:
        return {chr(code).encode().translate(_LOWER)}

    def walk(items) -> tuple[set[bytes] | None, object]:
        """The exact strings, or None and the query."""
        exact: set[bytes] = {b""}
        queries, whole = [], True

        def stop():
            nonlocal exact, whole
            queries.append(demand(exact))
            exact, whole = {b""}, False

        def put(strings: set[bytes]):
            nonlocal exact
            if len(exact) * len(strings) > MOST_STRINGS:
                stop()
            exact = {a + b for a in exact for b in strings}

        for op, value in items:
            if op is K.LITERAL:
                put(literal(value))
            elif op is K.IN and all(o is K.LITERAL for o, _ in value) and len(value) <= 8:
                put(set().union(*(literal(v) for _, v in value)))
            elif op is K.SUBPATTERN or op is K.BRANCH:
                got = [walk(x) for x in ([value[-1]] if op is K.SUBPATTERN else value[1])]
                if all(s is not None for s, _ in got) and len(strings := set().union(*(s for s, _ in got))) <= MOST_STRINGS:
                    put(strings)
                else:
                    stop()
                    queries.append(both("or", [demand(s) if s is not None else q for s, q in got]))
            elif op is K.MAX_REPEAT or op is K.MIN_REPEAT:
                low, high, body = value
                strings, query = walk(body)
                if (low, high) == (0, 1) and strings is not None:
                    put(strings | {b""})
                elif low and strings is not None and low == high == 1:
                    put(strings)
                else:
                    if low and strings is not None:
                        put(strings)
                    stop()
                    if low and strings is None:
                        queries.append(query)
            elif op is not K.AT:
                stop()
        if whole:
            return exact, None
        stop()
        return None, both("and", queries)

    strings, query = walk(_parser.parse(pattern))
    return demand(strings) if strings is not None else query


class TrigramIndex:
    """Postings of one shard: for each trigram of the lower-cased texts, the documents that have it."""

    #: Bytes of text indexed at a time.
    PART = 1 << 20

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts).translate(_LOWER), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.cumsum(size)
        keys = [np.empty(0, np.int64)]
        for a in range(0, len(data) - 2, self.PART):  # a part's places take some 60 bytes each, what they have in common far less
            part = data[a : a + self.PART + 2].astype(np.int64)
            doc = np.searchsorted(stops, np.arange(a, a + len(part)), "right")
            inside = doc[:-2] == doc[2:]
            keys.append(np.unique(((part[:-2] << 16 | part[1:-1] << 8 | part[2:])[inside] << 32) | doc[:-2][inside]))
        key = np.unique(np.concatenate(keys))
        self.codes, self.docs = key >> 32, key & 0xFFFFFFFF

    def postings(self, trigram: bytes) -> np.ndarray:
        code = trigram[0] << 16 | trigram[1] << 8 | trigram[2]
        a, b = np.searchsorted(self.codes, [code, code + 1])
        return self.docs[a:b]

    def find(self, query) -> np.ndarray:
        """Sorted documents that meet the query."""
        if isinstance(query, bytes):
            return self.postings(query)
        parts = [self.find(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.regex.encode(), re.I if r.ignore_case else 0), trigram_query(r.regex)) for r in rules]

    def scan(self, texts: list[bytes]) -> list[list[dict]]:
        """Each text's matches by start, then rule; start and end in code points."""
        index = TrigramIndex(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(self.rules):
            for d in range(len(texts)) if query is None else index.find(query).tolist():
                for m in self.matches(regex, rule, texts[d]):
                    found[d].append((m[0], k, m[1]))
        out = []
        for text, spans in zip(texts, found, strict=True):
            rows = []
            if spans:
                lead = None if text.isascii() else np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                at = (lambda b: b) if lead is None else (lambda b, lead=lead: int(lead[b - 1]) if b else 0)
                rows = [{"kind": self.rules[k][0].kind, "start": at(a), "end": at(b)} for a, k, b in sorted(spans)]
            out.append(rows)
        return out

    @staticmethod
    def matches(regex: re.Pattern, rule: Rule, text: bytes) -> list[tuple[int, int]]:
        if rule.regex == r"[0-9a-f]+":  # a maximal run of `least` or more, without one match for each shorter run
            return [m.span() for m in re.finditer(rb"[0-9a-f]{%d,}" % rule.least, text)]
        return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with `secrets`, every match by start and then by the rules' order, without a shuffle.

    Leftmost and not overlapping within a rule; rules may overlap. Rules' regexes are of ASCII characters. Null and empty texts have
    no matches. An Arrow batch is a shard; whole texts are searched. A column of docs named `secrets` is replaced.
    """

    def make():
        scanner = Scanner(rules)
        return lambda batch: [scanner.scan(text_bytes(batch.column(text)))]

    return map_columns(docs, [text], docs.columns if keep is None else keep, f"secrets {SPANS}", make)


def redact(text: Column, secrets: Column, mark: str = "[secret]") -> Column:
    """text with every maximal run of overlapping secrets replaced by the mark; null stays null."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(secrets, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(secrets) == 0, text).otherwise(done)


def secret_digest(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The row of each document that op8's contract asks for."""
    found = find_secrets(docs, keep=[doc_id])
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count_of = lambda kind: lambda s: s["kind"] == kind
    n = {r.kind: F.size(F.filter("secrets", count_of(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE}
    return found.select(doc_id, n["assign"], n["access"], n["hex"], F.sha2(say(base), 256).alias("base_sha256"), say(F.col("secrets")).alias("spans"))
