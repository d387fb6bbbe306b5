"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Entries become integers, so counts, sums and the scatter matrix M = n^2 V (V the covariance) are exact. Its characteristic polynomial is
found modulo many primes, each by reduction to Hessenberg form in a Spark task, and put together by Chinese remainders; the number of primes
follows from a bound on the coefficients. All roots are real, so the sign changes of the polynomial shifted to a count exactly the
roots over a: bisection isolates each distinct root, and goes on until it is known far better than its distance to the others.
Components are null vectors of M minus the root, by inverse iteration in as many decimal digits as that distance asks for.

The driver holds what is of the size of the matrix: d^2 integers and the polynomial's d + 1 coefficients of about d * log2(trace) bits. That
suits some hundred dimensions. The number of vectors isn't bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb, gcd, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Integers over this are held at it: a long can't hold their differences. (64 times an entry of 10^16 is under it.)
MOST = 1 << 61
#: Bits of a limb: products of two limbs, summed over a block's rows, are exact in a double.
LIMB, ROWS = 20, 4096
#: Bits of the parts in which sums travel to the driver.
PART = 40


def finite(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is neither null nor has null or non-finite entries."""
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & ~bad)


def integers(column: pa.Array, d: int, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift of each entry, one row a vector of d entries."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * c), -MOST, MOST).astype(np.int64) + shift


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of limb k times 2^(LIMB k); the last limb carries the sign."""
    out = []
    while np.abs(y).max(initial=0) >= 1 << LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


def parts(i: int, j: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    """value in signed parts of PART bits: sums of them over some million tasks fit a long."""
    sign, value, k = (1 if value >= 0 else -1), abs(value), 0
    while value:
        yield i, j, k, sign * (value & ((1 << PART) - 1))
        value, k = value >> PART, k + 1


def summed(vectors: DataFrame, vector: str, tally) -> dict[tuple[int, int], int]:
    """tally(batches of the vector column) yields (i, j, integer) once a task; the sums by (i, j), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [p for i, j, v in tally(b.column(0) for b in batches if b.num_rows) for p in parts(i, j, int(v))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["i", "j", "k", "v"])

    found = vectors.select(vector).mapInArrow(run, "i int, j int, k int, v bigint").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in found:
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (r.v << PART * r.k)
    return out


def sums(vectors: DataFrame, vector: str, d: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """n and the sum of each dimension."""

    def tally(columns):
        n, total = 0, np.zeros(d, object)
        for c in columns:
            x = integers(c, d, scale, shift)
            n += len(x)
            for k in range(0, len(x), ROWS):
                for at, limb in enumerate(limbs(x[k : k + ROWS])):
                    total += limb.sum(0).astype(np.int64).astype(object) << LIMB * at
        yield -1, -1, n
        for i, v in enumerate(total):
            yield i, -1, v

    found = summed(vectors, vector, tally)
    return found.get((-1, -1), 0), [found.get((i, -1), 0) for i in range(d)]


def scatter(vectors: DataFrame, vector: str, n: int, total: list[int], scale: int, shift: int) -> list[list[int]]:
    """n^2 times the covariance: products of centred entries, centred to the integer below the mean first and exactly after."""
    d = len(total)
    middle = [s // n for s in total]
    rest = [s - n * c for s, c in zip(total, middle, strict=True)]
    centre = np.array(middle, np.int64)

    def tally(columns):
        held = np.zeros((d, d), object)
        for c in columns:
            y = integers(c, d, scale, shift) - centre
            for k in range(0, len(y), ROWS):
                split = limbs(y[k : k + ROWS])
                for a, x in enumerate(split):
                    for b, z in enumerate(split):
                        held += (x.T @ z).astype(np.int64).astype(object) << LIMB * (a + b)
        for i in range(d):
            for j in range(i, d):
                yield i, j, held[i, j]

    found = summed(vectors, vector, tally)
    return [[n * found.get((min(i, j), max(i, j)), 0) - rest[i] * rest[j] for j in range(d)] for i in range(d)]


def primes(count: int) -> list[int]:
    """The largest primes under 2^31."""

    def prime(p: int) -> bool:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # settles all numbers under 3 * 10^9
            x = pow(base, odd, p)
            if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
                return False
        return True

    out, p = [], (1 << 31) - 1
    while len(out) < count:
        if prime(p):
            out.append(p)
        p -= 2
    return out


def modular_polynomials(matrix: list[list[int]], moduli: list[int]) -> np.ndarray:
    """The characteristic polynomial for each prime, lowest coefficient first: similarity to Hessenberg form, then its recurrence."""
    d, p = len(matrix), np.array(moduli, np.int64)
    h = np.array([[[v % q for v in row] for row in matrix] for q in moduli], np.int64)
    every, p2, p3 = np.arange(len(p)), p[:, None], p[:, None, None]
    for k in range(d - 2):
        at = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)  # a pivot, by exchange of two rows and the same two columns
        h[every, at], h[:, k + 1] = h[:, k + 1].copy(), h[every, at].copy()
        h[every, :, at], h[:, :, k + 1] = h[:, :, k + 1].copy(), h[every, :, at].copy()
        inverse, power, left = np.ones(len(p), np.int64), h[:, k + 1, k].copy(), p - 2
        while left.any():
            inverse = np.where(left & 1, inverse * power % p, inverse)
            power, left = power * power % p, left >> 1
        u = h[:, k + 2 :, k] * inverse[:, None] % p2  # zeros where the column has no pivot
        h[:, k + 2 :] = (h[:, k + 2 :] - u[:, :, None] * h[:, k + 1 : k + 2]) % p3
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * u[:, None, :] % p3).sum(2)) % p2
    poly = np.zeros((d + 1, len(p), d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(1, d + 1):
        new = -h[:, k - 1, k - 1, None] * poly[k - 1] % p2
        new[:, 1:] += poly[k - 1][:, :-1]
        down = np.ones(len(p), np.int64)
        for i in range(k - 1, 0, -1):
            down = down * h[:, i, i - 1] % p
            new -= (h[:, i - 1, k - 1] * down % p)[:, None] * poly[i - 1] % p2
        poly[k] = new % p2
    return poly[d]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """det(t - matrix) of a positive semidefinite integer matrix, lowest coefficient first. Each task takes some primes."""
    d = len(matrix)
    trace = max(1, sum(matrix[i][i] for i in range(d)))
    bits = max(log2(comb(d, k)) + k * max(0.0, log2(trace) - log2(d)) for k in range(d + 1))  # e_k <= C(d, k) (trace / d)^k
    moduli = primes(int(bits / 30.9) + 3)
    held = [[str(v) for v in row] for row in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [[int(v) for v in row] for row in held]
        for batch in batches:
            taken = batch.column(0).to_pylist()
            for k in range(0, len(taken), 8):
                some = taken[k : k + 8]
                got = modular_polynomials(own, some)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(got.tolist(), pa.list_(pa.int64()))], names=["prime", "rest"])

    at = spark.range(0, len(moduli), 1, max(1, len(moduli) // 8)).select(F.get(F.lit(moduli), F.col("id").cast("int")).cast("bigint").alias("prime"))
    value, modulus = [0] * (d + 1), 1
    for r in at.mapInArrow(run, "prime bigint, rest array<bigint>").collect():
        inverse = pow(modulus, -1, r.prime)
        value = [v + modulus * ((x - v) * inverse % r.prime) for v, x in zip(value, r.rest, strict=True)]
        modulus *= r.prime
    return [v - modulus if 2 * v > modulus else v for v in value]


def over(poly: list[int], at: int, bits: int) -> int:
    """How many roots, by multiplicity, exceed at / 2^bits: the sign changes of the polynomial shifted there, for all its roots are real."""
    d = len(poly) - 1
    at, bits = at << max(0, -bits), max(0, bits)
    c = [v << bits * (d - i) for i, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs[:-1], signs[1:], strict=True))


def sign(poly: list[int], at: int, bits: int) -> int:
    """The polynomial's sign at at / 2^bits."""
    at, bits = at << max(0, -bits), max(0, bits)
    total, d = 0, len(poly) - 1
    for k in range(d, -1, -1):
        total = total * at + (poly[k] << bits * (d - k))
    return (total > 0) - (total < 0)


def distinct_roots(poly: list[int]) -> int:
    """The degree less that of the common divisor with the derivative, the least over some primes: a prime can only make the divisor larger."""
    d, best = len(poly) - 1, 0
    for p in primes(12)[-4:]:
        a, b = [v % p for v in poly], [i * v % p for i, v in enumerate(poly)][1:]
        while any(b):
            while not b[-1]:
                b.pop()
            inverse = pow(b[-1], -1, p)
            while len(a) >= len(b):
                f = a[-1] * inverse % p
                if f:
                    for i in range(len(b)):
                        a[len(a) - len(b) + i] = (a[len(a) - len(b) + i] - f * b[i]) % p
                a.pop()
            a, b = b, a or [0]
        while not a[-1]:
            a.pop()
        best = max(best, d - (len(a) - 1))
    return best


@dataclass
class Span:
    """(low, high] / 2^bits has `count` roots by multiplicity, and `higher` lie over it. low = high: that is the root."""

    low: int
    high: int
    bits: int
    count: int
    higher: int

    def halve(self, poly: list[int]) -> None:
        """For a span with one distinct root: the half that has it."""
        if self.low == self.high:
            return
        self.low, self.high, self.bits = 2 * self.low, 2 * self.high, self.bits + 1
        middle = (self.low + self.high) // 2
        s = sign(poly, middle, self.bits)
        if not s:
            self.low = self.high = middle
            return
        if self.count % 2:  # the sign tells whether the number of roots above is even
            upper = (self.higher + self.count) % 2 == (s < 0)
        else:
            upper = over(poly, middle, self.bits) > self.higher
        self.low, self.high = (middle, self.high) if upper else (self.low, middle)

    def split(self, poly: list[int]) -> list[Span]:
        low, high, bits = 2 * self.low, 2 * self.high, self.bits + 1
        middle = (low + high) // 2
        upper = over(poly, middle, bits) - self.higher
        return [x for x in (Span(middle, high, bits, upper, self.higher), Span(low, middle, bits, self.count - upper, self.higher + upper)) if x.count]

    @property
    def edges(self) -> tuple[Fraction, Fraction]:
        unit = Fraction(2) ** -self.bits
        return self.low * unit, self.high * unit


def roots(poly: list[int], trace: int, most: int) -> list[tuple[Fraction, int, Fraction]]:
    """The largest positive roots, falling, until their multiplicities make `most`: value, multiplicity, distance to the nearest other root or less.

    A value is right to 2^-100 of that distance. All roots are real and none is negative; trace is their sum.
    """
    zero = next(i for i, v in enumerate(poly) if v)
    poly = poly[zero:]
    d = len(poly) - 1
    if not d:
        return []
    kinds, spans = distinct_roots(poly), [Span(0, 1, -trace.bit_length(), d, 0)]
    while len(spans) < kinds:  # spans with several roots, equal or not, are halved until each distinct root has its own
        spans = [y for x in spans for y in ([x] if x.count == 1 else x.split(poly))]
    gaps = []
    for x, y in zip(spans, [*spans[1:], None], strict=True):
        while True:
            (low, high), (below, ceiling) = x.edges, y.edges if y else (Fraction(0), Fraction(0))
            if low - ceiling > 0 and low - ceiling >= max(high - low, ceiling - below):
                gaps.append(low - ceiling)
                break
            (x if not y or high - low >= ceiling - below else y).halve(poly)
    out: list[tuple[Fraction, int, Fraction]] = []
    for k, x in enumerate(spans):
        if sum(m for _, m, _ in out) >= most:
            break
        gap = min(gaps[max(0, k - 1) : k + 1])
        while x.low < x.high and (x.edges[1] - x.edges[0]) * (1 << 100) > gap:
            x.halve(poly)
        out.append((sum(x.edges) / 2, x.count, gap))
    return out


def null_vectors(matrix: list[list[int]], value: Fraction, count: int, gap: Fraction) -> np.ndarray:
    """`count` orthonormal vectors that matrix - value takes next to nothing: inverse iteration with digits enough for the gap to other roots."""
    d = len(matrix)
    size = d * max(abs(v) for row in matrix for v in row)
    with localcontext() as context:
        context.prec = 45 + len(str(int(size / gap) + 1))
        at = Decimal(value.numerator) / Decimal(value.denominator)
        a = [[Decimal(v) - at if i == j else Decimal(v) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        order = list(range(d))
        tiny = Decimal(size).scaleb(-context.prec)
        for c in range(d):
            pivot = max(range(c, d), key=lambda r: abs(a[r][c]))  # noqa: B023
            a[c], a[pivot], order[c], order[pivot] = a[pivot], a[c], order[pivot], order[c]
            a[c][c] = a[c][c] or tiny
            top, own = a[c][c + 1 :], a[c][c]
            for r in range(c + 1, d):
                row = a[r]
                f = row[c] = row[c] / own
                if f:
                    row[c + 1 :] = [x - f * y for x, y in zip(row[c + 1 :], top, strict=True)]
        random = np.random.default_rng(7)
        block = [[Decimal(int(v)) for v in random.integers(1, 1000, d)] for _ in range(count)]
        for _ in range(3):
            solved: list[list[Decimal]] = []
            for v in block:
                y = [v[k] for k in order]
                for r in range(d):
                    y[r] -= sum((x * z for x, z in zip(a[r][:r], y, strict=False)), Decimal(0))
                for r in range(d - 1, -1, -1):
                    y[r] = (y[r] - sum((x * z for x, z in zip(a[r][r + 1 :], y[r + 1 :], strict=True)), Decimal(0))) / a[r][r]
                for _ in range(2):
                    for u in solved:
                        f = sum(x * z for x, z in zip(u, y, strict=True))
                        y = [z - f * x for x, z in zip(u, y, strict=True)]
                    norm = sum(z * z for z in y).sqrt()
                    y = [z / norm for z in y]
                solved.append(y)
            block = solved
        return np.array([[float(x) for x in v] for v in block])


def components(spark, matrix: list[list[int]], found: list[tuple[Fraction, int, Fraction]]) -> np.ndarray:
    """The null vectors of each root, one below the other. A task solves for some roots."""
    held = [[str(v) for v in row] for row in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [[int(v) for v in row] for row in held]
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([null_vectors(own, *found[k]).ravel().tolist()], pa.list_(pa.float64()))], names=["k", "v"])

    got = {r.k: r.v for r in spark.range(0, len(found), 1, max(1, len(found) // 2)).mapInArrow(run, "k bigint, v array<double>").collect()}
    return np.concatenate([np.array(got[k]).reshape(-1, len(matrix)) for k in range(len(found))])


@dataclass
class Whitening:
    """values: eigenvalues of the covariance, falling; explained: their shares of its trace (null if that is zero); vectors: a row for each component, zeros where the eigenvalue is zero."""

    n: int
    total: list[int]
    values: np.ndarray
    explained: list[float | None]
    vectors: np.ndarray
    scale: int
    shift: int

    def project(self, column: pa.Array) -> tuple[np.ndarray, list[int | None]]:
        """Whitened coordinates (NaN for eigenvalue zero) and the exact sums of (n x - S)^2, null where a long can't hold one."""
        d, n = len(self.total), self.n
        middle = [s // n for s in self.total]
        rest = [s - n * c for s, c in zip(self.total, middle, strict=True)]
        y = integers(column, d, self.scale, self.shift) - np.array(middle, np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            white = (y - np.array([r / n for r in rest])) @ self.vectors.T / np.sqrt(self.values)
        most = (int(np.abs(y).max(initial=0)) + 1) * n
        if d * most * most < 1 << 63:
            z = n * y - np.array(rest, np.int64)
            return white, (z * z).sum(1).tolist()
        exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
        return white, [v if v < 1 << 63 else None for v in exact]


def fit(vectors: DataFrame, vector: str, components_: int = 32, scale: int = 64, shift: int = 1_000_000) -> Whitening | None:
    """The whitening of the vectors of the commonest length (of equally common ones the longest); null without vectors or dimensions.

    vectors is read three times and must be finite(). Two passes add up sums and centred products; what goes to the driver is of the
    size of the matrix.
    """
    spark = vectors.sparkSession
    lengths = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    if lengths is None:
        return None
    d = lengths.d
    own = vectors.filter(F.size(vector) == d)
    n, total = sums(own, vector, d, scale, shift)
    matrix = scatter(own, vector, n, total, scale, shift)
    trace, k = sum(matrix[i][i] for i in range(d)), min(components_, d)
    values, rows = np.zeros(k), np.zeros((k, d))
    explained: list[float | None] = [0.0 if trace else None] * k
    if trace:
        common = gcd(*(v for row in matrix for v in row))
        reduced = [[v // common for v in row] for row in matrix]
        found = roots(characteristic_polynomial(spark, reduced), trace // common, k)
        each = [value for value, count, _ in found for _ in range(count)][:k]
        rows[: len(each)] = components(spark, reduced, found)[: len(each)]
        values[: len(each)] = [float(v * common / n**2) for v in each]
        explained[: len(each)] = [float(v * common / trace) for v in each]
    return Whitening(n, total, values, explained, rows, scale, shift)


def identity_error(vectors: DataFrame, vector: str, by: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over components with an eigenvalue; null if none has."""
    k = int((by.values > 0).sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                white = by.project(batch.column(0))[0][:, :k]
                products += white.T @ white
                total += white.sum(0)
        i, j = np.indices((k, k + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.column_stack([products, total]).ravel())], names=["i", "j", "v"])

    got = np.zeros((k, k + 1))
    for r in vectors.filter(F.size(vector) == len(by.total)).select(vector).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        got[r.i, r.j] = r.v
    mean = got[:, k] / by.n  # about zero, for whitened values are centred before they are multiplied
    return float(np.abs(got[:, :k] / by.n - np.outer(mean, mean) - np.eye(k)).max())


WHITE = "deviation bigint, whitened array<double>"


def whiten(vectors: DataFrame, by: Whitening, keep: list[str], vector: str = "embedding") -> DataFrame:
    """The columns `keep` of the rows that `by` covers, deviation and whitened, a value for each component (null for eigenvalue zero).

    Rows whose vector is null, has null or non-finite entries or another length than the fitted ones have no coordinates and are left out.
    Repeated rows each come out.
    """

    def make():
        def work(batch: pa.RecordBatch) -> list:
            white, deviation = by.project(batch.column(vector))
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)  # NaN as null
            return [pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), flat)]

        return work

    own = finite(vectors, vector).filter(F.size(vector) == len(by.total))
    return map_columns(own, [vector], keep, WHITE, make)


def whitening_digest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows that op12's contract asks for. Components of eigenvalue zero have a null whitened; no usable vector: no rows."""
    spark = vectors.sparkSession
    own = finite(vectors, vector)
    by = fit(own, vector)
    if by is None:
        return spark.createDataFrame([], f"{vec_id} {vectors.schema[vec_id].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    error = identity_error(own, vector, by)
    share = F.array(*[F.lit(x).cast("double") for x in by.explained])
    white = whiten(vectors, by, [vec_id], vector).select(vec_id, "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return white.select(
        vec_id, (F.col("k") + 1).alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
