"""Ordered computations over series that are longer than a task: rows are dealt by ranges of (key, order), so a range is a task however few keys there are.

A first pass writes the rows in their ranges, each knowing its place. A range's state (how many rows, a sum, a last value, a drawdown) is one small
row, and the states before each range come from a window over those. A second pass finishes inside the ranges. What needs only
some rows before and after (lags, rolling windows) runs in blocks of a series, each with copies of its neighbours' nearest rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from refspark.shared import checkpointed

#: How states of kinds are made from rows and put together, and whether nothing before leaves them as they are.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, F.max, lambda a, b: F.greatest(a, b)),
    "product": (F.product, F.product, lambda a, b: F.coalesce(a * b, a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}
RANGE, PLACE = "__range", "__place"


def ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df in as many ranges of (by, order) as a shuffle has partitions, written once: __range, and __place, which rises along the order within a
    range and from range to range."""
    keys, n = [F.col(c) for c in [*by, *order]], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(PLACE, F.monotonically_increasing_id())
    return checkpointed(rows.withColumn(RANGE, F.shiftright(PLACE, 33)))


def _joined(rows: DataFrame, states: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of states (by, __range, ...), whose keys may be null."""
    side = states.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(RANGE).alias("__at"), *[c for c in states.columns if c not in (*by, RANGE)])
    on = F.col(RANGE) == F.col("__at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(side, on).drop("__at", *[f"__{c}" for c in by])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "k", held: DataFrame | None = None) -> DataFrame:
    """df with the number of each row in its key by the order, from 0: one range shuffle, and a row for each key and range to count with.

    Rows that are equal in `by` and `order` are numbered as they come, the same way in every later step.
    """
    rows = held if held is not None else ranged(df.drop(name), by, order)
    own = rows.groupBy(*by, RANGE).agg(F.count("*").alias("__n"), F.min(PLACE).alias("__first"))
    before = F.sum("__n").over(W.partitionBy(*by).orderBy(RANGE)) - F.col("__n")
    out = _joined(rows, own.withColumn("__before", before).drop("__n"), by)
    out = out.withColumn(name, F.col(PLACE) - F.col("__first") + F.col("__before")).drop("__first", "__before")
    return out if held is not None else out.drop(RANGE, PLACE)


def running(df: DataFrame, by: list[str], order: list[str], states: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """df with, for each name of `states`, its kind (of KINDS) of the column over the key's rows up to each row, or up to the row before.

    As the window from the first row on, nulls being left out, but no task has more than a range. A column must be one that df gives.
    """
    taken = {f"__v_{n}": c for n, (_, c) in states.items()}
    rows = ranged(df.drop(*states).withColumns(taken), by, order)
    kinds = {n: KINDS[k] for n, (k, _) in states.items()}
    own = rows.groupBy(*by, RANGE).agg(*[(F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(PLACE))) if states[n][0] == "last" else make(F.col(f"__v_{n}"))).alias(f"__s_{n}") for n, (make, _, _) in kinds.items()])
    past = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    before = own.select(*by, RANGE, *[merge(F.col(f"__s_{n}")).over(past).alias(f"__b_{n}") for n, (_, merge, _) in kinds.items()])
    here = W.partitionBy(*by, RANGE).orderBy(PLACE).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    out = _joined(rows, before, by)
    out = out.withColumns({n: join(F.col(f"__b_{n}"), make(F.col(f"__v_{n}")).over(here)) for n, (make, _, join) in kinds.items()})
    return out.drop(RANGE, PLACE, *taken, *[f"__b_{n}" for n in states])


def folded(df: DataFrame, by: list[str], order: list[str], fields: str, begin: object, step: Callable[[object, tuple], tuple[object, tuple]]) -> DataFrame:
    """df with `fields` (a DDL string): for each row, in its key's order, what step(state, row) gives beside the next state; begin is a key's first state.

    For rules in which each row hangs on what was decided before, which no window expresses. Rows are streamed, so a key of any length takes one
    task's time but not its memory. Columns of df with a name of fields are replaced.
    """
    new = T._parse_datatype_string(fields)
    own = df.drop(*new.names)
    schema = T.StructType([*own.schema.fields, *new.fields])
    arrow, names = to_arrow_schema(schema), own.columns
    keys = [names.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, begin
        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(row[k] for k in keys)
                if key != last:
                    last, state = key, begin
                state, out = step(state, row)
                made.append(out)
            columns = list(zip(*made, strict=True)) or [()] * len(new.names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, arrow.field(len(names) + k).type) for k, c in enumerate(columns)]], schema=arrow)

    return own.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def in_blocks(df: DataFrame, work: Callable[[DataFrame], DataFrame], order: list[str], before: int, after: int = 0, size: int = 1_000_000, by: str = "series_id") -> DataFrame:
    """work(df), for an operator whose row needs at most `before` rows of its series before it and `after` behind it, in blocks of `size` rows.

    work sees each block as a series of its own, with copies of the rows around it, and must keep the other columns of its rows; the copies'
    rows are dropped after. Equal to work(df) but for the order of rows.
    """
    if max(before, after) > size:
        raise ValueError("a block must be at least as long as what its rows need around them")
    k = F.col("__k")
    block = F.floor(k / size)
    far = F.array_compact(F.array(block, F.when(k % size >= size - before, block + 1), F.when((k % size < after) & (block > 0), block - 1)))
    rows = numbered(df, [by], order, "__k").withColumn("__block", F.explode(far))
    rows = rows.withColumn(by, F.struct(F.col(by).alias("id"), "__block"))
    done = work(rows).filter(F.col("__block") == block)
    return done.withColumn(by, F.col(f"{by}.id")).drop("__k", "__block")


def drawdowns(net: DataFrame, by: str = "series_id", order: str = "seq", value: str = "net") -> DataFrame:
    """by, max_drawdown: the largest fall of the running sum from its highest so far (its first value included). A range's state is its sum, its
    highest and lowest running sum, and its own largest fall; null values add nothing."""
    rows = ranged(net.select(by, order, value), [by], [order])
    here = W.partitionBy(by, RANGE).orderBy(PLACE).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__eq", F.sum(value).over(here)).withColumn("__fall", F.max("__eq").over(here) - F.col("__eq"))
    states = rows.groupBy(by, RANGE).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"), F.max("__eq").alias("high"), F.min("__eq").alias("low"), F.max("__fall").alias("fall"))
    past = W.partitionBy(by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    states = states.withColumn("start", F.coalesce(F.sum("sum").over(past), F.lit(0.0)))
    states = states.withColumn("top", F.max(F.col("start") + F.col("high")).over(past))
    return states.groupBy(by).agg(F.max(F.greatest("fall", F.col("top") - (F.col("start") + F.col("low")))).alias("max_drawdown"))


def earlier_below(rank: np.ndarray) -> np.ndarray:
    """For each place of a permutation how many earlier places have a lower rank: bit by bit, as in a wavelet matrix."""
    n = len(rank)
    out, at = np.zeros(n, np.int64), np.arange(n)
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        r = rank[at]
        one, group = (r >> bit & 1).astype(bool), r >> (bit + 1)
        zeros = np.cumsum(~one) - ~one
        first = np.append(True, group[1:] != group[:-1])
        base = zeros[np.flatnonzero(first)][np.cumsum(first) - 1]
        out[at[one]] += (zeros - base)[one]
        at = at[np.argsort(r >> bit, kind="stable")]
    return out


def earlier(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value how many before it are lower, and how many are lower or equal."""
    n, time = len(values), np.arange(len(values))
    lower, upto = np.empty(n, np.int64), np.empty(n, np.int64)
    lower[np.lexsort((-time, values))] = time
    upto[np.lexsort((time, values))] = time
    return earlier_below(lower), earlier_below(upto)


def expanding_ranks(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """df (keys and value not null) with k, the row's number in its key, and below and upto: how many earlier rows have a lower, and a lower or equal value.

    Rows are dealt by ranges of time and by ranges of value. Earlier rows are those of the same range of time, counted there; those of earlier
    ranges of time and lower ranges of value, by sums over a table of how many rows two ranges share; and those of earlier ranges
    of time and the same range of value, counted there. So no task has more than a range, however long a series is; equal values are
    one range.
    """
    names = df.columns
    timed = numbered(df.drop("k"), by, order, "k", ranged(df.drop("k"), by, order)).withColumnRenamed(RANGE, "__t").drop(PLACE)
    both = ranged(timed, by, [value]).withColumnRenamed(RANGE, "__v").drop(PLACE)

    def counted(rows: DataFrame, group: list[str], sort: list[str], within: str | None, out: tuple[str, str]) -> DataFrame:
        """rows with how many rows before them by `sort` have a lower value in their group; with `within`, only rows of earlier values of it."""
        schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in out]])
        arrow = to_arrow_schema(schema)
        take = [*sort, value] if within is None else [within, *sort, value]

        def run(table: pa.Table) -> pa.Table:
            # keys of the order, the values last
            columns = [table.column(c).to_numpy(zero_copy_only=False) for c in take]
            at = np.lexsort(tuple(columns[:-1][::-1]))
            x = columns[-1][at]
            lower, upto = earlier(x)
            if within is not None:  # leave out what is of the same range of time: it comes from the same rank inside each of them
                w = columns[0][at]
                for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.append(True, w[1:] != w[:-1])), len(w))), strict=True):
                    own = earlier(x[a:b])
                    lower[a:b] -= own[0]
                    upto[a:b] -= own[1]
            back = np.empty(len(at), np.int64)
            back[at] = np.arange(len(at))
            return pa.table([*table.columns, pa.array(lower[back]), pa.array(upto[back])], schema=arrow)

        return rows.groupBy(*group).applyInArrow(run, schema)

    near = counted(both, [*by, "__t"], ["k"], None, ("__b0", "__u0"))
    here = counted(near, [*by, "__v"], ["k"], "__t", ("__b1", "__u1"))
    shared = both.groupBy(*by, "__t", "__v").agg(F.count("*").alias("c"))
    # by time within a range of value, then by value within a range of time
    grid = shared.select(*by, "__t").distinct().join(shared.select(*by, "__v").distinct(), by).join(shared, [*by, "__t", "__v"], "left").fillna(0, ["c"])
    grid = grid.withColumn("e", F.coalesce(F.sum("c").over(W.partitionBy(*by, "__v").orderBy("__t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    grid = grid.withColumn("far", F.coalesce(F.sum("e").over(W.partitionBy(*by, "__t").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = here.join(grid.select(*by, "__t", "__v", "far"), [*by, "__t", "__v"])
    return out.select(*names, "k", (F.col("__b0") + F.col("__b1") + F.col("far")).alias("below"), (F.col("__u0") + F.col("__u1") + F.col("far")).alias("upto"))
