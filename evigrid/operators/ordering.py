"""Ordered operators that survive a hot key.

A plain window puts every row of one key into one task. The operators here take a `bucket`, a column
that never decreases along the order, and work in two levels: a window inside (keys, bucket), and a
window over one summary row per bucket whose result is joined back. The rows of a hot key are spread
over its buckets; only the summaries of one key meet in one task.

First-per-key and top-k per key need no bucket: Spark keeps the best k rows of every key in each map
task before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "_rank") -> DataFrame:
    """Best k rows of every key, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(_ordered(keys, order))).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1).drop("_rank")


def _carry(df: DataFrame, keys: Sequence[str], summary: Sequence[Column], carried: dict[str, Column]) -> DataFrame:
    """Join, to every row, what the earlier buckets of its key add up to."""
    on = [*keys, "__bucket"]
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carries = df.groupBy(*on).agg(*summary).select(*on, *[c.over(before).alias(n) for n, c in carried.items()])
    return df.join(carries, on)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None, rank: str) -> DataFrame:
    """row_number from 1 along `order`; without a bucket the group is taken to be bounded."""
    if bucket is None:
        return df.withColumn(rank, F.row_number().over(_ordered(keys, order)))
    marked = df.withColumn("__bucket", bucket)
    marked = marked.withColumn(rank, F.row_number().over(_ordered([*keys, "__bucket"], order)))
    joined = _carry(marked, keys, [F.count(F.lit(1)).alias("_n")], {"__before": F.sum("_n")})
    return joined.withColumn(rank, F.col(rank) + F.coalesce("__before", F.lit(0))).drop("__bucket", "__before")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None,
                value: Column, out: str) -> DataFrame:
    """Inclusive running sum along a total order."""
    def inclusive(ks):
        return _ordered(ks, order).rowsBetween(Window.unboundedPreceding, 0)
    if bucket is None:
        return df.withColumn(out, F.sum(value).over(inclusive(keys)))
    marked = df.withColumn("__bucket", bucket).withColumn("_v", value)
    marked = marked.withColumn(out, F.sum("_v").over(inclusive([*keys, "__bucket"])))
    joined = _carry(marked, keys, [F.sum("_v").alias("_s")], {"__before": F.sum("_s")})
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(0)) + F.coalesce("__before", F.lit(0))).drop(
        "__bucket", "_v", "__before")


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None,
               values: dict[str, Column]) -> DataFrame:
    """For each named value the latest non-null one up to and including this row."""
    def inclusive(ks):
        return _ordered(ks, order).rowsBetween(Window.unboundedPreceding, 0)
    if bucket is None:
        return df.select("*", *[F.last(v, True).over(inclusive(keys)).alias(n) for n, v in values.items()])
    names = list(values)
    marked = df.withColumn("__bucket", bucket).select(
        "*", *[values[n].alias(f"_v_{n}") for n in names], F.struct(*order).alias("__order"))
    local = inclusive([*keys, "__bucket"])
    marked = marked.select("*", *[F.last(f"_v_{n}", True).over(local).alias(n) for n in names])
    summary = [F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("__order"))).alias(f"_l_{n}")
               for n in names]
    joined = _carry(marked, keys, summary, {f"_c_{n}": F.last(f"_l_{n}", True) for n in names})
    filled = {n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in names}
    return joined.withColumns(filled).drop("__bucket", "__order", *[f"_v_{n}" for n in names], *[f"_c_{n}" for n in names])


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None,
                 values: dict[str, Column]) -> DataFrame:
    """lag(1) of each named value; null on the first row of a key."""
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    if bucket is None:
        out = df.withColumn("__prev", F.lag(row).over(_ordered(keys, order)))
    else:
        marked = df.withColumn("__bucket", bucket).withColumn("__row", row).withColumn("__order", F.struct(*order))
        marked = marked.withColumn("__prev", F.lag("__row").over(_ordered([*keys, "__bucket"], order)))
        joined = _carry(marked, keys, [F.max_by("__row", "__order").alias("__last")], {"__carry": F.last("__last", True)})
        out = joined.withColumn("__prev", F.coalesce("__prev", "__carry")).drop("__bucket", "__row", "__order", "__carry")
    return out.withColumns({n: F.col(f"__prev.{n}") for n in values}).drop("__prev")


def next_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None,
             values: dict[str, Column]) -> DataFrame:
    """lead(1) of each named value; null on the last row of a key. `order` must be ascending."""
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    if bucket is None:
        out = df.withColumn("__next", F.lead(row).over(_ordered(keys, order)))
    else:
        marked = df.withColumn("__bucket", bucket).withColumn("__row", row).withColumn("__order", F.struct(*order))
        marked = marked.withColumn("__next", F.lead("__row").over(_ordered([*keys, "__bucket"], order)))
        on = [*keys, "__bucket"]
        after = Window.partitionBy(*keys).orderBy("__bucket")
        firsts = marked.groupBy(*on).agg(F.min_by("__row", "__order").alias("__first"))
        firsts = firsts.withColumn("__carry", F.lead("__first").over(after)).drop("__first")
        out = marked.join(firsts, on).withColumn("__next", F.coalesce("__next", "__carry")).drop(
            "__bucket", "__row", "__order", "__carry")
    return out.withColumns({n: F.col(f"__next.{n}") for n in values}).drop("__next")


_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _array(parts: list, kind: str) -> pa.Array:
    if all(isinstance(p, np.ndarray) for p in parts):
        return pa.array(np.concatenate(parts), _ARROW[kind])
    return pa.array([x for p in parts for x in p], _ARROW[kind])


def fold_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], start: Callable, step: Callable, out: dict[str, str]) -> DataFrame:
    """df with columns `out`, decided row after row along `order` with a state per key.

    Rows are dealt by key, sorted, and read as a stream of batches; `start()` gives the state of a key and `step(state, columns)` the new columns of the next
    rows of it, as arrays. The state passes from batch to batch, so a task holds one batch and one state, however many rows a key has.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` {t}" for n, t in out.items())])
    names, wide = list(keys), list(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            fresh = np.zeros(n, bool)
            for c in names:
                fresh[1:] |= columns[c].astype(object)[1:] != columns[c].astype(object)[:-1]
            cuts = [0, *np.flatnonzero(fresh).tolist(), n]
            parts: list[list] = [[] for _ in wide]
            for first, last in zip(cuts, cuts[1:], strict=False):
                key = tuple(columns[c][first] for c in names)
                if state is None or key != held:
                    held, state = key, start()
                for part, values in zip(parts, step(state, {c: v[first:last] for c, v in columns.items()}), strict=True):
                    part.append(values)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(_array(p, out[c]) for p, c in zip(parts, wide, strict=True))], [*batch.schema.names, *wide])

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(run, schema)
