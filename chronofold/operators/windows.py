"""Windows over a history's time line.

All take the columns that identify a history, so that histories run in
parallel, and order equal times by a tie-breaking column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions.scalars import haversine_m

# Fixed values.
GAP_S = 600
CAP_S = 21_600
DEFAULT_EXTENSION_S = 60
FRAGMENT_RATIO = 0.4
FRAGMENT_MEDIAN_S = 30
FRAGMENT_GROUP = 20


def over(keys: list[str], *order) -> W:
    return W.partitionBy(*keys).orderBy(*order)


def gap_islands(df: DataFrame, keys: list[str], ts: str, tie: str, gap_s: int = GAP_S, into: str = "island") -> DataFrame:
    """Number runs of rows whose neighbours are at most ``gap_s`` apart, from 1 in each history."""
    w = over(keys, ts, tie)
    opens = F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap_s).cast("int"), F.lit(1))
    return df.withColumn("_opens", opens).withColumn(into, F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_opens")


def _lasting(total: Column, n: Column) -> Column:
    """How long the last observation of a window is taken to last: the mean positive step, 1 to 60 s, by default 60."""
    return F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(60.0), total / F.when(n > 0, n))), F.lit(float(DEFAULT_EXTENSION_S)))


def observation_windows(df: DataFrame, keys: list[str], ts: str, tie: str, gap_s: int = GAP_S, cap_s: int | None = CAP_S) -> DataFrame:
    """Windows of observations: keys, start_ts, end_ts, n.

    A window closes at a gap, or once it has lasted ``cap_s``; those of a
    single observation go. Where a window ends at its cap depends on where it
    opened, so capped ones are cut out of sorted rows one after another, and a
    task holds one window.
    """
    rows = df.select(*keys, F.col(ts).cast("bigint").alias("_ts"), tie)
    if cap_s is None:
        held = gap_islands(rows, keys, "_ts", tie, gap_s).withColumn("_d", F.col("_ts") - F.lag("_ts").over(over([*keys, "island"], "_ts", tie)))
        steps = F.when(F.col("_d") > 0, F.col("_d"))
        out = held.groupBy(*keys, "island").agg(F.min("_ts").alias("start_ts"), F.max("_ts").alias("_last"), F.sum(steps).alias("_sum"), F.count(steps).alias("_steps"), F.count("*").alias("n"))
    else:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), "start_ts bigint, _last bigint, _sum bigint, _steps bigint, n bigint"])
        out = rows.repartition(*keys).sortWithinPartitions(*keys, "_ts", tie).select(*keys, "_ts").mapInArrow(_capped(len(keys), gap_s, cap_s), schema)
    return out.where("n > 1").select(*keys, "start_ts", (F.col("_last") + _lasting(F.col("_sum"), F.col("_steps"))).alias("end_ts"), "n")


def _capped(n_keys: int, gap_s: int, cap_s: int):
    """An Arrow function from rows of keys and time, sorted, to windows: keys, first and last time, sum and number of positive steps, rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None

        def windows(rows: pa.RecordBatch, final: bool) -> tuple[pa.RecordBatch, int]:
            t = rows.column(n_keys).to_numpy(zero_copy_only=False)
            step = np.diff(t)
            new = step > gap_s
            for k in range(n_keys):
                x = rows.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new |= np.diff(x) != 0
            ends = np.concatenate([np.flatnonzero(new) + 1, [len(t)]])
            starts, at = [], 0
            for end in ends.tolist():
                while at < end:
                    starts.append(at)
                    at += int(np.searchsorted(t[at:end], t[at] + cap_s))
            done = len(starts) if final else len(starts) - 1
            bounds = np.array([*starts, len(t)])
            first, last = bounds[:done], bounds[1 : done + 1] - 1
            risen = np.concatenate([[0], np.cumsum(np.maximum(step, 0))])
            rises = np.concatenate([[0], np.cumsum(step > 0)])
            picked = rows.take(pa.array(first))
            numbers = (t[first], t[last], risen[last] - risen[first], rises[last] - rises[first], last - first + 1)
            out = pa.RecordBatch.from_arrays([*picked.columns[:n_keys], *(pa.array(x, pa.int64()) for x in numbers)], [*picked.schema.names[:n_keys], "start_ts", "_last", "_sum", "_steps", "n"])
            return out, int(bounds[done])

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if left is None else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            out, at = windows(rows, False)
            left = rows.slice(at)
            yield out
        if left is not None and len(left):
            yield windows(left, True)[0]

    return cut


def fragmented(df: DataFrame, keys: list[str], duration: str, least: int = 2) -> DataFrame:
    """Groups of fragments: many rows without duration, or many short ones; rows n, n_empty, median_s, is_fragmented."""
    n, empty = F.count("*"), F.count_if(F.col(duration) <= 0)
    out = df.groupBy(*keys).agg(n.alias("n"), empty.alias("n_empty"), F.median(duration).cast("double").alias("median_s"))
    ratio = (F.col("n") >= least) & (F.col("n_empty") / F.col("n") >= FRAGMENT_RATIO)
    short = (F.col("n") >= FRAGMENT_GROUP) & (F.col("median_s") < FRAGMENT_MEDIAN_S)
    return out.withColumn("is_fragmented", ratio | short)


def fragment_windows(df: DataFrame, keys: list[str], start: str, end: str, anchor: str, tie: str, gap_s: int = GAP_S) -> DataFrame:
    """Runs of fragments between anchors: history, start_ts, end_ts, n.

    A run ends at an anchor, and where the next fragment begins more than
    ``gap_s`` after the start and the end of the one before. It lasts to the
    latest end, or 60 s beyond the last fragment without duration.
    """
    w = over(keys, start, tie)
    before = F.greatest(F.lag(start).over(w), F.lag(end).over(w))
    flush = F.col(anchor) | F.coalesce(F.lag(anchor).over(w), F.lit(True)) | (F.col(start) - before > gap_s)
    runs = df.withColumn("_f", flush.cast("int")).withColumn("_run", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0))).where(~F.col(anchor))
    last = F.when(F.col(end) <= F.col(start), F.col(start) + 60).otherwise(F.col(end))
    return runs.groupBy(*keys, "_run").agg(F.min(start).alias("start_ts"), F.max(last).alias("end_ts"), F.count("*").alias("n")).drop("_run")


def path_length(df: DataFrame, keys: list[str], ts: str, tie: str, lat: str, lon: str) -> DataFrame:
    """Metres along the points of a history in order of time."""
    w = over(keys, ts, tie)
    step = haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon)
    return df.withColumn("_step", step).groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path_m"))


def typical_interval_s(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Median step of up to 600 s between observations, 1 to 300, by default 60."""
    step = F.col(ts) - F.lag(ts).over(over(keys, ts, tie))
    held = df.withColumn("_step", step)
    middle = F.median(F.when((F.col("_step") > 0) & (F.col("_step") <= GAP_S), F.col("_step")))
    return held.groupBy(*keys).agg(F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(300.0), middle)), F.lit(60.0)).alias("interval_s"))


def neighbours(df: DataFrame, keys: list[str], ts: str, tie: str, columns: list[str]) -> DataFrame:
    """``columns`` of the rows before and after, as previous_* and next_*."""
    w = over(keys, ts, tie)
    return df.select("*", *(F.lag(x).over(w).alias(f"previous_{x}") for x in columns), *(F.lead(x).over(w).alias(f"next_{x}") for x in columns))


def gaps_between(df: DataFrame, keys: list[str], start: str, end: str, kind: str, tie: str, of: str) -> DataFrame:
    """The time between a row of kind ``of`` and the next row, if that is of the same kind and begins later."""
    w = over(keys, start, tie)
    out = df.withColumn("_next", F.lead(start).over(w)).withColumn("_kind", F.lead(kind).over(w))
    return out.where((F.col(kind) == of) & (F.col("_kind") == of) & (F.col("_next") > F.col(end))).select(*keys, F.col(end).alias("start_ts"), F.col("_next").alias("end_ts"))


def first_last(df: DataFrame, keys: list[str], ts: str, tie: str, column: str) -> DataFrame:
    """The first and the last non-null value of a column in order of time."""
    there = F.when(F.col(column).isNotNull(), F.struct(ts, tie))
    return df.groupBy(*keys).agg(F.min_by(column, there).alias(f"first_{column}"), F.max_by(column, there).alias(f"last_{column}"))


def floor_index(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """(keys, value): of the non-null values of a group in ascending order the one at floor((n - 1) * p)."""
    there = df.where(F.col(value).isNotNull())
    ranked = there.select(*keys, value, F.row_number().over(over(keys, value)).alias("_r"), F.count("*").over(W.partitionBy(*keys)).alias("_n"))
    return ranked.where(F.col("_r") == F.floor((F.col("_n") - 1) * p) + 1).select(*keys, value)


def median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the middle of the non-null values, of two the mean; null where there is none."""
    return df.groupBy(*keys).agg(F.median(value).alias(value))


def dominant(df: DataFrame, keys: list[str], mode: str, rank: str | None = None) -> DataFrame:
    """The most frequent mode of the rows with the strongest evidence; of equals the first in the alphabet."""
    if rank is not None:
        df = df.withColumn("_top", F.max(rank).over(W.partitionBy(*keys))).where(F.col(rank) == F.col("_top"))
    counted = df.where(F.col(mode).isNotNull()).groupBy(*keys, mode).agg(F.count("*").alias("n"))
    best = counted.withColumn("_r", F.row_number().over(over(keys, F.desc("n"), mode)))
    return best.where("_r = 1").select(*keys, mode, "n")
