"""Slices, selections, batches and delays of signals and spike tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples in a block of a recording; what looks back gets the rows it needs from the block before.
BLOCK = 1 << 16
#: Bytes of arrays in rows that a task puts out together.
OUT_BYTES = 1 << 24


def slice_time(df: DataFrame, start: float, stop: float, fs: float) -> DataFrame:
    """Rows from start (included) to stop (not) in seconds; reaches the scan as a filter."""
    return df.where((F.col("sample_idx") >= int(start * fs)) & (F.col("sample_idx") < int(stop * fs)))


def select_units(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of the units in mapping (recording_id, unit, to_unit), renamed."""
    return df.join(mapping, ["recording_id", "unit"]).withColumn("unit", F.col("to_unit")).drop("to_unit")


def reorder_channels(df: DataFrame, order: Column) -> DataFrame:
    """Channels in the order of an array of positions."""
    return df.withColumn("channels", F.transform(order, lambda i: F.get(F.col("channels"), i)))


def values_at_spikes(ipts: DataFrame, spikes: DataFrame) -> DataFrame:
    """ipts rows at the spikes of the same recording and unit, with the square as value."""
    keys = ["recording_id", "unit", "sample_idx"]
    return ipts.join(spikes.select(*keys), keys).withColumn("value", F.col("ipt") * F.col("ipt"))


def every_nth(df: DataFrame, n: int, col: str = "batch_idx") -> DataFrame:
    return df.where(F.col(col) % n == 0)


def trim_warmup(df: DataFrame, ext_fact: int) -> DataFrame:
    """Without the samples whose delays reach before the recording."""
    return df.where(F.col("sample_idx") >= ext_fact)


def trim_edges(df: DataFrame, head: int = 1, tail: int = 1) -> DataFrame:
    """Without the first and last batches of each recording."""
    ends = df.groupBy("recording_id").agg(F.max("batch_idx").alias("__last"))
    near = df.join(ends, "recording_id")
    return near.where((F.col("batch_idx") >= head) & (F.col("batch_idx") <= F.col("__last") - tail)).drop("__last")


def assign_batches(df: DataFrame, size: int | Column, drop_last: bool = False) -> DataFrame:
    """batch_idx by counts of ``size`` samples; drop_last leaves out batches that are not full."""
    out = df.withColumn("batch_idx", F.floor(F.col("sample_idx") / size).cast("long"))
    if not drop_last:
        return out
    full = out.groupBy("recording_id", "batch_idx").agg(F.count("*").alias("__n"), F.first(F.lit(size)).alias("__size"))
    return out.join(full.where(F.col("__n") == F.col("__size")).select("recording_id", "batch_idx"), ["recording_id", "batch_idx"])


def complete_outputs(samples: DataFrame, ipts: DataFrame, units: DataFrame) -> DataFrame:
    """A row for each sample and unit; what was trimmed is zero."""
    grid = samples.select("recording_id", "sample_idx").join(units.select("recording_id", "unit"), "recording_id")
    return grid.join(ipts, ["recording_id", "unit", "sample_idx"], "left").withColumn("ipt", F.coalesce("ipt", F.lit(0.0)))


def remove_offset(df: DataFrame) -> DataFrame:
    """Channels less their mean over the recording, and the means as ``offset``."""
    means = offsets(df)
    near = df.join(means, "recording_id")
    return near.withColumn("channels", F.zip_with("channels", "offset", lambda a, b: a - b))


def offsets(df: DataFrame) -> DataFrame:
    """(recording_id, offset): the mean of each channel, from partial sums by channel."""
    cells = df.select("recording_id", F.posexplode("channels").alias("channel", "value"))
    means = cells.groupBy("recording_id", "channel").agg(F.avg("value").alias("mean"))
    pairs = F.array_sort(F.collect_list(F.struct("channel", "mean")))
    return means.groupBy("recording_id").agg(F.transform(pairs, lambda p: p["mean"]).alias("offset"))


def with_history(df: DataFrame, depth: int, keys: tuple[str, ...] = ("recording_id",), block: int = BLOCK) -> DataFrame:
    """df with (block, halo): the last ``depth`` rows of a block are also in the next, as halo.

    A window over (keys, block) then sees ``depth`` rows back, and no task holds more
    than a block of a recording. Rows of the halo go after use.
    """
    at = F.floor(F.col("sample_idx") / block)
    own = F.struct(at.alias("block"), F.lit(False).alias("halo"))
    also = F.struct((at + 1).alias("block"), F.lit(True).alias("halo"))
    places = F.when(F.col("sample_idx") % block >= block - depth, F.array(own, also)).otherwise(F.array(own))
    return df.withColumn("__at", F.explode(places)).select(*df.columns, "__at.block", "__at.halo")


def extend_delays(df: DataFrame, ext_fact: int, block: int = BLOCK) -> DataFrame:
    """df with x: for delays 0 to ext_fact-1 the channels so many samples before, zeros before the start."""
    order = Window.partitionBy("recording_id", "block").orderBy("sample_idx")
    zeros = F.transform("channels", lambda _: F.lit(0.0))
    delayed = [F.col("channels")] + [F.coalesce(F.lag("channels", i).over(order), zeros) for i in range(1, ext_fact)]
    rows = with_history(df, ext_fact - 1, block=block).withColumn("x", F.flatten(F.array(*delayed)))
    return rows.where("not halo").drop("block", "halo")


def put_together(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as tables of about OUT_BYTES."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + sum(v.nbytes for v in row if isinstance(v, np.ndarray))
        if size > OUT_BYTES:
            yield pd.DataFrame(out, columns=names)
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=names)


def in_runs(df: DataFrame, keys: tuple[str, ...], order: str | None, make: Callable[[dict[str, np.ndarray]], Iterator[tuple]], schema: str) -> DataFrame:
    """make(columns) of each group of rows equal in ``keys``, by ``order``; it gives rows of ``schema``.

    Groups lie one after another in their partition and are cut out of its Arrow batches, so that a small group costs
    little more than its numbers. A group is held whole.
    """
    names = [c.strip().split(" ")[0].strip("`") for c in schema.split(", ")]

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
        held: list[dict[str, np.ndarray]] = []
        whole = lambda: {c: np.concatenate([part[c] for part in held]) for c in held[0]} if len(held) > 1 else held[0]
        for pdf in batches:
            if pdf.empty:
                continue
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            change = np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(pdf)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and any(held[0][k][0] != cols[k][a] for k in keys):
                    yield whole()
                    held = []
                held.append({c: v[a:b] for c, v in cols.items()})
        if held:
            yield whole()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return put_together((row for group in groups(batches) for row in make(group)), names)

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *([order] if order else [])).mapInPandas(task, schema)
