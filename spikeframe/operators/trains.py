"""Firing statistics of spike trains and quality of their sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hann
from . import packed
from .frames import in_runs, values_at_spikes
from .peaks import local_maxima_long

UNIT = ("recording_id", "source", "unit")


def spike_count(spikes: DataFrame, units: DataFrame, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """n_spikes of every unit in units, 0 for a silent one."""
    counts = spikes.groupBy(*keys).agg(F.count("*").alias("n"))
    return units.join(counts, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n_spikes"))


def isi(spikes: DataFrame, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """(keys, t, isi): time since the unit's spike before."""
    order = Window.partitionBy(*keys).orderBy("t")
    gaps = spikes.withColumn("isi", F.col("t") - F.lag("t").over(order))
    return gaps.where(F.col("isi").isNotNull()).select(*keys, "t", "isi")


def discharge_rate(spikes: DataFrame, gap: float = 0.25, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """Spikes per active second: the span without the intervals above gap.

    0 for a unit whose spikes span no time; NULL where every interval is above gap.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    gaps = spikes.withColumn("isi", F.col("t") - F.lag("t").over(order))
    sums = gaps.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), F.sum(F.when(F.col("isi") <= gap, F.col("isi"))).alias("active"))
    rate = F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.col("n") / F.nullif("active", F.lit(0.0)))
    return sums.select(*keys, rate.alias("discharge_rate"))


def isi_cov(spikes: DataFrame, gap: float = 0.25, min_isi: float | None = None, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """100 times deviation over mean of the intervals below gap (and from min_isi on, if given)."""
    used = isi(spikes, keys).where(F.col("isi") < gap)
    if min_isi is not None:
        used = used.where(F.col("isi") >= min_isi)
    return used.groupBy(*keys).agg((100 * F.stddev_pop("isi") / F.nullif(F.avg("isi"), F.lit(0.0))).alias("isi_cov"))


def inst_discharge_rate(spikes: DataFrame, lengths: DataFrame, fs: int, keys: tuple[str, ...] = UNIT, block: int = 1 << 14) -> DataFrame:
    """(keys, sample_idx, rate) where not zero: twice the spikes smoothed by a window of one second.

    lengths (recording_id, n_samples) crops the ends. A spike goes to the blocks of samples that its
    window reaches; a block adds up its spikes' windows.
    """
    size = round(fs)
    middle, weights = (size - 1) // 2, np.array(hann(size))
    near = spikes.join(lengths, "recording_id").withColumn("__from", F.col("sample_idx") - middle)
    reach = F.sequence(F.floor(F.greatest("__from", F.lit(0)) / block), F.floor(F.least(F.col("__from") + size - 1, F.col("n_samples") - 1) / block))
    near = near.where((F.col("__from") < F.col("n_samples")) & (F.col("__from") + size > 0)).select(*keys, "n_samples", "__from", F.explode(reach).alias("__block"))

    def smooth(group):
        first = int(group["__block"][0]) * block
        n = min(block, int(group["n_samples"][0]) - first)
        total = np.zeros(n)
        for at in group["__from"] - first:
            a, b = max(at, 0), min(at + size, n)
            total[a:b] += weights[a - at : b - at]
        on = np.flatnonzero(total)
        yield *(group[k][0] for k in keys), first + on, 2 * total[on]

    schema = ", ".join(f"`{n}` {t}" for n, t in near.select(*keys).dtypes)
    made = in_runs(near, (*keys, "__block"), "__from", smooth, f"{schema}, at array<long>, rates array<double>")
    return made.select(*keys, F.inline(F.arrays_zip(F.col("at").alias("sample_idx"), F.col("rates").alias("rate"))))


def _levels(spikes: DataFrame, ipts: DataFrame, ext_fact: int) -> tuple[DataFrame, DataFrame]:
    """Squares at the spikes, and the mean square of the baseline (b): peaks no higher than the lowest spike,
    or without any the samples that are no spikes; both after the first ext_fact samples.

    ipts may be rows of packed.SOURCE, the spikes then bring their sources (packed.FOUND)."""
    keys = ["recording_id", "unit"]
    late = F.col("sample_idx") >= ext_fact + 1
    if "ipts" in ipts.columns:
        at = spikes.where(late & F.col("ipt").isNotNull()).select(*keys, "sample_idx", (F.col("ipt") * F.col("ipt")).alias("value"))
        lowest = at.groupBy(*keys).agg(F.min("value").alias("lowest"))
        return at, packed.baselines(ipts, lowest, spikes, ext_fact)
    at = values_at_spikes(ipts, spikes).where(late).select(*keys, "sample_idx", "value")
    lowest = at.groupBy(*keys).agg(F.min("value").alias("lowest"))
    squares = ipts.select(*keys, "sample_idx", (F.col("ipt") * F.col("ipt")).alias("value"))
    low = local_maxima_long(squares, "value", tuple(keys)).join(lowest, keys).where(F.col("value") <= F.col("lowest")).drop("lowest")
    bare = lowest.select(*keys).join(low.select(*keys).distinct(), keys, "left_anti")
    rest = squares.join(bare, keys).join(spikes.select(*keys, "sample_idx"), [*keys, "sample_idx"], "left_anti")
    base = low.select(*keys, "sample_idx", "value").unionByName(rest.select(*keys, "sample_idx", "value")).where(late)
    return at, base.groupBy(*keys).agg(F.avg("value").alias("b"))


def pulse_to_noise(spikes: DataFrame, ipts: DataFrame, ext_fact: int = 8) -> DataFrame:
    """20 log10 of the mean square at the spikes over that of the baseline."""
    at, b = _levels(spikes, ipts, ext_fact)
    keys = ["recording_id", "unit"]
    s = at.groupBy(*keys).agg(F.avg("value").alias("s"))
    return s.join(b, keys, "left").select(*keys, (20 * F.log10(F.col("s") / F.nullif("b", F.lit(0.0)))).alias("pnr"))


def silhouette(spikes: DataFrame, ipts: DataFrame, ext_fact: int = 8) -> DataFrame:
    """(db - ds) / max(db, ds): squared distances of the spikes' squares from the baseline's and from their own mean."""
    at, b = _levels(spikes, ipts, ext_fact)
    keys = ["recording_id", "unit"]
    s = at.groupBy(*keys).agg(F.avg("value").alias("s"))
    near = at.join(s, keys).join(b, keys, "left")
    d = lambda m: F.sum((F.col("value") - F.col(m)) * (F.col("value") - F.col(m)))
    sums = near.groupBy(*keys).agg(d("s").alias("ds"), d("b").alias("db"))
    most = F.greatest("ds", "db")
    value = F.when(most == 0, F.lit(0.0)).otherwise((F.col("db") - F.col("ds")) / F.nullif(most, F.lit(0.0)))
    return sums.select(*keys, F.when(F.col("db").isNotNull(), value).alias("silhouette"))
