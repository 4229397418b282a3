"""Summaries of metrics, comparison of runs and of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lower_median, nan_median, nan_sum, valid

__all__ = ["compare_runs", "lower_median", "nan_median", "nan_sum", "objective", "objective_of_steps", "param_diff", "same_pairing", "summarise", "valid"]

#: What a missing whitening loss costs in the objective.
MISSING = 1e10


def summarise(df: DataFrame, col: str, by: list[str], sample: bool = False) -> DataFrame:
    """mean, std (of the population, or of a sample) and median of a metric, missing ones left out."""
    v = valid(col)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) if sample else F.stddev_pop(v)).alias("std"), F.percentile(v, 0.5).alias("median"))


def objective(batches: DataFrame, units: DataFrame, by: list[str]) -> DataFrame:
    """What a search maximises: less the median whitening loss (1e10 if one is missing) and the median separation loss."""
    wh = batches.groupBy(*by).agg(F.coalesce(lower_median("wh_loss"), F.lit(MISSING)).alias("wh"))
    sv = units.groupBy(*by).agg(nan_median("sv_loss").alias("sv"))
    return wh.join(sv, by, "left").select(*by, (-F.col("wh") - F.coalesce("sv", F.lit(0.0))).alias("objective"))


def objective_of_steps(steps: DataFrame, by: list[str]) -> DataFrame:
    """objective, of rows of batches (unit null, wh_loss) and of units (sv_loss) in one table, in one aggregation."""
    batch = F.col("unit").isNull()
    there = F.count(F.when(batch, valid("wh_loss"))) == F.count(F.when(batch, F.lit(1)))
    median = lambda value: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")
    wh = F.when(there, median("CASE WHEN unit IS NULL THEN wh_loss END"))
    sv = median("CASE WHEN unit IS NOT NULL AND NOT isnan(sv_loss) THEN sv_loss END")
    return steps.groupBy(*by).agg((-F.coalesce(wh, F.lit(MISSING)) - F.coalesce(sv, F.lit(0.0))).alias("objective"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, a, b, diff) of a metric in two runs; rows of only one run stay."""
    left, right = a.select(*keys, F.col(col).alias("a")), b.select(*keys, F.col(col).alias("b"))
    return left.join(right, keys, "full").withColumn("diff", F.col("b") - F.col("a"))


def param_diff(a: DataFrame, b: DataFrame, keys: list[str], col: str = "w") -> DataFrame:
    """(keys, pos, diff, most): differences of vectors by element, and the largest one's size in the recording."""
    cells = lambda df, name: df.select(*keys, F.posexplode(col).alias("pos", name))
    diffs = cells(a, "a").join(cells(b, "b"), [*keys, "pos"]).select(*keys, "pos", (F.col("b") - F.col("a")).alias("diff"))
    most = diffs.groupBy("recording_id").agg(F.max(F.abs("diff")).alias("most"))
    return diffs.join(most, "recording_id")


def same_pairing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(recording_id, same): whether both hold the same pairs."""
    side = lambda df, v: df.select("recording_id", *keys, F.lit(v).alias("side"))
    both = side(a, 1).unionByName(side(b, -1)).groupBy("recording_id", *keys).agg(F.sum("side").alias("net"))
    return both.groupBy("recording_id").agg(F.bool_and(F.col("net") == 0).alias("same"))
