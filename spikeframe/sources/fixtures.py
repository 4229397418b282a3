"""The driver's tables as signals and spike trains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Centre and scale of the four lineitem channels.
CHANNELS = (("l_quantity", 25.5, 14.4), ("l_extendedprice", 45000.0, 31500.0), ("l_discount", 0.05, 0.0316), ("l_tax", 0.04, 0.0258))
EXT_FACT, BATCH, DIST, MULT = 4, 100, 5, 3
#: Seconds in a sample of the event trains.
TICK = 600


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as four-channel recordings, one for each supplier."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("string").alias("recording_id"),
        (F.row_number().over(order) - 1).cast("long").alias("sample_idx"),
        F.array(*[(F.col(c) - mid) / scale for c, mid, scale in CHANNELS]).alias("channels"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 64-channel recordings, one for each label."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("label").cast("string").alias("recording_id"),
        (F.row_number().over(order) - 1).cast("long").alias("sample_idx"),
        F.col("embedding").cast("array<double>").alias("channels"),
    )


def firing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as spikes (recording_id, source, unit, t): t in seconds, one row for each unit and time."""
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select(
            F.pmod("user_id", F.lit(16)).cast("string").alias("recording_id"),
            F.col("event_type").alias("source"),
            F.col("user_id").alias("unit"),
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        )
        .distinct()
    )


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as spikes on a grid of TICK seconds (recording_id, source, unit, sample_idx)."""
    times = firing_times(spark, sf_dir)
    return times.select("recording_id", "source", "unit", F.floor(F.col("t") / TICK).cast("long").alias("sample_idx")).distinct()
