"""Queries of the streaming forms, over file streams of the same signals as the batch queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adapt as ad
from ..operators import packed
from ..sources import fixtures as fx
from ..sources import recordings as rec
from ..sources.storage import shared_folder
from ..streaming import online
from . import adaptive as pa
from .common import r6

QUERIES, ORACLES = {}, {}
ARRIVING = "recording_id string, sample_idx long, channels array<double>, ts timestamp"
#: Parts that a signal arrives in, and parts of a trigger.
ARRIVALS, PER_TRIGGER = 8, 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _arrivals(signal: DataFrame) -> DataFrame:
    """The signal with event times, and the part that each sample arrives in: stretches of 37 samples out of order."""
    stretch = F.floor(F.col("sample_idx") / 37)
    at = F.timestamp_micros((F.lit(1_700_000_000_000_000) + F.col("sample_idx") * int(1e6 / pa.FS)).cast("long"))
    return signal.select("recording_id", "sample_idx", "channels", at.alias("ts"), F.pmod(stretch * 5 + F.crc32("recording_id"), F.lit(ARRIVALS)).alias("part"))


def _streamed(spark: SparkSession, signal: DataFrame, make: Callable[[DataFrame], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """What make(stream) puts out when the signal comes out of order, over several triggers, with a restart in between.

    At the end a row of another recording moves the clock on.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a file of each part from each task, so that parts go on as they lie; a part of a recording stays together
    sorted_rows = _arrivals(signal).sortWithinPartitions("part", "recording_id", "sample_idx")
    sorted_rows.write.partitionBy("part").parquet(f"{folder}/arrivals")
    rows = spark.read.schema(f"{ARRIVING}, part int").parquet(f"{folder}/arrivals")
    files = spark.sparkContext.defaultParallelism
    clock = spark.range(1).select(F.lit("clock").alias("recording_id"), F.lit(0).cast("long").alias("sample_idx"), F.array(F.lit(0.0)).alias("channels"), (F.timestamp_micros(F.lit(1_700_000_000_000_000)) + F.expr("interval 1 day")).alias("ts"))
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    online.state_store(spark)
    schema, there = None, 0
    try:
        for half in (range(ARRIVALS // 2), range(ARRIVALS // 2, ARRIVALS)):
            for part in half:
                rows.where(F.col("part") == part).drop("part").coalesce(files).write.mode("append").parquet(f"{folder}/in")
            arrived = len(spark.read.schema(ARRIVING).parquet(f"{folder}/in").inputFiles())
            schema = _run(spark, folder, make, partition_by, -(-(arrived - there) * PER_TRIGGER // len(half)))
            there = arrived
        clock.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        _run(spark, folder, make, partition_by, 1)
    finally:
        if store:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return rec.read_stream(spark, f"{folder}/out", schema)


def _run(spark: SparkSession, folder: str, make: Callable[[DataFrame], DataFrame], partition_by: tuple[str, ...], per_trigger: int):
    stream = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/in")
    rows = make(stream)
    rec.write_stream(rows, f"{folder}/out", f"{folder}/checkpoint", partition_by).awaitTermination()
    return rows.schema


@query(pa.ORACLES["filter_bandpass"])
def stream_filter(spark, d):
    sig = fx.signal(spark, d)
    return pa._out(_streamed(spark, sig, lambda s: online.filter_stream(s, pa._BAND, pa.FS)))


def _online(spark: SparkSession, d: str) -> DataFrame:
    sig, start, units = pa.start_model(spark, d)
    return _streamed(spark, sig, lambda s: online.decompose_stream(s, start, units, pa.PARAMS, pa.FS, snapshots=4), ("kind",))


@query(pa.ADAPTED_SPIKES)
def decompose_stream(spark, d):
    """The rows of decompose_adaptive, from the stream."""
    out = _online(spark, d).where("kind = 'unit'")
    return out.select("recording_id", "unit", "batch_idx", F.explode("spikes").alias("sample_idx"))


@query(pa.TRAJECTORY)
def stream_trajectory(spark, d):
    """The rows of param_trajectory, as the stream writes them."""
    units, _ = online.trajectory(_online(spark, d))
    return units.select("recording_id", "version", "unit", r6("base_centr").alias("base_centr"), r6("spikes_centr").alias("spikes_centr"))


@query(pa.ADAPTED_SPIKES)
def replay_snapshots(spark, d):
    """The rows of decompose_adaptive again, from the stored snapshots of every third batch."""
    packs, start, units = pa.start_packed(spark, d)
    ran = ad.decompose_adaptive(packs, start, units, pa.PARAMS, snapshots=3)
    out = ad.replay(packed.unpack(packs), start, units, ran["model_whitening"], ran["model_units"], pa.PARAMS)
    return out["spikes"].select("recording_id", "unit", "batch_idx", "sample_idx")


@query(pa.ADAPTED_SPIKES)
def adaptive_by_units(spark, d):
    """The rows of decompose_adaptive, each unit in a task of its own."""
    out = ad.decompose_adaptive(*pa.start_packed(spark, d), pa.PARAMS, units_per_task=1)
    return out["spikes"].select("recording_id", "unit", "batch_idx", "sample_idx")
