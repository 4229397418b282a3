"""What the registered queries share: views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decompose, model, packed
from ..sources import fixtures as fx
from ..sources.storage import materialise

CH, EXT, BATCH, DIST, MULT, UNITS = len(fx.CHANNELS), fx.EXT_FACT, fx.BATCH, fx.DIST, fx.MULT, 3
SIZE = CH * EXT


def vector(unit: int) -> list[float]:
    """Separation vector of the fixture model, of length 1."""
    raw = [(7 * k + 3 * unit) % 11 - 5 for k in range(SIZE)]
    return [v / math.sqrt(sum(x * x for x in raw)) for v in raw]


VECTORS = [vector(u) for u in range(UNITS)]
#: The fixture's whitening is MIX times one over the channels' deviations: a full matrix for each recording.
MIX = [[float(i == k) + ((3 * i + 5 * k) % 7 - 3) / 20 for k in range(SIZE)] for i in range(SIZE)]
#: Rows of vectors times MIX, as the SQL uses them.
MIXED = [[sum(v[i] * MIX[i][k] for i in range(SIZE)) for k in range(SIZE)] for v in VECTORS]


def r6(col: str | Column) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def unit_rows(signal: DataFrame) -> DataFrame:
    """(recording_id, unit, w): the fixture's vectors for every recording."""
    rows = F.array(*[F.struct(F.lit(u).alias("unit"), F.array(*map(F.lit, v)).alias("w")) for u, v in enumerate(VECTORS)])
    return signal.select("recording_id").distinct().select("recording_id", F.inline(rows))


def whitening(signal: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """(recording_id, version, row_idx, w): the fixture's whitening over the extended sample, a full matrix; scales: the signal's, if known."""
    rows = F.array(*[F.struct(F.lit(i).alias("row_idx"), F.array(*map(F.lit, row)).alias("m")) for i, row in enumerate(MIX)])
    tiled = F.flatten(F.array_repeat("scale", EXT))
    each = (model.scales(signal, size=CH) if scales is None else scales).select("recording_id", tiled.alias("scale"), F.explode(rows).alias("r"))
    return each.select("recording_id", F.lit(0).cast("long").alias("version"), "r.row_idx", F.zip_with("r.m", "scale", lambda a, b: a * b).alias("w"))


def packs_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The signal's packs (written), and the scales of its recordings (recording_id, scale)."""
    packs = materialise(packed.pack(fx.signal(spark, sf_dir), EXT - 1, packed.block_of(BATCH)), "packs")
    return packs, materialise(packed.scales(packs), "scales")


def calibrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Packs of the signal, their scales, the frozen model (recording_id, unit, w, centroids, height) and its sources by batch (packed.SOURCE)."""
    packs, scales = packs_of(spark, sf_dir)
    rows = materialise(decompose.fuse(unit_rows(scales), whitening(packs, scales)), "model-rows")
    sources = materialise(packed.frozen_batches(packs, rows, EXT, BATCH), "sources")
    units = materialise(model.init_heights(rows.join(packed.centroids(sources), ["recording_id", "unit"])), "units")
    return packs, scales, units, sources


def fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signal, frozen model and its sources with batch_idx, warm-up trimmed, as rows of samples."""
    packs, _, units, sources = calibrated(spark, sf_dir)
    return packed.unpack(packs), units, packed.explode_sources(sources)


def frozen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model, its sources by batch, and the detected spikes (packed.FOUND)."""
    _, _, units, sources = calibrated(spark, sf_dir)
    return units, sources, materialise(packed.detect_spikes(sources, units, DIST, MULT), "spikes")


_CHANNELS = ", ".join(f"({c} - {mid!r}::DOUBLE) / {scale!r}::DOUBLE AS c{i}" for i, (c, mid, scale) in enumerate(fx.CHANNELS))
_ORDER = "PARTITION BY recording_id ORDER BY sample_idx"


def _ipt(unit: int) -> str:
    terms = []
    for k, w in enumerate(MIXED[unit]):
        i, c = divmod(k, CH)
        value = f"coalesce(lag(c{c}, {i}) OVER w, 0)" if i else f"c{c}"
        terms.append(f"({w!r}::DOUBLE * s{c}) * {value}")
    return " + ".join(terms)


SIG = f"""sig AS (
  SELECT l_suppkey::VARCHAR AS recording_id,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS sample_idx, {_CHANNELS}
  FROM lineitem)"""
SCALES = "sc AS (SELECT recording_id, " + ", ".join(f"coalesce(1.0::DOUBLE / nullif(stddev_pop(c{i}), 0), 0) AS s{i}" for i in range(CH)) + " FROM sig GROUP BY 1)"
IPTS = f"""{SIG}, {SCALES},
wide AS (
  SELECT recording_id, sample_idx, {", ".join(f"{_ipt(u)} AS i{u}" for u in range(UNITS))}
  FROM sig JOIN sc USING (recording_id) WINDOW w AS ({_ORDER})),
full_ipts AS (
  SELECT recording_id, sample_idx, unnest({list(range(UNITS))}) AS unit, unnest([{", ".join(f"i{u}" for u in range(UNITS))}]) AS ipt FROM wide),
ipts AS (SELECT *, sample_idx // {BATCH} AS batch_idx, ipt * ipt AS value FROM full_ipts WHERE sample_idx >= {EXT})"""
MODEL = """cuts AS (SELECT recording_id, unit, quantile_cont(value, 0.9) AS cut FROM ipts GROUP BY ALL),
model AS (
  SELECT recording_id, unit, avg(value) FILTER (value <= cut) AS base_centr, avg(value) FILTER (value > cut) AS spikes_centr,
    avg(value) FILTER (value > cut) - (avg(value) FILTER (value > cut) - avg(value) FILTER (value <= cut)) / 2 AS height
  FROM ipts JOIN cuts USING (recording_id, unit) GROUP BY ALL)"""


def maxima(source: str, keys: str = "recording_id, unit, batch_idx", name: str = "maxima") -> str:
    """SQL of the local maxima of a table's value."""
    return f"""{name}_new AS (
  SELECT {keys}, sample_idx, value, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY sample_idx)),
{name}_run AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY sample_idx) AS run FROM {name}_new),
{name}_flat AS (SELECT {keys}, run, any_value(value) AS value, min(sample_idx) AS a, max(sample_idx) AS b FROM {name}_run GROUP BY ALL),
{name} AS (
  SELECT {keys}, ((a + b) // 2)::BIGINT AS sample_idx, value FROM {name}_flat
  QUALIFY value > lag(value) OVER (PARTITION BY {keys} ORDER BY run) AND value > lead(value) OVER (PARTITION BY {keys} ORDER BY run))"""


BAND = f"""band AS (
  SELECT p.* FROM maxima p JOIN model USING (recording_id, unit)
  WHERE value BETWEEN base_centr / {MULT} AND {MULT} * spikes_centr)"""
KEPT = f"""ranked AS (
  SELECT recording_id, unit, batch_idx, list(sample_idx ORDER BY value DESC, sample_idx DESC) AS p FROM band GROUP BY ALL),
greedy AS (
  SELECT recording_id, unit, batch_idx, p, []::BIGINT[] AS kept, 1 AS k FROM ranked
  UNION ALL
  SELECT recording_id, unit, batch_idx, p,
    CASE WHEN len(list_filter(kept, lambda x: abs(x - p[k]) < {DIST})) = 0 THEN list_append(kept, p[k]) ELSE kept END, k + 1
  FROM greedy WHERE k <= len(p)),
kept AS (
  SELECT g.recording_id, g.unit, g.batch_idx, g.sample_idx, b.value
  FROM (SELECT recording_id, unit, batch_idx, unnest(kept) AS sample_idx FROM greedy WHERE k > len(p)) g
  JOIN band b USING (recording_id, unit, batch_idx, sample_idx)),
labelled AS (SELECT kept.*, value > height AS is_spike FROM kept JOIN model USING (recording_id, unit)),
spikes AS (SELECT recording_id, unit, batch_idx, sample_idx, value FROM labelled WHERE is_spike)"""
FROZEN = f"WITH RECURSIVE {IPTS}, {MODEL}, {maxima('ipts')}, {BAND}, {KEPT}"
FRAMES = """fr AS (
  SELECT label::VARCHAR AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_idx, embedding::DOUBLE[] AS channels FROM embeddings)"""
TIMES = """times AS (
  SELECT DISTINCT (user_id % 16)::VARCHAR AS recording_id, event_type AS source, user_id AS unit, epoch_us(ts) / 1e6::DOUBLE AS t FROM events)"""
TRAINS = f"""{TIMES},
trains AS (SELECT DISTINCT recording_id, source, unit, floor(t / {fx.TICK})::BIGINT AS sample_idx FROM times)"""
