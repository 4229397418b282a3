"""Frozen decomposition: delays, projection and detection in one pass over the samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import UNROLLED
from .frames import BLOCK, assign_batches, trim_warmup, with_history
from .peaks import detect_spikes


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _products(b: pd.Series, m: pd.Series, rows: pd.Series) -> pd.Series:
    """Flat products of flat matrices, the second with so many rows."""
    return pd.Series([(np.reshape(x, (-1, k)) @ np.reshape(y, (k, -1))).ravel() for x, y, k in zip(b, m, rows, strict=True)], dtype=object)


def fuse(units: DataFrame, whitening: DataFrame) -> DataFrame:
    """Rows of B W: units with w over the extended sample, from w over the whitened one.

    whitening (recording_id, row_idx, w): full matrices, as read_model gives them. A recording's units and its matrix meet as one row.
    """
    cols = [c for c in units.columns if c != "w"]
    lines = F.array_sort(F.collect_list(F.struct("row_idx", "w")))
    matrices = whitening.groupBy("recording_id").agg(F.transform(lines, lambda r: r["w"]).alias("m"))
    of = units.groupBy("recording_id").agg(F.collect_list(F.struct(*[c for c in units.columns if c != "recording_id"])).alias("u"))
    near = of.join(matrices, "recording_id").withColumn("made", _products(F.flatten(F.transform("u", lambda u: u["w"])), F.flatten("m"), F.size("m")))
    size = (F.size("made") / F.size("u")).cast("int")
    each = near.select("recording_id", "made", size.alias("size"), F.posexplode("u").alias("i", "u"))
    return each.select(*[F.col("recording_id") if c == "recording_id" else F.col(f"u.{c}").alias(c) for c in cols], F.slice("made", F.col("i") * F.col("size") + 1, F.col("size")).alias("w"))


def whitened_rows(units: DataFrame, scales: DataFrame, ext_fact: int) -> DataFrame:
    """Rows of B W for a diagonal whitening: (recording_id, unit, w), w as long as the extended sample."""
    tiled = F.flatten(F.array_repeat("scale", ext_fact))
    return units.join(scales, "recording_id").select("recording_id", "unit", F.zip_with("w", tiled, lambda a, b: a * b).alias("w"))


def frozen_ipts(signal: DataFrame, rows: DataFrame, channels: int, ext_fact: int, batch_size: int) -> DataFrame:
    """(recording_id, unit, sample_idx, ipt, batch_idx) after the warm-up, as sums of delayed products.

    The extended sample never becomes a column: each delayed channel is one lag over a
    block of the recording, and the products are compiled.
    """
    order = Window.partitionBy("recording_id", "block").orderBy("sample_idx")
    cols = {f"x{c}": F.get(F.col("channels"), F.lit(c)) for c in range(channels)}
    flat = with_history(signal, ext_fact - 1).select("recording_id", "sample_idx", "block", "halo", *[v.alias(k) for k, v in cols.items()])
    delayed = [(F.lag(f"x{c}", i).over(order) if i else F.col(f"x{c}")).alias(f"d{i * channels + c}") for i in range(ext_fact) for c in range(channels)]
    wide = flat.select("recording_id", "sample_idx", "halo", *delayed).where("not halo")
    per_recording = rows.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("unit", "w"))).alias("units"))
    near = trim_warmup(wide, ext_fact).join(per_recording, "recording_id")
    near = near.select("recording_id", "sample_idx", F.explode("units").alias("u"), *[f"d{k}" for k in range(channels * ext_fact)])
    total = None
    for k in range(channels * ext_fact):
        term = F.get(F.col("u.w"), F.lit(k)) * F.col(f"d{k}")
        total = term if total is None else total + term
    out = near.select("recording_id", F.col("u.unit").alias("unit"), "sample_idx", total.alias("ipt"))
    return assign_batches(out, batch_size)


def frozen_ipts_wide(signal: DataFrame, rows: DataFrame, channels: int, ext_fact: int, batch_size: int, block: int = BLOCK) -> DataFrame:
    """The same as frozen_ipts for models of any size: a product of matrices for each delay over a block of a recording."""
    near = with_history(signal.select("recording_id", "sample_idx", "channels"), ext_fact - 1, block=block)
    blocks = near.select(F.col("recording_id").alias("of"), F.col("block").alias("of_block")).distinct()
    models = rows.select(F.col("recording_id").alias("of"), "unit", "w").join(blocks, "of")
    schema = "recording_id string, unit int, sample_idx long, ipt double"

    def products(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if part.empty or model.empty:
            return pd.DataFrame({"recording_id": [], "unit": [], "sample_idx": [], "ipt": []})
        part, model = part.sort_values("sample_idx"), model.sort_values("unit")
        x, at, m = np.stack(part["channels"].to_numpy()), part["sample_idx"].to_numpy(), np.stack(model["w"].to_numpy())
        out = np.zeros((len(x), len(m)))
        for i in range(ext_fact):
            out[i:] += x[: len(x) - i] @ m[:, i * channels : (i + 1) * channels].T
        keep = ~part["halo"].to_numpy(dtype=bool) & (at >= ext_fact)
        n = int(keep.sum())
        return pd.DataFrame({"recording_id": [part["recording_id"].iat[0]] * (n * len(m)), "unit": np.repeat(model["unit"].to_numpy(), n), "sample_idx": np.tile(at[keep], len(m)), "ipt": out[keep].T.ravel()})

    made = near.groupBy("recording_id", "block").cogroup(models.groupBy("of", "of_block")).applyInPandas(products, schema)
    return assign_batches(made, batch_size)


def decompose(signal: DataFrame, model: DataFrame, channels: int, ext_fact: int, batch_size: int, distance: int, mult: float) -> DataFrame:
    """Spikes of a frozen model (recording_id, unit, w, base_centr, spikes_centr, height); w over the extended sample.

    Both ways of projecting give the same; small models are compiled.
    """
    project = frozen_ipts if channels * ext_fact <= UNROLLED else frozen_ipts_wide
    ipts = project(signal, model, channels, ext_fact, batch_size)
    return detect_spikes(ipts, model, distance, mult)
