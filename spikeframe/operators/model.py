"""Linear models on signals: whitening, separation, losses and their calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import contrast_of, dot
from ..sources.storage import materialise
from . import packed
from .adapt import OF_BATCH, OF_WHOLE, batch_covariances, delayed_moments, in_order
from .frames import BLOCK, assign_batches, trim_edges

#: Vectors that are made orthogonal together.
VECTORS = 1024
#: Entries of a sample from which on covariances add up as whole matrices, and matrices whose divergences are taken at once.
WIDE, TOGETHER = 8, 64


def project(df: DataFrame, rows: DataFrame, x: str, size: int | None = None, key: str = "unit", out: str = "ipt") -> DataFrame:
    """A row for each row of df and each matrix row (recording_id, key, w): their product.

    The matrix rows join by recording; the products need no shuffle of their own.
    """
    near = df.join(rows.select("recording_id", key, "w"), "recording_id")
    return near.withColumn(out, dot(x, "w", size)).drop("w", x)


def project_wide(df: DataFrame, matrix: np.ndarray, x: str, out: str) -> DataFrame:
    """df with out = matrix @ x for one matrix for all recordings, in Arrow batches."""
    sent = df.sparkSession.sparkContext.broadcast(matrix)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value.T
        for batch in batches:
            if len(batch):
                yield batch.assign(**{out: list(np.stack(batch[x].to_numpy()) @ m)})

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` array<double>"
    return df.mapInPandas(task, schema)


def whiten(df: DataFrame, diagonal: DataFrame, x: str = "channels") -> DataFrame:
    """z = D x for a diagonal whitening (recording_id, scale)."""
    return df.join(diagonal, "recording_id").withColumn("z", F.zip_with(x, "scale", lambda a, b: a * b)).drop("scale")


def whiten_by(df: DataFrame, whitening: DataFrame, x: str = "x", block: int = BLOCK) -> DataFrame:
    """(recording_id, sample_idx, z): z = W x for a full matrix of each recording.

    whitening (recording_id, row_idx, w), and version where the matrix changes by batch (df then has
    batch_idx). The matrix comes once to each batch or block of a recording, not to its samples.
    """
    by_batch = "version" in whitening.columns and "batch_idx" in df.columns
    rows = df.select("recording_id", "sample_idx", F.col(x).alias("x"), (F.col("batch_idx") if by_batch else F.floor(F.col("sample_idx") / block)).cast("long").alias("part"))
    matrices = whitening.select(F.col("recording_id").alias("of"), "row_idx", "w", *([F.col("version").cast("long").alias("of_part")] if by_batch else []))
    if not by_batch:
        parts = rows.select(F.col("recording_id").alias("of"), F.col("part").alias("of_part")).distinct()
        matrices = matrices.join(parts, "of")

    def product(part: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        if part.empty or w.empty:
            return pd.DataFrame({"recording_id": [], "sample_idx": [], "z": []})
        z = np.stack(part["x"].to_numpy()) @ np.stack(w.sort_values("row_idx")["w"].to_numpy()).T
        return part[["recording_id", "sample_idx"]].assign(z=list(z))

    made = rows.groupBy("recording_id", "part").cogroup(matrices.groupBy("of", "of_part"))
    return made.applyInPandas(product, "recording_id string, sample_idx long, z array<double>")


def covariances(df: DataFrame, x: str, size: int, keys: tuple[str, ...] = ("recording_id", "batch_idx")) -> DataFrame:
    """(keys, n, cov): the unbiased covariance of each group's ``size`` entries, upper triangle by row; NULL for one row.

    One aggregation with a sum for each entry: no row is cut into cells.
    """
    at = lambda i: F.get(F.col(x), F.lit(i))
    places = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(at(i)).alias(f"__s{i}") for i in range(size)] + [F.sum(at(i) * at(j)).alias(f"__s{i}_{j}") for i, j in places]
    m = df.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    cov = [(F.col(f"__s{i}_{j}") - F.col(f"__s{i}") * F.col(f"__s{j}") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0)) for i, j in places]
    return m.select(*keys, "n", F.array(*cov).alias("cov"))


def batch_covariance(df: DataFrame, x: str = "channels", size: int = 2, keys: tuple[str, ...] = ("recording_id", "batch_idx")) -> DataFrame:
    """(keys, i, j, cov): the unbiased covariance of each batch, upper triangle; NULL for one row.

    Small samples add up as columns; of large ones whole matrices do.
    """
    if size > WIDE:
        wide = df.select("recording_id", (F.col("batch_idx") if "batch_idx" in keys else F.lit(0).cast("long")).alias("batch_idx"), F.col(x).alias("x"))
        flat = batch_covariances(wide, size).select("recording_id", "batch_idx", F.posexplode("cov").alias("k", "cov"))
        cells = flat.select(*keys, F.floor(F.col("k") / size).cast("int").alias("i"), F.pmod("k", F.lit(size)).cast("int").alias("j"), F.when(~F.isnan("cov"), F.col("cov")).alias("cov"))
        return cells.where("i <= j")
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(size) for j in range(i, size)])
    cells = covariances(df, x, size, keys).select(*keys, F.inline(F.arrays_zip(places.alias("at"), "cov")))
    return cells.select(*keys, "at.i", "at.j", "cov")


def ewma_covariance(cov: DataFrame, start: DataFrame, alpha: float) -> DataFrame:
    """(recording_id, batch_idx, i, j, cov): C <- (1-a) C + a cov along the batches.

    A recording's batches go through a task in order, as a stream, with all entries of a batch as one row; the places of
    the entries come with the first row, so that nothing is joined afterwards.
    """
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "cov")))
    flat = lambda c: F.transform(c, lambda x: F.coalesce(x["cov"], F.lit(float("nan"))))
    place = lambda c, at: F.transform(c, lambda x: x[at].cast("double"))
    first = start.groupBy("recording_id").agg(cells.alias("cells"))
    head = first.select("recording_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.concat(place("cells", "i"), place("cells", "j"), flat("cells")).alias("payload"))
    each = cov.groupBy("recording_id", "batch_idx").agg(cells.alias("cells"))
    body = each.select("recording_id", F.lit(1).alias("kind"), F.col("batch_idx").alias("at"), flat("cells").alias("payload"))

    def fold():
        c = i = j = None

        def step(key, kind, ats, payloads):
            nonlocal c, i, j
            if kind == 0:
                i, j, c = np.array(payloads[0], dtype=float).reshape(3, -1)
                i, j = i.astype(np.int32), j.astype(np.int32)
            if kind != 1 or c is None:
                return
            for b, v in zip(ats, payloads, strict=True):
                c = (1 - alpha) * c + alpha * np.asarray(v, dtype=float)
                yield key, b, i, j, c

        return step

    course = in_order(head.unionByName(body), fold, "recording_id string, batch_idx long, i array<int>, j array<int>, cov array<double>")
    rows = course.select("recording_id", "batch_idx", F.inline(F.arrays_zip("i", "j", "cov")))
    return rows.withColumn("cov", F.when(~F.isnan("cov"), F.col("cov")))


def divergences(z: DataFrame, batch_size: int, alpha: float, size: int) -> DataFrame:
    """(recording_id, batch_idx, kl): the running covariance's divergence from the identity after each full batch of z.

    The same as kl_to_identity of ewma_covariance of batch_covariance, from the whole recording's covariance on, without
    cells: a batch is one row all the way, and its divergence comes out of the fold.
    """
    batches = assign_batches(z, batch_size)
    if size > WIDE:
        of = lambda at: batch_covariances(batches.select("recording_id", at.cast("long").alias("batch_idx"), F.col("z").alias("x")), size)
        start, each = of(F.lit(0)), of(F.col("batch_idx"))
    else:
        start, each = covariances(z, "z", size, ("recording_id",)), covariances(batches, "z", size)
    flat = F.transform("cov", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("payload")
    head = start.select("recording_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), flat)
    body = each.where(F.col("n") == batch_size).select("recording_id", F.lit(1).alias("kind"), F.col("batch_idx").alias("at"), flat)
    upper = np.triu_indices(size)

    def matrices(rows: np.ndarray) -> np.ndarray:
        if rows.shape[1] == size * size:
            return rows.reshape(-1, size, size)
        out = np.zeros((len(rows), size, size))
        out[:, upper[0], upper[1]] = out[:, upper[1], upper[0]] = rows
        return out

    def fold():
        c = None

        def step(key, kind, ats, payloads):
            nonlocal c
            if kind == 0:
                c = np.array(payloads[0], dtype=float)
            if kind != 1 or c is None:
                return
            for at in range(0, len(ats), TOGETHER):
                course = []
                for v in payloads[at : at + TOGETHER]:
                    c = (1 - alpha) * c + alpha * np.asarray(v, dtype=float)
                    course.append(c)
                m = matrices(np.stack(course))
                sign, log = np.linalg.slogdet(m)
                kl = (np.trace(m, axis1=1, axis2=2) - log - size) / 2
                for b, s, v in zip(ats[at : at + TOGETHER], sign, kl, strict=True):
                    yield key, b, float(v) if s > 0 else None

        return step

    return in_order(head.unionByName(body), fold, "recording_id string, batch_idx long, kl double")


def packed_divergences(packs: DataFrame, scales: DataFrame, batch_size: int, alpha: float) -> DataFrame:
    """divergences of the signal under a diagonal whitening (recording_id, scale), from packs of it: cov(D x) = D cov(x) D, so that no sample is whitened."""
    head = scales.select("recording_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.col("scale").alias("payload"))

    def fold():
        d = whole = at = held = c = None
        waiting: list[tuple] = []

        def covariance(rows: np.ndarray) -> np.ndarray:
            size = len(d)
            i, j = np.triu_indices(size)
            ss, n, s = np.zeros((len(rows), size, size)), rows[:, 0, None, None], rows[:, 1 : size + 1]
            ss[:, i, j] = ss[:, j, i] = rows[:, size + 1 :]
            with np.errstate(divide="ignore", invalid="ignore"):
                return (ss - s[:, :, None] * s[:, None, :] / n) / np.where(n > 1, n - 1, np.nan) * np.outer(d, d)

        def run() -> Iterator[tuple]:
            nonlocal c
            rows = [(b, v) for b, v in waiting if v[0] == batch_size]
            waiting.clear()
            if not rows:
                return
            course = []
            for v in covariance(np.stack([v for _, v in rows])):
                c = (1 - alpha) * c + alpha * v
                course.append(c)
            m = np.stack(course)
            sign, log = np.linalg.slogdet(m)
            kl = (np.trace(m, axis1=1, axis2=2) - log - len(d)) / 2
            for (b, _), s, v in zip(rows, sign, kl, strict=True):
                yield b, float(v) if s > 0 else None

        def step(key, kind, ats, payloads):
            nonlocal d, whole, at, held, c
            if kind == 0:
                d = np.asarray(payloads[0])
            elif d is None:
                return
            elif kind == OF_WHOLE:
                for v in payloads:
                    whole = v if whole is None else whole + v
            elif kind == OF_BATCH:
                c = covariance(whole[None])[0] if c is None else c
                for b, v in zip(ats.tolist(), payloads, strict=True):
                    if b == at:
                        held = held + v
                        continue
                    if held is not None:
                        waiting.append((at, held))
                    at, held = b, v
                    if len(waiting) == TOGETHER:
                        yield from ((key, *row) for row in run())
            elif held is not None:
                waiting.append((at, held))
                yield from ((key, *row) for row in run())

        return step

    return in_order(head.unionByName(packed.moments(packs, 1, batch_size)), fold, "recording_id string, batch_idx long, kl double")


@F.pandas_udf(T.DoubleType())
def _logdet(rows: pd.Series, size: pd.Series) -> pd.Series:
    def one(values, n):
        m = np.zeros((n, n))
        m[np.triu_indices(n)] = values
        sign, value = np.linalg.slogdet(m + np.triu(m, 1).T)
        return value if sign > 0 else None

    return pd.Series([one(r, n) for r, n in zip(rows, size, strict=True)], dtype="float64")


def kl_to_identity(cov: DataFrame, size: int) -> DataFrame:
    """(recording_id, batch_idx, kl): half of trace - logdet - size; NULL where the determinant isn't positive."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "cov")))
    m = cov.groupBy("recording_id", "batch_idx").agg(cells.alias("cells"))
    trace = F.aggregate(F.filter("cells", lambda c: c["i"] == c["j"]), F.lit(0.0), lambda acc, c: acc + c["cov"])
    if size <= 2:
        det = F.col("cells")[0]["cov"] if size == 1 else F.col("cells")[0]["cov"] * F.col("cells")[2]["cov"] - F.col("cells")[1]["cov"] * F.col("cells")[1]["cov"]
        log = F.when(det > 0, F.ln(det))
    else:
        log = _logdet(F.transform("cells", lambda c: c["cov"]), F.lit(size))
    return m.select("recording_id", "batch_idx", ((trace - log - size) / 2).alias("kl"))


def whitening_loss(kl: DataFrame, calib: DataFrame) -> DataFrame:
    """wh_loss: the squared distance of kl from the calibration's mean, in its deviations."""
    z = (F.col("kl") - F.col("kl_mean")) / F.nullif(F.col("kl_std"), F.lit(0.0))
    return kl.join(calib, "recording_id").select("recording_id", "batch_idx", (z * z).alias("wh_loss"))


def _at_spikes(ipts: DataFrame, spikes: DataFrame) -> DataFrame:
    """The ipts at the spikes; spikes that have theirs already (values_at_spikes) are taken as they are."""
    return spikes if "ipt" in spikes.columns else ipts.join(spikes.select("recording_id", "unit", "sample_idx"), ["recording_id", "unit", "sample_idx"])


def separation_loss(ipts: DataFrame, spikes: DataFrame, calib: DataFrame, contrast: str = "logcosh") -> DataFrame:
    """(recording_id, batch_idx, unit, sv_loss): contrast of the mean spike height against the calibration.

    Batches without spikes have the contrast 0, which counts as missing.
    """
    batch = ["recording_id", "batch_idx", "unit"]
    sums = _at_spikes(ipts, spikes).groupBy(*batch).agg((F.sum("ipt") / (F.count("*") + 1e-6)).alias("height"))
    batches = ipts.select(*batch) if "ipts" in ipts.columns else ipts.select(*batch).distinct()  # rows of packed.SOURCE are batches already
    means = batches.join(sums, batch, "left").withColumn("height", F.coalesce("height", F.lit(0.0)))
    value = F.nullif(contrast_of(F.col("height"), contrast), F.lit(0.0))
    z = (value - F.col("contrast_mean")) / F.nullif(F.col("contrast_std"), F.lit(0.0))
    return means.join(calib, ["recording_id", "unit"]).select("recording_id", "batch_idx", "unit", (z * z).alias("sv_loss"))


def total_loss(wh: DataFrame, sv: DataFrame) -> DataFrame:
    """wh_loss (missing: 1e10) plus the separation losses that are there."""
    added = sv.groupBy("recording_id", "batch_idx").agg(F.sum("sv_loss").alias("sv"))
    total = F.coalesce("wh_loss", F.lit(1e10)) + F.coalesce("sv", F.lit(0.0))
    return wh.join(added, ["recording_id", "batch_idx"], "left").select("recording_id", "batch_idx", total.alias("total_loss"))


def calibrate_contrast(ipts: DataFrame, spikes: DataFrame, contrast: str = "logcosh") -> DataFrame:
    """(recording_id, unit, contrast_mean, contrast_std) of the contrast at the spikes."""
    at = _at_spikes(ipts, spikes).withColumn("value", contrast_of(F.col("ipt"), contrast))
    return at.groupBy("recording_id", "unit").agg(F.avg("value").alias("contrast_mean"), F.stddev_samp("value").alias("contrast_std"))


def init_heights(model: DataFrame) -> DataFrame:
    """The detection threshold: midway between the centroids."""
    return model.withColumn("height", F.col("spikes_centr") - (F.col("spikes_centr") - F.col("base_centr")) / 2)


def calibration(kl: DataFrame) -> DataFrame:
    """(recording_id, kl_mean, kl_std) of divergences (recording_id, batch_idx, kl), without the first and last batch of each recording."""
    return trim_edges(kl).groupBy("recording_id").agg(F.avg("kl").alias("kl_mean"), F.stddev_samp("kl").alias("kl_std"))


def calibrate_whitening(z: DataFrame, batch_size: int, alpha: float, size: int) -> DataFrame:
    """(recording_id, kl_mean, kl_std) of the calibration: full batches, without the first and last."""
    # read twice: for the ends and for the values between them
    return calibration(materialise(divergences(z, batch_size, alpha, size), "divergences"))


def calibrate_full(signal: DataFrame, whitening: DataFrame, ext_fact: int, batch_size: int, alpha: float, size: int, packs: DataFrame | None = None) -> DataFrame:
    """(recording_id, w, c, kl_mean, kl_std): flat whitening, covariance of the whitened signal, and what calibrate_whitening gives of it.

    whitening (recording_id, row_idx, w), ``size`` rows for each recording. Whitened samples are never made: cov(W x) = W cov(x) W', so that one pass over the samples
    gives the moments of batches and one fold the rest. A recording without samples or whitening gives no row. packs: the signal's (packed.pack), if there are any.
    """
    lines = F.array_sort(F.collect_list(F.struct("row_idx", "w")))
    flat = whitening.groupBy("recording_id").agg(F.transform(lines, lambda r: r["w"]).alias("m"))
    head = flat.select("recording_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.flatten("m").alias("payload"))

    def fold():
        w = whole = at = held = last = c = None
        waiting, n, mean, square = [], 0, 0.0, 0.0

        def covariance(rows: np.ndarray) -> np.ndarray:
            d = w.shape[1]
            ss, count, s = np.zeros((len(rows), d, d)), rows[:, 0, None, None], rows[:, 1 : d + 1]
            i, j = np.triu_indices(d)
            ss[:, i, j] = ss[:, j, i] = rows[:, d + 1 :]
            with np.errstate(divide="ignore", invalid="ignore"):
                x = (ss - s[:, :, None] * s[:, None, :] / count) / np.where(count > 1, count - 1, np.nan)
            return w @ x @ w.T

        def run() -> None:
            """The divergences of the batches that wait; the last one of a recording is never added, nor the first."""
            nonlocal c, last, n, mean, square
            rows = [(b, v) for b, v in waiting if v[0] == batch_size]
            waiting.clear()
            if not rows:
                return
            course = []
            for v in covariance(np.stack([v for _, v in rows])):
                c = (1 - alpha) * c + alpha * v
                course.append(c)
            m = np.stack(course)
            sign, log = np.linalg.slogdet(m)
            kl = (np.trace(m, axis1=1, axis2=2) - log - len(c)) / 2
            for (b, _), s, v in zip(rows, sign, kl, strict=True):
                if last is not None and last[0] >= 1 and last[1] is not None:
                    n += 1
                    off = last[1] - mean
                    mean += off / n
                    square += off * (last[1] - mean)
                last = b, float(v) if s > 0 else None

        def step(key, kind, ats, payloads):
            nonlocal w, whole, at, held, c
            if kind == 0:
                w = np.array(payloads[0]).reshape(size, -1)
            elif w is None:
                return
            elif kind == OF_WHOLE:
                for v in payloads:
                    whole = v if whole is None else whole + v
            elif kind == OF_BATCH:
                c = covariance(whole[None])[0] if c is None else c
                for b, v in zip(ats.tolist(), payloads, strict=True):
                    if b == at:
                        held = held + v
                        continue
                    if held is not None:
                        waiting.append((at, held))
                    at, held = b, v
                    if len(waiting) == TOGETHER:
                        run()
            elif whole is not None:
                waiting.append((at, held))
                first = covariance(whole[None])[0]
                run()
                yield key, w.ravel(), first.ravel(), mean if n else None, float(np.sqrt(square / (n - 1))) if n > 1 else None

        return step

    rows = head.unionByName(delayed_moments(signal, ext_fact, batch_size) if packs is None else packed.moments(packs, ext_fact, batch_size))
    return in_order(rows, fold, "recording_id string, w array<double>, c array<double>, kl_mean double, kl_std double")


def orthonormalise(units: DataFrame) -> DataFrame:
    """Each recording's vectors (recording_id, unit, w) made orthogonal to those before, of length 1; zeros for one that those before span.

    A recording's vectors pass as a stream: a task holds some of them and those that were no zeros, of which there are no more than a vector has entries.
    """
    types = dict(units.dtypes)
    rows = units.select("recording_id", F.lit(0).alias("kind"), F.col("unit").alias("at"), F.col("w").cast("array<double>").alias("payload"))

    def fold():
        basis: list[np.ndarray] = []

        def step(key, _kind, ats, payloads):
            for begin in range(0, len(ats), VECTORS):
                v = np.stack(payloads[begin : begin + VECTORS])
                least, out = 1e-10 * np.linalg.norm(v, axis=1), np.zeros_like(v)
                for u in basis:
                    v = v - np.outer(v @ u, u)
                i = 0
                while len(new := np.flatnonzero(np.linalg.norm(v[i:], axis=1) > least[i:])):
                    i += int(new[0])
                    out[i] = v[i] / np.linalg.norm(v[i])
                    basis.append(out[i].copy())
                    i += 1
                    v[i:] -= np.outer(v[i:] @ basis[-1], basis[-1])
                yield from ((key, at, w) for at, w in zip(ats[begin : begin + VECTORS].tolist(), out, strict=True))

        return step

    return in_order(rows, fold, f"recording_id {types['recording_id']}, unit {types['unit']}, w array<double>").select(*[F.col(c).cast(types[c]).alias(c) for c in ("recording_id", "unit", "w")])


def centroids(ipts: DataFrame, share: float = 0.9) -> DataFrame:
    """(recording_id, unit, base_centr, spikes_centr): means of the squares below and above their quantile."""
    sq = F.col("ipt") * F.col("ipt")
    cut = ipts.groupBy("recording_id", "unit").agg(F.percentile(sq, share).alias("cut"))
    near = ipts.join(cut, ["recording_id", "unit"])
    return near.groupBy("recording_id", "unit").agg(F.avg(F.when(sq <= F.col("cut"), sq)).alias("base_centr"), F.avg(F.when(sq > F.col("cut"), sq)).alias("spikes_centr"))


def scales(df: DataFrame, x: str = "channels", size: int | None = None) -> DataFrame:
    """(recording_id, scale): one over each channel's deviation, 0 for a constant one; with a known number of channels no row is cut into cells."""
    scale_of = lambda value: F.coalesce(1.0 / F.nullif(F.stddev_pop(value), F.lit(0.0)), F.lit(0.0))
    if size is not None:
        made = df.groupBy("recording_id").agg(*[scale_of(F.get(F.col(x), F.lit(i))).alias(f"__s{i}") for i in range(size)])
        return made.select("recording_id", F.array(*[F.col(f"__s{i}") for i in range(size)]).alias("scale"))
    cells = df.select("recording_id", F.posexplode(x).alias("channel", "value"))
    one = cells.groupBy("recording_id", "channel").agg(scale_of("value").alias("s"))
    pairs = F.array_sort(F.collect_list(F.struct("channel", "s")))
    return one.groupBy("recording_id").agg(F.transform(pairs, lambda p: p["s"]).alias("scale"))


def build_model(tables: dict[str, DataFrame], ext_fact: int, batch_size: int, alpha: float, size: int, contrast: str = "logcosh") -> tuple[DataFrame, DataFrame]:
    """What a run starts from, of the tables that read_model returns: (units, start) as adapt.adaptive_steps takes them.

    units get heights and contrast statistics. start has the whitening and its covariance over the calibration
    signal (zeros before its first sample included), both flat, with the mean and deviation of the
    divergence. size: rows of the whitening. The tables may hold the signal's packs, too.
    """
    stats = calibrate_contrast(tables["ipts"], tables["spikes"], contrast)
    units = init_heights(tables["model_units"]).drop("version").join(stats, ["recording_id", "unit"], "left")
    return units, calibrate_full(tables["signal"], tables["model_whitening"], ext_fact, batch_size, alpha, size, tables.get("packs"))
