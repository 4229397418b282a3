"""Adaptive decomposition: the model follows the signal batch by batch.

Every batch needs the parameters that the batch before left, so a recording is sequential;
recordings (and groups of trials) run side by side. A recording goes through its
task in order and as a stream: what is held are the model, the last delays and one batch, never the
recording. The covariances of batches alone don't depend on the model (cov(W x) = W cov(x) W'):
they are made in parallel, and the whitening's course by itself is a fold over them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise
from .frames import BLOCK, in_runs, put_together, with_history

#: Trials that go through a recording together.
TRIALS_PER_GROUP = 8


@dataclass(frozen=True)
class Params:
    """What adapts and how fast; sizes in samples."""

    batch_size: int = 100
    ext_fact: int = 4
    spike_dist: int = 5
    wh_learning_rate: float = 7e-3
    sv_learning_rate: float = 3e-3
    cov_alpha: float = 0.1
    spike_height_mult: float = 3
    spike_prev_weight: float = 5
    sv_epochs: int = 1
    sv_tol: float = 1e-4
    contrast: str = "logcosh"
    adapt_wh: bool = True
    adapt_sv: bool = True
    adapt_sd: bool = True
    legacy_force_sd: bool = False
    compute_loss: bool = True

    def __post_init__(self):
        if self.ext_fact > self.batch_size:
            raise ValueError("ext_fact may not be larger than batch_size")
        if self.contrast not in ("logcosh", "cube"):
            raise ValueError(f"unknown contrast {self.contrast!r}; one of logcosh, cube")


def find_peaks(x: np.ndarray, low: float, high: float, distance: int) -> np.ndarray:
    """Strict local maxima (plateau middles) with low <= x <= high, the highest first without those nearer than distance."""
    up = x[1:] - x[:-1]
    if (up != 0).all():
        at = np.flatnonzero((up[:-1] > 0) & (up[1:] < 0)) + 1
    else:
        starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
        ends, v = np.append(starts[1:], len(x)), x[starts]
        top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
        at = (starts[top] + ends[top] - 1) // 2
    v = x[at]
    inside = (v >= low) & (v <= high)
    at, v = at[inside], v[inside]
    # of equal ones the later first: a stable sort of the reversed places
    order = at[::-1][np.argsort(-v[::-1], kind="stable")]
    free, none, kept = bytearray(b"\1" * len(x)), bytes(2 * distance - 1), []
    for i in order.tolist():
        if free[i]:
            kept.append(i)
            a, b = max(0, i - distance + 1), min(len(x), i + distance)
            free[a:b] = none[: b - a]
    kept.sort()
    return np.array(kept, dtype=np.int64)


def covariance_of(z: np.ndarray) -> np.ndarray:
    """Unbiased covariance of rows, two at least."""
    d = z - z.sum(0) / len(z)
    return (d.T @ d) / (len(z) - 1)


def kl_of(c: np.ndarray) -> float:
    """Divergence of a covariance from the identity; NaN where it isn't positive definite."""
    try:
        log = 2 * np.log(np.linalg.cholesky(c).diagonal()).sum()
    except np.linalg.LinAlgError:
        return np.nan
    return (c.trace() - log - len(c)) / 2


def unit_step(b: np.ndarray, base: float, spikes: float, height: float, ipt: np.ndarray, z: np.ndarray, p: Params):
    """One unit over one batch z (samples, dims) with its ipt = z b: peaks, labels and the parameters after it."""
    sq = ipt * ipt
    at = find_peaks(sq, base / p.spike_height_mult, p.spike_height_mult * spikes, p.spike_dist)
    tops = sq[at]
    hit = tops > height
    n = int(hit.sum())
    if p.adapt_sv and n:
        y = ipt[at[hit]]
        g = np.tanh(y) if p.contrast == "logcosh" else y * y / 2
        grad = (g @ z[at[hit]]) / n
        new = b
        for _ in range(p.sv_epochs):
            old, new = new, new + p.sv_learning_rate * grad
            new = new / np.sqrt(new @ new)
            if abs(abs(new @ old) - 1) < p.sv_tol:
                break
        b = new
    if (p.adapt_sd or p.legacy_force_sd) and len(at):
        mean = lambda now, old: (p.spike_prev_weight * old + n * now) / (p.spike_prev_weight + n)
        spikes = mean(tops[hit].sum() / n, spikes) if n else spikes
        base = mean(tops[~hit].sum() / (len(at) - n), base) if n < len(at) else base
        height = spikes - (spikes - base) / 2
    return at, hit, b, base, spikes, height


@dataclass
class Unit:
    """A unit's vector in whitened space, thresholds, and the contrast of its calibration."""

    unit: int
    w: np.ndarray
    base: float
    spikes: float
    height: float
    mean: float = np.nan
    std: float = np.nan


@dataclass
class Run:
    """A model on its way through one recording: whitening, running covariance and units."""

    p: Params
    w: np.ndarray
    c: np.ndarray
    units: list[Unit]
    kl_mean: float = np.nan
    kl_std: float = np.nan

    def batch(self, x: np.ndarray) -> dict:
        """Move on by one batch of extended samples (samples, dims); outputs and losses under the model from before it.

        A batch of one row leaves the covariance, and with it the whitening, as it is.
        """
        out = self.whiten(x)
        made = self.separate(out.pop("z"))
        total = 1e10 if np.isnan(out["wh_loss"]) else out["wh_loss"]
        total += sum(0 if np.isnan(u[-1]) else u[-1] for u in made)
        return out | {"units": made, "total_loss": total if self.p.compute_loss else np.nan}

    def whiten(self, x: np.ndarray) -> dict:
        """The batch whitened, with the whitening and covariance from before it and the loss; both move on."""
        p, z = self.p, x @ self.w.T
        out = {"z": z, "w": self.w, "c": self.c, "wh_loss": np.nan}
        if len(z) > 1:
            self.c = (1 - p.cov_alpha) * self.c + p.cov_alpha * covariance_of(z)
        if p.compute_loss:
            out["wh_loss"] = ((kl_of(self.c) - self.kl_mean) / self.kl_std) ** 2 if self.kl_std else np.nan
        if p.adapt_wh and len(z) > 1:
            self.w = self.w + p.wh_learning_rate * (self.w - self.c @ self.w)
        return out

    def separate(self, z: np.ndarray) -> list[tuple]:
        """(unit, ipt, places of spikes, w, base, spikes, height, loss) of each unit over a whitened batch; the units move on."""
        made = []
        ipts = z @ np.stack([u.w for u in self.units]).T if self.units else np.zeros((len(z), 0))
        for u, ipt in zip(self.units, ipts.T, strict=True):
            before = (u.w, u.base, u.spikes, u.height)
            at, hit, u.w, u.base, u.spikes, u.height = unit_step(*before, ipt, z, self.p)
            made.append((u.unit, ipt, at[hit], *before, self._sv_loss(u, ipt[at[hit]]) if self.p.compute_loss else np.nan))
        return made

    def _sv_loss(self, u: Unit, heights: np.ndarray) -> float:
        """Distance of the mean spike's contrast from the calibration's; NaN without spikes."""
        mean = heights.sum() / (len(heights) + 1e-6)
        value = np.log(np.cosh(mean)) if self.p.contrast == "logcosh" else mean**3 / 6
        return ((value - u.mean) / u.std) ** 2 if value and u.std else np.nan


def peaks_of_rows(x: np.ndarray, low: np.ndarray, high: np.ndarray, distance: int) -> np.ndarray:
    """find_peaks of each row of x, as a matrix of marks."""
    kept, n = np.zeros(x.shape, dtype=bool), x.shape[1]
    up = x[:, 1:] - x[:, :-1]
    if not (up != 0).all():
        for row, mine, a, b in zip(x, kept, low, high, strict=True):
            mine[find_peaks(row, a, b, distance)] = True
        return kept
    middle = x[:, 1:-1]
    row, at = np.nonzero((up[:, :-1] > 0) & (up[:, 1:] < 0) & (middle >= low[:, None]) & (middle <= high[:, None]))
    # rows lie one after another, too far apart to touch
    place = row * (n + distance) + at + distance
    order = np.lexsort((-place, -middle[row, at], row))
    free, none, taken = bytearray(b"\1" * (x.shape[0] * (n + distance) + 2 * distance)), bytes(2 * distance - 1), []
    for i, p in zip(order.tolist(), place[order].tolist(), strict=True):
        if free[p]:
            taken.append(i)
            free[p - distance + 1 : p + distance] = none
    kept[row[taken], at[taken] + 1] = True
    return kept


#: Settings in which the runs of one group may differ.
RATES = ("wh_learning_rate", "sv_learning_rate", "cov_alpha")


class Runs:
    """Runs over one recording whose settings differ in RATES alone: each step is taken for all of them and all their units at once."""

    def __init__(self, runs: list[Run]):
        stack = lambda of: np.array([of(r) for r in runs], dtype=float)
        each = lambda name: stack(lambda r: [getattr(u, name) for u in r.units])
        self.p, self.ids = runs[0].p, [u.unit for u in runs[0].units]
        self.w, self.c, self.kl_mean, self.kl_std = stack(lambda r: r.w), stack(lambda r: r.c), [r.kl_mean for r in runs], [r.kl_std for r in runs]
        self.b, self.base, self.spikes, self.height = each("w"), each("base"), each("spikes"), each("height")
        self.mean, self.std = each("mean"), each("std")
        self.wh_rate, self.sv_rate, self.alpha = (stack(lambda r, n=n: getattr(r.p, n))[:, None, None] for n in RATES)

    @staticmethod
    def fit(runs: list[Run]) -> bool:
        """Whether these runs can go together."""
        if not runs:
            return False
        common = [asdict(r.p) | dict.fromkeys(RATES) for r in runs]
        return all(c == common[0] for c in common) and all([u.unit for u in r.units] == [u.unit for u in runs[0].units] for r in runs) and len(runs[0].units) > 0

    def single(self) -> list[Run]:
        """The runs one by one, as they are now."""
        out = []
        for t in range(len(self.w)):
            units = [Unit(u, self.b[t, i], *(float(v[t, i]) for v in (self.base, self.spikes, self.height, self.mean, self.std))) for i, u in enumerate(self.ids)]
            rates = {n: float(v[t, 0, 0]) for n, v in zip(RATES, (self.wh_rate, self.sv_rate, self.alpha), strict=True)}
            out.append(Run(with_params(self.p, **rates), self.w[t], self.c[t], units, self.kl_mean[t], self.kl_std[t]))
        return out

    def batch(self, x: np.ndarray) -> list[dict]:
        """What Run.batch gives, of each run."""
        p, n = self.p, len(x)
        z, w, c = x @ self.w.transpose(0, 2, 1), self.w, self.c
        if n > 1:
            d = z - z.sum(1, keepdims=True) / n
            self.c = (1 - self.alpha) * c + self.alpha * ((d.transpose(0, 2, 1) @ d) / (n - 1))
        wh = [((kl - mean) / std) ** 2 if std else np.nan for kl, mean, std in zip(self._divergences(), self.kl_mean, self.kl_std, strict=True)] if p.compute_loss else [np.nan] * len(w)
        if p.adapt_wh and n > 1:
            self.w = w + self.wh_rate * (w - self.c @ w)
        before = (self.b, self.base, self.spikes, self.height)
        ipt = self.b @ z.transpose(0, 2, 1)
        hit, loss = self._separate(z, ipt)
        total = lambda t: (1e10 if np.isnan(wh[t]) else wh[t]) + np.nansum(loss[t]) if p.compute_loss else np.nan
        unit = lambda t, i: (self.ids[i], ipt[t, i], np.flatnonzero(hit[t, i]), *(v[t, i] for v in before), loss[t, i])
        return [{"w": w[t], "c": c[t], "wh_loss": wh[t], "units": [unit(t, i) for i in range(len(self.ids))], "total_loss": total(t)} for t in range(len(w))]

    def _divergences(self) -> list[float]:
        try:
            log = 2 * np.log(np.linalg.cholesky(self.c).diagonal(axis1=1, axis2=2)).sum(1)
        except np.linalg.LinAlgError:
            return [kl_of(c) for c in self.c]
        return ((self.c.trace(axis1=1, axis2=2) - log - self.c.shape[1]) / 2).tolist()

    def _separate(self, z: np.ndarray, ipt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks of the spikes and the losses of all units; the units move on."""
        p, sq = self.p, ipt * ipt
        low, high = self.base / p.spike_height_mult, p.spike_height_mult * self.spikes
        kept = peaks_of_rows(sq.reshape(-1, sq.shape[2]), low.ravel(), high.ravel(), p.spike_dist).reshape(sq.shape)
        hit = kept & (sq > self.height[:, :, None])
        n, found = hit.sum(2), kept.sum(2)
        fired, some = n > 0, np.maximum(n, 1)
        if p.adapt_sv and fired.any():
            g = np.where(hit, np.tanh(ipt) if p.contrast == "logcosh" else sq / 2, 0.0)
            grad = (g @ z) / some[:, :, None]
            new, going = self.b, fired
            for _ in range(p.sv_epochs):
                then = new + self.sv_rate * grad
                then = then / np.sqrt((then * then).sum(2, keepdims=True))
                near = np.abs(np.abs((then * new).sum(2)) - 1) < p.sv_tol
                new, going = np.where(going[:, :, None], then, new), going & ~near
            self.b = new
        if p.adapt_sd or p.legacy_force_sd:
            weigh = lambda total, count, old: np.where(count > 0, (p.spike_prev_weight * old + n * (total / np.maximum(count, 1))) / (p.spike_prev_weight + n), old)
            self.spikes = weigh(np.where(hit, sq, 0.0).sum(2), n, self.spikes)
            self.base = weigh(np.where(kept & ~hit, sq, 0.0).sum(2), found - n, self.base)
            self.height = np.where(found > 0, self.spikes - (self.spikes - self.base) / 2, self.height)
        if not p.compute_loss:
            return hit, np.full(n.shape, np.nan)
        mean = np.where(hit, ipt, 0.0).sum(2) / (n + 1e-6)
        value = np.log(np.cosh(mean)) if p.contrast == "logcosh" else mean**3 / 6
        with np.errstate(divide="ignore", invalid="ignore"):
            return hit, np.where((value != 0) & (self.std != 0), ((value - self.mean) / self.std) ** 2, np.nan)


class OneByOne:
    """Runs over one recording that differ in more, or have no units."""

    def __init__(self, runs: list[Run]):
        self.runs = runs

    def single(self) -> list[Run]:
        return self.runs

    def batch(self, x: np.ndarray) -> list[dict]:
        return [r.batch(x) for r in self.runs]


def together(runs: list[Run]) -> Runs | OneByOne:
    return Runs(runs) if Runs.fit(runs) else OneByOne(runs)


def delayed(whole: np.ndarray, ext_fact: int) -> np.ndarray:
    """Extended rows of raw samples, of which the first ext_fact - 1 only come before."""
    return np.hstack([whole[ext_fact - 1 - i : len(whole) - i] for i in range(ext_fact)])


class Delays:
    """Raw samples to extended ones, batch by batch; rows that reach before the recording are left out."""

    def __init__(self, p: Params):
        self.p, self.tail, self.next = p, None, 0

    def start(self, first: int, before: np.ndarray | None = None) -> None:
        """Begin with batch ``first``; before: the samples right before it, none of them zeros."""
        self.next, self.tail = first, before

    def batch(self, raw: np.ndarray) -> tuple[np.ndarray, int]:
        """Extended rows of the next batch, and how many of its first ones were left out."""
        p, depth = self.p, self.p.ext_fact - 1
        if self.tail is None:
            self.tail = np.zeros((depth, raw.shape[1]))
        whole = np.concatenate([self.tail, raw])
        x = delayed(whole, p.ext_fact)
        skip = min(len(raw), p.ext_fact) if self.next == 0 else 0
        self.tail, self.next = whole[len(whole) - depth :], self.next + 1
        return x[skip:], skip


def batch_covariances(df: DataFrame, size: int) -> DataFrame:
    """(recording_id, batch_idx, n, cov): unbiased covariance of x (recording_id, batch_idx, x), flat by row; sums meet by batch."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for (r, b), part in pdf.groupby(["recording_id", "batch_idx"], sort=False):
                x = np.stack(part["x"].to_numpy())
                rows.append((r, b, len(x), x.sum(0), (x.T @ x).ravel()))
            if rows:
                yield pd.DataFrame(rows, columns=["recording_id", "batch_idx", "n", "s", "ss"])

    def total(group: dict[str, np.ndarray]) -> Iterator[tuple]:
        n, s, ss = int(group["n"].sum()), np.sum(np.stack(group["s"]), 0), np.sum(np.stack(group["ss"]), 0)
        cov = (ss - np.outer(s, s).ravel() / n) / (n - 1) if n > 1 else np.full(size * size, np.nan)
        yield group["recording_id"][0], int(group["batch_idx"][0]), n, cov

    sums = df.select("recording_id", "batch_idx", "x").mapInPandas(partial, "recording_id string, batch_idx long, n long, s array<double>, ss array<double>")
    return in_runs(sums, ("recording_id", "batch_idx"), None, total, "recording_id string, batch_idx long, n long, cov array<double>")


#: Kinds of the rows of delayed_moments.
OF_WHOLE, OF_BATCH = 1, 2


def delayed_moments(signal: DataFrame, ext_fact: int, batch_size: int, block: int = BLOCK) -> DataFrame:
    """(recording_id, kind, at, payload): number, sums and sums of products (upper triangle by row) of extended samples.

    OF_WHOLE: of a block of the recording, OF_BATCH: of batch ``at`` within a block; those of one recording or batch are to be added.
    Extended as by frames.extend_delays, within blocks of a recording that lie in order.
    """
    depth = ext_fact - 1

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        key = tail = at = sums = total = upper = None
        for pdf in batches:
            names, blocks, halo, index = (pdf[c].to_numpy() for c in ("recording_id", "block", "halo", "sample_idx"))
            channels, halo = pdf["channels"].to_numpy(), halo.astype(bool)
            change = (names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(pdf)] if len(pdf) else []
            for a, b in zip(edges, edges[1:], strict=False):
                raw = np.stack(channels[a:b])
                if (names[a], blocks[a]) != key:
                    if sums is not None:
                        yield key[0], OF_BATCH, at, sums
                        yield key[0], OF_WHOLE, 0, total + sums
                    key, tail, at, sums, total = (names[a], blocks[a]), np.zeros((depth, raw.shape[1])), None, None, 0.0
                    upper = np.triu_indices(raw.shape[1] * ext_fact)
                whole = np.concatenate([tail, raw])
                x = np.hstack([whole[depth - i : len(whole) - i] for i in range(ext_fact)])[~halo[a:b]]
                tail = whole[len(whole) - depth :]
                of = index[a:b][~halo[a:b]] // batch_size
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
                for i, j in zip(cuts, cuts[1:], strict=False):
                    part = x[i:j]
                    more = np.concatenate([[j - i], part.sum(0), (part.T @ part)[upper]])
                    if at == of[i]:
                        sums = sums + more
                        continue
                    if sums is not None:
                        yield key[0], OF_BATCH, at, sums
                        total = total + sums
                    at, sums = int(of[i]), more
        if sums is not None:
            yield key[0], OF_BATCH, at, sums
            yield key[0], OF_WHOLE, 0, total + sums

    near = with_history(signal.select("recording_id", "sample_idx", "channels"), depth, block=block)
    dealt = near.repartition(F.xxhash64("recording_id", "block")).sortWithinPartitions("recording_id", "block", "sample_idx")
    names = ["recording_id", "kind", "at", "payload"]
    return dealt.mapInPandas(lambda batches: put_together(moments(batches), names), "recording_id string, kind int, at long, payload array<double>")


#: Kinds of the rows of a fold that hold a pack of samples, and of those that say where a stretch ends.
PACKED, END = 4, 5


def samples_of(kind: int, ats: np.ndarray, payloads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the samples in rows of a fold (_sample_rows)."""
    if kind != PACKED:
        return ats, np.stack(payloads)
    at, x = [], []
    for first, row in zip(ats.tolist(), payloads, strict=True):
        width, given = int(row[0]), int(row[1])
        x.append(row[2 + given :].reshape(-1, width))
        at.append(row[2 : 2 + given].astype(np.int64) if given else np.arange(first, first + len(x[-1])))
    return (at[0], x[0]) if len(at) == 1 else (np.concatenate(at), np.concatenate(x))


def between(signal: DataFrame, begin: int | None, end: int) -> DataFrame:
    """Samples, or packs of them, from begin (if given) to end - 1; a pack without its history."""
    if "values" not in signal.columns:
        rows = signal.where(F.col("sample_idx") < end)
        return rows if begin is None else rows.where(F.col("sample_idx") >= begin)
    n = (F.size("values") / F.col("width")).cast("int") - F.col("halo")
    count = lambda bound: F.when(F.col("at").isNull(), F.greatest(F.lit(0), F.least(n, (F.lit(bound) - F.col("first")).cast("int")))).otherwise(F.size(F.filter("at", lambda i: i < bound)))
    rows = signal.where(F.col("first") < end).withColumns({"__a": F.lit(0) if begin is None else count(begin), "__b": count(end)}).where("__a < __b")
    at = F.slice("at", F.col("__a") + 1, F.col("__b") - F.col("__a"))
    first = F.when(F.col("at").isNull(), F.col("first") + F.col("__a")).otherwise(F.get(at, F.lit(0)))
    values = F.slice("values", (F.col("halo") + F.col("__a")) * F.col("width") + 1, (F.col("__b") - F.col("__a")) * F.col("width"))
    return rows.select("recording_id", first.alias("first"), F.lit(0).alias("halo"), "width", at.alias("at"), values.alias("values"))


def in_order(rows: DataFrame, fold: Callable[[], Callable[[str, int, np.ndarray, np.ndarray], Iterator[tuple]]], schema: str) -> DataFrame:
    """rows (recording_id, kind, at, payload) of a recording in order of kind and at, through one fold each, as a stream.

    fold() makes a function that is called as f(recording_id, kind, ats, payloads) with consecutive rows,
    and at the end with kind -1; it gives rows of ``schema`` one after another. A task holds one recording's fold at a time, and
    rows of about frames.OUT_BYTES.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        key, step, none = None, None, np.empty(0)
        for pdf in batches:
            for (recording, kind), part in pdf.groupby(["recording_id", "kind"], sort=False):
                if recording != key:
                    if step:
                        yield from step(key, -1, none, none)
                    key, step = recording, fold()
                yield from step(key, int(kind), part["at"].to_numpy(), part["payload"].to_numpy())
        if step:
            yield from step(key, -1, none, none)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return put_together(made(batches), names)

    # dealt by a hash of the name: a union of tables that lie by recording_id already counts as dealt by it, but its parts are
    # coalesced each by itself, so that a recording's rows of different kinds would reach different tasks
    dealt = rows.select("recording_id", "kind", "at", "payload").repartition(F.xxhash64("recording_id")).sortWithinPartitions("recording_id", "kind", "at")
    return dealt.mapInPandas(task, schema)


def _null(v) -> float | None:
    return None if v is None or np.isnan(v) else float(v)


def adapt_whitening(covs: DataFrame, start: DataFrame, p: Params, every: int = 1) -> DataFrame:
    """(recording_id, version, w, c): whitening (flat) valid before batch ``version``, and the running covariance after it.

    covs: what batch_covariances returns; start (recording_id, w, c) flat. A batch of one row leaves both as they are.
    every: only of each so many batches.
    """
    head = start.select("recording_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.concat("w", "c").alias("payload"))
    body = covs.select("recording_id", F.lit(1).alias("kind"), F.col("batch_idx").alias("at"), F.col("cov").alias("payload"))

    def fold():
        w = c = None

        def step(key, kind, ats, payloads):
            nonlocal w, c
            if kind == 0:
                n = int(np.sqrt(len(payloads[0]) // 2))
                w, c = np.array(payloads[0]).reshape(2, n, n)
            if kind != 1 or w is None:
                return
            for b, flat in zip(ats, payloads, strict=True):
                was, x = w, np.asarray(flat).reshape(w.shape)
                if np.isfinite(x).all():
                    c = (1 - p.cov_alpha) * c + p.cov_alpha * (w @ x @ w.T)
                    w = w - p.wh_learning_rate * (c - np.eye(len(c))) @ w if p.adapt_wh else w
                if b % every == 0:
                    yield key, b, was.ravel(), c.ravel()

        return step

    return in_order(head.unionByName(body), fold, "recording_id string, version long, w array<double>, c array<double>")


STEP = "recording_id string, trial_id int, batch_idx long, unit int, samples array<long>, ipts array<double>, spikes array<long>, w array<double>, c array<double>, base_centr double, spikes_centr double, height double, sv_loss double, wh_loss double, total_loss double"


def start_rows(start: DataFrame, units: DataFrame) -> DataFrame:
    """The rows of a fold that come before the samples: kind 0 the whitening, kind 1 the units."""
    whole = start.select("recording_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.concat(F.array(_or_nan(start, "kl_mean"), _or_nan(start, "kl_std")), "w", "c").alias("payload"))
    return whole.unionByName(_unit_payloads(units))


def _or_nan(df: DataFrame, name: str) -> Column:
    there = F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
    return F.coalesce(there, F.lit(float("nan")))


def _unit_payloads(units: DataFrame) -> DataFrame:
    values = [F.col("unit").cast("double"), *[F.col(c).cast("double") for c in ("base_centr", "spikes_centr", "height")], _or_nan(units, "contrast_mean"), _or_nan(units, "contrast_std")]
    return units.select("recording_id", F.lit(1).alias("kind"), F.col("unit").cast("long").alias("at"), F.concat(F.array(*values), "w").alias("payload"))


def _unit_of(payload: np.ndarray) -> Unit:
    return Unit(int(payload[0]), np.array(payload[6:]), *map(float, payload[1:6]))


def started_runs(rows: dict[int, list[np.ndarray]], settings: list[Params], entries: int) -> list[Run]:
    """A run for each setting from the payloads of kinds 0 and 1; entries: of an extended sample."""
    whole = np.asarray(rows[0][0])
    # k rows of the whitening and k x k covariances
    k = round((np.sqrt(entries * entries + 4 * (len(whole) - 2)) - entries) / 2)
    size = k * entries
    w, c = whole[2 : 2 + size].reshape(k, -1), whole[2 + size :].reshape(k, k)
    units = lambda: [_unit_of(np.asarray(u)) for u in rows.get(1, [])]
    return [Run(p, w, c, units(), whole[0], whole[1]) for p in settings]


class Batches:
    """Samples of a recording in order, cut into batches: gaps are zeros, of repeated samples the first counts.

    A recording begins with the batch of its first sample.
    """

    def __init__(self, size: int, now: int | None = None):
        self.size, self.now = size, now
        self.at, self.x = np.empty(0, dtype=np.int64), None

    def add(self, at: np.ndarray, payloads: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(batch, its samples) of the batches that are full or over with these samples."""
        x = (payloads if payloads.ndim == 2 else np.stack(payloads)).astype(float, copy=False)
        if self.x is not None and len(self.x):
            at, x = np.concatenate([self.at, at]), np.concatenate([self.x, x])
        fresh = np.diff(at, prepend=at[0] - 1) > 0
        at, x = at[fresh], x[fresh]
        self.now = int(at[0]) // self.size if self.now is None else self.now
        last = int(at[-1]) // self.size
        while self.now < last:
            n = int(np.searchsorted(at, (self.now + 1) * self.size))
            yield self.now, self.filled(at[:n], x[:n], self.size)
            at, x, self.now = at[n:], x[n:], self.now + 1
        self.at, self.x = at, x

    def until(self, end: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """The batches before ``end``, all of them full."""
        x = np.zeros((0, width)) if self.x is None else self.x
        while self.now < end:
            n = int(np.searchsorted(self.at, (self.now + 1) * self.size))
            yield self.now, self.filled(self.at[:n], x[:n], self.size)
            self.at, x, self.now = self.at[n:], x[n:], self.now + 1
        self.x = x

    def rest(self) -> Iterator[tuple[int, np.ndarray]]:
        """The last batch, as long as its samples reach."""
        if len(self.at):
            yield self.now, self.filled(self.at, self.x, int(self.at[-1]) + 1 - self.now * self.size)

    def filled(self, at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, x.shape[1]))
        out[at - self.now * self.size] = x
        return out


def unit_rows(name: str, trial: int, batch: int, at: np.ndarray, made: list[tuple], whole: bool = True) -> Iterator[tuple]:
    """STEP rows of the units of a batch (Run.separate)."""
    for unit, ipt, hits, w, base, spikes, height, loss in made:
        arrays = (at, ipt, at[hits], w) if whole else (None, None, None, None)
        yield name, trial, batch, unit, *arrays, None, base, spikes, height, _null(loss), None, None


def _batch_row(name: str, trial: int, batch: int, done: dict, keep: bool) -> tuple:
    w, c = (done["w"].ravel(), done["c"].ravel()) if keep else (None, None)
    return name, trial, batch, None, None, None, None, w, c, None, None, None, None, _null(done["wh_loss"]), _null(done.get("total_loss"))


def adaptive_steps(signal: DataFrame, start: DataFrame, units: DataFrame, trials: list[tuple[int, Params]], whole: bool = True, snapshots: int | None = None, last_batch: int | None = None) -> DataFrame:
    """STEP rows: for each trial and batch one for every unit, and one (unit null) for the batch itself.

    signal (recording_id, sample_idx, channels), or packs of it; start (recording_id, w, c flat; kl_mean and kl_std of the
    calibration); units (recording_id, unit, w, base_centr, spikes_centr, height; contrast_mean and contrast_std).
    w need not be square. Parameters in a row are those from before its batch. whole: samples, ipts, spikes and vectors
    too, not losses alone; snapshots: whitening and covariance in the own row of each so many batches. Gaps in the samples are zeros, of repeated
    ones the first counts, and a recording begins with the batch of its first sample;
    recordings without a model give no rows. Trials are few and go to the tasks as they are; sizes of batches and delays
    are the same for all.
    """
    p = trials[0][1]
    if any((t.batch_size, t.ext_fact) != (p.batch_size, p.ext_fact) for _, t in trials):
        raise ValueError("trials must share batch_size and ext_fact")
    if last_batch is not None:
        signal = between(signal, None, last_batch * p.batch_size)
    rows = start_rows(start, units).unionByName(_sample_rows(signal))
    groups = [trials[i : i + TRIALS_PER_GROUP] for i in range(0, len(trials), TRIALS_PER_GROUP)]
    if len(groups) > 1:
        rows = rows.withColumn("recording_id", F.explode(F.array(*[F.concat(F.lit(f"{g}|"), "recording_id") for g in range(len(groups))])))

    def fold():
        begun, runs, names, delays, cut = {}, None, [], Delays(p), Batches(p.batch_size)

        def done(key: str, batch: int, raw: np.ndarray) -> Iterator[tuple]:
            if delays.tail is None:
                delays.start(batch)
            x, skip = delays.batch(raw)
            if not len(x):
                return
            name = key.split("|", 1)[1] if len(groups) > 1 else key
            at = np.arange(batch * p.batch_size + skip, batch * p.batch_size + len(raw))
            for trial, out in zip(names, runs.batch(x), strict=True):
                yield from unit_rows(name, trial, batch, at, out["units"], whole)
                yield _batch_row(name, trial, batch, out, snapshots is not None and batch % snapshots == 0)

        def step(key, kind, ats, payloads):
            nonlocal runs, names
            if kind in (0, 1):
                begun.setdefault(kind, []).extend(payloads)
            elif 0 in begun and kind in (2, PACKED):
                ats, payloads = samples_of(kind, ats, payloads)
                if runs is None:
                    mine = groups[int(key.split("|", 1)[0])] if len(groups) > 1 else trials
                    names = [t for t, _ in mine]
                    runs = together(started_runs(begun, [q for _, q in mine], len(payloads[0]) * p.ext_fact))
                for batch, raw in cut.add(ats, payloads):
                    yield from done(key, batch, raw)
            elif kind == -1:
                for batch, raw in cut.rest():
                    yield from done(key, batch, raw)

        return step

    return in_order(rows, fold, STEP)


def _sample_rows(signal: DataFrame) -> DataFrame:
    """The rows of a fold that are samples (kind 2), or packs of a signal (packed.pack; kind PACKED, see samples_of)."""
    if "values" in signal.columns:
        own = F.slice("values", F.col("halo") * F.col("width") + 1, F.size("values"))
        at = F.coalesce(F.col("at").cast("array<double>"), F.array().cast("array<double>"))
        payload = F.concat(F.array(F.col("width").cast("double"), F.size(at).cast("double")), at, own)
        return signal.select("recording_id", F.lit(PACKED).alias("kind"), F.col("first").alias("at"), payload.alias("payload"))
    return signal.select("recording_id", F.lit(2).alias("kind"), F.col("sample_idx").alias("at"), F.col("channels").alias("payload"))


#: z, or where that is shorter the samples it is made of (those before the batch first) with the whitening that makes it.
WHITENED = "recording_id string, batch_idx long, first long, n int, z array<double>, width int, raw array<double>, by array<double>, wh_loss double, w array<double>, c array<double>"


def whitened_batches(signal: DataFrame, start: DataFrame, p: Params, snapshots: int | None = None) -> DataFrame:
    """A row for each batch: its samples whitened (flat, see whitened_of) by the course that the whitening takes alone, from sample ``first`` on.

    Vectors and thresholds of units never reach the whitening, so that this is the part of the adaptation that a recording's
    units share. snapshots: as in adaptive_steps.
    """
    none = start.sparkSession.createDataFrame([], "recording_id string, unit int, w array<double>, base_centr double, spikes_centr double, height double")
    rows = start_rows(start, none).unionByName(_sample_rows(signal))

    def fold():
        begun, run, delays, cut = {}, None, Delays(p), Batches(p.batch_size)

        def done(key: str, batch: int, raw: np.ndarray) -> Iterator[tuple]:
            if delays.tail is None:
                delays.start(batch)
            before = np.zeros((p.ext_fact - 1, raw.shape[1])) if delays.tail is None else delays.tail
            x, skip = delays.batch(raw)
            if len(x):
                out = run.whiten(x)
                kept = (out["w"].ravel(), out["c"].ravel()) if snapshots is not None and batch % snapshots == 0 else (None, None)
                whole = np.concatenate([before, raw])
                short = whole.size + out["w"].size < out["z"].size
                samples = (None, raw.shape[1], whole.ravel(), out["w"].ravel()) if short else (out["z"].ravel(), raw.shape[1], None, None)
                yield key, batch, batch * p.batch_size + skip, len(x), *samples, _null(out["wh_loss"]), *kept

        def step(key, kind, ats, payloads):
            nonlocal run
            if kind == 0:
                begun[0] = list(payloads)
            elif 0 in begun and kind in (2, PACKED):
                ats, payloads = samples_of(kind, ats, payloads)
                run = started_runs(begun, [p], len(payloads[0]) * p.ext_fact)[0] if run is None else run
                for batch, raw in cut.add(ats, payloads):
                    yield from done(key, batch, raw)
            elif kind == -1:
                for batch, raw in cut.rest():
                    yield from done(key, batch, raw)

        return step

    return in_order(rows, fold, WHITENED)


def whitened_of(n: int, width: int, ext_fact: int, by: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The n whitened samples of a batch: values are they themselves, or with a whitening ``by`` the raw samples."""
    if not len(by):
        return values.reshape(n, -1)
    raw = values.reshape(-1, width)
    return delayed(raw, ext_fact)[-n:] @ by.reshape(-1, width * ext_fact).T


def separated_batches(whitened: DataFrame, units: DataFrame, p: Params, units_per_task: int) -> DataFrame:
    """STEP rows of the units over whitened batches (whitened_batches): units are dealt to groups, each of which goes through the batches by itself."""
    of = units.groupBy("recording_id").agg(F.count("*").alias("__n"))
    groups = of.select("recording_id", F.ceil(F.col("__n") / units_per_task).cast("int").alias("groups"))
    name = F.concat(F.col("group").cast("string"), F.lit("|"), "recording_id").alias("recording_id")
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy("unit")) - 1
    mine = units.withColumn("group", F.floor(nth / units_per_task).cast("int")).withColumn("recording_id", name)
    head = _unit_payloads(mine)
    each = whitened.join(groups, "recording_id").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    of_batch = [F.col("first"), F.col("n"), F.col("width"), F.when(F.col("by").isNull(), F.lit(0)).otherwise(F.size("by"))]
    made = F.when(F.col("z").isNotNull(), F.col("z")).otherwise(F.concat("by", "raw"))
    payload = F.concat(F.array(*[c.cast("double") for c in of_batch]), made)
    body = each.select(name, F.lit(2).alias("kind"), F.col("batch_idx").alias("at"), payload.alias("payload"))

    def fold():
        run = Run(p, np.empty(0), np.empty(0), [])

        def step(key, kind, ats, payloads):
            if kind == 1:
                run.units += [_unit_of(u) for u in payloads]
            elif kind == 2:
                for batch, row in zip(ats.tolist(), payloads, strict=True):
                    first, n, width, of_by = (int(v) for v in row[:4])
                    made = run.separate(whitened_of(n, width, p.ext_fact, row[4 : 4 + of_by], row[4 + of_by :]))
                    yield from unit_rows(key.split("|", 1)[1], 0, batch, np.arange(first, first + n), made)

        return step

    return in_order(head.unionByName(body), fold, STEP)


def decompose_adaptive(signal: DataFrame, start: DataFrame, units: DataFrame, p: Params, with_w: bool = False, snapshots: int | None = None, units_per_task: int | None = None) -> dict[str, DataFrame]:
    """Outputs of the adaptive decomposition: ipts, spikes, losses by batch and by unit, and the course of the parameters.

    Inputs as in adaptive_steps. All outputs come from one written table, so that the fold runs once. with_w: the whitening of
    every batch; snapshots: of each so many. With units_per_task a recording is not one task but one for the
    whitening and then one for each so many units, which pays where units are many; results are the same.
    """
    snapshots = 1 if with_w and snapshots is None else snapshots
    if units_per_task is None:
        steps = materialise(adaptive_steps(signal, start, units, [(0, p)], snapshots=snapshots), "steps")
        return outputs_of(steps.where("unit is not null"), steps.where("unit is null"))
    whitened = materialise(whitened_batches(signal, start, p, snapshots), "whitened")
    of_units = materialise(separated_batches(whitened, units, p, units_per_task), "unit-steps")
    added = of_units.groupBy("recording_id", "batch_idx").agg(F.sum("sv_loss").alias("sv"))
    total = (F.coalesce("wh_loss", F.lit(1e10)) + F.coalesce("sv", F.lit(0.0))) if p.compute_loss else F.lit(None).cast("double")
    of_batches = whitened.drop("z", "width", "raw", "by").join(added, ["recording_id", "batch_idx"], "left").withColumn("total_loss", total)
    return outputs_of(of_units, of_batches)


def outputs_of(of_units: DataFrame, of_batches: DataFrame) -> dict[str, DataFrame]:
    """The tables of a run, of its STEP rows."""
    keys = ("recording_id", "batch_idx")
    return {
        "steps": of_units,
        "ipts": of_units.select("recording_id", "unit", "batch_idx", F.inline(F.arrays_zip(F.col("samples").alias("sample_idx"), F.col("ipts").alias("ipt")))),
        "spikes": of_units.select("recording_id", "unit", "batch_idx", F.explode("spikes").alias("sample_idx")),
        "batch_metrics": of_batches.select(*keys, "wh_loss", "total_loss"),
        "unit_metrics": of_units.select(*keys, "unit", "sv_loss"),
        "model_units": of_units.select("recording_id", F.col("batch_idx").alias("version"), "unit", "w", "base_centr", "spikes_centr", "height"),
        "model_whitening": of_batches.select("recording_id", F.col("batch_idx").alias("version"), "w", "c").where("w is not null"),
    }


def replay(signal: DataFrame, start: DataFrame, units: DataFrame, whitening: DataFrame, course: DataFrame, p: Params) -> dict[str, DataFrame]:
    """The outputs of a run again, from its stored snapshots: stretches between snapshots run side by side.

    whitening (recording_id, version, w, c): snapshots from before the batches ``version``, as decompose_adaptive(snapshots=k) gives
    them in model_whitening; course: its model_units, of which the versions with a snapshot are read. start and
    units as in the run, for the statistics of the calibration. Each batch goes with the last snapshot at or before it, and
    batches before the first one are left out.
    """
    marks = materialise(whitening.select("recording_id", "version").distinct(), "snapshots")
    batches = signal.groupBy("recording_id", F.floor(F.col("sample_idx") / p.batch_size).cast("long").alias("batch")).agg(F.max(F.size("channels")).alias("width"))
    batches = materialise(batches, "batches")
    # the last snapshot at or before each batch, from one ordered pass over both
    both = batches.select("recording_id", "batch", F.lit(None).cast("long").alias("version")).unionByName(marks.select("recording_id", F.col("version").alias("batch"), "version"))
    asof = Window.partitionBy("recording_id").orderBy("batch", F.col("version").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    places = both.withColumn("from", F.last("version", ignorenulls=True).over(asof)).where("version is null and `from` is not null").select("recording_id", "batch", "from")
    places = materialise(places, "stretches")
    name = F.concat(F.col("from").cast("string"), F.lit("|"), "recording_id").alias("recording_id")
    rows = signal.withColumn("batch", F.floor(F.col("sample_idx") / p.batch_size).cast("long"))
    own = rows.join(places, ["recording_id", "batch"]).select(name, F.lit(2).alias("kind"), F.col("sample_idx").alias("at"), F.col("channels").alias("payload"))
    # the samples before a stretch that its first delays reach back to
    near = rows.where(F.col("sample_idx") % p.batch_size >= p.batch_size - p.ext_fact + 1).withColumn("from", F.col("batch") + 1).join(marks.withColumnRenamed("version", "from"), ["recording_id", "from"])
    near = near.select(name, F.lit(2).alias("kind"), F.col("sample_idx").alias("at"), F.col("channels").alias("payload"))
    # where a stretch ends: at the next snapshot, whether samples come up to there or not
    ends = marks.withColumn("end", F.lead("version").over(Window.partitionBy("recording_id").orderBy("version"))).where("`end` is not null").withColumnRenamed("version", "from")
    ends = ends.join(batches.groupBy("recording_id").agg(F.max("width").alias("width")), "recording_id")
    ends = ends.select(name, F.lit(3).alias("kind"), F.col("end").alias("at"), F.array(F.col("width").cast("double")).alias("payload"))
    calib = start.drop("w", "c").join(whitening.select("recording_id", F.col("version").alias("from"), "w", "c"), "recording_id").withColumn("recording_id", name).drop("from")
    stats = units.select("recording_id", "unit", *[c for c in ("contrast_mean", "contrast_std") if c in units.columns])
    then = course.withColumnRenamed("version", "from").join(marks.withColumnRenamed("version", "from"), ["recording_id", "from"]).join(stats, ["recording_id", "unit"])
    then = then.withColumn("recording_id", name).drop("from")

    def fold():
        begun, run, delays, cut = {}, None, Delays(p), None

        def done(key: str, batch: int, raw: np.ndarray) -> Iterator[tuple]:
            x, skip = delays.batch(raw)
            if len(x):
                out = run.batch(x)
                recording = key.split("|", 1)[1]
                yield from unit_rows(recording, 0, batch, np.arange(batch * p.batch_size + skip, batch * p.batch_size + len(raw)), out["units"])
                yield _batch_row(recording, 0, batch, out, False)

        def begin(first: int, width: int) -> None:
            nonlocal run, cut
            if run is None:
                run, cut = started_runs(begun, [p], width * p.ext_fact)[0], Batches(p.batch_size, first)
                delays.start(first)

        def step(key, kind, ats, payloads):
            if kind in (0, 1):
                begun.setdefault(kind, []).extend(payloads)
            elif 0 in begun and kind == 2:
                first = int(key.split("|", 1)[0])
                begin(first, len(payloads[0]))
                early = ats < first * p.batch_size
                if early.any():
                    tail = np.zeros((p.ext_fact - 1, len(payloads[0]))) if delays.tail is None else delays.tail
                    tail[ats[early] - (first * p.batch_size - p.ext_fact + 1)] = np.stack(payloads[early])
                    delays.start(first, tail)
                if not early.all():
                    for batch, raw in cut.add(ats[~early], payloads[~early]):
                        yield from done(key, batch, raw)
            elif 0 in begun and kind == 3:
                width = int(payloads[0][0])
                begin(int(key.split("|", 1)[0]), width)
                for batch, raw in cut.until(int(ats[0]), width):
                    yield from done(key, batch, raw)
            elif kind == -1 and cut is not None:
                for batch, raw in cut.rest():
                    yield from done(key, batch, raw)

        return step

    steps = materialise(in_order(start_rows(calib, then).unionByName(own).unionByName(near).unionByName(ends), fold, STEP), "replayed")
    return outputs_of(steps.where("unit is not null"), steps.where("unit is null"))


def recording_bounds(signal: DataFrame, batch_size: int) -> DataFrame:
    """(recording_id, begin, end, width): first batch, last sample and number of channels."""
    if "values" in signal.columns:
        last = F.when(F.col("at").isNull(), F.col("first") + F.size("values") / F.col("width") - F.col("halo") - 1).otherwise(F.array_max("at")).cast("long")
        begin = F.floor(F.min("first") / batch_size).cast("long").alias("begin")
        return signal.groupBy("recording_id").agg(begin, F.max(last).alias("end"), F.max("width").alias("width"))
    begin = F.floor(F.min("sample_idx") / batch_size).cast("long").alias("begin")
    return signal.groupBy("recording_id").agg(begin, F.max("sample_idx").alias("end"), F.max(F.size("channels")).alias("width"))


STRETCH = "recording_id string, trial_id int, batch_idx long, unit int, wh_loss double, sv_loss double, kind int, at long, payload array<double>"
#: The trial of states that serve all trials alike.
ANY_TRIAL = -1


def adaptive_stretch(signal: DataFrame, begun: DataFrame, bounds: DataFrame, state: DataFrame | None, trials: list[tuple[int, Params]], first: int, last: int) -> DataFrame:
    """The batches first to last - 1 of adaptive_steps, from the state that the batches before left: STRETCH rows.

    Rows with a batch_idx are losses (unit null: of the batch itself), those with a kind are the state (trial_id, kind, at, payload) that
    the next stretch takes. begun: start_rows, for recordings that begin within the stretch; bounds: recording_bounds; state: those rows
    of the stretch before, None for the first one. Stretches put together give the losses of one run, gaps included.
    """
    p = trials[0][1]
    groups = [trials[i : i + TRIALS_PER_GROUP] for i in range(0, len(trials), TRIALS_PER_GROUP)]
    begin, end = first * p.batch_size, last * p.batch_size
    live = bounds.where((F.col("begin") < last) & (F.col("end") >= begin))
    fresh = begun.join(live.where(F.col("begin") >= first).select("recording_id"), "recording_id", "left_semi")
    states = fresh.withColumn("trial_id", F.lit(ANY_TRIAL))
    if state is not None:
        going = state.join(live.select("recording_id"), "recording_id", "left_semi").where(F.col("trial_id").isin([t for t, _ in trials]))
        states = states.unionByName(going.select(*states.columns))
    every = F.array(*[F.lit(g) for g in range(len(groups))])
    group_of = F.create_map(*[F.lit(v) for g, of in enumerate(groups) for t, _ in of for v in (t, g)])
    of_trial = F.when(F.col("trial_id") == ANY_TRIAL, every).otherwise(F.array(F.element_at(group_of, F.col("trial_id"))))
    head = states.select("recording_id", "kind", "at", F.concat(F.array(F.col("trial_id").cast("double")), "payload").alias("payload"), F.explode(of_trial).alias("group"))
    own = between(signal, begin - p.ext_fact + 1, end)
    on = live.where(F.col("end") >= end).select("recording_id", F.lit(END).alias("kind"), F.lit(last).cast("long").alias("at"), F.array(F.col("width").cast("double")).alias("payload"))
    rows = _sample_rows(own).unionByName(on).withColumn("group", F.explode(every)).unionByName(head)
    rows = rows.withColumn("recording_id", F.concat_ws("|", "group", "recording_id"))

    def fold():
        states, runs, names, delays, cut, goes_on = {}, None, [], Delays(p), None, False

        def done(name: str, batch: int, raw: np.ndarray) -> Iterator[tuple]:
            if delays.tail is None:
                delays.start(batch)
            x, skip = delays.batch(raw)
            for trial, out in zip(names, runs.batch(x), strict=True) if len(x) else ():
                yield from ((name, trial, batch, u[0], None, _null(u[-1]), None, None, None) for u in out["units"])
                yield name, trial, batch, None, _null(out["wh_loss"]), None, None, None, None

        def begin_at(key: str, width: int) -> None:
            nonlocal runs, cut
            begun = []
            for trial, q in groups[int(key.split("|", 1)[0])]:
                of = trial if (0, trial) in states else ANY_TRIAL
                if (0, of) in states:
                    names.append(trial)
                    begun.append(started_runs({k: states.get((k, of), []) for k in (0, 1)}, [q], width * p.ext_fact)[0])
            runs = together(begun)
            known = (0, ANY_TRIAL) not in states
            cut = Batches(p.batch_size, first if known else None)
            if known:
                delays.start(first, np.zeros((p.ext_fact - 1, width)))

        def step(key, kind, ats, payloads):
            nonlocal goes_on
            name = key.split("|", 1)[1]
            if kind in (0, 1):
                for row in payloads:
                    states.setdefault((kind, int(row[0])), []).append(row[1:])
            elif kind in (2, PACKED) and states:
                ats, payloads = samples_of(kind, ats, payloads)
                if cut is None:
                    begin_at(key, len(payloads[0]))
                early = ats < begin
                for at, row in zip(ats[early][::-1], payloads[early][::-1], strict=True):  # of repeated samples the first counts
                    delays.tail[at - (begin - p.ext_fact + 1)] = row
                if not early.all():
                    for batch, raw in cut.add(ats[~early], payloads[~early]):
                        yield from done(name, batch, raw)
            elif kind == END and states:
                if cut is None:
                    begin_at(key, int(payloads[0][0]))
                goes_on = True
                for batch, raw in cut.until(last, int(payloads[0][0])):
                    yield from done(name, batch, raw)
            elif kind == -1 and cut is not None:
                if not goes_on:
                    for batch, raw in cut.rest():
                        yield from done(name, batch, raw)
                for trial, run in zip(names, runs.single(), strict=True) if goes_on else ():
                    whole = np.concatenate([[run.kl_mean, run.kl_std], run.w.ravel(), run.c.ravel()])
                    yield name, trial, None, None, None, None, 0, 0, whole
                    for u in run.units:
                        yield name, trial, None, None, None, None, 1, u.unit, np.concatenate([[u.unit, u.base, u.spikes, u.height, u.mean, u.std], u.w])

        return step

    return in_order(rows, fold, STRETCH)


def with_params(p: Params, **changes) -> Params:
    return Params(**(asdict(p) | changes))
