"""Butterworth filters along time, run in chunks of a recording side by side.

A filter is linear: each chunk is filtered from rest, the states at the ends of the
chunks are put together in order, and each chunk's response to the state it really starts
from is added. What a stretch of samples does to a state is an affine map, and maps compose: states are
put together within spans of SPAN chunks side by side, then a recording's spans (a row each) in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise
from .frames import in_runs, offsets, put_together, remove_offset

CHUNK = 512
#: Chunks whose states are put together in one task.
SPAN = 1024


@dataclass(frozen=True)
class System:
    """A filter in state space: s' = A s + B x, y = C s + D x."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float

    @property
    def rest(self) -> np.ndarray:
        """The state that a constant input of 1 settles in."""
        return np.linalg.solve(np.eye(len(self.b)) - self.a, self.b)

    def powers(self, n: int) -> Powers:
        """What n samples do: a part of what CHUNK (or more) do, which is made once in a process for each filter."""
        size = max(CHUNK, n)
        key = (self.a.tobytes(), self.b.tobytes(), self.c.tobytes(), float(self.d), size)
        if key not in _POWERS:
            if len(_POWERS) >= 16:
                _POWERS.clear()
            _POWERS[key] = _whole(self, size)
        outputs, free, reach, steps = _POWERS[key]
        return Powers(outputs[:n, :n], free[:n], reach[:, size - n :], steps[n])


@dataclass(frozen=True)
class Powers:
    """n samples as matrices: outputs are ``outputs @ x + free @ state``, the state after them ``reach @ x + step @ state``."""

    outputs: np.ndarray
    free: np.ndarray
    reach: np.ndarray
    step: np.ndarray


def _whole(system: System, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    states = len(system.b)
    free, reach, steps = np.zeros((n, states)), np.zeros((states, n)), np.zeros((n + 1, states, states))
    steps[0] = np.eye(states)
    for k in range(n):
        free[k], reach[:, n - 1 - k] = system.c @ steps[k], steps[k] @ system.b
        steps[k + 1] = system.a @ steps[k]
    impulse = np.concatenate([[system.d], (free @ system.b)[:-1]])
    # row i of the outputs: the impulse response turned around, up to sample i
    lags = np.subtract.outer(np.arange(n), np.arange(n))
    return np.where(lags >= 0, impulse[np.maximum(lags, 0)], 0.0), free, reach, steps


_POWERS: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def butterworth(kind: str, order: int, cut: float | tuple[float, float], fs: float) -> System:
    """kind: "low", "high", "band" or "stop"; cut in Hz (two for the last two). Bilinear, prewarped."""
    cuts = np.atleast_1d(np.asarray(cut, dtype=float))
    if kind not in ("low", "high", "band", "stop") or len(cuts) != (1 if kind in ("low", "high") else 2):
        raise ValueError(f"unknown filter {kind!r} with {len(cuts)} cutoffs")
    if not ((cuts > 0) & (cuts < fs / 2)).all():
        raise ValueError("cutoffs must lie between 0 and half the sampling rate")
    warped = 2 * fs * np.tan(np.pi * cuts / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "low":
        poles, zeros, gain = poles * warped[0], np.zeros(0), warped[0] ** order
    elif kind == "high":
        zeros, gain, poles = np.zeros(order), 1.0, warped[0] / poles
    else:
        width, middle = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = (poles if kind == "band" else 1 / poles) * width / 2
        root = np.sqrt(half**2 - middle**2 + 0j)
        poles = np.concatenate([half + root, half - root])
        zeros = np.zeros(order) if kind == "band" else np.concatenate([np.full(order, 1j * middle), np.full(order, -1j * middle)])
        gain = width**order if kind == "band" else 1.0
    rate = 2 * fs
    gain = gain * np.real(np.prod(rate - zeros) / np.prod(rate - poles))
    zeros = np.concatenate([(rate + zeros) / (rate - zeros), -np.ones(len(poles) - len(zeros))])
    poles = (rate + poles) / (rate - poles)
    return _cascade(_pairs(zeros), _pairs(poles), gain)


def _pairs(roots: np.ndarray) -> list[np.ndarray]:
    """Real polynomials of degree 2 or 1 with these roots, conjugates together, nearest the unit circle last."""
    roots = sorted(roots, key=lambda r: (abs(r.imag) < 1e-10, abs(r), r.real, r.imag))
    up = [r for r in roots if r.imag > 1e-10]
    real = [r.real for r in roots if abs(r.imag) <= 1e-10]
    out = [np.array([1.0, -2 * r.real, abs(r) ** 2]) for r in up]
    out += [np.poly(real[i : i + 2]) for i in range(0, len(real), 2)]
    return out


def _cascade(zeros: list[np.ndarray], poles: list[np.ndarray], gain: float) -> System:
    total = None
    zeros = sorted(zeros, key=len, reverse=True)
    poles = sorted(poles, key=len, reverse=True)
    for num, den in zip(zeros, poles, strict=True):
        num, den = np.pad(num, (0, 3 - len(num))), np.pad(den, (0, 3 - len(den)))
        # transposed direct form of one section
        part = System(np.array([[-den[1], 1.0], [-den[2], 0.0]]), num[1:] - den[1:] * num[0], np.array([1.0, 0.0]), float(num[0]))
        total = part if total is None else _chain(total, part)
    return System(total.a, total.b * gain, total.c, total.d * gain)


def _chain(first: System, then: System) -> System:
    n, m = len(first.b), len(then.b)
    a = np.zeros((n + m, n + m))
    a[:n, :n], a[n:, n:], a[n:, :n] = first.a, then.a, np.outer(then.b, first.c)
    return System(a, np.concatenate([first.b, then.b * first.d]), np.concatenate([then.d * first.c, then.c]), then.d * first.d)


def run(system: System, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, channels) filtered from a state (states, channels), and the state after; CHUNK samples at a time."""
    out = []
    for i in range(0, len(x), CHUNK):
        part = x[i : i + CHUNK]
        m = system.powers(len(part))
        out.append(m.outputs @ part + m.free @ state)
        state = m.reach @ part + m.step @ state
    return (np.concatenate(out) if out else np.zeros_like(x, dtype=float)), state


def apply(df: DataFrame, system: System, chunk: int = CHUNK, settled: bool = False, span: int = SPAN) -> DataFrame:
    """df (recording_id, sample_idx, channels) filtered forwards in time.

    From rest, or settled on the first sample. Sample indices start anywhere but have no gaps.
    """
    cols = df.select("recording_id", "sample_idx", "channels").withColumn("chunk", F.floor(F.col("sample_idx") / chunk).cast("long"))
    states = len(system.b)

    def local(group):
        x = np.stack(group["channels"])
        y, end = run(system, x, np.zeros((states, x.shape[1])))
        yield group["recording_id"][0], int(group["chunk"][0]), int(group["sample_idx"][0]), len(x), x[0], y.ravel(), end.ravel()

    schema = "recording_id string, chunk long, start long, n int, first array<double>, y array<double>, state array<double>"
    # read twice, to put the states together and by the correction
    parts = materialise(in_runs(cols, ("recording_id", "chunk"), "sample_idx", local, schema), "filter-chunks")

    def within(group):
        """Each chunk's state as if its span began at rest, the samples of the span before it, and a row (chunk null) for the whole span."""
        recording, of = group["recording_id"][0], int(group["span"][0])
        state, done = np.zeros((states, len(group["first"][0]))), 0
        for at, n, end in zip(group["chunk"].tolist(), group["n"].tolist(), group["state"], strict=True):
            yield at, done, state.ravel(), None, recording, of
            state = np.asarray(end).reshape(state.shape) + system.powers(n).step @ state
            done += n
        yield None, done, state.ravel(), group["first"][0], recording, of

    of_span = parts.select("recording_id", F.floor(F.col("chunk") / span).cast("long").alias("span"), "chunk", "n", "first", "state")
    made = "chunk long, before long, local array<double>, first array<double>, recording_id string, span long"
    put = materialise(in_runs(of_span, ("recording_id", "span"), "chunk", within, made), "filter-states")

    def fold(group):
        state = None
        for of, first, end, n in zip(group["span"].tolist(), group["first"], group["local"], group["before"].tolist(), strict=True):
            end = np.asarray(end).reshape(states, -1)
            if state is None:
                state = np.outer(system.rest, np.asarray(first)) if settled else np.zeros_like(end)
            yield group["recording_id"][0], of, state.ravel()
            state = end + np.linalg.matrix_power(system.a, n) @ state

    spans = put.where("chunk is null").drop("chunk")
    begins = in_runs(spans, ("recording_id",), "span", fold, "recording_id string, span long, begin array<double>")

    def added(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                begin = np.asarray(r.begin).reshape(states, -1)
                state = np.asarray(r.local).reshape(states, -1)
                if begin.any():
                    state = state + np.linalg.matrix_power(system.a, int(r.before)) @ begin
                y = np.array(r.y).reshape(r.n, -1)
                for i in range(0, r.n if state.any() else 0, CHUNK):
                    m = system.powers(min(CHUNK, r.n - i))
                    y[i : i + CHUNK] += m.free @ state
                    state = m.step @ state
                yield r.recording_id, r.start, r.n, y.ravel()

    def add(batches):
        return put_together(added(batches), ["recording_id", "start", "n", "y"])

    states_of = put.where("chunk is not null").join(begins, ["recording_id", "span"]).select("recording_id", "chunk", "before", "local", "begin")
    joined = parts.select("recording_id", "chunk", "start", "n", "y").join(states_of, ["recording_id", "chunk"])
    whole = joined.mapInPandas(add, "recording_id string, start long, n int, y array<double>")
    # a chunk is cut into its samples by Spark
    width = (F.size("y") / F.col("n")).cast("int").alias("width")
    each = whole.select("recording_id", "start", "y", width, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select("recording_id", (F.col("start") + F.col("i")).alias("sample_idx"), F.slice("y", F.col("i") * F.col("width") + 1, F.col("width")).alias("channels"))


def _reverse(df: DataFrame, ends: DataFrame) -> DataFrame:
    """Time turned around in each recording, from its last sample (recording_id, last) on."""
    return df.join(ends, "recording_id").withColumn("sample_idx", F.col("last") - F.col("sample_idx")).drop("last")


def _padded(df: DataFrame, pad: int) -> DataFrame:
    """Recordings from 0 on with ``pad`` samples at both ends, turned around their end points."""
    ends = df.groupBy("recording_id").agg(F.min("sample_idx").alias("a"), F.max("sample_idx").alias("b"), F.min(F.struct("sample_idx", "channels")).alias("x"), F.max(F.struct("sample_idx", "channels")).alias("z"))
    near = df.join(ends, "recording_id")
    turned = lambda at: F.zip_with(F.col(at)["channels"], "channels", lambda e, v: 2 * e - v)
    head = near.where((F.col("sample_idx") > F.col("a")) & (F.col("sample_idx") <= F.col("a") + pad)).select("recording_id", (2 * F.col("a") - F.col("sample_idx")).alias("sample_idx"), turned("x").alias("channels"))
    tail = near.where((F.col("sample_idx") < F.col("b")) & (F.col("sample_idx") >= F.col("b") - pad)).select("recording_id", (2 * F.col("b") - F.col("sample_idx")).alias("sample_idx"), turned("z").alias("channels"))
    return df.select("recording_id", "sample_idx", "channels").unionByName(head).unionByName(tail).withColumn("sample_idx", F.col("sample_idx") + pad)


def zero_phase(df: DataFrame, system: System, chunk: int = CHUNK) -> DataFrame:
    """Filtered forwards, then backwards. Recordings must be longer than the padding of 3 (states + 1)."""
    pad = 3 * (len(system.b) + 1)
    # read several times below
    df = materialise(df.select("recording_id", "sample_idx", "channels"), "unfiltered")
    bounds = materialise(df.groupBy("recording_id").agg(F.min("sample_idx").alias("a"), F.max("sample_idx").alias("b")), "bounds")
    last = bounds.select("recording_id", (F.col("b") + 2 * pad).alias("last"))
    turned = bounds.select("recording_id", (F.col("b") + 2 * pad - F.col("a")).alias("last"))
    once = apply(_padded(df, pad), system, chunk, settled=True)
    twice = _reverse(apply(_reverse(once, last), system, chunk, settled=True), turned).withColumn("sample_idx", F.col("sample_idx") - pad)
    return twice.join(df.select("recording_id", "sample_idx"), ["recording_id", "sample_idx"])


def _filter(df: DataFrame, system: System, zero: bool, chunk: int) -> DataFrame:
    return zero_phase(df, system, chunk) if zero else apply(df, system, chunk)


def bandpass(df: DataFrame, fs: float, lo: float = 20, hi: float = 500, order: int = 4, zero: bool = True, chunk: int = CHUNK) -> DataFrame:
    return _filter(df, butterworth("band", order, (lo, hi), fs), zero, chunk)


def highpass(df: DataFrame, fs: float, cut: float = 20, order: int = 2, zero: bool = True, chunk: int = CHUNK) -> DataFrame:
    return _filter(df, butterworth("high", order, cut, fs), zero, chunk)


def lowpass(df: DataFrame, fs: float, cut: float = 500, order: int = 2, zero: bool = True, chunk: int = CHUNK) -> DataFrame:
    return _filter(df, butterworth("low", order, cut, fs), zero, chunk)


def notch(df: DataFrame, fs: float, freq: float = 50, width: float = 1, order: int = 2, zero: bool = True, chunk: int = CHUNK) -> DataFrame:
    return _filter(df, butterworth("stop", order, (freq - width / 2, freq + width / 2), fs), zero, chunk)


def preprocess(df: DataFrame, fs: float, lo: float, hi: float, powerline: float | None) -> tuple[DataFrame, DataFrame]:
    """Band-pass, notch if asked for, both forwards only, then the offset taken off; the offsets too."""
    out = bandpass(df, fs, lo, hi, zero=False)
    if powerline is not None:
        out = notch(out, fs, powerline, zero=False)
    # read for the offsets and by their subtraction
    out = materialise(out, "filtered")
    return remove_offset(out), offsets(out)
