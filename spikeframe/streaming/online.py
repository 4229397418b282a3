"""Streaming: causal filters and the adaptive decomposition, with state between micro-batches and event time.

Samples may come in any order, in any cut, and not at all. Those of a recording wait in state, by batch of samples,
until their batch is full and the one before it is done; where samples are missing, until the watermark has passed the
end of the batch: then a timer goes off and the gaps count as zeros. What comes for a batch that is done is late: it
is left out and counted.

Recordings are dealt to groups by a hash, and a group is a key of the state: a call of Spark's, and of its state, serves all
recordings of a group. State is in pieces, so that a micro-batch writes what it changed: the places in the group's recordings,
the samples that wait (a map by batch), and the models (a map by recording). Arrays of numbers are kept as their bytes. Queries
need the RocksDB state store (``state_store``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.adapt import Delays, Params, Run, Unit, start_rows, started_runs
from ..operators.filters import System, run
from ..operators.frames import put_together

#: Groups that recordings are dealt to, fixed for the life of a query.
GROUPS = 1024
#: Numbers of a group's input that are taken in together.
TOGETHER = 1 << 23
_PACK = "recording_id string, width int, zero long, at array<long>, samples array<double>"


def state_store(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which these operators need; for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _pack(rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Samples (recording_id, sample_idx, channels, at) to rows of those of a recording in an Arrow batch, in the order they came.

    zero: the earliest time of sample 0 that they tell.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in ("channels", "sample_idx", "at"):
                batch = batch.filter(pc.is_valid(batch.column(c)))
            if not batch.num_rows:
                continue
            recordings = np.asarray(batch.column("recording_id").dictionary_encode().indices.fill_null(-1))
            order = np.argsort(recordings, kind="stable")
            batch, recordings = batch.take(pa.array(order)), recordings[order]
            at, channels = batch.column("sample_idx").to_numpy(), batch.column("channels")
            widths = channels.value_lengths().to_numpy()
            change = (recordings[1:] != recordings[:-1]) | (widths[1:] != widths[:-1])
            edges = np.concatenate([[0], np.flatnonzero(change) + 1, [len(at)]])
            first = edges[:-1]
            zero = np.minimum.reduceat(batch.column("at").to_numpy() - np.round(at * 1e6 / rate).astype(np.int64), first)
            ends = np.concatenate([[0], np.cumsum(widths)])[edges]
            lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            columns = [batch.column("recording_id").take(pa.array(first)), pa.array(widths[first], pa.int32()), pa.array(zero, pa.int64()), lists(edges, pa.array(at, pa.int64())), lists(ends, channels.flatten())]
            yield pa.RecordBatch.from_arrays(columns, names=["recording_id", "width", "zero", "at", "samples"])

    return pack


def _together(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in tables of about TOGETHER numbers."""
    held, size = [], 0
    for pdf in rows:
        held.append(pdf)
        size += sum(map(len, pdf["samples"]))
        if size > TOGETHER:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


@dataclass
class Place:
    """Where a recording is: its next batch (None: none yet), the time of sample 0, channels, the end it waits for, the
    batches that wait, and what an operator with little to carry on keeps here."""

    next: int | None
    zero: int
    width: int
    timer: int | None = None
    waiting: set[int] = field(default_factory=set)
    own: bytes | None = None


class Ordered(StatefulProcessor):
    """Samples of a group's recordings put in order, batch by batch; what happens to a batch is for subclasses to say.

    Input rows: those of _pack. A sample's time is that of sample 0 plus its number over ``rate``; a batch ends with
    its last sample's.
    """

    columns: list[str] = []

    def __init__(self, size: int, rate: float):
        self.size, self.rate = size, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getValueState("places", "recordings array<string>, next array<long>, zero array<long>, width array<int>, timer array<long>, waiting array<binary>, own array<binary>")
        self.waiting = handle.getMapState("waiting", "batch long", "recordings array<string>, at array<binary>, samples array<binary>")

    def close(self) -> None:
        pass

    def known(self, name: str | None) -> bool:
        """Whether the recording is worth keeping at all."""
        return True

    def begin(self, name: str | None, place: Place) -> None:
        """Called once for a recording, before its first batch."""

    def batch(self, name: str | None, place: Place, batch: int, raw: np.ndarray, there: np.ndarray) -> Iterator[tuple]:
        """Rows (without recording) for a batch's samples, gaps as zeros; there: which samples came."""
        raise NotImplementedError

    def late(self, batch: int, n: int) -> Iterator[tuple]:
        """Rows for n samples that came after their batch was done."""
        return iter(())

    def finish(self, name: str | None) -> None:
        """Called when no more can be done for a recording: what was carried along goes to state."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for packs in _together(rows):
            yield from self._turn(timerValues.getCurrentWatermarkInMs(), packs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._turn(timerValues.getCurrentWatermarkInMs())

    def _turn(self, watermark: int, packs: pd.DataFrame | None = None) -> Iterator[pd.DataFrame]:
        """Take in packs, or go on where the watermark has passed the end that a recording waits for."""
        places = self._places()
        timers = {p.timer for p in places.values()}
        if packs is None and not any(t is not None and t <= watermark for t in timers):
            return
        #: Samples that wait, by batch and recording, as far as they were needed, and the batches where that changed.
        self.held: dict[int, dict[str | None, tuple[np.ndarray, np.ndarray]]] = {}
        self.changed: set[int] = set()
        rows = self._passed(places, watermark) if packs is None else self._taken(places, packs, watermark)
        yield from put_together(rows, ["recording_id", *self.columns])
        for b in self.changed:
            self._keep(b)
        if places:
            self._keep_places(places)
        now = {p.timer for p in places.values()}
        for t in now - timers - {None}:
            self.handle.registerTimer(t)
        for t in timers - now - {None}:
            # Spark itself removes those that go off
            if t > watermark:
                self.handle.deleteTimer(t)

    def _taken(self, places: dict[str | None, Place], packs: pd.DataFrame, watermark: int) -> Iterator[tuple]:
        came: dict[str | None, list] = {}
        for r in packs.itertuples(index=False):
            came.setdefault(r.recording_id, []).append(r)
        for name, parts in came.items():
            place = places.get(name)
            if place is None:
                if not self.known(name):
                    continue
                # the earliest is what the clock of the recording starts from
                place = places[name] = Place(None, min(int(r.zero) for r in parts), int(parts[0].width))
            if any(r.width != place.width for r in parts):
                raise ValueError(f"recording {name!r} has samples of different widths")
            at = np.concatenate([r.at for r in parts])
            x = np.concatenate([r.samples for r in parts]).reshape(len(at), place.width)
            batches = at // self.size
            for b in np.unique(batches).tolist():
                mine = batches == b
                if place.next is not None and b < place.next:
                    yield from ((name, *row) for row in self.late(b, int(mine.sum())))
                    continue
                piece = self._piece(b)
                all_at, all_x = at[mine], x[mine]
                if name in piece:
                    old_at, old_x = piece[name]
                    all_at, all_x = np.concatenate([old_at, all_at]), np.concatenate([old_x.reshape(len(old_at), place.width), all_x])
                # of repeated samples the first one counts
                all_at, first = np.unique(all_at, return_index=True)
                piece[name] = all_at, all_x[first]
                place.waiting.add(b)
                self.changed.add(b)
            yield from self._go_on(name, place, watermark)

    def _passed(self, places: dict[str | None, Place], watermark: int) -> Iterator[tuple]:
        for name, place in places.items():
            if place.timer is not None and place.timer <= watermark:
                yield from self._go_on(name, place, watermark)

    def _places(self) -> dict[str | None, Place]:
        if not self.places.exists():
            return {}
        names, *columns, waiting, own = self.places.get()
        batches = [set(np.frombuffer(w, dtype=np.int64).tolist()) for w in waiting]
        return {n: Place(*r) for n, *r in zip(names, *columns, batches, own, strict=True)}

    def _keep_places(self, places: dict[str | None, Place]) -> None:
        rows = [(n, p.next, p.zero, p.width, p.timer, np.array(sorted(p.waiting), dtype=np.int64).tobytes(), p.own) for n, p in places.items()]
        self.places.update(tuple(map(list, zip(*rows, strict=True))))

    def _piece(self, b: int) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
        """The samples that wait for a batch, by recording."""
        if b not in self.held:
            names, at, samples = self.waiting.getValue((b,)) or ((), (), ())
            self.held[b] = {n: (np.frombuffer(i, dtype=np.int64), np.frombuffer(x)) for n, i, x in zip(names, at, samples, strict=True)}
        return self.held[b]

    def _keep(self, b: int) -> None:
        piece = self.held[b]
        if piece:
            self.waiting.updateValue((b,), (list(piece), [i.tobytes() for i, _ in piece.values()], [x.tobytes() for _, x in piece.values()]))
        elif self.waiting.containsKey((b,)):
            self.waiting.removeKey((b,))

    def _end(self, place: Place, batch: int) -> int:
        """When all of the batch should have come, in milliseconds."""
        return int(np.ceil((place.zero + (batch + 1) * self.size * 1e6 / self.rate) / 1000))

    def _go_on(self, name: str | None, place: Place, watermark: int) -> Iterator[tuple]:
        """Do what can be done; note what the rest waits for."""
        place.timer = None
        while place.waiting:
            if place.next is None:
                earliest = min(place.waiting)
                # a batch before the earliest may still come
                if earliest > 0 and watermark < self._end(place, earliest - 1):
                    place.timer = self._end(place, earliest - 1)
                    break
                place.next = earliest
                self.begin(name, place)
            b = place.next
            here = b in place.waiting
            at, x = self._piece(b)[name] if here else (np.empty(0, dtype=np.int64), None)
            if len(at) < self.size and watermark < self._end(place, b):
                place.timer = self._end(place, b)
                break
            n = self.size if len(place.waiting) > here else int(at.max()) - b * self.size + 1
            raw, there = np.zeros((n, place.width)), np.zeros(n, dtype=bool)
            if here:
                raw[at - b * self.size], there[at - b * self.size] = x.reshape(len(at), place.width), True
            yield from ((name, *row) for row in self.batch(name, place, b, raw, there))
            if here:
                place.waiting.discard(b)
                del self._piece(b)[name]
                self.changed.add(b)
            place.next = b + 1
        self.finish(name)


class Filtering(Ordered):
    """Forward filtering, its rows stretches of samples; samples that never came are zeros for the filter and are left out."""

    columns = ["start", "n", "y"]

    def __init__(self, system: System, size: int, rate: float):
        super().__init__(size, rate)
        self.system = system

    def batch(self, name, place, batch, raw, there):
        state = np.zeros((len(self.system.b), place.width)) if place.own is None else np.frombuffer(place.own).reshape(-1, place.width)
        y, state = run(self.system, raw, state)
        place.own = state.tobytes()
        edges = np.flatnonzero(np.diff(there, prepend=False, append=False))
        for a, z in edges.reshape(-1, 2).tolist():
            yield batch * self.size + a, z - a, y[a:z].ravel()


def _arrivals(stream: DataFrame, time_col: str, delay: str, rate: float, groups: int) -> DataFrame:
    """Packs of the stream under its watermark, and their group; the event time as a plain number: Spark itself then drops no late row, and they can be counted."""
    marked = stream.withWatermark(time_col, delay)
    rows = marked.select("recording_id", "sample_idx", F.col("channels").cast("array<double>").alias("channels"), (F.unix_micros(time_col) + F.lit(0)).alias("at"))
    return rows.mapInArrow(_pack(rate), _PACK).withColumn("group", _group(groups))


def _group(groups: int) -> Column:
    return F.pmod(F.xxhash64("recording_id"), F.lit(groups))


def filter_stream(stream: DataFrame, system: System, rate: float, time_col: str = "ts", delay: str = "10 seconds", size: int = 256, groups: int = GROUPS) -> DataFrame:
    """(recording_id, sample_idx, channels) filtered forwards, the filter's state carried from one micro-batch to the next.

    stream (recording_id, sample_idx, channels, and a timestamp); samples may come in any order up to the delay. They leave in
    batches of ``size``; the last, shorter one of a recording leaves when the watermark passes its end. A task holds what waits in
    one of the ``groups`` at a time; with very many recordings take more.
    """
    packs = _arrivals(stream, time_col, delay, rate, groups)
    out = packs.groupBy("group").transformWithStateInPandas(Filtering(system, size, rate), "recording_id string, start long, n int, y array<double>", "append", "eventTime")
    # a stretch is cut into its samples by Spark
    width = (F.size("y") / F.col("n")).cast("int")
    samples = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((F.col("start") + i).alias("sample_idx"), F.slice("y", i * width + 1, width).alias("channels")))
    return out.select("recording_id", F.inline(samples))


#: Rows of decompose_stream. kind: unit, batch or late.
ONLINE = "recording_id string, kind string, batch_idx long, unit int, samples array<long>, ipts array<double>, spikes array<long>, w array<double>, c array<double>, base_centr double, spikes_centr double, height double, sv_loss double, wh_loss double, total_loss double, n_samples long, n_missing long, n_late long"


class Decomposing(Ordered):
    """The adaptive decomposition; a recording's model and delays are a state of their own, written when batches were done."""

    columns = [c.strip().split(" ")[0] for c in ONLINE.split(",")][1:]

    def __init__(self, p: Params, rate: float, snapshots: int | None):
        super().__init__(p.batch_size, rate)
        self.p, self.snapshots = p, snapshots

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # marks of a unit: base, spikes, height, mean, std; no tail before the first batch
        self.models = handle.getMapState("models", "recording_id string", "w binary, c binary, kl_mean double, kl_std double, units array<int>, marks binary, vectors array<binary>, next long, tail binary")
        self.run, self.delays = None, None

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            whole, *units = r.payloads
            self._write(r.recording_id, started_runs({0: [whole], 1: units}, [self.p], int(r.entries))[0], None)

    def known(self, name):
        return name is not None and self.models.containsKey((name,))

    def _write(self, name: str, run: Run, delays: Delays | None) -> None:
        marks = np.array([(u.base, u.spikes, u.height, u.mean, u.std) for u in run.units], dtype=float)
        ahead = (None, None) if delays is None else (delays.next, delays.tail.tobytes())
        model = np.asarray(run.w, dtype=float).tobytes(), np.asarray(run.c, dtype=float).tobytes(), float(run.kl_mean), float(run.kl_std)
        self.models.updateValue((name,), (*model, [u.unit for u in run.units], marks.tobytes(), [np.asarray(u.w, dtype=float).tobytes() for u in run.units], *ahead))

    def _read(self, name: str, width: int) -> None:
        w, c, mean, std, units, marks, vectors, after, tail = self.models.getValue((name,))
        number = lambda b: np.frombuffer(b).copy()
        k = round(np.sqrt(len(c) // 8))
        of = [Unit(int(u), number(v), *m) for u, v, m in zip(units, vectors, number(marks).reshape(-1, 5).tolist(), strict=True)]
        of.sort(key=lambda u: u.unit)
        self.run = Run(self.p, number(w).reshape(k, -1), number(c).reshape(k, k), of, mean, std)
        self.delays = Delays(self.p)
        if tail is not None:
            self.delays.start(int(after), number(tail).reshape(self.p.ext_fact - 1, width))

    def begin(self, name, place):
        self._read(name, place.width)
        self.delays.start(place.next, np.zeros((self.p.ext_fact - 1, place.width)))

    def batch(self, name, place, batch, raw, there):
        if self.run is None:
            self._read(name, place.width)
        x, skip = self.delays.batch(raw)
        first, out = batch * self.size + skip, []
        counts = (int(there.sum()), int((~there).sum()), 0)
        none = lambda n: (None,) * n
        if len(x):
            done = self.run.batch(x)
            at = np.arange(first, first + len(x))
            for unit, ipt, hits, w, base, spikes, height, loss in done["units"]:
                out.append(("unit", batch, unit, at, ipt, at[hits], w, None, base, spikes, height, _null(loss), *none(2), *none(3)))
            keep = self.snapshots is not None and batch % self.snapshots == 0
            w, c = (done["w"].ravel(), done["c"].ravel()) if keep else none(2)
            out.append(("batch", batch, *none(4), w, c, *none(4), _null(done["wh_loss"]), _null(done["total_loss"]), *counts))
        return out

    def late(self, batch, n):
        return [("late", batch, *(None,) * 14, n)]

    def finish(self, name):
        if self.run is not None:
            self._write(name, self.run, self.delays)
            self.run = None


def _null(v: float) -> float | None:
    return None if np.isnan(v) else float(v)


def decompose_stream(stream: DataFrame, start: DataFrame, units: DataFrame, p: Params, rate: float, time_col: str = "ts", delay: str = "10 seconds", snapshots: int | None = None, groups: int = GROUPS) -> DataFrame:
    """ONLINE rows of the adaptive decomposition: for each batch one for every unit (kind ``unit``) and one for itself (``batch``).

    stream (recording_id, sample_idx, channels, and a timestamp). start and units are tables as in adapt.adaptive_steps, with the
    models of all recordings that may come; recordings without one are left out and take no state. A batch is done when it is full and the
    one before it is done, or when the watermark has passed its end; gaps are zeros (n_missing), and a recording's last batch is
    as long as its samples reach. Rows of kind ``late`` count the samples that came later than that (n_late, by batch). A recording
    begins with the batch of its first sample. Recordings are dealt to ``groups`` as in filter_stream.
    """
    packs = _arrivals(stream, time_col, delay, rate, groups)
    size = start.select("recording_id", F.size("w").alias("__w"), F.sqrt(F.size("c").cast("double")).cast("int").alias("__k"))
    # a row for each recording: the whitening, then its units
    payloads = F.array_sort(F.collect_list(F.struct("kind", "at", "payload")))
    whole = start_rows(start, units).groupBy("recording_id").agg(F.transform(payloads, lambda r: r["payload"]).alias("payloads"))
    models = whole.join(size, "recording_id").select("recording_id", "payloads", F.floor(F.col("__w") / F.col("__k")).cast("int").alias("entries"), _group(groups).alias("group"))
    return packs.groupBy("group").transformWithStateInPandas(Decomposing(p, rate, snapshots), ONLINE, "append", "eventTime", models.groupBy("group"))


def trajectory(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model_units, model_whitening) of ONLINE rows, as adapt.decompose_adaptive gives them."""
    of_units, of_batches = rows.where("kind = 'unit'"), rows.where("kind = 'batch' and w is not null")
    return (
        of_units.select("recording_id", F.col("batch_idx").alias("version"), "unit", "w", "base_centr", "spikes_centr", "height"),
        of_batches.select("recording_id", F.col("batch_idx").alias("version"), "w", "c"),
    )
