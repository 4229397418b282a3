"""Agreement between spike trains: lags, matched firings, assigned units."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise
from .frames import BLOCK, in_runs

PAIR = ("recording_id", "unit_ref", "unit_test")
#: Pairs of firings that are looked at together.
DENSE = 1 << 18
#: The same for rows of differences that stay in a core's cache.
ROWS = 1 << 15


def _pairs_within(ref: DataFrame, test: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """ref and test times (keys, a) and (keys, b) with abs(a - b) <= width: an equi-join on bins of width + 1."""
    size = width + 1
    left = ref.withColumn("__bin", F.floor(F.col("a") / size))
    right = test.withColumn("__own", F.floor(F.col("b") / size)).withColumn("__bin", F.explode(F.array(*[F.col("__own") + d for d in (-1, 0, 1)]))).drop("__own")
    return left.join(right, [*keys, "__bin"]).where(F.abs(F.col("a") - F.col("b")) <= width).drop("__bin")


#: Units, and firings of theirs, that meet in one task on each side, and lags that are counted together.
UNITS, FIRINGS, LAGS = 512, 1 << 15, 1 << 20
#: Pairs of a recording that are assigned at once. Where it has more, the best go first, about BEST for each unit, judged by the pairs of about SOME units.
WAVE, BEST, SOME = 1 << 20, 128, 64


def _best_of(x: np.ndarray, y: np.ndarray, tol: int) -> tuple[int, int]:
    """(lag, corr): the largest correlation of two trains widened to tol samples at any lag, of equal ones the lowest lag.

    Lags are gone through in blocks of LAGS, in each of which only the pairs of firings that differ by so much are looked at: what is
    held does not grow with the recording.
    """
    x, y = np.sort(x), np.sort(y)
    kernel = tol - np.abs(np.arange(-(tol - 1), tol))
    low, high = int(x[0] - y[-1]) - (tol - 1), int(x[-1] - y[0]) + (tol - 1)
    best = (0, low)
    for begin in range(low, high + 1, LAGS):
        end = min(begin + LAGS, high + 1)
        # differences that reach a lag of the block: begin - (tol - 1) <= x - y < end + tol - 1
        first, width = begin - (tol - 1), end - begin + 2 * (tol - 1)
        to, fro = np.searchsorted(y, x - first, "right"), np.searchsorted(y, x - first - width, "right")
        n = to - fro
        if not n.any():
            continue
        counts = np.zeros(width, dtype=np.int64)
        upto = np.cumsum(n)
        i = 0
        while i < len(x):
            k = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + DENSE, "right")))
            for j in range(0, int(n[i]) if k == i + 1 else 1, DENSE):  # one firing may meet very many by itself
                part = n[i:k] if k > i + 1 else np.array([min(DENSE, int(n[i]) - j)])
                at = np.repeat(fro[i:k] + j - np.concatenate([[0], np.cumsum(part)[:-1]]), part) + np.arange(part.sum())
                counts += np.bincount(np.repeat(x[i:k], part) - y[at] - first, minlength=width)
            i = k
        corr = np.convolve(counts, kernel, "valid") if tol > 1 else counts
        at = int(corr.argmax())
        if corr[at] > best[0]:
            best = (int(corr[at]), begin + at)
    return best[1], best[0]


def _best_of_each(x: np.ndarray, ys: list[np.ndarray], tol: int) -> list[tuple[int, int]]:
    """_best_of(x, y, tol) for each of ys; short trains all at once.

    A pair's differences are sorted as one row. The lowest lag of the largest correlation is one of them: as a sum of triangles the
    correlation can only stop rising where one of these has its top. So each difference adds up those nearer than tol, found a few places to either side.
    """
    few = sorted((k for k, y in enumerate(ys) if len(x) * len(y) <= DENSE), key=lambda k: len(ys[k]))
    out: dict[int, tuple[int, int]] = {}
    while few:
        n = 1
        while n < len(few) and (n + 1) * len(x) * len(ys[few[n]]) <= DENSE:
            n += 1
        now, few = few[:n], few[n:]
        sizes = np.array([len(ys[k]) for k in now])
        there = np.arange(sizes.max()) < sizes[:, None]
        y = np.full(there.shape, ys[now[0]][0], dtype=np.int64)
        y[there] = np.concatenate([ys[k] for k in now])
        d = x[None, :, None] - y[:, None, :]
        low, span = int(d.min()), int(d.max()) - int(d.min())
        d -= low
        # what fills short trains up lies behind all differences, far from each other
        filled = np.broadcast_to(~there[:, None, :], d.shape)
        top = span + tol * (d[0].size + 2)
        if top >= 1 << 62:
            out |= {k: _best_of(x, ys[k], tol) for k in now}
            continue
        if filled.any():
            d = np.where(filled, span + tol * (1 + np.arange(d[0].size).reshape(d[0].shape)), d)
        d = d.reshape(len(now), -1)
        d = np.sort(d.astype(np.int32) if top < 1 << 31 else d, axis=1)
        corr = np.full(d.shape, tol, dtype=np.int64)
        for s in range(1, d.shape[1]):
            near = tol - (d[:, s:] - d[:, :-s])
            if near.max() <= 0:
                break
            np.maximum(near, 0, out=near)
            corr[:, :-s] += near
            corr[:, s:] += near
        at = corr.argmax(1)
        rows = np.arange(len(now))
        out |= {k: (int(v) + low, int(c)) for k, v, c in zip(now, d[rows, at], corr[rows, at], strict=True)}
    return [out[k] if k in out else _best_of(x, y, tol) for k, y in enumerate(ys)]


def _best_corrs(xs: list[np.ndarray], ys: list[np.ndarray], tol: int) -> np.ndarray:
    """corr of _best_of(x, y, tol) for each of xs (rows) and ys, without the lags.

    As _best_of_each, but what does not hang on x is made once for many xs of one length, and a step from one difference to the next
    is a byte where tol allows it.
    """
    out = np.zeros((len(xs), len(ys)), dtype=np.int64)
    by_size = lambda trains: sorted(range(len(trains)), key=lambda k: len(trains[k]))
    small = np.uint8 if tol < 128 else np.int64
    for n_x, group in itertools.groupby(by_size(xs), key=lambda k: len(xs[k])):
        mine, left = list(group), by_size(ys)
        while left and n_x * len(ys[left[0]]) <= DENSE:
            n = 1
            while n < len(left) and (n + 1) * n_x * len(ys[left[n]]) <= ROWS:
                n += 1
            now, left = left[:n], left[n:]
            sizes, top, least = np.array([len(ys[k]) for k in now]), max(int(ys[k].max()) for k in now), min(int(ys[k].min()) for k in now)
            span = top - least + max(int(xs[i].max() - xs[i].min()) for i in mine)
            kind = np.int32 if 2 * span + tol < (1 << 31) - 1 else np.int64
            # rows of differences (less the lowest) are sums; what fills short rows up lies behind all others
            y = np.full((n, int(sizes[-1])), span + 1, dtype=kind)
            y[np.arange(y.shape[1]) < sizes[:, None]] = top - np.concatenate([ys[k] for k in now])
            y = np.repeat(y, n_x, axis=1)
            width, size = y.shape[1], y.size
            last = np.flatnonzero(np.arange(1, width + 1) >= (n_x * sizes)[:, None])  # nothing follows these
            # a minimum with an array is much faster than one with a number
            far, most, step = np.full(size - 1, tol, dtype=kind), np.full(size, tol, dtype=small), np.empty(size, dtype=small)
            for i in mine:
                d = y + np.tile((xs[i] - xs[i].min()).astype(kind), width // n_x)
                d.sort(axis=1)
                d = d.ravel()
                gaps = d[1:] - d[:-1]
                step[:-1] = np.minimum(gaps, far, out=gaps)
                step[last] = tol
                corr, reach, s = most.copy(), step[:-1], 1
                while len(reach):
                    near = most[s:] - reach
                    if not near.any():
                        break
                    if tol * (2 * s + 1) > np.iinfo(corr.dtype).max:
                        corr = corr.astype(np.uint16 if corr.dtype == np.uint8 else np.int64)
                    corr[:-s] += near
                    corr[s:] += near
                    reach, s = np.minimum(reach[:-1] + step[s:-1], most[s + 1 :]), s + 1
                out[i, now] = corr.reshape(n, width).max(1)
        for i in mine:
            for k in left:
                out[i, k] = _best_of(xs[i], ys[k], tol)[1]
    return out


def _trains(df: DataFrame, unit: str, t: str) -> DataFrame:
    """(recording_id, unit, at, train): a row for each unit that fires; ``at`` counts a recording's units in their order."""
    rows = df.groupBy("recording_id", F.col(unit).alias("unit")).agg(F.collect_list(F.col(t).cast("long")).alias("train"))
    order = Window.partitionBy("recording_id").orderBy("unit")
    return materialise(rows.withColumn("at", F.row_number().over(order).cast("long") - 1), "trains")


def _meet(left: DataFrame, right: DataFrame, tol: int, within: bool, make: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """make(recording, floor, left places, right places, their best correlations at any lag, right block) for all blocks of units.

    left (recording_id, at, train, floor), right (recording_id, at, train). A recording's units are cut into blocks of UNITS, of about FIRINGS
    at most; each block of one side meets each of the other in a task: a train is sent once for each block, not for each pair.
    within: both sides are of one set; the correlation is 0 but for pairs with the later unit on the right.
    """

    def blocks(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("recording_id").orderBy("at")
        upto = F.sum(F.size("train").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / UNITS) + F.floor(upto / FIRINGS))

    refs, tests = blocks(left), blocks(right)
    ends = lambda rows, name: rows.groupBy("recording_id").agg(F.max("block").alias(name))
    counts = ends(refs, "n_left").join(ends(tests, "n_right"), "recording_id")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        met = rows.withColumnRenamed("block", own).join(counts, "recording_id")
        return met.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), f"n_{other}"))).drop("n_left", "n_right", "unit")

    def search(refs: pd.DataFrame, tests: pd.DataFrame) -> pd.DataFrame:
        if refs.empty or tests.empty:
            return pd.DataFrame()
        refs, tests = refs.sort_values("at"), tests.sort_values("at")
        i, j = refs["at"].to_numpy(), tests["at"].to_numpy()
        if within and i[0] >= j[-1]:
            return pd.DataFrame()
        best = _best_corrs([np.asarray(v) for v in refs["train"]], [np.asarray(v) for v in tests["train"]], tol)
        if within:
            best[i[:, None] >= j] = 0
        return make(refs["recording_id"].iat[0], int(refs["floor"].iat[0]), i, j, best, int(tests["right"].iat[0]))

    keys = ["recording_id", "left", "right"]
    return dealt(refs, "left", "right").groupBy(*keys).cogroup(dealt(tests, "right", "left").groupBy(*keys)).applyInPandas(search, schema)


def _floors(left: DataFrame, right: DataFrame, sizes: DataFrame, tol: int, within: bool, kind: str) -> DataFrame:
    """(recording_id, floor): the correlation down to which a wave goes, 1 (all) where it can take all pairs.

    What is assigned does not depend on it.
    """
    some = F.pmod(F.xxhash64("at"), F.greatest(F.lit(1), F.floor(F.col("n_left") / SOME)))
    few = left.join(sizes.where(F.col("pairs") > WAVE), "recording_id").where(some == 0).select(*left.columns, F.lit(1).alias("floor"))

    def counted(recording, _floor, _i, _j, best, _place) -> pd.DataFrame:
        n = np.bincount(best[best > 0])
        return pd.DataFrame({"recording_id": recording, "corr": np.flatnonzero(n), "n": n[n > 0]})

    levels = _meet(few, right, tol, within, counted, f"recording_id {kind}, corr long, n long").groupBy("recording_id", "corr").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("recording_id").orderBy(F.desc("corr"))
    levels = levels.withColumn("upto", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("recording_id"))).join(sizes, "recording_id")
    enough = F.col("upto") >= F.col("all") * BEST / F.greatest("n_left", "n_right")
    floors = levels.where(enough).groupBy("recording_id").agg(F.max("corr").alias("floor"))
    return sizes.join(floors, "recording_id", "left").select("recording_id", F.coalesce("floor", F.lit(1).cast("long")).alias("floor"))


def _pairs_at_any_lag(a: DataFrame, b: DataFrame, tol: int, within: bool) -> DataFrame:
    """(recording_id, unit_ref, unit_test, corr, lag) as assign_units gives them of all pairs of units of a recording that both fire, at their best lags.

    The pairs are never a table. Those down to some correlation come first in the order of assignment, so they are assigned
    as a wave; only units that are left then meet again, in the next.
    """
    left = _trains(a, "unit_ref", "a")
    again = lambda rows: rows.select(*[F.col(c).alias(c) for c in rows.columns])
    right = again(left) if within else _trains(b, "unit_test", "b")
    refs, tests, waves, kind = left, right, [], dict(left.dtypes)["recording_id"]

    def ranked(recording, floor, i, j, best, place) -> pd.DataFrame:
        r, c = np.nonzero(best >= floor)
        corr = best[r, c]
        order = np.argsort(-corr, kind="stable")
        r, c, corr = r[order], c[order], corr[order]
        edges = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(corr, prepend=-1) != 0))
        others = np.split(j[c], edges[1:]) if len(edges) else []
        return pd.DataFrame({"recording_id": recording, "corr": corr[edges], "ref": i[r[edges]], "place": place, "tests": others}) if others else pd.DataFrame()

    while True:
        count = lambda rows, name: rows.groupBy("recording_id").agg(F.count("*").alias(name))
        sizes = count(left, "n_left").join(count(right, "n_right"), "recording_id").withColumn("pairs", F.col("n_left") * F.col("n_right"))
        whole = (sizes.agg(F.max("pairs")).first()[0] or 0) <= WAVE
        floors = sizes.select("recording_id", F.lit(1).alias("floor")) if whole else materialise(_floors(left, right, sizes, tol, within, kind), "floors")
        met = _meet(left.join(floors, "recording_id"), right, tol, within, ranked, f"recording_id {kind}, corr long, ref long, place long, tests array<long>")
        waves.append(materialise(_take(met, within), "assigned"))
        if whole:
            break
        gone = [waves[-1].select("recording_id", F.col(c).alias("at")) for c in ("ref", "test")]
        if within:
            left = materialise(left.join(gone[0].union(gone[1]), ["recording_id", "at"], "left_anti"), "trains")
            right = again(left)
        else:
            left, right = (materialise(rows.join(ends, ["recording_id", "at"], "left_anti"), "trains") for rows, ends in ((left, gone[0]), (right, gone[1])))

    def lags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_best_of_each(np.asarray(x), [np.asarray(y)], tol)[0] for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf[list(PAIR)].assign(corr=[float(c) for _, c in found], lag=[lag for lag, _ in found])

    side = lambda rows, at, unit, train: rows.select("recording_id", F.col("at").alias(at), F.col("unit").alias(unit), F.col("train").alias(train))
    taken = functools.reduce(DataFrame.unionByName, waves).select("recording_id", "ref", "test")
    near = taken.join(side(refs, "ref", "unit_ref", "x"), ["recording_id", "ref"]).join(side(tests, "test", "unit_test", "y"), ["recording_id", "test"])
    types = dict(near.dtypes)
    return near.select(*PAIR, "x", "y").mapInPandas(lags, ", ".join(f"{c} {types[c]}" for c in PAIR) + ", corr double, lag long")


def lag_correlogram(ref: DataFrame, test: DataFrame, tol: int, max_lag: int, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """(keys, lag, corr) for abs(lag) <= max_lag where corr > 0: correlation of the trains, each
    spike widened to tol samples. ref (keys, a), test (keys, b): sample indices.

    The correlation of two boxes is a triangle, so each near pair of spikes adds
    max(0, tol - abs(lag - (a - b))) to each lag; differences are counted first.
    """
    diffs = _pairs_within(ref, test, keys, max_lag + tol - 1).groupBy(*keys, (F.col("a") - F.col("b")).alias("d")).agg(F.count("*").alias("n"))
    return _spread(diffs, tol, max_lag, keys)


def best_lag(correlogram: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """(keys, lag, corr): the largest correlation, of equal ones the lowest lag."""
    best = F.min(F.struct((-F.col("corr")).alias("down"), F.col("lag")))
    return correlogram.groupBy(*keys).agg(best.alias("x")).select(*keys, F.col("x.lag").alias("lag"), (-F.col("x.down")).alias("corr"))


def _matched(a: np.ndarray, b: np.ndarray, tol: int) -> tuple[list[int], list[int]]:
    """Places of the firings of a and of b (both sorted) that are matched: each of a in order with the nearest of b left within tol."""
    right = np.searchsorted(b, a, "right").tolist()
    # the nearest place with a firing left, at or after each place and before it; paths are shortened as they are walked
    after, before = list(range(len(b) + 1)), list(range(len(b) + 1))

    def find(links: list[int], i: int) -> int:
        root = i
        while links[root] != root:
            root = links[root]
        while links[i] != root:
            links[i], i = root, links[i]
        return root

    times, taken = b.tolist(), ([], [])
    for i, (t, place) in enumerate(zip(a.tolist(), right, strict=True)):
        up, down = find(after, place), find(before, place) - 1  # before[k] stands for place k - 1
        far = times[up] - t if up < len(times) else tol + 1
        near = t - times[down] if down >= 0 else tol + 1
        if min(far, near) > tol:
            continue
        k = down if near <= far else up
        after[k], before[k + 1] = k + 1, k
        taken[0].append(i)
        taken[1].append(k)
    return taken


def match_firings(ref: DataFrame, test: DataFrame, tol: int, keys: tuple[str, ...] = PAIR, block: int = BLOCK) -> DataFrame:
    """(keys, a, b): each firing of ref in order takes the nearest test firing left within tol.

    ref (keys, a), test (keys, b). Firings more than tol apart never interact, so the merged train falls into islands.
    Time is cut into blocks; a task has the islands that begin in one block, so that no task holds a
    long train (unless it is one island), and goes through them in order. Of two test firings equally near
    the earlier is taken.
    """
    both = ref.select(*keys, F.col("a").cast("long").alias("t"), F.lit(0).alias("kind")).unionByName(test.select(*keys, F.col("b").cast("long").alias("t"), F.lit(1).alias("kind")))
    rows = both.withColumn("block", F.floor(F.col("t") / block).cast("long"))
    # a row for each block that has firings: its last firing, known to the block after it
    by_block = Window.partitionBy(*keys).orderBy("block")
    ends = rows.groupBy(*keys, "block").agg(F.min("t").alias("__from"), F.max("t").alias("__to"))
    ends = ends.withColumn("__prior", F.lag("__to").over(by_block))
    order = Window.partitionBy(*keys, "block").orderBy("t", "kind")
    near = rows.join(ends.select(*keys, "block", "__prior"), [*keys, "block"])
    before = F.coalesce(F.lag("t").over(order), "__prior")
    near = near.withColumn("__new", before.isNull() | (F.col("t") - before > tol))
    cuts = near.where("__new").groupBy(*keys, "block").agg(F.min("t").alias("__cut"))
    # what lies before a block's first new island belongs to the last block before it that has one
    place = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select(*keys, "block").join(cuts, [*keys, "block"], "left")
    known = known.withColumn("__earlier", F.last(F.when(F.col("__cut").isNotNull(), F.col("block")), ignorenulls=True).over(place))
    dealt = rows.join(known, [*keys, "block"])
    dealt = dealt.withColumn("__part", F.when(F.col("t") >= F.col("__cut"), F.col("block")).otherwise(F.col("__earlier"))).select(*keys, "__part", "t", "kind")

    def match(island: dict[str, np.ndarray]) -> Iterator[tuple]:
        t, kind = island["t"], island["kind"]
        a, b = t[kind == 0], t[kind == 1]
        i, k = _matched(a, b, tol)
        if i:
            yield *(island[c][0] for c in keys), a[i], b[k]

    types = dict(ref.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", a array<long>, b array<long>"
    made = in_runs(dealt, (*keys, "__part"), "t", match, schema)
    return made.select(*keys, F.inline(F.arrays_zip("a", "b")))


def rate_of_agreement(ref: DataFrame, test: DataFrame, lags: DataFrame, tol: int, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """(keys, lag, n_common, roa) for the pairs in lags: common / (ref + test - common), NULL if both are silent."""
    moved = test.join(lags.select(*keys, "lag"), list(keys)).select(*keys, (F.col("b") + F.col("lag")).alias("b"))
    used = ref.join(lags.select(*keys), list(keys))
    common = match_firings(used, moved, tol, keys).groupBy(*keys).agg(F.count("*").alias("n_common"))
    n_ref = used.groupBy(*keys).agg(F.count("*").alias("n_ref"))
    n_test = moved.groupBy(*keys).agg(F.count("*").alias("n_test"))
    out = lags.select(*keys, "lag")
    for df in (common, n_ref, n_test):
        out = out.join(df, list(keys), "left")
    n = F.coalesce("n_common", F.lit(0))
    total = F.coalesce("n_ref", F.lit(0)) + F.coalesce("n_test", F.lit(0)) - n
    return out.select(*keys, "lag", n.alias("n_common"), (n / F.nullif(total, F.lit(0))).alias("roa"))


def _check(ref: DataFrame, test: DataFrame) -> None:
    for name, df in (("reference", ref), ("test", test)):
        missing = {"recording_id", "unit", "sample_idx"} - set(df.columns)
        if missing:
            raise ValueError(f"the {name} table lacks {', '.join(sorted(missing))}")


def agreement_paired(ref: DataFrame, test: DataFrame, tol_spike: int, tol_train: int, units: DataFrame | None = None) -> DataFrame:
    """(recording_id, unit, lag, n_common, roa): each unit against the unit of the same name.

    Lags reach tol_train; a unit that is silent on one side has 0. With units given,
    both tables may hold no others (ValueError), and each gets a row.
    """
    _check(ref, test)
    keys = ("recording_id", "unit")
    a, b = ref.select(*keys, F.col("sample_idx").alias("a")), test.select(*keys, F.col("sample_idx").alias("b"))
    have = a.select(*keys).union(b.select(*keys)).distinct()
    if units is not None:
        if not have.join(units, list(keys), "left_anti").isEmpty():
            raise ValueError("spikes of units that are not in the unit table")
        have = units.select(*keys).distinct()
    found = best_lag(lag_correlogram(a, b, tol_spike, tol_train, keys), keys)
    # without any overlap all lags are 0 alike and the first one counts
    lags = have.join(found, list(keys), "left").select(*keys, F.coalesce("lag", F.lit(-tol_train).cast("long")).alias("lag"))
    out = rate_of_agreement(a, b, lags, tol_spike, keys)
    return out.withColumn("roa", F.coalesce("roa", F.lit(0.0))) if units is not None else out


def _take(rows: DataFrame, within: bool) -> DataFrame:
    """(recording_id, corr, ref, test): the pairs that are taken of rows (recording_id, corr, ref, place, tests), tests being an ordered list.

    A recording's rows pass in the order of correlation, reference, place; of them a task holds only the units taken.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, refs, tests = None, set(), set()
        for pdf in batches:
            out = []
            for recording, corr, ref, some in zip(pdf["recording_id"], pdf["corr"], pdf["ref"], pdf["tests"], strict=True):
                if recording != now:
                    now, refs = recording, set()
                    tests = refs if within else set()
                if ref in refs:
                    continue
                for test in some.tolist():
                    if test not in tests:
                        refs.add(ref)
                        tests.add(test)
                        out.append((recording, corr, ref, test))
                        break
            if out:
                yield pd.DataFrame(out, columns=["recording_id", "corr", "ref", "test"])

    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ("recording_id", "corr", "ref")) + f", test {types['tests'][6:-1]}"
    ordered = rows.repartition(F.xxhash64("recording_id")).sortWithinPartitions("recording_id", F.desc("corr"), "ref", "place")
    return ordered.mapInPandas(task, schema)


def assign_units(corr: DataFrame, within: bool = False) -> DataFrame:
    """(recording_id, unit_ref, unit_test, corr, lag): the largest correlation left is taken, and its row and column go.

    Equal ones go by reference, then test unit. within: both sides are one set. A task goes through a recording's pairs in order, and
    holds its units and one unit's pairs of one correlation.
    """
    cols = corr.select("recording_id", "unit_ref", "unit_test", F.col("corr").cast("double").alias("corr"), F.col("lag").cast("long").alias("lag")).where("corr > 0")
    rows = cols.groupBy("recording_id", "corr", F.col("unit_ref").alias("ref")).agg(F.sort_array(F.collect_list("unit_test")).alias("tests"))
    taken = _take(rows.withColumn("place", F.lit(0)), within)
    return taken.select("recording_id", F.col("ref").alias("unit_ref"), F.col("test").alias("unit_test"), "corr").join(cols, [*PAIR, "corr"]).select(*cols.columns).distinct()


def _sides(ref: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recording_id, unit_ref, a) and (recording_id, unit_test, b)."""
    return tuple(df.select("recording_id", F.col("unit").alias(unit), F.col("sample_idx").alias(t)) for df, unit, t in ((ref, "unit_ref", "a"), (test, "unit_test", "b")))


def agreement(ref: DataFrame, test: DataFrame, tol_spike: int, max_lag: int | None = None) -> DataFrame:
    """(recording_id, unit_ref, unit_test, lag, n_common, roa) of units matched between two sets.

    Lags are not limited unless max_lag is given; then pairs of units meet only where
    spikes do, in bins of the lag range.
    """
    _check(ref, test)
    return _agree(*_sides(ref, test), tol_spike, max_lag, False)


def agreement_within(spikes: DataFrame, tol_spike: int, tol_train: int) -> DataFrame:
    """As agreement, for the pairs of different units of one set: finds units that are one.

    Pairs are found at any lag; a best lag beyond tol_train counts as 0.
    """
    _check(spikes, spikes)
    return _agree(*_sides(spikes, spikes), tol_spike, None, True, tol_train)


def unit_pairs(a: DataFrame, b: DataFrame, tol: int, max_lag: int | None = None, within: bool = False) -> DataFrame:
    """(recording_id, unit_ref, unit_test, corr, lag): the units that belong together, by their best correlation at any lag, or up to max_lag."""
    if max_lag is None:
        return _pairs_at_any_lag(a, b, tol, within)
    near = _pairs_within(a, b, ("recording_id",), max_lag + tol - 1)
    diffs = near.groupBy(*PAIR, (F.col("a") - F.col("b")).alias("d")).agg(F.count("*").alias("n"))
    if within:
        diffs = diffs.where(F.col("unit_ref") < F.col("unit_test"))
    return assign_units(best_lag(_spread(diffs, tol, max_lag, PAIR)), within)


def _spread(diffs: DataFrame, tol: int, max_lag: int, keys: tuple[str, ...]) -> DataFrame:
    """Counts of differences (keys, d, n) as triangles over the lags."""
    lags = F.sequence(F.greatest(F.col("d") - (tol - 1), F.lit(-max_lag).cast("long")), F.least(F.col("d") + (tol - 1), F.lit(max_lag).cast("long")))
    spread = diffs.select(*keys, "d", "n", F.explode(lags).alias("lag"))
    return spread.groupBy(*keys, "lag").agg(F.sum(F.col("n") * (tol - F.abs(F.col("lag") - F.col("d")))).alias("corr"))


def _agree(a: DataFrame, b: DataFrame, tol: int, max_lag: int | None, within: bool, tol_train: int | None = None) -> DataFrame:
    # few rows, read three times below; the search for them is the costly part
    pairs = unit_pairs(a, b, tol, max_lag, within)
    if tol_train is not None:
        pairs = pairs.withColumn("lag", F.when(F.abs("lag") > tol_train, F.lit(0).cast("long")).otherwise(F.col("lag")))
    pairs = materialise(pairs, "pairs")
    left = pairs.select(*PAIR).join(a, ["recording_id", "unit_ref"])
    right = pairs.select(*PAIR).join(b, ["recording_id", "unit_test"])
    return rate_of_agreement(left, right, pairs, tol)


def evaluate_run(truth: DataFrame, spikes: DataFrame, calib_samples: int, tol_spike: int, max_lag: int | None, tol_train: int) -> DataFrame:
    """Units matched on the first calib_samples, then scored over the whole recording: (recording_id, unit, ...), unit as in truth.

    The matching looks at every lag where max_lag is None.
    """
    early = F.col("sample_idx") < calib_samples
    _check(truth, spikes)
    pairs = unit_pairs(*_sides(truth.where(early), spikes.where(early)), tol_spike, max_lag).select(*PAIR)
    pairs = materialise(pairs, "pairs")
    ref = truth.join(pairs.select("recording_id", F.col("unit_ref").alias("unit")), ["recording_id", "unit"])
    test = spikes.join(pairs.select("recording_id", F.col("unit_test").alias("unit"), "unit_ref"), ["recording_id", "unit"])
    return agreement_paired(ref, test.select("recording_id", F.col("unit_ref").alias("unit"), "sample_idx"), tol_spike, tol_train)
