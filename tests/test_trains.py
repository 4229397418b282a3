"""Agreement against plain loops, and the edges of the metrics."""

import functools
import time
import tracemalloc

import numpy as np
import pytest

from spikeframe.operators import agreement as ag
from spikeframe.operators import summary as sm
from spikeframe.operators import sweep as sw
from spikeframe.operators import trains as tr


def spikes(spark, units, name="r"):
    rows = [(name, u, int(t)) for u, ts in units.items() for t in ts]
    return spark.createDataFrame(rows, "recording_id string, unit int, sample_idx long")


def greedy(ref, test, tol):
    left, pairs = sorted(test), []
    for a in sorted(ref):
        near = min(left, key=lambda b: (abs(b - a), b), default=None)
        if near is not None and abs(near - a) <= tol:
            pairs.append((a, near))
            left.remove(near)
    return pairs


def test_matching_is_greedy(spark):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        a, b = (np.unique(rng.integers(0, 300, 80)) for _ in range(2))
        ref = spikes(spark, {0: a}).withColumnRenamed("sample_idx", "a")
        test = spikes(spark, {0: b}).withColumnRenamed("sample_idx", "b")
        got = sorted((r.a, r.b) for r in ag.match_firings(ref, test, 3, ("recording_id", "unit")).collect())
        assert got == greedy(a.tolist(), b.tolist(), 3)


def test_equal_trains_agree_and_silent_ones_do_not(spark):
    a = spikes(spark, {0: [5, 40, 80], 1: [7, 30]})
    b = spikes(spark, {0: [5, 40, 80]})
    units = spark.createDataFrame([("r", 0), ("r", 1), ("r", 2)], "recording_id string, unit int")
    got = {r.unit: (r.lag, r.roa) for r in ag.agreement_paired(a, b, 2, 10, units).collect()}
    assert got[0] == (0, 1.0) and got[1][1] == 0.0 and got[2][1] == 0.0
    with pytest.raises(ValueError):
        ag.agreement_paired(a, b, 2, 10, units.where("unit = 0"))
    with pytest.raises(ValueError):
        ag.agreement(a.drop("unit"), b, 2, 10)


def test_lag_and_assignment(spark):
    base = {0: [10, 50, 90, 133], 1: [20, 61, 99, 150]}
    moved = {7: [t - 3 for t in base[1]], 8: [t + 2 for t in base[0]]}
    got = {(r.unit_ref, r.unit_test): (r.lag, r.roa) for r in ag.agreement(spikes(spark, base), spikes(spark, moved), 2, 12).collect()}
    assert got == {(0, 8): (-2, 1.0), (1, 7): (3, 1.0)}
    twice = spikes(spark, {0: base[0], 1: base[0], 2: base[1]})
    within = ag.agreement_within(twice, 1, 2).collect()
    assert [(r.unit_ref, r.unit_test, r.roa) for r in within if r.roa == 1] == [(0, 1, 1.0)]


def within_by_hand(units, tol, tol_train):
    """Pairs of one set by their best correlation at any lag; a lag beyond tol_train counts as 0."""
    table = {}
    names = sorted(units)
    for i, u in enumerate(names):
        for v in names[i + 1 :]:
            corr = {}
            for a in units[u]:
                for b in units[v]:
                    for s in range(-(tol - 1), tol):
                        corr[a - b + s] = corr.get(a - b + s, 0) + tol - abs(s)
            if corr:
                best = max(corr.values())
                lag = min(k for k, n in corr.items() if n == best)
                table[u, v] = (best, 0 if abs(lag) > tol_train else lag)
    out = {}
    while table:
        u, v = min(table, key=lambda k: (-table[k][0], k))
        lag = table[u, v][1]
        moved = [b + lag for b in units[v]]
        n = len(greedy(units[u], moved, tol))
        out[u, v] = (lag, n, n / (len(units[u]) + len(moved) - n))
        table = {k: x for k, x in table.items() if not set(k) & {u, v}}
    return out


def test_agreement_within_a_set_at_any_lag(spark):
    rng = np.random.default_rng(17)
    base = sorted(set(rng.integers(0, 3000, 60).tolist()))
    other = sorted(set(rng.integers(0, 3000, 50).tolist()))
    units = {0: base, 1: [t + 500 for t in base], 2: other, 3: [t - 6 for t in other], 4: sorted(set(rng.integers(0, 3000, 40).tolist()))}
    got = {(r.unit_ref, r.unit_test): (r.lag, r.n_common, r.roa) for r in ag.agreement_within(spikes(spark, units), 2, 12).collect()}
    want = within_by_hand(units, 2, 12)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert got[0, 1][0] == 0 and got[2, 3][0] == 6 and got[2, 3][2] == 1


def test_inst_rate_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    n, fs = 700, 50
    trains = {u: sorted(set(rng.integers(0, n, 40).tolist()) | {0, n - 1}) for u in range(2)}
    df = spikes(spark, trains)
    lengths = spark.createDataFrame([("r", n)], "recording_id string, n_samples long")
    window = np.hanning(fs)
    for block in (64, 1 << 14):
        got = {(r.unit, r.sample_idx): r.rate for r in tr.inst_discharge_rate(df, lengths, fs, ("recording_id", "unit"), block).collect()}
        for u, ts in trains.items():
            train = np.zeros(n)
            train[ts] = 1
            want = 2 * np.convolve(train, window, "full")[(fs - 1) // 2 :][:n]
            assert all(np.isclose(got.get((u, i), 0.0), want[i], atol=1e-12) for i in range(n))


def test_rates(spark):
    rows = [("r", "s", 0, t) for t in (0.0, 0.1, 0.2, 5.0, 5.1)] + [("r", "s", 1, 3.0)] + [("r", "s", 2, t) for t in (0.0, 9.0)]
    df = spark.createDataFrame(rows, "recording_id string, source string, unit int, t double")
    rate = {r.unit: r.discharge_rate for r in tr.discharge_rate(df).collect()}
    assert np.isclose(rate[0], 5 / 0.3) and rate[1] == 0.0 and rate[2] is None
    cov = {r.unit: r.isi_cov for r in tr.isi_cov(df).collect()}
    assert set(cov) == {0} and cov[0] < 1e-6
    units = df.select("recording_id", "source", "unit").distinct().union(spark.createDataFrame([("r", "s", 9)], "a string, b string, c int"))
    assert {r.unit: r.n_spikes for r in tr.spike_count(df, units).collect()}[9] == 0


def test_medians_skip_or_keep_missing(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 4.0), (0, 2.0), (0, 3.0), (1, float("nan")), (1, 5.0)], "g int, v double")
    got = {r.g: (r.m, r.n, r.s) for r in df.groupBy("g").agg(sm.lower_median("v").alias("m"), sm.nan_median("v").alias("n"), sm.nan_sum("v").alias("s")).collect()}
    assert got == {0: (2.0, 2.0, 10.0), 1: (None, 5.0, 5.0)}


def test_trials(spark):
    grid = sw.trial_grid(spark, {"a": [0, 1], "b": [2, 3]})
    assert [(r.a, r.b) for r in grid.orderBy("trial_id").collect()] == [(0, 2), (0, 3), (1, 2), (1, 3)]
    assert sw.trial_random(spark, {"a": (0, 1)}, 5, 3).collect() == sw.trial_random(spark, {"a": (0, 1)}, 5, 3).collect()
    out = sw.successive_halving(grid, lambda t, budget: t.selectExpr("trial_id", "a + b AS loss"), 1, 4).collect()
    assert [(r.trial_id, r.budget) for r in out if r.kept and r.budget == 4] == [(0, 4)]


def test_brackets(spark):
    assert sw.bracket_budgets(27, 3, 3) == [3, 9, 27] and sw.bracket_budgets(2, 3, 3) == [1, 1, 2]
    grid, calls = sw.trial_grid(spark, {"a": range(17)}), []

    def evaluate():
        calls.append([])
        return lambda t, budget: (calls[-1].append(budget), t.selectExpr("trial_id", "a AS loss"))[1]

    out = sw.hyperband(grid, evaluate, 9, 3, 3).collect()
    assert calls == [[1, 3, 9], [3, 9], [9]]
    first = {b: [r.trial_id for r in out if r.bracket == b and r.rung == 0] for b in range(3)}
    assert [len(v) for v in first.values()] == [9, 5, 3] and sorted(sum(first.values(), [])) == list(range(17))
    assert [(r.trial_id, r.budget) for r in out if r.kept and r.budget == 9 and r.bracket == 0] == [(0, 9)]
    assert sw.hyperband(grid.limit(0), evaluate, 9).isEmpty()


@pytest.mark.parametrize("dense", [1 << 18, 200, 1])
def test_units_meet_at_any_lag(spark, monkeypatch, dense):
    monkeypatch.setattr(ag, "DENSE", dense)
    rng, tol = np.random.default_rng(9), 3
    base = {u: np.unique(rng.integers(0, 3000, 60)) for u in range(3)}
    moved = {2 - u: np.concatenate([t + s, rng.integers(3600, 3900, 5)]) for (u, t), s in zip(base.items(), (700, -450, 5), strict=True)}
    best = []
    for u, a in base.items():
        for v, b in moved.items():
            corr = {}
            for d in np.subtract.outer(a, np.unique(b)).ravel().tolist():
                for lag in range(d - tol + 1, d + tol):
                    corr[lag] = corr.get(lag, 0) + tol - abs(lag - d)
            lag = min(corr, key=lambda k: (-corr[k], k))
            best.append((-corr[lag], u, v, lag))
    want, refs, tests = {}, set(), set()
    for _, u, v, lag in sorted(best):
        if u not in refs and v not in tests:
            want[u, v] = lag
            refs.add(u)
            tests.add(v)
    a, b = spikes(spark, base), spikes(spark, {u: np.unique(t) for u, t in moved.items()})
    got = ag.agreement(a, b, tol).collect()
    assert {(r.unit_ref, r.unit_test): r.lag for r in got} == want == {(0, 2): -700, (1, 1): 450, (2, 0): -5}
    assert all(r.n_common >= len(base[r.unit_ref]) for r in got)
    assert {r.unit for r in ag.evaluate_run(a, b, 10**6, tol, None, 12).collect()} == {0, 1, 2}


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_matching_by_blocks(spark, block):
    rng = np.random.default_rng(block)
    a, b = (np.unique(np.concatenate([rng.integers(0, 900, 90), rng.integers(-200, 0, 30)])) for _ in range(2))
    ref = spikes(spark, {0: a, 1: b}).withColumnRenamed("sample_idx", "a")
    test = spikes(spark, {0: b, 1: a, 2: a}).withColumnRenamed("sample_idx", "b")
    got = [(r.unit, r.a, r.b) for r in ag.match_firings(ref, test, 4, ("recording_id", "unit"), block).collect()]
    assert sorted(got) == [(0, *p) for p in greedy(a.tolist(), b.tolist(), 4)] + [(1, *p) for p in greedy(b.tolist(), a.tolist(), 4)]


def test_a_long_island_is_matched_in_time_that_grows_with_it():
    rng = np.random.default_rng(2)
    a, b = np.sort(rng.integers(0, 200_000, 100_000)), np.sort(rng.integers(0, 200_000, 100_000))
    began = time.time()
    i, k = ag._matched(a, b, 50)
    assert time.time() - began < 10 and len(i) > 80_000 and (np.abs(a[i] - b[k]) <= 50).all() and len(set(k)) == len(k)
    few = ag._matched(a[:300], b[:300], 9)
    assert [(int(a[x]), int(b[y])) for x, y in zip(*few, strict=True)] == greedy(a[:300].tolist(), b[:300].tolist(), 9)


@pytest.mark.parametrize("lags", [5, 64, 1 << 20])
@pytest.mark.parametrize("dense", [1, 50, 1 << 18])
@pytest.mark.parametrize("tol", [1, 4])
def test_best_lag_by_blocks(monkeypatch, lags, dense, tol):
    monkeypatch.setattr(ag, "LAGS", lags)
    monkeypatch.setattr(ag, "DENSE", dense)
    rng = np.random.default_rng(7)
    for n in (1, 2, 30):
        x, ys = rng.integers(0, 150, n), [rng.integers(-40, 90, m) for m in (1, 5, 25)]
        want = []
        for y in ys:
            corr = {}
            for d in np.subtract.outer(x, y).ravel().tolist():
                for lag in range(d - tol + 1, d + tol):
                    corr[lag] = corr.get(lag, 0) + tol - abs(lag - d)
            best = min(corr, key=lambda k: (-corr[k], k))
            want.append((best, corr[best]))
        assert [ag._best_of(x, y, tol) for y in ys] == want == ag._best_of_each(x, ys, tol)


def test_best_lag_of_a_day_holds_little():
    rng = np.random.default_rng(8)
    day = 24 * 3600 * 2048
    x = np.sort(rng.integers(0, day, 3000))
    y = np.concatenate([x[::2] - 123_456, rng.integers(0, day, 1000)])
    tracemalloc.start()
    assert ag._best_of(x, y, 2)[0] == 123_456
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


@pytest.mark.parametrize(("firings", "last", "tol"), [(13, 4320, 3), (40, 50, 4), (30, 30, 1), (8, 1 << 40, 3)])
def test_best_lags_of_many_short_trains(firings, last, tol):
    rng = np.random.default_rng(firings)
    x, *ys = [np.unique(rng.integers(0, last, 1 + rng.poisson(firings))) for _ in range(50)]
    got = ag._best_of_each(x, ys, tol)
    for y, (lag, corr) in zip(ys, got, strict=True):
        d = np.subtract.outer(x, y).ravel()
        lags = np.unique(d[:, None] + np.arange(1 - tol, tol))
        all_of = [int(np.maximum(tol - np.abs(v - d), 0).sum()) for v in lags]
        assert (lag, corr) == (lags[int(np.argmax(all_of))], max(all_of))


def test_best_lags_take_little_time():
    rng = np.random.default_rng(0)
    trains = [np.unique(rng.integers(0, 4320, 13)) for _ in range(90)]
    began = time.process_time()
    for x in trains:
        ag._best_of_each(x, trains, 3)
    # 8,100 pairs; about 2 s before a pair's differences were sorted as a row
    assert time.process_time() - began < 0.8


def test_inst_rate_takes_no_task_for_each_unit(spark):
    trains = spikes(spark, {0: [3], 1: []})
    lengths = spark.createDataFrame([("r", 100)], "recording_id string, n_samples long")
    out = tr.inst_discharge_rate(trains, lengths, 10, ("recording_id", "unit"))
    assert "GroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.unit for r in out.collect()} == {0}


def assigned_by_hand(refs, tests, tol, within):
    """(unit_ref, unit_test, corr, lag) of the pairs taken, largest correlation first, then by units."""
    table = {}
    for u, x in refs.items():
        for v, y in tests.items():
            if not within or u < v:
                lag, corr = ag._best_of(np.array(x), np.array(y), tol)
                table[-corr, u, v] = lag
    out, used = set(), (set(), set())
    for (down, u, v), lag in sorted(table.items()):
        if u in used[0] or v in used[1] or (within and (u in used[1] or v in used[0])):
            continue
        used[0].add(u)
        used[1].add(v)
        out.add((u, v, float(-down), lag))
    return out


@pytest.mark.parametrize("within", [False, True])
def test_pairs_are_assigned_in_waves_and_never_written(spark, monkeypatch, within):
    for name, value in {"WAVE": 100, "BEST": 2, "SOME": 8, "UNITS": 12}.items():
        monkeypatch.setattr(ag, name, value, raising=False)
    written, write = [], ag.materialise
    monkeypatch.setattr(ag, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    rng = np.random.default_rng(8)
    some = lambda n: {u: sorted(set(rng.integers(0, 400, rng.integers(1, 9)).tolist())) for u in rng.permutation(1000)[:n].tolist()}
    sets = {name: (refs := some(n), refs if within else some(m)) for name, n, m in (("r", 40, 33), ("s", 21, 30), ("t", 3, 2))}
    table = lambda side: functools.reduce(lambda x, y: x.union(y), [spikes(spark, s[side], name) for name, s in sets.items()])
    pairs = ag.unit_pairs(*ag._sides(table(0), table(1)), 3, within=within).collect()
    for name, (refs, tests) in sets.items():
        got = [(r.unit_ref, r.unit_test, r.corr, r.lag) for r in pairs if r.recording_id == name]
        assert len(got) == len(set(got)) and set(got) == assigned_by_hand(refs, tests, 3, within)
    assert max(df.count() for df in written) <= sum(len(s[0]) + len(s[1]) for s in sets.values())


def test_equal_pairs_take_no_rounds(spark, monkeypatch):
    written, write = [], ag.materialise
    monkeypatch.setattr(ag, "materialise", lambda df, name: written.append(name) or write(df, name))
    corr = spark.range(12).selectExpr("'r' AS recording_id", "id AS unit_ref").crossJoin(spark.range(12).selectExpr("id AS unit_test")).selectExpr("*", "3.0D AS corr", "unit_ref - unit_test AS lag")
    got = sorted((r.unit_ref, r.unit_test, r.lag) for r in ag.assign_units(corr).collect())
    assert got == [(u, u, 0) for u in range(12)]
    got = sorted((r.unit_ref, r.unit_test) for r in ag.assign_units(corr.where("unit_ref < unit_test"), within=True).collect())
    assert got == [(u, u + 1) for u in range(0, 12, 2)]
    assert len(written) < 3


def test_largest_correlations_of_blocks():
    rng = np.random.default_rng(4)
    for span, n, tol in ((4000, 13, 3), (40, 30, 2), (30, 60, 20), (1 << 40, 5, 200), (600, 700, 3), (900, 4, 1)):
        xs, ys = ([rng.integers(0, span, rng.integers(1, n + 1)) for _ in range(7)] for _ in range(2))
        want = [[c for _, c in ag._best_of_each(x, ys, tol)] for x in xs]
        assert ag._best_corrs(xs, ys, tol).tolist() == want
