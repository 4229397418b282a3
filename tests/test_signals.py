"""Filters, adaptation and peaks against plain loops."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_loops as loops
from spikeframe.operators import adapt as ad
from spikeframe.operators import decompose as dc
from spikeframe.operators import filters as fl
from spikeframe.operators import frames as fr
from spikeframe.operators import model as md
from spikeframe.operators import peaks as pk
from spikeframe.operators import sweep as sw
from spikeframe.sources import recordings as rec
from spikeframe.sources.storage import materialise

RNG = np.random.default_rng(3)


def signal(spark, x, name="r"):
    rows = [(name, i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id string, sample_idx long, channels array<double>")


def array(df):
    return np.array([r.channels for r in df.orderBy("sample_idx").collect()])


def loop(system, x):
    s, out = np.zeros((len(system.b), x.shape[1])), []
    for row in x:
        out.append(system.c @ s + system.d * row)
        s = system.a @ s + np.outer(system.b, row)
    return np.array(out)


@pytest.mark.parametrize("chunk", [7, 64, 1000])
def test_filter_in_chunks_is_the_sequential_filter(spark, chunk):
    x = RNG.normal(size=(150, 2))
    system = fl.butterworth("band", 4, (2.0, 20.0), 100.0)
    got = array(fl.apply(signal(spark, x), system, chunk))
    assert np.allclose(got, loop(system, x), atol=1e-9)


def test_zero_phase_keeps_a_slow_wave_in_place(spark):
    t = np.arange(400) / 100
    x = np.sin(2 * np.pi * 1.0 * t)[:, None]
    got = array(fl.lowpass(signal(spark, x), 100.0, 20.0))
    assert np.abs(got - x).max() < 0.02


def test_filter_design():
    with pytest.raises(ValueError):
        fl.butterworth("band", 2, 5.0, 100.0)
    with pytest.raises(ValueError):
        fl.butterworth("low", 2, 60.0, 100.0)


@pytest.mark.parametrize("kind,order,cut", [("low", 2, 10.0), ("high", 3, 10.0), ("band", 4, (2.0, 20.0)), ("stop", 2, (24.5, 25.5))])
def test_filters_have_butterworth_responses(kind, order, cut):
    system, fs = fl.butterworth(kind, order, cut, 100.0), 100.0
    n = len(system.b)

    def gain(f):
        z = np.exp(2j * np.pi * f / fs)
        return abs(system.c @ np.linalg.solve(z * np.eye(n) - system.a, system.b) + system.d)

    edges = np.atleast_1d(cut)
    assert np.allclose([gain(f) for f in edges], np.sqrt(0.5), atol=1e-6)
    w = np.tan(np.pi * np.array([0.5, 5.0, 15.0, 30.0, 45.0]) / fs)
    e = np.tan(np.pi * edges / fs)
    ratio = {"low": lambda: w / e[0], "high": lambda: e[0] / w, "band": lambda: (w**2 - e[0] * e[1]) / (w * (e[1] - e[0])), "stop": lambda: w * (e[1] - e[0]) / (e[0] * e[1] - w**2)}[kind]()
    assert np.allclose([gain(f) for f in (0.5, 5.0, 15.0, 30.0, 45.0)], 1 / np.sqrt(1 + ratio ** (2 * order)), atol=1e-6)


@pytest.mark.parametrize("block", [5, 64])
def test_delays_do_not_depend_on_blocks(spark, block):
    x = RNG.normal(size=(40, 2))
    got = np.array([r.x for r in fr.extend_delays(signal(spark, x), 3, block=block).orderBy("sample_idx").collect()])
    want = np.hstack([np.vstack([np.zeros((i, 2)), x[: len(x) - i]]) for i in range(3)])
    assert np.allclose(got, want)


def test_peaks_of_plateaus_ends_and_ties(spark):
    v = [5, 1, 2, 2, 2, 1, 3, 1, 3, 0, 9]
    df = spark.createDataFrame([("r", 0, 0, i, float(x)) for i, x in enumerate(v)], "recording_id string, unit int, batch_idx long, sample_idx long, value double")
    top = pk.local_maxima(df)
    assert sorted(r.sample_idx for r in top.collect()) == [3, 6, 8]
    assert sorted(r.sample_idx for r in pk.refractory(top, 3).collect()) == [3, 8]  # of equal ones the later
    assert ad.find_peaks(np.array(v, float), 0, 10, 3).tolist() == loops.peaks(v, 0, 10, 3) == [3, 8]


@pytest.mark.parametrize("block", [4, 7, 1 << 16])
def test_peaks_of_long_series_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(block)
    series = {0: rng.integers(0, 3, 120), 1: np.repeat(rng.integers(0, 4, 12), 10), 2: np.zeros(50), 3: np.array([1, 2, *[5] * 40, 1])}
    df = spark.createDataFrame([("r", u, i, float(x)) for u, v in series.items() for i, x in enumerate(v)], "recording_id string, unit int, sample_idx long, value double")
    got = {}
    for r in pk.local_maxima_long(df, block=block).collect():
        got.setdefault(r.unit, []).append(r.sample_idx)
        assert r.value == series[r.unit][r.sample_idx]
    assert {u: sorted(t) for u, t in got.items()} == {u: loops.peaks(v.tolist(), -1, 99, 1) for u, v in series.items() if loops.peaks(v.tolist(), -1, 99, 1)}


def test_refractory_is_greedy(spark):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        v = rng.integers(0, 6, 200).astype(float)
        df = spark.createDataFrame([("r", 0, 0, i, float(x)) for i, x in enumerate(v)], "recording_id string, unit int, batch_idx long, sample_idx long, value double")
        got = sorted(r.sample_idx for r in pk.refractory(pk.local_maxima(df), 6).collect())
        assert got == ad.find_peaks(v, -1, 99, 6).tolist() == loops.peaks(v.tolist(), -1, 99, 6)


def model_tables(spark, w, c, units, kl=(None, None), names=("r",)):
    start = spark.createDataFrame([(r, np.ravel(w).tolist(), np.ravel(c).tolist(), *kl) for r in names], "recording_id string, w array<double>, c array<double>, kl_mean double, kl_std double")
    rows = [(r, u["unit"], list(map(float, u["w"])), u["base"], u["spikes"], u["height"], u["mean"], u["std"]) for r in names for u in units]
    return start, spark.createDataFrame(rows, "recording_id string, unit int, w array<double>, base_centr double, spikes_centr double, height double, contrast_mean double, contrast_std double")


def a_model(k, size, rng):
    """A whitening of k rows over size entries, its covariance, and three units."""
    w = np.eye(k, size) + rng.normal(size=(k, size)) / 10
    units = []
    for u in range(3):
        v = rng.normal(size=k)
        units.append({"unit": u, "w": v / np.linalg.norm(v), "base": 0.5, "spikes": 4.0 + u, "height": 2.25 + u / 2, "mean": 0.9, "std": 0.4 + u})
    return w, np.eye(k) * 1.1, units


def close(a, b):
    return a is None and b is None or a is not None and b is not None and np.isclose(a, b, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("how", [{}, {"kind": "cube"}, {"adapt_wh": False, "epochs": 3, "sv": 0.2}, {"adapt_sv": False, "adapt_sd": False}])
@pytest.mark.parametrize("n", [230, 151, 100])
def test_adaptation_is_the_sequential_loop(spark, monkeypatch, n, how):
    rng = np.random.default_rng(n)
    ch, ext, batch = 2, 3, 50
    x = {r: rng.normal(size=(n, ch)) ** 3 for r in "ab"}
    w, c, units = a_model(5, ch * ext, rng)
    names = {"kind": "contrast", "sv": "sv_learning_rate", "wh": "wh_learning_rate", "epochs": "sv_epochs"}
    p = ad.Params(batch_size=batch, ext_fact=ext, spike_dist=4, **{names.get(k, k): v for k, v in how.items()})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # rows come in pieces that no batch agrees with
    both = signal(spark, x["a"], "a").unionByName(signal(spark, x["b"], "b")).orderBy(F.rand(2))
    out = ad.decompose_adaptive(both, *model_tables(spark, w, c, units, (2.0, 0.7), "ab"), p, with_w=True)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    steps = {(r.recording_id, r.batch_idx, r.unit): r for r in out["steps"].collect()}
    metrics = {(r.recording_id, r.batch_idx): r for r in out["batch_metrics"].collect()}
    course = {(r.recording_id, r.version): r.w for r in out["model_whitening"].collect()}
    seen = 0
    for r in "ab":
        for want in loops.adapt(x[r], w, c, units, batch=batch, ext=ext, distance=4, kl_calib=(2.0, 0.7), **how):
            b = want["batch"]
            assert np.allclose(course[r, b], want["w"].ravel(), atol=1e-9)
            assert close(metrics[r, b].wh_loss, want["wh_loss"]) and close(metrics[r, b].total_loss, want["total"])
            for u, unit in want["units"].items():
                got = steps[r, b, u]
                assert list(got.samples) == want["rows"] and np.allclose(got.ipts, unit["ipt"], atol=1e-9)
                assert list(got.spikes) == unit["spikes"] and np.allclose(got.w, unit["w"], atol=1e-9)
                assert np.isclose(got.height, unit["height"]) and np.isclose(got.base_centr, unit["base"]) and close(got.sv_loss, unit["sv_loss"])
                seen += len(got.spikes)
    assert seen > 20 and len(steps) == 3 * len(metrics) == 3 * 2 * -(-n // batch)


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_filter_states_are_put_together_by_spans(spark, span):
    x = np.random.default_rng(3).normal(size=(200, 2)) + 1
    s = fl.butterworth("band", 2, (2.0, 20.0), 100.0)
    for settled in (False, True):
        state = np.outer(s.rest, x[0]) if settled else np.zeros((len(s.b), 2))
        want = []
        for v in x:
            want.append(s.c @ state + s.d * v)
            state = s.a @ state + np.outer(s.b, v)
        got = fl.apply(signal(spark, x), s, 7, settled, span)
        assert np.allclose(array(got), want)


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_units_in_tasks_of_their_own(spark):
    rng = np.random.default_rng(31)
    x = {r: rng.normal(size=(230, 2)) ** 3 for r in "ab"}
    w, c, units = a_model(5, 6, rng)
    p = ad.Params(batch_size=50, ext_fact=3, spike_dist=4)
    both = signal(spark, x["a"], "a").unionByName(signal(spark, x["b"], "b"))
    tables = model_tables(spark, w, c, units, (2.0, 0.7), "ab")
    whole = ad.decompose_adaptive(both, *tables, p, snapshots=2)
    for n in (1, 2, 5):
        apart = ad.decompose_adaptive(both, *tables, p, snapshots=2, units_per_task=n)
        for name, keys in (("steps", ("recording_id", "batch_idx", "unit")), ("batch_metrics", ("recording_id", "batch_idx")), ("model_whitening", ("recording_id", "version"))):
            got, want = rows_of(apart[name], *keys), rows_of(whole[name], *keys)
            assert got.keys() == want.keys()
            for key, r in want.items():
                for col, v in r.asDict().items():
                    assert np.allclose(got[key][col], v) if isinstance(v, (list, float)) else got[key][col] == v
    whitened = ad.whitened_batches(both, tables[0], p)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    groups = ad.separated_batches(whitened, tables[1], p, 1).select(F.spark_partition_id().alias("task")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert groups > 1


@pytest.mark.parametrize("every", [1, 2, 3, 50])
def test_replay_from_snapshots_is_the_run(spark, every):
    rng = np.random.default_rng(32)
    x = {r: rng.normal(size=(n, 2)) ** 3 for r, n in (("a", 430), ("b", 51), ("c", 205))}
    w, c, units = a_model(5, 8, rng)
    p = ad.Params(batch_size=50, ext_fact=4, spike_dist=4)
    sig = signal(spark, x["a"], "a").unionByName(signal(spark, x["b"], "b")).unionByName(signal(spark, x["c"], "c"))
    sig = sig.where("recording_id <> 'a' or not (sample_idx between 97 and 103 or sample_idx between 210 and 330)").where("recording_id <> 'c' or sample_idx >= 60")
    tables = model_tables(spark, w, c, units, (2.0, 0.7), "abc")
    ran = ad.decompose_adaptive(sig, *tables, p, snapshots=every)
    again = ad.replay(sig, *tables, ran["model_whitening"], ran["model_units"], p)
    for name, keys in (("steps", ("recording_id", "batch_idx", "unit")), ("batch_metrics", ("recording_id", "batch_idx"))):
        got = rows_of(again[name], *keys)
        # recordings that begin after a batch with a snapshot are there from the first snapshot on
        first = {r.recording_id: r.version for r in ran["model_whitening"].groupBy("recording_id").agg(F.min("version").alias("version")).collect()}
        want = {k: r for k, r in rows_of(ran[name], *keys).items() if k[0] in first and k[1] >= first[k[0]]}
        assert got.keys() == want.keys() and len(want) > 0
        for key, r in want.items():
            for col, v in r.asDict().items():
                if col != "c":
                    assert np.allclose(got[key][col], v) if isinstance(v, (list, float)) else got[key][col] == v


def test_trials_of_a_sweep_are_runs_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(ad, "TRIALS_PER_GROUP", 2)
    rng = np.random.default_rng(9)
    x = {r: rng.normal(size=(205, 2)) ** 3 for r in "ab"}
    w, c, units = a_model(4, 4, rng)
    p = ad.Params(batch_size=50, ext_fact=2, spike_dist=4)
    tables = model_tables(spark, w, c, units, (2.0, 0.7), "ab")
    trials = sw.trial_grid(spark, {"wh_learning_rate": [0.0, 0.05], "sv_learning_rate": [0.003, 0.3], "cov_alpha": [0.1, 0.6]})
    both = signal(spark, x["a"], "a").unionByName(signal(spark, x["b"], "b"))
    for batches in (None, 2):
        got = {(r.trial_id, r.recording_id): r.loss for r in sw.run_sweep(both, *tables, trials, p, batches).collect()}
        assert len(got) == 16 and len(set(got.values())) > 8
        for t in trials.collect():
            for r in "ab":
                steps = loops.adapt(x[r][: 50 * batches if batches else None], w, c, units, batch=50, ext=2, distance=4, kl_calib=(2.0, 0.7), wh=t.wh_learning_rate, sv=t.sv_learning_rate, alpha=t.cov_alpha)
                assert np.isclose(got[t.trial_id, r], loops.loss_of(steps))
    with pytest.raises(ValueError):
        ad.adaptive_steps(both, *tables, [(0, p), (1, ad.with_params(p, batch_size=60))])


@pytest.mark.parametrize("stops", [(1, 2, 9), (3, 4), (9,)])
def test_rungs_go_on_where_they_stopped(spark, monkeypatch, stops):
    monkeypatch.setattr(ad, "TRIALS_PER_GROUP", 2)
    rng = np.random.default_rng(17)
    w, c, units = a_model(6, 6, rng)
    p = ad.Params(batch_size=50, ext_fact=3, spike_dist=4)
    tables = model_tables(spark, w, c, units, (2.0, 0.7), "abc")
    x = {r: rng.normal(size=(n, 2)) ** 3 for r, n in zip("abcd", (205, 430, 60, 90), strict=True)}
    both = signal(spark, x["a"], "a").unionByName(signal(spark, x["c"], "c")).unionByName(signal(spark, x["d"], "d"))
    # a gap over whole batches and over a border, a late beginning, a repeated sample
    both = both.unionByName(signal(spark, x["b"], "b").where("sample_idx >= 70 and (sample_idx < 98 or sample_idx > 101) and (sample_idx < 190 or sample_idx >= 320)"))
    both = both.unionByName(both.where("recording_id = 'a' and sample_idx = 99"))
    trials = sw.trial_grid(spark, {"wh_learning_rate": [0.0, 0.05], "sv_learning_rate": [0.003, 0.3]})
    whole = ad.adaptive_steps(both, *tables, sw._settings(trials, p), whole=False)
    key = lambda r: (r.recording_id, r.trial_id, r.batch_idx, r.unit)
    rungs = sw.Rungs(both, *tables, p)
    live = trials
    for k, stop in enumerate(stops):
        live = live.where(F.col("trial_id") != k) if k else live
        losses = {r.trial_id: r.loss for r in rungs.evaluate(live, stop).collect()}
        ids = {r.trial_id for r in live.collect()}
        want = whole.where(F.col("batch_idx") < stop).where(F.col("trial_id").isin(list(ids)))
        got = rungs.steps.where(F.col("trial_id").isin(list(ids)))
        assert got.count() == want.count()  # each batch once
        got, want = {key(r): r for r in got.collect()}, {key(r): r for r in want.collect()}
        assert got.keys() == want.keys() and {k[0] for k in got} <= set("abc") and losses.keys() == ids
        for at, r in want.items():
            for col in ("wh_loss", "sv_loss"):
                assert got[at][col] == r[col] or np.isclose(got[at][col], r[col])
    with pytest.raises(ValueError):
        rungs.evaluate(live, stops[-1])


def test_gaps_repeats_and_recordings_without_a_model(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2)) ** 3
    w, c, units = a_model(4, 4, rng)
    p = ad.Params(batch_size=30, ext_fact=2, spike_dist=4)
    rows = signal(spark, x, "r").where("sample_idx not in (40, 41) and (sample_idx < 60 or sample_idx >= 90)")
    rows = rows.unionByName(signal(spark, x, "r").where("sample_idx = 7")).unionByName(signal(spark, x, "other"))
    out = ad.decompose_adaptive(rows, *model_tables(spark, w, c, units, (2.0, 0.7)), p)
    y = x.copy()
    y[40:42], y[60:90] = 0, 0
    want = loops.adapt(y, w, c, units, batch=30, ext=2, distance=4, kl_calib=(2.0, 0.7))
    got = {(r.batch_idx, r.unit): r.spikes for r in out["steps"].collect()}
    assert got == {(s["batch"], u): v["spikes"] for s in want for u, v in s["units"].items()}
    assert ad.decompose_adaptive(rows.limit(0), *model_tables(spark, w, c, units), p)["spikes"].isEmpty()


def test_full_whitening_and_fused_models(spark):
    rng = np.random.default_rng(12)
    ch, ext, n = 3, 4, 300
    x = {r: rng.normal(size=(n, ch)) for r in "ab"}
    w = {r: rng.normal(size=(7, ch * ext)) for r in "ab"}
    b = {r: rng.normal(size=(2, 7)) for r in "ab"}
    sig = signal(spark, x["a"], "a").unionByName(signal(spark, x["b"], "b"))
    matrices = spark.createDataFrame([(r, i, row.tolist()) for r in "ab" for i, row in enumerate(w[r])], "recording_id string, row_idx int, w array<double>")
    units = spark.createDataFrame([(r, i, row.tolist()) for r in "ab" for i, row in enumerate(b[r])], "recording_id string, unit int, w array<double>")
    full = {r: loops.extend(x[r], ext) for r in "ab"}
    z = md.whiten_by(fr.extend_delays(sig, ext), matrices, block=64)
    for r in z.collect():
        assert np.allclose(r.z, w[r.recording_id] @ full[r.recording_id][r.sample_idx])
    by_batch = fr.assign_batches(fr.extend_delays(sig, ext), 100)
    changing = matrices.withColumn("version", F.explode(F.array(*[F.lit(v) for v in range(3)]))).withColumn("w", F.transform("w", lambda v: v * (F.col("version") + 1)))
    for r in md.whiten_by(by_batch, changing).collect():
        assert np.allclose(r.z, (r.sample_idx // 100 + 1) * (w[r.recording_id] @ full[r.recording_id][r.sample_idx]))
    rows = dc.fuse(units, matrices)
    for ipts in (dc.frozen_ipts(sig, rows, ch, ext, 100), dc.frozen_ipts_wide(sig, rows, ch, ext, 100, block=64)):
        got = ipts.collect()
        assert len(got) == 2 * 2 * (n - ext)
        for r in got:
            assert np.isclose(r.ipt, b[r.recording_id][r.unit] @ w[r.recording_id] @ full[r.recording_id][r.sample_idx]) and r.batch_idx == r.sample_idx // 100


@pytest.mark.parametrize("size", [3, 9])
def test_covariances_and_their_course(spark, size):
    x = RNG.normal(size=(250, size)) @ RNG.normal(size=(size, size))
    df = fr.assign_batches(signal(spark, x), 50)
    cov = md.batch_covariance(df, "channels", size)
    start = md.batch_covariance(df, "channels", size, ("recording_id",))
    course = md.ewma_covariance(cov, start, 0.2)
    got = {(r.batch_idx, r.i, r.j): r.cov for r in course.collect()}
    kl = {r.batch_idx: r.kl for r in md.kl_to_identity(course, size).collect()}
    c = np.cov(x.T)
    for b in range(5):
        c = 0.8 * c + 0.2 * np.cov(x[50 * b : 50 * (b + 1)].T)
        assert all(np.isclose(got[b, i, j], c[i, j]) for i in range(size) for j in range(i, size))
        assert np.isclose(kl[b], 0.5 * (np.trace(c) - size - np.linalg.slogdet(c)[1]))


def test_params_and_layouts(spark):
    with pytest.raises(ValueError):
        ad.Params(batch_size=4, ext_fact=5)
    with pytest.raises(ValueError):
        ad.Params(contrast="other")
    with pytest.raises(ValueError):
        rec.read_recordings(spark, "nowhere", layout="other")
    with pytest.raises(ValueError):
        md.contrast_of(F.lit(1.0), "other")
    params = {r.preset: r for r in rec.load_params(spark, {"fs": 1000, "other": 1}).collect()}
    assert params["wrist"].batch_size == 100 and params["wrist"].spike_dist == 10
    wide = spark.createDataFrame([("r", 0, 1.0, 2.0)], "recording_id string, sample_idx long, ch0 double, ch1 double")
    assert rec.from_wide(wide).first().channels == [1.0, 2.0]


def test_params_of_a_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "mine.yml").write_text("fs: 1000\ncontrast_fun: cube\nwh_learning_rate: 1.0e-3\nspike_height_mult: 4.0\ndevice: null\nother: 3\n")
    row = rec.load_params(spark, {"cov_alpha": 0.5}, str(tmp_path / "mine.yml")).first()
    assert (row.preset, row.fs, row.contrast, row.wh_learning_rate, row.spike_height_mult, row.cov_alpha, row.batch_size) == ("mine", 1000, "cube", 1e-3, 4, 0.5, 100)


def test_datasets(spark, tmp_path):
    sig = spark.createDataFrame([("r", 0, 1.0, 2.0)], "recording_id string, sample_idx long, ch0 double, ch1 double")
    about = spark.createDataFrame([("r", 2048)], "recording_id string, fs int")
    rec.write_dataset({"signal": sig, "recordings": about}, str(tmp_path / "d"))
    back = rec.read_dataset(spark, str(tmp_path / "d"), "wide")
    assert set(back) == {"signal", "recordings"} and back["signal"].first().channels == [1.0, 2.0]
    with pytest.raises(ValueError):
        rec.write_dataset({"other": sig}, str(tmp_path / "e"))
    about.drop("fs").write.parquet(str(tmp_path / "d/profile"))
    with pytest.raises(ValueError, match="lacks sample_idx"):
        rec.read_dataset(spark, str(tmp_path / "d"), "wide")


def test_one_row_batch_and_flat_channel(spark):
    df = fr.assign_batches(signal(spark, np.ones((3, 2))), 2)
    cov = md.batch_covariance(df, "channels", 2)
    assert {(r.batch_idx, r.cov) for r in cov.collect()} == {(0, 0.0), (1, None)}
    kl = md.kl_to_identity(cov.where("batch_idx = 0"), 2)
    assert kl.first().kl is None
    assert md.scales(df).first().scale == [0.0, 0.0]


def test_model_source_and_start(spark, tmp_path):
    emg = RNG.normal(size=(2, 40))
    ipts = RNG.normal(size=(2, 40)) + 2
    row = ("r", np.eye(2).tolist(), [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], [0.5, 0.6, 0.7], [4.5, 4.6, 4.7], 1, emg.tolist(), ipts.tolist(), [[1, 11, 30], [5]])
    schema = "recording_id string, WH array<array<double>>, BRT array<array<double>>, N_CENT array<double>, SIG_CENT array<double>, EXT_FACT int, EMG array<array<double>>, IPTs array<array<double>>, firings array<array<long>>"
    spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "model"))
    tables = rec.read_model(spark, str(tmp_path / "model"))
    units = {r.unit: r for r in tables["model_units"].collect()}
    assert units[1].w == [2.0, 5.0] and units[2].base_centr == 0.7 and units[0].height == 2.5
    assert np.allclose(array(tables["signal"]), emg.T)
    assert sorted((r.unit, r.sample_idx) for r in tables["spikes"].collect()) == [(0, 0), (0, 10), (0, 29), (1, 4)]
    model, whole = md.build_model(tables, 1, 8, 0.1, 2)
    got = {r.unit: r for r in model.collect()}
    want = np.log(np.cosh(ipts[0][[0, 10, 29]]))
    assert np.isclose(got[0].contrast_mean, want.mean()) and np.isclose(got[0].contrast_std, want.std(ddof=1))
    assert got[1].contrast_std is None
    # five batches of eight without the first and the last, from the covariance of the whole
    whole, c, kl = whole.first(), np.cov(emg), []
    for b in range(5):
        c = 0.9 * c + 0.1 * np.cov(emg[:, 8 * b : 8 * b + 8])
        kl.append(0.5 * (np.trace(c) - 2 - np.linalg.slogdet(c)[1]))
    assert np.allclose(whole.w, np.eye(2).ravel()) and np.allclose(whole.c, np.cov(emg).ravel())
    assert np.isclose(whole.kl_mean, np.mean(kl[1:-1])) and np.isclose(whole.kl_std, np.std(kl[1:-1], ddof=1))
    steps = ad.decompose_adaptive(tables["signal"], spark.createDataFrame([whole]), model.fillna(1.0), ad.Params(batch_size=8, ext_fact=1))
    assert steps["steps"].count() == 15 and steps["batch_metrics"].where("wh_loss is null").isEmpty()


def test_outputs_and_metrics(spark, tmp_path):
    spikes = spark.createDataFrame([("1", 0, 5), ("2", 1, 7)], "recording_id string, unit int, sample_idx long")
    rec.write_outputs({"spikes": spikes}, str(tmp_path / "out"))
    back = rec.read_outputs(spark, str(tmp_path / "out"), ["spikes"])["spikes"]
    assert {(r.recording_id, r.unit, r.sample_idx) for r in back.collect()} == {("1", 0, 5), ("2", 1, 7)}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        rec.write_outputs({"spikes": spikes}, str(tmp_path / "out"))
    long = spark.range(1000).selectExpr("'r' AS recording_id", "0 AS unit", "id AS sample_idx")
    rec.write_outputs({"spikes": long}, str(tmp_path / "long"), rows_per_file=100)
    assert len(list((tmp_path / "long/spikes/recording_id=r").glob("*.parquet"))) >= 10
    assert rec.read_outputs(spark, str(tmp_path / "long"), ["spikes"])["spikes"].count() == 1000
    for run in ("a", "b", "b"):
        rec.log_metrics({"run_summary": spikes}, str(tmp_path / "metrics"), run)
    assert spark.read.parquet(str(tmp_path / "metrics/run_summary")).count() == 4
    snapshots = spikes.select("recording_id", F.col("unit").alias("version"))
    for _ in range(2):
        rec.append_params(snapshots, str(tmp_path / "params"))
    assert spark.read.parquet(str(tmp_path / "params")).count() == 2


def test_folds_of_tables_that_lie_by_recording(spark):
    """Both parts of the fold's union come out of a join by recording that is planned as a sort-merge join and runs as a broadcast one."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        rng = np.random.default_rng(5)
        rows = [(f"r{r}", i, rng.normal(size=4).tolist()) for r in range(12) for i in range(60)]
        sig = materialise(spark.createDataFrame(rows, "recording_id string, sample_idx long, channels array<double>"), "signal")
        z = md.whiten(sig, md.scales(sig))
        kl = md.divergences(z, 10, 0.1, 4)
        got = {(r.recording_id, r.batch_idx): r.kl for r in kl.collect()}
        # rows were lost on large tables alone; what is tested here is that a fold's rows are dealt by their own key
        assert "hashpartitioning(xxhash64(recording_id" in kl._jdf.queryExecution().executedPlan().toString()
        cells = md.ewma_covariance(md.batch_covariance(fr.assign_batches(z, 10), "z", 4), md.batch_covariance(z, "z", 4, ("recording_id",)), 0.1)
        assert len(cells.collect()) == 12 * 6 * 10 and len(md.calibrate_whitening(z, 10, 0.1, 4).collect()) == 12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert len(got) == 12 * 6
    for r in range(12):
        x = np.array([v for name, _, v in rows if name == f"r{r}"])
        x = x / x.std(0)
        c = np.cov(x.T)
        for b in range(6):
            c = 0.9 * c + 0.1 * np.cov(x[10 * b : 10 * b + 10].T)
            assert got[f"r{r}", b] == pytest.approx((np.trace(c) - np.linalg.slogdet(c)[1] - 4) / 2)


def test_calibration_and_fused_models_take_no_task_for_each_group(spark):
    """Moments of batches that blocks cut, put together, and no Python call of Spark's for each recording or batch."""
    rng = np.random.default_rng(8)
    ch, ext, size, n, alpha = 2, 3, 4, 250, 0.2
    x = {r: rng.normal(size=(n, ch)) for r in "ab"}
    w = {r: rng.normal(size=(size, ch * ext)) for r in "ab"}
    sig = signal(spark, x["a"], "a").unionByName(signal(spark, x["b"], "b"))
    matrices = spark.createDataFrame([(r, i, row.tolist()) for r in "ab" for i, row in enumerate(w[r])], "recording_id string, row_idx int, w array<double>")
    units = matrices.where("row_idx < 2").select("recording_id", F.col("row_idx").alias("unit"), F.slice("w", 1, size).alias("w"))
    start, rows = md.calibrate_full(sig, matrices, ext, 40, alpha, size), dc.fuse(units, matrices)
    for df in (start, rows, ad.batch_covariances(fr.assign_batches(sig, 40).withColumn("x", F.col("channels")), ch)):
        assert "GroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    for r in start.collect():
        z = loops.extend(x[r.recording_id], ext) @ w[r.recording_id].T
        c, kl = np.cov(z.T), []
        assert np.allclose(r.c, c.ravel()) and np.allclose(r.w, w[r.recording_id].ravel())
        for b in range(6):
            c = (1 - alpha) * c + alpha * np.cov(z[40 * b : 40 * b + 40].T)
            kl.append(0.5 * (np.trace(c) - size - np.linalg.slogdet(c)[1]))
        assert np.isclose(r.kl_mean, np.mean(kl[1:-1])) and np.isclose(r.kl_std, np.std(kl[1:-1], ddof=1))
    total = {}
    for r in ad.delayed_moments(sig, ext, 40, block=64).collect():
        key = r.recording_id, r.kind, r["at"]
        total[key] = total.get(key, 0) + np.array(r.payload)
    for r in "ab":
        full, upper = loops.extend(x[r], ext), np.triu_indices(ch * ext)
        for key, part in {(r, ad.OF_WHOLE, 0): full, **{(r, ad.OF_BATCH, b): full[40 * b : 40 * b + 40] for b in range(7)}}.items():
            assert np.allclose(total.pop(key), np.concatenate([[len(part)], part.sum(0), (part.T @ part)[upper]]))
    assert not total


def test_filters_take_no_task_for_each_chunk(spark):
    x = RNG.normal(size=(300, 2))
    out = fl.apply(signal(spark, x), fl.butterworth("band", 2, (2.0, 20.0), 100.0), 64)
    assert "GroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(array(out), loop(fl.butterworth("band", 2, (2.0, 20.0), 100.0), x))


def test_vectors_of_one_recording_take_no_time_with_their_square(spark):
    rng = np.random.default_rng(6)
    few = rng.normal(size=(5, 4))
    rows = {"r": np.vstack([few[:2], few[0] + few[1], np.zeros(4), few[2:], rng.normal(size=(20_000, 4))]), "s": np.array([[3.0, 4.0], [6.0, 8.0], [0.0, 1.0]])}
    df = spark.createDataFrame([(name, u, w.tolist()) for name, ws in rows.items() for u, w in enumerate(ws)], "recording_id string, unit int, w array<double>").cache()
    df.count()
    began = time.time()
    got = {(r.recording_id, r.unit): r.w for r in md.orthonormalise(df).collect()}
    assert time.time() - began < 30
    for name, ws in rows.items():
        done = []
        for u, w in enumerate(ws[:60]):
            v = w - sum(((w @ b) * b for b in done), np.zeros_like(w))
            size = np.linalg.norm(v)
            done += [v / size] if size > 1e-10 * np.linalg.norm(w) else []
            assert np.allclose(got[name, u], v / size if size > 1e-10 * np.linalg.norm(w) else 0)
        assert len(done) == len(w) and sum(any(got[name, u]) for u in range(len(ws))) == len(w)


def test_whitened_batches_are_as_short_as_they_can_be(spark):
    """A batch goes to each unit's task: as raw samples with their whitening, or whitened where that is shorter."""
    rng = np.random.default_rng(33)
    x, p = rng.normal(size=(230, 2)), ad.Params(batch_size=50, ext_fact=3, spike_dist=4)
    w, c, units = a_model(6, 6, rng)
    start = model_tables(spark, w, c, units, (2.0, 0.7), "r")[0]
    rows = ad.whitened_batches(signal(spark, x), start, p).orderBy("batch_idx").collect()
    assert len(rows) == 5
    of_row = lambda r: sum(len(v) for k, v in r.asDict().items() if isinstance(v, list) and k in ("z", "raw", "by"))
    assert all(of_row(r) <= 52 * 2 + 36 < 300 for r in rows)
    z = rows[0]
    made = ad.whitened_of(z.n, z.width, 3, np.array(z.by), np.array(z.raw))
    wide = np.hstack([np.vstack([np.zeros((i, 2)), x])[: len(x)] for i in range(3)])
    assert np.allclose(made, wide[3:50] @ np.array(z.by).reshape(6, 6).T) and len(made) == 47
    assert np.array_equal(ad.whitened_of(47, 2, 3, np.empty(0), made.ravel()), made)
    few = ad.with_params(p, batch_size=6)
    assert all(r.z is not None and r.by is None for r in ad.whitened_batches(signal(spark, x), start, few).collect())


def test_the_run_that_is_replayed_reads_packs(spark, monkeypatch):
    from spikeframe.plans import streams

    class Seen(Exception):
        pass

    def run(signal, *_args, **_more):
        raise Seen(signal.columns)

    monkeypatch.setattr(streams.ad, "decompose_adaptive", run)
    with pytest.raises(Seen, match="values"):
        streams.QUERIES["replay_snapshots"](spark, "/root/testdata/sf0.001")
