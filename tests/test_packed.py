"""Packed signals and sources against the operators on rows."""

import numpy as np
from pyspark.sql import functions as F

from spikeframe.operators import adapt as ad
from spikeframe.operators import decompose as dc
from spikeframe.operators import model as md
from spikeframe.operators import packed as pa
from spikeframe.operators import peaks as pk
from spikeframe.operators import trains as tr
from spikeframe.sources import recordings as rec
from spikeframe.sources.storage import materialise

EXT, BATCH = 3, 20


def tables(spark):
    """A recording of several blocks with plateaus, a constant one, one with a gap, one of two samples; and a model of each."""
    rng = np.random.default_rng(11)
    rows = [("long", i, rng.integers(-2, 3, 2).astype(float).tolist()) for i in range(130)]
    rows += [("still", i, [0.1, 0.1]) for i in range(50)]
    rows += [("gap", i, rng.normal(size=2).tolist()) for i in range(90) if not 47 <= i < 71]
    rows += [("short", i, rng.normal(size=2).tolist()) for i in range(2)]
    sig = materialise(spark.createDataFrame(rows, "recording_id string, sample_idx long, channels array<double>"), "signal")
    units = [(r, u, rng.normal(size=2 * EXT).tolist()) for r in ("long", "still", "gap", "short") for u in range(2)]
    return sig, spark.createDataFrame(units, "recording_id string, unit int, w array<double>")


def same(a, b, keys):
    # NULLs apart, equal to 12 digits
    rows = lambda df: {tuple(r[k] for k in keys): [r[c] for c in sorted(df.columns) if c not in keys] for r in df.collect()}
    x, y = rows(a), rows(b)
    assert x.keys() == y.keys() and x
    for k in x:
        for u, v in zip(x[k], y[k], strict=True):
            assert (u is None) == (v is None) and (u is None or np.allclose(u, v, rtol=1e-12, atol=1e-12)), (k, u, v)


def test_packed_sources_and_spikes_are_those_of_rows(spark):
    sig, rows = tables(spark)
    packs = materialise(pa.pack(sig, EXT - 1, 2 * BATCH), "packs")
    same(pa.unpack(packs), sig, ["recording_id", "sample_idx"])
    assert packs.where("recording_id = 'long'").count() == 4
    same(pa.scales(packs), md.scales(sig, size=2), ["recording_id"])
    sources = materialise(pa.frozen_batches(packs, rows, EXT, BATCH), "sources")
    ipts = materialise(dc.frozen_ipts(sig, rows, 2, EXT, BATCH), "ipts")
    same(pa.explode_sources(sources), ipts, ["recording_id", "unit", "sample_idx"])
    same(pa.centroids(sources), md.centroids(ipts), ["recording_id", "unit"])
    units = materialise(md.init_heights(pa.centroids(sources)), "units")
    spikes = materialise(pa.detect_spikes(sources, units, 5, 3), "spikes")
    same(spikes.drop("ipt"), pk.detect_spikes(ipts, units, 5, 3), ["recording_id", "unit", "batch_idx", "sample_idx"])
    whole = spikes.where("ipt is not null")
    same(pa.values_at_spikes(sources, whole, BATCH).select(*whole.columns), whole, ["recording_id", "unit", "sample_idx"])
    for measure in (tr.pulse_to_noise, tr.silhouette):
        same(measure(whole, sources, 4), measure(whole, ipts, 4), ["recording_id", "unit"])
    # no sample is a row of a shuffle once it is packed
    plan = spikes._jdf.queryExecution().executedPlan().toString() + sources._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_packed_divergences_and_calibration_are_those_of_rows(spark):
    sig, _ = tables(spark)
    sig = sig.where("recording_id in ('long', 'gap')")
    packs = materialise(pa.pack(sig, EXT - 1, 2 * BATCH), "packs")
    scales = md.scales(sig, size=2)
    same(md.packed_divergences(packs, scales, BATCH, 0.1), md.divergences(md.whiten(sig, scales), BATCH, 0.1, 2), ["recording_id", "batch_idx"])
    w = np.random.default_rng(2).normal(size=(2 * EXT, 2 * EXT)).tolist()
    matrices = sig.select("recording_id").distinct().select("recording_id", F.posexplode(F.array(*[F.array(*map(F.lit, r)) for r in w])).alias("row_idx", "w"))
    calibrated = [md.calibrate_full(sig.where("recording_id = 'long'"), matrices, EXT, BATCH, 0.1, 2 * EXT, p) for p in (None, packs.where("recording_id = 'long'"))]
    same(*calibrated, ["recording_id"])


def test_near_peaks_in_any_number_of_rounds(monkeypatch):
    rng = np.random.default_rng(4)
    for rounds in (0, 1, 50):
        monkeypatch.setattr(pa, "ROUNDS", rounds)
        key = np.sort(rng.integers(0, 4, 200))
        at = np.concatenate([np.sort(rng.choice(300, n, replace=False)) for n in np.bincount(key, minlength=4)])
        value = rng.integers(0, 6, 200).astype(float)
        want = np.zeros(200, dtype=bool)
        for i in np.lexsort((-at, -value)):
            want[i] = not (want & (key == key[i]) & (np.abs(at - at[i]) < 5)).any()
        assert (pa._thinned(key, at, value, 5) == want).all()


def test_short_recordings_share_files(spark, tmp_path):
    rows = spark.range(3000).selectExpr("CAST(id % 500 AS STRING) AS recording_id", "0 AS unit", "id AS sample_idx")
    rec.write_outputs({"spikes": rows}, str(tmp_path / "out"), folders=False)
    assert len(list((tmp_path / "out/spikes").rglob("*.parquet"))) <= 8
    back = rec.read_outputs(spark, str(tmp_path / "out"), ["spikes"])["spikes"]
    assert back.exceptAll(rows).isEmpty() and back.count() == 3000


def test_runs_together_are_the_runs_one_by_one():
    rng = np.random.default_rng(6)
    vector = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(size=6))
    start = [(u, vector(), 0.5, 4.0, 2.0, 0.3, 0.2) for u in range(2)]
    settings = [ad.Params(batch_size=40, wh_learning_rate=0.004 * i, cov_alpha=0.1 + 0.1 * i, sv_epochs=1 + 2 * epochs) for epochs in (0, 1) for i in range(3)]
    make = lambda ps: [ad.Run(p, np.eye(6), np.eye(6), [ad.Unit(*u) for u in start], 1.0, 0.5) for p in ps]
    assert isinstance(ad.together(make(settings)), ad.OneByOne)
    batches = [rng.normal(size=(40, 6)) for _ in range(6)] + [rng.integers(-1, 2, (40, 6)).astype(float), np.zeros((40, 6)), rng.normal(size=(1, 6)), rng.normal(size=(2, 6))]
    for ps in (settings[:3], settings[3:], settings[:1]):
        alone, all_of_them = make(ps), ad.together(make(ps))
        assert isinstance(all_of_them, ad.Runs)
        for x in batches:
            for r, got in zip(alone, all_of_them.batch(x), strict=True):
                want = r.batch(x)
                assert all(np.allclose(want[k], got[k], equal_nan=True) for k in ("w", "c", "wh_loss", "total_loss"))
                for u, v in zip(want["units"], got["units"], strict=True):
                    assert u[0] == v[0] and u[2].tolist() == v[2].tolist() and all(np.allclose(a, b, equal_nan=True) for a, b in zip(u[3:], v[3:], strict=True))
        for r, got in zip(alone, all_of_them.single(), strict=True):
            assert r.p == got.p and np.allclose(r.c, got.c) and all(np.allclose(u.w, v.w) and np.isclose(u.height, v.height) for u, v in zip(r.units, got.units, strict=True))


def test_adaptive_steps_and_stretches_take_packs(spark):
    sig, rows = tables(spark)
    p = ad.Params(batch_size=BATCH, ext_fact=EXT)
    packs = materialise(pa.pack(sig, EXT - 1, 2 * BATCH), "packs")
    units = rows.select("*", F.lit(0.2).alias("base_centr"), F.lit(3.0).alias("spikes_centr"), F.lit(1.5).alias("height"))
    eye = F.flatten(F.array(*[F.array(*[F.lit(float(i == k)) for i in range(2 * EXT)]) for k in range(2 * EXT)]))
    start = sig.select("recording_id").distinct().select("recording_id", eye.alias("w"), eye.alias("c"), F.lit(1.0).alias("kl_mean"), F.lit(0.5).alias("kl_std"))
    trials = [(0, p), (1, ad.with_params(p, wh_learning_rate=0.0))]
    losses = lambda df: df.where("unit is not null").select("recording_id", "trial_id", "batch_idx", "unit", "sv_loss").fillna(-1.0)
    for last in (None, 3):
        same(*[losses(ad.adaptive_steps(s, start, units, trials, whole=False, last_batch=last)) for s in (sig, packs)], ["recording_id", "trial_id", "batch_idx", "unit"])
    same(*[ad.recording_bounds(s, BATCH) for s in (sig, packs)], ["recording_id"])
    begun = ad.start_rows(start, units)
    whole = ad.adaptive_steps(sig, start, units, trials, whole=False)
    made = None
    parts = []
    for first, last in ((0, 2), (2, 7)):
        made = materialise(ad.adaptive_stretch(packs, begun, ad.recording_bounds(packs, BATCH), made.where("kind is not null").select("recording_id", "trial_id", "kind", "at", "payload") if made else None, trials, first, last), "rung")
        parts.append(losses(made.where("kind is null")))
    same(losses(whole), parts[0].unionByName(parts[1]), ["recording_id", "trial_id", "batch_idx", "unit"])
