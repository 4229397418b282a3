"""A stream's results are those of the batch, however its rows arrive."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_loops as loops
from spikeframe.operators import adapt as ad
from spikeframe.operators import filters as fl
from spikeframe.plans import streams
from spikeframe.sources import recordings as rec
from spikeframe.streaming import online

SCHEMA = "recording_id string, sample_idx long, channels array<double>, ts timestamp"
RATE = 100.0


@pytest.fixture(autouse=True)
def store(spark):
    online.state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Feed:
    """A folder of files, one for each trigger, and a query that is started anew for each run."""

    def __init__(self, spark, path, make, partition_by=()):
        self.spark, self.path, self.make, self.by = spark, str(path), make, partition_by
        self.files = 0

    def put(self, rows, name="r"):
        """rows: (sample_idx, channels); None: the clock goes on by years."""
        made = [("clock", 0, [0.0], 9e7)] if rows is None else [(name, int(i), [float(v) for v in x], float(i / RATE)) for i, x in rows]
        df = self.spark.createDataFrame(made, "recording_id string, sample_idx long, channels array<double>, s double")
        df = df.select("recording_id", "sample_idx", "channels", F.timestamp_micros((F.col("s") * 1_000_000 + 1_000_000_000_000).cast("long")).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        rows = self.make(stream)
        rec.write_stream(rows, f"{self.path}/out", f"{self.path}/ck", self.by).awaitTermination()
        return rec.read_stream(self.spark, f"{self.path}/out", rows.schema)


@pytest.mark.parametrize("cuts", [1, 4])
def test_filter_stream_out_of_order_with_a_restart(spark, tmp_path, cuts):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 2))
    system = fl.butterworth("high", 2, 5.0, RATE)
    feed = Feed(spark, tmp_path, lambda s: online.filter_stream(s, system, RATE, size=32))
    order = np.array_split(rng.permutation(150), cuts)
    for k, part in enumerate(order):
        feed.put([(i, x[i]) for i in part])
        if k == len(order) // 2:
            feed.run()
    feed.put([(3, x[3] + 1)])  # late, or once more
    feed.put(None)
    got = feed.run().orderBy("sample_idx").collect()
    assert [r.sample_idx for r in got] == list(range(150))
    assert np.allclose([r.channels for r in got], fl.run(system, x, np.zeros((2, 2)))[0])


def test_filter_stream_waits_no_longer_than_the_watermark(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(3000, 1))
    there = [i for i in range(3000) if i not in range(70, 75)]
    system = fl.butterworth("low", 1, 5.0, RATE)
    feed = Feed(spark, tmp_path, lambda s: online.filter_stream(s, system, RATE, size=50))
    feed.put([(i, x[i]) for i in there])
    first = feed.run()
    assert first.where("sample_idx >= 50").count() > 1000  # 30 s of samples, the watermark is 10 behind
    feed.put([(72, x[72])])
    feed.put(None)
    got = {r.sample_idx: r.channels for r in feed.run().collect()}
    y = x.copy()
    y[70:75] = 0
    want = fl.run(system, y, np.zeros((len(system.b), 1)))[0]
    assert sorted(got) == there and all(np.allclose(got[i], want[i]) for i in there)


P = ad.Params(batch_size=30, ext_fact=2, spike_dist=3)
UNITS = [{"unit": u, "w": np.roll([0.7, 0.5, 0.4, 0.3], u), "base": 0.5, "spikes": 4.0, "height": 2.25, "mean": 1.0, "std": 0.5 + u} for u in range(2)]


def model(spark, names=("r",)):
    eye = np.eye(4).ravel().tolist()
    start = spark.createDataFrame([(n, eye, eye, 2.0, 0.7) for n in names], "recording_id string, w array<double>, c array<double>, kl_mean double, kl_std double")
    rows = [(n, u["unit"], list(map(float, u["w"])), u["base"], u["spikes"], u["height"], u["mean"], u["std"]) for n in names for u in UNITS]
    return start, spark.createDataFrame(rows, "recording_id string, unit int, w array<double>, base_centr double, spikes_centr double, height double, contrast_mean double, contrast_std double")


def wanted(x):
    return loops.adapt(x, np.eye(4), np.eye(4), UNITS, batch=30, ext=2, distance=3, kl_calib=(2.0, 0.7))


def same(rows, want):
    units = {(r.batch_idx, r.unit): r for r in rows if r.kind == "unit"}
    batches = {r.batch_idx: r for r in rows if r.kind == "batch"}
    assert len(units) == sum(r.kind == "unit" for r in rows) and sorted(batches) == [s["batch"] for s in want]
    for s in want:
        assert np.isclose(batches[s["batch"]].wh_loss, s["wh_loss"]) and np.isclose(batches[s["batch"]].total_loss, s["total"])
        for u, v in s["units"].items():
            r = units[s["batch"], u]
            assert list(r.spikes) == v["spikes"] and np.allclose(r.ipts, v["ipt"]) and list(r.samples) == s["rows"] and np.allclose(r.w, v["w"]) and np.isclose(r.height, v["height"])
    return batches


@pytest.mark.parametrize("n", [150, 155])
def test_decompose_stream(spark, tmp_path, n):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 2)) ** 3
    feed = Feed(spark, tmp_path, lambda s: online.decompose_stream(s, *model(spark), P, RATE, snapshots=2), ("kind",))
    for k, part in enumerate(np.array_split(rng.permutation(n), 4)):
        feed.put([(i, x[i]) for i in part])
        if k == 1:
            feed.run()
    feed.put([(i, x[i]) for i in range(40)], "no model")
    before = feed.run()
    assert before.where("kind = 'batch'").count() == n // 30  # all full ones; the rest waits for the clock
    feed.put(None)
    rows = feed.run()
    same(rows.collect(), wanted(x))
    assert rows.where("recording_id <> 'r'").isEmpty()
    _, whitening = online.trajectory(rows)
    assert sorted(r.version for r in whitening.collect()) == list(range(0, -(-n // 30), 2))


def test_decompose_stream_gaps_late_rows_and_no_first_sample(spark, tmp_path):
    x = np.random.default_rng(9).normal(size=(4000, 2)) ** 3
    gone = {0, 1, 40, 41, *range(100, 170)}
    feed = Feed(spark, tmp_path, lambda s: online.decompose_stream(s, *model(spark), P, RATE), ("kind",))
    feed.put([(i, x[i]) for i in range(2000) if i not in gone])
    feed.run()
    feed.put([(40, x[40]), (41, x[41]), (120, x[120])] + [(i, x[i]) for i in range(2000, 3995)])
    feed.run()
    feed.put(None)
    rows = feed.run().collect()
    y = x[:3995].copy()
    y[sorted(gone)] = 0
    batches = same(rows, wanted(y))
    assert (batches[0].n_missing, batches[1].n_missing, batches[4].n_samples, batches[7].n_missing) == (2, 2, 0, 0)
    late = {}
    for r in rows:
        if r.kind == "late":
            late[r.batch_idx] = late.get(r.batch_idx, 0) + r.n_late
    assert late == {1: 2, 4: 1}


def test_a_recording_begins_with_its_first_batch(spark, tmp_path):
    x = np.random.default_rng(10).normal(size=(100, 2)) ** 3
    first = 30 * 10**7
    sig = spark.createDataFrame([("r", first + i, v.tolist()) for i, v in enumerate(x)], "recording_id string, sample_idx long, channels array<double>")
    out = ad.decompose_adaptive(sig, *model(spark), P)
    got = {(r.batch_idx, r.unit): r for r in out["steps"].collect()}
    assert sorted({b for b, _ in got}) == [10**7 + i for i in range(4)]
    feed = Feed(spark, tmp_path, lambda s: online.decompose_stream(s, *model(spark), P, RATE), ("kind",))
    feed.put([(first + i, v) for i, v in enumerate(x)])
    feed.put(None)
    rows = [r for r in feed.run().collect() if r.kind == "unit"]
    assert {(r.batch_idx, r.unit): (r.ipts, r.spikes) for r in rows} == {k: (r.ipts, r.spikes) for k, r in got.items()}


def test_a_trigger_written_twice_leaves_one_copy(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: s.select("recording_id", "sample_idx"))
    feed.put([(i, [0.0]) for i in range(5)])
    feed.run()
    feed.put([(i, [0.0]) for i in range(5, 8)])
    feed.run()
    # the second trigger was written but its end not noted: it runs again
    (tmp_path / "ck/commits/1").unlink()
    for crc in (tmp_path / "ck/commits").glob(".1*"):
        crc.unlink()
    assert sorted(r.sample_idx for r in feed.run().collect()) == list(range(8))


def put_many(spark, path, rows):
    """rows: (recording, sample_idx, channels), one file."""
    df = spark.createDataFrame([(n, int(i), [float(v) for v in x], float(i / RATE)) for n, i, x in rows], "recording_id string, sample_idx long, channels array<double>, s double")
    df = df.select("recording_id", "sample_idx", "channels", F.timestamp_micros((F.col("s") * 1_000_000 + 1_000_000_000_000).cast("long")).alias("ts"))
    df.coalesce(1).write.mode("append").parquet(f"{path}/in")


def run_many(spark, path, make):
    """The rows so far, and the most state rows that the run had at once."""
    rows = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    query = rec.write_stream(rows, f"{path}/out", f"{path}/ck")
    query.awaitTermination()
    held = max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators)
    return rec.read_stream(spark, f"{path}/out", rows.schema).collect(), held


def test_recordings_share_the_state_of_their_group(spark, tmp_path):
    rng = np.random.default_rng(11)
    system = fl.butterworth("band", 2, (2.0, 20.0), RATE)
    make = lambda s: online.filter_stream(s, system, RATE, size=20, groups=2)
    # other lengths, widths, first samples and gaps
    signals, there = {}, {}
    for k in range(40):
        signals[f"r{k}"] = rng.normal(size=(50 + 3 * k, 1 + k % 3))
        gone = set(range(k % 5)) | ({30, 31, 45} if k % 4 == 0 else set())
        there[f"r{k}"] = [i for i in range(len(signals[f"r{k}"])) if i not in gone]
    came = [(n, i, signals[n][i]) for n, all_i in there.items() for i in all_i]
    came = [came[i] for i in rng.permutation(len(came))]
    for part in (came[: len(came) // 2], came[len(came) // 2 :]):
        put_many(spark, tmp_path, part)
        _, held = run_many(spark, tmp_path, make)
        # places, batches of samples and timers of two groups, not of each recording
        assert held <= 2 * (1 + 3 * 9)
    put_many(spark, tmp_path, [("r39", 7, signals["r39"][7] + 1)])  # once more
    put_many(spark, tmp_path, [("clock", int(9e9), [0.0])])
    got, _ = run_many(spark, tmp_path, make)
    assert len(got) == len(came)
    got = {(r.recording_id, r.sample_idx): r.channels for r in got}
    for n, x in signals.items():
        y = np.zeros_like(x)
        y[there[n]] = x[there[n]]
        want = fl.run(system, y, np.zeros((len(system.b), x.shape[1])))[0]
        assert all(np.allclose(got[n, i], want[i]) for i in there[n])


def test_decompose_stream_of_many_recordings_in_a_group(spark, tmp_path):
    rng = np.random.default_rng(12)
    signals = {f"r{k}": rng.normal(size=(95 + 7 * k, 2)) ** 3 for k in range(6)}
    make = lambda s: online.decompose_stream(s, *model(spark, list(signals)), P, RATE, snapshots=2, groups=1)
    came = [(n, i, x[i]) for n, x in signals.items() for i in range(len(x))]
    came = [came[i] for i in rng.permutation(len(came))]
    for part in np.array_split(np.arange(len(came)), 2):
        put_many(spark, tmp_path, [came[i] for i in part])
        run_many(spark, tmp_path, make)
    put_many(spark, tmp_path, [("clock", int(9e9), [0.0])])
    got, held = run_many(spark, tmp_path, make)
    for n, x in signals.items():
        same([r for r in got if r.recording_id == n], wanted(x))
    # a model for each recording; places, batches and timers are the group's
    assert held <= len(signals) + 1 + 3 * 5


def test_parts_of_an_arriving_signal_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "shared_folder", lambda _: str(tmp_path))
    rows = [(f"r{r}", i, [float(i)]) for r in range(24) for i in range(37 * 8)]
    signal = spark.createDataFrame(rows, "recording_id string, sample_idx long, channels array<double>").repartition(4, "recording_id")
    out = streams._streamed(spark, signal, lambda s: s.select("recording_id", "sample_idx"))
    assert sorted((r.recording_id, r.sample_idx) for r in out.where("recording_id <> 'clock'").collect()) == sorted((r, i) for r, i, _ in rows)
    (folder,) = tmp_path.glob("stream-*")
    files = list(folder.glob("in/*.parquet"))
    assert len(files) > 2 * streams.ARRIVALS
    # each run goes by two parts a trigger
    assert len(list(folder.glob("out/trigger=*"))) == streams.ARRIVALS // streams.PER_TRIGGER + 1
