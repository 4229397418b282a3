"""Queries of filters, adaptation and sweeps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import adapt as ad
from ..operators import decompose as dc
from ..operators import filters as fl
from ..operators import frames as fr
from ..operators import model as md
from ..operators import packed
from ..operators import sweep as sw
from ..sources import fixtures as fx
from ..sources import recordings as rec
from ..sources.storage import materialise, shared_folder
from .common import BATCH, CH, DIST, EXT, IPTS, MIX, MODEL, MULT, SCALES, SIG, SIZE, VECTORS, calibrated, r6, unit_rows, whitening

QUERIES, ORACLES = {}, {}
FS = 100.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _out(df):
    return df.select("recording_id", "sample_idx", *[r6(F.get(F.col("channels"), F.lit(i))).alias(f"c{i}") for i in range(CH)])


def _filtered(system: fl.System, source: str, name: str, settled: bool = False) -> str:
    """SQL: table ``name`` of ``source`` (recording_id, sample_idx from 0, c0...) filtered sample by sample, states as columns."""
    n = len(system.b)
    num = lambda v: f"({float(v)!r}::DOUBLE)"

    def line(row, gain, x: str, state) -> str:
        terms = [f"{num(k)} * {state(j)}" for j, k in enumerate(row) if k] + [f"{num(gain)} * {x}"] * bool(gain)
        return " + ".join(terms) or "0.0::DOUBLE"

    def columns(x, state) -> str:
        ys = [f"{line(system.c, system.d, x(c), lambda j, c=c: state(c, j))} AS y{c}" for c in range(CH)]
        return ", ".join(ys + [f"{line(system.a[i], system.b[i], x(c), lambda j, c=c: state(c, j))} AS s{c}_{i}" for c in range(CH) for i in range(n)])

    first = columns(lambda c: f"c{c}", lambda c, j: f"({num(system.rest[j] if settled else 0.0)} * c{c})")
    then = columns(lambda c: f"x.c{c}", lambda c, j: f"f.s{c}_{j}")
    return f"""{name}_run AS (
  SELECT recording_id, sample_idx, {first} FROM {source} WHERE sample_idx = 0
  UNION ALL
  SELECT x.recording_id, x.sample_idx, {then} FROM {name}_run f JOIN {source} x ON x.recording_id = f.recording_id AND x.sample_idx = f.sample_idx + 1),
{name} AS (SELECT recording_id, sample_idx, {", ".join(f"y{c} AS c{c}" for c in range(CH))} FROM {name}_run)"""


_C = ", ".join(f"c{c}" for c in range(CH))
_BAND = fl.butterworth("band", 4, (2.0, 20.0), FS)
_NOTCH = fl.butterworth("stop", 2, (24.5, 25.5), FS)
_NARROW = fl.butterworth("band", 2, (2.0, 20.0), FS)


def _rounded(source: str) -> str:
    return f"SELECT recording_id, sample_idx, {', '.join(f'round(c{c}, 6) AS c{c}' for c in range(CH))} FROM {source}"


@query(f"WITH RECURSIVE {SIG}, {_filtered(_BAND, 'sig', 'band')} {_rounded('band')}")
def filter_bandpass(spark, d):
    return _out(fl.bandpass(fx.signal(spark, d), FS, 2.0, 20.0, zero=False))


@query(f"WITH RECURSIVE {SIG}, {_filtered(_NOTCH, 'sig', 'notched')} {_rounded('notched')}")
def filter_notch(spark, d):
    return _out(fl.notch(fx.signal(spark, d), FS, 25.0, zero=False))


_PAD = 3 * (len(_NARROW.b) + 1)
_ODD = lambda end: ", ".join(f"2 * {end}.c{c} - sig.c{c} AS c{c}" for c in range(CH))


@query(f"""WITH RECURSIVE {SIG}, ends AS (SELECT recording_id, max(sample_idx) AS last FROM sig GROUP BY 1),
head AS (SELECT * FROM sig WHERE sample_idx = 0), tail AS (SELECT sig.* FROM sig JOIN ends USING (recording_id) WHERE sample_idx = last),
padded AS (
  SELECT recording_id, sample_idx + {_PAD} AS sample_idx, {_C} FROM sig
  UNION ALL SELECT recording_id, {_PAD} - sig.sample_idx, {_ODD("head")} FROM sig JOIN head USING (recording_id) WHERE sig.sample_idx BETWEEN 1 AND {_PAD}
  UNION ALL SELECT recording_id, 2 * tail.sample_idx - sig.sample_idx + {_PAD}, {_ODD("tail")} FROM sig JOIN tail USING (recording_id) WHERE sig.sample_idx < tail.sample_idx AND sig.sample_idx >= tail.sample_idx - {_PAD}),
{_filtered(_NARROW, 'padded', 'once', True)},
turned AS (SELECT recording_id, last + {2 * _PAD} - sample_idx AS sample_idx, {_C} FROM once JOIN ends USING (recording_id)),
{_filtered(_NARROW, 'turned', 'twice', True)},
back AS (SELECT recording_id, last + {_PAD} - sample_idx AS sample_idx, last, {_C} FROM twice JOIN ends USING (recording_id))
{_rounded('back')} WHERE sample_idx BETWEEN 0 AND last""")
def filter_zero_phase(spark, d):
    return _out(fl.bandpass(fx.signal(spark, d), FS, 2.0, 20.0, order=2))


def _first_order(kind: str, cut: float) -> str:
    s = fl.butterworth(kind, 1, cut, FS)
    a1, b0 = -float(s.a[0, 0]), float(s.d)
    b1 = float(s.b[0]) + a1 * b0  # the section's first state is the output's rest
    steps = ", ".join(f"{b0!r}::DOUBLE * x.c{i} + {b1!r}::DOUBLE * p.c{i} - {a1!r}::DOUBLE * f.y{i} AS y{i}" for i in range(CH))
    return f"""WITH RECURSIVE {SIG}, f AS (
  SELECT recording_id, sample_idx, {", ".join(f"{b0!r}::DOUBLE * c{i} AS y{i}" for i in range(CH))} FROM sig WHERE sample_idx = 0
  UNION ALL
  SELECT x.recording_id, x.sample_idx, {steps}
  FROM f JOIN sig x ON x.recording_id = f.recording_id AND x.sample_idx = f.sample_idx + 1 JOIN sig p ON p.recording_id = f.recording_id AND p.sample_idx = f.sample_idx)
SELECT recording_id, sample_idx, {", ".join(f"round(y{i}, 6) AS c{i}" for i in range(CH))} FROM f"""


@query(_first_order("high", 2.0))
def filter_highpass(spark, d):
    return _out(fl.highpass(fx.signal(spark, d), FS, 2.0, order=1, zero=False))


@query(_first_order("low", 10.0))
def filter_lowpass(spark, d):
    return _out(fl.lowpass(fx.signal(spark, d), FS, 10.0, order=1, zero=False))


_MEANS = ", ".join(f"c{c} - avg(c{c}) OVER (PARTITION BY recording_id) AS c{c}" for c in range(CH))


@query(f"WITH RECURSIVE {SIG}, {_filtered(_BAND, 'sig', 'band')}, {_filtered(_NOTCH, 'band', 'notched')}, level AS (SELECT recording_id, sample_idx, {_MEANS} FROM notched) {_rounded('level')}")
def preprocess(spark, d):
    return _out(fl.preprocess(fx.signal(spark, d), FS, 2.0, 20.0, 25.0)[0])


ONE = ad.Params(batch_size=BATCH, ext_fact=1)
_SQUARE = [(i, j) for i in range(CH) for j in range(CH)]


def _course() -> str:
    """The whitening's course over batches in SQL: W and C entry by entry."""
    cell = lambda m, i, j: f"{m}{i}{j}"
    cov = lambda i, j: f"v{min(i, j)}{max(i, j)}"
    every = lambda m: ", ".join(cell(m, i, j) for i, j in _SQUARE)
    made = lambda name, of: ", ".join(f"{of(i, j)} AS {name}{i}{j}" for i, j in _SQUARE)
    wv = made("t", lambda i, j: " + ".join(f"w{i}{k} * {cov(k, j)}" for k in range(CH)))
    c = made("c", lambda i, j: f"CASE WHEN n > 1 THEN 0.9::DOUBLE * o{i}{j} + 0.1::DOUBLE * (" + " + ".join(f"t{i}{k} * w{j}{k}" for k in range(CH)) + f") ELSE o{i}{j} END")
    w = made("w", lambda i, j: f"CASE WHEN n > 1 THEN w{i}{j} - 0.007::DOUBLE * (" + " + ".join(f"(c{i}{k}{' - 1' if i == k else ''}) * w{k}{j}" for k in range(CH)) + f") ELSE w{i}{j} END")
    pairs = ", ".join(f"CASE WHEN count(*) > 1 THEN {f'var_samp(c{i})' if i == j else f'covar_samp(c{i}, c{j})'} END AS v{i}{j}" for i, j in _SQUARE if i <= j)
    vs = ", ".join(f"v{i}{j}" for i, j in _SQUARE if i <= j)
    olds = ", ".join(f"f.c{i}{j} AS o{i}{j}" for i, j in _SQUARE)
    return f"""WITH RECURSIVE {SIG}, {SCALES}, cov AS (SELECT recording_id, sample_idx // {BATCH} AS batch_idx, count(*) AS n, {pairs} FROM sig WHERE sample_idx >= 1 GROUP BY ALL),
f AS (
  SELECT recording_id, 0::BIGINT AS version, {made("w", lambda i, j: f"s{i}" if i == j else "0.0::DOUBLE")}, {made("c", lambda i, j: "1.0::DOUBLE" if i == j else "0.0::DOUBLE")} FROM sc
  UNION ALL
  SELECT recording_id, version + 1, {w}, {every("c")} FROM (
    SELECT recording_id, version, n, {every("w")}, {c} FROM (
      SELECT recording_id, version, n, {every("w")}, {every("o")}, {wv} FROM (
        SELECT f.recording_id, version, n, {every("w")}, {olds}, {vs} FROM f JOIN cov ON cov.recording_id = f.recording_id AND cov.batch_idx = f.version))))
SELECT f.recording_id, version, {", ".join(f"round(w{i}{j}, 6) AS w{i}{j}" for i, j in _SQUARE)} FROM f JOIN cov ON cov.recording_id = f.recording_id AND cov.batch_idx = f.version"""


@query(_course())
def adaptive_whitening(spark, d):
    sig = materialise(fx.signal(spark, d), "signal")
    x = fr.assign_batches(fr.trim_warmup(sig, 1), BATCH).withColumn("x", F.col("channels"))
    diagonal = F.flatten(F.transform("scale", lambda s, i: F.transform("scale", lambda _, j: F.when(i == j, s).otherwise(0.0))))
    unit = F.array(*[F.lit(1.0 if i == j else 0.0) for i, j in _SQUARE])
    start = md.scales(sig, size=CH).select("recording_id", diagonal.alias("w"), unit.alias("c"))
    course = ad.adapt_whitening(ad.batch_covariances(x, CH), start, ONE)
    return course.select("recording_id", "version", *[r6(F.get("w", F.lit(CH * i + j))).alias(f"w{i}{j}") for i, j in _SQUARE])


PARAMS = ad.Params(batch_size=BATCH, ext_fact=EXT, spike_dist=DIST, spike_height_mult=MULT)


def start_packed(spark, d):
    """Packs of the signal, start and units as adapt.adaptive_steps takes them: the fixture's model, calibrated on the signal itself."""
    packs, scales, units, sources = calibrated(spark, d)
    vectors = unit_rows(scales).join(units.drop("w"), ["recording_id", "unit"])
    spikes = packed.detect_spikes(sources, units, DIST, MULT)
    tables = {"signal": packed.unpack(packs), "packs": packs, "ipts": sources, "spikes": spikes, "model_units": vectors, "model_whitening": whitening(packs, scales)}
    vectors, start = md.build_model(tables, EXT, BATCH, PARAMS.cov_alpha, SIZE)
    return packs, materialise(start, "start"), materialise(vectors, "vectors")


def start_model(spark, d):
    """The same with the signal as rows of samples."""
    packs, start, vectors = start_packed(spark, d)
    return packed.unpack(packs), start, vectors


_ROWS, _COLS = range(SIZE), range(1, SIZE + 1)
_EXTENDED = ", ".join(f"coalesce(lag(c{k % CH}, {k // CH}) OVER w, 0)" if k >= CH else f"c{k}" for k in _ROWS)
_PRODUCT = "list_transform({a}, lambda r: list_transform({b}, lambda q: list_inner_product(r, q)))"  # rows of a by rows of b


def _adaptation(adapt_wh: bool) -> str:
    """The adaptation of the fixture's model in SQL, matrices as lists of rows.

    ``course``: whitening and covariance before each batch (as they are all the way without adapt_wh); ``unit_course``: each unit before each batch, and
    the spikes of the batch before.
    """
    start = "[" + ", ".join("[" + ", ".join(f"{m!r}::DOUBLE * s{k % CH}" for k, m in enumerate(row)) + "]" for row in MIX) + "]"
    vectors = "[" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in row) + "]" for row in VECTORS) + "]"
    product = lambda x, y: _PRODUCT.format(a=x, b=y)
    cells = lambda keys, where: f"""SELECT {keys}list(line ORDER BY i) AS v, any_value(n) AS n FROM (
    SELECT {keys}i, list(v ORDER BY j) AS line, any_value(n) AS n FROM (
      SELECT {keys}i, j, coalesce(covar_samp(x[i], x[j]), 0) AS v, count(*) AS n FROM ext, range(1, {SIZE + 1}) a(i), range(1, {SIZE + 1}) b(j) {where} GROUP BY {keys}i, j)
    GROUP BY {keys}i) GROUP BY {keys.rstrip(', ')}"""  # noqa: E731
    mixed = "list_transform(c, lambda r, i: list_transform(r, lambda v, j: 0.9::DOUBLE * v + 0.1::DOUBLE * z[i][j]))"
    moved = f"list_transform(w, lambda r, i: list_transform(r, lambda v, j: v + {PARAMS.wh_learning_rate!r}::DOUBLE * (v - cw[i][j])))"
    turned = f"list_transform(range(1, {SIZE + 1}), lambda k: list_transform(w, lambda r: r[k]))"
    course = f"""cov AS MATERIALIZED ({cells("recording_id, b, ", f"WHERE sample_idx >= {EXT}")}),
whole AS ({cells("recording_id, ", "")}),
course AS (
  SELECT recording_id, 0::BIGINT AS b, w, {product(product("w", "v"), "w")} AS c FROM w0 JOIN whole USING (recording_id)
  UNION ALL
  SELECT recording_id, b + 1, CASE WHEN n > 1 THEN {moved} ELSE w END, c FROM (
    SELECT *, {product("c", turned)} AS cw FROM (
      SELECT recording_id, b, w, n, CASE WHEN n > 1 THEN {mixed} ELSE c END AS c FROM (
        SELECT course.recording_id, course.b, w, c, n, {product(product("w", "v"), "w")} AS z FROM course JOIN cov ON cov.recording_id = course.recording_id AND cov.b = course.b))))"""
    still = "course AS (SELECT recording_id, b, w FROM w0 JOIN (SELECT DISTINCT recording_id, b FROM batches) USING (recording_id))"
    mean = lambda of, value: f"coalesce(list_avg(list_transform({of}, lambda i: {value})), 0)"
    grad = f"list_transform(range(1, {SIZE + 1}), lambda k: w[k] + {PARAMS.sv_learning_rate!r}::DOUBLE * {mean('hits', 'z[i][k] * tanh(ipt[i])')})"
    weighted = lambda old, of: f"({PARAMS.spike_prev_weight} * {old} + len(hits) * {mean(of, 'sq[i]')}) / ({PARAMS.spike_prev_weight} + len(hits))"
    return f"""WITH RECURSIVE {IPTS}, {MODEL},
ext AS (SELECT recording_id, sample_idx, sample_idx // {BATCH} AS b, [{_EXTENDED}] AS x FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx)),
batches AS MATERIALIZED (SELECT recording_id, b, min(sample_idx) AS first, list(x ORDER BY sample_idx) AS xs FROM ext WHERE sample_idx >= {EXT} GROUP BY recording_id, b),
w0 AS (SELECT recording_id, {start} AS w FROM sc),
{course if adapt_wh else still},
zs AS MATERIALIZED (SELECT recording_id, b, first, list_transform(xs, lambda x: list_transform(w, lambda r: list_inner_product(r, x))) AS z FROM batches JOIN course USING (recording_id, b)),
unit_course AS (
  SELECT recording_id, unit, 0::BIGINT AS b, ({vectors})[unit + 1] AS w, base_centr, spikes_centr, height, []::BIGINT[] AS spikes FROM model
  UNION ALL
  SELECT recording_id, unit, b + 1, w, base_centr, spikes_centr, CASE WHEN len(kept) > 0 THEN spikes_centr - (spikes_centr - base_centr) / 2 ELSE height END, list_transform(hits, lambda i: first + i - 1) FROM (
    SELECT recording_id, unit, b, first, kept, hits, height,
      CASE WHEN len(hits) > 0 THEN list_transform(moved, lambda v: v / sqrt(list_inner_product(moved, moved))) ELSE w END AS w,
      CASE WHEN len(rest) > 0 THEN {weighted('base_centr', 'rest')} ELSE base_centr END AS base_centr,
      CASE WHEN len(hits) > 0 THEN {weighted('spikes_centr', 'hits')} ELSE spikes_centr END AS spikes_centr FROM (
      SELECT *, {grad} AS moved FROM (
        SELECT *, list_filter(kept, lambda i: sq[i] > height) AS hits, list_filter(kept, lambda i: sq[i] <= height) AS rest FROM (
          SELECT *, list_reduce(list_prepend([]::BIGINT[], ranked), lambda acc, v: CASE WHEN len(list_filter(acc, lambda k: abs(k - v[1]) < {DIST})) = 0 THEN list_append(acc, v[1]) ELSE acc END) AS kept FROM (
            SELECT *, list_transform(list_sort(list_transform(tops, lambda i: {{'down': -sq[i], 'late': -i}})), lambda t: [-t.late]) AS ranked FROM (
              SELECT *, list_filter(range(2, len(sq)), lambda i: sq[i] > sq[i - 1] AND sq[i] > sq[i + 1] AND sq[i] BETWEEN base_centr / {MULT} AND {MULT} * spikes_centr) AS tops FROM (
                SELECT *, list_transform(ipt, lambda v: v * v) AS sq FROM (
                  SELECT u.*, first, z, list_transform(z, lambda v: list_inner_product(v, u.w)) AS ipt
                  FROM unit_course u JOIN zs ON zs.recording_id = u.recording_id AND zs.b = u.b))))))))),
known AS (SELECT u.* FROM unit_course u JOIN zs USING (recording_id, b))"""


ADAPTED_SPIKES = f"{_adaptation(True)} SELECT recording_id, unit, b - 1 AS batch_idx, unnest(spikes) AS sample_idx FROM unit_course"
TRAJECTORY = f"{_adaptation(True)} SELECT recording_id, b AS version, unit, round(base_centr, 6) AS base_centr, round(spikes_centr, 6) AS spikes_centr FROM known"


@query(f"{_adaptation(False)} SELECT recording_id, b AS version, unit, round(w[1], 6) AS first_weight, round(height, 6) AS height FROM known")
def adaptive_separation(spark, d):
    p = ad.with_params(PARAMS, adapt_wh=False, compute_loss=False)
    out = ad.decompose_adaptive(*start_packed(spark, d), p)["model_units"]
    return out.select("recording_id", "version", "unit", r6(F.get("w", F.lit(0))).alias("first_weight"), r6("height").alias("height"))


@query(ADAPTED_SPIKES)
def decompose_adaptive(spark, d):
    out = ad.decompose_adaptive(*start_packed(spark, d), PARAMS)
    return out["spikes"].select("recording_id", "unit", "batch_idx", "sample_idx")


@query()
def adaptive_losses(spark, d):
    out = ad.decompose_adaptive(*start_packed(spark, d), PARAMS)
    added = out["unit_metrics"].groupBy("recording_id", "batch_idx").agg(F.sum("sv_loss").alias("sv_loss"))
    return out["batch_metrics"].join(added, ["recording_id", "batch_idx"], "left").select("recording_id", "batch_idx", *[r6(c).alias(c) for c in ("wh_loss", "sv_loss", "total_loss")])


@query(TRAJECTORY)
def param_trajectory(spark, d):
    out = ad.decompose_adaptive(*start_packed(spark, d), PARAMS)["model_units"]
    path = f"{shared_folder(spark)}/params-{uuid.uuid4().hex}"
    rec.append_params(out.where("version < 3"), path)
    rec.append_params(out, path)  # what is there already is left out
    back = spark.read.parquet(path)
    return back.select("recording_id", "version", "unit", r6("base_centr").alias("base_centr"), r6("spikes_centr").alias("spikes_centr"))


SPACE = {"wh_learning_rate": [0.0, 0.001, 0.007], "sv_learning_rate": [0.0005, 0.003], "cov_alpha": [0.1, 0.3]}


@query()
def sweep_losses(spark, d):
    losses = sw.run_sweep(*start_packed(spark, d), sw.trial_grid(spark, SPACE), PARAMS)
    return losses.select("trial_id", "recording_id", r6("loss").alias("loss"))


@query()
def sweep_halving(spark, d):
    rungs = sw.Rungs(*start_packed(spark, d), PARAMS)
    # no recording of these tables has more than 8 batches: the last rung sees all of them
    out = sw.successive_halving(sw.trial_grid(spark, SPACE), rungs.evaluate, start=2, stop=8)
    return out.select("trial_id", "rung", "budget", r6("loss").alias("loss"), "kept")


@query()
def sweep_hyperband(spark, d):
    model = start_packed(spark, d)
    out = sw.hyperband(sw.trial_grid(spark, SPACE), lambda: sw.Rungs(*model, PARAMS).evaluate, stop=8, keep=2, brackets=3)
    return out.select("bracket", "trial_id", "rung", "budget", r6("loss").alias("loss"), "kept")


WIDE = ad.Params(batch_size=100, ext_fact=10, spike_dist=DIST, spike_height_mult=MULT)


@query()
def adaptive_wide(spark, d):
    """The adaptive decomposition of the 64-channel frames: 640 entries in an extended sample."""
    size, sig = 64 * WIDE.ext_fact, materialise(fx.frames(spark, d), "frames")
    tiled = md.scales(sig).select("recording_id", F.flatten(F.array_repeat("scale", WIDE.ext_fact)).alias("scale"))
    row = lambda i, value: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == i, value).otherwise(0.0))
    diagonal = tiled.select("recording_id", F.posexplode("scale").alias("row_idx", "s")).select("recording_id", "row_idx", row(F.col("row_idx"), F.col("s")).alias("w"))
    eye = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: row(i, F.lit(1.0))))
    start = tiled.select("recording_id", F.flatten(F.transform("scale", lambda s, i: row(i, s))).alias("w"), eye.alias("c"))
    vectors = F.array(*[F.struct(F.lit(u).alias("unit"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (F.pmod(7 * k + 3 * u, F.lit(11)) - 5) / 80.0).alias("w")) for u in range(3)])
    units = sig.select("recording_id").distinct().select("recording_id", F.inline(vectors))
    ipts = materialise(dc.frozen_ipts_wide(sig, dc.fuse(units, diagonal), 64, WIDE.ext_fact, WIDE.batch_size), "ipts")
    units = md.init_heights(units.join(md.centroids(ipts), ["recording_id", "unit"]))
    return ad.decompose_adaptive(sig, start, units, WIDE)["spikes"].select("recording_id", "unit", "batch_idx", "sample_idx")
