"""Queries of spike-train statistics, agreement, summaries and trial tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..operators import decompose as dc
from ..operators import summary as sm
from ..operators import sweep as sw
from ..operators import trains as tr
from ..sources import fixtures as fx
from ..sources.storage import materialise
from .common import CH, EXT, FROZEN, MIXED, SCALES, SIG, TIMES, TRAINS, frozen, maxima, r6, unit_rows, whitening
from .signals import _LOSSES, losses

QUERIES, ORACLES = {}, {}
KEYS = "recording_id, source, unit"
GAP = 43200.0
TOL, MAX_LAG = 3, 12


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ISI = f"isi AS (SELECT *, t - lag(t) OVER (PARTITION BY {KEYS} ORDER BY t) AS isi FROM times)"


@query(f"WITH {TIMES}, u AS (SELECT DISTINCT recording_id, unit FROM times), s AS (SELECT DISTINCT source FROM times) SELECT u.recording_id, s.source, u.unit, count(t.t) AS n_spikes FROM u CROSS JOIN s LEFT JOIN times t ON t.recording_id = u.recording_id AND t.unit = u.unit AND t.source = s.source GROUP BY ALL")
def spike_count(spark, d):
    times = fx.firing_times(spark, d)
    sources = times.select("source").distinct()
    units = times.select("recording_id", "unit").distinct().crossJoin(sources)  # a handful of event types
    return tr.spike_count(times, units)


@query(f"WITH {TIMES}, {ISI} SELECT {KEYS}, round(t, 6) AS t, round(isi, 6) AS isi FROM isi WHERE isi IS NOT NULL")
def isi(spark, d):
    return tr.isi(fx.firing_times(spark, d)).select("recording_id", "source", "unit", r6("t").alias("t"), r6("isi").alias("isi"))


@query(f"WITH {TIMES}, {ISI} SELECT {KEYS}, round(CASE WHEN min(t) = max(t) THEN 0 ELSE count(*) / nullif(sum(CASE WHEN isi <= {GAP} THEN isi END), 0) END, 9) AS discharge_rate FROM isi GROUP BY ALL")
def discharge_rate(spark, d):
    out = tr.discharge_rate(fx.firing_times(spark, d), GAP)
    return out.withColumn("discharge_rate", F.round("discharge_rate", 9))


@query(f"WITH {TIMES}, {ISI} SELECT {KEYS}, round(100 * stddev_pop(isi) / nullif(avg(isi), 0), 6) AS isi_cov FROM isi WHERE isi < {GAP} GROUP BY ALL")
def isi_cov(spark, d):
    return tr.isi_cov(fx.firing_times(spark, d), GAP).withColumn("isi_cov", r6("isi_cov"))


@query(FROZEN + """, len AS (SELECT recording_id, count(*) AS n_samples FROM sig GROUP BY 1),
spread AS (
  SELECT s.recording_id, s.unit, s.sample_idx + pos - 24 AS sample_idx, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * pos / 49) AS weight, n_samples
  FROM spikes s JOIN len USING (recording_id), range(50) t(pos))
SELECT recording_id, 'test' AS source, unit, sample_idx, round(2 * sum(weight), 6) AS rate FROM spread WHERE sample_idx >= 0 AND sample_idx < n_samples GROUP BY ALL HAVING sum(weight) <> 0""")
def inst_rate(spark, d):
    spikes = frozen(spark, d)[2].select("recording_id", F.lit("test").alias("source"), "unit", "sample_idx")
    lengths = fx.signal(spark, d).groupBy("recording_id").agg(F.count("*").alias("n_samples"))
    return tr.inst_discharge_rate(spikes, lengths, 50).withColumn("rate", r6("rate"))


_LEVELS = f"""sq AS (SELECT recording_id, unit, sample_idx, value FROM ipts),
hits AS (SELECT recording_id, unit, sample_idx, ipts.value FROM ipts JOIN spikes USING (recording_id, unit, sample_idx) WHERE sample_idx >= 9),
lowest AS (SELECT recording_id, unit, min(value) AS lowest FROM hits GROUP BY ALL), {maxima('sq', 'recording_id, unit', 'all_max')},
low AS (SELECT a.* FROM all_max a JOIN lowest USING (recording_id, unit) WHERE value <= lowest),
base AS (
  SELECT recording_id, unit, sample_idx, value FROM low WHERE sample_idx >= 9
  UNION ALL
  SELECT recording_id, unit, sample_idx, value FROM sq SEMI JOIN (SELECT recording_id, unit FROM lowest ANTI JOIN low USING (recording_id, unit)) USING (recording_id, unit)
    ANTI JOIN spikes USING (recording_id, unit, sample_idx) WHERE sample_idx >= 9),
s AS (SELECT recording_id, unit, avg(value) AS s FROM hits GROUP BY ALL), b AS (SELECT recording_id, unit, avg(value) AS b FROM base GROUP BY ALL)"""


@query(f"{FROZEN}, {_LEVELS} SELECT recording_id, unit, round(20 * log10(s / nullif(b, 0)), 6) AS pnr FROM s LEFT JOIN b USING (recording_id, unit)")
def pulse_to_noise(spark, d):
    _, ipts, spikes = frozen(spark, d)
    return tr.pulse_to_noise(spikes, ipts).withColumn("pnr", r6("pnr"))


@query(f"""{FROZEN}, {_LEVELS}, dist AS (SELECT recording_id, unit, sum((value - s) ** 2) AS ds, sum((value - b) ** 2) AS db FROM hits JOIN s USING (recording_id, unit) LEFT JOIN b USING (recording_id, unit) GROUP BY ALL)
SELECT recording_id, unit, round(CASE WHEN db IS NULL THEN NULL WHEN greatest(ds, db) = 0 THEN 0 ELSE (db - ds) / greatest(ds, db) END, 6) AS silhouette FROM dist""")
def silhouette(spark, d):
    _, ipts, spikes = frozen(spark, d)
    return tr.silhouette(spikes, ipts).withColumn("silhouette", r6("silhouette"))


def _train(spark, d, source, name=None):
    return fx.trains(spark, d).where(F.col("source") == source).select("recording_id", "unit", F.col("sample_idx").alias(name or "sample_idx"))


AB = f"{TRAINS}, a AS (SELECT recording_id, unit, sample_idx AS a FROM trains WHERE source = 'click'), b AS (SELECT recording_id, unit, sample_idx AS b FROM trains WHERE source = 'view')"
CORR = f"""near AS (SELECT recording_id, unit, a - b AS d, count(*) AS n FROM a JOIN b USING (recording_id, unit) WHERE abs(a - b) <= {MAX_LAG + TOL - 1} GROUP BY ALL),
corr AS (SELECT recording_id, unit, lag, sum(n * ({TOL} - abs(lag - d)))::BIGINT AS corr FROM near, range(-{MAX_LAG}, {MAX_LAG + 1}) l(lag) WHERE abs(lag - d) < {TOL} GROUP BY ALL),
best AS (SELECT * FROM corr QUALIFY row_number() OVER (PARTITION BY recording_id, unit ORDER BY corr DESC, lag) = 1)"""
UNIT = ("recording_id", "unit")


def _correlogram(spark, d):
    return ag.lag_correlogram(_train(spark, d, "click", "a"), _train(spark, d, "view", "b"), TOL, MAX_LAG, UNIT)


@query(f"WITH {AB}, {CORR} SELECT recording_id, unit, lag, corr FROM corr")
def lag_correlogram(spark, d):
    return _correlogram(spark, d)


@query(f"WITH {AB}, {CORR} SELECT recording_id, unit, lag, corr FROM best")
def best_lag(spark, d):
    return ag.best_lag(_correlogram(spark, d), UNIT)


def matching(ref: str, test: str, keys: str = "recording_id, unit") -> str:
    """SQL of the greedy matching between two tables (keys, a) and (keys, b)."""
    return f"""refs AS (SELECT {keys}, list(a ORDER BY a) AS r FROM {ref} GROUP BY ALL), tests AS (SELECT {keys}, list(b ORDER BY b) AS t FROM {test} GROUP BY ALL),
steps AS (
  SELECT {keys}, r, t, 1 AS k, NULL::BIGINT AS hit FROM refs JOIN tests USING ({keys})
  UNION ALL
  SELECT {keys}, r, list_filter(t, lambda x: x <> coalesce(m.hit, -1000000)), k + 1, m.hit
  FROM steps, LATERAL (SELECT list_min(list_transform(list_filter(t, lambda x: abs(x - r[k]) <= {TOL}), lambda x: abs(x - r[k]) * 1099511627776 + x + 1000000)) % 1099511627776 - 1000000 AS hit) m
  WHERE k <= len(r)),
matched AS (SELECT {keys}, r[k - 1] AS a, hit AS b FROM steps WHERE hit IS NOT NULL)"""


@query(f"WITH RECURSIVE {AB}, {matching('a', 'b')} SELECT recording_id, unit, a, b FROM matched")
def match_firings(spark, d):
    return ag.match_firings(_train(spark, d, "click", "a"), _train(spark, d, "view", "b"), TOL, UNIT)


@query(f"""WITH RECURSIVE {AB}, {CORR}, have AS (SELECT recording_id, unit FROM a UNION SELECT recording_id, unit FROM b),
lags AS (SELECT recording_id, unit, coalesce(lag, -{MAX_LAG}) AS lag FROM have LEFT JOIN best USING (recording_id, unit)),
moved AS (SELECT recording_id, unit, b + lag AS b FROM b JOIN lags USING (recording_id, unit)), {matching('a', 'moved')},
c AS (SELECT recording_id, unit, count(*) AS n FROM matched GROUP BY ALL), na AS (SELECT recording_id, unit, count(*) AS n FROM a GROUP BY ALL), nb AS (SELECT recording_id, unit, count(*) AS n FROM b GROUP BY ALL)
SELECT recording_id, unit, lag, coalesce(c.n, 0) AS n_common, round(coalesce(c.n, 0) / nullif(coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(c.n, 0), 0), 6) AS roa
FROM lags LEFT JOIN c USING (recording_id, unit) LEFT JOIN na USING (recording_id, unit) LEFT JOIN nb USING (recording_id, unit)""")
def roa_paired(spark, d):
    out = ag.agreement_paired(_train(spark, d, "click"), _train(spark, d, "view"), TOL, MAX_LAG)
    return out.withColumn("roa", r6("roa"))


def assigning(test: str, within: bool = False, where: str = "TRUE") -> str:
    """SQL of the greedy unit assignment between the click train and another, by the best correlation at any lag."""
    used = "list_contains(used_r, p[k].r) OR list_contains(used_t, p[k].t)" + (" OR list_contains(used_t, p[k].r) OR list_contains(used_r, p[k].t)" if within else "")
    return f"""ra AS (SELECT recording_id, unit AS unit_ref, sample_idx AS a FROM trains WHERE source = 'click' AND {where}),
rb AS (SELECT recording_id, unit AS unit_test, sample_idx AS b FROM trains WHERE source = '{test}' AND {where}),
pnear AS (SELECT recording_id, unit_ref, unit_test, a - b AS d, count(*) AS n FROM ra JOIN rb USING (recording_id) {"WHERE unit_ref < unit_test" if within else ""} GROUP BY ALL),
pcorr AS (SELECT recording_id, unit_ref, unit_test, d + s AS lag, sum(n * ({TOL} - abs(s)))::BIGINT AS corr FROM pnear, range(-{TOL - 1}, {TOL}) l(s) GROUP BY ALL),
pbest AS (SELECT * FROM pcorr QUALIFY row_number() OVER (PARTITION BY recording_id, unit_ref, unit_test ORDER BY corr DESC, lag) = 1),
plist AS (SELECT recording_id, list({{'r': unit_ref, 't': unit_test, 'c': corr, 'l': lag}} ORDER BY corr DESC, unit_ref, unit_test) AS p FROM pbest GROUP BY 1),
psteps AS (
  SELECT recording_id, p, 1 AS k, []::BIGINT[] AS used_r, []::BIGINT[] AS used_t, FALSE AS took FROM plist
  UNION ALL
  SELECT recording_id, p, k + 1, CASE WHEN {used} THEN used_r ELSE list_append(used_r, p[k].r) END, CASE WHEN {used} THEN used_t ELSE list_append(used_t, p[k].t) END, NOT ({used})
  FROM psteps WHERE k <= len(p)),
pairs AS (SELECT recording_id, p[k - 1].r AS unit_ref, p[k - 1].t AS unit_test, p[k - 1].c AS corr, {f"CASE WHEN abs(p[k - 1].l) > {MAX_LAG} THEN 0 ELSE p[k - 1].l END" if within else "p[k - 1].l"} AS lag FROM psteps WHERE took)"""


def _pairs(spark, d, test="view", cond="true"):
    a = _train(spark, d, "click").where(cond).select("recording_id", F.col("unit").alias("unit_ref"), F.col("sample_idx").alias("a"))
    b = _train(spark, d, test).where(cond).select("recording_id", F.col("unit").alias("unit_test"), F.col("sample_idx").alias("b"))
    return ag.unit_pairs(a, b, TOL)


@query(f"WITH RECURSIVE {TRAINS}, {assigning('view')} SELECT recording_id, unit_ref, unit_test, corr, lag FROM pairs")
def assign_units(spark, d):
    return _pairs(spark, d).withColumn("corr", F.col("corr").cast("long"))


def _agreement(test: str, within: bool = False) -> str:
    keys = "recording_id, unit_ref, unit_test"
    return f"""WITH RECURSIVE {TRAINS}, {assigning(test, within)},
pa AS (SELECT {keys}, a FROM pairs JOIN ra USING (recording_id, unit_ref)), pb AS (SELECT {keys}, b + lag AS b FROM pairs JOIN rb USING (recording_id, unit_test)),
{matching('pa', 'pb', keys)}, c AS (SELECT {keys}, count(*) AS n FROM matched GROUP BY ALL), na AS (SELECT {keys}, count(*) AS n FROM pa GROUP BY ALL), nb AS (SELECT {keys}, count(*) AS n FROM pb GROUP BY ALL)
SELECT {keys}, lag, coalesce(c.n, 0) AS n_common, round(coalesce(c.n, 0) / nullif(na.n + nb.n - coalesce(c.n, 0), 0), 6) AS roa
FROM pairs LEFT JOIN c USING ({keys}) LEFT JOIN na USING ({keys}) LEFT JOIN nb USING ({keys})"""


@query(_agreement("view"))
def roa_between(spark, d):
    return ag.agreement(_train(spark, d, "click"), _train(spark, d, "view"), TOL).withColumn("roa", r6("roa"))


@query(_agreement("click", within=True))
def roa_within(spark, d):
    return ag.agreement_within(_train(spark, d, "click"), TOL, MAX_LAG).withColumn("roa", r6("roa"))


@query(f"""WITH RECURSIVE {TIMES}, first AS (SELECT min(floor(t / {fx.TICK})::BIGINT) AS start FROM times),
trains AS (SELECT DISTINCT recording_id, source, unit, floor(t / {fx.TICK})::BIGINT - start AS sample_idx FROM times, first), {assigning("view", where="sample_idx < 2000")},
ea AS (SELECT recording_id, unit, sample_idx AS a FROM trains WHERE source = 'click' AND (recording_id, unit) IN (SELECT (recording_id, unit_ref) FROM pairs)),
eb AS (SELECT trains.recording_id, unit_ref AS unit, sample_idx AS b FROM trains JOIN pairs ON trains.recording_id = pairs.recording_id AND trains.unit = unit_test WHERE source = 'view'),
near AS (SELECT recording_id, unit, a - b AS d, count(*) AS n FROM ea JOIN eb USING (recording_id, unit) WHERE abs(a - b) <= {MAX_LAG + TOL - 1} GROUP BY ALL),
corr AS (SELECT recording_id, unit, lag, sum(n * ({TOL} - abs(lag - d)))::BIGINT AS corr FROM near, range(-{MAX_LAG}, {MAX_LAG + 1}) l(lag) WHERE abs(lag - d) < {TOL} GROUP BY ALL),
best AS (SELECT * FROM corr QUALIFY row_number() OVER (PARTITION BY recording_id, unit ORDER BY corr DESC, lag) = 1),
have AS (SELECT recording_id, unit FROM ea UNION SELECT recording_id, unit FROM eb),
lags AS (SELECT recording_id, unit, coalesce(lag, -{MAX_LAG}) AS lag FROM have LEFT JOIN best USING (recording_id, unit)),
moved AS (SELECT recording_id, unit, b + lag AS b FROM eb JOIN lags USING (recording_id, unit)), {matching('ea', 'moved')},
c AS (SELECT recording_id, unit, count(*) AS n FROM matched GROUP BY ALL), na AS (SELECT recording_id, unit, count(*) AS n FROM ea GROUP BY ALL), nb AS (SELECT recording_id, unit, count(*) AS n FROM eb GROUP BY ALL)
SELECT recording_id, unit, lag, coalesce(c.n, 0) AS n_common, round(coalesce(c.n, 0) / nullif(coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(c.n, 0), 0), 6) AS roa
FROM lags LEFT JOIN c USING (recording_id, unit) LEFT JOIN na USING (recording_id, unit) LEFT JOIN nb USING (recording_id, unit)""")
def evaluate_run(spark, d):
    start = fx.trains(spark, d).agg(F.min("sample_idx")).first()[0] or 0
    shift = lambda df: df.withColumn("sample_idx", F.col("sample_idx") - start)
    out = ag.evaluate_run(shift(_train(spark, d, "click")), shift(_train(spark, d, "view")), 2000, TOL, None, MAX_LAG)
    return out.withColumn("roa", r6("roa"))


@query(f"WITH RECURSIVE {TRAINS}, {assigning('view')}, x AS (SELECT recording_id, unit_ref, unit_test FROM pairs), y AS (SELECT DISTINCT recording_id, unit AS unit_ref, unit AS unit_test FROM trains WHERE source = 'click'), n AS (SELECT recording_id, unit_ref, unit_test, sum(side) AS net FROM (SELECT *, 1 AS side FROM x UNION ALL SELECT *, -1 FROM y) GROUP BY ALL) SELECT recording_id, bool_and(net = 0) AS same FROM n GROUP BY 1")
def same_pairing(spark, d):
    named = _train(spark, d, "click").select("recording_id", F.col("unit").alias("unit_ref"), F.col("unit").alias("unit_test")).distinct()
    return sm.same_pairing(_pairs(spark, d), named, ["unit_ref", "unit_test"])


@query(f"{_LOSSES} SELECT recording_id, round(avg(sv_loss), 6) AS mean, round(stddev_pop(sv_loss), 6) AS std, round(median(sv_loss), 6) AS median FROM sv GROUP BY 1")
def metric_summary(spark, d):
    out = sm.summarise(losses(spark, d)[1], "sv_loss", ["recording_id"])
    return out.select("recording_id", *[r6(c).alias(c) for c in ("mean", "std", "median")])


@query(f"{_LOSSES} SELECT recording_id, round(CASE WHEN count(wh_loss) = count(*) THEN quantile_disc(wh_loss, 0.5) END, 4) AS lower_median FROM wh GROUP BY 1")
def lower_median(spark, d):
    return losses(spark, d)[0].groupBy("recording_id").agg(F.round(sm.lower_median("wh_loss"), 4).alias("lower_median"))


@query(f"{_LOSSES} SELECT recording_id, unit, round(coalesce(sum(sv_loss), 0), 6) AS nan_sum, round(quantile_disc(sv_loss, 0.5), 6) AS nan_median FROM sv GROUP BY ALL")
def nan_aggregates(spark, d):
    sv = losses(spark, d)[1].withColumn("sv_loss", F.coalesce("sv_loss", F.lit(float("nan"))))
    return sv.groupBy("recording_id", "unit").agg(r6(sm.nan_sum("sv_loss")).alias("nan_sum"), r6(sm.nan_median("sv_loss")).alias("nan_median"))


@query(f"{_LOSSES}, m AS (SELECT recording_id, coalesce(CASE WHEN count(wh_loss) = count(*) THEN quantile_disc(wh_loss, 0.5) END, 1e10) AS wh FROM wh GROUP BY 1), s AS (SELECT recording_id, quantile_disc(sv_loss, 0.5) AS sv FROM sv GROUP BY 1) SELECT recording_id, round(-wh - coalesce(sv, 0), 4) AS objective FROM m LEFT JOIN s USING (recording_id)")
def objective(spark, d):
    return sm.objective(*losses(spark, d), ["recording_id"]).withColumn("objective", F.round("objective", 4))


@query(f"{_LOSSES} SELECT coalesce(wh.recording_id, svs.recording_id) AS recording_id, coalesce(wh.batch_idx, svs.batch_idx) AS batch_idx, round(wh_loss, 4) AS a, round(sv, 4) AS b, round(sv - wh_loss, 4) AS diff FROM wh FULL JOIN svs ON wh.recording_id = svs.recording_id AND wh.batch_idx = svs.batch_idx")
def compare_runs(spark, d):
    wh, sv = losses(spark, d)
    added = sv.groupBy("recording_id", "batch_idx").agg(F.sum("sv_loss").alias("loss"))
    out = sm.compare_runs(wh.withColumnRenamed("wh_loss", "loss"), added, ["recording_id", "batch_idx"], "loss")
    return out.select("recording_id", "batch_idx", *[F.round(c, 4).alias(c) for c in ("a", "b", "diff")])


_ROWS = ", ".join("(" + ", ".join([str(u), *[repr(x) + "::DOUBLE" for x in v]]) + ")" for u, v in enumerate(MIXED))
_NAMES = ", ".join(f"v{k}" for k in range(CH * EXT))


@query(f"""WITH {SIG}, {SCALES}, half AS (SELECT recording_id, {", ".join(f"coalesce(1.0::DOUBLE / nullif(stddev_pop(c{i}), 0), 0) AS h{i}" for i in range(CH))} FROM sig WHERE sample_idx < 300 GROUP BY 1),
v(unit, {_NAMES}) AS (VALUES {_ROWS}),
x AS (SELECT recording_id, unit, unnest(range({CH * EXT})) AS pos, unnest([{", ".join(f"v{k} * h{k % CH} - v{k} * s{k % CH}" for k in range(CH * EXT))}]) AS diff FROM sc JOIN half USING (recording_id), v)
SELECT recording_id, unit, pos, round(diff, 6) AS diff, round(max(abs(diff)) OVER (PARTITION BY recording_id), 6) AS most FROM x""")
def param_diff(spark, d):
    sig = materialise(fx.signal(spark, d), "signal")
    rows = lambda part: dc.fuse(unit_rows(sig), whitening(part))
    out = sm.param_diff(rows(sig), rows(sig.where("sample_idx < 300")), ["recording_id", "unit"])
    return out.select("recording_id", "unit", F.col("pos").cast("long").alias("pos"), r6("diff").alias("diff"), r6("most").alias("most"))


GRID = {"wh_learning_rate": [0.0, 0.001, 0.007], "sv_learning_rate": [0.0005, 0.003]}


@query(f"WITH {SIG}, n AS (SELECT recording_id, count(*) AS n_samples FROM sig GROUP BY 1), w(i, wh_learning_rate) AS (VALUES (0, 0.0::DOUBLE), (1, 0.001::DOUBLE), (2, 0.007::DOUBLE)), s(j, sv_learning_rate) AS (VALUES (0, 0.0005::DOUBLE), (1, 0.003::DOUBLE)) SELECT recording_id, n_samples, i * 2 + j AS trial_id, wh_learning_rate, sv_learning_rate FROM n, w, s")
def trial_grid(spark, d):
    lengths = fx.signal(spark, d).groupBy("recording_id").agg(F.count("*").alias("n_samples"))
    return lengths.crossJoin(F.broadcast(sw.trial_grid(spark, GRID)))  # six rows


@query(f"{_LOSSES}, t AS (SELECT recording_id, unit AS trial_id, median(sv_loss) AS loss FROM sv GROUP BY ALL) SELECT recording_id, trial_id, round(loss, 6) AS loss FROM t QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY loss NULLS LAST, trial_id) <= 2")
def best_trial(spark, d):
    table = losses(spark, d)[1].groupBy("recording_id", F.col("unit").alias("trial_id")).agg(F.percentile("sv_loss", 0.5).alias("loss"))
    return sw.best_trial(table, 2, ["recording_id"]).select("recording_id", "trial_id", r6("loss").alias("loss"))
