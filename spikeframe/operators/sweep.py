"""Hyper-parameter trials as tables: grids, parallel evaluation, halving and the best."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise
from .adapt import Params, adaptive_steps, adaptive_stretch, recording_bounds, start_rows, with_params
from .summary import objective_of_steps

#: Parameters that a trial may set.
SWEPT = ("wh_learning_rate", "sv_learning_rate", "cov_alpha")


def trial_grid(spark: SparkSession, space: dict[str, list[float]]) -> DataFrame:
    """(trial_id, one column for each parameter): every combination, the last name varying fastest."""
    names = list(space)
    rows = [(i, *map(float, values)) for i, values in enumerate(itertools.product(*space.values()))]
    return spark.createDataFrame(rows, "trial_id int, " + ", ".join(f"`{n}` double" for n in names))


def trial_random(spark: SparkSession, ranges: dict[str, tuple[float, float]], n: int, seed: int = 0) -> DataFrame:
    """n trials drawn evenly from the ranges; a seed gives the same ones again."""
    draws = {k: F.rand(seed + 101 * i) * (hi - lo) + lo for i, (k, (lo, hi)) in enumerate(sorted(ranges.items()))}
    return spark.range(n, numPartitions=1).select(F.col("id").cast("int").alias("trial_id"), *[v.alias(k) for k, v in draws.items()])


def best_trial(losses: DataFrame, k: int = 1, by: list[str] | None = None) -> DataFrame:
    """The k trials of least loss, of each group if by is given; missing losses last, ties by number."""
    order = [F.col("loss").asc_nulls_last(), F.col("trial_id").asc()]
    if not by:
        return losses.orderBy(*order).limit(k)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return losses.withColumn("__nth", nth).where(F.col("__nth") <= k).drop("__nth")


def _settings(trials: DataFrame, p: Params) -> list[tuple[int, Params]]:
    names = [c for c in trials.columns if c in SWEPT]
    return [(r.trial_id, with_params(p, compute_loss=True, **{c: r[c] for c in names})) for r in trials.orderBy("trial_id").collect()]


def run_sweep(signal: DataFrame, start: DataFrame, units: DataFrame, trials: DataFrame, p: Params, batches: int | None = None) -> DataFrame:
    """(trial_id, recording_id, loss): every trial's adaptive decomposition of every recording, less the objective.

    trials (trial_id and some of SWEPT; p holds the rest) are few: they come to the driver and go to the
    tasks, where a recording's samples serve a group of trials at once. batches: only the first so many of
    each recording. Other inputs as in adapt.adaptive_steps.
    """
    steps = adaptive_steps(signal, start, units, _settings(trials, p), whole=False, last_batch=batches)
    by = ["trial_id", "recording_id"]
    return objective_of_steps(steps, by).select(*by, (-F.col("objective")).alias("loss"))


def successive_halving(trials: DataFrame, evaluate: Callable[[DataFrame, int], DataFrame], start: int = 5, stop: int = 50, keep: int = 2) -> DataFrame:
    """(trial_id, rung, budget, loss, kept): trials by loss after ever more batches, 1/keep of them going on.

    evaluate(trials, budget) gives (trial_id, loss) over the first ``budget`` batches of every recording;
    all trials of a rung run in one job, and only their numbers and losses come to the driver.
    """
    spark, budget, rung, rows, live = trials.sparkSession, start, 0, [], trials
    while True:
        losses = [(r.trial_id, r.loss) for r in best_trial(evaluate(live, budget), 1 << 30).collect()]
        last = budget >= stop or len(losses) <= 1
        n = len(losses) if last else max(1, len(losses) // keep)
        rows += [(t, rung, budget, loss, i < n) for i, (t, loss) in enumerate(losses)]
        if last:
            return spark.createDataFrame(rows, "trial_id int, rung int, budget int, loss double, kept boolean")
        live = live.where(F.col("trial_id").isin([t for t, _ in losses[:n]]))
        budget, rung = min(stop, budget * keep), rung + 1


class Rungs:
    """A sweep that stops after some batches and goes on from there: no batch is computed twice.

    evaluate(trials, budget), as successive_halving calls it, runs the trials from the batch that the last call
    stopped at up to ``budget`` and returns (trial_id, loss): the mean over recordings of the objective of all batches so far, less. Between calls the
    models of all trials and recordings (whitening, covariance, units) are a written table. A call's trials must be among those of
    the call before, and its budget larger. Inputs as in adapt.adaptive_steps.
    """

    def __init__(self, signal: DataFrame, start: DataFrame, units: DataFrame, p: Params):
        self.signal, self.p = signal, p
        self.begun = start_rows(start, units)
        self.bounds = materialise(recording_bounds(signal, p.batch_size), "bounds")
        self.steps: DataFrame | None = None
        self.state: DataFrame | None = None
        self.done = 0

    def evaluate(self, trials: DataFrame, budget: int) -> DataFrame:
        if budget <= self.done:
            raise ValueError(f"{budget} batches are done already")
        settings = _settings(trials, self.p)
        made = adaptive_stretch(self.signal, self.begun, self.bounds, self.state, settings, self.done, budget)
        made = materialise(made, "rung")
        self.state, self.done = made.where("kind is not null"), budget
        losses = made.where("kind is null").select("recording_id", "trial_id", "batch_idx", "unit", "wh_loss", "sv_loss")
        self.steps = losses if self.steps is None else self.steps.unionByName(losses)
        mine = self.steps.where(F.col("trial_id").isin([t for t, _ in settings]))
        return objective_of_steps(mine, ["trial_id", "recording_id"]).groupBy("trial_id").agg(F.avg(-F.col("objective")).alias("loss"))


def bracket_budgets(stop: int, keep: int, brackets: int) -> list[int]:
    """First budget of each bracket, the boldest first: stop / keep^s for s from brackets - 1 to 0, one batch at least."""
    return [max(1, stop // keep**s) for s in range(brackets - 1, -1, -1)]


def hyperband(trials: DataFrame, evaluate: Callable[[], Callable[[DataFrame, int], DataFrame]], stop: int = 50, keep: int = 3, brackets: int = 3) -> DataFrame:
    """(bracket, trial_id, rung, budget, loss, kept): successive halving from several first budgets.

    Bracket b of ``brackets`` begins with bracket_budgets[b] batches; the last one runs its trials in full. The trials are dealt in the order of their
    numbers, to a bracket of s rungs before the last ones in proportion to ceil(brackets * keep^s / (s + 1)). evaluate() makes what
    successive_halving calls, anew for each bracket (Rungs(...).evaluate). Brackets without trials are left out.
    """
    spark = trials.sparkSession
    shares = [-(-brackets * keep**s // (s + 1)) for s in range(brackets - 1, -1, -1)]
    ids = sorted(r.trial_id for r in trials.select("trial_id").collect())
    edges = [len(ids) * sum(shares[:i]) // sum(shares) for i in range(brackets + 1)]
    rows = []
    for b, first in enumerate(bracket_budgets(stop, keep, brackets)):
        mine = ids[edges[b] : edges[b + 1]]
        if mine:
            out = successive_halving(trials.where(F.col("trial_id").isin(mine)), evaluate(), first, stop, keep)
            rows += [(b, *r) for r in out.collect()]
    return spark.createDataFrame(rows, "bracket int, trial_id int, rung int, budget int, loss double, kept boolean")
