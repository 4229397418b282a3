"""Peak and spike detection within batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import BLOCK, with_history

KEYS = ("recording_id", "unit", "batch_idx")


def local_maxima(df: DataFrame, value: str = "value", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Peaks (keys, sample_idx, value): strict local maxima, the middle of a plateau (rounded down), never an end."""
    order = Window.partitionBy(*keys).orderBy("sample_idx")
    new = F.coalesce((F.col("value") != F.lag("value").over(order)).cast("int"), F.lit(1))
    runs = df.select(*keys, "sample_idx", F.col(value).alias("value")).withColumn("__new", new)
    runs = runs.withColumn("__run", F.sum("__new").over(order)).groupBy(*keys, "__run").agg(F.first("value").alias("value"), F.min("sample_idx").alias("__a"), F.max("sample_idx").alias("__b"))
    by_run = Window.partitionBy(*keys).orderBy("__run")
    runs = runs.withColumns({"__before": F.lag("value").over(by_run), "__after": F.lead("value").over(by_run)})
    peak = (F.col("value") > F.col("__before")) & (F.col("value") > F.col("__after"))
    return runs.where(peak).select(*keys, F.floor((F.col("__a") + F.col("__b")) / 2).cast("long").alias("sample_idx"), "value")


def local_maxima_long(df: DataFrame, value: str = "value", keys: tuple[str, ...] = ("recording_id", "unit"), block: int = BLOCK) -> DataFrame:
    """The same as local_maxima for series of any length, by blocks of samples without gaps.

    A peak's run begins with a rise and ends with a fall. Changes are found within blocks; where a block's last
    one has its next in a later block, that comes from a table of the blocks' first changes.
    """
    rows = with_history(df.select(*keys, "sample_idx", F.col(value).alias("value")), 1, keys, block)
    order = Window.partitionBy(*keys, "block").orderBy("sample_idx")
    change = F.signum(F.col("value") - F.lag("value").over(order))
    changes = rows.withColumn("turn", change).where("not halo and turn <> 0")
    after = F.struct("sample_idx", "turn")
    firsts = changes.groupBy(*keys, "block").agg(F.min(after).alias("__first"))
    firsts = firsts.select(*keys, "block", F.lead("__first").over(Window.partitionBy(*keys).orderBy("block")).alias("__next"))
    near = changes.withColumn("__within", F.lead(after).over(order)).join(firsts, [*keys, "block"])
    near = near.withColumn("__end", F.coalesce("__within", "__next"))
    middle = F.floor((F.col("sample_idx") + F.col("__end.sample_idx") - 1) / 2).cast("long")
    return near.where((F.col("turn") > 0) & (F.col("__end.turn") < 0)).select(*keys, middle.alias("sample_idx"), "value")


def height_filter(peaks: DataFrame, model: DataFrame, mult: float) -> DataFrame:
    """Peaks between base_centr / mult and mult * spikes_centr, both included."""
    near = peaks.join(model.select("recording_id", "unit", "base_centr", "spikes_centr"), ["recording_id", "unit"])
    return near.where(F.col("value").between(F.col("base_centr") / mult, mult * F.col("spikes_centr"))).drop("base_centr", "spikes_centr")


def refractory(peaks: DataFrame, distance: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The highest peaks first, without their neighbours closer than distance; of equal ones the later.

    Peaks that far apart never touch, so runs of near ones are taken each by itself: at most
    a run is in one array.
    """
    order = Window.partitionBy(*keys).orderBy("sample_idx")
    gap = F.col("sample_idx") - F.lag("sample_idx").over(order) >= distance
    runs = peaks.withColumn("__new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(order))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("down"), (-F.col("sample_idx")).alias("late"))))
    runs = runs.groupBy(*keys, "__run").agg(ranked.alias("peaks"))
    none = F.array().cast("array<struct<down:double,late:bigint>>")

    def keep(acc: Column, p: Column) -> Column:
        near = F.exists(acc, lambda k: F.abs(k["late"] - p["late"]) < distance)
        return F.when(near, acc).otherwise(F.concat(acc, F.array(p)))

    kept = runs.select(*keys, F.explode(F.aggregate("peaks", none, keep)).alias("p"))
    return kept.select(*keys, (-F.col("p.late")).alias("sample_idx"), (-F.col("p.down")).alias("value"))


def label_peaks(peaks: DataFrame, model: DataFrame) -> DataFrame:
    """is_spike: above the unit's height."""
    near = peaks.join(model.select("recording_id", "unit", "height"), ["recording_id", "unit"])
    return near.withColumn("is_spike", F.col("value") > F.col("height")).drop("height")


def candidate_peaks(ipts: DataFrame, model: DataFrame, distance: int, mult: float) -> DataFrame:
    """Peaks of the squared ipts of each batch within the band, labelled."""
    squares = ipts.select(*KEYS, "sample_idx", (F.col("ipt") * F.col("ipt")).alias("value"))
    return label_peaks(refractory(height_filter(local_maxima(squares), model, mult), distance), model)


def detect_spikes(ipts: DataFrame, model: DataFrame, distance: int, mult: float) -> DataFrame:
    """Spikes (recording_id, unit, batch_idx, sample_idx, value) under fixed thresholds."""
    return candidate_peaks(ipts, model, distance, mult).where("is_spike").drop("is_spike")


def centroid_step(peaks: DataFrame, model: DataFrame, prev_weight: float) -> DataFrame:
    """New centroids after one batch's labelled peaks; both weigh the new mean by the number of spikes."""
    sums = peaks.groupBy("recording_id", "unit", "batch_idx").agg(
        F.sum(F.col("is_spike").cast("int")).alias("n"),
        F.avg(F.when(F.col("is_spike"), F.col("value"))).alias("spike"),
        F.avg(F.when(~F.col("is_spike"), F.col("value"))).alias("base"),
    )
    near = sums.join(model.select("recording_id", "unit", "base_centr", "spikes_centr"), ["recording_id", "unit"])
    mean = lambda new, old: (prev_weight * F.col(old) + F.col("n") * F.coalesce(new, old)) / (prev_weight + F.col("n"))
    out = near.withColumns({"new_base": F.when(F.col("base").isNull(), F.col("base_centr")).otherwise(mean("base", "base_centr")), "new_spikes": F.when(F.col("spike").isNull(), F.col("spikes_centr")).otherwise(mean("spike", "spikes_centr"))})
    height = F.col("new_spikes") - (F.col("new_spikes") - F.col("new_base")) / 2
    return out.select("recording_id", "unit", "batch_idx", F.col("n").cast("long").alias("n_spikes"), F.col("new_base").alias("base_centr"), F.col("new_spikes").alias("spikes_centr"), height.alias("height"))
