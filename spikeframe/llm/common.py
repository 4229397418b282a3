"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise, shared_folder

__all__ = ["WORD", "by_place", "let", "materialise", "meet", "prefix_sums", "running", "shared_dir", "shingle_hashes", "table", "with_defaults", "words_of"]

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


shared_dir = shared_folder


def prefix_sums(df: DataFrame, order: list[Column], name: str, part: str | None = None, **sums: Column) -> DataFrame:
    """df with a column for each of sums: its total over all rows before, in the order given.

    Rows are range-sorted into parts and written; what meets in one task is a part, or one total for each part.
    part: name for the number of a row's part, if it is wanted.
    """
    rows = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    totals = rows.groupBy("__part").agg(*[F.sum(v).alias(f"__{k}") for k, v in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__part", *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__{k}") for k in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f"__in_{k}": F.coalesce(F.sum(v).over(within), F.lit(0)) for k, v in sums.items()})
    kept = [F.col("__part").alias(part)] if part else []
    return inside.join(before, "__part").select(*df.columns, *kept, *[(F.col(f"__in_{k}") + F.col(f"__{k}")).alias(k) for k in sums])


#: A key of more than one row in so many counts as hot.
HOT_SHARE = 1000


def meet(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with ``one``, which has at most one row for each value of keys (none of them null).

    rows: a written table. A key that more than one row in HOT_SHARE has (there are fewer than HOT_SHARE of these) meets its
    row of ``one`` by broadcast; the others are shuffled, where no key has more rows than that.
    """
    total = rows.count()
    hot = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") * HOT_SHARE > total).select(*keys)
    hot = materialise(hot, "hot-keys")
    if hot.isEmpty():
        return rows.join(one, keys)
    few = one.join(F.broadcast(hot), keys, "left_semi")
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(one, keys)
    return rows.join(F.broadcast(few), keys).unionByName(rest)


def with_defaults(text: str | Column) -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def by_place(docs: DataFrame, *cols: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns named c0, c1, ... by their place, and the new names of ``cols``: no column of docs clashes with a name used inside."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in cols]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


#: Elements that running() sums at once.
STEP = 256


def _scan(lengths: Column, start: Column) -> Column:
    def step(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    first = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(lengths, first, step)["out"]


def running(lengths: Column) -> Column:
    """For each element of an array<bigint> the sum of those before it.

    Steps of STEP elements get their starts from sums of steps, so that long arrays are not copied once for each element.
    """

    def of(values: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / STEP).cast("int"))
        part = lambda k: F.slice(values, k * STEP + 1, F.lit(STEP))
        sums = F.transform(steps, lambda k: F.aggregate(part(k), F.lit(0).cast("long"), lambda acc, n: acc + n))
        return let(_scan(sums, F.lit(0)), lambda starts: F.flatten(F.transform(steps, lambda k: _scan(part(k), F.get(starts, k)))))

    return let(lengths, of)


def words_of(text: str | Column) -> Column:
    """The words of a text in order; none for a null or blank one."""
    bare = F.btrim(with_defaults(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingle_hashes(text: str | Column, width: int = 5) -> Column:
    """64-bit hashes of the runs of ``width`` words; of a shorter text one hash of all its words."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        wide = F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(wide)

    return let(words_of(text), runs)
