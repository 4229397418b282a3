"""Exact deduplication by a tree merge of sorted digest runs.

The rows of each part of the table are a run: its digests in order, equal ones joined
to one entry with the row to keep and the number of rows. Runs meet in binomial
rounds: in each round the runs whose numbers differ in one digit (to the base ``fan``)
go to the one with the digit 0. A run is cut into ranges of digests, so that what meets is
a range of ``fan`` runs, not a whole run; it is merged by sorting and joined by an
aggregation over the sorted rows. An entry counts as equal to another where digest,
second hash and length all agree, at every level. The outcome goes back to the rows run
by run, so that no task meets more of a large group of copies than one part's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, materialise, with_defaults

#: Rounds at most, and runs that meet in one at least.
ROUNDS, FAN = 3, 8
#: Bits of the digest that name its range.
RANGE_BITS = 12
#: What must agree besides the digest before two rows count as copies.
VERIFY = ("check", "octets")
ENTRY = ("slice", "digest", *VERIFY)


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, run, slice, digest, check, octets, id), one row for each of docs, as a written table; run: the part it came from."""
    text = with_defaults(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().cast("long").alias("run"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).alias("octets"),
        F.col(id_col).alias("id"),
    )
    head = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    return materialise(rows.withColumn("slice", F.shiftright(head, 16 - RANGE_BITS)), "digest-runs")


def _rank(keep: str) -> Column:
    """What the kept row has most (keep="max") or least of: an id at all, then the id, then the row."""
    there = F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()
    return F.struct(there.alias("there"), F.col("id"), F.col("row"))


def _merge(entries: DataFrame, keep: str) -> DataFrame:
    """One entry for each digest of a run's range. The struct has no place in a hash aggregation, so that Spark sorts and merges."""
    best = F.max if keep == "max" else F.min
    return entries.groupBy("run", *ENTRY).agg(best("best").alias("best"), F.sum("group_size").alias("group_size"))


def first_runs(rows: DataFrame, keep: str = "max") -> DataFrame:
    """The sorted runs that the rounds start from: rows (digest_runs) joined within their parts before anything moves."""
    return _merge(rows.select("run", *ENTRY, _rank(keep).alias("best"), F.lit(1).cast("long").alias("group_size")), keep)


def merge_tree(level: DataFrame, keep: str = "max", runs: int | None = None, fan: int | None = None) -> DataFrame:
    """(slice, digest, check, octets, best, group_size) after all rounds; level: what first_runs returns."""
    if runs is None:
        runs = (level.agg(F.max("run")).first()[0] or 0) + 1
    if fan is None:
        fan = max(FAN, int(runs ** (1 / ROUNDS)) + 1)
    stride = 1
    while stride < runs:
        stride *= fan
        # the holder of a round: the run whose last digits are 0
        moved = level.withColumn("run", F.col("run") - F.pmod("run", F.lit(stride)))
        level = _merge(moved.repartition("run", "slice").sortWithinPartitions("run", *ENTRY), keep)
    return level.drop("run")


def fates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """(row, id, digest, best, group_size), one row for each of docs: best holds id and row of the copy that stays."""
    rows = digest_runs(docs, id_col, text_col)
    level = materialise(first_runs(rows, keep), "first-runs")
    winners = merge_tree(level, keep).select(*ENTRY, "best", "group_size")
    # a row for each run and digest on this side, and only one run's rows of a digest on the other
    per_run = level.select("run", *ENTRY).join(winners, [*ENTRY])
    return rows.join(per_run, ["run", *ENTRY]).select("row", "id", "digest", "best", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, of any length; null counts as empty. Of equal texts the row with
    the largest (keep="min": smallest) id stays; a null id loses against any other. Of
    repeated rows (same id and text) exactly one is kept. An empty table gives no rows;
    other columns are not read.
    """
    return fates(docs, id_col, text_col, keep).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def copies_by_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """(id, digest, keep_id, rows): the id that stays for each id and text (digest: lower-case hex), and the rows that have both."""
    own = fates(docs, id_col, text_col, keep).groupBy("id", "digest").agg(F.first("best.id").alias("keep_id"), F.count("*").alias("rows"))
    return own.withColumn("digest", F.lower(F.hex("digest")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that exact_dedup keeps, all their columns as they are, whatever these are called (of rows equal in id and text any one).

    A null text equals an empty one, a null id loses against any other, and an empty table gives no rows.
    """
    names = docs.columns
    docs, (id_col, text_col) = by_place(docs, id_col, text_col)
    own = materialise(copies_by_id(docs, id_col, text_col, keep).where(F.col("id").eqNullSafe(F.col("keep_id"))), "keepers")
    winners = own.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("rows").alias("__rows"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest_of_row") == F.col("__digest"))
    marked = docs.withColumn("__digest_of_row", F.sha2(with_defaults(text_col).cast("binary"), 256))
    single = marked.join(winners, same, "left_semi")
    if own.where("rows > 1").isEmpty():
        return single.drop("__digest_of_row").toDF(*names)
    # rows repeated with id and text: one of them
    single = marked.join(winners.where("__rows = 1"), same, "left_semi")
    repeated = marked.join(winners.where("__rows > 1"), same, "left_semi").dropDuplicates([id_col, "__digest_of_row"])
    return single.unionByName(repeated).drop("__digest_of_row").toDF(*names)
