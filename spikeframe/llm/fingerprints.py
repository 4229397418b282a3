"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch holds the k smallest distinct hashes of a text's shingles (five words).
Sketches of parts merge into the sketch of the whole, and two sketches give
estimates of resemblance and containment; one alone of the distinct count.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise, shingle_hashes, with_defaults

K, WIDTH = 256, 5
#: Text bytes that one bucket of the id order holds, about, the fewest buckets, and the most: their first rows
#: are broadcast (40 MB at the most). Above 2 TB of text buckets grow, to 100 MB at 100 TB.
BUCKET_BYTES, MIN_BUCKETS, MAX_BUCKETS = 2 << 20, 32, 1_000_000
#: Quantiles of the ids that buckets are cut at; between two of them buckets are even steps of ids.
CUTS = 1000
#: A row repeated to more than this share of the table is one row in the order, its copies are made apart.
HOT_ROWS = 1000


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: str | Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text, ascending; empty for a null text or one without words."""
    return bottom(shingle_hashes(text, width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what a and b were made from."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, by: list[str], col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: the k smallest distinct hashes of all its parts.

    Parts are first reduced by a salt, so that no task meets all of a large group.
    """
    salted = sketches.select(*by, F.explode(col).alias("hash")).distinct().withColumn("salt", F.pmod("hash", F.lit(64)))

    def least(df: DataFrame, keys: list[str]) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
        return df.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")

    return least(least(salted, [*by, "salt"]), by).groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias(col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; 1 for two empty sketches."""

    def of(union: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(union), F.lit(1)))

    return let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    rank = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / rank)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def as_text(a: Column) -> Column:
    """Hexadecimal digits, 16 for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


@dataclass(frozen=True)
class Order:
    """How rows in descending order of ids, null last, and of a hash of the text (tie) are cut into buckets.

    cuts: ids, ascending, at equal shares of the rows; an id that has the share of several cuts is
    in the list as often. Between two cuts there are ``steps`` buckets, even in the ids between, or
    in the ties where one id is all there is. The list has CUTS entries at most, the buckets grow with the table.
    """

    cuts: list[int]
    steps: int
    null_steps: int
    ends: tuple[int | None, int | None]

    @classmethod
    def of(cls, docs: DataFrame, id_col: str, text_col: str) -> Order:
        at = [i / CUTS for i in range(1, CUTS)]
        seen = docs.agg(
            F.sum(F.octet_length(text_col)).alias("bytes"),
            F.sum(F.when(F.col(id_col).isNull(), F.octet_length(text_col))).alias("null_bytes"),
            F.percentile_approx(id_col, at, 20 * CUTS).alias("cuts"),
            F.min(id_col).alias("least"),
            F.max(id_col).alias("most"),
        ).first()
        size = max(BUCKET_BYTES, (seen.bytes or 0) / MAX_BUCKETS)
        buckets = max(MIN_BUCKETS, math.ceil((seen.bytes or 0) / size))
        every = max(1, CUTS // buckets)
        cuts = (seen.cuts or [])[every - 1 :: every]
        return cls(cuts, max(1, math.ceil(buckets / (len(cuts) + 1))), max(1, math.ceil((seen.null_bytes or 0) / size)), (seen.least, seen.most))

    def _between(self, share: Column, steps: Column | int) -> Column:
        """The step, 0 to steps - 1, of a share between 0 and 1."""
        steps = steps if isinstance(steps, Column) else F.lit(steps)
        return F.least(F.floor(share * steps), steps - 1).cast("long")

    def bucket(self, value: Column, tie: Column) -> Column:
        """Ascending from the first row on: the larger the id, and of equal ids the tie, the smaller the bucket."""
        even = tie.cast("double") / 2.0**64 + 0.5
        last = (len(self.cuts) + 1) * self.steps
        of_null = last + self.null_steps - 1 - self._between(even, self.null_steps)
        if not self.cuts:
            return F.when(value.isNull(), of_null).otherwise(last - 1 - self._between(even, self.steps))
        edges = F.from_json(F.lit(json.dumps([*self.cuts])), "array<bigint>")

        def placed(e: Column) -> Column:
            first = F.size(F.filter(e, lambda c: c < value))
            upto = F.size(F.filter(e, lambda c: c <= value))
            ends = [F.lit(x).cast("double") for x in self.ends]
            low, high = F.coalesce(F.get(e, first - 1).cast("double"), ends[0]), F.coalesce(F.get(e, first).cast("double"), ends[1])
            inside = F.coalesce((value.cast("double") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
            # an id that is itself a cut begins the part after it; of several cuts its rows go by ties through the parts between
            own = F.when(upto - first > 1, (first + 1) * self.steps + self._between(even, (upto - first - 1) * self.steps)).otherwise(upto * self.steps)
            return last - 1 - F.when(upto > first, own).otherwise(first * self.steps + self._between(inside, self.steps))

        return F.when(value.isNull(), of_null).otherwise(let(edges, placed))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry=None) -> DataFrame:
    """docs' id, text and ``carry(text)`` with the same of the next row in descending order of ids.

    After the last row comes the first. Rows of equal id follow by a hash of the text,
    null ids come last. The order is cut into buckets; the first row of each bucket also goes to the
    bucket before, so that one shuffle is enough. Ids are integers.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer column")
    carry = carry or (lambda _: F.lit(None))
    order = Order.of(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), with_defaults(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("bucket", order.bucket(F.col("id"), F.col("tie")))
    keys = materialise(rows.groupBy("bucket", "id", "tie").agg(F.count("*").alias("n")), "id-order")
    # one row for each bucket
    heads = materialise(keys.groupBy("bucket").agg(F.max(F.struct(F.col("id").isNotNull().alias("there"), "id", "tie")).alias("head")), "heads")
    around = Window.orderBy("bucket")
    last = heads.agg(F.max("bucket")).first()[0]
    firsts = heads.select(F.coalesce(F.lag("bucket").over(around), F.lit(last)).alias("goes_to"), F.col("head.id").alias("head_id"), F.col("head.tie").alias("head_tie"))
    # a row repeated so often that it makes up a large share: at most HOT_ROWS of them
    total = docs.count()
    hot = keys.where((F.col("n") > 1) & (F.col("n") * HOT_ROWS > total)).select(F.col("id").alias("hot_id"), F.col("tie").alias("hot_tie"), "n")
    more = None
    if not hot.isEmpty():
        is_hot = F.col("id").eqNullSafe(F.col("hot_id")) & (F.col("tie") == F.col("hot_tie"))
        ones = rows.join(F.broadcast(hot), is_hot).groupBy("id", "tie", "bucket", "n").agg(F.first("text").alias("text"))
        ones = materialise(ones, "repeated-rows")
        rows = rows.join(F.broadcast(hot), is_hot, "left_anti").unionByName(ones.drop("n"))
        # of n equal rows all but the last have their like as the next one
        left = F.col("n") - 1
        thousands = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((left - 1) / 1000)), lambda k: F.least(F.lit(1000).cast("long"), left - k * 1000))
        copies = ones.withColumn("some", F.explode(thousands)).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("some"))))
        more = copies.withColumn("made", carry(F.col("text"))).select("id", "text", "made", F.col("text").alias("next_text"), F.col("made").alias("next_made"))
    found = rows.join(F.broadcast(firsts), F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("goes_to").alias("bucket"), F.lit(True).alias("guest"))
    placed = found.select("id", "text", "tie", F.explode(F.when(F.col("goes_to").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at"))
    placed = placed.select("id", "text", "tie", "at.bucket", "at.guest").repartition("bucket").withColumn("made", carry(F.col("text")))
    inside = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.col("tie").desc())
    after = placed.withColumns({"next_text": F.lead("text").over(inside), "next_made": F.lead("made").over(inside)})
    out = after.where("not guest").select("id", "text", "made", "next_text", "next_made")
    return out if more is None else out.unionByName(more)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness.

    The edited form has the last third of the code points replaced by the first as many
    (or all) of the next document in descending order of ids (integers). A null text counts as
    empty, an empty one has an empty fingerprint; the likeness of two empty ones is 1. Texts are read
    whole, however long. Every row of repeated ids or texts gives a row. Other columns are not read. An
    empty table gives no rows.
    """
    rows = with_next(docs, id_col, text_col, lambda t: sketch(t, k))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - cut), F.left("next_text", cut)))
    out = rows.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("made"),
        F.col("next_made"),
        sketch("edited", k).alias("edited_made"),
    )
    return out.select(
        id_col,
        "n_chars",
        "edited_sha256",
        as_text(F.col("made")).alias("fingerprint"),
        as_text(F.col("edited_made")).alias("edited_fingerprint"),
        resemblance(F.col("made"), F.col("edited_made"), k).alias("near_edited"),
        resemblance(F.col("made"), F.col("next_made"), k).alias("near_next"),
    )
