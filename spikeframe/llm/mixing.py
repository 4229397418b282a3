"""Mixing sources to target weights, to the exact word.

Every row gets a random key by a hash of its id. A range sort by (source, key)
deals the rows out in order; words before a row are a prefix sum within its part
plus the sums of the source's earlier parts, so that a source of any size is cut
at its budget without meeting in one task. Only ids, sources and sizes move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, by_place, materialise, prefix_sums, with_defaults

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS, SEED = 1.5, 2, "mix-1"
#: Tasks that the rows of one repeated document are dealt to.
SALTS = 64


def word_count(text: str | Column) -> Column:
    return F.regexp_count(with_defaults(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size) -> with target double, one row per source.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all words. A target stops at ``epochs`` times its source's size
    and the excess goes to the others by weight. That is one level L for all: the
    target is min(cap, weight * L), found by going through the sources by cap per
    weight. Turns and sums are prefix sums over range-sorted parts, for any number of sources.
    """
    turned = prefix_sums(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "mix-turns", turn=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int")).cast("long")
    table = turned.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    table = prefix_sums(table, [F.col("ratio"), F.col("turn")], "mix-levels", caps=F.col("cap"), heavier=F.col("weight"))
    total = sizes.agg(F.sum("source_size").alias("n")).first().n or 0
    weighed = table.agg(F.sum("weight").alias("n")).first().n or 0
    level = (F.lit(total) * F.lit(share) - F.col("caps")) / (F.lit(weighed) - F.col("heavier"))
    # the first source that stays under its cap sets the level of all after it
    fits = table.withColumn("level", level).where(F.col("cap") >= F.col("weight") * F.col("level"))
    first = fits.agg(F.min(F.struct("ratio", "turn", "level")).alias("x")).first().x
    target = F.col("cap").cast("double")
    if first:
        after = F.struct("ratio", "turn") >= F.struct(F.lit(first.ratio), F.lit(first.turn).cast("long"))
        target = F.when(after, F.col("weight") * F.lit(first.level)).otherwise(target)
    return table.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, fingerprint: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, before, fingerprint.

    size counts words of the whole text; a null one has none. taken is what the mix takes of the row's
    words, epochs counted: the whole passes that the source's target holds, and in the
    last pass the words up to the exact budget (the row at the cut gives its first
    words). The order depends on the ids alone, so reruns agree; equal ids follow by
    fingerprint (a hash of the text unless another is given), and repeated rows share what falls to them
    in any order. Null sources are a source, sources without words have target 0. Other columns are
    not read. An empty table gives no rows.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        (F.xxhash64(with_defaults(text_col)) if fingerprint is None else fingerprint).alias("fingerprint"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("key"),
    )
    # written before it is sorted: sampling for the ranges would count the words of every text once more
    sized = materialise(sized, "mix-sizes")
    order = ("key", "doc_id", "fingerprint")
    dealt = sized.repartitionByRange(F.col("source").asc_nulls_last(), *order)
    rows = materialise(dealt.withColumn("part", F.spark_partition_id()), "mix-sorted")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plan = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, epochs)
    plan = plan.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.source", "p.part", "offset", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.alias("r").join(plan.alias("p"), (F.col("r.part") == F.col("p.part")) & F.col("r.source").eqNullSafe(F.col("p.source")))
    out = joined.select("doc_id", "r.source", "size", "source_size", "target", (F.col("offset") + F.col("inner")).alias("before"), "fingerprint")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("passes", whole).withColumn("rest", budget - F.col("passes") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return out.withColumn("last", last).withColumn("taken", F.col("passes") * F.col("size") + F.col("last"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **how) -> DataFrame:
    """The rows of the mix with the columns of docs: a row for each pass that takes the document.

    A document that the cut shortens keeps the words before the cut, and its
    length_col (if docs has one) follows. Rows are found again by id, source and a hash of all their
    columns (but maps); rows that agree in these are the same row repeated. Columns keep their values, whatever they are called.
    A null or empty text has no words and is never taken; null sources are one source, and an empty table gives no rows.
    """
    names = docs.columns
    docs, (id_col, text_col, source_col) = by_place(docs, id_col, text_col, source_col)
    length_col = docs.columns[names.index(length_col)] if length_col in names else None
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    keys = ("__id", "__source", "__print")
    plan = mix(docs, id_col, text_col, source_col, fingerprint=hashed, **how).where("taken > 0")
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("fingerprint").alias("__print"), F.col("before").alias("__before"), F.col("passes").alias("__passes"), F.col("last").alias("__last"), F.col("size").alias("__size"))
    plan = materialise(plan, "mix-plan")
    rows = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col), "__print": hashed})
    same = lambda left, right, keys: [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    wanted = [F.col(f"d.`{c}`") for c in docs.columns] + [F.col(f"p.{c}") for c in ("__passes", "__last", "__size")]
    often = plan.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    if often.isEmpty():
        taken = rows.alias("d").join(plan.alias("p"), same("d", "p", keys)).select(*wanted)
    else:
        # rows repeated in all columns: one of them stands for all, with the plan's rows dealt to SALTS tasks
        often = materialise(often.select(*keys), "mix-repeated")
        once = plan.alias("p").join(often.alias("o"), same("p", "o", keys), "left_anti")
        more = plan.alias("p").join(often.alias("o"), same("p", "o", keys), "left_semi").withColumn("__salt", F.pmod(F.xxhash64("__before"), F.lit(SALTS)).cast("int"))
        one = rows.alias("d").join(often.alias("o"), same("d", "o", keys), "left_semi").dropDuplicates([*keys])
        one = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        taken = rows.alias("d").join(once.alias("p"), same("d", "p", keys)).select(*wanted)
        taken = taken.unionByName(one.alias("d").join(more.alias("p"), same("d", "p", (*keys, "__salt"))).select(*wanted))
    passes = F.concat(F.array_repeat(F.col("__size"), F.col("__passes").cast("int")), F.when(F.col("__last") > 0, F.array(F.col("__last"))).otherwise(F.array().cast("array<bigint>")))
    taken = taken.withColumn("__words", F.explode(passes))
    cut = F.when(F.col("__words") >= F.col("__size"), F.col(text_col)).otherwise(first_words(F.col(text_col), F.col("__words")))
    out = taken.withColumns({text_col: cut})
    if length_col:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns).toDF(*names)


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word, what stands between the words as it is."""
    pieces = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")
