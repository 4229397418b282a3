"""Near-duplicate documents by circulant MinHash, banding and exact verification.

One permutation spreads the shingles over 2^32 places; a second one, shifted circularly by
0, 1, 2, ... places, gives all coordinates of a signature. Bands of a signature name
buckets. In a bucket signatures are compared first; of documents that have a partner there
the full shingle sets follow, and pairs are confirmed on them unless the links found
so far already join them: what leaves a bucket is a forest of confirmed links, never
all pairs. A pair is looked at in the first band alone that it shares.

Large buckets are dealt out as blocks, and a few members of the bucket visit every block. Mostly
that joins a bucket to one component. Where it does not, the documents outside the bucket's largest
component meet all the others, block by block; documents of one component meet no more.

Bands and the demand of equal coordinates follow from the threshold (banding). At 0.85,
25 bands of 5 miss a pair with a chance of 4e-7 and the demand of 86 equal coordinates
adds 1.4e-6; at 0.80 it is 28 bands of 4 (4e-7) and 77 (6e-7); above a threshold far less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, materialise

WIDTH, COORDS = 5, 125
#: Links hold from this share (in hundredths) of shared shingles on: op10's, and what copies are dropped by.
PERCENT, DROP_PERCENT = 85, 80
#: The chances that a link at the threshold may be missed with, by the bands and by the demand of equal coordinates.
MISS_BANDS, MISS_AGREE = 5e-7, 1.5e-6
#: Documents in a block of a large bucket, members of the bucket that visit every block, and documents
#: in a block where blocks of open buckets meet.
BLOCK, VISITORS, MEETING = 160, 16, 400
#: A key with more than this share of all rows is joined by broadcast: there are at most so many.
HOT_KEYS = 1000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def banding(percent: int) -> tuple[int, int, int]:
    """(bands, rows, agree) for a threshold: the longest bands, then the fewest, and the largest demand within the chances above."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be 1 to 100")
    p = percent / 100
    for rows in range(COORDS, 0, -1):
        missed = 1 - p**rows
        bands = ceil(log(MISS_BANDS) / log(missed)) if missed > 0 else 1
        if bands * rows <= COORDS:
            break
    else:
        raise ValueError(f"{COORDS} coordinates are too few for links at {percent} %")
    agree, below = 0, 0.0
    while agree < COORDS and (below := below + comb(COORDS, agree) * p**agree * (1 - p) ** (COORDS - agree)) <= MISS_AGREE:
        agree += 1
    return bands, rows, agree


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words (A-Z lower-cased); of fewer words, of all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(width, len(words))
    rolled = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        rolled = rolled * _STEP + hashes[k : len(words) - n + 1 + k]
    rolled ^= rolled >> np.uint64(32)
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    rolled ^= rolled >> np.uint64(32)
    return np.unique(rolled)


#: Multipliers of the two permutations of the 32-bit numbers.
_FIRST, _SECOND = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)), (np.uint32(0x9E3779B1), np.uint32(0x27D4EB2F))


def _permute(x: np.ndarray, by: tuple[np.uint32, np.uint32]) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place; different multipliers give different ones."""
    x ^= x >> np.uint32(16)
    x *= by[0]
    x ^= x >> np.uint32(13)
    x *= by[1]
    x ^= x >> np.uint32(16)
    return x


_SHIFTS = np.arange(COORDS, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, chunk: int = 512) -> np.ndarray:
    """COORDS coordinates: low 16 bits of the least place under the second permutation, shifted by each number of places."""
    places = _permute((shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32), _FIRST)
    least = np.full(COORDS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(places), chunk):
        shifted = _permute(places[None, at : at + chunk] + _SHIFTS, _SECOND)
        np.minimum(least, shifted.min(axis=1), out=least)
    return (least & np.uint32(0xFFFF)).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, tags, signs = [], [], []
        for text in batch.column(2):
            own = shingle_set(text.as_py())
            sizes.append(len(own))
            tags.append(xxhash.xxh3_128_digest(own.tobytes()))
            signs.append(signature(own).tobytes() if len(own) else None)
        made = [pa.array(sizes, pa.int64()), pa.array(tags, pa.binary()), pa.array(signs, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "print", "size", "tag", "sign"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.large_binary()).cast(pa.binary())], names=["tag", "shingles"])


class Forest:
    """Union-find over positions 0 to n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets share at least ``percent`` hundredths of their union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return (100 + percent) * shared >= percent * (len(a) + len(b))


class Part:
    """The documents of one part (bucket, p, q), each tag once and in order, and their pairs of like signatures.

    In a part of one block (p = q) all documents meet, else those of one side (0) the other's (1);
    documents that share a label or an earlier band never do.
    """

    def __init__(self, table: pa.Table, percent: int):
        tags = table.column("tag").to_pylist()
        first = dict(zip(reversed(tags), reversed(range(len(tags)))))
        self.rows = [first[t] for t in sorted(first)]
        self.tags = sorted(first)
        of = lambda name: [x for x in table.column(name).take(pa.array(self.rows)).to_pylist()]
        self.labels = of("label")
        ids = {x: k for k, x in enumerate(dict.fromkeys(self.labels))}
        label, size, side = (np.array(x) for x in ([ids[x] for x in self.labels], of("size"), of("side")))
        signs = np.frombuffer(b"".join(of("sign")), dtype=np.uint16).reshape(-1, COORDS)
        band, one = table.column("band")[0].as_py(), table.column("p")[0].as_py() == table.column("q")[0].as_py()
        _, rows, least = banding(percent)
        left, right, scores = [], [], []
        for i in range(len(self.tags) - 1):
            others = np.arange(i + 1, len(self.tags))
            fit = (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])) & (label[others] != label[i])
            if not one:
                fit &= side[others] != side[i]
            others = others[fit]
            same = signs[others] == signs[i]
            agree = same.sum(axis=1)
            keep = agree >= least
            if band:
                keep &= ~same[:, : band * rows].reshape(len(others), band, rows).all(axis=2).any(axis=1)
            left.append(np.full(int(keep.sum()), i))
            right.append(others[keep])
            scores.append(agree[keep])
        none = np.empty(0, dtype=np.int64)
        self.left, self.right = np.concatenate([none, *left]), np.concatenate([none, *right])
        best = np.argsort(-np.concatenate([none, *scores]), kind="stable")
        self.left, self.right = self.left[best], self.right[best]
        self.group = label


def _alike(percent: int) -> Callable[[pa.Table], pa.Table]:
    """A function of a part: its rows that have a partner of like signature."""

    def alike(table: pa.Table) -> pa.Table:
        part = Part(table, percent)
        have = np.unique(np.concatenate([part.left, part.right]))
        return table.take(pa.array([part.rows[i] for i in have.tolist()], pa.int64()))

    return alike


def _links(percent: int) -> Callable[[pa.Table], pa.Table]:
    """A function of a part with sets: its confirmed links, a forest, as pairs of labels."""

    def links(table: pa.Table) -> pa.Table:
        part = Part(table, percent)
        shingles = table.column("shingles")
        sets = [np.frombuffer(shingles[i].as_py(), dtype=np.uint64) for i in part.rows]
        forest, found = Forest(len(part.labels)), []
        group = part.group.tolist()
        for i, j in zip(part.left.tolist(), part.right.tolist(), strict=True):
            a, b = forest.root(group[i]), forest.root(group[j])
            if a != b and linked(sets[i], sets[j], percent):
                forest.up[max(a, b)] = min(a, b)
                found.append((part.labels[i], part.labels[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return links


def _buckets(nodes: DataFrame, percent: int) -> DataFrame:
    """(tag, bucket, band, members) of buckets with several documents; of buckets with the same documents the first band's."""
    count, width, _ = banding(percent)
    step = 2 * width
    bands = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.struct(b.cast("tinyint").alias("band"), F.xxhash64(b, F.substring(F.col("sign"), b * step + 1, F.lit(step))).alias("bucket")))
    rows = nodes.select("tag", F.explode(bands).alias("x")).select("tag", "x.band", "x.bucket")
    mark = F.shiftrightunsigned(F.xxhash64("tag"), 8)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.sum(mark.cast("decimal(20,0)")).alias("who"), F.min("band").alias("band"))
    first = sizes.where("members > 1").groupBy("members", "who").agg(F.min(F.struct("band", "bucket")).alias("x"))
    return rows.drop("band").join(first.select("members", "x.bucket", "x.band"), "bucket")


def _dealt(members: DataFrame) -> DataFrame:
    """(tag, bucket, band, p, q, side, label): the parts in which members meet first: blocks with their visitors."""
    rows = members.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    own = rows.select("tag", "bucket", "band", F.pmod(F.xxhash64("tag"), F.col("blocks")).cast("int").alias("p"))
    few = [F.min(F.when(F.pmod(F.xxhash64(F.lit("visitor"), "tag"), F.lit(VISITORS)) == k, F.col("tag"))) for k in range(VISITORS)]
    chosen = rows.where("blocks > 1").groupBy("bucket", "band", "blocks").agg(F.array_compact(F.array(*few)).alias("tags"))
    guests = chosen.select("bucket", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"), "tags").select(F.explode("tags").alias("tag"), "bucket", "band", "p")
    return own.unionByName(guests).select("tag", "bucket", "band", "p", F.col("p").alias("q"), F.lit(0).alias("side"), F.col("tag").alias("label"))


def _dealt_again(members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """The same for large buckets of several components: what is outside the largest one meets all, block by block."""
    large = members.where(F.col("members") > BLOCK)
    if large.isEmpty():
        return None
    known = large.select("tag", "bucket", "band").join(labels, "tag", "left")
    known = materialise(known.select("tag", "bucket", "band", F.coalesce("label.tag", "tag").alias("label")), "large-buckets")
    kinds = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    tops = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where("kinds > 1")
    blocks = lambda n: F.ceil(n / MEETING).cast("int")
    tops = materialise(tops.select("bucket", F.col("top.label").alias("main"), blocks(F.col("n") - F.col("top.n")).alias("rest"), blocks(F.col("top.n")).alias("most")), "open-buckets")
    if tops.isEmpty():
        return None
    rows = known.join(tops, "bucket").withColumn("inside", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("tag"), F.when(F.col("inside"), F.col("most")).otherwise(F.col("rest"))).cast("int")
    rows = rows.withColumn("own", own)
    part = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))
    count = lambda n: F.sequence(F.lit(0), n - 1)
    main = F.transform(count(F.col("rest")), lambda i: part(i, F.col("rest") + F.col("own"), F.lit(1)))
    with_main = F.transform(count(F.col("most")), lambda j: part(F.col("own"), F.col("rest") + j, F.lit(0)))
    with_rest = F.transform(count(F.col("rest")), lambda k: part(F.least("own", k), F.greatest("own", k), (F.col("own") > k)))
    parts = F.when(F.col("inside"), main).otherwise(F.concat(with_main, with_rest))
    return rows.select("tag", "bucket", "band", "label", F.explode(parts).alias("x")).select("tag", "bucket", "band", "x.p", "x.q", "x.side", "label")


PART_COLUMNS = "tag binary, bucket long, band int, p int, q int, side int, label binary, size long, sign binary"


def _alike_in(dealt: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of what was dealt to parts the rows with a partner of like signature there (PART_COLUMNS), as a written table."""
    signed = dealt.join(nodes.select("tag", "size", "sign"), "tag").select("tag", "bucket", F.col("band").cast("int").alias("band"), "p", "q", "side", "label", "size", "sign")
    return materialise(signed.groupBy("bucket", "p", "q").applyInArrow(_alike(percent), PART_COLUMNS), "alike")


def _repeated(sketches: DataFrame) -> DataFrame | None:
    """(often_id, often_print) of the rows, equal in both, that make up more than one in HOT_KEYS: fewer than HOT_KEYS; None if there are none."""
    total = sketches.count()
    often = sketches.groupBy("id", "print").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") * HOT_KEYS > total))
    often = materialise(often.select(F.col("id").alias("often_id"), F.col("print").alias("often_print")), "repeated")
    return None if often.isEmpty() else often


def _sets_of(tags: DataFrame, nodes: DataFrame, text: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """(tag, shingles): the full sets of these tags, each from one text that has it, as a written table; often: what _repeated returns."""
    wanted = tags.join(nodes, "tag").select("tag", F.col("id").alias("own"), F.col("print").alias("own_print"))
    same = F.col("id").eqNullSafe(F.col("own")) & (F.col("print") == F.col("own_print"))
    found = text.join(wanted, same).select("tag", "text")
    if often is not None:
        # a row that is repeated very often: its texts become one in each task before they meet
        of = F.col("id").eqNullSafe(F.col("often_id")) & (F.col("print") == F.col("often_print"))
        one = text.join(F.broadcast(often), of, "left_semi").groupBy("id", "print").agg(F.first("text").alias("text"))
        found = text.join(F.broadcast(often), of, "left_anti").join(wanted, same).select("tag", "text").unionByName(one.join(wanted, same).select("tag", "text"))
    sets = materialise(found.mapInArrow(_sets, "tag binary, shingles binary"), "sets")
    # rows repeated with id and text give theirs more than once
    return sets.dropDuplicates(["tag"]) if sets.count() > wanted.count() else sets


def _confirmed(alike: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the labels of the parts' rows, as a written table."""
    held = alike.join(sets, "tag")
    return materialise(held.groupBy("bucket", "p", "q").applyInArrow(_links(percent), "a binary, b binary"), "edges")


def _join_hot(rows: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    """rows left joined with table (key, value; a row for each key) where some keys have a large share of the n rows.

    Keys with more than n / HOT_KEYS rows number at most HOT_KEYS: they are sent to all tasks,
    and only rows of other keys are dealt by key.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(n // HOT_KEYS, 1)).select(F.col(key).alias("__hot"))
    hot = materialise(hot.join(table, F.col("__hot") == table[key]).select("__hot", "value"), "hot-keys")
    is_hot = F.col(key) == F.col("__hot")
    often = rows.join(F.broadcast(hot), is_hot).drop("__hot")
    seldom = rows.join(F.broadcast(hot.select("__hot")), is_hot, "left_anti").join(table, key, "left")
    return often.unionByName(seldom)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tag, label): the least node of each component; edges (a, b) of tags, nodes (tag, node).

    Labels take the least of their neighbours' and then their label's label, until none
    changes; every round is a written table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    touched = both.select(F.col("a").alias("tag")).distinct()
    labels = materialise(nodes.join(touched, "tag").select("tag", F.col("node").alias("label")), "labels")
    n = labels.count()
    while n:
        near = both.join(labels.select(F.col("tag").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.tag == near.a).select("tag", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        least = materialise(least.withColumn("to", F.col("label.tag")), "nearest")
        if least.where("was <> label").isEmpty():
            break
        # each label's own label
        jumped = _join_hot(least, least.select(F.col("tag").alias("to"), F.col("label").alias("value")), "to", n)
        labels = materialise(jumped.select("tag", F.least("label", F.coalesce("value", "label")).alias("label")), "labels")
    return labels


def _labelled(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, print, size, tag, value), one row for each of docs; value: the least node (id, tag) of its component, null without a set."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    sketches = materialise(text.mapInArrow(_sketch, f"id {kind}, print long, size long, tag binary, sign binary"), "sketches")
    # of equal sets the least id, and of its texts one
    best = F.min(F.struct(F.col("id").isNull().alias("missing"), F.col("id").cast("long").alias("id"), "print"))
    nodes = sketches.where("size > 0").groupBy("tag").agg(best.alias("best"), F.first("sign").alias("sign"), F.first("size").alias("size"))
    nodes = materialise(nodes.select("tag", "best.id", "best.print", "sign", "size", F.struct("best.missing", "best.id", "tag").alias("node")), "nodes")
    members = materialise(_buckets(nodes, percent), "buckets")
    alike = _alike_in(_dealt(members), nodes, percent)
    # texts move once: members of large buckets may be needed when their blocks meet
    wanted = alike.select("tag").union(members.where(F.col("members") > BLOCK).select("tag")).distinct()
    sets = _sets_of(wanted, nodes, text, _repeated(sketches))
    labels = components(_confirmed(alike, sets, percent), nodes.select("tag", "node"))
    again = _dealt_again(members, labels)
    if again is not None:
        more = components(_confirmed(_alike_in(again, nodes, percent), sets, percent), nodes.select("tag", "node"))
        # labels of the first round are the nodes of the second
        whole = nodes.select("tag", "node").join(labels, "tag", "left").select("tag", F.coalesce("label", "node").alias("label")).withColumn("to", F.col("label.tag"))
        moved = _join_hot(whole, more.select(F.col("tag").alias("to"), F.col("label").alias("value")), "to", nodes.count())
        labels = materialise(moved.select("tag", F.coalesce("value", "label").alias("label")), "labels")
    named = nodes.select("tag", "node").join(labels, "tag", "left").select("tag", F.coalesce("label", "node").alias("value"))
    rows = sketches.where("size > 0").select("id", "print", "size", "tag")
    none = sketches.where("size = 0").select("id", "print", "size", "tag", F.lit(None).cast(named.schema["value"].dataType).alias("value"))
    return _join_hot(rows, named, "tag", sketches.count()).select("id", "print", "size", "tag", "value").unionByName(none)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are runs of characters other than white space, A-Z lower-cased; a document's
    set are its distinct runs of five words, or all its words as one, of the whole text however
    long. Documents whose sets share at least ``percent`` % are linked; component_id is the smallest
    id (an integer) that links reach. A null, empty or blank text has no set and no links. Null ids count
    as larger than any and give a null component_id where there is no other; repeated rows share
    theirs. Other columns are not read. An empty table gives no rows.
    """
    rows = _labelled(docs, id_col, text_col, percent)
    label = F.when(F.col("value").isNull(), F.col("id").cast("long")).otherwise(F.col("value.id"))
    out = rows.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), label.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = DROP_PERCENT) -> DataFrame:
    """The rows of docs that are their component's first by id (null last), all their columns as they are.

    Documents are linked from ``percent`` % of shared five-word runs on, by default 80, where near_components takes 85.
    Texts without words all stay. Of a component one set of runs stays: rows that share it and the
    id, such as repeated rows, stay together. Columns keep their values, whatever they are called; an empty table gives no rows.
    """
    names = docs.columns
    docs, (id_col, text_col) = by_place(docs, id_col, text_col)
    rows = _labelled(docs, id_col, text_col, percent)
    first = (F.col("value.tag") == F.col("tag")) & F.col("id").cast("long").eqNullSafe(F.col("value.id"))
    kept = rows.where(F.col("value").isNull() | first).select(F.col("id").alias("__id"), F.col("print").alias("__print")).distinct()
    marked = docs.withColumn("__print_of_row", F.xxhash64(text_col))
    return marked.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__print_of_row") == F.col("__print")), "left_semi").drop("__print_of_row").toDF(*names)
