"""Approximate nearest neighbours by multi-index hashing.

A vector's code is the signs of BITS of its coordinates after a rotation, learned so that coordinates lie
far from 0. The code is cut into PARTS substrings, each with an index of its own. Two codes that differ in
at most r bits differ in at most r // PARTS bits of some substring, so a probe of each index with that smaller radius
finds every code within r; those are compared in full, and by their vectors.

The radius comes from the query: two vectors at an angle differ in a share angle / pi of their bits, so one
that is no farther than the fifth known so far lies, up to MARGIN deviations, within a radius. The fifth known comes
from a sample first, then from a search with a small radius; only queries whose radius is larger search again, and those that
find fewer than five then look at every code.

An index is dealt to cells by the leading CELL_BITS bits of its substring. A query goes to the cells that
its substring radius reaches, and there to every block of up to BLOCK codes; where the radius reaches all cells
of an index, the query goes to one index only. Equal vectors are one entry of an index with the smallest
of their ids, so that copies meet no query one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, meet

BITS, PARTS, CELL_BITS = 64, 4, 6
WIDTH = BITS // PARTS
#: Codes of a cell, and queries, that one task holds together.
BLOCK = 1 << 13
#: Vectors that the rotation is learned from and that give the first bound, at most about this many.
SAMPLE_ROWS = 4000
#: Radius of the first search, and deviations that the radius is wider than an angle's mean.
FIRST_RADIUS, MARGIN = 11, 2.0


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v), written: the rows that have an id and a vector that isn't null, zero, or with null or non-finite components."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return materialise(rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)), "vectors")


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(entry, v, n, members), written: equal vectors once, with the k + 1 smallest (id, row) of them; entry: the smallest row."""
    # minus zero and zero are equal; what arrays of doubles group by is their bytes
    same = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("bag", F.pmod(F.xxhash64("row"), F.lit(64)))
    smallest = lambda col: F.slice(F.array_sort(col), 1, k + 1)
    bags = same.groupBy("v", "bag").agg(smallest(F.collect_list(F.struct("id", "row"))).alias("members"), F.count("*").alias("n"), F.min("row").alias("entry"))
    whole = bags.groupBy("v").agg(smallest(F.flatten(F.collect_list("members"))).alias("members"), F.sum("n").alias("n"), F.min("entry").alias("entry"))
    return materialise(whole.select("entry", "v", "n", "members"), "entries")


def learned_rotation(x: np.ndarray, dims: int, rounds: int = 30) -> np.ndarray:
    """(dims, BITS): columns of a rotation that brings the unit vectors x near the corners of a cube; short vectors get random ones behind it.

    In each round the signs are fixed and the rotation fits them best, then the other way around. Without vectors a random
    rotation stays. Seeded.
    """
    rng, cols = np.random.default_rng(20), []
    while sum(c.shape[1] for c in cols) < BITS:
        r = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(rounds if len(x) and not cols else 0):
            u, _, w = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
            r = u @ w
        cols.append(r)
    return np.hstack(cols)[:, :BITS]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their size; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row; the same pair gives the same number wherever it is computed."""
    fits = lambda z: (s := np.sqrt((z * z).sum(1))).min() > 1e-140 and s.max() < 1e140
    if len(x) and not (fits(x) and fits(y)):
        x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def radius_of(cos: np.ndarray) -> np.ndarray:
    """Bits that a code may differ in to be looked at, when what counts has a cosine of at least cos."""
    share = np.arccos(np.clip(cos, -1, 1)) / np.pi
    return np.minimum(BITS, np.floor(BITS * share + MARGIN * np.sqrt(BITS * share * (1 - share)))).astype(np.int64)


class Model:
    """Rotations by the vectors' size, and the sample that they were learned from."""

    def __init__(self, sample: list[np.ndarray]):
        self.sample: dict[int, np.ndarray] = {}
        for d in {len(v) for v in sample}:
            self.sample[d] = unit(np.stack([v for v in sample if len(v) == d]))
        self.rotation = {d: learned_rotation(x, d) for d, x in self.sample.items()}

    def codes(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        if d not in self.rotation:
            self.rotation[d] = learned_rotation(np.zeros((0, d)), d)
        bits = np.packbits(unit(x) @ self.rotation[d] > 0, axis=1)
        return np.ascontiguousarray(bits).view(">u8").ravel().astype(np.uint64)

    def bound(self, x: np.ndarray, k: int) -> np.ndarray:
        """A cosine that k + 1 of the sample reach (one of them may be the vector itself), -1 where it has no so many."""
        known = self.sample.get(x.shape[1], np.zeros((0, x.shape[1])))
        if len(known) <= k:
            return np.full(len(x), -1.0)
        at = len(known) - k - 1
        some = [np.partition(unit(x[i : i + 500]) @ known.T, at, axis=1)[:, at] for i in range(0, len(x), 500)]
        return np.concatenate([*some, np.zeros(0)]) - 1e-9


def fitted(rows: DataFrame) -> Model:
    """A model from about SAMPLE_ROWS entries, chosen by a hash; everything else looks at all entries."""
    n = max(1, rows.count())
    share = F.pmod(F.xxhash64(F.lit("sample"), "entry"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
    return Model([np.asarray(r.v) for r in rows.where(share).select("v").orderBy("v").limit(2 * SAMPLE_ROWS).collect()])


def _parts(codes: np.ndarray) -> np.ndarray:
    """(codes, PARTS): the substrings, the leading one first."""
    shifts = np.arange(BITS - WIDTH, -1, -WIDTH, dtype=np.uint64)
    return ((codes[:, None] >> shifts) & np.uint64((1 << WIDTH) - 1)).astype(np.uint16)


#: How many bits apart the numbers of two cells are.
_CELLS = np.arange(1 << CELL_BITS, dtype=np.uint16)
_APART = np.bitwise_count(_CELLS[:, None] ^ _CELLS)

def _by_size(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for _, part in pdf.groupby(pdf["v"].map(len), sort=False):
        yield part, np.stack(part["v"].to_numpy())


def coded(rows: DataFrame, model: Model, k: int) -> DataFrame:
    """(entry, v, size, code, bound), written: entries with their code and a cosine that k others of the sample reach."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, x in _by_size(pdf):
                asked, bound = part["queried"].to_numpy(dtype=bool), np.full(len(x), -1.0)
                bound[asked] = sent.value.bound(x[asked], k)
                yield part.assign(size=x.shape[1], code=sent.value.codes(x).astype(np.int64), bound=bound)

    made = rows.select("entry", "v", "queried").mapInPandas(task, "entry long, v array<double>, queried boolean, size int, code long, bound double")
    return materialise(made, "codes")


def _dealt(codes: DataFrame) -> DataFrame:
    """Each code once for each substring, in the cell where it lies."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = _parts(pdf["code"].to_numpy().astype(np.uint64)) >> (WIDTH - CELL_BITS)
            for j in range(PARTS):
                yield pdf.assign(part=j, cell=cells[:, j].astype(np.int32))

    return codes.select("entry", "v", "size", "code").mapInPandas(task, "entry long, v array<double>, size int, code long, part int, cell int")


def search(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, entry, score): for each query (entry, v, size, code, bound, radius) the best k + 1 entries within its radius.

    Entries below the query's bound are left out; its own entry counts as one.
    """
    dealt = _dealt(codes)
    sizes = materialise(dealt.groupBy("size", "part", "cell").agg(F.count("*").alias("n")), "cells")
    blocks = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select("size", "part", "cell", "blocks")
    # a size has PARTS * 2^CELL_BITS cells at most
    place = lambda df: df.join(blocks, ["size", "part", "cell"])
    held = place(dealt).select("size", "part", "cell", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int").alias("block"), "entry", "code", "v")

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = _parts(pdf["code"].to_numpy().astype(np.uint64)) >> (WIDTH - CELL_BITS)
            reach = pdf["radius"].to_numpy() // PARTS
            for j in range(PARTS):
                # where all cells are in reach, the first index has every code
                sent = (_APART[cells[:, j]] <= reach[:, None]) & ((reach < CELL_BITS) | (j == 0))[:, None]
                at, cell = np.nonzero(sent)
                for i in range(0, len(at), BLOCK):
                    yield pdf.iloc[at[i : i + BLOCK]].assign(part=j, cell=cell[i : i + BLOCK].astype(np.int32))

    cols = "entry long, v array<double>, size int, code long, bound double, radius int"
    going = queries.select("entry", "v", "size", "code", "bound", "radius").mapInPandas(visits, cols + ", part int, cell int")
    qblocks = max(1, -(-queries.count() // BLOCK))
    going = place(going).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("qblock", F.pmod(F.xxhash64(F.lit("q"), "entry"), F.lit(qblocks)).cast("int"))
    held = held.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1)))) if qblocks > 1 else held.withColumn("qblock", F.lit(0))
    keys = ["size", "part", "cell", "block", "qblock"]

    def probe(codes: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if codes.empty or asking.empty:
            return pd.DataFrame({"query": [], "entry": [], "score": []})
        return _probe(codes, asking, k)

    found = held.groupBy(*keys).cogroup(going.groupBy(*keys)).applyInPandas(probe, "query long, entry long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    return found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at")


#: Pairs of codes and queries that are looked at together.
PAIRS = 1 << 20


def _probe(codes: pd.DataFrame, asking: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k + 1 codes of a block for each query among those that its probe of the block's substring finds."""
    code, x = codes["code"].to_numpy().astype(np.uint64), np.stack(codes["v"].to_numpy())
    entry, j = codes["entry"].to_numpy(), int(codes["part"].iat[0])
    parts = _parts(code)
    # the index: the block's values of this substring, and the codes of each
    values, of = np.unique(parts[:, j], return_inverse=True)
    length = np.sqrt((x * x).sum(1))
    flat = x / np.where(length > 0, length, 1)[:, None]
    out = []
    step = max(1, PAIRS // max(1, len(code)))
    for i in range(0, len(asking), step):
        some = asking.iloc[i : i + step]
        q, qcode, radius = np.stack(some["v"].to_numpy()), some["code"].to_numpy().astype(np.uint64), some["radius"].to_numpy()
        reach = radius // PARTS
        qparts = _parts(qcode)
        hit = (np.bitwise_count(qparts[:, j, None] ^ values) <= reach[:, None])[:, of]
        hit |= (reach >= CELL_BITS)[:, None]
        for before in range(j):  # found through an earlier substring already
            hit &= np.bitwise_count(qparts[:, before, None] ^ parts[:, before]) > reach[:, None]
        hit &= np.bitwise_count(qcode[:, None] ^ code) <= radius[:, None]
        size = np.sqrt((q * q).sum(1))
        near = (q / np.where(size > 0, size, 1)[:, None]) @ flat.T
        ok = np.isfinite(near) & (length > 0) & (length < np.inf)
        hit &= ~ok | (near >= some["bound"].to_numpy()[:, None])
        near[~hit] = -np.inf
        near[hit & ~ok] = np.inf  # looked at closely below
        if near.shape[1] > k + 1:
            # what may be among the best, those that differ by rounding alone too
            least = np.partition(near, near.shape[1] - k - 1, axis=1)[:, near.shape[1] - k - 1] - 1e-12
            hit &= near >= least[:, None]
        a, b = np.nonzero(hit)
        out.append(pd.DataFrame({"query": some["entry"].to_numpy()[a], "entry": entry[b], "score": cosines(q[a], x[b])}))
    rows = pd.concat(out).sort_values(["query", "score", "entry"], ascending=[True, False, True])
    return rows.groupby("query", sort=False).head(k + 1)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): for each row whose id is divisible by ``every`` the k nearest found among all other rows.

    Nearness is the largest cosine in double precision, ties to the smaller id; fewer rows than k give all. Rows with a null id, and
    vectors that are null, empty, zero or hold null or non-finite components, take no part, neither do vectors of another
    length than the query's for that query. A repeated row is a row of its own: as a query it has its own
    answer, and as a candidate it is its copy's nearest. Other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    asked = F.pmod(F.col("id"), F.lit(every)) == 0
    known = entries(rows, k)
    # queries by entry: each row finds the entry that its vector belongs to
    zero = F.transform("v", lambda x: x + F.lit(0.0))
    queries = materialise(rows.where(asked).select("row", F.col("id").alias("query_id"), zero.alias("v")), "queries")
    of_entry = materialise(meet(queries, known.select("v", "entry"), ["v"]).select("row", "query_id", "entry"), "queries-entries")
    marked = known.join(of_entry.select("entry").distinct().withColumn("queried", F.lit(True)), "entry", "left").withColumn("queried", F.coalesce("queried", F.lit(False)))
    codes = coded(marked, fitted(known), k)
    first = codes.where("queried").withColumn("radius", F.lit(FIRST_RADIUS))
    sizes = known.select("entry", "n")
    near = materialise(search(codes, first, k), "near")
    reached = _reached(near.join(sizes, "entry"), k).withColumnRenamed("query", "entry")
    wider = materialise(_with_radius(first.drop("radius").join(reached, "entry", "left")).where(F.col("radius") > FIRST_RADIUS), "wider")
    found = materialise(_replaced(near, wider, search(codes, wider, k)), "found")
    # a radius is right but for its margin: who has too few at its end looks at every code
    enough = _reached(found.join(sizes, "entry"), k).select(F.col("query").alias("entry"))
    rest = materialise(first.withColumn("radius", F.lit(BITS)).join(enough, "entry", "left_anti"), "rest")
    if not rest.isEmpty():
        found = _replaced(found, rest, search(codes, rest, k))
    lists = found.join(known.select("entry", "members"), "entry").groupBy("query").agg(F.collect_list(F.struct("score", "members")).alias("found"))
    lists = lists.withColumnRenamed("query", "entry")
    answers = meet(of_entry, lists, ["entry"])
    flat = answers.select("row", "query_id", F.explode("found").alias("f")).select("row", "query_id", "f.score", F.explode("f.members").alias("m"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "m.id", "m.row")
    ranked = flat.where("m.row <> row").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("m.id").alias(id_col), "score")


def _replaced(found: DataFrame, queries: DataFrame, again: DataFrame) -> DataFrame:
    return found.join(queries.select(F.col("entry").alias("query")), "query", "left_anti").unionByName(again)


def _reached(found: DataFrame, k: int) -> DataFrame:
    """(query, sure): the score that k rows other than the query's own reach, of those found; missing where there are fewer."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "entry").rowsBetween(Window.unboundedPreceding, 0)
    sums = found.withColumn("upto", F.sum("n").over(order))
    return sums.where(F.col("upto") >= k + 1).groupBy("query").agg(F.max("score").alias("sure"))


def _with_radius(queries: DataFrame) -> DataFrame:
    """queries with the bound raised to what is sure, and the radius that follows from it."""
    raised = queries.withColumn("bound", F.greatest("bound", F.coalesce(F.col("sure") - F.lit(1e-12), F.lit(-1.0))))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(radius=radius_of(pdf["bound"].to_numpy()).astype(np.int32))

    schema = ", ".join(f"`{n}` {t}" for n, t in raised.dtypes) + ", radius int"
    return raised.mapInPandas(task, schema)
