"""Toxicity: a linear classifier over character n-grams, scaled by log-count ratios.

Features are the distinct character n-grams of a lower-cased text, hashed. Each is
scaled by its naive Bayes log-count ratio between toxic and other training texts;
logistic regression over the scaled features gives the score. Training takes a
bounded sample of the labelled rows, whose texts stay in the tasks; scoring runs over every whole text in Arrow
batches with the table of weights (1 MB) sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, materialise, with_defaults

BITS, ORDERS = 18, (3, 4, 5)
#: Most labelled ids of each class that training takes, about.
TRAIN_ROWS = 2_500
#: N-grams count that are in this many training texts and whose class shares differ by so many standard errors.
MIN_ROWS, MIN_Z = 3, 4.5
THRESHOLD = 0.3
#: Long texts are hashed in pieces of this many characters.
PIECE = 1 << 20


def _lower() -> np.ndarray:
    table = np.arange(128, dtype=np.uint32)
    table[65:91] += 32
    return table


LOWER = _lower()


def features(text: str, stamp: np.ndarray) -> np.ndarray:
    """The hashed n-grams of a text with a blank at both ends, each once. stamp: scratch of 2^BITS int64.

    Long texts go piece by piece, an n-gram with the piece that it starts in: what a text has
    does not depend on PIECE.
    """
    padded, more = f" {text} ", max(ORDERS) - 1
    parts = []
    for at in range(0, len(padded), PIECE):
        chars = np.frombuffer(padded[at : at + PIECE + more].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars = np.where(chars < 128, LOWER[np.minimum(chars, 127)], chars)
        mixed = chars * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        rolled, found = mixed, [np.empty(0, dtype=np.uint32)]
        for n in range(2, max(ORDERS) + 1):
            if len(mixed) < n:
                break
            rolled = rolled[: len(mixed) - n + 1] * np.uint32(0x85EBCA6B) + mixed[n - 1 :]
            if n in ORDERS:
                grams = rolled[:PIECE]
                found.append((grams ^ (grams >> np.uint32(16))) * np.uint32(0xC2B2AE35 + 2 * n) >> np.uint32(32 - BITS))
        parts.append(_once(np.concatenate(found).astype(np.int64), stamp))
    return parts[0] if len(parts) == 1 else _once(np.concatenate(parts), stamp)


def _once(slots: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    order = np.arange(len(slots))
    stamp[slots] = order
    return slots[stamp[slots] == order]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str, stamp: np.ndarray) -> float:
        z = self.bias + float(self.weights[features(text, stamp)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def telling(counts: DataFrame, rows0: int, rows1: int) -> DataFrame:
    """Of the counts (slot, n0, n1) those in enough texts whose class shares differ by enough standard errors."""
    share = (F.col("n0") + F.col("n1")) / F.lit(rows0 + rows1)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * F.lit(1 / rows0 + 1 / rows1))
    apart = F.abs(F.col("n1") / F.lit(rows1) - F.col("n0") / F.lit(rows0)) / error
    return counts.where((F.col("n0") + F.col("n1") >= MIN_ROWS) & (apart >= MIN_Z))


def regress(rows: list[np.ndarray], y: np.ndarray, share: np.ndarray, ratio: np.ndarray, rounds: int = 400, penalty: float = 2e-3) -> Model:
    """Logistic regression on the n-grams of each row, scaled by ratio; share: what each row stands for."""
    prior = (share[y > 0].sum() + 0.5) / (share.sum() + 1)
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    norm = np.float32(1 / np.sqrt(max(np.mean(np.bincount(owner, ratio[flat] ** 2, minlength=len(y))), 1e-9)))
    scaled = ratio * norm
    values = scaled[flat]
    w, bias = np.zeros(1 << BITS, dtype=np.float32), float(np.log(prior / (1 - prior)))
    first, second, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = share / share.mean()
    for step in range(1, rounds + 1):
        z = bias + np.bincount(owner, values * w[flat], minlength=len(y))
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share / len(y)
        grad = np.bincount(flat, values * off[owner].astype(np.float32), minlength=1 << BITS).astype(np.float32) + np.float32(penalty / len(y)) * w
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        rate = 0.05 * (1 - step / (rounds + 1))
        w -= (rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        b1, b2 = 0.9 * b1 + 0.1 * off.sum(), 0.99 * b2 + 0.01 * off.sum() ** 2
        bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-8)
    return Model((w * scaled).astype(np.float32), float(bias))


def is_held_out(id_col: str | Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    text = F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(4)) == 2


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stamp = np.zeros(1 << BITS, dtype=np.int64)
    for batch in batches:
        slots = [features(t.as_py(), stamp).astype(np.int32) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.list_(pa.int32()))], names=["label", "slots"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``rows`` labelled ids of each class, taken by a hash of the id.

    An id labelled both 0 and 1 counts as 1; of several rows with one id the smallest text
    counts. Texts are hashed and counted in tasks: what the driver gets are the n-grams that
    tell the classes apart and their places in the sample. Without a row of either
    class every text gets the share of label 1 (smoothed by a half).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30))
    cut = lambda c: int(min(1.0, rows / max(sizes.get(c, 0), 1)) * (1 << 30))
    chosen = known.where(F.when(F.col("label") == 1, part < cut(1)).otherwise(part < cut(0)))
    text = docs.select(F.col(id_col).alias("id"), with_defaults(text_col).alias("text"))
    # bounded: 2 * rows ids
    sample = text.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    sample = materialise(sample.select("label", "text").mapInArrow(_hashed, "label int, slots array<int>"), "toxic-sample")
    own = {r.label: r for r in sample.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("slots")).alias("total")).collect()}
    if len(own) < 2:
        prior = (sizes.get(1, 0) * (1 in own) + 0.5) / (sum(sizes[c] for c in own) + 1)
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log(prior / (1 - prior))))
    of = lambda c: F.sum((F.col("label") == c).cast("long")).alias(f"n{c}")
    counts = sample.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(of(0), of(1))
    told = telling(counts, own[0].n, own[1].n).collect()
    ratio = np.zeros(1 << BITS, dtype=np.float32)
    smooth = [own[c].total + (1 << BITS) for c in (0, 1)]
    for r in told:
        ratio[r.slot] = np.log((r.n1 + 1) / smooth[1]) - np.log((r.n0 + 1) / smooth[0])
    live = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [s[live.value[s]] for s in (x.values.to_numpy() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots, pa.list_(pa.int32()))], names=["label", "slots"])

    # bounded: 2 * rows lists of n-grams that tell
    kept = sorted((r.label, sorted(r.slots)) for r in sample.mapInArrow(task, "label int, slots array<int>").collect())
    y = np.array([label for label, _ in kept], dtype=np.float64)
    weight = [sizes[c] / own[c].n for c in (0, 1)]
    return regress([np.array(s, dtype=np.int64) for _, s in kept], y, np.where(y > 0, weight[1], weight[0]), ratio)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with __score double (0 to 1), of the whole text; a null text is scored as an empty one. docs has no column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        stamp = np.zeros(1 << BITS, dtype=np.int64)
        own = Model(weights, bias)
        for batch in batches:
            scores = [own.score(t.as_py() or "", stamp) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "__score"])

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", __score double"
    return plain.mapInArrow(task, schema).toDF(*docs.columns, "__score")


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 from THRESHOLD on).

    Only labels of 0 or 1 count; an id labelled both counts as 1, labels of unknown and null ids not at all.
    Empty and null texts get the score of a text without n-grams but its ends, long ones are read to their end.
    Repeated rows each get a row; other columns are not read. An empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col)
    rows = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return rows.select(
        F.col("id").alias(id_col),
        is_held_out("id").alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below THRESHOLD, as they are, with all their columns, whatever these are called.

    A null text is scored as an empty one, null ids are never trained on, repeated rows all stay or all go, and an empty
    table gives none.
    """
    model = train(docs, labels, id_col, text_col)
    plain, (text_col,) = by_place(docs, text_col)
    scored = score(plain, model, text_col)
    return scored.where(F.col("__score") < THRESHOLD).drop("__score").toDF(*docs.columns)
