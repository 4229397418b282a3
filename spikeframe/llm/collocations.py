"""Phrase collocations by marginalising the counts of the longest windows.

Only windows of MAX_WORDS words are counted: each word with the words 1 to 4 places on beside it as
lead columns, padded where its piece ends. ROLLUP over the lead columns then sums the counts of
ever shorter prefixes: the total of (w1, w2, w3) over all that follows is the number of times that
these three words occur in a row. No n-gram of another length is ever made into rows.

A window is padded as well where two or three words in a row can't occur often enough, as no phrase around them can
then: most windows are short and equal, and add up before they move. Which pairs and triples can is read from counts by hash
slot, an upper bound of each one's own count; what is counted of the rest is exact whatever the number of
slots. Before the ROLLUP, windows lose the last words with which they turned out to be too rare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, meet

MAX_WORDS = 5
#: Slots of the counts of pairs and triples, as powers of 2: from words in the table, about one slot for 16. A bit of each goes to the workers.
LEAST_BITS, MOST_BITS, PER_SLOT = 16, 27, 16
#: Lengths that are counted by slots, and slots that travel as one row.
GATED, SPAN = (2, 3), 1 << 16
#: Parts that a language's phrases are ranked in before they meet.
RANK_PARTS = 256
LEADS = tuple(f"w{k}" for k in range(1, MAX_WORDS + 1))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: What each byte of a text does: 0 belongs to a word, 1 ends a word, 2 a piece. All others, parts of longer characters too, are letters.
_ENDS = np.zeros(256, dtype=np.uint8)
_ENDS[[0x20, 0x09]] = 1
_ENDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
#: Bytes of text that are looked at together (one text at least).
CHUNK = 1 << 22


class _Words:
    """The words of texts end to end: codes into their own dictionary, with language and words left in the piece."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        text = pc.ascii_lower(pc.fill_null(text, ""))
        at = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
        at = (at - at[0]).astype(np.int64)
        ends = _ENDS[data]
        begins = np.zeros(len(data), dtype=bool)
        begins[at[:-1][np.diff(at) > 0]] = True
        inside = ends == 0
        first = np.flatnonzero(inside & (begins | ~np.concatenate([[False], inside[:-1]])))
        chars = np.cumsum(inside)
        offsets = np.append(chars[first] - 1, chars[-1] if len(chars) else 0).astype(np.int32)
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
        langs = pc.fill_null(lang, "und").dictionary_encode()
        self.langs, self.words = langs.dictionary, words.dictionary
        self.code = words.indices.to_numpy(zero_copy_only=False)
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[np.searchsorted(at, first, "right") - 1]
        piece = np.cumsum((ends == 2).astype(np.int64) + begins)[first]
        last = np.flatnonzero(np.diff(piece, append=-1))
        self.left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(first)) + 1  # words up to the piece's end
        self.hash = self._hashes(self.words)[self.code] + self._hashes(self.langs)[self.lang] * _B

    @staticmethod
    def _hashes(values: pa.Array) -> np.ndarray:
        return pd.util.hash_array(np.array(values.to_pylist(), dtype=object), categorize=False)

    def slots(self, at: np.ndarray, k: int, bits: int) -> np.ndarray:
        """Slots of the k words from each place on."""
        mixed = self.hash[at]
        for j in range(1, k):
            mixed = (mixed * _A) ^ (self.hash[at + j] * _B)
            mixed ^= mixed >> np.uint64(29)
        return ((mixed * _A) >> np.uint64(64 - bits)).astype(np.int64)

    def on(self, k: int, masks: dict[int, np.ndarray], bits: int, shorter: np.ndarray | None = None) -> np.ndarray:
        """Places where the k words from there on may be frequent, by what the masks say of two and three words in a row."""
        if k == 1:
            return np.ones(len(self.code), dtype=bool)
        shorter = self.on(k - 1, masks, bits) if shorter is None else shorter
        out = shorter & np.append(shorter[1:], False) & (self.left >= k)
        if k in masks:
            at = np.flatnonzero(out)
            slot = self.slots(at, k, bits)
            out[at] = (masks[k][slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """The words of (lang, text) batches, whole texts of up to CHUNK bytes together."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = int(sizes[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + CHUNK, "right")))
            words = _Words(batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin))
            if len(words.code):
                yield words
            begin = end


def frequent_slots(texts: DataFrame, k: int, masks: dict[int, np.ndarray], least: int, bits: int) -> np.ndarray:
    """A bit for each slot: whether at least ``least`` runs of k words fall into it.

    A task counts all its own runs by slot, up to ``least``, and sends spans of slots; spans add up as they come.
    """
    kind = np.min_scalar_type(least)
    span = min(SPAN, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=kind)
        for words in _chunks(batches):
            at, n = np.unique(words.slots(np.flatnonzero(words.on(k, masks, bits)), k, bits), return_counts=True)
            total[at] = np.minimum(total[at].astype(np.int64) + n, least)
        for i in range(0, len(total), span):
            part = total[i : i + span]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // span]), pa.array([part.tobytes()], pa.binary())], names=["span", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["span", "bits"])
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != now:
                    if now is not None:
                        yield packed()
                    now, total = at, np.zeros(span, dtype=np.int64)
                total += np.frombuffer(counts.as_buffer(), dtype=kind)
        if now is not None:
            yield packed()

    sent = texts.mapInArrow(count, "span long, counts binary").repartition("span").sortWithinPartitions("span")
    mask = np.zeros(((1 << bits) + 7) // 8, dtype=np.uint8)
    # 2 ** MOST_BITS bits at most
    for r in sent.mapInArrow(add, "span long, bits binary").toLocalIterator():
        part = np.frombuffer(r.bits, dtype=np.uint8)
        mask[r.span * span // 8 : r.span * span // 8 + len(part)] = part
    return mask


def slot_bits(texts: DataFrame) -> int:
    words = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(1 + words / PER_SLOT)))))


def counted_windows(texts: DataFrame, least: int, bits: int | None = None) -> DataFrame:
    """(lang, w1 to w5, n) of texts (lang, text): every word with those behind it, padded with empty strings, and how often that occurs.

    A window may come in several rows, all of them in one part of the table with those that agree in the first three words.
    """
    bits, masks = slot_bits(texts) if bits is None else bits, {}
    for k in GATED:
        masks[k] = frequent_slots(texts, k, masks, least, bits)
    sent = texts.sparkSession.sparkContext.broadcast(masks)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _chunks(batches):
            leads, on = [w.code], w.on(1, sent.value, bits)
            group = pd.factorize(w.lang.astype(np.int64) * len(w.words) + w.code)[0]
            for k in range(2, MAX_WORDS + 1):
                on = w.on(k, sent.value, bits, on)
                live = np.flatnonzero(on)
                lead = np.full(len(w.code), -1, dtype=np.int64)
                lead[live] = w.code[live + k - 1]
                leads.append(lead)
                # equal windows so far, numbered as they come
                group = pd.factorize(group * (len(w.words) + 1) + lead + 1)[0]
            n, newest = np.bincount(group), np.maximum.accumulate(group)
            first = np.flatnonzero(np.diff(newest, prepend=-1))
            leads = [pc.fill_null(w.words.take(pa.array(c[first], mask=c[first] < 0)), "") for c in leads]
            yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.lang[first])), *leads, pa.array(n)], names=["lang", *LEADS, "n"])

    schema = ", ".join(f"{c} string" for c in ("lang", *LEADS)) + ", n long"
    return texts.mapInArrow(windows, schema).repartition("lang", *LEADS[:3])


def shortened(windows: DataFrame, least: int) -> DataFrame:
    """windows (counted_windows) without the last words with which they occur less than ``least`` times, down to pairs. Nothing moves."""
    rows = windows.groupBy("lang", *LEADS).agg(F.sum("n").alias("n"))
    for k in range(MAX_WORDS, 2, -1):
        # how often the first k words occur, whatever follows
        often = F.sum("n").over(Window.partitionBy("lang", *LEADS[:k])) >= least
        rows = rows.withColumn("__often", often).withColumn(LEADS[k - 1], F.when(F.col("__often"), F.col(LEADS[k - 1])).otherwise(""))
        rows = rows.groupBy("lang", *LEADS).agg(F.sum("n").alias("n"))
    return rows


def phrase_counts(windows: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, f): the phrases of k words with f >= least, and for k = 0 each language's words in all (phrase empty)."""
    level = F.grouping_id()
    sums = windows.rollup("lang", *LEADS).agg(level.alias("__level"), F.sum("n").alias("f"))
    # a grouping id has a 1 for each column that is summed away, the last column lowest
    k = sum(((F.shiftright("__level", MAX_WORDS - i).bitwiseAND(F.lit(1)) == 0).cast("int") for i in range(1, MAX_WORDS + 1)), F.lit(0))
    whole = F.col("k") == F.array_size(F.array_compact(F.transform(F.array(*LEADS), lambda w: F.when(w != "", w))))
    rows = sums.withColumn("k", k).where((F.col("k") == 0) | ((F.col("f") >= least) & whole))
    rows = rows.where(F.col("__level") < 1 << MAX_WORDS)  # not the total over all languages
    phrase = F.when(F.col("k") == 0, F.lit("")).otherwise(F.array_join(F.array(*[F.when(F.col("k") >= i, F.col(w)) for i, w in enumerate(LEADS, 1)]), " "))
    return rows.select("lang", "k", phrase.alias("phrase"), "f")


def _part(of: Column, start: int | Column, n: int | Column) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.array_join(F.slice(F.split(of, " "), as_col(start), as_col(n)), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, n, score) of each phrase of two and more words, by its lowest-scoring cut.

    phrases: a written table as phrase_counts returns it. Arithmetic is on decimals of 38 digits.
    """
    several = phrases.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = several.withColumns({"first": _part(F.col("phrase"), 1, F.col("cut")), "rest": _part(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut"))})
    known = phrases.where("k >= 1")
    cuts = meet(materialise(cuts, "cuts"), known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = meet(materialise(cuts, "cuts-first"), known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = meet(materialise(cuts, "cuts-rest"), phrases.where("k = 0").select("lang", F.col("f").alias("n")), ["lang"])
    wide = "decimal(38,0)"
    score = F.expr(f"cast((cast(1000 as {wide}) * cast(a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide})) as long)")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "k", "phrase", "a", "n").agg(best).select("lang", "k", "phrase", "a", "best.l", "best.r", "n", "best.score")


def without_parts(rows: DataFrame, share: int = 100) -> DataFrame:
    """rows (scored) that lie inside no longer one with share % of their count or more.

    Looking one word further is enough: what is that frequent k words further is so at each step between.
    """
    longer = rows.where("k > 2")
    inside = F.array(_part(F.col("phrase"), 1, F.col("k") - 1), _part(F.col("phrase"), 2, F.col("k") - 1))
    most = longer.select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("__most"))
    kept = rows.join(most, ["lang", "phrase"], "left").where(F.col("__most").isNull() | (100 * F.col("__most") < share * F.col("a")))
    return kept.drop("__most")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, share: int = 100, text_col: str = "text", lang_col: str = "lang", bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to five words.

    a is the number of times the phrase occurs, l and r those of its two parts at the cut with the lowest
    score floor(1000 a n / (l r)), ties to the shortest first part; n counts all words of the language. Phrases lie within
    pieces between . , ; : ! ? and line ends; letters A to Z are lower-cased. Phrases with a < least are no candidates, and those inside a
    longer candidate that has share % of their count are dropped. Order: score, a (both falling), then the phrase's bytes.

    A null text counts as empty, a null language as ``und``; texts without words and empty tables give no rows, repeated
    rows count each time, and other columns are not read. Texts of any length are read whole.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    phrases = materialise(phrase_counts(shortened(counted_windows(texts, least, bits), least), least), "phrases")
    rows = without_parts(materialise(scored(phrases), "scored"), share)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part, then the first of those
    parts = rows.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    first = parts.withColumn("__at", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
