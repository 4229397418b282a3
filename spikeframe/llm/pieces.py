"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut into units that no piece crosses (a space belongs to what follows
it; long units are cut further between characters that no piece holds side by side). Units that a
task has not met yet are grouped by length, and all units of a
group advance together (where only a few share a length, one after another by the same search): at each end position the hashes of the substrings that end
there probe the sorted keys of the pieces, and the best candidate of each unit is
kept as its backpointer. For unigram models the best is the largest sum of scores.
For BPE models a candidate must fit the piece before it, that is, merging the two
by rank must leave the border between them; exactly one segmentation fits
everywhere, and it is the one that merging finds.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Units that a worker remembers, their longest length, and cells of one group that advance at once.
REMEMBERED, LONGEST_REMEMBERED, GROUP_CELLS = 500_000, 64, 1 << 21
#: Units of one length that go one after another, and characters of text that are encoded together.
FEW, CHUNK_CHARS = 4, 4 << 20
#: Slots of the table of key bits that is looked at before the keys, and of the table of pairs of pieces.
BITS_SEEN, BITS_PAIRS = 22, 20
UNIGRAM, BPE = 1, 2


@dataclass
class Pieces:
    """What a model file holds, as plain values that go to the tasks."""

    kind: int
    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only models that keep the text as it is are supported")
        return cls(model.trainer_spec.model_type, [p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], norm.add_dummy_prefix)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


@dataclass
class Codec:
    """Encoder and decoder of one model, for one worker."""

    model: Pieces
    memory: dict = field(default_factory=dict)
    blanks: dict = field(default_factory=dict)
    #: Answers of _fit_one, and units that are forgotten after their texts.
    fitting: dict = field(default_factory=dict)
    passing: list = field(default_factory=list)

    def __post_init__(self):
        m = self.model
        normal = [i for i, t in enumerate(m.types) if t == 1]
        self.unknown = next(i for i, t in enumerate(m.types) if t == 2)
        self.bytes = [-1] * 256
        for i, t in enumerate(m.types):
            if t == 6:
                self.bytes[int(m.pieces[i][3:5], 16)] = i
        self.blank = {len(m.pieces[i]): i for i in normal if set(m.pieces[i]) == {SPACE}}
        # pieces by rank: single characters first, then merges from the first on; runs of blanks are handled apart
        self.ids = [i for i in normal if len(m.pieces[i]) == 1] + sorted((i for i in normal if len(m.pieces[i]) > 1 and i not in self.blank.values()), key=lambda i: (-m.scores[i], i))
        self.text = [m.pieces[i] for i in self.ids]
        self.rank = {t: r for r, t in enumerate(self.text)}
        self.singles = sum(len(t) == 1 for t in self.text)
        self.longest = max(map(len, self.text))
        self.score = np.array([m.scores[i] for i in self.ids])
        self.power = np.full(self.longest + 1, BASE, dtype=np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power, dtype=np.uint64)
        self.length = np.array([len(t) for t in self.text])
        self.hash = np.array([self._hash(t) for t in self.text], dtype=np.uint64)
        keys = self.hash ^ (self.length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one key")
        self.seen = np.zeros(1 << BITS_SEEN, dtype=bool)
        self.seen[self.keys >> np.uint64(64 - BITS_SEEN)] = True
        if m.kind == BPE:
            self._split()
            self.pair_key = np.full(1 << BITS_PAIRS, -1, dtype=np.int64)
            self.pair_fits = np.zeros(1 << BITS_PAIRS, dtype=bool)
        self.usable = {t: r for r, t in enumerate(self.text) if m.kind != BPE or self.made[r]}
        self.lowest = self.score.min() - 10
        #: Neighbours that some piece holds; between any others no piece goes on.
        self.inside = {t[i : i + 2] for t in self.text for i in range(len(t) - 1)}
        self.decoded = [self._plain(i) for i in range(len(m.pieces))]

    def _hash(self, text: str) -> np.uint64:
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in _codes(text):
                value = value * BASE + c + np.uint64(1)
        return value

    def _plain(self, i: int) -> bytes:
        kind, piece = self.model.types[i], self.model.pieces[i]
        return {3: b"", 6: None, 2: " ⁇ ".encode()}.get(kind, piece.replace(SPACE, " ").encode()) if kind != 6 else bytes([int(piece[3:5], 16)])

    def probe(self, hashes: np.ndarray, lengths) -> np.ndarray:
        """Ranks of the pieces with these hashes, -1 where there is none."""
        keys = hashes ^ (np.asarray(lengths).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        out = np.full(len(keys), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[keys >> np.uint64(64 - BITS_SEEN)])
        if len(maybe):
            keys = keys[maybe]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == keys, self.key_rank[at], -1)
        return out

    def _split(self) -> None:
        """The two pieces of each piece's last merge; a single character, or a piece that merging never makes, is its own."""
        self.left = np.arange(len(self.text))
        self.right = np.arange(len(self.text))
        for r in range(self.singles, len(self.text)):
            parts = self._merge(self.text[r], r)
            if len(parts) == 2:
                self.left[r], self.right[r] = parts
        self.made = (self.left != np.arange(len(self.text))) | (self.length == 1)
        # a piece that merging never makes is no candidate
        self.key_rank = np.where(self.made[self.key_rank], self.key_rank, -1)

    def _merge(self, text: str, below: int) -> list[int]:
        """Ranks after all merges of ranks less than ``below``, plainly; only for pieces."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= below:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank.get(p, -1) for p in parts]

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_fits, with what was found for pairs before."""
        pair = a * len(self.text) + b
        slot = (pair.astype(np.uint64) * BASE >> np.uint64(64 - BITS_PAIRS)).astype(np.int64)
        known = self.pair_key[slot] == pair
        known &= (a >= 0) & (b >= 0)
        ok = self.pair_fits[slot]
        new = np.flatnonzero(~known)
        if len(new):
            ok[new] = self._fits(a[new], b[new])
            self.pair_key[slot[new]] = pair[new]
            # of pairs that share a slot the last one written stays: its answer must be the one kept with it
            stays = new[self.pair_key[slot[new]] == pair[new]]
            self.pair_fits[slot[stays]] = ok[stays]
        return ok

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between piece a and piece b (ranks; -1 is a character without a piece)."""
        ok = np.ones(len(a), dtype=bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[live], b[live]
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            joint = self.length[a] + self.length[b]
            short = joint <= self.longest
            made = np.full(len(a), -1)
            made[short] = self.probe(self.hash[a[short]] * self.power[self.length[b[short]]] + self.hash[b[short]], joint[short])
            bad = (made >= 0) & (made < limit)
            ok[live[bad]] = False
            # undo the later of the two last merges, then the other's
            undo_a = a > b
            na, nb = self.right[a], self.left[b]
            a_ends, b_ends = na == a, nb == b
            take_a = np.where(undo_a, ~a_ends, b_ends & ~a_ends)
            take_b = np.where(undo_a, a_ends & ~b_ends, ~b_ends)
            limit = np.where(take_a, a, np.where(take_b, b + 1, limit))
            go = ~bad & (take_a | take_b)
            a, b = np.where(take_a, na, a)[go], np.where(take_b, nb, b)[go]
            limit, live = limit[go], live[go]
        return ok

    def _viterbi(self, units: list[str]) -> list[list[int]]:
        """Ranks of the pieces of units of one length; -1 for a character without a piece."""
        size, rows = len(units[0]), len(units)
        chars = _codes("".join(units)).reshape(rows, size).T + np.uint64(1)
        prefix = np.zeros((size + 1, rows), dtype=np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * BASE + chars[j]
        last = np.full((size + 1, rows), -1, dtype=np.int64)
        step = np.zeros((size + 1, rows), dtype=np.int32)
        best = np.full((size + 1, rows), -np.inf)
        best[0] = 0
        for j in range(1, size + 1):
            # all substrings that end here, the longest first
            lengths = np.arange(min(self.longest, j), 0, -1)
            hashes = prefix[j] - prefix[j - lengths] * self.power[lengths, None]
            found = self.probe(hashes.ravel(), np.repeat(lengths, rows)).reshape(len(lengths), rows)
            can = (found >= 0) & (best[j - lengths] > -np.inf)
            can[-1] |= best[j - 1] > -np.inf
            for k in np.flatnonzero(can.any(axis=1)).tolist():
                n = int(lengths[k])
                i = j - n
                if self.model.kind == BPE:
                    at = np.flatnonzero(can[k] & (best[j] == -np.inf))
                    if i and len(at):
                        at = at[self.fits(last[i, at], found[k, at])]
                    best[j, at] = 0
                else:
                    value = best[i] + np.where(found[k] >= 0, self.score[found[k]], self.lowest)
                    at = np.flatnonzero(can[k] & (value > best[j]))
                    best[j, at] = value[at]
                last[j, at], step[j, at] = found[k, at], n
        # all units walk back together; each leaves its pieces from the last to the first
        rank, count = np.full((rows, size), -2, dtype=np.int64), np.zeros(rows, dtype=np.int64)
        at, live = np.full(rows, size), np.arange(rows)
        while len(live):
            rank[live, count[live]] = last[at[live], live]
            count[live] += 1
            at[live] -= step[at[live], live]
            live = live[at[live] > 0]
        order = count[:, None] - 1 - np.arange(size)
        flat = np.take_along_axis(rank, np.maximum(order, 0), axis=1)[order >= 0].tolist()
        ends = np.cumsum(count).tolist()
        return [flat[e - n : e] for e, n in zip(ends, count.tolist(), strict=True)]

    def _fit_one(self, a: int, b: int) -> bool:
        pair = (a, b)
        if pair not in self.fitting:
            if len(self.fitting) > REMEMBERED:
                self.fitting.clear()
            self.fitting[pair] = bool(self._fits(np.array([a]), np.array([b]))[0])
        return self.fitting[pair]

    def _walk(self, unit: str) -> list[int]:
        """What _viterbi gives for one unit."""
        bpe, usable, low = self.model.kind == BPE, self.usable, self.lowest
        last, step, best = [-1] * (len(unit) + 1), [0] * (len(unit) + 1), [-np.inf] * (len(unit) + 1)
        best[0] = 0.0
        for j in range(1, len(unit) + 1):
            for n in range(min(self.longest, j), 0, -1):
                i = j - n
                if best[i] == -np.inf:
                    continue
                r = usable.get(unit[i:j], -1)
                if n > 1 and r < 0:
                    continue
                if bpe:
                    if i and r >= 0 and last[i] >= 0 and not self._fit_one(last[i], r):
                        continue
                    best[j], last[j], step[j] = 0.0, r, n
                    break
                value = best[i] + (self.score[r] if r >= 0 else low)
                if value > best[j]:
                    best[j], last[j], step[j] = value, r, n
        ranks, at = [], len(unit)
        while at:
            ranks.append(last[at])
            at -= step[at]
        return ranks[::-1]

    def _parts(self, unit: str) -> list[str]:
        """A unit cut where no piece goes on: a long one everywhere, others before a last character such as a full stop."""
        inside = self.inside
        if len(unit) > LONGEST_REMEMBERED:
            cuts = [0, *(i for i in range(1 + (unit[0] == SPACE), len(unit)) if unit[i - 1 : i + 1] not in inside), len(unit)]
            return [unit[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(unit) > 2 and unit[-2:] not in inside and unit[-2] != SPACE:
            return [unit[:-1], unit[-1]]
        return [unit]

    def _learn(self, units: list[str]) -> None:
        """Put into memory the ids of units that are not there yet."""
        inside, memory = self.inside, self.memory
        cut = {u: self._parts(u) for u in units if len(u) > 2 and (u[-2:] not in inside or len(u) > LONGEST_REMEMBERED)}
        fresh = set(units).difference(cut)
        fresh.update(part for parts in cut.values() for part in parts if part not in memory)
        by_length: dict[int, list[str]] = {}
        for part in fresh:
            by_length.setdefault(len(part), []).append(part)
        for size, group in by_length.items():
            if len(group) <= FEW:
                for unit in group:
                    self._remember(unit, self._to_ids(unit, self._walk(unit)))
                continue
            block = max(1, GROUP_CELLS // (size + 1) // 16)
            for at in range(0, len(group), block):
                part = group[at : at + block]
                for unit, ranks in zip(part, self._viterbi(part), strict=True):
                    self._remember(unit, self._to_ids(unit, ranks))
        for u, parts in cut.items():
            if len(parts) > 1:
                self._remember(u, b"".join(map(memory.__getitem__, parts)))

    def _remember(self, unit: str, ids: bytes) -> None:
        self.memory[unit] = ids
        if len(unit) > LONGEST_REMEMBERED:
            self.passing.append(unit)

    def _to_ids(self, unit: str, ranks: list[int]) -> bytes:
        if -1 not in ranks:
            if "".join(map(self.text.__getitem__, ranks)) != unit:
                raise ValueError(f"two substrings have one key: {unit!r}")
            return array("i", map(self.ids.__getitem__, ranks)).tobytes()
        ids, at = array("i"), 0
        for r in ranks:
            if r >= 0:
                ids.append(self.ids[r])
                at += len(self.text[r])
            else:
                raw = unit[at].encode("utf-8", "surrogatepass")
                ids.extend(self.bytes[b] if self.bytes[b] >= 0 else self.unknown for b in raw)
                at += 1
        return ids.tobytes()

    def _blank_run(self, n: int) -> bytes:
        """Ids of n blanks in a row: the leftmost pair that makes a piece is joined first."""
        if n not in self.blanks:
            parts: list[int] = []
            for _ in range(n):
                parts.append(1)
                # all that stands to the left is final as soon as no join is left there
                while len(parts) > 1 and parts[-2] + parts[-1] in self.blank:
                    parts[-2:] = [parts[-2] + parts[-1]]
            self.blanks[n] = array("i", (self.blank[p] for p in parts)).tobytes()
        return self.blanks[n]

    def _cut(self, text: str) -> list[str]:
        """Units: a blank and the characters up to the next blank or line end, or a line end; some are empty."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        sign = "\x00"
        if sign in text:
            sign = next(c for c in map(chr, range(0xE000, 0x10FFFF)) if c not in text)
        marked = text.replace(" ", sign + SPACE).replace("\n", f"{sign}\n{sign}")
        return (SPACE + marked if self.model.dummy_prefix else marked).split(sign)

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers one after another."""
        cut = [self._cut(t) for t in texts]
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        memory.setdefault("", b"")
        fresh = set(chain.from_iterable(cut))
        fresh.discard(SPACE)
        self._learn([u for u in fresh if u not in memory])
        out = [self._assemble(u) if SPACE in u else b"".join(map(memory.__getitem__, u)) for u in cut]
        for u in self.passing:
            memory.pop(u, None)
        self.passing.clear()
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(b, dtype=np.int32).tolist() for b in self.encode_bytes(texts)]

    def _assemble(self, units: list[str]) -> bytes:
        """Ids of units with runs of blanks among them."""
        ids: list[bytes] = []
        memory, blanks = self.memory, 0
        lone = array("i", [self.blank.get(1, -1)]).tobytes()
        for u in units:
            if u == SPACE:
                blanks += 1
                continue
            got = memory[u]
            if blanks and u:
                # a blank that no piece of the unit takes belongs to the run before it
                if got[:4] == lone and u[0] == SPACE:
                    ids.append(self._blank_run(blanks + 1))
                    got = got[4:]
                else:
                    ids.append(self._blank_run(blanks))
                blanks = 0
            ids.append(got)
        if blanks:
            ids.append(self._blank_run(blanks))
        return b"".join(ids)

    def decode(self, ids: list[int]) -> str:
        plain = self.decoded
        text = b"".join([plain[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_codecs: dict[int, Codec] = {}


def _codec(sent) -> Codec:
    """One codec for each worker and model, so that units stay remembered between tasks."""
    key = sent.id if hasattr(sent, "id") else id(sent)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(sent.value)
    return _codecs[key]


def _chunks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch with their texts, about CHUNK_CHARS of them at a time."""
    start, size, texts = 0, 0, []
    for k in range(batch.num_rows):
        texts.append(batch.column(at)[k].as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARS or k == batch.num_rows - 1:
            yield batch.slice(start, k + 1 - start), texts
            start, size, texts = k + 1, 0, []


def _lists(ids: list[bytes]) -> pa.Array:
    """The ids of texts as an Arrow array of lists."""
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def encode_column(docs: DataFrame, text_col: str = "text", out_col: str = "token_ids", path: str = DEFAULT_MODEL) -> DataFrame:
    """docs with the ids of each whole text (array<int>) as ``out_col``, in place of a column of that name (in any case).

    A null text has no ids, like an empty one; long texts are encoded whole, repeated rows each, and an empty table gives no rows.
    Of pieces with equal sums the longest wins. Other columns stay as they are, whatever they are called.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out_col.lower()])
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*names), docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in batches:
            for part, texts in _chunks(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(codec.encode_bytes(texts))], names=[*names, "ids"])

    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", ids array<int>"
    return plain.mapInArrow(task, schema).toDF(*docs.columns, out_col)


def decode_column(docs: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", path: str = DEFAULT_MODEL) -> DataFrame:
    """docs with the text that the ids stand for; null ids give an empty text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*names), docs.columns.index(ids_col)
    sent = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", text string"
    return plain.mapInArrow(task, schema).toDF(*docs.columns, out_col)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_MODEL) -> DataFrame:
    """One row per input row: id, n_tokens, token_ids, decoded_sha256, round_trip.

    Ids are those that the model's own library gives; decoding follows in the same pass.
    round_trip tells whether it gives the text back (a text with the blank sign U+2581
    itself gets a space for it). A null or empty text has no tokens, a long one is encoded whole, with
    or without blanks. Repeated rows each get theirs; other columns are not read. An empty table
    gives no rows.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in batches:
            for part, texts in _chunks(batch, 1):
                ids = codec.encode_bytes(texts)
                back = [codec.decode(np.frombuffer(x, dtype=np.int32).tolist()) for x in ids]
                digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]
                same = [a == b for a, b in zip(back, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], names=["id", "token_ids", "decoded_sha256", "round_trip"])

    kind = plain.schema["id"].dataType.simpleString()
    made = plain.mapInArrow(task, f"id {kind}, token_ids array<int>, decoded_sha256 string, round_trip boolean")
    return made.select(F.col("id").alias(id_col), F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_sha256", "round_trip")
