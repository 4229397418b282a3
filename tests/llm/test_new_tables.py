"""Nearest neighbours, the conversation trie and collocations against brute force on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from spikeframe.llm import collocations, neighbours, queries, trie

VECS = "vec_id long, embedding array<float>, label int"
CONVS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string"


# nearest neighbours


def plain_nearest(rows, k, every):
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, (qid, x) in enumerate(usable):
        if qid % every:
            continue
        near = []
        for c, (cid, y) in enumerate(usable):
            if c != q and len(x) == len(y):
                score = (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))
                near.append((-score, cid))
        out += [(qid, r, cid, -s) for r, (s, cid) in enumerate(sorted(near)[:k], 1)]
    return out


def got_nearest(spark, rows, k=5, every=50):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECS)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, k, every).collect())


@pytest.mark.parametrize("dims", [2, 8, 64, 100])
def test_nearest_recall(spark, dims):
    rng = np.random.default_rng(dims)
    middle = rng.normal(size=(12, dims))
    x = np.concatenate([rng.normal(size=(300, dims)), middle[rng.integers(0, 12, 300)] + 0.05 * rng.normal(size=(300, dims))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = got_nearest(spark, rows, every=10), sorted(plain_nearest(rows, 5, 10))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    found = {(g[0], g[2]) for g in got}
    assert np.mean([(w[0], w[2]) in found for w in want]) >= 0.95
    score = {(w[0], w[2]): w[3] for w in plain_nearest(rows, 600, 10)}
    assert all(g[3] == pytest.approx(score[g[0], g[2]], abs=1e-12) for g in got)


def test_nearest_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    same = rng.normal(size=4).astype(np.float32).tolist()
    rows = [(i, same) for i in range(0, 60)] + [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60, 100)]
    rows += [(100, same), (100, same), (None, same), (101, None), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(106, []), (150, [1.0, 2.0]), (151, [2.0, 4.0]), (200, [-0.0, 1.0, 0.0, 0.0]), (201, [0.0, 1.0, 0.0, 0.0])]
    got, want = got_nearest(spark, rows), sorted(plain_nearest(rows, 5, 50))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[2] for g in got if g[0] == 0] == [1, 2, 3, 4, 5]
    assert [g[2] for g in got if g[0] == 150] == [151]


def test_nearest_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=16) + 0.01 * rng.normal(size=(200, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    whole = got_nearest(spark, rows, every=5)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    assert got_nearest(spark, rows, every=5) == whole
    assert got_nearest(spark, [], every=5) == []


def test_probe_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    code = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    code[:1000] = code[0] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 20), replace=False)) for _ in range(1000)], dtype=np.uint64)
    parts = neighbours._parts(code)
    for r in (0, 3, 11, 19):
        near = np.bitwise_count(code[0] ^ code) <= r
        close = np.bitwise_count(parts[0] ^ parts) <= r // neighbours.PARTS
        assert (close.any(1) | ~near).all()


def test_nearest_of_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = {(r.query_id, r.vec_id) for r in queries.op11_neighbours(spark, d).collect()}
    want = [(w[0], w[2]) for w in plain_nearest(rows, 5, 50)]
    assert np.mean([w in got for w in want]) >= 0.9 and len(got) == len(want)


# the trie


def plain_trie(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by[c].append(((t is not None, t or 0, role, digest), (role, text)))
    turns = {c: [x for _, x in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        kids = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in nodes)]
        saved = sum((len(nodes[s]) - 1) * size(s[-1][1]) for s in below if s)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(seq)))
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_conversations(seed, n=45, same=True):
    rng = random.Random(seed)
    words = ["a", "bb", "a bb", "", "x\ty z", " "]
    rows = []
    for c in range(n):
        kind = rng.randrange(3)
        for t in range(rng.randrange(1, 7)):
            text = f"turn {t} of {kind}" if same and rng.random() < 0.8 else rng.choice(words)
            rows.append((c - 7, t, rng.choice(["user", "assistant"]) if not same else ("user", "assistant")[t % 2], text))
    return rows


def got_trie(spark, rows, **more):
    return sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, CONVS), **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = some_conversations(seed, same=seed == 1)
    rows += [(60, None, None, None), (60, None, "user", "b"), (60, 3, "user", "b"), (60, 3, "user", "b"), (60, 3, "a", ""), (None, 0, "user", "lost"), (61, 1, "é", "ü " * 2000)]
    assert got_trie(spark, rows) == plain_trie(rows)


def test_trie_long_conversation_in_blocks(spark, monkeypatch):
    rows = [(20, t, "user", f"w{t % 5}") for t in range(60)] + [(c, t, "user", f"w{t % 5}") for c in (21, 22, 25) for t in range(30)]
    monkeypatch.setattr(trie, "BLOCK", 7)
    assert got_trie(spark, rows) == plain_trie(rows)
    assert got_trie(spark, []) == []


def test_trie_rejects_prefixes_that_only_look_equal(spark):
    rows = some_conversations(4, n=30, same=False)
    weak = trie.Ring(2, (1, 1, 1, 1))
    assert got_trie(spark, rows, rings=(weak, *trie.RINGS)) == plain_trie(rows)
    with pytest.raises(ValueError):
        got_trie(spark, rows, rings=(weak,))


def test_ring_powers(spark):
    ring = trie.RINGS[0]
    at = spark.createDataFrame([(0,), (1,), (12345678901,), (2**31 - 2,)], "e long")
    for r in at.select("e", ring.power(0, at.e).alias("p")).collect():
        assert r.p == pow(ring.bases[0], r.e, ring.prime)


# collocations


def plain_collocations(rows, least, top, share=100):
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    cand = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in cand.items():
        inside = any(m == lang and len(w) > len(words) and 100 * b >= share * a and any(w[i : i + len(words)] == words for i in range(len(w))) for (m, w), b in cand.items())
        if inside:
            continue
        cuts = [(1000 * a * total[lang] // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]], total[lang]))
    ranked, at = [], collections.Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


def got_collocations(spark, rows, least, top, **more):
    return sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, DOCS), least, top, **more).collect())


def some_texts(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "new", "york", "times", "of", "état", "ß", "-", "a", "ÀB"]
    phrases = ["new york times", "state of the union", "a a a", "of the", "one two three four five six"]
    rows = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(0, 40))]
        rows.append((i, "".join(p + rng.choice([" ", "  ", "\t", ", ", "\n", "\x0b", " "]) for p in parts), rng.choice(["en", "en", "fr", None, ""])))
    return rows + [(900, None, "en"), (901, "", None), (902, " \t.", "de"), (903, "alone", "de"), (904, "same same " * 3000, "de"), (904, "same same " * 3000, "de")]


@pytest.mark.parametrize("share", [100, 60])
@pytest.mark.parametrize("bits", [None, 3, 12])
def test_collocations(spark, bits, share):
    rows = some_texts(7)
    want = sorted(plain_collocations(rows, 5, 30, share))
    assert len(want) > 40
    assert got_collocations(spark, rows, 5, 30, bits=bits, share=share) == want


def test_collocations_of_nothing(spark):
    assert got_collocations(spark, [], 2, 10) == []
    assert got_collocations(spark, [(1, None, None), (2, "one", "en")], 1, 10) == []


def test_collocation_texts_are_read_in_chunks(spark, monkeypatch):
    rows = some_texts(8, 60)
    monkeypatch.setattr(collocations, "CHUNK", 50)
    words = collections.Counter()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    for chunk in collocations._chunks(iter([batch.slice(3)])):
        words.update(chunk.words.take(pa.array(chunk.code)).to_pylist())
    want = collections.Counter(w for _, t, _ in rows[3:] for w in re.findall(r"[^\x20\x09-\x0D.,;:!?]+", (t or "").translate(str.maketrans("TABCNY", "tabcny"))))
    assert words == want


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**15
    rows = [("en", 0, "", big), ("en", 1, "a", 5 * 10**14), ("en", 1, "b", 4 * 10**14), ("en", 2, "a b", 3 * 10**14)]
    from spikeframe.llm.common import materialise

    phrases = materialise(spark.createDataFrame(rows, "lang string, k int, phrase string, f long"), "big-phrases")
    (r,) = collocations.scored(phrases).collect()
    assert r.score == 1000 * r.a * big // (r.l * r.r)
