"""Mixing, exact and near deduplication, fingerprints, secrets: small cases and brute force."""

import base64
import hashlib
import math
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spikeframe.llm import exact_dedup, fingerprints, mixing, near_dedup, secrets
from spikeframe.llm.common import running

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[k], len(t or "")) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


CASES = [(1, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "x"), (7, "é " * 3000), (8, " \t\n")]


def test_exact_dedup_cases(spark):
    got = exact_dedup.exact_dedup(docs(spark, CASES)).collect()
    assert len(got) == len(CASES)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[1, digest("a b c")].keep_id == 2 and not by[1, digest("a b c")].kept
    assert by[3, digest("")].keep_id == 4 and by[4, digest("")].kept
    assert by[None, digest("x")].keep_id == 5 and by[None, digest("x")].group_size == 3
    assert sum(r.kept for r in got) == 5
    left = exact_dedup.drop_copies(docs(spark, CASES))
    assert sorted((r.doc_id for r in left.collect())) == [2, 4, 5, 7, 8]
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_exact_dedup_smallest_and_many_copies(spark):
    rows = [(i, "same") for i in range(500)] + [(i, f"t{i % 50}") for i in range(500, 700)]
    got = exact_dedup.exact_dedup(docs(spark, rows), keep="min").where("kept").collect()
    assert sorted(r.doc_id for r in got) == [0, *range(500, 550)]


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("parts", [1, 3, 70])
def test_merged_runs_are_those_of_brute_force(spark, keep, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, *range(150)]), rng.choice(["same", None, "", *(f"t{k}" for k in range(60))])) for _ in range(900)]
    got = exact_dedup.exact_dedup(docs(spark, rows).repartition(parts), keep=keep).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    best = max if keep == "max" else min
    for r in got:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.keep_id == (best(ids) if ids else None) and r.group_size == len(groups[r.text_sha256])
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(groups) and len(got) == len(rows)


def test_runs_are_sorted_and_merged(spark, capsys):
    level = exact_dedup.first_runs(exact_dedup.digest_runs(docs(spark, [(i, f"t{i % 50}") for i in range(400)]).repartition(20)))
    merged = exact_dedup.merge_tree(level, runs=20, fan=4)
    merged.explain()
    plan = capsys.readouterr().out
    # three rounds of fan 4 from 20 runs, after the runs' own sort: each sorts what it gets and joins neighbours
    assert plan.count("SortAggregate") >= 4 and plan.count("Sort [") >= 4 and "HashAggregate" not in plan
    assert merged.count() == 50


def test_many_copies_of_one_row(spark):
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    got = exact_dedup.exact_dedup(rows)
    assert got.count() == 100_000 and got.where("kept").count() == 1 and got.where("group_size = 100000").count() == 100_000
    assert exact_dedup.drop_copies(rows).count() == 1


def test_empty_tables_and_clashing_columns(spark):
    empty = docs(spark, []).withColumn("run", F.lit(1))
    assert exact_dedup.exact_dedup(empty).isEmpty()
    assert mixing.mix(empty).isEmpty() and mixing.mixed_documents(empty).isEmpty()
    assert near_dedup.near_components(empty).isEmpty()
    assert fingerprints.fingerprint_edits(empty).isEmpty()
    assert secrets.secret_report(empty).isEmpty()
    some = docs(spark, CASES).withColumns({c: F.lit(1) for c in ("run", "digest", "key", "part", "size", "id", "tag", "bucket", "made", "spans")})
    assert exact_dedup.drop_copies(some).columns == some.columns
    assert mixing.mixed_documents(some).columns == some.columns
    assert near_dedup.drop_near_copies(some).columns == some.columns
    assert fingerprints.fingerprint_edits(some).count() == secrets.secret_report(some).count() == len(CASES)


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by handing the excess round after round to the others."""
    budget = share * sum(sizes)
    full, goal = set(), {}
    while len(full) < len(sizes):
        free = [i for i in range(len(sizes)) if i not in full]
        rest = budget - sum(most * sizes[i] for i in full)
        total = sum(weights[i % len(weights)] for i in free)
        goal = {i: rest * weights[i % len(weights)] / total for i in free}
        over = {i for i in free if goal[i] > most * sizes[i]}
        if not over:
            break
        full |= over
    return [most * sizes[i] if i in full else goal[i] for i in range(len(sizes))]


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    texts = [(i, words(rng, rng.randint(0, 60))) for i in range(300)] + [(300, None), (301, "")]
    sources = [rng.choice(["b", "b", "b", "é", "a", "z"]) for _ in texts]
    table = docs(spark, texts, sources).withColumn("source", F.when(F.col("source") != "z", F.col("source")))
    got = mixing.mix(table).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(table.repartition(7)).collect()), key=str)
    sums, own = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.size == len(WORD.findall(texts[r.doc_id][1] or ""))
        sums[r.source] = sums.get(r.source, 0) + r.taken
        own[r.source] = (r.source_size, r.target)
    order = ["a", "b", "é", None]
    want = fill([own[s][0] for s in order])
    for s, t in zip(order, want, strict=True):
        assert abs(own[s][1] - t) < 1e-6 and abs(sums[s] - t) <= 0.5


def test_mixed_rows_hold_the_words_taken(spark):
    rng = random.Random(2)
    texts = [(i, words(rng, rng.randint(1, 40))) for i in range(120)] + [(5, words(rng, 9)), (6, "twin twin"), (6, "twin twin")]
    table = docs(spark, texts, [rng.choice("abc") for _ in texts])
    taken = {r.source: r.n for r in mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    rows = mixing.mixed_documents(table)
    again = {}
    for r in rows.collect():
        again[r.source] = again.get(r.source, 0) + len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert again == taken


@pytest.mark.parametrize("count", [1, 2, 3, 7, 40])
def test_targets_of_any_number_of_sources(spark, count):
    rng = random.Random(count)
    sizes = [rng.choice([0, 1, 5, 1000, rng.randint(0, 300)]) for _ in range(count)]
    table = spark.createDataFrame([(f"s{i:03d}" if i else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table.repartition(3)).collect()}
    order = [*range(1, count), 0]  # null last
    want = fill([sizes[i] for i in order])
    for i, t in zip(order, want, strict=True):
        assert abs(got[f"s{i:03d}" if i else None] - t) < 1e-6


def test_mix_of_one_row_repeated_often(spark):
    twins = [(7, "one two three")] * 3000
    table = docs(spark, [*twins, *((i, "a b") for i in range(100, 130))], ["a"] * 3000 + ["b"] * 30).withColumn("lang", F.when(F.col("doc_id") == 7, F.when(F.rand(1) < 0.5, "x").otherwise("y")))
    taken = {r.source: r.n for r in mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    again = {r.source: r.n for r in mixing.mixed_documents(table).groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
    assert again == taken


def test_running_sums(spark):
    rng = random.Random(3)
    lists = [[], [5], [rng.randint(0, 9) for _ in range(255)], [1] * 256, [2] * 257, [rng.randint(0, 9) for _ in range(3000)]]
    df = spark.createDataFrame([(v,) for v in lists], "v array<bigint>")
    for r in df.select("v", running(F.col("v")).alias("r")).collect():
        assert r.r == [sum(r.v[:i]) for i in range(len(r.v))]


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, percent=85):
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}, dict(sets)


@pytest.mark.parametrize("block,meeting", [(80, 250), (3, 4), (1, 1)])
def test_near_components_are_those_of_brute_force(spark, monkeypatch, block, meeting):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "MEETING", meeting)
    monkeypatch.setattr(near_dedup, "VISITORS", 2)
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = words(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(copy).replace("w1", "W1") if rng.random() < 0.3 else " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \n", "two words", "Two  words", "É", "é", "x " * 5000])]
    want, sets = components(rows)
    got = near_dedup.near_components(docs(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_pairs_of_80_to_85_percent_are_dropped(spark):
    assert near_dedup.banding(85) == (25, 5, 86) and near_dedup.banding(80) == (28, 4, 77)
    rng, rows = random.Random(11), []
    for k in range(150):
        base = [f"v{k}x{i}" for i in range(204)]  # 200 runs of five words, of which n words at the end share 200 - n
        n = rng.randint(16, 26)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 204 - n] + [f"u{k}x{i}" for i in range(n)]))]
    sets = dict((i, shingles(t)) for i, t in rows)
    shares = [100 * len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(150)]
    assert sum(80 <= s < 85 for s in shares) > 20 and min(shares) < 80
    table = docs(spark, rows)
    for percent, got in ((80, near_dedup.drop_near_copies(table)), (85, near_dedup.drop_near_copies(table, percent=85))):
        want = {i for i in sets if i % 2 == 0 or shares[i // 2] < percent}
        assert {r.doc_id for r in got.collect()} == want


def test_near_components_of_repeated_and_null_ids(spark):
    rng = random.Random(5)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (1, b), (2, a + " more"), (None, b + " more"), (3, a), (3, a)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_components(docs(spark, rows)).collect()}
    assert set(got.values()) == {1}


def test_a_large_family_and_its_likes(spark, monkeypatch):
    """Hundreds of near copies, a second family that shares most of their words, chains, and many null ids."""
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    monkeypatch.setattr(near_dedup, "MEETING", 30)
    rng = random.Random(21)
    base = words(rng, 200, 10**6).split()
    other = base[:150] + words(rng, 50, 10**6).split()
    rows = []
    for k in range(400):
        copy = list(base if k % 4 else other)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(copy)))
    chain = words(rng, 150, 10**6).split()
    for k in range(60):
        rows.append((1000 + k, " ".join(chain)))
        chain = chain[2:] + [f"c{k}", f"d{k}"]
    want, _ = components(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(docs(spark, rows)).collect()}
    assert got == want and len(set(want.values())) < 300


def test_many_null_ids(spark):
    texts = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *[F.hash("id", F.lit(k)) for k in range(9)]).alias("text"))
    twins = spark.range(50).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the very same text in many rows here").alias("text"))
    got = near_dedup.near_components(texts.unionByName(twins))
    assert got.count() == 100_050 and got.where("component_id is not null").isEmpty()
    left = near_dedup.drop_near_copies(twins.unionByName(spark.createDataFrame([(4, "the very same text in many rows here"), (None, "x")], "doc_id long, text string")))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "x"), (4, "the very same text in many rows here")]


def test_signatures_estimate_resemblance():
    rng = random.Random(6)
    a = words(rng, 600, 10**6).split()
    b = a[:500] + words(rng, 100, 10**6).split()
    x, y = (near_dedup.shingle_set(" ".join(t)) for t in (a, b))
    true = len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist()))
    same = (near_dedup.signature(x) == near_dedup.signature(y)).mean()
    assert abs(same - true) < 0.12


def sketch_of(text, k=256):
    """The k least hashes of the shingles, from Spark's own hash of the words; computed plainly."""
    w = WORD.findall(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def edits_by_hand(rows):
    """(id, text, edited, next) of every row in descending order of ids, null last; the last is followed by the first."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        out.append((i, text, text[: len(text) - cut] + after[:cut], after))
    return out


@pytest.mark.parametrize("cuts,bytes_", [(1000, 8 << 20), (1000, 400), (3, 200), (7, 1)])
def test_fingerprints_are_those_of_brute_force(spark, monkeypatch, cuts, bytes_):
    monkeypatch.setattr(fingerprints, "CUTS", cuts)
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", bytes_)
    monkeypatch.setattr(fingerprints, "MIN_BUCKETS", 4)
    rng = random.Random(7)
    ids = [*range(40), *(10**12 + rng.randint(0, 10**6) for _ in range(20)), -(2**63), 2**63 - 1, -5, None]
    rows = [(i, words(rng, rng.choice([0, 1, 4, 5, 30, 900]))) for i in ids] + [(3000, None), (3001, "😀é" * 50), (3002, " \t"), (3003, "tie")]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    want = edits_by_hand(rows)
    # exact sketches: hash every distinct shingle apart, sort and cut
    texts = sorted({t for _, *three in want for t in three})
    pairs = [(n, list(s)) for n, t in enumerate(texts) for s in set(sketch_of(t))]
    hashed = {}
    for r in spark.createDataFrame(pairs, "n int, s array<string>").select("n", F.xxhash64("s").alias("h")).collect():
        hashed.setdefault(r.n, []).append(r.h)
    exact = {t: sorted(hashed.get(n, []))[:256] for n, t in enumerate(texts)}
    text_of = lambda s: "".join(f"{h % 2**64:016x}" for h in s)

    def alike(a, b):
        union = sorted(set(a) | set(b))[:256]
        return len([h for h in union if h in set(a) and h in set(b)]) / len(union) if union else 1.0

    for i, text, edited, after in want:
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == text_of(exact[text]) and r.edited_fingerprint == text_of(exact[edited])
        assert abs(r.near_edited - alike(exact[text], exact[edited])) < 1e-12 and abs(r.near_next - alike(exact[text], exact[after])) < 1e-12
        a, b = shingles(text.upper()), shingles(edited.upper())
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.15


def test_fingerprints_of_repeated_ids_and_rows(spark):
    rng = random.Random(8)
    rows = [(5, words(rng, 20)) for _ in range(30)] + [(6, "the same row here again")] * 2500 + [(None, words(rng, 9)) for _ in range(20)] + [(i, words(rng, 12)) for i in range(10, 60)]
    got = fingerprints.with_next(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    # every row is followed by one, and follows one
    assert sorted((r.id, r.text) for r in got if r.id) == sorted((i, t) for i, t in rows if i)
    assert sorted(r.next_text for r in got) == sorted(t for _, t in rows)
    order = sorted({i for i, _ in rows if i}, reverse=True)
    by = {t: i for i, t in rows}
    for r in got:
        after = by[r.next_text]
        assert after == r.id or (order.index(r.id) + 1 == order.index(after) if r.id and after else r.id == 5 if after is None else after == 59)
    with pytest.raises(ValueError):
        fingerprints.with_next(docs(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string")))


def test_sketches_merge(spark):
    rng = random.Random(8)
    parts = [(g, words(rng, 300, 5000)) for g in (0, 0, 1)]
    df = spark.createDataFrame(parts, "g int, text string").select("g", fingerprints.sketch("text", 64).alias("sketch"), fingerprints.shingle_hashes("text").alias("every"))
    merged = {r.g: r.sketch for r in fingerprints.merge_all(df, ["g"], k=64).collect()}
    every = {}
    for r in df.collect():
        every.setdefault(r.g, set()).update(r.every)
    assert merged == {g: sorted(v)[:64] for g, v in every.items()}
    n = df.select(fingerprints.distinct_shingles(F.col("sketch"), 64).alias("n")).first().n
    assert 200 < n < 420
    same = df.select(fingerprints.containment(F.col("sketch"), F.col("sketch"), 64).alias("c")).first().c
    assert abs(same - 1) < 1e-9


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets(spark):
    hexes = "0123456789abcdef" * 3
    rng = random.Random(9)
    loose = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = ["", None, "é😀 password=abc secret: 'abcdef' x", "secret=token: abcdefgh", "API_KEY = zz" + hexes, f"{hexes}g{hexes[:23]}Z", "AKIA1234 AKIA" + "Q" * 16, "AKIAAKIA" + "B" * 12 + " AKIA" + "C" * 15, "token=" * 3, hexes * 200, f"see {loose} here", "internationalisation of the-long-hyphenated-words", "PassWord : hunter22\npasswd=\"hunter22\""]
    rows = list(enumerate(texts)) + [(90 + i, "Ordinary Words of The Running text, Identifiers like_this_one, LikeThat, and 2024 Numbers " * 9) for i in range(400)]
    got = {r.doc_id: r for r in secrets.secret_report(docs(spark, rows)).collect()}
    for i, t in rows:
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert f"markov:4:{4 + len(loose)}" in got[10].spans
    assert "markov" not in got[11].spans and not got[90].spans


def markov_by_hand(rows):
    """All spans of every text: base ones, and runs whose ratio under two models trained on these rows is large."""
    assign, access, hexes = ASSIGN, re.compile("AKIA[A-Z0-9]{16,}"), re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
    letters, pair_counts = secrets.ALPHABET, [{}, {}]

    def learn(which, string):
        for pair in {string[i : i + 2] for i in range(len(string) - 1)}:
            pair_counts[which][pair] = pair_counts[which].get(pair, 0) + 1

    for i, t in rows:
        t = t or ""
        for m in assign.finditer(t):
            if len(m[2]) >= 6:
                learn(0, m[2])
        for m in [*access.finditer(t), *hexes.finditer(t)]:
            learn(0, m[0])
        learn(0, base64.b64encode(hashlib.sha256(("" if i is None else str(i)).encode()).digest()).decode())
        for pattern in (assign, access, hexes):
            t = pattern.sub(" ", t)
        for word in re.findall("[A-Za-z0-9+/_=-]{4,}", t):
            learn(1, word)

    def chance(which, a, b):
        smooth = secrets.PRIOR / len(letters)
        return (pair_counts[which].get(a + b, 0) + smooth) / sum(pair_counts[which].get(a + c, 0) + smooth for c in letters)

    known = {}

    def ratio(run):
        total = 0
        for pair in zip(run, run[1:]):
            if pair not in known:
                known[pair] = math.log(chance(0, *pair)) - math.log(chance(1, *pair))
            total += known[pair]
        return total

    out = {}
    for i, t in rows:
        base = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base_spans(t or "").split(",") if x)]
        more = [(m.start(), m.end(), "markov") for m in re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", t or "") if ratio(m[0]) >= secrets.MIN_LLR]
        more = [m for m in more if not any(b[0] < m[1] and m[0] < b[1] for b in base)]
        rank = {"assign": 0, "access": 1, "hex": 2, "markov": 3}
        out[i] = ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base + more, key=lambda x: (x[0], rank[x[2]])))
    return out


def test_secrets_by_both_models_are_those_of_brute_force(spark):
    rng = random.Random(41)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    letters, low = secrets.ALPHABET[:-1], "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(200):
        parts = ["".join(rng.choice(["ra", "ti", "on", "the", "er", "in", "Al", "es"]) for _ in range(rng.randint(2, 9))) for _ in range(60)] + ["snake_case_name", "getValueOf"] * 3
        parts += [pick(letters, rng.randint(16, 60))] * (rng.random() < 0.3) + [f"token={pick(letters, 30)}"] * (rng.random() < 0.4)
        parts += [pick(low, 40)] * (rng.random() < 0.1) + ["Donaudampfschifffahrtsgesellschaft", pick("0123456789abcdef", 32)] * (rng.random() < 0.1)
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(900, None), (901, "secret=abcdefgh12 " * 4000), (902, pick(letters, 5_000))]
    want = markov_by_hand(rows)
    got = {r.doc_id: r.spans for r in secrets.secret_report(docs(spark, rows)).collect()}
    assert got == want and sum("markov" in x for x in want.values()) >= 5


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no test tables")
def test_models_of_the_documents_table_tell_random_strings(spark):
    model = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = random.Random(5)
    strings = [(kind, "".join(rng.choice(letters) for _ in range(24))) for kind, letters in (("any", secrets.ALPHABET[:64]), ("hex", "0123456789abcdef"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) for _ in range(100)]
    df = spark.createDataFrame(strings, "kind string, s string")
    got = df.select("kind", (secrets.log_ratio(F.col("s"), model) >= secrets.MIN_LLR).cast("int").alias("hit")).groupBy("kind").agg(F.avg("hit").alias("share")).collect()
    share = {r.kind: r.share for r in got}
    assert min(share["any"], share["hex"], share["upper"]) >= 0.95, share


def test_a_long_run_is_scanned_in_time_that_grows_with_it(spark):
    rng = random.Random(12)
    run = "".join(rng.choice(secrets.ALPHABET) for _ in range(1_000_000))
    rows = [(1, f"see {run} and {run[:40]}"), (2, run[:2000])]
    began = time.time()
    got = {r.id: r for r in secrets.scan_secrets(docs(spark, rows), model=[0.01] * len(secrets.ALPHABET) ** 2).collect()}
    pairs = {r.pair for r in secrets._pairs(docs(spark, rows[:1]).select(F.lit(run).alias("s")), "s").collect()}
    assert time.time() - began < 30
    assert [(s.start, s.stop) for s in got[1].spans if s.kind == "markov"] == [(4, 1_000_004)] and len(got[2].spans) == 1
    assert pairs == {a + b for a, b in zip(run, run[1:])}


def test_ratio_of_a_token_is_the_sum_over_its_pairs(spark):
    rng = random.Random(13)
    n = len(secrets.ALPHABET)
    model = [round(rng.uniform(-3, 3), 6) for _ in range(n * n)]
    tokens = ["", "a", "ab", "é", "aéb", "A-_=/+z"] + ["".join(rng.choice(secrets.ALPHABET) for _ in range(k)) for k in (16, 300)]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    for r in df.select("t", secrets.log_ratio(F.col("t"), model).alias("v")).collect():
        places = [secrets.ALPHABET.find(c) for c in r.t]
        want = sum(model[a * n + b] for a, b in zip(places, places[1:]) if a >= 0 and b >= 0)
        assert math.isclose(r.v, want, abs_tol=1e-9)


def test_a_row_repeated_often_gives_one_set(spark, monkeypatch):
    rng = random.Random(14)
    base = words(rng, 200, 10**6)
    near = base.rsplit(" ", 1)[0] + " other"
    rows = [(1, base)] * 500 + [(2, near), (3, words(rng, 200, 10**6))]
    seen = []
    whole = near_dedup._sets_of
    monkeypatch.setattr(near_dedup, "_sets_of", lambda *a: seen.append(whole(*a)) or seen[-1])
    made = []
    write = near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df, name: made.append((name, out := write(df, name))) or out)
    got = near_dedup.near_components(docs(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)} and len(got) == 502
    assert [df.count() for name, df in made if name == "sets"] == [2]


def test_the_largest_id_is_an_id(spark):
    last = (1 << 63) - 1
    text = "one two three four five six seven"
    got = near_dedup.near_components(docs(spark, [(last, text), (None, text), (None, "alone by itself")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [(str(last), str(last)), ("None", str(last)), ("None", "None")]
    only = near_dedup.near_components(docs(spark, [(last, text)])).first()
    assert only.component_id == last and only.kept
    left = near_dedup.drop_near_copies(docs(spark, [(last, text), (None, text)])).collect()
    assert [r.doc_id for r in left] == [last]
