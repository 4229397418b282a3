"""The corpus pipeline, stage by stage, against brute force on the rows that each stage was given."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from spikeframe.llm import pieces, toxicity
from test_tables import WORD, components, fill, words
from test_texts import toxic_rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not os.path.exists(pieces.DEFAULT_MODEL), reason="no tokenizer file")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with toxic ones, exact and near copies, nulls, empty texts and one hot source; labels of most."""
    rng = random.Random(31)
    texts = [t for _, t, _ in toxic_rows(500, 6)]
    labels = [(i, bad) for i, _, bad in toxic_rows(500, 6)]
    for _ in range(40):
        base = words(rng, 90, 10**6).split()
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    texts += [rng.choice(texts) for _ in range(80)] + ["", "", None, " \n ", "x", "X"]
    rows = [(i, t, "en", rng.choice([None, "b", *["hot"] * 6, "é"]), len(t or "")) for i, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, bad) for i, bad in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def outputs(spark, tables):
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = f"{tables}/stage{k}"
        stage(spark, docs, tables).write.parquet(at)
        before, docs = docs, spark.read.parquet(at)
        out.append((name, before.collect(), docs.collect(), docs.columns))
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_and_columns(outputs):
    assert [o[0] for o in outputs] == ["toxicity", "exact dedup", "near dedup", "mix sources", "sentencepiece"]
    assert all(o[3] == COLUMNS for o in outputs[:-1]) and outputs[-1][3] == [*COLUMNS, "token_ids", "n_tokens"]


def test_toxic_documents_go(spark, tables, outputs):
    _, before, after, _ = outputs[0]
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    said = {r.doc_id: r.predicted for r in toxicity.toxicity_report(docs, labels).collect()}
    assert ids(after) == sorted(i for i, p in said.items() if p == 0)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = [r.doc_id for r in before if r.doc_id < 500 and r.doc_id not in toxic]
    kept = set(ids(after))
    assert len(toxic & kept) <= len(toxic) // 20 and sum(i not in kept for i in clean) <= len(clean) // 50


def test_exact_copies_go(outputs):
    _, before, after, _ = outputs[1]
    last = {}
    for r in before:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", -1))
    assert ids(after) == sorted(last.values()) and set(after) <= set(before)


def test_near_copies_go(outputs):
    _, before, after, _ = outputs[2]
    want, sets = components([(r.doc_id, r.text) for r in before], 80)
    assert ids(after) == sorted(i for i in want if want[i] == i) and set(after) <= set(before)
    assert len(after) < len(before)


def test_mix_is_that_of_brute_force(outputs):
    _, before, after, _ = outputs[3]
    by = {}
    for r in before:
        by.setdefault(r.source, []).append(r)
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    size = lambda r: len(WORD.findall(r.text or ""))
    want = []
    for s, target in zip(order, fill([sum(map(size, by[s])) for s in order]), strict=True):
        total, budget, before_it = sum(map(size, by[s])), int(target + 0.5), 0
        for r in sorted(by[s], key=lambda r: (hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest(), r.doc_id)):
            n = size(r)
            last = max(0, min(n, budget % total - before_it)) if total else 0
            before_it += n
            for part in [n] * (budget // total if total and n else 0) + [last] * (last > 0):
                text = r.text if part == n else r.text[: [m.end() for m in WORD.finditer(r.text)][part - 1]]
                want.append((r.doc_id, text, r.lang, r.source, len(text)))
    key = lambda row: (row[0], row[1])
    assert sorted(map(tuple, after), key=key) == sorted(want, key=key)


def test_tokens_are_the_librarys(outputs):
    import sentencepiece

    _, before, after, _ = outputs[4]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    assert sorted(tuple(r[:5]) for r in after if r.source) == sorted(tuple(r) for r in before if r.source) and len(after) == len(before)
    for r in after:
        assert list(r.token_ids) == library.encode(r.text) and r.n_tokens == len(r.token_ids)


def test_run_is_all_stages(spark, tables, outputs):
    got = corpus_pipeline.run(spark, tables)
    rows = lambda df: sorted(map(str, df))
    assert got.columns == outputs[-1][3] and rows(got.collect()) == rows(outputs[-1][2])


def test_stages_of_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.lit(1) for c in ("id", "tag", "print", "key", "run", "part")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(9), tables).columns == docs.columns


CLASHES = ("token_ids", "n_tokens", "__score", "__print_of_row", "__digest_of_row", "__words", "__part", "__id", "__source", "__print", "__passes", "__last", "__size", "c0", "id", "text_", "before", "taken", "size")


def test_stages_with_clashing_columns(spark, tables, outputs):
    """Columns of any name keep their values; token_ids and n_tokens are replaced."""
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(f"{tables}/stage{k - 1}" if k else f"{tables}/documents.parquet")
        extra = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASHES})
        got = stage(spark, extra, tables)
        keep = [c for c in CLASHES if k < 4 or c not in ("token_ids", "n_tokens")]
        assert set(got.columns) == {*docs.columns, *CLASHES}
        rows = got.collect()
        assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in keep)
        assert sorted(str(r.asDict()["text"]) for r in rows) == sorted(str(r.text) for r in outputs[k][2])
        assert k < 4 or all(r.n_tokens == len(r.token_ids) for r in rows)
