"""SentencePiece, toxicity, chat, WARC and main text: round trips, brute force, held-out accuracy."""

import os
import random
import time
import zlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from spikeframe.llm import chat, main_text, pieces, toxicity, warc

DOCS = "doc_id long, text string"
MODEL = pieces.DEFAULT_MODEL
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer file")


@needs_model
def test_pieces_are_the_librarys():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = pieces.Codec(pieces.Pieces.load(MODEL))
    rng = random.Random(1)
    signs = " ▁\tabcdefgh.,_0123éßçǅ\n日本語😀\x00ing tion the  "
    texts = ["", " ", "   a", "\n\n a", "a" * 200, " " * 37 + "b", "_.,;", "x_. y", "a\x00b", "word. word, Word"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    assert codec.encode(texts) == library.encode(texts)
    assert [codec.decode(i) for i in codec.encode(texts)] == [t.replace("▁", " ") for t in texts]


@needs_model
@pytest.mark.parametrize("few", [0, 10**9])
def test_units_go_together_or_alone(monkeypatch, few):
    import sentencepiece

    monkeypatch.setattr(pieces, "FEW", few)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = pieces.Codec(pieces.Pieces.load(MODEL))
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeinrst  ,.-é漢字か0") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    texts += ["".join(rng.choice("abcdeinrst") for _ in range(900)), "a" * 1500, "漢字" * 700, "." * 300, "ab" * 40 + "é" + "ion" * 40, " " * 99 + "ing" * 99 + " "]
    assert codec.encode(texts) == library.encode(texts)
    assert all(len(u) <= pieces.LONGEST_REMEMBERED for u in codec.memory)


@needs_model
def test_long_texts_without_blanks():
    codec = pieces.Codec(pieces.Pieces.load(MODEL))
    rng = random.Random(3)
    texts = ["漢字かな交じり文" * 20_000, "".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), "a" * 50_000]
    began = time.process_time()
    ids = codec.encode(texts)
    assert time.process_time() - began < 20 and [codec.decode(i) for i in ids] == texts


def test_unigram_takes_the_best_sum():
    names = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba"]
    scores = [0.0, -3.0, -2.0, -2.5, -3.0, -3.2, -2.9, -9.0]
    codec = pieces.Codec(pieces.Pieces(pieces.UNIGRAM, names, scores, [2] + [1] * 7))

    def best(text):
        paths = [[] for _ in range(len(text) + 1)]
        top = [0.0] + [-np.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in names[1:]:
                    value = top[i] + scores[names.index(text[i:j])]
                    if value > top[j]:
                        top[j], paths[j] = value, [*paths[i], names.index(text[i:j])]
        return paths[-1]

    texts = ["abab", "aab", "babaab", "a", *("".join(random.Random(k).choices("ab", k=9)) for k in range(40))]
    assert codec.encode(texts) == [best("▁" + t) for t in texts]  # many of one length together
    for text in texts:
        assert pieces.Codec(codec.model).encode([text])[0] == best("▁" + text)  # one alone


@needs_model
def test_encode_documents(spark):
    rows = [(1, "some text here"), (2, None), (3, ""), (3, ""), (None, "é▁x"), (5, "long " * 5000)]
    got = pieces.encode_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[2].round_trip
    assert by[1].round_trip and not by[None].round_trip and by[5].n_tokens >= 5000
    assert pieces.encode_documents(spark.createDataFrame([], DOCS)).isEmpty()
    extra = spark.createDataFrame([("x", 1)], "text string, ids int")
    assert pieces.encode_column(extra).columns == ["text", "ids", "token_ids"]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.2
        words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["gronk", "Blorf", "zwump"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(900, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], DOCS)
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(0, rows[0][2]), (77777, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(got) == len(rows) + 2 and got[9000].score == got[9001].score
    held = [(i, b) for i, _, b in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) <= len(held) + 2
    assert np.mean([got[i].predicted == b for i, b in held]) > 0.95
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(r.predicted == 0 for r in got.values())


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/labels.parquet"), reason="no test tables")
def test_toxicity_of_the_documents_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.toxicity_report(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert len(toxic) > 50 and len(clean) > 500
    assert np.mean([r.predicted for r in toxic]) >= 0.75 and np.mean([r.predicted for r in clean]) <= 0.01
    ranked = sorted(got, key=lambda r: r.score)
    below = sum(sum(c.toxic == 0 for c in ranked[:k]) for k, r in enumerate(ranked) if r.toxic == 1)
    assert below / (len(toxic) * len(clean)) >= 0.97


def test_training_counts_and_ratios_are_those_of_brute_force(spark, monkeypatch):
    rows = toxic_rows(300, 9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "regress", lambda rows, y, share, ratio: seen.update(rows=rows, y=y, ratio=ratio))
    toxicity.train(docs, labels)
    stamp = np.zeros(1 << toxicity.BITS, dtype=np.int64)
    used = [(sorted(toxicity.features(t, stamp).tolist()), b) for i, t, b in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts, sizes = [{}, {}], [sum(b == c for _, b in used) for c in (0, 1)]
    for slots, b in used:
        for s in slots:
            counts[b][s] = counts[b].get(s, 0) + 1
    ratio = {}
    for s in set(counts[0]) | set(counts[1]):
        n0, n1 = counts[0].get(s, 0), counts[1].get(s, 0)
        share = (n0 + n1) / sum(sizes)
        error = max(share * (1 - share), 1e-9) ** 0.5 * (1 / sizes[0] + 1 / sizes[1]) ** 0.5
        if n0 + n1 >= toxicity.MIN_ROWS and abs(n1 / sizes[1] - n0 / sizes[0]) / error >= toxicity.MIN_Z:
            whole = [sum(c.values()) + (1 << toxicity.BITS) for c in counts]
            ratio[s] = np.log((n1 + 1) / whole[1]) - np.log((n0 + 1) / whole[0])
    assert {s: float(seen["ratio"][s]) for s in np.flatnonzero(seen["ratio"])} == pytest.approx(ratio, rel=1e-5) and ratio
    assert sorted((int(b), r.tolist()) for r, b in zip(seen["rows"], seen["y"])) == sorted((b, [s for s in slots if s in ratio]) for slots, b in used)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_report(docs, none).collect()} == {0.5}
    assert toxicity.toxicity_report(docs.limit(0), none).isEmpty()


@pytest.mark.parametrize("piece", [1, 3, 4, 5, 700, 5001])
def test_features_do_not_depend_on_pieces(monkeypatch, piece):
    stamp, rng = np.zeros(1 << toxicity.BITS, dtype=np.int64), random.Random(4)
    texts = ["", "a", "ab", "abc", "".join(rng.choice("abcdefghé😀Z ") for _ in range(5000)), "the same prose again. " * 200]
    whole = [sorted(toxicity.features(t, stamp).tolist()) for t in texts]
    assert all(len(set(w)) == len(w) for w in whole) and len(whole[4]) > 5000
    monkeypatch.setattr(toxicity, "PIECE", piece)
    assert whole == [sorted(toxicity.features(t, stamp).tolist()) for t in texts]


def test_toxicity_features_are_all_ngrams():
    stamp, text = np.zeros(1 << toxicity.BITS, dtype=np.int64), "Some text, some Text"
    padded = f" {text.lower()} "
    grams = {padded[i : i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}
    assert len(toxicity.features(text, stamp)) == len(grams)  # no two of these few share a slot


def test_toxicity_of_labels_that_disagree(spark):
    rows = toxic_rows(300, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [rows[1][:2]] * 5, DOCS)
    labels = [(i, b) for i, _, b in rows]
    bad = [i for i, b in labels if b][:10]
    first = spark.createDataFrame(labels + [(i, 0) for i in bad] + [(None, 1)] * 3, "doc_id long, toxic int")
    a = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, first.repartition(5)).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert a == b  # an id labelled 0 and 1 counts as 1


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "é😀"), (1, 3, None, None), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, 300, "ann", "late"), (3, 1, "ann", "early"), (3, None, "bob", "last"), (3, 1, "ann", "early")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.render(turns.withColumn("part", F.lit(0))).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (None, "ann"), (3, "ann"), (3, "bob")}
    text = got[1, "bob", 0].text
    assert text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi <\\|im_end|><|im_end|>\n<|im_start|>assistant\né😀<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    a, b = map(int, got[1, "bob", 0].mask.split(":"))
    assert text[a:b] == "é😀<|im_end|>"
    whole = [got[k] for k in sorted(k for k in got if k[:2] == (3, "ann"))]
    full, spans = "".join(r.text for r in whole), [tuple(map(int, s.split(":"))) for r in whole for s in filter(None, r.mask.split(","))]
    assert [full[a:b] for a, b in spans] == ["early<|im_end|>", "early<|im_end|>", "late<|im_end|>"]
    assert chat.render(turns.limit(0)).isEmpty()


@pytest.mark.parametrize("part, hot", [(3, 1000), (256, 0), (256, 3)])  # all dialogues are hot, none, the one of three in five turns alone
def test_chat_parts_are_cut_from_the_whole(spark, monkeypatch, part, hot):
    monkeypatch.setattr(chat, "PART_TURNS", part)
    monkeypatch.setattr(chat, "HOT_SHARE", hot)
    rng = random.Random(part)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, None, *range(40)]), rng.choice(["ann", "bob", "system", None]), "é" * rng.randint(0, 9)) for _ in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {}
    for r in chat.render(turns).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    names = {None: "user", "system": "system"}
    for conv in (1, 2, None):
        for who in ("ann", "bob"):
            head = lambda role: f"<|im_start|>{'assistant' if role == who else names.get(role, f'user name={role}')}\n"  # noqa: B023, E731
            own = sorted(((t is None, t or 0, head(role), f"{text}<|im_end|>", role == who) for c, t, role, text in rows if c == conv))
            parts = sorted(got[conv, who], key=lambda r: r.part)
            assert [r.part for r in parts] == list(range(-(-len(own) // part)))
            full, at, mask = "".join(h + b + "\n" for _, _, h, b, _ in own), 0, []
            for _, _, h, b, mine in own:
                mask += [f"{at + len(h)}:{at + len(h) + len(b)}"] * mine
                at += len(h) + len(b) + 1
            assert "".join(r.text for r in parts) == full and ",".join(r.mask for r in parts if r.mask) == ",".join(mask)
            for k, r in enumerate(parts):
                assert r.n_chars == len(r.text) and full[r.start : r.start + r.n_chars] == r.text and r.n_turns == len(own[k * part : (k + 1) * part])


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big = "<p>" + "text " * 60 + "</p>"
    rows = [(i, f"http://x/{i}\r\nA: b", big + str(i % 40)) for i in range(90)] + [(500, None, None), (501, "u", ""), (502, "é", "short"), (503, "é", "short"), (7, "again", big + "7"), (None, "n", big + "8"), (600, "l", big * 3000)]
    pages = spark.createDataFrame(rows, PAGES)
    folder = f"file://{warc.shared_dir(spark)}/archives-test"
    manifest = warc.write_archives(pages, folder)
    got = warc.read_archives(manifest, payload=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id] if r.page_id is not None else big + "8")
        if r.record_type == "response":
            assert bytes(r.payload) == html.get(r.page_id)
    assert by[45][0].record_type == "revisit" and by[45][0].refers_to == 5
    assert sorted(r.record_type for r in by[7]) == ["response", "revisit"] and by[None][0].refers_to == 8
    assert {r.record_type for i in (500, 501, 502, 503) for r in by[i]} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder)).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 5, 15, 16, 40])
def test_archives_of_any_size_hold_a_dictionary(tmp_path, n):
    for k, records in enumerate(([b"WARC/1.1 the very same record " * 9] * n, [os.urandom(300) + b"record" for _ in range(n)], [b"x"] * n)):
        path = warc.ArchiveWriter(f"file://{tmp_path}", records).close()["path"].removeprefix("file://")
        with open(path, "rb") as f:
            assert list(warc.frames(f)) == records, k
        data = open(path, "rb").read()
        size = int.from_bytes(data[4:8], "little")
        trained = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        assert data[:4] == warc.SKIPPABLE_MAGIC.to_bytes(4, "little") and trained[:4] == bytes.fromhex("37a430ec")  # a dictionary by format


def test_names_of_records_are_unique(spark):
    big = "<p>" + "text " * 60 + "</p>"
    rows = [(7, "u", big), (7, "u", big), (7, "v", big + "!"), (8, "u", big), (None, "u", big), (None, None, None), (None, None, None), (9, "u", "small"), (9, "u", "small")] + [(11, "w", big + "?")] * 300
    pages = spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit(1), "digest": F.lit("d"), "row": F.lit(2), "id": F.lit(3)})
    manifest = warc.write_archives(pages, f"file://{warc.shared_dir(spark)}/names-test")
    names, refers = [], []
    for r in manifest.collect():
        with open(r.path.removeprefix("file://"), "rb") as f:
            for record in warc.frames(f):
                head = record.partition(b"\r\n\r\n")[0].decode().split("\r\n")
                names += [x.split(": ", 1)[1] for x in head if x.startswith("WARC-Record-ID")]
                refers += [x.split(": ", 1)[1] for x in head if x.startswith("WARC-Refers-To")]
    assert len(names) == len(set(names)) == len(rows)
    assert set(refers) <= set(names) and len(refers) == 3 + 299
    got = warc.read_archives(manifest).collect()
    assert sum(r.record_type == "response" for r in got if r.page_id == 11) == 1 and len(got) == len(rows)
    assert all(r.refers_to == (11 if r.page_id == 11 else 7) for r in got if r.record_type == "revisit")


def test_archive_holds_its_dictionary(tmp_path):
    records = [warc.record_bytes(i, "http://u", (f"<html><body>page number {i} of the archive " * 5 + "".join(random.Random(i).choices("abcdef <>/", k=300))).encode(), "d", i, True, False, "2024-01-01T00:00:00Z") for i in range(200)]
    done = warc.ArchiveWriter(f"file://{tmp_path}", records)
    path = done.close()["path"].removeprefix("file://")
    data = open(path, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_MAGIC
    with open(path, "rb") as f:
        assert list(warc.frames(f, chunk=37)) == records
    with pytest.raises(zstandard.ZstdError), open(path, "rb") as f:
        f.seek(8 + int.from_bytes(data[4:8], "little"))
        zstandard.ZstdDecompressor().stream_reader(f).read()
    with open(path, "r+b") as f:
        f.truncate(len(data) - 5)
    with pytest.raises(ValueError), open(path, "rb") as f:
        list(warc.frames(f))


@pytest.fixture(scope="module")
def model():
    return main_text.default_model()


def test_main_text_of_unseen_layouts(model):
    layouts, kept, wrong, missed = main_text.Layouts(12345), 0, 0, 0
    for _ in range(120):
        page = main_text.parse(layouts.page())
        x = main_text.features(page)
        keep = main_text.decode(page, model.mixed.predict(x), model.article.predict(x))
        for at, text in filter(None, page.runs):
            n, good = len(text.strip()), layouts.SIGN in text
            kept += n * (good and keep[at])
            wrong += n * (not good and keep[at])
            missed += n * (good and not keep[at])
    assert kept / (kept + wrong) > 0.95 and kept / (kept + missed) > 0.95


def test_main_text_cases(spark, model):
    words = "The quick fox, said the man, was not so quick. " * 6
    rows = [
        (1, "u", f"<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Tea &amp;\n time</h1><p>{words}<p>Second  &eacute;<br>line<script>var x='</p>'</script></article><footer>&copy; me</footer>"),
        (2, "u", None),
        (3, "u", ""),
        (4, "u", "<div class=cookie-notice>We use cookies</div>"),
        (5, "u", "<<<>>><p <b></p></div></article>&#xZZ; &#0; <!-- never closed"),
        (6, "u", "<div>" * 3000 + "deep" + "</p>" * 10),
        (6, "u", "<div>" * 3000 + "deep" + "</p>" * 10),
    ]
    got = main_text.main_text(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(1)), model=model)
    assert got.columns == ["page_id", "url", "html", "text"]
    out = [(r.page_id, r.text) for r in got.collect()]
    assert len(out) == len(rows)
    assert dict(out)[1] == f"Tea & time\n{words.strip()}\nSecond é line"
    assert dict(out)[2] == dict(out)[3] == dict(out)[4] == ""
    assert main_text.main_text(spark.createDataFrame([], PAGES), model=model).isEmpty()


@pytest.mark.parametrize("source", ["<a " + '"' * 10_001 + "<p>x", "<a " + "\"'" * 10_001 + ">y<p>x", "<a " * 100_000, "<a " * 100_000 + ">x", '<a "><a x" ' * 30_000 + "x", "<![CDATA[>" * 30_000 + "x", "<table>" + "<span>" * 10_000 + "</x>" * 10_000 + "x", "<p><table>" + "<span>" * 8_000 + "<div>" * 8_000 + "x", "<ul>" + "<li>x" * 10_000])
def test_pages_are_parsed_in_one_go(source):
    began = time.process_time()
    page = main_text.parse(source)
    main_text.features(page)
    assert time.process_time() - began < 2 and "".join(run[1] for run in page.runs if run).rstrip()[-1] in "xa"


def test_quotes_that_are_not_closed():
    seen = lambda source: "".join(run[1] for run in main_text.parse(source).runs if run)
    assert seen('<div title="foo>bar <p>para</p> text') == "bar para text"
    assert seen("<p class='a>b'>one<p title=\"x>y\">two") == "onetwo"


class Article(HTMLParser):
    """The article element's text, by the parser of the standard library."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.hidden, self.blocks, self.now = False, 0, [], ""
        self.feed(source)
        self.close()
        self.end()

    def end(self):
        line, self.now = " ".join(self.now.split()), ""
        self.blocks += [line] * bool(line)

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.hidden += tag in ("script", "style")
        if tag in ("p", "h1", "h2", "div", "article", "footer"):
            self.end()
        self.now += " " * (tag == "br" and self.inside)

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "div", "article", "footer"):
            self.end()
        self.inside &= tag != "article"
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        self.now += data if self.inside and not self.hidden else ""


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="no test tables")
def test_main_text_of_the_pages_table(spark, model):
    """The pages of the test tables are labelled by their markup: an article element holds the main text."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_text.main_text(rows, model=model).collect()}
    want = {r.page_id: "\n".join(Article(r.html or "").blocks) for r in rows.collect()}
    wrong = [i for i in want if want[i] != got[i]]
    assert not wrong


SHORT = "Rain fell on the harbour all night, and the boats stayed where they were."
LONG = ("Long reports about rivers, towns and roads fill this page, and nobody reads them to the end. " * 8).strip()
NAV, FOOT = "<nav><ul><li><a href=/>Home</a></ul></nav>", "<footer>&copy; me</footer>"


@pytest.mark.parametrize(
    "page, blocks",
    [
        (f"<body><article><p>{SHORT}</p></article></body>", [SHORT]),
        (f"<html><body><p>{SHORT}</p></body></html>", [SHORT]),
        (f"<body>{NAV}<article><h1>A title</h1><p><a href=/x>{LONG}</a></p><p>{LONG}</p></article>{FOOT}</body>", ["A title", LONG, LONG]),
        (f"<body><article><p>{LONG}</p><div class=comment-policy-analysis><p>{LONG}</p></div><p>{LONG}</p></article></body>", [LONG] * 3),
        (f"<body>{NAV}<article><h1>Rules</h1><p>{LONG}</p><div class='comment-policy-analysis'>{LONG}</div></article>{FOOT}</body>", ["Rules", LONG, LONG]),
        (f"<body><article><p>{LONG}</p><section class=comments><div class=comment>nice one, thanks</div><div class=comment>{SHORT}</div></section></article></body>", [LONG]),
        (f"<body>{NAV}<div class=cookie-notice>We use cookies</div></body>", []),
    ],
)
def test_short_pages_linked_paragraphs_and_names_of_several_words(model, page, blocks):
    assert main_text.extract([page], model) == ["\n".join(blocks)]


def test_tokens_of_attributes():
    roles, slots, others = main_text._tokens(' class="comment-policy analysis2" id=nav')
    names = list(main_text.ROLES)
    assert roles == 1 << names.index("talk") | 1 << names.index("nav") and others == 2
    assert slots == 1 << zlib.crc32(b"policy") % main_text.SLOTS | 1 << zlib.crc32(b"analysis") % main_text.SLOTS
    assert main_text._tokens(' data-x="comment"') == (0, 0, 0)


def test_letters_that_grow_in_lower_case_before_scripts():
    head = "<p>" + "\u0130" * 400 + "</p>"
    page = main_text.parse(f"{head}<script>var a = 1;</SCRIPT><script>var b = 2;</script><p>kept &gt; text</p><p>more</p><b>x</b>")
    seen = "".join(run[1] for run in page.runs if run)
    assert seen == "\u0130" * 400 + "kept > textmorex"


@pytest.mark.parametrize("n", [10, 62, 63, 64, 500])
def test_share_of_like_siblings_at_every_size(n):
    page = main_text.parse("<p>some text</p>" * n + "<div>a notice</div>" + "<p>more</p>")
    alike = main_text.features(page)[:, -5]
    want = [1.0] + [sum(y.tag == x.tag for y in page.nodes[1:]) / (n + 2) for x in page.nodes[1:]]
    assert np.allclose(alike, want) and min(want) == 1 / (n + 2)


def test_labels_of_nodes_never_contradict(model):
    page = main_text.parse(main_text.Layouts(5).page())
    rng = np.random.default_rng(1)
    n = len(page.nodes)
    keep = main_text.decode(page, np.full(n, 1e-9), rng.random(n))
    assert len(set(keep)) == 1  # with no mixed nodes the whole page is of one kind
