"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order models over one alphabet, of random strings and of ordinary
identifiers, are trained from labelled samples: the values that the fixed patterns
match and digests of ids are the random strings, the other runs of identifier
characters the ordinary ones. A run whose log-likelihood ratio is large enough is a
further span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, with_defaults

# The patterns of the base kinds, in the order that breaks ties of starts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: What the pattern of assignments can't match without, for a cheap look first.
HINTS = ("passw", "secret", "token", "api")
MIN_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: A run is a secret from this log-likelihood ratio on, in nats.
MIN_LLR = 12.0
#: Rows for training, about: their share of the table is taken by a hash of id and text.
SECRET_ROWS, ORDINARY_ROWS = 100_000, 4_000
#: Weight of a uniform distribution in each row of transitions.
PRIOR = 20.0

SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _located(text: Column, pattern: str, wanted, kind: str, rank: int) -> Column:
    """Spans of the matches that wanted(matches) keeps (an array of booleans); text is split at
    every match, so starts are sums of the lengths before."""

    def of(found: Column) -> Column:
        lengths = F.transform(found["matches"], lambda m, i: (F.char_length(F.get(found["gaps"], i)) + F.char_length(m)).cast("long"))

        def spans(before: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                begin = F.get(before, i) + F.char_length(F.get(found["gaps"], i))
                return F.struct(begin.cast("int").alias("start"), F.lit(rank).alias("rank"), (begin + F.char_length(m)).cast("int").alias("stop"), F.lit(kind).alias("kind"))

            kept = F.filter(F.transform(found["matches"], lambda m, i: F.struct(F.get(found["keep"], i).alias("keep"), span(m, i).alias("span"))), lambda x: x["keep"])
            return F.transform(kept, lambda x: x["span"])

        return let(running(lengths), spans).cast(SPAN)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.struct(F.split(text, pattern).alias("gaps"), matches.alias("matches"), wanted(text, matches).alias("keep"))
    return let(pieces, lambda p: F.when(F.exists(p["keep"], lambda x: x), of(p)).otherwise(_none()))


def _long_enough(text: Column, _: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= MIN_VALUE)


def _all(_: Column, matches: Column) -> Column:
    return F.transform(matches, lambda m: F.lit(True))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, runs, assign, access, hex): runs of 16 or more identifier characters and the base spans."""
    rows = docs.select(F.col(id_col).alias("id"), with_defaults(text_col).alias("text"))
    runs = F.regexp_extract_all("text", F.lit(RUN), F.lit(0))

    def spans(low: Column, runs: Column) -> Column:
        text = F.col("text")
        hinted = F.lit(False)
        for hint in HINTS:
            hinted = hinted | F.contains(low, F.lit(hint))
        has = lambda pattern: F.exists(runs, lambda r: r.rlike(pattern))
        return F.struct(
            runs.alias("runs"),
            F.when(hinted, _located(text, ASSIGN, _long_enough, "assign", 0)).otherwise(_none()).alias("assign"),
            F.when(has(ACCESS), _located(text, ACCESS, _all, "access", 1)).otherwise(_none()).alias("access"),
            F.when(has(HEX), _located(text, HEX, _all, "hex", 2)).otherwise(_none()).alias("hex"),
        )

    found = let(F.struct(F.lower("text").alias("low"), runs.alias("runs")), lambda s: spans(s["low"], s["runs"]))
    return rows.withColumn("found", found).select("id", "text", "found.*")


def _pairs(strings: DataFrame, col: str) -> DataFrame:
    """In how many strings neighbouring characters occur, both of ALPHABET: at most its length squared rows.

    A string counts once for each pair that it has anywhere, so that no single long one decides.
    """
    # one look at each character, however long the string
    two = let(F.split(col, ""), lambda chars: F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat(F.get(chars, i - 1), F.get(chars, i))))
    pairs = strings.where(F.char_length(col) > 1).select(F.explode(F.array_distinct(two)).alias("pair"))
    return pairs.groupBy("pair").count()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", secret_rows: int = SECRET_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> list[float]:
    """Log-likelihood ratio of each transition, random against ordinary, row by row of ALPHABET."""
    total = max(docs.count(), 1)

    def sample(rows: int) -> DataFrame:
        if rows >= total:
            return docs
        return docs.where(F.pmod(F.xxhash64(F.lit("train"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) < int(rows / total * (1 << 30)))

    cut = lambda span: F.substring(F.col("text"), span["start"] + 1, span["stop"] - span["start"])
    secrets = _scan(sample(secret_rows), id_col, text_col).select("text", F.explode(F.concat("assign", "access", "hex")).alias("span"))
    value = F.when(F.col("span.kind") == "assign", F.regexp_extract(cut(F.col("span")), ASSIGN, 2)).otherwise(cut(F.col("span")))
    # digests of ids are random strings over the whole alphabet
    digest = F.base64(F.unhex(F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"), 256)))
    random = _pairs(secrets.select(value.alias("s")).unionByName(sample(ordinary_rows).select(digest.alias("s"))), "s")
    bare = with_defaults(text_col)
    for pattern in (ASSIGN, ACCESS, HEX):
        bare = F.regexp_replace(bare, pattern, " ")
    ordinary = sample(ordinary_rows).select(F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("s"))
    counts = [{r.pair: r["count"] for r in df.collect()} for df in (random, _pairs(ordinary, "s"))]
    n = len(ALPHABET)
    model: list[float] = []
    for a in ALPHABET:
        logs = []
        for count in counts:
            row = [count.get(a + b, 0) + PRIOR / n for b in ALPHABET]
            logs.append([math.log(x / sum(row)) for x in row])
        model += [x - y for x, y in zip(*logs, strict=True)]
    return model


def log_ratio(token: Column, model: list[float]) -> Column:
    """Sum of the model's ratios over the token's transitions; those with a character outside ALPHABET count 0."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def total(at: Column) -> Column:
        known = lambda i: (F.get(at, i - 1) > 0) & (F.get(at, i) > 0)
        ratio = lambda i: F.when(known(i), F.get(table, (F.get(at, i - 1) - 1) * len(ALPHABET) + F.get(at, i) - 1)).otherwise(0.0)
        return F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(0.0), lambda acc, i: acc + ratio(i))

    return F.when(F.char_length(token) > 1, let(places, total)).otherwise(0.0)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None, min_llr: float = MIN_LLR) -> DataFrame:
    """Spans of secrets in every row: id, text, base and spans (arrays of start, rank, stop, kind).

    Positions are code points, ends exclusive. base holds the matches of the fixed patterns; spans
    also those of the model (kind "markov") that touch none of them: runs of 16 or more characters
    of ALPHABET whose ratio is min_llr or more. A null or empty text has none, a long one is read to
    its end; repeated rows each get their own. Other columns are not read. An empty table gives no rows.
    """
    model = model if model is not None else train(docs, id_col, text_col)
    rows = _scan(docs, id_col, text_col)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    suspect = F.filter("runs", lambda run: log_ratio(run, model) >= min_llr)
    rows = rows.withColumns({"base": base, "suspect": suspect})
    flags = lambda _, matches: F.transform(matches, lambda m: F.array_contains(F.col("suspect"), m))
    more = F.when(F.size("suspect") > 0, _located(F.col("text"), RUN, flags, "markov", 3)).otherwise(_none())
    apart = F.filter(more, lambda m: ~F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    return rows.withColumn("spans", F.array_sort(F.concat("base", apart)))


def joined(spans: str) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
    return F.array_join(F.transform(spans, one), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = scan_secrets(docs, id_col, text_col)
    return rows.select(
        F.col("id").alias(id_col),
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
