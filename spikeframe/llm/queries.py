"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, exact_dedup, fingerprints, main_text, mixing, near_dedup, neighbours, pieces, secrets, toxicity, trie, warc
from .common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = main_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), percent=85)


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secrets": op3_secrets,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_chat": op6_chat,
    "op7_fingerprints": op7_fingerprints,
    "op8_warc": op8_warc,
    "op9_main_text": op9_main_text,
    "op10_near_dedup": op10_near_dedup,
    "op11_neighbours": op11_neighbours,
    "op12_trie": op12_trie,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op1_mix": r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn
  FROM rows GROUP BY source),
caps AS (
  SELECT *, 2 * source_size AS cap, [5, 2, 1][((turn - 1) % 3 + 1)::INT] AS weight FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
     / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM caps),
goals AS (
  SELECT source, source_size, cap, weight,
     (SELECT l.level FROM levels l WHERE l.cap >= l.weight * l.level
        AND (l.cap::DOUBLE / l.weight, l.turn) <= (levels.cap::DOUBLE / levels.weight, levels.turn)
      ORDER BY l.cap::DOUBLE / l.weight, l.turn LIMIT 1) AS level
  FROM levels),
plan AS (
  SELECT source, source_size, coalesce(weight * level, cap::DOUBLE) AS target,
     round(coalesce(weight * level, cap::DOUBLE))::BIGINT AS budget FROM goals),
placed AS (
  SELECT rows.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
     + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken
FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source
""",
    "op2_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id,
  count(*) OVER (PARTITION BY text) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM t
""",
    "op8_warc": """
WITH t AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
""",
    "op6_chat": """
WITH t AS (
  SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|', '<\\|') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'),
r AS (
  SELECT t.conv_id, perspective, turn,
    speaker IS NOT DISTINCT FROM perspective AS own,
    '<|im_start|>' || CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
      WHEN speaker IS NULL THEN 'user' ELSE 'user name=' || speaker END || chr(10) AS head, body || '<|im_end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, ((row_number() OVER w - 1) // 256)::BIGINT AS part,
    sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS begin_at, sum(length(head) + length(body) + 1) OVER w - 1 AS end_at
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, head, body, own ROWS UNBOUNDED PRECEDING)),
g AS (
  SELECT conv_id, perspective, part, count(*)::BIGINT AS n_turns, sum(length(head) + length(body) + 1)::BIGINT AS n_chars,
    string_agg(head || body || chr(10), '' ORDER BY turn NULLS LAST, head, body, own) AS text,
    coalesce(string_agg(CASE WHEN own THEN begin_at || ':' || end_at END, ',' ORDER BY turn NULLS LAST, head, body, own), '') AS mask
  FROM o GROUP BY ALL)
SELECT conv_id, perspective, part, n_turns, n_chars, text, mask,
  coalesce(sum(n_chars) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM g
""",
    "op12_trie": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, role, digest) AS turns, list(words ORDER BY turn NULLS FIRST, role, digest) AS words,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns, list_concat(coalesce(b.words[1:c.h], []), c.words[c.h + 1:]) AS words
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, len(turns) AS size, turns[1:d] AS path, coalesce(words[d], 0) AS w FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(w) AS w,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = size), '') AS ends
  FROM p GROUP BY d, path),
kids AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*)::BIGINT AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, path)),
below AS (
  SELECT a AS d, path[1:a] AS path, count(*) FILTER (n_children = 0)::BIGINT AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens
  FROM known, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
SELECT k.conv_id, k.d::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN below USING (d, path) LEFT JOIN nodes up ON up.d = k.d - 1 AND up.path = k.path[1:k.d - 1]
""",
    "op13_collocations": r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
c AS (SELECT lang, ws, len(ws) AS m FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p) WHERE len(ws) > 0),
total AS (SELECT lang, sum(m)::BIGINT AS n FROM c GROUP BY lang),
f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM c, unnest(range(1, 6)) AS u(k), unnest(range(1, m - k + 2)) AS v(i) GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, k, phrase, f AS a FROM f WHERE k >= 2),
cuts AS (
  SELECT lang, k, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS head, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS rest
  FROM cand, unnest(range(1, k)) AS u(cut)),
s AS (
  SELECT cuts.*, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM cand x WHERE x.lang = b.lang AND x.k > b.k AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * x.a >= 100 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""",
}
