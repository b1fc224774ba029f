"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, fertility, filter_audit, language_id, minhash, mixing, packing, quotes, sentence_pieces, substrings, token_counts, topk, toxicity
from .common import remainder, table


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents")).withColumn("n_copies", F.size("shards"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "n_copies")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), sentence_pieces.model_bytes())


def op6_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(table(spark, sf_dir, "documents"), fertility.vocabularies())


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = language_id.predict(docs, language_id.train(docs))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), sentence_pieces.model_bytes())


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flag_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_top_k_search, op2_quotation_linking, op3_toxicity, op4_mixing, op5_sentencepiece, op6_fertility_rules, op7_near_duplicates, op8_language_id, op9_token_counts, op10_repeated_passages, op11_filter_audit, op12_collocations, op13_packing)
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k_search": """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row AS query, q.vec_id AS query_id, c.row, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, row) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_quotation_linking": r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
quoted AS (
  SELECT conv_id, turn, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '\s+', ' ', 'g')) AS key
  FROM lines WHERE regexp_matches(line, '^(?:[ \t]*>)+')),
asked AS (
  SELECT DISTINCT conv_id, turn, key FROM (
    SELECT *, min(level) OVER (PARTITION BY conv_id, turn) AS low FROM quoted WHERE key <> '') WHERE level = low),
own AS (
  SELECT *, CASE WHEN text IS NULL THEN NULL ELSE trim(array_to_string(list_filter(string_split(text, chr(10)),
    lambda x: NOT regexp_matches(x, '^(?:[ \t]*>)+')), chr(10))) END AS body FROM conversations),
held AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS key FROM (
    SELECT conv_id, turn, unnest(list_append(string_split(body, chr(10)), body)) AS line FROM own)),
met AS (
  SELECT a.conv_id, a.turn, a.key, max(h.turn) AS holder FROM asked a
  JOIN held h ON h.conv_id = a.conv_id AND h.key = a.key AND h.turn < a.turn GROUP BY ALL),
votes AS (SELECT conv_id, turn, holder, sum(length(key)) AS chars FROM met GROUP BY ALL),
reply AS (
  SELECT conv_id, turn, holder AS reply_to FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY chars DESC, holder DESC) = 1),
up AS (
  SELECT conv_id, turn, reply_to, reply_to AS root FROM reply
  UNION ALL
  SELECT u.conv_id, u.turn, u.reply_to, r.reply_to FROM up u JOIN reply r ON r.conv_id = u.conv_id AND r.turn = u.root),
root AS (SELECT conv_id, turn, reply_to, min(root) AS root FROM up GROUP BY ALL),
done AS (
  SELECT o.conv_id, o.turn, o.role, r.reply_to, coalesce(r.root, o.turn) AS root_turn, o.body AS text
  FROM own o LEFT JOIN root r ON r.conv_id = o.conv_id AND r.turn = o.turn)
SELECT conv_id, turn,
  row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
  role, reply_to, root_turn, text,
  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS message
FROM done""",
    "op11_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT t.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    [len(words) < 200,
     100 * len(list_distinct(words)) < 50 * len(words),
     100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'),
     coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM texts t LEFT JOIN marks m ON m.doc_id = t.doc_id),
counts AS (SELECT part, fails, good, toxic, count(*) AS n FROM flags GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
done AS (
  SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS f,
    coalesce(sum(n) FILTER (len(list_filter(o[:step], lambda k: fails[k])) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(o[:step - 1], lambda k: fails[k])) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(o[:step - 1], lambda k: fails[k])) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (good AND fails[o[step]] AND len(list_filter(o[:step - 1], lambda k: fails[k])) = 0), 0) AS good_lost,
    coalesce(sum(n) FILTER (toxic AND fails[o[step]] AND len(list_filter(o[:step - 1], lambda k: fails[k])) = 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, o, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM done""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT lang, w[i : i + m - 1] AS p FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT * FROM f WHERE len(p) > 1),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM cand),
scores AS (
  SELECT c.lang, c.p, c.a, x.a AS l, y.a AS r, t.n, c.k,
    (1000::HUGEINT * c.a::HUGEINT * t.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.p = c.p[: c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1 :]),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (
  SELECT DISTINCT c.lang, d.p FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS i FROM cand) c, (SELECT unnest([2, 3, 4]) AS m) s
  JOIN cand d ON d.lang = c.lang AND d.p = c.p[c.i : c.i + s.m - 1] AND len(d.p) < len(c.p) AND c.a >= d.a
  WHERE c.i + s.m - 1 <= len(c.p)),
kept AS (SELECT *, array_to_string(p, ' ') AS phrase FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = b.lang AND i.p = b.p)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
}
