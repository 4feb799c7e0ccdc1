"""The registered queries of this subpackage: thin wrappers that fix inputs and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt_dedup, chat_windows, decontam_edit, fingerprint_cws, importance_draw, langid_ftrl, quality_nbsvm, simhash_cover, source_audit, spm_codec, token_store, toxicity_gbt, window_packing
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of fold 2 of 4 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality_nbsvm.score(docs, quality_nbsvm.train(docs, labels.where(fold(F.col("doc_id"), 4) != 2)))
    held = fold(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality_nbsvm.THRESHOLD).cast("int").alias("predicted"))


def op5_langid_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; texts and languages of fold 0 of 5 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid_ftrl.train(docs.where(fold(F.col("doc_id"), 5) != 0))
    return langid_ftrl.predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of fold 0 of 5 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity_gbt.train_and_score(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    held = fold(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity_gbt.THRESHOLD).cast("int").alias("predicted"))


def tokenizer_path(name: str) -> str:
    """Where the tokenizer files of this machine are; the operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


ESCAPE_PROBE = r"\### Assistant: </turn> ok"


def op6_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that an earlier one has."""
    return bwt_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every conversation, read back from its formatted windows; conversation -7 probes the escapes."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(ESCAPE_PROBE).alias("text"))
    return chat_windows.digests(chat_windows.windows(turns.unionByName(probe)))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids, read back from the store's files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.digests(token_store.stored(docs, tokenizer_path("word_bpe_49k.json"), end_id=2))


def op10_decontam_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds within their error budget."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam_edit.marked(docs, table(spark, sf_dir, "benchmark"))


def op2_fingerprint_cws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprint_cws.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_cover.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_spm_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spm_codec.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document for the benchmark's language, and the ranks of those drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = importance_draw.drawn(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their sequence and place there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return window_packing.digests(window_packing.packed(docs, tokenizer_path("word_bpe_49k.json")))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source of a language differs from the others, and the terms that are typical of it."""
    return source_audit.report(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP7_SQL = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM all_turns
), sized AS (
  SELECT *, n = 1 AND role = 'system' AS sys, (length(text) + 3) // 4 + 2 AS tokens,
    16 + length(role) + length(text)
      + length(role || text) * 3 - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', '')) * 3
      - (length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', ''))) * 2 AS chars
  FROM numbered
), summed AS (
  SELECT *, greatest((768 - max(CASE WHEN sys THEN tokens ELSE 0 END) OVER c) // 2, 1) AS cell_size,
    sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER c AS total, CASE WHEN sys THEN 0 ELSE tokens END AS own,
    max(CASE WHEN sys THEN chars ELSE 0 END) OVER c AS sys_chars
  FROM sized WINDOW c AS (PARTITION BY conv_id ORDER BY n)
), celled AS (
  SELECT *, (greatest(total, 1) - 1) // cell_size AS cell, own > cell_size AS large FROM summed
), begun AS (
  SELECT *, coalesce(cell <> lag(cell) OVER c OR large OR lag(large) OVER c, true) AS begins
  FROM celled WINDOW c AS (PARTITION BY conv_id ORDER BY n)
), spanned AS (
  SELECT *, sum(begins::int) OVER (PARTITION BY conv_id ORDER BY n) AS span FROM begun
), ended AS (
  SELECT *, row_number() OVER b AS from_end, sum(tokens) OVER b AS to_end, max(span) OVER (PARTITION BY conv_id) AS last_span
  FROM spanned WINDOW b AS (PARTITION BY conv_id, span ORDER BY n DESC)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + coalesce(sum(chars) FILTER (from_end <= 2 AND to_end <= 256 AND NOT sys AND span < last_span), 0)
    + coalesce(sum(sys_chars) FILTER (begins AND span > 1), 0))::bigint AS formatted_chars
FROM ended GROUP BY conv_id
"""

OP11_SQL = r"""
WITH byte_crc AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), worded AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT side, row, unnest(w) AS feature FROM worded
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
), hashed AS (
  SELECT feature, xor(list_reduce(list_transform(range(octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::bigint), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM runs), byte_crc
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM runs JOIN hashed USING (feature) GROUP BY bucket
), gained AS (
  SELECT bucket, floor(1000 * ln((t + 1)::double * (sum(s) OVER () + 10000)::double / ((s + 1)::double * (sum(t) OVER () + 10000)::double)))::bigint AS gain FROM counted
), weighed AS (
  SELECT row, count(*) AS n_features, floor(sum(gain) / count(*))::bigint AS weight FROM runs JOIN hashed USING (feature) JOIN gained USING (bucket) WHERE side = 'd' GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS long,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS score
  FROM worded LEFT JOIN weighed USING (row) WHERE side = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id, n_features, weight) AS place, count(*) FILTER (long) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), terms AS (
  SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term FROM terms GROUP BY lang, term HAVING count(*) >= 30
), sizes AS (
  SELECT lang, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)
), counts AS (
  SELECT lang, source, term, sum(n)::hugeint AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT d.lang, d.source, v, coalesce(sum(c.n), 0)::hugeint AS total FROM (SELECT DISTINCT lang, source FROM docs) d JOIN sizes USING (lang) LEFT JOIN counts c ON c.lang = d.lang AND c.source = d.source GROUP BY d.lang, d.source, v
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (g.total + 5 * g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), langs AS (
  SELECT lang, term, 1 + 1000000000::hugeint * (sum(c.n) + 5) // (any_value(t.total) + 5 * any_value(t.v)) AS q
  FROM counts c JOIN (SELECT lang, any_value(v) AS v, sum(total) AS total FROM groups GROUP BY lang) t USING (lang) GROUP BY lang, term
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::bigint AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::bigint FROM shares JOIN langs USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::int AS rank FROM found) WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {f.__name__: f for f in (op1_quality_nbsvm, op2_fingerprint_cws, op3_simhash_cover, op4_spm_codec, op5_langid_ftrl, op6_bwt_dedup, op7_chat_windows, op8_token_store, op9_toxicity_gbt, op10_decontam_edit, op11_importance_draw, op12_window_packing, op13_source_audit)}
ORACLE_SQL: dict[str, str] = {"op7_chat_windows": OP7_SQL, "op11_importance_draw": OP11_SQL, "op13_source_audit": OP13_SQL}
