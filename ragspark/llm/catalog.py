"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm.alignment import default_model, link_statistics
from ragspark.llm.common import table
from ragspark.llm.dac import read_tokens, write_tokens
from ragspark.llm.embeddings import embedding_components
from ragspark.llm.fingerprints import fingerprint_edits
from ragspark.llm.language import infer_languages, train_languages
from ragspark.llm.line_dedup import dedup_lines
from ragspark.llm.mixing import mix_sources
from ragspark.llm.packing import pack_documents
from ragspark.llm.quality import score_quality
from ragspark.llm.sharding import assign_shards
from ragspark.llm.simhash import simhash_components
from ragspark.llm.spelling import spelling_variants
from ragspark.llm.tokens import default_tokenizer
from ragspark.llm.toxicity import score_toxicity

SHARDS = 8


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    names, model = train_languages(docs.where(~held_out & F.col("lang").isNotNull()))
    found = infer_languages(docs, names, model, [F.col("doc_id"), held_out.alias("held_out")])
    return found.select("_row.doc_id", "_row.held_out", "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprint_edits(table(spark, sf_dir, "documents"))
    like = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")  # noqa: E731  an exact digest: 1 if equal, else 0
    return marked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), default_tokenizer()))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    found = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), every=199)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_statistics(table(spark, sf_dir, "documents"), default_tokenizer(), default_model())


QUERIES = {f.__name__: f for f in (op1_sharding, op2_language, op3_simhash, op4_packing, op5_line_dedup, op6_mixing, op7_fingerprints, op8_quality, op9_embedding_dedup, op10_token_files, op11_toxicity, op12_spelling, op13_alignment)}
QUERIES["pipeline"] = corpus_pipeline.run

#: Word and source rules of op6 as in ragspark.llm.mixing: the thresholds there select what running sums select here.
OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3.0 * source_size AS most, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM ordered
), targets AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT arg_min(level, k) FROM levels WHERE most / weight >= level) * weight::DOUBLE, most::DOUBLE)) AS target FROM levels
), parts AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), summed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash) AS upto, sum(s.size) OVER (PARTITION BY s.source, s.hash) AS own
  FROM sized s JOIN parts t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN upto <= rest OR upto - own <= rest AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.line, k.place, s.key IS NOT NULL AND k.doc_id <> s.keep AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: CRC-32 byte by byte with the table of its polynomial, as DuckDB has no such function.
CRC = """step(i, k, v) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), tab AS (
  SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8
)"""
CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT"

OP1_SQL = rf"""
WITH RECURSIVE {CRC}, bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents
), sized AS (
  SELECT doc_id, (len(b) + 1)::BIGINT AS size,
    {CRC_OF} AS text_crc32
  FROM bytes, tab
), scores AS (
  SELECT doc_id, j::INTEGER AS j, -1.0::DOUBLE / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || j), 1, 15))::BIGINT + 0.5::DOUBLE) / 1152921504606846976::DOUBLE) AS score
  FROM sized, range(9) r(j)
), chosen AS (
  SELECT doc_id, arg_max(j, score) FILTER (WHERE j < 8) AS shard, arg_max(j, score) AS grown_shard FROM scores GROUP BY doc_id
)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, c.shard, c.grown_shard,
  row_number() OVER (PARTITION BY c.shard ORDER BY ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || '|' || s.text_crc32), 1, 15))::BIGINT, s.doc_id, s.size) - 1 AS slot
FROM sized s JOIN chosen c ON s.doc_id = c.doc_id
"""

OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT c.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM component c LEFT JOIN degree d ON c.vec_id = d.vec_id
"""

#: Pairs one edit apart: equal without one letter at the same place, or one equals the other without a letter.
OP12_SQL = rf"""
WITH RECURSIVE {CRC}, runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6
), counted AS (
  SELECT doc_id, run, count(*) AS k, list_transform(regexp_extract_all(hex(doc_id || ':' || run), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, {CRC_OF} AS h FROM counted, tab
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), shorter AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), way(word, stop, depth) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT w.word, f.form, w.depth + 1 FROM way w JOIN formed f ON w.stop = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(stop, depth) AS root FROM way GROUP BY word
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON f.word = e.word
"""

ORACLES = {"op12_spelling": OP12_SQL, "op1_sharding": OP1_SQL, "op5_line_dedup": OP5_SQL, "op6_mixing": OP6_SQL, "op9_embedding_dedup": OP9_SQL}
