"""Registered queries of files, keys, follow-ups, model hooks and streams, with their DuckDB SQL.

Models are plain functions here, whose results SQL can repeat; what they plug into is what is tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.operators import answers, bm25, conversations, embedding, evaluation, fusion, guard, rerank, rewrite, segments
from ragspark.plans import oracles as o
from ragspark.plans.catalog import E1_SQL, F4_SQL, LEGAL, TEST_PACK, _known_contexts, _legal, e1_exact_top_k, known_items, query, read, scratch
from ragspark.sources import tables, versions
from ragspark.sources.tables import stored
from ragspark.streaming import jobs

# --- files and tables


@query("SELECT item_id, md5(text || chr(10)) AS text_md5 FROM benchmark")
def a1_scan_corpus(spark, sf_dir):
    """The benchmark passages as text files, scanned again."""
    out = scratch(spark)
    read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(f"{out}/corpus")
    found = tables.scan_corpus(spark, f"{out}/corpus")
    return found.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.md5("text").alias("text_md5"))


CASES = """SELECT CASE WHEN item_id % 3 = 0 THEN 'case_0001' ELSE 'b' || item_id END AS case_id, text AS question, CASE WHEN item_id % 4 <> 1 THEN 'r' || item_id END AS reference, len(string_split(text, ' '))::INT % 4 AS n FROM benchmark"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as evaluation files of one case each, with either kind of key, some without id or reference."""
    b, out = read(spark, sf_dir, "benchmark"), scratch(spark)
    n = F.size(F.split("text", " ")) % 4
    case = F.struct(
        F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("b"), "item_id")).alias("id"), F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("question"), F.when(F.col("item_id") % 2 == 1, F.col("text")).alias("user_input"),
        F.when(F.col("item_id") % 4 != 1, F.concat(F.lit("r"), "item_id")).alias("reference_answer"), F.slice(F.split("text", " "), 1, n).alias("expected_terms"))
    body = F.when(F.col("item_id") % 2 == 0, F.to_json(F.array(case))).otherwise(F.concat(F.lit('{"samples": '), F.to_json(F.array(case)), F.lit("}")))
    b.select("item_id", body.alias("value")).write.partitionBy("item_id").text(f"{out}/cases")
    return tables.read_cases(spark, f"{out}/cases")


@query(f"SELECT case_id, question, reference, n FROM ({CASES}) WHERE reference IS NOT NULL")
def a4_normalize_cases(spark, sf_dir):
    return evaluation.normalize_cases(_cases(spark, sf_dir))[0].select("case_id", "question", "reference", F.size("answer_terms").alias("n"))


@query(f"SELECT case_id, 'no reference' AS reason FROM ({CASES}) WHERE reference IS NULL")
def a3_rejected_cases(spark, sf_dir):
    return evaluation.normalize_cases(_cases(spark, sf_dir))[1]


@query("SELECT doc_id, md5(text) AS text_md5, 'documents' AS kind FROM documents UNION ALL SELECT page_id, md5(url), 'pages' FROM pages")
def a5_replace_tables(spark, sf_dir):
    """Two tables that replace older ones with other rows in one step, read through one manifest."""
    out, docs, pages = scratch(spark), read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "pages").select("page_id", "url")
    tables.replace_tables(out, documents=docs.where("doc_id % 2 = 0"), pages=pages.union(pages))
    tables.replace_tables(out, documents=docs, pages=pages)
    held = versions.manifest(spark, out)
    now = lambda name: versions.read_table(spark, out, name, held)
    return now("documents").select("doc_id", F.md5("text").alias("text_md5"), F.lit("documents").alias("kind")).union(now("pages").select("page_id", F.md5("url"), F.lit("pages")))


@query("SELECT vec_id AS chunk_id, label, len(embedding)::INT AS dimensions, embedding[1]::DOUBLE AS head FROM embeddings WHERE label % 3 <> 0")
def a6_rebuild_vectors(spark, sf_dir):
    """Vectors of chunks that are gone are not in the rebuilt table."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("vector"))
    out = f"{scratch(spark)}/vectors"
    tables.rebuild_vectors(e.drop("vector"), e, out)
    again = tables.rebuild_vectors(e.where("label % 3 <> 0").drop("vector"), e, out)
    return again.select("chunk_id", "label", F.size("vector").alias("dimensions"), F.col("vector")[0].cast("double").alias("head"))


@query("SELECT item_id::VARCHAR AS case_id, length(text)::BIGINT AS chars FROM benchmark UNION ALL SELECT 'all', sum(length(text))::BIGINT FROM benchmark")
def a8_report(spark, sf_dir):
    """A report's summary and cases, read back from its JSON lines."""
    out, cases = scratch(spark), read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.length("text").alias("chars"))
    tables.write_report(cases.select(F.lit("all").alias("case_id"), "chars").groupBy("case_id").agg(F.sum("chars").alias("chars")), cases, out)
    back = lambda name: spark.read.schema("case_id string, chars long").json(f"{out}/{name}")
    return back("cases").union(back("summary"))


@query(f"SELECT query_id, chunk_id::VARCHAR AS chunk_id, '' AS heading, NULL::INT AS heading_level, 0 AS chunk_index, score, rank, CASE WHEN chunk_id % 2 = 0 THEN 'p' || chunk_id END AS parent_id, CASE WHEN chunk_id % 2 = 0 THEN 0 END AS parent_index, CASE WHEN chunk_id % 2 = 0 THEN 'child' END AS chunk_type, CASE WHEN chunk_id % 2 = 0 THEN '' END AS parent_text FROM ({E1_SQL})")
def e4_hit_projection(spark, sf_dir):
    hits = e1_exact_top_k(spark, sf_dir)
    parent = F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("p"), "chunk_id"))
    full = tables.project_hits(hits.withColumn("parent_id", parent), ["query_id"])
    return full.select("query_id", "chunk_id", "heading", "heading_level", "chunk_index", "score", "rank", "parent_id", "parent_index", "chunk_type", "parent_text")


@query(F4_SQL)
def f6_fresh_index(spark, sf_dir):
    """A stored index of an older version is not read for a newer one, and that of the newer one is written once."""
    path, docs = scratch(spark), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    bm25.fresh_index(docs.where("chunk_id % 2 = 0"), path, "v1")
    bm25.fresh_index(docs, path, "v2")
    index = bm25.fresh_index(docs.limit(0), path, "v2")
    return bm25.search(index, known_items(spark, sf_dir).withColumnRenamed("item_id", "query_id"), 10)


@query(F4_SQL)
def f6_segments(spark, sf_dir):
    """An index of two segments, after changed, removed and returned documents: the same top ten as one built anew."""
    path, docs = f"{scratch(spark)}/index", read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    early = docs.where("chunk_id % 2 = 0").withColumn("text", F.when(F.col("chunk_id") % 4 == 0, F.concat(F.lit("older text "), "text")).otherwise(F.col("text")))
    segments.update_index(spark, path, early, None)
    segments.update_index(spark, path, None, early.where("chunk_id % 3 = 0").select("chunk_id"))
    segments.update_index(spark, path, docs.where("chunk_id % 2 = 1 or chunk_id % 4 = 0 or chunk_id % 3 = 0"))
    return bm25.search(segments.read_index(spark, path), known_items(spark, sf_dir).withColumnRenamed("item_id", "query_id"), 10)


RANKED = """SELECT * FROM (SELECT doc_id % 40 AS q, CASE WHEN doc_id % 3 = 0 THEN 'c' || doc_id ELSE 'd' || (doc_id % 7) || ':' || doc_id END AS chunk_id,
  row_number() OVER (PARTITION BY doc_id % 40 ORDER BY {by}, doc_id) AS place FROM documents) AS ordered WHERE ordered.place <= 20"""


@query(f"""SELECT q, chunk_id, round(coalesce(0.65::DOUBLE / (60 + v.place), 0) + coalesce((1.0::DOUBLE - 0.65::DOUBLE) / (60 + k.place), 0), 9) AS score FROM ({RANKED.format(by='n_chars DESC')}) v
  FULL JOIN ({RANKED.format(by='n_chars')}) k USING (q, chunk_id)""")
def g2_result_keys(spark, sf_dir):
    """Fusion of rankings in which two of three hits have no chunk id and are known by document and index."""
    d = read(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 40).alias("q"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("c"), "doc_id")).alias("chunk_id"),
        F.concat(F.lit("d"), F.col("doc_id") % 7).alias("document_id"), F.col("doc_id").alias("chunk_index"), "n_chars", F.lit(0.0).alias("score"))
    from ragspark.operators.vector import ranked

    first, second = (ranked(d, 20, ["q"], [order, "chunk_index"]) for order in (F.desc("n_chars"), F.asc("n_chars")))
    return fusion.reciprocal_rank_fusion(first, second, 40, ["q"]).select("q", "chunk_id", "score")


# --- follow-ups, blocked tasks, model rewriting

TURN = """CASE WHEN conv_id % 5 = 1 AND turn > 0 THEN 'Còn bao nhiêu?' WHEN conv_id % 5 = 2 THEN 'Xin hỏi, ' || text || ' nhé?' WHEN conv_id % 5 = 3 THEN 'Viết cho tôi code ' || text WHEN conv_id % 5 = 4 THEN 'SV ' || text ELSE text END"""
PLAIN = o.collapsed(o.fold("said"))
HIT = f"""regexp_matches({{x}}, '{"|".join(o.TEST_TERMS)}')"""
TURNS = f"""turns AS (SELECT conv_id, turn, role, said, {PLAIN} AS plain FROM (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {TURN} ELSE text END AS said FROM conversations)),
seen AS (SELECT *, list(CASE WHEN role = 'user' THEN plain END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS before FROM turns)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with users' turns made into follow-ups, polite questions, blocked tasks and abbreviations."""
    kind, text = F.col("conv_id") % 5, F.col("text")
    said = F.when((kind == 1) & (F.col("turn") > 0), "Còn bao nhiêu?").when(kind == 2, F.concat(F.lit("Xin hỏi, "), text, F.lit(" nhé?"))).when(kind == 3, F.concat(F.lit("Viết cho tôi code "), text)).when(kind == 4, F.concat(F.lit("SV "), text)).otherwise(text)
    return read(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") == "user", said).otherwise(text))


@query(f"""WITH {TURNS} SELECT conv_id, turn, coalesce(conv_id % 5 <> 3 AND ({HIT.format(x='plain')} OR conv_id % 5 = 1 AND turn > 0 AND len(list_filter(before, lambda b: b IS NOT NULL AND {HIT.format(x='b')})) > 0), false) AS allowed,
  CASE WHEN plain = '' THEN 'empty' WHEN conv_id % 5 = 3 THEN 'code_generation' WHEN {HIT.format(x='plain')} THEN 'domain'
  WHEN conv_id % 5 = 1 AND turn > 0 AND len(list_filter(before, lambda b: b IS NOT NULL AND {HIT.format(x='b')})) > 0 THEN 'follow_up' ELSE 'outside_domain' END AS reason FROM seen WHERE role = 'user'""")
def h5_follow_ups_and_tasks(spark, sf_dir):
    """The scope decision on blocked tasks (H3) and on follow-ups with and without an earlier turn of the domain (H5)."""
    asked = conversations.earlier_turns(_turns(spark, sf_dir), max_chars=1_000_000)
    return asked.select("conv_id", "turn", guard.scope_decision(F.col("text"), F.col("history"), TEST_PACK).alias("s")).select("conv_id", "turn", "s.allowed", "s.reason")


RULED = f"""CASE WHEN conv_id % 5 = 2 THEN {o.TRIM_QUERY.format(x="regexp_replace(regexp_replace(plain, '^xin hỏi[,:;.!?[:space:]-]*', ''), '[[:space:]]+(nhé)[.!?[:space:]]*$', '')")}
  WHEN conv_id % 5 = 4 THEN {o.TRIM_QUERY.format(x="regexp_replace(plain, '^sv ', 'sinh viên ')")} ELSE {o.TRIM_QUERY.format(x="plain")} END"""
REWRITTEN = f"""WITH {TURNS}, ruled AS (SELECT *, {RULED} AS rule FROM seen),
latest AS (SELECT *, last_value(CASE WHEN role = 'user' AND plain <> '' THEN rule END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS earlier FROM ruled),
rewritten AS (SELECT conv_id, turn, said, CASE WHEN conv_id % 5 = 1 AND turn > 0 AND earlier IS NOT NULL THEN substr(earlier || ' ' || rule, 1, 500) ELSE rule END AS query FROM latest WHERE role = 'user')"""


def _rewritten(spark, sf_dir):
    asked = conversations.earlier_turns(_turns(spark, sf_dir), max_chars=1_000_000)
    return asked.select("conv_id", "turn", "text", rewrite.resolve_follow_up(rewrite.rule_rewrite(F.col("text")), F.col("history")).alias("rule"))


@query(REWRITTEN + " SELECT conv_id, turn, query FROM rewritten")
def i2_follow_ups(spark, sf_dir):
    """Prefixes, tails, abbreviations, and follow-ups with the latest user turn before them."""
    return _rewritten(spark, sf_dir).select("conv_id", "turn", F.col("rule").alias("query"))


def load_rewriter():
    def generate(prompts: list[str]) -> list[str]:
        if any("que" in p for p in prompts):
            raise ValueError("a prompt that this model can't take")
        return [f'"asked: {p}"\n' if len(p) % 4 else "  " for p in prompts]

    return generate


@query(REWRITTEN + f""" SELECT conv_id, turn, CASE WHEN contains(said, 'que') OR length(said) % 4 = 0 THEN query ELSE substr({o.collapsed("'asked: ' || said")}, 1, 500) END AS query FROM rewritten""")
def i3_model_rewrite(spark, sf_dir):
    """A model's rewriting, with the rules where it fails or says nothing."""
    return rewrite.model_rewrite(_rewritten(spark, sf_dir), "text", "rule", load_rewriter).select("conv_id", "turn", "query")


def load_variants():
    return lambda prompts: [f"- {p}\n2) {p.upper() if p.isascii() else p}\n* more on {p}" for p in prompts]


@query(f"""WITH v AS (SELECT item_id AS query_id, unnest([text, 'more on ' || text]) AS raw, unnest([0, 1]) AS variant FROM benchmark), c AS (SELECT *, trim({o.collapsed("raw")}, ' `"''-') AS said FROM v)
SELECT query_id, variant::BIGINT AS variant, substr(said, 1, 500) AS query FROM c WHERE said <> ''""")
def i5_model_variants(spark, sf_dir):
    """A model's list of variants, without its bullets and without what differs by case only."""
    asked = rewrite.with_model(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace("text", r"\n", " ").alias("text")), "text", "said", load_variants)
    found = rewrite.unique_variants(asked, F.concat(F.array("text"), rewrite.model_variants(F.col("said"))))
    return found.withColumn("variant", F.col("variant").cast("long"))


@query("SELECT conv_id, turn, (length(regexp_replace(said, '[\\s\\p{Z}]+', '', 'g')) > 0) AS valid FROM (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN ' ' || chr(10) ELSE text END AS said FROM conversations)")
def j7_valid_messages(spark, sf_dir):
    """Messages of which some are blank, accepted and rejected."""
    said = read(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("conv_id") % 9 == 0, " \n").otherwise(F.col("text")))
    good, blank = conversations.valid_messages(said)
    mark = lambda df, ok: df.select("conv_id", "turn", F.lit(ok).alias("valid"))
    return mark(good, True).union(mark(blank, False))


@query("SELECT conv_id, max(CASE WHEN role = 'user' THEN greatest(turn, 2) ELSE 2 END)::BIGINT AS updated_at FROM conversations GROUP BY conv_id")
def j2_touch(spark, sf_dir):
    m = read(spark, sf_dir, "conversations")
    return conversations.touch(m.select("conv_id", F.lit(2).cast("long").alias("updated_at")).distinct(), m.where("role = 'user'").select("conv_id", F.col("turn").alias("created_at"))).select("conv_id", "updated_at")


# --- model embedding, reranking, prompts, answers, judges


def load_embedder():
    return lambda texts: [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


@query("SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS a, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS b, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS c FROM documents")
def d3_model_embedding(spark, sf_dir):
    found = embedding.embed_with(read(spark, sf_dir, "documents"), "doc_id", "text", load_embedder)
    return found.select("doc_id", *[F.col("vector")[i].alias(n) for i, n in enumerate("abc")])


def load_reranker():
    return lambda pairs: [(len(text) * 7 + len(asked)) % 101 / 101 for asked, text in pairs]


@query(f"""SELECT query_id, chunk_id, rerank_score, rank, 'model' AS reranker FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, was)::INT AS rank FROM (
  SELECT k.query_id, k.chunk_id, k.rank AS was, round(((length(d.text) * 7 + length(b.text)) % 101)::DOUBLE / 101, 6) AS rerank_score FROM ({F4_SQL}) k JOIN documents d ON d.doc_id = k.chunk_id JOIN benchmark b ON b.item_id = k.query_id)) WHERE rank <= 4""")
def g9_model_rerank(spark, sf_dir):
    docs, asked = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), known_items(spark, sf_dir).withColumnRenamed("item_id", "query_id")
    hits = bm25.search(bm25.build_index(docs, path=scratch(spark)), asked, 10)
    found = rerank.model_rerank(hits.join(docs, "chunk_id").join(asked, "query_id"), 4, ["query_id"], load_reranker)
    return found.select("query_id", "chunk_id", "rerank_score", "rank", "reranker")


PROMPTS = f"""WITH {LEGAL}, blocks AS (SELECT c.query_id, c.rank, '[' || c.citation_id || '] ' || c.source_name || chr(10) || c.heading || chr(10) || c.locator || chr(10)
  || array_to_string(list_transform(string_split(d.text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN i || '. ' || x WHEN (i - 1) % 3 = 1 THEN 'a) ' || x ELSE x END), chr(10)) AS b, c.citation_id FROM cited c JOIN documents d ON d.doc_id = c.rank),
prompts AS (SELECT query_id, 'H:user: earlier' || chr(10) || 'C:' || string_agg(b, chr(10) || chr(10) ORDER BY rank) || chr(10) || 'Q:what of ' || query_id AS prompt, max(citation_id) AS most FROM blocks GROUP BY query_id)"""


def _prompted(spark, sf_dir):
    cited = answers.citations(_legal(spark, sf_dir), ["query_id"])
    turn = F.array(F.struct(F.lit("user").alias("role"), F.lit("earlier").alias("content")))
    return cited, cited.select("query_id").distinct().select("query_id", F.concat(F.lit("what of "), "query_id").alias("question"), turn.alias("history"))


@query(PROMPTS + " SELECT query_id, md5(prompt) AS prompt_md5 FROM prompts")
def k7_prompts(spark, sf_dir):
    made = answers.prompts(*_prompted(spark, sf_dir), ["query_id"], template="H:{history}\nC:{contexts}\nQ:{question}")
    return made.select("query_id", F.md5("prompt").alias("prompt_md5"))


def load_generator():
    return lambda prompts: [f"found {p.count('[')} [1] and [99]" if p.count("a)") % 2 else f"found {p.count('a)')}" for p in prompts]


#: The default template, which the generator sees, holds one bracket more than the contexts.
@query(PROMPTS + f""" SELECT query_id, CASE WHEN n % 2 = 1 THEN 'found ' || k || ' [1] and' ELSE 'found ' || n || ' [1]' END AS answer
  FROM (SELECT query_id, (length(p) - length(replace(p, 'a)', ''))) // 2 AS n, length(p) - length(replace(p, '[', '')) + 1 AS k FROM (SELECT query_id, replace(replace(replace(prompt, 'H:', ''), 'C:', ''), 'Q:', '') AS p FROM prompts))""")
def k9_generation(spark, sf_dir):
    """A model's answers, of which some cite nothing or what is not there."""
    cited, asked = _prompted(spark, sf_dir)
    return answers.generate_answers(cited, asked, ["query_id"], load_generator)


#: The ten documents that keyword search finds for each passage, in order, without blank ones.
SAMPLES = f"""WITH found AS ({F4_SQL}), s AS (SELECT b.item_id::VARCHAR AS case_id, b.text AS question, 'a' || b.item_id AS response,
  (SELECT count(*) FROM found f JOIN documents d ON d.doc_id = f.chunk_id WHERE f.query_id = b.item_id AND trim(coalesce(d.text, '')) <> '') AS n, 'r' AS reference FROM benchmark b)"""


def _samples(spark, sf_dir):
    cases = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.col("text").alias("question"), F.lit("r").alias("reference"))
    return evaluation.judge_samples(cases, cases.select("case_id", F.concat(F.lit("a"), "case_id").alias("answer")), _known_contexts(spark, sf_dir))


@query(SAMPLES + " SELECT case_id, question, response, n, reference FROM s")
def l7_judge_samples(spark, sf_dir):
    return _samples(spark, sf_dir).select("case_id", "question", "response", F.size("retrieved_contexts").cast("long").alias("n"), "reference")


def load_judge():
    def score(metric: str, inputs: dict) -> float:
        if metric == "faithfulness" and len(inputs["retrieved_contexts"]) % 3 == 0:
            raise ValueError("no verdict")
        if metric == "answer_relevancy" and len(inputs["question"]) % 5 == 0:
            return float("nan")
        return len(inputs["question"]) % 10 / 10

    return score


JUDGED = SAMPLES + """, judged AS (SELECT case_id, metric, CASE WHEN error IS NULL THEN (length(question) % 10)::DOUBLE / 10 END AS score, error FROM (
  SELECT s.*, m.metric, CASE WHEN metric = 'faithfulness' AND n % 3 = 0 THEN 'ValueError: no verdict' WHEN metric = 'answer_relevancy' AND length(question) % 5 = 0 THEN 'score is not finite' END AS error
  FROM s, (SELECT unnest(['context_precision', 'context_recall', 'faithfulness', 'answer_relevancy', 'answer_correctness']) AS metric) m))"""


@query(JUDGED + " SELECT case_id, metric, score, error FROM judged")
def l8_judge(spark, sf_dir):
    return evaluation.judge(_samples(spark, sf_dir), load_judge)


@query(JUDGED + " SELECT (SELECT round(avg(m), 6) FROM (SELECT avg(score) AS m FROM judged GROUP BY metric)) AS grand_mean, count(DISTINCT CASE WHEN error IS NOT NULL THEN case_id END) AS cases_with_errors FROM judged")
def l9_judge_summary(spark, sf_dir):
    return evaluation.judge_summary(stored(evaluation.judge(_samples(spark, sf_dir), load_judge), f"{scratch(spark)}/scores"))


# --- streams


@query(f"""SELECT query_id, route, place, type, CASE WHEN type = 'done' THEN answer END AS answer FROM (SELECT conv_id || '-' || turn AS query_id, CASE WHEN {HIT.format(x=o.collapsed(o.fold("text")))} THEN 'answer' ELSE 'refusal' END AS route, 'on ' || md5(text) AS answer FROM conversations WHERE role = 'user'),
  (SELECT unnest(['start', 'done']) AS type, unnest([1, 2]) AS place)""")
def m3_stream_answers(spark, sf_dir):
    """A stream of questions answered a batch at a time, and the events it logs (M4)."""
    out, kind = scratch(spark), spark.read.parquet(f"{sf_dir}/conversations.parquet").schema

    def answer(df: DataFrame) -> DataFrame:
        route = F.when(guard.scope_decision(F.col("text"), None, TEST_PACK)["allowed"], "answer").otherwise("refusal")
        return df.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), route.alias("route"), F.concat(F.lit("on "), F.md5("text")).alias("answer"))

    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/conversations.parquet*")
    jobs.stream_answers(stream, answer, f"{out}/events", f"{out}/checkpoint").awaitTermination()
    return jobs.read_events(spark, f"{out}/events").select("query_id", "route", "place", "type", "answer")
