"""Queries of vector retrieval, contexts and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import prompts as pr
from corpusmill.functions import text as tx
from corpusmill.operators import evaluation, retrieval, vector_index
from corpusmill.plans import corpus
from corpusmill.plans.registry import registry, table
from corpusmill.providers import HashingEmbedder, embedded
from corpusmill.session import work_path

QUERIES, ORACLE_SQL, query = registry()

_COS = "round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"
_D = "CAST(embedding AS DOUBLE[])"
_SIM = f"""sims AS (SELECT q.vec_id AS query_id, c.vec_id AS match_id, {_COS.format(a='q.v', b='c.v')} AS sim
  FROM (SELECT vec_id, label, {_D} AS v FROM embeddings WHERE {{q}}) q JOIN (SELECT vec_id, label, {_D} AS v FROM embeddings) c ON {{on}})"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


@query(f"WITH {_SIM.format(q='vec_id % 20 = 0', on='q.vec_id <> c.vec_id')} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, match_id) AS rank FROM sims WHERE sim >= 0.2) WHERE rank <= 10")
def knn_topk(spark, sf):
    v = _vectors(spark, sf)
    return retrieval.knn(v.where("vec_id % 20 = 0"), v, k=10, least=0.2, skip_same=True)


@query(f"WITH {_SIM.format(q='vec_id % 20 = 0', on='q.vec_id <> c.vec_id')} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, match_id) AS rank FROM sims WHERE sim >= 0.35) WHERE rank <= 3")
def knn_threshold(spark, sf):
    v = _vectors(spark, sf)
    return retrieval.knn(v.where("vec_id % 20 = 0"), v, k=3, least=0.35, skip_same=True)


_NEAR = f"WITH {_SIM.format(q='vec_id % 20 = 0', on='q.vec_id <> c.vec_id')} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, match_id) AS rank FROM sims) WHERE rank <= 10"


def _index(spark, sf):
    path, v = work_path(spark, "index"), _vectors(spark, sf)
    return path, vector_index.build_index(v, path), v.where("vec_id % 20 = 0")


@query(_NEAR)
def index_all_cells(spark, sf):
    path, cells, asked = _index(spark, sf)
    return vector_index.search_index(spark, path, asked, probes=cells, least=-1.0, skip_same=True)


@query()
def index_probed_cells(spark, sf):
    """The same with six in ten of the cells read: the test vectors have hardly any structure, see the README."""
    path, cells, asked = _index(spark, sf)
    return vector_index.search_index(spark, path, asked, probes=-(-cells * 6 // 10), least=-1.0, skip_same=True)


@query(f"WITH {_SIM.format(q='vec_id % 20 = 0', on='TRUE')} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, match_id) AS rank FROM sims) WHERE rank <= 3")
def brute_force_top3(spark, sf):
    v = _vectors(spark, sf)
    return retrieval.knn(v.where("vec_id % 20 = 0"), v, k=3, least=-1.0)


_RANKED = f"WITH {_SIM.format(q='TRUE', on='q.label = c.label AND q.vec_id <> c.vec_id')}, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, match_id) AS rank FROM sims) WHERE rank <= 3)"


def _ranked(spark, sf):
    v = _vectors(spark, sf)
    return retrieval.similarity_join(v, v, "label", "vec_id", "vec_id")


@query(f"{_RANKED} SELECT CAST(e.label AS BIGINT) AS label, query_id AS left_id, match_id AS right_id, sim, rank FROM ranked JOIN embeddings e ON e.vec_id = query_id")
def label_filtered_knn(spark, sf):
    return _ranked(spark, sf)


@query(f"{_RANKED} SELECT query_id AS left_id, count(*) AS n, round(avg(sim), 8) AS mean_sim, max(sim) AS best_sim, string_agg(d.text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM ranked JOIN documents d ON d.doc_id = match_id GROUP BY 1 HAVING avg(sim) >= 0.05")
def context_topk_mean(spark, sf):
    return retrieval.contexts(_ranked(spark, sf), table(spark, sf, "documents"), "doc_id", least=0.05).withColumn("mean_sim", F.round("mean_sim", 8))


@query(f"{_RANKED} SELECT count(sim) AS n, round(avg(sim), 5) AS mean, round(median(sim), 5) AS median, min(sim) AS min, max(sim) AS max, round(stddev_pop(sim), 5) AS std FROM ranked")
def similarity_stats(spark, sf):
    d = evaluation.describe(_ranked(spark, sf), "sim")
    return d.select("n", *[F.round(c, 5).alias(c) for c in ("mean", "median")], "min", "max", F.round("std", 5).alias("std"))


@query(f"{_RANKED}, best AS (SELECT query_id, max(sim) AS b FROM ranked GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN b >= 0.2 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS accuracy, round(avg(b), 5) AS mean_sim, (SELECT query_id FROM best ORDER BY b DESC, query_id LIMIT 1) AS best_query, (SELECT query_id FROM best ORDER BY b, query_id LIMIT 1) AS worst_query FROM best")
def search_accuracy(spark, sf):
    best = _ranked(spark, sf).groupBy(F.col("left_id").alias("query_id")).agg(F.max("sim").alias("best_sim"))
    found = evaluation.search_accuracy(best, least=0.2)
    return found.withColumn("accuracy", F.round("accuracy", 5)).withColumn("mean_sim", F.round("mean_sim", 5))


@query(f"SELECT vec_id, round(sqrt(list_dot_product({_D}, {_D})), 5) AS length, round(1 - (1 - list_dot_product({_D}, {_D})), 5) AS sim FROM embeddings")
def vector_norms(spark, sf):
    from corpusmill.functions.vectors import dot, norm, similarity_of_distance

    v = F.col("embedding")
    return _vectors(spark, sf).select("vec_id", F.round(norm(v), 5).alias("length"), F.round(similarity_of_distance(1 - dot(v, v)), 5).alias("sim"))


@query()
def embedded_chunks(spark, sf):
    return embedded(corpus.recursive_chunks(spark, sf), HashingEmbedder()).select("doc_id", "chunk_id", "embedding")


_QA = """qa AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def _qa(spark, sf):
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("turn").over(w).alias("t2"), F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("answer"))
    return pairs.where("role = 'user' AND r2 = 'assistant' AND t2 = turn + 1").select("conv_id", "turn", "question", "answer")


@query(f"WITH {_QA} SELECT conv_id, turn, question, answer FROM qa WHERE trim(answer) <> ''")
def qa_pairs(spark, sf):
    return _qa(spark, sf).where(F.length(tx.py_strip(F.col("answer"))) > 0)


@query(f"WITH {_QA} SELECT conv_id, turn, '<|im_start|>user' || chr(10) || 'Контекст: ' || answer || chr(10) || 'Вопрос: ' || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(answer, chr(10)) || '<|im_end|>' || chr(10) AS rendered FROM qa")
def chatml_pairs(spark, sf):
    q = _qa(spark, sf)
    return q.select("conv_id", "turn", pr.chat_pair(F.col("answer"), F.col("question"), F.col("answer")).alias("rendered"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def chatml_render(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.struct("turn", pr.chat_turn(F.col("role"), F.col("text")).alias("s")).alias("t"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["s"]), "").alias("rendered"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    f"""WITH {_QA} SELECT conv_id, turn, {_quoted(pr.RAG_RULES)} || 'Контекст:' || chr(10) || answer || chr(10) || chr(10) || 'Вопрос: ' || translate(question, '<>', '') || chr(10) || chr(10) || 'Ответ:' AS rag,
    {_quoted(pr.JUDGE_RULES)} || 'Контекст: ' || answer || chr(10) || chr(10) || 'Вопрос: ' || question || chr(10) || chr(10) || 'Ответ ассистента: ' || answer || chr(10) || chr(10) || 'Твой ответ (только "ДА" или "НЕТ"):' AS judge FROM qa"""
)
def prompts(spark, sf):
    q, a = F.col("question"), F.col("answer")
    return _qa(spark, sf).select("conv_id", "turn", pr.rag_prompt(a, q).alias("rag"), pr.judge_prompt(a, q, a).alias("judge"))


@query(f"WITH {_QA} SELECT conv_id, turn, length(question) + length(answer) + {len(pr.RAG_RULES) + len('Контекст:') + len('Вопрос: ') + len('Ответ:') + 5} AS prompt_len, length(question) + 2 * length(answer) + {len(pr.JUDGE_RULES) + len('Контекст: ') + len('Вопрос: ') + len('Ответ ассистента: ') + len('Твой ответ (только ДА или НЕТ):') + 10} AS judge_len FROM qa")
def prompt_lengths(spark, sf):
    q, a = F.col("question"), F.col("answer")
    return _qa(spark, sf).select("conv_id", "turn", F.length(pr.rag_prompt(a, q)).alias("prompt_len"), F.length(pr.judge_prompt(a, q, a)).alias("judge_len"))


@query("WITH t AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations) SELECT conv_id, coalesce(string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) FILTER (upto <= 600), '') AS context, count(*) FILTER (upto <= 600) AS kept FROM t GROUP BY conv_id")
def prompt_budget(spark, sf):
    chunks = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(chunks.alias("chunks"))
    kept = pr.within_budget(F.col("chunks"), 600)
    return c.select("conv_id", F.array_join(kept, pr.CONTEXT_JOIN).alias("context"), F.size(kept).cast("long").alias("kept"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, sum(length(text)) OVER w AS upto, row_number() OVER w AS k, length(translate(first_value(text) OVER w, '<>', '')) AS q FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    fits AS (SELECT *, upto + 5 * (k - 1) AS n, {len(pr.RAG_RULES) + len("Контекст:") + len("Вопрос: ") + len("Ответ:") + 5} + upto + 5 * (k - 1) + q AS prompt FROM t WHERE upto <= 1400)
    SELECT c.conv_id, coalesce(max(n) FILTER (k = 1 OR prompt // 2 <= 700), 0) AS context_len FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN fits USING (conv_id) GROUP BY c.conv_id"""
)
def trimmed_contexts(spark, sf):
    chunks = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(chunks.alias("chunks"), F.min_by("text", "turn").alias("question"))
    return c.select("conv_id", F.length(pr.trimmed_context(F.col("chunks"), F.col("question"), 700)).alias("context_len"))


@query("SELECT event_id, event_type AS question, CAST(round(value, 2) AS VARCHAR) AS answer FROM events")
def qa_json(spark, sf):
    e = table(spark, sf, "events")
    made = F.to_json(F.array(F.struct(F.col("event_type").alias("question"), F.round("value", 2).cast("string").alias("answer"))))
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).otherwise(made)
    return e.select("event_id", F.explode(pr.parse_qa(fenced)).alias("p")).select("event_id", "p.*")


@query("WITH o AS (SELECT l_orderkey, list(CAST(l_partkey % 50 AS INTEGER) ORDER BY l_linenumber, l_partkey % 50) AS ids FROM lineitem GROUP BY 1) SELECT l_orderkey, len(ids) AS n, CAST(list_sum(list_concat(ids[1:4], list_transform(generate_series(1, greatest(8 - least(len(ids), 4), 0)), lambda x: -1))) AS BIGINT) AS padded_sum FROM o")
def token_padding(spark, sf):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 50).cast("int").alias("x")))), lambda s: s["x"])
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ids.alias("ids"))
    padded = pr.padded(pr.truncated(F.col("ids"), 4), F.lit(8), -1)
    return o.select("l_orderkey", F.size("ids").cast("long").alias("n"), F.aggregate(padded, F.lit(0).cast("long"), lambda s, x: s + x).alias("padded_sum"))


@query(
    """WITH o AS (SELECT l_orderkey, list(CAST(l_partkey % 5 AS INTEGER) ORDER BY l_linenumber, l_partkey % 5) AS ids FROM lineitem GROUP BY 1),
    p AS (SELECT l_orderkey, ids, coalesce(list_min(list_filter(generate_series(0, len(ids) - 2), lambda i: ids[i + 1] = 1 AND ids[i + 2] = 2)), -1) AS pos FROM o)
    SELECT l_orderkey, pos >= 0 AS assistant_found, CASE WHEN pos >= 0 THEN pos + 1 ELSE 0 END AS masked FROM p"""
)
def label_mask(spark, sf):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 5).cast("int").alias("x")))), lambda s: s["x"])
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ids.alias("ids")).withColumn("m", pr.mask_labels(F.col("ids"), 1, [2]))
    return o.select("l_orderkey", "m.assistant_found", F.size(F.filter("m.labels", lambda x: x == pr.IGNORED)).cast("long").alias("masked"))
