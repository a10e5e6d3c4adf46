"""Queries of answer evaluation: facts, grounding, summaries and joins with contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import facts
from corpusmill.functions import text as tx
from corpusmill.operators import bertscore, evaluation
from corpusmill.plans.registry import registry, table
from corpusmill.plans.retrieval import _QA, _qa

QUERIES, ORACLE_SQL, query = registry()

_DATE = "strftime(o_orderdate, '%d.%m.%Y')"


def _answers(spark, sf):
    """A sentence made from each order and one from its line items, which agree in part."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" by "), (F.col("o_custkey") % 7).cast("string")).alias("generated"))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("Order "), F.first("l_orderkey").cast("string"), F.lit(" has "), F.count("*").cast("string"), F.lit(" items")).alias("reference"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))


_ANSWERS = f"""a AS (SELECT o_orderkey, [CAST(o_orderkey AS VARCHAR), {_DATE}, ltrim(strftime(o_orderdate, '%d.%m'), '0'), strftime(o_orderdate, '%Y'), CAST(o_custkey % 7 AS VARCHAR)] AS g, [CAST(o_orderkey AS VARCHAR), CAST(n AS VARCHAR)] AS r
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
  b AS (SELECT o_orderkey, list_distinct(list_transform(g, lambda x: CASE WHEN length(x) - length(replace(x, '.', '')) = 1 THEN rtrim(rtrim(x, '0'), '.') ELSE x END)) AS g, list_distinct(r) AS r FROM a)"""


@query(f"WITH {_ANSWERS} SELECT o_orderkey, round(CASE WHEN len(list_intersect(g, r)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(g, r)) / (len(g) + len(r)) END, 9) AS f1, len(r) > 0 AS has_ref, len(g) > 0 AS has_gen FROM b")
def fact_f1(spark, sf):
    found = _answers(spark, sf).select("o_orderkey", facts.extract_facts(F.col("generated")).alias("g"), facts.extract_facts(F.col("reference")).alias("r"))
    a = found.select("o_orderkey", facts.fact_f1(F.col("g"), F.col("r")).alias("s"))  # each set is made once
    return a.select("o_orderkey", F.round("s.f1", 9).alias("f1"), "s.has_ref", "s.has_gen")


@query(f"WITH {_ANSWERS} SELECT o_orderkey, array_to_string(list_sort(g), ' ') AS found FROM b")
def extracted_facts(spark, sf):
    return _answers(spark, sf).select("o_orderkey", F.array_join(F.array_sort(facts.extract_facts(F.col("generated"))), " ").alias("found"))


@query(r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[0-9]+'))) > 0 AS BOOLEAN) AS has_digits FROM documents")
def documents_with_digits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike("[0-9]").alias("has_digits"))


@query("SELECT o_orderkey, CAST(o_custkey % 7 AS VARCHAR) IN (CAST(o_orderkey AS VARCHAR), CAST(n AS VARCHAR)) AS grounded, CASE WHEN CAST(o_custkey % 7 AS VARCHAR) IN (CAST(o_orderkey AS VARCHAR), CAST(n AS VARCHAR)) THEN 'Answer ' || (o_custkey % 7) ELSE 'Информация не найдена' END AS answer FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def number_guard(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"))
    answer = F.concat(F.lit("Answer "), (F.col("o_custkey") % 7).cast("string"))
    noted = F.concat(answer, F.lit(" (Источник: заказ 5)"))
    chunks = F.array(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("items "), F.col("n").cast("string")))
    return o.select("o_orderkey", facts.numbers_grounded(answer, chunks).alias("grounded"), facts.guarded_answer(noted, chunks).alias("answer"))


@query("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 1::BIGINT WHEN 1 THEN 0 END AS faithful FROM orders")
def verdicts(spark, sf):
    said = F.when(F.col("o_custkey") % 3 == 0, " да.").when(F.col("o_custkey") % 3 == 1, "НЕТ, не так").otherwise("может быть")
    return table(spark, sf, "orders").select("o_orderkey", facts.verdict(said).alias("faithful"))


@query("WITH v AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS f FROM orders) SELECT count(*) AS total_examples, count(f) AS evaluated_examples, count(*) FILTER (f = 1) AS faithful_count, count(*) FILTER (f = 0) AS unfaithful_count, coalesce(round(avg(f), 4), 0) AS faithfulness_score FROM v")
def faithfulness_report(spark, sf):
    return evaluation.faithfulness(verdicts(spark, sf))


@query("WITH c AS (SELECT conv_id, role, nullif(trim(max_by(text, turn)), '') AS context, count(*) AS entries FROM conversations GROUP BY conv_id, role) SELECT a.conv_id, a.role, a.turn, c.context, c.entries FROM conversations a LEFT JOIN c ON a.conv_id = c.conv_id AND a.role = c.role AND c.role <> 'system'")
def last_wins_context_join(spark, sf):
    c = table(spark, sf, "conversations")
    contexts = c.where("role <> 'system'").select("conv_id", "role", "turn", F.col("text").alias("context"))
    return evaluation.with_contexts(c.select("conv_id", "role", "turn"), contexts, ["conv_id", "role"], "turn")


@query("SELECT count(*) AS num_examples, count(*) FILTER (toxic = 1) AS examples_with_facts, count(*) FILTER (toxic = 0) AS examples_without_facts, avg(quality) AS avg_quality, 0.75::DOUBLE AS target_quality, avg(quality) >= 0.75 AS quality_met, avg(toxic) AS avg_toxic, 0.5::DOUBLE AS target_toxic, avg(toxic) >= 0.5 AS toxic_met FROM labels")
def eval_summary(spark, sf):
    labels = table(spark, sf, "labels").withColumn("facts", F.col("toxic") == 1)
    return evaluation.summary(labels, {"quality": 0.75, "toxic": 0.5}, "facts")


@query("WITH r AS (SELECT d.source, row_number() OVER w AS n, avg(l.quality) OVER w AS avg_quality, avg(l.toxic) OVER w AS avg_toxic FROM labels l JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY d.source ORDER BY l.doc_id ROWS UNBOUNDED PRECEDING)) SELECT source, n, round(avg_quality, 9) AS avg_quality, round(avg_toxic, 9) AS avg_toxic FROM r WHERE n % 5 = 0")
def running_avg(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    out = evaluation.running_averages(rows, ["source"], "doc_id", ["quality", "toxic"], 5)
    return out.select("source", "n", F.round("avg_quality", 9).alias("avg_quality"), F.round("avg_toxic", 9).alias("avg_toxic"))


@query("SELECT count(length(text)) AS n, avg(length(text)) AS mean, median(length(text)) AS median, min(length(text)) AS min, max(length(text)) AS max, round(stddev_pop(length(text)), 6) AS std FROM documents")
def length_stats(spark, sf):
    d = evaluation.describe(table(spark, sf, "documents").select(F.length("text").alias("n")), "n")
    return d.withColumn("std", F.round("std", 6))


#: The longest common subsequence by rows: a cell is the greatest of those before it, of the one above, and, where words match, one more than the one above and before.
_ROUGE = rf"""WITH RECURSIVE {_QA},
words AS (SELECT conv_id, turn, kind, regexp_extract_all(lower(answer), p) AS a, regexp_extract_all(lower(question), p) AS b FROM qa, (VALUES ('ascii', '[a-z0-9]+'), ('unicode', '[\pL\pN_]+')) k(kind, p)),
cells AS (
  SELECT conv_id, turn, kind, a, b, 0 AS i, list_transform(b, lambda x: 0) AS above FROM words
  UNION ALL SELECT conv_id, turn, kind, a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN coalesce(above[k - 1], 0) + 1 ELSE above[k] END)))
  FROM cells WHERE i < len(a)),
scores AS (SELECT conv_id, turn, kind, CASE WHEN coalesce(list_max(above), 0) = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * list_max(above) / (len(a) + len(b)), 9) END AS f FROM cells WHERE i = len(a))
SELECT conv_id, turn, max(f) FILTER (kind = 'ascii') AS rouge_l, max(f) FILTER (kind = 'unicode') AS rouge_l_unicode FROM scores GROUP BY conv_id, turn"""


@query(_ROUGE)
def rouge_l(spark, sf):
    q = _qa(spark, sf)
    return q.select("conv_id", "turn", F.round(evaluation.rouge_l(F.col("answer"), F.col("question")), 9).alias("rouge_l"), F.round(evaluation.rouge_l(F.col("answer"), F.col("question"), True), 9).alias("rouge_l_unicode"))


@query(f"WITH {_QA} SELECT conv_id, turn, trim(answer) AS cleaned FROM qa")
def cleaned_responses(spark, sf):
    q = _qa(spark, sf)
    said = F.concat(F.lit("<think>\n"), F.col("question"), F.lit("\n</think>\n"), F.col("answer"), F.lit("</think> "))
    return q.select("conv_id", "turn", tx.clean_response(said).alias("cleaned"))


_SENTENCES = "t AS (SELECT vec_id // 6 AS s, vec_id % 6 AS p, 'w' || label AS token, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(
    f"""WITH {_SENTENCES}, refs AS (SELECT * FROM t WHERE s % 2 = 1), m AS (SELECT count(DISTINCT s) AS m FROM refs),
    idf AS (SELECT token, ln((any_value(m) + 1) / (count(DISTINCT s) + 1)) AS w FROM refs, m GROUP BY token),
    cos AS (SELECT g.s, g.p AS gp, r.p AS rp, g.token AS gt, r.token AS rt, list_dot_product(g.v, r.v) / (sqrt(list_dot_product(g.v, g.v)) * sqrt(list_dot_product(r.v, r.v))) AS c FROM t g JOIN refs r ON r.s = g.s + 1 WHERE g.s % 2 = 0),
    p AS (SELECT s, sum(c * w) / sum(w) AS precision FROM (SELECT s, gp, max(c) AS c, coalesce(any_value(w), ln((SELECT m FROM m) + 1)) AS w FROM cos LEFT JOIN idf ON gt = token GROUP BY s, gp) GROUP BY s),
    r AS (SELECT s, sum(c * w) / sum(w) AS recall FROM (SELECT s, rp, max(c) AS c, any_value(w) AS w FROM cos JOIN idf ON rt = token GROUP BY s, rp) GROUP BY s)
    SELECT s AS id, round(precision, 8) AS precision, round(recall, 8) AS recall, round(2 * precision * recall / (precision + recall), 8) AS f1 FROM p JOIN r USING (s)"""
)
def bert_scores(spark, sf):
    """Six vectors in a row as a text's tokens, named by their labels; every second text is the reference of the one before."""
    v = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("s"), F.struct((F.col("vec_id") % 6).alias("p"), F.concat(F.lit("w"), "label").alias("token"), F.col("embedding").alias("v")).alias("t"))
    texts = v.groupBy("s").agg(F.sort_array(F.collect_list("t")).alias("t")).select("s", F.col("t.token").alias("tokens"), F.col("t.v").alias("vectors"))
    named = lambda d, n: d.select((F.col("s") - F.col("s") % 2).alias("id"), F.col("tokens").alias(f"{n}_tokens"), F.col("vectors").alias(f"{n}_vectors"))
    references = texts.where("s % 2 = 1")
    pairs = named(texts.where("s % 2 = 0"), "generated").join(named(references, "reference"), "id")
    found = bertscore.bert_score(pairs, idf=bertscore.token_idf(references))
    return found.select("id", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])
