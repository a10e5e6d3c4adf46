"""Queries that write tables in each format and read them back, and queries over uploads and pages."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import prompts as pr
from corpusmill.functions import text as tx
from corpusmill.operators import chat, layout, splitting
from corpusmill.plans.registry import registry, table
from corpusmill.session import work_path
from corpusmill.sources import documents, readers, sinks

QUERIES, ORACLE_SQL, query = registry()

_CONV = "conv_id long, turn long, role string, text string"


def _said(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


@query("SELECT n_name || '.txt' AS file_name, n_name || chr(10) || n_nationkey || chr(10) AS content FROM nation")
def text_dir_scan(spark, sf):
    path = work_path(spark, "text")
    made = table(spark, sf, "nation").select("n_name", F.concat("n_name", F.lit("\n"), F.col("n_nationkey").cast("string")).alias("content"))
    sinks.text_per_document(made, path, "n_name", "content")
    return readers.text_files(spark, path, folder="name")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines_scan(spark, sf):
    path = work_path(spark, "jsonl")
    sinks.json_rows(_said(spark, sf), path)
    return readers.json_lines(spark, path, _CONV)


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn LIMIT 210")
def json_lines_limit(spark, sf):
    path = work_path(spark, "jsonl")
    sinks.json_rows(_said(spark, sf), path)
    return readers.json_lines(spark, path, _CONV, limit=210, order=["conv_id", "turn"])


@query("SELECT conv_id, turn, count(*) * 2 AS n FROM conversations GROUP BY conv_id, turn")
def json_lines_append(spark, sf):
    path = work_path(spark, "jsonl")
    for _ in range(2):
        sinks.json_rows(_said(spark, sf), path, append=True)
    return readers.json_lines(spark, path, _CONV).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_id % 7 = 3 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n, CAST(sum(CASE WHEN event_id % 7 = 3 THEN length(event_type) + 1 ELSE user_id END) AS BIGINT) AS total FROM events WHERE event_id % 11 <> 5 GROUP BY 1")
def json_lines_and_bad(spark, sf):
    e, path = table(spark, sf, "events"), work_path(spark, "jsonl")
    line = F.when(F.col("event_id") % 11 == 5, " ").when(F.col("event_id") % 7 == 3, F.concat(F.lit("{"), F.col("event_type"))).otherwise(F.to_json(F.struct("user_id")))
    sinks.text(e.select(line.alias("line")), path, "line")
    good, bad = readers.json_lines_and_bad(spark, path, "user_id long")
    told = good.select(F.lit("good").alias("kind"), "user_id").unionByName(bad.select(F.lit("bad").alias("kind"), F.length("line").cast("long").alias("user_id")))
    return told.groupBy("kind").agg(F.count("*").alias("n"), F.sum("user_id").alias("total"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang AS language, text AS content, CAST(n_chars AS BIGINT) AS original_length, CAST(NULL AS BIGINT) AS prepared_length FROM documents")
def json_array_scan(spark, sf):
    path = work_path(spark, "json")
    sinks.json_array(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("language"), F.col("text").alias("content"), F.col("n_chars").cast("int").alias("original_length")), path)
    return readers.json_array(spark, path)


@query("SELECT conv_id AS doc_id, role AS question, text AS generated, CASE WHEN turn % 3 = 2 THEN NULL ELSE CAST(turn % 3 AS BIGINT) END AS faithful FROM conversations")
def csv_scan(spark, sf):
    path = work_path(spark, "csv")
    rows = _said(spark, sf).select(F.col("conv_id").alias("doc_id"), F.col("role").alias("question"), F.col("text").alias("generated"), F.when(F.col("turn") % 3 != 2, F.col("turn") % 3).alias("faithful"))
    sinks.csv_rows(rows, path)
    return readers.csv_table(spark, path, "doc_id long, question string, generated string, faithful long")


@query("SELECT conv_id, role FROM conversations WHERE 1 = 0")
def csv_without_columns(spark, sf):
    path = work_path(spark, "csv")
    sinks.csv_rows(_said(spark, sf).drop("role"), path)
    return readers.csv_table(spark, path, needs=("conv_id", "role"), strict=False).select(F.col("conv_id").cast("long").alias("conv_id"), "role")


@query("SELECT conv_id AS doc_id, role AS question, text AS answer FROM conversations WHERE coalesce(text, '') <> ''")
def dataset_load(spark, sf):
    path = work_path(spark, "jsonl")
    sinks.json_rows(_said(spark, sf).select(F.col("conv_id").alias("doc_id"), F.col("role").alias("question"), F.col("text").alias("answer"), F.lit("x").alias("more")), path)
    found = readers.require(readers.json_lines(spark, path, "doc_id long, question string, answer string, more string"), ["doc_id", "question", "answer"])
    return readers.complete_rows(found).drop("more")


@query(
    """WITH g AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('42:' || CAST(conv_id AS VARCHAR)), conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT c.conv_id, c.turn, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM conversations c JOIN g USING (conv_id)"""
)
def split_files(spark, sf):
    path = work_path(spark, "splits")
    sinks.splits(splitting.group_split(table(spark, sf, "conversations"), "conv_id"), path)
    return spark.read.schema("conv_id long, turn long, split string").json(path)


@query("SELECT size, n FROM (SELECT CASE WHEN length(text) < 5000 THEN 'small' WHEN length(text) < 30000 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM documents GROUP BY 1)")
def json_report(spark, sf):
    path = work_path(spark, "report")
    sinks.report(table(spark, sf, "documents").groupBy(tx.size_bucket(F.length("text")).alias("size")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("size string, n long").json(path)


@query("SELECT CAST(label AS VARCHAR) AS collection, vec_id AS chunk_id, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings WHERE label = 3")
def vector_collection(spark, sf):
    path = work_path(spark, "vectors")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    for label in [r[0] for r in v.select("label").distinct().orderBy("label").collect()]:  # ten
        sinks.collection(v.where(F.col("label") == label), path, str(label))
    sinks.collection(v.where("label = 3"), path, "3")  # again: nothing is repeated
    found = readers.collection(spark, path, "3")
    return found.select(F.col("collection").cast("string").alias("collection"), "chunk_id", F.col("embedding")[0].cast("double").alias("first"))


_PAGES = r"""p AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '([\pL\pN_]+)- +([\pL\pN_]+)', '\1\2', 'g')) AS page FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id % 9 <> 4) WHERE trim(line) <> '')"""


@query(
    rf"""WITH {_PAGES}, t AS (SELECT doc_id, string_agg('=== Страница ' || i || ' ===' || chr(10) || page, chr(10) || chr(10) ORDER BY i) AS text, count(*) AS pages FROM p GROUP BY doc_id)
    SELECT 'd' || d.doc_id || '.pdf' AS file_name, 'd' || d.doc_id || '.txt' AS text_name, t.text, coalesce(t.pages, 0) AS pages,
      CASE WHEN d.doc_id % 9 = 4 THEN 'ОШИБКА: d' || d.doc_id || '.pdf - ValueError damaged' WHEN t.text IS NULL THEN 'ВНИМАНИЕ: d' || d.doc_id || '.pdf'
        ELSE 'УСПЕХ: d' || d.doc_id || '.pdf -> d' || d.doc_id || '.txt (' || t.pages || ')' END AS status
    FROM documents d LEFT JOIN t USING (doc_id)"""
)
def converted_pdfs(spark, sf):
    """The documents as files whose pages are lines; the stand-in for a decoder takes the lines, and refuses every ninth."""

    def pages(content: bytes) -> list[str]:
        mark, _, body = content.partition(b"\n")
        if mark != b"%PDF":
            raise ValueError("damaged")
        return body.decode().split("\n")

    d = table(spark, sf, "documents")
    content = F.encode(F.concat(F.when(F.col("doc_id") % 9 == 4, "").otherwise("%PDF\n"), F.col("text")), "utf-8")
    return documents.converted(d.select(F.format_string("d%d.pdf", "doc_id").alias("file_name"), content.alias("content")), pages)


def _docx(name: str, key: int) -> bytes:
    w, out = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", io.BytesIO()
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p(name) + p(" ") + f"<w:tbl><w:tr>{cell('a|b')}{cell(name)}</w:tr><w:tr>{cell(key)}</w:tr></w:tbl>" + p("end")
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _files(spark, sf, kinds: tuple = (0, 1, 2, 3)) -> DataFrame:
    """A file for each nation, of these kinds in turn: DOCX, PDF after NUL bytes, an archive of another kind, and plain bytes."""

    def run(batches):
        for pdf in batches:
            plain = io.BytesIO()
            with zipfile.ZipFile(plain, "w") as z:
                z.writestr("x.txt", "x")
            made = [[_docx(n, k), b"\0\0%PDF-1.7", plain.getvalue(), b"x%PDF"][kinds[k % len(kinds)]] for n, k in zip(pdf["n_name"], pdf["n_nationkey"])]
            yield pd.DataFrame({"key": pdf["n_nationkey"], "file_name": [f"f{k}.{'pdf' if kinds[k % len(kinds)] in (1, 3) else 'docx'}" for k in pdf["n_nationkey"]], "content": made})

    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").mapInPandas(run, "key long, file_name string, content binary")


@query("SELECT n_nationkey AS key, n_nationkey % 4 = 1 AS pdf, n_nationkey % 4 = 0 AS docx, CASE WHEN n_nationkey % 4 IN (2, 3) THEN 422::BIGINT ELSE 200 END AS status FROM nation")
def magic_checks(spark, sf):
    found = documents.checked_uploads(_files(spark, sf))
    return found.select("key", tx.is_pdf(F.col("content")).alias("pdf"), documents.is_docx(F.col("content")).alias("docx"), "status")


@query("SELECT 'f' || n_nationkey || '.docx' AS file_name, n_name || chr(10) || '[ТАБЛИЦА]' || chr(10) || '| a b | ' || n_name || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' |  |' || chr(10) || '[/ТАБЛИЦА]' || chr(10) || 'end' AS text, 'OK' AS status FROM nation")
def docx_texts(spark, sf):
    return documents.extracted(_files(spark, sf, (0,)))


@query("SELECT n_nationkey, '| h  t |' || chr(10) || '| --- |' || chr(10) || '| ' || n_name || ' |' AS md FROM nation")
def docx_tables(spark, sf):
    rows = F.array(F.array(F.lit("h|\tt")), F.array("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", layout.markdown_table(rows, drop_empty=False).alias("md"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'name' WHEN doc_id % 5 = 4 THEN 'extension' WHEN doc_id % 7 = 3 THEN 'type' WHEN doc_id % 6 = 5 THEN 'size' WHEN doc_id % 5 IN (1, 3) THEN 'content' END AS refusal FROM documents"""
)
def upload_refusals(spark, sf):
    d = F.col("doc_id")
    name = F.concat(F.when(d % 13 == 0, F.repeat(F.lit("n"), 260)).otherwise("f"), F.element_at(F.array(*map(F.lit, (".pdf", ".PDF", ".docx", ".docx", ".exe"))), (d % 5 + 1).cast("int")))
    mime = F.when(d % 7 == 3, "text/plain").when(d % 2 == 0, "application/pdf")
    size = F.when(d % 6 == 5, 30000000).otherwise(100)
    return table(spark, sf, "documents").select("doc_id", chat.upload_refusal(name, size, mime, d % 5 == 0, d % 5 == 2).alias("refusal"))


@query(
    """WITH o AS (SELECT l_orderkey, list(CAST(l_partkey % 5 AS INTEGER) ORDER BY l_linenumber, l_partkey % 5) AS ids FROM lineitem GROUP BY 1),
    p AS (SELECT l_orderkey, ids, coalesce(list_min(list_filter(generate_series(0, len(ids) - 2), lambda i: ids[i + 1] = 1 AND ids[i + 2] = 2)), -1) AS pos FROM o)
    SELECT l_orderkey, len(ids) AS n FROM p WHERE pos >= 0"""
)
def trainable_rows(spark, sf):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 5).cast("int").alias("x")))), lambda s: s["x"])
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ids.alias("ids")).withColumn("m", pr.mask_labels(F.col("ids"), 1, [2]))
    return o.where(pr.trainable(F.col("m.labels"), F.col("m.assistant_found"))).select("l_orderkey", F.size("ids").alias("n"))


@query(
    """SELECT l_orderkey AS page, string_agg(CASE WHEN l_linenumber % 3 = 0 THEN chr(10) || '[ТАБЛИЦА]' || chr(10) || 't' || l_linenumber || chr(10) || '[/ТАБЛИЦА]' ELSE 'w' || l_linenumber END, chr(10)
      ORDER BY CAST(l_suppkey % 50 AS DOUBLE), l_linenumber % 3 <> 0, CASE WHEN l_linenumber % 3 = 0 THEN chr(10) || '[ТАБЛИЦА]' || chr(10) || 't' || l_linenumber ELSE 'w' || l_linenumber END) AS text FROM lineitem GROUP BY 1"""
)
def page_texts(spark, sf):
    is_table, number = F.col("l_linenumber") % 3 == 0, F.col("l_linenumber").cast("string")
    elements = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 50).cast("double").alias("y"), F.when(is_table, "table").otherwise("text").alias("kind"), F.concat(F.when(is_table, "t").otherwise("w"), number).alias("text"))
    return layout.page_text(elements)


@query("SELECT conv_id, turn, text FROM conversations")
def selected_columns(spark, sf):
    return table(spark, sf, "conversations").drop("role").select("conv_id", "turn", "text")
