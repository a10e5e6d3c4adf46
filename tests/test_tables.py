"""Table functions in SQL give what the DataFrame operators give."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import facts, tables
from corpusmill.operators import chunking, segments

SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, "=== Страница 1 ===\nРаздел 1. Общее\n" + "слово число 1,50 и 12.5.24 " * 200 + "=== Страница 2 ===\n2. Условия\n[ТАБЛИЦА]\n| a | b |\n[/ТАБЛИЦА]\nтекст 2024-1-9 и 1e-5, 10000000000000000000000"),
    (2, None), (3, ""), (4, "  \n "), (5, "один"), (6, "0.0001 0,25 3.0 5 007 1e3 31.12.1999 1.2.3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    made = spark.createDataFrame(TEXTS, "doc_id long, text string")
    both = made.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    both.createOrReplaceTempView("made_documents")
    return both


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_chunks(spark, docs):
    got = rows(spark.sql("SELECT doc_id, c.chunk_id, c.chunk FROM made_documents, LATERAL text_chunks(text, 300, 50) AS c"))
    assert got == rows(chunking.recursive_chunks(docs, chunking.Splitter(300, 50))) and len(got) > 500
    got = rows(spark.sql("SELECT doc_id, c.chunk_id, c.chunk, c.chunk_name FROM made_documents, LATERAL section_chunks(text) AS c"))
    assert got == rows(chunking.section_chunks(docs))


def test_segments(spark, docs):
    got = rows(spark.sql("SELECT doc_id, s.* FROM made_documents, LATERAL text_segments(text, 500) AS s"))
    assert got == rows(segments.segments(docs, 500)) and got


def test_facts(spark, docs):
    got = rows(spark.sql("SELECT doc_id, f.fact FROM made_documents, LATERAL text_facts(text) AS f"))
    assert got == rows(docs.select("doc_id", F.explode(facts.extract_facts(F.col("text")))))
    assert (6, "1000") in got and (1, "09.01.2024") in got


@pytest.mark.parametrize("call", ["text_chunks(doc_id)", "text_chunks(text, 10, 10)", "text_chunks(text, CAST(doc_id AS INT))", "text_segments(text, -1)", "text_facts(1)"])
def test_wrong_arguments_fail_before_the_query_runs(spark, docs, call):
    with pytest.raises(Exception, match="takes a string|less than size|whole number"):
        spark.sql(f"SELECT * FROM made_documents, LATERAL {call}")
