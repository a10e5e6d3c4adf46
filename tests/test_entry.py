import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from corpusmill.providers import HashingEmbedder

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "match_id", "sim", "rank"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["knn_topk", "greedy_segments", "fact_f1", "rate_limit", "group_split", "header_footer_removal", "last_wins_context_join"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "orders", "lineitem", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    show = lambda rows: Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert show(tuple(r) for r in df.select(*names).collect()) == show(want)


def test_every_chunk_is_embedded(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(400))
    spark.createDataFrame([(1, text), (2, "one chunk"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["embedded_chunks"](spark, str(tmp_path)).collect()
    chunks = {(r["doc_id"], r["chunk_id"]): r["text"] for r in entry.queries()["recursive_chunks"](spark, str(tmp_path)).collect()}
    assert {(r["doc_id"], r["chunk_id"]) for r in got} == set(chunks) and any(c > 0 for _, c in chunks)
    by_hand = {k: HashingEmbedder().embed([t])[0] for k, t in chunks.items()}
    assert all(abs(x - y) < 1e-6 for r in got for x, y in zip(r["embedding"], by_hand[r["doc_id"], r["chunk_id"]], strict=True))


def test_odd_lines_go_as_in_sql(spark, tmp_path):
    """Line ends at the end and of other kinds, white space that isn't a space, digits that aren't ASCII, empty texts, ids and sources that are missing or shared."""
    duckdb = pytest.importorskip("duckdb")
    heads = ["12", "٣٤", "a page", "страница", "\tab", "\u00a0ab ", "ab\u000bcd", "ΑΣ", "ασ", "İ", "a\u00a0bcd"]
    rows = [(100 + 50 * j + k, f"{h}\nsome words {k}", f"s{j}") for j, h in enumerate(heads) for k in range(30)]
    rows += [(1, "", "s0"), (2, "12", "s0"), (3, "12\n", "s0"), (4, "one line\n", "s0"), (5, "carriage\r\nreturn\u2028and\u0085more\f", "s0"), (6, "\n\n", "s2"), (7, None, "s0"), (8, "12\nrest", None)]
    rows += [(9, "12\nthis text twice", "s0"), (9, "12\nthis text twice", "s0"), (9, "12", "s1"), (None, "\nlast", "s1"), (None, "12", "s0"), (100, "12\n12\nthird line", "s0")]
    # a line of one page and of all those without an id
    rows += [(2000 + k, "body text", "few") for k in range(50)] + [(2100, "to", "few"), (None, "to", "few"), (None, "to", "few")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, text FROM ({entry.oracle_sql()['header_footer_removal']})").fetchall()
    got = entry.queries()["header_footer_removal"](spark, str(tmp_path)).select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter(want)
