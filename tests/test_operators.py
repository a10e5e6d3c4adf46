import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import chat, chunking, corpus, evaluation, layout, retrieval, segments, splitting
from corpusmill.providers import EchoGenerator, HashingEmbedder, embedded, generated, judge_delay, judged, with_retries


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_splitter_properties(text, size, overlap):
    chunks = chunking.Splitter(size, overlap).split(text)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    at = 0
    for c in chunks:  # in order, each a piece of the text
        at = text.index(c, max(0, at - size))
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_splitter_cases():
    s = chunking.Splitter(10, 4)
    assert s.split("aaaa bbbb cccc dddd") == ["aaaa bbbb", "cccc dddd"]
    assert chunking.Splitter(10, 5).split("aaaa bbbb cccc dddd") == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert s.split("x" * 25) == ["x" * 10, "x" * 10, "x" * 10, "x" * 7]  # each four into the one before
    assert s.split("") == [] and s.split(" \n ") == []
    assert chunking.Splitter(12, 0).split("one. two. three") == ["one. two", ". three"]


def test_sections():
    text = "Раздел 1.\na\n[ТАБЛИЦА]\nt\n[/ТАБЛИЦА]\nb\n[PAGE_BREAK]\nc\nСроки:"
    got = [(s.kind, s.heading, s.body) for s in chunking.sections(text)]
    assert got == [("table", "Раздел 1.", "[ТАБЛИЦА]\nt\n[/ТАБЛИЦА]"), ("text", "Раздел 1.", "a\n\nb\nc"), ("text", "Сроки:", "")]
    assert chunking.section_texts("Сроки:\nx", chunking.Splitter()) == ["Раздел: Сроки:\nx"]
    assert chunking.section_texts("Сроки:", chunking.Splitter()) == ["Раздел: Сроки:"]
    assert [s.kind for s in chunking.sections("")] == ["text"]


def test_char_windows(spark):
    df = spark.createDataFrame([("abcdefgh",), ("abc",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(chunking.char_windows(F.col("t"), 4, 1)).collect()]
    assert got == [["abcd", "defg", "gh"], ["abc"], [], []]
    with pytest.raises(ValueError):
        chunking.char_windows(F.lit("a"), 3, 3)


def test_section_chunks(spark):
    df = spark.createDataFrame([(1, "Сроки:\nдо 5 мая"), (2, ""), (3, None)], "doc_id long, text string")
    got = chunking.section_chunks(df).collect()
    assert [(r["doc_id"], r["chunk_id"], r["text"], r["chunk_name"]) for r in got] == [(1, 0, "Раздел: Сроки:\nдо 5 мая", "chunk_0000")]
    assert chunking.recursive_chunks(df).count() == 1


def greedy(sizes, budget):
    out = []
    for k, n in enumerate(sizes, 1):
        if out and out[-1][2] + n <= budget:
            out[-1] = (out[-1][0], k, out[-1][2] + n)
        else:
            out.append((k, k, n))
    return [(f"{a}-{b}", n) for a, b, n in out]


def test_segments(spark):
    rng = random.Random(1)
    docs = [[rng.randint(0, 12) for _ in range(rng.randint(0, 9))] for _ in range(30)]
    rows = [(k, " ".join(f"=== Страница {'x' * max(1, 4 * n)}" for n in d)) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for r in segments.segments(df, 10).orderBy("doc_id", "segment").collect():
        got.setdefault(r["doc_id"], []).append((r["page_range"], r["token_estimate"]))
    assert got == {k: greedy(d, 10) for k, d in enumerate(docs) if d}


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[5] = x[4]  # a tie
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(300, [0.0] * 8), (301, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {(r["query_id"], r["rank"]): (r["match_id"], r["sim"]) for r in retrieval.knn(df.where("vec_id < 10 OR vec_id >= 300"), df, 4, 0.2, skip_same=True).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {}
    for q in range(10):
        s = np.round(u @ u[q], 6)
        order = sorted((k for k in range(300) if k != q and s[k] >= 0.2), key=lambda k: (-s[k], k))[:4]
        want |= {(q, n): (k, s[k]) for n, k in enumerate(order, 1)}
    assert got == want
    assert retrieval.knn(df.limit(0), df).count() == 0


def test_context(spark):
    ranked = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2), (2, 10, 0.1, 1)], "left_id long, right_id long, sim double, rank int")
    texts = spark.createDataFrame([(10, "a"), (11, "b")], "id long, text string")
    got = retrieval.contexts(ranked, texts, "id").collect()
    assert [(r["left_id"], r["n"], r["best_sim"], r["context"]) for r in got] == [(1, 2, 0.9, "a\n---\nb")]


@pytest.mark.parametrize(("n", "want"), [(175, (122, 26, 27)), (1, (0, 0, 1)), (2, (1, 0, 1)), (7, (4, 1, 2))])
def test_group_split(spark, n, want):
    df = spark.range(n).selectExpr("id AS doc_id", "explode(sequence(1, 3)) AS qa")
    stats = {r["split"]: (r["docs"], r["qa_pairs"]) for r in splitting.split_stats(splitting.group_split(df, "doc_id"), "doc_id").collect()}
    assert tuple(stats.get(s, (0, 0))[0] for s in splitting.SPLITS) == want
    assert sum(q for _, q in stats.values()) == 3 * n


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
def test_lcs(a, b):
    assert evaluation.lcs_length(a, b) == brute_lcs(a, b)


def test_rouge():
    assert evaluation.rouge_l_score("a b c", "A c") == pytest.approx(0.8)
    assert evaluation.rouge_l_score("да", "да") == 0.0
    assert evaluation.rouge_l_score("да", "да", evaluation.UNICODE_TOKENS) == 1.0
    assert evaluation.rouge_l_score(None, "") == 0.0


def test_evaluation(spark):
    c = spark.createDataFrame([("d", "q", 1, "old"), ("d", "q", 2, "new"), ("e", "q", 1, " ")], "doc_id string, question string, seq int, context string")
    r = spark.createDataFrame([("d", "q"), ("e", "q"), ("f", "q")], "doc_id string, question string")
    got = {x["doc_id"]: (x["context"], x["entries"]) for x in evaluation.with_contexts(r, c, ["doc_id", "question"], "seq").collect()}
    assert got == {"d": ("new", 2), "e": (None, 1), "f": (None, None)}
    v = spark.createDataFrame([(1,), (0,), (None,), (1,)], "faithful int")
    assert tuple(evaluation.faithfulness(v).first()) == (4, 3, 2, 1, 0.6667)
    assert evaluation.faithfulness(v.limit(0)).first()["faithfulness_score"] == 0.0
    best = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, None)], "query_id long, best_sim double")
    assert tuple(evaluation.search_accuracy(best).first()) == (4, 75.0, 0.575, 2, 4)


def test_rate_limit(spark):
    assert chat.accepted([0, 1, 2, 3, 4], 2) == [True, False, True, False, True]
    rows = spark.range(5).selectExpr("1L AS user_id", "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts")
    got = [r["accepted"] for r in chat.rate_limited(rows, "user_id", "ts", "event_id", 2).orderBy("id").collect()]
    assert got == [True, False, True, False, True]


def test_sessions(spark):
    gaps = {1: 3599, 2: 3600, 3: 3601}
    rows = [(u, t) for u, g in gaps.items() for t in (0, g)]
    df = spark.createDataFrame(rows, "user_id int, s int").selectExpr("user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts")
    got = {r["user"]: r["n"] for r in chat.inactivity_sessions(df, "user_id", "ts").groupBy("user").agg(F.count("*").alias("n")).collect()}
    by_gap = {r["user"]: r["n"] for r in chat.sessions_by_gap(df, "user_id", "ts").groupBy("user").agg(F.max("session").alias("n")).collect()}
    assert got == by_gap == {1: 1, 2: 1, 3: 2}


def test_uploads(spark):
    rows = [("a.pdf", 5, True, False), ("a.pdf", 5, False, False), ("a.docx", 5, False, True), ("a.exe", 5, False, False), ("a.pdf", 30_000_000, True, False), ("a.pdf", 0, False, False), (None, 1, True, True)]
    df = spark.createDataFrame(rows, "n string, s int, p boolean, d boolean")
    c = F.col
    assert [r[0] for r in df.select(chat.upload_status(c("n"), c("s"), c("p"), c("d"))).collect()] == [200, 422, 200, 400, 413, 400, 400]
    assert [r[0] for r in df.select(chat.upload_refusal(c("n"), c("s"), F.lit(None).cast("string"), c("p"), c("d"))).collect()] == [None, "content", None, "extension", "size", "content", "extension"]


def test_headers_and_footers(spark):
    pages = [("d", k, f"Отчёт а\n{5}\nтекст страницы {k}\nстраница отчёта\nДлинная строка") for k in range(10)] + [("e", k, "5\nx") for k in range(3)]
    df = spark.createDataFrame(pages, "doc string, page int, text string").withColumnRenamed("doc", "name")
    gone = {r["line"] for r in corpus.repeated_lines(df, "name", "page").collect()}
    assert gone == {"5", "страница отчёта"}
    kept = {(r["name"], r["page"]): r["text"] for r in corpus.without_repeated_lines(df, "name", "page").collect()}
    assert kept["d", 0] == "Отчёт а\nтекст страницы 0\nДлинная строка" and kept["e", 0] == "5\nx"


def test_layout(spark):
    words = [(1, 0.0, 0.0, 10.0, 5.0, "a"), (1, 100.0, 2.0, 110.0, 5.0, "b"), (1, 20.0, 3.0, 30.0, 5.0, "c"), (1, 0.0, 9.0, 5.0, 12.0, "d")]
    df = spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, y1 double, word string")
    assert [(r["y"], r["text"]) for r in layout.text_lines(df).orderBy("y").collect()] == [(0.0, "a c \t b"), (9.0, "d")]
    zone = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 4.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["word"] for r in layout.words_outside(df, zone).collect()) == ["b", "d"]
    rows = spark.createDataFrame([([["a", None, "b"], ["", "", ""], ["c\nd", ""]],), ([["x"]],), (None,)], "r array<array<string>>")
    assert [r[0] for r in rows.select(layout.markdown_table(F.col("r"))).collect()] == ["| a | b |\n| --- | --- |\n| c d |  |", "", ""]
    assert [r[0] for r in rows.select(layout.markdown_table(F.col("r"), False)).collect()][1] == "| x |\n| --- |"
    z = zone.withColumn("zone_id", F.lit(1).cast("long"))
    t = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 3.0, 7), (1, 0.0, 0.0, 10.0, 4.0, 8)], "page int, x0 double, y0 double, x1 double, y1 double, table_id long")
    assert [(r["zone_id"], r["table_id"], r["iou"]) for r in layout.matched_tables(z, t).collect()] == [(1, 7, 0.75)]


def test_providers(spark):
    waits = []
    tries = iter([None, ValueError(), "x"])

    def call():
        got = next(tries)
        if isinstance(got, Exception):
            raise got
        return got

    assert with_retries(call, 3, judge_delay, waits.append) == "x" and waits == [2.0, 4.0]
    assert with_retries(lambda: None, 2, sleep=waits.append) is None
    df = spark.createDataFrame([("a b", "x\nДА"), ("", "y\nнет"), (None, None)], "text string, prompt string")
    size = [np.linalg.norm(r["embedding"]) for r in embedded(df, HashingEmbedder(16)).collect()]
    assert size == pytest.approx([1, 0, 0])
    assert [r["generated"] for r in generated(df, EchoGenerator()).collect()] == ["ДА", "нет", None]
    assert [r["faithful"] for r in judged(df, EchoGenerator()).collect()] == [1, 0, None]


def test_profile(spark):
    docs = spark.createDataFrame([("a.txt", "=== Страница 1 ===\nабв"), ("b.txt", "x" * 6000), ("c.txt", None)], "name string, text string")
    found = corpus.profiled(docs, "name")
    report = corpus.profile(found).first()
    assert (report["total_documents"], report["small"], report["medium"], report["large"], report["avg_pages"]) == (3, 2, 1, 0, 1.0)
    assert report["by_language"] == {"eng": 2, "rus": 1} and report["by_pages"] == {1: 3}
    assert corpus.profile(found.limit(0)).first()["avg_pages"] == 0.0
    assert [r["original_pdf"] for r in corpus.catalog(docs, "name").collect()] == ["a.pdf", "b.pdf", "c.pdf"]


@pytest.mark.parametrize("block", [2048, 7])
def test_similarity_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)).astype(np.float32)
    x[7] = x[8]  # a tie
    rows = [(k, k % 3 if k < 45 else 0, v.tolist()) for k, v in enumerate(x)] + [(100, 0, [0.0] * 6), (101, 0, None), (102, None, x[0].tolist()), (103, 9, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, doc int, v array<float>").withColumn("k", F.lit(1)).withColumn("n", F.lit(2))
    got = {(r["left_id"], r["rank"]): (r["doc"], r["right_id"], r["sim"]) for r in retrieval.similarity_join(df, df, "doc", "id", "id", "v", 3, 0.0).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want, doc = {}, {k: d for k, d, _ in rows}
    for a in range(60):
        s = np.round(u @ u[a], 6)
        order = sorted((b for b in range(60) if b != a and doc[a] == doc[b] and s[b] >= 0), key=lambda b: (-s[b], b))[:3]
        want |= {(a, n): (doc[a], b, s[b]) for n, b in enumerate(order, 1)}
    assert got == want


@pytest.mark.parametrize("values", [[3], [1, 2], [5, 1, 1, None, 9], list(range(1000)), [7] * 500 + [1, 2], []])
def test_describe(spark, values):
    got = evaluation.describe(spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double"), "x").first()
    own = [v for v in values if v is not None]
    assert got["n"] == len(own)
    assert (got["median"] is None) if not own else got["median"] == np.median(own) and got["mean"] == pytest.approx(np.mean(own)) and got["std"] == pytest.approx(np.std(own))


def test_rate_limit_over_batches(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), k, rng.randrange(4000)) for k in range(3000)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, s int").selectExpr("user_id", "event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {r["id"]: r["accepted"] for r in chat.rate_limited(df, "user_id", "ts", "event_id", 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for user in (1, 2, None):
        own = sorted((s, k) for u, k, s in rows if u == user)
        assert [got[k] for _, k in own] == chat.accepted([s for s, _ in own], 5)


def test_pages_from_words_and_tables(spark):
    box = "page int, x0 double, y0 double, x1 double, y1 double"
    words = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 5.0, "Title"), (1, 0.0, 20.0, 9.0, 25.0, "in"), (1, 0.0, 50.0, 9.0, 55.0, "end"), (2, 0.0, 0.0, 9.0, 5.0, "two")], f"{box}, word string")
    zones = spark.createDataFrame([(1, 0.0, 18.0, 50.0, 40.0, 1)], f"{box}, zone_id long")
    tables = spark.createDataFrame([(1, 0.0, 18.0, 50.0, 39.0, 5, [["a", "b"], ["c", "d"]])], f"{box}, table_id long, rows array<array<string>>")
    got = {r["page"]: r["text"] for r in layout.laid_out(words, zones, tables).collect()}
    assert got == {1: "Title\n\n[ТАБЛИЦА]\n| a | b |\n| --- | --- |\n| c | d |\n[/ТАБЛИЦА]\nend", 2: "two"}
