"""Tables found on made pages, and laid out among their lines."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import corpus, layout, tables
from corpusmill.sources import readers, sinks

WORDS = "page long, x0 double, y0 double, x1 double, y1 double, word string"


def put(page, x, y, text):
    """Words of a text from a place on, six units a letter, ten high."""
    out = []
    for word in text.split(" "):
        out.append((page, float(x), float(y), x + 6.0 * len(word), y + 10.0, word))
        x += 6 * len(word) + 4
    return out


def made_page(page, rng, rows, columns, top):
    """A paragraph, a table with some empty cells and uneven starts, a paragraph."""
    words = [w for k in range(3) for w in put(page, 40, 20 + 14 * k, "some words of plain text go on and on")]
    table = [[rng.choice(["one", "two words", "3,5", "x"]) if c < 2 or rng.random() < 0.8 else "" for c in range(columns)] for _ in range(rows)]
    for r, row in enumerate(table):
        for c, cell in enumerate(row):
            if cell:
                words += put(page, 40 + 110 * c + rng.choice([0, 1, 2]), top + 16 * r + rng.choice([0, 0.5]), cell)
    below = top + 16 * rows + 40
    words += [w for k in range(2) for w in put(page, 40, below + 14 * k, "more plain text below the table")]
    return words, table


def test_tables_are_found(spark):
    rng = random.Random(1)
    pages = {p: made_page(p, rng, rows, columns, 100) for p, (rows, columns) in enumerate([(4, 3), (2, 2), (9, 4), (3, 3)])}
    plain = [w for k in range(6) for w in put(9, 40, 20 + 14 * k, "a page without any table at all")]
    two = put(8, 40, 20, "left") + put(8, 300, 20, "right")  # one line of two cells is no table
    odd = [(None, 0.0, 0.0, 1.0, 1.0, "x"), (7, None, 0.0, 1.0, 1.0, "x")]
    df = spark.createDataFrame([w for words, _ in pages.values() for w in words] + plain + two + odd, WORDS).withColumns({"run": F.lit(1), "line": F.lit(1)}).repartition(3)
    found = {r["page"]: r for r in tables.found_tables(df).collect()}
    assert set(found) == set(pages)
    for p, (_, table) in pages.items():
        assert found[p]["rows"] == table and found[p]["zone_id"] == 1 and (found[p]["x0"], found[p]["y0"]) <= (42, 100.5)
    assert tables.found_tables(df.limit(0)).count() == 0


def test_found_tables_are_laid_out(spark):
    rng = random.Random(2)
    words, table = made_page(5, rng, 3, 2, 100)
    df = spark.createDataFrame(words, WORDS).repartition(2)
    zones = tables.found_tables(df)
    text = layout.laid_out(df, zones, zones).first()["text"].split("\n")
    assert text[:3] == ["some words of plain text go on and on"] * 3 and text[-1] == "more plain text below the table"
    assert text[4] == "[ТАБЛИЦА]" and text[5] == "| " + " | ".join(table[0]) + " |" and text[-3] == "[/ТАБЛИЦА]"


def test_clashing_columns_of_repeated_lines(spark):
    pages = spark.createDataFrame([(1, k, f"12\nbody {k}") for k in range(8)], "doc_id long, page int, text string").withColumns({"gone": F.lit("g"), "doc": F.lit("d"), "line": F.lit("l")})
    out = corpus.without_repeated_lines(pages, "doc_id", "page").orderBy("page").collect()
    assert [r["text"] for r in out] == [f"body {k}" for k in range(8)] and out[0]["gone"] == "g" and out[0]["doc"] == "d"


def test_collections_written_again(spark, tmp_path):
    chunks = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "chunk_id long, embedding array<double>")
    for name in ("a", "b", "a"):
        sinks.collection(chunks, f"{tmp_path}/v", name)
    assert readers.collection(spark, f"{tmp_path}/v", "a").count() == 2 == readers.collection(spark, f"{tmp_path}/v", "b").count()
    sinks.collection(chunks, f"{tmp_path}/v", "a", append=True)
    assert readers.collection(spark, f"{tmp_path}/v", "a").count() == 4


def test_lines_are_made_in_batches_of_words(spark):
    """The same lines however words come in batches; a page's first word begins a line though the page before ends nearby."""
    from corpusmill.operators import layout

    words = [(page, float(10 * line + k % 3), float(40 * ((k * 7) % 5)), float(40 * ((k * 7) % 5) + 10), f"w{k}") for page in ("a", "b", None) for line in range(4) for k in range(5)]
    df = spark.createDataFrame(words, "page string, y0 double, x0 double, x1 double, word string")
    want = {(page, 10.0 * line): " ".join(f"w{k}" for k in sorted(range(5), key=lambda k: (k * 7) % 5)) for page in ("a", "b", None) for line in range(4)}
    for rows in ("1", "3", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            assert {(r["page"], r["y"]): r["text"] for r in layout.text_lines(df).collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in layout.text_lines(df)._jdf.queryExecution().optimizedPlan().toString()


def test_markdown_is_made_of_taken_tables_alone(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corpusmill.operators import layout

    rows = [("p", 0.0, 0.0, 10.0, 10.0, "z", 1), ("p", 0.0, 0.0, 10.0, 9.0, "t", 1), ("p", 50.0, 50.0, 60.0, 60.0, "u", 2)]
    boxes = spark.createDataFrame(rows, "page string, x0 double, y0 double, x1 double, y1 double, word string, id long")
    tables = boxes.where("word <> 'z'").withColumnRenamed("id", "table_id").withColumn("rows", F.array(F.array("word")))
    monkeypatch.setattr(layout, "markdown_table", lambda r: F.when(r[0][0] == "u", F.raise_error("a table that no zone took").cast("string")).otherwise(r[0][0]))
    got = layout.laid_out(boxes, boxes.where("word = 'z'").withColumnRenamed("id", "zone_id"), tables).collect()
    assert [r["text"] for r in got] == ["\n[ТАБЛИЦА]\nt\n[/ТАБЛИЦА]\nu"]


def test_pages_stay_whole_when_a_join_becomes_a_broadcast(spark):
    """The join of words and zones deals by page; where adaptive execution makes it a broadcast, its exchange is read another way."""
    from corpusmill.operators import layout

    words = spark.range(0, 8000, 1, 6).selectExpr("id % 500 as page", "double(id * 7 % 31 * 20) as x0", "double(id * 11 % 17 * 2) as y0", "double(id * 7 % 31 * 20 + 15) as x1", "double(id * 11 % 17 * 2 + 9) as y1", "string(id) as word")
    zones = words.where("page < 5").withColumn("zone_id", F.col("word").cast("long"))
    tables = zones.withColumnRenamed("zone_id", "table_id").withColumn("rows", F.array(F.array(F.lit("a")), F.array("word")))
    text = lambda: {r["page"]: r["text"] for r in layout.laid_out(words, zones, tables).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        want = text()
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert text() == want and len(want) == 500
    finally:
        for key in ("autoBroadcastJoinThreshold", "adaptive.enabled", "adaptive.autoBroadcastJoinThreshold", "adaptive.coalescePartitions.enabled"):
            spark.conf.unset(f"spark.sql.{key}")
