import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import documents, html, readers, sinks


def docx(body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def test_docx(spark):
    cell = lambda t: f"<w:tc>{P.format(t)}</w:tc>"
    content = docx(P.format("один") + P.format(" ") + f"<w:tbl><w:tr>{cell('a|b')}{cell('c')}</w:tr><w:tr>{cell('d')}</w:tr></w:tbl>" + P.format("два"))
    assert documents.docx_text(content) == "один\n[ТАБЛИЦА]\n| a b | c |\n| --- | --- |\n| d |  |\n[/ТАБЛИЦА]\nдва"
    rows = [("a.docx", content), ("b.docx", b"no"), ("c.pdf", b"\x00%PDF-1"), ("d.pdf", b"x"), ("e.txt", b"x"), ("f.docx", docx(""))]
    df = spark.createDataFrame(rows, "file_name string, content binary")
    assert {r["file_name"]: r["status"] for r in documents.checked_uploads(df).collect()} == {"a.docx": 200, "b.docx": 422, "c.pdf": 200, "d.pdf": 422, "e.txt": 400, "f.docx": 200}
    got = {r["file_name"]: r["status"] for r in documents.extracted(df, lambda b: ["one", "two"]).collect()}
    assert got["a.docx"] == got["c.pdf"] == "OK" and got["b.docx"] == "ERROR BadZipFile" and got["f.docx"] == "WARN no text"
    assert documents.extracted(df).where("file_name = 'c.pdf'").first()["status"] == "ERROR no PDF reader"


def test_text_and_binary(spark, tmp_path):
    (tmp_path / "a.txt").write_text("один\nдва", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    assert [tuple(r) for r in readers.text_files(spark, str(tmp_path)).collect()] == [("a.txt", "один\nдва")]
    assert [(r["file_name"], r["length"]) for r in readers.binary_files(spark, str(tmp_path)).collect()] == [("b.pdf", 4)]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"doc_id": "1", "content": "x"}, {"doc_id": "2"}]')
    (tmp_path / "b.json").write_text('[{"doc_id": "1", "content": "x"}]')
    with pytest.raises(Exception, match="a record lacks doc_id or content"):
        readers.json_array(spark, f"{tmp_path}/a.json").select("doc_id").collect()
    good, bad = readers.json_array_and_bad(spark, f"{tmp_path}/a.json")
    assert [r["doc_id"] for r in good.collect()] == ["1"] and [r["record"] for r in bad.collect()] == ['{"doc_id":"2"}']
    assert readers.json_array(spark, f"{tmp_path}/b.json").count() == 1
    (tmp_path / "c.jsonl").write_text('{"doc_id": "1", "question": "q"}\n\nbad\n{"doc_id": "0"}\n')
    assert sorted(r["doc_id"] for r in readers.json_lines(spark, f"{tmp_path}/c.jsonl", readers.QA, strict=False).collect()) == ["0", "1"]
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        readers.json_lines(spark, f"{tmp_path}/c.jsonl", readers.QA).collect()
    assert [r["doc_id"] for r in readers.json_lines(spark, f"{tmp_path}/c.jsonl", readers.QA, False, 1).collect()] == ["0"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", "q\nx", 'say "a"', "train"), ("e", "r", None, "val")], "doc_id string, question string, generated string, split string")
    sinks.csv_rows(df, f"{tmp_path}/csv")
    back = readers.csv_table(spark, f"{tmp_path}/csv")
    assert sorted(r["question"] for r in back.collect()) == ["q\nx", "r"] and back.where("doc_id = 'd'").first()["generated"] == 'say "a"'
    with pytest.raises(readers.SchemaError):
        readers.csv_table(spark, f"{tmp_path}/csv", needs=("missing",))
    sinks.splits(df, f"{tmp_path}/splits")
    assert spark.read.json(f"{tmp_path}/splits").where("split = 'val'").count() == 1
    sinks.json_rows(df, f"{tmp_path}/j")
    sinks.json_rows(df, f"{tmp_path}/j", append=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    sinks.report(df.agg(F.count("*").alias("n")), f"{tmp_path}/r")
    sinks.text(df, f"{tmp_path}/t", "doc_id")
    assert spark.read.text(f"{tmp_path}/t").count() == 2
    chunks = spark.createDataFrame([(1, "x", [0.5])], "chunk_id int, text string, embedding array<float>")
    sinks.collection(chunks, f"{tmp_path}/v", "a")
    sinks.collection(chunks, f"{tmp_path}/v", "b")
    assert readers.collection(spark, f"{tmp_path}/v", "a").count() == 1
    with pytest.raises(ValueError, match="no collection"):
        readers.collection(spark, f"{tmp_path}/v", "c")
    assert readers.complete_rows(df, ("generated",)).count() == 1


def test_listing(spark):
    row = '<tr><td><a class="contest-link" href="/x">x</a><a class="contest-link b" href="/docs/{}.pdf">y</a></td></tr>'
    page = f'<div id="comp_1"><table>{row.format(1)}<tr><a class="contest-link" href="/z"></a></tr>{row.format(2)}</table></div><div id="other"><table>{row.format(3)}</table></div>'
    df = spark.createDataFrame([(1, "https://h.org/l/", page), (2, None, None)], "page_id long, url string, html string")
    assert [tuple(r) for r in html.listing(df).collect()] == [(1, "https://h.org/docs/1.pdf", "1.pdf"), (1, "https://h.org/docs/2.pdf", "2.pdf")]


def test_converted(spark):
    def pages(content):
        if not content:
            raise ValueError("damaged")
        return content.decode().split("\f")

    df = spark.createDataFrame([("a.b.pdf", "один  два\f \fтри".encode()), ("c.pdf", b" "), ("d.pdf", None)], "file_name string, content binary")
    got = {r["file_name"]: (r["text_name"], r["text"], r["pages"], r["status"]) for r in documents.converted(df, pages).collect()}
    assert got == {
        "a.b.pdf": ("a.b.txt", "=== Страница 1 ===\nодин два\n\n=== Страница 3 ===\nтри", 2, "УСПЕХ: a.b.pdf -> a.b.txt (2)"),
        "c.pdf": ("c.txt", None, 0, "ВНИМАНИЕ: c.pdf"), "d.pdf": ("d.txt", None, 0, "ОШИБКА: d.pdf - ValueError damaged"),
    }


def test_bad_lines_are_kept(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": "1", "question": "q"}\n\nbad\n{"doc_id": "0"}\n{"doc_id": \n')
    good, bad = readers.json_lines_and_bad(spark, f"{tmp_path}/c.jsonl", readers.QA)
    assert sorted(r["doc_id"] for r in good.collect()) == ["0", "1"] and sorted(r["line"] for r in bad.collect()) == ["bad", '{"doc_id": ']


def test_arrays_and_missing_columns(spark, tmp_path):
    df = spark.createDataFrame([(str(k), "x" if k % 2 else 'say "é"\n') for k in range(7)], "doc_id string, content string").repartition(3)
    sinks.json_array(df, f"{tmp_path}/a")
    assert sorted(tuple(r) for r in readers.json_array(spark, f"{tmp_path}/a").select("doc_id", "content").collect()) == sorted(tuple(r) for r in df.collect())
    sinks.csv_rows(df, f"{tmp_path}/c")
    assert readers.csv_table(spark, f"{tmp_path}/c", strict=False).collect() == [] and readers.csv_table(spark, f"{tmp_path}/c", needs=("doc_id",), strict=False).count() == 7
