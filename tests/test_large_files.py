"""Large CSV files and JSON arrays: cut anywhere, they give what one task reads."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import large_files, readers

CELLS = ["", "a", 'x"y', "q\nr", '"', "a,b", "\n\n", ',"', "é\r\nz", "tail ", '5" pipe', '{"a": "}"}', "\\", '\\"', "[{", "}]"]
CSV = "a string, b string, c string, n long"
JSON = "doc_id string, content string, n struct<x:array<struct<y:string>>>, k long"


@pytest.fixture
def ranges(spark):
    """Sets how many bytes of a file a task reads."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_to(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], min(size, 1000))

    yield set_to
    for n, v in before.items():
        spark.conf.set(n, v)


def cell(rng):
    return rng.choice(CELLS) if rng.random() < 0.9 else "long " * rng.randrange(1, 400)


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def write_csv(path, rows, quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, quoting=quoting, lineterminator="\n")
        out.writerow(["a", "b", "c", "n"])
        out.writerows(rows)


@pytest.mark.parametrize("size", [3_000, 50_000, 10_000_000])
def test_csv(spark, tmp_path, ranges, size):
    rng = random.Random(1)
    rows = [(k, cell(rng), cell(rng), k % 7) for k in range(1500)]
    write_csv(tmp_path / "1.csv", rows)
    write_csv(tmp_path / "2.csv", rows[:300], csv.QUOTE_ALL)
    write_csv(tmp_path / "3.csv", [])
    want = spark.read.schema(CSV).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path)).collect()
    ranges(size)
    found = large_files.csv_records(spark, str(tmp_path), CSV)
    assert sorted(map(key, found.collect())) == sorted(map(key, want))
    assert sorted(map(key, readers.csv_table(spark, str(tmp_path), CSV, ("a", "n")).collect())) == sorted(map(key, want))
    assert size > 3_000 or large_files._pieces(spark, str(tmp_path), large_files.CsvLines()).rdd.getNumPartitions() > 20


def test_csv_cells_over_many_ranges(spark, tmp_path, ranges):
    rows = [(1, "x\n" * 5000, "", 1), (2, 'say "\n"\n' * 3000, "y", 2), (3, "z", "", 3)]
    write_csv(tmp_path / "1.csv", rows)
    ranges(1000)
    assert sorted(tuple(r) for r in large_files.csv_records(spark, str(tmp_path), CSV).collect()) == [(str(a), b, c or None, n) for a, b, c, n in rows]


def test_csv_bad_records_and_open_quotes(spark, tmp_path, ranges):
    (tmp_path / "1.csv").write_text("a,b,c,n\n1,x,y,2\n2,x,y,two\n\n3,x\n4,\"never\nclosed,y,2\n" + "5,x,y,1\n" * 50)
    ranges(60)
    good, bad = readers.csv_and_bad(spark, str(tmp_path), CSV)
    assert [tuple(r) for r in good.collect()] == [("1", "x", "y", 2)]
    told = sorted(r["record"] for r in bad.collect())
    assert told[:2] == ["2,x,y,two", "3,x"] and told[2].startswith('4,"never\nclosed') and told[2].count("5,x,y,1") == 50
    assert readers.csv_table(spark, str(tmp_path), needs=("missing",), strict=False).count() == 0


@pytest.mark.parametrize("size", [3_000, 50_000, 10_000_000])
def test_json(spark, tmp_path, ranges, size):
    rng = random.Random(2)
    rows = [{"doc_id": str(k), "content": cell(rng), "n": {"x": [{"y": "}"}] * (k % 3)}, "k": k} for k in range(1200)]
    for name, indent, some in (("1", None, rows), ("2", 2, rows), ("3", None, []), ("4", None, [{"doc_id": "long", "content": "} {" * 9000}])):
        with open(tmp_path / f"{name}.json", "w", encoding="utf-8") as f:
            json.dump(some, f, indent=indent, ensure_ascii=name == "1")
    want = spark.read.schema(JSON).json(str(tmp_path), multiLine=True).collect()
    ranges(size)
    assert sorted(map(str, large_files.json_records(spark, str(tmp_path), JSON, "_bad").drop("_bad").collect())) == sorted(map(str, want))
    assert readers.json_array(spark, str(tmp_path), JSON, ("doc_id",)).count() == len(want) == 2401


def test_json_bad_records(spark, tmp_path, ranges):
    (tmp_path / "1.json").write_text('[{"doc_id":"z", "content": "c"},{"doc_id" "q"},\n {"k": "no number", "doc_id": "w"}, 5]')
    (tmp_path / "2.json").write_text('[{"doc_id":"y", "content": "c"}, {"doc_id": "cut off')
    (tmp_path / "3.json").write_text(" ")
    ranges(20)
    good, bad = readers.json_array_and_bad(spark, str(tmp_path), JSON)
    assert sorted(r["doc_id"] for r in good.collect()) == ["y", "z"]
    assert sorted(r["record"].strip(", ") for r in bad.collect()) == ["5]", '{"doc_id" "q"}', '{"doc_id": "cut off', '{"k": "no number", "doc_id": "w"}']
    with pytest.raises(Exception, match="a record lacks"):
        readers.json_array(spark, str(tmp_path), JSON).count()


def test_largest_file(spark, tmp_path):
    (tmp_path / "1.csv").write_text("x" * 100)
    (tmp_path / "2.csv").write_text("x" * 300)
    assert large_files.largest_file(spark, str(tmp_path)) == 300
    assert spark.read.text(str(tmp_path)).where(F.length("value") > 200).count() == 1


def test_batches_of_long_texts_are_taken_in_portions(spark):
    """Python objects are made of a bounded number of bytes at once, however many a batch has."""
    import pyarrow as pa

    from corpusmill.operators import chunking

    texts = ["x" * 400_000 + "}" for _ in range(40)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
    made = list(chunking._chunk_batches(iter([docs]), lambda t: [t]))
    assert [x for b in made for x in b.column("doc_id").to_pylist()] == list(range(40)) and max(b.nbytes for b in made) < 2_500_000
    from corpusmill.sources import large_files

    pieces = pa.RecordBatch.from_arrays([pa.array(["f"] * 40), pa.array([0] * 40), pa.array(texts)], names=["file", "start", "value"])
    parts = [held for _, _, held in large_files._ranges(iter([pieces]))]
    assert [t for held in parts for t in held] == texts and max(sum(map(len, held)) for held in parts) <= 2_000_000
