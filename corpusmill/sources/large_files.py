"""CSV files and JSON arrays that many tasks read, although their records span lines.

Spark's text source cuts a large file into ranges of bytes and gives each range whole pieces: lines of
a CSV file, or what ends in a closing brace of a JSON array. Whether a range begins inside a quoted cell
or a string, and how deep in brackets, depends on all that came before it. So three passes are made:

1. each range is scanned for both cases, beginning inside quotes and outside, which gives two possible
   ends; folding these over a file's ranges, in their order, settles with which each one begins;
2. what ranges hold of records that reach beyond them is gathered, ordered and put together;
3. all other records are found where they are, in a scan of each range from its settled beginning.

Files that are not cut need the third pass only. Rows never leave their tasks, but for the ends of the
ranges; the driver sees a few numbers for each range of a cut file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.batches import portions

#: What follows an opening quote, up to the closing one.
_QUOTED = re.compile(r'(?:[^"]++|"")*+"')
#: What no JSON string has outside of it: whole strings, and one that is still open at the end.
_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)


@dataclass(frozen=True)
class CsvLines:
    """Lines of comma-separated cells; a quoted cell may hold commas, line ends and doubled quotes."""

    piece_end: str = "\n"
    closes: bool = False

    def scan(self, line: str, inside: bool) -> tuple[bool, int]:
        """Whether the line ends inside a quoted cell; depth is none."""
        if '"' not in line:
            return inside, 0
        at = 0
        while True:
            if inside or line.startswith('"', at):
                found = _QUOTED.match(line, at if inside else at + 1)
                if not found:
                    return True, 0
                at, inside = found.end(), False
            at = line.find(',"', at) + 1
            if not at:
                return False, 0

    def ends_record(self, inside: bool, depth: int) -> bool:
        return not inside


@dataclass(frozen=True)
class JsonPieces:
    """What lies between closing braces; a piece that ends at depth one, that of the array, ends a record."""

    piece_end: str = "}"
    closes: bool = True

    def scan(self, piece: str, inside: bool) -> tuple[bool, int]:
        """Whether the piece ends inside a string, and by how much its brackets, with the brace it ends in, change the depth."""
        if inside:
            found = _REST_OF_STRING.match(piece)
            if not found:
                return True, 0
            piece = piece[found.end() :]
        bare = _STRING.sub("", piece)
        open_at = bare.find('"')
        if open_at >= 0:
            bare = bare[:open_at]
        depth = bare.count("{") + bare.count("[") - bare.count("]")
        return open_at >= 0, depth - (open_at < 0)

    def ends_record(self, inside: bool, depth: int) -> bool:
        return not inside and depth == 1


Kind = CsvLines | JsonPieces


def _pieces(spark: SparkSession, path: str, kind: Kind) -> DataFrame:
    found = spark.read.option("lineSep", kind.piece_end).text(path)
    return found.select(*[F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_block_start", "file_block_length")], "value")


def _ranges(batches):
    """(file, start, pieces) for consecutive rows of one range of bytes; a long range comes in several parts."""
    for batch in portions(batches, 2):
        files, starts, texts = (batch.column(k).to_pylist() for k in range(3))
        at = 0
        while at < len(texts):
            to = at
            while to < len(texts) and starts[to] == starts[at] and files[to] == files[at]:
                to += 1
            yield files[at], starts[at], texts[at:to]
            at = to


def _ends(batches, kind: Kind):
    """file, start, and for a beginning outside and inside quotes whether the range ends inside, and the change of depth."""
    key, states = None, []

    def told():
        return pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "out_inside": states[0][0], "out_depth": states[0][1], "in_inside": states[1][0], "in_depth": states[1][1]}])

    for file, start, pieces in _ranges(batches):
        if (file, start) != key:
            if key:
                yield told()
            key, states = (file, start), [(False, 0), (True, 0)]
        for piece in pieces:
            if states[0][0] == states[1][0]:  # the two cases have met
                inside, more = kind.scan(piece, states[0][0])
                states = [(inside, depth + more) for _, depth in states]
            else:
                states = [(now[0], depth + now[1]) for (inside, depth) in states for now in (kind.scan(piece, inside),)]
    if key:
        yield told()


def _beginnings(pieces: DataFrame, kind: Kind) -> dict[tuple[str, int], tuple[bool, int]]:
    """How each range of a cut file begins: inside quotes or not, and at which depth. A row a range reaches the driver."""
    cut = pieces.where("file_block_length < file_size").select("file_path", "file_block_start", "value")
    rows = cut.mapInArrow(partial(_ends, kind=kind), "file string, start long, out_inside boolean, out_depth long, in_inside boolean, in_depth long").collect()
    found, file = {}, None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        found[r["file"], r["start"]] = inside, depth
        inside, depth = (r["in_inside"], depth + r["in_depth"]) if inside else (r["out_inside"], depth + r["out_depth"])
    return found


RECORD = "file string, start long, part int, ends boolean, head boolean, value string"


def _records(batches, kind: Kind, begun, ends_only: bool):
    """Rows of RECORD. part 0: a whole record; 1: what a range begins with of a record begun before; 2: the open end of a range.

    head: the first record of a file. ends_only: parts 1 and 2 alone, else part 0 alone.
    """
    key, held, out = None, [], []

    def emit(part, ends):
        value = kind.piece_end.join(held) + (kind.piece_end if ends and kind.closes else "")
        if (part > 0) == ends_only:
            out.append((*key, part, ends, first, value))
        held.clear()

    def passed():
        columns = list(zip(*out))
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()))], names=["file", "start", "part", "ends", "head", "value"])
        out.clear()
        return batch

    for file, start, pieces in _ranges(batches):
        if (file, start) != key:
            if key and held:
                emit(1 if leading else 2, False)
            key = file, start
            inside, depth = begun.value[key] if start else (False, 0)
            first, leading = start == 0, start > 0 and (inside or kind.closes)
        for piece in pieces:
            inside, more = kind.scan(piece, inside)
            depth += more
            held.append(piece)
            if kind.ends_record(inside, depth):
                emit(1 if leading else 0, True)
                leading = first = False
        if sum(map(len, (r[5] for r in out))) > 4_000_000 or len(out) > 20_000:
            yield passed()
    if key and held:
        emit(1 if leading else 2, False)
    if out:
        yield passed()


def records(spark: SparkSession, path: str, kind: Kind) -> DataFrame:
    """value (a record's text), head (it is its file's first), whole (false for what remains open at a file's end), of all files."""
    pieces = _pieces(spark, path, kind)
    # all passes read one table, for how Spark cuts a file depends on all that is read with it
    begun = spark.sparkContext.broadcast(_beginnings(pieces, kind))
    three = pieces.select("file_path", "file_block_start", "value")
    inner = three.mapInArrow(partial(_records, kind=kind, begun=begun, ends_only=False), RECORD)
    parts = three.mapInArrow(partial(_records, kind=kind, begun=begun, ends_only=True), RECORD)
    # a record's parts lie between two ends; a range has two parts at most
    before = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    chains = parts.withColumn("chain", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part", "value"))), lambda x: x["value"]), kind.piece_end)
    over = chains.groupBy("file", "chain").agg(joined.alias("value"), F.max("head").alias("head"), F.max("ends").alias("whole"))
    return inner.select("value", "head", F.lit(True).alias("whole")).unionByName(over.select("value", "head", "whole"))


def csv_records(spark: SparkSession, path: str, schema: str, corrupt: str | None = None) -> DataFrame:
    """Rows of CSV files with a header each, quotes doubled in quoted cells; cells go to columns by their order.

    With ``corrupt``, a column of that name holds the text of records that don't fit the schema; else
    what doesn't fit is null. A cell whose quotes never close reaches to the end of its file.
    """
    found = records(spark, path, CsvLines()).where(~F.col("head") & (F.trim(F.regexp_replace("value", r"[\r\n]+", "")) != ""))
    options = {"escape": '"', "mode": "PERMISSIVE"} | ({"columnNameOfCorruptRecord": corrupt} if corrupt else {})
    whole = f"{schema}, `{corrupt}` string" if corrupt else schema
    return found.select(F.from_csv(F.regexp_replace("value", r"\r\z", ""), whole, options).alias("r")).select("r.*")


def json_records(spark: SparkSession, path: str, schema: str, corrupt: str) -> DataFrame:
    """Rows of files that are each an array of JSON objects; the column ``corrupt`` holds the text of what can't be read as one."""
    found = records(spark, path, JsonPieces())
    text = F.when(F.col("whole"), F.regexp_replace("value", r"\A\s*+[\[,]?\s*+", "")).otherwise(F.col("value"))
    rows = found.select(text.alias("value"), "whole").where(F.col("whole") | ~F.col("value").rlike(r"\A\s*(\[\s*)?\]?\s*\z"))
    return rows.select(F.from_json("value", f"{schema}, `{corrupt}` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r")).select("r.*")


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file; only the listing is read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
