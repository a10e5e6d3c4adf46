"""Table functions for SQL: chunks, segments and facts of a text as rows, to be joined LATERAL.

``register`` enters them in a session by name::

    SELECT doc_id, c.* FROM documents, LATERAL text_chunks(text, 700, 150) AS c

Each tells its columns, and checks its constant arguments, before the query runs. They give what the
DataFrame operators give; a null text is an empty one and has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StringType, StructType

from corpusmill.functions.facts import DAY_FIRST, NUMBER, YEAR_FIRST
from corpusmill.functions.text import PAGE_MARK
from corpusmill.operators.chunking import Splitter, section_chunk_texts

_KINDS = {"string": StringType(), "long": LongType()}


def _schema(**columns: str) -> StructType:
    out = StructType()
    for name, kind in columns.items():
        out = out.add(name, _KINDS[kind])
    return out


def _text(arg: AnalyzeArgument, name: str) -> None:
    if not isinstance(arg.dataType, StringType):
        raise ValueError(f"{name} takes a string, not {arg.dataType.simpleString()}")


def _constant(arg: AnalyzeArgument | None, name: str, default: int, least: int) -> int:
    if arg is None:
        return default
    if not arg.isConstantExpression or not isinstance(arg.value, int) or arg.value < least:
        raise ValueError(f"{name} must be a whole number, {least} or more, and the same for all rows")
    return arg.value


@dataclass
class Sized(AnalyzeResult):
    """The columns, and the constant arguments as analyze() found them."""

    size: int = field(default=0)
    overlap: int = field(default=0)


def _splitting(text: AnalyzeArgument, size: AnalyzeArgument | None, overlap: AnalyzeArgument | None, name: str, defaults: Splitter, **columns: str) -> Sized:
    _text(text, name)
    found = _constant(size, "size", defaults.size, 1), _constant(overlap, "overlap", defaults.overlap, 0)
    if found[1] >= found[0]:
        raise ValueError("overlap must be less than size")
    return Sized(_schema(**columns), size=found[0], overlap=found[1])


@udtf
class TextChunks:
    """text_chunks(text [, size [, overlap]]): chunk_id, chunk, as operators.chunking.recursive_chunks."""

    def __init__(self, found: Sized):
        self.splitter = Splitter(found.size, found.overlap)

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> Sized:
        return _splitting(text, size, overlap, "text_chunks", Splitter(700, 150), chunk_id="long", chunk="string")

    def eval(self, text: str, *_: int) -> Iterator[tuple]:
        yield from enumerate(self.splitter.split(text or ""))


@udtf
class SectionChunks:
    """section_chunks(text [, size [, overlap]]): chunk_id, chunk_name, chunk, as operators.chunking.section_chunks."""

    def __init__(self, found: Sized):
        self.splitter = Splitter(found.size, found.overlap)

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> Sized:
        return _splitting(text, size, overlap, "section_chunks", Splitter(), chunk_id="long", chunk_name="string", chunk="string")

    def eval(self, text: str, *_: int) -> Iterator[tuple]:
        for k, chunk in enumerate(section_chunk_texts(text or "", self.splitter)):
            yield k, f"chunk_{k:04d}", chunk


@udtf
class TextSegments:
    """text_segments(text [, budget]): segment, segment_text, page_range, token_estimate, as operators.segments.segments."""

    def __init__(self, found: Sized):
        self.budget = found.size

    @staticmethod
    def analyze(text: AnalyzeArgument, budget: AnalyzeArgument | None = None) -> Sized:
        _text(text, "text_segments")
        return Sized(_schema(segment="long", segment_text="string", page_range="string", token_estimate="long"), size=_constant(budget, "budget", 12000, 0))

    def eval(self, text: str, *_: int) -> Iterator[tuple]:
        pages = [p for p in (x.strip() for x in re.split(f"{re.escape(PAGE_MARK)}|\x00", text or "")) if p]
        segment = first = tokens = 0
        for k, n in enumerate([len(p) // 4 for p in pages] + [None]):
            if k > first and (n is None or tokens + n > self.budget):
                yield segment, "\n\n".join(pages[first:k]), f"{first + 1}-{k}", tokens
                segment, first, tokens = segment + 1, k, 0
            tokens += n or 0


@udtf
class TextFacts:
    """text_facts(text): fact, each number and date of a text once, as functions.facts.extract_facts."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text, "text_facts")
        return AnalyzeResult(_schema(fact="string"))

    def eval(self, text: str) -> Iterator[tuple]:
        text = text or ""
        found = dict.fromkeys(_shown(float(x.replace(",", "."))) for x in re.findall(NUMBER, text))
        for d, m, y in (x.split(".") for x in re.findall(DAY_FIRST, text)):
            found[f"{d:0>2}.{m:0>2}.{'20' + y if len(y) == 2 else y}"] = None
        for y, m, d in (x.split("-") for x in re.findall(YEAR_FIRST, text)):
            found[f"{d:0>2}.{m:0>2}.{y}"] = None
        for fact in found:
            yield (fact,)


def _shown(x: float) -> str:
    """Whole values in full, others in their shortest form."""
    return str(int(x)) if x.is_integer() else repr(x)


NAMES = {"text_chunks": TextChunks, "section_chunks": SectionChunks, "text_segments": TextSegments, "text_facts": TextFacts}


def register(spark: SparkSession) -> None:
    """Enters the table functions in the session."""
    for name, f in NAMES.items():
        spark.udtf.register(name, f)
