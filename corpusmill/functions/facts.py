"""Facts in answers, their agreement, and checks of numbers and verdicts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import canonical_number, drop_source_notes

# The answer that stands for none, and the judge's words.
NOT_FOUND = "Информация не найдена"
YES, NO = "ДА", "НЕТ"

# What is a number and what a date.
NUMBER = r"\b\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?\b"
_PLAIN_NUMBER = r"(?U)(\b\d+(?:\.\d+)?\b)"
DAY_FIRST = r"(\b\d{1,2}\.\d{1,2}\.\d{2,4}\b)"
YEAR_FIRST = r"(\b\d{4}-\d{1,2}-\d{1,2}\b)"


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def _day_first(c: Column) -> Column:
    p = F.split(c, r"\.")
    year = F.when(F.length(p[2]) == 2, F.concat(F.lit("20"), p[2])).otherwise(p[2])
    return F.concat_ws(".", _two(p[0]), _two(p[1]), year)


def _year_first(c: Column) -> Column:
    p = F.split(c, "-")
    return F.concat_ws(".", _two(p[2]), _two(p[1]), p[0])


def extract_facts(c: Column) -> Column:
    """The set of a text's numbers (canonical) and dates (dd.mm.yyyy). A date's parts are numbers too. Null has none."""
    c = F.coalesce(c, F.lit(""))
    numbers = F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"(?U)({NUMBER})"), 1), canonical_number), lambda x: x.isNotNull())
    dates = F.concat(F.transform(F.regexp_extract_all(c, F.lit(f"(?U){DAY_FIRST}"), 1), _day_first), F.transform(F.regexp_extract_all(c, F.lit(f"(?U){YEAR_FIRST}"), 1), _year_first))
    return F.array_distinct(F.concat(numbers, dates))


def fact_f1(generated: Column, reference: Column) -> Column:
    """struct(f1, has_ref, has_gen) for two sets: 1 if both are empty, 0 if one is, else the harmonic mean of precision and recall."""
    both = F.size(F.array_intersect(generated, reference))
    n_gen, n_ref = F.size(generated), F.size(reference)
    p, r = both / F.nullif(n_gen, F.lit(0)), both / F.nullif(n_ref, F.lit(0))
    f1 = F.when(n_ref == 0, F.when(n_gen == 0, 1.0).otherwise(0.0)).when((n_gen == 0) | (both == 0), 0.0).otherwise(2 * p * r / (p + r))
    return F.struct(f1.alias("f1"), (n_ref > 0).alias("has_ref"), (n_gen > 0).alias("has_gen"))


def plain_numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(_PLAIN_NUMBER), 1))


def numbers_grounded(answer: Column, chunks: Column) -> Column:
    """Whether each number of the answer occurs in a chunk; an answer without numbers is grounded."""
    there = F.flatten(F.transform(chunks, plain_numbers))
    return F.size(F.array_except(plain_numbers(answer), there)) == 0


def guarded_answer(answer: Column, chunks: Column, fallback: str = NOT_FOUND) -> Column:
    """The answer without source notes; the fallback if it is empty or has numbers that no chunk has."""
    said = drop_source_notes(F.coalesce(answer, F.lit("")))
    return F.when((said == "") | ~numbers_grounded(said, chunks), fallback).otherwise(said)


def verdict(c: Column) -> Column:
    """1 for an answer that starts with yes, 0 with no, null for others (to be asked again)."""
    said = F.upper(F.trim(c))
    return F.when(said.startswith(YES), 1).when(said.startswith(NO), 0)
