"""Text cleaning, profiling and classification as Column expressions.

All run inside the JVM. Patterns use ``(?U)`` where words and white space are meant in the Unicode
sense.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of the extracted-text format.
PAGE_MARK = "=== Страница"
PAGE_BREAK = "[PAGE_BREAK]"
TABLE_OPEN, TABLE_CLOSE = "[ТАБЛИЦА]", "[/ТАБЛИЦА]"
SECTION_PREFIX = "Раздел: "
CUT_MARK = "\n...\n"

# Document types by words in the head of a text, the first that fits: (word, characters looked at, type).
TYPE_RULES = (
    ("конкурс", 1000, "конкурсная_документация"),
    ("заявк", 1000, "форма_заявки"),
    ("титульн", 500, "титульный_лист"),
)
OTHER_TYPE = "прочий_документ"

# Patterns and words by which a line is a heading.
HEADING_PATTERNS = (r"\d+(\.\d+)+\.?", r"\d+\.\s", r"\d+\.[А-ЯЁа-яё]", r"[а-яё]{3,}\s?\d+\.")
HEADING_KEYWORDS = (
    "раздел", "требования", "условия", "порядок", "критерии", "сроки", "финансирование", "заявитель", "участник", "конкурс",
    "грант", "подача", "заявка", "заявки", "заявку", "заявок", "индикатор", "результатив", "бюджет", "софинанс",
)

#: What Python's str.strip() and \s take for white space: the characters, and the inside of a pattern's class without the line feed.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_INLINE = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def split_lines(c: Column) -> Column:
    """The lines of a text; an empty text has none and a final line end starts none."""
    body = F.regexp_replace(c, r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"))


def clean_extracted(c: Column) -> Column:
    """Cleaning of offline extracts: white space to one blank, hyphenated words joined, control characters dropped, ends stripped.

    White space goes first, so no line ends are left. Null stays null.
    """
    c = F.regexp_replace(c, rf"[\n{_INLINE}]+", " ")
    c = F.when(c.contains("- "), F.regexp_replace(c, r"(?U)(?<!\w)(\w++)- +(\w++)", "$1$2")).otherwise(c)
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return py_strip(c)


def clean_lines(c: Column) -> Column:
    """Cleaning that keeps lines: control characters dropped, lines stripped, and no rulers, bare punctuation or blank lines."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    lines = F.transform(split_lines(c), py_strip)
    lines = F.filter(lines, lambda x: ~(x.startswith("===") & x.endswith("===")) & ~x.rlike(rf"\A[\n{_INLINE}.,;:!?…\-–—]*\z"))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, f"[{_INLINE}]+", " ")), "\n")


def marked_pages(pages: Column) -> Column:
    """The text of an array of pages: each under a line with its number, cleaned; blank pages are left out but counted."""
    numbered = F.transform(pages, lambda p, i: F.when(py_strip(p) != "", F.concat(F.lit(f"{PAGE_MARK} "), (i + 1).cast("string"), F.lit(" ===\n"), clean_extracted(p))))
    return F.array_join(F.filter(numbered, lambda p: p.isNotNull()), "\n\n")


def strip_angle_brackets(c: Column) -> Column:
    return F.translate(c, "<>", "")


def drop_source_notes(c: Column) -> Column:
    """Without ``(Источник ...)`` notes, stripped."""
    return py_strip(F.regexp_replace(c, r"(?iu)(?U)\s*\(Источник[^)]*\)", ""))


def clean_response(c: Column) -> Column:
    """A model's answer without its thinking; null becomes empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", "")
    return py_strip(F.regexp_replace(c, r"</?think>", ""))


def strip_code_fence(c: Column) -> Column:
    """Without an opening fence and the last three characters, which are taken to be the closing one."""
    c = py_strip(c)
    inner = lambda n: py_strip(F.substring(c, n + 1, F.greatest(F.length(c) - n - 3, F.lit(0))))
    return F.when(c.startswith("```json"), inner(7)).when(c.startswith("```"), inner(3)).otherwise(c)


def html_escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def page_count(c: Column) -> Column:
    """Page marks in a text, one at least."""
    found = (F.length(c) - F.length(F.replace(c, F.lit(PAGE_MARK), F.lit("")))) / len(PAGE_MARK)
    return F.greatest(F.lit(1), found.cast("int"))


def language_vote(c: Column, scripts: tuple[tuple[str, str], ...] = (("rus", "[а-яА-Я]"), ("eng", "[a-zA-Z]"))) -> Column:
    """The label whose character class occurs most; of equal ones the last, so a tie of the defaults is eng."""
    counts = [F.struct(F.regexp_count(c, F.lit(pattern)).alias("n"), F.lit(k).alias("k"), F.lit(label).alias("label")) for k, (label, pattern) in enumerate(scripts)]
    return F.when(c.isNotNull(), F.array_max(F.array(*counts))["label"])


def size_bucket(n: Column, small: int = 5000, medium: int = 30000) -> Column:
    return F.when(n < small, "small").when(n < medium, "medium").otherwise("large")


def document_type(c: Column, rules: tuple = TYPE_RULES, other: str = OTHER_TYPE) -> Column:
    out = F.lit(other)
    for word, head, kind in reversed(rules):
        out = F.when(F.lower(F.substring(c, 1, head)).contains(word), kind).otherwise(out)
    return out


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def head_middle_tail(c: Column, limit: int = 100_000, mark: str = CUT_MARK) -> Column:
    """Texts over ``limit`` characters become their first, middle and last third, with marks between."""
    third, half = limit // 3, limit // 6
    n = F.length(c)
    middle = F.floor(n / 2).cast("int")
    cut = F.concat(F.substring(c, 1, third), F.lit(mark), F.substring(c, middle - half + 1, F.lit(2 * half)), F.lit(mark), F.substring(c, n - third + 1, F.lit(third)))
    return F.when(n > limit, cut).otherwise(c)


def preview(c: Column, n: int, more: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(more))).otherwise(c)


def slices(c: Column, n: int) -> Column:
    """The text in consecutive pieces of n characters; an empty text has none."""
    starts = F.sequence(F.lit(1), F.length(c), F.lit(n))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def heading_rule(end: str) -> str:
    """The pattern that the start of a stripped line meets if it is a heading; ``end`` is the dialect's mark for the end of a text.

    All headings have at most 120 characters. They are numbered, or open with a keyword that stands
    alone or before a colon, point or digit; those don't end in a point and have a colon if over 80 characters.
    """
    keyword = rf"(?:{'|'.join(HEADING_KEYWORDS)})\s*(?:{end}|[:.\d])"
    return rf"(?=.{{1,120}}{end})(?:{'|'.join(HEADING_PATTERNS)}|(?!.*\.{end})(?=.{{1,80}}{end}|[^:]*:){keyword})"


def is_heading(line: Column) -> Column:
    """Whether a line is a heading, by heading_rule()."""
    return F.coalesce(py_strip(line).rlike(r"(?isU)\A(?:" + heading_rule(r"\z") + ")"), F.lit(False))


def is_useful_chunk(c: Column, least: int = 15) -> Column:
    """Chunks worth keeping: tables, long or numeric ones, ones under a heading, ones with a word of five letters."""
    return c.contains(TABLE_OPEN) | (F.length(c) >= least) | c.rlike(r"(?U)\d") | c.startswith(SECTION_PREFIX.strip()) | c.rlike("(?iu)[а-яёa-z]{5,}")


def is_pdf(content: Column) -> Column:
    """Whether bytes, after leading NULs, start with the PDF mark."""
    return F.coalesce(F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"^\x00+", "").startswith("%PDF"), F.lit(False))


def url_file_name(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def history_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "HH:mm")


def canonical_number(c: Column) -> Column:
    """A number's text with a point: whole values in full without a fraction, others in their shortest form, as 0.5 or 1e-05."""
    d = F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    # a large double is a long times a power of two, both exact; from 2**114 on the digits after the 17th are zeros
    power = F.greatest(F.floor(F.log2(F.abs(d))) - 53, F.lit(0))
    long = lambda x: x.cast("long").cast("decimal(19,0)")
    large = (long(d / F.pow(F.lit(2.0), power)) * long(F.pow(F.lit(2.0), power))).cast("string")
    whole = F.when(F.abs(d) < 1e18, d.cast("long").cast("string")).when(F.abs(d) < 2.0**114, large).otherwise(F.regexp_replace(F.format_number(d, 0), ",", ""))
    short = d.cast("string")  # 1.0E-5 below a thousandth
    digits = F.regexp_replace(F.regexp_extract(short, r"^-?([0-9.]+)E", 1), r"\.0$", "")
    tenth = F.regexp_extract(short, r"E-([0-9]+)$", 1)
    tiny = F.when(tenth == "4", F.concat(F.lit("0.000"), F.replace(digits, F.lit("."), F.lit("")))).otherwise(F.concat(digits, F.lit("e-"), F.lpad(tenth, 2, "0")))
    return F.when((F.abs(d) >= 1e18) | (d == F.floor(d)), whole).when(tenth != "", tiny).otherwise(short)
