"""Column expressions over plain text.

White space and line ends follow Unicode rules, as in the data the rules were
written for: the ASCII separators 1c-1f count as white space too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
_STRIP_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
    0x2029, 0x202F, 0x205F, 0x3000,
]
_STRIP_CHARS = "".join(chr(code) for code in _STRIP_CODES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def computed(array: Column | str) -> Column:
    """Array to explode whose column is an expensive expression.

    Spark tests a plain column for emptiness before it explodes it and pushes
    that test below the expression, which would then run twice per row.
    """
    return F.slice(array, 1, 2**31 - 1)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_STRIP_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(_STRIP_CHARS))


def ltrim(text: Column) -> Column:
    return F.ltrim(text, F.lit(_STRIP_CHARS))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITESPACE), lambda word: word != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse(text: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.array_join(words(text), " ")


def normalized(text: Column) -> Column:
    return collapse(F.lower(text))


def lines(text: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""
    return let(
        F.split(text, LINE_END),
        lambda rows: F.when(F.element_at(rows, -1) == "", F.slice(rows, F.lit(1), F.size(rows) - 1)).otherwise(rows),
    )


def filled_lines(text: Column) -> Column:
    """Trimmed lines without the blank ones."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda line: line != "")


def literal_strings(values: list[str]) -> Column:
    """Array literal, parsed in one go (building it element by element is slow)."""
    quoted = [value.replace("\\", "\\\\").replace("'", "\\'") for value in values]
    return F.expr("array(" + ", ".join(f"'{value}'" for value in quoted) + ")")


def contains_any(text: Column, literals: list[str]) -> Column:
    if len(literals) > 3:
        return F.exists(literal_strings(literals), lambda literal: F.contains(text, literal))
    test = F.contains(text, F.lit(literals[0]))
    for literal in literals[1:]:
        test = test | F.contains(text, F.lit(literal))
    return test


def truncate_text(text: Column, limit: int | Column) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def cut(t: Column) -> Column:
        head = F.concat(rstrip(F.substr(t, F.lit(1), limit)), F.lit("\n[truncated]"))
        return F.when(F.length(t) <= limit, t).otherwise(head)

    return let(F.coalesce(text, F.lit("")), cut)


def truncate_middle(text: Column, limit: int) -> Column:
    tail = min(12_000, limit // 3)
    head = limit - tail - 80

    def cut(t: Column) -> Column:
        short = F.concat(
            rstrip(F.substr(t, F.lit(1), F.lit(head))),
            F.lit("\n[large prompt truncated to avoid LLM timeout]\n"),
            ltrim(F.right(t, F.lit(tail))),
        )
        return F.when(F.length(t) <= limit, t).otherwise(short)

    return let(text, cut)


def path_segments(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.element_at(path_segments(path), -1)


def file_stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+\z", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]+)\z", 1))


def logical_path(path: Column) -> Column:
    return F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))


def slug(text: Column) -> Column:
    """Finding slug: anything that is neither letter nor digit becomes a dash."""
    return F.upper(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]", "-"), F.lit("-")))


def file_slug(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9._-]+", "-")
    value = F.trim(F.regexp_replace(kept, r"-{2,}", "-"), F.lit("-._"))
    return F.when(value == "", F.lit("item")).otherwise(value)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")
