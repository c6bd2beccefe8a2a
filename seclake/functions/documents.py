"""Column features of a knowledge document: title, source type, areas, HTML text."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from seclake.functions.text import (
    base_name,
    file_stem,
    filled_lines,
    let,
    lines,
    path_segments,
    strip,
    title_case,
)
from seclake.vocab import (
    ACCEPTANCE_MARKERS,
    CONTROL_AREAS,
    CURATED_DROP_LINE_PREFIXES,
    CURATED_DROP_SECTIONS,
    DEFAULT_PRIORITY,
    SOURCE_PRIORITY,
    TEMPLATE_PRIORITY,
)


def _starts_with_any(text: Column, prefixes: list[str]) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | F.startswith(text, F.lit(prefix))
    return test


def _heading_text(line: Column, fallback: Column) -> Column:
    value = strip(F.ltrim(line, F.lit("#")))
    return F.when(value == "", fallback).otherwise(value)


def doc_title(text: Column, path: Column) -> Column:
    """First filled line: heading text, or its first 120 characters."""
    stem = file_stem(path)
    return let(
        F.try_element_at(filled_lines(text), F.lit(1)),
        lambda first: F.when(first.isNull(), stem)
        .when(F.startswith(first, F.lit("#")), _heading_text(first, stem))
        .otherwise(F.substring(first, 1, 120)),
    )


def heading_title(text: Column, path: Column, separators: str = "-") -> Column:
    """First heading anywhere in the text, else the file stem in title case."""
    stem = file_stem(path)
    spoken = title_case(strip(F.translate(stem, separators, " " * len(separators))))
    heading = F.try_element_at(
        F.filter(filled_lines(text), lambda line: F.startswith(line, F.lit("#"))), F.lit(1)
    )
    return let(heading, lambda h: F.when(h.isNull(), spoken).otherwise(_heading_text(h, stem)))


def source_type(path: Column) -> Column:
    parts = path_segments(path)

    def has(name: str) -> Column:
        return F.array_contains(parts, name)

    def has_prefix(prefix: str) -> Column:
        return F.exists(parts, lambda part: F.startswith(part, F.lit(prefix)))

    return (
        F.when(has("internal"), "internal")
        .when(has("portswigger"), "portswigger")
        .when(has("mitre") | has_prefix("mitre-"), "mitre")
        .when(has("owasp") | has_prefix("owasp-"), "owasp")
        .when(has("payloads") | has("payloadsallthethings"), "payloads")
        .otherwise("local")
    )


def is_template(path: Column) -> Column:
    return F.contains(base_name(path), F.lit(".template."))


def priority_of_type(kind: Column) -> Column:
    value = F.lit(None).cast("double")
    for name, priority in SOURCE_PRIORITY.items():
        value = F.coalesce(value, F.when(kind == name, F.lit(priority)))
    return F.coalesce(value, F.lit(DEFAULT_PRIORITY))


def source_priority(path: Column) -> Column:
    return F.when(is_template(path), F.lit(TEMPLATE_PRIORITY)).otherwise(
        priority_of_type(source_type(path))
    )


def effective_priority(configured: Column, kind: Column, template: Column) -> Column:
    """Priority used by ranking: a stored value wins and is clamped to [0, 1]."""
    stored = F.greatest(F.least(configured.cast("double"), F.lit(1.0)), F.lit(0.0))
    derived = F.when(F.coalesce(template, F.lit(False)), F.lit(TEMPLATE_PRIORITY)).otherwise(
        # ranking knows no entry of its own for payload collections; both are 0.50
        priority_of_type(F.coalesce(kind, F.lit("local")))
    )
    return F.when(configured.isNotNull(), stored).otherwise(derived)


def control_areas(text: Column, areas: dict[str, list[str]] = CONTROL_AREAS) -> Column:
    tokens = F.split(F.translate(F.lower(text), "-", " "), r"(?U)[\s\x1c-\x1f]+")
    return let(
        tokens,
        lambda bag: F.array_compact(
            F.array(
                *[
                    F.when(
                        F.arrays_overlap(bag, F.array(*[F.lit(w) for w in keywords])), F.lit(area)
                    )
                    for area, keywords in areas.items()
                ]
            )
        ),
    )


_REFERENCE = r"&(?:#[xX][0-9A-Fa-f]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]*);"
_MARKUP = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<[a-z/](?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+>|<[!?][^>]*>|[^<]+|<"
)
_BREAK_TAG = r"(?i)^<(?:p|br|li|tr|h[1-4])(?=[\s/>])"
_RAW_ELEMENT = r"(?i)^<(?:script|style)\b"


def _entity_map() -> Column:
    known = {**name2codepoint, "apos": 0x27}
    return F.create_map(*[F.lit(x) for name, code in known.items() for x in (name, chr(code))])


def _char(reference: Column) -> Column:
    """Character of one reference; an unknown name stays as written."""
    name = F.regexp_extract(reference, r"^&([^#;]+);", 1)
    number = F.coalesce(
        F.conv(F.nullif(F.regexp_extract(reference, r"^&#[xX]([0-9A-Fa-f]+);", 1), F.lit("")), 16, 10),
        F.nullif(F.regexp_extract(reference, r"^&#(\d+);", 1), F.lit("")),
    ).cast("bigint")
    decoded = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(number.isNotNull(), F.when(number <= 0x10FFFF, decoded).otherwise(F.lit("\ufffd"))).otherwise(
        F.coalesce(F.try_element_at(_entity_map(), name), reference)
    )


def decode_entities(text: Column) -> Column:
    """Named and numeric character references of HTML and XML text."""

    def weave(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)), _char)
        gaps = F.split(t, _REFERENCE, -1)
        return F.array_join(
            F.zip_with(gaps, found, lambda gap, ch: F.concat(gap, F.coalesce(ch, F.lit("")))), ""
        )

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), weave(t)).otherwise(t))


def html_to_text(html: Column) -> Column:
    """Text nodes, with a line break before block starts and no blank lines.

    Script and style content is text too and is not decoded; comments and
    declarations are dropped.
    """

    def render(token: Column) -> Column:
        raw = F.regexp_replace(token, r"(?is)^<[^>]*>|</(?:script|style)\s*>$", "")
        return (
            F.when(~F.startswith(token, F.lit("<")) | (token == "<"), strip(decode_entities(token)))
            .when(F.rlike(token, F.lit(_BREAK_TAG)), F.lit("\n"))
            .when(F.rlike(token, F.lit(_RAW_ELEMENT)), strip(raw))
            .otherwise(F.lit(""))
        )

    tokens = F.regexp_extract_all(html, F.lit(_MARKUP), F.lit(0))
    nodes = F.filter(F.transform(tokens, render), lambda node: node != "")
    return F.array_join(filled_lines(F.array_join(nodes, " ")), "\n")


def acceptance_criteria(text: Column, markers: list[str] = ACCEPTANCE_MARKERS) -> Column:
    """Text from the first known marker on; marker order wins over position."""
    lowered = F.lower(text)
    hits = [
        F.when(F.contains(lowered, F.lit(m)), strip(F.substr(text, F.locate(m, lowered))))
        for m in markers
    ]
    return F.coalesce(*hits)


def clean_markdown(
    text: Column,
    drop_lines: list[str] = CURATED_DROP_LINE_PREFIXES,
    drop_sections: list[str] = CURATED_DROP_SECTIONS,
) -> Column:
    """Remove image lines and listed sections; a section ends at the next heading."""

    def cut(rows: Column) -> Column:
        marks = F.transform(
            rows,
            lambda line, i: F.struct(
                i.alias("at"), _starts_with_any(strip(line), drop_sections).alias("drop"),
                F.startswith(strip(line), F.lit("#")).alias("heading"),
            ),
        )
        heads = F.filter(marks, lambda m: m["heading"] | m["drop"] | (m["at"] == 0))
        # a stretch runs from one heading to the next and is kept or dropped as a whole
        return let(
            heads,
            lambda h: F.flatten(
                F.transform(
                    F.filter(F.transform(h, lambda m, k: F.struct(m.alias("m"), k.alias("k"))), lambda x: ~x["m"]["drop"]),
                    lambda x: F.slice(
                        rows,
                        x["m"]["at"] + 1,
                        F.coalesce(F.try_element_at(h, x["k"] + 2)["at"], F.size(rows)) - x["m"]["at"],
                    ),
                )
            ),
        )

    kept = F.filter(lines(text), lambda line: ~_starts_with_any(strip(line), drop_lines))
    return strip(F.array_join(let(kept, cut), "\n"))


def is_low_value(text: Column, minimum_chars: int) -> Column:
    def check(t: Column) -> Column:
        links = F.size(F.filter(t["rows"], lambda line: _starts_with_any(line, ["http://", "https://"])))
        share = F.try_divide(links.cast("double"), F.size(t["rows"]).cast("double"))
        return (t["chars"] < minimum_chars) | (F.coalesce(share, F.lit(0.0)) > 0.6)

    return let(
        text, lambda t: let(F.struct(filled_lines(t).alias("rows"), F.length(strip(t)).alias("chars")), check)
    )


def has_few_words(text: Column, minimum: int = 20) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))) < minimum


def strip_front_matter(text: Column) -> Column:
    """Drop a leading block between two --- lines; an unclosed one stays."""

    def cut(t: Column) -> Column:
        def body(rows: Column) -> Column:
            rest = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
            close = F.array_position(F.transform(rest, strip), "---").cast("int")
            return let(
                close,
                lambda c: F.when(
                    c > 0, F.array_join(F.slice(rows, c + 2, F.greatest(F.size(rows) - c - 1, F.lit(0))), "\n")
                ).otherwise(t),
            )

        # the whole text is only split when its first line opens a block
        opened = F.rlike(t, F.lit(r"\A[ \t]*---[ \t]*(?:\R|\z)"))
        return F.when(opened, let(lines(t), body)).otherwise(t)

    return let(text, cut)
