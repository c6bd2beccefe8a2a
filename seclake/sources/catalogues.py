"""Weakness and attack catalogues (CSV, XML) and retrieval cases (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seclake.functions.documents import decode_entities
from seclake.functions.text import collapse, strip
from seclake.schemas import EVAL_CASES
from seclake.vocab import CATALOG_XML_ATTRIBUTES, CATALOG_XML_CHILDREN


def scan_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """``record`` map of trimmed column names and values, empty for missing."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    pairs = [
        x
        for name in raw.columns
        for x in (
            F.lit(name.lstrip("﻿").strip()),
            strip(F.coalesce(F.col(f"`{name}`"), F.lit(""))),
        )
    ]
    return raw.select(F.create_map(*pairs).alias("record"))


_BROKEN = "_broken_record"


def decode_text(content: Column) -> Column:
    """Text of a file's bytes: UTF-16 with a byte order mark, UTF-8 with or without one, else Latin-1."""
    def starts(mark: bytes) -> Column:
        return F.startswith(content, F.lit(bytearray(mark)))

    utf8 = F.try_validate_utf8(content.cast("string"))
    body = F.when(starts(b"\xef\xbb\xbf"), F.try_validate_utf8(F.substring(content, 4, 2**31 - 1).cast("string")))
    wide = F.when(starts(b"\xff\xfe"), F.decode(F.substring(content, 3, 2**31 - 1), "UTF-16LE")).when(
        starts(b"\xfe\xff"), F.decode(F.substring(content, 3, 2**31 - 1), "UTF-16BE")
    )
    return F.coalesce(wide, body, utf8, F.decode(content, "ISO-8859-1"))


def parse_catalog_csv(lines: DataFrame, header: list[str], value: str = "value") -> DataFrame:
    """Other columns of ``lines``, ``record`` (trimmed names and values, empty for missing) and ``broken``.

    ``value`` holds one CSV record a row, of any table whose columns ``header``
    names; a byte order mark and blanks around the names go.  A record with too few
    or too many fields, or an open quote, is broken and has no map.
    """
    names = [name.lstrip("\ufeff").strip() for name in header]
    schema = ", ".join([f"`c{i}` string" for i in range(len(names))] + [f"`{_BROKEN}` string"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN, "escape": '"', "multiLine": "true"}
    line = F.regexp_replace(F.col(value), "^\ufeff", "")
    kept = [c for c in lines.columns if c not in (value, "record", "broken")]
    parsed = lines.select(*kept, line.alias("_l")).withColumn("_r", F.from_csv("_l", schema, options))
    open_quote = F.length(F.regexp_replace("_l", '[^"]', "")) % 2 == 1
    broken = F.col("_l").isNull() | F.col(f"_r.{_BROKEN}").isNotNull() | open_quote
    pairs = [x for i, name in enumerate(names) for x in (F.lit(name), strip(F.coalesce(F.col(f"_r.c{i}"), F.lit(""))))]
    return parsed.select(*kept, F.when(~broken, F.create_map(*pairs)).alias("record"), broken.alias("broken"))


def parse_catalog_xml(rows: DataFrame, value: str = "value") -> DataFrame:
    """Other columns of ``rows``, ``record`` of the catalogue element in ``value``, and ``broken`` for unreadable ones."""
    fields = [f"`_{a}` string" for a in CATALOG_XML_ATTRIBUTES] + [f"`{c}` string" for c in CATALOG_XML_CHILDREN] + [f"`{_BROKEN}` string"]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN, "ignoreNamespace": "true"}
    kept = [c for c in rows.columns if c not in (value, "record", "broken")]
    parsed = rows.select(*kept, F.from_xml(F.col(value), ", ".join(fields), options).alias("_r"))
    broken = F.col("_r").isNull() | F.col(f"_r.{_BROKEN}").isNotNull()
    flat = parsed.select(*kept, broken.alias("broken"), "_r.*")
    return flat.select(*kept, F.when(~F.col("broken"), _xml_record()).alias("record"), "broken")


def _flat(xml: Column) -> Column:
    return collapse(decode_entities(F.regexp_replace(xml, r"<[^>]*>", " ")))


def scan_catalog_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """``record`` map of a catalogue element (row_tag without name space prefix).

    Mixed content arrives as inner XML and is flattened to text.
    """
    fields = [f"`_{a}` string" for a in CATALOG_XML_ATTRIBUTES] + [f"`{c}` string" for c in CATALOG_XML_CHILDREN]
    raw = spark.read.schema(", ".join(fields)).option("rowTag", row_tag).option("ignoreNamespace", True).xml(path)
    return raw.select(_xml_record().alias("record"))


def _xml_record() -> Column:
    attributes = [
        x for a in CATALOG_XML_ATTRIBUTES for x in (F.lit(a), F.coalesce(F.col(f"_{a}"), F.lit("")))
    ]
    children = [
        x for c in CATALOG_XML_CHILDREN for x in (F.lit(c.replace("_", " ")), F.coalesce(_flat(F.col(c)), F.lit("")))
    ]
    filled = F.map_filter(F.create_map(*children), lambda _, v: v != "")
    return F.map_concat(F.create_map(*attributes), filled)


def scan_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return eval_cases(spark.read.schema(EVAL_CASES).json(path, multiLine=True))


def parse_eval_cases(raw: DataFrame, value: str = "value") -> DataFrame:
    """Cases from a column of JSON objects."""
    return eval_cases(raw.select(F.from_json(value, EVAL_CASES).alias("_v")).where("_v is not null").select("_v.*"))


def eval_cases(raw: DataFrame) -> DataFrame:
    """case_id, query and the expectation lists; the old key is a fallback."""
    empty = F.array().cast("array<string>")
    return raw.select(
        F.sha1(F.encode("query", "UTF-8")).alias("case_id"),
        "query",
        F.coalesce("expected_sources", "must_retrieve", empty).alias("expected_sources"),
        F.coalesce("expected_source_types", empty).alias("expected_source_types"),
        F.coalesce("expected_security_domains", empty).alias("expected_security_domains"),
        F.coalesce("forbidden_sources", empty).alias("forbidden_sources"),
    )


def case_expectations(cases: DataFrame) -> DataFrame:
    """Long form of the expectation lists: case_id, kind, item."""
    kinds = {
        "source": "expected_sources",
        "source_type": "expected_source_types",
        "security_domain": "expected_security_domains",
        "forbidden": "forbidden_sources",
    }

    def tag(kind: str, column: str) -> Column:
        return F.transform(column, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("item")))

    tagged = F.concat(*[tag(kind, column) for kind, column in kinds.items()])
    return cases.select("case_id", F.explode(tagged).alias("_e")).select("case_id", "_e.kind", "_e.item")
