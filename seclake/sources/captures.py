"""Captured flows and app fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclake.functions.http import body_text
from seclake.operators.dedupe import first_n
from seclake.schemas import APP_FACTS, ARCHIVE_ENTRIES, FLOWS, RAW_FLOWS


def normalize_bodies(flows: DataFrame) -> DataFrame:
    """Binary ``*_content`` columns become ``*_body`` text."""
    return flows.select(
        *[c for c in flows.columns if c not in ("request_content", "response_content")],
        body_text(F.col("request_content"), F.col("request_headers")).alias("request_body"),
        body_text(F.col("response_content"), F.col("response_headers")).alias("response_body"),
    )


def _read(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)


def scan_flows(
    spark: SparkSession, path: str, kind: str = "json", raw_bodies: bool = False, limit: int | None = None
) -> DataFrame:
    """Flows table; with ``limit`` at most that many flows per capture, in capture order."""
    flows = _read(spark, path, RAW_FLOWS if raw_bodies else FLOWS, kind)
    if raw_bodies:
        flows = normalize_bodies(flows)
    return first_n(flows, ["capture_id"], ["seq"], limit)


def parse_flows(lines: DataFrame, value: str = "value") -> DataFrame:
    """Flows from a column of JSON objects, other columns kept, and ``broken`` for those that are no such object."""
    kept = [c for c in lines.columns if c != value]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken_record"}
    parsed = lines.select(*kept, F.from_json(value, FLOWS + ", _broken_record string", options).alias("_r"))
    broken = F.col("_r").isNull() | F.col("_r._broken_record").isNotNull()
    return parsed.select(*kept, broken.alias("broken"), "_r.*").drop("_broken_record")


def scan_app_facts(spark: SparkSession, root: str, kind: str = "json", tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The app fact tables below ``root``, one folder each."""
    return {name: _read(spark, f"{root}/{name}", APP_FACTS[name], kind) for name in tables or APP_FACTS}


def scan_archive_entries(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return _read(spark, path, ARCHIVE_ENTRIES, kind)
