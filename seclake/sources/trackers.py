"""Issue and wiki page exports (JSON lines or one object per file)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seclake.functions.documents import acceptance_criteria, html_to_text
from seclake.operators.issues import _rich_text, rich_text

_ISSUE_TEXT = "array<string>"


def _lines(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole_files)


def _objects(raw: DataFrame, value: str) -> DataFrame:
    return raw.where(F.trim(value) != "").select(F.col(value).alias("raw"), F.try_parse_json(value).alias("_v"))


def _text(tree: str, path: str) -> Column:
    """String at a path; objects and lists come back as JSON."""
    return F.try_variant_get(tree, path, "string")


def _rich(tree: str, path: str) -> Column:
    return rich_text(_text(tree, path))


def _rich_list(values: Column) -> Column:
    @F.pandas_udf(_ISSUE_TEXT)
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda vs: None if vs is None else [_rich_text(v) for v in vs if v])

    return walk(values)


def scan_issues(
    spark: SparkSession, path: str, acceptance_field: str | None = None, whole_files: bool = False
) -> DataFrame:
    return parse_issues(_lines(spark, path, whole_files), acceptance_field)


def parse_issues(raw: DataFrame, acceptance_field: str | None = None, value: str = "value") -> DataFrame:
    """Issues table from a column of JSON.  A configured acceptance field that is absent sets ``data_error``."""
    rows = _objects(raw, value)
    comments = F.transform(
        F.try_variant_get("_v", "$.fields.comment.comments", "array<variant>"),
        lambda c: F.try_variant_get(c, "$.body", "string"),
    )
    components = F.filter(
        F.transform(
            F.try_variant_get("_v", "$.fields.components", "array<variant>"),
            lambda c: F.try_variant_get(c, "$.name", "string"),
        ),
        lambda n: F.coalesce(n, F.lit("")) != "",
    )
    empty = F.array().cast(_ISSUE_TEXT)
    staged = rows.select(
        "raw", "_v",
        _rich("_v", "$.fields.description").alias("description"),
        _rich_list(comments).alias("comments"),
        (_rich("_v", f"$.fields.{acceptance_field}") if acceptance_field else F.lit(None).cast("string")).alias("_ac"),
    )
    criteria = F.col("_ac") if acceptance_field else acceptance_criteria(F.col("description"))
    error = F.when(F.col("_v").isNull(), "issue is not JSON").when(
        ~F.startswith(F.schema_of_variant(F.try_variant_get("_v", "$.fields", "variant")), F.lit("OBJECT")),
        "issue has no fields object",
    )
    if acceptance_field:
        error = error.when(
            F.try_variant_get("_v", f"$.fields.{acceptance_field}", "variant").isNull(),
            f"acceptance criteria field was not returned: {acceptance_field}",
        )
    return staged.select(
        F.coalesce(_text("_v", "$.key"), F.lit("UNKNOWN")).alias("key"),
        F.coalesce(_text("_v", "$.fields.summary"), F.lit("")).alias("summary"),
        "description",
        _text("_v", "$.fields.issuetype.name").alias("issue_type"),
        _text("_v", "$.fields.status.name").alias("status"),
        _text("_v", "$.fields.priority.name").alias("priority"),
        F.coalesce(F.try_variant_get("_v", "$.fields.labels", _ISSUE_TEXT), empty).alias("labels"),
        F.coalesce(components, empty).alias("components"),
        F.coalesce(F.filter("comments", lambda c: F.coalesce(c, F.lit("")) != ""), empty).alias("comments"),
        criteria.alias("acceptance_criteria"),
        "raw",
        error.alias("data_error"),
    )


def scan_remote_links(spark: SparkSession, path: str) -> DataFrame:
    return parse_remote_links(_lines(spark, path))


def parse_remote_links(raw: DataFrame, value: str = "value") -> DataFrame:
    """issue_key, position, url from a column of JSON {"issue_key": …, "links": [...]}."""
    rows = _objects(raw, value)
    links = rows.select(
        _text("_v", "$.issue_key").alias("issue_key"),
        F.posexplode(F.try_variant_get("_v", "$.links", "array<variant>")).alias("position", "_l"),
    )
    url = F.coalesce(F.try_variant_get("_l", "$.object.url", "string"), F.try_variant_get("_l", "$.url", "string"))
    return links.select("issue_key", "position", url.alias("url")).where("url is not null")


def scan_pages(spark: SparkSession, path: str, base_url: str | None = None, whole_files: bool = False) -> DataFrame:
    return parse_pages(_lines(spark, path, whole_files), base_url)


def parse_pages(raw: DataFrame, base_url: str | None = None, value: str = "value") -> DataFrame:
    """Wiki pages from a column of JSON: storage body first, then the rendered one; HTML becomes text."""
    rows = _objects(raw, value)
    page = _text("_v", "$.id")
    body = F.coalesce(
        F.nullif(_text("_v", "$.body.storage.value"), F.lit("")),
        F.nullif(_text("_v", "$.body.view.value"), F.lit("")),
        F.lit(""),
    )
    base = F.coalesce(_text("_v", "$._links.base"), F.lit(base_url))
    webui = F.nullif(_text("_v", "$._links.webui"), F.lit(""))
    return rows.select(
        page.alias("id"),
        F.coalesce(F.nullif(_text("_v", "$.title"), F.lit("")), F.concat(F.lit("Confluence page "), page)).alias("title"),
        F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(webui, F.lit("/"))).alias("url"),
        _text("_v", "$.space.key").alias("space_key"),
        html_to_text(body).alias("body_text"),
    )
