"""Issue fields, rich text and issue-to-page links."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seclake.operators.dedupe import first_per_key
from seclake.vocab import LINK_PATTERN

_BLOCKS = {"paragraph", "heading", "listItem"}


class _Node(dict):
    """A parsed object together with the text it stands for."""

    parts: tuple[str, ...] = ()


def _parts(value) -> tuple[str, ...]:
    if isinstance(value, _Node):
        return value.parts
    return tuple(p for v in value for p in _parts(v)) if isinstance(value, list) else ()


def _rendered(pairs: dict) -> _Node:
    """Called by the parser for every object, the inner ones first: its links, its text, its content, a break."""
    node = _Node(pairs)
    attrs = [pairs.get("attrs"), *(m.get("attrs") for m in pairs.get("marks") or [] if isinstance(m, dict))]
    urls = [a.get(key) for i, a in enumerate(attrs) if isinstance(a, dict) for key in (("href", "url") if i == 0 else ("href",))]
    links = tuple(u for u in urls if isinstance(u, str) and u.startswith(("http://", "https://")))
    kind = pairs.get("type")
    own = (pairs["text"],) if kind == "text" and pairs.get("text") else ()
    node.parts = links + own + _parts(pairs.get("content", [])) + (("\n",) if kind in _BLOCKS else ())
    return node


def _rich_text(value: str) -> str | None:
    try:
        root = json.loads(value, object_hook=_rendered)
    except ValueError:
        return value
    if not isinstance(root, _Node):
        return value
    return "\n".join(p for p in root.parts if p).strip() or None


def rich_text(value: Column) -> Column:
    """Plain text of a rich-text JSON column; a column of plain text passes through.

    The tree has no fixed depth; the parser renders it from the leaves up.
    """

    @F.pandas_udf("string")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: None if v is None else _rich_text(v))

    return walk(value)


def wiki_urls(text: Column) -> Column:
    """Distinct wiki URLs of a text, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(LINK_PATTERN), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,;")))
    return F.array_distinct(F.filter(found, _is_wiki))


def _is_wiki(url: Column) -> Column:
    return F.contains(F.lower(url), F.lit("confluence")) | F.contains(url, F.lit("/wiki/"))


def page_id(url: Column) -> Column:
    """Page id of a wiki URL: query parameter first, then the known path forms."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    candidates = [
        F.url_decode(F.regexp_extract(query, r"(?:^|&)pageId=([^&]+)", 1)),
        *[F.regexp_extract(path, p, 1) for p in (r"/pages/(\d+)", r"/content/(\d+)", r"/pageId/(\d+)")],
    ]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def link_pages(issues: DataFrame, remote_links: DataFrame, pages: DataFrame) -> DataFrame:
    """issue_key, position (from 0) and the page columns of every page an issue refers to.

    ``remote_links``: issue_key, position, url.  Links in the issue's text come
    first; a page linked twice counts once.
    """
    text = F.concat_ws(
        "\n", F.coalesce("description", F.lit("")), F.coalesce("acceptance_criteria", F.lit("")),
        F.array_join("comments", "\n"),
    )
    inline = issues.select(F.col("key").alias("issue_key"), F.posexplode(wiki_urls(text)).alias("position", "url")).withColumn(
        "position", F.struct(F.lit(0).alias("kind"), "position")
    )
    remote = remote_links.select(
        "issue_key", F.struct(F.lit(1).alias("kind"), F.col("position").cast("int").alias("position")).alias("position"), F.rtrim("url", F.lit(".,;")).alias("url")
    ).where(_is_wiki(F.col("url")))
    links = inline.unionByName(remote).withColumn("id", page_id(F.col("url"))).where("id is not null")
    once = first_per_key(links, ["issue_key", "id"], ["position", "url"])
    numbered = once.withColumn("position", F.row_number().over(Window.partitionBy("issue_key").orderBy("position", "id")) - 1)
    return numbered.select("issue_key", "position", "id").join(pages, "id")


def unresolved_links(issues: DataFrame, remote_links: DataFrame, pages: DataFrame) -> DataFrame:
    """Linked page ids that no page row answers."""
    known = link_pages(issues, remote_links, pages.select("id"))
    text = F.concat_ws("\n", "description", "acceptance_criteria", F.array_join("comments", "\n"))
    inline = issues.select(F.col("key").alias("issue_key"), F.explode(wiki_urls(text)).alias("url"))
    remote = remote_links.select("issue_key", "url").where(_is_wiki(F.col("url")))
    ids = inline.unionByName(remote).select("issue_key", page_id(F.rtrim("url", F.lit(".,;"))).alias("id"))
    return ids.where("id is not null").distinct().join(known.select("issue_key", "id"), ["issue_key", "id"], "left_anti")
