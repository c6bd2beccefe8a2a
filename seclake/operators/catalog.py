"""Curated collections and weakness catalogues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seclake.functions import documents as D
from seclake.functions import ids
from seclake.functions.redact import redact
from seclake.functions.text import base_name, collapse, contains_any, file_slug, let, normalized, path_segments, strip
from seclake.operators.chunking import ATOMIC_TYPES, markdown_parts, window_texts
from seclake.operators.classify import DOMAIN_KEYWORDS, domains_of
from seclake.operators.dedupe import first_n, flag_first
from seclake.vocab import (
    CATALOG_ID_FIELDS,
    CATALOG_IDS,
    CATALOG_KEYWORDS,
    CATALOG_PREFERRED_FIELDS,
    CURATED_ALLOW,
    CURATED_EXCLUDE,
    CURATED_MIN_CHARS,
    CURATED_SOURCE_NAME,
    EXTERNAL_METHODOLOGY,
    IMPORT_PRESETS,
    INDEX_SCHEMA_VERSION,
    LOW_VALUE_NAMES,
    SOURCE_PRIORITY,
)


# -- path patterns ---------------------------------------------------------------------


def glob_regex(patterns: list[str]) -> str:
    """One regular expression for shell patterns; * also crosses folders."""
    bodies = []
    for pattern in patterns:
        out = []
        for char in re.sub(r"\*+", "*", pattern.lower()):
            out.append({"*": ".*", "?": "."}.get(char) or re.escape(char))
        bodies.append("".join(out))
    return r"(?s)\A(?:" + "|".join(bodies) + r")\z"


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whole path or base name, lower case, against any pattern."""
    names = [re.sub(r"^(?:\*\*/)+", "", p) for p in patterns]
    lowered = F.lower(path)
    return F.rlike(lowered, F.lit(glob_regex(patterns))) | F.rlike(
        base_name(lowered), F.lit(glob_regex(names))
    )


def curated_dispositions(
    docs: DataFrame,
    allow: list[str] = CURATED_ALLOW,
    exclude: list[str] = CURATED_EXCLUDE,
    min_chars: int = CURATED_MIN_CHARS,
    max_mb: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Add ``text`` cleaned and a ``disposition``; exclude patterns win over allow ones.

    Limits on size and number of files are off unless given.

    ``docs``: relative_path, text (NULL when not UTF-8), optionally length.
    """
    path = F.col("relative_path")
    size = F.col("length") if "length" in docs.columns else F.octet_length("text")
    markdown = docs.where(F.endswith(path, F.lit(".md")))
    oversized = F.lit(False) if max_mb is None else size > max_mb * 1024 * 1024
    staged = flag_first(markdown, F.split(path, "/"), max_files).withColumn("_clean", D.clean_markdown(F.col("text")))
    state = (
        F.when(~F.col("_within"), "over_limit")
        .when(oversized, "oversized")
        .when(glob_match(path, exclude), "excluded")
        .when(~glob_match(path, allow), "not_allowed")
        .when(F.col("text").isNull(), "not_utf8")
        .when(F.length("_clean") < min_chars, "too_short")
        .otherwise("accepted")
    )
    return staged.withColumn("disposition", state).withColumn("text", F.col("_clean")).drop("_clean", "_within")


def select_by_globs(docs: DataFrame, allow: list[str] = CURATED_ALLOW, exclude: list[str] = CURATED_EXCLUDE,
                    min_chars: int = CURATED_MIN_CHARS, **limits) -> DataFrame:
    """Accepted documents: relative_path, cleaned text, title, domains."""
    kept = curated_dispositions(docs, allow, exclude, min_chars, **limits).where("disposition = 'accepted'")
    titled = kept.withColumn("title", D.heading_title(F.col("text"), F.col("relative_path")))
    return titled.select("relative_path", "text", "title")


# -- curated chunks ----------------------------------------------------------------------


def curated_chunk_rows(
    docs: DataFrame,
    *,
    scope: dict[str, str],
    source_name: str = CURATED_SOURCE_NAME,
    index_root: str = "",
    version: str = "unknown",
    language: str = "en",
    min_chars: int = CURATED_MIN_CHARS,
    keywords: dict[str, list[str]] = DOMAIN_KEYWORDS,
    pii_mode: str = "off",
    schema_version: int = INDEX_SCHEMA_VERSION,
) -> DataFrame:
    """Chunks with a header, without low-value ones; not yet deduplicated."""
    path, title = F.col("relative_path"), F.col("title")
    domains = domains_of(path, title, F.col("text"), keywords)
    staged = docs.select(
        "relative_path", "title", redact(F.col("text"), pii_mode).alias("text"), domains.alias("_domains")
    ).withColumn("_parts", markdown_parts(F.col("text")))

    def expand(part: Column) -> Column:
        section = F.array_join(F.filter(part["section_path"], lambda s: s != ""), " > ")
        head = F.concat(
            F.lit("Title: "), title, F.when(section != "", F.concat(F.lit("\nSection: "), section)).otherwise(F.lit(""))
        )
        texts = F.when(part["chunk_type"].isin(ATOMIC_TYPES), F.array(part["text"])).otherwise(
            window_texts(part["text"])
        )
        return F.transform(
            texts,
            lambda body: F.struct(
                part["title"].alias("section"), part["chunk_type"].alias("chunk_type"),
                part["section_path"].alias("section_path"),
                strip(F.concat(head, F.lit("\n\nContent:\n"), body)).alias("text"),
            ),
        )

    chunks = F.filter(
        F.flatten(F.transform("_parts", expand)), lambda c: ~D.is_low_value(c["text"], min_chars)
    )
    rows = staged.withColumn("content_hash", ids.content_hash(F.col("text"))).select(
        "relative_path", "title", "content_hash", "_domains", F.posexplode(chunks).alias("_pos", "_c")
    )
    body = F.col("_c.text")
    return rows.select(
        ids.curated_chunk_id(path, F.col("_c.section_path"), body, source_name=source_name, scope=scope,
                             version=schema_version).alias("chunk_id"),
        F.concat(F.lit(f"{source_name}:"), path).alias("source"),
        F.when(F.col("_c.section") == "", title).otherwise(F.col("_c.section")).alias("title"),
        body.alias("text"), F.col("title").alias("document_title"), F.col("_c.section").alias("section"),
        F.col("_c.chunk_type").alias("chunk_type"), F.col("_c.section_path").alias("section_path"),
        F.col("_c.section_path").alias("heading_path"), F.col("_pos"),
        ids.document_id(path, source_name=F.lit(source_name), scope=scope, version=schema_version).alias("document_id"),
        "content_hash", F.lit(index_root).alias("index_root"),
        F.lit(EXTERNAL_METHODOLOGY).alias("source_type"), F.lit(source_name).alias("source_name"),
        F.lit(SOURCE_PRIORITY[EXTERNAL_METHODOLOGY]).alias("source_priority"),
        F.lit("security_guidance").alias("evidence_type"), F.lit("guidance").alias("authority_level"),
        F.lit(False).alias("is_internal"), F.col("_domains")[0].alias("security_domain"),
        F.col("_domains").alias("security_domains"), path.alias("document_path"),
        F.lit(language).alias("language"), F.lit(version).alias("version"),
        F.lit(True).alias("license_review_required"), F.lit(False).alias("is_template"),
        F.lit(schema_version).alias("index_schema_version"),
        D.control_areas(F.concat_ws(" ", F.col("_domains")[0], body)).alias("control_areas"),
        *[F.lit(value).alias(name) for name, value in scope.items()],
    )


def chunk_curated(docs: DataFrame, **options) -> DataFrame:
    """Curated chunks, each normalised text once, numbered per document."""
    rows = curated_chunk_rows(docs, **options).withColumn("_key", ids.content_hash(normalized(F.col("text"))))
    kept = first_n(rows, ["_key"], ["document_path", "_pos"], 1)
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("_pos")) - 1
    return kept.withColumn("chunk_index", number).drop("_key", "_pos")


def domain_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("security_domain").agg(F.count("*").alias("chunks"))


# -- markdown collections -----------------------------------------------------------------


def _pure_path_regex(pattern: str) -> str:
    """Relative shell pattern matched from the right, part by part (* stays in a part)."""
    parts = []
    for part in pattern.split("/"):
        body = "".join(
            {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c) for c in re.sub(r"\*+", "*", part)
        )
        parts.append(body)
    return r"(?:\A|/)" + "/".join(parts) + r"\z"


def _probe(pattern: str) -> str:
    """Pattern without its wild cards, for the case-free substring test."""
    text = pattern.lower().replace("**/", "").replace("/**/*.md", "")
    return text.replace("*.md", "").replace("*", "").strip("/")


def preset_match(path: Column, patterns: list[str]) -> Column:
    exact = [_pure_path_regex(p) for p in patterns]
    exact += [_pure_path_regex(p[3:]) for p in patterns if p.startswith("**/")]
    probes = [p for p in map(_probe, patterns) if p]
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    found = F.rlike(clean, F.lit("|".join(exact)))
    for probe in probes:
        found = found | F.contains(F.lower(clean), F.lit(probe))
    return found


def import_dispositions(docs: DataFrame, preset: str) -> DataFrame:
    """Markdown files of a collection with their ``disposition``."""
    rules = IMPORT_PRESETS[preset]
    path, text = F.col("relative_path"), F.col("text")
    state = (
        F.when(base_name(path).isin(LOW_VALUE_NAMES), "low_value_name")
        .when(~preset_match(path, rules["allow"]), "not_allowed")
        .when(text.isNull(), "not_utf8")
        .when((text == "") | D.has_few_words(text), "too_short")
        .otherwise("written")
    )
    return docs.where(F.endswith(path, F.lit(".md"))).withColumn("disposition", state)


def _destination(path: Column) -> Column:
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]+\z", "")
    return F.concat(F.array_join(F.transform(path_segments(stem), file_slug), "/"), F.lit(".md"))


def _unique_destinations(df: DataFrame, order: str) -> DataFrame:
    """Second and later documents of one destination get a hash suffix."""
    window = Window.partitionBy("destination").orderBy(order)
    digest = F.substring(F.sha2("destination", 256), 1, 8)
    number = F.row_number().over(window)
    stem = F.regexp_replace("destination", r"\.md\z", "")
    named = (
        F.when(number == 1, F.col("destination"))
        .when(number == 2, F.concat(stem, F.lit("-"), digest, F.lit(".md")))
        .otherwise(F.concat(stem, F.lit("-"), digest, F.lit("-"), (number - 1).cast("string"), F.lit(".md")))
    )
    return df.withColumn("_named", named).drop("destination").withColumnRenamed("_named", "destination")


def normalize_markdown(imported: DataFrame, preset: str) -> DataFrame:
    """Provenance header plus body: destination, relative_path, title, text."""
    rules = IMPORT_PRESETS[preset]
    title = D.heading_title(F.col("text"), F.col("relative_path"), "-_")
    body = strip(D.strip_front_matter(F.col("text")))
    text = F.concat(
        F.lit("# "), F.col("title"), F.lit(f"\n\n- Source: {rules['label']}\n- Upstream: {rules['url']}\n- Upstream path: `"),
        F.col("relative_path"), F.lit(f"`\n- License: {rules['license']}\n\n## Imported Content\n\n"), F.col("_body"), F.lit("\n"),
    )
    staged = imported.select("relative_path", title.alias("title"), body.alias("_body")).withColumn(
        "destination", F.concat(F.lit(f"{preset}/"), _destination(F.col("relative_path")))
    )
    return _unique_destinations(staged, "relative_path").select("destination", "relative_path", "title", text.alias("text"))


def import_markdown(docs: DataFrame, preset: str) -> DataFrame:
    return normalize_markdown(import_dispositions(docs, preset).where("disposition = 'written'"), preset)


def import_report(dispositions: DataFrame, preset: str, written: str = "written") -> DataFrame:
    """One row: files scanned, written, skipped and a warning when nothing was written."""
    counts = dispositions.agg(
        F.count("*").alias("files_scanned"),
        F.count_if(F.col("disposition") == written).alias("files_written"),
        F.count_if(F.col("disposition") != written).alias("files_skipped"),
    )
    warning = F.when(F.col("files_written") == 0, F.array(F.lit("nothing was imported; check path and layout"))).otherwise(
        F.array().cast("array<string>")
    )
    return counts.select(F.lit(preset).alias("source_kind"), "*", warning.alias("warnings"))


# -- weakness catalogues --------------------------------------------------------------------


def _first_filled(record: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(record, F.lit(n)), F.lit("")) for n in names], F.lit(""))


def relevant_records(
    records: DataFrame, keywords: list[str] = CATALOG_KEYWORDS, identifiers: list[str] = CATALOG_IDS
) -> DataFrame:
    """Records (``record``: map<string,string>) with a listed keyword or id."""
    text = F.lower(F.array_join(F.map_values("record"), " "))
    keyword = let(text, lambda t: contains_any(t, keywords))
    return records.where(keyword | _first_filled(F.col("record"), CATALOG_ID_FIELDS).isin(identifiers))


def catalog_to_markdown(records: DataFrame, label: str, folder: str) -> DataFrame:
    """One document per record: preferred fields in order, the others sorted in a list."""
    record = F.col("record")
    identifier = strip(_first_filled(record, [*CATALOG_ID_FIELDS, "Name"]))
    name = strip(_first_filled(record, ["Name", "Title"]))
    staged = records.withColumn("_name", F.when(name == "", identifier).otherwise(name)).withColumn(
        "identifier", F.when(identifier == "", file_slug(F.col("_name"))).otherwise(identifier)
    ).withColumnRenamed("_name", "name")
    sections = [
        F.when(
            F.coalesce(F.try_element_at(record, F.lit(key)), F.lit("")) != "",
            F.concat(F.lit(f"## {key.replace('_', ' ')}\n\n"), collapse(F.try_element_at(record, F.lit(key))), F.lit("\n")),
        )
        for key in CATALOG_PREFERRED_FIELDS
    ]
    hidden = [*CATALOG_PREFERRED_FIELDS, *CATALOG_ID_FIELDS, "Name"]
    rest = F.array_sort(F.filter(F.map_entries(record), lambda e: ~e["key"].isin(hidden) & (e["value"] != "")))
    extra = F.when(
        F.size(rest) > 0,
        F.concat(
            F.lit("## Additional Fields\n\n"),
            F.array_join(F.transform(rest, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), collapse(e["value"]))), "\n"),
            F.lit("\n"),
        ),
    )
    head = F.concat(
        F.lit(f"# {label} - "), "identifier", F.lit(": "), "name",
        F.lit(f"\n\n- Source: {label}\n- Source ID: "), "identifier", F.lit("\n"),
    )
    text = F.concat(strip(F.concat_ws("\n", head, *sections, extra)), F.lit("\n"))
    destination = F.concat(F.lit(f"{folder}/"), file_slug(F.concat("identifier", F.lit("-"), "name")), F.lit(".md"))
    return staged.select("identifier", "name", destination.alias("destination"), text.alias("text"))
