"""Deterministic identifiers as column expressions (RFC 4122 version 5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seclake.functions.text import logical_path
from seclake.vocab import INDEX_SCHEMA_VERSION

# fixed value: the RFC 4122 name space for URLs
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _identity(prefix: str, *parts: Column) -> Column:
    return uuid5(F.concat(F.lit(prefix), F.concat_ws("|", *parts)))


def document_id(
    path: Column,
    *,
    source_name: Column,
    scope: dict[str, str],
    version: int = INDEX_SCHEMA_VERSION,
    prefix: str = "document:",
) -> Column:
    return _identity(
        prefix,
        F.lit(str(version)),
        source_name,
        F.lit(scope["tenant_id"]),
        F.lit(scope["environment"]),
        F.lit(scope["knowledge_base_id"]),
        logical_path(path),
    )


def chunk_id(
    document: Column,
    heading_path: Column,
    text: Column,
    *,
    version: int = INDEX_SCHEMA_VERSION,
    prefix: str = "chunk:",
) -> Column:
    return _identity(
        prefix,
        F.lit(str(version)),
        document,
        F.array_join(heading_path, " > "),
        content_hash(text),
    )


def curated_chunk_id(
    path: Column,
    heading_path: Column,
    text: Column,
    *,
    source_name: str,
    scope: dict[str, str],
    version: int = INDEX_SCHEMA_VERSION,
) -> Column:
    return _identity(
        "",
        F.lit(str(version)),
        F.lit(source_name),
        F.lit(scope["tenant_id"]),
        F.lit(scope["environment"]),
        F.lit(scope["knowledge_base_id"]),
        path,
        F.array_join(heading_path, " > "),
        content_hash(text),
    )


def unscoped_document_id(source: Column, *, prefix: str = "document:") -> Column:
    """Identifier of indexes written before scopes existed."""
    return _identity(prefix, source)


def unscoped_chunk_id(source: Column, index: Column, text: Column) -> Column:
    return uuid5(F.sha2(F.encode(F.concat_ws(":", source, index.cast("string"), text), "UTF-8"), 256))
