"""Redaction of secrets and personal data (all native expressions).

A pattern only runs on rows that hold one of its cheap gate literals.  The text
is lower-cased once per row for all gates, so clean text costs one pass of
substring scans instead of fifteen regular expressions.  Replacements never
create a gate literal, so the gates of the original text stay valid throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclake.functions.text import contains_any, let
from seclake.vocab import (
    BARE_SECRETS,
    PII_PATTERNS,
    PREFIXED_SECRETS,
    REDACTED,
    REDACTED_PII,
    SENSITIVE_AUDIT_KEYS,
    SENSITIVE_QUERY_KEYS,
    URL_PATTERN,
)


def _steps(text: Column, lowered: Column, steps: list[tuple[str, str, list[str]]]) -> Column:
    """Apply gated replacements in order."""
    for pattern, replacement, gate in steps:
        text = _step(text, lowered, pattern, replacement, gate)
    return text


def _step(text: Column, lowered: Column, pattern: str, replacement: str, gate: list[str]) -> Column:
    def apply(t: Column) -> Column:
        changed = F.regexp_replace(t, F.lit(pattern), F.lit(replacement))
        return F.when(contains_any(lowered, gate), changed).otherwise(t)

    return let(text, apply)


def _form_decode(part: Column) -> Column:
    # a percent sign that starts no escape stays as it is
    safe = F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(safe)


def _form_encode(part: Column) -> Column:
    # url_encode keeps * and escapes ~; form encoding here does the reverse
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _redact_query(query: Column, keys: list[str]) -> Column:
    """Rewrite one query string, or NULL when it holds no sensitive key."""
    pairs = F.filter(F.split(query, "&"), lambda pair: pair != "")
    parsed = F.transform(
        pairs,
        lambda pair: F.struct(
            _form_decode(F.substring_index(pair, "=", 1)).alias("key"),
            F.when(F.contains(pair, F.lit("=")), _form_decode(F.regexp_replace(pair, r"^[^=]*=", "")))
            .otherwise(F.lit(""))
            .alias("value"),
        ),
    )

    def sensitive(pair: Column) -> Column:
        return F.lower(pair["key"]).isin(keys)

    def render(pair: Column) -> Column:
        value = F.when(sensitive(pair), F.lit(REDACTED)).otherwise(pair["value"])
        return F.concat(_form_encode(pair["key"]), F.lit("="), _form_encode(value))

    return let(
        parsed,
        lambda items: F.when(F.exists(items, sensitive), F.array_join(F.transform(items, render), "&")),
    )


def redact_url(url: Column, keys: list[str] = SENSITIVE_QUERY_KEYS) -> Column:
    """One URL with the values of sensitive query keys replaced."""
    head = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"#(.+)$", 1)
    return let(
        F.struct(url.alias("url"), head.alias("head"), _redact_query(query, keys).alias("query"),
                 fragment.alias("fragment")),
        lambda p: F.when(p["query"].isNull(), p["url"]).otherwise(
            F.concat(
                p["head"], F.lit("?"), p["query"],
                F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(F.lit("")),
            )
        ),
    )


def _redact_urls(text: Column) -> Column:
    # text between URLs and the URLs themselves, zipped back together
    def rebuild(t: Column) -> Column:
        urls = F.transform(F.regexp_extract_all(t, F.lit(URL_PATTERN), F.lit(0)), lambda url: redact_url(url))
        gaps = F.split(t, URL_PATTERN, -1)
        woven = F.zip_with(gaps, urls, lambda gap, url: F.concat(gap, F.coalesce(url, F.lit(""))))
        return F.array_join(woven, "")

    has_query = F.lit(r"https?://[^\s<>'\"]*\?")
    return let(
        text,
        lambda t: F.when(F.contains(t, F.lit("://")) & F.rlike(t, has_query), rebuild(t)).otherwise(t),
    )


def redact_secrets(text: Column) -> Column:
    steps = [*PREFIXED_SECRETS, *[(pattern, REDACTED, gate) for _, pattern, gate in BARE_SECRETS]]
    gates = sorted({literal for _, _, gate in steps for literal in gate})

    def apply(row: Column) -> Column:
        changed = _redact_urls(_steps(row["text"], row["lowered"], steps))
        return F.when(contains_any(row["lowered"], gates), changed).otherwise(row["text"])

    return let(F.struct(text.alias("text"), F.lower(text).alias("lowered")), apply)


def mask_pii(text: Column) -> Column:
    def apply(t: Column) -> Column:
        masked = t
        for _, pattern in PII_PATTERNS:
            masked = F.regexp_replace(masked, F.lit(pattern), F.lit(REDACTED_PII))
        # ten digits are the least any of the numeric patterns needs
        relevant = F.contains(t, F.lit("@")) | F.rlike(t, F.lit(r"(?U)\d(?:[^\d]?[ \-]*\d){9}"))
        return F.when(relevant, masked).otherwise(t)

    return let(text, apply)


def redact(text: Column, pii_mode: str = "off") -> Column:
    if pii_mode not in ("off", "mask"):
        raise ValueError(f"unknown pii_mode: {pii_mode}")
    secretless = redact_secrets(text)
    return mask_pii(secretless) if pii_mode == "mask" else secretless


def find_secrets(text: Column) -> Column:
    """All bare-secret matches, in pattern order and then text order."""
    none = F.array().cast("array<string>")

    def find(row: Column) -> Column:
        found = [
            F.when(
                contains_any(row["lowered"], gate), F.regexp_extract_all(row["text"], F.lit(pattern), F.lit(0))
            ).otherwise(none)
            for _, pattern, gate in BARE_SECRETS
        ]
        return F.flatten(F.array(*found))

    return let(F.struct(text.alias("text"), F.lower(text).alias("lowered")), find)


def secret_kind(value: Column) -> Column:
    """Name of the first bare-secret pattern that matches, else NULL."""
    return F.coalesce(
        *[F.when(F.rlike(value, F.lit(pattern)), F.lit(name)) for name, pattern, _ in BARE_SECRETS]
    )


def pii_counts(text: Column) -> list[Column]:
    return [
        F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias(f"n_{name}")
        for name, pattern in PII_PATTERNS
    ]


def is_sensitive_key(key: Column) -> Column:
    """Keys compare without case and with dashes and underscores as equals."""
    names = sorted({name.replace("_", "-") for name in SENSITIVE_AUDIT_KEYS})
    return F.translate(F.lower(key), "_", "-").isin(names)


def _is_string_list(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StringType)


def _hidden(name: str, by_key: bool) -> bool:
    return by_key and name.lower().replace("_", "-") in {k.replace("_", "-") for k in SENSITIVE_AUDIT_KEYS}


class _Group:
    """Fields redacted together: one expression for all strings, one for all string lists.

    Building and planning the redaction once per field would cost far more than
    packing the values into an array.
    """

    def __init__(self, fields: list[tuple[T.StructField, Column]], pii_mode: str, by_key: bool):
        self.fields, self.pii_mode, self.by_key = fields, pii_mode, by_key
        open_fields = [(f, c) for f, c in fields if not _hidden(f.name, by_key)]
        self.strings = [f.name for f, _ in open_fields if isinstance(f.dataType, T.StringType)]
        self.lists = [f.name for f, _ in open_fields if _is_string_list(f.dataType)]

    def packed(self) -> Column | None:
        values = {f.name: c for f, c in self.fields}
        parts = []
        if self.strings:
            together = F.array(*[values[n] for n in self.strings])
            parts.append(F.transform(together, lambda v: redact(v, self.pii_mode)).alias("s"))
        if self.lists:
            together = F.array(*[values[n] for n in self.lists])
            parts.append(
                F.transform(together, lambda vs: F.transform(vs, lambda v: redact(v, self.pii_mode))).alias("l")
            )
        return F.struct(*parts) if parts else None

    def field(self, name: str, packed: Column | None) -> Column:
        (data_type, value) = next((f.dataType, c) for f, c in self.fields if f.name == name)
        if _hidden(name, self.by_key):
            return F.lit(REDACTED)
        if name in self.strings:
            return packed["s"][self.strings.index(name)]
        if name in self.lists:
            return packed["l"][self.lists.index(name)]
        return redact_nested(value, data_type, self.pii_mode, self.by_key)


def redact_nested(
    value: Column, data_type: T.DataType, pii_mode: str = "off", by_key: bool = False
) -> Column:
    """Redact every string leaf of a nested column.

    With ``by_key`` the values of sensitive map keys and struct fields are
    replaced as a whole.
    """
    if isinstance(data_type, T.StringType):
        return redact(value, pii_mode)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: redact_nested(item, data_type.elementType, pii_mode, by_key))
    if isinstance(data_type, T.MapType):
        def entry(key: Column, item: Column) -> Column:
            inner = redact_nested(item, data_type.valueType, pii_mode, by_key)
            if by_key and isinstance(data_type.valueType, T.StringType):
                return F.when(is_sensitive_key(key), F.lit(REDACTED)).otherwise(inner)
            return inner

        return F.transform_values(value, entry)
    if isinstance(data_type, T.StructType):
        group = _Group([(f, value[f.name]) for f in data_type.fields], pii_mode, by_key)

        def rebuild(packed: Column | None) -> Column:
            return F.struct(*[group.field(f.name, packed).alias(f.name) for f in data_type.fields])

        packed = group.packed()
        return F.when(value.isNotNull(), rebuild(None) if packed is None else let(packed, rebuild))
    return value


def redact_df(
    df: DataFrame, columns: list[str] | None = None, pii_mode: str = "off", by_key: bool = False
) -> DataFrame:
    wanted = [f for f in df.schema.fields if f.name in set(columns or df.columns)]
    group = _Group([(f, F.col(f.name)) for f in wanted], pii_mode, by_key)
    packed = group.packed()
    staged = df if packed is None else df.withColumn("_packed", packed)
    names = {f.name for f in wanted}
    return staged.select(
        *[
            group.field(n, None if packed is None else F.col("_packed")).alias(n) if n in names else F.col(n)
            for n in df.columns
        ]
    )
