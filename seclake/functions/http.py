"""Header, cookie, body and token expressions over captured flows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seclake.functions.text import let, strip
from seclake.vocab import BINARY_CONTENT_TYPES

COOKIE_FLAGS = {"secure": "Secure", "httponly": "HttpOnly", "samesite": "SameSite"}


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, any case, else NULL."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.try_element_at(hits, F.lit(1))["value"]


def has_header(headers: Column, name: str) -> Column:
    return F.coalesce(F.exists(headers, lambda h: F.lower(h["name"]) == name), F.lit(False))


def url_path(url: Column) -> Column:
    """Path of a URL without query and fragment, / when empty."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def cookie_name(value: Column) -> Column:
    return strip(F.substring_index(F.substring_index(value, ";", 1), "=", 1))


def cookie_missing(value: Column) -> Column:
    """Names of the protective attributes a set-cookie value leaves out."""
    parts = F.split(value, ";")
    attributes = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda part: F.lower(strip(F.substring_index(part, "=", 1))),
    )
    return F.array_compact(
        F.array(
            *[
                F.when(~F.array_contains(attributes, key), F.lit(label))
                for key, label in COOKIE_FLAGS.items()
            ]
        )
    )


def body_text(content: Column, headers: Column) -> Column:
    """Decoded body; binary or undecodable content becomes a marker with its size."""
    kind = F.lower(F.coalesce(header(headers, "content-type"), F.lit("")))
    size = F.octet_length(content).cast("string")
    binary = F.lit(False)
    for prefix in BINARY_CONTENT_TYPES:
        binary = binary | F.startswith(kind, F.lit(prefix))
    text = content.cast("string")
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), F.lit(None).cast("string"))
        .when(binary, F.concat(F.lit("[omitted: binary content-type "), kind, F.lit(", "), size, F.lit(" bytes]")))
        .when(F.is_valid_utf8(text), text)
        .otherwise(F.concat(F.lit("[omitted: undecodable binary content, "), size, F.lit(" bytes]")))
    )


def jwt_algorithm(token: Column) -> Column:
    """The alg claim of a token header; NULL when absent or unreadable."""
    head = F.translate(F.substring_index(token, ".", 1), "-_", "+/")
    padded = F.concat(head, F.repeat(F.lit("="), F.pmod(-F.length(head), F.lit(4)).cast("int")))
    return let(
        F.try_to_binary(padded, F.lit("base64")).cast("string"),
        lambda text: F.when(F.is_valid_utf8(text), F.get_json_object(text, "$.alg")),
    )
