"""Rules over captured flows.

A rule maps a flow row to an array of candidates.  All rules share one pass: the
arrays are exploded, the first candidate per capture, rule and key is kept in
capture order, and at most 20 findings per rule and capture remain.  The stream
job in ``seclake.streaming`` uses the same candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclake.functions.http import cookie_missing, cookie_name, has_header, header, jwt_algorithm, url_path
from seclake.functions.redact import find_secrets
from seclake.functions.text import let, slug
from seclake.operators.dedupe import first_n, first_per_key
from seclake.operators.findings import complete, evidence
from seclake.vocab import JWT_PATTERN, JWT_UNSIGNED_PATTERN

ORDER = ["seq", "item_no"]
_SEP = "\u0001"
_CANDIDATE = "array<struct<seen_key:string,id:string,title:string,quote:string,item_no:int>>"


def _candidate(
    key: Column, finding_id: Column, title: Column | str, quote: Column, item_no: Column | None = None
) -> Column:
    return F.struct(
        key.alias("seen_key"), finding_id.alias("id"), (F.lit(title) if isinstance(title, str) else title).alias("title"),
        quote.alias("quote"), (item_no if item_no is not None else F.lit(0)).alias("item_no"),
    )


def _only_if(test: Column, candidate: Column) -> Column:
    return F.when(test, F.array(candidate)).otherwise(F.array().cast(_CANDIDATE))


def cleartext_items() -> Column:
    def of_path(path: Column) -> Column:
        target = F.concat("host", path)
        return _candidate(
            F.concat("host", F.lit(_SEP), path),
            F.concat(F.lit("DYNAMIC-CLEARTEXT-"), slug(target)),
            F.concat(F.lit("Plain HTTP request seen: "), target),
            F.concat("method", F.lit(" "), "url", F.lit(" (scheme=http)")),
        )

    return _only_if(F.col("scheme") == "http", let(url_path(F.col("url")), of_path))


def missing_hsts_items() -> Column:
    hit = (F.col("scheme") == "https") & ~has_header(F.col("response_headers"), "strict-transport-security")
    return _only_if(
        hit,
        _candidate(
            F.col("host"),
            F.concat(F.lit("DYNAMIC-MISSING-HSTS-"), slug(F.col("host"))),
            F.concat(F.lit("No HSTS header from "), "host"),
            F.concat(F.lit("Response from "), "host", F.lit(" had no HSTS header")),
        ),
    )


def missing_csp_items() -> Column:
    kind = F.lower(F.coalesce(header(F.col("response_headers"), "content-type"), F.lit("")))
    hit = F.startswith(kind, F.lit("text/html")) & ~has_header(
        F.col("response_headers"), "content-security-policy"
    )
    return _only_if(
        hit,
        _candidate(
            F.col("host"),
            F.concat(F.lit("DYNAMIC-MISSING-CSP-"), slug(F.col("host"))),
            F.concat(F.lit("No content policy on an HTML page of "), "host"),
            F.concat(F.lit("HTML response from "), "host", F.lit(" had no CSP header")),
        ),
    )


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _hash_tag(value: Column) -> Column:
    return F.upper(F.substring(F.sha2(value, 256), 1, 16))


def secret_items() -> Column:
    """Evidence carries the length only and the id a hash prefix, never the value."""
    text = F.concat_ws("\n", _filled("url"), _filled("request_body"), _filled("response_body"))
    return F.transform(
        find_secrets(text),
        lambda value, no: _candidate(
            value,
            F.concat(F.lit("DYNAMIC-SECRET-"), _hash_tag(value)),
            "Secret-shaped value in captured traffic",
            F.concat(F.lit("redacted_length="), F.length(value).cast("string")),
            no,
        ),
    )


def jwt_items(strict_parity: bool = False) -> Column:
    """Tokens without an algorithm or with none; an empty signature counts too."""
    text = F.concat_ws(
        "\n",
        F.nullif(header(F.col("request_headers"), "authorization"), F.lit("")),
        _filled("url"), _filled("request_body"), _filled("response_body"),
    )
    pattern = JWT_PATTERN if strict_parity else JWT_UNSIGNED_PATTERN
    tokens = let(
        text,
        lambda t: F.when(F.contains(t, F.lit("eyJ")), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        .otherwise(F.array().cast("array<string>")),
    )
    read = F.transform(
        tokens,
        lambda token, no: F.struct(token.alias("token"), no.alias("no"), jwt_algorithm(token).alias("alg")),
    )
    unsigned = F.filter(read, lambda t: t["alg"].isNull() | (F.lower(t["alg"]) == "none"))
    return F.transform(
        unsigned,
        lambda t: _candidate(
            t["token"],
            F.concat(F.lit("DYNAMIC-JWT-ALG-NONE-"), _hash_tag(t["token"])),
            "Token without a signing algorithm",
            F.concat(
                F.lit("JWT header alg="),
                F.when(t["alg"].isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), t["alg"], F.lit("'"))),
                F.lit(" (token prefix redacted)"),
            ),
            t["no"],
        ),
    )


def cookie_items() -> Column:
    cookies = F.filter("response_headers", lambda h: F.lower(h["name"]) == "set-cookie")
    read = F.transform(
        cookies,
        lambda h, no: F.struct(
            h["value"].alias("value"), no.alias("no"), cookie_name(h["value"]).alias("name"),
            cookie_missing(h["value"]).alias("missing"),
        ),
    )
    lacking = F.filter(read, lambda c: (F.col("scheme") == "https") & (F.size(c["missing"]) > 0))
    return F.transform(
        lacking,
        lambda c: _candidate(
            F.concat("host", F.lit(_SEP), c["name"]),
            F.concat(F.lit("DYNAMIC-COOKIE-FLAGS-"), slug(F.concat("host", c["name"]))),
            F.concat(F.lit("Cookie '"), c["name"], F.lit("' of "), "host", F.lit(" lacks: "), F.array_join(c["missing"], ", ")),
            c["value"],
            c["no"],
        ),
    )


RULE_ITEMS: dict[str, Callable[..., Column]] = {
    "android.dynamic.cleartext_request": cleartext_items,
    "android.dynamic.missing_hsts": missing_hsts_items,
    "android.dynamic.missing_csp": missing_csp_items,
    "android.dynamic.secret_in_traffic": secret_items,
    "android.dynamic.jwt_alg_none": jwt_items,
    "android.dynamic.cookie_missing_flags": cookie_items,
}


def candidates(flows: DataFrame, rules: list[str] | None = None, **options) -> DataFrame:
    """capture_id, seq, ts, rule_id, seen_key and the parts of each candidate finding."""

    def tagged(rule_id: str) -> Column:
        items = RULE_ITEMS[rule_id](**options).cast(_CANDIDATE)
        return F.transform(items, lambda c: F.struct(F.lit(rule_id).alias("rule_id"), c.alias("c")))

    arrays = [tagged(rule_id) for rule_id in rules or RULE_ITEMS]
    exploded = flows.select(
        "capture_id", "seq", F.col("id").alias("flow_id"), "ts",
        F.concat("method", F.lit(" "), "url").alias("location"), F.explode(F.concat(*arrays)).alias("_x"),
    )
    return exploded.select("capture_id", "seq", "flow_id", "ts", "location", "_x.rule_id", "_x.c.*")


def as_findings(rows: DataFrame, *keys: str) -> DataFrame:
    item = evidence("http_flow", F.col("flow_id"), F.col("location"), F.col("quote"))
    staged = rows.withColumn("evidence", F.array(item)).withColumn("catalogue_id", F.col("rule_id"))
    return complete(staged, *keys)


def traffic_findings(
    flows: DataFrame, limit: int | None = None, rules: list[str] | None = None, **options
) -> DataFrame:
    """First flow per key; with ``limit`` the first that many findings per capture and rule."""
    once = first_per_key(candidates(flows, rules, **options), ["capture_id", "rule_id", "seen_key"], ORDER)
    return as_findings(first_n(once, ["capture_id", "rule_id"], ORDER, limit), "capture_id")


def rule_findings(flows: DataFrame, rule_id: str, limit: int | None = None, **options) -> DataFrame:
    return traffic_findings(flows, limit, [rule_id], **options)


def traffic_report(flows: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per capture: flow count, finding count and the findings."""
    counts = flows.groupBy("capture_id").agg(F.count("*").alias("flow_count"))
    found = traffic_findings(flows, limit)
    grouped = found.groupBy("capture_id").agg(
        F.sort_array(
            F.collect_list(F.struct("rule_id", "id", "title", "category", "severity", "status", "evidence",
                                    "impact", "recommended_validation", "remediation"))
        ).alias("findings")
    )
    joined = counts.join(grouped, "capture_id", "left")
    return joined.withColumn("finding_count", F.coalesce(F.size("findings"), F.lit(0)))
