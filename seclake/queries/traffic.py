"""Traffic rules on the pages table read as captured flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seclake.functions.http import body_text
from seclake.operators import retrieval, traffic
from seclake.operators.evidence import render_flow
from seclake.queries import base
from seclake.queries.base import FLOWS_SQL, query, table

_SLUG = "upper(trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '-', 'g'), '-'))"
_PATH_OF = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"
_LOC = "method || ' ' || url"


def _rule_sql(where: str, key: str, finding: str, title: str, quote: str, source: str = "f") -> str:
    return f"""SELECT capture_id, id, title, location, quote FROM (
      SELECT capture_id, seq, {finding} AS id, {title} AS title, {_LOC} AS location, {quote} AS quote,
          row_number() OVER (PARTITION BY capture_id, {key} ORDER BY seq) AS pick FROM {source} WHERE {where}) WHERE pick = 1"""


_ALG = "CASE seq % 4 WHEN 0 THEN '''none''' WHEN 3 THEN '''None''' ELSE 'None' END"
_TOKEN = "substr(\"authorization\", 8)"
_COOKIE = "regexp_extract(cookie, '^([^=]*)', 1)"
_LACKS = (
    "array_to_string(list_filter([CASE WHEN NOT contains(cookie, 'Secure') THEN 'Secure' END, CASE WHEN NOT contains(cookie, 'HttpOnly') THEN 'HttpOnly' END, "
    "CASE WHEN NOT contains(cookie, 'SameSite') THEN 'SameSite' END], lambda x: x IS NOT NULL), ', ')"
)
RULES_SQL = {
    "android.dynamic.cleartext_request": _rule_sql(
        "scheme = 'http'", f"host, {_PATH_OF}", f"'DYNAMIC-CLEARTEXT-' || {_SLUG.format(x=f'host || {_PATH_OF}')}",
        f"'Plain HTTP request seen: ' || host || {_PATH_OF}", "method || ' ' || url || ' (scheme=http)'",
    ),
    "android.dynamic.missing_hsts": _rule_sql(
        "scheme = 'https' AND hsts IS NULL", "host", f"'DYNAMIC-MISSING-HSTS-' || {_SLUG.format(x='host')}",
        "'No HSTS header from ' || host", "'Response from ' || host || ' had no HSTS header'",
    ),
    "android.dynamic.missing_csp": _rule_sql(
        "csp IS NULL", "host", f"'DYNAMIC-MISSING-CSP-' || {_SLUG.format(x='host')}",
        "'No content policy on an HTML page of ' || host", "'HTML response from ' || host || ' had no CSP header'",
    ),
    "android.dynamic.secret_in_traffic": _rule_sql(
        "body_key <> ''", "body_key", "'DYNAMIC-SECRET-' || upper(substr(sha256(body_key), 1, 16))",
        "'Secret-shaped value in captured traffic'", "'redacted_length=' || length(body_key)",
    ),
    "android.dynamic.jwt_alg_none": _rule_sql(
        "seq % 4 <> 1", _TOKEN, f"'DYNAMIC-JWT-ALG-NONE-' || upper(substr(sha256({_TOKEN}), 1, 16))",
        "'Token without a signing algorithm'", f"'JWT header alg=' || {_ALG} || ' (token prefix redacted)'",
    ),
    "android.dynamic.cookie_missing_flags": _rule_sql(
        f"scheme = 'https' AND {_LACKS} <> ''", f"host, {_COOKIE}", f"'DYNAMIC-COOKIE-FLAGS-' || {_SLUG.format(x=f'host || {_COOKIE}')}",
        f"'Cookie ''' || {_COOKIE} || ''' of ' || host || ' lacks: ' || {_LACKS}", "cookie",
    ),
}


def _flat(found):
    item = F.col("evidence")[0]
    return found.select("capture_id", "id", "title", item["location"].alias("location"), item["quote"].alias("quote"))


def _register(name: str, rule_id: str) -> None:
    @query(name, f"WITH f AS ({FLOWS_SQL}) {RULES_SQL[rule_id]}")
    def run(spark, sf_dir):
        return _flat(traffic.rule_findings(base.flows(spark, sf_dir), rule_id))


for _name, _rule in {
    "cleartext_findings": "android.dynamic.cleartext_request",
    "hsts_findings": "android.dynamic.missing_hsts",
    "html_host_findings": "android.dynamic.missing_csp",
    "secret_findings": "android.dynamic.secret_in_traffic",
    "jwt_alg_none": "android.dynamic.jwt_alg_none",
    "cookie_flags": "android.dynamic.cookie_missing_flags",
}.items():
    _register(_name, _rule)


_ALL = " UNION ALL ".join(f"SELECT capture_id, '{rule}' AS rule_id FROM ({sql})" for rule, sql in RULES_SQL.items())


@query(
    "traffic_report",
    f"""WITH f AS ({FLOWS_SQL}), a AS ({_ALL}), c AS (SELECT capture_id, count(*) AS flow_count FROM f GROUP BY capture_id)
    SELECT c.capture_id, c.flow_count, CAST(count(a.rule_id) AS INT) AS finding_count, count(DISTINCT a.rule_id) AS rules
    FROM c LEFT JOIN a USING (capture_id) GROUP BY c.capture_id, c.flow_count""",
)
def traffic_report(spark, sf_dir):
    report = traffic.traffic_report(base.flows(spark, sf_dir))
    rules = F.size(F.array_distinct(F.transform("findings", lambda f: f["rule_id"]))).cast("bigint")
    return report.select("capture_id", "flow_count", "finding_count", rules.alias("rules"))


@query(
    "traffic_rule_counts",
    f"WITH f AS ({FLOWS_SQL}), a AS ({_ALL}) SELECT rule_id, count(*) AS findings FROM a GROUP BY rule_id",
)
def traffic_rule_counts(spark, sf_dir):
    return traffic.traffic_findings(base.flows(spark, sf_dir)).groupBy("rule_id").agg(F.count("*").alias("findings"))


@query(
    "body_normalization",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '[omitted: binary content-type image/png, ' || strlen(html) || ' bytes]'
      WHEN 1 THEN NULL WHEN 2 THEN '[omitted: undecodable binary content, 3 bytes]' ELSE html END AS body FROM pages""",
)
def body_normalization(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    form = F.col("page_id") % 4
    kind = F.when(form == 0, "IMAGE/png").otherwise("text/html")
    headers = F.array(F.struct(F.lit("CONTENT-type").alias("name"), kind.alias("value")))
    content = F.when(form == 1, F.unhex(F.lit(""))).when(form == 2, F.unhex(F.lit("FFFE00"))).otherwise(F.encode("html", "UTF-8"))
    return pages.select("page_id", body_text(content, headers).alias("body"))


def _compact_flows_sql(budget: int = 4000) -> str:
    """The greedy walk over a host's flows: texts cut to what is left, stop at the first item that does not fit."""
    text = (
        "method || ' ' || url || ' (host ' || host || ', scheme ' || scheme || ')' || chr(10) || 'Authorization: ' || \"authorization\" || chr(10) || chr(10) "
        "|| 'HTTP status ' || coalesce(CAST(status_code AS VARCHAR), 'unknown') || chr(10) || 'Content-Type: text/html; charset=utf-8' "
        "|| coalesce(chr(10) || 'Strict-Transport-Security: ' || hsts, '') || coalesce(chr(10) || 'Content-Security-Policy: ' || csp, '') || chr(10) || 'Set-Cookie: ' || cookie "
        "|| chr(10) || chr(10) || 'Response body:' || chr(10) || html || ' ' || body_key"
    )

    def item(chars: str) -> str:
        cut = f"CASE WHEN length(f.text) <= {chars} THEN f.text ELSE rtrim(substr(f.text, 1, {chars}), chr(32) || chr(10)) || chr(10) || '[truncated]' END"
        return f"CAST(to_json({{'id': f.id, 'method': f.method, 'url': f.url, 'status_code': f.status_code, 'text': {cut}}}) AS VARCHAR)"

    return f"""WITH RECURSIVE f AS MATERIALIZED (SELECT host, id, "method", url, status_code, {text} AS text, row_number() OVER (PARTITION BY host ORDER BY seq) AS place FROM ({FLOWS_SQL})),
    walk AS (
      SELECT host, 0::BIGINT AS place, {budget}::BIGINT AS left_over, 0 AS taken, false AS done, NULL::VARCHAR AS item FROM (SELECT DISTINCT host FROM f)
      UNION ALL
      SELECT w.host, f.place, CASE WHEN stop THEN w.left_over ELSE w.left_over - length(j) END, CASE WHEN stop THEN w.taken ELSE w.taken + 1 END, stop, CASE WHEN stop THEN NULL ELSE j END
      FROM walk w JOIN f ON f.host = w.host AND f.place = w.place + 1,
      LATERAL (SELECT least(w.left_over, 1200) AS c1, greatest(200, w.left_over - 300) AS c2),
      LATERAL (SELECT {item('c1')} AS j1, {item('c2')} AS j2),
      LATERAL (SELECT w.done OR w.left_over <= 0 OR (length(j1) > w.left_over AND w.taken > 0) AS stop, CASE WHEN length(j1) > w.left_over THEN j2 ELSE j1 END AS j)
      WHERE NOT w.done)
    SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY place) - 1 AS INT) AS item_no, item FROM walk WHERE item IS NOT NULL"""


@query("compact_flows", _compact_flows_sql())
def compact_flows(spark, sf_dir):
    """Prompt budget over the flows of a capture's hosts."""
    rendered = base.flows(spark, sf_dir).select("host", "seq", "id", "method", "url", "status_code", render_flow().alias("text"))
    return retrieval.compact_flows(rendered, group="host", max_chars=4000)
