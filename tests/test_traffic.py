import pytest
from pyspark.sql import Row

from seclake.functions import http
from seclake.operators import traffic
from seclake.operators.evidence import render_flow, segment_array
from seclake.schemas import FLOWS
from seclake.sources.captures import normalize_bodies, scan_flows
from seclake.streaming.jobs import start_findings

NONE = "eyJhbGciOiJub25lIn0.eyJzdWIiOiIxMjM0NTYifQ.c2lnbmF0dXJlMTIz"
HS = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTYifQ.c2lnbmF0dXJlMTIz"
UNREADABLE = "eyJ____________.eyJzdWIiOiIxMjM0NTYifQ.c2lnbmF0dXJlMTIz"


def flow(seq, url="https://h.example/p", **over):
    base = dict(
        capture_id="c", seq=seq, id=f"f{seq}", method="GET", url=url, host="h.example", scheme=url.split(":")[0],
        status_code=200, request_headers=[], request_body=None,
        response_headers=[("Strict-Transport-Security", "x"), ("Content-Type", "application/json")],
        response_body=None, ts=None, source="manual_capture",
    )
    return {**base, **over}


@pytest.fixture
def make(spark):
    order = [c.split(" ")[0] for c in FLOWS.replace("array<struct<name:string,value:string>>", "x").split(", ")]
    return lambda *rows: spark.createDataFrame([tuple(r[c] for c in order) for r in rows], FLOWS)


def found(flows, rule, **options):
    return traffic.rule_findings(flows, f"android.dynamic.{rule}", **options).collect()


def test_cleartext_once_per_host_and_path(make):
    flows = make(flow(2, "http://h.example/a?x=1"), flow(1, "http://h.example/a"), flow(3, "http://h.example"), flow(4))
    rows = found(flows, "cleartext_request")
    assert sorted(r.id for r in rows) == ["DYNAMIC-CLEARTEXT-H-EXAMPLE", "DYNAMIC-CLEARTEXT-H-EXAMPLE-A"]
    assert {r.evidence[0].artifact_path for r in rows} == {"f1", "f3"}
    assert rows[0].severity == "high" and rows[0].status == "confirmed_observation"


def test_hsts_and_csp(make):
    flows = make(
        flow(1), flow(2, response_headers=[]), flow(3, host="g", response_headers=[("content-type", "Text/HTML; x")]),
        flow(4, "http://k.example/", host="k", response_headers=[("Content-Type", "text/html"), ("content-SECURITY-policy", "x")]),
    )
    assert {r.evidence[0].artifact_path for r in found(flows, "missing_hsts")} == {"f2", "f3"}
    assert {r.evidence[0].artifact_path for r in found(flows, "missing_csp")} == {"f3"}


def test_secrets_show_length_only(make):
    key = "AKIA" + "Q" * 16
    rows = found(make(flow(1, response_body=f"x {key}"), flow(2, url=f"https://h.example/{key}")), "secret_in_traffic")
    assert len(rows) == 1 and rows[0].evidence[0].quote == "redacted_length=20"
    assert key not in str(rows[0].asDict()) and key[:10] not in rows[0].id


def test_unsigned_tokens(make):
    def with_token(seq, token):
        return flow(seq, request_headers=[("AUTHORIZATION", f"Bearer {token}")])

    unsigned = NONE.rsplit(".", 1)[0] + "."
    flows = make(with_token(1, NONE), with_token(2, HS), with_token(3, UNREADABLE), with_token(4, NONE), with_token(5, unsigned))
    quotes = {r.evidence[0].artifact_path: r.evidence[0].quote for r in found(flows, "jwt_alg_none")}
    assert set(quotes) == {"f1", "f3", "f5"}
    assert quotes["f1"].startswith("JWT header alg='none'") and quotes["f3"].startswith("JWT header alg=None")
    strict = found(flows, "jwt_alg_none", strict_parity=True)
    assert {r.evidence[0].artifact_path for r in strict} == {"f1", "f3"}


def test_cookies_keep_duplicate_headers(make):
    headers = [("Set-Cookie", "a=1"), ("set-cookie", "b=2; secure; HTTPONLY; SameSite=Lax"), ("Set-Cookie", "c=3; Secure")]
    rows = found(make(flow(1, response_headers=headers), flow(2, response_headers=headers)), "cookie_missing_flags")
    titles = {r.title for r in rows}
    assert titles == {"Cookie 'a' of h.example lacks: Secure, HttpOnly, SameSite", "Cookie 'c' of h.example lacks: HttpOnly, SameSite"}


def test_cap_per_rule_and_report(make):
    flows = make(*[flow(i, f"http://h.example/{i}") for i in range(30)], flow(99, capture_id="d"))
    assert len(found(flows, "cleartext_request")) == 30
    rows = found(flows, "cleartext_request", limit=20)
    assert sorted(int(r.evidence[0].artifact_path[1:]) for r in rows) == list(range(20))
    report = {r.capture_id: r for r in traffic.traffic_report(flows, 20).collect()}
    assert (report["c"].flow_count, report["c"].finding_count) == (30, 20)
    report = {r.capture_id: r for r in traffic.traffic_report(flows).collect()}
    assert (report["c"].flow_count, report["c"].finding_count) == (30, 30)
    assert (report["d"].flow_count, report["d"].finding_count) == (1, 0)


def test_rendering_is_quotable(spark, make):
    body = '{"a": [1, "é"]}'
    flows = make(flow(1, request_headers=[("X", "1")], request_body=body, response_body="y" * 5000, status_code=None))
    text = flows.select(render_flow(4000).alias("t")).first().t
    assert "y" * 5000 in flows.select(render_flow().alias("t")).first().t
    head, status, request, response = text.split("\n\n")
    assert head == "GET https://h.example/p (host h.example, scheme https)\nX: 1"
    assert status.splitlines()[0] == "HTTP status unknown"
    assert request == 'Request body:\n{\n  "a": [\n    1,\n    "é"\n  ]\n}'
    assert response == "Response body:\n" + "y" * 4000 + "\n[truncated]"
    segments = flows.select(segment_array(render_flow()).alias("s")).first().s
    assert "X: 1" in segments


def test_bodies(spark):
    html, image = [Row(name="Content-Type", value="text/html")], [Row(name="content-type", value="Image/PNG")]
    df = spark.createDataFrame(
        [(1, html, b"ok", image, b"abc"), (2, html, b"\xff\xfe\x00", html, b""), (3, html, None, html, b"\xc3\xa9")],
        "id int, request_headers array<struct<name:string,value:string>>, request_content binary, response_headers array<struct<name:string,value:string>>, response_content binary",
    )
    rows = {r.id: r for r in normalize_bodies(df).collect()}
    assert rows[1].request_body == "ok" and rows[1].response_body == "[omitted: binary content-type image/png, 3 bytes]"
    assert rows[2].request_body == "[omitted: undecodable binary content, 3 bytes]" and rows[2].response_body is None
    assert rows[3].request_body is None and rows[3].response_body == "é"


def test_url_parts(value):
    assert value(http.url_path, "https://h?x=/a") == "/" and value(http.url_path, "https://h/a/b#c") == "/a/b"


def test_flow_scan_caps_each_capture(spark, make, tmp_path):
    path = str(tmp_path / "flows")
    make(*[flow(i) for i in range(9)], *[flow(i, capture_id="d") for i in range(2)]).write.json(path)
    counts = {r.capture_id: r["count"] for r in scan_flows(spark, path, limit=4).groupBy("capture_id").count().collect()}
    assert counts == {"c": 4, "d": 2}
    assert {r.seq for r in scan_flows(spark, path, limit=4).where("capture_id = 'c'").collect()} == {0, 1, 2, 3}


def test_stream_equals_batch_without_late_rows(spark, make, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [
        flow(i, f"http://h.example/{i % 3}", ts=start + timedelta(seconds=i), response_headers=[("Set-Cookie", "a=1")])
        for i in range(6)
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    make(*rows).coalesce(1).write.json(source)
    stream = spark.readStream.schema(FLOWS).json(source)
    start_findings(stream, out, str(tmp_path / "cp")).awaitTermination()
    batch = traffic.traffic_findings(spark.read.schema(FLOWS).json(source))
    streamed = spark.read.json(out)
    assert {r.id for r in streamed.collect()} == {r.id for r in batch.collect()}
    assert streamed.count() == batch.count()
