import random
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import functions as F

from seclake.functions import redact
from seclake.sources.sinks import append_audit, redact_audit
from seclake.vocab import SENSITIVE_QUERY_KEYS


def test_prefixed_secrets_keep_their_prefix(value):
    out = value(redact.redact_secrets, "Authorization: Bearer abc.def, x\npassword = 'a b' Cookie: a=1; b=2\n\"token\": \"q\"")
    assert "Authorization: Bearer [REDACTED], x" in out
    assert "password = [REDACTED]" in out
    assert "Cookie: [REDACTED]\n" in out
    assert "abc.def" not in out and "a b" not in out and "\"q\"" not in out


def test_xml_secret_keeps_both_tags(value):
    assert value(redact.redact_secrets, "<apiKey>k\nl</apiKey>") == "<apiKey>[REDACTED]</apiKey>"


def test_bare_secrets(value):
    samples = [
        "AKIA" + "A" * 16, "ghp_" + "a" * 24, "glpat-" + "B" * 20, "xoxb-" + "1" * 12, "npm_" + "c" * 20,
        "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "mongodb+srv://u:p@host/db", "postgresql://u:p@h/x",
        "jdbc:sqlserver://h;user=a;password=b", "AccountName=a;AccountKey=b",
        "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
    ]
    for sample in samples:
        assert value(redact.redact_secrets, f"x {sample}") == "x [REDACTED]", sample
    found = value(redact.find_secrets, f"{samples[1]} {samples[0]}")
    assert found == [samples[0], samples[1]]  # pattern order, not text order


def test_clean_text_and_null(value):
    assert value(redact.redact_secrets, "nothing here") == "nothing here"
    assert value(redact.redact, None) is None


def test_redaction_is_idempotent(value):
    text = "token=abc; https://h/x?a=1&sig=2 AKIA" + "Z" * 16
    once = value(redact.redact_secrets, text)
    assert value(redact.redact_secrets, once) == once
    assert value(redact.find_secrets, once) == []


def _expected_url(url):
    parts = urlsplit(url)
    pairs = parse_qsl(parts.query, keep_blank_values=True)
    if not any(k.lower() in SENSITIVE_QUERY_KEYS for k, _ in pairs):
        return url
    safe = [(k, "[REDACTED]" if k.lower() in SENSITIVE_QUERY_KEYS else v) for k, v in pairs]
    return urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode(safe), parts.fragment))


def test_url_rewrite_matches_form_encoding(spark):
    rng = random.Random(7)
    keys, letters = ["a", "sig", "CODE", "x y", "é", "state"], "ab1 é&=+%/~*"
    urls = []
    for _ in range(300):
        pairs = [
            (rng.choice(keys), "".join(rng.choice(letters) for _ in range(rng.randrange(6))))
            for _ in range(rng.randrange(1, 5))
        ]
        urls.append("https://h.example/p/q?" + urlencode(pairs) + rng.choice(["", "#top"]))
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    for row in frame.select("u", redact.redact_url(F.col("u")).alias("r")).collect():
        assert row.r == _expected_url(row.u)


def test_urls_inside_text_keep_their_surroundings(value):
    text = "see https://h/a?sig=1&x=2, then https://h/a?sig=1&x=2y and https://h/b?x=1 end"
    out = value(redact.redact_secrets, text)
    assert out == "see https://h/a?sig=%5BREDACTED%5D&x=2%2C then https://h/a?sig=%5BREDACTED%5D&x=2y and https://h/b?x=1 end"


def test_pii_modes(value):
    text = "a.b@c.de TR330006100519786457841326 0532 123 45 67 12345678901 4111 1111 1111 1111 12345"
    masked = value(lambda c: redact.redact(c, "mask"), text)
    assert masked.count("[REDACTED:PII]") == 5 and masked.endswith(" 12345")
    assert value(redact.redact, text) == text


def test_mobile_number_across_a_line_break(value):
    assert value(redact.mask_pii, "call 0532\n123 45 67") == "call [REDACTED:PII]"


def test_nested_values(spark):
    df = spark.createDataFrame(
        [(("AKIA" + "A" * 16, 3, ["token=x", None]), {"client_secret": "s", "Note": "password=1"})],
        "s struct<a:string,n:int,l:array<string>>, m map<string,string>",
    )
    row = redact.redact_df(df, by_key=True).first()
    assert row.s.a == "[REDACTED]" and row.s.n == 3 and row.s.l == ["token=[REDACTED]", None]
    assert row.m == {"client_secret": "[REDACTED]", "Note": "password=[REDACTED]"}


def test_audit_lines_append(spark, tmp_path):
    events = spark.createDataFrame([("login", {"api_key": "k", "who": "a@b.de"})], "event string, payload map<string,string>")
    path = str(tmp_path / "audit")
    append_audit(events, path, "mask")
    append_audit(events, path, "mask")
    rows = spark.read.json(path).collect()
    assert len(rows) == 2 and rows[0].payload.api_key == "[REDACTED]" and rows[0].payload.who == "[REDACTED:PII]"
    stamp = redact_audit(events).select("timestamp").first()[0]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00", stamp)


def test_patterns_agree_with_python_on_corpus(spark):
    # the secret-free path and the gates must not change any row
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    gated = docs.select("doc_id", redact.redact_secrets(F.col("text")).alias("t"))
    plain = F.col("text")
    from seclake.vocab import BARE_SECRETS, PREFIXED_SECRETS

    for pattern, replacement, _ in PREFIXED_SECRETS:
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(replacement))
    for _, pattern, _ in BARE_SECRETS:
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit("[REDACTED]"))
    other = docs.select("doc_id", plain.alias("p"))
    assert gated.join(other, "doc_id").where("t <> p").count() == 0
