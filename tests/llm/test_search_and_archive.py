"""Nearest neighbours by recall, revisits against a plain scan, the registered queries against their SQL."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seclake.llm import ann, warc
from seclake.llm import queries as registered

DIR = "/root/testdata/sf0.001"


# -- nearest neighbours ------------------------------------------------------------------------------------
def plain_nearest(vectors, query, k):
    own = vectors[query]
    out = []
    for i, v in vectors.items():
        if i != query:
            out.append((-float(v @ own) / math.sqrt((v @ v) * (own @ own)), i))
    return sorted(out)[:k]


def test_recall_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(14)
    centres = rng.standard_normal((8, 24))
    rows = {i: centres[i % 8] + 0.6 * rng.standard_normal(24) for i in range(1200)}
    for i in range(1200, 1260):
        rows[i] = rows[40].copy()  # one vector many times
    data = [(i, [float(x) for x in v]) for i, v in rows.items()]
    odd = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] + [1.0] * 23), (2004, [None] + [1.0] * 23), (2005, [1.0]), (None, [1.0] * 24), data[7]]
    monkeypatch.setattr(ann, "CELL", (150, 150))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)  # cells are copied for blocks of queries
    frame = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    wanted = [i for i in rows if i % 50 == 0]
    queries = spark.createDataFrame([(i,) for i in wanted + [2000, 2001, 7777]], "query_id long")
    out = ann.nearest(frame, queries).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(wanted)
    hits = 0
    for q in wanted:
        expected = plain_nearest(rows, q, 5)
        assert [r["rank"] for r in got[q]] == [1, 2, 3, 4, 5]
        assert [r["vec_id"] for r in got[q]] == [i for _, i in sorted((-r["score"], r["vec_id"]) for r in got[q])]
        hits += len({i for _, i in expected} & {r["vec_id"] for r in got[q]})
        for r in got[q]:
            v, own = rows[r["vec_id"]], rows[q]
            assert r["score"] == pytest.approx(float(v @ own) / math.sqrt((v @ v) * (own @ own)), abs=1e-12)
    assert hits >= 0.9 * 5 * len(wanted)
    assert [r["vec_id"] for r in got[1200]] == [40, 1201, 1202, 1203, 1204]


def test_the_test_stops_the_search(spark, monkeypatch):
    """Separable data: most vectors are never verified, whole cells never visited; vectors without structure: half."""
    monkeypatch.setattr(ann, "CELL", (300, 300))
    rng = np.random.default_rng(15)
    centres = 4 * rng.standard_normal((40, 32))
    for rows, share in (({i: centres[i % 40] + 0.3 * rng.standard_normal(32) for i in range(3000)}, 0.1), ({i: rng.standard_normal(32) for i in range(3000)}, 0.6)):
        frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, embedding array<double>")
        queries = frame.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
        out = ann.nearest(frame, queries).collect()
        hits = sum(len({i for _, i in plain_nearest(rows, q, 5)} & {r["vec_id"] for r in out if r["query_id"] == q}) for q in range(0, 3000, 50))
        assert hits >= 0.9 * 5 * 60
        assert all(r["n_verified"] >= 5 for r in out)
        assert sum(r["n_verified"] for r in out if r["rank"] == 1) <= share * 60 * 3000


def test_few_or_no_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 2.0]), (3, [3.0, 3.0])], "vec_id long, embedding array<float>")
    ids = spark.createDataFrame([(0,), (50,)], "query_id long")
    rows = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in ann.nearest(frame, ids).collect()}
    assert rows == {(0, 1): (3, 0.707107), (0, 2): (50, 0.0), (50, 1): (3, 0.707107), (50, 2): (0, 0.0)}
    assert ann.nearest(frame.where("false"), ids).count() == 0
    assert ann.nearest(frame, ids.where("false")).count() == 0


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert ann.chi_square_quantile(0.95, 10) == pytest.approx(18.307038, abs=1e-5)


# -- revisits ---------------------------------------------------------------------------------------------
def test_canonical_urls(spark):
    same = ["HTTP://www.Example.com:80/a/b/?utm_source=x&z=1&a=2#top", "https://example.com/a/b?a=2&z=1", "https://u:p@example.com:443/a/b/?a=2&z=1&ref=q"]
    other = ["https://example.com/A/b?a=2&z=1", "https://example.com/a/b", None, "", "example.com"]
    rows = [r["c"] for r in spark.createDataFrame([(u,) for u in same + other], "u string").select(warc.canonical_url(F.col("u")).alias("c")).collect()]
    assert rows == ["example.com/a/b?a=2&z=1"] * 3 + ["example.com/A/b?a=2&z=1", "example.com/a/b", None, "", "example.com"]


RECORDS = "record_id long, url string, ts timestamp, type string, status_code int, headers array<struct<name:string,value:string>>, payload_digest string, extra int"


def plain_resolve(rows):
    out = {}
    for r in rows:
        i, url, ts, kind, code, headers, digest, _ = r
        tag = lambda h, n: next((v for k, v in reversed(h or []) if k and k.lower() == n), None)
        if kind == "response" and code == 200:
            out[i] = ("full", i, None, digest)
            continue
        if kind != "revisit":
            out[i] = ("other", None, None, None)
            continue
        earlier = [s for s in rows if url is not None and ts is not None and s[1] == url and s[2] is not None and s[3] == "response" and s[4] == 200 and (s[2], s[0]) < (ts, i)]
        if not earlier:
            out[i] = ("unmatched", None, None, None)
            continue
        s = max(earlier, key=lambda s: (s[2], s[0]))
        mine, date = tag(headers, "etag"), tag(headers, "last-modified")
        if mine is not None:
            by = "etag" if mine.removeprefix("W/") == (tag(s[5], "etag") or "-").removeprefix("W/") else None
        elif date is not None:
            by = "last_modified" if date == tag(s[5], "last-modified") else None
        else:
            by = "none"
        out[i] = ("resolved", s[0], by, s[6]) if by else ("changed", None, None, None)
    return out


def test_revisits_equal_a_plain_scan(spark):
    rng = random.Random(15)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        kind, code = rng.choice([("response", 200), ("response", 404), ("revisit", 304), ("revisit", 304), ("warcinfo", None), (None, None)])
        headers = [h for h in (("ETag", rng.choice(['"a"', 'W/"a"', '"b"'])), ("Last-Modified", rng.choice(["d1", "d2"])), ("Content-Length", str(i))) if rng.random() < 0.6]
        ts = None if rng.random() < 0.03 else start + timedelta(hours=rng.randrange(200))
        rows.append((i, rng.choice(["http://hot/x"] * 4 + ["http://b/", None]), ts, kind, code, headers if rng.random() < 0.9 else None, f"d{i}", 1))
    frame = spark.createDataFrame(rows, RECORDS)
    expected = plain_resolve(rows)
    for seconds in (3600, 86_400, 10**8):
        out = warc.resolve_revisits(frame, seconds).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r["status"], r["refers_to"], r["validated_by"], r["payload_digest"]) == expected[r["record_id"]], r
    assert warc.resolve_revisits(frame.where("false")).count() == 0


def test_headers_are_merged(spark):
    t = datetime(2024, 1, 1)
    stored = [("Content-Type", "text/html"), ("ETag", '"a"'), ("Cache-Control", "max-age=1"), ("Vary", "x")]
    fresh = [("etag", 'W/"a"'), ("cache-control", "max-age=9"), ("Content-Type", "text/plain"), ("content-length", "0"), ("Age", "3")]
    rows = [(1, "http://a/", t, "response", 200, stored, "d", 0), (2, "https://www.a", t + timedelta(days=40), "revisit", 304, fresh, None, 0)]
    out = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()}
    assert [tuple(h) for h in out[2]["headers"]] == [("age", "3"), ("cache-control", "max-age=9"), ("content-type", "text/html"), ("etag", 'W/"a"'), ("vary", "x")]
    assert out[2]["refers_to"] == 1 and out[2]["payload_digest"] == "d"


# -- queries ----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents pages benchmark labels embeddings".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    frame = registered.QUERIES[name](spark, DIR)
    columns = sorted(frame.columns)
    result = duck.execute(registered.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns

    def keyed(rows):
        return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))

    expected = keyed([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])
    assert keyed([tuple(r[c] for c in columns) for r in frame.collect()]) == expected and expected


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES) == list(range(1, 14))


def test_pipeline_keeps_clean_documents_and_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(out.toArrow(), out.schema)
    assert 0.6 * before < docs.count() < before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert last.where("copies < 1 or copies > 3").count() == 0 and last.count() > 0
