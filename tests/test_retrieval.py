import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seclake.operators import classify, dedupe, evaluation, retrieval, vector_lists
from seclake.plans.review import issue_context, retrieve_for_issues
from seclake.sources.catalogues import case_expectations
from seclake.vocab import EXTERNAL_METHODOLOGY


def vectors(spark, scope, n=60, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    data[n // 2 :: 2] = data[n // 2]  # a large group of copies
    rows = [(f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(data)]
    index = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    return data, index.select("*", *[F.lit(v).alias(k) for k, v in scope.items()])


def brute_topk(data, queries, k):
    unit = data.astype(np.float64) / np.linalg.norm(data.astype(np.float64), axis=1, keepdims=True)
    out = {}
    for name, q in queries:
        scores = unit @ (np.array(q) / np.linalg.norm(q))
        order = sorted(range(len(data)), key=lambda i: (-round(scores[i], 12), i))
        out[name] = [f"c{i:03d}" for i in order[:k]]
    return out


@pytest.mark.parametrize("count, rows", [(1, 20_000), (7, 20_000), (7, 5), (60, 3)])
def test_dense_topk_is_exact_for_any_lists(spark, scope, monkeypatch, count, rows):
    """Lists of any number, spread over tasks and asked for in blocks."""
    monkeypatch.setattr(vector_lists, "BLOCK_ROWS", rows)
    monkeypatch.setattr(vector_lists, "QUERY_ROWS", rows)
    data, index = vectors(spark, scope)
    queries = [(f"q{i}", [float(x) for x in data[i] + 0.01]) for i in range(9)] + [("copy", [float(x) for x in data[30]])]
    frame = spark.createDataFrame(queries, "query_id string, embedding array<float>")
    lists = vector_lists.CoarseLists.build(index, count)
    assert len(lists.centroids) == count
    found = retrieval.dense_topk(frame, index, scope, 3, 2, lists).collect()
    got = {}
    for row in sorted(found, key=lambda r: r.dense_rank):
        got.setdefault(row.query_id, []).append(row.chunk_id)
    expected = brute_topk(data, queries, 6)
    # copies tie exactly, so ids decide
    assert got["copy"] == expected["copy"]
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in expected.items()}
    read = vector_lists.lists_read(frame, lists, 6).collect()
    assert len(read) == 10 and all(6 <= r.vectors_read <= 60 and r.lists_read <= count for r in read)


def test_lists_out_of_reach_are_not_read(spark, scope, tmp_path):
    """Clustered vectors: a query reads its own cluster; the index as files gives the same rows."""
    rng = np.random.default_rng(4)
    centres = 10 * rng.normal(size=(20, 16))
    data = np.array([centres[i % 20] + rng.normal(size=16) * 0.2 for i in range(600)])
    rows = [(f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(data)] + [("none", None), ("zero", [0.0] * 16)]
    index = spark.createDataFrame(rows, "chunk_id string, embedding array<double>").select("*", *[F.lit(v).alias(k) for k, v in scope.items()])
    queries = [(f"q{i}", [float(x) for x in data[i] + 0.05]) for i in range(30)]
    frame = spark.createDataFrame([*queries, ("null", None)], "query_id string, embedding array<double>")
    lists = vector_lists.write_lists(index, f"{tmp_path}/index", 20)
    entries, again = vector_lists.read_lists(spark, f"{tmp_path}/index")
    assert np.allclose(lists.centroids, again.centroids) and entries.count() == 601
    found = retrieval.dense_topk(frame, entries, scope, 5, 1, again).collect()
    got = {}
    for row in found:
        got.setdefault(row.query_id, set()).add(row.chunk_id)
    assert got == {k: set(v) for k, v in brute_topk(data, queries, 5).items()}
    read = vector_lists.lists_read(frame, again, 5).collect()
    assert sum(r.lists_read for r in read) <= 0.2 * 20 * len(read)
    few = retrieval.dense_topk(frame, entries, scope, 5, 1, again, probes=1).collect()
    assert sum(r.chunk_id in got[r.query_id] for r in few) >= 0.9 * 150


def test_other_scopes_are_never_searched(spark, scope):
    _, index = vectors(spark, scope)
    foreign = index.withColumn("tenant_id", F.lit("other"))
    query = spark.createDataFrame([("q", [1.0] * 6)], "query_id string, embedding array<float>")
    assert retrieval.dense_topk(query, foreign, scope).count() == 0
    with pytest.raises(ValueError):
        retrieval.in_scope(index, {"tenant_id": "acme"})


def test_zero_vector_and_no_queries(spark, scope):
    _, index = vectors(spark, scope)
    schema = "query_id string, embedding array<float>"
    zero = retrieval.dense_topk(spark.createDataFrame([("z", [0.0] * 6)], schema), index, scope, 2, 1).collect()
    assert [r.dense_score for r in zero] == [0.0, 0.0]
    assert retrieval.dense_topk(spark.createDataFrame([], schema), index, scope).count() == 0


def test_rerank_breakdown(spark):
    chunks = spark.createDataFrame(
        [("a", "internal/x.md", "Upload", "check the upload size", "internal", None, False, "file_upload"),
         ("b", "m/y.md", "Other", "nothing shared", EXTERNAL_METHODOLOGY, 7.0, False, None),
         ("c", "t/z.template.md", "Upload", "upload", "local", None, None, None)],
        "chunk_id string, source string, title string, text string, source_type string, source_priority double, is_template boolean, security_domain string",
    )
    queries = spark.createDataFrame([("q", "secure upload")], "query_id string, query_text string")
    cands = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 1.4), ("q", "c", -1.0)], "query_id string, chunk_id string, dense_score double")
    rows = {r.chunk_id: r for r in retrieval.rerank(cands, queries, chunks).collect()}
    assert rows["a"].domain_score == 0.04 and rows["a"].lexical_score == 0.5
    assert rows["a"].score == pytest.approx(0.65 * 0.5 + 0.2 * 0.5 + 0.15 * 1.0 + 0.04)
    assert rows["b"].score == pytest.approx(0.65 + 0.15) and rows["b"].source_priority == 1.0
    assert rows["c"].source_priority == 0.15 and rows["c"].dense_score == 0.0
    assert [r.rank for r in sorted(rows.values(), key=lambda r: -r.score)] == [1, 2, 3]
    with pytest.raises(ValueError):
        retrieval.rerank(cands, queries, chunks, {"dense": 0.0, "lexical": 0.0, "source": 0.0})


def test_terms_of_a_chunk_are_taken_once_for_all_queries(spark, monkeypatch):
    """The text stays on its side of the joins; queries in blocks give the same rows."""
    chunks = spark.createDataFrame([("a", "s", "T", "check the upload size"), ("b", "s", None, None)], "chunk_id string, source string, title string, text string")
    queries = spark.createDataFrame([(i, f"secure upload {i}") for i in range(7)], "query_id int, query_text string")
    cands = spark.createDataFrame([(i, c, 0.5) for i in range(7) for c in "ab"], "query_id int, chunk_id string, dense_score double")
    whole = retrieval.rerank(cands, queries, chunks).drop("title", "query_terms")
    monkeypatch.setattr(retrieval, "_ASKED_AT_ONCE", 2)
    slim = retrieval.rerank(cands, queries, chunks, texts=False)
    assert "text" not in slim.columns and slim.count() == 14
    assert sorted(map(str, whole.withColumn("n_chars", F.length("text")).select(slim.columns).collect())) == sorted(map(str, slim.collect()))


def test_packing_reads_the_ranks_once(spark):
    """Carried rows equal the joined ones; one scan of the ranks in the plan."""
    rows = [(g, r, f"s{r % 3}", 10 * r % 50, f"{g}{r}") for g in ("I", "J", None) for r in range(1, 30)]
    ranked = spark.createDataFrame(rows, "issue_key string, rank int, source string, n int, chunk_id string")
    plain = retrieval.pack_context(ranked, max_chars=120, length="n")
    carried = retrieval.pack_context(ranked, max_chars=120, length="n", carried=True)
    assert sorted(carried.collect()) == sorted(plain.select(carried.columns).collect()) and carried.count() > 4
    plan = carried._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    fused = retrieval.fuse(ranked.select("issue_key", "rank", "chunk_id", (1 / F.col("rank")).alias("score"), F.lit(0).alias("query_no")))
    once = retrieval.fuse(ranked.select("issue_key", "rank", "chunk_id", (1 / F.col("rank")).alias("score"), F.lit(0).alias("query_no")), gathered=True)
    assert sorted(map(str, once.select(fused.columns).collect())) == sorted(map(str, fused.collect()))
    assert "Join" not in once._jdf.queryExecution().executedPlan().toString()


def test_the_sample_bounds_what_is_read(spark, scope):
    """Vectors of the index that are known when the search is planned rule lists out; the rows stay the same."""
    from dataclasses import replace

    rng = np.random.default_rng(3)
    data = [[float(x) for x in v] for v in rng.normal(size=(400, 3))]
    index = spark.createDataFrame([(f"c{i:03d}", v) for i, v in enumerate(data)], "chunk_id string, embedding array<double>")
    index = index.select("*", *[F.lit(v).alias(k) for k, v in scope.items()])
    frame = spark.createDataFrame([(i, data[i]) for i in range(20)], "query_id int, embedding array<double>")
    lists = vector_lists.CoarseLists.build(index, 10)
    assert len(lists.some) == 400
    blind = replace(lists, some=None)
    got = [sorted(retrieval.dense_topk(frame, index, scope, 4, 1, x).collect()) for x in (lists, blind)]
    assert got[0] == got[1] and len(got[0]) == 80
    read = [sum(r.vectors_read for r in vector_lists.lists_read(frame, x, 4).collect()) for x in (lists, blind)]
    assert read[0] < read[1]


def test_search_in_two_steps_is_exact(spark, scope, monkeypatch):
    """More vectors than the sample holds: the nearest list bounds the others; copies, vectors and queries without a direction, repeated query ids."""
    from dataclasses import replace

    monkeypatch.setattr(vector_lists, "CELL", 4)
    monkeypatch.setattr(vector_lists, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(600, 3))
    data[300:400] = data[100:200]
    data[7] = 0
    index = spark.createDataFrame([(f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(data)], "chunk_id string, embedding array<double>")
    index = index.select("*", *[F.lit(v).alias(k) for k, v in scope.items()])
    asked = [(i, [float(x) for x in data[i]]) for i in range(40)] + [(100, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0])]
    frame = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    lists = vector_lists.CoarseLists.build(index, 10)
    few = replace(lists, some=lists.some[:20])
    got = [sorted(retrieval.dense_topk(frame, index, scope, 3, 2, x).collect(), key=str) for x in (few, replace(lists, some=None))]
    assert [r[:2] + r[3:] for r in got[0]] == [r[:2] + r[3:] for r in got[1]] and len(got[0]) == 42 * 6
    assert np.allclose([r.dense_score for r in got[0]], [r.dense_score for r in got[1]], atol=1e-11)
    near = lists.nearest(vector_lists.unit_rows(frame.where("query_id < 40 and query_id <> 7").toArrow()["embedding"]), 1)[0]
    assert (near.sum(1) == 1).all()


def test_a_query_is_compared_with_few_cells():
    rng = np.random.default_rng(6)
    units = rng.normal(size=(20_000, 4))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    queries, floor, ids = units[::50], np.full(400, -2.0), np.arange(len(units))
    cells = vector_lists._Cells.of(units)
    assert sorted(cells.rows[cells.rows >= 0].tolist()) == ids.tolist()
    assert len(cells.hits(queries, floor, 24)[0]) < 0.01 * 400 * 20_000
    reach = np.sort(queries @ units.T, axis=1)[:, -24]
    assert (cells.away(queries) <= np.sqrt(2 - 2 * reach)[:, None]).mean() < 0.05
    query, score, row = vector_lists._best(queries, floor, units, ids, 24)
    scores = np.round(queries @ units.T, 12)
    for q in range(0, 400, 13):
        expected = np.lexsort((ids, -scores[q]))[:24]
        assert row[query == q].tolist() == expected.tolist() and np.allclose(score[query == q], scores[q][expected], atol=1e-11)


def test_each_text_is_embedded_once(spark, scope, tmp_path):
    """The vectors of queries and chunks are read several times, but made once."""
    import pandas as pd

    def embed(texts):
        with open(tmp_path / "texts", "a") as out:
            out.writelines(f"{x!r}\n" for x in texts)
        return pd.Series([[float(len(x)), 1.0] for x in texts], index=texts.index)

    issues = spark.createDataFrame(
        [(f"I-{i}", f"token login {i}", "session", None, [], [], [f"note {i}"]) for i in range(3)],
        "key string, summary string, description string, acceptance_criteria string, labels array<string>, components array<string>, comments array<string>",
    )
    pages = spark.createDataFrame([("I-1", 0, "Page", "body")], "issue_key string, position int, title string, body_text string")
    index = spark.createDataFrame([(f"c{i}", f"s{i % 2}", "t", "text " * (i + 1)) for i in range(8)], "chunk_id string, source string, title string, text string")
    index = retrieval.embed_chunks(index.select("*", *[F.lit(v).alias(k) for k, v in scope.items()]), embed, 2)
    rows = issue_context(issues, pages, index, scope, embed, 2).collect()
    assert {r.issue_key for r in rows} == {"I-0", "I-1", "I-2"}
    texts = (tmp_path / "texts").read_text().splitlines()
    assert len([x for x in texts if x.startswith("'text ")]) == 8
    assert max(texts.count(x) for x in texts if "token login" in x) == 1


def test_fusion_keeps_best_and_earliest(spark):
    rows = [("I", "c", 0, 0.5), ("I", "c", 1, 0.9), ("I", "c", 2, 0.9), ("I", "d", 1, 0.7)]
    fused = retrieval.fuse(spark.createDataFrame(rows, "issue_key string, chunk_id string, query_no int, score double"))
    assert [(r.chunk_id, r.query_no, r["rank"]) for r in fused.orderBy("rank").collect()] == [("c", 1, 1), ("d", 1, 2)]


def test_ranks_without_a_limit_in_pieces(spark):
    """Ranks equal a plain sort; ties, scores of 0 and 1, nulls; no task numbers a whole group."""
    rng = random.Random(9)
    rows = [("I", i, round(rng.random(), 2), rng.randrange(3)) for i in range(400)] + [("I", 500, 1.0, 0), ("I", 501, 0.0, 0), ("I", 502, None, 0), (None, 1, 0.5, 0)]
    frame = spark.createDataFrame(rows, "issue_key string, chunk_id int, score double, query_no int")
    got = {(r.issue_key, r.chunk_id): r["rank"] for r in dedupe.ranked_by_score(frame, ["issue_key"], "score", ["query_no", "chunk_id"]).collect()}
    mine = sorted([r for r in rows if r[0]], key=lambda r: (r[2] is None, -(r[2] or 0), r[3], r[1]))
    assert got == {**{("I", r[1]): i + 1 for i, r in enumerate(mine)}, (None, 1): 1}
    plan = dedupe.ranked_by_score(frame, ["issue_key"], "score", ["query_no", "chunk_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(issue_key" in plan and "step" in plan.split("row_number() windowspecdefinition(issue_key")[1][:60]


def brute_pack(items, budget, quota):
    used, taken, per = 0, [], {}
    for rank, source, text in items:
        if per.get(source, 0) < quota and used + len(text) <= budget:
            taken.append(rank)
            used += len(text)
            per[source] = per.get(source, 0) + 1
    return taken


def test_packing_matches_a_greedy_walk(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for g in range(30):
        items = [(i + 1, f"s{rng.randrange(3)}", "x" * rng.randrange(1, 60)) for i in range(rng.randrange(1, 20))]
        expected[f"g{g}"] = brute_pack(items, 150, 3)
        rows += [(f"g{g}", *item) for item in items]
    frame = spark.createDataFrame(rows, "issue_key string, rank int, source string, text string")
    got = {}
    for row in retrieval.pack_context(frame, max_chars=150).orderBy("rank").collect():
        got.setdefault(row.issue_key, []).append(row["rank"])
    assert got == {k: v for k, v in expected.items() if v}


def test_compact_context_stops_at_first_misfit(spark):
    rows = [("I", i, f"c{i}", "s", "t", "q" * n, 1.0, "local") for i, n in enumerate([100, 5000, 10])]
    frame = spark.createDataFrame(
        rows, "issue_key string, rank int, chunk_id string, source string, title string, text string, score double, source_type string"
    )
    small = retrieval.compact_context(frame, max_chars=600).orderBy("item_no").collect()
    assert [r.item_no for r in small] == [0]
    single = retrieval.compact_context(frame.where("rank = 1"), max_chars=600).collect()
    assert len(single) == 1 and "[truncated]" in single[0].item and single[0].item.count("q") == 300
    roomy = retrieval.compact_context(frame, max_chars=12000).collect()
    assert len(roomy) == 3 and max(r.item.count("q") for r in roomy) == 1200


def test_attach_vectors_fails_on_gaps(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    good = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    assert retrieval.attach_vectors(chunks, good, 2).count() == 2
    for bad in (good.where("chunk_id = 'a'"), good):
        with pytest.raises(Exception, match="vector"):
            retrieval.attach_vectors(chunks, bad, 2 if bad is not good else 3).collect()


def test_embedding_callback(spark):
    chunks = spark.createDataFrame([("a", "xy"), ("b", "xyz")], "chunk_id string, text string")
    import pandas as pd

    out = retrieval.embed_chunks(chunks, lambda s: pd.Series([[float(len(t)), 1.0] for t in s]), 2).orderBy("chunk_id").collect()
    assert [r.embedding for r in out] == [[2.0, 1.0], [3.0, 1.0]]
    with pytest.raises(Exception, match="dimension mismatch"):
        retrieval.embed_chunks(chunks, lambda s: pd.Series([[1.0] for _ in s]), 2).collect()


def test_facets_and_fallback(value):
    got = value(classify.facet_array, "The Maker checker approves; POST /pay/{id} needs userId. roles, logout!")
    facets = {f.type: f.terms for f in got}
    shared = ["POST /pay/{id}", "userId"]
    assert facets["authorization"] == ["checker", "maker", *shared]
    assert facets["business_logic"] == ["maker checker", *shared]
    assert facets["authentication_session"] == ["logout", *shared]
    only = value(classify.facet_array, "see accountId")
    assert [(f.type, f.terms) for f in only] == [("api_surface", ["accountId"])]
    assert value(classify.facet_array, "nothing") == []


def test_facet_words_are_whole_words(value):
    assert value(classify.facet_array, "logs filed profiled émaker field-levels") == []
    assert [f.type for f in value(classify.facet_array, "a field-level rule")] == ["graphql_api"]


def test_domains_order_and_default(value):
    path, title = F.lit("pentesting-web/jwt-attacks.md"), F.lit("JWT")
    got = value(lambda c: classify.domains_of(path, title, c), "json web token jws and oauth")
    assert got == ["jwt", "oauth"]
    assert value(lambda c: classify.domains_of(F.lit("a.md"), F.lit("b"), c), "zzz") == ["general_web_security"]
    curated = classify.domain_keywords(True)
    assert curated["jwt"] == ["jwt", "json web token"] and curated["xss"] == ["xss", "cross-site scripting"]


def test_query_domains_and_option(value):
    got = value(classify.query_domains, "file upload with oidc role")
    assert set(got) == {"file_handling", "file_upload", "oauth", "authorization"}
    mapped = value(lambda c: classify.query_domains(c, facet_domains=classify.FACET_DOMAINS), "role")
    assert "access_control" in mapped


def test_evaluation_metrics(spark):
    cases = spark.createDataFrame(
        [("full", "q", ["internal/a", "missing"], ["internal", "owasp"], ["jwt"], ["bad"]), ("none", "q", [], [], [], []),
         ("banned", "q", [], [], [], ["internal"])],
        "case_id string, query string, expected_sources array<string>, expected_source_types array<string>, expected_security_domains array<string>, forbidden_sources array<string>",
    )
    results = spark.createDataFrame(
        [("full", 1, "x/bad.md", EXTERNAL_METHODOLOGY, ["xss"]), ("full", 2, "internal/a.md", "internal", ["jwt"]),
         ("full", 3, "internal/ab.md", "internal", None), ("banned", 1, "internal/z.md", "internal", None)],
        "case_id string, rank int, source string, source_type string, security_domains array<string>",
    )
    out = {r.case_id: r for r in evaluation.evaluate_retrieval(results, cases, case_expectations(cases)).collect()}
    full = out["full"]
    assert (full.recall_at_k, full.mrr, full.source_type_coverage) == (0.5, 0.5, 0.5)
    assert full.precision_at_k == pytest.approx(2 / 3) and full.security_domain_coverage == 1.0
    assert full.false_positive_source_rate == 1.0 and full.internal_before_external_guidance is False
    assert (full.hits, full.misses, full.retrieved_sources) == (["internal/a"], ["missing"], ["x/bad.md", "internal/a.md", "internal/ab.md"])
    assert full.source_type_hits == ["internal"] and full.security_domain_hits == ["jwt"] and full.forbidden_source_hits == ["bad"]
    assert full.retrieved_security_domains == ["jwt", "xss"] and out["none"].hits == [] and out["none"].retrieved_sources == []
    none = out["none"]
    assert (none.recall_at_k, none.precision_at_k, none.mrr, none.false_positive_source_rate) == (1.0, 0.0, 0.0, 0.0)
    assert out["banned"].false_positive_source_rate == 1.0 and none.internal_before_external_guidance


def test_neutral_summary(spark):
    empty = spark.createDataFrame([], "case_id string, recall_at_k double, precision_at_k double, mrr double, source_type_coverage double, security_domain_coverage double, false_positive_source_rate double, internal_before_external_guidance boolean")
    row = evaluation.summarize_eval(empty).first()
    assert row.mean_recall_at_k == 1.0 and row.mean_false_positive_source_rate == 0.0
    assert row.internal_before_external_guidance_rate == 1.0 and row.cases == 0


def test_issue_retrieval_end_to_end(spark, scope):
    data, index = vectors(spark, scope, n=20)
    index = index.select("*", F.concat(F.lit("s/"), "chunk_id").alias("source"), F.lit("t").alias("title"), F.lit("body text").alias("text"), F.lit("local").alias("source_type"))
    queries = spark.createDataFrame(
        [("I", 0, "token=abc body", [float(x) for x in data[3]]), ("I", 1, "other", [float(x) for x in data[4]])],
        "issue_key string, query_no int, query_text string, embedding array<float>",
    )
    rows = retrieve_for_issues(queries, index, scope, k=4, max_chars=36).orderBy("rank").collect()
    assert len(rows) == 4 and rows[0].chunk_id == "c003" and all(len(r.text) == 9 for r in rows)
