import json

import pytest
from pyspark.sql import functions as F

from seclake.operators import catalog
from seclake.operators.chunking import chunk_documents, split_documents
from seclake.plans import index as plans
from seclake.plans import snapshots
from seclake.sources import captures, catalogues, files, sinks, trackers
from seclake.sources.captures import scan_app_facts
from seclake.streaming.jobs import audit_counts, index_batch, start_audit, start_indexing


def put(root, **content):
    for name, data in content.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data if isinstance(data, bytes) else data.encode())


def lay(root, files_):
    put(root, **files_)
    return str(root)


def test_document_scan_dispositions(spark, tmp_path):
    root = lay(tmp_path, {
        "a.md": "# A", "sub/b.TXT": "b", "c.json": "{}", "d.pdf": "x", ".git/e.md": "x", "sub/dist/f.md": "x", "dist.md": "ok",
        "bad.txt": b"\xff\xfe\x00", "big.md": b"x" * (1024 * 1024 + 1), "with space.md": "s",
    })
    docs, dispositions = files.scan_documents(spark, root, max_mb=1)
    assert sorted(r.path for r in docs.collect()) == ["a.md", "c.json", "dist.md", "sub/b.TXT", "with space.md"]
    counts = {r.disposition: r["count"] for r in dispositions.groupBy("disposition").count().collect()}
    assert counts == {"accepted": 5, "unsupported": 1, "oversized": 1, "not_utf8": 1}
    _, capped = files.scan_documents(spark, root, max_mb=1, max_files=2)
    kept = {r.path: r.disposition for r in capped.where("disposition in ('accepted', 'not_utf8')").collect()}
    assert kept == {"a.md": "accepted", "bad.txt": "not_utf8"}  # the cap counts files before they are read
    assert capped.where("disposition = 'over_limit'").count() == 4


def test_index_report_counts(spark, tmp_path):
    root = lay(tmp_path, {"internal/a.md": "# A\nx\n# A\nx", "owasp/b.md": "# B\ny", "c.bin": "z"})
    docs, dispositions = files.scan_documents(spark, root)
    row = plans.index_report(split_documents(docs), dispositions, dry_run=True).first()
    assert (row.files_scanned, row.files_accepted, row.files_skipped, row.chunks_created, row.duplicate_chunks) == (3, 2, 1, 2, 1)
    assert row.source_type_distribution == {"internal": 1, "owasp": 1} and row.dry_run and row.embedding_batches == 1


def test_nested_batches(spark):
    out = spark.range(0, 300, 7).select("id", plans.nested_batches(F.col("id"), 32, 10).alias("b")).collect()
    for row in out:
        sizes = [min(32, row.id - at) for at in range(0, row.id, 32)]
        assert row.b == sum(-(-s // 10) for s in sizes)


def test_globs(spark):
    paths = ["x/src/my-API-guide.md", "graphql.md", "a/forensics/oauth.md", "pentesting-web/deep/x.md", "a/pentesting-web/deep/x.md", "misc/x.md", "todo/x/api.md", "z/todo/api.md"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    import fnmatch
    from pathlib import PurePosixPath

    from seclake.vocab import CURATED_ALLOW, CURATED_EXCLUDE

    def base(pattern):
        while pattern.startswith("**/"):
            pattern = pattern[3:]
        return pattern

    for patterns in (CURATED_ALLOW, CURATED_EXCLUDE):
        for row in frame.select("p", catalog.glob_match(F.col("p"), patterns).alias("m")).collect():
            low = row.p.lower()
            assert row.m == any(fnmatch.fnmatchcase(low, q.lower()) or fnmatch.fnmatchcase(PurePosixPath(low).name, base(q.lower())) for q in patterns), row.p


def test_preset_match_is_exact_or_probe(spark):
    paths = ["Server Side Request Forgery/README.md", "a/server side request forgery/x.md", "x/README.md", "docs/a/b.md", "Document/x.md", "a/Document/x.md", "Document/deep/x.md"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    from seclake.vocab import IMPORT_PRESETS

    def hits(preset):
        return {r.p for r in frame.where(catalog.preset_match(F.col("p"), IMPORT_PRESETS[preset]["allow"])).collect()}

    assert hits("payloads") == {paths[0], paths[1]}
    assert hits("owasp-api") == {"docs/a/b.md"}
    assert hits("owasp-masvs") >= {"Document/x.md", "a/Document/x.md"}


LONG = " ".join(f"word{i}" for i in range(60))


def test_curated_documents_and_chunks(spark, tmp_path, scope):
    body = f"# Attack\n{LONG} ssrf webhook\n## Social\nfollow us"
    root = lay(tmp_path, {
        "pentesting-web/ssrf.md": body, "a/ssrf-copy.md": body, "a/forensics/ssrf.md": body, "a/other.md": body, "a/jwt.md": "tiny",
    })
    docs = files.scan_markdown(spark, root)
    states = {r.relative_path: r.disposition for r in catalog.curated_dispositions(docs).collect()}
    assert states == {"pentesting-web/ssrf.md": "accepted", "a/ssrf-copy.md": "accepted", "a/forensics/ssrf.md": "excluded",
                      "a/other.md": "not_allowed", "a/jwt.md": "too_short"}
    chunks = catalog.chunk_curated(catalog.select_by_globs(docs), scope=scope, version="v1").collect()
    assert len(chunks) == 1  # the copy has the same normalised text
    (chunk,) = chunks
    assert chunk.text.startswith("Title: Attack\nSection: Attack\n\nContent:\n# Attack word0") and "follow us" not in chunk.text
    assert (chunk.security_domain, chunk.source, chunk.chunk_index, chunk.version) == ("ssrf", "curated:a/ssrf-copy.md", 0, "v1")


def test_markdown_import_collisions(spark):
    import hashlib

    docs = spark.createDataFrame(
        [("docs/A b.md", f"---\nx: 1\n---\n# One\n{LONG}"), ("docs/a-b.md", LONG), ("docs/A_b!.md", LONG), ("docs/a b.md", LONG), ("docs/few.md", "x"), ("docs/LICENSE", LONG), ("src/x.md", LONG), ("docs/CONTRIBUTING.md", LONG)],
        "relative_path string, text string",
    )
    states = catalog.import_dispositions(docs, "owasp-api")
    report = catalog.import_report(states, "owasp-api").first()
    assert (report.files_scanned, report.files_written, report.files_skipped) == (7, 4, 3)
    rows = {r.relative_path: r for r in catalog.import_markdown(docs, "owasp-api").collect()}
    digest = hashlib.sha256(b"owasp-api/docs/a-b.md").hexdigest()[:8]
    assert rows["docs/A b.md"].destination == "owasp-api/docs/a-b.md"
    assert rows["docs/a b.md"].destination == f"owasp-api/docs/a-b-{digest}.md"
    assert rows["docs/a-b.md"].destination == f"owasp-api/docs/a-b-{digest}-2.md"
    assert rows["docs/A b.md"].text.startswith("# One\n\n- Source: OWASP API Security\n") and "x: 1" not in rows["docs/A b.md"].text


def test_catalogue_scans(spark, tmp_path):
    csv, xml = tmp_path / "c.csv", tmp_path / "c.xml"
    csv.write_text('﻿ID, Name ,Description,Extended Description\n79,XSS," a, ""b""\nc ",\n5,Other,nothing,\n6,Login,authentication gap,more\n')
    records = catalogues.scan_catalog_csv(spark, str(csv))
    found = {r.record["ID"]: r.record for r in catalog.relevant_records(records).collect()}
    assert set(found) == {"79", "6"} and found["79"]["Name"] == "XSS" and found["79"]["Description"] == 'a, "b"\nc'
    text = {r.identifier: r.text for r in catalog.catalog_to_markdown(catalog.relevant_records(records), "MITRE CWE", "mitre-cwe").collect()}
    assert text["79"] == '# MITRE CWE - 79: XSS\n\n- Source: MITRE CWE\n- Source ID: 79\n\n## Description\n\na, "b" c\n'
    xml.write_text(
        '<c:Cat xmlns:c="urn:x"><c:Attack_Pattern ID="9" Name="Session" Status="Draft"><c:Description>use <b>the</b> session &amp; go</c:Description>'
        '<c:Typical_Severity>High</c:Typical_Severity></c:Attack_Pattern><c:Attack_Pattern ID="8" Name="None"/></c:Cat>'
    )
    rows = {r.record["ID"]: r.record for r in catalogues.scan_catalog_xml(spark, str(xml), "Attack_Pattern").collect()}
    assert rows["9"]["Description"] == "use the session & go" and rows["9"]["Typical Severity"] == "High"
    assert "Description" not in rows["8"] and rows["8"]["Abstraction"] == ""


def test_eval_case_scan(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([{"query": "a", "must_retrieve": ["x"]}, {"query": "b", "expected_sources": ["y"], "forbidden_sources": ["z"]}, {"query": "c"}]))
    rows = {r.query: r for r in catalogues.scan_eval_cases(spark, str(path)).collect()}
    assert rows["a"].expected_sources == ["x"] and rows["b"].forbidden_sources == ["z"] and rows["c"].expected_sources == []


def test_issue_scan(spark, tmp_path):
    rich = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Acceptance criteria: x"}]}]}
    rows = [
        {"key": "A-1", "fields": {"summary": "S", "description": rich, "issuetype": {"name": "Story"}, "labels": ["l"], "cf_1": "own",
                                  "components": [{"name": "c"}, {}], "comment": {"comments": [{"body": "hi"}, {"body": rich}, {}]}}},
        {"key": "A-2", "fields": {"summary": None}},
    ]
    path = tmp_path / "issues.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    out = {r.key: r for r in trackers.scan_issues(spark, str(path)).collect()}
    first = out["A-1"]
    assert (first.description, first.acceptance_criteria, first.issue_type) == ("Acceptance criteria: x", "Acceptance criteria: x", "Story")
    assert (first.comments, first.components, first.labels) == (["hi", "Acceptance criteria: x"], ["c"], ["l"])
    assert out["A-2"].summary == "" and out["A-2"].comments == [] and out["A-2"].data_error is None
    own = {r.key: r for r in trackers.scan_issues(spark, str(path), acceptance_field="cf_1").collect()}
    assert own["A-1"].acceptance_criteria == "own" and "cf_1" in own["A-2"].data_error


def test_page_scan(spark, tmp_path):
    rows = [
        {"id": 5, "title": "", "body": {"storage": {"value": ""}, "view": {"value": "<p>v</p>"}}, "space": {"key": "K"}, "_links": {"webui": "/x", "base": "https://h/wiki/"}},
        {"id": "6", "title": "T", "body": {"storage": {"value": "<p>a<br>b</p>"}}},
    ]
    path = tmp_path / "pages.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    out = {r.id: r for r in trackers.scan_pages(spark, str(path)).collect()}
    assert (out["5"].title, out["5"].url, out["5"].space_key, out["5"].body_text) == ("Confluence page 5", "https://h/wiki/x", "K", "v")
    assert out["6"].body_text == "a\nb" and out["6"].url is None


def test_fact_scan(spark, tmp_path):
    (tmp_path / "apps").mkdir()
    (tmp_path / "apps" / "a.json").write_text('{"app_id": "a", "debuggable": true}')
    facts = scan_app_facts(spark, str(tmp_path), tables=["apps"])
    assert facts["apps"].first().debuggable is True and facts["apps"].first().allow_backup is None


@pytest.fixture
def rows(spark, scope):
    def make(items, version="old", **over):
        values = {**scope, **over}
        return spark.createDataFrame(
            [(f"{d}#{i}", d, version, "local", "internal", root) for d, root, n in items for i in range(n)],
            "chunk_id string, document_id string, version string, source_name string, source_type string, index_root string",
        ).select("*", *[F.lit(v).alias(k) for k, v in values.items()])

    return make


def state(df):
    return sorted((r.chunk_id, r.version, r.tenant_id) for r in df.collect())


def test_upsert_sets_the_scope(rows, scope):
    out = plans.upsert_chunks(rows([("d", "r", 2)]), rows([("d", "r", 1)], "new", tenant_id="evil"), scope)
    assert state(out) == [("d#0", "new", "acme"), ("d#1", "old", "acme")]


def test_replace_stays_inside_scope_and_filters(spark, rows, scope):
    index = rows([("d", "r", 3), ("e", "r", 1), ("gone", "r", 1)]).unionByName(rows([("gone", "r", 1)], "other", tenant_id="other"))
    read = spark.createDataFrame([("d",), ("gone",)], "document_id string")
    out = plans.replace_documents(index, rows([("d", "r", 1)], "new"), scope, read)
    assert state(out) == [("d#0", "new", "acme"), ("e#0", "old", "acme"), ("gone#0", "other", "other")]
    kept = plans.replace_documents(index, rows([("x", "r", 1)], "new"), scope, read, source_type="owasp")
    assert kept.count() == index.count() + 1


def test_sync_and_its_guard(rows, scope):
    index = rows([("d", "r1", 1), ("e", "r2", 1)])
    out = plans.sync_root(index, rows([("n", "r1", 1)], "new"), scope, "r1", 1)
    assert [s[0] for s in state(out)] == ["e#0", "n#0"]
    assert plans.sync_root(index, index.limit(0), scope, "r1", 0).count() == 2


def test_index_log_on_disk(spark, rows, scope, tmp_path):
    path, target = str(tmp_path / "log"), str(tmp_path / "compact")
    assert plans.read_index(spark, path) is None
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "document_id string")
    plans.write_change(rows([("d", "r", 3), ("e", "r", 1)]), ids("d", "e"), scope, path, 0)
    plans.write_change(rows([("d", "r", 1)], "new"), ids("d"), scope, path, 1)
    plans.write_change(rows([("d", "r", 1)], "new"), ids("d"), scope, path, 1)  # a retry
    expected = [("d#0", "new", "acme"), ("e#0", "old", "acme")]
    assert state(plans.read_index(spark, path)) == expected
    counts = plans.change_counts(spark, path)
    assert [(r.seq, r.chunks_upserted, r.documents_replaced) for r in counts.orderBy("seq").collect()] == [(0, 4, 2), (1, 1, 1)]
    assert plans.sync_change(spark, rows([("n", "r", 1)], "new"), ids("n"), scope, path, 2, "r", 1)
    assert [s[0] for s in state(plans.read_index(spark, path))] == ["n#0"]
    assert not plans.sync_change(spark, rows([]), ids(), scope, path, 3, "r", 0)
    plans.compact_index(spark, path, target)
    assert state(plans.read_index(spark, target)) == state(plans.read_index(spark, path))
    with pytest.raises(ValueError):
        plans.write_change(rows([("d", "r", 1)]), ids("d"), scope, path, 1, change="another")
    assert plans.write_change(rows([("d", "r", 1)], "later"), ids("d"), scope, path, change="x") == 4
    assert plans.write_change(rows([("d", "r", 1)], "later"), ids("d"), scope, path, change="x") == 4
    assert ("d#0", "later", "acme") in state(plans.read_index(spark, path))


def test_upsert_keeps_one_row_per_chunk(rows, scope):
    index = rows([("d", "r", 1)])
    new = rows([("d", "r", 1)], "new").unionByName(rows([("d", "r", 1)], "newer"))
    assert [s[:2] for s in state(plans.upsert_chunks(index, new, scope))] == [("d#0", "new")]


def test_incremental_indexing_stream(spark, scope, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "cp")
    source.mkdir()
    (source / "1.json").write_text('{"path": "a.md", "text": "# A\\none"}\n{"path": "b.md", "text": "# B\\ntwo"}')
    apply = index_batch(scope, path)

    def run():
        stream = spark.readStream.schema("path string, text string").json(str(source))
        start_indexing(stream, checkpoint, apply).awaitTermination()
        return sorted(r.text for r in plans.read_index(spark, path).collect())

    assert run() == ["# A one", "# B two"]
    (source / "2.json").write_text('{"path": "a.md", "text": "# A\\nchanged"}')
    assert run() == ["# A changed", "# B two"]
    # a fresh checkpoint on a filled log, and a document twice in one batch
    (source / "3.json").write_text('{"path": "a.md", "text": "# A\\nfirst"}\n{"path": "a.md", "text": "# A\\nlast"}')
    for name in ("1.json", "2.json"):
        (source / name).write_text("")
    checkpoint = str(tmp_path / "fresh")
    assert run() == ["# A last", "# B two"]
    batch = chunk_documents(spark.createDataFrame([("a.md", "# A\nlast")], "path string, text string"), scope=scope).first()
    assert batch.chunk_id in {r.chunk_id for r in plans.read_index(spark, path).collect()}


def test_audit_stream_and_counts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text('{"ts": "2024-01-01T00:10:00Z", "event": "login", "payload": {"password": "x", "n": "token=1"}}\n' * 3)
    stream = spark.readStream.schema("ts timestamp, event string, payload map<string,string>").json(str(source))
    start_audit(stream, out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.json(out).collect()
    assert len(rows) == 3 and rows[0].payload.password == "[REDACTED]" and rows[0].payload.n == "token=[REDACTED]"
    counts = audit_counts(spark.read.schema("ts timestamp, event string").json(str(source))).collect()
    assert [(c.event, c.n) for c in counts] == [("login", 3)]
    query = audit_counts(stream.select("ts", "event")).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").first().n == 3


def test_report_sink(spark, tmp_path):
    path = str(tmp_path / "r")
    sinks.write_report(spark.createDataFrame([(1, None)], "a int, b string"), path)
    assert spark.read.text(path).first().value == '{"a":1,"b":null}'


def test_snapshots_follow_every_kind_of_change(spark, scope, tmp_path):
    """After each run the index is that of the listing; a repeated run changes nothing, also when it died before its manifest."""
    import shutil

    index, manifest = str(tmp_path / "log"), str(tmp_path / "manifest")
    versions = [
        {"a.md": "# A\none", "b.md": "# B\ntwo", "c.md": "# C\nthree", "e.md": ""},
        {"a.md": "# A\nchanged", "b.md": "", "d.md": "# D\nfour", "e.md": ""},
        {"a.md": "# A\nchanged", "b.md": "# B\nagain", "d.md": "# D\nfour"},
    ]
    expected = [
        {"added": 4}, {"changed": 1, "emptied": 1, "removed": 1, "added": 1, "unchanged": 1}, {"unchanged": 2, "changed": 1, "removed": 1},
    ]

    def frame(files):
        return spark.createDataFrame(list(files.items()), "path string, text string")

    def texts():
        return sorted((r.chunk_id, r.text) for r in plans.read_index(spark, index).collect())

    for no, (files, states) in enumerate(zip(versions, expected)):
        run = snapshots.index_snapshot(frame(files), index, manifest, scope)
        assert run.version == no and {k: n for k, n in run.states.items() if n} == states
        whole = chunk_documents(frame({p: t for p, t in files.items() if t}), scope=scope)
        assert texts() == sorted((r.chunk_id, r.text) for r in whole.collect())
        again = snapshots.index_snapshot(frame(files), index, manifest, scope)
        assert again.version == no and again.states["unchanged"] == len(files)
    shutil.rmtree(f"{manifest}/version=2")  # as if the run had died before its manifest
    before = texts()
    assert snapshots.index_snapshot(frame(versions[2]), index, manifest, scope).version == 2 and texts() == before
    with pytest.raises(ValueError):
        snapshots.index_snapshot(frame(versions[0]).where("false"), index, manifest, scope)
    assert texts() == before


def test_catalogue_columns_and_encodings(spark):
    texts = {"utf8": "né".encode(), "bom": b"\xef\xbb\xbf" + "né".encode(), "wide": b"\xff\xfe" + "né".encode("utf-16-le"), "big": b"\xfe\xff" + "né".encode("utf-16-be"), "latin": "né".encode("latin-1"), "empty": b"", "none": None}
    frame = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in texts.items()], "k string, content binary")
    got = {r.k: r.t for r in frame.select("k", catalogues.decode_text(F.col("content")).alias("t")).collect()}
    assert got == {**{k: "né" for k in texts}, "empty": "", "none": None}
    lines = spark.createDataFrame([(1, '1, "a ""b""",'), (2, "1,2"), (3, "1,2,3,4"), (4, '1,"open,3'), (5, None), (6, "﻿1,x,y"), (7, '"a\nb",c,d')], "n int, value string")
    rows = {r.n: r for r in catalogues.parse_catalog_csv(lines, ["﻿ID", " Name", "Kind "]).collect()}
    assert [n for n in rows if rows[n].broken] == [2, 3, 4, 5] and rows[1].record["Kind"] == ""
    assert rows[6].record == {"ID": "1", "Name": "x", "Kind": "y"} and rows[7].record["ID"] == "a\nb"
    xml = spark.createDataFrame([(1, '<c:W xmlns:c="x" ID="7"><c:Description>a <b>b</b></c:Description></c:W>'), (2, "<W ID="), (3, None), (4, "<W/>")], "n int, value string")
    found = {r.n: r for r in catalogues.parse_catalog_xml(xml).collect()}
    assert found[1].record["ID"] == "7" and found[1].record["Description"] == "a b" and [n for n in found if found[n].broken] == [2, 3]
    flows = spark.createDataFrame([(1, '{"seq": 3, "url": "u"}'), (2, "{"), (3, None), (4, '{"seq": "x"}')], "n int, value string")
    assert [(r.n, r.broken, r.seq) for r in captures.parse_flows(flows).orderBy("n").collect()] == [(1, False, 3), (2, True, None), (3, True, None), (4, True, None)]
