import html.parser
import random
import uuid

import pytest
from pyspark.sql import functions as F

from seclake.functions import documents as D
from seclake.functions import ids
from seclake.operators import chunking as C
from seclake.operators import dedupe


def brute_windows(words, size, overlap):
    out, step = [], max(size - overlap, 1)
    for start in range(0, len(words), step):
        out.append(" ".join(words[start : start + size]))
        if start + size >= len(words):
            break
    return out


@pytest.mark.parametrize("size,overlap", [(1, 0), (5, 2), (7, 6), (4, 4), (3, 9)])
def test_windows_cover_every_word(spark, size, overlap):
    texts = [" \n".join(f"w{i}" for i in range(n)) for n in range(0, 40)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", C.window_texts(F.col("t"), size, overlap).alias("w")).collect():
        assert row.w == brute_windows(row.t.split(), size, overlap)


def sections(value, text, **options):
    return [(s.title, s.text) for s in value(lambda c: C.section_array(c, **options), text)]


def test_section_paths_and_preamble(value):
    text = "pre\n# A\na\n### C\nc\n### D\nd\n## E\n\n# F\nf\n"
    assert sections(value, text) == [
        ("", "pre"), ("A", "# A\na"), ("A > C", "### C\nc"), ("A > C > D", "### D\nd"), ("A > E", "## E"), ("F", "# F\nf"),
    ]


def test_skipped_level_nests_siblings(value):
    # positional stack: after a skipped level the next sibling lands one deeper
    text = "# A\n#### C\n#### D\n"
    assert [t for t, _ in sections(value, text)] == ["A", "A > C", "A > C > D"]


def test_hash_in_code_is_no_heading_unless_strict(value):
    text = "# A\n```\n# not\n```\nx"
    assert [t for t, _ in sections(value, text)] == ["A"]
    assert [t for t, _ in sections(value, text, strict_parity=True)] == ["A", "not"]


def brute_blocks(text):
    import re

    rule = re.compile(r"^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-{3,}:?\s*\|?\s*$")
    rows, out, at = text.splitlines(), [], 0

    def prose(line):
        if out and out[-1][0] == "prose":
            out[-1][1].append(line)
        else:
            out.append(["prose", [line]])

    while at < len(rows):
        if rows[at].strip().startswith("```"):
            end = at + 1
            while end < len(rows) and not rows[end].strip().startswith("```"):
                end += 1
            out.append(["code", rows[at : end + 1]])
            at = end + 1
        elif "|" in rows[at] and at + 1 < len(rows) and rule.match(rows[at + 1]):
            end = at + 2
            while end < len(rows) and "|" in rows[end]:
                end += 1
            out.append(["table", rows[at:end]])
            at = end
        else:
            prose(rows[at])
            at += 1
    flat = [(k, "\n".join(r).strip() if k == "prose" else "\n".join(r)) for k, r in out]
    return [b for b in flat if b[0] != "prose" or b[1]]


LINES = ["", "text", "a | b", "| x | y |", "|---|---|", "--- | ---", "```", " ```py", "# h", "|"]


def test_blocks_match_a_line_scanner(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 15))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", C.block_array(F.col("t")).alias("b")).collect():
        assert [(b.kind, b.text) for b in row.b] == brute_blocks(row.t), row.t


def test_long_table_repeats_its_header(value):
    rows = [f"| r{i} | v{i} w |" for i in range(40)]
    text = "\n".join(["| a | b |", "|---|---|", *rows])
    chunks = value(lambda c: C.table_texts(c, 60), text)
    assert all(c.startswith("| a | b |\n|---|---|\n") for c in chunks)
    assert [line for c in chunks for line in c.splitlines()[2:]] == rows
    assert all(len(c.split()) <= 60 for c in chunks) and len(chunks) > 1


def test_oversize_row_stays_whole(value):
    big = "| " + " ".join(["w"] * 80) + " |"
    text = "\n".join(["| a | b |", "|---|---|", big, "| s | t |"])
    chunks = value(lambda c: C.table_texts(c, 60), text)
    assert [c.splitlines()[2:] for c in chunks] == [[big], ["| s | t |"]]


def test_long_section_gets_numbered_parts(spark, scope):
    code = "```\n" + " ".join(f"c{i}" for i in range(800)) + "\n```"
    text = "# Top\nintro words\n" + code + "\nafter"
    docs = spark.createDataFrame([("docs/a.md", text)], "path string, text string")
    rows = C.chunk_documents(docs, scope=scope).orderBy("chunk_index").collect()
    assert [(r.section, r.chunk_type) for r in rows] == [
        ("Top part 1.1", "markdown_prose"), ("Top part 2.1", "markdown_code"), ("Top part 3.1", "markdown_prose"),
    ]
    assert rows[1].text == code and rows[0].section_path == ["Top"]


def test_strict_parity_keeps_short_sections_whole(spark, scope):
    docs = spark.createDataFrame([("a.md", "# T\nx\n```\ny\n```")], "path string, text string")
    loose = C.chunk_documents(docs, scope=scope).count()
    strict = C.chunk_documents(docs, scope=scope, strict_parity=True).collect()
    assert loose == 2 and [r.text for r in strict] == ["# T x ``` y ```"]


def test_json_documents(spark, scope):
    payload = '{"big": {' + ", ".join(f'"k{i}": "a b c d"' for i in range(120)) + '}, "s": "é"}'
    docs = spark.createDataFrame([("x/a.json", payload), ("x/b.json", "{oops")], "path string, text string")
    rows = C.chunk_documents(docs, scope=scope).collect()
    good = [r for r in rows if r.source == "x/a.json"]
    assert {r.chunk_type for r in good} == {"json"} and ["s"] in [r.json_path for r in good]
    assert [r.text for r in good if r.json_path == ["s"]] == ['"é"']
    assert len([r for r in good if r.json_path[0] == "big"]) == 120
    assert [r.chunk_type for r in rows if r.source == "x/b.json"] == ["json_invalid"]


def test_chunk_columns_ids_and_template(spark, scope):
    docs = spark.createDataFrame(
        [("internal/plan.template.md", "# Limits\nthe maker must approve a transfer limit")], "path string, text string"
    )
    row = C.chunk_documents(docs, scope=scope, index_root="kb").first()
    doc_id = str(uuid.uuid5(uuid.NAMESPACE_URL, "document:2|local|acme|preprod|kb|internal/plan.template.md"))
    assert row.document_id == doc_id
    assert row.is_template and row.source_priority == 0.15 and row.source_type == "internal"
    assert row.control_areas == ["access_control", "business_logic"]
    assert (row.tenant_id, row.index_root, row.title) == ("acme", "kb", "Limits")


@pytest.mark.parametrize("name", ["", "é", "a|b", "日本語 > x", "x" * 300])
def test_uuid5(value, name):
    assert value(ids.uuid5, name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_repeated_chunks_and_cap(spark, scope):
    text = "# A\nsame\n# A\nsame\n# A\nother\n# B\nlast"
    docs = spark.createDataFrame([("a.md", text)], "path string, text string")
    row = C.split_documents(docs, max_chunks=2).first()
    assert [c.text for c in row.chunks] == ["# A same", "# A other"]
    assert (row.duplicate_chunks, row.truncated_chunks) == (1, 1)
    whole = C.split_documents(docs).first()
    assert ([c.text for c in whole.chunks], whole.truncated_chunks) == (["# A same", "# A other", "# B last"], 0)


def test_text_redacted_before_hashing(spark, scope):
    docs = spark.createDataFrame([("a.txt", "key AKIA" + "A" * 16)], "path string, text string")
    row = C.chunk_documents(docs, scope=scope).first()
    assert row.text == "key [REDACTED]"


@pytest.mark.parametrize(
    "path,kind",
    [("a/internal/owasp/x.md", "internal"), ("owasp-api/x.md", "owasp"), ("mitre-cwe/x.md", "mitre"),
     ("payloadsallthethings/x.md", "payloads"), ("portswigger/mitre/x.md", "portswigger"), ("x.md", "local")],
)
def test_source_types(value, path, kind):
    assert value(D.source_type, path) == kind


def test_titles(value):
    path = F.lit("x/some-file.md")
    assert value(lambda c: D.doc_title(c, path), "\n  ## Hi there \nx") == "Hi there"
    assert value(lambda c: D.doc_title(c, path), "plain first\n# later") == "plain first"
    assert value(lambda c: D.doc_title(c, path), "##\nx") == "some-file"
    assert value(lambda c: D.doc_title(c, path), "  ") == "some-file"
    assert value(lambda c: D.heading_title(c, path), "plain\nx") == "Some File"


def test_control_areas_keep_punctuation(value):
    assert value(D.control_areas, "Login, then limit") == ["business_logic"]
    assert value(D.control_areas, "third-party webhook") == ["integration_security"]


class _Reader(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts = []

    def handle_data(self, data):
        if data.strip():
            self.parts.append(data.strip())

    def handle_starttag(self, tag, attrs):
        if tag in {"p", "br", "li", "tr", "h1", "h2", "h3", "h4"}:
            self.parts.append("\n")


def test_html_text_matches_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    extra = spark.createDataFrame(
        [(-1, "<p title='a>b'>x &amp;lt; y &#8364; &#x41; &nope; 1 < 2<br/>z</p><style>p{a:'</p>'}</style><!-- c --><td>q")],
        "page_id long, html string",
    )
    rows = pages.select("page_id", "html").union(extra).withColumn("text", D.html_to_text(F.col("html"))).collect()
    for row in rows:
        reader = _Reader()
        reader.feed(row.html)
        reader.close()
        lines = [line.strip() for line in " ".join(reader.parts).splitlines()]
        assert row.text == "\n".join(line for line in lines if line), row.page_id


def test_front_matter_and_boilerplate(value):
    assert value(D.strip_front_matter, "---\na: 1\n---\nbody") == "body"
    assert value(D.strip_front_matter, "---\nno end") == "---\nno end"
    text = "# T\n![](x.png)\n## Sponsored by x\ngone\n### Back\nkept\n<figure>f"
    assert value(D.clean_markdown, text) == "# T\n### Back\nkept"


def test_low_value(value):
    assert value(lambda c: D.is_low_value(c, 120), "short")
    links = "\n".join(["https://example.com/" + "x" * 30] * 4 + ["text"])
    assert value(lambda c: D.is_low_value(c, 120), links)
    assert not value(lambda c: D.is_low_value(c, 10), "some plain words here")


def test_first_n_with_hot_key_is_exact(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    got = dedupe.first_n(df, ["k"], ["id"], 1200).where("k = 0").agg(F.count("*"), F.max("id")).first()
    assert tuple(got) == (1200, 1199 * 3)


def test_first_n_above_the_plan_limit_with_descending_order(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), "id")
    got = dedupe.first_n(df, ["k"], [F.desc("id")], 1800).agg(F.count("*"), F.min("id")).first()
    assert tuple(got) == (1800, 1200)
    assert dedupe.first_n(df, ["k"], ["id"], None).count() == 3000


def test_flag_first(spark):
    df = spark.createDataFrame([(p,) for p in ("b", "a", "d", "c")], "p string")
    kept = dedupe.flag_first(df, F.col("p"), 2, F.col("p") != "a").where("_within").collect()
    assert sorted(r.p for r in kept) == ["b", "c"]
    assert dedupe.flag_first(df, F.col("p"), None).where("_within").count() == 4
