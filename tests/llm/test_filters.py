"""Toxicity, token counts, url rules, mixing and quality against brute force on small fixtures."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seclake.llm import mixing, quality, token_counts, toxicity, url_filter
from seclake.llm.common import held_out

DOCS = "doc_id long, text string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ab", "cd", "ef", "on", "it"]) for _ in range(n))


# -- folds ------------------------------------------------------------------------------------------------
def test_held_out_fold(spark):
    rows = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "doc_id long").withColumn("h", held_out(F.col("doc_id"))).collect()
    for r in rows:
        assert r["h"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


# -- toxicity ---------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def toxic_docs():
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(500):
        sentences = [words(rng, 8) for _ in range(rng.randint(1, 6))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] = sentences[at] + " " + rng.choice(["grobian", "grobians", "schuft"])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad), 1))
    return docs, labels


def test_toxicity_learns_from_documents_and_locates_sentences(spark, toxic_docs):
    docs, labels = toxic_docs
    frame = spark.createDataFrame(docs, DOCS)
    model = toxicity.train_toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), max_rows=400)
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, model).collect()}
    truth = {d: y for d, y, _ in labels}
    fold = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(rows[d]["predicted"] == truth[d] for d in fold) >= 0.95 * len(fold)
    found = [r for r in rows.values() if r["predicted"] == 1]
    assert all(any(w in r["worst_sentence"] for w in ("grobian", "schuft")) for r in found)
    for r in found:
        text = dict(docs)[r["doc_id"]]
        assert text.encode()[r["worst_start"] :].decode().startswith(r["worst_sentence"])


def test_noisy_or_is_the_product_over_sentences(spark):
    weights = np.zeros(1 << 18)
    model = toxicity.ToxicityModel(weights, -1.0)
    frame = spark.createDataFrame([(1, "one two. three! four"), (2, ""), (3, None), (4, "... !!")], DOCS)
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, model).collect()}
    p = 1 / (1 + math.exp(1))
    assert rows[1]["score"] == pytest.approx(1 - (1 - p) ** 3) and rows[1]["n_sentences"] == 3
    for i in (2, 3, 4):
        assert rows[i]["score"] == 0 and rows[i]["predicted"] == 0 and rows[i]["worst_start"] is None and rows[i]["worst_sentence"] is None


def test_scores_hold_the_words_of_few_texts_at_a_time(spark, monkeypatch):
    frame, tasks = spark.createDataFrame([], DOCS), []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, shape: tasks.append(run) or self)
    toxicity.score_toxicity(frame, toxicity.ToxicityModel(np.linspace(-1, 1, 1 << 18), -1.0))
    rng = random.Random(9)
    texts = [None if i % 50 == 0 else ". ".join(words(rng, 8) for _ in range(40)) for i in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(toxicity, "BATCH_BYTES", 1 << 30)
    whole = pa.Table.from_batches(tasks[0](iter([batch])))
    monkeypatch.undo()
    tracemalloc.start()
    rows, parts = 0, []
    for part in tasks[0](iter([batch])):
        rows += part.num_rows
        parts.append(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 6000 and pa.Table.from_batches(parts).combine_chunks().equals(whole.combine_chunks())
    assert peak < 4 * batch.nbytes


def test_scores_keep_rows_and_replace_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "x", 5, "s"), (1, "x", 5, "s"), (None, None, None, None)], "doc_id long, text string, score int, source string")
    model = toxicity.ToxicityModel(np.zeros(1 << 18), -1.0)
    out = toxicity.score_toxicity(frame, model)
    assert out.columns[:3] == ["doc_id", "text", "source"] and dict(out.dtypes)["score"] == "double" and out.count() == 3
    assert toxicity.score_toxicity(frame.where("false"), model).count() == 0


def test_no_labels_reject_nothing(spark):
    frame = spark.createDataFrame([(1, "a. b. c. " * 200)], DOCS)
    model = toxicity.train_toxicity(frame, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(frame, model).first()["predicted"] == 0


# -- quality ----------------------------------------------------------------------------------------------
def test_quality_held_out_accuracy_and_edges(spark):
    rng = random.Random(5)
    docs = [(i, words(rng, 40) + (" $$$ | &&&" if i % 3 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 3 != 0)) for i in range(400)]
    frame = spark.createDataFrame([*docs, (None, None), (1000, "")], DOCS)
    model = quality.train_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int"), max_rows=300)
    rows = {r["doc_id"]: r for r in quality.score_texts(frame, model).collect()}
    fold = [d for d, _ in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(rows[d]["predicted"] == dict(labels)[d] for d in fold) >= 0.95 * len(fold)
    assert rows[None]["score"] == rows[1000]["score"] and 0 <= rows[1000]["score"] <= 1
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())


def test_quality_score_is_the_sparse_dot_product(spark):
    model = quality.FtrlModel()
    for _ in range(30):
        model.learn(np.array([5, 9, 70]), 1)
        model.learn(np.array([5, 11]), 0)
    w = model.weights()
    assert w[9] > 0 > w[11] and w[1234] == 0
    frame = spark.createDataFrame([(1, "good words here"), (2, "x " * 300_000)], DOCS)
    from seclake.llm.common import utf8
    import pyarrow as pa

    data, offsets = utf8(pa.array(["good words here"]))
    _, ids = quality.text_features(data, offsets, model.bits, model.orders)
    assert len(ids) == 5
    z = w[-1] + w[ids].sum() * 8 / 4
    scores = {r["doc_id"]: r["score"] for r in quality.score_texts(frame, model).collect()}
    assert scores[1] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and 0 <= scores[2] <= 1


# -- tokens -----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark, tokenizer_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    pool = ["it's", "we'll", "x", " ", "  ", "\n", "\t", "naïve", "日本", "🙂", "123", "...", "<|endoftext|>", "\x1c", "\u00a0", "don't"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["".join(rng.choice(pool) for _ in range(4000)) for _ in range(4)]
    texts += ["a" * 9000, " " * 5000, "ab " * 3000, "'" * 5000, "<|endoftext|>" * 900, "", " ", "x ", " x", "y" * 2500 + " z" * 2000]
    texts += ["ab " * 3000]  # a repeated long text
    frame = spark.createDataFrame([*enumerate(texts), (1000, None), (0, texts[0])], DOCS).withColumn("n_tokens", F.lit("clash"))
    out = token_counts.count_tokens(frame, tokenizer_path, limit=20, chunk_chars=1500, overlap=200).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path)
    assert len(out) == len(texts) + 2
    for r in out:
        text = "" if r["doc_id"] == 1000 else texts[r["doc_id"]]
        expected = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (expected, len(text.encode()), expected > 20)
    assert token_counts.count_tokens(frame.where("false"), tokenizer_path).count() == 0


# -- url rules --------------------------------------------------------------------------------------------
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "/es/x", "allow")]


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
        path = rest[n:].split("?")[0].split("#")[0]
    fits = [(h, p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules_equal_brute_force(spark):
    urls = [f"http{s}://{h}{p}{q}" for s in ("", "s") for h in ("com", "Example.com", "www.example.com", "m.www.example.com", "xexample.com", "b.a.net", "net", "x.org", "")
            for p in ("", "/", "/en/", "/en", "/es/", "/es/xyz", "/fr/1") for q in ("", "?a=/en/", "#t")]
    urls += [None, "", "no scheme", "://", "a://b://c/en/", "http://ÄÖ.com/x\ny", "http://a..com/"]
    frame = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    out = url_filter.judge_urls(frame, RULES).collect()
    assert len(out) == len(urls)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(urls[r["page_id"]]), urls[r["page_id"]]
    assert {r["verdict"] for r in url_filter.judge_urls(frame, []).collect()} == {"allow"}
    assert url_filter.judge_urls(frame.where("false"), RULES).count() == 0


def test_cascade_is_exact_over_the_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("crc32(key) % 7 = 0").unionByName(spark.sql("select 'elsewhere' as key"))
    levels = url_filter.build_cascade(universe, 4000, listed)
    assert len(levels) > 2
    found = universe.withColumn("member", url_filter.passes_cascade(levels, F.col("key")))
    assert found.where("member <> (crc32(key) % 7 = 0)").count() == 0
    assert url_filter.build_cascade(universe, 4000, listed.where("false")) == []


# -- mixing -----------------------------------------------------------------------------------------------
def fill(sizes, weights, total, epochs=3.0):
    full, out = set(), {}
    while True:
        rest = total - sum(sizes[s] * epochs for s in full)
        open_ = [s for s in sizes if s not in full]
        w = sum(weights[s] for s in open_)
        out = {s: sizes[s] * epochs if s in full else rest * weights[s] / w for s in sizes}
        above = [s for s in open_ if out[s] > sizes[s] * epochs]
        if not above:
            return out
        full |= set(above)


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(0, 30)), ["hot", "b", "small", "d", None][min(4, int(rng.random() ** 2 * 5))]) for i in range(800)]
    rows += [(900, None, "b"), (901, "", "d"), (902, " \t\n", "small"), (3, rows[3][1], rows[3][2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    weights = {"hot": 1.0, "b": 2.0, "small": 5.0, "d": 1.0, None: 9.0}
    given = spark.createDataFrame(list(weights.items()), "source string, weight double")
    out = mixing.mix(frame, given).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = fill(sizes, weights, sum(sizes.values()))
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert own[0]["target"] == pytest.approx(targets[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= 31
        assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in own)
    again = mixing.mix(frame.repartition(3), given).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)
    assert mixing.repeat(mixing.mix(frame, given)).count() == sum(r["copies"] for r in out)
    assert mixing.mix(frame.where("false"), given).count() == 0
    other = mixing.mix(frame, given.where("source = 'b'")).collect()  # the rest has no weight
    assert all(r["taken"] == 0 for r in other if r["source"] != "b")
