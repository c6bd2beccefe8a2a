"""Stages of the corpus pipeline against plain versions, on some hundred documents and on edges."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seclake.llm import simhash, toxicity
from tests.llm.test_copies import plain_groups, plain_repeats

STAGES = dict(corpus_pipeline.STAGES)
SHAPE = "doc_id long, text string, lang string, source string, n_chars int"


def sentence(rng, n, mark="w"):
    return " ".join(f"{mark}{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(40)
    items = [(i, sentence(rng, 12, "bench")) for i in range(6)]
    passage = sentence(rng, 25, "shared")
    texts = [sentence(rng, rng.randint(20, 120)) for _ in range(120)]
    texts += [t + " end" for t in texts[:15]] + texts[15:25]
    texts += [sentence(rng, 30) + " " + passage + " " + sentence(rng, 30) for _ in range(10)]
    texts += [sentence(rng, 30) + " " + items[i % 6][1] + " " + sentence(rng, 5) for i in range(12)]
    toxic = [sentence(rng, 40) + ". you are an awful idiot and i hate you. " + sentence(rng, 10) for _ in range(40)]
    order = list(range(len(texts) + len(toxic)))
    rng.shuffle(order)
    rows = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t)) for i, t in zip(order, texts + toxic)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    labels = [(i, 1, int(t in toxic)) for i, t, *_ in rows]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items, {i for i, t, *_ in rows if t in toxic}


def texts_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_every_stage_equals_its_plain_version(spark, corpus):
    folder, rows, items, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = STAGES["toxicity"](spark, docs, folder)
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    expected = {i: t for i, t, *_ in rows if not judged[i]}
    assert texts_of(kept) == expected and len(toxic - set(expected)) >= 0.9 * len(toxic) and len(expected) >= len(rows) - len(toxic) - 3

    docs = spark.createDataFrame([r for r in rows if r[0] in expected], SHAPE)
    groups = plain_groups([(i, t) for i, t in expected.items()])
    expected = {i: t for i, t in expected.items() if groups[i] == i}
    assert texts_of(STAGES["near_dedup"](spark, docs, folder)) == expected and len(set(groups.values())) < len(groups)

    docs = spark.createDataFrame([r for r in rows if r[0] in expected], SHAPE)
    gone = plain_repeats(list(expected.items()))
    cut = {i: "".join(c for c, g in zip(t, gone[i]) if not g) for i, t in expected.items()}
    found = STAGES["repeats"](spark, docs, folder)
    assert found.columns == docs.columns and texts_of(found) == cut and cut != expected
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())

    docs = spark.createDataFrame([(i, cut[i], *r[2:]) for r in rows for i in [r[0]] if i in cut], SHAPE)

    def shingles(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    clean = {i: t for i, t in cut.items() if all(len(shingles(t) & shingles(x)) < 0.8 * len(shingles(x)) for _, x in items)}
    assert texts_of(STAGES["decontamination"](spark, docs, folder)) == clean and 0 < len(cut) - len(clean) <= 12

    docs = spark.createDataFrame([(r[0], clean[r[0]], *r[2:]) for r in rows if r[0] in clean], SHAPE)
    mixed = STAGES["mixing"](spark, docs, folder).collect()
    sizes, target, taken, largest = {}, {}, {}, {}
    for i, t, _, source, _ in ((r[0], clean[r[0]], *r[2:]) for r in rows if r[0] in clean):
        sizes[source] = sizes.get(source, 0) + len(t.split())
        largest[source] = max(largest.get(source, 0), len(t.split()))
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1, 5, 2)))
    full, rest = {}, dict(weights)
    while True:  # water-filling with a cap of three times a source's size
        left = sum(sizes.values()) - sum(full.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        above = [s for s in share if share[s] > 3 * sizes[s]]
        if not above:
            break
        for s in above:
            full[s] = 3 * sizes[s]
            del rest[s]
    target = {**full, **share}
    copies = {}
    for r in mixed:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["text"] == clean[r["doc_id"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target) and max(copies.values()) <= 3


def test_near_copies_by_fingerprint_and_by_similarity(spark):
    """Repeated shingles decide a fingerprint, different ones a similarity: either links, and groups of both join."""
    rng = random.Random(41)
    refrain = sentence(rng, 7)  # an odd number of shingles: none of the bits is a tie
    base = [f"v{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join([refrain] * 200) + " " + sentence(rng, 60, f"own{i}x")) for i in (1, 2, 3)]
    rows += [(4, " ".join(base)), (5, " ".join(base[:125])), (6, sentence(rng, 80))]
    # a copy of 3 that is linked by similarity alone: the refrain twice only
    rows += [(7, rows[2][1].replace(" ".join([refrain] * 200), " ".join([refrain] * 2)))]
    groups = plain_groups(rows)
    assert groups == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 3}
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], SHAPE)
    prints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert prints == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert set(texts_of(STAGES["near_dedup"](spark, docs, ""))) == {1, 4, 6}


def test_stages_on_edges(spark, corpus):
    folder, *_ = corpus
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 50_000), (5, "one two three"), (5, "one two three"), (None, "one two three"), (None, None), (6, None)]
    clash = {name: F.lit(7) for name in ("_h", "_id", "_spans", "_loser", "_hit", "_key", "h", "id", "hit", "loser", "hash", "spans")}
    docs = spark.createDataFrame([(*r, "en", None, 0) for r in rows], SHAPE).withColumns(clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept = {r["doc_id"] for r in out.collect()}
        assert {4, 5, None} <= kept and all(r["_h"] == 7 and r["hit"] == 7 for r in out.collect()), name
        assert stage(spark, docs.where("false"), folder).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert {r["doc_id"] for r in last(spark, docs.drop("_h"), folder).collect()} <= {r[0] for r in rows}
    assert last(spark, docs.where("false"), folder).count() == 0


def test_run_leaves_only_its_result(spark, corpus):
    folder, rows, *_ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert 0 < out.count() and {r["doc_id"] for r in out.collect()} <= {r[0] for r in rows}
    shared = corpus_pipeline.shared_folder(spark).removeprefix("file:")
    import glob

    assert all(len(glob.glob(f"{place}/*")) <= 1 for place in glob.glob(f"{shared}/pipeline-*"))
