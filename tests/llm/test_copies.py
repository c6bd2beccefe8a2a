"""SimHash, suffix-sorted repeats, decontamination and connected components against brute force."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seclake.llm import decontamination, simhash, suffix_dedup
from seclake.llm.common import broadcast_if_small, checkpointed, components, stored

DOCS = "doc_id long, text string"
VOCABULARY = [a + b for a in ("re", "on", "th", "an", "és", "ti") for b in ("ing", "or", "ed", "le", "wh", "ñ", "en")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, n):
    parts = text.split()
    for _ in range(n):
        parts[rng.randrange(len(parts))] = rng.choice(VOCABULARY) + "x"
    return " ".join(parts)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    passage = prose(rng, 40)
    texts = list(base)
    texts += [base[i] for i in (1, 1, 2, 3, 3, 3)]
    texts += [edited(rng, base[i % 60], 1) for i in range(25)]
    texts += [prose(rng, 10) + " " + passage + " " + prose(rng, 10) for _ in range(8)]
    texts += ["", None, " \n", "a" * 400, "a" * 300, "A B", "a b", "x", "é" * 60, "é" * 40 + "z", "\x00" * 120, "\x00" * 70 + "b"]
    rng.shuffle(texts)
    return list(enumerate(texts, start=5))


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    pairs = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(205, 203), (203, 201), (201, 205), (7, 7)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    expected = union([p for p in pairs if p[0] != p[1]], {n for p in pairs for n in p})
    assert {r["node"]: r["component"] for r in components(frame).collect()} == expected
    assert components(frame.where("false")).count() == 0


# -- SimHash ----------------------------------------------------------------------------------------------
def plain_fingerprint(text, k=3):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(spark, corpus):
    prints = {d: plain_fingerprint(t) for d, t in corpus}
    ids = list(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = union(pairs, ids)
    rows = [*corpus, corpus[0], (None, corpus[1][1])]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    for r in out:
        d = r["doc_id"] if r["doc_id"] is not None else corpus[1][0]
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[d]:016x}", expected[d])


def test_links_lose_no_pair_at_the_bound(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)]
    values = list(dict.fromkeys(values))
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    entries = spark.createDataFrame(rows, "node long, f0 long")
    for bits in (1, 2, 3):
        expected = {(i, j) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= bits}
        assert {(r["a"], r["b"]) for r in simhash.links(entries, bits).collect()} == expected
    with pytest.raises(ValueError):
        simhash.links(entries, 7)


def test_near_duplicate_groups(spark):
    rng = random.Random(10)
    texts = [prose(rng, 150) for _ in range(30)]
    rows = list(enumerate(texts)) + [(100 + i, edited(rng, texts[i], 2)) for i in range(10)] + [(200, texts[4]), (201, texts[4]), (300, None), (301, "")]
    rows += [(5, texts[5]), (None, texts[6])]
    frame = spark.createDataFrame([(*r, "s") for r in rows], DOCS + ", source string")
    kept = simhash.drop_near_duplicates(frame).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept)
    assert ids == sorted([(False, i) for i in range(30)] + [(False, 300), (True, 0)])
    assert simhash.drop_near_duplicates(frame.where("false")).count() == 0


def plain_groups(rows, least=0.8, k=5):
    sets = {d: {tuple(p[i : i + k]) for i in range(max(1, len(p) - k + 1))} for d, t in rows for p in [t.split()]}
    pairs = [(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return union(pairs, sets)


def reworded(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def test_variants_that_only_resemble_an_original_of_middle_id(spark):
    rng = random.Random(20)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(words) if i == 40 else reworded(rng, words, 6)) for i in range(80)]
    expected = plain_groups(rows)
    assert set(expected.values()) == {0}
    assert len(set(plain_groups([r for r in rows if r[0] != 40]).values())) > 70
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"] for r in kept} == {0}


def test_cut_and_extended_copies_down_to_the_bound(spark):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(120, 300))]
        share = rng.uniform(0.8, 0.85)
        cut, longer = words[: math.ceil(share * len(words))], words + [f"x{rng.randrange(10**6)}" for _ in range(int(len(words) / share) - len(words))]
        rows += [(i, " ".join(words)), (100 + i, " ".join(cut)), (200 + i, " ".join(longer)), (300 + i, reworded(rng, words, len(words) // 50))]
    groups = plain_groups(rows)
    assert len(set(groups.values())) < 80
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"] for r in kept} == set(groups.values())


def test_no_pair_of_a_long_list_stays_uncompared(spark):
    nodes = list(range(100))
    joined = [(a, b) for a in nodes for b in nodes if a > b and (b == 37 and a < 60 or b == 70)]
    index = spark.createDataFrame([(i, 9, [1, 2, 3] if i in (3, 99) else [1, 3, 1000 + i], [0]) for i in nodes], "node long, n int, lists array<long>, sketch array<long>")
    members = simhash._distinct_lists(index).withColumn("common", F.col("n"))
    assert members.count() == 102  # lists 1 and 3 are one
    pairs = spark.createDataFrame(joined, "a long, b long").withColumn("j", F.lit(0.8))
    none = pairs.select("a", "b").where("false")
    # distances of 0.2 and 0.4 are those of a metric
    found = simhash._list_groups(members, none, lambda p: p.join(pairs, ["a", "b"], "left").fillna(0.6), 0.8, 0)
    expected = union(joined, nodes)
    assert {r["node"]: r["component"] for r in found.collect()} == {n: c for n, c in expected.items() if n in {x for p in joined for x in p}}


def family(rng, m, words, near, far):
    """An original and m - 1 texts with ``near`` or more of its words replaced."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(base) if i == m // 2 else reworded(rng, base, rng.randint(near, far)) for i in range(m)]


@pytest.mark.parametrize("near, far", [(14, 30), (3, 30)])
def test_families_that_only_resemble_each_other(spark, monkeypatch, near, far):
    """Most members are below 0.8 to each other; some are near the original, which stands in the middle."""
    made, counts = [], {}
    plain = simhash._similarities
    monkeypatch.setattr(simhash, "_similarities", lambda pairs, sets: made.append(pairs.count()) or plain(pairs, sets))
    for m in (60, 300):
        rng = random.Random(m)
        rows = list(enumerate(family(rng, m, 200, near, far)))
        made.clear()
        kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
        assert {r["doc_id"] for r in kept} == set(plain_groups(rows).values())
        counts[m] = sum(made)
    if near > 3:
        assert counts[300] <= 3 * 300  # sketches tell that they are apart
    assert counts[300] < 300 * 299 / 2 / 4


def test_sets_are_sent_once_to_a_block(spark, monkeypatch):
    """All pairs of a family of 60 and some small lists, in one block and in many."""
    rng = random.Random(33)
    sets = {i: sorted({rng.randrange(-(2**63), 2**63) if rng.random() < 0.3 else k * 7919 for k in range(40)}, key=lambda x: x % 2**64) for i in range(70)}
    pairs = [(a, b, 5, b) for a in range(60) for b in range(a)] + [(61 + k, 60, 100 + k, 61 + k) for k in range(9)]
    frames = spark.createDataFrame(pairs, "a long, b long, list long, rep long"), spark.createDataFrame(list(sets.items()), "doc_id long, set array<long>")
    expected = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a, b, *_ in pairs}
    for block, block_pairs in ((1 << 18, 1 << 18), (400, 1 << 18), (1 << 18, 100)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "BLOCK_PAIRS", block_pairs)
        assert {(r["a"], r["b"]): r["j"] for r in simhash._similarities(*frames).collect()} == pytest.approx(expected)
        sent = simhash._blocks(*frames)[1].count()
        assert sent == 70 if block == block_pairs else 70 < sent < len(pairs)  # not two for each pair
    assert simhash._similarities(frames[0].where("false"), frames[1]).count() == 0


def test_the_exact_way_and_the_share_that_is_missed(spark):
    rng = random.Random(31)
    rows = []
    for i in range(150):  # pairs right at the bound
        words = [f"w{rng.randrange(10**6)}" for _ in range(124)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:100]))]
    rows = [(d, t) for d, t in rows]
    pairs = [g for g in plain_groups(rows).items() if g[0] != g[1]]
    assert len(pairs) == 150
    frame = spark.createDataFrame(rows, DOCS)
    exact = simhash.similar_groups(frame, miss=0).collect()
    assert {(r["doc_id"], r["component"]) for r in exact if r["doc_id"] != r["component"]} == set(pairs)
    found = simhash.similar_groups(frame).where("doc_id <> component").count()
    assert found >= 148


# -- repeats ----------------------------------------------------------------------------------------------
def plain_repeats(rows, length=50):
    least, out = {}, {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            least.setdefault(data[i : i + length], d)
    for d, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if least[data[i : i + length]] < d:
                gone[i : i + length] = True
        out[d] = gone
    return out


def test_repeats_equal_brute_force(spark, corpus):
    frame = spark.createDataFrame(corpus, DOCS)
    expected = plain_repeats(corpus)
    for buckets in (1, 7):
        out = {r["doc_id"]: r for r in suffix_dedup.repeat_digests(frame, buckets).collect()}
        assert len(out) == len(corpus)
        for d, t in corpus:
            data, gone = np.frombuffer((t or "").encode(), np.uint8), expected[d]
            runs = int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) > 0 and gone[0])
            digest = hashlib.sha256(data[~gone].tobytes()).hexdigest()
            assert tuple(out[d])[1:] == (len(data), int(gone.sum()), runs, digest)
    cleaned = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame.selectExpr("text", "doc_id", "-1 as n_chars")).collect()}
    for d, t in corpus:
        kept, at = "", 0
        for c in t or "":
            size = len(c.encode())
            kept += "" if expected[d][at : at + size].all() else c
            at += size
        assert (cleaned[d]["text"], cleaned[d]["n_chars"]) == (kept, len(kept))


def test_rows_of_one_id_and_without_id(spark):
    text = "abcdefghij " * 12
    rows = [(3, text), (3, text), (3, text + "more"), (None, text), (9, text), (1, "short")]
    out = suffix_dedup.repeat_digests(spark.createDataFrame(rows, DOCS)).collect()
    removed = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in out))
    assert removed == sorted([(3, len(text), 0), (3, len(text), 0), (3, len(text) + 4, 0), (0, len(text), 0), (9, len(text), len(text)), (1, 5, 0)])
    assert suffix_dedup.repeat_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_are_hashed_in_slices(spark, monkeypatch):
    rng = random.Random(11)
    long = prose(rng, 900)
    rows = [(1, long), (2, long[300:2500] + prose(rng, 40)), (3, prose(rng, 300))]
    monkeypatch.setattr(suffix_dedup, "SLICE", 512)
    expected = plain_repeats(rows)
    data = np.frombuffer(long.encode(), np.uint8)
    pieces = list(suffix_dedup.stretches(data, np.array([0, len(data)])))
    assert len(pieces) > 1 and sum(p[2].sum() for p in pieces) == len(data) - 49
    out = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeat_digests(spark.createDataFrame(rows, DOCS), 3).collect()}
    assert out == {d: int(g.sum()) for d, g in expected.items()}


def test_windows_of_a_hot_key_are_spread_and_still_meet(spark):
    rng = random.Random(22)
    passage = prose(rng, 14)
    rows = [(i, f"{rng.getrandbits(60):015x}{rng.getrandbits(60):015x} {passage} {rng.getrandbits(60):015x}{rng.getrandbits(60):015x}") for i in range(300)]
    rows += [(1000 + i, t[:70]) for i, t in rows[:20]] + [(1100 + i, t[-80:]) for i, t in rows[:20]]
    frame = spark.createDataFrame(rows, DOCS).repartition(6)
    expected = plain_repeats(rows)
    for hot in (suffix_dedup.HOT, 20):
        got = {d: np.zeros(len(t.encode()), bool) for d, t in rows}
        for r in suffix_dedup.find_repeats(frame, 16, hot).collect():
            for _, spans in r["spans"]:
                for a, n in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
                    got[r["doc_id"]][a : a + n + 49] = True
        assert all((got[d] == expected[d]).all() for d, _ in rows)

    def largest_share(hot):
        windows = {}
        for r in suffix_dedup._sent(frame, 16, hot).where("payload is not null").collect():
            sizes = suffix_dedup._unpack(r["payload"])[1].astype(int)
            windows[r["bucket"]] = windows.get(r["bucket"], 0) + int((sizes - 49).sum())
        return max(windows.values()) / sum(windows.values())

    assert largest_share(suffix_dedup.HOT) > 0.3 and largest_share(20) < 0.12


def test_buckets_follow_what_is_gathered_and_sorts_are_smaller(spark, monkeypatch):
    """Copies are packed in few buckets, however little is sorted at a time; long runs of one sign, too."""
    rng = random.Random(31)
    pool = [prose(rng, 30) for _ in range(12)]
    rows = [(i, " ".join([prose(rng, 8), *rng.sample(pool, 3)])) for i in range(60)] + [(100 + i, t) for i, t in enumerate(pool)]
    run = "ab" * 90
    rows += [(200, run), (201, run), (202, run[:90] + "x" + run[91:]), (203, run[:90] + "y" + run[91:]), (204, run[:90] + "x" + run[91:])]
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    expected = plain_repeats(rows)
    monkeypatch.setattr(suffix_dedup, "SORTED", 200)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 300)
    out = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeat_digests(frame).collect()}
    assert out == {d: int(g.sum()) for d, g in expected.items()}
    sent = suffix_dedup._sent(frame, None, suffix_dedup.HOT).where("payload is not null")
    assert sent.select("bucket").distinct().count() <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_equal_strings_share_a_number():
    run = b"ab" * 90
    strings = [run, b"c" * 50, run, run[:90] + b"x" + run[91:], run[:90] + b"y" + run[91:], b"c" * 51, b"c" * 50, run[:120], run[:120]]
    size = np.array([len(x) for x in strings])
    number, first = suffix_dedup._equal(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size)
    for i, n in enumerate(number):
        assert strings[first[n]] == strings[i] and first[n] <= i
    assert number[1] == number[6] and number[7] == number[8] and len(set(number[[1, 5, 7, 0]])) == 4


def test_sorted_suffix_classes_are_those_of_plain_sorting():
    rng = np.random.default_rng(12)
    for alphabet in (1, 2, 26):
        text = np.concatenate([rng.integers(97, 97 + alphabet, 900), np.tile(rng.integers(97, 97 + alphabet, 60), 8), np.zeros(70, int)]).astype(np.uint8)
        windows = np.sort(rng.choice(1300, 500, replace=False))
        classes = suffix_dedup.sort_suffixes(text, windows)
        strings = [text[w : w + 50].tobytes() for w in windows]
        rank = {s: i for i, s in enumerate(sorted(set(strings)))}
        assert classes.tolist() == [rank[s] for s in strings]


# -- decontamination --------------------------------------------------------------------------------------
def test_contained_items_equal_brute_force(spark):
    rng = random.Random(13)
    items = [(i, prose(rng, n)) for i, n in enumerate([14, 20, 35, 59, 120, 6, 5, 3, 1, 2])] + [(50, None), (51, ""), (52, "one two three four")]
    docs = []
    for i in range(40):
        parts = prose(rng, rng.randint(5, 900)).split()
        at = rng.randrange(len(parts))
        item = items[i % 7][1].split()
        cut = item[: max(5, int(len(item) * rng.choice([1, 1, 0.9, 0.85, 0.5])))]
        docs.append((i, " ".join(parts[:at] + cut + parts[at:]).upper() if i % 5 == 0 else " ".join(parts[:at] + cut + parts[at:])))
    docs += [(100, "One Two\nthree FOUR"), (101, items[8][1]), (102, None), (103, ""), (104, "one two three four five"), (3, docs[3][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", item_id int")
    found = decontamination.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), block_chars=400).collect()
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"], r["containment"]) for r in found}
    assert len(got) == len(found)

    def shingles(text):
        parts = ("".join(c.lower() if c.isascii() else c for c in text or "")).split()
        return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()

    expected = {}
    for d, t in docs:
        for i, x in items:
            want, have = shingles(x), shingles(t)
            if want and len(want & have) >= 0.8 * len(want):
                expected[d, i] = (len(want), len(want & have), len(want & have) / len(want))
    assert got == expected and expected
    clean = decontamination.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in expected}
    none = decontamination.contaminated(frame, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0 and decontamination.contaminated(frame.where("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_steps_leave_no_shuffle_files(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    grouped = spark.range(1000).groupBy((F.col("id") % 10).alias("a")).agg(F.min("id").alias("b"))
    made = [checkpointed(grouped), stored(grouped), components(grouped.where("a <> b or a > 0"))]
    broadcast_if_small(grouped)
    until = time.time() + 20
    while files() - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not files() - before
    assert [m.count() for m in made] == [10, 10, 0]
    assert spark.conf.get(setting) == "false"  # only the steps change it
