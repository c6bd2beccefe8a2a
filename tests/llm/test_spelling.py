"""Spelling variants against plain counting and all-pairs comparison."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from seclake.llm import spelling
from seclake.llm.queries import ORACLES, QUERIES

SYLLABLES = ["heit", "ung", "tion", "er", "en", "é", "ñan", "st", "ab", "lo"]


def plain_words(rows, min_length=6, min_count=5, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def plain_groups(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def got(frame):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in frame.collect())


def vocabulary(rng, n):
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))
        if len(w) >= 6:
            words[w] = rng.choice([5, 6, 30, 200, 1500])
    for w in list(words):  # edits of edits make chains
        for _ in range(2):
            at = rng.randrange(len(w) + 1)
            v = rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "é" + w[at + 1 :], w + "z"])
            if len(v) < 6:
                break
            words.setdefault(v, max(5, words[w] // rng.choice([1, 5, 6])))
            w = v
    return words


def test_the_bound_holds_for_every_edit():
    rng = random.Random(1)
    for _ in range(1500):
        letters = "ab" if rng.random() < 0.5 else "abcé"
        word = "".join(rng.choice(letters) for _ in range(rng.randint(6, 12)))
        at, q_max = rng.randrange(len(word) + 1), rng.choice([2, 3, 4])
        other = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])
        if len(other) < 6 or other == word:
            continue
        every = {w[p : p + q] for w in (word, other) for q in range(2, q_max + 1) for p in range(len(w) - q + 1)}
        frequent = {g: 9 for g in every if rng.random() < 0.6}
        (ga, na), (gb, nb) = spelling.decompose(word, frequent, q_max), spelling.decompose(other, frequent, q_max)
        starts = Counter((word[p:e], "s", p) for p, e in ga) & Counter((other[p:e], "s", p) for p, e in gb)
        shared_grams = sum((Counter(word[p:e] for p, e in ga) & Counter(other[p:e] for p, e in gb)).values())
        assert shared_grams >= max(len(ga) - na, len(gb) - nb) >= 1
        ends = {(word[p:e], len(word) - e) for p, e in ga} & {(other[p:e], len(other) - e) for p, e in gb}
        assert starts or ends


def test_grams_grow_only_while_frequent():
    grams, most = spelling.decompose("abcdef", {"ab": 50, "abc": 40, "cd": 50}, 4)
    assert [("abcdef"[p:e]) for p, e in grams] == ["abcd", "bc", "cde", "de", "ef"] and most == 3
    assert spelling.decompose("aaaaaa", {"aa": 9, "aaa": 9}, 4)[0][-1] == (4, 6)


def test_equals_all_pairs(spark):
    rng = random.Random(2)
    words = vocabulary(rng, 250)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    for options in ({}, {"rare": 1, "max_grams": 50}, {"rare": 1, "longest_gram": 3}):
        assert got(spelling.group_variants(frame, **options)) == plain_groups(words)
    expected = plain_groups(words)
    assert any(f for _, f, *_ in expected) and any(f and r != f for _, f, r, *_ in expected) and any(not k for *_, k, _ in expected)


def test_a_chain_of_many_steps(spark):
    words = {"abcdef" + "g" * i: 5**(i + 1) for i in range(9)}
    out = got(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert out == plain_groups(words) and {r[2] for r in out} == {"abcdefgggggggg"}


def test_words_and_query(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = vocabulary(rng, 60)
    pool = [w.capitalize() if rng.random() < 0.2 else w for w in words for _ in range(min(40, words[w]))]
    rng.shuffle(pool)
    rows = [(i, " ".join(pool[i * 30 : i * 30 + 30]) + rng.choice(["", ", ÀÉ×÷ÿ Ārger 漢字abcdefg", " x_y-zzzzzzz"])) for i in range(len(pool) // 30)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (10_000, None), (10_001, ""), (10_002, "a" * 5000 + " " + "abcdefgh " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    monkeypatch.setattr(spelling, "SLICE", 100)
    monkeypatch.setattr(spelling, "HELD", 50)
    for every in (199, 3):
        counted = {r["word"]: r["n"] for r in spelling.count_words(docs, every=every).collect()}
        assert counted == plain_words(rows, every=every)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = got(QUERIES["op13_spelling"](spark, str(tmp_path)))
    assert out == plain_groups(plain_words(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(f"SELECT word, coalesce(form, ''), root, n, n_near, coalesce(form_n, 0) FROM ({ORACLES['op13_spelling']})").fetchall()
    assert sorted(sql) == out


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.group_variants(none).count() == 0
    with pytest.raises(ValueError):
        spelling.near_words(none, min_length=3)
    with pytest.raises(ValueError):
        spelling.group_variants(none, ratio=1)
