"""Alignment of two tokenizers against whole-text encodings and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seclake.llm import alignment
from seclake.llm.alignment import Csr, byte_incidence, one_each, pack_numbers, product, transpose, unpack_numbers
from seclake.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")

TEXTS = [
    "", None, " ", "a", "  two  blanks ", "The quick brown fox jumps over the lazy dog.", "x<|endoftext|>y <|endoftext|> z", "<s> </s> <unk> <0x41>",
    "naïve café Ünïcödé ñandú", "▁under ▁lines", "emoji 😀😀 and 漢字かな 中文 text", "\n\n\tindent\n  code(x): y = 1\r\n", "don't we'll I'm '", "\x00 nul \x01",
    "a b   c 　d", "1234567890 12 3.14", "word " * 400, "nospace" * 200, "é ́x  ́", " lead and trail ", "tab\tsep \x1c x \x85 y", "ö" * 50,
]


def dense(m: Csr) -> np.ndarray:
    out = np.zeros((len(m.indptr) - 1, m.n_columns), np.int64)
    for i in range(len(m.indptr) - 1):
        for k in range(m.indptr[i], m.indptr[i + 1]):
            out[i, m.indices[k]] += m.values[k]
    return out


def test_sparse_products():
    rng = np.random.default_rng(1)
    for _ in range(50):
        def some(r, c):
            full = rng.integers(0, 3, (r, c)) * (rng.random((r, c)) < 0.4)
            i, j = np.nonzero(full)
            return full, Csr(np.concatenate([[0], np.cumsum(np.bincount(i, minlength=r))]), j, full[i, j], c)

        x, a = some(int(rng.integers(1, 6)), 5)
        y, b = some(5, int(rng.integers(1, 6)))
        assert (dense(product(a, b)) == x @ y).all() and (dense(transpose(a)) == x.T).all()
    assert (dense(byte_incidence(np.array([2, 1]))) == [[1, 1, 0], [0, 0, 1]]).all()
    assert (dense(one_each(np.array([1, 0]), 2)) == [[0, 1], [1, 0]]).all()


def test_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 7, 2**55], np.int64)
    data, length = pack_numbers(values)
    back, ends = unpack_numbers(data)
    assert back.tolist() == values.tolist() and ends.tolist() == np.cumsum(length).tolist()
    assert unpack_numbers(pack_numbers(values[:0])[0])[0].tolist() == []


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def plain(libraries, text, kind):
    """Tokens, groups and links of a whole text, by offsets and loops."""
    a, b = libraries
    text = text or ""
    signs = alignment._byte_signs()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
    ids_b = b.encode(text)
    spell_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
    spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    raw = (" " + text).encode()
    if not text or b"".join(spell_a) != raw or b"".join(spell_b) != raw:
        return [], [], [], []

    def spans(ids, spell):
        out, at = [], 0
        for i, s in zip(ids, spell):
            out.append((i, at, at + len(s)))
            at += len(s)
        return out

    xs, ys = spans(ids_a, spell_a), spans(ids_b, spell_b)
    cuts = sorted({e for _, _, e in xs} & {e for _, _, e in ys})
    groups = [([i for i, s, e in xs if lo < e <= hi], [i for i, s, e in ys if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
    if kind == "end":
        links = [(i, j) for i, _, e in xs for j, _, f in ys if e == f]
    elif kind == "overlap":
        links = [(i, j) for i, s, e in xs for j, t, f in ys if s < f and t < e]
    else:
        links = [(i, j) for g in groups for i in g[0] for j in g[1]]
    return ids_a, ids_b, groups, links


def expected(libraries, texts, kind="end"):
    all_ = [plain(libraries, t, kind) for t in texts]
    count = Counter(x for *_, links in all_ for x in links)
    highest = {}
    for (_, j), n in count.items():
        highest[j] = max(highest.get(j, 0), n)
    out = []
    for ids_a, ids_b, groups, links in all_:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), written))
    return out, count


def corpus():
    rng = random.Random(4)
    words = "the of and naïve coöperate tokenization 123 x-ray don't 漢字 foo_bar straße  \n re-run".split(" ")
    return TEXTS + TEXTS[:8] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(40)]


@pytest.mark.parametrize("kind", alignment.LINKS)
def test_equals_plain_loops(spark, libraries, kind):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids_b = alignment.n_ids(B)
    aligned = alignment.align(docs, A, B, links=kind, slice_links=300)
    want, count = expected(libraries, texts, kind)
    got = {r["doc_id"]: r for r in alignment.score_links(aligned, ids_b).collect()}
    assert len(got) == len(texts)
    for i, row in enumerate(want):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == row, texts[i]
    found = {(r["a_id"], r["b_id"]): r["n"] for r in alignment.link_counts(aligned, ids_b).collect()}
    assert found == dict(count)
    pairs = Counter()
    for r in alignment.pair_rows(aligned, ids_b).collect():
        pairs[r["a_id"], r["b_id"]] += r["n"]
    assert pairs == count


def test_long_text_in_segments(spark, libraries, monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(TEXTS[5].split() + ["naïve", "漢字"]) for _ in range(3000))
    assert " ".join(alignment.segments(text * 40)) == text * 40 and len(list(alignment.segments(text * 40))) > 1
    monkeypatch.setattr(alignment, "SEGMENT", 1000)
    aligner = alignment.Aligner(A, B, "end")
    numbers, written, rows, codes, times = alignment.align_texts([None, text, "", "a b", text + " ▁"], alignment.Remembered(aligner, 50))
    ids_a, ids_b, groups, links = plain(libraries, text, "end")
    assert numbers[1].tolist() == [len(ids_a), len(ids_b), len(groups), len(links)] and not numbers[[0, 2, 4]].any()
    assert written[1] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    assert Counter(dict(zip(codes[rows == 1].tolist(), times[rows == 1].tolist()))) == Counter(i * aligner.n_b + j for i, j in links)
    assert set(rows.tolist()) == {1, 3}


def test_query_and_edges(spark, libraries, tmp_path):
    rows = [(1, "a b", 5), (1, "a b", 6), (None, "a b", 7), (2, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_alignment"](spark, str(tmp_path)).collect()
    (n_a, n_b, n_groups, n_links, n_best, count_sum, written), count = expected(libraries, ["a b"])[0][0], None
    digest = hashlib.sha256(written.encode()).hexdigest()
    full = (n_a, n_b, n_groups, n_links, n_links, 3 * count_sum, digest)
    assert sorted((r["doc_id"] or 0, *tuple(r)[1:]) for r in got) == sorted([(0, *full), (1, *full), (1, *full), (2, 0, 0, 0, 0, 0, 0, "")])
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op12_alignment"](spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        alignment.align(docs, A, B, links="all")
    assert F.col("n_a") is not None
