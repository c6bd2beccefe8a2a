"""Spelling variants: words one edit apart, found with an index of grams of variable length.

The dictionary of grams is pruned by frequency: a gram is made longer only while it
is frequent, from ``SHORTEST`` up to ``longest_gram`` letters.  A word is decomposed
into the longest such gram at each position.  Where a gram stops depends on its own
letters alone, or on the end of the word; so an edit touches only grams that hold its
place, and, if it appends a letter, those that the word's end cut short.  The most
grams that one edit can touch is the word's bound, NAG.

Two words one edit apart share all but NAG of the grams of either.  Ordered by
frequency, the first shared gram is therefore among the NAG + 1 rarest of both, at the
same distance from the start (before the edit) or from the end (behind it), in words
whose lengths differ by one at most.  Only these lists are merged, by a join on gram,
place and length; what meets is verified by its edit distance.  At that distance
verifying costs less than counting the other shared grams, so nothing is counted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclake.llm.common import stored

SHORTEST = 2  # letters of the shortest grams
MAX_GRAMS = 200_000  # bound of the grams whose frequency every task knows
RARE = 32  # a gram of at most so many words is never made longer
HELD = 200_000  # distinct words or grams that a task counts before it passes them on
SLICE = 1 << 20  # bytes of a text that are read at a time

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # A-Z in lower case, and U+00C0 to U+00FF, in UTF-8


def _runs(data: bytes) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters, some at a time."""
    data = data.lower()  # bytes: A-Z only
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and (97 <= data[end] <= 122 or 128 <= data[end] <= 195):  # not inside a run or a letter
            end += 1
        yield _RUN.findall(data[at:end])
        at = end


def _counted(counts: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=[name, "n"])


def count_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """``word, n`` of all texts of ``docs`` (doc_id, text): words of ``min_length`` code points that occur ``min_count`` times.

    A word is a longest run of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower
    case.  If ``every`` divides h, the unsigned CRC-32 of ``<doc_id>:<run>``, the
    run loses its letter h modulo its length.  Null texts have no words; a null
    doc_id is written as nothing.  Rows that repeat count again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for found in _runs(data.as_py()):
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word, seed)
                        text = word.decode()
                        if h % every == 0:
                            at = h % len(text)
                            text = text[:at] + text[at + 1 :]
                        if len(text) >= min_length:
                            counts[text] += n
                    if len(counts) >= HELD:
                        yield _counted(counts, "word")
                        counts = Counter()
        if counts:
            yield _counted(counts, "word")

    texts = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def gram_frequencies(words: DataFrame, longest_gram: int, max_grams: int = MAX_GRAMS, rare: int = RARE) -> tuple[dict[str, int], int]:
    """Frequent grams with their numbers, and the number T above which a gram is frequent.

    T is at least ``rare`` and so large that at most ``max_grams`` grams can
    exceed it: n occurrences hold at most n / T grams with more than T.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for q in range(SHORTEST, longest_gram + 1):
                    counts.update([word[p : p + q] for p in range(len(word) - q + 1)])
                if len(counts) >= HELD:
                    yield _counted(counts, "gram")
                    counts = Counter()
        if counts:
            yield _counted(counts, "gram")

    sizes = [F.sum(F.greatest(F.length("word") - (q - 1), F.lit(0))) for q in range(SHORTEST, longest_gram + 1)]
    total = sum(x or 0 for x in words.agg(*sizes).first())
    threshold = max(rare, -(-total // max_grams))
    counted = words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.where(F.col("n") > threshold).collect()}, threshold


def decompose(word: str, frequent: dict[str, int], longest_gram: int) -> tuple[list[tuple[int, int]], int]:
    """First letter and end of the longest gram at each position, and the most of them that one edit can touch."""
    size, grams, cut_short = len(word), [], 0
    held = [0] * (size + 1)
    for p in range(size - SHORTEST + 1):
        e = p + SHORTEST
        while e < size and e - p < longest_gram and word[p:e] in frequent:
            e += 1
        grams.append((p, e))
        held[p] += 1
        held[e] -= 1
        cut_short += e == size and e - p < longest_gram and word[p:e] in frequent
    most, open_ = cut_short, 0
    for change in held[:size]:
        open_ += change
        most = max(most, open_)
    return grams, most


def rare_grams(words: DataFrame, frequent: dict[str, int], longest_gram: int) -> DataFrame:
    """``word, n, grams``: of each word its NAG + 1 rarest grams with their first letter and the letters behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                sizes, texts, firsts, behind = [], [], [], []
                for word in part.column(0).to_pylist():
                    grams, most = decompose(word, frequent, longest_gram)
                    ranked = sorted((frequent.get(word[p:e], 0), word[p:e], p, len(word) - e) for p, e in grams)[: most + 1]
                    sizes.append(len(ranked))
                    texts += [g for _, g, _, _ in ranked]
                    firsts += [p for _, _, p, _ in ranked]
                    behind += [b for _, _, _, b in ranked]
                entries = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(firsts, pa.int32()), pa.array(behind, pa.int32())], names=["gram", "first", "behind"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, entries)], names=["word", "n", "grams"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, grams array<struct<gram:string,first:int,behind:int>>")


def near_words(words: DataFrame, min_length: int, longest_gram: int = 4, max_grams: int = MAX_GRAMS, rare: int = RARE) -> DataFrame:
    """``word, n, other, other_n``: all pairs of ``words`` (word, n) that one inserted, deleted or replaced letter makes equal, both ways round.

    Words are distinct and have at least ``min_length`` code points.
    """
    # a word must keep a gram whatever the edit: it has min_length - SHORTEST + 1, an edit touches longest_gram at most
    longest_gram = min(longest_gram, min_length - SHORTEST)
    if longest_gram < SHORTEST:
        raise ValueError(f"words must have at least {2 * SHORTEST} letters")
    frequent, _ = gram_frequencies(words, longest_gram, max_grams, rare)
    index = stored(rare_grams(words, frequent, longest_gram))
    posting = index.select("word", "n", F.length("word").alias("size"), F.explode("grams").alias("g"))

    def key(place: str, size: Column) -> Column:
        return F.xxhash64(F.col("g.gram"), F.lit(place), F.col(f"g.{place}"), size)

    size = F.col("size")
    left = posting.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(F.array(key("first", size), key("behind", size))).alias("key"))
    right = posting.select(
        F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(key("first", size), key("first", size - 1), key("behind", size - 1))).alias("key")
    )
    ordered = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    pairs = left.join(right.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & ordered & (F.levenshtein("a", "b", 1) == 1))
    pairs = pairs.select("a", "a_n", "b", "b_n").distinct()
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def group_variants(words: DataFrame, min_length: int = 6, ratio: int = 5, **index) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words`` (word, n; distinct words of at least ``min_length`` letters).

    ``form`` is the near word with the largest n, ties to the smallest in
    code-point order, if that n is at least ``ratio`` times the word's; else null.
    ``root`` follows forms to the last; n grows by ``ratio`` with every step, so
    this ends.  Words without near words have n_near 0.  No rows: no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = stored(words.select("word", "n"))
    near = near_words(words, min_length, **index)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"))
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"),
    )
    judged = stored(judged)
    steps = judged.where("form IS NOT NULL").select(F.col("word").alias("at"), F.col("form").alias("next"))
    roots = steps.select(F.col("at").alias("word"), F.col("next").alias("root"))
    while True:  # each round doubles the steps taken
        further = stored(roots.join(steps, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            break
        steps = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
