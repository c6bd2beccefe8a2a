"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two fingerprints of n bytes that differ in at most ``max_bits`` bits agree in at
least ``n - max_bits`` bytes at their places: the guaranteed minimum of matches.
Lists of single bytes would each hold a 256th of the corpus, so the index is
keyed by *combinations* of as many positional bytes as the minimum asks for.
Pairs that meet in a combination have their shared positional bytes tallied,
those below the minimum go, and the rest are verified bit by bit.  With all
combinations this loses no link.

Equal fingerprints are one entry of the index, so copies never meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclake.llm.common import SLICE_BYTES, WORDS, broadcast_if_small, checkpointed, components, free_name, mix, release, row_slices, shuffles_removed, stored, utf8
from seclake.llm.common import words as hashed_words
from seclake.operators.dedupe import first_n

SEED = 42
_TALLY = 1 << 14  # shingles whose bits are counted at a time


def _spans(text: bytes, shingle: int) -> tuple[bytes, list[tuple[int, int]]]:
    """Words joined by one blank, and the byte range of every shingle in it."""
    words = text.lower().split()  # bytes: A-Z, and white space 09-0d and 20
    joined = b" ".join(words)
    if len(words) <= shingle:
        return joined, [(0, len(joined))] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    return joined, list(zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()))


def fingerprint(text: bytes, shingle: int, words: int = 1, distinct: bool = False) -> list[int]:
    """Unsigned 64-bit words of the fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    joined, spans = _spans(text, shingle)
    if not spans:
        return [0] * words
    parts = {joined[a:b] for a, b in spans} if distinct else [joined[a:b] for a, b in spans]
    out = []
    for seed in range(SEED, SEED + words):
        hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts)).astype(">u8")
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _TALLY):
            counts += np.unpackbits(hashes[at : at + _TALLY].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * counts > len(parts)).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """``doc_id, digest, f0, f1 ..``: fingerprint words as signed longs, and a digest of the text's words.

    Null texts count as empty; texts without words have fingerprint 0.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.encode() if t else b"" for t in batch.column("text").to_pylist())
            prints, digests = [], []
            for text in texts:
                prints.append(fingerprint(text, shingle, words, distinct))
                digests.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
            columns = np.array(prints, np.uint64).reshape(-1, words).view(np.int64)
            arrays = [batch.column("doc_id"), pa.array(digests, pa.binary()), *(pa.array(columns[:, i]) for i in range(words))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", *(f"f{i}" for i in range(words))])

    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, " + ", ".join(f"f{i} long" for i in range(words))
    return docs.select("doc_id", "text").mapInArrow(hashed, shape)


def _mask(places: tuple[int, ...], word: int) -> int:
    """Signed mask of the bytes of one 64-bit word among ``places``."""
    value = sum(0xFF << 8 * (p - 8 * word) for p in places if 8 * word <= p < 8 * word + 8)
    return value - (1 << 64) if value >> 63 else value


def postings(entries: DataFrame, combos: list[tuple[int, ...]], words: int) -> DataFrame:
    """One row per entry and combination: ``c`` and the combination's bytes ``k0, k1 ..``."""
    keys = F.array(*[
        F.struct(F.lit(c).alias("c"), *[F.col(f"f{w}").bitwiseAND(F.lit(_mask(places, w)).cast("bigint")).alias(f"k{w}") for w in range(words)])
        for c, places in enumerate(combos)
    ])
    return entries.select("*", F.inline(keys))


def shared_bytes(a: str, b: str, words: int) -> Column:
    """Number of positional bytes that two entries share."""
    total = F.lit(0)
    for w in range(words):
        differ = F.col(f"{a}.f{w}").bitwiseXOR(F.col(f"{b}.f{w}"))
        for p in range(8):
            total = total + F.when(differ.bitwiseAND(F.lit(_mask((p,), 0)).cast("bigint")) == 0, 1).otherwise(0)
    return total


def differing_bits(a: str, b: str, words: int) -> Column:
    total = F.lit(0)
    for w in range(words):
        total = total + F.bit_count(F.col(f"{a}.f{w}").bitwiseXOR(F.col(f"{b}.f{w}")))
    return total


def links(entries: DataFrame, max_bits: int = 2) -> DataFrame:
    """``a, b`` with a < b: all pairs of 64-bit entries ``node, f0`` at ``max_bits`` or fewer differing bits."""
    least = 8 - max_bits
    if least < 2:
        raise ValueError("more differing bits leave too few bytes to index")
    index = postings(entries, list(combinations(range(8), least)), 1)
    close = (F.col("a.c") == F.col("b.c")) & (F.col("a.k0") == F.col("b.k0")) & (F.col("a.node") < F.col("b.node"))
    close = close & (differing_bits("a", "b", 1) <= max_bits) & (shared_bytes("a", "b", 1) >= least)
    found = index.alias("a").join(index.alias("b"), close)
    return found.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest doc_id
    that links reach, the row's own included.  Rows without an id get the
    component of the rows with their fingerprint, if any has an id.  No rows:
    no rows.
    """
    prints = checkpointed(fingerprints(docs, shingle).select("doc_id", "f0"))
    entries = checkpointed(prints.groupBy("f0").agg(F.min("doc_id").alias("node")))
    found = components(links(entries.where("node is not null"), max_bits))
    labelled = entries.join(found, "node", "left").select("f0", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labelled, "f0").select(
        "doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id"
    )


# -- near-duplicates by similarity --------------------------------------------------------------------
MISS = 1e-3  # chance at most that a pair of exactly the wanted similarity shares no list
ROWS = 10  # minimum hashes that make one list
GROWTH = 16  # times as many representatives of a list in every round
SIGMAS = 5  # a pair's sketches may differ by so many standard deviations more than those of a pair at the wanted similarity


def bands(least: float, miss: float = MISS) -> int:
    """Lists per text: a pair of similarity ``least`` shares one of them but for a chance of ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(least**ROWS)))) if least < 1 else 1


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the different shingles of every row, in order."""
    hashes, rows, _ = hashed_words(data, offsets, WORDS)
    cuts = np.searchsorted(rows, np.arange(len(offsets)))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        width, own = min(shingle, j - i), hashes[i:j]
        total = np.zeros(j - i - width + 1 if width else 0, np.uint64)
        for w in range(width):
            total = mix(total ^ own[w : w + len(total)])
        yield np.unique(total)


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of ``doc_id, text`` batches, a few at a time."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in row_slices(offsets, SLICE_BYTES // 4):
            yield batch.column("doc_id").slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _list_column(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def shared_lists(docs: DataFrame, least: float, shingle: int, miss: float = MISS) -> DataFrame:
    """``doc_id, digest, n, lists, sketch``: digest of the text's words, number of different shingles, one key per list.

    A list is keyed by ``ROWS`` minimum hashes of 32 bits; the sketch has one bit of each
    of all minimum hashes.  With ``miss`` 0 there is a list for each of the n - least * n
    + 1 smallest shingle hashes and no sketch: two sets of that similarity always
    share one of these, at the price of far longer lists.
    """
    n = bands(least, miss) if miss > 0 else 0
    rng = np.random.default_rng(SEED)
    factor = rng.integers(0, 1 << 31, (n * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
    summand = rng.integers(0, 1 << 32, (n * ROWS, 1), np.uint32)

    def keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not n or not len(own):
            prefix = len(own) - math.ceil(least * len(own) - 1e-9) + 1 if len(own) else 0
            return own[:prefix].view(np.int64), np.empty(0, np.int64)
        small, lowest = (own >> np.uint64(32)).astype(np.uint32), np.full(n * ROWS, ~np.uint32(0))
        for at in range(0, len(small), 256):
            hashed = small[at : at + 256] * factor
            hashed += summand
            np.minimum(lowest, hashed.min(1), out=lowest)
        out = np.arange(n, dtype=np.uint64)
        for row in lowest.reshape(n, ROWS).T:
            out = mix((out + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ row)
        bits = np.zeros(-(-len(lowest) // 64) * 64, np.uint8)
        bits[: len(lowest)] = (lowest ^ (lowest >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(31)
        return out.view(np.int64), np.packbits(bits).view(np.int64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _text_slices(batches):
            cuts = offsets.tolist()
            digests = [xxhash.xxh3_128_digest(b" ".join(data[i:j].tobytes().lower().split())) for i, j in zip(cuts[:-1], cuts[1:])]
            own = list(_shingle_hashes(data, offsets, shingle))
            made = [keys(x) for x in own]
            arrays = [ids, pa.array(digests, pa.binary()), pa.array([len(x) for x in own], pa.int32()), _list_column([m[0] for m in made]), _list_column([m[1] for m in made])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "n", "lists", "sketch"])
        release()

    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, n int, lists array<long>, sketch array<long>"
    return docs.select("doc_id", "text").mapInArrow(hashed, shape)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, set``: 64-bit hashes of the different shingles of every text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _text_slices(batches):
            sets = [x.view(np.int64) for x in _shingle_hashes(data, offsets, shingle)]
            yield pa.RecordBatch.from_arrays([ids, _list_column(sets)], ["doc_id", "set"])
        release()

    return docs.select("doc_id", "text").mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set array<long>")


def similar_groups(docs: DataFrame, least: float = 0.8, shingle: int = 5, miss: float = MISS, linked: DataFrame | None = None) -> DataFrame:
    """``doc_id, component`` of all documents that have a near copy: Jaccard similarity of word shingles of ``least`` or more.

    The index has one list per band of ``ROWS`` minimum hashes of a text's
    shingles, and as many bands as ``least`` asks for: a pair of exactly that
    similarity shares no list with a chance of ``miss``, closer ones far more
    seldom (0.85: 1e-6).  ``miss=0`` loses nothing.  Pairs whose numbers of shingles
    are too far apart to reach ``least`` go, as do those of which one has too many
    shingles that no other listed text has, and those whose sketches differ too much
    (chance 3e-7 at ``least``); others of a list are compared on all their shingles.

    ``linked`` (doc_id, component_id), as ``near_duplicates`` gives it, joins
    documents from the start: its groups grow by similar texts and are not
    compared inside.
    """
    prints = checkpointed(shared_lists(docs.where("doc_id is not null"), least, shingle, miss))
    classes = checkpointed(prints.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    copies = prints.select("doc_id", "digest").join(broadcast_if_small(classes), "digest").where("doc_id <> node")
    copies = checkpointed(copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    nodes = prints.join(broadcast_if_small(copies.select(F.col("a").alias("doc_id"))), "doc_id", "left_anti").withColumnRenamed("doc_id", "node")
    if linked is not None:
        copies = copies.unionByName(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    members = _distinct_lists(nodes)
    listed = checkpointed(members.select(F.col("node").alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text").join(broadcast_if_small(listed), "doc_id", "left_semi")
    sets = stored(shingle_sets(texts, shingle).groupBy("doc_id").agg(F.first("set").alias("set")))
    members = _with_common(members, sets)
    n_bits = bands(least, miss) * ROWS if miss > 0 else 0
    known = components(copies).select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = _list_groups(members, known, lambda pairs: _similarities(pairs, sets), least, n_bits)
    return groups.select(F.col("node").alias("doc_id"), "component")


def _distinct_lists(nodes: DataFrame) -> DataFrame:
    """``list, node, n, sketch, size, place`` of lists with several members; of lists with the same members one.

    ``place`` orders members: those that stand in the most and longest lists, which
    resemble the most others, come first.
    """
    index = nodes.select("node", F.explode("lists").alias("list"))
    # most lists have one member: their keys are shuffled once, and nothing of them goes on
    shared = checkpointed(index.groupBy("list").count().where("count > 1").select("list"))
    index = checkpointed(index.join(broadcast_if_small(shared), "list", "left_semi").distinct())
    marks = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"mark{seed}") for seed in (1, 2)]
    lists = index.groupBy("list").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), *marks).where("low < high")
    lists = lists.groupBy("size", "low", "high", "mark1", "mark2").agg(F.min("list").alias("list"))
    members = checkpointed(index.join(lists.select("list", "size"), "list"))
    places = checkpointed(members.groupBy("node").agg((-F.sum("size")).alias("place")))
    known = nodes.join(broadcast_if_small(places), "node").groupBy("node").agg(F.first("place").alias("place"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return checkpointed(members.join(known, "node").select("list", "node", "n", "sketch", "size", "place"))


def _with_common(members: DataFrame, sets: DataFrame) -> DataFrame:
    """With ``common``: how many of a member's shingles another listed text has, too.  No pair shares more."""
    alone = sets.select("doc_id", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("rows"), F.min("doc_id").alias("node")).where("rows = 1")
    own = checkpointed(alone.groupBy("node").agg(F.count("*").alias("own")))
    joined = members.join(broadcast_if_small(own), "node", "left")
    return checkpointed(joined.withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own"))


BLOCK = 1 << 18  # shingle hashes of either side that are compared at a time (2 MB)
BLOCK_PAIRS = 1 << 18  # pairs that are compared at a time


def _shared_shares(pairs: pa.Table, texts: pa.Table) -> Iterator[tuple[int, float]]:
    """Row and similarity of every pair of ``a, b``; ``texts`` has their sets, which are in order as unsigned numbers."""
    sets = texts["set"].combine_chunks()
    flat, offsets = sets.flatten().to_numpy().view(np.uint64), sets.value_lengths().to_numpy().cumsum()
    own = dict(zip(texts["doc_id"].to_pylist(), np.split(flat, offsets[:-1])))
    for row, (a, b) in enumerate(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())):
        x, y = sorted((own[a], own[b]), key=len)
        place = np.searchsorted(y, x)
        shared = int(np.count_nonzero(y[np.minimum(place, len(y) - 1)] == x)) if len(x) else 0
        yield row, shared / max(1, len(x) + len(y) - shared)


_PLACE = ["place", "rep_block", "other_block"]


def _blocks(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b`` and ``doc_id, set``, each with its block: all sets of a block's pairs, once.

    Pairs of a large list are dealt over blocks by their texts; small lists share a block.
    """
    other = F.when(F.col("a") == F.col("rep"), F.col("b")).otherwise(F.col("a"))
    pairs = pairs.withColumn("other", other)
    n = F.size("set").cast("long").alias("n")
    sides = pairs.select("list", F.explode(F.array(F.struct(F.col("rep").alias("doc_id"), F.lit(True).alias("is_rep")), F.struct(F.col("other").alias("doc_id"), F.lit(False).alias("is_rep")))).alias("side"))
    sides = sides.select("list", "side.*").distinct().join(sets.select("doc_id", n), "doc_id").groupBy("list").agg(
        F.sum(F.when(F.col("is_rep"), F.col("n")).otherwise(0)).alias("of_reps"), F.sum(F.when(F.col("is_rep"), 0).otherwise(F.col("n"))).alias("of_others")
    )
    lists = checkpointed(sides.join(pairs.groupBy("list").agg(F.count("*").alias("pairs")), "list").select(
        "list", "pairs", (F.col("of_reps") + F.col("of_others")).alias("n"),
        F.greatest(F.ceil(F.col("of_reps") / BLOCK), F.lit(1)).alias("rep_blocks"),
        F.greatest(F.ceil(F.col("of_others") / BLOCK), F.ceil(F.col("pairs") / BLOCK_PAIRS), F.lit(1)).alias("other_blocks"),
    ))
    with shuffles_removed(lists.sparkSession):
        total = lists.agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).first()
    shared = F.lit(max(math.ceil((total["n"] or 0) / BLOCK), math.ceil((total["pairs"] or 0) / BLOCK_PAIRS), 1))
    small = F.col("rep_blocks") + F.col("other_blocks") == 2
    place = F.when(small, F.pmod(F.xxhash64("list"), shared)).otherwise(F.xxhash64("list"))
    dealt = [F.when(small, F.lit(0)).otherwise(F.pmod(F.xxhash64(side), F.col(f"{side}_blocks"))).alias(f"{side}_block") for side in ("rep", "other")]
    placed = checkpointed(pairs.join(broadcast_if_small(lists.drop("pairs", "n")), "list").select("a", "b", place.alias("place"), *dealt))
    needed = placed.select(*_PLACE, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return placed, needed.join(sets, "doc_id").toDF("doc_id", *[f"{c}_" for c in _PLACE], "set")


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, j``: Jaccard similarity of the sets of each pair (a, b, ``list``, and ``rep``, the one of them that stands in many pairs).

    A set is sent once to every block that has pairs of it, not with every pair.
    """
    placed, texts = _blocks(pairs, sets)
    kind = pairs.schema["a"].dataType.simpleString()

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        shares = np.zeros(one.num_rows)
        for row, share in _shared_shares(one, other):
            shares[row] = share
        return pa.table({"a": one["a"], "b": one["b"], "j": pa.array(shares)})

    return placed.groupBy(*_PLACE).cogroup(texts.groupBy(*[f"{c}_" for c in _PLACE])).applyInArrow(compare, f"a {kind}, b {kind}, j double")


def _differing_bits(a: str, b: str, n_bits: int) -> Column:
    total = F.lit(0)
    for word in range(-(-n_bits // 64)):
        total = total + F.bit_count(F.get(a, F.lit(word)).bitwiseXOR(F.get(b, F.lit(word))))
    return total


def _list_groups(members: DataFrame, known: DataFrame, similarities: Callable[[DataFrame], DataFrame], least: float, n_bits: int) -> DataFrame:
    """``node, component`` of the links ``known`` (from a to b, the smallest that is reached) and of all pairs of members of a list with a similarity of ``least`` or more.

    Members of a list are compared with representatives of it, one in the first
    round and ``GROWTH`` times as many in every next one; in between the members
    that are linked already get one label.  A pair of one label needs no
    comparison, so large groups give a few pairs per member.  Representatives are
    taken from the list's largest group first: they meet only those that are not
    in it, and most of these are linked after a few.  One minus the
    similarity is a metric: members whose distances to the list's first
    representative differ by more than 1 - ``least`` cannot be similar.  Pairs
    compared once are not compared again.  A list is left when its members have one
    label or were all representatives: no pair stays uncompared.
    """
    entry = ["place", "node", "n", "common", "sketch"]
    labels = known.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    members = members.join(labels, "node", "left").withColumns({"label": F.coalesce("label", "node"), "far": F.lit(None).cast("double"), "other": F.lit(False)})
    links, tested, n, slack, chance = known, None, 1, 1 - least + 1e-9, (1 - least) / 2
    while True:
        large = members.where(F.col("size") > n)
        columns = ["list", *entry, "label", "far"]
        some = first_n(large, ["list"], ["other", "place", "node"], n).select(*columns, F.lit(False).alias("every"))
        whole = members.where(F.col("size") <= n).select(*columns, F.lit(True).alias("every"))
        chosen = checkpointed(whole.unionByName(some))
        apart = (F.col("m.list") == F.col("e.list")) & (F.col("m.label") != F.col("e.label")) & (~F.col("e.every") | (F.col("m.node") < F.col("e.node")))
        apart &= F.least("m.n", "e.n") >= F.lit(float(least)) * F.greatest("m.n", "e.n")
        apart &= F.least("m.common", "e.common") >= F.lit(least / (1 + least)) * (F.col("m.n") + F.col("e.n")) - 1e-9
        if n_bits:
            apart &= _differing_bits("m.sketch", "e.sketch", n_bits) <= n_bits * chance + SIGMAS * math.sqrt(n_bits * chance * (1 - chance))
        apart &= F.coalesce(F.abs(F.col("m.far") - F.col("e.far")) <= slack, F.lit(True))
        met = members.alias("m").join(chosen.alias("e"), apart)
        pairs = met.select(F.greatest("m.node", "e.node").alias("a"), F.least("m.node", "e.node").alias("b"), F.struct("m.list", F.col("e.node").alias("rep")).alias("by"))
        pairs = pairs.groupBy("a", "b").agg(F.min("by").alias("by")).select("a", "b", "by.*")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        compared = checkpointed(similarities(checkpointed(pairs)).select("a", "b", "j"))
        found = components(links.unionByName(compared.where(F.col("j") >= least - 1e-12).select("a", "b")))
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        rest = large.join(chosen.select("list", "node"), ["list", "node"], "left_anti").drop("label", "size", "other").join(found, "node", "left")
        rest = checkpointed(rest.withColumn("label", F.coalesce("component", "node")).drop("component"))
        # lists that still have several labels, with the largest of these
        labels = rest.groupBy("list", "label").agg(F.count("*").alias("group"))
        lists = labels.groupBy("list").agg(F.sum("group").alias("size"), F.count("*").alias("labels"), F.max(F.struct("group", "label")).alias("main")).where("labels > 1")
        if tested is None:  # a list had one representative in the first round
            lists = lists.join(chosen.select("list", F.col("node").alias("pivot")), "list")
        members = rest.join(lists.drop("labels"), "list")
        members = members.withColumn("other", (F.col("label") != F.col("main.label")) & (F.col("main.group") > 1)).drop("main")
        if tested is None:  # how far every member is from it
            members = members.withColumns({"a": F.greatest("node", "pivot"), "b": F.least("node", "pivot")}).join(compared, ["a", "b"], "left")
            members = members.withColumn("far", 1 - F.col("j")).drop("a", "b", "j", "pivot")
        members = checkpointed(members)
        tested = compared.select("a", "b") if tested is None else tested.unionByName(compared.select("a", "b"))
        with shuffles_removed(members.sparkSession):
            left = members.limit(1).count()
        if not left:
            return found
        n *= GROWTH


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """Columns of ``docs``; of each of the ``similar_groups`` the row with the smallest doc_id stays.

    Rows that repeat an id and its text are one document.  Rows without an id
    stay.  Null texts count as empty; empty texts are copies of each other.
    """
    groups = similar_groups(docs, **params)
    own, own_hash = free_name(docs, "loser"), free_name(docs, "hash")
    losers = checkpointed(groups.where("doc_id <> component").select(F.col("doc_id").alias(own)))
    kept = docs.join(broadcast_if_small(losers), F.col("doc_id") == F.col(own), "left_anti")
    key = docs.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias(own_hash)).count()
    repeated = checkpointed(key.where("count > 1").select(F.col("doc_id").alias(own), own_hash))
    with shuffles_removed(docs.sparkSession):
        some = repeated.limit(1).count()
    if not some:
        return kept
    same = (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(own_hash))
    once = kept.join(broadcast_if_small(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(broadcast_if_small(repeated), same, "left_anti").unionByName(once)
