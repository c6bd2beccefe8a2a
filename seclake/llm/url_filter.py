"""URL rules held in a Bloom filter cascade: exact membership of the corpus's keys, looked up without joins.

Rules are (host, path prefix, verdict).  A rule fits its host and all
subdomains if the url's path starts with the rule's; the longest fitting rule
wins.  Every url therefore has a small set of candidate keys: each suffix of its
host joined with each prefix of its path that is as long as some rule's path.
The candidate keys of all urls are the *universe*; the rules' keys in it are the
*listed* keys.

Level 1 of a cascade encodes the listed keys, level 2 the keys of the universe
that level 1 passes by mistake, level 3 the listed keys that level 2 passes, and
so on until a level errs on nothing.  A key is listed if the first level that
refuses it has an even number (no level refuses it: odd count of levels).
Within the universe this is exact.

Everything is built from SQL functions.  Only keys that pass level 1 are ever
shuffled, and the size of level 1 follows from the number of rules and the size
of the universe, so filters stay a few bits per rule and travel as literals.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclake.llm.common import checkpointed

MAX_FILTER_BITS = 1 << 27  # 16 MB of literals; a longer list of rules is refused, not cut


def host(url: Column) -> Column:
    """From after the first ``://`` to ``/ ? #`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    value = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words, number of bits and hash functions."""

    words: list[int]
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        array = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # foldable: a literal in the plan
        test = F.lit(True)
        for i in range(self.hashes):
            at = _bit(key, self.bits, self.seed, i)
            test = test & (F.getbit(F.get(array, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return test


def _bit(key: Column, bits: int, seed: int, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits))


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """Bloom filter of the column ``key``; only the words of the filter come to the driver."""
    bits = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
    bits = -(-bits // 64) * 64
    if bits > MAX_FILTER_BITS:
        raise ValueError(f"{count} keys need {bits} bits; split the rules over several filters")
    hashes = max(1, round(bits / max(1, count) * math.log(2)))
    hashes = min(hashes, 24)
    at = F.explode(F.array(*[_bit(F.col("key"), bits, seed, i) for i in range(hashes)])).alias("at")
    rows = (
        keys.select(at)
        .groupBy(F.floor(F.col("at") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("bits"))
        .collect()
    )
    words = [0] * (bits // 64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return Level(words, bits, hashes, seed)


def passes_cascade(levels: list[Level], key: Column) -> Column:
    """Membership of a key of the universe."""
    member = F.lit(len(levels) % 2 == 1)
    for number, level in reversed(list(enumerate(levels, start=1))):
        member = F.when(level.passes(key), member).otherwise(F.lit(number % 2 == 0))
    return member


def build_cascade(universe: DataFrame, size: int, listed: DataFrame, seed: int = 1) -> list[Level]:
    """Cascade over the column ``key`` of both frames; ``size`` bounds the number of distinct keys of the universe.

    ``universe`` may repeat keys and is read once.  No keys listed, or none of
    them in the universe: no levels, and nothing is a member.
    """
    listed = listed.select("key").where("key is not null").distinct()
    count = listed.count()
    if not count:
        return []
    rate = min(0.5, max(count / max(size, 1), 2.0**-32))
    first = _level(listed, count, rate, seed * 1000)
    passed = universe.select("key", F.lit(False).alias("listed"), F.lit(True).alias("seen")).where(first.passes(F.col("key")))
    both = passed.unionByName(listed.select("key", F.lit(True).alias("listed"), F.lit(False).alias("seen")))
    passed = checkpointed(both.groupBy("key").agg(F.max("listed").alias("listed"), F.max("seen").alias("seen")).where("seen").drop("seen"))
    totals = {r["listed"]: r["count"] for r in passed.groupBy("listed").count().collect()}
    levels, wrong, right = [first], passed.where("not listed"), passed.where("listed")
    left = totals.get(False, 0)
    if not totals.get(True, 0):
        return []
    while left:
        level = _level(wrong, left, 0.5, seed * 1000 + len(levels))
        levels.append(level)
        wrong, right = right.where(level.passes(F.col("key"))), wrong
        left = wrong.count()
    return levels


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of one url, longest first; equal lengths: longer host first."""
    names = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    heads = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    pairs = F.flatten(F.transform(ends, lambda h: F.transform(heads, lambda p: F.struct(
        -(F.length(h) + F.length(p)), -F.length(h), F.concat(h, p).alias("key")))))
    keys = F.transform(F.array_sort(pairs), lambda pair: pair["key"])
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def judge_urls(urls: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict`` to the rows of ``urls``.

    Null urls and urls without ``://`` have an empty host and path, no rule and
    the default verdict, that of a key on no list.  A rule given twice with
    both verdicts blocks.  Rows and further columns are kept as they are;
    columns named like the four results are replaced.
    """
    spark = urls.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules})
    flat = urls.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    cascades = {}
    if rules:
        keys = candidate_keys(F.col("host"), F.col("path"), lengths)
        universe = flat.select(F.explode(keys).alias("key"))
        size = urls.count() * 4 * max(1, len(lengths))
        literal = F.lit(json.dumps([{"key": h + p, "verdict": v} for h, p, v in rules]))
        given = spark.range(1).select(F.inline(F.from_json(literal, "array<struct<key:string,verdict:string>>")))
        for seed, verdict in enumerate(("block", "allow"), start=1):
            cascades[verdict] = build_cascade(universe, size, given.where(F.col("verdict") == verdict), seed)

    def listed(verdict: str, key: Column) -> Column:
        levels = cascades.get(verdict)
        return passes_cascade(levels, key) if levels else F.lit(False)

    if not any(cascades.values()):
        rule = F.lit(None).cast("string")
    else:
        rule = F.get(F.filter(candidate_keys(F.col("host"), F.col("path"), lengths), lambda k: listed("block", k) | listed("allow", k)), F.lit(0))
    found = flat.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNull(), default).when(listed("block", F.col("rule")), "block").otherwise("allow")
    return found.withColumn("verdict", verdict)
