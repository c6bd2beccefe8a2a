"""Retrieval quality against expectation tables.

A case's retrieved list is at most k rows and is carried as an array; the
expectation lists can be long, so they stay rows and only counts are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclake.vocab import EXTERNAL_METHODOLOGY

MEANS = {
    "recall_at_k": 1.0,
    "precision_at_k": 1.0,
    "mrr": 1.0,
    "source_type_coverage": 1.0,
    "security_domain_coverage": 1.0,
    "false_positive_source_rate": 0.0,
}


LISTS = [
    "expected_sources", "hits", "misses", "expected_source_types", "source_type_hits", "expected_security_domains", "security_domain_hits",
    "forbidden_source_hits", "retrieved_sources", "retrieved_source_types", "retrieved_security_domains",
]


def retrieved_lists(results: DataFrame) -> DataFrame:
    """case_id, rank, source, source_type, security_domains -> one row per case."""
    return results.groupBy("case_id").agg(
        F.sort_array(
            F.collect_list(F.struct("rank", "source", "source_type", "security_domains"))
        ).alias("_r")
    )


def _first_rank(rows: Column, kind: str) -> Column:
    return F.array_min(F.transform(F.filter(rows, lambda r: r["source_type"] == kind), lambda r: r["rank"]))


_LIST = "array<struct<rank:int,source:string,source_type:string,security_domains:array<string>>>"


def evaluate_retrieval(results: DataFrame, cases: DataFrame, expectations: DataFrame) -> DataFrame:
    """Per-case metrics.

    ``cases``: case_id.  ``expectations``: case_id, kind, item with kind one of
    source, forbidden, source_type, security_domain.  ``results``: see
    ``retrieved_lists``; ranks have no bound.  Beside the numbers, the lists say
    which expected items were hit or missed and what was retrieved; lists of
    items are sorted, ``retrieved_sources`` are in the order of their ranks.
    """
    lists = cases.select("case_id").distinct().join(retrieved_lists(results), "case_id", "left")
    lists = lists.select("case_id", F.coalesce(F.col("_r").cast(_LIST), F.array().cast(_LIST)).alias("_r"))
    pairs = lists.join(expectations.select("case_id", "kind", "item").distinct(), "case_id", "left")

    item = F.col("item")
    matched = F.filter("_r", lambda r: F.contains(r["source"], item))
    types = F.transform("_r", lambda r: r["source_type"])
    none = F.array().cast("array<string>")
    domains = F.flatten(F.transform("_r", lambda r: F.coalesce(r["security_domains"], none)))
    hit = (
        F.when(F.col("kind").isin("source", "forbidden"), F.size(matched) > 0)
        .when(F.col("kind") == "source_type", F.array_contains(types, item))
        .when(F.col("kind") == "security_domain", F.array_contains(domains, item))
    )
    best = F.array_min(F.transform(matched, lambda r: r["rank"]))
    checked = pairs.select(
        "case_id", "kind", "item", "_r",
        F.coalesce(hit, F.lit(False)).alias("hit"),
        F.when(F.col("kind") == "source", best).alias("best"),
        F.when(F.col("kind") == "source", F.transform(matched, lambda r: r["rank"])).alias("ranks"),
    )

    def share(kind: str, empty: float) -> Column:
        of_kind = F.col("kind") == kind
        return F.coalesce(
            F.try_divide(F.count_if(of_kind & F.col("hit")), F.count_if(of_kind)), F.lit(empty)
        )

    def items(kind: str, hit: Column) -> Column:
        return F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & hit, F.col("item"))))

    was_hit, any_ = F.col("hit"), F.lit(True)
    per_case = checked.groupBy("case_id").agg(
        F.first("_r").alias("_r"),
        items("source", any_).alias("expected_sources"),
        items("source", was_hit).alias("hits"),
        items("source", ~was_hit).alias("misses"),
        items("source_type", any_).alias("expected_source_types"),
        items("source_type", was_hit).alias("source_type_hits"),
        items("security_domain", any_).alias("expected_security_domains"),
        items("security_domain", was_hit).alias("security_domain_hits"),
        items("forbidden", was_hit).alias("forbidden_source_hits"),
        share("source", 1.0).alias("recall_at_k"),
        share("forbidden", 0.0).alias("false_positive_source_rate"),
        share("source_type", 1.0).alias("source_type_coverage"),
        share("security_domain", 1.0).alias("security_domain_coverage"),
        F.min("best").alias("_best"),
        F.collect_set("ranks").alias("_ranks"),  # few: most sources match one rank or none
    )
    relevant = F.size(F.array_distinct(F.flatten("_ranks")))
    internal, external = _first_rank(F.col("_r"), "internal"), _first_rank(F.col("_r"), EXTERNAL_METHODOLOGY)
    return per_case.select(
        "case_id",
        F.size("_r").alias("retrieved"),
        "recall_at_k",
        F.coalesce(F.try_divide(relevant, F.size("_r")), F.lit(0.0)).alias("precision_at_k"),
        F.coalesce(F.try_divide(F.lit(1.0), F.col("_best")), F.lit(0.0)).alias("mrr"),
        "source_type_coverage",
        "security_domain_coverage",
        "false_positive_source_rate",
        F.coalesce(internal < external, F.lit(True)).alias("internal_before_external_guidance"),
        *LISTS[:-3],
        F.transform("_r", lambda r: r["source"]).alias("retrieved_sources"),
        _distinct(F.transform("_r", lambda r: r["source_type"])).alias("retrieved_source_types"),
        _distinct(F.flatten(F.transform("_r", lambda r: F.coalesce(r["security_domains"], none)))).alias("retrieved_security_domains"),
    )


def _distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def summarize_eval(per_case: DataFrame) -> DataFrame:
    """Means over all cases; no cases give the neutral values."""
    means = [
        F.coalesce(F.avg(name), F.lit(neutral)).alias(f"mean_{name}") for name, neutral in MEANS.items()
    ]
    order = F.coalesce(
        F.avg(F.col("internal_before_external_guidance").cast("double")), F.lit(1.0)
    ).alias("internal_before_external_guidance_rate")
    return per_case.agg(F.count("*").alias("cases"), *means, order)
