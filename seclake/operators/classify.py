"""Facets, domains and signals of text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclake.functions.lexical import endpoints, identifiers, shared_terms, vocabulary_hits
from seclake.functions.text import contains_any, let
from seclake.vocab import (
    CURATED_DOMAIN_OVERRIDES,
    DEFAULT_DOMAIN,
    DOMAIN_KEYWORDS,
    FACET_TERMS,
    FALLBACK_FACET,
    QUERY_DOMAIN_TRIGGERS,
    SIGNAL_KEYWORDS,
)

# the facets whose name is not already a document domain, for callers that want
# query domains and document domains to meet (an option, off by default)
FACET_DOMAINS = {
    "authorization": "access_control",
    "authentication_session": "authentication",
    "file_handling": "file_upload",
    "ssrf_integration": "ssrf",
    "graphql_api": "graphql",
    "rate_limit_resource": "rate_limiting",
}


def facet_array(text: Column, vocabulary: dict[str, list[str]] = FACET_TERMS) -> Column:
    """array<struct<type, terms>>: sorted matches, then endpoints and identifiers."""
    hits = vocabulary_hits(text, vocabulary)

    def combine(shared: Column) -> Column:
        facets = F.transform(
            hits,
            lambda h: F.struct(
                h["type"].alias("type"), F.concat(F.array_sort(h["terms"]), shared).alias("terms")
            ),
        )
        fallback = F.array(F.struct(F.lit(FALLBACK_FACET).alias("type"), shared.alias("terms")))
        return let(
            facets,
            lambda f: F.when((F.size(f) == 0) & (F.size(shared) > 0), fallback).otherwise(f),
        )

    return let(shared_terms(text), combine)


def security_facets(
    df: DataFrame, text: str, vocabulary: dict[str, list[str]] = FACET_TERMS
) -> DataFrame:
    """One row per facet: the other columns, ``facet_no``, ``facet``, ``terms``."""
    kept = [c for c in df.columns if c != text]
    exploded = df.select(*kept, F.posexplode(facet_array(F.col(text), vocabulary)).alias("facet_no", "_f"))
    return exploded.select(*kept, "facet_no", F.col("_f.type").alias("facet"), F.col("_f.terms").alias("terms"))


def endpoint_rows(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct endpoint or identifier of each input row."""
    kept = [c for c in df.columns if c != text]
    tagged = F.concat(
        F.transform(endpoints(F.col(text)), lambda v: F.struct(F.lit("endpoint").alias("kind"), v.alias("value"))),
        F.transform(identifiers(F.col(text)), lambda v: F.struct(F.lit("identifier").alias("kind"), v.alias("value"))),
    )
    return df.select(*kept, F.explode(tagged).alias("_e")).select(*kept, "_e.kind", "_e.value")


def domain_keywords(curated_profile: bool = False) -> dict[str, list[str]]:
    return {**DOMAIN_KEYWORDS, **CURATED_DOMAIN_OVERRIDES} if curated_profile else dict(DOMAIN_KEYWORDS)


def domains_of(
    path: Column, title: Column, text: Column, keywords: dict[str, list[str]] = DOMAIN_KEYWORDS
) -> Column:
    """Domains by number of keywords found, best first; a default when none match."""
    haystack = F.translate(
        F.lower(F.concat_ws(" ", path, title, text)), "-", " "
    )

    def score(hay: Column) -> Column:
        scored = F.array(
            *[
                F.struct(
                    (-sum((F.contains(hay, F.lit(k.lower())).cast("int") for k in found), F.lit(0))).alias("rank"),
                    F.lit(name).alias("name"),
                )
                for name, found in keywords.items()
            ]
        )
        return F.transform(F.array_sort(F.filter(scored, lambda s: s["rank"] < 0)), lambda s: s["name"])

    return let(
        let(haystack, score),
        lambda names: F.when(F.size(names) == 0, F.array(F.lit(DEFAULT_DOMAIN))).otherwise(names),
    )


def classify_domains(
    df: DataFrame, path: str, title: str, text: str, keywords: dict[str, list[str]] = DOMAIN_KEYWORDS
) -> DataFrame:
    found = df.withColumn("security_domains", domains_of(F.col(path), F.col(title), F.col(text), keywords))
    return found.withColumn("security_domain", F.col("security_domains")[0])


def query_domains(
    text: Column,
    vocabulary: dict[str, list[str]] = FACET_TERMS,
    triggers: dict[str, list[str]] = QUERY_DOMAIN_TRIGGERS,
    facet_domains: dict[str, str] | None = None,
) -> Column:
    facets = F.transform(facet_array(text, vocabulary), lambda f: f["type"])
    lowered = F.lower(text)
    triggered = F.array_compact(
        F.array(*[F.when(contains_any(lowered, words), F.lit(name)) for name, words in triggers.items()])
    )
    found = F.array_union(facets, triggered)
    if facet_domains:
        mapping = F.create_map(*[F.lit(x) for pair in facet_domains.items() for x in pair])
        found = F.array_union(
            found, F.array_compact(F.transform(facets, lambda f: F.try_element_at(mapping, f)))
        )
    return found


def security_signals(
    df: DataFrame, text: str, vocabulary: dict[str, list[str]] = SIGNAL_KEYWORDS
) -> DataFrame:
    """One row per signal with its matched keywords in vocabulary order."""
    kept = [c for c in df.columns if c != text]
    exploded = df.select(*kept, F.explode(vocabulary_hits(F.col(text), vocabulary)).alias("_s"))
    return exploded.select(*kept, F.col("_s.type").alias("signal"), F.col("_s.terms").alias("keywords"))


def network_endpoints(strings: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Distinct URL-shaped strings per key."""
    return strings.where(F.rlike(F.col(value), F.lit("^https?://"))).select(*keys, value).distinct()
