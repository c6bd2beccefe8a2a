"""Token sets, endpoints, identifiers and vocabulary matches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seclake.functions.text import let, literal_strings
from seclake.vocab import ENDPOINT_PATTERN, IDENTIFIER_PATTERN, LEXICAL_TOKEN_PATTERN


def terms(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(LEXICAL_TOKEN_PATTERN), F.lit(0))
    return F.array_distinct(F.filter(F.transform(tokens, F.lower), lambda t: F.length(t) > 1))


def overlap_share(query_terms: Column, document_terms: Column) -> Column:
    """Share of the query terms found in the document; no terms give 0."""
    shared = F.size(F.array_intersect(query_terms, document_terms))
    return F.when(F.size(query_terms) == 0, F.lit(0.0)).otherwise(shared / F.size(query_terms))


def _by_lower_case(values: Column) -> Column:
    keyed = F.transform(values, lambda v: F.struct(F.lower(v).alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda pair: pair["v"])


def endpoints(text: Column) -> Column:
    return _by_lower_case(
        F.array_distinct(F.regexp_extract_all(text, F.lit(ENDPOINT_PATTERN), F.lit(0)))
    )


def identifiers(text: Column) -> Column:
    return _by_lower_case(
        F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER_PATTERN), F.lit(0)))
    )


def shared_terms(text: Column) -> Column:
    return _by_lower_case(
        F.array_union(
            F.regexp_extract_all(text, F.lit(ENDPOINT_PATTERN), F.lit(0)),
            F.regexp_extract_all(text, F.lit(IDENTIFIER_PATTERN), F.lit(0)),
        )
    )


def _is_word(term: str) -> bool:
    return re.fullmatch(r"\w+", term) is not None


def _phrase_pattern(term: str) -> str:
    escaped = re.sub(r"([^\w\s])", r"\\\1", term)
    return rf"(?iuU)(?<!\w){escaped}(?!\w)"


def word_set(lowered: Column) -> Column:
    return F.array_distinct(F.split(lowered, r"(?U)\W+"))


def matched_terms(lowered: Column, tokens: Column, vocabulary: list[str]) -> Column:
    """Terms of the vocabulary that occur as whole words, in vocabulary order.

    A term made of word characters only is a whole-word match exactly when it
    is one of the text's word runs, so those need a set lookup and no regular
    expression.  Phrases run their own pattern, behind a substring test.
    """
    single = [t for t in vocabulary if _is_word(t)]
    phrases = [t for t in vocabulary if not _is_word(t)]
    found = F.array_intersect(literal_strings(single), tokens) if single else None
    if phrases:
        hits = F.array_compact(
            F.array(
                *[
                    F.when(
                        F.contains(lowered, F.lit(t)) & F.rlike(lowered, F.lit(_phrase_pattern(t))),
                        F.lit(t),
                    )
                    for t in phrases
                ]
            )
        )
        found = hits if found is None else F.concat(found, hits)
    order = {t: i for i, t in enumerate(vocabulary)}
    if single and phrases:
        ranks = F.create_map(*[x for t, i in order.items() for x in (F.lit(t), F.lit(i))])
        keyed = F.transform(found, lambda t: F.struct(ranks[t].alias("i"), t.alias("t")))
        found = F.transform(F.array_sort(keyed), lambda pair: pair["t"])
    return found


def vocabulary_hits(text: Column, vocabularies: dict[str, list[str]]) -> Column:
    """array<struct<type, terms>> of the vocabularies with at least one match."""

    def per_row(lowered: Column) -> Column:
        return let(
            word_set(lowered),
            lambda tokens: F.filter(
                F.array(
                    *[
                        F.struct(
                            F.lit(name).alias("type"),
                            matched_terms(lowered, tokens, terms_).alias("terms"),
                        )
                        for name, terms_ in vocabularies.items()
                    ]
                ),
                lambda hit: F.size(hit["terms"]) > 0,
            ),
        )

    return let(F.lower(text), per_row)
