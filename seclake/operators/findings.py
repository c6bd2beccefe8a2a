"""The shared findings row of traffic and app rules.

``findings`` turns one pass over a table into the rows of all its row-level
rules: the candidates of a row form an array that is exploded, so a table with
many rules is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seclake.vocab import RULES

_ATTRIBUTES = ["category", "severity", "status", "impact", "check", "fix"]


def evidence(kind: str, path: Column | str, location: Column | str, quote: Column | str) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else p for p in (path, location, quote)]
    return F.struct(
        F.lit(kind).alias("artifact_type"), parts[0].alias("artifact_path"), parts[1].alias("location"),
        parts[2].alias("quote"),
    )


@dataclass
class Rule:
    """One row-level rule: when it applies and what it reports."""

    rule_id: str | Column
    finding_id: str | Column
    title: str | Column
    items: Column
    test: Column | None = None
    catalogue_id: str | None = None  # where it differs from the rule id


def _column(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _attributes(rule_id: Column, rules: list[str] | None = None) -> Column:
    """Catalogue entry of a rule id, as a struct (a constant map, parsed in one go)."""
    entries = []
    for name in rules or RULES:
        fields = ", ".join(f"'{key}', {_quoted(text)}" for key, text in zip(_ATTRIBUTES, RULES[name], strict=True))
        entries.append(f"{_quoted(name)}, named_struct({fields})")
    return F.try_element_at(F.expr(f"map({', '.join(entries)})"), rule_id)


def complete(df: DataFrame, *keys: str) -> DataFrame:
    """Findings from rows with rule_id, catalogue_id, id, title and evidence."""
    entry = _attributes(F.col("catalogue_id"))
    staged = df.withColumn("_a", entry)
    return staged.select(
        *keys, "id", "rule_id", "title",
        F.col("_a.category").alias("category"), F.col("_a.severity").alias("severity"),
        F.col("_a.status").alias("status"), "evidence", F.col("_a.impact").alias("impact"),
        F.array("_a.check").alias("recommended_validation"), F.col("_a.fix").alias("remediation"),
    )


def findings(df: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """Findings of all ``rules`` in one pass; several may apply to a row."""
    found = df.select(*keys, F.explode(candidates(rules)).alias("_f"))
    return complete(found.select(*keys, "_f.*"), *keys)


def candidates(rules: list[Rule]) -> Column:
    """Findings of all ``rules`` of a row as an array, without their catalogue entries."""

    def candidate(rule: Rule) -> Column:
        row = F.struct(
            _column(rule.rule_id).alias("rule_id"), _column(rule.catalogue_id or rule.rule_id).alias("catalogue_id"),
            _column(rule.finding_id).alias("id"), _column(rule.title).alias("title"), rule.items.alias("evidence"),
        )
        return row if rule.test is None else F.when(rule.test, row)

    return F.array_compact(F.array(*[candidate(r) for r in rules]))


def completed(found: Column) -> Column:
    """An array of candidates with their catalogue entries."""

    def whole(f: Column, entry: Column) -> Column:
        return F.struct(
            f["rule_id"].alias("rule_id"), f["id"].alias("id"), f["title"].alias("title"), entry["category"].alias("category"),
            entry["severity"].alias("severity"), entry["status"].alias("status"), f["evidence"].alias("evidence"), entry["impact"].alias("impact"),
            F.array(entry["check"]).alias("recommended_validation"), entry["fix"].alias("remediation"),
        )

    # the entry is looked up once per finding, not once per field of it
    return F.transform(found, lambda f: F.get(F.transform(F.array(_attributes(f["catalogue_id"])), lambda entry: whole(f, entry)), F.lit(0)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
