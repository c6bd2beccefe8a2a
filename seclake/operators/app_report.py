"""The nested report of an app from one pass over its facts.

Every family of facts is read once.  Instructions and classes are one frame of tagged
rows that is shuffled by class; the arguments of calls, the methods and the classes are
worked out there one after another, without another shuffle.  Each row of a family
becomes a row of one common form: the findings it gives as an array, and its entry in
one of the report's lists.  A single aggregate by app puts the report together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seclake.functions.redact import secret_kind
from seclake.operators import posture
from seclake.operators.findings import Rule, candidates, completed
from seclake.operators.posture import APP
from seclake.vocab import (
    CIPHER_MARKER,
    DIGEST_MARKER,
    ENCRYPTED_PREFERENCES,
    PREFERENCES_MARKER,
    RANDOM_MARKER,
    SDK_PREFIXES,
    SSL_ERROR_PROCEED,
    WEBVIEW_MARKERS,
)

_URL = "^https?://"


def code_rows(classes: DataFrame | None, instructions: DataFrame) -> DataFrame:
    """Instructions and classes as tagged rows: ``app_id, class, method, idx, name, output, interfaces, is_class``."""
    text = F.lit(None).cast("string")
    rows = instructions.select(APP, "class", "method", F.col("idx").cast("bigint"), "name", "output", F.lit(None).cast("array<string>").alias("interfaces"), F.lit(False).alias("is_class"))
    if classes is None:
        return rows
    owners = classes.select(
        APP, "class", text.alias("method"), F.lit(None).cast("bigint").alias("idx"), text.alias("name"), text.alias("output"),
        F.coalesce("interfaces", F.array().cast("array<string>")).alias("interfaces"), F.lit(True).alias("is_class"),
    )
    return rows.unionByName(owners)


def _calls(marker: str) -> Column:
    return F.startswith("name", F.lit("invoke")) & F.contains("output", F.lit(marker))


def class_facts(rows: DataFrame) -> DataFrame:
    """One row per class of ``code_rows``: ``found`` (candidates), ``preferences``, ``encrypted``, ``n_classes``.

    Only what a rule asks for is shuffled: constants, calls of listed methods, all
    instructions of the checks that may not throw, and the classes.  One shuffle by
    class serves the window over a method's calls and both aggregates.
    """
    checks = [method for _, method, _, _ in posture.PERMISSIVE]
    constant, call = F.col("name") == "const-string", F.startswith("name", F.lit("invoke"))
    checked = F.col("method").isin(checks)
    slim = rows.where(F.col("is_class") | constant | call | checked).select(
        APP, "class", "method", "idx", "name", "interfaces", "is_class",
        # calls of other methods only end the run of a constant
        F.when(constant | reduce(lambda a, b: a | b, [_calls(m) for m in (CIPHER_MARKER, DIGEST_MARKER, RANDOM_MARKER, SSL_ERROR_PROCEED, PREFERENCES_MARKER, *WEBVIEW_MARKERS.values())]), F.col("output")).alias("output"),
    ).repartition(APP, "class")
    in_order = Window.partitionBy(APP, "class", "method").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(constant | call, F.struct("name", "output")), ignorenulls=True).over(in_order)
    argument = F.when(before["name"] == "const-string", F.coalesce(before["output"], F.lit("")))
    staged = slim.withColumn("argument", F.coalesce(argument, F.lit("")))
    weak = F.when(_calls(CIPHER_MARKER) | _calls(DIGEST_MARKER), candidates(posture.crypto_rules()))
    methods = staged.withColumn("_weak", weak).groupBy(APP, "class", "method").agg(
        F.count_if(~F.col("is_class")).alias("n"),
        F.coalesce(F.bool_or(F.col("name") == "throw"), F.lit(False)).alias("throws"),
        F.flatten(F.collect_list(F.when(F.size("_weak") > 0, F.col("_weak")))).alias("weak"),
        *[F.coalesce(F.bool_or(_calls(m)), F.lit(False)).alias(f"calls_{name}") for name, m in {**WEBVIEW_MARKERS, "random": RANDOM_MARKER, "proceed": SSL_ERROR_PROCEED, "preferences": PREFERENCES_MARKER}.items()],
        F.count_if("is_class").alias("n_classes"),
        *[F.coalesce(F.bool_or(posture.implements(interfaces)), F.lit(False)).alias(f"is_{method}") for interfaces, method, _, _ in posture.PERMISSIVE],
    )
    plain = candidates([posture.random_rule(F.col("calls_random")), posture.ssl_error_rule((F.col("method") == "onReceivedSslError") & F.col("calls_proceed"))])
    quiet = [candidates([posture.permissive_rule(method, rule, title)]) for _, method, rule, title in posture.PERMISSIVE]
    flags = {name: F.bool_or(f"calls_{name}").alias(name) for name in [*WEBVIEW_MARKERS, "preferences"]}
    classes = methods.groupBy(APP, "class").agg(
        F.flatten(F.collect_list(F.concat("weak", plain))).alias("found"),
        *[F.flatten(F.collect_list(q)).alias(f"quiet_{method}") for q, (_, method, _, _) in zip(quiet, posture.PERMISSIVE)],
        *[F.bool_or(f"is_{method}").alias(f"is_{method}") for method in checks],
        *flags.values(), F.sum("n_classes").alias("n_classes"),
    )
    none = F.slice(F.col("found"), 1, 0)
    owned = [F.when(F.col(f"is_{method}"), F.col(f"quiet_{method}")).otherwise(none) for method in checks]
    shipped = F.col("class") == ENCRYPTED_PREFERENCES
    return classes.select(
        APP, "class", "n_classes",
        F.concat("found", *owned, candidates(posture.webview_rules())).alias("found"),
        (F.col("preferences") & ~shipped).alias("preferences"), (shipped & (F.col("n_classes") > 0)).alias("encrypted"),
    )


def _kept(df: DataFrame, part: Column, some: Callable[[Column], Column]) -> DataFrame:
    """Fields of ``part`` where ``some`` of it holds; a plain filter would compute what it tests a second time."""
    return df.select(APP, F.inline(F.filter(F.array(part), some)))


def _code_part(rows: DataFrame) -> DataFrame:
    facts = class_facts(rows)
    sdk = F.when(F.col("n_classes") > 0, posture.sdk_of(F.col("class"))["package_prefix"])
    part = F.struct(
        "found", F.when(F.col("preferences"), posture.preferences_item(F.col("class"))).alias("preferences"),
        F.when(F.col("encrypted"), True).alias("encrypted"), sdk.alias("sdk"), "n_classes",
    )
    return _kept(facts, part, lambda p: (F.size(p["found"]) > 0) | p["preferences"].isNotNull() | p["encrypted"] | p["sdk"].isNotNull())


def _string_part(strings: DataFrame) -> DataFrame:
    """Every different string of an app once, with its first place."""
    url = F.rlike("value", F.lit(_URL))
    once = strings.where(posture.secret_sized() | url).groupBy(APP, "value").agg(F.min_by("xrefs", "idx").alias("xrefs"))
    found = candidates(posture.secret_rules())
    judged = once.withColumn("_kind", F.when(posture.secret_sized(), secret_kind(F.col("value"))))
    part = F.struct(F.when(posture.secret_sized(), found).otherwise(F.slice(found, 1, 0)).alias("found"), F.when(url, F.struct("value")).alias("network_endpoints"))
    return _kept(judged, part, lambda p: (F.size(p["found"]) > 0) | p["network_endpoints"].isNotNull())


def _link_part(components: DataFrame | None, links: DataFrame | None) -> DataFrame:
    """Links by scheme and host: their list and both link rules from one aggregate."""
    links = links if links is not None else posture.deep_links(components)
    fields = [c for c in links.columns if c != APP]
    broad = ~F.col("auto_verify") & posture.open_host()
    groups = links.groupBy(APP, "scheme", "host").agg(
        F.collect_list(F.struct(*fields)).alias("deep_links"),
        F.array_sort(F.collect_set(F.when(broad, F.col("component_class")))).alias("_broad"),
        F.array_sort(F.collect_set(F.when(~posture.open_host(), F.col("component_class")))).alias("_named"),
    )
    rules = [posture.broad_link_rule("_broad"), posture.collision_rule("_named")]
    return groups.select(APP, candidates(rules).alias("found"), "deep_links")


def posture_report(facts: dict[str, DataFrame], limitations: DataFrame | None = None) -> DataFrame:
    """One nested row per app of ``facts["apps"]``: findings and the lists of its facts.

    ``facts`` holds any of the tables of the fact scan; ``code`` may give
    instructions and classes as ``code_rows``, ``files`` (app_id, length, sha256,
    sha1) the hashes, ``custom_permissions`` (app_id, name, protection_level) the
    permissions that the app declares.  Lists without facts are empty.
    """
    apps = facts["apps"]
    empty = F.lit(None).cast("string")

    def rules_of(df: DataFrame, rules: list[Rule]) -> Column:
        return candidates(rules).alias("found")

    def listed(df: DataFrame, name: str, found: Column | None = None) -> DataFrame:
        fields = [c for c in df.columns if c != APP]
        return df.select(APP, F.struct(*fields).alias(name), *([found] if found is not None else []))

    known = [c for c in ("package_name", "version_name", "version_code", "min_sdk", "target_sdk") if c in apps.columns]
    network = [c for c in ("nsc_declared", "nsc_cleartext_default", "nsc_parse_error") if c in apps.columns]
    manifest = [*posture.flag_rules(), posture.backup_rule(), posture.cleartext_rule()]
    parts = [apps.select(APP, F.struct(F.lit(True).alias("is_app"), *known, (F.struct(*network) if network else empty).alias("network_config")).alias("app"), rules_of(apps, manifest))]
    if "components" in facts:
        components = facts["components"]
        shown = F.struct("component_type", "class_name", "exported", "exported_explicit", "permission").alias("components")
        parts.append(components.select(APP, shown, rules_of(components, posture.component_rules(components))))
    if "components" in facts or "deep_links" in facts:
        parts.append(_link_part(facts.get("components"), facts.get("deep_links")))
    if "certificates" in facts:
        signers = posture.flagged_certificates(facts["certificates"])
        parts.append(signers.select(APP, F.struct("subject", "is_debug_cert").alias("signers"), rules_of(signers, [posture.debug_signer_rule()])))
    if "native_libs" in facts:
        libraries = facts["native_libs"]
        shown = F.struct("path", "abi", "nx_enabled", "relro", "parse_error").alias("native_libraries")
        parts.append(libraries.select(APP, shown))  # their findings are long and follow from what is shown: they are made after the shuffle
    if "code" in facts or "dex_instructions" in facts:
        parts.append(_code_part(facts["code"] if "code" in facts else code_rows(facts.get("dex_classes"), facts["dex_instructions"])))
    if "dex_strings" in facts:
        parts.append(_string_part(facts["dex_strings"]))
    if "permissions" in facts:
        parts.append(listed(facts["permissions"], "permissions"))
    if "custom_permissions" in facts:
        own = facts["custom_permissions"]
        parts.append(own.select(APP, F.struct("name", posture.protection_level(F.col("protection_level")).alias("protection_level")).alias("custom_permissions")))
    if "files" in facts:
        parts.append(listed(facts["files"], "files"))
    if limitations is not None:
        parts.append(listed(limitations, "analysis_limitations"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lists = [c for c in (
        "components", "signers", "native_libraries", "network_endpoints", "permissions", "custom_permissions", "files", "analysis_limitations"
    ) if c in rows.columns]
    totals = [F.max("app").alias("app"), F.flatten(F.collect_list("found")).alias("found")]
    totals += [F.sort_array(F.collect_list(c)).alias(c) for c in lists]
    if "deep_links" in rows.columns:
        totals.append(F.sort_array(F.flatten(F.collect_list("deep_links"))).alias("deep_links"))
    prefixes = [(prefix.replace("/", "."), name) for prefix, name in SDK_PREFIXES]
    if "sdk" in rows.columns:
        totals += [F.collect_list("preferences").alias("preferences"), F.coalesce(F.bool_or("encrypted"), F.lit(False)).alias("encrypted")]
        totals += [F.coalesce(F.sum(F.when(F.col("sdk") == prefix, F.col("n_classes"))), F.lit(0)).alias(f"_sdk{i}") for i, (prefix, _) in enumerate(prefixes)]
    whole = rows.groupBy(APP).agg(*totals).where("app.is_app")
    found = F.col("found")
    if "native_libraries" in rows.columns:
        found = F.concat(found, F.flatten(F.transform("native_libraries", lambda library: candidates(posture.native_rules(library.getField)))))
    if "sdk" in rows.columns:
        plain = posture.storage_rule(F.sort_array("preferences"), ~F.col("encrypted") & (F.size("preferences") > 0))
        found = F.concat(found, candidates([plain]))
        counted = F.array(*[
            F.struct(F.lit(name).alias("name"), F.lit(prefix).alias("package_prefix"), F.col(f"_sdk{i}").alias("class_count"), posture.sdk_confidence(F.col(f"_sdk{i}")).alias("confidence"))
            for i, (prefix, name) in enumerate(prefixes)
        ])
        whole = whole.withColumn("detected_sdks", F.sort_array(F.filter(counted, lambda s: s["class_count"] > 0)))
        lists.append("detected_sdks")
    if "deep_links" in rows.columns:
        lists.append("deep_links")
    return whole.select(APP, *[F.col(f"app.{c}").alias(c) for c in known], "app.network_config", F.sort_array(completed(found)).alias("findings"), *lists)
