"""Rules over app fact tables; many apps per job, everything keyed by ``app_id``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seclake.functions.documents import decode_entities
from seclake.functions.redact import secret_kind
from seclake.functions.text import contains_any, let, slug, strip
from seclake.operators.dedupe import first_n
from seclake.operators.findings import Rule, evidence, findings, union_all
from seclake.vocab import (
    ABI_ORDER,
    CIPHER_MARKER,
    DIGEST_MARKER,
    ENCRYPTED_PREFERENCES,
    HOSTNAME_VERIFIER_INTERFACES,
    MAX_ARCHIVE_BYTES,
    MAX_ARCHIVE_ENTRIES,
    MAX_COMPRESSION_RATIO,
    MAX_UNCOMPRESSED_BYTES,
    PREFERENCES_MARKER,
    PROTECTION_LEVELS,
    RANDOM_MARKER,
    SDK_PREFIXES,
    SECRET_ENTROPY_BITS,
    SECRET_MAX_LENGTH,
    SECRET_MIN_LENGTH,
    SSL_ERROR_PROCEED,
    TRUST_MANAGER_INTERFACES,
    UI_DENY_WORDS,
    WEAK_HASHES,
    WEBVIEW_MARKERS,
)

MANIFEST = "AndroidManifest.xml"
APP = "app_id"


def _is_set(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def _manifest_item(location: Column | str, quote: Column | str) -> Column:
    return F.array(evidence("manifest", MANIFEST, location, quote))


# -- manifest facts -----------------------------------------------------------------------


def flag_rules() -> list[Rule]:
    """Flags that count only when literally true, and the shared user id."""
    flags = [
        ("debuggable", "android.manifest.debuggable", "ANDROID-MANIFEST-DEBUGGABLE", "debuggable",
         "Debugging is switched on"),
        ("test_only", "android.manifest.test_only", "ANDROID-MANIFEST-TEST-ONLY", "testOnly",
         "Package is marked as test only"),
        ("request_legacy_external_storage", "android.manifest.request_legacy_external_storage",
         "ANDROID-MANIFEST-LEGACY-EXTERNAL-STORAGE", "requestLegacyExternalStorage",
         "Unscoped external storage is requested"),
    ]
    rules = [
        Rule(
            rule, finding, title,
            _manifest_item(f"application/@android:{attribute}", f'android:{attribute}="true"'), F.col(column),
        )
        for column, rule, finding, attribute, title in flags
    ]
    shared = F.concat(F.lit('android:sharedUserId="'), "shared_user_id", F.lit('"'))
    return [
        *rules,
        Rule(
            "android.manifest.shared_user_id", "ANDROID-MANIFEST-SHARED-USER-ID",
            F.concat(F.lit("Shared user id declared: "), "shared_user_id"),
            _manifest_item("manifest/@android:sharedUserId", shared), _is_set("shared_user_id"),
        ),
    ]


def backup_rule() -> Rule:
    """Backup is allowed unless switched off; not declared means allowed."""
    quote = F.when(F.col("allow_backup"), 'android:allowBackup="true"').otherwise(
        'android:allowBackup is absent, and absent means backup is on'
    )
    return Rule(
        "android.manifest.allow_backup", "ANDROID-MANIFEST-ALLOW-BACKUP", "App data may be backed up",
        _manifest_item("application/@android:allowBackup", quote), F.coalesce("allow_backup", F.lit(True)),
    )


def cleartext_rule() -> Rule:
    """Explicit flag, else the network config, else the target SDK's default."""
    flag, declared = F.col("uses_cleartext_traffic"), F.coalesce("nsc_declared", F.lit(False))
    sdk = F.try_to_number(strip(F.col("target_sdk")), F.lit("S999999999")).cast("int")
    config = declared & ~_is_set("nsc_parse_error") & F.coalesce("nsc_cleartext_default", F.lit(False))
    old = ~declared & F.coalesce(sdk < 28, F.lit(True))
    by_config, by_default = flag.isNull() & config, flag.isNull() & old
    quote = (
        F.when(flag, F.lit('android:usesCleartextTraffic="true"'))
        .when(by_config, F.lit('the base network config lets unencrypted traffic through'))
        .otherwise(
            F.concat(
                F.lit("neither the flag nor a network config is set; target SDK "),
                F.coalesce("target_sdk", F.lit("None")),
                F.lit(" still lets unencrypted traffic through (before Android 9)"),
            )
        )
    )
    location = F.when(
        by_config, "res/xml network security config/base-config/@android:cleartextTrafficPermitted"
    ).otherwise("application/@android:usesCleartextTraffic")
    return Rule(
        "android.manifest.uses_cleartext_traffic", "ANDROID-MANIFEST-CLEARTEXT-TRAFFIC",
        "Unencrypted traffic is permitted", _manifest_item(location, quote),
        F.coalesce(flag, F.lit(False)) | by_config | by_default,
    )


def flag_findings(apps: DataFrame) -> DataFrame:
    return findings(apps, flag_rules(), APP)


def backup_findings(apps: DataFrame) -> DataFrame:
    return findings(apps, [backup_rule()], APP)


def cleartext_findings(apps: DataFrame) -> DataFrame:
    return findings(apps, [cleartext_rule()], APP)


def manifest_findings(apps: DataFrame) -> DataFrame:
    """All manifest rules in one pass."""
    return findings(apps, [*flag_rules(), backup_rule(), cleartext_rule()], APP)


def protection_level(raw: Column) -> Column:
    """Name of a permission's base level plus extra flags; unreadable values pass through."""
    text = F.lower(strip(raw))
    digits = F.regexp_extract(text, r"^[+]?0x([0-9a-f]{1,15})$", 1)
    number = F.coalesce(
        F.when(digits != "", F.conv(digits, 16, 10)),
        F.when(F.rlike(text, F.lit(r"^[+]?(?:0+|[1-9]\d{0,17})$")), F.ltrim(text, F.lit("+"))),
    ).cast("bigint")
    names = F.create_map(*[x for k, v in PROTECTION_LEVELS.items() for x in (F.lit(k), F.lit(v))])
    base = F.try_element_at(names, number.bitwiseAND(F.lit(15)).cast("int"))
    extra = number - number.bitwiseAND(F.lit(15))
    return F.when(base.isNull(), raw).when(
        extra > 0, F.concat(base, F.lit("|0x"), F.lower(F.hex(extra)))
    ).otherwise(base)


# -- components and links -------------------------------------------------------------------


def resolve_exported(components: DataFrame, flag: str = "exported_flag") -> DataFrame:
    """``exported`` from the explicit flag, else whether an intent filter exists."""
    return components.withColumn("exported_explicit", F.col(flag).isNotNull()).withColumn(
        "exported", F.coalesce(flag, F.coalesce(F.size("intent_filters"), F.lit(0)) > 0)
    )


def _component_item() -> Column:
    source = F.when(F.col("exported_explicit"), "explicit").otherwise("implicit (has intent-filter)")
    return _manifest_item(
        F.concat("component_type", F.lit("[@android:name='"), "class_name", F.lit("']")),
        F.concat(F.lit("exported=True ("), source, F.lit("), permission=none")),
    )


def _only(values: Column, value: str) -> Column:
    return F.array_distinct(values) == F.array(F.lit(value))


def component_rules(components: DataFrame) -> list[Rule]:
    """Exported components and providers that ask for no permission."""
    launcher = F.exists(
        F.coalesce("intent_filters", F.array().cast(components.schema["intent_filters"].dataType)),
        lambda f: _only(f["actions"], "android.intent.action.MAIN")
        & _only(f["categories"], "android.intent.category.LAUNCHER"),
    )
    open_component = (F.col("component_type") != "provider") & ~_is_set("permission") & ~F.coalesce(launcher, F.lit(False))
    open_provider = (
        (F.col("component_type") == "provider")
        & ~_is_set("permission") & ~_is_set("read_permission") & ~_is_set("write_permission")
    )
    return [
        Rule(
            "android.component.exported_without_permission",
            F.concat(F.lit("ANDROID-COMPONENT-EXPORTED-"), slug(F.col("class_name"))),
            F.concat(F.lit("Open "), "component_type", F.lit(" without a permission: "), "class_name"),
            _component_item(), F.col("exported") & open_component,
        ),
        Rule(
            "android.component.exported_provider_without_permission",
            F.concat(F.lit("ANDROID-PROVIDER-EXPORTED-"), slug(F.col("class_name"))),
            F.concat(F.lit("Open content provider without a permission: "), "class_name"),
            _component_item(), F.col("exported") & open_provider,
        ),
    ]


def component_findings(components: DataFrame) -> DataFrame:
    return findings(components.where(F.col("exported")), component_rules(components), APP)


def deep_links(components: DataFrame) -> DataFrame:
    """Links of browsable view filters that name a scheme."""
    filters = components.select(APP, "class_name", F.explode("intent_filters").alias("f")).where(
        F.array_contains("f.actions", "android.intent.action.VIEW")
        & F.array_contains("f.categories", "android.intent.category.BROWSABLE")
    )
    data = filters.select(APP, "class_name", "f.auto_verify", F.explode("f.data").alias("d"))
    path = F.coalesce(*[F.nullif(F.col(f"d.{n}"), F.lit("")) for n in ("path_pattern", "path", "path_prefix")])
    return data.where(F.coalesce("d.scheme", F.lit("")) != "").select(
        APP, F.col("d.scheme").alias("scheme"), F.col("d.host").alias("host"), path.alias("path_pattern"),
        F.coalesce("auto_verify", F.lit(False)).alias("auto_verify"), F.col("class_name").alias("component_class"),
    )


def open_host() -> Column:
    """No definite host."""
    return ~_is_set("host") | (F.col("host") == "*")


def _link_groups(links: DataFrame) -> DataFrame:
    # distinct first, so repeats of one component collapse before they are collected
    once = links.select(APP, "scheme", "host", "component_class").distinct()
    return once.groupBy(APP, "scheme", "host").agg(
        F.array_sort(F.collect_list("component_class")).alias("components")
    )


def _link_items(host: Column, components: str) -> Column:
    quote = F.concat(F.lit('android:scheme="'), "scheme", F.lit('" android:host="'), host, F.lit('"'))
    return F.transform(
        components,
        lambda c: evidence("manifest", MANIFEST, F.concat(c, F.lit("/intent-filter/data")), quote),
    )


def broad_link_rule(components: str = "components") -> Rule:
    shown = F.coalesce(F.nullif("host", F.lit("")), F.lit("*"))
    first, n = F.get(components, F.lit(0)), F.size(components)
    where = F.when(
        n > 1, F.concat(F.lit(" (on "), n.cast("string"), F.lit(" components, e.g. "), first, F.lit(")"))
    ).otherwise(F.concat(F.lit(" on "), first))
    source = F.concat("scheme", F.lit("-"), F.coalesce(F.nullif("host", F.lit("")), F.lit("wildcard")))
    return Rule(
        "android.manifest.broad_deep_link", F.concat(F.lit("ANDROID-DEEPLINK-BROAD-"), slug(source)),
        F.concat(F.lit("Unverified link "), "scheme", F.lit("://"), shown, where),
        _link_items(shown, components), n > 0,
    )


def collision_rule(components: str = "components") -> Rule:
    target = F.concat("scheme", F.lit("://"), "host")
    return Rule(
        "android.manifest.deep_link_collision",
        F.concat(F.lit("ANDROID-DEEPLINK-COLLISION-"), slug(F.concat("scheme", F.lit("-"), "host"))),
        F.concat(F.lit("Link "), target, F.lit(" is claimed by "), F.size(components).cast("string"), F.lit(" components")),
        _link_items(F.col("host"), components), F.size(components) >= 2,
    )


def broad_link_findings(links: DataFrame) -> DataFrame:
    """Unverified links without a definite host, one finding per scheme and host."""
    return findings(_link_groups(links.where(~F.col("auto_verify") & open_host())), [broad_link_rule()], APP)


def link_collision_findings(links: DataFrame) -> DataFrame:
    """The same scheme and host on two or more components."""
    return findings(_link_groups(links.where(~open_host())), [collision_rule()], APP)


def flagged_certificates(certificates: DataFrame) -> DataFrame:
    """With ``is_debug_cert``, which may be derived from the subject."""
    if "is_debug_cert" in certificates.columns:
        return certificates
    return certificates.withColumn("is_debug_cert", F.contains("subject", F.lit("Android Debug")))


def debug_signer_rule() -> Rule:
    return Rule(
        "android.certificate.debug_signer", "ANDROID-CERT-DEBUG-SIGNER", "Package is signed with a debug certificate",
        F.array(evidence("certificate", "META-INF signature", "signer/subject", F.coalesce("subject", F.lit("None")))),
        F.col("is_debug_cert"),
    )


def certificate_findings(certificates: DataFrame) -> DataFrame:
    return findings(flagged_certificates(certificates), [debug_signer_rule()], APP)


# -- native libraries ---------------------------------------------------------------------


def select_libraries(libraries: DataFrame, limit: int | None = None) -> DataFrame:
    """Libraries of one ABI per app (preferred order, else the first by name); with ``limit`` the first that many."""
    rank = F.coalesce(
        *[F.when(F.col("abi") == abi, F.lit(i)) for i, abi in enumerate(ABI_ORDER)], F.lit(len(ABI_ORDER))
    )
    chosen = libraries.groupBy(APP).agg(F.min_by("abi", F.struct(rank, "abi")).alias("abi"))
    return first_n(libraries.join(chosen, [APP, "abi"]), [APP], ["path"], limit)


def native_rules(library: Callable[[str], Column] = F.col) -> list[Rule]:
    """``library`` gives a library's fields by name: columns, or fields of a struct."""
    path, readable = library("path"), library("parse_error").isNull()
    return [
        Rule(
            "android.native.nx_disabled", F.concat(F.lit("ANDROID-NATIVE-NX-DISABLED-"), slug(path)),
            F.concat(F.lit("Executable stack in "), path),
            F.array(evidence("zip_entry", path, F.concat(path, F.lit(" (PT_GNU_STACK)")),
                             "the stack may be executed (flag X)")),
            readable & ~library("nx_enabled"),
        ),
        Rule(
            "android.native.relro_missing", F.concat(F.lit("ANDROID-NATIVE-RELRO-MISSING-"), slug(path)),
            F.concat(F.lit("No RELRO in "), path),
            F.array(evidence("zip_entry", path, path, "relocations stay writable")),
            readable & (library("relro") == "none"),
        ),
    ]


def native_findings(libraries: DataFrame) -> DataFrame:
    return findings(libraries.where("parse_error is null"), native_rules(), APP)


# -- code ---------------------------------------------------------------------------------


def _code_item(location: Column, quote: Column | str) -> Column:
    return F.array(evidence("dex_code", F.col("class"), location, quote))


def _method_location() -> Column:
    return F.concat("class", F.lit("->"), "method")


def _calls(marker: str) -> Column:
    return F.startswith("name", F.lit("invoke")) & F.contains("output", F.lit(marker))


def method_stats(instructions: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """Instruction count and presence of a throw per method.

    ``methods`` adds methods without any instruction.
    """
    keys = [APP, "class", "method"]
    stats = instructions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.bool_or(F.col("name") == "throw").alias("throws")
    )
    if methods is not None:
        stats = methods.select(*keys).distinct().join(stats, keys, "left").na.fill(0, ["n"])
    return stats.withColumn("throws", F.coalesce("throws", F.lit(False)))


PERMISSIVE = [
    (TRUST_MANAGER_INTERFACES, "checkServerTrusted", "android.tls.permissive_trust_manager",
     "Trust manager seems to accept every certificate: "),
    (HOSTNAME_VERIFIER_INTERFACES, "verify", "android.tls.permissive_hostname_verifier",
     "Host name verifier seems to accept every name: "),
]


def implements(interfaces: list[str]) -> Column:
    return F.arrays_overlap("interfaces", F.array(*[F.lit(i) for i in interfaces]))


def permissive_rule(method: str, rule: str, title: str) -> Rule:
    """A method's row with its instruction count ``n``."""
    quote = F.concat(F.lit(f"{method} never throws (body of "), F.col("n").cast("string"), F.lit(" instructions)"))
    return Rule(
        rule, F.concat(F.lit("ANDROID-TLS-"), slug(F.col("class")), F.lit(f"-{method.upper()}")),
        F.concat(F.lit(title), "class", F.lit(f".{method}")), _code_item(_method_location(), quote),
        (F.col("method") == method) & ~F.col("throws"),
    )


def permissive_findings(classes: DataFrame, instructions: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """Trust managers and host name verifiers whose check never throws."""
    frames = []
    for interfaces, method, rule, title in PERMISSIVE:
        owners = classes.where(implements(interfaces)).select(APP, "class").distinct()
        # only instructions of the one method name reach the shuffle
        named = instructions.where(F.col("method") == method)
        extra = None if methods is None else methods.where(F.col("method") == method)
        quiet = method_stats(named, extra).where(~F.col("throws")).join(owners, [APP, "class"], "left_semi")
        frames.append(findings(quiet, [permissive_rule(method, rule, title)], APP))
    return union_all(frames)


def ssl_error_rule(test: Column | None = None) -> Rule:
    return Rule(
        "android.webview.ssl_error_proceed", F.concat(F.lit("ANDROID-TLS-SSL-ERROR-PROCEED-"), slug(F.col("class"))),
        F.concat(F.lit("Certificate errors are ignored in "), "class", F.lit(".onReceivedSslError")),
        _code_item(_method_location(), "the error handler goes on with proceed()"), test,
    )


def ssl_error_findings(instructions: DataFrame) -> DataFrame:
    hit = instructions.where((F.col("method") == "onReceivedSslError") & _calls(SSL_ERROR_PROCEED))
    return findings(hit.select(APP, "class", "method").distinct(), [ssl_error_rule()], APP)


def webview_rules() -> list[Rule]:
    """Class-level combinations of web view settings, given as flags."""
    rules = [
        (F.col("js_interface") & F.col("js_enabled"), "android.webview.js_bridge_with_javascript_enabled",
         "ANDROID-WEBVIEW-JS-BRIDGE-", "JavaScript bridge with JavaScript on: ",
         "uses setJavaScriptEnabled together with addJavascriptInterface"),
        (F.col("js_interface") & ~F.col("js_enabled"), "android.webview.js_interface",
         "ANDROID-WEBVIEW-JS-INTERFACE-", "JavaScript interface: ", "uses addJavascriptInterface"),
        (F.col("mixed_content"), "android.webview.mixed_content_mode",
         "ANDROID-WEBVIEW-MIXED-CONTENT-", "Mixed-content mode is set: ", "uses setMixedContentMode"),
        (F.col("file_access"), "android.webview.universal_file_access",
         "ANDROID-WEBVIEW-UNIVERSAL-FILE-ACCESS-", "File pages may reach every origin: ",
         "uses setAllowUniversalAccessFromFileURLs"),
        (F.col("debugging"), "android.webview.debugging_enabled",
         "ANDROID-WEBVIEW-DEBUGGING-", "Page debugging is on: ", "uses setWebContentsDebuggingEnabled"),
    ]
    return [
        Rule(rule, F.concat(F.lit(prefix), slug(F.col("class"))), F.concat(F.lit(title), "class"),
             _code_item(F.col("class"), quote), test)
        for test, rule, prefix, title, quote in rules
    ]


def webview_findings(instructions: DataFrame) -> DataFrame:
    marked = instructions.where(F.startswith("name", F.lit("invoke")) & contains_any(F.col("output"), list(WEBVIEW_MARKERS.values())))
    flags = marked.groupBy(APP, "class").agg(
        *[F.bool_or(F.contains("output", F.lit(m))).alias(name) for name, m in WEBVIEW_MARKERS.items()]
    )
    return findings(flags, webview_rules(), APP)


def call_arguments(instructions: DataFrame) -> DataFrame:
    """Every invoke with the string constant right before it, '' when there is none.

    Only constants and invokes matter, so other instructions are dropped first
    and the argument is the previous remaining row if that is a constant.
    """
    kept = instructions.where((F.col("name") == "const-string") | F.startswith("name", F.lit("invoke")))
    window = Window.partitionBy(APP, "class", "method").orderBy("idx")
    before = F.lag(F.struct("name", "output")).over(window)
    staged = kept.withColumn("_before", before).where(F.startswith("name", F.lit("invoke")))
    argument = F.when(F.col("_before.name") == "const-string", F.coalesce("_before.output", F.lit("")))
    return staged.withColumn("argument", F.coalesce(argument, F.lit(""))).drop("_before")


def _crypto_id(prefix: str) -> Column:
    return F.concat(F.lit(f"ANDROID-CRYPTO-{prefix}-"), slug(F.col("class")), F.lit("-"), slug(F.col("method")))


def crypto_rules() -> list[Rule]:
    """A call's row with its ``argument``."""
    name = F.concat("class", F.lit("."), "method")
    shown = F.coalesce(F.nullif(strip(F.col("argument")), F.lit("")), F.lit("..."))
    upper = F.upper("argument")
    algorithm = F.coalesce(*[F.when(F.contains(upper, F.lit(a)), F.lit(a)) for a in WEAK_HASHES])
    return [
        Rule(
            "android.crypto.ecb_cipher_mode", _crypto_id("ECB"), F.concat(F.lit("ECB mode in "), name),
            _code_item(_method_location(), F.concat(F.lit("Cipher.getInstance("), shown, F.lit(")"))),
            _calls(CIPHER_MARKER) & F.contains(upper, F.lit("ECB")),
        ),
        Rule(
            "android.crypto.weak_hash_algorithm", _crypto_id("WEAK-HASH"),
            F.concat(F.lit("Weak digest "), algorithm, F.lit(" in "), name),
            _code_item(_method_location(), F.concat(F.lit("MessageDigest.getInstance("), shown, F.lit(")"))),
            _calls(DIGEST_MARKER) & algorithm.isNotNull(),
        ),
    ]


def random_rule(test: Column | None = None) -> Rule:
    return Rule(
        "android.crypto.weak_random", _crypto_id("WEAK-RANDOM"), F.concat(F.lit("Predictable random in "), "class", F.lit("."), "method"),
        _code_item(_method_location(), "java.util.Random makes predictable values"), test,
    )


def crypto_findings(instructions: DataFrame) -> DataFrame:
    calls = call_arguments(instructions).where(_calls(CIPHER_MARKER) | _calls(DIGEST_MARKER))
    by_argument = findings(calls, crypto_rules(), APP)
    random = findings(instructions.where(_calls(RANDOM_MARKER)).select(APP, "class", "method").distinct(), [random_rule()], APP)
    return by_argument.unionByName(random)


def preferences_item(name: Column) -> Column:
    return evidence("dex_code", name, name, "reads or writes SharedPreferences")


def storage_rule(items: Column, test: Column | None = None) -> Rule:
    return Rule(
        "android.storage.shared_preferences_without_encryption", "ANDROID-STORAGE-SHARED-PREFERENCES-UNENCRYPTED",
        "Plain preferences and no encrypted ones in the app", items, test,
    )


def storage_findings(classes: DataFrame, instructions: DataFrame, shown: int | None = None) -> DataFrame:
    """Plain preferences in an app that ships no encrypted variant; all classes are evidence unless ``shown`` limits them."""
    encrypted = classes.where(F.col("class") == ENCRYPTED_PREFERENCES).select(APP).distinct()
    users = (
        instructions.where(_calls(PREFERENCES_MARKER) & (F.col("class") != ENCRYPTED_PREFERENCES))
        .select(APP, "class").distinct().join(encrypted, APP, "left_anti")
    )
    first = first_n(users, [APP], ["class"], shown)
    grouped = first.groupBy(APP).agg(F.sort_array(F.collect_list(preferences_item(F.col("class")))).alias("_items"))
    return findings(grouped, [storage_rule(F.col("_items"))], APP)


def sdk_of(name: Column) -> Column:
    """SDK of a class (name, package_prefix), by the longest prefix."""
    path = F.substring_index(F.regexp_replace(name, "^L", ""), ";", 1)
    longest = sorted(SDK_PREFIXES, key=lambda item: -len(item[0]))

    def match(p: Column) -> Column:
        return F.coalesce(
            *[
                F.when(
                    (p == prefix) | F.startswith(p, F.lit(prefix + "/")),
                    F.struct(F.lit(sdk).alias("name"), F.lit(prefix.replace("/", ".")).alias("package_prefix")),
                )
                for prefix, sdk in longest
            ]
        )

    return let(path, match)


def sdk_confidence(n: Column) -> Column:
    return F.when(n >= 5, "high").when(n >= 2, "medium").otherwise("low")


def sdk_fingerprints(classes: DataFrame) -> DataFrame:
    """SDKs by the longest package prefix of each class."""
    found = classes.withColumn("_sdk", sdk_of(F.col("class"))).where("_sdk is not null")
    counts = found.groupBy(APP, "_sdk.name", "_sdk.package_prefix").agg(F.count("*").alias("class_count"))
    return counts.withColumn("confidence", sdk_confidence(F.col("class_count")))


def entropy_bits(text: Column) -> Column:
    """Shannon entropy of the characters of a short text, in bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def bits(c: Column) -> Column:
        n = F.size(c).cast("double")
        shares = F.transform(
            F.array_distinct(c), lambda d: F.size(F.filter(c, lambda x: x == d)).cast("double") / n
        )
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return let(chars, bits)


def secret_sized() -> Column:
    length = F.length("value")
    return (length >= SECRET_MIN_LENGTH) & (length <= SECRET_MAX_LENGTH)


def secret_rules() -> list[Rule]:
    """Rows with ``value, xrefs`` and ``_kind``, the known shape or null; no finding repeats the value."""
    xref = F.try_element_at("xrefs", F.lit(1))
    where = F.when(xref.isNotNull(), F.concat(xref["class"], F.lit("->"), xref["method"])).otherwise("string pool")
    path = F.coalesce(xref["class"], F.lit("classes.dex"))
    tag = F.upper(F.substring(F.sha2("value", 256), 1, 16))
    item = F.array(
        evidence("dex_code", path, where, F.concat(F.lit("redacted_length="), F.length("value").cast("string")))
    )
    tokenish = F.rlike("value", F.lit(r"^[A-Za-z0-9+/=_\-]{20,}$")) & F.rlike("value", F.lit(r"\d")) & F.rlike("value", F.lit("[A-Za-z]"))
    random = F.when(F.col("_kind").isNull() & tokenish, entropy_bits(F.col("value")) >= SECRET_ENTROPY_BITS).otherwise(False)
    return [
        Rule(
            F.concat(F.lit("android.secrets."), "_kind"), F.concat(F.lit("ANDROID-SECRET-"), tag),
            F.concat(F.lit("Secret-shaped string in the app: "), "_kind"), item, F.col("_kind").isNotNull(), "android.secrets.known_pattern",
        ),
        Rule(
            "android.secrets.generic_high_entropy", F.concat(F.lit("ANDROID-SECRET-GENERIC-"), tag),
            "Random-looking string in the app", item, random,
        ),
    ]


def secret_string_findings(strings: DataFrame, per_app: int | None = None) -> DataFrame:
    """Known secret shapes, and other random-looking strings with digits, up to ``per_app`` if given.

    ``strings``: app_id, idx, value, xrefs.
    """
    once = first_n(strings.where(secret_sized()), [APP, "value"], ["idx"], 1).withColumn("_kind", secret_kind(F.col("value")))
    known, generic = secret_rules()
    known_rows = findings(once.where("_kind is not null"), [known], APP)
    capped = first_n(once.where(generic.test), [APP], ["idx"], per_app)
    generic.test = None
    return known_rows.unionByName(findings(capped, [generic], APP))


# -- archives, UI dumps, report --------------------------------------------------------------


def audit_archives(entries: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Checks and inventory per archive.

    ``entries``: archive, entry, compressed, uncompressed.  ``files``: archive,
    length and, when hashes are wanted, content.
    """
    name = F.replace("entry", F.lit("\\"), F.lit("/"))
    unsafe = (
        F.startswith(name, F.lit("/")) | F.contains(name, F.lit(":")) | F.array_contains(F.split(name, "/"), "..")
    )
    ratio = F.when(F.col("compressed") > 0, F.col("uncompressed") / F.col("compressed"))
    dex = F.rlike("entry", F.lit(r"^classes\d*\.dex$"))
    native = F.rlike("entry", F.lit(r"^lib/[^/]*/.*\.so$"))
    stats = entries.groupBy("archive").agg(
        F.count("*").alias("entry_count"),
        F.sum("uncompressed").alias("total_uncompressed"),
        F.coalesce(F.max(ratio), F.lit(0.0)).alias("max_ratio"),
        F.bool_or(unsafe).alias("unsafe_path"),
        F.count_if(dex).alias("dex_files"),
        F.count_if(native).alias("native_libraries"),
    )
    problems = [
        ("too many entries", F.col("entry_count") > MAX_ARCHIVE_ENTRIES),
        ("unsafe entry path", F.col("unsafe_path")),
        ("compression ratio too high", F.col("max_ratio") > MAX_COMPRESSION_RATIO),
        ("uncompressed size too large", F.col("total_uncompressed") > MAX_UNCOMPRESSED_BYTES),
    ]
    if files is not None:
        facts = [F.col("archive"), F.col("length").alias("file_size")]
        if "content" in files.columns:
            facts += [F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1")]
        stats = stats.join(files.select(*facts), "archive", "right")
        problems.insert(0, ("file too large", F.col("file_size") > MAX_ARCHIVE_BYTES))
    found = F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in problems]))
    return stats.withColumn("problems", found).withColumn("accepted", F.size("problems") == 0)


def archive_members(entries: DataFrame) -> DataFrame:
    """Code files and native libraries with their ABI."""
    native = F.rlike("entry", F.lit(r"^lib/[^/]*/.*\.so$"))
    kind = F.when(F.rlike("entry", F.lit(r"^classes\d*\.dex$")), "dex").when(native, "native")
    return (
        entries.withColumn("kind", kind).where("kind is not null")
        .select("archive", "entry", "kind", F.when(native, F.split("entry", "/")[1]).alias("abi"))
    )


def clickable_nodes(dumps: DataFrame, xml: str = "xml") -> DataFrame:
    """Clickable nodes of UI dumps; a malformed dump has none.

    Attributes are read per node, so a missing one shifts nothing.
    """
    kept = [c for c in dumps.columns if c != xml]
    probe = F.from_xml(F.col(xml), "_corrupt_record string, `_rotation` string")
    readable = dumps.where(probe["_corrupt_record"].isNull() & F.contains(xml, F.lit("<")))
    nodes = readable.select(
        *kept, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"<node\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+>"), F.lit(0))).alias("node_no", "_n")
    )

    def attribute(name: str) -> Column:
        raw = F.regexp_extract("_n", rf"\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
        other = F.regexp_extract("_n", rf"\s{name}\s*=\s*'([^']*)'", 1)
        return decode_entities(F.when(raw != "", raw).otherwise(other))

    return nodes.where(attribute("clickable") == "true").select(
        *kept, "node_no", attribute("text").alias("text"), attribute("content-desc").alias("content_desc"),
        attribute("resource-id").alias("resource_id"), attribute("class").alias("class_name"),
        attribute("bounds").alias("bounds"),
    )


def is_denied(text: Column, description: Column, resource: Column, words: list[str] = UI_DENY_WORDS) -> Column:
    """A node is denied by a listed word, or when nothing about it can be read."""
    searchable = F.lower(F.concat(text, F.lit(" "), description, F.lit(" "), resource))
    return let(searchable, lambda s: (strip(s) == "") | contains_any(s, [w.lower() for w in words]))


def screen_nodes(nodes: DataFrame, words: list[str] = UI_DENY_WORDS) -> DataFrame:
    denied = is_denied(F.col("text"), F.col("content_desc"), F.col("resource_id"), words)
    return nodes.withColumn("denied", denied)


def screening_counts(screened: DataFrame, key: str = "session_id") -> DataFrame:
    return screened.groupBy(key).agg(
        F.count("*").alias("clickable"), F.count_if("denied").alias("blocked"),
        F.count_if(~F.col("denied")).alias("candidates"),
    )


def posture_findings(facts: dict[str, DataFrame]) -> DataFrame:
    """All app rules the given fact tables allow (keys as in the fact scan)."""
    frames = []
    if "apps" in facts:
        frames.append(manifest_findings(facts["apps"]))
    if "components" in facts:
        links = facts.get("deep_links") or deep_links(facts["components"])
        frames += [component_findings(facts["components"]), broad_link_findings(links), link_collision_findings(links)]
    if "certificates" in facts:
        frames.append(certificate_findings(facts["certificates"]))
    if "native_libs" in facts:
        frames.append(native_findings(facts["native_libs"]))
    if "dex_instructions" in facts:
        code = facts["dex_instructions"]
        frames += [ssl_error_findings(code), webview_findings(code), crypto_findings(code)]
        if "dex_classes" in facts:
            frames += [permissive_findings(facts["dex_classes"], code), storage_findings(facts["dex_classes"], code)]
    if "dex_strings" in facts:
        frames.append(secret_string_findings(facts["dex_strings"]))
    return union_all(frames)
