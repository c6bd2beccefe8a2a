"""App rules, archives, UI dumps and the audit stream on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seclake.operators import app_report, classify, posture
from seclake.queries.base import ORACLES, project, query, select_sql, table
from seclake.streaming.jobs import audit_counts
from seclake.vocab import (
    ABI_ORDER,
    ENCRYPTED_PREFERENCES,
    HOSTNAME_VERIFIER_INTERFACES,
    SDK_PREFIXES,
    TRUST_MANAGER_INTERFACES,
    UI_DENY_WORDS,
)

_SLUG = "upper(trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '-', 'g'), '-'))"


def _flat(found):
    quotes = F.array_join(F.transform("evidence", lambda e: F.concat(e["location"], F.lit(" :: "), e["quote"])), "\n")
    return found.select("app_id", "rule_id", "id", "severity", quotes.alias("evidence"))


# -- parts as apps ----------------------------------------------------------------------------------
APPS = {
    "app_id": "concat('app', CAST(p_partkey AS STRING))",
    "package_name": "p_name",
    "target_sdk": "CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(p_size AS STRING) END",
    "debuggable": "CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "allow_backup": "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END",
    "uses_cleartext_traffic": "CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END",
    "test_only": "CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false END",
    "request_legacy_external_storage": "p_partkey % 8 = 0",
    "shared_user_id": "CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('uid.', p_brand) END",
    "nsc_declared": "p_partkey % 2 = 0",
    "nsc_cleartext_default": "CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "nsc_parse_error": "CASE WHEN p_size % 11 = 0 THEN 'bad' END",
}
APPS_SQL = select_sql("part", APPS)


def _apps(spark, sf_dir):
    return project(table(spark, sf_dir, "part"), APPS)


@query(
    "posture_manifest",
    f"""WITH a AS ({APPS_SQL}),
    b AS (SELECT *, CASE WHEN uses_cleartext_traffic THEN 'flag' WHEN uses_cleartext_traffic IS NULL AND nsc_declared AND nsc_parse_error IS NULL AND nsc_cleartext_default THEN 'config'
        WHEN uses_cleartext_traffic IS NULL AND NOT nsc_declared AND coalesce(TRY_CAST(target_sdk AS INT) < 28, true) THEN 'default' END AS why FROM a)
    SELECT app_id, 'android.manifest.debuggable' AS rule_id, 'ANDROID-MANIFEST-DEBUGGABLE' AS id, 'high' AS severity, 'application/@android:debuggable :: android:debuggable="true"' AS evidence FROM a WHERE debuggable
    UNION ALL SELECT app_id, 'android.manifest.test_only', 'ANDROID-MANIFEST-TEST-ONLY', 'low', 'application/@android:testOnly :: android:testOnly="true"' FROM a WHERE test_only
    UNION ALL SELECT app_id, 'android.manifest.request_legacy_external_storage', 'ANDROID-MANIFEST-LEGACY-EXTERNAL-STORAGE', 'medium', 'application/@android:requestLegacyExternalStorage :: android:requestLegacyExternalStorage="true"' FROM a WHERE request_legacy_external_storage
    UNION ALL SELECT app_id, 'android.manifest.shared_user_id', 'ANDROID-MANIFEST-SHARED-USER-ID', 'low', 'manifest/@android:sharedUserId :: android:sharedUserId="' || shared_user_id || '"' FROM a WHERE shared_user_id <> ''
    UNION ALL SELECT app_id, 'android.manifest.allow_backup', 'ANDROID-MANIFEST-ALLOW-BACKUP', 'medium', 'application/@android:allowBackup :: ' || CASE WHEN allow_backup THEN 'android:allowBackup="true"' ELSE 'android:allowBackup is absent, and absent means backup is on' END FROM a WHERE coalesce(allow_backup, true)
    UNION ALL SELECT app_id, 'android.manifest.uses_cleartext_traffic', 'ANDROID-MANIFEST-CLEARTEXT-TRAFFIC', 'high',
      CASE why WHEN 'flag' THEN 'application/@android:usesCleartextTraffic :: android:usesCleartextTraffic="true"'
        WHEN 'config' THEN 'res/xml network security config/base-config/@android:cleartextTrafficPermitted :: the base network config lets unencrypted traffic through'
        ELSE 'application/@android:usesCleartextTraffic :: neither the flag nor a network config is set; target SDK ' || coalesce(target_sdk, 'None') || ' still lets unencrypted traffic through (before Android 9)' END FROM b WHERE why IS NOT NULL""",
)
def posture_manifest(spark, sf_dir):
    return _flat(posture.manifest_findings(_apps(spark, sf_dir)))


_LEVELS = {"p_partkey": "p_partkey", "raw": "CASE p_partkey % 5 WHEN 0 THEN 'custom' WHEN 1 THEN '0x12' WHEN 2 THEN NULL ELSE CAST(p_partkey % 70 AS STRING) END"}


@query(
    "protection_levels",
    f"""WITH l AS ({select_sql('part', _LEVELS)}), v AS (SELECT *, CASE WHEN raw = '0x12' THEN 18 ELSE TRY_CAST(raw AS BIGINT) END AS v FROM l)
    SELECT p_partkey, CASE WHEN v IS NULL OR (v & 15) > 3 THEN raw ELSE (CASE v & 15 WHEN 0 THEN 'normal' WHEN 1 THEN 'dangerous' WHEN 2 THEN 'signature' ELSE 'signatureOrSystem' END)
      || CASE WHEN v - (v & 15) > 0 THEN '|0x' || lower(to_hex(v - (v & 15))) ELSE '' END END AS level FROM v""",
)
def protection_levels(spark, sf_dir):
    levels = project(table(spark, sf_dir, "part"), _LEVELS)
    return levels.select("p_partkey", posture.protection_level(F.col("raw")).alias("level"))


# -- orders as components ----------------------------------------------------------------------------
COMPONENTS = {
    "app_id": "concat('app', CAST(o_custkey AS STRING))",
    "component_type": "CASE o_orderkey % 4 WHEN 0 THEN 'provider' WHEN 1 THEN 'activity' WHEN 2 THEN 'service' ELSE 'receiver' END",
    "class_name": "concat('com.acme.C', CAST(o_orderkey AS STRING))",
    "exported_flag": "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "permission": "CASE WHEN o_orderstatus = 'P' THEN 'p' END",
    "read_permission": "CASE WHEN o_orderkey % 8 = 0 THEN 'r' ELSE '' END",
    "write_permission": "CAST(NULL AS STRING)",
    "launcher": "o_orderkey % 7 = 0",
    "browsable": "o_orderkey % 5 < 2",
    "scheme": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('app', CAST(o_custkey % 2 AS STRING)) END",
    "host": "CASE o_orderkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'h.example' END",
    "auto_verify": "o_orderkey % 2 = 0",
}
COMPONENTS_SQL = select_sql("orders", COMPONENTS)
_EXPORTED = "coalesce(exported_flag, launcher OR browsable)"


def _components(spark, sf_dir):
    flat = project(table(spark, sf_dir, "orders"), COMPONENTS)
    text = F.lit(None).cast("string")
    data = F.array(
        F.struct(F.col("scheme").alias("scheme"), F.col("host").alias("host"), F.lit("/p").alias("path"),
                 text.alias("path_pattern"), text.alias("path_prefix"), text.alias("mime_type"))
    )

    def intent(action: str, category: str, links, verify):
        return F.struct(
            F.array(F.lit(f"android.intent.action.{action}")).alias("actions"),
            F.array(F.lit(f"android.intent.category.{category}")).alias("categories"),
            links.alias("data"), verify.alias("auto_verify"),
        )

    filters = F.array_compact(
        F.array(
            F.when(F.col("launcher"), intent("MAIN", "LAUNCHER", F.slice(data, 1, 0), F.lit(False))),
            F.when(F.col("browsable"), intent("VIEW", "BROWSABLE", data, F.col("auto_verify"))),
        )
    )
    return posture.resolve_exported(flat.withColumn("intent_filters", filters))


@query(
    "posture_components",
    f"""WITH c AS ({COMPONENTS_SQL}), e AS (SELECT *, CASE WHEN exported_flag IS NULL THEN 'implicit (has intent-filter)' ELSE 'explicit' END AS how FROM c WHERE {_EXPORTED} AND permission IS NULL)
    SELECT app_id, 'android.component.exported_without_permission' AS rule_id, 'ANDROID-COMPONENT-EXPORTED-' || {_SLUG.format(x='class_name')} AS id, 'medium' AS severity,
      component_type || '[@android:name=''' || class_name || '''] :: exported=True (' || how || '), permission=none' AS evidence FROM e WHERE component_type <> 'provider' AND NOT launcher
    UNION ALL SELECT app_id, 'android.component.exported_provider_without_permission', 'ANDROID-PROVIDER-EXPORTED-' || {_SLUG.format(x='class_name')}, 'high',
      component_type || '[@android:name=''' || class_name || '''] :: exported=True (' || how || '), permission=none' FROM e WHERE component_type = 'provider' AND read_permission = ''""",
)
def posture_components(spark, sf_dir):
    return _flat(posture.component_findings(_components(spark, sf_dir)))


@query(
    "posture_deep_links",
    f"""WITH c AS ({COMPONENTS_SQL}), l AS (SELECT * FROM c WHERE browsable AND scheme <> ''),
    broad AS (SELECT app_id, scheme, host, string_agg(DISTINCT class_name, ',' ORDER BY class_name) AS cs FROM l WHERE NOT auto_verify AND (host IS NULL OR host = '*') GROUP BY app_id, scheme, host),
    coll AS (SELECT app_id, scheme, host, string_agg(DISTINCT class_name, ',' ORDER BY class_name) AS cs FROM l WHERE host = 'h.example' GROUP BY app_id, scheme, host HAVING count(DISTINCT class_name) >= 2)
    SELECT app_id, 'android.manifest.broad_deep_link' AS rule_id, 'ANDROID-DEEPLINK-BROAD-' || {_SLUG.format(x="scheme || '-' || coalesce(host, 'wildcard')")} AS id, 'medium' AS severity,
      array_to_string(list_transform(string_split(cs, ','), lambda c: c || '/intent-filter/data :: android:scheme="' || scheme || '" android:host="' || coalesce(host, '*') || '"'), chr(10)) AS evidence FROM broad
    UNION ALL SELECT app_id, 'android.manifest.deep_link_collision', 'ANDROID-DEEPLINK-COLLISION-' || {_SLUG.format(x="scheme || '-' || host")}, 'medium',
      array_to_string(list_transform(string_split(cs, ','), lambda c: c || '/intent-filter/data :: android:scheme="' || scheme || '" android:host="' || host || '"'), chr(10)) FROM coll""",
)
def posture_deep_links(spark, sf_dir):
    links = posture.deep_links(_components(spark, sf_dir))
    return _flat(posture.broad_link_findings(links).unionByName(posture.link_collision_findings(links)))


# -- customers as certificates, suppliers as native libraries --------------------------------------------
_CERTS = {"app_id": "concat('app', CAST(c_custkey AS STRING))", "subject": "CASE c_custkey % 4 WHEN 0 THEN concat('CN=Android Debug, O=', c_mktsegment) WHEN 1 THEN NULL ELSE 'CN=Acme' END"}


@query(
    "posture_certificates",
    f"""WITH c AS ({select_sql('customer', _CERTS)}) SELECT app_id, 'android.certificate.debug_signer' AS rule_id, 'ANDROID-CERT-DEBUG-SIGNER' AS id, 'info' AS severity,
    'signer/subject :: ' || subject AS evidence FROM c WHERE contains(subject, 'Android Debug')""",
)
def posture_certificates(spark, sf_dir):
    return _flat(posture.certificate_findings(project(table(spark, sf_dir, "customer"), _CERTS)))


_LIBS = {
    "app_id": "concat('app', CAST(l_suppkey AS STRING))",
    "path": "concat('lib/', CASE l_partkey % 5 WHEN 0 THEN 'x86' WHEN 1 THEN 'armeabi-v7a' WHEN 2 THEN 'mips' WHEN 3 THEN 'x86_64' ELSE 'riscv' END, '/lib', CAST(l_orderkey AS STRING), '_', CAST(l_partkey AS STRING), '.so')",
    "abi": "CASE l_partkey % 5 WHEN 0 THEN 'x86' WHEN 1 THEN 'armeabi-v7a' WHEN 2 THEN 'mips' WHEN 3 THEN 'x86_64' ELSE 'riscv' END",
    "nx_enabled": "CASE l_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN true END",
    "relro": "CASE l_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'full' END",
    "parse_error": "CASE WHEN l_orderkey % 13 = 0 THEN 'bad' END",
}
_LIBS_SQL = select_sql("lineitem", _LIBS)


def _libs(spark, sf_dir):
    return project(table(spark, sf_dir, "lineitem"), _LIBS).distinct()


@query(
    "abi_selection",
    f"""WITH l AS (SELECT DISTINCT * FROM ({_LIBS_SQL})), r AS (SELECT *, CASE abi {' '.join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(ABI_ORDER))} ELSE 4 END AS rk FROM l),
    b AS (SELECT app_id, first(abi ORDER BY rk, abi) AS abi FROM r GROUP BY app_id),
    p AS (SELECT l.app_id, l.abi, l.path, row_number() OVER (PARTITION BY l.app_id ORDER BY l.path) AS n FROM l JOIN b ON b.app_id = l.app_id AND b.abi = l.abi)
    SELECT app_id, abi, path FROM p""",
)
def abi_selection(spark, sf_dir):
    return posture.select_libraries(_libs(spark, sf_dir)).select("app_id", "abi", "path")


@query(
    "posture_native",
    f"""WITH l AS (SELECT DISTINCT * FROM ({_LIBS_SQL}))
    SELECT app_id, 'android.native.nx_disabled' AS rule_id, 'ANDROID-NATIVE-NX-DISABLED-' || {_SLUG.format(x='path')} AS id, 'medium' AS severity,
      path || ' (PT_GNU_STACK) :: the stack may be executed (flag X)' AS evidence FROM l WHERE parse_error IS NULL AND nx_enabled = false
    UNION ALL SELECT app_id, 'android.native.relro_missing', 'ANDROID-NATIVE-RELRO-MISSING-' || {_SLUG.format(x='path')}, 'low',
      path || ' :: relocations stay writable' FROM l WHERE parse_error IS NULL AND relro = 'none'""",
)
def posture_native(spark, sf_dir):
    return _flat(posture.native_findings(_libs(spark, sf_dir)))


# -- events as bytecode --------------------------------------------------------------------------------
CODE = {
    "app_id": "concat('app', CAST(user_id % 20 AS STRING))",
    "class": "concat('Lcom/acme/U', CAST(user_id AS STRING), ';')",
    "method": "CASE event_id % 4 WHEN 0 THEN 'checkServerTrusted' WHEN 1 THEN 'verify' WHEN 2 THEN 'onReceivedSslError' ELSE 'run' END",
    "idx": "event_id",
    "name": "CASE event_type WHEN 'click' THEN 'const-string' WHEN 'view' THEN 'invoke-virtual' WHEN 'signup' THEN 'invoke-static' WHEN 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'throw' ELSE 'nop' END ELSE 'move-result' END",
    "output": (
        "CASE event_type WHEN 'click' THEN CASE event_id % 5 WHEN 0 THEN 'v0, AES/ecb/PKCS5Padding' WHEN 1 THEN 'v0, md5' WHEN 2 THEN 'v0, AES/GCM' WHEN 3 THEN ' v0, SHA-1 ' ELSE 'x' END "
        "WHEN 'error' THEN '' WHEN 'purchase' THEN 'v0' ELSE CASE event_id % 11 WHEN 0 THEN 'Ljavax/crypto/Cipher;->getInstance' WHEN 1 THEN 'Ljava/security/MessageDigest;->getInstance' "
        "WHEN 2 THEN 'Ljava/util/Random;-><init>()V' WHEN 3 THEN 'Landroid/webkit/SslErrorHandler;->proceed()V' WHEN 4 THEN 'Landroid/webkit/WebSettings;->setJavaScriptEnabled(Z)V' "
        "WHEN 5 THEN 'Landroid/webkit/WebView;->addJavascriptInterface' WHEN 6 THEN 'Landroid/webkit/WebSettings;->setMixedContentMode(I)V' WHEN 7 THEN 'Landroid/content/SharedPreferences;->edit()' "
        "WHEN 8 THEN 'Landroid/webkit/WebSettings;->setAllowUniversalAccessFromFileURLs(Z)V' WHEN 9 THEN 'Landroid/webkit/WebView;->setWebContentsDebuggingEnabled(Z)V' ELSE 'La;->b()V' END END"
    ),
    "user_id": "user_id",
}
CODE_SQL = select_sql("events", {(f'"{k}"' if k in ("class", "method", "name") else k): v for k, v in CODE.items()})
_TM, _HV = TRUST_MANAGER_INTERFACES[0], HOSTNAME_VERIFIER_INTERFACES[0]


def _code(spark, sf_dir):
    return project(table(spark, sf_dir, "events"), {f"`{k}`": v for k, v in CODE.items()})


def _classes(spark, sf_dir):
    """The users' classes; some apps also ship the encrypted preferences class."""
    users = _code(spark, sf_dir).select("app_id", "class", "user_id").distinct()
    none = F.array().cast("array<string>")
    interfaces = F.when(F.col("user_id") % 3 == 0, F.array(F.lit(_TM))).when(
        F.col("user_id") % 3 == 1, F.array(F.lit("La;"), F.lit(_HV))
    ).otherwise(none)
    own = F.struct(F.col("class").alias("class"), interfaces.alias("interfaces"))
    shipped = F.struct(F.lit(ENCRYPTED_PREFERENCES).alias("class"), none.alias("interfaces"))
    listed = F.array_compact(F.array(own, F.when(F.col("user_id") % 20 % 3 == 0, shipped)))
    return users.select("app_id", F.explode(listed).alias("_c")).select("app_id", "_c.*").distinct()


@query(
    "posture_tls",
    f"""WITH c AS ({CODE_SQL}), m AS (SELECT app_id, "class", "method", user_id, count(*) AS n, bool_or("name" = 'throw') AS t FROM c GROUP BY ALL),
    p AS (SELECT *, CASE WHEN user_id % 3 = 0 AND "method" = 'checkServerTrusted' THEN 'android.tls.permissive_trust_manager' WHEN user_id % 3 = 1 AND "method" = 'verify' THEN 'android.tls.permissive_hostname_verifier' END AS rule_id FROM m WHERE NOT t)
    SELECT app_id, rule_id, 'ANDROID-TLS-' || {_SLUG.format(x='"class"')} || '-' || upper("method") AS id, 'high' AS severity,
      "class" || '->' || "method" || ' :: ' || "method" || ' never throws (body of ' || n || ' instructions)' AS evidence FROM p WHERE rule_id IS NOT NULL
    UNION ALL SELECT DISTINCT app_id, 'android.webview.ssl_error_proceed', 'ANDROID-TLS-SSL-ERROR-PROCEED-' || {_SLUG.format(x='"class"')}, 'high',
      "class" || '->onReceivedSslError :: the error handler goes on with proceed()' FROM c WHERE "method" = 'onReceivedSslError' AND starts_with("name", 'invoke') AND contains(output, 'SslErrorHandler;->proceed')""",
)
def posture_tls(spark, sf_dir):
    code = _code(spark, sf_dir)
    return _flat(posture.permissive_findings(_classes(spark, sf_dir), code).unionByName(posture.ssl_error_findings(code)))


def _webview_sql() -> str:
    rules = [
        ("ji AND js", "js_bridge_with_javascript_enabled", "JS-BRIDGE-", "high", "uses setJavaScriptEnabled together with addJavascriptInterface"),
        ("ji AND NOT js", "js_interface", "JS-INTERFACE-", "medium", "uses addJavascriptInterface"),
        ("mc", "mixed_content_mode", "MIXED-CONTENT-", "medium", "uses setMixedContentMode"),
        ("fa", "universal_file_access", "UNIVERSAL-FILE-ACCESS-", "high", "uses setAllowUniversalAccessFromFileURLs"),
        ("db", "debugging_enabled", "DEBUGGING-", "low", "uses setWebContentsDebuggingEnabled"),
    ]
    slug = _SLUG.format(x='"class"')
    union = " UNION ALL ".join(
        f"SELECT app_id, 'android.webview.{rule}' AS rule_id, 'ANDROID-WEBVIEW-{prefix}' || {slug} AS id, '{sev}' AS severity, \"class\" || ' :: {quote}' AS evidence FROM g WHERE {test}"
        for test, rule, prefix, sev, quote in rules
    )
    markers = {"js": "setJavaScriptEnabled", "ji": "addJavascriptInterface", "mc": "setMixedContentMode", "fa": "setAllowUniversalAccess", "db": "setWebContentsDebugging"}
    flags = ", ".join(f"bool_or(contains(output, '{m}')) AS {k}" for k, m in markers.items())
    return f"WITH c AS ({CODE_SQL}), g AS (SELECT app_id, \"class\", {flags} FROM c WHERE starts_with(\"name\", 'invoke') GROUP BY app_id, \"class\") {union}"


@query("posture_webview", _webview_sql())
def posture_webview(spark, sf_dir):
    return _flat(posture.webview_findings(_code(spark, sf_dir)))


@query(
    "posture_crypto",
    f"""WITH c AS ({CODE_SQL}),
    k AS (SELECT *, lag("name") OVER w AS bn, lag(output) OVER w AS bo FROM c WHERE "name" = 'const-string' OR starts_with("name", 'invoke') WINDOW w AS (PARTITION BY app_id, "class", "method" ORDER BY idx)),
    a AS (SELECT app_id, "class", "method", output, CASE WHEN bn = 'const-string' THEN coalesce(bo, '') ELSE '' END AS arg FROM k WHERE starts_with("name", 'invoke')),
    s AS (SELECT *, {_SLUG.format(x='"class"')} || '-' || {_SLUG.format(x='"method"')} AS place, "class" || '->' || "method" AS loc, coalesce(nullif(trim(arg), ''), '...') AS shown FROM a)
    SELECT app_id, 'android.crypto.ecb_cipher_mode' AS rule_id, 'ANDROID-CRYPTO-ECB-' || place AS id, 'high' AS severity, loc || ' :: Cipher.getInstance(' || shown || ')' AS evidence FROM s WHERE contains(output, 'Cipher;->getInstance') AND contains(upper(arg), 'ECB')
    UNION ALL SELECT app_id, 'android.crypto.weak_hash_algorithm', 'ANDROID-CRYPTO-WEAK-HASH-' || place, 'low', loc || ' :: MessageDigest.getInstance(' || shown || ')' FROM s WHERE contains(output, 'MessageDigest;->getInstance') AND regexp_matches(upper(arg), 'MD5|SHA-1|SHA1')
    UNION ALL SELECT DISTINCT app_id, 'android.crypto.weak_random', 'ANDROID-CRYPTO-WEAK-RANDOM-' || place, 'low', loc || ' :: java.util.Random makes predictable values' FROM s WHERE contains(output, 'Ljava/util/Random;-><init>')""",
)
def posture_crypto(spark, sf_dir):
    return _flat(posture.crypto_findings(_code(spark, sf_dir)))


@query(
    "posture_storage",
    f"""WITH c AS ({CODE_SQL}), u AS (SELECT DISTINCT app_id, "class", user_id % 20 AS a FROM c WHERE starts_with("name", 'invoke') AND contains(output, 'SharedPreferences;')),
    r AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY "class") AS n FROM u WHERE a % 3 <> 0)
    SELECT app_id, 'android.storage.shared_preferences_without_encryption' AS rule_id, 'ANDROID-STORAGE-SHARED-PREFERENCES-UNENCRYPTED' AS id, 'low' AS severity,
      string_agg("class" || ' :: reads or writes SharedPreferences', chr(10) ORDER BY "class") AS evidence FROM r GROUP BY app_id""",
)
def posture_storage(spark, sf_dir):
    return _flat(posture.storage_findings(_classes(spark, sf_dir), _code(spark, sf_dir)))


_SDK_CLASSES = {
    "app_id": "concat('app', CAST(p_size AS STRING))",
    "class": (
        "concat('L', CASE p_partkey % 7 WHEN 0 THEN 'com/facebook/react' WHEN 1 THEN 'com/facebook' WHEN 2 THEN 'okhttp3' WHEN 3 THEN 'com/google/firebase/auth' "
        "WHEN 4 THEN 'com/facebookish' WHEN 5 THEN 'okio' ELSE 'com/acme' END, '/X', CAST(p_partkey AS STRING), ';')"
    ),
}


def _sdk_sql() -> str:
    longest = sorted(SDK_PREFIXES, key=lambda item: -len(item[0]))
    path = "substr(\"class\", 2)"
    cases = " ".join(f"WHEN starts_with({path}, '{p}/') THEN '{p.replace('/', '.')}'" for p, _ in longest)
    names = " ".join(f"WHEN '{p.replace('/', '.')}' THEN '{n}'" for p, n in longest)
    source = select_sql("part", {(f'"{k}"' if k == "class" else k): v for k, v in _SDK_CLASSES.items()})
    return (
        f"WITH c AS ({source}), s AS (SELECT app_id, CASE {cases} END AS package_prefix FROM c) "
        f"SELECT app_id, CASE package_prefix {names} END AS name, package_prefix, count(*) AS class_count, "
        "CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM s WHERE package_prefix IS NOT NULL GROUP BY app_id, package_prefix"
    )


@query("sdk_fingerprints", _sdk_sql())
def sdk_fingerprints(spark, sf_dir):
    classes = project(table(spark, sf_dir, "part"), {f"`{k}`": v for k, v in _SDK_CLASSES.items()})
    return posture.sdk_fingerprints(classes)


_STRINGS = {
    "app_id": "concat('app', CAST(user_id AS STRING))",
    "idx": "event_id",
    "value": (
        "CASE event_type WHEN 'click' THEN concat('https://api.example.com/v', CAST(event_id % 7 AS STRING), '/login') WHEN 'error' THEN concat('AKIA', lpad(CAST(event_id % 40 AS STRING), 16, '0')) "
        "WHEN 'signup' THEN concat('Zk', md5(CAST(event_id AS STRING))) WHEN 'view' THEN 'AccessibilityCompatActivityImplementation' ELSE 'Please enter your name' END"
    ),
}
_STRINGS_SQL = select_sql("events", _STRINGS)


def _strings(spark, sf_dir):
    flat = project(table(spark, sf_dir, "events"), _STRINGS)
    ref = F.struct(F.lit("Lcom/acme/K;").alias("class"), F.lit("init").alias("method"))
    return flat.withColumn("xrefs", F.when(F.col("idx") % 2 == 0, F.array(ref)).otherwise(F.slice(F.array(ref), 1, 0)))


@query(
    "secret_strings",
    f"""WITH s AS ({_STRINGS_SQL}), o AS (SELECT app_id, value, min(idx) AS idx FROM s WHERE length(value) BETWEEN 8 AND 256 GROUP BY app_id, value),
    g AS (SELECT *, list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -(length(value) - length(replace(value, c, ''))) / length(value) * log2((length(value) - length(replace(value, c, ''))) / length(value)))) AS bits FROM o WHERE starts_with(value, 'Zk')),
    r AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY idx) AS n FROM g WHERE bits >= 3.5),
    a AS (SELECT app_id, idx, value, 'android.secrets.aws_access_key' AS rule_id, 'ANDROID-SECRET-' AS p, 'high' AS severity FROM o WHERE starts_with(value, 'AKIA')
      UNION ALL SELECT app_id, idx, value, 'android.secrets.generic_high_entropy', 'ANDROID-SECRET-GENERIC-', 'low' FROM r)
    SELECT app_id, rule_id, p || upper(substr(sha256(value), 1, 16)) AS id, severity,
      CASE WHEN idx % 2 = 0 THEN 'Lcom/acme/K;->init' ELSE 'string pool' END || ' :: redacted_length=' || length(value) AS evidence FROM a""",
)
def secret_strings(spark, sf_dir):
    return _flat(posture.secret_string_findings(_strings(spark, sf_dir)))


@query("network_endpoints", f"SELECT DISTINCT app_id, value FROM ({_STRINGS_SQL}) WHERE starts_with(value, 'https://')")
def network_endpoints(spark, sf_dir):
    return classify.network_endpoints(_strings(spark, sf_dir), ["app_id"])


# -- archives and UI dumps -----------------------------------------------------------------------------
_ENTRIES = {
    "archive": "concat('a', CAST(l_orderkey AS STRING))",
    "entry": (
        "CASE l_linenumber WHEN 1 THEN 'classes.dex' WHEN 2 THEN 'classes2.dex' WHEN 3 THEN 'lib/arm64-v8a/libx.so' WHEN 4 THEN 'lib/readme.so' "
        "WHEN 5 THEN CASE WHEN l_partkey % 9 = 0 THEN 'a/../../x' WHEN l_partkey % 9 = 1 THEN '/etc/x' ELSE 'res/..x.png' END WHEN 6 THEN 'classesX.dex' ELSE 'assets/y' END"
    ),
    "compressed": "CAST(l_quantity AS BIGINT) - 1",
    "uncompressed": "CAST(floor(l_extendedprice / 30) AS BIGINT)",
}


@query(
    "archive_audit",
    f"""WITH e AS ({select_sql('lineitem', _ENTRIES)}),
    s AS (SELECT archive, count(*) AS entry_count, CAST(sum(uncompressed) AS BIGINT) AS total_uncompressed, coalesce(max(CASE WHEN compressed > 0 THEN uncompressed / compressed END), 0.0) AS max_ratio,
      bool_or(starts_with(entry, '/') OR contains(entry, ':') OR list_contains(string_split(entry, '/'), '..')) AS unsafe_path,
      count(*) FILTER (regexp_matches(entry, '^classes[0-9]*\\.dex$')) AS dex_files, count(*) FILTER (regexp_matches(entry, '^lib/[^/]*/.*\\.so$')) AS native_libraries FROM e GROUP BY archive)
    SELECT archive, entry_count, total_uncompressed, round(max_ratio, 6) AS max_ratio, unsafe_path, dex_files, native_libraries,
      array_to_string(list_filter([CASE WHEN unsafe_path THEN 'unsafe entry path' END, CASE WHEN max_ratio > 100 THEN 'compression ratio too high' END], lambda x: x IS NOT NULL), ',') AS problems FROM s""",
)
def archive_audit(spark, sf_dir):
    out = posture.audit_archives(project(table(spark, sf_dir, "lineitem"), _ENTRIES))
    return out.select(
        "archive", "entry_count", "total_uncompressed", F.round("max_ratio", 6).alias("max_ratio"), "unsafe_path",
        "dex_files", "native_libraries", F.array_join("problems", ",").alias("problems"),
    )


@query(
    "archive_files",
    f"""WITH e AS ({select_sql('lineitem', _ENTRIES)}),
    s AS (SELECT archive, count(*) AS entry_count, bool_or(starts_with(entry, '/') OR contains(entry, ':') OR list_contains(string_split(entry, '/'), '..')) AS unsafe_path,
      max(CASE WHEN compressed > 0 THEN uncompressed / compressed END) > 100 AS dense FROM e GROUP BY archive)
    SELECT 'a' || page_id AS archive, strlen(html) * 100000 AS file_size, sha256(html) AS sha256, sha1(html) AS sha1, entry_count,
      array_to_string(list_filter([CASE WHEN strlen(html) * 100000 > 786432000 THEN 'file too large' END, CASE WHEN unsafe_path THEN 'unsafe entry path' END,
        CASE WHEN dense THEN 'compression ratio too high' END], lambda x: x IS NOT NULL), ',') AS problems
    FROM pages LEFT JOIN s ON archive = 'a' || page_id""",
)
def archive_files(spark, sf_dir):
    """Every page as the bytes of one archive; archives without entries keep their hashes."""
    content = F.col("html").cast("binary")
    files = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("a"), F.col("page_id").cast("string")).alias("archive"), (F.octet_length("html") * F.lit(100_000).cast("bigint")).alias("length"), content.alias("content")
    )
    out = posture.audit_archives(project(table(spark, sf_dir, "lineitem"), _ENTRIES), files)
    return out.select("archive", "file_size", "sha256", "sha1", "entry_count", F.array_join("problems", ",").alias("problems"))


@query(
    "archive_members",
    f"""WITH e AS ({select_sql('lineitem', _ENTRIES)}) SELECT archive, entry, CASE WHEN starts_with(entry, 'lib/') THEN 'native' ELSE 'dex' END AS kind,
    CASE WHEN starts_with(entry, 'lib/') THEN string_split(entry, '/')[2] END AS abi FROM e WHERE regexp_matches(entry, '^classes[0-9]*\\.dex$|^lib/[^/]*/.*\\.so$')""",
)
def archive_members(spark, sf_dir):
    return posture.archive_members(project(table(spark, sf_dir, "lineitem"), _ENTRIES))


_DUMPS = {
    "session_id": "concat('s', CAST(page_id % 12 AS STRING))",
    "seq": "page_id",
    "label": "CASE page_id % 6 WHEN 0 THEN 'Transfer &amp; go' WHEN 1 THEN 'Details' WHEN 2 THEN '' WHEN 3 THEN 'KAYDET' WHEN 4 THEN 'Profile &quot;x&quot;' ELSE '   ' END",
    "resource": "CASE page_id % 5 WHEN 0 THEN 'com.acme:id/btn_delete' WHEN 1 THEN '' ELSE 'com.acme:id/row' END",
    "tail": "CASE WHEN page_id % 10 = 9 THEN '<broken' ELSE '</hierarchy>' END",
}
_DUMPS_SQL = select_sql("pages", _DUMPS)


def _dumps(spark, sf_dir):
    flat = project(table(spark, sf_dir, "pages"), _DUMPS)
    xml = F.concat(
        F.lit('<?xml version="1.0"?><hierarchy rotation="0"><node clickable="true" text="'), "label", F.lit('" resource-id="'), "resource",
        F.lit('" bounds="[0,0][2,2]"><node clickable="false" text="send"/></node>'), "tail",
    )
    return flat.select("session_id", "seq", xml.alias("xml"))


_DENIED = (
    "(trim(label || ' ' || resource) = '' OR "
    + " OR ".join(f"contains(lower(label || ' ' || resource), '{w}')" for w in UI_DENY_WORDS)
    + ")"
)


@query(
    "ui_screen",
    f"""WITH d AS ({_DUMPS_SQL}), n AS (SELECT session_id, seq, replace(replace(label, '&amp;', '&'), '&quot;', '"') AS label, resource FROM d WHERE tail = '</hierarchy>')
    SELECT session_id, seq, 0 AS node_no, label AS text, resource AS resource_id, {_DENIED} AS denied FROM n""",
)
def ui_screen(spark, sf_dir):
    screened = posture.screen_nodes(posture.clickable_nodes(_dumps(spark, sf_dir)))
    return screened.select("session_id", "seq", "node_no", "text", "resource_id", "denied")


@query(
    "ui_screen_counts",
    f"""WITH d AS ({_DUMPS_SQL}), n AS (SELECT session_id, {_DENIED} AS denied FROM d WHERE tail = '</hierarchy>')
    SELECT session_id, count(*) AS clickable, count(*) FILTER (denied) AS blocked, count(*) FILTER (NOT denied) AS candidates FROM n GROUP BY session_id""",
)
def ui_screen_counts(spark, sf_dir):
    return posture.screening_counts(posture.screen_nodes(posture.clickable_nodes(_dumps(spark, sf_dir))))


_RULE_QUERIES = [
    "posture_manifest", "posture_components", "posture_deep_links", "posture_certificates", "posture_native", "posture_tls",
    "posture_webview", "posture_crypto", "posture_storage", "secret_strings",
]
_FOUND = " UNION ALL ".join(f"SELECT app_id, rule_id || ' ' || id || ' ' || severity || ' ' || evidence AS line FROM ({ORACLES[name]})" for name in _RULE_QUERIES)


def _code_rows(spark, sf_dir):
    """Instructions and classes of one read of the events, and the SDK classes."""
    code = _code(spark, sf_dir)
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    interfaces = F.when(F.col("user_id") % 3 == 0, F.array(F.lit(_TM))).when(F.col("user_id") % 3 == 1, F.array(F.lit("La;"), F.lit(_HV))).otherwise(none)

    def row(name, method, idx, op, output, kinds, is_class):
        columns = {"class": name, "method": method, "idx": idx, "name": op, "output": output, "interfaces": kinds, "is_class": F.lit(is_class)}
        return F.struct(*[c.alias(k) for k, c in columns.items()])

    idx, no_idx = F.col("idx").cast("bigint"), F.lit(None).cast("bigint")
    rows = F.array_compact(F.array(
        row(F.col("class"), F.col("method"), idx, F.col("name"), F.col("output"), F.lit(None).cast("array<string>"), False),
        row(F.col("class"), text, no_idx, text, text, interfaces, True),
        F.when(F.col("user_id") % 20 % 3 == 0, row(F.lit(ENCRYPTED_PREFERENCES), text, no_idx, text, text, none, True)),
    ))
    sdks = project(table(spark, sf_dir, "part"), {f"`{k}`": v for k, v in _SDK_CLASSES.items()}).withColumn("interfaces", none)
    return code.select("app_id", F.explode(rows).alias("_r")).select("app_id", "_r.*").unionByName(
        sdks.select("app_id", "class", text.alias("method"), no_idx.alias("idx"), text.alias("name"), text.alias("output"), "interfaces", F.lit(True).alias("is_class"))
    )


def _lines_sql(name: str, source: str, line: str) -> str:
    return f"{name} AS (SELECT app_id, array_to_string(list_sort(list({line})), chr(10)) AS {name} FROM ({source}) GROUP BY app_id)"


_REPORT_LISTS = {
    "findings": (_FOUND, "line"),
    "components": (COMPONENTS_SQL, "class_name || ' ' || component_type"),
    "deep_links": (f"SELECT * FROM ({COMPONENTS_SQL}) WHERE browsable AND scheme <> ''", "scheme || '://' || coalesce(host, '') || ' ' || class_name"),
    "detected_sdks": (_sdk_sql(), "name || ' ' || class_count || ' ' || confidence"),
    "network_endpoints": (f"SELECT DISTINCT app_id, value FROM ({_STRINGS_SQL}) WHERE starts_with(value, 'https://')", "value"),
    "signers": (select_sql("customer", _CERTS), "coalesce(subject, '-')"),
    "native_libraries": (f"SELECT DISTINCT app_id, path FROM ({_LIBS_SQL})", "path"),
}


@query(
    "posture_report",
    f"""WITH {', '.join(_lines_sql(name, *source) for name, source in _REPORT_LISTS.items())}
    SELECT app_id, package_name, target_sdk,
      concat_ws(' ', CASE WHEN nsc_declared THEN 'declared' END, CASE WHEN nsc_cleartext_default THEN 'cleartext' END, nsc_parse_error) AS network_config,
      {', '.join(f"coalesce({name}, '') AS {name}" for name in _REPORT_LISTS)}
    FROM ({APPS_SQL}) {' '.join(f'LEFT JOIN {name} USING (app_id)' for name in _REPORT_LISTS)}""",
)
def posture_report(spark, sf_dir):
    """All rules and lists of an app, line by line."""
    facts = {
        "apps": _apps(spark, sf_dir), "components": _components(spark, sf_dir),
        "certificates": project(table(spark, sf_dir, "customer"), _CERTS), "native_libs": _libs(spark, sf_dir),
        "code": _code_rows(spark, sf_dir), "dex_strings": _strings(spark, sf_dir),
    }
    report = app_report.posture_report(facts)

    def lines(name, line):
        return F.array_join(F.array_sort(F.transform(name, line)), "\n").alias(name)

    def space(*parts):
        return F.concat_ws(" ", *parts)

    def quotes(f):
        return F.array_join(F.transform(f["evidence"], lambda e: F.concat(e["location"], F.lit(" :: "), e["quote"])), "\n")

    nsc = F.col("network_config")
    return report.select(
        "app_id", "package_name", "target_sdk",
        F.concat_ws(" ", F.when(nsc["nsc_declared"], "declared"), F.when(nsc["nsc_cleartext_default"], "cleartext"), nsc["nsc_parse_error"]).alias("network_config"),
        lines("findings", lambda f: F.concat(f["rule_id"], F.lit(" "), f["id"], F.lit(" "), f["severity"], F.lit(" "), quotes(f))),
        lines("components", lambda c: space(c["class_name"], c["component_type"])),
        lines("deep_links", lambda l: F.concat(l["scheme"], F.lit("://"), F.coalesce(l["host"], F.lit("")), F.lit(" "), l["component_class"])),
        lines("detected_sdks", lambda d: space(d["name"], d["class_count"].cast("string"), d["confidence"])),
        lines("network_endpoints", lambda e: e["value"]), lines("signers", lambda c: F.coalesce(c["subject"], F.lit("-"))),
        lines("native_libraries", lambda n: n["path"]),
    )


@query(
    "audit_windows",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS event, count(*) AS n FROM events GROUP BY 1, 2",
)
def audit_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("event"))
    return audit_counts(events)
