import itertools

import pytest
from pyspark.sql import functions as F

from seclake import schemas
from seclake.operators import app_report, posture
from seclake.vocab import ENCRYPTED_PREFERENCES, HOSTNAME_VERIFIER_INTERFACES, TRUST_MANAGER_INTERFACES


def rules(df):
    return sorted((r.app_id, r.rule_id.removeprefix("android.")) for r in df.collect())


def apps(spark, **columns):
    names = [c.split(" ")[0] for c in schemas.APPS.split(", ")]
    size = max(len(v) for v in columns.values())
    rows = [
        tuple(columns.get(n, [None] * size)[i] if n != "app_id" else f"a{i}" for n in names) for i in range(size)
    ]
    return spark.createDataFrame(rows, schemas.APPS)


def test_flags_only_when_true(spark):
    df = apps(spark, debuggable=[True, False, None], test_only=[None, True, False], shared_user_id=["", None, "u"],
              request_legacy_external_storage=[False, None, True])
    assert rules(posture.flag_findings(df)) == [
        ("a0", "manifest.debuggable"), ("a1", "manifest.test_only"),
        ("a2", "manifest.request_legacy_external_storage"), ("a2", "manifest.shared_user_id"),
    ]


def test_backup_default_counts_as_allowed(spark):
    rows = {r.app_id: r.evidence[0].quote for r in posture.backup_findings(apps(spark, allow_backup=[True, False, None])).collect()}
    assert set(rows) == {"a0", "a2"} and "absent" in rows["a2"]


def test_cleartext_truth_table(spark):
    cases = list(itertools.product([True, False, None], [True, False], [True, False, None], [None, "bad"], [None, "27", "28", "x"]))
    df = apps(
        spark, uses_cleartext_traffic=[c[0] for c in cases], nsc_declared=[c[1] for c in cases],
        nsc_cleartext_default=[c[2] for c in cases], nsc_parse_error=[c[3] for c in cases], target_sdk=[c[4] for c in cases],
    )

    def expected(flag, declared, default, error, sdk):
        if flag is not None:
            return flag
        if declared:
            return not error and default is True
        return not (sdk is not None and sdk.isdigit() and int(sdk) >= 28)

    got = {r.app_id for r in posture.cleartext_findings(df).collect()}
    assert got == {f"a{i}" for i, c in enumerate(cases) if expected(*c)}


@pytest.mark.parametrize(
    "raw,level",
    [("0", "normal"), ("1", "dangerous"), ("0x2", "signature"), ("0x12", "signature|0x10"), ("18", "signature|0x10"),
     ("custom", "custom"), ("7", "7"), (None, None), ("3", "signatureOrSystem")],
)
def test_protection_levels(value, raw, level):
    assert value(posture.protection_level, raw) == level


def filters(*items):
    return [
        ([f"android.intent.action.{a}" for a in actions], [f"android.intent.category.{c}" for c in cats],
         [(s, h, "/p", None, None, None) for s, h in data], verify)
        for actions, cats, data, verify in items
    ]


VIEW = (["VIEW"], ["BROWSABLE", "DEFAULT"])


@pytest.fixture
def components(spark):
    rows = [
        ("a", "activity", "c.Main", None, None, None, None, filters((["MAIN"], ["LAUNCHER"], [], False))),
        ("a", "activity", "c.Open", None, None, None, None, filters((*VIEW, [("app", None), ("app", "h")], False))),
        ("a", "activity", "c.Same", None, "p", None, None, filters((*VIEW, [("app", "h"), ("app", "*"), ("", "x")], False))),
        ("a", "service", "c.Closed", False, None, None, None, filters((["X"], [], [], False))),
        ("a", "provider", "c.Data", True, None, None, None, []),
        ("a", "provider", "c.Read", True, "", "r", None, []),
        ("b", "activity", "c.Safe", True, None, None, None, filters((*VIEW, [("app", None)], True))),
        ("b", "receiver", "c.Bare", None, None, None, None, None),
    ]
    return posture.resolve_exported(spark.createDataFrame(rows, schemas.COMPONENTS))


def test_components(components):
    rows = {r.id: r for r in posture.component_findings(components).collect()}
    assert set(rows) == {"ANDROID-COMPONENT-EXPORTED-C-OPEN", "ANDROID-PROVIDER-EXPORTED-C-DATA", "ANDROID-COMPONENT-EXPORTED-C-SAFE"}
    assert "implicit" in rows["ANDROID-COMPONENT-EXPORTED-C-OPEN"].evidence[0].quote
    assert "explicit" in rows["ANDROID-PROVIDER-EXPORTED-C-DATA"].evidence[0].quote


def test_deep_links(components):
    links = posture.deep_links(components)
    assert links.where("scheme = ''").count() == 0
    broad = {r.id: len(r.evidence) for r in posture.broad_link_findings(links).collect()}
    assert broad == {"ANDROID-DEEPLINK-BROAD-APP-WILDCARD": 1, "ANDROID-DEEPLINK-BROAD-APP": 1}
    (collision,) = posture.link_collision_findings(links).collect()
    assert collision.id == "ANDROID-DEEPLINK-COLLISION-APP-H"
    assert [e.location for e in collision.evidence] == ["c.Open/intent-filter/data", "c.Same/intent-filter/data"]


def test_certificates_and_native(spark):
    certs = spark.createDataFrame([("a", "CN=Android Debug"), ("b", "CN=x"), ("c", None)], schemas.CERTIFICATES)
    assert rules(posture.certificate_findings(certs)) == [("a", "certificate.debug_signer")]
    libs = spark.createDataFrame(
        [("a", "lib/x86/1.so", "x86", False, "none", None), ("a", "lib/x86_64/2.so", "x86_64", True, "full", None),
         ("a", "lib/x86/3.so", "x86", False, "none", "bad"), ("b", "lib/z/1.so", "z", None, None, None), ("b", "lib/m/1.so", "m", None, "none", None)],
        schemas.NATIVE_LIBS,
    )
    assert rules(posture.native_findings(libs)) == [("a", "native.nx_disabled"), ("a", "native.relro_missing"), ("b", "native.relro_missing")]
    assert {(r.app_id, r.abi) for r in posture.select_libraries(libs).collect()} == {("a", "x86_64"), ("b", "m")}
    assert posture.select_libraries(libs.unionByName(libs.withColumn("path", F.concat("path", F.lit("x")))), 1).count() == 2


@pytest.fixture
def code(spark):
    inv = "invoke-virtual"
    rows = [
        ("a", "LT;", "checkServerTrusted", 0, "return-void", ""),
        ("a", "LS;", "checkServerTrusted", 0, "throw", "v0"),
        ("a", "LH;", "verify", 0, "const/4", "1"),
        ("a", "LW;", "onReceivedSslError", 0, inv, "Landroid/webkit/SslErrorHandler;->proceed()V"),
        ("a", "LC;", "onReceivedSslError", 0, inv, "Landroid/webkit/SslErrorHandler;->cancel()V"),
        ("a", "LW;", "x", 0, inv, "Landroid/webkit/WebSettings;->setJavaScriptEnabled(Z)V"),
        ("a", "LW;", "y", 0, inv, "Landroid/webkit/WebView;->addJavascriptInterface(x)V"),
        ("a", "LI;", "y", 0, inv, "Landroid/webkit/WebView;->addJavascriptInterface(x)V"),
        ("a", "LI;", "z", 0, "const-string", "WebSettings;->setMixedContentMode"),
        ("a", "LK;", "m", 0, "const-string", "v0, 'AES/ECB/x'"),
        ("a", "LK;", "m", 1, "move", "v0"),
        ("a", "LK;", "m", 2, "invoke-static", "Ljavax/crypto/Cipher;->getInstance(x)"),
        ("a", "LK;", "m", 3, "invoke-static", "Ljava/security/MessageDigest;->getInstance(x)"),
        ("a", "LK;", "n", 0, "const-string", " sha1 "),
        ("a", "LK;", "n", 1, "invoke-static", "Ljava/security/MessageDigest;->getInstance(x)"),
        ("a", "LK;", "n", 2, "invoke-direct", "Ljava/util/Random;-><init>()V"),
        ("a", "LK;", "n", 3, "invoke-direct", "Ljava/util/Random;-><init>(J)V"),
        ("a", "LP;", "q", 0, "invoke-interface", "Landroid/content/SharedPreferences;->edit()"),
        ("b", "LP;", "q", 0, "invoke-interface", "Landroid/content/SharedPreferences;->edit()"),
    ]
    return spark.createDataFrame(rows, schemas.DEX_INSTRUCTIONS)


@pytest.fixture
def classes(spark):
    rows = [("a", "LT;", [TRUST_MANAGER_INTERFACES[0]]), ("a", "LS;", [TRUST_MANAGER_INTERFACES[0]]), ("b", ENCRYPTED_PREFERENCES, []), ("a", "LW;", [])]
    rows += [("a", "LH;", [HOSTNAME_VERIFIER_INTERFACES[1]])]
    return spark.createDataFrame(rows, schemas.DEX_CLASSES)


def test_tls_rules(classes, code):
    rows = {r.rule_id: r for r in posture.permissive_findings(classes, code).collect()}
    assert set(rows) == {"android.tls.permissive_trust_manager", "android.tls.permissive_hostname_verifier"}
    trust = rows["android.tls.permissive_trust_manager"]
    assert trust.id == "ANDROID-TLS-LT-CHECKSERVERTRUSTED" and "body of 1 instructions" in trust.evidence[0].quote
    assert [r.id for r in posture.ssl_error_findings(code).collect()] == ["ANDROID-TLS-SSL-ERROR-PROCEED-LW"]


def test_method_without_instructions_never_throws(spark, classes, code):
    methods = spark.createDataFrame([("a", "LS;", "checkServerTrusted"), ("a", "LW;", "checkServerTrusted"), ("a", "LT;", "checkServerTrusted")], "app_id string, class string, method string")
    extra = classes.unionByName(spark.createDataFrame([("a", "LW;", [TRUST_MANAGER_INTERFACES[0]])], schemas.DEX_CLASSES))
    rows = posture.permissive_findings(extra, code, methods).where("rule_id like '%trust_manager'").collect()
    assert {r.evidence[0].artifact_path for r in rows} == {"LT;", "LW;"}


def test_webview_rules(code):
    assert rules(posture.webview_findings(code)) == [("a", "webview.js_bridge_with_javascript_enabled"), ("a", "webview.js_interface")]


def test_crypto_rules_use_the_nearest_constant(code):
    rows = {r.rule_id: r for r in posture.crypto_findings(code).collect()}
    assert set(rows) == {"android.crypto.ecb_cipher_mode", "android.crypto.weak_hash_algorithm", "android.crypto.weak_random"}
    assert rows["android.crypto.ecb_cipher_mode"].evidence[0].quote == "Cipher.getInstance(v0, 'AES/ECB/x')"
    assert rows["android.crypto.weak_hash_algorithm"].evidence[0].quote == "MessageDigest.getInstance(sha1)"
    assert posture.crypto_findings(code).count() == 3  # two constructors in one method count once


def test_storage_rule(classes, code):
    assert rules(posture.storage_findings(classes, code)) == [("a", "storage.shared_preferences_without_encryption")]


def test_sdk_prefixes(spark):
    names = ["Lcom/facebook/react/A;", "Lcom/facebook/B;", "Lcom/facebook/C;", "Lcom/facebooker/D;", "Lokio;"]
    found = posture.sdk_fingerprints(spark.createDataFrame([("a", n, []) for n in names], schemas.DEX_CLASSES)).collect()
    assert {(r.name, r.class_count, r.confidence) for r in found} == {("React Native", 1, "low"), ("Facebook SDK", 2, "medium"), ("Okio", 1, "low")}


def test_secret_strings(spark):
    key = "AKIA" + "B" * 16
    values = [key, "Please enter your username and password", "AccessibilityCompatActivityImplementation", "short1"]
    values += [f"Xk9{i}Zq7Wp2Rt5{i}Vb3Nm8Lc1Hf6" for i in range(30)] + [key]
    strings = spark.createDataFrame([("a", i, v, [("LK;", "m")] if v == key else []) for i, v in enumerate(values)], schemas.DEX_STRINGS)
    rows = posture.secret_string_findings(strings).collect()
    known = [r for r in rows if r.rule_id == "android.secrets.aws_access_key"]
    assert len(known) == 1 and known[0].evidence[0].location == "LK;->m" and key not in str(known)
    assert len(rows) == 31 and not any(v in str(r) for r in rows for v in values)
    assert posture.secret_string_findings(strings, per_app=15).count() == 16


def test_archives(spark):
    gib = 1024**3
    rows = [("ok", "classes.dex", 10, 100), ("ok", "classes2.dex", 1, 1), ("ok", "lib/x86/a.so", 0, 900), ("ok", "classesx.dex", 1, 1),
            ("up", "a/../b", 1, 1), ("abs", "\\etc", 1, 1), ("bomb", "x", 1, 101), ("big", "x", gib, 2 * gib), ("big", "y", gib, 2 * gib)]
    rows += [("many", f"f{i}", 1, 1) for i in range(20_001)]
    entries = spark.createDataFrame(rows, schemas.ARCHIVE_ENTRIES)
    files = spark.createDataFrame([(n, 1, b"abc") for n in ("ok", "up", "abs", "bomb", "big", "many")] + [("huge", 800 * 1024 * 1024, b"")], "archive string, length long, content binary")
    out = {r.archive: r for r in posture.audit_archives(entries, files).collect()}
    assert out["ok"].accepted and out["ok"].dex_files == 2 and out["ok"].native_libraries == 1
    assert out["ok"].sha1 == "a9993e364706816aba3e25717850c26c9cd0d89d"
    assert out["up"].problems == out["abs"].problems == ["unsafe entry path"]
    assert out["bomb"].problems == ["compression ratio too high"] and out["big"].problems == ["uncompressed size too large"]
    assert out["many"].problems == ["too many entries"] and out["huge"].problems == ["file too large"]
    members = {(r.entry, r.kind, r.abi) for r in posture.archive_members(entries.where("archive = 'ok'")).collect()}
    assert members == {("classes.dex", "dex", None), ("classes2.dex", "dex", None), ("lib/x86/a.so", "native", "x86")}


def test_ui_screening_fails_closed(spark):
    xml = (
        '<hierarchy rotation="0"><node clickable="true" text="Ödeme &amp; x" bounds="[0,0][1,1]"/><node clickable="false" text="a"/>'
        "<node text='Details' clickable='true' content-desc='' resource-id='id/row'/><node clickable=\"true\" text=\" \"/></hierarchy>"
    )
    dumps = spark.createDataFrame([("s", 1, xml), ("s", 2, xml.replace("</hierarchy>", "<oops")), ("t", 1, "no xml")], schemas.UI_DUMPS)
    nodes = posture.screen_nodes(posture.clickable_nodes(dumps)).orderBy("node_no").collect()
    assert [(n.text, n.denied) for n in nodes] == [("Ödeme & x", True), ("Details", False), (" ", True)]
    counts = posture.screening_counts(posture.screen_nodes(posture.clickable_nodes(dumps))).collect()
    assert [(c.session_id, c.clickable, c.blocked) for c in counts] == [("s", 3, 2)]


def test_report_joins_all_parts(spark, components, classes, code):
    facts = {
        "apps": apps(spark, debuggable=[True]).withColumn("app_id", F.lit("a")), "components": components,
        "dex_classes": classes, "dex_instructions": code,
        "permissions": spark.createDataFrame([("a", "p", "normal")], schemas.PERMISSIONS),
        "dex_strings": spark.createDataFrame([("a", 1, "https://x.example/", [])], schemas.DEX_STRINGS),
    }
    limits = spark.createDataFrame([("a", "code step timed out")], "app_id string, note string")
    row = app_report.posture_report(facts, limits).first()
    assert {f.rule_id for f in row.findings} >= {"android.manifest.debuggable", "android.crypto.weak_random", "android.manifest.deep_link_collision"}
    assert row.network_endpoints[0].value == "https://x.example/" and row.analysis_limitations[0].note == "code step timed out"
    assert len(row.components) == 6 and row.permissions[0].name == "p"


def test_the_registered_report_reads_its_tables_few_times(spark):
    import __spark_entry__ as contract

    executed = contract.queries()["posture_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < executed.count("events.parquet") <= 2 and 0 < executed.count("orders.parquet") <= 2


def test_report_equals_the_families(spark):
    """Findings of the one-pass report are those of the families one by one."""
    from seclake.queries import posture as registered

    directory = "/root/testdata/sf0.001"
    facts = {"dex_classes": registered._classes(spark, directory), "dex_instructions": registered._code(spark, directory), "dex_strings": registered._strings(spark, directory)}
    apps = facts["dex_instructions"].select("app_id").distinct()
    single = posture.posture_findings(facts)
    keys = ["app_id", "rule_id", "id", "title", "severity"]
    expected = sorted(map(str, single.join(apps, "app_id").select(*keys, F.col("evidence").cast("string").alias("e")).collect()))
    whole = app_report.posture_report({"apps": apps.select("app_id", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("package_name", "string"), ("target_sdk", "string"), ("debuggable", "boolean"), ("allow_backup", "boolean"), ("uses_cleartext_traffic", "boolean"),
        ("test_only", "boolean"), ("request_legacy_external_storage", "boolean"), ("shared_user_id", "string"), ("nsc_declared", "boolean"),
        ("nsc_cleartext_default", "boolean"), ("nsc_parse_error", "string"))]), **facts})
    got = whole.select("app_id", F.explode("findings").alias("f")).where("not startswith(f.rule_id, 'android.manifest')").select(
        "app_id", "f.rule_id", "f.id", "f.title", "f.severity", F.col("f.evidence").cast("string").alias("e"))
    assert sorted(map(str, got.collect())) == expected and len(expected) > 50


def test_report_adds_native_findings_and_catalogue_texts_after_the_shuffle(spark):
    libraries = spark.createDataFrame(
        [("a", "lib/x86/l.so", "x86", False, "none", None), ("a", "lib/x86/m.so", "x86", None, "none", None), ("a", "lib/x86/n.so", "x86", False, "none", "bad"),
         ("a", None, "x86", False, None, None), ("a", "lib/x86/l.so", "x86", False, "none", None), ("z", "lib/x86/l.so", "x86", False, "none", None)],
        "app_id string, path string, abi string, nx_enabled boolean, relro string, parse_error string",
    )
    report = app_report.posture_report({"apps": apps(spark, debuggable=[True]).withColumn("app_id", F.lit("a")), "native_libs": libraries})
    (row,) = report.collect()
    expected = posture.native_findings(libraries.where("app_id = 'a'")).drop("app_id").select(*[f for f in row.findings[0].asDict()]).collect()
    key = str
    assert sorted((f for f in row.findings if f.rule_id.startswith("android.native")), key=key) == sorted(expected, key=key) and len(expected) == 6

    def nodes(plan):
        below = plan.children()
        return [plan, *(n for i in range(below.size()) for n in nodes(below.apply(i)))]

    parts = [n for n in nodes(report._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Union"]
    assert parts and not any("impact" in p.schema().catalogString() for p in parts)
