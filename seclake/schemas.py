"""Explicit schemas of the tables the jobs read."""

HEADERS = "array<struct<name:string,value:string>>"
FLOWS = (
    "capture_id string, seq bigint, id string, method string, url string, host string, scheme string, "
    f"status_code int, request_headers {HEADERS}, request_body string, response_headers {HEADERS}, "
    "response_body string, ts timestamp, source string"
)
RAW_FLOWS = FLOWS.replace("request_body string", "request_content binary").replace(
    "response_body string", "response_content binary"
)
EVAL_CASES = (
    "query string, expected_sources array<string>, must_retrieve array<string>, "
    "expected_source_types array<string>, expected_security_domains array<string>, "
    "forbidden_sources array<string>"
)
APPS = (
    "app_id string, package_name string, target_sdk string, debuggable boolean, allow_backup boolean, "
    "uses_cleartext_traffic boolean, test_only boolean, request_legacy_external_storage boolean, "
    "shared_user_id string, nsc_declared boolean, nsc_cleartext_default boolean, nsc_parse_error string"
)
INTENT_FILTERS = (
    "array<struct<actions:array<string>,categories:array<string>,data:array<struct<scheme:string,host:string,"
    "path:string,path_pattern:string,path_prefix:string,mime_type:string>>,auto_verify:boolean>>"
)
COMPONENTS = (
    "app_id string, component_type string, class_name string, exported_flag boolean, permission string, "
    f"read_permission string, write_permission string, intent_filters {INTENT_FILTERS}"
)
CERTIFICATES = "app_id string, subject string"
NATIVE_LIBS = "app_id string, path string, abi string, nx_enabled boolean, relro string, parse_error string"
DEX_CLASSES = "app_id string, class string, interfaces array<string>"
DEX_INSTRUCTIONS = "app_id string, class string, method string, idx int, name string, output string"
DEX_STRINGS = "app_id string, idx bigint, value string, xrefs array<struct<class:string,method:string>>"
PERMISSIONS = "app_id string, name string, protection_level string"
APP_FACTS = {
    "apps": APPS,
    "components": COMPONENTS,
    "certificates": CERTIFICATES,
    "native_libs": NATIVE_LIBS,
    "dex_classes": DEX_CLASSES,
    "dex_instructions": DEX_INSTRUCTIONS,
    "dex_strings": DEX_STRINGS,
    "permissions": PERMISSIONS,
}
ARCHIVE_ENTRIES = "archive string, entry string, compressed bigint, uncompressed bigint"
UI_DUMPS = "session_id string, seq int, xml string"
AUDIT_EVENTS = "ts timestamp, event string, payload map<string,string>"
