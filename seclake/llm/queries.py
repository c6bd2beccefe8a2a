"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seclake.llm import alignment, ann, decontamination, main_text, mixing, quality, simhash, spelling, suffix_dedup, token_counts, toxicity, url_filter, warc
from seclake.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- 1 -----------------------------------------------------------------------------------------
@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, located=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "worst_start")


# -- 2 -----------------------------------------------------------------------------------------
@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, path, limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


# -- 3 -----------------------------------------------------------------------------------------
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
OP3_SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path,
       CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} END AS rule,
       CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _BY_LENGTH)} ELSE 'allow' END AS verdict
FROM parts
"""


@query("op3_url_filter", OP3_SQL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# -- 4 -----------------------------------------------------------------------------------------
OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS o
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM sizes),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS t, sum(w) AS w FROM weighed),
ordered AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
         coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM weighed),
tested AS (SELECT o.*, t.t - taken AS rest, t.w - used AS open, (t.t - taken) * o.w / (t.w - used) > cap AS above FROM ordered o, total t),
first_open AS (SELECT rest, open, cap / w AS edge FROM tested WHERE NOT above ORDER BY cap / w, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN above OR NOT EXISTS (SELECT 1 FROM first_open) THEN cap ELSE (SELECT rest FROM first_open) * w / (SELECT open FROM first_open) END AS target
  FROM tested),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS whole FROM targets),
orders AS (SELECT source, o, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, o),
running AS (SELECT *, CAST(sum(words) OVER (PARTITION BY source ORDER BY o) AS BIGINT) AS upto FROM orders)
SELECT s.doc_id, s.size, p.source_size, p.target,
       CAST(s.size * least(3, p.whole + CASE WHEN greatest(0.0, p.target - p.whole * p.source_size) > 0
            AND (2 * r.upto - r.words) / 2.0 <= greatest(0.0, p.target - p.whole * p.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
JOIN running r ON s.source IS NOT DISTINCT FROM r.source AND s.o = r.o
"""


def ranked_weights(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Sources by code point, null last, get the weights in turn."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1  # one row per source
    listed = F.array(*map(F.lit, weights))
    return docs.select("source").distinct().select("source", F.get(listed, (place % len(weights)).cast("int")).alias("weight"))


@query("op4_mixing", OP4_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, ranked_weights(docs), max_epochs=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# -- 5 -----------------------------------------------------------------------------------------
@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


# -- 6 -----------------------------------------------------------------------------------------
@query("op6_nearest")
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    return ann.nearest(vectors, queries, k=5)


# -- 7: pages as captures; addresses without their numbers recur, every fourth capture has a body --------
def _slot(width: int) -> str:
    return f"CAST(CAST(floor(page_id / {width}.0) AS BIGINT) AS STRING)"


CAPTURES = {
    "record_id": "page_id",
    "type": "CASE WHEN page_id % 4 = 0 THEN 'response' ELSE 'revisit' END",
    "status_code": "CASE WHEN page_id % 4 > 0 THEN 304 WHEN page_id % 20 = 0 THEN 404 ELSE 200 END",
    "tag": f"CASE WHEN page_id % 5 < 4 THEN concat(CASE WHEN page_id % 2 = 1 THEN 'W/' ELSE '' END, '\"v', {_slot(2000)}, '\"') END",
    "modified": f"CASE WHEN page_id % 7 > 0 THEN concat('day ', {_slot(1500)}) END",
    "cache": "concat('max-age=', CAST(page_id % 9 AS STRING))",
    "content": "CASE WHEN page_id % 4 = 0 THEN 'text/html' ELSE 'text/plain' END",
    "x_cache": "CASE WHEN page_id % 3 = 0 AND page_id % 4 > 0 THEN 'HIT' END",
    "payload_digest": "CASE WHEN page_id % 4 = 0 THEN md5(html) END",
}
OP7_SQL = f"""
WITH captures AS (
  SELECT {', '.join(f'{e} AS {n}' for n, e in CAPTURES.items())},
         regexp_replace(regexp_replace(regexp_replace(url, '[0-9]+', '', 'g'), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS rest
  FROM pages),
parted AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'),
                lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({', '.join(f"'{t}'" for t in warc.TRACKING)}))) AS pairs
  FROM captures),
keyed AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\\.', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
            || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS canonical
  FROM parted),
whole AS (SELECT * FROM keyed WHERE type = 'response' AND status_code = 200),
joined AS (
  SELECT r.*, s.record_id AS s_id, s.tag AS s_tag, s.modified AS s_modified, s.payload_digest AS s_digest, s.content AS s_content, s.cache AS s_cache,
         CASE WHEN r.tag IS NOT NULL THEN CASE WHEN replace(r.tag, 'W/', '') = replace(s.tag, 'W/', '') THEN 'etag' END
              WHEN r.modified IS NOT NULL THEN CASE WHEN r.modified = s.modified THEN 'last_modified' END ELSE 'none' END AS vouched
  FROM keyed r ASOF LEFT JOIN whole s ON r.canonical = s.canonical AND r.record_id > s.record_id),
judged AS (
  SELECT *, CASE WHEN type = 'response' THEN CASE WHEN status_code = 200 THEN 'full' ELSE 'other' END
                 WHEN s_id IS NULL THEN 'unmatched' WHEN vouched IS NULL THEN 'changed' ELSE 'resolved' END AS status
  FROM joined)
SELECT record_id, canonical, status,
       CASE status WHEN 'resolved' THEN s_id WHEN 'full' THEN record_id END AS refers_to,
       CASE WHEN status = 'resolved' THEN vouched END AS validated_by,
       CASE status WHEN 'resolved' THEN s_digest WHEN 'full' THEN payload_digest END AS payload_digest,
       concat_ws('; ', 'cache-control: ' || cache,
                 'content-type: ' || CASE WHEN status = 'resolved' THEN s_content ELSE content END,
                 'etag: ' || CASE WHEN status = 'resolved' THEN coalesce(tag, s_tag) ELSE tag END,
                 'last-modified: ' || CASE WHEN status = 'resolved' THEN coalesce(modified, s_modified) ELSE modified END,
                 'x-cache: ' || x_cache) AS headers
FROM judged
"""


@query("op7_revisits", OP7_SQL)
def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    flat = pages.selectExpr(
        *[f"{e} AS {n}" for n, e in CAPTURES.items()], "regexp_replace(url, '[0-9]+', '') AS url", "timestamp_seconds(1700000000 + page_id * 60) AS ts"
    )

    def field(name: str, column: str):
        return F.when(F.col(column).isNotNull(), F.struct(F.lit(name).alias("name"), F.col(column).alias("value")))

    headers = F.array_compact(F.array(
        field("Cache-Control", "cache"), field("Content-Type", "content"), field("ETag", "tag"), field("Last-Modified", "modified"), field("X-Cache", "x_cache")
    ))
    found = warc.resolve_revisits(flat.withColumn("headers", headers))
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return found.withColumn("headers", F.array_join(lines, "; "))


# -- 8 -----------------------------------------------------------------------------------------
@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, max_bits=2)


# -- 9 -----------------------------------------------------------------------------------------
_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
)


def _shingles_sql(table: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM (SELECT {key}, {_WORDS} AS w FROM {table})"""


OP9_SQL = f"""
WITH item AS ({_shingles_sql('benchmark', 'item_id')}),
sizes AS (SELECT item_id, CAST(count(*) AS BIGINT) AS n_item FROM item GROUP BY item_id),
doc AS (SELECT * FROM ({_shingles_sql('documents', 'doc_id')}) WHERE shingle IN (SELECT shingle FROM item)),
shared AS (SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared FROM doc JOIN item USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_item
"""


@query("op9_decontamination", OP9_SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), least=0.8)


# -- 10 ----------------------------------------------------------------------------------------
@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_texts(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


# -- 11 ----------------------------------------------------------------------------------------
# The pages of these tables keep their article in one element, its blocks in p and h1; the SQL takes it from there.
_BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
OP11_SQL = f"""
WITH article AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS inner_html FROM pages),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(inner_html, '</?(?:p|h1)>'), lambda x:
         trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           x, '<br>', ' ', 'g'), '</?[a-z][^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '{_BLANK}', ' ', 'g'))),
         lambda x: x <> '') AS parts
  FROM article),
texts AS (SELECT page_id, url, regexp_replace(array_to_string(parts, chr(10) || chr(10)), '&amp;?', '&', 'g') AS text FROM blocks)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""


@query("op11_main_text", OP11_SQL)
def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


# -- 12 ----------------------------------------------------------------------------------------
@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(read(spark, sf_dir, "documents"), a_path, b_path, links="end")
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    scored = alignment.score_links(aligned.withColumn("groups_sha256", digest).drop("groups"), alignment.n_ids(b_path))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# -- 13 ----------------------------------------------------------------------------------------
# CRC-32 by its table of 256 remainders (fixed polynomial 0xEDB88320); near words by equal strings after one deletion.
_LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = f"""
WITH RECURSIVE remainders AS (
  SELECT list(v ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(i))),
runs AS (
  SELECT doc_id, run, CAST(count(*) AS BIGINT) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER_AZ.format('text')}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents WHERE text IS NOT NULL)
  GROUP BY doc_id, run),
spelled AS (
  SELECT run, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
           lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS h FROM spelled, remainders),
made AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c
  FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
shorter AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, range(40) t(i) WHERE i < length(word)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM shorter a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM shorter a JOIN words w ON a.rest = w.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near),
judged AS (
  SELECT w.word, w.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form,
         CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
walk AS (
  SELECT word, word AS place, 0 AS step FROM judged
  UNION ALL SELECT w.word, j.form, step + 1 FROM walk w JOIN judged j ON w.place = j.word WHERE j.form IS NOT NULL),
roots AS (SELECT word, arg_max(place, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)
"""


@query("op13_spelling", OP13_SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(read(spark, sf_dir, "documents").select("doc_id", "text"), min_length=6, min_count=5, every=199)
    return spelling.group_variants(words, min_length=6, ratio=5)
