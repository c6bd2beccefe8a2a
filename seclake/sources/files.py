"""Knowledge files as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seclake.functions.text import file_suffix, path_segments
from seclake.operators.dedupe import flag_first
from seclake.vocab import DOCUMENT_SUFFIXES, EXCLUDED_DIRS

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def _relative(path: Column, root: str) -> Column:
    base = re.sub(_SCHEME, "", root).rstrip("/") + "/"
    plain = F.regexp_replace(path, _SCHEME, "")
    plain = F.regexp_replace(plain, "^/+", "/")
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(
        F.ltrim(plain, F.lit("/"))
    )


def list_files(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """All files below ``root``: relative path, length, content (read only when used).

    ``suffixes`` filters by name before any file is opened, in either case.
    Spark lists no empty files; they hold no chunk, and a sync drops their old ones.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffixes:
        either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
        reader = reader.option("pathGlobFilter", "*{" + ",".join(either) + "}")
    return reader.load(root).select(_relative(F.col("path"), root).alias("path"), "length", "content")


def utf8_text(content: Column) -> Column:
    """Text of valid UTF-8 bytes, else NULL; a byte order mark is kept."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def _in_excluded_dir() -> Column:
    parents = F.slice(path_segments(F.col("path")), F.lit(1), F.size(path_segments(F.col("path"))) - 1)
    return F.arrays_overlap(parents, F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))


def _fits(max_mb: int | None) -> Column:
    return F.lit(True) if max_mb is None else F.col("length") <= max_mb * 1024 * 1024


def scan_documents(
    spark: SparkSession, root: str, max_mb: int | None = None, max_files: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(documents: path, text; dispositions: path, disposition).

    Files under an excluded folder are not part of the scan.  Dispositions come
    from the listing; contents are only read of files whose name and size pass.
    Limits are off unless given; what they refuse is in the dispositions.
    """
    listed = list_files(spark, root).select("path", "length").where(~_in_excluded_dir())
    supported = file_suffix(F.col("path")).isin(DOCUMENT_SUFFIXES)
    listed = flag_first(listed, path_segments(F.col("path")), max_files, supported & _fits(max_mb))
    within = F.col("_within")
    readable = list_files(spark, root, DOCUMENT_SUFFIXES).where(_fits(max_mb) & ~_in_excluded_dir() & supported)
    if max_files is not None:
        readable = readable.join(listed.where(supported & _fits(max_mb) & within).select("path"), "path", "left_semi")
    decoded = readable.select("path", utf8_text(F.col("content")).alias("text"))
    refused = listed.select(
        "path",
        F.when(~supported, "unsupported").when(~_fits(max_mb), "oversized").when(~within, "over_limit").alias("disposition"),
    ).where("disposition is not null")
    read = decoded.select("path", F.when(F.col("text").isNull(), "not_utf8").otherwise("accepted").alias("disposition"))
    return decoded.where("text is not null"), refused.unionByName(read)


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files for the curated and collection imports: relative_path, text, length."""
    return list_files(spark, root, [".md"]).where(F.endswith(F.col("path"), F.lit(".md"))).select(
        F.col("path").alias("relative_path"), utf8_text(F.col("content")).alias("text"), "length"
    )


def spread(df: DataFrame, least: int = 2) -> DataFrame:
    """Give a scan of too few splits (one small file) a task per core.

    A scan that already has a split for every core stays as it is, so large
    inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * least <= cores else df
