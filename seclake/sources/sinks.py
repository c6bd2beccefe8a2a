"""JSON reports, audit lines and normalised documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seclake.functions.redact import redact_df


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def redact_audit(events: DataFrame, pii_mode: str = "off") -> DataFrame:
    """Redacted audit rows with a UTC ``timestamp`` string; sensitive keys lose their value."""
    if "ts" not in events.columns:
        events = events.withColumn("ts", F.current_timestamp())
    moment = F.col("ts")
    if isinstance(events.schema["ts"].dataType, T.TimestampType):
        # the clock time in UTC, whatever the session's time zone
        moment = F.to_utc_timestamp(moment, F.current_timezone())
    stamped = events.withColumn("timestamp", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).drop("ts")
    return redact_df(stamped, pii_mode=pii_mode, by_key=True)


def append_audit(events: DataFrame, path: str, pii_mode: str = "off") -> None:
    redact_audit(events, pii_mode).write.mode("append").json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Normalised documents (destination, text) as a table; a new import replaces the old one."""
    docs.write.mode("overwrite").parquet(path)
