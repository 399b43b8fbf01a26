"""Writing results and findings, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.findings import explode_findings
from palisade.operators.scan import is_suspicious


def response(guarded: DataFrame) -> DataFrame:
    """The flattened response: sanitizer and intent as nested objects."""
    inner = {"sanitization", "intent"}
    others = [F.col(f"`{c}`") for c in guarded.columns if c not in inner]
    sanitizer = F.struct(
        F.col("sanitization.blocked").alias("blocked"),
        F.col("sanitization.cleaned_text").alias("cleaned_text"),
        F.col("sanitization.findings").alias("findings"),
    )
    return guarded.select(*others, sanitizer.alias("sanitizer"), "intent")


def _save(rows: DataFrame, path: str, fmt: str, mode: str, by: list[str]) -> None:
    """Write ``rows``; with mode ``replace`` only the partitions that they hold are replaced.

    Repeating such a write leaves the same files' rows, so a job that failed half
    way is simply run again, and other partitions stay as they are.
    """
    writer = rows.write.format(fmt)
    if by:
        writer = writer.partitionBy(*by)
    if mode == "replace":
        if not by:
            raise ValueError("only partitions can be replaced")
        writer, mode = writer.option("partitionOverwriteMode", "dynamic"), "overwrite"
    writer.mode(mode).save(path)


def write_responses(
    guarded: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None
) -> None:
    """Responses as files, one folder per value of the columns ``by``.

    JSON leaves nulls out, so it is read with the schema of :func:`response`.
    """
    _save(response(guarded), path, fmt, mode, by or [])


def read_responses(spark: SparkSession, path: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Written responses with the columns that ``response(like)`` has."""
    return spark.read.schema(response(like).schema).format(fmt).load(path)


def write_findings(scanned: DataFrame, keys: list[str], path: str, mode: str = "errorifexists") -> None:
    """Findings in long form, one folder per rule."""
    _save(explode_findings(scanned, keys), path, "parquet", mode, ["rule_name"])


def write_quarantine(scanned: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All texts in one pass, in the folders suspicious=false and suspicious=true."""
    marked = scanned.withColumn("suspicious", is_suspicious())
    _save(marked.filter(F.col("suspicious").isNotNull()), path, "parquet", mode, ["suspicious"])
