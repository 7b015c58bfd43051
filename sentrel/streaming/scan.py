"""The rule scan over arriving files.

The same row-local operators as in batch run on a streaming ``files`` table with one more
column, the arrival time, so a drained stream equals the batch result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.catalogue import CHECKS, Rule
from sentrel.operators.scan import audit_lines, filename_scan, pattern_scan, project_finding

ARRIVED = "arrived"


def _carrying(files: DataFrame) -> DataFrame:
    """Put the arrival time next to the tree name, which every row-local operator keeps."""
    return files.withColumn("repo", F.struct(F.col("repo").alias("name"), F.col(ARRIVED).alias(ARRIVED)))


def stream_scan(files: DataFrame, rules: DataFrame | Iterable[Rule] = CHECKS, delay: str = "1 hour") -> DataFrame:
    """Findings of arriving files, with ``arrived``: line, code-event and file-name checks, no state.

    ``delay`` is how late a file may be for the stateful operators behind this one.
    """
    carried = _carrying(files)
    hits = pattern_scan(audit_lines(carried), rules).unionByName(filename_scan(carried, rules))
    found = project_finding(hits, rules)
    rest = [c for c in found.columns if c != "repo"]
    named = found.select(F.col("repo.name").alias("repo"), F.col(f"repo.{ARRIVED}").alias(ARRIVED), *rest)
    return named.withWatermark(ARRIVED, delay)


def stream_dedupe(findings: DataFrame) -> DataFrame:
    """One row per finding id while its first arrival is within the watermark.

    Ids are stable, so an unchanged line that arrives again is the same finding. Rows
    later than the watermark are dropped and state older than it is freed.
    """
    return findings.dropDuplicatesWithinWatermark(["repo", "id"])


def stream_severity(findings: DataFrame, width: str = "1 hour") -> DataFrame:
    """Severity counts per tumbling window of arrival time (append after the watermark)."""
    return (
        findings.groupBy(F.window(ARRIVED, width).alias("w"), "severity")
        .agg(F.count("*").alias("findings"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "severity", "findings")
    )


def drain(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Run a streaming table until its input is used up, into Parquet under ``out``."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
