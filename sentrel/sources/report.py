"""Writing the consolidated report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON document with sorted keys."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_report(tables: dict[str, DataFrame], out: str) -> dict[str, str]:
    """Write the parts of a report under ``out`` and return their folders.

    ``findings`` becomes Parquet partitioned by agent; the small tables, and the one-row
    ``report`` document, become JSON lines with sorted keys.
    """
    written = {}
    for name, df in tables.items():
        target = f"{out.rstrip('/')}/{name}"
        if name.endswith("findings"):
            df.write.mode("overwrite").partitionBy("agent").parquet(target)
        else:
            json_rows(df).write.mode("overwrite").text(target)
        written[name] = target
    return written
