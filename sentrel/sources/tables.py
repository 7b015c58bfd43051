"""Tables as a corpus: any text column can be scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.text import detect_language


def corpus_from_table(df: DataFrame, path: Column, text: str | Column, repo: str | Column = "table") -> DataFrame:
    """``files(repo, path, size, text, language)`` from any table.

    ``repo`` given as text is a constant name, as a column it comes from the row.
    """
    text = F.col(text) if isinstance(text, str) else text
    repo = F.lit(repo) if isinstance(repo, str) else repo
    rows = df.select(repo.alias("repo"), path.alias("path"), text.alias("text")).filter(F.col("text").isNotNull())
    return rows.select("repo", "path", F.octet_length("text").cast("long").alias("size"), "text", detect_language(F.col("path")).alias("language"))
