"""Stored web pages as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.functions.text import decode_utf8

# --- Fixed values ------------------------------------------------------------
SCHEMES = ("http", "https")
MAX_BYTES = 256 * 1024
# --- end of fixed values -----------------------------------------------------


def evidence_scan(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``(page_id, url, scheme, error, truncated, text)``.

    Only http and https pages become evidence; another scheme gives an error and no text. Whole texts are kept, unless
    ``max_bytes`` (``MAX_BYTES`` for the usual limit) asks to cut them there, which is flagged.
    """
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    allowed = scheme.isin(*SCHEMES)
    too_long, text = F.lit(False), F.col("html")
    if max_bytes is not None:
        too_long = F.octet_length("html") > max_bytes
        text = F.when(too_long, decode_utf8(F.substring(F.col("html").cast("binary"), 1, max_bytes))).otherwise(text)
    return pages.select(
        "page_id",
        "url",
        scheme.alias("scheme"),
        F.when(~allowed, F.concat(F.lit("Unsupported URL scheme: '"), scheme, F.lit("'"))).alias("error"),
        F.when(allowed, too_long).alias("truncated"),
        F.when(allowed, text).alias("text"),
    )


def evidence(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    return evidence_scan(pages, max_bytes).filter(F.col("error").isNull())


def rejected(pages: DataFrame) -> DataFrame:
    return evidence_scan(pages).filter(F.col("error").isNotNull()).select("page_id", "url", "error")
