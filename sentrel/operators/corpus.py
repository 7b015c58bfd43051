"""From files to lines, and the path columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.text import base_name, detect_language, segments, split_lines, suffix

# --- Fixed values ------------------------------------------------------------
EXCLUDED_DIRECTORIES = (
    ".git",
    ".hg",
    ".svn",
    "node_modules",
    "vendor",
    "dist",
    "build",
    ".next",
    ".venv",
    "venv",
    "__pycache__",
    ".pytest_cache",
)
MANIFEST_NAMES = ("package.json", "composer.json", "requirements.txt")
# --- end of fixed values -----------------------------------------------------


def explode_lines(files: DataFrame) -> DataFrame:
    """``lines(repo, path, line_no, line)``, numbered from 1. No shuffle."""
    return files.select("repo", "path", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select(
        "repo", "path", (F.col("pos") + 1).alias("line_no"), "line"
    )


def path_features(df: DataFrame) -> DataFrame:
    """Adds base name, lower-cased suffix and path segments."""
    path = F.col("path")
    return df.withColumns({"base_name": base_name(path), "suffix": suffix(path), "segments": segments(path)})


def with_language(df: DataFrame) -> DataFrame:
    return df.withColumn("language", detect_language(F.col("path")))


def kept_path(path: Column, excluded: Iterable[str] = EXCLUDED_DIRECTORIES) -> Column:
    return ~F.arrays_overlap(segments(path), F.array(*[F.lit(name) for name in excluded]))


def filter_paths(df: DataFrame, excluded: Iterable[str] = EXCLUDED_DIRECTORIES) -> DataFrame:
    """Drops rows whose path has an excluded segment at any depth."""
    return df.filter(kept_path(F.col("path"), excluded))


def is_manifest(path: Column) -> Column:
    return base_name(path).isin(*MANIFEST_NAMES)


def dependency_inventory(files: DataFrame) -> DataFrame:
    """Distinct manifest paths per tree."""
    return files.filter(is_manifest(F.col("path"))).select("repo", "path").distinct()
