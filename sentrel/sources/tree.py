"""Directory trees and patches as a corpus.

Spark's own file sources leave out every name that starts with ``.`` or ``_``, which would
drop ``.env`` and ``__init__.py``. The tree is therefore listed level by level as a Spark
job (one row per directory, so a wide level spreads over the cluster), and the files are
read by the tasks that hold their paths.
"""

from __future__ import annotations

import fnmatch
import os
import sys
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrel.functions.text import decode_utf8, detect_language
from sentrel.operators.corpus import EXCLUDED_DIRECTORIES
from sentrel.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 32 * 1024 * 1024
#: Entries of a directory that a task holds at once.
BATCH_NAMES = 10_000
#: File content that a task reads.
TASK_BYTES = 128 * 1024 * 1024
LISTED = "parent string, name string, is_dir boolean, size long"


def open_filesystem(location: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs

    if "://" in location:
        return fs.FileSystem.from_uri(location)
    return fs.LocalFileSystem(), location


def _list_directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Children of each directory in batches of bounded size; symbolic links are left out."""
    for batch in batches:
        for parent in batch["path"]:
            children = _children(parent)
            while rows := [(parent, *child) for child in islice(children, BATCH_NAMES)]:
                yield pd.DataFrame(rows, columns=["parent", "name", "is_dir", "size"])


def _children(location: str) -> Iterator[tuple[str, bool, int]]:
    """Name, kind and size of what a directory holds; one on a local file system is read entry by entry.

    Arrow's other file systems give the entries of a directory as one list.
    """
    from pyarrow import fs

    system, inner = open_filesystem(location)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(inner) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, True, 0
                elif entry.is_file(follow_symlinks=False):
                    yield entry.name, False, entry.stat(follow_symlinks=False).st_size
        return
    for child in system.get_file_info(fs.FileSelector(inner, recursive=False)):
        if child.type in (fs.FileType.File, fs.FileType.Directory):
            is_dir = child.type == fs.FileType.Directory
            yield child.base_name, is_dir, 0 if is_dir else child.size


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """File contents in batches of bounded size."""
    for batch in batches:
        rows, held = [], 0
        for row in batch.itertuples(index=False):
            system, inner = open_filesystem(row.location)
            with system.open_input_stream(inner) as stream:
                content = stream.read()
            rows.append((row.repo, row.path, row.size, content))
            held += len(content)
            if held >= BATCH_BYTES:
                yield pd.DataFrame(rows, columns=["repo", "path", "size", "content"])
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=["repo", "path", "size", "content"])


def list_tree(spark: SparkSession, root: str, excluded: Iterable[str] = EXCLUDED_DIRECTORIES, recursive: bool = True) -> DataFrame:
    """``(location, path, size)`` of every regular file below ``root``, hidden names included.

    Excluded names are pruned while walking. The driver only loops over the depth.
    """
    root = root.rstrip("/")
    if "://" not in root:
        if os.path.islink(root):
            raise ValueError("a symbolic link is not a valid root")
        if not os.path.exists(root):
            raise FileNotFoundError(root)
    cores = spark.sparkContext.defaultParallelism
    banned = list(excluded)
    level = spark.createDataFrame([(root,)], "path string")
    found: DataFrame | None = None
    while True:
        listed = cut_lineage(level.repartition(cores).mapInPandas(_list_directories, LISTED))
        kept = listed.filter(~F.col("name").isin(*banned)) if banned else listed
        kept = kept.withColumn("location", F.concat_ws("/", "parent", "name"))
        files = kept.filter(~F.col("is_dir")).select("location", "size")
        found = files if found is None else found.unionByName(files)
        level = kept.filter("is_dir").select(F.col("location").alias("path"))
        if not recursive or level.isEmpty():
            break
    path = F.substring(F.col("location"), len(root) + 2, 1 << 20)
    return found.select("location", path.alias("path"), "size")


def read_parts(listed: DataFrame, target: int = TASK_BYTES) -> DataFrame:
    """``listed`` in as many partitions as its bytes ask for, a core each at least.

    The number of parts follows the bytes, twice what they need, and files are dealt in turn, so a part holds half of the target
    on average.
    """
    spark = listed.sparkSession
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files")).first()
    n = max(spark.sparkContext.defaultParallelism, -(-2 * total["bytes"] // target))
    return listed.repartition(int(min(n, max(1, total["files"]))))


def _contents(listed: DataFrame) -> DataFrame:
    """Read listed files; ``listed`` holds ``location, repo, path, size``."""
    raw = read_parts(cut_lineage(listed)).mapInPandas(_read_files, "repo string, path string, size long, content binary")
    return raw.select(
        "repo", "path", "size", decode_utf8(F.col("content")).alias("text"), detect_language(F.col("path")).alias("language")
    )


def scan_corpus(
    spark: SparkSession,
    root: str,
    max_bytes: int | None = None,
    max_files: int | None = None,
    excluded: Iterable[str] = EXCLUDED_DIRECTORIES,
    repos: bool = False,
) -> DataFrame:
    """``files(repo, path, size, text, language)`` of a directory tree.

    Symbolic links and excluded names at any depth are left out, and files over ``max_bytes`` if it is given;
    ``skipped`` lists those.
    With ``repos`` the first level below the root names the tree a file belongs to, else
    the root does. ``max_files`` keeps the first files of each tree in path order.
    """
    listed = _named(list_tree(spark, root, excluded), root, repos)
    if max_bytes is not None:
        listed = listed.filter(F.col("size") <= max_bytes)
    if max_files is not None:
        place = F.row_number().over(Window.partitionBy("repo").orderBy(F.split("path", "/")))
        listed = listed.withColumn("place", place).filter(F.col("place") <= max_files).drop("place")
    return _contents(listed)


def skipped(
    spark: SparkSession, root: str, max_bytes: int, excluded: Iterable[str] = EXCLUDED_DIRECTORIES, repos: bool = False
) -> DataFrame:
    """``repo, path, size, reason`` of the files that ``scan_corpus`` leaves out for their size."""
    listed = _named(list_tree(spark, root, excluded), root, repos).filter(F.col("size") > max_bytes)
    return listed.select("repo", "path", "size", F.lit(f"over {max_bytes} bytes").alias("reason"))


def _named(listed: DataFrame, root: str, repos: bool) -> DataFrame:
    """The listed files with the tree they belong to."""
    if not repos:
        return listed.select("location", F.lit(os.path.basename(root.rstrip("/"))).alias("repo"), "path", "size")
    return listed.select(
        "location",
        F.substring_index("path", "/", 1).alias("repo"),
        F.regexp_replace("path", "^[^/]*/", "").alias("path"),
        "size",
    )


def scan_patches(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Patches or single source files as plain text: added and removed lines both count.

    Each file of the folder that matches ``pattern`` is an input of its own: it is shown by
    its base name, which keeps its suffix, and ``repo`` is its location.
    """
    listed = list_tree(spark, root, excluded=(), recursive=False)
    listed = listed.filter(F.col("path").rlike(fnmatch.translate(pattern).replace("\\Z", "\\z")))
    return _contents(listed.select("location", F.col("location").alias("repo"), "path", "size"))
