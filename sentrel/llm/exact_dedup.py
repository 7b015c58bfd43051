"""Exact deduplication by salted combining of digest groups.

Each task first combines its own equal texts; the groups of a digest and salt combine next, then the salt winners of a
digest. Text is a grouping key at each of these stages, so full content is compared and no digest is trusted. Only the
winners, without text, meet the documents again. If two texts ever shared a digest, the rows of that digest alone
would be matched by their text.

Defined cases: a null text equals an empty one; the largest ``doc_id`` stays, a null one only where a group has no
other; rows equal in both text and ``doc_id`` all carry the same result, and ``deduplicate`` leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.llm.batches import stored, text_of

SALTS = 16


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", digest=content_digest, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: ``digest``, ``keep_id``, ``group_size``, and ``same_digest``, the text if others share its digest."""
    rows = df.select(F.col(key).alias("keep_id"), text_of(text).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content"))).withColumn("salt", F.pmod(F.xxhash64("keep_id"), F.lit(salts)))
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("keep_id").alias("keep_id"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # A digest of several texts keeps them; of one text, which is the rule, only the numbers go on.
    per_digest = whole.groupBy("digest").agg(
        F.count("*").alias("n_texts"),
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
    )
    return per_digest.select("digest", "keep_id", "group_size", "n_texts")


def _collided(df: DataFrame, winners: DataFrame, text: str, key: str, digest, salts: int) -> DataFrame:
    """The groups of digests that several texts share, each with its text."""
    shared = winners.filter("n_texts > 1").select("digest")
    rows = df.select(F.col(key).alias("keep_id"), text_of(text).alias("content")).withColumn("digest", digest(F.col("content")))
    rows = rows.join(shared, "digest", "left_semi").withColumn("salt", F.pmod(F.xxhash64("keep_id"), F.lit(salts)))
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("keep_id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(df: DataFrame, text: str = "text", key: str = "doc_id", digest=content_digest, salts: int = SALTS) -> DataFrame:
    """Per row: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``digest``."""
    winners = stored(groups(df, text, key, digest, salts), "exact")
    rows = df.select(F.col(key).alias("doc_id"), digest(text_of(text)).alias("digest"))
    found = rows.join(winners.filter("n_texts = 1"), "digest").drop("n_texts")
    if not winners.filter("n_texts > 1").isEmpty():
        texts = df.select(F.col(key).alias("doc_id"), text_of(text).alias("content")).withColumn("digest", digest(F.col("content")))
        several = _collided(df, winners, text, key, digest, salts)
        found = found.unionByName(texts.join(several, ["digest", "content"]).drop("content"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", digest=content_digest, salts: int = SALTS) -> DataFrame:
    """``df`` with one row of each text, all columns as they were, whatever their names."""
    winners = stored(groups(df, text, key, digest, salts), "exact")
    own = [digest(text_of(text)).alias("digest"), F.col(key).alias("key"), F.xxhash64(key).alias("hash")]
    rows = df.select(F.struct("*").alias("row"), *own, text_of(text).alias("content"))
    winner = [F.col("digest"), F.xxhash64("keep_id").alias("hash"), F.col("keep_id")]
    kept = rows.join(winners.filter("n_texts = 1").select(*winner), ["digest", "hash"])
    same = ["digest", "hash"]
    if not winners.filter("n_texts > 1").isEmpty():
        several = _collided(df, winners, text, key, digest, salts).select(*winner, "content")
        kept = kept.unionByName(rows.join(several, ["digest", "hash", "content"]))
        same.append("content")
    kept = kept.filter(F.col("key").eqNullSafe(F.col("keep_id")))
    numbered = kept.withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1))))
    return numbered.filter("n = 1").select("row.*")
