"""One query per operator with production parameters, over whole tables, and the statements for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm import chat, conversation_repair, decontamination, exact_dedup, lm_score, near_dedup, periodic_runs, pii, quality, sentencepiece_codec, sharding, token_files, toxicity
from sentrel.llm.batches import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WORD_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_files(spark, sf_dir):
    path = shared_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_VOCABULARY), end_id=1)
    return token_files.read_documents(spark, path)


@query
def op2_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY))


@query
def op3_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op4_exact_dedup(spark, sf_dir):
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op4_exact_dedup"] = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window w as (partition by coalesce(text, ''))
"""


@query
def op5_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


# The filled table is a list of the statement, which looks up each slot in it.
SQL["op5_sharding"] = f"""
select doc_id, slot, format('shard-{{:03d}}', holder[slot + 1]) as shard
from (
    select doc_id, cast('0x' || substr(md5(coalesce('=' || cast(doc_id as varchar), '/')), 1, 15) as bigint) % {sharding.SLOTS} as slot
    from documents
), (select {sharding.lookup_table(SHARDS)} as holder)
"""


@query
def op6_lattice_score(spark, sf_dir):
    return lm_score.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY))


@query
def op7_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op7_decontamination"] = r"""
with words as (
    select doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), items as (
    select cast(item_id as varchar) as item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), windows as (
    select distinct item_id, least(len(w), 10) as size, w[i : i + least(len(w), 10) - 1] as win
    from items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(i)
    where len(w) > 0
), sizes as (
    select distinct size from windows
), places as (
    select doc_id, i, size, w[i : i + size - 1] as win
    from words, sizes, unnest(range(1, len(w) - size + 2)) as t(i)
), hits as (
    select p.doc_id, p.i, p.size, x.item_id
    from places p join windows x on p.size = x.size and p.win = x.win
), covered as (
    select doc_id, count(distinct i + k) as n_hit
    from (select distinct doc_id, i, size from hits), unnest(range(0, size)) as t(k)
    group by doc_id
), named as (
    select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
    from (select distinct doc_id, item_id from hits)
    group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(n.n_items, 0) as n_items,
       sha256(coalesce(n.ids, '')) as items_sha256, c.n_hit is not null as contaminated
from words d left join covered c using (doc_id) left join named n using (doc_id)
"""


@query
def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@query
def op9_chat_windows(spark, sf_dir):
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.window_digests(chat.format_windows(rows))


@query
def op10_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The fixed damage that op11 repairs: dropped, emptied, cut, repeated and renamed turns, by a checksum of their key."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *own)) % 20
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).filter("kind != 0")
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


@query
def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    report = conversation_repair.report(damaged(rows))
    every = rows.select("conv_id", conversation_repair.conv_key().alias("conv")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit(""), 256)
    digest = F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    return every.join(report, "conv", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def periodic_damage(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The fixed damage of op12: from some word on, a tenth of the documents repeat their words with a period."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op12_periodic_runs(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.collapse(documents, rewrite=periodic_damage).select("doc_id", "runs", "collapsed")
    # The greatest length / period, compared without rounding; of equal ones the first.
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    best = F.when(F.size("runs") > 0, best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
