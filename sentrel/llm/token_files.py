"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level k the next chunk of
those ids that go on, told by the continuation bitmap of level k - 1. A rank directory over each bitmap gives the
place of an id's next chunk, so any token is read by a few array accesses and no block is decoded.

A file is a Parquet table with one row per segment of consecutive documents: ``part``, ``segment``, ``doc_ids``,
``lengths``, ``n_tokens`` and ``codes`` (the levels). Parts and segments are in ascending order of ``doc_id``.

Defined cases: a null text is empty; an empty text has the end id alone; null ``doc_id`` comes first; rows of equal
``doc_id`` are all kept, in an order given by their text; no rows give files without segments. Other columns are
not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrel.llm.batches import SLICE_BYTES, WordTable, flattened, kept_in_worker, slices, spread, text_of, utf8

#: A segment is closed once it has so many tokens; a longer document makes a segment of its own.
SEGMENT_TOKENS = 1 << 18
SEGMENTS = "part int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, codes binary"
BITS = 8


# --- Codes ---------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """The levels of ``ids`` (unsigned 32-bit): sizes first, then chunks, bitmap and ranks of each level."""
    rest, sizes, parts = np.asarray(ids, np.uint32), [], []
    while len(rest):
        more = rest >> BITS
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % 8, np.uint8)]).view(np.uint64)
        ranks = (np.cumsum(np.bitwise_count(bitmap), dtype=np.uint32) - np.bitwise_count(bitmap)).astype(np.uint32)
        sizes.append(len(rest))
        parts += [rest.astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()]
        rest = more[goes_on]
    return np.array([len(sizes), *sizes], "<u4").tobytes() + b"".join(parts)


class Codes:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        levels = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", levels, 4).astype(int).tolist()
        at, self.levels = 4 + 4 * levels, []
        for n in sizes:
            words = -(-n // 64)
            chunks = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, "<u8", words, at + n)
            ranks = np.frombuffer(data, "<u4", words, at + n + 8 * words)
            self.levels.append((chunks, bitmap, ranks))
            at += n + 12 * words

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def all(self) -> np.ndarray:
        """All ids in order; each level's chunks belong to the tokens that the bitmap above lets go on, so no ranks are needed."""
        out, where = np.zeros(len(self), np.uint32), np.arange(len(self))
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(BITS * level)
            where = where[np.unpackbits(bitmap.view(np.uint8), count=len(chunks), bitorder="little").view(bool)]
        return out

    def get(self, positions: np.ndarray) -> np.ndarray:
        """The ids at ``positions``, in any order."""
        positions = np.asarray(positions, np.int64)
        out, where = np.zeros(len(positions), np.uint32), np.arange(len(positions))
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            out[where] |= chunks[positions].astype(np.uint32) << np.uint32(BITS * level)
            block, bit = positions >> 6, (positions & 63).astype(np.uint64)
            goes_on = (bitmap[block] >> bit) & np.uint64(1) == 1
            where, block, bit = where[goes_on], block[goes_on], bit[goes_on]
            below = bitmap[block] & ((np.uint64(1) << bit) - np.uint64(1))
            positions = ranks[block].astype(np.int64) + np.bitwise_count(below)
        return out


# --- Writing -------------------------------------------------------------------


#: Marks that the vocabulary's pattern always cuts from a letter or digit before them, at the end of a word.
MARK = rb"[.,;:!?#$%&*)\x22]"
#: Begins with the mark, which the search can look for, and then looks back at the character before it.
CUT = re.compile(MARK + rb"(?<=[a-z0-9]" + MARK + rb")" + MARK + rb"*(?!\S)")
MARKS = re.compile(MARK + rb"+")
LATIN_END = "\u0250"
JOINED = 1000


def units(text: bytes) -> list[bytes]:
    """The words of a text in lower case, marks at their ends apart: forms of a word share their ids.

    A word with ``<`` may hold a special token, whose case counts, and stays as it is.
    """
    if b"<" not in text:
        return CUT.sub(rb" \g<0>", text.lower()).split()
    return list(chain.from_iterable([w] if b"<" in w else units(w) for w in text.split()))


def word_encoder(tokenizer_json: str):
    """Encodes units by the tokenizers library.

    Its vocabulary drops white space and joins nothing across it, so the ids of a text are those of its words. Words
    that the library does not cut are encoded many at a time in one text and told apart by the ids that end a word; all
    others are encoded alone.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    size = tokenizer.get_vocab_size()
    ends_unit = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def uncut(word: bytes) -> bool:
        if word.isascii():
            return word.isalpha() or MARKS.fullmatch(word) is not None
        text = word.decode()
        return text.isalpha() and max(text) < LATIN_END

    def alone(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)])

    def together(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(ends_unit[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else alone(words)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joint = np.fromiter(map(uncut, words), bool, len(words))
        flat, counts, at = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        done = 0
        for own, how in ((np.flatnonzero(joint), together), (np.flatnonzero(~joint), alone)):
            for i in range(0, len(own), JOINED):
                some = own[i : i + JOINED]
                ids, n = how([words[j] for j in some.tolist()])
                flat.append(ids)
                counts[some], at[some] = n, done + np.cumsum(n) - n
                done += len(ids)
        return np.concatenate(flat)[spread(at, counts)], counts

    return encode


def encoded(batches: Iterator[pa.RecordBatch], tokenizer_json: str, end_id: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, tokens per document and the tokens of a slice of documents."""
    name = f"tokens_{zlib.crc32(tokenizer_json.encode())}"
    table = kept_in_worker(name, lambda: WordTable(word_encoder(tokenizer_json)))
    for batch in slices(batches, "text", 4 * SLICE_BYTES):
        words = [units(text) for text in utf8(batch.column("text"))]
        ids, counts = table.ids(list(chain.from_iterable(words)))
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum([len(w) for w in words])])]
        lengths = np.diff(bounds) + 1
        tokens = np.full(int(lengths.sum()), end_id, np.uint32)
        tokens[np.arange(len(ids)) + np.repeat(np.arange(len(words)), lengths - 1)] = ids
        yield batch.column("doc_id").to_pylist(), lengths, tokens


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode ``text`` and write the ids, in ascending order of ``doc_id``, to ``path``.

    ``tokenizer`` is a local file of the tokenizers library that drops white space.
    """
    context = documents.sparkSession.sparkContext
    content = context.broadcast(Path(tokenizer).read_text())

    def segments(batches):
        part, segment = TaskContext.get().partitionId(), 0
        ids, lengths, tokens, size = [], [], [], 0

        def row():
            values = ([part], [segment], [ids], [np.concatenate(lengths)], [size], [pack(np.concatenate(tokens))])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=names)

        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        for own, counts, found in encoded(batches, content.value, end_id):
            ids += own
            lengths.append(counts)
            tokens.append(found)
            size += len(found)
            if size >= SEGMENT_TOKENS:
                yield row()
                segment, ids, lengths, tokens, size = segment + 1, [], [], [], 0
        if ids:
            yield row()

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(path)


# --- Reading -------------------------------------------------------------------


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """Part, segment and the number of tokens before it; only totals of parts meet in one task."""
    sizes = spark.read.schema(SEGMENTS).parquet(path).select("part", "segment", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return (
        sizes.join(totals.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part")
        .select("part", "segment", (F.col("before") + F.coalesce(within, F.lit(0))).alias("start"))
    )


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: its start, its number of tokens, the crc32 of its ids, and the ids if asked for."""

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, lengths = Codes(row["codes"]), np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                ids = np.split(codes.all(), starts[1:])
                columns = {
                    "part": pa.array([row["part"]] * len(ids), pa.int32()),
                    "segment": pa.array([row["segment"]] * len(ids), pa.int32()),
                    "offset": pa.array(starts),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, segment int, offset bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"
    files = spark.read.schema(SEGMENTS).parquet(path)
    rows = files.mapInArrow(documents, schema + (", ids array<int>" if with_ids else ""))
    shown = ["doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"]
    return rows.join(segment_starts(spark, path), ["part", "segment"]).select(*shown, *(["ids"] if with_ids else []))


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Single tokens: ``wanted`` has ``position`` (0 for the first token of all); positions outside give no row.

    Positions meet their segment through blocks of ``SEGMENT_TOKENS``; a segment gets each position once.
    """
    files = spark.read.schema(SEGMENTS).parquet(path)
    starts = files.select("part", "segment", "n_tokens").join(segment_starts(spark, path), ["part", "segment"])
    block = lambda c: F.floor(c / SEGMENT_TOKENS)
    last = F.col("start") + F.col("n_tokens") - 1
    blocks = starts.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(last))))
    asked = wanted.select(F.col("position").cast("long").alias("position")).distinct()
    inside = (F.col("position") >= F.col("start")) & (F.col("position") <= last)
    found = asked.withColumn("block", block(F.col("position"))).join(blocks, "block").filter(inside)
    lists = found.groupBy("part", "segment", "start").agg(F.collect_list("position").alias("positions"))

    def tokens(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["positions"], np.int64)
                ids = Codes(row["codes"]).get(at - row["start"])
                yield pa.RecordBatch.from_pydict({"position": pa.array(at), "id": pa.array(ids.astype(np.int64))})

    return lists.join(files.select("part", "segment", "codes"), ["part", "segment"]).mapInArrow(tokens, "position bigint, id bigint")
