"""Benchmark decontamination by a positional inverted index.

The words of the benchmark are counted over all documents. Each window (``n`` consecutive words of an item; a shorter
item is one window) is looked up by its two rarest words: the postings of those words (word, row, positions) are stored,
each list is moved back by the word's offset in the window, and the lists of a window are intersected. What is left is
compared with the window word for word, in the document. With ``slop``, the words may lie apart: in order, with at
most ``slop`` other words between them.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast has a bound; a word of more than
``WORD_BYTES`` counts as several, and a longer item is cut into pieces that share ``n - 1`` words, so that each of its windows
is in one of them. A window with a word that no document has is dropped before any list is read.

Defined cases: null text has no words; an empty item has no windows; items of one id count once; rows repeated in the
documents all get the result; no benchmark or no documents give no matches. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.llm.batches import WORD_SPACES, WordHasher, slices, stored, text_of, utf8

WINDOW = 10
BLOCK_WORDS = 100_000
WORD_BYTES = 64
EMPTY_SHA256 = sha256(b"").hexdigest()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_SPACES).split()


def keyed(documents: DataFrame) -> DataFrame:
    """Rows with a key; rows that share one by chance are told apart when their words are compared."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.withColumn("row_key", F.xxhash64("doc_id", "text"))


# --- Benchmark -----------------------------------------------------------------


class Block:
    """The windows of some items or pieces of items, on the driver and in tasks."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.items: dict[tuple, set[str]] = {}
        for name, words in items:
            for at in range(max(1, len(words) - n + 1) if words else 0):
                self.items.setdefault(tuple(words[at : at + n]), set()).add(name)
        self.windows = list(self.items)
        terms = sorted({w for window in self.windows for w in window})
        hashes, _ = WordHasher().hashes(pa.array([t.decode() for t in terms], pa.string()))
        self.hash_of = dict(zip(terms, hashes.tolist()))
        self.terms = np.unique(hashes)

    def anchors(self, counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
        """Window, and word and offset of its two rarest words; windows with a word of no document are left out."""
        out = []
        for i, window in enumerate(self.windows):
            ranked = sorted((counts.get(self.hash_of[w], 0), at, self.hash_of[w]) for at, w in enumerate(window))
            if ranked[0][0]:
                (_, a, first), (_, b, second) = ranked[0], ranked[min(1, len(ranked) - 1)]
                out.append((i, _signed(first), a, _signed(second), b))
        return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def size_of(words: list[bytes]) -> int:
    return sum(1 + len(w) // WORD_BYTES for w in words)


def pieces(words: list[bytes], n: int, block_words: int) -> Iterator[list[bytes]]:
    """Pieces of ``block_words`` words, or of ``n`` if that is more, by the size of words; each window is in one of them."""
    begin, held, size = 0, 0, 0
    for end, word in enumerate(words):
        own = size_of([word])
        if size + own > block_words and held >= n:
            yield words[begin:end]
            begin = end - n + 1
            held, size = n - 1, size_of(words[begin:end])
        held, size = held + 1, size + own
    yield words[begin:]


def blocks(benchmark: DataFrame, n: int, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks; items come to the driver one by one."""
    items, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_of().alias("text"))
    for row in rows.toLocalIterator():
        for words in pieces(words_of(row["text"].encode()), n, block_words):
            own = size_of(words)
            if items and size + own > block_words:
                yield Block(items, n)
                items, size = [], 0
            items.append((row["item_id"], words))
            size += own
    if items:
        yield Block(items, n)


# --- Index ---------------------------------------------------------------------


def _found(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The place in ``terms`` of each hash, or -1."""
    if not len(terms):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, at, -1)


def term_counts(rows: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How often each of the given words occurs in all documents."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        hasher, total = WordHasher(), np.zeros(len(shared.value), np.int64)
        for batch in slices(batches, "text"):
            at = _found(hasher.hashes(batch.column("text"))[0], shared.value)
            total += np.bincount(at[at >= 0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(shared.value[seen].view(np.int64)), "n": pa.array(total[seen])})

    found = rows.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"] % (1 << 64): r["n"] for r in found.toLocalIterator()}


def postings(rows: DataFrame, terms: np.ndarray) -> DataFrame:
    """The positional index of the given words: ``term``, ``row_key``, ``positions``."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def index(batches):
        hasher = WordHasher()
        for batch in slices(batches, "text"):
            hashes, bounds = hasher.hashes(batch.column("text"))
            at = _found(hashes, shared.value)
            where = np.flatnonzero(at >= 0)
            if not len(where):
                continue
            row = np.searchsorted(bounds, where, "right") - 1
            order = np.lexsort((where, at[where], row))
            where, row = where[order], row[order]
            term = at[where]
            new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(term) != 0)))
            keys = batch.column("row_key").to_numpy()
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array(shared.value[term[new]].view(np.int64)),
                    "row_key": pa.array(keys[row[new]]),
                    "positions": pa.ListArray.from_arrays(
                        pa.array(np.append(new, len(where)), pa.int32()), pa.array(where - bounds[row], pa.int32())
                    ),
                }
            )

    return rows.select("text", "row_key").mapInArrow(index, "term bigint, row_key bigint, positions array<int>")


def candidates(index: DataFrame, anchors: DataFrame, slop: int = 0) -> DataFrame:
    """Rows and starts where the moved lists of a window's two rarest words meet: ``row_key``, ``window``, ``start``."""

    def moved(term: str, offset: str) -> DataFrame:
        rows = index.join(anchors.select("window", F.col(term).alias("term"), F.col(offset).alias("offset")), "term")
        rows = rows.select("row_key", "window", F.explode("positions").alias("position"), "offset")
        return rows.select("row_key", "window", (F.col("position") - F.col("offset")).alias("start")).filter(f"start >= {-slop}")

    first, second = moved("first", "a"), moved("second", "b").withColumnRenamed("start", "other")
    cell = lambda c: F.floor(F.col(c) / (slop + 1))
    near = F.explode(F.sequence(cell("other") - 1, cell("other") + 1)) if slop else cell("other")
    met = first.withColumn("cell", cell("start")).join(second.withColumn("cell", near), ["row_key", "window", "cell"])
    return met.filter(F.abs(F.col("start") - F.col("other")) <= slop).select("row_key", "window", "start").distinct()


# --- Matches -------------------------------------------------------------------


def _spans(words: list[bytes], window: tuple, start: int, slop: int) -> Iterator[tuple[int, int]]:
    """Where the words of the window occur in order around ``start``, with at most ``slop`` others between them."""
    n = len(window)
    if not slop:
        if tuple(words[start : start + n]) == window:
            yield start, start + n
        return
    for first in range(max(0, start - slop), min(len(words), start + slop + 1)):
        at, end = first, first + n + slop
        for w in window:
            while at < min(end, len(words)) and words[at] != w:
                if at == first:
                    break
                at += 1
            if at >= min(end, len(words)) or words[at] != w:
                break
            at += 1
        else:
            yield first, at


def matches(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Occurrences of benchmark windows, a row per document with any: ``row_key``, ``doc_id``, ``starts``, ``ends``, ``items``.

    ``items`` has the ids of each occurrence. A document has a row for each block of the benchmark it meets.
    """
    spark, rows, out = documents.sparkSession, keyed(documents), []
    for block in blocks(benchmark, n, block_words):
        anchors = block.anchors(term_counts(rows, block.terms)) if len(block.terms) else []
        if not anchors:
            continue
        terms = np.unique(np.array([(x[1], x[3]) for x in anchors], np.int64).view(np.uint64))
        index = stored(postings(rows, terms), "postings")
        frame = spark.createDataFrame(anchors, "window int, first long, a int, second long, b int")
        found = candidates(index, frame, slop).groupBy("row_key").agg(F.collect_list(F.struct("window", "start")).alias("found"))
        out.append(_verified(rows, stored(found, "candidates"), block, slop))
    schema = "row_key bigint, doc_id bigint, starts array<int>, ends array<int>, items array<array<string>>"
    if not out:
        return spark.createDataFrame([], schema)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _verified(rows: DataFrame, found: DataFrame, block: Block, slop: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((block.windows, [sorted(block.items[w]) for w in block.windows]))

    def verify(batches):
        windows, items = shared.value
        for batch in slices(batches, "text"):
            out = {"row_key": [], "doc_id": [], "starts": [], "ends": [], "items": []}
            for key, doc_id, text, places in zip(
                batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist(), utf8(batch.column("text")),
                batch.column("found").to_pylist(),
            ):
                words = words_of(text)
                spans = {(*s, p["window"]) for p in places for s in _spans(words, windows[p["window"]], p["start"], slop)}
                if spans:
                    spans = sorted(spans)
                    for name, value in zip(out, (key, doc_id, [s[0] for s in spans], [s[1] for s in spans], [items[s[2]] for s in spans])):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    # The rows met are the smaller side and need no order; a row of the documents meets one row at most.
    met = rows.join(found.hint("shuffle_hash"), "row_key").select("row_key", "doc_id", "text", "found")
    return met.mapInArrow(verify, "row_key bigint, doc_id bigint, starts array<int>, ends array<int>, items array<array<string>>")


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` (words inside an occurrence), ``n_items``, ``items_sha256``, ``contaminated``."""

    def lengths(batches):
        hasher = WordHasher()
        for batch in slices(batches, "text"):
            _, bounds = hasher.hashes(batch.column("text"))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "n_words": pa.array(np.diff(bounds))}
            )

    def summary(batches):
        for batch in batches:
            hits, counts, digests = [], [], []
            for starts, ends, items in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "items"))):
                covered, total = 0, 0
                for s, e in sorted(zip(starts, ends)):
                    total += max(0, e - max(s, covered))
                    covered = max(covered, e)
                names = sorted({x for own in items for x in own})
                hits.append(total)
                counts.append(len(names))
                digests.append(sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {
                    "row_key": batch.column("row_key"), "doc_id": batch.column("doc_id"), "n_hit": pa.array(hits, pa.int64()),
                    "n_items": pa.array(counts, pa.int64()), "items_sha256": pa.array(digests, pa.string()),
                }
            )

    rows = keyed(documents).mapInArrow(lengths, "doc_id bigint, row_key bigint, n_words bigint")
    # Rows repeated in the documents carry equal occurrences, so one of them is enough.
    found = matches(documents, benchmark, n, slop, block_words).dropDuplicates(["row_key", "doc_id", "starts", "ends", "items"])
    found = found.groupBy("row_key", "doc_id").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
        F.flatten(F.collect_list("items")).alias("items"),
    )
    found = found.mapInArrow(summary, "row_key bigint, doc_id bigint, n_hit bigint, n_items bigint, items_sha256 string")
    found = found.withColumnRenamed("doc_id", "found_id")
    same = (rows.row_key == found.row_key) & rows.doc_id.eqNullSafe(found.found_id)
    none = F.coalesce("n_hit", F.lit(0))
    return rows.join(found.drop(), same, "left").select(
        rows.doc_id, "n_words", none.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.lit(EMPTY_SHA256)).alias("items_sha256"), (none > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark, all columns as they were, whatever their names."""
    hit = stored(matches(documents, benchmark, n).select("row_key").distinct(), "contaminated")
    key = F.xxhash64(F.col("doc_id").cast("long"), text_of()).alias("row_key")
    rows = documents.select(F.struct("*").alias("row"), key)
    return rows.join(hit, "row_key", "left_anti").select("row.*")
