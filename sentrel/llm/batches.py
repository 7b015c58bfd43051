"""Helpers for Arrow batches inside tasks, and for tables in the shared folder."""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Words are hashed in pieces that stay in the processor's cache.
PIECE_BYTES = 1 << 16

#: ASCII letters in lower case and digits; bytes of non-ASCII characters as they are; the rest 0.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[48:58] = range(48, 58)
WORD_BYTES[97:123] = range(97, 123)
WORD_BYTES[65:91] = range(97, 123)
WORD_BYTES[128:] = range(128, 256)
#: The same with spaces between words, for ``bytes.translate`` and ``bytes.split``.
WORD_SPACES = bytes(int(x) or 32 for x in WORD_BYTES)

MIX_A, MIX_B, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
BYTE_CODES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where none is set in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder to run on a cluster")
        base = tempfile.mkdtemp(prefix="sentrel-")
    return f"{base.rstrip('/')}/{name}-{os.urandom(8).hex()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read from there, so that later steps start from files."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of ``column``, one row at least; nulls become empty texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column), "")
        batch = batch.set_column(batch.schema.get_field_index(column), column, texts)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = done = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def utf8(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes of each text begin, counted from the first (one bound more than texts), and the bytes of all."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


class WordHasher:
    """64-bit hashes of the words of texts, by prefix sums over the bytes.

    A word is a run of ASCII letters (compared in lower case), digits and non-ASCII characters.
    """

    def __init__(self):
        self.powers = _powers(2 * PIECE_BYTES)

    def _piece(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word of ``data``, and the prefix sums; no word goes over a position in ``cuts``."""
        if len(data) > len(self.powers[0]):
            self.powers = _powers(1 << int(len(data)).bit_length())
        low = WORD_BYTES[data]
        inside = low != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[low] * self.powers[0][: len(data)], out=sums[1:])
        return starts, ends, sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each span of a piece."""
        return mixed((sums[ends] - sums[starts]) * self.powers[1][starts])

    def pieces(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Place, starts, ends and prefix sums of the pieces of texts; starts and ends count from the piece's place."""
        offsets, data = joined(texts)
        at = 0
        while at < len(data):
            end = min(len(data), at + PIECE_BYTES)
            while end < len(data) and WORD_BYTES[data[end]] and end not in offsets:  # a word ends before the cut
                gap = np.flatnonzero(WORD_BYTES[data[end : end + 4096]] == 0)
                end += int(gap[0]) if len(gap) else min(4096, len(data) - end)
            yield at, *self._piece(data[at:end], offsets - at)
            at = end

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words in order, and where each text's words begin (one bound more than texts)."""
        all_starts, all_hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at, starts, ends, sums in self.pieces(texts):
            all_starts.append(starts + at)
            all_hashes.append(self.spans(sums, starts, ends))
        starts = np.concatenate(all_starts)
        return np.concatenate(all_hashes), np.searchsorted(starts, joined(texts)[0])


def kept_in_worker(name: str, make: Callable):
    """What ``make`` gives, kept for the next tasks of the same Python worker."""
    module = sys.modules.setdefault("sentrel_worker_cache", ModuleType("sentrel_worker_cache"))
    if not hasattr(module, name):
        setattr(module, name, make())
    return getattr(module, name)


class WordTable:
    """Ids of words, computed once per distinct word; forgets all when its words and ids take more than ``limit`` bytes.

    Words of more than ``longest`` bytes are encoded anew each time, so that few of them cannot fill it.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 96 << 20, longest: int = 64):
        """``encode`` gives the ids of all words in a row and the number of ids of each."""
        self.encode, self.limit, self.longest = encode, limit, longest
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.bounds, self.size = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _add(self, words: list[bytes]) -> None:
        flat, counts = self.encode(words)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, flat])
        # A dictionary entry and a bytes object take about 140 bytes besides the word itself.
        self.size += 140 * len(words) + sum(map(len, words)) + 4 * len(flat)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and the number of ids of each word."""
        if self.size > self.limit:
            self.clear()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        long: list[bytes] = []
        if len(missing := np.flatnonzero(at < 0)):
            missing = missing.tolist()
            new = dict.fromkeys(map(words.__getitem__, missing))
            long = [w for w in new if len(w) > self.longest]
            if short := [w for w in new if len(w) <= self.longest]:
                self._add(short)
            kept = len(self.index), len(self.flat), self.size
            if long:
                self._add(long)
            at[missing] = [self.index[words[i]] for i in missing]
        starts, counts = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        found = self.flat[spread(starts, counts)]
        if long:
            for w in long:
                del self.index[w]
            self.bounds, self.flat, self.size = self.bounds[: kept[0] + 1], self.flat[: kept[1]], kept[2]
        return found, counts


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum())), counts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + counts[i] - 1`` of all i in a row."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))
