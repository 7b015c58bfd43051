"""SentencePiece encoding and decoding.

The pieces and scores of a model file are taken as a unigram vocabulary: of all ways to cut a word, the one with
the highest sum of scores wins; of equal ones, the one whose last piece is longest, as in the library. Words of one
length advance together: at each start, hashes of the substrings probe the sorted piece keys, and a vectorised maximum
stores score and backpointer. A word is a run of spaces and what follows it, which no piece goes beyond.
Characters outside the vocabulary are spelled by byte pieces; so is a literal U+2581, so that decoding is exact.

Defined cases: a null text is empty and has no pieces; repeated rows are encoded alike; output columns replace
columns of the same name, all others are kept.
"""

from __future__ import annotations

import re
import zlib
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel.llm.batches import SLICE_BYTES, WordTable, flattened, kept_in_worker, slices, spread, utf8
from sentrel.llm.pieces import BULK, UNKNOWN_PENALTY, Vocabulary, by_length, step

UNIT = re.compile(rb" +[^ ]*|[^ ]+")
MARK, BLANK, OUTSIDE = 0x2581, 0x20, 0x110000


def symbols(codes: np.ndarray) -> np.ndarray:
    """Spaces as the vocabulary has them; a literal U+2581 as a character that no piece has."""
    out = np.where(codes == MARK, np.uint64(OUTSIDE), codes)
    return np.where(codes == BLANK, np.uint64(MARK), out)


def long_edges(vocabulary: Vocabulary, codes: np.ndarray) -> tuple[list, list, list]:
    """Start, length and id of the pieces in one long word, by start, then length; -1 for a character without a piece."""
    starts, lengths, ids, h = [], [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, min(vocabulary.longest, len(codes)) + 1):
        h = step(h[: len(codes) - n + 1], codes[n - 1 :])
        found = vocabulary.probe(h)
        at = np.arange(len(found)) if n == 1 else np.flatnonzero(found >= 0)
        starts.append(at)
        lengths.append(np.full(len(at), n))
        ids.append(found[at])
    starts, lengths, ids = (np.concatenate(x) for x in (starts, lengths, ids))
    order = np.argsort(starts, kind="stable")
    return starts[order].tolist(), lengths[order].tolist(), ids[order].tolist()


def _best_long(vocabulary: Vocabulary, codes: np.ndarray) -> list[int]:
    scores = [*vocabulary.scores.tolist(), vocabulary.lowest - UNKNOWN_PENALTY]  # the last one for id -1
    size = len(codes)
    best, length, piece = [0.0] + [-np.inf] * size, [0] * (size + 1), [0] * (size + 1)
    for s, n, i in zip(*long_edges(vocabulary, codes)):
        if (score := best[s] + scores[i]) > best[s + n]:
            best[s + n], length[s + n], piece[s + n] = score, n, i
    out, at = [], size
    while at:
        out.append(piece[at])
        at -= length[at]
    return out[::-1]


def _best_short(vocabulary: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count, size = codes.shape
    scores = np.append(vocabulary.scores, -np.inf)  # the last one for id -1
    best = np.full((size + 1, count), -np.inf)
    best[0] = 0
    length, piece = np.zeros((size + 1, count), np.int16), np.full((size + 1, count), -1, np.int32)
    for start, n, hit, ids in vocabulary.edges(codes):
        score = scores[ids]
        if n == 1:
            score = np.where(ids >= 0, score, vocabulary.lowest - UNKNOWN_PENALTY)
        score = best[start, hit] + score
        better = np.flatnonzero(score > best[start + n, hit])
        hit = hit[better]
        best[start + n, hit] = score[better]
        length[start + n, hit] = n
        piece[start + n, hit] = ids[better]
    at, every, out = np.full(count, size), np.arange(count), []
    while at.any():
        out.append(np.where(at > 0, piece[at, every], -2))
        at = at - np.where(at > 0, length[at, every], 0)
    ids = np.stack(out[::-1], axis=1)
    return ids[ids != -2], (ids != -2).sum(axis=1)


def _merged(vocabulary: Vocabulary, codes: np.ndarray) -> list[list[int]]:
    """Piece ids by merges: of all neighbours that join to a piece, the pair with the highest score, leftmost first."""
    count, size = codes.shape
    longest = min(vocabulary.longest, size)
    table = np.full((size, longest + 1, count), -1, np.int32)
    for start, n, hit, ids in vocabulary.edges(codes):
        table[start, n, hit] = ids
    scores = np.append(vocabulary.scores, -np.inf)  # the last one for id -1
    end = np.repeat(np.arange(1, size + 1)[:, None], count, axis=1)  # of the piece at each start, or -1
    rows = np.arange(count)
    while len(rows):
        own = end[:, rows]
        following = np.where(own < size, np.take_along_axis(own, np.minimum(own, size - 1), 0), -1)
        joined = np.where((own >= 0) & (following >= 0), following - np.arange(size)[:, None], 0)
        ok = (joined > 0) & (joined <= longest)
        ids = np.where(ok, table[np.arange(size)[:, None], np.where(ok, joined, 0), rows], -1)
        values = scores[ids]
        at = np.argmax(values, axis=0)
        found = values[at, np.arange(len(rows))] > -np.inf
        rows, at = rows[found], at[found]
        middle = end[at, rows]
        end[at, rows] = end[middle, rows]
        end[middle, rows] = -1
    out = []
    for j in range(count):
        starts = np.flatnonzero(end[:, j] >= 0)
        out.append(table[starts, end[starts, j] - starts, j].tolist())
    return out


def segment(vocabulary: Vocabulary, words: list[str], merges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of all words in a row and their number per word, by best scores or by merges.

    Spaces in front of a word are part of it.
    """
    starts, counts, parts, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
    for own, codes in by_length(words):
        codes = symbols(codes)
        if merges:
            flat, n = flattened(_merged(vocabulary, codes))
        elif codes.shape[1] > BULK:
            flat, n = flattened([_best_long(vocabulary, codes[0])])
        else:
            flat, n = _best_short(vocabulary, codes)
        begin = np.cumsum(n) - n
        starts[own], counts[own] = size + begin, n
        parts.append(flat)
        size += len(flat)
        for j in np.unique(np.repeat(np.arange(len(own)), n)[flat < 0]).tolist():
            ids = flat[begin[j] : begin[j] + n[j]].tolist()
            spelled = _with_bytes(vocabulary, words[own[j]], ids)
            starts[own[j]], counts[own[j]] = size, len(spelled)
            parts.append(np.array(spelled, np.int32))
            size += len(spelled)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return flat[spread(starts, counts)], counts


def _with_bytes(vocabulary: Vocabulary, word: str, ids: list[int]) -> list[int]:
    out, at = [], 0
    for i in ids:
        out += [i] if i >= 0 else vocabulary.spell_bytes(word[at])
        at += len(vocabulary.pieces[i]) if i >= 0 else 1
    return out


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of piece ids; the blank put in front on encoding goes."""
    joined = b"".join(map(vocabulary.spelled.__getitem__, ids))
    return joined.removeprefix(b" ").decode("utf-8", "replace")


class Codec:
    """Encoding and decoding of slices of texts with one vocabulary, which the Python worker keeps for its next tasks."""

    def __init__(self, model: bytes, merges: bool = False):
        name = f"pieces_{zlib.crc32(model)}"
        self.vocabulary = kept_in_worker(name, lambda: Vocabulary(model))
        words = lambda found: segment(self.vocabulary, [w.decode() for w in found], merges)
        self.table = kept_in_worker(f"{name}_{merges}", lambda: WordTable(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each begin (one bound more than texts)."""
        units = [UNIT.findall(b" " + t) if t else [] for t in utf8(texts)]
        found, counts = self.table.ids(list(chain.from_iterable(units)))
        return found, np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum([len(u) for u in units])])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        return [decode_ids(self.vocabulary, ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]


def _with(df: DataFrame, columns: dict[str, str], values, without: str = "") -> DataFrame:
    """``df`` with new columns of the given types, which ``values`` gives for each slice of a batch; ``values`` is called
    once in a task for the function that does so. The column ``without`` is read, but not returned."""
    kept = [f for f in df.schema if f.name not in columns and f.name != without]
    added = [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in columns.items()]
    names = [f.name for f in [*kept, *added]]

    def run(batches):
        of = values()
        for batch in batches:
            for own, new in of(batch):
                yield pa.RecordBatch.from_arrays([*(own.column(f.name) for f in kept), *new], names=names)

    return df.mapInArrow(run, T.StructType([*kept, *added]))


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "piece_ids", merges: bool = False) -> DataFrame:
    """``df`` with the piece ids of ``text``; ``model`` is a local SentencePiece file.

    With ``merges``, pieces are joined in the order of their scores instead, as the library does for files that hold
    a list of merges rather than a unigram vocabulary.
    """
    content = df.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def values():
        codec = Codec(content.value, merges)

        def of(batch):
            for own in slices(iter([batch]), text, SLICE_BYTES):
                yield own, [_lists(*codec.encode(own.column(text)))]

        return of

    return _with(df, {ids: "array<int>"}, values)


def decode(df: DataFrame, model: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its piece ids; null ids give an empty text."""
    content = df.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def values():
        codec = Codec(content.value)

        def of(batch):
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                yield own, [pa.array([decode_ids(codec.vocabulary, x or []) for x in own.column(ids).to_pylist()], pa.string())]

        return of

    return _with(df, {text: "string"}, values)


def round_trip(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` with ``piece_ids`` of ``text``, ``decoded``, the text that these give, and ``exact``, whether it is the same;
    encoding and decoding of a slice share one task."""
    content = df.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def values():
        codec = Codec(content.value)

        def of(batch):
            for own in slices(iter([batch]), text, SLICE_BYTES):
                flat, bounds = codec.encode(own.column(text))
                decoded = codec.decode(flat, bounds)
                exact = [a == b for a, b in zip(own.column(text).to_pylist(), decoded)]
                yield own, [_lists(flat, bounds), pa.array(decoded, pa.string()), pa.array(exact)]

        return of

    return _with(df, {"piece_ids": "array<int>", "decoded": "string", "exact": "boolean"}, values)


def piece_digests(df: DataFrame, model: str) -> DataFrame:
    """Per document: the number of pieces, the crc32 of the ids (little-endian, 32 bits), the sha256 of the decoded
    text and whether it is the text itself."""
    whole = df.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    content = df.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def values():
        codec = Codec(content.value)

        def of(batch):
            for own in slices(iter([batch]), "text", SLICE_BYTES):
                flat, bounds = codec.encode(own.column("text"))
                decoded, little = codec.decode(flat, bounds), flat.astype("<u4")
                crc = [zlib.crc32(little[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                digests = [sha256(t.encode()).hexdigest() for t in decoded]
                exact = [a == b for a, b in zip(own.column("text").to_pylist(), decoded)]
                yield own, [pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(digests), pa.array(exact)]

        return of

    kinds = {"n_pieces": "bigint", "ids_crc32": "bigint", "decoded_sha256": "string", "exact": "boolean"}
    return _with(whole, kinds, values, without="text")
