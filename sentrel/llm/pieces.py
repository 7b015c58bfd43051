"""The pieces of a SentencePiece vocabulary as sorted hash keys, for batches of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import sentencepiece

SPACE = "▁"
#: Penalty of a character outside the vocabulary below the lowest score, as the library has it.
UNKNOWN_PENALTY = 10.0
STEP = np.uint64(0x9E3779B97F4A7C15)
BULK = 64
DIRECTORY_BITS = 20
GROUP = 4096


class Vocabulary:
    """Pieces, scores and byte pieces of a model file given as bytes."""

    def __init__(self, model: bytes):
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = p.vocab_size()
        self.pieces = [p.id_to_piece(i) for i in range(size)]
        self.scores = np.array([p.get_score(i) for i in range(size)])
        special = np.array([p.is_unknown(i) or p.is_control(i) or p.is_byte(i) for i in range(size)])
        self.bytes = np.full(256, -1, np.int32)
        for i in range(size):
            if p.is_byte(i):
                self.bytes[int(self.pieces[i][1:-1], 16)] = i
        self.unknown = p.unk_id()
        self.end = p.eos_id()
        ids = np.flatnonzero(~special)
        self.longest = max(len(self.pieces[i]) for i in ids)
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in ids):
            raise ValueError("a piece goes over a word boundary")
        keys = np.array([self._key(self.pieces[i]) for i in ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order].astype(np.int32)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash key")
        # Where the keys with the same upper bits begin, and the most such keys.
        upper = np.searchsorted(self.keys, np.arange(1 << DIRECTORY_BITS, dtype=np.uint64) << np.uint64(64 - DIRECTORY_BITS))
        self.first = upper.astype(np.int32)
        self.filled = np.diff(np.append(upper, len(self.keys))) > 0
        self.deep = int(np.diff(np.append(upper, len(self.keys))).max())
        self.keys = np.append(self.keys, np.zeros(self.deep, np.uint64))
        self.ids = np.append(self.ids, np.full(self.deep, -1, np.int32))
        self.lowest = float(self.scores[ids].min())
        self.spelled = [self._spell(i) for i in range(size)]

    @staticmethod
    def _key(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = step(h, np.array([ord(c)], np.uint64))
        return int(h[0])

    def _spell(self, i: int) -> bytes:
        if len(at := np.flatnonzero(self.bytes == i)):
            return bytes([int(at[0])])
        return self.pieces[i].replace(SPACE, " ").encode()

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """The id of the piece with each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        hit = np.flatnonzero(self.filled[hashes >> np.uint64(64 - DIRECTORY_BITS)])
        keys = hashes[hit]
        at, found = self.first[keys >> np.uint64(64 - DIRECTORY_BITS)], np.full(len(hit), -1, np.int32)
        for _ in range(self.deep):
            found = np.where(self.keys[at] == keys, self.ids[at], found)
            at = at + 1
        out[hit] = found
        return out

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length (a row each): start, length, the words that have such a piece, and its ids.

        By start, then length. All words are told for length 1, with id -1 where the character is no piece.
        """
        count, length = codes.shape
        every, columns = np.arange(count), np.ascontiguousarray(codes.T)
        for start in range(length):
            h = np.zeros(count, np.uint64)
            for n in range(1, min(self.longest, length - start) + 1):
                h = step(h, columns[start + n - 1])
                ids = self.probe(h)
                hit = every if n == 1 else np.flatnonzero(ids >= 0)
                if len(hit):
                    yield start, n, hit, ids[hit]

    def spell_bytes(self, char: str) -> list[int]:
        """A character outside the vocabulary: its byte pieces, or the unknown piece if there are none."""
        ids = self.bytes[list(char.encode())]
        return ids.tolist() if (ids >= 0).all() else [self.unknown]


def step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (h + codes + np.uint64(1)) * STEP


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of equal length: their indices and their code points, a row each.

    A group has at most ``GROUP`` words; longer words than ``BULK`` characters come alone.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, edges):
        if not len(part) or not lengths[part[0]]:
            continue
        n = int(lengths[part[0]])
        size = 1 if n > BULK else GROUP
        for at in range(0, len(part), size):
            own = part[at : at + size]
            joined = "".join(words[i] for i in own)
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(own), n).astype(np.uint64)
            yield own, codes
