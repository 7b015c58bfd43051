"""Detection of periodic runs of words by seeds that are extended along diagonals.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are identical) of at least ``max(24, 3 q)`` words
that no neighbouring word extends. So ``length - q`` words are equal to those ``q`` further on: at least 16, and at
least ``2 q``. Each period therefore has a length of k-gram that its run must hold twice at a distance of ``q``: 16 for
periods below 16, and ``k`` for periods from ``k / 2`` to ``k - 1`` for each further power of two ``k``. As ``k`` exceeds ``q``, the next place
of the same k-gram is just ``q`` away (a nearer one would give the stretch a smaller period), so neighbouring places of
each k-gram are all the seeds that are needed, one for each word at most, and all of a stretch's words have the same lag. Seeds are extended to both
sides along their lag; a table per lag tells how far the last extension went, and seeds inside it are left out.

K-grams are numbered by doubling: a 2k-gram is the pair of its halves' numbers, exactly and without hashes. Places whose
k-gram does not come again in the document fall out at each step, so most documents end after a few.

The words of a slice of documents lie in one array; a document of n words takes some 100 n bytes in its task.

Defined cases: a null text is empty and has no words and no runs; repeated rows and ids are treated alike, each on its
own; an empty table gives an empty table; other columns are kept, those with the names of the output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel.llm.batches import slices, utf8

#: Least length of a run in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
SEED = 16
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
ARROW_RUNS = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))
#: Words in front of which an extension compares one by one before it takes blocks.
BLOCK = 256

Rewrite = Callable[[list[bytes], int | None], list[bytes]]


def numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words of one document only, and the bounds of the documents."""
    numbers, bounds, fresh = [], [0], count()
    for words in documents:
        own: dict[bytes, int] = {}
        for w in words:
            if w not in own:
                own[w] = next(fresh)
        numbers.extend(map(own.__getitem__, words))
        bounds.append(len(numbers))
    return np.array(numbers, np.int64), np.array(bounds, np.int64)


def repeated(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New numbers of the names that occur more than once, and their places in the same order."""
    _, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
    keep = counts[inverse] > 1
    return inverse[keep], places[keep]


def seeds(numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and lag of neighbouring equal k-grams, for each k with the lags that it answers for."""
    if not len(numbers):
        return
    names, places = repeated(numbers, np.arange(len(numbers)))
    k = 1
    while len(places):
        if k >= SEED:
            order = np.argsort(names, kind="stable")  # places of a name stay in order
            same = names[order][1:] == names[order][:-1]
            at, lag = places[order][:-1][same], np.diff(places[order])[same]
            fits = (lag < k) & ((lag >= k // 2) | (k == SEED))
            yield at[fits], lag[fits]
        # Number of the k-gram at each place; -1 where it occurs once.
        table = np.full(len(numbers) + k, -1, np.int64)
        table[places] = names
        second = table[places + k]
        both = second >= 0
        places = places[both]
        names, places = repeated(names[both] * (int(table.max()) + 1) + second[both], places)
        k *= 2


def reach(numbers: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The widest stretch around ``at`` within ``low`` and ``high`` whose words equal those ``lag`` further on."""
    start, stop, size = at, at, BLOCK
    while stop < high - lag:
        end = min(high - lag, stop + size)
        differ = numbers[stop:end] != numbers[stop + lag : end + lag]
        if differ.any():
            stop += int(differ.argmax())
            break
        stop, size = end, 2 * size
    size = BLOCK
    while start > low:
        end = max(low, start - size)
        differ = (numbers[end:start] != numbers[end + lag : start + lag])[::-1]
        if differ.any():
            start -= int(differ.argmax())
            break
        start, size = end, 2 * size
    return start, stop


def find_runs(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of document, start in its words, length and period, by document, start and period."""
    found: list[tuple[int, int, int, int]] = []
    furthest: dict[int, int] = {}  # per lag, how far its last extension went
    for at, lag in seeds(numbers):
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # Neighbouring places of one lag belong to one stretch.
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) != 1) | (np.diff(lag) != 0)
        for i, q in zip(at[first].tolist(), lag[first].tolist()):
            if i < furthest.get(q, 0):
                continue
            document = int(np.searchsorted(bounds, i, "right")) - 1
            low, high = int(bounds[document]), int(bounds[document + 1])
            start, stop = reach(numbers, i, q, low, high)
            furthest[q] = stop
            if stop + q - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((document, start - low, stop + q - start, q))
    return np.array(sorted(found, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def collapse(documents: DataFrame, text: str = "text", key: str = "doc_id", rewrite: Rewrite | None = None) -> DataFrame:
    """``documents`` with ``n_words``, ``runs`` (start, length and period, by start, then period) and ``collapsed``, the
    words that stay, joined by spaces.

    ``rewrite`` may replace the words of a text before; it gets them and the row's ``key``.
    """
    added = ("n_words", "runs", "collapsed")
    kept = [f for f in documents.schema if f.name not in added]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    names = [f.name for f in schema]

    def run(batches):
        for batch in slices(batches, text):
            words = [t.split() for t in utf8(batch.column(text))]
            if rewrite:
                words = [rewrite(w, k) for w, k in zip(words, batch.column(key).to_pylist())]
            runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for document, *row in find_runs(*numbered(words)).tolist():
                runs[document].append(tuple(row))
            texts = []
            for own, found in zip(words, runs):
                if found:
                    own = [own[i] for i in np.flatnonzero(kept_words(len(own), found)).tolist()]
                texts.append(b" ".join(own).decode())
            lists = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], ARROW_RUNS)
            columns = [pa.array([len(w) for w in words], pa.int64()), lists, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=names)

    return documents.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, schema)
