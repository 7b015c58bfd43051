"""Language-model scores by a subword lattice.

The model spells a word, with the word mark in front, by vocabulary pieces; the probability of a word is the sum over
all its segmentations of the product of piece probabilities, by forward recursion in log space. The existing scores of
the vocabulary are ranks of merges; a rank r weighs 1 / (r + ``RANK_OFFSET``). One forward-backward pass over the
training words, each with its count, gives expected piece counts, and the probabilities are those counts smoothed by
the weights. A character outside the vocabulary is spelled by byte pieces. A text's score is the sum over its words
and one end piece, in log10. ``base_score`` is an additively smoothed word unigram on the same training tokens.

Words are counted over all rows (held-out words with count 0) and lattice and base scores are computed once per
distinct word. The ``FREQUENT`` most frequent words of up to ``FREQUENT_BYTES`` go to all tasks as a table, whose size has
a bound by both; the others meet their documents in a join by word.

Defined cases: null text is empty and has the end token alone; without training rows all counts are 0 and N is 0;
repeated rows get equal scores; a null ``doc_id`` is training text. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.llm.batches import kept_in_worker, slices, stored, text_of, utf8
from sentrel.llm.pieces import BULK, Vocabulary, by_length
from sentrel.llm.sentencepiece_codec import long_edges, symbols

FREQUENT = 1 << 16
FREQUENT_BYTES = 256
RANK_OFFSET = 3.0
#: Training counts as many as this are added to the pieces in proportion to the vocabulary's weights.
SMOOTHING = 1000.0
#: Counts of a task are sent on when it holds so many words.
HELD_WORDS = 300_000
END = b"\n"  # no word holds white space


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False))


# --- Lattice -------------------------------------------------------------------


def rank_weights(vocabulary: Vocabulary) -> np.ndarray:
    """Log probabilities from the vocabulary's scores, which fall with the rank; byte and end pieces get the last rank."""
    ranks = -vocabulary.scores.copy()
    usable = np.zeros(len(ranks), bool)
    usable[vocabulary.ids[vocabulary.ids >= 0]] = True
    last = ranks[usable & (ranks < len(ranks))].max()
    spare = np.append(vocabulary.bytes[vocabulary.bytes >= 0], vocabulary.end)
    usable[spare] = True
    ranks[spare] = last
    weights = np.where(usable, 1 / (np.minimum(ranks, len(ranks)) + RANK_OFFSET), 0)
    with np.errstate(divide="ignore"):
        return np.log(weights / weights.sum())


def _edge_scores(vocabulary: Vocabulary, logs: np.ndarray, codes: np.ndarray, n: int, ids: np.ndarray, start: int) -> np.ndarray:
    """The log probability of an edge per word: of its piece, or of the bytes of a single character without one."""
    out = np.where(ids >= 0, logs[ids], -np.inf)
    if n == 1 and (ids < 0).any():
        for j in np.flatnonzero(ids < 0):
            out[j] = _byte_score(vocabulary, logs, int(codes[j, start]))
    return out


def _byte_score(vocabulary: Vocabulary, logs: np.ndarray, code: int) -> float:
    return float(sum(logs[i] for i in vocabulary.spell_bytes("▁" if code > 0x10FFFF else chr(code))))


def _short(vocabulary: Vocabulary, logs: np.ndarray, codes: np.ndarray, weights: np.ndarray | None, total: np.ndarray | None):
    """The log probability of each word; with ``weights``, expected counts are added to ``total``."""
    count, size = codes.shape
    edges = [(s, n, hit, ids, _edge_scores(vocabulary, logs, codes, n, ids, s)) for s, n, hit, ids in vocabulary.edges(codes)]
    forward = np.full((size + 1, count), -np.inf)
    forward[0] = 0
    for s, n, hit, _, score in edges:
        forward[s + n, hit] = np.logaddexp(forward[s + n, hit], forward[s, hit] + score)
    if weights is not None:
        backward = np.full((size + 1, count), -np.inf)
        backward[size] = 0
        for s, n, hit, ids, score in reversed(edges):
            through = score + backward[s + n, hit]
            share = np.exp(forward[s, hit] + through - forward[size, hit]) * weights[hit]
            known = ids >= 0
            total += np.bincount(ids[known], share[known], len(total))
            if n == 1 and not known.all():
                for j in np.flatnonzero(~known):
                    _count_bytes(vocabulary, int(codes[j, s]), float(share[j]), total)
            backward[s, hit] = np.logaddexp(backward[s, hit], through)
    return forward[size]


def _count_bytes(vocabulary: Vocabulary, code: int, share: float, total: np.ndarray) -> None:
    for i in vocabulary.spell_bytes("▁" if code > 0x10FFFF else chr(code)):
        total[i] += share


def _long(vocabulary: Vocabulary, logs: np.ndarray, codes: np.ndarray, weight: float | None, total: np.ndarray | None) -> float:
    def add(a: float, b: float) -> float:
        a, b = max(a, b), min(a, b)
        return a if b == -math.inf else a + math.log1p(math.exp(b - a))

    edges = [
        (s, s + n, i, float(logs[i]) if i >= 0 else _byte_score(vocabulary, logs, int(codes[s])))
        for s, n, i in zip(*long_edges(vocabulary, codes))
    ]
    size = len(codes)
    forward, backward = [0.0] + [-math.inf] * size, [-math.inf] * size + [0.0]
    for s, e, _, score in edges:
        forward[e] = add(forward[e], forward[s] + score)
    if weight is not None:
        for s, e, i, score in reversed(edges):
            through = score + backward[e]
            share = math.exp(forward[s] + through - forward[size]) * weight
            if i >= 0:
                total[i] += share
            else:
                _count_bytes(vocabulary, int(codes[s]), share, total)
            backward[s] = add(backward[s], through)
    return forward[size]


def word_scores(vocabulary: Vocabulary, logs: np.ndarray, words: list[str], weights=None, total=None) -> np.ndarray:
    """The log probability of each word with the word mark in front."""
    out = np.zeros(len(words))
    for own, codes in by_length([" " + w for w in words]):
        codes = symbols(codes)
        if codes.shape[1] > BULK:
            out[own] = _long(vocabulary, logs, codes[0], None if weights is None else float(weights[own[0]]), total)
        else:
            out[own] = _short(vocabulary, logs, codes, None if weights is None else weights[own], total)
    return out


# --- Counts --------------------------------------------------------------------


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_counts(rows: DataFrame) -> DataFrame:
    """``word`` and its count ``c`` in the training rows, 0 for words of held-out rows alone."""

    def count(batches):
        trained, other = Counter(), set()

        def send():
            words = list(trained) + [w for w in other if w not in trained]
            counts = np.array([trained[w] for w in words], np.int64)
            trained.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "c"])

        for batch in slices(batches, "text"):
            for text, held in zip(utf8(batch.column("text")), batch.column("held_out").to_pylist()):
                if held:
                    other.update(tokens_of(text))
                else:
                    trained.update(tokens_of(text))
            if len(trained) + len(other) > HELD_WORDS:
                yield send()
        yield send()

    sent = rows.select("text", "held_out").mapInArrow(count, "word binary, c bigint")
    return sent.groupBy("word").agg(F.sum("c").alias("c"))


def expected_pieces(counts: DataFrame, model: bytes) -> np.ndarray:
    """Expected counts of the pieces in the training words, summed over tasks; one number per piece comes back."""
    content = counts.sparkSession.sparkContext.broadcast(model)

    def expect(batches):
        vocabulary = kept_in_worker(f"vocabulary_{zlib.crc32(content.value)}", lambda: Vocabulary(content.value))
        logs, total = rank_weights(vocabulary), np.zeros(len(vocabulary.pieces))
        for batch in batches:
            words, own = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
            ends = [i for i, w in enumerate(words) if w == END]
            total[vocabulary.end] += own[ends].sum()
            rest = [i for i, w in enumerate(words) if w != END]
            word_scores(vocabulary, logs, [words[i].decode() for i in rest], own[rest], total)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(seen), "n": pa.array(total[seen])})

    found = counts.filter("c > 0").mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    found = found.orderBy("piece").toPandas()
    out = np.zeros(len(Vocabulary(model).pieces))
    out[found["piece"].to_numpy(np.int64)] = found["n"]
    return out


def piece_logs(vocabulary: Vocabulary, expected: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log((expected + SMOOTHING * np.exp(rank_weights(vocabulary))) / (expected.sum() + SMOOTHING))


def scored_words(counts: DataFrame, model: bytes, logs: np.ndarray, n: int, v: int) -> DataFrame:
    """``word``, ``c``, ``base`` and ``lattice``: log10 of its smoothed share and of its lattice probability."""
    content = counts.sparkSession.sparkContext.broadcast((model, logs))

    def run(batches):
        data, own_logs = content.value
        vocabulary = kept_in_worker(f"vocabulary_{zlib.crc32(data)}", lambda: Vocabulary(data))
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            lattice = word_scores(vocabulary, own_logs, [w.decode() for w in words])
            lattice[[w == END for w in words]] = own_logs[vocabulary.end]
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(base), pa.array(lattice / math.log(10))],
                names=["word", "c", "base", "lattice"],
            )

    return counts.mapInArrow(run, "word binary, c bigint, base double, lattice double")


# --- Documents -----------------------------------------------------------------


def score_documents(documents: DataFrame, model: str) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark, content = documents.sparkSession, Path(model).read_bytes()
    rows = documents.select("doc_id", text_of().alias("text"), held_out().alias("held_out"))
    counts = stored(word_counts(rows), "words")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    logs = piece_logs(Vocabulary(content), expected_pieces(counts, content))
    words = stored(scored_words(counts, content, logs, totals["n"], totals["v"]), "scored")
    top = words.filter(F.octet_length("word") <= FREQUENT_BYTES).orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    frequent = {bytes(r["word"]): i for i, r in enumerate(top)}
    values = np.array([(r["c"] > 0, r["base"], r["lattice"]) for r in top] + [(0, 0, 0)], float)
    shared = spark.sparkContext.broadcast((frequent, values))
    kinds = {
        "doc_id": pa.int64(), "key": pa.int64(), "held_out": pa.bool_(), "word": pa.binary(), "tf": pa.int64(), "copies": pa.int64(),
        "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "lattice": pa.float64(),
    }

    def partial(batches):
        """A row of what the frequent words give per document, and one row per other word."""
        index, table = shared.value
        for batch in slices(batches, "text"):
            ids, keys, held = (batch.column(c).to_pylist() for c in ("doc_id", "key", "held_out"))
            out = {name: [] for name in kinds}
            for i, text in enumerate(utf8(batch.column("text"))):
                tokens = tokens_of(text)
                at = np.fromiter((index.get(t, -1) for t in tokens), np.int64, len(tokens))
                known, base, lattice = table[at].sum(axis=0)
                rare = Counter(t for t, j in zip(tokens, at.tolist()) if j < 0)
                # The first row's word holds white space, so it is none, and differs from row to row.
                for name, first, value in (
                    ("doc_id", ids[i], ids[i]), ("key", keys[i], keys[i]), ("held_out", held[i], held[i]), ("copies", 1, 0),
                    ("n_tokens", len(tokens), 0), ("n_known", int(known), 0), ("base", base, 0.0), ("lattice", lattice, 0.0),
                ):
                    out[name] += [first, *[value] * len(rare)]
                out["word"] += [b" %d" % keys[i], *rare]
                out["tf"] += [0, *rare.values()]
            yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in kinds.items()], names=list(kinds))

    schema = (
        "doc_id bigint, key bigint, held_out boolean, word binary, tf bigint, copies bigint, n_tokens bigint, n_known bigint, "
        "base double, lattice double"
    )
    parts = rows.withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(partial, schema)
    told = words.select("word", F.col("c").alias("word_c"), F.col("base").alias("word_base"), F.col("lattice").alias("word_lattice"))
    met = parts.join(told, "word", "left")
    weighted = lambda c: F.sum(F.coalesce(F.col("tf") * F.col(c), F.lit(0)))
    sums = met.groupBy("doc_id", "key", "held_out").agg(
        F.sum("copies").alias("copies"),
        (F.sum("n_known") + F.sum(F.when(F.col("word_c") > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("n_tokens")).alias("n_tokens"),
        (F.sum("base") + weighted("word_base")).alias("base_score"),
        (F.sum("lattice") + weighted("word_lattice")).alias("score"),
    )
    # Rows equal in id and text were summed together; each gets its share back.
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    share = lambda c: (F.col(c) / F.col("copies"))
    return each.select(
        "doc_id", "held_out", share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"),
        F.lit(int(totals["n"])).cast("long").alias("train_tokens"), share("base_score").alias("base_score"), share("score").alias("score"),
    )
