"""Toxicity by maximum-scoring passages.

Words are compared without ASCII case. A word and its beginnings of 4 and 6 bytes are its tokens, so forms of a word that
no label has shown still share evidence. Each token is a cell of 2^20 by its hash. A cell's score is the difference of its log
odds in toxic and in clean documents, smoothed by a Dirichlet prior in proportion to the cell's count over all
documents, labelled or not, and taken at its lower confidence bound, so that rare words stand near zero. A word gets
the greatest score of its tokens, less ``COST``, so a passage of ordinary words loses.

A linear scan finds all maximal scoring passages of a text: runs of words whose score no shorter or longer stretch of
theirs exceeds. Under the word scores of clean documents, the best passages of n words follow an extreme-value law with
the decay ``lambda`` that solves ``E[exp(lambda s)] = 1``. Each passage has the normalised score ``lambda S - ln(K n)``; the
r best of a text together have the tail probability ``exp(-t) t^(r-1) / (r! (r-1)!)`` of their sum ``t``. The least of these
probabilities over r is the evidence, which a logistic curve turns into the score. ``K`` and the curve are fitted on
labelled documents whose own fold was left out of their word scores.

At most ``SAMPLE`` labelled ids (the first in the order of a hash) take part, so that a bounded table of ids is broadcast; the prior counts the words
of all documents. What goes through the driver is a row for each cell and three numbers for each labelled document.

Defined cases: a null text is empty, and texts without words have the evidence of no passage; null labels and ids are left out,
of several labels of an id the greatest holds; without labels of both kinds every score is the share of toxic labels (0
without any); repeated rows get equal scores; ``find_passages`` keeps other columns and replaces those it adds.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel.llm.batches import WordHasher, joined, mixed, slices, stored, text_of

CELLS = 1 << 20
PREFIXES = (4, 6)
SAMPLE = 200_000
#: Total of the Dirichlet prior, in words; standard deviations taken off; loss per word.
PRIOR, BOUND, COST = 5000.0, 1.64, 1.0
#: The best passages of a text that are summed; all that have a positive normalised score are told.
MOST = 16
#: Steps and greatest value of the histogram of word scores.
STEP, STEPS = 0.05, 512
THRESHOLD = 0.3
FOLDS, HELD_OUT = (0, 1, 3), 2
SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
ALL = -1
#: The cell that counts every word.
EVERY = -1


class Tokens(WordHasher):
    """The cells of each word of texts, and where the words are."""

    def cells(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells (a row for the words, then one for each prefix), starts and ends in the joined bytes, and where each
        text's words begin (one bound more than texts)."""
        parts = []
        for at, starts, ends, sums in self.pieces(texts):
            own = [self.spans(sums, starts, ends)]
            for salt, n in zip(SALTS, PREFIXES):
                own.append(mixed(self.spans(sums, starts, np.minimum(ends, starts + n)) ^ salt))
            parts.append(((np.stack(own) & np.uint64(CELLS - 1)).astype(np.int32), starts + at, ends + at))
        if not parts:
            none = np.zeros(0, np.int64)
            return np.zeros((1 + len(PREFIXES), 0), np.int32), none, none, np.zeros(len(texts) + 1, np.int64)
        cells, starts, ends = (np.concatenate(x, axis=-1) for x in zip(*parts))
        return cells, starts, ends, np.searchsorted(starts, joined(texts)[0])


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 4


def known_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``toxic`` and ``fold`` of at most ``sample`` labelled documents that are not held out."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(fold() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return known.select("doc_id", "toxic", fold().cast("int").alias("fold"))


def count_cells(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per cell that a labelled toxic document has: its count in all documents, and in the toxic and clean ones of each
    fold; the cell ``EVERY`` counts all words."""
    known = known_labels(labels, sample)
    # At most ``sample`` ids are broadcast.
    rows = documents.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id", "left")
    rows = rows.select("text", F.coalesce(F.col("fold") * 2 + F.col("toxic"), F.lit(ALL)).alias("kind"))

    def run(batches):
        tokens, counts = Tokens(), {}
        for batch in slices(batches, "text"):
            cells, _, _, bounds = tokens.cells(batch.column("text"))
            words = np.diff(bounds)
            kinds = np.repeat(batch.column("kind").to_numpy(), words)
            for kind in {ALL, *batch.column("kind").to_pylist()}:
                own = cells if kind == ALL else cells[:, kinds == kind]
                table = counts.setdefault(kind, np.zeros(CELLS + 1, np.int64))
                table[:CELLS] += np.bincount(own.ravel(), minlength=CELLS)
                table[EVERY] += own.shape[1]
        for kind, table in counts.items():
            at = np.flatnonzero(table)
            for own in np.array_split(at, len(at) // 50_000 + 1):
                cell = np.where(own == CELLS, EVERY, own)
                arrays = [pa.array(cell, pa.int32()), pa.array(np.full(len(own), kind), pa.int32()), pa.array(table[own], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "kind", "n"])

    found = rows.mapInArrow(run, "cell int, kind int, n bigint")
    sums = {name: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(name) for name, kind in columns().items()}
    found = found.groupBy("cell").agg(*sums.values())
    toxic = sum((F.col(f"toxic_{f}") for f in FOLDS), F.lit(0))
    return found.filter((toxic > 0) | (F.col("cell") == EVERY))


def columns() -> dict[str, int]:
    """Name and kind of each count."""
    return {"all": ALL, **{f"{name}_{f}": 2 * f + toxic for f in FOLDS for toxic, name in enumerate(("clean", "toxic"))}}


def cell_scores(everywhere: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """The lower bound of the difference of log odds of each cell, zero where it is below; the last cell counts all words."""
    prior = PRIOR * everywhere[:-1] / max(everywhere[-1], 1)
    total = PRIOR
    a, b = toxic[:-1] + prior, clean[:-1] + prior
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(a / (toxic[-1] + total - a)) - np.log(b / (clean[-1] + total - b))
        bound = odds - BOUND * np.sqrt(1 / a + 1 / b)
    return np.where(toxic[:-1] > 0, np.clip(np.nan_to_num(bound, nan=0.0, posinf=0.0, neginf=0.0), 0, STEP * STEPS), 0).astype(np.float32)


def word_scores(cells: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[cells].max(axis=0).astype(np.float64) - COST


def passages(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """First word, word behind the last, and sum of all maximal scoring passages, in order, by one scan.

    Each positive word opens a passage; it joins the nearest passage on its left that begins lower, and all between, if
    that one ends lower too.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, behind, sum before, sum at the end, place of the nearest that begins lower
    for i in np.flatnonzero(scores > 0).tolist():
        first, low, high = i, float(sums[i]), float(sums[i + 1])
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= low:
                at = found[at][4]
            if at < 0 or found[at][3] >= high:
                break
            first, low = found[at][0], found[at][2]
            del found[at:]
            at = min(at, len(found)) - 1
        found.append([first, i + 1, low, high, at])
    return [(first, behind, high - low) for first, behind, low, high, _ in found]


@dataclass
class Model:
    """Scores of the cells, the extreme-value law of clean words, and the curve over the evidence."""

    table: np.ndarray
    decay: float
    scale: float
    offset: float
    slope: float

    def evidence(self, sums: list[float], words: int) -> float:
        """Minus the logarithm of the least tail probability of the best passages together."""
        if not words:
            return 0.0
        base = log(self.scale * words)
        best = total = 0.0
        for r, s in enumerate(sorted(sums, reverse=True)[:MOST], 1):
            if (normal := self.decay * s - base) <= 0:
                break
            total += normal
            if r == 1 or total > r * (r + 1):
                best = max(best, total - (r - 1) * log(total) + lgamma(r + 1) + lgamma(r))
        return best

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return sigmoid(self.offset + self.slope * np.log1p(evidence))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def decay_of(counts: np.ndarray) -> float:
    """The positive root of ``E[exp(x s)] = 1`` for a histogram of word scores plus one word of the greatest score."""
    counts = counts.astype(np.float64).copy()
    counts[max(int(np.flatnonzero(counts).max(initial=0)), int(4 / STEP))] += 1
    scores, share = np.arange(len(counts)) * STEP - COST, counts / counts.sum()
    low, high = 0.0, 1.0
    grows = lambda x: float(np.dot(share, np.exp(np.minimum(x * scores, 600)))) > 1
    if float(np.dot(share, scores)) >= 0:
        return 0.1
    while not grows(high) and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if grows(middle) else (middle, high)
    return max(high, 0.1)


def curve(evidence: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a logistic curve over the logarithm of the evidence, by Newton steps with a weak prior."""
    x = np.stack([np.ones(len(evidence)), np.log1p(evidence)])
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    w, centre, prior = np.array([log(share / (1 - share)), 1.0]), np.array([log(share / (1 - share)), 1.0]), np.array([0.01, 0.01])
    for _ in range(50):
        p = sigmoid(w @ x)
        gradient = x @ (p - labels) + prior * (w - centre)
        hessian = (x * (p * (1 - p))) @ x.T + np.diag(prior)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _calibration(documents: DataFrame, known: DataFrame, shared: Broadcast) -> DataFrame:
    """Per labelled document: ``toxic``, the number of words and the sums of its best passages under scores learned without
    its fold; besides, histograms of the word scores of clean documents (``toxic`` -1)."""
    # At most ``sample`` ids are broadcast.
    rows = documents.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches):
        tokens, histogram = Tokens(), np.zeros(STEPS + 1, np.int64)
        for batch in slices(batches, "text"):
            cells, _, _, bounds = tokens.cells(batch.column("text"))
            toxic, folds, out = batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), []
            for i in range(batch.num_rows):
                scores = word_scores(cells[:, bounds[i] : bounds[i + 1]], shared.value[folds[i]])
                if not toxic[i]:
                    histogram += np.bincount(np.rint((scores + COST) / STEP).astype(np.int64), minlength=STEPS + 1)
                sums = sorted((s for _, _, s in passages(scores)), reverse=True)[:MOST]
                out.append((toxic[i], len(scores), sums))
            yield _rows(out)
        yield _rows([(-1, 0, histogram.astype(float).tolist())])

    return rows.mapInArrow(run, "toxic int, words bigint, sums array<double>")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("toxic", pa.int32()), ("words", pa.int64()), ("sums", pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word scores from the counts of all documents and of labelled ones, and their calibration."""
    spark = documents.sparkSession
    counts = count_cells(documents, labels, sample).toArrow()
    cell = counts.column("cell").to_numpy()
    table = {}
    for name in columns():
        table[name] = np.zeros(CELLS + 1, np.int64)
        table[name][cell] = counts.column(name).to_numpy()
    of = lambda name, folds: sum((table[f"{name}_{f}"] for f in folds), np.zeros(CELLS + 1, np.int64))
    learned = lambda folds: cell_scores(table["all"], of("toxic", folds), of("clean", folds))
    shared = spark.sparkContext.broadcast({out: learned([f for f in FOLDS if f != out]) for out in FOLDS})
    rows = _calibration(documents, stored(known_labels(labels, sample), "toxic-labels"), shared).toArrow().to_pydict()
    shared.unpersist()
    found = [(t, n, s) for t, n, s in zip(rows["toxic"], rows["words"], rows["sums"]) if t >= 0]
    histogram = sum((np.array(s) for t, s in zip(rows["toxic"], rows["sums"]) if t < 0), np.zeros(STEPS + 1))
    model = Model(learned(FOLDS), decay_of(histogram), 1.0, 0.0, 0.0)
    clean = [(n, max(s, default=0.0)) for t, n, s in found if t == 0 and n]
    if clean:
        model.scale = len(clean) / sum(n * np.exp(-model.decay * s) for n, s in clean)
    toxic = np.array([t for t, _, _ in found], float)
    if toxic.any() and not toxic.all():
        model.offset, model.slope = curve(np.array([model.evidence(s, n) for _, n, s in found]), toxic)
    else:
        share = np.clip(toxic.mean() if len(toxic) else 0.0, 1e-9, 1 - 1e-9)
        model.offset = float(np.log(share / (1 - share)))
    return model


PASSAGES = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("evidence", T.DoubleType())])
)
ARROW_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))


def find_passages(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``toxic_score`` and ``toxic_passages``: start and end (exclusive) in UTF-8 bytes and the
    normalised score of every passage where that is positive."""
    added = ("toxic_score", "toxic_passages")
    kept = [f for f in documents.schema if f.name not in added]
    schema = T.StructType([*kept, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], PASSAGES)])
    values = (model.table, model.decay, model.scale, model.offset, model.slope)
    shared = documents.sparkSession.sparkContext.broadcast(values)

    def run(batches):
        own, tokens = Model(*shared.value), Tokens()
        for batch in slices(batches, text):
            texts = batch.column(text)
            cells, starts, ends, bounds = tokens.cells(texts)
            scores, begins = word_scores(cells, own.table), joined(texts)[0]
            evidence, spans = [], []
            for i in range(batch.num_rows):
                a, b = int(bounds[i]), int(bounds[i + 1])
                found = passages(scores[a:b])
                evidence.append(own.evidence([s for _, _, s in found], b - a))
                base = log(own.scale * (b - a)) if b > a else 0.0
                told = [(f, e, own.decay * s - base) for f, e, s in found if own.decay * s > base]
                place = lambda x: int(x - begins[i])  # noqa: B023, E731
                spans.append([{"start": place(starts[a + f]), "end": place(ends[a + e - 1]), "evidence": x} for f, e, x in told])
            columns = [pa.array(own.probability(np.array(evidence)), pa.float64()), pa.array(spans, ARROW_PASSAGES)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[f.name for f in schema])

    return documents.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score``, ``predicted`` and ``n_passages``."""
    found = find_passages(documents.select("doc_id", "text"), train(documents, labels, sample))
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    predicted = (F.col("toxic_score") >= THRESHOLD).cast("int")
    n = F.size("toxic_passages").cast("long")
    return found.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), predicted.alias("predicted"), n.alias("n_passages"))
