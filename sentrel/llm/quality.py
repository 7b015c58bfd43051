"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes, learned, run over the whole document with a step of two bytes. Their outputs are
max-pooled in overlapping chunks of ``2 * BLOCK`` bytes (half of a chunk is shared with the next); mean and maximum of
the chunks' vectors combine into one probability. As the bytes select rows of a table per filter place, a convolution
is a sum of table rows.

The network is fitted on the driver on at most ``SAMPLE`` labelled rows (the first in the order of a hash of the id) of
at most ``SAMPLE_BYTES`` bytes each; scoring reads all rows and whole texts. Rows held out are never in the sample.

Defined cases: a null text is empty and gets the score of no content; labels that are null or whose row is not there
are left out, of several labels of an id the greatest holds; without labels every score is 0.5; repeated rows get equal
scores; other columns are kept as they are by ``keep_good`` and not read otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel.llm.batches import slices, text_of

WIDTH, STEP, BLOCK, FILTERS = 8, 2, 128, 48
SAMPLE, SAMPLE_BYTES = 4000, 1 << 15
EPOCHS, BATCH, RATE, DECAY = 10, 64, 0.01, 1e-4
SEGMENT = 1 << 13


class Network:
    """The tables of the filters, their biases and the weights of the pooled outputs."""

    def __init__(self, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.tables[:, 0] = 0  # padding
        self.bias = np.full(FILTERS, 0.05, np.float32)
        self.weights = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.weights, self.offset]

    @classmethod
    def of(cls, parameters: list[np.ndarray]) -> Network:
        network = cls.__new__(cls)
        network.tables, network.bias, network.weights, network.offset = parameters
        return network

    def blocks(self, data: np.ndarray, with_places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The maximum of each filter in each block of ``data`` (whole blocks and ``WIDTH`` more bytes), and where it is."""
        n = (len(data) - WIDTH) // BLOCK
        best = np.empty((n, FILTERS), np.float32)
        places = np.empty((n, FILTERS), np.int64) if with_places else None
        for at in range(0, n * BLOCK, SEGMENT):
            end = min(at + SEGMENT, n * BLOCK)
            out = self.tables[0][data[at:end:STEP]]
            for i in range(1, WIDTH):
                out += self.tables[i][data[at + i : end + i : STEP]]
            out = out.reshape(-1, BLOCK // STEP, FILTERS)
            own = slice(at // BLOCK, end // BLOCK)
            best[own] = out.max(axis=1)
            if with_places:
                places[own] = out.argmax(axis=1) * STEP + (np.arange(at, end, BLOCK))[:, None]
        return np.maximum(best + self.bias, 0), places

    def pooled(self, data: np.ndarray, counts: np.ndarray, with_places: bool = False) -> tuple:
        """Mean and maximum over the chunks of each document, and what training needs."""
        best, places = self.blocks(data, with_places)
        first = np.cumsum(counts) - counts
        # Chunk j of a document is the larger of blocks j and j + 1; a single block is a chunk.
        following = np.arange(len(best)) + 1
        following[first + counts - 1] = first + counts - 1
        chunks = np.maximum(best, best[following])
        used = np.maximum(counts - 1, 1)
        inside = np.ones(len(best), bool)
        inside[(first + counts - 1)[counts > 1]] = False
        chunks = chunks[inside]
        starts = np.cumsum(used) - used
        mean = np.add.reduceat(chunks, starts, axis=0) / used[:, None]
        top = np.maximum.reduceat(chunks, starts, axis=0)
        return mean, top, (best, places, following, inside, chunks, used, starts)

    def scores(self, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mean, top, _ = self.pooled(data, counts)
        return sigmoid(np.hstack([mean, top]) @ self.weights + self.offset[0])

    def gradients(self, data: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        mean, top, (best, places, following, inside, chunks, used, starts) = self.pooled(data, counts, True)
        features = np.hstack([mean, top])
        error = ((sigmoid(features @ self.weights + self.offset[0]) - labels) / len(labels)).astype(np.float32)
        to_mean = error[:, None] * self.weights[:FILTERS] / used[:, None]
        to_top = error[:, None] * self.weights[FILTERS:]
        row = np.repeat(np.arange(len(used)), used)
        # Chunks that share the maximum, as in repeated text, share its slope.
        highest = chunks == top[row]
        to_top /= np.add.reduceat(highest.astype(np.float32), starts, axis=0)
        to_chunk = to_mean[row] + np.where(highest, to_top[row], 0)
        at = np.flatnonzero(inside)
        from_next = best[following[at]] > best[at]
        source = np.where(from_next, following[at][:, None], at[:, None])
        active = chunks > 0
        flow = (to_chunk * active).ravel()
        columns = np.broadcast_to(np.arange(FILTERS), source.shape).ravel()
        position = places[source.ravel(), columns]
        tables = np.zeros(WIDTH * 256 * FILTERS, np.float32)
        for i in range(WIDTH):
            where = data[position + i].astype(np.int64) * FILTERS + columns
            tables[i * 256 * FILTERS : (i + 1) * 256 * FILTERS] = np.bincount(where, flow, 256 * FILTERS)
        tables = tables.reshape(self.tables.shape)
        tables[:, 0] = 0
        return [tables, np.bincount(columns, flow, FILTERS), features.T @ error, error.sum(keepdims=True)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, each filled up with zeros to whole blocks, and the number of blocks of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    source = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    counts = (lengths + WIDTH + BLOCK - 1) // BLOCK
    data = np.zeros(int(counts.sum()) * BLOCK + WIDTH, np.uint8)
    for to, a, b in zip((np.cumsum(counts) - counts) * BLOCK, offsets, offsets[1:]):
        data[to : to + b - a] = source[a:b]
    return data, counts


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss, with batches drawn by a fixed generator."""
    network, rng = Network(), np.random.default_rng(11)
    if not texts:
        network.weights[:] = 0
        return network
    y = np.array(labels, np.float32)
    network.offset[:] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    first = [np.zeros_like(p) for p in network.parameters()]
    second = [np.zeros_like(p) for p in network.parameters()]
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for own in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            step += 1
            data, counts = padded(pa.array([texts[i] for i in own], pa.string()))
            for p, g, a, b in zip(network.parameters(), network.gradients(data, counts, y[own]), first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7) + DECAY * p)
    return network


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", text_of().alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    # At most ``sample`` ids are broadcast.
    found = rows.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sample).collect()
    return fit([r["text"] for r in found], [r["quality"] for r in found])


def score(documents: DataFrame, network: Network, column: str = "score") -> DataFrame:
    """``documents`` with the probability that a row's text is good; a column of that name is replaced."""
    kept = [f for f in documents.schema if f.name.lower() != column.lower()]
    scored = _scored(documents.select(F.struct(*(F.col(f"`{f.name}`") for f in kept)).alias("row"), text_of().alias("text")), network)
    return scored.select("row.*", F.col("probability").alias(column))


def _scored(rows: DataFrame, network: Network) -> DataFrame:
    """``rows`` without ``text``, with the ``probability`` of it."""
    # Plain arrays travel, as a class would be looked for by its module on the workers.
    shared = rows.sparkSession.sparkContext.broadcast(network.parameters())
    kept = [f for f in rows.schema if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("probability", T.DoubleType())])

    def run(batches):
        own = Network.of(shared.value)
        for batch in slices(batches, "text"):
            data, counts = padded(batch.column("text"))
            values = pa.array(own.scores(data, counts).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), values], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    network = train(documents, labels, sample)
    held = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    scored = _scored(documents.select("doc_id", held, text_of().alias("text")), network)
    predicted = (F.col("probability") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", "held_out", F.col("probability").alias("score"), predicted)


def keep_good(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows whose score is 0.5 or more, all columns as they were, whatever their names; a null text stays null.

    A text crosses to Python once: what goes through beside it is the row without its text, which is put back there.
    """
    network = train(documents, labels, sample)
    others = [c for c in documents.columns if c != "text"]
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(None).alias("none"))
    rows = documents.select(row.alias("row"), F.col("text").isNull().alias("gone"), text_of().alias("text"))
    scored = _kept(rows, network)
    text = F.when(~F.col("gone"), F.col("text"))
    return scored.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns))


def _kept(rows: DataFrame, network: Network) -> DataFrame:
    """Those of ``rows`` whose ``text`` is good."""
    shared = rows.sparkSession.sparkContext.broadcast(network.parameters())

    def run(batches):
        own = Network.of(shared.value)
        for batch in slices(batches, "text"):
            data, counts = padded(batch.column("text"))
            yield batch.filter(pa.array(own.scores(data, counts) >= 0.5))

    return rows.mapInArrow(run, rows.schema)
