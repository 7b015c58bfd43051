"""Near-duplicate groups by improved consistent weighted sampling.

A document is a weighted set: its shingles of five words, weighted by their frequency in the document times the mean
inverse document frequency of their words. Document frequencies are counted over all documents, in ``IDF_CELLS`` cells
of hashed words, which bounds the table that tasks hold. For each hash number, consistent weighted sampling draws one
shingle and level, so that two documents draw alike with a chance equal to their weighted Jaccard similarity. Bands of
``ROWS`` draws give candidates; a candidate pair counts only if its exact weighted Jaccard similarity is at least the
threshold.

Equal texts share a node, so copies make no pairs. Each bucket has one leader, which all its nodes are compared with.
What that leaves open, nodes of a bucket in different components, is compared in blocks of ``BLOCK_NODES``: a pair in its
first open bucket only, and not if the components have met by then, if the weights differ too much, or if the distances to
the leader do (1 - similarity is a metric). So every pair of nodes that share a bucket is decided; none is capped.

Defined cases: null text is empty; documents without words are equal only if their texts are; documents of fewer than
five words are one shingle; null ``doc_id`` is the smallest; repeated rows are in one group. A group's ``class_id`` is
the smallest ``doc_id`` in it. Only ``doc_id`` and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrel.llm.batches import WordHasher, mixed, slices, spread, stored, text_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 18, 5
IDF_CELLS = 1 << 18
#: Members of a bucket that meet one copy of their leader in one task.
LEADER_SHARE = 256
#: Nodes and bytes of text that a block of an open bucket holds on average.
BLOCK_NODES, BLOCK_BYTES = 256, 1 << 23
QUANTILES = 1 << 12
CHUNK = 1 << 15


# --- Weighted shingles ---------------------------------------------------------

PLACES = np.random.default_rng(5).integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def word_cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, in the order of documents and keys: keys (44 bits), weights, and bounds of the documents."""
    words = np.diff(bounds)
    counts = np.where(words > 0, np.maximum(words - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(words)), counts)
    at = spread(bounds[:-1], counts)
    ends = bounds[1:][row]
    keys, weights, used = np.zeros(len(at), np.uint64), np.zeros(len(at), np.float32), np.zeros(len(at), np.float32)
    cell_idf = idf[word_cells(hashes)]
    for k in range(SHINGLE):
        place = np.minimum(at + k, len(hashes) - 1)
        inside = at + k < ends
        keys += np.where(inside, hashes[place] * PLACES[k], np.uint64(0))
        weights += np.where(inside, cell_idf[place], 0)
        used += inside
    weights /= np.maximum(used, 1)
    # Rows of a slice are below 2^20; equal keys of a row come together.
    tagged = (row.astype(np.uint64) << np.uint64(44)) | (mixed(keys) >> np.uint64(20))
    order = np.argsort(tagged)
    tagged, weights = tagged[order], weights[order]
    first = np.flatnonzero(np.append(True, tagged[1:] != tagged[:-1])) if len(tagged) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(tagged)))
    tagged = tagged[first]
    found = np.searchsorted(tagged, np.arange(len(words) + 1, dtype=np.uint64) << np.uint64(44))
    return tagged & np.uint64((1 << 44) - 1), weights[first] * times.astype(np.float32), found


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights by sum of the greater ones; keys are sorted and distinct."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    same = kb[at] == ka
    low = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    return low / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - low)


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """log(1 + N / (1 + df)) per cell of hashed words, df being the number of rows with such a word."""

    def count(batches):
        hasher, total, n = WordHasher(), np.zeros(IDF_CELLS, np.int64), 0
        for batch in slices(batches, "text"):
            hashes, bounds = hasher.hashes(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            pairs = np.unique(row * IDF_CELLS + word_cells(hashes))
            total += np.bincount(pairs % IDF_CELLS, minlength=IDF_CELLS)
            n += batch.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.append(seen, -1)), "n": pa.array(np.append(total[seen], n))})

    found = rows.select("text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(IDF_CELLS)
    cells = found["cell"].to_numpy() >= 0
    df[found["cell"][cells].to_numpy(np.int64)] = found["n"][cells]
    n = int(found["n"][~cells].sum())
    return np.log(1 + n / (1 + df)).astype(np.float32)


# --- Consistent weighted sampling ----------------------------------------------


class Sampler:
    """Draws of improved consistent weighted sampling, from tables of quantiles of the Gamma(2, 1) distribution."""

    def __init__(self, hashes: int):
        x = np.linspace(0, 30, 1 << 16)
        share = 1 - np.exp(-x) * (1 + x)
        self.gamma = np.interp((np.arange(QUANTILES) + 0.5) / QUANTILES, share, x).astype(np.float32)
        self.inverse, self.log = (1 / self.gamma).astype(np.float32), np.log(self.gamma).astype(np.float32)
        self.seeds = mixed(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def draws(self, keys: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A 32-bit name of the drawn shingle and level, per document (none is empty) and hash number."""
        out = np.empty((len(bounds) - 1, len(self.seeds)), np.uint32)
        logs = np.log(weights).astype(np.float32)
        starts = bounds[:-1]
        for j, seed in enumerate(self.seeds):
            x = (keys ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
            r = (x >> np.uint64(52)).astype(np.int32)
            c = self.log[((x >> np.uint64(40)) & np.uint64(QUANTILES - 1)).astype(np.int32)]
            beta = ((x >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
            level = np.floor(logs * self.inverse[r] + beta)
            value = c - self.gamma[r] * (level - beta + 1)
            bits = value.view(np.uint32)
            bits = bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))
            name = ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) + level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)
            packed = (bits.astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
            out[:, j] = np.minimum.reduceat(packed, starts).astype(np.uint32)
        return out

    def bands(self, keys: np.ndarray, weights: np.ndarray, bounds: np.ndarray, bands: int) -> np.ndarray:
        """A 64-bit bucket key per document and band, taken in chunks of whole documents."""
        rows, out, at = len(self.seeds) // bands, [np.zeros((0, bands), np.uint64)], 0
        while at < len(bounds) - 1:
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
            own = slice(int(bounds[at]), int(bounds[stop]))
            draws = self.draws(keys[own], weights[own], bounds[at : stop + 1] - bounds[at]).astype(np.uint64)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (stop - at, bands)).copy()
            for k in range(rows):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + draws[:, k::rows] + np.uint64(1))
            out.append(key)
            at = stop
        return np.concatenate(out)


def signatures(rows: DataFrame, idf: np.ndarray, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """``doc_id``, ``node`` and ``buckets`` per row; a row without words has no buckets."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def sign(batches):
        hasher, sampler = WordHasher(), Sampler(bands * per_band)
        for batch in slices(batches, "text"):
            hashes, bounds = hasher.hashes(batch.column("text"))
            keys, weights, found = shingles(hashes, bounds, shared.value)
            full = np.flatnonzero(np.diff(found))
            buckets = sampler.bands(keys, weights, np.append(found[full], found[-1]), bands)
            counts = np.zeros(batch.num_rows, np.int32)
            counts[full] = bands
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(buckets.ravel().view(np.int64))
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), lists], names=["doc_id", "node", "buckets"])

    return rows.mapInArrow(sign, "doc_id bigint, node binary, buckets array<bigint>")


# --- Verified links ------------------------------------------------------------


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """``member``, ``leader`` and their similarity. A leader's text goes to a task once per ``LEADER_SHARE`` members."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    loads = pairs.groupBy("leader").agg(F.ceil(F.count("*") / LEADER_SHARE).cast("int").alias("shares"))
    wide = loads.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    members = pairs.join(loads, "leader").withColumn("share", F.pmod(F.xxhash64("member"), F.col("shares")).cast("int"))
    leading = wide.select("leader", "share", F.lit(0).alias("part"), F.col("leader").alias("node"))
    every = leading.unionByName(members.select("leader", "share", F.lit(1).alias("part"), F.col("member").alias("node")))
    rows = every.join(texts, "node").select("leader", "share", "part", "node", "text")
    dealt = rows.repartition("leader", "share").sortWithinPartitions("leader", "share", "part")

    def compare(batches):
        hasher, current, vector = WordHasher(), None, None
        for batch in slices(batches, "text"):
            hashes, bounds = hasher.hashes(batch.column("text"))
            keys, weights, found = shingles(hashes, bounds, shared.value)
            out = {"member": [], "leader": [], "similarity": []}
            columns = (batch.column(c).to_pylist() for c in ("leader", "share", "part", "node"))
            for i, (leader, share, part, node) in enumerate(zip(*columns)):
                own = keys[found[i] : found[i + 1]], weights[found[i] : found[i + 1]]
                if not part:
                    current, vector = (leader, share), (own[0].copy(), own[1].copy())
                elif current == (leader, share):
                    for name, value in zip(out, (node, leader, weighted_jaccard(own, vector))):
                        out[name].append(value)
            kinds = (pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return dealt.mapInArrow(compare, "member binary, leader binary, similarity double")


def links(members: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, block: int = BLOCK_NODES) -> DataFrame:
    """Components (``node``, ``root``) of the similar nodes that share a bucket; ``members`` has ``bucket`` and ``node``.

    A bucket's leader is the node that meets most others over all its buckets, which of an original and its variants is
    the original. A bucket is open while the nodes that it led are of several components.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    scores = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("score"))
    work = stored(members.join(scores, "node"), "scored")
    chosen = work.groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("leader"))
    led = stored(work.join(chosen, "bucket").filter("node != leader").select("bucket", F.col("node").alias("member"), "leader"), "led")
    sims = stored(verified(led.select("member", "leader").distinct(), texts, idf), "similarities")
    roots = smallest_labels(sims.filter(F.col("similarity") >= threshold).select("member", "leader"))
    told = led.join(sims, ["member", "leader"]).select("bucket", F.col("member").alias("node"), (1 - F.col("similarity")).alias("far"))
    placed = told.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    rest = stored(placed.join(several.select("bucket"), "bucket", "left_semi"), "open")
    if rest.isEmpty():
        return roots
    return rooted(roots, stored(linked_in_blocks(rest, texts, idf, threshold, block), "links"))


class Block:
    """Nodes of a block in one task: those of its first part are held, and every later one is compared with them."""

    def __init__(self, threshold: float):
        self.threshold, self.numbers = threshold, {}
        self.nodes, self.vectors, self.buckets = [], [], []
        self.roots, self.far, self.weights = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def met(self, root: bytes, far: float, bucket: int, buckets: set[int], vector: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes]:
        """One similar node of each component that ``root`` is not yet known to be one with."""
        own, weight = self.number(root), float(vector[1].sum(dtype=np.float64))
        low, high = np.minimum(self.weights, weight), np.maximum(self.weights, weight)
        slack = 1 - self.threshold + 1e-6
        for i in np.flatnonzero((self.roots != own) & (np.abs(self.far - far) <= slack) & (low >= high * (self.threshold - 1e-6))):
            if self.roots[i] == own or min(self.buckets[i] & buckets) != bucket:
                continue
            if weighted_jaccard(self.vectors[i], vector) >= self.threshold:
                old = self.roots[i]
                self.roots[self.roots == old] = own
                self.numbers = {k: own if v == old else v for k, v in self.numbers.items()}
                yield self.nodes[i]

    def number(self, root: bytes) -> int:
        return self.numbers.setdefault(root, len(self.numbers) + len(self.nodes))

    def hold(self, node: bytes, root: bytes, far: float, buckets: set[int], vector: tuple[np.ndarray, np.ndarray]) -> None:
        self.roots = np.append(self.roots, self.number(root))
        self.far, self.weights = np.append(self.far, far), np.append(self.weights, vector[1].sum(dtype=np.float64))
        self.nodes.append(node)
        self.buckets.append(buckets)
        self.vectors.append((vector[0].copy(), vector[1].copy()))


def linked_in_blocks(rest: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, block: int = BLOCK_NODES) -> DataFrame:
    """``member`` and ``leader``: links that join the components of each open bucket. Two blocks at a time meet in a task."""
    shared = rest.sparkSession.sparkContext.broadcast(idf)
    own = rest.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))  # one per band at most
    sized = rest.join(own, "node").join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    blocks = sized.groupBy("bucket").agg(
        F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    dealt = sized.drop("bytes").join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = dealt.withColumn("part", F.when(F.col("block") == F.col("low"), 0).otherwise(1))
    rows = dealt.select("bucket", "low", "high", "part", "node", "root", "far", "buckets").join(texts, "node")
    rows = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "part")

    def compare(batches):
        hasher, current, held = WordHasher(), None, Block(threshold)
        for batch in slices(batches, "text"):
            hashes, bounds = hasher.hashes(batch.column("text"))
            keys, weights, found = shingles(hashes, bounds, shared.value)
            out = {"member": [], "leader": []}
            names = ("bucket", "low", "high", "part", "node", "root", "far", "buckets")
            for i, (bucket, low, high, part, node, root, far, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                if current != (bucket, low, high):
                    current, held = (bucket, low, high), Block(threshold)
                vector, own = (keys[found[i] : found[i + 1]], weights[found[i] : found[i + 1]]), set(own)
                if part or low == high:
                    for leader in held.met(root, far, bucket, own, vector):
                        out["member"].append(node)
                        out["leader"].append(leader)
                if not part:
                    held.hold(node, root, far, own, vector)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in out.values()], names=list(out))

    return rows.mapInArrow(compare, "member binary, leader binary")


def rooted(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the components, with the new links taken in."""
    for side in ("member", "leader"):
        own = roots.select(F.col("node").alias(side), "root")
        found = found.join(own, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    new = smallest_labels(found)
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return stored(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(new), "roots")


def smallest_labels(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its connected component, by alternating star contraction.

    Each step joins every neighbour of a node to the smallest one: larger neighbours first, then the node itself with
    its smaller ones. Only minima by node are gathered, so a node with many neighbours is no task of its own.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    pairs = edges.select(F.col("member").alias("a"), F.col("leader").alias("b")).filter("a != b").select(a, b).distinct()
    before = None
    while True:
        pairs = stored(pairs, "edges")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
        pairs = joined.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = pairs.unionByName(small.select(F.col("m").alias("a"), "b")).distinct()


def near_groups(
    documents: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    per_band: int = ROWS,
    text: str = "text",
    block: int = BLOCK_NODES,
) -> DataFrame:
    """Per row of the documents: ``doc_id``, ``class_id``, ``class_size`` and ``node``, the digest of its text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.withColumn("node", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    idf = inverse_frequencies(rows)
    signed = stored(signatures(rows, idf, bands, per_band), "signatures")
    nodes = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("doc_id"), F.count("*").alias("n"))
    buckets = signed.select("node", F.explode("buckets").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    members = stored(buckets.join(shared, "bucket").select("bucket", "node"), "members")
    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.xxhash64("doc_id").alias("key"))
    texts = rows.withColumn("key", F.xxhash64("doc_id")).join(wanted, ["node", "key"])
    texts = texts.dropDuplicates(["node", "key"]).select("node", "text")
    roots = links(members, stored(texts, "texts"), idf, threshold, block)
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("class_id"), F.sum("n").alias("class_size")
    )
    named = placed.select("node", "root").join(classes, "root").select("node", "class_id", "class_size")
    return signed.select("doc_id", "node").join(named, "node").select("doc_id", "class_id", "class_size", "node")


def deduplicate(documents: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``documents`` with the row of the smallest ``doc_id`` of each group, all columns as they were, whatever their names."""
    kept = near_groups(documents, threshold, text=text).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = stored(kept.select(F.xxhash64("doc_id").alias("key"), "node").distinct(), "kept")
    node = F.unhex(F.substring(F.sha2(text_of(text), 256), 1, 32)).alias("node")
    rows = documents.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long")).alias("key"), node)
    rows = rows.join(kept, ["key", "node"], "left_semi")
    own = Window.partitionBy("key", "node").orderBy(F.lit(1))
    return rows.withColumn("n", F.row_number().over(own)).filter("n = 1").select("row.*")
