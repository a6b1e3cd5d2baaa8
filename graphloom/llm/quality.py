"""Quality of whole documents by a byte-level convolutional network in numpy.

A document's bytes are covered by overlapping chunks of ``2 * STEP`` places, one every ``STEP`` places.
Learned filters of ``WIDTH`` bytes slide over each chunk and are max-pooled; the document's vector holds,
for each filter, the mean and the largest of its chunks' rectified maxima, and a logistic layer turns it
into one probability. The network sees nothing but the text.

It is fitted on a bounded sample of labelled rows, in the order of a hash of doc_id: ``TRAIN_DOCS`` at most,
and of these as many as have ``TRAIN_BYTES`` of text together. Training sees whole texts through the same
chunks as scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from graphloom.llm.textarrays import blocks, bounded_batches, text_bytes

STEP, WIDTH, FILTERS = 128, 4, 16
#: Bounds of the training sample: labelled rows, and bytes of their whole texts.
TRAIN_DOCS, TRAIN_BYTES = 5000, 32 << 20
#: Steps of training at least, however few the rows are; whole rounds over the sample are made.
UPDATES = 480
BATCH, RATE, SEED = 64, 0.01, 7
#: Positions handled at once while scoring.
TILE = 1 << 15
THRESHOLD = 0.7


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS, float32
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 x FILTERS: of the mean and of the largest
    offset: float

    def probability(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        # Row by row, so that a text's score does not depend on the texts beside it.
        return 1 / (1 + np.exp(-((mean * self.weights[0]).sum(axis=1) + (most * self.weights[1]).sum(axis=1) + self.offset)))


def _steps(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all steps of STEP bytes, and for each text the index of its first step (total last)."""
    n = -(-np.diff(offsets) // STEP)
    first = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(offsets[:-1] - first[:-1] * STEP, n) + np.arange(first[-1]) * STEP, first


def document_vectors(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and largest rectified maximum of each text's chunks, per filter; zeros for an empty text."""
    starts, first = _steps(offsets)
    low = np.float32(-1e9)
    best = np.full((len(starts), FILTERS), low, dtype=np.float32)
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    crossing = np.unique((offsets[1:, None] - np.arange(1, WIDTH)[None, :]).ravel())  # a filter would reach the next text
    crossing = crossing[crossing >= 0]
    # A text shorter than a filter keeps its only position, which then reaches into zeros or the next text's bytes: mask only longer ones.
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < WIDTH))
    for lo in range(0, len(data), TILE):
        hi = min(lo + TILE, len(data))
        score = net.filters[0][padded[lo:hi]]
        for w in range(1, WIDTH):
            score += net.filters[w][padded[lo + w : hi + w]]
        score[crossing[np.searchsorted(crossing, lo) : np.searchsorted(crossing, hi)] - lo] = low
        a, b = np.searchsorted(starts, [lo, hi])
        a -= bool(a == len(starts) or starts[a] > lo)
        best[a:b] = np.maximum(best[a:b], np.maximum.reduceat(score, np.maximum(starts[a:b] - lo, 0), axis=0))
    chunk = best.copy()
    if len(chunk) > 1:
        np.maximum(best[:-1], best[1:], out=chunk[:-1])
    last = first[1:][np.diff(first) > 0] - 1
    chunk[last] = best[last]
    hidden = np.maximum(chunk + net.bias, 0).astype(np.float64)
    n = np.diff(first)
    mean, most = np.zeros((len(n), FILTERS)), np.zeros((len(n), FILTERS))
    has = n > 0
    if has.any():
        at = first[:-1][has]
        mean[has] = np.add.reduceat(hidden, at, axis=0) / n[has][:, None]
        most[has] = np.maximum.reduceat(hidden, at, axis=0)
    mean[short] = most[short] = 0
    return mean, most


def _step_maxima(filters: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest value of each filter in each step of STEP bytes and where it is, and each text's first step."""
    starts, first = _steps(offsets)
    end = np.repeat(offsets[1:], np.diff(first))
    best, at = np.zeros((len(starts), FILTERS), np.float32), np.zeros((len(starts), FILTERS), np.int64)
    padded = np.concatenate([data, np.zeros(STEP + WIDTH, np.uint8)])
    for lo in range(0, len(starts), TILE // STEP):
        own = starts[lo : lo + TILE // STEP]
        place = own[:, None] + np.arange(STEP)
        value = filters[0][padded[place]]
        for w in range(1, WIDTH):
            value += filters[w][padded[place + w]]
        value[place > end[lo : lo + len(own), None] - WIDTH] = -1e9  # would reach behind the text
        top = value.argmax(axis=1)
        best[lo : lo + len(own)] = np.take_along_axis(value, top[:, None, :], 1)[:, 0]
        at[lo : lo + len(own)] = own[:, None] + top
    return best, at, first


def fit(texts: list[np.ndarray], labels: np.ndarray) -> Network:
    """Trains on whole texts (arrays of bytes), by Adam with a fixed seed."""
    rng = np.random.default_rng(SEED)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, (2, FILTERS)), 0.0)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("filters", net.filters), ("bias", net.bias), ("weights", net.weights), ("offset", np.zeros(())))}
    rounds = 0

    def update(name: str, gradient) -> None:
        m, v = state[name]
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient * gradient - v)
        change = RATE * (m / (1 - 0.9**rounds)) / (np.sqrt(v / (1 - 0.999**rounds)) + 1e-8)
        setattr(net, name, getattr(net, name) - change.astype(getattr(net, name).dtype if name != "offset" else np.float64))

    usable = np.array([i for i, t in enumerate(texts) if len(t)], dtype=np.int64)
    for _ in range(-(-UPDATES // -(-len(usable) // BATCH)) if len(usable) else 0):
        order = usable[rng.permutation(len(usable))]
        for lo in range(0, len(order), BATCH):
            picked = order[lo : lo + BATCH]
            data = np.concatenate([texts[i] for i in picked])
            best, at, first = _step_maxima(net.filters, data, np.concatenate([[0], np.cumsum([len(texts[i]) for i in picked])]))
            sizes, first, last = np.diff(first), first[:-1], first[1:] - 1
            follows = np.ones(len(best), bool)
            follows[last] = False
            after = np.flatnonzero(follows)  # a chunk is a step and the next one of its text
            later = best[after + 1] > best[after]
            top, where = best.copy(), at.copy()
            top[after] = np.where(later, best[after + 1], best[after])
            where[after] = np.where(later, at[after + 1], at[after])
            top += net.bias
            hidden = np.maximum(top, 0)
            mean = np.add.reduceat(hidden, first, axis=0) / sizes[:, None]
            most = np.maximum.reduceat(hidden, first, axis=0)
            error = (net.probability(mean, most) - labels[picked]) / len(picked)
            owner = np.repeat(np.arange(len(picked)), sizes)
            back = (error / sizes)[owner, None] * net.weights[0] + (hidden == most[owner]) * error[owner, None] * net.weights[1]
            back = np.where(top > 0, back, 0)
            gradient = np.zeros_like(net.filters)
            padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
            for w in range(WIDTH):
                np.add.at(gradient[w], (padded[where + w], np.broadcast_to(np.arange(FILTERS), where.shape)), back)
            rounds += 1
            update("filters", gradient)
            update("bias", back.sum(axis=0))
            update("weights", np.stack([error @ mean, error @ most]) + 1e-5 * net.weights)
            update("offset", error.sum())
    return net


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Network:
    """Fits the network to ``labels`` (doc_id, quality) of ``docs`` (doc_id, text); ``usable`` limits labels.

    Null labels are left out; a document with several labels counts with their rounded mean, one that is
    repeated with the same text once. The sample is the first rows by hash of the id, whatever their lengths:
    it ends with TRAIN_DOCS rows, or with the row that brings its texts to TRAIN_BYTES.
    Without labels, or where no labelled text has bytes, the network gives one half for every text.
    """
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if usable is None else rows.where(usable)
    picked = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    picked = picked.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(TRAIN_DOCS)
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")
    keyed = texts.select("h", F.xxhash64("text").alias("t"), "label", F.octet_length("text").alias("n"), "text")
    sizes = keyed.where("n > 0").groupBy("h", "t").agg(F.max("n").alias("n")).orderBy("h", "t").limit(TRAIN_DOCS).collect()  # TRAIN_DOCS rows
    chosen, left = [], TRAIN_BYTES
    for r in sizes:
        if left <= 0:
            break
        chosen.append((r["h"], r["t"]))
        left -= r["n"]
    keys = docs.sparkSession.createDataFrame(chosen, "h long, t long")
    sample = keyed.join(F.broadcast(keys), ["h", "t"]).dropDuplicates(["h", "t"]).select("h", "t", "label", "text").toArrow()  # TRAIN_BYTES and one text at most
    found = sorted(zip(*(sample.column(i).to_pylist() for i in range(4))))
    net = fit([np.frombuffer(x, np.uint8) for *_, x in found], np.array([y for _, _, y, _ in found], dtype=np.float64))
    if not found:
        net.weights[:] = 0
    return net


def score(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality of each whole text (null and empty texts too).

    Rows, other columns and repeated rows stay, equal texts have equal scores; an existing column of that
    name is replaced. An empty table gives an empty result. A very long text is held whole by one task,
    in some ten times its bytes at most.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])
            out = [shared.value.probability(*document_vectors(shared.value, *text_bytes(b.column(0)))) for b in blocks(batch)]
            yield pd.Series(np.concatenate([np.zeros(0), *out]), index=texts.index)

    return docs.withColumn(name, probability(F.col("text").cast("string")))


def in_fold(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of an id written as text leaves this remainder; a null id leaves none."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~in_fold("doc_id", 4, 2))
    scored = score(docs, net).withColumn("held_out", in_fold("doc_id", 4, 2))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
