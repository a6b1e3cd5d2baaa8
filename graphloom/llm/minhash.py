"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Each shingle is hashed once; the top bits choose a bin, the rest compete for the bin's minimum. An empty
bin borrows from the first non-empty bin on a probe sequence that depends on the bin alone (optimal
densification). Of each minimum the low ``bits`` bits are stored, and the share of equal values is
corrected for matches by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.textarrays import blocks, bounded_batches, mix, shingles
from graphloom.sources.shared_storage import write_shared

#: Words of a shingle, bins (a power of two) and stored bits per bin (1, 2, 4 or 8).
WORDS, BINS, BITS = 5, 512, 4
PROBES = 64


def _probes(bins: int, first: int) -> np.ndarray:
    """For each bin the next PROBES bins that it asks for a value."""
    x = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(first, first + PROBES, dtype=np.uint64)[None, :]
    return (mix(x) % np.uint64(bins)).astype(np.int64)


def minima(column: pa.Array, words: int = WORDS, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """The densified minimum of each text's bins (texts x bins), and which texts have any shingle."""
    values, bounds = shingles(column, words)
    n = len(bounds) - 1
    free = np.uint64(2**64 - 1)
    shift = np.uint64(64 - bins.bit_length() + 1)
    out = np.full(n * bins, free, dtype=np.uint64)
    slot = np.repeat(np.arange(n, dtype=np.int64) * bins, np.diff(bounds)) + (values >> shift).astype(np.int64)
    np.minimum.at(out, slot, values & ((np.uint64(1) << shift) - np.uint64(1)))
    out = out.reshape(n, bins)
    known = np.diff(bounds) > 0
    filled = out != free
    text, bin_ = np.nonzero(~filled & known[:, None])
    first = 0
    while len(text):  # each round finds a donor with probability 1 - (share of empty bins) ** PROBES
        donors = _probes(bins, first)[bin_]
        hit = filled[text[:, None], donors]
        found = hit.any(axis=1)
        chosen = donors[np.arange(len(text)), hit.argmax(axis=1)]
        out[text[found], bin_[found]] = out[text[found], chosen[found]]
        text, bin_ = text[~found], bin_[~found]
        first += PROBES
    return out, known


def packed(low: np.ndarray, bits: int) -> np.ndarray:
    """Rows of packed bytes from rows of values below 2 ** bits."""
    if bits == 8:
        return low
    each = 8 // bits
    shifts = np.arange(each, dtype=np.uint8) * bits
    return np.bitwise_or.reduce(low.reshape(len(low), -1, each) << shifts, axis=2).astype(np.uint8)


def fingerprints(column: pa.Array, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of each text's minima (texts x bins, uint8), and which texts have a fingerprint."""
    out, known = minima(column, words, bins)
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint8), known


def as_strings(low: np.ndarray, known: np.ndarray, bits: int = BITS) -> list[str]:
    """Lower-case hex of the packed bits; the empty string for a text without shingles."""
    rows = packed(low, bits)
    return [row.tobytes().hex() if ok else "" for row, ok in zip(rows, known)]


def likeness(a: np.ndarray, a_known: np.ndarray, b: np.ndarray, b_known: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Jaccard similarity by the share of equal values, corrected for chance; two texts without shingles: 1, one: 0."""
    chance = 2.0**-bits
    near = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1) if len(a) else np.zeros(0)
    return np.where(a_known & b_known, near, np.where(a_known == b_known, 1.0, 0.0))


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = WORDS, bins: int = BINS, bits: int = BITS, name: str = "fingerprint") -> DataFrame:
    """``docs`` with a column of hex fingerprints of whole texts; null and texts without words get ''.

    Rows stay as they are, repeated ones included; an existing column of that name is replaced.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def fingerprint(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string(), from_pandas=True)], ["text"])
        out = [s for b in blocks(batch) for s in as_strings(*fingerprints(b.column(0), words, bins, bits), bits)]
        return texts.__class__(out, index=texts.index, dtype=object)

    return docs.withColumn(name, fingerprint(F.col(text).cast("string")))


RESULT = "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: What a row of the first pass is: a result, the text that a range begins with, or that it ends with.
DONE, HEAD, TAIL = 0, 1, 2


def _edited(texts: list[str], words: int, bins: int, bits: int) -> list[pa.Array]:
    """Columns of the results of all texts but the last, each edited with the one behind it."""
    low, known = fingerprints(pa.array(texts, pa.large_string()), words, bins, bits)
    changed = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:])]
    low_e, known_e = fingerprints(pa.array(changed, pa.large_string()), words, bins, bits)
    a, ok = low[:-1], known[:-1]
    return [
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(as_strings(a, ok, bits), pa.string()),
        pa.array(as_strings(low_e, known_e, bits), pa.string()),
        pa.array(likeness(a, ok, low_e, known_e, bits)),
        pa.array(likeness(a, ok, low[1:], known[1:], bits)),
    ]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _edited_ranges(words: int, bins: int, bits: int):
    """Results of a range's rows in order; its last row, and a copy of its first, are left for ``_edited_ends``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None

        def end(kind: int, row: pa.RecordBatch) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([row.column(0), *(pa.nulls(1, k) for k in kinds), pa.array([kind], pa.int32()), pa.array([part], pa.int32()), row.column(1).cast(pa.string())], [*NAMES, "kind", "part", "text"])

        for batch in batches:
            for block in blocks(batch):
                if held is None:
                    yield end(HEAD, block.slice(0, 1))
                else:
                    block = pa.Table.from_batches([held, block]).combine_chunks().to_batches()[0]
                n = block.num_rows - 1
                if n:
                    done = _edited([t or "" for t in block.column(1).to_pylist()], words, bins, bits)
                    yield pa.RecordBatch.from_arrays([block.column(0).slice(0, n), *done, pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.string())], [*NAMES, "kind", "part", "text"])
                held = block.slice(n, 1)
        if held is not None:
            yield end(TAIL, held)

    return run


def _edited_ends(words: int, bins: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                done = _edited([batch.column(1)[i].as_py() or "", batch.column(2)[i].as_py() or ""], words, bins, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *done], NAMES)

    return run


def edit_fingerprints(docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, whose second half comes from the next document.

    The next document is that with the next smaller doc_id; after the last comes the first again. Null ids
    come last; equal ids are ordered by a hash of their texts, equal rows anyhow. Null texts count as empty;
    other columns are ignored; an empty table gives an empty result. Texts are shuffled once, by ranges of
    id, hash and row, so that an id with many rows spreads over tasks; the two texts at the border of two
    ranges meet afterwards. A very long text is held whole by one task, in some forty times its bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("t"), F.col("row")]
    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    result = RESULT.format(docs.schema["doc_id"].dataType.simpleString())
    found = ordered.mapInArrow(_edited_ranges(words, bins, bits), result + ", kind int, part int, text string")
    found, _ = write_shared(found, "edited", compression="zstd")
    used = [r["part"] for r in found.where(F.col("kind") == HEAD).select("part").orderBy("part").collect()]  # a row per range
    following = spark.createDataFrame(list(zip(used, used[1:] + used[:1])), "part int, next int")
    tails = found.where(F.col("kind") == TAIL).select("doc_id", "text", "part").join(F.broadcast(following), "part")
    heads = found.where(F.col("kind") == HEAD).select(F.col("text").alias("after"), F.col("part").alias("next"))
    ends = tails.join(heads, "next").select("doc_id", "text", "after").mapInArrow(_edited_ends(words, bins, bits), result)
    return found.where(F.col("kind") == DONE).select(*NAMES).unionAll(ends)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_document_fingerprints": op1_document_fingerprints}
