"""How the filters of a corpus interact: what each removes, alone, after others, and in every order.

One pass over the bytes of a text measures it. A small transducer reads them: tables give, for each state
(outside or inside a word) and class of byte, the next state and what to emit (a word begins, a code
point, a capital, a symbol). All of a block's bytes go through the tables at once; that is possible since
the next state depends on the byte alone, which is checked when the tables are made. Spans of words go
into a hash table whose every match is verified byte by byte, so distinct words are counted exactly.

A document's failed filters are a mask. Counts per part, mask and label are all that the orders need: the
600 steps of a part are sums over at most 32 masks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.textarrays import blocks, bounded_batches, mix, powers, text_bytes
from graphloom.sources.shared_storage import write_shared

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5  # words; percent of words; percent of code points
#: Most texts with copies for which the table of their first ids is broadcast (some hundred bytes each).
MAX_BROADCAST_COPIES = 1 << 18

# ---- the transducer

OUTSIDE, INSIDE = 0, 1
SPACE, PLAIN, CAPITAL, SYMBOL, CONTINUED = range(5)
CLASS = np.full(256, PLAIN, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[list(b"#$%&*|")] = SYMBOL
CLASS[0x80:0xC0] = CONTINUED  # further bytes of a code point
NEXT = np.array([[OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE]] * 2, np.uint8)
WORD, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8
EMIT = np.array(
    [
        [POINT, WORD | POINT, WORD | POINT | IS_CAPITAL, WORD | POINT | IS_SYMBOL, WORD],
        [POINT, POINT, POINT | IS_CAPITAL, POINT | IS_SYMBOL, 0],
    ],
    np.uint8,
)
assert (NEXT[OUTSIDE] == NEXT[INSIDE]).all(), "states of a block are looked up at once"
STATE_AFTER = NEXT[OUTSIDE][CLASS]
EMITTED = EMIT[:, CLASS].reshape(-1)  # by 256 * state + byte
#: Emitted flags as two counters in 32-bit halves: words and code points; capitals and symbols.
HALF = np.uint64(32)
_flags = np.arange(16, dtype=np.uint64)
COUNT_WORDS = (_flags & np.uint64(1)) | ((_flags >> np.uint64(1) & np.uint64(1)) << HALF)
COUNT_SIGNS = (_flags >> np.uint64(2) & np.uint64(1)) | ((_flags >> np.uint64(3) & np.uint64(1)) << HALF)
LOW = np.uint64(0xFFFFFFFF)


def transduce(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts of each text (words, points, capitals, symbols), and starts and ends of all words.

    A text is data[offsets[i]:offsets[i+1]], of less than 4 GB. Each begins outside a word.
    """
    n = len(data)
    after = STATE_AFTER[data]
    before = np.zeros(n, np.uint8)
    before[1:] = after[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = OUTSIDE
    emitted = EMITTED[before.astype(np.uint16) * np.uint16(256) + data]
    counts = {}
    for names, table in ((("words", "points"), COUNT_WORDS), (("capitals", "symbols"), COUNT_SIGNS)):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[emitted], out=total[1:])
        each = total[offsets[1:]] - total[offsets[:-1]]  # both halves wrap alike, so differences are exact
        counts[names[0]], counts[names[1]] = (each & LOW).astype(np.int64), (each >> HALF).astype(np.int64)
    starts = np.flatnonzero(emitted & WORD)
    leaves = np.zeros(n + 1, bool)  # a word ends before this byte
    leaves[:n] = (before == INSIDE) & (after == OUTSIDE)
    edges = offsets[1:][np.diff(offsets) > 0]
    leaves[edges] |= after[edges - 1] == INSIDE
    return counts, starts, np.flatnonzero(leaves)


# ---- the table of words


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial over its bytes from prefix sums, then mixed."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


#: Spans beyond so many bytes are compared as byte strings, shorter ones eight bytes at a time.
SHORT = 64


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans that begin at a and at b are equal over their common length."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    same = np.ones(len(a), bool)
    for i in np.flatnonzero(length > SHORT):
        same[i] = data[a[i] : a[i] + length[i]].tobytes() == data[b[i] : b[i] + length[i]].tobytes()
    todo, at = np.flatnonzero(length <= SHORT), 0
    while len(todo):
        left = np.minimum(length[todo] - at, 8)
        differ = windows[a[todo] + at] ^ windows[b[todo] + at]
        same[todo] &= ~(differ.astype(bool) & (np.arange(8) < left[:, None])).any(axis=1)
        at += 8
        todo = todo[same[todo] & (length[todo] > at)]
    return same


def first_of_each(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a word is the first of its owner with these bytes: insertion into one open hash table, all words at once.

    A word that finds a free slot takes it (the smallest of several); one that finds a word of the same
    owner, hash, length and bytes is a repeat; any other goes on to the next slot.
    """
    n = len(starts)
    slots = 1 << max(4, (2 * n).bit_length())
    holders = np.full(slots, -1, np.int64)
    h = _span_hashes(data, starts, ends)
    length = ends - starts
    at = (mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(slots - 1)).astype(np.int64)
    first, pending = np.ones(n, bool), np.arange(n)
    while len(pending):
        slot = at[pending]
        free = holders[slot] < 0
        claims = pending[free][::-1]
        holders[at[claims]] = claims  # of repeated slots the last assignment, so the smallest word, stays
        held = holders[slot]
        mine = held == pending
        alike = ~mine & (owner[held] == owner[pending]) & (h[held] == h[pending]) & (length[held] == length[pending])
        some = np.flatnonzero(alike)
        alike[some] = same_bytes(data, starts[held[some]], starts[pending[some]], length[pending[some]])
        first[pending[alike]] = False
        pending = pending[~(mine | alike)]
        at[pending] = (at[pending] + 1) & (slots - 1)
    return first


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """words, points, capitals, symbols and distinct words of each text; null counts as empty."""
    data, offsets = text_bytes(column)
    counts, starts, ends = transduce(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), counts["words"])
    first = first_of_each(data, starts, ends, owner)
    return counts | {"distinct": np.bincount(owner[first], minlength=len(offsets) - 1)}


# ---- filters of a table


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            m = measure(block.column(2))
            mask = (m["words"] < MIN_WORDS) | (100 * m["distinct"] < MIN_DISTINCT * m["words"]) << 1
            mask = mask | (100 * m["capitals"] > MAX_CAPITALS * m["points"]) << 2 | (m["symbols"] > 0) << 3
            data, offsets = text_bytes(block.column(2))
            view = memoryview(np.ascontiguousarray(data))
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(mask.astype(np.int32)), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs`` (doc_id, text, source): bit i of mask is set where filter i of ABCDE fails.

    A text fails E if a smaller doc_id anywhere in the table has the identical text, by SHA-256. A null
    doc_id is neither smaller nor larger than any; equal ids are not smaller. Null texts are empty, and an
    empty text fails A, and E like any other; null and empty sources are one part. Other columns are
    ignored; an empty table gives an empty result. A text is held whole by one task, in some sixty times
    its bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows, _ = write_shared(rows.mapInArrow(_measured, f"doc_id {kind}, part string, mask int, digest binary"), "filter-masks")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id")
    copies, _ = write_shared(copies, "filter-copies")
    few = copies.count() <= MAX_BROADCAST_COPIES
    met = rows.join(F.broadcast(copies) if few else copies, "digest", "left")
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return met.select("doc_id", "part", F.when(later, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask"))


def masks(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, documents, good, toxic): documents by failed filters, and those labelled quality 1 and toxic 1.

    ``labels`` has (doc_id, quality, toxic); of repeated labels of a document the largest counts.
    """
    lost = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    zero = F.lit(0).cast("long")
    counts = failed.groupBy("part", "mask").agg(F.count("*").alias("documents")).select("part", "mask", "documents", zero.alias("good"), zero.alias("toxic"))
    labelled = failed.join(lost.where("q = 1 OR t = 1"), "doc_id").groupBy("part", "mask").agg(F.sum("q").alias("good"), F.sum("t").alias("toxic"))
    both = counts.unionAll(labelled.select("part", "mask", zero.alias("documents"), "good", "toxic"))
    return both.groupBy("part", "mask").agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("documents", "good", "toxic")))


ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step, FILTERS.index(order[step - 1]), sum(1 << FILTERS.index(f) for f in order[: step - 1])) for order in ORDERS for step in range(1, 6)]
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows for each part, from its counts per mask."""
    mask = np.arange(32)[:, None]
    own = 1 << np.array([s[2] for s in STEPS])[None, :]
    earlier = np.array([s[3] for s in STEPS])[None, :]
    fails, gone = (mask & own) > 0, (mask & earlier) > 0
    removed = (fails & ~gone).astype(np.int64)
    of_filter = np.array([[s[2] == f for f in range(5)] for s in STEPS]).astype(np.int64)
    for batch in batches:
        for part, held in zip(batch.column(0), batch.column(1).to_pylist()):
            by = np.zeros((3, 32), np.int64)
            for h in held:
                by[:, h["mask"]] = h["documents"], h["good"], h["toxic"]
            n, good, toxic = by
            cut = n @ removed
            all_orders = (cut @ of_filter)[[s[2] for s in STEPS]]
            columns = [n @ (~fails & ~gone).astype(np.int64), cut, n @ (fails & gone).astype(np.int64), n @ (mask == own).astype(np.int64), good @ removed, toxic @ removed, all_orders]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * len(STEPS), pa.string()), pa.array([s[0] for s in STEPS]), pa.array([s[1] for s in STEPS], pa.int32()), *(pa.array(c) for c in columns)],
                ["part", "filter_order", "step", *MEASURES],
            )


def audit(counts: DataFrame) -> DataFrame:
    """A row per part, order of the five filters and step: what is kept, removed and lost there.

    ``counts`` is as ``masks`` gives it, at most 32 rows a part; no part, no rows.
    """
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "documents", "good", "toxic")).alias("held"))
    return held.mapInArrow(_steps, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = failures(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return audit(masks(write_shared(failed, "filter-failures")[0], spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op13_filter_audit": op13_filter_audit}

ORACLE_SQL = {
    "op13_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
m AS (SELECT doc_id, part,
    (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(q), 0) AS good, coalesce(sum(x), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, i AS step, bits[i] AS own, coalesce(list_sum(bits[:i - 1]), 0)::BIGINT AS earlier FROM o, range(1, 6) r(i)),
r AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
}
