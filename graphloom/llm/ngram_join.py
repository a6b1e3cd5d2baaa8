"""Exact Jaccard self-join over word n-grams: links between classes of equal sets, or components of linked documents.

A document's set holds its distinct ``k``-word shingles (64-bit hashes). Two documents link when
``den * |A & B| >= num * |A | B|``. The plan, in terms of Spark jobs:

1. *Order.* One pass counts all shingles (blocks of packed keys are shuffled and merged); those above a
   frequency that is chosen so that at most ``MAX_FREQUENT`` of them exist become a broadcast order:
   rare shingles first, frequent ones by class of frequency. Any order gives the same links.
2. *Index.* A second pass keeps each set's size, its 128-bit digest and its prefix in that order. Equal
   digests are one class, which gets a number. Prefix entries are shuffled by shingle into index lists
   with the entry's position; entries without a partner are dropped.
3. *Representatives' answers.* Each list's entry with the earliest position acts as representative; the
   others are verified against it by their whole sets, which also gives what each lacks and adds.
4. *Block skipping.* Lists are cut into blocks, and pairs of blocks are dealt as keys, so a long list
   spreads over tasks. A pair of blocks (and within them of smaller ones, ordered by set size) is skipped
   when the positions left after its best entries cannot reach the needed overlap.
5. *Derived answers.* The overlap of two sets that are similar to one representative R follows from its
   answers: ``|A & B| = |R| - |(R-A) | (R-B)| + |(A-R) & (B-R)|``; only the differences are looked at.
   Other pairs are verified by their whole sets.

For components (``jaccard_components``) step 5 is shorter still: sets that share a representative, or are
joined over several, share its component already, so a set takes over the component of its answers, lists
of one component are dropped before they are shuffled, and pairs within a component are never formed.

Two shingles are taken for equal when their 64-bit hashes are. Lists and components are never held whole
by a task; no list, link or component is collected to the driver. A very long text is hashed whole by one
task, in arrays of some twenty times its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.textarrays import blocks, bounded_batches, distinct_sorted, free_name, ragged, shingles, trimmed
from graphloom.operators.components import connected_components
from graphloom.sources.shared_storage import drop_shared, write_shared

#: Most shingles whose frequency is broadcast (16 bytes each); the frequency they start at follows from it.
MAX_FREQUENT = 1 << 19
#: Lowest frequency at which a shingle is moved behind rarer ones.
MIN_FREQUENT = 8
#: Most document ids that are broadcast to find the texts of candidate pairs.
MAX_BROADCAST_IDS = 1 << 20
FLUSH = 1 << 19
#: Entries of a block of an index list that is a key of its own, and of the smaller blocks in it.
KEY_BLOCK, LIST_BLOCK = 4096, 64


def _partitions(spark: SparkSession) -> int:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(4, (n - 1).bit_length())


def _unique_counts(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)
    return keys[first], total.astype(np.int64)


def _packed_counts(k: int, parts: int):
    bits = parts.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = _unique_counts(np.concatenate(held))
            held.clear()
            part = (keys >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(part, np.arange(parts + 1))
            low, many = keys.astype(np.uint32), counts.astype(np.uint32)
            used = [p for p in range(parts) if cut[p] < cut[p + 1]]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([low[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary()), pa.array([many[cut[p] : cut[p + 1]].tobytes() for p in used], pa.binary())], ["part", "keys", "counts"])

        size = 0
        for batch in batches:
            for block in blocks(batch):
                values, _ = distinct_sorted(*shingles(block.column(0), k))
                held.append(values >> np.uint64(32 - bits))
                size += len(values)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def _merged_counts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        more_k, more_c, size = [], [], 0

        def merged():
            return _unique_counts(np.concatenate([keys, *more_k]), np.concatenate([counts, *more_c]))

        for batch in batches:
            for p, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                more_k.append(np.frombuffer(k, np.uint32).astype(np.uint64) | (np.uint64(p) << np.uint64(32)))
                more_c.append(np.frombuffer(c, np.uint32).astype(np.int64))
                size += len(more_k[-1])
            if size > max(4 * FLUSH, len(keys)):
                keys, counts = merged()
                more_k, more_c, size = [], [], 0
        keys, counts = merged()
        keep = counts >= least
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].astype(np.int64)), pa.array(counts[keep])], ["key", "df"])

    return run


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys ascending, class of frequency, bits of a key): at most MAX_FREQUENT keys, counted over all texts."""
    spark = docs.sparkSession
    parts = _partitions(spark)
    packed = docs.select("text").mapInArrow(trimmed(_packed_counts(k, parts)), "part int, keys binary, counts binary")
    counted, path = write_shared(packed.repartitionById(parts, "part").mapInArrow(trimmed(_merged_counts(MIN_FREQUENT)), "key long, df long"), "shingle-df")
    level = F.floor(F.log2("df")).cast("int")
    start, total = 63, 0
    for row in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 63 levels at most
        total += row["count"]
        if total > MAX_FREQUENT:
            break
        start = row["level"]
    rows = counted.where(level >= start).select("key", level.alias("level")).toArrow()
    drop_shared(spark, path)
    keys, levels = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.uint64), levels[order].astype(np.uint8), 32 + parts.bit_length() - 1


def _signatures(k: int, num: int, den: int, frequent):
    """Size, digest and prefix of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels, bits = frequent.value
        for batch in batches:
            for block in blocks(batch):
                values, bounds = distinct_sorted(*shingles(block.column(1), k))
                short = values >> np.uint64(64 - bits)
                at = np.searchsorted(keys, short)
                at[at == len(keys)] = 0
                level = np.where(keys[at] == short, levels[at], 0) if len(keys) else np.zeros(len(values), np.uint8)
                sizes = np.diff(bounds)
                lengths = np.where(sizes > 0, sizes - -(-num * sizes // den) + 1, 0)
                out, digest = [], []
                for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
                    own = values[lo:hi]
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    if level[lo:hi].any():
                        own = own[np.argsort(level[lo:hi], kind="stable")]
                    out.append(own[: lengths[i]])
                prefix = ragged(np.concatenate([np.zeros(0, np.uint64), *out]).view(np.int64), np.concatenate([[0], np.cumsum(lengths)]))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sizes), pa.array(digest, pa.binary()), prefix], ["doc_id", "n", "digest", "prefix"])

    return run


def _needed(n_a, n_b, num: int, den: int):
    """Least overlap of two sets of these sizes that links them."""
    return -(-num * (n_a + n_b) // (num + den))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of index lists that hold two sets or more; entries come by token, one is held back."""
    last, shared = None, False  # the entry held back, and whether the one before it had its token
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        token = table.column(0).to_numpy()
        same = token[1:] == token[:-1]
        keep = np.concatenate([[shared], same]) | np.concatenate([same, [False]])
        last, shared = table.slice(len(token) - 1), bool(same[-1]) if len(same) else shared
        yield table.slice(0, len(token) - 1).filter(pa.array(keep[:-1]))
    if last is not None and shared:
        yield last


def _pairs_of(num: int, den: int, node, comp, n, rem, block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one list in different components whose sizes and positions allow a link.

    ``block`` tells the two blocks of a key apart; pairs within a block belong to that block's own key.
    """
    order = np.lexsort((node, n))
    node, comp, n, rem, block = node[order], comp[order], n[order], rem[order], block[order]
    both = block.min() != block.max()
    starts = np.arange(0, len(n), LIST_BLOCK)
    low, best = n[starts], np.maximum.reduceat(rem, starts)
    high = n[np.minimum(starts + LIST_BLOCK, len(n)) - 1]
    one = np.minimum.reduceat(comp, starts)
    alone = one == np.maximum.reduceat(comp, starts)  # blocks of one component
    for i in range(len(starts)):
        j = np.arange(i + 1)
        need = _needed(low[i], low[j], num, den)
        j = j[(den * high[j] >= num * low[i]) & (best[j] >= need) & (best[i] >= need) & ~(alone[j] & alone[i] & (one[j] == one[i]))]
        mine = slice(starts[i], starts[i] + LIST_BLOCK)
        for at in starts[j]:
            other = slice(at, at + LIST_BLOCK)
            need = _needed(n[mine][:, None], n[other][None, :], num, den)
            ok = (comp[mine][:, None] != comp[other][None, :]) & (np.minimum(rem[mine][:, None], rem[other][None, :]) >= need)
            if both:
                ok &= block[mine][:, None] != block[other][None, :]
            if at == starts[i]:
                ok &= np.tri(*ok.shape, -1, dtype=bool)
            a, b = np.nonzero(ok)
            if len(a):
                a, b = node[mine][a], node[other][b]
                yield np.minimum(a, b), np.maximum(a, b)


def _cross_pairs(num: int, den: int):
    """Candidate pairs of all keys (token, i, j); rows come by key, and only the last key of a batch is held back."""
    columns = ("token", "i", "j", "node", "comp", "n", "pos", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        held, size = [], 0  # pairs now

        def flush():
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*held)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        def keys(parts: list[np.ndarray], closed: bool):
            token, i, j, node, comp, n, pos, block = parts
            cut = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            cut = np.append(cut, len(token))
            for a, b in zip(cut[:-1], cut[1:] if closed else cut[1:-1]):
                own = comp[a:b]
                if own.min() != own.max():
                    yield from _pairs_of(num, den, node[a:b], own, n[a:b], (n - pos)[a:b], block[a:b])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns]
            if rest is not None:
                now = [np.concatenate([x, y]) for x, y in zip(rest, now)]
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            for a, b in keys(now, False):
                held.append((a, b))
                size += len(a)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
            rest = [x[last] for x in now]
        if rest is not None:
            for a, b in keys(rest, True):
                held.append((a, b))
                size += len(a)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _candidates(lists: DataFrame, placed: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """(a, b) of nodes in different components (``placed``: node, comp) that a list's sizes and positions allow to link."""
    entries = lists.join(placed, "node")
    mixed = entries.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("entries")).where("least <> most")
    several = F.ceil(F.col("entries") / KEY_BLOCK).cast("int")
    entries = entries.join(mixed.select("token", several.alias("blocks")), "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "comp", F.col("n").cast("long"), F.col("pos").cast("long"), "block")
    dealt = dealt.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(trimmed(_cross_pairs(num, den)), "a long, b long").distinct()


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                values, bounds = distinct_sorted(*shingles(block.column(0), k))
                digest = [hashlib.blake2b(values[lo:hi].tobytes(), digest_size=16).digest() for lo, hi in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), ragged(values.view(np.int64), bounds)], ["digest", "shingles"])

    return run


def _linked(num: int, den: int, differences: bool):
    """Of pairs with both sets those that link; with ``differences`` also what b lacks of a and adds to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, lacks, adds, overlap = [], [], [], []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * both >= num * (len(x) + len(y) - both))
                if keep[-1]:
                    overlap.append(both)
                    if differences:
                        lacks.append(np.setdiff1d(x, y, assume_unique=True))
                        adds.append(np.setdiff1d(y, x, assume_unique=True))
            out = batch.filter(pa.array(keep, pa.bool_()))
            columns, names = [out.column(0), out.column(1), pa.array(overlap, pa.int64())], ["a", "b", "overlap"]
            if differences:
                columns += [pa.array(lacks, pa.list_(pa.int64())), pa.array(adds, pa.list_(pa.int64()))]
                names += ["lacks", "adds"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _derived(num: int, den: int):
    """Links among pairs of sets whose differences from one representative are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            keep, overlap = [], []
            for i in range(batch.num_rows):
                lacks_a, adds_a, lacks_b, adds_b = (columns[c][i].values.to_numpy() for c in ("lacks_a", "adds_a", "lacks_b", "adds_b"))
                n = columns["n"][i].as_py()
                both = n - len(np.union1d(lacks_a, lacks_b)) + len(np.intersect1d(adds_a, adds_b, assume_unique=True))
                total = 2 * n - len(lacks_a) + len(adds_a) - len(lacks_b) + len(adds_b)
                keep.append(den * both >= num * (total - both))
                overlap.append(both)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([columns["a"].filter(mask), columns["b"].filter(mask), pa.array(overlap, pa.int64()).filter(mask)], ["a", "b", "overlap"])

    return run


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, num: int, den: int, differences: bool = False) -> tuple[DataFrame, str]:
    """Of candidate pairs those that link (a, b, overlap ...), by intersecting the whole sets of both."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    ids, ids_path = write_shared(wanted.join(nodes.select("node", "digest", "first_id"), "node"), "candidate-ids")
    own = ids.select(F.col("first_id").alias("id"))
    few = ids.count() <= MAX_BROADCAST_IDS
    texts = docs.join(F.broadcast(own) if few else own, docs["doc_id"].eqNullSafe(own["id"]), "left_semi").select("text")
    sets = texts.mapInArrow(trimmed(_sets(k)), "digest binary, shingles array<long>").dropDuplicates(["digest"])
    sets, path = write_shared(sets.join(ids.select("digest", "node"), "digest").select("node", "shingles"), "candidate-sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    schema = "a long, b long, overlap long" + (", lacks array<long>, adds array<long>" if differences else "")
    links, links_path = write_shared(both.select("a", "b", "left", "right").mapInArrow(trimmed(_linked(num, den, differences)), schema), "links")
    drop_shared(spark, ids_path, path)
    return links, links_path


@dataclass
class Index:
    """What both outputs share: signatures of all rows, classes with numbers, lists and representatives' candidates."""

    docs: DataFrame
    signed: DataFrame  # doc_id, n, digest of every row
    nodes: DataFrame  # node, digest, first_id, n of every class
    lists: DataFrame  # token, node, n, pos
    star: DataFrame  # a: representative, b: another set of its list
    paths: list[str]


def _index(docs: DataFrame, k: int, num: int, den: int) -> Index:
    if not 0 < num <= den:
        raise ValueError("similarity must lie in (0, 1]")
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = _partitions(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, k))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed, _ = write_shared(docs.mapInArrow(trimmed(_signatures(k, num, den, frequent)), f"doc_id {id_type}, n long, digest binary, prefix array<long>"), "signatures")
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes, nodes_path = write_shared(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token")).select("token", "node", "n", F.col("pos").cast("int").alias("pos"))
    entries = entries.repartition(parts, "token").sortWithinPartitions("token")
    lists, lists_path = write_shared(entries.mapInArrow(trimmed(_lists), "token long, node long, n int, pos int"), "lists")
    heads = lists.groupBy("token").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("x"), "n", "node", "pos")).alias("h"))
    need = F.ceil((F.col("n") + F.col("h.n")) * F.lit(num) / F.lit(num + den))
    star = lists.join(heads, "token").where((F.col("node") != F.col("h.node")) & (F.least(F.col("n") - F.col("pos"), F.col("h.n") - F.col("h.pos")) >= need))
    star, star_path = write_shared(star.select(F.col("h.node").alias("a"), F.col("node").alias("b")).distinct(), "star")
    return Index(docs, signed.select("doc_id", "n", "digest"), nodes.drop("prefix"), lists, star, [nodes_path, lists_path, star_path])


def jaccard_links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and which class each row belongs to.

    Returns (a, b, overlap) with a < b, one row per pair of classes that link, and (doc_id, n_shingles,
    class) for every row of ``docs`` (doc_id, text; other columns are ignored); rows without shingles have
    a null class. Rows of one class have equal sets; copies are not expanded into pairs. As many links as
    there are come out, so a large group of different near copies has many. Null and empty texts, or texts
    without words, link with nothing; null and repeated ids are rows like others; an empty table gives two
    empty results.
    """
    x = _index(docs, k, num, den)
    spark = docs.sparkSession
    near, near_path = _verify(x.docs, x.nodes, x.star, k, num, den, differences=True)
    # Of each set the representative it is most similar to, with the differences; a representative has none from itself.
    best = near.groupBy(F.col("b").alias("node")).agg(F.max(F.struct("overlap", F.col("a").alias("head"), "lacks", "adds")).alias("v")).select("node", "v.head", "v.lacks", "v.adds")
    empty = F.array().cast("array<long>")
    alone = near.select(F.col("a").alias("node")).distinct().join(best.select("node"), "node", "left_anti")
    known, known_path = write_shared(best.unionAll(alone.select("node", F.col("node").alias("head"), empty, empty)), "representatives")
    every = x.nodes.select("node", F.col("node").alias("comp"))
    pairs = _candidates(x.lists, every, num, den, _partitions(spark))
    done = x.star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs, pairs_path = write_shared(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    side = lambda c: known.select(F.col("node").alias(c), F.col("head").alias(f"head_{c}"), F.col("lacks").alias(f"lacks_{c}"), F.col("adds").alias(f"adds_{c}"))
    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    same = F.coalesce(F.col("head_a") == F.col("head_b"), F.lit(False))
    sized = met.where(same).join(x.nodes.select(F.col("node").alias("head_a"), "n"), "head_a")
    derived, derived_path = write_shared(sized.select("a", "b", "n", "lacks_a", "adds_a", "lacks_b", "adds_b").mapInArrow(trimmed(_derived(num, den)), "a long, b long, overlap long"), "derived")
    whole, whole_path = _verify(x.docs, x.nodes, met.where(~same).select("a", "b"), k, num, den)
    first = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap").distinct()
    links, _ = write_shared(first.unionAll(derived).unionAll(whole), "all-links")
    members, _ = write_shared(x.signed.join(x.nodes.select("digest", F.col("node").alias("class")), "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class")), "members")
    drop_shared(spark, *x.paths, near_path, known_path, pairs_path, derived_path, whole_path)
    return links, members


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links. Null and empty texts, or texts without
    words, have no shingles and link with nothing; a row with a null doc_id takes part and gets the
    smallest known doc_id of its component, or null. Repeated rows stay repeated. An empty table gives
    an empty result. doc_id may be of any type with an order.
    """
    x = _index(docs, k, num, den)
    spark = docs.sparkSession
    links, links_path = _verify(x.docs, x.nodes, x.star, k, num, den)
    first = connected_components(links)
    placed, placed_path = write_shared(x.nodes.select("node").join(first, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "placed")
    pairs, pairs_path = write_shared(_candidates(x.lists, placed, num, den, _partitions(spark)), "pairs")
    more, more_path = _verify(x.docs, x.nodes, pairs, k, num, den)

    component = connected_components(links.unionAll(more))
    placed = x.nodes.select("node", "digest", "first_id").join(component, "node", "left").select("digest", "first_id", F.coalesce("component", "node").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    final, _ = write_shared(placed.join(least, "comp").select("digest", "component_id"), "class-components")
    drop_shared(spark, *x.paths, links_path, placed_path, pairs_path, more_path)
    out = x.signed.withColumnRenamed("n", "n_shingles").join(final, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of ``docs`` with one row of each component left.

    Rows get a written number, and components are those of rows: the row with the smallest doc_id stays
    (null behind all others), and of rows that share it the one with the smallest number. Null and empty
    texts link with nothing and stay, whatever their doc_id; rows that repeat a doc_id with texts that do
    not link all stay.
    """
    row, gone_row = free_name("row", docs.columns), free_name("gone_row", docs.columns)
    rows, _ = write_shared(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows", compression="zstd")
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = jaccard_components(rows.select(key.alias("doc_id"), "text"), k, num, den)
    gone, _ = write_shared(found.where("component_id.row <> doc_id.row").select(F.col("doc_id.row").alias(gone_row)), "gone")
    few = gone.count() <= MAX_BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, rows[row] == gone[gone_row], "left_anti").drop(row)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
