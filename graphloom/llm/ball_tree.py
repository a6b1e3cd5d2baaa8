"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

Vectors are dealt evenly into shards of a bounded size; a shard's tree is built once and stored. Queries
visit the shards of their dimension in waves that grow fourfold: every shard is busy in every wave with
some of the queries. After a wave the best answers of all shards are merged, and each query takes its
current k-th score along as a floor, so that later shards only look for better ones. In a tree a node's
best possible score for query q is q.centre + |q| * radius; children are visited in the order of that
bound, and a node is dropped for the queries whose k-th score is above it. Scores are exact integers.

A query travels once to each shard. There are as many shards as shuffle partitions, or as many as keep
each below SHARD_BYTES, so what is shuffled grows with the queries until memory asks for more shards.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.textarrays import bounded_batches
from graphloom.sources.shared_storage import drop_shared, write_shared

#: Most bytes of a shard's vectors, fewest rows of a shard, rows of a leaf.
SHARD_BYTES, SHARD_ROWS, LEAF_ROWS = 64 << 20, 256, 128
#: Scores below these are exact in double precision and in 64-bit integers.
EXACT, EXACT_LONG = 2.0**53, 2.0**62
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def products(queries: np.ndarray, vectors: np.ndarray, reach: float) -> np.ndarray:
    """All inner products as 64-bit integers; ``reach`` bounds their size. Those beyond 64 bits stop at the ends."""
    if reach < EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if reach < EXACT_LONG:
        return queries @ vectors.T
    return np.clip(queries.astype(object) @ vectors.astype(object).T, NONE + 1, MOST).astype(np.int64)


def build(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> dict:
    """A ball tree over the rows: nodes in depth-first order, with the rows reordered so that a node is a slice."""
    order = np.lexsort((rows, ids))
    nodes: list[list] = []  # first row, last row, right child (-1: leaf)

    def split(lo: int, hi: int) -> None:
        me = len(nodes)
        nodes.append([lo, hi, -1])
        if hi - lo <= LEAF_ROWS:
            return
        part = x[order[lo:hi]]
        a = part[((part - part[0]) ** 2).sum(1).argmax()]
        b = part[((part - a) ** 2).sum(1).argmax()]
        along = part @ (b - a)
        order[lo:hi] = order[lo:hi][np.argsort(along, kind="stable")]
        middle = (lo + hi) // 2
        split(lo, middle)
        nodes[me][2] = len(nodes)
        split(middle, hi)

    x = vectors.astype(np.float64)
    split(0, len(ids))
    x = x[order]
    nodes_ = np.array(nodes, dtype=np.int64)
    centres = np.stack([x[lo:hi].mean(axis=0) for lo, hi, _ in nodes])
    radii = np.array([np.sqrt(((x[lo:hi] - c) ** 2).sum(1).max()) for (lo, hi, _), c in zip(nodes, centres)])
    return {"rows": rows[order], "ids": ids[order], "vectors": vectors[order], "nodes": nodes_, "centres": centres, "radii": radii, "longest": float(np.sqrt((x**2).sum(1).max()))}


def search(tree: dict, own_rows: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) per query, descending; scores are NONE where a query has fewer than k.

    ``own_rows`` are the queries' own rows, which are no answers. ``floors`` are scores that k candidates
    elsewhere have reached (NONE: not yet); worse candidates need not be found.
    """
    n = len(queries)
    scores, ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)
    floor = floors.copy()
    q = queries.astype(np.float64)
    length = np.sqrt((q**2).sum(1))
    bound = q @ tree["centres"].T + length[:, None] * tree["radii"][None, :]
    bound += 1e-9 * np.abs(bound) + 1e-3 + 1e-9 * length[:, None] * np.sqrt((tree["centres"] ** 2).sum(1))[None, :]
    reach = length.max(initial=0) * tree["longest"]

    def visit(node: int, active: np.ndarray) -> None:
        active = active[bound[active, node] >= floor[active]]
        if not len(active):
            return
        lo, hi, right = tree["nodes"][node]
        if right >= 0:
            left = node + 1
            first = (left, right) if bound[active, left].sum() >= bound[active, right].sum() else (right, left)
            for child in first:
                visit(int(child), active)
            return
        found = products(queries[active], tree["vectors"][lo:hi], reach)
        ok = (found >= floor[active][:, None]) & (tree["rows"][lo:hi][None, :] != own_rows[active][:, None])
        better = ok.any(axis=1)
        active, found, ok = active[better], found[better], ok[better]
        if not len(active):
            return
        all_ids = np.concatenate([ids[active], np.broadcast_to(tree["ids"][lo:hi], found.shape)], axis=1)
        all_scores = np.concatenate([scores[active], np.where(ok, found, NONE)], axis=1)
        order = np.lexsort((all_ids, ~all_scores))[:, :k]  # ~ reverses the order of integers without overflow
        scores[active] = np.take_along_axis(all_scores, order, 1)
        ids[active] = np.take_along_axis(all_ids, order, 1)
        floor[active] = np.maximum(floor[active], scores[active, k - 1])

    visit(0, np.arange(n))
    return scores, ids


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _trees(table: pa.Table) -> pa.Table:
    tree = build(table.column("row").to_numpy(), table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks()))
    return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _searched(k: int):
    """Rows come by (dim, shard), a shard's tree before the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            is_tree = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(is_tree)
            for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [batch.num_rows]])):
                part = batch.slice(int(a), int(b - a))
                if part.num_rows and is_tree[a]:
                    tree = pickle.loads(part.column(2)[0].as_py())
                    part = part.slice(1)
                if part.num_rows:
                    rows, query_ids = part.column(3).to_numpy(), part.column(4).to_numpy()
                    scores, ids = search(tree, rows, _matrix(part.column(5)), k, part.column(6).fill_null(NONE).to_numpy())
                    row, col = np.nonzero(scores > NONE)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[row]), pa.array(query_ids[row]), pa.array(ids[row, col]), pa.array(scores[row, col])], ["row", "query_id", "vec_id", "score"])

    return run


def integer_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x); vectors that are null or hold null or non-finite parts are left out.

    Parts beyond 64-bit integers stop at their ends. Empty vectors and rows without vec_id are left out too.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(x) > 0)
    kept = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    most = F.lit(2.0**63)
    part = lambda c: F.when(c * scale >= most, F.lit(MOST)).when(c * scale < -most, F.lit(NONE + 1)).otherwise(F.floor(c * scale).cast("long"))
    return kept.select("vec_id", F.transform(x, part).alias("v"))


def top_k(vectors: DataFrame, asks: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows by integer inner product for each row that ``asks``.

    ``vectors`` holds (vec_id, v); only vectors of equal dimension meet. Ties go to the smaller vec_id. A
    query's own row is left out and no other, so rows that repeat a vec_id are candidates, and as queries
    each has an answer of its own. Queries with fewer candidates get all. Scores beyond 64 bits stop at
    their ends. Other columns are ignored; an empty table or no query gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select("vec_id", "v", F.coalesce(asks, F.lit(False)).alias("asks"), F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"))
    rows, rows_path = write_shared(rows, "vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_size = F.ceil(F.count("*") * F.col("dim") * 8 / SHARD_BYTES)
    by_rows = F.least(F.lit(parts), F.ceil(F.count("*") / SHARD_ROWS))
    sizes, sizes_path = write_shared(rows.groupBy("dim").agg(F.greatest(by_size, by_rows).cast("int").alias("shards")), "shard-counts")
    most = sizes.agg(F.max("shards")).first()[0] or 0
    dealt = rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    trees = dealt.groupBy("dim", "shard").applyInArrow(_trees, "dim int, shard int, tree binary")
    trees, trees_path = write_shared(trees, "ball-trees")
    queries = dealt.where("asks").select("dim", "shards", F.col("shard").alias("home"), "row", F.col("vec_id").alias("query_id"), "v")
    answer = "row long, query_id long, vec_id long, score long"
    best, best_path = spark.createDataFrame([], answer), None
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    lo, hi = 0, 1
    while lo < most:
        floors = best.groupBy("row").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).select("row", "floor")
        hop = F.explode(F.sequence(F.lit(lo), F.least(F.lit(hi), F.col("shards")) - 1)).alias("hop")
        going = queries.where(F.col("shards") > lo).join(floors, "row", "left").select("dim", "shards", "home", "row", "query_id", "v", "floor", hop)
        visits = going.select("dim", F.pmod(F.col("home") + F.col("hop"), F.col("shards")).alias("shard"), F.lit(None).cast("binary").alias("tree"), "row", "query_id", "v", "floor")
        waiting = trees.select("dim", "shard", "tree", *(F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("query_id", "long"), ("v", "array<long>"), ("floor", "long"))))
        met = waiting.unionAll(visits).repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("tree").isNull())
        found = met.mapInArrow(_searched(k), answer)
        ranked = best.unionAll(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best, path = write_shared(ranked.select("row", "query_id", "vec_id", "score"), "best")
        if best_path:
            drop_shared(spark, best_path)
        best_path = path
        lo, hi = hi, hi * 4
    drop_shared(spark, rows_path, sizes_path, trees_path)
    return best.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20)


QUERIES = {"op8_exact_top_k": op8_exact_top_k}
