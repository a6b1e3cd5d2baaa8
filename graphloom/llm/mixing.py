"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a key from a hash of its id; a source's documents in key order are its random order.
Ranges of keys are cut by leading bits, so that a source of any size spreads over many tasks: sizes are
summed per range, the ranges' sums give each range's start, and a running sum inside each range gives
each document's. A source's budget in words is cut exactly at that running sum; a budget above the
source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.textarrays import free_name
from graphloom.operators.statistics import ranked
from graphloom.sources.shared_storage import write_shared

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Rows aimed at in a range of a source's keys.
RANGE_ROWS = 512
#: Most sources for which the table of sources is broadcast.
MAX_BROADCAST_SOURCES = 1 << 18


def _key(column: str = "doc_id", seed: str = "mix"):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null"))).cast("binary"))


def word_count(text):
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """A row per source of ``sized`` (source, size): its number in code-point order (null last), size and target.

    All targets add up to ``share`` of all sizes; a target stops at ``cap`` times its source's size and
    the others share the excess by weight: targets are weight * level, for the one level that fits. The
    level rises round by round: what the sources below it cannot take is shared by those above, until no
    further source falls below. Sources are numbered by ranges, so there may be any number of them.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    number = F.col("rank") - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (number % len(weights) + 1).cast("int"))
    s = ranked(sources, F.col("source").asc_nulls_last()).withColumn("source_no", number.cast("int")).withColumn("weight", weight)
    s = s.withColumn("limit", F.col("source_size") * cap).withColumn("ratio", F.col("limit").cast("double") / F.col("weight")).drop("rank")
    s, _ = write_shared(s, "source-sizes")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while True:
        full = F.col("ratio") < F.lit(level)
        r = s.agg(F.sum(F.when(full, F.col("limit"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("left"), F.count(F.when(full, 1)).alias("n")).first()
        if r["n"] == before or not r["left"]:
            break
        before, level = r["n"], (share * total - (r["taken"] or 0)) / r["left"]
    target = F.least(F.col("weight") * F.lit(level), F.col("limit").cast("double"))
    return s.select("source", "source_no", "source_size", "rows", target.alias("target"))


def _sources(sized: DataFrame) -> DataFrame:
    table, _ = write_shared(source_targets(sized), "sources")
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_SOURCES else table


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, mix_key) for every row of ``docs`` (doc_id, text, source).

    size counts words of the whole text (null: 0); taken counts the words that the mix takes, up to
    twice the size. A source's taken words add up to the whole part of its target. Null ids share one
    key, equal ids too; within a key rows are ordered by size. Other columns are ignored; an empty table
    gives an empty result. Texts are only counted, so a very long one costs no more than reading it.
    """
    sized, _ = write_shared(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    bits = F.least(F.lit(30), F.ceil(F.log2(F.greatest(F.col("rows") / RANGE_ROWS, F.lit(1.0))))).cast("int")
    sources = _sources(sized).withColumn("bits", bits).drop("rows")
    keyed = sized.withColumn("mix_key", _key()).alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    keyed = keyed.select("doc_id", "d.source", "size", "mix_key", "source_no", "source_size", "target", F.expr("shiftrightunsigned(cast(conv(substring(mix_key, 1, 8), 16, 10) as long), 32 - bits)").alias("range"))
    spread = keyed.groupBy("source_no", "range").agg(F.sum("size").alias("range_size"))
    start = F.sum("range_size").over(Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = spread.select("source_no", "range", F.coalesce(start, F.lit(0)).alias("start"))
    inside = F.sum("size").over(Window.partitionBy("source_no", "range").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["source_no", "range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("inside")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), "mix_key")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with each document as often as the mix takes part of it: once per epoch, not at all if never.

    The document that a source's budget ends in stays whole. Since a source is taken in key order, its
    last key taken tells which rows belong to the last epoch, so texts are not shuffled. All columns stay,
    whatever their names; rows without words stay as often as rows beside them in key order; nulls,
    repeats and empty tables are as in ``mix``.
    """
    taken = mix(docs)
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    cuts = taken.groupBy("source").agg(F.first(whole).alias("epochs"), F.max(F.when(F.col("taken") > whole * F.col("size"), F.col("mix_key"))).alias("last_key"))
    cuts, _ = write_shared(cuts, "cuts")
    few = cuts.count() <= MAX_BROADCAST_SOURCES
    name = {c: free_name(c, docs.columns) for c in ("mix_source", "epochs", "last_key", "times")}
    cuts = cuts.select(F.col("source").alias(name["mix_source"]), F.col("epochs").alias(name["epochs"]), F.col("last_key").alias(name["last_key"]))
    met = docs.join(F.broadcast(cuts) if few else cuts, F.col("source").cast("string").eqNullSafe(F.col(name["mix_source"])))
    times = F.col(name["epochs"]) + F.coalesce((_key() <= F.col(name["last_key"])).cast("int"), F.lit(0))
    each = F.explode(F.sequence(F.lit(1), times.cast("int"))).alias(name["times"])
    return met.where(times > 0).select(*(F.col(f"`{c}`") for c in docs.columns), each).drop(name["times"])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mix_sources": op4_mix_sources}

ORACLE_SQL = {
    "op4_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM per_source),
weighed AS (SELECT *, [5, 2, 1][(no % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM numbered),
levels AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM weighed),
chosen AS (SELECT lvl FROM levels WHERE ratio >= lvl ORDER BY ratio, no LIMIT 1),
targets AS (SELECT source, source_size, least(weight * (SELECT lvl FROM chosen), cap::DOUBLE) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
budgeted AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM budgeted
"""
}
