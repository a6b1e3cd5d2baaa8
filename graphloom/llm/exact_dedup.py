"""Exact deduplication with DataFrame functions only: copies are combined by digest, in salted groups first.

Texts are equal when they are identical after all whitespace is deleted. Rows are first counted by the
digest of that content, small columns only. Contents whose digest occurs once have no copies and are not
moved. The others are combined in three steps, and each groups by the digest *and* the full content: the
copies within a task (the partial aggregate before the shuffle), the groups of one digest and one salt,
where a task's salt is its number, and the winners of all salts. After the first step a task sends one row
for each content, and after the second at most ``SALTS`` rows of a digest are left to meet in one task, so
a group may hold any part of all rows.

Two contents that share a digest stay two groups: their members are told apart by the content itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.shared_storage import write_shared

#: Groups that the copies of one content are spread over before they meet.
SALTS = 32
#: Most digests for which a table with one row per digest is broadcast (some hundred bytes each).
MAX_BROADCAST_DIGESTS = 1 << 18


def content(text: Column) -> Column:
    """A text without its whitespace; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_DIGESTS else table


def combined(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, content, size, best) of rows (digest, content, n_chars, doc_id): local, salted and global winners.

    best is (-n_chars, whether doc_id is null, doc_id): the smallest stays, so the longest original text,
    then the smallest doc_id, nulls last. Every step compares digest and full content.
    """
    place = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    dealt = rows.select("digest", "content", place.alias("best"), (F.spark_partition_id() % salts).alias("salt"))
    salted = dealt.groupBy("digest", "content", "salt").agg(F.count("*").alias("size"), F.min("best").alias("best"))
    return salted.repartition("digest").groupBy("digest", "content").agg(F.sum("size").alias("size"), F.min("best").alias("best"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text), dropped ones too.

    keep_id is the doc_id of the row that stays: of equal texts the one with the most code points in the
    original text, then the smallest doc_id (nulls last); exactly one row of a group is kept, also where
    rows repeat a doc_id or have none. Null and empty texts, and those of whitespace only, are equal.
    text_sha256 is of the text without whitespace, in UTF-8. ``digest`` only deals contents out: results
    do not depend on it, even where contents share one. Other columns are ignored; an empty table gives
    an empty result. A very long text is held by one task at a time, in a few times its bytes.
    """
    texts = docs.select("doc_id", content(F.col("text")).alias("content"), F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_chars"))
    texts = texts.withColumn("digest", digest(F.col("content")))
    hashed = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "digest", sha256(F.col("content")).alias("sha"))
    rows, _ = write_shared(hashed, "dedup-rows")
    repeated, _ = write_shared(rows.groupBy("digest").count().where("count > 1").select("digest"), "dedup-digests")
    groups = combined(texts.join(_bounded(repeated), "digest", "left_semi"), salts)
    by_digest = Window.partitionBy("digest")
    numbered = groups.withColumn("which", F.row_number().over(by_digest.orderBy("content"))).withColumn("contents", F.count("*").over(by_digest))
    alike = F.when(F.col("contents") > 1, F.col("content"))
    groups, _ = write_shared(numbered.select("digest", "which", "size", "best", "contents", alike.alias("content")), "dedup-groups")

    single = groups.where("contents = 1").select("digest", "which", "size", "best")
    member = ["row", "doc_id", "n_chars", "digest", "sha", "which", "size", "best"]
    met = rows.join(_bounded(single), "digest").select(*member)
    shared = groups.where("contents > 1").select("digest", "content", "which", "size", "best")
    if not shared.isEmpty():  # contents that share a digest: the content itself tells their rows apart
        apart = texts.join(shared, ["digest", "content"]).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "digest", sha256(F.col("content")).alias("sha"), "which", "size", "best")
        met = met.unionByName(write_shared(apart, "dedup-apart")[0])
    is_best = (F.col("n_chars") == -F.col("best.shorter")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    first = met.where(is_best).groupBy("digest", "which").agg(F.min("row").alias("kept_row"))
    grouped = met.join(_bounded(first), ["digest", "which"])
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    several = grouped.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("kept_row")).alias("kept"), hexed)
    alone = rows.join(_bounded(repeated), "digest", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    return several.unionByName(alone)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_exact_dedup": op12_exact_dedup}

ORACLE_SQL = {
    "op12_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY content) AS group_size FROM t
  WINDOW w AS (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(content) AS text_sha256 FROM g
"""
}
