"""What changed between two states of a tree of files, by digests of its folders.

A folder's digest is a sum over all files below it, so files are added up per folder in one pass, and the
sum does not depend on their order. Two trees are compared from the top: only folders whose parent differs
are looked at, and only files that lie directly in folders with differing files are compared. Files that
vanished and files that are new are then paired: equal contents first, then similar ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.sweep import ranged, running_sums
from graphloom.sources.shared_storage import drop_shared, new_path

#: Words of a shingle, hash functions and those of a band, and the least similarity of a renamed file with edits.
WORDS, HASHES, BAND, SIMILAR = 3, 32, 2, 0.5
#: Most differing folders of a level whose names are broadcast.
MAX_BROADCAST_FOLDERS = 1 << 18


def folder_of(path: Column) -> Column:
    """What stands before the last slash; '' for a file of the top folder."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _ancestors(folder: Column) -> Column:
    """A folder and all above it, with their depths: '' is 0."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))


@dataclass
class DigestTree:
    """Written: ``files`` (path, folder, content_hash), and ``folders`` (depth, folder, parent, deep, own) in folders by depth."""

    files: DataFrame
    folders: DataFrame
    path: str

    @classmethod
    def build(cls, files: DataFrame) -> DigestTree:
        """Of files (path, content_hash), each path once; null hashes are a content of their own, null paths are left out."""
        spark = files.sparkSession
        path = new_path(spark, "digest-tree")
        known = files.where("path IS NOT NULL").select("path", folder_of(F.col("path")).alias("folder"), F.col("content_hash").cast("string").alias("content_hash"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        known.repartitionByRange(parts, "folder", "path").sortWithinPartitions("folder", "path").write.parquet(f"{path}/files")
        rows = spark.read.schema(known.schema).parquet(f"{path}/files")
        name = F.sha2(F.to_json(F.array("path", F.coalesce("content_hash", F.lit("\0")))).cast("binary"), 256)
        number = lambda at: F.conv(F.substring(name, at, 15), 16, 10).cast("decimal(38,0)")
        marked = rows.select("folder", number(1).alias("a"), number(17).alias("b"))
        own = marked.groupBy("folder").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n"))  # a row per folder with files
        spread = own.select(F.explode(_ancestors(F.col("folder"))).alias("up"), F.col("folder").alias("of"), "a", "b", "n").select("up.depth", "up.folder", "of", "a", "b", "n")
        total = lambda kept: F.concat_ws(":", *(F.sum(F.when(kept, F.col(c))).cast("string") for c in ("a", "b", "n")))
        direct = F.col("of") == F.col("folder")
        sums = spread.groupBy("depth", "folder").agg(total(F.lit(True)).alias("deep"), total(direct).alias("own"))
        sums.withColumn("parent", F.when(F.col("depth") > 0, folder_of(F.col("folder")))).repartitionByRange(parts, "depth", "parent", "folder").sortWithinPartitions("depth", "parent").write.partitionBy("depth").parquet(f"{path}/folders")
        folders = spark.read.schema("folder string, deep string, own string, parent string, depth int").parquet(f"{path}/folders")
        return cls(rows, folders, path)

    def drop(self) -> None:
        drop_shared(self.files.sparkSession, self.path)


def _few(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.count() <= MAX_BROADCAST_FOLDERS else names


def differing(old: DigestTree, new: DigestTree) -> tuple[DataFrame, int]:
    """(folder) of the folders whose own files differ, and how many folders were compared.

    One step for each level of the tree: a folder is looked at if the one above it differs, and a level
    without such folders is the last.
    """
    spark = old.files.sparkSession
    out = spark.createDataFrame([], "folder string")
    above, paths, compared, depth = None, [], 0, 0
    while True:
        sides = []
        for side, tree in (("o", old), ("n", new)):
            rows = tree.folders.where(F.col("depth") == depth)
            if above is not None:
                rows = rows.join(above, "parent", "left_semi")
            sides.append(rows.select("folder", F.col("deep").alias(f"deep_{side}"), F.col("own").alias(f"own_{side}")))
        met = sides[0].join(sides[1], "folder", "full_outer")
        marked = met.select("folder", (~F.col("deep_o").eqNullSafe(F.col("deep_n"))).alias("deep"), (~F.col("own_o").eqNullSafe(F.col("own_n"))).alias("own"))
        path = new_path(spark, "digest-level")
        marked.write.parquet(path)
        paths.append(path)
        level = spark.read.schema(marked.schema).parquet(path)
        compared += level.count()
        out = out.unionAll(level.where("own").select("folder"))
        below = level.where("deep").select(F.col("folder").alias("parent"))
        if below.isEmpty():
            return out, compared
        above, depth = _few(below), depth + 1


def _pair(gone: DataFrame, came: DataFrame, key: list[str]) -> DataFrame:
    """(old_path, path) of the k-th of both sides in order of path, for each key; numbered by ranges, so a key may hold any part of the rows."""
    sides = []
    for rows, name in ((gone, "old_path"), (came, "path")):
        dealt = ranged(rows.select(*key, "path").withColumn("n", F.lit(1).cast("long")), key, ["path"])
        sides.append(running_sums(dealt, key, ["path"], ["n"]).select(*key, "n", F.col("path").alias(name)))
    return sides[0].join(sides[1], [*key, "n"]).select("old_path", "path")


def _shingles(text: Column) -> Column:
    words = F.filter(F.split(text, r"\W+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - WORDS + 1, F.lit(1)))
    return F.when(F.size(words) > 0, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, WORDS), " "))))).otherwise(F.array().cast("array<bigint>"))


def _similar(gone: DataFrame, came: DataFrame, contents: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(old_path, path, similarity) of files that are each other's most similar, at least SIMILAR.

    Candidates are those that MinHash bands put together: of each band's files the k-th that went and the
    k-th that came, in order of path, so their number grows with the files and never with pairs.
    """
    signed = []
    for rows, texts in zip((gone, came), contents):
        held = rows.join(texts.select("path", "content"), "path").select("path", _shingles(F.coalesce("content", F.lit(""))).alias("shingles")).where(F.size("shingles") > 0)
        least = F.array(*(F.array_min(F.transform("shingles", lambda s, i=i: F.xxhash64(s, F.lit(i)))) for i in range(HASHES)))
        signed.append(held.withColumn("least", least))
    bands = [s.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(HASHES - BAND + 1), F.lit(BAND)), lambda i: F.xxhash64(F.slice("least", i, BAND)))).alias("band", "key")) for s in signed]
    pairs = _pair(bands[0], bands[1], ["band", "key"]).distinct()
    met = pairs.join(signed[0].select(F.col("path").alias("old_path"), F.col("shingles").alias("x")), "old_path").join(signed[1].select("path", F.col("shingles").alias("y")), "path")
    scored = met.select("old_path", "path", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("similarity")).where(F.col("similarity") >= SIMILAR)
    by_new = scored.groupBy("path").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "old_path")).alias("b")).select("path", F.col("b.old_path").alias("old_path"), (-F.col("b.s")).alias("similarity"))
    by_old = scored.groupBy("old_path").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path")).alias("b")).select("old_path", F.col("b.path").alias("path"))
    return by_new.join(by_old, ["old_path", "path"])


def changes(old: DigestTree, new: DigestTree, contents: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(path, change, old_path) of every file that differs: Added, Deleted, Modified, or Renamed with the path it had.

    A file that vanished and a new one of equal content are one renamed file; of several, the first in
    order of path go together. With ``contents``, old and new (path, content) of any superset of the files,
    files left over are renamed, too, where they are each other's most similar. Null contents equal only
    each other.
    """
    names, _ = differing(old, new)
    names = _few(names)
    a = old.files.join(names, "folder", "left_semi").select("path", F.col("content_hash").alias("h"), F.lit(True).alias("was"))
    b = new.files.join(names, "folder", "left_semi").select("path", F.col("content_hash").alias("k"), F.lit(True).alias("is"))
    spark = old.files.sparkSession
    path = new_path(spark, "digest-changes")
    met = a.join(b, "path", "full_outer").where("was IS NULL OR is IS NULL OR NOT (h <=> k)")
    kind = F.when(F.col("was").isNull(), "Added").when(F.col("is").isNull(), "Deleted").otherwise("Modified")
    met.select("path", kind.alias("change"), F.coalesce("h", "k").alias("content_hash")).write.parquet(path)
    found = spark.read.schema("path string, change string, content_hash string").parquet(path)
    gone, came = found.where("change = 'Deleted'"), found.where("change = 'Added'")
    keyed = lambda rows: rows.withColumn("key", F.coalesce("content_hash", F.lit("\0")))
    moved = _pair(keyed(gone), keyed(came), ["key"])
    if contents is not None:
        rest = gone.join(moved, F.col("old_path") == gone["path"], "left_anti"), came.join(moved.select("path"), "path", "left_anti")
        moved = moved.unionAll(_similar(*rest, contents).select("old_path", "path"))
    moved_path = new_path(spark, "digest-moved")
    moved.write.parquet(moved_path)
    moved = spark.read.schema("old_path string, path string").parquet(moved_path)
    left = found.join(moved.select(F.col("old_path").alias("path"), F.lit("Deleted").alias("change")), ["path", "change"], "left_anti").join(moved.select("path", F.lit("Added").alias("change")), ["path", "change"], "left_anti")
    return left.select("path", "change", F.lit(None).cast("string").alias("old_path")).unionAll(moved.select("path", F.lit("Renamed"), "old_path"))
