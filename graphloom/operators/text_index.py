"""A trigram index over names: containment of any needle without reading all names.

Every three code points in a row of a lower-cased text are a posting (gram, id, field, pos). Postings lie
in folders by a hash of the gram and sorted by gram within, so that a lookup reads its grams' folders, and
in them the row groups that hold them. A search takes the needle's rarest grams, whose numbers are known,
intersects their postings by where the needle would begin, and checks what is left against the texts; a
table of needles meets the postings of each needle's rarest gram, and then the texts.
Needles of one or two code points have no gram and are looked for in the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import contains_any_case
from graphloom.sources.shared_storage import drop_shared, new_path, write_shared

GRAM, BUCKETS = 3, 64
#: Grams of a needle that are intersected, and most postings of the rarest for which its ids are broadcast.
RAREST, MAX_BROADCAST_POSTINGS = 3, 1 << 18
#: Most bytes of needles, each with its lower-cased form and 64 more, for which they are broadcast.
MAX_BROADCAST_NEEDLES = 8 << 20


def code_points(text: Column) -> Column:
    """The code points of a text as an array of strings."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def grams(text: Column, size: int = GRAM) -> Column:
    """The runs of ``size`` code points of a text, in order; none where it is shorter."""

    def runs(points: Column) -> Column:
        starts = F.when(F.size(points) >= size, F.sequence(F.lit(0), F.size(points) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*(F.get(points, i + j) for j in range(size))))

    return F.transform(F.array(code_points(text)), runs)[0]  # the code points as a variable, found once and not once for each run


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """An index over some columns of nodes (id, ...); ``build`` writes it, and it is valid for these nodes only."""

    def __init__(self, nodes: DataFrame, columns: list[str], path: str):
        self.nodes, self.columns, self.path, self.spark = nodes, columns, path, nodes.sparkSession

    @classmethod
    def build(cls, nodes: DataFrame, columns: list[str], path: str | None = None) -> TextIndex:
        """Writes postings and their numbers below ``path`` (by default a new folder of the shared ones).

        Null texts have no postings, nor have rows with a null id, which searches look at one by one. A gram
        that a large part of all texts hold spreads over tasks and files.
        """
        index = cls(nodes, columns, path or new_path(nodes.sparkSession, "text-index"))
        parts = index._parts()
        rows = index._dealt().select("id", "field", F.posexplode(grams(F.col("text"))).alias("pos", "gram")).withColumn("bucket", _bucket(F.col("gram")))
        order = ["bucket", "gram", "id", "field", "pos"]
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings")
        counts = index.postings.groupBy("gram").agg(F.count("*").alias("n"))
        counts.repartitionByRange(max(1, parts // 8), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{index.path}/grams")
        return index

    def drop(self) -> None:
        drop_shared(self.spark, self.path)

    def _texts(self) -> DataFrame:
        texts = F.posexplode(F.array(*(F.lower(F.col(c).cast("string")) for c in self.columns))).alias("field", "text")
        return self.nodes.where("id IS NOT NULL").select("id", texts).where("text IS NOT NULL")

    def _parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _dealt(self) -> DataFrame:
        """The texts over all tasks, for what makes many rows of each: a small file is a single task's otherwise."""
        return self._texts().repartition(self._parts())

    @property
    def postings(self) -> DataFrame:
        kind = self.nodes.schema["id"].dataType.simpleString()
        return self.spark.read.schema(f"id {kind}, field int, pos int, gram string, bucket int").parquet(f"{self.path}/postings")

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long").parquet(f"{self.path}/grams")

    def _starts(self, gram: str, offset: int) -> DataFrame:
        """Where a needle with this gram at this offset would begin."""
        bucket = self.spark.range(1).select(_bucket(F.lit(gram)).alias("b")).first()["b"]
        found = self.postings.where((F.col("bucket") == bucket) & (F.col("gram") == gram) & (F.col("pos") >= offset))
        return found.select("id", "field", (F.col("pos") - offset).alias("start"))

    def holds(self, needle: str) -> Column:
        out = F.lit(False)
        for c in self.columns:
            out = out | F.coalesce(contains_any_case(F.col(c).cast("string"), needle), F.lit(False))
        return out

    def search(self, needle: str) -> DataFrame:
        """The nodes that hold the needle in one of the columns, whatever the case, as a scan would find them."""
        low = needle.lower()
        offsets = {low[i : i + GRAM]: i for i in range(len(low) - GRAM + 1)}
        if not offsets:
            return self.nodes.where(self.holds(needle))
        known = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(list(offsets))).collect()}  # at most one row per code point of the needle
        unnamed = self.nodes.where(F.col("id").isNull() & self.holds(needle))
        if len(known) < len(offsets):
            return unnamed
        rarest = sorted(known, key=lambda g: (known[g], g))[:RAREST]
        hits = self._starts(rarest[0], offsets[rarest[0]])
        for gram in rarest[1:]:
            hits = hits.join(self._starts(gram, offsets[gram]), ["id", "field", "start"], "left_semi")
        ids = hits.select("id").distinct()
        if known[rarest[0]] <= MAX_BROADCAST_POSTINGS:
            ids = F.broadcast(ids)
        return self.nodes.join(ids, "id", "left_semi").select(*self.nodes.columns).where(self.holds(needle)).unionAll(unnamed)

    def search_many(self, needles: DataFrame) -> DataFrame:
        """(needle, id) for every node id and every different needle of ``needles`` (needle) that one of its columns holds.

        Needles meet the postings of their rarest gram, and what is found meets the texts; no other posting
        is read. Needles of some number are broadcast, more are joined by gram. Null needles and nodes
        without id have no row; an empty needle is held by every text.
        """
        asked = needles.where("needle IS NOT NULL").select("needle").distinct().withColumn("low", F.lower("needle"))
        asked, _ = write_shared(asked, "needles")  # derived once, and of a known size from here on
        size = asked.agg(F.sum(F.octet_length("needle") + F.octet_length("low") + 64)).first()[0] or 0
        dealt = F.broadcast if size <= MAX_BROADCAST_NEEDLES else lambda rows: rows
        length = F.char_length("low")
        by_rarity = Window.partitionBy("needle").orderBy("n", "gram", "offset")  # a row per code point of a needle
        spread = asked.where(length >= GRAM).select("needle", "low", F.posexplode(grams(F.col("low"))).alias("offset", "gram"))
        counted = spread.join(self.counts, "gram", "left").na.fill(0, ["n"]).withColumn("place", F.row_number().over(by_rarity))
        chosen = counted.where("place = 1 AND n > 0").select("needle", "low", "gram", "offset")
        hits = self.postings.drop("bucket").join(dealt(chosen), "gram").where("pos >= offset").select("needle", "low", "id", "field", (F.col("pos") - F.col("offset")).alias("start"))
        long = hits.join(self._texts(), ["id", "field"]).where(F.substring("text", F.col("start") + 1, F.char_length("low")) == F.col("low")).select("needle", "id")
        pieces = F.array_distinct(F.concat(F.array(F.lit("")), code_points(F.col("text")), grams(F.col("text"), 2)))
        short = self._dealt().select("id", F.explode(pieces).alias("low")).join(dealt(asked.where(length < GRAM)), "low").select("needle", "id")
        return long.unionAll(short).distinct()
