"""A project's tables on disk: append-only logs per snapshot, published by a manifest row.

Every table lives below ``<root>/<project>/``, never inside the source tree. Openings and closings of
versions are written to folders of their snapshot (in overwrite mode, so a repeated attempt replaces
what a crashed one left); the manifest row comes last. Readers join only what a published snapshot
holds, so a failed run leaves nothing visible. Collection rewrites the tables into a new generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import snapshot_uuid
from graphloom.operators import changes, collection
from graphloom.schemas import TABLES

OPENED = {
    "symbol": "id string, identity_id string, start_byte bigint, end_byte bigint, start_line int, end_line int, content_hash string, visible_from bigint",
    "edge": "from_symbol_identity string, to_symbol_identity string, kind int, confidence int, visible_from bigint",
    "file": "id string, identity_id string, content_hash string, size_bytes bigint, visible_from bigint",
}
KEYS = {"symbol": ["id", "visible_from"], "edge": ["from_symbol_identity", "to_symbol_identity", "kind", "visible_from"], "file": ["id", "visible_from"]}


class ConcurrentWriter(Exception):
    """Another writer published a snapshot in between."""


class Store:
    def __init__(self, spark: SparkSession, root: str, project: str):
        self.spark, self.base = spark, f"{root.rstrip('/')}/{project}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _read(self, path: str, schema: str) -> DataFrame:
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def generation(self) -> int:
        rows = self._read(f"{self.base}/generation", "number int").agg(F.max("number").alias("n")).first()
        return rows["n"] or 0

    def _at(self, *parts: str) -> str:
        return "/".join([self.base, f"g{self.generation()}", *parts])

    def manifest(self) -> DataFrame:
        return self._read(self._at("manifest"), TABLES["snapshot"])

    def identities(self, name: str) -> DataFrame:
        """file_identity or symbol_identity: the last row written for each id."""
        schema = TABLES[name]
        rows = self._read(self._at(name), schema + ", snapshot bigint")
        live = rows.join(self.manifest().select(F.col("id").alias("snapshot")), "snapshot", "left_semi")
        others = [c for c in self.spark.createDataFrame([], schema).columns if c != "id"]
        return live.groupBy("id").agg(F.max(F.struct("snapshot", *others)).alias("v")).select("id", *(f"v.{c}" for c in others))

    def versions(self, kind: str) -> DataFrame:
        """Version rows with both ends, of published snapshots only."""
        published = self.manifest().select(F.col("id").alias("snapshot"))
        opened = self._read(self._at(f"{kind}_open"), OPENED[kind] + ", snapshot bigint").join(published, "snapshot", "left_semi").drop("snapshot")
        keys = KEYS[kind]
        kinds = dict(opened.dtypes)
        closed = self._read(self._at(f"{kind}_close"), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", snapshot bigint").join(published, "snapshot", "left_semi")
        ends = closed.groupBy(*keys).agg(F.min("snapshot").alias("visible_until"))
        return opened.join(ends, keys, "left")

    def claim(self, snapshot: int) -> int:
        """The first free snapshot number from this one on: no two writers get the same, and a crashed one's stays unused."""
        while True:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self._at("claims", str(snapshot)))
            if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(p):
                return snapshot
            snapshot += 1

    def publish(self, opened: dict[str, DataFrame], closed: dict[str, DataFrame], identities: dict[str, DataFrame], snapshot: int, base: int, kind: str, now: int) -> None:
        """Writes a snapshot's rows and then its manifest row, the point at which they become visible.

        ``base`` is the snapshot that the rows were compared with; if another writer has published since,
        nothing of this one becomes visible.
        """
        for name, rows in identities.items():
            rows.write.mode("overwrite").parquet(self._at(name, f"snapshot={snapshot}"))
        for name, rows in opened.items():
            rows.withColumn("visible_from", F.lit(snapshot).cast("long")).write.mode("overwrite").parquet(self._at(f"{name}_open", f"snapshot={snapshot}"))
        for name, rows in closed.items():
            rows.select(*KEYS[name]).write.mode("overwrite").parquet(self._at(f"{name}_close", f"snapshot={snapshot}"))
        if self.latest() != base:
            raise ConcurrentWriter(f"snapshot {self.latest()} was published while {snapshot} was written over {base}")
        row = self.spark.createDataFrame([(snapshot, "", kind, None, None, base or None, now)], TABLES["snapshot"])
        row = row.withColumn("uuid", snapshot_uuid(F.col("created_at") * 1_000_000_000, F.col("id")))
        row.write.mode("append").parquet(self._at("manifest"))

    def set_meta(self, key: str, value: str) -> None:
        at = self._read(f"{self.base}/meta", TABLES["meta"] + ", at bigint").count()
        row = self.spark.createDataFrame([(key, value, at)], TABLES["meta"] + ", at bigint")
        self.append("meta", row)

    def get_meta(self, key: str) -> str | None:
        """The last value set under the key; null if there is none."""
        rows = self._read(f"{self.base}/meta", TABLES["meta"] + ", at bigint").where(F.col("key") == key)
        found = changes.last_values(rows, "key", "value", "at").first()
        return found["value"] if found else None

    def size(self) -> int:
        """Bytes of all the project's tables."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def latest(self) -> int:
        return self.manifest().agg(F.max("id").alias("n")).first()["n"] or 0

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.base}/{name}")

    def log(self, name: str) -> DataFrame:
        return self._read(f"{self.base}/{name}", TABLES[name])

    def collect_garbage(self, now: int, keep: int = collection.KEEP_EPHEMERAL, keep_days: int = collection.KEEP_DAYS) -> dict[str, int]:
        """Drops old ephemeral snapshots and the versions that begin or end there, by writing a new generation."""
        manifest = self.manifest()
        gone = collection.victims(manifest, now, keep, keep_days)
        freed = gone.count()
        if not freed:
            return {"freed_snapshots": 0, "freed_versions": 0}
        number = self.generation() + 1
        target, dropped = f"{self.base}/g{number}", 0
        for kind in OPENED:
            rows = self.versions(kind)
            left = collection.surviving_versions(rows, gone)
            dropped += rows.count() - left.count()
            left.drop("visible_until").withColumn("snapshot", F.col("visible_from")).write.mode("overwrite").partitionBy("snapshot").parquet(f"{target}/{kind}_open")
            left.where("visible_until IS NOT NULL").select(*KEYS[kind], F.col("visible_until").alias("snapshot")).write.mode("overwrite").partitionBy("snapshot").parquet(f"{target}/{kind}_close")
        left = collection.survivors(manifest, gone)
        last = left.agg(F.max("id").alias("n")).first()["n"] or 0
        for name in ("file_identity", "symbol_identity"):
            self.identities(name).write.mode("overwrite").parquet(f"{target}/{name}/snapshot={last}")
        left.write.mode("overwrite").parquet(f"{target}/manifest")
        self.spark.createDataFrame([(number,)], "number int").write.mode("append").parquet(f"{self.base}/generation")
        return {"freed_snapshots": freed, "freed_versions": dropped}


class Registry:
    """All projects of a warehouse, as a log of what became known of each; the last known value counts."""

    FIELDS = ["canonical_path", "display_name", "snapshot_source", "created_at", "last_attached_at", "last_indexed_at", "db_size_bytes", "status"]

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root, "registry")
        self.spark = spark

    def _log(self, at: int, uuid: str, **values) -> None:
        row = {"uuid": uuid, **{k: values.get(k) for k in self.FIELDS}}
        df = self.spark.createDataFrame([tuple(row.values())], TABLES["project"]).withColumn("at", F.lit(at).cast("long"))
        self.store.append("project", df)

    def attached(self, uuid: str, path: str, at: int) -> None:
        self._log(at, uuid, canonical_path=path, display_name=path.rsplit("/", 1)[-1], snapshot_source="unknown", created_at=at, last_attached_at=at, status="active")

    def indexed(self, uuid: str, at: int, size: int) -> None:
        self._log(at, uuid, last_indexed_at=at, db_size_bytes=size)

    def archive(self, uuid: str, at: int) -> None:
        self._log(at, uuid, status="archived")

    def all(self) -> DataFrame:
        """One row per project: the first time it was created, else the last value written for each field."""
        log = self.store._read(f"{self.store.base}/project", TABLES["project"] + ", at bigint")
        last = [F.max(F.when(F.col(f).isNotNull(), F.struct("at", f)))[f].alias(f) for f in self.FIELDS if f != "created_at"]
        return log.groupBy("uuid").agg(F.min("created_at").alias("created_at"), *last)

    def active(self) -> DataFrame:
        return self.all().where("status = 'active'").orderBy(F.desc("last_attached_at"), "uuid")
