"""Projects: indexing source trees, asking about their graphs, overlays, feedback and collection."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.functions.text import confidence, parsed, payload, span_length
from graphloom.operators import changes, feedback, graph, resolver
from graphloom.operators.dedup import keep_first
from graphloom.operators.visibility import open_rows, snapshot_diff, visible_at
from graphloom.plans import context
from graphloom.schemas import EDGE_KINDS, EVENT_KINDS
from graphloom.sources import parser, tree
from graphloom.sources.store import Registry, Store

MAX_ACTIVE = 5
#: Of edges found by name, stored in hundredths.
CONFIDENCE = 1.0


class GraphError(Exception):
    """Base of this module's errors."""


class UnknownProject(GraphError):
    pass


@dataclass
class IndexResult:
    snapshot: int
    files: int
    new_symbols: int
    new_edges: int


def symbols_of(parsed: DataFrame, project: str) -> DataFrame:
    """Symbols with identities; of repeated identities the first built stays."""
    rows = parser.raw_symbols(parsed)
    p = F.lit(project)
    named = rows.withColumn("file_id", ids.file_id(p, F.col("rel_path"))).withColumn("identity", ids.symbol_id(p, F.col("rel_path"), F.col("qualified_name"), F.col("kind")))
    # Names are resolved within this build order: files by path, symbols by place.
    return keep_first(named.withColumn("ord", F.struct("rel_path", "ord")), ["identity"], ["ord"])


def edges_of(parsed: DataFrame, symbols: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    rows = parser.raw_references(parsed).withColumn("file_id", ids.file_id(F.lit(project), F.col("rel_path"))).withColumn("ord", F.struct("rel_path", "ord"))
    return resolver.resolve_edges(rows.select("file_id", "from_qualified_name", "to_name", "kind", "ord"), symbols.select("identity", "file_id", "qualified_name", "name", "ord"))


def nodes_of(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("identity").alias("id"), "name", "qualified_name", F.col("rel_path").alias("file_path"), "kind", "start_line", "end_line", span_length(F.col("start_byte"), F.col("end_byte")).alias("byte_len"))


class Project:
    """One source tree: its stored snapshots, the graph at the latest one, and an overlay that is never stored."""

    def __init__(self, spark: SparkSession, warehouse: str, root: str, clock: Callable[[], int] = lambda: int(time.time())):
        self.spark, self.root, self.clock = spark, tree.canonical(root), clock
        self.id = spark.range(1).select(ids.project_id(F.lit(self.root)).alias("id")).first()["id"]
        self.store = Store(spark, warehouse, self.id)
        self.registry = Registry(spark, warehouse)
        self.registry.attached(self.id, self.root, self.clock())
        self.overlay: tuple[DataFrame, DataFrame] | None = None

    # -- indexing

    def index(self, kind: str = "filehash") -> IndexResult:
        """Stores what changed since the last snapshot: only new and changed files are parsed.

        Symbols, edges and files that are gone are closed; unchanged ones stay as they are.
        """
        files = tree.source_tree(self.spark, self.root).withColumn("hash", ids.content_hash(F.col("content")))
        base = self.store.latest()
        p, snapshot = F.lit(self.id), self.store.claim(base + 1)
        walked = files.select("rel_path", "language", "size_bytes", "content", "hash", ids.file_id(p, F.col("rel_path")).alias("identity_id")).cache()
        parsed = parser.parse_tree(walked).cache()
        symbols = symbols_of(parsed, self.id).cache()
        edges = edges_of(parsed, symbols, self.id)[0]
        now_symbols = symbols.select(ids.symbol_version_id(F.col("identity"), F.col("content_hash")).alias("id"), F.col("identity").alias("identity_id"), "start_byte", "end_byte", "start_line", "end_line", "content_hash")
        now_edges = edges.select(F.col("src").alias("from_symbol_identity"), F.col("dst").alias("to_symbol_identity"), "kind", (confidence(F.lit(CONFIDENCE)) * 100).cast("int").alias("confidence"))
        now_files = walked.select(ids.symbol_version_id(F.col("identity_id"), F.col("hash")).alias("id"), "identity_id", F.col("hash").alias("content_hash"), "size_bytes")
        # A symbol that only moved has a new span and so a new version row.
        same = {"symbol": ["id", "start_byte", "end_byte"], "edge": ["from_symbol_identity", "to_symbol_identity", "kind"], "file": ["id"]}
        opened, closed = {}, {}
        for name, rows in (("symbol", now_symbols), ("edge", now_edges), ("file", now_files)):
            before = open_rows(self.store.versions(name))
            opened[name] = changes.new_versions(rows, before, same[name]).cache()
            closed[name] = before.join(rows.select(*same[name]), same[name], "left_anti").cache()
        result = IndexResult(snapshot, walked.count(), opened["symbol"].count(), opened["edge"].count())
        closed["symbol"].count(), closed["edge"].count(), closed["file"].count()
        identities = {
            "file_identity": walked.select(F.col("identity_id").alias("id"), F.col("rel_path").alias("path"), "language"),
            "symbol_identity": symbols.select(F.col("identity").alias("id"), F.col("file_id").alias("file_identity_id"), "qualified_name", "name", "kind"),
        }
        self.store.publish(opened, closed, identities, snapshot, base, kind, self.clock())
        self.store.set_meta("project_uuid", self.id)
        self.registry.indexed(self.id, self.clock(), self.store.size())
        for df in (walked, parsed, symbols, *opened.values(), *closed.values()):
            df.unpersist()
        return result

    # -- reading

    def graph(self, snapshot: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, calls): the overlay's if one is set and no snapshot is asked for, else the stored graph's."""
        if self.overlay is not None and snapshot is None:
            return self.overlay
        at = self.store.latest() if snapshot is None else snapshot
        files = self.store.identities("file_identity").select(F.col("id").alias("file_identity_id"), "path")
        rows = visible_at(self.store.versions("symbol"), at).join(self.store.identities("symbol_identity").withColumnRenamed("id", "identity_id"), "identity_id").join(files, "file_identity_id", "left")
        nodes = rows.select(F.col("identity_id").alias("id"), "name", "qualified_name", F.coalesce("path", F.lit("")).alias("file_path"), "kind", "start_line", "end_line", span_length(F.col("start_byte"), F.col("end_byte")).alias("byte_len"))
        edges = visible_at(self.store.versions("edge"), at).where(F.col("kind") == EDGE_KINDS["Calls"])
        return nodes, edges.select(F.col("from_symbol_identity").alias("src"), F.col("to_symbol_identity").alias("dst"))

    def callers(self, name: str) -> DataFrame:
        return graph.relations(*self.graph(), name, "callers")

    def callees(self, name: str) -> DataFrame:
        return graph.relations(*self.graph(), name, "callees")

    def trace(self, name: str, direction: str = "both") -> DataFrame:
        return graph.trace(*self.graph(), name, direction)

    def search(self, needle: str) -> DataFrame:
        return graph.search(self.graph()[0], needle).orderBy("qualified_name", "id")

    def symbol(self, name: str) -> DataFrame:
        return graph.named(self.graph()[0], name)

    def impact(self, name: str, max_depth: int = 3) -> DataFrame:
        """Files that a change to the symbols of this name can reach through callers, with their tests."""
        nodes, calls = self.graph()
        return graph.impact(nodes, calls, graph.named(nodes, name).select("id"), max_depth)

    def explain(self, base: int, head: int, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
        """What changed between two snapshots: (id, change) of symbols, and the files that callers carry it to."""
        changed = snapshot_diff(self.store.versions("symbol"), base, head, ["identity_id", "id"])
        return graph.explained(*self.graph(head), changed, "identity_id", max_depth)

    def edges(self, snapshot: int | None = None) -> DataFrame:
        """(src, dst, kind) of every kind at a snapshot, the latest unless one is named."""
        rows = visible_at(self.store.versions("edge"), self.store.latest() if snapshot is None else snapshot)
        return rows.select(F.col("from_symbol_identity").alias("src"), F.col("to_symbol_identity").alias("dst"), "kind")

    # -- overlay

    def set_overlay(self, files: DataFrame) -> None:
        """Replaces the overlay by files (rel_path, content); null content is a deleted file. Nothing is stored."""
        if not self.store.latest():
            empty = self.graph(0)
            self.overlay = (empty[0].limit(0), empty[1].limit(0))
            return
        self.overlay = None
        base_nodes, base_calls = self.graph()
        there = files.where("content IS NOT NULL").withColumn("language", tree.language_of(F.col("rel_path"))).where("language IS NOT NULL")
        parsed = parser.parse_tree(there)
        own = symbols_of(parsed, self.id)
        changed = files.select(F.col("rel_path").alias("file_path"))
        nodes = changes.overlay_nodes(base_nodes, changed, nodes_of(own))
        p = F.lit(self.id)
        others = base_nodes.join(changed, "file_path", "left_anti")
        known = others.select(F.col("id").alias("identity"), ids.file_id(p, F.col("file_path")).alias("file_id"), "qualified_name", "name", F.struct(F.col("file_path").alias("rel_path"), F.col("start_line").alias("ord")).alias("ord"))
        merged = known.unionByName(own.select("identity", "file_id", "qualified_name", "name", "ord"))
        new = edges_of(parsed, merged, self.id)[0].where(F.col("kind") == EDGE_KINDS["Calls"])
        self.overlay = (nodes, changes.overlay_edges(base_calls, base_nodes, changed, new))

    def clear_overlay(self) -> None:
        self.overlay = None

    # -- context and feedback

    def usefulness(self) -> DataFrame:
        events = self.store.log("telemetry_event").where(F.col("event_kind") == EVENT_KINDS["symbol_included"])
        fields = parsed(F.col("payload"), "identity string, score bigint")
        rows = events.select(fields["identity"].alias("identity_id"), F.col("id").alias("seq"), fields["score"].alias("score"), F.col("created_at").alias("seen_at"))
        return feedback.clamped(feedback.usefulness(rows.where("identity_id IS NOT NULL")))

    def find_context(self, task: context.Task) -> DataFrame:
        """The ranked plan; its pack is logged, and its items count as included from then on."""
        nodes, calls = self.graph()
        uses = self.usefulness().select(F.col("identity_id").alias("id"), "times_included")
        plan = context.context_plan(nodes, calls, uses, task)
        items = context.pack_rows(plan).select("id", "score", "rank").collect()  # at most budget / 16 rows
        first = (self.store.log("telemetry_event").agg(F.max("id").alias("n")).first()["n"] or 0) + 1
        now = self.clock()
        head = self.spark.createDataFrame([(first, EVENT_KINDS["pack_built"], task.text, now)], "id bigint, event_kind int, task string, created_at bigint").select("id", "event_kind", payload(task=F.col("task")).alias("payload"), "created_at")
        rows = [(first + r["rank"], EVENT_KINDS["symbol_included"], r["id"], r["score"], now) for r in items]
        body = self.spark.createDataFrame(rows, "id bigint, event_kind int, identity string, score int, created_at bigint").select("id", "event_kind", payload(identity=F.col("identity"), score=F.col("score")).alias("payload"), "created_at")
        self.store.append("telemetry_event", head.unionByName(body))
        return plan

    def collect_garbage(self, keep: int = 5, keep_days: int = 30) -> dict[str, int]:
        return self.store.collect_garbage(self.clock(), keep, keep_days)


class Engine:
    """Attached projects, the least recently used of which is let go beyond ``MAX_ACTIVE``."""

    def __init__(self, spark: SparkSession, warehouse: str, clock: Callable[[], int] = lambda: int(time.time()), max_active: int = MAX_ACTIVE):
        self.spark, self.warehouse, self.clock, self.max_active = spark, warehouse, clock, max_active
        self.active: OrderedDict[str, Project] = OrderedDict()

    def attach(self, root: str) -> Project:
        key = tree.canonical(root)
        project = self.active.pop(key, None) or Project(self.spark, self.warehouse, key, self.clock)
        self.active[key] = project
        while len(self.active) > self.max_active:
            self.active.popitem(last=False)
        return project

    def get(self, root: str) -> Project:
        key = tree.canonical(root)
        if key not in self.active:
            raise UnknownProject(key)
        return self.attach(root)

    def detach(self, root: str) -> bool:
        return self.active.pop(tree.canonical(root), None) is not None

    def projects(self) -> list[str]:
        """Attached roots, the most recently used first."""
        return list(reversed(self.active))

    def known(self) -> DataFrame:
        """Every project that was attached to this warehouse and not archived, the last attached first."""
        return Registry(self.spark, self.warehouse).active()
