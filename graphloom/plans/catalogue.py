"""All queries over the given tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions import ids
from graphloom.functions.text import confidence, keywords, last_segment, parsed, payload, qualify, span_length, token_cost
from graphloom.operators import changes, collection, dedup, digest_tree, feedback, graph, keyword_match, packing, resolver, statistics, sweep, text_index, visibility
from graphloom.plans import context, many_tasks
from graphloom.plans.stand_ins import Tables, with_ctes
from graphloom.sources import tree
from graphloom.streaming import overlay_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AT = 1995 * 12 + 6
NOW, KEEP = (1998 * 12) * 2592000, 3
TASK = context.Task("fix small_ring hot", "Brand#2", ["Brand#3", "Brand#4"], 5000)
CHANGED = ["Brand#3", "Brand#4"]


def query(name: str, sql: str | None = None):
    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return add


# ---- filters and projections


@query("p1_visible_at", with_ctes("versions", f"SELECT identity, version, visible_from, visible_until FROM versions WHERE visible_from <= {AT} AND (visible_until IS NULL OR visible_until > {AT})"))
def _(t):
    return visibility.visible_at(t.versions, AT).select("identity", "version", "visible_from", "visible_until")


@query("p2_open_rows", with_ctes("versions", "SELECT identity, count(*) AS open_versions FROM versions WHERE visible_until IS NULL GROUP BY identity"))
def _(t):
    return visibility.open_rows(t.versions).groupBy("identity").agg(F.count("*").alias("open_versions"))


@query("p3_exact_name", with_ctes("nodes", "SELECT id, qualified_name FROM nodes WHERE name = 'small_ring'"))
def _(t):
    return graph.named(t.nodes, "small_ring").select("id", "qualified_name")


@query("p4_name_at_snapshot", with_ctes("nodes versions", f"SELECT id, qualified_name, version, part_no FROM nodes JOIN versions ON identity = id WHERE name = 'small_ring' AND visible_from <= {AT} AND (visible_until IS NULL OR visible_until > {AT})"))
def _(t):
    own = graph.named(t.nodes, "small_ring")
    return visibility.visible_at(t.versions, AT).join(own, F.col("identity") == F.col("id")).select("id", "qualified_name", "version", "part_no")


@query("p5_search", with_ctes("nodes", "SELECT id, name, qualified_name FROM nodes WHERE contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring')"))
def _(t):
    return graph.search(t.nodes, "RING").select("id", "name", "qualified_name").orderBy("qualified_name", "id")


@query("p5_indexed_search", with_ctes("nodes", "SELECT id, name, qualified_name FROM nodes WHERE contains(lower(name), 'mall_ring') OR contains(lower(qualified_name), 'mall_ring')"))
def _(t):
    index = text_index.TextIndex.build(t.nodes, ["name", "qualified_name"])
    return index.search("mall_RING").select("id", "name", "qualified_name")


@query("p5_search_many", with_ctes("nodes", """SELECT needle, id FROM nodes JOIN (SELECT upper(right(p_name, 6)) AS needle FROM part UNION SELECT left(p_name, 2) FROM part UNION SELECT p_brand || '::' || left(p_name, 3) FROM part UNION SELECT p_type FROM part) n
  ON contains(lower(name), lower(needle)) OR contains(lower(qualified_name), lower(needle))"""))
def _(t):
    part = t.read("part")
    sides = [F.upper(F.right("p_name", F.lit(6))), F.left("p_name", F.lit(2)), F.concat("p_brand", F.lit("::"), F.left("p_name", F.lit(3))), F.col("p_type")]
    needles = part.select(F.explode(F.array(*sides)).alias("needle"))
    return text_index.TextIndex.build(t.nodes, ["name", "qualified_name"]).search_many(needles)


@query("p6_point_lookup", with_ctes("nodes", "SELECT id, name, file_path FROM nodes WHERE id = 42"))
def _(t):
    return t.nodes.where("id = 42").select("id", "name", "file_path")


@query("p7_edge_kind_filter", with_ctes("edges", "SELECT src, dst, visible_from FROM edges WHERE kind = 'Calls'"))
def _(t):
    return t.edge_versions.where(schemas.edge_kind_number(F.col("kind")) == schemas.EDGE_KINDS["Calls"]).select("src", "dst", "visible_from")


@query("s20_edges_at_snapshot", with_ctes("edges", f"SELECT src, dst, CASE kind WHEN 'Calls' THEN 1 WHEN 'Imports' THEN 2 ELSE 4 END::INTEGER AS kind FROM edges WHERE visible_from <= {AT} AND (visible_until IS NULL OR visible_until > {AT})"))
def _(t):
    return visibility.visible_at(t.edge_versions, AT).select("src", "dst", schemas.edge_kind_number(F.col("kind")).alias("kind"))


@query("p8_hit_projection", with_ctes("nodes", "SELECT qualified_name, kind, file_path, start_line FROM nodes"))
def _(t):
    return t.nodes.select("qualified_name", "kind", "file_path", "start_line")


@query("p9_node_projection", "SELECT p_partkey AS id, greatest(0, (p_retailprice::BIGINT - 1000)::BIGINT)::BIGINT AS byte_len FROM part")
def _(t):
    return t.read("part").select(F.col("p_partkey").alias("id"), span_length(F.lit(1000), F.round("p_retailprice").cast("long")).alias("byte_len"))


@query("p11_membership", with_ctes("nodes", "SELECT id, file_path FROM nodes WHERE file_path IN ('Brand#2', 'Brand#3', 'Brand#4')"))
def _(t):
    return t.nodes.where((F.col("file_path") == "Brand#2") | F.col("file_path").isin(CHANGED)).select("id", "file_path")


@query("p13_active_projects", "SELECT s_suppkey AS project, s_name AS display_name FROM supplier WHERE s_acctbal >= 0")
def _(t):
    status = F.when(F.col("s_acctbal") < 0, "archived").otherwise("active")
    return t.read("supplier").withColumn("status", status).where("status = 'active'").orderBy(F.desc("s_acctbal"), "s_suppkey").select(F.col("s_suppkey").alias("project"), F.col("s_name").alias("display_name"))


# ---- joins


@query("j1_symbols_at_snapshot", with_ctes("nodes versions", f"SELECT id, name, version, visible_from FROM versions JOIN nodes ON identity = id WHERE visible_from <= {AT} AND (visible_until IS NULL OR visible_until > {AT})"))
def _(t):
    return visibility.visible_at(t.versions, AT).join(t.nodes, F.col("identity") == F.col("id")).select("id", "name", "version", "visible_from")


@query("j2_file_paths", with_ctes("nodes", "SELECT n.id, coalesce(f.path, '') AS path FROM nodes n LEFT JOIN (SELECT DISTINCT p_brand AS path FROM part WHERE p_size > 48) f ON f.path = n.file_path"))
def _(t):
    files = t.read("part").where("p_size > 48").select(F.col("p_brand").alias("path")).distinct()
    return t.nodes.join(files, F.col("file_path") == F.col("path"), "left").select("id", F.coalesce("path", F.lit("")).alias("path"))


def _relation_sql(own: str, other: str) -> str:
    return f"SELECT m.id AS match_id, r.id AS related_id, r.name AS related_name, r.file_path AS related_file FROM (SELECT id FROM nodes WHERE name = 'small_ring') m LEFT JOIN (SELECT c.{own} AS k, n.id, n.name, n.file_path FROM bag c JOIN nodes n ON n.id = c.{other}) r ON r.k = m.id"


@query("j3_callers", with_ctes("nodes bag", _relation_sql("dst", "src")))
def _(t):
    return graph.relations(t.nodes, t.bag, "small_ring", "callers")


@query("j3_callees", with_ctes("nodes bag", _relation_sql("src", "dst")))
def _(t):
    return graph.relations(t.nodes, t.bag, "small_ring", "callees")


@query("j4_callers_at_snapshot", with_ctes("calls versions", f"SELECT dst AS id, count(*) AS callers FROM calls SEMI JOIN (SELECT identity FROM versions WHERE visible_from <= {AT} AND (visible_until IS NULL OR visible_until > {AT})) v ON v.identity = src GROUP BY dst"))
def _(t):
    alive = visibility.visible_at(t.versions, AT).select(F.col("identity").alias("src"))
    return t.calls.join(alive, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))


_RESOLVED = """
SELECT r.file_id, r.from_qualified_name, r.to_name, r.ord,
  CASE WHEN l.local IS NOT NULL THEN l.local WHEN n.n = 1 THEN n.only END AS target,
  CASE WHEN l.local IS NOT NULL THEN 'SameFile' WHEN n.n = 1 THEN 'Unique' WHEN n.n > 1 THEN 'Ambiguous' ELSE 'NotFound' END AS reason
FROM refs r LEFT JOIN (SELECT name, count(*) AS n, min(identity) AS only FROM symbols GROUP BY name) n ON n.name = r.to_name
LEFT JOIN (SELECT name, file_id, arg_min(identity, ord) AS local FROM symbols GROUP BY name, file_id) l ON l.name = r.to_name AND l.file_id = r.file_id"""


@query("j5_resolve", with_ctes("refs symbols", _RESOLVED))
def _(t):
    return resolver.resolve_targets(t.references, t.symbols).select("file_id", "from_qualified_name", "to_name", "ord", "target", "reason")


@query("j6_origin", with_ctes("refs symbols", "SELECT r.ord, o.from_identity FROM refs r JOIN (SELECT file_id, qualified_name, arg_max(identity, ord) AS from_identity FROM symbols GROUP BY ALL) o ON o.file_id = r.file_id AND o.qualified_name = r.from_qualified_name"))
def _(t):
    return t.references.join(resolver.origins(t.symbols), ["file_id", "from_qualified_name"]).select("ord", "from_identity")


@query("j7_change_detection", """
WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS h FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS h FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'Added' WHEN a.k IS NULL THEN 'Deleted' WHEN a.h = b.h THEN 'Unchanged' ELSE 'Modified' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def _(t):
    side = lambda status: t.read("orders").where(F.col("o_orderstatus") != status).groupBy("o_custkey").agg(F.max("o_orderkey").alias("h"))
    return changes.detect(side("F"), side("P"), "o_custkey", "h")


def _tree_at(t: Tables, snapshot: int) -> digest_tree.DigestTree:
    """A file for each order, in folders by number; its content is what parts of it are visible."""
    rows = visibility.visible_at(t.versions, snapshot).groupBy("version").agg(F.sum("identity").cast("string").alias("content_hash"))
    part = lambda n: F.expr(f"version div {n}").cast("string")
    return digest_tree.DigestTree.build(rows.select(F.concat(part(1000), F.lit("/"), part(100), F.lit("/"), F.col("version").cast("string")).alias("path"), "content_hash"))


_AT_FILES = "SELECT (version // 1000) || '/' || (version // 100) || '/' || version AS path, sum(identity)::VARCHAR AS h FROM versions WHERE visible_from <= {0} AND (visible_until IS NULL OR visible_until > {0}) GROUP BY version"


@query("j7_tree_changes", with_ctes("versions", """SELECT path, change, NULL AS old_path FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE (change = 'Deleted' AND r.old_path = d.path) OR (change = 'Added' AND r.path = d.path))
  UNION ALL SELECT path, 'Renamed', old_path FROM r""", more=f"""
a AS ({_AT_FILES.format(AT)}), b AS ({_AT_FILES.format(AT + 3)}),
d AS (SELECT path, CASE WHEN a.h IS NULL THEN 'Added' WHEN b.h IS NULL THEN 'Deleted' ELSE 'Modified' END AS change, coalesce(a.h, b.h) AS h FROM a FULL JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h),
n AS (SELECT *, row_number() OVER (PARTITION BY change, h ORDER BY path) AS n FROM d),
r AS (SELECT o.path AS old_path, i.path FROM n o JOIN n i ON o.h = i.h AND o.n = i.n WHERE o.change = 'Deleted' AND i.change = 'Added')"""))
def _(t):
    return digest_tree.changes(_tree_at(t, AT), _tree_at(t, AT + 3))


@query("j8_new_symbol_versions", with_ctes("versions", "SELECT identity, version FROM (SELECT DISTINCT identity, version FROM versions) c ANTI JOIN (SELECT identity, version FROM versions WHERE visible_until IS NULL) o USING (identity, version)"))
def _(t):
    return changes.new_versions(t.versions.select("identity", "version").distinct(), t.versions, ["identity", "version"])


@query("j9_new_edges", with_ctes("calls closed", "SELECT src, dst FROM calls ANTI JOIN closed USING (src, dst)"))
def _(t):
    return changes.new_versions(t.calls, t.closed_calls.withColumn("visible_until", F.lit(None).cast("long")), ["src", "dst"])


@query("j10_overlay_nodes", with_ctes("nodes", "SELECT id, name, file_path FROM nodes WHERE file_path NOT IN ('Brand#3', 'Brand#4') UNION ALL SELECT -id AS id, name, file_path FROM nodes WHERE file_path = 'Brand#3' AND start_line > 20"))
def _(t):
    changed = t.spark.createDataFrame([(c,) for c in CHANGED], "file_path string")
    parsed = t.nodes.where("file_path = 'Brand#3' AND start_line > 20").select((-F.col("id")).alias("id"), "name", "file_path")
    return changes.overlay_nodes(t.nodes.select("id", "name", "file_path"), changed, parsed)


@query("j11_overlay_edges", with_ctes("nodes calls", "SELECT src, dst FROM calls WHERE src NOT IN (SELECT id FROM nodes WHERE file_path IN ('Brand#3', 'Brand#4')) UNION ALL SELECT -src, dst FROM calls SEMI JOIN (SELECT id FROM nodes WHERE file_path = 'Brand#3' AND start_line > 20) n ON n.id = src"))
def _(t):
    changed = t.spark.createDataFrame([(c,) for c in CHANGED], "file_path string")
    parsed = t.nodes.where("file_path = 'Brand#3' AND start_line > 20").select(F.col("id").alias("src"))
    new = t.calls.join(parsed, "src", "left_semi").select((-F.col("src")).alias("src"), "dst")
    return changes.overlay_edges(t.calls, t.nodes, changed, new)


@query("j12_neighbours", with_ctes("nodes calls", "SELECT DISTINCT a.id AS anchor, x.o AS neighbour FROM (SELECT id FROM nodes WHERE name = 'small_ring') a JOIN (SELECT src AS i, dst AS o FROM calls UNION ALL SELECT dst, src FROM calls) x ON x.i = a.id"))
def _(t):
    own = graph.named(t.nodes, "small_ring").select(F.col("id").alias("anchor"))
    both = t.calls.unionAll(t.calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.join(own, F.col("src") == F.col("anchor")).select("anchor", F.col("dst").alias("neighbour")).distinct()


@query("j13_boost_lookup", with_ctes("nodes uses", "SELECT n.id, coalesce(u.times_included, 0)::BIGINT AS times_included, least(coalesce(u.times_included, 0) * 5, 100)::BIGINT AS boost FROM nodes n LEFT JOIN uses u ON u.id = n.id"))
def _(t):
    return t.nodes.select("id").join(t.uses, "id", "left").na.fill(0, ["times_included"]).select("id", "times_included", F.least(F.col("times_included") * 5, F.lit(100)).cast("long").alias("boost"))


@query("j14_live_versions", with_ctes("versions snapshots", "SELECT s.id AS snapshot_id, count(v.identity) AS live, coalesce(sum(v.identity), 0)::BIGINT AS checksum FROM snapshots s LEFT JOIN versions v ON v.visible_from <= s.id AND (v.visible_until IS NULL OR v.visible_until > s.id) GROUP BY s.id"))
def _(t):
    return sweep.live_at(t.versions, t.snapshots, checksum=F.col("identity"))


@query("j14_live_by_file", with_ctes("versions nodes", """SELECT file_path, since, until, live, checksum FROM (
    SELECT file_path, pt AS since, lead(pt) OVER w AS until, (sum(d) OVER w)::BIGINT AS live, (sum(s) OVER w)::BIGINT AS checksum FROM (
      SELECT file_path, pt, sum(d) AS d, sum(d * identity) AS s FROM (SELECT file_path, identity, visible_from AS pt, 1 AS d FROM versions JOIN nodes ON identity = id
        UNION ALL SELECT file_path, identity, visible_until, -1 FROM versions JOIN nodes ON identity = id WHERE visible_until IS NOT NULL) GROUP BY file_path, pt HAVING sum(d) <> 0 OR sum(d * identity) <> 0)
    WINDOW w AS (PARTITION BY file_path ORDER BY pt)) WHERE live <> 0"""))
def _(t):
    files = t.nodes.select(F.col("id").alias("identity"), "file_path")
    return sweep.live_spans(t.versions.join(files, "identity"), ["file_path"], checksum=F.col("identity"))


@query("a15_freed_by_snapshot", with_ctes("versions snapshots", f"""SELECT s.id AS snapshot_id, coalesce(b.n, 0)::BIGINT AS begins, coalesce(e.n, 0)::BIGINT AS ends FROM snapshots s
  LEFT JOIN (SELECT visible_from AS pt, count(*) AS n FROM versions GROUP BY 1) b ON b.pt = s.id LEFT JOIN (SELECT visible_until AS pt, count(*) AS n FROM versions GROUP BY 1) e ON e.pt = s.id
  WHERE s.id IN (FROM victims)""", more=f"""
victims AS (SELECT id FROM snapshots WHERE kind IN ('anonymous', 'working_tree') AND created_at < {NOW - 30 * 86400}
  AND id NOT IN (SELECT id FROM snapshots WHERE kind IN ('anonymous', 'working_tree') ORDER BY created_at DESC, id DESC LIMIT {KEEP}))"""))
def _(t):
    return collection.freed_by_snapshot(t.versions, collection.victims(t.snapshots, NOW, KEEP))


@query("j15_keyword_match", with_ctes("nodes", "SELECT id, k AS keyword FROM nodes, (VALUES ('fix'), ('small_ring'), ('hot')) w(k) WHERE contains(lower(name), k) OR contains(lower(qualified_name), k)"))
def _(t):
    words = F.array(*(F.lit(w) for w in context.task_keywords(t.nodes, TASK.text)))
    hit = F.filter(words, lambda w: F.contains(F.lower("name"), w) | F.contains(F.lower("qualified_name"), w))
    return t.nodes.select("id", F.explode(hit).alias("keyword"))


@query("j15_task_words", with_ctes("nodes customers tasks", "SELECT id, word, lower(name) = word AS whole FROM (SELECT DISTINCT word FROM task_words) JOIN nodes ON contains(lower(name), word) OR contains(lower(qualified_name), word)"))
def _(t):
    return keyword_match.matches(t.nodes, many_tasks.task_words(t.tasks("customer", "c_custkey")))


_EDGES = f"""
resolved AS ({_RESOLVED}),
known AS (SELECT o.from_identity AS src, r.to_name, r.target, r.reason, r.ord FROM resolved r JOIN
  (SELECT file_id, qualified_name, arg_max(identity, ord) AS from_identity FROM symbols GROUP BY ALL) o ON o.file_id = r.file_id AND o.qualified_name = r.from_qualified_name)"""


@query("j16_resolved_edges", with_ctes("refs symbols", "SELECT src, target AS dst, min(ord) AS ord FROM known WHERE target IS NOT NULL GROUP BY ALL", more=_EDGES))
def _(t):
    return resolver.resolve_edges(t.references, t.symbols)[0].select("src", "dst", "ord")


@query("j16_unresolved", with_ctes("refs symbols", "SELECT src, to_name, reason FROM known WHERE target IS NULL", more=_EDGES))
def _(t):
    return resolver.resolve_edges(t.references, t.symbols)[1].select("src", "to_name", "reason")


# ---- aggregates


@query("a1_latest_snapshot", with_ctes("snapshots", "SELECT max(id) AS latest, count(*) AS n FROM snapshots"))
def _(t):
    return t.snapshots.agg(F.max("id").alias("latest"), F.count("*").alias("n"))


@query("a3_events_by_kind", "SELECT event_type AS event_kind, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t.read("events").groupBy(F.col("event_type").alias("event_kind")).agg(F.count("*").alias("n"))


@query("a4_schema_version", "SELECT c_custkey AS project, coalesce(max(o_orderkey), 0)::BIGINT AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def _(t):
    migrations = t.read("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("version"))
    return statistics.latest_version(t.read("customer").select(F.col("c_custkey").alias("project")), migrations, "project")


@query("a5_running_mean", with_ctes("feedback", "SELECT identity_id, rn AS times_included, seen_at AS last_seen, m AS avg_score FROM r WHERE rn = n", recursive=True, more="""
ordered AS (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY identity_id) AS n FROM feedback),
r AS (SELECT identity_id, rn, n, seen_at, score AS m FROM ordered WHERE rn = 1 UNION ALL
  SELECT o.identity_id, o.rn, o.n, o.seen_at, (r.m * r.rn + o.score) // (r.rn + 1) FROM r JOIN ordered o ON o.identity_id = r.identity_id AND o.rn = r.rn + 1)"""))
def _(t):
    return feedback.usefulness(t.feedback)


@query("a6_name_index", with_ctes("nodes", "SELECT name, count(*) AS symbols, min(id) AS first_id, sum(id)::BIGINT AS id_sum FROM nodes GROUP BY name"))
def _(t):
    return t.nodes.groupBy("name").agg(F.count("*").alias("symbols"), F.min("id").alias("first_id"), F.sum("id").alias("id_sum"))


@query("a7_adjacency", with_ctes("bag", "SELECT src, count(*) AS calls, count(DISTINCT dst) AS callees, sum(dst)::BIGINT AS dst_sum FROM bag GROUP BY src"))
def _(t):
    pairs = t.bag.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.groupBy("src").agg(F.sum("n").alias("calls"), F.count("*").alias("callees"), F.sum(F.col("dst") * F.col("n")).alias("dst_sum"))


@query("a8_degrees", with_ctes("nodes bag", "SELECT n.id, (SELECT count(*) FROM bag WHERE dst = n.id) AS callers, (SELECT count(*) FROM bag WHERE src = n.id) AS callees FROM nodes n"))
def _(t):
    return graph.degrees(t.nodes, t.bag)


_ANCHORS = """
words AS (SELECT * FROM (VALUES ('fix'), ('small_ring'), ('hot')) w(k)),
anchors AS (SELECT id, max(CASE WHEN lower(name) = k THEN 1000 ELSE 600 END)::INTEGER AS anchor FROM nodes, words
  WHERE contains(lower(name), k) OR contains(lower(qualified_name), k) GROUP BY id)"""


@query("a9_anchor_scores", with_ctes("nodes", "SELECT id, anchor FROM anchors", more=_ANCHORS))
def _(t):
    return context.anchors(t.nodes, context.task_keywords(t.nodes, TASK.text))


_NEAR = _ANCHORS + """,
near AS (SELECT id, max(part)::INTEGER AS near FROM (SELECT dst AS id, anchor * 2 // 5 AS part FROM calls JOIN anchors ON anchors.id = src
  UNION ALL SELECT src, anchor * 2 // 5 FROM calls JOIN anchors ON anchors.id = dst) GROUP BY id)"""


@query("a10_proximity", with_ctes("nodes calls", "SELECT id, near FROM near", more=_NEAR))
def _(t):
    return context.proximity(context.anchors(t.nodes, context.task_keywords(t.nodes, TASK.text)), t.calls)


@query("a11_keep_first", "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def _(t):
    return dedup.keep_first(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber"])


@query("a13_keep_last", "SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) AS l_partkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def _(t):
    return dedup.keep_last(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber"])


@query("a12_dedup_edges", with_ctes("bag", "SELECT src, dst, count(*) AS repeats FROM bag GROUP BY src, dst"))
def _(t):
    return t.bag.groupBy("src", "dst").agg(F.count("*").alias("repeats"))


@query("a15_gc_report", with_ctes("versions snapshots", "SELECT (SELECT count(*) FROM victims) AS freed_snapshots, (SELECT count(*) FROM versions WHERE visible_from IN (FROM victims) OR visible_until IN (FROM victims)) AS freed_versions", more=f"""
victims AS (SELECT id FROM snapshots WHERE kind IN ('anonymous', 'working_tree') AND created_at < {NOW - 30 * 86400}
  AND id NOT IN (SELECT id FROM snapshots WHERE kind IN ('anonymous', 'working_tree') ORDER BY created_at DESC, id DESC LIMIT {KEEP}))"""))
def _(t):
    gone = collection.victims(t.snapshots, NOW, KEEP)
    return collection.report(t.snapshots, t.versions, gone)


@query("a16_p99", "SELECT event_type, (list_sort(list(event_id)))[count(*) * 99 // 100 + 1] AS p99 FROM events GROUP BY event_type")
def _(t):
    return statistics.disc_quantile(t.read("events"), "event_type", "event_id", 99, 100).select("event_type", F.col("value").alias("p99"))


# ---- windows, order, sets


@query("w2_gc_victims", with_ctes("snapshots", f"""SELECT id FROM snapshots WHERE kind IN ('anonymous', 'working_tree') AND created_at < {NOW - 30 * 86400}
  AND id NOT IN (SELECT id FROM snapshots WHERE kind IN ('anonymous', 'working_tree') ORDER BY created_at DESC, id DESC LIMIT {KEEP})"""))
def _(t):
    return collection.victims(t.snapshots, NOW, KEEP)


@query("w2_recency", with_ctes("snapshots", "SELECT id, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, id DESC)::INTEGER AS recency FROM snapshots"))
def _(t):
    return collection.newest_rank(t.snapshots).select("id", "recency")


@query("w4_interval_ends", with_ctes("versions", "SELECT identity, visible_from, lead(visible_from) OVER (PARTITION BY identity ORDER BY visible_from) AS visible_until FROM (SELECT DISTINCT identity, visible_from FROM versions)"))
def _(t):
    return visibility.interval_ends(t.versions.select("identity", "visible_from").distinct(), "identity")


@query("w5_as_of", with_ctes("versions", f"SELECT identity, max(struct_pack(visible_from, version)).visible_from AS visible_from, max(struct_pack(visible_from, version)).version AS version FROM versions WHERE visible_from <= {AT} GROUP BY identity"))
def _(t):
    return visibility.latest_before(t.versions.select("identity", "visible_from", "version"), "identity", AT, "version")


@query("o1_ranking", with_ctes("nodes uses", "SELECT n.id, row_number() OVER (ORDER BY coalesce(u.times_included, 0) DESC, qualified_name, n.id)::INTEGER AS rank FROM nodes n LEFT JOIN uses u ON u.id = n.id"))
def _(t):
    rows = t.nodes.join(t.uses, "id", "left").na.fill(0, ["times_included"]).select("id", "times_included", "qualified_name")
    return statistics.ranked(rows, F.desc("times_included"), "qualified_name", "id").select("id", F.col("rank").cast("int").alias("rank"))


@query("o3_top_anchors", with_ctes("nodes", "SELECT id, name FROM (SELECT a.id, n.name, row_number() OVER (ORDER BY anchor DESC, name, a.id) AS rn FROM anchors a JOIN nodes n ON n.id = a.id) WHERE rn <= 2", more=_ANCHORS))
def _(t):
    found = context.anchors(t.nodes, context.task_keywords(t.nodes, TASK.text)).join(t.nodes, "id")
    return found.orderBy(F.desc("anchor"), "name", "id").limit(2).select("id", "name")


_CANDIDATES = _NEAR + """,
scored AS (SELECT n.id, n.name, n.qualified_name, n.file_path, greatest(n.byte_len // 4, 16) AS cost, coalesce(a.anchor, 0) AS anchor, coalesce(p.near, 0) AS near,
    coalesce(u.times_included, 0) AS uses, n.file_path = 'Brand#2' AS cur, n.file_path IN ('Brand#3', 'Brand#4') AS dif
  FROM nodes n LEFT JOIN anchors a ON a.id = n.id LEFT JOIN near p ON p.id = n.id LEFT JOIN uses u ON u.id = n.id),
candidates AS (SELECT id, name, qualified_name, file_path, cost::BIGINT AS cost,
    least(greatest(anchor, near) + CASE WHEN cur THEN 250 ELSE 0 END + CASE WHEN dif THEN 250 ELSE 0 END + least(uses * 5, 100), 1000)::INTEGER AS score,
    concat_ws(' + ', CASE WHEN anchor = 1000 THEN 'exact name match' WHEN anchor > 0 THEN 'matches task token' END, CASE WHEN anchor = 0 AND near > 0 THEN 'near a task match' END,
      CASE WHEN cur THEN 'current file' END, CASE WHEN dif THEN 'diff overlap' END, CASE WHEN uses > 0 THEN 'previously useful' END) AS reason
  FROM scored WHERE greatest(anchor, near) + CASE WHEN cur THEN 250 ELSE 0 END + CASE WHEN dif THEN 250 ELSE 0 END > 0)"""
_PACKED = _CANDIDATES + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, qualified_name, id) AS rn FROM candidates),
pack AS (SELECT 0::BIGINT AS rn, 5000::BIGINT AS remaining, false AS kept UNION ALL
  SELECT r.rn, CASE WHEN r.cost <= p.remaining THEN p.remaining - r.cost ELSE p.remaining END, r.cost <= p.remaining FROM pack p JOIN ranked r ON r.rn = p.rn + 1)"""


@query("u1_candidates", with_ctes("nodes calls uses", "SELECT id, score, reason FROM candidates", more=_CANDIDATES))
def _(t):
    return context.candidates(t.nodes, t.calls, t.uses, TASK).select("id", "score", "reason")


@query("c1_context_plan", with_ctes("nodes calls uses", "SELECT r.id, r.name, r.qualified_name, r.file_path, r.score, r.reason, r.cost, p.kept FROM ranked r JOIN pack p ON p.rn = r.rn", recursive=True, more=_PACKED))
def _(t):
    return context.context_plan(t.nodes, t.calls, t.uses, TASK)


@query("o5_greedy_pack", with_ctes("nodes calls uses", "SELECT r.id, r.cost, row_number() OVER (ORDER BY r.rn)::INTEGER AS rank FROM ranked r JOIN pack p ON p.rn = r.rn WHERE p.kept", recursive=True, more=_PACKED))
def _(t):
    return context.pack_rows(context.context_plan(t.nodes, t.calls, t.uses, TASK)).select("id", "cost", "rank")


@query("o5_pack_budgets", with_ctes("nodes calls uses", """SELECT p.budget, r.id, row_number() OVER (PARTITION BY p.budget ORDER BY r.rn)::INTEGER AS rank FROM ranked r JOIN packs p ON p.rn = r.rn WHERE p.kept""", recursive=True, more=_CANDIDATES + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, qualified_name, id) AS rn FROM candidates),
packs AS (SELECT DISTINCT 0::BIGINT AS rn, p_size::BIGINT * 100 AS budget, p_size::BIGINT * 100 AS remaining, false AS kept FROM part UNION ALL
  SELECT r.rn, p.budget, CASE WHEN r.cost <= p.remaining THEN p.remaining - r.cost ELSE p.remaining END, r.cost <= p.remaining FROM packs p JOIN ranked r ON r.rn = p.rn + 1)"""))
def _(t):
    found = context.candidates(t.nodes, t.calls, t.uses, TASK).withColumn("task", F.lit("one"))
    budgets = t.read("part").select(F.lit("one").alias("task"), (F.col("p_size") * 100).alias("budget")).distinct()
    return packing.pack(found, budgets).select("budget", "id", "rank")


@query("a9_task_anchors", with_ctes("nodes customers tasks", "SELECT task, id, anchor FROM task_anchors"))
def _(t):
    return many_tasks.anchors(t.tasks("customer", "c_custkey"), t.nodes)


_MANY = """
near AS (SELECT task, id, max(part)::INTEGER AS near FROM (SELECT task, dst AS id, anchor * 2 // 5 AS part FROM calls JOIN task_anchors a ON a.id = src
  UNION ALL SELECT task, src, anchor * 2 // 5 FROM calls JOIN task_anchors a ON a.id = dst) GROUP BY ALL),
scored AS (SELECT t.task, t.budget, n.id, n.name, n.qualified_name, n.file_path, greatest(n.byte_len // 4, 16) AS cost, coalesce(a.anchor, 0) AS anchor, coalesce(p.near, 0) AS near,
    coalesce(u.times_included, 0) AS uses, coalesce(n.file_path = t.current_file, false) AS cur, list_contains(t.changed_files, n.file_path) AS dif
  FROM tasks t CROSS JOIN nodes n LEFT JOIN task_anchors a ON a.id = n.id AND a.task = t.task LEFT JOIN near p ON p.id = n.id AND p.task = t.task LEFT JOIN uses u ON u.id = n.id),
candidates AS (SELECT task, budget, id, name, qualified_name, file_path, cost::BIGINT AS cost,
    least(greatest(anchor, near) + CASE WHEN cur THEN 250 ELSE 0 END + CASE WHEN dif THEN 250 ELSE 0 END + least(uses * 5, 100), 1000)::INTEGER AS score,
    concat_ws(' + ', CASE WHEN anchor = 1000 THEN 'exact name match' WHEN anchor > 0 THEN 'matches task token' END, CASE WHEN anchor = 0 AND near > 0 THEN 'near a task match' END,
      CASE WHEN cur THEN 'current file' END, CASE WHEN dif THEN 'diff overlap' END, CASE WHEN uses > 0 THEN 'previously useful' END) AS reason
  FROM scored WHERE greatest(anchor, near) + CASE WHEN cur THEN 250 ELSE 0 END + CASE WHEN dif THEN 250 ELSE 0 END > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, qualified_name, id) AS rn FROM candidates),
pack AS (SELECT task, 0::BIGINT AS rn, CASE WHEN budget > 0 THEN budget ELSE 5000 END::BIGINT AS remaining, false AS kept FROM tasks UNION ALL
  SELECT r.task, r.rn, CASE WHEN r.cost <= p.remaining THEN p.remaining - r.cost ELSE p.remaining END, r.cost <= p.remaining FROM pack p JOIN ranked r ON r.task = p.task AND r.rn = p.rn + 1)"""


@query("c1_task_plans", with_ctes("nodes calls uses suppliers tasks", """SELECT r.task, r.id, r.name, r.qualified_name, r.file_path, r.score, r.reason, r.cost, p.kept,
  CASE WHEN p.kept THEN row_number() OVER (PARTITION BY r.task, p.kept ORDER BY r.rn) END::INTEGER AS rank FROM ranked r JOIN pack p ON p.task = r.task AND p.rn = r.rn""", recursive=True, more=_MANY))
def _(t):
    return many_tasks.context_plans(t.tasks("supplier", "s_suppkey"), t.nodes, t.calls, t.uses)


@query("a14_pack_budget", with_ctes("nodes calls uses", "SELECT 5000::BIGINT AS requested, sum(CASE WHEN p.kept THEN r.cost ELSE 0 END)::BIGINT AS estimated, count(*) FILTER (p.kept) AS items, count(*) FILTER (NOT p.kept) AS omitted FROM ranked r JOIN pack p ON p.rn = r.rn", recursive=True, more=_PACKED))
def _(t):
    return context.pack_budget(context.context_plan(t.nodes, t.calls, t.uses, TASK), TASK)


@query("c1_omitted", with_ctes("nodes calls uses", "SELECT r.id, r.file_path, 'token budget' AS reason FROM ranked r JOIN pack p ON p.rn = r.rn WHERE NOT p.kept", recursive=True, more=_PACKED))
def _(t):
    return context.omitted(context.context_plan(t.nodes, t.calls, t.uses, TASK)).select("id", "file_path", "reason")


@query("c2_feedback_after_pack", with_ctes("nodes calls uses", "SELECT u.id, (coalesce(a.times_included, 0) + CASE WHEN k.id IS NULL THEN 0 ELSE 1 END)::BIGINT AS times_included FROM (SELECT id FROM uses UNION SELECT r.id FROM ranked r JOIN pack p ON p.rn = r.rn WHERE p.kept) u LEFT JOIN uses a ON a.id = u.id LEFT JOIN (SELECT r.id FROM ranked r JOIN pack p ON p.rn = r.rn WHERE p.kept) k ON k.id = u.id", recursive=True, more=_PACKED))
def _(t):
    packed = context.pack_rows(context.context_plan(t.nodes, t.calls, t.uses, TASK))
    return feedback.with_inclusions(t.uses, packed.select("id"))


@query("f17_summary", with_ctes("nodes calls uses", """SELECT 'Found ' || (SELECT count(*) FROM ranked r JOIN pack p ON p.rn = r.rn WHERE p.kept) || ' candidate(s) anchored on ' || string_agg(name, ', ' ORDER BY anchor DESC, name) || '.' AS summary
  FROM (SELECT n.name, a.anchor FROM anchors a JOIN nodes n ON n.id = a.id ORDER BY a.anchor DESC, n.name LIMIT 2)""", recursive=True, more=_PACKED))
def _(t):
    return context.summary_row(context.context_plan(t.nodes, t.calls, t.uses, TASK), t.nodes, TASK)


@query("u5_set_difference", with_ctes("nodes calls", "SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM calls WHERE src IN (SELECT id FROM nodes WHERE file_path = 'Brand#2'))"))
def _(t):
    called = t.calls.join(t.nodes.where("file_path = 'Brand#2'").select(F.col("id").alias("src")), "src", "left_semi")
    return changes.difference(t.nodes.select("id"), called.select(F.col("dst").alias("id")), ["id"])


@query("u7_snapshot_diff", with_ctes("versions", f"""SELECT identity, version, CASE WHEN h THEN 'added' ELSE 'removed' END AS change FROM (SELECT identity, version,
  bool_or(visible_from <= {AT} AND (visible_until IS NULL OR visible_until > {AT})) AS b, bool_or(visible_from <= {AT + 6} AND (visible_until IS NULL OR visible_until > {AT + 6})) AS h FROM versions GROUP BY ALL) WHERE b <> h"""))
def _(t):
    return visibility.snapshot_diff(t.versions, AT, AT + 6, ["identity", "version"])


# ---- graph walks


def _most_called(t: Tables) -> DataFrame:
    return t.calls.groupBy(F.col("dst").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


_REACH = """
start AS (SELECT dst AS id FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
walk AS (SELECT id, 0 AS depth FROM start UNION SELECT s.src, w.depth + 1 FROM walk w JOIN calls s ON s.dst = w.id WHERE w.depth < 3),
reach AS (SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id HAVING min(depth) > 0)"""


@query("g3_reverse_reach", with_ctes("calls", "SELECT id, depth FROM reach", recursive=True, more=_REACH))
def _(t):
    return graph.reverse_reach(t.calls, _most_called(t), 3)


@query("g4_impact", with_ctes("nodes calls", """SELECT file_path, count(*) AS symbols, min(depth) AS nearest, sum(CASE WHEN contains(lower(name), 'test') OR contains(lower(file_path), 'test') THEN 1 ELSE 0 END)::BIGINT AS tests
  FROM reach JOIN (SELECT id, name, CASE WHEN kind LIKE 'PROMO%' THEN 'tests/' ELSE '' END || file_path AS file_path FROM nodes) USING (id) GROUP BY file_path""", recursive=True, more=_REACH))
def _(t):
    path = F.concat(F.when(F.startswith("kind", F.lit("PROMO")), F.lit("tests/")).otherwise(F.lit("")), "file_path")
    return graph.impact(t.nodes.withColumn("file_path", path), t.calls, _most_called(t), 3)


@query("g3_reach_of_each", with_ctes("nodes calls", """SELECT start, count(*) FILTER (depth = 1) AS direct, count(*) AS reached, sum(id * depth)::BIGINT AS checksum FROM (
  SELECT start, id, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0) GROUP BY start""", recursive=True, more="""
walk AS (SELECT id AS start, id, 0 AS depth FROM nodes UNION SELECT w.start, s.src, w.depth + 1 FROM walk w JOIN calls s ON s.dst = w.id WHERE w.depth < 2)"""))
def _(t):
    direct = F.count(F.when(F.col("depth") == 1, 1)).alias("direct")
    totals = [direct, F.count("*").alias("reached"), F.sum(F.col("id") * F.col("depth")).alias("checksum")]
    return graph.reverse_reach_totals(t.calls, t.nodes.select(F.col("id").alias("group"), "id"), 2, *totals).withColumnRenamed("group", "start")


@query("g4_impact_of_files", with_ctes("nodes calls", """SELECT changed, file_path, count(*) AS symbols, min(depth)::INTEGER AS nearest, sum(CASE WHEN contains(lower(name), 'test') OR contains(lower(file_path), 'test') THEN 1 ELSE 0 END)::BIGINT AS tests
  FROM (SELECT changed, id, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0) JOIN nodes USING (id) GROUP BY changed, file_path""", recursive=True, more="""
walk AS (SELECT file_path AS changed, id, 0 AS depth FROM nodes UNION SELECT w.changed, s.src, w.depth + 1 FROM walk w JOIN calls s ON s.dst = w.id WHERE w.depth < 2)"""))
def _(t):
    starts = t.nodes.select(F.col("file_path").alias("group"), "id")
    return graph.impact_of_each(t.nodes, t.calls, starts, 2).withColumnRenamed("group", "changed")


@query("g5_explain", with_ctes("nodes calls versions", f"""SELECT file_path, count(*) AS symbols, min(depth) AS nearest FROM reach JOIN nodes USING (id) GROUP BY file_path""", recursive=True, more=f"""
changed AS (SELECT identity AS id FROM (SELECT identity, version, bool_or(visible_from <= {AT} AND (visible_until IS NULL OR visible_until > {AT})) AS b,
  bool_or(visible_from <= {AT + 1} AND (visible_until IS NULL OR visible_until > {AT + 1})) AS h FROM versions GROUP BY ALL) WHERE b <> h GROUP BY identity),
walk AS (SELECT id, 0 AS depth FROM changed UNION SELECT s.src, w.depth + 1 FROM walk w JOIN calls s ON s.dst = w.id WHERE w.depth < 2),
reach AS (SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id HAVING min(depth) > 0)"""))
def _(t):
    changed, reached = graph.explained(t.nodes, t.calls, visibility.snapshot_diff(t.versions, AT, AT + 1, ["identity", "version"]), "identity", 2)
    return reached.select("file_path", "symbols", "nearest")


@query("g1_graph_at_snapshot", with_ctes("nodes versions edges", f"""SELECT id, any_value(name) AS name, max(version) AS version, coalesce(any_value(e.n), 0)::BIGINT AS edges
  FROM versions JOIN nodes ON identity = id LEFT JOIN (SELECT src, count(*) AS n FROM edges WHERE kind = 'Calls' AND visible_from <= {AT} AND (visible_until IS NULL OR visible_until > {AT}) GROUP BY src) e ON e.src = id
  WHERE visible_from <= {AT} AND (visible_until IS NULL OR visible_until > {AT}) GROUP BY id"""))
def _(t):
    nodes, edges = graph.at_snapshot(t.versions, t.nodes, t.edge_versions.withColumn("kind", schemas.edge_kind_number(F.col("kind"))), AT)
    own = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"))
    newest = nodes.groupBy("id", "name").agg(F.max("version").alias("version"))
    return newest.join(own, "id", "left").na.fill(0, ["edges"]).select("id", "name", "version", "edges")


@query("g6_trace", with_ctes("nodes bag", f"SELECT *, 'callers' AS direction FROM ({_relation_sql('dst', 'src')}) UNION ALL SELECT *, 'callees' FROM ({_relation_sql('src', 'dst')})"))
def _(t):
    return graph.trace(t.nodes, t.bag, "small_ring")


@query("g6_trace_directions", with_ctes("nodes bag", f"""SELECT asked, match_id, count(*) AS n FROM (SELECT 'callers' AS asked, * FROM ({_relation_sql('dst', 'src')}) UNION ALL SELECT 'callees', * FROM ({_relation_sql('src', 'dst')})
  UNION ALL SELECT 'both', * FROM ({_relation_sql('dst', 'src')}) UNION ALL SELECT 'both', * FROM ({_relation_sql('src', 'dst')})) GROUP BY ALL"""))
def _(t):
    parts = [graph.trace(t.nodes, t.bag, "small_ring", d).select(F.lit(d).alias("asked"), "match_id") for d in ("callers", "callees", "both", "sideways")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.groupBy("asked", "match_id").agg(F.count("*").alias("n"))


# ---- scalar functions


@query("f1_keywords", r"""SELECT doc_id, unnest(list_distinct_ordered) AS keyword FROM (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered
  FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda x: strlen(x) >= 3), lambda x: lower(x)) AS w FROM documents))""")
def _(t):
    return t.read("documents").select("doc_id", F.explode(keywords(F.col("text"))).alias("keyword"))


@query("f3_last_segment", "SELECT p_partkey, replace(p_name, ' ', '_') AS rust_segment, string_split(p_name, ' ')[-1] AS ts_segment FROM part")
def _(t):
    rust = qualify(F.array("p_brand", "p_type"), F.replace("p_name", F.lit(" "), F.lit("_")))
    typescript = F.concat_ws(".", "p_brand", F.replace("p_name", F.lit(" "), F.lit(":")))
    return t.read("part").select("p_partkey", last_segment(rust, F.lit("rust")).alias("rust_segment"), last_segment(typescript, F.lit("typescript")).alias("ts_segment"))


@query("f5_symbol_ids", """SELECT p_partkey, substr(sha256(unhex(project) || '\\x00'::BLOB || encode(p_brand) || '\\x00'::BLOB || encode(p_name) || '\\x00'::BLOB || unhex('01')), 1, 32) AS symbol_id
  FROM part, (SELECT substr(sha256('project'), 1, 32) AS project)""")
def _(t):
    project = ids.project_id(F.lit("project"))
    return t.read("part").select("p_partkey", ids.symbol_id(project, F.col("p_brand"), F.col("p_name"), F.lit(1)).alias("symbol_id"))


@query("f5_file_and_version_ids", """SELECT p_partkey, project, substr(sha256(unhex(project) || '\\x00'::BLOB || encode(p_name)), 1, 32) AS file,
  substr(sha256(unhex(project) || '\\x00'::BLOB || unhex(sha256(p_type))), 1, 32) AS version, substr(project, 1, 8) AS short FROM (SELECT *, substr(sha256(p_brand), 1, 32) AS project FROM part)""")
def _(t):
    rows = t.read("part").withColumn("project", ids.project_id(F.col("p_brand")))
    version = ids.symbol_version_id(F.col("project"), ids.content_hash(F.col("p_type")))
    return rows.select("p_partkey", ids.checked(F.col("project")).alias("project"), ids.file_id(F.col("project"), F.col("p_name")).alias("file"), version.alias("version"), ids.short_id(F.col("project")).alias("short"))


@query("f24_memory_kinds", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'semantic' WHEN '2-HIGH' THEN 'semantic' WHEN '3-MEDIUM' THEN 'episodic' WHEN '4-NOT SPECIFIED' THEN 'procedural' ELSE 'working' END AS memory_group,
  o_orderpriority <> '5-LOW' AS persistent FROM orders""")
def _(t):
    names = dict(zip(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], schemas.MEMORY_GROUPS))
    kind = F.coalesce(*(F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in names.items()))
    return t.read("orders").select("o_orderkey", schemas.memory_group(kind).alias("memory_group"), schemas.is_persistent(kind).alias("persistent"))


@query("f6_content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def _(t):
    return t.read("documents").select("doc_id", ids.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


_KIND_LABELS = {"o_orderstatus": {"F": "Function", "O": "Trait", "P": "Gadget"}, "o_orderpriority": {"1-URGENT": "Imports", "2-HIGH": "Contains", "3-MEDIUM": "Implements", "4-NOT SPECIFIED": "FileDepends"}}


@query("f8_kind_numbers", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 5 ELSE 99 END::INTEGER AS symbol_kind,
  CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 5 ELSE 1 END::INTEGER AS edge_kind,
  CASE o_orderstatus WHEN 'F' THEN 'Function' WHEN 'O' THEN 'Trait' ELSE 'Other' END AS kind_name FROM orders""")
def _(t):
    label = lambda c: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in _KIND_LABELS[c].items()), F.lit("?"))
    rows = t.read("orders").select("o_orderkey", schemas.symbol_kind_number(label("o_orderstatus")).alias("symbol_kind"), schemas.edge_kind_number(label("o_orderpriority")).alias("edge_kind"))
    return rows.withColumn("kind_name", schemas.symbol_kind_name(F.col("symbol_kind")))


@query("f11_token_cost", with_ctes("nodes", "SELECT id, greatest(byte_len // 4, 16)::BIGINT AS cost FROM nodes"))
def _(t):
    return t.nodes.select("id", token_cost(F.col("byte_len")).alias("cost"))


@query("f22_payloads", "SELECT event_id, json_object('event_type', event_type, 'user_id', user_id)::VARCHAR AS payload FROM events")
def _(t):
    return t.read("events").select("event_id", payload(event_type=F.col("event_type"), user_id=F.col("user_id")).alias("payload"))


@query("f23_json_payload", "SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::BIGINT AS missing FROM events")
def _(t):
    fields = parsed(F.col("props"), "k string, missing bigint")
    return t.read("events").select("event_id", fields["k"].alias("k"), fields["missing"].alias("missing"))


@query("f19_confidence", "SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal::DOUBLE / 5000)) AS confidence FROM customer")
def _(t):
    return t.read("customer").select("c_custkey", confidence(F.col("c_acctbal").cast("double") / 5000).alias("confidence"))


@query("f21_snapshot_uuids", with_ctes("snapshots", "SELECT id, lpad(lower(to_hex(created_at * 1000)), 32, '0') || lpad(lower(to_hex(id)), 16, '0') AS uuid FROM snapshots"))
def _(t):
    return t.snapshots.select("id", ids.snapshot_uuid(F.col("created_at") * 1000, F.col("id")).alias("uuid"))


@query("s10_usefulness", "SELECT s_suppkey AS identity_id, greatest(0, trunc(s_acctbal)::BIGINT)::BIGINT AS times_included, greatest(0, trunc(-s_acctbal)::BIGINT)::BIGINT AS avg_score FROM supplier")
def _(t):
    rows = t.read("supplier").select(F.col("s_suppkey").alias("identity_id"), F.col("s_acctbal").cast("long").alias("times_included"), (-F.col("s_acctbal")).cast("long").alias("avg_score"))
    return feedback.clamped(rows)


# Paths of every case: folders of which some are ignored, at the top or deeper, and endings of which some are supported.
_TOPS = {"STANDARD": "src", "SMALL": "lib/target", "MEDIUM": "node_modules", "LARGE": "build", "ECONOMY": "dist.d", "PROMO": "target"}
_ENDS = {"plate": "rs", "widget": "tsx", "ring": "RS", "rod": "mjs"}


def _case(words: dict[str, str], part: str) -> str:
    return f"CASE {part} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " ELSE 'x' END"


_PATHS = f"paths AS (SELECT p_partkey AS id, {_case(_TOPS, 'p_type')} || '/' || replace(p_name, ' ', '_') || '.' || {_case(_ENDS, 'string_split(p_name, chr(32))[-1]')} AS path FROM part)"


@query("s1_tree_paths", f"""WITH {_PATHS} SELECT id, path, CASE WHEN path LIKE '%.rs' THEN 'rust' ELSE 'typescript' END AS language FROM paths
  WHERE string_split(path, '/')[1] NOT IN ('node_modules', 'build', 'target') AND (path LIKE '%.rs' OR path LIKE '%.tsx' OR path LIKE '%.mjs')""")
def _(t):
    pick = lambda names, word: F.coalesce(*(F.when(word == k, F.lit(v)) for k, v in names.items()), F.lit("x"))
    found = F.concat(F.lit("file:///w/tree/"), pick(_TOPS, F.col("p_type")), F.lit("\\"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), pick(_ENDS, F.element_at(F.split("p_name", " "), -1)))
    rows = t.read("part").select(F.col("p_partkey").alias("id"), tree.relative(found, "/w/tree").alias("path"))
    rows = rows.withColumn("language", tree.language_of(F.col("path")))
    return rows.where(F.col("language").isNotNull() & ~tree.is_ignored(F.col("path")))


# ---- writes as sets, collection, overlay state


@query("d1_upsert", "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS language FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal < 0")
def _(t):
    own = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("language"), "c_acctbal")
    new = own.where("c_acctbal < 0").withColumn("language", F.concat(F.upper("language"), F.lit("!")))
    return changes.upsert(own.where("language <> 'BUILDING'").select("id", "language"), new, ["id"])


@query("d7_meta", "SELECT c_mktsegment AS key, arg_max(c_name, c_custkey) AS value FROM customer GROUP BY c_mktsegment")
def _(t):
    written = t.read("customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("at"))
    return changes.last_values(written, "key", "value", "at")


@query("d4_close_versions", with_ctes("versions nodes", f"SELECT identity, version, CASE WHEN visible_until IS NULL AND identity IN (SELECT id FROM nodes WHERE start_line <= 15) THEN {AT + 100} ELSE visible_until END AS visible_until FROM versions"))
def _(t):
    changed = t.nodes.where("start_line <= 15").select(F.col("id").alias("identity"))
    return changes.close_versions(t.versions, changed, ["identity"], AT + 100).select("identity", "version", "visible_until")


@query("d10_surviving_versions", with_ctes("versions snapshots", "SELECT identity, version, visible_from, visible_until FROM versions WHERE visible_from NOT IN (FROM victims) AND (visible_until IS NULL OR visible_until NOT IN (FROM victims))", more=f"""
victims AS (SELECT id FROM snapshots WHERE kind IN ('anonymous', 'working_tree') AND created_at < {NOW - 30 * 86400}
  AND id NOT IN (SELECT id FROM snapshots WHERE kind IN ('anonymous', 'working_tree') ORDER BY created_at DESC, id DESC LIMIT {KEEP}))"""))
def _(t):
    gone = collection.victims(t.snapshots, NOW, KEEP)
    return collection.surviving_versions(t.versions, gone).select("identity", "version", "visible_from", "visible_until")


@query("x2_debounce_sessions", """SELECT user_id, min(ts) AS session_start, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def _(t):
    changed = t.read("events").select(F.col("user_id").alias("root"), F.col("ts").alias("at"), F.col("event_type").alias("path"))
    return overlay_state.debounced(changed, "2 hours").select(F.col("root").alias("user_id"), F.col("started").alias("session_start"), F.col("changes").alias("n"), F.array_join("paths", ",").alias("paths"))


@query("x4_dirty_paths", "SELECT user_id AS path, arg_max(event_type, (ts, event_id)) AS content FROM events GROUP BY user_id")
def _(t):
    changes_ = t.read("events").select(F.col("user_id").alias("path"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
    return overlay_state.latest(changes_).select("path", "content")
