"""Graph tables derived from the star schema, so that every operator runs on given data of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Reads tables of a folder and derives nodes, calls, versions, snapshots, references and events."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        name = F.replace("p_name", F.lit(" "), F.lit("_"))
        return self.read("part").select(
            F.col("p_partkey").alias("id"),
            name.alias("name"),
            F.concat("p_brand", F.lit("::"), name).alias("qualified_name"),
            F.col("p_brand").alias("file_path"),
            F.col("p_type").alias("kind"),
            F.col("p_size").alias("start_line"),
            (F.col("p_size") * 40).cast("long").alias("byte_len"),
        )

    @property
    def bag(self) -> DataFrame:
        """Calls with repeats: consecutive lines of an order."""
        lines = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
        return lines.join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst")

    @property
    def calls(self) -> DataFrame:
        return self.bag.distinct()

    @property
    def closed_calls(self) -> DataFrame:
        """Calls between finished lines."""
        lines = self.read("lineitem").where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", "l_partkey")
        after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
        return lines.join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst").distinct()

    @property
    def edge_versions(self) -> DataFrame:
        """(src, dst, kind, visible_from, visible_until): from a part to its supplier, of a kind by the line's return flag."""
        kind = F.when(F.col("l_returnflag") == "A", "Calls").when(F.col("l_returnflag") == "N", "Imports").otherwise("Implements")
        month = lambda c: (F.year(c) * 12 + F.month(c)).cast("long")
        ends = F.when(F.col("l_linestatus") == "F", month(F.col("l_shipdate")) + 6)
        return self.read("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), kind.alias("kind"), month(F.col("l_shipdate")).alias("visible_from"), ends.alias("visible_until"))

    @property
    def versions(self) -> DataFrame:
        month = lambda c: (F.year(c) * 12 + F.month(c)).cast("long")
        orders = self.read("orders").select("o_orderkey", month(F.col("o_orderdate")).alias("visible_from"))
        lines = self.read("lineitem").select("l_orderkey", F.col("l_partkey").alias("identity"), "l_linenumber", F.when(F.col("l_linestatus") == "F", month(F.col("l_shipdate")) + 1).alias("visible_until"))
        joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        return joined.where("visible_until IS NULL OR visible_from < visible_until").select("identity", F.col("l_orderkey").alias("version"), F.col("l_linenumber").alias("part_no"), "visible_from", "visible_until")

    @property
    def snapshots(self) -> DataFrame:
        month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
        ids = self.read("orders").select(month.alias("id")).distinct()
        kind = F.when(F.col("id") % 4 == 0, "anonymous").when(F.col("id") % 4 == 1, "working_tree").when(F.col("id") % 4 == 2, "commit").otherwise("filehash")
        return ids.select("id", kind.alias("kind"), (F.col("id") * 2592000).alias("created_at"), (F.col("id") - 1).alias("parent_id"))

    @property
    def symbols(self) -> DataFrame:
        """Parts, whose names repeat within and across files, and suppliers, whose names are unique."""
        parts = self.nodes.select(F.col("id").alias("identity"), F.col("file_path").alias("file_id"), "qualified_name", "name", F.col("id").alias("ord"))
        number = -F.col("s_suppkey")
        return parts.unionAll(self.read("supplier").select(number.alias("identity"), F.lit("suppliers").alias("file_id"), F.concat(F.lit("suppliers::"), "s_name").alias("qualified_name"), F.col("s_name").alias("name"), number.alias("ord")))

    @property
    def references(self) -> DataFrame:
        """From parts: to what they call, to their suppliers, and to their types, which are no symbols."""
        n = self.nodes
        a = n.select(F.col("id").alias("src"), F.col("file_path").alias("file_id"), F.col("qualified_name").alias("from_qualified_name"), "kind")
        b = n.select(F.col("id").alias("dst"), F.col("name").alias("to_name"))
        calls = self.calls.join(b, "dst").select("src", "to_name", (F.col("src") * 1000000 + F.col("dst")).alias("ord"))
        bought = self.read("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("s_suppkey")).distinct()
        supplied = bought.join(self.read("supplier").select("s_suppkey", "s_name"), "s_suppkey").select("src", F.col("s_name").alias("to_name"), (-(F.col("src") * 1000000 + F.col("s_suppkey"))).alias("ord"))
        typed = a.select("src", F.col("kind").alias("to_name"), (F.col("src") * 1000000).alias("ord"))
        return calls.unionAll(supplied).unionAll(typed).join(a.drop("kind"), "src").select("file_id", "from_qualified_name", "to_name", F.lit(1).alias("kind"), "ord")

    @property
    def feedback(self) -> DataFrame:
        score = F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(F.col("value") * 10))).cast("long")
        return self.read("events").select(F.col("user_id").alias("identity_id"), F.col("event_id").alias("seq"), score.alias("score"), F.unix_timestamp("ts").alias("seen_at"))

    @property
    def uses(self) -> DataFrame:
        return self.read("events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("times_included"))

    def tasks(self, owner: str, key: str) -> DataFrame:
        """A task for each row of a table, about the part of its number and two files; budgets differ."""
        n = self.nodes.select("id", "name", "file_path")
        own = self.read(owner).select(F.col(key).alias("task"))
        after = n.select((F.col("id") - 1).alias("task"), F.col("file_path").alias("next_file"))
        rows = own.join(n, F.col("task") == F.col("id")).join(after, "task", "left")
        text = F.concat(F.lit("Mend "), F.upper("name"), F.lit(" (#"), F.col("task").cast("string"), F.lit(")"))
        files = F.when(F.col("next_file").isNotNull(), F.array("next_file", "file_path")).otherwise(F.array())
        return rows.select("task", text.alias("text"), F.when(F.col("task") % 2 == 0, F.col("file_path")).alias("current_file"), F.when(F.col("task") % 3 == 0, files).otherwise(F.array()).alias("changed_files"), (F.col("task") % 7 * 400).alias("budget"))


CTES = {
    "nodes": """nodes AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, p_brand || '::' || replace(p_name, ' ', '_') AS qualified_name,
  p_brand AS file_path, p_type AS kind, p_size AS start_line, (p_size * 40)::BIGINT AS byte_len FROM part)""",
    "bag": """bag AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)""",
    "calls": "calls AS (SELECT DISTINCT src, dst FROM bag)",
    "closed": """closed AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey AND a.l_linestatus = 'F' AND b.l_linestatus = 'F')""",
    "edges": """edges AS (SELECT l_partkey AS src, l_suppkey AS dst, CASE l_returnflag WHEN 'A' THEN 'Calls' WHEN 'N' THEN 'Imports' ELSE 'Implements' END AS kind,
  (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS visible_from, CASE WHEN l_linestatus = 'F' THEN (year(l_shipdate) * 12 + month(l_shipdate) + 6)::BIGINT END AS visible_until FROM lineitem)""",
    "versions": """versions AS (SELECT l_partkey AS identity, l_orderkey AS version, l_linenumber AS part_no,
  (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS visible_from,
  CASE WHEN l_linestatus = 'F' THEN (year(l_shipdate) * 12 + month(l_shipdate) + 1)::BIGINT END AS visible_until
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_linestatus <> 'F' OR year(o_orderdate) * 12 + month(o_orderdate) < year(l_shipdate) * 12 + month(l_shipdate) + 1)""",
    "snapshots": """snapshots AS (SELECT id, CASE id % 4 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'working_tree' WHEN 2 THEN 'commit' ELSE 'filehash' END AS kind,
  id * 2592000 AS created_at, id - 1 AS parent_id FROM (SELECT DISTINCT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS id FROM orders))""",
    "symbols": """symbols AS (SELECT id AS identity, file_path AS file_id, qualified_name, name, id AS ord FROM nodes
  UNION ALL SELECT -s_suppkey, 'suppliers', 'suppliers::' || s_name, s_name, -s_suppkey FROM supplier)""",
    "refs": """refs AS (SELECT a.file_path AS file_id, a.qualified_name AS from_qualified_name, r.to_name, 1 AS kind, r.ord FROM nodes a JOIN (
  SELECT c.src, b.name AS to_name, c.src * 1000000 + b.id AS ord FROM calls c JOIN nodes b ON b.id = c.dst
  UNION ALL SELECT l.src, s_name, -(l.src * 1000000 + s_suppkey) FROM (SELECT DISTINCT l_partkey AS src, l_suppkey FROM lineitem) l JOIN supplier ON s_suppkey = l.l_suppkey
  UNION ALL SELECT id, kind, id * 1000000 FROM nodes) r ON r.src = a.id)""",
    "feedback": """feedback AS (SELECT user_id AS identity_id, event_id AS seq, greatest(0, least(1000, floor(value * 10)))::BIGINT AS score,
  floor(epoch(ts))::BIGINT AS seen_at FROM events)""",
    "tasks": r"""tasks AS (SELECT k AS task, 'Mend ' || upper(n.name) || ' (#' || k || ')' AS text, CASE WHEN k % 2 = 0 THEN n.file_path END AS current_file,
  CASE WHEN k % 3 = 0 AND m.id IS NOT NULL THEN [m.file_path, n.file_path] ELSE [] END AS changed_files, k % 7 * 400 AS budget FROM owners JOIN nodes n ON n.id = k LEFT JOIN nodes m ON m.id = k + 1),
task_words AS (SELECT DISTINCT task, lower(w) AS word FROM (SELECT task, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}_]+')) AS w FROM tasks) WHERE strlen(w) >= 3),
task_anchors AS (SELECT task, id, max(CASE WHEN lower(name) = word THEN 1000 ELSE 600 END)::INTEGER AS anchor FROM task_words JOIN nodes ON contains(lower(name), word) OR contains(lower(qualified_name), word) GROUP BY ALL)""",
    "customers": "owners AS (SELECT c_custkey AS k FROM customer)",
    "suppliers": "owners AS (SELECT s_suppkey AS k FROM supplier)",
    "uses": "uses AS (SELECT user_id AS id, count(*) AS times_included FROM events GROUP BY user_id)",
}
NEEDS = {"calls": ["bag"], "symbols": ["nodes"], "refs": ["nodes", "bag", "calls"], "tasks": ["nodes"]}


def with_ctes(names: str, body: str, recursive: bool = False, more: str = "") -> str:
    """DuckDB SQL with these stand-in tables in front."""
    order: list[str] = []
    for name in names.split():
        for need in [*NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    parts = [CTES[n] for n in order] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body

