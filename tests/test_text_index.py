"""The trigram index finds what a scan finds, and reads only its needle's lists."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, text_index

NODES = "id long, name string, qualified_name string, gram string"


def names(rng, n):
    parts = ["parse", "Parser", "für", "x_", "%", "日本語", "🤗🤗", "a.b", "İ", "ss", "aaa", "\\d"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 6))), rng.choice([None, "mod::" + rng.choice(parts)]), "g") for i in range(n)]
    return rows + [(None, "parser for no id", None, "g"), (3, "repeated id parse", "q", "g"), (n, None, None, "g"), (n + 1, "", "", "g"), (n + 2, "long " * 3000 + "needle at the end", "", "g")]


@pytest.fixture(scope="module")
def table(spark):
    rows = names(random.Random(2), 300)
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    return rows, nodes, text_index.TextIndex.build(nodes, ["name", "qualified_name"])


def found(df):
    return sorted(map(str, df.collect()))


def test_same_as_the_scan(table):
    rows, nodes, index = table
    for needle in ["PARSERX", "rserfü", "🤗🤗🤗", "語🤗", "%", "", "aaaaaaaaaaaaa", "no id", "needle at the end", "x_%"]:
        assert found(index.search(needle)) == found(graph.search(nodes, needle)), needle


def test_plan_reads_the_lists_of_the_needle(table):
    index = table[2]
    plan = index.search("needle at")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "postings" in line or "FileScan parquet" in line and "gram" in line]
    assert len(scans) == text_index.RAREST
    for line in scans:
        assert "PartitionFilters: [isnotnull(bucket" in line and "EqualTo(gram," in line and "GreaterThanOrEqual(pos," in line
    assert "FileScan" not in index.search("no such gram: qqq")._jdf.queryExecution().executedPlan().toString()


def test_many_needles_at_once(spark, table):
    rows, nodes, index = table
    rng = random.Random(8)
    asked = {"", "a", "fü", "PARSE", "zzzz", "🤗", "🤗日", "needle at the end", "aaaaaa", None}
    for _ in range(40):
        text = rng.choice([r[1] for r in rows[:300] if r[1]])
        at = rng.randrange(len(text))
        asked.add(text[at : at + rng.randrange(1, 9)].upper() if rng.random() < 0.3 else text[at : at + rng.randrange(1, 9)])
    asked = {a for a in asked if a is None or (a.upper().lower() == a.lower() and "İ" not in a and "i̇" not in a)}
    needles = spark.createDataFrame([(a, 1) for a in asked] + [("PARSE", 2)], "needle string, id long")
    got = [tuple(r) for r in index.search_many(needles).collect()]
    expected = {(a, r[0]) for a in asked if a is not None for r in rows if r[0] is not None and any(c is not None and a.lower() in c.lower() for c in r[1:3])}
    assert set(got) == expected and len(got) == len(set(got))


def test_many_needles_read_one_list_each(table):
    """No other gram's postings are joined, needles go to the postings, and a text is taken apart once, not once for each gram."""
    nodes, index = table[1:]
    plan = index.search_many(nodes.select(F.col("name").alias("needle")))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "pos#" in line]
    assert len(scans) == 1 and plan.count("BroadcastHashJoin [gram") + plan.count("BroadcastHashJoin [low") >= 2
    taken = nodes.select(text_index.grams(F.col("name")).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert taken.count("split(") + taken.count("regexp_extract_all(") == 1


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_needles_broadcast_or_not(spark, table, monkeypatch, most):
    monkeypatch.setattr(text_index, "MAX_BROADCAST_NEEDLES", most)
    rows, nodes, index = table
    needles = nodes.select(F.col("name").alias("needle")).unionAll(spark.createDataFrame([("",), ("e",), ("İ",), ("語🤗",)], "needle string"))
    asked = {r["needle"] for r in needles.collect()} - {None}
    got = [tuple(r) for r in index.search_many(needles).collect()]
    low = {r["needle"]: r["low"] for r in needles.select("needle", F.lower("needle").alias("low")).collect()}
    texts = [(r["id"], [c for c in (r["a"], r["b"]) if c is not None]) for r in nodes.select("id", F.lower("name").alias("a"), F.lower("qualified_name").alias("b")).collect()]
    assert set(got) == {(a, i) for a in asked for i, held in texts if i is not None and any(low[a] in c for c in held)} and len(got) == len(set(got))


def test_a_small_file_is_many_tasks_work(spark, table):
    index = text_index.TextIndex(table[1].coalesce(1), ["name"], table[2].path)
    assert index._dealt().rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_common_gram_spreads(spark):
    nodes = spark.range(4000).select("id", F.concat(F.lit("aaa"), F.col("id")).alias("name"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        index = text_index.TextIndex.build(nodes, ["name"])
        assert index.postings.where("gram = 'aaa'").select(F.input_file_name()).distinct().count() > 2
        assert index.search("aaa39").count() == 111 and index.search("aa").count() == 4000
        assert text_index.TextIndex.build(nodes.limit(0), ["name"]).search("abc").count() == 0
        index.drop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
