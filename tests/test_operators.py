"""Small cases of operators with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions import ids
from graphloom.functions.text import keywords, last_segment, token_cost
from graphloom.operators import changes, collection, feedback, graph, resolver, statistics, visibility
from graphloom.operators.components import connected_components
from graphloom.plans import context

DAY = 86400
VERSIONS = "identity long, version long, visible_from long, visible_until long"


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_visibility_is_half_open(spark):
    v = spark.createDataFrame([(1, 1, 1, 2), (2, 1, 2, None)], VERSIONS)
    assert [r.identity for r in visibility.visible_at(v, 1).collect()] == [1]
    assert [r.identity for r in visibility.visible_at(v, 2).collect()] == [2]
    s = spark.createDataFrame([(1,), (2,), (30,)], "id long")
    live = visibility.live_versions(v, s)
    assert pairs(live.select("snapshot_id", "identity")) == [(1, 1), (2, 2), (30, 2)]
    assert pairs(visibility.snapshot_diff(v, 1, 2, ["identity"])) == [(1, "removed"), (2, "added")]


def graph_of(spark, names, edges):
    nodes = spark.createDataFrame([(i, n, f"m::{n}", "src/a.rs", 1, 40) for i, n in enumerate(names)], "id long, name string, qualified_name string, file_path string, start_line int, byte_len long")
    return nodes, spark.createDataFrame(edges, "src long, dst long")


def test_relations_against_a_plain_rule(spark):
    """Random graphs: repeated edges repeat, unknown ends vanish, a match without neighbours stays."""
    rng = random.Random(14)
    names = [rng.choice(["brew", "steep", "Pour", "stir"]) for _ in range(12)] + ["alone"]
    edges = [(rng.randrange(14), rng.randrange(12)) for _ in range(40)]
    nodes, calls = graph_of(spark, names, edges)
    for name in ("brew", "alone", "none"):
        for direction, own, other in (("callers", 1, 0), ("callees", 0, 1)):
            expected = []
            for i, n in enumerate(names):
                found = [e[other] for e in edges if e[own] == i and e[other] < len(names)] if n == name else []
                expected += [(i, x, names[x]) for x in found] or ([(i, None, None)] if n == name else [])
            got = graph.relations(nodes, calls, name, direction).select("match_id", "related_id", "related_name")
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert graph.trace(nodes, calls, "brew", "sideways").count() == 0
    assert pairs(graph.degrees(nodes, calls)) == [(i, sum(e[1] == i for e in edges), sum(e[0] == i for e in edges)) for i in range(len(names))]
    assert sorted(r.id for r in graph.search(nodes, "PO").collect()) == [i for i, n in enumerate(names) if n == "Pour"]
    assert graph.search(nodes, "p%").count() == 0


def test_reverse_reach_in_a_cycle(spark):
    _, calls = graph_of(spark, [], [(0, 1), (1, 2), (2, 0)])
    start = spark.createDataFrame([(2,)], "id long")
    assert pairs(graph.reverse_reach(calls, start, 1)) == [(1, 1)]
    assert pairs(graph.reverse_reach(calls, start, 9)) == [(0, 2), (1, 1)]


SYMBOLS = "identity long, file_id string, qualified_name string, name string, ord long"
REFS = "file_id string, from_qualified_name string, to_name string, kind int, ord long"


def test_resolution_against_a_plain_rule(spark):
    """Random files: the first symbol of the name in the file, else the only one anywhere, else none; origins are the last of their name."""
    rng = random.Random(6)
    names = [f"w{i}" for i in range(25)]
    symbols = [(i, rng.choice("pqrs"), f"s::{n}", n, i) for i, n in enumerate(rng.choice(names) for _ in range(30))]
    refs = [(rng.choice("pqrst"), f"s::{rng.choice(names)}", rng.choice(names), 1, k) for k in range(120)]
    edges, lost = {}, []
    for file, origin, name, _, k in refs:
        source = [i for i, f, q, *_ in symbols if (f, q) == (file, origin)]
        local, anywhere = [i for i, f, _, n, _ in symbols if (f, n) == (file, name)], [i for i, _, _, n, _ in symbols if n == name]
        if not source:
            continue
        if local or len(anywhere) == 1:
            edges.setdefault((source[-1], (local or anywhere)[0]), k)
        else:
            lost.append((name, "Ambiguous" if anywhere else "NotFound"))
    got, unresolved = resolver.resolve_edges(spark.createDataFrame(refs, REFS), spark.createDataFrame(symbols, SYMBOLS))
    assert pairs(got.select("src", "dst", "ord")) == sorted((a, b, k) for (a, b), k in edges.items())
    assert pairs(unresolved.select("to_name", "reason")) == sorted(lost)


def test_running_mean_truncates_in_order(spark):
    events = spark.createDataFrame([("x", 2, 33, 5), ("x", 1, 990, 4), ("x", 3, 7, 6), ("x", 4, 500, 6)], "identity_id string, seq long, score long, seen_at long")
    assert pairs(feedback.usefulness(events)) == [("x", 4, 6, 382)]  # 990, 511, 343, 382
    again = feedback.with_inclusions(spark.createDataFrame([(1, 4), (2, 1)], "id long, times_included long"), spark.createDataFrame([(2,), (3,)], "id long"))
    assert pairs(again) == [(1, 4), (2, 2), (3, 1)]


def test_running_mean_over_many_batches(spark):
    """A symbol's events are never gathered into one array, and its fold goes on from batch to batch."""
    rng = random.Random(5)
    rows = [(rng.choice(["x", "x", "x", "y", None]), i, rng.randrange(1001), i % 13) for i in range(3000)] + [("z", 1, None, None), ("z", 2, 7, 5)]
    expected = {}
    for symbol, _, score, seen in rows:
        n, mean, _ = expected.get(symbol, (0, 0, None))
        expected[symbol] = (n + 1, None if mean is None or score is None else (mean * n + score) // (n + 1), seen)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        used = feedback.usefulness(spark.createDataFrame(rows, "identity_id string, seq long, score long, seen_at long").repartition(3))
        got = {r["identity_id"]: (r["times_included"], r["avg_score"], r["last_seen"]) for r in used.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == expected
    assert "collect_list" not in used._jdf.queryExecution().toString()


def snapshots(spark, rows):
    return spark.createDataFrame(rows, "id long, kind string, created_at long, parent_id long")


def test_collection(spark):
    """Random histories against a plain rule: old, ephemeral, and not among the newest."""
    rng, now = random.Random(21), 1_700_000_000
    for keep in (0, 2, 9):
        kinds = ["anonymous", "working_tree", "commit", "filehash"]
        rows = [(i, rng.choice(kinds), now - rng.randrange(0, 60 * DAY), rng.choice([None, *range(1, i)])) for i in range(1, 25)]
        s = snapshots(spark, rows)
        ephemeral = sorted((r for r in rows if r[1] in kinds[:2]), key=lambda r: (r[2], r[0]), reverse=True)
        lost = sorted(r[0] for r in ephemeral[keep:] if r[2] < now - 30 * DAY)
        gone = collection.victims(s, now, keep, 30)
        assert [r["id"] for r in gone.collect()] == lost
        parent = {r[0]: r[3] for r in rows}

        def nearest(i):
            while i in lost:
                i = parent[i]
            return i

        assert pairs(collection.survivors(s, gone).select("id", "parent_id")) == [(i, nearest(parent[i])) for i in sorted(parent) if i not in lost]
        v = [(i, rng.randrange(9), rng.randrange(1, 25), rng.choice([None, *range(1, 25)])) for i in range(60)]
        freed = sum(r[2] in lost or r[3] in lost for r in v)
        assert pairs(collection.report(s, spark.createDataFrame(v, VERSIONS), gone)) == [(len(lost), freed)]
    loop = snapshots(spark, [(1, "anonymous", 0, 2), (2, "anonymous", 0, 1), (3, "commit", 0, 1), (4, "commit", 0, 3)])
    assert pairs(collection.survivors(loop, collection.victims(loop, now, 0, 30)).select("id", "parent_id")) == [(3, None), (4, 3)]


def test_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    assert pairs(changes.upsert(table, spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    v = spark.createDataFrame([(1, 1, 1, None), (2, 1, 1, 5)], VERSIONS)
    assert pairs(changes.close_versions(v, v.select("identity"), ["identity"], 9).select("identity", "visible_until")) == [(1, 9), (2, 5)]
    assert pairs(changes.new_versions(v.select("identity", "version"), v, ["identity", "version"])) == [(2, 1)]
    found = changes.detect(spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None)], "p string, h string"), spark.createDataFrame([("b", "3"), ("c", "4"), ("d", None)], "p string, h string"), "p", "h")
    assert pairs(found) == [("a", "Added"), ("b", "Modified"), ("c", "Deleted"), ("d", "Unchanged")]


def planned(spark, task, uses=()):
    rows = [(1, "kettle", "tea::kettle", "tea/pot.rs", 96), (2, "lid", "tea::lid", "tea/pot.rs", 20), (3, "kettle_lid", "tea::kettle_lid", "tea/lid.rs", 200), (4, "saucer", "tea::saucer", "tea/cup.rs", 88)]
    nodes = spark.createDataFrame(rows, "id long, name string, qualified_name string, file_path string, byte_len long")
    calls = spark.createDataFrame([(4, 3), (4, 3), (2, 9)], "src long, dst long")
    plan = context.context_plan(nodes, calls, spark.createDataFrame(list(uses), "id long, times_included long"), task)
    return {r["name"]: r for r in plan.collect()}, plan, nodes


def test_plan_scores(spark):
    got, plan, nodes = planned(spark, context.Task("mend the KETTLE"))
    assert {k: r["score"] for k, r in got.items()} == {"kettle": 1000, "kettle_lid": 600, "saucer": 240}
    assert context.summary(plan, nodes, context.Task("kettle")) == "Found 3 candidate(s) anchored on kettle, kettle_lid."
    assert context.summary(plan, nodes, context.Task("zz")) == "No anchors matched the task; 3 candidate(s)."
    got, *_ = planned(spark, context.Task("nothing", current_file="tea/cup.rs", changed_files=["tea/cup.rs", "tea/lid.rs"]))
    assert {k: (r["score"], r["reason"]) for k, r in got.items()} == {"saucer": (500, "current file + diff overlap"), "kettle_lid": (250, "diff overlap")}
    got, plan, _ = planned(spark, context.Task("kettle", budget=50))
    assert {k for k, r in got.items() if r["kept"]} == {"kettle", "saucer"}  # 24 + 22 tokens; 50 do not fit between
    assert pairs(context.omitted(plan)) == [(3, "tea/lid.rs", "token budget")]
    assert pairs(context.pack_budget(plan, context.Task("kettle", budget=50))) == [(50, 46, 2, 1)]
    got, *_ = planned(spark, context.Task("kettle"), [(4, 7), (3, 90), (2, 5)])
    assert got["saucer"]["score"] == 275 and got["kettle_lid"]["score"] == 700 and "lid" not in got
    assert got["saucer"]["reason"] == "near a task match + previously useful"


def test_packing_skips_what_does_not_fit(spark):
    rng = random.Random(3)
    table = [(i, rng.choice([100, 200]), f"n{rng.randrange(9)}", rng.choice([16, 50, 90, 170])) for i in range(60)]
    left, expected = 700, []
    for i, _, _, cost in sorted(table, key=lambda r: (-r[1], r[2], r[0])):
        if cost <= left:
            left -= cost
            expected.append(i)
    assert context.greedy_pack(spark.createDataFrame(table, "id long, score int, qualified_name string, cost long"), 700) == expected


def test_functions(spark):
    row = spark.range(1).select(
        keywords(F.lit("Fix: über añ ab login_2fa FIX")).alias("k"),
        last_segment(F.lit("a::b::c"), F.lit("rust")).alias("r"),
        last_segment(F.lit("a.b:c"), F.lit("typescript")).alias("t"),
        token_cost(F.lit(40)).alias("least"),
        token_cost(F.lit(401)).alias("cost"),
        schemas.symbol_kind_number(F.lit("Trait")).alias("trait"),
        schemas.symbol_kind_name(F.lit(42)).alias("other"),
        schemas.edge_kind_number(F.lit("?")).alias("edge"),
        ids.is_id(ids.project_id(F.lit("/x"))).alias("ok"),
        ids.is_id(F.lit("abc")).alias("bad"),
        keywords(F.lit("हिन्दी ภาษา e\u0301tat cafe\u0301s Ⅻ½x")).alias("marks"),
        schemas.memory_group(F.lit("skill")).alias("memory"),
        schemas.memory_group(F.lit("?")).alias("unknown"),
        schemas.is_persistent(F.lit("session")).alias("stored"),
        token_cost(F.lit(2**53 + 7)).alias("large"),
    ).first()
    # Vowel signs belong to words; the virama and the combining acute do not.
    assert row["marks"] == ["हिन", "दी", "ภาษา", "tat", "cafe", "ⅻ½x"]
    assert (row["memory"], row["unknown"], row["stored"], row["large"]) == ("procedural", None, False, 2**51 + 1)
    assert spark.range(1).select(ids.checked(ids.project_id(F.lit("/x")))).count() == 1
    with pytest.raises(Exception, match="16-byte id"):
        spark.range(1).select(ids.checked(F.lit("abcd"))).collect()
    assert row["k"] == ["fix", "über", "añ", "login_2fa"]
    assert (row["r"], row["t"], row["least"], row["cost"], row["trait"], row["other"], row["edge"], row["ok"], row["bad"]) == ("c", "c", 16, 100, 5, "Other", 1, True, False)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(3, 3), (None, 4), (100, 101), (101, 100)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quantile(spark):
    rows = [("a", x) for x in range(20_000, 0, -1)] + [("b", 7)] * 50 + [("c", None)]
    got = dict(map(tuple, statistics.disc_quantile(spark.createDataFrame(rows, "k string, v long"), "k", "v", 99, 100).collect()))
    assert got == {"a": 19_801, "b": 7}
