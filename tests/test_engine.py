"""A small source tree from indexing to collection."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.cli import main
from graphloom.engine import Engine, UnknownProject
from graphloom.plans.context import Task
from graphloom.sources import tree
from graphloom.sources.parser import parse
from graphloom.sources.store import ConcurrentWriter
from graphloom.streaming import feedback_stream, overlay_state

BREW = """pub fn weigh(beans: f64) -> f64 {
    beans.max(0.0)
}

pub fn grind(beans: f64, steps: u8) -> f64 {
    weigh(beans) / f64::from(steps)
}

pub fn pour(water: f64) -> f64 {
    grind(water, 4)
}
"""
FILES = {
    "kitchen/lib.rs": "pub mod brew;\n\npub enum Roast {\n    Light,\n    Dark,\n}\n\nimpl Roast {\n    pub fn cost(&self) -> f64 {\n        weigh(2.5)\n    }\n}\n",
    "kitchen/brew.rs": BREW,
    "kitchen/bar.rs": "fn bell() {}\n\nfn open_bar() {\n    bell();\n    eprintln!(\"open\");\n}\n",
    "menu/list.ts": "export class Menu {\n  first() {\n    return pick(0);\n  }\n}\nfunction pick(n) { return n; }\n",
    "node_modules/x/skip.ts": "function skipped() {}\n",
    "build/skip.rs": "\u0000 not read",
    "menu/plan.txt": "nothing",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    return tmp_path / "tree"


def state(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in sorted(root.rglob("*")) if p.is_file()}


def test_index_ask_overlay_collect(spark, root, tmp_path):
    clock = [1_000_000_000]
    engine = Engine(spark, f"{tmp_path}/warehouse", lambda: clock[0])
    before = state(root)
    project = engine.attach(str(root))
    first = project.index(kind="anonymous")
    assert (first.snapshot, first.files, first.new_symbols, first.new_edges) == (1, 4, 12, 5)
    again = project.index(kind="anonymous")
    assert (again.snapshot, again.new_symbols, again.new_edges) == (2, 0, 0)
    assert state(root) == before
    assert sorted(r["related_name"] for r in project.callers("weigh").collect()) == ["cost", "grind"]
    assert [r["related_name"] for r in project.callees("first").collect()] == ["pick"]
    assert {r["qualified_name"] for r in project.search("ROAST").collect()} == {"Roast", "Roast::cost"}
    assert project.edges().count() == 5 == project.edges(1).count() and project.edges(0).count() == 0
    assert project.store.get_meta("project_uuid") == project.id and project.store.get_meta("other") is None
    assert project.registry.all().first()["db_size_bytes"] > 0

    changed = BREW.replace("pub fn pour(water: f64) -> f64 {\n    grind(water, 4)\n}\n", "pub fn steep(water: f64) -> f64 {\n    weigh(grind(water, 2))\n}\n")
    project.set_overlay(spark.createDataFrame([("kitchen/brew.rs", changed)], "rel_path string, content string"))
    assert {r["related_name"] for r in project.callers("weigh").collect()} == {"cost", "grind", "steep"}
    assert project.symbol("pour").count() == 0
    project.clear_overlay()
    assert project.symbol("steep").count() == 0 and project.symbol("pour").count() == 1

    plan = {r["name"]: r for r in project.find_context(Task("pour grind")).collect()}
    assert plan["pour"]["score"] == plan["grind"]["score"] == 1000 and plan["pour"]["kept"]
    assert project.usefulness().count() == 3
    assert "previously useful" in {r["name"]: r for r in project.find_context(Task("pour")).collect()}["grind"]["reason"]

    old = [tuple(r) for r in project.graph(2)[0].select("id").orderBy("id").collect()]
    (root / "kitchen/brew.rs").write_text(changed)
    third = project.index(kind="filehash")
    assert third.new_symbols == 1 and project.symbol("pour").count() == 0
    changed_symbols, reached = project.explain(2, 3)
    assert sorted(r["change"] for r in changed_symbols.collect()) == ["added", "removed"] and reached.count() == 0
    assert [(r["file_path"], r["symbols"]) for r in project.impact("weigh").orderBy("file_path").collect()] == [("kitchen/brew.rs", 2), ("kitchen/lib.rs", 1)]
    assert [r["last_indexed_at"] for r in engine.known().collect()] == [clock[0]]
    assert [tuple(r) for r in project.graph(2)[0].select("id").orderBy("id").collect()] == old
    clock[0] += 77 * 86400
    freed = project.collect_garbage(keep=1)
    assert freed["freed_snapshots"] == 1
    assert project.symbol("steep").count() == 1

    main(["--warehouse", f"{tmp_path}/warehouse", "callers", str(root), "weigh"], spark)


def test_unpublished_rows_stay_invisible(spark, root, tmp_path):
    project = Engine(spark, f"{tmp_path}/warehouse").attach(str(root))
    project.index()
    store = project.store
    rows = store.versions("symbol").drop("visible_until", "visible_from").withColumn("visible_from", F.lit(2).cast("long"))
    rows.write.mode("overwrite").parquet(store._at("symbol_open", "snapshot=2"))  # a run that never got to its manifest
    assert store.versions("symbol").where("visible_from = 2").count() == 0


def test_two_writers(spark, root, tmp_path):
    """Each gets a number of its own, and the one that comes second publishes nothing."""
    project = Engine(spark, f"{tmp_path}/warehouse").attach(str(root))
    store = project.store
    crashed = store.claim(1)
    assert (crashed, project.index().snapshot) == (1, 2)
    late, nodes = store.claim(1), project.graph()[0].count()
    with pytest.raises(ConcurrentWriter):
        store.publish({}, {}, {}, late, 0, "filehash", 7)
    assert late == 3 and store.latest() == 2 and project.graph()[0].count() == nodes > 0
    assert len(store.manifest().first()["uuid"]) == 48


def test_engine_lets_the_oldest_go(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/warehouse", max_active=2)
    for name in "abc":
        (tmp_path / name).mkdir()
        engine.attach(f"{tmp_path}/{name}")
    assert [os.path.basename(p) for p in engine.projects()] == ["c", "b"]
    with pytest.raises(UnknownProject):
        engine.get(f"{tmp_path}/a")
    assert engine.detach(f"{tmp_path}/b") and not engine.detach(f"{tmp_path}/b")


def test_broken_utf8_stops_the_run(spark, tmp_path):
    (tmp_path / "a.rs").write_bytes(b"fn a() {} // \xff")
    with pytest.raises(Exception, match="UTF-8"):
        tree.source_tree(spark, str(tmp_path)).collect()


def test_typescript():
    symbols, references = parse("interface Shape { area(): number; }\nclass Disc implements Shape {\n  radius(): number { return Math.abs(2); }\n  area(): number { return this.radius(); }\n}\n", "typescript")
    assert {(s["qualified_name"], s["kind"]) for s in symbols} >= {("Shape", 5), ("Disc", 2), ("Disc::radius", 1), ("Disc::area", 1)}
    assert {(r["from_qualified_name"], r["to_name"], r["kind"]) for r in references} >= {("Disc::area", "radius", 1), ("Disc", "Shape", 4)}
    names = [s["name"] for s in parse("function fold(a) {}\nconst twice = (n) => fold(n, n);\nconst half = function (n) {};\n", "typescript")[0] if s["kind"] == 1]
    assert names == ["fold", "twice", "half"]
    assert ("tea::boil", 1) in {(s["qualified_name"], s["kind"]) for s in parse("namespace tea { export function boil(a) { return a; } }", "typescript")[0]}


@pytest.mark.parametrize("text", ["fn {{{ impl for (", 'let s = "', "/* open", "class { function ((", "}}}}", "é" * 50, ""])
def test_malformed_sources(text):
    for language in ("rust", "typescript"):
        parse(text, language)


def test_git(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True)

    with pytest.raises(ValueError):
        tree.resolve_commit(str(tmp_path), "HEAD")
    git("init", "-q")
    (tmp_path / "a.rs").write_text("fn a() {}\n" * 9)
    (tmp_path / "b.rs").write_text("1\n")
    git("add", ".")
    assert {tuple(r) for r in tree.diff_working_tree(spark, str(tmp_path)).collect()} == {("a.rs", "added"), ("b.rs", "added")}
    git("commit", "-qm", "x")
    git("mv", "a.rs", "c.rs")
    (tmp_path / "b.rs").unlink()
    (tmp_path / "n.rs").write_text("2\n")
    git("add", "-A")
    git("commit", "-qm", "y")
    assert {tuple(r) for r in tree.diff_commits(spark, str(tmp_path), "HEAD~1", "HEAD").collect()} == {("c.rs", "modified"), ("b.rs", "deleted"), ("n.rs", "added")}


def test_streams(spark, tmp_path):
    events = [("x", 1, 77, 1), ("x", 2, 910, 2), ("y", 3, 10, 3), ("x", 4, 305, 4)]
    schema = "identity_id string, seq long, score long, seen_at long"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = feedback_stream.running_usefulness(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"))
    query = stream.writeStream.outputMode("update").format("memory").queryName("uses").option("checkpointLocation", f"{tmp_path}/c1").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.sql("SELECT identity_id, times_included, avg_score FROM uses").collect()} == {("x", 3, 430), ("y", 1, 10)}

    changes = spark.createDataFrame([("r", "a.rs", 1, "old"), ("r", "a.rs", 2, "new"), ("r", "b.rs", 3, None)], "root string, path string, seq long, content string").withColumn("at", F.timestamp_seconds("seq"))
    changes.coalesce(1).write.parquet(f"{tmp_path}/changes")
    got = []
    source = spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/changes")
    query = overlay_state.maintain(source, lambda batch, number: got.extend((r["path"], r["content"]) for r in batch.collect()), f"{tmp_path}/c2")
    query.awaitTermination(60)
    assert sorted(got, key=str) == [("a.rs", "new"), ("b.rs", None)]
    assert [(r["changes"], r["paths"]) for r in overlay_state.debounced(changes).collect()] == [(3, ["a.rs", "b.rs"])]
    paths = ["/w/a/x.rs", "/w/a/target/y.rs", "/w/a/deep/target/z.ts", "/w/a/n.md", "/w/b/q.rs"]
    found = overlay_state.relevant(spark.createDataFrame([(p,) for p in paths], "path string"), "/w/a")
    assert sorted(r["path"] for r in found.collect()) == ["deep/target/z.ts", "x.rs"]
