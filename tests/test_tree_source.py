"""The source-tree data source: what it lists, what it opens, and what filters keep from it."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.sources import tree, tree_source

FILES = {
    "a.rs": "fn a() {}",
    ".rs": "hidden",
    "src/x.rs": "é 日本",
    "src/X.RS": "not supported",
    "src/deep/target/y.ts": "a folder of an ignored name, further down",
    "src/deep/e m+p%t y.jsx": "",
    "src2/x.rs": "another folder of that prefix",
    "target/z.rs": "ignored",
    "node_modules/m/index.js": "ignored",
    "build": "a file of an ignored name",
    "lib/n.md": "not supported",
}
READ = {"a.rs", ".rs", "src/x.rs", "src/deep/target/y.ts", "src/deep/e m+p%t y.jsx", "src2/x.rs"}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    (base / "src" / "again").symlink_to(base / "src")
    return str(base)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_whole_tree(spark, root, scheme):
    rows = {r["rel_path"]: r for r in tree.source_tree(spark, scheme + root).collect()}
    assert set(rows) == READ
    for path, r in rows.items():
        assert (r["content"], r["size_bytes"]) == (FILES[path], len(FILES[path].encode()))
    again = spark.createDataFrame([(p,) for p in rows], "p string").select("p", tree.language_of(F.col("p")).alias("l"))
    assert {r["p"]: r["l"] for r in again.collect()} == {p: r["language"] for p, r in rows.items()}
    names = tree.source_tree(spark, root, contents=False)
    assert {(r["rel_path"], r["content"]) for r in names.collect()} == {(p, None) for p in READ}


def test_filters_reach_the_listing(spark, tmp_path):
    """Files outside a filter are not opened: here they could not be read."""
    for path in ("src/a.rs", "src/b.ts", "other/c.rs", "other/d/e.ts"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"fine" if path == "src/a.rs" else b"\xff\xfe")
    found = tree.source_tree(spark, str(tmp_path))
    with pytest.raises(Exception, match="not UTF-8"):
        found.collect()
    for kept in (found.where("rel_path LIKE 'src/%' AND language = 'rust'"), found.where("rel_path = 'src/a.rs'"), found.where("rel_path IN ('src/a.rs', 'x') AND size_bytes > 1"), found.where("rel_path LIKE '%a.rs'")):
        assert [r["rel_path"] for r in kept.collect()] == ["src/a.rs"]
        plan = kept._jdf.queryExecution().executedPlan()
        assert "PushedFilters" in kept._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted") and "BatchScan source_tree" in plan.toString()
    assert found.where("language = 'typescript' AND language = 'rust'").count() == 0


def test_folders_outside_a_filter_are_not_listed(root, monkeypatch):
    listed = []
    real = tree_source.SourceTreeReader._list
    monkeypatch.setattr(tree_source.SourceTreeReader, "_list", lambda self, system, base, path: listed.append(path) or real(self, system, base, path))
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    for folders in (1, 2, 100):
        reader = tree_source.SourceTreeReader(root, True, folders)
        left = list(reader.pushFilters([StringStartsWith(("rel_path",), "src/deep/"), GreaterThan(("size_bytes",), 0), EqualTo(("content",), "x")]))
        assert [type(f) for f in left] == [GreaterThan, EqualTo]
        parts = reader.partitions()
        got = sorted(p for part in parts for batch in reader.read(part) for p in batch.column(0).to_pylist())
        assert got == sorted(p for p in READ if p.startswith("src/deep/"))
    assert set(listed) <= {"", "src", "src/deep", "src/deep/target"}


@pytest.mark.parametrize("folders", [1, 3, 1000])
def test_partitions_cover_the_tree_once(root, folders):
    reader = tree_source.SourceTreeReader(root, True, folders)
    got = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column(0).to_pylist()]
    assert sorted(got) == sorted(READ)


def test_empty_tree_and_batches(spark, tmp_path, monkeypatch):
    assert tree.source_tree(spark, str(tmp_path)).count() == 0
    for i in range(20):
        (tmp_path / f"f{i}.rs").write_text("x" * 10)
    monkeypatch.setattr(tree_source, "BATCH_BYTES", 35)
    reader = tree_source.SourceTreeReader(str(tmp_path), True, 1)
    assert [b.num_rows for part in reader.partitions() for b in reader.read(part)] == [4] * 5
    assert os.listdir(tmp_path).count("f0.rs") == 1
