"""Changes between two trees against a plain comparison."""

import random

from pyspark.sql import functions as F

from graphloom.operators import digest_tree

FILES = "path string, content_hash string"


def plain(old, new):
    gone = {p for p in old if p not in new}
    came = {p for p in new if p not in old}
    out = {(p, "Modified", None) for p in old if p in new and old[p] != new[p]}
    for h in {old[p] for p in gone} & {new[p] for p in came}:
        for a, b in zip(sorted(p for p in gone if old[p] == h), sorted(p for p in came if new[p] == h)):
            out.add((b, "Renamed", a))
            gone.discard(a)
            came.discard(b)
    return out | {(p, "Deleted", None) for p in gone} | {(p, "Added", None) for p in came}


def tree(spark, files):
    return digest_tree.DigestTree.build(spark.createDataFrame(list(files.items()), FILES).repartition(3))


def random_tree(rng, n):
    return {"/".join(rng.choice("abc") for _ in range(rng.randrange(0, 4))) + f"/f{i}.rs": rng.choice(["x", "y", None, f"h{i}"]) for i in range(n)}


def test_against_a_plain_comparison(spark):
    rng = random.Random(6)
    old = {p.lstrip("/"): h for p, h in random_tree(rng, 120).items()}
    new = dict(old)
    for p in rng.sample(sorted(old), 25):
        new["moved/" + p] = new.pop(p)
    for p in rng.sample(sorted(old), 20):
        new[p] = rng.choice(["x", "z", None])
    for p in rng.sample(sorted(new), 10):
        del new[p]
    before, after = tree(spark, old), tree(spark, new)
    got = [tuple(r) for r in digest_tree.changes(before, after).collect()]
    assert set(got) == plain(old, new) and len(got) == len(set(got))
    assert {k for _, k, _ in got} == {"Added", "Deleted", "Modified", "Renamed"}
    empty = tree(spark, {})
    assert {tuple(r) for r in digest_tree.changes(empty, after).collect()} == {(p, "Added", None) for p in new}
    before.drop()


def test_equal_folders_are_skipped(spark):
    """Only what lies above and beside a change is looked at."""
    old = {f"d{i}/e{j}/f{k}/x.rs": f"{i}{j}{k}" for i in range(4) for j in range(4) for k in range(4)}
    new = old | {"d1/e2/f3/x.rs": "other"}
    before, after = tree(spark, old), tree(spark, new)
    names, compared = digest_tree.differing(before, after)
    assert [r["folder"] for r in names.collect()] == ["d1/e2/f3"] and compared == 1 + 4 + 4 + 4
    same, compared = digest_tree.differing(before, tree(spark, dict(reversed(old.items()))))
    assert same.count() == 0 and compared == 1


def test_edited_and_moved_files(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    olds = {f"src/{i}.rs": text() for i in range(12)} | {"src/empty.rs": "", "src/none.rs": None}
    news = {}
    for i, (p, t) in enumerate(olds.items()):
        news["lib/" + p if i < 9 else p] = t + " edited here" if i < 8 and t else t
    news["lib/fresh.rs"] = text()
    hashed = lambda rows: {p: str(hash(t)) for p, t in rows.items()}
    contents = tuple(spark.createDataFrame([(p, t, 1) for p, t in rows.items()], "path string, content string, key int") for rows in (olds, news))
    got = {tuple(r) for r in digest_tree.changes(tree(spark, hashed(olds)), tree(spark, hashed(news)), contents).collect()}
    assert got == {(f"lib/src/{i}.rs", "Renamed", f"src/{i}.rs") for i in range(9)} | {("lib/fresh.rs", "Added", None)}


def test_many_files_of_one_content_spread(spark):
    """Files of equal content are numbered by ranges: one content may be that of all files."""
    old = spark.range(600).select(F.format_string("a/%04d", "id").alias("path"), F.lit("same").alias("content_hash"))
    new = spark.range(500).select(F.format_string("b/%04d", "id").alias("path"), F.lit("same").alias("content_hash"))
    found = digest_tree.changes(digest_tree.DigestTree.build(old), digest_tree.DigestTree.build(new))
    assert {tuple(r) for r in found.collect()} == {(f"b/{i:04d}", "Renamed", f"a/{i:04d}") for i in range(500)} | {(f"a/{i:04d}", "Deleted", None) for i in range(500, 600)}
