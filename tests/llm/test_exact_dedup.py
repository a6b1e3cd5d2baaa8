"""Exact deduplication against a plain rule."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import helpers as H
import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, len(text or "")))
    out = Counter()
    for content, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        sha = hashlib.sha256(content.encode()).hexdigest()
        out[best[0], best[0], len(members), True, sha] += 1
        members.remove(best)
        for doc_id, _ in members:
            out[doc_id, best[0], len(members) + 1, False, sha] += 1
    return out


def cases():
    rng = random.Random(4)
    rows = list(enumerate(H.awkward_texts()))
    rows += [(None, "a b"), (None, "ab"), (7000, " ab "), (7000, " ab "), (None, "  a b  "), (None, "  a b  "), (8000, "only once"), (8000, "another"), (None, None), (3, " x"), (4, "x")]
    rows += [(9000 + i, "hot" + " " * rng.randrange(3)) for i in range(400)]
    rows += [(rng.randrange(10_000, 10_040), rng.choice(["p", " p", "q q", "qq", "r\x0b"])) for _ in range(200)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("weak", [False, True])
def test_against_a_plain_rule(spark, weak):
    """A digest that most contents share changes nothing: contents themselves are compared."""
    rows = cases()
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, size string, digest string, row int").repartition(7)
    digest = {"digest": lambda c: F.unhex(F.substring(F.md5(c), 1, 2))} if weak else {}
    got = exact_dedup.deduplicate(docs, **digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == expected(rows)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_DIGESTS", 0)
    rows = cases()
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), salts=3)
    assert Counter(tuple(r) for r in got.collect()) == expected(rows)


def test_empty_table_and_ids_of_another_type(spark):
    assert exact_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [("b", "t t"), ("a", "tt"), ("c", "t  t")]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got.collect()} == {("a", "c", False), ("b", "c", False), ("c", "c", True)}


def test_no_python_on_the_path(spark):
    plan = exact_dedup.deduplicate(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
