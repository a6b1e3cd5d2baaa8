"""Measures of texts, failed filters and the audit of all orders against plain rules."""

import random
import re
from itertools import permutations

import helpers as H
import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import filter_audit as audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    words = WORD.findall(text or "")
    return len(words), len(text or ""), len(re.findall("[A-Z]", text or "")), len(re.findall(r"[#$%&*|]", text or "")), len(set(words))


def texts():
    rng = random.Random(3)
    long = ["w" * 63, "w" * 64, "w" * 65, "w" * 64 + "x", "w" * 65, "W" * 64, "w" * 200 + "a", "w" * 200 + "b", "w" * 200 + "a"]
    many = " ".join(rng.choice(["Aa", "aA", "é|", "日本", "🤗#", "x" * rng.randrange(1, 80), "$"]) for _ in range(3000))
    return [*H.awkward_texts(), " ".join(long), many, "\x0b\x0cA\rB", "ÀÉ A", "é", "a", "aé", "ab ab abc ab\x00 ab", "A" * 7 + " " + "b" * 93]


@pytest.mark.parametrize("hashes", ["as they are", "all equal"])
def test_measures(monkeypatch, hashes):
    """Words are compared byte by byte, so that equal hashes change nothing."""
    found = texts()
    if hashes == "all equal":
        monkeypatch.setattr(audit, "_span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        found = [(t or "")[:1500] for t in found]
    m = audit.measure(pa.array(found, pa.string()))
    got = list(zip(*(m[k].tolist() for k in ("words", "points", "capitals", "symbols", "distinct"))))
    assert got == [measured(t) for t in found]
    assert [len(x) for x in audit.measure(pa.array([], pa.string())).values()] == [0] * 5
    assert audit.measure(pa.array([None, ""], pa.string()))["words"].tolist() == [0, 0]


def test_a_text_of_several_megabytes():
    text = H.prose(random.Random(1), 700_000) + " " + "Z" * 3_000_000 + " é#"
    m = audit.measure(pa.array(["a b", text, "c"]))
    assert [m[k][1] for k in ("words", "points", "capitals", "symbols", "distinct")] == list(measured(text))
    assert m["words"].tolist()[::2] == [2, 1]


def rows():
    rng = random.Random(9)
    out = []
    for i in range(300):
        words = [rng.choice(["alpha", "beta", "Gamma", "delta", "eps"]) if rng.random() < rng.choice([0.1, 0.9]) else f"w{rng.randrange(999)}" for _ in range(rng.choice([10, 49, 50, 80]))]
        text = " ".join(words) + rng.choice(["", "", " #", " ABCDEFGHIJ KLMNOPQ"])
        out.append((i, rng.choice(["a", "a", "a", "b", None, ""]), text))
    out += [(300 + i, "b", out[i % 7][2]) for i in range(60)] + [(5, "a", out[5][2]), (5, "c", "another"), (None, "a", out[1][2]), (None, None, None), (None, None, ""), (999, "d", None), (1000, "d", "")]
    rng.shuffle(out)
    return out


def failed(all_rows):
    ids = {}
    for i, _, text in all_rows:
        if i is not None:
            ids[text or ""] = min(i, ids.get(text or "", i))
    out = []
    for i, part, text in all_rows:
        words, points, capitals, symbols, distinct = measured(text)
        late = i is not None and ids[text or ""] < i
        out.append((i, part or "", {f for f, bad in zip("ABCDE", (words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, symbols > 0, late)) if bad}))
    return out


def plain_audit(all_rows, labels):
    documents = failed(all_rows)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    out = {}
    for part in {p for _, p, _ in documents}:
        here = [d for d in documents if d[1] == part]
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                lost = [sum(d[0] in who for d in gone if d[0] is not None) for who in (good, toxic)]
                fail = sum(f in d[2] for d in here)
                out[part, order, step] = [len(left), len(gone), fail - len(gone), sum(d[2] == {f} for d in here), *lost]
        for f in "ABCDE":
            at = [(order, order.index(f) + 1) for order in map("".join, permutations("ABCDE"))]
            total = sum(out[part, order, step][1] for order, step in at)
            for order, step in at:
                out[part, order, step].append(total)
    return out


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_audit_of_all_orders(spark, monkeypatch, most):
    monkeypatch.setattr(audit, "MAX_BROADCAST_COPIES", most)
    table = rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 400, 3)] + [(3, 1, None), (None, 1, 1), (6, None, 1), (6, 0, 0)]
    docs = spark.createDataFrame([(i, s, t, "x", 1) for i, s, t in table], "doc_id long, source string, text string, part string, mask int").repartition(5)
    failures = audit.failures(docs)
    assert sorted(map(str, ((r["doc_id"], r["part"], {f for k, f in enumerate("ABCDE") if r["mask"] >> k & 1}) for r in failures.collect()))) == sorted(map(str, failed(table)))
    got = audit.audit(audit.masks(failures, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert {(r["part"], r["filter_order"], r["step"]): [r[m] for m in audit.MEASURES] for r in got.collect()} == plain_audit(table, labels)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.masks(audit.failures(docs), labels)).count() == 0
