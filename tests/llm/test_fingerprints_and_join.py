"""Fingerprints and the n-gram join against direct computation."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import helpers as H

from graphloom.llm import minhash, ngram_join, textarrays


def test_shingles_of_blocks():
    texts = [t for t in H.awkward_texts() if t is None or len(t) < 20_000]
    values, bounds = textarrays.distinct_sorted(*textarrays.shingles(pa.array(texts), 4))
    assert list(np.diff(bounds)) == [len(H.shingles(t, 4)) for t in texts]


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_fingerprint_estimates(bits):
    rng = random.Random(bits)
    base = H.prose(rng, 800).split(" ")
    texts = [" ".join(base), " ".join(base[:600] + H.prose(rng, 200).split(" ")), "one word", " ".join(base)]
    low, known = minhash.fingerprints(pa.array(texts), bits=bits)
    assert all(len(s) == minhash.BINS * bits // 4 for s in minhash.as_strings(low, known, bits))
    near = minhash.likeness(low[:1], known[:1], low[1:2], known[1:2], bits)[0]
    assert abs(near - H.jaccard(H.shingles(texts[0], 5), H.shingles(texts[1], 5))) < 0.3 / bits
    assert minhash.likeness(low[:1], known[:1], low[3:], known[3:], bits)[0] == 1
    assert minhash.likeness(low[:1], known[:1], low[2:3], known[2:3], bits)[0] < 0.35 / bits


def test_edit_fingerprints(spark):
    texts = H.awkward_texts()
    docs = H.documents(spark, texts)
    got = minhash.edit_fingerprints(docs).toPandas()
    rows = sorted(((i if i is not None else -1, t or "") for i, t in docs.select("doc_id", "text").collect()), key=lambda r: (-r[0], r[1]))
    assert len(got) == len(rows)
    expected = []
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.n_chars, got.edited_sha256)) == sorted(expected)
    by_text = dict(zip(got.doc_id, got.fingerprint))
    assert by_text[6] == by_text[7] == by_text[8] and by_text[0] == by_text[1] == ""
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert minhash.edit_fingerprints(docs.limit(0)).count() == 0
    one = minhash.edit_fingerprints(docs.where("doc_id = 9")).first()
    assert one["near_next"] == 1


def fingerprint_directly(text, words=5, bins=512, bits=4):
    """One hash per shingle of words, a minimum per bin, and empty bins filled along the probe sequence, in plain loops."""
    mask = 2**64 - 1

    def mix(h):
        for shift, factor in ((30, int(textarrays.MIX_1)), (27, int(textarrays.MIX_2))):
            h = (h ^ (h >> shift)) * factor & mask
        return h ^ (h >> 31)

    word = lambda w: mix(sum((b + 1) * pow(int(textarrays.BASE), i, 1 << 64) for i, b in enumerate(w.encode())) & mask)
    own = H.shingles(text, words)
    if not own:
        return None
    minima = [None] * bins
    for s in own:
        h = mix(sum(word(w) * pow(textarrays.STEP, j, 1 << 64) for j, w in enumerate(s)) & mask)
        b, rest = h >> 55, h & (2**55 - 1)
        minima[b] = rest if minima[b] is None else min(minima[b], rest)
    filled = list(minima)
    for b in range(bins):
        i = 0
        while filled[b] is None:
            filled[b] = minima[mix((b << 32) + i) % bins]
            i += 1
    return [x % 2**bits for x in filled]


def test_fingerprints_against_direct_computation(spark):
    texts = [t for t in H.awkward_texts() if t is None or len(t) < 5000] + [""]
    docs = H.documents(spark, texts)
    rows = sorted(((-1 if i is None else i, t or "") for i, t in docs.select("doc_id", "text").collect()), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in minhash.edit_fingerprints(docs).where("doc_id IS NOT NULL").collect()}

    def packed(x):
        return "" if x is None else bytes(x[i] | x[i + 1] << 4 for i in range(0, len(x), 2)).hex()

    def like(x, y):
        if x is None or y is None:
            return float(x is y)
        return max(0.0, (sum(a == b for a, b in zip(x, y)) / len(x) - 1 / 16) / (15 / 16))

    for k, (i, t) in enumerate(rows):
        if i >= 0:
            after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
            a, e, n = (fingerprint_directly(x) for x in (t, t[: len(t) - half] + after[:half], after))
            r = got[i]
            assert r["fingerprint"] == packed(a)
            if i != 6:  # of its two rows one is edited with the other
                assert r["edited_fingerprint"] == packed(e)
                assert (r["near_edited"], r["near_next"]) == (pytest.approx(like(a, e)), pytest.approx(like(a, n)))


def test_many_rows_of_one_id(spark):
    """They spread over ranges; every row is edited with its follower in one round."""
    rows = [(None if i % 3 else i, f"w{i} " * 9) for i in range(500)] + [(None, "same words " * 5)] * 200
    got = minhash.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == 700 and len({r["edited_sha256"] for r in got}) > 490


def test_with_fingerprint_keeps_rows(spark):
    docs = H.documents(spark, H.awkward_texts())
    got = minhash.with_fingerprint(docs)
    assert got.columns == [*docs.columns, "fingerprint"] and got.count() == docs.count()


def components(texts, k, num, den):
    sets = {i: H.shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(seed):
    """Groups of copies that differ by a few words, at similarities around the threshold."""
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        base = H.prose(rng, rng.randrange(5, 120)).split(" ")
        for _ in range(rng.randrange(1, 12)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = H.prose(rng, 1)
            texts.append(" ".join(own))
    common = H.prose(rng, 40)  # a passage that many documents share
    return texts + [common + " " + H.prose(rng, rng.randrange(1, 90)) for _ in range(25)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_against_all_pairs(spark, seed):
    texts = dict(enumerate(variants(seed) + ["", None, "a b", "a b", "a B c"]))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, node string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == components(texts, 4, 85, 100)


def test_join_moves_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MIN_FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", 300)
    texts = dict(enumerate(variants(9)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, 5, 80, 100).collect()}
    assert got == components(texts, 5, 80, 100)


@pytest.mark.parametrize("block", [4096, 3])
def test_links_against_all_pairs(spark, monkeypatch, block):
    """Every link between different sets, also those derived from a representative, and lists cut into blocks."""
    monkeypatch.setattr(ngram_join, "KEY_BLOCK", block)
    texts = dict(enumerate(variants(4) + ["", None, "a b", "a b", "A B"]))
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, comp int").repartition(4)
    links, members = ngram_join.jaccard_links(docs, 4, 75, 100)
    of = {r["doc_id"]: r["class"] for r in members.collect()}
    sets = {i: H.shingles(t, 4) for i, t in texts.items()}
    assert {r["doc_id"]: r["n_shingles"] for r in members.collect()} == {i: len(x) for i, x in sets.items()}
    assert len({of[i] for i in sets if sets[i]}) == len({frozenset(x) for x in sets.values() if x})
    expected = {(*sorted((of[a], of[b])), len(sets[a] & sets[b])) for a in sets for b in sets if sets[a] and of[a] != of[b] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 20
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, 4, 75, 100).collect()}
    assert got == components(texts, 4, 75, 100)
    assert [x.count() for x in ngram_join.jaccard_links(docs.limit(0))] == [0, 0]


def test_join_with_awkward_rows(spark):
    texts = H.awkward_texts()
    docs = H.documents(spark, texts)
    got = ngram_join.jaccard_components(docs, 4, 85, 100).toPandas()
    assert len(got) == docs.count()
    expected = components(dict(enumerate(texts)), 4, 85, 100)
    known = got[got.doc_id.notna()]
    assert all((n, c) == expected[i] for i, n, c in zip(known.doc_id.astype(int), known.n_shingles, known.component_id))
    assert got[got.doc_id.isna()].component_id.tolist() == [expected[9][1]]
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    kept = ngram_join.one_per_group(docs, 4, 85, 100)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({c for i, (n, c) in expected.items() if n} | {i for i, (n, _) in expected.items() if not n})


def test_one_per_group_without_or_with_repeated_ids(spark):
    """Only linked rows go: not others without an id, nor other texts under the same id."""
    rng = random.Random(12)
    a, b, c, d, e = (H.prose(rng, 60) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, ""), (None, None), (None, c), (None, c + " end"), (7, d), (7, e), (7, a), (8, d), (9, ""), (9, ""), (3, b)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _row int").repartition(3)
    got = ngram_join.one_per_group(docs, 4, 85, 100)
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    kept_c = [r for r in left if r in [(None, c), (None, c + " end")]]
    assert len(kept_c) == 1
    expected = [(1, a), (3, b), (None, ""), (None, None), *kept_c, (7, d), (7, e), (9, ""), (9, "")]
    assert sorted(left, key=str) == sorted(expected, key=str)
