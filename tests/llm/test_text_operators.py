"""Quality, scores, token ids, licenses and byte-level BPE on small tables."""

import collections
import itertools
import hashlib
import math
import os
import random
import zlib

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, context_mixing, license_texts, licenses, quality, token_files
from graphloom.sources.shared_storage import new_path

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


# ---- quality


def labelled(spark, n=240):
    rng = random.Random(3)
    good = [H.prose(rng, rng.randrange(20, 300)) + "." for _ in range(n)]
    texts = [t if i % 3 else " | ".join(w + "!!" for w in t.upper().split()) for i, t in enumerate(good)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)] + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    return docs, labels


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    held = quality.in_fold("doc_id", 4, 2)
    net = quality.train(docs, labels, ~held)
    scored = quality.score(docs.withColumn("held", held), net).toPandas()
    own = scored[scored.held]
    assert len(own) > 30 and ((own.score >= 0.5) == (own.doc_id % 3 > 0)).mean() > 0.95
    again = quality.score(docs.repartition(7), quality.train(docs.repartition(3), labels, ~held)).toPandas()
    assert dict(zip(scored.doc_id, scored.score)) == dict(zip(again.doc_id, again.score))
    assert [r["held"] for r in docs.withColumn("held", held).orderBy("doc_id").collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(docs.count())]


def test_quality_of_awkward_rows(spark):
    docs, labels = labelled(spark, 60)
    net = quality.train(docs, labels)
    rows = H.documents(spark, H.awkward_texts())
    got = quality.score(rows, net)
    assert got.columns == [*rows.columns, "score"] and got.count() == rows.count()
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score(rows.limit(0), net).count() == 0
    blank = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, blank).collect()} == {0.5}


def test_document_vectors_cover_whole_texts():
    rng = np.random.default_rng(0)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), np.zeros((2, quality.FILTERS)), 0.0)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 3, 4, 127, 128, 129, 700, 40_000, 0, 5)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    mean, most = quality.document_vectors(net, np.concatenate(texts), offsets)
    for t, m, b in zip(texts, mean, most):
        chunks = []
        for s in range(0, len(t), quality.STEP) if len(t) >= quality.WIDTH else ():
            c = t[s : s + 2 * quality.STEP + quality.WIDTH - 1]  # filters start at 2 * STEP places
            v = [sum(net.filters[w][c[i + w]] for w in range(quality.WIDTH)) for i in range(len(c) - quality.WIDTH + 1)]
            chunks.append(np.maximum(np.max(v[: 2 * quality.STEP], axis=0), 0) if v else np.zeros(quality.FILTERS))
        chunks = np.array(chunks) if chunks else np.zeros((1, quality.FILTERS))
        assert np.allclose(m, chunks.mean(0), atol=1e-3) and np.allclose(b, chunks.max(0), atol=1e-3)


def test_training_sees_whole_texts(spark):
    """What tells good texts from bad may stand anywhere: here only behind the first 20,000 characters."""
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(120):
        words = H.prose(rng, 4000)
        rows.append((i, words + (" #!$%&*#!$%&*" * 40 if i % 2 else " " + H.prose(rng, 60))))
        labels.append((i, 1 - i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.score(docs, net).toPandas()
    assert ((got.score >= 0.5) == (got.doc_id % 2 == 0)).mean() > 0.95


def test_training_bound_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_BYTES", 20_000)
    docs, labels = labelled(spark, 90)
    net = quality.train(docs.unionAll(docs), labels)
    assert quality.score(docs, net).where("score BETWEEN 0 AND 1").count() == 90
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.append([t.tobytes().decode() for t in texts]) or net)
    size = {r["text"]: len(r["text"].encode()) for r in docs.where("text > ''").collect()}
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 1 << 30)
    quality.train(docs, labels)
    some, every = seen
    assert some == every[: len(some)] and sum(size[t] for t in some[:-1]) < 20_000 <= sum(size[t] for t in some)  # none left out for its length


# ---- language-model scores


def test_base_scores(spark):
    texts = H.awkward_texts()
    docs = H.documents(spark, texts)
    held = quality.in_fold("doc_id", 10, 0)
    got = context_mixing.lm_scores(docs, ~held).toPandas()
    assert len(got) == docs.count()
    counts, rows = collections.Counter(), [(r["doc_id"], [*H.words(r["text"]), None]) for r in docs.collect()]
    for i, tokens in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((-1 if i is None else i, len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 4)) for i, t in rows)
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.n_tokens, got.n_known, got.train_tokens, got.base_score.round(4))) == expected
    assert (got.score < 0).all() and (got.bits_per_byte > 0).all()
    by_id = got.groupby("doc_id").score.nunique()
    assert (by_id == 1).all()  # equal texts have equal scores, wherever they stand
    assert context_mixing.lm_scores(docs.limit(0), ~held).count() == 0
    nothing = context_mixing.lm_scores(docs, F.lit(None).cast("boolean")).toPandas()
    assert len(nothing) == len(got) and (nothing.n_known == 0).all() and (nothing.train_tokens == 0).all() and (nothing.score < 0).all()


def scored_directly(code, texts, training):
    """ln probability of each text, symbol by symbol, with contexts and counts in dictionaries."""
    m = context_mixing
    known = {int(h): i for i, h in enumerate(code.hashes)}
    often = {w: int(code.counts[known[h]]) for t in texts for w in H.words(t) if (h := int(licenses.template_hashes(w)[0])) in known}
    path = lambda s: [(int(code.nodes[code.starts[s] + d]), int(code.bits[code.starts[s] + d]), float(code.odds[code.starts[s] + d])) for d in range(code.lengths[s])]

    def steps(text):  # symbol, contexts from short to long, the text's own context
        out, words = [], H.words(text)
        for k, w in enumerate([*words, None]):
            before = ("word", words[k - 1] if k else None)
            own = (words[k - 1] if k else None, words[k - 2] if k > 1 else None)
            h = None if w is None else int(licenses.template_hashes(w)[0])
            symbol = code.end if w is None else known.get(h, code.end + 1)
            frequent = k > 1 and often.get(words[k - 2], 0) >= m.FREQUENT * code.tokens
            out.append((symbol, [before, own if frequent else before], own))
            if symbol == code.end + 1:
                b = w.encode()
                for j in range(len(b) + 1):
                    out.append((code.end + 2 + (b[j] if j < len(b) else 256), [("bytes", b[max(0, j - n) : j]) for n in m.BYTES_BEFORE], b[:j]))
        return out

    turns = collections.defaultdict(lambda: [0, 0])
    for text, learn in zip(texts, training):
        if learn:
            for symbol, contexts, _ in steps(text):
                for c in dict.fromkeys(contexts):
                    for node, bit, _ in path(symbol):
                        turns[c, node][bit] += 1

    def odds(contexts, node, bit, base):
        share = 1 / (1 + math.exp(-base))
        out = []
        for n, c in enumerate(contexts):
            if n and c == contexts[n - 1]:
                out.append(out[-1])
                continue
            zero, one = turns.get((c, node), (0, 0))
            byte = m.turn_codes(np.array([one]), np.array([zero]))[0]
            byte = byte if bit else m.OTHER_WAY[byte]
            on, off = m.TURN_ON[byte] + m.BACK_OFF * share, m.TURN_OFF[byte] + m.BACK_OFF * (1 - share)
            share = on / (on + off)
            out.append(math.log(on / off))
        return out

    results = []
    for text in texts:
        follows, run, at, total = {}, 0, 0, 0.0
        weights, bend = collections.defaultdict(lambda: list(m.FIRST_WEIGHTS)), collections.defaultdict(lambda: m.WEIGHT_PRIOR)
        tilt, tilt_bend = collections.defaultdict(float), collections.defaultdict(lambda: m.MAP_PRIOR)
        all_steps = steps(text)
        cuts = [0]
        while cuts[-1] < len(all_steps):
            cuts.append(m.next_cut(cuts[-1]))
        for cut, end in itertools.pairwise(cuts):
            events = []
            for symbol, contexts, own in all_steps[cut:end]:
                guess, agreed = follows.get(own), True
                for d, (node, bit, base) in enumerate(path(symbol)):
                    x = [base, *odds(contexts, node, bit, base)]
                    x = x if len(x) == 3 else x[1:]
                    said, state = 0.0, 0
                    if guess is not None and agreed and d < code.lengths[guess]:
                        right = path(guess)[d][1] == bit
                        said, state, agreed = m.MATCH_ODDS[run] * (1 if right else -1), max(run, 1), right
                    gate = (node >= len(code.hashes) + 1, min(d // 3, m.DEPTHS - 1), state)
                    z = max(-11.9, min(11.9, sum(w * v for w, v in zip(weights[gate], [*x, said]))))
                    sign = math.copysign(1, z)
                    bucket = int(abs(z) * (m.BUCKETS / 12))
                    z += sign * tilt[bucket]
                    chance = 1 / (1 + math.exp(-z))
                    total += math.log(chance)
                    events.append((gate, [*x, said], chance, bucket, sign))
                run = min(run + 1, m.RUNS - 1) if guess == symbol else 0
                follows[own] = symbol
            gains, maps = collections.defaultdict(lambda: [0.0] * m.INPUTS), collections.defaultdict(float)
            for gate, x, chance, bucket, sign in events:
                bend[gate] += chance * (1 - chance) * sum(v * v for v in x)
                gains[gate] = [g + (1 - chance) * v for g, v in zip(gains[gate], x)]
                tilt_bend[bucket] += chance * (1 - chance)
                maps[bucket] += (1 - chance) * sign
            for gate, gain in gains.items():
                weights[gate] = [w + g / bend[gate] for w, g in zip(weights[gate], gain)]
            for bucket, gain in maps.items():
                tilt[bucket] += gain / tilt_bend[bucket]
        results.append(total)
    return results


@pytest.mark.parametrize("block", [2 << 20, 900])
def test_scores_against_direct_computation(spark, monkeypatch, block):
    """Counts gathered by Spark and mixing in arrays give what dictionaries and a loop over bits give."""
    monkeypatch.setattr(context_mixing, "BLOCK_BYTES", block)
    monkeypatch.setattr(context_mixing, "BUNDLE", 2)
    monkeypatch.setattr(context_mixing, "VOCABULARY", 24)
    rng = random.Random(21)
    texts = [H.prose(rng, rng.randrange(1, 120)) for _ in range(14)] + [None, "", "é 日本 x", "the the the the the the"]
    texts += [texts[3], texts[5] + " " + texts[5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learn = F.col("doc_id") % 4 != 0
    got = {r["doc_id"]: (r["score"], r["bits_per_byte"]) for r in context_mixing.lm_scores(docs, learn).collect()}
    code = context_mixing.train(docs, learn)
    expected = scored_directly(code, texts, [i % 4 != 0 for i in range(len(texts))])
    for i, ln in enumerate(expected):
        assert got[i][0] == pytest.approx(ln / math.log(10), rel=2e-3)
        assert got[i][1] == pytest.approx(-ln / math.log(2) / max(1, len((texts[i] or "").encode())), rel=2e-3)


def test_paths_make_a_prefix_code():
    rng = np.random.default_rng(3)
    code = context_mixing.make_code(np.sort(rng.integers(0, 2**63, 500).astype(np.uint64)), rng.integers(1, 10**9, 500), rng.integers(0, 10**6, 256), 10**12, 10**6, 1000)
    words = 502
    assert abs(sum(2.0 ** -code.lengths[:words]) - 1) < 1e-9 and abs(sum(2.0 ** -code.lengths[words:]) - 1) < 1e-9
    a, b = rng.integers(0, words, 400), rng.integers(0, words, 400)
    a, b = a[a != b], b[a != b]
    shared = context_mixing.shared_turns(code, a, b)
    for x, y, n in zip(a, b, shared):
        p, q = (code.bits[code.starts[s] : code.starts[s] + code.lengths[s]].tolist() for s in (x, y))
        assert p[:n] == q[:n] and p[n] != q[n]


def test_orders_of_packed_keys():
    """Keys whose leading bits agree are put in order by all bits, and equal ones stay in place."""
    rng = np.random.default_rng(9)
    top = rng.integers(0, 5, 3000).astype(np.uint64) << np.uint64(60)
    for keys in (top + rng.integers(0, 50, 3000).astype(np.uint64), rng.integers(0, 2**64, 3000, dtype=np.uint64), top):
        assert np.array_equal(context_mixing.order_of(keys), np.argsort(keys, kind="stable"))
    assert np.array_equal(context_mixing.order_of(np.array([5, 1, 5, 0], np.uint64), 3), [3, 1, 0, 2])


def test_pairs_are_sorted_once(monkeypatch):
    """Numbers of pairs are right where leading bits stand for several contexts; equal contexts are left out of the sort."""
    m = context_mixing
    rng = np.random.default_rng(4)
    near = rng.integers(0, 3, 5000).astype(np.uint64) << np.uint64(60) | rng.integers(0, 1 << 22, 5000).astype(np.uint64)
    for keys in (near, near[:1], near[:0], rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(0, 9, 3000).astype(np.uint64)):
        place, number = m._dense_pairs(keys)
        distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
        assert np.array_equal(place, first) and np.array_equal(number, of) and np.array_equal(keys[place], distinct)
    data = np.frombuffer(b"ab abc the " * 50, np.uint8)
    hashes = np.sort(licenses.template_hashes("the"))
    code = m.make_code(hashes, np.array([50]), np.bincount(data, minlength=256), 151, 4, 1)
    s = m.stream(code, data, np.array([0, len(data)]))
    sorted_keys = []
    monkeypatch.setattr(m, "_dense_pairs", lambda keys, plain=m._dense_pairs: sorted_keys.append(len(keys)) or plain(keys))
    p = m.pairs(code, s)
    symbols = np.concatenate([s.symbols, s.symbols, s.symbols[s.at_byte]])
    keys = np.concatenate(s.contexts) >> m.LEAF_BITS << m.LEAF_BITS | code.leaf[symbols].astype(np.uint64)
    distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
    assert np.array_equal(p.keys, distinct) and np.array_equal(p.place, first) and np.array_equal(p.of, of) and np.array_equal(p.symbols, symbols[first])
    assert sorted_keys[0] < len(keys)


def test_nodes_of_a_context_are_coded_once(monkeypatch):
    """A context with very many followers takes work by its nodes, and not by all steps of all their paths."""
    m = context_mixing
    n = 3000
    code = m.make_code(np.arange(n).astype(np.uint64), np.full(n, 5), np.ones(256, np.int64), 6 * n, n + 1, 9)
    keys = np.sort(np.concatenate([np.uint64(7) << m.LEAF_BITS | code.leaf[:n].astype(np.uint64), np.uint64(8) << m.LEAF_BITS | code.leaf[:3].astype(np.uint64)]))
    coded = []
    monkeypatch.setattr(m, "turn_codes", lambda on, off, plain=m.turn_codes: coded.append(len(on)) or plain(on, off))
    counts = np.arange(len(keys)).astype(np.uint32) % 7
    runs, of = m.answers(code, keys, counts)
    assert sum(coded) < 3 * len(keys) and np.array_equal(of, np.arange(len(keys)))
    symbols = code.of_leaf[(keys & np.uint64((1 << 17) - 1)).astype(np.int64)]
    sums = collections.defaultdict(lambda: [0, 0])
    for context, symbol, c in zip(keys >> m.LEAF_BITS, symbols, counts):
        for d in range(code.lengths[symbol]):
            at = code.starts[symbol] + d
            sums[context, code.nodes[at]][code.bits[at]] += int(c)
    for i in [0, 1, 2, 3, 4, 5, n // 2, n, n + 1, n + 2]:
        at = code.starts[symbols[i]] + np.arange(code.lengths[symbols[i]])
        zero, one = np.array([sums[keys[i] >> m.LEAF_BITS, node] for node in code.nodes[at]]).T
        assert np.array_equal(runs.values[runs.starts[i] : runs.starts[i] + runs.lengths[i]], m.turn_codes(one, zero))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_model_beats_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = quality.in_fold("doc_id", 10, 0)
    r = context_mixing.lm_scores(docs, ~held).where(held).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > 0.85 * r["b"]


@pytest.mark.parametrize("longest", [16, 4096])
def test_segments_against_direct_computation(monkeypatch, longest):
    monkeypatch.setattr(context_mixing, "LONGEST_SEGMENT", longest)
    rng = random.Random(longest)
    texts = [H.prose(rng, rng.randrange(1, 400)) for _ in range(6)] + [""]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    words = [w for t in texts for w in H.words(t)]
    hashes, counts = np.unique(np.concatenate([licenses.template_hashes(w) for w in words]), return_counts=True)
    few = counts >= np.sort(counts)[-10]
    code = context_mixing.make_code(hashes[few], counts[few], np.bincount(data, minlength=256), len(words) + 7, len(hashes) + 1, 7)
    s = context_mixing.stream(code, data, offsets)
    p = context_mixing.pairs(code, s)
    runs, _ = context_mixing.answers(code, p.keys, context_mixing.training_counts(s, p, np.ones(7, np.uint8)))
    runs.values = np.where(code.bits[context_mixing._paths(code.starts[p.symbols], runs.lengths)] == 1, runs.values, context_mixing.OTHER_WAY[runs.values])
    assert context_mixing.mixed(code, s, p, runs) == pytest.approx(scored_directly(code, texts, [True] * 7), rel=1e-4)


def test_segments_have_no_end():
    """A text of five million symbols is learned from to its end: what repeats only there gets cheap."""
    cut = 0
    while cut < 9_000_000:
        assert 0 < context_mixing.next_cut(cut) - cut <= context_mixing.LONGEST_SEGMENT
        cut = context_mixing.next_cut(cut)
    rng = np.random.default_rng(2)
    words = np.array([b"aa ", b"bb ", b"cc ", b"dd "])
    text = b"".join(words[rng.integers(0, 4, 4_600_000)]) + b"aa bb " * 200_000
    data = [np.frombuffer(t, np.uint8) for t in (text, text + b"aa bb " * 50_000)]
    hashes = np.sort(np.concatenate([licenses.template_hashes(w.decode()) for w in words]))
    code = context_mixing.make_code(hashes, np.array([9, 9, 9, 9]), np.ones(256, np.int64), 40, 5, 4)
    ln = []
    for d in data:
        s = context_mixing.stream(code, d, np.array([0, len(d)]))
        p = context_mixing.pairs(code, s)
        runs, of = context_mixing.answers(code, p.keys, np.zeros(len(p.keys), np.uint32))
        assert np.array_equal(of, np.arange(len(p.keys)))
        ln.append(context_mixing.mixed(code, s, p, runs)[0])
    assert len(s.symbols) > 5_000_000 and (ln[0] - ln[1]) / 100_000 < 0.05


# ---- token files


def test_token_files(spark, tmp_path):
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    texts = H.awkward_texts() + ["<|endoftext|> x", "don't I'LL '", "ΑΣ ΣΑΣ. İ"]
    docs = H.documents(spark, texts)
    got = token_files.token_file_digests(docs, path, 2).toPandas()
    rows = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.collect()))
    start, expected = 0, []
    for i, t in rows:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.start, got.n_tokens, got.ids_crc32)) == expected
    assert token_files.token_file_digests(docs.limit(0), path, 2).count() == 0


def test_memory_of_words_keeps_the_first(monkeypatch):
    """Latin words are encoded as in whole texts, and words met first stay known when the memory is full."""
    monkeypatch.setattr(token_files, "MEMO_WORDS", 200)
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read())
    assert encoder.plain and encoder.latin
    letters = [chr(c) for c in range(0x80, 0x250)]
    first = ["the", "été", "ÉTÉ.", "straße,", "Œuvre.", "…."]
    texts = [" ".join(first), *(f"{c} a{c}b {c}. x{c}, {c.upper()}{c}." for c in letters), "İstanbul ǅ ﬁn e\u0301. ə. ΑΣ.", " ".join(first)]
    for text in texts:
        ids, n = encoder.encode([text.encode()])
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)], text
        assert all(w.encode() in encoder.words for w in first if w.isascii())
        assert len(encoder.words) == len(encoder.word_ids.lengths) < 300


def test_dictionaries_of_any_corpus(spark):
    """Pieces come from everywhere in long texts, and a few short texts give a dictionary too."""
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
        description = f.read()
    few = token_files.train_dictionary(H.documents(spark, ["a few words", None, ""], extra=False), description, 2)
    assert 0 < len(few) < 200
    assert token_files.train_dictionary(H.documents(spark, [None, ""], extra=False), description, 2) == b""
    rng = random.Random(2)
    mark = " xylophone quixotic zephyr"
    texts = [H.prose(rng, 3000) + mark * 300 for _ in range(30)]
    one = token_files.train_dictionary(H.documents(spark, texts, extra=False), description, None)
    ids = tokenizers.Tokenizer.from_str(description).encode(mark, add_special_tokens=False).ids
    assert np.array(ids, "<u4").tobytes() in one


def test_a_hot_id_spreads_over_files(spark):
    rows = [(None if i % 2 else i, f"text {i}") for i in range(600)] + [(None, "same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    files, _ = token_files.write_token_files(docs, public.path("word_bpe_49k.json"), new_path(spark, "test-hot"), 2)
    sizes = sorted(r["documents"] for r in files.collect())
    assert sum(sizes) == 900 and len(sizes) == 4 and sizes[-1] < 400


def test_short_document_access(tmp_path):
    documents = [(i, np.arange(i * 3, dtype="<u4")) for i in range(50)]
    dictionary = b""
    path = f"{tmp_path}/x.gltok"
    assert token_files.write_file(path, dictionary, iter(documents)) == (50, sum(3 * i for i in range(50)))
    some = list(token_files.read_file(path, dictionary, [0, 7, 8, 49], step=100))
    assert [i for i, _ in some] == [0, 7, 8, 49] and all(np.array_equal(ids, documents[i][1]) for i, ids in some)
    with pytest.raises(ValueError, match="dictionary"):
        list(token_files.read_file(path, b"another"))


# ---- licenses


def passages_of(text, name, template):
    """All passages by direct comparison of words, without windows or hashes."""
    w, t = H.words(text), H.words(template)
    k = min(len(t), licenses.WORDS)
    own = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)} if t else set()
    hits = [(i, tuple(w[i : i + k])) for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in own] if own else []
    needed, longest = math.ceil(licenses.CONTAINMENT * len(own)), max(len(t), len(t) * 5 // 4)
    out, i = [], 0
    while i < len(hits):
        reach = [h for h in hits[i:] if h[0] + k <= hits[i][0] + longest]
        if len({s for _, s in reach}) < needed:
            i += 1
            continue
        most = next(n for n in range(1, len(reach) + 1) if {s for _, s in reach[:n]} == {s for _, s in reach})
        found = reach[:most]
        i += most
        share = len({s for _, s in found}) / len(own)
        while found[0][1] in [s for _, s in found[1:]]:
            found = found[1:]
        out.append((name, found[0][0], found[-1][0] + k, round(share, 9)))
    return out


@pytest.mark.parametrize("group", [20_000, 7])
def test_license_scan_against_direct_comparison(spark, monkeypatch, group):
    monkeypatch.setattr(licenses, "GROUP", group)
    rng = random.Random(4)
    texts = [t for t in H.awkward_texts() if t is None or len(t) < 9000]
    rows = [*license_texts.ROWS, ("two", "one two"), ("single", "tu"), ("none", ""), (None, "x y z w")]
    for name, notice in rows[:-2]:
        words = notice.split()
        dropped = " ".join(w for w in words if rng.random() > 0.04)  # a few words lost
        for body in (notice, notice.upper(), f"{notice} {notice}", f"{notice} {H.prose(rng, 30)} {dropped} {notice}"):
            texts.append(" ".join([H.prose(rng, rng.choice([0, 1, 7, 150])), body, H.prose(rng, rng.randrange(0, 40))]).strip())
    docs = H.documents(spark, texts)
    templates = spark.createDataFrame(rows + rows[:5], "license string, text string")
    got = collections.Counter((r["doc_id"], r["license"], r["first_word"], r["end_word"], round(r["containment"], 9)) for r in licenses.scan(docs, templates).collect())
    expected = collections.Counter((r["doc_id"], *p) for r in docs.collect() for name, notice in rows if name for p in passages_of(r["text"], name, notice))
    assert got == expected and len(expected) > 300
    mit = [r for r in expected if r[1] == "MIT"]
    assert {r[4] for r in mit} > {1.0} and len(mit) > 20
    assert licenses.scan(docs.limit(0), templates).count() == 0 == licenses.scan(docs, templates.limit(0)).count()


def test_adjacent_notices_are_apart():
    notice = "Released under the MIT License."
    t = licenses.Templates([("MIT", notice)], 3)
    import pyarrow as pa

    text = " ".join(["a b", notice, notice, "c", notice])
    assert [x[2:4] for x in licenses.scan_block(pa.array([text]), [t])] == [(2, 7), (7, 12), (13, 18)]


def test_bands_reach_their_probability():
    rng = np.random.default_rng(5)
    bands = licenses.n_bands(0.3, 0.01)
    missed = 0
    for _ in range(400):
        a = rng.integers(0, 2**63, 13).astype(np.uint64) * np.uint64(2)
        b = np.concatenate([a[:6], rng.integers(0, 2**63, 7).astype(np.uint64) * np.uint64(2)])  # 6 of 20
        missed += not any((a * licenses.seed(i)).min() == (b * licenses.seed(i)).min() for i in range(bands))
    assert missed < 20


# ---- byte-level BPE


def test_byte_bpe_against_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = byte_bpe.public_ranks()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = H.awkward_texts() + ["don't I'LL we've  x", "  \n\n \t x ", "ｱ١٢٣Ⅷ²³½", "<|endoftext|>", "a\n b\n\nc   d"]
    docs = H.documents(spark, texts)
    got = byte_bpe.digests(docs, ranks, pattern).toPandas()
    expected = []
    for r in docs.collect():
        t = r["text"] or ""
        ids = encoding.encode_ordinary(t)
        expected.append((-1 if r["doc_id"] is None else r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.n_tokens, got.ids_sha256, got.decoded_sha256)) == sorted(expected)
    assert byte_bpe.digests(docs.limit(0), ranks, pattern).count() == 0


def test_offsets_cover_split_characters(spark):
    ranks, pattern = byte_bpe.public_ranks()
    texts = ["aé🤗 b", "", "日本語 xyz", None]
    rows = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks, pattern, offsets=True)
    for r in byte_bpe.decode(rows, ranks).collect():
        t = texts[r["doc_id"]] or ""
        assert r["decoded"].decode() == t
        assert all(0 <= a < b <= len(t) for a, b in zip(r["starts"], r["ends"]))
        assert set(range(len(t))) == {p for a, b in zip(r["starts"], r["ends"]) for p in range(a, b)}
    odd = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert byte_bpe.decode(odd, ranks).first()["decoded"] == b""
    clash = spark.createDataFrame([("ab", 1, "x", None)], "text string, __text int, _text string, ids int")
    got = byte_bpe.encode(clash, ranks, pattern)
    assert got.columns == ["__text", "_text", "ids"] and [got.first()[c] for c in ("__text", "_text")] == [1, "x"]
