"""Mixing, search, archives and the whole pipeline."""

import base64
import gzip
import hashlib
import json
import os
import random
import struct
import zipfile

import duckdb
import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import ball_tree, byte_bpe, mixing, quality, registry, warc
from graphloom.sources.shared_storage import new_path, write_shared

SF_DIR = "/root/testdata/sf0.001"


# ---- mixing


def test_mix_matches_sql(spark, tmp_path):
    docs = H.documents(spark, H.awkward_texts())
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    theirs = con.sql(mixing.ORACLE_SQL["op4_mix_sources"]).fetchall()
    ours = [tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(ours, key=str) == sorted(theirs, key=str)


def test_mix_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, H.prose(rng, rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", None]), "clash") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(6)
    got = mixing.mix(docs).toPandas()
    assert (got["size"].to_numpy() == [len(H.words(rows[i][1])) for i in got.doc_id]).all()
    total = got["size"].sum()
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"), own=("size", "sum"))
    assert (by["size"] == by.own).all() and (by.target <= 2 * by["size"]).all()
    assert abs(by.target.sum() - 1.5 * total) < 1e-6 * total and (np.floor(by.target) == by.taken).all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    again = mixing.mix(docs.repartition(2)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    repeated = mixing.mixed_rows(docs)
    times = repeated.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    for r in got.itertuples():
        assert times.get(r.doc_id, 0) >= -(-r.taken // r.size) if r.size else True
    assert repeated.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_all_sources_empty(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixing.mix(docs).select("size", "target", "taken").collect()} == {(0, 0.0, 0)}


# ---- search


@pytest.mark.parametrize("shape", ["spread", "ties"])
def test_top_k_against_all_products(spark, monkeypatch, shape):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 30)
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", 8)
    monkeypatch.setattr(ball_tree, "SHARD_BYTES", 40 * 6 * 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6)) if shape == "spread" else rng.integers(-1, 2, (300, 6)) / 4
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(1000, None, ""), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (1040, [float("nan")] * 6, ""), (1060, [float("inf")] * 6, ""), (1080, [], ""), (None, [1.0] * 6, ""), (1100, [2.0, 1.0], ""), (1101, [1.0, 1.0], "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    vectors = ball_tree.integer_vectors(table)
    got = {tuple(r) for r in ball_tree.top_k(vectors, F.col("vec_id") % 20 == 0, 20).collect()}
    v = np.floor(64 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    expected = {(1100, 1, 1101, 128 * 64 + 64 * 64)}
    for q in range(0, 300, 20):
        score = v @ v[q]
        order = [j for j in np.lexsort((np.arange(300), -score)) if j != q][:20]
        expected |= {(q, r + 1, int(j), int(score[j])) for r, j in enumerate(order)}
    assert got == expected
    assert ball_tree.top_k(vectors.limit(0), F.col("vec_id") > 0, 20).count() == 0
    assert ball_tree.top_k(vectors, F.lit(None).cast("boolean"), 20).count() == 0


def test_top_k_beside_a_very_long_vector(spark, monkeypatch):
    """Scores beyond double precision: the other candidates keep their places."""
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 40)
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", 8)
    x = np.random.default_rng(7).normal(size=(120, 4)).astype(np.float32)
    x[17] = 1e13
    vectors = ball_tree.integer_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    got = {tuple(r) for r in ball_tree.top_k(vectors, F.col("vec_id") % 20 == 0, 9).collect()}
    v = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    expected = set()
    for q in range(0, 120, 20):
        score = v @ v[q]
        order = [j for j in np.lexsort((np.arange(120), ~score)) if j != q][:9]
        expected |= {(q, r + 1, int(j), int(score[j])) for r, j in enumerate(order)}
    assert got == expected


def test_top_k_of_repeated_and_huge_vectors(spark, monkeypatch):
    """Rows of one vec_id are candidates and queries of their own; scores beyond 64 bits stop at the ends."""
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 10)
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3)).round(2)
    x[5], x[40], x[41] = 1e30, -1e30, 3e17
    ids = [i % 25 for i in range(60)]
    vectors = ball_tree.integer_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in ball_tree.top_k(vectors, F.col("vec_id") % 20 == 0, 7).collect())
    top = 2**63 - 1
    v = [[max(-top, min(top, int(np.floor(64 * c)) if abs(c) < 1e17 else int(64 * c))) for c in row] for row in x.tolist()]
    expected = []
    for q in range(60):
        if ids[q] % 20 == 0:
            score = [(-max(-top, min(top, sum(a * b for a, b in zip(v[q], v[j])))), ids[j]) for j in range(60) if j != q]
            expected += [(ids[q], r + 1, i, -s) for r, (s, i) in enumerate(sorted(score)[:7])]
    assert got == sorted(expected)


# ---- archives


def pages(spark):
    rows = [(1, "http://a/x y", "p"), (2, None, "p"), (3, "u\r\nz", None), (4, "é", ""), (5, "u", "日本" * 40_000), (None, "u", "p"), (2, "u", "p"), (7, "u", "q")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, leader int")


@pytest.mark.parametrize("least", [0, 1])
def test_archives_round_trip(spark, least):
    got = warc.read_archives(warc.write_archives(pages(spark), new_path(spark, "test-warc"), least))
    table = [(r["page_id"], (r["html"] or "").encode()) for r in pages(spark).collect()]
    expected, led = [], set()
    for i, payload in table:
        lead = max((j for j, p in table if p == payload and j is not None), default=None)
        repeated = sum(p == payload for _, p in table) > 1 and len(payload) >= least
        again = repeated and lead is not None and (lead != i or payload in led)
        led |= {payload} if lead == i else set()
        expected.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", lead if again else None))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert warc.read_archives(warc.write_archives(pages(spark).limit(0), new_path(spark, "test-warc"))).count() == 0


def test_many_repeated_payloads(spark, monkeypatch):
    """Beyond the bound of the broadcast leaders are joined by row, with the same records."""
    few = sorted(map(tuple, warc.read_archives(warc.write_archives(pages(spark), new_path(spark, "test-warc"))).collect()), key=str)
    monkeypatch.setattr(warc, "MAX_BROADCAST_LEADERS", 0)
    assert few == sorted(map(tuple, warc.read_archives(warc.write_archives(pages(spark), new_path(spark, "test-warc"))).collect()), key=str)


def test_reader_against_zipfile(tmp_path):
    path = f"{tmp_path}/a.wacz"
    rows = [(i, i, f"http://B.example/{i}", b"x" * i, warc.payload_digest(b"x" * i), None) for i in range(30)]
    assert warc.write_archive(path, iter(rows), "2020-01-01T00:00:00Z") == 30
    assert zipfile.ZipFile(path).testzip() is None
    assert [r["payload_bytes"] for r in warc.read_archive(path, {3, 4, 29})] == [3, 4, 29]
    with zipfile.ZipFile(path) as z:
        lines, data = z.read(warc.INDEX).decode().splitlines(), z.read(warc.DATA)
    assert lines == sorted(lines) and len(lines) == 30
    for line in lines:
        key, stamp, place = line.split(" ", 2)
        place = json.loads(place)
        assert key == f"example,b)/{place['page']}" and stamp == "20200101000000"
        own = gzip.decompress(data[int(place["offset"]) : int(place["offset"]) + int(place["length"])])
        assert own.startswith(b"WARC/1.1") and f"urn:page:{place['page']}/".encode() in own
    with zipfile.ZipFile(f"{tmp_path}/b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 100)
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(f"{tmp_path}/b.zip") as f:
        members = warc.central_directory(f)
        assert [(m.name, m.size) for m in members] == [("x", 100)]
        with pytest.raises(ValueError, match="compressed"):
            warc.stored_start(f, members[0])
    (tmp_path / "c.zip").write_bytes(b"nothing here")
    with fs.LocalFileSystem().open_input_file(f"{tmp_path}/c.zip") as f, pytest.raises(ValueError, match="ZIP"):
        warc.central_directory(f)


def test_zip64_fields(tmp_path):
    """More members than 16 bits can count make an archive with a ZIP64 end record."""
    path = f"{tmp_path}/many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(66_000):
            z.writestr(str(i), b"")
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(path) as f:
        assert [m.name for m in warc.central_directory(f)] == [str(i) for i in range(66_000)]
    whole = (tmp_path / "many.zip").read_bytes()
    for comment in (b"c" * 65_535, b"x" * 40_000 + warc.END + b"\0" * 300, warc.END * 5000):
        (tmp_path / "many.zip").write_bytes(whole[:-2] + struct.pack("<H", len(comment)) + comment)
        with fs.LocalFileSystem().open_input_file(path) as f:
            assert len(warc.central_directory(f)) == 66_000


def test_archive_of_another_writer(tmp_path):
    """Two WARC members, an index with numbers and without pages, and one member that is no index."""
    records = [gzip.compress(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {9 + i}\r\n\r\nHTTP\r\n\r\n{'y' * (i + 1)}\r\n\r\n".encode()) for i in range(4)]
    lines = [json.dumps({"offset": 0 if i % 2 == 0 else len(records[i - 1]), "length": len(records[i]), "filename": f"{'ab'[i // 2]}.warc.gz"}) for i in range(4)]
    with zipfile.ZipFile(f"{tmp_path}/other.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", records[0] + records[1])
        z.writestr("indexes/index.cdxj", "!meta 0 {}\n" + "".join(f"k{i} 2021 {line}\n" for i, line in reversed(list(enumerate(lines)))))
        z.writestr("archive/b.warc.gz", records[2] + records[3])
        z.writestr("pages/pages.jsonl", "{}")
    assert [r["payload"] for r in warc.read_archive(f"{tmp_path}/other.wacz")] == [b"y", b"yy", b"yyy", b"yyyy"]


def foreign(i):
    return gzip.compress(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {9 + i}\r\n\r\nHTTP\r\n\r\n{'y' * (i + 1)}\r\n\r\n".encode())


@pytest.mark.parametrize("front", [b"", b"#!/bin/sh\n" * 30])
def test_archives_in_folders_behind_other_bytes(tmp_path, front):
    """Members of one base name in two folders, gzipped and repeated indexes, a record that is not compressed, bytes in front of the archive."""
    plain = gzip.decompress(foreign(4))
    places = [("x/a.warc.gz", foreign(0)), ("archive/y/a.warc.gz", foreign(1)), ("only.warc.gz", foreign(2)), ("some/where/only.warc.gz", foreign(2)), ("raw.warc", plain)]
    lines = "".join(f"k{i} 2021 {json.dumps({'offset': '0', 'length': len(data), 'filename': name})}\n" for i, (name, data) in enumerate(places)).encode()
    path = f"{tmp_path}/other.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("x/a.warc.gz", foreign(0)), ("y/a.warc.gz", foreign(1)), ("only.warc.gz", foreign(2)), ("raw.warc", plain)):
            z.writestr(f"archive/{name}", data)
        z.writestr("indexes/index.cdx.gz", gzip.compress(lines[: len(lines) // 2].rpartition(b"\n")[0] + b"\n") + gzip.compress(lines))
        z.writestr("indexes/index.idx", "not read")
    with open(path, "rb") as f:
        whole = f.read()
    with open(path, "wb") as f:
        f.write(front + whole)
    assert [r["payload"] for r in warc.read_archive(path)] == [b"y", b"yy", b"yyy", b"yyyyy"]


@pytest.mark.parametrize("index, line, said", [("readme.txt", "", "no index"), ("indexes/index.cdx", "k 2021 text/html", "not CDXJ"), ("indexes/index.cdxj", 'k 2021 {"filename": "a.warc.gz", "offset": 0, "length": 1}', "several members"), ("indexes/index.cdxj", 'k 2021 {"filename": "b.warc.gz", "offset": 0, "length": 1}', "no member")])
def test_what_cannot_be_read_is_an_error(tmp_path, index, line, said):
    with zipfile.ZipFile(f"{tmp_path}/other.wacz", "w", zipfile.ZIP_STORED) as z:
        for folder in "xy":
            z.writestr(f"archive/{folder}/a.warc.gz", foreign(0))
        z.writestr(index, line + "\n")
    with pytest.raises(ValueError, match=said):
        list(warc.read_archive(f"{tmp_path}/other.wacz"))


# ---- everything together


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = write_shared(stage(spark, docs, SF_DIR), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name in ("quality_filter", "near_duplicates"):
            assert 0.6 * before < docs.count() <= before and docs.count() == docs.select("doc_id").distinct().count()
            before = docs.count()
    assert docs.count() > 0 and docs.where("n_tokens IS NULL").count() == 0


def test_pipeline_rows_against_direct_computation(spark, tmp_path):
    """Every stage by plain loops or DuckDB on awkward rows, with columns whose names clash."""
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(31)
    good = [H.prose(rng, rng.randrange(10, 200)) for _ in range(60)]
    bad = [" | ".join(w + "!!" for w in H.prose(rng, 60).upper().split()) for _ in range(30)]
    texts = good + bad + [good[4], good[5] + " end", None, "", "é 日本 🤗 x"]
    rows = [(i, t, f"s{i % 4}" if i % 7 else None, 1, "q", "t", 5) for i, t in enumerate(texts)] + [(None, good[7], "s1", 1, "q", "t", 5), (3, H.prose(rng, 50), "s1", 1, "q", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, quality string, times string, epochs int")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60)) for i in range(90)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    net = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = []
    for row in rows:
        data = np.frombuffer((row[1] or "").encode(), np.uint8)
        values = [sum(net.filters[w][data[i + w]] for w in range(quality.WIDTH)) for i in range(len(data) - quality.WIDTH + 1)]
        chunks = [np.maximum(np.max(values[i : i + 2 * quality.STEP], axis=0) + net.bias, 0) if values[i : i + 2 * quality.STEP] else np.zeros(quality.FILTERS) for i in range(0, len(data), quality.STEP)] or [np.zeros(quality.FILTERS)]
        z = np.mean(chunks, axis=0) @ net.weights[0] + np.max(chunks, axis=0) @ net.weights[1] + net.offset
        if 1 / (1 + np.exp(-z)) >= corpus_pipeline.REJECT_BELOW:
            kept.append(row)
    assert 55 < len(kept) < len(rows) - 20
    sets = [H.shingles(r[1], 5) for r in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and sets[j] and H.jaccard(sets[i], sets[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for i, r in enumerate(kept):
        key = (r[0] is None, r[0] or 0, i)
        first[group[i]] = min(first.get(group[i], (key, r)), (key, r), key=lambda x: x[0])
    left = [r for _, r in first.values()]
    assert len(left) < len(kept)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in left])
    targets = {}
    for r, (size, total, target) in zip(left, (con.execute(f"SELECT size, source_size, target FROM ({mixing.ORACLE_SQL['op4_mix_sources']}) WHERE doc_id IS NOT DISTINCT FROM ? ", [r[0]]).fetchone() for r in left)):
        targets.setdefault(r[2], (total, target))
    ranks, pattern = byte_bpe.public_ranks()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for source, (total, target) in targets.items():
        own = sorted((hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, len(H.words(r[1])), r) for r in left if r[2] == source)
        epochs, rest = divmod(int(target), total) if total else (0, 0)
        last, before = "", 0
        for key, _, size, r in own:
            last = key if size and before < rest else last
            before += size
        for key, _, _, r in own:
            ids = encoding.encode_ordinary(r[1] or "")
            out = (r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
            expected += [out] * (epochs + (key <= last))
    assert got == sorted(expected, key=str)


def test_stages_on_empty_and_extra_columns(spark, tmp_path):
    docs = H.documents(spark, H.awkward_texts()).withColumn("gone_row", F.lit(1)).withColumn("last_key", F.lit("k"))
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= 2 * max(1, some.count())
        assert corpus_pipeline.STAGES[-1][1](spark, some, str(tmp_path)).count() == some.count()


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
