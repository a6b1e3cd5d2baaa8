"""Token-id files: one zstandard dictionary for all, every document compressed by itself, an offset index.

A file holds consecutive documents in ascending doc_id order:

    magic "GLTOKID1" | u64 dictionary hash | u64 documents | frames | index | u64 start of the index

The index is four arrays of u64/i64 per document: doc_id, start of its frame, end of its frame, number of
ids. A frame is the document's ids as little-endian u32, compressed with the shared dictionary, which
lies beside the files. A reader opens a file, checks the dictionary's hash, and range-reads the frames
it wants. Files are renamed into place when complete, under names that no other attempt of a task uses; the
table of files names those of the attempts that counted.

The dictionary is trained on pieces of PIECE characters, spread evenly over all texts: those with the
smallest hashes of document and place, SAMPLE_PIECES of them. Where there is too little to train on, the
pieces' ids themselves are the dictionary.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.memo import Numbers, Runs, grouped
from graphloom.llm.textarrays import blocks, bounded_batches
from graphloom.sources.shared_storage import new_path

MAGIC = b"GLTOKID1"
HEAD = struct.Struct("<8sQQ")
#: Words that a worker keeps with their ids.
MEMO_WORDS = 400_000
#: Pieces of texts that the dictionary is trained on, characters of a piece, bytes of the dictionary at most.
SAMPLE_PIECES, PIECE, DICTIONARY_BYTES = 4096, 2048, 64 << 10
LEVEL = 1
PROBES = ["a", "the", "tokens", "xyzzyqqj", "internationalization"]
#: Behind the letters that are taken as Latin.
LATIN_END = "\u0250"


def _byte_letters() -> list[str]:
    """The letters that byte-level tokenizers write for bytes: printable ones for themselves, others from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in kept else next(rest)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


def _lettered(text: str) -> str:
    return "".join([BYTE_LETTERS[b] for b in text.encode()])


def _latin(text: str) -> bool:
    """Whether these are letters below U+0250 alone, for which all versions of Unicode in use agree; I with a dot
    above is none of them, as its lower case is a letter and a mark."""
    return text.isalpha() and max(text) < LATIN_END and "\u0130" not in text


#: Every such letter by itself, and some words.
LATIN_PROBES = [c for c in map(chr, range(0x80, 0x250)) if _latin(c)] + ["été", "ÉTÉ", "Straße", "œuvre", "žluťoučký"]


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases and drops white space, with a bounded memory of words met before.

    Such a tokenizer treats what stands between ASCII spaces, tabs and line ends alike wherever it stands.
    """

    def __init__(self, description: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.model = self.tokenizer.model
        # Whether lower-case ASCII letters alone pass to the model as they are, so that the steps before it can be left out.
        self.plain = all([t.id for t in self.model.tokenize(w)] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES)
        # Whether words of Latin letters pass to it in lower case, as the letters that stand for their bytes.
        self.latin = self.plain and all([t.id for t in self.model.tokenize(_lettered(w.lower()))] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in LATIN_PROBES)
        self.reset()

    def reset(self) -> None:
        self.words, self.word_ids = Numbers(), Runs()
        self.stems, self.stem_ids = Numbers(), Runs()

    def forget(self, keep: int) -> None:
        """Keeps the words and stems that were met first, among them most of the frequent ones."""
        self.words, self.word_ids = Numbers(islice(self.words, keep)), self.word_ids.first(keep)
        self.stems, self.stem_ids = Numbers(islice(self.stems, keep)), self.stem_ids.first(keep)

    def learn(self, step: int = 4000) -> None:
        """Encodes words met since the last call: new stems, many in one text; a token belongs to the stem it starts in.

        A full stop or comma after an ASCII letter or digit, or after a Latin letter, ends a word, so it is a stem of its own.
        """
        words, stems, codes = self.words.since(len(self.word_ids.lengths)), self.stems, []
        sizes = np.ones(len(words), np.int64)
        for i, word in enumerate(words):
            if word[-1] in b".," and (word[-2:-1].isalnum() or word[-2:-1] > b"\x7f" and _latin(word[:-1].decode("utf-8", "replace")[-1:])):
                codes += (stems[word[:-1]], stems[word[-1:]])
                sizes[i] = 2
            else:
                codes.append(stems[word])
        new = stems.since(len(self.stem_ids.lengths))
        found: list[list[int]] = [[]] * len(new)
        others, tokenize = [], self.model.tokenize
        for i, stem in enumerate(new):
            if self.plain and stem.isalpha() and stem.islower():
                found[i] = [t.id for t in tokenize(stem.decode())]
            elif self.latin and _latin(text := stem.decode("utf-8", "replace")):
                found[i] = [t.id for t in tokenize(_lettered(text.lower()))]
            else:
                others.append(i)
        for lo in range(0, len(others), step):
            texts = [new[i].decode("utf-8", "replace") for i in others[lo : lo + step]]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in texts)])
            at = np.fromiter(map(itemgetter(0), got.offsets), np.int64, len(got.ids))
            cut, ids = np.searchsorted(at, starts), got.ids
            for i, x, y in zip(others[lo : lo + step], cut[:-1], cut[1:]):
                found[i] = ids[x:y]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.stem_ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths)
        ids, lengths = self.stem_ids.take(np.array(codes, np.int64))
        self.word_ids.append(ids, grouped(lengths, sizes))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the number of ids of each."""
        if len(self.words) > MEMO_WORDS:
            self.forget(MEMO_WORDS // 4)
        # The tokenizer lower-cases, but for special tokens, and after it has composed letters with marks (whose first bytes are CC and CD).
        words = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        self.learn()
        ids, lengths = self.word_ids.take(codes)
        return ids, grouped(lengths, sizes)


@lru_cache(maxsize=2)
def _encoder(description: str) -> WordEncoder:
    return WordEncoder(description)


def _encoded(block: pa.RecordBatch, column: str, description: str, end_id: int | None) -> list[np.ndarray]:
    texts = block.column(block.schema.get_field_index(column)).cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"").to_pylist()
    ids, n = _encoder(description).encode(texts)
    runs = np.split(ids.astype("<u4"), np.cumsum(n)[:-1])
    return runs if end_id is None else [np.append(x, np.uint32(end_id)).astype("<u4") for x in runs]


def train_dictionary(docs: DataFrame, description: str, end_id: int | None) -> bytes:
    """A dictionary from pieces of the texts (doc_id, text); b'' only if no text has a character."""
    import zstandard

    place = F.explode(F.sequence(F.lit(0), F.call_function("div", F.length("text") - 1, F.lit(PIECE)).cast("int"))).alias("place")
    pieces = docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("t"), place)
    picked = pieces.select("t", "place", F.xxhash64("doc_id", "t", "place").alias("h")).orderBy("h", "t", "place").limit(SAMPLE_PIECES).dropDuplicates(["t", "place"])
    texts = docs.select("text", F.xxhash64("text").alias("t")).join(F.broadcast(picked), "t").dropDuplicates(["t", "place"])
    rows = texts.select("h", F.substring(F.col("text"), F.col("place") * PIECE + 1, F.lit(PIECE)).alias("text")).orderBy("h", "text").select("text").toArrow()  # SAMPLE_PIECES rows of PIECE characters
    parts = [x.tobytes() for b in rows.to_batches() for x in _encoded(b, "text", description, end_id)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        whole = b"".join(parts)[-DICTIONARY_BYTES:]
        return whole if len(whole) >= 8 else b""


def dictionary_hash(dictionary: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(dictionary)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_file(path: str, dictionary: bytes, documents: Iterator[tuple[int, np.ndarray]]) -> tuple[int, int]:
    """Writes one file; documents come in order. Returns how many documents and ids."""
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_dict_id=False).compress
    system, name = _filesystem(path)
    parent, own = name.rsplit("/", 1)
    system.create_dir(parent, recursive=True)
    draft = f"{parent}/_{own}.{uuid.uuid4().hex}"
    index: list[tuple[int, int, int, int]] = []
    with system.open_output_stream(draft) as out:
        out.write(HEAD.pack(MAGIC, dictionary_hash(dictionary), 0))
        at = HEAD.size
        for doc_id, ids in documents:
            frame = pack(ids.tobytes())
            out.write(frame)
            index.append((doc_id, at, at + len(frame), len(ids)))
            at += len(frame)
        out.write(np.array(index, "<i8").reshape(-1, 4).T.tobytes())
        out.write(struct.pack("<QQ", len(index), at))
    system.move(draft, name)
    return len(index), sum(x[3] for x in index)


def read_file(path: str, dictionary: bytes, wanted: list[int] | None = None, step: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of the documents at these places in the file, or of all; reads their frames only.

    Neighbouring frames are read together, about ``step`` bytes at a time.
    """
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpack = zstandard.ZstdDecompressor(dict_data=known).decompress
    system, name = _filesystem(path)
    with system.open_input_file(name) as f:
        magic, found, _ = HEAD.unpack(f.read_at(HEAD.size, 0))
        if magic != MAGIC or found != dictionary_hash(dictionary):
            raise ValueError(f"{path} was not written with this dictionary")
        n, start = struct.unpack("<QQ", f.read_at(16, f.size() - 16))
        doc_ids, first, last, sizes = np.frombuffer(f.read_at(32 * n, start), "<i8").reshape(4, n)
        places = np.arange(n) if wanted is None else np.array(wanted, np.int64)
        i = 0
        while i < len(places):
            j = i + 1
            while j < len(places) and places[j] == places[j - 1] + 1 and last[places[j]] - first[places[i]] <= step:
                j += 1
            base = first[places[i]]
            data = memoryview(f.read_at(int(last[places[j - 1]] - base), int(base)))
            for p in places[i:j]:
                ids = np.frombuffer(unpack(data[first[p] - base : last[p] - base], max_output_size=int(sizes[p]) * 4), "<u4")
                yield int(doc_ids[p]), ids
            i = j


#: Stands for a null doc_id in the files; such documents come first.
NULL_ID = -(1 << 63)


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int | None = None) -> tuple[DataFrame, bytes]:
    """Encodes whole texts and writes them under ``out``, one file per range of doc_id.

    Returns the table of files (file, path, documents, ids), itself stored under ``out``, and the
    dictionary. ``tokenizer_path`` is read by the driver. Null texts are empty documents, null ids come
    first, rows that repeat a doc_id follow one another in an order by their text; a repeated id with many
    rows spreads over files. Other columns are ignored; an empty table gives no file. A very long text is
    held whole by one task, in some fifty times its bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        description = f.read()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(docs, description, end_id)
    shared, tokenizer = spark.sparkContext.broadcast(dictionary), spark.sparkContext.broadcast(description)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("t"), F.col("row")]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def documents(first):
            for batch in chain([first], batches):
                for block in blocks(batch):
                    yield from zip(block.column(0).fill_null(NULL_ID).to_pylist(), _encoded(block, "text", tokenizer.value, end_id))

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        file = TaskContext.get().partitionId()  # ranges of doc_id ascend with their partitions
        path = f"{out}/ids-{file:08d}-{uuid.uuid4().hex[:8]}.gltok"
        n, ids = write_file(path, shared.value, documents(first))
        yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([path]), pa.array([n], pa.int64()), pa.array([ids], pa.int64())], ["file", "path", "documents", "ids"])

    files = ordered.select("doc_id", "text").mapInArrow(run, "file int, path string, documents long, ids long")
    files.write.parquet(f"{out}/_files")
    return spark.read.schema(files.schema).parquet(f"{out}/_files"), dictionary


def read_token_files(files: DataFrame, dictionary: bytes) -> DataFrame:
    """(file, doc_id, at, ids) of every document: ``at`` counts the ids before it in its file."""
    shared = files.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, held, size = 0, [], 0

                def flush():
                    ids = [x for _, _, x in held]
                    values = pa.array(np.concatenate(ids).astype(np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), values)
                    doc_ids = pa.array([None if d == NULL_ID else d for d, _, _ in held], pa.int64())
                    return pa.RecordBatch.from_arrays([pa.array([file] * len(held), pa.int32()), doc_ids, pa.array([a for _, a, _ in held], pa.int64()), lists], ["file", "doc_id", "at", "ids"])

                for doc_id, ids in read_file(path, shared.value):
                    held.append((doc_id, at, ids))
                    at += len(ids)
                    size += len(ids)
                    if size >= 1 << 19:
                        yield flush()
                        held, size = [], 0
                if held:
                    yield flush()

    return files.select("file", "path").repartition(max(1, files.count())).mapInArrow(run, "file int, doc_id long, at long, ids array<int>")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])


def token_file_digests(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes token files to the shared folder, reads them back and returns each document's place and digest.

    (doc_id, start, n_tokens, ids_crc32) of every row; nulls, repeats and empty tables as in ``write_token_files``.
    """
    spark = docs.sparkSession
    files, dictionary = write_token_files(docs, tokenizer_path, new_path(spark, "token-files"), end_id)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))  # a row per file, and no more files than shuffle partitions
    digests = read_token_files(files, dictionary).mapInArrow(_crc, "file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return digests.join(F.broadcast(starts), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2)


QUERIES = {"op5_token_files": op5_token_files}
