"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts are split by a pattern; each piece is written in the byte-to-character alphabet and merged by the
library's BPE model, built from a file of ranks. A worker keeps the ids of the words it has met (about
``MEMO_WORDS`` at most), since words repeat. Decoding looks token ids up in a table of bytes, so a character
whose bytes are split over tokens comes out whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from graphloom.llm.memo import Codes, Runs, grouped
from graphloom.llm.textarrays import blocks, bounded_batches, free_name, ragged, text_bytes, trimmed

#: Words that a worker keeps with their ids; beyond it the memory starts anew.
MEMO_WORDS = 80_000
#: Ids decoded at once.
DECODE_IDS = 1 << 18


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes this one: merge by rank, with lower ranks only."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def model_json(ranks: dict[bytes, int]) -> str:
    """The tokenizers library's description of a BPE model with these ranks."""
    chars = byte_characters()
    name = lambda token: "".join(chars[b] for b in token)
    by_rank = sorted(ranks, key=ranks.get)
    merges = [[name(p) for p in pair] for token in by_rank if len(token) > 1 and (pair := _parts(token, ranks))]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {name(t): ranks[t] for t in by_rank}, "merges": merges}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model})


class PieceEncoder:
    """Ids of texts, with a bounded memory of words met before.

    Holds for patterns that start a new piece at any space before a non-space, as GPT-like ones do.
    """

    def __init__(self, description: str, pattern: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile(r" (?=\S)").split
        self.odd_space = regex.compile(r" (?:\s|\Z)").search
        self.chars = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.reset()

    def reset(self) -> None:
        self.words, self.word_ids = Codes(), Runs()
        self.pieces, self.piece_ids = Codes(), Runs()

    def learn(self) -> None:
        """Encodes the words met since the last call: all new pieces in one call of the library."""
        words, pieces = self.words.new, self.pieces.new
        if not words:
            return
        split = [self.split(w[0] if type(w) is tuple else " " + w) for w in words]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.encode().decode("latin-1").translate(self.chars) for p in pieces], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.piece_ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths)
        ids, lengths = self.piece_ids.take(codes)
        self.word_ids.append(ids, grouped(lengths, sizes))
        words.clear()
        pieces.clear()

    def parts(self, text: str) -> list:
        """Parts that the pattern splits alike wherever they stand: a space before a non-space starts one.

        The first part, which has no space before it, is a tuple.
        """
        found = self.cut(text) if self.odd_space(text) else text.split(" ")
        found[0] = (found[0],)
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the bounds of each text's."""
        if len(self.words) > MEMO_WORDS:
            self.reset()
        parts = [self.parts(t) for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        self.learn()
        ids, lengths = self.word_ids.take(codes)
        return ids, np.concatenate([[0], np.cumsum(grouped(lengths, sizes))])


@lru_cache(maxsize=2)
def _encoder(description: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(description, pattern)


def _token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens, one after another by id, and their bounds; ids without a token have none."""
    lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    data = b"".join(sorted(ranks, key=ranks.get))
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) in place of the text column: the ids of the whole text, null as empty.

    With ``offsets``, also ``starts`` and ``ends``: the characters that each token covers; tokens that
    share a character all cover it. Columns named ids, starts or ends are replaced. Rows keep their order
    within a partition and repeated rows stay; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    description = spark.sparkContext.broadcast(model_json(ranks))
    table = spark.sparkContext.broadcast(_token_bytes(ranks)[1])
    extra = ["ids", "starts", "ends"] if offsets else ["ids"]
    keep = [c for c in docs.columns if c not in {text, *extra}]
    own = free_name("text", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(description.value, pattern)
        for batch in batches:
            for block in blocks(batch, own):
                column = block.column(block.schema.get_field_index(own))
                ids, bounds = encoder.encode([t or "" for t in column.to_pylist()])
                out = [block.column(block.schema.get_field_index(c)) for c in keep] + [ragged(ids, bounds)]
                if offsets:
                    data, at = text_bytes(column)
                    width = np.diff(table.value)[ids]
                    end = np.cumsum(width)
                    char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
                    first = np.repeat(char[at[:-1]], np.diff(bounds))
                    begun = char[np.minimum(end - width + 1, len(data))] - 1 - first
                    out += [ragged(begun.astype(np.int32), bounds), ragged((char[end] - first).astype(np.int32), bounds)]
                yield pa.RecordBatch.from_arrays(out, keep + extra)

    schema = docs.select(*keep).schema
    for c in extra:
        schema = schema.add(c, ArrayType(IntegerType()))
    return docs.select(*keep, F.col(text).cast("string").alias(own)).mapInArrow(trimmed(run, _encoder.cache_clear), schema)


def joined_bytes(ids: np.ndarray, cuts: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of consecutive documents' ids, and where each document's begin and end; data, bounds: the table of bytes."""
    width = bounds[ids + 1] - bounds[ids]
    total = np.concatenate([[0], np.cumsum(width)])
    return data[np.arange(total[-1]) + np.repeat(bounds[ids] - total[:-1], width)], total[cuts]


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column of the decoded bytes; a null list gives no bytes, unknown ids are an error."""
    table = encoded.sparkSession.sparkContext.broadcast(_token_bytes(ranks))
    keep = [c for c in encoded.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, bounds = table.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
            first = 0
            while first < batch.num_rows:  # rows with about DECODE_IDS ids at a time
                last = min(max(int(np.searchsorted(ends, ends[first] + DECODE_IDS, side="right")) - 1, first + 1), batch.num_rows)
                rows = batch.slice(first, last - first)
                flat = rows.column(batch.schema.get_field_index(ids)).flatten().to_numpy(zero_copy_only=False)
                text, at = joined_bytes(flat, ends[first : last + 1] - ends[first], data, bounds)
                binary = pa.BinaryArray.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text)])
                yield pa.RecordBatch.from_arrays([*(rows.column(batch.schema.get_field_index(c)) for c in keep), binary], [*keep, name])
                first = last

    return encoded.mapInArrow(run, encoded.select(*keep).schema.add(name, BinaryType()))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the bytes that decoding them gives.

    Encodes, decodes and digests in one worker, so that neither ids nor bytes travel and an executor
    runs one worker for each core. Null texts are empty: no ids, and the digests of nothing. Rows that
    repeat, and null ids, are rows like others; columns besides doc_id and text are ignored; an empty
    table gives an empty result. A very long text is held whole by one task, in some hundred times its bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    description = spark.sparkContext.broadcast(model_json(ranks))
    table = spark.sparkContext.broadcast(_token_bytes(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(description.value, pattern)
        data, bounds = table.value
        names = [str(i) for i in range(len(bounds) - 1)]
        for batch in batches:
            for block in blocks(batch):
                ids, cuts = encoder.encode([t or "" for t in block.column(1).to_pylist()])
                text, at = joined_bytes(ids, cuts, data, bounds)
                listed = ids.tolist()
                of_ids = [hashlib.sha256(" ".join(map(names.__getitem__, listed[a:b])).encode()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]
                of_text = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(cuts)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run, _encoder.cache_clear), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_ranks(path: str | None = None) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_ranks())


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
