"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Templates are classed by length; for a class of length L every text is cut into windows of 3/2 L places,
one every L/2, so that any passage of up to L words lies whole in a window. Windows and templates have
``bands`` minima of one hash each (minima of L/2 places are computed once and combined); a minimum that
agrees retrieves the template. The number of bands is set so that a window that holds a passage with
``CONTAINMENT`` of a template's shingles meets it with probability ``1 - MISS`` even at the lowest Jaccard
similarity that is possible then. This is the only way by which templates are found.

A retrieved template is verified exactly by the share of its distinct shingles in the window, and then
all its passages in the text are reported: from the first shingle on the shortest stretch with the most
distinct shingles, at most a quarter longer than the template, trimmed at its start; then the next one
behind it. So adjacent and repeated passages are rows of their own.

Templates are broadcast in groups of ``GROUP`` at most, one scan each; texts never move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.license_texts import ROWS
from graphloom.llm.textarrays import blocks, bounded_batches, mix, text_bytes, word_bounds, word_hashes
from graphloom.operators.statistics import ranked
from graphloom.sources.shared_storage import write_shared

#: Words of a shingle (a shorter template is one shingle), share of a template's shingles that a passage must hold,
#: chance to miss a passage, words of a passage for each four of its template.
WORDS, CONTAINMENT, MISS, STRETCH = 3, 0.8, 1e-6, 5
#: Templates that are broadcast and scanned for at once.
GROUP = 20_000


def n_bands(share: float, miss: float = MISS) -> int:
    """Bands of one minimum each so that sets of this Jaccard similarity agree in one with probability 1 - miss."""
    return 1 if share >= 1 else math.ceil(math.log(miss) / math.log(1 - share))


def seed(band: int) -> np.uint64:
    """An odd multiplier: multiplication permutes the hashes."""
    return mix(np.array([band + 1], np.uint64))[0] | np.uint64(1)


def _shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles that start at each of the first len(h) - k + 1 words."""
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out += h[j : len(h) - k + 1 + j] * np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64))
    return mix(out)


def template_hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


class Templates:
    """The band index of templates (name, text) with shingles of ``k`` words; others and empty ones are not in it."""

    def __init__(self, rows: list[tuple[str, str]], k: int):
        self.k, self.names, self.sets, self.longest = k, [], [], []
        for name, text in rows:
            h = template_hashes(text)
            if len(h) and min(len(h), WORDS) == k:
                self.names.append(name)
                self.sets.append(np.unique(_shingle_hashes(h, k)))
                self.longest.append(max(len(h), len(h) * STRETCH // 4))
        self.needed = [math.ceil(CONTAINMENT * len(s)) for s in self.sets]
        # A class per power of two of the longest passage: (step, bands, per band the sorted minima and their templates).
        self.classes: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]] = []
        for size in sorted({1 << max(1, (n - 1).bit_length()) for n in self.longest}):
            own = np.array([i for i, n in enumerate(self.longest) if 1 << max(1, (n - 1).bit_length()) == size])
            step = size // 2
            least = min(self.needed[i] / (len(self.sets[i]) + 3 * step - self.needed[i]) for i in own)
            index = []
            for b in range(n_bands(least)):
                keys = np.array([(self.sets[i] * seed(b)).min() for i in own])
                order = np.argsort(keys, kind="stable")
                index.append((keys[order], own[order]))
            self.classes.append((step, index))

    def candidates(self, shingles: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, first shingle, end, template) of windows and templates that agree in a band."""
        sizes = np.diff(bounds)
        layouts = []
        for step, index in self.classes:
            n = -(-sizes // step)
            first = np.concatenate([[0], np.cumsum(n)])
            text = np.repeat(np.arange(len(sizes)), n)
            starts = bounds[text] + (np.arange(first[-1]) - first[text]) * step
            near = [np.minimum(np.arange(first[-1]) + d, first[text + 1] - 1) for d in (1, 2)]  # the next chunks of the text
            flags = np.zeros(1 << 16, bool)
            for keys, _ in index:
                flags[(keys >> np.uint64(48)).astype(np.int64)] = True
            layouts.append((step, index, text, starts, near, flags))
        found: set[tuple[int, int, int, int]] = set()
        for b in range(max((len(index) for _, index in self.classes), default=0)):
            x = shingles * seed(b)
            for step, index, text, starts, near, flags in layouts:
                if b >= len(index) or not len(starts):
                    continue
                low = np.minimum.reduceat(x, starts)
                low = np.minimum(np.minimum(low, low[near[0]]), low[near[1]])
                maybe = np.flatnonzero(flags[(low >> np.uint64(48)).astype(np.int64)])
                if not len(maybe):
                    continue
                keys, owners = index[b]
                lo, hi = np.searchsorted(keys, low[maybe]), np.searchsorted(keys, low[maybe], side="right")
                for w, i, j in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo]):
                    t = int(text[w])
                    end = min(int(starts[w]) + 3 * step, int(bounds[t + 1]))
                    found.update((t, int(starts[w]), end, int(o)) for o in owners[i:j])
        yield from sorted(found)

    def passages(self, shingles: np.ndarray, template: int) -> Iterator[tuple[int, int, float]]:
        """(first word, end word, share) of all passages of a template in a text, left to right."""
        own, needed, longest = self.sets[template], self.needed[template], self.longest[template] - self.k
        at = np.searchsorted(own, shingles)
        at[at == len(own)] = 0
        hits = np.flatnonzero(own[at] == shingles)
        which = at[hits]
        i = 0
        while i + needed <= len(hits):
            last = int(np.searchsorted(hits, hits[i] + longest, side="right"))
            seen, end = set(), i
            if last - i >= needed:
                for j in range(i, last):
                    if which[j] not in seen:
                        seen.add(which[j])
                        end = j
            if len(seen) < needed:
                i += 1
                continue
            first, later = i, list(which[i : end + 1])
            while later[0] in later[1:]:  # what comes again later is not the start
                later.pop(0)
                first += 1
            yield int(hits[first]), int(hits[end]) + self.k, len(seen) / len(own)
            i = end + 1


def scan_block(column: pa.Array, templates: list[Templates]) -> list[tuple[int, str, int, int, float]]:
    """(text, name, first word, end word, share) of all passages in a block of texts."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    out = []
    for t in templates:
        sizes = np.maximum(np.diff(first) - t.k + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        whole = _shingle_hashes(h, t.k) if len(h) >= t.k else np.zeros(0, np.uint64)
        shingles = whole[np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], sizes)]
        done: set[tuple[int, int]] = set()
        for text, a, b, template in t.candidates(shingles, bounds):
            if (text, template) in done:
                continue
            inside = np.intersect1d(shingles[a:b], t.sets[template])
            if len(inside) >= t.needed[template]:
                done.add((text, template))
                own = shingles[bounds[text] : bounds[text + 1]]
                out += [(text, t.names[template], *p) for p in t.passages(own, template)]
    return out


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, license, first_word, end_word, containment): passages of ``docs`` (doc_id, text) that hold a template.

    ``templates`` is (license, text), of any number; equal rows count once, null or empty texts and null
    names match nothing. Templates of one or two words are single shingles of that length. Null and empty
    texts hold nothing, repeated rows are reported each, passages of different templates may overlap. Other
    columns are ignored; empty tables give an empty result. A very long text is hashed whole by one task,
    in arrays of some twenty times its bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = templates.where("license IS NOT NULL AND text IS NOT NULL").select("license", "text").distinct()
    numbered, _ = write_shared(ranked(rows, "license", "text"), "templates")
    kind = docs.schema["doc_id"].dataType
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind.simpleString()}, license string, first_word int, end_word int, containment double"
    arrow = [to_arrow_type(kind), pa.string(), pa.int32(), pa.int32(), pa.float64()]

    def scanned(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch):
                    found = scan_block(block.column(1), shared.value)
                    text = pa.array([x[0] for x in found], pa.int64())
                    columns = [block.column(0).take(text), *(pa.array([x[i] for x in found], arrow[i]) for i in range(1, 5))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "first_word", "end_word", "containment"])

        return texts.mapInArrow(run, schema)

    out = spark.createDataFrame([], schema)
    for group in range(math.ceil(numbered.count() / GROUP)):
        own = numbered.where(F.col("rank").between(group * GROUP + 1, (group + 1) * GROUP)).orderBy("rank").select("license", "text").collect()  # GROUP rows
        built = [Templates([tuple(r) for r in own], k) for k in range(1, WORDS + 1)]
        out = out.unionAll(scanned(spark.sparkContext.broadcast([t for t in built if t.names])))
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, text) of the public texts, headers, notices and SPDX lines that ship with the operator."""
    return spark.createDataFrame(ROWS, "license string, text string")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_licenses(spark))


QUERIES = {"op6_license_scan": op6_license_scan}
