"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is the set of its five-word shingles. A document contains it if at least CONTAINMENT of them occur in the
document, however long that is. Items are partitioned by size. An item of n shingles keeps the floor(n - need) + 1
smallest of their hashes (a bottom-k MinHash, its length set by the partition's size), where need is the number of
shingles that must be found: if none of the kept ones is in a document, fewer than ``need`` can be, so the search misses
nothing. A document with fewer words than ``need`` is no candidate. Every candidate is then counted exactly.

The items are the stated queries. Up to BLOCK_BYTES of them (their size is summed up first) are broadcast, and one pass over the documents
without a shuffle finds them. A longer benchmark is a table: items write down their sketches, the documents pass once by a filter of all sketch values
(FILTER_BITS bits for each, FILTER_MOST at most), what it lets through joins the sketches, and candidate texts meet their items, ITEMS_AT_ONCE of
them at a time, to be counted exactly. Either way the result is the same, and the documents' shingles are hashed in one pass.

Words are split at [\\x20\\x09-\\x0D] with A-Z in lower case. An item of k < 5 words is a size of its own: one shingle of k words, looked up among the
k-word shingles of documents. Texts that are equal are searched once in a long benchmark, by their md5. Edge cases: null and empty texts contain nothing and items without words are in nothing; long documents are worked on in chunks that overlap; repeated rows are reported as often as they come in; rows without an id are
reported with a null id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import FILTER_BITS, FILTER_MOST, PIECE_BYTES, keep_rows, maybe_in, spare, stage, utf8, without, word_chunks

WORDS = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 8 << 20

#: Items of a long benchmark that a candidate text is compared with in one group.
ITEMS_AT_ONCE = 1000

#: Bytes of a document hashed at a time.
CHUNK_BYTES = PIECE_BYTES

_BASE = 0x9E3779B97F4A7C15
_FRONT_BITS = 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, kept as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def shingle_spans(words: list[bytes], size_in_words: int = WORDS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by spaces, and where each shingle begins and ends in them; fewer words are one shingle."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(size_in_words, len(words))
    return b" ".join(words), (end - size)[: len(words) - k + 1], end[k - 1 :]


def span_hashes(joined: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal spans have equal hashes; different ones may."""
    up, down = _POWERS.get(len(joined) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(joined, np.uint8) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        h = (sums[end] - sums[begin]) * down[begin]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes) -> set[bytes]:
    words = text.lower().split()
    if not words:
        return set()
    joined, begin, end = shingle_spans(words)
    return {joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)}


class Index:
    """A block of items: their shingles, and their sketches by size partition."""

    def __init__(self, items: list[tuple[int, bytes]], containment: float = CONTAINMENT):
        self.ids, self.sizes, self.need = [], [], []
        self.items: list[list[bytes]] = []
        parts: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, text in items:
            if not (shingles := sorted(shingle_set(text))):
                continue
            k, n = len(self.ids), len(shingles)
            self.ids.append(item_id)
            self.sizes.append(n)
            self.need.append(max(1, math.ceil(containment * n - 1e-9)))
            self.items.append(shingles)
            length = np.fromiter(map(len, shingles), np.int64, n)
            end = np.cumsum(length)
            hashes = np.unique(span_hashes(b"".join(shingles), end - length, end))
            # two of its shingles may share a hash, so the sketch is as long as the number of shingles asks
            parts[n.bit_length()].append((hashes[: n - self.need[k] + 1], k))
        self.partitions = []
        for size in sorted(parts):
            hashes = np.concatenate([h for h, _ in parts[size]])
            owner = np.concatenate([np.full(len(h), k) for h, k in parts[size]])
            self.partitions.append((hashes, owner))
        #: Words in a shingle: five, and the lengths of shorter items.
        self.lengths = sorted({min(WORDS, x.count(b" ") + 1) for shingles in self.items for x in shingles})
        self.front = np.zeros(1 << _FRONT_BITS, bool)
        for hashes, _ in self.partitions:
            self.front[hashes >> np.uint64(64 - _FRONT_BITS)] = True

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items with a sketch value among the hashes, partition by partition."""
        hashes = np.unique(hashes[self.front[hashes >> np.uint64(64 - _FRONT_BITS)]])
        found: set[int] = set()
        for values, owner in self.partitions if len(hashes) else ():
            found.update(owner[np.isin(values, hashes)].tolist())
        return found

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item id, shingles found, shingles of the item) of every item that the text contains."""
        found, n = set(), 0
        for words in word_chunks(text, WORDS - 1, CHUNK_BYTES):
            for size in self.lengths:
                if len(words) >= size:
                    found |= self.candidates(span_hashes(*shingle_spans(words, size)))
            n += len(words)
        found = {k for k in found if self.need[k] <= n}
        if not found:
            return []
        wanted = {x for k in found for x in self.items[k]}
        there = set()
        for words in word_chunks(text, WORDS - 1, CHUNK_BYTES):
            for size in {x.count(b" ") + 1 for x in wanted}:
                if len(words) < size:
                    continue
                joined, begin, end = shingle_spans(words, size)
                there.update(wanted.intersection(joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)))
        shared = [(k, sum(x in there for x in self.items[k])) for k in found]
        return sorted((self.ids[k], c, self.sizes[k]) for k, c in shared if c >= self.need[k])


_LAST: list = [None, None]


def index_of(block: list[tuple[int, bytes]], containment: float = CONTAINMENT) -> Index:
    """The index of a broadcast block, made once in a Python worker as long as no other is asked for."""
    if _LAST[0] is not block or _LAST[1][0] != containment:
        _LAST[:] = [block, (containment, Index(block, containment))]
    return _LAST[1][1]


def is_short(items: DataFrame, text_col: str, block_bytes: int) -> bool:
    return (items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) <= block_bytes


def read_block(items: DataFrame, id_col: str, text_col: str) -> list[tuple[int, bytes]]:
    """The items of a short benchmark."""
    return [(row[0], bytes(row[1])) for row in items.select(F.col(id_col).cast("long"), utf8(F.col(text_col))).collect()]


def item_sketches(items: DataFrame, containment: float) -> DataFrame:
    """(item, item_id, bytes, length, sketch) of (item_id, bytes): sketch as in Index, length the words in a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for item_id, text in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                index = Index([(item_id, text)], containment)
                if index.partitions:
                    out.append({"item": task, "item_id": item_id, "bytes": text, "length": index.lengths[0], "sketch": index.partitions[0][0].view(np.int64).tolist()})
                    task += 1
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("bytes", pa.binary()), ("length", pa.int32()), ("sketch", pa.list_(pa.int64()))])
    return stage(items.mapInArrow(run, "item long, item_id long, bytes binary, length int, sketch array<long>"), "contained-items")


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(size - 1), (hashes >> np.uint64(29)) & np.uint64(size - 1)


def sketch_filter(values: DataFrame) -> np.ndarray:
    """A filter of two bits for each value of ``hash``, as booleans; its size is bounded, so with very many values it lets more through."""
    n = max(values.count(), 1)
    size = min(max(1 << 16, 1 << (n * FILTER_BITS - 1).bit_length()), FILTER_MOST)
    at = [F.col("hash").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("hash", 29).bitwiseAND(F.lit(size - 1))]
    bits = values.select(F.explode(F.array(*at)).alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    out = np.zeros(size // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def long_benchmark(rows: DataFrame, items: DataFrame, containment: float) -> DataFrame:
    """(text, item_id, n_shared, n_item) of every different text of (text, bytes), text being a hash of it, and item that it contains."""
    held = item_sketches(items, containment)
    lengths = sorted(r[0] for r in held.select("length").distinct().collect())
    sketches = held.select("item", F.explode("sketch").alias("hash"))
    seen = rows.sparkSession.sparkContext.broadcast(sketch_filter(sketches))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = seen.value
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                met = [np.zeros(0, np.uint64)]
                for words in word_chunks(text.as_py(), WORDS - 1, CHUNK_BYTES):
                    for size in lengths:
                        if len(words) >= size:
                            h = span_hashes(*shingle_spans(words, size))
                            one, two = _bits(h, len(there))
                            met.append(np.unique(h[there[one] & there[two]]))
                if len(hits := np.unique(np.concatenate(met))):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(hits)), pa.array(hits.view(np.int64))], names=["text", "hash"])

    probed = stage(rows.mapInArrow(probe, "text string, hash long").distinct(), "contained-probed")
    pairs = stage(probed.join(sketches, "hash").select("text", "item").distinct(), "contained-candidates")
    place = F.row_number().over(W.partitionBy("text").orderBy("item"))
    pairs = pairs.withColumn("part", F.floor((place - 1) / ITEMS_AT_ONCE)).join(held.select("item", "item_id", F.col("bytes").alias("wanted")), "item")
    pairs = stage(pairs.select("text", "part", "item_id", "wanted"), "contained-pairs")
    once = maybe_in(rows, "text", pairs, "text").groupBy("text").agg(F.first("bytes").alias("bytes"))
    asked = pairs.select("text", "part").distinct().join(once, "text")

    def count(key: tuple, texts: pa.Table, pairs: pa.Table) -> pa.Table:
        text, name = texts["bytes"][0].as_py(), texts["text"][0].as_py()
        hits = Index(list(zip(pairs["item_id"].to_pylist(), pairs["wanted"].to_pylist(), strict=True)), containment).search(text)
        columns = list(zip(*[(name, *hit) for hit in hits], strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["text", "item_id", "n_shared", "n_item"])

    sides = asked.groupBy("text", "part"), pairs.select(F.col("text").alias("t"), F.col("part").alias("p"), "item_id", "wanted").groupBy("t", "p")
    found = sides[0].cogroup(sides[1]).applyInArrow(count, "text string, item_id long, n_shared long, n_item long")
    return stage(found, "contained-found")


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, item_id, n_shared, n_item, containment) for every document and item that it contains."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("bytes"))
    if is_short(items, item_text_col, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(read_block(items, item_id_col, item_text_col))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = index_of(index.value, containment).search
            for batch in batches:
                out = [(d.as_py(), *hit) for d, t in zip(batch.column(0), batch.column(1), strict=True) for hit in search(t.as_py())]
                cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(cols, names=["id", "item_id", "n_shared", "n_item"])

        found = rows.mapInArrow(run, "id long, item_id long, n_shared long, n_item long")
    else:
        named = rows.select(F.md5("bytes").alias("text"), "bytes")
        asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), utf8(F.col(item_text_col)).alias("bytes"))
        hits = long_benchmark(named, asked, containment)
        who = rows.select("id", F.md5("bytes").alias("text"))
        found = maybe_in(who, "text", hits, "text").join(hits, "text").select("id", "item_id", "n_shared", "n_item")
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no benchmark item, with or without an id."""
    if is_short(items, "text", block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(read_block(items, "item_id", "text"))

        def make():
            search = index_of(held.value).search
            return lambda texts: [not search(t) for t in texts]

        return keep_rows(docs, text_col, make)
    (name,) = spare(docs, "md5")
    named = docs.withColumn(name, F.md5(utf8(F.col(text_col))))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), utf8(F.col("text")).alias("bytes"))
    hits = long_benchmark(named.select(F.col(name).alias("text"), utf8(F.col(text_col)).alias("bytes")), asked, CONTAINMENT)
    return without(named, name, hits, "text").drop(name)
