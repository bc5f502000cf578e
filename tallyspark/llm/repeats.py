"""Repeated byte strings, found by bucket-pointer refinement over sampled suffixes.

A suffix's bucket at depth q is named by 64 bits that stand for its first q bytes. Names start as 8-grams and are used again for
each next depth (16, 32, ... 256): the bucket of depth 2q at i is the pair of the buckets of depth q at i and at the later
offset i + q. A depth between two powers is the pair of the buckets at its first and at its last 256 bytes.

1. Anchors. In each string of ``length`` bytes the 32-gram bucket with the least hash is its anchor, so equal strings have equal
   anchors at the same offset. The strings of an anchor are split into blocks of neighbouring starts. The bytes
   common to all strings of a block are its core, the bytes that they cover (as far as the text goes) are its hull.
2. Refinement. Blocks are sorted by the bucket of their core, then by the buckets at the hull's two offsets, range-partitioned
   over the cluster, and each is compared with its neighbours in this order. A block with no neighbour of the same core
   has no repeated string; one whose neighbour has the same hull has repeated strings only. Both are settled. What is left is split
   into narrower blocks, with longer cores, and sorted again: WIDTHS starts wide, down to single strings.

The order ends with id and start, so a core or hull of any number of blocks is spread over many tasks. At the edges of
partitions a block counts as unsettled, which costs one more refinement and changes no result. Bytes are fetched from the texts
only for unsettled blocks, and for one or two of each settled group next to them. Long texts are worked on in pieces of PIECE starts.

Besides, documents are marked that share a passage of more than PASSAGE_WORDS - 1 words with another text, whatever its bytes: with words in
place of bytes, windows of that many words whose least 16-word bucket another text has too are sorted, and each is compared
with its neighbours.

Names of two different strings agree with a probability of about 2^-64 for each pair that shares its other bucket.
Edge cases: a null text is empty; texts under ``length`` bytes lose nothing and match nothing; repeated rows are copies of each
other. Where ids are null or not unique, rows are numbered first, and each comes out with the id it had. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, join_texts, stage, utf8, word_chunks

LENGTH = 400
GRAM = 32
HALF = 128
DEPTH = 256
#: Starts in a block at each refinement, each a part of the one before; what is unsettled after the last is compared string by string.
WIDTHS = (180, 18)
PIECE = 1 << 20
PASSAGE_WORDS = 51
WORD_GRAM = 16
#: Bytes of short texts that are worked on at once.
BATCH = 1 << 16
#: Rows that a task holds before it passes them on.
FLUSH = 100_000

_NONE = np.zeros(0, np.int64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(31)
_HEAD, _BLOCK, _WORDS = 0, 1, 2


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The name of a pair of buckets."""
    z = x * _K1
    z += y.astype(np.uint64, copy=False)
    z ^= z >> np.uint64(29)
    z *= _K2
    z ^= z >> np.uint64(32)
    return z


def doubled(ids: np.ndarray, q: int, wanted: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Bucket names at the wanted depths, from those at depth q: each depth is made of two names of the one before."""
    out = {q: ids} if q in wanted else {}
    while q < max(wanted):
        ids, q = _pair(ids[:-q], ids[q:]), 2 * q
        if q in wanted:
            out[q] = ids
    return out


def buckets(data: np.ndarray) -> dict[int, np.ndarray]:
    """Bucket names of all suffixes at depth GRAM, HALF and DEPTH."""
    at = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    return doubled(_pair(at, np.zeros(1, np.uint64)), 8, (GRAM, HALF, DEPTH))


def window_anchor(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` grams, where its least one is, the first of equals."""
    n = len(grams)
    v = ((grams >> _LOW) << _LOW) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    blocks = np.concatenate((v, np.full(pad, ~np.uint64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (m & np.uint64((1 << 31) - 1)).astype(np.int64)


def pieces(text: bytes, length: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first start, end of starts, offset of data, data): the starts of a piece, and the bytes around its strings."""
    data, width = np.frombuffer(text, np.uint8), WIDTHS[0]
    for first in range(0, len(data) - length + 1, PIECE):
        end = min(first + PIECE, len(data) - length + 1)
        low = max(0, first - 1 - width)
        yield first, end, low, data[low : end - 1 + length + 2 * width]


def block_keys(b: dict[int, np.ndarray], near: np.ndarray, off: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, length: int) -> list[np.ndarray]:
    """core, hull_a, hull_b of blocks whose last start is ``near`` and whose hull is lo to hi; b: names at HALF and DEPTH.

    ``off`` is how far the anchor lies behind ``near``; with it, blocks of two anchors that lie on the same bytes differ.
    """
    size = length - width + 1
    depth = DEPTH if size >= DEPTH else HALF
    core = _pair(_pair(b[depth][near], b[depth][near + (size - depth)]), off)
    first, middle, last = b[DEPTH][lo], b[DEPTH][(lo + hi - DEPTH) // 2], b[DEPTH][hi - DEPTH]
    return [x.view(np.int64) for x in (core, _pair(_pair(first, middle), near - lo), _pair(_pair(last, middle), hi - near))]


def _blocks(b: dict[int, np.ndarray], s: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> list[np.ndarray]:
    """Columns first, last, near, off, core, hull_a, hull_b: the blocks of the starts s, each in a text from begin to end."""
    width = WIDTHS[0]
    m = window_anchor(b[GRAM], length - GRAM + 1)[s]
    part = (m - s) // width
    new = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (part[1:] != part[:-1]) | (begin[1:] != begin[:-1]))))
    last = np.append(new[1:], len(s)) - 1
    off = part[new] * width
    near = m[new] - off
    keys = block_keys(b, near, off, np.maximum(near - width + 1, begin[new]), np.minimum(near + length, end[new]), width, length)
    return [s[new], s[last], near, off, *keys]


def blocks_of(text: bytes, length: int = LENGTH) -> list[np.ndarray]:
    """Columns s_lo, s_hi, near, off, core, hull_a, hull_b: all blocks of a text; starts are inclusive.

    A block belongs to the piece that holds its first start.
    """
    out, width, starts = [], WIDTHS[0], len(text) - length + 1
    for first, end, low, data in pieces(text, length):
        s = np.arange(max(0, first - 1), min(starts, end + width)) - low
        cols = _blocks(buckets(data), s, np.zeros(len(s), np.int64), np.full(len(s), len(data)), length)
        own = (cols[0] + low >= first) & (cols[0] + low < end)
        cols = [c[own] for c in cols]
        out.append([cols[0] + low, cols[1] + low, cols[2] + low, *cols[3:]])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else []


def blocks_of_many(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same for texts of one piece, laid end to end: which text each block is of, and the columns."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    long = np.flatnonzero(size >= length)
    if not len(long):
        return _NONE, []
    begin = np.cumsum(size[long]) - size[long]
    data = np.frombuffer(b"".join([texts[k] for k in long]), np.uint8)
    starts = size[long] - length + 1
    text = np.repeat(np.arange(len(long)), starts)
    s = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + begin[text]
    cols = _blocks(buckets(data), s, begin[text], (begin + size[long])[text], length)
    of = np.searchsorted(begin, cols[0], side="right") - 1
    shift = begin[of]
    return long[of], [cols[0] - shift, cols[1] - shift, cols[2] - shift, *cols[3:]]


def word_names(words: list[bytes]) -> np.ndarray:
    """A name for each word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    joined = np.frombuffer(b"".join(words) + b"\0" * 8, np.uint8)
    end = np.cumsum(size)
    begin = end - size
    at = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    # eight bytes at a time, the last ones masked
    name = _pair(np.zeros(len(words), np.uint64), size)
    left = size.copy()
    while len(some := np.flatnonzero(left > 0)):
        mask = ~np.uint64(0) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left[some], 8).astype(np.uint64)))
        name[some] = _pair(name[some], at[begin[some]] & mask)
        begin[some] += 8
        left[some] -= 8
    return name


def passages_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor's 16-word name, window's name) of all windows of PASSAGE_WORDS words in lists of words."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    long = np.flatnonzero(size >= PASSAGE_WORDS)
    if not len(long):
        return _NONE, _NONE, _NONE
    b = doubled(word_names([w for k in long for w in texts[k]]), 1, (WORD_GRAM, 32))
    begin, starts = np.cumsum(size[long]) - size[long], size[long] - PASSAGE_WORDS + 1
    text = np.repeat(np.arange(len(long)), starts)
    s = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + begin[text]
    anchor = window_anchor(b[WORD_GRAM], PASSAGE_WORDS - WORD_GRAM + 1)[s]
    names = _pair(b[32][s], b[32][s + PASSAGE_WORDS - 32])
    return long[text], b[WORD_GRAM][anchor].view(np.int64), names.view(np.int64)


def word_lists(texts: list[bytes]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """The texts' words, a batch at a time, with the number of the text of each list; long texts come in chunks that overlap."""
    at, held, size = [], [], 0
    for k, text in enumerate(texts):
        for words in word_chunks(text, PASSAGE_WORDS - 1, PIECE):
            at.append(k)
            held.append(words)
            size += len(words)
            if size >= BATCH // 4:
                yield at, held
                at, held, size = [], [], 0
    if held:
        yield at, held


class Rows:
    """Gathers columns of output rows and hands them out in batches; a column that a row lacks is null."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.parts, self.size = schema, [], 0

    def add(self, n: int, **columns) -> None:
        if n:
            arrays = []
            for f in self.schema:
                x = columns.get(f.name)
                if x is None:
                    arrays.append(pa.nulls(n, f.type))
                elif isinstance(x, np.ndarray):
                    arrays.append(pa.array(x.view(np.int64) if x.dtype == np.uint64 else x).cast(f.type))
                else:
                    arrays.append(pa.array(x, f.type) if isinstance(x, list) else pa.repeat(pa.scalar(x, f.type), n))
            self.parts.append(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
            self.size += n

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.size >= least:
            yield from pa.Table.from_batches(self.parts, self.schema).combine_chunks().to_batches()
            self.parts, self.size = [], 0


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in text.split(", ")])


SCAN = "kind int, id long, n_bytes long, sha256 string, key long, n_words long, gram long, s_lo int, s_hi int, near int, off int, core long, hull_a long, hull_b long"
SETTLED = "id long, n_bytes long, top int, s_lo int, s_hi int, near int, off int, sure boolean, asked boolean"
OPEN = "kind int, id long, n_bytes long, top int, s_lo int, s_hi int, near int, off int, lo int, bytes binary, window long"
REFINED = "id long, n_bytes long, top int, s_lo int, s_hi int, near int, off int, core long, hull_a long, hull_b long"


def scan(docs: DataFrame, length: int) -> DataFrame:
    """One pass over (id, bytes): a head row for each text, a row for each block, and one for each word anchor."""
    schema = _schema(SCAN)

    def add(rows: Rows, ids: np.ndarray, texts: list[bytes]) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        parts = [(np.full(len(c[0]), k), c) for k in np.flatnonzero(size > PIECE) if (c := blocks_of(texts[k], length))]
        short = np.flatnonzero(size <= PIECE)
        of, cols = blocks_of_many([texts[k] for k in short], length)
        for of, (s_lo, s_hi, near, off, core, hull_a, hull_b) in [*parts, *([(short[of], cols)] if cols else [])]:
            rows.add(len(of), kind=_BLOCK, id=ids[of], n_bytes=size[of], s_lo=s_lo, s_hi=s_hi, near=near, off=off, core=core, hull_a=hull_a, hull_b=hull_b)
        digests = [hashlib.sha256(t).digest() for t in texts]
        keys = np.array([int.from_bytes(d[:8], "little", signed=True) for d in digests])
        n_words = np.zeros(len(texts), np.int64)
        for at, words in word_lists(texts):
            at = np.array(at)
            of, grams, _ = passages_of(words)
            n_words += np.bincount(at[of], minlength=len(texts))
            new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (grams[1:] != grams[:-1]))))[: None if len(of) else 0]
            rows.add(len(new), kind=_WORDS, id=ids[at[of[new]]], key=keys[at[of[new]]], gram=grams[new])
        n_words += (PASSAGE_WORDS - 1) * (n_words > 0)
        rows.add(len(texts), kind=_HEAD, id=ids, n_bytes=size, sha256=[d.hex() for d in digests], key=keys, n_words=n_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), 0
            for texts in by_bytes((t.as_py() for t in batch.column(1)), BATCH):
                add(rows, ids[at : at + len(texts)], texts)
                at += len(texts)
                yield from rows.take(FLUSH)
        yield from rows.take()

    return docs.mapInArrow(run, SCAN)


def settle(blocks: DataFrame) -> DataFrame:
    """Sorts blocks by their buckets and compares each with its neighbours; blocks of a core of their own are left out.

    sure: a neighbour has the same hull. asked: the block has to be refined, or is next to one that has.
    """
    order = ["core", "hull_a", "hull_b", "id", "s_lo"]
    names = [x.split()[0] for x in SETTLED.split(", ")][:-2]

    def compare(batch: pa.RecordBatch, before: list | None, after: list | None) -> pa.RecordBatch:
        keys = [batch.column(k).to_numpy() for k in order[:3]]
        ahead = [np.append(x[1:], 0 if after is None else after[k]) for k, x in enumerate(keys)]
        behind = [np.append(0 if before is None else before[k], x[:-1]) for k, x in enumerate(keys)]
        core_ahead, core_behind = keys[0] == ahead[0], keys[0] == behind[0]
        hull_ahead, hull_behind = (core & (keys[1] == x[1]) & (keys[2] == x[2]) for core, x in ((core_ahead, ahead), (core_behind, behind)))
        if after is None:
            core_ahead[-1], hull_ahead[-1] = True, False
        if before is None:
            core_behind[0], hull_behind[0] = True, False
        shared, sure = core_ahead | core_behind, hull_ahead | hull_behind
        asked = shared & (~sure | (core_ahead & ~hull_ahead) | (core_behind & ~hull_behind))
        out = pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(sure), pa.array(asked)], names=[*names, "sure", "asked"])
        return out.filter(pa.array(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        edge = lambda batch, k: [batch.column(c)[k].as_py() for c in order[:3]]
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield compare(held, before, edge(batch, 0))
                    before = edge(held, held.num_rows - 1)
                held = batch
        if held is not None:
            yield compare(held, before, None)

    blocks = blocks if "top" in blocks.columns else blocks.withColumn("top", F.col("s_lo"))
    sorted_rows = blocks.select(*dict.fromkeys([*order, *names])).repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(run, SETTLED)


def hulls_and_windows(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """One pass over the texts of asked (id, blocks, grams): the hulls of the blocks, and the windows whose anchors are among the grams."""
    schema = _schema(OPEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for batch in batches:
            for i, t, found, shared in zip(*[batch.column(k) for k in ("id", "bytes", "blocks", "grams")], strict=True):
                doc, text = i.as_py(), t.as_py()
                if len(v := found.values):
                    s_lo, s_hi, near, off = (v.field(k).to_numpy() for k in ("s_lo", "s_hi", "near", "off"))
                    lo, hi = np.maximum(near - WIDTHS[0] + 1, 0), np.minimum(near + length, len(text))
                    cut = [text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                    rows.add(len(v), kind=_BLOCK, id=doc, n_bytes=len(text), top=s_lo, s_lo=s_lo, s_hi=s_hi, near=near, off=off, lo=lo, bytes=cut)
                if len(wanted := shared.values):
                    for _, words in word_lists([text]):
                        _, grams, names = passages_of(words)
                        own = np.unique(names[np.isin(grams, wanted.to_numpy())])
                        rows.add(len(own), kind=_WORDS, id=doc, window=own)
                yield from rows.take(FLUSH)
        yield from rows.take()

    return join_texts(texts, asked).mapInArrow(run, OPEN)


def sharing(windows: DataFrame) -> DataFrame:
    """(id): who has a window that another id has too. Windows (id, window) are sorted, and each is compared with the next.

    What lies on both sides of an edge between partitions is compared in a second, small step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            window, ids = (batch.column(k).to_numpy() for k in ("window", "id"))
            edge = np.zeros(0, np.int64)
            if before is None:
                edge = np.array([0])
            else:
                window, ids = np.append(before[0], window), np.append(before[1], ids)
            met = np.flatnonzero((window[1:] == window[:-1]) & (ids[1:] != ids[:-1]))
            found = np.unique(np.concatenate((ids[met], ids[met + 1])))
            before = [window[-1:], ids[-1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found, ids[edge])), pa.array([None] * len(found) + window[edge].tolist(), pa.int64())], names=["id", "edge"])
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array(before[1]), pa.array(before[0])], names=["id", "edge"])

    found = stage(windows.repartitionByRange("window", "id").sortWithinPartitions("window", "id").mapInArrow(run, "id long, edge long"), "repeats-sharing")
    edges = found.where("edge is not null")
    met = edges.groupBy("edge").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("edge")
    return found.where("edge is null").select("id").unionByName(edges.join(met, "edge", "left_semi").select("id")).distinct()


def _joined(batch: pa.RecordBatch) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The bucket names of all hulls of a batch, one after the other, and where each hull begins."""
    data = [x.as_buffer() for x in batch.column("bytes")]
    size = np.fromiter((x.size for x in data), np.int64, len(data))
    return buckets(np.frombuffer(b"".join(data), np.uint8)), np.cumsum(size) - size


def narrower(hulls: DataFrame, width: int, length: int) -> DataFrame:
    """The hulls' blocks of ``width`` starts."""
    schema = _schema(REFINED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b, begin = _joined(batch)
            i, n, top, s_lo, s_hi, near, off, lo = (batch.column(k).to_numpy().astype(np.int64) for k in ("id", "n_bytes", "top", "s_lo", "s_hi", "near", "off", "lo"))
            first, last = (near - s_hi) // width, (near - s_lo) // width
            count = last - first + 1
            row = np.repeat(np.arange(len(i)), count)
            j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
            at, behind = near[row] - j * width, off[row] + j * width
            low, high = np.maximum(at - width + 1, 0), np.minimum(at + length, n[row])
            shift = begin[row] - lo[row]
            keys = block_keys(b, at + shift, behind, low + shift, high + shift, width, length)
            columns = [i[row], n[row], top[row], np.maximum(s_lo[row], at - width + 1), np.minimum(s_hi[row], at), at, behind, *keys]
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return hulls.select("id", "n_bytes", "top", "s_lo", "s_hi", "near", "off", "lo", "bytes").mapInArrow(run, REFINED)


def strings_of(hulls: DataFrame, length: int) -> DataFrame:
    """(id, start, a, b): the single strings of hulls (lo, bytes) that start in their ranges (s_lo, s_hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b, begin = _joined(batch)
            i, s_lo, s_hi, lo = (batch.column(k).to_numpy().astype(np.int64) for k in ("id", "s_lo", "s_hi", "lo"))
            count = s_hi - s_lo + 1
            row = np.repeat(np.arange(len(i)), count)
            start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + s_lo[row]
            at = start + begin[row] - lo[row]
            a, z = (b[DEPTH][x].view(np.int64) for x in (at, at + length - DEPTH))
            yield pa.RecordBatch.from_arrays([pa.array(i[row]), pa.array(start).cast(pa.int32()), pa.array(a), pa.array(z)], names=["id", "start", "a", "b"])

    return hulls.mapInArrow(run, "id long, start int, a long, b long")


def met_again(strings: DataFrame) -> DataFrame:
    """The rows of (a, b, ...) whose pair of buckets has another member. Both sides are staged, so a very common pair can be split."""
    twice = strings.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    return strings.join(stage(twice, "repeats-twice"), ["a", "b"], "left_semi")


def _spans(settled: DataFrame, width: int, length: int) -> DataFrame:
    """All strings of a sure block's hull are repeated, also those of other anchors."""
    lo, hi = F.greatest(F.col("near") - (width - 1), F.lit(0)), F.least(F.col("near") + length, F.col("n_bytes"))
    return settled.where("sure").select("id", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch or overlap become one."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1])))
    return lo[new], reach[np.append(new[1:], len(lo)) - 1]


def cut_out(texts: DataFrame) -> DataFrame:
    """(id, spans, kept_sha256) of (id, bytes, spans): merged spans, and the digest of the bytes outside them."""
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, digests = [], []
            for t, found in zip(batch.column("bytes"), batch.column("spans"), strict=True):
                text, at, digest = memoryview(t.as_buffer()), 0, hashlib.sha256()
                lo, hi = merge_spans(*(found.values.field(k).to_numpy() for k in ("lo", "hi")))
                pairs = list(zip(lo.tolist(), hi.tolist(), strict=True))
                for a, b in pairs:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                merged.append([{"lo": a, "hi": b} for a, b in pairs])
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(merged, kind), pa.array(digests, pa.string())], names=["id", "spans", "kept_sha256"])

    return texts.mapInArrow(run, f"id long, spans {SPANS}, kept_sha256 string")


SPANS = "array<struct<lo:long,hi:long>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, spans, kept_sha256, shares_passage): the removed runs (lo, hi) of every document, the digest of what stays, and
    whether a passage of PASSAGE_WORDS words is in another document too."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if not ids.groupBy("id").count().where("id is null or count > 1").isEmpty():
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        rows = stage(rows, "repeats-rows")
        found = remove_repeats(rows.select("row", "text"), "row", "text", length)
        return found.withColumnRenamed("id", "row").join(rows.select("row", "id"), "row").drop("row")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("bytes"))
    scanned = stage(scan(texts, length), "repeats-scan")
    heads = scanned.where(F.col("kind") == _HEAD).select("id", "n_bytes", "sha256", "n_words")
    copies = stage(heads.groupBy("sha256").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "repeats-copies")
    heads = stage(heads.join(copies, "sha256").select("*", (F.col("n") > 1).alias("copied")), "repeats-heads")

    # the first refinement, and the word anchors that different texts share
    settled = stage(settle(scanned.where(F.col("kind") == _BLOCK)), "repeats-blocks")
    grams = scanned.where(F.col("kind") == _WORDS).select("id", "gram", "key")
    shared = grams.groupBy("gram").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("gram")
    shared = grams.join(stage(shared, "repeats-grams"), "gram", "left_semi").select("id", "gram")
    shared = shared.join(heads.where("id <> first").select("id"), "id", "left_anti")
    block = F.struct("s_lo", "s_hi", "near", "off")
    asked = settled.where("asked").select("id", block.alias("block"), F.lit(None).cast("long").alias("gram"))
    asked = asked.unionByName(shared.select("id", F.lit(None).cast(asked.schema["block"].dataType).alias("block"), "gram"))
    asked = stage(asked.groupBy("id").agg(F.collect_list("block").alias("blocks"), F.collect_set("gram").alias("grams")), "repeats-asked")

    opened = stage(hulls_and_windows(texts, asked, length), "repeats-open")
    hulls = opened.where(F.col("kind") == _BLOCK)
    spans = _spans(settled, WIDTHS[0], length)
    for width in WIDTHS[1:]:
        settled = stage(settle(narrower(hulls, width, length)), "repeats-narrower")
        spans = spans.unionByName(_spans(settled, width, length))
        left = settled.where("asked").select("id", "top", "s_lo", "s_hi", "near", "off")
        hulls = hulls.select("id", "n_bytes", "top", "lo", "bytes").join(left, ["id", "top"])
    strings = stage(strings_of(hulls.select("id", "s_lo", "s_hi", "lo", "bytes"), length), "repeats-strings")
    spans = spans.unionByName(met_again(strings).select("id", F.col("start").cast("long").alias("lo"), (F.col("start") + length).cast("long").alias("hi")))
    spans = spans.join(heads.where("copied").select("id"), "id", "left_anti").groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = stage(spans, "repeats-spans")

    sharers = stage(sharing(opened.where(F.col("kind") == _WORDS).select("id", "window")), "repeats-sharers")

    cut = stage(cut_out(join_texts(texts, spans)), "repeats-cut")
    heads = heads.join(cut, "id", "left").join(sharers.withColumn("shares", F.lit(True)), "id", "left")
    gone = F.col("copied") & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    shares = F.when(F.col("copied"), F.col("n_words") >= PASSAGE_WORDS).otherwise(F.coalesce("shares", F.lit(False)))
    return heads.select(
        "id", "n_bytes", F.when(gone, all_of_it).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {SPANS})"))).alias("spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        shares.alias("shares_passage"),
    )
