"""Token ids in word-aligned binary files (Simple-8b).

Documents are range-partitioned by id; each partition encodes its texts and streams one file to the shared folder. A file is
read back block by block, so neither side holds more than a block of ids and the lengths of a file's documents.

Format, all little-endian: MAGIC; blocks; a footer (JSON: for each stream, where its blocks begin, their ids and words); the
footer's length as 8 bytes; MAGIC. There are three streams: ids, documents' lengths, documents' ids (0 for null, else 1
+ the zigzag difference to the one before). A block is up to BLOCK values in 64-bit words: the upper 4 bits select how many
values of how many bits follow in the lower 60 (the first at the lowest bits). Selector 15 is an escape: the value
needs more than 60 bits and stands in full among the block's last words, in order. Blocks decode with a few array
operations for each selector, independently of each other.

Words are split at [\\x20\\x09-\\x0D], which the tokenizer splits at as well, and each different word of a batch is encoded once.

Edge cases: a null or empty text is its end id alone; rows without an id come first; rows that share an id stand in the order
of their texts; an empty table writes no file. Files of failed task attempts are never read: only the manifest, written when
all tasks have ended, names the files that count. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Numbers, by_bytes, new_dir, pieces_at_blanks, stage, utf8

MAGIC = b"TSPACK8B"
BLOCK = 1 << 16
#: (values in a word, bits of each) by selector; fixed values of the coding.
PACKINGS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
#: Different words kept encoded in a Python worker; when full, it starts anew.
CACHE_WORDS = 1_600_000


def pack(values: np.ndarray) -> np.ndarray:
    """One block's words."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    # bits of each value, at most one too many: the exponent of the nearest double
    bits_of = (values.astype(np.float64).view(np.int64) >> 52) - 1022
    width = np.zeros(n + 60, np.uint8)
    width[:n] = np.where(values == 0, 0, bits_of)
    select, covered = np.full(n, ESCAPE, np.uint8), 1
    for s in range(len(PACKINGS) - 1, -1, -1):
        many, bits = PACKINGS[s]
        while covered < many:  # the largest width of the next ``many`` values
            more = min(covered, many - covered)
            width[:-more] = np.maximum(width[:-more], width[more:])
            covered += more
        fits = width[:n] <= bits
        if not fits.any():
            break
        select[fits] = s
    count = np.array([*(c for c, _ in PACKINGS), 0, 1], np.int64)[select]
    step, starts, i = count.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    begin = np.array(starts, np.int64)
    chosen = select[begin]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((values, np.zeros(60, np.uint64)))
    for s in np.unique(chosen):
        if s != ESCAPE:
            many, bits = PACKINGS[s]
            mine = chosen == s
            take = padded[begin[mine][:, None] + np.arange(many)]
            inside = begin[mine][:, None] + np.arange(many) < n
            shift = np.arange(many, dtype=np.uint64) * np.uint64(bits)
            words[mine] |= np.bitwise_or.reduce(np.where(inside, take, np.uint64(0)) << shift, axis=1)
    return np.concatenate((words, values[begin[chosen == ESCAPE]]))


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The block's n values."""
    out = np.zeros(n + 60, np.uint64)
    select = (words >> np.uint64(60)).astype(np.int64)
    many = np.array([*(c for c, _ in PACKINGS), 0, 1])[select]
    end = np.cumsum(many)
    used = int(np.searchsorted(end, n)) + 1 if n else 0  # the words after these are escaped values
    select, begin = select[:used], (end - many)[:used]
    for s in np.unique(select):
        mine = select == s
        if s == ESCAPE:
            out[begin[mine]] = words[used : used + int(mine.sum())]
        else:
            c, bits = PACKINGS[s]
            shift = np.arange(c, dtype=np.uint64) * np.uint64(bits)
            out[begin[mine][:, None] + np.arange(c)] = (words[:used][mine][:, None] >> shift) & np.uint64((1 << bits) - 1)
    return out[:n]


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Streams a file; nothing but the block at hand, and the documents' lengths and ids, is held."""

    def __init__(self, path: str):
        where, name = filesystem(path)
        where.create_dir(os.path.dirname(name), recursive=True)
        self.out = where.open_output_stream(name)
        self.out.write(MAGIC)
        self.streams: dict[str, list[tuple[int, int, int]]] = {"ids": [], "lengths": [], "docs": []}
        self.held, self.size, self.lengths, self.docs = [], 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, full, BLOCK):
            self._block("ids", ids[at : min(at + BLOCK, full)])
        self.held, self.size = [ids[full:]], len(ids) - full

    def _block(self, stream: str, values: np.ndarray) -> None:
        words = pack(values)
        self.streams[stream].append((self.out.tell(), len(values), len(words)))
        self.out.write(words.astype("<u8").tobytes())

    def close(self) -> None:
        self._flush(True)
        known, codes = 0, []
        for d in self.docs:
            step = 0 if d is None else d - known
            codes.append(0 if d is None else ((step << 1) ^ (step >> 127)) + 1)
            known = known if d is None else d
        for stream, values in (("lengths", self.lengths), ("docs", codes)):
            for at in range(0, len(values), BLOCK):
                self._block(stream, np.array(values[at : at + BLOCK], np.uint64))
        foot = json.dumps(self.streams).encode()
        self.out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.out.close()


class Reader:
    def __init__(self, path: str):
        where, name = filesystem(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        length = int.from_bytes(tail[:8], "little")
        self.streams = json.loads(self.file.read_at(length, size - 16 - length))

    def blocks(self, stream: str) -> Iterator[np.ndarray]:
        for at, n, words in self.streams[stream]:
            yield unpack(np.frombuffer(self.file.read_at(8 * words, at), "<u8"), n)

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """(document id, its ids in parts), in order; a document's parts must be used before the next is asked for."""
        lengths = (int(x) for block in self.blocks("lengths") for x in block)
        codes = (int(x) for block in self.blocks("docs") for x in block)
        blocks, rest, known = self.blocks("ids"), np.zeros(0, np.uint64), 0
        for n, code in zip(lengths, codes, strict=True):
            if code:
                known += ((code - 1) >> 1) ^ -((code - 1) & 1)
            parts = []
            while n > len(rest):
                parts.append(rest)
                n -= len(rest)
                rest = next(blocks)
            parts.append(rest[:n])
            rest = rest[n:]
            yield (known if code else None), iter(parts)


#: Normalizers that treat words on their own, and a pattern that never joins what blanks, or stops after a letter or digit, separate.
WORD_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def works_by_words(tokenizer_json: str) -> bool:
    """Whether a text's ids are those of its words, in lower case and with the stops at their ends apart, one after the other."""
    t = json.loads(tokenizer_json)
    norm, split = t.get("normalizer") or {}, t.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers") or [{}]
    first, rest = steps[0], steps[1:]
    return (
        norm.get("type") == "Sequence" and list(norm.get("normalizers", ())) == list(WORD_NORMALIZERS) and split.get("type") == "Sequence"
        and (first.get("type"), first.get("behavior"), first.get("invert"), first.get("pattern")) == ("Split", "Removed", True, {"Regex": WORD_PATTERN})
        and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in rest) and not t.get("post_processor")
        and all(a["content"].startswith("<|") and not (a["lstrip"] or a["rstrip"]) for a in t.get("added_tokens", ()))
    )


class Encoder:
    """Encodes texts word by word through the tokenizers library, each different word once while the cache lasts.

    Where the tokenizer's own settings do not allow that, whole texts are given to it.
    """

    def __init__(self, tokenizer_json: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.by_words = Tokenizer.from_str(tokenizer_json), np.array([end_id], np.uint32), works_by_words(tokenizer_json)
        self._empty()

    def _empty(self) -> None:
        self.index = Numbers()
        self.flat, self.first, self.many = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text and the end id. A text of more than two pieces is worked on piece by piece."""
        if not self.by_words:
            coded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.concatenate((np.array(c.ids, np.uint32), self.end)) for c in coded]
        if len(texts) == 1 and len(texts[0]) > 2 * PIECE_BYTES:
            parts = [self._ids([p])[0] for p in pieces_at_blanks(texts[0])]
            return [np.concatenate((*parts, self.end))]
        return [np.concatenate((ids, self.end)) for ids in self._ids(texts)]

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self._empty()
        known = len(self.index)
        # only words without a special token's mark may change case before the tokenizer does it
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        last = np.cumsum([len(w) for w in words])
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(last[-1]))
        self._learn(known)
        many = self.many[at]
        end = np.concatenate(([0], np.cumsum(many)))
        place = np.repeat(self.first[at] - end[:-1], many) + np.arange(int(end[-1]))
        return np.split(self.flat[place], end[last][:-1])

    def _learn(self, known: int) -> None:
        """Encodes the words that were added to the index; a word and the stops after it are always separate for the tokenizer."""
        index, parts = self.index, {}
        for w in list(islice(index, known, None)):
            body = w.rstrip(b".,")
            if body != w and body[-1:].isalnum():
                parts[w] = (index[body], index[w[len(body) :]])
        fresh = list(islice(index, known, None))
        if not fresh:
            return
        plain = [w.decode() for w in fresh if w not in parts]
        coded = (e.ids for at in range(0, len(plain), 10_000) for e in self.tokenizer.encode_batch_fast(plain[at : at + 10_000], add_special_tokens=False))
        ids: list[list[int] | None] = [None if w in parts else next(coded) for w in fresh]

        def of(k: int) -> list[int]:
            return ids[k - known] if k >= known else self.flat[self.first[k] : self.first[k] + self.many[k]].tolist()

        for k, w in enumerate(fresh):
            if w in parts:
                ids[k] = of(parts[w][0]) + of(parts[w][1])
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(many) - many))
        self.many = np.concatenate((self.many, many))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(many.sum()))))


_ENCODERS: dict[int, Encoder] = {}


def encoder(tokenizer_json: str, end_id: int) -> Encoder:
    """One for each Python worker, with its cache."""
    key = zlib.crc32(tokenizer_json.encode()) * 2**32 + end_id
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json, end_id)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Encodes all texts and writes the files. The manifest: (path, start, n_ids, n_docs), start counts the ids of all files before."""
    spark = docs.sparkSession
    with open(tokenizer_path) as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    folder = new_dir(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, total = None, f"{folder}/{uuid.uuid4().hex}.s8b", 0
        enc = encoder(tokenizer.value, end_id)
        for batch in batches:
            if not out and batch.num_rows:
                out, first = Writer(path), (batch.column(0)[0].as_py(), batch.column(2)[0].as_py())
            ids = iter(batch.column(0).to_pylist())
            for texts in by_bytes(t.as_py() for t in batch.column(1)):
                for coded in enc.encode(texts):
                    out.add(next(ids), coded)
                    total += len(coded)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_ids": total, "n_docs": len(out.docs), "first_doc": first[0], "first_hash": first[1]}], manifest)

    manifest = pa.schema([("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("first_doc", pa.int64()), ("first_hash", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("bytes"))
    # rows of one id, or of none, are spread by a hash of their text
    order = ["id", "hash"]
    rows = rows.withColumn("hash", F.xxhash64("bytes")).repartitionByRange(*order).sortWithinPartitions(*order, "bytes")
    files = stage(rows.mapInArrow(run, "path string, n_ids long, n_docs long, first_doc long, first_hash long"), "tokens-manifest")
    before = W.orderBy(F.col("first_doc").asc_nulls_first(), "first_hash", "path").rowsBetween(W.unboundedPreceding, -1)
    return files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids", "n_docs")


def read_token_files(manifest: DataFrame, per_document: Callable[[Iterator[np.ndarray]], tuple], schema: str) -> DataFrame:
    """(id, start, n_tokens, ...): what ``per_document`` makes of each document's ids, given in parts."""
    manifest = stage(manifest, "tokens-files")
    names = ["id", "start", "n_tokens", *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["start"], []
                for d, parts in Reader(row["path"]).documents():
                    sizes: list[int] = []
                    made = per_document(_counted(parts, sizes))
                    out.append((d, at, sum(sizes), *made))
                    at += sum(sizes)
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if k < 3 else pa.array(c) for k, c in enumerate(zip(*out, strict=True))], names=names)

    n = min(max(manifest.count(), 1), 10_000)
    return manifest.repartition(n).mapInArrow(run, f"id long, start long, n_tokens long, {schema}")


def _counted(parts: Iterator[np.ndarray], sizes: list[int]) -> Iterator[np.ndarray]:
    for part in parts:
        sizes.append(len(part))
        yield part


def ids_crc32(parts: Iterator[np.ndarray]) -> tuple[int]:
    """The checksum of the ids as little-endian unsigned 32-bit integers."""
    crc = 0
    for part in parts:
        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
    return (crc,)
