"""Importance resampling towards a target distribution, by a dictionary of distinct n-grams.

Features are all runs of 1 to 3 words of a text, with repeats. Each falls into one of BUCKETS buckets by the crc32 of its string. A
bucket's gain is the logarithm of how much more often the target has it than the corpus; a document weighs the sum of the gains of
its features. To the weight comes a Gumbel draw that a hash of the id decides, and the highest sums are drawn.

How it works: a task cuts its documents into blocks of BLOCK_BYTES and writes a block down as distinct windows (a word and the two that
follow it, which stand for one feature of each length) with the documents that hold them and how often. Windows are dealt by
their first word over ranges, so each range sees every occurrence of its words, pairs and triples in the corpus: it counts the distinct strings,
hashes each once, and the counts by bucket are summed up over the ranges. The gains, BUCKETS numbers, then join the same ranges,
where they meet the per-document counts of each string, and come back as sums by block and document. A first word that holds over
1 / SPREAD of a block's windows is dealt by the second word too, and such a pair by the third, so no range holds a hot word; its string
is then counted in parts, which the sums by bucket add up.

One exchange carries the windows; both uses read it. Nothing but the BUCKETS sums comes together in one place. The sizes of
blocks and ranges are bounds on memory; how many there are follows the corpus.

Edge cases: a null or empty text, and one without words, has no feature, weight 0 and no rank; repeated rows and rows with one id weigh
alike and each count; a null id draws as ''; texts longer than a block continue in the next; an empty table gives an empty one,
and an empty target gives every bucket t = 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Numbers, pieces_at_blanks, stage, utf8
from .planes import expand, pack, pack_signed, squeeze, unpack, unpack_signed

BUCKETS = 10_000
BLOCK_BYTES = 6 << 20
#: Bytes of text whose windows come together in a range.
RANGE_BYTES = 16 << 20
SPREAD = 256
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Words longer than this are hashed one by one.
LONG_WORD = 48

#: Bytes of words as they are, capitals in lower case, and blanks for all others.
_WORD_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: A block's windows in a range; without words, what it tells of its documents.
_FIELDS = ("words", "first", "second", "third", "held_by", "docs", "times")
_ROWS = pa.schema([("range", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in _FIELDS]])
_ROWS_SQL = "range int, block long, " + ", ".join(f"{c} binary" for c in _FIELDS)
_TOLD, _SUMS = "block long, told array<binary>, docs binary, weights binary", "row long, whole boolean, id long, n_words long, n_features long, weight long"


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out.astype(np.uint32)


_CRC = _crc_table()


class Words:
    """Distinct words by number, their bytes in one array."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def crc(self, which: np.ndarray) -> np.ndarray:
        return np.fromiter((zlib.crc32(self.words[k]) for k in which.tolist()), np.uint32, len(which))

    def crc_after(self, crc: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The checksums of strings with checksums ``crc`` after a blank and a word were added to each."""
        size = self.size[which]
        order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
        size, at = size[order], self.begin[which[order]]
        held = ~crc[order]
        held = _CRC[(held ^ np.uint32(0x20)) & 255] ^ (held >> np.uint32(8))
        long = int(np.searchsorted(-np.minimum(size, LONG_WORD + 1), -LONG_WORD))
        for k in range(long):
            held[k] = ~np.uint32(zlib.crc32(self.words[which[order[k]]], int(~held[k])))
        n = len(size)
        for step in range(int(size[long]) if long < n else 0):
            n = long + int(np.searchsorted(-size[long:], -step))
            part = held[long:n]
            held[long:n] = _CRC[(part ^ self.bytes[at[long:n] + step]) & 255] ^ (part >> np.uint32(8))
        out = np.empty(len(order), np.uint32)
        out[order] = ~held
        return out


class Block:
    """Words of documents, up to a bounded size, as rows of _ROWS: one for each range, and one that tells of the documents."""

    def __init__(self, number: int):
        self.number, self.index, self.bytes = number, Numbers(), 0
        self.words_of: list[np.ndarray] = []
        self.docs: list[tuple[int, int | None, bool, int, int]] = []

    def add(self, row: int, doc_id: int | None, whole: bool, last: bool, words: list[bytes]) -> None:
        """A document or a part of it. Unless it is the last part, its last two words only follow others: the next part begins with them."""
        self.words_of.append(np.array(list(map(self.index.__getitem__, words)), np.int64))
        begun = len(words) if last else max(len(words) - 2, 0)
        features = 3 * begun if not last else sum(max(len(words) - k, 0) for k in range(3))
        self.docs.append((row, doc_id, whole, begun, features))

    def rows(self, ranges: int) -> Iterator[dict]:
        # words are numbered in their own order from 1 on, so that words of neighbouring numbers begin alike
        words = sorted(self.index)
        rank = np.empty(len(words), np.int64)
        rank[[self.index[x] for x in words]] = np.arange(1, len(words) + 1)
        begun = [d[3] for d in self.docs]
        padded = [np.concatenate((rank[ids], (0, 0))) for ids in self.words_of]
        u, v, w = (np.concatenate([x[k : k + n] for x, n in zip(padded, begun, strict=True)]) for k in range(3))
        doc = np.repeat(np.arange(len(begun)), begun)
        bits = len(words).bit_length()
        order = np.argsort((((u << bits) | v) << bits) | w, kind="stable") if 3 * bits < 64 else np.lexsort((w, v, u))
        u, v, w, doc = u[order], v[order], w[order], doc[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(u)))
        where = self._range(u, v, w, words, ranges)[at]
        u, v, w, doc = u[at], v[at], w[at], doc[at]
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(ranges + 1))
        for r in range(ranges):
            if cuts[r] < cuts[r + 1]:
                some = order[cuts[r] : cuts[r + 1]]
                yield self._row(r, u[some], v[some], w[some], doc[some], times[some], words)
        row, ids, whole, begun, features = zip(*self.docs, strict=True)
        flags = [int(x) + 2 * (i is None) for x, i in zip(whole, ids, strict=True)]
        told = [pack_signed(row), pack_signed([i or 0 for i in ids]), pack(flags, "u1"), pack(begun, "<u8"), pack(features, "<u8")]
        yield {"range": self.number % ranges, "block": self.number, "words": None} | dict(zip(_FIELDS[1:], told, strict=False))

    @staticmethod
    def _range(u: np.ndarray, v: np.ndarray, w: np.ndarray, words: list[bytes], ranges: int) -> np.ndarray:
        own = np.fromiter((zlib.crc32(x) for x in words), np.uint64, len(words))
        own = np.concatenate((np.zeros(1, np.uint64), own)) * np.uint64(0x9E3779B97F4A7C15)
        turn = np.uint64(0xBF58476D1CE4E5B9)
        most = max(len(u) // SPREAD, 1)
        hot = np.bincount(u, minlength=len(own))[u] > most
        h = own[u]
        h = np.where(hot, (h ^ (h >> np.uint64(29))) * turn + own[v], h)
        pair_at = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))) if len(u) else np.zeros(0, np.int64)
        of_pair = np.diff(np.append(pair_at, len(u)))
        hot &= np.repeat(of_pair > most, of_pair)
        h = np.where(hot, (h ^ (h >> np.uint64(29))) * turn + own[w], h)
        return (((h ^ (h >> np.uint64(32))) * turn >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)

    def _row(self, r: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, doc: np.ndarray, times: np.ndarray, words: list[bytes]) -> dict:
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        u, v, w = u[at], v[at], w[at]
        used = np.zeros(len(words) + 1, bool)
        used[0] = True
        for x in (u, v, w):
            used[x] = True
        local = np.cumsum(used) - 1
        names = b" ".join([words[k - 1] for k in np.flatnonzero(used)[1:].tolist()])
        held_by = np.diff(np.append(at, len(doc)))
        fields = [squeeze(names), pack(np.diff(local[u], prepend=0)), pack(local[v]), pack(local[w]), pack(held_by), pack(doc), pack(times)]
        return {"range": r, "block": self.number} | dict(zip(_FIELDS, fields, strict=True))


def windows(docs: DataFrame, ranges: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The windows of (id, bytes) as rows of _ROWS. Rows are numbered by partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        n_blocks, row = 1, part
        block = Block(part)

        def send() -> Iterator[pa.RecordBatch]:
            for x in block.rows(ranges):
                yield pa.RecordBatch.from_pylist([x], _ROWS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[bytes] = []
                whole = True
                pieces = pieces_at_blanks(text.as_py().translate(_WORD_BYTES), min(block_bytes, PIECE_BYTES))
                piece = next(pieces)
                while piece is not None:
                    held += piece.split()
                    block.bytes += len(piece) + 1
                    piece = next(pieces, None)
                    if block.bytes >= block_bytes or piece is None:
                        whole &= piece is None
                        block.add(row, doc_id, whole, piece is None, held)
                        held = held[-2:]
                        if block.bytes >= block_bytes:
                            yield from send()
                            block = Block(part + n_blocks)
                            n_blocks += 1
                row += 1
        if block.docs:
            yield from send()

    return docs.mapInArrow(run, _ROWS_SQL)


class Dictionary:
    """The distinct strings of a range: their buckets, and where each window of the rows has its three. Numbers of words are below 2^31."""

    def __init__(self, rows: list[dict]):
        index = Numbers()
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for x in rows:
            names = np.fromiter(map(index.__getitem__, expand(x.pop("words")).split(b" ")), np.int32)
            names = np.concatenate((np.zeros(1, np.int32), names + 1))
            for column, at in zip(columns, (np.cumsum(unpack(x.pop("first"))), unpack(x.pop("second")), unpack(x.pop("third"))), strict=False):
                column.append(names[at])
            held_by = unpack(x["held_by"])
            columns[3].append(np.add.reduceat(unpack(x["times"]), np.cumsum(held_by, dtype=np.int64) - held_by))
        self.sizes = [len(n) for n in columns[3]]
        u, v, w, n = (np.concatenate(columns.pop(0)) for _ in range(4))
        words = Words(list(index))
        del index
        key = u.astype(np.int64) << 32 | v
        del u, v
        pairs, pair_of = np.unique(key, return_inverse=True)
        key = pair_of << 32 | w
        del pair_of, w
        triples, triple_of = np.unique(key, return_inverse=True)
        self.triple_of = triple_of.astype(np.int32)
        del key, triple_of
        n_triples = np.bincount(self.triple_of, n, len(triples))
        self.pair_of, third = (triples >> 32).astype(np.int32), (triples & 0xFFFFFFFF).astype(np.int32)
        n_pairs = np.bincount(self.pair_of, n_triples, len(pairs))
        self.first_of, second = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        del pairs, triples, n
        # a string is hashed once, from where the shorter one that it goes on from ended
        own = np.zeros(len(words.words) + 1, np.uint32)
        ones = np.unique(self.first_of)
        own[ones] = words.crc(ones - 1)
        crc_pairs, crc_triples = own[self.first_of], np.zeros(len(third), np.uint32)
        more = np.flatnonzero(second)
        crc_pairs[more] = words.crc_after(crc_pairs[more], second[more] - 1)
        last = np.flatnonzero(third)
        crc_triples[last] = words.crc_after(crc_pairs[self.pair_of[last]], third[last] - 1)
        self.parts = [(ones, own, np.bincount(self.first_of, n_pairs, len(own))), (more, crc_pairs, n_pairs), (last, crc_triples, n_triples)]

    def bucket_sums(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for which, crc, n in self.parts:
            out += np.bincount(crc[which] % BUCKETS, n[which], BUCKETS)
        return out.astype(np.int64)

    def weights(self, gains: np.ndarray) -> Iterator[np.ndarray]:
        """The weights of each row's windows, a row at a time."""
        ones, pairs, triples = (np.zeros(len(crc), np.int64) for _, crc, _ in self.parts)
        for (which, crc, _), out in zip(self.parts, (ones, pairs, triples), strict=True):
            out[which] = gains[crc[which] % BUCKETS]
        pairs += ones[self.first_of]
        triples += pairs[self.pair_of]
        begin = 0
        for n in self.sizes:
            yield triples[self.triple_of[begin : begin + n]]
            begin += n


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n): how many features of the corpus fall into each bucket, from rows of _ROWS."""

    def run(table: pa.Table) -> pa.Table:
        some = [x for x in _rows(table.select(["words", "first", "second", "third", "held_by", "times"])) if x["words"] is not None]
        sums = Dictionary(some).bucket_sums() if some else np.zeros(BUCKETS, np.int64)
        at = np.flatnonzero(sums)
        return pa.table({"bucket": pa.array(at, pa.int32()), "n": pa.array(sums[at], pa.int64())})

    return rows.groupBy("range").applyInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(own: dict[int, int], target: dict[int, int]) -> np.ndarray:
    all_own, all_target = sum(own.values()), sum(target.values())
    ratio = [(target.get(b, 0) + 1) * (all_own + BUCKETS) / ((own.get(b, 0) + 1) * (all_target + BUCKETS)) for b in range(BUCKETS)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _rows(table: pa.Table) -> Iterator[dict]:
    return (x for batch in table.to_batches(max_chunksize=1) for x in batch.to_pylist())


def _weigh(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
    sides = [{x["bucket"]: x["n"] for x in counts["counts"][0].as_py() if x["target"] == side} for side in (False, True)]
    gains, out, some = bucket_gains(*sides), [], []
    for x in _rows(rows):
        if x["words"] is None:
            out.append({"block": x["block"], "told": [x[c] for c in _FIELDS[1:6]]})
        else:
            some.append(x)
    for x, weights in zip(some, Dictionary(some).weights(gains) if some else (), strict=True):
        docs, sums = unpack(x["docs"]), np.repeat(weights, unpack(x["held_by"])) * unpack(x["times"])
        sums = np.bincount(docs, sums)  # whole numbers below 2^53
        used = np.flatnonzero(np.bincount(docs))
        out.append({"block": x["block"], "docs": pack(used), "weights": pack_signed(sums[used].astype(np.int64))})
    schema = pa.schema([("block", pa.int64()), ("told", pa.list_(pa.binary())), ("docs", pa.binary()), ("weights", pa.binary())])
    return pa.Table.from_pylist(out, schema)


def _add_up(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    told = next(x["told"] for x in rows if x["told"] is not None)
    row, ids = (unpack_signed(x) for x in told[:2])
    flags, n_words, n_features = unpack(told[2], "u1"), unpack(told[3], "<u8"), unpack(told[4], "<u8")
    weight = np.zeros(len(row), np.int64)
    for x in rows:
        if x["docs"] is not None:
            weight[unpack(x["docs"])] += unpack_signed(x["weights"])
    columns = [row, flags & 1 == 1, pa.array(ids, mask=flags & 2 == 2), n_words.view(np.int64), n_features.view(np.int64), weight]
    return pa.table(dict(zip(("row", "whole", "id", "n_words", "n_features", "weight"), columns, strict=True)))


def text_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("bytes"))
    wanted = target.select(F.lit(None).cast("long").alias("id"), utf8(F.col(target_text_col)).alias("bytes"))
    n, n_target = (x.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0 for x in (rows, wanted))
    ranges = max(-(-n // RANGE_BYTES), 1)
    there = windows(rows, ranges)
    aimed = bucket_counts(windows(wanted, max(-(-n_target // RANGE_BYTES), 1))).select("bucket", "n", F.lit(True).alias("target"))
    counts = bucket_counts(there).select("bucket", "n", F.lit(False).alias("target")).unionByName(aimed)
    # at most two rows for each bucket, in one row, which goes to every range
    counts = counts.agg(F.collect_list(F.struct("bucket", "n", "target")).alias("counts"))
    counts = counts.select(F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"), "counts")
    parts = there.groupBy("range").cogroup(counts.groupBy("range")).applyInArrow(_weigh, _TOLD)
    sums = stage(parts.groupBy("block").applyInArrow(_add_up, _SUMS), "resampling-weights")
    spread = sums.where("not whole").groupBy("row").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    return sums.where("whole").select("id", "n_words", "n_features", "weight").unionByName(spread.drop("row"))


def draw(weighed: DataFrame, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds score and rank to (id, n_words, n_features, weight): of rows with enough words, the highest ``percent`` of a hundred.

    Ranks are counted over range partitions, so they need no task that holds all rows.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stage(weighed.withColumn("score", F.col("weight") + gumbel), "resampling-scored")
    able = scored.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("id"), "n_features", "n_words"]
    at = F.monotonically_increasing_id()
    placed = able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at).withColumn("part", F.shiftright("at", 33))
    placed = stage(placed, "resampling-placed")
    parts = placed.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(every), F.lit(0))).withColumn("all", F.sum("n").over(W.partitionBy()))
    parts = parts.select("part", F.expr("before - first + 1").alias("shift"), F.expr(f"{percent} * all div 100").alias("drawn"))
    ranked = placed.join(parts, "part").withColumn("rank", F.col("at") + F.col("shift"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", seed: int = SEED, percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``; rows that are not drawn have no rank."""
    return draw(text_weights(docs, target, id_col, text_col, target_text_col), seed, percent, least_words)
