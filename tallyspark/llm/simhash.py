"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a few differing bits.

Links are found by pigeonhole blocks: a fingerprint is cut into ``max_bits + 2`` blocks, so two fingerprints within
``max_bits`` bits agree on at least two of them. Fingerprints are joined on each pair of blocks and the distance of
every candidate is verified. A bucket of many different fingerprints is not joined with itself: there, each fingerprint
lists itself and its one-bit neighbours, and two fingerprints are within two bits just when they list a common value.
A value is listed by 65 fingerprints at most, so no group grows with the data.

Edge cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other; with
fewer words than a shingle, the whole sequence is the one shingle. Repeated rows come out as often as they come in. Rows
whose id is null link like any other, and get the smallest id of those that they reach, or null. Other columns of the input are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, utf8, without, word_chunks
from .components import connected_components
from .near_copies import copy_groups

SEED = 42
#: Shingles hashed at a time, so that long texts need no more memory than short ones.
CHUNK = 1 << 16
#: A bucket of up to so many different fingerprints is joined with itself; larger ones go by shared neighbours.
PAIR_BUCKET = 32


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    counts, n = np.zeros(64, np.int64), 0
    for words in word_chunks(text, words_per_shingle - 1):
        k = words_per_shingle if n else min(words_per_shingle, len(words))
        if not words or len(words) < k:
            continue
        joined = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        first, last = starts[: len(words) - k + 1], ends[k - 1 :]
        for at in range(0, len(first), CHUNK):
            spans = zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)
            hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int32)
        n += len(first)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("bytes"))
    return rows.mapInArrow(run, "id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(max_bits: int = 2) -> list[int]:
    """Masks of every pair of the ``max_bits + 2`` blocks."""
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def fingerprint_links(nodes: DataFrame, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(a, b): links that join all different fingerprints within two bits, directly or by a common neighbour.

    nodes: (fp, rep), each fingerprint once. a and b are ``rep`` values.
    """
    keys = [F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(block_masks())]
    keyed = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "k.block", "k.key")
    sizes = stage(keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-sizes")
    met = stage(keyed.join(sizes, ["block", "key"]), "simhash-blocks")
    few = met.where(F.col("n") <= pair_bucket)
    left = few.select("block", "key", F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
    right = few.select("block", "key", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    pairs = (
        left.join(right, ["block", "key"])
        .where("fp_a < fp_b and bit_count(fp_a ^ fp_b) <= 2")
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    listed = met.where(F.col("n") > pair_bucket).select("fp", "rep").distinct()
    listed = listed.select("rep", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    common = listed.groupBy("value").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    common = common.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    return pairs.unionByName(common).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp, component): the fingerprint of every row, and the smallest id reachable over links of two bits at most."""
    # what is staged is joined by an exchange of its own, so partitions of very common values can be split
    rows = stage(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash-fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    # components of fingerprints, so one whose rows have no id links others all the same
    links = stage(fingerprint_links(nodes.select("fp", F.col("fp").alias("rep"))), "simhash-links")
    found = connected_components(links, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("group"))
    grouped = stage(nodes.join(found, "fp", "left").select("fp", "rep", F.coalesce("group", "fp").alias("group")), "simhash-groups")
    least = stage(grouped.groupBy("group").agg(F.min("rep").alias("component")), "simhash-least")
    named = stage(grouped.join(least, "group").select("fp", "component"), "simhash-named")
    return rows.join(named, "fp").select("id", "fp", "component")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, of each group of near copies (five-word shingles, similarity 0.8) only that with the smallest id.

    Of rows that share an id one stays, that with the least hash of its text and columns; rows without an id cannot be the smallest of a
    group and all stay.
    """
    found = stage(copy_groups(docs, id_col, text_col), "simhash-groups")
    kept = without(docs, id_col, found.where("id <> component"), "id")
    if found.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        return kept
    plain = [c for c, kind in kept.dtypes if "map<" not in kind and kind != "variant"]
    order = F.struct(F.xxhash64(text_col), F.col(text_col), F.xxhash64(*plain))
    named = kept.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.min_by(F.struct(*kept.columns), order).alias("row"))
    return named.select("row.*").unionByName(kept.where(F.col(id_col).isNull()))
