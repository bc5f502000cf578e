"""Near copies by five-word shingles: documents whose sets of shingles have a Jaccard similarity of SIMILAR or more.

Candidates come from SimHash. A set has two independent SimHashes: one of 64 bits, and one of BANDS bands of BITS bits, whose sums are a
Hadamard transform of the signed counts of its hashes. At a similarity of 0.8 a bit differs with a probability of 0.15, so two such sets
agree on a band with 0.072 and on one band at least with 1 - (1 - 0.072)^BANDS, 0.99997. Documents that share a band are candidates
within RADIUS of the 64 bits and FAR of the first NEAR_BANDS bands and at like sizes; the rest are counted exactly, on 64-bit hashes of
the shingles. Beyond CHANCE << BITS documents bands are longer, so that unlike texts that meet in a bucket by chance are CHANCE at most on
average, and more, so that as few copies are missed.

Equal sets are one node. First, nodes that share two neighbouring bands are compared with the least one of them only, so a large group of
copies costs no more than its size. Candidates of this pass, similar or not, are one cluster. Then all bands are joined, for nodes that
are still in different clusters; where one cluster fills a bucket, its nodes meet the others' only. Pairs found there unite clusters, so no
group makes a row for each of its pairs, be it over the limit or just under it. Clusters of more than one component are compared in the condition of a
join, by sketches: the SKETCH least hashes of a set, which are all of it or, in a larger set, a sample that puts its similarity within
SLACK. A pair becomes a row of sets only if it is similar by that, and is then counted exactly like the others.

Edge cases: null and empty texts and texts without words are equal; a text of fewer than five words is one shingle; how often a
shingle occurs does not count. Rows without an id are in no group. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, stage, utf8, word_chunks
from .components import connected_components
from .decontaminate import WORDS, shingle_spans, span_hashes

SIMILAR = 0.8
BANDS = 140
BITS = 16
#: Sums of few hashes are often zero, which makes bits less sure: sets of fewer than SHORT hashes have more bands.
SHORT = 16
SHORT_BANDS = 256
#: Bits of the 64 that may differ, five standard deviations over the mean at a similarity of 0.8.
RADIUS = 24
#: Bits of the first bands that may differ, six standard deviations over it and as many below the half that differs in unlike texts.
NEAR_BANDS = 16
FAR = 76
#: Bits of the 64 and of the first FIRST_BANDS bands that may differ, six standard deviations over the mean.
FIRST_BANDS = 4
FIRST_FAR = 44
#: Documents that meet in a bucket by chance, on average, before bands get longer; a bit agrees with AGREE at a similarity of 0.8.
CHANCE = 64
AGREE = 0.8485
#: Rows of one cluster that make its bucket crowded, and nodes of a part of a cluster.
CROWD = 256
#: Rows of a large cluster in a bucket that are worth comparing one of them with the others in the bucket.
HUB = 8
#: Tasks that compare a large cluster by sketches, at most.
PARTS = 8
#: Hashes in a sketch, and six standard deviations of a similarity of 0.8 by so many.
SKETCH = 512
SLACK = 0.11
SEED = 42
#: Shingles worked on at a time.
CHUNK = 1 << 14

#: The sums of the banded SimHash are SIDE x SIDE; bit i of a hash is the parity of i and its low bits, turned by its highest bit.
SIDE = 64
_HADAMARD = np.ones((1, 1))
while len(_HADAMARD) < SIDE:
    _HADAMARD = np.block([[_HADAMARD, _HADAMARD], [_HADAMARD, -_HADAMARD]])


def bits_for(n: int) -> int:
    """Bits of a band for n documents."""
    return BITS + max(0, ceil(log2(max(n, 1) / CHANCE)) - BITS)


def bands_for(bits: int, short: bool = False) -> int:
    """Bands of so many bits that find what BANDS of BITS bits do; for short sets SHORT_BANDS."""
    return ceil((SHORT_BANDS if short else BANDS) / AGREE ** (bits - BITS))


def band_bits(n: int) -> np.ndarray:
    """The bits of n places in bands: all of them once, then all in another order."""
    rng, orders = np.random.default_rng(SEED), []
    for _ in range(-(-n // SIDE**2)):
        orders.append(rng.permutation(SIDE * SIDE))
    return np.concatenate(orders)[:n]


_BAND_BITS = band_bits(SHORT_BANDS * BITS)


def shingle_hashes(text: bytes) -> np.ndarray:
    """Hashes of the text's different shingles, in order."""
    parts = [np.unique(span_hashes(*shingle_spans(words))) for words in word_chunks(text, WORDS - 1)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def signature(hashes: np.ndarray, bits: int = BITS, places: np.ndarray = _BAND_BITS) -> tuple[int, np.ndarray]:
    """The SimHash of a set in 64 bits, and the bands of its longer one, each with its number; an empty set has none."""
    counts, signed = np.zeros(64, np.int64), np.zeros(SIDE * SIDE)
    for at in range(0, len(hashes), CHUNK):
        some = hashes[at : at + CHUNK]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        signed += np.bincount((some % np.uint64(SIDE * SIDE)).view(np.int64), 1.0 - 2.0 * (some >> np.uint64(63)), SIDE * SIDE)
    fp = int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])
    if not len(hashes):
        return fp, np.zeros(0, np.uint64)
    sums = _HADAMARD @ signed.reshape(SIDE, SIDE) @ _HADAMARD
    n = bands_for(bits, len(hashes) < SHORT)
    bands = (sums.ravel()[places[: n * bits]] > 0).reshape(n, bits) @ (1 << np.arange(bits))
    return fp, (np.arange(n) << bits | bands).astype(np.uint64)


def signatures(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(id, node, fp, n, keys) of (id, bytes): a hash of the set, its SimHash, its size, and its bands of so many bits."""
    sign = signature if bits == BITS else partial(signature, bits=bits, places=band_bits(bands_for(bits, True) * bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, keys = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py())
                fp, own = sign(hashes)
                nodes.append(node_of(hashes))
                fps.append(fp)
                sizes.append(len(hashes))
                keys.append((own & np.uint64((1 << 31) - 1)).astype(np.int32))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int32()))], names=["id", "node", "fp", "n", "keys"])

    return docs.mapInArrow(run, "id long, node long, fp long, n long, keys array<int>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes, sketch) of the wanted (id, node), read from (id, bytes), each node once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py()) for t in batch.column(1)]
            nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            sketches = [np.sort(s.view(np.int64))[:SKETCH] for s in sets]
            columns = [batch.column(0), pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "hashes", "sketch"])

    sets = maybe_in(docs, "id", wanted, "id").mapInArrow(read, "id long, node long, hashes binary, sketch array<long>")
    return maybe_in(sets, "node", wanted, "node").join(wanted, ["id", "node"]).dropDuplicates(["node"])


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): ids of the pairs (a, node_a, b, node_b) whose sets, read from (id, bytes), are similar."""
    pairs = stage(pairs.distinct(), "copies-pairs")
    wanted = pairs.select(F.col("a").alias("id"), F.col("node_a").alias("node")).unionByName(pairs.select(F.col("b").alias("id"), F.col("node_b").alias("node")))
    sets = stage(sets_of(docs, stage(wanted.distinct(), "copies-wanted")).select("node", "hashes"), "copies-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                mask.append(both >= SIMILAR * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    left = sets.select(F.col("node").alias("node_a"), F.col("hashes").alias("hashes_a"))
    right = sets.select(F.col("node").alias("node_b"), F.col("hashes").alias("hashes_b"))
    both = pairs.join(left, "node_a").join(right, "node_b").select("a", "b", "hashes_a", "hashes_b")
    return both.mapInArrow(compare, "a long, b long")


def similar_by_sketch(x: str, y: str) -> str:
    """Of two sketches, the values up to the least end of one that is cut off are a sample of both sets; of whole sets, all of them."""
    end = lambda z: f"if({z}.n > {SKETCH}, element_at({z}.sketch, -1), {(1 << 63) - 1}L)"
    part = lambda z: f"filter({z}.sketch, v -> v <= least({end(x)}, {end(y)}))"
    whole = f"{1 + SIMILAR} * size(array_intersect({x}.sketch, {y}.sketch)) >= {SIMILAR} * ({x}.n + {y}.n) - 1e-9"
    least = SIMILAR - SLACK
    sample = f"{1 + least} * size(array_intersect({part(x)}, {part(y)})) >= {least} * (size({part(x)}) + size({part(y)}))"
    return f"if({x}.n <= {SKETCH} and {y}.n <= {SKETCH}, {whole}, {sample})"


def _near(x: str, y: str) -> str:
    return f"bit_count({x}.fp ^ {y}.fp) <= {RADIUS} and least({x}.n, {y}.n) >= {SIMILAR} * greatest({x}.n, {y}.n) - 1e-9"


def _pair(x: str, y: str) -> list:
    return [F.col(f"{x}.rep").alias("a"), F.col(f"{x}.node").alias("node_a"), F.col(f"{y}.rep").alias("b"), F.col(f"{y}.node").alias("node_b")]


def _far_apart(x: str, y: str) -> str:
    return f"aggregate(zip_with({x}.bands, {y}.bands, (p, q) -> bit_count((p ^ q) & {(1 << BITS) - 1})), 0, (s, d) -> s + d)"


def hub_pairs(nodes: DataFrame) -> DataFrame:
    """(node_a, node_b): of (node, keys), every node that shares two neighbouring bands with others, and the least of these."""
    both = "if(size(keys) < 2, array(), transform(sequence(0, size(keys) div 2 - 1), i -> shiftleft(cast(keys[2 * i] as long), 32) | keys[2 * i + 1]))"
    keyed = nodes.select(F.explode(F.expr(both).cast("array<long>")).alias("key"), "node")
    hubs = stage(keyed.groupBy("key").agg(F.min("node").alias("node_b"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "node_b"), "copies-hubs")
    return maybe_in(keyed, "key", hubs, "key").join(hubs, "key").where("node <> node_b").select(F.col("node").alias("node_a"), "node_b").distinct()


def _keyed(nodes: DataFrame) -> DataFrame:
    first = f"aggregate(slice(keys, 1, {FIRST_BANDS}), 0L, (s, k) -> shiftleft(s, {BITS}) | (k & {(1 << BITS) - 1}))"
    return nodes.select(F.explode("keys").alias("key"), "node", "fp", F.expr(first).alias("first"), F.col("n").cast("int").alias("n"), "g")


def _near_first(x: str, y: str) -> str:
    return f"bit_count({x}.fp ^ {y}.fp) + bit_count({x}.first ^ {y}.first) <= {FIRST_FAR} and {_near(x, y)}"


def _large(nodes: DataFrame) -> DataFrame:
    return F.broadcast(stage(nodes.groupBy("g").count().where(F.col("count") >= CROWD).select("g"), "copies-large"))


def crowd_pairs(nodes: DataFrame) -> DataFrame:
    """(node_a, node_b): of (node, fp, n, keys, g), nodes that share a band with several of a large cluster and pass the test with one of these."""
    keyed = _keyed(nodes)
    hubs = keyed.join(_large(nodes), "g").groupBy("key", "g").agg(F.count(F.lit(1)).alias("count"), F.min_by(F.struct("node", "fp", "first", "n", "g"), F.xxhash64("node", "key")).alias("y"))
    hubs = stage(hubs.where(F.col("count") >= HUB).groupBy("key").agg(F.max_by("y", F.struct("count", "g")).alias("y")), "copies-crowd-hubs")
    met = maybe_in(keyed, "key", hubs, "key").alias("x").join(hubs, "key").where(f"x.g <> y.g and {_near_first('x', 'y')}")
    return met.select(F.col("x.node").alias("node_a"), F.col("y.node").alias("node_b")).distinct()


def band_pairs(nodes: DataFrame) -> DataFrame:
    """(node_a, node_b): of (node, fp, n, keys, g), those of different clusters g that share a band and pass the test of fingerprints and sizes."""
    keyed = _keyed(nodes)
    crowds = keyed.join(_large(nodes), "g").groupBy("key", "g").count().where(F.col("count") >= CROWD)
    crowds = stage(crowds.groupBy("key").agg(F.max_by("g", F.struct("count", "g")).alias("most")), "copies-crowds")
    keyed = keyed.repartition("key")
    left = keyed.join(F.broadcast(crowds), "key", "left").where("most is null or g <> most").alias("x")
    tests = ["x.key = y.key", "x.g <> y.g", "(x.node < y.node or y.g <=> x.most)", _near_first("x", "y")]
    found = left.join(keyed.alias("y").hint("merge"), F.expr(" and ".join(tests)))
    return found.select(F.least("x.node", "y.node").alias("node_a"), F.greatest("x.node", "y.node").alias("node_b")).distinct()


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, node_a, b, node_b) of the pairs (node_a, node_b) that all fingerprints and the sizes allow."""
    told = nodes.select("node", F.struct("rep", "node", "fp", "n", F.slice("keys", 1, NEAR_BANDS).alias("bands")).alias("x"))
    both = pairs.join(told.withColumnRenamed("node", "node_a"), "node_a").join(told.select(F.col("node").alias("node_b"), F.col("x").alias("y")), "node_b")
    return both.where("x.rep <> y.rep").where(_near("x", "y")).where(f"{_far_apart('x', 'y')} <= {FAR}").select(*_pair("x", "y"))


def similar_pairs(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, node_a, b, node_b): similar by sketches, of the nodes (rep, node, fp, n, c, cluster) of one cluster and of different components c."""
    sketches = sets_of(docs, asked.select(F.col("rep").alias("id"), "node")).select("node", "sketch")
    asked = stage(asked.join(sketches, "node").select("cluster", F.struct("rep", "node", "fp", "n", "sketch").alias("x"), "c"), "copies-sketched")
    # large clusters are dealt to several tasks: the nodes x by parts, the nodes y to all parts
    parts = asked.groupBy("cluster").agg(F.least(F.lit(PARTS), F.ceil(F.count(F.lit(1)) / CROWD)).cast("int").alias("parts"))
    asked = asked.join(F.broadcast(stage(parts.where("parts > 1"), "copies-parts")), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    other = asked.select("cluster", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("x").alias("y"), F.col("c").alias("d"))
    asked = asked.withColumn("part", F.expr("cast(pmod(xxhash64(x.node), parts) as int)"))
    tests = ["c <> d and x.node < y.node", _near("x", "y"), similar_by_sketch("x", "y")]
    return asked.join(other, ["cluster", "part"]).where(" and ".join(tests)).select(*_pair("x", "y"))


def _edges(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _with_group(nodes: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """The nodes with the group of each one's rep, which is the rep itself if it is in none."""
    return nodes.join(groups.select(F.col("node").alias("rep"), F.col("component").alias(name)), "rep", "left").withColumn(name, F.coalesce(name, "rep"))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): for every row with an id, the smallest id reachable over pairs of similar documents."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("bytes")).where("id is not null")
    rows = stage(signatures(texts, bits_for(texts.count())), "copies-signatures")
    nodes = stage(rows.groupBy("node").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("fp", "n", "keys")]), "copies-nodes")
    first = stage(near_pairs(hub_pairs(nodes), nodes), "copies-first")
    found = stage(connected_components(verified(texts, first)), "copies-components")
    met = stage(connected_components(first), "copies-met")
    # what the first pass left apart; large clusters take in what is near one of their nodes first
    named = stage(_with_group(_with_group(nodes, found, "c"), met, "g"), "copies-named")
    pairs = stage(near_pairs(crowd_pairs(named), named), "copies-crowd-near")
    met = stage(connected_components(pairs.select("a", "b").unionByName(_edges(met))), "copies-met")
    named = stage(_with_group(named.drop("g"), met, "g"), "copies-named")
    pairs = stage(near_pairs(stage(band_pairs(named), "copies-bands"), named), "copies-near")
    met = connected_components(pairs.select("a", "b").unionByName(_edges(met)))
    asked = stage(_with_group(named.drop("keys", "g"), met, "cluster"), "copies-clusters")
    open_ = asked.groupBy("cluster").agg(F.min("c").alias("c"), F.max("c").alias("d")).where("c <> d").select("cluster")
    asked = stage(asked.join(open_, "cluster"), "copies-asked")
    if not asked.isEmpty():
        more = stage(verified(texts, similar_pairs(texts, asked)), "copies-more")
        found = stage(connected_components(_edges(found).unionByName(more)), "copies-components")
    named = nodes.select("node", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = stage(named.select("node", F.coalesce("component", "rep").alias("component")), "copies-groups")
    return rows.select("id", "node").join(named, "node").select("id", "component")
