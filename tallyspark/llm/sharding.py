"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At every level each child of the node draws ln(u) / weight with u a hash of its name and the document's id, and the highest draw
wins, so children are chosen in proportion to their weights, and a child whose weight changes only gains or loses rows of
its own subtree. New capacity enters as a region of its own: no other weight changes, so rows only move into it.

Slots number the rows of a shard from 0 without gaps, in order of id, size and checksum. They are counted over range
partitions, so no shard is gathered in one task: only one count for each shard and partition is summed up.

Edge cases: a shard, rack or region of weight 0 is drained and gets no row; a null or empty text has 0 bytes and checksum 0; all rows with one id (also null) go to one shard and get
slots of their own; an empty table gives an empty one. Other columns are kept by ``shard_documents`` unless their names
clash with a column it adds, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import md5_unit, stage, utf8

#: Bytes that every row takes besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Tree:
    """regions[r][k] lists the weights of the shards of rack k in region r; shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    def __post_init__(self):
        weights = [w for region in self.regions for rack in region for w in rack]
        if any(not 0 <= w < float("inf") for w in weights) or not sum(weights) > 0:
            raise ValueError("weights are finite, none is below 0, and one at least is above")

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        return Tree((*self.regions, ((weight,),)))


def even_tree(regions: int, racks: int, shards: int) -> Tree:
    return Tree((((1.0,) * shards,) * racks,) * regions)


DEFAULT = even_tree(2, 4, 5)


def _draw(names: list[str], weights: list[float], key: Column) -> Column:
    """The index of the child that wins. A child of weight 0 is drained and never does; if all are, which only a drained parent has, the first stands in."""
    live = [(i, name, w) for i, (name, w) in enumerate(zip(names, weights, strict=True)) if w > 0]
    if len(live) <= 1:
        return F.lit(live[0][0] if live else 0)
    draws = [F.struct((F.ln(md5_unit(name, key)) / F.lit(w)).alias("draw"), F.lit(i).alias("child")) for i, name, w in live]
    return F.greatest(*draws)["child"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a row, by its key alone."""
    total = [sum(sum(rack) for rack in region) for region in tree.regions]
    region = _draw([f"region{r}" for r in range(len(tree.regions))], total, key)
    out, at = None, 0
    for r, racks in enumerate(tree.regions):
        inner = None
        rack = _draw([f"region{r}/rack{k}" for k in range(len(racks))], [sum(x) for x in racks], key)
        for k, shards in enumerate(racks):
            leaf = F.lit(at) + _draw([f"region{r}/rack{k}/shard{s}" for s in range(len(shards))], list(shards), key)
            inner = F.when(rack == k, leaf) if inner is None else inner.when(rack == k, leaf)
            at += len(shards)
        out = F.when(region == r, inner) if out is None else out.when(region == r, inner)
    return out


def grown_shard_of(key: Column, shard: Column, tree: Tree, weight: float = 1.0) -> Column:
    """The shard of a row in ``tree.grown(weight)``, given its shard in the tree: only the regions draw again, with the new one among them."""
    total = [sum(sum(rack) for rack in region) for region in tree.regions]
    if weight <= 0:
        return shard
    *own, new = [F.ln(md5_unit(f"region{r}", key)) / F.lit(w) for r, w in enumerate([*total, weight]) if w > 0]
    return F.when(new >= (F.greatest(*own) if len(own) > 1 else own[0]), F.lit(tree.shards)).otherwise(shard)


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null"))


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: Tree = DEFAULT) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) of every row; grown_shard is the shard with one shard more."""
    text, key = utf8(F.col(text_col)), _key(id_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(key, tree).cast("int").alias("shard"),
        key.alias("key"),
    )
    rows = rows.withColumn("grown_shard", grown_shard_of(F.col("key"), F.col("shard"), tree).cast("int")).drop("key")
    order = ["shard", "id", "size", "text_crc32"]
    at = F.monotonically_increasing_id()
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at).withColumn("part", F.shiftright("at", 33)), "shards")
    counts = placed.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "part", (before - F.col("first")).alias("shift"))
    slot = (F.col("at") + F.col("shift")).alias("slot")
    return placed.join(counts, ["shard", "part"]).select("id", "size", "text_crc32", "shard", slot, "grown_shard")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: Tree = DEFAULT) -> DataFrame:
    """The documents with the shard of each and its size in bytes."""
    text = utf8(F.col(text_col))
    return docs.withColumns({"shard": shard_of(_key(id_col), tree).cast("int"), "size": (F.octet_length(text) + ROW_BYTES).cast("long")})
