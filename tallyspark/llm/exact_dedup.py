"""Exact deduplication with a log-structured merge index of text digests.

Memtables: rows fill them in the order in which they are read, MEMTABLE_ROWS at most in each, and each is flushed as a run:
one entry for each digest, sorted, with the smallest id and the number of rows. Compaction deals the entries of all runs to new
runs by ranges of the digest, RUN_ROWS or so in each, merges them in order of digest and id, and keeps the first
identifier of each digest. Every new run has a Bloom filter of its digests that have more than one row.

A row looks its digest up in the one run whose range covers it. Most rows are ruled out by the run's filter: they are alone, and
the run is not read for them. The others are joined with the run's entries, and those that have one with more rows are
hits. Hits receive byte verification: their texts, found by id, are grouped by digest and text (equal texts
meet in the map tasks already), and where a digest has two texts, each text is a group of its own. Other texts are read once.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] becomes one space. Edge cases: a null text counts as
empty; rows without an id belong to their group and are never the row that stays unless no row of it has an id (then
keep_id is null and none is marked kept); repeated rows with the same id share its verdict. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CHUNK_BITS, FILTER_MOST, filter_chunks, flag_maybe_in, probe_chunks, stage

#: Rows of a memtable: a power of two.
MEMTABLE_ROWS = 1 << 16
#: Entries of a compacted run, on average; a run's filter is made for no more.
RUN_ROWS = 1 << 14


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, norm, digest)"""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    return texts.withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))


def flush(digests: DataFrame) -> DataFrame:
    """(memtable, digest, keep_id, n): the runs that the memtables of (memtable, id, digest) leave, each sorted by digest."""
    entries = digests.repartition("memtable").groupBy("memtable", "digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return stage(entries.sortWithinPartitions("memtable", "digest"), "dedup-runs")


def run_of(digest: Column, runs: int) -> Column:
    """The run whose range covers a digest; ranges are as wide as one another, and digests are uniform."""
    lead = F.conv(F.hex(F.substring(digest, 1, 5)), 16, 10).cast("double") / float(1 << 40)
    return (lead * runs).cast("int")


def merged(entries: DataFrame, runs: int) -> DataFrame:
    """(run, digest, keep_id, n): the entries of all runs merged in order; the first identifier of a digest is the smallest.

    One exchange by range and one sort; the window streams over them.
    """
    order = ["run", "digest", F.col("keep_id").asc_nulls_last()]
    rows = entries.withColumn("run", run_of(F.col("digest"), runs)).repartitionByRange("run").sortWithinPartitions(*order)
    same = W.partitionBy("run", "digest")
    first = F.row_number().over(same.orderBy(order[2]))
    total = F.sum("n").over(same.orderBy(order[2]).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.select("run", "digest", "keep_id", first.alias("place"), total.alias("n")).where("place = 1").drop("place")


def compact(entries: DataFrame, runs: int) -> DataFrame:
    return stage(merged(entries, runs), "dedup-level")


def look_up(digests: DataFrame, level: DataFrame, runs: int) -> DataFrame:
    """(id, digest, asked, keep_id, n): asked rows passed the filter of their run; the last two are null unless the run has more rows."""
    hits = level.where("n > 1")
    run = run_of(F.col("digest"), runs)
    if runs * CHUNK_BITS > FILTER_MOST:  # too many to be broadcast: every row reads its run
        flagged = digests.withColumn("asked", F.lit(True))
    else:
        flagged = probe_chunks(digests, run, F.col("digest"), filter_chunks(hits, F.col("run"), F.col("digest")), "asked")
    columns = ["id", "digest", "asked"]
    alone = flagged.where("not asked").select(*columns, F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("n"))
    read = flagged.where("asked").select(*columns).join(hits.select("digest", "keep_id", "n"), "digest", "left")
    return alone.unionByName(read.select(*columns, "keep_id", "n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, sha256): for every row, the row of its group that stays."""
    texts = digests_of(docs, id_col, text_col)
    memtable = F.shiftright(F.monotonically_increasing_id(), MEMTABLE_ROWS.bit_length() - 1).alias("memtable")
    digests = stage(texts.select(memtable, "id", "digest"), "dedup-digests")
    entries = flush(digests)
    runs = max(-(-entries.count() // RUN_ROWS), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = stage(look_up(digests, compact(entries, runs), runs), "dedup-found")
    hits = found.where("n > 1").select("id", "digest", "keep_id", "n")
    held = flag_maybe_in(docs, id_col, hits, "id", "__hit").where(F.col("__hit") | F.col(id_col).isNull())
    verified = digests_of(held, id_col, text_col).groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    verified = stage(verified, "dedup-verified")
    split = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    split = stage(split.where("texts > 1").select("digest"), "dedup-split")
    out = found.select("id", "digest", F.when(F.col("n") > 1, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"))
    if not split.isEmpty():  # different texts with one digest: group them by the text itself
        own = digests_of(held, id_col, text_col).join(split, "digest", "left_semi").join(verified, ["digest", "norm"])
        out = out.join(split, "digest", "left_anti").unionByName(own.select(*out.columns))
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False))
    return out.select("id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("sha256"))
