"""Line deduplication with keep bitmaps.

Long lines become 128-bit hashes, with the text left behind. A key's documents are counted with partial sums in the map tasks. The
occurrences of keys that are frequent are range-partitioned by hash, document (largest id first) and position, and sorted the
same way, so a key that is everywhere spreads over many partitions. A stream over each partition carries the document of the first
occurrence of the current key: that document keeps its lines, those of the documents that follow go. Where a key runs on
from one partition into the next, its first document is taken from a table of the last key of each partition. What is returned for a
document is its compressed keep bitmap: for each 64 lines that lose any, the word's number and its bits.

A key is a line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z in lower case. Keys of at least MIN_CHARS code points in
at least MIN_DOCS documents lose all their lines except in the document with the largest id. Edge cases: a null or
empty text is one empty line; rows without an id count as documents of their own, have no bitmap, and keep all their
lines; rows that share an id count as one document, and each has a bitmap of its own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import flag_maybe_in, stage

MIN_CHARS = 40
MIN_DOCS = 5
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def _hashes(line: Column) -> Column:
    key = _key(line)
    h = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))
    return F.when(F.char_length(key) >= MIN_CHARS, h)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, text): row is the id, or a number of its own for every row where ids repeat."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        return rows.select(F.col("id").alias("row"), "id", "text")
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "lines-rows")


def sorted_stream(lines: DataFrame) -> DataFrame:
    """The lines in order of key, document and position, with their place (at) and partition (part) in that order."""
    order = [F.col("a"), F.col("b"), F.col("id").desc(), F.col("pos"), F.col("row")]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return placed.withColumn("part", F.shiftright("at", 33))


def with_first_document(stream: DataFrame) -> DataFrame:
    """The stream with ``first_id``: the document of the first occurrence of each line's key.

    The window over a partition's order needs its rows by ``part``, and Spark does not know that the range exchange has put them so: the
    frequent lines, five numbers each, are dealt a second time, by partition, and sorted within it.
    """
    through = W.partitionBy("part").orderBy("at")
    begins = F.coalesce((F.lag("a").over(through) != F.col("a")) | (F.lag("b").over(through) != F.col("b")), F.lit(True))
    so_far = through.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = stream.withColumn("begins", begins)
    rows = rows.withColumn("first_id", F.last(F.when(F.col("begins"), F.col("id")), ignorenulls=True).over(so_far))
    rows = stage(rows.withColumn("keys", F.sum(F.col("begins").cast("long")).over(so_far)), "lines-stream")
    # one row for each partition: its last key, and the first document of that as far as the partition knows
    ends = rows.groupBy("part").agg(F.max_by(F.struct("a", "b", "first_id"), "at").alias("end"))
    ends = ends.groupBy("end.a", "end.b").agg(F.min("part").alias("since"), F.min_by("end.first_id", "part").alias("carried"))
    # of a partition's lines only those of its first key can have begun before it
    joined = rows.join(F.broadcast(ends), ["a", "b"], "left")
    runs_on = (F.col("keys") == 1) & (F.col("since") < F.col("part"))
    return joined.withColumn("first_id", F.when(runs_on, F.col("carried")).otherwise(F.col("first_id"))).select("row", "id", "pos", "first_id")


def drop_bitmaps(rows: DataFrame) -> DataFrame:
    """(row, words): for rows that lose lines, an array of (word, keep): lines 64 * word to 64 * word + 63, a set bit stays."""
    lines = rows.select("row", "id", F.posexplode(F.transform(lines_of(F.col("text")), _hashes)).alias("pos", "key"))
    lines = stage(lines.where("key is not null").select("row", "id", "pos", "key.a", "key.b"), "lines")
    once = lines.groupBy("a", "b", "id").agg(F.count(F.lit(1)).alias("lines"))
    spread = F.when(F.col("id").isNull(), F.col("lines")).otherwise(F.lit(1))
    frequent = once.groupBy("a", "b").agg(F.sum(spread).alias("docs"))
    frequent = stage(frequent.where(F.col("docs") >= MIN_DOCS).select("a", "b"), "lines-frequent")
    met = stage(lines.where("id is not null").join(frequent, ["a", "b"], "left_semi"), "lines-met")
    lost = with_first_document(sorted_stream(met)).where("id <> first_id")
    word = (F.col("pos") / 64).cast("int").alias("word")
    words = lost.groupBy("row", word).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("keep"))
    return words.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("word", "keep"))).alias("words"))


def apply_bitmaps(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row (row, id, text): the lines that stay, joined.

    Only documents that may have a bitmap are shuffled to meet it; the others stay where they are read.
    """
    bitmaps = stage(bitmaps, "lines-bitmaps")
    flagged = flag_maybe_in(rows, "row", bitmaps, "row", "maybe")
    n_lines = F.size(lines_of(F.col("text"))).cast("long").alias("n_lines")
    whole = flagged.where("not maybe").select("id", n_lines, F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    # a sort-merge join at every size: a broadcast of few bitmaps would only make small inputs look cheaper
    met = flagged.where("maybe").join(bitmaps.hint("merge"), "row", "left").select("id", lines_of(F.col("text")).alias("lines"), F.map_from_entries("words").alias("words"))
    dense = F.expr("transform(sequence(0, cast((size(lines) - 1) / 64 as int)), w -> coalesce(try_element_at(words, w), -1L))")
    stay = F.expr("filter(lines, (x, i) -> (shiftright(dense[cast(i / 64 as int)], i % 64) & 1L) = 1L)")
    cut = met.withColumn("dense", dense).select("id", F.size("lines").cast("long").alias("n_lines"), stay.alias("stay"))
    cut = cut.select("id", "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_dropped"), F.array_join("stay", "\n").alias("kept"))
    return whole.unionByName(cut)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row."""
    rows = numbered(docs, id_col, text_col)
    return apply_bitmaps(rows, drop_bitmaps(rows))
