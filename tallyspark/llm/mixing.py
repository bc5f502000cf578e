"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated Poisson(rate of s) times, where rate = target share of s * total size / size of s,
so the expected size of the mix is that of the input, and each source's part of it is its target share. The count is
found by inverting the Poisson distribution at a number between 0 and 1 that a hash of seed and id gives, so it is the same
on every run and machine. Copies are exploded and shuffled globally: rows come out in the order of a hash of seed, id and
copy, range-partitioned, so neighbours are unrelated and no partition holds a source.

Target shares are given, or follow the sizes raised to TEMPERATURE (small sources are repeated, large ones thinned).
Size is counted in UTF-8 bytes of text. A rate above CHUNK_RATE is split into independent parts of at most that, whose
counts add up, so no distribution function gets too long or underflows.

Edge cases: null is a source like any other; given shares are scaled to sum to 1, and sources without one get 0, so
their documents go; a source whose texts are all empty has rate 1; rows with the same id share their count; rows without an
id use the id ''; an empty table gives an empty one. Columns of the input are kept; a column that is added replaces one of
its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import md5_unit, spare, stage

TEMPERATURE = 0.5
SEED = 10
CHUNK_RATE = 64.0
#: Up to so many sources are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Terms of the distribution function beyond its mean: the rest is below 1e-15 at CHUNK_RATE.
TAIL = 96


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", shares: dict[str | None, float] | None = None) -> DataFrame:
    """(source, bytes, share, rate) of every source. Sizes are summed in the map tasks before they are shuffled."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("bytes"))
    if shares is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(TEMPERATURE)))
    else:
        weight = F.lit(0.0)
        for name, share in shares.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
        sizes = sizes.withColumn("weight", weight)
    sizes = stage(sizes, "mix-sizes")
    total = sizes.agg(F.sum("bytes").alias("total"), F.sum("weight").alias("weights"))
    share = F.coalesce(F.expr("try_divide(weight, weights)"), F.lit(0.0))
    rate = F.when(F.col("bytes") == 0, F.lit(1.0)).otherwise(F.col("share") * F.col("total") / F.col("bytes"))
    return sizes.join(F.broadcast(total)).withColumn("share", share).withColumn("rate", rate).select("source", "bytes", "share", "rate")


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds parts (how many Poisson counts add up) and cdf (the distribution function of one, from 0 on)."""
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(CHUNK_RATE)), F.lit(1)).cast("int")
    terms = f"sequence(1, cast(ceil(3 * mean) as int) + {TAIL})"
    step = "(s, k) -> named_struct('p', s.p * mean / k, 'c', s.c + s.p * mean / k, 'all', array_append(s.all, s.c + s.p * mean / k))"
    start = "named_struct('p', exp(-mean), 'c', exp(-mean), 'all', array(exp(-mean)))"
    cdf = F.expr(f"aggregate({terms}, {start}, {step}, s -> s.all)")
    return rates.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts")).withColumn("cdf", cdf)


def replicate(
    docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, names: tuple[str, str, str] = ("n_copies", "copy", "rate")
) -> DataFrame:
    """The documents with n_copies, copy (from 0) and rate, under the names given, a row for each copy, in the order of the rows given."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    n_copies, copy, rate = names
    source, own_rate, parts, cdf, units = spare(docs, "source", "rate", "parts", "cdf", "units")
    table = poisson_table(rates).select(F.col("source").alias(source), F.col("rate").alias(own_rate), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = docs.join(table, F.col(source_col).eqNullSafe(F.col(source)))
    numbers = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda part: md5_unit(str(seed), key, part))
    count = F.expr(f"aggregate({units}, 0, (n, u) -> n + size(filter({cdf}, c -> c <= u)))")
    rows = rows.withColumn(units, numbers).withColumn(n_copies, count).withColumn(rate, F.col(own_rate))
    rows = rows.where(F.col(n_copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1)))
    return rows.drop(source, own_rate, parts, cdf, units)


def shuffled(copies: DataFrame, id_col: str = "doc_id", seed: int = SEED, copy: str = "copy") -> DataFrame:
    """The copies in a global order that a hash decides."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return copies.orderBy(F.xxhash64(F.lit(f"order{seed}"), key, F.col(copy)), key, F.col(copy))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shares: dict[str | None, float] | None = None,
    seed: int = SEED, names: tuple[str, str, str] = ("n_copies", "copy", "rate"),
) -> DataFrame:
    """The mixed documents, globally shuffled, with n_copies, copy and rate under the names given."""
    return shuffled(replicate(docs, source_rates(docs, source_col, text_col, shares), id_col, source_col, seed, names), id_col, seed, names[1])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix with the columns of the documents only, whatever they are called."""
    names = spare(docs, "n_copies", "copy", "rate")
    return mix(docs, id_col, source_col, text_col, names=tuple(names)).select(*docs.columns)
