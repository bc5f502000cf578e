"""Exact quantiles without a table of all values: ranges that hold a wanted rank are narrowed by histograms.

First every value falls into a bucket of its sign and logarithm (some hundred for most data, whatever its scale); a bucket has its count
and its least and greatest value. Only buckets with a wanted rank go on: they are cut into PARTS equal parts between their own ends,
and the parts with a wanted rank, about one value in PARTS, are counted value by value. All columns and groups go through the same three
passes, and what is shuffled is histograms, summed up in the map tasks first. Rows stay where they are read and the buckets come to them by
broadcast; only rows of groups of up to LARGE values, which may be any number of groups, meet their buckets in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets for a factor of e, and parts of a bucket.
STEPS = 64
PARTS = 4096
#: Groups with more values get their buckets by broadcast: of a billion values, ten thousand groups at most.
LARGE = 100_000


def _ranks(n: Column, points: list[float]) -> Column:
    places = [F.lit(float(p)) * (n - 1) for p in points]
    return F.array_distinct(F.array(*[f(x) for x in places for f in (F.floor, F.ceil)]))


def _wanted(cells: DataFrame, group: list[str], points: list[float]) -> DataFrame:
    """Of cells (group, from, lo, hi, m, n) in the order of lo, those with a wanted rank; ``from`` is how many values come before the cell."""
    before = F.sum("m").over(W.partitionBy(*group, "from").orderBy("lo").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumn("from", F.col("from") + F.coalesce(before, F.lit(0)))
    inside = F.exists(_ranks(F.col("n"), points), lambda k: (F.col("from") <= k) & (k < F.col("from") + F.col("m")))
    return cells.where(inside)


def _cells_of(rows: DataFrame, cells: DataFrame, group: list[str]) -> DataFrame:
    """The rows (group, x) that lie in one of the cells of their group, with ``cell``."""
    held = cells.groupBy(*group).agg(F.collect_list(F.struct("from", "lo", "hi", "n")).alias("cells"), F.max("n").alias("n"))
    if group == ["column"]:
        met = rows.join(F.broadcast(held.drop("n")), group)
    else:
        large = held.where(F.col("n") > LARGE).drop("n")
        rest = rows.join(F.broadcast(large.select(*group)), group, "left_anti")
        # merged, as else the optimizer may take the rows for the small side and broadcast them
        met = rows.join(F.broadcast(large), group).unionByName(rest.join(held.where(F.col("n") <= LARGE).drop("n").hint("merge"), group))
    found = met.withColumn("cell", F.get(F.filter("cells", lambda c: (c["lo"] <= F.col("x")) & (F.col("x") <= c["hi"])), 0))
    return found.where("cell is not null").drop("cells")


def _counted(rows: DataFrame, group: list[str], part: Column) -> DataFrame:
    keys = [*group, F.col("cell.from").alias("from"), F.col("cell.n").alias("n"), part.alias("part")]
    return rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("m"))


def column_quantiles(df: DataFrame, keys: list[str], cols: list[str], points: list[float]) -> DataFrame:
    """(keys, column, n, quantiles): the interpolated quantiles of every column by group. Null and NaN count as no value; a group without
    values in a column has no row for it. Null keys are groups of their own."""
    names = [f"k{i}" for i in range(len(keys))]
    own = [F.struct(F.col(k).alias("v")).alias(n) for k, n in zip(keys, names, strict=True)]  # a struct is never null, so null keys join
    value = lambda c: (F.col(c).cast("double") + F.lit(0.0)).alias("x")
    if len(cols) == 1:
        rows = df.select(*own, F.lit(cols[0]).alias("column"), value(cols[0]))
    else:
        rows = df.select(*own, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c)) for c in cols])).alias("c")).select(*names, "c.*")
    rows, group = rows.where("x is not null and not isnan(x)"), [*names, "column"]
    scale = F.when(F.col("x") == 0, F.lit(0)).otherwise(F.signum("x") * (F.floor(F.log(F.abs("x")) * STEPS) + 100_000)).cast("long")
    hist = rows.groupBy(*group, scale.alias("part")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("m"))
    hist = hist.withColumn("n", F.sum("m").over(W.partitionBy(*group))).withColumn("from", F.lit(0).cast("long"))
    width = F.col("cell.hi") - F.col("cell.lo")
    part = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("cell.lo")) / width * PARTS), F.lit(PARTS - 1))).otherwise(0)
    cells = _wanted(_counted(_cells_of(rows, _wanted(hist, group, points), group), group, part), group, points)
    values = _wanted(_counted(_cells_of(rows, cells, group), group, F.col("x")), group, points)
    at = lambda k: F.max(F.when((F.col("from") <= k) & (k < F.col("from") + F.col("m")), F.col("lo")))
    out = []
    for p in points:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * F.max(place - F.floor(place))))
    found = values.groupBy(*group).agg(F.max("n").alias("n"), F.array(*out).alias("quantiles"))
    return found.select(*[F.col(f"{n}.v").alias(k) for k, n in zip(keys, names, strict=True)], "column", "n", "quantiles")


def exact_quantiles(df: DataFrame, keys: list[str], x: str, points: list[float], name: str) -> DataFrame:
    """(keys, name): the interpolated quantiles of x, as an array, by group or (without keys) of all rows; null counts as no value.

    A group without values is left out; without keys there is always one row, of nulls if there is no value.
    """
    found = column_quantiles(df, keys, [x], points)
    return found.select(*keys, F.col("quantiles").alias(name)) if keys else found.agg(F.coalesce(F.first("quantiles"), F.array(*[F.lit(None).cast("double")] * len(points))).alias(name))
