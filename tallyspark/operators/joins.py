"""Joins that Spark has no single word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import first_by, interval, slice_edges


def asof_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, cols: list[str], tie: list, strict: bool = True, slices: int = 128) -> DataFrame:
    """Each left row with ``cols`` of the last right row of its entity before it (or at it, unless strict); entities may have any size.

    One union, cut into slices of the time at edges that are fixed first: a slice of an entity is sorted on its own, and what the slices
    before it end with comes from a table of one row for each entity and slice. Of right rows with one time the first in the order
    ``tie`` counts; left rows without a match, or without a key, have nulls.
    """
    own = first_by(right.where(F.col(ts).isNotNull()), [*by, ts], tie).select(*by, ts, F.struct(*cols).alias("__right"))
    own = own.withColumn("__side", F.lit(1 if strict else 0)).withColumn("__left", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType))
    asking = left.select(*by, ts, F.struct("*").alias("__left")).withColumn("__side", F.lit(0 if strict else 1))
    number = lambda c: F.unix_micros(c) if right.schema[ts].dataType.typeName() == "timestamp" else F.unix_date(c) if right.schema[ts].dataType.typeName() == "date" else c
    edges = slice_edges(right.select(number(F.col(ts)).alias("t")), "t", slices)
    both = own.unionByName(asking, allowMissingColumns=True).withColumn("__slice", F.coalesce(interval(number(F.col(ts)), edges), F.lit(0)))
    order = [F.col(ts).asc_nulls_first(), F.col("__side")]
    w = W.partitionBy(*by, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = both.withColumn("__found", F.last("__right", ignorenulls=True).over(w)).where("__left is not null")
    ends = own.withColumn("__slice", interval(number(F.col(ts)), edges)).groupBy(*by, "__slice").agg(F.max_by("__right", ts).alias("__end"))
    # an entity's ends and the slices where it asks: as many rows as it has slices
    asked = within.select(*by, "__slice").distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType)).withColumn("__asks", F.lit(1))
    marks = ends.withColumn("__asks", F.lit(0)).unionByName(asked).groupBy(*by, "__slice").agg(F.max("__end").alias("__end"), F.max("__asks").alias("__asks"))
    carry = marks.withColumn("__carry", F.last("__end", ignorenulls=True).over(W.partitionBy(*by).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)))
    carry = carry.where("__asks = 1 and __carry is not null").select(*by, "__slice", "__carry")
    found = within.join(carry, [*by, "__slice"], "left").withColumn("__found", F.coalesce("__found", "__carry"))
    known = F.col(ts).isNotNull()
    for c in by:
        known &= F.col(c).isNotNull()
    return found.select("__left.*", *[F.when(known, F.col(f"__found.{c}")).alias(f"asof_{c}") for c in cols])


def opponent_values(df: DataFrame, game: str, cols: list[str], suffix: str = "_allowed") -> DataFrame:
    """For games of exactly two rows, the other row's values: the game's sum less the own value, in one shuffle."""
    w = W.partitionBy(game)
    out = {f"{c}{suffix}": F.sum(c).over(w) - F.col(c) for c in cols}
    return df.withColumn("__rows", F.count(F.lit(1)).over(w)).where("__rows = 2").withColumns(out).drop("__rows")


def stack_sides(df: DataFrame, common: list[str], first: dict[str, str], second: dict[str, str]) -> DataFrame:
    """One row of two sides as two rows, in one pass. first and second: output name -> input column."""
    sides = [F.struct(*[F.col(c).alias(n) for n, c in side.items()], F.lit(k == 0).alias("is_first")) for k, side in enumerate((first, second))]
    return df.select(*common, F.explode(F.array(*sides)).alias("__side")).select(*common, "__side.*")


def attach_sides(games: DataFrame, rows: DataFrame, key: str, home: str, away: str, cols: list[str], also: list[str] | None = None) -> DataFrame:
    """Team rows as home_* and as away_* columns of each game, matched on the team and the columns in ``also``."""
    also = also or []
    for side, team in (("home", home), ("away", away)):
        part = rows.select(F.col(key).alias(team), *also, *[F.col(c).alias(f"{side}_{c}") for c in cols])
        games = games.join(part, [team, *also], "left")
    return games


def best_of_two(df: DataFrame, lookup: DataFrame, first: tuple[str, str], second: tuple[str, str], value: str) -> DataFrame:
    """The larger value of two ways to match, each its own equi-join. (column of df, key of lookup) for both."""
    out = df
    for n, (col, key) in enumerate((first, second)):
        best = lookup.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__k{n}")).agg(F.max(value).alias(f"__v{n}"))
        out = out.join(best, F.col(col) == F.col(f"__k{n}"), "left").drop(f"__k{n}")
    return out.withColumn(f"best_{value}", F.greatest("__v0", "__v1")).drop("__v0", "__v1")


def resolve(names: DataFrame, roster: DataFrame, keys: list[str], name: str, who: str, loose: Column) -> DataFrame:
    """Names to ids: by the exact name, else by the loose one; a name of several ids is ambiguous and stays unresolved.

    ``loose`` is an expression on the column ``name``. Adds who and method (exact, normalized, ambiguous, unmatched).
    """
    exact = roster.groupBy(*keys, name).agg(F.min(who).alias("__e"), F.count_distinct(who).alias("__en"))
    norm = roster.withColumn("__loose", loose).groupBy(*keys, "__loose").agg(F.min(who).alias("__l"), F.count_distinct(who).alias("__ln"))
    out = names.join(exact, [*keys, name], "left").withColumn("__loose", loose).join(norm, [*keys, "__loose"], "left")
    method = F.when(F.col("__en") == 1, "exact").when(F.col("__en") > 1, "ambiguous").when(F.col("__ln") == 1, "normalized").when(F.col("__ln") > 1, "ambiguous").otherwise("unmatched")
    out = out.withColumn("method", method)
    found = F.when(F.col("method") == "exact", F.col("__e")).when(F.col("method") == "normalized", F.col("__l"))
    return out.withColumn(who, found).drop("__e", "__en", "__l", "__ln", "__loose")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails if a key repeats on either side or a left row finds no partner."""
    for name, side in (("left", left), ("right", right)):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{name} side: {keys} is no key")
    if not left.join(right, keys, "left_anti").isEmpty():
        raise ValueError("left rows without a partner")
    return left.join(right, keys)
