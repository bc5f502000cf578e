"""Validation of tables: each check is a query; ``require`` makes a finding an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import safe_div


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def coverage(expected: DataFrame, facts: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Expected slots, those with a fact, and their share."""
    there = facts.select(*keys).distinct().withColumn("__there", F.lit(1))
    both = expected.join(there, keys, "left")
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("slots"), F.count("__there").alias("matched"))
    return out.withColumn("rate", safe_div(F.col("matched"), F.col("slots")))


def short_periods(df: DataFrame, period: str, share: float = 0.6, without_itself: bool = False) -> DataFrame:
    """Rows of each period, the median of all (or of all others), and whether the period is shorter than its share of it. Periods are few."""
    counts = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"))
    each = counts.agg(F.collect_list(F.struct(F.col(period).alias("p"), "n")).alias("__all"))
    others = F.filter("__all", lambda x: x["p"] != F.col(period)) if without_itself else F.col("__all")
    out = counts.join(F.broadcast(each)).withColumn("__n", F.array_sort(F.transform(others, lambda x: x["n"].cast("double"))))
    middle = F.expr("(get(__n, cast((size(__n) - 1) / 2 as int)) + get(__n, cast(size(__n) / 2 as int))) / 2")
    return out.withColumn("median_n", F.when(F.size("__n") > 0, middle)).drop("__all", "__n").withColumn("is_short", F.col("n") < share * F.col("median_n"))


def incomplete(df: DataFrame, by: list[str], col: str, most: float = 0.1) -> DataFrame:
    rate = F.avg(F.col(col).isNull().cast("int"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rate.alias("null_rate")).withColumn("too_many", F.col("null_rate") > most)


def out_of_bounds(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(column, n): values that are infinite, not a number, or out of bounds."""
    bad: dict[str, Column] = {}
    for c, (low, high) in bounds.items():
        x = F.col(c).cast("double")
        cond = F.isnan(x) | (F.abs(x) == float("inf"))
        cond = cond | (x < low) if low is not None else cond
        bad[c] = cond | (x > high) if high is not None else cond
    one = df.agg(*[F.count_if(cond).alias(c) for c, cond in bad.items()])
    return one.unpivot([], list(bad), "column", "n")


def far_values(df: DataFrame, cols: list[str], most: float = 6.0) -> DataFrame:
    """(column, n, max_z): values further from the mean than ``most`` standard deviations, and the largest distance."""
    stats = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}"))])
    z = {c: F.abs(safe_div(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}"))) for c in cols}
    one = df.join(F.broadcast(stats)).agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(x > most).alias("n"), F.max(x).alias("max_z")) for c, x in z.items()]).alias("a"))
    return one.select(F.explode("a").alias("x")).select("x.*")


def wrong_values(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """(column, n): rows whose value is none of those allowed; null is none of them."""
    one = df.agg(*[F.count_if(~F.coalesce(F.col(c).isin(values), F.lit(False))).alias(c) for c, values in allowed.items()])
    return one.unpivot([], list(allowed), "column", "n")


def wrong_columns(df: DataFrame, numeric: list[str], denied: tuple[str, ...] = ()) -> list[str]:
    """Columns that should be numbers and are not there or are none, and columns that must not be there."""
    kinds = dict(df.dtypes)
    number = lambda k: k.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c in numeric if not number(kinds.get(c, ""))] + [c for c in denied if c in kinds]


def leaked_periods(df: DataFrame, period: str, x: str) -> DataFrame:
    """(period, x, n, leaked): counts of every pair; leaked where x repeats the period, as when a season was loaded into a class year."""
    return df.where(F.col(x).isNotNull()).groupBy(period, x).agg(F.count(F.lit(1)).alias("n")).withColumn("leaked", F.col(period) == F.col(x))


def weighted_match_rate(df: DataFrame, by: list[str], method: str, weight: str, most_unmatched: float = 0.1) -> DataFrame:
    """Shares of the weight that are matched and unmatched, and whether too much is unmatched."""
    of = lambda cond: safe_div(F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0.0)), F.sum(weight))
    out = df.groupBy(*by).agg(of(F.col(method).isin("exact", "normalized")).alias("matched_rate"), of(F.col(method) == "unmatched").alias("unmatched_rate"))
    return out.withColumn("status", F.when(F.col("unmatched_rate") > most_unmatched, "WARN").otherwise("PASS"))


def frame_diff(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str], tolerance: float) -> DataFrame:
    """For each column: pairs compared (both values known), pairs with one unknown, largest and mean difference, pairs that differ by
    more than the tolerance; and the rows whose key only one side has."""
    own = a.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in cols]).alias("__a"))
    other = b.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in cols]).alias("__b"))
    both = own.join(other, keys, "full")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__a.{c}").alias("x"), F.col(f"__b.{c}").alias("y")) for c in cols])
    long = both.select(F.col("__a").isNull().alias("__no_a"), F.col("__b").isNull().alias("__no_b"), F.explode(cells).alias("__c")).select("__no_a", "__no_b", "__c.*")
    gap = F.abs(F.col("x") - F.col("y"))
    one_known = ~F.col("__no_a") & ~F.col("__no_b") & (F.col("x").isNull() != F.col("y").isNull())
    return long.groupBy("column").agg(
        F.count(gap).alias("n_compared"), F.count_if(one_known).alias("n_one_known"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.count_if(gap > tolerance).alias("n_over"),
        F.count_if("__no_b").alias("only_left"), F.count_if("__no_a").alias("only_right"),
    )


def require(found: DataFrame, what: str) -> None:
    if rows := found.limit(5).collect():
        raise ValueError(f"{what}: {rows}")


def same_count(before: DataFrame, after: DataFrame, what: str) -> None:
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"{what}: {a} rows became {b}")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def fan_out(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """What a left join on the keys would do, one row, without the join's rows: n_left, n_right, left rows without a partner, with one and with
    several, the most partners of a row, and the rows of the result. A null key has no partner. Both sides are counted by key first."""
    own = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__l"))
    other = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    n, m = F.coalesce(F.col("__l"), F.lit(0)), F.coalesce(F.col("__r"), F.lit(0))
    return own.join(other, keys, "full").agg(
        total(n).alias("n_left"), total(m).alias("n_right"), total(F.when(m == 0, n)).alias("without"), total(F.when(m == 1, n)).alias("with_one"), total(F.when(m > 1, n)).alias("with_several"),
        F.coalesce(F.max(F.when(n > 0, m)), F.lit(0)).cast("long").alias("widest"), total(n * F.greatest(m, F.lit(1))).alias("n_joined"),
    )
