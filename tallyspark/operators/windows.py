"""Ordered windows by entity. Frames are ROWS unless seasons are counted; a feature at t never sees rows at or after t."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import safe_div

_ALL = W.unboundedPreceding


def _spec(keys: list[str], order: list):
    return W.partitionBy(*keys).orderBy(*order)


def rolling_means(df: DataFrame, keys: list[str], order: list, cols: list[str], span: int = 3) -> DataFrame:
    """For each column: mean so far; trailing mean once the frame has span rows, span values, or any value. All share one sort."""
    w = _spec(keys, order)
    so_far, last = w.rowsBetween(_ALL, 0), w.rowsBetween(1 - span, 0)
    out = {}
    for c in cols:
        mean = F.avg(c).over(last)
        out[f"{c}_avg_all"] = F.avg(c).over(so_far)
        out[f"{c}_avg{span}_rows"] = F.when(F.count(F.lit(1)).over(last) >= span, mean)
        out[f"{c}_avg{span}_full"] = F.when(F.count(c).over(last) >= span, mean)
        out[f"{c}_avg{span}_any"] = mean
    return df.withColumns(out)


def prior_means(df: DataFrame, keys: list[str], order: list, cols: list[str], span: int = 3) -> DataFrame:
    """The value before, the mean of all before, and the trailing mean before the row once span values are there."""
    w = _spec(keys, order)
    before, last = w.rowsBetween(_ALL, -1), w.rowsBetween(-span, -1)
    out = {}
    for c in cols:
        out[f"prev_{c}"] = F.lag(c).over(w)
        out[f"{c}_avg_all"] = F.avg(c).over(before)
        out[f"{c}_avg{span}"] = F.when(F.count(c).over(last) >= span, F.avg(c).over(last))
    return df.withColumns(out)


def prior_count(keys: list[str], order: list) -> Column:
    return F.row_number().over(_spec(keys, order)) - 1


def cumulative_record(df: DataFrame, keys: list[str], order: list, games: str, wins: str) -> DataFrame:
    """Totals and rate including the row, and those of the rows before it."""
    w = _spec(keys, order)
    now, before = w.rowsBetween(_ALL, 0), w.rowsBetween(_ALL, -1)
    out = {"total_games": F.sum(games).over(now), "total_wins": F.sum(wins).over(now), "prior_games": F.coalesce(F.sum(games).over(before), F.lit(0)), "prior_wins": F.coalesce(F.sum(wins).over(before), F.lit(0))}
    out_rates = {"total_pct": safe_div(F.col("total_wins"), F.col("total_games")), "prior_pct": safe_div(F.col("prior_wins"), F.col("prior_games"))}
    return df.withColumns(out).withColumns(out_rates)


def relabel_next(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Each row under the label of the entity's next row; the last row goes."""
    later = F.lead(label).over(_spec(keys, [label]))
    return df.withColumn("__next", later).where("__next is not null").withColumn(label, F.col("__next")).drop("__next")


def change_flag(keys: list[str], order: str, value: str) -> Column:
    """1 where the value differs from the row before, 0 where not, null on the first row."""
    w = _spec(keys, [order])
    return F.when(F.lag(order).over(w).isNotNull(), (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))


def days_since_previous(keys: list[str], order: list, ts: str) -> Column:
    """Whole days of elapsed time since the row before."""
    before = F.lag(ts).over(_spec(keys, order))
    return F.timestamp_diff("DAY", before, F.col(ts))


def repeated_flag(keys: list[str], order: list, value: str) -> Column:
    """1 where a boolean holds on the row and on the one before."""
    w = _spec(keys, order)
    return (F.col(value) & F.coalesce(F.lag(value).over(w), F.lit(False))).cast("int")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in a total order."""
    return df.withColumn("__n", F.row_number().over(_spec(keys, order))).where("__n = 1").drop("__n")


def first_with_ties(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.rank().over(_spec(keys, order))).where("__n = 1").drop("__n")


def zscore(keys: list[str], x: str, population: bool = False) -> Column:
    w = W.partitionBy(*keys)
    spread = F.stddev_pop(x) if population else F.stddev_samp(x)
    return safe_div(F.col(x) - F.avg(x).over(w), spread.over(w))


def share_of_total(keys: list[str], x: str) -> Column:
    return safe_div(F.col(x), F.sum(x).over(W.partitionBy(*keys)))


def ratio_to_first(keys: list[str], order: list, x: str) -> Column:
    first = F.first(x).over(_spec(keys, order).rowsBetween(_ALL, 0))
    return safe_div(F.col(x), first) - 1


def interval(x: Column, edges: list) -> Column:
    """How many of the edges, in order, are at most x: by halving, so the expression is as deep as a logarithm of their number. Null for null."""

    def cut(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= F.lit(edges[mid]), cut(mid + 1, hi)).otherwise(cut(lo, mid))

    return F.when(x.isNotNull(), cut(0, len(edges)))


def slice_edges(df: DataFrame, x: str, n: int = 128) -> list:
    """At most n - 1 values that cut the rows into parts of about one size; one aggregate, whose result is that many numbers."""
    points = [k / n for k in range(1, n)]
    return sorted(set(df.agg(F.percentile_approx(x, points, F.lit(10_000)).alias("edges")).first()["edges"] or []))


def sliced(df: DataFrame, x: str, n: int = 128, edges: list | None = None) -> DataFrame:
    """Adds __slice: which of n ranges of x a row lies in. The edges are approximate quantiles of the whole table, so crowded values are spread over
    slices, and they are fixed before anything else is planned: all that is derived from the slices agrees on them. Null values are of slice 0."""
    return df.withColumn("__slice", F.coalesce(interval(F.col(x), slice_edges(df, x, n) if edges is None else edges), F.lit(0)))


def lag_by_slices(df: DataFrame, keys: list[str], order: str, x: str, name: str) -> DataFrame:
    """x of the row before in a group of any size, for a unique order: groups are cut into slices of the order, and the first row of a slice
    takes the last value of the slice before."""
    rows, w = sliced(df, order), W.partitionBy(*keys, "__slice").orderBy(order)
    ends = rows.groupBy(*keys, "__slice").agg(F.max_by(F.struct(F.col(x).alias("v")), order).alias("__end"))
    before = F.lag("__end").over(W.partitionBy(*keys).orderBy("__slice"))
    ends = ends.withColumn("__before", before).drop("__end")
    rows = rows.withColumns({"__first": F.row_number().over(w) == 1, name: F.lag(x).over(w)}).join(ends, [*keys, "__slice"], "left")
    return rows.withColumn(name, F.when(F.col("__first"), F.col("__before.v")).otherwise(F.col(name))).drop("__slice", "__first", "__before")


def windows_by_slices(df: DataFrame, keys: list[str], order: str, cols: list[str], span: int = 3, n: int = 128) -> DataFrame:
    """``prior_means`` for entities of any size and a unique order within each: prev_<c>, <c>_avg_all and <c>_avg<span> from the rows before.

    An entity's rows are cut into slices of the order, so its history is spread over many tasks. A slice gets from those before it the sums and
    counts (a table of one row for each entity and slice) and the entity's last ``span`` rows as rows that lead it.
    """
    rows = sliced(df, order, n)
    at = F.row_number().over(W.partitionBy(*keys, "__slice").orderBy(F.col(order).asc_nulls_first()))
    rows = rows.withColumn("__at", at)
    sums = [x for c in cols for x in (F.sum(c).alias(f"__sum_{c}"), F.count(c).alias(f"__n_{c}"))]
    ends = rows.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__rows"), *sums)
    w = W.partitionBy(*keys).orderBy("__slice").rowsBetween(_ALL, -1)
    before = {f"__before_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("__rows", *[f"__{k}_{c}" for c in cols for k in ("sum", "n")])}
    ends = ends.withColumns(before)
    names = [F.struct(F.col(k).alias("v")).alias(f"__k{i}") for i, k in enumerate(keys)]  # null keys join too
    on = [f"__k{i}" for i in range(len(keys))]
    ends, rows = ends.select(*names, "__slice", "__rows", *before), rows.select("*", *names)
    # the last rows of a slice lead later slices as long as they are among the last ``span`` before those
    tails = rows.join(ends.select(*on, "__slice", "__rows", F.col("__before___rows").alias("__first")), [*on, "__slice"])
    tails = tails.where(F.col("__at") > F.col("__rows") - span).withColumn("__place", F.col("__first") + F.col("__at"))
    later = ends.select(*on, F.col("__slice").alias("__to"), F.col("__before___rows").alias("__have"))
    lead = tails.join(later, on).where((F.col("__to") > F.col("__slice")) & (F.col("__place") > F.col("__have") - span))
    lead = lead.select(*df.columns, *on, F.col("__to").alias("__slice"), (F.col("__place") - F.col("__have")).cast("int").alias("__at"))
    both = rows.select(*df.columns, *on, "__slice", "__at").unionByName(lead).join(ends.drop("__rows"), [*on, "__slice"])
    w = W.partitionBy(*on, "__slice").orderBy("__at")
    inside, last, out = w.rowsBetween(_ALL, -1), w.rowsBetween(-span, -1), {}
    own = lambda c: F.when(F.col("__at") > 0, F.col(c))
    for c in cols:
        out[f"prev_{c}"] = F.lag(c).over(w)
        total, count = F.col(f"__before___sum_{c}") + F.coalesce(F.sum(own(c)).over(inside), F.lit(0)), F.col(f"__before___n_{c}") + F.count(own(c)).over(inside)
        out[f"{c}_avg_all"] = safe_div(total, count)
        out[f"{c}_avg{span}"] = F.when(F.count(c).over(last) >= span, F.avg(c).over(last))
    return both.withColumns(out).where("__at > 0").select(*df.columns, *out)


def average_ranks(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """Adds the rank of x within its group, ties sharing the mean of their ranks, for groups of any size.

    Equal values are counted first; the counts are summed up by slices of x, then within each.
    """
    counts = sliced(df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__m")), x)
    below = lambda w: F.coalesce(F.sum("__m").over(w.rowsBetween(_ALL, -1)), F.lit(0))
    slices = counts.groupBy(*keys, "__slice").agg(F.sum("__m").alias("__m"))
    slices = slices.select(*keys, "__slice", below(W.partitionBy(*keys).orderBy("__slice")).alias("__below"))
    rank = F.col("__below") + below(W.partitionBy(*keys, "__slice").orderBy(x)) + (F.col("__m") + 1) / 2
    ranks = counts.join(slices, [*keys, "__slice"]).select(*keys, x, rank.alias(name))
    return df.join(ranks, [*keys, x])


def season_shift(df: DataFrame, season: str, cols: list[str], by: int, keys: list[str]) -> DataFrame:
    """The columns as those of ``by`` seasons before, under suffix _lag<by>: join on keys and season."""
    return df.select(*keys, (F.col(season) + by).alias(season), *[F.col(c).alias(f"{c}_lag{by}") for c in cols])


def season_lags(df: DataFrame, keys: list[str], season: str, x: str, lags: int = 3) -> DataFrame:
    """x of the 1..lags seasons before, by calendar, and the mean of those that exist; null where a season is missing."""
    by = W.partitionBy(*keys).orderBy(season)
    out = {f"{x}_lag{k}": F.max(x).over(by.rangeBetween(-k, -k)) for k in range(1, lags + 1)}
    names = list(out)
    known = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    return df.withColumns(out).withColumn(f"{x}_lag_mean", safe_div(total, known)).withColumn(f"{x}_step", F.col(names[0]) - F.col(names[1]))


def season_windows(df: DataFrame, keys: list[str], season: str, x: str, who: str | None = None, spans: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """Over the last n seasons before the row, by calendar: seasons present, sum, mean, sample deviation, stability of ``who``."""
    by, out = W.partitionBy(*keys).orderBy(season), {}
    for n in spans:
        w = by.rangeBetween(-n, -1)
        out[f"seasons_{n}"] = F.count(x).over(w)
        out[f"{x}_sum_{n}"] = F.sum(x).over(w)
        out[f"{x}_mean_{n}"] = F.avg(x).over(w)
        out[f"{x}_std_{n}"] = F.when(F.count(x).over(w) >= 2, F.stddev_samp(x).over(w))
        if who:
            different = F.size(F.collect_set(who).over(w))
            out[f"stability_{n}"] = F.when(different > 0, 1 - (different - 1) / F.lit(float(n)))
    return df.withColumns(out)
