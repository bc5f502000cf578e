"""Feature tables made of the smaller operators: history, live rows, sweeps, composites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from .joins import attach_sides
from .metrics import at_least
from .quantiles import exact_quantiles
from .ratings import rate_sweep
from .windows import first_by, interval, prior_means, rolling_means


def weighted_score(weights: dict[str, float]) -> Column:
    """The weighted sum of columns; null counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()])


def signed_line(size: Column, favourite: Column) -> Column:
    """The line from the home side's view: negative where it is the favourite."""
    return F.when(favourite == 0, F.abs(size)).otherwise(-F.abs(size))


def interactions(pairs: list[tuple[str, str]]) -> dict[str, Column]:
    """Products, margins and complements of column pairs by name."""
    out = {}
    for a, b in pairs:
        out |= {f"{a}_x_{b}": F.col(a) * F.col(b), f"{a}_less_{b}": F.col(a) - F.col(b), f"{a}_share_{b}": 1 - safe_div(F.col(b), F.col(a))}
    return out


def historical_rows(weeks: DataFrame, games: DataFrame, team: str, season: str, week: str, cols: list[str], home: str, away: str) -> DataFrame:
    """Each game with both sides' values from before its week: lag, mean so far, trailing mean."""
    prior = prior_means(weeks, [team, season], [week], cols)
    names = [n for c in cols for n in (f"prev_{c}", f"{c}_avg_all", f"{c}_avg3")]
    return attach_sides(games, prior.select(team, season, week, *names), team, home, away, names, [season, week])


def live_rows(weeks: DataFrame, games: DataFrame, team: str, season: str, week: str, cols: list[str], home: str, away: str) -> DataFrame:
    """Coming games with both sides' latest values, their last game included."""
    rolled = rolling_means(weeks, [team, season], [week], cols)
    last = first_by(rolled, [team, season], [F.col(week).desc()])
    out = {n: v for c in cols for n, v in ((f"prev_{c}", F.col(c)), (f"{c}_avg_all", F.col(f"{c}_avg_all")), (f"{c}_avg3", F.col(f"{c}_avg3_full")))}
    return attach_sides(games, last.select(team, season, *[v.alias(n) for n, v in out.items()]), team, home, away, list(out), [season])


def sensitivity(df: DataFrame, member: str, gates: dict[str, tuple[str, list[float]]]) -> DataFrame:
    """Rows and members that pass each threshold of each gate: (gate, threshold, rows, members).

    A row falls once into the interval between two thresholds of each gate; a member passes a threshold with its largest value, so members
    are counted by the interval of that. Members without a name are not counted.
    """
    parts = []
    for name, (c, ts) in gates.items():
        edges = [float(t) for t in sorted(set(ts))]
        reached = F.coalesce(interval(F.col(c), edges), F.lit(0))
        own = df.groupBy(member, reached.alias("__reached")).agg(F.count(F.lit(1)).alias("rows"))
        highest = own.where(F.col(member).isNotNull()).groupBy(member).agg(F.max("__reached").alias("__reached")).groupBy("__reached").agg(F.count(F.lit(1)).alias("members"))
        rows = own.groupBy("__reached").agg(F.sum("rows").alias("rows")).withColumn("members", F.lit(0).cast("long"))
        cells = rows.unionByName(highest.withColumn("rows", F.lit(0).cast("long"))).withColumn("gate", F.lit(name))
        parts.append(at_least(cells, ["gate"], edges, ["rows", "members"]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def trajectory(rows: DataFrame, season: str, week: str, weeks: list[int], passes: int) -> DataFrame:
    """(season, as_of, team, rating): for every season, ratings from the games before each of the weeks."""
    return rate_sweep(rows, season, week, weeks, [0], passes).drop("k")


def swept_ratings(rows: DataFrame, priors: DataFrame, season: str, week: str, weeks: list[int], ks: list[int], passes: int) -> DataFrame:
    """(season, as_of, k, team, rating): for every week and every weight k of the prior, ratings from the games before that week.

    A team's prior is k games against an opponent of rating 0; teams without a prior get the mean one.
    """
    mean = priors.agg(F.avg("rating").alias("__mean"))
    known = priors.groupBy("team").agg(F.first("rating").alias("__prior"))
    asked = rows.join(known, "team", "left").crossJoin(F.broadcast(mean))
    return rate_sweep(asked.withColumn("prior", F.coalesce("__prior", "__mean", F.lit(0.0))), season, week, weeks, ks, passes)


def phase_means(weekly: DataFrame, by: list[str], week: str, metrics: list[str], split: int = 4) -> DataFrame:
    """Means of weekly metrics over all weeks, over those up to ``split`` and over those after it; null where there is none."""
    early = F.col(week) <= split
    return weekly.groupBy(*by).agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_all"), F.avg(F.when(early, F.col(m))).alias(f"{m}_early"), F.avg(F.when(~early, F.col(m))).alias(f"{m}_late"))])


def agreement(df: DataFrame, key: list[str], model: str, p: str, thresholds: dict[str, float]) -> DataFrame:
    """Rows that all models flag, each at its own threshold, with their mean probability."""
    own = reduce(lambda a, m: a.when(F.col(model) == m, F.lit(thresholds[m])), thresholds, F.when(F.lit(False), F.lit(0.0)))
    out = df.where(F.col(model).isin(list(thresholds))).groupBy(*key).agg(F.count_if(F.col(p) >= own).alias("flags"), F.avg(p).alias("mean_probability"))
    return out.withColumn("agreed", F.col("flags") == len(thresholds))


def residual_spread(df: DataFrame, residual: str, by: list[str]) -> DataFrame:
    """Population deviation of residuals and their interquartile range over 1.349; 0 becomes 1."""
    one = lambda c: F.when(c > 0, c).otherwise(1.0)
    quartiles = exact_quantiles(df, by, residual, [0.25, 0.75], "__q").select(*by, one((F.col("__q")[1] - F.col("__q")[0]) / 1.349).alias("robust_std"))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), one(F.stddev_pop(residual)).alias("std"))
    return out.join(quartiles, by, "left").fillna(1.0, ["robust_std"])


def quality_weighted(df: DataFrame, by: list[str], scored: str, allowed: str, z: str, alpha: float) -> DataFrame:
    """Points weighted by the opponent's quality: scored times w, allowed divided by it, w = 1 + alpha z."""
    w = 1 + alpha * F.coalesce(F.col(z), F.lit(0.0))
    return df.groupBy(*by).agg(F.sum(F.col(scored) * w).alias("scored"), F.sum(F.col(allowed) / w).alias("allowed"))


def importance_by_category(df: DataFrame, category: str, importance: str) -> DataFrame:
    """Sum, rank and share of the total of non-negative importances."""
    sums = df.groupBy(category).agg(F.sum(F.greatest(F.col(importance), F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("features"))
    whole = sums.agg(F.sum("total").alias("__all"))
    out = sums.join(F.broadcast(whole)).withColumn("share", safe_div(F.col("total"), F.col("__all"))).drop("__all")
    return out.withColumn("rank", F.rank().over(W.orderBy(F.col("total").desc())))
