"""Grouped measures. Conditional measures are aggregates with a filter, in one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import avg_if, flag, safe_div, sum_if
from .quantiles import exact_quantiles
from .windows import sliced


def play_side_measures(plays: DataFrame, drives: DataFrame, keys: list[str], explosive_at: float) -> DataFrame:
    """36 measures of one side's plays and drives, each table read and shuffled once.

    plays, a row for each: kind (run, pass, other), down, distance, gained, value, success. drives, a row for each: scored, touchdown. Sums of
    nothing are 0, rates of nothing null; a side without drives has 0 of them.
    """
    c, known = F.col, lambda x: F.coalesce(x, F.lit(False))
    run, passing, first, ok, big = (known(x) for x in (c("kind") == "run", c("kind") == "pass", c("down") == 1, c("success"), c("gained") >= explosive_at))
    everything = F.lit(True)
    kinds = {"": everything, "run_": run, "pass_": passing}
    counts = {f"{k}plays": F.count_if(x) for k, x in kinds.items()} | {f"__first_{k}plays": F.count_if(first & x) for k, x in kinds.items()}
    counts |= {f"{k}value": sum_if(x, c("value")) for k, x in kinds.items()} | {f"{k}successes": F.count_if(ok & x) for k, x in kinds.items()}
    counts |= {f"{k}explosives": F.count_if(big & x) for k, x in kinds.items()} | {f"first_down_{k}successes": F.count_if(first & ok & x) for k, x in kinds.items()}
    counts["third_down_distance"] = avg_if(c("down") == 3, c("distance"))
    own = drives.groupBy(*keys).agg(F.count(F.lit(1)).alias("drives"), F.count_if(known(c("scored"))).alias("scoring_drives"), F.count_if(known(c("touchdown"))).alias("touchdown_drives"))
    out = plays.groupBy(*keys).agg(*[x.alias(n) for n, x in counts.items()]).join(own, keys, "left").fillna(0, ["drives", "scoring_drives", "touchdown_drives"])
    rates = {"run_rate": ("run_plays", "plays"), "pass_rate": ("pass_plays", "plays"), "first_down_pass_rate": ("__first_pass_plays", "__first_plays")}
    for k in kinds:
        rates |= {f"{k}value_per_play": (f"{k}value", f"{k}plays"), f"{k}success_rate": (f"{k}successes", f"{k}plays"), f"{k}explosive_rate": (f"{k}explosives", f"{k}plays")}
        rates[f"first_down_{k}success_rate"] = (f"first_down_{k}successes", f"__first_{k}plays")
    rates |= {f"{k}_drive_share": (f"{k}_drives", "drives") for k in ("scoring", "touchdown")}
    return out.withColumns({n: safe_div(c(a), c(b)) for n, (a, b) in rates.items()}).drop(*[n for n in counts if n.startswith("__")])


def both_sides(plays: DataFrame, drives: DataFrame, at: list[str], explosive_at: float, sides: tuple[str, str] = ("offense", "defense")) -> DataFrame:
    """(team, ...at) with the measures of both sides: plays and drives name the team on each in a column of the side's name."""
    parts = []
    for side in sides:
        own = play_side_measures(*[df.where(F.col(side).isNotNull()).withColumn("team", F.col(side)) for df in (plays, drives)], ["team", *at], explosive_at)
        parts.append(own.select("team", *at, *[F.col(n).alias(f"{side}_{n}") for n in own.columns if n not in ("team", *at)]))
    return parts[0].join(parts[1], ["team", *at], "full")


def allowed_by_game(plays: DataFrame, keys: list[str], explosive_at: float) -> DataFrame:
    """What a defence allowed on the plays of each game: rates of success and of stops, explosive plays, value per play."""
    big = F.count_if(F.col("gained") >= explosive_at)
    return plays.groupBy(*keys).agg(
        F.avg(F.col("success").cast("int")).alias("success_rate_allowed"), big.alias("explosives_allowed"), F.avg("value").alias("value_per_play_allowed"),
        F.avg(F.col("stuffed").cast("int")).alias("stuffed_rate_forced"), safe_div(big, F.count("gained")).alias("explosive_rate_allowed"),
    )


def schedule_summary(rows: DataFrame, keys: list[str], early: int, late: int, bye_days: int = 10, short_days: int = 6) -> DataFrame:
    """21 features of a team's schedule, in one pass over its games in order.

    rows: game, date, week, is_home, is_road, neutral, conference, power, sub, prior_pct, prior_talent, prior_returning, own_talent.
    Part-season and by-conference features are null for teams without such games.
    """
    w = W.partitionBy(*keys).orderBy("date", "game")
    gap = F.timestamp_diff("DAY", F.lag("date").over(w), F.col("date"))
    rows = rows.withColumns({"__gap": gap, "__road_again": F.col("is_road") & F.coalesce(F.lag("is_road").over(w), F.lit(False))})
    c, n = F.col, lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    part = lambda where: F.sum(F.when(where, flag(c("power"))))
    out = rows.groupBy(*keys).agg(
        F.count("game").alias("games"), n(c("is_home")).alias("home"), n(c("is_road")).alias("road"), n(c("neutral")).alias("neutral"), n(c("conference")).alias("conference"), n(c("power")).alias("power"),
        n(~c("power") & ~c("sub")).alias("middle"), n(c("sub")).alias("sub"), F.avg("prior_pct").alias("avg_prior_pct"), F.avg("prior_talent").alias("avg_prior_talent"), F.max("prior_talent").alias("max_prior_talent"),
        F.avg("prior_returning").alias("avg_prior_returning"), n(c("prior_talent") > c("own_talent")).alias("above_own_talent"), part(c("week") <= early).alias("power_early"), part(c("week") >= late).alias("power_late"),
        avg_if(c("conference"), c("prior_talent")).alias("talent_conference"), avg_if(~c("conference"), c("prior_talent")).alias("talent_nonconference"),
        n(c("__gap") > bye_days).alias("byes"), n(c("__gap") < short_days).alias("short_rests"), n(c("__road_again")).alias("road_again"),
    )
    return out.withColumn("nonconference", c("games") - c("conference"))


def gini(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(n, gini, cv) by group over values that are neither null nor negative; null where they sum to 0. For groups of any size.

    Equal values are counted before they are ranked; ranks are summed up by slices of the values, then within each.
    """
    counts = sliced(df.where(F.col(x) >= 0).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("m")), x)
    below = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = [F.struct(F.col(c).alias("v")).alias(c) for c in keys]
    counts = counts.select(*names, F.col(x).alias("x"), "m", "__slice")
    slices = counts.groupBy(*keys, "__slice").agg(F.sum("m").alias("m"))
    slices = slices.select(*keys, "__slice", below(W.partitionBy(*keys).orderBy("__slice")).alias("__below"))
    before = F.col("__below") + below(W.partitionBy(*keys, "__slice").orderBy("x"))
    ranks = (F.col("m") * (2 * before + F.col("m") + 1) / 2).alias("ranks")  # the sum of the ranks of the m equal values
    counts = counts.join(slices, [*keys, "__slice"]).select(*keys, "x", "m", ranks)
    out = counts.groupBy(*keys).agg(
        F.sum("m").alias("n"), F.sum(F.col("x") * F.col("m")).alias("__total"), F.sum(F.col("x") * F.col("ranks")).alias("__ranked"), F.sum(F.col("x") * F.col("x") * F.col("m")).alias("__squares")
    )
    n, total = F.col("n"), F.col("__total")
    variance = safe_div(F.greatest(F.col("__squares") - total * total / n, F.lit(0.0)), n - 1)
    out = out.withColumn("gini", safe_div(2 * F.col("__ranked"), n * total) - F.when(total > 0, (n + 1) / n))
    return out.withColumn("cv", safe_div(F.sqrt(variance), total / n)).select(*[F.col(f"{c}.v").alias(c) for c in keys], "n", "gini", "cv")


def preferred_or_average(df: DataFrame, keys: list[str], preferred: Column, x: str, name: str) -> DataFrame:
    """The value of the preferred row if a group has one (its null stays null), else the mean of all."""
    return df.groupBy(*keys).agg(F.when(F.count_if(preferred) > 0, F.max(F.when(preferred, F.col(x)))).otherwise(F.avg(x)).alias(name))


def star_ratio(df: DataFrame, keys: list[str], member: str, stars: str, rating: str, at_least: int = 4, min_matched: int = 20) -> DataFrame:
    """High-star members against all members, and against those with a match where there are enough of them."""
    out = df.groupBy(*keys).agg(
        F.count_distinct(member).alias("members"), F.count_if(F.col(stars) >= at_least).alias("high"), F.count(stars).alias("matched"), F.coalesce(F.avg(rating), F.lit(0.0)).alias("avg_rating")
    )
    ratio = F.coalesce(safe_div(F.col("high"), F.col("members")), F.lit(0.0))
    return out.withColumn("ratio", ratio).withColumn("matched_ratio", F.when(F.col("matched") >= min_matched, safe_div(F.col("high"), F.col("matched"))))


def quantile_edges(df: DataFrame, x: str, n: int) -> DataFrame:
    """One row: the distinct interior edges of n quantile buckets."""
    inner = [k / n for k in range(1, n)]
    return exact_quantiles(df, [], x, inner, "edges").select(F.array_distinct("edges").alias("edges"))


def quantile_buckets(df: DataFrame, x: str, n: int, name: str = "bucket") -> DataFrame:
    """Adds the bucket of x by value edges, closed on the right, equal edges merged. Null stays null."""
    edges = quantile_edges(df, x, n)
    bucket = F.when(F.col(x).isNotNull(), F.size(F.filter("edges", lambda e: e < F.col(x))))
    return df.join(F.broadcast(edges)).withColumn(name, bucket).drop("edges")


def calibration(df: DataFrame, by: str, predicted: str, actual: str) -> DataFrame:
    gap = F.avg(predicted) - F.avg(actual)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(actual).alias("mean_actual"), gap.alias("gap"))


def width_bucket(x: str, width: float) -> Column:
    """The lower edge of x's bucket; null below 0."""
    return F.when(F.col(x) >= 0, F.floor(F.col(x) / width) * width)


def null_rates(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null_rate") for c in cols])
