"""Opponent-adjusted ratings: a fixed number of simultaneous passes of r = mean(margin + opponent's r), centred each time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normal_cdf, safe_div
from .joins import stack_sides
from .windows import interval


def home_advantage(games: DataFrame, margin: str) -> DataFrame:
    """One row: the mean home margin, 0 without games."""
    return games.agg(F.coalesce(F.avg(margin), F.lit(0.0)).alias("home_advantage"))


def team_margins(games: DataFrame, period: str, home: str, away: str, margin: str, neutral: str | None = None) -> DataFrame:
    """(period, team, opponent, margin): two rows for each game, the home advantage taken out where the site is not neutral."""
    games = games.join(F.broadcast(home_advantage(games.where(~F.col(neutral)) if neutral else games, margin)))
    edge = F.when(F.col(neutral), 0.0).otherwise(F.col("home_advantage")) if neutral else F.col("home_advantage")
    games = games.withColumn("__m", F.col(margin) - edge).withColumn("__n", -F.col("__m"))
    rows = stack_sides(games, [period], {"team": home, "opponent": away, "margin": "__m"}, {"team": away, "opponent": home, "margin": "__n"})
    return rows.select(period, "team", "opponent", "margin")


def rate(rows: DataFrame, period: str, passes: int = 200) -> DataFrame:
    """(period, team, rating) of every period, all its teams in one task: meant for leagues of up to some thousand teams.

    rows: (period, team, opponent, margin) and optionally weight; an opponent without rows of its own has rating 0.
    Rows are summed for each pair of teams first, so a task gets pairs, not games.
    """
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    pairs = rows.groupBy(period, "team", "opponent").agg(F.sum(weight * F.col("margin")).alias("total"), F.sum(weight).alias("weight"))
    kind = rows.schema[period].dataType.simpleString()

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["team", "opponent"])
        teams = np.unique(pdf["team"])
        team = np.searchsorted(teams, pdf["team"])
        place = pd.Index(teams).get_indexer(pdf["opponent"])
        rated = place >= 0
        games = np.bincount(team, pdf["weight"], len(teams))
        base = np.bincount(team, pdf["total"], len(teams))
        r = np.zeros(len(teams))
        for _ in range(passes):
            r = (base + np.bincount(team, pdf["weight"] * np.where(rated, r[place], 0.0), len(teams))) / games
            r -= r.mean()
        return pd.DataFrame({period: key[0], "team": teams, "rating": r})

    team_kind = rows.schema["team"].dataType.simpleString()
    return pairs.groupBy(period).applyInPandas(solve, f"{period} {kind}, team {team_kind}, rating double")


def rate_sweep(rows: DataFrame, period: str, week: str, weeks: list[int], ks: list[int], passes: int = 200) -> DataFrame:
    """(period, as_of, k, team, rating): ratings from the games before each of the weeks, with each weight k of the teams' priors.

    rows: (period, week, team, opponent, margin) and, where a k is above 0, prior. Games are shuffled once: summed for each pair of teams
    between two weeks, they are added up week by week in a period's task, and one pass moves the ratings of all k together. A team has a
    rating once it has a game.
    """
    edges = sorted(set(weeks))
    prior = F.first("prior") if "prior" in rows.columns else F.lit(0.0)
    cells = rows.withColumn("__cell", interval(F.col(week), edges)).where(F.col("__cell") < len(edges))
    pairs = cells.groupBy(period, "__cell", "team", "opponent").agg(F.sum("margin").alias("total"), F.count("margin").alias("games"), prior.alias("prior"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (period, "team")}

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["team", "opponent"])
        every, k = np.unique(pdf["team"]), np.array(ks, float)
        prior = pdf.groupby("team")["prior"].first().reindex(every).to_numpy(float)
        team, place = np.searchsorted(every, pdf["team"]), pd.Index(every).get_indexer(pdf["opponent"])
        cell, n, total = pdf["__cell"].to_numpy(), pdf["games"].to_numpy(float), pdf["total"].to_numpy(float)
        parts = []
        for at, as_of in enumerate(edges):
            own = cell <= at
            games, base = (np.bincount(team[own], x[own], len(every)) for x in (n, total))
            there = games > 0
            met = own & (place >= 0)
            met[met] = there[place[met]]
            r, t = np.zeros((len(every), len(k))), team[met]
            first = np.flatnonzero(np.diff(t, prepend=-1))
            for _ in range(passes if there.any() else 0):
                pull = np.zeros_like(r)
                if len(t):
                    pull[t[first]] = np.add.reduceat(n[met, None] * r[place[met]], first)
                r[there] = (base[there, None] + k * prior[there, None] + pull[there]) / (games[there, None] + k)
                r[there] -= r[there].mean(0)
            parts += [pd.DataFrame({period: key[0], "as_of": as_of, "k": int(x), "team": every[there], "rating": r[there, j]}) for j, x in enumerate(ks)]
        return pd.concat(parts)

    return pairs.groupBy(period).applyInPandas(solve, f"{period} {kinds[period]}, as_of int, k int, team {kinds['team']}, rating double")


def rate_by_joins(rows: DataFrame, period: str, passes: int, cut_every: int = 8) -> DataFrame:
    """The same for any number of teams, by joins and grouped means.

    The lineage is cut after every few passes in ``spark.checkpoint.dir``, so a pass costs the same however many went before. Without that
    setting more passes than that are refused.
    """
    if passes > cut_every and not rows.sparkSession.conf.get("spark.checkpoint.dir", None):
        raise ValueError(f"more than {cut_every} passes need spark.checkpoint.dir, where their lineage is cut")
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    pairs = rows.groupBy(period, "team", "opponent").agg(F.sum(weight * F.col("margin")).alias("total"), F.sum(weight).alias("games"))
    now = pairs.select(period, "team").distinct().withColumn("rating", F.lit(0.0))
    shared = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    for n in range(1, passes + 1):
        seen = pairs.join(now.select(period, F.col("team").alias("opponent"), F.col("rating").alias("r")), [period, "opponent"], "left")
        raw = seen.groupBy(period, "team").agg((F.sum(F.col("total") + F.col("games") * F.coalesce("r", F.lit(0.0))) / F.sum("games")).alias("raw"))
        mean = raw.groupBy(period).agg(F.avg("raw").alias("mean"))
        now = raw.join(mean, period).select(period, "team", (F.col("raw") - F.col("mean")).alias("rating"))
        if shared and n % cut_every == 0 and n < passes:
            now = now.checkpoint()
    return now


def with_fixed(rows: DataFrame, fixed: DataFrame) -> DataFrame:
    """Rows against opponents of a fixed rating (opponent, rating): the rating becomes part of the margin, the opponent null."""
    own = fixed.select("opponent", F.col("rating").alias("__fixed"))
    out = rows.join(own, "opponent", "left").withColumn("margin", F.col("margin") + F.coalesce("__fixed", F.lit(0.0)))
    return out.withColumn("opponent", F.when(F.col("__fixed").isNull(), F.col("opponent"))).select(*rows.columns)


def with_pool(rows: DataFrame, rated: DataFrame, period: str) -> DataFrame:
    """The rows of rated teams; all other opponents are one pool whose rating in a period is the mean of the margins against it, with its sign changed."""
    known = rated.select(F.col("team").alias("opponent"), F.lit(True).alias("__rated"))
    out = rows.join(rated.select("team"), "team", "left_semi").join(known, "opponent", "left").withColumn("__pool", F.col("__rated").isNull())
    pool = out.where("__pool").groupBy(period).agg((-F.avg("margin")).alias("__rating"))
    out = out.join(pool, period, "left").withColumn("margin", F.when(F.col("__pool"), F.col("margin") + F.col("__rating")).otherwise(F.col("margin")))
    return out.withColumn("opponent", F.when(~F.col("__pool"), F.col("opponent"))).select(*rows.columns)


def with_phantoms(rows: DataFrame, priors: DataFrame, period: str, k: int) -> DataFrame:
    """Adds a row of weight k for each team: its prior as a margin against an opponent of rating 0. No prior: the mean one."""
    teams = rows.select(period, "team").distinct()
    mean = priors.agg(F.avg("rating").alias("mean_prior"))
    phantom = teams.join(priors.select("team", "rating"), "team", "left").join(F.broadcast(mean))
    margin = F.coalesce("rating", "mean_prior", F.lit(0.0)).alias("margin")
    none = F.lit(None).cast(rows.schema["opponent"].dataType).alias("opponent")
    return rows.withColumn("weight", F.lit(1.0)).unionByName(phantom.select(period, "team", none, margin, F.lit(float(k)).alias("weight")))


def prior_weight(games: str, k: int):
    return F.lit(float(k)) / (F.lit(float(k)) + F.col(games))


def project_games(games: DataFrame, ratings: DataFrame, home: str, away: str, edge: float, spread: float, also: list[str] | None = None) -> DataFrame:
    """Expected home margin, favourite and the home side's probability to win; ratings are those of the team and of the columns in ``also``."""
    also = also or []
    for side, team in (("home", home), ("away", away)):
        games = games.join(ratings.select(F.col("team").alias(team), *also, F.col("rating").alias(f"{side}_rating")), [team, *also], "left")
    games = games.withColumn("expected_margin", F.col("home_rating") - F.col("away_rating") + edge)
    favourite = F.when(F.col("expected_margin") >= 0, F.col(home)).otherwise(F.col(away))
    return games.withColumn("favourite", favourite).withColumn("home_probability", normal_cdf(F.col("expected_margin") / spread))


def _refine(low: float, high: float, steps: int, rounds: int, errors) -> tuple[float, float] | None:
    """(best, error) of a number between low and high, by rounds of ever finer grids; errors: grid -> an error (or null) for each number."""
    best = None
    for _ in range(rounds):
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        pairs = [(e, x) for e, x in zip(errors(grid), grid, strict=True) if e is not None]
        if not pairs:
            return None
        error, x = min(pairs)
        best, gap = (x, error), (high - low) / steps
        low, high = max(low, x - gap), min(high, x + gap)
    return best


def fit_quality_weight(games: DataFrame, keys: list[str], scored: str, allowed: str, z: str, actual: DataFrame, low: float = -0.3, high: float = 0.3, steps: int = 12, rounds: int = 3) -> DataFrame:
    """One row (alpha, mse): how much the opponent's quality should weigh in points so that the scoring ratio comes nearest to ``actual`` (keys, y).

    A round is one grouped pass with a pair of sums for each number of the grid; only errors come to the driver.
    """

    def errors(grid: list[float]) -> list:
        weight = [1 + F.lit(a) * F.coalesce(F.col(z), F.lit(0.0)) for a in grid]
        sums = [F.sum(F.col(scored) * w).alias(f"s{i}") for i, w in enumerate(weight)] + [F.sum(F.col(allowed) / w).alias(f"a{i}") for i, w in enumerate(weight)]
        both = games.groupBy(*keys).agg(*sums).join(actual, keys)
        ratio = [safe_div(F.col(f"s{i}") ** 2, F.col(f"s{i}") ** 2 + F.col(f"a{i}") ** 2) for i in range(len(grid))]
        return list(both.agg(*[F.avg((F.col("y") - r) ** 2) for r in ratio]).first())

    best = _refine(low, high, steps, rounds, errors)
    return games.sparkSession.createDataFrame([best] if best else [], "alpha double, mse double")


def fit_exponent(rows: DataFrame, scored: str, allowed: str, actual: str, low: float = 0.5, high: float = 6.0, steps: int = 20, rounds: int = 3) -> DataFrame:
    """One row (k, mse): the exponent of the scoring ratio with the least mean squared error, by refining a grid.

    A round is one pass over the rows with ``steps + 1`` sums in it; only those come to the driver.
    """
    ratio = safe_div(F.col(allowed), F.col(scored))
    base = rows.select(ratio.alias("q"), F.col(actual).alias("y")).where("q is not null and y is not null")

    def errors(grid: list[float]) -> list:
        return list(base.agg(*[F.avg(F.pow(F.col("y") - 1 / (1 + F.pow("q", F.lit(k))), 2)).alias(f"e{i}") for i, k in enumerate(grid)]).first())

    best = _refine(low, high, steps, rounds, errors)
    return rows.sparkSession.createDataFrame([best] if best else [], "k double, mse double")
