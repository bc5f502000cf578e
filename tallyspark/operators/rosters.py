"""Set logic on members, entities and periods: turnover, tenure, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import safe_div


def turnover(roster: DataFrame, member: str, team: str, season: str) -> DataFrame:
    """For each team and season: members who stayed, left, came new and came from another team, against the season before."""
    now = roster.select(member, season, F.col(team).alias("now")).distinct()
    before = now.select(member, (F.col(season) + 1).alias(season), F.col("now").alias("before"))
    # a season counts only where both it and the one before have rows
    seasons = now.select(season).distinct().join(before.select(season).distinct(), season)
    both = now.join(before, [member, season], "full").join(F.broadcast(seasons), season, "left_semi")
    stayed = F.col("now") == F.col("before")
    into = both.where("now is not null").groupBy(F.col("now").alias(team), season).agg(
        F.count_if(stayed).alias("stayed"), F.count_if(F.col("before").isNull()).alias("new"), F.count_if(~stayed).alias("moved_in"), F.count(F.lit(1)).alias("size")
    )
    out = both.where("before is not null").groupBy(F.col("before").alias(team), season).agg(F.count_if(F.col("now").isNull()).alias("gone"), F.count_if(~stayed).alias("moved_out"))
    counts = ["stayed", "new", "moved_in", "size", "gone", "moved_out"]
    return into.join(out, [team, season], "full").fillna(0, counts).withColumn("kept_share", safe_div(F.col("stayed"), F.col("stayed") + F.col("gone") + F.col("moved_out")))


def rated_turnover(roster: DataFrame, ratings: DataFrame, member: str, team: str, season: str, key_role: tuple[str, str]) -> DataFrame:
    """Turnover of every team and season against the season before: sizes, counts, the net rating of transfers, and whether a key role left.

    A member counts once in a season. ratings: (member, rating); those without one add nothing. key_role: (column, value).
    Seasons without one before them are left out.
    """
    role, wanted = key_role
    now = roster.groupBy(member, season).agg(F.min(F.struct(team, role)).alias("x")).select(member, season, F.col(f"x.{team}").alias("now"), F.col(f"x.{role}").alias("role"))
    before = now.select(member, (F.col(season) + 1).alias(season), F.col("now").alias("before"), F.col("role").alias("before_role"))
    seasons = now.select(season).distinct().join(before.select(season).distinct(), season)
    both = now.join(before, [member, season], "full").join(F.broadcast(seasons), season, "left_semi").join(ratings.select(member, "rating"), member, "left")
    stayed, moved = F.coalesce(F.col("now") == F.col("before"), F.lit(False)), F.col("now").isNotNull() & F.col("before").isNotNull() & (F.col("now") != F.col("before"))
    count = lambda x, n: F.count_if(x).alias(n)
    rated = lambda n: F.coalesce(F.sum(F.when(moved, F.col("rating"))), F.lit(0.0)).alias(n)
    left = both.where("before is not null").groupBy(F.col("before").alias(team), season).agg(
        F.count(F.lit(1)).alias("size_before"), count(stayed, "stayed"), count(~stayed, "departed"), count(moved, "transferred_out"), count(~stayed & (F.col("before_role") == wanted), "__key"), rated("__out")
    )
    came = both.where("now is not null").groupBy(F.col("now").alias(team), season).agg(F.count(F.lit(1)).alias("size_now"), count(~stayed, "incoming"), count(moved, "transferred_in"), rated("__in"))
    out = left.join(came, [team, season], "full").fillna(0)
    out = out.withColumns({"key_departed": F.col("__key") > 0, "net_transfer_rating": F.col("__in") - F.col("__out")}).drop("__key", "__in", "__out")
    return out.withColumns({"stayed_share": safe_div(F.col("stayed"), F.col("size_before")), "turnover_share": safe_div(F.col("departed"), F.col("size_before"))})


def arrivals_and_departures(roster: DataFrame, ratings: DataFrame, member: str, team: str, season: str) -> DataFrame:
    """Without a list of moves: members who were on no team the season before, members on no team now, and the net of their ratings."""
    rows = roster.select(member, team, season).distinct().join(ratings.select(member, "rating"), member, "left")
    there = rows.select(member, season).distinct()
    seasons = there.select(season).distinct()
    new = rows.join(there.select(member, (F.col(season) + 1).alias(season)), [member, season], "left_anti")
    into = new.groupBy(team, season).agg(F.count(F.lit(1)).alias("arrivals"), F.sum("rating").alias("__in"))
    next_year = rows.withColumn(season, F.col(season) + 1).join(F.broadcast(seasons), season, "left_semi")
    gone = next_year.join(there, [member, season], "left_anti").groupBy(team, season).agg(F.count(F.lit(1)).alias("departures"), F.sum("rating").alias("__out"))
    out = into.join(gone, [team, season], "full").fillna(0)
    return out.withColumn("net_rating", F.col("__in") - F.col("__out")).drop("__in", "__out")


def tenure(roster: DataFrame, member: str, season: str, seasons: tuple[int, int] | None = None, lookback: int | None = None) -> DataFrame:
    """(member, season, tenure): seasons before this one in which the member appears.

    With ``seasons`` (first, last) and ``lookback`` rows are read from ``lookback`` seasons before the first on, and those of the seasons asked
    for are returned: the bound is one for all, not one for each row.
    """
    rows = roster.select(member, season).distinct()
    if seasons:
        rows = rows.where(F.col(season).between(seasons[0] - (lookback or 0), seasons[1]))
    w = W.partitionBy(member).orderBy(season).rangeBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("tenure", F.count(F.lit(1)).over(w))
    return out.where(F.col(season).between(*seasons)) if seasons else out


def leader_tenure(leaders: DataFrame, team: str, season: str, who: str, floor: int) -> DataFrame:
    """Each team's leader of a season: whether it is another than in the season before, since when it leads the team, and for how long.

    changed is false where the season before is unknown; censored says that the start is the first season there is.
    """
    before = leaders.select(team, (F.col(season) + 1).alias(season), F.col(who).alias("__before"))
    out = leaders.join(before, [team, season], "left")
    w = W.partitionBy(team, who).orderBy(season).rangeBetween(W.unboundedPreceding, W.currentRow)
    out = out.withColumn("since", F.min(season).over(w)).withColumn("changed", F.col("__before").isNotNull() & (F.col(who) != F.col("__before")))
    return out.withColumns({"years": F.col(season) - F.col("since"), "censored": F.col("since") <= floor, "first_year": F.col(season) == F.col("since")}).drop("__before")


def flow_totals(moves: DataFrame, origin: str, target: str, rating: str, name: str = "place") -> DataFrame:
    """In and out counts and quality of every place, their difference and sum."""
    into = moves.groupBy(F.col(target).alias(name)).agg(F.count(F.lit(1)).alias("n_in"), F.avg(rating).alias("avg_in"))
    out = moves.groupBy(F.col(origin).alias(name)).agg(F.count(F.lit(1)).alias("n_out"), F.avg(rating).alias("avg_out"))
    both = into.join(out, name, "full").fillna(0, ["n_in", "n_out"])
    return both.withColumns({"net": F.col("n_in") - F.col("n_out"), "activity": F.col("n_in") + F.col("n_out"), "quality_delta": F.col("avg_in") - F.col("avg_out")})


def pair_flows(moves: DataFrame, origin: str, target: str) -> DataFrame:
    """For each unordered pair of places: moves, net flow, and who gains."""
    a, b = F.least(origin, target), F.greatest(origin, target)
    toward = F.when(F.col(target) == b, 1).otherwise(-1)
    pairs = moves.where(F.col(origin) != F.col(target)).groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("moves"), F.sum(toward).alias("net_to_b"))
    gains = F.when(F.col("net_to_b") > 0, F.col("b")).when(F.col("net_to_b") < 0, F.col("a"))
    return pairs.withColumn("importer", gains).withColumn("exporter", F.when(gains == F.col("a"), F.col("b")).when(gains == F.col("b"), F.col("a")))
