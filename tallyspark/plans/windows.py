"""Plays and ordered windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import is_success, margin_label, safe_div
from ..operators import aggregates as A
from ..operators import windows as X
from ..sources.tables import table
from .common import DRIVES, GAMES, PLAYS, TEAM_WEEKS, drives, games, plays, rounded, team_weeks, year


def play_side_agg(spark, d):
    """36 measures of offence and defence by team, season and week."""
    p = plays(spark, d).withColumn("success", is_success(F.col("down"), F.col("distance"), F.col("gained")))
    p = p.withColumnsRenamed({"team": "offense", "opponent": "defense"})
    return rounded(A.both_sides(p, drives(spark, d), ["season", "week"], 40.0))


_RUN, _PASS = "kind = 'run'", "kind = 'pass'"
_COUNTS = {
    "plays": "TRUE", "run_plays": _RUN, "pass_plays": _PASS, "successes": "ok", "run_successes": f"ok AND {_RUN}", "pass_successes": f"ok AND {_PASS}",
    "explosives": "gained >= 40", "run_explosives": f"gained >= 40 AND {_RUN}", "pass_explosives": f"gained >= 40 AND {_PASS}",
    "first_down_successes": "ok AND down = 1", "first_down_run_successes": f"ok AND down = 1 AND {_RUN}", "first_down_pass_successes": f"ok AND down = 1 AND {_PASS}",
}
_SHARES = {
    "run_rate": ("run_plays", "plays"), "pass_rate": ("pass_plays", "plays"), "first_down_pass_rate": ("fp", "f"), "value_per_play": ("value", "plays"), "run_value_per_play": ("run_value", "run_plays"),
    "pass_value_per_play": ("pass_value", "pass_plays"), "success_rate": ("successes", "plays"), "run_success_rate": ("run_successes", "run_plays"), "pass_success_rate": ("pass_successes", "pass_plays"),
    "explosive_rate": ("explosives", "plays"), "run_explosive_rate": ("run_explosives", "run_plays"), "pass_explosive_rate": ("pass_explosives", "pass_plays"), "first_down_success_rate": ("first_down_successes", "f"),
    "first_down_run_success_rate": ("first_down_run_successes", "fr"), "first_down_pass_success_rate": ("first_down_pass_successes", "fp"), "scoring_drive_share": ("scoring_drives", "drives"), "touchdown_drive_share": ("touchdown_drives", "drives"),
}


def _side_sql(side, team):
    counts = ", ".join(f"CAST(count_if({cond}) AS BIGINT) AS {n}" for n, cond in _COUNTS.items())
    plain = [*_COUNTS, "drives", "scoring_drives", "touchdown_drives"]
    values = ["value", "run_value", "pass_value", "third_down_distance"]
    out = [f"{n} AS {side}_{n}" for n in plain] + [f"round({n}, 6) AS {side}_{n}" for n in values] + [f"round({a} / nullif({b}, 0), 6) AS {side}_{n}" for n, (a, b) in _SHARES.items()]
    return f"""SELECT team, season, week, {", ".join(out)} FROM (SELECT a.*, coalesce(n, 0) AS drives, coalesce(s, 0) AS scoring_drives, coalesce(t, 0) AS touchdown_drives FROM (
 SELECT {team} AS team, season, week, {counts}, coalesce(sum(value), 0) AS value, coalesce(sum(value) FILTER (WHERE {_RUN}), 0) AS run_value, coalesce(sum(value) FILTER (WHERE {_PASS}), 0) AS pass_value,
 avg(distance) FILTER (WHERE down = 3) AS third_down_distance, count_if(down = 1) AS f, count_if(down = 1 AND {_RUN}) AS fr, count_if(down = 1 AND {_PASS}) AS fp FROM q GROUP BY ALL) a
 LEFT JOIN (SELECT {side} AS team, season, week, count(*) AS n, CAST(count_if(scored) AS BIGINT) AS s, CAST(count_if(touchdown) AS BIGINT) AS t FROM drives GROUP BY ALL) dr USING (team, season, week))"""


PLAY_SIDE_AGG = f"""WITH {PLAYS}, {DRIVES}, q AS (SELECT *, coalesce(distance > 0 AND gained >= CASE down WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 1.0 END * distance, FALSE) AS ok FROM plays)
SELECT * FROM ({_side_sql("offense", "team")}) FULL JOIN ({_side_sql("defense", "opponent")}) USING (team, season, week)"""

_W = ["team", "season"]


def _rolling(name):
    def query(spark, d):
        out = X.rolling_means(team_weeks(spark, d), _W, ["week"], ["points"])
        return rounded(out.select("team", "season", "week", F.col(name)))

    return query


_ROLL = "OVER (PARTITION BY team, season ORDER BY week ROWS BETWEEN {} AND CURRENT ROW)"
_ALL, _LAST = _ROLL.format("UNBOUNDED PRECEDING"), _ROLL.format("2 PRECEDING")


def roll_then_lag(spark, d):
    return rounded(X.prior_means(team_weeks(spark, d), _W, ["week"], ["points"]).drop("points"))


ROLL_THEN_LAG = f"""WITH {TEAM_WEEKS}, r AS (SELECT *, avg(points) {_ALL} AS a, CASE WHEN count(points) {_LAST} >= 3 THEN avg(points) {_LAST} END AS b FROM tw)
SELECT team, season, week, round(lag(points) OVER w, 6) AS prev_points, round(lag(a) OVER w, 6) AS points_avg_all, round(lag(b) OVER w, 6) AS points_avg3
FROM r WINDOW w AS (PARTITION BY team, season ORDER BY week)"""


def _records(spark, d):
    wins = (F.col("home_points") > F.col("away_points")).cast("int")
    return games(spark, d).groupBy("home", "season").agg(F.count(F.lit(1)).alias("games"), F.sum(wins).alias("wins"))


RECORDS = f"{GAMES}, rec AS (SELECT home, season, count(*) AS games, CAST(sum(CAST(home_points > away_points AS INTEGER)) AS BIGINT) AS wins FROM games GROUP BY ALL)"


def cumulative_record(spark, d):
    return rounded(X.cumulative_record(_records(spark, d), ["home"], ["season"], "games", "wins"))


CUMULATIVE_RECORD = f"""WITH {RECORDS}, c AS (SELECT *, CAST(sum(games) OVER w AS BIGINT) AS total_games, CAST(sum(wins) OVER w AS BIGINT) AS total_wins FROM rec
 WINDOW w AS (PARTITION BY home ORDER BY season ROWS UNBOUNDED PRECEDING))
SELECT home, season, games, wins, total_games, total_wins, total_games - games AS prior_games, total_wins - wins AS prior_wins, round(total_wins / nullif(total_games, 0), 6) AS total_pct,
 round((total_wins - wins) / nullif(total_games - games, 0), 6) AS prior_pct FROM c"""


def relabel_next_year(spark, d):
    return X.relabel_next(_records(spark, d), ["home"], "season")


RELABEL_NEXT_YEAR = f"WITH {RECORDS}, n AS (SELECT *, lead(season) OVER (PARTITION BY home ORDER BY season) AS later FROM rec) SELECT home, later AS season, games, wins FROM n WHERE later IS NOT NULL"


def _customer_years(spark, d):
    return table(spark, d, "orders").select("o_custkey", year("o_orderdate").alias("season"), "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderkey")


def coach_of_record(spark, d):
    """The priority with most orders in a nation's year; ties: the earliest first order, then its name."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = _customer_years(spark, d).join(c, "o_custkey").groupBy("c_nationkey", "season", "o_orderpriority").agg(F.count(F.lit(1)).alias("games"), F.min("o_orderdate").alias("since"))
    return X.first_by(n, ["c_nationkey", "season"], [F.col("games").desc(), F.col("since"), F.col("o_orderpriority")]).drop("since")


COACH_OF_RECORD = """WITH n AS (SELECT c_nationkey, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority, count(*) AS games, min(o_orderdate) AS since
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_nationkey, season, o_orderpriority, games FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey, season ORDER BY games DESC, since, o_orderpriority) = 1"""


def change_flag(spark, d):
    top = coach_of_record(spark, d)
    return top.select("c_nationkey", "season", X.change_flag(["c_nationkey"], "season", "o_orderpriority").alias("changed"))


CHANGE_FLAG = COACH_OF_RECORD.replace("SELECT c_nationkey, season, o_orderpriority, games FROM n", ", t AS (SELECT c_nationkey, season, o_orderpriority FROM n") + """)
SELECT c_nationkey, season, CAST(CASE WHEN lag(season) OVER w IS NOT NULL THEN CAST(o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER w AS INTEGER) END AS INTEGER) AS changed
FROM t WINDOW w AS (PARTITION BY c_nationkey ORDER BY season)"""


def rest_days_gaps(spark, d):
    gap = X.days_since_previous(["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("gap", gap)
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("gap") > 100).alias("byes"), F.count_if(F.col("gap") < 30).alias("short_rests"), F.max("gap").alias("longest"), F.sum(F.coalesce("gap", F.lit(7))).alias("rest_days"))


REST_DAYS_GAPS = """WITH g AS (SELECT o_custkey, date_sub('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders)
SELECT o_custkey, count(*) AS games, count(*) FILTER (WHERE gap > 100) AS byes, count(*) FILTER (WHERE gap < 30) AS short_rests, max(gap) AS longest, CAST(sum(coalesce(gap, 7)) AS BIGINT) AS rest_days FROM g GROUP BY 1"""


def back_to_back(spark, d):
    rows = games(spark, d).withColumn("road", F.col("home_points") < F.col("away_points"))
    rows = rows.withColumn("again", X.repeated_flag(["home", "season"], ["week", "game"], "road"))
    return rows.groupBy("home", "season").agg(F.sum("again").alias("back_to_back"), F.sum(F.col("road").cast("int")).alias("road_games"))


BACK_TO_BACK = f"""WITH {GAMES}, r AS (SELECT *, home_points < away_points AS road FROM games),
b AS (SELECT *, road AND coalesce(lag(road) OVER (PARTITION BY home, season ORDER BY week, game), FALSE) AS again FROM r)
SELECT home, season, CAST(count_if(again) AS BIGINT) AS back_to_back, CAST(count_if(road) AS BIGINT) AS road_games FROM b GROUP BY ALL"""


def _wins(spark, d):
    # some seasons are missing
    return _records(spark, d).where((F.col("home") + F.col("season")) % 4 != 0).withColumn("wins", F.col("wins").cast("double"))


_WINS = f"{RECORDS}, wn AS (SELECT home, season, CAST(wins AS DOUBLE) AS wins FROM rec WHERE (home + season) % 4 <> 0)"


def season_shift_lags(spark, d):
    return rounded(X.season_lags(_wins(spark, d).select("home", "season", "wins"), ["home"], "season", "wins"))


SEASON_SHIFT_LAGS = f"""WITH {_WINS} SELECT a.home, a.season, a.wins, b.wins AS wins_lag1, c.wins AS wins_lag2, e.wins AS wins_lag3,
 round(list_avg(list_filter([b.wins, c.wins, e.wins], lambda x: x IS NOT NULL)), 6) AS wins_lag_mean, b.wins - c.wins AS wins_step
FROM wn a LEFT JOIN wn b ON b.home = a.home AND b.season = a.season - 1 LEFT JOIN wn c ON c.home = a.home AND c.season = a.season - 2 LEFT JOIN wn e ON e.home = a.home AND e.season = a.season - 3"""


def season_windows_235(spark, d):
    rows = _wins(spark, d).withColumn("who", (F.col("games") % 3).cast("int"))
    return rounded(X.season_windows(rows, ["home"], "season", "wins", "who").drop("games", "who", "wins"))


def _season_windows_sql():
    cols = []
    for n in (2, 3, 5):
        w = f"OVER (PARTITION BY home ORDER BY season RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cols += [f"count(wins) {w} AS seasons_{n}", f"sum(wins) {w} AS wins_sum_{n}", f"round(avg(wins) {w}, 6) AS wins_mean_{n}",
                 f"round(CASE WHEN count(wins) {w} >= 2 THEN stddev_samp(wins) {w} END, 6) AS wins_std_{n}",
                 f"round(CASE WHEN count(wins) {w} > 0 THEN 1 - (len(list_distinct(list(who) {w})) - 1) / {n}.0 END, 6) AS stability_{n}"]
    return f"WITH {RECORDS}, wn AS (SELECT home, season, CAST(wins AS DOUBLE) AS wins, games % 3 AS who FROM rec WHERE (home + season) % 4 <> 0) SELECT home, season, {', '.join(cols)} FROM wn"


def season_shift_join(spark, d):
    r = _wins(spark, d)
    before = X.season_shift(r, "season", ["wins", "games"], 1, ["home"])
    return r.join(before, ["home", "season"], "left")


SEASON_SHIFT_JOIN = f"""WITH {RECORDS}, wn AS (SELECT home, season, games, CAST(wins AS DOUBLE) AS wins FROM rec WHERE (home + season) % 4 <> 0)
SELECT a.*, b.wins AS wins_lag1, b.games AS games_lag1 FROM wn a LEFT JOIN wn b ON a.home = b.home AND a.season = b.season + 1"""


def zscore_by_group(spark, d):
    c = table(spark, d, "customer")
    return rounded(c.select("c_custkey", X.zscore(["c_nationkey"], "c_acctbal").alias("z"), X.zscore(["c_mktsegment"], "c_acctbal", population=True).alias("z_pop")))


ZSCORE_BY_GROUP = """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER n) / nullif(stddev_samp(c_acctbal) OVER n, 0), 6) AS z,
 round((c_acctbal - avg(c_acctbal) OVER m) / nullif(stddev_pop(c_acctbal) OVER m, 0), 6) AS z_pop FROM customer WINDOW n AS (PARTITION BY c_nationkey), m AS (PARTITION BY c_mktsegment)"""


def group_shares(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.withColumn("share", X.share_of_total(["o_orderstatus"], "n")).withColumn("vs_first", X.ratio_to_first(["o_orderstatus"], ["o_orderpriority"], "n")).withColumn("rank", F.rank().over(X._spec(["o_orderstatus"], [F.col("n").desc()]))))


GROUP_SHARES = """WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share, round(n / first_value(n) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) - 1, 6) AS vs_first,
 CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY n DESC) AS INTEGER) AS rank FROM n"""


def latest_per_entity(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    one = X.first_by(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", F.col("o_orderkey").alias("latest"))
    ties = X.first_with_ties(o, ["o_custkey"], [F.col("o_orderdate").desc()]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_latest"))
    return one.join(ties, "o_custkey")


LATEST_PER_ENTITY = """WITH r AS (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS k FROM orders)
SELECT o_custkey, max(o_orderkey) AS latest, count(*) AS n_latest FROM r WHERE k = 1 GROUP BY 1"""


def dedupe_first(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_type", "p_partkey", "p_size")
    return X.first_by(p, ["p_brand", "p_type"], [F.col("p_size").desc(), F.col("p_partkey")])


DEDUPE_FIRST = "SELECT p_brand, p_type, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) = 1"


def prior_games_played(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", X.prior_count(["user_id"], ["ts", "event_id"]).cast("long").alias("games_before"))


PRIOR_GAMES_PLAYED = "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS games_before FROM events"


def margin_labels(spark, d):
    g = games(spark, d).withColumn("label", margin_label(F.col("home_points") - F.col("away_points") - 3))
    return rounded(g.groupBy("season", "label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("home_points") - F.col("away_points")).alias("margin")))


MARGIN_LABELS = f"""WITH {GAMES} SELECT season, CAST(CASE WHEN home_points - away_points - 3 > 0 THEN 1 WHEN home_points - away_points - 3 < 0 THEN 0 END AS INTEGER) AS label, count(*) AS n,
 round(avg(home_points - away_points), 6) AS margin FROM games GROUP BY ALL"""


def margin_by_week_share(spark, d):
    g = games(spark, d).groupBy("season", "week").agg(F.sum(F.col("home_points")).alias("pf"), F.sum("away_points").alias("pa"))
    return rounded(g.withColumn("ratio", safe_div(F.col("pf"), F.col("pa"))))


QUERIES = {
    "play_side_agg": play_side_agg, "rolling_avg_all": _rolling("points_avg_all"), "rolling3_rows": _rolling("points_avg3_rows"), "rolling3_nonnull": _rolling("points_avg3_full"),
    "rolling3_min1": _rolling("points_avg3_any"), "roll_then_lag": roll_then_lag, "cumulative_record": cumulative_record, "relabel_next_year": relabel_next_year,
    "coach_of_record": coach_of_record, "change_flag": change_flag, "rest_days_gaps": rest_days_gaps, "back_to_back": back_to_back, "season_shift_lags": season_shift_lags,
    "season_windows_235": season_windows_235, "season_shift_join": season_shift_join, "zscore_by_group": zscore_by_group, "group_shares": group_shares, "latest_per_entity": latest_per_entity,
    "dedupe_first": dedupe_first, "prior_games_played": prior_games_played, "margin_labels": margin_labels, "period_ratio": margin_by_week_share,
}
_TW = f"WITH {TEAM_WEEKS} SELECT team, season, week, "
ORACLES = {
    "play_side_agg": PLAY_SIDE_AGG, "rolling_avg_all": f"{_TW} round(avg(points) {_ALL}, 6) AS points_avg_all FROM tw",
    "rolling3_rows": f"{_TW} round(CASE WHEN count(*) {_LAST} >= 3 THEN avg(points) {_LAST} END, 6) AS points_avg3_rows FROM tw",
    "rolling3_nonnull": f"{_TW} round(CASE WHEN count(points) {_LAST} >= 3 THEN avg(points) {_LAST} END, 6) AS points_avg3_full FROM tw",
    "rolling3_min1": f"{_TW} round(avg(points) {_LAST}, 6) AS points_avg3_any FROM tw",
    "roll_then_lag": ROLL_THEN_LAG, "cumulative_record": CUMULATIVE_RECORD, "relabel_next_year": RELABEL_NEXT_YEAR, "coach_of_record": COACH_OF_RECORD, "change_flag": CHANGE_FLAG,
    "rest_days_gaps": REST_DAYS_GAPS, "back_to_back": BACK_TO_BACK, "season_shift_lags": SEASON_SHIFT_LAGS, "season_windows_235": _season_windows_sql(), "season_shift_join": SEASON_SHIFT_JOIN,
    "zscore_by_group": ZSCORE_BY_GROUP, "group_shares": GROUP_SHARES, "latest_per_entity": LATEST_PER_ENTITY, "dedupe_first": DEDUPE_FIRST, "prior_games_played": PRIOR_GAMES_PLAYED,
    "margin_labels": MARGIN_LABELS,
    "period_ratio": f"WITH {GAMES} SELECT season, week, CAST(sum(home_points) AS BIGINT) AS pf, CAST(sum(away_points) AS BIGINT) AS pa, round(sum(home_points) / nullif(sum(away_points), 0), 6) AS ratio FROM games GROUP BY ALL",
}
