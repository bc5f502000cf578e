"""Feature tables, sweeps and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from ..operators import features as X
from ..operators import metrics as M
from ..operators.quantiles import column_quantiles
from ..operators.ratings import team_margins
from ..operators.windows import zscore
from ..sources.tables import table
from .common import GAMES, PREDICTIONS, TEAM_WEEKS, games, plays, predictions, rounded, team_weeks, year
from .evaluation import _MARGINS, _srs_sql


def _fixtures(spark, d):
    """Each game of the order table's nations, as a game between two suppliers in one month."""
    g = games(spark, d).select("game", "season", "week", (F.col("home") * 3).cast("long").alias("home"), (F.col("away") * 3 + 1).cast("long").alias("away"))
    return g


_FIX = f"{GAMES}, fx AS (SELECT game, season, week, CAST(home * 3 AS BIGINT) AS home, CAST(away * 3 + 1 AS BIGINT) AS away FROM games)"


def historical_rows(spark, d):
    return rounded(X.historical_rows(team_weeks(spark, d), _fixtures(spark, d), "team", "season", "week", ["points"], "home", "away"))


_PRIOR = """pm AS (SELECT team, season, week, lag(points) OVER w AS prev_points, avg(points) OVER (PARTITION BY team, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS points_avg_all,
 CASE WHEN count(points) OVER l >= 3 THEN avg(points) OVER l END AS points_avg3 FROM tw WINDOW w AS (PARTITION BY team, season ORDER BY week), l AS (PARTITION BY team, season ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""
_SIDES = ", ".join(f"round({s}.{c}, 6) AS {n}_{c}" for s, n in (("h", "home"), ("a", "away")) for c in ("prev_points", "points_avg_all", "points_avg3"))
HISTORICAL_ROWS = f"""WITH {TEAM_WEEKS}, {_FIX}, {_PRIOR} SELECT fx.*, {_SIDES} FROM fx LEFT JOIN pm h ON h.team = home AND h.season = fx.season AND h.week = fx.week LEFT JOIN pm a ON a.team = away AND a.season = fx.season AND a.week = fx.week"""


def live_rows(spark, d):
    return rounded(X.live_rows(team_weeks(spark, d), _fixtures(spark, d).where("week = 12"), "team", "season", "week", ["points"], "home", "away"))


LIVE_ROWS = f"""WITH {TEAM_WEEKS}, {_FIX}, r AS (SELECT team, season, points AS prev_points, avg(points) OVER (PARTITION BY team, season) AS points_avg_all, CASE WHEN count(points) OVER l >= 3 THEN avg(points) OVER l END AS points_avg3,
 row_number() OVER (PARTITION BY team, season ORDER BY week DESC) AS k FROM tw WINDOW l AS (PARTITION BY team, season ORDER BY week ROWS 2 PRECEDING)), pm AS (SELECT * FROM r WHERE k = 1)
SELECT fx.*, {_SIDES} FROM fx LEFT JOIN pm h ON h.team = home AND h.season = fx.season LEFT JOIN pm a ON a.team = away AND a.season = fx.season WHERE fx.week = 12"""


def composite_scores(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).cast("double").alias("points"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 300).cast("double")).alias("yards"), (F.col("o_orderkey") % 3).cast("double").alias("touchdowns"))
    o = o.withColumn("score", X.weighted_score({"points": 1.0, "yards": 1 / 17, "touchdowns": 6.0})).withColumn("line", X.signed_line(F.col("points") / 2, F.col("o_orderkey") % 2))
    return rounded(o.withColumns(X.interactions([("points", "touchdowns")])))


COMPOSITE_SCORES = """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 40 AS DOUBLE) AS points, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 300 AS DOUBLE) END AS yards, CAST(o_orderkey % 3 AS DOUBLE) AS touchdowns FROM orders)
SELECT *, round(points + coalesce(yards, 0) / 17 + touchdowns * 6, 6) AS score, round(CASE WHEN o_orderkey % 2 = 0 THEN points / 2 ELSE -points / 2 END, 6) AS line, points * touchdowns AS points_x_touchdowns, points - touchdowns AS points_less_touchdowns,
 round(1 - touchdowns / nullif(points, 0), 6) AS points_share_touchdowns FROM o"""


def sensitivity_sweep(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    return X.sensitivity(e, "user_id", {"total": ("total", [20, 80, 200]), "n": ("n", [1, 3, 5])})


SENSITIVITY_SWEEP = """WITH e AS (SELECT user_id, day(ts) AS d, sum(value) AS total, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT 'total' AS gate, CAST(unnest([20, 80, 200]) AS DOUBLE) AS threshold UNION ALL SELECT 'n', CAST(unnest([1, 3, 5]) AS DOUBLE))
SELECT gate, threshold, count(*) FILTER (WHERE CASE gate WHEN 'total' THEN total ELSE n END >= threshold) AS rows, count(DISTINCT user_id) FILTER (WHERE CASE gate WHEN 'total' THEN total ELSE n END >= threshold) AS members FROM e, t GROUP BY ALL"""


def weekly_trajectory(spark, d):
    g = games(spark, d).withColumn("margin", (F.col("home_points") - F.col("away_points")).cast("double")).withColumn("at", F.struct("season", "week"))
    rows = team_margins(g, "at", "home", "away", "margin", "neutral").select("at.*", "team", "opponent", "margin")
    return rounded(X.trajectory(rows, "season", "week", [4, 8, 12], 3))


def _trajectory_sql():
    margins = _MARGINS.replace("mg AS (SELECT season,", "m0 AS (SELECT season, week,").replace("UNION ALL SELECT season,", "UNION ALL SELECT season, week,")
    rated = _srs_sql(3, "mw").replace("round(rating, 6) AS rating", "rating")
    return f"""SELECT CAST(season // 1000 AS INTEGER) AS season, CAST(season % 1000 AS INTEGER) AS as_of, team, round(rating, 6) AS rating FROM (WITH {margins},
 mw AS (SELECT season * 1000 + as_of AS season, team, opponent, margin FROM m0, (SELECT unnest([4, 8, 12]) AS as_of) WHERE week < as_of), {rated})"""


def model_agreement(spark, d):
    p = predictions(spark, d)
    a = p.select("event_id", F.lit("a").alias("model"), F.col("score").alias("p")).unionByName(p.select("event_id", F.lit("b").alias("model"), (F.col("predicted") / 40).alias("p")))
    return rounded(X.agreement(a, ["event_id"], "model", "p", {"a": 0.5, "b": 0.6}))


MODEL_AGREEMENT = f"WITH {PREDICTIONS} SELECT event_id, CAST(CAST(score >= 0.5 AS INTEGER) + CAST(predicted / 40 >= 0.6 AS INTEGER) AS BIGINT) AS flags, round((score + predicted / 40) / 2, 6) AS mean_probability, score >= 0.5 AND predicted / 40 >= 0.6 AS agreed FROM pr"


def residual_spread(spark, d):
    return rounded(X.residual_spread(predictions(spark, d).withColumn("r", F.col("actual") - F.col("predicted")), "r", ["event_type"]))


RESIDUAL_SPREAD = f"WITH {PREDICTIONS} SELECT event_type, count(*) AS n, round(stddev_pop(actual - predicted), 6) AS std, round((quantile_cont(actual - predicted, 0.75) - quantile_cont(actual - predicted, 0.25)) / 1.349, 6) AS robust_std FROM pr GROUP BY 1"


def quality_weighted(spark, d):
    nations = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("away")).agg(F.avg("c_acctbal").alias("talent")).withColumn("one", F.lit(1))
    z = nations.withColumn("z", zscore(["one"], "talent")).select("away", "z")
    return rounded(X.quality_weighted(games(spark, d).join(F.broadcast(z), "away", "left"), ["home", "season"], "home_points", "away_points", "z", 0.05), 4)


QUALITY_WEIGHTED = f"""WITH {GAMES}, t AS (SELECT c_nationkey AS away, avg(c_acctbal) AS talent FROM customer GROUP BY 1), z AS (SELECT away, (talent - avg(talent) OVER ()) / stddev_samp(talent) OVER () AS z FROM t)
SELECT home, season, round(sum(home_points * (1 + 0.05 * coalesce(z, 0))), 4) AS scored, round(sum(away_points / (1 + 0.05 * coalesce(z, 0))), 4) AS allowed FROM games LEFT JOIN z USING (away) GROUP BY ALL"""


_PIVOTED = tuple(range(1995, 2002))


def season_pivot(spark, d):
    """Orders by priority, a column for each season that the orders have."""
    n = table(spark, d, "orders").select("o_orderpriority", year("o_orderdate").alias("season"), "o_totalprice")
    wide = n.groupBy("o_orderpriority").pivot("season", list(_PIVOTED)).agg(F.count("o_totalprice"))
    return wide.withColumnsRenamed({str(y): f"orders_{y}" for y in _PIVOTED})


SEASON_PIVOT = "SELECT o_orderpriority, " + ", ".join(f"nullif(count(*) FILTER (WHERE year(o_orderdate) = {y}), 0) AS orders_{y}" for y in _PIVOTED) + " FROM orders GROUP BY 1"


def two_level_rate(spark, d):
    """Share of a supplier's orders in which any of its lines was returned: the maximum for each order, then the mean."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("hit"))
    return rounded(li.groupBy("l_suppkey").agg(F.avg("hit").alias("rate"), F.count(F.lit(1)).alias("drives")))


TWO_LEVEL_RATE = "WITH o AS (SELECT l_suppkey, l_orderkey, max(CAST(l_returnflag = 'R' AS INTEGER)) AS hit FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(avg(hit), 6) AS rate, count(*) AS drives FROM o GROUP BY 1"


def class_means(spark, d):
    """The mean of the means of the last four classes that each season sees, over a grid of seasons."""
    p = table(spark, d, "part").select((1990 + F.col("p_size") % 10).cast("int").alias("class"), "p_brand", "p_retailprice")
    by = p.groupBy("p_brand", "class").agg(F.avg("p_retailprice").alias("m"))
    grid = by.select("p_brand", "m", F.explode(F.sequence(F.col("class"), F.col("class") + 3)).alias("season"))
    return rounded(grid.groupBy("p_brand", "season").agg(F.avg("m").alias("rank_mean"), F.count(F.lit(1)).alias("classes")))


CLASS_MEANS = """WITH b AS (SELECT p_brand, CAST(1990 + p_size % 10 AS INTEGER) AS class, avg(p_retailprice) AS m FROM part GROUP BY ALL), s AS (SELECT CAST(unnest(range(1990, 2003)) AS INTEGER) AS season)
SELECT p_brand, season, round(avg(m), 6) AS rank_mean, count(*) AS classes FROM b JOIN s ON class BETWEEN season - 3 AND season GROUP BY ALL"""


def describe_columns(spark, d):
    cols = ["l_quantity", "l_discount", "l_tax"]
    li = table(spark, d, "lineitem").select(*cols)
    one = li.unpivot([], cols, "column", "value")
    out = one.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg(F.col("value").isNull().cast("int")).alias("missing"))
    return rounded(out.join(column_quantiles(li, [], cols, [0.5]).select("column", F.col("quantiles")[0].alias("median")), "column", "left"))


DESCRIBE_COLUMNS = """SELECT "column", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, median(value) AS median, max(value) AS max, 0.0 AS missing
FROM (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME "column" VALUE value) GROUP BY 1"""


def holdout_by_week(spark, d):
    return rounded(M.classification(predictions(spark, d).where("season = 4"), ["event_type"], "label", "score", 0.4).select("event_type", "flagged", "precision", "coverage", "accuracy"))


HOLDOUT_BY_WEEK = f"""WITH {PREDICTIONS}, s AS (SELECT * FROM pr WHERE season = 4) SELECT event_type, count(*) FILTER (WHERE score >= 0.4) AS flagged, round(count(*) FILTER (WHERE score >= 0.4 AND label = 1) / nullif(count(*) FILTER (WHERE score >= 0.4), 0), 6) AS precision,
 round(count(*) FILTER (WHERE score >= 0.4) / count(*), 6) AS coverage, round(avg(CAST((score >= 0.4) = (label = 1) AS INTEGER)), 6) AS accuracy FROM s GROUP BY 1"""


def generalization_gap(spark, d):
    """Error on the first seasons and on the last, and their difference, signed so that positive is worse."""
    p = predictions(spark, d).withColumn("part", F.when(F.col("season") < 3, "train").otherwise("holdout"))
    e = F.abs(F.col("predicted") - F.col("actual"))
    wide = p.groupBy("event_type").agg(F.avg(F.when(F.col("part") == "train", e)).alias("train_mae"), F.avg(F.when(F.col("part") == "holdout", e)).alias("holdout_mae"))
    return rounded(wide.withColumn("gap", F.col("holdout_mae") - F.col("train_mae")).withColumn("gap_share", safe_div(F.col("gap"), F.col("train_mae"))))


GENERALIZATION_GAP = f"""WITH {PREDICTIONS}, g AS (SELECT event_type, avg(abs(predicted - actual)) FILTER (WHERE season < 3) AS t, avg(abs(predicted - actual)) FILTER (WHERE season >= 3) AS h FROM pr GROUP BY 1)
SELECT event_type, round(t, 6) AS train_mae, round(h, 6) AS holdout_mae, round(h - t, 6) AS gap, round((h - t) / t, 6) AS gap_share FROM g"""


def pooled_error(spark, d):
    """The mean of the folds' errors, weighted by their rows."""
    p = M.regression(predictions(spark, d), ["season"], "actual", "predicted").select("season", "n", "mae")
    return rounded(p.agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("pooled_mae"), F.count(F.lit(1)).alias("folds")))


def importance_rollup(spark, d):
    li = table(spark, d, "part").select(F.col("p_type").alias("category"), (F.col("p_retailprice") - 1400).alias("importance"))
    return rounded(X.importance_by_category(li, "category", "importance"))


IMPORTANCE_ROLLUP = """WITH s AS (SELECT p_type AS category, sum(greatest(p_retailprice - 1400, 0)) AS total, count(*) AS features FROM part GROUP BY 1)
SELECT category, round(total, 6) AS total, features, round(total / sum(total) OVER (), 6) AS share, CAST(rank() OVER (ORDER BY total DESC) AS INTEGER) AS rank FROM s"""


def market_check(spark, d):
    g = games(spark, d).withColumn("implied", (F.col("home") - F.col("away")).cast("double")).withColumn("market", (F.col("home_points") - F.col("away_points")).cast("double"))
    return rounded(g.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("implied") - F.col("market"))).alias("mae"), F.corr("implied", "market").alias("corr")))


MARKET_CHECK = f"WITH {GAMES} SELECT season, count(*) AS n, round(avg(abs((home - away) - (home_points - away_points))), 6) AS mae, round(corr(home - away, home_points - away_points), 6) AS corr FROM games GROUP BY 1"


def player_game(spark, d):
    """Rates of each order's supplier lines; a line counts as a first down from its distance, 10 where unknown."""
    p = plays(spark, d).withColumn("need", F.coalesce(F.when(F.col("distance") > 2, F.col("distance")), F.lit(10.0)))
    g = p.groupBy("game", "team").agg(F.count(F.lit(1)).alias("carries"), F.sum("gained").alias("yards"), F.count_if(F.col("gained") >= F.col("need")).alias("first_downs"), F.max("gained").alias("longest"))
    return rounded(g.withColumn("per_carry", safe_div(F.col("yards"), F.col("carries"))))


PLAYER_GAME = """SELECT l_orderkey AS game, l_suppkey AS team, count(*) AS carries, sum(l_quantity) AS yards, count(*) FILTER (WHERE l_quantity >= CASE WHEN round(l_tax * 100) > 2 THEN round(l_tax * 100) ELSE 10 END) AS first_downs,
 max(l_quantity) AS longest, round(sum(l_quantity) / count(*), 6) AS per_carry FROM lineitem GROUP BY ALL"""


def row_counts(spark, d):
    parts = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.min(year(c)).alias("first"), F.max(year(c)).alias("last")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ROW_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST(min(year({c})) AS INTEGER) AS first, CAST(max(year({c})) AS INTEGER) AS last FROM {t}" for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")))

_NAMES = "historical_rows live_rows composite_scores sensitivity_sweep weekly_trajectory model_agreement residual_spread quality_weighted season_pivot two_level_rate class_means describe_columns holdout_by_week generalization_gap pooled_error importance_rollup market_check player_game row_counts"
QUERIES = {name: globals()[name] for name in _NAMES.split()}
ORACLES = {
    "historical_rows": HISTORICAL_ROWS, "live_rows": LIVE_ROWS, "composite_scores": COMPOSITE_SCORES, "sensitivity_sweep": SENSITIVITY_SWEEP, "weekly_trajectory": _trajectory_sql(), "model_agreement": MODEL_AGREEMENT,
    "residual_spread": RESIDUAL_SPREAD, "quality_weighted": QUALITY_WEIGHTED, "season_pivot": SEASON_PIVOT, "two_level_rate": TWO_LEVEL_RATE, "class_means": CLASS_MEANS, "describe_columns": DESCRIBE_COLUMNS,
    "holdout_by_week": HOLDOUT_BY_WEEK, "generalization_gap": GENERALIZATION_GAP, "pooled_error": f"WITH {PREDICTIONS} SELECT round(avg(abs(predicted - actual)), 6) AS pooled_mae, count(DISTINCT season) AS folds FROM pr",
    "importance_rollup": IMPORTANCE_ROLLUP, "market_check": MARKET_CHECK, "player_game": PLAYER_GAME, "row_counts": ROW_COUNTS,
}
