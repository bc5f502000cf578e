"""The analogues that queries run on: which columns of the tables stand for plays, games, members and seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded and without a negative zero, so results compare across engines."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def year(ts: str) -> Column:
    return F.year(ts).cast("int")


def plays(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as plays: game, play, team, opponent, season, week, down, distance, gained, value, is_run, kind."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("play"), F.col("l_suppkey").alias("team"), year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"),
        (F.col("l_linenumber") % 4 + 1).alias("down"), F.round(F.col("l_tax") * 100).alias("distance"), F.col("l_quantity").alias("gained"), F.col("l_discount").alias("value"), (F.col("l_returnflag") == "R").alias("is_run"),
        (F.col("l_partkey") % 100 + 1).alias("opponent"), F.when(F.col("l_returnflag") == "R", "run").when(F.col("l_returnflag") == "N", "pass").otherwise("other").alias("kind"),
    )


PLAYS = """plays AS (SELECT l_orderkey AS game, l_linenumber AS play, l_suppkey AS team, CAST(year(l_shipdate) AS INTEGER) AS season,
  CAST(month(l_shipdate) AS INTEGER) AS week, l_linenumber % 4 + 1 AS down, round(l_tax * 100) AS distance, l_quantity AS gained,
  l_discount AS value, l_returnflag = 'R' AS is_run, l_partkey % 100 + 1 AS opponent,
  CASE l_returnflag WHEN 'R' THEN 'run' WHEN 'N' THEN 'pass' ELSE 'other' END AS kind FROM lineitem)"""


def drives(spark: SparkSession, d: str) -> DataFrame:
    """orders as drives: offense, defense, season, week, scored, touchdown."""
    o, c = table(spark, d, "orders"), F.col
    return o.select(
        (c("o_custkey") % 100 + 1).alias("offense"), (c("o_orderkey") % 100 + 1).alias("defense"), year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"),
        (c("o_orderstatus") == "F").alias("scored"), c("o_orderpriority").startswith("1").alias("touchdown"),
    )


DRIVES = """drives AS (SELECT o_custkey % 100 + 1 AS offense, o_orderkey % 100 + 1 AS defense, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week,
  o_orderstatus = 'F' AS scored, o_orderpriority LIKE '1%' AS touchdown FROM orders)"""


def team_weeks(spark: SparkSession, d: str) -> DataFrame:
    """points by team, season and week; a total that 5 divides counts as unknown."""
    weeks = plays(spark, d).groupBy("team", "season", "week").agg(F.sum("gained").alias("points"))
    return weeks.withColumn("points", F.when(F.col("points") % 5 != 0, F.col("points")))


TEAM_WEEKS = f"""{PLAYS}, tw0 AS (SELECT team, season, week, sum(gained) AS points FROM plays GROUP BY ALL),
tw AS (SELECT team, season, week, CASE WHEN points % 5 <> 0 THEN points END AS points FROM tw0)"""


def games(spark: SparkSession, d: str) -> DataFrame:
    """orders as games between the customer's nation and a nation that the key gives, with points of both sides."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    away = ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("int")
    return joined.select(
        F.col("o_orderkey").alias("game"), year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.col("c_nationkey").alias("home"), away.alias("away"),
        (F.floor("o_totalprice") % 60).cast("int").alias("home_points"), (F.floor(F.col("o_totalprice") / 7) % 50).cast("int").alias("away_points"), (F.col("o_orderkey") % 9 == 0).alias("neutral"),
    )


GAMES = """games AS (SELECT o_orderkey AS game, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week, c_nationkey AS home,
  CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INTEGER) AS away, CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS INTEGER) AS home_points,
  CAST(CAST(floor(o_totalprice / 7) AS BIGINT) % 50 AS INTEGER) AS away_points, o_orderkey % 9 = 0 AS neutral
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """events as scored predictions: score in [0, 1], a label, a prediction of value, seasons 0 to 4 by day."""
    return table(spark, d, "events").select(
        "event_id", F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("season"), "event_type", F.least(F.lit(1.0), F.floor("value") / 100).alias("score"),
        ((F.get_json_object("props", "$.k").cast("int") + F.floor("value")) % 100 >= 60).cast("int").alias("label"), F.col("value").alias("actual"),
        (F.get_json_object("props", "$.k").cast("double") * 0.3 + 5).alias("predicted"),
    )


PREDICTIONS = """pr AS (SELECT event_id, CAST(floor((day(ts) - 1) / 7) AS INTEGER) AS season, event_type, least(1.0, floor(value) / 100) AS score,
  CAST((CAST(json_extract_string(props, '$.k') AS INTEGER) + CAST(floor(value) AS BIGINT)) % 100 >= 60 AS INTEGER) AS label, value AS actual,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.3 + 5 AS predicted FROM events)"""
