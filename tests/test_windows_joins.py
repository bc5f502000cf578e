from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E
from tallyspark.operators import joins as J
from tallyspark.operators import quantiles as Q
from tallyspark.operators import windows as X

WEEKS = "team string, year int, week int, points double"


def weeks(spark, extra=()):
    rows = [("A", 2024, w, 10.0 * w) for w in range(1, 6)] + list(extra)
    return spark.createDataFrame(rows, WEEKS).repartition(3)


def col(df, c, order="week"):
    return [r[0] for r in df.orderBy("team", order).select(c).collect()]


def test_rolling_rules(spark):
    out = X.rolling_means(weeks(spark), ["team", "year"], ["week"], ["points"])
    assert col(out, "points_avg_all") == [10, 15, 20, 25, 30]
    assert col(out, "points_avg3_rows") == [None, None, 20, 30, 40] == col(out, "points_avg3_full")
    assert col(out, "points_avg3_any") == [10, 15, 20, 30, 40]


def test_rolling_rules_differ_on_nulls(spark):
    frame = spark.createDataFrame([("A", 1, 1, 10.0), ("A", 1, 2, None), ("A", 1, 3, 30.0), ("A", 1, 4, 40.0)], WEEKS)
    out = X.rolling_means(frame, ["team", "year"], ["week"], ["points"])
    assert col(out, "points_avg_all") == [10, 10, 20, pytest.approx(80 / 3)]
    assert col(out, "points_avg3_rows") == [None, None, 20, 35] and col(out, "points_avg3_full") == [None] * 4


def test_groups_do_not_mix_and_share_one_sort(spark):
    out = X.rolling_means(weeks(spark, [("B", 2024, w, 100.0 * w) for w in range(1, 4)]), ["team", "year"], ["week"], ["points"])
    assert col(out, "points_avg_all") == [10, 15, 20, 25, 30, 100, 150, 200]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("hashpartitioning") == 1


def test_prior_means(spark):
    out = X.prior_means(weeks(spark), ["team", "year"], ["week"], ["points"])
    assert col(out, "prev_points") == [None, 10, 20, 30, 40]
    assert col(out, "points_avg_all") == [None, 10, 15, 20, 25] and col(out, "points_avg3") == [None, None, None, 20, 30]


def test_no_feature_sees_its_own_row(spark):
    keep = ["week", "prev_points", "points_avg_all", "points_avg3"]
    before = X.prior_means(weeks(spark), ["team", "year"], ["week"], ["points"]).select(keep).orderBy("week").collect()
    changed = weeks(spark).withColumn("points", F.when(F.col("week") == 5, 999999.0).otherwise(F.col("points")))
    assert X.prior_means(changed, ["team", "year"], ["week"], ["points"]).select(keep).orderBy("week").collect() == before


def test_records(spark):
    frame = spark.createDataFrame([("C", 2021, 12, 10), ("C", 2022, 13, 11), ("C", 2023, 14, 9)], "team string, year int, games int, wins int")
    rows = X.cumulative_record(frame, ["team"], ["year"], "games", "wins").orderBy("year").collect()
    assert [(r["total_games"], r["total_pct"], r["prior_games"], r["prior_pct"]) for r in rows] == [(12, 10 / 12, 0, None), (25, 21 / 25, 12, 10 / 12), (39, 30 / 39, 25, 21 / 25)]
    later = X.relabel_next(frame, ["team"], "year").orderBy("year").collect()
    assert [(r["year"], r["games"]) for r in later] == [(2022, 12), (2023, 13)]


def test_change_flag_and_gaps(spark):
    rows = [("A", 1, "x"), ("A", 2, "x"), ("A", 3, None), ("A", 4, "y")]
    frame = spark.createDataFrame(rows, "team string, week int, who string")
    assert col(frame.withColumn("c", X.change_flag(["team"], "week", "who")), "c") == [None, 0, 1, 1]
    times = [dt.datetime(2024, 1, 1, 20), dt.datetime(2024, 1, 9, 19), dt.datetime(2024, 1, 9, 20)]
    frame = spark.createDataFrame([("A", k, t) for k, t in enumerate(times)], "team string, week int, ts timestamp_ntz")
    assert col(frame.withColumn("d", X.days_since_previous(["team"], ["ts"], "ts")), "d") == [None, 7, 0]


def test_seasons_go_by_the_calendar(spark):
    frame = spark.createDataFrame([("A", 2019, 4.0), ("A", 2020, 6.0), ("A", 2022, 9.0), ("A", 2023, 1.0)], "team string, season int, wins double")
    rows = X.season_lags(frame, ["team"], "season", "wins").orderBy("season").collect()
    assert [(r["wins_lag1"], r["wins_lag2"], r["wins_lag3"], r["wins_lag_mean"], r["wins_step"]) for r in rows] == [
        (None, None, None, None, None), (4, None, None, 4, None), (None, 6, 4, 5, None), (9, None, 6, 7.5, None)]
    rows = X.season_windows(frame, ["team"], "season", "wins").orderBy("season").collect()
    assert [(r["seasons_3"], r["wins_sum_3"], r["wins_std_2"]) for r in rows] == [(0, None, None), (1, 4, None), (2, 10, None), (2, 15, None)]


def test_first_and_ties(spark):
    frame = spark.createDataFrame([("A", 1, 5), ("A", 2, 5), ("A", 3, 4)], "team string, week int, n int")
    assert X.first_by(frame, ["team"], [F.col("n").desc(), F.col("week")]).collect()[0]["week"] == 1
    assert X.first_with_ties(frame, ["team"], [F.col("n").desc()]).count() == 2


def test_average_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("AB"), k, float(rng.randint(0, 40)) if k % 9 else 0.0) for k in range(400)]
    frame = pd.DataFrame(rows, columns=["team", "week", "x"])
    got = X.average_ranks(spark.createDataFrame(frame), ["team"], "x", "r").orderBy("week").toPandas()
    assert got["r"].tolist() == frame.groupby("team")["x"].rank().tolist()


def test_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ABC"), None if k % 11 == 0 else float(rng.choice([1, 2, 2, 3, rng.randint(0, 1000)]))) for k in range(500)] + [("D", None), ("E", 7.0)]
    frame = pd.DataFrame(rows, columns=["g", "x"])
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["q"] for r in Q.exact_quantiles(df, ["g"], "x", points, "q").collect()}
    assert got == {g: pytest.approx(frame[frame.g == g].x.quantile(points).tolist()) for g in "ABCE"}
    assert Q.exact_quantiles(df, [], "x", points, "q").first()["q"] == pytest.approx(frame.x.quantile(points).tolist())


def test_lag_by_slices(spark):
    """The same as a window over whole groups, also where a slice has no row of a group and where values are null."""
    rng = random.Random(3)
    rows = [(rng.choice(["A", "B", None]), k * k, None if k % 5 == 0 else float(k)) for k in range(300)]
    frame = spark.createDataFrame(rows, "g string, t int, x double")
    plain = frame.withColumn("p", F.lag("x").over(W.partitionBy("g").orderBy("t"))).orderBy("t").collect()
    got = X.lag_by_slices(frame.where("g is not null"), ["g"], "t", "x", "p").orderBy("t").collect()
    assert [(r["g"], r["t"], r["p"]) for r in got] == [(r["g"], r["t"], r["p"]) for r in plain if r["g"] is not None]


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, at(5), "a"), (1, at(7), "b"), (2, at(5), "c"), (None, at(9), "d"), (1, None, "e"), (1, at(1), "f")], "who int, ts timestamp_ntz, tag string")
    right = spark.createDataFrame([(1, at(3), 20, 1), (1, at(5), 99, 1), (1, at(5), 98, 2), (None, at(1), 7, 1)], "who int, ts timestamp_ntz, x int, tie int")
    got = {r["tag"]: r["asof_x"] for r in J.asof_join(left, right, ["who"], "ts", ["x"], [F.col("tie").desc()]).collect()}
    assert got == {"a": 20, "b": 98, "c": None, "d": None, "e": None, "f": None}
    got = {r["tag"]: r["asof_x"] for r in J.asof_join(left, right, ["who"], "ts", ["x"], [F.col("tie").desc()], strict=False).collect()}
    assert got["a"] == 98 and got["b"] == 98


def test_opponent_values(spark):
    frame = spark.createDataFrame([(1, "A", 10), (1, "B", 7), (2, "A", 3)], "game int, team string, points int")
    got = {r["team"]: r["points_allowed"] for r in J.opponent_values(frame, "game", ["points"]).collect()}
    assert got == {"A": 7, "B": 10}


def test_sides(spark):
    games = spark.createDataFrame([(1, "A", "B", 10, 7)], "game int, home string, away string, hp int, ap int")
    rows = J.stack_sides(games, ["game"], {"team": "home", "points": "hp"}, {"team": "away", "points": "ap"}).collect()
    assert {tuple(r) for r in rows} == {(1, "A", 10, True), (1, "B", 7, False)}
    stats = spark.createDataFrame([("A", 1.0)], "team string, x double")
    assert J.attach_sides(games, stats, "team", "home", "away", ["x"]).select("home_x", "away_x").first()[:] == (1.0, None)


def test_best_of_two(spark):
    frame = spark.createDataFrame([(1, 1, 5), (2, 9, 2), (3, None, 9)], "id int, a int, b int")
    lookup = spark.createDataFrame([(1, None, 3), (2, 5, 4), (None, 9, 8)], "k int, m int, stars int")
    got = {r["id"]: r["best_stars"] for r in J.best_of_two(frame, lookup, ("a", "k"), ("b", "m"), "stars").collect()}
    assert got == {1: 4, 2: None, 3: 8}


def test_resolution(spark):
    roster = spark.createDataFrame([("T", "Bob Smith", 1), ("T", "BOB SMITH Jr.", 2), ("T", "José Diaz", 3), ("T", "Al Twin", 4), ("T", "Al Twin", 5)], "team string, name string, who int")
    names = spark.createDataFrame([("T", "Bob Smith"), ("T", "jose diaz"), ("T", "bob smith"), ("T", "Al Twin"), ("T", "Nobody"), ("U", "Bob Smith")], "team string, name string")
    got = {(r["team"], r["name"]): (r["who"], r["method"]) for r in J.resolve(names, roster, ["team"], "name", "who", E.normalize_name(F.col("name"))).collect()}
    assert got == {("T", "Bob Smith"): (1, "exact"), ("T", "jose diaz"): (3, "normalized"), ("T", "bob smith"): (None, "ambiguous"), ("T", "Al Twin"): (None, "ambiguous"), ("T", "Nobody"): (None, "unmatched"), ("U", "Bob Smith"): (None, "unmatched")}


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert J.one_to_one(a, a.withColumnRenamed("v", "w"), ["k"]).count() == 2
    for left, right in ((a.union(a), a), (a, a.where("k = 1")), (a, a.union(a))):
        with pytest.raises(ValueError):
            J.one_to_one(left, right.withColumnRenamed("v", "w"), ["k"])


def test_windows_of_a_hot_entity(spark):
    rng = random.Random(9)
    rows = [("hot" if k % 3 else rng.choice(["a", "b", None]), k, None if k % 11 == 0 else float(rng.randint(0, 50)), float(k % 7)) for k in range(900)]
    df = spark.createDataFrame(rows, "who string, week int, x double, z double").repartition(5)
    for n in (1, 2, 16, 400):
        got = X.windows_by_slices(df, ["who"], "week", ["x", "z"], 3, n).orderBy("week").toPandas()
        want = X.prior_means(df, ["who"], [F.col("week")], ["x", "z"], 3).orderBy("week").toPandas()
        pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    cut = X.sliced(df.where("who = 'hot'"), "week", 16).groupBy("who", "__slice").count().collect()
    assert len(cut) == 16 and max(r["count"] for r in cut) < 2 * 600 / 16


@pytest.mark.parametrize("strict", [True, False])
def test_asof_of_a_hot_entity_over_slices(spark, strict):
    rng = random.Random(10)
    left = [(k, rng.choice(["hot", "hot", "b", None]), rng.choice([None, rng.randint(0, 300)])) for k in range(400)]
    right = [(rng.choice(["hot", "hot", "c", "b"]), rng.randint(100, 300), k) for k in range(500)]
    want = {}
    for tag, who, ts in left:
        best = [(t, tie) for w, t, tie in right if w == who and ts is not None and (t < ts if strict else t <= ts)]
        want[tag] = max(best)[1] if best else None
    lf, rf = spark.createDataFrame(left, "tag int, who string, ts int"), spark.createDataFrame(right, "who string, ts int, x int")
    for n in (1, 3, 64):
        found = J.asof_join(lf, rf, ["who"], "ts", ["x"], [F.col("x").desc()], strict, n)
        assert {r["tag"]: r["asof_x"] for r in found.collect()} == want
    stamps = [f.withColumn("ts", F.timestamp_seconds("ts")) for f in (lf, rf)]
    assert {r["tag"]: r["asof_x"] for r in J.asof_join(*stamps, ["who"], "ts", ["x"], [F.col("x").desc()], strict).collect()} == want


def test_rows_of_a_large_group_stay_in_their_tasks(spark, monkeypatch):
    """Buckets come to the rows: one column, or one group, is never dealt to a single task."""
    monkeypatch.setattr(Q, "LARGE", 100, raising=False)
    rows = spark.range(0, 4000, 1, 4).select(F.struct(F.lit(None).cast("string").alias("v")).alias("k0"), F.lit("x").alias("column"), F.col("id").cast("double").alias("x"))
    for group in (["column"], ["k0", "column"]):
        cells = rows.groupBy(*group).agg(F.lit(0).alias("from"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
        found = Q._cells_of(rows, cells, group)
        assert found.count() == 4000
        assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_quantiles_of_large_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(Q, "LARGE", 100, raising=False)
    rng = np.random.default_rng(5)
    values = {g: rng.lognormal(1, 2, n).round(2) for g, n in ((None, 900), ("a", 101), ("b", 100), ("c", 1), ("d", 2500))}
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs], "g string, x double").repartition(3)
    got = {r["g"]: (r["n"], r["quantiles"]) for r in Q.column_quantiles(df, ["g"], ["x"], [0, 0.3, 0.5, 1]).collect()}
    assert got == {g: (len(x), pytest.approx(np.quantile(x, [0, 0.3, 0.5, 1]).tolist())) for g, x in values.items()}


def test_intervals_and_column_quantiles(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 7.0, None)], "x double")
    assert [r[0] for r in df.select(X.interval(F.col("x"), [0.0, 1.0, 5.0])).collect()] == [0, 1, 1, 2, 3, None]
    rng = random.Random(12)
    rows = [(rng.choice([None, "a"]), rng.choice([1e-300, -5.0, 1.7e9 + rng.random(), 0.0, rng.gauss(0, 1) * 10 ** rng.randint(-20, 20)]), float("nan") if k % 5 == 0 else rng.random(), None) for k in range(3000)]
    f = pd.DataFrame(rows, columns=["g", "x", "y", "z"])
    points = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = Q.column_quantiles(spark.createDataFrame(rows, "g string, x double, y double, z double"), ["g"], ["x", "y", "z"], points).collect()
    assert len(got) == 4
    for r in got:
        own = f[f.g.isna() if r["g"] is None else f.g == r["g"]][r["column"]].dropna()
        assert r["n"] == len(own) and r["quantiles"] == pytest.approx(own.quantile(points).tolist(), rel=1e-12)
