from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import exprs as E


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_safe_division(spark):
    got = one(spark, E.safe_div(F.col("a"), F.col("b")), [(1, 2), (1, 0), (0, 0), (None, 1), (1, None)], "a int, b int")
    assert got == [0.5, None, None, None, None]


def test_clip_keeps_null(spark):
    assert one(spark, E.clip(F.col("x"), -3, 3), [(-9.0,), (9.0,), (1.5,), (None,)], "x double") == [-3.0, 3.0, 1.5, None]


def test_margin_label(spark):
    assert one(spark, E.margin_label(F.col("m")), [(0.5,), (-0.5,), (0.0,), (None,)], "m double") == [1, 0, None, None]


def test_success_thresholds(spark):
    rows = [(1, 10, 5), (1, 10, 4), (2, 10, 7), (2, 10, 6), (3, 4, 4), (4, 2, 1), (1, 0, 3), (1, None, 3)]
    assert one(spark, E.is_success(F.col("down"), F.col("distance"), F.col("gained")), rows, "down int, distance int, gained int") == [True, False, True, False, True, False, False, False]


def test_compound_and_clock(spark):
    rows = [("7-16", "39:15"), ("bad", "soon"), (None, None), ("3-", "4:")]
    frame = spark.createDataFrame(rows, "c string, t string")
    got = frame.select(E.compound_part(F.col("c"), 1), E.compound_part(F.col("c"), 2), E.clock_minutes(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(7, 16, 39.25), (None, None, None), (None, None, None), (3, None, None)]


def test_names(spark):
    rows = [("Bob Smith Jr.",), ("Marcus Johnson III",), ("José O'Brien",), ("  BOB   SMITH  ",), (None,)]
    assert one(spark, E.normalize_name(F.col("n")), rows, "n string") == ["bob smith", "marcus johnson", "jose obrien", "bob smith", ""]


def test_json_ids(spark):
    assert one(spark, E.json_ids(F.col("j")), [('["1","0","",null,"22"]',), ("[]",), (None,)], "j string") == [["1", "22"], [], None]


def test_scoring_ratio(spark):
    got = one(spark, E.pythagorean(F.col("a"), F.col("b"), 2.0), [(60.0, 40.0), (0.0, 0.0), (10.0, 0.0)], "a double, b double")
    assert got[0] == pytest.approx(3600 / 5200) and got[1] is None and got[2] == 1.0
    assert one(spark, E.pythagorean(F.col("a"), F.col("b"), 2.0, 1e-6), [(0.0, 0.0)], "a double, b double") == [0.0]


def test_normal_distribution(spark):
    zs = [-3.0, -1.0, 0.0, 0.3, 1.96]
    got = one(spark, E.normal_cdf(F.col("z")), [(z,) for z in zs], "z double")
    assert all(abs(g - (1 + math.erf(z / math.sqrt(2))) / 2) < 1e-6 for g, z in zip(got, zs, strict=True))


def test_column_names():
    assert E.camel_to_snake("totalPenaltiesYards") == "total_penalties_yards"
    names = E.expand_names(["points"])
    assert len(names) == 6 and [E.parse_name(n) for n in names][:3] == [("home", "prev_week", "points"), ("home", "avg_all", "points"), ("home", "avg3", "points")]
    assert E.parse_name("trend_points") == ("", "trend", "points") and E.parse_name("diff_epa") == ("diff", "", "epa")


def test_names_lose_every_accent_and_what_has_no_plain_letter(spark):
    rows = [("Şükrü Ńowak",), ("Nguyễn Văn",), ("ﬁeld Ĳssel",), ("Søren Łukasz",), ("Zo\u0308e",), ("Müller III",), (None,)]
    assert one(spark, E.normalize_name(F.col("n")), rows, "n string") == ["sukru nowak", "nguyen van", "field ijssel", "sren ukasz", "zoe", "muller", ""]


def test_cover_labels(spark):
    rows = [(7, -3), (2, -3), (3, -3), (-1, 3), (-9, 3), (4, 0), (None, 3)]
    assert one(spark, E.cover_label(F.col("m"), F.col("l")), rows, "m int, l int") == ["favourite", "underdog", None, "underdog", "favourite", None, None]


def test_columns_are_grouped_by_their_names():
    names = ["home_prev_week_offense_epa", "home_offense_epa_avg3", "home_defense_epa_avg3", "away_offense_epa_avg_all", "season"]
    assert E.transform_groups(names) == {
        ("home", "offense_epa"): {"prev_week": names[0], "avg3": names[1]}, ("home", "defense_epa"): {"avg3": names[2]}, ("away", "offense_epa"): {"avg_all": names[3]},
    }
    assert E.mirror_pairs(names) == [(names[1], names[2])]
    assert [E.domain_of(n, {"value": ("epa",), "time": ("season",)}) for n in (names[0], "season", "x")] == ["value", "time", "other"]
