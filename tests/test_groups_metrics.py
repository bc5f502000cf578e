from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.functions.exprs import is_success
from tallyspark.operators import aggregates as A
from tallyspark.operators import checks as C
from tallyspark.operators import metrics as M
from tallyspark.operators import ratings as T
from tallyspark.operators import rosters as R
from tallyspark.operators import selection as S


def test_side_measures(spark):
    rows = [("A", "B", 1, 10, 6, "run", 1.0), ("A", "B", 3, 5, 25, "run", 0.7), ("A", "B", 2, 10, 2, "pass", -0.7), ("A", "C", 3, 5, 1, "pass", -1.0), (None, "C", 1, 10, 50, "other", None)]
    p = spark.createDataFrame(rows, "offense string, defense string, down int, distance int, gained int, kind string, value double")
    p = p.withColumn("success", is_success(F.col("down"), F.col("distance"), F.col("gained"))).withColumn("week", F.lit(1))
    d = spark.createDataFrame([("A", "B", 1, True, False), ("A", "C", 1, None, None), ("B", "A", 1, True, True)], "offense string, defense string, week int, scored boolean, touchdown boolean")
    got = {r["team"]: r for r in A.both_sides(p, d, ["week"], 20).collect()}
    r = got["A"]
    assert len(r) == 2 + 2 * 36 and set(got) == {"A", "B", "C"}
    assert (r["offense_plays"], r["offense_run_plays"], r["offense_pass_plays"], r["offense_successes"], r["offense_run_explosives"], r["offense_drives"], r["offense_scoring_drives"]) == (4, 2, 2, 2, 1, 2, 1)
    assert r["offense_value"] == pytest.approx(0) and r["offense_run_value_per_play"] == pytest.approx(0.85) and r["offense_pass_value_per_play"] == pytest.approx(-0.85)
    assert (r["offense_third_down_distance"], r["offense_first_down_run_success_rate"], r["offense_first_down_pass_success_rate"], r["offense_scoring_drive_share"]) == (5, 1, None, 0.5)
    assert r["defense_plays"] is None and got["B"]["offense_plays"] is None
    assert (got["C"]["defense_plays"], got["C"]["defense_explosives"], got["C"]["defense_run_success_rate"], got["C"]["defense_drives"], got["B"]["defense_drives"]) == (2, 1, None, 1, 1)


def test_gini(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("b", 6.0), ("b", None), ("b", -4.0), ("c", 0.0)], "g string, x double")
    got = {r["g"]: r for r in A.gini(frame, ["g"], "x").collect()}
    assert got["a"]["gini"] == pytest.approx(0) and got["b"]["gini"] == pytest.approx(2 / 3) and got["c"]["gini"] is None
    assert got["b"]["n"] == 3 and got["b"]["cv"] == pytest.approx(np.std([0, 0, 6], ddof=1) / 2)


def test_preferred_or_average(spark):
    rows = [(1, "consensus", -3.5), (1, "x", -3.0), (2, "x", -4.5), (2, "y", -3.5), (3, "consensus", None), (3, "x", 1.0)]
    frame = spark.createDataFrame(rows, "game int, provider string, spread double")
    got = {r["game"]: r["s"] for r in A.preferred_or_average(frame, ["game"], F.col("provider") == "consensus", "spread", "s").collect()}
    assert got == {1: -3.5, 2: -4.0, 3: None}


def test_star_ratio(spark):
    rows = [("T", 1, 5, 0.92), ("T", 2, None, None), ("T", 3, 2, 0.92), ("U", 9, None, None)]
    got = {r["team"]: r for r in A.star_ratio(spark.createDataFrame(rows, "team string, id int, stars int, rating double"), ["team"], "id", "stars", "rating", min_matched=2).collect()}
    assert got["T"]["ratio"] == pytest.approx(1 / 3) and got["T"]["matched_ratio"] == 0.5 and got["U"]["ratio"] == 0 == got["U"]["avg_rating"] and got["U"]["matched_ratio"] is None


def test_quantile_buckets_are_those_of_value_edges(spark):
    rng = random.Random(1)
    xs = [float(rng.randint(0, 30)) for _ in range(500)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    got = [r["bucket"] for r in A.quantile_buckets(frame, "x", 7).orderBy("k").collect()]
    want = pd.qcut(pd.Series(xs), 7, labels=False, duplicates="drop").tolist()
    assert got == want


def test_turnover(spark):
    rows = [(1, "A", 2023), (2, "A", 2023), (3, "B", 2023), (1, "A", 2024), (2, "B", 2024), (4, "A", 2024)]
    got = {(r["team"], r["season"]): (r["stayed"], r["new"], r["moved_in"], r["gone"], r["moved_out"]) for r in R.turnover(spark.createDataFrame(rows, "who int, team string, season int"), "who", "team", "season").collect()}
    assert got == {("A", 2024): (1, 1, 0, 0, 1), ("B", 2024): (0, 0, 1, 1, 0)}


def test_tenure(spark):
    rows = [(1, 2020), (1, 2020), (1, 2021), (1, 2023), (2, 2023)]
    got = {(r[0], r[1]): r[2] for r in R.tenure(spark.createDataFrame(rows, "who int, season int"), "who", "season").collect()}
    assert got == {(1, 2020): 0, (1, 2021): 1, (1, 2023): 2, (2, 2023): 0}


def test_flows(spark):
    moves = spark.createDataFrame([("A", "B", 1.0), ("A", "B", 3.0), ("B", "A", 2.0), ("C", "C", 9.0)], "o string, t string, r double")
    got = {r["place"]: (r["n_in"], r["n_out"], r["net"], r["quality_delta"]) for r in R.flow_totals(moves, "o", "t", "r").collect()}
    assert got == {"A": (1, 2, -1, 0.0), "B": (2, 1, 1, 0.0), "C": (1, 1, 0, 0.0)}
    assert [tuple(r) for r in R.pair_flows(moves, "o", "t").collect()] == [("A", "B", 3, 1, "B", "A")]


def margins(spark, games, season="season int"):
    rows = [(2024, a, b, float(m)) for a, b, m in games] + [(2024, b, a, -float(m)) for a, b, m in games]
    return spark.createDataFrame(rows, f"{season}, team string, opponent string, margin double")


def test_ratings_of_a_round_robin(spark):
    rows = margins(spark, [("A", "B", 10), ("A", "C", 7), ("B", "C", -7)])
    got = {r["team"]: r["rating"] for r in T.rate(rows, "season").collect()}
    assert got["A"] == pytest.approx(17 / 3) and got["B"] == pytest.approx(-17 / 3) and sum(got.values()) == pytest.approx(0, abs=1e-9)


def test_passes_count_where_ratings_oscillate(spark):
    rows = margins(spark, [("A", "B", 8)])
    even, odd = ({r["team"]: r["rating"] for r in T.rate(rows, "season", n).collect()} for n in (500, 501))
    assert even["A"] == pytest.approx(0) and odd["A"] == pytest.approx(8)


def test_both_ways_to_rate_agree(spark):
    rng = random.Random(7)
    rows = margins(spark, [(f"t{rng.randrange(12)}", f"u{rng.randrange(9)}", rng.randint(-30, 30)) for _ in range(200)])
    a, b = ({r["team"]: r["rating"] for r in f(rows, "season", 4).collect()} for f in (T.rate, T.rate_by_joins))
    assert a == pytest.approx(b)


def test_home_advantage(spark):
    games = spark.createDataFrame([(2024, "A", "B", 7.0, False), (2024, "B", "A", 7.0, False), (2024, "A", "C", 50.0, True)], "season int, h string, a string, m double, n boolean")
    assert T.home_advantage(games.where("not n"), "m").first()[0] == 7 and T.home_advantage(games.where("m > 99"), "m").first()[0] == 0
    rows = T.team_margins(games, "season", "h", "a", "m", "n").collect()
    assert sorted(r["margin"] for r in rows) == [-50, 0, 0, 0, 0, 50]


def test_phantom_games_shrink_to_the_prior(spark):
    rows = margins(spark, [("A", "B", 6)])
    priors = spark.createDataFrame([("A", 4.0)], "team string, rating double")
    got = T.with_phantoms(rows, priors, "season", 5).where("weight = 5").select("team", "margin").collect()
    assert {tuple(r) for r in got} == {("A", 4.0), ("B", 4.0)}
    assert spark.createDataFrame([(0,), (1,)], "n int").select(T.prior_weight("n", 5)).collect() == [(1.0,), (5 / 6,)]


def test_exponent_fit(spark):
    rows = spark.createDataFrame([(float(a), float(b), a**2.4 / (a**2.4 + b**2.4)) for a in (20, 30, 45) for b in (18, 33, 50)], "pf double, pa double, pct double")
    k, mse = T.fit_exponent(rows, "pf", "pa", "pct").first()
    assert abs(k - 2.4) < 0.02 and mse < 1e-5 and T.fit_exponent(rows.where("pf < 0"), "pf", "pa", "pct").count() == 0


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 7])
def test_ranking_measures(spark, seed):
    rng = random.Random(seed)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(200)]
    r = M.ranking(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    assert r["auc"] == pytest.approx(brute_auc(rows))
    cut = sorted({s for _, s in rows}, reverse=True)
    tp = [sum(y for y, s in rows if s >= c) for c in cut]
    precision = [t / sum(s >= c for _, s in rows) for t, c in zip(tp, cut, strict=True)]
    want = sum((t - u) * p for t, u, p in zip(tp, [0, *tp], precision, strict=False)) / tp[-1]
    assert r["average_precision"] == pytest.approx(want)


def test_regression_measures(spark):
    y, p = [1.0, 2.0, 5.0, 7.0], [2.0, 2.0, 4.0, 9.0]
    r = M.regression(spark.createDataFrame([(0, a, b) for a, b in zip(y, p, strict=True)], "g int, y double, p double"), ["g"], "y", "p").first()
    e = np.array(p) - np.array(y)
    assert r["mae"] == pytest.approx(1.0) and r["rmse"] == pytest.approx(math.sqrt((e**2).mean())) and r["bias"] == 0.5 and r["within"] == 0.75
    assert r["r2"] == pytest.approx(1 - (e**2).sum() / ((np.array(y) - np.mean(y)) ** 2).sum())


def test_classification_measures(spark):
    frame = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.8), (1, 1, 0.2), (1, 0, 0.1)], "g int, y int, p double")
    r = M.classification(frame, ["g"], "y", "p").first()
    assert (r["flagged"], r["coverage"], r["precision"], r["recall"], r["accuracy"]) == (2, 0.5, 0.5, 0.5, 0.5)
    assert r["log_loss"] == pytest.approx(-(math.log(0.9) + math.log(0.2) + math.log(0.2) + math.log(0.9)) / 4)


def test_thresholds(spark):
    frame = spark.createDataFrame([("m", 1, 0.9), ("m", 0, 0.6), ("m", 1, 0.6), ("m", 0, 0.2)], "m string, y int, p double")
    grid = M.threshold_grid(frame, ["m"], "y", "p", [0.1, 0.5, 0.8, 0.95])
    assert {r["threshold"]: (r["flagged"], r["precision"]) for r in grid.collect()} == {0.1: (4, 0.5), 0.5: (3, pytest.approx(2 / 3)), 0.8: (1, 1.0), 0.95: (0, None)}
    assert [M.best_threshold(grid, ["m"], f).first()["threshold"] for f in (0.2, 0.5, 1.1)] == [0.8, 0.5, 0.8]


def test_intervals_and_spearman(spark):
    frame = spark.createDataFrame([(1, float(k), 5.0) for k in range(11)], "g int, y double, p double")
    r = M.residual_interval(frame, "y", "p").first()
    assert (r["low"], r["high"]) == (1.0, 9.0)
    mono = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 8.0), (1, 3.0, 9.0), (1, None, 1.0)], "g int, x double, y double")
    assert M.spearman(mono, ["g"], "x", "y").first()["spearman"] == pytest.approx(1)


def test_folds_never_see_the_future():
    got = M.folds(list(range(2015, 2020)), 2017, holdout=2019, excluded=(2016,))
    assert got == [([2015], 2017), ([2015, 2017], 2018)]


def test_checks(spark):
    frame = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, float("inf")), (3, None)], "k int, x double")
    assert [tuple(r) for r in C.duplicate_keys(frame, ["k"]).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        C.require(C.duplicate_keys(frame, ["k"]), "keys")
    C.require(C.duplicate_keys(frame.where("k > 1"), ["k"]), "keys")
    with pytest.raises(ValueError):
        C.same_count(frame, frame.limit(1), "join")
    assert {r["column"]: r["n"] for r in C.out_of_bounds(frame, {"x": (1.5, None)}).collect()} == {"x": 2}
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0), (4, None), (5, 0.0)], "k int, x double")
    b = spark.createDataFrame([(1, 1.2), (2, 5.0), (3, 5.0), (4, None), (6, 0.0)], "k int, x double")
    r = C.frame_diff(a, b, ["k"], ["x"], 0.05).first()
    assert (r["n_compared"], r["n_one_known"], r["n_over"], r["only_left"], r["only_right"]) == (2, 1, 1, 1, 1) and r["max_gap"] == pytest.approx(0.2)
    counts = spark.createDataFrame([(s,) for s, n in ((1, 10), (2, 12), (3, 5), (4, 9)) for _ in range(n)], "s int")
    assert {r["s"]: (r["median_n"], r["is_short"]) for r in C.short_periods(counts, "s").collect()}[3] == (9.5, True)
    assert {r["s"]: (r["median_n"], r["is_short"]) for r in C.short_periods(counts, "s", without_itself=True).collect()}[3] == (10, True)
    assert C.wrong_columns(frame, ["k", "x", "y"], ("x",)) == ["y", "x"]
    slots = C.coverage(spark.createDataFrame([(1, 9), (2, 9), (5, 8)], "k int, s int"), frame, ["k"], ["s"])
    assert {r["s"]: (r["slots"], r["matched"], r["rate"]) for r in slots.collect()} == {9: (2, 2, 1.0), 8: (1, 0, 0.0)}
    assert C.incomplete(frame, ["k"], "x").where("too_many").first()["k"] == 3


def test_pruning_keeps_the_stronger_of_a_pair(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=300), rng.normal(size=300)
    frame = spark.createDataFrame(pd.DataFrame({"a": a, "a2": a + rng.normal(0, 0.05, 300), "b": b, "y": a + rng.normal(0, 0.01, 300)}))
    assert S.prune_correlated(frame, ["a", "a2", "b"], "y") == ["a", "b"]
    assert len(S.representatives(frame, ["a", "a2", "b"], "y")) == 2
    assert S.variance_inflation(frame, ["a", "a2", "b"])["a"] > 50 > 2 > S.variance_inflation(frame, ["a", "a2", "b"])["b"]
    assert len(S.principal_components(frame, ["a", "a2", "b"]).first()["components"]) == 2


def test_average_linkage():
    sim = np.array([[1, 0.9, 0.1, 0.0], [0.9, 1, 0.2, 0.1], [0.1, 0.2, 1, 0.8], [0.0, 0.1, 0.8, 1]])
    assert S.cluster_average_linkage(sim, 0.3) == [[0, 1], [2, 3]] and S.cluster_average_linkage(sim, 0.05) == [[0], [1], [2], [3]]


def test_turnover_with_ratings(spark):
    rows = [(1, "A", 2023, "q"), (2, "A", 2023, "r"), (3, "B", 2023, "q"), (1, "A", 2024, "q"), (2, "B", 2024, "r"), (4, "A", 2024, "r")]
    roster = spark.createDataFrame(rows, "who int, team string, season int, role string")
    ratings = spark.createDataFrame([(2, 0.5), (4, 0.25), (3, 0.125)], "who int, rating double")
    got = {r["team"]: r for r in R.rated_turnover(roster, ratings, "who", "team", "season", ("role", "q")).collect()}
    a, b = got["A"], got["B"]
    assert (a["size_before"], a["stayed"], a["departed"], a["transferred_out"], a["incoming"], a["transferred_in"], a["key_departed"], a["net_transfer_rating"]) == (2, 1, 1, 1, 1, 0, False, -0.5)
    assert (b["size_before"], b["departed"], b["transferred_in"], b["key_departed"], b["net_transfer_rating"], b["turnover_share"]) == (1, 1, 1, True, 0.5, 1)
    moves = {r["team"]: (r["arrivals"], r["departures"], r["net_rating"]) for r in R.arrivals_and_departures(roster, ratings, "who", "team", "season").where("season = 2024").collect()}
    assert moves == {"A": (1, 0, 0.25), "B": (0, 1, -0.125)}


def test_tenure_counts_back_from_the_first_season(spark):
    rows = spark.createDataFrame([(1, s) for s in (2015, 2018, 2019, 2020, 2021)] + [(2, 2021)], "who int, season int")
    got = {(r["who"], r["season"]): r["tenure"] for r in R.tenure(rows, "who", "season", (2020, 2021), 2).collect()}
    assert got == {(1, 2020): 2, (1, 2021): 3, (2, 2021): 0}


def test_leaders(spark):
    rows = spark.createDataFrame([("A", 2020, "x"), ("A", 2021, "y"), ("A", 2022, "y"), ("A", 2024, "x")], "team string, season int, who string")
    got = {r["season"]: (r["changed"], r["since"], r["years"], r["censored"], r["first_year"]) for r in R.leader_tenure(rows, "team", "season", "who", 2020).collect()}
    assert got == {2020: (False, 2020, 0, True, True), 2021: (True, 2021, 0, False, True), 2022: (False, 2021, 1, False, False), 2024: (False, 2020, 4, True, False)}


def settled(rows, passes):
    r = {t: 0.0 for t, _, _ in rows}
    for _ in range(passes):
        raw = {t: np.mean([m + r.get(o, 0.0) for a, o, m in rows if a == t]) for t in r}
        mean = np.mean(list(raw.values()))
        r = {t: x - mean for t, x in raw.items()}
    return r


def test_pool_and_fixed_opponents(spark):
    rows = [("A", "B", 10.0), ("B", "A", -10.0), ("A", "z1", 40.0), ("B", "z2", 20.0), ("z1", "A", -40.0), ("B", "C", 3.0), ("C", "B", -3.0)]
    frame = spark.createDataFrame([(2024, *r) for r in rows], "season int, team string, opponent string, margin double")
    rated = spark.createDataFrame([("A",), ("B",), ("C",)], "team string")
    got = {r["team"]: r["rating"] for r in T.rate(T.with_pool(frame, rated, "season"), "season").collect()}
    assert got == pytest.approx(settled([(a, o if o in "ABC" else None, m - 30 * (o not in "ABC")) for a, o, m in rows if a in "ABC"], 200), abs=1e-6)
    fixed = spark.createDataFrame([("C", -7.0)], "opponent string, rating double")
    got = {r["team"]: r["rating"] for r in T.rate(T.with_fixed(frame.where("team <> 'C'"), fixed), "season").collect()}
    assert got == pytest.approx(settled([(a, o if o != "C" else None, m - 7 * (o == "C")) for a, o, m in rows if a != "C"], 200), abs=1e-6)


def test_queries_that_sql_cannot_follow(spark):
    from tallyspark.plans import evaluation as E

    sf = "/root/testdata/sf0.001"
    got = {(r["season"], r["team"]): r["rating"] for r in E.srs_settled(spark, sf).collect()}
    rows = E._margins(spark, sf).collect()
    for season in {r["season"] for r in rows}:
        want = settled([(r["team"], r["opponent"], r["margin"]) for r in rows if r["season"] == season], 200)
        assert {t: x for (s, t), x in got.items() if s == season} == pytest.approx(want, abs=1e-5)
    points = [(r["pf"], r["pa"], r["pct"]) for r in E.pythagorean(spark, sf).where("pf > 0").collect()]
    error = lambda k: np.mean([(y - 1 / (1 + (b / a) ** k)) ** 2 for a, b, y in points])
    k, mse = E.fit_exponent(spark, sf).first()
    assert mse == pytest.approx(min(error(x) for x in np.linspace(0.5, 6, 20_001)), abs=1e-6) and error(k) == pytest.approx(mse, abs=1e-6)


def test_quality_weight(spark):
    rows = [(t, float(20 + t + 3 * g), float(25 + g), (g % 5 - 2) / 2) for t in range(6) for g in range(10)]
    ratio = lambda a, t: (lambda s, c: s * s / (s * s + c * c))(*[sum(x) for x in zip(*[(p * (1 + a * z), q / (1 + a * z)) for u, p, q, z in rows if u == t], strict=True)])
    actual = spark.createDataFrame([(t, ratio(0.12, t)) for t in range(6)], "team int, y double")
    alpha, mse = T.fit_quality_weight(spark.createDataFrame(rows, "team int, pf double, pa double, z double"), ["team"], "pf", "pa", "z", actual).first()
    assert abs(alpha - 0.12) < 0.01 and mse < 1e-6


def test_p_values(spark):
    for t, df, want in ((0.0, 5, 1.0), (2.570582, 5, 0.05), (2.228139, 10, 0.05), (12.7062, 1, 0.05), (3.169273, 10, 0.01), (1.959964, 10**6, 0.05)):
        assert M.student_p(t, df) == pytest.approx(want, abs=1e-5)
    r = M.linear_trend(spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 5.0), (4, 4.0), (5, None)], "x int, y double"), "x", "y").first()
    assert r["n"] == 4 and r["slope"] == pytest.approx(0.8) and r["p"] == pytest.approx(0.2, abs=1e-6)
    assert M.linear_trend(spark.createDataFrame([(1, 2.0)], "x int, y double"), "x", "y").first()["p"] is None


def test_two_passes_of_pruning(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=300), rng.normal(size=300)
    frame = spark.createDataFrame(pd.DataFrame({"prev_a": a + rng.normal(0, 0.2, 300), "a_avg": a, "b_avg": b, "prev_b": rng.normal(size=300), "a_copy": a * 2, "y": a}))
    cols, groups = ["prev_a", "a_avg", "b_avg", "prev_b", "a_copy"], [["prev_a", "a_avg"], ["prev_b", "b_avg"]]
    assert S.collapse_transforms(frame, cols, groups, "y") == ["a_avg", "b_avg", "prev_b", "a_copy"]
    assert S.prune_in_two_passes(frame, cols, groups, "y") == ["a_avg", "b_avg", "prev_b"]
