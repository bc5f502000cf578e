"""Fits on sums of products against pyspark.ml and numpy; correlations, clusters and inflation on columns with nulls."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tallyspark.operators import gram, models
from tallyspark.operators import selection as S


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 4)) * [1, 10, 0.1, 1] + [0, 100, 5, 0]
    y = 3 + x @ [2, 0.5, -4, 0] + rng.normal(0, 2, 600)
    f = pd.DataFrame(x, columns=list("abcd")).assign(y=y, season=np.arange(600) % 6, id=np.arange(600), d=np.where(np.arange(600) % 7 == 0, np.nan, x[:, 3]), k=7.0)
    return spark.createDataFrame(f).withColumn("d", F.nanvl("d", F.lit(None).cast("double"))).repartition(4).cache()


@pytest.mark.parametrize(("reg", "l1"), [(0.0, 0.0), (2.0, 0.0), (1.0, 1.0), (0.5, 0.5)])
def test_same_coefficients_as_spark(frame, reg, l1):
    m = gram.moments(frame, "season", ["a", "b", "c"], "y")
    line = gram.fit_line(m, [0, 1, 2, 3], reg, l1)
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame.where("season < 4"))
    want = LinearRegression(featuresCol="features", labelCol="y", regParam=reg, elasticNetParam=l1, tol=1e-14, maxIter=10_000).fit(rows)
    assert line.coefs == pytest.approx(want.coefficients.toArray(), rel=1e-6, abs=1e-7)
    assert line.intercept == pytest.approx(want.intercept, rel=1e-6)
    got = frame.where("season = 5").select(line.predict().alias("p"), "y").toPandas()
    n, error = gram.squared_error(m, [5], line)
    assert n == 100 and error == pytest.approx(((got["p"] - got["y"]) ** 2).sum(), rel=1e-6)


def test_paths_and_constant_columns(frame):
    m = gram.moments(frame, "season", ["a", "b", "c", "k"], "y")
    regs = [0.01, 3.0, 1.0, 50.0]
    for reg, line in zip(regs, gram.penalty_path(m, range(6), regs, 1.0), strict=True):
        assert line.coefs == pytest.approx(gram.fit_line(m, range(6), reg, 1.0).coefs, abs=1e-8) and line.coefs[3] == 0
    assert not gram.penalty_path(m, range(6), [50.0], 1.0)[0].coefs.any()
    assert np.isnan(gram.fit_line(m, [99]).intercept)


def test_nulls_are_filled_by_fold(frame):
    oof = models.walk_forward(frame, "season", "ridge", ["a", "d"], "y", False, list(range(6)), 3)
    assert sorted(r[0] for r in oof.select("fold").distinct().collect()) == [3, 4, 5] and oof.count() == 300
    f = frame.toPandas()
    train = f[f.season < 4]
    med = train["d"].sort_values().dropna().to_numpy()
    med = med[int(np.ceil(len(med) / 2)) - 1]
    x = train[["a", "d"]].fillna(med).to_numpy()
    xs, ys = (x - x.mean(0)) / x.std(0), train["y"].to_numpy()
    w = np.linalg.solve(xs.T @ xs / len(xs) + np.eye(2) / ys.std(), xs.T @ (ys - ys.mean()) / len(xs) / ys.std()) * ys.std()
    valid = f[f.season == 4]
    want = dict(zip(valid["id"], ys.mean() + ((valid[["a", "d"]].fillna(med).to_numpy() - x.mean(0)) / x.std(0)) @ w, strict=True))
    got = {r["id"]: r["p"] for r in oof.where("fold = 4").collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_one_scan_for_all_folds_and_penalties(frame, spark):
    grid = [{"regParam": r} for r in (0.0, 1.0, 100.0)]
    best, error = models.tune(frame, "season", "ridge", grid, ["a", "b", "c"], "y", list(range(6)), 2)
    each = [models.walk_forward(frame, "season", "ridge", ["a", "b", "c"], "y", False, list(range(6)), 2, **g).agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0] for g in grid]
    assert error == pytest.approx(min(each)) and best == grid[int(np.argmin(each))]
    tracker, before = spark.sparkContext.statusTracker(), None
    spark.sparkContext.setJobGroup("gram", "one scan")
    models.fold_lines(frame, "season", [(r, 0.0) for r in (0.0, 1.0, 5.0)], [["a", "b"], ["a", "b", "c"]], "y", [[0], [0, 1], [0, 1, 2]])
    before = tracker.getJobIdsForGroup("gram")
    spark.sparkContext.setJobGroup("", "")
    assert len(before) <= 4  # a look at the first row, and the stages of one aggregate


def test_elimination_by_cross_validation(frame):
    kept, errors = models.cross_validated_elimination(frame, "season", "ols", ["a", "b", "c", "d"], "y", list(range(6)), 2)
    assert {"a", "b"} <= set(kept) and [k for k, _ in errors] == [1, 2, 3, 4] and errors[0][1] > errors[1][1]
    gain = models.permutation_importance(models.fit(frame, "ols", ["a", "b"], "y", False), frame, ["a", "b"], "id", lambda d: d.agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0], False, 3, True)
    assert gain["b"][0] > gain["a"][0] > 0 and 0 <= gain["b"][1] < gain["b"][0]


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_pairwise_correlations(spark, method):
    rng = np.random.default_rng(4)
    f = pd.DataFrame(rng.integers(0, 30, (400, 4)).astype(float), columns=list("abcd"))
    f["b"] += f["a"]
    f["never"], f["even"] = np.where(np.arange(400) % 2, 1e9 + f["a"], np.nan), np.where(np.arange(400) % 2, np.nan, f["b"])
    for k, c in enumerate("bcd"):
        f.loc[rng.random(400) < 0.2 + 0.1 * k, c] = np.nan
    df = spark.createDataFrame(f.astype(object).where(f.notna(), None), ", ".join(f"{c} double" for c in f)).repartition(3)
    ranked = f.rank() if method == "spearman" else f
    want = ranked.corr().fillna(0).to_numpy()
    np.fill_diagonal(want, 1)
    assert S.correlation_matrix(df, list(f), method) == pytest.approx(want, abs=1e-9)
    pairs = {(r["first"], r["second"]): (r["n"], r["corr"]) for r in S.correlation_pairs(df, list(f), method).collect()}
    assert pairs["even", "never"] == (0, None) and len(pairs) == 15


def test_counts_of_pairs_from_many_tasks(spark):
    """The rows that know both columns are counted to the last one, over however many tasks they are spread."""
    for rows in range(1000, 1012):
        df = spark.range(0, rows, 1, 11).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 7 != 3, F.col("id") % 10).cast("double").alias("b"))
        assert [r["n"] for r in S.correlation_pairs(df, ["a", "b"]).collect()] == [sum(i % 7 != 3 for i in range(rows))]


def by_all_pairs(similarity, limit):
    d = 1 - np.abs(similarity)
    clusters = {k: [k] for k in range(len(d))}
    while len(clusters) > 1:
        keys = list(clusters)
        gap, a, b = min((d[np.ix_(clusters[x], clusters[y])].mean(), x, y) for i, x in enumerate(keys) for y in keys[:i])
        if gap > limit:
            break
        clusters[b] += clusters.pop(a)
    return sorted(sorted(c) for c in clusters.values())


def test_chain_linkage_is_average_linkage():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 30):
        for limit in (0.05, 0.3, 0.6, 1.0):
            m = np.corrcoef(rng.normal(size=(n, 6)) + 2 * rng.normal(size=(1 + n // 4, 6)).repeat(4, 0)[:n]) if n > 1 else np.ones((1, 1))
            assert S.cluster_average_linkage(m, limit) == by_all_pairs(m, limit)
    base = rng.normal(size=(1000, 40)) + 3 * rng.normal(size=(100, 40)).repeat(10, 0)
    began = time.time()
    assert len(S.cluster_average_linkage(np.corrcoef(base), 0.3)) == 100
    assert time.time() - began < 5


def test_inflation_of_collinear_columns(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=200), rng.normal(size=200)
    f = pd.DataFrame({"a": a, "same": a, "b": b, "sum": 2 * a - b, "e": rng.normal(size=200), "k": 3.0, "near": a + rng.normal(0, 0.1, 200)})
    got = S.variance_inflation(spark.createDataFrame(f), list(f))
    assert got["a"] == got["same"] == got["b"] == got["sum"] == float("inf") and 1 <= got["e"] < 1.2 and got["k"] == 1 and got["near"] > 50
    own = S.variance_inflation(spark.createDataFrame(f), ["a", "near", "e"])
    x = np.column_stack([np.ones(200), f["near"], f["e"]])
    r2 = 1 - ((a - x @ np.linalg.lstsq(x, a, rcond=None)[0]) ** 2).sum() / ((a - a.mean()) ** 2).sum()
    assert own["a"] == pytest.approx(1 / (1 - r2), rel=1e-6)


def test_large_offsets_cost_no_digits(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 2)) + [1e8, -1e7]
    y = x @ [2.0, -3.0] + rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(y=y, s=1))
    centered = x - x.mean(0)
    want = np.linalg.lstsq(centered, y - y.mean(), rcond=None)[0]
    assert gram.fit_line(gram.moments(df, "s", ["a", "b"], "y"), [1]).coefs == pytest.approx(want, rel=1e-7)
    assert gram.pairwise_correlations(df, ["a", "b"])[0][0, 1] == pytest.approx(np.corrcoef(x.T)[0, 1], rel=1e-6)
