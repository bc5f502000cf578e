from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyspark.operators import checks, models
from tallyspark.sources import tables as S
from tallyspark.streaming import refresh as refreshing
from tallyspark.streaming.refresh import read_version, refresh

SF = "/root/testdata/sf0.001"


def test_csv_with_text_booleans(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,Covered,points\n1,TRUE,3.5\n2,false,\n3,maybe,1\n")
    df = S.read_csv(spark, str(tmp_path / "x.csv"), "id int, Covered string, points double", ("Covered",), {"Covered": "covered"})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, True, 3.5), (2, False, None), (3, None, 1.0)]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_partitions(spark.createDataFrame([(1, 2023), (2, 2024)], "x int, season int"), path, ["season"])
    S.write_partitions(spark.createDataFrame([(9, 2024)], "x int, season int"), path, ["season"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 2023), (9, 2024)]


def test_upsert_and_inserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, S.upsert(old, new, ["k"], [F.col("v").desc()]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, S.insert_missing(old, new.where("k = 3 or v = 'c'"), ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "e")]
    assert [tuple(r) for r in S.missing_slots(new.select("k").distinct(), old, ["k"]).collect()] == [(3,)]


def test_build_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert S.build_once(spark, str(tmp_path / "c"), {"a": 1}, build).count() == 3
    S.build_once(spark, str(tmp_path / "c"), {"a": 2}, build)
    assert len(calls) == 2


def test_retry_and_split():
    waits, tries = [], iter([ValueError, ValueError, None])

    def pull():
        if error := next(tries):
            raise error
        return "ok"

    assert S.with_retry(pull, base=10, sleep=waits.append) == "ok" and len(waits) == 2 and 20 <= waits[1] < 22.1

    def batch(slots):
        if len(slots) > 1:
            raise ValueError
        return slots

    assert S.pull_or_split(batch, [1, 2, 3]) == [1, 2, 3]
    with pytest.raises(ValueError):
        S.with_retry(lambda: batch([1, 2]), attempts=2, sleep=waits.append)


def test_payload(spark):
    df = spark.createDataFrame([(1, [("totalYards", "10"), ("firstDowns", "3")]), (2, [])], "game int, stats array<struct<category:string,stat:string>>")
    got = S.flatten_payload(df, ["game"], "stats", ["totalYards", "firstDowns"])
    assert got.columns == ["game", "total_yards", "first_downs"] and sorted(map(tuple, got.collect())) == [(1, "10", "3"), (2, None, None)]


SEASONS = "k int, season int, v int, seq int"


def weekly(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, SEASONS).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(SEASONS).parquet(str(tmp_path / name))


def test_weekly_refresh(spark, tmp_path):
    path, kept = str(tmp_path / "t"), lambda: sorted((r["k"], r["v"]) for r in read_version(spark, path, SEASONS).collect())
    run = lambda stream: refresh(stream, path, ["k"], ["season"], [F.col("seq").desc()], str(tmp_path / "ckpt")).awaitTermination()
    run(weekly(spark, tmp_path, "in", [(1, 2023, 10, 1), (2, 2024, 20, 1), (5, None, 5, 1)]))
    run(weekly(spark, tmp_path, "in", [(2, 2024, 30, 2), (2, 2024, 25, 1), (3, 2024, 40, 1)]))
    assert kept() == [(1, 10), (2, 30), (3, 40), (5, 5)]
    assert sorted(r["k"] for r in read_version(spark, path, SEASONS, ["season=2024"]).collect()) == [2, 3]


@pytest.mark.parametrize("where", ["write", "publish", "after"])
def test_a_refresh_that_fails_leaves_the_old_rows(spark, tmp_path, monkeypatch, where):
    path, kept = str(tmp_path / "t"), lambda: sorted((r["k"], r["v"]) for r in read_version(spark, path, SEASONS).collect())
    run = lambda stream: refresh(stream, path, ["k"], ["season"], [F.col("seq").desc()], str(tmp_path / "ckpt")).awaitTermination()
    run(weekly(spark, tmp_path, "in", [(1, 2024, 10, 1), (2, 2024, 20, 1)]))
    stream = weekly(spark, tmp_path, "in", [(2, 2024, 30, 2)])
    publish, upsert = refreshing._publish, refreshing.upsert

    def broken(*args):
        if where == "after":
            publish(*args)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if where == "write":  # some rows are written before a task fails
            m.setattr(refreshing, "upsert", lambda *a: upsert(*a).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v"))))
        else:
            m.setattr(refreshing, "_publish", broken)
        with pytest.raises(Exception, match="lost"):
            run(stream)
    assert kept() == ([(1, 10), (2, 30)] if where == "after" else [(1, 10), (2, 20)])
    run(stream)
    assert kept() == [(1, 10), (2, 30)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, k % 5, float(k % 17), float((k * 7) % 13) if k % 9 else None, "ab"[k % 2], 2.0 * (k % 17) + k % 3, int(k % 17 > 8)) for k in range(400)]
    return spark.createDataFrame(rows, "id int, season int, x1 double, x2 double, kind string, y double, label int").cache()


@pytest.mark.parametrize("name", ["logistic", "random_forest", "svm", "extra_trees"])
def test_classifiers_by_season(frame, name):
    oof = models.walk_forward(frame, "season", name, ["x1", "x2"], "label", True, [0, 1, 2, 3, 4], 3)
    assert {r[0] for r in oof.select("fold").distinct().collect()} == {3, 4} and oof.where("fold <> season").count() == 0
    assert oof.agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("int"))).first()[0] > 0.9


def test_regressors(frame, tmp_path):
    fitted = models.fit(frame, "ols", ["x1", "x2"], "y", False, ["kind"])
    out = models.score(fitted, frame, False)
    assert out.agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0] < 1
    fitted.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    assert models.score(PipelineModel.load(str(tmp_path / "m")), frame, False).count() == 400
    grid = [{"regParam": 1000.0}, {"regParam": 0.0}]
    assert models.tune(frame, "season", "ridge", grid, ["x1", "x2"], "y", [0, 1, 2], 1)[0] == {"regParam": 0.0}
    loss = lambda df: df.agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
    gain = models.permutation_importance(fitted, frame, ["x1", "x2"], "id", loss, False)
    assert gain["x1"] > 2 > gain["x2"]


def test_calibration_and_stacking(frame):
    oof = {n: models.walk_forward(frame, "season", n, ["x1", "x2"], "label", True, [0, 1, 2], 1) for n in ("logistic", "elastic_net")}
    both = models.stack(oof, ["id"], "label")
    assert both.columns == ["id", "label", "logistic", "elastic_net"] and both.count() == 160
    model = models.isotonic(both, "logistic", "label")
    assert list(model.predictions) == sorted(model.predictions)
    assert models.platt(both, "logistic", "label").coefficients[0] > 0


def test_entry_and_catalogue(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80


def test_selection_by_models(frame):
    assert models.embedded_selection(frame, "lasso", ["x1", "x2"], "y", False, 1) == ["x1"]
    assert models.recursive_elimination(frame, "ols", ["x1", "x2"], "y", False, 1) == ["x1"]
    rows = {r["column"]: r for r in models.coefficient_stability(frame, "season", "ols", ["x1", "x2"], "y", False, [0, 1, 2, 3], 2).collect()}
    assert rows["x1"]["sign_share"] == 1 and rows["x1"]["std"] < 0.1 * rows["x1"]["mean"]
    loss = {r["variant"]: r["loss"] for r in models.ablation(frame, "season", "ols", {"good": ["x1"], "bad": ["x2"]}, "y", False, [0, 1, 2], 1).collect()}
    assert loss["good"] < 1 < loss["bad"]


def test_partial_dependence(frame):
    fitted = models.fit(frame, "ols", ["x1", "x2"], "y", False)
    got = {r["value"]: r["mean_p"] for r in models.partial_dependence(fitted, frame, "x1", [0.0, 10.0], False).collect()}
    assert got[10.0] - got[0.0] == pytest.approx(20, abs=0.5)


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_quantile_regression(spark, q):
    rows = spark.range(2000).selectExpr("cast(id % 20 as double) x", "cast(3 * (id % 20) + (id div 20) % 100 as double) y")
    intercept, slopes = models.quantile_regression(rows, ["x"], "y", q)
    assert slopes["x"] == pytest.approx(3, abs=0.6) and intercept + 9.5 * slopes["x"] == pytest.approx(28.5 + 100 * q, abs=5)


def test_stacking_with_inner_folds(frame):
    out = models.stacked(frame, "season", {"l": "logistic", "f": "random_forest"}, "logistic", ["x1", "x2"], "label", [0, 1, 2, 3, 4], 3, ["id"])
    assert {r[0] for r in out.select("fold").distinct().collect()} == {3, 4} and out.where("fold <> season").count() == 0
    assert out.agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("int"))).first()[0] > 0.9


def test_selection_by_grid_and_learning_curve(frame):
    grid = [{"regParam": 5.0, "elasticNetParam": 1.0}, {"regParam": 0.01, "elasticNetParam": 0.5}]
    assert models.select_by_grid(frame, "season", "elastic_net", grid, ["x1", "x2"], "label", [0, 1, 2, 3], 2, 1) == ["x1"]
    curve = models.learning_curve(frame, "season", "ols", ["x1", "x2"], "y", False, [0, 1, 2, 3, 4], 4).orderBy("seasons").collect()
    assert [r["seasons"] for r in curve] == [1, 2, 3, 4] and all(0 < r["valid_loss"] < 2 for r in curve)


def test_calendar_pulls_reports_and_resumed_appends(spark, tmp_path):
    df = S.pull_calendar(spark, [2023, 2024], [1, 2, 3], lambda s, w: [(s * 10 + w, "x")] * w, "n int, v string")
    assert df.count() == 12 and df.where("n <> season * 10 + week").count() == 0
    path = str(tmp_path / "oof")
    S.append_missing(df.where("season = 2023"), path, ["season", "week"])
    assert S.append_missing(df, path, ["season", "week"]).count() == 12
    text = S.markdown(df.groupBy("season").count().orderBy("season"), "Rows")
    assert text.splitlines()[0] == "## Rows" and text.splitlines()[-1] == "| 2024 | 6 |"
    with pytest.raises(ValueError):
        S.markdown(df, "Rows", 3)
    S.write_csv(df.coalesce(1), str(tmp_path / "c"))
    S.write_json(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == 12
    assert S.run_query(spark, "SELECT :a + 1 AS x", {"a": 2}).first()["x"] == 3


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text('{"db": {"user": "${USER_X}", "port": 5}, "seasons": [2023, "${S}"]}')
    assert S.load_config(str(tmp_path / "c.json"), {"USER_X": "u", "S": "2024"}) == {"db": {"user": "u", "port": 5}, "seasons": [2023, "2024"]}
    with pytest.raises(ValueError, match="USER_X"):
        S.load_config(str(tmp_path / "c.json"), {"S": "1"})
    (tmp_path / "c.yaml").write_text("a: ${S}\nb: [1, 2]\n")
    assert S.load_config(str(tmp_path / "c.yaml"), {"S": "x"}) == {"a": "x", "b": [1, 2]}


def test_margins_as_probabilities_and_latest_models(spark, frame, tmp_path):
    df = frame.withColumn("margin", F.col("y") - 17)
    fitted = models.fit(df, "ols", ["x1", "x2"], "margin", False, ["kind"])
    for robust in (False, True):
        out = models.margin_probability(fitted, df.where("season < 4"), df, "margin", robust)
        assert out.where("(margin > 3 and p < 0.9) or (margin < -3 and p > 0.1) or p < 0 or p > 1").count() == 0
    for name, model in (("a-2023", "ridge"), ("a-2024", "ols"), ("b-2025", "lasso")):
        models.fit(df, model, ["x1", "x2"], "margin", False).write().save(str(tmp_path / name))
    want = models.fit(df, "ols", ["x1", "x2"], "margin", False).stages[-1].coefficients
    assert models.latest_model(spark, str(tmp_path), "a-").stages[-1].coefficients.toArray() == pytest.approx(want.toArray())
    with pytest.raises(FileNotFoundError):
        models.latest_model(spark, str(tmp_path), "z")
    assert models.tune(frame, "season", "elastic_net", [{"regParam": 5.0}, {"regParam": 0.0}], ["x1", "x2"], "label", [0, 1, 2], 1, True)[0] == {"regParam": 0.0}


def test_spread_of_coefficients_is_in_units_of_the_target(frame):
    """A linear fit from sums of products and a pipeline's fit give the same scaled coefficients."""
    rows = {r["column"]: r for r in models.coefficient_stability(frame, "season", "ols", ["x1", "x2"], "y", False, [0, 1, 2, 3], 2).collect()}
    fits = [models.coefficients(models.fit(frame.where(F.col("season").isin(t)), "ols", ["x1", "x2"], "y", False), ["x1", "x2"]) for t in ([0, 1], [0, 1, 2])]
    for c in ("x1", "x2"):
        # one divides by n, the other by n - 1
        assert rows[c]["mean"] == pytest.approx(sum(f[c] for f in fits) / 2, rel=0.02, abs=0.01)


def test_fan_out(spark):
    left, right = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int"), spark.createDataFrame([(1,), (2,), (2,), (2,), (9,), (None,)], "k int")
    got = checks.fan_out(left, right, ["k"]).first().asDict()
    joined = left.join(right, ["k"], "left").count()
    assert got == {"n_left": 5, "n_right": 6, "without": 2, "with_one": 2, "with_several": 1, "widest": 3, "n_joined": joined} and joined == 7
    none = left.limit(0)
    assert set(checks.fan_out(none, none, ["k"]).first()) == {0} and checks.fan_out(left, none, ["k"]).first()["without"] == 5


def test_scratch_folders_are_new_and_shared():
    session = lambda folder, master: SimpleNamespace(conf={"spark.checkpoint.dir": folder} if folder else {}, sparkContext=SimpleNamespace(master=master))
    cluster = session("hdfs://shared", "yarn")
    a, b = S.scratch(cluster, "x"), S.scratch(cluster, "x")
    assert a != b and a.startswith("hdfs://shared/x-")
    assert S.scratch(session(None, "local[4]"), "x").startswith("file:///")
    with pytest.raises(ValueError, match="checkpoint"):
        S.scratch(session(None, "spark://host:7077"), "x")
