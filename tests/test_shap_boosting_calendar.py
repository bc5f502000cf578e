"""Shapley values against all subsets, boosted trees on held-out rows, and the season-and-week source against a local service."""

from __future__ import annotations

import http.server
import itertools
import json
import math
import threading
from collections import Counter
from urllib.parse import parse_qs, urlparse

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyspark.operators import boosting, models, shap
from tallyspark.sources import calendar


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(500, 3))
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0, 3, -1) * x[:, 2] + rng.normal(0, 0.3, 500)
    kind = np.array(["u", "v", "w"])[rng.integers(0, 3, 500)]
    f = pd.DataFrame(x, columns=["a", "b", "c"]).assign(kind=kind, y=y + (kind == "w"), label=(y > 0).astype(int), id=range(500))
    return spark.createDataFrame(f).repartition(3).cache()


def by_subsets(trees, weights, x):
    """The definition: the mean over all orders of what a column adds, a tree's value for a set of columns being its expectation along the paths."""
    n = x.shape[1]

    def value(row, known):
        total = 0.0
        for leaves, weight in zip(trees, weights, strict=True):
            for leaf in leaves:
                p = leaf.value * weight
                for c, lo, hi, share in zip(leaf.columns, leaf.low, leaf.high, leaf.share, strict=True):
                    p *= (lo < row[c] <= hi) if c in known else share
                total += p
        return total

    out = np.zeros(x.shape)
    for r, row in enumerate(x):
        for j in range(n):
            rest = [k for k in range(n) if k != j]
            for size in range(n):
                w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                for s in itertools.combinations(rest, size):
                    out[r, j] += w * (value(row, {*s, j}) - value(row, set(s)))
    return out


@pytest.mark.parametrize(("name", "classify"), [("random_forest", False), ("gradient_boosting", False), ("gradient_boosting", True), ("random_forest", True), ("decision_tree", True)])
def test_tree_values_are_exact(frame, name, classify):
    small = {"gradient_boosting": {"maxIter": 4, "maxDepth": 4}, "random_forest": {"numTrees": 4, "maxDepth": 6}, "decision_tree": {"maxDepth": 7}}[name]
    fitted = models.fit(frame, name, ["a", "b", "c"], "label" if classify else "y", classify, **small)
    model = fitted.stages[-1]
    own = fitted.transform(frame).orderBy("id")
    x = np.array([r[0] for r in own.select(vector_to_array("features")).collect()])
    explainer = shap.explainer_of(model, classify)
    got = explainer.explain(x)
    trees = list(model.trees) if hasattr(model, "trees") else [model]
    boosted = name == "gradient_boosting"
    leaves = [shap.leaves_of(t._java_obj.rootNode(), classify and not boosted) for t in trees]
    weights = list(model.treeWeights) if boosted else [1 / len(trees)] * len(trees)
    assert got[:12] == pytest.approx(by_subsets(leaves, weights, x[:12]), abs=1e-9)
    if not classify:
        want = [r[0] for r in own.select("prediction").collect()]
    elif boosted:
        want = [r[0] / 2 for r in own.select(vector_to_array("rawPrediction")[1] * 2).collect()]
    else:
        want = [r[0] for r in own.select(vector_to_array("probability")[1]).collect()]
    assert got.sum(1) + explainer.base == pytest.approx(want, abs=1e-8)
    leaf = max((x for t in leaves for x in t), key=lambda x: len(x.columns))
    meets = np.random.default_rng(1).integers(0, 2, (9, len(leaf.columns))).astype(float)
    big = shap.Explainer([[leaf]], [1.0], 3)
    big.leaves = [(leaf, None)]
    assert big.explain(x[:50]) == pytest.approx(shap.Explainer([[leaf]], [1.0], 3).explain(x[:50])) and shap.contributions_of(meets, leaf).shape == meets.shape


def test_values_by_column(frame):
    fitted = models.fit(frame, "random_forest", ["a", "b", "c"], "y", False, ["kind"], numTrees=6)
    rows = shap.shap_values(fitted, frame, ["a", "b", "c"], False, ["kind"])
    assert rows.columns == [*frame.columns, "base", "contributions"]
    both = {r["id"]: r["p"] for r in models.score(fitted, frame, False).collect()}
    for r in rows.collect():
        assert set(r["contributions"]) == {"a", "b", "c", "kind"} and sum(r["contributions"].values()) + r["base"] == pytest.approx(both[r["id"]])
    line = models.fit(frame, "ols", ["a", "b", "c"], "y", False)
    both = {r["id"]: r["p"] for r in models.score(line, frame, False).collect()}
    means = frame.agg(F.avg("a"), F.avg("y")).first()
    for r in shap.shap_values(line, frame, ["a", "b", "c"], False).collect():
        assert sum(r["contributions"].values()) + r["base"] == pytest.approx(both[r["id"]]) and r["base"] == pytest.approx(means[1])


def pinball(y, p, q):
    return float(np.mean(np.maximum(q * (y - p), (q - 1) * (y - p))))


@pytest.fixture(scope="module")
def spread(spark):
    rng = np.random.default_rng(22)
    x = rng.uniform(0, 10, (1200, 2))
    y = 2 * np.floor(x[:, 0]) + (1 + x[:, 0]) * rng.normal(size=1200)
    f = pd.DataFrame(x, columns=["a", "b"]).assign(y=y, label=(y > 10).astype(int), a=np.where(np.arange(1200) % 13 == 0, np.nan, x[:, 0]), fold=np.arange(1200) % 3)
    return spark.createDataFrame(f).repartition(3).cache()


@pytest.mark.parametrize("q", [0.1, 0.9])
def test_boosted_quantiles_out_of_fold(spread, q):
    model = boosting.fit_boosted(spread.where("fold < 2"), ["a", "b"], "y", "pinball", q, rounds=10, rate=0.4, depth=2)
    held = model.predict(spread.where("fold = 2")).toPandas()
    constant = spread.where("fold < 2").toPandas()["y"].quantile(q)
    assert pinball(held["y"], held["p"], q) < 0.95 * pinball(held["y"], constant, q)
    assert abs((held["y"] <= held["p"]).mean() - q) < 0.06


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_boosted_means_and_classes_out_of_fold(spread, loss):
    target = "y" if loss == "squared" else "label"
    model = boosting.fit_boosted(spread.where("fold < 2"), ["a", "b"], target, loss, rounds=12, rate=0.3)
    held = model.predict(spread.where("fold = 2")).toPandas()
    gap, base = held[target] - held["p"], held[target] - spread.where("fold < 2").toPandas()[target].mean()
    assert (gap**2).mean() < 0.7 * (base**2).mean() and (loss == "squared" or held["p"].between(0, 1).all())


def test_boosting_without_rows_or_variation(spark, spread):
    none = boosting.fit_boosted(spread.where("fold > 9"), ["a"], "y", rounds=1)
    assert {r["p"] for r in none.predict(spread).collect()} == {0.0}
    flat = boosting.fit_boosted(spread.withColumn("y", F.lit(4.0)).withColumn("b", F.lit(None).cast("double")), ["a", "b"], "y", rounds=2)
    assert {r["p"] for r in flat.predict(spread).collect()} == {4.0}


def test_one_tree_is_the_best_split(spark):
    rows = spark.createDataFrame([(float(k), float(k % 2), 10.0 * (k >= 30)) for k in range(100)], "x double, z double, y double")
    model = boosting.fit_boosted(rows, ["z", "x"], "y", rounds=1, depth=1, rate=1.0, penalty=0.0, bins=100)
    assert {round(r["p"], 6) for r in model.predict(rows).collect()} == {0.0, 10.0} and model.trees[0].column[0] == 1


GAMES = {(s, w): [{"id": s * 100 + w * 10 + k, "season": s, "week": w, "homeTeam": "A", "awayTeam": "B", "homePoints": 7 * k, "neutralSite": "true"} for k in range(w)] for s in (2023, 2024) for w in (1, 2, 3)}
LINES = [{"id": 5, "homeTeam": "A", "lines": [{"provider": "x", "spread": "-3.5"}, {"provider": "y", "spread": None, "id": 9}]}, {"id": 6, "homeTeam": "C", "lines": []}]


@pytest.fixture
def service():
    state = {"asked": Counter(), "calendar": [{"season": s, "week": w} for s, w in GAMES], "fail": {(2024, 2): 2}}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            q = {k: int(v[0]) for k, v in parse_qs(url.query).items()}
            slot = (q.get("year"), q.get("week"))
            state["asked"][url.path, slot] += 1
            if url.path == "/games" and state["fail"].get(slot, 0) > 0:
                state["fail"][slot] -= 1
                self.send_error(503)
                return
            body = {"/calendar": state["calendar"], "/games": GAMES.get(slot, []), "/lines": LINES, "/talent": [{"year": q.get("year"), "team": "A", "talent": 700}]}[url.path]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", state
    server.shutdown()


def read(spark, base, endpoint, **options):
    calendar.register(spark)
    return spark.read.format("season_weeks").options(endpoint=endpoint, base=base, wait="0.01", **options).load()


def test_slots_are_partitions_and_failures_are_retried(spark, service):
    base, state = service
    df = read(spark, base, "games", seasons="2023-2024", weeks="1-3")
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 6 and state["fail"] == {(2024, 2): 0}
    assert sorted(r["game_id"] for r in rows) == sorted(g["id"] for games in GAMES.values() for g in games)
    assert {(r["slot_season"], r["slot_week"]) for r in rows} == set(GAMES) and all(r["neutral_site"] and r["venue_id"] is None for r in rows)
    lines = sorted(map(tuple, read(spark, base, "lines", seasons="2023", weeks="1").select("game_id", "home_team", "provider", "spread").collect()))
    assert lines == [(5, "A", "x", -3.5), (5, "A", "y", None)]
    assert [tuple(r) for r in read(spark, base, "talent", seasons="2024").collect()] == [(2024, None, 2024, "A", 700.0)]
    state["fail"][2023, 1] = 99
    with pytest.raises(Exception, match="attempts failed"):
        read(spark, base, "games", seasons="2023", weeks="1", attempts="2").collect()
    for bad in ({"endpoint": "nothing", "seasons": "1", "weeks": "1"}, {"endpoint": "games", "seasons": "2023"}):
        with pytest.raises(Exception, match="options"):
            read(spark, base, **bad).collect()


def test_a_second_run_pulls_only_new_slots(spark, service, tmp_path):
    base, state = service
    calendar.register(spark)
    state["calendar"] = state["calendar"][:2]

    def run():
        stream = spark.readStream.format("season_weeks").options(endpoint="games", base=base, wait="0.01").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "t")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return spark.read.parquet(str(tmp_path / "t")).count(), {k[1]: n for k, n in state["asked"].items() if k[0] == "/games"}

    assert run() == (3, {(2023, 1): 1, (2023, 2): 1})
    assert run() == (3, {(2023, 1): 1, (2023, 2): 1})
    state["calendar"] = [{"season": s, "week": w} for s, w in GAMES][:3]
    assert run() == (6, {(2023, 1): 1, (2023, 2): 1, (2023, 3): 1})


def test_folder_and_schemas(spark, tmp_path):
    (tmp_path / "roster").mkdir()
    (tmp_path / "roster" / "2023.json").write_text(json.dumps([{"id": 1, "team": "A"}, {"id": "2", "position": "RB"}]))
    rows = read(spark, str(tmp_path), "roster", seasons="2023").collect()
    assert sorted(map(tuple, rows)) == [(2023, None, "1", "A", None), (2023, None, "2", None, "RB")]
    assert len(calendar.ENDPOINTS) == 10 and calendar.numbers("1-3,7, 2") == [1, 2, 3, 7]
    for name in calendar.ENDPOINTS:
        assert spark.createDataFrame([], calendar.schema_of(name)).columns[:2] == ["slot_season", "slot_week"]


def test_queries(spark):
    from tallyspark.plans import catalog

    r = catalog.QUERIES["boosted_quantiles"](spark, "/root/testdata/sf0.001").first()
    assert r["n"] > 100 and r["pinball"] < 1.1 * r["pinball_constant"] and 0.8 < r["covered"] <= 1
    rows = catalog.QUERIES["tree_contributions"](spark, "/root/testdata/sf0.001").collect()
    assert {r["column"] for r in rows} == {"score", "predicted", "x1", "x2"} and max(r["gap"] for r in rows) < 1e-5
