"""Tables written and read back, checks of joins, column names, and models whose results have a closed form."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import checks as C
from ..operators import metrics as M
from ..operators import models
from ..operators import selection as S
from ..operators.joins import one_to_one
from ..sources import tables as I
from ..sources.tables import table
from .common import GAMES, PREDICTIONS, games, predictions, rounded, year
from .evaluation import _features

SEASONS = [0, 1, 2, 3, 4]


def parameterised_scan(spark, d):
    """SQL with named parameters over a table."""
    table(spark, d, "orders").createOrReplaceTempView("scanned_orders")
    sql = "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM scanned_orders WHERE o_totalprice >= :least AND o_orderstatus = :status GROUP BY o_orderpriority"
    return I.run_query(spark, sql, {"least": 1000.0, "status": "F"})


PARAMETERISED_SCAN = "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus = 'F' GROUP BY 1"


def csv_cycle(spark, d):
    """Customers written as CSV, with booleans as text in several spellings, and read back under other names."""
    flag = F.when(F.col("c_acctbal") < 0, "true").when(F.col("c_acctbal") < 5000, "FALSE").when(F.col("c_acctbal") < 9000, "False").otherwise("n/a")
    path = I.scratch(spark, "customers")
    I.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", flag.alias("c_debtor")), path)
    back = I.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_debtor string", ("c_debtor",), {"c_custkey": "id", "c_name": "name", "c_debtor": "debtor"})
    return back.select("id", "name", "debtor")


CSV_CYCLE = "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN true WHEN c_acctbal < 9000 THEN false END AS debtor FROM customer"


def partition_cycle(spark, d):
    """Orders cached by season; the even seasons are pulled again at twice the price and replace their partitions, the others stay."""
    path = I.scratch(spark, "seasons")
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", year("o_orderdate").alias("season"))
    I.write_partitions(rows, path, ["season"])
    I.write_partitions(rows.where("season % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), path, ["season"])
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


PARTITION_CYCLE = "SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n, round(sum(CASE WHEN year(o_orderdate) % 2 = 0 THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1"


def resumed_append(spark, d):
    """A run that was broken off before the season of 1996 goes on: seasons that are there are not appended again."""
    path = I.scratch(spark, "resumed")
    rows = table(spark, d, "orders").groupBy(year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    I.append_missing(rows.where("season < 1996"), path, ["season"])
    return I.append_missing(rows.withColumn("n", F.when(F.col("season") < 1996, -1).otherwise(F.col("n"))), path, ["season"])


RESUMED_APPEND = "SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


def built_once(spark, d):
    """Two configurations, each asked for twice: the second asking reads what the first built, whatever its builder would have given."""
    path, parts = I.scratch(spark, "built"), []
    for status in ("F", "O"):
        wanted = table(spark, d, "orders").where(F.col("o_orderstatus") == status).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
        for build in (lambda w=wanted: w, lambda w=wanted: w.withColumn("n", F.lit(-1).cast("long"))):
            found = I.build_once(spark, path, {"status": status}, build)
        parts.append(found)
    return parts[0].unionByName(parts[1])


BUILT_ONCE = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1"


_EXPANDED = E.expand_names(["points"])


def expanded_names(spark, d):
    """A home and an away statistic under all their transforms as one wide table, and each column by the parts of its name; the family of last
    weeks is dropped from the count of columns that are left."""
    wide = games(spark, d).select("game", "season", "week", "home", "away", "home_points", "away_points")
    for side in ("home", "away"):
        w = W.partitionBy(side, "season").orderBy("week", "game")
        x = F.col(f"{side}_points")
        wide = wide.withColumns({
            f"{side}_prev_week_points": F.lag(x).over(w), f"{side}_points_avg_all": F.avg(x).over(w.rowsBetween(W.unboundedPreceding, -1)), f"{side}_points_avg3": F.avg(x).over(w.rowsBetween(-3, -1)),
        })
    wide = wide.select("game", *[F.col(c).cast("double").alias(c) for c in _EXPANDED])
    parts = {c: E.parse_name(c) for c in _EXPANDED}
    family = {c: len(group) for group in E.transform_groups(_EXPANDED).values() for c in group.values()}
    named = lambda f: F.create_map(*[x for c in _EXPANDED for x in (F.lit(c), F.lit(f(c)))])[F.col("name")]
    long = wide.unpivot(["game"], _EXPANDED, "name", "x").groupBy("name").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    return rounded(long.select("name", *[named(lambda c, k=k: parts[c][k]).alias(a) for k, a in enumerate(("side", "transform", "statistic"))], named(lambda c: family[c]).alias("family_size"), "n", "mean"))


def _expanded_sql() -> str:
    w = "OVER (PARTITION BY {s}, season ORDER BY week, game {f})"
    cells = []
    for s in ("home", "away"):
        so_far, three = w.format(s=s, f="ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"), w.format(s=s, f="ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING")
        cells += [(f"{s}_prev_week_points", s, "prev_week", f"lag({s}_points) {w.format(s=s, f='')}"), (f"{s}_points_avg_all", s, "avg_all", f"avg({s}_points) {so_far}"), (f"{s}_points_avg3", s, "avg3", f"avg({s}_points) {three}")]
    each = " UNION ALL ".join(f"SELECT '{n}' AS name, '{s}' AS side, '{t}' AS transform, {x} AS x FROM games" for n, s, t, x in cells)
    return f"WITH {GAMES}, l AS ({each}) SELECT name, side, transform, 'points' AS statistic, 3 AS family_size, count(x) AS n, round(avg(x), 6) AS mean FROM l GROUP BY ALL"


def validated_merge(spark, d):
    """Totals of the lines of an order beside the order itself: a merge that must be one to one and keep the number of rows."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("extended"))
    merged = one_to_one(lines, table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), "o_orderstatus"), ["order_key"])
    C.same_count(lines, merged, "orders beside their lines")
    return merged


VALIDATED_MERGE = "SELECT l_orderkey AS order_key, count(*) AS lines, round(sum(l_extendedprice), 2) AS extended, any_value(o_orderstatus) AS o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"


def fan_out(spark, d):
    return C.fan_out(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_custkey").alias("key")), ["key"])


FAN_OUT = """WITH j AS (SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT count(*) AS n_left, (SELECT count(*) FROM orders) AS n_right, count(*) FILTER (WHERE n = 0) AS without, count(*) FILTER (WHERE n = 1) AS with_one, count(*) FILTER (WHERE n > 1) AS with_several, max(n) AS widest,
 (SELECT count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey) AS n_joined FROM j"""


def fold_plan(spark, d):
    """Every fold of the walk-forward: what it trains on and where its inner folds begin; the last season is held out."""
    by = predictions(spark, d).groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    cuts = M.folds(SEASONS, 1, holdout=SEASONS[-1])
    plan = spark.createDataFrame([(v, t, t[min(M.inner_seasons(len(t), 2), len(t) - 1)]) for t, v in cuts], "fold int, train array<int>, inner_first int")
    rows = by.join(F.broadcast(plan), F.array_contains("train", F.col("season")) | (F.col("season") == F.col("fold")))
    own = F.col("season") != F.col("fold")
    return rows.groupBy("fold", "inner_first").agg(F.count_if(own).alias("train_seasons"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n_train"), F.sum(F.when(~own, F.col("n")).otherwise(0)).alias("n_valid"))


FOLD_PLAN = f"""WITH {PREDICTIONS}, s AS (SELECT season, count(*) AS n FROM pr GROUP BY 1)
SELECT v.season AS fold, CAST(least(2, v.season - 1) AS INTEGER) AS inner_first, count(t.season) AS train_seasons, CAST(sum(t.n) AS BIGINT) AS n_train, any_value(v.n) AS n_valid FROM s v JOIN s t ON t.season < v.season WHERE v.season BETWEEN 1 AND 3 GROUP BY v.season"""


def prepared_features(spark, d):
    """Medians for nulls, standard scores and one-hot columns, learned before the last season and applied to it."""
    rows = predictions(spark, d).select("event_id", "season", "event_type", F.when(F.col("event_id") % 9 != 0, (F.col("event_id") % 7).cast("double")).alias("x"))
    stages = models.Pipeline(stages=models.preprocessing(["x"], ["event_type"])).fit(rows.where("season < 4"))
    cells = models.vector_to_array("features")
    out = stages.transform(rows.where("season = 4")).select("event_id", cells[0].alias("z"), (F.array_position(F.slice(cells, 2, 100), 1.0)).cast("int").alias("kind"), (F.size(cells) - 1).alias("kinds"))
    return rounded(out)


PREPARED_FEATURES = f"""WITH {PREDICTIONS}, r AS (SELECT event_id, season, event_type, CASE WHEN event_id % 9 <> 0 THEN CAST(event_id % 7 AS DOUBLE) END AS x FROM pr),
m AS (SELECT quantile_disc(x, 0.5) AS med FROM r WHERE season < 4), s AS (SELECT avg(coalesce(x, med)) AS mean, stddev_samp(coalesce(x, med)) AS sd FROM r, m WHERE season < 4),
k AS (SELECT event_type, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS kind FROM r WHERE season < 4 GROUP BY 1)
SELECT event_id, round((coalesce(x, med) - mean) / sd, 6) + 0.0 AS z, kind, CAST((SELECT count(*) FROM k) AS INTEGER) AS kinds FROM r JOIN k USING (event_type), m, s WHERE season = 4"""


def saturated_classifier(spark, d):
    """Out-of-fold probabilities from one column of two values, where a logistic regression ends at the rates of the training seasons."""
    rows = predictions(spark, d).select("season", "label", (F.col("score") >= 0.1).cast("double").alias("high"))
    oof = models.walk_forward(rows, "season", "logistic", ["high"], "label", True, SEASONS, 2)
    return rounded(oof.groupBy("fold", "high").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p")), 3)


SATURATED_CLASSIFIER = f"""WITH {PREDICTIONS}, r AS (SELECT season, label, CAST(score >= 0.1 AS DOUBLE) AS high FROM pr),
f AS (SELECT v.season AS fold, t.high, avg(t.label) AS p FROM (SELECT DISTINCT season FROM r WHERE season >= 2) v JOIN r t ON t.season < v.season GROUP BY ALL)
SELECT fold, r.high, count(*) AS n, round(any_value(p), 3) AS p FROM r JOIN f ON r.season = f.fold AND r.high = f.high GROUP BY ALL"""


def calibrated(spark, d):
    """A monotone map from scores to rates of the label, fitted on one weighted row for each score."""
    by = predictions(spark, d).groupBy("score").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("label").alias("rate"))
    fitted = models.isotonic(by, "score", "rate", "n")
    return rounded(fitted.transform(models.VectorAssembler(inputCols=["score"], outputCol="features").transform(by)).select("score", "n", "rate", F.col("prediction").alias("p")))


# the value of a monotone fit: the highest over all starts of the lowest mean over all ends
CALIBRATED = f"""WITH {PREDICTIONS}, g AS (SELECT score, CAST(count(*) AS DOUBLE) AS n, avg(label) AS rate, sum(label) AS hits FROM pr GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY score) AS cn, sum(hits) OVER (ORDER BY score) AS ch FROM g),
s AS (SELECT x.score, a.score AS lo, min((b.ch - a.ch + a.hits) / (b.cn - a.cn + a.n)) AS least FROM c x JOIN c a ON a.score <= x.score JOIN c b ON b.score >= x.score GROUP BY ALL)
SELECT score, any_value(n) AS n, round(any_value(rate), 6) AS rate, round(max(least), 6) AS p FROM s JOIN g USING (score) GROUP BY score"""


def latest_model_scores(spark, d):
    """Two lines are saved under dated names; the later one is loaded again, scores the last season and is read off at three values."""
    rows, folder = _features(spark, d), I.scratch(spark, "models")
    for name, until in (("line_20240101", 2), ("line_20240201", 4)):
        models.fit(rows.where(F.col("season") < until), "ols", ["predicted"], "actual", False).write().save(f"{folder}/{name}")
    loaded, held = models.latest_model(spark, folder, "line_"), rows.where("season = 4")
    scored = models.score(loaded, held, False).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.abs(F.col("p") - F.col("actual"))).alias("mae"))
    return rounded(models.partial_dependence(loaded, held, "predicted", [5.0, 20.0, 35.0], False).withColumnRenamed("mean_p", "at_value").crossJoin(F.broadcast(scored)), 4)


LATEST_MODEL_SCORES = f"""WITH {PREDICTIONS}, f AS (SELECT regr_slope(actual, predicted) AS b, regr_intercept(actual, predicted) AS a FROM pr WHERE season < 4),
s AS (SELECT count(*) AS n, avg(a + b * predicted) AS mean_p, avg(abs(a + b * predicted - actual)) AS mae FROM pr, f WHERE season = 4)
SELECT value, round(a + b * value, 4) AS at_value, n, round(mean_p, 4) AS mean_p, round(mae, 4) AS mae FROM (VALUES (5.0::DOUBLE), (20.0), (35.0)) v(value), f, s"""


_COLUMNS = ["predicted", "score", "x1"]
_FT = f"WITH {PREDICTIONS}, ft AS (SELECT event_id, season, label, actual, score, predicted, CAST(event_id % 7 AS DOUBLE) AS x1 FROM pr)"
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variant, season, actual, {c} AS x FROM ft" for c in _COLUMNS) + ")"


def ablation_lines(spark, d):
    """Pooled out-of-fold absolute error of each column on its own."""
    return rounded(models.ablation(_features(spark, d), "season", "ols", {c: [c] for c in _COLUMNS}, "actual", False, SEASONS, 2), 4)


ABLATION_LINES = f"""{_FT}, {_LONG}, f AS (SELECT v.season AS fold, t.variant, regr_slope(t.actual, t.x) AS b, regr_intercept(t.actual, t.x) AS a FROM (SELECT DISTINCT season FROM l WHERE season >= 2) v JOIN l t ON t.season < v.season GROUP BY ALL)
SELECT variant, count(*) AS n, round(avg(abs(a + b * x - actual)), 4) AS loss FROM l JOIN f USING (variant) WHERE season = fold GROUP BY 1"""


def learning_curve_line(spark, d):
    return rounded(models.learning_curve(_features(spark, d), "season", "ols", ["score"], "actual", False, SEASONS, 4), 4)


LEARNING_CURVE_LINE = f"""{_FT}, k AS (SELECT CAST(range AS INTEGER) AS seasons FROM range(1, 5)), f AS (SELECT seasons, regr_slope(actual, score) AS b, regr_intercept(actual, score) AS a FROM k JOIN ft ON season BETWEEN 4 - seasons AND 3 GROUP BY 1)
SELECT seasons, round(avg(abs(a + b * score - actual)) FILTER (WHERE season < 4), 4) AS train_loss, round(avg(abs(a + b * score - actual)) FILTER (WHERE season = 4), 4) AS valid_loss FROM f JOIN ft ON season BETWEEN 4 - seasons AND 4 GROUP BY 1"""


def coefficient_spread(spark, d):
    """A coefficient of standard scores over the folds, one column at a time."""
    parts = [models.coefficient_stability(_features(spark, d), "season", "ols", [c], "actual", False, SEASONS, 1) for c in _COLUMNS]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 4)


COEFFICIENT_SPREAD = f"""{_FT}, {_LONG}, f AS (SELECT v.season, t.variant, regr_slope(t.actual, t.x) * stddev_pop(t.x) AS b FROM (SELECT DISTINCT season FROM l WHERE season >= 1) v JOIN l t ON t.season < v.season GROUP BY ALL)
SELECT variant AS "column", round(avg(b), 4) AS mean, round(stddev_pop(b), 4) AS std, greatest(avg(CAST(b > 0 AS INTEGER)), avg(CAST(b < 0 AS INTEGER))) AS sign_share FROM f GROUP BY 1"""


_PENALTIES = [0.1, 10.0, 1000.0]


def tuned_ridge(spark, d):
    """The penalty of least pooled error, and that error."""
    best, error = models.tune(_features(spark, d), "season", "ridge", [{"regParam": p} for p in _PENALTIES], ["score"], "actual", SEASONS, 2)
    return rounded(spark.createDataFrame([(best["regParam"], error)], "penalty double, error double"), 4)


# with one column a ridge shrinks the slope by 1 + penalty / deviation of the target
TUNED_RIDGE = f"""{_FT}, p(penalty) AS (VALUES {', '.join(f'({p}::DOUBLE)' for p in _PENALTIES)}),
f AS (SELECT v.season AS fold, penalty, regr_slope(t.actual, t.score) / (1 + penalty / stddev_pop(t.actual)) AS b, avg(t.actual) AS my, avg(t.score) AS mx FROM (SELECT DISTINCT season FROM ft WHERE season >= 2) v JOIN ft t ON t.season < v.season, p GROUP BY v.season, penalty)
SELECT penalty, round(avg(abs(my + b * (score - mx) - actual)), 4) AS error FROM ft JOIN f ON season = fold GROUP BY 1 ORDER BY avg(abs(my + b * (score - mx) - actual)) LIMIT 1"""


def family_components(spark, d):
    """Two columns of a family as principal components of their standard scores, and the variance of each."""
    rows = _features(spark, d).select("predicted", (F.col("predicted") / 10 + F.col("x1")).alias("mixed"))
    out = S.principal_components(rows, ["predicted", "mixed"], 0.9999).select(models.vector_to_array("components").alias("c"))
    long = out.select(F.posexplode("c").alias("component", "x"))
    return rounded(long.groupBy("component").agg(F.var_samp("x").alias("variance"), F.count(F.lit(1)).alias("n")), 5)


FAMILY_COMPONENTS = f"""{_FT}, r AS (SELECT corr(predicted, predicted / 10 + x1) AS r, count(*) AS n FROM ft)
SELECT 0 AS component, round(1 + abs(r), 5) AS variance, n FROM r UNION ALL SELECT 1, round(1 - abs(r), 5), n FROM r"""

ORACLES = {
    "parameterised_scan": PARAMETERISED_SCAN, "csv_cycle": CSV_CYCLE, "partition_cycle": PARTITION_CYCLE, "resumed_append": RESUMED_APPEND, "built_once": BUILT_ONCE, "expanded_names": _expanded_sql(),
    "validated_merge": VALIDATED_MERGE, "fan_out": FAN_OUT, "fold_plan": FOLD_PLAN, "prepared_features": PREPARED_FEATURES, "saturated_classifier": SATURATED_CLASSIFIER, "calibrated": CALIBRATED,
    "latest_model_scores": LATEST_MODEL_SCORES, "ablation_lines": ABLATION_LINES, "learning_curve_line": LEARNING_CURVE_LINE, "coefficient_spread": COEFFICIENT_SPREAD, "tuned_ridge": TUNED_RIDGE,
    "family_components": FAMILY_COMPONENTS,
}
QUERIES = {name: globals()[name] for name in ORACLES}
