"""Statistics, evaluation, ratings, validation and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import aggregates as A
from ..operators import boosting
from ..operators import checks as C
from ..operators import gram as G
from ..operators import metrics as M
from ..operators import models, shap
from ..operators import ratings as T
from ..operators import selection as S
from ..operators import windows as X
from ..operators.joins import stack_sides
from ..operators.quantiles import exact_quantiles
from ..sources.tables import table
from .common import GAMES, PREDICTIONS, games, predictions, rounded, year


def gini_by_group(spark, d):
    return rounded(A.gini(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal"))


GINI_BY_GROUP = """WITH r AS (SELECT c_nationkey, c_acctbal AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS i FROM customer WHERE c_acctbal >= 0)
SELECT c_nationkey, count(*) AS n, round(2 * sum(i * x) / nullif(count(*) * sum(x), 0) - (count(*) + 1) / count(*), 6) AS gini, round(stddev_samp(x) / nullif(avg(x), 0), 6) AS cv FROM r GROUP BY 1"""


def mode_by_group(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.mode("c_mktsegment", deterministic=True).alias("segment"), F.count_distinct("c_mktsegment").alias("segments"))


MODE_BY_GROUP = """WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), m AS (SELECT c_nationkey, c_mktsegment AS segment FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1)
SELECT m.*, count(n.c_mktsegment) AS segments FROM m JOIN n USING (c_nationkey) GROUP BY ALL"""


def bucket_width(spark, d):
    p = predictions(spark, d).withColumn("bucket", A.width_bucket("predicted", 5.0).cast("double"))
    return rounded(A.calibration(p, "bucket", "predicted", "actual"))


def bucket_quantile(spark, d):
    return rounded(A.calibration(A.quantile_buckets(predictions(spark, d), "score", 5), "bucket", "score", "label"))


_EDGES = "e AS (SELECT list_distinct(quantile_cont(score, [0.2, 0.4, 0.6, 0.8])) AS edges FROM pr), b AS (SELECT pr.*, CAST(len(list_filter(edges, lambda x: x < score)) AS INTEGER) AS bucket FROM pr, e)"
BUCKET_QUANTILE = f"WITH {PREDICTIONS}, {_EDGES} SELECT bucket, count(*) AS n, round(avg(score), 6) AS mean_predicted, round(avg(label), 6) AS mean_actual, round(avg(score) - avg(label), 6) AS gap FROM b GROUP BY 1"


def spearman(spark, d):
    return rounded(M.spearman(predictions(spark, d), ["event_type", "season"], "predicted", "actual"))


SPEARMAN = f"""WITH {PREDICTIONS}, r AS (SELECT *, rank() OVER (PARTITION BY event_type, season ORDER BY predicted) + (count(*) OVER (PARTITION BY event_type, season, predicted) - 1) / 2 AS a,
 rank() OVER (PARTITION BY event_type, season ORDER BY actual) + (count(*) OVER (PARTITION BY event_type, season, actual) - 1) / 2 AS b FROM pr)
SELECT event_type, season, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY ALL"""


def auc_rank_sum(spark, d):
    return rounded(M.ranking(predictions(spark, d), "label", "score"))


AUC_RANK_SUM = f"""WITH {PREDICTIONS}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM pr),
a AS (SELECT sum(label) AS p, sum(1 - label) AS n, (sum(k) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS auc FROM r),
s AS (SELECT score, sum(label) AS m, count(*) AS c FROM pr GROUP BY 1), t AS (SELECT m, sum(m) OVER w AS tp, sum(c) OVER w AS seen FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT CAST(any_value(p) AS BIGINT) AS n_pos, CAST(any_value(n) AS BIGINT) AS n_neg, round(any_value(auc), 6) AS auc, round(sum(m * tp / seen) / any_value(p), 6) AS average_precision FROM t, a"""


def regression_metrics(spark, d):
    out = M.regression(predictions(spark, d), ["event_type"], "actual", "predicted", 10.0)
    return rounded(out.withColumn("variance_aware", M.variance_aware(F.col("mae"), F.col("std_ratio"), 2.0)))


REGRESSION_METRICS = f"""WITH {PREDICTIONS}, m AS (SELECT event_type, count(*) AS n, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse, median(abs(predicted - actual)) AS median_ae, avg(predicted - actual) AS bias,
 avg(CAST(abs(predicted - actual) <= 10 AS INTEGER)) AS within, regr_slope(predicted, actual) AS slope, stddev_samp(predicted) AS std_predicted, stddev_samp(actual) AS std_actual, 1 - avg((predicted - actual) ** 2) / var_pop(actual) AS r2 FROM pr GROUP BY 1)
SELECT event_type, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(median_ae, 6) AS median_ae, round(bias, 6) AS bias, round(within, 6) AS within, round(slope, 6) AS slope, round(std_predicted, 6) AS std_predicted,
 round(std_actual, 6) AS std_actual, round(r2, 6) AS r2, round(std_predicted / std_actual, 6) AS std_ratio, round(mae + 2 * abs(1 - std_predicted / std_actual), 6) AS variance_aware FROM m"""


def classification_metrics(spark, d):
    return rounded(M.classification(predictions(spark, d), ["event_type", "season"], "label", "score", 0.3))


CLASSIFICATION_METRICS = f"""WITH {PREDICTIONS}, s AS (SELECT *, greatest(1e-15, least(1 - 1e-15, score)) AS q FROM pr), m AS (SELECT event_type, season, count(*) AS n, count_if(score >= 0.3) AS f, count_if(score >= 0.3 AND label = 1) AS tp, count_if(label = 1) AS p,
 avg(CAST((score >= 0.3) = (label = 1) AS INTEGER)) AS accuracy, -avg(CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END) AS log_loss, avg((score - label) ** 2) AS brier FROM s GROUP BY ALL)
SELECT event_type, season, n, CAST(f AS BIGINT) AS flagged, round(accuracy, 6) AS accuracy, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(f / n, 6) AS coverage, round(tp / nullif(f, 0), 6) AS precision, round(tp / nullif(p, 0), 6) AS recall FROM m"""

_THRESHOLDS = [0.05 * k for k in range(1, 19)]
_T = ", ".join(repr(t) for t in _THRESHOLDS)


def threshold_grid(spark, d):
    return rounded(M.threshold_grid(predictions(spark, d), ["season"], "label", "score", _THRESHOLDS))


THRESHOLD_GRID = f"""WITH {PREDICTIONS}, g AS (SELECT season, unnest([{_T}]) AS threshold, score, label FROM pr)
SELECT season, round(threshold, 6) AS threshold, count(*) AS n, CAST(count_if(score >= threshold) AS BIGINT) AS flagged, CAST(count_if(score >= threshold AND label = 1) AS BIGINT) AS hits,
 round(count_if(score >= threshold AND label = 1) / nullif(count_if(score >= threshold), 0), 6) AS precision, round(count_if(score >= threshold) / count(*), 6) AS coverage FROM g GROUP BY season, threshold"""


def best_threshold(spark, d):
    return M.best_threshold(threshold_grid(spark, d), ["season"], 0.1)


BEST_THRESHOLD = f"WITH grid AS ({THRESHOLD_GRID}) SELECT *, coverage >= 0.1 AS meets_floor FROM grid QUALIFY row_number() OVER (PARTITION BY season ORDER BY coverage >= 0.1 DESC, precision DESC NULLS LAST, threshold) = 1"


def residual_interval(spark, d):
    return rounded(M.residual_interval(predictions(spark, d), "actual", "predicted").select("event_id", "low", "high"))


RESIDUAL_INTERVAL = f"WITH {PREDICTIONS}, q AS (SELECT quantile_cont(actual - predicted, [0.1, 0.9]) AS q FROM pr) SELECT event_id, round(greatest(0, predicted + q[1]), 6) AS low, round(greatest(0, predicted + q[2]), 6) AS high FROM pr, q"


def bucket_lift(spark, d):
    """Hit rate of the top and the bottom quantile bucket, and the rank correlation of bucket and rate."""
    b = A.quantile_buckets(predictions(spark, d), "score", 5).groupBy("bucket").agg(F.avg("label").alias("rate"))
    out = M.spearman(b.withColumn("all", F.lit(1)), ["all"], "bucket", "rate").drop("all", "n")
    ends = b.agg((F.max_by("rate", "bucket") - F.min_by("rate", "bucket")).alias("lift"))
    return rounded(out.join(F.broadcast(ends)))


BUCKET_LIFT = f"""WITH {PREDICTIONS}, {_EDGES}, r AS (SELECT bucket, avg(label) AS rate FROM b GROUP BY 1), k AS (SELECT *, rank() OVER (ORDER BY bucket) AS a, rank() OVER (ORDER BY rate) AS c FROM r)
SELECT round(corr(a, c), 6) AS spearman, round(max_by(rate, bucket) - min_by(rate, bucket), 6) AS lift FROM k"""


def baselines(spark, d):
    """Each row against simple guesses, by type: the value before, the mean of the three before, the mean of the type, of its group, of the type in the season before, of
    its group in the season before and of all, and a least-squares plane through the seasons before; and how often the favourite and the majority are right."""
    p = X.windows_by_slices(predictions(spark, d).withColumn("grp", F.col("event_id") % 10), ["event_type"], "event_id", ["actual"], 3)
    p = p.withColumnsRenamed({"prev_actual": "previous", "actual_avg3": "rolling"}).drop("actual_avg_all")
    for name, keys, lag in (("type_mean", ["event_type"], 0), ("group_mean", ["grp"], 0), ("season_before", ["event_type", "season"], 1), ("group_season_before", ["grp", "season"], 1)):
        means = p.groupBy(*[(F.col(k) + lag).alias(k) if k == "season" else k for k in keys]).agg(F.avg("actual").alias(name))
        p = p.join(means, keys, "left")
    total = p.agg(F.avg("actual").alias("overall"))
    p = p.crossJoin(F.broadcast(total)).withColumn("x1", (F.col("event_id") % 7).cast("double"))
    lines = models.fold_lines(predictions(spark, d).withColumn("x1", (F.col("event_id") % 7).cast("double")), "season", [(0.0, 0.0)], [["predicted", "x1"]], "actual", [[0], [0, 1], [0, 1, 2], [0, 1, 2, 3]])[0][0]
    plane = F.when(F.lit(False), F.lit(0.0))
    for season, line in zip((1, 2, 3, 4), lines, strict=True):
        plane = plane.when(F.col("season") == season, line.predict())
    p = p.withColumn("plane", plane)
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("actual"))).alias(c)
    favourite, ones = F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int")), F.avg("label")
    names = ["previous", "rolling", "type_mean", "group_mean", "season_before", "group_season_before", "overall", "plane"]
    return rounded(p.groupBy("event_type").agg(*map(err, names), favourite.alias("favourite"), F.greatest(ones, 1 - ones).alias("majority")))


BASELINES = f"""WITH {PREDICTIONS}, q AS (SELECT *, event_id % 10 AS grp, CAST(event_id % 7 AS DOUBLE) AS x1 FROM pr), sb AS (SELECT event_type, season + 1 AS season, avg(actual) AS s FROM q GROUP BY ALL), gb AS (SELECT grp, season + 1 AS season, avg(actual) AS g FROM q GROUP BY ALL),
b AS (SELECT q.*, lag(actual) OVER w AS p, CASE WHEN count(actual) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN avg(actual) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS r3,
 avg(actual) OVER (PARTITION BY event_type) AS m, avg(actual) OVER (PARTITION BY grp) AS gm, (SELECT avg(actual) FROM pr) AS o FROM q WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
fd AS (SELECT unnest([1, 2, 3, 4]) AS fold), l AS (SELECT fold, avg(predicted) AS m1, avg(x1) AS m2, avg(actual) AS my, var_pop(predicted) AS v1, var_pop(x1) AS v2, covar_pop(predicted, x1) AS v12, covar_pop(predicted, actual) AS c1, covar_pop(x1, actual) AS c2
  FROM fd JOIN q ON season < fold GROUP BY fold), pl AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 ** 2) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 ** 2) AS b2 FROM l)
SELECT event_type, round(avg(abs(p - actual)), 6) AS previous, round(avg(abs(r3 - actual)), 6) AS rolling, round(avg(abs(m - actual)), 6) AS type_mean, round(avg(abs(gm - actual)), 6) AS group_mean, round(avg(abs(s - actual)), 6) AS season_before,
 round(avg(abs(g - actual)), 6) AS group_season_before, round(avg(abs(o - actual)), 6) AS overall, round(avg(abs(my + b1 * (predicted - m1) + b2 * (x1 - m2) - actual)), 6) AS plane,
 round(avg(CAST((score >= 0.5) = (label = 1) AS INTEGER)), 6) AS favourite, round(greatest(avg(label), 1 - avg(label)), 6) AS majority FROM b LEFT JOIN sb USING (event_type, season) LEFT JOIN gb USING (grp, season) LEFT JOIN pl ON fold = season GROUP BY 1"""


def pythagorean(spark, d):
    g = games(spark, d).groupBy("home", "season").agg(F.sum("home_points").alias("pf"), F.sum("away_points").alias("pa"), F.avg((F.col("home_points") > F.col("away_points")).cast("int")).alias("pct"))
    return rounded(g.withColumn("expected", E.pythagorean(F.col("pf"), F.col("pa"), 2.0)).withColumn("gap", F.col("pct") - F.col("expected")))


PYTHAGOREAN = f"""WITH {GAMES}, g AS (SELECT home, season, sum(home_points) AS pf, sum(away_points) AS pa, avg(CAST(home_points > away_points AS INTEGER)) AS pct FROM games GROUP BY ALL)
SELECT home, season, CAST(pf AS BIGINT) AS pf, CAST(pa AS BIGINT) AS pa, round(pct, 6) AS pct, round(pf ** 2.0 / nullif(pf ** 2.0 + pa ** 2.0, 0), 6) AS expected, round(pct - pf ** 2.0 / nullif(pf ** 2.0 + pa ** 2.0, 0), 6) AS gap FROM g"""


def fit_exponent_grid(spark, d):
    rows = pythagorean(spark, d).where("pf > 0")
    return rounded(T.fit_exponent(rows, "pf", "pa", "pct", rounds=1))


FIT_EXPONENT_GRID = f"""WITH p AS ({PYTHAGOREAN}), k AS (SELECT 0.5 + 5.5 * i / 20 AS k FROM range(21) AS t(i)), e AS (SELECT k, avg((pct - 1 / (1 + (pa / pf) ** k)) ** 2) AS mse FROM p, k WHERE pf > 0 GROUP BY 1)
SELECT round(k, 6) AS k, round(mse, 6) AS mse FROM e ORDER BY mse, k LIMIT 1"""


def _margins(spark, d):
    return T.team_margins(games(spark, d).withColumn("margin", (F.col("home_points") - F.col("away_points")).cast("double")), "season", "home", "away", "margin", "neutral")


_MARGINS = f"""{GAMES}, hfa AS (SELECT coalesce(avg(home_points - away_points) FILTER (WHERE NOT neutral), 0) AS h FROM games),
mg AS (SELECT season, home AS team, away AS opponent, home_points - away_points - CASE WHEN neutral THEN 0 ELSE h END AS margin FROM games, hfa
 UNION ALL SELECT season, away, home, away_points - home_points + CASE WHEN neutral THEN 0 ELSE h END FROM games, hfa)"""


def srs_unrolled(spark, d):
    return rounded(T.rate_by_joins(_margins(spark, d), "season", 3))


def srs_grouped(spark, d):
    return rounded(T.rate(_margins(spark, d), "season", 3))


def _srs_sql(passes, rows="mg", weight="1"):
    ctes, before = [], None
    for k in range(passes):
        add = " + coalesce(p.rating, 0)" if before else ""
        join = f" LEFT JOIN {before} p ON p.season = m.season AND p.team = m.opponent" if before else ""
        ctes += [f"a{k} AS (SELECT m.season, m.team, sum({weight} * (m.margin{add})) / sum({weight}) AS raw FROM {rows} m{join} GROUP BY ALL)",
                 f"r{k} AS (SELECT season, team, raw - avg(raw) OVER (PARTITION BY season) AS rating FROM a{k})"]
        before = f"r{k}"
    return f"{', '.join(ctes)} SELECT season, team, round(rating, 6) AS rating FROM {before}"


def phantom_prior(spark, d):
    rows = _margins(spark, d)
    priors = table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("team"), (F.col("n_nationkey").cast("double") - 10).alias("rating"))
    return rounded(T.rate(T.with_phantoms(rows, priors, "season", 5), "season", 4))


PHANTOM_PRIOR = f"""WITH {_MARGINS}, pri AS (SELECT n_nationkey AS team, n_nationkey - 10.0 AS rating FROM nation WHERE n_nationkey % 4 <> 0), t AS (SELECT DISTINCT season, team FROM mg),
mw AS (SELECT season, team, opponent, CAST(margin AS DOUBLE) AS margin, 1.0 AS wt FROM mg UNION ALL SELECT season, team, NULL, coalesce(rating, (SELECT avg(rating) FROM pri)), 5.0 FROM t LEFT JOIN pri USING (team)), {_srs_sql(4, 'mw', 'm.wt')}"""


def matchup_projection(spark, d):
    ratings = T.rate(_margins(spark, d), "season", 3)
    g = games(spark, d).select("game", "season", "home", "away")
    out = T.project_games(g, ratings, "home", "away", 2.5, 15.0, ["season"])
    return rounded(out.select("game", "expected_margin", "favourite", "home_probability"), 5)


MATCHUP_PROJECTION = f"""WITH r AS (WITH {_MARGINS}, {_srs_sql(3).replace('round(rating, 6) AS rating', 'rating')}), {GAMES}, g AS (SELECT game, home, away, h.rating - a.rating + 2.5 AS m FROM games LEFT JOIN r h ON h.team = home AND h.season = games.season LEFT JOIN r a ON a.team = away AND a.season = games.season),
z AS (SELECT *, abs(m / 15) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(m / 15) / sqrt(2)) AS t FROM g),
e AS (SELECT *, 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS erf FROM z)
SELECT game, round(m, 5) AS expected_margin, CASE WHEN m >= 0 THEN home ELSE away END AS favourite, round(CASE WHEN m >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END, 5) AS home_probability FROM e"""


def expected_wins(spark, d):
    g = games(spark, d).withColumn("p", E.elo_probability((F.col("home") * 20 + 1400).cast("double"), (F.col("away") * 20 + 1400).cast("double"))).withColumn("q", 1 - F.col("p"))
    rows = stack_sides(g, ["season"], {"team": "home", "p": "p"}, {"team": "away", "p": "q"})
    return rounded(rows.groupBy("season", "team").agg(F.sum("p").alias("wins"), F.count(F.lit(1)).alias("games")))


EXPECTED_WINS = f"""WITH {GAMES}, p AS (SELECT season, home, away, 1 / (1 + 10 ** ((away * 20.0 - home * 20.0) / 400)) AS p FROM games), s AS (SELECT season, home AS team, p FROM p UNION ALL SELECT season, away, 1 - p FROM p)
SELECT season, team, round(sum(p), 6) AS wins, count(*) AS games FROM s GROUP BY ALL"""


def dup_keys(spark, d):
    return C.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def coverage_rate(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), year("o_orderdate").alias("season"))
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return rounded(C.coverage(o, li, ["k"], ["season"]))


COVERAGE_RATE = """WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS slots, count(l_orderkey) AS matched, round(count(l_orderkey) / count(*), 6) AS rate
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1"""


def null_rate(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.select("event_type", F.when(F.col("k") > 20, F.col("k")).alias("k"), F.when(F.col("value") < 100, F.col("value")).alias("value"))
    return rounded(A.null_rates(e, ["event_type"], ["k", "value"]))


NULL_RATE = """SELECT event_type, round(avg(CAST(NOT CAST(json_extract_string(props, '$.k') AS INTEGER) > 20 AS INTEGER)), 6) AS k_null_rate, round(avg(CAST(NOT value < 100 AS INTEGER)), 6) AS value_null_rate FROM events GROUP BY 1"""


def shortened_period(spark, d):
    o = table(spark, d, "orders").select(year("o_orderdate").alias("season"))
    others = C.short_periods(o, "season", without_itself=True).select("season", F.col("median_n").alias("median_others"), F.col("is_short").alias("short_of_others"))
    return C.short_periods(o, "season").join(others, "season")


SHORTENED_PERIOD = """WITH n AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT median(n) AS median_n FROM n),
o AS (SELECT a.season, median(b.n) AS median_others FROM n a JOIN n b ON a.season <> b.season GROUP BY 1)
SELECT season, n, median_n, n < 0.6 * median_n AS is_short, median_others, n < 0.6 * median_others AS short_of_others FROM n JOIN o USING (season), m"""


def completeness_gate(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("value") < 70, F.col("value")).alias("value"))
    return rounded(C.incomplete(e, ["event_type"], "value"))


COMPLETENESS_GATE = "SELECT event_type, count(*) AS n, round(avg(CAST(NOT value < 70 AS INTEGER)), 6) AS null_rate, avg(CAST(NOT value < 70 AS INTEGER)) > 0.1 AS too_many FROM events GROUP BY 1"


def frame_diff(spark, d):
    """Customers against a copy that lacks some rows, has others, and differs in values and in what is known."""
    c = F.col
    a = table(spark, d, "customer").select("c_custkey", F.when(c("c_custkey") % 11 != 0, c("c_acctbal")).alias("c_acctbal"), "c_nationkey").where("c_custkey % 17 <> 3")
    b = table(spark, d, "customer").select("c_custkey", F.when(c("c_custkey") % 13 != 0, c("c_acctbal") + F.when(c("c_custkey") % 50 == 0, 1.0).otherwise(0.0)).alias("c_acctbal"), "c_nationkey").where("c_custkey % 19 <> 4")
    return rounded(C.frame_diff(a, b, ["c_custkey"], ["c_acctbal", "c_nationkey"], 0.05))


FRAME_DIFF = """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS x, c_nationkey AS y FROM customer WHERE c_custkey % 17 <> 3),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal + CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END END AS x, c_nationkey AS y FROM customer WHERE c_custkey % 19 <> 4),
l AS (SELECT count(*) AS n FROM a ANTI JOIN b USING (k)), r AS (SELECT count(*) AS n FROM b ANTI JOIN a USING (k)), m AS (SELECT k, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS bby FROM a JOIN b USING (k))
SELECT 'c_acctbal' AS "column", count(ax - bx) AS n_compared, CAST(count_if((ax IS NULL) <> (bx IS NULL)) AS BIGINT) AS n_one_known, round(max(abs(ax - bx)), 6) AS max_gap, round(avg(abs(ax - bx)), 6) AS mean_gap,
 CAST(count_if(abs(ax - bx) > 0.05) AS BIGINT) AS n_over, (SELECT n FROM l) AS only_left, (SELECT n FROM r) AS only_right FROM m
UNION ALL SELECT 'c_nationkey', count(ay - bby), 0, CAST(max(abs(ay - bby)) AS DOUBLE), avg(abs(ay - bby)), CAST(count_if(abs(ay - bby) > 0.05) AS BIGINT), (SELECT n FROM l), (SELECT n FROM r) FROM m"""


def bounds_check(spark, d):
    return C.out_of_bounds(table(spark, d, "lineitem"), {"l_discount": (0.0, 0.09), "l_quantity": (2.0, None), "l_tax": (None, None)})


BOUNDS_CHECK = """SELECT 'l_discount' AS "column", CAST(count_if(l_discount < 0 OR l_discount > 0.09) AS BIGINT) AS n FROM lineitem UNION ALL SELECT 'l_quantity', CAST(count_if(l_quantity < 2) AS BIGINT) FROM lineitem UNION ALL SELECT 'l_tax', 0"""


def favourite_check(spark, d):
    """How often clear favourites and toss-ups win, by an Elo probability."""
    g = games(spark, d).withColumn("p", E.elo_probability((F.col("home") * 20).cast("double"), (F.col("away") * 20).cast("double")))
    won = (F.col("home_points") > F.col("away_points")).cast("int")
    return rounded(g.groupBy(F.when(F.col("p") >= 0.7, "favourite").when(F.col("p") <= 0.3, "underdog").otherwise("toss-up").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg(won).alias("won"), F.avg("p").alias("expected")))


FAVOURITE_CHECK = f"""WITH {GAMES}, p AS (SELECT *, 1 / (1 + 10 ** ((away * 20.0 - home * 20.0) / 400)) AS p FROM games)
SELECT CASE WHEN p >= 0.7 THEN 'favourite' WHEN p <= 0.3 THEN 'underdog' ELSE 'toss-up' END AS kind, count(*) AS n, round(avg(CAST(home_points > away_points AS INTEGER)), 6) AS won, round(avg(p), 6) AS expected FROM p GROUP BY 1"""


def linear_trend(spark, d):
    n = table(spark, d, "orders").groupBy(year("o_orderdate").alias("season")).agg(F.avg("o_totalprice").alias("mean_price"))
    return rounded(M.linear_trend(n, "season", "mean_price"), 4)


# Student's distribution in closed form: with an odd number f of degrees, 1 - p is 2 / pi * (a + sin a * (cos a + 2/3 cos^3 a + ...)), tan a = t / sqrt(f); 7 seasons are 5 degrees
LINEAR_TREND = """WITH n AS (SELECT year(o_orderdate) AS season, avg(o_totalprice) AS m FROM orders GROUP BY 1), r AS (SELECT count(*) AS n, regr_slope(m, season) AS slope, regr_r2(m, season) AS r2 FROM n),
a AS (SELECT *, atan(sqrt(r2 / (1 - r2))) AS a FROM r)
SELECT n, round(slope, 4) AS slope, round(r2, 4) AS r2, CASE WHEN n = 7 THEN round(1 - 2 / pi() * (a + sin(a) * (cos(a) + cos(a) ** 3 * 2 / 3)), 4) END AS p FROM a"""


def srs_settled(spark, d):
    """Ratings of every season after 200 passes. SQL cannot follow so many; a test compares it with plain Python."""
    return rounded(T.rate(_margins(spark, d), "season"))


def fit_exponent(spark, d):
    """The exponent after three rounds of ever finer grids; a test compares it with a search in plain Python."""
    return rounded(T.fit_exponent(pythagorean(spark, d).where("pf > 0"), "pf", "pa", "pct"))


def correlation_pairs(spark, d):
    """Correlations of line item columns, each pair once."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    one = table(spark, d, "lineitem").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return rounded(one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr"))


CORRELATION_PAIRS = " UNION ALL ".join(f"SELECT '{a}|{b}' AS pair, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][:i])


def _features(spark, d):
    return predictions(spark, d).select("event_id", "season", "label", "actual", "score", "predicted", (F.col("event_id") % 7).cast("double").alias("x1"), F.when(F.col("event_id") % 9 != 0, F.col("predicted") * 2).alias("x2"))


def walk_forward_classifier(spark, d):
    oof = models.walk_forward(_features(spark, d), "season", "logistic", ["score", "predicted", "x1", "x2"], "label", True, [0, 1, 2, 3, 4], 2)
    return rounded(M.classification(oof, ["fold"], "label", "p").select("fold", "n", "accuracy", "brier"), 4)


def walk_forward_regressor(spark, d):
    """Each season by a line through the seasons before it."""
    oof = models.walk_forward(_features(spark, d), "season", "ols", ["predicted"], "actual", False, [0, 1, 2, 3, 4], 2)
    return rounded(M.regression(oof, ["fold"], "actual", "p").select("fold", "n", "mae", "rmse"), 4)


_FOLDS = f"WITH {PREDICTIONS}, fd AS (SELECT CAST(unnest([2, 3, 4]) AS INTEGER) AS fold), ft AS (SELECT *, CAST(event_id % 7 AS DOUBLE) AS x1 FROM pr)"
WALK_FORWARD_REGRESSOR = f"""{_FOLDS}, l AS (SELECT fold, regr_slope(actual, predicted) AS b, regr_intercept(actual, predicted) AS a FROM fd JOIN ft ON season < fold GROUP BY fold)
SELECT fold, count(*) AS n, round(avg(abs(a + b * predicted - actual)), 4) AS mae, round(sqrt(avg((a + b * predicted - actual) ** 2)), 4) AS rmse FROM l JOIN ft ON season = fold GROUP BY fold"""


def walk_forward_plane(spark, d):
    """Each season by least squares on two columns, and by a ridge on them: both from one scan."""
    rows, cuts = _features(spark, d), [[0, 1], [0, 1, 2], [0, 1, 2, 3]]
    lines = models.fold_lines(rows, "season", [(0.0, 0.0), (2.0, 0.0)], [["predicted", "x1"]], "actual", cuts)[0]
    found = [G.score_by_season(rows, "season", dict(zip([2, 3, 4], own, strict=True))).withColumn("model", F.lit(name)) for name, own in zip(("ols", "ridge"), lines, strict=True)]
    return rounded(M.regression(found[0].unionByName(found[1]), ["model", "fold"], "actual", "p").select("model", "fold", "n", "mae", "rmse"), 4)


# two columns by Cramer's rule; the ridge's penalty is in standard scores, over the deviation of the target
WALK_FORWARD_PLANE = f"""{_FOLDS}, m AS (SELECT fold, avg(predicted) AS m1, avg(x1) AS m2, avg(actual) AS my, var_pop(predicted) AS v1, var_pop(x1) AS v2, covar_pop(predicted, x1) AS v12,
  covar_pop(predicted, actual) AS c1, covar_pop(x1, actual) AS c2, stddev_pop(actual) AS sy FROM fd JOIN ft ON season < fold GROUP BY fold),
r AS (SELECT m.*, model, v1 * (1 + pen / sy) AS w1, v2 * (1 + pen / sy) AS w2 FROM m, (VALUES ('ols', 0.0), ('ridge', 2.0)) AS p(model, pen)),
b AS (SELECT *, (c1 * w2 - c2 * v12) / (w1 * w2 - v12 ** 2) AS b1, (c2 * w1 - c1 * v12) / (w1 * w2 - v12 ** 2) AS b2 FROM r),
e AS (SELECT model, fold, my + b1 * (predicted - m1) + b2 * (x1 - m2) - actual AS e FROM b JOIN ft ON season = fold)
SELECT model, fold, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse FROM e GROUP BY model, fold"""


def _with_nulls(spark, d):
    return _features(spark, d).withColumn("x3", F.when(F.col("event_id") % 9 == 0, F.col("score"))).select("score", "predicted", "x1", "x2", "x3", F.when(F.col("event_id") % 4 != 1, F.col("actual")).alias("actual"))


_NULLS = f"""WITH {PREDICTIONS}, ft AS (SELECT score, predicted, CAST(event_id % 7 AS DOUBLE) AS x1, CASE WHEN event_id % 9 <> 0 THEN predicted * 2 END AS x2, CASE WHEN event_id % 9 = 0 THEN score END AS x3,
 CASE WHEN event_id % 4 <> 1 THEN actual END AS actual FROM pr)"""
_CORR_COLS = ["score", "predicted", "x1", "x2", "x3", "actual"]


def _pairs_sql(source):
    return " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, count({a} + {b}) AS n, round(corr({a}, {b}), 6) AS corr FROM {source}" for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[:i])


def correlations_with_nulls(spark, d):
    """Every pair of columns over the rows that know both; two of the columns are never known together."""
    return rounded(S.correlation_pairs(_with_nulls(spark, d), _CORR_COLS))


def rank_correlations_with_nulls(spark, d):
    return rounded(S.correlation_pairs(_with_nulls(spark, d), _CORR_COLS, "spearman"))


CORRELATIONS_WITH_NULLS = f"{_NULLS} {_pairs_sql('ft')}"
_RANKS = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 END AS {c}" for c in _CORR_COLS)
RANK_CORRELATIONS_WITH_NULLS = f"{_NULLS}, rk AS (SELECT {_RANKS} FROM ft) {_pairs_sql('rk')}"


def inflation_factors(spark, d):
    """How much the other columns inflate each; a column and its double are infinite, written as null."""
    rows = _features(spark, d).withColumn("x3", F.col("score") + F.col("x1")).select("score", "predicted", "x1", "x3")
    found = S.variance_inflation(rows, ["score", "predicted", "x1"]) | {"x3": S.variance_inflation(rows, ["score", "predicted", "x1", "x3"])["x3"]}
    return rounded(spark.createDataFrame([(c, None if v == float("inf") else v) for c, v in found.items()], "column string, vif double"), 4)


# of three columns R^2 follows from their correlations
INFLATION_FACTORS = f"""WITH {PREDICTIONS}, ft AS (SELECT score, predicted, CAST(event_id % 7 AS DOUBLE) AS x1 FROM pr), c AS (SELECT corr(score, predicted) AS a, corr(score, x1) AS b, corr(predicted, x1) AS c FROM ft),
v AS (SELECT 1 - a * a - b * b - c * c + 2 * a * b * c AS det, a, b, c FROM c)
SELECT 'score' AS "column", round((1 - c * c) / det, 4) AS vif FROM v UNION ALL SELECT 'predicted', round((1 - b * b) / det, 4) FROM v UNION ALL SELECT 'x1', round((1 - a * a) / det, 4) FROM v UNION ALL SELECT 'x3', NULL"""


def pruned_features(spark, d):
    """Of two columns that go together the one less associated with the target goes; each pair over the rows that know both."""
    kept = S.prune_correlated(_with_nulls(spark, d), ["score", "predicted", "x1", "x2"], "actual")
    return spark.createDataFrame([(c,) for c in kept], "feature string")


PRUNED_FEATURES = f"""{_NULLS}, st AS (SELECT 'score' AS f, abs(corr(score, actual)) AS s FROM ft UNION ALL SELECT 'predicted', abs(corr(predicted, actual)) FROM ft UNION ALL SELECT 'x1', abs(corr(x1, actual)) FROM ft UNION ALL SELECT 'x2', abs(corr(x2, actual)) FROM ft),
pa AS (SELECT first AS f, second AS g, abs(corr) AS c FROM ({_pairs_sql('ft')})), far AS (SELECT f, g FROM pa WHERE c > 0.9 UNION ALL SELECT g, f FROM pa WHERE c > 0.9)
SELECT f AS feature FROM st WHERE NOT EXISTS (SELECT 1 FROM far JOIN st t ON t.f = far.g WHERE far.f = st.f AND t.s > st.s)"""


def boosted_quantiles(spark, d):
    """The 90 % quantile by boosted trees fitted on the first three seasons: its pinball loss and coverage on the last two, beside those of one number."""
    rows = _features(spark, d)
    train, held = rows.where("season < 3"), rows.where("season >= 3")
    model = boosting.fit_boosted(train, ["score", "predicted", "x1", "x2"], "actual", "pinball", 0.9, rounds=5, depth=2, rate=0.4)
    constant = exact_quantiles(train, [], "actual", [0.9], "q").select(F.col("q")[0].alias("constant"))
    scored = model.predict(held).crossJoin(F.broadcast(constant))
    loss = lambda c: F.avg(F.greatest(0.9 * (F.col("actual") - F.col(c)), 0.1 * (F.col(c) - F.col("actual"))))
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), loss("p").alias("pinball"), loss("constant").alias("pinball_constant"), F.avg((F.col("actual") <= F.col("p")).cast("int")).alias("covered")), 4)


def tree_contributions(spark, d):
    """Mean absolute contribution of each column to a forest's predictions of the last season, and how far contributions and base are from the prediction at most."""
    rows, cols = _features(spark, d), ["score", "predicted", "x1", "x2"]
    fitted = models.fit(rows.where("season < 4"), "random_forest", cols, "actual", False, numTrees=8, maxDepth=4)
    values = shap.shap_values(fitted, rows.where("season = 4"), cols, False)
    gap = values.join(models.score(fitted, rows.where("season = 4"), False).select("event_id", "p"), "event_id")
    gap = gap.select(F.abs(F.aggregate(F.map_values("contributions"), F.col("base"), lambda a, x: a + x) - F.col("p")).alias("gap")).agg(F.max("gap").alias("gap"))
    long = values.select(F.explode("contributions").alias("column", "x")).groupBy("column").agg(F.avg(F.abs("x")).alias("mean_size"), F.count(F.lit(1)).alias("n"))
    return rounded(long.crossJoin(F.broadcast(gap)), 6)


QUERIES = {
    "gini_by_group": gini_by_group, "mode_by_group": mode_by_group, "bucket_width": bucket_width, "bucket_quantile": bucket_quantile, "spearman": spearman, "auc_rank_sum": auc_rank_sum,
    "regression_metrics": regression_metrics, "classification_metrics": classification_metrics, "threshold_grid": threshold_grid, "best_threshold": best_threshold, "residual_interval": residual_interval,
    "bucket_lift": bucket_lift, "baselines": baselines, "pythagorean": pythagorean, "fit_exponent_grid": fit_exponent_grid, "srs_unrolled": srs_unrolled, "srs_grouped": srs_grouped,
    "phantom_prior": phantom_prior, "matchup_projection": matchup_projection, "expected_wins": expected_wins, "dup_keys": dup_keys, "coverage_rate": coverage_rate, "null_rate": null_rate,
    "shortened_period": shortened_period, "completeness_gate": completeness_gate, "frame_diff": frame_diff, "bounds_check": bounds_check, "favourite_check": favourite_check, "linear_trend": linear_trend,
    "correlation_pairs": correlation_pairs, "walk_forward_classifier": walk_forward_classifier, "walk_forward_regressor": walk_forward_regressor, "pruned_features": pruned_features,
    "walk_forward_plane": walk_forward_plane, "correlations_with_nulls": correlations_with_nulls, "rank_correlations_with_nulls": rank_correlations_with_nulls, "inflation_factors": inflation_factors,
    "boosted_quantiles": boosted_quantiles, "tree_contributions": tree_contributions,
    "srs_settled": srs_settled, "fit_exponent": fit_exponent,
}
ORACLES = {
    "gini_by_group": GINI_BY_GROUP, "mode_by_group": MODE_BY_GROUP,
    "bucket_width": f"WITH {PREDICTIONS} SELECT floor(predicted / 5) * 5 AS bucket, count(*) AS n, round(avg(predicted), 6) AS mean_predicted, round(avg(actual), 6) AS mean_actual, round(avg(predicted) - avg(actual), 6) AS gap FROM pr GROUP BY 1",
    "bucket_quantile": BUCKET_QUANTILE, "spearman": SPEARMAN, "auc_rank_sum": AUC_RANK_SUM, "regression_metrics": REGRESSION_METRICS, "classification_metrics": CLASSIFICATION_METRICS,
    "threshold_grid": THRESHOLD_GRID, "best_threshold": BEST_THRESHOLD, "residual_interval": RESIDUAL_INTERVAL, "bucket_lift": BUCKET_LIFT, "baselines": BASELINES, "pythagorean": PYTHAGOREAN,
    "fit_exponent_grid": FIT_EXPONENT_GRID, "srs_unrolled": f"WITH {_MARGINS}, {_srs_sql(3)}", "srs_grouped": f"WITH {_MARGINS}, {_srs_sql(3)}", "phantom_prior": PHANTOM_PRIOR,
    "matchup_projection": MATCHUP_PROJECTION, "expected_wins": EXPECTED_WINS,
    "dup_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", "coverage_rate": COVERAGE_RATE, "null_rate": NULL_RATE, "shortened_period": SHORTENED_PERIOD,
    "completeness_gate": COMPLETENESS_GATE, "frame_diff": FRAME_DIFF, "bounds_check": BOUNDS_CHECK, "favourite_check": FAVOURITE_CHECK, "linear_trend": LINEAR_TREND, "correlation_pairs": CORRELATION_PAIRS,
    "walk_forward_regressor": WALK_FORWARD_REGRESSOR, "walk_forward_plane": WALK_FORWARD_PLANE, "correlations_with_nulls": CORRELATIONS_WITH_NULLS, "rank_correlations_with_nulls": RANK_CORRELATIONS_WITH_NULLS,
    "inflation_factors": INFLATION_FACTORS, "pruned_features": PRUNED_FEATURES,
}
