"""Evaluation of predictions. Ordered measures count equal scores first and are summed over slices of the score's range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from .quantiles import exact_quantiles
from .windows import average_ranks, interval, sliced


def regression(df: DataFrame, by: list[str], y: str, p: str, within: float = 1.0) -> DataFrame:
    """n, mae, rmse, median absolute error, r2 (1 - residual / total variation), bias, share within a distance."""
    e = F.col(p) - F.col(y)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.avg((F.abs(e) <= within).cast("int")).alias("within"), F.avg(e * e).alias("__mse"), F.var_pop(y).alias("__var"),
        F.regr_slope(p, y).alias("slope"), F.stddev_samp(p).alias("std_predicted"), F.stddev_samp(y).alias("std_actual"),
    )
    median = exact_quantiles(df.select(*by, F.abs(e).alias("__e")), by, "__e", [0.5], "__q").select(*by, F.col("__q")[0].alias("median_ae"))
    out = out.join(median, by, "left") if by else out.join(F.broadcast(median), how="left")
    return out.withColumn("r2", 1 - safe_div(F.col("__mse"), F.col("__var"))).withColumn("std_ratio", safe_div(F.col("std_predicted"), F.col("std_actual"))).drop("__mse", "__var")


def variance_aware(mae: Column, std_ratio: Column, penalty: float) -> Column:
    return mae + penalty * F.abs(1 - std_ratio)


def classification(df: DataFrame, by: list[str], y: str, p: str, threshold: float = 0.5, eps: float = 1e-15) -> DataFrame:
    """n, flagged, coverage, precision, recall, accuracy, log loss, Brier score."""
    hit, said, safe = F.col(y) == 1, F.col(p) >= threshold, F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(said).alias("flagged"), F.count_if(said & hit).alias("__tp"), F.count_if(hit).alias("__p"),
        F.avg((said == hit).cast("int")).alias("accuracy"), (-F.avg(F.when(hit, F.ln(safe)).otherwise(F.ln(1 - safe)))).alias("log_loss"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
    )
    rates = {"coverage": safe_div(F.col("flagged"), F.col("n")), "precision": safe_div(F.col("__tp"), F.col("flagged")), "recall": safe_div(F.col("__tp"), F.col("__p"))}
    return out.withColumns(rates).drop("__tp", "__p")


def cumulative_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, pos, neg, pos_above, neg_above) for each different score: how many rows score higher.

    Scores are cut into slices at approximate quantiles; slices are summed up on their own, then within, so no task holds all.
    """
    counts = sliced(df.groupBy(score).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")), score)
    above = W.orderBy(F.col("__slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    slices = counts.groupBy("__slice").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    slices = slices.select("__slice", F.coalesce(F.sum("__p").over(above), F.lit(0)).alias("__p"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__n"))
    w = W.partitionBy("__slice").orderBy(F.col(score).desc()).rowsBetween(W.unboundedPreceding, -1)
    both = counts.join(F.broadcast(slices), "__slice")
    totals = {f"{c}_above": F.col(f"__{c[0]}") + F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("pos", "neg")}
    return both.withColumns(totals).select(score, "pos", "neg", "pos_above", "neg_above")


def ranking(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: AUC (ties count half) and average precision."""
    c = cumulative_counts(df, y, score)
    tp, seen = F.col("pos_above") + F.col("pos"), F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")
    won = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    out = c.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("__won"), F.sum(F.col("pos") * tp / seen).alias("__ap"))
    return out.select("n_pos", "n_neg", safe_div(F.col("__won"), F.col("n_pos") * F.col("n_neg")).alias("auc"), safe_div(F.col("__ap"), F.col("n_pos")).alias("average_precision"))


def at_least(cells: DataFrame, by: list[str], thresholds: list[float], sums: list[str]) -> DataFrame:
    """(by, threshold, sums): for each threshold, in rising order, the sums over cells whose ``__reached`` (how many thresholds they reach) includes it.

    Every group has a row for every threshold: the grid is made of the groups, and cells are added up from the highest down.
    """
    spark = cells.sparkSession
    grid = cells.select(*by).distinct().crossJoin(F.broadcast(spark.createDataFrame([(k + 1, float(t)) for k, t in enumerate(thresholds)], "__reached int, threshold double")))
    none = [F.lit(0).cast(cells.schema[c].dataType).alias(c) for c in sums]
    both = grid.select(*by, "__reached", "threshold", *none).unionByName(cells.where("__reached > 0").withColumn("threshold", F.lit(None).cast("double")).select(*by, "__reached", "threshold", *sums))
    both = both.groupBy(*by, "__reached").agg(F.max("threshold").alias("threshold"), *[F.sum(c).alias(c) for c in sums])
    w = W.partitionBy(*by).orderBy(F.col("__reached").desc()).rowsBetween(W.unboundedPreceding, 0)
    return both.select(*by, "threshold", *[F.sum(c).over(w).alias(c) for c in sums])


def threshold_grid(df: DataFrame, by: list[str], y: str, p: str, thresholds: list[float]) -> DataFrame:
    """precision, coverage and counts for every threshold and group: a row falls once into the interval between two thresholds, and the
    intervals' counts are added up from the highest down."""
    edges = sorted(set(thresholds))
    reached = F.coalesce(interval(F.col(p), [float(t) for t in edges]), F.lit(0)).alias("__reached")
    cells = df.groupBy(*by, reached).agg(F.count(F.lit(1)).alias("flagged"), F.count_if(F.col(y) == 1).alias("hits"))
    names = [F.struct(F.col(c).alias("v")).alias(c) for c in by]  # null groups join too
    totals = cells.groupBy(*names).agg(F.sum("flagged").alias("n"))
    out = at_least(cells.select(*names, "__reached", "flagged", "hits"), by, edges, ["flagged", "hits"])
    out = out.join(totals, by) if by else out.crossJoin(F.broadcast(totals))
    out = out.select(*[F.col(f"{c}.v").alias(c) for c in by], "threshold", "n", "flagged", "hits")
    return out.withColumns({"precision": safe_div(F.col("hits"), F.col("flagged")), "coverage": safe_div(F.col("flagged"), F.col("n"))})


def score_at_coverage(df: DataFrame, by: list[str], score: str, share: float) -> DataFrame:
    """(by, threshold, n): the k-th highest score of each group, k the share of its rows rounded up, 1 at least; for groups of any size.

    Equal scores are counted, then summed up by slices of the score and within the slice that holds the k-th.
    """
    counts = sliced(df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(F.count(F.lit(1)).alias("__m")), "threshold")
    names = [F.struct(F.col(c).alias("v")).alias(c) for c in by]
    counts = counts.select(*names, "threshold", "__m", "__slice")
    above = lambda w: F.coalesce(F.sum("__m").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices, w = counts.groupBy(*by, "__slice").agg(F.sum("__m").alias("__m")), W.partitionBy(*by)
    slices = slices.withColumns({"n": F.sum("__m").over(w), "__above": above(w.orderBy(F.col("__slice").desc()))})
    k = F.greatest(F.lit(1), F.ceil(F.lit(float(share)) * F.col("n")))
    holds = slices.where((F.col("__above") < k) & (k <= F.col("__above") + F.col("__m"))).drop("__m")
    inside = counts.join(holds, [*by, "__slice"])
    seen = F.col("__above") + above(W.partitionBy(*by, "__slice").orderBy(F.col("threshold").desc())) + F.col("__m")
    found = inside.withColumn("__seen", seen).where(F.col("__seen") >= k).groupBy(*by, "n").agg(F.max("threshold").alias("threshold"))
    return found.select(*[F.col(f"{c}.v").alias(c) for c in by], "n", "threshold")


def precision_recall_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, precision, recall, coverage) at every score."""
    c = cumulative_counts(df, y, score)
    totals = c.agg(F.sum("pos").alias("__pos"), F.sum(F.col("pos") + F.col("neg")).alias("__n"))
    tp, seen = F.col("pos_above") + F.col("pos"), F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")
    out = c.join(F.broadcast(totals))
    return out.select(F.col(score).alias("threshold"), safe_div(tp, seen).alias("precision"), safe_div(tp, F.col("__pos")).alias("recall"), safe_div(seen, F.col("__n")).alias("coverage"))


def threshold_for_every_fold(grid: DataFrame, model: list[str], floor: float) -> DataFrame:
    """The threshold of each model with the highest mean precision over folds among those with enough coverage in every fold.

    Where there is none: that with enough coverage in the most folds, then of the highest mean precision. grid: model, threshold, precision, coverage by fold; no
    flagged row is a precision of 0. Ties: the lowest threshold.
    """
    met = F.count_if(F.coalesce(F.col("coverage") >= floor, F.lit(False)))
    out = grid.groupBy(*model, "threshold").agg(
        F.avg(F.coalesce("precision", F.lit(0.0))).alias("mean_precision"), F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("min_coverage"), met.alias("folds_met"), F.count("coverage").alias("folds")
    )
    out = out.withColumn("every_fold", F.col("folds_met") == F.col("folds"))
    order = [F.col("every_fold").desc(), F.col("folds_met").desc(), F.col("mean_precision").desc(), F.col("threshold")]
    return out.withColumn("__n", F.row_number().over(W.partitionBy(*model).orderBy(*order))).where("__n = 1").drop("__n")


def best_threshold(grid: DataFrame, by: list[str], floor: float) -> DataFrame:
    """The threshold of highest precision among those with enough coverage, else among all; ties: the lowest."""
    met = F.coalesce(F.col("coverage") >= floor, F.lit(False))
    order = [met.desc(), F.col("precision").desc_nulls_last(), F.col("threshold")]
    first = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return grid.withColumn("meets_floor", met).withColumn("__n", first).where("__n = 1").drop("__n")


def residual_interval(df: DataFrame, y: str, p: str, low: float = 0.1, high: float = 0.9, floor: float = 0.0) -> DataFrame:
    """Adds low and high: the prediction plus quantiles of the residuals, not below the floor."""
    q = exact_quantiles(df.select((F.col(y) - F.col(p)).alias("__e")), [], "__e", [low, high], "__q")
    ends = {n: F.greatest(F.lit(floor), F.col(p) + F.col("__q")[i]) for i, n in enumerate(("low", "high"))}
    return df.join(F.broadcast(q)).withColumns(ends).drop("__q")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks by group, for groups of any size."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_ranks(average_ranks(known, by, x, "__x"), by, y, "__y")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("__x", "__y").alias("spearman"))


def inner_seasons(n_seasons: int, wanted: int) -> int:
    """Seasons that inner folds train on at first: as many as wanted, but one is left to score."""
    return max(1, min(wanted, n_seasons - 1))


def student_p(t: float, degrees: int) -> float:
    """Two-sided p-value of a t statistic: a regularised incomplete beta function, by the continued fraction of Lentz."""
    x = degrees / (degrees + t * t)
    a, b = degrees / 2, 0.5
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-30, 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), 1e-30)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, slope, r2, p): a straight line through the points, and the p-value of its slope; null for fewer than three points."""
    row = df.agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2")).first()
    n, r2, p = row["n"], row["r2"], None
    if n > 2 and r2 is not None:
        p = 0.0 if r2 >= 1 else student_p(math.sqrt(r2 * (n - 2) / (1 - r2)), n - 2)
    return df.sparkSession.createDataFrame([(n, row["slope"], r2, p)], "n long, slope double, r2 double, p double")


def folds(seasons: list[int], first: int, holdout: int | None = None, excluded: tuple[int, ...] = ()) -> list[tuple[list[int], int]]:
    """(training seasons, validation season): every fold trains on all seasons before it, never on the holdout."""
    usable = sorted(s for s in seasons if s not in excluded and s != holdout)
    return [([t for t in usable if t < s], s) for s in usable if s >= first and any(t < s for t in usable)]
