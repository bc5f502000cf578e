"""Models by name on pyspark.ml, fitted and scored season by season."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import normal_cdf
from . import gram
from .metrics import folds, inner_seasons
from .quantiles import exact_quantiles

SEED = 42

CLASSIFIERS: dict[str, Callable] = {
    "logistic": lambda **k: LogisticRegression(featuresCol="features", labelCol="label", **k),
    "elastic_net": lambda **k: LogisticRegression(featuresCol="features", labelCol="label", **({"regParam": 0.01, "elasticNetParam": 0.5} | k)),
    "random_forest": lambda **k: RandomForestClassifier(featuresCol="features", labelCol="label", seed=SEED, **k),
    "gradient_boosting": lambda **k: GBTClassifier(featuresCol="features", labelCol="label", seed=SEED, **k),
    "svm": lambda **k: LinearSVC(featuresCol="features", labelCol="label", **k),
    "decision_tree": lambda **k: DecisionTreeClassifier(featuresCol="features", labelCol="label", seed=SEED, **k),
}
REGRESSORS: dict[str, Callable] = {
    "ols": lambda **k: LinearRegression(featuresCol="features", labelCol="label", **k),
    "ridge": lambda **k: LinearRegression(featuresCol="features", labelCol="label", **({"regParam": 1.0, "elasticNetParam": 0.0} | k)),
    "lasso": lambda **k: LinearRegression(featuresCol="features", labelCol="label", **({"regParam": 0.1, "elasticNetParam": 1.0} | k)),
    "elastic_net": lambda **k: LinearRegression(featuresCol="features", labelCol="label", **({"regParam": 0.1, "elasticNetParam": 0.5} | k)),
    "poisson": lambda **k: GeneralizedLinearRegression(featuresCol="features", labelCol="label", family="poisson", **k),
    "random_forest": lambda **k: RandomForestRegressor(featuresCol="features", labelCol="label", seed=SEED, **k),
    "gradient_boosting": lambda **k: GBTRegressor(featuresCol="features", labelCol="label", seed=SEED, **k),
}
#: Boosted and randomised trees of other libraries have no counterpart in pyspark.ml; under their names these stand in, with settings of their kind.
STAND_INS: dict[str, tuple[str, dict]] = {
    "xgboost": ("gradient_boosting", {"maxIter": 60, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8}),
    "lightgbm": ("gradient_boosting", {"maxIter": 60, "maxDepth": 5, "stepSize": 0.05, "featureSubsetStrategy": "0.8"}),
    "catboost": ("gradient_boosting", {"maxIter": 60, "maxDepth": 5, "stepSize": 0.05}),
    "hist_gradient_boosting": ("gradient_boosting", {"maxIter": 60, "maxBins": 255, "stepSize": 0.05}),
    "extra_trees": ("random_forest", {"numTrees": 100, "featureSubsetStrategy": "sqrt", "bootstrap": False}),
}


#: Regressors that are fitted on sums of products: name -> penalty and its part of absolute values, as in REGRESSORS.
ADDITIVE: dict[str, tuple[float, float]] = {"ols": (0.0, 0.0), "ridge": (1.0, 0.0), "lasso": (0.1, 1.0), "elastic_net": (0.1, 0.5)}


def penalty(model: str, params: dict) -> tuple[float, float] | None:
    """(regParam, elasticNetParam) if the model with these parameters can be fitted on sums of products."""
    if model not in ADDITIVE or set(params) - {"regParam", "elasticNetParam"}:
        return None
    reg, l1 = ADDITIVE[model]
    return params.get("regParam", reg), params.get("elasticNetParam", l1)


def fold_lines(df: DataFrame, season: str, grid: list[tuple[float, float]], variants: list[list[str]], target: str, trains: list[list[int]]) -> list[list[list[gram.Line]]]:
    """[variant][penalty][fold]: linear fits of every set of columns, penalty and training part, from one scan and one for medians where there are nulls.

    Nulls are filled with the training part's median.
    """
    cols = list(dict.fromkeys(c for v in variants for c in v))
    m = gram.moments(df, season, cols, target)
    fills = gram.median_fills(df, season, m, target, trains)
    out = []
    for v in variants:
        at, own = [cols.index(c) for c in v], m.only(v)
        out.append([[gram.fit_line(own, train, reg, l1, f[at]) for train, f in zip(trains, fills, strict=True)] for reg, l1 in grid])
    return out


def learner(model: str, classify: bool, **params):
    """A model by its name; the parameters given go before those of a stand-in."""
    name, own = STAND_INS.get(model, (model, {}))
    return (CLASSIFIERS if classify else REGRESSORS)[name](**(own | params))


def preprocessing(numeric: list[str], categorical: list[str] | None = None) -> list:
    """Medians for nulls, standard scores, one-hot columns."""
    categorical = categorical or []
    filled = [f"__f_{c}" for c in numeric]
    stages: list = [
        Imputer(strategy="median", inputCols=numeric, outputCols=filled, relativeError=0.001), VectorAssembler(inputCols=filled, outputCol="__num"),
        StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True),
    ]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"__i_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"__o_{c}")]
    return [*stages, VectorAssembler(inputCols=["__scaled", *[f"__o_{c}" for c in categorical]], outputCol="features")]


def fit(df: DataFrame, model: str, numeric: list[str], target: str, classify: bool, categorical: list[str] | None = None, **params) -> PipelineModel:
    return Pipeline(stages=[*preprocessing(numeric, categorical), learner(model, classify, **params)]).fit(df.withColumn("label", F.col(target).cast("double")).where("label is not null"))


def score(model: PipelineModel, df: DataFrame, classify: bool) -> DataFrame:
    """Adds p: the probability of 1, or the predicted value."""
    out = model.transform(df)
    if classify and "probability" not in out.columns:  # a margin, as a support vector machine gives it
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    else:
        p = vector_to_array("probability")[1] if classify else F.col("prediction")
    return out.select(*df.columns, p.alias("p"))


def margin_probability(regressor: PipelineModel, train: DataFrame, df: DataFrame, target: str, robust: bool = False) -> DataFrame:
    """Adds p: the probability that a predicted margin is above 0, by a normal distribution as wide as the training residuals.

    Their width is the population deviation or, if ``robust``, the interquartile range over 1.349; 0 counts as 1.
    """
    gap = F.col(target) - F.col("p")
    gaps = score(regressor, train, False).select(gap.alias("__gap"))
    if robust:
        q = exact_quantiles(gaps, [], "__gap", [0.25, 0.75], "__q")
        width = (F.col("__q")[1] - F.col("__q")[0]) / 1.349
    else:
        q, width = gaps.agg(F.stddev_pop("__gap").alias("__q")), F.col("__q")
    spread = q.select(F.when(width > 0, width).otherwise(1.0).alias("__spread"))
    out = score(regressor, df, False).join(F.broadcast(spread))
    return out.withColumn("p", normal_cdf(F.col("p") / F.col("__spread"))).drop("__spread")


def latest_model(spark: SparkSession, folder: str, prefix: str = "") -> PipelineModel:
    """The saved model whose name, which ends with when it was made, is the last of those with the prefix."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(where) if x.isDirectory()] if store.exists(where) else []
    if not (found := sorted(n for n in names if n.startswith(prefix))):
        raise FileNotFoundError(f"no model {prefix}* in {folder}")
    return PipelineModel.load(f"{folder}/{found[-1]}")


def walk_forward(df: DataFrame, season: str, model: str, numeric: list[str], target: str, classify: bool, seasons: list[int], first: int, **params) -> DataFrame:
    """Out-of-fold predictions: each season is scored by a model fitted on those before it. Linear regressors are fitted for all folds in one scan."""
    cuts = folds(seasons, first)
    if not classify and (p := penalty(model, params)):
        lines = fold_lines(df, season, [p], [numeric], target, [t for t, _ in cuts])[0][0]
        return gram.score_by_season(df, season, {valid: line for (_, valid), line in zip(cuts, lines, strict=True)})
    parts = []
    for train, valid in cuts:
        fitted = fit(df.where(F.col(season).isin(train)), model, numeric, target, classify, **params)
        parts.append(score(fitted, df.where(F.col(season) == valid), classify).withColumn("fold", F.lit(valid)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def pooled_losses(df: DataFrame, season: str, cases: list[tuple[list[str], tuple[float, float]]], target: str, seasons: list[int], first: int) -> list[float]:
    """Pooled out-of-fold absolute error of linear regressors, each a set of columns and a penalty: one scan fits them all, one scores them all."""
    cuts = folds(seasons, first)
    grid, variants = list(dict.fromkeys(p for _, p in cases)), [list(v) for v in dict.fromkeys(tuple(v) for v, _ in cases)]
    lines = fold_lines(df, season, grid, variants, target, [t for t, _ in cuts])
    scored = []
    for cols, p in cases:
        own = lines[variants.index(list(cols))][grid.index(p)]
        by_fold = reduce(lambda w, k: w.when(F.col(season) == cuts[k][1], own[k].predict()), range(len(cuts)), F)
        scored.append((F.col(season).isin([v for _, v in cuts]), by_fold))
    return [mae for mae, _ in gram.losses(df, target, scored)]


def tune(df: DataFrame, season: str, model: str, grid: list[dict], numeric: list[str], target: str, seasons: list[int], first: int, classify: bool = False) -> tuple[dict, float]:
    """The parameters of least pooled absolute error (of classifiers: Brier score) over the folds; the first of equals."""
    penalties = [None if classify else penalty(model, params) for params in grid]
    if all(penalties):
        error, k = min((e, k) for k, e in enumerate(pooled_losses(df, season, [(numeric, p) for p in penalties], target, seasons, first)))
        return grid[k], error
    errors, gap = [], F.col("p") - F.col(target)
    for k, params in enumerate(grid):
        oof = walk_forward(df, season, model, numeric, target, classify, seasons, first, **params)
        errors.append((oof.agg(F.avg(gap * gap if classify else F.abs(gap))).first()[0], k))
    error, k = min(errors)
    return grid[k], error


def stack(oof: dict[str, DataFrame], keys: list[str], target: str) -> DataFrame:
    """Base models' out-of-fold predictions side by side, rows that all of them scored."""
    frames = [df.select(*keys, target, F.col("p").alias(name)) if i == 0 else df.select(*keys, F.col("p").alias(name)) for i, (name, df) in enumerate(oof.items())]
    return reduce(lambda a, b: a.join(b, keys), frames).dropna()


def stacked(
    df: DataFrame, season: str, bases: dict[str, str], meta: str, numeric: list[str], target: str, seasons: list[int], first: int, key: list[str], min_inner: int = 2,
) -> DataFrame:
    """Out-of-fold predictions of a classifier on the base models' predictions. bases: name -> model.

    In every fold the base models' predictions for its training seasons are made out of fold themselves (inner folds, by season), the meta
    model is fitted on rows that all of them scored, and the base models are fitted again on the whole training part to score the fold.
    """
    parts = []
    for train, valid in folds(seasons, first):
        own, held = df.where(F.col(season).isin(train)), df.where(F.col(season) == valid)
        start = sorted(train)[min(inner_seasons(len(train), min_inner), len(train) - 1)]
        inner = {n: walk_forward(own, season, m, numeric, target, True, train, start) for n, m in bases.items()}
        fitted = fit(stack(inner, key, target), meta, list(bases), target, True)
        scored = reduce(lambda a, b: a.join(b, key), [score(fit(own, m, numeric, target, True), held, True).select(*key, F.col("p").alias(n)) for n, m in bases.items()])
        out = score(fitted, held.join(scored, key), True).withColumn("fold", F.lit(valid))
        parts.append(out.drop(*bases))
    return reduce(lambda a, b: a.unionByName(b), parts)


def isotonic(df: DataFrame, p: str, target: str, weight: str | None = None):
    """A monotone map from scores to probabilities."""
    v = VectorAssembler(inputCols=[p], outputCol="features").transform(df.withColumn("label", F.col(target).cast("double")))
    return IsotonicRegression(featuresCol="features", labelCol="label", **({"weightCol": weight} if weight else {})).fit(v)


def platt(df: DataFrame, p: str, target: str):
    v = VectorAssembler(inputCols=[p], outputCol="features").transform(df.withColumn("label", F.col(target).cast("double")))
    return LogisticRegression(featuresCol="features", labelCol="label").fit(v)


def permutation_importance(
    model: PipelineModel, df: DataFrame, cols: list[str], key: str, loss: Callable[[DataFrame], float], classify: bool, repeats: int = 1, spread: bool = False,
) -> dict[str, float] | dict[str, tuple[float, float]]:
    """How much the loss grows when a column's values move between rows: each row gets that of the next in a hash's order, a new order in every repeat.

    The mean over the repeats, or with ``spread`` the mean and the population deviation. Rows are dealt to slices by the hash, so no task sorts
    them all; the last of a slice takes the slice's first.
    """
    base, out = loss(score(model, df, classify)), {}
    for c in cols:
        grown = []
        for k in range(repeats):
            w = W.partitionBy(F.pmod(F.xxhash64(key, F.lit(c), F.lit(k)), F.lit(1024))).orderBy(F.xxhash64(F.lit(SEED + k), key), key)
            first = F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            last = F.lead(key).over(w).isNull()
            moved = df.withColumn(c, F.when(last, first).otherwise(F.lead(c).over(w)))
            grown.append(loss(score(model, moved, classify)) - base)
        out[c] = (float(np.mean(grown)), float(np.std(grown))) if spread else float(np.mean(grown))
    return out


def coefficients(model: PipelineModel, numeric: list[str]) -> dict[str, float]:
    """Coefficients of the standardised numeric columns of a linear model."""
    return dict(zip(numeric, model.stages[-1].coefficients.toArray().tolist()[: len(numeric)], strict=True))


def embedded_selection(df: DataFrame, model: str, numeric: list[str], target: str, classify: bool, top: int, **params) -> list[str]:
    """The ``top`` columns of largest absolute coefficient in a sparse linear model; columns at zero never count."""
    sizes = {c: abs(x) for c, x in coefficients(fit(df, model, numeric, target, classify, **params), numeric).items()}
    return sorted((c for c in numeric if sizes[c] > 0), key=lambda c: (-sizes[c], numeric.index(c)))[:top]


def select_by_grid(df: DataFrame, season: str, model: str, grid: list[dict], numeric: list[str], target: str, seasons: list[int], first: int, top: int) -> list[str]:
    """The embedded selection by the parameters that classify best over time-ordered folds (least mean log loss, the first of equals)."""
    losses = []
    for k, params in enumerate(grid):
        oof = walk_forward(df, season, model, numeric, target, True, seasons, first, **params)
        p = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
        loss = oof.groupBy("fold").agg(F.avg(-F.when(F.col(target) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss")).agg(F.avg("loss")).first()[0]
        losses.append((loss, k))
    return embedded_selection(df.where(F.col(season).isin(seasons)), model, numeric, target, True, top, **grid[min(losses)[1]])


def learning_curve(df: DataFrame, season: str, model: str, numeric: list[str], target: str, classify: bool, seasons: list[int], valid: int) -> DataFrame:
    """(seasons, train_loss, valid_loss): fitted on the last 1, 2, ... seasons before ``valid``; Brier score or absolute error."""
    before, rows = sorted((s for s in seasons if s < valid), reverse=True), []
    if not classify and (p := penalty(model, {})):
        trains = [before[:n] for n in range(1, len(before) + 1)]
        lines = fold_lines(df, season, [p], [numeric], target, trains)[0][0]
        cases = [(F.col(season).isin(part), line.predict()) for train, line in zip(trains, lines, strict=True) for part in (train, [valid])]
        found = [mae for mae, _ in gram.losses(df, target, cases)]
        rows = [(n, found[2 * n - 2], found[2 * n - 1]) for n in range(1, len(before) + 1)]
        return df.sparkSession.createDataFrame(rows, "seasons int, train_loss double, valid_loss double")
    gap = F.col("p") - F.col(target)
    loss = F.avg(gap * gap if classify else F.abs(gap))
    for n in range(1, len(before) + 1):
        own = df.where(F.col(season).isin(before[:n]))
        fitted = fit(own, model, numeric, target, classify)
        rows.append((n, *(score(fitted, x, classify).agg(loss).first()[0] for x in (own, df.where(F.col(season) == valid)))))
    return df.sparkSession.createDataFrame(rows, "seasons int, train_loss double, valid_loss double")


def elimination_order(sizes: Callable[[list[str]], dict[str, float]], numeric: list[str]) -> list[list[str]]:
    """The columns left after each drop of that with the least absolute coefficient, all of them first."""
    left = [list(numeric)]
    while len(left[-1]) > 1:
        size = sizes(left[-1])
        least = min(left[-1], key=lambda c: abs(size[c]))
        left.append([c for c in left[-1] if c != least])
    return left


def recursive_elimination(df: DataFrame, model: str, numeric: list[str], target: str, classify: bool, keep: int) -> list[str]:
    """Drops the column of least absolute coefficient (of standard scores) and fits again, until ``keep`` are left; linear regressors in one scan."""
    if not classify and (p := penalty(model, {})):
        m = gram.moments(df, None, numeric, target)
        fills = dict(zip(numeric, gram.median_fills(df, None, m, target, [[]])[0], strict=True))

        def sizes(cols: list[str]) -> dict[str, float]:
            return dict(zip(cols, gram.fit_line(m.only(cols), [""], *p, np.array([fills[c] for c in cols])).scaled.tolist(), strict=True))
    else:

        def sizes(cols: list[str]) -> dict[str, float]:
            return coefficients(fit(df, model, cols, target, classify), cols)

    return elimination_order(sizes, numeric)[len(numeric) - keep] if keep < len(numeric) else list(numeric)


def cross_validated_elimination(df: DataFrame, season: str, model: str, numeric: list[str], target: str, seasons: list[int], first: int) -> tuple[list[str], list[tuple[int, float]]]:
    """The columns that recursive elimination keeps at the number with the least mean squared error over the folds (the fewest of equals), and
    (number, error) for every number. For linear regressors; every fold eliminates on its own training part, and no fold has a scan of its own."""
    if (p := penalty(model, {})) is None:
        raise ValueError(f"{model} is not fitted on sums of products")
    m, cuts = gram.moments(df, season, numeric, target), folds(seasons, first)
    fills = gram.median_fills(df, season, m, target, [*[t for t, _ in cuts], sorted(seasons)])
    total: dict[int, list[float]] = {}
    best: list[list[str]] = []
    for k, (train, valid) in enumerate([*cuts, (sorted(seasons), None)]):
        at = dict(zip(numeric, fills[k], strict=True))
        line = lambda cols: gram.fit_line(m.only(cols), train, *p, np.array([at[c] for c in cols]))  # noqa: B023, E731
        steps = elimination_order(lambda cols: dict(zip(cols, line(cols).scaled.tolist(), strict=True)), numeric)  # noqa: B023
        for cols in steps if valid is not None else ():
            n, error = gram.squared_error(m.only(cols), [valid], line(cols))
            at_number = total.setdefault(len(cols), [0.0, 0.0])
            at_number[0], at_number[1] = at_number[0] + n, at_number[1] + error
        best = steps
    errors = sorted((k, e / n) for k, (n, e) in total.items() if n)
    return best[len(numeric) - min(errors, key=lambda x: (x[1], x[0]))[0]], errors


def coefficient_stability(df: DataFrame, season: str, model: str, numeric: list[str], target: str, classify: bool, seasons: list[int], first: int) -> DataFrame:
    """(column, mean, std, sign_share) over the folds of the coefficients of standard scores, in units of the target."""
    cuts = [t for t, _ in folds(seasons, first)]
    if not classify and (p := penalty(model, {})):
        rows = [(c, float(x)) for line in fold_lines(df, season, [p], [numeric], target, cuts)[0][0] for c, x in zip(numeric, line.scaled * line.y_scale, strict=True)]
    else:
        rows = [(c, x) for train in cuts for c, x in coefficients(fit(df.where(F.col(season).isin(train)), model, numeric, target, classify), numeric).items()]
    long = df.sparkSession.createDataFrame(rows, "column string, x double")
    return long.groupBy("column").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.greatest(F.avg((F.col("x") > 0).cast("int")), F.avg((F.col("x") < 0).cast("int"))).alias("sign_share"))


def ablation(df: DataFrame, season: str, model: str, variants: dict[str, list[str]], target: str, classify: bool, seasons: list[int], first: int) -> DataFrame:
    """(variant, n, loss): pooled out-of-fold error (Brier score or absolute error) for each set of columns."""
    if not classify and (p := penalty(model, {})):
        found = pooled_losses(df, season, [(cols, p) for cols in variants.values()], target, seasons, first)
        valid = [v for _, v in folds(seasons, first)]
        n = df.where(F.col(season).isin(valid)).count()
        return df.sparkSession.createDataFrame([(name, n, e) for name, e in zip(variants, found, strict=True)], "variant string, n long, loss double")
    parts = []
    for name, cols in variants.items():
        gap = F.col("p") - F.col(target)
        oof = walk_forward(df, season, model, cols, target, classify, seasons, first)
        parts.append(oof.agg(F.lit(name).alias("variant"), F.count(F.lit(1)).alias("n"), F.avg(gap * gap if classify else F.abs(gap)).alias("loss")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def partial_dependence(model: PipelineModel, df: DataFrame, col: str, grid: list[float], classify: bool) -> DataFrame:
    """(value, mean_p): the mean prediction with the column set to each value of the grid."""
    rows = df.drop(col).withColumn(col, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return score(model, rows, classify).groupBy(F.col(col).alias("value")).agg(F.avg("p").alias("mean_p"))


def quantile_regression(df: DataFrame, cols: list[str], target: str, q: float, steps: int = 60, rate: float = 1.0) -> tuple[float, dict[str, float]]:
    """Intercept and slopes that minimise the pinball loss, by subgradient steps on standardised columns.

    A step is one aggregate over the rows; the returned values are means of the last half of the steps. Rows with a null are left out.
    """
    df = df.select(*cols, target).dropna()
    y0 = exact_quantiles(df, [], target, [q], "q").first()["q"][0]
    stats = df.agg(F.stddev_pop(target).alias("ys"), *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    scale = {c: (stats[f"m_{c}"], stats[f"s_{c}"] or 1.0) for c in cols}
    z = df.select(F.col(target).alias("__y"), *[((F.col(c) - m) / s).alias(c) for c, (m, s) in scale.items()]).cache()
    beta, total = [y0, *[0.0] * len(cols)], [0.0] * (len(cols) + 1)
    for k in range(steps):
        fit_now = reduce(lambda a, b: a + b, [F.col(c) * b for c, b in zip(cols, beta[1:], strict=True)], F.lit(beta[0]))
        pull = F.when(F.col("__y") > fit_now, q).otherwise(q - 1)
        grad = z.agg(F.avg(pull), *[F.avg(pull * F.col(c)) for c in cols]).first()
        step = rate * (stats["ys"] or 1.0) * 2 / (1 + k) ** 0.5
        beta = [b + step * g for b, g in zip(beta, grad, strict=True)]
        if k >= steps // 2:
            total = [t + b for t, b in zip(total, beta, strict=True)]
    z.unpersist()
    mean = [t / (steps - steps // 2) for t in total]
    slopes = {c: b / scale[c][1] for c, b in zip(cols, mean[1:], strict=True)}
    return mean[0] - sum(slopes[c] * scale[c][0] for c in cols), slopes
