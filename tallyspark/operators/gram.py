"""Linear fits and correlations from sums of products, which one scan gathers for every season at once.

A task multiplies its rows' matrices and sends on their sums, one vector for each row of a matrix; Spark adds the vectors up by season and
row. What reaches the driver has the size of columns x columns x seasons, whatever the number of rows. Sums of seasons add up, so
expanding folds, grids of penalties, subsets of columns and learning curves need no further scan.

Nulls of a column stay apart as an indicator, so any value that fills them is a linear map of the sums; each fold fills with its own. Values are
shifted by the first row's, so large offsets do not cost digits. NaN counts as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregates in one query where each column has its own.
AGGREGATES = 400


def vector_sums(sent: DataFrame) -> DataFrame:
    """The vectors in ``sums``, the last column, added up over the rows that agree in all others. Counts stay whole numbers: they are added, while
    Summarizer's sums are means times weights, which can fall short of a count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for *key, sums in zip(*[c.to_pylist() for c in batch.columns[:-1]], batch.columns[-1], strict=True):
                own, m = tuple(key), sums.values.to_numpy()
                held[own] = held[own] + m if own in held else m.copy()
        found = list(held.items())
        for at in range(0, len(found), 256):
            some = found[at : at + 256]
            keys = [pa.array(k, f.type) for k, f in zip(zip(*[k for k, _ in some], strict=True), batch.schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([m for _, m in some], pa.list_(pa.float64()))], schema=batch.schema)

    return sent.repartition(*sent.columns[:-1]).mapInArrow(add, sent.schema)


def matrix_sums(df: DataFrame, key: str | None, cols: list[str], center: np.ndarray, parts: Callable[[np.ndarray], dict[str, np.ndarray]]) -> dict:
    """By key: the sums of the matrices that ``parts`` makes of blocks of rows (nulls are NaN, values less ``center``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], 1) - center
            for k in dict.fromkeys(keys.tolist()):
                for name, m in parts(x[keys == k]).items():
                    held[k, name] = held[k, name] + m if (k, name) in held else m
        for (k, name), m in held.items():
            for at in range(0, len(m), 256):
                some = m[at : at + 256]
                columns = [pa.array([k] * len(some), pa.string()), pa.array([name] * len(some)), pa.array(range(at, at + len(some)), pa.int32()), pa.array(list(some), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "part", "row", "sums"])

    group = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    sent = df.select(group.alias("__key"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "key string, part string, row int, sums array<double>")
    rows = vector_sums(sent).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["row"]):
        out.setdefault(r["key"], {}).setdefault(r["part"], []).append(r["sums"])
    return {k: {name: np.array(m) for name, m in parts.items()} for k, parts in out.items()}


def first_values(df: DataFrame, cols: list[str]) -> np.ndarray:
    """A value of each column, a shift near the data: the first row's or, where that is null, any. 0 where there is none."""
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    row = list(values.first() or [0.0] * len(cols))
    if missing := [i for i, x in enumerate(row) if x is None]:
        for i, x in zip(missing, values.agg(*[F.first(f"c{i}", ignorenulls=True) for i in missing]).first(), strict=True):
            row[i] = x
    return np.array([x if x is not None and np.isfinite(x) else 0.0 for x in row])


@dataclass(frozen=True)
class Moments:
    """By season the products of [1, x, is null, y], x and y less a center and 0 where null."""

    cols: list[str]
    center: np.ndarray
    y_center: float
    by: dict[str, np.ndarray]

    def of(self, seasons) -> np.ndarray:
        size = 2 * len(self.cols) + 2
        return sum((self.by[str(s)] for s in seasons if str(s) in self.by), np.zeros((size, size)))

    def only(self, cols: list[str]) -> Moments:
        at = [self.cols.index(c) for c in cols]
        p = len(self.cols)
        keep = [0, *[1 + i for i in at], *[1 + p + i for i in at], 1 + 2 * p]
        return replace(self, cols=list(cols), center=self.center[at], by={k: g[np.ix_(keep, keep)] for k, g in self.by.items()})

    def with_nulls(self) -> list[str]:
        p = len(self.cols)
        some = sum(self.by.values(), np.zeros((2 * p + 2, 2 * p + 2)))[0, 1 + p : 1 + 2 * p]
        return [c for c, n in zip(self.cols, some, strict=True) if n > 0]


def moments(df: DataFrame, season: str | None, cols: list[str], target: str) -> Moments:
    """One scan. Rows without a target are left out. Without a season all rows are of one that is named ''."""
    rows = df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    center = first_values(rows, [*cols, target])

    def products(x: np.ndarray) -> dict[str, np.ndarray]:
        known = np.isfinite(x[:, :-1])
        z = np.hstack([np.ones((len(x), 1)), np.where(known, x[:, :-1], 0.0), ~known, x[:, -1:]])
        return {"g": z.T @ z}

    sums = matrix_sums(rows, season, [*cols, target], center, products)
    return Moments(list(cols), center[:-1], float(center[-1]), {k: m["g"] for k, m in sums.items()})


@dataclass(frozen=True)
class Line:
    """prediction = intercept + sum of coefs * (x or, where null, fill). Scaled coefficients are those of standard scores, the target's too; times
    y_scale they are in units of the target."""

    cols: list[str]
    intercept: float
    coefs: np.ndarray
    fills: np.ndarray
    scaled: np.ndarray
    y_scale: float = 1.0

    def predict(self) -> Column:
        terms = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(f))) * F.lit(float(b)) for c, b, f in zip(self.cols, self.coefs, self.fills, strict=True)]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))


def _filled(m: Moments, g: np.ndarray, fills: np.ndarray) -> np.ndarray:
    """Products of [1, x filled, y] from those with indicators."""
    p = len(m.cols)
    a = np.zeros((2 * p + 2, p + 2))
    a[0, 0] = a[-1, -1] = 1
    a[1 : p + 1, 1 : p + 1] = np.eye(p)
    a[p + 1 : 2 * p + 1, 1 : p + 1] = np.diag(fills - m.center)
    return a.T @ g @ a


def mean_fills(m: Moments, g: np.ndarray) -> np.ndarray:
    p = len(m.cols)
    known = g[0, 0] - g[0, 1 + p : 1 + 2 * p]
    return m.center + np.divide(g[0, 1 : 1 + p], known, out=np.zeros(p), where=known > 0)


def fit_line(m: Moments, seasons, reg: float = 0.0, l1: float = 0.0, fills: np.ndarray | None = None, start: np.ndarray | None = None) -> Line:
    """Least squares with the penalty reg * (l1 * |w| + (1 - l1) / 2 * w^2) on the coefficients w of standard scores.

    The penalty is scaled as pyspark.ml.regression.LinearRegression does: the target is in standard deviations too. A part of absolute
    values is found by coordinate descent on the products; columns without variation get 0.
    """
    g = m.of(seasons)
    if g[0, 0] == 0:
        return Line(m.cols, float("nan"), np.zeros(len(m.cols)), m.center, np.zeros(len(m.cols)))
    fills = mean_fills(m, g) if fills is None else fills
    f = _filled(m, g, fills)
    n = f[0, 0]
    mean, y_mean = f[0, 1:-1] / n, f[0, -1] / n
    cov, with_y, y_var = f[1:-1, 1:-1] / n - np.outer(mean, mean), f[1:-1, -1] / n - mean * y_mean, f[-1, -1] / n - y_mean**2
    scale, y_scale = np.sqrt(np.maximum(np.diag(cov), 0)), np.sqrt(max(y_var, 0))
    live = scale > 1e-12 * (1 + np.abs(mean))
    w = np.zeros(len(m.cols))
    if live.any() and y_scale > 0:
        s = scale[live]
        r, c, penalty = cov[np.ix_(live, live)] / np.outer(s, s), with_y[live] / (s * y_scale), reg / y_scale
        if l1 > 0 and reg > 0:
            w[live] = coordinate_descent(r, c, penalty * l1, penalty * (1 - l1), start[live] if start is not None else None)
        else:
            w[live] = np.linalg.lstsq(r + penalty * np.eye(len(s)), c, rcond=None)[0]
    coefs = np.divide(w * y_scale, scale, out=np.zeros_like(w), where=live)
    return Line(m.cols, float(m.y_center + y_mean - coefs @ (mean + m.center)), coefs, fills, w, float(y_scale))


def coordinate_descent(r: np.ndarray, c: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None, rounds: int = 10_000, settled: float = 1e-12) -> np.ndarray:
    """The w that minimises w'rw / 2 - c'w + l1 |w| + l2 w'w / 2."""
    w = np.zeros(len(c)) if start is None else start.copy()
    rw = r @ w
    for _ in range(rounds):
        most = 0.0
        for j in range(len(c)):
            pull = c[j] - rw[j] + r[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (r[j, j] + l2)
            if (step := new - w[j]) != 0.0:
                rw += r[:, j] * step
                w[j], most = new, max(most, abs(step))
        if most < settled:
            break
    return w


def penalty_path(m: Moments, seasons, regs: list[float], l1: float, fills: np.ndarray | None = None) -> list[Line]:
    """The fits of all penalties, from the largest down, each started from the one before; in the order given."""
    found, start = {}, None
    for reg in sorted(set(regs), reverse=True):
        found[reg] = fit_line(m, seasons, reg, l1, fills, start)
        start = found[reg].scaled
    return [found[r] for r in regs]


def squared_error(m: Moments, seasons, line: Line) -> tuple[float, float]:
    """(rows, sum of squared errors) of a fit on the rows of some seasons, without a scan. The fit is on the columns of ``m``."""
    f = _filled(m, m.of(seasons), line.fills)
    v = np.concatenate(([line.intercept + line.coefs @ m.center - m.y_center], line.coefs, [-1.0]))
    return float(f[0, 0]), float(max(v @ f @ v, 0.0))


def median_fills(df: DataFrame, season: str | None, m: Moments, target: str, folds: list[list[int]]) -> list[np.ndarray]:
    """For each fold's training seasons the columns' medians (to a thousandth of the rows), of columns that have nulls; 0 where all are."""
    asked = [(k, c) for k in range(len(folds)) for c in m.with_nulls()]
    out = [np.array(m.center) for _ in folds]
    rows = df.where(F.col(target).isNotNull())
    for at in range(0, len(asked), AGGREGATES):
        some = asked[at : at + AGGREGATES]
        known = [F.when(F.col(season).isin(folds[k]) if season else F.lit(True), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))) for k, c in some]
        found = rows.agg(*[F.percentile_approx(x, F.lit(0.5), F.lit(1000)).alias(f"q{i}") for i, x in enumerate(known)]).first()
        for (k, c), x in zip(some, found, strict=True):
            out[k][m.cols.index(c)] = x if x is not None else 0.0
    return out


def score_by_season(df: DataFrame, season: str, lines: dict[int, Line]) -> DataFrame:
    """The rows of the seasons given with p, each season by its own fit, and fold, the season."""
    p = reduce(lambda w, s: w.when(F.col(season) == s, lines[s].predict()), lines, F) if lines else F.lit(None).cast("double")
    return df.where(F.col(season).isin(list(lines))).withColumn("p", p).withColumn("fold", F.col(season).cast("int"))


def losses(df: DataFrame, target: str, cases: list[tuple[Column, Column]]) -> list[tuple[float | None, float | None]]:
    """(mean absolute error, mean squared error) of each (rows, prediction), all in one scan."""
    gaps = [F.when(rows, p - F.col(target)) for rows, p in cases]
    row = df.agg(*[x for i, g in enumerate(gaps) for x in (F.avg(F.abs(g)).alias(f"a{i}"), F.avg(g * g).alias(f"s{i}"))]).first()
    return [(row[f"a{i}"], row[f"s{i}"]) for i in range(len(cases))]


def pair_sums(df: DataFrame, cols: list[str]) -> dict[str, np.ndarray]:
    """For each pair of columns, over the rows where both are known: how many, and the sums of x, x^2 (of the first) and x y."""
    center = first_values(df, cols)

    def products(x: np.ndarray) -> dict[str, np.ndarray]:
        known = np.isfinite(x)
        x, k = np.where(known, x, 0.0), known.astype(float)
        return {"n": k.T @ k, "x": x.T @ k, "xx": (x * x).T @ k, "xy": x.T @ x}

    sums = matrix_sums(df, None, cols, center, products)
    return sums.get("", {c: np.zeros((len(cols), len(cols))) for c in ("n", "x", "xx", "xy")})


def pairwise_correlations(df: DataFrame, cols: list[str], least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(correlations, rows) of every pair over the rows where both columns are known; NaN for fewer rows than ``least`` or no variation."""
    s = pair_sums(df, cols)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = s["x"] / s["n"]
        var = s["xx"] / s["n"] - mean**2
        floor = 1e-14 * (s["xx"] / s["n"])
        var = np.where(var > floor, var, np.nan)
        r = (s["xy"] / s["n"] - mean * mean.T) / np.sqrt(var * var.T)
    return np.where(s["n"] >= least, np.clip(r, -1, 1), np.nan), s["n"]
