"""Feature selection on correlation matrices. The matrix is summed up by Spark; a matrix of some thousand columns is small."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import pairwise_correlations
from .windows import average_ranks


def column_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as average ranks among their own known values, nulls as they are; rows come out in no order."""
    rows = df.select(F.monotonically_increasing_id().alias("__row"), *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    long = rows.unpivot(["__row"], cols, "__column", "__x").where("__x is not null")
    ranked = average_ranks(long, ["__column"], "__x", "__rank")
    return ranked.groupBy("__row").agg(*[F.max(F.when(F.col("__column") == c, F.col("__rank"))).alias(c) for c in cols]).drop("__row")


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson", least: int = 2) -> np.ndarray:
    """Correlations of every two columns over the rows where both are known (``spearman``: of their ranks among the column's known values).

    Of a constant column, and of columns with fewer than ``least`` rows in common, 0; 1 with itself.
    """
    m = np.nan_to_num(pairwise_correlations(df if method == "pearson" else column_ranks(df, cols), cols, least)[0])
    np.fill_diagonal(m, 1.0)
    return m


def correlation_pairs(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """(first, second, n, corr): each two columns once, with the rows that know both; corr is null where it has no value."""
    m, n = pairwise_correlations(df if method == "pearson" else column_ranks(df, cols), cols)
    rows = [(a, b, int(n[i, j]), None if np.isnan(m[i, j]) else float(m[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if j < i]
    return df.sparkSession.createDataFrame(rows, "first string, second string, n long, corr double")


def target_association(df: DataFrame, cols: list[str], target: str) -> dict[str, float]:
    """Absolute correlation of each column with the target, over the rows where both are known; 0 where there is none."""
    m = correlation_matrix(df, [*cols, target])[-1]
    return {c: abs(float(x)) for c, x in zip(cols, m, strict=False)}


def prune_correlated(df: DataFrame, cols: list[str], target: str, limit: float = 0.9) -> list[str]:
    """Columns left when, of every pair above the limit, the one less associated with the target goes, strongest pairs first."""
    m, strength = np.abs(correlation_matrix(df, cols)), target_association(df, cols, target)
    pairs = sorted(((m[i, j], i, j) for i in range(len(cols)) for j in range(i) if m[i, j] > limit), reverse=True)
    gone: set[int] = set()
    for _, i, j in pairs:
        if i not in gone and j not in gone:
            gone.add(i if (strength[cols[i]], -i) < (strength[cols[j]], -j) else j)
    return [c for k, c in enumerate(cols) if k not in gone]


def collapse_transforms(df: DataFrame, cols: list[str], groups: list[list[str]], target: str, limit: float = 0.9) -> list[str]:
    """Of every group of columns (one statistic by several transforms) those go that correlate above the limit with the one most associated with the target."""
    strength, gone = target_association(df, cols, target), set()
    for group in ([c for c in g if c in cols] for g in groups):
        if len(group) > 1:
            best, *others = sorted(group, key=lambda c: -strength[c])
            row = df.agg(*[F.abs(F.corr(best, c)).alias(c) for c in others]).first()
            gone |= {c for c in others if (row[c] or 0.0) > limit}
    return [c for c in cols if c not in gone]


def prune_in_two_passes(df: DataFrame, cols: list[str], groups: list[list[str]], target: str, collapse: float = 0.9, limit: float = 0.9) -> list[str]:
    """Transforms of one statistic first, then any pair. Call it with the training rows of a fold only."""
    return prune_correlated(df, collapse_transforms(df, cols, groups, target, collapse), target, limit)


def cluster_average_linkage(similarity: np.ndarray, limit: float) -> list[list[int]]:
    """Clusters of items, merged while the mean distance (1 - |similarity|) between two clusters is at most the limit.

    By a chain of nearest neighbours: two clusters that are each other's nearest merge for good, whatever else is nearer elsewhere, and the
    distances from the merged one are weighted means of the two. Every step looks at one row of distances, so n items take time n^2.
    """
    d = np.clip(1 - np.abs(np.asarray(similarity, float)), 0, None)
    d = (d + d.T) / 2
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, members, alive, chain = np.ones(n), [[k] for k in range(n)], np.ones(n, bool), []
    merges: list[tuple[float, int, int]] = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            row = np.where(alive, d[chain[-1]], np.inf)
            nearest = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[nearest]:
                break
            chain.append(nearest)
        a, b = chain.pop(), chain.pop()
        merges.append((float(d[a, b]), members[a][0], members[b][0]))
        mean = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = mean, mean
        d[a, a] = np.inf
        size[a], alive[b] = size[a] + size[b], False
        members[a] = members[a] + members[b]
    owner = list(range(n))

    def root(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    for gap, a, b in merges:
        if gap <= limit + 1e-12:
            owner[root(a)] = root(b)
    groups: dict[int, list[int]] = {}
    for k in range(n):
        groups.setdefault(root(k), []).append(k)
    return sorted(groups.values())


def representatives(df: DataFrame, cols: list[str], target: str, limit: float = 0.1) -> list[str]:
    """One column of each cluster of columns whose ranks correlate by 1 - ``limit``: the one most associated with the target."""
    strength = target_association(df, cols, target)
    groups = cluster_average_linkage(correlation_matrix(df, cols, "spearman"), limit)
    return [max((cols[k] for k in g), key=lambda c: (strength[c], -cols.index(c))) for g in groups]


def variance_inflation(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """1 / (1 - R^2) of each column on all others, over rows where all are known; infinite where the others give it exactly, 1 where it is constant."""
    known = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols]).dropna()
    m, _ = pairwise_correlations(known, cols)
    return dict(zip(cols, inflation(m), strict=True))


def inflation(correlations: np.ndarray, exact: float = 1e-10) -> list[float]:
    live = ~np.isnan(np.diag(correlations))
    out, at = np.ones(len(live)), np.flatnonzero(live)
    r = np.nan_to_num(correlations[np.ix_(live, live)])
    values, vectors = np.linalg.eigh(r) if len(at) else (np.zeros(0), np.zeros((0, 0)))
    none = values < exact * max(len(at), 1)
    # a column with a part in a direction without variation is a sum of others
    part = (vectors[:, none] ** 2).sum(1)
    inverse = (vectors[:, ~none] ** 2 / values[~none]).sum(1)
    out[at] = np.where(part > 1e-8, np.inf, np.maximum(inverse, 1.0))
    return out.tolist()


def principal_components(df: DataFrame, cols: list[str], variance: float = 0.9, out: str = "components") -> DataFrame:
    """Adds as many principal components as explain the share of the variance."""
    v = VectorAssembler(inputCols=cols, outputCol="__raw", handleInvalid="skip").transform(df)
    v = StandardScaler(inputCol="__raw", outputCol="__std", withMean=True).fit(v).transform(v)
    full = PCA(k=len(cols), inputCol="__std", outputCol=out).fit(v)
    k = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), variance)) + 1
    return PCA(k=min(k, len(cols)), inputCol="__std", outputCol=out).fit(v).transform(v).drop("__raw", "__std")
