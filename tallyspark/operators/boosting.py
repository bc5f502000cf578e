"""Gradient-boosted trees on histograms, with second-order steps: squared error, logistic loss, and quantiles by the pinball loss.

Columns are cut into bins at quantiles once. In every level a task adds up, for each of its nodes, columns and bins, the gradients and
curvatures of its rows; Spark adds these sums up, and the driver picks each node's split from them. They are as many as nodes x columns x bins,
whatever the number of rows. Rows are never moved: a task finds a row's node from the trees so far, which are small and go to it.

Nulls and NaN are a bin of their own before all others, so a split sends them left with the small values. For quantiles the tree is grown on the
gradient of the pinball loss, and each leaf then gets the quantile of its rows' residuals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import vector_sums
from .quantiles import column_quantiles

BINS = 32


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: node k has children 2k + 1 and 2k + 2. A row goes left if its bin is at most ``cut``; -1 in ``column`` sends all left."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def at(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Each row's node of a level."""
        node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(level):
            c = self.column[node]
            node = 2 * node + 1 + ((c >= 0) & (bins[every, np.maximum(c, 0)] > self.cut[node]))
        return node

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        inner = len(self.column)
        return self.at(bins, inner.bit_length()) - inner


@dataclass(frozen=True)
class Boosted:
    """prediction = start + rate * the sum of the trees' leaves; of the logistic loss, its logistic function."""

    cols: list[str]
    edges: list[np.ndarray]
    loss: str
    start: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Rows x columns: 0 for null, else 1 and how many edges are below the value."""
        out = np.zeros(x.shape, np.int16)
        for j, e in enumerate(self.edges):
            known = ~np.isnan(x[:, j])
            out[known, j] = 1 + np.searchsorted(e, x[known, j], "left")
        return out

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for t in self.trees:
            out += self.rate * t.value[t.leaf(bins)]
        return out

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Adds the prediction."""
        n = len(df.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[n:]], 1)
                p = self.raw(self.bins(x))
                p = 1 / (1 + np.exp(-p)) if self.loss == "logistic" else p
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(p)], names=[*batch.schema.names[:n], name])

        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"`{name}` double"])
        return df.select(*df.columns, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(self.cols)]).mapInArrow(run, schema)


def gradients(loss: str, q: float, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "logistic":
        p = 1 / (1 + np.exp(-raw))
        return p - y, p * (1 - p)
    if loss == "pinball":
        return np.where(y > raw, -q, 1 - q), np.ones(len(y))
    return raw - y, np.ones(len(y))


def _best(sums: np.ndarray, penalty: float, least: float) -> tuple[int, int, float]:
    """(column, cut, gain) of a node's columns x bins x (gradient, curvature, rows)."""
    left = np.cumsum(sums, 1)[:, :-1]
    whole = sums.sum(1, keepdims=True)
    right = whole - left
    score = lambda s: np.divide(s[..., 0] ** 2, s[..., 1] + penalty, out=np.zeros(s.shape[:-1]), where=s[..., 1] + penalty > 0)
    gain = score(left) + score(right) - score(whole)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, -np.inf)
    c, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(c), int(b), float(gain[c, b])) if gain[c, b] > 1e-12 else (-1, 0, 0.0)


def fit_boosted(
    df: DataFrame, cols: list[str], target: str, loss: str = "squared", q: float = 0.5, rounds: int = 40, depth: int = 3, rate: float = 0.1, penalty: float = 1.0,
    bins: int = BINS, least: int = 20,
) -> Boosted:
    """Rows without a target are left out. loss: squared, logistic (target 0 or 1) or pinball, for the quantile q."""
    if loss not in ("squared", "logistic", "pinball"):
        raise ValueError(f"no loss {loss}")
    rows = df.select(F.col(target).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)]).where("__y is not null and not isnan(__y)")
    names = [f"__x{i}" for i in range(len(cols))]
    found = {r["column"]: r["quantiles"] for r in column_quantiles(rows, [], names, [k / bins for k in range(1, bins)]).collect()}
    edges = [np.unique(found.get(n, [])) for n in names]
    if loss == "pinball":
        start = column_quantiles(rows, [], ["__y"], [q]).first()
        start = start["quantiles"][0] if start else 0.0
    else:
        mean = rows.agg(F.avg("__y")).first()[0] or 0.0
        start = float(np.log((mean + 1e-9) / (1 - mean + 1e-9))) if loss == "logistic" else mean
    model = Boosted(list(cols), edges, loss, start, rate)
    size = bins + 1

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in model.bins(x)], pa.binary())], names=["y", "bins"])

    binned = rows.mapInArrow(bin_rows, "y double, bins binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(rounds):
            inner = (1 << depth) - 1
            tree = Tree(np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(inner + 1))
            for level in range(depth):
                sums = _histograms(binned, model, tree, level, q, len(cols), size)
                for node in range((1 << level) - 1, (2 << level) - 1):
                    if node in sums:
                        tree.column[node], tree.cut[node], _ = _best(sums[node].reshape(len(cols), size, 3), penalty, least)
            value = np.zeros(inner + 1)
            if loss == "pinball":
                for r in column_quantiles(_residuals(binned, model, tree), ["leaf"], ["gap"], [q]).collect():
                    value[r["leaf"]] = r["quantiles"][0]
            else:
                for leaf, total in _histograms(binned, model, tree, depth, q, 1, size).items():
                    g, h, _ = total.reshape(-1, 3).sum(0)
                    value[leaf - inner] = -g / (h + penalty) if h + penalty > 0 else 0.0
            model = replace(model, trees=[*model.trees, replace(tree, value=value)])
    finally:
        binned.unpersist()
    return model


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    y = batch.column(0).to_numpy(zero_copy_only=False)
    return y, np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int16).reshape(len(y), -1)


def _histograms(binned: DataFrame, model: Boosted, tree: Tree, level: int, q: float, columns: int, size: int) -> dict[int, np.ndarray]:
    """By node of a level: sums of gradient, curvature and rows for every column (or the first only) and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, bins = _rows(batch)
            g, h = gradients(model.loss, q, y, model.raw(bins))
            node = tree.at(bins, level)
            for k in np.unique(node).tolist():
                own = node == k
                parts = []
                for j in range(columns):
                    b = bins[own, j]
                    parts.append(np.stack([np.bincount(b, w, size) for w in (g[own], h[own], None)], 1))
                sums = np.concatenate(parts).ravel()
                held[k] = held[k] + sums if k in held else sums
        for k, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * columns, pa.int32()), pa.array(range(columns), pa.int32()), pa.array(list(sums.reshape(columns, -1)), pa.list_(pa.float64()))], names=["node", "column", "sums"])

    sent = binned.mapInArrow(run, "node int, column int, sums array<double>")
    width = size * 3
    rows = vector_sums(sent).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["node"], np.zeros(columns * width))[r["column"] * width : (r["column"] + 1) * width] = r["sums"]
    return out


def _residuals(binned: DataFrame, model: Boosted, tree: Tree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, bins = _rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(bins), pa.int64()), pa.array(y - model.raw(bins))], names=["leaf", "gap"])

    return binned.mapInArrow(run, "leaf long, gap double")
