"""Shapley values of predictions: exact for Spark's tree ensembles, by the path-dependent rule, and in closed form for linear models.

Of a leaf's path each column has two numbers: whether the row meets all of its splits, and the share of training rows that do. The value of a set of
columns is the leaf's value where the row meets the splits of the set, times the shares of the others; a column's contribution is the mean of what
it adds over all orders of joining. It depends only on which of the path's columns the row meets, so a leaf of k columns has a table of 2^k x k
numbers, made once, and a row looks its line up. Contributions and base add up to the prediction (for gradient-boosted classifiers and
logistic models to the margin).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths over more columns than this are worked out by row instead of by a table.
TABLE_COLUMNS = 10


@dataclass
class Leaf:
    """low and high: the row meets a column's splits if low < x <= high; share: of the rows that come to its splits, those that do."""

    value: float
    columns: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def _size(node) -> float:
    stats = np.array(list(node.impurityStats().stats()))
    return float(stats[0]) if len(stats) == 3 and "Variance" in node.impurityStats().getClass().getSimpleName() else float(stats.sum())


def _value(node, classify: bool) -> float:
    if classify:
        stats = np.array(list(node.impurityStats().stats()))
        return float(stats[1] / stats.sum()) if stats.sum() else 0.0
    return float(node.prediction())


def leaves_of(root, classify: bool) -> list[Leaf]:
    """The leaves of a fitted Spark tree, whose splits are on numbers or on the columns of one-hot codes."""
    out: list[Leaf] = []
    todo = [(root, {})]
    while todo:
        node, path = todo.pop()
        if node.getClass().getSimpleName() == "LeafNode":
            items = sorted(path.items())
            columns = np.array([c for c, _ in items], np.int64)
            out.append(Leaf(_value(node, classify), columns, *(np.array([x[k] for _, x in items], float) for k in range(3))))
            continue
        split = node.split()
        c, whole = int(split.featureIndex()), _size(node)
        below, above = node.leftChild(), node.rightChild()
        if "Continuous" in split.getClass().getSimpleName():
            t = float(split.threshold())
        else:  # a column of a one-hot code, known to have 0 and 1 only
            left = sorted(split.leftCategories())
            if len(left) != 1 or left[0] not in (0.0, 1.0) or len(list(split.rightCategories())) != 1:
                raise ValueError("splits on more than two categories are not explained: encode them as columns")
            t = 0.5
            below, above = (below, above) if left[0] == 0.0 else (above, below)
        low, high, share = path.get(c, (-np.inf, np.inf, 1.0))
        for child, lo, hi in ((below, low, min(high, t)), (above, max(low, t), high)):
            todo.append((child, path | {c: (lo, hi, share * (_size(child) / whole if whole else 0.5))}))
    return out


def contributions_of(meets: np.ndarray, leaf: Leaf) -> np.ndarray:
    """Rows x columns of the path: what each adds to the leaf's value. meets: rows x columns, 0 or 1."""
    n, k = meets.shape
    weights = [factorial(s) * factorial(k - 1 - s) / factorial(k) for s in range(k)]
    out = np.zeros((n, k))
    for j in range(k):
        # of the other columns' product of (share + meets t), the coefficient of t^s sums up the sets of s columns
        sets = np.zeros((n, k))
        sets[:, 0] = 1
        for i in range(k):
            if i != j:
                sets[:, 1:] = sets[:, 1:] * leaf.share[i] + sets[:, :-1] * meets[:, i : i + 1]
                sets[:, 0] *= leaf.share[i]
        out[:, j] = leaf.value * (meets[:, j] - leaf.share[j]) * (sets @ weights)
    return out


class Explainer:
    """Contributions of an ensemble: the weighted sum of its trees' leaves."""

    def __init__(self, trees: list[list[Leaf]], weights: list[float], n_columns: int):
        self.n_columns, self.leaves, self.base = n_columns, [], 0.0
        for leaves, weight in zip(trees, weights, strict=True):
            for leaf in leaves:
                leaf = Leaf(leaf.value * weight, leaf.columns, leaf.low, leaf.high, leaf.share)
                self.base += leaf.value * float(np.prod(leaf.share))
                k = len(leaf.columns)
                table = None
                if 0 < k <= TABLE_COLUMNS:
                    codes = np.arange(1 << k)
                    table = contributions_of(((codes[:, None] >> np.arange(k)) & 1).astype(float), leaf)
                if k:
                    self.leaves.append((leaf, table))

    def explain(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.n_columns))
        for leaf, table in self.leaves:
            values = x[:, leaf.columns]
            meets = (leaf.low < values) & (values <= leaf.high)
            if table is None:
                out[:, leaf.columns] += contributions_of(meets.astype(float), leaf)
            else:
                out[:, leaf.columns] += table[meets @ (1 << np.arange(len(leaf.columns)))]
        return out


def explainer_of(model, classify: bool) -> Explainer:
    """Of a fitted tree, forest or boosted ensemble of Spark. A boosted classifier's margin is that of its own raw prediction."""
    kind = type(model).__name__
    trees = list(model.trees) if hasattr(model, "trees") else [model]
    boosted = kind.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1 / len(trees)] * len(trees)
    leaves = [leaves_of(t._java_obj.rootNode(), classify and not boosted) for t in trees]
    return Explainer(leaves, weights, model.numFeatures)


def slots_of(pipeline: PipelineModel, numeric: list[str], categorical: list[str] | None = None) -> list[str]:
    """The column that each slot of the feature vector belongs to; a one-hot column has several."""
    sizes = {s.getInputCol(): s.categorySizes[0] - s.getDropLast() for s in pipeline.stages if type(s).__name__ == "OneHotEncoderModel"}
    return [*numeric, *[c for c in categorical or [] for _ in range(sizes[f"__i_{c}"])]]


def shap_values(pipeline: PipelineModel, df: DataFrame, numeric: list[str], classify: bool, categorical: list[str] | None = None, background: DataFrame | None = None) -> DataFrame:
    """``df`` with base and contributions, a map from each column to what it adds to the prediction.

    Trees need nothing more; a linear model is explained against the mean row of ``background`` (the training rows), or of ``df`` without one.
    """
    model, slots = pipeline.stages[-1], slots_of(pipeline, numeric, categorical)
    names = list(dict.fromkeys(slots))
    owner = np.array([names.index(s) for s in slots])
    if hasattr(model, "coefficients"):
        coefs = np.array(model.coefficients.toArray())
        mean = np.array(pipeline.transform(background if background is not None else df).select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray())
        base, explain = float(model.intercept + coefs @ mean), lambda x: (x - mean) * coefs
    else:
        own = explainer_of(model, classify)
        base, explain = own.base, own.explain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            features = batch.column(batch.num_columns - 1)
            x = features.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            parts = explain(x)
            sums = np.zeros((len(x), len(names)))
            np.add.at(sums.T, owner, parts.T)
            columns = [*batch.columns[:-1], pa.array(np.full(len(x), base)), pa.array(list(sums), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__base", "__sums"])

    kept = pipeline.transform(df).select(*df.columns, vector_to_array("features").alias("__features"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "__base double, __sums array<double>"])
    found = kept.mapInArrow(run, schema)
    keys = F.array(*[F.lit(n) for n in names])
    return found.select(*df.columns, F.col("__base").alias("base"), F.map_from_arrays(keys, "__sums").alias("contributions"))
