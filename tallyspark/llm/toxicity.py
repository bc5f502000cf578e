"""Toxicity: embeddings of words and character n-grams, averaged into a linear softmax, trained jointly in numpy.

A text is cut into bags of BAG words; a bag's vector is the mean of the embeddings of its words and their character
n-grams, all hashed into BUCKETS rows, and a softmax layer on it gives the bag's probability. A document scores as its
most toxic bag, so a few insults count the same in a short and in a very long text. Embeddings and the layer are learned
together by gradient descent: in every step each training document sends its highest bag (in the first steps, any bag)
through the softmax. A misspelling that was never seen shares n-grams with words that were.

Scoring needs no embeddings on the executors: a bag's logit is the mean of one number for each n-gram (its embedding
times the layer's weights), so BUCKETS floats are broadcast, a fixed size.

Training reads a bounded sample of the labelled rows: SAMPLE of each class at most, in the order of a hash of the id, texts
of up to SAMPLE_BYTES bytes and SAMPLE_TOTAL bytes of them. Scores are given to all rows and whole texts.

Texts of more than two pieces (8 MB) are scored piece by piece, so their words need no more memory than one; bags run on
across pieces.

Edge cases: null and empty texts (and texts without words) score as the share of label 1 among all training labels, before the
sample is drawn, and 0 if there is no training row; rows without an id are scored, and are not held out; if training rows have a single label, all texts
with words score 0.0 or 1.0 by it; if no sampled text of one of the labels has a word, texts with words score as the sample's share of label 1; labels other than 0 and 1 and null labels are left out of training; repeated rows score alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Numbers, by_bytes, keep_rows, maybe_in, pieces_at_blanks, stage, utf8

BUCKETS = 1 << 17
NGRAMS = (3, 4, 5)
BAG = 4
DIM = 4
SAMPLE = 1500
SAMPLE_BYTES = 1 << 18
#: Bytes of the sampled texts of a class, in the order of the sample.
SAMPLE_TOTAL = 1 << 25
STEPS = 80
RATE = 1000.0
LAYER_RATE = 0.5
MOMENTUM = 0.8
LIMIT = 1e4
SEED = 20
#: Words whose features are kept in a Python worker; when full, it starts anew.
CACHE_WORDS = 400_000
#: Words whose features are made at a time.
FEATURE_WORDS = 1 << 14

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the words, one after the other, and how many each has: the word itself and its n-grams."""
    parts = [_features(words[at : at + FEATURE_WORDS]) for at in range(0, len(words), FEATURE_WORDS)]
    return np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts])


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    marked = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    word_of = np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(marked), _BASE, np.uint64)) if len(marked) else marked
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((marked + np.uint64(1)) * power, dtype=np.uint64)))
        # the hash of a span must not depend on where it is: bring each to the same power
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        back = np.cumprod(np.full(len(marked), inverse, np.uint64)) if len(marked) else marked
        at = end - size
        spans, owners = [(sums[end] - sums[at]) * back[at]], [np.arange(len(words))]
        place = np.arange(len(marked))
        for n in NGRAMS:
            ok = place + n < end[word_of]
            ok |= (place + n == end[word_of]) & (size[word_of] != n)
            begin = place[ok]
            spans.append((sums[begin + n] - sums[begin]) * back[begin] + np.uint64(n))
            owners.append(word_of[ok])
        hashes, owner = np.concatenate(spans), np.concatenate(owners)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX
    order = np.argsort(owner, kind="stable")
    rows = ((hashes >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)[order]
    return rows, np.bincount(owner, minlength=len(words))


@dataclass
class Model:
    """weight: one number for each feature row, already times the layer; bias; base: the score of a text without words."""

    weight: np.ndarray
    bias: float
    base: float

    def word_sums(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows, counts = word_features(words)
        return np.add.reduceat(self.weight[rows].astype(np.float64), np.cumsum(counts) - counts), counts


def _bags(n_words: int) -> np.ndarray:
    return np.arange(0, n_words, BAG)


class Scorer:
    """Scores texts; features of words are computed once for each word while the cache lasts."""

    def __init__(self, model: Model):
        self.model, self.index = model, Numbers()
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        long = [len(t) > 2 * PIECE_BYTES for t in texts]
        top = self._top([] if piecewise else t.lower().split() for t, piecewise in zip(texts, long, strict=True))
        for k in np.flatnonzero(long):
            top[k] = self._top_of_long(texts[k])
        return np.where(np.isneginf(top), self.model.base, 1 / (1 + np.exp(-np.clip(top, -30.0, 30.0))))

    def _top_of_long(self, text: bytes) -> float:
        top, held = -np.inf, []
        for piece in pieces_at_blanks(text, PIECE_BYTES):
            held += piece.lower().split()
            whole = len(held) - len(held) % BAG
            top, held = max(top, self._top([held[:whole]])[0]), held[whole:]
        return max(top, self._top([held])[0])

    def _top(self, texts: Iterable[list[bytes]]) -> np.ndarray:
        """The highest logit among the bags of each list of words; without words minus infinity."""
        if len(self.index) > CACHE_WORDS:
            self.index, self.sums, self.counts = Numbers(), np.zeros(0), np.zeros(0)
        known, index = len(self.index), self.index
        ids = [list(map(index.__getitem__, words)) for words in texts]
        out = np.full(len(ids), -np.inf)
        if fresh := list(islice(index, known, None)):
            sums, counts = self.model.word_sums(fresh)
            self.sums, self.counts = np.concatenate((self.sums, sums)), np.concatenate((self.counts, counts))
        for k, words in enumerate(ids):
            if words:
                w, at = np.array(words), _bags(len(words))
                logit = np.add.reduceat(self.sums[w], at) / np.add.reduceat(self.counts[w], at) + self.model.bias
                out[k] = logit.max()
        return out


def train(texts: list[bytes], labels: list[int], steps: int = STEPS) -> Model:
    """Embeddings and softmax layer, fitted together by gradient descent with momentum on the documents' highest bags; classes weigh the same."""
    y = np.array(labels, np.float64)
    base = float(y.mean()) if len(y) else 0.0
    if not len(y) or base in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), -30.0 if not len(y) or base == 0 else 30.0, base)
    keep = [k for k, t in enumerate(texts) if t.split()]
    y = y[keep]
    if not keep or y.min() == y.max():  # no text of a label has a word: nothing tells words of one label from those of the other
        return Model(np.zeros(BUCKETS), math.log(base / (1 - base)), base)
    index: dict[bytes, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in texts[k].lower().split()]) for k in keep]
    rows, counts = word_features(list(index))
    first = np.cumsum(counts) - counts
    word_at, bag_at, bag_doc = [], [0], []
    for doc, w in enumerate(ids):
        for at in _bags(len(w)):
            word_at.append(w[at : at + BAG])
            bag_at.append(bag_at[-1] + len(word_at[-1]))
            bag_doc.append(doc)
    words, bag_at, bag_doc = np.concatenate(word_at), np.array(bag_at[:-1]), np.array(bag_doc)
    del word_at
    doc_at = np.searchsorted(bag_doc, np.arange(len(ids)))
    bag_size = np.diff(np.append(bag_at, len(words)))
    bag_features = np.add.reduceat(counts[words], bag_at)
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    layer[:] = rng.normal(0, 1.0, layer.shape)
    speed = [np.zeros_like(x) for x in (emb, layer, bias)]
    for step in range(1, steps + 1):
        z = emb @ (layer[:, 1] - layer[:, 0]).astype(np.float32)
        if step <= steps // 12:
            pick = doc_at + rng.integers(0, np.bincount(bag_doc, minlength=len(ids)))
        else:
            word_z = np.add.reduceat(z[rows], first)
            logit = np.add.reduceat(word_z[words], bag_at) / bag_features
            order = np.lexsort((-logit, bag_doc))
            pick = order[doc_at]
        at = np.concatenate([np.arange(bag_at[b], bag_at[b] + bag_size[b]) for b in pick])
        w = words[at]
        per = counts[w]
        start = np.cumsum(per) - per
        flat = rows[np.repeat(first[w] - start, per) + np.arange(per.sum())]
        size = bag_features[pick]
        bag = np.repeat(np.arange(len(pick)), size)
        mean = np.stack([np.bincount(bag, emb[flat, d], len(pick)) for d in range(DIM)], 1) / size[:, None]
        logits = mean @ layer + bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        g = (p - np.stack((1 - y, y), 1)) * share[:, None]
        g_mean = (g @ layer.T) / size[:, None]
        g_emb = np.stack([np.bincount(flat, g_mean[bag, d], BUCKETS) for d in range(DIM)], 1).astype(np.float32)
        for x, grad, v, rate in zip((emb, layer, bias), (g_emb, mean.T @ g, g.sum(0)), speed, (RATE, LAYER_RATE, LAYER_RATE), strict=True):
            v *= MOMENTUM
            v -= rate * grad
            x += v
            np.clip(x, -LIMIT, LIMIT, out=x)  # a handful of texts can make steps that grow without end
    return Model((emb @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]), base)


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y): the labels 0 and 1 of rows that are not held out."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~_held_out(id_col))
    return marks.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, bytes, y): at most SAMPLE texts of each label, from rows that are not held out."""
    marks = training_labels(labels, id_col, label_col)
    order = [F.crc32(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary")), F.col("id")]
    chosen = marks.where("y = 1").orderBy(*order).limit(SAMPLE).unionByName(marks.where("y = 0").orderBy(*order).limit(SAMPLE))
    chosen = stage(chosen, "toxicity-sample")
    texts = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("bytes")).where(F.octet_length("bytes") <= SAMPLE_BYTES)
    found = maybe_in(texts, "id", chosen, "id").join(chosen, "id").select("id", "bytes", "y")
    so_far = F.sum(F.octet_length("bytes")).over(W.partitionBy("y").orderBy(*order, "bytes").rowsBetween(W.unboundedPreceding, 0))
    return found.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_TOTAL).drop("so_far")


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains in one task, on the bounded sample; only BUCKETS floats come back. Texts without words get the rate of all training labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["id"], r["bytes"], r["y"]) for batch in batches for r in batch.to_pylist())
        model = train([r[1] for r in rows], [r[2] for r in rows])
        weight = model.weight.astype("<f4").tobytes()
        yield pa.RecordBatch.from_pylist([{"weight": weight, "bias": model.bias}])

    sample = training_sample(docs, labels, id_col, text_col, label_col).repartition(1)
    row = sample.mapInArrow(run, "weight binary, bias double").collect()
    if not row:
        return train([], [])
    rate = training_labels(labels, id_col, label_col).agg(F.avg("y")).first()[0]
    return Model(np.frombuffer(row[0]["weight"], "<f4"), row[0]["bias"], rate or 0.0)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score): every document's probability of label 1, from its text alone.

    Rows with crc32(id as text) mod 5 = 0 are held out: their labels are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            scores = [scorer.score(texts) for texts in by_bytes(t.as_py() for t in batch.column(1))]
            scores = np.concatenate([*scores, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores)], names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("bytes"), _held_out(id_col).alias("held_out"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, with or without an id."""
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, id_col, text_col))

    def make():
        scorer = Scorer(model.value)
        return lambda texts: (scorer.score(texts) < threshold).tolist()

    return keep_rows(docs, text_col, make)
