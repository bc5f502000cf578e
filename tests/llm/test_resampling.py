"""Importance resampling against plain Python: every feature of every text by itself."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tallyspark.llm import queries, resampling

from .conftest import SF


def features(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % 10000


def plain(docs: list[tuple[int | None, str | None]], target: list[str | None]) -> list[tuple]:
    own = Counter(bucket(f) for _, t in docs for f in features(t))
    aim = Counter(bucket(f) for t in target for f in features(t))
    s_all, t_all = sum(own.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10000) / ((own[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows, able = [], []
    for k, (doc_id, text) in enumerate(docs):
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, None])
        if len([x for x in f if " " not in x]) >= 20:
            able.append(k)
    able.sort(key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    for rank, k in enumerate(able[: 5 * len(able) // 100], 1):
        rows[k][4] = rank
    return sorted(map(tuple, rows), key=str)


def result(df) -> list[tuple]:
    return sorted(map(tuple, df.select("id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_over_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    found = queries.QUERIES["op12_importance_resampling"](spark, SF)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, target)


@pytest.mark.parametrize(("block", "size"), [(50, 100), (700, 5_000), (1 << 20, 1 << 20)])
def test_odd_rows_in_small_blocks_and_many_ranges(spark, odd_docs, monkeypatch, block, size):
    if block == 50:  # a long text would make very many blocks
        odd_docs = odd_docs.where("length(text) < 5000 or text is null")
    monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
    monkeypatch.setattr(resampling.windows, "__defaults__", (block,))
    monkeypatch.setattr(resampling, "RANGE_BYTES", size)
    monkeypatch.setattr(resampling, "SPREAD", 4)
    target = ["unique line number 3 which", None, "", "W1 w2 w3 w1"]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = resampling.resample(odd_docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert result(found) == plain(docs, target)


def test_one_word_holds_nearly_all_and_words_are_long(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_BYTES", 300)
    docs = [(k, "the the the " * 30 + f"a{k} " + "Ü" * 70 + " the " + "z" * (k + 40)) for k in range(40)]
    found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([("the the a3",)], "text string"))
    assert result(found) == plain(docs, ["the the a3"])


def test_hot_words_are_spread_over_ranges():
    block = resampling.Block(0)
    block.add(0, 0, True, True, [w for k in range(3000) for w in (b"the", b"x%d" % (k % 50), b"y%d" % k)])
    sizes = {x["range"]: len(x["third"]) // 4 for x in block.rows(8) if x["words"] is not None}
    assert len(sizes) == 8 and max(sizes.values()) < 2 * sum(sizes.values()) / 8


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, none).collect() == []
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert result(resampling.resample(odd_docs, none)) == plain(docs, [])
