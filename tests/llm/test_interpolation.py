"""Language-model scores against plain Python over every token."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import interpolation, queries
from tallyspark.llm.interpolation import DELETED, MOST, SETTLED, START

from .conftest import SF


def tokens_of(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def plain(docs: list[tuple[int | None, str | None]], order: int, rounds: int = 40) -> list[tuple]:
    held = [i is not None and crc(str(i)) % 7 == 2 for i, _ in docs]
    deleted = [not h and i is not None and crc(f"deleted{i}") % DELETED == 0 for h, (i, _) in zip(held, docs, strict=True)]
    tokens = [tokens_of(t) for _, t in docs]

    def grams(words, k):
        padded = [""] * (k - 1) + words
        return [tuple(padded[i : i + k]) for i in range(len(words))]

    def count(which):
        counts = [Counter(g for w, on in zip(tokens, which, strict=True) if on for g in grams(w, k)) for k in range(1, order + 1)]
        contexts = [Counter() for _ in range(order)]
        for k in range(order):
            for g, n in counts[k].items():
                contexts[k][g[:-1]] += n
        return counts, contexts

    def parts(words, counts, contexts):
        levels = [grams(words, k) for k in range(1, order + 1)]
        return [[(counts[k][g[k]] / max(contexts[k][g[k][:-1]], 1), contexts[k][g[k][:-1]].bit_length()) for k in range(order)] for g in zip(*levels, strict=True)]

    full, contexts = count([not h for h in held])
    types, total = len(full[0]), sum(full[0].values())
    rest = count([not h and not d for h, d in zip(held, deleted, strict=True)])
    em = [x for w, d in zip(tokens, deleted, strict=True) if d for x in parts(w, *rest)]
    weights = [[0.0] + [START] * 64 for _ in range(order)]
    seen, past = [set() for _ in range(order)], []

    def chain(x):
        p = [1 / (types + 1)]
        for k in range(order):
            w = weights[k][x[k][1]]
            p.append(w * x[k][0] + (1 - w) * p[-1])
        return p

    for _ in range(rounds if em else 0):
        own, below, likelihood = Counter(), Counter(), 0.0
        for x in em:
            p = chain(x)
            likelihood += math.log(p[-1])
            share = 1 / p[-1]
            for k in range(order - 1, -1, -1):
                w = weights[k][x[k][1]]
                below[k, x[k][1]] += share * p[k + 1]
                own[k, x[k][1]] += share * w * x[k][0]
                share *= 1 - w
        past.append(likelihood / len(em))
        for (k, b), n in below.items():
            if b:
                seen[k].add(b)
                if n > 0:
                    weights[k][b] = min(own[k, b] / n, MOST)
        if len(past) > 1 and past[-1] - past[-2] < SETTLED:
            break
    assert all(b >= a - 1e-9 for a, b in zip(past, past[1:], strict=False))
    for level, some in zip(weights, seen, strict=True):
        for b in range(1, len(level)):
            if some and b not in some:
                level[b] = level[min(some, key=lambda x: (abs(x - b), x))]
    out = []
    for (i, _), h, words in zip(docs, held, tokens, strict=True):
        base = sum(math.log10((full[0][(w,)] + 1) / (total + types + 1)) for w in words)
        score = sum(math.log10(chain(x)[-1]) for x in parts(words, full, contexts))
        out.append((i, h, len(words), sum(full[0][(w,)] > 0 for w in words), total, base, score))
    return out


def same(found, want) -> None:
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 4))
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert [x for r in found for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-6)


COLUMNS = ("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def test_query_over_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op11_lm_scoring"](spark, SF)
    assert found.columns == ["doc_id", *COLUMNS[1:]]
    rows = found.collect()
    same(rows, plain(docs, interpolation.ORDER))
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block", [300, 1 << 20])
def test_odd_rows_and_small_blocks(spark, odd_docs, order, block):
    more = spark.range(100, 160).select(F.col("id").alias("doc_id"), F.concat(F.lit("A b a "), (F.col("id") % 7).cast("string"), F.lit(" c b a B")).alias("text"))
    docs = odd_docs.select("doc_id", "text").where("length(text) < 5000 or text is null").unionByName(more)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = interpolation.text_scores(docs.withColumn("row", F.lit("clash")), order=order, block_bytes=block, range_names=64)
    same(found.select(*COLUMNS).collect(), plain(rows, order))


def test_long_texts_over_several_blocks(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = interpolation.text_scores(odd_docs, order=3, block_bytes=50_000, range_names=10_000)
    same(found.select(*COLUMNS).collect(), plain(rows, 3))


def test_without_rows_or_training_documents(spark, no_docs):
    assert interpolation.text_scores(no_docs).collect() == []
    out = [i for i in range(200) if crc(str(i)) % 7 == 2][:3]
    found = interpolation.text_scores(spark.createDataFrame([(i, "a b") for i in out], "doc_id long, text string")).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == [(i, True, 3, 0, 0, 0.0, 0.0) for i in out]
