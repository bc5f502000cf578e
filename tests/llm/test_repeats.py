from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import repeats


def brute(texts: dict, length: int) -> dict:
    """Removed bytes by counting every string of the length."""
    seen = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out[k] = (len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def got(df):
    return {r["id"]: (r["n_bytes"], sum(x["hi"] - x["lo"] for x in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in df.collect()}


def hard_texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = "abcdefgh "
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [make(n) for n in (399, 400, 401, 480, 493, 650, 2000)]
    texts = ["x" * 1500, "ab" * 900, make(300) * 5, make(3000)]
    for k in range(60):
        parts = [make(rng.randint(0, 700))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, 30)
            parts += [s[cut : len(s) - rng.randint(0, 30)] if rng.random() < 0.5 else s, make(rng.randint(0, 300))]
        text = "".join(parts)
        if k % 5 == 0 and texts:  # a near copy
            base = list(rng.choice(texts))
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = "é"
            text = "".join(base)
        texts.append(text)
    return texts


@pytest.mark.parametrize(("seed", "piece"), [(1, 1 << 20), (2, 700), (3, 150)])
def test_against_brute_force(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    texts = hard_texts(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert got(repeats.remove_repeats(docs)) == brute({k: t.encode() for k, t in enumerate(texts)}, 400)


@pytest.mark.parametrize("piece", [100, 401])
def test_pieces_give_the_same_blocks(monkeypatch, piece):
    texts = [t.encode() for t in hard_texts(4)]
    rows = lambda t: sorted(tuple(map(int, r)) for r in zip(*repeats.blocks_of(t), strict=True))
    whole = [rows(t) for t in texts]
    of, cols = repeats.blocks_of_many(texts)
    assert sorted(zip(of.tolist(), *[c.tolist() for c in cols], strict=True)) == [(k, *map(int, r)) for k, b in enumerate(whole) for r in b]
    assert all(sorted(s for r in b for s in range(r[0], r[1] + 1)) == list(range(len(t) - 399)) for t, b in zip(texts, whole, strict=True))
    monkeypatch.setattr(repeats, "PIECE", piece)
    assert [rows(t) for t in texts] == whole


def plain_passages(texts: dict, words: int = 51) -> dict:
    """Whether a window of words is in another document too."""
    split = {k: t.lower().split() for k, t in texts.items()}
    holders = defaultdict(set)
    for k, w in split.items():
        for i in range(len(w) - words + 1):
            holders[tuple(w[i : i + words])].add(k)
    return {k: any(len(holders[tuple(w[i : i + words])]) > 1 for i in range(len(w) - words + 1)) for k, w in split.items()}


def passages(df):
    return {r["id"]: r["shares_passage"] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_words(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(1, 19)))
    shared = [[word() for _ in range(n)] for n in (50, 51, 52, 60, 130)]
    texts = ["a " * 60, "a " * 70, "a " * 50, "b " * 200, ""]
    for k in range(60):
        parts = [word() for _ in range(rng.randint(0, 60))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            parts += [*s, *(word() for _ in range(rng.randint(0, 60)))]
        texts.append(" ".join(parts).upper() if k % 7 == 0 else " ".join(parts))
    texts += [texts[9], texts[9]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert passages(repeats.remove_repeats(docs)) == plain_passages({k: t.encode() for k, t in enumerate(texts)})


def test_a_very_common_passage_is_spread_over_tasks(spark):
    """One 600-byte passage in 400 texts, each followed by bytes of its own: one core, many hulls, and no task that holds them all."""
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = make(600)
    texts = {k: make(rng.randint(0, 100)) + common + make(rng.randint(0, 100)) for k in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert got(repeats.remove_repeats(docs)) == brute({k: t.encode() for k, t in texts.items()}, 400)
    blocks = repeats.scan(docs.selectExpr("doc_id as id", "cast(text as binary) as bytes"), 400).where("kind = 1")
    dealt = blocks.repartitionByRange(8, "core", "hull_a", "hull_b", "id", "s_lo").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 0.3 * blocks.count()


def test_sf_documents(spark, sf_docs):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in sf_docs.collect()}
    found = repeats.remove_repeats(sf_docs)
    assert got(found) == brute(texts, 400)
    assert passages(found) == plain_passages(texts)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    want = brute(dict(enumerate(t for _, t in rows)), 400)
    key = lambda x: (x[0] is None, str(x))
    found = repeats.remove_repeats(odd_docs).collect()
    found = sorted([(r["id"], r["n_bytes"], sum(x["hi"] - x["lo"] for x in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in found], key=key)
    assert found == sorted([(i, *want[k]) for k, (i, _) in enumerate(rows)], key=key)
    assert repeats.remove_repeats(no_docs).count() == 0
