from __future__ import annotations

import random

import pytest
import xxhash

from tallyspark.llm import simhash
from tallyspark.llm.common import word_chunks
from tallyspark.llm.components import connected_components


def plain_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items: list[tuple[int, int]]) -> dict[int, int]:
    """items: (id, fingerprint); by comparing all pairs."""
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in items:
        for j, g in items:
            if i < j and (f ^ g).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in items}


def test_sf_documents(sf_docs):
    rows = sf_docs.select("doc_id", "text").collect()
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = components(fps)
    for r in simhash.near_duplicates(sf_docs).collect():
        assert (r["fp"] % 2**64, r["component"]) == (dict(fps)[r["id"]], want[r["id"]])


@pytest.mark.parametrize("bucket", [1, 4, 10_000])
def test_links_of_crowded_buckets(spark, monkeypatch, bucket):
    """Chains and clouds of fingerprints, with buckets that are joined and buckets that go by shared neighbours."""
    rng = random.Random(bucket)
    fps = set()
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
        fps |= {f ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    found = connected_components(simhash.fingerprint_links(nodes, bucket)).collect()
    got = dict.fromkeys(range(len(fps)))
    got |= {r["node"]: r["component"] for r in found}
    assert {k: k if v is None else v for k, v in got.items()} == components(list(enumerate(fps)))


def test_rows_without_an_id_link_others(spark, monkeypatch):
    fps = {10: 0, None: 3, 20: 15, 30: 1 << 40 | 1 << 50 | 1 << 60}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id as id", "n as fp"))
    rows = spark.createDataFrame(list(fps.items()), "doc_id long, n long")
    assert {(r["id"], r["component"]) for r in simhash.near_duplicates(rows).collect()} == {(10, 10), (None, 10), (20, 10), (30, 30)}


def test_components_of_a_long_path(spark):
    order = random.Random(1).sample(range(300), 300)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {r["component"] for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.where("a < 0")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    found = simhash.near_duplicates(odd_docs).collect()
    assert sorted((r["id"] is None, r["fp"] % 2**64) for r in found) == sorted((r[0] is None, plain_fingerprint(r[1])) for r in rows)
    by_id = {r["id"]: r["component"] for r in found}
    assert (by_id[2], by_id[3], by_id[7], by_id[5]) == (1, 1, 6, 4)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(11) == 1 and ids.count(None) == 2 and not {2, 3, 5, 7} & set(ids) and {1, 4, 6, 9} <= set(ids)


@pytest.mark.parametrize("text", [b"", b" \n ", b"one", b"one two three four", b"x" * 90 + b" a b c d e", b"a " + b"y" * 90 + b" b " + b"z" * 70, b"  \t" * 40 + b"a b c", b"a b c d " * 30])
def test_chunks_of_words_have_the_shingles_of_the_whole_text(text):
    words = text.split()
    for k in (1, 3, 5):
        chunks = list(word_chunks(text, k - 1, 16))
        got = [tuple(c[i : i + k]) for c in chunks for i in range(max(1, len(c) - k + 1))]
        assert got == [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))][: None if words else 0]
