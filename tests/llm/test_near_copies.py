"""The pipeline's near copies against all pairs compared."""

from __future__ import annotations

import random

import pytest

from tallyspark.llm import near_copies, simhash


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_all_pairs(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if find(i) == i}


def test_edited_copies_go(spark):
    """Copies with some edited words, around the limit and in large groups; a repeated phrase makes no copy."""
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(12):
        own = new(rng.randint(20, 400))
        for _ in range(rng.randint(2, 25)):
            words = list(own)
            for _ in range(rng.randint(0, max(2, len(own) // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    phrase = "the same five words again " * 400
    rows += [(len(rows) + k, phrase + " ".join(new(60))) for k in range(2)]
    kept = {r[0] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == kept_by_all_pairs(rows)
    assert {len(rows) - 1, len(rows) - 2} <= kept


def test_pairs_that_the_least_node_of_a_bucket_does_not_link(spark, monkeypatch):
    """One fingerprint for all: two copies meet only in a bucket whose least node is neither's copy."""
    rng = random.Random(6)
    monkeypatch.setattr(near_copies, "signature", lambda hashes: (0, near_copies.np.zeros(1, near_copies.np.uint64)))
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(3)]
    rows = [(0, texts[0]), (1, texts[1]), (2, texts[1] + " tail"), (3, texts[2]), (4, texts[2] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0] for r in simhash.keep_one_of_each(docs).collect()} == {0, 1, 3}


@pytest.mark.parametrize("sketch", [1, 24, 512])
def test_sketches_lose_no_pair(spark, monkeypatch, sketch):
    """Copies that meet only in buckets whose least node is no copy of theirs, with sketches that hold a part or all of a set."""
    monkeypatch.setattr(near_copies, "SKETCH", sketch)
    monkeypatch.setattr(near_copies, "SLACK", {1: 0.8, 24: 0.5}.get(sketch, 0.11))
    plain = near_copies.signature
    monkeypatch.setattr(near_copies, "signature", lambda hashes: (plain(hashes)[0], near_copies.np.zeros(1, near_copies.np.uint64)))
    rng = random.Random(7)
    rows = [(0, "a text of its own that is the least node of the only bucket")]
    for _ in range(8):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(8, 300))]
        for _ in range(3):
            words = list(own)
            for _ in range(len(own) // 60):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    monkeypatch.setattr(near_copies, "RADIUS", 64)
    kept = {r[0] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == kept_by_all_pairs(rows)


def test_rows_that_share_an_id(spark):
    """One row of each id stays, always the same."""
    rows = [(1, "b text"), (1, "a text"), (1, "c text"), (2, "one"), (None, "one"), (None, "x")]
    for n in (1, 3, 5):
        kept = simhash.keep_one_of_each(spark.createDataFrame(rows[n:] + rows[:n], "doc_id long, text string").repartition(n)).collect()
        assert len(kept) == 4
        assert n == 1 or {tuple(r) for r in kept} == before
        before = {tuple(r) for r in kept}


def test_candidates_share_bands_of_a_simhash():
    """Every bit of a band is the sign of a sum over the hashes, and sets at the limit share a band."""
    rng = near_copies.np.random.default_rng(8)
    for n in (3, 10, 41):
        hashes = rng.integers(0, 1 << 64, n, near_copies.np.uint64)
        places = near_copies._BAND_BITS.tolist()
        for band, key in enumerate(near_copies.signature(hashes)[1].tolist()):
            assert key >> near_copies.BITS == band
            for bit in range(near_copies.BITS):
                i = places[band * near_copies.BITS + bit]
                total = sum(1 - 2 * (((h % near_copies.SIDE**2 & i).bit_count() + (h >> 63)) % 2) for h in hashes.tolist())
                assert key >> bit & 1 == (total > 0)
    for n in (4, 12, 100):
        for _ in range(200):
            hashes = rng.integers(0, 1 << 64, n + n // 4, near_copies.np.uint64)
            (x, keys), (y, others) = near_copies.signature(hashes[:n]), near_copies.signature(hashes)
            assert set(keys.tolist()) & set(others.tolist()) and (x ^ y).bit_count() <= near_copies.RADIUS


def test_crowded_buckets_and_clusters(spark, monkeypatch):
    """Components that fill buckets, and clusters that are dealt to several tasks."""
    monkeypatch.setattr(near_copies, "CROWD", 2)
    rng = random.Random(9)
    rows = []
    for _ in range(6):
        own = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(16):
            words = list(own)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    kept = {r[0] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == kept_by_all_pairs(rows)


def edited(rng, own, edits):
    words = list(own)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_a_group_just_under_the_limit_makes_no_row_for_each_pair(spark, monkeypatch):
    """400 texts of which few pairs are similar, and some further off: every staged table has some rows for each text."""
    staged, plain = {}, near_copies.stage

    def counted(df, name):
        out = plain(df, name)
        staged[name] = max(staged.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_copies, "stage", counted)
    rng = random.Random(10)
    own = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = list(enumerate(edited(rng, own, 4 if k % 8 else 8) for k in range(400)))
    kept = {r[0] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == kept_by_all_pairs(rows)
    assert max(staged.values()) <= 70 * len(rows) and staged["copies-near"] <= 10 * len(rows)


def test_unlike_texts_in_a_bucket_make_no_row_for_each_pair(spark):
    """Nodes with fingerprints of their own and one band in common."""
    rng = random.Random(11)
    rows = [(k, rng.getrandbits(63), 100, [b << near_copies.BITS | (b != 100 and rng.getrandbits(near_copies.BITS)) for b in range(140)], k, k) for k in range(1500)]
    nodes = spark.createDataFrame(rows, "node long, fp long, n long, keys array<int>, c long, g long")
    assert near_copies.band_pairs(nodes).count() <= 1500


def test_longer_bands_for_more_documents(spark, monkeypatch):
    """Buckets hold CHANCE unlike texts at most, sets at the limit share a band of any length, and the groups are the same."""
    assert [near_copies.bits_for(n) for n in (0, 1, 200_000, 1 << 22, (1 << 22) + 1, 12_000_000)] == [16, 16, 16, 16, 17, 18]
    rng = near_copies.np.random.default_rng(12)
    for bits in (18, 20):
        places = near_copies.band_bits(near_copies.bands_for(bits, True) * bits)
        for n in (4, 12, 100):
            for _ in range(100):
                hashes = rng.integers(0, 1 << 64, n + n // 4, near_copies.np.uint64)
                (_, keys), (_, others) = near_copies.signature(hashes[:n], bits, places), near_copies.signature(hashes, bits, places)
                assert set(keys.tolist()) & set(others.tolist())
    monkeypatch.setattr(near_copies, "CHANCE", 2.0**-12)
    rng = random.Random(13)
    rows = []
    for _ in range(10):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(15, 300))]
        rows += [(len(rows) + k, edited(rng, own, rng.randint(0, len(own) // 40 + 1))) for k in range(6)]
    kept = {r[0] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert near_copies.bits_for(len(rows)) == 18 and kept == kept_by_all_pairs(rows)
