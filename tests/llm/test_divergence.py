"""The source audit on odd rows, against plain Python with exact integers."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import divergence


def plain(rows, min_docs, top):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for lang, source, text in rows]
    df = defaultdict(Counter)
    for lang, _, terms in docs:
        df[lang].update(set(terms))
    out = []
    for lang in {d[0] for d in docs}:
        kept = {t for t, n in df[lang].items() if n >= min_docs}
        v, counts = len(kept), {s: Counter() for s in {d[1] for d in docs if d[0] == lang}}
        for x, s, terms in docs:
            if x == lang:
                counts[s].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        mass = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * v)  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: mass(c[t], sum(c.values())) for t in kept} for s, c in counts.items()}
        q = {t: mass(whole[t], sum(whole.values())) for t in kept}
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("held", [5, 400_000])
def test_against_exact_integers(spark, odd_docs, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    for min_docs in (1, 2, 7, 99):
        got = divergence.source_divergence(odd_docs, min_docs=min_docs)
        assert sorted(map(tuple, got.collect())) == plain(rows, min_docs, 10)


def test_groups_without_terms_ties_and_empty_tables(spark, no_docs):
    rows = [("en", "a", "One two; THREE"), ("en", "b", "12 34 _"), ("en", None, None), ("en", "c", "two two one ö Ö ö"), (None, "a", "1"), (None, "b", ""), ("fr", "only", "x y")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert sorted(map(tuple, divergence.source_divergence(df, min_docs=1, top_terms=2).collect())) == plain(rows, 1, 2)
    assert divergence.source_divergence(no_docs).collect() == []


def test_counts_beyond_longs(spark):
    df = spark.createDataFrame([(10**13, 10**15, 50_000)], "c long, n long, v long")
    assert df.select(divergence.mass(df.c, df.n, df.v)).first()[0] == 1 + 10**9 * (10**13 + 2) // (10**15 + 2 * 50_000)
