"""Exact deduplication, sharding, line deduplication and mixing, against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, exact_dedup, line_dedup, mixing, sharding

KEY = lambda x: (x[0] is None, str(x))


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in by[norm(t)] if x is not None]
        keep = min(ids, default=None)
        out.append((i, keep, len(by[norm(t)]), i is not None and i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=KEY)


@pytest.mark.parametrize("table", ["odd_docs", "sf_docs", "no_docs"])
def test_exact_duplicates(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=KEY) == plain_groups(rows)


def test_texts_that_share_a_digest_stay_apart(spark, monkeypatch):
    """With a digest of two values, only the byte verification can tell texts apart."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lpad(F.hex(F.length(c) % 2), 64, "0"))
    rows = [(k, "abcdefg"[: k % 7]) for k in range(40)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], r["keep_id"], r["group_size"]) for r in found} == {(k, k % 7, sum(1 for j in range(40) if j % 7 == k % 7)) for k in range(40)}


def test_a_row_is_ruled_out_by_the_filter_of_its_run(spark):
    """Runs without a digest of several rows are read by nobody; in the others few rows ask that find nothing."""
    rows = [(k, str(k)) for k in range(4000)] + [(5000 + k, str(k)) for k in range(40)]
    texts = exact_dedup.digests_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    digests = texts.select((F.col("id") % 5).alias("memtable"), "id", "digest").cache()
    entries = exact_dedup.flush(digests)
    assert entries.count() == digests.select("memtable", "digest").distinct().count()
    level = exact_dedup.compact(entries, 64)
    assert level.groupBy("run").agg(F.min("digest"), F.max("digest")).count() == 64
    found = exact_dedup.look_up(digests, level, 64).collect()
    read = {r["id"] for r in found if r["asked"]}
    assert {k for k in range(40)} | {5000 + k for k in range(40)} <= read and len(read) < 200
    assert {(r["id"], r["keep_id"], r["n"]) for r in found if r["n"]} == {(i, k, 2) for k in range(40) for i in (k, 5000 + k)}
    with_hits = {r["run"] for r in level.where("n > 1").collect()}
    asked = {r["run"] for r in digests.where(F.col("id").isin(list(read))).select(exact_dedup.run_of(F.col("digest"), 64).alias("run")).collect()}
    assert asked == with_hits and len(with_hits) < 64
    plan = plan_of(exact_dedup.merged(entries, 64))
    assert "Window [" in plan and plan.index("Sort [") < plan.index("RepartitionByExpression")


def test_memtables_of_few_rows(spark, monkeypatch, sf_docs):
    rows = [(r[0], r[1]) for r in sf_docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 16)
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 8)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(sf_docs).collect()), key=KEY) == plain_groups(rows)


def test_filters_are_sized_by_their_members(spark):
    members = spark.range(100_000).select((F.col("id") * 7).alias("k"))
    probe = spark.range(700_000).select(F.col("id").alias("k"))
    flagged = common.flag_maybe_in(probe, "k", members, "k", "maybe")
    hits = flagged.where("maybe").select((F.col("k") % 7 == 0).alias("member")).groupBy("member").count().collect()
    counts = {r["member"]: r["count"] for r in hits}
    assert counts[True] == 100_000 and counts.get(False, 0) < 0.05 * 600_000
    assert common.flag_maybe_in(spark.createDataFrame([(None,), (3,)], "k long"), "k", members.limit(0), "k", "maybe").where("maybe").count() == 0


def plain_lines(rows, least=40, docs=5):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders, keeper = defaultdict(set), {}
    for n, (i, lines) in enumerate(split):
        for k in map(key, lines):
            if len(k) >= least:
                holders[k].add(i if i is not None else f"row {n}")
                if i is not None:
                    keeper[k] = max(keeper.get(k, i), i)
    out = []
    for i, lines in split:
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < docs or keeper[key(x)] == i or len(key(x)) < least]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=KEY)


@pytest.mark.parametrize("table", ["odd_docs", "sf_docs", "no_docs"])
def test_lines(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    found = line_dedup.drop_lines(docs)
    assert sorted(map(tuple, found.collect()), key=KEY) == plain_lines(rows)


def test_lines_beyond_one_word_of_the_bitmap(spark):
    common = [f"line {k} is the same in all of these documents, and it is long" for k in range(0, 200, 3)]
    rows = [(i, "\n".join(common[k // 3] if k % 3 == 0 else f"{i} {k}" for k in range(200))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.drop_lines(docs).collect()
    assert sorted(map(tuple, found)) == plain_lines(rows)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_sorted_stream_decides_which_document_keeps_a_line(spark):
    """Two keys that run over several partitions, and the first document of a key in another partition than most of its lines."""
    hot, warm = "this line is in every document, and it is long enough", "this one is in every third document, and it is long enough"
    texts = {i: "\n".join([hot, *[warm] * (i % 3 == 0), f"{i}", hot][: 2 + i % 3]) for i in range(3000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = line_dedup.drop_lines(docs).collect()
    assert sorted(map(tuple, found), key=KEY) == plain_lines(list(texts.items()))
    lines = spark.createDataFrame([(i, i, p, k, 0) for i in range(500) for p, k in enumerate((1, 1, i % 2))], "row long, id long, pos int, a long, b long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stream = line_dedup.sorted_stream(lines)
    assert max(r["parts"] for r in stream.groupBy("a").agg(F.countDistinct("part").alias("parts")).collect()) > 1
    firsts = {(r["id"], r["first_id"], r["pos"]) for r in line_dedup.with_first_document(stream).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert firsts == {(i, 499 if p < 2 or i % 2 else 498, p) for i in range(500) for p in range(3)}
    plan = plan_of(stream)
    assert plan.index("Sort [") < plan.index("RepartitionByExpression")


def test_rows_that_share_an_id_have_bitmaps_of_their_own(spark):
    line = "a line that five documents have, which is long enough to count"
    rows = [(1, f"{line}\nb"), (1, f"c\nd\n{line}\ne"), *[(k, line) for k in range(2, 7)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.drop_lines(docs).collect()), key=KEY) == plain_lines(rows)


def test_shards(spark, sf_docs):
    docs = sf_docs.selectExpr("doc_id", "text").unionByName(spark.range(1000, 21_000).selectExpr("id as doc_id", "'x' as text"))
    rows = sharding.assign_shards(docs).collect()
    texts = {r[0]: (r[1] or "").encode() for r in docs.collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["id"]]) + 16, zlib.crc32(texts[r["id"]])) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    moved = sum(r["grown_shard"] == 40 for r in rows)
    assert abs(moved / len(rows) - 1 / 41) < 0.006
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append((r["slot"], r["id"]))
    assert sorted(by) == list(range(40)) and all([s for s, _ in sorted(x)] == list(range(len(x))) and sorted(x) == sorted(x, key=lambda y: y[1]) for x in by.values())
    assert max(map(len, by.values())) < 1.3 * len(rows) / 40
    again = sharding.assign_shards(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def plain_shard(key, tree):
    """The tree's draws in plain Python."""
    unit = lambda name: (int(hashlib.md5(f"{name}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    pick = lambda names, weights: max(range(len(names)), key=lambda i: math.log(unit(names[i])) / weights[i]) if len(names) > 1 else 0
    r = pick([f"region{i}" for i in range(len(tree.regions))], [sum(map(sum, x)) for x in tree.regions])
    racks = tree.regions[r]
    k = pick([f"region{r}/rack{i}" for i in range(len(racks))], [sum(x) for x in racks])
    s = pick([f"region{r}/rack{k}/shard{i}" for i in range(len(racks[k]))], racks[k])
    return sum(len(rack) for region in tree.regions[:r] for rack in region) + sum(len(rack) for rack in racks[:k]) + s


def test_draws_against_plain_python(spark):
    tree = sharding.Tree((((1.0, 2.0), (3.0,)), ((1.0, 1.0, 0.5),)))
    key = F.col("id").cast("string")
    rows = spark.range(3000).select("id", sharding.shard_of(key, tree).alias("s")).withColumn("g", sharding.grown_shard_of(key, F.col("s"), tree, 2.0)).collect()
    assert [(r["s"], r["g"]) for r in rows] == [(plain_shard(r["id"], tree), plain_shard(r["id"], tree.grown(2.0))) for r in rows]


def test_a_weight_that_changes_moves_rows_of_its_subtree_only(spark):
    tree = sharding.even_tree(2, 2, 3)
    heavier = sharding.Tree((((1.0, 1.0, 2.0), (1.0, 1.0, 1.0)), tree.regions[1]))
    keys = spark.range(20_000).select(sharding.shard_of(F.col("id").cast("string"), tree).alias("a"), sharding.shard_of(F.col("id").cast("string"), heavier).alias("b"))
    moves = Counter(tuple(r) for r in keys.where("a <> b").collect())
    # into region 0 from region 1, into rack 0 from rack 1 of region 0, into shard 2 from the rest of its rack
    assert all((a >= 6 and b < 6) or (3 <= a < 6 and b < 3) or (a < 3 and b == 2) for a, b in moves)


def test_odd_rows_get_shards(odd_docs, no_docs):
    rows = sharding.assign_shards(odd_docs).collect()
    assert len(rows) == odd_docs.count() and len({r["shard"] for r in rows if r["id"] is None}) == 1 and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert sharding.assign_shards(no_docs).count() == 0
    assert sharding.shard_documents(odd_docs).columns == odd_docs.columns and sharding.shard_documents(odd_docs.drop("size")).columns == [*odd_docs.drop("size").columns, "size"]


def poisson(u, mean):
    k, p, c = 0, math.exp(-mean), math.exp(-mean)
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def plain_mix(rows):
    size = Counter()
    for _, s, t in rows:
        size[s] += len((t or "").encode())
    weights = {s: n**0.5 for s, n in size.items()}
    out = []
    for i, s, _ in rows:
        rate = 1.0 if size[s] == 0 else weights[s] / sum(weights.values()) * sum(size.values()) / size[s]
        parts = max(1, math.ceil(rate / 64))
        unit = lambda p: (int(hashlib.md5(f"10|{'' if i is None else i}|{p}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52  # noqa: B023, E731
        out += [(i, c) for c in range(sum(poisson(unit(p), rate / parts) for p in range(1, parts + 1)))]
    return sorted(out, key=KEY)


@pytest.mark.parametrize("table", ["odd_docs", "sf_docs", "no_docs"])
def test_mix(request, table):
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    found = mixing.mix(docs)
    assert sorted(((r["doc_id"], r["copy"]) for r in found.collect()), key=KEY) == plain_mix(rows)
    assert set(docs.columns) <= set(found.columns)


def test_mix_to_given_shares_with_large_rates(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id < 10, 'small', if(id < 20, null, 'large')) as source", "repeat('x', 100) as text")
    found = mixing.mix(docs, shares={"small": 3.0, None: 1.0, "large": 0.0}).groupBy("source").count().collect()
    got = {r[0]: r[1] for r in found}
    assert "large" not in got and abs(got["small"] - 2250) < 250 and abs(got[None] - 750) < 150


def test_mix_has_many_sources_without_a_broadcast(spark, monkeypatch, sf_docs):
    want = sorted((r["doc_id"], r["copy"]) for r in mixing.mix(sf_docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted((r["doc_id"], r["copy"]) for r in mixing.mix(sf_docs).collect()) == want
