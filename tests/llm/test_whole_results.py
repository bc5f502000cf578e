"""Results that must not depend on sample sizes, batches, or the scheme of a url."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tallyspark.llm import toxicity, warc

from .test_python_stages import plain_archive


@pytest.mark.parametrize("sample", [3, 1500])
def test_texts_without_words_score_by_the_rate_of_all_training_labels(spark, monkeypatch, sample):
    monkeypatch.setattr(toxicity, "SAMPLE", sample)
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice("abcdefgh") * 5 for _ in range(20)) + " awful" * (k % 8 == 0)) for k in range(100)]
    blank = [(200, None), (201, ""), (202, " \n")]
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(100)], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs + blank, "doc_id long, text string")
    train = [k % 8 == 0 for k in range(100) if zlib.crc32(str(k).encode()) % 5]
    scores = {r["id"]: r["score"] for r in toxicity.toxicity_scores(frame, labels).collect()}
    assert [scores[k] for k, _ in blank] == pytest.approx([sum(train) / len(train)] * 3)
    assert {200, 201, 202} <= {r[0] for r in toxicity.drop_toxic(frame, labels).collect()}


def test_pieces_and_batches_do_not_decide_a_score(monkeypatch):
    rng = np.random.default_rng(2)
    scorer = toxicity.Scorer(toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS), 0.0, 0.25))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)).encode() for n in (60, 81, 94, 103)]
    whole = scorer.score(texts)
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 50)
    assert scorer.score([b"", *texts, b" " * 300]).tolist() == [0.25, *whole, 0.25]
    assert [scorer.score([t])[0] for t in texts] == whole.tolist()


def test_pages_of_any_scheme_have_a_row(spark):
    urls = ["ftp://f/x", "HTTP://A/", "//host/x", "www.host/x", "a/b?c", "Https://b", "dns:a", "filedesc://x", "http://a", "5", "mailto:x y"]
    rows = [(k, f"<p>{k}</p>") for k in range(len(urls))] + [(100 + k, "same") for k in range(len(urls))]
    pages = spark.createDataFrame([(i, urls[i % 100], h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    assert sorted(map(tuple, warc.archive_pages(pages).collect())) == plain_archive(rows)
