"""What the pipeline's Python workers hold at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import common, langid, simhash
from tests.llm import data

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def peak(f) -> float:
    """MB that f allocates and holds at once."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_scores_hold_few_texts():
    texts = [b"some words of a text " * 250] * 400
    logp = np.log(np.random.default_rng(1).random((langid.BUCKETS, 12), np.float32) + 0.1)
    assert peak(lambda: langid.scores(texts, len(texts), logp)) < 30


def test_scores_of_pieces_are_those_of_the_text():
    logp = np.log(np.random.default_rng(2).random((langid.BUCKETS, 3), np.float32) + 0.1)
    texts = [b"", b"a", b"A long one " * 40_000, b"another"]
    ll, n = langid.scores(texts, len(texts), logp)
    for t, own, count in zip(texts, ll, n, strict=True):
        codes = langid._codes(langid._padded(t)) if t else []
        assert count == len(codes)
        np.testing.assert_allclose(own, logp[codes].sum(axis=0, dtype=np.float64) if t else 0)


def test_fingerprints_decode_few_at_once():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 400, np.uint64)) for _ in range(300)]
    assert peak(lambda: simhash.wide_fingerprints(sets)) < 20


def test_fingerprints_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 3, 400, 35_000, 12_000, 2, 700)]
    fp, keys = simhash.wide_fingerprints(sets)
    monkeypatch.setattr(simhash, "WIDE_CHUNK", 100)
    monkeypatch.setattr(simhash, "DECODED", 2)
    again = simhash.wide_fingerprints(sets)
    assert (fp == again[0]).all() and (keys == again[1]).all()


def test_batches_are_small_and_the_setting_comes_back(spark, monkeypatch):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    before, seen, stash = spark.conf.get(KEY), [], common.stash
    with common.batches(spark, 10):
        assert max(r.n for r in spark.range(0, 100, 1, 1).mapInArrow(rows, "n long").collect()) == 10
    assert spark.conf.get(KEY) == before
    monkeypatch.setattr(common, "stash", lambda df: seen.append(spark.conf.get(KEY)) or stash(df))
    docs = data.frame(spark, ["some words of a text", "some words of another text", None])
    assert simhash.dedup(docs).count() == 3 and seen[0] == str(common.BATCH_ROWS)
    seen.clear()
    langid.identify(docs, langid.train(docs))
    assert seen[0] == str(common.BATCH_ROWS) and spark.conf.get(KEY) == before


def test_training_starts_no_workers_for_ids(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("rows of Python take workers of their own")

    docs = data.frame(spark, ["the words of a text", "more words"])
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert langid.train(docs).langs == ["en"] and langid.train(docs.limit(0)).langs == ["und"]
