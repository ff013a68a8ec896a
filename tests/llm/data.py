"""Small tables with planted copies, and a table of every odd case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, texts, **columns):
    """documents with ids from 0; texts may hold None."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd(spark):
    """Nulls in every column, empty texts, white space, a very long text, ties and repeated rows, clashing extra columns."""
    rng = random.Random(4)
    long = " ".join(words(rng, 30_000))
    rows = [
        (1, None, None, None, None), (None, "some words without an id", "en", "s", 1), (2, "", "", "", 0), (3, " \n\t", "en", "s", 3), (4, long, "en", "s", len(long)),
        (5, "a tie", "en", "s", 5), (5, "a tie", "en", "s", 5), (6, "a tie", None, "s", 5), (7, long, "xx", None, len(long)), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("key", "fp", "hash", "h", "n", "part", "a", "b", "c", "shard", "found", "words", "start", "best", "label", "__id", "own_id", "own_lang", "kept", "out_id", "later", "m", "p", "item_id", "source_")
    for c in clash:
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
