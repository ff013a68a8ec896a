import random
from collections import defaultdict

import numpy as np

from tessera.llm import common, suffixes
from tests.llm import data


def brute(texts, length):
    """(repeated, later) spans by a table of all passages."""
    where = defaultdict(set)
    own = {d: (t or "").lower().split() for d, t in enumerate(texts)}
    for d, w in own.items():
        for i in range(len(w) - length + 1):
            where[tuple(w[i : i + length])].add(d)
    out = {}
    for d, w in own.items():
        spans = ([], [])
        for i in range(len(w) - length + 1):
            docs = where[tuple(w[i : i + length])]
            for kind, hit in enumerate((len(docs) > 1, min(docs) < d)):
                if hit:
                    x = spans[kind]
                    if x and i <= x[-1][1]:
                        x[-1][1] = i + length
                    else:
                        x.append([i, i + length])
        if spans[0]:
            out[d] = tuple(",".join(f"{a}:{b}" for a, b in x) for x in spans)
    return out


def corpus():
    rng = random.Random(1)
    passages = [data.words(rng, n) for n in (49, 50, 51, 80, 300)]
    texts = []
    for i in range(60):
        t = data.words(rng, rng.randrange(0, 200))
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t[at:at] = p
        if i % 7 == 0:
            t += ["and", "so"] * rng.randrange(20, 90)  # periodic
        if i % 11 == 0:
            t += (data.words(random.Random(9), 23) + [f"x{i}"] * (i % 2)) * 5
        texts.append(" ".join(t).upper() if i % 5 == 0 else " ".join(t))
    return texts + [texts[3], None, ""]


def test_against_brute_force(spark):
    texts = corpus()
    want = brute(texts, 50)
    for run in (suffixes.RUN, 20):
        got = suffixes.repeated_passages(data.frame(spark, texts), run=run).collect()
        assert {r.doc_id: (r.repeated, r.later) for r in got} == want
        for r in got:
            assert r.repeated_words == sum(int(b) - int(a) for a, b in (x.split(":") for x in r.repeated.split(",")))


def test_words_that_agree_in_16_bits_differ(spark):
    hashes = common.Words().hashes([b"id163", b"id172"]).view(np.uint64) >> np.uint64(48)
    assert hashes[0] == hashes[1]
    rng, texts = random.Random(3), []
    for _ in range(10):
        rest = data.words(rng, 49)
        texts += [" ".join([w, *rest]) for w in ("id163", "id172")] + [" ".join([*rest, w]) for w in ("id163", "id172")]
    assert suffixes.repeated_passages(data.frame(spark, texts)).count() == 0


def test_cut_leaves_one_copy(spark):
    texts = corpus()
    docs = data.frame(spark, texts)
    left = suffixes.cut(docs, suffixes.repeated_passages(docs))
    assert left.columns == docs.columns and left.count() == len(texts)
    shared = suffixes.repeated_passages(left).collect()
    assert all(r.repeated_words < 150 for r in shared)  # what joins anew at a cut
    assert {r.doc_id: r.text for r in left.collect()}[0] == texts[0]


def test_cut_odd_cases(spark):
    docs = data.odd(spark)
    left = suffixes.cut(docs, suffixes.repeated_passages(docs))
    assert left.columns == docs.columns and left.count() == docs.count()
    assert [r.text for r in left.where("doc_id = 7").collect()] == [""]
    assert suffixes.cut(data.empty(spark), suffixes.repeated_passages(docs)).count() == 0


def test_odd_cases(spark):
    got = {r.doc_id: r for r in suffixes.repeated_passages(data.odd(spark)).collect()}
    assert set(got) == {4, 7} and got[7].later == "0:30000" and got[4].later == ""
    assert suffixes.repeated_passages(data.empty(spark)).count() == 0
