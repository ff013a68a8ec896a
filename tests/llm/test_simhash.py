import random

import numpy as np
import xxhash

from tessera.llm import simhash
from tests.llm import data


def brute(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    own = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, near=3):
    """Smallest index reachable."""
    todo, out = set(range(len(fps))), {}
    while todo:
        first = min(todo)
        stack = [first]
        todo.discard(first)
        while stack:
            x = stack.pop()
            out[x] = first
            hit = {y for y in todo if (fps[x] ^ fps[y]).bit_count() <= near}
            todo -= hit
            stack += hit
    return out


def test_any_two_words_near_by_share_a_key():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 300, np.uint64)
    for n in (0, 1, 2, 3):
        other = fp.copy()
        for i in range(len(fp)):
            for b in rng.choice(64, n, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        keys = [[set(), set()] for _ in fp]
        for side, x in enumerate((fp, other)):
            for r, k in zip(*simhash.keys(x.view(np.int64)), strict=True):
                keys[r][side].add(int(k))
        assert all(a & b for a, b in keys)


def test_near_pairs_connect_all(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    fps = {int(x) for x in base}
    for _ in range(400):
        x = int(rng.choice(list(fps)))
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x & (1 << 63) - 1)
    fps = sorted(fps)
    want = components(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    at = {x: i for i, x in enumerate(fps)}
    for block in (simhash.BLOCK, 5):
        pairs = [(at[r.a], at[r.b]) for r in simhash.near_pairs(df, block=block).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in pairs)
        got = {i: i for i in range(len(fps))}

        def find(x):
            while got[x] != x:
                x = got[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            got[y] = x
        assert {i: find(i) for i in got} == want


def test_documents(spark):
    rng = random.Random(3)
    texts = [" ".join(data.words(rng, rng.randrange(0, 80))) for _ in range(50)]
    texts += [texts[3], texts[4].upper(), texts[5] + " end", "A", "a", "ÄÖ x\x0by", None, "", " "]
    fps = [brute(t) for t in texts]
    comp = components(fps)
    got = simhash.near_duplicates(data.frame(spark, texts)).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{x:016x}", comp[i]) for i, x in enumerate(fps)}
    kept = simhash.dedup(data.frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))


def test_odd_cases(spark):
    docs = data.odd(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[7].component_id == 4 and by[6].component_id == 5
    assert simhash.dedup(docs).columns == docs.columns
    assert sorted(r.doc_id for r in simhash.dedup(docs).where("doc_id is not null").collect()) == [1, 4, 5]
    assert simhash.near_duplicates(data.empty(spark)).count() == 0 == simhash.dedup(data.empty(spark)).count()


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_dedup_against_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        base = data.words(rng, rng.randrange(30, 300))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(own)
    root, links = list(range(len(texts))), []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links.append((j, i))
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = data.frame(spark, [" ".join(t) for t in texts])
    for block, size in ((20_000, 1 << 26), (2, 1 << 26), (20_000, 3000)):
        kept = {r.doc_id for r in simhash.dedup(docs, block=block, size=size).collect()}
        assert want <= kept and len(kept - want) <= 0.1 * len(set(range(len(texts))) - want), kept - want


def test_dedup_keeps_one_row_of_each_text(spark):
    docs = spark.createDataFrame([
        (1, "a b c d e f", "x"), (1, "another text of some words", "x"), (1, "A  b c d e f", "y"), (None, "a b c d e f", "x"), (None, "none other has this one", "x"),
        (7, "the same row here again", "p"), (7, "the same row here again", "q"), (8, "", "x"), (9, None, "x"), (None, " ", "x"),
    ], "doc_id long, text string, out_id string")
    got = simhash.dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower().split()) for r in got.collect()) == sorted([
        (1, "a b c d e f".split()), (1, "another text of some words".split()), (0, "none other has this one".split()), (7, "the same row here again".split()), (8, [])])


def test_dedup_odd_cases(spark):
    docs = data.odd(spark)
    got = simhash.dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in got.collect()) == [(0, 24), (1, 0), (4, got.where("doc_id = 4").first().n_chars), (5, 5)]
    assert simhash.dedup(data.empty(spark)).count() == 0
