import random
import time

import numpy as np

from tessera.llm import suffixes, windows
from tests.llm import data


def classes(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


def corpus():
    rng = random.Random(2)
    passages = [data.words(rng, n) for n in (60, 70, 120, 200)]
    texts = []
    for i in range(80):
        t = data.words(rng, rng.randrange(0, 150))
        for p in rng.sample(passages, rng.randrange(2)):
            p = list(p)
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = f"x{i}"
            at = rng.randrange(len(t) + 1)
            t[at:at] = p
        if i % 9 == 0:
            t += ["one", "two", "three"] * 60
        texts.append(" ".join(t))
    return texts + [texts[1], texts[1], None, "", "short one"]


def brute(texts, width=46, least=0.8):
    """(pairs whose passages have this similarity anywhere, pairs with equal passages)."""
    sets = [[frozenset(tuple(w[k : k + 5]) for k in range(i, i + width)) for i in range(len(w) - width - 3)] for w in ((t or "").split() for t in texts)]
    near, same = set(), set()
    for a in range(len(sets)):
        own = set(sets[a])
        for b in range(a + 1, len(sets)):
            if own & set(sets[b]):
                same.add((a, b))
            elif any(len(x & y) >= least * len(x | y) for x in own for y in set(sets[b]) if len(x & y) > 30):
                near.add((a, b))
    return near | same, same


def test_spans_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(40)
    at = np.arange(300)
    l, r = windows.spans(v, at, np.zeros(300, int), np.full(300, 300))
    for c in range(300):
        a = b = c
        while a > 0 and v[a - 1] > v[c]:
            a -= 1
        while b < 299 and v[b + 1] >= v[c]:
            b += 1
        assert (l[c], r[c]) == (a, b)
    assert set(suffixes.minimisers(v, np.ones(300, bool), 46)) <= set(at[r - l >= 45])


def test_forest_leaves_out_no_row():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 31, (6, 91), np.uint32)
    g = base[rng.integers(0, 6, 90)].copy()
    for i in range(90):
        p = rng.integers(0, 90)
        g[i, p : p + rng.integers(0, 12)] = rng.integers(1, 1 << 31)
        g[i, : rng.integers(0, 30)] = 0
    doc = np.arange(90)
    want = classes([(i, j) for i in range(90) for j in range(i) if windows.similar(g[i], g[j], 46, 0.8) >= 0.8])
    assert classes([(a, b) for a, b, _ in windows.forest(doc, doc, g, 46, 0.8, windows.Joined())]) == want
    root = doc // 2 * 2
    got = [(a, b) for a, b, _ in windows.forest(doc, root, g, 46, 0.8, windows.Joined(10))]
    assert classes([*got, *((i, i // 2 * 2) for i in range(90))]) == classes([*want.items(), *((i, i // 2 * 2) for i in range(90))])


def test_against_brute_force(spark):
    texts = corpus()
    want, same = brute(texts)
    for block in (windows.BLOCK, 3):
        links, found = windows.near_passages(data.frame(spark, texts), block=block)
        got = {r.doc_id: r.class_id for r in found.collect()}
        assert {(r.a, r.b) for r in links.collect()} <= want
        assert got == classes([(r.a, r.b) for r in links.collect()])
        assert all(got[a] == got[b] for a, b in same)
        assert len(set(got)) >= 0.9 * len(classes(want))


def test_odd_cases(spark):
    got = {r.doc_id: (r.class_id, r.n_docs) for r in windows.near_passages(data.odd(spark))[1].collect()}
    assert got == {4: (4, 2), 7: (4, 2)}
    assert windows.near_passages(data.empty(spark))[1].count() == 0


def test_exact_passages_of_templated_text(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        form, records = data.words(rng, 24), []
        for k in range(20):
            records += form + [f"v{rng.randrange(10**9)}" for _ in range(8)]
        at = rng.randrange(200, 400)
        own = [[f"w{rng.randrange(10**9)}" for _ in range(40)] for _ in range(2)]
        texts += [" ".join(records), " ".join(own[0] + records[at : at + 60] + own[1])]
    got = {r.doc_id: r.class_id for r in windows.near_passages(data.frame(spark, texts))[1].collect()}
    assert [i for i in range(0, 80, 2) if i not in got or got[i] != got.get(i + 1)] == []


def frequent(n):
    """(documents, roots, shingles) of n passages around one line. Half are changed copies of one root; of the others,
    nine out of ten have nothing else in common, the rest are two of a kind, alike or not."""
    rng = np.random.default_rng(n)
    g = rng.integers(1, 1 << 31, (n, 91), np.uint32) | np.uint32(1)
    g[: n // 2] = g[0]
    for i in range(n // 2):
        p = rng.integers(0, 30)
        g[i, p : p + 5] = rng.integers(1, 1 << 31, 5)
    for i in range(n - n // 20, n, 2):
        g[i + 1] = g[i]
        g[i + 1, 40 : 40 + 3 * (i // 2 % 5)] = 1 << 31
        g[i + 1, 50:60] = rng.integers(1, 1 << 31, 10) if i % 4 else g[i, 50:60]
    g[:, 35:56] = rng.integers(1, 1 << 31, 21, np.uint32) | np.uint32(1)
    root = np.arange(n)
    root[: n // 2] = 0
    return np.arange(n), root, g


def test_forest_of_a_frequent_line_leaves_out_no_row():
    doc, root, g = frequent(120)
    roots = list(enumerate(root.tolist()))
    want = classes([*roots, *((i, j) for i in range(120) for j in range(i) if windows.similar(g[i], g[j], 46, 0.8) >= 0.8)])
    got = windows.forest(doc, root, g, 46, 0.8, windows.Joined())
    assert got and classes([*roots, *((a, b) for a, b, _ in got)]) == want
    for i in range(0, 120, 2):
        pair = slice(i, i + 2)
        s = windows.similar(*g[pair], 46, 0.8)
        assert [x for _, _, x in windows.forest(doc[pair], doc[pair], g[pair], 46, 0.8, windows.Joined())] == [s] * (s >= 0.8)


def test_forest_of_a_frequent_line_grows_with_its_rows():
    took = []
    for n in (1000, 8000):
        group, best = frequent(n), []
        for _ in range(2):
            began = time.process_time()
            windows.forest(*group, 46, 0.8, windows.Joined())
            best.append(time.process_time() - began)
        took.append(min(best))
    assert took[1] < 20 * took[0], took
