import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from tessera.llm import repair
from tests.llm import data

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "<|endoftext|> Hi<|startoftext|>", "don't 'S ''s I'LL", "Ünï ½ ²", "日本語 テスト abc", "é àb", "", " \t\n", "x\x1cy\x85z   w", "İstanbul ΑΣ σς", "10,000.50 €5 _a_ </w>", "\x00 a",
    "ﬁ ª º", "é ä", "<|", "a" * 3000, "....!!!'\"'", None,
]


def want(texts):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_ids_are_the_tokenizers():
    e = repair.Encoder(PATH, most=20)
    for texts in (ODD, ODD[::-1], ODD[3:5] + ["plain words"], []):
        ids, n = e.encode(pa.array(texts, pa.string()))
        own = np.split(ids, np.cumsum(n)[:-1]) if texts else []
        assert [x.tolist() for x in own] == want(texts)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    ids, n = repair.Encoder(path).encode(pa.array(ODD, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in ODD]


def test_parts_met_often_are_asked_for_once():
    rng = random.Random(3)
    e, asked = repair.Encoder(PATH, most=200), Counter()
    ask = e._ask

    def count(texts, bare):
        asked.update(x for t in texts for x in t.split())
        return ask(texts, bare)

    e._ask = count
    names = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(2000)]
    often, rare = names[:40], iter(names[40:])
    for _ in range(30):
        texts = [" ".join([*often, *(next(rare) for _ in range(60))]), "日本 often"]
        ids, n = e.encode(pa.array(texts, rng.choice([pa.string(), pa.large_string()])))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want(texts)
        assert len(e.table.at) <= 320
    assert [asked[x] for x in often] == [1] * 40 and asked["日本"] == 1


def test_splitting_is_the_pattern():
    rng = random.Random(5)
    words = ["", "'", "'s", "''s", "x'", "don't", "'t's", "'re've'll", "'r", "'l", "'ve", ".'s", "9's", "'street", "é'm", "a<", "|b", "<|", "a<|b", "×", "a÷", "\x7f", "½", "K", "ÿß", "日本", "a\x1cb"]
    words += ["".join(rng.choices("aé'''strevlmd09.,|<-ß×", k=rng.randrange(9))) for _ in range(5000)]
    for own in (words, words[::-1], [], [""]):
        array = pa.array(["cut", *own], pa.string())[1:]
        plain = [bool(re.fullmatch("[\x21-\x7eÀ-ÖØ-öø-ÿ]*", w)) and "<|" not in w for w in own]
        assert repair.plain(array).tolist() == plain
        parts, n = repair.split(pc.utf8_lower(array.filter(pa.array(plain, pa.bool_()))))
        found = [re.findall(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+", w.lower()) for w, x in zip(own, plain) if x]
        assert parts.to_pylist() == [x for p in found for x in p] and n.tolist() == [len(p) for p in found]


def pair_counts(seq):
    """Of pairs within a document, by a walk; in a run of one symbol each second pair overlaps."""
    out, skip = Counter(), False
    for i, (a, b) in enumerate(zip(seq, seq[1:])):
        skip = a == b and not skip and i > 0 and seq[i - 1] == a
        if a != 2 and not skip:
            out[a, b] += 1
    return out


def naive(ids, least):
    """Re-Pair by the book: the most frequent pair is replaced, again and again."""
    seq, rules, new = list(ids), {}, 10_000
    ends = {2}
    while True:
        count = Counter({p: n for p, n in pair_counts(seq).items() if p[0] not in ends})
        if not count or max(count.values()) < least:
            return seq, rules
        pair = max(count, key=lambda p: (count[p], -p[0], -p[1]))
        out, i = [], 0
        while i < len(seq):
            if i + 1 < len(seq) and (seq[i], seq[i + 1]) == pair:
                out.append(new)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        if pair[1] in ends:
            ends.add(new)
        rules[new], seq, new = pair, out, new + 1


@pytest.mark.parametrize("least", [2, 3, 8])
def test_grammar_against_naive_re_pair(least):
    rng = np.random.default_rng(least)
    for kind in range(4):
        ids = rng.zipf(1.4, 1500) % 60 + 3 if kind < 2 else np.tile(rng.integers(3, 9, 40), 40) if kind == 2 else np.full(700, 7)
        ids[rng.integers(0, len(ids), 25)] = 2
        ids = np.append(ids, 2).astype(np.uint32)
        seq, rules, first = repair.compress(ids, least)
        assert (repair.expand(seq, rules, first) == ids).all()
        assert (repair.Expansions(rules, first, 10**7)(seq) == ids).all() and (repair.Expansions(rules, first, 0)(seq) == ids).all()
        flat = np.concatenate([*rules, np.empty((0, 2), np.uint32)])
        ends = {2} | {first + i for i in range(len(flat)) if repair.expand(np.array([first + i], np.uint32), rules, first)[-1] == 2}
        left = {p: n for p, n in pair_counts(seq.tolist()).items() if p[0] not in ends}
        assert max(left.values(), default=0) < least
        by_book, own = naive(ids.tolist(), least)
        assert len(seq) + 4 * len(flat) <= 1.25 * (len(by_book) + 4 * len(own)) + 20


@pytest.mark.parametrize("top", [65535, 65500, 65536, 70000])
def test_symbols_around_16_bits(top):
    rng = np.random.default_rng(top)
    ids = np.r_[np.full(99, top), 2, np.tile(np.r_[rng.integers(top - 30, top, 50), 2], 30), top - rng.zipf(1.4, 3000) % 60, 2].astype(np.uint32)
    seq, rules, first = repair.compress(ids, 2)
    n = sum(map(len, rules))
    assert first + n > 1 << 16 and (repair.expand(seq, rules, first) == ids).all()
    ends = {2} | {s for s in range(first, first + n) if repair.expand(np.array([s], np.uint32), rules, first)[-1] == 2}
    assert max((k for p, k in pair_counts(seq.tolist()).items() if p[0] not in ends), default=0) < 2


def test_no_symbol_spans_two_documents():
    ids = np.array([5, 6, 2] * 50, np.uint32)
    seq, rules, first = repair.compress(ids, 2)
    assert len(seq) == 50 and repair.expand(seq[:1], rules, first).tolist() == [5, 6, 2]


def test_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 300, 60)
    ids = np.concatenate([np.r_[rng.zipf(1.5, n - 1) % 900 + 3, 2] for n in tokens]).astype(np.uint32)
    blob = repair.to_blob(ids, tokens)
    got = repair.Blob(blob)
    assert (got.all() == ids).all() and len(blob) < 4 * len(ids)
    for i in rng.permutation(60):
        assert (got.doc(i) == np.split(ids, np.cumsum(tokens)[:-1])[i]).all()
    one = repair.Blob(repair.to_blob(np.array([2], np.uint32), np.array([1])))
    assert one.all().tolist() == [2]


def test_table(spark, tmp_path):
    rng = random.Random(7)
    texts = ODD + [" ".join(data.words(rng, rng.randrange(400))) for _ in range(60)]
    path = str(tmp_path / "shards")
    repair.write(data.frame(spark, texts), PATH, path, shard_tokens=2000)
    got = repair.read(spark.read.parquet(path)).orderBy("doc_id").collect()
    at = 0
    for r, ids in zip(got, want(texts), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_cases(spark, tmp_path):
    docs = data.odd(spark)
    repair.write(docs, PATH, str(tmp_path / "a"))
    got = repair.read(spark.read.parquet(str(tmp_path / "a"))).collect()
    assert len(got) == docs.count() and sum(r.doc_id is None for r in got) == 2
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()
    repair.write(data.empty(spark), PATH, str(tmp_path / "b"))
    assert repair.read(spark.read.parquet(str(tmp_path / "b"))).count() == 0
