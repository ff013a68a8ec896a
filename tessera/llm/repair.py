"""Token ids in grammar-compressed shards (Re-Pair), and their reader.

A table of shards has the columns part and seq (their order), doc_ids and blob. A blob:
  magic "RPG1"; six little-endian uint32: documents, symbols, rounds, rules, first rule's symbol, width
  per round uint32: its rules' number; per rule uint32 left, uint32 right, uint32 expansion length
  per document uint32: where its symbols begin; uint64: its tokens
  per symbol `width` bytes, little-endian: 2 if that is enough, else 3
No symbol spans two documents, so one document is decoded from its own symbols and the rules alone."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

END = 2
MAGIC = b"RPG1"
#: A rule takes 12 bytes and saves 2 or 3 each time it is used, so one used 7 times pays.
LEAST = 8
#: Bytes that no word to be split here holds: it has only \x21-\x7e and the letters À-ÿ (0xC3 and another byte), of which
#: the tokenizer's own normalizing only changes the case.
ODD = np.isin(np.arange(256), [*range(0x21), 0x7F, *range(0xC0, 0xC3), *range(0xC4, 0x100)])
#: What a byte of such a word in lower case belongs to: 0 letters, 1 signs, 2 a digit.
KIND = np.ones(256, np.uint8)
KIND[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 0
KIND[ord("0") : ord("9") + 1] = 2
#: What a tokenizer's file must say for this splitting to hold. Other tokenizers get whole texts.
SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}])


class Table:
    """Numbers of strings in order of their first look-up, and the ids of each."""

    def __init__(self, *known: tuple[str, list[int]]):
        self.at = {x: i for i, (x, _) in enumerate(known)}
        self.size = np.array([len(x) for _, x in known], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.ids = np.array([i for _, x in known for i in x], np.uint32)

    def add(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.at.update(zip(names, range(len(self.at), len(self.at) + len(names)), strict=True))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids)

    def trim(self, keep: np.ndarray) -> None:
        """Leave only the entries of these ascending numbers."""
        names, (ids, size) = list(self.at), self.get(keep)
        self.at = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.ids, self.size, self.start = ids, size, np.cumsum(size) - size

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered strings, one after the other, and how many each has."""
        size = self.size[numbers]
        return self.ids[common.ranges(self.start[numbers], size)], size


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' UTF-8, one after the other, and where each begins; the end is the last."""
    upto = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[upto[0] : upto[-1]]
    return raw, upto - upto[0]


def _per_word(mark: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How many of a word's bytes are marked."""
    return np.diff(np.append(0, np.cumsum(mark))[upto])


def plain(words: pa.Array) -> np.ndarray:
    """Which words `split` may have: no ODD byte, no × nor ÷, and no "<|", which may begin a special token."""
    raw, upto = _bytes(words)
    mark = ODD[raw]
    a = np.flatnonzero((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
    begins = np.zeros(len(raw) + 1, bool)
    begins[upto] = True
    mark[a[~begins[a + 1]]] = True
    return _per_word(mark, upto) == 0


def split(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of plain words in lower case, one after the other, and the number of each word's: the tokenizer's own pattern but for white space."""
    raw, upto = _bytes(words)
    n, kind = len(raw), KIND[raw]
    begins = np.zeros(n + 2, bool)
    begins[upto] = begins[n:] = True
    cut = begins[:n] | (kind == 2)
    cut[1:] |= kind[1:] != kind[:-1]
    # 's, 't, 'm, 'd, 're, 've and 'll are parts where no sign precedes them.
    at = np.flatnonzero((raw == ord("'")) & cut)
    at = at[~begins[at + 1]]
    x, y = raw[at + 1], np.append(raw, np.uint8(0))[at + 2]
    one = np.isin(x, list(b"stmd"))
    two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    two &= ~begins[at + 2]
    cut[at[one | two] + 1] = False
    ends = np.append(at[one] + 2, at[two] + 3)
    cut[ends[ends < n]] = True
    offsets = np.append(np.flatnonzero(cut), n).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw)), _per_word(cut, upto)


class Encoder:
    """Ids of whole texts.

    Of a tokenizer that splits as SPLITS says, no token crosses ASCII white space. A batch's different words are taken:
    plain ones are split to parts, each of which the tokenizer is asked for once, by itself; others go through the whole
    tokenizer, once each. When the table of parts and such words exceeds `most` entries, the half of that which most
    batches had is kept, of those met in at least two."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.most = Tokenizer.from_file(path), most
        normalizer, pre = (json.loads(x.__getstate__()) if x else {} for x in (self.tok.normalizer, self.tok.pre_tokenizer))
        splits = [x["pattern"].get("Regex") for x in pre.get("pretokenizers", []) if x.get("type") == "Split"]
        self.known = (splits, normalizer.get("normalizers")) == ([SPLITS[0]], SPLITS[1]) and all(x.content.startswith("<|") for x in self.tok.get_added_tokens_decoder().values())
        self.whole = self.tok.normalizer, self.tok.pre_tokenizer
        self.ascii = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit(" ")  # whose bytes' characters are their own
        self.bare = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table, self.met = Table(), np.empty(0, np.int64)

    def _ask(self, texts: list[str], how: tuple) -> list[list[int]]:
        self.tok.normalizer, self.tok.pre_tokenizer = how
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Parts many at once, as a part's last token shows where it ends; words, which have a line break in front, one by one."""
        words, parts, others = [], [], []
        for x in new:
            (words if x[0] == "\n" else parts if x.isascii() else others).append(x)
        for own, how in ((parts, self.ascii), (others, self.bare)):
            found = [np.array(x, np.uint32) for x in self._ask([" ".join(own[i : i + 1000]) for i in range(0, len(own), 1000)], how)]
            if found:
                ids = np.concatenate(found)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(own):
                    raise ValueError("this tokenizer doesn't mark the ends of words")
                self.table.add(own, ids, np.diff(ends, prepend=0))
        if words:
            own = self._ask([x[1:] for x in words], self.whole)
            self.table.add(words, np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64))

    def _numbers(self, names: list[str]) -> np.ndarray:
        """The numbers of different parts and words, learnt if they are new."""
        if len(self.table.at) > self.most:
            keep = np.argsort(-self.met, kind="stable")[: self.most // 2]
            keep = np.sort(keep[self.met[keep] > 1])
            self.table.trim(keep)
            self.met = self.met[keep] // 2  # what is met no more makes room
        at = self.table.at
        out = np.fromiter(map(at.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        if len(new):
            own = [names[i] for i in new.tolist()]
            self._learn(own)
            out[new] = [at[x] for x in own]
            self.met = np.append(self.met, np.zeros(len(own), np.int64))
        self.met[out] += 1
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by END, and the number of each text's. A null is empty."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        if not self.known:
            own = [[*x, END] for x in self._ask(texts.to_pylist(), self.whole)]
            return np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64)
        words = pc.ascii_split_whitespace(texts)
        found = words.flatten().dictionary_encode()
        each = found.dictionary.cast(pa.string())
        own = plain(each)
        parts, n = split(pc.utf8_lower(each.filter(pa.array(own))))
        rest = pc.binary_join_element_wise("\n", each.filter(pa.array(~own)), "")
        strings = pa.concat_arrays([parts, rest]).dictionary_encode()
        numbers = self._numbers(strings.dictionary.to_numpy(zero_copy_only=False).tolist())[strings.indices.to_numpy()]
        # The entries of each different word: its parts, or the one that stands behind all parts.
        size, start = np.ones(len(each), np.int64), np.empty(len(each), np.int64)
        size[own], start[own], start[~own] = n, np.cumsum(n) - n, np.arange(len(parts), len(numbers))
        ids, n = self.table.get(numbers[common.ranges(start, size)])
        upto = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(size))]
        # The words' ids side by side, END behind them; then all words of the texts, in order.
        ids, start, size = np.append(ids, np.uint32(END)), np.append(upto[:-1], len(ids)), np.append(np.diff(upto), 1)
        offsets = words.offsets.to_numpy().astype(np.int64)
        ends = offsets[1:] - offsets[0]
        number = np.insert(found.indices.to_numpy().astype(np.int64), ends, len(each))
        size = size[number]
        return ids[common.ranges(start[number], size)], np.diff(np.cumsum(size)[ends + np.arange(len(ends))], prepend=0)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def _slot(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)


def compress(ids: np.ndarray, least: int = LEAST, span: int = 6) -> tuple[np.ndarray, list[np.ndarray], int]:
    """(symbols, per round the rules' pairs, the first rule's symbol).

    Each round counts all pairs exactly, overlaps of a symbol with itself once, and takes those at least 2**-span times as
    frequent as the most frequent one, and no less than `least`. Where two of them overlap the more frequent one is
    replaced, and the other waits for a later round. Rounds go on until no pair occurs `least` times. A pair whose left
    part ends a document is none.

    A count of old symbols never rises, so only places whose pair was frequent enough, and those beside a new symbol, are
    looked at again; the sequence is a linked list until the end."""
    if least < 2:
        raise ValueError("a pair that occurs once can't be shared")
    n, first = len(ids), int(ids.max(initial=END)) + 1
    base, rules = first, []
    seq = np.append(ids, END).astype(np.uint32)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    before[0] = n
    last = np.append(ids == END, True)  # ends a document, or is gone
    gone = np.zeros(n + 1, bool)
    none = np.int32(2**31 - 1)
    rank = np.full(n + 1, none, np.int32)
    at = np.flatnonzero(~last)
    while len(at):
        left, right = seq[at], seq[after[at]]
        half = 16 if base <= 1 << 16 else 24  # bits of a symbol; pairs of 32 bits sort faster
        key = left.astype(np.uint32 if half == 16 else np.int64) << half | right
        twins = np.flatnonzero(left == right)
        second = np.zeros(len(at), bool)  # of a run of one symbol, pairs that overlap the one before
        counted = key.copy()
        if len(twins):
            own, i = at[twins], np.arange(len(twins))
            begin = np.maximum.accumulate(np.where(np.r_[True, after[own[:-1]] != own[1:]], i, 0))
            twins = twins[(i - begin) % 2 == 1]
            second[twins] = True
            counted[twins] = np.iinfo(counted.dtype).max  # sorted to the end, and cut off there
        counted.sort()
        counted = counted[: len(at) - len(twins)]
        begin = np.flatnonzero(counted[1:] != counted[:-1]) + 1
        begin = np.append(0, begin)[: len(counted)]
        count = np.diff(np.append(begin, len(counted)))
        top = int(count.max(initial=0))
        if top < least:
            break
        enough = np.flatnonzero(count >= least)
        pairs, count = counted[begin[enough]], count[enough]
        bits = min(18, max(8, (4 * len(pairs)).bit_length()))
        slot = _slot(left, right, bits)
        full = np.zeros(1 << bits, bool)
        pair = np.stack([pairs >> half, pairs & (1 << half) - 1], 1).astype(np.uint32)
        full[_slot(pair[:, 0], pair[:, 1], bits)] = True
        # Only places whose pair is frequent enough, and a few that share its slot, are looked at from now on.
        may = np.flatnonzero(full[slot])
        at, key, slot, second = at[may], key[may], slot[may], second[may]
        frequent = np.flatnonzero(count >= top >> span)
        frequent = frequent[np.argsort(-count[frequent], kind="stable")][: (1 << 24) - base]
        pairs, pair = pairs[frequent], pair[frequent]
        if not len(pairs):  # no symbol is left to name one
            break
        where = _slot(pair[:, 0], pair[:, 1], bits)
        number = np.full(1 << bits, -1, np.int32)
        number[where[::-1]] = np.arange(len(pairs))[::-1]  # of pairs in one slot the most frequent; others wait
        r = number[slot]
        hit = np.flatnonzero(r >= 0)
        hit = hit[(pairs[r[hit]] == key[hit]) & ~second[hit]]
        place, r = at[hit], r[hit]
        rank[place] = r
        chosen = (r < rank[before[place]]) & (r < rank[after[place]])
        rank[place] = none
        place, r = place[chosen], r[chosen]
        good = np.bincount(r, minlength=len(pairs)) >= least
        chosen = good[r]
        place, r = place[chosen], (np.cumsum(good) - 1)[r[chosen]]
        taken = after[place]
        seq[place] = (r + base).astype(np.uint32)
        last[place] = last[taken]
        last[taken] = gone[taken] = True
        after[place] = after[taken]
        before[after[place]] = place
        if len(at) > n // 256:
            again = np.zeros(n + 1, bool)
            again[at] = again[place] = again[before[place]] = True
            at = np.flatnonzero(again & ~last)
        else:
            at = np.unique(np.concatenate([at, place, before[place]]))
            at = at[~last[at]]
        rules.append(pair[good])
        base += len(rules[-1])
    if first > 1 << 24:
        raise ValueError("ids need more than 24 bits")
    return seq[:-1][~gone[:-1]], rules, first


def expand(seq: np.ndarray, rules: list[np.ndarray], first: int) -> np.ndarray:
    """Undo compress, the last round first."""
    base = first + sum(map(len, rules))
    for pairs in reversed(rules):
        base -= len(pairs)
        is_rule = seq >= base
        at = np.cumsum(is_rule) - is_rule + np.arange(len(seq))
        out = np.empty(len(seq) + int(is_rule.sum()), np.uint32)
        r = seq[is_rule] - base
        out[at[~is_rule]] = seq[~is_rule]
        out[at[is_rule]] = pairs[r, 0]
        out[at[is_rule] + 1] = pairs[r, 1]
        seq = out
    return seq


def _lengths(rules: list[np.ndarray], first: int) -> np.ndarray:
    size = np.ones(first + sum(map(len, rules)), np.uint32)
    base = first
    for pairs in rules:
        size[base : base + len(pairs)] = size[pairs].sum(axis=1)
        base += len(pairs)
    return size


class Expansions:
    """All symbols' ids, side by side, to decode by one look-up. Where they would hold more than `most` ids, rounds are undone one by one."""

    def __init__(self, rules: list[np.ndarray], first: int, most: int):
        self.rules, self.first, self.ids = rules, first, None
        size = _lengths(rules, first).astype(np.int64)
        if size.sum() > most + first:
            return
        self.size, self.start = size, np.cumsum(size) - size
        self.ids = np.empty(int(size.sum()), np.uint32)
        self.ids[:first] = np.arange(first)
        base = first
        for pairs in rules:
            flat = pairs.ravel()
            own = self.ids[common.ranges(self.start[flat], size[flat])]
            self.ids[self.start[base] : self.start[base] + len(own)] = own
            base += len(pairs)

    def __call__(self, seq: np.ndarray) -> np.ndarray:
        if self.ids is None:
            return expand(seq, self.rules, self.first)
        return self.ids[common.ranges(self.start[seq], self.size[seq])]


def to_blob(ids: np.ndarray, tokens: np.ndarray, least: int = LEAST) -> bytes:
    """A shard of documents with so many tokens each."""
    seq, rules, first = compress(ids, least)
    size = _lengths(rules, first)
    upto = np.cumsum(size[seq].astype(np.int64))
    start = np.searchsorted(upto, np.cumsum(tokens) - tokens, "right").astype("<u4")
    flat = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    width = 2 if first + len(flat) <= 1 << 16 else 3
    table = np.concatenate([flat, size[first:, None]], 1).astype("<u4")
    head = struct.pack("<6I", len(tokens), len(seq), len(rules), len(flat), first, width) + np.array([len(r) for r in rules], "<u4").tobytes()
    return MAGIC + head + table.tobytes() + start.tobytes() + tokens.astype("<u8").tobytes() + seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


class Blob:
    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        docs, symbols, levels, rules, self.first, width = struct.unpack_from("<6I", data, 4)
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        per = take("<u4", levels)
        table = take("<u4", 3 * rules).reshape(-1, 3)
        self.rules = np.split(table[:, :2], np.cumsum(per)[:-1]) if levels else []
        self.start, self.tokens = take("<u4", docs), take("<u8", docs).astype(np.int64)
        raw = np.zeros((symbols, 4), np.uint8)
        raw[:, :width] = take("u1", width * symbols).reshape(-1, width)
        self.seq = raw.view("<u4").ravel()
        self.expand = Expansions(self.rules, self.first, max(1_000_000, 4 * int(self.tokens.sum())))

    def doc(self, i: int) -> np.ndarray:
        """The ids of one document."""
        return self.expand(self.seq[self.start[i] : self.start[i + 1] if i + 1 < len(self.start) else None])

    def all(self) -> np.ndarray:
        return self.expand(self.seq)


def write(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1_000_000, least: int = LEAST) -> None:
    """Encode docs and write their shards to path, in ascending order of id, null first, and of text where ids are equal.

    A null or empty text has the end id alone. Documents are range-partitioned and streamed in order; a shard ends
    about where it reaches shard_tokens, at a document's end, so a task holds one shard and one batch of rows. `least` is compress's. Other columns are ignored; an
    empty table gives an empty one. Each part is written by Spark's committer, so a lost task is just run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, seq = encoder(tokenizer), 0
        ids, tokens, parts, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            blob = to_blob(np.concatenate(parts), np.concatenate(tokens), least)
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["part", "seq", "doc_ids", "blob"])

        for b in batches:
            text, own = b.column("text"), b.column("doc_id")
            upto = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            i = 0
            while i < b.num_rows:
                # Up to 2 MB of text at once, in whole rows.
                e = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + 2_000_000, "right")))
                x, n = own_encoder.encode(text.slice(i, e - i))
                parts.append(x)
                tokens.append(n)
                ids += own.slice(i, e - i).to_pylist()
                total, i = total + len(x), e
                if total >= shard_tokens:
                    yield shard()
                    ids, tokens, parts, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(common.frugal(run), "part int, seq int, doc_ids array<bigint>, blob binary").write.parquet(path)


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a table of shards, from its decoded ids.

    Shards' own offsets are summed within each part, and parts' totals over the parts, which are as many as the writer had tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, ids, blob in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("doc_ids").to_pylist(), b.column("blob"), strict=True):
                x = Blob(blob.as_py())
                data, upto = memoryview(x.all().astype("<u4").tobytes()), np.cumsum(x.tokens)
                crc = [zlib.crc32(data[4 * a : 4 * e]) for a, e in zip((upto - x.tokens).tolist(), upto.tolist(), strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(upto - x.tokens), pa.array(x.tokens), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    docs = common.stash(shards.mapInArrow(common.frugal(run), "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")).df
    per = docs.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    before = "coalesce(sum(n) over (partition by part order by seq rows between unbounded preceding and 1 preceding), 0)"
    per = per.select("part", "seq", F.expr(before).alias("before"))
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("base"))
    out = docs.join(per, ["part", "seq"]).join(F.broadcast(parts), "part")
    return out.select("doc_id", (F.col("base") + F.col("before") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32")
