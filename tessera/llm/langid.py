"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, html

BUCKETS = 1 << 16
#: Bytes of text that are scored at once; a worker holds a row of likelihoods for each.
PIECE = 1 << 17


class Model(NamedTuple):
    langs: list[str]
    logp: np.ndarray  # bucket x language


def _codes(b: bytes) -> np.ndarray:
    """Hashed byte trigrams."""
    x = np.frombuffer(b, np.uint8).astype(np.uint32)
    return (((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _padded(t: bytes) -> bytes:
    return b" " + t.lower() + b" "


def _pieces(t: bytes) -> Iterator[bytes]:
    """Parts of a long text whose trigrams together are the text's."""
    for i in range(0, max(1, len(t) - 2), PIECE):
        yield t[i : i + PIECE + 2]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = 4000, alpha: float = 0.5) -> Model:
    """Trigram likelihoods from at most `rows` labelled ids, chosen by the smallest hashes of their ids, whole texts.

    Rows without an id or label are left out; a null text is empty; rows of one id count all; of ids whose hashes tie at the
    limit any may go. Other columns are ignored; an empty table gives a model of one language, und."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    ids = [r[0] for r in labelled.select(id_col).orderBy(F.xxhash64(id_col)).limit(rows).collect()]
    chosen = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    wanted = spark.createDataFrame(pa.table({"id": pa.array([int(i) for i in ids], pa.int64())}))  # of Arrow: from rows it takes Python workers of its own
    chosen = chosen.join(F.broadcast(wanted), "id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), common.texts(b), strict=True):
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for p in _pieces(_padded(t)):
                    own += np.bincount(_codes(p), minlength=BUCKETS)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "code", "n"])

    found = chosen.mapInArrow(common.frugal(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found.lang.unique().tolist()) or ["und"]
    n = np.full((BUCKETS, len(langs)), alpha)
    n[found.code.to_numpy(np.int64), found.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] += found.n.to_numpy(np.float64)
    return Model(langs, np.log(n / n.sum(axis=0)).astype(np.float32))


def scores(texts: Iterable[bytes], count: int, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of log likelihoods by language, numbers of trigrams) of so many texts."""
    ll, n = np.zeros((count, logp.shape[1])), np.zeros(count, np.int64)
    part, rows, size = [], [], 0

    def flush() -> None:
        nonlocal part, rows, size
        if part:
            codes = [_codes(p) for p in part]
            where = np.cumsum([0, *(len(c) for c in codes[:-1])])
            np.add.at(ll, rows, np.add.reduceat(logp[np.concatenate(codes)], where, axis=0, dtype=np.float64))
            np.add.at(n, rows, [len(c) for c in codes])
        part, rows, size = [], [], 0

    for i, t in enumerate(texts):
        for p in _pieces(_padded(t)):
            if len(p) > 2:
                part.append(p)
                rows.append(i)
                size += len(p)
            if size >= PIECE:
                flush()
    flush()
    return ll, n


def likelihoods(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, declared, suffix, host, n trigrams with a letter in them or not, letters, ll: one sum per language)."""
    logp = model.logp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ll, n = scores(common.texts(b), b.num_rows, logp)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "declared", "suffix", "host", "letters")), pa.array(n), pa.array(list(ll), pa.list_(pa.float64()))], ["doc_id", "declared", "suffix", "host", "letters", "n", "ll"])

    return docs.mapInArrow(common.frugal(run), "doc_id long, declared string, suffix string, host string, letters boolean, n long, ll array<double>")


HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*+://(?:[^/?#@]*+@)?+([^/?#:@]+)")
LANG = re.compile(r"[A-Za-z]{2,3}(?![A-Za-z])")


def declared_language(page: str) -> str | None:
    """The language that the page's first html tag names, without its region; None if it names none."""
    scan, at = html.Scanner(page), 0
    while (at := page.find("<", at)) >= 0:
        m = html.NAME.match(page, at + 1)
        at += 1
        if m:
            at, attributes, _ = scan.attributes(m.end())
            if m[0].lower() == "html":
                found = LANG.match(dict(reversed(attributes)).get("lang", "").strip())
                return found[0].lower() if found else None
            if m[0].lower() not in ("head", "meta", "title"):
                return None
    return None


def from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: html.Field | None = None) -> DataFrame:
    """(id, text, declared, suffix, host) of each web page: its main text, the language its markup declares, and of its
    address the host and the host's last label, in lower case.

    What is missing is null, as from a null page or an address without host. Null and repeated ids each give a row; other
    columns are ignored; an empty table gives an empty one."""
    model = field or html.default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, declared, suffix, host = [], [], [], []
            for u, x in zip(b.column("url").to_pylist(), b.column("html"), strict=True):
                page = x.as_py() or ""
                m = HOST.match(u or "")
                name = m[1].lower().rstrip(".") if m else None
                text.append(html.main_text(model, page))
                declared.append(declared_language(page))
                host.append(name)
                suffix.append(name.rsplit(".", 1)[-1] if name else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.string()) for x in (text, declared, suffix, host))], ["id", "text", "declared", "suffix", "host"])

    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, "id long, text string, declared string, suffix string, host string")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, effective: int = 60, kappa: float = 20.0, min_prob: float = 0.5, min_gain: float = -1.0) -> DataFrame:
    """One row (doc_id, lang, prob, text_lang, kept) per row of docs.

    Log posterior = text log likelihood, scaled to `effective` independent trigrams at most, + log P(declared | language)
    + log prior of the host. All three tables come from grouped counts over every row, by the language its text alone
    suggests: the prior of a host is smoothed by kappa towards that of its address suffix, that one towards the whole;
    a row's own count is left out. Where a piece of evidence is null it is a value of its own.
    kept is false, and lang null, if the text has no letter, if no language reaches min_prob, or if the text is
    more than -min_gain nats a trigram less likely than under equally likely trigrams. Null and empty texts are so rejected.
    Null and repeated ids each give a row; other columns are ignored; an empty table gives an empty one.
    Counts of hosts and suffixes are broadcast if they are few (common.small); else rows meet them by shuffle joins, whose
    hot keys Spark splits. Per-language counts of all rows are as many as there are languages."""
    langs, none = model.langs, F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(declared if declared is not None else none, F.lit("")).alias("declared"), F.coalesce(suffix if suffix is not None else none, F.lit("")).alias("suffix"),
        F.coalesce(host if host is not None else none, F.lit("")).alias("host"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col(text_col).alias("text"))
    rows = rows.withColumn("declared", F.when(F.col("declared").isin([*langs, ""]), F.col("declared")).otherwise("other"))
    own = likelihoods(rows, model).withColumn("best", F.expr("cast(array_position(ll, array_max(ll)) - 1 as int)"))
    with common.batches(docs.sparkSession):
        own = common.stash(own.select("*", F.col("ll")[F.col("best")].alias("top"))).df

    def counts(*by: str) -> DataFrame:
        per = [F.sum((F.col("best") == i).cast("double")) for i in range(len(langs))]
        return own.groupBy(*by).agg(F.array(*per).alias("_".join(("c", *by))))

    whole = (counts().first() or [None])[0] or []
    whole = [(x or 0.0) + 1.0 for x in whole] or [1.0] * len(langs)
    base = F.array(*(F.lit(x / sum(whole)) for x in whole))
    told = F.broadcast(counts("declared"))  # at most two rows more than languages
    by_host, by_suffix = (common.small(common.stash(counts(*by)).df) for by in (("host", "suffix"), ("suffix",)))
    j = own.join(by_host, ["host", "suffix"]).join(by_suffix, "suffix").join(told, "declared")
    j = j.withColumn("base", base).withColumn("me", F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: F.when(i == F.col("best"), 1.0).otherwise(0.0)))
    total = lambda c: f"aggregate({c}, 0D, (a, x) -> a + x)"
    j = j.withColumn("by_suffix", F.expr(f"transform(base, (p, i) -> (c_suffix[i] - me[i] + {kappa}D * p) / ({total('c_suffix')} - 1 + {kappa}D))"))
    j = j.withColumn("by_host", F.expr(f"transform(by_suffix, (p, i) -> (c_host_suffix[i] - me[i] + {kappa}D * p) / ({total('c_host_suffix')} - 1 + {kappa}D))"))
    all_of = F.array(*(F.lit(x) for x in whole))
    j = j.withColumn("all_of", all_of).withColumn("weight", F.expr(f"least(1D, {effective}D / greatest(n, 1))"))
    j = j.withColumn("score", F.expr("transform(by_host, (p, i) -> weight * (ll[i] - top) + ln(p + 1e-9D) + ln((c_declared[i] - me[i] + 0.5D) / all_of[i]))"))
    j = j.withColumn("most", F.array_max("score")).withColumn("prob", F.expr("1 / aggregate(score, 0D, (a, x) -> a + exp(x - most))"))
    gain = F.col("top") / F.greatest("n", F.lit(1)) + float(np.log(BUCKETS))
    kept = F.col("letters") & (F.col("prob") >= min_prob) & (gain >= min_gain)
    name = lambda i: F.array(*(F.lit(x) for x in langs))[i]
    return j.select("doc_id", F.when(kept, name(F.expr("cast(array_position(score, most) - 1 as int)"))).alias("lang"), "prob", name(F.col("best")).alias("text_lang"), kept.alias("kept"))
