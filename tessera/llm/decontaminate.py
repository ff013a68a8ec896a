"""Benchmark decontamination by templates, in DataFrame functions only.

Texts are canonicalised: numbers, names and units become typed placeholders. Windows of canonical words are hash-joined
with those of the benchmark; then the values that stand in the placeholders must map one to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|feet|foot|inch(?:es)?|dollars?|euros?|cents?|percent"


def marked(text: Column) -> Column:
    """Words in lower case without punctuation, space-joined; numbers start with 1_, names with 2_, units with 3_.

    A name is a word of one capital and small letters that follows, on one line, a word or comma; a unit is one of UNITS after a number."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "_", " ")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;:] )(\p{Lu}\p{Ll}++)(?!\p{L})", "2_$1")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])([0-9]++(?:[.,][0-9]+)*+)(?!_)", " 1_$1 ")
    t = F.regexp_replace(t, rf"(1_[0-9.,]+)\s+((?i:{UNITS})(?![\p{{L}}\p{{N}}])|[%€$£])", "$1 3_$2")
    t = F.regexp_replace(F.lower(t), r"(?<=[0-9])[.,](?=[0-9])", "_")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}\p{M}_%€$£]+", " "))


def canonical(marked_text: Column) -> Column:
    return F.split(F.regexp_replace(marked_text, r"(?<![^ ])([123]_)[^ ]+", "$1"), " ")


def windows(words: str, n: int) -> Column:
    """Hashes of all n-word windows of the array column `words`, by position."""
    return F.expr(f"case when size({words}) >= {n} then transform(sequence(1, size({words}) - {n - 1}), i -> xxhash64(slice({words}, i, {n}))) else array() end")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, min_literals: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_words, exact) for each document and item that share a consistent template window.

    Windows have n words, for an item of at least min_literals but fewer than n words its whole length. A window of the
    benchmark counts if min_literals of its words are not placeholders. Along one alignment of document and item, a
    value in the item's slots must always meet the same value in the document's, and the other way round; windows with a
    pair of values that conflicts with another don't count, unless all their values are equal to the item's. n_windows:
    windows of the best alignment that count; n_words: words of the item they cover, of which overlaps count once when
    windows are contiguous; exact: all their slot values are equal.
    Null and empty texts match nothing. Rows of one doc_id (or item_id) count as one document (item). Null ids are left
    out, as nothing can name them. Other columns are ignored; an empty table on either side gives an empty result.
    The benchmark's windows are broadcast only if few (common.small), else shuffled, hot keys split by Spark; texts are read again for
    the documents with a hit only."""
    items = benchmark.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).alias("item_id"), marked(F.col(item_text_col)).alias("i_marked"))
    items = common.stash(items.select("item_id", "i_marked", canonical(F.col("i_marked")).alias("words")).withColumn("len", F.least(F.size("words"), F.lit(n)))).df
    sizes = sorted(r[0] for r in items.where(F.col("len") >= min_literals).select("len").distinct().collect())  # at most n of them
    per = [items.where(F.col("len") == k).select("item_id", F.lit(k).alias("n"), "words", F.posexplode(windows("words", k)).alias("ipos", "hash")) for k in sizes]
    if not per:
        per = [items.select("item_id", F.col("len").alias("n"), "words", F.lit(0).alias("ipos"), F.lit(0).cast("long").alias("hash")).where("false")]
    wins = per[0]
    for x in per[1:]:
        wins = wins.union(x)
    literal = F.expr("size(filter(slice(words, ipos + 1, n), x -> not x in ('1_', '2_', '3_')))")
    wins = common.stash(wins.where(literal >= min_literals).select("item_id", "n", "ipos", "hash")).df

    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = own.select("doc_id", canonical(marked(F.col("text"))).alias("words"))
    parts = F.array(*(F.struct(F.lit(k).alias("n"), windows("words", k).alias("h")) for k in sizes)) if len(sizes) > 1 else None
    if parts is None:
        hashes = words.select("doc_id", F.lit(sizes[0] if sizes else n).alias("n"), F.posexplode(windows("words", sizes[0] if sizes else n)).alias("dpos", "hash"))
    else:
        hashes = words.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.n", F.posexplode("p.h").alias("dpos", "hash"))
    known = common.small(wins.select("hash", "n").distinct())
    hits = common.stash(hashes.join(known, ["hash", "n"])).df

    at = common.small(hits.select("doc_id").distinct())
    texts = own.join(at, "doc_id", "left_semi").select("doc_id", F.split(marked(F.col("text")), " ").alias("d"))
    slots = wins.join(items.select("item_id", F.split("i_marked", " ").alias("i")), "item_id").select("item_id", "n", "ipos", "hash", F.expr("slice(i, ipos + 1, n)").alias("i"))
    # A document's hits meet its text in one row, which gives each its own words only.
    per_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("n", "dpos", "hash")).alias("hits"))
    cut = F.expr("transform(hits, x -> struct(x.n as n, x.dpos as dpos, x.hash as hash, slice(d, x.dpos + 1, x.n) as d))")
    own_words = per_doc.join(texts, "doc_id").select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*")
    found = own_words.join(common.small(slots), ["hash", "n"])
    pairs = F.expr("filter(zip_with(i, d, (a, b) -> struct(a, b)), x -> x.a rlike '^[123]_')")
    found = found.select("doc_id", "item_id", "n", "ipos", (F.col("dpos") - F.col("ipos")).alias("diag"), F.col("dpos"), pairs.alias("pairs"))
    found = common.stash(found).df
    line = ["doc_id", "item_id", "n", "diag"]
    values = found.where("size(pairs) > 0").select(*line, F.explode("pairs").alias("p")).select(*line, "p.a", "p.b").distinct()
    values = values.groupBy(*line).agg(F.collect_list(F.struct("a", "b")).alias("v"))
    bad = values.where("size(v) > size(array_distinct(v.a)) or size(v) > size(array_distinct(v.b))")
    conflict = "exists(pairs, x -> exists(v, y -> (x.a = y.a) != (x.b = y.b)))"
    found = found.join(bad, line, "left").where(f"v is null or forall(pairs, x -> x.a = x.b) or not {conflict}")
    differs = F.max(F.expr("exists(pairs, x -> x.a != x.b)"))
    lines = found.groupBy(*line).agg(F.count_distinct("ipos").alias("n_windows"), F.min("ipos").alias("lo"), F.max("ipos").alias("hi"), (~differs).alias("exact"))
    good = lines.withColumn("n_words", F.least(F.col("n_windows") * F.col("n"), F.col("hi") - F.col("lo") + F.col("n")))
    best = F.max(F.struct("n_windows", "n_words", "exact")).alias("b")
    return good.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.n_windows").alias("n_windows"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.exact").alias("exact"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the contaminated documents. Rows with a null id stay."""
    (out,) = common.fresh(docs, "out_id")
    found = common.stash(contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(out)).distinct()).df
    return docs.join(common.small(found), F.col(id_col) == F.col(out), "left_anti")
