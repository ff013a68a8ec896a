"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores. DataFrame functions only.

Base kinds are email, ip, card and phone; the method adds iban (mod 97), ssn and phone_strict (a complete number of the
form +1 (234) 555-6789 where the base phone pattern ran on into other digits). The patterns are written so that Java's
engine runs each in linear time and without recursion: possessive loops, and lookbehinds that start a match only at a
run's beginning or where the last match ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

BASE = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone_strict": r"\+[0-9]{1,3}\x20\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}(?![0-9])",
}
#: What a text must hold for the pattern to be tried.
HINT = {"email": "@", "ip": ".", "phone": "+", "ssn": "-", "phone_strict": "+"}
#: Words that raise a span's score when they stand within NEAR characters, and the kinds' scores before that.
CONTEXT = {
    "email": "mail|contact|address|write", "ip": "ip|host|server|address|login", "card": "card|visa|master|credit|debit|payment|cvv",
    "phone": "phone|tel|call|mobile|fax|cell", "iban": "iban|bank|account|konto|compte|cuenta", "ssn": "ssn|social|security", "phone_strict": "phone|tel|call|mobile|fax|cell",
}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "phone_strict": 0.6}
NEAR = 40
#: Matches of a text whose places are summed together.
CHUNK = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Over a string of digits."""
    worth = F.transform(F.split(F.reverse(d), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((2 * x.cast("int")) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(m: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count 10 to 35, the rest by 97 is 1."""
    s = F.regexp_replace(m, " ", "")
    chars = F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _matched(df: DataFrame, kind: str, text: str, m_name: str, p_name: str) -> DataFrame:
    """With columns of all raw matches and of the pieces of text between them."""
    none = F.array().cast("array<string>")
    m = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))
    df = df.withColumn(m_name, F.when(F.instr(text, HINT[kind]) > 0, m).otherwise(none) if kind in HINT else m)
    return df.withColumn(p_name, F.when(F.size(m_name) > 0, F.split(F.col(text), PATTERNS[kind], -1)).otherwise(none))


def _spans(kind: str) -> Column:
    """array<struct<kind, start, end, value, score>> of the valid matches, from m_<kind> and p_<kind>."""
    m, p = f"m_{kind}", f"p_{kind}"
    # Lengths are summed in chunks, whose own sums are summed first, so that no long array is built up one by one.
    step = "(acc, x) -> struct(acc.pos + x.a + x.b as pos, concat(acc.out, array(acc.pos + x.a)) as out), acc -> acc.out"
    at = F.expr(f"""aggregate(array(zip_with(slice({p}, 1, size({m})), {m}, (a, b) -> struct(length(a) as a, length(b) as b))), cast(array() as array<bigint>), (none, lens) ->
        aggregate(array(transform(sequence(0, (size(lens) - 1) div {CHUNK}), c -> slice(lens, c * {CHUNK} + 1, {CHUNK}))), cast(array() as array<bigint>), (none, chunks) ->
        flatten(zip_with(chunks,
            aggregate(chunks, struct(0L as pos, cast(array() as array<bigint>) as out), (acc, chunk) -> struct(acc.pos + aggregate(chunk, 0L, (s, x) -> s + x.a + x.b) as pos, concat(acc.out, array(acc.pos)) as out), acc -> acc.out),
            (chunk, begin) -> aggregate(chunk, struct(begin as pos, cast(array() as array<bigint>) as out), {step})))))""")
    near = lambda i: F.lower(F.concat(F.right(F.col(p)[i], F.lit(NEAR)), F.lit(" "), F.left(F.col(p)[i + 1], F.lit(NEAR)))).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})")
    span = lambda i: F.struct(F.lit(kind).alias("kind"), F.col(f"at_{kind}")[i].alias("start"), (F.col(f"at_{kind}")[i] + F.length(F.col(m)[i])).alias("end"), F.col(m)[i].alias("value"), (F.lit(SCORE[kind]) + F.when(near(i), 0.3).otherwise(0.0)).alias("score"))
    indexes = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: valid(kind, F.col(m)[i]))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>")
    return at, F.when(F.size(m) > 0, F.transform(indexes, span)).otherwise(none)


def _with_found(df: DataFrame, text: str, keep: list[str], min_score: float) -> DataFrame:
    """The columns `keep` of df, and found. No column of df may be called as the helpers here are."""
    for kind in PATTERNS:
        df = _matched(df, kind, text, f"m_{kind}", f"p_{kind}")
    for kind in PATTERNS:
        at, spans = _spans(kind)
        df = df.withColumn(f"at_{kind}", F.when(F.size(f"m_{kind}") > 0, at)).withColumn(f"s_{kind}", spans)
    strict = F.filter("s_phone_strict", lambda x: (x["score"] >= min_score) & ~F.exists("s_phone", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    added = [F.filter("s_iban", lambda x: x["score"] >= min_score), F.filter("s_ssn", lambda x: x["score"] >= min_score), strict]
    return df.select(*keep, F.concat(*(F.col(f"s_{k}") for k in BASE), *added).alias("found"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.6) -> DataFrame:
    """One row (doc_id, found) per row of docs; found: array of (kind, start, end, value, score), in code points, end exclusive.

    Base spans always stay; an added one must reach min_score and not overlap a base span of the same sort.
    A null text is empty and has no spans. Null and repeated ids each give a row; other columns are ignored; an empty
    table gives an empty one. No shuffle: each row is worked on by itself, in time linear in its text and, up to millions
    of matches, in their number."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _with_found(df, "text", ["doc_id"], min_score)


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) from find()'s rows."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", min_score: float = 0.6) -> DataFrame:
    """docs with each span that find() reports replaced by <kind>; overlapping spans are one, of the first's kind, the longer
    one's if two begin at one place.

    What find() reports of the result, where a removal lays a span bare, is replaced too, once. The kinds written count
    as no context there. A null text stays null."""
    columns = docs.columns
    df = docs.select(F.struct(*(docs[f"`{c}`"] for c in columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for _ in range(2):
        df = _with_found(df, "text", ["row", "text"], min_score)
        spans = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("by_length"), x["end"].alias("end"), x["kind"].alias("kind"))))
        # Spans in order: up to where the text is written, and what is written. A kind is led by x, so that it isn't a word of its own.
        step = "if(x.start < acc.pos, struct(greatest(acc.pos, x.end) as pos, acc.out as out), struct(x.end as pos, concat(acc.out, substring(text, cast(acc.pos + 1 as int), cast(x.start - acc.pos as int)), '<x', x.kind, '>') as out))"
        out = F.expr(f"aggregate(spans, struct(0L as pos, '' as out), (acc, x) -> {step}, acc -> concat(acc.out, substring(text, cast(acc.pos + 1 as int))))")
        df = df.withColumn("spans", spans).select("row", F.when(F.size("spans") > 0, out).otherwise(F.col("text")).alias("text"))
    text = F.regexp_replace("text", f"<x({'|'.join(PATTERNS)})>", "<$1>")
    return df.select(*(F.when(F.col("row")[c].isNotNull(), text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns))
