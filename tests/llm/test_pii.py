import hashlib
import random
import re

from tessera.llm import pii
from tests.llm import data


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in BASE.items()}


def corpus():
    rng = random.Random(5)
    bits = ["a.b+c@x-y.org", "@", "a@b", "x@y.z.", "@a@b.c", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0010.2.3.004", "99999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111",
            "+1 (234) 555-6789", "+4912345", "+44 20 7946 0958 12345678", "++49 30 1234567", "DE89 3704 0044 0532 0130 00", "123-45-6789", "card", "phone", "é", "𝔘", "日本", "\n", " ", ".", "-", "12", "+"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(40))) for _ in range(300)] + bits + [None, ""]


def test_base_spans_against_re(spark):
    texts = corpus()
    got = {r.doc_id: r for r in pii.digest(pii.find(data.frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        spans = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
        assert [got[i][f"n_{k}"] for k in BASE] == [len(v) for v in want.values()], t
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), t
        assert (got[i].spans + ",").startswith(spans + "," if spans else "")


def test_added_spans_need_checksum_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN DE88 3704 0044 0532 0130 00 no", "my ssn is 123-45-6789", "part 123-45-6789 of it", "tel +1 (234) 555-6789 99999 99999 99"]
    got = {r.doc_id: [(x.kind, x.value) for x in r.found] for r in pii.find(data.frame(spark, texts)).collect()}
    assert got[0] == [("iban", "DE89 3704 0044 0532 0130 00")] and got[1] == []
    assert got[2] == [("ssn", "123-45-6789")] and got[3] == []
    assert got[4] == [("phone_strict", "+1 (234) 555-6789")]


def test_redacted_text_has_none_left(spark):
    texts = corpus()
    out = pii.redact(data.frame(spark, texts))
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[len(texts) - 2] is None and kept[len(texts) - 1] == ""
    plain = data.frame(spark, ["write to a@b.org or 1.2.3.4, nothing else: 123"])
    assert pii.redact(plain).first().text == "write to <email> or <ip>, nothing else: 123"


def test_redacted_are_the_spans_found(spark):
    texts = ["tel +1 (234) 555-6789 2024 1999 07", "part 123-45-6789 of it", "my ssn is 123-45-6789", "x 4111111111111111@x.org y", "4111 1111 1111 1111 1.2.3.4", "ssn 123-45-6789 " + "z" * 60 + " 223-45-6789", "𝔘 1.2.3.4 é"]
    got = {r.doc_id: r.text for r in pii.redact(data.frame(spark, texts)).collect()}
    assert got == {0: "tel <phone_strict> 2024 1999 07", 1: texts[1], 2: "my ssn is <ssn>", 3: "x <email> y", 4: "<card> <ip>", 5: "ssn <ssn> " + "z" * 60 + " 223-45-6789", 6: "𝔘 <ip> é"}
    texts = corpus()
    found = {r.doc_id: r.found for r in pii.find(data.frame(spark, texts)).collect()}
    for r in pii.redact(data.frame(spark, texts)).collect():
        t = texts[r.doc_id]
        assert (r.text == t) == (not found[r.doc_id]), t


def test_odd_cases(spark):
    docs = data.odd(spark)
    got = pii.digest(pii.find(docs)).collect()
    assert len(got) == docs.count() and all(r.spans == "" for r in got)
    assert pii.redact(docs).columns == docs.columns
    assert pii.find(data.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.digest(pii.find(data.odd(spark)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_matches_in_one_text(spark):
    n = 30_000
    text = " ".join(f"user{i}@example.org" for i in range(n))
    r = pii.find(data.frame(spark, [text])).first()
    assert len(r.found) == n and all(text[x.start : x.end] == x.value for x in r.found)
