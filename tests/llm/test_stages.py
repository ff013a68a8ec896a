"""Language, decontamination, packing, main text and the pipeline of them."""

import random
import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, html, langid, packing
from tests.compare import DATA
from tests.llm import data
from tests.llm.test_simhash import shingles


def split(docs, part):
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == part)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(split(docs, 0))
    test = split(docs, 1).where("length(text) > 40")
    got = langid.identify(test, model, declared=F.lit(None), host=F.col("source")).join(test.select("doc_id", F.col("lang").alias("gold")), "doc_id").toPandas()
    assert (got.lang == got.gold).mean() > 0.9
    told = langid.identify(test, model, declared=F.col("lang"), host=F.col("source"))
    assert told.where("kept").count() >= 0.98 * test.count()


def test_language_odd_cases(spark):
    docs = data.odd(spark)
    model = langid.train(docs)
    got = langid.identify(docs, model, declared=F.col("lang"), host=F.col("source")).collect()
    assert len(got) == docs.count()
    assert all(not r.kept and r.lang is None for r in got if r.doc_id in (1, 2, 3))
    none = data.empty(spark)
    assert langid.identify(none, langid.train(none), declared=F.col("lang"), host=F.col("source")).count() == 0


def test_posterior_against_brute_force(spark):
    rng = random.Random(21)
    model = langid.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 20").limit(60).collect()]
    rows = []
    for i, t in enumerate(texts):
        at = rng.randrange(len(t))
        suffix = rng.choice(["org", "fr", None])
        rows.append((i, t[at : at + rng.randrange(5, 80)], rng.choice(["en", "fr", "tlh", None]), suffix, rng.choice(["a", "b", "c"]) + "." + (suffix or "x")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    got = {r.doc_id: r for r in langid.identify(docs, model, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host")).collect()}
    n = len(model.langs)
    codes = [langid._codes(b" " + r[1].encode().lower() + b" ") for r in rows]
    ll = [model.logp[c].astype(float).sum(axis=0) for c in codes]
    best = [int(x.argmax()) for x in ll]
    told = [r[2] if r[2] in model.langs else "other" if r[2] else "" for r in rows]

    def count(same):
        return np.bincount([best[j] for j in range(len(rows)) if same(j)], minlength=n).astype(float)

    whole = count(lambda j: True) + 1
    for i, r in enumerate(rows):
        me = np.eye(n)[best[i]]
        suffix, host, declared = (count(f) - me for f in (lambda j: rows[j][3] == r[3], lambda j: rows[j][3:] == r[3:], lambda j: told[j] == told[i]))
        prior = (suffix + 20 * whole / whole.sum()) / (suffix.sum() + 20)
        prior = (host + 20 * prior) / (host.sum() + 20)
        score = min(1, 60 / max(1, len(codes[i]))) * (ll[i] - ll[i].max()) + np.log(prior + 1e-9) + np.log((declared + 0.5) / whole)
        p = np.exp(score - score.max())
        assert abs(p.max() / p.sum() - got[i].prob) < 1e-6
        assert got[i].lang in (None, model.langs[int(score.argmax())]) and got[i].text_lang == model.langs[best[i]]


def test_evidence_of_pages(spark):
    page = "<!DOCTYPE html><!-- x --><HTML class=a lang='fr-CA'><head><title>t</title></head><body><article><p>Un mot, puis un autre.</p></article></body></html>"
    rows = [(1, "https://user@Blog.Example.FR:80/x?y", page, 0), (1, "no address", "<p lang=de>x</p>", 0), (None, None, None, 0), (2, "http://h/", "<html lang=english><p>", 0), (3, "", "<b" * 2000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = [tuple(r)[:1] + tuple(r)[2:] for r in langid.from_pages(df).collect()]
    assert got == [(1, "fr", "fr", "blog.example.fr"), (1, None, None, None), (None, None, None, None), (2, None, "h", "h"), (3, None, None, None)]
    assert langid.from_pages(df.where("false")).count() == 0


def test_pages_language(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    gold = {r.page_id: langid.declared_language(r.html) for r in pages.collect()}
    rows, model = langid.from_pages(pages), langid.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    for declared in (F.col("declared"), F.lit(None)):
        got = langid.identify(rows, model, id_col="id", declared=declared, suffix=F.col("suffix"), host=F.col("host")).collect()
        assert len(got) == pages.count() and sum(r.lang == gold[r.doc_id] for r in got) >= 0.95 * len(got)


ITEMS = [
    (0, "A farmer named Olga sells 12 apples for 5 dollars each and then buys 30 pears from Boris for 2 dollars"),
    (1, "What is the capital city of the largest country on the continent that lies south of here today"),
    (2, "Short one"), (3, None), (4, ""), (None, "never named at all by anybody in any of these many places"),
]


def test_reparameterised_questions(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    pad = " ".join(f"filler{i} words" for i in range(30))
    texts = [
        f"{pad} {ITEMS[0][1]} {pad}", f"{pad} A farmer named Vera sells 40 apples for 7 dollars each and then buys 11 pears from Ivan for 9 dollars {pad}",
        f"{pad} {ITEMS[1][1].upper()} {pad}", f"{pad} {' '.join(ITEMS[1][1].split()[:5])} {pad}", pad, None, "", "Short one",
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(data.frame(spark, texts), bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1)}
    assert got[0, 0].exact and not got[1, 0].exact
    left = decontaminate.clean(data.frame(spark, texts), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7]


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(0, "first take 5 red balls then again take 5 red balls out of the very same old box")], "item_id long, text string")
    texts = ["first take 8 red balls then again take 8 red balls out of the very same old box", "first take 8 red balls then again take 9 red balls out of the very same old box"]
    assert [r.doc_id for r in decontaminate.contaminated(data.frame(spark, texts), bench, n=17).collect()] == [0]


def test_one_altered_slot_leaves_the_other_windows(spark):
    item = "the committee bought 40 chairs for the new hall and asked every member to pay a small share of the cost before winter came and then 40 chairs were delivered to the wrong door"
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    texts = [item, item.replace("then 40", "then 41"), item.replace("40", "41"), item.replace("bought 40", "bought 41")]
    got = {r.doc_id: (r.n_windows, r.exact) for r in decontaminate.contaminated(data.frame(spark, texts), bench).collect()}
    n, kept = len(item.split()) - 9, lambda at: [i for i in range(len(item.split()) - 9) if not i <= at < i + 10]
    first, second = (i for i, w in enumerate(item.split()) if w == "40")
    assert got == {0: (n, True), 1: (len(kept(second)), True), 2: (n, False), 3: (len(kept(first)), True)}


def brute_templates(docs, items, n=10, least=5):
    """By comparing every window of every item with every window of every document. Words are (text, template)."""
    out = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            k, lines = min(len(item), n), {}
            for p in range(len(item) - k + 1 if k >= least else 0):
                own = item[p : p + k]
                if sum(t == w for w, t in own) < least:
                    continue
                for q in range(len(doc) - k + 1):
                    other = doc[q : q + k]
                    if [t for _, t in own] == [t for _, t in other]:
                        lines.setdefault(q - p, []).append((p, {(a[0], b[0]) for a, b in zip(own, other, strict=True) if a[0] != a[1]}))
            best = []
            for found in lines.values():
                met = set().union(*(v for _, v in found))
                clash = {x for x in met for y in met if (x[0] == y[0]) != (x[1] == y[1])}
                good = [(p, v) for p, v in found if all(a == b for a, b in v) or not v & clash]
                if good:
                    at = {p for p, _ in good}
                    best.append((len(at), min(len(at) * k, max(at) - min(at) + k), all(a == b for _, v in good for a, b in v)))
            if best:
                out.add((d, i, *max(best)))
    return out


def test_templates_against_brute_force(spark):
    rng = random.Random(8)

    def some(n):
        """Words, numbers, names and units, the first an ordinary word."""
        out = [("so", "so")]
        while len(out) < n:
            kind = rng.random()
            if kind < 0.7:
                w = rng.choice(("red", "ball", "sells", "apples", "takes", "from", "each", "box"))
                out.append((w, w))
            elif kind < 0.85:
                out.append((str(rng.randrange(4, 9)), "#"))
                if rng.random() < 0.5:
                    out.append((rng.choice(("kg", "hours")), "unit"))
            else:
                out.append((rng.choice(("Vera", "Ivan", "Nora")), "name"))
        return out

    def altered(words):
        """Some values replaced everywhere, or in one place only."""
        out, swap = list(words), {"4": "7", "Vera": "Nora", "kg": "hours"}
        for k, (w, t) in enumerate(out):
            if w != t and rng.random() < 0.1:
                out[k] = (rng.choice([x for x, y in words if y == t]), t)
        return [(swap.get(w, w) if w != t else w, t) for w, t in out] if rng.random() < 0.5 else out

    items = [some(n) for n in (4, 5, 7, 12, 18, 25, 30)]
    docs = [some(rng.randrange(1, 30)) + altered(rng.choice(items)) + some(rng.randrange(1, 30)) for _ in range(120)] + [some(40) for _ in range(10)]
    docs.append(docs[0] + docs[1] + docs[0])
    line = lambda x: " ".join(w for w, _ in x)
    bench = spark.createDataFrame([(i, line(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = decontaminate.contaminated(data.frame(spark, [line(x) for x in docs]), bench)
    want = brute_templates(docs, items)
    assert {(r.doc_id, r.item_id, r.n_windows, r.n_words, r.exact) for r in got.collect()} == want
    assert len({exact for *_, exact in want}) == 2 and len(want) > 50


def test_decontamination_odd_cases(spark):
    docs, bench = data.odd(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns and decontaminate.clean(docs, bench).count() == docs.count()
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0 == decontaminate.contaminated(data.empty(spark), bench).count()


def brute_fit(length, source, cluster, capacity):
    """The tightest bin that fits, found by looking at all of them."""
    bins, out = [], [None] * len(length)
    for i in sorted(range(len(length)), key=lambda i: (-length[i], i)):
        may = [(capacity - b[0], k) for k, b in enumerate(bins) if b[0] + length[i] <= capacity and b[0] < capacity and source[i] not in b[1] and cluster[i] not in b[2]]
        k = min(may)[1] if may else len(bins)
        if not may:
            bins.append([0, set(), set()])
        out[i] = (k, bins[k][0])
        bins[k][0] += length[i]
        if source[i] >= 0:
            bins[k][1].add(source[i])
        if cluster[i] >= 0:
            bins[k][2].add(cluster[i])
    return out


def test_best_fit_against_brute_force():
    rng = random.Random(8)
    for _ in range(20):
        n = rng.randrange(1, 200)
        x = [[rng.randrange(0, 101) for _ in range(n)], [rng.randrange(-1, 9) for _ in range(n)], [rng.randrange(-1, 30) for _ in range(n)]]
        bins, offsets = packing.best_fit(*x, 100)
        assert list(zip(bins, offsets, strict=True)) == brute_fit(*x, 100)


def test_packing(spark):
    rng = random.Random(9)
    texts = ["x" * rng.randrange(0, 400) for _ in range(200)] + ["long" * 300, None, ""]
    got = packing.pack(data.frame(spark, texts), capacity=512, shard_rows=64).collect()
    held, docs = defaultdict(list), defaultdict(list)
    for r in got:
        held[r.bin].append(r)
        docs[r.doc_id].append(r)
    assert {d: sum(r.length for r in v) for d, v in docs.items()} == {i: len(t or "") for i, t in enumerate(texts)}
    for v in held.values():
        v.sort(key=lambda r: (r.offset, r.length))
        assert all(a.offset + a.length <= b.offset for a, b in zip(v, v[1:])) and v[-1].offset + v[-1].length <= 512
        assert len({r.doc_id % 3 for r in v}) == len(v)
    assert packing.pack(data.odd(spark)).count() >= 10 and packing.pack(data.empty(spark)).count() == 0


def test_packed_sequences(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice("aé日 b") for _ in range(rng.randrange(0, 900))) for _ in range(90)]
    docs = data.frame(spark, texts)
    placed = packing.pack(docs, capacity=512, shard_rows=64).cache()
    got = {r.bin: bytes(r.data) for r in packing.sequences(docs, placed).collect()}
    for r in placed.collect():
        own = texts[r.doc_id].encode()[r.start : r.start + r.length]
        assert not r.length or got[r.bin][r.offset : r.offset + r.length] == own
    assert sum(map(len, got.values())) == sum(len(t.encode()) for t in texts)
    told = packing.fill(placed, 512).first()
    assert told.bins >= len(got) and 0 < told.filled <= 1
    again = packing.pack(docs.repartition(5), capacity=512, shard_rows=64).collect()
    assert sorted(again) == sorted(placed.collect())


def gold(page):
    """The marked blocks of a page of labelled_pages."""
    return " ".join(b.text for b in html.blocks(page) if b.label)


def test_main_text_held_out():
    field = html.train(html.labelled_pages(160, 1))
    pages = html.labelled_pages(60, 2)
    same = sum(html.main_text(field, p) == gold(p) for p in pages)
    assert same >= 0.85 * len(pages), same


#: Pages by another hand than the generator's, and their main text.
BY_HAND = [
    ('<p>A long prose paragraph stands here, with commas and a full stop. It goes on for a while.</p><p>Another one follows it, which is also quite long, and says a bit more.</p>',
     'A long prose paragraph stands here, with commas and a full stop. It goes on for a while. Another one follows it, which is also quite long, and says a bit more.'),
    ('<html><body><nav><a href=/>Start</a> <a href=/k>Kontakt</a></nav><div class=inhalt><h1>Der Fluss</h1><p>Ein langer Absatz steht hier, mit Kommas und einem Punkt. Er geht noch weiter, bis er endet.</p><p>Noch einer folgt, und auch er sagt etwas.</p></div><footer>&copy; wir</footer></body></html>',
     'Der Fluss Ein langer Absatz steht hier, mit Kommas und einem Punkt. Er geht noch weiter, bis er endet. Noch einer folgt, und auch er sagt etwas.'),
    ('<body><div id="mw-head"><ul><li><a href="#">Log in</a></li><li><a href="#">Talk</a></li></ul></div><div id="bodyContent" class="mw-body"><h1>Lake</h1><div class="mw-parser-output"><p>A lake is a body of water, surrounded by land. Lakes lie on land, and are not part of the ocean.</p><ul><li>Some lakes are fresh, others salty.</li><li>Some dry up, and come back.</li></ul></div></div><div id="footer"><ul><li><a href="#">Privacy</a></li><li><a href="#">About</a></li></ul></div></body>',
     'Lake A lake is a body of water, surrounded by land. Lakes lie on land, and are not part of the ocean. Some lakes are fresh, others salty. Some dry up, and come back.'),
    ('<body><header class="gh-head"><a class="gh-logo" href="/">My Blog</a><nav class="gh-menu"><a href="/a">Home</a><a href="/b">About</a></nav></header><main class="gh-main"><article class="gh-article"><h1>On bread</h1><p>Good bread takes time, flour, water and salt. Nothing else is needed, as every baker knows.</p><h2>Time</h2><p>Leave the dough overnight, and bake it in the morning.</p></article></main><footer class="gh-foot">&copy; My Blog</footer></body>',
     'On bread Good bread takes time, flour, water and salt. Nothing else is needed, as every baker knows. Time Leave the dough overnight, and bake it in the morning.'),
    ('<body><div class="cookie-consent"><p>We use cookies to improve this site.</p><button>OK</button></div><div class="story-wrap"><h1>Storm hits coast</h1><p>A storm hit the coast on Monday, and trees fell in many towns. Nobody was hurt, said the mayor.</p><p>More rain is due, so people should stay at home.</p></div><aside class="sidebar"><h3>Related</h3><ul><li><a href=1>Other news</a></li><li><a href=2>Sports</a></li></ul></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>I saw it all happen, it was quite a sight.</p></div></section></body>',
     'Storm hits coast A storm hit the coast on Monday, and trees fell in many towns. Nobody was hurt, said the mayor. More rain is due, so people should stay at home.'),
]


def test_main_text_of_pages_by_hand():
    assert [html.main_text(html.default_field(), p) for p, _ in BY_HAND] == [w for _, w in BY_HAND]


def test_main_text_of_the_tables_pages(spark):
    """Their article element tells the main text; names of elements are no part of the text's own features."""
    field = html.default_field()
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        own = html.blocks(r.html or "")
        assert html.main_text(field, r.html or "") == " ".join(b.text for b in own if "tag:article" in b.path)


def test_scanner_takes_linear_time():
    field = html.default_field()
    for page in ("<a b" * 250_000 + '"', "<div class=x>y" * 70_000, "<b>x" * 250_000, "<p class='it s>x" * 60_000, "<script x" * 100_000, "<!-" * 300_000, "<a =" * 250_000, "<i>" * 100_000 + "<article>" + "</i>" * 100_000):
        began = time.process_time()
        html.main_text(field, page)
        assert time.process_time() - began < 20


def test_tags_and_attributes():
    text = lambda page: " ".join(b.text for b in html.blocks(page))
    assert text("<p class=it's>One</p><p>Two it's</p>") == "One Two it's"
    assert text("a < b and <3 c<") == "a < b and <3 c<"
    assert text('<p title="x>One</p><p>Two</p>') == "One Two"
    assert text("<p title=\"a > b\" data-x='</p>'>One&nbsp;&amp;\u2003two</p>") == "One & two"


def test_main_text_odd_cases(spark):
    page = "<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>First &amp; foremost\n text, with commas.<p>Second one here.</article><footer>&copy; us</footer>"
    df = spark.createDataFrame([(0, "u", page, 1), (0, None, page, 1), (None, "u", None, 1), (2, "u", "", 1), (3, "u", "<p>" * 3000, 1), (4, "u", "<b" * 3000, 1), (5, "u", "x&#0;&#xD800;<!-- y", 1)], "page_id long, url string, html string, text int")
    got = html.extract(df).collect()
    assert [r.text for r in got if r.page_id == 0] == ["Title First & foremost text, with commas. Second one here."] * 2
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == 7
    assert html.extract(df.where("false")).count() == 0


def test_markup_without_end_hides_no_text():
    text = lambda page: " ".join(b.text for b in html.blocks(page))
    for x in ('<svg viewBox="0 0 1 1"/>', "<svg-icon name=x></svg-icon>", "<template-card>", "<svg>", "<iframe src=x>", "<select>", "<object>", "<noscript>"):
        assert text(f"<p>One.</p>{x}<p>Two.</p>") == "One. Two.", x
    assert text("<p>One.</p><svg><text>no</text></svg ><template><p>no</p></template><script>no</script><object>Two.</object><noscript>Three.</noscript><style>no") == "One. Two. Three."


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, DATA).cache()
        assert out.columns == docs.columns, name
        if name == "near_duplicates":
            before, after = (sorted((r.doc_id, r.text or "") for r in x.collect()) for x in (kept, out))
            sets = [shingles(x[1].lower().split()) for x in before]
            near = {i for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
            gone = {i for i, x in enumerate(before) if x not in after}
            assert gone <= near and len(gone) >= 0.9 * len(near) > 0
        if name == "decontamination":
            bad = decontaminate.contaminated(kept, spark.read.parquet(f"{DATA}/benchmark.parquet")).select("doc_id").distinct()
            assert out.count() == kept.count() - bad.count()
        if name == "personal_data":
            assert out.count() == kept.count()
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_pipeline_odd_cases(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (data.odd(spark), data.empty(spark)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0
