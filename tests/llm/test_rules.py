"""Operators whose results come from a fitted model or from page structure."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases import PASSAGE, no_docs, odd_docs, pairs

import corpus_pipeline
from attesta.llm import decontaminate, html_text, merge_dropout, pii, simhash, toxicity
from attesta.llm.decontaminate import clean, contamination
from attesta.llm.words import Words, mix
from attesta.session import table

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


# --- toxicity ----------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 5 < 3"))
    got = toxicity.severity(docs, model).join(labels.where("doc_id % 5 >= 3").withColumnRenamed("toxic", "label"), "doc_id").collect()
    hit = sum(r.toxic and r.label for r in got)
    assert hit >= 0.7 * sum(r.label for r in got) and sum(r.toxic and not r.label for r in got) <= 0.02 * len(got)
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in got)
    assert model.thresholds == sorted(model.thresholds)


def test_toxicity_odd_rows(spark):
    draw = random.Random(7)
    words = [f"plain{k}" for k in range(200)]
    texts = [(k, " ".join(draw.choice(words) for _ in range(60)) + (" nastyword" * draw.randint(1, 3) if k % 4 == 0 else "")) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(None, 1, 1), (5, None, None), (0, 1, 1)], LABELS)
    model = toxicity.fit(docs, labels)
    more = docs.unionByName(odd_docs(spark).select("doc_id", "text"))
    got = toxicity.severity(more, model).collect()
    assert len(got) == 400 + odd_docs(spark).count()
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in got[:400])
    assert not any(r.toxic for r in got[400:])
    left = toxicity.civil(odd_docs(spark), model)
    assert left.columns == odd_docs(spark).columns and left.count() == odd_docs(spark).count()
    assert toxicity.severity(no_docs(spark), model).count() == 0
    # One class, no labels, or no texts: the share of toxic labels for every text, no error.
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        flat = toxicity.fit(docs, some)
        assert flat.weights == {} and len({round(r.severity, 9) for r in toxicity.severity(docs, flat).collect()}) == 1
    assert toxicity.fit(no_docs(spark), labels).weights == {}


# --- decontamination ---------------------------------------------------------------------------


def test_contamination_against_whole_passages(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    read = lambda t: duckdb.sql(f"select * from '{SF}/{t}.parquet'").fetchall()
    passages = {i: f" {' '.join(t.split())} " for i, t in read("benchmark")}
    want = {(d, i) for d, t, *_ in read("documents") for i, p in passages.items() if p in f" {' '.join(t.split())} "}
    got = {(r.doc_id, i): r for r in contamination(docs, items).collect() for i in r["items"]}
    assert want and want <= set(got)
    for d, i in set(got) - want:  # the rest hold most of the passage's words in order
        words = next(t for k, t, *_ in read("documents") if k == d).split()
        item = passages[i].split()
        assert max(sum(a == b for a, b in zip(words[k:], item)) for k in range(len(words))) >= 0.5 * len(item)


@pytest.mark.parametrize("text, found", [
    ("A train leaves the old station of Avonlea at 9 km per hour and Marta counts 14 passing trees before it stops there.", True),
    ("A train leaves the old station of Bexhill at 31 miles per hour and Jonas counts 7 passing trees before it stops there.", True),
    ("Say: a train leaves the old station of Avonlea at 9 km per hour and Marta counts 14 passing trees before it stops there. Then more.", True),
    ("A ship leaves a new harbour near Avonlea with 9 km to go and Marta counts 14 of them.", False),
    ("", False),
])
def test_reparameterised_items(spark, text, found):
    items = spark.createDataFrame([(7, "A train leaves the old station of Avonlea at 9 km per hour and Marta counts 14 passing trees before it stops there.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert contamination(docs, items).first().contaminated == found


def test_slots_must_agree(spark):
    item = "First Anna gives the small box to Berta and then Anna takes the other box away from Berta while Berta looks on"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    same = item.replace("Anna", "Carla").replace("Berta", "Doris")
    mixed = "First Carla gives the small box to Doris and then Emma takes the other box away from Carla while Frida looks on"
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    assert dict(pairs(contamination(docs, items), "doc_id", "contaminated")) == {1: True, 2: False}


def test_contamination_across_diagonals(spark):
    words = [f"word{k}" for k in range(30)]
    trip = "On the way from New York to the old harbour the driver counts twenty five red lamps and then drives back to New York with all of the lamps"
    texts = {
        1: " ".join(words), 2: trip, 3: " ".join(f"short{k}" for k in range(15)),
    }
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    other = trip.replace("New York", "Boston").replace("twenty five", "25")
    docs = spark.createDataFrame([
        (1, " ".join(["so", *words[:10], "more", *words[10:20], "more", *words[20:], "end"])),
        (2, "Say this: " + other),
        (3, texts[3].replace("short7", "other")),
        (4, " ".join([*words[:9], *["gap"] * 100, *words[20:26]])),
        (5, other.replace("Boston", "Paris", 1).replace("lamps", "hats").replace("harbour", "bridge")),
        (6, " ".join(f"short{k}" for k in range(6)) + " and then"),
    ], "doc_id long, text string")
    assert {r.doc_id: r["items"] for r in contamination(docs, items).collect()} == {1: [1], 2: [2], 3: [3], 4: [], 5: [], 6: []}


def test_contamination_by_names_and_numbers(spark):
    pens = "Tom buys 3 red pens at the shop. Tom gives 2 of the pens to Ann. Tom then loses 1 pen on the bus."
    sums = "Add 3 and 14 and 25 and 36, take 7 and 8 from it, share by 5 and 6, then name the rest of 91 and 12"
    same = "first the cook puts 3 eggs in the small bowl and then adds another 3 to it"
    items = spark.createDataFrame([(1, pens), (2, sums), (3, same)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, pens.replace("Tom", "Ben")),
        (2, "Add 4 and 15 and 26 and 37, take 9 and 1 from it, share by 2 and 3, then name the rest of 82 and 11"),
        (3, same.replace("another 3", "another 4")),
        (4, "Tom sees 3 red hats at the pond. Ann finds 2 of the hats in May. Tom then keeps 1 hat on the shelf."),
        (5, "between 4 and 15 and 26 and 37 or 9 and 1"),
    ], "doc_id long, text string")
    assert {r.doc_id: r["items"] for r in contamination(docs, items).collect()} == {1: [1], 2: [2], 3: [3], 4: [], 5: []}


def test_contamination_odd_rows(spark, monkeypatch):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (None, PASSAGE), (5, "Negative ids are ids, too!")], "item_id long, text string")
    for most in (1 << 20, 0):  # with the windows sent to all tasks, and by the join alone
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
        got = contamination(docs, items).collect()
        assert len(got) == docs.count()
        want = {7: [1, 2], 8: [1, 2], -5: [5]}
        assert all(r["items"] == want.get(r.doc_id, []) and r.n_items == len(r["items"]) and r.contaminated == bool(r["items"]) for r in got)
    left = clean(docs, items)
    assert left.columns == docs.columns and left.count() == docs.where("doc_id is null or doc_id not in (7, 8, -5)").count()
    assert contamination(no_docs(spark), items).count() == 0
    assert not any(r.contaminated for r in contamination(docs, items.limit(0)).collect())


# --- pages -------------------------------------------------------------------------------------

ARTICLE, OPEN, OUTSIDE = html_text.ARTICLE, html_text.OPEN, html_text.OUTSIDE


@pytest.mark.parametrize("page, want", [
    (None, []),
    ("", []),
    ("plain &lt;text&gt; &amp more", [("plain <text> & more", OPEN)]),
    ("<article><h1>T&eacute;</h1><p>a\n  <b>b</b>c<br>d&nbsp;e</p></article>", [("Té", ARTICLE), ("a bc d e", ARTICLE)]),
    ("<nav>n</nav><main><p>a<p>b<aside>x<aside>y</aside></aside>c</main>tail", [("n", OUTSIDE), ("a", ARTICLE), ("b", ARTICLE), ("x", OUTSIDE), ("y", OUTSIDE), ("c", ARTICLE), ("tail", OUTSIDE)]),
    ("<article><header>h</header>x <a href='a>b'>link</a><form><input>f</form><script>if(a<b)'</p>'</script>z</article>", [("h", OUTSIDE), ("x link", ARTICLE), ("f", OUTSIDE), ("z", ARTICLE)]),
    ("<article>a<div class='user-comments'><article>no</article></div>b</article>", [("a", ARTICLE), ("no", OUTSIDE), ("b", ARTICLE)]),
    ("<p>one<p hidden>two</p><div role=navigation>three</div><div id=adSlot>four</div><p class=lead>five", [("one", OPEN), ("two", OUTSIDE), ("three", OUTSIDE), ("four", OUTSIDE), ("five", OPEN)]),
    ("<p>a<!-- <p>b --><style>p{}</style>c</p><script>open <p>d", [("ac", OPEN)]),
    ("<p>cut <b", [("cut", OPEN)]),
    ("<article><script>if(a<b) // it's</script><p>It's text</p><p>more \"quoted</p></article>", [("It's text", ARTICLE), ('more "quoted', ARTICLE)]),
    ("<article><div class=article-header><h1>T</h1></div><h2 id=related-work>R</h2><div class=site-header>s</div></article>", [("T", ARTICLE), ("R", ARTICLE), ("s", OUTSIDE)]),
    ("<article>teaser</article><p>" + "body " * 200, [("teaser", OPEN), (("body " * 200).strip(), OPEN)]),
    ("</div></p>stray<nav>never closed <p>x", [("stray", OPEN), ("never closed", OUTSIDE), ("x", OUTSIDE)]),
])
def test_blocks(page, want):
    assert html_text.blocks(page) == want


def test_host_suffix_array(spark):
    notice = " ".join(f"boiler{k}" for k in range(12))
    unique = lambda k: " ".join(f"word{k}x{j}" for j in range(12))
    rows = [(k, f"http://h.example/{k}", f"<div>{notice}</div><div>{unique(k)}</div><div>short</div>") for k in range(3)]
    rows += [(10, "http://other.example/a", f"<p>{notice}</p>"), (11, None, None), (None, "x", ""), (12, "http://h.example/9", f"<article>{notice}</article>")]
    rows += [(13, "http://twice.example/", f"<p>{unique(13)}</p>")] * 2
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, row int, text string")
    got = pairs(html_text.main_text(pages), "page_id", "url", "text", "n_chars")
    text = {k: f"{unique(k)}\nshort" for k in range(3)} | {10: notice, 11: "", None: "", 12: notice, 13: unique(13)}
    assert got == sorted(((i, u, text[i], len(text[i])) for i, u, _ in rows), key=repr)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    """Two addresses of one host with one body: repetition across them says nothing, across other pages it does."""
    notice, body = (" ".join(f"{w}{k}" for k in range(12)) for w in ("boiler", "word"))
    rows = [(k, f"http://h.example/{k}", f"<div>{notice}</div><div>{body}</div>") for k in (1, 2)] + [(3, "http://h.example/3", f"<div>{notice}</div><p>else</p>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: body, 2: body, 3: "else"}


def test_copies_with_other_menus_or_a_changed_block_keep_their_text(spark):
    text = lambda w, n: " ".join(f"{w}{k}" for k in range(n))
    foot, first, second = text("foot", 14), text("one", 40), text("two", 50)
    page = lambda menu, *parts: f"<nav>{menu}</nav>" + "".join(f"<div>{p}</div>" for p in parts)
    # Two addresses whose menus mark the page that is open, on a host of their own and beside pages with the same footer.
    rows = [(k, f"http://{h}.example/{k}", page(f"home here{k}", first, second, *more)) for k, h, more in ((1, "lone", []), (2, "lone", []), (3, "h", [foot]), (4, "h", [foot]))]
    rows += [(k, f"http://h.example/{k}", page("home", text(f"own{k}x", 30), foot)) for k in range(10, 20)]
    # The same text with a line of its own, and a page that has little but the footer.
    rows += [(5, "http://h.example/5", page("home", "printed on Monday", first, second, foot)), (6, "http://h.example/6", page("home", "call us", foot))]
    want = {k: f"{first}\n{second}" for k in (1, 2, 3, 4)} | {k: text(f"own{k}x", 30) for k in range(10, 20)} | {5: f"printed on Monday\n{first}\n{second}", 6: "call us"}
    assert {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_formulas_and_examples_are_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x^2</annotation></math> be.</p><xmp>a <b> c</xmp><p>End</p></article>"
    assert html_text.blocks(page) == [("Let x=2 be.", ARTICLE), ("a <b> c", ARTICLE), ("End", ARTICLE)]


def test_pages_keep_whole_articles(spark):
    import html
    import re

    got = {r.page_id: r for r in html_text.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for i, url, page in duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall():
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(p for p in parts if p)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))


# --- pipeline ----------------------------------------------------------------------------------


def plain_near(fps):
    """Smallest id reachable from each id of {id: long fingerprint} by links of at most NEAR_BITS bits and a common key."""
    ids = sorted(fps)
    codes = np.array([np.frombuffer(fps[i], np.uint64) for i in ids]).reshape(-1, simhash.LANES)
    keys = simhash.long_keys(codes) if len(ids) else codes
    group = np.arange(len(ids))
    moved = True
    while moved:
        moved = False
        for k in range(len(ids)):
            near = (np.bitwise_count(codes ^ codes[k]).sum(1) <= simhash.NEAR_BITS) & (keys == keys[k]).any(1)
            low = group[near].min()
            moved, group[k] = moved or low != group[k], low
    return {i: ids[g] for i, g in zip(ids, group.tolist())}


def test_near_texts_against_all_pairs(spark):
    """On the stored and the odd documents, and drawn copies of a text with more and more words changed."""
    draw = random.Random(6)
    words = [f"w{draw.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(60):
        changed = list(words)
        for k in draw.sample(range(150), i // 3):
            changed[k] = f"z{draw.randint(0, 10**6)}"
        rows.append((10**7 + i, " ".join(changed)))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    fps = {r.doc_id: bytes(r.fp) for r in simhash.long_fingerprints(docs).collect()}
    want = plain_near(fps)
    got = {r.doc_id: r.component_id for r in simhash.near_texts(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)
    assert all(got[10**7 + i] == 10**7 for i in range(6)) and got[10**7 + 59] != 10**7
    assert {r.doc_id for r in simhash.one_each(docs).collect()} == set(want.values())
    odd = odd_docs(spark)
    found = simhash.near_texts(odd).collect()
    assert len(found) == odd.count() and simhash.near_texts(no_docs(spark)).isEmpty()
    named = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert named[2] == named[3] == named[4] == 2 and named[5] == named[6] == 5


def test_long_fingerprint_is_a_majority(spark):
    text = "The cat sat on THE mat and the cat sat on the mat again, then left"
    fp = np.frombuffer(bytes(simhash.long_fingerprints(spark.createDataFrame([(1, text), (2, text.lower()), (3, "two words"), (4, "")], "doc_id long, text string")).orderBy("doc_id").collect()[0].fp), np.uint64)
    words = Words(pa.array([text]), lower=True)
    hashes = {int(h) for h in words.sequences(words.hashes(), 5)[words.whole(5)]}
    step = np.random.default_rng(9).integers(1, 1 << 63, simhash.LANES, dtype=np.uint64)
    assert len(hashes) < len(text.split()) - 4  # one shingle comes twice
    for lane in range(simhash.LANES):
        values = [int(mix(np.array([h], np.uint64) + step[lane])[0]) for h in hashes]
        assert int(fp[lane]) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_pipeline_against_its_operators(spark):
    docs, labels, items = (table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, labels)
    stay = {r.doc_id for r in toxicity.severity(docs, model).collect() if not r.toxic}
    group = plain_near({r.doc_id: bytes(r.fp) for r in simhash.long_fingerprints(docs).collect() if r.doc_id in stay})
    stay = {i for i in stay if group[i] == i}
    stay -= {r.doc_id for r in decontaminate.matches(docs.where(docs.doc_id.isin(list(stay))), items).collect()}
    left = {i: pii.redacted(texts[i], pii.spans(texts[i])) for i in stay}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == left.keys() and len(corpus_pipeline.STAGES) == 5
    decode = merge_dropout.Segmenter(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")).decode
    assert all(r.lossless and decode(r.ids) == left[i] for i, r in got.items())


def test_stages_on_odd_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs(spark).drop("key", "block", "fp", "row", "words"), no_docs(spark).drop("key", "block", "fp", "row", "words")):
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
            if name != "pieces":
                assert out.columns == docs.columns
