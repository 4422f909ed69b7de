"""Fill-in-middle, licence scans and hard negatives against plain versions, on whole small tables and odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from cases import no_docs, odd_docs
from pyspark.sql import functions as F

from attesta.llm import fill_middle, hard_negatives, license_scan, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["stored", "odd", "none"])
def docs(request, spark):
    return {"stored": lambda: spark.read.parquet(f"{SF}/documents.parquet"), "odd": lambda: odd_docs(spark), "none": lambda: no_docs(spark)}[request.param]()


def plain_fill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<P>|<S>|<M>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, middle, tail = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}"
    return n, "psm", len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}"


def test_fill_in_middle(docs):
    want = sorted(((r.doc_id, *plain_fill(r.doc_id, r.text), r.text or "") for r in docs.collect()), key=repr)
    for block in (fill_middle.BLOCK, 7):
        got = sorted((tuple(r) for r in fill_middle.fill_in_middle(docs, block=block).collect()), key=repr)
        assert got == want


def test_fill_in_middle_cuts():
    draw = random.Random(2)
    for _ in range(1500):
        text = "".join(draw.choice("ab Z9\n<>PSMé漢😀") for _ in range(draw.randint(0, 90)))
        units, laid = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), fill_middle.Blocks(np.frombuffer(text.encode(), np.uint8), draw.randint(1, 9))
        assert (laid.units, laid.points) == (len(units), len(text))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert laid.cut(k) == (len(head.encode()), len(head))
        i = draw.randint(-5, 10**6)
        n, form, a, b, out = fill_middle.arranged(text.encode(), i, block=draw.randint(1, 9))
        assert (n, form, a, b, out.decode()) == plain_fill(i, text) and fill_middle.restored(out, form).decode() == text


def test_fenwick():
    draw = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 13, 64, 100):
        counts = draw.integers(0, 4, (n, 2))
        tree, ends = fill_middle.Fenwick(counts), np.cumsum(counts, 0)
        for k in range(int(ends[-1, 0])):
            at, before = tree.descend(k)
            assert at == np.searchsorted(ends[:, 0], k, "right") and (before == (ends[at] - counts[at])).all()


def test_fill_in_middle_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_fill_middle(spark, SF).collect():
        *head, out = plain_fill(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == head
        assert [r.output_sha256, r.restored_sha256] == [hashlib.sha256(x.encode()).hexdigest() for x in (out, texts[r.doc_id] or "")]


BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain_places(text):
    """(words, [(start, label)]) of the base phrases, word by word."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = []
    for k in range(len(words)):
        found += [(k, name) for phrase, name in BASE.items() if words[k : k + phrase.count(" ") + 1] == phrase.split()]
    return len(words), found


def plain_value(tokens):
    """(freedom, chosen) of the longest whole expression, by recursive descent on every beginning."""

    def choice(at):
        value, at = both(at)
        while tokens[at : at + 1] == ["or"]:
            other, at = both(at + 1)
            value = value if value[0] >= other[0] else other
        return value, at

    def both(at):
        value, at = one(at)
        while tokens[at : at + 1] == ["and"]:
            other, at = one(at + 1)
            value = (min(value[0], other[0]), value[1] | other[1])
        return value, at

    def one(at):
        if tokens[at : at + 1] == ["("]:
            value, at = choice(at + 1)
            if tokens[at : at + 1] != [")"]:
                raise ValueError
            at += 1
        elif at < len(tokens) and tokens[at] not in ("and", "or", "with", "(", ")"):
            value, at = (license_scan.freedom(tokens[at]), {tokens[at]}), at + 1
        else:
            raise ValueError
        while tokens[at : at + 1] == ["with"]:
            other, at = one(at + 1)
            value = (max(value[0], 0.6), {"+".join(sorted(value[1])) + "-with-" + "+".join(sorted(other[1]))})
        return value, at

    every, best = tokens, None
    for n in range(1, len(every) + 1):
        tokens = every[:n]
        try:
            value, end = choice(0)
        except ValueError:
            continue
        if end == n:
            best = value
    return best


def test_license_places(docs):
    got = sorted(((r.doc_id, r.n_words, tuple(r.places), tuple(r.base_labels)) for r in license_scan.licences(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        n, found = plain_places(r.text)
        want.append((r.doc_id, n, tuple(k for k, _ in found), tuple(sorted({x for _, x in found}))))
    assert got == sorted(want, key=repr)


def test_license_places_of_drawn_texts():
    draw = random.Random(4)
    pieces = ["under", "the", "mit", "MIT", "license", "apache", "Apache License", "version", "2", "2.0", "cc", "CC-BY-NC", "by", "nc", "é", "\x1f", "\u00a0", "x"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) + draw.choice([" ", ", ", "-", "", "\n"]) for _ in range(draw.randint(0, 25)))
        n, found = plain_places(text)
        got = license_scan.scan(text)
        assert (got.n_words, got.places, got.base) == (n, [k for k, _ in found], sorted({x for _, x in found})), repr(text)
        assert set(got.base) <= set(got.labels) and 0 <= got.score <= 1


def test_shunting_yard():
    draw = random.Random(5)
    for _ in range(4000):
        tokens = [draw.choice(["(", ")", "and", "or", "with", "mit", "gpl-2", "cc-by-nc", "x", "mit", "gpl-3"]) for _ in range(draw.randint(0, 9))]
        got, want = license_scan.evaluate(license_scan.postfix(tokens)), plain_value(tokens)
        assert (got and (got.freedom, set(got.chosen))) == want, tokens


@pytest.mark.parametrize("text, labels, score, expressions", [
    ("// SPDX-License-Identifier: MIT", "mit", 1.0, ["mit"]),
    ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */", "gpl-2-with-classpath-exception-2", 0.6, ["gpl-2 classpath-exception-2 with"]),
    ("SPDX-License-Identifier: (MIT OR GPL-3.0-or-later) AND CC-BY-NC-4.0\nelse", "cc-by-nc,gpl-3-or-later,mit", 0.2, ["mit gpl-3-or-later or cc-by-nc and"]),
    ("SPDX-License-Identifier: MIT AND", "mit", 1.0, ["mit"]),
    ("SPDX-License-Identifier:\nMIT", "", 0.0, []),
    ("Licensed under the MIT License or the Apache License, Version 2.0, at your option.", "apache-2,mit", 1.0, ["mit apache-2 or"]),
    ("Licensed under the GNU General Public License, version 3, with the Classpath exception.", "gpl-3-with-classpath-exception", 0.6, ["gpl-3 classpath-exception with"]),
    ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa", 0.2, ["cc-by-nc-sa"]),
    ("Released under the MIT License. Much later and in quite another place: all rights reserved.", "mit,proprietary", 0.0, ["mit", "proprietary"]),
    ("no statement at all", "", 0.0, []),
])
def test_license_statements(text, labels, score, expressions):
    got = license_scan.scan(text)
    assert (",".join(got.labels), got.score, got.expressions) == (labels, score, expressions)


def test_license_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_license_scan(spark, SF).collect()
    assert len(got) == len(texts) and sum(r.n_base for r in got) > 0
    for r in got:
        n, found = plain_places(texts[r.doc_id])
        starts = [k for k, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and r.labels == ",".join(license_scan.scan(texts[r.doc_id]).labels)


def plain_negatives(rows, every, positives=5, negatives=5):
    """Rows (id, label, vector) by the rule, with Python's whole numbers."""
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append((label, [math.floor(256 * float(x)) for x in v]))
    good = {i: min(x) for i, x in good.items()}
    dot = lambda a, b: max(-(2**63) + 2, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, (label, v) in good.items():
        if i % every:
            continue
        ranked = sorted((-dot(v, w), j, other == label) for j, (other, w) in good.items() if j != i)
        for s, j, _ in [x for x in ranked if x[2]][:positives]:
            p = -s
            near = [(k, -t) for t, k, same in ranked if not same and 80 * p <= -100 * t <= 100 * p][:negatives]
            out += [(i, j, rank, k, p, t) for rank, (k, t) in enumerate(near, 1)]
    return sorted(out)


NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, label int, embedding array<float>, id int, v string, s int, cell int, part int"


def vector_rows(kind):
    draw = np.random.default_rng(7)
    if kind == "none":
        return []
    if kind == "odd":
        near = draw.normal(0, 0.01, (40, 5)) + [1, 0.5, 0, 0, 0.25]
        rows = [(i, int(i % 3), [float(np.float32(x)) for x in v]) for i, v in enumerate(near)]
        rows += [(i, i % 3, [0.5, 0.25]) for i in range(50, 70)]  # ties, and shorter vectors
        rows += [(70, 1, None), (71, None, [0.5]), (None, 1, [0.5]), (72, 1, [0.5, None]), (73, 1, [NAN]), (74, 1, [INF, 1.0]), (75, 1, []), (76, 2, [0.0] * 70 + [1.0])]
        rows += [(77, 0, [0.5, 0.25]), (77, 0, [0.5, 0.25]), (77, 1, [9.0]), (80, 0, [-1.0, -1.0]), (90, 0, [1e20, 1.0]), (-10, 0, [1e20, 2.0]), (78, 1, [1e-30, -1e-30])]
        return rows
    return [(i, int(draw.integers(4)), [float(np.float32(x)) for x in draw.normal(0, 0.3, 64)]) for i in range(300)]


@pytest.mark.parametrize("kind", ["drawn", "odd", "none"])
def test_hard_negatives(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = vector_rows(kind)
    df = spark.createDataFrame([(*r, 1, "v", 2, 3, 4) for r in rows], VECTORS)
    got = hard_negatives.mine(hard_negatives.usable(df), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10)
    assert kind == "none" or got.count() > 20


def test_segment_bounds():
    draw = np.random.default_rng(8)
    for width in (64, 128):
        base = draw.normal(0, 1, (30, width // 16)).repeat(16, 1)  # alike inside segments, so that bounds rule pairs out
        v = np.floor(256 * (base + draw.normal(0, 0.05, (30, width))))
        side = hard_negatives.Vectors(np.arange(30), np.zeros(30, np.int64), v, hard_negatives.summary(v))
        exact = hard_negatives.scores(v, v)
        for k in range(0, len(side.s), 2):
            near, far = side.s[k] @ side.s[k].T, side.s[k + 1] @ side.s[k + 1].T
            assert (np.abs(exact - near) <= far * (1 + 1e-9) + 1e-6).all()
        low, high = np.percentile(exact, 90, axis=1), np.percentile(exact, 97, axis=1)
        columns, want = hard_negatives.open_pairs(side, side, low, high, np.ones((30, 30), bool))
        inside = (exact >= low[:, None]) & (exact <= high[:, None])
        full = np.zeros((30, 30), bool)
        full[:, columns] = want
        assert (full | ~inside).all() and full.sum() < 300


def test_hard_negatives_query(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, SF).collect())) == plain_negatives(rows, 100)
