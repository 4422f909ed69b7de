"""Each operator against a plain version on whole small tables and on odd rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import ROWS, WORD, no_docs, odd_docs, pairs

from attesta.llm import backoff_lm, components, merge_dropout, pii, queries, simhash, substring_dedup, token_files, weak_quality

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", params=["stored", "odd", "none"])
def docs(request, spark):
    return {"stored": lambda: spark.read.parquet(f"{SF}/documents.parquet"), "odd": lambda: odd_docs(spark), "none": lambda: no_docs(spark)}[request.param]()


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_token_files(docs):
    from tokenizers import Tokenizer

    manifest = token_files.write_tokens(docs, BPE, length=64, rows=4)
    got = [tuple(r)[:4] for r in token_files.read_tokens(manifest).orderBy("start").collect()]
    model, at, want = Tokenizer.from_file(BPE), 0, []
    for i, text in sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    files = {r.file: r.n for r in manifest.groupBy("file").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    for file, n in files.items():
        reader = token_files.SequenceFile(file)
        masks = [reader.sequence(k) for k in range(len(reader))]
        assert all(len(ids) == 64 == len(mask) for ids, mask in masks)
        assert sum(mask.to_numpy(zero_copy_only=False).sum() for _, mask in masks) == n
        assert (np.concatenate([ids for ids, _ in masks])[:n] == reader.tokens(0, n)).all()


def test_token_files_name_their_file_system(spark):
    manifest = token_files.write_tokens(spark.createDataFrame([(1, "text")], "doc_id long, text string"), BPE)
    assert manifest.first().file.startswith("file:///")
    assert token_files._qualified(spark, "/x/y") == "file:///x/y" and token_files._qualified(spark, "file:///x/y") == "file:///x/y"


def test_token_chunks():
    from tokenizers import Tokenizer

    model, mine, draw = Tokenizer.from_file(BPE), token_files.Encoder(BPE), random.Random(1)
    texts = ["".join(draw.choice(" \n\t 　\x1c\x85ab'st1é.,*! ") for _ in range(draw.randint(0, 20))) for _ in range(3000)]
    for text, ids in zip(texts, mine.many(texts)):
        assert np.frombuffer(ids, np.uint16)[:-1].tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_merge_dropout(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = merge_dropout.encode_pieces(docs, PIECES, rate=0.0)
    dropped = merge_dropout.encode_pieces(docs, PIECES, rate=0.3)
    texts = {i: t or "" for i, t in rows_of(docs)}
    for r in plain.collect():
        assert r.lossless and r.n_ids == len(r.ids)
        if "▁" not in texts[r.doc_id]:
            assert r.ids == model.encode(texts[r.doc_id])
    assert pairs(dropped, "doc_id", "ids") == pairs(merge_dropout.encode_pieces(docs.repartition(3), PIECES, rate=0.3), "doc_id", "ids")
    assert dropped.where("not lossless").isEmpty()
    assert pairs(merge_dropout.decode_pieces(dropped, PIECES), "doc_id", "text") == sorted(((i, t or "") for i, t in rows_of(docs)), key=repr)


def test_merge_dropout_agendas():
    s, draw = merge_dropout.Segmenter(PIECES, 0.4), random.Random(2)
    texts = ["".join(draw.choice(" \n\x00ab'st1é.! ▁漢😀therein") for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    s.encode(texts, list(range(2000)))
    # Blocks of chunks with drawn skips agree with the heap.
    known = np.array([k for k, c in enumerate(s.names) if len(c) <= merge_dropout.LONG] * 3)
    skips = np.array([draw.getrandbits(63) & draw.getrandbits(63) for _ in known], np.uint64)
    skips[::3] = 0
    ids, at, count, _ = s._blocks(known, skips)
    forms = {}
    for k, x, a, n in zip(known.tolist(), skips.tolist(), at.tolist(), count.tolist()):
        assert ids[a : a + n].tolist() == s.segment(s.names[k], x)
        forms.setdefault(k, set()).add(tuple(ids[a : a + n].tolist()))
    assert max(map(len, forms.values())) > 1
    for text, ids in zip(texts, s.encode(texts, list(range(2000)))):
        assert s.decode(ids.tolist()) == text
    with pytest.raises(ValueError):
        merge_dropout.Segmenter(PIECES, 1.0)


def test_merge_dropout_draws_for_each_occurrence():
    s = merge_dropout.Segmenter(PIECES, 0.1)
    text = " ".join(["thereinafter"] * 400) + " " + "thereinafter" * 3
    one, two, again = s.encode([text, text, text], [1, 2, 1])
    assert one.tolist() == again.tolist() != two.tolist()
    texts = [s.encode([text], [k])[0].tolist() for k in range(20)]
    assert len(set(map(tuple, texts))) == 20 and all(s.decode(ids) == text for ids in texts)
    forms = {tuple(s.encode(["thereinafter"], [k])[0].tolist()) for k in range(400)}
    assert len(forms) > 4
    # The blocks and the heap agree on the draws of an occurrence.
    for name in range(200):
        key = merge_dropout.mix(np.array([merge_dropout.xxhash.xxh64_intdigest(str(name), s.seed)], np.uint64))[0]
        assert s.encode(["thereinafter"], [name])[0].tolist() == s.segment(" thereinafter", 0, int(key))


def test_substring_dedup(docs):
    first, want = {}, []
    for i, text in sorted(set(rows_of(docs)), key=lambda r: (r[0] is None, r[0] or 0)):
        words = WORD.findall(text or "")
        gone = [False] * (len(words) + 20)
        for k in range(len(words) - 19 if i is not None else 0):
            if first.setdefault(tuple(words[k : k + 20]), (i, k)) != (i, k):
                gone[k : k + 20] = [True] * 20
        left = [w for w, g in zip(words, gone) if not g]
        want += [(i, len(words), len(words) - len(left), " ".join(left))] * rows_of(docs).count((i, text))
    got = pairs(substring_dedup.deduplicated(docs), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(want, key=repr)


def test_difference_cover():
    d, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % d for a in cover for b in cover} == set(range(d))


def test_pii(docs):
    def base(text):
        out = []
        for kind, pattern in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ):
            for m in re.finditer(pattern, text):
                digits = re.sub(r"\D", "", m[0])
                ok = {
                    "email": True, "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])), "phone": 9 <= len(digits) <= 15,
                    "card": 13 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(digits[::-1])) % 10 == 0,
                }[kind]
                if ok:
                    out.append((kind, *m.span()))
        return out

    texts = dict(rows_of(docs))
    for r in pii.personal_spans(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == base(texts[r.doc_id] or "")
    assert pii.personal_spans(docs).count() == docs.count() and pii.redact(docs).columns == docs.columns
    draw = random.Random(3)
    for letters in ("a1@.- +", "0123456789 -+.()@a", "4111 -"):
        for _ in range(5000):
            text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
            assert pii.find(text) == base(text), text


@pytest.mark.parametrize("text, span, clear", [
    ("write john dot doe at example dot com now", "john dot doe at example dot com", "write [EMAIL] now"),
    ("john (at) example [dot] org", "john (at) example [dot] org", "[EMAIL]"),
    ("to jоhn@exаmple.com, please", "jоhn@exаmple.com", "to [EMAIL], please"),
    ("call plus one four one five five five five two six seven one ok", "plus one four one five five five five two six seven one", "call [PHONE] ok"),
    ("ｃａｌｌ ＋１ ４１５ ５５５ ２６７１", "＋１ ４１５ ５５５ ２６７１", "ｃａｌｌ [PHONE]"),
    ("four one one one one one one one one one one one one one one one", None, "[CARD]"),
    ("at one nine two dot one six eight dot zero dot one", "one nine two dot one six eight dot zero dot one", "at [IP]"),
    ("ask jane.roe at host.com today", "jane.roe at host.com", "ask [EMAIL] today"),
])
def test_disguises(text, span, clear):
    found = pii.spans(text)
    assert len(found) == 1 and not found[0][3]
    assert text[found[0][1] : found[0][2]] == (span or text) and pii.redacted(text, found) == clear


@pytest.mark.parametrize("text", ["jоhn@example.com", "john\u200b.doe@example.com", "jоhn@exаmple.com"])
def test_wider_disguises_leave_nothing(text):
    found = pii.spans(f"to {text}, please")
    assert pii.redacted(f"to {text}, please", found) == "to [EMAIL], please"
    assert [x for x in found if x[3]] == [(*x, True) for x in pii.find(f"to {text}, please")]
    assert ("email", 3, 3 + len(text), False) in found


def test_pii_query(spark):
    """The registered query: counts, digest and list of spans from what `spans` finds."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_pii(spark, SF).collect()}
    assert got.keys() == texts.keys() and sum(r.n_email for r in got.values()) > 0
    for i, text in texts.items():
        found, plain = pii.spans(text), pii.find(text or "")
        listed = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in x)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in plain) for k in pii.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(listed(plain).encode()).hexdigest() and got[i].spans == listed(found)


def test_no_disguise():
    assert pii.spans("look at example.com or visit us at shop.example.org, we are at home.Then") == []
    assert pii.spans("He sat at the table. One two three, at dot com. Look at me dot") == []


def test_backoff_lm(docs, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 1 << 16)
    rows = [(i, [*WORD.findall(lower(t or "")), "</s>"]) for i, t in rows_of(docs)]
    for order in (2, 3):
        counts, before = Counter(), Counter()
        for i, tokens in rows:
            if not backoff_lm.held_out(i):
                padded = ["<s>"] * (order - 1) + tokens
                for k in range(1, order + 1):
                    for at in range(order - 1, len(padded)):
                        gram = tuple(padded[at - k + 1 : at + 1])
                        counts[gram] += 1
                        before[gram[:-1]] += 1
        n, kinds, want = before[()], sum(len(g) == 1 for g in counts), []
        for i, tokens in rows:
            padded, base, score = ["<s>"] * (order - 1) + tokens, 0.0, 0.0
            for at in range(order - 1, len(padded)):
                p = (counts[(padded[at],)] + 1) / (n + kinds + 1)
                base += math.log10(p)
                for k in range(2, order + 1):
                    gram = tuple(padded[at - k + 1 : at + 1])
                    p = (counts[gram] + 10 * p) / (before[gram[:-1]] + 10)
                score += math.log10(p)
            want.append((i, backoff_lm.held_out(i), len(tokens), sum(counts[(t,)] > 0 for t in tokens), n, round(base, 6), round(score, 6)))
        got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in pairs(backoff_lm.score(docs, order), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")]
        key = lambda r: (r[0] is None, r[:5], r[5])
        for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)


def test_backoff_lm_adds_up(spark):
    texts = [(1, "a b a"), (3, "b a"), (4, "a c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = ["a", "b", "c", "other"]
    asks = spark.createDataFrame([(10 + k, w) for k, w in enumerate(words)], "doc_id long, text string")
    got = backoff_lm.score(docs.union(asks), hold=lambda i: i >= 10).where("doc_id >= 10").collect()
    # P(w | start) over all words and the end; the score of a one-word text also has P(end | w).
    total = Counter({"a": 4, "b": 2, "c": 1, "</s>": 3})
    p = lambda w: (total[w] + 1) / (10 + 4 + 1)
    end = {"a": (1 + 0 + 10 * p("</s>") + 1) / (4 + 10), "b": 10 * p("</s>") / 12, "c": (1 + 10 * p("</s>")) / 11, "other": p("</s>")}
    first = {w: 10 ** r.score / end[w] for w, r in zip(words, sorted(got))}
    assert sum(first.values()) + 10 * p("</s>") / 13 == pytest.approx(1)


def test_weak_quality(docs):
    want = []
    for i, text in rows_of(docs):
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        covered = len({k + j for k, g in enumerate(grams) if g in twice for j in range(5)})
        failed = len(words) < 10 or 100 * covered > 20 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), covered, failed))
    out = weak_quality.quality(docs)
    assert pairs(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert out.where("kept and (base_failed or posterior < 0.5)").isEmpty()
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_em_finds_accuracies(spark):
    draw, rows = random.Random(5), []
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.9]
    for _ in range(4000):
        good = draw.random() < 0.7
        rows.append((good, *(0 if draw.random() < 0.2 else (1 if good else -1) * (1 if draw.random() < a else -1) for a in right)))
    names = [f"vote_{r}" for r in weak_quality.RULES]
    voted = spark.createDataFrame(rows, "good boolean, " + ", ".join(f"{n} int" for n in names))
    model = weak_quality.fit(voted, close=1e-4)
    assert model.prior == pytest.approx(0.7, abs=0.04)
    assert max(abs(a - b) for a, b in zip(model.good, right)) < 0.05 and max(abs(a - b) for a, b in zip(model.bad, right)) < 0.06
    assert voted.where((model.posterior() >= 0.5) == voted.good).count() > 0.97 * len(rows)


def test_simhash(docs):
    rows = rows_of(docs)
    fps = []
    for _, text in rows:
        words = WORD.findall(lower(text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        import xxhash

        found = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found)))
    codes = np.array(fps, np.uint64)
    least = [min([i for (i, _), f in zip(rows, fps) if f == g and i is not None], default=None) for g in fps]
    group = list(range(len(rows)))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3 if rows else np.zeros((0, 0), bool)
    moved = True
    while moved:
        new = [min(group[j] for j in np.flatnonzero(near[k])) for k in group[:0] or range(len(rows))]
        moved, group = new != group, new
    best = {g: min([v for v, h in zip(least, group) if h == g and v is not None], default=None) for g in set(group)}
    want = [(i, f"{f:016x}", best[g]) for (i, _), f, g in zip(rows, fps, group)]
    assert pairs(simhash.near_copies(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    left = simhash.one_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted({v for v in best.values() if v is not None})


def test_golay():
    draw = np.random.default_rng(4)
    words = draw.integers(0, 1 << 22, 3000)
    assert (np.unique(simhash.codeword(np.arange(1 << 23)), return_counts=True)[1] == 2048).all()
    fp = draw.integers(0, 1 << 63, 2000, dtype=np.uint64)
    other = fp.copy()
    for _ in range(3):
        other ^= np.uint64(1) << draw.integers(0, 64, 2000).astype(np.uint64)
    row, key, index = simhash.fuzzy_keys(fp)
    theirs, their_key, their_index = simhash.fuzzy_keys(other)
    own = {(r, k) for r, k, i in zip(row.tolist(), key.tolist(), index.tolist()) if i}
    assert len({r for r, k, i in zip(theirs.tolist(), their_key.tolist(), their_index.tolist()) if not i and (r, k) in own}) == len(fp)
    assert len(words) == 3000


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000 + k, 999) for k in range(50)] + [(7, 7), (7, 8), (8, 7)]
    got = dict(pairs(components.connected(spark.createDataFrame(chain, "a long, b long")), "node", "root"))
    assert got == {k: 0 for k in range(1, 201)} | {1000 + k: 999 for k in range(50)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_of_kept_text():
    assert substring_dedup.digest("") == hashlib.sha256(b"").hexdigest() and html.unescape("&amp;") == "&" and ROWS
