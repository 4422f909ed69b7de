"""Licences that a text states: notice phrases and identifier tags, and the expressions they form.

One Aho-Corasick pass over a text's words finds notice phrases and `SPDX-License-Identifier` tags. The expression
after a tag, and phrases that stand near each other with "and", "or" or "with" between them, are put into postfix
order by a shunting yard and evaluated: a choice takes the freer side, a conjunction the stricter one, and an
exception loosens the licence that it belongs to.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.words import slices

# Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Further notice phrases in words of lower case, and their labels.
NOTICES = {
    "mit license": "mit",
    "the mit licence": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license 2 0": "apache-2",
    "apache 2 0 license": "apache-2",
    "apache license": "apache-2",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "isc license": "isc",
    "boost software license": "bsl-1",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu gpl": "gpl",
    "gpl version 2": "gpl-2",
    "gpl version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license 2": "mpl-2",
    "eclipse public license": "epl",
    "classpath exception": "classpath-exception",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creativecommons org licenses by": "cc-by",
    "creativecommons org licenses by sa": "cc-by-sa",
    "creativecommons org licenses by nc": "cc-by-nc",
    "creativecommons org licenses by nc sa": "cc-by-nc-sa",
    "creativecommons org licenses by nd": "cc-by-nd",
    "creativecommons org licenses by nc nd": "cc-by-nc-nd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc0 1 0": "cc0",
    "creativecommons org publicdomain zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
EXCEPTIONS = frozenset(("classpath-exception",))  # state nothing by themselves

# How freely a text under a licence may be used, by the beginning of its label; the first that fits counts.
FREEDOM = (
    ("cc-by-nc", 0.2), ("cc-by-nd", 0.2), ("cc-by-sa", 0.4), ("agpl", 0.3), ("gpl", 0.4), ("lgpl", 0.6), ("mpl", 0.6), ("epl", 0.6), ("proprietary", 0.0),
    ("mit", 1.0), ("apache", 1.0), ("bsd", 1.0), ("isc", 1.0), ("bsl", 1.0), ("cc-by", 0.9), ("cc0", 1.0), ("public-domain", 1.0), ("unlicense", 1.0), ("zlib", 1.0),
)
UNKNOWN, LOOSENED = 0.5, 0.6

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
# Words that may stand between two licences of one statement.
FILLERS = frozenset("a an and at both either is license licence licensed of option or the terms under version with your 0 1 2 3 4".split())
GAP = 8

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = r"0-9A-Za-z\x80-\U0010FFFF"
_TAG = re.compile(rf"(?<![{_WORD}])spdx[^{_WORD}]+license[^{_WORD}]+identifier(?![{_WORD}])", re.I)
_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+-]*))")


class Hit(NamedTuple):
    start: int  # in words
    end: int
    label: str
    kind: str


class Value(NamedTuple):
    """What an expression comes to: its freedom, the licences of the side chosen, and all that it names."""

    freedom: float
    chosen: frozenset
    named: frozenset


def words(text: str) -> str:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, one space around each."""
    found = text.encode().translate(_FOLD).split()
    return f" {b' '.join(found).decode()} " if found else ""


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def hits(stream: str) -> list[Hit]:
    """Every place of every phrase, overlapping ones included, by its end."""
    out, at, word = [], 0, 0
    for last, phrase in _automaton().iter(stream):
        word += stream.count(" ", at, last)
        at = last
        n = phrase.count(" ") + 1
        # `word` counts the spaces before the closing one, so it is the number of words up to the phrase's end.
        kind = "base" if phrase in BASE else "tag" if phrase == TAG else "notice"
        out.append(Hit(word - n, word, BASE.get(phrase) or NOTICES.get(phrase) or "", kind))
    return out


def longest(found: Sequence[Hit]) -> list[Hit]:
    """Hits without those inside or across a longer one that begins no later."""
    out: list[Hit] = []
    for hit in sorted(found, key=lambda h: (h.start, -h.end)):
        if not out or hit.start >= out[-1].end:
            out.append(hit)
        elif hit.end > out[-1].end:
            # "under the mit license version ..." style overlaps: the one with more words stays.
            if hit.end - hit.start > out[-1].end - out[-1].start:
                out[-1] = hit
    return out


def label(identifier: str) -> str:
    """A licence identifier in the form of the labels: lower case, without `-only` and a trailing `.0`; Creative
    Commons licences without their version."""
    name = identifier.lower().rstrip(".")
    later = name.endswith(("+", "-or-later"))
    name = re.sub(r"(-only|-or-later|\+)$", "", name)
    if name.startswith("cc"):
        return re.sub(r"-[0-9.]+$", "", name)
    return re.sub(r"(\.0)+$", "", name) + ("-or-later" if later else "")


def postfix(tokens: Sequence[str]) -> list[str]:
    """Licences and operators in postfix order, by a shunting yard over the longest beginning of `tokens` that is a
    whole expression. Operators are and, or, with; anything else but parentheses is a licence."""
    whole, depth, operand = 0, 0, True
    for k, token in enumerate(tokens, 1):
        if token == "(" and operand:
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
        elif token in PRECEDENCE and not operand:
            operand = True
        elif token not in PRECEDENCE and token not in "()" and operand:
            operand = False
        else:
            break
        if not operand and not depth:
            whole = k
    out: list[str] = []
    held: list[str] = []
    for token in tokens[:whole]:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    return out + held[::-1]


def freedom(name: str) -> float:
    return next((f for start, f in FREEDOM if name.startswith(start)), UNKNOWN)


def evaluate(order: Sequence[str]) -> Value | None:
    """The value of an expression in postfix order; None for an empty one. Equal sides of a choice: the first."""
    stack: list[Value] = []
    for token in order:
        if token not in PRECEDENCE:
            stack.append(Value(freedom(token), frozenset((token,)), frozenset((token,))))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            best = left if left.freedom >= right.freedom else right
            stack.append(Value(best.freedom, best.chosen, left.named | right.named))
        elif token == "and":
            stack.append(Value(min(left.freedom, right.freedom), left.chosen | right.chosen, left.named | right.named))
        else:
            name = "+".join(sorted(left.chosen)) + "-with-" + "+".join(sorted(right.chosen))
            stack.append(Value(max(left.freedom, LOOSENED), frozenset((name,)), frozenset((name,))))
    return stack[0] if stack else None


def tagged(text: str) -> Iterator[tuple[list[str], int]]:
    """The tokens on the line after each identifier tag, and how many words they take."""
    for tag in _TAG.finditer(text):
        at = tag.end()
        while at < len(text) and text[at] in " \t:='\"":
            at += 1
        tokens = []
        while m := _TOKEN.match(text, at):
            word = m[2]
            tokens.append(m[1] or (word.lower() if word.lower() in PRECEDENCE else label(word)))
            at = m.end()
        yield tokens, max(0, words(text[tag.end() : at]).count(" ") - 1)


def statements(stream: str, found: Sequence[Hit]) -> Iterator[list[str]]:
    """Tokens of each statement: notice hits, chained where few words with an operator stand between them.

    The gap words are cut out of the stream between the ends of hits, so nothing else of it is looked at twice.
    """
    tokens: list[str] = []
    last, at, word = 0, 0, 0
    for hit in found:
        gap: list[str] = []
        near = tokens and hit.start - last <= GAP
        if near:
            while word < last:
                at, word = stream.index(" ", at + 1), word + 1
            gap = stream[at:].split(" ", hit.start - last + 1)[1 : hit.start - last + 1] if hit.start > last else []
        signs = [w for w in gap if w in PRECEDENCE]
        if near and signs and all(w in FILLERS for w in gap):
            tokens += ["or" if "or" in signs else signs[0], hit.label]
        else:
            if tokens:
                yield tokens
            tokens = [hit.label]
        last = hit.end
    if tokens:
        yield tokens


class Found(NamedTuple):
    n_words: int
    places: list[int]  # first words of base phrases
    base: list[str]
    labels: list[str]
    expressions: list[str]  # in postfix order
    score: float


def scan(text: str | None) -> Found:
    """All that one text states. The score is the freedom of the strictest statement; 0 if there is none."""
    stream = words(text or "")
    found = hits(stream)
    base = [h for h in found if h.kind == "base"]
    tags = [h for h in found if h.kind == "tag"]
    lines = list(zip(tags, tagged(text or ""))) if tags else []
    # What stands in a tag's expression is read as that alone.
    begins, ends = [t.end for t in tags], [t.end + n for t, (_, n) in lines]
    read = lambda h: (k := bisect_right(begins, h.start)) and h.start < ends[k - 1]
    notices = [h for h in found if h.kind != "tag" and not read(h)]
    stated = [postfix(t) for t in statements(stream, longest(notices)) if not EXCEPTIONS.issuperset(t)]
    stated += [p for _, (t, _) in lines if (p := postfix(t))]
    values = [v for p in stated if (v := evaluate(p))]
    labels = {h.label for h in base}.union(*(v.named for v in values))
    return Found(
        max(0, stream.count(" ") - 1), sorted(h.start for h in base), sorted({h.label for h in base}), sorted(labels),
        [" ".join(p) for p in stated], min((v.freedom for v in values), default=0.0),
    )


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, base_labels, labels, expressions, score) of every row of `docs` (doc_id, text, any others).

    `places` are the first words (from 0) of the base phrases, `labels` all licences found, `expressions` the
    statements in postfix order. Null texts count as empty; an empty text has no labels and score 0. Repeated rows and
    rows without an id are judged each by itself; an empty table gives an empty result. A very long text costs time in
    proportion to its length and a few times its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, *rest = zip(*map(scan, batch.column("text").to_pylist()))
            kinds = (pa.list_(pa.int64()), *[pa.list_(pa.string())] * 3, pa.float64())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), *map(pa.array, rest, kinds)]
            yield pa.record_batch(columns, ["doc_id", "n_words", "places", "base_labels", "labels", "expressions", "score"])

    lists = "base_labels array<string>, labels array<string>, expressions array<string>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id long, n_words long, places array<long>, {lists}, score double"
    )


def joined(column: str) -> Column:
    return F.array_join(column, ",")
