"""Deny names against the plain rule: whole words, any separators, across lines."""

import random
import re

import ahocorasick

from attesta.operators import audit as Q

SEPARATORS = r"[\s._\-/\\]+"


def plain(text, names):
    out = []
    for name in names:
        body = SEPARATORS.join(map(re.escape, re.findall("[0-9A-Za-z]+", name)))
        out += [(text.count("\n", 0, m.start()) + 1, name) for m in re.finditer(rf"(?<![0-9A-Za-z])(?={body}(?![0-9A-Za-z]))", text, re.I)]
    return sorted(out)


def test_names_by_the_plain_rule():
    names, draw = ["Mary-Ann Poe", "Lee", "ann lee"], random.Random(4)
    automaton = ahocorasick.Automaton()
    for k, n in enumerate(names):
        words = " ".join(re.findall("[0-9a-z]+", n.lower()))
        automaton.add_word(f" {words} ", (k, len(words) + 2))
    automaton.make_automaton()
    pieces = ["mary", "Ann", "POE", "lee", "Lee", "ann", "x", "leed", "é"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) + draw.choice([" ", "\n", "_", ".", "-", "/", ", ", "", "\r\n", "(", "\\"]) for _ in range(draw.randint(0, 14)))
        assert sorted((line, names[k]) for line, k in Q.name_hits(text, automaton)) == plain(text, names), repr(text)


def test_names_in_a_table(spark):
    df = spark.createDataFrame([("a", "by\nAnn\nLee and ANN_LEE"), ("b", None), ("c", "Annlee, Ann, Lee"), ("d", "")], "id string, t string")
    got = sorted(map(tuple, Q.deny_hits(df, "id", "t", ["ann lee", ""]).collect()))
    assert got == [("a", 2, "ann lee"), ("a", 3, "ann lee")]
    assert Q.deny_hits(df, "id", "t", []).isEmpty() and Q.deny_hits(df.where("false"), "id", "t", ["lee"]).isEmpty()
