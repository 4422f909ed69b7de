"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, block int, fp long, words int"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
PASSAGE = " ".join(f"p{k}" for k in range(60))
ROWS = [
    (1, "The cat sat on the mat. " * 3, "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", "a", 3),
    (5, LONG, "en", "b", 1),
    (6, LONG, "en", "b", 1),
    (7, f"start here {PASSAGE} and an end", "en", "a", 1),
    (8, f"{PASSAGE} another end", "en", "a", 1),
    (8, f"{PASSAGE} another end", "en", "a", 1),
    (9, "ünï cödé 漢字 😀 x ▁ y", "xx", "c", 1),
    (10, "one two", "en", "a", 2),
    (10, "one two", "en", "a", 2),
    (11, "A" * 5_000, "en", "a", 5_000),
    (12, "no-break\x00zero\x1ccontrol  double  spaces \n\n lines\nlines\nlines", "en", "a", 1),
    (None, "a row without an id " + PASSAGE, "en", "a", 1),
    (-5, "negative ids are ids too", "en", "a", 1),
    (2**40, "huge id", "en", "a", 1),
]


def odd_docs(spark):
    """The odd rows with extra columns named as the operators' own."""
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in ROWS], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
