"""Personal data in texts, also where it is disguised, with spans in the source text.

Two transducers rewrite a text and keep for every character they write the source span it stands for: one maps
look-alike letters and drops invisible ones, the other turns written-out digits, "at" and "dot" into signs.
Identifiers found in the result are mapped back to the source. Those found in the source itself stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones, invisible characters, written digits.
LOOKALIKES = dict(zip(
    "АВЕКМНОРСТУХІЈЅаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ",
    "ABEKMHOPCTYXIJSaeopcyxijshdqwABEZHIKMNOPTYXoavp",
)) | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {"﹫": "@", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " "}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[" + re.escape("".join(LOOKALIKES) + INVISIBLE) + "]")
_BRACKETS = (
    (re.compile(r"\s{0,3}[(\[{<]\s{0,3}(?:at|@)\s{0,3}[)\]}>]\s{0,3}", re.I), "@"),
    (re.compile(r"\s{0,3}[(\[{<]\s{0,3}(?:dot|\.)\s{0,3}[)\]}>]\s{0,3}", re.I), "."),
)
_SPOKEN = re.compile(r"(?<=[A-Za-z0-9]) (?:at|AT) (?=[A-Za-z0-9-]+(?: (?:dot|DOT) [A-Za-z0-9-]+)+)|(?<=[A-Za-z0-9]) (?:dot|DOT) (?=[A-Za-z0-9])")
# Ends of host names that a spoken "at" may stand before, and words that point at a place, not a person.
_ENDS = "com|org|net|edu|gov|info|biz|io|co|me|eu|uk|de|fr|es|it|nl|ch|at|se|no|pl|ru|cn|jp|in|br|au|ca|us"
_POINTING = frozenset("look looking us me up him her them it available found hosted here live is are was be see stay shop order more online and or".split())
_AT_HOST = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)( (?:at|AT) )(?=(?:[A-Za-z0-9-]+\.)+(?:{_ENDS})(?![A-Za-z0-9-]))")
_ITEM = rf"(?:{'|'.join(DIGIT_WORDS)}|plus|dot|point|[0-9]+)"
_DIGITS = re.compile(rf"(?<![A-Za-z0-9])(?:{_ITEM}[ ,-]{{1,2}}){{3,}}{_ITEM}(?![A-Za-z0-9])", re.I)
_ITEMS = re.compile(_ITEM, re.I)


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the plain patterns find, by kind, then start. Kinds don't exclude each other."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


class Rewritten:
    """A text after edits, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by the characters given; edits must be in order and must not overlap."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:a], new]
            start += [*self.start[at:a], *[self.start[a]] * len(new)] if new else self.start[at:a]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)] if new else self.end[at:a]
            at = b
        self.text, self.start, self.end = "".join(text), start, end


def _digits(run: re.Match) -> str | None:
    items = [x.lower() for x in _ITEMS.findall(run[0])]
    if not any(x in DIGIT_WORDS for x in items):
        return None
    return "".join(DIGIT_WORDS.get(x) or {"plus": "+", "dot": ".", "point": "."}.get(x, x) for x in items)


def normalise(text: str) -> Rewritten:
    """The text with its disguises undone."""
    out = Rewritten(text)
    if not text.isascii():
        out.edit([(m.start(), m.end(), LOOKALIKES.get(m[0], "")) for m in _ODD.finditer(text)])
    out.edit([(*m.span(), new) for m in _DIGITS.finditer(out.text) if (new := _digits(m))])
    for pattern, sign in _BRACKETS:
        out.edit([(*m.span(), sign) for m in pattern.finditer(out.text)])
    if " dot " in out.text or " DOT " in out.text:
        out.edit([(*m.span(), "@" if m[0].strip().lower() == "at" else ".") for m in _SPOKEN.finditer(out.text)])
    if " at " in out.text or " AT " in out.text:
        out.edit([(*m.span(2), "@") for m in _AT_HOST.finditer(out.text) if m[1].lower() not in _POINTING])
    return out


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) by kind, then start. A disguised span inside a plain one of its kind gives way; a wider one is added."""
    text = text or ""
    base = find(text)
    out = [(*x, True) for x in base]
    clear = normalise(text)
    if clear.text != text:
        taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
        for kind, s, e in find(clear.text):
            start, end = clear.start[s], clear.end[e - 1]
            if not any(a <= start and end <= b for a, b in taken[kind]):
                out.append((kind, start, end, False))
        out.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return out


def redacted(text: str | None, found: list[tuple[str, int, int, bool]]) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that touch each other go as one."""
    if not found:
        return text
    merged: list[list] = []
    for kind, start, end, _ in sorted(found, key=lambda x: (x[1], -x[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    cuts = [0, *(x for _, s, e in merged for x in (s, e)), len(text)]
    plain = [text[a:b] for a, b in list(pairwise(cuts))[::2]]
    return plain[0] + "".join(f"[{k.upper()}]{rest}" for (k, _, _), rest in zip(merged, plain[1:]))


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of `docs` (doc_id, text, any others); offsets are code points, ends exclusive.

    Null and empty texts have no spans. Each row is judged by itself, so null ids and repeated rows change nothing.
    A very long text costs time in proportion to its length and a few numbers a character while it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans(t)] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def listed(found: str | Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with personal data in `column` replaced; all other columns and rows stay as they are.

    A null text stays null, an empty one empty; repeated rows are treated alike and an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            new = pa.array([redacted(t, spans(t)) for t in batch.column(column).to_pylist()], pa.string())
            yield batch.set_column(batch.schema.get_field_index(column), column, new)

    return docs.mapInArrow(run, docs.schema)
