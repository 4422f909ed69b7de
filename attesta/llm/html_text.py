"""Main text of web pages: page structure first, and a host-wide suffix array for what structure leaves open.

Structure settles most blocks: elements that are menus, adverts, forms and the like go, and where a page has an
article, its blocks stay. Texts of articles recur on other pages of a host as copies and must stay, so repetition
alone cannot decide there. On pages without an article, blocks covered by long token runs that recur on another
page of the host are boilerplate, and unique runs stay. The token streams of all blocks outside articles form the
host's suffix array. It is cut at the length of a run, since longer common prefixes cover no more: suffixes with the
same leading run are neighbours in it, and a run recurs if its neighbours come from two pages.

Pages of equal text outside articles and dropped parts are copies of one page, whatever their menus say, and recur
nowhere among themselves. A page of which little is its own is a copy with changes: it keeps the blocks that recur on
far fewer pages than its boilerplate does.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.store import kept
from attesta.llm.words import Words, signed, slices

RUN = 8  # tokens of a run
ARTICLE, OPEN, OUTSIDE = 0, 1, 2
TEASER, LEAST_BODY = 3, 600  # open text of so many times the articles' and so many characters is the body
OWN_PART, RARER = 4, 4  # a page of less than a quarter of own text is a copy; its text is on a quarter of the boilerplate's pages at most

# Elements by their part in a page, and words of class, id and role that mark boilerplate.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes annotation annotation-xml".split())
DROPPED = frozenset("head nav header footer aside form menu dialog button select option svg canvas audio video object figure-nav".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend "
    "li main ol p pre search section summary table tbody td tfoot th thead tr ul caption xmp".split()
) | DROPPED
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog alertdialog".split())
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager header footer masthead colophon sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond copyright disclaimer toolbar".split()
)

# Elements that no sign drops, those whose id is an anchor, and words of classes that make "header" the article's own.
WHOLE = frozenset("body html article main".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 section".split())
OWN = frozenset("article post entry story content".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _boilerplate(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role":
            if value.lower() in ROLES:
                return True
        elif key != "aria-hidden" and name not in WHOLE and not (key == "id" and name in TEXT):
            parts = {p.lower() for p in _PART.split(value)}
            if not SIGNS.isdisjoint(parts if OWN.isdisjoint(parts) else parts - {"header"}):
                return True
    return False


def _main(name: str, attributes: str) -> bool:
    return name in ("article", "main") or "role" in attributes and any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in ("main", "article") for m in _ATTRIBUTE.finditer(attributes))


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of the blocks of a page in order, white space folded. Unclosed and stray tags do no harm."""
    page, out, parts = page or "", [], []
    hidden: list[str] = []  # open elements of the name that started a dropped part, innermost last
    inner: list[str] = []  # the same for the article
    at, articles, nested = 0, False, 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((text, OUTSIDE if hidden else ARTICLE if inner else OPEN))

    # Each search begins where the last tag or raw element ended: what looks like a tag in a script reaches no further.
    while m := _TAG.search(page, at):
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if name == "xmp":  # shown as it is written
                parts.append(page[at : end.start() if end else len(page)])
                flush()
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if name in VOID or (m[3] or "").endswith("/"):
            continue
        if hidden:
            if name == hidden[-1]:
                if not closing:
                    hidden.append(name)
                else:
                    flush()
                    hidden.pop()
            elif name in ("article", "main") and inner:  # an article that ends here ends dropped parts left open in it
                nested += -1 if closing else 1
                if nested < 0:
                    flush()
                    hidden.clear()
                    inner.pop()
            continue
        if not closing and _boilerplate(name, m[3] or ""):
            flush()
            hidden.append(name)
            nested = 0
        elif inner and name == inner[-1]:
            flush()
            if closing:
                inner.pop()
            else:
                inner.append(name)
        elif not inner and not closing and _main(name, m[3] or ""):
            flush()
            inner.append(name)
            articles = True
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    flush()
    if not articles:
        return out
    size = [sum(len(t) for t, z in out if z == zone) for zone in (ARTICLE, OPEN)]
    if size[1] > max(TEASER * size[0], LEAST_BODY):  # articles are teasers, and the body stands outside them
        return [(t, OPEN if z == ARTICLE else z) for t, z in out]
    return [(t, OUTSIDE if z == OPEN else z) for t, z in out]


_PARSED = "row long, page_id long, url string, host string, texts array<string>, zones array<int>"


def parsed(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, host, texts, zones) of every row of `pages` (page_id, url, html); `row` tells pages apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [blocks(h) for h in batch.column("html").to_pylist()]
            texts = pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string()))
            zones = pa.array([[z for _, z in x] for x in found], pa.list_(pa.int32()))
            yield pa.record_batch([*(batch.column(c) for c in ("row", "page_id", "url", "host")), texts, zones], ["row", "page_id", "url", "host", "texts", "zones"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    # Equal rows are one page here: a page's own copy must not make it boilerplate.
    return rows.select(
        F.xxhash64("page_id", "url", "html").alias("row"), "page_id", "url", F.coalesce(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html")
    ).mapInArrow(run, _PARSED)


def _suffixes(pages: DataFrame) -> DataFrame:
    """(row, host, key, pos, first, open, body): the leading runs of the token streams outside articles; copies share a body.

    `first` is 1 at a key's first place in the page, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "stream"):
            words = Words(batch.column("stream"))
            at = np.flatnonzero(words.whole(RUN))
            row = words.row[at]
            pick = pa.array(row)
            key = signed(words.sequences(words.hashes(), RUN)[at])
            order = np.lexsort((key, row))
            first = np.zeros(len(at), np.int64)
            first[order] = (np.diff(key[order], prepend=0) != 0) | (np.diff(row[order], prepend=-1) != 0)
            yield pa.record_batch(
                [*(batch.column(c).take(pick) for c in ("row", "host")), pa.array(key), pa.array(words.place[at].astype(np.int32)), pa.array(first), *(batch.column(c).take(pick) for c in ("open", "body"))],
                ["row", "host", "key", "pos", "first", "open", "body"],
            )

    texts = lambda keep: F.array_join(F.transform(F.filter(F.arrays_zip("texts", "zones"), keep), lambda b: b["texts"]), " ")
    streams = pages.select("row", "host", texts(lambda b: b["zones"] != ARTICLE).alias("stream"), texts(lambda b: b["zones"] == OPEN).alias("own"))
    streams = streams.where("stream <> ''").select("row", "host", "stream", (F.col("own") != "").alias("open"), F.xxhash64(F.when(F.col("own") != "", F.col("own")).otherwise(F.col("stream"))).alias("body"))
    return streams.mapInArrow(run, "row long, host string, key long, pos int, first long, open boolean, body long")


def _text(texts: list[str], zones: list[int], runs: list[dict] | None) -> str:
    """The blocks that stay. `runs` are the starts of recurring runs in the stream of blocks outside articles, with their pages."""
    if OPEN not in zones:
        return "\n".join(t for t, z in zip(texts, zones) if z == ARTICLE)
    sizes = [len(t.encode().split()) if z != ARTICLE else 0 for t, z in zip(texts, zones)]
    often = np.zeros(sum(sizes) + RUN, np.int64)  # pages of a token's most frequent run
    starts, counts = (np.array([r[c] for r in runs or []], np.int64) for c in ("pos", "n"))
    for k in range(RUN):
        np.maximum.at(often, starts + k, counts)
    ends = np.cumsum(sizes)
    stay = [z == ARTICLE or z == OPEN and 2 * np.count_nonzero(often[end - n : end]) < max(1, n) for z, n, end in zip(zones, sizes, ends)]
    whole, own = (sum(n for n, z, s in zip(sizes, zones, stay) if z == OPEN and s >= least) for least in (False, True))
    if OWN_PART * own < whole:
        for k, (z, n, end) in enumerate(zip(zones, sizes, ends)):
            if z == OPEN and not stay[k]:
                seen = often[end - n : end]
                stay[k] = bool(RARER * np.median(seen[seen > 0]) <= often.max())
    return "\n".join(t for t, s in zip(texts, stay) if s)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html, any others).

    Null and empty html gives an empty text, as does a page without main text. A null url belongs to the host "". Null ids
    and repeated rows are reported as they come; pages of a host with equal text outside articles and dropped parts count
    as one page. An empty table gives none. A very long page costs time and memory in proportion to its length.
    """
    rows = kept(parsed(pages), "pages")
    runs = _suffixes(rows)
    again = runs.groupBy("host", "key").agg(F.min("body").alias("a"), F.max("body").alias("b"), F.sum("first").alias("n")).where("a < b").select("host", "key", "n")
    found = runs.where("open").join(again, ["host", "key"]).groupBy("row").agg(F.collect_set(F.struct("pos", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_text(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("texts", "zones", "runs")))]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    # Only pages that repetition decides are shuffled to meet their runs.
    undecided = F.exists("zones", lambda z: z == OPEN)
    columns = ["page_id", "url", "texts", "zones", "runs"]
    settled = rows.where(~undecided).withColumn("runs", F.lit(None).cast("array<struct<pos:int,n:long>>")).select(columns)
    joined = settled.unionByName(rows.where(undecided).join(found, "row", "left").select(columns))
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
