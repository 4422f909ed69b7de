"""Label, identifier and free-text Column functions (all built-in expressions)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which labels count as healthy or as content words.
HEALTHY_LABELS = (
    "healthy", "normal", "none", "no disease", "not diseased", "non diseased", "nondiseased",
    "control", "unaffected", "healthy control", "normal tissue", "healthy tissue", "n a", "na",
)
HEALTHY_IN_TEXT = ("normal", "healthy", "control", "non-diseased", "nondiseased", "unaffected")
STOP_WORDS = (
    "the", "and", "of", "cell", "cells", "tissue", "tissues", "disease", "diseases", "type", "types",
    "human", "organ", "region", "part", "proper", "left", "right", "upper", "lower", "system", "not",
    "specified", "unspecified", "unstated", "unknown", "other",
)
# Three lists are in use; the first holds "", which as a substring matches every text.
HEALTHY_CALL_WORDS = {
    "scored": ("none", "healthy", "normal", "control", "non-disease", "na", "not applicable",
               "none reported", "unsure", "n/a", ""),
    "ontology": ("none", "healthy", "normal", "control", "non-disease", "na", "not applicable",
                 "unsure", "n/a"),
    "release": ("none", "healthy", "normal", "control", "non-disease", "na", "not applicable",
                "unsure", "n/a", "none reported", "not specified"),
}
SLUG_STOP = ("of", "the", "in", "and", "to")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`, also inside array lambdas."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def any_contained(text: Column, words: Sequence[str]) -> Column:
    """True if any of a fixed word list occurs in `text`; one codegen disjunction."""
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def norm_label(s: Column) -> Column:
    """Lower-case, drop possessives and apostrophes, unify separators, trim, fold healthy synonyms."""
    t = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "['\u2019]s\\b", "")
    t = F.regexp_replace(F.translate(t, "'\u2019", ""), "[-_/]", " ")
    t = F.trim(F.regexp_replace(t, "\\s+", " "))
    t = F.btrim(t, F.lit(" .;,\"*`"))
    # One full-match replacement instead of a lookup, so the chain above is evaluated once.
    return F.regexp_replace(t, "\\A(?:" + "|".join(HEALTHY_LABELS) + ")\\z", "normal")


def norm_simple(s: Column) -> Column:
    """Lower-case and collapse whitespace."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "\\s+", " "))


def contains_either_way(a: Column, b: Column) -> Column:
    """Both non-empty, and one contains the other (inputs already normalised)."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def label_match(a: Column, b: Column) -> Column:
    return contains_either_way(norm_label(a), norm_label(b))


def label_pieces(pred: Column) -> Column:
    """Split a list-like answer into normalised labels of three or more characters."""
    raw = F.split(F.coalesce(pred, F.lit("")), "\\s*(?:,|;|/|\\||\\band\\b)\\s*")
    kept = F.filter(F.transform(raw, norm_label), lambda p: F.length(p) >= 3)
    whole = lambda: F.filter(F.array(norm_label(pred)), lambda p: p != "")
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(whole()))


def any_match(pred: Column, truth: Column) -> Column:
    """Some piece of `pred` matches some label of the `truth` array."""
    both = F.struct(label_pieces(pred).alias("p"), F.transform(truth, norm_label).alias("t"))
    return let(both, lambda s: F.exists(s["p"], lambda p: F.exists(s["t"], lambda t: contains_either_way(p, t))))


def lexical_support(pred: Column, text: Column) -> Column:
    """The text contains the stem of some content word of the asserted label."""
    return let(F.struct(norm_label(pred).alias("l"), F.lower(text).alias("low")), lambda s: _supported(s["l"], s["low"]))


def _supported(label: Column, low: Column) -> Column:
    words = F.filter(F.regexp_extract_all(label, F.lit("([a-z]{4,})")), lambda w: ~w.isin(*STOP_WORDS))
    found = lambda ws: F.exists(
        ws, lambda w: low.contains(w.substr(F.lit(1), F.greatest(F.lit(5), F.length(w) - 2)))
    )
    return F.when(label == "normal", any_contained(low, HEALTHY_IN_TEXT)).otherwise(
        let(words, lambda ws: F.when(F.size(ws) == 0, F.lit(True)).otherwise(found(ws)))
    )


def classify(
    text: Column,
    table: Mapping[str, Sequence[str]],
    override: str | None = None,
    unstated: Sequence[str] = ("unstated", "none", "n/a", "not stated"),
) -> Column:
    """First class, in table order, one of whose words occurs; `override` wins when present."""
    low = F.lower(text)
    expr = F.when(text.isNull() | (text == "") | text.isin(*unstated), F.lit("unstated"))
    if override:
        expr = expr.when(any_contained(low, table[override]), F.lit(override))
    for name, words in table.items():
        expr = expr.when(any_contained(low, words), F.lit(name))
    return expr


def classes_in(text: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """All classes with a word in the text, in table order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(any_contained(low, w), F.lit(n)) for n, w in table.items()]))


def healthy_call(term_id: Column, text: Column, word_list: str = "release") -> Column:
    """No term id, and the text is empty or holds a healthy word."""
    d = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    no_id = term_id.isNull() | (term_id == "")
    return no_id & ((d == "") | any_contained(d, HEALTHY_CALL_WORDS[word_list]))


def slug(name: Column, width: int = 34) -> Column:
    parts = F.split(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), "-")
    kept = F.array_join(F.filter(parts, lambda p: ~p.isin(*SLUG_STOP)), "-")
    return F.btrim(F.substring(kept, 1, width), F.lit("-"))


def strip_id_suffix(symbol: Column) -> Column:
    """'SYM (123)' -> 'SYM'."""
    return F.regexp_replace(symbol, "\\s*\\(\\d+\\)$", "")


def upper_alnum(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")


def with_chr(c: Column) -> Column:
    """Exactly one 'chr' prefix, whatever its case was."""
    return F.concat(F.lit("chr"), F.regexp_replace(F.trim(c), "^(?i:chr)", ""))


def is_autosome(c: Column) -> Column:
    return c.rlike("^chr([1-9]|1[0-9]|2[0-2])$")


def locus(loc: Column) -> Column:
    """struct(chrom, arm, band); all NULL when the text does not parse."""
    pattern = "^(\\d+|X|Y)([pq])([\\d.]*)"
    t = F.trim(loc)
    ok = t.rlike(pattern)
    chrom = F.when(ok, F.regexp_extract(t, pattern, 1))
    arm = F.when(ok, F.concat(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)))
    band = F.when(ok, F.regexp_extract(t, pattern, 3)).try_cast("double")
    return F.struct(chrom.alias("chrom"), arm.alias("arm"), band.alias("band"))


def same_chromosome(a: Column, b: Column) -> Column:
    """Unknown counts as the same, so an unparsable locus never looks distant."""
    return F.coalesce(locus(a)["chrom"] == locus(b)["chrom"], F.lit(True))


def flag_columns(text: Column, features: Mapping[str, Column]) -> list[Column]:
    return [F.coalesce(c, F.lit(False)).alias(n) for n, c in features.items()]


def reasoning_features(text: Column) -> dict[str, Column]:
    """Named boolean features of a curation note (fixed vocabulary)."""
    disclosed = text.contains("biosample_disclosed_disease=true")
    return {
        "disclosed": disclosed,
        "silent": any_contained(text, ("biosample is silent", "biosample_disclosed_disease=false")),
        "from_summary": any_contained(text, ("summary", "title")) & ~disclosed,
        "hedged": any_contained(
            text, ("unsure", "ambiguous", "cannot", "unlikely", "mixed", "possible", "may ", "might")
        ),
    }


# Score-type vocabulary and the direction it implies, in lookup order.
SCORE_TYPE_DIRECTION = {
    "BAGEL": 1, "BF": 1, "BAYES": 1, "L2FC": -1, "LOG2": -1, "MAGeCK": -1, "CERES": -1, "DEMETER": -1,
    "ZLFC": -1, "FOLD": -1, "NEG": -1, "CRISPR": -1, "DEPLETION": -1, "DEPLETED": -1,
}


def criterion_direction(criterion: Column) -> Column:
    """-1 when the text only has '< number', +1 when it only has '> number', else NULL."""
    less, more = criterion.rlike("<\\s*-?\\d"), criterion.rlike(">\\s*-?\\d")
    return F.when(less & ~more, F.lit(-1)).when(more & ~less, F.lit(1))


def vocabulary_direction(types: Column, table: Mapping[str, int]) -> Column:
    """First vocabulary entry (in table order) found in the upper-cased score-type text."""
    up = F.upper(types)
    return F.coalesce(*[F.when(up.contains(k), F.lit(d)) for k, d in table.items()], F.lit(None).cast("int"))


def criterion_score_column(criterion: Column) -> Column:
    k = F.regexp_extract(criterion, "Score\\.(\\d+)", 1)
    return F.concat(F.lit("SCORE."), F.when(k == "", F.lit("1")).otherwise(k))


def canonical_digest(*cols: str) -> Column:
    """'sha256:' + digest of the record's JSON with sorted keys; NULL fields stay explicit."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def canonical_map(m: Column) -> Column:
    """A map with its entries in key order, so equal maps print alike."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def scrub(text: Column, substitutions: Sequence[tuple[str, str]], literals: Mapping[str, str] | None = None) -> Column:
    """Literal replacements, longest first, then regular expressions in the given order."""
    for old in sorted(literals or {}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(old), F.lit(literals[old]))
    for pattern, new in substitutions:
        text = F.regexp_replace(text, pattern, new)
    return text
