"""Contract, manifest, journal, ledger and text-hygiene checks that report violations as rows."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.joins import Refused
from attesta.operators.ordered import Ordered, lagged, quantiles
from attesta.session import stage


def violations(df: DataFrame, row_id: Sequence[str], rules: Mapping[str, Column], unique: Sequence[str] | None = None) -> DataFrame:
    """(row_id..., rule) for every broken rule; a NULL rule result counts as broken.

    All row rules are checked in one pass. Uniqueness is a grouped count, so a key repeated
    millions of times folds map-side.
    """
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull()
    )
    out = df.select(*row_id, F.explode(broken).alias("rule"))
    if unique:
        dup = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*unique)
        repeated = df.select(*{*row_id, *unique}).join(dup, list(unique), "left_semi").select(*row_id, F.lit("unique").alias("rule"))
        out = out.unionByName(repeated)
    return out


def refuse_if_any(violation_rows: DataFrame) -> None:
    first = violation_rows.limit(1).collect()
    if first:
        raise Refused(f"contract broken: {first[0].asDict()}")


def direction_sane(df: DataFrame, value: str, lower: Column, higher: Column, gap: float, by: Sequence[str] = ()) -> DataFrame:
    """median(lower group) + gap < median(higher group)."""
    side = df.select(*by, value, F.when(lower, "lo").when(higher, "hi").alias("__side")).where("__side IS NOT NULL")
    med = quantiles(side, [*by, "__side"], value, {"m": 0.5})
    g = med.groupBy(*by).agg(
        F.max(F.when(F.col("__side") == "lo", F.col("m"))).alias("median_lower"), F.max(F.when(F.col("__side") == "hi", F.col("m"))).alias("median_higher")
    )
    return g.withColumn("sane", F.col("median_lower") + gap < F.col("median_higher"))


def content_checks(df: DataFrame, row_id: str, content: Column, first_line: str, required: Sequence[str], min_bytes: int) -> DataFrame:
    """Names of the checks a downloaded text passes, with its size and digest."""
    head = F.lower(F.ltrim(content))
    line = F.split_part(content, F.lit("\n"), F.lit(1))
    checks = {
        "not_empty": F.length(content) > 0,
        "not_html": ~(head.startswith("<!doctype html") | head.startswith("<html")),
        "not_json_error": ~(head.startswith("{") & head.contains('"error"')),
        "first_line": line.rlike(first_line),
        "required": _all([content.contains(r) for r in required]),
        "min_bytes": F.octet_length(content) >= min_bytes,
    }
    passed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return df.select(row_id, passed.alias("passed"), F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def _all(conds: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def file_manifest(spark, folder: str) -> DataFrame:
    """(path, sha256, bytes) of every file below a folder; hashing runs on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """ok / changed / missing / added per path."""
    e = expected.select("path", F.col("sha256").alias("want"))
    a = actual.select("path", F.col("sha256").alias("have"))
    status = (
        F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "added").when(F.col("want") != F.col("have"), "changed").otherwise("ok")
    )
    return e.join(a, "path", "full").select("path", status.alias("status"))


def bucketed_digest(manifest: DataFrame, buckets: int = 4096) -> DataFrame:
    """Order-free digest of a manifest of any size: digest per path-hash bucket, then digest of those.

    A bucket holds about 1/buckets of the paths, so no list of all paths is ever built. Buckets come from MD5,
    so any engine can check the digest.
    """
    line = F.concat_ws("\t", "path", "sha256")
    bucket = F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long") % buckets
    b = manifest.groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    return b.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), "\n"), 256).alias("digest"))


def top_digest(manifest: DataFrame) -> DataFrame:
    """Digest over the sorted 'path NUL sha256' lines of a release manifest.

    The digest is defined on one sequence of lines, so one task takes them in order; it holds one batch of
    lines at a time and its sort can spill. `bucketed_digest` is the form that many tasks can share.
    """

    def run(batches):
        digest, files = hashlib.sha256(), 0
        for batch in batches:
            for line in batch.column("line").to_pylist():
                digest.update((b"\n" if files else b"") + line.encode())
                files += 1
        yield pa.record_batch([pa.array([digest.hexdigest()]), pa.array([files], pa.int64())], ["digest", "files"])

    lines = manifest.select(F.concat(F.col("path"), F.lit("\x00"), F.col("sha256")).alias("line"))
    return lines.repartition(1).sortWithinPartitions("line").mapInArrow(run, "digest string, files long")


def chain_violations(events: DataFrame, key: str, seq: str, prev: str, digest: str, at: str, recomputed: Column) -> DataFrame:
    """Broken links of hash-chained journals: wrong digest, gap, wrong previous hash, time going back.

    The previous event is found by an equi-join on (journal, sequence - 1), so one enormous
    journal spreads over all tasks.
    """
    e = events.withColumn("__ok", recomputed == F.col(digest))
    p = events.select(key, (F.col(seq) + 1).alias(seq), F.col(digest).alias("__ph"), F.col(at).alias("__pt"))
    j = e.join(p, [key, seq], "left")
    first = F.col(seq) == 1
    rules = {
        "digest": F.col("__ok"),
        "sequence": first | F.col("__ph").isNotNull(),
        "previous": F.when(first, F.col(prev).isNull()).otherwise(F.col(prev) == F.col("__ph")),
        "time": F.col("__pt").isNull() | (F.col(at) >= F.col("__pt")),
    }
    return violations(j, [key, seq], rules)


def transition_violations(events: DataFrame, key: str, seq: str, state: str, allowed: Sequence[tuple[str | None, str]]) -> DataFrame:
    """Events whose (previous state, state) is not an allowed transition; None is the start."""
    p = events.select(key, (F.col(seq) + 1).alias(seq), F.col(state).alias("prev_state"))
    j = events.select(key, seq, state).join(p, [key, seq], "left")
    arrow = F.concat_ws(">", F.coalesce("prev_state", F.lit("")), F.col(state))
    return j.where(~arrow.isin(*[f"{a or ''}>{b}" for a, b in allowed]))


def budget_trail(events: DataFrame, key: str, order: Sequence[str], spend: Column, reserve: Column, ceiling: int) -> DataFrame:
    """Running spent and reserved amounts per run in integer micros, and where the ceiling is passed."""
    run = Ordered(events, [key], list(order)).running({"spent": ("sum", spend), "reserved": ("sum", reserve)}).rows()
    return run.withColumn("breach", F.col("spent") + F.col("reserved") > ceiling)


# The state in which an event leaves its task, and the states in which it may find it.
TASK_STATES = {"proposed": "proposed", "revised": "proposed", "retried": "proposed", "rejected": "rejected", "admitted": "reserved", "dispatch": "submitting", "observed": "submitted", "uncertain": "uncertain"}
TASK_ENDS = ("completed", "failed", "cancelled")
_ACTIVE = ("reserved", "submitting", "submitted", "uncertain")
TASK_BEFORE = {
    "proposed": (), "revised": ("proposed", "rejected"), "retried": ("failed", "cancelled"), "rejected": ("proposed",), "admitted": ("proposed",),
    "dispatch": _ACTIVE, "observed": _ACTIVE, "uncertain": _ACTIVE, "settled": _ACTIVE,
}
UNRESOLVED = ("uncertain", "submitting")


def budget_audit(
    events: DataFrame, run: str, seq: str, task: str, kind: str, estimate: str, actual: str, final: str, breached: str, budget: int
) -> tuple[DataFrame, DataFrame]:
    """((run, seq, rule) of every event that breaks a rule, final totals by run) of task journals, in integer amounts.

    A task goes from proposal over admission to settlement; an admission needs its estimate free in the budget, no
    breach before it and no task in doubt; a settlement names a final state and says rightly whether it exceeds its
    estimate or the budget. Every event counts as it stands, also after one that breaks a rule. Totals satisfy
    budget = spent + reserved + remaining. All state is carried by ordered scans that deal a long run over tasks.
    """
    status = F.when(F.col(kind) == "settled", F.col(final))
    for k, v in TASK_STATES.items():
        status = status.when(F.col(kind) == k, v)
    e = events.select(run, seq, task, kind, *[F.col(c).cast("bigint").alias(c) for c in (estimate, actual)], final, breached, status.alias("__status"))
    offered = F.when(F.col(kind).isin("proposed", "revised"), F.struct(F.col(seq), F.col(estimate).alias("v")))
    e = Ordered(lagged(e, [run, task], [seq], ["__status"]), [run, task], [seq]).running({"__offer": ("max", offered)}).rows()
    est, prev = F.coalesce(F.col("__offer.v"), F.lit(0)), F.col("prev___status")
    number = lambda c: c.cast("bigint")
    doubt = lambda c: number(F.coalesce(c.isin(*UNRESOLVED), F.lit(False)))
    active = F.coalesce(prev.isin(*_ACTIVE), F.lit(False))
    settled = F.col(kind) == "settled"
    e = e.withColumns({
        "__est": est, "__spent": F.when(settled, F.coalesce(F.col(actual), F.lit(0))).otherwise(F.lit(0).cast("bigint")),
        "__held": F.when((F.col(kind) == "admitted") & (prev == "proposed"), est).when(settled & active, -est).otherwise(F.lit(0).cast("bigint")),
        "__doubt": doubt(F.col("__status")) - doubt(prev),
    })
    o = Ordered(e, [run], [seq]).running({"spent": ("sum", F.col("__spent")), "reserved": ("sum", F.col("__held")), "doubts": ("sum", F.col("__doubt"))})
    exceeds = settled & ((F.col(actual) > F.col("__est")) | (F.col("spent") > budget))
    o = Ordered(o.df.withColumn("__exceeds", F.coalesce(exceeds, F.lit(False))), [run], [seq], _staged=True)
    state = stage(o.running({"breaches": ("sum", number(F.col("__exceeds")))}).rows(), "audit")
    before = lambda total, own: F.col(total) - F.col(own)
    came_well = F.when(F.col(kind) == "proposed", prev.isNull())
    for k, states in TASK_BEFORE.items():
        if states:
            came_well = came_well.when(F.col(kind) == k, F.coalesce(prev.isin(*states), F.lit(False)))
    admitted = F.col(kind) == "admitted"
    rules = {
        "kind": F.col(kind).isin(*TASK_BEFORE),
        "state": F.coalesce(came_well, F.lit(True)),
        "final": ~settled | F.coalesce(F.col(final).isin(*TASK_ENDS), F.lit(False)),
        "unresolved": ~admitted | ((F.col("breaches") == 0) & (before("doubts", "__doubt") == 0)),
        "budget": ~admitted | (F.col("spent") + before("reserved", "__held") + F.col("__est") <= budget),
        "breach": ~settled | F.col(breached).eqNullSafe(F.col("__exceeds")),
    }
    totals = state.groupBy(run).agg(
        F.sum("__spent").alias("spent"), F.sum("__held").alias("reserved"), (F.sum("__doubt") > 0).alias("uncertain"), F.bool_or("__exceeds").alias("breached"), F.countDistinct(task).alias("tasks")
    )
    return violations(state, [run, seq], rules), totals.withColumn("remaining", F.lit(budget) - F.col("spent") - F.col("reserved"))


def budget_totals(events: DataFrame, key: str, amount: str, kind: str, ceiling: int) -> DataFrame:
    return events.groupBy(key).agg(
        F.sum(F.when(F.col(kind) == "recorded", F.col(amount)).otherwise(0)).alias("recorded"),
        F.sum(F.when(F.col(kind) == "reserved", F.col(amount)).otherwise(0)).alias("reserved"),
    ).withColumn("remaining", F.lit(ceiling) - F.col("recorded") - F.col("reserved"))


def append_only_diff(before: DataFrame, after: DataFrame, key: str, fixed: Sequence[str], grow: Sequence[str], status: str, allowed: Sequence[tuple[str, str]]):
    """How a ledger snapshot may change: rows added, arrays extended at their end, status moved along allowed arrows."""
    cols = [*fixed, *grow, status]
    b = before.select(key, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("__b"))
    a = after.select(key, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("__a"))
    j = b.join(a, key, "full")
    both = F.col("__b").isNotNull() & F.col("__a").isNotNull()
    arrow = F.concat_ws(">", F.col(f"b_{status}"), F.col(f"a_{status}"))
    rules = {"removed": F.col("__a").isNotNull()}
    for c in fixed:
        rules[f"changed:{c}"] = ~both | F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    for c in grow:
        prefix = F.slice(F.col(f"a_{c}"), F.lit(1), F.size(f"b_{c}")) == F.col(f"b_{c}")
        rules[f"rewritten:{c}"] = ~both | (F.size(f"b_{c}") == 0) | prefix
    rules["status"] = ~both | (F.col(f"b_{status}") == F.col(f"a_{status}")) | arrow.isin(*[f"{x}>{y}" for x, y in allowed])
    return violations(j, [key], rules)


def reuse_violations(openings: DataFrame, uses: DataFrame, source: str, group: str, consumer: str) -> DataFrame:
    """Consumers of a newly opened group that have already used the source."""
    return openings.join(uses.select(source, consumer).distinct(), [source, consumer], "left_semi").select(source, group, consumer).distinct()


def cover_check(members: DataFrame, frozen: DataFrame, released: DataFrame, key: str) -> DataFrame:
    """Members must be frozen or released, not both, once each; anything else is reported."""
    tag = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    j = tag(members, "m").join(tag(frozen, "f"), key, "full").join(tag(released, "r"), key, "full").fillna(0, ["m", "f", "r"])
    problem = (
        F.when((F.col("m") > 1) | (F.col("f") > 1) | (F.col("r") > 1), "repeated")
        .when((F.col("f") > 0) & (F.col("r") > 0), "in both")
        .when((F.col("m") > 0) & (F.col("f") + F.col("r") == 0), "not covered")
        .when((F.col("m") == 0), "not a member")
    )
    return j.select(key, problem.alias("problem")).where("problem IS NOT NULL")


# Hygiene patterns. Personal paths, merge markers, and common secret shapes.
HYGIENE = {
    "personal_path": r"(/Users/|/home/)[A-Za-z0-9._-]+/",
    "merge_marker": r"^(<{7}|>{7}|={7})( |$)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "api_key": r"(sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9]{16,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


# A text without any of these substrings cannot match the pattern of that name.
HYGIENE_LITERALS = {
    "personal_path": ("/Users/", "/home/"),
    "merge_marker": ("<<<<<<<", ">>>>>>>", "======="),
    "email": ("@",),
    "private_key": ("PRIVATE KEY-----",),
}


def _hit(text: Column, name: str, pattern: str) -> Column:
    """Regular expression behind a cheap substring test where one is known."""
    words = HYGIENE_LITERALS.get(name) if HYGIENE.get(name) == pattern or HYGIENE.get(name) == pattern.removeprefix("(?m)") else None
    if not words:
        return text.rlike(pattern)
    some = F.lit(False)
    for w in words:
        some = some | text.contains(w)
    return some & text.rlike(pattern)


def deny_pattern(names: Sequence[str]) -> str:
    """Names with flexible separators: 'Ann Lee' also finds ann_lee and AnnLee."""
    return "(?i)" + "|".join(r"[\s._-]*".join("".join(ch if ch.isalnum() else "\\" + ch for ch in w) for w in n.split()) for n in names)


# A name's parts may be joined by any of these; other characters part them.
_NAME_TOKEN = re.compile(r"[0-9A-Za-z]+|[^0-9A-Za-z\s._\-/\\]+")


def name_hits(text: str, automaton) -> list[tuple[int, int]]:
    """(line from 1, name) of every whole-word occurrence of a name in a text, by the line on which it begins.

    The text's words stand in one stream with single spaces, where a break of other characters is a word that no name
    has; one pass of the automaton finds all names, also across line ends, and words know their lines.
    """
    words = [(m.start(), m[0].lower() if m[0].isalnum() and m[0].isascii() else "\0") for m in _NAME_TOKEN.finditer(text)]
    if not words:
        return []
    stream = f" {' '.join(w for _, w in words)} "
    ends = list(accumulate(len(w) + 1 for _, w in words))  # of each word in the stream
    breaks = [m.start() for m in re.finditer("\n", text)]
    found = []
    for end, (name, length) in automaton.iter(stream):
        word = bisect_left(ends, end - length + 2)
        found.append((bisect_left(breaks, words[word][0]) + 1, name))
    return found


def deny_hits(docs: DataFrame, doc_id: str, text: str, names: Sequence[str]) -> DataFrame:
    """(doc, line, name): every occurrence of a listed name as whole words, whatever separators join its parts.

    Case doesn't matter; a name split over lines counts for the line on which it begins. Null texts hold none.
    """
    parts = [" ".join(re.findall("[0-9A-Za-z]+", n.lower())) for n in names]
    key = {f.name: f.dataType.simpleString() for f in docs.schema}[doc_id]

    def run(batches):
        automaton = ahocorasick.Automaton()
        for k, n in enumerate(parts):
            if n:
                automaton.add_word(f" {n} ", (k, len(n) + 2))
        automaton.make_automaton()
        for batch in batches:
            rows, lines, which = [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                for line, name in name_hits(t, automaton) if t and len(automaton) else ():
                    rows.append(row)
                    lines.append(line)
                    which.append(names[name])
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.int32()), pa.array(which, pa.string())], ["id", "line", "name"])

    return docs.select(doc_id, text).mapInArrow(run, f"id {key}, line int, name string").withColumnRenamed("id", doc_id)


def hygiene_hits(docs: DataFrame, doc_id: str, text: str, patterns: Mapping[str, str], max_line: int | None = None) -> DataFrame:
    """(doc, line, rule) for every whole line that matches; lines are numbered from 1.

    Documents are first tested as a whole where that is equivalent, so clean texts are never split.
    """
    any_line = F.lit(False)
    for n, p in patterns.items():
        any_line = any_line | _hit(F.col(text), n, "(?m)" + p)
    if max_line is not None:
        any_line = any_line | (F.length(text) > max_line)
    lines = docs.where(any_line).select(doc_id, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    rules = [F.when(_hit(F.col("t"), n, p), F.lit(n)) for n, p in patterns.items()]
    if max_line is not None:
        rules.append(F.when(F.length("t") > max_line, F.lit("oversize")))
    return lines.select(doc_id, (F.col("line") + 1).alias("line"), F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def constants_agreement(used: DataFrame, registered: DataFrame) -> DataFrame:
    """(name, status) comparing JSON-typed values: 1 and 1.0 and \"1\" are all different."""
    u, r = used.select("name", F.col("value").alias("u")), registered.select("name", F.col("value").alias("r"))
    status = F.when(F.col("u").isNull(), "unused").when(F.col("r").isNull(), "unregistered").when(F.col("u") == F.col("r"), "same").otherwise("differs")
    return u.join(r, "name", "full").select("name", status.alias("status"))


def foreign_key_violations(df: DataFrame, row_id: Sequence[str], key: str, target: DataFrame, target_key: str) -> DataFrame:
    t = target.select(F.col(target_key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(t, key, "left_anti").select(*row_id, F.lit(f"foreign:{key}").alias("rule"))
