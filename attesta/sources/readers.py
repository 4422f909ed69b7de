"""Readers for the text and table layouts of the studies, each returning a typed DataFrame.

Readers parse with built-in expressions on lines or rows, so scans split over tasks as Spark
splits the files; nothing but a header line ever reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.functions.numeric import clean
from attesta.operators.joins import Refused


# --- matrices ----------------------------------------------------------------------------------


def wide_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Wide matrix CSV -> (row_id, col_id, value). Id suffixes are stripped, the first of repeated
    headers wins, empty cells stay NULL. Only the header line is read on the driver."""
    header = next(c for c in spark.read.text(path).where(F.col("value") != "").limit(1).collect())[0].split(sep)
    names = [re.sub(r"\s*\(\d+\)$", "", h.strip().strip('"')) for h in header]
    fields = ", ".join(["row_id string", *[f"c{i} double" for i in range(1, len(names))]])
    raw = spark.read.schema(fields).option("sep", sep).option("header", "true").option("enforceSchema", "true").csv(path)
    first = {}
    for i, n in enumerate(names[1:], 1):
        first.setdefault(n, i)
    long = raw.unpivot(["row_id"], [f"c{i}" for i in first.values()], "__c", "value")
    symbol = F.create_map(*[v for n, i in first.items() for v in (F.lit(f"c{i}"), F.lit(n))])
    return long.select("row_id", symbol[F.col("__c")].alias("col_id"), clean(F.col("value")).alias("value"))


def oriented(long: DataFrame, id_pattern: str, min_share: float = 0.5) -> DataFrame:
    """Put the axis that holds the ids into `row_id`; refuse when neither or both axes match."""
    axis = lambda c: F.avg(F.col(c).rlike(id_pattern).cast("int"))
    rows = long.select("row_id").distinct().agg(axis("row_id")).first()[0] or 0.0
    cols = long.select("col_id").distinct().agg(axis("col_id")).first()[0] or 0.0
    if (rows >= min_share) == (cols >= min_share):
        raise Refused(f"ids match {rows:.2f} of the rows and {cols:.2f} of the columns")
    if rows >= min_share:
        return long
    return long.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def flagged_calls(spark: SparkSession, path: str, schema: str, cols: Sequence[str], flag: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose flag is true, all profiled ids): absence of a call is a negative only for profiled ids."""
    scan = spark.read.schema(schema).option("header", "true").csv(path).select(*cols, flag)
    return scan.where(F.col(flag)).select(*cols), scan.select(entity).distinct()


def count_matrix(spark: SparkSession, path: str, annotation: Sequence[str] = ()) -> DataFrame:
    """Count TSV (id, optional annotation columns, libraries) -> (feature, library, n, raw)."""
    header = spark.read.text(path).limit(1).first()[0].split("\t")
    schema = ", ".join(f"`{h}` string" for h in header)
    raw = spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)
    libs = [h for h in header[1:] if h not in annotation]
    long = raw.select(header[0], *libs).unpivot([header[0]], libs, "library", "raw").withColumnRenamed(header[0], "feature")
    return long.withColumn("n", F.when(F.col("raw").rlike("^[0-9]+$"), F.col("raw").try_cast("bigint")))


# --- tracks and contacts -----------------------------------------------------------------------


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant reader: comments and track lines are skipped, the prefix is unified, bad values are NULL."""
    t = spark.read.text(path).select(F.trim("value").alias("v"))
    t = t.where((F.col("v") != "") & ~F.col("v").rlike("^(track|browser|#)"))
    p = F.split("v", "\\s+")
    row = t.select(
        X.with_chr(p[0]).alias("chrom"), p[1].try_cast("bigint").alias("start"), p[2].try_cast("bigint").alias("end"),
        clean(F.get(p, 3).try_cast("double")).alias("value"),
    )
    return row.where("start IS NOT NULL AND end IS NOT NULL")


def bedgraph_rules(max_abs: float = 1e6) -> dict[str, Column]:
    """Row rules of the strict form, for `audit.violations` over `strict_bedgraph` rows."""
    return {
        "width": F.col("n_fields") == 4,
        "interval": (F.col("start") >= 0) & (F.col("end") > F.col("start")),
        "value": F.col("value").isNotNull() & (F.abs("value") <= max_abs),
        "order": F.col("prev_start").isNull() | (F.col("start") >= F.col("prev_start")),
    }


def strict_bedgraph(lines: DataFrame, ordinal: str, line: str) -> DataFrame:
    """Parsed rows with field count and the previous start in file order (ordinals are consecutive)."""
    p = F.split(line, "\t")
    d = lines.select(
        ordinal, F.size(p).alias("n_fields"), p[0].alias("chrom"), F.get(p, 1).try_cast("bigint").alias("start"),
        F.get(p, 2).try_cast("bigint").alias("end"), F.get(p, 3).try_cast("decimal(38,18)").alias("value"),
    )
    prev = d.select((F.col(ordinal) + 1).alias(ordinal), F.col("chrom").alias("__c"), F.col("start").alias("__s"))
    j = d.join(prev, ordinal, "left")
    return j.withColumn("prev_start", F.when(F.col("__c") == F.col("chrom"), F.col("__s"))).drop("__c", "__s")


def valid_pairs(lines: DataFrame, line: str, sizes: DataFrame, min_mapq: int | None = None) -> DataFrame:
    """Contact lines -> (chrom, pos1, pos2, reason); reason is NULL for rows to keep.

    Layout 1: read chr1 pos1 strand1 chr2 pos2 strand2 [frag r1 r2 mapq1 mapq2]; layout 2 puts both
    positions first. Each line decides by whether its fourth field is a strand, so folders may mix layouts.
    """
    data = lines.where((F.trim(line) != "") & ~F.col(line).startswith("#")).select(F.split(F.trim(line), "\\s+").alias("f"))
    first = F.coalesce(F.get("f", 3).isin("+", "-"), F.lit(True))
    c1, p1 = F.get("f", 1), F.get("f", 2)
    c2, p2 = (F.when(first, F.get("f", i + 1)).otherwise(F.get("f", i)) for i in (3, 4))
    d = data.select(
        F.size("f").alias("w"), X.with_chr(c1).alias("chrom"), X.with_chr(c2).alias("chrom2"),
        p1.try_cast("bigint").alias("pos1"), p2.try_cast("bigint").alias("pos2"),
        F.get("f", 10).try_cast("int").alias("q1"), F.get("f", 11).try_cast("int").alias("q2"),
    ).join(sizes.select("chrom", "length"), "chrom", "left")
    low = F.lit(False) if min_mapq is None else F.coalesce(F.least("q1", "q2") < min_mapq, F.lit(False))
    reason = (
        F.when((F.col("w") < 7) | F.col("pos1").isNull() | F.col("pos2").isNull(), "malformed")
        .when(F.col("chrom") != F.col("chrom2"), "trans")
        .when(~X.is_autosome(F.col("chrom")), "not_autosomal")
        .when(F.col("length").isNull() | (F.least("pos1", "pos2") < 1) | (F.greatest("pos1", "pos2") > F.col("length")), "out_of_range")
        .when(low, "low_mapq")
    )
    return d.select("chrom", "pos1", "pos2", reason.alias("reason"))


def sparse_matrix(entries: DataFrame, bins: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(id1, id2, value) with (id, chrom, start) bins -> cis upper triangle, and misaligned bins as rows."""
    bad = bins.where(F.col("start") % width != 0).select("id", F.lit("alignment").alias("rule"))
    b = lambda i: bins.select(F.col("id").alias(f"id{i}"), F.col("chrom").alias(f"c{i}"), F.floor(F.col("start") / width).alias(f"b{i}"))
    j = entries.join(b(1), "id1").join(b(2), "id2").where("c1 = c2")
    m = j.groupBy(F.col("c1").alias("chrom"), F.least("b1", "b2").alias("i"), F.greatest("b1", "b2").alias("j")).agg(F.max("value").alias("w"))
    return m, bad


def gene_annotation(lines: DataFrame, line: str, minus_offset: int = 1) -> DataFrame:
    """Gene table lines with or without a leading bin column; the strand column decides per line.

    The transcription start is `start` on + and `end - minus_offset` on -.
    """
    f = F.split(line, "\t")
    shift = F.when(F.get(f, 3).isin("+", "-"), 1).when(F.get(f, 2).isin("+", "-"), 0)
    d = lines.select(f.alias("f"), shift.alias("k")).where("k IS NOT NULL")
    at = lambda i: F.get("f", F.col("k") + i)
    strand, start, end = at(2), at(3).try_cast("bigint"), at(4).try_cast("bigint")
    return d.select(
        at(0).alias("name"), X.with_chr(at(1)).alias("chrom"), strand.alias("strand"),
        F.when(strand == "+", start).otherwise(end - minus_offset).alias("tss"),
    )


# --- records and answers -----------------------------------------------------------------------

COLLECTION_SCHEMA = (
    "collection_id string, name string, description string, "
    "datasets array<struct<tissue: array<struct<label: string, tissue_type: string>>, disease: array<struct<label: string>>>>"
)


def nested_items(spark: SparkSession, path: str, min_text: int, take: int | None = None) -> DataFrame:
    """Collections -> (id, text, tissue[], disease[]): long enough text, real tissues, both label sets present."""
    d = spark.read.schema(COLLECTION_SCHEMA).json(path).where(F.length("description") >= min_text)
    real = F.filter(F.flatten("datasets.tissue"), lambda t: t["tissue_type"] == "tissue")
    labels = lambda a: F.array_distinct(F.array_compact(F.transform(a, lambda t: t["label"])))
    out = d.select("collection_id", F.concat_ws(" ", "name", "description").alias("text"), labels(real).alias("tissue"), labels(F.flatten("datasets.disease")).alias("disease"))
    out = out.where((F.size("tissue") > 0) & (F.size("disease") > 0))
    return out if take is None else out.orderBy("collection_id").limit(take)


def answer_blocks(df: DataFrame, row_id: str, text: str, fields: Sequence[str], n_items: Column | None = None) -> DataFrame:
    """Texts of '[i]' blocks with 'field: value' lines -> one row per (text, i), last value of a field wins.

    Each text is split where a block opens, so no window over lines is needed.
    """
    blocks = df.select(row_id, *([n_items.alias("__n")] if n_items is not None else []), F.explode(F.split(text, "(?m)^(?=\\s*\\[\\d+\\])")).alias("b"))
    head = F.regexp_extract("b", "^\\s*\\[(\\d+)\\]", 1)
    d = blocks.withColumn("i", F.when(head != "", head).cast("int")).where("i IS NOT NULL")
    if n_items is not None:
        d = d.where((F.col("i") >= 0) & (F.col("i") < F.col("__n")))
    pick = lambda f: F.element_at(F.regexp_extract_all("b", F.lit(f"(?mi)^\\s*{f}\\s*:\\s*(.*?)\\s*$"), 1), -1)
    some = lambda f: F.when(F.regexp_like("b", F.lit(f"(?mi)^\\s*{f}\\s*:")), pick(f)).alias(f)
    return d.select(row_id, "i", *[some(f) for f in fields])


def sectioned_list(df: DataFrame, row_id: str, text: str, headings: Sequence[str], symbol: str = "^[A-Z][A-Z0-9-]*$") -> DataFrame:
    """Headings open sections; symbol lines belong to the open one. Distinct (text, section, member)."""
    heads = "|".join(re.escape(h) for h in headings)
    parts = df.select(row_id, F.explode(F.split(text, f"(?m)^(?=(?:{heads}):?\\s*$)")).alias("b"))
    d = parts.select(row_id, F.regexp_extract("b", f"^({heads}):?\\s*(?:\\n|$)", 1).alias("section"), F.explode(F.split("b", "\n")).alias("line"))
    return d.select(row_id, "section", F.trim("line").alias("member")).where((F.col("section") != "") & F.col("member").rlike(symbol) & ~F.col("member").isin(*headings)).distinct()


def citation_lines(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """'NAME | a | b' lines -> (id, name, cited[], strict); non-conforming lines keep a NULL name.

    Strict lines are exactly a bare name and at least two cited parts; the wide form also takes
    bullets, emphasis marks and one part.
    """
    lines = df.select(row_id, F.explode(F.split(text, "\n")).alias("l")).where(F.trim("l") != "")
    t = F.trim("l")
    strict = t.rlike("^[A-Z0-9][A-Za-z0-9-]*\\s*\\|[^|]+\\|.+$")
    wide = F.regexp_replace(t, "^[-*\\d.)\\s]*\\**|\\**(?=\\s*\\|)", "")
    ok = wide.rlike("^[A-Za-z0-9][A-Za-z0-9-]*\\s*\\|.*\\S")
    p = F.filter(F.transform(F.split(wide, "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select(
        row_id, F.when(ok, p[0]).alias("name"), F.when(ok, F.slice(p, F.lit(2), F.size(p))).alias("cited"), (ok & strict).alias("strict")
    )


def score_files(spark: SparkSession, folder: str, wanted: DataFrame, min_members: int, pattern: str = "^[A-Z][A-Z0-9-]*$") -> DataFrame:
    """Folder partitioned by screen id with (symbol, score) rows -> mean per symbol for wanted screens.

    The metadata decides before any score is read: `wanted` joins on the partition column, which
    Spark turns into partition pruning. Screens with too few valid symbols are left out.
    """
    d = spark.read.schema("symbol string, score string, screen_id string").option("sep", "\t").option("comment", "#").csv(folder)
    d = d.join(wanted.select("screen_id").distinct(), "screen_id", "left_semi")
    v = d.select("screen_id", "symbol", clean(F.col("score").try_cast("double")).alias("score")).where(F.col("symbol").rlike(pattern) & F.col("score").isNotNull())
    g = v.groupBy("screen_id", "symbol").agg(F.avg("score").alias("score"))
    n = g.groupBy("screen_id").agg(F.count(F.lit(1)).alias("n_symbols")).where(F.col("n_symbols") >= min_members)
    return g.join(n, "screen_id")


def key_value_samples(df: DataFrame, sample: str, text: str, keys: Sequence[str]) -> DataFrame:
    """'key = value' lines -> one typed record per sample, with the issues that can be told from it."""
    lines = df.select(sample, F.explode(F.split(text, "\n")).alias("l")).where(F.col("l").contains(" = "))
    kv = lines.select(sample, F.trim(F.split("l", " = ", 2)[0]).alias("k"), F.trim(F.split("l", " = ", 2)[1]).alias("v"))
    rec = kv.groupBy(sample).agg(
        *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in keys],
        *[F.count_if(F.col("k") == k).alias(f"__n_{k}") for k in keys],
    )
    issues = []
    for k in keys:
        issues += [F.when(F.col(k).isNull(), F.lit(f"missing:{k}")), F.when(F.col(f"__n_{k}") > 1, F.lit(f"repeated:{k}"))]
    return rec.select(sample, *keys, F.array_compact(F.array(*issues)).alias("issues"))


def resolve_column(columns: Sequence[str], patterns: Sequence[str]) -> str | None:
    """Exact normalised name first, then a whole-name pattern, then a unique partial match."""
    norm = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in reversed(columns)}
    for p in patterns:
        if re.sub(r"[^a-z0-9]", "", p.lower()) in norm:
            return norm[re.sub(r"[^a-z0-9]", "", p.lower())]
    for find in (re.fullmatch, re.search):
        for p in patterns:
            hits = [c for c in columns if find(p, c, re.I)]
            if len(hits) == 1:
                return hits[0]
    return None


def normalise_pairs(df: DataFrame, dataset: str, config: Mapping) -> DataFrame:
    """Heterogeneous double-perturbation tables -> (dataset, line, gene_a, gene_b, gi, flag).

    `config` names header patterns per field, an optional pair column with its separator, a default
    line, and the score limit used when no flag column exists. A flag column that parses as numbers
    in over 90 % of its rows is read as numeric (non-zero is true), otherwise as words.
    """
    col = {f: resolve_column(df.columns, config[f]) if f in config else None for f in ("gene_a", "gene_b", "pair", "line", "gi", "flag")}
    at = lambda f: F.col("`" + col[f].replace("`", "``") + "`")
    if col["pair"]:
        parts = F.split(at("pair"), config.get("separator", "[_|;]"))
        a, b = parts[0], F.get(parts, 1)
    else:
        a, b = at("gene_a"), at("gene_b")
    line = at("line") if col["line"] else F.lit(config.get("default_line"))
    gi = clean(at("gi").try_cast("double")) if col["gi"] else F.lit(None).cast("double")
    if col["flag"]:
        raw = at("flag").cast("string")
        numeric = df.where(raw.isNotNull()).agg(F.avg(raw.try_cast("double").isNotNull().cast("int"))).first()[0] or 0.0
        flag = (raw.try_cast("double") != 0) if numeric > 0.9 else F.lower(F.trim(raw)).isin("true", "t", "yes", "y", "sl", "hit")
    else:
        flag = gi <= config["gi_limit"]
    return df.select(
        F.lit(dataset).alias("dataset"), line.cast("string").alias("line"), X.upper_alnum(a).alias("gene_a"), X.upper_alnum(b).alias("gene_b"), gi.alias("gi"), flag.alias("flag")
    )


def set_members(lines: DataFrame, line: str, form: str) -> DataFrame:
    """'gmt' rows (set TAB url TAB members...) or 'subunits' rows (set TAB a;b,c) -> distinct (set_id, member)."""
    f = F.split(line, "\t")
    members = F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0))) if form == "gmt" else F.split(F.get(f, 1), "[;,]")
    d = lines.select(f[0].alias("set_id"), F.explode(members).alias("member"))
    return d.select("set_id", F.trim("member").alias("member")).where("member <> ''").distinct()


def jsonl_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ledger lines; a malformed line is an error, not a NULL row."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
