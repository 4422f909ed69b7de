"""Claim tables: build them, score them, compare releases, tally triage rules.

A claim is one row per (system, item, field). Tallies are single aggregations of 0/1
sums, so the map-side combine reduces any hot system or stratum before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators.resample import cluster_bootstrap
from attesta.session import dealt


def _sum_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def tally(claims: DataFrame, right: Column, flag: Column, by: Sequence[str | Column] = ()) -> DataFrame:
    """Counts, accuracy, flag rate, recall, lift and accepted accuracy; undefined ratios are NULL."""
    flag, wrong = F.coalesce(flag, F.lit(False)), ~F.coalesce(right, F.lit(False))
    agg = claims.groupBy(*by).agg(
        F.count(F.lit(1)).alias("claims"),
        _sum_if(wrong).alias("errors"),
        _sum_if(flag).alias("flagged"),
        _sum_if(flag & wrong).alias("caught"),
    )
    return _rates(agg)


def _rates(agg: DataFrame) -> DataFrame:
    kept = "(claims - flagged)"
    return agg.selectExpr(
        "*",
        "try_divide(claims - errors, claims) AS accuracy",
        "coalesce(try_divide(flagged, claims), 0D) AS flag_rate",
        "try_divide(caught, errors) AS recall",
        "try_divide(try_divide(caught, errors), try_divide(flagged, claims)) AS lift",
        "try_divide(caught, flagged) AS precision",
        f"{kept} AS accepted",
        f"try_divide({kept} - (errors - caught), {kept}) AS accepted_accuracy",
    )


def tally_by_rule(claims: DataFrame, right: Column, rules: Mapping[str, Column], strata: Sequence[str]) -> DataFrame:
    """Every rule in every stratum and pooled, from one scan.

    Rules become columns of one aggregate per stratum; only the small result is unpivoted
    and rolled up, so the claim table is never multiplied by the number of rules.
    """
    wrong = ~F.coalesce(right, F.lit(False))
    cols = [F.count(F.lit(1)).alias("claims"), _sum_if(wrong).alias("errors")]
    for i, cond in enumerate(rules.values()):
        f = F.coalesce(cond, F.lit(False))
        cols += [_sum_if(f).alias(f"f{i}"), _sum_if(f & wrong).alias(f"c{i}")]
    base = claims.groupBy(*strata).agg(*cols)
    long = base.select(
        *strata,
        "claims",
        "errors",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("rule"), F.col(f"f{i}").alias("flagged"), F.col(f"c{i}").alias("caught"))
                    for i, n in enumerate(rules)
                ]
            )
        ).alias("r"),
    ).select(*strata, "r.rule", "claims", "errors", "r.flagged", "r.caught")
    sums = [F.sum(c).alias(c) for c in ("claims", "errors", "flagged", "caught")]
    pooled = long.groupBy("rule").agg(*sums)
    pooled = pooled.select(*[F.lit("(all)").alias(s) for s in strata], *pooled.columns)
    return _rates(long.unionByName(pooled))


def build_claims(answers: DataFrame, key: Sequence[str], system: str, pred: str, truth: str, text: str) -> DataFrame:
    """Correctness, peer disagreement and lexical support for two systems answering the same items.

    A missing peer answer is a gap, not a disagreement. Answers that normalise to unstated
    or unknown are no claims.
    """
    # Labels are normalised once, before the join, on each side's own rows.
    base = answers.withColumn("__norm", X.norm_label(F.col(pred)))
    peers = answers.where(F.coalesce(F.col(pred), F.lit("")) != "").select(
        *key, F.col(system).alias("__sys"), X.norm_label(F.col(pred)).alias("__peer")
    )
    real = base.where(F.col(pred).isNotNull() & ~F.col("__norm").isin("unstated", "unknown", ""))
    scored = real.select(
        *key, system, "__norm",
        X.any_match(F.col(pred), F.col(truth)).alias("right"),
        (~X.lexical_support(F.col(pred), F.col(text))).alias("flag_text"),
    )
    cond = F.col(f"a.{system}") != F.col("b.__sys")
    for k in key:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = scored.alias("a").join(peers.alias("b"), cond, "left")
    disagree = F.col("b.__peer").isNotNull() & ~X.contains_either_way(F.col("a.__norm"), F.coalesce("b.__peer", F.lit("")))
    return joined.select(*[F.col(f"a.{c}") for c in (*key, system, "right")], disagree.alias("flag_peer"), "a.flag_text")


def curated_claims(rows: DataFrame, curated: DataFrame, key: str, term: Column, healthy: Column, normal: str):
    """Join rows to curated key sets; claims exist only where the key set is non-empty."""
    c = curated.select(key, "key_ids").where(F.size("key_ids") > 0)
    j = rows.join(c, key)
    has_term = term.isNotNull() & (term != "")
    kind = F.when(has_term, "term call").when(healthy, "healthy call")
    right = F.when(has_term, F.array_contains("key_ids", term)).otherwise(F.array_contains("key_ids", F.lit(normal)))
    return j.withColumns({"kind": kind, "right": right, "n_key": F.size("key_ids")}).where(kind.isNotNull())


def hierarchy_verdict(claims: DataFrame, term: str, keys: str, ancestors: DataFrame) -> DataFrame:
    """agree / related (one is an ancestor of the other) / conflict.

    `ancestors` holds (term, ancestor) pairs. Claims meet it through two equi-joins on exploded
    (claim, key) pairs, then one verdict is aggregated back per claim.
    """
    pairs = claims.select("claim_id", F.col(term).alias("t"), F.explode(keys).alias("k"))
    up = ancestors.select(F.col("term").alias("t"), F.col("ancestor").alias("k"), F.lit(True).alias("up"))
    down = ancestors.select(F.col("term").alias("k"), F.col("ancestor").alias("t"), F.lit(True).alias("down"))
    j = pairs.join(up, ["t", "k"], "left").join(down, ["t", "k"], "left")
    score = F.when(F.col("t") == F.col("k"), 2).when(F.col("up") | F.col("down"), 1).otherwise(0)
    verdict = j.groupBy("claim_id").agg(F.max(score).alias("s"))
    return claims.join(verdict, "claim_id").select(
        *claims.columns, F.when(F.col("s") == 2, "agree").when(F.col("s") == 1, "related").otherwise("conflict").alias("verdict")
    )


def release_changes(old: DataFrame, new: DataFrame, key: str, vocab: DataFrame, normal: str = "__normal__") -> DataFrame:
    """Join two releases on a shared key and resolve both sides to comparable tokens.

    Inputs carry (key, label, term). `vocab` maps a normalised label to a term. A side that
    cannot be resolved leaves `changed` NULL, to be counted as unresolvable.
    """
    o = old.select(key, X.norm_simple(F.col("label")).alias("old_label"))
    n = new.select(key, X.norm_simple(F.col("label")).alias("new_label"), F.col("term").alias("new_term"))
    v1 = vocab.select(F.col("label").alias("old_label"), F.col("term").alias("v_old"))
    v2 = vocab.select(F.col("label").alias("new_label"), F.col("term").alias("v_new"))
    j = o.join(n, key).join(v1, "old_label", "left").join(v2, "new_label", "left")

    def token(label, known):
        healthy = X.healthy_call(F.lit(None).cast("string"), F.col(label), "release")
        return F.when(healthy, F.lit(normal)).otherwise(F.col(known))

    a, b = token("old_label", "v_old"), F.coalesce(F.col("new_term"), token("new_label", "v_new"))
    return j.select(key, a.alias("old"), b.alias("new"), (a != b).alias("changed"))


def churn(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return changes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shared"),
        F.count("changed").alias("scored"),
        F.count_if(F.col("changed").isNull()).alias("unresolved"),
        F.count_if("changed").alias("changed"),
        F.avg(F.col("changed").cast("int")).alias("churn"),
    )


def churn_directions(changes: DataFrame, normal: str = "__normal__") -> DataFrame:
    side = lambda c: F.when(F.col(c) == normal, "normal").otherwise("disease")
    counts = changes.where("changed").groupBy(side("old").alias("from"), side("new").alias("to")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def first_by(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Keep, per key, the row with the smallest ordinal ('first wins'); combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def accuracy_three_ways(
    claims: DataFrame, right: str, passage: str, ordinal: str, by: Sequence[str] = (), cluster: str | None = None, reps: int = 4000, seed: int = 7
) -> DataFrame:
    """Row accuracy beside accuracy over distinct passages (first occurrence counts).

    With `cluster`, also the percentile interval (lo, hi) of row accuracy when whole clusters are resampled.
    """
    rows = claims.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(right).cast("int")).alias("row_accuracy"))
    ded = first_by(claims.select(*by, passage, ordinal, right), [*by, passage], ordinal)
    d = ded.groupBy(*by).agg(F.count(F.lit(1)).alias("n_distinct"), F.avg(F.col(right).cast("int")).alias("dedup_accuracy"))
    out = rows.join(d, list(by)) if by else rows.join(F.broadcast(d))
    if cluster is None:
        return out
    sums = {"__s": F.col(right).cast("int"), "__n": F.lit(1)}
    ci = cluster_bootstrap(claims, cluster, sums, F.expr("__s / __n"), by, reps, seed, None).select(*by, "lo", "hi")
    return out.join(ci, list(by)) if by else out.join(F.broadcast(ci))


def class_hits(claims: DataFrame, right: str, classes: str, min_n: int = 10) -> DataFrame:
    """Hits per answer-key class, and the share of all errors carried by the worst one."""
    per = claims.select(F.explode(classes).alias("cls"), F.col(right).cast("int").alias("r")).groupBy("cls").agg(
        F.sum("r").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    worst = per.agg(
        F.min_by("cls", F.when(F.col("n") >= min_n, F.struct(F.col("hits") / F.col("n"), F.col("cls")))).alias("worst"),
        F.sum(F.col("n") - F.col("hits")).alias("errors"),
    )
    j = per.join(F.broadcast(worst))
    return j.select(
        "cls", "hits", "n", (F.col("cls") == F.col("worst")).alias("is_worst"),
        F.try_divide(F.col("n") - F.col("hits"), F.col("errors")).alias("error_share"),
    )


def independence(df: DataFrame, passage: Column, entity: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct passages, distinct entities and the most repeated passage's count.

    Long passages are compared by SHA-256, so the shuffle moves digests instead of texts.
    """
    base = df.select(*by, F.sha2(passage, 256).alias("__p"), entity.alias("__e"))
    per = base.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("n"))
    p = per.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_passages"), F.max("n").alias("max_repeats")
    )
    e = base.select(*by, "__e").distinct().groupBy(*by).agg(F.count("__e").alias("n_entities"))
    return p.join(e, list(by)) if by else p.join(F.broadcast(e))


def recall_by_depth(truth: DataFrame, answers: DataFrame, subject: str, item: str) -> DataFrame:
    """Per system and depth: hits over truth items. Every system faces the whole truth of its subjects."""
    asked = answers.select("system", subject).distinct()
    expected = asked.join(truth, subject)
    got = answers.select("system", subject, item).distinct().withColumn("hit", F.lit(1))
    return (
        expected.join(got, ["system", subject, item], "left")
        .groupBy("system", "depth")
        .agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("total"))
        .withColumn("recall", F.col("hits") / F.col("total"))
    )


def false_positives(truth: DataFrame, answers: DataFrame, subject: str, item: str) -> DataFrame:
    """Distinct answers of each system that are not in `truth`."""
    a, t = dealt([subject, item], answers.select("system", subject, item), truth.select(subject, item))
    return a.join(t, [subject, item], "left_anti").distinct().groupBy("system").agg(
        F.count(F.lit(1)).alias("false_pos")
    )


def set_scores(proposals: DataFrame, key: DataFrame, own: DataFrame, item: str, cited: str) -> DataFrame:
    """Precision, recall and grounding of proposed items per system.

    Grounded: at least two cited members belong to the item's own row in `own` (item, members).
    """
    prop = proposals.join(own, item, "left").select(
        "system",
        item,
        (F.size(F.array_intersect(cited, F.coalesce("members", F.array().cast("array<string>")))) >= 2).alias("g"),
    )
    prop = prop.groupBy("system", item).agg(F.bool_or("g").alias("g"))
    flagged = prop.join(key.select(item).distinct().withColumn("in_key", F.lit(True)), item, "left")
    size = key.select(item).distinct().agg(F.count(F.lit(1)).alias("key_size"))
    out = flagged.groupBy("system").agg(
        F.count(F.lit(1)).alias("proposed"),
        F.count("in_key").alias("correct"),
        F.count_if(F.col("in_key").isNull()).alias("off_key"),
        F.count_if("g").alias("grounded"),
    ).join(F.broadcast(size))
    return out.selectExpr(
        "*", "key_size - correct AS missed", "try_divide(correct, proposed) AS precision",
        "try_divide(correct, key_size) AS recall", "try_divide(grounded, proposed) AS grounding",
    )


def abstention_scores(answers: DataFrame, pred: Column, truth: Column, stated: Column, by: Sequence[str]) -> DataFrame:
    """Answers are scored; an abstention is right only where the text really states nothing."""
    gave_up = pred == "unstated"
    return answers.groupBy(*by).agg(
        F.count_if(~gave_up).alias("answered"),
        F.count_if(~gave_up & (pred == truth)).alias("right"),
        F.count_if(gave_up & ~stated).alias("abstain_ok"),
        F.count_if(gave_up & stated).alias("abstain_miss"),
    )


def placement(items: DataFrame, attribute: Column, placed: Column, by: Sequence[str]) -> DataFrame:
    """Where did items with an unknown attribute land, and how many determinate ones are right?"""
    unknown = attribute.isNull()
    return items.groupBy(*by).agg(
        F.count_if(unknown).alias("undetermined"),
        F.count_if(unknown & (placed == "unknown")).alias("as_unknown"),
        F.count_if(unknown & (placed == "no")).alias("as_no"),
        F.count_if(unknown & (placed == "yes")).alias("as_yes"),
        F.count_if(F.coalesce(attribute, F.lit(False)) & (placed == "yes")).alias("determinate_ok"),
    )


def contradicted(facts: DataFrame, entity: str, direction: str) -> DataFrame:
    """Entities carrying more than one direction; min and max differ, so no pair is ever formed."""
    return (
        facts.groupBy(entity)
        .agg(F.min(direction).alias("first_dir"), F.max(direction).alias("last_dir"), F.count(F.lit(1)).alias("n"))
        .where(F.col("first_dir") != F.col("last_dir"))
    )
