"""Key joins with stated behaviour for unmatched, repeated, unordered and listed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as X


class Refused(ValueError):
    """A guard found data that the operator must not silently drop."""


def strict_map_join(left: DataFrame, mapping: DataFrame, on: str) -> DataFrame:
    """Inner join that refuses when any left key has no mapping."""
    missing = left.select(on).join(mapping.select(on), on, "left_anti").limit(1).collect()
    if missing:
        raise Refused(f"{on}={missing[0][0]!r} has no mapping")
    return left.join(mapping, on)


def crosswalk_join(left: DataFrame, crosswalk: DataFrame, on: str, measure: str) -> DataFrame:
    """Keep rows whose id is in the crosswalk and whose measure is present."""
    return left.where(F.col(measure).isNotNull()).join(crosswalk, on)


def alias_table(names: DataFrame, id_col: str, name_cols: Sequence[str], ordinal: str) -> DataFrame:
    """Normalised spelling -> id. Every name column counts; the earliest row owns a spelling."""
    exploded = names.select(
        id_col, ordinal, F.posexplode(F.array(*[F.col(c) for c in name_cols])).alias("slot", "name")
    ).where(F.col("name").isNotNull() & (F.trim("name") != ""))
    spelled = exploded.withColumn(
        "key", F.explode(F.array_distinct(F.array(F.upper(F.trim("name")), X.upper_alnum(F.col("name")))))
    )
    return spelled.where("key <> ''").groupBy("key").agg(
        F.min_by(id_col, F.struct(ordinal, "slot", F.col(id_col))).alias(id_col)
    )


def resolve_aliases(df: DataFrame, row_id: str, names: str, aliases: DataFrame, id_col: str) -> DataFrame:
    """Resolve a 'a|b|c' name list to the id of its first known alias; unknown rows keep NULL."""
    parts = df.select(row_id, F.posexplode(F.split(names, "\\|")).alias("pos", "part"))
    keys = parts.select(row_id, "pos", X.upper_alnum(F.col("part")).alias("key"))
    hit = keys.join(aliases, "key").groupBy(row_id).agg(F.min_by(id_col, "pos").alias(id_col))
    return df.join(hit, row_id, "left")


def admitted(df: DataFrame, universe: DataFrame, on: str, excluded: DataFrame | None = None) -> DataFrame:
    out = df.join(universe.select(on), on, "left_semi")
    return out if excluded is None else out.join(excluded.select(on), on, "left_anti")


def unordered(df: DataFrame, a: str, b: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Add the pair in canonical order; pairs with a NULL member are dropped."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns(
        {lo: F.least(a, b), hi: F.greatest(a, b)}
    )


def unordered_pair_join(left: DataFrame, right: DataFrame, a: str, b: str, how: str = "inner") -> DataFrame:
    """Match (a, b) with (b, a) too; `flipped` tells whether the right row was given in the other order."""
    l, r = unordered(left, a, b), unordered(right, a, b)
    r = r.withColumnRenamed(a, "__ra").drop(b)
    j = l.join(r, ["lo", "hi"], how)
    return j.withColumn("flipped", F.col(a) != F.col("__ra")).drop("lo", "hi", "__ra")


def pairs_sharing_set(pairs: DataFrame, pair_id: Sequence[str], members: DataFrame) -> DataFrame:
    """How many sets hold both members of each *given* pair.

    The pair list drives the join through (set, member) keys, so no set ever emits its own pairs.
    """
    a, b = pair_id
    with_sets = pairs.select(a, b).join(members.select(F.col("member").alias(a), "set_id"), a)
    both = with_sets.join(members.select(F.col("member").alias(b), "set_id"), [b, "set_id"], "left_semi")
    hits = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_shared"))
    return pairs.join(hits, [a, b], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("bigint")))


def group_member_spread(df: DataFrame, group: str, member: str) -> DataFrame:
    """Per group: does it hold two different members, and how many unordered pairs that makes.

    Inequality is min <> max and the pair count comes from the distinct count, so no pair is emitted.
    """
    d = df.where(F.col(member).isNotNull()).select(group, member).distinct()
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.min(member).alias("lo"), F.max(member).alias("hi"))
    return g.withColumn("n_pairs", (F.col("members") * (F.col("members") - 1) / 2).cast("bigint"))


def directed_pairs(features: DataFrame, partners: DataFrame, tainted: DataFrame, key: str, partner: str) -> DataFrame:
    """Feature-partner pairs without self pairs and without tainted members, each once."""
    j = features.select(key).distinct().join(partners.select(key, partner), key).where(F.col(key) != F.col(partner))
    bad = tainted.select(F.col(key).alias("__bad")).distinct()
    clean = j.join(bad, j[key] == F.col("__bad"), "left_anti").join(bad, j[partner] == F.col("__bad"), "left_anti")
    return clean.dropDuplicates([key, partner])


def tainted_keys(guides: DataFrame, guide: str, key: str, alignments: str) -> DataFrame:
    """Keys hit by a guide that names several keys or aligns more than once."""
    multi = guides.groupBy(guide).agg(F.min(key).alias("a"), F.max(key).alias("b"), F.max(alignments).alias("n"))
    bad = multi.where((F.col("a") != F.col("b")) | (F.col("n") > 1)).select(guide)
    return guides.join(bad, guide, "left_semi").select(key).distinct()


def first_block_crosswalk(left: DataFrame, right: DataFrame, key: str, block: int, right_id: str) -> DataFrame:
    """Join on the first `block` characters of a structured key; one row per match."""
    r = right.select(F.substring(key, 1, block).alias("__blk"), right_id)
    return left.withColumn("__blk", F.substring(key, 1, block)).join(r, "__blk").drop("__blk")


def ancestor_sets(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """Distinct (group, term-or-ancestor) rows, the joinable form of a key set with its ancestors."""
    up = nodes.join(edges, "term").select(group, F.col("ancestor").alias("term"))
    return nodes.select(group, "term").unionByName(up).distinct()


def exact_pairing(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer join of two tracks that must have identical keys; `side` marks any difference."""
    x = a.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__ina"))
    y = b.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__inb"))
    j = x.join(y, list(keys), "full")
    side = F.when(F.col("__ina").isNull(), "right only").when(F.col("__inb").isNull(), "left only").otherwise("both")
    return j.select(*keys, F.col("__a").alias("a"), F.col("__b").alias("b"), side.alias("side"))


def delta_summary(paired: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sign counts of b - a; DECIMAL inputs stay exact. A key mismatch voids the group."""
    delta = F.col("b") - F.col("a")
    g = paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("side") != "both").alias("mismatched"),
        F.avg(delta).alias("__mean"),
        F.count_if(delta > 0).alias("up"),
        F.count_if(delta < 0).alias("down"),
    )
    return g.withColumn("mean_delta", F.when(F.col("mismatched") == 0, F.col("__mean"))).drop("__mean")


def fold_pairs(predictors: Sequence[str], outcomes: Sequence[str], source: dict[str, str] | None = None):
    """Column-name pairs to screen: no self pairs, no same-source pairs, each unordered pair once.

    Works on column names only (table metadata); the pairs become columns of one aggregate.
    """
    seen, out = set(), []
    for p in predictors:
        for o in outcomes:
            key = frozenset((p, o))
            same = source is not None and source.get(p) is not None and source.get(p) == source.get(o)
            if p != o and not same and key not in seen:
                seen.add(key)
                out.append((p, o))
    return out


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation and complete-row count for each named pair, in one pass over the rows."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(*by, F.inline(rows))


def best_proxy(corr: DataFrame, feature: str, other: str, r: str, n: str, min_r: float = 0.5, min_n: int = 30):
    """The strongest tracking feature of each feature, where |r| > min_r on at least min_n rows."""
    ok = corr.where((F.abs(r) > min_r) & (F.col(n) >= min_n))
    best = F.max_by(F.struct(other, r, n), F.struct(F.abs(r), F.col(other)))
    return ok.groupBy(feature).agg(best.alias("b")).select(feature, f"b.{other}", f"b.{r}", f"b.{n}")


def known_classes(flags: dict[str, Column], known: Sequence[str]) -> list[Column]:
    """`classes` = names of the true flags; `known` = whether any belongs to the established subset."""
    classes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))
    return [classes.alias("classes"), F.arrays_overlap(classes, F.array(*[F.lit(k) for k in known])).alias("known")]
