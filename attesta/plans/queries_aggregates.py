"""Study aggregates over counts, long matrices and verdict tables."""

from pyspark.sql import functions as F

from attesta.functions.numeric import ordered_mean
from attesta.operators import aggregates as A

from attesta.plans.registry import registrar
from attesta.session import table

QUERIES, query = registrar()


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    """SELECT l_partkey, l_returnflag, round(avg(l_quantity), 6) AS mean_value, round(quantile_cont(l_quantity, 0.5), 6) AS median_value, count(*) AS n
       FROM lineitem GROUP BY 1, 2"""
)
def replicate_collapse(spark, d):
    li, k = table(spark, d, "lineitem"), ["l_partkey", "l_returnflag"]
    m = A.replicate_mean(li, k, "l_quantity").select(*k, F.round("value", 6).alias("mean_value"))
    q = A.replicate_median(li, k, "l_quantity").select(*k, F.round("value", 6).alias("median_value"), "n")
    return m.join(q, k)


# Count matrix: feature = part, library = supplier group, count = pieces shipped.
_COUNTS = """counts AS (SELECT l_partkey AS feature, 'L' || (l_suppkey % 8) AS library, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)"""


def count_matrix(spark, d):
    li = table(spark, d, "lineitem")
    lib = F.concat(F.lit("L"), (F.col("l_suppkey") % 8).cast("string")).alias("library")
    return li.groupBy(F.col("l_partkey").alias("feature"), lib).agg(F.sum("l_quantity").cast("bigint").alias("n"))


@query(
    f"""WITH {_COUNTS}, t AS (SELECT library, sum(n) * 1800 AS total FROM counts GROUP BY 1)
        SELECT feature, count(*) FILTER (CAST(n AS HUGEINT) * 100000000 > CAST(26 AS HUGEINT) * total) AS n_present,
               count(*) FILTER (CAST(n AS HUGEINT) * 100000000 > CAST(26 AS HUGEINT) * total) >= 4 AS kept
        FROM counts JOIN t ON counts.library = t.library GROUP BY 1"""
)
def presence_filter(spark, d):
    c = count_matrix(spark, d)
    totals = A.observed_totals(c, "library", "n").withColumn("total", F.col("total") * 1800)
    return A.presence_filter(c, "feature", "library", "n", totals)


@query(
    f"""WITH {_COUNTS}, t AS (SELECT library, sum(n) AS total FROM counts GROUP BY 1),
        x AS (SELECT fs.feature, t.library, log2(coalesce(n, 0) * 1e6 / total + 0.5) AS v, t.library < 'L4' AS is_case FROM (SELECT DISTINCT feature FROM counts) fs CROSS JOIN t LEFT JOIN counts c ON c.feature = fs.feature AND c.library = t.library),
        f AS (SELECT feature, avg(v) FILTER (NOT is_case) AS control_mean, avg(v) FILTER (is_case) - avg(v) FILTER (NOT is_case) AS contrast FROM x GROUP BY 1),
        l AS (SELECT x.feature, max(CASE WHEN o.is_case THEN c.case_wo - f0.m0 ELSE f0.m1 - c.ctrl_wo END) AS loo_max FROM x
              JOIN (SELECT feature, library, is_case FROM x) o ON x.feature = o.feature AND x.library = o.library
              JOIN (SELECT feature, avg(v) FILTER (is_case) AS m1, avg(v) FILTER (NOT is_case) AS m0 FROM x GROUP BY 1) f0 ON f0.feature = x.feature
              JOIN (SELECT a.feature, a.library, avg(b.v) FILTER (b.is_case) AS case_wo, avg(b.v) FILTER (NOT b.is_case) AS ctrl_wo
                    FROM x a JOIN x b ON a.feature = b.feature AND a.library <> b.library GROUP BY 1, 2) c ON c.feature = x.feature AND c.library = x.library
              GROUP BY 1)
       SELECT f.feature, round(control_mean, 6) AS control_mean, round(contrast, 6) AS contrast, round(loo_max, 6) AS loo_max, loo_max < 0 AS loo_all_negative
       FROM f LEFT JOIN l ON f.feature = l.feature"""
)
def normalised_contrast(spark, d):
    c = A.normalised_contrast(count_matrix(spark, d), "feature", "library", "n", F.col("library") < "L4")
    return rounded(c, "control_mean", "contrast", "loo_max")


@query(
    f"""WITH {_COUNTS}, g AS (SELECT feature, avg(ln(n)) AS m FROM counts GROUP BY 1 HAVING count(*) FILTER (n > 0) = (SELECT count(DISTINCT library) FROM counts)),
        r AS (SELECT library, quantile_cont(exp(ln(n) - m), 0.5) AS f FROM counts JOIN g USING (feature) GROUP BY 1)
       SELECT library, round(f / exp((SELECT avg(ln(f)) FROM r)), 6) AS size_factor FROM r"""
)
def size_factors(spark, d):
    return rounded(A.size_factors(count_matrix(spark, d), "feature", "library", "n"), "size_factor")


@query(
    """WITH f AS (SELECT p_brand, p_size // 10 AS tile, avg(l_quantity) AS base, avg(l_discount) - 0.05 AS chg FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_size // 10, p_partkey)
       SELECT p_brand, tile, round(avg(chg), 9) AS mean_change, count(chg) AS n FROM f WHERE base >= 25 GROUP BY 1, 2 HAVING count(chg) >= 2"""
)
def tile_mean_change(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    f = li.join(p, li.l_partkey == p.p_partkey).groupBy("p_partkey", "p_brand", F.floor(F.col("p_size") / 10).alias("tile")).agg(
        F.avg("l_quantity").alias("base"), (F.avg("l_discount") - 0.05).alias("chg")
    )
    return rounded(A.tile_mean_change(f, ["p_brand", "tile"], "base", "chg", 25), "mean_change", digits=9)


# Long matrix: row = supplier, column = part brand and size class, value = centred mean discount.
_LONG = """long AS (SELECT l_suppkey AS row_id, p_brand || ':' || (p_size % 2) AS col_id, avg(l_discount) * 20 - 1.4 AS value FROM lineitem JOIN part ON l_partkey = p_partkey
   GROUP BY 1, 2)"""


def long_matrix(spark, d):
    """Means of a cell's rows (a dozen), added up as they are stored: many lie on the thresholds they are compared with."""
    li, p = table(spark, d, "lineitem", place=True), table(spark, d, "part")
    col = F.concat_ws(":", "p_brand", (F.col("p_size") % 2).cast("string")).alias("col_id")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_suppkey").alias("row_id"), col).agg(
        (ordered_mean(F.col("l_discount"), F.col("place")) * 20 - 1.4).alias("value")
    )


@query(
    f"""WITH {_LONG}, b AS (SELECT col_id, s_nationkey AS stratum, CASE WHEN value IS NULL THEN NULL ELSE (value < -0.5)::INT END AS pos FROM long JOIN supplier ON row_id = s_suppkey),
        p AS (SELECT col_id, stratum, count(*) FILTER (pos = 1) AS pos, count(*) FILTER (pos = 0) AS neg FROM b GROUP BY 1, 2),
        g AS (SELECT col_id, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, count(*) FILTER (pos >= 2) AS n_strata FROM p GROUP BY 1)
       SELECT *, n_pos >= 15 AND n_pos <= floor(0.4 * (SELECT count(*) FROM supplier)) AND n_neg >= 15 AND n_strata >= 2 AS qualifies FROM g"""
)
def qualified_contexts(spark, d):
    s = table(spark, d, "supplier")
    n = s.count()
    b = long_matrix(spark, d).join(s, F.col("row_id") == s.s_suppkey).select(
        "col_id", F.col("s_nationkey").alias("stratum"), (F.col("value") < -0.5).cast("int").alias("pos")
    )
    return A.qualify_contexts(b, "col_id", "pos", "stratum", n, min_in_stratum=2)


@query(
    f"""WITH {_LONG}, n AS (SELECT count(*) AS n FROM supplier), g AS (SELECT col_id, count(value) AS n, stddev_pop(value) AS sd, avg(value) AS mean, count(*) FILTER (value <= -0.5) AS hits FROM long GROUP BY 1)
       SELECT col_id, g.n, round(sd, 6) AS sd, round(mean, 6) AS mean, hits, (n.n - g.n) / n.n < 0.05 AND sd >= 0.2 AND hits >= 3 AS kept FROM g, n"""
)
def behaved_columns(spark, d):
    n = table(spark, d, "supplier").count()
    return rounded(A.behaved_columns(long_matrix(spark, d), "col_id", "value", n), "sd", "mean")


@query(
    """WITH c AS (SELECT c_custkey AS row_id, unnest(['bal', 'seg']) AS col_id, unnest([CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 1000 END, length(c_mktsegment)::DOUBLE]) AS value FROM customer),
        m AS (SELECT col_id, avg(value) AS mean FROM c GROUP BY 1)
       SELECT row_id, c.col_id, round(coalesce(value, mean), 6) AS value, value IS NULL AS imputed FROM c JOIN m USING (col_id)"""
)
def mean_imputation(spark, d):
    cell = lambda n, v: F.struct(F.lit(n).alias("col_id"), v.cast("double").alias("value"))
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.inline(F.array(cell("bal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000)), cell("seg", F.length("c_mktsegment")))),
    )
    stats = c.groupBy("col_id").agg(F.avg("value").alias("mean")).withColumn("kept", F.lit(True))
    return rounded(A.impute_mean(c, stats, "col_id", "value"), "value")


_DUP = """d AS (SELECT l_orderkey AS row_id, 'tax' AS col_id, 0 AS ord, l_linenumber AS ln, round(l_tax * 100) AS v FROM lineitem UNION ALL SELECT l_orderkey, 'tax_copy', 1, l_linenumber, round(l_tax * 100) FROM lineitem
  UNION ALL SELECT l_orderkey, 'disc', 2, l_linenumber, round(l_discount * 100) FROM lineitem UNION ALL SELECT l_orderkey, 'disc_copy', 3, l_linenumber, round(l_discount * 100) FROM lineitem
  UNION ALL SELECT l_orderkey, 'disc_off', 4, l_linenumber, CASE WHEN l_quantity = 50 THEN NULL ELSE round(l_discount * 100) END FROM lineitem)"""


@query(
    f"""WITH {_DUP}, s AS (SELECT col_id, min(ord) AS ord, md5(string_agg(row_id || ',' || ln || ',' || coalesce(v::VARCHAR, '?'), ';' ORDER BY row_id, ln, v)) AS h FROM d GROUP BY 1)
       SELECT col_id, first_value(col_id) OVER (PARTITION BY h ORDER BY ord) AS representative, count(*) OVER (PARTITION BY h) AS copies FROM s"""
)
def duplicate_columns(spark, d):
    t, disc = F.round(F.col("l_tax") * 100), F.round(F.col("l_discount") * 100)
    cell = lambda n, o, v: F.struct(F.lit(n).alias("col_id"), F.lit(o).alias("ord"), v.alias("v"))
    long = table(spark, d, "lineitem").select(
        F.concat_ws(",", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row_id"),
        F.inline(F.array(
            cell("tax", 0, t), cell("tax_copy", 1, t), cell("disc", 2, disc), cell("disc_copy", 3, disc),
            cell("disc_off", 4, F.when(F.col("l_quantity") != 50, disc)),
        )),
    )
    return A.duplicate_columns(long, "row_id", "col_id", "v", "ord")


@query(
    """SELECT l_partkey, count(DISTINCT l_returnflag) AS n_datasets FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 2"""
)
def replicated_entities(spark, d):
    return A.replicated_entities(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", F.col("l_discount") >= 0.09)


@query(
    """WITH p AS (SELECT l_suppkey, unnest([l_discount, l_tax]) AS v FROM lineitem)
       SELECT l_suppkey, CASE WHEN count(v) >= 1200 THEN round(quantile_cont(v, 0.05), 6) END AS threshold, count(v) AS n FROM p GROUP BY 1"""
)
def pooled_thresholds(spark, d):
    return rounded(A.pooled_thresholds(table(spark, d, "lineitem"), ["l_suppkey"], ["l_discount", "l_tax"], min_n=1200), "threshold")


@query(
    """WITH u AS (SELECT l_returnflag, l_suppkey, avg((l_discount > 0.08)::INT) AS rate, count(*) FILTER (l_quantity > 48) AS n_sel,
              count(*) FILTER (l_quantity > 48 AND l_discount > 0.08) AS n_hit FROM lineitem GROUP BY 1, 2)
       SELECT sum(n_sel)::BIGINT AS selected, sum(n_hit)::BIGINT AS selected_hits, round(avg(rate) FILTER (n_sel > 0), 9) AS background_rate,
              round(sum(n_hit) / sum(n_sel) / avg(rate) FILTER (n_sel > 0), 9) AS ratio FROM u"""
)
def enrichment_ratio(spark, d):
    e = A.enrichment_ratio(table(spark, d, "lineitem"), ["l_returnflag", "l_suppkey"], F.col("l_discount") > 0.08, F.col("l_quantity") > 48)
    return rounded(e, "background_rate", "ratio", digits=9)


@query(
    """WITH c AS (SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'UNKNOWN' ELSE 'N' || c_nationkey END AS value, count(*) AS n FROM customer GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, value) AS rn, sum(n) OVER (PARTITION BY c_mktsegment) AS t FROM c)
       SELECT c_mktsegment, value, n, rn, round(n / t, 4) AS share FROM r WHERE rn <= 10"""
)
def composition_shares(spark, d):
    c = table(spark, d, "customer").withColumn(
        "cat", F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    )
    return A.composition(c, ["c_mktsegment"], "cat")


_LIB = "CASE WHEN l_discount < 0.03 THEN 'KY' WHEN l_discount < 0.06 THEN 'AV' ELSE 'CD' END"


@query(
    f"""WITH s AS (SELECT l_orderkey, {_LIB} AS lib FROM lineitem)
       SELECT l_orderkey, bool_or(lib = 'KY') AS tier_a, bool_or(lib = 'KY') AND bool_or(lib = 'AV') AS tier_a_shared, bool_and(lib = 'KY') AS tier_b,
              bool_or(lib = 'CD') AS tier_c FROM s GROUP BY 1"""
)
def tier_membership(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.expr(_LIB).alias("lib"))
    return A.tier_membership(li, "l_orderkey", "lib")


@query(
    f"""WITH {_LONG}, b AS (SELECT row_id, col_id, (value < -0.5)::INT AS pos FROM long),
        t AS (SELECT DISTINCT 'R' || (s_nationkey % 3) AS tier, s_suppkey AS row_id FROM supplier),
        c AS (SELECT tier, col_id, count(*) FILTER (pos = 1) AS n_pos, count(*) FILTER (pos = 0) AS n_neg FROM b JOIN t USING (row_id) GROUP BY 1, 2)
       SELECT tier, col_id, p_type AS target, n_pos, n_neg, n_pos >= 5 AND n_neg >= 5 AS testable FROM (SELECT DISTINCT p_brand || ':' || (p_size % 2) AS col_id, p_type FROM part) JOIN c USING (col_id)"""
)
def testability_denominators(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    b = long_matrix(spark, d).withColumn("pos", (F.col("value") < -0.5).cast("int"))
    tiers = s.select(F.concat(F.lit("R"), (F.col("s_nationkey") % 3).cast("string")).alias("tier"), F.col("s_suppkey").alias("row_id"))
    pairs = p.select(F.concat_ws(":", "p_brand", (F.col("p_size") % 2).cast("string")).alias("col_id"), F.col("p_type").alias("target")).distinct()
    return A.testability(pairs, b, "col_id", "row_id", "pos", tiers, 5, 5)


@query(
    """WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.1) AS a, quantile_cont(o_totalprice, 0.9) AS b FROM orders GROUP BY 1)
       SELECT o_orderstatus, round(avg(o_custkey) FILTER (o_totalprice <= a), 6) AS bottom, round(avg(o_custkey) FILTER (o_totalprice >= b), 6) AS top,
              round(avg(o_custkey) FILTER (o_totalprice >= b) - avg(o_custkey) FILTER (o_totalprice <= a), 6) AS difference FROM orders JOIN q USING (o_orderstatus) GROUP BY 1"""
)
def decile_contrast(spark, d):
    return rounded(A.decile_contrast(table(spark, d, "orders"), "o_totalprice", "o_custkey", ["o_orderstatus"]), "bottom", "top", "difference")


@query(
    """WITH p AS (SELECT l_suppkey, stddev_pop(l_discount) / stddev_pop(l_tax) AS ratio FROM lineitem GROUP BY 1)
       SELECT l_suppkey, round(ratio, 6) AS ratio, round((SELECT quantile_cont(ratio, 0.5) FROM p), 6) AS median_ratio,
              round((SELECT stddev_pop(l_discount) / stddev_pop(l_tax) FROM lineitem), 6) AS pooled_ratio FROM p"""
)
def scale_ratio(spark, d):
    return rounded(A.scale_ratio(table(spark, d, "lineitem"), "l_suppkey", "l_discount", "l_tax"), "ratio", "median_ratio", "pooled_ratio")


@query(
    "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY 1"
)
def slope_by_group(spark, d):
    return rounded(A.slopes(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]), "slope", digits=4)


@query(
    f"""WITH {_LONG}, c AS (SELECT row_id, col_id AS context FROM long WHERE value < -0.5),
        v AS (SELECT l_suppkey AS row_id, l_returnflag AS target, l_quantity AS q FROM lineitem)
       SELECT context, target, round(quantile_cont(q, 0.5), 6) AS median FROM v JOIN c USING (row_id) GROUP BY 1, 2"""
)
def positive_row_median(spark, d):
    c = long_matrix(spark, d).select(
        "row_id", F.col("col_id").alias("context"), (F.col("value") < -0.5).cast("int").alias("positive")
    )
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row_id"), F.col("l_returnflag").alias("target"), F.col("l_quantity").alias("q"))
    return rounded(A.positive_median(v, c, "row_id", ["target"], "q"), "median")


_EV = """SELECT user_id, event_type AS pset, CASE WHEN event_id % 5 = 0 THEN false ELSE true END AS tested, value > 50 AS hit FROM events"""


@query(
    f"""SELECT pset, count(*) AS nominated, count(*) FILTER (tested) AS tested, count(*) FILTER (tested AND hit) AS replicated,
        round(count(*) FILTER (tested AND hit) / nullif(count(*) FILTER (tested), 0), 9) AS rate FROM ({_EV}) GROUP BY 1"""
)
def rate_block(spark, d):
    e = table(spark, d, "events").withColumn("pset", F.col("event_type"))
    return rounded(A.rate_block(e, "pset", F.col("event_id") % 5 != 0, F.col("value") > 50), "rate", digits=9)


_VERDICT_ROWS = """SELECT user_id, count(*) FILTER (event_type = 'click') AS n_primary, count(*) FILTER (event_type = 'view') AS n_placebo,
   count(*) FILTER (event_type = 'signup' AND value > 30) AS n_independent, count(*) FILTER (event_type = 'purchase' AND value > 20) AS n_self,
   avg(value) > 48 AS p1, avg(value) FILTER (event_type = 'view') < 70 AS p2, max(value) > 180 AS p3, min(value) < 1.5 AS p4, count(*) > 40 AS p5 FROM events GROUP BY 1"""


@query(
    f"""SELECT user_id, CASE WHEN n_primary = 0 OR n_placebo = 0 OR n_independent = 0 OR n_self = 0 THEN 'NOT_EVALUABLE' WHEN NOT p5 THEN 'UNDERPOWERED'
        WHEN NOT p2 THEN 'PLACEBO_BREACH' WHEN p1 AND p3 AND p4 THEN 'CROSS_PLATFORM_REPLICATED' WHEN p1 THEN 'PARTIAL_REPLICATION' ELSE 'LOW_YIELD' END AS verdict FROM ({_VERDICT_ROWS})"""
)
def study_verdict(spark, d):
    e, t, v = table(spark, d, "events"), F.col("event_type"), F.col("value")
    g = e.groupBy("user_id").agg(
        F.count_if(t == "click").alias("n_primary"), F.count_if(t == "view").alias("n_placebo"),
        F.count_if((t == "signup") & (v > 30)).alias("n_independent"), F.count_if((t == "purchase") & (v > 20)).alias("n_self"),
        (F.avg(v) > 48).alias("p1"), (F.avg(F.when(t == "view", v)) < 70).alias("p2"), (F.max(v) > 180).alias("p3"),
        (F.min(v) < 1.5).alias("p4"), (F.count(F.lit(1)) > 40).alias("p5"),
    )
    return A.study_verdict(g).select("user_id", "verdict")


@query(
    """WITH t AS (SELECT l_suppkey % 6 AS sample, l_returnflag AS part, l_partkey AS pos, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3),
        p AS (SELECT part, pos, sum(v) FILTER (sample < 3) AS s, count(v) FILTER (sample < 3) AS n FROM t GROUP BY 1, 2),
        j AS (SELECT sample, t.part, v AS x, CASE WHEN sample < 3 THEN (s - v) / nullif(n - 1, 0) ELSE s / nullif(n, 0) END AS y FROM t JOIN p ON t.part = p.part AND t.pos = p.pos),
        k AS (SELECT * FROM j WHERE x IS NOT NULL AND y IS NOT NULL),
        r AS (SELECT sample, part, rank() OVER (PARTITION BY sample, part ORDER BY x) + (count(*) OVER (PARTITION BY sample, part, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY sample, part ORDER BY y) + (count(*) OVER (PARTITION BY sample, part, y) - 1) / 2.0 AS ry FROM k),
        c AS (SELECT sample, part, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY 1, 2),
        f AS (SELECT *, n < 100 OR rho IS NULL OR rho < 0.02 AS failed FROM c)
       SELECT sample, part, round(rho, 6) AS rho, n, failed, bool_or(failed) OVER (PARTITION BY part) AS partition_excluded,
              (SELECT count(*) FROM (SELECT part FROM f GROUP BY 1 HAVING bool_or(failed))) > 1 AS run_failed FROM f"""
)
def sample_qc(spark, d):
    t = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 6).alias("sample"), F.col("l_returnflag").alias("part"), F.col("l_partkey").alias("pos")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("v")  # cents keep ties exact
    ).withColumn("ref", F.col("sample") < 3)
    q = A.sample_qc(t, "sample", "part", "pos", "v", "ref", 0.02, 100, 1)
    return rounded(q.select("sample", "part", "rho", "n", "failed", "partition_excluded", "run_failed"), "rho")


@query(
    """WITH c AS (SELECT DISTINCT 'B' || o_custkey AS context_gene, o_orderpriority AS target FROM orders),
        u AS (SELECT DISTINCT o_orderpriority AS target FROM orders WHERE o_totalprice > 495000),
        x AS (SELECT 'B' || o_custkey AS context_gene, o_orderstatus AS kind, count(*) AS n_pos FROM orders WHERE o_totalprice > 200000 GROUP BY 1, 2),
        b AS (SELECT context_gene, kind, n_pos FROM (SELECT *, row_number() OVER (PARTITION BY context_gene ORDER BY CASE kind WHEN 'P' THEN 1 ELSE 2 END) AS rn FROM x WHERE kind IN ('P', 'F')) WHERE rn = 1),
        j AS (SELECT c.context_gene, c.target, kind, n_pos, CASE WHEN u.target IS NULL THEN 'target outside universe' WHEN kind IS NULL THEN 'no context measured'
              WHEN n_pos < 3 THEN 'below prevalence floor' END AS why FROM c LEFT JOIN u ON c.target = u.target LEFT JOIN b ON b.context_gene = c.context_gene)
       SELECT *, why IS NULL AS available FROM j"""
)
def control_set(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("context_gene"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    controls = o.select("context_gene", F.col("o_orderpriority").alias("target")).distinct()
    universe = o.where("o_totalprice > 495000").select(F.col("o_orderpriority").alias("target"))
    ctx = o.where("o_totalprice > 200000").groupBy("context_gene", F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n_pos"))
    return A.control_set(controls, universe, ctx, ["P", "F"], 3)


@query(
    """WITH g AS (SELECT p_brand, l_partkey, avg(l_discount) FILTER (l_linestatus = 'O') - 0.05 AS disc, avg(l_discount) FILTER (l_linestatus = 'F') - 0.05 AS hold
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
       SELECT p_brand, count(*) AS n, round(avg((sign(disc) = sign(hold))::INT), 6) AS sign_agreement, CASE WHEN count(*) > 3 THEN round(corr(disc, hold), 6) END AS effect_corr
       FROM g WHERE disc IS NOT NULL AND hold IS NOT NULL GROUP BY 1"""
)
def discovery_agreement(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    arm = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_discount"))) - 0.05
    g = li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand", "l_partkey").agg(arm("O").alias("disc"), arm("F").alias("hold"))
    return rounded(A.agreement(g, "disc", "hold", ["p_brand"]), "sign_agreement", "effect_corr")


@query(
    """WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS n_primary, count(*) FILTER (event_type = 'view' AND value > 40) AS n_placebo, count(*) FILTER (event_type = 'signup' AND value > 20) AS n_self,
         avg(value) > 48 AS p1_anchor, max(value) > 180 AS p1_other, avg(value) FILTER (event_type = 'view') < 60 AS p2, count(*) > 40 AS p5 FROM events GROUP BY 1)
       SELECT user_id, CASE WHEN n_primary = 0 OR n_self = 0 THEN 'NOT_EVALUABLE' WHEN NOT p5 THEN 'UNDERPOWERED' WHEN NOT p2 AND n_placebo > 0 THEN 'PLACEBO_BREACH'
              WHEN p1_anchor AND p1_other THEN 'PHARMACO_REPLICATED' WHEN p1_anchor OR p1_other THEN 'PARTIAL_TRANSFER' ELSE 'NO_TRANSFER' END AS verdict FROM e"""
)
def pharmaco_verdict(spark, d):
    e, t, v = table(spark, d, "events"), F.col("event_type"), F.col("value")
    g = e.groupBy("user_id").agg(
        F.count_if(t == "click").alias("n_primary"), F.count_if((t == "view") & (v > 40)).alias("n_placebo"), F.count_if((t == "signup") & (v > 20)).alias("n_self"),
        (F.avg(v) > 48).alias("p1_anchor"), (F.max(v) > 180).alias("p1_other"), (F.avg(F.when(t == "view", v)) < 60).alias("p2"), (F.count(F.lit(1)) > 40).alias("p5"))
    return A.study_verdict(g, "pharmaco").select("user_id", "verdict")


@query(
    """WITH e AS (SELECT c_nationkey, count(*) > 65 AS pipeline_failure, avg(c_acctbal) > 5000 AS tier_b, avg(c_acctbal) > 4600 AS tier_a, min(c_acctbal) < -950 AS opposite, max(c_acctbal) > 9900 AS direction_consistent FROM customer GROUP BY 1)
       SELECT c_nationkey, CASE WHEN pipeline_failure THEN 'PIPELINE_FAILURE' WHEN tier_a AND tier_b THEN 'TIER_B_PASS' WHEN tier_a THEN 'TIER_A_PASS' WHEN opposite THEN 'OPPOSITE'
              WHEN direction_consistent THEN 'NOT_PASSED_DIRECTION_CONSISTENT' ELSE 'NOT_PASSED' END AS verdict FROM e"""
)
def compartment_verdict(spark, d):
    b = F.col("c_acctbal")
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(
        (F.count(F.lit(1)) > 65).alias("pipeline_failure"), (F.avg(b) > 5000).alias("tier_b"), (F.avg(b) > 4600).alias("tier_a"),
        (F.min(b) < -950).alias("opposite"), (F.max(b) > 9900).alias("direction_consistent"))
    return A.compartment_verdict(g).select("c_nationkey", "verdict")


@query(
    """WITH m AS (SELECT l_returnflag, count(*) AS n, stddev_pop(l_extendedprice) AS sd, corr(l_quantity, l_extendedprice) AS r1, corr(l_discount, l_extendedprice) AS r2, corr(l_quantity, l_discount) AS r12 FROM lineitem GROUP BY 1)
       SELECT l_returnflag, 'l_quantity' AS term, round((r1 - r12 * r2) / (1 - r12 * r12) * sd, 4) AS slope, n FROM m
       UNION ALL SELECT l_returnflag, 'l_discount', round((r2 - r12 * r1) / (1 - r12 * r12) * sd, 4), n FROM m"""
)
def standardised_slopes(spark, d):
    s = A.standardised_slopes(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"])
    return rounded(s, "slope", digits=4)
