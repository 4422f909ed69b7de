"""Correlation, screens, selection and nulls over parts, customers, events and embeddings."""

from pyspark.sql import functions as F

from attesta.operators import association as A
from attesta.operators import contacts as C
from attesta.operators import ordered as O
from attesta.operators import selection as S
from attesta.plans import studies
from attesta.plans.queries_scalar import _P
from attesta.plans.registry import DUCK_DRAW, registrar
from attesta.session import stage, table

QUERIES, query = registrar()


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def sql_rank(v, part=""):
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {v}" if part else f"PARTITION BY {v}"
    return f"(rank() OVER ({p}ORDER BY {v}) + (count(*) OVER ({q}) - 1) / 2.0)"


@query(
    f"""WITH r AS (SELECT l_returnflag, l_extendedprice AS x, l_discount AS y, {sql_rank('l_extendedprice', 'l_returnflag')} AS rx, {sql_rank('l_discount', 'l_returnflag')} AS ry FROM lineitem)
        SELECT l_returnflag, round(corr(x, y), 6) AS pearson, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1"""
)
def group_correlations(spark, d):
    return rounded(A.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_discount"), "pearson", "spearman")


# Tiles: one row per part; partition = brand, position = part key; cents keep sums and ties exact.
_TILES = """tiles AS (SELECT p_brand AS chrom, p_partkey AS pos, p_size AS z1, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS x, CAST(sum(l_quantity) AS BIGINT) AS y,
   CAST(sum(round(l_discount * 100)) AS BIGINT) AS z2 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def tiles(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    return li.join(p, li.l_partkey == p.p_partkey).groupBy(
        F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("z1")
    ).agg(cents("l_extendedprice").alias("x"), F.sum("l_quantity").cast("bigint").alias("y"), cents("l_discount").alias("z2"))


_RANKED = f"rk AS (SELECT chrom, pos, {sql_rank('x')} AS rx, {sql_rank('y')} AS ry, {sql_rank('z1')} AS r1, {sql_rank('z2')} AS r2 FROM tiles)"
_PART1 = "(({a}) - ({b}) * ({c})) / sqrt((1 - ({b}) ** 2) * (1 - ({c}) ** 2))"


def sql_pr(x, y, z, w):
    f = lambda a, b: f"corr({a}, {b})"
    xy = _PART1.format(a=f(x, y), b=f(x, z), c=f(y, z))
    xw = _PART1.format(a=f(x, w), b=f(x, z), c=f(w, z))
    yw = _PART1.format(a=f(y, w), b=f(y, z), c=f(w, z))
    return _PART1.format(a=xy, b=xw, c=yw)


@query(f"WITH {_TILES}, {_RANKED} SELECT count(*) AS n, round({sql_pr('rx', 'ry', 'r1', 'r2')}, 6) AS partial_r FROM rk")
def partial_rank_correlation(spark, d):
    return rounded(A.partial_spearman(tiles(spark, d), [], "x", "y", ["z1", "z2"]), "partial_r")


@query(
    f"""WITH {_TILES}, {_RANKED}, rg AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY chrom) AS len FROM rk),
        mv AS (SELECT chrom, rep, rx, (k + CASE WHEN len > 20 THEN dr % (len - 19) + 10 WHEN len > 2 THEN dr % (len - 1) + 1 ELSE 0 END) % len AS k
               FROM (SELECT *, {DUCK_DRAW.format("'17|' || rep || '|' || chrom")} AS dr FROM (SELECT rg.*, unnest(range(1, 2000)) AS rep FROM rg))),
        nl AS (SELECT rep, {sql_pr('mv.rx', 'rg.ry', 'rg.r1', 'rg.r2')} AS r FROM mv JOIN rg ON mv.chrom = rg.chrom AND mv.k = rg.k GROUP BY 1),
        ob AS (SELECT count(*) AS n, {sql_pr('rx', 'ry', 'r1', 'r2')} AS o FROM rg)
       SELECT max(n) AS n, round(max(o), 6) AS observed, (1 + count(*) FILTER (r <= o + 1e-12)) / 2000 AS p_neg, (1 + count(*) FILTER (r >= o - 1e-12)) / 2000 AS p_pos,
              round(avg(r), 6) AS null_mean, round(stddev_pop(r), 6) AS null_sd FROM nl, ob"""
)
def spatial_null_test(spark, d):
    t = A.spatial_null(tiles(spark, d), "chrom", ["pos"], "x", "y", ["z1", "z2"], 1999, 17)
    return rounded(t.drop("z"), "observed", "null_mean", "null_sd")


@query(
    f"""WITH r AS (SELECT c_nationkey, c_mktsegment = 'BUILDING' AS pos, c_acctbal AS v, {sql_rank('c_acctbal', 'c_nationkey')} AS rk FROM customer),
        t AS (SELECT c_nationkey, sum(n * (n * n - 1))::DOUBLE AS tie_term FROM (SELECT c_nationkey, v, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
       SELECT r.c_nationkey, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2 AS u,
              max(tie_term) AS tie_term FROM r JOIN t ON r.c_nationkey = t.c_nationkey GROUP BY 1"""
)
def mann_whitney_u(spark, d):
    c = table(spark, d, "customer").withColumn("pos", F.col("c_mktsegment") == "BUILDING")
    return A.mann_whitney(c, ["c_nationkey"], "c_acctbal", "pos").drop("p_less")


@query()
def mann_whitney_p(spark, d):
    """One-sided p per nation with its BH q (exact tails are checked against enumeration in tests)."""
    c = table(spark, d, "customer").withColumn("pos", F.col("c_mktsegment") == "BUILDING")
    mw = A.mann_whitney(c, ["c_nationkey"], "c_acctbal", "pos").select("c_nationkey", "n_pos", "n_neg", "p_less")
    return rounded(O.benjamini_hochberg(mw, "p_less"), "p_less", "q", digits=9)


@query(
    """WITH g AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS m1, var_samp(value) FILTER (event_type = 'click') AS v1, count(*) FILTER (event_type = 'click') AS n1,
              avg(value) FILTER (event_type = 'view') AS m0, var_samp(value) FILTER (event_type = 'view') AS v0, count(*) FILTER (event_type = 'view') AS n0 FROM events GROUP BY 1),
        s AS (SELECT *, v1 / n1 AS a, v0 / n0 AS b FROM g)
       SELECT user_id, round(m1 - m0, 6) AS delta, CASE WHEN n1 >= 3 AND n0 >= 3 AND v1 > 0 AND v0 > 0 THEN round((m1 - m0 + 0.5) / sqrt(a + b), 6) END AS t,
              CASE WHEN n1 >= 3 AND n0 >= 3 AND v1 > 0 AND v0 > 0 THEN round((a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n0 - 1)), 6) END AS df FROM s"""
)
def welch_threshold(spark, d):
    return rounded(studies.welch_lower(table(spark, d, "events"), ["user_id"], "value", F.col("event_type") == "click", F.col("event_type") == "view").drop("p_lower"), "delta", "t", "df")


@query()
def welch_holm_family(spark, d):
    """Lower-tail Welch p per user, Holm-adjusted over the whole family; unqualified members stay at p = 1."""
    w = studies.welch_lower(table(spark, d, "events"), ["user_id"], "value", F.col("event_type") == "click", F.col("event_type") == "view")
    return rounded(O.holm(w.select("user_id", "p_lower"), "p_lower"), "p_lower", "p_holm", digits=9)


@query(
    """WITH panel AS (SELECT DISTINCT p_brand || '-' || p_size AS symbol, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS rk FROM part WHERE p_type IN ('PROMO', 'LARGE')),
        m AS (SELECT p_brand || '-' || p_size AS symbol, l_partkey, avg(l_discount) - 0.05 AS d1, avg(l_tax) - 0.04 AS d2 FROM lineitem JOIN part ON l_partkey = p_partkey AND p_type <> 'LARGE' GROUP BY 1, 2),
        g AS (SELECT symbol, count(*) AS k, max(d1) AS d1, max(d2) AS d2 FROM m GROUP BY 1)
       SELECT panel.symbol, CASE WHEN k IS NULL THEN 'missing' WHEN k > 1 THEN 'ambiguous' WHEN d1 < 0 AND d2 < 0 THEN 'corroborated' ELSE 'not_corroborated' END AS status,
              coalesce(k = 1 AND d1 < 0 AND d2 < 0, false) AS pass FROM panel LEFT JOIN g ON panel.symbol = g.symbol"""
)
def panel_direction(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    sym = F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("symbol")
    panel = p.where("p_type IN ('PROMO', 'LARGE')").select(sym).distinct()
    m = li.join(p.where("p_type <> 'LARGE'"), li.l_partkey == p.p_partkey).groupBy(sym, "l_partkey").agg(
        (F.avg("l_discount") - 0.05).alias("d1"), (F.avg("l_tax") - 0.04).alias("d2")
    )
    return studies.panel_direction(panel, m, "symbol", [F.col("d1"), F.col("d2")])


@query(
    f"""WITH {_TILES}, c AS (SELECT chrom, x, y, CASE WHEN z1 <= 17 THEN 'low' WHEN z1 <= 34 THEN 'mid' ELSE 'high' END AS stratum FROM tiles),
        r AS (SELECT stratum, x, y, {sql_rank('x', 'stratum')} AS rx, {sql_rank('y', 'stratum')} AS ry FROM c)
       SELECT stratum, round(corr(x, y), 6) AS pearson, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1"""
)
def stratified_contrast(spark, d):
    t = tiles(spark, d).withColumn("stratum", F.when(F.col("z1") <= 17, "low").when(F.col("z1") <= 34, "mid").otherwise("high"))
    return rounded(A.spearman(t, ["stratum"], "x", "y"), "pearson", "spearman")


@query(
    f"""WITH t AS (SELECT 'S' || (l_suppkey % 3) AS sample, l_returnflag AS chrom, l_partkey AS pos, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS a, CAST(sum(l_quantity) AS BIGINT) AS b FROM lineitem GROUP BY 1, 2, 3),
        r AS (SELECT sample, chrom, a, b, {sql_rank('a', 'sample, chrom')} AS ra, {sql_rank('b', 'sample, chrom')} AS rb FROM t)
       SELECT sample, chrom, round(corr(a, b), 6) AS pearson, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY 1, 2"""
)
def method_validation(spark, d):
    """Agreement of two measurement methods per sample and partition."""
    t = table(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string")).alias("sample"), F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("pos")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("a"), F.sum("l_quantity").cast("bigint").alias("b"))
    return rounded(A.spearman(t, ["sample", "chrom"], "a", "b"), "pearson", "spearman")


@query(
    f"""WITH {_TILES}, r AS (SELECT chrom, pos, {sql_rank('x', 'chrom')} / count(*) OVER (PARTITION BY chrom) - 0.5 AS u FROM tiles),
        q AS (SELECT chrom, quantile_cont(u, 0.25) AS q1, quantile_cont(u, 0.5) AS q2, quantile_cont(u, 0.75) AS q3 FROM r GROUP BY 1)
       SELECT r.chrom, pos, round(u, 6) + 0 AS u1, round(u * u, 6) + 0 AS u2, round(u * u * u, 6) + 0 AS u3, round(greatest(u - q1, 0) ** 3, 6) AS k1,
              round(greatest(u - q2, 0) ** 3, 6) AS k2, round(greatest(u - q3, 0) ** 3, 6) AS k3 FROM r JOIN q ON r.chrom = q.chrom"""
)
def rank_spline_basis(spark, d):
    b = O.rank_spline(tiles(spark, d).select("chrom", "pos", "x"), ["chrom"], "x").drop("x")
    return rounded(b, "u1", "u2", "u3", "k1", "k2", "k3")


@query(
    f"""WITH {_TILES}, r AS (SELECT chrom, pos, x, {sql_rank('x', 'chrom')} AS rx, {sql_rank('z2', 'chrom')} AS rz FROM tiles), c AS (SELECT chrom, corr(rx, rz) AS rho, count(*) AS n FROM r GROUP BY 1)
       SELECT r.chrom, pos, round(rho, 6) AS rho, CASE WHEN n >= 10 AND abs(rho) >= 0.75 THEN CASE WHEN rho < 0 THEN -x ELSE x END END AS oriented FROM r JOIN c ON r.chrom = c.chrom"""
)
def oriented_tracks(spark, d):
    return rounded(O.orient(tiles(spark, d), ["chrom"], "x", "z2", 0.75).select("chrom", "pos", "rho", "oriented"), "rho")


@query(
    f"""WITH t AS (SELECT l_suppkey % 6 AS track, l_partkey AS pos, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2),
        r AS (SELECT pos, {sql_rank('v', 'track')} / (count(*) OVER (PARTITION BY track) + 1) AS f FROM t)
       SELECT pos, round(CASE WHEN count(*) >= 4 THEN avg(f) END, 6) AS consensus, count(*) AS n_tracks FROM r GROUP BY 1"""
)
def consensus_rank(spark, d):
    t = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 6).alias("track"), F.col("l_partkey").alias("pos")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("v"))
    return rounded(O.consensus_rank(t, "track", ["pos"], "v"), "consensus")


@query(
    """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS seg, CASE WHEN c_acctbal < -800 THEN NULL ELSE c_acctbal END AS bal, c_nationkey < 3 AS fl FROM customer),
        lv AS (SELECT coalesce(seg, 'UNKNOWN') AS lv, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 3), dr AS (SELECT lv FROM lv ORDER BY n DESC, lv DESC LIMIT 1),
        md AS (SELECT quantile_cont(bal, 0.5) AS med, count(*) - count(bal) AS miss, count(*) AS n FROM c), f AS (SELECT id, coalesce(bal, med) AS b, bal IS NULL AS imp, seg, fl FROM c, md),
        st AS (SELECT avg(b) AS mu, stddev_pop(b) AS sd FROM f),
        x AS (SELECT id, 0 AS o, 'intercept' AS term, 1.0::DOUBLE AS v FROM f UNION ALL SELECT id, 1, 'seg=' || lv, (coalesce(seg, 'UNKNOWN') = lv)::INT::DOUBLE FROM f, lv WHERE lv NOT IN (SELECT lv FROM dr)
              UNION ALL SELECT id, 2, 'bal', (b - mu) / sd FROM f, st UNION ALL SELECT id, 3, 'bal:imputed', imp::INT::DOUBLE FROM f, md WHERE miss >= 3 AND miss <= n - 3 UNION ALL SELECT id, 4, 'fl', fl::INT::DOUBLE FROM f)
       SELECT id, term, round(v, 6) AS v FROM x"""
)
def covariate_design(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 10 != 0, F.col("c_mktsegment")).alias("seg"),
        F.when(F.col("c_acctbal") >= -800, F.col("c_acctbal")).alias("bal"), (F.col("c_nationkey") < 3).alias("fl"))
    des, names = A.covariate_design(c, "id", ["seg"], ["bal"], [], ["fl"])
    return des.select("id", F.posexplode("c").alias("k", "v")).select(
        "id", F.array(*[F.lit(n) for n in names])[F.col("k")].alias("term"), F.round("v", 6).alias("v"))


def embedding_samples(spark, d):
    """x = binarised dimensions, y = dimensions, c = label indicators; every vector is one sample."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("y"))
    des, _ = A.covariate_design(e.select("vec_id", F.col("label").cast("string").alias("label")), "vec_id", ["label"])
    return e.withColumn("x", F.transform("y", lambda v: (v > 0).cast("double"))).join(des, "vec_id")


DIMS = 64

# Student's t with whole degrees of freedom has a finite series; `co` and `ce` are its coefficients for odd and even ones.
_SERIES = """cf AS (SELECT list(o ORDER BY k) AS co, list(e ORDER BY k) AS ce FROM (SELECT k, exp(sum(CASE WHEN k = 0 THEN 0 ELSE ln(2.0 * k / (2 * k + 1)) END) OVER (ORDER BY k)) AS o,
   exp(sum(CASE WHEN k = 0 THEN 0 ELSE ln((2.0 * k - 1) / (2 * k)) END) OVER (ORDER BY k)) AS e FROM range(0, 5000) x(k)))"""


def sql_t_p(t, df):
    """Two-sided p of t with whole df, in a query that has `cf`."""
    c2, th = f"({df} / ({df} + {t} * {t}))", f"atan(abs({t}) / sqrt({df}))"
    odd = f"2 / pi() * ({th} + sin({th}) * cos({th}) * coalesce(list_sum(list_transform(range(0, (({df} - 1) / 2)::BIGINT), lambda k: co[k + 1] * pow({c2}, k))), 0))"
    even = f"sin({th}) * list_sum(list_transform(range(0, ({df} / 2)::BIGINT), lambda k: ce[k + 1] * pow({c2}, k)))"
    return f"greatest(1 - CASE WHEN {df}::BIGINT % 2 = 1 THEN {odd} ELSE {even} END, 0.0)"


def sql_within(rows, keys):
    """Statistics of x and y given labels from rows (keys, label, x, y): sums of products within labels."""
    return f"""lb AS (SELECT {keys}, label, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, count(*) FILTER (x = 1) AS n1, count(*) FILTER (x = 0) AS n0 FROM {rows} GROUP BY ALL),
        sm AS (SELECT {keys}, sum(n)::BIGINT AS n, sum(n1)::BIGINT AS n_pos, sum(n0)::BIGINT AS n_neg, (sum(n) - count(*) - 1)::DOUBLE AS df, sum(xy - sx * sy / n) AS sxy, sum(xx - sx * sx / n) AS sxx, sum(yy - sy * sy / n) AS syy,
               sqrt((sum(yy) - sum(sy) * sum(sy) / sum(n)) / sum(n)) AS dep_sd FROM lb GROUP BY ALL),
        sr AS (SELECT *, sxy / sxx AS beta, sxy / sqrt(sxx * syy) AS r FROM sm),
        st AS (SELECT *, r * sqrt(df / (1 - r * r)) AS t, sqrt(greatest(syy - beta * beta * sxx, 0) / df / sxx) AS se FROM sr)"""


_DIMS = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"
_PAIRS = "pr AS (SELECT a.k AS i, b.k AS j, a.label, (a.y > 0)::INT::DOUBLE AS x, b.y FROM e a JOIN e b ON a.vec_id = b.vec_id {0})"
_ALL_PAIRS = f"""{_DIMS}, {_PAIRS.format('')}, {sql_within('pr', 'i, j')}, {_SERIES}, pv AS (SELECT st.*, {sql_t_p('t', 'df')} AS p FROM st, cf),
        qv AS (SELECT *, least(1, min(p * m / rk) OVER (ORDER BY p DESC)) AS q FROM (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk FROM pv))"""


def dims(kind):
    return [f"{kind}{i}" for i in range(DIMS)]


@query(
    f"""WITH {_ALL_PAIRS} SELECT 'x' || i AS feature, 'y' || j AS outcome, n, round(beta, 9) AS beta, round(r, 9) AS r, round(se, 9) AS se, round(p, 7) AS p, round(q, 7) AS q FROM qv"""
)
def association_all_pairs(spark, d):
    """All 64 x 64 covariate-adjusted associations with BH q over every pair."""
    a = A.associate(embedding_samples(spark, d), "x", "y", "c", dims("x"), dims("y"))
    a = O.benjamini_hochberg(a, "p")
    return rounded(rounded(a.select("feature", "outcome", "n", "beta", "r", "se", "p", "q"), "beta", "r", "se", digits=9), "p", "q", digits=7)


@query(f"WITH {_ALL_PAIRS} SELECT 'x' || i AS feature, 'y' || j AS outcome, round(beta, 9) AS beta, df, round(t, 7) AS t, round(p, 7) AS p, round(q, 7) AS q FROM qv WHERE q <= 0.05")
def association_significant(spark, d):
    """The pairs that pass BH at 0.05, with exact q, without a row for any other pair."""
    a = A.associate_significant(embedding_samples(spark, d), "x", "y", "c", dims("x"), dims("y"), 0.05)
    return rounded(rounded(a.select("feature", "outcome", "beta", "df", "t", "p", "q"), "beta", digits=9), "t", "p", "q", digits=7)


@query(
    f"""WITH {_DIMS}, {_PAIRS.format('WHERE (a.vec_id + a.k) % 3 <> 0')}, {sql_within('pr', 'i, j')}, {_SERIES}
        SELECT 'x' || i AS feature, 'y' || j AS outcome, n, df, round(beta, 9) AS beta, round(se, 9) AS se, round({sql_t_p('t', 'df')}, 7) AS p FROM st, cf"""
)
def association_with_missing(spark, d):
    """Same screen with unmeasured context cells: every column uses its own measured rows."""
    s = embedding_samples(spark, d).withColumn("x", F.transform("x", lambda v, i: F.when((F.col("vec_id") + i) % 3 != 0, v)))
    a = A.associate(s, "x", "y", "c", dims("x"), dims("y"))
    return rounded(rounded(a.select("feature", "outcome", "n", "df", "beta", "se", "p"), "beta", "se", digits=9), "p", digits=7)


@query(
    f"""WITH {_DIMS}, {_PAIRS.format('WHERE (a.vec_id + a.k) % 3 <> 0 AND (a.vec_id + b.k) % 5 <> 0')}, {sql_within('pr', 'i, j')}, {_SERIES}
        SELECT 'x' || i AS feature, 'y' || j AS outcome, n, df, round(beta, 9) AS beta, round(se, 9) AS se, round({sql_t_p('t', 'df')}, 7) AS p FROM st, cf"""
)
def association_mask_groups(spark, d):
    """Cells missing on both sides: a pair uses the rows that its two columns share, columns of one mask share sums."""
    s = embedding_samples(spark, d)
    s = s.withColumn("x", F.transform("x", lambda v, i: F.when((F.col("vec_id") + i) % 3 != 0, v))).withColumn("y", F.transform("y", lambda v, i: F.when((F.col("vec_id") + i) % 5 != 0, v)))
    a = A.associate(s, "x", "y", "c", dims("x"), dims("y"))
    return rounded(rounded(a.select("feature", "outcome", "n", "df", "beta", "se", "p"), "beta", "se", digits=9), "p", digits=7)


HELD_OUT = [(f"x{i}~y{(7 * i + 3) % DIMS}", i, (7 * i + 3) % DIMS) for i in range(DIMS)] + [(f"x{i}~y{i}", i, i) for i in range(8)]


@query(
    f"""WITH {_DIMS}, pr AS (SELECT 'x' || a.k || '~y' || b.k AS pair, 'T' || (a.vec_id % 3) AS tier, a.label, (a.y > 0)::INT::DOUBLE AS x, b.y FROM e a JOIN e b ON a.vec_id = b.vec_id AND (b.k = (7 * a.k + 3) % 64 OR b.k = a.k AND a.k < 8)),
        {sql_within('pr', 'pair, tier')}, {_SERIES}, ok AS (SELECT *, n >= 20 AND n_pos >= 5 AND n_neg >= 5 AND df >= 10 AS tested FROM st)
       SELECT pair, tier, n, n_pos, n_neg, df, round(dep_sd, 9) AS dep_sd, CASE WHEN tested THEN round(beta, 9) END AS beta, CASE WHEN tested THEN round(se, 9) END AS se, CASE WHEN tested THEN round({sql_t_p('t', 'df')}, 7) END AS p FROM ok, cf"""
)
def held_out_pairs(spark, d):
    """Listed pairs tested again in each of three tiers of held-out rows."""
    s = embedding_samples(spark, d).withColumn("tier", F.concat(F.lit("T"), (F.col("vec_id") % 3).cast("string")))
    a = A.test_pairs(s, "x", "y", "c", HELD_OUT, "tier").select("pair", "tier", "n", "n_pos", "n_neg", "df", "dep_sd", "beta", "se", "p")
    return rounded(rounded(a, "dep_sd", "beta", "se", digits=9), "p", digits=7)


@query()
def association_wide(spark, d):
    """2,560 x 2,560 pairs: thresholds of every dimension against products of dimensions; what passes BH at 0.01."""
    cuts = [(k - 19.5) / 80 for k in range(40)]
    s = embedding_samples(spark, d).select("c", "y")
    x = F.flatten(F.transform("y", lambda v: F.array(*[(v > c).cast("double") for c in cuts])))
    y = F.flatten(F.transform("y", lambda v: F.transform(F.slice("y", 1, 40), lambda u: u * v)))
    n = 40 * DIMS
    a = A.associate_significant(s, x, y, "c", [f"x{i}" for i in range(n)], [f"y{i}" for i in range(n)], 0.01)
    return rounded(a.select("feature", "outcome", "beta", "t", "q"), "beta", "t", "q")


@query()
def association_study(spark, d):
    """Discovery on even vectors, selection under caps, held-out tests on odd vectors, replication verdicts."""
    return studies.association_study(embedding_samples(spark, d), DIMS)


@query(
    "WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"
    " SELECT a.k AS a, b.k AS b, round(corr(a.v, b.v), 6) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY 1, 2"
)
def correlation_matrix(spark, d):
    e = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return rounded(A.correlation_matrix(e, "v", [f"d{i}" for i in range(DIMS)]), "r")


@query(
    """WITH RECURSIVE e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
        c AS (SELECT a.k AS a, b.k AS b, corr(a.v, b.v) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY 1, 2),
        up AS (SELECT b AS col, min(a) AS up FROM c WHERE abs(r) > 0.2 GROUP BY 1),
        f(col, cur) AS (SELECT k, k FROM (SELECT DISTINCT k FROM e) UNION ALL SELECT f.col, up.up FROM f JOIN up ON f.cur = up.col)
       SELECT col, min(cur) AS "group" FROM f GROUP BY 1"""
)
def correlation_groups(spark, d):
    from attesta.operators.aggregates import correlation_groups as groups

    e = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    corr = A.correlation_matrix(e, "v", [f"d{i}" for i in range(DIMS)])
    return groups(corr, spark.range(DIMS).select(F.col("id").alias("col")), 0.2)


@query(
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_discount * 10.1 - 0.5037 AS beta, 0.0213 + l_tax AS se, l_tax * -4.03 AS arm_beta, l_quantity / 500.3 AS arm_p, ({_P}) ** 4 AS p FROM lineitem),
        r AS (SELECT *, row_number() OVER (ORDER BY p) AS rn, count(*) OVER () AS n FROM a), q AS (SELECT *, least(1, min(p * n / rn) OVER (ORDER BY rn DESC)) AS q FROM r)
       , b AS (SELECT *, abs(beta) - 1.96 * se AS lb FROM q)
       SELECT 'context' AS study, l_orderkey, l_linenumber, round(beta, 6) AS beta, round(lb, 6) AS beta_lb, round(q, 9) AS q FROM b WHERE q <= 0.01 AND abs(beta) >= 0.30 AND lb >= 0.20
       UNION ALL SELECT 'paralog', l_orderkey, l_linenumber, round(beta, 6), round(lb, 6), round(q, 9) FROM b WHERE q <= 0.01 AND beta <= -0.30 AND lb >= 0.20 AND arm_beta <= -0.15 AND arm_p < 0.05
       UNION ALL SELECT 'drug', l_orderkey, l_linenumber, round(beta, 6), round(lb, 6), round(q, 9) FROM b WHERE q <= 0.01 AND beta <= -0.35 AND lb > 0"""
)
def screen_filter(spark, d):
    a = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 10.1 - 0.5037).alias("beta"), (F.col("l_tax") + 0.0213).alias("se"),
        (F.col("l_tax") * -4.03).alias("arm_beta"), (F.col("l_quantity") / 500.3).alias("arm_p_one_sided"), F.pow(F.expr(_P), F.lit(4)).alias("p"))
    a = stage(O.benjamini_hochberg(a, "p"), "screen")
    forms = [S.screen_filter(a, k).select(F.lit(k).alias("study"), "l_orderkey", "l_linenumber", "beta", "beta_lb", "q") for k in S.SCREEN_LIMITS]
    return rounded(rounded(forms[0].unionByName(forms[1]).unionByName(forms[2]), "beta", "beta_lb"), "q", digits=9)


@query(
    """WITH c AS (SELECT quantile_cont(o_totalprice - 100000, 0.9) AS cut FROM orders WHERE o_orderstatus <> 'P')
       SELECT o_orderkey, round(o_totalprice - 100000, 4) AS gain FROM orders, c WHERE o_orderstatus <> 'P' AND o_totalprice - 100000 > 0 AND o_totalprice - 100000 >= cut"""
)
def percentile_screen(spark, d):
    o = table(spark, d, "orders").withColumn("gain", F.col("o_totalprice") - 100000)
    return S.percentile_screen(o, "gain", F.col("o_orderstatus") != "P").select("o_orderkey", F.round("gain", 4).alias("gain"))


@query(
    """WITH RECURSIVE t AS (SELECT o_orderkey AS id, o_orderstatus AS st, (o_orderstatus = 'O')::INT AS o, o_custkey AS c, o_orderpriority AS p, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')),
        k AS (SELECT *, row_number() OVER (ORDER BY o, v DESC, id) AS rn FROM t),
        g(n, rn, id, taken) AS (SELECT 0, 0::BIGINT, NULL::BIGINT, []::STRUCT(o INT, c BIGINT, p VARCHAR)[]
          UNION ALL SELECT n + 1, nx.rn, nx.id, list_append(taken, struct_pack(o := nx.o, c := nx.c, p := nx.p)) FROM g, LATERAL (SELECT k.* FROM k WHERE k.rn > g.rn
             AND len(list_filter(g.taken, lambda x: x.o = k.o)) < 50 AND len(list_filter(g.taken, lambda x: x.c = k.c)) < 3 AND len(list_filter(g.taken, lambda x: x.p = k.p)) < 20 ORDER BY k.rn LIMIT 1) nx)
       SELECT o_orderkey, o_orderstatus, o_custkey, o_orderpriority, o_totalprice FROM orders JOIN g ON o_orderkey = g.id"""
)
def greedy_capped_selection(spark, d):
    """50 per status by price, at most 3 per customer and 20 per priority shared across statuses."""
    o = table(spark, d, "orders")
    s = S.greedy_capped(o, "o_orderkey", "o_orderstatus", {"F": 50, "O": 50}, "o_totalprice", {"o_custkey": 3, "o_orderpriority": 20})
    return s.select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority", "o_totalprice")


_SPACE = """t AS (SELECT 'chr' || (o_custkey % 5) AS chrom, o_orderkey AS id, (o_orderkey * 7919) % 1000000 AS pos, o_totalprice AS score FROM orders)"""


@query(
    f"""WITH RECURSIVE {_SPACE}, g(n, id, chrom, pos, taken) AS (
          SELECT 1, id, chrom, pos, [struct_pack(c := chrom, p := pos)] FROM (SELECT * FROM t ORDER BY score DESC, id LIMIT 1)
          UNION ALL SELECT n + 1, nx.id, nx.chrom, nx.pos, list_append(taken, struct_pack(c := nx.chrom, p := nx.pos)) FROM g, LATERAL (SELECT t.id, t.chrom, t.pos FROM t
             WHERE len(list_filter(g.taken, lambda k: k.c = t.chrom AND abs(k.p - t.pos) < 200000)) = 0 ORDER BY score DESC, id LIMIT 1) nx WHERE n < 10)
       SELECT t.id, CASE WHEN g.id IS NOT NULL THEN 'selected' WHEN EXISTS (SELECT 1 FROM g h WHERE h.chrom = t.chrom AND abs(h.pos - t.pos) < 200000) THEN 'excluded_spacing' ELSE 'beyond_maximum' END AS status,
              g.n AS candidate_rank FROM t LEFT JOIN g ON t.id = g.id"""
)
def greedy_spacing(spark, d):
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(
        F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"), k.alias("id"), (k * 7919 % 1000000).alias("pos"), (-F.col("o_totalprice")).alias("neg"))
    return S.greedy_spacing(t, "id", "chrom", "pos", ["neg"], 200_000, 10).select("id", "status", "candidate_rank")


@query(
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS rn FROM documents), s AS (SELECT unnest([25, 50, 100]) AS size)
       SELECT size, doc_id, rn FROM r JOIN s ON rn <= size"""
)
def nested_samples(spark, d):
    return S.nested_samples(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", [25, 50, 100], 42).select("size", "doc_id", "rn")


def sql_shifted(rows, by, reps, seed, offset, first=1):
    """`rg` (rows on rings) and `mv` (the ring place that each row moves to, by replicate) of rows (by, chrom, pos)."""
    part = f"{by}, chrom" if by else "chrom"
    draw = DUCK_DRAW.format(f"'{seed}|' || rep || '|' || chrom")
    return f"""rg AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY {part}) AS len FROM {rows}),
        mv AS (SELECT * EXCLUDE (k), (k + {offset}) % len AS k FROM (SELECT *, {draw} AS dr FROM (SELECT rg.*, unnest(range({first}, {reps} + 1)) AS rep FROM rg)))"""


_SCREEN_OFFSET = "CASE WHEN len > 20 THEN dr % (len - 19) + 10 WHEN len > 2 THEN dr % (len - 1) + 1 ELSE 0 END"
_FEATURES = ("x", "z2", "y")


def sql_screen(odd, seed):
    """CTEs of one half: `ob` observed and `tl` tails by pair, of partial rank correlations given z1."""
    rank = ", ".join(f"{sql_rank(c)} AS r_{c}" for c in (*_FEATURES, "z1"))
    pairs = [(a, b) for k, a in enumerate(_FEATURES) for b in _FEATURES[k + 1 :]]
    pr = lambda a, b, m, f: _PART1.format(a=f"corr({m}.r_{a}, {f}.r_{b})", b=f"corr({m}.r_{a}, {f}.r_z1)", c=f"corr({f}.r_{b}, {f}.r_z1)")
    null = " UNION ALL ".join(f"SELECT '{a}' AS predictor, '{b}' AS outcome, rep, {pr(a, b, 'mv', 'rg')} AS r FROM mv JOIN rg ON mv.chrom = rg.chrom AND mv.k = rg.k GROUP BY rep" for a, b in pairs)
    seen = " UNION ALL ".join(f"SELECT '{a}' AS predictor, '{b}' AS outcome, {pr(a, b, 'rg', 'rg')} AS o FROM rg" for a, b in pairs)
    return f"""(WITH {_TILES}, hf AS (SELECT chrom, pos, {rank} FROM tiles WHERE (CAST(substr(chrom, 7, 9) AS INT) % 2 = 1) = {odd}), {sql_shifted('hf', '', 1999, seed, _SCREEN_OFFSET)},
        nl AS ({null}), ob AS ({seen})
       SELECT nl.predictor, nl.outcome, max(o) AS o, (1 + count(*) FILTER (r <= o + 1e-12)) / 2000 AS p_neg, (1 + count(*) FILTER (r >= o - 1e-12)) / 2000 AS p_pos FROM nl JOIN ob ON nl.predictor = ob.predictor AND nl.outcome = ob.outcome GROUP BY 1, 2)"""


@query(
    f"""WITH d AS (SELECT *, abs(o) >= 0.05 AND least(p_neg, p_pos) <= 0.05 AS survived FROM {sql_screen('true', 5)}), c AS (SELECT * FROM {sql_screen('false', 6)}),
        j AS (SELECT d.predictor, d.outcome, d.o AS disc_rho, survived, CASE WHEN survived THEN c.o END AS conf_rho, CASE WHEN survived THEN CASE WHEN d.o < 0 THEN c.p_neg ELSE c.p_pos END END AS p FROM d JOIN c ON d.predictor = c.predictor AND d.outcome = c.outcome)
       SELECT predictor, outcome, round(disc_rho, 9) AS disc_rho, survived, round(conf_rho, 9) AS conf_rho, p AS p_directional,
              coalesce(sign(disc_rho) * conf_rho >= 0.05 AND p <= 0.05 / (SELECT count(*) FROM d WHERE survived), false) AS confirmed FROM j"""
)
def discovery_confirmation_screen(spark, d):
    """Tile screen: discovery on odd partitions, survivors confirmed on even ones in the discovery sign."""
    got = studies.split_screen(tiles(spark, d), "chrom", ["pos"], list(_FEATURES), ["z1"], F.substring("chrom", 7, 9).cast("int"), 1999, 5)
    return rounded(got, "disc_rho", "conf_rho", digits=9)


@query()
def sensitivity_grid(spark, d):
    """Raw, scale-free and flexible arms of one contrast, tested in one job."""
    return studies.sensitivity_grid(tiles(spark, d), "chrom", ["pos"], "x", "y", "z1", 1999, 9)


@query(
    f"""WITH {_TILES}, t AS (SELECT chrom, pos, x::DOUBLE AS x, y::DOUBLE AS y, z1 FROM tiles), s AS (SELECT chrom, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM t GROUP BY 1),
        z AS (SELECT t.*, CASE WHEN sx > 0 THEN (x - mx) / sx ELSE 0 END AS zx, CASE WHEN sy > 0 THEN (y - my) / sy ELSE 0 END AS zy FROM t JOIN s ON t.chrom = s.chrom),
        a AS (SELECT 'raw' AS arm, chrom, pos, z1, x AS a, y AS b FROM z UNION ALL SELECT 'scale_free', chrom, pos, z1, zx, zy FROM z UNION ALL SELECT 'swapped', chrom, pos, z1, y, x FROM z),
        rk AS (SELECT arm, chrom, pos, {sql_rank('a', 'arm')} AS ra, {sql_rank('b', 'arm')} AS rb, {sql_rank('z1', 'arm')} AS rz FROM a), {sql_shifted('rk', 'arm', 499, 9, _SCREEN_OFFSET)},
        nl AS (SELECT mv.arm, rep, {_PART1.format(a='corr(mv.ra, rg.rb)', b='corr(mv.ra, mv.rz)', c='corr(rg.rb, mv.rz)')} AS r FROM mv JOIN rg ON mv.arm = rg.arm AND mv.chrom = rg.chrom AND mv.k = rg.k GROUP BY ALL),
        ob AS (SELECT arm, count(*) AS n, {_PART1.format(a='corr(ra, rb)', b='corr(ra, rz)', c='corr(rb, rz)')} AS o FROM rg GROUP BY 1)
       SELECT nl.arm, max(n) AS n, round(max(o), 6) AS observed, (1 + count(*) FILTER (r <= o + 1e-12)) / 500 AS p_neg, (1 + count(*) FILTER (r >= o - 1e-12)) / 500 AS p_pos, round(avg(r), 6) AS null_mean, round(stddev_pop(r), 6) AS null_sd
       FROM nl JOIN ob ON nl.arm = ob.arm GROUP BY 1"""
)
def sensitivity_arms(spark, d):
    """Raw, scale-free and swapped arms; the base moves with the predictor."""
    got = studies.sensitivity_arms(tiles(spark, d), "chrom", ["pos"], "x", "y", "z1", 499, 9)
    return rounded(got.drop("z"), "observed", "null_mean", "null_sd")


@query()
def noise_matched_control(spark, d):
    return studies.noise_matched(tiles(spark, d), ["chrom", "pos"], "x", "y", "z2", 3, 10)


@query(
    f"""WITH {_TILES}, t AS (SELECT substr(chrom, 1, 7) AS chrom, pos, pos // 250 AS tile, x::DOUBLE AS x, y::DOUBLE AS y, z2::DOUBLE AS z FROM tiles), {sql_shifted('t', '', 200, 21, 'CASE WHEN rep > 0 THEN dr % (len - 99) + 50 ELSE 0 END', first=0)},
        j AS (SELECT mv.rep, rg.chrom, rg.tile, mv.x, rg.y, rg.z FROM mv JOIN rg ON mv.chrom = rg.chrom AND mv.k = rg.k WHERE rg.len >= 101),
        dm AS (SELECT rep, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, z - avg(z) OVER w AS dz, count(*) OVER w AS c FROM j WINDOW w AS (PARTITION BY rep, chrom, tile)),
        rk AS (SELECT rep, {sql_rank('dx', 'rep')} AS rx, {sql_rank('dy', 'rep')} AS ry, {sql_rank('dz', 'rep')} AS rz FROM dm WHERE c >= 5),
        pr AS (SELECT rep, count(*) AS n, {_PART1.format(a='corr(rx, ry)', b='corr(rx, rz)', c='corr(ry, rz)')} AS r FROM rk GROUP BY 1),
        cm AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM t GROUP BY chrom, tile HAVING count(*) >= 5), ck AS (SELECT {sql_rank('x')} AS rx, {sql_rank('y')} AS ry, {sql_rank('z')} AS rz FROM cm)
       SELECT 'fine' AS scale, max(n) FILTER (rep = 0) AS n, round(max(r) FILTER (rep = 0), 6) AS rho, round((max(r) FILTER (rep = 0) - avg(r) FILTER (rep > 0)) / stddev_pop(r) FILTER (rep > 0), 5) AS z FROM pr HAVING count(*) > 0
       UNION ALL SELECT 'coarse', count(*), round({_PART1.format(a='corr(rx, ry)', b='corr(rx, rz)', c='corr(ry, rz)')}, 6), NULL FROM ck"""
)
def fine_vs_coarse(spark, d):
    """Partial rank correlation within tiles and between tile means, with a null that shifts the raw feature."""
    t = tiles(spark, d).withColumn("chrom", F.substring("chrom", 1, 7)).withColumn("tile", F.floor(F.col("pos") / 250))
    got = studies.fine_coarse(t, "chrom", "tile", ["pos"], "x", "y", "z2", 5, 200, 21)
    return got.select("scale", "n", F.round("rho", 6).alias("rho"), F.round("z", 5).alias("z"))


# --- contacts ----------------------------------------------------------------------------------

_CONTACTS = """ct AS (SELECT l_returnflag AS chrom, least((l_partkey + 0) // 50, (l_partkey * 31 + l_suppkey * 17) % (SELECT count(*) FROM part) // 50) AS i,
   greatest(l_partkey // 50, (l_partkey * 31 + l_suppkey * 17) % (SELECT count(*) FROM part) // 50) AS j FROM lineitem)"""


def contact_pairs(spark, d):
    """1-based position pairs on three partitions, as many positions as parts."""
    n = table(spark, d, "part").count()
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("chrom"), (p + 1).alias("pos1"), ((p * 31 + s * 17) % n + 1).alias("pos2"))


@query(f"WITH {_CONTACTS} SELECT chrom, i, j, count(*)::DOUBLE AS w FROM ct GROUP BY ALL")
def contact_matrix(spark, d):
    return C.bin_pairs(contact_pairs(spark, d), ["chrom"], "pos1", "pos2", 50)


@query(
    f"""WITH {_CONTACTS}, m AS (SELECT chrom, i, j, count(*) AS w FROM ct GROUP BY ALL), f AS (SELECT chrom, i, j FROM m UNION SELECT chrom, j, i FROM m),
        k AS (SELECT chrom, i FROM f GROUP BY 1, 2 HAVING count(*) >= 10)
       SELECT f.chrom, f.i, count(*) AS nnz, true AS balanced FROM f JOIN k a ON f.chrom = a.chrom AND f.i = a.i JOIN k b ON f.chrom = b.chrom AND f.j = b.i GROUP BY 1, 2"""
)
def balanced_matrix(spark, d):
    """Whether each bin's row sum is the partition's mean to 1e-4 after balancing."""
    m = C.bin_pairs(contact_pairs(spark, d), ["chrom"], "pos1", "pos2", 50)
    b, _ = C.balance(m, ["chrom"], 10)
    g = C.mirrored(b, ["chrom"]).groupBy("chrom", "i").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("nnz"))
    mean = g.groupBy("chrom").agg(F.avg("s").alias("mean"))
    return g.join(mean, "chrom").select("chrom", "i", "nnz", (F.abs(F.col("s") / F.col("mean") - 1) < 1e-4).alias("balanced"))


@query(
    f"""WITH {_CONTACTS}, m AS (SELECT chrom, i, j, count(*)::DOUBLE AS w FROM ct GROUP BY ALL), k AS (SELECT chrom, i FROM m UNION SELECT chrom, j FROM m),
        np AS (SELECT a.chrom, b.i - a.i AS d, count(*) AS n FROM k a JOIN k b ON a.chrom = b.chrom AND b.i >= a.i GROUP BY 1, 2),
        s AS (SELECT chrom, j - i AS d, sum(w) AS t FROM m GROUP BY 1, 2), e AS (SELECT np.chrom, np.d, coalesce(t / n, 0) AS e FROM np LEFT JOIN s ON np.chrom = s.chrom AND np.d = s.d)
       SELECT m.chrom, i, j, round(w / e.e, 6) AS oe FROM m JOIN e ON m.chrom = e.chrom AND j - i = e.d WHERE e.e > 0
       UNION ALL SELECT a.chrom, a.i, b.i, 1.0 FROM k a JOIN k b ON a.chrom = b.chrom AND b.i >= a.i JOIN e ON e.chrom = a.chrom AND e.d = b.i - a.i AND e.e <= 0"""
)
def observed_over_expected(spark, d):
    m = stage(C.bin_pairs(contact_pairs(spark, d), ["chrom"], "pos1", "pos2", 50), "contacts")
    mask = m.select("chrom", "i").union(m.select("chrom", "j")).distinct()
    return rounded(C.observed_over_expected(m, stage(mask, "mask"), ["chrom"]), "oe")


@query()
def contact_compartments(spark, d):
    """Contacts to oriented leading eigenvector for every partition in one run."""
    dens = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("chrom"), F.floor(F.col("l_partkey") / 50).alias("i")).agg(F.avg("l_quantity").alias("density"))
    out = studies.contact_compartments(contact_pairs(spark, d), ["chrom"], "pos1", "pos2", 50, dens)
    return out.select("chrom", "i", F.round("pc1", 3).alias("pc1"), F.round("oriented", 3).alias("oriented"), F.round("eigen_share", 4).alias("eigen_share"))
