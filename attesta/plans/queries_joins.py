"""Key joins, rule programs and reachability over the star-schema tables."""

from pyspark.sql import functions as F

from attesta.operators import graph as G
from attesta.operators import joins as J
from attesta.plans.registry import registrar
from attesta.session import table

QUERIES, query = registrar()


def names(spark, d, *tables):
    return [table(spark, d, t) for t in tables]


@query("SELECT c_custkey, n_name AS nation_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def strict_map_join(spark, d):
    c, n = names(spark, d, "customer", "nation")
    m = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation_name"))
    return J.strict_map_join(c, m, "c_nationkey").select("c_custkey", "nation_name")


@query(
    """SELECT l_orderkey, l_linenumber, l_tax, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0
       WHERE l_tax IS NOT NULL"""
)
def crosswalk_join(spark, d):
    li, s = names(spark, d, "lineitem", "supplier")
    cw = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return J.crosswalk_join(li, cw, "l_suppkey", "l_tax").select("l_orderkey", "l_linenumber", "l_tax", "s_name")


@query(
    """WITH e AS (SELECT p_partkey, unnest([0, 1, 2]) AS slot, unnest([p_name, p_brand || '-' || p_size, p_type]) AS name FROM part),
        k AS (SELECT p_partkey, slot, unnest(list_distinct([upper(trim(name)), regexp_replace(upper(name), '[^A-Z0-9]', '', 'g')])) AS key FROM e),
        a AS (SELECT key, arg_min(p_partkey, p_partkey) AS id FROM k WHERE key <> '' GROUP BY 1),
        q AS (SELECT p_partkey AS qid, unnest(range(2)) AS pos, unnest(['Unheard of', p_brand || ' ' || p_size]) AS part FROM part),
        h AS (SELECT qid, arg_min(id, pos) AS id FROM q JOIN a ON regexp_replace(upper(part), '[^A-Z0-9]', '', 'g') = a.key GROUP BY 1)
       SELECT p_partkey AS qid, h.id FROM part LEFT JOIN h ON qid = p_partkey"""
)
def alias_resolver(spark, d):
    p = table(spark, d, "part")
    brand_size = lambda sep: F.concat_ws(sep, "p_brand", F.col("p_size").cast("string"))
    n = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), "p_name", brand_size("-").alias("bs"), "p_type")
    aliases = J.alias_table(n, "id", ["p_name", "bs", "p_type"], "ord")
    q = p.select(F.col("p_partkey").alias("qid"), F.concat_ws("|", F.lit("Unheard of"), brand_size(" ")).alias("names"))
    return J.resolve_aliases(q, "qid", "names", aliases, "id").select("qid", "id")


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
       AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""
)
def admitted_rows(spark, d):
    o, c = names(spark, d, "orders", "customer")
    c = c.withColumnRenamed("c_custkey", "o_custkey")
    return J.admitted(o, c.where("c_acctbal > 0"), "o_custkey", c.where("c_mktsegment = 'BUILDING'")).select("o_orderkey", "o_custkey")


_PAIRS = "SELECT l_partkey AS a, l_suppkey AS b, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2"


@query(
    f"""WITH l AS ({_PAIRS}), r AS (SELECT CASE WHEN a % 2 = 0 THEN a ELSE b END AS a, CASE WHEN a % 2 = 0 THEN b ELSE a END AS b, qty * 2 AS w FROM l WHERE a <> b),
        l2 AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM l), r2 AS (SELECT a AS ra, w, least(a, b) AS lo, greatest(a, b) AS hi FROM r)
        SELECT a, b, qty, w, a <> ra AS flipped FROM l2 JOIN r2 ON l2.lo = r2.lo AND l2.hi = r2.hi"""
)
def unordered_pair_join(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum("l_quantity").alias("qty"))
    even = F.col("a") % 2 == 0
    r = l.where("a <> b").select(
        F.when(even, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(even, F.col("b")).otherwise(F.col("a")).alias("b"),
        (F.col("qty") * 2).alias("w"),
    )
    return J.unordered_pair_join(l, r, "a", "b").select("a", "b", "qty", "w", "flipped")


@query(
    """WITH m AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS member FROM lineitem),
        p AS (SELECT DISTINCT l_partkey AS a, (l_partkey * 7 + 3) % (SELECT count(*) FROM part) AS b FROM lineitem)
       SELECT a, b, (SELECT count(*) FROM m x JOIN m y ON x.set_id = y.set_id WHERE x.member = p.a AND y.member = p.b) AS n_shared FROM p"""
)
def pairs_sharing_set(spark, d):
    li, p = names(spark, d, "lineitem", "part")
    m = li.select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("member")).distinct()
    n = p.count()
    pairs = li.select(F.col("l_partkey").alias("a")).distinct().withColumn("b", (F.col("a") * 7 + 3) % n)
    return J.pairs_sharing_set(pairs, ("a", "b"), m)


@query(
    """SELECT l_suppkey, count(DISTINCT l_returnflag || l_linestatus) AS members, min(l_returnflag || l_linestatus) AS lo, max(l_returnflag || l_linestatus) AS hi,
              (SELECT count(*) FROM (SELECT DISTINCT l_returnflag || l_linestatus AS m FROM lineitem z WHERE z.l_suppkey = lineitem.l_suppkey) x
               JOIN (SELECT DISTINCT l_returnflag || l_linestatus AS m FROM lineitem z WHERE z.l_suppkey = lineitem.l_suppkey) y ON x.m < y.m) AS n_pairs
       FROM lineitem GROUP BY 1"""
)
def group_member_spread(spark, d):
    li = table(spark, d, "lineitem").withColumn("m", F.concat("l_returnflag", "l_linestatus"))
    return J.group_member_spread(li, "l_suppkey", "m")


@query(
    """WITH g AS (SELECT l_orderkey AS guide, l_suppkey AS k, l_tax AS t FROM lineitem),
        m AS (SELECT guide FROM g GROUP BY 1 HAVING min(k) <> max(k) AND max(t) = 0),
        bad AS (SELECT DISTINCT k FROM g WHERE guide IN (SELECT guide FROM m)),
        p AS (SELECT DISTINCT s_suppkey AS k, s_nationkey::BIGINT AS partner FROM supplier)
       SELECT k, partner FROM p WHERE k <> partner AND k NOT IN (SELECT k FROM bad) AND partner NOT IN (SELECT k FROM bad)"""
)
def directed_pair_universe(spark, d):
    li, s = names(spark, d, "lineitem", "supplier")
    g = li.select(F.col("l_orderkey").alias("guide"), F.col("l_suppkey").alias("k"), F.col("l_tax").alias("t"))
    multi = g.groupBy("guide").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.max("t").alias("t")).where("a <> b AND t = 0")
    bad = g.join(multi.select("guide"), "guide", "left_semi").select("k")
    p = s.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("bigint").alias("partner"))
    return J.directed_pairs(p, p, bad, "k", "partner")


@query(
    """WITH g AS (SELECT l_orderkey * 10 + l_linenumber % 2 AS guide, l_partkey AS k, l_linenumber AS n FROM lineitem)
       SELECT DISTINCT k FROM g WHERE guide IN (SELECT guide FROM g GROUP BY 1 HAVING count(DISTINCT k) > 1 OR max(n) > 1)"""
)
def tainted_keys(spark, d):
    li = table(spark, d, "lineitem")
    g = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).alias("guide"), F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n"))
    return J.tainted_keys(g, "guide", "k", "n")


@query(
    """SELECT o_orderkey, c_custkey FROM orders JOIN customer ON substr('CUST-' || lpad(o_custkey::VARCHAR, 9, '0') || '-' || o_orderstatus, 1, 14)
              = substr('CUST-' || lpad(c_custkey::VARCHAR, 9, '0') || '-ZZ', 1, 14)"""
)
def first_block_crosswalk(spark, d):
    o, c = names(spark, d, "orders", "customer")
    key = lambda k, tail: F.concat(F.lit("CUST-"), F.lpad(F.col(k).cast("string"), 9, "0"), F.lit("-"), tail)
    left = o.select("o_orderkey", key("o_custkey", F.col("o_orderstatus")).alias("key"))
    right = c.select("c_custkey", key("c_custkey", F.lit("ZZ")).alias("key"))
    return J.first_block_crosswalk(left, right, "key", 14, "c_custkey").select("o_orderkey", "c_custkey")


@query(
    """WITH e AS (SELECT 'N' || n_nationkey AS term, 'R' || n_regionkey AS ancestor FROM nation),
        n AS (SELECT DISTINCT c_mktsegment AS grp, 'N' || c_nationkey AS term FROM customer)
       SELECT grp, term FROM n UNION SELECT grp, ancestor FROM n JOIN e ON n.term = e.term"""
)
def ancestor_key_sets(spark, d):
    c, n = names(spark, d, "customer", "nation")
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = c.select(F.col("c_mktsegment").alias("grp"), tag("N", "c_nationkey").alias("term")).distinct()
    edges = n.select(tag("N", "n_nationkey").alias("term"), tag("R", "n_regionkey").alias("ancestor"))
    return J.ancestor_sets(nodes, edges, "grp")


@query(
    """WITH a AS (SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
        b AS (SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
        j AS (SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, a.v AS va, b.v AS vb, a.l_suppkey IS NULL OR b.l_suppkey IS NULL AS miss
              FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag)
       SELECT l_returnflag, count(*) AS n, count(*) FILTER (miss) AS mismatched, count(*) FILTER (vb > va) AS up, count(*) FILTER (vb < va) AS down,
              CASE WHEN count(*) FILTER (miss) = 0 THEN round(avg(CAST(vb - va AS DOUBLE)), 4) END AS mean_delta FROM j GROUP BY 1"""
)
def exact_track_pairing(spark, d):
    li = table(spark, d, "lineitem").withColumn("v", F.col("l_extendedprice").cast("decimal(18,2)"))
    side = lambda s: li.where(F.col("l_linestatus") == s).groupBy("l_suppkey", "l_returnflag").agg(F.sum("v").alias("v"))
    p = J.exact_pairing(side("O"), side("F"), ["l_suppkey", "l_returnflag"], "v")
    s = J.delta_summary(p, ["l_returnflag"])
    return s.withColumn("mean_delta", F.round(F.col("mean_delta").cast("double"), 4))


_USER = """SELECT user_id, avg(value) AS mean_value, count(*)::DOUBLE AS n_events, max(value) AS max_value, count(*) FILTER (event_type = 'error')::DOUBLE AS n_error,
           CASE WHEN user_id % 4 = 0 THEN NULL ELSE min(value) END AS min_value FROM events GROUP BY 1"""
_UCOLS = ["mean_value", "n_events", "max_value", "n_error", "min_value"]


def user_features(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).cast("double").alias("n_events"), F.max("value").alias("max_value"),
        F.count_if(F.col("event_type") == "error").cast("double").alias("n_error"), F.min("value").alias("__min"),
    ).withColumn("min_value", F.when(F.col("user_id") % 4 != 0, F.col("__min"))).drop("__min")


@query(
    f"WITH u AS ({_USER}) " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END), 6) AS r,"
        f" count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM u"
        for a, b in J.fold_pairs(_UCOLS, _UCOLS, {"n_events": "c", "n_error": "c"})
    )
)
def screen_pair_grid(spark, d):
    """All unordered column pairs except those from the same source, as one aggregate."""
    pairs = J.fold_pairs(_UCOLS, _UCOLS, {"n_events": "c", "n_error": "c"})
    return J.pair_correlations(user_features(spark, d), pairs).withColumn("r", F.round("r", 6))


@query(
    f"WITH u AS ({_USER}), c AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) AS r,"
        f" count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM u"
        for a in _UCOLS for b in _UCOLS if a != b
    ) + """) SELECT a, b, round(r, 6) AS r, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY abs(r) DESC, b DESC) AS k FROM c
         WHERE abs(r) > 0.1 AND n >= 30) WHERE k = 1"""
)
def proxy_features(spark, d):
    pairs = J.fold_pairs(_UCOLS, _UCOLS)
    c = J.pair_correlations(user_features(spark, d), pairs)
    both = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "r", "n"))
    return J.best_proxy(both, "a", "b", "r", "n", min_r=0.1).withColumn("r", F.round("r", 6))


@query(
    """WITH p AS (SELECT l_partkey AS a, (l_partkey * 7 + 3) % (SELECT count(*) FROM part) AS b FROM lineitem GROUP BY 1),
        j AS (SELECT p.a, p.b, x.p_brand = y.p_brand AS same_brand, x.p_type = y.p_type AS same_type, x.p_size = y.p_size AS same_size
              FROM p JOIN part x ON p.a = x.p_partkey JOIN part y ON p.b = y.p_partkey)
       SELECT a, b, concat_ws('|', CASE WHEN same_brand THEN 'brand' END, CASE WHEN same_type THEN 'type' END, CASE WHEN same_size THEN 'size' END) AS classes,
              same_brand OR same_size AS known FROM j"""
)
def known_novel_annotation(spark, d):
    li, p = names(spark, d, "lineitem", "part")
    n = p.count()
    pairs = li.select(F.col("l_partkey").alias("a")).distinct().withColumn("b", (F.col("a") * 7 + 3) % n)
    attrs = ("p_brand", "p_type", "p_size")
    x = p.select(F.col("p_partkey").alias("a"), *[F.col(c).alias(f"x_{c}") for c in attrs])
    y = p.select(F.col("p_partkey").alias("b"), *[F.col(c).alias(f"y_{c}") for c in attrs])
    flags = {c[2:]: F.col(f"x_{c}") == F.col(f"y_{c}") for c in attrs}
    out = pairs.join(x, "a").join(y, "b").select("a", "b", *J.known_classes(flags, ["brand", "size"]))
    return out.withColumn("classes", F.array_join("classes", "|"))


# --- facts and rules ---------------------------------------------------------------------------


def star_facts(spark, d):
    li, p, s, n = names(spark, d, "lineitem", "part", "supplier", "nation")
    li = li.select("l_partkey", "l_suppkey", "l_returnflag")
    return G.fact_union(
        G.fact_rows(li, "supplies", ["l_suppkey", "l_partkey"], "l_returnflag"),
        G.fact_rows(p, "brand", ["p_partkey", "p_brand"], "p_type"),
        G.fact_rows(s, "located", ["s_suppkey", "s_nationkey"], "s_name"),
        G.fact_rows(n, "region", ["n_nationkey", "n_regionkey"], "n_name"),
    )


_FACTS = """facts AS (SELECT 'supplies' AS relation, l_suppkey || '|' || l_partkey AS args, min(l_returnflag) AS source FROM lineitem GROUP BY ALL
   UNION ALL SELECT 'brand', p_partkey || '|' || p_brand, p_type FROM part
   UNION ALL SELECT 'located', s_suppkey || '|' || s_nationkey, s_name FROM supplier
   UNION ALL SELECT 'region', n_nationkey || '|' || n_regionkey, n_name FROM nation)"""


@query(f"WITH {_FACTS} SELECT relation, args, source FROM facts")
def fact_store_union(spark, d):
    return star_facts(spark, d).withColumn("args", F.array_join("args", "|"))


@query(
    f"""WITH {_FACTS} SELECT relation, count(*) AS n_facts, 2 AS arity, sum(length(args))::BIGINT AS n_chars FROM facts
        WHERE relation IN ('supplies', 'located') GROUP BY 1"""
)
def relation_projection_report(spark, d):
    return G.store_report(G.project_relations(star_facts(spark, d), ["supplies", "located"]))


V = G.Var
CANDIDATE_RULES = (
    G.Rule("candidate", G.Literal("candidate", (V("brand"), V("region"))), (
        G.Literal("brand", (V("part"), V("brand"))), G.Literal("supplies", (V("supp"), V("part"))),
        G.Literal("located", (V("supp"), V("nation"))), G.Literal("region", (V("nation"), V("region"))))),
    G.Rule("in_three", G.Literal("in_three", (V("brand"),)), (G.Literal("candidate", (V("brand"), "3")),)),
)


@query(
    """SELECT DISTINCT p_brand AS brand, n_regionkey::VARCHAR AS region FROM lineitem JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
)
def rule_evaluation(spark, d):
    f = star_facts(spark, d)
    views = {r: G.relation_view(f, r, ["x", "y"]) for r in ("brand", "supplies", "located", "region")}
    out = G.evaluate(CANDIDATE_RULES, views)
    return out["candidate"].select(F.col("a0").alias("brand"), F.col("a1").alias("region"))


@query(
    """WITH sp AS (SELECT l_suppkey, l_partkey, min(l_returnflag) AS src FROM lineitem GROUP BY 1, 2),
        j AS (SELECT p_brand AS brand, n_regionkey::VARCHAR AS region, p_type, src, s_name, n_name,
              row_number() OVER (PARTITION BY p_brand, n_regionkey ORDER BY p_partkey::VARCHAR, s_suppkey::VARCHAR, n_nationkey::VARCHAR) AS k
              FROM sp JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
       SELECT brand, region, 'candidate' AS rule_id, 4 AS n_premises, least(p_type, src, s_name, n_name) AS first_source, greatest(p_type, src, s_name, n_name) AS last_source FROM j WHERE k = 1"""
)
def rule_proofs(spark, d):
    """Each candidate with its chosen derivation, walked to the sources of its premises."""
    f = star_facts(spark, d)
    views = {r: G.relation_view(f, r, ["x", "y"]) for r in ("brand", "supplies", "located", "region")}
    proofs = G.apply_rule(CANDIDATE_RULES[0], views, with_proof=True).toDF("brand", "region", "rule_id", "premises")
    return G.proof_sources(proofs, f, ["brand", "region"])


def trade_edges(spark, d):
    """Order -> customer -> nation -> region, and order -> supplier -> nation: a layered dependency graph."""
    o, c, s, n, li = names(spark, d, "orders", "customer", "supplier", "nation", "lineitem")
    e = lambda df, a, x, b, y: df.select(
        F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst")
    )
    parts = [
        e(o, "c", "o_custkey", "o", "o_orderkey"), e(li, "o", "l_orderkey", "s", "l_suppkey"), e(c, "n", "c_nationkey", "c", "c_custkey"),
        e(s, "s", "s_suppkey", "n", "s_nationkey"), e(n, "r", "n_regionkey", "n", "n_nationkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


_EDGES = """e AS (SELECT DISTINCT * FROM (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
   UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
   UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation))"""


@query(
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT dst AS node, 1 AS depth FROM e WHERE src = 'r1' UNION SELECT e.dst, depth + 1 FROM w JOIN e ON w.node = e.src WHERE depth < 9),
        m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1) SELECT 'r1' AS start, node, depth FROM m WHERE node <> 'r1'"""
)
def forward_reach_depth(spark, d):
    starts = table(spark, d, "region").where("r_regionkey = 1").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.reach(trade_edges(spark, d), starts)


@query(
    f"""WITH RECURSIVE {_EDGES}, w AS (SELECT src AS node, 1 AS depth FROM e WHERE dst = 's0' UNION SELECT e.src, depth + 1 FROM w JOIN e ON w.node = e.dst WHERE depth < 9),
        m AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1) SELECT 's0' AS start, node, depth FROM m WHERE node <> 's0'"""
)
def backward_reach_depth(spark, d):
    starts = table(spark, d, "supplier").where("s_suppkey = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return G.reach(G.reverse(trade_edges(spark, d)), starts)


@query(
    """WITH RECURSIVE b AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
              UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
        t AS (SELECT src, dst FROM b UNION SELECT t.src, b.dst FROM t JOIN b ON t.dst = b.src) SELECT src, dst FROM t"""
)
def recursive_closure(spark, d):
    """Containment closure region > nation > customer > order; depth is fixed by the hierarchy."""
    edges = trade_edges(spark, d).where(~F.col("src").rlike("^[os]"))
    rules = (
        G.Rule("base", G.Literal("within", (V("x"), V("y"))), (G.Literal("edge", (V("x"), V("y"))),)),
        G.Rule("step", G.Literal("within", (V("x"), V("z"))), (G.Literal("within", (V("x"), V("y"))), G.Literal("edge", (V("y"), V("z"))))),
    )
    out = G.evaluate(rules, {"edge": edges})["within"]
    return out.select(F.col("a0").alias("src"), F.col("a1").alias("dst"))
