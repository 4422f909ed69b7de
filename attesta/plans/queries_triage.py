"""Claim scoring, release comparison and resampling over the document and order tables."""

from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import bootstrap as B
from attesta.operators import ordered as O
from attesta.operators import resample as R
from attesta.operators import shuffles as SH
from attesta.operators import triage as T
from attesta.plans.queries_scalar import sql_either, sql_norm, sql_pieces, sql_contains_any, quoted
from attesta.plans.registry import DUCK_DRAW, registrar
from attesta.session import table

QUERIES, query = registrar()


def doc_claims(spark, d):
    """One claim per labelled document: right when its quality label is 1."""
    docs = table(spark, d, "documents", spread=True).select("doc_id", "lang", "source", "n_chars", "text")
    lab = table(spark, d, "labels")
    j = docs.join(lab, "doc_id")
    return j.select(
        "doc_id", "lang", "source", "n_chars",
        (F.col("quality") == 1).alias("is_right"),
        (F.col("toxic") == 1).alias("flag_toxic"),
        (F.col("n_chars") < 400).alias("flag_short"),
        F.col("text").contains("http").alias("flag_link"),
    )


_CLAIMS = """claims AS (SELECT d.doc_id, lang, source, n_chars, quality = 1 AS is_right, toxic = 1 AS flag_toxic,
              n_chars < 400 AS flag_short, contains(text, 'http') AS flag_link FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_RATES = """, (claims - errors) / claims AS accuracy, flagged / claims AS flag_rate, caught / nullif(errors, 0) AS recall,
   (caught / nullif(errors, 0)) / nullif(flagged / claims, 0) AS lift, caught / nullif(flagged, 0) AS precision,
   claims - flagged AS accepted, ((claims - flagged) - (errors - caught)) / nullif(claims - flagged, 0) AS accepted_accuracy"""
_RATE_COLS = ("accuracy", "flag_rate", "recall", "lift", "precision", "accepted_accuracy")


def rounded(df, cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def sql_rounded(inner, plain, cols, digits=9):
    return f"SELECT {', '.join(plain)}, {', '.join(f'round({c}, {digits}) AS {c}' for c in cols)} FROM ({inner})"


@query(
    "WITH " + _CLAIMS + ", t AS (SELECT lang, count(*) AS claims, count(*) FILTER (NOT is_right) AS errors, count(*) FILTER (flag_toxic) AS flagged,"
    " count(*) FILTER (flag_toxic AND NOT is_right) AS caught FROM claims GROUP BY 1) "
    + sql_rounded("SELECT *" + _RATES + " FROM t", ["lang", "claims", "errors", "flagged", "caught", "accepted"], _RATE_COLS)
)
def triage_tally(spark, d):
    t = T.tally(doc_claims(spark, d), F.col("is_right"), F.col("flag_toxic"), ["lang"])
    return rounded(t, _RATE_COLS)


_RULES = {
    "toxic": "flag_toxic",
    "short": "flag_short",
    "toxic or short": "flag_toxic OR flag_short",
    "toxic not short": "flag_toxic AND NOT flag_short",
    "link": "flag_link",
}


@query(
    "WITH " + _CLAIMS + ", r AS (" + " UNION ALL ".join(f"SELECT lang, is_right, '{n}' AS rule, {c} AS f FROM claims" for n, c in _RULES.items())
    + """), t AS (SELECT coalesce(lang, '(all)') AS lang, rule, count(*) AS claims, count(*) FILTER (NOT is_right) AS errors,
       count(*) FILTER (f) AS flagged, count(*) FILTER (f AND NOT is_right) AS caught FROM r GROUP BY GROUPING SETS ((lang, rule), (rule))) """
    + sql_rounded("SELECT *" + _RATES + " FROM t", ["lang", "rule", "claims", "errors", "flagged", "caught", "accepted"], _RATE_COLS)
)
def triage_tally_by_stratum(spark, d):
    rules = {n: F.expr(c) for n, c in _RULES.items()}
    return rounded(T.tally_by_rule(doc_claims(spark, d), F.col("is_right"), rules, ["lang"]), _RATE_COLS)


_ANSWERS = """SELECT o_orderkey AS item, 'x' AS field, unnest(['name', 'type']) AS system,
   unnest([CASE WHEN o_orderkey % 11 = 0 THEN 'unstated' ELSE p_name END, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END]) AS pred,
   [split_part(p_name, ' ', 1), p_type] AS truth, p_name || ' ' || o_orderpriority AS txt
   FROM orders JOIN part ON p_partkey = o_custkey"""


@query(
    f"""WITH a AS ({_ANSWERS}), n AS (SELECT *, {sql_norm('pred')} AS np, {sql_pieces('pred')} AS pp, lower(txt) AS low FROM a),
        j AS (SELECT a.*, b.pred AS peer, b.np AS npeer FROM n a LEFT JOIN n b ON a.item = b.item AND a.system <> b.system
              WHERE a.pred IS NOT NULL AND a.np NOT IN ('unstated', 'unknown', ''))
        SELECT item, system,
          len(list_filter(pp, lambda x: len(list_filter(list_transform(truth, lambda t: {sql_norm('t')}), lambda t: {sql_either('x', 't')})) > 0)) > 0 AS is_right,
          (peer IS NOT NULL AND peer <> '' AND NOT {sql_either('np', 'npeer')}) AS flag_peer,
          NOT (CASE WHEN np = 'normal' THEN {sql_contains_any('low', X.HEALTHY_IN_TEXT)}
               WHEN len(list_filter(regexp_extract_all(np, '[a-z]{{4,}}'), lambda w: w NOT IN ({quoted(X.STOP_WORDS)}))) = 0 THEN true
               ELSE len(list_filter(regexp_extract_all(np, '[a-z]{{4,}}'), lambda w: w NOT IN ({quoted(X.STOP_WORDS)})
                    AND contains(low, substr(w, 1, greatest(5, length(w) - 2))))) > 0 END) AS flag_text
        FROM j"""
)
def claims_across_systems(spark, d):
    o, p = table(spark, d, "orders", spread=True), table(spark, d, "part")
    j = o.join(p, o.o_custkey == p.p_partkey)
    word = lambda i: F.split_part(F.col("p_name"), F.lit(" "), F.lit(i))
    answer = lambda s, v: F.struct(F.lit(s).alias("system"), v.alias("pred"))
    a = j.select(
        F.col("o_orderkey").alias("item"),
        F.array(word(1), F.col("p_type")).alias("truth"),
        F.concat_ws(" ", "p_name", "o_orderpriority").alias("txt"),
        F.explode(
            F.array(
                answer("name", F.when(F.col("o_orderkey") % 11 == 0, "unstated").otherwise(F.col("p_name"))),
                answer("type", F.when(F.col("o_orderkey") % 7 != 0, word(2))),
            )
        ).alias("a"),
    ).select("item", "truth", "txt", "a.*")
    c = T.build_claims(a, ["item"], "system", "pred", "truth", "txt")
    return c.withColumnRenamed("right", "is_right")


@query(
    """WITH k AS (SELECT p_brand AS grp, list(DISTINCT p_type) AS ids FROM part WHERE p_size > 40 AND p_brand <> 'Brand#3' GROUP BY 1),
        r AS (SELECT p_partkey, p_brand AS grp, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS term, p_name AS txt FROM part),
        j AS (SELECT r.*, ids, CASE WHEN term IS NOT NULL THEN 'term call' WHEN contains(lower(txt), 'na') OR contains(lower(txt), 'none') THEN 'healthy call' END AS kind
              FROM r JOIN k ON r.grp = k.grp)
       SELECT p_partkey, kind, len(ids) AS n_key, CASE WHEN term IS NOT NULL THEN list_contains(ids, term) ELSE list_contains(ids, 'PROMO') END AS is_right
       FROM j WHERE kind IS NOT NULL""",
)
def curated_key_claims(spark, d):
    p = table(spark, d, "part")
    # Key sets hold distinct types, a vocabulary of fixed size per brand.
    keys = (
        p.where((F.col("p_size") > 40) & (F.col("p_brand") != "Brand#3"))
        .groupBy(F.col("p_brand").alias("grp"))
        .agg(F.collect_set("p_type").alias("key_ids"))
    )
    rows = p.select(
        "p_partkey", F.col("p_brand").alias("grp"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("term"), F.col("p_name").alias("txt")
    )
    healthy = X.any_contained(F.lower("txt"), ("na", "none"))
    c = T.curated_claims(rows, keys, "grp", F.col("term"), healthy, "PROMO")
    return c.select("p_partkey", "kind", F.col("n_key").cast("bigint").alias("n_key"), F.col("right").alias("is_right"))


@query(
    """WITH anc AS (SELECT 'N' || n_nationkey AS term, 'R' || n_regionkey AS ancestor FROM nation),
        c AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 4 = 0 THEN 'R' || (c_nationkey % 5) ELSE 'N' || c_nationkey END AS term,
              ['N' || (o_orderkey % 25), 'R' || (o_orderkey % 5)] AS key_ids FROM orders JOIN customer ON o_custkey = c_custkey),
        p AS (SELECT claim_id, term, unnest(key_ids) AS k FROM c),
        s AS (SELECT claim_id, max(CASE WHEN p.term = k THEN 2 WHEN EXISTS (SELECT 1 FROM anc a WHERE (a.term = p.term AND a.ancestor = k)
              OR (a.term = k AND a.ancestor = p.term)) THEN 1 ELSE 0 END) AS s FROM p GROUP BY 1)
       SELECT claim_id, CASE s WHEN 2 THEN 'agree' WHEN 1 THEN 'related' ELSE 'conflict' END AS verdict FROM s"""
)
def hierarchy_verdicts(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    node = lambda p, e: F.concat(F.lit(p), e.cast("string"))
    k = F.col("o_orderkey")
    claims = o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("claim_id"),
        F.when(k % 4 == 0, node("R", F.col("c_nationkey") % 5)).otherwise(node("N", F.col("c_nationkey"))).alias("term"),
        F.array(node("N", k % 25), node("R", k % 5)).alias("key_ids"),
    )
    anc = n.select(node("N", F.col("n_nationkey")).alias("term"), node("R", F.col("n_regionkey")).alias("ancestor"))
    return T.hierarchy_verdict(claims, "term", "key_ids", anc).select("claim_id", "verdict")


_OLD = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'Not  specified' ELSE o_orderpriority END AS label FROM orders WHERE o_orderstatus <> 'P'"
_NEW = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'None' WHEN o_orderkey % 5 = 0 THEN '2-HIGH' ELSE o_orderpriority END AS label,
          CASE WHEN o_orderkey % 3 = 0 THEN 'T' || substr(o_orderpriority, 1, 1) END AS term FROM orders WHERE o_orderstatus <> 'O'"""
_HEALTHY_REL = "(l = '' OR " + " OR ".join(f"contains(l, '{w}')" for w in X.HEALTHY_CALL_WORDS["release"]) + ")"
_CHANGES = f"""n AS (SELECT k, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS l, term FROM ({_NEW})),
  o AS (SELECT k, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS l FROM ({_OLD})),
  v AS (SELECT l, term FROM (SELECT l, term, row_number() OVER (PARTITION BY l ORDER BY count(*) DESC, min(k)) AS rn FROM n
        WHERE term IS NOT NULL AND l <> '' GROUP BY 1, 2) WHERE rn = 1),
  ot AS (SELECT o.k, CASE WHEN {_HEALTHY_REL.replace('(l ', '(o.l ').replace('(l,', '(o.l,')} THEN '__normal__' ELSE v.term END AS t FROM o LEFT JOIN v ON o.l = v.l),
  nt AS (SELECT n.k, coalesce(n.term, CASE WHEN {_HEALTHY_REL.replace('(l ', '(n.l ').replace('(l,', '(n.l,')} THEN '__normal__' ELSE v.term END) AS t FROM n LEFT JOIN v ON n.l = v.l),
  ch AS (SELECT k, ot.t AS old, nt.t AS new, ot.t <> nt.t AS changed FROM ot JOIN nt USING (k))"""


def _changes(spark, d):
    o = table(spark, d, "orders")
    k, pr = F.col("o_orderkey"), F.col("o_orderpriority")
    old = o.where("o_orderstatus <> 'P'").select(
        k.alias("k"), F.when(k % 13 == 0, "Not  specified").otherwise(pr).alias("label")
    )
    new = o.where("o_orderstatus <> 'O'").select(
        k.alias("k"),
        F.when(k % 17 == 0, "None").when(k % 5 == 0, "2-HIGH").otherwise(pr).alias("label"),
        F.when(k % 3 == 0, F.concat(F.lit("T"), F.substring(pr, 1, 1))).alias("term"),
    )
    vocab = new.where("term IS NOT NULL").withColumn("label", X.norm_simple(F.col("label"))).where("label <> ''")
    vocab = O.modal_value(vocab, ["label"], "term", "k").select("label", "term")
    return T.release_changes(old, new, "k", vocab)


@query(f"WITH {_CHANGES} SELECT k, old, new, changed FROM ch")
def release_join(spark, d):
    return _changes(spark, d)


@query(
    f"""WITH {_CHANGES} SELECT k % 4 AS grp, count(*) AS shared, count(changed) AS scored, count(*) FILTER (changed IS NULL) AS unresolved,
        count(*) FILTER (changed) AS changed, round(avg(changed::INT), 9) AS churn FROM ch GROUP BY 1"""
)
def release_churn(spark, d):
    ch = _changes(spark, d).withColumn("grp", F.col("k") % 4)
    return T.churn(ch, ["grp"]).withColumn("churn", F.round("churn", 9))


@query(
    f"""WITH {_CHANGES}, c AS (SELECT CASE WHEN old = '__normal__' THEN 'normal' ELSE 'disease' END AS "from",
        CASE WHEN new = '__normal__' THEN 'normal' ELSE 'disease' END AS "to", count(*) AS n FROM ch WHERE changed GROUP BY 1, 2)
        SELECT "from", "to", n, round(n / sum(n) OVER (), 9) AS share FROM c"""
)
def churn_directions(spark, d):
    return T.churn_directions(_changes(spark, d)).withColumn("share", F.round("share", 9))


@query(
    """WITH c AS (SELECT o_orderkey, o_orderstatus, o_custkey AS passage, o_totalprice > 250000 AS r FROM orders),
        f AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, passage ORDER BY o_orderkey) AS rn FROM c)
       SELECT o_orderstatus, count(*) AS n_rows, round(avg(r::INT), 9) AS row_accuracy, count(*) FILTER (rn = 1) AS n_distinct,
              round(avg(CASE WHEN rn = 1 THEN r::INT END), 9) AS dedup_accuracy FROM f GROUP BY 1"""
)
def accuracy_three_ways(spark, d):
    c = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_custkey").alias("passage"), (F.col("o_totalprice") > 250000).alias("r")
    )
    return rounded(T.accuracy_three_ways(c, "r", "passage", "o_orderkey", ["o_orderstatus"]), ("row_accuracy", "dedup_accuracy"))


@query(
    "WITH " + _CLAIMS + """, p AS (SELECT unnest([lang, source]) AS cls, is_right::INT AS r FROM claims),
      g AS (SELECT cls, sum(r)::BIGINT AS hits, count(*) AS n FROM p GROUP BY 1),
      w AS (SELECT cls FROM g WHERE n >= 10 ORDER BY hits / n, cls LIMIT 1)
      SELECT g.cls, hits, n, g.cls = (SELECT cls FROM w) AS is_worst, round((n - hits) / (SELECT sum(n - hits) FROM g), 9) AS error_share FROM g"""
)
def class_hit_table(spark, d):
    c = doc_claims(spark, d).withColumn("classes", F.array("lang", "source"))
    return T.class_hits(c, "is_right", "classes").withColumn("error_share", F.round("error_share", 9))


@query(
    """WITH p AS (SELECT lang, md5(text) AS h, source FROM documents), g AS (SELECT lang, h, count(*) AS n FROM p GROUP BY 1, 2),
        e AS (SELECT lang, count(DISTINCT source) AS n_entities FROM p GROUP BY 1)
       SELECT g.lang, sum(n)::BIGINT AS n_rows, count(*) AS n_passages, max(n) AS max_repeats, any_value(n_entities) AS n_entities
       FROM g JOIN e ON g.lang = e.lang GROUP BY 1"""
)
def corpus_independence(spark, d):
    return T.independence(table(spark, d, "documents", spread=True), F.col("text"), F.col("source"), ["lang"])


# Truth: parts ordered by a customer's nation at a depth; answers: two systems naming parts.
_TRUTH = "SELECT DISTINCT l_suppkey AS subject, l_partkey AS item, min(l_linenumber) OVER (PARTITION BY l_suppkey, l_partkey) AS depth FROM lineitem"
_GOT = """SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN 'sys_a' ELSE 'sys_b' END AS system, l_suppkey AS subject,
          CASE WHEN l_quantity > 45 THEN l_partkey + 1 ELSE l_partkey END AS item FROM lineitem"""


def _truth_and_answers(spark, d):
    li = table(spark, d, "lineitem")
    s, p = F.col("l_suppkey").alias("subject"), F.col("l_partkey")
    truth = li.groupBy(s, p.alias("item")).agg(F.min("l_linenumber").alias("depth"))
    got = li.select(
        F.when(F.col("l_returnflag") == "A", "sys_a").otherwise("sys_b").alias("system"), s,
        F.when(F.col("l_quantity") > 45, p + 1).otherwise(p).alias("item"),
    )
    return truth, got


@query(
    f"""WITH t AS ({_TRUTH}), g AS ({_GOT}), a AS (SELECT DISTINCT system, subject FROM g)
        SELECT a.system, depth, count(g.item) AS hits, count(*) AS total, round(count(g.item) / count(*), 9) AS recall
        FROM a JOIN t ON a.subject = t.subject LEFT JOIN g ON g.system = a.system AND g.subject = t.subject AND g.item = t.item GROUP BY 1, 2"""
)
def recall_by_depth(spark, d):
    truth, got = _truth_and_answers(spark, d)
    return T.recall_by_depth(truth, got, "subject", "item").withColumn("recall", F.round("recall", 9))


@query(
    f"""WITH t AS ({_TRUTH}), g AS ({_GOT}) SELECT system, count(*) AS false_pos FROM g
        WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.subject = g.subject AND t.item = g.item) GROUP BY 1"""
)
def false_positive_items(spark, d):
    _, got = _truth_and_answers(spark, d)
    truth = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("item"))
    return T.false_positives(truth, got, "subject", "item")


@query(
    """WITH own AS (SELECT p_partkey AS item, [p_brand, p_type, split_part(p_name, ' ', 1)] AS members FROM part),
        prop AS (SELECT CASE WHEN l_linestatus = 'O' THEN 's1' ELSE 's2' END AS system, l_partkey + CAST(round(l_tax * 100) AS BIGINT) % 2 AS item,
                 ['Brand#' || (1 + l_partkey % 25), 'ECONOMY', 'small', 'red'] AS cited FROM lineitem),
        key AS (SELECT p_partkey AS item FROM part WHERE p_size < 35),
        g AS (SELECT system, prop.item, bool_or(coalesce(len(list_intersect(cited, members)), 0) >= 2) AS g FROM prop LEFT JOIN own ON prop.item = own.item GROUP BY 1, 2),
        s AS (SELECT system, count(*) AS proposed, count(key.item) AS correct, count(*) - count(key.item) AS off_key, count(*) FILTER (g) AS grounded,
              (SELECT count(*) FROM key) AS key_size FROM g LEFT JOIN key ON g.item = key.item GROUP BY 1)
       SELECT *, key_size - correct AS missed, round(correct / proposed, 9) AS precision, round(correct / key_size, 9) AS recall,
              round(grounded / proposed, 9) AS grounding FROM s"""
)
def set_scores(spark, d):
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    own = p.select(
        F.col("p_partkey").alias("item"),
        F.array("p_brand", "p_type", F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))).alias("members"),
    )
    prop = li.select(
        F.when(F.col("l_linestatus") == "O", "s1").otherwise("s2").alias("system"),
        (F.col("l_partkey") + F.expr("CAST(round(l_tax * 100) AS BIGINT)") % 2).alias("item"),
        F.array(F.concat(F.lit("Brand#"), (1 + F.col("l_partkey") % 25).cast("string")), F.lit("ECONOMY"), F.lit("small"), F.lit("red")).alias("cited"),
    )
    key = p.where("p_size < 35").select(F.col("p_partkey").alias("item"))
    return rounded(T.set_scores(prop, key, own, "item", "cited"), ("precision", "recall", "grounding"))


@query(
    """WITH a AS (SELECT event_type, CASE WHEN value < 20 THEN 'unstated' WHEN value < 60 THEN 'low' ELSE 'high' END AS pred,
              CASE WHEN event_id % 3 = 0 THEN 'low' ELSE 'high' END AS truth, contains(props, '7') AS stated FROM events)
       SELECT event_type, count(*) FILTER (pred <> 'unstated') AS answered, count(*) FILTER (pred <> 'unstated' AND pred = truth) AS "right",
              count(*) FILTER (pred = 'unstated' AND NOT stated) AS abstain_ok, count(*) FILTER (pred = 'unstated' AND stated) AS abstain_miss
       FROM a GROUP BY 1"""
)
def abstention_scores(spark, d):
    v = F.col("value")
    pred = F.when(v < 20, "unstated").when(v < 60, "low").otherwise("high")
    truth = F.when(F.col("event_id") % 3 == 0, "low").otherwise("high")
    return T.abstention_scores(table(spark, d, "events"), pred, truth, F.col("props").contains("7"), ["event_type"])


@query(
    """WITH a AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice > 200000 END AS attr,
              CASE WHEN o_orderpriority LIKE '1%' THEN 'unknown' WHEN o_orderpriority LIKE '2%' THEN 'no' ELSE 'yes' END AS placed FROM orders)
       SELECT o_orderstatus, count(*) FILTER (attr IS NULL) AS undetermined, count(*) FILTER (attr IS NULL AND placed = 'unknown') AS as_unknown,
              count(*) FILTER (attr IS NULL AND placed = 'no') AS as_no, count(*) FILTER (attr IS NULL AND placed = 'yes') AS as_yes,
              count(*) FILTER (attr AND placed = 'yes') AS determinate_ok FROM a GROUP BY 1"""
)
def three_way_placement(spark, d):
    attr = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice") > 200000)
    pr = F.col("o_orderpriority")
    placed = F.when(pr.startswith("1"), "unknown").when(pr.startswith("2"), "no").otherwise("yes")
    return T.placement(table(spark, d, "orders"), attr, placed, ["o_orderstatus"])


@query(
    """SELECT l_partkey, min(l_linestatus) AS first_dir, max(l_linestatus) AS last_dir, count(*) AS n FROM lineitem
       GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1"""
)
def contradicted_entities(spark, d):
    return T.contradicted(table(spark, d, "lineitem"), "l_partkey", "l_linestatus")


# --- resampling -------------------------------------------------------------------------------


def sql_bootstrap(rows, by, cluster, sums, stat, reps, seed, floor_share):
    """DuckDB form of cluster_bootstrap with the same hash draws."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    on = f" AND d.{by} = i.{by}" if by else ""
    agg = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    names = ", ".join(f"sum(i.{n}) AS {n}" for n in sums)
    valid = f"CASE WHEN max(m) >= {int(reps * floor_share)} THEN" if floor_share else "CASE WHEN true THEN"
    return f"""
    WITH {rows}, per AS (SELECT {g}{cluster}, {agg} FROM src GROUP BY {g}{cluster}),
    i AS (SELECT *, row_number() OVER ({part} ORDER BY {cluster}) - 1 AS idx, count(*) OVER ({part}) AS k FROM per),
    sz AS (SELECT DISTINCT {g}k FROM i),
    d AS (SELECT {g}rep, slot, {DUCK_DRAW.format(f"'{seed}|' || rep || '|' || slot")} % k AS idx
          FROM (SELECT {g}k, unnest(range({reps})) AS rep FROM sz), LATERAL (SELECT unnest(range(k)) AS slot)),
    r AS (SELECT {('d.' + by + ', ') if by else ''}rep, {names} FROM d JOIN i ON d.idx = i.idx{on} GROUP BY ALL),
    v AS (SELECT {g}{stat} AS value FROM r),
    w AS (SELECT {g}value, row_number() OVER ({part} ORDER BY value) - 1 AS p, count(*) OVER ({part}) AS m FROM v WHERE value IS NOT NULL),
    c AS (SELECT {g}{valid} max(value) FILTER (p = floor(0.025::DOUBLE * m)) END AS lo, {valid} max(value) FILTER (p = floor(0.975::DOUBLE * m)) END AS hi,
          max(m) AS n_valid FROM w {('GROUP BY ' + by) if by else ''}),
    pt AS (SELECT {g}{stat} AS point FROM (SELECT {g}{', '.join(f'sum({n}) AS {n}' for n in sums)} FROM per {('GROUP BY ' + by) if by else ''}))
    SELECT {('pt.' + by + ', ') if by else ''}round(point, 9) AS point, round(lo, 9) AS lo, round(hi, 9) AS hi, n_valid
    FROM pt LEFT JOIN c ON {('pt.' + by + ' = c.' + by) if by else 'true'}"""


_LIFT_SQL = "(c / nullif(e, 0)) / nullif(f / n, 0)"


@query(
    sql_bootstrap(
        _CLAIMS + ", src AS (SELECT * FROM claims)", "", "source",
        {"n": "1", "e": "(NOT is_right)::INT", "f": "flag_toxic::INT", "c": "(flag_toxic AND NOT is_right)::INT"},
        _LIFT_SQL, 4000, 13, 0.25,
    )
)
def cluster_bootstrap_lift(spark, d):
    c = doc_claims(spark, d)
    wrong, flag = ~F.col("is_right"), F.col("flag_toxic")
    sums = {"n": F.lit(1), "e": wrong.cast("int"), "f": flag.cast("int"), "c": (flag & wrong).cast("int")}
    return rounded(R.cluster_bootstrap(c, "source", sums, R.lift_statistic(), reps=4000, seed=13), ("point", "lo", "hi"))


@query(
    sql_bootstrap(
        "src AS (SELECT o_orderpriority AS grp, c_nationkey, (o_totalprice > 250000)::INT AS x FROM orders JOIN customer ON o_custkey = c_custkey)",
        "grp", "c_nationkey", {"s": "x", "n": "1"}, "s / n", 4000, 29, None,
    )
)
def cluster_bootstrap_rate(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    src = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderpriority").alias("grp"), "c_nationkey", (F.col("o_totalprice") > 250000).cast("int").alias("x")
    )
    b = R.cluster_bootstrap(
        src, "c_nationkey", {"s": F.col("x"), "n": F.lit(1)}, F.expr("s / n"), ["grp"], 4000, 29, None
    )
    return rounded(b, ("point", "lo", "hi"))


_THREE = sql_bootstrap(
    "src AS (SELECT o_orderstatus AS st, o_orderpriority, (o_totalprice > 250000)::INT AS x FROM orders)", "st", "o_orderpriority", {"s": "x", "n": "1"}, "s / n", 4000, 7, None
)


@query(
    f"""WITH f AS (SELECT *, o_totalprice > 250000 AS r, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey) AS rn FROM orders),
        a AS (SELECT o_orderstatus, count(*) AS n_rows, round(avg(r::INT), 9) AS row_accuracy, count(*) FILTER (rn = 1) AS n_distinct,
              round(avg(CASE WHEN rn = 1 THEN r::INT END), 9) AS dedup_accuracy FROM f GROUP BY 1)
       SELECT a.*, lo, hi FROM a JOIN ({_THREE}) ON st = o_orderstatus"""
)
def accuracy_clustered(spark, d):
    """Row, distinct-passage and clustered accuracy per status."""
    c = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").alias("passage"), (F.col("o_totalprice") > 250000).alias("r")
    )
    return rounded(T.accuracy_three_ways(c, "r", "passage", "o_orderkey", ["o_orderstatus"], "o_orderpriority"), ("row_accuracy", "dedup_accuracy", "lo", "hi"))


@query(
    f"""WITH b AS (SELECT o_orderkey // 1000 AS blk, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1),
        i AS (SELECT *, row_number() OVER (ORDER BY blk) - 1 AS idx, count(*) OVER () AS k FROM b),
        d AS (SELECT rep, {DUCK_DRAW.format("'7|' || rep || '|' || slot")} % k AS idx FROM (SELECT k, unnest(range(2000)) AS rep FROM (SELECT max(k) AS k FROM i)), LATERAL (SELECT unnest(range(k)) AS slot)),
        v AS (SELECT rep, sum(s) / sum(n) AS v FROM d JOIN i ON d.idx = i.idx GROUP BY 1)
       SELECT round((SELECT sum(s) / sum(n) FROM b), 4) AS point, round(quantile_cont(v, 0.025), 4) AS lo, round(quantile_cont(v, 0.975), 4) AS hi, count(*) AS n_valid FROM v"""
)
def block_bootstrap_mean(spark, d):
    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("blk"), "o_totalprice")
    b = R.cluster_bootstrap(o, "blk", {"s": F.col("o_totalprice"), "n": F.lit(1)}, F.expr("s / n"), reps=2000, seed=7, linear=True)
    return rounded(b, ("point", "lo", "hi"), 4)


@query(
    f"""WITH g AS (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1),
        s AS (SELECT lang, k, n, unnest(range(4000)) AS rep FROM g),
        t AS (SELECT lang, k, n, rep, unnest(range(n)) AS slot FROM s),
        v AS (SELECT lang, rep, avg(({DUCK_DRAW.format("'5|' || rep || '|' || slot")} % n < k)::INT) AS v FROM t GROUP BY 1, 2),
        w AS (SELECT lang, v, row_number() OVER (PARTITION BY lang ORDER BY v) - 1 AS i FROM v)
       SELECT lang, round(max(v) FILTER (i = 100), 9) AS lo, round(max(v) FILTER (i = 3899), 9) AS hi FROM w GROUP BY 1"""
)
def row_bootstrap_proportion(spark, d):
    j = table(spark, d, "documents", spread=True).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    g = j.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(R.row_bootstrap_proportion(g, "k", "n", ["lang"], 4000, 5), ("lo", "hi"))


_PERM = """b AS (SELECT c_custkey AS id, c_nationkey AS s, c_mktsegment = 'BUILDING' AS lab, c_acctbal AS v FROM customer),
   own AS (SELECT id, s, row_number() OVER (PARTITION BY s ORDER BY id) AS k FROM b),
   sh AS (SELECT s, rep, lab, row_number() OVER (PARTITION BY s, rep ORDER BY md5('{seed}|' || rep || '|' || id), id) AS k
          FROM (SELECT b.*, unnest(range({reps})) AS rep FROM b)),
   perm AS (SELECT rep, own.id, sh.lab FROM sh JOIN own ON sh.s = own.s AND sh.k = own.k)"""


def _perm_rows(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("s"),
        (F.col("c_mktsegment") == "BUILDING").alias("lab"), F.col("c_acctbal").alias("v"),
    )


@query(f"WITH {_PERM.format(seed=3, reps=4)} SELECT rep, id, lab FROM perm")
def permuted_labels(spark, d):
    return R.permute_within(_perm_rows(spark, d), ["s"], "id", "lab", 3, 4).select("rep", "id", "lab")


@query(
    f"""WITH {_PERM.format(seed=3, reps=50)}, o AS (SELECT avg(v) FILTER (lab) - avg(v) FILTER (NOT lab) AS o FROM b),
        n AS (SELECT rep, avg(v) FILTER (perm.lab) - avg(v) FILTER (NOT perm.lab) AS x FROM perm JOIN b ON perm.id = b.id GROUP BY 1)
       SELECT round(max(o), 6) AS observed, (1 + count(*) FILTER (x >= o)) / 51 AS p_greater, (1 + count(*) FILTER (x <= o)) / 51 AS p_less,
              (1 + count(*) FILTER (abs(x) >= abs(o))) / 51 AS p_two_sided FROM n, o"""
)
def permutation_test(spark, d):
    t = R.permutation_test(_perm_rows(spark, d), ["s"], "id", "lab", "v", 50, 3)
    return t.withColumn("observed", F.round("observed", 6))


@query(
    f"""WITH {_CLAIMS}, i AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS idx, count(*) OVER () AS tot FROM claims),
        s AS (SELECT unnest([20, 60, 150]) AS n_draw), r AS (SELECT n_draw, unnest(range(2000)) AS rep FROM s), t AS (SELECT *, unnest(range(n_draw)) AS slot FROM r),
        d AS (SELECT n_draw, rep, {DUCK_DRAW.format("'11|' || rep || '|' || n_draw || '|' || slot")} % (SELECT max(tot) FROM i) + 1 AS idx FROM t),
        v AS (SELECT n_draw, rep, count(*) AS n, sum((NOT is_right)::INT) AS e, sum(flag_toxic::INT) AS f, sum((flag_toxic AND NOT is_right)::INT) AS c
              FROM d JOIN i ON d.idx = i.idx GROUP BY 1, 2),
        x AS (SELECT n_draw, {_LIFT_SQL} AS value FROM v),
        w AS (SELECT *, row_number() OVER (PARTITION BY n_draw ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY n_draw) AS m FROM x WHERE value IS NOT NULL)
       SELECT n_draw, round(avg(value), 9) AS mean, round(max(value) FILTER (p = floor(0.025::DOUBLE * m)), 9) AS lo,
              round(max(value) FILTER (p = floor(0.975::DOUBLE * m)), 9) AS hi, max(m) AS n_valid FROM w GROUP BY 1"""
)
def resample_at_sizes(spark, d):
    c = doc_claims(spark, d)
    wrong, flag = ~F.col("is_right"), F.col("flag_toxic")
    sums = {"n": F.lit(1), "e": wrong.cast("int"), "f": flag.cast("int"), "c": (flag & wrong).cast("int")}
    r = R.resample_at_sizes(c, "doc_id", sums, R.lift_statistic(), [20, 60, 150], 2000, 11)
    return rounded(r, ("mean", "lo", "hi"))


@query(
    """WITH b AS (SELECT p_partkey AS id, p_size < 20 AS hit, p_type = 'PROMO' AS q FROM part),
        s AS (SELECT b.*, unnest(range(20)) AS split FROM b),
        r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('9|' || split || '|' || id), id) AS pos FROM s),
        g AS (SELECT split, count(*) FILTER (hit AND q) AS hits, count(*) FILTER (q) AS held_out FROM r
              WHERE pos > CAST(floor((SELECT count(*) FROM b) * (1 - 0.3)) AS BIGINT) GROUP BY 1)
       SELECT round(avg(hits), 9) AS mean_hits, min(hits) AS min_hits, max(hits) AS max_hits, round(avg(held_out), 9) AS mean_held_out FROM g"""
)
def holdout_reach(spark, d):
    p = table(spark, d, "part")
    r = R.holdout_reach(p, "p_partkey", F.col("p_size") < 20, F.col("p_type") == "PROMO", 20, 0.3, 9)
    return rounded(r, ("mean_hits", "mean_held_out"))


# --- shuffles as keyed bijections ----------------------------------------------------------------

_KEYED = "(({0} + rep * 104729) % 2147483647)"
_MOVED = f"mv AS (SELECT *, {SH.DUCK_MOVED} AS x FROM r)"


_SHUFFLE = f"""b AS (SELECT c_custkey AS id, c_nationkey AS s, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment = 'BUILDING' END AS lab, c_acctbal AS v FROM customer)"""


@query(
    f"""WITH {_SHUFFLE}, p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY s) AS n, {DUCK_DRAW.format("'3|' || s")} AS sk FROM b WHERE lab IS NOT NULL),
        r AS (SELECT id, s, k, n, rep, {_KEYED.format('sk')} AS ky FROM (SELECT *, unnest(range(6)) AS rep FROM p)), {_MOVED}
       SELECT mv.rep, mv.id, p.lab FROM mv JOIN p ON mv.s = p.s AND mv.x = p.k"""
)
def shuffled_labels(spark, d):
    """Labels shuffled within strata among the rows that have one, by lookup."""
    rows = _perm_rows(spark, d).withColumn("lab", F.when(F.col("id") % 11 != 0, F.col("lab")))
    return SH.shuffled_labels(rows, ["s"], "id", "lab", 3, 6).select("rep", "id", "lab")


@query(
    f"""WITH {_SHUFFLE}, p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY NOT lab, id) - 1 AS k, count(*) OVER (PARTITION BY s) AS n, count(*) FILTER (lab) OVER (PARTITION BY s) AS nt, {DUCK_DRAW.format("'3|' || s")} AS sk FROM b WHERE lab IS NOT NULL),
        r AS (SELECT v, k, n, nt, rep, {_KEYED.format('sk')} AS ky FROM (SELECT *, unnest(range(499)) AS rep FROM p)), {_MOVED},
        o AS (SELECT avg(v) FILTER (lab) - avg(v) FILTER (NOT lab) AS o FROM p), nl AS (SELECT rep, avg(v) FILTER (x < nt) - avg(v) FILTER (x >= nt) AS x FROM mv GROUP BY 1)
       SELECT round(max(o), 6) AS observed, (1 + count(*) FILTER (x >= o)) / 500 AS p_greater, (1 + count(*) FILTER (x <= o)) / 500 AS p_less, (1 + count(*) FILTER (abs(x) >= abs(o))) / 500 AS p_two_sided FROM nl, o"""
)
def shuffle_test(spark, d):
    """499 shuffles within strata of a label that some rows lack."""
    rows = _perm_rows(spark, d).withColumn("lab", F.when(F.col("id") % 11 != 0, F.col("lab")))
    return SH.shuffle_test(rows, ["s"], "id", "lab", "v", 499, 3).withColumn("observed", F.round("observed", 6))


@query(
    f"""WITH b AS (SELECT p_partkey AS id, p_size < 20 AS hit, p_type = 'PROMO' AS q FROM part), p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM b),
        r AS (SELECT hit, q, k, n, rep, {_KEYED.format('9')} AS ky FROM (SELECT *, unnest(range(25)) AS rep FROM p)), {_MOVED},
        g AS (SELECT rep, count(*) FILTER (hit AND q) AS hits, count(*) FILTER (q) AS held_out FROM mv WHERE x >= floor(n * 0.7::DOUBLE) GROUP BY 1)
       SELECT round(avg(hits), 9) AS mean_hits, min(hits) AS min_hits, max(hits) AS max_hits, round(avg(held_out), 9) AS mean_held_out FROM g"""
)
def holdout_splits(spark, d):
    """25 splits that hold out three tenths of the parts."""
    p = table(spark, d, "part")
    r = SH.shuffled_holdout(p, "p_partkey", F.col("p_size") < 20, F.col("p_type") == "PROMO", 25, 0.3, 9)
    return rounded(r, ("mean_hits", "mean_held_out"))


# --- bootstraps from counts ----------------------------------------------------------------------


@query(
    f"""WITH g AS (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1),
        f AS (SELECT lang, n, x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(k / n) + (n - x) * ln(1 - k / n))) OVER (PARTITION BY lang ORDER BY x) AS below FROM (SELECT *, unnest(range(n + 1)) AS x FROM g WHERE k > 0 AND k < n)),
        u AS (SELECT lang, rep, ({DUCK_DRAW.format("'5|' || lang || '|' || rep")} + 0.5) / 4294967296.0::DOUBLE AS u FROM (SELECT lang, unnest(range(4000)) AS rep FROM g)),
        v AS (SELECT u.lang, rep, min(x / n) AS v FROM u JOIN f ON u.lang = f.lang AND f.below >= u.u GROUP BY 1, 2 UNION ALL SELECT u.lang, rep, k / n FROM u JOIN g ON u.lang = g.lang WHERE k = 0 OR k = n),
        w AS (SELECT lang, v, row_number() OVER (PARTITION BY lang ORDER BY v) - 1 AS i FROM v)
       SELECT lang, round(max(v) FILTER (i = 100), 9) AS lo, round(max(v) FILTER (i = 3900), 9) AS hi FROM w GROUP BY 1"""
)
def binomial_bootstrap(spark, d):
    """Row bootstrap of a share by one binomial number a replicate."""
    j = table(spark, d, "documents", spread=True).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    g = j.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(B.binomial_bootstrap(g, "k", "n", ["lang"], 4000, 5), ("lo", "hi"))


@query()
def customer_bootstrap(spark, d):
    """Share of large orders with customers as clusters, 4,000 replicates from counts; all customers are drawn each time."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_custkey", (F.col("o_totalprice") > 250000).cast("int").alias("x"))
    b = B.counted_bootstrap(o, "o_custkey", {"s": F.col("x"), "n": F.lit(1)}, F.expr("s / n"), ["o_orderpriority"], 4000, 29)
    return rounded(b, ("point", "lo", "hi"))
