"""Scalar functions over whole tables (labels, identifiers, numeric rules)."""

from pyspark.sql import functions as F

from attesta.functions import numeric as N
from attesta.functions import text as X
from attesta.operators import ordered as O
from attesta.plans.registry import registrar
from attesta.session import table

QUERIES, query = registrar()


def quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_norm(e):
    t = f"regexp_replace(lower(coalesce({e}, '')), '[''\u2019]s\\b', '', 'g')"
    t = f"regexp_replace(replace(replace({t}, '''', ''), '\u2019', ''), '[-_/]', ' ', 'g')"
    t = f"trim(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' .;,\"*`')"
    return f"list_transform([{t}], lambda nl: CASE WHEN nl IN ({quoted(X.HEALTHY_LABELS)}) THEN 'normal' ELSE nl END)[1]"


def sql_contains_any(e, words):
    return "(" + " OR ".join(f"contains({e}, '{w}')" for w in words) + ")"


def sql_pieces(e):
    raw = f"string_split_regex(coalesce({e}, ''), '\\s*(?:,|;|/|\\||\\band\\b)\\s*')"
    kept = f"list_filter(list_transform({raw}, lambda r: {sql_norm('r')}), lambda q: length(q) >= 3)"
    return (
        f"CASE WHEN len({kept}) > 0 THEN {kept} WHEN {sql_norm(e)} <> '' THEN [{sql_norm(e)}] "
        "ELSE CAST([] AS VARCHAR[]) END"
    )


def sql_either(a, b):
    return f"({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})))"


@query(f"SELECT doc_id, md5({sql_norm('text')}) AS label_md5, length({sql_norm('text')}) AS label_len FROM documents")
def label_norm(spark, d):
    n = X.norm_label(F.col("text"))
    return table(spark, d, "documents", spread=True).select("doc_id", F.md5(n).alias("label_md5"), F.length(n).alias("label_len"))


@query(
    f"""WITH p AS (SELECT p_partkey, {sql_norm('p_name')} AS a, {sql_norm('p_type')} AS b,
                         {sql_norm("split_part(p_name, ' ', 2)")} AS w FROM part)
        SELECT p_partkey, {sql_either('a', 'b')} AS name_type, {sql_either('a', 'w')} AS name_word FROM p"""
)
def label_match(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        X.label_match(F.col("p_name"), F.col("p_type")).alias("name_type"),
        X.label_match(F.col("p_name"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))).alias("name_word"),
    )


@query(
    f"""SELECT conv_id, turn, len(pp) AS n_pieces, md5(array_to_string(pp, '|')) AS pieces_md5
        FROM (SELECT conv_id, turn, {sql_pieces('text')} AS pp FROM conversations)"""
)
def label_pieces(spark, d):
    p = X.label_pieces(F.col("text"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.size(p).cast("bigint").alias("n_pieces"), F.md5(F.array_join(p, "|")).alias("pieces_md5")
    )


@query(
    f"""WITH p AS (SELECT p_partkey, {sql_pieces('p_name')} AS pp,
                   [{sql_norm("'Blue Widget'")}, {sql_norm("'ring'")}, {sql_norm('p_type')}] AS tt FROM part)
        SELECT p_partkey, len(list_filter(pp, lambda x: len(list_filter(tt, lambda t: {sql_either('x', 't')})) > 0)) > 0
               AS matched FROM p"""
)
def any_match(spark, d):
    truth = F.array(F.lit("Blue Widget"), F.lit("ring"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", X.any_match(F.col("p_name"), truth).alias("matched"))


_SUPPORT = f"""
WITH s AS (SELECT doc_id, lower(text) AS low, {sql_norm("array_to_string(string_split_regex(text, '[^A-Za-z]+')[1:6], ' ')")} AS lab
           FROM documents),
     w AS (SELECT doc_id, low, lab, list_filter(regexp_extract_all(lab, '[a-z]{{4,}}'),
                  lambda x: x NOT IN ({quoted(X.STOP_WORDS)})) AS ws FROM s)
SELECT doc_id, CASE WHEN lab = 'normal' THEN {sql_contains_any('low', X.HEALTHY_IN_TEXT)}
                    WHEN len(ws) = 0 THEN true
                    ELSE len(list_filter(ws, lambda x: contains(low, substr(x, 1, greatest(5, length(x) - 2))))) > 0
               END AS supported
FROM w"""


@query(_SUPPORT)
def lexical_support(spark, d):
    pred = F.array_join(F.slice(F.split("text", "[^A-Za-z]+"), 1, 6), " ")
    return table(spark, d, "documents", spread=True).select("doc_id", X.lexical_support(pred, F.col("text")).alias("supported"))


# A small word table shaped like the curation classes.
TONES = {"rnai": ("interfer", "knock"), "loss": ("delet", "null", "tion"), "gain": ("trans", "over"), "other": ("the", "der")}


def sql_classify(e, low):
    cases = f"WHEN {e} IS NULL OR {e} = '' OR {e} IN ('unstated', 'none', 'n/a', 'not stated') THEN 'unstated' "
    cases += f"WHEN {sql_contains_any(low, TONES['rnai'])} THEN 'rnai' "
    for k, v in TONES.items():
        cases += f"WHEN {sql_contains_any(low, v)} THEN '{k}' "
    return f"CASE {cases} END"


@query(
    f"""SELECT doc_id, {sql_classify('text', 'lower(text)')} AS cls,
        array_to_string(list_filter([{', '.join(f"CASE WHEN {sql_contains_any('lower(text)', v)} THEN '{k}' END" for k, v in TONES.items())}],
        lambda x: x IS NOT NULL), '|') AS all_cls FROM documents"""
)
def synonym_class(spark, d):
    t = F.col("text")
    return table(spark, d, "documents", spread=True).select(
        "doc_id",
        X.classify(t, TONES, override="rnai").alias("cls"),
        F.array_join(X.classes_in(t, TONES), "|").alias("all_cls"),
    )


def sql_healthy(id_, e, words):
    low = f"lower(trim(coalesce({e}, '')))"
    return f"(({id_} IS NULL OR {id_} = '') AND ({low} = '' OR {sql_contains_any(low, words)}))"


@query(
    f"""SELECT conv_id, turn, {', '.join(sql_healthy("CASE WHEN role = 'system' THEN role END", 'text', w) + f' AS {k}' for k, w in X.HEALTHY_CALL_WORDS.items())}
        FROM conversations"""
)
def healthy_call(spark, d):
    rid = F.when(F.col("role") == "system", F.col("role"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", *[X.healthy_call(rid, F.col("text"), k).alias(k) for k in X.HEALTHY_CALL_WORDS]
    )


@query(
    f"""WITH p AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), '-') AS w
                  FROM benchmark)
        SELECT item_id, trim(substr(array_to_string(list_filter(w, lambda x: x NOT IN ({quoted(X.SLUG_STOP)})), '-'), 1, 34), '-') AS slug
        FROM p"""
)
def slug(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.slug(F.col("text")).alias("slug"))


@query(
    """SELECT s_suppkey, regexp_replace(s_name || ' (' || s_suppkey || ')', '\\s*\\(\\d+\\)$', '') AS symbol,
              regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS norm_key,
              'chr' || s_nationkey AS chrom,
              regexp_matches('chr' || s_nationkey, '^chr([1-9]|1[0-9]|2[0-2])$') AS autosome FROM supplier"""
)
def identifier_keys(spark, d):
    chrom = X.with_chr(F.concat(F.lit("Chr"), F.col("s_nationkey").cast("string")))
    return table(spark, d, "supplier").select(
        "s_suppkey",
        X.strip_id_suffix(F.format_string("%s (%d)", "s_name", "s_suppkey")).alias("symbol"),
        X.upper_alnum(F.col("s_name")).alias("norm_key"),
        chrom.alias("chrom"),
        X.is_autosome(chrom).alias("autosome"),
    )


_LOCUS_E = """CASE WHEN p_size % 7 = 0 THEN 'unplaced' ELSE CAST(p_size % 23 AS VARCHAR) || substr('pq', 1 + p_size % 2, 1)
              || CAST(p_partkey % 40 AS VARCHAR) || '.' || CAST(p_partkey % 3 AS VARCHAR) END"""


@query(
    f"""WITH l AS (SELECT p_partkey, {_LOCUS_E} AS loc FROM part),
        x AS (SELECT p_partkey, loc, regexp_extract(loc, '^(\\d+|X|Y)([pq])([\\d.]*)', ['c', 'a', 'b']) AS m FROM l)
        SELECT p_partkey, nullif(m.c, '') AS chrom, nullif(m.c || m.a, '') AS arm, TRY_CAST(m.b AS DOUBLE) AS band,
               coalesce(nullif(m.c, '') = '7', true) AS near_seven FROM x"""
)
def locus_parse(spark, d):
    loc = F.expr(_LOCUS_E.replace("VARCHAR", "STRING"))
    p = table(spark, d, "part").select("p_partkey", X.locus(loc).alias("l"), X.same_chromosome(loc, F.lit("7q31")).alias("near_seven"))
    return p.select("p_partkey", "l.chrom", "l.arm", "l.band", "near_seven")


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'MUT_DAM' WHEN 'N' THEN 'DEL' ELSE 'MSI_HIGH' END AS kind,
              CASE WHEN l_linestatus = 'O' AND l_tax = 0 THEN NULL WHEN l_returnflag = 'N' THEN l_tax * 10 ELSE l_quantity - 5 END AS v
              FROM lineitem)
       SELECT kind, CASE WHEN v IS NULL THEN NULL WHEN kind = 'DEL' THEN CAST(v < 0.5 AS INT)
              WHEN kind = 'MSI_HIGH' THEN CAST(v > 20 AS INT) ELSE CAST(v > 0 AS INT) END AS positive, count(*) AS n
       FROM c GROUP BY ALL"""
)
def binarised_contexts(spark, d):
    li = table(spark, d, "lineitem")
    kind = F.expr("CASE l_returnflag WHEN 'A' THEN 'MUT_DAM' WHEN 'N' THEN 'DEL' ELSE 'MSI_HIGH' END")
    v = F.expr(
        "CASE WHEN l_linestatus = 'O' AND l_tax = 0 THEN NULL WHEN l_returnflag = 'N' THEN l_tax * 10 ELSE l_quantity - 5 END"
    )
    return (
        li.select(kind.alias("kind"), N.binarise(kind, v).alias("positive"))
        .groupBy("kind", "positive")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    f"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents)
        SELECT doc_id, contains(t, 'biosample_disclosed_disease=true') AS disclosed,
          {sql_contains_any('t', ('biosample is silent', 'biosample_disclosed_disease=false'))} AS silent,
          {sql_contains_any('t', ('summary', 'title'))} AND NOT contains(t, 'biosample_disclosed_disease=true') AS from_summary,
          {sql_contains_any('t', ('unsure', 'ambiguous', 'cannot', 'unlikely', 'mixed', 'possible', 'may ', 'might'))} AS hedged
        FROM t"""
)
def reasoning_flags(spark, d):
    t = F.lower("text")
    return table(spark, d, "documents", spread=True).select("doc_id", *X.flag_columns(t, X.reasoning_features(t)))


_CRIT = """CASE WHEN o_orderstatus = 'O' THEN 'Score.' || CAST(o_orderkey % 5 + 1 AS VARCHAR) || ' (Z) < -' || CAST(o_orderkey % 4 AS VARCHAR)
           WHEN o_orderstatus = 'F' THEN 'BF > 5' ELSE o_orderpriority || ' |x| > 2 or < 1' END"""
_TYPE = "CASE WHEN o_orderkey % 3 = 0 THEN 'bagel score' WHEN o_orderkey % 3 = 1 THEN 'Log2 fold change' ELSE 'rank' END"


@query(
    f"""WITH c AS (SELECT o_orderkey, {_CRIT} AS crit, upper({_TYPE}) AS ty FROM orders)
        SELECT o_orderkey,
          CASE WHEN regexp_matches(crit, '<\\s*-?\\d') AND NOT regexp_matches(crit, '>\\s*-?\\d') THEN -1
               WHEN regexp_matches(crit, '>\\s*-?\\d') AND NOT regexp_matches(crit, '<\\s*-?\\d') THEN 1
               WHEN contains(ty, 'BAGEL') THEN 1 WHEN contains(ty, 'LOG2') THEN -1 END AS direction,
          'SCORE.' || coalesce(nullif(regexp_extract(crit, 'Score\\.(\\d+)', 1), ''), '1') AS score_col
        FROM c"""
)
def criterion_direction(spark, d):
    crit, ty = F.expr(_CRIT.replace("VARCHAR", "STRING")), F.expr(_TYPE)
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.coalesce(X.criterion_direction(crit), X.vocabulary_direction(ty, X.SCORE_TYPE_DIRECTION)).alias("direction"),
        X.criterion_score_column(crit).alias("score_col"),
    )


@query(
    """SELECT n_nationkey, 'sha256:' || sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey
              || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation"""
)
def record_digest(spark, d):
    return table(spark, d, "nation").select(
        "n_nationkey", X.canonical_digest("n_nationkey", "n_regionkey", "n_name").alias("digest")
    )


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity AS v, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS tot,
              avg(l_quantity) OVER (PARTITION BY l_returnflag) AS mu, stddev_pop(l_quantity) OVER (PARTITION BY l_returnflag) AS sd FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_returnflag, v, round(ln(1 + v), 6) AS log1p_v, round(log2(v + 0.5), 6) AS log2_v,
              round(v * 1e6 / tot, 6) AS cpm, round((v - mu) / sd, 6) AS z FROM t"""
)
def numeric_transforms(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("v"))
    stats = li.groupBy("l_returnflag").agg(
        F.sum("v").alias("tot"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")
    )
    return li.join(stats, "l_returnflag").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "v",
        F.round(F.log1p("v"), 6).alias("log1p_v"),
        F.round(F.log2(F.col("v") + 0.5), 6).alias("log2_v"),
        F.round(N.cpm(F.col("v"), F.col("tot")), 6).alias("cpm"),
        F.round((F.col("v") - F.col("mu")) / F.col("sd"), 6).alias("z"),
    )


_REP = """SELECT l_orderkey, l_linenumber, l_discount - 0.05 AS db, l_tax AS dlb, CASE WHEN l_quantity > 3 THEN l_quantity / 50 ELSE 0 END AS dsd,
          CASE WHEN l_linestatus = 'O' AND l_quantity < 10 THEN NULL ELSE l_discount - 0.03 END AS b,
          l_tax * l_quantity / 10 AS p, 0.4 AS hsd FROM lineitem"""


@query(
    f"""WITH r AS ({_REP}), s AS (SELECT *, CASE WHEN sign(b) = sign(db) THEN p / 2 ELSE 1 - p / 2 END AS p1 FROM r)
        SELECT l_orderkey, l_linenumber, CASE WHEN b IS NULL THEN NULL ELSE sign(b) = sign(db) AND p1 < 0.05
               AND abs(b) / hsd >= CASE WHEN dsd > 0 THEN 0.5 * greatest(dlb, 0) / dsd ELSE 0 END END AS rep FROM s"""
)
def replication_rule(spark, d):
    r = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_discount - 0.05 AS db", "l_tax AS dlb", "CASE WHEN l_quantity > 3 THEN l_quantity / 50 ELSE 0 END AS dsd",
        "CASE WHEN l_linestatus = 'O' AND l_quantity < 10 THEN NULL ELSE l_discount - 0.03 END AS b", "l_tax * l_quantity / 10 AS p")
    c = F.col
    return r.select("l_orderkey", "l_linenumber", N.replicated(c("db"), c("dlb"), c("dsd"), c("b"), c("p"), F.lit(0.4)).alias("rep"))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type IN ('click', 'view') END AS ctx,
              CASE WHEN event_type = 'view' AND value > 200 THEN NULL ELSE value END AS score, event_id % 2 = 0 AS flag FROM events)
       SELECT event_id, CASE WHEN ctx THEN 'sko_dep_lethal' WHEN NOT ctx THEN 'sl_gi' ELSE 'context_unknown' END AS pred,
              CASE WHEN ctx IS NULL THEN NULL WHEN ctx THEN coalesce(score <= 50, false) ELSE flag END AS ok,
              CASE WHEN ctx THEN score IS NOT NULL ELSE ctx IS NOT NULL END AS tested FROM e"""
)
def event_decision(spark, d):
    e = table(spark, d, "events")
    ctx = F.when(F.col("event_type") != "error", F.col("event_type").isin("click", "view"))
    score = F.when(~((F.col("event_type") == "view") & (F.col("value") > 200)), F.col("value"))
    r = e.select("event_id", N.decide_event(ctx, score, F.lit(50.0), F.col("event_id") % 2 == 0).alias("r"))
    return r.select("event_id", "r.pred", "r.ok", "r.tested")


@query(
    """WITH g AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS k, count(*) AS n FROM events GROUP BY 1),
        w AS (SELECT *, k / n::DOUBLE AS p, 1.959963984540054 AS z FROM g),
        x AS (SELECT *, (p + z*z/(2*n)) / (1 + z*z/n) AS c, z * sqrt(p*(1-p)/n + z*z/(4.0*n*n)) / (1 + z*z/n) AS h FROM w),
        i AS (SELECT user_id, k, n, greatest(c - h, 0) AS lo, least(c + h, 1) AS hi FROM x)
       SELECT user_id, k, n, round(lo, 6) AS lo, round(hi, 6) AS hi,
              CASE WHEN k < 10 THEN 'too few fires' WHEN lo > 0.2 THEN 'beats random' WHEN hi < 0.2 THEN 'worse than random'
                   ELSE 'undemonstrated' END AS verdict,
              CASE WHEN hi < 0.15 THEN 'a lower' WHEN 0.25 < lo THEN 'b lower' ELSE 'overlap' END AS vs_band FROM i"""
)
def wilson_verdict(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count(F.lit(1)).alias("n"))
    w = g.withColumn("w", N.wilson(F.col("k"), F.col("n")))
    lo, hi = F.col("w.lo"), F.col("w.hi")
    return w.select(
        "user_id", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"),
        N.interval_verdict(F.col("k"), lo, hi, null_value=0.2).alias("verdict"),
        N.overlap_verdict(lo, hi, F.lit(0.15), F.lit(0.25)).alias("vs_band"),
    )


_TERM = "exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))"


@query(
    f"""WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS k, count(*) AS n, count(*) FILTER (value > 60) AS a, count(*) FILTER (value < 60) AS b FROM events GROUP BY 1)
        SELECT user_id, round(least(1, list_sum(list_transform(range(k, n + 1), lambda i: {_TERM.format(n='n', p='0.2')}))), 9) AS binom_p,
               round(least(1, list_sum(list_transform(range(a, a + b + 1), lambda i: {_TERM.format(n='(a + b)', p='0.5')}))), 9) AS sign_p FROM g"""
)
def binomial_tails(spark, d):
    """Upper binomial tail and sign test per user."""
    g = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("k"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value") > 60).alias("n_pos"), F.count_if(F.col("value") < 60).alias("n_neg"),
    )
    return g.select(
        "user_id", F.round(N.binomial_upper(F.col("k").cast("double"), F.col("n").cast("double"), F.lit(0.2)), 9).alias("binom_p"),
        F.round(N.sign_test_p(F.col("n_pos"), F.col("n_neg")), 9).alias("sign_p"),
    )


@query()
def distribution_tails(spark, d):
    """Binomial, sign-test and Student-t tails per user (no SQL form; checked against exact sums in tests)."""
    e = table(spark, d, "events")
    g = e.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("k"),
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mu"),
        F.stddev_samp("value").alias("sd"),
        F.count_if(F.col("value") > 60).alias("n_pos"),
        F.count_if(F.col("value") < 60).alias("n_neg"),
    )
    t = (F.col("mu") - 60) / (F.col("sd") / F.sqrt("n"))
    return g.select(
        "user_id",
        F.round(N.binomial_upper(F.col("k").cast("double"), F.col("n").cast("double"), F.lit(0.2)), 9).alias("binom_p"),
        F.round(N.sign_test_p(F.col("n_pos"), F.col("n_neg")), 9).alias("sign_p"),
        F.round(N.student_t_p(t, (F.col("n") - 1).cast("double")), 9).alias("t_p"),
    )


# --- ordered operators ------------------------------------------------------------------------

@query(
    """SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value)
              + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rnk FROM events"""
)
def average_tie_rank(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return O.average_rank(e, ["event_type"], "value", "rnk").select("event_id", "rnk")


@query(
    """WITH r AS (SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value)
              + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
       SELECT event_id, round(CASE WHEN event_type IN ('click', 'view') THEN r / n ELSE (n + 1 - r) / n END, 9) AS frac FROM r"""
)
def rank_fraction(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    direction = F.when(F.col("event_type").isin("click", "view"), -1).otherwise(1)
    return O.rank_fraction(e, ["event_type"], "value", direction).select("event_id", F.round("frac", 9).alias("frac"))


@query(
    """SELECT c_custkey, round(coalesce((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0), 0), 6) AS z
       FROM customer WINDOW w AS (PARTITION BY c_nationkey)"""
)
def partition_zscore(spark, d):
    return O.partition_zscore(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal").select(
        "c_custkey", F.round("z", 6).alias("z")
    )


@query(
    """WITH v AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)
       SELECT event_id, round(CASE WHEN count(v) OVER w >= 9 THEN v - avg(v) OVER w END, 6) AS resid FROM v
       WINDOW w AS (PARTITION BY user_id, event_type)"""
)
def tile_demean(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return O.demean(e, ["user_id", "event_type"], "v", 9).select("event_id", F.round("resid", 6).alias("resid"))


_P = "((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 31) % 1000003 / 1000003e0)"


@query(
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_P} * {_P} * {_P} AS p FROM lineitem),
        r AS (SELECT *, row_number() OVER (ORDER BY p) AS rn, count(*) OVER () AS n FROM p),
        q AS (SELECT *, least(1, min(p * n / rn) OVER (ORDER BY rn DESC)) AS q FROM r)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(q, 9) AS q FROM q"""
)
def bh_all_pairs(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(f"{_P} * {_P} * {_P}").alias("p")
    )
    return O.benjamini_hochberg(li, "p").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("q", 9).alias("q")
    )


@query(
    """WITH p AS (SELECT c_custkey, c_mktsegment, least(1.0, abs(c_acctbal) / 1e6) AS p FROM customer),
        r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY p, c_custkey) - 1 AS s,
              count(*) OVER (PARTITION BY c_mktsegment) AS m FROM p)
       SELECT c_custkey, round(max(least(1, (m - s) * p)) OVER (PARTITION BY c_mktsegment ORDER BY s), 9) AS p_holm FROM r"""
)
def holm_by_family(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", F.least(F.lit(1.0), F.abs("c_acctbal") / 1e6).alias("p")
    )
    return O.holm(c, "p", ["c_mktsegment"]).select("c_custkey", F.round("p_holm", 9).alias("p_holm"))


@query(
    """WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos,
              count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
       SELECT a.o_orderkey, b.o_totalprice AS shifted FROM r a JOIN r b ON a.o_orderpriority = b.o_orderpriority AND a.pos = (b.pos + 37) % b.n"""
)
def circular_shift(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    s = O.circular_shift(o, ["o_orderpriority"], ["o_orderkey"], "o_totalprice", F.lit(37), "shifted")
    return s.select("o_orderkey", "shifted")


@query(
    """WITH t AS (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) AS x, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
        s AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, x) - 1) / 2.0 AS r FROM t),
        n AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag) AS m FROM s), h AS (SELECT *, (r - 0.5) / m * (m - 1) AS h FROM n),
        u AS (SELECT l_returnflag, y, row_number() OVER (PARTITION BY l_returnflag ORDER BY y) - 1 AS k FROM t)
       SELECT h.l_returnflag, l_suppkey, round(max(a.y) + (max(b.y) - max(a.y)) * (max(h) - floor(max(h))), 6) AS mapped FROM h
       JOIN u a ON h.l_returnflag = a.l_returnflag AND a.k = CAST(floor(h) AS BIGINT) JOIN u b ON h.l_returnflag = b.l_returnflag AND b.k = CAST(ceil(h) AS BIGINT) GROUP BY ALL"""
)
def quantile_mapped_track(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        N.exact_mean(F.col("l_extendedprice")).alias("x"), N.exact_mean(F.col("l_quantity")).alias("y")
    )
    return O.quantile_map(t, ["l_returnflag"], "x", "y").select("l_returnflag", "l_suppkey", F.round("mapped", 6).alias("mapped"))


@query(
    """WITH g AS (SELECT l_shipmode_key AS k, sum(v) AS s, count(v) AS n FROM
              (SELECT l_suppkey % 10 AS l_shipmode_key, l_extendedprice AS v FROM lineitem) GROUP BY 1)
       SELECT k, round(((SELECT sum(s) FROM g) - s) / ((SELECT sum(n) FROM g) - n), 4) AS loo_mean FROM g"""
)
def leave_group_out(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("k"), F.col("l_extendedprice").alias("v"))
    return O.leave_group_out_mean(li, "k", "v").select("k", F.round("loo_mean", 4).alias("loo_mean"))


@query(
    """SELECT lang, quantile_cont(n_chars, 0.05) AS q05, quantile_cont(n_chars, 0.5) AS q50, quantile_cont(n_chars, 0.9) AS q90,
              count(*) AS n FROM documents GROUP BY 1"""
)
def exact_quantiles(spark, d):
    return O.quantiles(table(spark, d, "documents", spread=True), ["lang"], "n_chars", {"q05": 0.05, "q50": 0.5, "q90": 0.9}, "n")


@query(
    """SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn
       FROM customer) WHERE rn <= 3"""
)
def top_k_per_group(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return O.top_k(c, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)


@query(
    """WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2)
       SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1"""
)
def modal_mapping(spark, d):
    return O.modal_value(table(spark, d, "part"), ["p_brand"], "p_type", "p_partkey")
