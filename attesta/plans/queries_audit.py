"""Integrity checks over documents, pages, events and orders."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import audit as Q
from attesta.operators import resample as R
from attesta.plans.registry import registrar
from attesta.session import table
from attesta.streaming import journal as J

QUERIES, query = registrar()


@query(
    """WITH d AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
       SELECT l_orderkey, l_linenumber, 'quantity_range' AS rule FROM lineitem WHERE NOT (l_quantity >= 2 AND l_quantity <= 49)
       UNION ALL SELECT l_orderkey, l_linenumber, 'discount_known' FROM lineitem WHERE NOT coalesce(l_discount < 0.1, false)
       UNION ALL SELECT l_orderkey, l_linenumber, 'unique' FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)"""
)
def contract_violations(spark, d):
    rules = {"quantity_range": F.col("l_quantity").between(2, 49), "discount_known": F.col("l_discount") < 0.1}
    return Q.violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], rules, ["l_orderkey", "l_linenumber"])


@query(
    """SELECT user_id, quantile_cont(value, 0.5) FILTER (event_type = 'view') AS median_lower, quantile_cont(value, 0.5) FILTER (event_type = 'error') AS median_higher,
              quantile_cont(value, 0.5) FILTER (event_type = 'view') + 2 < quantile_cont(value, 0.5) FILTER (event_type = 'error') AS sane FROM events GROUP BY 1"""
)
def direction_sanity(spark, d):
    t = F.col("event_type")
    return Q.direction_sane(table(spark, d, "events"), "value", t == "view", t == "error", 2.0, ["user_id"])


@query(
    """SELECT page_id, concat_ws('|', CASE WHEN length(html) > 0 THEN 'not_empty' END, CASE WHEN NOT (starts_with(lower(ltrim(html)), '<!doctype html') OR starts_with(lower(ltrim(html)), '<html')) THEN 'not_html' END,
         CASE WHEN NOT (starts_with(lower(ltrim(html)), '{') AND contains(lower(ltrim(html)), '"error"')) THEN 'not_json_error' END,
         CASE WHEN regexp_matches(split_part(html, chr(10), 1), 'charset') THEN 'first_line' END, CASE WHEN contains(html, '<h1>') AND contains(html, '</article>') THEN 'required' END,
         CASE WHEN strlen(html) >= 2000 THEN 'min_bytes' END) AS passed, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages"""
)
def content_checks(spark, d):
    c = Q.content_checks(table(spark, d, "pages"), "page_id", F.col("html"), "charset", ["<h1>", "</article>"], 2000)
    return c.withColumn("passed", F.array_join("passed", "|"))


@query(
    """WITH e AS (SELECT url || '#' || page_id AS path, sha256(html) AS h FROM pages WHERE length(html) > 1500),
        a AS (SELECT url || '#' || page_id AS path, sha256(replace(html, '<h1>Is', '<h1>is')) AS h FROM pages WHERE contains(html, '<nav>'))
       SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'added' WHEN e.h <> a.h THEN 'changed' ELSE 'ok' END AS status
       FROM e FULL JOIN a ON e.path = a.path"""
)
def manifest_diff(spark, d):
    p = table(spark, d, "pages").withColumn("path", F.concat_ws("#", "url", F.col("page_id").cast("string")))
    expected = p.where(F.length("html") > 1500).select("path", F.sha2("html", 256).alias("sha256"))
    changed = F.replace(F.col("html"), F.lit("<h1>Is"), F.lit("<h1>is"))
    actual = p.where(F.col("html").contains("<nav>")).select("path", F.sha2(changed, 256).alias("sha256"))
    return Q.manifest_diff(expected, actual)


@query(
    """WITH p AS (SELECT url || '#' || page_id AS path, sha256(html) AS h FROM pages), b AS (SELECT CAST('0x' || substr(md5(path), 1, 8) AS BIGINT) % 4096 AS b, sha256(string_agg(path || chr(9) || h, chr(10) ORDER BY path || chr(9) || h)) AS h FROM p GROUP BY 1)
       SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM b"""
)
def manifest_digest(spark, d):
    p = table(spark, d, "pages").select(F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("sha256"))
    return Q.bucketed_digest(p)


@query("SELECT sha256(string_agg(url || '#' || page_id || chr(0) || sha256(html), chr(10) ORDER BY url || '#' || page_id || chr(0) || sha256(html))) AS digest, count(*) AS files FROM pages")
def release_digest(spark, d):
    p = table(spark, d, "pages").select(F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("sha256"))
    return Q.top_digest(p)


# Journal: events of one user in id order; the digest covers the own fields, broken for some values.
_JOURNAL = """j AS (SELECT *, lag(h) OVER w AS ph, lag(ts) OVER w AS pt, row_number() OVER w AS seq FROM (SELECT *, md5(event_id || '|' || event_type) AS h FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def journal(spark, d):
    from attesta.operators.ordered import lagged, numbered

    e = table(spark, d, "events").withColumn("h", F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "event_type")))
    e = lagged(e, ["user_id"], ["event_id"], ["h"])
    e = numbered(e, ["user_id"], ["event_id"], "seq")
    # Damage: a forged digest, a forged link, a clock running backwards.
    return e.select(
        "user_id", "seq", "event_id", "event_type", "value",
        F.when(F.col("value") > 300, F.md5("h")).otherwise(F.col("h")).alias("digest"),
        F.when(F.col("value") < 0.3, F.lit("forged")).otherwise(F.col("prev_h")).alias("prev"),
        F.when(F.col("value").between(100, 101), F.col("ts") - F.expr("INTERVAL 40 DAYS")).otherwise(F.col("ts")).alias("at"),
    )


@query(
    f"""WITH {_JOURNAL}, k AS (SELECT user_id, seq, event_id, event_type, CASE WHEN value > 300 THEN md5(h) ELSE h END AS digest, CASE WHEN value < 0.3 THEN 'forged' ELSE ph END AS prev,
          CASE WHEN value BETWEEN 100 AND 101 THEN ts - INTERVAL 40 DAYS ELSE ts END AS tm FROM j),
        l AS (SELECT *, lag(digest) OVER w AS pd, lag(tm) OVER w AS pa FROM k WINDOW w AS (PARTITION BY user_id ORDER BY seq))
       SELECT user_id, seq, unnest(list_filter([CASE WHEN md5(event_id || '|' || event_type) <> digest THEN 'digest' END,
         CASE WHEN (seq = 1 AND prev IS NOT NULL) OR (seq > 1 AND coalesce(prev <> pd, true)) THEN 'previous' END, CASE WHEN tm < pa THEN 'time' END], lambda x: x IS NOT NULL)) AS rule FROM l"""
)
def hash_chain_violations(spark, d):
    recomputed = F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"))
    return Q.chain_violations(journal(spark, d), "user_id", "seq", "prev", "digest", "at", recomputed)


ALLOWED = [(None, "view"), (None, "click"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "signup"), ("signup", "view"), ("signup", "click"), ("error", "view")]


@query(
    f"""WITH {_JOURNAL}, l AS (SELECT user_id, seq, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY seq) AS prev_state FROM j)
        SELECT user_id, seq, event_type, prev_state FROM l WHERE coalesce(prev_state, '') || '>' || event_type NOT IN ({', '.join(f"'{a or ''}>{b}'" for a, b in ALLOWED)})"""
)
def state_transitions(spark, d):
    return Q.transition_violations(journal(spark, d), "user_id", "seq", "event_type", ALLOWED).select("user_id", "seq", "event_type", "prev_state")


@query(
    """WITH m AS (SELECT user_id, event_id, CAST(round(value * 1000000) AS BIGINT) AS micros, event_type FROM events),
        r AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' THEN micros ELSE 0 END) OVER w AS spent, sum(CASE event_type WHEN 'click' THEN micros WHEN 'error' THEN -micros ELSE 0 END) OVER w AS reserved
              FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
       SELECT user_id, event_id, spent::BIGINT AS spent, reserved::BIGINT AS reserved, spent + reserved > 900000000 AS breach FROM r"""
)
def budget_trail(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.round(F.col("value") * 1000000).cast("bigint").alias("micros"))
    t, m = F.col("event_type"), F.col("micros")
    spend = F.when(t == "purchase", m).otherwise(0)
    reserve = F.when(t == "click", m).when(t == "error", -m).otherwise(0)
    return Q.budget_trail(e, "user_id", ["event_id"], spend, reserve, 900_000_000).select("user_id", "event_id", "spent", "reserved", "breach")


_BUDGET = """SELECT user_id, sum(CASE WHEN event_type <> 'click' THEN CAST(round(value * 1000000) AS BIGINT) ELSE 0 END)::BIGINT AS recorded,
   sum(CASE WHEN event_type = 'click' THEN CAST(round(value * 1000000) AS BIGINT) ELSE 0 END)::BIGINT AS reserved FROM events GROUP BY 1"""


@query(f"SELECT *, 9000000000 - recorded - reserved AS remaining FROM ({_BUDGET})")
def budget_totals(spark, d):
    return Q.budget_totals(J.budget_events(table(spark, d, "events")), "user_id", "amount", "kind", 9_000_000_000)


_KINDS = ("proposed", "admitted", "dispatch", "observed", "settled", "retried")
_JOURNAL = """ev AS (SELECT user_id % 7 AS run, event_id AS seq, user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
   e AS (SELECT run, seq, task, CASE WHEN seq % 23 = 0 THEN 'revised' WHEN seq % 19 = 0 THEN 'uncertain' WHEN seq % 29 = 0 THEN 'rejected' ELSE ['retried', 'proposed', 'admitted', 'dispatch', 'observed', 'settled'][rn % 6 + 1] END AS kind,
         seq * 37 % 1000 + 1 AS est, seq * 53 % 900 AS act, CASE WHEN seq % 31 = 0 THEN 'lost' WHEN seq % 2 = 0 THEN 'failed' ELSE 'cancelled' END AS fin, seq % 4 = 0 AS br FROM ev),
   s AS (SELECT *, CASE kind WHEN 'settled' THEN fin WHEN 'rejected' THEN 'rejected' WHEN 'admitted' THEN 'reserved' WHEN 'dispatch' THEN 'submitting' WHEN 'observed' THEN 'submitted' WHEN 'uncertain' THEN 'uncertain' ELSE 'proposed' END AS st FROM e),
   p AS (SELECT *, lag(st) OVER w AS pv, coalesce(last_value(CASE WHEN kind IN ('proposed', 'revised') THEN est END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS cur FROM s WINDOW w AS (PARTITION BY run, task ORDER BY seq)),
   a AS (SELECT *, coalesce(pv IN ('reserved', 'submitting', 'submitted', 'uncertain'), false) AS act_st, CASE WHEN kind = 'settled' THEN act ELSE 0 END AS sp, (st IN ('uncertain', 'submitting'))::INT - coalesce(pv IN ('uncertain', 'submitting'), false)::INT AS db FROM p),
   h AS (SELECT *, CASE WHEN kind = 'admitted' AND pv = 'proposed' THEN cur WHEN kind = 'settled' AND act_st THEN -cur ELSE 0 END AS hd FROM a),
   t AS (SELECT *, sum(sp) OVER o AS spent, sum(hd) OVER o AS reserved, sum(db) OVER o AS doubts FROM h WINDOW o AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)),
   x AS (SELECT *, kind = 'settled' AND (act > cur OR spent > 400000) AS ex FROM t), z AS (SELECT *, sum(ex::INT) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS breaches FROM x)"""


def journal_audit(spark, d):
    """Seven journals of task events that mostly keep to the rules."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("run"), F.col("event_id").alias("seq"), F.col("user_id").alias("task"), rn.alias("rn"))
    seq = F.col("seq")
    kind = F.when(seq % 23 == 0, "revised").when(seq % 19 == 0, "uncertain").when(seq % 29 == 0, "rejected")
    cycle = F.array(*[F.lit(k) for k in (_KINDS[-1], *_KINDS[:-1])])
    fin = F.when(seq % 31 == 0, "lost").when(seq % 2 == 0, "failed").otherwise("cancelled")
    e = e.select("run", "seq", "task", kind.otherwise(cycle[F.col("rn") % 6]).alias("kind"), (seq * 37 % 1000 + 1).alias("est"), (seq * 53 % 900).alias("act"), fin.alias("fin"), (seq % 4 == 0).alias("br"))
    return Q.budget_audit(e, "run", "seq", "task", "kind", "est", "act", "fin", "br", 400_000)


@query(
    f"""WITH {_JOURNAL}, v AS (SELECT run, seq, unnest([
          CASE WHEN NOT CASE kind WHEN 'proposed' THEN pv IS NULL WHEN 'revised' THEN coalesce(pv IN ('proposed', 'rejected'), false) WHEN 'retried' THEN coalesce(pv IN ('failed', 'cancelled'), false)
             WHEN 'rejected' THEN coalesce(pv = 'proposed', false) WHEN 'admitted' THEN coalesce(pv = 'proposed', false) ELSE act_st END THEN 'state' END,
          CASE WHEN kind = 'settled' AND fin = 'lost' THEN 'final' END, CASE WHEN kind = 'admitted' AND NOT (breaches = 0 AND doubts - db = 0) THEN 'unresolved' END,
          CASE WHEN kind = 'admitted' AND spent + reserved - hd + cur > 400000 THEN 'budget' END, CASE WHEN kind = 'settled' AND br <> ex THEN 'breach' END]) AS rule FROM z)
       SELECT run, seq, rule FROM v WHERE rule IS NOT NULL"""
)
def journal_violations(spark, d):
    return journal_audit(spark, d)[0]


@query(
    f"""WITH {_JOURNAL} SELECT run, sum(sp)::BIGINT AS spent, sum(hd)::BIGINT AS reserved, sum(db) > 0 AS uncertain, bool_or(ex) AS breached, count(DISTINCT task) AS tasks, (400000 - sum(sp) - sum(hd))::BIGINT AS remaining FROM z GROUP BY 1"""
)
def journal_totals(spark, d):
    return journal_audit(spark, d)[1]



@query(
    """WITH b AS (SELECT p_partkey, p_brand, [p_type] AS opened, CASE WHEN p_size < 20 THEN 'open' ELSE 'frozen' END AS status FROM part WHERE p_size <> 7),
        a AS (SELECT p_partkey, CASE WHEN p_size = 3 THEN 'X' ELSE p_brand END AS p_brand, CASE WHEN p_size = 4 THEN ['NEW', p_type] ELSE [p_type, 'NEW'] END AS opened, CASE WHEN p_size < 10 THEN 'frozen' WHEN p_size > 45 THEN 'open' WHEN p_size < 20 THEN 'open' ELSE 'frozen' END AS status FROM part WHERE p_size <> 5),
        j AS (SELECT coalesce(b.p_partkey, a.p_partkey) AS p_partkey, b.p_partkey IS NOT NULL AND a.p_partkey IS NOT NULL AS bt, a.p_partkey IS NULL AS gone, b.p_brand AS bb, a.p_brand AS ab, b.opened AS bo, a.opened AS ao, b.status AS bs, a.status AS st
              FROM b FULL JOIN a ON a.p_partkey = b.p_partkey)
       SELECT p_partkey, unnest(list_filter([CASE WHEN gone THEN 'removed' END, CASE WHEN bt AND bb <> ab THEN 'changed:p_brand' END, CASE WHEN bt AND ao[1] <> bo[1] THEN 'rewritten:opened' END,
              CASE WHEN bt AND bs <> st AND NOT (bs = 'open' AND st = 'frozen') THEN 'status' END], lambda x: x IS NOT NULL)) AS rule FROM j"""
)
def append_only_diff(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    typ = F.col("p_type")
    b = p.where(size != 7).select("p_partkey", "p_brand", F.array(typ).alias("opened"), F.when(size < 20, "open").otherwise("frozen").alias("status"))
    a = p.where(size != 5).select(
        "p_partkey", F.when(size == 3, "X").otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(size == 4, F.array(F.lit("NEW"), typ)).otherwise(F.array(typ, F.lit("NEW"))).alias("opened"),
        F.when(size < 10, "frozen").when(size > 45, "open").when(size < 20, "open").otherwise("frozen").alias("status"))
    return Q.append_only_diff(b, a, "p_partkey", ["p_brand"], ["opened"], "status", [("open", "frozen")])


@query(
    """SELECT DISTINCT o_custkey AS source, o_orderstatus AS grp, o_orderpriority AS consumer FROM orders n WHERE o_orderstatus = 'O'
       AND EXISTS (SELECT 1 FROM orders u WHERE u.o_orderstatus = 'F' AND u.o_custkey = n.o_custkey AND u.o_orderpriority = n.o_orderpriority)"""
)
def reuse_violations(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("grp"), F.col("o_orderpriority").alias("consumer"))
    return Q.reuse_violations(o.where("grp = 'O'"), o.where("grp = 'F'"), "source", "grp", "consumer")


@query(
    """WITH m AS (SELECT c_custkey AS k FROM customer), f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000), r AS (SELECT DISTINCT o_custkey + 5 AS k FROM orders WHERE o_totalprice < 60000),
        j AS (SELECT k, bool_or(t = 'm') AS m, bool_or(t = 'f') AS f, bool_or(t = 'r') AS r FROM (SELECT k, 'm' AS t FROM m UNION ALL SELECT k, 'f' FROM f UNION ALL SELECT k, 'r' FROM r) GROUP BY 1)
       SELECT k, problem FROM (SELECT k, CASE WHEN f AND r THEN 'in both' WHEN m AND NOT f AND NOT r THEN 'not covered' WHEN NOT m THEN 'not a member' END AS problem FROM j) WHERE problem IS NOT NULL"""
)
def partition_cover(spark, d):
    o = table(spark, d, "orders")
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    f = o.where("o_orderstatus = 'F' AND o_totalprice > 400000").select(F.col("o_custkey").alias("k")).distinct()
    r = o.where("o_totalprice < 60000").select((F.col("o_custkey") + 5).alias("k")).distinct()
    return Q.cover_check(m, f, r, "k")


DENY = ["that and", "la le"]
_HYG = {**Q.HYGIENE, "deny_name": Q.deny_pattern(DENY)}


@query(
    "WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) "
    + " UNION ALL ".join(f"SELECT doc_id, line, '{n}' AS rule FROM l WHERE regexp_matches(t, '{p}')" for n, p in _HYG.items())
    + " UNION ALL SELECT doc_id, line, 'oversize' FROM l WHERE length(t) > 3000"
)
def text_hygiene(spark, d):
    return Q.hygiene_hits(table(spark, d, "documents", spread=True), "doc_id", "text", _HYG, 3000)


_NAMES = ["that and", "la le", "Le-La", "the"]


def _sql_name(name):
    """Lines of a name's occurrences: line ends in the pieces between matches and in the matches before."""
    p = "(?i)\\b" + "[\\s./\\\\-]+".join(name.lower().replace("-", " ").split()) + "\\b"
    ends = lambda x: f"length({x}) - length(replace({x}, chr(10), ''))"
    return f"""SELECT doc_id, (1 + list_sum(list_transform(ps[1:k], lambda x: {ends('x')})) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: {ends('x')})), 0))::INTEGER AS line, '{name}' AS name
       FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS ps, regexp_extract_all(t, '{p}') AS ms FROM (SELECT doc_id, translate(text, '_', ' ') AS t FROM documents)))"""


@query(" UNION ALL ".join(_sql_name(n) for n in _NAMES))
def deny_names(spark, d):
    """Listed names as whole words, also across line ends, with the line on which each begins."""
    return Q.deny_hits(table(spark, d, "documents", spread=True), "doc_id", "text", _NAMES)



@query(
    """SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(text, 'example.com', '<site>'), 'the', 'THE'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<mail>', 'g'), '[0-9]{3,}', '<n>', 'g')) AS scrubbed FROM documents"""
)
def scrubbed_text(spark, d):
    subs = [(Q.HYGIENE["email"], "<mail>"), ("[0-9]{3,}", "<n>")]
    return table(spark, d, "documents", spread=True).select("doc_id", F.md5(X.scrub(F.col("text"), subs, {"the": "THE", "example.com": "<site>"})).alias("scrubbed"))


@query(
    """WITH u AS (SELECT 'k' || (event_id % 997) AS name, max(regexp_extract(props, '"k": *([0-9]+)', 1)) AS value FROM events WHERE event_type = 'view' GROUP BY 1),
        r AS (SELECT 'k' || (event_id % 997) AS name, max(regexp_extract(props, '"k": *([0-9]+)', 1)) AS value FROM events WHERE event_type = 'click' GROUP BY 1)
       SELECT coalesce(u.name, r.name) AS name, CASE WHEN u.value IS NULL THEN 'unused' WHEN r.value IS NULL THEN 'unregistered' WHEN u.value = r.value THEN 'same' ELSE 'differs' END AS status FROM u FULL JOIN r ON u.name = r.name"""
)
def constants_agreement(spark, d):
    e = table(spark, d, "events")
    side = lambda t: e.where(F.col("event_type") == t).groupBy(F.concat(F.lit("k"), (F.col("event_id") % 997).cast("string")).alias("name")).agg(
        F.max(F.get_json_object("props", "$.k")).alias("value"))
    return Q.constants_agreement(side("view"), side("click"))


@query(
    """SELECT o_orderkey, 'foreign:o_custkey' AS rule FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900)
       UNION ALL SELECT o_orderkey, 'status_enum' FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, 'priority_pattern' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')"""
)
def record_schema_check(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rules = {"status_enum": F.col("o_orderstatus").isin("O", "F"), "priority_pattern": F.col("o_orderpriority").rlike("^[1-4]-")}
    v = Q.violations(o, ["o_orderkey"], rules)
    return v.unionByName(Q.foreign_key_violations(o, ["o_orderkey"], "o_custkey", c.where("c_acctbal > -900"), "c_custkey"))


# --- sets --------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
       SELECT k, CASE WHEN k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) THEN 'shared' WHEN k IN (SELECT k FROM a) THEN 'only_a' ELSE 'only_b' END AS part FROM (SELECT k FROM a UNION SELECT k FROM b)"""
)
def set_overlap(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    a, b = side("A"), side("R")
    tag = lambda df, n: df.withColumn("part", F.lit(n))
    return tag(a.intersect(b), "shared").unionByName(tag(a.subtract(b), "only_a")).unionByName(tag(b.subtract(a), "only_b"))


@query(
    """WITH b AS (SELECT p_partkey, p_brand, p_type FROM part), al AS (SELECT p_type, 'opaque_' || dense_rank() OVER (ORDER BY p_type) AS alias FROM (SELECT DISTINCT p_type FROM part)),
        own AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM b),
        sh AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY md5('8|0|' || p_partkey), p_partkey) AS k FROM b)
       SELECT 'real' AS condition, p_partkey, p_type AS label, p_type = 'PROMO' AS qualifies FROM b
       UNION ALL SELECT 'opaque', p_partkey, alias, b.p_type = 'PROMO' FROM b JOIN al ON b.p_type = al.p_type
       UNION ALL SELECT 'conflict', own.p_partkey, sh.p_type, sh.p_type = 'PROMO' FROM own JOIN sh ON own.p_brand = sh.p_brand AND own.k = sh.k"""
)
def conditioned_copies(spark, d):
    """Real labels, opaque renames and within-brand permuted labels, each with its own answer key."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    # The label vocabulary is a handful of distinct types, so ranking it in one place is bounded.
    alias = p.select("p_type").distinct().withColumn("alias", F.expr("concat('opaque_', dense_rank() OVER (ORDER BY p_type))"))
    perm = R.permute_within(p, ["p_brand"], "p_partkey", "p_type", 8, 1)
    key = (F.col("p_type") == "PROMO").alias("qualifies")
    one = lambda df, n, label: df.select(F.lit(n).alias("condition"), "p_partkey", F.col(label).alias("label"), key)
    return one(p, "real", "p_type").unionByName(one(p.join(alias, "p_type"), "opaque", "alias")).unionByName(one(perm, "conflict", "p_type"))


@query(
    """WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY md5('6|' || c_custkey), c_custkey) AS rn FROM customer)
       SELECT c_custkey, CASE WHEN rn > 50 THEN c_mktsegment END AS shown FROM r"""
)
def dropped_field_sample(spark, d):
    """Remove one field from a seeded sample of rows; the rest keep it."""
    from attesta.operators.selection import nested_samples

    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    picked = nested_samples(c.select("c_custkey"), "c_custkey", [50], 6).select("c_custkey", F.lit(True).alias("drop"))
    return c.join(picked, "c_custkey", "left").select("c_custkey", F.when(F.col("drop").isNull(), F.col("c_mktsegment")).alias("shown"))


# --- streams -----------------------------------------------------------------------------------


@query(f"SELECT user_id, recorded, reserved FROM ({_BUDGET})")
def streamed_budget_totals(spark, d):
    return J.stream_budget_totals(spark, d)


@query(
    "SELECT user_id, event_type, min(event_id) AS n_first FROM events GROUP BY 1, 2"
)
def streamed_first_receipts(spark, d):
    return J.stream_first_receipts(spark, d)


@query(
    f"""WITH l AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER w AS p, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, event_id, CASE WHEN ts < pt THEN 'time' ELSE 'transition' END AS rule FROM l WHERE ts < pt OR coalesce(p, '') || '>' || event_type NOT IN ({', '.join(f"'{a or ''}>{b}'" for a, b in ALLOWED)})"""
)
def streamed_journal_audit(spark, d):
    return J.stream_journal_audit(spark, d, ALLOWED)
