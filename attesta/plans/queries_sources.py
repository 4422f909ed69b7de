"""Readers and writers; the files they read are written by Spark from the given tables."""

from pyspark.sql import functions as F

from attesta.operators import audit as Q
from attesta.operators.ordered import numbered
from attesta.plans.registry import registrar
from attesta.session import fresh_path, table
from attesta.sources import readers as R
from attesta.sources import sinks as W

QUERIES, query = registrar()


def as_text(spark, lines, label):
    path = fresh_path(spark, label)
    lines.write.text(path)
    return path


def s(c):
    return F.col(c).cast("string")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def parquet_scan(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query(
    """SELECT c_custkey::VARCHAR AS row_id, k AS col_id, v AS value FROM (SELECT c_custkey, unnest(['BAL', 'NATION', 'GONE']) AS k, unnest([c_acctbal, c_nationkey::DOUBLE, CASE WHEN c_acctbal > 0 THEN c_acctbal / 4 END]) AS v FROM customer)"""
)
def wide_csv_matrix(spark, d):
    path = fresh_path(spark, "wide")
    c = table(spark, d, "customer")
    c.select(
        s("c_custkey").alias("id"), F.col("c_acctbal").alias("BAL (17)"), F.col("c_nationkey").alias("NATION (3)"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 4).alias("GONE"), F.lit(0).alias("BAL (18)"),
    ).write.option("header", "true").csv(path)
    return R.wide_csv(spark, path)


@query("SELECT 'ACH-' || lpad(l_suppkey::VARCHAR, 6, '0') AS row_id, l_returnflag AS col_id, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2")
def oriented_matrix(spark, d):
    ids = F.concat(F.lit("ACH-"), F.lpad(s("l_suppkey"), 6, "0")).alias("col_id")
    turned = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("row_id"), ids).agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    return R.oriented(turned, "^ACH-[0-9]{6}$")


@query("SELECT l_orderkey, l_partkey, l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08) AS profiled FROM lineitem WHERE l_discount > 0.08")
def flagged_call_scan(spark, d):
    path = fresh_path(spark, "calls")
    li = table(spark, d, "lineitem")
    li.select("l_orderkey", "l_partkey", "l_linestatus", (F.col("l_discount") > 0.08).alias("likely")).write.option("header", "true").csv(path)
    calls, profiled = R.flagged_calls(spark, path, "l_orderkey bigint, l_partkey bigint, note string, likely boolean", ["l_orderkey", "l_partkey"], "likely", "l_orderkey")
    return calls.join(profiled.withColumn("profiled", F.lit(True)), "l_orderkey", "left")


@query("SELECT 'G' || l_partkey AS feature, 'lib_' || l_returnflag AS library, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def count_matrix_tsv(spark, d):
    path = fresh_path(spark, "counts")
    li = table(spark, d, "lineitem")
    g = li.groupBy(F.concat(F.lit("G"), s("l_partkey")).alias("Geneid"), F.lit("x").alias("Chr")).agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).cast("bigint").alias(f"lib_{f}") for f in ("A", "N", "R")])
    g.write.option("sep", "\t").option("header", "true").csv(path)
    return R.count_matrix(spark, path, ["Chr"]).where("raw IS NOT NULL").select("feature", "library", "n")


_BED = "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey * 10 AS a, l_partkey * 10 + l_linenumber - 2 AS b, CASE WHEN l_tax = 0 THEN 'nan' ELSE CAST(l_quantity AS VARCHAR) END AS v FROM lineitem"


def bed_lines(spark, d, sep):
    li = table(spark, d, "lineitem")
    p = F.col("l_partkey") * 10
    v = F.when(F.col("l_tax") == 0, "nan").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(sep, s("l_suppkey"), p.cast("string"), (p + F.col("l_linenumber") - 2).cast("string"), v).alias("line"))


@query(
    """SELECT 'chr' || l_suppkey AS chrom, l_partkey * 10 AS start, l_partkey * 10 + l_linenumber - 2 AS "end", CASE WHEN l_tax <> 0 THEN l_quantity END AS value FROM lineitem"""
)
def bedgraph_tolerant(spark, d):
    body = bed_lines(spark, d, " ").select("line")
    head = table(spark, d, "region").select(F.concat(F.lit("track name="), F.col("r_name")).alias("line"))
    return R.bedgraph(spark, as_text(spark, head.unionByName(body), "bed"))


@query(
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY l_suppkey, l_partkey, l_orderkey, l_linenumber) AS ord, l_partkey * 10 AS a, l_partkey * 10 + l_linenumber - 2 AS b FROM lineitem),
        p AS (SELECT *, CASE WHEN l_suppkey = lag(l_suppkey) OVER (ORDER BY ord) THEN lag(a) OVER (ORDER BY ord) END AS pa FROM o)
       SELECT ord, 'interval' AS rule FROM p WHERE NOT (a >= 0 AND b > a) UNION ALL SELECT ord, 'value' FROM p WHERE l_tax = 0 UNION ALL SELECT ord, 'order' FROM p WHERE a < pa"""
)
def bedgraph_strict(spark, d):
    lines = numbered(bed_lines(spark, d, "\t"), [], ["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"], "ord")
    return Q.violations(R.strict_bedgraph(lines, "ord", "line"), ["ord"], R.bedgraph_rules())


@query(
    """WITH p AS (SELECT l_suppkey % 25 AS c1, l_linenumber % 2 AS same, l_partkey AS p1, l_orderkey % 3000 AS p2, CAST(l_quantity AS INT) AS q FROM lineitem),
        r AS (SELECT CASE WHEN same = 1 AND q < 3 THEN 'trans' WHEN c1 NOT BETWEEN 1 AND 22 THEN 'not_autosomal' WHEN p1 < 1 OR p2 < 1 OR greatest(p1, p2) > 2500 THEN 'out_of_range' WHEN least(q, 30) < 10 THEN 'low_mapq' END AS reason FROM p)
       SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1"""
)
def valid_pair_reasons(spark, d):
    li = table(spark, d, "lineitem")
    c1, q = F.col("l_suppkey") % 25, F.col("l_quantity").cast("int")
    c2 = F.when((F.col("l_linenumber") % 2 == 1) & (q < 3), c1 + 1).otherwise(c1)
    line = F.concat_ws("\t", F.lit("r"), c1.cast("string"), s("l_partkey"), F.lit("+"), c2.cast("string"), (F.col("l_orderkey") % 3000).cast("string"), F.lit("-"), F.lit("f"), F.lit("a"), F.lit("b"), q.cast("string"), F.lit("30"))
    path = as_text(spark, li.select(line.alias("value")), "pairs")
    sizes = li.select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 25).cast("string")).alias("chrom")).distinct().withColumn("length", F.lit(2500))
    v = R.valid_pairs(spark.read.text(path), "value", sizes, 10)
    return v.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH b AS (SELECT p_partkey AS id, 'chr' || (p_partkey % 3) AS chrom, p_partkey // 3 AS bin FROM part),
        e AS (SELECT l_partkey AS id1, l_suppkey AS id2, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2)
       SELECT x.chrom, least(x.bin, y.bin) AS i, greatest(x.bin, y.bin) AS j, max(value) AS w FROM e JOIN b x ON id1 = x.id JOIN b y ON id2 = y.id WHERE x.chrom = y.chrom GROUP BY ALL"""
)
def sparse_matrix_with_bins(spark, d):
    p = F.col("p_partkey")
    bins = table(spark, d, "part").select(p.alias("id"), F.concat(F.lit("chr"), (p % 3).cast("string")).alias("chrom"), (F.floor(p / 3) * 500).alias("start"))
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2")).agg(F.max("l_quantity").alias("value"))
    return R.sparse_matrix(e, bins, 500)[0]


@query(
    """SELECT p_name || p_partkey AS name, 'chr' || (p_size % 22 + 1) AS chrom, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 100 ELSE p_partkey * 100 + p_size - 1 END AS tss FROM part"""
)
def gene_annotation(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    body = [F.concat("p_name", k.cast("string")), (F.col("p_size") % 22 + 1).cast("string"), F.when(k % 2 == 0, "+").otherwise("-"), (k * 100).cast("string"), (k * 100 + F.col("p_size")).cast("string")]
    line = F.when(F.col("p_size") > 25, F.concat_ws("\t", F.lit("585"), *body)).otherwise(F.concat_ws("\t", *body))
    path = as_text(spark, p.select(line.alias("value")), "genes")
    return R.gene_annotation(spark.read.text(path), "value")


@query(
    """SELECT 'D' || doc_id AS collection_id, md5(source || ' ' || text) AS text_md5, lang || '|' || source AS tissue, CASE WHEN n_chars > 900 THEN 'long|' || lang ELSE lang END AS disease
       FROM documents WHERE length(text) >= 200"""
)
def nested_json_items(spark, d):
    path = fresh_path(spark, "collections")
    tis = lambda v, t: F.struct(v.alias("label"), F.lit(t).alias("tissue_type"))
    dis = lambda v: F.struct(v.alias("label"))
    lang, src = F.col("lang"), F.col("source")
    ds = lambda t, x: F.struct(t.alias("tissue"), x.alias("disease"))
    table(spark, d, "documents", spread=True).select(
        F.concat(F.lit("D"), s("doc_id")).alias("collection_id"), src.alias("name"), F.col("text").alias("description"),
        F.array(
            ds(F.array(tis(lang, "tissue"), tis(F.lit("line"), "cell line")), F.array(dis(F.when(F.col("n_chars") > 900, "long").otherwise(lang)))),
            ds(F.array(tis(src, "tissue"), tis(lang, "tissue")), F.array(dis(lang))),
        ).alias("datasets"),
    ).write.json(path)
    out = R.nested_items(spark, path, 200)
    return out.select("collection_id", F.md5("text").alias("text_md5"), F.array_join("tissue", "|").alias("tissue"), F.array_join("disease", "|").alias("disease"))


@query(
    """SELECT o_orderkey, i, CASE i WHEN 0 THEN o_orderpriority ELSE o_orderstatus END AS tissue, CASE i WHEN 0 THEN CAST(o_custkey AS VARCHAR) END AS disease FROM orders, (SELECT unnest([0, 2]) AS i)"""
)
def answer_blocks(spark, d):
    t = F.concat(F.lit("preamble\n[0]\ntissue: "), "o_orderpriority", F.lit("\ndisease:  "), s("o_custkey"), F.lit("\n[2]\n tissue: first\nTissue: "), "o_orderstatus", F.lit("\n[9]\ntissue: out of range"))
    o = table(spark, d, "orders").select("o_orderkey", t.alias("answer"))
    return R.answer_blocks(o, "o_orderkey", "answer", ["tissue", "disease"], F.lit(5))


@query(
    """SELECT p_partkey, 'QUALIFIES' AS section, upper(split_part(p_name, ' ', 1)) AS member FROM part UNION SELECT p_partkey, 'DOES NOT QUALIFY', upper(split_part(p_name, ' ', 2)) FROM part
       UNION SELECT p_partkey, 'DOES NOT QUALIFY', p_type FROM part"""
)
def sectioned_list(spark, d):
    w = lambda i: F.upper(F.split_part("p_name", F.lit(" "), F.lit(i)))
    t = F.concat(F.lit("Here it is\nQUALIFIES:\n"), w(1), F.lit("\n not a symbol\nDOES NOT QUALIFY\n"), w(2), F.lit("\n"), F.col("p_type"), F.lit("\n"), w(2))
    return R.sectioned_list(table(spark, d, "part").select("p_partkey", t.alias("t")), "p_partkey", "t", ["QUALIFIES", "DOES NOT QUALIFY"])


@query(
    """SELECT p_partkey, 2 AS conforming, 1 AS strict_lines, 1 AS nonconforming, upper(p_type) || '|' || p_brand AS strict_cited FROM part"""
)
def citation_lines(spark, d):
    t = F.concat(F.lit("G1 | "), F.upper("p_type"), F.lit(" | "), "p_brand", F.lit("\n- **g2** | "), F.col("p_type"), F.lit("\nno citation here\n"))
    c = R.citation_lines(table(spark, d, "part").select("p_partkey", t.alias("t")), "p_partkey", "t")
    return c.groupBy("p_partkey").agg(
        F.count("name").cast("int").alias("conforming"), F.count_if("strict").cast("int").alias("strict_lines"), F.count_if(F.col("name").isNull()).cast("int").alias("nonconforming"),
        F.max(F.when(F.col("strict"), F.array_join("cited", "|"))).alias("strict_cited"))


@query(
    """WITH v AS (SELECT 'S' || (l_suppkey % 12) AS screen_id, 'G' || l_partkey AS symbol, l_discount AS score FROM lineitem WHERE l_quantity > 5 AND l_suppkey % 12 IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 9)),
        g AS (SELECT screen_id, symbol, avg(score) AS score FROM v GROUP BY 1, 2), n AS (SELECT screen_id, count(*) AS n_symbols FROM g GROUP BY 1 HAVING count(*) >= 100)
       SELECT g.screen_id, symbol, round(score, 6) AS score, n_symbols FROM g JOIN n ON g.screen_id = n.screen_id"""
)
def score_files(spark, d):
    path = fresh_path(spark, "screens")
    li = table(spark, d, "lineitem")
    li.select(
        F.concat(F.lit("G"), s("l_partkey")).alias("symbol"), F.when(F.col("l_quantity") > 5, s("l_discount")).otherwise("na").alias("score"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 12).cast("string")).alias("screen_id"),
    ).write.partitionBy("screen_id").option("sep", "\t").csv(path)
    wanted = table(spark, d, "supplier").where("s_nationkey < 9").select(F.concat(F.lit("S"), s("s_nationkey")).alias("screen_id"))
    return R.score_files(spark, path, wanted, 100).withColumn("score", F.round("score", 6))


@query(
    """SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation,
       concat_ws('|', CASE WHEN c_nationkey = 3 THEN 'repeated:segment' END, CASE WHEN c_acctbal <= 0 THEN 'missing:nation' END) AS issues FROM customer"""
)
def key_value_samples(spark, d):
    t = F.concat_ws(
        "\n", F.concat(F.lit("segment = "), "c_mktsegment"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("nation = "), s("c_nationkey"))),
        F.when(F.col("c_nationkey") == 3, F.concat(F.lit("segment = "), "c_mktsegment")), F.lit("free text"))
    r = R.key_value_samples(table(spark, d, "customer").select("c_custkey", t.alias("t")), "c_custkey", "t", ["segment", "nation"])
    return r.withColumn("issues", F.array_join("issues", "|"))


@query(
    """SELECT 'one' AS dataset, l_returnflag AS line, 'G' || l_partkey AS gene_a, 'S' || l_suppkey AS gene_b, l_discount - 0.05 AS gi, l_linestatus = 'O' AS flag FROM lineitem
       UNION ALL SELECT 'two', 'HAP1', 'G' || l_partkey, 'S' || l_suppkey, l_tax - 0.04, l_tax - 0.04 <= -0.025 FROM lineitem"""
)
def normalised_pair_tables(spark, d):
    li = table(spark, d, "lineitem")
    g, sp = F.concat(F.lit("g-"), s("l_partkey")), F.concat(F.lit("s "), s("l_suppkey"))
    one = li.select(g.alias("Gene A"), sp.alias("Gene B"), F.col("l_returnflag").alias("Cell line"), (F.col("l_discount") - 0.05).alias("GI_score"), (F.col("l_linestatus") == "O").cast("int").alias("SL call"))
    two = li.select(F.concat_ws("|", g, sp).alias("gene_pair"), (F.col("l_tax") - 0.04).alias("pi.score"))
    a = R.normalise_pairs(one, "one", {"gene_a": ["genea"], "gene_b": ["geneb"], "line": ["cellline"], "gi": ["gi.*"], "flag": [".*sl.*"]})
    b = R.normalise_pairs(two, "two", {"pair": ["genepair"], "gi": ["pi.?score"], "separator": "\\|", "default_line": "HAP1", "gi_limit": -0.025})
    return a.unionByName(b)


@query(
    """SELECT DISTINCT p_brand AS set_id, m AS member FROM (SELECT p_brand, unnest([p_type, 'M' || (p_size % 4)]) AS m FROM part)
       UNION SELECT 'C' || s_nationkey, m FROM (SELECT s_nationkey, unnest([s_name, 'N' || s_nationkey]) AS m FROM supplier)"""
)
def set_files(spark, d):
    m = F.concat(F.lit("M"), (F.col("p_size") % 4).cast("string"))
    gmt = table(spark, d, "part").select(F.concat_ws("\t", "p_brand", F.lit("http://x"), "p_type", m).alias("value"))
    sub = table(spark, d, "supplier").select(F.concat_ws("\t", F.concat(F.lit("C"), s("s_nationkey")), F.concat("s_name", F.lit("; N"), s("s_nationkey"))).alias("value"))
    read = lambda df, form: R.set_members(spark.read.text(as_text(spark, df, form)), "value", form)
    return read(gmt, "gmt").unionByName(read(sub, "subunits"))


@query("SELECT event_id, user_id, event_type FROM events UNION ALL SELECT event_id + 1000000000, user_id, 'late' FROM events WHERE event_type = 'error'")
def ledger_append_and_read(spark, d):
    path = fresh_path(spark, "ledger")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    W.append_ledger(e, path)
    W.append_ledger(e.where("event_type = 'error'").select((F.col("event_id") + 1000000000).alias("event_id"), "user_id", F.lit("late").alias("event_type")), path)
    return R.jsonl_ledger(spark, path, "event_id bigint, user_id bigint, event_type string")


@query("SELECT CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN substr(p_brand, 7) ELSE 'other' END AS part, count(*) AS n FROM part GROUP BY 1")
def routed_rows(spark, d):
    return W.route_by_suffix(table(spark, d, "part"), "p_brand", "#([12])$", fresh_path(spark, "routed"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS score, s_name FROM supplier")
def write_once_table(spark, d):
    path = fresh_path(spark, "once")
    t = table(spark, d, "supplier").withColumn("score", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(F.lit(float("nan"))))
    W.write_once(t, path, ["s_suppkey", "score", "s_name"])
    return spark.read.schema("s_suppkey bigint, score double, s_name string").option("sep", "\t").option("header", "true").csv(path)
