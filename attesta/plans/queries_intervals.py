"""Interval operators; orders per nation act as intervals on a day axis, events as points in time."""

from pyspark.sql import functions as F

from attesta.operators import intervals as I
from attesta.operators.ordered import lagged
from attesta.plans.registry import registrar
from attesta.session import table

QUERIES, query = registrar()

WIDTH = 100_000
LENGTH = 1_000_000  # coordinates are order keys scaled into [0, LENGTH)

# Intervals: each order spans from a hashed position over a length taken from its price.
_IV = """iv AS (SELECT 'chr' || (c_nationkey % 7) AS chrom, o_orderkey, (o_orderkey * 7919) % 1000000 AS s,
   least((o_orderkey * 7919) % 1000000 + CAST(o_totalprice AS BIGINT) % 30000, 1000000) AS e, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE sqrt(o_totalprice) END AS v, o_orderpriority AS cat
   FROM orders JOIN customer ON o_custkey = c_custkey)"""


def intervals(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    s = F.col("o_orderkey") * 7919 % LENGTH
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("chr"), (F.col("c_nationkey") % 7).cast("string")).alias("chrom"), "o_orderkey", s.alias("s"),
        F.least(s + F.round("o_totalprice").cast("bigint") % 30000, F.lit(LENGTH).cast("bigint")).alias("e"),
        F.when(F.col("o_orderstatus") != "P", F.sqrt("o_totalprice")).alias("v"), F.col("o_orderpriority").alias("cat"),
    )


def sizes(spark, d):
    """One row per partition, as many as the nation table has residues."""
    n = table(spark, d, "nation")
    return n.select(F.concat(F.lit("chr"), (F.col("n_nationkey") % 7).cast("string")).alias("chrom")).distinct().withColumn(
        "length", F.lit(LENGTH - 30_000).cast("bigint")
    )


def clipped(spark, d):
    return intervals(spark, d).withColumn("e", F.least("e", F.lit(LENGTH - 30_000).cast("bigint"))).where("e > s")


_IV = _IV.replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)")
_CLIP = _IV + ", cv AS (SELECT chrom, o_orderkey, s, least(e, 970000) AS e, v, cat FROM iv WHERE least(e, 970000) > s)"
_TILES = "tl AS (SELECT k, k * 100000 AS a, least((k + 1) * 100000, 970000) AS b FROM (SELECT unnest(range(10)) AS k))"
_SPLIT = _CLIP + ", " + _TILES + ", sp AS (SELECT cv.*, k AS tile, least(e, b) - greatest(s, a) AS ov, b - a AS tlen FROM cv JOIN tl ON s < b AND e > a)"


# Intervals cut where the next one of the partition starts, so that none overlap.
_APART = "ap AS (SELECT chrom, s, least(e, coalesce(lead(s) OVER (PARTITION BY chrom ORDER BY s, o_orderkey), e)) AS e, v FROM cv)"
_APART_SPLIT = _CLIP + ", " + _APART + ", " + _TILES + ", sp AS (SELECT ap.*, k AS tile, least(e, b) - greatest(s, a) AS ov, b - a AS tlen FROM ap JOIN tl ON s < b AND e > a WHERE e > s)"


def apart(spark, d):
    iv = clipped(spark, d).withColumns({"__s": -F.col("s"), "__k": -F.col("o_orderkey")})
    return lagged(iv, ["chrom"], ["__s", "__k"], ["s"]).withColumn("e", F.least("e", F.coalesce("prev_s", "e")))


@query(
    f"""WITH {_APART_SPLIT} SELECT chrom, tile, sum(ov)::BIGINT AS covered, round(sum(ov) / max(tlen), 6) AS coverage,
        round(CASE WHEN sum(ov) / max(tlen) >= 0.5 THEN sum(ov * v) / sum(ov) END, 6) AS mean FROM sp WHERE v IS NOT NULL GROUP BY 1, 2"""
)
def interval_tile_means(spark, d):
    m = I.tile_means(apart(spark, d), sizes(spark, d), [], "chrom", "s", "e", "v", "length", WIDTH)
    return m.withColumns({"coverage": F.round("coverage", 6), "mean": F.round("mean", 6)})


@query(f"WITH {_SPLIT} SELECT chrom, cat, tile, round(sum(ov) / 100000, 6) AS fraction FROM sp GROUP BY ALL")
def overlap_fraction(spark, d):
    return I.overlap_fraction(clipped(spark, d), ["cat"], "chrom", "s", "e", WIDTH).withColumn("fraction", F.round("fraction", 6))


@query(
    f"""WITH {_CLIP}, t AS (SELECT unnest(range(970)) AS k), sp AS (SELECT cv.*, k AS tile, least(e, (k + 1) * 1000) - greatest(s, k * 1000) AS ov FROM cv JOIN t ON s < (k + 1) * 1000 AND e > k * 1000)
        SELECT chrom, tile, cat AS category FROM (SELECT *, row_number() OVER (PARTITION BY chrom, tile ORDER BY s DESC, e DESC, cat DESC) AS rn FROM sp WHERE ov >= 500) WHERE rn = 1"""
)
def majority_category(spark, d):
    return I.majority_category(clipped(spark, d), "chrom", "s", "e", "cat", 1000)


@query(
    f"""WITH {_IV}, a AS (SELECT chrom, min(s) + 200000 AS lo, max(s) - 300000 AS hi, max(e) AS size FROM iv GROUP BY 1)
        SELECT o_orderkey, round(CASE WHEN s < lo THEN (lo - s) / lo WHEN s > hi THEN (s - hi) / (size - hi) ELSE 0 END, 9) AS arm_pos FROM iv JOIN a ON iv.chrom = a.chrom"""
)
def arm_position(spark, d):
    iv = intervals(spark, d)
    a = iv.groupBy("chrom").agg((F.min("s") + 200000).alias("lo"), (F.max("s") - 300000).alias("hi"), F.max("e").alias("size"))
    pos = I.arm_position(F.col("s"), F.col("lo"), F.col("hi"), F.col("size"))
    return iv.join(a, "chrom").select("o_orderkey", F.round(pos, 9).alias("arm_pos"))


@query(
    f"""WITH {_IV}, c AS (SELECT DISTINCT 'chr' || (n_nationkey % 7) AS chrom FROM nation), g AS (SELECT chrom, k AS tile, k * 100000 AS tile_start, least((k + 1) * 100000, 970000) AS tile_end
        FROM c, (SELECT unnest(range(10)) AS k)), n AS (SELECT chrom, s // 100000 AS tile, count(*) AS n FROM iv GROUP BY 1, 2)
        SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN n ON g.chrom = n.chrom AND g.tile = n.tile"""
)
def points_per_tile(spark, d):
    grid = I.tile_grid(sizes(spark, d), "chrom", "length", WIDTH)
    return I.points_per_tile(intervals(spark, d), grid, "chrom", "s", WIDTH)


@query(
    f"""WITH {_IV} SELECT DISTINCT chrom, s, count(*) OVER (PARTITION BY chrom ORDER BY s RANGE BETWEEN 2500 PRECEDING AND 2500 FOLLOWING) AS n_near FROM iv"""
)
def neighbour_counts(spark, d):
    return I.neighbour_counts(intervals(spark, d), ["chrom"], "s", 2500)


@query(
    f"""WITH {_IV}, o AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM iv)
        SELECT chrom, o_orderkey FROM o WHERE s < m"""
)
def overlapping_intervals(spark, d):
    r = I.overlapping_rows(intervals(spark, d), ["chrom"], "s", "e", ["o_orderkey"])
    return r.select("chrom", "o_orderkey")


# Lift: blocks of 20,000 every 25,000, some to another partition; targets shifted by 15,000.
_BLOCKS = """bl AS (SELECT DISTINCT 'chr' || (n_nationkey % 7) AS chrom, k * 25000 AS a, k * 25000 + 20000 AS b,
   CASE WHEN k % 9 = 4 THEN 'chr' || ((n_nationkey + 1) % 7) ELSE 'chr' || (n_nationkey % 7) END AS dst, k * 25000 + 15000 AS t FROM nation, (SELECT unnest(range(40)) AS k) WHERE n_nationkey < 7)"""
_LIFT = f"""{_IV}, {_BLOCKS}, p AS (SELECT o_orderkey AS point_id, chrom, (s + e) // 2 AS pos, v FROM iv),
  l AS (SELECT p.*, dst, t + pos - a AS np FROM p LEFT JOIN bl ON p.chrom = bl.chrom AND pos >= a AND pos < b),
  r AS (SELECT *, CASE WHEN np IS NULL THEN 'unmapped' WHEN dst <> chrom THEN 'chrom_change' WHEN np >= 970000 THEN 'unmapped' ELSE 'lifted' END AS reason FROM l)"""


def lifted(spark, d):
    blocks = sizes(spark, d).select("chrom", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    number = F.substring("chrom", 4, 9).cast("int")
    away = F.concat(F.lit("chr"), ((number + 1) % 7).cast("string"))
    a = (F.col("k") * 25000).cast("bigint")
    blocks = blocks.select(
        "chrom", a.alias("src_start"), (a + 20000).alias("src_end"),
        F.when(F.col("k") % 9 == 4, away).otherwise(F.col("chrom")).alias("dst_chrom"), (a + 15000).alias("dst_start"),
    )
    p = intervals(spark, d).select(
        F.col("o_orderkey").alias("point_id"), "chrom", F.floor((F.col("s") + F.col("e")) / 2).alias("pos"), "v"
    )
    return I.lift_points(p, blocks, sizes(spark, d))


@query(f"WITH {_LIFT} SELECT chrom, reason, count(*) AS n FROM r GROUP BY 1, 2")
def lift_reasons(spark, d):
    return lifted(spark, d).groupBy("chrom", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_LIFT} SELECT dst AS dst_chrom, np // 10000 AS tile, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN avg(v) END, 6) AS mean
        FROM r WHERE reason = 'lifted' GROUP BY 1, 2"""
)
def lifted_tile_means(spark, d):
    return I.lifted_tile_means(lifted(spark, d), "v", 10_000, 10).withColumn("mean", F.round("mean", 6))


# Two non-overlapping tracks per partition: supplier shipments cut at fixed strides.


def tracks(spark, d):
    li = table(spark, d, "lineitem")
    chrom = F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string"))

    def one(name, stride, length, col):
        g = li.groupBy(chrom.alias("chrom"), "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(col)).alias("q"))
        return g.select(
            F.lit(name).alias("track"), "chrom", (F.col("l_partkey") * stride).alias("start"),
            (F.col("l_partkey") * stride + length).alias("end"), F.when(F.col("n") % 11 != 0, F.col("q")).alias("value"),
        )

    n_part = table(spark, d, "part").count()
    chroms = li.select(chrom.alias("chrom")).distinct().withColumn("length", F.lit(n_part * 500).cast("bigint"))
    b = one("b", 700, 700, "l_tax").where(F.col("start") < n_part * 500).withColumn("end", F.least("end", F.lit(n_part * 500).cast("bigint")))
    return one("a", 500, 420, "l_quantity").unionByName(b), chroms


_TRACKS = """np AS (SELECT count(*) * 500 AS len FROM part), tr AS (SELECT chrom, track, k * st AS s, least(k * st + ln, CASE WHEN track = 'b' THEN len ELSE k * st + ln END) AS e,
   CASE WHEN n % 11 = 0 THEN NULL ELSE sqrt(q) END AS v FROM
  (SELECT 'chr' || (l_suppkey % 5) AS chrom, 'a' AS track, l_partkey AS k, 500 AS st, 420 AS ln, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY ALL
   UNION ALL SELECT 'chr' || (l_suppkey % 5), 'b', l_partkey, 700, 700, count(*), avg(l_tax) FROM lineitem GROUP BY ALL), np WHERE track = 'a' OR k * st < len)"""
_SEGS = f"""{_TRACKS}, lv AS (SELECT * FROM tr WHERE v IS NOT NULL), cs AS (SELECT DISTINCT chrom FROM tr),
  pt AS (SELECT chrom, s AS x FROM lv UNION SELECT chrom, e FROM lv UNION SELECT chrom, 0 FROM cs UNION SELECT chrom, len FROM cs, np),
  sg AS (SELECT chrom, x AS a, lead(x) OVER (PARTITION BY chrom ORDER BY x) AS b FROM pt),
  va AS (SELECT sg.chrom, sg.a, sg.b, lv.v FROM sg ASOF JOIN (SELECT * FROM lv WHERE track = 'a') lv ON sg.chrom = lv.chrom AND sg.a >= lv.s WHERE lv.e >= sg.b),
  vb AS (SELECT sg.chrom, sg.a, sg.b, lv.v FROM sg ASOF JOIN (SELECT * FROM lv WHERE track = 'b') lv ON sg.chrom = lv.chrom AND sg.a >= lv.s WHERE lv.e >= sg.b),
  seg AS (SELECT sg.chrom, sg.a AS start, sg.b AS "end", va.v IS NOT NULL AND vb.v IS NOT NULL AS valid, CASE WHEN vb.v IS NOT NULL THEN va.v END AS a, CASE WHEN va.v IS NOT NULL THEN vb.v END AS b
          FROM sg LEFT JOIN va ON sg.chrom = va.chrom AND sg.a = va.a LEFT JOIN vb ON sg.chrom = vb.chrom AND sg.a = vb.a WHERE sg.b IS NOT NULL)"""


@query(f"""WITH {_SEGS} SELECT chrom, start, "end", valid, a, b FROM seg""")
def common_segments(spark, d):
    t, s = tracks(spark, d)
    return I.common_segments(t, ["a", "b"], s)


@query(
    f"""WITH {_SEGS}, q AS (SELECT s_suppkey AS point_id, 'chr' || (s_suppkey % 5) AS chrom, h, greatest(p - h, 0) AS lo, least(p + h, len) AS hi
          FROM (SELECT s_suppkey, s_suppkey * 9973 % len AS p, len FROM supplier, np), (SELECT unnest([5000, 25000]) AS h)),
        j AS (SELECT point_id, q.chrom, h, hi - lo AS w, least("end", hi) - greatest(start, lo) AS ov, valid, a, b FROM q JOIN seg ON q.chrom = seg.chrom AND start < hi AND "end" > lo),
        g AS (SELECT point_id, chrom, h, max(w) AS w, coalesce(sum(ov) FILTER (valid), 0) AS t0, sum(ov * a) FILTER (valid) AS ta, sum(ov * b) FILTER (valid) AS tb FROM j GROUP BY 1, 2, 3)
       SELECT point_id, chrom, h, round(t0, 3) AS covered, round(t0 / w, 6) AS coverage, CASE WHEN round(t0 / w, 9) >= 0.5 THEN 'evaluable' ELSE 'insufficient_common_coverage' END AS status,
              round(CASE WHEN round(t0 / w, 9) >= 0.5 THEN ta / t0 END, 5) AS a, round(CASE WHEN round(t0 / w, 9) >= 0.5 THEN tb / t0 END, 5) AS b FROM g"""
)
def window_integrals(spark, d):
    t, s = tracks(spark, d)
    seg = I.common_segments(t, ["a", "b"], s)
    n_part = table(spark, d, "part").count()
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(
        k.alias("point_id"), F.concat(F.lit("chr"), (k % 5).cast("string")).alias("chrom"), (k * 9973 % (n_part * 500)).alias("pos")
    )
    w = I.window_integrals(seg, ["a", "b"], p, s, [5000, 25000], 0.5)
    return w.withColumns({"covered": F.round("covered", 3), "coverage": F.round("coverage", 6), "a": F.round("a", 5), "b": F.round("b", 5)})


@query(
    """WITH b AS (SELECT p_partkey AS id, p_brand AS part, p_partkey * 1000 AS pos, p_retailprice::DOUBLE AS f1, p_size::DOUBLE AS f2, p_retailprice / (1 + p_size) AS y, p_size = 50 AS anc FROM part),
        z AS (SELECT *, (f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER () AS z1, (f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER () AS z2 FROM b),
        j AS (SELECT a.id, a.y, c.id AS cid, c.y AS cy, (a.z1 - c.z1) ** 2 + (a.z2 - c.z2) ** 2 AS dist FROM z a JOIN z c ON a.part = c.part AND a.anc AND NOT c.anc AND abs(a.pos - c.pos) > 100000),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS rn, count(*) OVER (PARTITION BY id) AS n FROM j)
       SELECT z.id AS anchor_id, coalesce(max(n), 0) AS available, CASE WHEN coalesce(max(n), 0) >= 5 THEN 'matched' ELSE 'fewer_than_k_controls' END AS status,
              round(CASE WHEN max(n) >= 5 THEN max(z.y) - avg(cy) FILTER (rn <= 5) END, 6) AS matched_difference, round(CASE WHEN max(n) >= 5 THEN max(dist) FILTER (rn <= 5) END, 6) AS max_distance
       FROM z LEFT JOIN r ON z.id = r.id WHERE z.anc GROUP BY 1"""
)
def matched_controls(spark, d):
    p = table(spark, d, "part").withColumn("pos", F.col("p_partkey") * 1000).withColumn("y", F.col("p_retailprice") / (1 + F.col("p_size")))
    m = I.matched_controls(p, "p_partkey", "p_brand", "pos", ["p_retailprice", "p_size"], F.col("p_size") == 50, "y", 100_000)
    return m.withColumns({"matched_difference": F.round("matched_difference", 6), "max_distance": F.round("max_distance", 6)})
