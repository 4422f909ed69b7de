"""Contact pipeline against dense numpy, rules against a naive evaluator, streams against batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta import session
from attesta.operators import aggregates as AG
from attesta.operators import contacts as C
from attesta.operators import graph as G
from attesta.operators import joins as J
from attesta.operators.audit import append_only_diff, chain_violations, file_manifest, manifest_diff, top_digest
from attesta.session import fresh_path, stage


def dense_balance(m, min_nnz):
    keep = ((m != 0).sum(1) >= min_nnz) & (m.sum(1) > 0)
    while True:
        bad = m[np.ix_(keep, keep)].sum(1) <= 0
        if not bad.any():
            break
        keep[np.flatnonzero(keep)[bad]] = False
    w = m[np.ix_(keep, keep)].astype(float)
    for _ in range(200):
        s = w.sum(1) / w.sum(1).mean()
        w = w / s[:, None] / s[None, :]
        if abs(s - 1).max() < 1e-5:
            break
    return w, keep


def test_contact_pipeline_matches_dense(spark):
    rng = np.random.default_rng(2)
    n = 24
    side = np.where(np.arange(n) // 4 % 2 == 0, 1, -1)
    lam = 8 * np.exp(-abs(np.subtract.outer(np.arange(n), np.arange(n))) / 9) * (1 + 0.6 * np.outer(side, side))
    m = np.triu(rng.poisson(lam))
    m = m + np.triu(m, 1).T
    m[5] = m[:, 5] = 0
    m[5, 6] = m[6, 5] = 2  # too few entries
    m[0, n - 1] = m[n - 1, 0] = 0  # the farthest diagonal has no signal
    rows = [("c1", i, j, float(m[i, j])) for i in range(n) for j in range(i, n) if m[i, j]]
    df = spark.createDataFrame(rows, "chrom string, i bigint, j bigint, w double")
    b, bias = C.balance(df, ["chrom"], 10)
    b = stage(b)
    w, keep = dense_balance(m, 10)
    idx = np.flatnonzero(keep)
    assert {r.i for r in bias.collect()} == set(idx.tolist()) and 5 not in idx
    back = {v: k for k, v in enumerate(idx)}
    for r in b.collect():
        assert r.w == pytest.approx(w[back[r.i], back[r.j]], rel=1e-6)
    sums = [r.s for r in C.mirrored(b, ["chrom"]).groupBy("i").agg(F.sum("w").alias("s")).collect()]
    assert max(sums) / min(sums) == pytest.approx(1, abs=1e-4)

    mask = bias.select("chrom", "i")
    oe = stage(C.observed_over_expected(b, mask, ["chrom"]))
    full = np.full((n, n), np.nan)
    full[np.ix_(keep, keep)] = w
    want = np.full((n, n), np.nan)
    for d in range(n):
        i = np.arange(n - d)
        ok = keep[i] & keep[i + d]
        e = full[i[ok], i[ok] + d].mean() if ok.any() else 0
        for k in i[ok]:
            want[k, k + d] = want[k + d, k] = full[k, k + d] / e if e > 0 else 1.0
    got = np.zeros((n, n))
    for r in oe.collect():
        got[r.i, r.j] = got[r.j, r.i] = r.oe
    assert np.allclose(got[np.ix_(keep, keep)], want[np.ix_(keep, keep)], atol=1e-6)

    pc = C.leading_eigenvector(oe, mask, ["chrom"])
    val, vec = np.linalg.eigh(np.corrcoef(want[np.ix_(keep, keep)]))
    lead = vec[:, -1] / vec[:, -1].std()
    lead = lead if lead.sum() >= 0 else -lead
    have = {r.i: r for r in pc.collect()}
    v = np.array([have[k].pc1 for k in idx])
    assert abs(np.corrcoef(v, lead)[0, 1]) > 0.999
    assert have[idx[0]].eigen_share == pytest.approx(val[-1] / len(idx), rel=1e-3)
    assert abs(np.corrcoef(v, side[idx])[0, 1]) > 0.8


def test_recursion_rounds_and_depth(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "b"), ("x", "y")]
    e = spark.createDataFrame(edges, "src string, dst string")
    V = G.Var
    rules = (
        G.Rule("base", G.Literal("path", (V("x"), V("y"))), (G.Literal("edge", (V("x"), V("y"))),)),
        G.Rule("step", G.Literal("path", (V("x"), V("z"))), (G.Literal("path", (V("x"), V("y"))), G.Literal("path", (V("y"), V("z"))))),
    )
    got = {(r.a0, r.a1) for r in G.evaluate(rules, {"edge": e})["path"].collect()}
    want = set(edges)
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    assert got == want
    depth = {r.node: r.depth for r in G.reach(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert depth == {"b": 1, "c": 1, "d": 2}


def test_strict_join_refuses(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(J.Refused):
        J.strict_map_join(left, spark.createDataFrame([(1, "a")], "k int, v string"), "k")


def test_presence_threshold_is_strict(spark):
    rows = [(f, lib, n) for f, n in (("edge", 26), ("above", 27)) for lib in "abcd"]
    c = spark.createDataFrame(rows, "feature string, library string, n bigint")
    t = spark.createDataFrame([(lib, 100_000_000) for lib in "abcd"], "library string, total bigint")
    got = {r.feature: r.kept for r in AG.presence_filter(c, "feature", "library", "n", t).collect()}
    assert got == {"edge": False, "above": True}


def test_verdict_precedence(spark):
    cols = "n_primary int, n_placebo int, n_independent int, n_self int, p1 boolean, p2 boolean, p3 boolean, p4 boolean, p5 boolean"
    rows = [
        ((0, 1, 1, 1, True, True, True, True, True), "NOT_EVALUABLE"), ((1, 1, 1, 1, True, False, True, True, False), "UNDERPOWERED"),
        ((1, 1, 1, 1, True, False, True, True, True), "PLACEBO_BREACH"), ((1, 1, 1, 1, True, True, True, True, True), "CROSS_PLATFORM_REPLICATED"),
        ((1, 1, 1, 1, True, True, False, True, True), "PARTIAL_REPLICATION"), ((1, 1, 1, 1, False, True, True, True, True), "LOW_YIELD"),
    ]
    df = spark.createDataFrame([r for r, _ in rows], cols)
    assert [r.verdict for r in AG.study_verdict(df).collect()] == [v for _, v in rows]
    assert AG.study_verdict(df, "rnai").collect()[4].verdict == "RNAI_REPLICATED"


def test_chain_and_ledger(spark):
    rows = [("j", 1, None, "h1", 10), ("j", 2, "h1", "h2", 20), ("j", 3, "h1", "h3", 15), ("j", 5, "h4", "h5", 30)]
    e = spark.createDataFrame(rows, "k string, seq int, prev string, h string, at int")
    got = {(r.seq, r.rule) for r in chain_violations(e, "k", "seq", "prev", "h", "at", F.concat(F.lit("h"), F.col("seq"))).collect()}
    assert got == {(3, "previous"), (3, "time"), (5, "sequence"), (5, "previous")}
    s = "id int, kind string, users array<string>, status string"
    before = spark.createDataFrame([(1, "a", ["x"], "open"), (2, "a", ["x", "y"], "open"), (3, "a", [], "open")], s)
    after = spark.createDataFrame([(1, "a", ["x", "z"], "spent"), (2, "b", ["y", "x"], "closed"), (4, "n", [], "open")], s)
    bad = {(r.id, r.rule) for r in append_only_diff(before, after, "id", ["kind"], ["users"], "status", [("open", "spent")]).collect()}
    assert bad == {(2, "changed:kind"), (2, "rewritten:users"), (2, "status"), (3, "removed")}


def test_file_manifest(spark):
    path = fresh_path(spark, "files")
    spark.range(10).write.parquet(path)
    m = stage(file_manifest(spark, path))
    assert m.count() >= 1 and {r.status for r in manifest_diff(m, file_manifest(spark, path)).collect()} == {"ok"}
    assert top_digest(m).first().digest == top_digest(m.orderBy(F.col("path").desc())).first().digest


def test_write_once_refuses_second_write(spark):
    from attesta.sources.sinks import write_once

    path = fresh_path(spark, "once")
    df = spark.createDataFrame([(1, float("inf"))], "a int, b double")
    write_once(df, path, ["a", "b"])
    with pytest.raises(Exception, match="(?i)exist"):
        write_once(df, path, ["a", "b"])
    assert spark.read.schema("a int, b double").option("sep", "\t").option("header", "true").csv(path).first().b is None


def test_rounds_do_not_shuffle_the_matrix(spark):
    rows = [("x", i, j, float(1 + (i * j) % 5)) for i in range(30) for j in range(i, 30)]
    m = spark.createDataFrame(rows, "chrom string, i long, j long, w double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.balance(m, ["chrom"], 10)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rows = spark.range(5000).select(F.lit("r").alias("relation"), F.array(F.col("id").cast("string")).alias("args"), F.lit("s").alias("source"))
    assert G.fact_union(rows).rdd.getNumPartitions() >= 50
    a, b = session.dealt(["id"], spark.range(3000), spark.range(2000))
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 50


def test_derivations_travel_without_their_facts(spark):
    t = {"e": spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "d"), ("d", "c")], "x string, y string")}
    rule = G.Rule("two", G.Literal("p", (G.Var("x"), G.Var("z"))), (G.Literal("e", (G.Var("x"), G.Var("y"))), G.Literal("e", (G.Var("y"), G.Var("z")))))
    got = G.apply_rule(rule, t, with_proof=True)
    assert [(r.a0, r.a1, r.rule_id, [(f.relation, f.args) for f in r.premises]) for r in got.collect()] == [("a", "c", "two", [("e", ["a", "b"]), ("e", ["b", "c"])])]
    assert "min(struct(rule_id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_reach_reads_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "src string, dst string").mapInArrow(counted, "src string, dst string")
    got = {r.node: r.depth for r in G.reach(edges, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert got == {f"n{i}": i for i in range(1, 6)} and seen.value == 5
