"""Fact stores, conjunctive rules, reachability and proofs.

Rules are Python objects over fact tables; each body is a chain of equi-joins that
Catalyst orders and AQE re-plans. Recursion is semi-naive: only the newest rows join
again, every round is written to shared storage, so lineage stays flat.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import dealt, stage


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Literal:
    relation: str
    terms: tuple


@dataclass(frozen=True)
class Rule:
    rule_id: str
    head: Literal
    body: tuple


def fact_rows(df: DataFrame, relation: str, args: Sequence[str], source: str) -> DataFrame:
    return df.select(
        F.lit(relation).alias("relation"),
        F.array(*[F.col(a).cast("string") for a in args]).alias("args"),
        F.col(source).cast("string").alias("source"),
    )


def fact_union(*parts: DataFrame) -> DataFrame:
    """Set union by (relation, args); the part listed first provides the provenance."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    all_rows = tagged[0]
    for t in tagged[1:]:
        all_rows = all_rows.unionByName(t)
    return dealt(["args"], all_rows)[0].groupBy("relation", "args").agg(F.min_by("source", F.struct("__part", "source")).alias("source"))


def project_relations(facts: DataFrame, relations: Sequence[str]) -> DataFrame:
    return facts.where(F.col("relation").isin(*relations))


def store_report(facts: DataFrame) -> DataFrame:
    """Rows, distinct-argument width and text size per relation."""
    return facts.groupBy("relation").agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.max(F.size("args")).cast("bigint").alias("arity"),
        F.sum(F.length(F.array_join("args", "|"))).alias("n_chars"),
    )


def relation_view(facts: DataFrame, relation: str, names: Sequence[str]) -> DataFrame:
    return facts.where(F.col("relation") == relation).select(*[F.col("args")[i].alias(n) for i, n in enumerate(names)])


def _bind(table: DataFrame, literal: Literal, distinct: bool) -> DataFrame:
    """Constants and repeated variables become filters; variables become columns."""
    conds, cols, seen = [], [], {}
    for name, term in zip(table.columns, literal.terms, strict=True):
        if isinstance(term, Var):
            if term.name in seen:
                conds.append(F.col(name) == F.col(seen[term.name]))
            else:
                seen[term.name] = name
                cols.append(F.col(name).alias(term.name))
        else:
            conds.append(F.col(name) == F.lit(term))
    for c in conds:
        table = table.where(c)
    out = table.select(*cols)
    return out.distinct() if distinct else out


def apply_rule(rule: Rule, tables: Mapping[str, DataFrame], with_proof: bool = False) -> DataFrame:
    """Natural join of the body on shared variables, projected to the distinct head.

    Variables of one name have one type. Derivations travel as the values of their variables; facts are put together
    from them for the chosen ones only.
    """
    joined, bound = None, set()
    for lit in rule.body:
        part = _bind(tables[lit.relation], lit, not with_proof)
        names = {t.name for t in lit.terms if isinstance(t, Var)}
        if joined is None:
            joined = part
        else:
            shared = sorted(bound & names)
            if not shared:
                raise ValueError(f"{rule.rule_id}: literal {lit.relation} shares no variable; order the body so it does")
            joined = joined.join(part, shared)
        bound |= names
    head_names = tables[rule.head.relation].columns if rule.head.relation in tables else [f"a{i}" for i in range(len(rule.head.terms))]
    head = [(F.col(t.name) if isinstance(t, Var) else F.lit(t)).alias(n) for t, n in zip(rule.head.terms, head_names, strict=True)]
    if not with_proof:
        return joined.select(*head).distinct()
    # The smallest derivation wins: a stable choice where any one proof is enough. All derivations have the same relations
    # and constants, so the order of their facts is that of their variables as they first occur.
    order = list(dict.fromkeys(t.name for lit in rule.body for t in lit.terms if isinstance(t, Var)))
    least = F.min(F.struct(F.lit(0).alias("__"), *[f"__v_{v}" for v in order])).alias("__v")
    value = lambda t: F.col(f"__v.__v_{t.name}") if isinstance(t, Var) else F.lit(t).cast("string")
    facts = [F.struct(F.lit(lit.relation).alias("relation"), F.array(*[value(t) for t in lit.terms]).alias("args")) for lit in rule.body]
    return joined.select(*head, *[F.col(v).cast("string").alias(f"__v_{v}") for v in order]).groupBy(*head_names).agg(least).select(*head_names, F.lit(rule.rule_id).alias("rule_id"), F.array(*facts).alias("premises"))


def evaluate(rules: Sequence[Rule], tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Least fixed point of positive rules; every derived relation gets its round.

    A round applies each rule once per recursive body literal with only the last round's new
    rows in that place. Rules without recursion run once, after the relations they read.
    """
    derived = {r.head.relation for r in rules}
    names = {}
    for r in rules:
        names.setdefault(r.head.relation, [f"a{i}" for i in range(len(r.head.terms))])
    state: dict[str, DataFrame] = {}
    delta: dict[str, DataFrame] = {}
    for round_no in count():
        fresh: dict[str, list[DataFrame]] = {}
        for r in rules:
            recursive = [i for i, lit in enumerate(r.body) if lit.relation in derived]
            if round_no == 0:
                if not recursive:
                    fresh.setdefault(r.head.relation, []).append(_head(r, tables, names))
                continue
            for i in recursive:
                if r.body[i].relation not in delta:
                    continue
                view = {**tables, **state}
                if any(lit.relation not in view for lit in r.body):
                    continue
                fresh.setdefault(r.head.relation, []).append(_head(_with_delta(r, i), {**view, "__delta": delta[r.body[i].relation]}, names))
        delta = {}
        for rel, parts in fresh.items():
            new = parts[0]
            for p in parts[1:]:
                new = new.unionByName(p)
            new = new.distinct()
            if rel in state:
                new = new.join(state[rel].drop("round"), names[rel], "left_anti")
            new = stage(new.withColumn("round", F.lit(round_no)), "delta")
            if not new.isEmpty():
                delta[rel] = new.drop("round")
                state[rel] = new if rel not in state else state[rel].unionByName(new)
        if not delta:
            return state


def _with_delta(rule: Rule, i: int) -> Rule:
    body = list(rule.body)
    body[i] = Literal("__delta", body[i].terms)
    # The small new rows lead the join chain.
    return Rule(rule.rule_id, rule.head, (body[i], *body[:i], *body[i + 1 :]))


def _head(rule: Rule, tables: Mapping[str, DataFrame], names: Mapping[str, list[str]]) -> DataFrame:
    plain = {k: (v.drop("round") if "round" in v.columns else v) for k, v in tables.items()}
    out = apply_rule(rule, plain)
    return out.toDF(*names[rule.head.relation])


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth): shortest depth of every node reachable from each start, start excluded.

    Output is bounded by starts x nodes. Each round joins the newest frontier to the edges and
    drops what is already known.
    """
    # Written once; an edge that is there twice does no harm, since every step is made distinct.
    e = stage(edges.select("src", "dst"), "edges")
    frontier = starts.select(F.col("node").alias("start"), F.col("node")).distinct()
    seen = stage(frontier.withColumn("depth", F.lit(0)), "reach")
    frontier = seen.select("start", "node")
    for depth in count(1):
        step = (
            frontier.join(e, frontier["node"] == e["src"])
            .select("start", F.col("dst").alias("node"))
            .distinct()
            .join(seen.select("start", "node"), ["start", "node"], "left_anti")
        )
        new = stage(step.withColumn("depth", F.lit(depth)), "reach")
        if new.isEmpty():
            return seen.where("depth > 0")
        seen = seen.unionByName(new)
        frontier = new.select("start", "node")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def proof_sources(proofs: DataFrame, facts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Walk each proof's premises to the source digests of the facts they rest on."""
    flat = proofs.select(*key, "rule_id", F.posexplode("premises").alias("step", "f"))
    j = flat.select(*key, "rule_id", "step", "f.relation", "f.args").join(facts, ["relation", "args"])
    return j.groupBy(*key, "rule_id").agg(
        F.count(F.lit(1)).alias("n_premises"), F.min("source").alias("first_source"), F.max("source").alias("last_source")
    )
