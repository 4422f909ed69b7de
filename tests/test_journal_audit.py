"""Budget audit against a sequential pass over random journals."""

import random

from attesta.operators import audit as Q

ACTIVE = ("reserved", "submitting", "submitted", "uncertain")
DOUBT = ("uncertain", "submitting")
BUDGET = 60


def sequential(rows):
    """(broken rules, totals by run) of rows (run, seq, task, kind, est, act, fin, br) in order."""
    broken, totals, run_state = [], {}, {}
    for run, seq, task, kind, est, act, fin, br in sorted(rows):
        r = run_state.setdefault(run, {"spent": 0, "held": 0, "breach": False, "tasks": {}})
        t = r["tasks"].setdefault(task, {"status": None, "est": 0})
        before, allowed = t["status"], Q.TASK_BEFORE[kind]
        if (before is not None) if kind == "proposed" else before not in allowed:
            broken.append((run, seq, "state"))
        if kind in ("proposed", "revised"):
            t["est"] = est
        if kind == "admitted":
            if r["breach"] or any(x["status"] in DOUBT for x in r["tasks"].values()):
                broken.append((run, seq, "unresolved"))
            if r["spent"] + r["held"] + t["est"] > BUDGET:
                broken.append((run, seq, "budget"))
            r["held"] += t["est"] if before == "proposed" else 0
        if kind == "settled":
            exceeds = act > t["est"] or r["spent"] + act > BUDGET
            if fin not in Q.TASK_ENDS:
                broken.append((run, seq, "final"))
            if br != exceeds:
                broken.append((run, seq, "breach"))
            r["breach"] |= exceeds
            r["spent"] += act
            r["held"] -= t["est"] if before in ACTIVE else 0
        t["status"] = fin if kind == "settled" else Q.TASK_STATES[kind]
        totals[run] = (r["spent"], r["held"], any(x["status"] in DOUBT for x in r["tasks"].values()), r["breach"], len(r["tasks"]), BUDGET - r["spent"] - r["held"])
    return sorted(broken), totals


def test_budget_audit_equals_a_sequential_pass(spark):
    draw, rows = random.Random(3), []
    for run in ("a", "b"):
        where = {}
        for seq in range(300):
            task = f"t{draw.randint(0, 9)}"
            nxt = {None: "proposed", "proposed": "admitted", "admitted": "dispatch", "dispatch": "observed", "observed": "settled", "settled": "retried", "retried": "admitted"}
            kind = nxt.get(where.get(task), "settled") if draw.random() < 0.85 else draw.choice(list(Q.TASK_BEFORE))
            where[task] = kind
            rows.append((run, seq, task, kind, draw.randint(1, 9), draw.randint(0, 7 if run == "a" else 1), draw.choice(["completed", "failed", "cancelled", "odd"]), draw.random() < 0.2))
    df = spark.createDataFrame(rows, "run string, seq int, task string, kind string, est int, act int, fin string, br boolean").repartition(6)
    broken, totals = Q.budget_audit(df, "run", "seq", "task", "kind", "est", "act", "fin", "br", BUDGET)
    want, sums = sequential(rows)
    assert sorted(map(tuple, broken.collect())) == want and {rule for *_, rule in want} == {"state", "final", "unresolved", "budget", "breach"}
    got = {r.run: (r.spent, r.reserved, r.uncertain, r.breached, r.tasks, r.remaining) for r in totals.collect()}
    assert got == sums
