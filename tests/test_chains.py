"""Correction chains against walking back one by one."""

from __future__ import annotations

import random
from collections import Counter

from lanewise.operators.chains import correction_chains, current_facts


def walked(parents):
    times = Counter(p for p in parents.values() if p in parents)
    out = {}
    for k in parents:
        at, depth = k, 0
        while parents[at] in parents and depth <= len(parents):
            at, depth = parents[at], depth + 1
        out[k] = (None, None, k not in times, True) if depth > len(parents) else (at, depth, k not in times, False)
    forked = {out[k][0] for k, n in times.items() if n > 1 and out[k][0] is not None}
    return {k: (fact, depth, latest, fact in forked, cycle) for k, (fact, depth, latest, cycle) in out.items()}


def test_chains_forks_and_cycles(spark):
    rnd = random.Random(4)
    parents = {k: k - 1 for k in range(1, 40)} | {0: None}  # one long chain
    parents |= {100 + k: (None if k == 0 else 100 + rnd.randrange(k)) if k % 3 else None for k in range(60)}  # trees
    parents |= {200: 202, 201: 200, 202: 201, 203: 202, 210: 210, 300: 999, 301: 300}  # circles, a way into one, a missing fact
    rows = [(k, p) for k, p in parents.items()]
    rnd.shuffle(rows)
    events = spark.createDataFrame(rows, "id long, supersedes_id long").repartition(4)
    got = {r["id"]: (r["fact_id"], r["depth"], r["is_latest"], r["is_forked"], r["in_cycle"]) for r in correction_chains(events).collect()}
    want = walked(parents)
    assert got == want and any(w[3] for w in want.values()) and sum(w[4] for w in want.values()) == 5
    assert {r["id"] for r in current_facts(events).collect()} == {k for k, w in want.items() if w[2] and not w[4]}
    assert correction_chains(events.limit(0)).count() == 0
