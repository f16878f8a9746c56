"""Pairs of rules, and of rules and fields: listed without holding them, and sent about as rows that grow with the rules."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablecheck.operators import conflicts, skew
from tests.test_scale_forms import RULES, pairs_of, some_registry, some_rules


def stages_of_explosions(df):
    """The whole-stage code, if any, of every explosion in the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(?:\*\((\d+)\) )?Generate explode\((?:transform\()?(\w+)", plan)



@pytest.mark.parametrize("asked", [False, True])
def test_expanded_rules_are_not_held_for_a_pair_of_packs(spark, asked):
    """Whole-stage code with both explosions held all rows of a pair of packs before it gave out the first."""
    _, _, t, f = some_registry(spark)
    rules = spark.createDataFrame([(*r[:3], r[0] % 14, r[0] % 210, *r[5:]) for r in some_rules(8, 100)], RULES)
    found = conflicts.expand_rules(rules, t, f, t.where("catalog_id in (1, 9)") if asked else None)
    stages = dict((column, stage) for stage, column in stages_of_explosions(found))
    assert stages["rule_id"] == "" and stages["place"] != ""



def test_packs_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(skew, "GRID_ROWS", 2)
    monkeypatch.setattr(skew, "PACK_ROWS", 5)
    monkeypatch.setattr(skew, "TASK_CELLS", 0.001)
    df = spark.range(400).select(F.lit(1).alias("k"), "id")
    rows = skew.pack_rows(df, df, ["k"])
    packs = skew.packed(df, ["k"], "id", rows).collect()
    assert sorted(i for p in packs for i in p["id"]) == list(range(400)) and max(len(p["id"]) for p in packs) < 20
    none = df.limit(0)
    assert skew.packed(none, ["k"], "id", skew.pack_rows(none, df, ["k"])).collect() == []


def few_sets(n, more=()):
    """Rules of two parents and few sets of fields."""
    fields = [["a"], ["b"], ["a", "b"], None]
    rows = [(i, ("catalog", "table", "column")[i % 3], i // 3 % 2, i // 3 % 2, None, "active", fields[i // 6 % 4]) for i in range(n)]
    return rows + list(more)


def sent(cells):
    """How many ids the pairs of packs hold."""
    return cells.agg(F.sum(F.size("a") + F.size("b"))).first()[0]


@pytest.mark.parametrize("kind", conflicts.KINDS, ids=lambda k: "-".join(k[:2]))
def test_packs_grow_with_the_pairs(spark, monkeypatch, kind):
    """Packs of one size were sent to a number of others that grows with the rules."""
    monkeypatch.setattr(skew, "GRID_ROWS", 3)
    monkeypatch.setattr(skew, "TASK_CELLS", 1, raising=False)
    ids = []
    for n in (480, 1920):
        data = few_sets(n)
        rules = spark.createDataFrame(data, RULES)
        cells = conflicts._cells(rules, kind)
        ids.append(sent(cells))
        assert cells.agg(F.sum(F.size("a") * F.size("b"))).first()[0] == len(pairs_of(data, kind))
    assert ids[1] < 7 * ids[0]  # four times the rules, sixteen times the pairs


def test_open_conflicts_of_large_packs_and_odd_rules(spark, monkeypatch):
    """Resolved pairs are taken out of the pairs of packs; rules that come twice or have no id stay."""
    monkeypatch.setattr(skew, "GRID_ROWS", 3)
    monkeypatch.setattr(skew, "TASK_CELLS", 1, raising=False)
    data = few_sets(240, [(None, "column", 1, 1, None, "active", ["a"]), (None, "column", 1, 1, None, "active", None), (500, "table", 1, 1, None, "active", ["b"])])
    twice = [(600, "column", 0, 0, None, "active", ["b"])] * 2
    rules = spark.createDataFrame(data + twice, RULES)
    key = lambda a, b: "|".join(sorted((str(a), str(b))))
    known = [(a, b) for kind in conflicts.KINDS for a, b in pairs_of(data, kind)]
    solved = sorted((a, b) for a, b in known if None not in (a, b) and (b == 1 or a % 9 == 0))
    resolutions = spark.createDataFrame(
        [(key(*p), str(p[0]), "me", datetime(2024, 1, 1)) for p in solved], "pair_key string, priority_rule_id string, resolved_by string, resolved_at timestamp")
    found = conflicts.conflicts_with_resolutions(rules, resolutions)
    rows = found.collect()
    got = sorted(((r["rule_a"], r["rule_b"], r["resolved"]) for r in rows), key=repr)
    want = []
    for kind in conflicts.KINDS:
        once = pairs_of(data, kind)
        copies = [p for p in pairs_of(data + twice, kind) if p[1] == 600] * 2
        # the two rules without an id have different fields, so a set of pairs names those who meet both only once
        nameless = [p for r in data if r[0] is None for p in pairs_of([x for x in data if x[0] is not None] + [r], kind) if p[1] is None]
        want += [(a, b, (a, b) in set(solved)) for a, b in [p for p in once if None not in p] + nameless + copies]
    assert got == sorted(want, key=repr)
    stages = [stage for stage, column in stages_of_explosions(found.select("rule_a", "rule_b")) if column == "b"]
    assert stages and all(stages)  # the filter of a pack kept its explosion out of whole-stage code
