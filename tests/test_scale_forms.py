"""Linear forms of conflicts, scopes, winners, joins and versions, against brute force and by their plans."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S
from tablecheck.operators import catalog, conflicts, reports, skew, state

RULES = "rule_id int, scope string, catalog_id int, table_id int, column_id int, status string, target_fields array<string>"


def some_rules(seed=7, n=300):
    rng = random.Random(seed)
    fields = [None, [], [None], ["a"], ["a", "b"], ["b", "c", "a"], ["d"], ["e", "e"], ["c", "b"]]
    return [
        (i, rng.choice(["catalog", "table", "column"]), rng.choice([1, 1, 1, 2, 3, None]), rng.choice([10, 11, 12, None]),
         rng.randrange(5), rng.choice(["active", "active", "draft"]), rng.choice(fields))
        for i in range(n)
    ]


def pairs_of(data, kind):
    first, second, parent = kind
    at = {"catalog_id": 2, "table_id": 3}[parent]
    out = set()
    for a in data:
        for b in data:
            if (a[1], b[1], a[5], b[5]) != (first, second, "active", "active") or a[at] is None or a[at] != b[at]:
                continue
            fa, fb = set(a[6] or []) - {None}, set(b[6] or []) - {None}
            if not fa or not fb or fa & fb:
                out.add((a[0], b[0]))
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [2, 100_000])
def test_conflict_groups_stand_for_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(skew, "PIECE_ROWS", piece)
    data = some_rules()
    rules = spark.createDataFrame(data, RULES)
    for kind in conflicts.KINDS:
        rows = conflicts.conflict_groups(rules, kind).collect()
        sides = {}
        for r in rows:
            sides.setdefault((r["parent_id"], r["match_key"]), {}).setdefault(r["scope"], []).append((r["rule_id"], r["links"]))
        met = set()
        for side in sides.values():
            firsts, seconds = side[kind[0]], side[kind[1]]
            assert {n for _, n in firsts} == {len(seconds)} and {n for _, n in seconds} == {len(firsts)}
            met |= {(a, b) for a, _ in firsts for b, _ in seconds}
        assert met == pairs_of(data, kind)
        assert len(rows) <= sum(len(set(d[6] or [])) + 2 for d in data)


def test_conflicts_of_each_rule_and_their_totals(spark):
    data = some_rules(8)
    rules = spark.createDataFrame(data, RULES)
    totals = {(r["a_scope"], r["b_scope"]): r["conflicts"] for r in conflicts.conflict_totals(rules).collect()}
    for kind in conflicts.KINDS:
        pairs = pairs_of(data, kind)
        want = {}
        for a, b in pairs:
            want.setdefault((a, kind[1]), []).append(b)
            want.setdefault((b, kind[0]), []).append(a)
        got = {(r["rule_id"], r["other_scope"]): (r["conflicts"], r["partner_id"]) for r in conflicts.rule_conflicts(rules, kind).collect()}
        assert got == {k: (len(v), min(v)) for k, v in want.items()}
        assert totals.get(kind[:2], 0) == len(pairs)
    assert conflicts.conflict_totals(rules.limit(0)).collect() == []


def test_resolutions_are_looked_up_from_their_side(spark):
    data = some_rules(9, 200)
    rules = spark.createDataFrame(data, RULES)
    rng = random.Random(1)
    every = {p: kind for kind in conflicts.KINDS for p in pairs_of(data, kind)}
    asked = rng.sample(sorted(every), 40) + [(rng.randrange(200), rng.randrange(200)) for _ in range(40)] + [(1, 9999)]
    rows = []
    for a, b in asked:
        key = "|".join(sorted((str(a), str(b))))
        rows += [(key, str(a), "old", datetime(2024, 1, 1)), (key, str(b), "new", datetime(2024, 2, 1)), (key, str(b), "none", None)]
    resolutions = spark.createDataFrame(rows, "pair_key string, priority_rule_id string, resolved_by string, resolved_at timestamp")
    found = conflicts.resolved_conflicts(rules, resolutions)
    keys = {"|".join(sorted((str(a), str(b)))) for a, b in asked}
    want = {p for p in every if "|".join(sorted(map(str, p))) in keys}
    assert {(r["rule_a"], r["rule_b"]) for r in found.collect()} == want and found.count() == len(want)
    assert {r["resolved_by"] for r in found.collect()} == {"new"}
    opened = {r["rule_id"]: (r["conflicts"], r["resolved"], r["open"]) for r in conflicts.open_conflicts(rules, resolutions).collect()}
    for rule, (all_, solved, left) in opened.items():
        assert (all_, solved) == (sum(rule in p for p in every), sum(rule in p for p in want)) and left == all_ - solved


def test_latest_of_ties_and_nulls_without_sorting_rows(spark):
    data = [
        (1, None, 5, "a"), (1, 2, None, "b"), (1, 2, 3, "c"), (2, None, None, "d"), (None, 1, 1, "e"), (None, 1, 2, "f"),
        (3, 7, 7, "same"), (3, 7, 7, "same"), (4, 1, 1, "x"), (4, 1, 1, "y"), (5, None, None, "p"), (5, None, None, "p"),
    ]
    df = spark.createDataFrame(data, "k int, at int, tie int, v string")
    latest = state.latest_per_key(df, ["k"], ["at", "tie"])
    got = {r["k"]: r["v"] for r in latest.collect()}
    assert latest.count() == 6 and got.pop(4) in "xy"
    assert got == {1: "c", 2: "d", None: "f", 3: "same", 5: "p"}
    assert "SortAggregate" not in plan_of(latest)
    with_map = df.withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    assert state.latest_per_key(with_map, ["k"], ["at", "tie"]).count() == 6
    assert state.latest_per_key(df.limit(0), ["k"], ["at"]).count() == 0


def test_latest_matches_a_window(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, *range(20)]), rng.choice([None, 1, 2, 3]), rng.choice([None, 1.0, float("nan")]), i) for i in range(500)]
    df = spark.createDataFrame(data, "k int, a int, b double, i int")
    latest = {r["k"]: tuple(r) for r in state.latest_per_key(df, ["k"], ["a", "b", "i"]).collect()}
    order = lambda r: tuple((x is not None, x != x, x if x == x and x is not None else 0) for x in r[1:])
    want = {}
    for r in data:
        if r[0] not in want or order(r) > order(want[r[0]]):
            want[r[0]] = r
    assert {k: v[3] for k, v in latest.items()} == {k: v[3] for k, v in want.items()}


def some_registry(spark):
    rng = random.Random(2)
    tables = [(t, rng.choice([1, 2, 3, None, 9])) for t in range(12)]
    fields = [(f, rng.randrange(14)) for f in range(200)]
    return (
        tables, fields, spark.createDataFrame(tables, "table_id int, catalog_id int"), spark.createDataFrame(fields, "field_id int, table_id int"),
    )


def test_scopes_are_intervals(spark):
    tables, fields, t, f = some_registry(spark)
    owner = dict(tables)
    labels = conflicts.scope_labels(t, f).collect()
    at = {int(r["node_id"]): r["lo"] for r in labels if r["level"] == "column"}
    assert sorted(at.values()) == list(range(len(at))) and set(at) == {x for x, y in fields if y in owner}
    inside = {"table": lambda x, n: x[1] == n, "catalog": lambda x, n: owner.get(x[1]) == n}
    for r in labels:
        if r["level"] != "column":
            mine = {at[x[0]] for x in fields if x[0] in at and inside[r["level"]](x, int(r["node_id"]))}
            assert mine == set(range(r["lo"], r["hi"]))


def test_rules_are_expanded_for_asked_tables_alone(spark):
    tables, fields, t, f = some_registry(spark)
    owner, data = dict(tables), some_rules(4, 100)
    data = [(*r[:3], r[0] % 14, r[0] % 210, *r[5:]) for r in data]
    rules = spark.createDataFrame(data, RULES)
    ranges = conflicts.rule_ranges(rules, conflicts.scope_labels(t, f))
    assert ranges.count() == ranges.select("rule_id").distinct().count() <= len(data)
    asked = spark.createDataFrame([(0,), (3,), (3,), (5,), (77,)], "table_id int")
    got = conflicts.expand_rules(rules, t, f, asked)
    want = set()
    for rule, scope, c, table, column, *_ in data:
        for x, y in fields:
            if y in owner and y in (0, 3, 5):
                applies = {"catalog": c is not None and owner[y] == c, "table": y == table, "column": x == column}[scope]
                if applies:
                    want.add((rule, scope, y, x))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("hot", ["left", "right", "both"])
def test_grid_join_cuts_hot_keys_of_either_side(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "PIECE_ROWS", 50)
    many = lambda side: [(0 if side in (hot, "left" if hot == "both" else "", "right" if hot == "both" else "") and i % 2 else i % 40, i) for i in range(800)]
    left = spark.createDataFrame(many("left"), "k int, l int")
    right = spark.createDataFrame(many("right"), "k int, r int")
    plain = left.join(right, "k").select("k", "l", "r")
    grid = skew.grid_join(left, right, ["k"], F.col("l"), F.col("r")).select("k", "l", "r")
    assert grid.count() == plain.count() and plain.exceptAll(grid).count() == 0
    pieces = {r["k"]: r["p"] for r in skew._pieces(left, ["k"], "p").collect()}
    if hot in ("left", "both"):
        assert pieces[0] == 9  # 410 rows in pieces of about 50


def test_hot_parents_keep_their_children(spark, monkeypatch):
    monkeypatch.setattr(skew, "PIECE_ROWS", 10)
    children = spark.createDataFrame([(i, 1 if i % 3 else i % 7) for i in range(300)] + [(1000, None)], "id int, parent int")
    parents = spark.createDataFrame([(1,), (1,), (2,), (5,)], "parent int")
    kept, lost = catalog.children_of(children, parents, "parent"), catalog.orphans(children, parents, "parent")
    assert kept.columns == lost.columns == children.columns
    assert sorted(r["id"] for r in kept.collect()) == [i for i in range(300) if (1 if i % 3 else i % 7) in (1, 2, 5)]
    assert kept.count() + lost.count() == 301 and kept.join(lost, "id", "left_semi").count() == 0


def test_version_content_stays_out_of_windows_and_aggregates(spark):
    rng = random.Random(6)
    data = [(k, v, rng.choice([None, None, f"{k}-{v}"]), f"t{v}") for k in range(3) for v in range(1, 40)]
    df = spark.createDataFrame(data, "report_id int, version int, content string, title string")
    done = reports.report_versions(df, block=7)
    assert done.columns == [*df.columns, "current_version", "next_version"]
    last, want = {}, {}
    for k, v, c, _ in data:
        last[k] = c if c is not None else last.get(k)
        want[k, v] = (last[k], 39, 40)
    assert {(r[0], r[1]): (r["content"], r["current_version"], r["next_version"]) for r in done.collect()} == want
    nodes = [x for x in plan_of(done).splitlines() if "Window" in x or "Aggregate" in x]
    assert nodes and not any("content#" in x and "__from_content" not in x for x in nodes)


def test_pair_key_is_what_resolutions_are_looked_up_by(spark):
    row = spark.range(1).select(S.pair_key(F.lit(10), F.lit(9)).alias("k")).first()
    assert row["k"] == "10|9"


def test_pairs_are_dealt_over_tasks_and_whole(spark, monkeypatch):
    """Few rows that make many pairs were one task: adaptive execution joined their small partitions."""
    monkeypatch.setattr(skew, "GRID_ROWS", 3)
    data = some_rules(6, 150)
    rules = spark.createDataFrame(data, RULES)
    busy = 0
    for kind in conflicts.KINDS:
        found = conflicts.conflicts(rules, kind)
        got = [(r["rule_a"], r["rule_b"]) for r in found.select("rule_a", "rule_b").collect()]
        assert len(got) == len(set(got)) and set(got) == pairs_of(data, kind)
        busy = max(busy, found.select(F.spark_partition_id()).distinct().count())
    assert busy > 2


def test_every_conflict_is_listed_with_its_resolution(spark, monkeypatch):
    monkeypatch.setattr(skew, "GRID_ROWS", 3)
    data = some_rules(7, 120)
    rules = spark.createDataFrame(data, RULES)
    pairs = sorted(p for kind in conflicts.KINDS for p in pairs_of(data, kind))
    solved = pairs[::3]
    key = lambda a, b: "|".join(sorted((str(a), str(b))))
    made = [(key(*p), str(p[0]), "me", n) for n, p in enumerate(solved)] + [("no|rule", "no", "me", 1)]
    resolutions = spark.createDataFrame(made, "pair_key string, priority_rule_id string, resolved_by string, resolved_at int")
    got = conflicts.conflicts_with_resolutions(rules, resolutions).collect()
    assert sorted((r["rule_a"], r["rule_b"]) for r in got) == pairs
    assert {(r["rule_a"], r["rule_b"]) for r in got if r["resolved"]} == set(solved)
    assert all((r["resolved_by"] == "me") == r["resolved"] and r["pair_key"] == key(r["rule_a"], r["rule_b"]) for r in got)


def test_rules_are_expanded_for_all_tables(spark, monkeypatch):
    monkeypatch.setattr(skew, "GRID_ROWS", 3)
    tables, fields, t, f = some_registry(spark)
    owner, data = dict(tables), some_rules(8, 100)
    data = [(*r[:3], r[0] % 14, r[0] % 210, *r[5:]) for r in data]
    got = conflicts.expand_rules(spark.createDataFrame(data, RULES), t, f)
    want = {
        (rule, scope, y, x) for rule, scope, c, table, column, *_ in data for x, y in fields
        if y in owner and {"catalog": c is not None and owner[y] == c, "table": y == table, "column": x == column}[scope]
    }
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert got.select(F.spark_partition_id()).distinct().count() > 2
