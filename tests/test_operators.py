import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecheck.functions import ruletext
from tablecheck.operators import audit, catalog, clean, conflicts, diff, lint, listing, metrics, notify, profile
from tablecheck.operators import quantile, reports, retention, rows, skew, state


# ---- profiling ----------------------------------------------------------------------


def infer(spark, columns, scope="full"):
    names = list(columns)
    length = max(len(v) for v in columns.values())
    data = [tuple(columns[n][i] if i < len(columns[n]) else None for n in names) for i in range(length)]
    df = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    return {r["column_name"]: r["inferred_type"] for r in profile.infer_column_types(df, names, scope).collect()}


def test_type_precedence(spark):
    dates = ["2024-01-05", "5/1/2024", "2024/1/2", "2024-01-01T10:00:00"]
    got = infer(
        spark,
        {
            "zero_one": ["0", "1", " 1 "], "words": ["Yes", "NO", "true"], "ints": ["0", "7"], "signed": ["+5", "-3"],
            "floats": ["1", "2.5"], "nan": ["nan", "1"], "dates": dates, "mostly": dates + ["soon"], "half": ["2024-01-05", "soon"],
            "blank": ["", "  ", None], "text": ["a", "1"], "mixed": ["true", "2"],
        },
    )
    assert got == {
        "zero_one": "boolean", "words": "boolean", "ints": "integer", "signed": "integer", "floats": "float", "nan": "float",
        "dates": "date", "mostly": "date", "half": "string", "blank": "string", "text": "string", "mixed": "string",
    }


def test_preview_scope_samples_the_first_twenty(spark):
    late = ["2024-01-05"] * 20 + ["later"] * 30
    assert infer(spark, {"v": late}, "preview") == {"v": "date"}
    assert infer(spark, {"v": late}) == {"v": "string"}


def test_schema_check(spark):
    df = spark.createDataFrame([("1", "yes", "2024-01-05", None), ("x", "no", "soon", "a")], "n string, b string, d string, s string")
    template = [
        {"field_name": "n", "field_type": "number", "required": True}, {"field_name": "b", "field_type": "boolean"},
        {"field_name": "d", "field_type": "date"}, {"field_name": "s", "field_type": "string", "required": True},
        {"field_name": "gone", "field_type": "string", "required": False},
    ]
    got = {r["field_name"]: (r["null_count"], r["bad_count"], r["in_dataset"], r["ok"]) for r in profile.check_schema(df, template).collect()}
    assert got == {"n": (0, 1, True, False), "b": (0, 0, True, True), "d": (0, 1, True, False), "s": (1, 0, True, False), "gone": (2, 0, False, True)}
    with pytest.raises(ValueError):
        profile.check_schema(df, [{"field_name": "n", "field_type": "decimal"}])


def test_previews(spark, tmp_path):
    df = spark.range(250).select("id", (F.col("id") % 2 == 0).alias("even"), F.current_timestamp().alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    df.drop("at").coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    p = profile.preview_parquet(spark, str(tmp_path / "p"))
    assert (p["total_preview_rows"], p["column_types"]) == (100, {"id": "integer", "even": "boolean", "at": "datetime"})
    c = profile.preview_csv(spark, str(tmp_path / "c"))
    assert (c["total_preview_rows"], c["column_types"]) == (100, {"id": "integer", "even": "boolean"})
    assert c["rows"].first()["id"] == "0"


# ---- percentiles and positions ------------------------------------------------------


@pytest.mark.parametrize("sortable", [5, 50_000])
@pytest.mark.parametrize(
    "name,values",
    [
        ("spread", [random.Random(1).random() for _ in range(5000)]),
        ("third_is_one_value", [1.0] * 1700 + [random.Random(2).gauss(1, 1) for _ in range(3300)]),
        ("all_equal", [2.5] * 1000),
        ("edge", [0.0] * 950 + [9.0] * 50),
        ("few", [3.0, 1.0]),
        ("one", [4.0]),
    ],
)
def test_exact_percentile(spark, monkeypatch, name, values, sortable):
    monkeypatch.setattr(quantile, "SORTABLE", sortable)
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "e double").cache()
    for p in (50, 95, 100):
        assert quantile.exact_percentile(df, "e", p) == pytest.approx(float(np.percentile(values, p)), rel=1e-12)


def test_percentile_when_the_approximation_is_poor(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SORTABLE", 3)
    monkeypatch.setattr(quantile, "ACCURACY", 10)
    values = [random.Random(5).expovariate(1) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "e double").repartition(6).cache()
    assert quantile.exact_percentile(df, "e", 95) == pytest.approx(float(np.percentile(values, 95)), rel=1e-12)
    assert quantile.exact_percentile(df.where("false"), "e") is None


def test_row_index_and_split(spark):
    data = [(i % 7, i) for i in range(1003)]
    df = spark.createDataFrame(random.Random(3).sample(data, len(data)), "a int, b int").repartition(5)
    got = {(r["a"], r["b"]): r["row_index"] for r in rows.with_row_index(df, ["a", "b"]).collect()}
    assert got == {key: i for i, key in enumerate(sorted(data))}
    head, tail = rows.split_ordered(df, ["a", "b"])
    assert sorted(map(tuple, head.collect())) == sorted(data)[: int(1003 * 0.8)]
    assert tail.count() == 1003 - int(1003 * 0.8)


@pytest.mark.parametrize("sortable", [3, 50_000])
def test_split_by_predicate(spark, monkeypatch, sortable):
    monkeypatch.setattr(quantile, "SORTABLE", sortable)
    rng = random.Random(9)
    data = list({(rng.choice([None, 1, 2, 3]), rng.randrange(2**60, 2**60 + 50), rng.choice([None, 0.5, float("nan")])) for _ in range(900)})
    df = spark.createDataFrame(data, "a int, b long, c double").repartition(4).cache()
    rank = lambda v: (v is not None, 0 if v is None else 1 if v == v else 2)
    ranked = sorted(data, key=lambda r: ((r[0] is not None, r[0] or 0), r[1], rank(r[2])))
    for share in (0, 0.3, 0.8, 0.99, 1):
        head, tail = rows.split_ordered(df, ["a", "b", "c"], share)
        assert head.count() + tail.count() == len(data)
        assert sorted(map(str, map(tuple, head.collect()))) == sorted(map(str, ranked[: int(len(data) * share)]))


def test_split_with_ties_and_text_uses_positions(spark):
    tied = spark.createDataFrame([(i // 10, str(i)) for i in range(100)], "a int, s string")
    head, tail = rows.split_ordered(tied, ["a"], 0.55)
    assert (head.count(), tail.count()) == (55, 45)
    head, tail = rows.split_ordered(tied, ["s"], 0.5)
    assert sorted(r["s"] for r in head.collect()) == sorted(str(i) for i in range(100))[:50]


# ---- skew ---------------------------------------------------------------------------


def test_hot_keys_are_few_and_counts_whole(spark):
    rng = random.Random(4)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(2000)}" if i % 5 else None, i) for i in range(9000)]
    df = spark.createDataFrame(data, "k string, i int").repartition(8)
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert skew.hot_keys(counts).count() < skew.HOT_SHARE
    n = {}
    for k, _ in data:
        n[k] = n.get(k, 0) + 1
    got = {r["i"]: r["c"] for r in skew.add_counts(df, ["k"], "c").collect()}
    assert got == {i: (n[k] if k is not None else None) for k, i in data}


@pytest.mark.parametrize("piece", [10, 100_000])
def test_split_hot_join_equals_plain_join(spark, monkeypatch, piece):
    monkeypatch.setattr(skew, "PIECE_ROWS", piece)
    left = spark.createDataFrame([(0 if i % 3 == 0 else i % 50, i) for i in range(3000)], "k int, l int")
    right = spark.createDataFrame([(i % 60, i) for i in range(240)], "k int, r int")
    plain = left.join(right, "k").select("k", "l", "r").exceptAll
    split = skew.split_hot_join(left, right, ["k"], F.col("l")).select("k", "l", "r")
    assert plain(split).count() == 0 and split.count() == left.join(right, "k").count()


# ---- conflicts ----------------------------------------------------------------------


def brute_conflicts(data):
    out = set()
    for first, second, parent in conflicts.KINDS:
        at = {"catalog_id": 2, "table_id": 3}[parent]
        for a in data:
            for b in data:
                if a[1] != first or b[1] != second or a[5] != "active" or b[5] != "active":
                    continue
                if a[at] is None or a[at] != b[at]:
                    continue
                fa, fb = set(a[6] or []) - {None}, set(b[6] or []) - {None}
                if not fa or not fb or fa & fb:
                    out.add((a[0], b[0]))
    return out


@pytest.mark.parametrize("piece", [2, 100_000])
def test_conflicts_match_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(skew, "PIECE_ROWS", piece)
    rng = random.Random(7)
    data = []
    for i in range(400):
        fields = rng.choice([None, [], [None], ["a"], ["a", "b"], ["b", "c", "a"], ["d"], ["e", "e"]])
        data.append((
            i, rng.choice(["catalog", "table", "column"]), rng.choice([1, 1, 1, 2, 3, None]), rng.choice([10, 11, 12, None]),
            rng.randrange(5), rng.choice(["active", "active", "draft"]), fields,
        ))
    rules = spark.createDataFrame(
        data, "rule_id int, scope string, catalog_id int, table_id int, column_id int, status string, target_fields array<string>"
    )
    got = [(r["rule_a"], r["rule_b"]) for r in conflicts.all_conflicts(rules).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_conflicts(data)


def test_resolution_of_three_rules_covers_every_pair(spark):
    rules = spark.createDataFrame([(1, "active"), (2, "active"), (3, "draft"), (4, "active")], "rule_id int, status string")
    updated, rows_ = conflicts.resolve_conflict(rules, [1, 2, 3], 2, "me", datetime(2024, 1, 1))
    assert {r["rule_id"]: r["status"] for r in updated.collect()} == {1: "overridden", 2: "active", 3: "overridden", 4: "active"}
    got = {r["pair_key"]: (r["priority_rule_id"], sorted(r["overridden_rule_ids"])) for r in rows_.collect()}
    assert got == {k: ("2", ["1", "3"]) for k in ("1|2", "1|3", "2|3")}
    found = spark.createDataFrame([("1|3", 1, 3), ("4|5", 4, 5)], "pair_key string, rule_a int, rule_b int")
    joined = {r["pair_key"]: (r["resolved"], r["resolved_by"]) for r in conflicts.with_resolutions(found, rows_).collect()}
    assert joined == {"1|3": (True, "me"), "4|5": (False, None)}
    for ids, winner in (([1], 1), ([1, 2], 9)):
        with pytest.raises(ValueError):
            conflicts.resolve_conflict(rules, ids, winner, "me", None)


def test_active_rules_refuse_an_empty_run(spark):
    rules = spark.createDataFrame(
        [(1, "active", "d1", None), (2, "active", None, "d1"), (3, "draft", "d1", None), (4, "active", "d2", None)],
        "rule_id int, status string, dataset_id string, scope_target string",
    )
    assert {r["rule_id"] for r in conflicts.active_rules(rules, "d1").collect()} == {1, 2}
    with pytest.raises(ValueError):
        conflicts.active_rules(rules, "d3")


# ---- diff, state, versions ----------------------------------------------------------


def test_row_diff(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "c", float("nan")), (4, "d", 4.0)], "k int, s string, v double")
    after = spark.createDataFrame([(1, "a", 1.0), (2, "x", 2.5), (3, "c", float("nan")), (5, "e", 5.0)], "k int, s string, v double")
    d = diff.row_diff(before, after, ["k"])
    got = {r["k"]: (r["change"], r["changed_columns"]) for r in d.collect()}
    assert got == {1: ("unchanged", []), 2: ("modified", ["s", "v"]), 3: ("unchanged", []), 4: ("removed", []), 5: ("added", [])}
    s = diff.cleaning_summary(d).first().asDict()
    assert s == dict(total_records=4, modified_records=1, unchanged_records=2, error_records=0, output_records=4, added_records=1, removed_records=1)
    assert diff.cleaning_summary(d, "shape").first()["modified_records"] == 2
    smaller = diff.cleaning_summary(diff.row_diff(before, after.where("k < 3"), ["k"]), "shape").first()
    assert (smaller["modified_records"], smaller["unchanged_records"], smaller["error_records"]) == (2, 0, 2)
    wider = diff.row_diff(before, before.withColumn("z", F.when(F.col("k") == 1, 1)), ["k"])
    assert {r["k"]: r["change"] for r in wider.collect()} == {1: "modified", 2: "unchanged", 3: "unchanged", 4: "unchanged"}


def test_state_operators(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, at int, v string")
    latest = state.latest_per_key(df, ["k"], ["at"])
    assert sorted(map(tuple, latest.collect())) == [(1, 2, "b"), (2, 1, None)]
    changes = spark.createDataFrame([(2, 5, "x"), (2, 6, "y"), (3, 1, "z")], "k int, at int, v string")
    assert sorted(map(tuple, state.upsert(latest, changes, ["k"], ["at"]).collect())) == [(1, 2, "b"), (2, 6, "y"), (3, 1, "z")]
    assert [r["k"] for r in state.delete_keys(latest, changes, ["k"]).collect()] == [1]
    patch = spark.createDataFrame([(1, None, "new")], "k int, at int, v string")
    assert sorted(map(tuple, state.update_columns(latest, patch, ["k"], ["at", "v"]).collect())) == [(1, 2, "new"), (2, 1, None)]


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_forward_fill_across_blocks(spark, block):
    rng = random.Random(block)
    data = [(k, v, rng.choice([None, None, None, f"{k}-{v}"]), None) for k in "ab" for v in range(1, 30)]
    df = spark.createDataFrame(data, "report_id string, version int, content string, title string")
    got = {(r[0], r[1]): r[2] for r in reports.forward_fill(df, "report_id", "version", ["content", "title"], block).collect()}
    last, expected = None, {}
    for k, v, content, _ in data:
        last = content if content is not None else (None if v == 1 else last)
        expected[k, v] = last
    assert got == expected


def test_report_edit_and_publish(spark):
    ddl = "report_id int, version int, title string, content string, edited_by string, edited_at timestamp"
    versions = spark.createDataFrame([(1, 1, "t", "c1", "x", None), (1, 2, "t", "c2", "x", None), (2, 1, "u", "d", "x", None)], ddl)
    edits = spark.createDataFrame(
        [(1, None, "new", "me", None), (2, None, None, "me", None), (9, None, "lost", "me", None)],
        "report_id int, title string, content string, edited_by string, edited_at timestamp",
    )
    assert [tuple(r)[:4] for r in reports.edit_report(versions, edits).select("report_id", "version", "content", "title").collect()] == [(1, 3, "new", "t")]
    made = spark.createDataFrame([(1, "draft", None, None), (2, "published", None, None)], "id int, status string, published_at timestamp, updated_at timestamp")
    updated, refused = reports.publish_report(made, spark.createDataFrame([(1,), (2,), (3,)], "id int"), datetime(2024, 1, 1))
    assert {r["id"]: (r["status"], r["published_at"]) for r in updated.collect()} == {1: ("published", datetime(2024, 1, 1)), 2: ("published", None)}
    assert {r["id"]: r["reason"] for r in refused.collect()} == {2: "not a draft", 3: "not found"}
    assert [r["version"] for r in reports.version_list(versions, 1).collect()] == [2, 1]


# ---- listings -----------------------------------------------------------------------


def test_keyset_pages_cover_everything_once(spark):
    data = [(i % 5, i) for i in range(63)]
    df = spark.createDataFrame(data, "a int, b int")
    seen, after = [], None
    while True:
        page = listing.keyset_page(df, [("a", "desc"), ("b", "asc")], after, 20).collect()
        if not page:
            break
        seen += [tuple(r) for r in page]
        after = [page[-1]["a"], page[-1]["b"]]
    assert seen == sorted(data, key=lambda r: (-r[0], r[1]))
    with pytest.raises(ValueError):
        listing.keyset_page(df, [("a", "asc")], [1, 2])


def test_page_size_and_cursor():
    assert [listing.page_size(x) for x in (None, "7", 0, 500, "x")] == [20, 7, 1, 100, 20]
    token = listing.encode_cursor({"a": 1, "t": "x"})
    assert listing.decode_cursor(token) == {"a": 1, "t": "x"} and listing.decode_cursor("%%%") is None


def test_offset_pages_of_numbers_text_and_ties(spark):
    df = spark.createDataFrame([(i, f"t{i:03}", 7) for i in range(300)], "v int, t string, same int").repartition(4)
    for order in (["v"], ["t"], ["same", "v"]):
        assert [r["v"] for r in listing.offset_page(df, order, 6, 25).collect()] == list(range(125, 150))
        assert [r["v"] for r in listing.offset_page(df, order, 1, 25).collect()] == list(range(25))
        assert listing.offset_page(df, order, 99, 25).count() == 0
    tied = [r["v"] for p in range(1, 4) for r in listing.offset_page(df.where("v < 70"), ["same"], p, 30).collect()]
    assert len(tied) == 70
    assert tuple(listing.total_pages(df.where("false"), 20).first()) == (0, 1)


def test_search_sort_and_listing(spark):
    df = spark.createDataFrame([(1, "Alpha", None), (21, "beta", "x"), (3, None, "ALPHABET")], "id int, name string, note string")
    assert {r["id"] for r in listing.search_any(df, "alPHA").collect()} == {1, 3}
    assert {r["id"] for r in listing.search_any(df, "1").collect()} == {1, 21}
    assert [r["id"] for r in listing.sort_as_text(df, "id").collect()] == [1, 21, 3]
    assert [r["id"] for r in listing.sort_as_text(df, "name", "desc").collect()] == [21, 1, 3]
    made = df.withColumn("created_at", F.col("id")).withColumn("owner", F.lit("o"))
    assert [r["id"] for r in listing.list_catalogs(made, name="pha").collect()] == [1]
    assert [r["id"] for r in listing.list_catalogs(made, name="ALPHA", ignore_case=True).collect()] == [1]
    assert [r["id"] for r in listing.list_catalogs(made, owner="o", after=2, before=21).collect()] == [21, 3]
    runs = spark.createDataFrame([(1, None, None)], "run_id int, rule_ids array<int>, details map<string,string>")
    assert tuple(listing.run_detail(runs, 1).first()) == (1, [], {})
    assert listing.lookup(runs, run_id=2).count() == 0


def test_rule_listing_order(spark):
    data = [(1, "column", "active", 3), (2, "catalog", "draft", 9), (3, "catalog", "active", 1), (4, "else", "active", 0), (5, "table", "active", None)]
    rules = spark.createDataFrame(data, "rule_id int, scope string, status string, created_at int")
    assert [r["rule_id"] for r in listing.list_rules(rules).collect()] == [3, 2, 5, 1, 4]
    assert [r["rule_id"] for r in listing.list_rules(rules, scope="bogus", status="active").collect()] == [3, 5, 1, 4]
    assert [r["rule_id"] for r in listing.list_rules(rules, scope="catalog").collect()] == [3, 2]


# ---- metrics ------------------------------------------------------------------------


def test_metrics_without_runs_or_scores(spark):
    ddl = "run_id int, dataset_id string, status string, score double, started_at timestamp"
    span = (datetime(2024, 1, 1), datetime(2024, 2, 1))
    none = metrics.run_metrics(spark.createDataFrame([], ddl), *span).first()
    assert (none["total_runs"], none["average_score"], none["pass_rate"]) == (0, None, None)
    unscored = spark.createDataFrame([(1, "d", "completed", None, datetime(2024, 1, 5))], ddl)
    assert tuple(metrics.run_metrics(unscored, *span).first()) == (1, 0.0, 0, 0, 0.0, 0.0)
    mixed = spark.createDataFrame(
        [(1, "d", "completed", 80.0, span[0]), (2, "d", "completed", 79.99, span[1]), (3, "d", "failed", 99.0, span[0]), (4, "d", "completed", 1.0, datetime(2024, 2, 2))], ddl)
    assert tuple(metrics.run_metrics(mixed, *span).first()) == (2, 80.0, 1, 1, 50.0, 50.0)


def test_ranking_is_ordered_and_broken_by_id(spark):
    data = [(f"d{i}", float(s)) for i, s in enumerate([50, 90, 90, 70, 10, 10, 60])] + [("none", None)]
    got = metrics.dataset_ranking(spark.createDataFrame(data, "dataset_id string, score double"), 3).collect()
    rank = lambda n: [(r["position"], r["dataset_id"]) for r in sorted(got, key=lambda r: r["position"]) if r["ranking"] == n]
    assert rank("highest") == [(1, "d1"), (2, "d2"), (3, "d3")]
    assert rank("lowest") == [(1, "d4"), (2, "d5"), (3, "d0")]


def test_period_change_values(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 84.0, 62), (datetime(2024, 2, 1), 87.0, 47), (datetime(2024, 4, 1), 1.0, 1)], "period timestamp, score double, n int")
    got = {r["period"].month: r for r in metrics.period_change(df, ["score", "n"]).collect()}
    assert (got[2]["score_change"], got[2]["score_change_pct"], got[2]["n_change_pct"]) == (3.0, 3.57, -24.19)
    assert got[1]["score_previous"] is None and got[4]["score_previous"] is None


# ---- catalog, audit, notifications, lints -------------------------------------------


def test_association_and_cascade(spark):
    tables = spark.createDataFrame([(1, None), (2, 7)], "table_id int, catalog_id int")
    catalogs = spark.createDataFrame([(5,), (7,)], "catalog_id int")
    pairs = spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "table_id int, catalog_id int")
    accepted, updated, rejected = catalog.associate(tables, catalogs, pairs)
    assert [tuple(r) for r in accepted.collect()] == [(1, 5)]
    assert sorted(map(tuple, updated.collect())) == [(1, 5), (2, 7)]
    assert {r["table_id"]: r["reason"] for r in rejected.collect()} == {2: "catalog not found", 3: "table not found"}
    kept, links = catalog.cascade_delete(tables, accepted, spark.createDataFrame([(1,)], "table_id int"), "table_id")
    assert [r["table_id"] for r in kept.collect()] == [2] and links.count() == 0
    assert [r["table_id"] for r in catalog.orphans(pairs, catalogs, "catalog_id").collect()] == [2]


def test_audit_prunes_months(spark, tmp_path):
    changes = spark.createDataFrame([(i, datetime(2024, 1 + i % 4, 10)) for i in range(40)], "i int, at timestamp")
    made = audit.audit_rows(changes, F.lit("u"), F.lit("update"), F.lit("rule"), F.col("i"), F.col("at"))
    made.write.partitionBy("year_month").parquet(str(tmp_path / "audit"))
    table = spark.read.parquet(str(tmp_path / "audit"))
    found = audit.audit_by_time(table, datetime(2024, 2, 1), datetime(2024, 3, 31), resource_type="rule")
    assert found.count() == 20
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    assert "year_month" in scan.split("PartitionFilters: ")[1]
    assert len({r["id"] for r in made.collect()}) == 40
    for bad in (dict(action="read"), dict(resource_type="user"), dict(start=datetime(2024, 2, 1), end=datetime(2024, 1, 1))):
        with pytest.raises(ValueError):
            audit.check_filters(**bad)


def test_fanout(spark):
    events = spark.createDataFrame([(1, "report_publication"), (2, "other"), (3, "validation_completion")], "id int, event_type string")
    config = spark.createDataFrame([("report_publication", ["a@b.c", "d@e.f"]), ("other", ["x@y.z"])], "event_type string, recipients array<string>")
    got = notify.notify_fanout(events, config, F.col("id"), F.lit(datetime(2024, 1, 1))).collect()
    assert {(r["event_id"], r["recipient"]) for r in got} == {("1", "a@b.c"), ("1", "d@e.f")}
    with pytest.raises(ValueError):
        notify.notify_fanout(events, config.union(config).union(config).union(config), F.col("id"), F.lit(None))


def errors_of(df, fn):
    return [r["errors"] for r in fn(df).collect()]


def test_lints(spark):
    long = "x" * 501
    cats = spark.createDataFrame([("ok", "me", None), (" ", None, long), ("n" * 101, "me", "d")], "name string, owner string, description string")
    assert errors_of(cats, lint.lint_catalogs) == [
        [], ["name: required", "owner: required", "description: longer than 500"], ["name: longer than 100"]]
    valid, rejected = lint.split_valid(lint.lint_catalogs(cats))
    assert valid.count() == 1 and rejected.count() == 2
    assert errors_of(spark.createDataFrame([("n" * 200,), ("n" * 201,)], "name string"), lint.lint_tables) == [[], ["name: longer than 200"]]
    fields = spark.createDataFrame([("a", "Number "), (None, None), ("b", "decimal")], "name string, field_type string")
    assert errors_of(fields, lint.lint_fields) == [[], ["name: required", "field_type: required"], ["field_type: not a known type"]]
    rules = spark.createDataFrame(
        [("text", "catalog", "c", None, None, "simple", "draft"), (long, "column", "c", None, None, "odd", "gone"), (None, "row", None, None, None, None, None)],
        "natural_language string, scope string, catalog_id string, table_id string, column_id string, template_category string, status string")
    assert errors_of(rules, lint.lint_rules) == [
        [],
        ["natural_language: longer than 500", "table_id: required for this scope", "column_id: required for this scope",
         "template_category: not a known category", "status: not a known status"],
        ["natural_language: required", "scope: not a known scope", "catalog_id: required"]]
    people = spark.createDataFrame([("report_publication", ["a@b.c"]), ("x", ["bad"]), ("report_publication", ["a@b.c"] * 21)], "event_type string, recipients array<string>")
    assert errors_of(people, lint.lint_recipients) == [
        [], ["event_type: not a known type", "recipients: an address is not valid"], ["recipients: more than 20"]]
    jobs = spark.createDataFrame([((None, 5, None, 64),), ((0.001, 100, 32, 16),)], "hyperparameters struct<learningRate:double,epochs:int,batchSize:int,encodingDimension:int>")
    linted = lint.lint_training_jobs(jobs).collect()
    assert [r["errors"] for r in linted] == [["epochs: not between 10 and 500"], []]
    assert tuple(linted[0]["hyperparameters"]) == (0.001, 5, 32, 64)
    templates = spark.createDataFrame([("t", [("a", "number", True)]), ("t", [("", "number", True)]), ("t", [("a", "uuid", None)])],
                                      "name string, fields array<struct<field_name:string,field_type:string,required:boolean>>")
    assert [len(e) for e in errors_of(templates, lint.lint_templates)] == [0, 1, 1]


# ---- cleaning -----------------------------------------------------------------------


def test_cleaning_plan(spark):
    df = spark.createDataFrame([(" A@B.C ", None, 20.0), (" A@B.C ", None, 20.0), ("x@y.z", "Z", 200.0), ("q", "Q", None)], "email string, name string, age double")
    steps = clean.plan_steps(
        ["Duplicate rows found", "inconsistent case in email", "missing values in name", "outliers in age"],
        {"age": {"lo": 0, "hi": 150}},
    )
    assert [s for s, _ in steps] == ["drop_duplicate_rows", "normalize_text", "fill_nulls", "drop_out_of_range"]
    assert [tuple(r) for r in clean.clean(df, clean.compile_steps(steps)).collect()] == [("a@b.c", "Unknown", 20.0)]
    assert clean.plan_steps(["outliers in age"]) == []
    for bad in (lambda: clean.plan_steps(["bad weather"]), lambda: clean.compile_steps([("fly", {})])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises((TypeError, AssertionError)):
        clean.clean(df, lambda d: 5)


def test_row_local_pandas_code(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    out = clean.clean(df, lambda d: clean.row_local(d, lambda p: p.assign(s=p.s.str.upper())))
    assert sorted(map(tuple, out.collect())) == [(1, "A"), (2, "B")]


# ---- rule text ----------------------------------------------------------------------

BODY = '{"type": "pattern", "conditions": [{"field": "a", "operator": "equals", "value": 5}], "targetFields": ["a", "b"], "expectedBehavior": "x", "parameters": {"k": 1}}'


def test_rule_text(spark):
    texts = {
        "bare": BODY, "json_fence": f"Sure:\n```json\n{BODY}\n```\nbye", "fence": f"```\n{BODY}\n```", "prose": f"It is {BODY} ok",
        "broken": BODY[:-1], "none": "no rule", "empty": "", "two": f"{BODY} and {BODY}", "odd_type": '{"type": "magic", "targetFields": "a", "conditions": "x", "parameters": [1]}',
        "single_quotes": "{'type': 'pattern'}",
    }
    df = spark.createDataFrame(list(texts.items()), "k string, text string")
    got = {r["k"]: r["definition"] for r in ruletext.parse_rule_text(df, "text").collect()}
    for k in ("bare", "json_fence", "fence", "prose"):
        d = got[k]
        assert (d["type"], d["targetFields"], d["expectedBehavior"], d["parameters"]) == ("pattern", ["a", "b"], "x", {"k": "1"}), k
        assert tuple(d["conditions"][0]) == ("a", "equals", "5", None)
    assert all(got[k] is None for k in ("broken", "none", "empty", "two", "single_quotes"))
    assert tuple(got["odd_type"]) == ("simple", [], ["a"], "", {})


def test_rule_preview(spark):
    many = '{"type": "cross_field", "targetFields": ["a","b","c","d"], "conditions": [' + ",".join(
        f'{{"field": "f{i}", "operator": "equals", "value": "{i}"}}' for i in range(7)) + "]}"
    df = spark.createDataFrame([(many, "table", "c", "t", None), ("{}", "column", "c", "t", "k")], "text string, scope string, catalog_id string, table_id string, column_id string")
    a, b = ruletext.preview_rules(ruletext.parse_rule_text(df, "text")).collect()
    assert a["rule_name"] == "Cross Field Rule on a, b, c (+1 more)"
    assert a["conditions_summary"] == "; ".join(f"f{i} equals {i}" for i in range(5)) + " (+2 more conditions)"
    assert a["target_scope"] == "Table 't' in catalog 'c'"
    assert (b["rule_name"], b["conditions_summary"], b["target_scope"]) == ("Simple Rule", "No specific conditions defined", "Column 'k' in table 't'")


# ---- retention ----------------------------------------------------------------------


def test_purge_table(spark, tmp_path):
    path = str(tmp_path / "t")
    data = [(i, datetime(2024, 1 + i % 4, 1 + i % 28)) for i in range(112)]
    df = spark.createDataFrame(data, "i int, ts timestamp").withColumn("year_month", F.date_format("ts", "yyyy-MM"))
    df.write.partitionBy("year_month").parquet(path)
    touched = retention.purge_table(spark, path, "year_month", "ts", datetime(2024, 4, 14), 30)
    assert touched == 3  # January and February deleted, March rewritten
    left = {r["i"] for r in spark.read.parquet(path).collect()}
    assert left == {i for i, ts in data if ts >= datetime(2024, 3, 15)}
    assert {r["i"] for r in retention.purge_expired(df, "ts", datetime(2024, 4, 14), 30).collect()} == left
    assert retention.drop_prefix(spark, path) > 0 and retention.drop_prefix(spark, path) == 0


