"""Cursor paging with nulls, named listings, and numbers in text compared exactly."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S
from tablecheck.functions.numberkeys import compared
from tablecheck.functions.rules import Rule
from tablecheck.operators import audit, listing
from tablecheck.operators.evaluate import rule_flags


@pytest.mark.parametrize("directions", [("asc", "desc"), ("desc", "asc")])
def test_cursors_walk_every_row_once(spark, directions):
    rng = random.Random(4)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, 2.25]), datetime(2024, 1, 1 + i % 9), i) for i in range(120)]
    df = spark.createDataFrame(data, "a int, b double, at timestamp, i int")
    order = [("a", directions[0]), ("b", directions[1]), ("at", directions[0]), ("i", "asc")]
    token, seen = None, []
    while page := listing.cursor_page(df, order, token, 25).collect():
        seen += [r["i"] for r in page]
        token = page[-1]["cursor"]
    keys = [F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in order]
    assert seen == [r["i"] for r in df.orderBy(*keys).collect()]
    pages = {r["page"]: r for r in listing.page_cursors(df, order, 25).collect()}
    assert [pages[k]["rows"] for k in range(1, 6)] == [25, 25, 25, 25, 20] and pages[5]["cursor"] == token


def test_a_token_of_something_else_begins_at_the_start(spark):
    df = spark.createDataFrame([(i, "x") for i in range(60)], "id int, t string")
    first = [r["id"] for r in listing.cursor_page(df, [("id", "asc")]).collect()]
    for bad in ("%%%", listing.encode_cursor({"id": 3}), listing.encode_cursor(["3", "4"]), listing.encode_cursor(["x"]), listing.encode_cursor([3])):
        assert [r["id"] for r in listing.cursor_page(df, [("id", "asc")], bad).collect()] == first
    after = listing.encode_cursor(["40"])
    assert [r["id"] for r in listing.cursor_page(df, [("id", "asc")], after).collect()] == list(range(41, 60))
    values = listing.cursor_values(listing.cursor_column(["id", "t"]), df, ["id", "t"])
    assert df.select("id", *[v.alias(f"read_{k}") for k, v in enumerate(values)]).where("id <> read_0 or read_1 <> 'x'").count() == 0


def test_audit_pages_hold_fifty(spark):
    rows = [(i, datetime(2024, 1, 1 + i % 28)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, timestamp timestamp")
    token, sizes = None, []
    while page := audit.audit_page(df, token).collect():
        sizes.append(len(page))
        token = page[-1]["cursor"]
    assert sizes == [50, 50, 20]
    assert len(audit.audit_page(df, None, 500).collect()) == 100


def test_named_listings(spark):
    people = spark.createDataFrame([("a", ["x@y.z"], None, "me"), ("b", None, None, None)], "event_type string, recipients array<string>, updated_at timestamp, updated_by string")
    assert [(r["event_type"], r["emails"]) for r in listing.list_recipients(people).collect()] == [("a", ["x@y.z"]), ("b", [])]
    assert listing.list_recipients(people, "c").collect() == [] and listing.list_recipients(people, "b").count() == 1
    templates = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "template_id int, name string")
    links = spark.createDataFrame([(1, 7), (1, 7), (3, 7), (9, 7), (2, 8)], "template_id int, catalog_id int")
    assert [r["template_id"] for r in listing.list_templates(templates, links, 7).collect()] == [1, 3]
    assert listing.list_templates(templates, links).count() == 3 and listing.list_templates(templates, links, 1).count() == 0
    tables = spark.createDataFrame([(2, 1), (1, 1), (3, None)], "table_id int, catalog_id int")
    assert [r["table_id"] for r in listing.list_tables(tables, 1).collect()] == [1, 2] and listing.list_tables(tables).count() == 3
    assert listing.list_fields(spark.createDataFrame([(1, 5), (2, 6)], "field_id int, table_id int"), 5).count() == 1


def number_texts(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    base = rng.choice(["9007199254740993", "0", "00", "1", digits(40), digits(3), "999999999999999999999999999999999999999"])
    part = rng.choice(["", ".", ".0", ".5", ".500", ".49999999999999999999999", "." + digits(4)])
    power = rng.choice(["", "", "e0", "E5", "e-5", "e+17", "e-40", "e400", "e-400"])
    return rng.choice(["", "", "-", "+"]) + base + part + power


def test_numbers_in_text_compare_like_decimals(spark):
    rng = random.Random(9)
    texts = [number_texts(rng) for _ in range(300)] + ["inf", "-Infinity", "nan", "x", None, " 7 ", ".5", "-0", "1e99999999999999999999", "-1e99999999999999999999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for bound in (0, 2**53 + 1, Decimal("9007199254740993.5"), Decimal("-0.5"), 0.1, 10**39, Decimal("1e400"), float("-inf"), Decimal("999999999999999999999999999999999999999.5")):
        exact = Decimal(repr(bound)) if isinstance(bound, float) else Decimal(bound)
        got = {r[0]: r[1] for r in df.select("i", compared(F.col("t"), S.to_number(df, "t"), bound)).collect()}
        for i, t in enumerate(texts):
            if t in (None, "x", "nan"):
                assert got[i] is None
            elif "99999999999999999999" not in t or "e9" not in t:
                n = Decimal(t.strip())
                assert got[i] == (n > exact) - (n < exact), (t, bound)
    far = {r["t"]: r["c"] for r in df.where("t like '%1e999%'").select("t", compared(F.col("t"), S.to_number(df, "t"), 10**400).alias("c")).collect()}
    assert far == {"1e99999999999999999999": 1, "-1e99999999999999999999": -1}


def test_rules_tell_fractions_past_2_to_53_apart(spark):
    df = spark.createDataFrame([(1, "9007199254740993.5"), (2, "9007199254740993.50001"), (3, "9007199254740994")], "i int, t string")
    rule = lambda op, v: Rule("r", "", conditions=({"field": "t", "operator": op, "value": v},))
    held = lambda op, v: [r["i"] for r in rule_flags(df, [rule(op, v)]).where("r").orderBy("i").collect()]
    assert held("less_than", "9007199254740994") == [1, 2] and held("greater_than", "9007199254740993.5") == [2, 3]
    assert held("between", "9007199254740993.5,9007199254740993.50001") == [1, 2]
