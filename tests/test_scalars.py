from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_strip_and_blank(spark):
    text = ["  a b\t", " x ", "\x1c\n", "", "ok", None]
    got = values(spark, [(t,) for t in text], "v string", S.strip(F.col("v")), S.not_blank(F.col("v")))
    expected = [(t.strip(), bool(t.strip())) if t is not None else (None, None) for t in text]
    assert got == expected


def test_whitespace_set_is_the_python_one():
    assert set(S.WHITESPACE) == {chr(c) for c in range(0x10000) if chr(c).isspace()}


LADDER = {
    # text: (integer, float, date)
    "0": (True, True, False), "12345": (True, True, False), "+5": (True, True, False), "1_000": (False, False, False),
    "1d": (False, False, False), "nan": (False, True, False), "1e5": (False, True, False), ".5": (False, True, False),
    "5.": (False, True, False), "-inf": (False, True, False), "2024-01-05": (False, False, True),
    "2024-1-5": (False, False, True), "24-01-05": (False, False, False), "5/1/2024": (False, False, True),
    "13/1/2024": (False, False, True), "1/13/2024": (False, False, True), "13/13/2024": (False, False, False),
    "2024-02-30": (False, False, False), "2024/2/9": (False, False, True), "2024-01-01T10:00:00": (False, False, True),
    "2024-01-01T10:00:00Z": (False, False, True), "2024-01-01T25:00:00": (False, False, False), "x": (False, False, False),
}


def test_type_ladder(spark):
    v = F.col("v")
    got = values(spark, [(t,) for t in LADDER], "v string", v, S.is_int_text(v), S.is_float_text(v), S.is_date_text(v))
    assert {g[0]: g[1:] for g in got} == LADDER


@pytest.mark.parametrize(
    "text,ok",
    [("2024-01-05", True), ("2024-01-05T10:20:30", True), ("2024-01-05 10:20", True), ("2024-01-05T10:20:30.123", True),
     ("2024-01-05T10:20:30Z", True), ("2024-01-05T10:20:30+02:00", True), ("2024-02-30", False), ("2024-1-5", False),
     ("05/01/2024", False), (" 2024-01-05", False), ("", False), (None, False)],
)
def test_iso_text(spark, text, ok):
    assert values(spark, [(text,)], "v string", S.is_iso_text(F.col("v"))) == [(ok,)]


def test_parse_iso(spark):
    rows = [("2024-01-15",), ("2024-01-15T10:00:00Z",), ("2024-01-15T10:00:00+02:00",), ("2024-01-15T10:00:00",), ("soon",)]
    got = [r[0] for r in values(spark, rows, "v string", S.parse_iso(F.col("v")))]
    assert got == [datetime(2024, 1, 15), datetime(2024, 1, 15, 10), datetime(2024, 1, 15, 8), datetime(2024, 1, 15, 10), None]


def test_email(spark):
    forms = {"a@b.c": True, "a@b": False, "a@@b.c": False, "@b.c": False, "a@": False, "": False, None: False, "a@b.c@d.e": False}
    got = values(spark, [(f,) for f in forms], "v string", S.valid_email(F.col("v")))
    assert [g[0] for g in got] == list(forms.values())


def test_severity_boundaries(spark):
    t = 0.5
    rows = [(0.5,), (0.50001,), (0.75,), (0.76,), (1.0,), (1.1,), (1.5,), (1.6,), (float("nan"),), (None,), (-1.0,)]
    got = values(spark, rows, "e double", S.severity(F.col("e"), t), S.is_anomaly(F.col("e"), t))
    names = ["normal", "low", "low", "medium", "medium", "high", "high", "critical", "normal", "normal", "normal"]
    assert got == [(n, n != "normal") for n in names]
    with pytest.raises(ValueError):
        S.severity(F.col("e"), 0)


def test_rates_bands_keys(spark):
    rows = [(1, 3, "b", "a", 95.0), (0, 0, "a", "b", 70.0), (2, 2, "9", "10", None)]
    got = values(
        spark, rows, "p long, w long, a string, b string, s double", S.rate(F.col("p"), F.col("w")),
        S.pair_key(F.col("a"), F.col("b")), S.score_band(F.col("s")), S.run_outcome(F.col("s")),
    )
    assert got == [(33.33, "a|b", "green", "passed"), (0.0, "a|b", "yellow", "failed"), (100.0, "10|9", None, None)]


def test_target_fields_and_overlap(spark):
    rows = [('{"targetFields": ["a", "b"]}', ["b"]), ("{broken", ["b"]), (None, ["b"]), ('{"targetFields": []}', [None])]
    got = values(
        spark, rows, "j string, o array<string>", S.target_fields(F.col("j")),
        S.fields_overlap(S.target_fields(F.col("j")), F.col("o")),
    )
    assert got == [(["a", "b"], True), ([], False), ([], False), ([], False)]


def test_ids_and_text(spark):
    got = values(
        spark, [(1, None, "  a long text ", datetime(2024, 3, 1, 5))], "a int, b string, c string, t timestamp",
        S.stable_id(F.col("a"), F.col("b")) == S.stable_id(F.lit(1), F.lit(None)),
        S.stable_id(F.col("a"), F.col("b")) == S.stable_id(F.lit(1), F.lit("")),
        S.truncate(F.col("c"), 6), S.year_month(F.col("t")), S.composite_key(F.col("a"), F.col("c")),
    )
    assert got == [(True, False, "a long", "2024-03", "1#  a long text ")]
