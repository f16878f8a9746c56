"""Column functions shared by the operators. All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------------
BOOLEAN_WORDS = ("true", "false", "yes", "no", "0", "1")
SEVERITIES = ("critical", "high", "medium", "low", "normal")
PASS_SCORE = 80
# every character Unicode counts as whitespace, plus the four ASCII separators
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# -------------------------------------------------------------------------------------

_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([\s\S]([01][0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9](\.[0-9]{3}|\.[0-9]{6})?)?)?"
    r"(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?)?)?$"
)
_MONTH = r"(1[0-2]|0?[1-9])"
_DAY = r"(3[01]|[12][0-9]|0?[1-9])"
_CLOCK = r"(2[0-3]|[01]?[0-9]):[0-5]?[0-9]:[0-5]?[0-9]"
# (digit-count guard, parse pattern) per accepted date layout
DATE_LAYOUTS = (
    (rf"^[0-9]{{4}}-{_MONTH}-{_DAY}$", "y-M-d"),
    (rf"^[0-9]{{4}}-{_MONTH}-{_DAY}T{_CLOCK}$", "y-M-d'T'H:m:s"),
    (rf"^[0-9]{{4}}-{_MONTH}-{_DAY}T{_CLOCK}Z$", "y-M-d'T'H:m:s'Z'"),
    (rf"^{_DAY}/{_MONTH}/[0-9]{{4}}$", "d/M/y"),
    (rf"^{_MONTH}/{_DAY}/[0-9]{{4}}$", "M/d/y"),
    (rf"^[0-9]{{4}}/{_MONTH}/{_DAY}$", "y/M/d"),
)


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``trim`` only removes spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def not_blank(c: Column) -> Column:
    return F.length(strip(c)) > 0


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def present(df: DataFrame, name: str) -> Column:
    """Not null and not NaN; a column the frame lacks is never present."""
    if not has_column(df, name):
        return F.lit(False)
    c = F.col(f"`{name}`")
    if isinstance(data_type(df, name), (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def is_int_text(stripped: Column) -> Column:
    return stripped.rlike(_INT)


def is_float_text(stripped: Column) -> Column:
    return stripped.rlike(_FLOAT)


def is_boolean_text(stripped: Column) -> Column:
    return F.lower(stripped).isin(*BOOLEAN_WORDS)


def is_date_text(stripped: Column) -> Column:
    """True when the text is a real date in one of ``DATE_LAYOUTS``."""
    parsed = [
        F.when(stripped.rlike(guard), F.try_to_timestamp(stripped, F.lit(pattern)))
        for guard, pattern in DATE_LAYOUTS
    ]
    return F.when(stripped.rlike("^[0-9]"), F.coalesce(*parsed).isNotNull()).otherwise(False)


def to_number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE, null where it is missing or not a number."""
    if not has_column(df, name):
        return F.lit(None).cast("double")
    c, dtype = F.col(f"`{name}`"), data_type(df, name)
    if isinstance(dtype, T.StringType):
        text = strip(c)
        number = F.when(is_float_text(text), text.try_cast("double"))
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        number = c.cast("double")
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(number), number)


def is_iso_text(c: Column) -> Column:
    """ISO-8601 date, or date and time with optional offset; the calendar day must exist."""
    day = F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))
    return F.coalesce(c.rlike(_ISO) & day.isNotNull(), F.lit(False))


def parse_iso(c: Column) -> Column:
    """ISO text to TIMESTAMP; text without an offset is read in the session zone (UTC)."""
    layouts = ("yyyy-M-d'T'H:m:sXXX", "yyyy-M-d'T'H:m:sXX", "yyyy-M-d'T'H:m:s", "yyyy-M-d")
    return F.when(
        c.rlike(r"^[0-9]{4}-"), F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in layouts])
    )


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def composite_key(*cols: Column) -> Column:
    return F.concat_ws("#", *[c.cast("string") for c in cols])


def stable_id(*cols: Column) -> Column:
    """An id that is the same on every run: the hash of the natural key."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return F.sha2(F.concat_ws("\x01", *parts), 256)


def truncate(c: Column, n: int) -> Column:
    return F.substring(strip(c), 1, n)


def valid_email(c: Column) -> Column:
    """Exactly one @, both sides non-empty, a dot in the domain."""
    parts = F.split(c, "@", -1)
    local, domain = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    ok = (F.size(parts) == 2) & (F.length(local) > 0) & domain.contains(".")
    return F.coalesce(ok, F.lit(False))


def target_fields(structured: Column) -> Column:
    """``targetFields`` of a rule definition held as JSON text; absent or broken gives []."""
    fields = F.from_json(F.get_json_object(structured, "$.targetFields"), "array<string>")
    return F.coalesce(fields, F.array().cast("array<string>"))


def fields_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def pair_key(a: Column, b: Column) -> Column:
    """Order-free id of a pair: the two ids in text order, joined by |."""
    a, b = a.cast("string"), b.cast("string")
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def clean_error(error: Column) -> Column:
    """Missing error counts as 0; NaN compares false everywhere, so it becomes 0 too."""
    return F.coalesce(F.nanvl(error, F.lit(0.0)), F.lit(0.0))


def severity(error: Column, threshold: float) -> Column:
    if not threshold > 0:
        raise ValueError("threshold must be a positive number")
    e = clean_error(error)
    return (
        F.when(e > threshold * 3, "critical")
        .when(e > threshold * 2, "high")
        .when(e > threshold * 1.5, "medium")
        .when(e > threshold, "low")
        .otherwise("normal")
    )


def is_anomaly(error: Column, threshold: float) -> Column:
    if not threshold > 0:
        raise ValueError("threshold must be a positive number")
    return clean_error(error) > threshold


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "green").when(score >= 70, "yellow").when(score.isNotNull(), "red")


def run_outcome(score: Column) -> Column:
    return F.when(score >= PASS_SCORE, "passed").when(score.isNotNull(), "failed")


def rate(part: Column, whole: Column) -> Column:
    """Percentage to two digits, 0 for an empty whole."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 2)).otherwise(F.lit(0.0))


def field_values(columns: list[str]) -> Column:
    """The record as MAP<STRING,STRING>; nulls stay null."""
    names = F.array(*[F.lit(c) for c in columns])
    values = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    return F.map_from_arrays(names, values)
