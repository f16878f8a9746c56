"""Rules as boolean Columns.

A rule is a list of structured conditions, or, without conditions, one of six template
checks over its target fields. Missing input (null, NaN, or a column the frame lacks) fails
the check.

Inside a rule a check on a null may be null. Checks are only joined by AND and OR, where null
and false act alike, so ``rule_column`` turns null into false once, at the top: the smaller
the expressions, the more rules fit into one compiled method.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions import scalars as S
from tablecheck.functions.numberkeys import compared

# ---- fixed values -------------------------------------------------------------------
CATEGORIES = ("cross_field", "statistical_outlier", "multi_record", "temporal", "pattern", "simple")
OUTLIER_LOW, OUTLIER_HIGH = -1_000_000.0, 1_000_000.0
# -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    id: str
    name: str = "unnamed"
    category: str = "simple"
    target_fields: tuple[str, ...] = ()
    conditions: tuple[Mapping[str, object], ...] = ()
    parameters: Mapping[str, str] = field(default_factory=dict)
    scope: str = "table"
    function: Callable[[dict], object] | None = None

    @property
    def columns(self) -> list[str]:
        """Columns the rule reads, in first-use order."""
        used = [str(c["field"]) for c in self.conditions]
        used += [str(c["other_field"]) for c in self.conditions if c.get("other_field")]
        return list(dict.fromkeys(used + list(self.target_fields)))

    @property
    def needs_count(self) -> bool:
        """True for the cross-record form: the key combination must occur once."""
        unique = str(self.parameters.get("unique", "")).lower() == "true"
        return self.category == "multi_record" and unique and not self.conditions


# ---- conditions ---------------------------------------------------------------------


def check_regex(pattern: str) -> str:
    """Fail when the rule is built, not on the first row, if the regex is malformed."""
    spark = SparkSession.active()
    spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    return pattern


def _is_text(df: DataFrame, name: str) -> bool:
    return S.has_column(df, name) and isinstance(S.data_type(df, name), T.StringType)


# Whole numbers from here on are not all doubles.
EXACT_DOUBLES = 2**53
# The widest decimals Spark has.
WIDEST = Decimal("9" * 38)


def _number(value: object) -> int | Decimal | float | None:
    """A number without loss: whole numbers as int, others as Decimal, infinities and NaN as float."""
    if isinstance(value, (int, float, Decimal)):
        return value
    text = str(value).strip()
    try:
        return int(text)
    except ValueError:
        pass
    try:
        exact = Decimal(text)
    except InvalidOperation:
        return None
    return exact if exact.is_finite() else float(text)


def _literal(number: int | Decimal | float) -> Column:
    """A literal that loses nothing: a long if it fits, else a decimal, else a double."""
    if isinstance(number, float) and number.is_integer() and abs(number) < EXACT_DOUBLES:
        number = int(number)
    if isinstance(number, int) and -(2**63) <= number < 2**63:
        return F.lit(number)
    if isinstance(number, (int, Decimal)) and Decimal(number).copy_abs() <= WIDEST:
        exact = Decimal(number)
        if len(exact.as_tuple().digits) <= 38 and -38 <= exact.as_tuple().exponent:
            return F.lit(exact if exact.as_tuple().exponent <= 0 else exact.quantize(Decimal(1)))
    return F.lit(float(number))


def _operands(df: DataFrame, name: str, value: object) -> tuple[Column, Column]:
    """The column and the literal brought to one type that keeps scans able to push down."""
    c = F.col(f"`{name}`")
    dtype = S.data_type(df, name)
    if isinstance(dtype, T.BooleanType):
        return c, F.lit(str(value).strip().lower() in ("true", "yes", "1"))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c, F.lit(str(value)).try_cast(dtype)
    if isinstance(dtype, T.NumericType):
        number = _number(value)
        if number is None:
            return c, F.lit(None).cast(dtype)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return c, F.lit(float(number))
        return c, _literal(number)
    return c, F.lit(str(value))


def _ordered(df: DataFrame, name: str, value: object) -> tuple[Column, Column]:
    """Operands for < and >: text columns compare as numbers, exactly, when the bound is a number."""
    number = _number(value) if _is_text(df, name) else None
    if number is None:
        return _operands(df, name, value)
    return compared(F.col(f"`{name}`"), S.to_number(df, name), number), F.lit(0)


def _bounds(value: object) -> tuple[object, object]:
    if isinstance(value, str):
        text = value.replace(" AND ", ",").replace(" and ", ",")
        parts = [p.strip() for p in text.split(",")]
    else:
        parts = list(value)  # type: ignore[arg-type]
    if len(parts) != 2:
        raise ValueError(f"between needs two bounds, got {value!r}")
    return parts[0], parts[1]


def _equals(df, name, value):
    left, right = _operands(df, name, value)
    return left == right


def _not_nan(df, name) -> Column | None:
    """NaN is the greatest value and differs from all others: only > and <> must exclude it."""
    if isinstance(S.data_type(df, name), (T.DoubleType, T.FloatType)):
        return ~F.isnan(F.col(f"`{name}`"))
    return None


def _guarded(test: Column, *guards: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [g for g in guards if g is not None], test)


def _not_equals(df, name, value):
    left, right = _operands(df, name, value)
    return _guarded(left != right, _not_nan(df, name))


def _greater(df, name, value):
    left, right = _ordered(df, name, value)
    return _guarded(left > right, _not_nan(df, name))


def _less(df, name, value):
    left, right = _ordered(df, name, value)
    return left < right


def _between(df, name, value):
    low, high = _bounds(value)
    left, lo = _ordered(df, name, low)
    right, hi = _ordered(df, name, high)
    return (left >= lo) & (right <= hi)


def _contains(df, name, value):
    return F.col(f"`{name}`").cast("string").contains(str(value))


def _regex(df, name, value):
    return F.col(f"`{name}`").cast("string").rlike(check_regex(str(value)))


def _not_null(df, name, value):
    return S.present(df, name)


OPERATORS: dict[str, Callable[[DataFrame, str, object], Column]] = {
    "equals": _equals,
    "not_equals": _not_equals,
    "greater_than": _greater,
    "less_than": _less,
    "contains": _contains,
    "not_null": _not_null,
    "regex": _regex,
    "matches": _regex,
    "between": _between,
}

_COLUMN_OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "equals": lambda a, b: a == b,
    "not_equals": lambda a, b: a != b,
    "greater_than": lambda a, b: a > b,
    "less_than": lambda a, b: a < b,
}


def condition_column(df: DataFrame, condition: Mapping[str, object]) -> Column:
    """One structured condition. ``other_field`` puts a column on the right-hand side."""
    name, operator = str(condition["field"]), str(condition["operator"])
    other = condition.get("other_field")
    known = _COLUMN_OPERATORS if other else OPERATORS
    if operator not in known:
        raise ValueError(f"unknown operator {operator!r} on {name!r}")
    if not S.has_column(df, name) or (other and not S.has_column(df, str(other))):
        return F.lit(False)
    if other:
        test = known[operator](F.col(f"`{name}`"), F.col(f"`{other}`"))
        return _guarded(test, _not_nan(df, name), _not_nan(df, str(other)))
    return known[operator](df, name, condition.get("value"))


def combine(df: DataFrame, conditions: Sequence[Mapping[str, object]]) -> Column:
    """Left to right; a condition's logicalOperator joins it to what came before (AND if absent)."""
    result = condition_column(df, conditions[0])
    for condition in conditions[1:]:
        joiner = str(condition.get("logicalOperator") or "AND").upper()
        if joiner not in ("AND", "OR"):
            raise ValueError(f"unknown logical operator {joiner!r}")
        nxt = condition_column(df, condition)
        result = (result | nxt) if joiner == "OR" else (result & nxt)
    return result


# ---- templates ----------------------------------------------------------------------


def _all(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, checks) if checks else F.lit(True)


def _filled(df: DataFrame, name: str) -> Column:
    if _is_text(df, name):
        return S.not_blank(F.col(f"`{name}`"))
    return S.present(df, name)


def simple(df: DataFrame, fields: Sequence[str], parameters: Mapping[str, str]) -> Column:
    """Every field present, and not blank if it is text."""
    return _all([_filled(df, f) for f in fields])


def cross_field(df: DataFrame, fields: Sequence[str], parameters: Mapping[str, str]) -> Column:
    """Every field present. Comparisons between fields are conditions with ``other_field``."""
    return _all([S.present(df, f) for f in fields])


def statistical_outlier(df: DataFrame, fields: Sequence[str], parameters: Mapping[str, str]) -> Column:
    """A number within [lo, hi], bounds included."""
    lo = float(parameters.get("lo", OUTLIER_LOW))
    hi = float(parameters.get("hi", OUTLIER_HIGH))
    return _all([S.to_number(df, f).between(lo, hi) for f in fields])


def multi_record(df: DataFrame, fields: Sequence[str], parameters: Mapping[str, str]) -> Column:
    """Every field present; ``unique`` adds the cross-record check in ``evaluate.with_counts``."""
    return _all([S.present(df, f) for f in fields])


def temporal(df: DataFrame, fields: Sequence[str], parameters: Mapping[str, str]) -> Column:
    """Present, and ISO-8601 if it is text."""
    return _all(
        [
            S.is_iso_text(F.col(f"`{f}`")) if _is_text(df, f) else S.present(df, f)
            for f in fields
        ]
    )


def pattern(df: DataFrame, fields: Sequence[str], parameters: Mapping[str, str]) -> Column:
    """Text, not blank, and matching ``regex`` if one is given."""
    checks = []
    for f in fields:
        if not _is_text(df, f):
            return F.lit(False)
        checks.append(_filled(df, f))
        if parameters.get("regex"):
            checks.append(F.col(f"`{f}`").rlike(check_regex(parameters["regex"])))
    return _all(checks)


TEMPLATES = {
    "simple": simple,
    "cross_field": cross_field,
    "statistical_outlier": statistical_outlier,
    "multi_record": multi_record,
    "temporal": temporal,
    "pattern": pattern,
}


def predicate(df: DataFrame, rule: Rule) -> Column:
    """The rule over ``df``, null or false where it fails; an unknown category means ``simple``."""
    if rule.function is not None:
        raise ValueError(f"rule {rule.id!r} is a Python rule; use operators.evaluate.python_rules")
    if rule.conditions:
        return combine(df, rule.conditions)
    template = TEMPLATES.get(rule.category, simple)
    return template(df, rule.target_fields, rule.parameters)


def rule_column(df: DataFrame, rule: Rule) -> Column:
    """The rule over ``df`` as true or false."""
    return F.coalesce(predicate(df, rule), F.lit(False))
