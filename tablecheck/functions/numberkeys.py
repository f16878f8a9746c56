"""Numbers in text of any size and precision, as keys that sort like the numbers.

A key is a struct of the sign, the decimal exponent and the significant digits (value = sign * 0.digits * 10 ** exponent),
turned round for negative numbers, so that comparing structs compares numbers without rounding them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S

_PARTS = r"^([+-]?)([0-9]*)\.?([0-9]*)(?:e([+-]?[0-9]+))?$"
# Exponents beyond a long are held at this one.
_FAR = 2**62
_DIGITS, _TURNED = "0123456789", "9876543210"
KEY = "struct<sign:int,exponent:bigint,digits:string>"


def _key(sign: Column, exponent: Column, digits: Column) -> Column:
    return F.struct(sign.cast("int").alias("sign"), exponent.cast("bigint").alias("exponent"), digits.alias("digits"))


def _let(value: Column, result) -> Column:
    """``result`` of a value that is computed once, however often ``result`` names it."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


def _finite(x: Column) -> Column:
    """The key of a number's parts: minus, whole, digits (whole and fraction), power."""
    first = F.ltrim(x["digits"], F.lit("0"))
    far = F.when(x["power"].startswith("-"), -_FAR).otherwise(_FAR)
    raised = F.when(x["power"] == "", F.lit(0).cast("bigint")).otherwise(F.coalesce(x["power"].try_cast("bigint"), far))
    held = F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), raised))
    exponent = F.length(x["whole"]) - F.length(x["digits"]) + F.length(first) + held
    known = F.struct(F.rtrim(first, F.lit("0")).alias("shown"), exponent.alias("exponent"), x["minus"].alias("minus"))
    turned = lambda k: F.concat(F.translate(k["shown"], _DIGITS, _TURNED), F.lit("~"))
    return _let(known, lambda k: (
        F.when(k["shown"] == "", _key(F.lit(0), F.lit(0), F.lit("")))
        .when(k["minus"], _key(F.lit(-1), -k["exponent"], turned(k)))
        .otherwise(_key(F.lit(1), k["exponent"], k["shown"]))
    ))


def _plain_key(plain: Column) -> Column:
    """The key of lower-case text that is a number."""
    sign, whole, part, power = (F.regexp_extract(plain, _PARTS, k) for k in (1, 2, 3, 4))
    parts = F.struct((sign == "-").alias("minus"), whole.alias("whole"), F.concat(whole, part).alias("digits"), power.alias("power"))
    endless = _key(F.when(plain.startswith("-"), -2).otherwise(2), F.lit(0), F.lit(""))
    word = F.when(plain.endswith("nan"), F.lit(None).cast(KEY)).otherwise(endless)
    return F.when(plain.rlike("n"), word).otherwise(_let(parts, _finite))


def number_key(text: Column) -> Column:
    """The key of a number in text; null for other text and for nan."""
    return _let(S.strip(text), lambda t: F.when(S.is_float_text(t), _plain_key(F.lower(t))))


def key_of(number: int | Decimal | float) -> Column:
    """The key of a number; of a float, of the shortest text that stands for it."""
    exact = Decimal(repr(number)) if isinstance(number, float) else Decimal(number)
    if exact.is_nan():
        return F.lit(None).cast(KEY)
    sign, digits, power = exact.as_tuple()
    if exact.is_infinite():
        return _key(F.lit(-2 if sign else 2), F.lit(0), F.lit(""))
    shown = "".join(map(str, digits)).lstrip("0")
    if not shown:
        return _key(F.lit(0), F.lit(0), F.lit(""))
    exponent, shown = len(shown) + power, shown.rstrip("0")
    if sign:
        return _key(F.lit(-1), F.lit(-exponent), F.lit(shown.translate(str.maketrans(_DIGITS, _TURNED)) + "~"))
    return _key(F.lit(1), F.lit(exponent), F.lit(shown))


def compared(text: Column, as_double: Column, number: int | Decimal | float) -> Column:
    """-1, 0 or 1: how a number in text stands to a bound; null if the text is no number, or the bound is nan.

    Rounding keeps order, so doubles that differ decide; only where they agree are the keys compared.
    """
    try:
        bound = float(number)
    except OverflowError:
        bound = float("inf") if number > 0 else float("-inf")
    if bound != bound:
        return F.lit(None).cast("int")
    other = key_of(number)
    exact = _let(number_key(text), lambda key: F.when(key < other, -1).when(key > other, 1).otherwise(0))
    return F.when(as_double < bound, -1).when(as_double > bound, 1).when(as_double == bound, exact)
