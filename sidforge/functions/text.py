"""String cleaning."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that count as white space at the ends of a field.
WHITE_SPACE = "".join(
    map(chr, [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ])
)
_SPACE_LITERAL = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE) + "'"


def strip_sql(text: str) -> str:
    return f"btrim({text}, {_SPACE_LITERAL})"


def stringified_sql(value: str) -> str:
    return f"coalesce(cast({value} as string), '')"


def item_text_sql(brand: str, title: str, description: str) -> str:
    parts = [strip_sql(stringified_sql(c)) for c in (brand, title, description)]
    return strip_sql("concat_ws(' ', " + ", ".join(parts) + ")")


def is_blank_sql(value: str) -> str:
    return f"({strip_sql(stringified_sql(value))} = '')"


def strip(text: str) -> Column:
    """Trim every kind of white space; SQL ``trim`` alone drops only blanks."""
    return F.expr(strip_sql(text))


def stringified(value: str) -> Column:
    """Text of a value, empty when null."""
    return F.expr(stringified_sql(value))


def item_text(brand: str = "brand", title: str = "title", description: str = "description") -> Column:
    """Brand, title and description joined by single blanks.

    An empty middle field keeps both of its blanks; only the ends are trimmed.
    """
    return F.expr(item_text_sql(brand, title, description))


def is_blank(value: str) -> Column:
    return F.expr(is_blank_sql(value))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _shortest(value: Column) -> Column:
    """``-1.25e-07``: the fewest digits that read back as the value. 15 or 16 digits are the
    shortest form if they do; else all 17 are needed."""
    forms = [F.format_string(f"%.{n}e", value) for n in (14, 15, 16)]
    forms.insert(2, F.regexp_replace(forms[2], "[0-9]e", "e"))  # 16 digits, cut instead of rounded
    reads_back = [(form.try_cast("double") == value, form) for form in forms[:3]]
    return reduce(lambda found, case: found.when(*case), reads_back[1:], F.when(*reads_back[0])).otherwise(forms[3])


def _spelled(parts: Column) -> Column:
    """Text from ``digits`` and ``power``, with an exponent below 1e-4 and from 1e16 on."""
    digits, power = parts["digits"], parts["power"]
    rest = F.substring(digits, 2, 20)
    side = F.when(power < 0, "-").otherwise("+")
    exponent = F.concat(F.lit("e"), side, F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    scientific = F.concat(F.left(digits, F.lit(1)), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), exponent)
    behind = F.substring(digits, power + F.lit(2), F.lit(20))
    above = F.concat(F.rpad(digits, power + F.lit(1), "0"), F.lit("."), F.when(behind == "", "0").otherwise(behind))
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - F.lit(1)), digits)
    return F.when((power < -4) | (power >= 16), scientific).when(power >= 0, above).otherwise(below)


def float_text(value: Column) -> Column:
    """Text of a double: ``1e-05``, ``12345678.5``, ``1e+16``, ``nan``, ``-inf``, ``-0.0``.

    Of two forms of 16 digits that read back it may be the one farther off, and below 2.2e-308
    it may have a digit more than it needs.
    """
    value = value.cast("double")
    form = _once(value, _shortest)
    parts = _once(
        form,
        lambda x: F.struct(
            F.regexp_replace(F.substring_index(x, "e", 1), "[-.]|0+$", "").alias("digits"),
            F.substring_index(x, "e", -1).try_cast("int").alias("power"),
        ),
    )
    sign = F.when(value < 0, "-").otherwise("")
    spark_text = value.cast("string")
    return (
        F.when(value.isNull(), None)
        .when(F.isnan(value), "nan")
        .when(F.abs(value) == float("inf"), F.concat(sign, F.lit("inf")))
        # Most values: without exponent, and with too few digits for a shorter form to exist.
        .when((value == 0) | ~F.contains(spark_text, F.lit("E")) & (F.length(spark_text) <= 16), spark_text)
        .otherwise(F.concat(sign, _once(parts, _spelled)))
    )


def field_text(value: Column, kind: T.DataType) -> Column:
    """Text of a field as item tables hold it; null stays null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float_text(value)
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    return value.cast("string")
