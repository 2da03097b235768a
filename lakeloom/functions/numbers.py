"""Numbers with units, market values and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and what they multiply by
CHINESE_UNITS = {
    "千": 1e3, "万": 1e4, "十万": 1e5, "百万": 1e6, "千万": 1e7,
    "亿": 1e8, "十亿": 1e9, "百亿": 1e10, "千亿": 1e11, "万亿": 1e12,
}
ENGLISH_UNITS = {"k": 1e3, "thousand": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9, "trillion": 1e12, "t": 1e12}

_PLAIN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_WITH_UNIT = r"^([+-]?\d+(?:\.\d+)?)\s*(\D+)$"


def to_number(text: Column) -> Column:
    """A plain number or number with a Chinese or English unit as a double; null if it is neither. Commas are ignored."""
    t = F.replace(F.trim(text), F.lit(","), F.lit(""))
    units = F.create_map(*[F.lit(x) for kv in {**CHINESE_UNITS, **ENGLISH_UNITS}.items() for x in kv])
    digits, unit = F.regexp_extract(t, _WITH_UNIT, 1), F.lower(F.regexp_extract(t, _WITH_UNIT, 2))
    return F.when(t.rlike(_PLAIN), t.try_cast("double")).otherwise(digits.try_cast("double") * F.try_element_at(units, unit))


def convert_number(text: Column) -> Column:
    """struct(num, text): the number, or the trimmed text where it is none."""
    n = to_number(text)
    return F.struct(n.alias("num"), F.when(n.isNull(), F.trim(text)).alias("text"))


def format_market_cap(value: Column) -> Column:
    """Two digits and the unit; the unit 亿 stands for 1e8 here."""
    two = lambda c: F.format_string("%.2f", c)
    return (
        F.when(value >= 1e12, F.concat(two(value / 1e12), F.lit(" 万亿美元")))
        .when(value >= 1e8, F.concat(two(value / 1e8), F.lit(" 亿美元")))
        .when(value >= 1e6, F.concat(two(value / 1e6), F.lit(" 百万美元")))
        .otherwise(F.concat(two(value), F.lit(" 美元")))
    )


def years(first: int, last: int) -> Column:
    """Array of year labels."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda y: y.cast("string"))


def quarters(first_year: int | Column, last_year: int | Column, first: int | Column = 1, last: int | Column = 4) -> Column:
    """Array of labels YYYY Qn from a quarter to a quarter."""
    at = [F.lit(x) if isinstance(x, int) else x for x in (first_year, first, last_year, last)]
    n = F.sequence(at[0] * 4 + at[1] - 1, at[2] * 4 + at[3] - 1)
    return F.transform(n, lambda q: F.concat(F.floor(q / 4).cast("string"), F.lit(" Q"), (q % 4 + 1).cast("string")))
