"""What one text cell is: strict type, numeric value, date value.

Cells stay text; these expressions derive typed columns beside them.  Patterns
run only behind cheap tests (length, first byte, presence of a comma), because
typing is evaluated for every distinct value of a table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework import dims

# White space in the Unicode sense: Spark's ``trim`` only knows the space.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def _may_be_number(v: Column) -> Column:
    """Starts with a digit, a sign, a dot or (harmlessly) ``/`` or ``,``."""
    return F.ascii(v).between(43, 57)


def _is_number(v: Column) -> Column:
    return _may_be_number(v) & F.when(
        v.contains(","), v.rlike(dims.DECIMAL_COMMA_PATTERN)).otherwise(v.rlike(dims.NUMBER_PATTERN))


def stripped_type(v: Column) -> Column:
    """Type of a text already stripped; null is ``empty``."""
    return (
        F.when(v.isNull() | (v == ""), "empty")
        .when(F.length(v).isin(4, 5) & F.lower(v).isin("true", "false"), "bool")
        .when(_is_number(v), "number")
        .when((F.length(v) == 10) & v.rlike(dims.ISO_DATE_PATTERN)
              & F.try_to_date(v, "yyyy-MM-dd").isNotNull(), "date")
        .otherwise("str")
    )


def value_type(text: Column) -> Column:
    """``empty``, ``bool``, ``number``, ``date`` or ``str``."""
    return stripped_type(strip(text))


def stripped_number(v: Column) -> Column:
    plain = F.when(v.contains(","), F.when(v.rlike(dims.DECIMAL_COMMA_PATTERN), F.translate(v, ",.", "."))).when(
        v.rlike(dims.NUMBER_PATTERN), v)
    number = F.when(_may_be_number(v), plain.try_cast("double"))
    return F.when(~number.isin(float("inf"), float("-inf")), number)


def to_number(text: Column) -> Column:
    """Double behind the two accepted spellings; anything else is null."""
    return stripped_number(strip(text))


def parse_date(text: Column) -> Column:
    """ISO first, then the day-first spellings, then ``Y/m/d``."""
    return stripped_date(strip(text))


def stripped_date(v: Column) -> Column:
    short = F.when(v.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"), F.try_to_date(v, "d/M/yy"))
    # Two-digit years from 69 on belong to the 1900s.
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    day = F.coalesce(
        F.when(v.rlike(dims.ISO_DATE_PATTERN), F.try_to_date(v, "yyyy-MM-dd")),
        F.when(v.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(v, "d/M/yyyy")),
        F.when(v.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), F.try_to_date(v, "d-M-yyyy")),
        short,
        F.when(v.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.try_to_date(v, "yyyy/M/d")),
    )
    return F.when(F.length(v).between(6, 10) & F.ascii(v).between(48, 57), day)


def cell_text(value: Column, kind: str = "scalar") -> Column:
    """Text of a native value: null -> '', booleans lower case, nested -> compact JSON."""
    text = F.to_json(value) if kind == "nested" else value.cast("string")
    return F.coalesce(text, F.lit(""))


def clip(text: Column) -> Column:
    return F.substring(text, 1, dims.MAX_CELL_CHARS)
