"""Numbers of up to 128 bits as columns: their digits, and how JSON shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"
#: JSON numbers below this survive every reader.
PORTABLE = 2**53
TEN19 = 10**19


def half(name: str, at: int) -> Column:
    """The upper (0) or lower (1) 64 bits of 16 bytes."""
    return F.conv(F.hex(F.substring(name, 1 + 8 * at, 8)), 16, 10).cast(WHOLE)


def wide_digits(name: str) -> Column:
    """The decimal digits of 16 bytes. The value is kept as two numbers, of 10 ** 19 and of units, as it can be over 38 digits long."""
    high, low = half(name, 0), half(name, 1)
    rest = F.lit(str((1 << 64) - TEN19)).cast(WHOLE)  # 2 ** 64 is 10 ** 19 and this
    ten = lambda n: F.lit(str(10**n)).cast(WHOLE)
    upper, lower = floor_div(high, ten(10)), (high % ten(10)).cast(WHOLE)
    carried = (upper * rest).cast(WHOLE)  # still to be multiplied by 10 ** 10
    units = (lower * rest + low).cast(WHOLE) + ((carried % ten(9)).cast(WHOLE) * ten(10)).cast(WHOLE)
    units = units.cast(WHOLE)
    whole = F.lit(str(TEN19)).cast(WHOLE)
    tops = (high + floor_div(carried, ten(9)) + floor_div(units, whole)).cast(WHOLE)
    left = (units % whole).cast(WHOLE).cast("string")
    return F.when(tops > 0, F.concat(tops.cast("string"), F.lpad(left, 19, "0"))).otherwise(left)


def floor_div(a: Column, b: Column) -> Column:
    """Whole division of non-negative decimals, without rounding on the way."""
    return ((a - a % b).cast(WHOLE) / b).cast(WHOLE)


def digits(df: DataFrame, name: str) -> Column:
    return wide_digits(name) if dict(df.dtypes)[name] == "binary" else F.col(name).cast("string")


def json_number(df: DataFrame, name: str) -> Column:
    """A number where every reader can hold it, else a string of its digits."""
    shown = digits(df, name)
    if dict(df.dtypes)[name] == "int":
        return shown
    small = (half(name, 0) == 0) & (half(name, 1) < PORTABLE) if dict(df.dtypes)[name] == "binary" else F.col(name) < PORTABLE
    return F.when(small, shown).otherwise(F.concat(F.lit('"'), shown, F.lit('"')))
