"""Numbers in strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+)$"
SHORTEST = "0." + "#" * 340


def number(c: Column) -> Column:
    """The float that the string spells, without outer blanks or suffixes; null if it spells none."""
    word = F.lower(F.regexp_replace(c, r"^[+-]", ""))
    sign = F.when(c.startswith("-"), -1.0).otherwise(1.0)
    return (
        F.when(c.rlike(NUMBER), c.try_cast("double"))
        .when(word.isin("inf", "infinity"), sign * F.lit(float("inf")))
        .when(word == "nan", F.lit(float("nan")))
    )


def show(c: Column) -> Column:
    """Shortest decimal, never with an exponent."""
    inf = float("inf")
    return F.when(F.isnan(c), "NaN").when(c == inf, "+Inf").when(c == -inf, "-Inf").otherwise(F.call_function("format_number", c, F.lit(SHORTEST)))
