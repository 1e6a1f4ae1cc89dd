"""Exact sums of two-decimal amounts in integer arithmetic.

Amounts are stored as doubles with two decimals. As integers (hundredths) they
stay in generated code, and their sums do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_BITS = 20


def cents(name: str) -> Column:
    """Column `name` in hundredths."""
    return F.floor(F.col(name) * 100 + 0.5)


def net() -> Column:
    """Discounted price in units of 1e-4."""
    return cents("l_extendedprice") * (100 - cents("l_discount"))


def real(name: str, decimals: int = 0) -> Column:
    """An integer total as a double, `decimals` places shifted."""
    value = F.col(name).cast("double")
    return value / F.lit(10.0**decimals) if decimals else value


@dataclass(frozen=True)
class ExactSum:
    """Sum of a long column that may outgrow a long.

    High and low bits are summed apart, each far from overflow at 1e12 rows, and
    put together as a decimal.
    """

    of: Column

    def column(self, wrap: Callable[[Column], Column] = lambda part: part) -> Column:
        high = wrap(F.sum(F.shiftright(self.of, LOW_BITS)))
        low = wrap(F.sum(self.of.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long"))))
        return high.cast("decimal(20,0)") * F.lit(1 << LOW_BITS).cast("decimal(8,0)") + low.cast("decimal(20,0)")


Aggregate = Column | ExactSum


def aggregate(part: Aggregate, wrap: Callable[[Column], Column] = lambda part: part) -> Column:
    return part.column(wrap) if isinstance(part, ExactSum) else wrap(part)
