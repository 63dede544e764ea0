"""Money held as double, to the cent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole cents, up to 2 ** 63, are summed in three parts of 20, 20 and 23 bits and a sign, each as
# a bigint: no sum of up to 2 ** 40 rows can overflow.
_BITS = 20
_LIMIT = float(1 << 63)


def round_money(amount: Column | str) -> Column:
    """Half-up to two places, as double."""
    return F.round(amount, 2).cast("double")


def sum_money(amount: Column | str) -> Column:
    """Sum of amounts of two decimal places, the same whatever the order of the rows.

    The parts of the cents are summed on their own, exactly, and put together as a decimal at the end, so that
    partial sums, task retries and re-partitioning cannot change the last digits. Amounts that are no
    number of cents a bigint holds (infinite, or from 9 * 10 ** 16 on) are added as doubles.
    """
    amount = F.col(amount) if isinstance(amount, str) else amount
    cents = F.rint(amount * 100)
    exact = F.abs(cents) < _LIMIT
    whole = F.when(exact, cents.cast("long"))
    mask = (1 << _BITS) - 1
    low = F.sum(whole.bitwiseAND(mask))
    middle = F.sum(F.shiftright(whole, _BITS).bitwiseAND(mask))
    high = F.sum(F.shiftright(whole, 2 * _BITS))

    def shifted(part: Column, bits: int) -> Column:
        return part.cast("decimal(19,0)") * F.lit(1 << bits).cast("decimal(13,0)")

    total = (shifted(high, 2 * _BITS) + shifted(middle, _BITS) + shifted(low, 0)).cast("double") / 100
    beyond = F.sum(F.when(~exact, amount))
    return F.coalesce(total + F.coalesce(beyond, F.lit(0.0)), beyond)
