"""Rounding that does not depend on the order in which partitions are summed."""

from pyspark.sql import Column, functions as F


def stable_round(value, decimals: int) -> Column:
    """Half-up rounding after dropping float noise below 1e-6.

    Sums of doubles differ in the last bits from run to run once a shuffle is
    involved; without the first rounding an exact tie would flip between runs.
    """
    return F.round(F.round(value if isinstance(value, Column) else F.col(value), 6), decimals)
