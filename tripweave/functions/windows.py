"""Window helpers shared by the sequence operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec, functions as F

ORDER = ("tst", "record_id")


def ordered(by: Sequence[str], order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def running(by: Sequence[str], order: Sequence[str] = ORDER) -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def next_non_null(column: str, by: Sequence[str], order: Sequence[str] = ORDER) -> Column:
    """Nearest non-null value strictly after the row.

    ``lead .. ignore nulls`` walks the partition once; a frame reaching to
    UNBOUNDED FOLLOWING would be recomputed for every row.
    """
    spec = f"partition by {', '.join(f'`{c}`' for c in by)} order by {', '.join(f'`{c}`' for c in order)}"
    return F.expr(f"lead(`{column}`, 1) ignore nulls over ({spec})")
