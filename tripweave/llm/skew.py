"""Lookup of a table by a key that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that go through a broadcast; all others own less than one in so many of the rows.
HEAVY = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row a key, ``weight`` its number of rows), both staged or cheap to read twice.

    The ``HEAVY`` keys of most weight are joined where their rows stand, by a broadcast of that many rows at most; any other key has
    less than a ``HEAVY``-th of all rows, so none fills a task of the shuffled join of the rest.
    """
    heavy = F.broadcast(table.orderBy(F.desc(weight), *keys).limit(HEAVY))
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(table.hint("merge"), keys)
    return rows.join(heavy, keys).unionByName(rest)
