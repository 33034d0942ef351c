"""Numbers for the rows of a table, so that a decision on one row is never taken for another's, and joins that hold out against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.session import materialize

#: Rows of one key that a join's task takes at most; keys with more are joined by broadcast. Bytes that are broadcast at most.
HOT_ROWS, SMALL_BYTES = 1_000_000, 16 << 20


def numbered(docs: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """`docs` with a column of distinct longs, and that column's name, which none of its own has.

    The table is written, since a number that is worked out twice may name two rows when the rows' order isn't fixed.
    """
    name, taken = "__row", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), tag, None), name


def small(df: DataFrame) -> DataFrame:
    """`df`, which must be materialised, to be broadcast if its rows take few bytes, as measured; else as it is."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df


def split_join(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """The inner join of `left` with `right`, which has a row for each key and, in `weight`, how many rows of `left` have that key.

    Keys of over HOT_ROWS rows, of which there are at most rows / HOT_ROWS, are broadcast, so their rows stay where they are; only
    the other keys' rows are shuffled. Both tables should be materialised.
    """
    most = right.agg(F.max(weight)).first()[0] or 0
    if most <= HOT_ROWS:
        return left.join(right.drop(weight), on)
    hot = right.where(F.col(weight) > HOT_ROWS).drop(weight)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(weight) <= HOT_ROWS).drop(weight), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)
