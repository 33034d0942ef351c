"""Connected components by alternating large-star and small-star steps, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.llm import _rows
from ravenna.llm._rows import split_join
from ravenna.session import materialize, release

#: Files a core of the small tables that loops write: rows of two numbers.
FILES = 1


def _star(edges: DataFrame, large: bool, hubs: bool) -> DataFrame:
    """edges (u, v): every node's least neighbour (itself included) replaces the node for its larger or its smaller neighbours."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    if hubs:  # a node of many neighbours can be a task's whole work, so its neighbours stay where they are
        both, least = materialize(both, "star-edges", FILES), materialize(least, "star-least", FILES)
        joined = split_join(both, least, ["u"], "n")
    else:
        joined = both.join(least.drop("n"), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (u, v; longs without nulls): root is the least node of its component.

    Loops and repeated edges are allowed; without edges the result is empty. The number of rounds grows with the
    logarithm of the number of nodes. Least neighbours are pre-aggregated before each shuffle, and nodes with very many neighbours
    are joined by broadcast.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag, FILES)
    mark = None
    while True:
        # done when every node points straight at a node that points nowhere
        n, links = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, links) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = (n, links)
        hubs = 2 * n > _rows.HOT_ROWS  # no node can have so many neighbours otherwise
        last, now = now, materialize(_star(_star(now, True, hubs), False, hubs), tag, FILES)
        release(last)
