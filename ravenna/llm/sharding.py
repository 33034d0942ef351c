"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns virtual nodes on a ring of 2**16 cells; a key belongs to the first node clockwise. A shard holds
no more rows than its capacity: what overflows continues clockwise to the next node whose shard has room. With no slack the
capacities sum to the number of rows, so shard sizes differ by one row at most; with slack, capacity is
ceil((1 + slack) * rows / shards).

The keys of one arc (between two nodes) are interchangeable, so the overflow is planned on counts of the arcs. There are
shards * vnodes arcs whatever the corpus size; only those counts reach the driver. A row's rank in its arc comes from
prefix sums over cells that are refined with the row count; cells that still hold many rows, since ids or texts repeat, are split
by the rows' numbers. So no task ever ranks more than some thousand rows of one arc together.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravenna.llm._rows import small
from ravenna.session import materialize

CELL_BITS = 16
#: Rows that one refined cell holds on average, at most.
CELL_ROWS = 4096


def ring(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Cells of the virtual nodes in ring order, and each node's shard. A shard's nodes don't depend on the other shards."""
    if shards < 1 or vnodes < 1 or shards * vnodes > 1 << (CELL_BITS - 1):
        raise ValueError("shards * vnodes must lie between 1 and half the ring's cells")
    spots: dict[int, int] = {}
    for s in range(shards):
        placed = n = 0
        while placed < vnodes:
            cell = int.from_bytes(hashlib.blake2b(f"{s}:{n}".encode(), digest_size=8).digest(), "big") >> (64 - CELL_BITS)
            n += 1
            if cell not in spots:
                spots[cell] = s
                placed += 1
    order = sorted(spots)
    return order, [spots[c] for c in order]


def plan_overflow(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for all rows of all arcs; each arc's rows go to its owner first."""
    free, pieces, over = list(capacity), [], []
    used = [0] * len(capacity)

    def put(arc: int, start: int, n: int, shard: int) -> None:
        pieces.append((arc, start, start + n, shard, used[shard]))
        used[shard] += n
        free[shard] -= n

    for arc, n in enumerate(counts):
        own = min(n, free[owners[arc]])
        if own:
            put(arc, 0, own, owners[arc])
        if n > own:
            over.append((arc, own, n))
    for arc, start, n in over:
        step = arc
        while start < n:
            step = (step + 1) % len(owners)
            if take := min(n - start, free[owners[step]]):
                put(arc, start, take, owners[step])
                start += take
    return pieces


def bounded_load_shards(docs: DataFrame, shards: int = 8, vnodes: int = 64, slack: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1 (null texts have none, and checksum 0). slot numbers each shard's rows from 0
    without gaps. Rows without id are placed by their text. Repeated rows get slots of their own; which of two
    identical rows has which slot means nothing. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(F.col(id_col).cast("string")))
    rows = materialize(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("h"), F.monotonically_increasing_id().alias("row")),
        "shard-rows",
        None,
    )
    spark = docs.sparkSession
    cells, owners = ring(shards, vnodes)
    arcs = [(c, bisect_left(cells, c) % len(cells)) for c in range(1 << CELL_BITS)]
    arc_of = F.broadcast(spark.createDataFrame(arcs, "cell int, arc int"))  # 2**16 rows, whatever the corpus
    total = rows.count()
    fine = CELL_BITS + max(0, (total // CELL_ROWS).bit_length() - CELL_BITS)
    cell = F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int")
    spot = F.shiftrightunsigned("h", 64 - fine)
    dealt = rows.withColumn("cell", cell).withColumn("spot", spot).join(arc_of, "cell").drop("cell")
    fill = materialize(dealt.groupBy("arc", "spot").agg(F.count("*").alias("n")), "shard-cells")
    full = materialize(fill.where(F.col("n") > 8 * CELL_ROWS).select("arc", "spot", F.ceil(F.col("n") / CELL_ROWS).alias("parts")), "shard-full-cells")
    if full.isEmpty():
        dealt, fill = dealt.withColumn("part", F.lit(0).cast("long")), fill.withColumn("part", F.lit(0).cast("long"))
    else:
        dealt = dealt.join(small(full), ["arc", "spot"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), "parts"), F.lit(0).cast("long"))).drop("parts")
        fill = materialize(dealt.groupBy("arc", "spot", "part").agg(F.count("*").alias("n")), "shard-parts")
    by_arc = {r["arc"]: r["n"] for r in fill.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    counts = [by_arc.get(a, 0) for a in range(len(cells))]
    if slack is None:
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        capacity = [-int(-(1 + slack) * total // shards)] * shards
    pieces = plan_overflow(counts, owners, capacity)
    planned = F.broadcast(spark.createDataFrame(pieces, "arc int, first long, end long, shard int, base long"))  # bounded by the arcs
    before = F.sum("n").over(Window.partitionBy("arc").orderBy("spot", "part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = fill.select("arc", "spot", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("arc", "spot", "part").orderBy("h", "doc_id", "size", "text_crc32", "row")) - 1
    ranked = dealt.withColumn("place", place).join(offsets, ["arc", "spot", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    hit = (ranked["arc"] == planned["arc"]) & (ranked["rank"] >= planned["first"]) & (ranked["rank"] < planned["end"])
    return ranked.join(planned, hit).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
