"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks. The distinct blocks are sorted and each gets an integer name; then adjacent
names are paired and every distinct pair is named in turn, level by level, until each document has one name. Names
are given by content, never by a hash, so two documents share an identity if and only if their texts are equal.

Only DataFrame operations are used. The block texts cross the network once, after a map-side distinct, so a block
that a third of all rows share costs one row for each map task. Afterwards rows carry a 128-bit fingerprint in place of the
block; the distinct blocks show whether two different blocks share one, and if so the seed changes and the
naming begins again, so fingerprints route rows but decide nothing. The sort is by fingerprint, whose leading bits cut the
blocks into ranges of even size, and a name is a block's place in that order: the same blocks get the same names
however the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravenna.llm._rows import numbered, small, split_join
from ravenna.session import materialize, release

#: Runs of ASCII white space, which count as one space.
WHITE = r"[\x20\x09-\x0D]+"
BLOCK_CHARS = 8192
#: Files a core of the small tables that the levels write, and rows of a range of names on average.
FILES, RANGE = 1, 1 << 14


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _blocks(text: Column, block_chars: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.length(text) > block_chars, found).otherwise(F.array(text))


def _prints(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("a"), F.xxhash64(block, F.lit(seed + 1)).alias("b"))


def _named(distinct: DataFrame, by: list[str], spread: Column) -> DataFrame:
    """`distinct`, which must be materialised, with `name`: each row's place, from 0, in the order of `spread`'s range and then `by`.

    `spread` is a 64-bit hash of `by`, so ranges of its leading bits are even: no task sorts more than some RANGE rows, and places
    are the counts of the ranges before plus the place in the range.
    """
    bits = max(0, (distinct.count() // RANGE).bit_length())
    rows = distinct.withColumn("range", F.shiftrightunsigned(spread, 64 - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by)) - 1
    return rows.withColumn("place", place).join(before, "range").withColumn("name", F.col("before") + F.col("place")).drop("range", "place", "before")


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, row_col: str | None = None) -> DataFrame:
    """One row (rid, doc_id, text_sha256, level, name) for each row of `docs`.

    (level, name) is the identity: equal exactly for equal normalised texts. rid numbers the rows; it is `row_col`'s number if
    there is one. Null texts count as empty; an empty text is one empty block; repeated rows keep rows of their own; other
    columns are ignored.
    """
    text = normalised(F.col(text_col))
    rid = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    for seed in range(0, 1000, 2):
        rows = materialize(
            docs.select(rid.alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text")).select(
                "rid",
                "doc_id",
                F.sha2("text", 256).alias("text_sha256"),
                F.transform(_blocks(F.col("text"), block_chars), lambda b: _prints(b, seed)).alias("prints"),
            ),
            "exact-rows",
            None,
        )
        blocks = docs.select(F.explode(_blocks(text, block_chars)).alias("block")).select(_prints(F.col("block"), seed).alias("p"), "block")
        blocks = blocks.groupBy("p.a", "p.b", "block").agg(F.count("*").alias("n"))
        distinct = materialize(blocks.select("a", "b", "n"), "exact-blocks", None)
        if distinct.groupBy("a", "b").count().where("count > 1").isEmpty():
            break
        release(rows, distinct)
    else:
        raise RuntimeError("no seed separates the blocks")

    names = materialize(_named(distinct, ["a", "b"], F.col("a")), "exact-names", FILES)
    placed = rows.select("rid", F.posexplode("prints").alias("place", "p")).select("rid", "place", "p.a", "p.b")
    arrays = split_join(placed, names, ["a", "b"], "n").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("placed")).select("rid", F.col("placed.name").alias("names"))
    current = materialize(arrays, "exact-level0")
    level, done = 0, []
    while True:
        done.append(current.where(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        rest = current.where(F.size("names") > 1)
        if rest.isEmpty():
            break
        level += 1
        half = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
        pair = lambda i: F.struct(F.get("names", 2 * i).alias("x"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("y"))
        paired = rest.select("rid", F.posexplode(F.transform(half, pair)).alias("place", "p")).select("rid", "place", "p.x", "p.y")
        counted = materialize(paired.groupBy("x", "y").agg(F.count("*").alias("n")), f"exact-counted{level}", FILES)
        pairs = materialize(_named(counted, ["x", "y"], F.xxhash64("x", "y")), f"exact-pairs{level}", FILES)
        nxt = split_join(paired, pairs, ["x", "y"], "n").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("placed")).select("rid", F.col("placed.name").alias("names"))
        current = materialize(nxt, f"exact-level{level}", FILES)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return rows.select("rid", "doc_id", "text_sha256").join(out, "rid")


def _judged(docs: DataFrame, id_col: str, text_col: str, block_chars: int, row_col: str | None = None) -> DataFrame:
    """What exact_dedup returns, with the rows' numbers (rid) before it."""
    ident = materialize(block_identities(docs, id_col, text_col, block_chars, row_col), "exact-identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    groups = materialize(ident.groupBy("level", "name").agg(first, F.count("*").alias("n")).select("level", "name", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid"), "n"), "exact-groups", FILES)
    judged = split_join(ident, groups.withColumn("group_size", F.col("n")), ["level", "name"], "n")
    return judged.select("rid", "doc_id", F.col("first_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first_rid")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space. Of equal texts the row with the
    smallest doc_id stays. Null texts count as empty, so they equal empty texts. Null ids come last: they are kept only when a
    group has no other (keep_id is then null). Of rows that repeat the smallest doc_id with an equal text exactly one is
    kept. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    return _judged(docs, id_col, text_col, block_chars).drop("rid")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with exactly one row of each text, the one that exact_dedup keeps, whether ids are repeated, null or neither."""
    rows, row = numbered(docs, "exact-input")
    gone = _judged(rows, id_col, text_col, BLOCK_CHARS, row).where(~F.col("kept")).select(F.col("rid").alias("__gone"))
    gone = materialize(gone, "exact-gone", FILES)
    return rows.join(small(gone), rows[row] == gone["__gone"], "left_anti").drop(row)
