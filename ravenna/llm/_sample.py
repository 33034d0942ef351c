"""Bounded labelled samples for fitting the small models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts of all classes together, where the classes are the label's values. Every class keeps at least one.
MOST_TEXTS = 19_200
#: Parts that a label's rows are cut in.
PARTS = 64


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids have none."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def texts_for(docs: DataFrame, chosen: DataFrame, max_bytes: int) -> list[tuple[str, object]]:
    """(text, label) of the chosen rows (doc_id, label), at most as many as the caller's bound; texts over `max_bytes` are left out.

    `chosen` is bounded, so it is broadcast, and the scan of the texts needs no shuffle of them all. Of rows that repeat an id
    the least text is taken, so no more rows come back than `chosen` has.
    """
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text")).join(F.broadcast(chosen.select(F.col("doc_id").alias("i"), "label")), "i")
    rows = rows.where(F.octet_length("text") <= max_bytes).groupBy("i").agg(F.min(F.struct("text", "label")).alias("own")).select("i", "own.*")
    return [(r["text"], r["label"]) for r in sorted(rows.collect(), key=lambda r: str(r["i"]))]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, max_bytes: int, classes: list | None = None) -> list[tuple[str, object]]:
    """At most `per_class` texts of each class of `label`, chosen by a hash of the id among the rows where `learn` holds.

    Null ids and labels are left out. Unless given, the classes are all of the label's values; beyond MOST_TEXTS texts in
    all, each gives an equal, smaller number of them, never less than one.
    """
    rows = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("label"))
    if classes is None:
        n = rows.select("label").distinct().count()
        most = max(1, min(per_class, MOST_TEXTS // max(1, n)))
        # A label of very many rows is cut in parts first, so that its last cut is of few rows.
        rows = rows.distinct().withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)))
        for keys in (("label", "part"), ("label",)):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
            rows = rows.withColumn("place", place).where(F.col("place") <= most).drop("place")
        return texts_for(docs, rows.select("doc_id", "label"), max_bytes)
    chosen = None
    for c in classes:
        some = rows.where(F.col("label") == c).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    return texts_for(docs, chosen, max_bytes) if chosen is not None else []
