"""Body text from positioned words: words inside tables go, the others form lines, and wide gaps part paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravenna.functions.text import sha256
from ravenna.operators.blocks import rendered_markdown

#: Points within which words share a line; a gap of over so many median word heights parts paragraphs; the height without any.
LINE_TOLERANCE, GAP_RATIO, NO_HEIGHT = 3.0, 1.8, 10.0


def in_box(x0: Column, x1: Column, top: Column, bottom: Column, box: Column) -> Column:
    """Whether a word's centre lies in the box (x0, top, x1, bottom), its edges included."""
    x, y = (x0 + x1) / 2, (top + bottom) / 2
    return (box["x0"] <= x) & (x <= box["x1"]) & (box["top"] <= y) & (y <= box["bottom"])


def body_words(words: DataFrame, tables: DataFrame) -> DataFrame:
    """`words` (doc_id, page, text, x0, x1, top, bottom) outside all of the page's tables (doc_id, page, bbox)."""
    boxes = tables.where("bbox is not null").groupBy("doc_id", "page").agg(F.collect_list("bbox").alias("boxes"))
    rows = words.join(boxes, ["doc_id", "page"], "left")
    hit = F.exists("boxes", lambda b: in_box(F.col("x0"), F.col("x1"), F.col("top"), F.col("bottom"), b))
    return rows.where(F.col("boxes").isNull() | ~hit).drop("boxes")


def page_text(words: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, text): each page's body, lines joined by line ends, paragraphs by an empty line.

    Lines take words whose top rounds (half to even) to the same multiple of the tolerance, from left to right; words at
    the same place in the order of their text. The median height is the upper one. A page is one task's unit: it holds some thousand words.
    """
    body = body_words(words, tables)
    height = F.col("bottom") - F.col("top")
    tall = F.array_sort(F.collect_list(F.when(height > 0, height)))
    middle = F.when(F.size(tall) == 0, F.lit(NO_HEIGHT)).otherwise(F.get(tall, (F.size(tall) / 2).cast("int")))
    heights = body.groupBy("doc_id", "page").agg(middle.alias("median"))
    row = body.withColumn("line", F.rint(F.col("top") / LINE_TOLERANCE).cast("int"))
    lines = row.groupBy("doc_id", "page", "line").agg(F.min("top").alias("first_top"), F.max("bottom").alias("last_bottom"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"))
    gap = F.col("first_top") - F.lag("last_bottom").over(Window.partitionBy("doc_id", "page").orderBy("line"))
    lines = lines.withColumn("gap", gap).join(heights, ["doc_id", "page"])
    parted = F.when(F.col("gap") > GAP_RATIO * F.col("median"), F.concat(F.lit("\n"), "text")).otherwise(F.col("text"))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", parted.alias("text")))), lambda x: x["text"]), "\n").alias("text"))


def tables_per_document(pages: DataFrame) -> DataFrame:
    """(doc_id, n_tables) of pages (doc_id, tables)."""
    return pages.groupBy("doc_id").agg(F.sum(F.greatest(F.size("tables"), F.lit(0))).alias("n_tables"))


def extracted_documents(pdfs: DataFrame) -> DataFrame:
    """(doc_id, text, provenance): PDFs of ravenna.sources.files.read_pdfs as marked Markdown, and what is known of its making.

    The body of a page with tables that have a place comes from its words outside them; of other pages the parser's text is taken.
    """
    pages = pdfs.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.page_number").alias("page"), "p.words", "p.tables")
    placed = pages.where(F.exists("tables", lambda t: t["bbox"].isNotNull()))
    words = placed.select("doc_id", "page", F.explode("words").alias("w")).select("doc_id", "page", "w.*")
    tables = placed.select("doc_id", "page", F.explode("tables").alias("t")).select("doc_id", "page", "t.bbox")
    bodies = page_text(words, tables).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias("bodies"))
    rows = pdfs.join(bodies, "doc_id", "left")

    def page(p: Column) -> Column:
        body = F.when(F.exists(p["tables"], lambda t: t["bbox"].isNotNull()), F.coalesce(F.element_at("bodies", p["page_number"]), F.lit(""))).otherwise(p["text"])
        marked = F.transform(p["tables"], lambda t: F.struct(t["table_id"], p["page_number"].alias("page"), t["rows"], t["caption"]))
        return F.struct(p["page_number"], body.alias("text"), marked.alias("tables"))

    text = rendered_markdown(F.col("doc_id"), F.transform("pages", page))
    rows = rows.withColumn("text", text)
    n_tables = F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(p["tables"]))
    made = F.struct(
        "doc_id",
        "pdf_filename",
        "pdf_sha256",
        sha256(F.col("text")).alias("representation_sha256"),
        F.size("pages").alias("num_pages"),
        n_tables.alias("tables_count"),
        "warnings",
        "review_items",
        F.col("metadata").alias("pdf_metadata"),
        F.current_timestamp().alias("generated_at"),
    )
    return rows.select("doc_id", "text", made.alias("provenance"))
