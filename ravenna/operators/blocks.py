"""Markdown with page and table marks to blocks, by window functions over numbered lines; and the rendering of such Markdown.

A line is, in this order of precedence: the opening of a table, the close of a table, a page mark, a line inside a table, a
heading, a one-line comment (dropped), a blank line (ends a paragraph) or text. Reopening a table drops what the unclosed one
held; a page mark inside a table ends no table; a table without a close ends with the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravenna.functions.text import heading, sha256, stripped

OPEN = r"^<!--\s*TABLE\s+(\S+)\s+page=(\d+)\s*-->$"
CLOSE = "<!-- /TABLE -->"
PAGE = r"^<!--\s*PAGE\s+(\d+)\s*-->$"
COMMENT = r"(?s)^<!--.*-->$"
CAPTION = "**Tabela"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, n, line): the documents' lines without white space at their ends, numbered from 0."""
    rows = documents.select(F.col("doc_id"), F.posexplode(F.split(F.col("text"), LINE_END)).alias("n", "line"))
    return rows.withColumn("line", F.regexp_replace("line", r"[\s\p{Z}\x1c-\x1f\x85]+$", ""))


def parse_blocks(documents: DataFrame) -> DataFrame:
    """(block_id, doc_id, page, section, modality, text, caption, source_block_hash) of `documents` (doc_id, text).

    Blocks are numbered by their first line in each document. A document's first heading is its title, not a section, when it
    equals doc_id. A text block has the section and page it stands in; a table its own page and the section it closes in. Empty blocks vanish; null
    texts have none. A caption is what follows the first colon of its line, marks included.
    """
    line, text = F.col("line"), F.col("text")
    flow = Window.partitionBy("doc_id").orderBy("n")
    past = flow.rowsBetween(Window.unboundedPreceding, 0)
    before = flow.rowsBetween(Window.unboundedPreceding, -1)

    rows = lines_of(documents.where(text.isNotNull()).select("doc_id", "text"))
    rows = rows.withColumn("opens", line.rlike(OPEN)).withColumn("closes", stripped(line) == CLOSE).withColumn("pages", line.rlike(PAGE))
    rows = rows.withColumn("event", F.when(F.col("opens"), 1).when(F.col("closes"), 0))
    rows = rows.withColumn("inside", F.coalesce(F.last("event", ignorenulls=True).over(past), F.lit(0)) == 1)
    rows = rows.withColumn("table_no", F.sum(F.col("opens").cast("int")).over(past))
    rows = rows.withColumn("table_page", F.last(F.when(F.col("opens"), F.regexp_extract("line", OPEN, 2).cast("int")), ignorenulls=True).over(past))
    rows = rows.withColumn("page", F.last(F.when(F.col("pages") & ~F.col("opens") & ~F.col("closes"), F.regexp_extract("line", PAGE, 1).cast("int")), ignorenulls=True).over(past))
    free = ~F.col("inside") & ~F.col("closes") & ~F.col("pages")
    rows = rows.withColumn("heading", F.when(free, heading(line)))
    first = F.coalesce(F.max(F.col("heading").isNotNull().cast("int")).over(before), F.lit(0)) == 0
    title = first & (stripped(F.col("heading")) == F.col("doc_id").cast("string"))
    rows = rows.withColumn("section", F.last(F.when(~title, F.col("heading")), ignorenulls=True).over(past))
    ends = F.col("opens") | (F.col("pages") & ~F.col("closes")) | F.col("heading").isNotNull() | (free & (stripped(line) == ""))
    rows = rows.withColumn("para_no", F.sum(ends.cast("int")).over(past))

    prose = rows.where(free & F.col("heading").isNull() & (stripped(line) != "") & ~stripped(line).rlike(COMMENT))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x["line"]), "\n")
    paragraphs = prose.withColumn("line", stripped(line)).groupBy("doc_id", "para_no").agg(F.min("n").alias("at"), F.first("page").alias("page"), F.first("section").alias("section"), joined("line").alias("text"))
    paragraphs = paragraphs.select("doc_id", "at", "page", "section", F.lit("text").alias("modality"), stripped(text).alias("text"), F.lit("").alias("caption"))

    following = F.first("event", ignorenulls=True).over(flow.rowsBetween(1, Window.unboundedFollowing))
    body = F.col("inside") & ~F.col("opens") & ~F.col("pages")
    marked = rows.withColumn("next_event", following).where(F.col("inside"))
    captioned = line.startswith(CAPTION)
    last_caption = F.max_by(F.when(body & captioned, line), F.when(body & captioned, F.col("n")))
    content = F.array_sort(F.collect_list(F.when(body & ~captioned, F.struct("n", "line"))))
    tables = marked.groupBy("doc_id", "table_no").agg(
        F.min("n").alias("at"),
        F.max("table_page").alias("page"),
        F.max_by("section", "n").alias("section"),
        F.max_by(F.coalesce("next_event", F.lit(0)), "n").alias("then"),
        F.array_join(F.transform(content, lambda x: x["line"]), "\n").alias("text"),
        last_caption.alias("caption_line"),
    )
    bare = F.regexp_replace(F.col("caption_line"), r"^[* ]+|[* ]+$", "")
    caption = F.coalesce(stripped(F.when(bare.contains(":"), F.regexp_replace(bare, r"(?s)^[^:]*:", "")).otherwise(bare)), F.lit(""))
    tables = tables.where("then = 0").select("doc_id", "at", "page", "section", F.lit("table").alias("modality"), stripped(text).alias("text"), caption.alias("caption"))

    blocks = paragraphs.unionByName(tables).where(text != "")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return blocks.select(F.format_string("%s-b%04d", F.col("doc_id").cast("string"), number).alias("block_id"), "doc_id", "page", "section", "modality", "text", "caption", sha256(text).alias("source_block_hash"))


def _cell(cell: Column) -> Column:
    return stripped(F.replace(F.replace(cell, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def rendered_table(table: Column) -> Column:
    """A table struct (table_id, page, rows, caption) as marked Markdown: rows padded to the widest, the first as header."""
    rows = table["rows"]
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), _cell))
    rule = _row(F.array_repeat(F.lit("---"), width))
    start = F.format_string("<!-- TABLE %s page=%d -->", table["table_id"], table["page"])
    caption = F.when(F.coalesce(table["caption"], F.lit("")) != "", F.concat(F.format_string("**Tabela (página %d):** ", table["page"]), stripped(table["caption"])))
    body = F.when(F.size(rows) <= 0, F.lit("_tabela vazia_")).otherwise(F.array_join(F.concat(F.array(_row(padded[0]), rule), F.transform(F.slice(padded, 2, F.greatest(F.size(rows) - 1, F.lit(0))), _row)), "\n"))
    return F.concat_ws("\n", start, caption, body, F.lit(CLOSE))


#: Fixed value: the notice that extracted Markdown carries.
NOTICE = "<!-- Documento extraído automaticamente. Corrija este arquivo quando necessário; o chunker o relê como fonte canônica. -->"


def rendered_markdown(doc_id: Column, pages: Column) -> Column:
    """A document's pages (page_number, text, tables) as marked Markdown that parse_blocks reads."""
    page = lambda p: F.concat(
        F.array(F.format_string("\n<!-- PAGE %d -->\n", p["page_number"])),
        F.when(stripped(F.coalesce(p["text"], F.lit(""))) != "", F.array(stripped(p["text"]))).otherwise(F.expr("cast(array() as array<string>)")),
        F.transform(p["tables"], lambda t: F.concat(F.lit("\n"), rendered_table(t))),
    )
    parts = F.concat(F.array(F.concat(F.lit("# "), doc_id, F.lit("\n")), F.lit(NOTICE + "\n")), F.flatten(F.transform(pages, page)))
    return F.concat(F.array_join(parts, "\n"), F.lit("\n"))


def paged_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, page, page_text): what follows each page mark, pages that repeat joined; without marks the whole text, with a null page."""
    mark = r"<!--\s*PAGE\s+(\d+)\s*-->"
    text = F.col("text")
    numbers, parts = F.regexp_extract_all(text, F.lit(mark), F.lit(1)), F.split(text, mark)
    rows = documents.where(text.isNotNull()).select("doc_id", numbers.alias("numbers"), parts.alias("parts"))
    whole = rows.where(F.size("numbers") == 0).select("doc_id", F.lit(None).cast("int").alias("page"), F.col("parts")[0].alias("page_text"))
    marked = rows.select("doc_id", F.posexplode("numbers").alias("n", "number"), "parts").select("doc_id", "n", F.col("number").cast("int").alias("page"), F.get("parts", F.col("n") + 1).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n")
    return whole.unionByName(marked.groupBy("doc_id", "page").agg(joined.alias("page_text")))
