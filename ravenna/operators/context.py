"""Context of a generation: the first candidates, formatted for citation, as many as a token budget holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravenna.functions.text import stripped, token_count

TOP_K, BUDGET, RESERVE, WINDOW = 5, 4000, 512, 8192


def context_entry(chunk_id: Column, doc_id: Column, page: Column, text: Column) -> Column:
    """[ID: chunk | doc=document | página n] above the text; the page only where known."""
    where = F.concat(F.lit("doc="), doc_id.cast("string"), F.when(page.isNotNull(), F.concat(F.lit(" | página "), page.cast("string"))).otherwise(F.lit("")))
    return F.concat(F.lit("[ID: "), chunk_id.cast("string"), F.lit(" | "), where, F.lit("]\n"), stripped(text))


def assemble_context(rankings: DataFrame, chunks: DataFrame, prompts: DataFrame, top_k: int = TOP_K, budget: int = BUDGET, reserve: int = RESERVE, window: int = WINDOW, count=token_count) -> DataFrame:
    """One row a question: context_text, included, excluded, context_tokens, prompt_tokens, total_tokens, problem.

    Entries are taken in the order of `rankings` (question_id, rank, chunk_id); one that doesn't fit what is left is excluded, and a
    later smaller one may still enter. The budget is the least of `budget` and what `window` leaves beside the prompt and the reserve.
    `problem` names what raise_problems() fails on: a prompt and reserve over the window, or candidates of which none fits.
    `prompts` has (question_id, prompt); `count` turns a text column into a token count.
    """
    entry = F.concat(context_entry(F.col("chunk_id"), F.col("doc_id"), F.col("page"), F.col("text")), F.lit("\n"))
    rows = rankings.where(F.col("rank") <= top_k).select("question_id", "rank", "chunk_id").join(chunks.select("chunk_id", "doc_id", "page", "text"), "chunk_id")
    rows = rows.select("question_id", "rank", "chunk_id", entry.alias("entry")).withColumn("cost", count(F.col("entry")).cast("int"))
    listed = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "entry", "cost"))).alias("list"))
    base = prompts.select("question_id", count(F.col("prompt")).cast("int").alias("prompt_tokens")).join(listed, "question_id", "left")
    room = F.least(F.lit(budget), F.lit(window) - F.col("prompt_tokens") - F.lit(reserve))
    ids = F.transform(F.slice("list", 1, 0), lambda x: x["chunk_id"])
    start = F.struct(F.lit(0).alias("used"), ids.alias("inside"), ids.alias("outside"), F.transform(F.slice("list", 1, 0), lambda x: x["entry"]).alias("parts"))

    def add(a: Column, x: Column) -> Column:
        fits = a["used"] + x["cost"] <= room
        one = F.array(x["chunk_id"])
        return F.struct(
            F.when(fits, a["used"] + x["cost"]).otherwise(a["used"]).alias("used"),
            F.when(fits, F.concat(a["inside"], one)).otherwise(a["inside"]).alias("inside"),
            F.when(fits, a["outside"]).otherwise(F.concat(a["outside"], one)).alias("outside"),
            F.when(fits, F.concat(a["parts"], F.array(x["entry"]))).otherwise(a["parts"]).alias("parts"),
        )

    folded = base.withColumn("f", F.aggregate("list", start, add))
    used = F.coalesce("f.used", F.lit(0))
    none = F.expr("cast(array() as array<string>)")
    problem = F.when(F.col("prompt_tokens") + F.lit(reserve) > window, "prompt and reserve exceed the window").when((F.size("list") > 0) & (F.size("f.inside") == 0), "no candidate fits the budget")
    return folded.select(
        "question_id",
        F.coalesce(F.array_join("f.parts", "\n"), F.lit("")).alias("context_text"),
        F.coalesce("f.inside", none).alias("included"),
        F.coalesce("f.outside", none).alias("excluded"),
        used.alias("context_tokens"),
        "prompt_tokens",
        (F.col("prompt_tokens") + used + F.lit(reserve)).alias("total_tokens"),
        problem.alias("problem"),
    )


def raise_problems(contexts: DataFrame) -> DataFrame:
    """`contexts`, failing when it is run if a row has a problem."""
    return contexts.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.col("question_id"), F.lit(": "), F.col("problem")))).otherwise(F.col("problem")))
