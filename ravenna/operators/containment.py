"""Which texts hold which of a stated set of strings, literally: one pass over the texts for each block of strings."""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenna.session import ship_package

#: Characters of the strings that one pass looks for; their automaton takes some hundred bytes for each.
BLOCK_CHARS = 1 << 20

#: The automaton of this Python worker, by its block's key.
_automata: dict[str, ahocorasick.Automaton | None] = {}


def _automaton(key: str, shared) -> ahocorasick.Automaton | None:
    if key not in _automata:
        _automata.clear()
        places: dict[str, list[int]] = {}
        for k, (_, needle) in enumerate(shared.value):
            places.setdefault(needle, []).append(k)
        found = ahocorasick.Automaton()
        for needle, rows in places.items():
            found.add_word(needle, rows)
        if places:
            found.make_automaton()
        _automata[key] = found if places else None
    return _automata[key]


def containing(texts: DataFrame, needles: DataFrame, id_col: str = "chunk_id", text_col: str = "text", needle_id_col: str = "question_id", needle_col: str = "needle", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(needle_id_col, id_col) of each row of `texts` that holds a row of `needles` as a stretch of characters.

    All strings of a block are found at once with an Aho-Corasick automaton, so a text is read once a block however many
    strings there are, and nothing is shuffled. Null texts hold nothing; null and empty strings are in nothing. Repeated rows give a
    row each. Reading the strings runs a job for each block.
    """
    spark = texts.sparkSession
    ship_package(spark)
    ids, rows = texts.schema[id_col].dataType, texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    schema = f"{needle_id_col} {needles.schema[needle_id_col].dataType.simpleString()}, {id_col} {ids.simpleString()}"
    asked = needles.where(F.length(needle_col) > 0).select(F.col(needle_id_col).alias("i"), F.col(needle_col).alias("n"))
    blocks = -(-(asked.agg(F.sum(F.length("n"))).first()[0] or 0) // block_chars)
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("i", "n"), F.lit(blocks)) == b)
        shared, key = spark.sparkContext.broadcast([(r["i"], r["n"]) for r in part.collect()]), uuid.uuid4().hex

        def find(batches, shared=shared, key=key):
            automaton = _automaton(key, shared)
            for batch in batches:
                hits = [(k, i) for i, t in enumerate(batch.column("t").to_pylist()) for k in {k for _, rows in automaton.iter(t) for k in rows}] if automaton else []
                if hits:
                    names = [shared.value[k][0] for k, _ in hits]
                    yield pa.RecordBatch.from_arrays([pa.array(names), batch.column("i").take(pa.array([i for _, i in hits]))], [needle_id_col, id_col])

        out = out.unionByName(rows.mapInArrow(find, schema))
    return out
