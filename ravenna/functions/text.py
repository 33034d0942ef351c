"""Text functions as Column expressions; NFKC alone needs a vectorised UDF.

Word characters are letters, digits and the underscore of all scripts. Java's \\w and \\s are ASCII, so the classes are
spelled out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"
#: A word or one other visible character, with the white space before it: the matches tile the text up to its last token.
TILE = r"[\s\p{Z}\x1c-\x1f\x85]*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85])"
ASCII_ONLY = r"^[\x00-\x7F]*$"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition."""
    return _nfkc(text)


def lexical_normalise(text: Column, lowercase: bool = True, compatibility: bool = False) -> Column:
    """Lower case, accents kept. With `compatibility`, NFKC first; ASCII texts don't change under it."""
    if compatibility:
        text = F.when(text.rlike(ASCII_ONLY), text).otherwise(nfkc(text))
    return F.lower(text) if lowercase else text


def lexical_tokens(text: Column, **how: bool) -> Column:
    """The words of the normalised text, in order, with repetitions; of a null text none."""
    return F.regexp_extract_all(F.coalesce(lexical_normalise(text, **how), F.lit("")), F.lit(WORD), F.lit(0))


def reference_tiles(text: Column) -> Column:
    """Words and single marks, each with the white space before it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TILE), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(reference_tiles(text))


def stripped(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text), F.lit("")) == ""


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(digest: Column, n: int = 12) -> Column:
    return F.substring(digest, 1, n)


def fixed(number: Column, decimals: int = 4) -> Column:
    """A fixed number of decimals; a dash for null and NaN."""
    return F.when(number.isNull() | F.isnan(number), F.lit("—")).otherwise(F.format_string(f"%.{decimals}f", number))


def uppercase_ratio(text: Column) -> Column:
    """Capitals among the letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(capitals / letters)


def filled(template: str, **values: Column) -> Column:
    """`template` with {name} replaced by the named columns; other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


#: Section names that count as headings whatever their case.
COMMON_SECTIONS = (
    "resumo", "abstract", "introdução", "introducao", "introduction",
    "métodos", "metodos", "methods", "materiais e métodos",
    "materiais e metodos", "materials and methods", "resultados", "results",
    "discussão", "discussao", "discussion", "conclusão", "conclusao",
    "conclusion", "conclusões", "conclusoes", "referências", "referencias",
    "references", "bibliografia", "agradecimentos", "acknowledgements",
    "trabalhos relacionados", "related work", "avaliação", "avaliacao",
    "experimentos", "experiments", "limitações", "limitacoes",
)


#: The forms of a marked and of a numbered heading, what the latter doesn't end in, and the limits of either kind.
MARKED, NUMBERED, NOT_LAST = r"^#{1,6}\s+(.+?)\s*#*$", r"^\d+(\.\d+)*\.?\s+\S", "[.,;:]$"
NUMBERED_CHARS, CAPITAL_CHARS, CAPITALS = 100, 80, 0.6


def heading(line: Column) -> Column:
    """The heading that a line is, or null.

    In this order: a line that starts with '#'; a numbered line under 100 characters that doesn't end in . , ; or :; a common
    section name, a colon after it allowed; a line under 80 characters with over three fifths capitals.
    """
    s = stripped(line)
    marked = F.regexp_extract(s, MARKED, 1)
    bare = stripped(F.regexp_replace(s, "^#+", ""))
    uncoloned = F.regexp_replace(s, ":+$", "")
    return (
        F.when(s == "", F.lit(None).cast("string"))
        .when(s.startswith("#"), F.when(marked != "", stripped(marked)).otherwise(bare))
        .when(s.rlike(NUMBERED) & (F.length(s) < NUMBERED_CHARS) & ~s.rlike(NOT_LAST), s)
        .when(F.lower(uncoloned).isin(*COMMON_SECTIONS), uncoloned)
        .when((F.length(s) < CAPITAL_CHARS) & (uppercase_ratio(s) > CAPITALS), s)
    )
