"""Text normalisation and tokenising."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Entities that need no Python, the ampersand last: what it leaves is not unescaped again.
PLAIN_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


@F.pandas_udf(StringType())
def unescape_html(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML entities to characters. The one Python step: Spark has no function for all of them."""
    for part in parts:
        yield part.map(html.unescape, na_action="ignore")


def strip_tags(column: Column | str) -> Column:
    """Tags become blanks, runs of blanks become one, ends are trimmed."""
    c = F.col(column) if isinstance(column, str) else column
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def normalise_text(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Unescapes entities, strips tags and collapses blanks.

    Only texts with an ``&`` that starts none of the ``PLAIN_ENTITIES`` are sent to Python; the rest stay inside the JVM.
    """
    raw = plain = F.col(column)
    names = "|".join(e[1:] for e in PLAIN_ENTITIES)
    other = F.coalesce(raw.contains("&") & raw.rlike(f"&(?!{names})"), F.lit(False))
    for entity, character in PLAIN_ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    unescaped = F.when(other, unescape_html(F.when(other, raw))).when(raw.contains("&"), plain).otherwise(raw)
    return df.withColumn(out or column, strip_tags(unescaped))


def words(column: Column | str) -> Column:
    """Blank-separated words; an empty text has none."""
    c = F.trim(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"\s+", " "))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def word_count(column: Column | str) -> Column:
    return F.regexp_count(F.col(column) if isinstance(column, str) else column, F.lit(r"\S+"))


def word_tokens(column: Column | str) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores, in order."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def topic_tokens(column: Column | str, stop_words: list[str]) -> Column:
    """Lower-cased ASCII words longer than two letters that are not stop words."""
    c = F.col(column) if isinstance(column, str) else column
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)), lambda t: ~t.isin(*stop_words))


def lemmatise(tokens: DataFrame, token: str, lemmas: DataFrame) -> DataFrame:
    """Replaces tokens by their lemma where ``lemmas(token, lemma)`` has one."""
    joined = tokens.join(lemmas.select(F.col("token").alias(token), "lemma"), token, "left")
    return joined.withColumn(token, F.coalesce("lemma", token)).drop("lemma")
