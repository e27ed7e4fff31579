"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One or more of the ASCII white-space characters.
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The runs of characters between ASCII white space; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(text)


def unused(taken: Iterable[str], name: str) -> str:
    """A column name that no column of a table has, whatever its case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def with_text_key(docs: DataFrame, key: str) -> DataFrame:
    return docs.withColumn(key, text_key(F.col("text")))
