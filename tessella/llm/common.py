"""What the training-data operators share: tables, the shared folder, and tables written into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.sources.scratch import scratch, shared_folder, written
from tessella.sources.tables import table

__all__ = ["GAP_CHARS", "WORD_GAP", "few", "let", "parted", "scratch", "shared_folder", "table", "whole", "word_array", "written"]

#: The ASCII white space that separates words, as a regular expression and as characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"

#: Tables of up to so many rows may be broadcast; they hold a few numbers a row.
FEW_ROWS = 500_000


def few(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row as one side of a join: broadcast if it is small, else left to the planner."""
    return F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table


def whole(docs: DataFrame, *names: str) -> DataFrame:
    """The rows of docs as one struct column _doc, and beside it the columns to work on: no name can clash."""
    return docs.select(F.struct("*").alias("_doc"), *names)


def parted(df: DataFrame, docs: DataFrame, **made: Column) -> DataFrame:
    """The inverse of whole(): the columns of docs, some of them made anew."""
    return df.select(*(made.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns))


def word_array(text: Column) -> Column:
    """The words of a text, in order; none for a null or blank one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]
