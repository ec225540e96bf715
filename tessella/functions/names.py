"""Columns chosen by their names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

_NUMBERS = ("byte", "short", "int", "bigint", "smallint", "tinyint", "float", "double", "decimal")

# How display names are cut short.
ABBREVIATIONS = {"texture_": "tex_", "morph_": "mor_", "freq_": "frq_", "dissimilarity": "dissim", "homogeneity": "homog", "magnitude": "mag", "energy_ratio": "e_ratio", "object": "obj"}


def matching(df: DataFrame, pattern: str, numeric: bool = True) -> list[str]:
    """The columns whose name fits the pattern somewhere, in order; numeric: of these only numbers."""
    return [c for c, t in df.dtypes if re.search(pattern, c) and (not numeric or t.split("(")[0] in _NUMBERS)]


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with those of the columns that it has, each once, in the order asked for."""
    return df.select(*(c for c in dict.fromkeys(columns) if c in df.columns))


def pairs(df: DataFrame, first: str, second: str) -> list[tuple[str, str]]:
    """Pairs of columns that are the same but for their prefix; those without the other are left out."""
    return [(c, second + c.removeprefix(first)) for c in df.columns if c.startswith(first) and second + c.removeprefix(first) in df.columns]


def abbreviated(name: Column) -> Column:
    """A column name cut short for display."""
    for long, short in ABBREVIATIONS.items():
        name = F.replace(name, F.lit(long), F.lit(short))
    return name


# What follows each other in display names, each on what those before it left.
DISPLAY = [
    ("Ssim", "SSIM"), ("Sem ", "SEM "), ("Freq ", "Frequency "), ("Morph ", "Morphological "), ("D1", "Distance 1"), ("D2", "Distance 2"),
    ("A0", "Angle 0°"), ("A45", "Angle 45°"), ("A90", "Angle 90°"), ("A135", "Angle 135°"),
]


def display(name: Column) -> Column:
    """A column name for people: words with a capital each, then the rewritings of DISPLAY in their order."""
    words = F.initcap(F.btrim(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\s+", " ")))
    for old, new in DISPLAY:
        words = F.replace(words, F.lit(old), F.lit(new))
    return words
