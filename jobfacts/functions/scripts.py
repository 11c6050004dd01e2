"""Patterns in script text. Text is lower-cased once and split into words once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobfacts import fixed_values as fv

# Unicode word characters, and only "\n" ends a line for ".".
_FLAGS = "(?Ud)"


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def words(lowered: Column) -> Column:
    """All words of a text: the runs of word characters."""
    return F.split(lowered, r"(?U)\W+")


def intensive(
    lowered: Column, found: Column, of_class: list[str], phrases: list[tuple[str, list[str]]]
) -> Column:
    """Whether a text has a word or a phrase of a class.

    ``found`` are the words of the text, split once for all classes. A phrase's
    pattern only runs on texts that hold everything it needs.
    """
    listed = F.expr(f"array({', '.join(map(repr, of_class))})")
    hit = F.arrays_overlap(found, listed)
    for pattern, needed in phrases:
        for text in needed:
            gate = lowered.contains(text) if text is needed[0] else gate & lowered.contains(text)
        hit = hit | (gate & lowered.rlike(_FLAGS + pattern))
    return hit


def mpi_ranks(lowered: Column) -> Column:
    """Rank count of the first ``mpirun -n N``; none or zero is NULL."""
    found = F.regexp_extract(lowered, _FLAGS + fv.MPI_RANKS_PATTERN, 1)
    return F.nullif(found.try_cast("int"), F.lit(0))


def has_shebang(script: Column) -> Column:
    """Whether the first line, leading white space aside, starts with ``#!``."""
    return script.rlike(r"^\s*#!")


def only_comments(script: Column) -> Column:
    """Whether no line holds anything but white space or a comment."""
    return ~script.rlike(r"(?md)^[^\S\n]*[^\s#]")


def loads_modules(lowered: Column) -> Column:
    return lowered.contains("module load")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def matches_any(text: Column, formats: list[str]) -> Column:
    return text.rlike(any_of(formats))
