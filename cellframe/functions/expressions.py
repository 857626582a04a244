"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token that counts as a number.
NUMBER = r"^(?i)([+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?(nan|inf|infinity))$"
INTEGER = r"^[+-]?\d+$"


def to_double(token: Column) -> Column:
    """The token as a double, or null if it is no number."""
    t = F.trim(token)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def to_int(token: Column) -> Column:
    t = F.trim(token)
    return F.when(t.rlike(INTEGER), t.try_cast("int"))


def tokens(line: Column) -> Column:
    """The white-space separated tokens of a line; none for a blank line."""
    return F.filter(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), lambda t: t != "")


def cells(line: Column) -> Column:
    """The comma-separated cells of a line, trimmed, without the blank ones."""
    return F.filter(F.transform(F.split(line, ","), lambda c: F.trim(c)), lambda c: c != "")


def header_cells(line: Column) -> Column:
    """The comma-separated cells of a header, trimmed; blank ones keep their places."""
    return F.transform(F.split(line, ","), lambda c: F.trim(c))


def floor_mod(x: Column) -> Column:
    """x modulo 1, never negative."""
    return x - F.floor(x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def axis_label(label: Column) -> Column:
    """A readable axis label, without white space around it."""
    label = F.regexp_replace(label, r"^\s+|\s+$", "")
    # fixed values
    return (
        F.when(label == "Q", "Q (Å^{-1})")
        .when(label.isin("r", "R"), "r (Å)")
        .otherwise(F.replace(F.replace(F.replace(label, F.lit("(A^-1)"), F.lit("(Å^{-1})")), F.lit("(A^{-1})"), F.lit("(Å^{-1})")), F.lit("(A)"), F.lit("(Å)")))
    )


def linspace(lo: Column, hi: Column, n: int) -> Column:
    """n evenly spaced values from lo to hi, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + i * (hi - lo) / (n - 1))


def interior_levels(lo: Column, hi: Column, n: int) -> Column:
    """n evenly spaced values strictly between lo and hi."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: lo + k * (hi - lo) / (n + 1))
