"""Summaries of papers and of their questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind_counts(questions: DataFrame, paper: str, kind: str) -> DataFrame:
    """(paper, kinds): a map of how many questions of each kind."""
    each = questions.groupBy(paper, kind).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(paper).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"))  # bounded by the kinds


def rank_within(group: list[str], order: list[str], low: Column, high: Column, alone: float = 0.3) -> Column:
    """A value rising evenly from low to high with a row's rank in its group; ``alone`` of the way if it is the only one.

    Rounded half up; a billionth makes up for halves that binary fractions miss.
    """
    w = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy(*order)) - 1
    return F.round(low + (high - low) * F.when(n > 1, rank / F.greatest(n - 1, F.lit(1))).otherwise(alone) + 1e-9, 2)


def renumber(rows: DataFrame, group: list[str], order: list[str], name: str = "no") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in an order; the optimiser limits groups before the shuffle."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def split_shift(rows: DataFrame, group: list[str], order: list[str], parts: Column, name: str = "no") -> DataFrame:
    """New numbers after each row becomes ``parts`` rows: the first number of each."""
    before = F.coalesce(F.sum(parts).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, (before + 1).cast("int"))


def duplicate_suffix(rows: DataFrame, parent: list[str], name: str, order: list[str]) -> DataFrame:
    """Repeated names under one parent become name#2, name#3, ..."""
    n = F.row_number().over(Window.partitionBy(*parent, name).orderBy(*order))
    return rows.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), n)))


def dense_pages(rows: DataFrame, doc: str, page: str) -> DataFrame:
    """Pages renumbered without gaps, in order."""
    return rows.withColumn(page, F.dense_rank().over(Window.partitionBy(doc).orderBy(page)))
