"""Exact-total apportionment and score assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apportion(rows: DataFrame, group: list[str], order: list[str], weight: Column, amount: Column, least: int = 1, name: str = "share") -> DataFrame:
    """Largest-remainder shares of ``amount`` by weight within each group, each at least ``least``.

    Ties in the remainder go by ``order``.  A group whose amount can't give every row the least
    has null shares.
    """
    own = Window.partitionBy(*group)
    rows = rows.withColumn("__w", weight.cast("double")).withColumn("__n", F.count(F.lit(1)).over(own))
    rows = rows.withColumn("__extra", amount - least * F.col("__n")).withColumn("__total", F.sum("__w").over(own))
    rows = rows.withColumn("__raw", F.col("__extra") * F.col("__w") / F.when(F.col("__total") > 0, F.col("__total")).otherwise(1.0))
    rows = rows.withColumn("__floor", F.floor("__raw"))
    rank = F.row_number().over(own.orderBy(F.round(F.col("__floor") - F.col("__raw"), 9), *order))
    rows = rows.withColumn("__rest", F.col("__extra") - F.sum("__floor").over(own)).withColumn("__rank", rank)
    share = F.when(F.col("__extra") >= 0, (F.col("__floor") + (F.col("__rank") <= F.col("__rest")).cast("long") + least).cast("long"))
    return rows.withColumn(name, share).drop("__w", "__n", "__extra", "__total", "__raw", "__floor", "__rest", "__rank")


def even_split(rows: DataFrame, group: list[str], order: list[str], total: Column, name: str = "share") -> DataFrame:
    """Whole equal shares of ``total`` in each group; the remainder goes to the last rows, one each."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    base = F.floor(total / n)
    return rows.withColumn(name, (base + (place > n - (total - base * n)).cast("long")).cast("long"))


def assign_scores(rows: DataFrame, group: list[str], order: list[str], kind: Column, flexible: str, base: Column, weight: Column, total: Column, name: str = "assigned", place: Column | None = None) -> DataFrame:
    """Scores of a paper's questions that add up to ``total`` exactly.

    Kinds but the flexible one get a rounded score common to the kind; the flexible kind shares the
    rest by weight; in a paper without that kind its last kind does, by ``place`` (or else by name).  If the rest
    is less than one each, all questions share by weight.
    """
    own = Window.partitionBy(*group)
    rows = rows.withColumn("__place", kind if place is None else place).withColumn("__has", F.max((kind == flexible).cast("int")).over(own))
    rows = rows.withColumn("__flex", F.when(F.col("__has") == 1, kind == flexible).otherwise(F.col("__place") == F.max("__place").over(own))).withColumn("__wt", weight.cast("double"))
    # Nine digits first, as for remainders: a half must not depend on the order in which weights were added.
    rows = rows.withColumn("__each", F.greatest(F.lit(1), F.bround(F.round(base * total / F.sum("__wt").over(own), 9), 0)).cast("long"))
    rows = rows.withColumn("__fixed", F.sum(F.when(~F.col("__flex"), F.col("__each")).otherwise(0)).over(own))
    rows = rows.withColumn("__m", F.sum(F.col("__flex").cast("int")).over(own))
    rows = rows.withColumn("__split", (F.col("__m") > 0) & (total - F.col("__fixed") >= F.col("__m")))
    rows = rows.withColumn("__part", F.when(F.col("__split"), F.col("__flex")).otherwise(F.lit(True)))
    amount = F.when(F.col("__split"), total - F.col("__fixed")).otherwise(total)
    shared = apportion(rows.withColumn("__amount", F.when(F.col("__part"), amount).otherwise(F.lit(1 << 40))), [*group, "__part"], order, F.col("__wt"), F.col("__amount"), name="__share")
    out = shared.withColumn(name, F.when(F.col("__part"), F.col("__share")).otherwise(F.col("__each")))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def scale(rows: DataFrame, group: list[str], order: list[str], score: Column, total: Column, name: str = "scaled") -> DataFrame:
    """Scores scaled to whole numbers that add up to ``total`` (largest remainders)."""
    return apportion(rows, group, order, score, total, 0, name)
