"""Faceted counting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def self_excluding(rows: DataFrame, filters: dict[str, Column], values: dict[str, Column], missing: str = "unclassified") -> DataFrame:
    """(dim, value, items): each dimension counted over rows that pass all filters but its own.

    One scan: a row counts for a dimension if no filter fails, or only that dimension's.
    """
    ok = {d: F.coalesce(filters.get(d, F.lit(True)), F.lit(False)) for d in values}
    fails = reduce(Column.__add__, [(~v).cast("int") for v in ok.values()])
    cells = [F.when((fails == 0) | ((fails == 1) & ~ok[d]), F.struct(F.lit(d).alias("dim"), F.coalesce(F.nullif(v.cast("string"), F.lit("")), F.lit(missing)).alias("value"))) for d, v in values.items()]
    return rows.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.dim", "c.value").agg(F.count(F.lit(1)).alias("items"))


def fixed_order(counts: DataFrame, value: str, order: list[str], count: str = "items") -> DataFrame:
    """With ``position`` by a fixed list; values off the list come after it, by falling count, then name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(value))
    return counts.withColumn("position", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))


def always_shown(spark: SparkSession, counts: DataFrame, value: str, always: list[str], count: str = "items") -> DataFrame:
    """Listed values with zero counts where absent; unlisted ones only if they have any."""
    listed = spark.createDataFrame([(v,) for v in always], f"`{value}` string")
    return listed.join(counts, value, "full").withColumn(count, F.coalesce(count, F.lit(0))).where(F.col(value).isin(always) | (F.col(count) > 0))


def meta_facets(rows: DataFrame, region: Column, grade: Column, years: Column, grades: list[str]) -> DataFrame:
    """(facet, value, items, position): regions by falling count, grades by a fixed list, each row's least year downwards; empty ones are skipped."""
    cells = F.array(F.struct(F.lit("region").alias("facet"), F.nullif(region, F.lit("")).alias("value")), F.struct(F.lit("grade").alias("facet"), F.nullif(grade, F.lit("")).alias("value")), F.struct(F.lit("year").alias("facet"), F.array_min(years).cast("string").alias("value")))
    counts = rows.select(F.explode(cells).alias("c")).select("c.*").where("value IS NOT NULL").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("items"))
    place = F.array_position(F.array(*map(F.lit, grades)), F.col("value"))
    key = F.when(F.col("facet") == "region", -F.col("items")).when(F.col("facet") == "year", -F.col("value").cast("int")).otherwise(F.when(place > 0, place).otherwise(99))
    return counts.withColumn("position", F.row_number().over(Window.partitionBy("facet").orderBy(key, "value")))


def folded(counts: DataFrame, value: str, always: list[str], other: str, missing: str, count: str = "items") -> DataFrame:
    """Counts of listed values (zero where absent), the rest as ``other`` and empty ones as ``missing``, both only if there are any."""
    v = F.coalesce(F.col(value), F.lit(""))
    name = F.when(v == "", missing).when(v.isin(always), v).otherwise(other)
    sums = counts.groupBy(name.alias(value)).agg(F.sum(count).cast("long").alias(count))
    return always_shown(counts.sparkSession, sums, value, always, count)
