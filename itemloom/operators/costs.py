"""Usage cost reports: summaries, trends, breakdowns and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def breakdown(rows: DataFrame, keys: list[str], cost: str = "cost", status: str = "status", job: str = "job_id") -> DataFrame:
    """Per key: cost, calls, errors, jobs and calls without a price."""
    return rows.groupBy(*keys).agg(
        F.round(F.sum(F.coalesce(cost, F.lit(0.0))), 6).alias("cost"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col(status) == "error").alias("errors"),
        F.count_distinct(job).alias("jobs"), F.count_if(F.col(cost).isNull()).alias("unpriced"),
    )


def breakdowns(rows: DataFrame, dims: list[str], cost: str = "cost", status: str = "status", job: str = "job_id") -> DataFrame:
    """All one-dimensional breakdowns (dim, key, ...) in one pass over the rows."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("key")) for d in dims])).alias("c"), cost, status, job)
    return breakdown(each.select("c.dim", "c.key", cost, status, job), ["dim", "key"], cost, status, job)


def summary(rows: DataFrame, keys: list[str], tokens: str, pages: str, is_tokens: Column, cost: str = "cost", currency: str = "currency", model: str = "model") -> DataFrame:
    """Per key: counts, tokens, pages, cost in the main currency, and models without a price in it.

    The main currency has the largest cost, ties to the smaller name; it is null if nothing is
    priced.  A call priced in another currency counts as unpriced.
    """
    per = rows.groupBy(*keys, currency).agg(F.sum(cost).alias("__c")).where(F.col("__c").isNotNull())
    main = per.groupBy(*keys).agg(F.min_by(F.col(currency), F.struct(-F.col("__c"), F.col(currency))).alias("main"))
    joined = rows.join(main, keys, "left")
    own = F.when(F.col(currency) == F.col("main"), F.col(cost))
    return joined.groupBy(*keys, "main").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.when(is_tokens, F.col(tokens)).otherwise(0)).alias("tokens"), F.sum(F.when(~is_tokens, F.col(pages)).otherwise(0)).alias("pages"),
        F.round(F.sum(own), 6).alias("cost"), F.array_join(F.array_sort(F.collect_set(F.when(own.isNull(), F.col(model)))), ",").alias("unpriced_models"),
    )


def daily(rows: DataFrame, day: Column, start: str, end: str, cost: str = "cost") -> DataFrame:
    """(day, calls, cost) for every day from start to end, zero where there is none."""
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    sums = rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost"))
    return days.join(sums, "day", "left").select("day", F.coalesce("calls", F.lit(0)).alias("calls"), F.round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost"))


def hourly(rows: DataFrame, hour: Column, peak_hours: list[int], cost: str = "cost") -> DataFrame:
    """(hour, peak, calls, cost) for 24 hours."""
    hours = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"), F.col("id").isin(peak_hours).alias("peak"))
    sums = rows.groupBy(hour.cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost"))
    return hours.join(sums, "hour", "left").select("hour", "peak", F.coalesce("calls", F.lit(0)).alias("calls"), F.round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost"))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, null where whole is 0."""
    return F.round(F.try_divide(part, whole), digits)


def compare_periods(rows: DataFrame, at: Column, start: Column, end: Column, previous: Column, cost: str = "cost") -> DataFrame:
    """Costs and calls of [start, end) and of [previous, start), and what is derived from them."""
    now, before = (at >= start) & (at < end), (at >= previous) & (at < start)
    days = F.date_diff(end.cast("date"), start.cast("date"))
    out = rows.where((at >= previous) & (at < end)).agg(
        F.round(F.sum(F.when(now, F.col(cost)).otherwise(0.0)), 6).alias("cost"), F.count_if(now).alias("calls"),
        F.round(F.sum(F.when(before, F.col(cost)).otherwise(0.0)), 6).alias("previous_cost"), F.count_if(before).alias("previous_calls"),
    )
    return out.withColumn("change", share(F.col("cost") - F.col("previous_cost"), F.col("previous_cost"))).withColumn("projected_month", F.round(F.col("cost") / days * 30, 4))


def top_jobs(rows: DataFrame, job: str, limit: int, cost: str = "cost") -> DataFrame:
    each = rows.groupBy(job).agg(F.round(F.sum(cost), 6).alias("cost"), F.count(F.lit(1)).alias("calls"))
    return each.orderBy(F.desc("cost"), F.desc("calls"), job).limit(limit)


def utc_range(start: str, end: str, zone: str = "+08:00") -> tuple[Column, Column]:
    """The days from ``start`` to ``end`` of a zone as [from, to) in UTC, which a scan can push down to the raw column."""
    midnight = lambda day: F.to_utc_timestamp(day.cast("timestamp"), zone)
    return midnight(F.lit(start).cast("date")), midnight(F.date_add(F.lit(end).cast("date"), 1))


def ratios(rows: DataFrame, days: int, prompt: str, cached: str, done: Column, cost: str = "cost", status: str = "status", job: str = "job_id") -> DataFrame:
    """Daily mean, cost of calls that failed, share of cached prompt tokens, and cost a job that is done."""
    own = F.sum(F.when(done, F.col(cost)).otherwise(0)).cast("double")
    return rows.agg(
        F.round(F.sum(cost).cast("double") / days, 6).alias("avg_daily"), F.round(F.sum(F.when(F.col(status) != "ok", F.col(cost)).otherwise(0)).cast("double"), 6).alias("error_cost"),
        share(F.sum(cached).cast("double"), F.sum(prompt)).alias("cache_hit_rate"), share(own, F.count_distinct(F.when(done, F.col(job))), 6).alias("per_done_job"),
    )
