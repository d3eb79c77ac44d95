"""Usage costs and prices over the events table: purpose is the type, cost the value, tokens come from the JSON."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from itemloom.operators import costs, pricing
from itemloom.plans.registry import query
from itemloom.sources.tables import table
from itemloom.streaming import state

# Prices stay exact decimals in sums, so that their order doesn't show in the last digit.
_USAGE = """SELECT event_id, ts, user_id, event_type AS purpose, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN NULL ELSE value::DECIMAL(18,2) END AS cost,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, json_extract_string(props, '$.k')::BIGINT AS tokens, event_id % 500 AS job_id,
 CASE WHEN event_id % 5 = 0 THEN 'USD' ELSE 'CNY' END AS currency, 'm' || (user_id % 4) AS model FROM events"""


def _usage(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("purpose"), F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), None).otherwise(F.col("value").cast("decimal(18,2)")).alias("cost"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_id") % 500).alias("job_id"),
        F.when(F.col("event_id") % 5 == 0, "USD").otherwise("CNY").alias("currency"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
    )


def _double(df, *names):
    return df.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])


def _breakdown(dim):
    return f"SELECT {dim}, coalesce(sum(cost), 0)::DOUBLE AS cost, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, count(DISTINCT job_id) AS jobs, count(*) FILTER (cost IS NULL) AS unpriced FROM ({_USAGE}) GROUP BY 1"


def _broken(spark, d, dim):
    rows = _usage(spark, d).withColumn("cost", F.col("cost"))
    out = rows.groupBy(dim).agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.count_distinct("job_id").alias("jobs"), F.count_if(F.col("cost").isNull()).alias("unpriced"))
    return _double(out, "cost")


@query(_breakdown("purpose"))
def cost_breakdown_purpose(spark, d):
    return _broken(spark, d, "purpose")


@query(_breakdown("model"))
def cost_breakdown_model(spark, d):
    return _broken(spark, d, "model")


@query(_breakdown("user_id"))
def cost_breakdown_user(spark, d):
    return _broken(spark, d, "user_id")


@query(" UNION ALL ".join(f"SELECT '{x}' AS dim, * FROM ({_breakdown(x).replace(f'SELECT {x},', f'SELECT {x}::VARCHAR AS key,', 1)})" for x in ("purpose", "model", "currency")))
def cost_breakdowns(spark, d):
    """All breakdowns in one scan."""
    return _double(costs.breakdowns(_usage(spark, d), ["purpose", "model", "currency"]), "cost")


@query(
    f"""WITH u AS ({_USAGE}), c AS (SELECT user_id, currency, sum(cost) AS s FROM u GROUP BY 1, 2), m AS (SELECT user_id, currency AS main FROM c WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, currency) = 1)
    SELECT user_id, main, count(*) AS calls, sum(CASE WHEN purpose <> 'view' THEN tokens ELSE 0 END)::BIGINT AS tokens, sum(CASE WHEN purpose = 'view' THEN tokens ELSE 0 END)::BIGINT AS pages, sum(CASE WHEN currency = main THEN cost END)::DOUBLE AS cost,
    coalesce(string_agg(DISTINCT CASE WHEN currency = main AND cost IS NOT NULL THEN NULL ELSE model END, ','), '') AS unpriced_models FROM u LEFT JOIN m USING (user_id) GROUP BY 1, 2"""
)
def usage_summary_main_currency(spark, d):
    return _double(costs.summary(_usage(spark, d), ["user_id"], "tokens", "tokens", F.col("purpose") != "view"), "cost")


@query(f"SELECT day::DATE AS day, coalesce(calls, 0) AS calls, coalesce(cost, 0)::DOUBLE AS cost FROM generate_series(DATE '2023-12-25', DATE '2024-02-10', INTERVAL 1 DAY) g(day) LEFT JOIN (SELECT (ts + INTERVAL 8 HOUR)::DATE AS d, count(*) AS calls, sum(cost) AS cost FROM ({_USAGE}) GROUP BY 1) ON d = day::DATE")
def daily_cost_gapfill(spark, d):
    day = F.from_utc_timestamp("ts", "+08:00").cast("date")
    return _double(costs.daily(_usage(spark, d), day, "2023-12-25", "2024-02-10"), "cost")


@query(f"SELECT h::INT AS hour, h IN (9, 10, 11, 14, 15, 16, 17) AS peak, coalesce(calls, 0) AS calls, coalesce(cost, 0)::DOUBLE AS cost FROM range(24) g(h) LEFT JOIN (SELECT hour(ts + INTERVAL 8 HOUR) AS x, count(*) AS calls, sum(cost) AS cost FROM ({_USAGE}) GROUP BY 1) ON x = h")
def hourly_histogram(spark, d):
    hour = F.hour(F.from_utc_timestamp("ts", "+08:00"))
    return _double(costs.hourly(_usage(spark, d), hour, [9, 10, 11, 14, 15, 16, 17]), "cost")


_PEAK = "isodow(ts + INTERVAL 8 HOUR) <= 5 AND ((hour(ts + INTERVAL 8 HOUR) >= 9 AND hour(ts + INTERVAL 8 HOUR) < 12) OR (hour(ts + INTERVAL 8 HOUR) >= 14 AND hour(ts + INTERVAL 8 HOUR) < 18))"


@query(f"SELECT purpose, sum(CASE WHEN {_PEAK} THEN cost ELSE 0 END)::DOUBLE AS peak_cost, sum(cost)::DOUBLE AS cost, round(sum(CASE WHEN {_PEAK} THEN cost ELSE 0 END)::DOUBLE / sum(cost)::DOUBLE, 4) AS share FROM ({_USAGE}) GROUP BY 1")
def peak_cost_share(spark, d):
    from itemloom.functions.maths import is_peak

    ranges = F.array(F.array(F.lit(9), F.lit(12)), F.array(F.lit(14), F.lit(18)))
    rows = _usage(spark, d).withColumn("peak", is_peak(F.col("ts"), ranges, F.lit(True)))
    out = rows.groupBy("purpose").agg(F.sum(F.when(F.col("peak"), F.coalesce("cost", F.lit(0))).otherwise(0)).cast("double").alias("peak_cost"), F.sum("cost").cast("double").alias("cost"))
    return out.withColumn("share", costs.share(F.col("peak_cost"), F.col("cost")))


@query(
    f"""SELECT sum(CASE WHEN ts >= '2024-01-16' THEN cost ELSE 0 END)::DOUBLE AS cost, count(*) FILTER (ts >= '2024-01-16') AS calls, sum(CASE WHEN ts < '2024-01-16' THEN cost ELSE 0 END)::DOUBLE AS previous_cost, count(*) FILTER (ts < '2024-01-16') AS previous_calls,
    round((sum(CASE WHEN ts >= '2024-01-16' THEN cost ELSE 0 END)::DOUBLE - sum(CASE WHEN ts < '2024-01-16' THEN cost ELSE 0 END)::DOUBLE) / sum(CASE WHEN ts < '2024-01-16' THEN cost ELSE 0 END)::DOUBLE, 4) AS change,
    round(sum(CASE WHEN ts >= '2024-01-16' THEN cost ELSE 0 END)::DOUBLE / 10 * 30, 4) AS projected_month FROM ({_USAGE}) WHERE ts >= '2024-01-06' AND ts < '2024-01-26'"""
)
def period_over_period(spark, d):
    at = lambda x: F.lit(x).cast("timestamp")
    out = costs.compare_periods(_usage(spark, d).withColumn("cost", F.coalesce(F.col("cost"), F.lit(0)).cast("decimal(18,2)").cast("double")), F.col("ts"), at("2024-01-16"), at("2024-01-26"), at("2024-01-06"))
    return out.withColumn("cost", F.round("cost", 2)).withColumn("previous_cost", F.round("previous_cost", 2))


@query(f"SELECT job_id, sum(cost)::DOUBLE AS cost, count(*) AS calls FROM ({_USAGE}) GROUP BY 1 ORDER BY sum(cost) DESC, calls DESC, job_id LIMIT 10")
def top_jobs(spark, d):
    return _double(costs.top_jobs(_usage(spark, d), "job_id", 10), "cost")


@query(f"SELECT job_id % 50 AS batch, status, count(*) AS jobs FROM ({_USAGE}) GROUP BY 1, 2")
def batch_status_counts(spark, d):
    return _usage(spark, d).groupBy((F.col("job_id") % 50).alias("batch"), "status").agg(F.count(F.lit(1)).alias("jobs"))


@query(f"SELECT user_id, round(sum(cost)::DOUBLE / nullif(count(DISTINCT job_id), 0), 4) AS per_job, round(sum(cost)::DOUBLE / nullif(sum(tokens), 0), 6) AS per_token, round(sum(tokens) FILTER (status = 'error')::DOUBLE / nullif(sum(tokens), 0), 4) AS error_rate FROM ({_USAGE}) WHERE cost IS NOT NULL GROUP BY 1")
def unit_costs(spark, d):
    rows = _usage(spark, d).where("cost IS NOT NULL")
    out = rows.groupBy("user_id").agg(F.sum("cost").cast("double").alias("c"), F.count_distinct("job_id").alias("j"), F.sum("tokens").alias("t"), F.sum(F.when(F.col("status") == "error", F.col("tokens"))).alias("e"))
    return out.select("user_id", costs.share(F.col("c"), F.col("j")).alias("per_job"), costs.share(F.col("c"), F.col("t"), 6).alias("per_token"), costs.share(F.col("e"), F.col("t")).alias("error_rate"))


_PRICES = "(VALUES (1, 'm0', TIMESTAMP '2024-01-05', 2.0, 8.0, NULL), (2, 'm0', TIMESTAMP '2024-01-15', 3.0, 9.0, NULL), (3, 'm0', TIMESTAMP '2024-01-15', 4.0, 12.0, 50), (4, 'm1', TIMESTAMP '2024-01-10', 1.0, 2.0, NULL), (5, 'm2', TIMESTAMP '2024-01-01', 5.0, 6.0, NULL))"
_PRICE_ROWS = [(1, "m0", "2024-01-05", 2.0, 8.0, None), (2, "m0", "2024-01-15", 3.0, 9.0, None), (3, "m0", "2024-01-15", 4.0, 12.0, 50), (4, "m1", "2024-01-10", 1.0, 2.0, None), (5, "m2", "2024-01-01", 5.0, 6.0, None)]


@query(
    f"""WITH p AS (SELECT * FROM {_PRICES} v(price_id, model, since, inp, outp, bound)), u AS (SELECT event_id, model, ts, tokens FROM ({_USAGE})),
    back AS (SELECT event_id, price_id, inp, outp FROM u JOIN p ON u.model = p.model AND p.since <= u.ts QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p.since DESC, price_id DESC) = 1),
    fwd AS (SELECT event_id, price_id, inp, outp FROM u JOIN p ON u.model = p.model QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p.since, price_id) = 1)
    SELECT u.event_id, coalesce(b.price_id, f.price_id) AS price_id, round((tokens * coalesce(b.inp, f.inp)::DOUBLE + 10 * coalesce(b.outp, f.outp)::DOUBLE) / 1000000, 8) AS cost FROM u LEFT JOIN back b ON u.event_id = b.event_id LEFT JOIN fwd f ON u.event_id = f.event_id"""
)
def price_asof_cost(spark, d):
    """Calls at the price then in force; those before a model's first price at that one."""
    from itemloom.functions.maths import call_cost, pick_tier

    prices = spark.createDataFrame(_PRICE_ROWS, "price_id int, model string, at string, inp double, outp double, bound int").withColumn("at", F.col("at").cast("timestamp"))
    none = F.lit(None).cast("double")
    tier = F.struct(F.col("inp").alias("input"), F.col("outp").alias("output"), none.alias("input_offpeak"), none.alias("output_offpeak"), none.alias("cached_input"), none.alias("cached_input_offpeak"), F.col("bound").alias("max_input"), F.lit(None).cast("string").alias("mode"))
    met = pricing.as_of(_usage(spark, d).select("event_id", "model", "ts", "tokens"), prices.withColumn("tiers", F.array(tier)), ["model"], "ts", "at", "price_id")
    chosen = met.withColumn("tier", pick_tier(F.col("tiers"), F.col("tokens"), F.lit(False)))
    return chosen.select("event_id", "price_id", call_cost(F.col("tier"), F.lit(True), F.col("tokens"), F.lit(10), F.lit(0), none).alias("cost"))


@query("SELECT l_partkey, l_shipdate, l_orderkey, l_discount FROM (SELECT *, lag(l_discount) OVER w AS p, row_number() OVER w AS r FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) WHERE r = 1 OR p IS DISTINCT FROM l_discount")
def price_history(spark, d):
    rows = table(spark, d, "lineitem", "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    out = pricing.append_on_change(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"], ["l_discount"])
    return out.select("l_partkey", F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"), "l_orderkey", "l_discount")


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 90 SECOND")
def online_users(spark, d):
    seen = state.presence(table(spark, d, "events"), "user_id", "ts")
    return state.online(seen, "2024-01-30 23:00:00").select("user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) AS stage, max(event_id) AS percent FROM events GROUP BY 1")
def task_progress(spark, d):
    return state.progress(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def tasks_once(spark, d):
    return state.once(table(spark, d, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type")


@query("WITH RECURSIVE c AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL SELECT * FROM (SELECT c.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = c.user_id AND e.ts >= c.ts + INTERVAL 24 HOUR) AS ts FROM c) WHERE ts IS NOT NULL) SELECT user_id, ts FROM c")
def daily_claims(spark, d):
    return state.claim(table(spark, d, "events"), "user_id", "ts").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT DISTINCT model FROM (SELECT p_brand AS model FROM part UNION SELECT p_type FROM part)")
def model_names(spark, d):
    parts = table(spark, d, "part", "p_brand", "p_type")
    return parts.select(F.col("p_brand").alias("model")).union(parts.select("p_type")).distinct()


_TIERS = "CASE WHEN event_id % 4 = 0 THEN 3.0 WHEN tokens * 1000 <= 20000 THEN 1.0 WHEN tokens * 1000 <= 50000 THEN 2.0 ELSE 5.0 END::DOUBLE"
_PEAK_OFF = f"CASE WHEN {_PEAK} OR event_id % 4 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE"


@query(f"SELECT event_id, round(((tokens * 1000 - least(event_id % 5 * 4000, tokens * 1000)) * ({_TIERS} * {_PEAK_OFF}) + least(event_id % 5 * 4000, tokens * 1000) * ({_TIERS} * {_PEAK_OFF} * CASE WHEN event_id % 4 = 0 THEN 0.2 ELSE 0.25 END::DOUBLE) + 100 * (4 * {_TIERS} * {_PEAK_OFF})) / 1000000, 6) AS cost FROM ({_USAGE})")
def tiered_cost(spark, d):
    """Tiers by prompt size, one for thinking calls, with idle prices and prices of cached tokens, given or as a share."""
    none = F.lit(None)
    tier = lambda bound, price, mode: F.struct(F.lit(bound).cast("int").alias("max_input"), F.lit(price).alias("input"), F.lit(4 * price).alias("output"), (none.cast("double") if mode else F.lit(price / 2)).alias("input_offpeak"), (none.cast("double") if mode else F.lit(2 * price)).alias("output_offpeak"), (none.cast("double") if mode else F.lit(price / 4)).alias("cached_input"), (none.cast("double") if mode else F.lit(price / 8)).alias("cached_input_offpeak"), F.lit(mode).cast("string").alias("mode"))
    tiers = F.array(tier(50000, 2.0, None), tier(None, 5.0, None), tier(20000, 1.0, None), tier(None, 3.0, "thinking"))
    peak = F.struct(F.array(F.array(F.lit(9), F.lit(12)), F.array(F.lit(14), F.lit(18))).alias("ranges"), F.lit(True).alias("weekdays_only"))
    rows = _usage(spark, d).select("event_id", "ts", (F.col("tokens") * 1000).alias("prompt"), F.lit(100).alias("completion"), F.when(F.col("event_id") % 4 == 0, 7).otherwise(0).alias("reasoning"), (F.col("event_id") % 5 * 4000).alias("cached"), tiers.alias("tiers"), peak.alias("peak"), F.lit(0.2).alias("cache_ratio"))
    out = pricing.price_calls(rows, F.col("ts"), "prompt", "completion", "reasoning", "cached")
    return out.select("event_id", F.round("cost", 6).alias("cost"))


@query(f"SELECT event_id, CASE WHEN purpose = 'view' THEN tokens * 0.05::DOUBLE WHEN model = 'm0' THEN NULL ELSE ((tokens - least(tokens, 20)) * 2.0::DOUBLE + least(tokens, 20) * CASE WHEN model = 'm1' THEN 1.0 ELSE 2.0 END::DOUBLE + 10 * 6.0::DOUBLE) / 1000000 END AS cost FROM ({_USAGE})")
def configured_costs(spark, d):
    """Costs from configured prices where none is stored: by page, by token, or none for a model without a price."""
    price = F.when(F.col("model") != "m0", F.struct(F.lit(2.0).alias("input"), F.lit(6.0).alias("output"), F.when(F.col("model") == "m1", 1.0).alias("cached_input")))
    provider = F.when(F.col("purpose") == "view", "mineru").otherwise("llm")
    return _usage(spark, d).select("event_id", pricing.configured_cost(provider, F.col("tokens"), F.col("tokens"), F.lit(10), F.lit(20), price, 0.05).alias("cost"))


@query("SELECT 'p' || p_partkey AS name, p_size::DOUBLE AS input, 2.0::DOUBLE * p_size AS output, CASE WHEN p_size % 2 = 0 THEN p_size / 2.0::DOUBLE END AS cached_input FROM part WHERE p_partkey % 5 > 0")
def listed_prices(spark, d):
    """A list of models in JSON; variants, repeats and models without a price are left out."""
    million = lambda c: (c / 1e6).cast("string")
    size = F.col("p_size")
    price = F.struct(F.when(F.col("p_partkey") % 5 > 0, million(size)).alias("prompt"), million(size * 2).alias("completion"), F.when(size % 2 == 0, million(size / 2)).alias("input_cache_read"))
    key = F.col("p_partkey").cast("string")
    models = F.array(F.struct(F.concat(F.lit("v/P"), key).alias("id"), price.alias("pricing")), F.struct(F.concat(F.lit("v/P"), key, F.lit(":batch")).alias("id"), price.alias("pricing")), F.struct(F.concat(F.lit("w/p"), key).alias("id"), F.struct(F.when(F.col("p_partkey") % 5 > 0, F.lit("9")).alias("prompt"), F.lit("9").alias("completion"), F.lit(None).cast("string").alias("input_cache_read")).alias("pricing")))
    rows = table(spark, d, "part", "p_partkey", "p_size").select(F.to_json(F.struct(models.alias("data"))).alias("json"))
    return pricing.listed_prices(rows, "json")


@query("SELECT DISTINCT 'x/' || p_name AS used_name, 'direct/' || upper(p_name) AS listed_name FROM part")
def matched_names(spark, d):
    """Names in use and listed ones that mean the same, a direct vendor's before a reseller's."""
    names = table(spark, d, "part", "p_name").distinct()
    used = names.select(F.concat(F.lit("x/"), F.col("p_name")).alias("name"))
    listed = names.select(F.concat(F.lit("a/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"), F.lit("a").alias("vendor")).unionByName(names.select(F.concat(F.lit("direct/"), F.upper("p_name")).alias("name"), F.lit("direct").alias("vendor")))
    return pricing.match_names(used, listed, "name", "vendor", ["direct"])


@query(f"SELECT purpose, coalesce(sum(cost), 0)::DOUBLE AS cost, count(*) AS calls, (row_number() OVER (ORDER BY coalesce(sum(cost), 0) DESC, count(*) DESC, purpose))::INT AS position FROM ({_USAGE}) GROUP BY 1")
def cost_order(spark, d):
    """Breakdown rows by falling cost, then calls, then name; five rows a report."""
    rows = _usage(spark, d).groupBy("purpose").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.count(F.lit(1)).alias("calls"))
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("cost"), F.desc("calls"), "purpose")))
    return _double(ranked, "cost")


@query(f"SELECT round(sum(cost)::DOUBLE / 30, 6) AS avg_daily, round(sum(CASE WHEN status <> 'ok' THEN cost ELSE 0 END)::DOUBLE, 6) AS error_cost, round(sum(least(tokens, event_id % 40))::DOUBLE / sum(tokens), 4) AS cache_hit_rate, round(sum(CASE WHEN job_id % 3 = 0 THEN cost ELSE 0 END)::DOUBLE / count(DISTINCT CASE WHEN job_id % 3 = 0 THEN job_id END), 6) AS per_done_job FROM ({_USAGE}) WHERE ts >= TIMESTAMP '2023-12-31 16:00:00' AND ts < TIMESTAMP '2024-01-30 16:00:00'")
def cost_ratios(spark, d):
    """Daily mean, cost of failures, cached share and cost a finished job, of thirty days in UTC+8 as a range of UTC instants."""
    start, end = costs.utc_range("2024-01-01", "2024-01-30")
    rows = _usage(spark, d).where((F.col("ts") >= start) & (F.col("ts") < end)).withColumn("cached", F.least("tokens", F.col("event_id") % 40))
    return costs.ratios(rows, 30, "tokens", "cached", F.col("job_id") % 3 == 0)


@query("SELECT c_custkey, c_name, count(DISTINCT event_type) > 0 AS online FROM customer LEFT JOIN (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-30 20:00:00') ON user_id = c_custkey GROUP BY 1, 2")
def users_online(spark, d):
    """All users, with whether any of their sessions was seen of late."""
    seen = state.presence(table(spark, d, "events", "user_id", "event_type", "ts"), "user_id", "ts")
    live = state.online(seen, "2024-01-30 23:00:00", 3 * 3600).select(F.col("user_id").alias("c_custkey"), F.lit(True).alias("online")).dropDuplicates(["c_custkey"])
    return table(spark, d, "customer", "c_custkey", "c_name").join(live, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("online", F.lit(False)).alias("online"))


@query("SELECT user_id, ts, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE r = 1 OR p IS DISTINCT FROM event_type")
def changed_snapshots(spark, d):
    out = state.changes(table(spark, d, "events", "user_id", "ts", "event_type"), "user_id", "ts", "event_type")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    w AS (SELECT user_id, i, ts, true AS allowed, ts AS begun, CASE WHEN ok THEN 0 ELSE 1 END AS used FROM e WHERE i = 1
    UNION ALL SELECT user_id, i, ts, u < 2, CASE WHEN fresh THEN ts ELSE begun END, CASE WHEN u < 2 AND ok THEN 0 ELSE u + 1 END FROM (SELECT e.*, w.begun, w.used = 0 OR e.ts >= w.begun + INTERVAL 720 MINUTE AS fresh, CASE WHEN w.used = 0 OR e.ts >= w.begun + INTERVAL 720 MINUTE THEN 0 ELSE w.used END AS u FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))
    SELECT user_id, ts, allowed FROM w"""
)
def throttled_attempts(spark, d):
    """Two attempts in half a day that the first one opens; a success starts anew."""
    rows = table(spark, d, "events", "user_id", "ts", "event_type").withColumn("ok", F.col("event_type") == "purchase")
    out = state.throttle(rows, "user_id", "ts", "ok", 2, 720)
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "allowed")
