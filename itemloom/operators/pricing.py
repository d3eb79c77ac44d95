"""Prices that change over time: history, as-of lookup and the pricing of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions.maths import call_cost, is_peak, pick_tier
from itemloom.functions.text import strip
from itemloom.sources.tables import cut


def append_on_change(history: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows of a price history whose values differ from the row before, per key; the first always stays."""
    w = Window.partitionBy(*key).orderBy(*order)
    now, before = F.struct(*values), F.lag(F.struct(*values)).over(w)
    return history.withColumn("__same", now.eqNullSafe(before) & F.lag(F.lit(1)).over(w).isNotNull()).where(~F.col("__same")).drop("__same")


def intervals(prices: DataFrame, key: list[str], at: str, row_id: str) -> DataFrame:
    """Prices with [valid_from, valid_to): the latest from its time on, ties to the larger id.

    Times before a key's first price fall to that first time's row of the smallest id, so those
    get an interval of their own without a beginning.
    """
    w = Window.partitionBy(*key, at)
    edge = prices.withColumn("__top", F.max(row_id).over(w)).withColumn("__low", F.min(row_id).over(w)).withColumn("__first", F.min(at).over(Window.partitionBy(*key)))
    regular = edge.where(F.col(row_id) == F.col("__top")).withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(Window.partitionBy(*key).orderBy(at)))
    early = edge.where((F.col(at) == F.col("__first")) & (F.col(row_id) == F.col("__low"))).withColumn("valid_from", F.lit(None).cast(prices.schema[at].dataType)).withColumn("valid_to", F.col(at))
    return regular.unionByName(early).drop("__top", "__low", "__first")


def as_of(calls: DataFrame, prices: DataFrame, key: list[str], at: str, price_at: str, row_id: str, source: str | None = None, sources: list[str] | None = None, small: int = 20_000) -> DataFrame:
    """Each call with the price that was in force, left-joined.

    With ``sources``, the first of them that has any price for the key decides, whatever its times.
    Up to ``small`` intervals, counted first, are broadcast, so that calls of a common model stay where they are;
    more are joined by key, where adaptive execution splits hot keys.
    """
    if source and sources:
        rank = F.array_position(F.array(*map(F.lit, sources)), F.col(source))
        ranked = prices.withColumn("__rank", rank).where("__rank > 0")
        best = ranked.groupBy(*key).agg(F.min("__rank").alias("__rank"))
        prices = ranked.join(best, [*key, "__rank"], "left_semi").drop("__rank")
    spans = intervals(prices, key, price_at, row_id)
    if spans.limit(small + 1).count() <= small:
        spans = F.broadcast(spans)
    on = [calls[k] == spans[k] for k in key]
    on += [spans["valid_from"].isNull() | (calls[at] >= spans["valid_from"]), spans["valid_to"].isNull() | (calls[at] < spans["valid_to"])]
    kept = [spans[c] for c in spans.columns if c not in key]
    return calls.join(spans, on, "left").select(*[calls[c] for c in calls.columns], *kept)


def price_calls(priced: DataFrame, at: Column, prompt: str, completion: str, reasoning: str, cached: str, tiers: str = "tiers", peak: str = "peak", ratio: str = "cache_ratio") -> DataFrame:
    """Adds ``cost`` to calls joined with their price row; null where there is no tier."""
    tier = pick_tier(F.col(tiers), F.col(prompt), F.col(reasoning) > 0)
    rush = is_peak(at, F.col(f"{peak}.ranges"), F.col(f"{peak}.weekdays_only"))
    return priced.withColumn("__tier", tier).withColumn("cost", call_cost(F.col("__tier"), rush, F.col(prompt), F.col(completion), F.col(cached), F.col(ratio))).drop("__tier")


def match_names(used: DataFrame, listed: DataFrame, name: str, vendor: str, direct: list[str]) -> DataFrame:
    """Model names in use with the listed name that means the same; direct vendors before resellers, then by name."""
    key = lambda c: F.regexp_replace(F.lower(F.element_at(F.split(c, "/"), -1)), r"[^a-z0-9]", "")
    a = used.select(F.col(name).alias("used_name"), key(F.col(name)).alias("k")).distinct()
    b = listed.select(F.col(name).alias("listed_name"), F.col(vendor), key(F.col(name)).alias("k"))
    order = F.struct(~F.col(vendor).isin(direct), F.col(vendor), F.col("listed_name"))
    return a.join(b, "k").groupBy("used_name").agg(F.min_by("listed_name", order).alias("listed_name"))


def configured_cost(provider: Column, pages: Column, prompt: Column, completion: Column, cached: Column, price: Column, per_page: float | None) -> Column:
    """Cost of a call without a stored one: by page for readers, else by ``price`` (input, output, cached_input); null without a price."""
    hit = F.least(cached, prompt)
    tokens = ((prompt - hit) * price["input"] + hit * F.coalesce(price["cached_input"], price["input"]) + completion * price["output"]) / 1_000_000
    return F.when(provider == "mineru", pages * F.lit(per_page).cast("double")).otherwise(tokens)


def listed_prices(rows: DataFrame, text: str) -> DataFrame:
    """(name, input, output, cached_input) a million tokens, out of JSON {data: [{id, pricing}]} with prices a token.

    Variants (ids with a colon) and models without both prices go; of models of one last name the first stays.
    """
    schema = "data array<struct<id: string, pricing: struct<prompt: string, completion: string, input_cache_read: string>>>"
    each = rows.select(F.posexplode(F.from_json(text, schema)["data"]).alias("pos", "m")).where(~F.contains(F.coalesce("m.id", F.lit("")), F.lit(":")))
    million = lambda c: F.round(F.col(f"m.pricing.{c}").try_cast("double") * 1e6, 6)
    named = each.select("pos", F.lower(F.element_at(F.split("m.id", "/"), -1)).alias("name"), million("prompt").alias("input"), million("completion").alias("output"), F.nullif(million("input_cache_read"), F.lit(0.0)).alias("cached_input")).where("input IS NOT NULL AND output IS NOT NULL")
    return named.groupBy("name").agg(F.min_by(F.struct("input", "output", "cached_input"), "pos").alias("p")).select("name", "p.*")


def table_prices(cells: DataFrame, doc: str) -> DataFrame:
    """(doc, name, max_input, input, output) out of price tables' rows (doc, table_no, row_no, cells), spans filled.

    A table counts if its first row names a model, an input and an output price; a bound such as ``32K`` in a cell named
    for the input's length is a tier's limit.  Of rows for one model and limit the first stays.
    """
    order = Window.partitionBy(doc, "table_no").orderBy("row_no")
    rows = cells.withColumn("head", F.first("cells").over(order)).where("row_no > 1")
    place = lambda pattern: F.array_position(F.transform("head", lambda h: F.lower(h).rlike(pattern)), True).cast("int")
    at = rows.select(doc, "table_no", "row_no", "cells", place("模型|model").alias("m"), place("输入.*价|input.*price|^in$|输入单价").alias("i"), place("输出.*价|output.*price|^out$|输出单价").alias("o"), place("长度|tokens|范围|range").alias("b"))
    at = at.where("m > 0 AND i > 0 AND o > 0")
    cell = lambda c: F.try_element_at("cells", F.col(c))
    number = lambda c: F.regexp_extract(cell(c), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    bound = F.when(F.col("b") > 0, F.regexp_extract(cell("b"), r"(\d+)\s*[kK]\D*$", 1).try_cast("int") * 1000)
    out = at.select(doc, "table_no", "row_no", F.trim(cell("m")).alias("name"), bound.alias("max_input"), number("i").alias("input"), number("o").alias("output")).where("input IS NOT NULL AND output IS NOT NULL")
    first = F.row_number().over(Window.partitionBy(doc, "name", "max_input").orderBy("table_no", "row_no"))
    return out.withColumn("__r", first).where("__r = 1").select(doc, "name", "max_input", "input", "output")


# The words of two vendors' price pages.
REGIONS = ("广州", "新加坡", "上海", "北京", "南京", "成都", "重庆", "香港", "硅谷", "弗吉尼亚", "法兰克福", "东京")
BUSY, IDLE, AMOUNT = r"Busy hours:\s*\$\s*([\d.]+)", r"Idle hours:\s*\$\s*([\d.]+)", r"\$\s*([\d.]+)"
UP_TO, LENGTH_TO = r"≤\s*([\d.]+)\s*([KkMm]?)", r",\s*([\d.]+)\s*([kKmM])\s*\]"
MODEL_NAME = "^[a-z0-9][a-z0-9._-]*$"


def _tables_with_heads(cells: DataFrame, doc: str) -> DataFrame:
    """Rows after the first of each table, with that first row as ``head``, in lower case."""
    order = Window.partitionBy(doc, "table_no").orderBy("row_no")
    return cells.withColumn("head", F.first(F.transform("cells", lambda h: F.lower(h))).over(order)).where("row_no > 1")


def _scaled(cell: Column, pattern: str) -> Column:
    """A number of tokens such as 32K or 1M; null where the pattern isn't met."""
    factor = F.when(F.lower(F.regexp_extract(cell, pattern, 2)) == "k", 1_000).when(F.lower(F.regexp_extract(cell, pattern, 2)) == "m", 1_000_000).otherwise(1)
    return F.floor(F.regexp_extract(cell, pattern, 1).try_cast("double") * factor).cast("long")


def scoped_prices(cells: DataFrame, doc: str, region: str, scope: str) -> DataFrame:
    """(doc, name, max_input, mode, input, output, input_offpeak, output_offpeak) of a page whose tables stand under headings by region.

    Columns are found by each table's own header: model, input and output price, and where there are any, deployment scope
    (only rows of ``scope``), input tokens per request (``≤ 256K`` bounds a tier) and mode.  A price may differ in busy and
    idle hours.  Of rows for one model, bound and mode the first on the page stays.
    """
    rows = _tables_with_heads(cells, doc).where(F.contains(F.lower(F.coalesce("heading", F.lit(""))), F.lit(region.lower())))
    holds = lambda *words: F.array_position(F.transform("head", lambda h: F.array_contains(F.array(*[F.contains(h, F.lit(w)) for w in words]), True)), True).cast("int")
    at = rows.select(doc, "table_no", "row_no", "cells", holds("model").alias("m"), holds("deployment scope").alias("s"), holds("input price").alias("i"), holds("output price").alias("o"), holds("input tokens per request").alias("t"), F.array_position(F.transform("head", lambda h: F.trim(h)), "mode").cast("int").alias("k"))
    at = at.where((F.col("m") > 0) & (F.col("i") > 0) & (F.col("o") > 0) & (F.size("cells") >= F.greatest("m", "i", "o")))
    cell = lambda c: F.coalesce(F.try_element_at("cells", F.when(F.col(c) > 0, F.col(c))), F.lit(""))
    at = at.where((F.col("s") == 0) | (F.lower(F.trim(cell("s"))) == scope.lower()))
    found = lambda c, p: F.regexp_extract(c, p, 1).try_cast("double")
    price = lambda c: F.coalesce(found(cell(c), BUSY), found(cell(c), AMOUNT))
    off = lambda c: F.when(found(cell(c), BUSY).isNotNull(), found(cell(c), IDLE))
    said = F.lower(cell("k"))
    both = F.contains(said, F.lit("non-thinking and thinking")) | F.contains(said, F.lit("thinking and non-thinking")) | (said == "")
    mode = F.when(both, None).when(F.contains(said, F.lit("non-thinking")), "non_thinking").when(F.contains(said, F.lit("thinking")), "thinking")
    name = F.lower(F.element_at(F.split(F.trim(cell("m")), r"\s+"), 1))
    out = at.select(doc, "table_no", "row_no", name.alias("name"), _scaled(cell("t"), UP_TO).alias("max_input"), mode.alias("mode"), price("i").alias("input"), price("o").alias("output"), off("i").alias("input_offpeak"), off("o").alias("output_offpeak"))
    out = out.where(F.col("name").rlike(MODEL_NAME) & F.col("input").isNotNull() & F.col("output").isNotNull())
    first = F.row_number().over(Window.partitionBy(doc, "name", "max_input", "mode").orderBy("table_no", "row_no"))
    return out.withColumn("__r", first).where("__r = 1").drop("__r", "table_no", "row_no")


def tab_prices(pages: DataFrame, cells: DataFrame, doc: str, html: str, region: str) -> DataFrame:
    """(doc, name, max_input, input, output, cached_input and their off-peak columns) of a page whose tables are tabs by region.

    Price tables name a model and the input and output of inference; those of batches don't count.  The regions that stand as
    lines of their own after the first table's heading are the tabs, in the order of the tables under that heading.  Rows of peak
    and idle hours are one tier; a tier with idle prices only has them at all hours.
    """
    tidy = F.transform("head", lambda h: F.replace(h, F.lit(" "), F.lit("")))
    rows = _tables_with_heads(cells, doc).withColumn("head", tidy)
    holds = lambda w: F.array_position(F.transform("head", lambda h: F.contains(h, F.lit(w))), True).cast("int")
    named = F.exists("head", lambda h: F.startswith(h, F.lit("模型名称")))
    # Pages are parsed once, and joins merge: pages are far larger than the columns that they may be computed from.
    priced = cut(rows.where(named & (holds("推理输入") > 0) & (holds("推理输出") > 0) & ~F.contains(F.coalesce("heading", F.lit("")), F.lit("批量"))))
    tables = priced.select(doc, "table_no", F.coalesce("heading", F.lit("")).alias("heading")).distinct()
    first = tables.groupBy(doc).agg(F.min_by("heading", "table_no").alias("heading"))
    same = tables.join(first.hint("merge"), [doc, "heading"]).withColumn("tab", F.row_number().over(Window.partitionBy(doc).orderBy("table_no")))
    plain = F.regexp_replace(F.col(html), "<[^>]+>", "\n")
    after = F.when(F.col("heading") != "", F.substr(plain, F.greatest(F.position(F.col("heading"), plain), F.lit(1)), F.lit(2000)))
    labels = F.array_distinct(F.filter(F.transform(F.split(after, "\n"), strip), lambda w: w.isin(*REGIONS)))
    wanted = pages.select(doc, html).hint("merge").join(first, doc).select(doc, F.greatest(F.coalesce(F.array_position(labels, region), F.lit(0)), F.lit(1)).alias("tab"))
    chosen = priced.join(same.join(wanted.hint("merge"), [doc, "tab"]).select(doc, "table_no").hint("merge"), [doc, "table_no"])
    cell = lambda w: F.when(holds(w) > 0, F.try_element_at("cells", F.when(holds(w) > 0, holds(w))))
    number = lambda c: F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"([\d.]+)", 1).try_cast("double")
    hours = F.coalesce(cell("峰谷"), F.lit(""))
    kind = F.when(F.contains(hours, F.lit("空闲")), "idle").when(F.contains(hours, F.lit("高峰")), "peak")
    each = chosen.select(doc, "row_no", strip(F.element_at("cells", 1)).alias("name"), _scaled(F.coalesce(cell("条件"), F.lit("")), LENGTH_TO).alias("max_input"), kind.alias("kind"), F.struct(number(cell("推理输入")).alias("input"), number(cell("推理输出")).alias("output"), number(cell("缓存命中")).alias("cached")).alias("p"))
    each = each.where("name <> '' AND p.input IS NOT NULL AND p.output IS NOT NULL")
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("p")), F.when(F.col("kind") == k, F.col("row_no")))
    tiers = each.groupBy(doc, "name", "max_input").agg(F.coalesce(last("peak"), F.min_by("p", "row_no")).alias("p"), last("idle").alias("off"))
    off = F.when(~((F.col("off.input") == F.col("p.input")) & (F.col("off.output") == F.col("p.output"))), F.col("off"))
    return tiers.withColumn("off", off).select(doc, "name", "max_input", "p.input", "p.output", F.col("p.cached").alias("cached_input"), F.col("off.input").alias("input_offpeak"), F.col("off.output").alias("output_offpeak"), F.col("off.cached").alias("cached_input_offpeak"))
