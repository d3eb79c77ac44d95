"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blend of lexical and semantic similarity, difficulty and price conventions.
SEMANTIC_LOW, SEMANTIC_HIGH, SEMANTIC_WEIGHT = 0.6, 0.95, 0.5
AI_WEIGHT = 0.7
BEIJING = "+08:00"


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def clamp_or(c: Column, low: float, high: float, default: float) -> Column:
    """A number within bounds out of text; what isn't one gives the default."""
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), float(default)).otherwise(clamp(n, low, high))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def usable_vector(v: Column) -> Column:
    """All components finite and not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def calibrate(cos: Column) -> Column:
    return clamp((cos - SEMANTIC_LOW) / (SEMANTIC_HIGH - SEMANTIC_LOW), 0, 1)


def combine(lexical: Column, cos: Column) -> Column:
    """Blend of both similarities, or the lexical one where there is no vector."""
    return F.when(cos.isNull(), lexical).otherwise((1 - SEMANTIC_WEIGHT) * lexical + SEMANTIC_WEIGHT * calibrate(cos))


def difficulty(ai: Column, baseline: Column, slope: float = 1.0, intercept: float = 0.0) -> Column:
    raw = F.coalesce(AI_WEIGHT * ai + (1 - AI_WEIGHT) * baseline, baseline)
    return F.round(clamp(slope * raw + intercept, 0.02, 0.98), 2)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of packed longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sign_bits(v: Column) -> Column:
    """A vector's signs packed into longs, 32 to each."""
    words = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / 32), F.lit(0)).cast("int"))
    word = lambda w: F.aggregate(F.transform(F.slice(v, w * 32 + 1, F.lit(32)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.transform(words, word)


def is_peak(at: Column, ranges: Column, weekdays_only: Column) -> Column:
    """Whether a UTC time falls into hour ranges of UTC+8; without ranges all time is peak."""
    local = F.from_utc_timestamp(at, BEIJING)
    hour = F.hour(local) + F.minute(local) / 60
    inside = F.exists(ranges, lambda r: (r[0] <= hour) & (hour < r[1]))
    return F.when(ranges.isNull(), True).when(F.coalesce(weekdays_only, F.lit(False)) & (F.weekday(local) >= 5), False).otherwise(inside)


def pick_tier(tiers: Column, prompt_tokens: Column, thinking: Column) -> Column:
    """The price tier of a call: by mode, then the smallest bound that holds, the unbounded, the largest bound."""
    mode = F.when(thinking, "thinking").otherwise("non_thinking")
    exact = F.filter(tiers, lambda t: t["mode"].eqNullSafe(mode))
    plain = F.filter(tiers, lambda t: t["mode"].isNull())
    pool = F.when(F.size(exact) > 0, exact).when(F.size(plain) > 0, plain).otherwise(tiers)
    keyed = lambda keep: F.filter(pool, keep)
    fitting = keyed(lambda t: t["max_input"] >= prompt_tokens)
    bounded = keyed(lambda t: t["max_input"].isNotNull())
    free = keyed(lambda t: t["max_input"].isNull())
    by_bound = lambda a: F.array_sort(a, lambda x, y: (x["max_input"] - y["max_input"]).cast("int"))
    return F.when(F.size(fitting) > 0, F.try_element_at(by_bound(fitting), F.lit(1))).when(F.size(free) > 0, F.try_element_at(free, F.lit(1))).otherwise(F.try_element_at(by_bound(bounded), F.lit(-1)))


def call_cost(tier: Column, peak: Column, prompt: Column, completion: Column, cached: Column, cache_ratio: Column) -> Column:
    """Cost of a call in millionths of the tier's prices; null without a tier."""
    at = lambda full, off: F.when(peak | tier[off].isNull(), tier[full]).otherwise(tier[off])
    inp, out = at("input", "input_offpeak"), at("output", "output_offpeak")
    hit = F.least(cached, prompt)
    hit_price = F.coalesce(at("cached_input", "cached_input_offpeak"), inp * F.coalesce(cache_ratio, F.lit(1.0)))
    return F.round(((prompt - hit) * inp + hit * hit_price + completion * out) / 1_000_000, 8)
