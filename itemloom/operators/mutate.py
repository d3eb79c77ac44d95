"""Changes as pure functions: an old table and a change give the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(saved: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """New rows replace saved ones of the same key; ``keep`` columns of a replaced row stay."""
    old = saved.select(F.col(key), F.lit(True).alias("__old"), *[F.col(c).alias(f"__o_{c}") for c in saved.columns if c != key])
    met = old.join(new.withColumn("__new", F.lit(True)), key, "full")
    pick = lambda c: F.when(F.col("__new") & (~F.coalesce("__old", F.lit(False)) if c in keep else F.lit(True)), F.col(c)).otherwise(F.col(f"__o_{c}"))
    return met.select(key, *[pick(c).alias(c) for c in saved.columns if c != key])


def sync(target: DataFrame, source: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, action): insert, update or delete, by comparing a hash of the values."""
    digest = F.md5(F.to_json(F.struct(*values)))
    a, b = target.select(key, digest.alias("__a")), source.select(key, digest.alias("__b"))
    met = a.join(b, key, "full")
    action = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete").when(F.col("__a") != F.col("__b"), "update")
    return met.select(key, action.alias("action")).where("action IS NOT NULL")


def merge_into_previous(rows: DataFrame, group: list[str], order: str, merged: Column, text: str, score: str, coef: str) -> DataFrame:
    """Rows where ``merged`` holds join the row before; difficulty is the mean weighted by score, numbers are dense."""
    w = Window.partitionBy(*group).orderBy(order)
    rows = rows.withColumn("__m", merged).withColumn("__r", F.row_number().over(w))
    rows = rows.withColumn("no", F.sum(F.when(~F.col("__m") | (F.col("__r") == 1), 1).otherwise(0)).over(w))
    total = F.sum(score)
    mean = F.when(total > 0, F.sum(F.col(coef) * F.col(score)) / total).otherwise(F.avg(coef))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(*group, "no").agg(F.array_join(parts, "；").alias(text), total.alias(score), F.round(mean, 2).alias(coef))


# Fixed value: how a question's parts are marked.
PART = r"(?:（\d+）|\(\d+\)|[⑴-⒇])"


def marked_parts(text: Column) -> Column:
    """array: what stands before the first mark, then each marked part, trimmed; null with fewer than two marks."""
    cut = F.split(F.concat(F.lit("\n"), text), f"(?={PART})")
    parts = F.transform(cut, lambda x, i: F.when(i == 0, F.substring(x, 2, 1 << 30)).otherwise(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.when(F.size(cut) > 2, parts)


def split_questions(rows: DataFrame, group: list[str], no: str, chosen: Column, text: str, score: str, answer: str, once: list[str]) -> DataFrame:
    """Rows where ``chosen`` holds become one row for each marked part of their text, behind what stands before the marks.

    Scores are whole and equal, the last part takes the rest; answers are dealt if they have as many
    parts, else the first part keeps the answer; the ``once`` columns stay on the first part.  Later numbers of the group move on.
    Column ``part`` counts from 0 and is null for rows that stay whole, as those without two marks do;
    rows of one number are moved alike.  Null texts, answers and scores stay null.
    """
    parts = F.when(chosen, marked_parts(F.col(text)))
    cut = rows.withColumn("__parts", parts).withColumn("__n", F.when(F.col("__parts").isNull(), 1).otherwise(F.size("__parts") - 1))
    before = Window.partitionBy(*group).orderBy(no).rangeBetween(Window.unboundedPreceding, -1)
    moved = cut.withColumn("__moved", F.coalesce(F.sum(F.col("__n") - 1).over(before), F.lit(0)))
    one = moved.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    i, n, whole, first = F.col("__i"), F.col("__n"), F.col("__parts").isNull(), F.col("__i") == 0
    each, answers = F.floor(F.col(score) / n), marked_parts(F.col(answer))
    dealt = F.when(F.size(answers) == n + 1, F.element_at(answers, i + 2)).when(first, F.col(answer))
    kind = {c: rows.schema[c].dataType for c in (no, score)}
    new = {
        text: F.when(whole, F.col(text)).otherwise(F.concat(F.element_at("__parts", F.lit(1)), F.element_at("__parts", i + 2))),
        score: F.when(whole, F.col(score)).otherwise(F.when(i == n - 1, F.col(score) - each * (n - 1)).otherwise(each)).cast(kind[score]),
        answer: F.when(whole, F.col(answer)).otherwise(dealt),
        no: (F.col(no) + F.col("__moved") + i).cast(kind[no]),
    } | {c: F.when(whole | first, F.col(c)) for c in once}
    return one.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns], F.when(~whole, i).alias("part"))


def needs_embedding(rows: DataFrame, model: str, vector: str = "embedding", model_col: str = "embedding_model") -> DataFrame:
    return rows.where(F.col(vector).isNull() | ~F.col(model_col).eqNullSafe(F.lit(model)))


def apply_embeddings(rows: DataFrame, computed: DataFrame, key: str, text: str, model: str, vector: str = "embedding", model_col: str = "embedding_model") -> DataFrame:
    """Vectors computed for texts that haven't changed meanwhile; ``computed`` has key, text and vector."""
    fresh = computed.select(key, F.col(text).alias("__t"), F.col(vector).alias("__v"))
    met = rows.join(fresh, key, "left")
    ok = F.col("__v").isNotNull() & F.col(text).eqNullSafe(F.col("__t"))
    return met.withColumn(vector, F.when(ok, F.col("__v")).otherwise(F.col(vector))).withColumn(model_col, F.when(ok, F.lit(model)).otherwise(F.col(model_col))).drop("__t", "__v")


def merge_points(points: Column) -> Column:
    """Array of structs with an id: the first place of each id, with the last values given for it."""
    ids = F.array_distinct(F.transform(points, lambda p: p["id"]))
    return F.transform(ids, lambda i: F.element_at(F.filter(points, lambda p: p["id"] == i), -1))
