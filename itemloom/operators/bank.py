"""Search, scope and paging over a question bank."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions.text import normal_text, normalize

# Difficulty bands, lower bound exclusive, upper inclusive.
BANDS: dict[str, tuple[float | None, float | None]] = {"easy": (None, 0.3), "medium": (0.3, 0.6), "hard": (0.6, None)}


def band(c: Column, name: str) -> Column:
    low, high = BANDS[name]
    tests = ([c > low] if low is not None else []) + ([c <= high] if high is not None else [])
    return reduce(Column.__and__, tests)


@dataclass(frozen=True)
class BankFilter:
    """Optional conditions, all of which must hold; one that is empty says nothing."""

    equal: dict[str, str | int | None] = field(default_factory=dict)
    band: str | None = None
    band_column: str = "coef"
    any_words: tuple[str, ...] = ()
    any_columns: tuple[str, ...] = ()
    keyword: str = ""
    keyword_columns: tuple[str, ...] = ()

    def conditions(self) -> list[Column]:
        out = [F.col(k) == v for k, v in self.equal.items() if v not in (None, "")]
        if self.band:
            out.append(band(F.col(self.band_column), self.band))
        if self.any_words:
            text = F.concat_ws(" ", *map(F.col, self.any_columns))
            out.append(reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in self.any_words]))
        if word := normal_text(self.keyword):  # one of punctuation alone says nothing
            out.append(F.contains(normalize(F.concat_ws(" ", *map(F.col, self.keyword_columns))), F.lit(word)))
        return out


def search(rows: DataFrame, where: BankFilter) -> DataFrame:
    return reduce(DataFrame.where, where.conditions(), rows)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in a total order; the caller's order must end in a unique column."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must be 0 or more, limit 1 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def late_page(rows: DataFrame, key: str, order: list[Column], needed: list[str], offset: int, limit: int) -> DataFrame:
    """Pages on the narrow columns the order needs, then fetches the wide rows of that page only."""
    keys = page(rows.select(key, *[c for c in needed if c != key]), order, offset, limit).select(key)
    return rows.join(F.broadcast(keys), key)  # at most ``limit`` keys


def scoped(rows: DataFrame, role: str, user: int | None = None, subject: str | None = None, owner: str = "owner_id", reviewed: str = "reviewed", subject_of: str = "subject") -> DataFrame:
    """What a role may see: administrators all, leaders their subject, members their own reviewed rows of it."""
    if role == "admin":
        return rows
    mine = rows.where(F.col(subject_of) == subject)
    if role == "leader":
        return mine
    if role == "member":
        return mine.where((F.col(owner) == user) & F.col(reviewed))
    raise ValueError(f"unknown role {role!r}")


def unknown_ids(wanted: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Requested ids that aren't allowed; an operation on all of them goes ahead only if this is empty."""
    return wanted.join(allowed.select(key), key, "left_anti")


def not_yet_saved(drafts: DataFrame, saved: DataFrame, draft_key: str, saved_key: str) -> DataFrame:
    return drafts.join(saved, drafts[draft_key] == saved[saved_key], "left_anti")


def review_reasons(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules a row fails; empty means it needs no review."""
    return F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])))


def scoped_papers(papers: DataFrame, items: DataFrame, role: str, user: int | None, subjects: list[str], paper: str = "paper") -> DataFrame:
    """Papers that a role may see: a leader's by subject (its own, or else its scope), a member's by the items they may see.

    ``papers`` has paper, subject and scope; ``items`` paper, owner, reviewed and subject.
    """
    if role == "admin":
        return papers
    if role == "leader":
        return papers.where(F.coalesce(F.nullif("subject", F.lit("")), F.col("scope")).isin(subjects))
    if role == "member":
        own = items.where((F.col("owner") == user) & F.col("reviewed") & F.col("subject").isin(subjects))
        return papers.join(own.select(paper), paper, "left_semi")
    raise ValueError(f"unknown role {role!r}")


def auto_commit(drafts: DataFrame, paper: str, duplicates: DataFrame, same_papers: DataFrame, draft: str = "draft") -> DataFrame:
    """(paper, draft, action, reasons): what becomes of each draft once its paper has been read.

    ``drafts`` has reasons for a review (an array) and rule_only, whether nothing but rules divided the paper; ``duplicates`` has
    the drafts that the bank has already, ``same_papers`` the papers it has.  Drafts with reasons wait; of the others
    none is saved if the paper is there already, and duplicates wait.
    """
    reasons = F.concat("reasons", F.when(F.col("rule_only"), F.array(F.lit("rules only"))).otherwise(F.array().cast("array<string>")))
    met = drafts.withColumn("reasons", reasons).join(duplicates.select(draft, F.lit(True).alias("__d")), draft, "left").join(same_papers.select(paper, F.lit(True).alias("__p")), paper, "left")
    clear = F.size("reasons") == 0
    action = F.when(~clear, "review").when(F.col("__p"), "same paper").when(F.col("__d"), "duplicate").otherwise("save")
    return met.select(paper, draft, action.alias("action"), "reasons")


def reason_counts(rows: DataFrame, paper: str) -> DataFrame:
    """(paper, reason, items): how many drafts wait for each reason."""
    why = F.when(F.col("action") == "review", F.col("reasons")).when(F.col("action") == "duplicate", F.array(F.lit("duplicate")))
    return rows.select(paper, F.explode(why).alias("reason")).groupBy(paper, "reason").agg(F.count(F.lit(1)).alias("items"))


def basket(items: DataFrame, owner: str, order: str, kind: str, score: str) -> DataFrame:
    """(owner, kind, items, score, each): sections of a basket; scores in half points within 0 and 200, ``each`` if all are equal."""
    fair = F.greatest(F.lit(0.0), F.least(F.lit(200.0), F.floor(F.col(score) * 2 + 0.5) / 2))
    rows = items.select(owner, kind, order, fair.alias("s"))
    out = rows.groupBy(owner, kind).agg(F.count(F.lit(1)).alias("items"), F.sum("s").alias("score"), F.min("s").alias("a"), F.max("s").alias("b"), F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy("first", kind))
    return out.select(owner, kind, "items", "score", F.when(F.col("a") == F.col("b"), F.col("a")).alias("each"), place.alias("section"))
