"""The life of a question in the bank: commit, new classification, review, removal; and who sees what.

Each change is a function from the tables as they are to the tables as they will be.  ``bank`` has id, job, draft,
meta (a struct with subject), owner, reviewed_at, reviewed_by and the content columns; ``drafts`` draft, job, status
and the same content; ``jobs`` job, meta and scope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.functions.text import stable_id


def _without_review(changed: Column) -> dict[str, Column]:
    return {c: F.when(changed, None).otherwise(F.col(c)) for c in ("reviewed_at", "reviewed_by")}


def sync_meta(bank: DataFrame, jobs: DataFrame) -> DataFrame:
    """The bank with its jobs' latest classification; a question whose subject changes loses its review.  Jobs that aren't given stay as they are."""
    met = bank.join(jobs.select("job", F.col("meta").alias("__meta"), F.lit(True).alias("__met")), "job", "left")
    known = F.col("__met").isNotNull()
    moved = known & ~F.col("meta.subject").eqNullSafe(F.col("__meta.subject"))
    return met.withColumns(_without_review(moved) | {"meta": F.when(known, F.col("__meta")).otherwise(F.col("meta"))}).select(*bank.columns)


def commit(bank: DataFrame, drafts: DataFrame, jobs: DataFrame, wanted: DataFrame, content: list[str], duplicates: DataFrame | None = None, same_papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bank, drafts, outcome) after the ``wanted`` drafts (draft, owner, force) have been saved.

    Unless forced, nothing of a paper that the bank has already (``same_papers``: job) is saved, and drafts that other
    papers' questions repeat (``duplicates``: draft) are skipped.  A draft that was saved before is replaced: it keeps its id and
    owner and loses its review.  The jobs' other questions get their latest classification.  ``outcome`` has
    draft and action: saved, skipped or same paper.
    """
    asked = drafts.join(wanted.select("draft", F.col("owner").alias("__owner"), "force"), "draft")
    flag = lambda df, key, name: df.select(key, F.lit(True).alias(name)).distinct()
    if same_papers is not None:
        asked = asked.join(flag(same_papers, "job", "__p"), "job", "left")
    if duplicates is not None:
        asked = asked.join(flag(duplicates, "draft", "__d"), "draft", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in asked.columns else F.lit(False)
    action = F.when(~F.col("force") & has("__p"), "same paper").when(~F.col("force") & has("__d"), "skipped").otherwise("saved")
    asked = asked.withColumn("action", action)
    saved = asked.where("action = 'saved'").join(jobs.select("job", F.col("meta").alias("__meta")), "job", "left")
    new = saved.select("draft", F.col("job").alias("__job"), "__owner", "__meta", F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in content])
    met = bank.withColumn("__old", F.lit(True)).join(new, "draft", "full")
    fresh = F.coalesce("__new", F.lit(False))
    values = {c: F.when(fresh, F.col(f"__n_{c}")).otherwise(F.col(c)) for c in content}
    values |= {"id": F.coalesce("id", F.concat(F.lit("k"), stable_id(F.col("draft").cast("string"), size=20))), "job": F.coalesce("job", "__job"), "owner": F.when(fresh, F.coalesce("owner", "__owner")).otherwise(F.col("owner"))}
    values |= {"meta": F.when(fresh, F.col("__meta")).otherwise(F.col("meta"))} | _without_review(fresh)
    after = met.withColumns(values).select(*bank.columns)
    touched = jobs.join(asked.where("action <> 'same paper'").select("job").distinct(), "job", "left_semi")
    status = drafts.join(saved.select("draft", F.lit(True).alias("__s")).distinct(), "draft", "left").withColumn("status", F.when(F.col("__s"), "saved").otherwise(F.col("status"))).select(*drafts.columns)
    return sync_meta(after, touched), status, asked.select("draft", "action")


def remove_papers(bank: DataFrame, drafts: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bank, drafts) without the papers' questions (``papers``: job); their drafts can be saved again."""
    gone = papers.select("job").distinct()
    back = drafts.join(gone.withColumn("__g", F.lit(True)), "job", "left").withColumn("status", F.when(F.col("__g") & (F.col("status") == "saved"), "draft").otherwise(F.col("status")))
    return bank.join(gone, "job", "left_anti"), back.select(*drafts.columns)


def review(bank: DataFrame, change: DataFrame) -> DataFrame:
    """The bank after an assignment or review (``change``: id, to, approved, actor, at): a new owner, and the review set or taken back."""
    met = bank.join(change.select("id", F.col("to").alias("__to"), F.col("approved").alias("__ok"), F.col("actor").alias("__by"), F.col("at").alias("__at")), "id", "left")
    hit = F.col("__to").isNotNull()
    put = lambda new, old: F.when(hit, new).otherwise(F.col(old))
    return met.withColumns({"owner": put(F.col("__to"), "owner"), "reviewed_by": put(F.when(F.col("__ok"), F.col("__by")), "reviewed_by"), "reviewed_at": put(F.when(F.col("__ok"), F.col("__at")), "reviewed_at")}).select(*bank.columns)


def refused_reviews(bank: DataFrame, change: DataFrame, users: DataFrame) -> DataFrame:
    """(id, reason) of what a review may not do; it goes ahead only if there is nothing.

    ``users`` has user, role, active and subjects.  The recipient must be active, a leader assigns to members only,
    the question must exist, and both must have its subject; administrators have all.
    """
    who = lambda name: users.select(*[F.col(c).alias(f"{name}_{c}") for c in ("user", "role", "active", "subjects")])
    a, r = who("a"), who("r")
    met = change.join(a, change["actor"] == a["a_user"], "left").join(r, change["to"] == r["r_user"], "left").join(bank.select("id", F.coalesce("meta.subject", F.lit("")).alias("subject"), F.lit(True).alias("__q")), "id", "left")
    may = lambda name: F.coalesce((F.col(f"{name}_role") == "admin") | F.array_contains(f"{name}_subjects", F.col("subject")), F.lit(False))
    reason = F.when(~F.coalesce("r_active", F.lit(False)), "recipient").when((F.col("a_role") == "leader") & (F.col("r_role") != "member"), "members only").when(F.col("__q").isNull(), "unknown").when(~may("a") | ~may("r"), "subject")
    return met.select("id", reason.alias("reason")).where("reason IS NOT NULL")


@dataclass(frozen=True)
class Views:
    """What one user sees of each table."""

    bank: DataFrame
    jobs: DataFrame
    drafts: DataFrame
    trees: DataFrame


def scoped_views(bank: DataFrame, jobs: DataFrame, drafts: DataFrame, trees: DataFrame, role: str, user: int | str | None = None, subjects: list[str] | None = None) -> Views:
    """All tables under one policy, carried over their relations: administrators see all, leaders their subjects, members what is theirs.

    A leader's jobs count by their own subject, or else by their scope, drafts by their job.  A member has reviewed questions
    of their own in their subjects, and jobs, drafts and trees only as far as these lead.  ``trees`` has subject.
    """
    if role == "admin":
        return Views(bank, jobs, drafts, trees)
    mine = F.col("meta.subject").isin(subjects or [])
    if role == "leader":
        own = jobs.where(F.coalesce(F.nullif("meta.subject", F.lit("")), F.col("scope")).isin(subjects or []))
        return Views(bank.where(mine), own, drafts.join(own.select("job"), "job", "left_semi"), trees.where(F.col("subject").isin(subjects or [])))
    if role == "member":
        seen = bank.where((F.col("owner") == user) & F.col("reviewed_at").isNotNull() & mine)
        return Views(seen, jobs.join(seen.select("job"), "job", "left_semi"), drafts.join(seen.select("draft"), "draft", "left_semi"), trees.join(seen.select(F.col("meta.subject").alias("subject")), "subject", "left_semi"))
    raise ValueError(f"unknown role {role!r}")
