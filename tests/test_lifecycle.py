"""Commit, classification, review, removal and views, by their values."""

from __future__ import annotations

import datetime

import pytest

from itemloom.operators import lifecycle

BANK = "id string, job int, draft int, meta struct<subject:string,title:string>, owner int, reviewed_at date, reviewed_by int, stem string, score double, extra string"
DRAFTS = "draft int, job int, status string, stem string, score double, no int"
JOBS = "job int, meta struct<subject:string,title:string>, scope string"
DAY = datetime.date(2024, 5, 1)


@pytest.fixture(scope="module")
def tables(spark):
    bank = spark.createDataFrame([("b1", 1, 11, ("math", "old"), 7, DAY, 1, "one", 5.0, "x"), ("b2", 1, 12, ("math", "old"), None, DAY, 1, "two", 5.0, "x"), ("b3", 2, 21, ("art", "t2"), 8, DAY, 1, "three", 2.0, "x"), ("b4", 3, 31, (None, None), 8, None, None, "four", 2.0, None)], BANK)
    drafts = spark.createDataFrame([(11, 1, "saved", "one, new", 6.0, 1), (12, 1, "saved", "two", 5.0, 2), (13, 1, "draft", "fresh", 4.0, 3), (21, 2, "saved", "three", 2.0, 1), (22, 2, "draft", "more", 3.0, 2), (31, 3, "saved", "four", 2.0, 1)], DRAFTS)
    jobs = spark.createDataFrame([(1, ("math", "new"), None), (2, ("art", "t2"), None), (3, (None, "t3"), "music")], JOBS)
    return bank, drafts, jobs


def rows(df, key="id"):
    return {r[key]: r for r in df.collect()}


def want(spark, *x):
    return spark.createDataFrame(list(x), "draft int, owner int, force boolean")


def test_commit_replaces_keeps_owners_and_resets_reviews(spark, tables):
    bank, drafts, outcome = lifecycle.commit(*tables, want(spark, (11, 9, False), (13, 9, False)), ["stem", "score"])
    got = {r.draft: r for r in bank.collect()}
    assert len(got) == 5 and bank.columns == tables[0].columns
    assert (got[11].id, got[11].stem, got[11].score, got[11].owner, got[11].reviewed_at, got[11].extra) == ("b1", "one, new", 6.0, 7, None, "x")
    assert (got[13].stem, got[13].owner, got[13].job, got[13].meta.title, got[13].reviewed_by) == ("fresh", 9, 1, "new", None) and got[13].id.startswith("k")
    # The other question of the paper has its new title, and its review, because the subject is the same.
    assert (got[12].meta.title, got[12].reviewed_at, got[12].owner) == ("new", DAY, None) and got[21].meta.title == "t2"
    assert {r.draft: r.status for r in drafts.collect()} == {11: "saved", 12: "saved", 13: "saved", 21: "saved", 22: "draft", 31: "saved"}
    assert {r.draft: r.action for r in outcome.collect()} == {11: "saved", 13: "saved"}


def test_commit_skips_duplicates_and_known_papers_unless_forced(spark, tables):
    twice, known = spark.createDataFrame([(13,)], "draft int"), spark.createDataFrame([(2,)], "job int")
    bank, drafts, outcome = lifecycle.commit(*tables, want(spark, (13, 9, False), (22, 9, False)), ["stem", "score"], twice, known)
    assert {r.draft: r.action for r in outcome.collect()} == {13: "skipped", 22: "same paper"} and bank.count() == 4
    assert rows(bank)["b1"].meta.title == "new" and {r.status for r in drafts.where("draft IN (13, 22)").collect()} == {"draft"}
    bank, _, outcome = lifecycle.commit(*tables, want(spark, (13, 9, True), (22, 9, True)), ["stem", "score"], twice, known)
    assert {r.action for r in outcome.collect()} == {"saved"} and bank.count() == 6


def test_a_new_subject_clears_the_review(spark, tables):
    jobs = spark.createDataFrame([(1, ("physics", "new"), None), (3, ("music", "t3"), None)], JOBS)
    got = rows(lifecycle.sync_meta(tables[0], jobs))
    assert (got["b1"].meta.subject, got["b1"].reviewed_at, got["b1"].reviewed_by) == ("physics", None, None)
    assert got["b3"].reviewed_at == DAY and got["b4"].meta.subject == "music"


def test_removed_papers_can_be_saved_again(spark, tables):
    bank, drafts = lifecycle.remove_papers(tables[0], tables[1], spark.createDataFrame([(1,), (1,), (99,)], "job int"))
    assert set(rows(bank)) == {"b3", "b4"} and {r.draft for r in drafts.where("status = 'draft'").collect()} == {11, 12, 13, 22}
    again, _, _ = lifecycle.commit(bank, drafts, tables[2], want(spark, (11, 9, False)), ["stem", "score"])
    assert again.count() == 3


def test_review_and_what_refuses_it(spark, tables):
    kind = "id string, to int, approved boolean, actor int, at date"
    got = rows(lifecycle.review(tables[0], spark.createDataFrame([("b1", 5, True, 2, DAY), ("b3", 6, False, 2, DAY)], kind)))
    assert (got["b1"].owner, got["b1"].reviewed_by, got["b1"].reviewed_at) == (5, 2, DAY)
    assert (got["b3"].owner, got["b3"].reviewed_by, got["b3"].reviewed_at) == (6, None, None) and got["b2"].reviewed_by == 1
    users = spark.createDataFrame([(1, "admin", True, []), (2, "leader", True, ["math"]), (5, "member", True, ["math"]), (6, "member", False, ["math"]), (7, "member", True, ["art"])], "user int, role string, active boolean, subjects array<string>")
    asked = [("b1", 5, True, 2, DAY), ("b1", 6, True, 2, DAY), ("b1", 1, True, 2, DAY), ("nowhere", 5, True, 1, DAY), ("b3", 5, True, 1, DAY), ("b3", 7, True, 1, DAY), ("b3", 7, True, 2, DAY), ("b1", 8, True, 1, DAY)]
    refused = [(r.id, r.reason) for r in lifecycle.refused_reviews(tables[0], spark.createDataFrame(asked, kind), users).collect()]
    assert sorted(refused) == sorted([("b1", "recipient"), ("b1", "members only"), ("nowhere", "unknown"), ("b3", "subject"), ("b3", "subject"), ("b1", "recipient")])


def test_views_follow_relations(spark, tables):
    trees = spark.createDataFrame([("math",), ("art",), ("music",)], "subject string")
    count = lambda v: tuple(x.count() for x in (v.bank, v.jobs, v.drafts, v.trees))
    see = lambda *who: count(lifecycle.scoped_views(*tables[:1], tables[2], tables[1], trees, *who))
    assert see("admin") == (4, 3, 6, 3)
    assert see("leader", 1, ["math", "music"]) == (2, 2, 4, 2)  # the third paper's subject is unknown, so that its scope counts
    assert see("member", 7, ["math"]) == (1, 1, 1, 1) and see("member", 8, ["math"]) == (0, 0, 0, 0) and see("member", 8, ["art", "music"]) == (1, 1, 1, 1)
    assert see("leader", 1, []) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        see("guest")


def test_empty_tables(spark, tables):
    bank, drafts, jobs = (t.limit(0) for t in tables)
    after, status, outcome = lifecycle.commit(bank, drafts, jobs, spark.createDataFrame([], "draft int, owner int, force boolean"), ["stem"])
    assert (after.count(), status.count(), outcome.count()) == (0, 0, 0)
