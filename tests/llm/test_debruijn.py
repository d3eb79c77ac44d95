"""Removal of passages that earlier documents hold, against a plain reading of the contract."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from itemloom.llm import queries
from itemloom.llm.debruijn import remove_passages

SCHEMA = "doc_id long, text string, id string, uid int, runs int"


def brute(docs: list[tuple[int | None, str | None]], k: int) -> list[tuple]:
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    least: dict[tuple, int] = {}
    for (key, _), own in zip(docs, words):
        for i in range(len(own) - k + 1):
            if key is not None:
                w = tuple(own[i : i + k])
                least[w] = min(least.get(w, key), key)
    out = []
    for (key, _), own in zip(docs, words):
        gone = bytearray(len(own))
        for i in range(len(own) - k + 1):
            if key is not None and least[tuple(own[i : i + k])] < key:
                gone[i : i + k] = b"\x01" * k
        out.append((key, len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g)))
    return sorted(out, key=repr)


def check(spark, docs: list[tuple[int | None, str | None]], k: int, **more) -> None:
    table = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], SCHEMA).repartition(3)
    rows = remove_passages(table, k=k, **more).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute(docs, k)


def prose(rng: random.Random, n: int, kinds: int = 400) -> list[str]:
    return [f"w{rng.randrange(kinds)}é" if rng.random() < 0.1 else f"w{rng.randrange(kinds)}" for _ in range(n)]


@pytest.mark.parametrize("seed,k", [(0, 12), (1, 15), (2, 30)])
def test_shared_passages_copies_and_edits(spark, seed, k):
    rng = random.Random(seed)
    shared = [prose(rng, 80) for _ in range(5)]
    docs: list[tuple[int | None, str | None]] = [(1000, None), (1001, ""), (1002, "few words only"), (None, " ".join(shared[0])), (None, " ".join(shared[0]))]
    for i in range(60):
        words = prose(rng, rng.randint(5, 150))
        for _ in range(rng.randint(0, 3)):
            s, at, a = rng.choice(shared), rng.randint(0, len(words)), rng.randint(0, 50)
            words = words[:at] + s[a : a + rng.randint(5, 60)] + words[at:]
        docs.append((i * 7 % 101, rng.choice([" ", "\n", " \t "]).join(words)))
    whole = [t for _, t in docs if t][5:]
    docs += [(200, whole[3]), (201, whole[3]), (5, whole[4]), (202, whole[4] + " " + whole[4])]
    edited = whole[6].split()
    edited[len(edited) // 2] = "edited"
    docs += [(203, " ".join(edited)), (203, " ".join(edited))]
    check(spark, docs, k)
    check(spark, docs, k, hot=3)


def test_repeats_inside_one_document_stay(spark):
    rng = random.Random(5)
    line, other = " ".join(prose(rng, 40)), " ".join(prose(rng, 40))
    check(spark, [(1, f"{line} {line} {other} {line}"), (2, f"{other} {other} x {other[5:]}"), (0, f"y {line[10:]}"), (3, "a " * 300), (4, "a " * 40 + "b")], 20)


def test_a_passage_in_most_documents(spark):
    rng = random.Random(6)
    line = prose(rng, 25)
    docs: list[tuple[int | None, str | None]] = [(i, " ".join(prose(rng, 30) + line + prose(rng, 30))) for i in range(150)]
    docs += [(i, docs[0][1]) for i in range(200, 260)]
    check(spark, docs, 20)


def test_a_long_text_that_another_holds_whole(spark):
    rng = random.Random(7)
    long = prose(rng, 30_000, 5_000)
    rows = remove_passages(spark.createDataFrame([(2, " ".join(long)), (1, " ".join(["x", *long, "y"]))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_removed, r.kept) for r in rows] == [(0, " ".join(["x", *long, "y"])), (30_000, "")]
    assert [tuple(s) for s in rows[1].spans] == [(0, 30_000)]


def test_an_empty_table(spark):
    assert remove_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_query_over_whole_texts(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted((tuple(r) for r in queries.op12_passage_dedup(spark, folder).collect()), key=repr)
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(docs, 50)]
    assert rows == sorted(want, key=repr)
    assert sum(r[2] > 0 for r in rows) > 10
