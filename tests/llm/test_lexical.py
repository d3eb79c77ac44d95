"""Ranked search against a plain reading of the contract, and the codes of the postings."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from itemloom.llm import queries
from itemloom.llm.lexical import build_index, decode, encode, merge, ranked_search, search
from tests.compare import duck, duck_rows, spark_rows

DOCS, ITEMS = "doc_id long, text string, shard int, term string", "item_id long, text string, score int"


def terms(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    counted = [(key, Counter(terms(t))) for key, t in docs if key is not None]
    counted = [(key, c, sum(c.values())) for key, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked: dict[int, set] = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for key, c, size in counted:
            m = 100 - 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, key))
        out += [(item, k + 1, key, -s) for k, (s, key) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["The", "Of", "a1", "É", "éé", "x-y", "naïve", *"bcdefgh"]) + str(min(rng.randrange(1, 40), rng.randrange(1, 40))) for _ in range(n))


@pytest.mark.parametrize("shard,block", [(2_000_000, 256), (60, 2)])
def test_ranks_as_a_plain_reading(spark, shard, block):
    rng = random.Random(3)
    docs: list[tuple] = [(rng.randrange(10_000), prose(rng, rng.randint(1, 40))) for _ in range(150)]
    docs += [(7, None), (8, ""), (9, "-- !"), (None, "The1 Of2"), (2**60, docs[0][1]), (2**60, docs[0][1])]
    items = [(i, prose(rng, 12)) for i in range(9)] + [(20, "unknownword"), (21, None), (None, "The1"), (3, "and The1"), (3, "and The1")]
    found = ranked_search(spark.createDataFrame([(*d, 1, "clash") for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, 2) for i in items], ITEMS), top=10, shard=shard, block=block)
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, items, 10)


def test_an_index_answers_several_searches(spark):
    docs = [(i, f"word{i % 7} word{i % 3}") for i in range(50)]
    index = build_index(spark.createDataFrame([(*d, 1, "") for d in docs], DOCS)).cache()
    for text in ("word1", "word2 word5 word6"):
        found = search(index, spark.createDataFrame([(1, text, 0)], ITEMS), top=5)
        assert sorted(tuple(r) for r in found.collect()) == brute(docs, [(1, text)], 5)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 0, "")], DOCS)
    item = spark.createDataFrame([(1, "a", 0)], ITEMS)
    assert ranked_search(none, item).count() == 0
    assert ranked_search(some, spark.createDataFrame([], ITEMS)).count() == 0
    assert [tuple(r)[:3] for r in ranked_search(some, item).collect()] == [(1, 1, 1)]


def test_a_very_long_text_and_text_ids(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    docs = spark.createDataFrame([("a", long), ("b", "w17 w18"), ("c", "w17")], "doc_id string, text string")
    got = ranked_search(docs, spark.createDataFrame([(1, "w17 w18 w4999", 0)], ITEMS)).orderBy("rank").collect()
    want = brute([("a", long), ("b", "w17 w18"), ("c", "w17")], [(1, "w17 w18 w4999")], 50)
    assert [tuple(r) for r in got] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=40))
def test_codes_are_an_exact_round_trip(values):
    assert decode(encode(np.array(values, np.uint64))[0].tobytes()).tolist() == values


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(0, 6), min_size=1), max_size=7), st.integers(1, 6))
def test_merge_finds_the_best_sums(lists, top):
    sums: Counter = Counter()
    for x in lists:
        sums.update(x)
    want = sorted(((-s, d) for d, s in sums.items() if s > 0))[:top]
    got = merge([([*sorted(x)], [x[d] for d in sorted(x)], max(x.values())) for x in lists], top)
    assert got == [(-s, d) for s, d in want]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_the_queries_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    columns, rows = spark_rows(queries.QUERIES[name](spark, folder))
    assert (columns, rows) == duck_rows(duck(folder), queries.ORACLE_SQL[name])
