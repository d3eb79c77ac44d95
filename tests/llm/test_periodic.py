"""Periodic runs against a plain reading of their definition, and the query against the contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from itemloom.llm import queries
from itemloom.llm.periodic import block_runs, periodic_runs

SCHEMA = "doc_id long, text string, row int, runs string"


def brute(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                own = words[i : i + size]
                if not any(all(own[k] == own[k + r] for k in range(size - r)) for r in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_words_with_planted_repetitions(seed):
    rng = random.Random(seed)
    for _ in range(150):
        codes = []
        for _ in range(rng.randint(1, 5)):
            n, kinds = rng.randint(0, 70), rng.randint(1, 4)
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            if n and rng.random() < 0.3:
                words[rng.randrange(n)] = rng.randrange(kinds)
            codes.append(np.array(words, np.int64))
        found = block_runs(codes)
        assert list(zip(*(x.tolist() for x in found))) == [(i, *r) for i, c in enumerate(codes) for r in brute(c.tolist())]


def test_fibonacci_words_have_no_fourth_power():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert not len(block_runs([np.array(b)])[0])


def test_a_very_long_text_and_one_word_over_and_over(spark):
    text = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = periodic_runs(spark.createDataFrame([(1, text, 0, ""), (2, "ha " * 20_000, 0, "")], SCHEMA)).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r.runs] for r in rows] == [[(0, 30_000, 700)], [(0, 20_000, 1)]]
    assert rows[0].collapsed == " ".join(f"w{i}" for i in range(700)) and rows[1].collapsed == "ha"


def test_nulls_empty_texts_and_rows_that_repeat(spark):
    texts = [(None, "a b " * 4), (1, None), (2, ""), (3, " \t\n"), (4, "x x x x x"), (5, "x x x x x x"), (5, "x x x x x x"), (2**60 + 1, "a b a b")]
    rows = periodic_runs(spark.createDataFrame([(i, t, 1, "clash") for i, t in texts], SCHEMA)).collect()
    got = sorted(((r.doc_id, r.n_words, len(r.runs), r.collapsed) for r in rows), key=lambda r: (r[0] is None, r[0]))
    assert got == [(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (4, 5, 0, "x x x x x"), (5, 6, 1, "x"), (5, 6, 1, "x"), (2**60 + 1, 2, 0, "a b a b"), (None, 8, 1, "a b")]


def test_an_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_query_over_whole_texts(spark):
    """All documents of the smallest tables, with the contract's planted repetitions."""
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    planted = 0
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 1500:  # a plain reading takes too long; longer texts are tested above
            continue
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if not runs else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert planted > 5
