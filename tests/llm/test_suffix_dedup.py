"""Exact removal of repeated strings against a brute-force reading of the contract."""

from __future__ import annotations

import hashlib
import random

import pytest

from itemloom.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string, uid string, trigger int"


def brute(texts: list[bytes], length: int) -> list[tuple]:
    times: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            times[t[i : i + length]] = times.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\x00" + bytes(gone)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts: list[str | None], length: int, **more) -> None:
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = remove_repeats(docs, length=length, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute([(t or "").encode() for t in texts], length)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, 60) for _ in range(4)]
    texts: list[str | None] = [None, "", "short", "x" * 500, "ab" * 300]
    for _ in range(40):
        text = prose(rng, rng.randint(5, 120))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            at = rng.randint(0, len(text))
            text = text[:at] + s[a : a + rng.randint(30, 250)] + text[at:]
        texts.append(text)
    texts += [texts[7], texts[8], texts[8]]
    check(spark, texts, 64)


def test_hot_trigger_takes_the_other_path(spark):
    rng = random.Random(9)
    line = prose(rng, 30)[:90]
    texts = [prose(rng, 20) + line + prose(rng, 20) for _ in range(60)]
    check(spark, texts, 64, hot=5)


def test_strings_never_cross_texts(spark):
    check(spark, ["a" * 40 + "b" * 30, "b" * 30 + "a" * 40, "c" * 63, "c" * 63], 64)


def test_rows_that_repeat_and_null_ids(spark):
    text = prose(random.Random(1), 40)
    rows = remove_repeats(spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string"), length=64).collect()
    assert sorted(r.doc_id is None for r in rows) == [False, False, True]
    assert all(r.n_removed == r.n_bytes for r in rows)


def test_empty_table(spark):
    out = remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=64, keep=[])
    assert out.count() == 0 and "kept" in out.columns
