"""License scans and quality rules against brute-force readings of their contracts."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from itemloom.llm.licenses import PHRASES, Automaton, scan
from itemloom.llm.quality import Rules, measure
from itemloom.llm.queries import op4_license_scan, op5_quality_rules

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "cc by", "CC BY-SA cc by cc by", "General Public License all rights reserved", "naïve cc by cc by", "a\nb\n\na\n a\nb", "###", "é" * 60, "one two three " * 40]


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def base_scan(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base_quality(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_words string")


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_license_base_columns(spark):
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    for rows, own in ((op4_license_scan(spark, FOLDER), texts(spark)), (scan(odd(spark), ["doc_id"]), dict(enumerate(ODD)))):
        got = {r.doc_id: tuple(r[c] for c in columns) for r in rows.collect()}
        assert got == {k: base_scan(t) for k, t in own.items()}


def test_license_labels_hold_base_ones(spark):
    for r in op4_license_scan(spark, FOLDER).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("This project is licensed under the Apache License, Version 2.0 (the License)", "apache-2.0"),
        ("released under the MIT license", "mit"),
        ("Licensed under the GNU General Public License version 3", "gpl-3.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and files to deal in the Software without restriction", "mit-grant"),
        ("Copyright (c) 2020 Some Body. All rights reserved", "copyright"),
        ("licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ],
)
def test_templates_accept(spark, text, label):
    row = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert label in row.labels.split(",") and row.score == 1.0


def test_mandatory_words_must_match():
    a = Automaton("a [[b]] {1-2} c")
    assert a.accepts([b"a", b"b", b"x", b"c"]) and a.accepts([b"a", b"x", b"y", b"c"])
    assert not a.accepts([b"a", b"c"]) and not a.accepts([b"a", b"x", b"y", b"z", b"d"])
    with pytest.raises(ValueError, match="closed"):
        Automaton("a [[b")


def test_quality_base_columns(spark):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for rows, own in ((op5_quality_rules(spark, FOLDER), texts(spark)), (measure(odd(spark), ["doc_id"]), dict(enumerate(ODD)))):
        got = {r.doc_id: tuple(r[c] for c in columns) for r in rows.collect()}
        assert got == {k: base_quality(t) for k, t in own.items()}


def test_failed_texts_are_not_kept(spark):
    assert not any(r.kept for r in measure(odd(spark), ["doc_id"]).collect() if r.base_failed)


def test_coverage_counts_characters(spark):
    text = " ".join(f"w{i}" for i in range(100)) + " one two three four five" * 2
    row = measure(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], rules=Rules()).first()
    assert row.share_5 == pytest.approx(2 * 19 / row.word_chars)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan(docs, ["doc_id"]).count() == 0 and measure(docs, ["doc_id"]).count() == 0
