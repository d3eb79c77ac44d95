"""Learnt operators: held-out accuracy, probabilities that sum to one, and odd inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from itemloom.llm import lm
from itemloom.llm.langid import CrfParams, code_switched, forward_backward, identify, train, word_marginals
from itemloom.llm.lm import score as lm_score
from itemloom.llm.queries import op2_toxicity, op6_language_model, op10_language_id
from itemloom.llm.toxicity import Ftrl, fit, toxicity
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


def test_toxic_texts_score_high(spark):
    """On the largest test table; the smaller ones label 37 toxic texts to learn from."""
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op2_toxicity(spark, folder).collect()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    positive = [b for a, b in held if a]
    assert sum(positive) >= 0.8 * len(positive)


def test_toxicity_learns_from_no_held_out_row(spark):
    docs = spark.createDataFrame([(i, f"bad{i % 2} word") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 9) for i in range(40)], "doc_id long, toxic int, score int")
    none = toxicity(docs, labels, F.lit(False)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    some = {r.doc_id: r.score for r in toxicity(docs, labels, F.col("doc_id") < 30, p=Ftrl(l1=0.1)).collect()}
    assert all((s > 0.5) == bool(i % 2) for i, s in some.items())


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x", "a"), (4, "!" * 1000, "a"), (4, "!" * 1000, "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (2, 0)], "doc_id long, toxic int")
    rows = toxicity(docs, labels, F.lit(True)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity(docs.limit(0), labels, F.lit(True)).count() == 0


def test_l1_keeps_weights_at_zero():
    rng = np.random.default_rng(0)
    y = [i % 2 for i in range(400)]
    rows = [np.array([v, *rng.integers(10, 1000, 5)], "<u4").tobytes() for v in y]
    model = fit(rows, y, Ftrl(l1=3.0, bits=10))
    index, value = model.index, model.value
    assert {0, 1} <= set(index.tolist()) and len(index) < 100
    assert value[list(index).index(1)] > 0 > value[list(index).index(0)]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_language_model_base_columns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    counts: Counter = Counter()
    for i, t in docs.items():
        if crc(i) % 5 != 1:
            counts.update([*words(t), ""])
    n, v = sum(counts.values()), len(counts)
    rows = op6_language_model(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = [*words(docs[r.doc_id]), ""]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc(r.doc_id) % 5 == 1, len(own), n)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert r.score < 0


def test_language_model_beats_its_base(spark):
    rows = [r for r in op6_language_model(spark, FOLDER).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_model_sums_to_one(spark):
    """Over all tokens of the training texts the probabilities in one context leave a little for unseen ones."""
    texts = [(i, t) for i, t in enumerate(["a b a c", "a a b", "b c", "c a b a"] * 20)]
    docs = spark.createDataFrame([*texts, (900, ""), (901, "a"), (902, "b"), (903, "c"), (904, "zebra")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score(docs, F.col("doc_id") < 900, F.col("doc_id") % 8 == 0).where("doc_id >= 900").collect()}
    # Every one-word text is word, then end in that word's context; the first factor is a probability given no context.
    assert got[904] < min(got[901], got[902], got[903]) and 10 ** got[900] < 1


def test_language_model_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b", 1), (4, "a b", 1), (4, "a b", 1), (5, "w " * 3000, 1)], "doc_id long, text string, h int")
    rows = lm_score(docs, F.lit(True), F.col("doc_id") == 4).collect()
    assert len(rows) == 6 and sum(r.doc_id == 4 for r in rows) == 2
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert lm_score(docs.limit(0), F.lit(True), F.lit(False)).count() == 0
    assert lm_score(docs, F.lit(False), F.lit(False)).count() == 6


def test_languages_of_held_out_texts(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op10_language_id(spark, FOLDER).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, truth[r.doc_id][1] or ""))) for r in rows)
    held = [(truth[r.doc_id][0], r.lang_pred) for r in rows if r.held_out and truth[r.doc_id][0] and r.lang_pred != "und"]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the and of", "en"), (5, "der und die", "de"), (None, "the", None), (7, "the and " * 9000, None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in identify(docs, F.lit(True), p=CrfParams(epochs=20)).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert (rows[4].lang_pred, rows[5].lang_pred, rows[7].lang_pred) == ("en", "de", "en")
    assert {r.lang_pred for r in identify(docs, F.lit(False)).collect()} == {"und"}
    assert identify(docs.limit(0), F.lit(True)).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    from itemloom.llm.langid import Crf

    rng = np.random.default_rng(1)
    move, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    model = Crf(list("abc"), np.zeros((1, 3)), np.zeros((1, 3)), np.eye(3), np.zeros(3), move, first)
    emit, doc = rng.normal(size=(9, 3)), np.array([0] * 4 + [2] * 5)
    marginal, pairs = forward_backward(emit, doc, model)
    expected_pairs = np.zeros((3, 3))
    for chain in (np.flatnonzero(doc == d) for d in (0, 2)):
        want, total = np.zeros((len(chain), 3)), 0.0
        both = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=len(chain)):
            p = math.exp(first[path[0]] + sum(emit[i, y] for i, y in zip(chain, path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
            for a, b in zip(path, path[1:]):
                both[a, b] += p
        assert np.allclose(marginal[chain], want / total)
        expected_pairs += both / total
    assert np.allclose(pairs, expected_pairs)


def test_a_long_chain_is_one_chain():
    """Forward-backward over several segments equals the plain recursion over the whole chain."""
    from itemloom.llm.langid import Crf

    rng = np.random.default_rng(2)
    n, emit, move, first = 200, rng.normal(size=(200, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    model = Crf(list("abc"), np.zeros((1, 3)), np.zeros((1, 3)), np.eye(3), np.zeros(3), move, first)
    marginal, _ = forward_backward(emit, np.zeros(n, int), model)
    alpha, beta = [np.exp(first + emit[0])], [np.ones(3)]
    for t in range(1, n):
        a = (alpha[-1] @ np.exp(move)) * np.exp(emit[t])
        alpha.append(a / a.sum())
        b = np.exp(move) @ (np.exp(emit[n - t]) * beta[-1])
        beta.append(b / b.sum())
    both = np.array(alpha) * np.array(beta[::-1])
    assert np.allclose(marginal, both / both.sum(1, keepdims=True))


def test_words_of_code_switched_texts_are_labelled_one_by_one(spark):
    """Alternating runs of English and German words out of texts that the model hasn't seen."""
    import pandas as pd

    from itemloom.llm.textops import blocks

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang in ('en', 'de')")
    model = train(docs, F.col("doc_id") % 5 != 0)
    held = [(r.text, model.labels.index(r.lang)) for r in docs.where("doc_id % 5 = 0 and length(text) > 200").orderBy("doc_id").limit(60).collect()]
    texts = code_switched([t for t, _ in held], [k for _, k in held], CrfParams(mixed=1.0, run=12))
    right = total = 0
    for text, truth in texts:
        for block in blocks([pd.DataFrame({"text": [text]})], "text", fold=str.lower):
            _, marginal = word_marginals(block, model, CrfParams().bits)
            right, total = right + int((marginal.argmax(1) == truth).sum()), total + len(truth)
    assert total > 1000 and right >= 0.9 * total


def test_markers_count_words_that_are_never_a_blocks_most_frequent(spark):
    """A word that stands once in each block wins over those that fill one block each (F12)."""
    texts = [" ".join([f"w{i}x{j}" for j in range(200)] * 2 + ["everywhere"]) for i in range(12)]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part int")
    word = next(iter(lm.blocks(iter([pd.DataFrame({"text": ["everywhere"]})]), "text"))).words(lm.NOT_SPACE).hashes().view(np.int64)[0]
    assert word in lm.markers(rows, 1000).view(np.int64).tolist()
