"""Packing as an exact round trip, mixing against its least-squares optimum, search against brute force."""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from itemloom.llm.ivfpq import IvfPq, search
from itemloom.llm.mixing import Mixing, _rates, label_domain, mix, resample
from itemloom.llm.packing import Encoder, Packing, best_cuts, pack
from itemloom.llm.queries import op3_packing, op7_mixing, op8_nearest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def holds(rows, texts: dict, tokenizer, window: int = 2048) -> float:
    """Every id in one piece, sequences gapless; returns the share of padding."""
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for k, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[k])) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[k][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[k])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    total = sum(map(len, ids.values()))
    return 1 - total / (len(sequences) * window)


def test_packing_round_trip(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    holds(op3_packing(spark, FOLDER).collect(), texts, tokenizer)


def test_packing_of_odd_texts(spark, tokenizer):
    odd = [None, "", " \n", "Hello,world!!", "<|endoftext|> x <|startoftext|>", "don't can't", "naïve café ÀÉ", "日本語 テキスト", "é İstanbul ﬁ", "a1b2 3.14 $5", "x" * 9000, "word " * 6000, "\x00\x1f  a", "I'll we've", "..", "a.!?b", "ß SS ǅ"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(odd)], "doc_id long, text string, offset int").coalesce(2)
    holds(pack(docs).collect(), dict(enumerate(odd)), tokenizer)
    assert pack(docs.limit(0)).count() == 0


def test_padding_is_little(spark, tokenizer):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)
    assert holds(pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer) < 0.02


def test_best_cuts_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(50):
        places = np.concatenate(([0], np.cumsum(rng.integers(1, 6, 9))))
        penalty = rng.integers(0, 4, 10).astype(float)
        cost = lambda cuts: sum(10 - (b - a) for a, b in zip(cuts, cuts[1:])) + sum(penalty[np.searchsorted(places, c)] for c in cuts[1:])  # noqa: E731, B023
        every = [[0, *mid, int(places[-1])] for n in range(9) for mid in itertools.combinations(places[1:-1].tolist(), n)]
        least = min(cost(c) for c in every if all(b - a <= 10 for a, b in zip(c, c[1:])))
        assert cost(best_cuts(places, penalty, 10)) == pytest.approx(least)


def corpus(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(("good" if i % 3 else "poor") + str(k) for k in rng.integers(0, 40, 60))) for i in range(600)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_rates_meet_targets(spark):
    docs, labels = corpus(spark)
    rows = mix(docs, labels, label_domain(), {"good": 0.5, "poor": 0.5}, p=Mixing(max_rate=8.0, ridge=0.01)).collect()
    mass = defaultdict(float)
    for r in rows:
        mass[r.domain] += r.rate * r.n_tokens
    total = sum(r.n_tokens for r in rows)
    assert len(rows) == 600 and all(0 <= r.rate <= 8 for r in rows)
    assert mass["good"] / total == pytest.approx(0.5, abs=0.05) and mass["poor"] / total == pytest.approx(0.5, abs=0.05)


def test_rates_are_a_fixed_point():
    """The distributed steps end where a plain solver's projected gradient vanishes."""
    rng = np.random.default_rng(2)
    post, tokens, p = rng.dirichlet([0.3, 0.3], 400), rng.integers(1, 50, 400), Mixing(max_rate=3.0, ridge=0.05)
    share = (tokens @ post) / tokens.sum()
    target, gaps = np.array([0.7, 0.3]), []
    r = np.ones(400)
    for _ in range(600):
        gaps.append(((r * tokens) @ post / tokens.sum() - target) / share)
        r = _rates(post, gaps, p)
    gradient = post @ (((r * tokens) @ post / tokens.sum() - target) / share) + p.ridge * (r - 1)
    inside = (r > 1e-9) & (r < p.max_rate - 1e-9)
    assert np.abs(gradient[inside]).max() < 1e-3
    assert (gradient[r <= 1e-9] >= -1e-3).all() and (gradient[r >= p.max_rate - 1e-9] <= 1e-3).all()


def test_production_targets_are_met(spark):
    """Expected token totals of the whole table, from each document's own posterior, and labelled documents' tokens."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = op7_mixing(spark, folder).join(labels.withColumn("true", label_domain()), "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(0 <= r.rate <= 8 and r.met for r in rows)
    total = sum(r.n_tokens for r in rows)
    want = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
    assert all(rows[0].reached[d] == pytest.approx(w, rel=0.01) for d, w in want.items())
    known = {d: sum(r.n_tokens for r in rows if r.true == d) for d in want}
    mass = {d: sum(r.rate * r.n_tokens for r in rows if r.true == d) for d in want}
    kept = sum(mass.values())
    assert total > 0 and mass["toxic"] / kept < 0.02 and mass["toxic"] < 0.15 * known["toxic"]
    assert mass["good"] / kept == pytest.approx(0.90, abs=0.03)


def test_rates_without_a_budget_stay_at_one(spark):
    """Good text is kept whole; poor text goes down to its share of what is kept."""
    docs, labels = corpus(spark)
    rows = mix(docs, labels, label_domain(), {"good": 0.9, "poor": 0.1}, budget=None).collect()
    mass = defaultdict(float)
    for r in rows:
        mass[r.domain] += r.rate * r.n_tokens
    assert all(r.rate > 0.95 for r in rows if r.domain == "good" and r.posterior > 0.97)
    assert mass["poor"] / sum(mass.values()) == pytest.approx(0.1, abs=0.02)


def test_bins_add_up_and_targets_out_of_reach_are_told(spark):
    docs, labels = corpus(spark)
    rows = mix(docs, labels, label_domain(), {"good": 0.01, "poor": 0.99}, p=Mixing(max_rate=1.0)).collect()
    assert {r.met for r in rows} == {False}
    again = mix(docs, labels, label_domain(), {"good": 0.5, "poor": 0.5}, p=Mixing(max_rate=8.0)).collect()
    assert {r.met for r in again} == {True}


def test_resample_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2), (2, "b", 3, 4), (None, "c", 5, 6)], "doc_id long, text string, times int, __times int")
    rates = spark.createDataFrame([(1, 2.0), (2, 0.0), (None, 1.0)], "doc_id long, rate double")
    assert sorted((r.text, r.times, r["__times"]) for r in resample(docs, rates).collect()) == [("a", 1, 2), ("a", 1, 2), ("c", 5, 6)]


def test_mixing_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (4, "x", "a"), (4, "x", "a")], "doc_id long, text string, domain string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = mix(docs, labels, label_domain(), {"poor": 0.1}).collect()
    assert len(rows) == 5 and {r.domain for r in rows} == {"all"}
    assert mix(docs.limit(0), labels, label_domain(), {}).count() == 0
    assert sorted(r.doc_id or 0 for r in resample(docs, mix(docs, labels, label_domain(), {})).collect()) == [0, 1, 2, 4, 4]


def brute(rows, k: int = 5, every: int = 50):
    ok = {r.vec_id: np.asarray(r.embedding, float) for r in rows if r.embedding and None not in r.embedding and np.isfinite(np.asarray(r.embedding, float)).all() and any(r.embedding)}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in ids[ids % every == 0]:
        s = x @ ok[q] / (norm * np.sqrt(ok[q] @ ok[q]))
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), s[i]) for i in best]
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_nearest_recall(spark, folder):
    want = brute(spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    got = defaultdict(list)
    for r in op8_nearest(spark, folder).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for own in got.values() for a, b in zip(own, own[1:]))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(s == pytest.approx(exact[q, i], abs=1e-12) for q in got for i, s in got[q] if (q, i) in exact)


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (50, [0.0, 1.0]), (9, [1e300, 1e300]), (1, [2.0, 0.0])]
    found = search(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cell int"), F.col("vec_id") % 50 == 0, p=IvfPq(cells=4))
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 9, 50] and got[50][0] == 9
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_nearest_of_tight_clusters_is_exact(spark):
    """Three clusters that codewords can't tell apart, among rows that spread over all cells."""
    rng = np.random.default_rng(5)
    tight = rng.normal(size=(3, 32)).repeat(500, axis=0) + 1e-3 * rng.normal(size=(1500, 32))
    rows = rng.permutation(np.concatenate([tight, rng.normal(size=(4500, 32))])) * rng.uniform(0.1, 9, size=(6000, 1))
    table = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in search(table, F.col("vec_id") % 50 == 0, p=IvfPq(subspaces=4, rerank=20, sample=1000, block=700)).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        score = unit @ unit[q]
        score[q] = -2
        hits += sum(a == b for a, b in zip(np.argsort(-score)[:5], got[q]))
    assert hits == 600


def test_words_with_marks_are_asked_of_the_model_alone():
    """Runs of marks behind a word go through the whole tokenizer once, whatever the words; few pieces are kept, and no id differs."""
    p = Packing()
    encode, whole = Encoder(p.tokenizer, 8), []
    ids = lambda text: np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    inner = encode._whole
    encode._whole = lambda piece: whole.append(piece) or inner(piece)
    text = " ".join(f"{w}{m}" for w in ("one", "two", "na\u00efve", "\u00c9t\u00e9", "THREE") for m in ("%%%", ".&&&", "", "#*#")) + "\n\tone two one"
    assert encode([text, text]) == [ids(text)] * 2
    assert sorted(whole) == [b"#*#", b"%%%", b".&&&"]
    odd = ["word'! don't x's a.b it's", "<|end|> a<|b|>", "\u0130stanbul e\u0301. x\u0338 \ufb01t", "\x1c a\x1cb 12ab3 -a- ]][", ""]
    assert encode(odd) == [ids(x) for x in odd]
    assert len(encode) <= 4 and len(encode.older) <= 4
