"""The corpus pipeline: each stage on what its predecessor kept, and what may and may not go."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def stages(spark, docs, sf_dir):
    out = {}
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = f(spark, docs, sf_dir).cache()
        docs.count()
    return out


def test_stages_narrow_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = stages(spark, docs, SF)
    assert list(out) == ["toxicity", "near_duplicates", "repeats", "mixing", "packing"]
    ids, before = docs.select("doc_id").distinct(), docs.count()
    for name in list(out)[:-1]:
        assert out[name].columns == docs.columns and out[name].dtypes == docs.dtypes
        assert out[name].join(ids, "doc_id", "left_anti").count() == 0
        assert 0 < out[name].count() <= before
        before = out[name].count()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in out["toxicity"].collect()}
    toxic = [i for i, r in truth.items() if r.toxic == 1]
    clean = [i for i, r in truth.items() if r.toxic == 0]
    assert sum(i in kept for i in toxic) <= 0.25 * len(toxic)  # with 37 toxic texts to learn from
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    mixed = {r.doc_id for r in out["mixing"].collect()}
    left = {r.doc_id for r in out["repeats"].collect()}
    good = [i for i in left if i in truth and truth[i].quality == 1]
    assert sum(i in mixed for i in good) >= 0.9 * len(good)
    pieces = defaultdict(int)
    for r in out["packing"].collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == mixed


def test_run_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns)
    want = stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)["packing"]
    assert sorted((r.doc_id, r.doc_tokens) for r in rows.where("start = 0").collect()) == sorted((r.doc_id, r.doc_tokens) for r in want.where("start = 0").collect())


def test_odd_rows_do_not_crash(spark):
    rng = random.Random(0)
    text = " ".join("w%d" % rng.randrange(500) for _ in range(200))
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, "alone here"), (4, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")
    out = stages(spark, docs, "/root/testdata/sf0.001")
    assert out["mixing"].columns == docs.columns
    assert stages(spark, docs.limit(0), "/root/testdata/sf0.001")["packing"].count() == 0


def test_a_repeat_of_51_short_words_is_cut(spark):
    rng = random.Random(1)

    def prose(n, least, most):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most))) for _ in range(n))

    passage = prose(51, 2, 5)
    assert 200 <= len(passage) < 260
    texts = [prose(80, 3, 9) + "\n" + passage + "\n" + prose(80, 3, 9) for _ in range(3)] + [prose(200, 3, 9)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert all(passage not in kept[i] and len(texts[i]) - len(kept[i]) <= len(passage) + 2 for i in range(3))
    assert kept[3] == texts[3]
