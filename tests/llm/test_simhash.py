"""SimHash fingerprints, trie links, components and near-duplicate removal against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from itemloom.llm.queries import op9_simhash
from itemloom.llm.simhash import drop_near_duplicates, hex_fingerprint, near_classes, near_roots, trie_forest
from itemloom.llm.workspace import Workspace


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids: list[int], fps: list[int]) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in docs]
    want = classes([r.doc_id for r in docs], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, folder).collect()}
    assert got == {r.doc_id: (f"{f:016x}", want[r.doc_id]) for r, f in zip(docs, fps)}


def test_odd_texts(spark):
    texts = [None, "", " \t\n", "One", "one TWO", "one two three", "ONE two\x0bthree", "É é \x1f a b", "x " * 5000]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component int")
    rows = near_classes(docs).select("doc_id", hex_fingerprint("fp").alias("f")).collect()
    assert {r.doc_id: r.f for r in rows} == {i: f"{fingerprint(t):016x}" for i, t in enumerate(texts)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_classes(docs).count() == 0
    assert drop_near_duplicates(docs).count() == 0


def test_trie_forest_loses_no_component():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 5)), replace=False))) for b in base for _ in range(8)]
    f = np.unique(np.array([*base, *near], np.uint64))
    links = trie_forest(f, 3)
    assert all((int(f[i]) ^ int(f[j])).bit_count() <= 3 for i, j in links)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    want = classes(list(range(len(f))), [int(x) for x in f])
    assert [find(i) for i in range(len(f))] == [want[i] for i in range(len(f))]


def test_one_of_each_group_stays(spark):
    rng = random.Random(2)
    words = [["w%d" % rng.randrange(4000) for _ in range(300)] for _ in range(12)]
    rows = []
    for k, w in enumerate(words):
        rows.append((10 * k + 5, " ".join(w)))
        rows.append((10 * k + 6, " ".join(w)))  # exact copy
        edited = list(w)
        edited[150] = "other"  # 5 of about 300 shingles
        rows.append((10 * k + 3, " ".join(edited)))
    rows += [(500, None), (501, ""), (5, " ".join(words[0]))]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, uid string, node int")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10 * k + 3 for k in range(12)] + [500]


def test_different_texts_stay(spark):
    rng = random.Random(3)
    shared = ["s%d" % rng.randrange(900) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(shared + ["w%d" % rng.randrange(4000) for _ in range(120)])) for i in range(30)], "doc_id long, text string")
    assert drop_near_duplicates(docs).count() == 30


def shingles(text: str) -> set[tuple[str, ...]]:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edits(rng: random.Random) -> dict[str, tuple[str, str]]:
    """Pairs of similarity just over 0.8: text appended, a block replaced, single words changed."""

    def fresh(n):
        return ["w%d" % rng.randrange(5000) for _ in range(n)]

    w = fresh(rng.randrange(150, 600))
    n, at = len(w), len(w) // 3
    block, single = int((n - 4) * 0.11) - 4, int((n - 4) * 0.022)
    scattered = list(w)
    for i in range(single):
        scattered[10 + i * (n - 20) // single] = "other"
    out = {"appended": w + fresh(int((n - 4) * 0.245)), "block": w[:at] + fresh(block) + w[at + block :], "scattered": scattered}
    return {kind: tuple(" ".join([kind + x for x in part]) for part in (w, e)) for kind, e in out.items()}


def test_recall_is_the_same_for_every_kind_of_edit(spark):
    rng = random.Random(5)
    pairs = [pair for _ in range(120) for pair in edits(rng).values()]
    assert all(0.8 <= similarity(*pair) < 0.87 for pair in pairs)
    docs = spark.createDataFrame([(10 * k + i, t) for k, pair in enumerate(pairs) for i, t in enumerate(pair)], "doc_id long, text string").repartition(8)
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [10 * k for k in range(len(pairs))]


def test_similarity_is_exact(spark):
    """A hundred shingles: 12 appended words leave 100/112, 25 leave exactly 0.8, 26 leave 100/126."""
    words = ["w%d" % i for i in range(200)]
    for more, stay in ((12, 1), (25, 1), (26, 2)):
        docs = spark.createDataFrame([(1, " ".join(words[:104])), (2, " ".join(words[: 104 + more]))], "doc_id long, text string")
        assert drop_near_duplicates(docs, bands=64, per_band=2).count() == stay


def test_members_unlike_the_first_are_compared_with_each_other(spark):
    """40 sets in two keys, 8 kinds of 5 alike: whichever node comes first, most are unlike it."""
    kinds = {node: node % 8 for node in range(1, 41)}
    sets = spark.createDataFrame([(n, [100 * k + i for i in range(20)] + [-n]) for n, k in kinds.items()], "node long, set array<long>")
    leaves = spark.createDataFrame([(n % 8 // 4, n, 21) for n in kinds], "key long, node long, size long")
    for most in (0, 2, 16):  # stars alone, stars and then all pairs, all pairs
        roots = {r.node: r.root for r in near_roots(leaves, sets, 0.8, Workspace(spark), most=most).collect()}
        assert roots == {n: min(m for m in kinds if kinds[m] == k) for n, k in kinds.items()}


def test_unlike_texts_of_one_key_take_few_rounds(spark):
    """A common passage puts 60 unlike sets into one key, two of them alike: rounds of stars link nothing, so that all pairs follow at once."""
    names = []

    class Recorded(Workspace):
        def save(self, df, name):
            names.append(name)
            return super().save(df, name)

    sets = spark.createDataFrame([(n, [1000 * max(n, 2) + i for i in range(20)]) for n in range(1, 61)], "node long, set array<long>")
    leaves = spark.createDataFrame([(k, n, 20) for n in range(1, 61) for k in (1, 2)], "key long, node long, size long")
    roots = {r.node: r.root for r in near_roots(leaves, sets, 0.8, Recorded(spark), most=0).collect()}
    assert roots == {1: 1, 2: 1}
    assert sum(n.startswith("close-") for n in names) <= 3


def test_same_words_in_another_order(spark):
    """Forty texts of one set of words; each has one near copy, and nothing else is alike."""
    rng = random.Random(6)
    words, rows = ["w%d" % i for i in range(200)], []
    for k in range(40):
        rng.shuffle(words)
        swapped = list(words)
        swapped[90], swapped[91] = swapped[91], swapped[90]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(swapped))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [10 * k for k in range(40)]


def test_hex(spark):
    row = spark.range(1).select(hex_fingerprint(F.lit(-1).cast("long")).alias("a"), hex_fingerprint(F.lit(10).cast("long")).alias("b")).first()
    assert (row.a, row.b) == ("f" * 16, "0" * 15 + "a")


def test_texts_whose_fingerprints_link_are_near_duplicates(spark):
    """A few words changed: fingerprints within 3 bits, though the sets of 5-word shingles are less than 0.8 alike."""
    rng = random.Random(8)
    words = ["w%d" % rng.randrange(5000) for _ in range(120)]
    base = " ".join(words)
    f, rows = fingerprint(base), []
    for _ in range(400):
        edited = [w + "x" if rng.random() < 0.045 else w for w in words]
        text = " ".join(edited)
        if 0 < (fingerprint(text) ^ f).bit_count() <= 3 and similarity(base, text) < 0.8:
            rows.append(text)
    assert rows
    docs = spark.createDataFrame([(1, base), (2, rows[0]), (3, "quite another text")], "doc_id long, text string")
    assert {r.component for r in near_classes(docs).collect()} == {1, 3}
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [1, 3]
