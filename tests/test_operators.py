"""Operators that SQL can't express, against plain loops over small tables."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from itemloom.functions.text import normal_text, normalize
from itemloom.operators import compose as compose_module
from itemloom.operators import segment
from itemloom.operators.apportion import assign_scores
from itemloom.operators.compose import PENALTY, Blueprint, compose
from itemloom.operators.evaluate import greedy_match
from itemloom.plans import catalog
from itemloom.sources.trees import from_json

FOLDER = "/root/testdata/sf0.001"


def test_best_pairs_first(spark):
    rng = random.Random(3)
    rows = [(s, g, p, rng.randrange(6) / 5) for s in range(3) for g in range(12) for p in range(12) if rng.random() < 0.5]
    want, used = set(), set()
    for score, g, p, s in sorted(((x[3], x[1], x[2], x[0]) for x in rows if x[3] >= 0.5), reverse=True):
        if not {(s, "g", g), (s, "p", p)} & used:
            used |= {(s, "g", g), (s, "p", p)}
            want.add((s, g, p, score))
    got = greedy_match(spark.createDataFrame(rows, "s long, g long, p long, score double"), "s", "g", "p", "score").collect()
    assert {tuple(r) for r in got} == want
    assert greedy_match(spark.createDataFrame([], "s long, g long, p long, score double"), "s", "g", "p", "score").count() == 0


def test_matched_vectors_are_one_to_one(spark):
    rows = catalog.queries()["greedy_match"](spark, FOLDER).collect()
    assert len(rows) > 50
    for side in ("kq", "kr"):
        assert len({(r["sample"], r[side]) for r in rows}) == len(rows)


def test_matched_texts_are_one_to_one(spark):
    rows = catalog.queries()["greedy_text_match"](spark, FOLDER).collect()
    assert len(rows) > 50 and all(r.lexical >= 0.5 for r in rows)
    for side in ("gold", "pred"):
        assert len({(r["sample"], r[side]) for r in rows}) == len(rows)


def lexical(a: str, b: str) -> float:
    x, y = (Counter(t[i : i + k] for k in (2, 3) for i in range(len(t) - k + 1)) for t in map(normal_text, (a, b)))
    n = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / n if n else 0.0


def plain_choice(rows: list[tuple], p: Blueprint) -> list[int]:
    """Of (item, kind, path, coef, stem), the picks of a greedy loop over all rows."""
    under = lambda path, key: path == key or path.startswith(key + " / ")
    rows = [r for r in rows if not any(under(r[2], a) for a in p.avoid)]
    topics = {r[0]: [k for k in p.focus if under(r[2], k)] if p.focus else [r[2]] for r in rows}
    covered: Counter = Counter()
    chosen: list[tuple] = []
    for kind, want in p.counts.items():
        left, got = [r for r in rows if r[1] == kind], 0
        while left and got < want:

            def worth(r):
                gain = sum((p.focus or {}).get(t, 1) / (1 + covered[t]) for t in topics[r[0]])
                mean = (sum(c[3] for c in chosen) + r[3]) / (len(chosen) + 1)
                return bool(topics[r[0]]) or not p.focus, round(gain - PENALTY * abs(mean - p.difficulty), 12), r[0]

            best = max(left, key=worth)
            left.remove(best)
            if not any(lexical(best[4], c[4]) >= 0.85 for c in chosen):
                chosen.append(best)
                covered.update(topics[best[0]])
                got += 1
    return sorted(c[0] for c in chosen)


@pytest.mark.parametrize("focus", [{}, {"b": 2, "a / x": 1}])
def test_composed_papers_equal_a_loop_over_all_rows(spark, focus):
    """Two hundred rows of few cells, many with nearly the same stem, so that cells run out and grow."""
    rng = random.Random(8)
    stems = ["an even longer question about %s and %s" % (a, b) for a in ("cells", "stars") for b in ("light", "force", "salt")]
    rows = [(i, rng.choice("AB"), rng.choice(["a / x", "a / y", "b", "c / z"]), rng.choice([0.2, 0.5, 0.8]), rng.choice(stems) + rng.choice(["", ".", " ", "!"]) if rng.random() < 0.7 else "question number %d on %d" % (i * 7919, i * i)) for i in range(200)]
    p = Blueprint({"A": 6, "B": 5}, 0.45, focus, ("c",))
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, item long, kind string, path string, coef double, stem string")
    got = compose(df, ["g"], "item", "kind", "path", "coef", p).collect()
    assert sorted(r["item"] for r in got) == plain_choice(rows, p)


def test_missing_questions_are_remarked(spark):
    df = spark.createDataFrame([("g", 1, "A", "a", 0.5, "one"), ("g", 2, "A", "b", 0.5, "two")], "g string, item long, kind string, path string, coef double, stem string")
    got = compose(df, ["g"], "item", "kind", "path", "coef", Blueprint({"A": 3}, 0.5, {"a": 1, "z": 1})).first()
    assert got["remarks"] == ["A: 2 of 3", "A: 1 off topic", "no question on z"]


def paper(spark, lines):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "paper long, seq long, text string")


def scored(spark, lines):
    units = paper(spark, lines)
    marks = segment.segment(units)
    heads = segment.headings(units, marks)
    out = segment.infer_scores(segment.scores(segment.questions(units, marks), heads), heads, segment.paper_totals(units, marks))
    return [(r.score, r.score_source) for r in out.orderBy("question").collect()]


def test_known_layout_of_a_section(spark):
    lines = ["试卷满分：150分", "一、选择题：本题共 16 小题，每小题 4 分", *[f"{i}．题目内容{i}" for i in range(1, 17)], "二、解答题：本题共 9 小题，共 86 分", *[f"{i}．解答内容{i}" for i in range(17, 26)]]
    got = scored(spark, lines)
    assert [s for s, _ in got] == [4] * 16 + [8, 8, 8, 8, 8, 10, 10, 12, 14] and sum(s for s, _ in got) == 150


def test_papers_total_only_lowers(spark):
    low = scored(spark, ["满分 20 分", "一、解答题", "1．第一题的内容", "2．第二题的内容"])
    assert low == [(10.0, "paper_total"), (10.0, "paper_total")]
    assert scored(spark, ["满分 90 分", "一、解答题", "1．第一题的内容", "2．第二题的内容"]) == [(12.0, "default"), (12.0, "default")]


def test_heading_with_another_count_is_not_trusted(spark):
    got = scored(spark, ["一、填空题：共 5 小题，共 20 分", "1．第一题的内容", "2．第二题的内容"])
    assert got == [(5.0, "default"), (5.0, "default")]


def test_notices_continuations_and_answers(spark):
    lines = ["注意事项", "1．答题前填写姓名", "一、选择题", "本大题每题 5 分", "1．甲", "续行", "2．乙", "9．不接", "3．丙", "参考答案", "1．A"]
    roles = [(r.role, r.question) for r in segment.segment(paper(spark, lines)).orderBy("seq").collect()]
    assert roles == [("preamble", None), ("preamble", None), ("section", None), ("section", None), ("start", 1), ("content", 1), ("start", 2), ("content", 2), ("start", 3), ("answers", None), ("answers", None)]


def test_normal_forms_agree(spark):
    texts = ["A．$\\frac{1}{2}$ ＿＿＿ （ ）， x", "ＡＢＣ　１２", "", "Ｘ＿＿y(  )"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [normal_text(r.t) for r in rows] and rows[0].n == "a12x" and rows[1].n == "abc12"


def test_deep_trees_keep_all_levels(spark):
    text = "".join(f'[{{"name": "n{k}", "children": ' for k in range(9)) + "[]" + "}]" * 9
    rows = from_json(spark.createDataFrame([(text,), (None,)], "t string"), "t").orderBy("level").collect()
    assert [(r.name, r.is_leaf) for r in rows] == [(f"n{k}", k == 8) for k in range(9)]


def test_a_half_does_not_depend_on_the_order_of_the_weights(spark):
    """4 * 150 / 48 is 12.5; added in some orders 13.8, 13.8, 11.4, 5 and 4 make a little less than 48."""
    weights = [("R", 13.799999999999999), ("R", 13.799999999999999), ("R", 11.4), ("A", 5.0), ("N", 4.0)]
    rows = [(i, n, kind, w) for i, ws in enumerate(itertools.permutations(weights)) for n, (kind, w) in enumerate(ws)]
    table = spark.createDataFrame(rows, "paper int, no int, kind string, w double").coalesce(1)
    base = F.when(F.col("kind") == "N", 4).when(F.col("kind") == "A", 5).otherwise(12)
    got = assign_scores(table, ["paper"], ["no"], F.col("kind"), "R", base, F.col("w"), F.lit(150)).where("kind = 'N'").select("assigned").distinct().collect()
    assert [r.assigned for r in got] == [12]


def test_cells_are_cut_before_they_are_sorted(spark):
    """A cell's first rows are kept in every task, which a lead over the whole cell would prevent, and a cut is seen."""
    rows = spark.range(40).select(F.lit("g").alias("g"), F.col("id").alias("item"), F.lit("A").alias("kind"), F.lit("t").alias("path"), F.lit(0.5).alias("coef"), F.col("id").cast("string").alias("stem"))
    kept = compose_module.candidates(rows, ["g"], "item", "kind", "path", "coef", "stem", compose_module.Blueprint({"A": 2}, 0.5, {"t": 1}, ()), 3)
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["item"], r["__cut"]) for r in kept.collect()) == [(37, True), (38, False), (39, False)]
    few = compose_module.candidates(rows.where("item < 3"), ["g"], "item", "kind", "path", "coef", "stem", compose_module.Blueprint({"A": 2}, 0.5, {"t": 1}, ()), 3)
    assert sorted((r["item"], r["__cut"]) for r in few.collect()) == [(0, False), (1, False), (2, False)]
