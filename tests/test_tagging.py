"""Split questions and knowledge points of a model's answers, compared with plain loops."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from itemloom.operators import mutate, tagging

NODES = [(i, n, a, f"book/{n}", i) for i, (n, a) in enumerate([("函数的单调性", []), ("函数的奇偶性", []), ("等差数列", ["等差数列求和"]), ("3.2 椭圆", []), ("牛顿第二定律", []), ("函数", [])])]


def nodes(spark):
    return spark.createDataFrame(NODES, "node_id int, name string, aliases array<string>, path string, at int")


def own(name: str) -> tuple:
    return ("kp_" + hashlib.md5(f"数学:{name}".encode()).hexdigest()[:10], name, False)


def node(i: int) -> tuple:
    return (str(i), NODES[i][1], True)


def told(rows) -> dict:
    return {r.key: (None if r.refs is None else [(x.id, x.name, x.in_tree) for x in r.refs], r.difficulty) for r in rows.collect()}


def test_points_chosen_by_number(spark):
    answers = [
        (1, ["k2", " k0 ", "k2"], ["1. 等差数列。", "x"], "0.456"),  # twice the same; a name that is a listed node stands again
        (2, ["k9", "0", "kk1", "k-1", None], [" ；", "立体几何"], "1.5"),  # none exists; the first name left is outside the tree
        (3, ["k0", "k1", "k2", "k3"], ["立体几何"], "NaN"),  # three at most
        (4, None, None, None),
        (5, [], ["椭圆"], "high"),
        (6, ["k5"], ["一、" + "长" * 40], "0"),
    ]
    got = told(tagging.tag_listed(spark.createDataFrame(answers, "key int, ids array<string>, other array<string>, difficulty string"), nodes(spark), F.lit("数学")))
    assert got == {1: ([node(2), node(0), node(2)], 0.46), 2: ([own("立体几何")], None), 3: ([node(0), node(1), node(2)], None), 4: (None, None), 5: ([node(3)], None), 6: ([node(5), own("长" * 30)], 0.0)}


def test_points_chosen_among_candidates(spark):
    answers = [
        (1, ["函数单调性"], [0, 4], "0.5"),  # 4 is no candidate
        (2, ["椭圆", "椭圆 ", "群论"], [4], "0.5"),  # no valid choice: names stand for themselves
        (3, ["等差数列求和", "等差数列"], None, None),  # two names of one node
        (4, None, [0], None),
        (5, ["函数"], [5, 1, 0, 5], None),
    ]
    rows = spark.createDataFrame(answers, "key int, names array<string>, chosen array<int>, difficulty string")
    got = told(tagging.tag_retrieved(rows, nodes(spark), F.lit("数学")))
    assert got[1] == ([node(0)], 0.5) and got[2] == ([node(3), own("群论")], 0.5) and got[3] == ([node(2)], None) and got[4] == (None, None)
    assert got[5][0] == [node(5), node(1), node(0)]
    most = tagging.candidates(rows, nodes(spark)).groupBy("key").count().collect()
    assert all(r["count"] <= 18 for r in most)
    assert tagging.tag_retrieved(rows.limit(0), nodes(spark), F.lit("数学")).count() == 0


def split_plain(rows, chosen):
    """The same in a loop: {(paper, id, part): (no, stem, score, answer, analysis)}."""
    mark = re.compile(r"（\d+）|\(\d+\)|[⑴-⒇]")

    def cut(t):
        at = [m.start() for m in mark.finditer(t or "")]
        return None if len(at) < 2 else [t[: at[0]], *[t[a:b].strip() for a, b in zip(at, [*at[1:], len(t)])]]

    out, sizes = {}, {(p, i): len(c) - 1 for p, i, _, t, *_ in rows if i in chosen and (c := cut(t))}
    for p, i, no, t, s, a, x in rows:
        no += sum(sizes.get((q, j), 1) - 1 for q, j, m, *_ in rows if q == p and m < no)
        if (p, i) not in sizes:
            out[p, i, None] = (no, t, s, a, x)
            continue
        head, *parts = cut(t)
        answers = (cut(a) or [""])[1:]
        for k, part in enumerate(parts):
            each = int(s // len(parts))
            score = s - each * (len(parts) - 1) if k == len(parts) - 1 else each
            out[p, i, k] = (no + k, head + part, score, answers[k] if len(answers) == len(parts) else a if k == 0 else None, x if k == 0 else None)
    return out


def test_questions_split_at_their_marks(spark):
    rows = [
        (1, 1, 1, "题干（1）求 a； （2）求 b\n（3）求 c", 10.0, "（1）1（2）2（3）3", "解"),
        (1, 2, 2, "(1)甲 (12)乙", 5.0, "只有一个", "解"),  # nothing before the first mark
        (1, 3, 3, "没有小问（1）", 4.0, None, None),  # one mark
        (1, 4, 3, "⑴甲⑵乙", 7.5, "⑴x ⑵y ⑶z", None),  # a number that repeats; answers that don't fit
        (1, 5, 4, "（1）甲（2）乙", 6.0, "a", "b"),  # not chosen
        (2, 6, 1, None, 3.0, None, "c"),
        (2, 7, 2, "", 3.0, "", ""),
        (2, 8, 9, "长" * 50_000 + "（1）x（2）y", 3.0, None, "d"),
    ]
    chosen = [1, 2, 3, 4, 6, 7, 8]
    table = spark.createDataFrame([(*r, 7) for r in rows], "paper int, id int, no int, stem string, score double, answer string, analysis string, n int")
    got = mutate.split_questions(table, ["paper"], "no", F.col("id").isin(chosen), "stem", "score", "answer", ["analysis"])
    assert got.columns == [*table.columns, "part"] and got.dtypes[:-1] == table.dtypes
    assert {(r.paper, r.id, r.part): (r.no, r.stem, r.score, r.answer, r.analysis) for r in got.collect()} == split_plain(rows, chosen)
    assert mutate.split_questions(table.limit(0), ["paper"], "no", F.lit(True), "stem", "score", "answer", []).count() == 0
