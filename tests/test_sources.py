"""Tables inside HTML pages, trees in CSV files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from itemloom.plans import catalog
from itemloom.operators.tree import SEPARATOR
from itemloom.sources import trees
from itemloom.sources.html_tables import _Cells, grid, parse, read_tables

PAGE = """<h2>Prices</h2><table><tr><th rowspan=2>Model</th><th colspan="2">Price</th></tr><tr><th>in</th><th>out</th></tr>
<tr><td>m1</td><td>1 <b>2</b></td><td></td></tr></table><table><tr><td>x</td></tr></table>"""


def test_spans_are_filled(spark):
    rows = read_tables(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none")], "k long, html string"), "k", "html").orderBy("k", "table_no", "row_no").collect()
    assert [(r.table_no, r.heading, r.cells) for r in rows] == [
        (1, "Prices", ["Model", "Price", "Price"]),
        (1, "Prices", ["Model", "in", "out"]),
        (1, "Prices", ["m1", "1 2", ""]),
        (2, "Prices", ["x"]),
    ]


def test_row_span_beyond_the_table():
    assert grid([[(5, 1, "a"), (1, 1, "b")], [(1, 1, "c")]]) == [["a", "b"], ["a", "c"]]


def _tree(df):
    return {(r.path.split(SEPARATOR)[-1], r.level, tuple(r.aliases), r.is_leaf) for r in df.collect()}


def test_trees_of_csv_files(spark, tmp_path):
    """Headers by their words, a column of aliases anywhere, ragged and quoted rows, nodes that repeat; two files with a header each."""
    for name, more in (("a", "代数,导数|微分 、求导,函数\n,,\n代数,,\n"), ("b", '"几何, 平面", ,\n 代数 ,导数；斜率,函数,极值\n')):
        (tmp_path / f"{name}.csv").write_text("\ufeff一级,别名,二级\n" + more, encoding="utf-8")
    got = _tree(trees.read_csv(spark, str(tmp_path)))
    assert got == {("代数", 1, (), False), ("函数", 2, ("导数", "微分", "求导"), False), ("极值", 3, ("导数", "斜率"), True), ("几何, 平面", 1, (), True)}
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "p.csv").write_text("代数,函数\n代数,数列,等差\n", encoding="utf-8")
    assert _tree(trees.read_csv(spark, str(plain))) == {("代数", 1, (), False), ("函数", 2, (), True), ("数列", 2, (), False), ("等差", 3, (), True)}
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "e.csv").write_text("\n , \n", encoding="utf-8")
    assert trees.read_csv(spark, str(empty)).count() == 0


def test_price_pages_are_never_broadcast(spark):
    """Pages as long as these come from columns of a few bytes, by whose size a plan would broadcast them."""
    plan = catalog.queries()["tab_price_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pages_are_dealt_to_all_tasks(spark):
    """One file of few bytes is one task, however long the pages that are made of it."""
    pages = spark.range(400).coalesce(1).select("id", F.concat(F.lit("<table><tr><td>"), F.col("id").cast("string"), F.lit("</td></tr></table>")).alias("html"))
    rows = read_tables(pages, "id", "html").withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() >= 4
    assert sorted((r.id, r.cells[0]) for r in rows.collect()) == [(i, str(i)) for i in range(400)]


def test_plain_pages_are_read_as_the_parser_reads_them():
    rng = random.Random(1)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<td rowspan=2>", "<th colspan='3'>", "</th>", '<TD ROWSPAN="2" class=x>', "<br>", "<br/>", "<p>", "a", "b &amp; c", "&lt;td&gt;", "<", "x > y", "<!-- c -->", "<h2>", "</h2>", "<script>", "</script>", "<div title='a>b'>", "<td nowrap>", "</td x>", "&", "<td\n rowspan=3 >", "<td =>", " \n", "<title>"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        if "<table>" in page.partition("<td")[2] or "<table>" in page.partition("<th")[2]:
            continue  # a table in an open cell is no case of this test
        parser = _Cells()
        parser.feed(page)
        assert parse(page) == parser.tables


def test_levels_outside_the_catalog_are_not_shuffled(spark):
    """A path that names a level twice, an item on two paths: counted once."""
    points = spark.createDataFrame([(1, "a / b / a"), (1, "a / c / x"), (2, "a / d / y"), (3, "q / d / z"), (3, None)], "item long, path string")
    catalog_ = spark.createDataFrame([("n", ["a", "b", "a"]), ("m", ["d"]), ("none", ["w"])], "node_id string, knowledge array<string>")
    out = trees.chapter_counts(points, catalog_, "item", "path")
    assert {(r.node_id, r["items"]) for r in out.collect()} == {("n", 2), ("m", 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [item" not in plan  # no distinct of all levels before the sections are met
