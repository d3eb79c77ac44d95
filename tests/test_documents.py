"""Recogniser blocks, school names and vendors' price pages, by their values."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from itemloom.functions.text import unescape_markdown
from itemloom.operators.classify import classify_paper
from itemloom.operators.pricing import scoped_prices, tab_prices
from itemloom.operators.schools import clean_school, school_of
from itemloom.sources.blocks import as_units, from_content_list
from itemloom.sources.html_tables import read_tables


def test_each_kind_of_block_keeps_its_content(spark):
    items = [
        {"type": "text", "text": "卷名", "text_level": 1, "page_idx": 0, "bbox": [0, 100, 1200, 300]},
        {"type": "text", "text": r"长为 \_\_\_ cm 与 $a\_b$", "bbox": [1, 2, 3]},
        {"type": "equation", "text": r"$$a\_1$$", "page_idx": 2},
        {"type": "image", "img_path": "images/1.jpg"},
        {"type": "image", "image_caption": ["图一", "", "装置"], "img_path": "images/2.jpg"},
        {"type": "chart", "chart_caption": "销量"},
        {"type": "table", "table_body": "<table><tr><td>题号</td><td>1</td></tr></table>", "table_caption": ["表"]},
        {"type": "table", "table_caption": ["只有标题"]},
        {"type": "list", "list_items": [r"(1) 甲 \_\_", "(2) 乙"]},
        {"type": "code", "code_body": "print(1)"},
        {"type": "other", "content": "别的内容"},
        {"text": "没有类型"},
        {"type": "header", "text": "页眉"}, {"type": "page_number", "text": "3"}, {"type": "text", "text": "  "}, {"type": "image"},
    ]
    blocks = from_content_list(spark.createDataFrame([(1, json.dumps(items, ensure_ascii=False)), (2, "[]"), (3, None)], "doc int, content string"), "doc", "content")
    got = [(r.seq, r.page, r.type, r.text, r.image) for r in blocks.orderBy("seq").collect()]
    assert got == [
        (1, 1, "title", "卷名", None), (2, 1, "text", r"长为 ___ cm 与 $a\_b$", None), (3, 3, "equation", r"$$a\_1$$", None), (4, 1, "image", "", "images/1.jpg"), (5, 1, "image", "图一\n装置", "images/2.jpg"), (6, 1, "image", "销量", None),
        (7, 1, "table", "<table><tr><td>题号</td><td>1</td></tr></table>", None), (8, 1, "table", "只有标题", None), (9, 1, "text", "(1) 甲 __\n(2) 乙", None), (10, 1, "text", "print(1)", None), (11, 1, "text", "别的内容", None), (12, 1, "text", "没有类型", None),
    ]
    assert [list(r.bbox) for r in blocks.orderBy("seq").limit(2).collect()] == [[0.0, 0.1, 1.0, 0.3], [0.0, 0.0, 1.0, 1.0]]
    units = {r.seq: r.text for r in as_units(blocks).collect()}
    assert (units[4], units[5], units[7].split()) == ("[图]", "[图] 图一\n装置", ["[表]", "题号", "1"])


@pytest.mark.parametrize("text,want", [(r"底边长为 \_\_ cm", "底边长为 __ cm"), (r"\* 号 $a\_b$ 与 $$x\_1$$", r"* 号 $a\_b$ 与 $$x\_1$$"), (r"\( 和 \. 不变", r"\( 和 \. 不变"), ("", "")])
def test_markdown_is_unescaped_outside_formulas(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(unescape_markdown(F.col("t"))).first()[0] == want


SCHOOLS = [
    ("厦门一中", "", "厦门第一中学"), ("福建省厦门市第一中学", "", "厦门第一中学"), ("厦门十一中", "", "厦门第十一中学"), ("厦门同安一中", "", "厦门同安第一中学"), ("同安一中", "福建 · 厦门", "厦门同安第一中学"),
    ("槟榔中学", "福建省厦门市初三期中考试", "厦门槟榔中学"), ("双十中学", "福建 · 厦门", "厦门双十中学"), ("厦门厦门双十中学", "", "厦门双十中学"), ("厦门思明区厦门市莲花中学", "", "厦门莲花中学"), ("厦门明区厦门市莲花中学", "", "厦门莲花中学"),
    ("厦门市集美区厦门市集美区灌口中学", "", "厦门灌口中学"), ("厦门湖里五缘第二实验学校", "", "厦门五缘第二实验学校"), ("厦门一中集美分校", "", "厦门灌口中学"), ("厦门一中集美分校（灌口中学）", "", "厦门灌口中学"), ("厦门灌口中学（厦门一中集美分校）", "", "厦门灌口中学"),
    ("厦门第一中学（海沧校区）", "", "厦门第一中学海沧校区"), (" 福建省 厦门市 槟榔中学 ", "", "厦门槟榔中学"), ("集美中学", "北京", "集美中学"), ("槟榔中学", "", "槟榔中学"), ("北京第一中学", "福建 · 厦门", "北京第一中学"), ("义务教育学校", "福建 · 厦门", ""), ("厦门市义务教育学校", "", ""), ("", "", ""),
    ("厦门实验中学", "", "厦门实验中学"), ("厦门市湖里区实验中学", "", "厦门湖里实验中学"), ("厦门外国语学校瑞景分校", "", "厦门瑞景外国语中学"),
]
TITLES = [
    ("2023-2024学年初三（上）厦门集美中学第二次月考英语", "厦门集美中学"), ("厦门六中2022—2023学年高一年10月月考物理试卷", "厦门第六中学"), ("2022-2023学年福建省厦门大学附属科技中学高一（上）月考物理试卷（10月份）", "厦门大学附属科技中学"),
    ("厦门外国语学校2022-2023学年度第一学期期中考试", "厦门外国语学校"), ("2023学年高一上学期厦门一中期中考试", "厦门第一中学"), ("2024学年初中数学第一学期期中质量检测", ""), ("厦门市2025年中考数学", ""), ("2024年福建省厦门市思明区双十中学九年级上期中", "厦门双十中学"),
    ("厦门市第一中学2023届高三", "厦门第一中学"), ("厦门市湖里区实验中学2024年月考", "厦门湖里实验中学"), ("思明区莲花中学期末考试", "厦门莲花中学"), ("福建福建省厦门双十中学思明分校2025学年期中考试", "厦门双十中学思明分校"),
    ("福建省厦门市海沧区厦门双十中学海沧附属学校2025学年期中考试", "厦门双十中学海沧附属学校"), ("厦门第一中学（思明校区）2025学年期中考试", "厦门第一中学思明校区"), ("厦门一中集美分校（灌口中学）2025学年期中考试", "厦门灌口中学"), ("厦门市义务教育学校2025学年期末考试", ""), (None, ""),
]


def test_school_names_have_one_spelling(spark):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(SCHOOLS)], "i int, name string, context string, want string")
    once = rows.withColumn("got", clean_school(F.col("name"), F.col("context")))
    again = once.withColumn("again", clean_school(F.col("got"), F.col("context"))).orderBy("i").collect()
    assert [(r.name, r.got) for r in again] == [(r.name, r.want) for r in again]
    assert [(r.name, r.again) for r in again] == [(r.name, r.want) for r in again]


def test_schools_out_of_titles(spark):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(TITLES)], "i int, title string, want string").withColumn("got", school_of(F.col("title"))).orderBy("i").collect()
    assert [(r.title, r.got) for r in rows] == [(r.title, r.want) for r in rows]


def test_a_file_name_completes_what_the_text_says(spark):
    rows = spark.createDataFrame([("道德与法治试题\n一、选择题", "2026福建中考_道德与法治试题及参考答案"), ("槟榔中学九年级数学期中考试", "厦门市2025年数学试卷")], "t string, h string")
    a, b = rows.select(classify_paper(F.col("t"), F.col("h")).alias("m")).select("m.*").collect()
    assert (a.title, a.stage, a.subject, a.paper_type) == ("道德与法治试题", "初中", "道德与法治", "中考真题")
    assert b.school == "厦门槟榔中学"


SCOPED = """<h2>Singapore</h2><table><tr><th>Model ID</th><th>Deployment scope</th><th>Input tokens per request</th><th>Input price (per 1 million tokens)</th><th>Output price (per 1 million tokens)</th></tr>
<tr><td rowspan="3">Alpha-Small latest</td><td>International</td><td>0&lt;Token≤32K</td><td>$0.03</td><td>$0.13</td></tr><tr><td>International</td><td>32K&lt;Token≤256K</td><td>$0.1</td><td>$0.4</td></tr><tr><td>International</td><td>256K&lt;Token≤1M</td><td>$0.2</td><td>$0.8</td></tr>
<tr><td>alpha-small</td><td>Global</td><td>0&lt;Token≤32K</td><td>$9</td><td>$9</td></tr><tr><td>alpha-small</td><td>International</td><td>0&lt;Token≤32K</td><td>$8</td><td>$8</td></tr></table>
<table><tr><th>Model ID</th><th>Deployment scope</th><th>Input price</th><th>Output price</th></tr><tr><td>beta-1</td><td>International</td><td>Busy hours: $0.3<br>Idle hours: $0.15</td><td>Busy hours: $1.2<br>Idle hours: $0.6</td></tr><tr><td>价格说明</td><td>International</td><td>$1</td><td>$1</td></tr></table>
<table><tr><th>Model ID</th><th>Mode</th><th>Input price</th><th>Output price</th></tr><tr><td>gamma</td><td>Non-thinking mode</td><td>$0.4</td><td>$1.2</td></tr><tr><td>gamma</td><td>Thinking mode</td><td>$0.4</td><td>$4</td></tr><tr><td>delta</td><td>Non-thinking and thinking modes</td><td>$1</td><td>free</td></tr></table>
<h2>Beijing</h2><table><tr><th>Model</th><th>Input price</th><th>Output price</th></tr><tr><td>beta-1</td><td>$7</td><td>$7</td></tr></table>"""
TABS = """<h3>按 Token 计费（后付费）</h3><ul><li>广州</li><li>新加坡</li></ul>
<table><tr><th>模型名称</th><th>条件</th><th>峰谷时段</th><th>推理 输入</th><th>推理输出</th><th>缓存命中</th></tr><tr><td rowspan="2">甲模型</td><td rowspan="2">输入长度（0, 128k]</td><td>高峰</td><td>4</td><td>16</td><td>1</td></tr><tr><td>空闲</td><td>2</td><td>8</td><td>0.5</td></tr><tr><td>乙模型</td><td>-</td><td>空闲</td><td>1,000</td><td>3</td><td>-</td></tr></table>
<table><tr><th>模型名称</th><th>条件</th><th>推理输入</th><th>推理输出</th></tr><tr><td>甲模型</td><td>输入长度 32k+</td><td>5 元</td><td>20 元</td></tr></table>
<h3>批量推理</h3><table><tr><th>模型名称</th><th>推理输入</th><th>推理输出</th></tr><tr><td>丙模型</td><td>1</td><td>1</td></tr></table>"""


def test_prices_by_region_scope_tier_hours_and_mode(spark):
    cells = read_tables(spark.createDataFrame([(1, SCOPED), (2, None)], "doc int, html string"), "doc", "html").cache()
    got = scoped_prices(cells, "doc", "Singapore", "International").orderBy("name", "max_input", "mode").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("alpha-small", 32_000, None, 0.03, 0.13, None, None), ("alpha-small", 256_000, None, 0.1, 0.4, None, None), ("alpha-small", 1_000_000, None, 0.2, 0.8, None, None),
        ("beta-1", None, None, 0.3, 1.2, 0.15, 0.6), ("gamma", None, "non_thinking", 0.4, 1.2, None, None), ("gamma", None, "thinking", 0.4, 4.0, None, None),
    ]
    assert [r.input for r in scoped_prices(cells, "doc", "Beijing", "International").collect()] == [7.0]


@pytest.mark.parametrize("region,want", [
    ("广州", [("乙模型", None, 1000.0, 3.0, None, None, None, None), ("甲模型", 128_000, 4.0, 16.0, 1.0, 2.0, 8.0, 0.5)]),
    ("新加坡", [("甲模型", None, 5.0, 20.0, None, None, None, None)]),
    ("东京", [("乙模型", None, 1000.0, 3.0, None, None, None, None), ("甲模型", 128_000, 4.0, 16.0, 1.0, 2.0, 8.0, 0.5)]),
])
def test_prices_by_tabs_of_regions_and_hours(spark, region, want):
    pages = spark.createDataFrame([(1, TABS), (2, "<p>nothing</p>")], "doc int, html string")
    got = tab_prices(pages, read_tables(pages, "doc", "html"), "doc", "html", region).orderBy("name").collect()
    assert [tuple(r)[1:] for r in got] == want
