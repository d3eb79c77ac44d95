"""Whole questions, their answers and their reading materials, from a paper's lines."""

from __future__ import annotations

import duckdb
import pytest

from itemloom.operators import answers, materials, segment
from itemloom.plans import catalog


def units_of(spark, *rows, paper: int = 1, numbered: bool = False):
    """Units of one paper, or, with ``numbered``, of several, each row with its paper's number."""
    pairs = rows if numbered else [(paper, r) for r in rows]
    at: dict[int, int] = {}
    each = []
    for key, r in pairs:
        each.append((key, at.setdefault(key, 0), *(("text", r) if isinstance(r, str) else r)))
        at[key] += 1
    return spark.createDataFrame(each, "paper int, seq int, type string, text string").repartition(2)


def built(spark, units, with_answer: bool = True, with_materials: bool = False):
    found = None
    if with_materials:
        found, heads = materials.find_materials(units)
        units = materials.without_materials(units, found)
    marks = segment.segment(units)
    sections = segment.headings(units, marks)
    area = answers.answer_area(units, marks) if with_answer else None
    out = segment.build(units, marks, sections, area)
    if with_answer:
        out = answers.finalize(out, units)
    settled = segment.infer_scores(out, sections, segment.paper_totals(units, marks))
    out = segment.rescored_flags(settled)
    if with_materials:
        out = materials.attach_materials(out, found, heads)
    return out.orderBy("paper", "question").collect()


EXAM = [
    "明湖市 2031—2032 学年高二上学期期中考试", "数 学", "本试卷共 3 页，满分 64 分。考试时长 70 分钟。",
    "一、单选题：本题共 4 小题，每小题 5 分，共 20 分。每小题给出的选项中，", "只有一项符合要求。",
    "1．若集合 M = {1, 2, 3}，N = {2, 3, 4}，则 M 与 N 的交集为（ ）", "A．{2, 3}    B．{1}    C．{4}    D．{1, 4}",
    "2．下列命题中为真命题的是（ ）", "A．空集是任何集合的真子集", "B．零是自然数", "C．负数有平方根", "D．圆周率是有理数",
    "3．“x > 2”是“x > 1”的（ ）", "A．充分不必要条件  B．必要不充分条件  C．充要条件  D．都不是",
    "4．已知 a + b = 6，则 ab 的最大值为（ ）", "A．6    B．9    C．12    D．36",
    "二、多选题：本题共 1 小题，每小题 6 分，共 6 分。", "5．下列函数中是奇函数的有（ ）", "A．y = x    B．y = x^3    C．y = 1/x    D．y = x^2",
    "三、填空题：本题共 2 小题，每小题 5 分，共 10 分。", "6．函数 y = √(x - 2) 的定义域为 ________.", "7．不等式 x^2 < 4 的解集为 ________.",
    "四、解答题：本题共 2 小题，共 24 分。写出演算步骤。",
    "8．（12 分）设集合 A 为不等式 x^2 < 9 的解集.", "（1）求 A；", "（2）求 A 的补集.", "9．（12 分）设 f(x) = x + 4/x.", "（1）求最小值；", "（2）讨论单调性.",
    "参考答案", "1-4 ABAB", "5．ABC", "6．[2, +∞)", "7．(-2, 2)", "8．（1）A = (-3, 3)；（2）其余实数", "9．（1）4；（2）先减后增",
]

STORY = [
    "Every Saturday, old Mr Green walks down to the harbour with a basket and a very long fishing rod.",
    "He never catches anything big, but he talks to everybody who comes along and he gives sweets to the children.",
    "One morning the harbour was empty because of a storm, so he sat in the small café and wrote a letter to his daughter.",
]
NOTICE = "The Riverside Museum is looking for two guides who can speak French and work on Sundays. The pay is 90 pounds a day, and lunch is free for everybody who works there."
OLD_HOUSE = "那一年的夏天，河水涨得很高，村里的人都搬到了山上的祠堂里，祖父却坚持留在老屋，守着他的几箱旧书和一只猫。" * 4
SPORTS_DAY = "Sports Day was only one week away, and all the pupils wanted to give their old teacher a big ____1____. " * 2


PAPERS = {
    "nine_questions_with_kinds_scores_options_and_answers": ([*EXAM], True, False),
    "nine_questions_with_kinds_scores_options_and_answers_2": ([*EXAM], False, False),
    "a_gap_in_the_numbers_and_default_scores": (["1．这是第一道题的题干内容", "2．这是第二道题的题干内容 A．甲 B．乙 C．丙", "4．空格处应填 ____ 才对"], False, False),
    "pictures_notices_and_inline_answers": (["注意事项：", "1．答题前写好姓名。", "三、实验题", "16．观察图中的实验装置", ("image", "[图]"), "(1)仪器的名称是______；", "【答案】烧杯", "【解析】由图可知", "17．下列说法中错误的是（ ）A．甲 B．乙 C．丙 D．丁", "【答案】AC"], True, False),
    "several_letters_make_a_single_choice_a_multiple_one": (["一、单选题", "1．选出正确的各项（ ）A．甲 B．乙 C．丙 D．丁", "【答案】BD"], True, False),
    "labelled_passages_belong_to_the_questions_after_them": (["Ⅲ.阅读理解（共两节，满分20分）", "第一节 阅读以下两篇材料，选出最佳答案。", "A", NOTICE, "32. A guide must be able to ____.", "A. cook B. speak French C. drive D. swim", "33. The pay is ____ a day.", "A. 60 B. 70 C. 80 D. 90.", "【答案】32. B 33. D", "【解析】", "【33题详解】", "细节理解题。故选D。", "B", *STORY, "34. Mr Green likes ____.", "A. talking B. cooking C. driving D. skiing", "35. He wrote to ____.", "A. a boy B. his daughter C. a guide D. nobody"], True, True),
    "a_cloze_gives_back_the_penalty_for_short_stems": (["第二节 完形填空", "从每小题所给的三个选项中，选出可以填入空白处的最佳答案。（每小题1.5分，满分9分）", "Lena Brook is a retired nurse of 71 who still works every day. She has been a good ____26____ to all the children of her street.", "But Lena ____27____ wanted to learn to paint, and so she started with small pictures of the birds in her garden.", "26. A. friend B. doctor C. driver", "27. A. always B. never C. hardly"], False, True),
    "prose_after_options_is_a_passage_and_a_heading_ends_it": (["我们的生活", "41. What is the best title for the text?", "A. Boats B. Schools C. Houses D. Games", *STORY, "42. Who got a letter?", "A. The cook B. Jack C. The daughter D. The guide", "Ⅳ. 词汇运用（共10小题）", "43. The bird sat on its n____ all day long."], False, True),
    "a_labelled_picture_needs_few_words": (["B", "Hi, I am Tom. Look at this picture of my family, please.", ("image", "[图]"), "26. Ann is Tom’s ____ .", "A. aunt B. uncle C. cousin D. sister"], False, True),
    "a_chinese_passage_after_an_instruction": (["二、现代文阅读（20分）", "阅读下面的文字，完成8～9题。", "老屋", OLD_HOUSE, "8. 文中的祖父是一个怎样的人？", "9. 赏析画线句子的表达效果。"], False, True),
    "numbers_that_start_again_are_questions": (["14. How many pupils will come?", "A. Two. B. Three. C. Four.", "15. What will they bring?", "A. A horse. B. A cake. C. A ball.", "Ⅱ. 选择填空", "从A、B、C中选择一个最佳答案。（共2题，每题1分）", "1. —Look, there is ____ apple.", "A. a B. the C. an", "2. My sister ____ sings.", "A. always B. often C. never", "二、语言知识运用（共一节，2小题）", "完形填空 选出可以填入空白处的最佳答案。", SPORTS_DAY, "“Fine,” Ben said, ____2____ the list. “You clean the room.”", "1. A. treasure B. surprise C. holiday", "2. A. looking at B. turning off C. putting on"], False, True),
    "a_glued_heading_stays_with_its_options": (["10. —Are they in the same class? —____", "A. Yes, she is B. No, she isn’t C. Yes, they are Ⅲ. 阅读理解。(每小题 2 分，共 30 分)", "A", *STORY, "11. Who got a letter?", "A. The cook B. Jack C. The daughter D. The guide"], False, True),
}


@pytest.fixture(scope="module")
def built_papers(spark):
    """All papers at once, those with the same wishes in one table."""
    out = {}
    for wishes in sorted({x[1:] for x in PAPERS.values()}):
        names = [n for n, x in PAPERS.items() if x[1:] == wishes]
        rows = built(spark, units_of(spark, *((i, r) for i, n in enumerate(names) for r in PAPERS[n][0]), numbered=True), *wishes)
        out |= {n: [r for r in rows if r.paper == i] for i, n in enumerate(names)}
    return out


def test_nine_questions_with_kinds_scores_options_and_answers(built_papers):
    rows = built_papers["nine_questions_with_kinds_scores_options_and_answers"]
    assert [(r.kind, r.score, len(r.options), r.answer) for r in rows] == [
        ("单选题", 5, 4, "A"), ("单选题", 5, 4, "B"), ("单选题", 5, 4, "A"), ("单选题", 5, 4, "B"), ("多选题", 6, 4, "ABC"),
        ("填空题", 5, 0, "[2, +∞)"), ("填空题", 5, 0, "(-2, 2)"), ("解答题", 12, 0, "（1）A = (-3, 3)；（2）其余实数"), ("解答题", 12, 0, "（1）4；（2）先减后增"),
    ]
    assert rows[0].stem.startswith("若集合 M") and rows[3].options[-1] == "36"
    assert "\n（1）" in rows[7].stem and "\n（2）" in rows[7].stem
    assert all(r.confidence >= 0.9 for r in rows) and [r.score_source for r in rows] == ["section"] * 7 + ["question"] * 2
    assert all(r.answer is None and r.analysis is None for r in built_papers["nine_questions_with_kinds_scores_options_and_answers_2"])


def test_answer_area_in_ranges_by_number_and_over_several_units(spark):
    units = units_of(spark, "1．一道有题干的题目", "参考答案", "1-3 ABD", "4．【答案】C【解析】由已知得出", "5．(1) 略", "(2) 3", "7-8 ABC", "6．A. apple pie", "4．B")
    marks = segment.segment(units)
    got = {r.printed: (r.answer, r.analysis) for r in answers.answer_area(units, marks).collect()}
    assert got == {1: ("A", None), 2: ("B", None), 3: ("D", None), 4: ("B", None), 5: ("(1) 略\n(2) 3", None), 6: ("A. apple pie", None)}


def test_a_gap_in_the_numbers_and_default_scores(built_papers):
    rows = built_papers["a_gap_in_the_numbers_and_default_scores"]
    assert [(r.printed, r.kind, r.score, r.confidence) for r in rows] == [(1, "解答题", 12, 0.9), (2, "单选题", 5, 0.7), (4, "填空题", 5, 0.7)]
    assert rows[1].flags == ["分值为默认值", "单选题选项数为 3"] and rows[2].flags == ["分值为默认值", "题号不连续"]


@pytest.mark.parametrize("heading,score", [("一、选择题", 5), ("一、多项选择题", 6), ("一、填空题", 5), ("一、解答题", 12)])
def test_usual_score_of_each_kind(spark, heading, score):
    assert [r.score for r in built(spark, units_of(spark, heading, "1．题干内容足够长的一道题"))] == [score]


@pytest.mark.parametrize("line", ["十一十二、这不是大题标题", "一、" + "题" * 70])
def test_what_only_looks_like_a_section(spark, line):
    marks = segment.segment(units_of(spark, "1．前面的一道题目内容", line)).orderBy("seq").collect()
    assert [m.role for m in marks] == ["start", "content"]


def test_pictures_notices_and_inline_answers(built_papers):
    rows = built_papers["pictures_notices_and_inline_answers"]
    assert [(r.kind, r.stem, r.answer, r.analysis) for r in rows] == [("解答题", "观察图中的实验装置\n(1)仪器的名称是______；", "烧杯", "由图可知"), ("解答题", "下列说法中错误的是（ ）", "AC", None)]


def test_several_letters_make_a_single_choice_a_multiple_one(built_papers):
    assert [r.kind for r in built_papers["several_letters_make_a_single_choice_a_multiple_one"]] == ["多选题"]


def asked(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "paper int, question int, printed int, answer string, analysis string")


def given(df):
    return [(r.answer, r.analysis) for r in df.orderBy("question").collect()]


def test_parts_marked_with_other_numbers_are_handed_over(spark):
    found = asked(spark, (1, "C\n【2 题答案】\nA\n【3 题答案】\nD", "第一题的解析"), (2, None, None), (3, None, None), (4, "B", None))
    assert given(answers.distribute(found)) == [("C", "第一题的解析"), ("A", None), ("D", None), ("B", None)]
    found = asked(spark, (1, "C【2 题答案】A【9 题答案】B", None), (2, "D", None))
    assert given(answers.distribute(found)) == [("C\nA\nB", None), ("D", None)]
    found = asked(spark, (1, None, "甲【2题解析】乙"), (2, "A", None), (None, "x", ""))
    assert given(answers.distribute(found)) == [(None, "甲"), ("A", "乙"), ("x", None)]


def test_tables_numbered_units_and_conclusions_fill_only_what_is_empty(spark):
    table = units_of(spark, ("table", "[表] 题号 1 2 3 4 选项 A C D B 题号 9 10 答案 AC BD"))
    found = asked(spark, (1, None, None), (2, "D", None), (3, None, None), (9, None, None), (11, None, "过程从略，故选：A"))
    assert [a for a, _ in given(answers.finalize(found, table))] == ["A", "D", "D", "AC", "A"]
    block = units_of(spark, "【1 题答案】\n【答案】C\n【2 题答案】\n【答案】A【解析】显然\n【3 题答案】\n【答案】D")
    assert given(answers.finalize(asked(spark, (1, None, None), (2, None, None), (3, "B", None)), block)) == [("C", None), ("A", "显然"), ("B", None)]


def test_labelled_passages_belong_to_the_questions_after_them(built_papers):
    rows = built_papers["labelled_passages_belong_to_the_questions_after_them"]
    assert [r.printed for r in rows] == [32, 33, 34, 35]
    assert rows[0].material == rows[1].material == NOTICE and rows[2].material == rows[3].material == "\n".join(STORY)
    assert "harbour" not in (rows[1].analysis or "") and rows[1].options[-1] == "90." and rows[2].stem.startswith("Mr Green likes")


def test_a_cloze_gives_back_the_penalty_for_short_stems(built_papers):
    rows = built_papers["a_cloze_gives_back_the_penalty_for_short_stems"]
    assert [r.options for r in rows] == [["friend", "doctor", "driver"], ["always", "never", "hardly"]]
    assert all("____26____" in r.material and "题干过短" not in r.flags for r in rows) and [r.confidence for r in rows] == [0.6, 0.7]


def test_prose_after_options_is_a_passage_and_a_heading_ends_it(built_papers):
    rows = built_papers["prose_after_options_is_a_passage_and_a_heading_ends_it"]
    assert [r.material for r in rows] == [None, "\n".join(STORY), None] and rows[0].options[-1] == "Games"


def test_a_labelled_picture_needs_few_words(built_papers):
    rows = built_papers["a_labelled_picture_needs_few_words"]
    assert rows[0].material.startswith("Hi, I am Tom") and rows[0].material_units == [1, 2] and 2 not in rows[0].units


def test_a_chinese_passage_after_an_instruction(built_papers):
    rows = built_papers["a_chinese_passage_after_an_instruction"]
    assert [r.printed for r in rows] == [8, 9] and all(r.material == f"老屋\n{OLD_HOUSE}" for r in rows)


def test_numbers_that_start_again_are_questions(built_papers):
    rows = built_papers["numbers_that_start_again_are_questions"]
    assert [r.printed for r in rows] == [14, 15, 1, 2, 1, 2]
    assert [r.material is not None for r in rows] == [False, False, False, False, True, True] and rows[4].options == ["treasure", "surprise", "holiday"]


def test_a_glued_heading_stays_with_its_options(built_papers):
    rows = built_papers["a_glued_heading_stays_with_its_options"]
    assert rows[0].options[:2] == ["Yes, she is", "No, she isn’t"] and rows[0].material is None and rows[1].material == "\n".join(STORY)


@pytest.mark.parametrize("rows", [
    ["6. What are they talking about?", "A. The doctor. B. A cut. C. The weather.", "【答案】B 【解析】", "【原文】W: Does it hurt?", "It hurts a little, but the nurse has put something on it and I feel so much better now than I did when it happened in the park near our school.", "7. Where are they?"],
    ["45. Which is the correct order of the events?", "a. They saw two dogs having a fight. b. My uncle and I were walking home through the park after dinner.", "c. He stopped the two dogs. d. I called the police and they came to the park very soon after that.", "A. b-d-c-a B. a-b-c-d C. d-b-a-c D. b-a-d-c", "46. What do you know?"],
    ["18. 如图，弧 AC 等于弧 CB。", "【解析】", "【详解】证明：连接$OC$．", ("image", "[图]"), r"$\therefore \left\{\begin{matrix}a+2=b \\ a+b=4\end{matrix}\right.$，$\because EF/\!/MN$ and so on and so forth for a while", "19. 计算"],
    ["17. 某物质常用作阻燃剂。已知：", "I.用酸与氧化物合成该物质，其组成会受温度等条件的影响。", "Ⅱ.该物质受热，先放出水；" + "当温度更高时生成氧化物固体并熔化为玻璃态物质，覆盖在可燃物表面隔绝空气；" * 4 + "这是它的主要用途。", "（1）能阻燃的原因是____。", "18. 下列说法正确的是"],
    ["初三年化学试卷", "（时间：60分钟，满分：100分）", "温馨提示：本学科试卷有两张，" + "请将全部答案填在答题卡的相应答题栏内，否则不能得分。" * 6, "一、选择题", "1. 下列变化属于化学变化的是"],
    ["1. 【此处可播放相关音频】", "A", ("image", "[图]"), "B", ("image", "[图]"), "C", ("image", "[图]"), "2. 【此处可播放相关音频】"],
])
def test_what_is_no_passage(spark, rows):
    assert materials.find_materials(units_of(spark, *rows))[0].count() == 0


def test_papers_are_kept_apart_and_may_be_empty(spark):
    two = units_of(spark, *EXAM).unionByName(units_of(spark, *EXAM[3:12], paper=2))
    rows = built(spark, two, with_materials=True)
    assert [(r.paper, r.question) for r in rows] == [(1, n) for n in range(1, 10)] + [(2, 1), (2, 2)]
    assert built(spark, two.limit(0), with_materials=True) == []


def test_question_part_ends_where_the_inline_answer_begins(spark):
    units = units_of(spark, "1．实数的相反数是（ ）", "A．2 B．-2", "【答案】B", "故选：B", "【答案】不属于题号")
    found = spark.createDataFrame([(1, 1, [0, 1, 2, 3]), (1, 2, [4])], "paper int, question int, units array<int>")
    assert [r.units for r in segment.question_part(found, units).orderBy("question").collect()] == [[0, 1], [4]]


def test_scores_of_a_model_that_fit_the_total_stay(spark):
    sections = segment.heading(spark.createDataFrame([(1, 1, "二、解答题：共 2 题，共 20 分")], "paper int, section int, text string"), "text")
    scored = spark.createDataFrame([(1, 1, 1, "解答题", 8.0, "llm"), (1, 2, 1, "解答题", 12.0, "llm")], "paper int, question int, section int, kind string, score double, score_source string")
    totals = spark.createDataFrame([(1, 100.0)], "paper int, paper_total double")
    rows = segment.infer_scores(scored, sections, totals).orderBy("question").collect()
    assert [(r.score, r.score_source) for r in rows] == [(8.0, "section_total"), (12.0, "section_total")]


def test_documents_that_begin_with_a_decimal_are_no_passages_of_the_query(spark, tmp_path):
    prose = " ".join(["Every word of this line is a plain one."] * 6)
    rows = [(1, f"56.187.231.175 {prose}"), (2, f"3.5 {prose}"), (3, prose), (4, f"1234. {prose}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    kept = sorted(r[0] for r in want.execute(catalog.oracle_sql()["reading_passages"]).fetchall())
    assert sorted(r.doc_id for r in catalog.queries()["reading_passages"](spark, str(tmp_path)).collect()) == kept == [3, 4]


def test_papers_that_span_batches_are_walked_whole(spark):
    """Marks don't depend on how units are cut into batches, with a null paper and one of many units among others."""
    sizes = {None: 7, 1: 3, 2: 40, 3: 1, 4: 12}
    rows = [(paper, seq, "一、选择题" if seq == 0 else f"{seq}．题目{seq}") for paper, size in sizes.items() for seq in range(size)]
    units = spark.createDataFrame(rows, "paper long, seq int, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        got = []
        for most in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            got.append(sorted(map(tuple, segment.segment(units).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1]
    assert {(r[0], r[1]): (r[2], r[5]) for r in got[0]} == {(p, s): (s or None, "start" if s else "section") for p, s, _ in rows}


def test_segmentation_folds_no_struct_by_lambda(spark):
    """Interpreted lambdas over a paper's units were most of the time of segmented_questions at size (F15)."""
    plan = segment.segment(units_of(spark, *EXAM))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "lambda" not in plan


def test_groups_without_units_are_repairs_and_joined_back_to_nothing(spark):
    groups = spark.createDataFrame([(1, 1, []), (1, 2, ["a"]), (1, 3, None), (1, 4, ["b", "a"]), (2, 1, []), (2, 2, None), (2, 3, ["x"]), (2, 4, []), (2, 5, ["a"])], "paper int, group int, units array<string>")
    units = spark.createDataFrame([(p, k, u, True) for p in (1, 2) for k, u in enumerate("ab")], "paper int, seq int, unit string, asked boolean")
    out = segment.repaired_groups(groups, units)
    assert sorted(map(tuple, out.collect())) == [(1, 1, ["a"], False), (1, 2, ["b"], True)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # the units, and how many are asked
