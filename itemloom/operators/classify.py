"""What a paper's first lines say about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemloom.functions.text import first_filled
from itemloom.operators.schools import clean_school, school_of

# The words by which papers name their stage, grade, kind, year, region and textbook.
GRADES = (
    ("高一", "高中", "高一"), ("高二", "高中", "高二"), ("高三", "高中", "高三"),
    ("初一|七年级", "初中", "初一"), ("初二|八年级", "初中", "初二"), ("初三|九年级", "初中", "初三"),
    ("一年级", "小学", "一年级"), ("二年级", "小学", "二年级"), ("三年级", "小学", "三年级"), ("四年级", "小学", "四年级"), ("五年级", "小学", "五年级"), ("六年级", "小学", "六年级"),
)
STAGE_WORDS = (("高考|高中", "高中"), ("(?<!期)中考|初中", "初中"), ("小学", "小学"))
SUBJECTS = ("道德与法治", "信息技术", "语文", "数学", "英语", "物理", "化学", "生物", "历史", "地理", "政治", "科学")
STAGES = {
    "小学": ("语文", "数学", "英语", "科学", "道德与法治"),
    "初中": ("语文", "数学", "英语", "物理", "化学", "生物", "历史", "地理", "道德与法治"),
    "高中": ("语文", "数学", "英语", "物理", "化学", "生物", "历史", "地理", "政治", "信息技术"),
}
PAPER_TYPES = (
    ("普通高等学校招生|高考", "高考真题"), ("(?<!期)中考|学业水平考试", "中考真题"), ("期中|半期", "期中考试"), ("期末", "期末考试"),
    ("月考|月测|质量检测", "月考"), ("[一二三]模|模拟|适应性", "模拟考试"), ("联考", "联考"), ("单元", "单元测试"),
)
TEXTBOOK = "(人教[AB]?版|北师大版|苏教版|湘教版|沪教版|浙教版|鲁教版|冀教版)"
SCHOOL_YEAR = r"(20\d{2})\s*[—\-–~～至]+\s*(20\d{2})\s*学年"
TERM_AFTER = SCHOOL_YEAR + r"(?s:.*?)(上|下|第一|第二)\s*学期"
PROVINCE = "(?:(?<![一-龥])|(?<=年))(?!年)([一-龥]{2,3}?)(?:省|市|自治区)"
DISTRICT = "(?:省|市)([一-龥]{2,3}?)(?:区|县|市)"
NOT_PLACE = "[的在各本该我全某所城]"
TITLE = "试卷|试题|考试|测试|测验|练习|月考|期中|期末|联考|模拟|检测|真题|押题"
NOT_TITLE = r"^试卷第|共\s*\d+\s*页|注意事项|本试卷"


def first_of(text: Column, rules: tuple) -> Column:
    """The value of the first rule (pattern, value) that the text holds, or the empty string."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(v)) for p, v in rules], F.lit(""))


def title(text: Column) -> Column:
    """The first of eight lines that reads like a paper's name, or the empty string."""
    lines = F.slice(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), 1, 8)
    good = F.filter(lines, lambda x: F.length(x).between(6, 60) & x.rlike(TITLE) & ~x.rlike(NOT_TITLE))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def classify_paper(text: Column, hint: Column | None = None) -> Column:
    """struct(title, stage, grade, subject, paper_type, school_year, region, textbook, school); what isn't said is empty.

    ``hint``, a file's name, is read after the text, for all but the title; a school is looked for in the title first.
    """
    heading = title(text)
    text = text if hint is None else F.when(F.coalesce(hint, F.lit("")) != "", F.concat(text, F.lit("\n"), hint)).otherwise(text)
    t = F.regexp_replace(text, r"(?<=[\u4e00-\u9fff])\s+(?=[\u4e00-\u9fff])", "")
    grade = first_of(t, tuple((p, g) for p, _, g in GRADES))
    stage = first_of(t, tuple((p, s) for p, s, _ in GRADES))
    stage = F.when(stage != "", stage).otherwise(first_of(t, STAGE_WORDS))
    a, b = F.regexp_extract(t, SCHOOL_YEAR, 1), F.regexp_extract(t, SCHOOL_YEAR, 2)
    said = F.regexp_extract(t, TERM_AFTER, 3)
    term = F.when(said.isin("上", "第一"), " 上").when(said.isin("下", "第二"), " 下").otherwise("")
    place = F.try_element_at(F.filter(F.regexp_extract_all(t, F.lit(PROVINCE), 1), lambda x: ~x.rlike(NOT_PLACE)), F.lit(1))
    district = F.regexp_extract(F.substr(t, F.position(place, t)), DISTRICT, 1)
    region = F.when(place.isNull(), "").otherwise(F.concat(place, F.when(district != "", F.concat(F.lit(" · "), district)).otherwise("")))
    return F.struct(
        heading.alias("title"), stage.alias("stage"), grade.alias("grade"), first_of(t, tuple((s, s) for s in SUBJECTS)).alias("subject"), first_of(t, PAPER_TYPES).alias("paper_type"),
        F.when(a != "", F.concat(a, F.lit("—"), b, term)).otherwise("").alias("school_year"), region.alias("region"), F.regexp_extract(t, TEXTBOOK, 1).alias("textbook"),
        clean_school(first_filled(school_of(heading), school_of(hint) if hint is not None else F.lit("")), t).alias("school"),
    )


def consistent(stage: Column, grade: Column, subject: Column, paper_type: Column) -> Column:
    """struct(stage, grade, subject, paper_type) of values that can stand together; a subject outweighs a stage, a stage a grade."""
    known = stage.isin(*STAGES)
    fits = F.coalesce(*[F.when(stage == s, subject.isin(*names)) for s, names in STAGES.items()], F.lit(False))
    stage = F.when(known & ((subject == "") | fits), stage).otherwise("")
    of = F.coalesce(*[F.when(grade == g, F.lit(s)) for _, s, g in GRADES], F.lit("?"))
    grade = F.when((grade != "") & (stage != "") & (of != stage), "").otherwise(grade)
    return F.struct(stage.alias("stage"), grade.alias("grade"), subject.alias("subject"), F.when(paper_type.isin(*[v for _, v in PAPER_TYPES]), paper_type).otherwise("").alias("paper_type"))
