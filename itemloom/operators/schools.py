"""School names out of paper titles, in one spelling for each school."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How school names end, what stands before them, districts that give a context, known schools and their other names.
SCHOOL_END = r"中学|小学|学校|附中|[一二三四五六七八九十\d]{1,2}中(?![学考])"
BRANCH = r"[一-龥]{0,8}?(?:附属(?:中学|小学|学校)|分校|校区)"
BRACKETED = r"\s*[（(]([一-龥]{1,8}(?:分校|校区))[）)]"
PREFIX = r"学年度?+|年度?+|届|第[一二]学期|[上下]学期|[一二三四五六七八九]年级|初[一二三]|高[一二三]"
PROVINCE, CITY, DISTRICT = r"^[一-龥]{2,3}?省", r"^([一-龥]{2,3}?)市", r"^([一-龥]{2,3}?)[区县]"
GENERIC = r"^(?:第|实验|[一二三四五六七八九十\d])"
CONTEXT = "厦门|思明区|湖里区|集美区|海沧区|同安区|翔安区"
NON_SCHOOLS = ("义务教育学校", "普通高等学校", "初级中学", "高级中学")
KNOWN = (
    "双十中学", "第一中学", "一中", "第二中学", "二中", "第三中学", "三中", "第六中学", "六中",
    "第九中学", "九中", "第十中学", "十中", "第十一中学", "十一中", "同安第一中学", "同安一中",
    "翔安第一中学", "翔安一中", "槟榔中学", "松柏中学", "湖滨中学", "湖里中学", "集美中学", "大同中学", "诚毅中学",
    "莲花中学", "灌口中学", "上塘中学", "内厝中学", "华侨中学", "外国语学校", "实验中学",
    "湖里实验中学", "尚文实验学校", "金尚中学", "金林湾实验学校", "金鹰学校", "音乐学校",
    "观音山音乐学校", "大学附属科技中学", "五缘实验学校", "五缘第二实验学校",
    "瑞景外国语中学", "瑞景外国语学校", "科技中学", "高新中学",
)
ALIASES = {
    "厦门明区厦门市莲花中学": "厦门莲花中学",
    "厦门湖里五缘第二实验学校": "厦门五缘第二实验学校",
    "厦门第一中学集美分校": "厦门灌口中学",
    "厦门第一中学集美分校(灌口中学)": "厦门灌口中学",
    "厦门灌口中学(厦门一中集美分校)": "厦门灌口中学",
    "厦门双十": "厦门双十中学",
    "厦门外国语": "厦门外国语学校",
    "厦门瑞景外国语学校": "厦门瑞景外国语中学",
    "厦门外国语学校瑞景分校": "厦门瑞景外国语中学",
}
NUMBERED = r"^(厦门(?:同安|翔安)?)(?:第)?([一二三四五六七八九十]{1,3})(?:中学|中)(?=$|[一-龥]{0,8}(?:分校|校区|附属(?:学校|中学|小学)))"


def _places_off(name: Column, city: Column) -> Column:
    """struct(name, city): city and district prefixes taken off, again and again, as often as a name has characters at most.

    A district stays, without its mark, before a name that would be another school's without it.
    """
    start = F.struct(name.alias("name"), city.alias("city"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        in_city, in_district = F.regexp_extract(s["name"], CITY, 1), F.regexp_extract(s["name"], DISTRICT, 1)
        after = lambda x: F.substr(s["name"], F.length(x) + 2)  # noqa: E731  the prefix and its mark
        small = (in_district != "") & (F.length(after(in_district)) >= 3)
        kept = small & after(in_district).rlike(GENERIC)
        new = F.when(in_city != "", F.struct(after(in_city).alias("name"), in_city.alias("city"), F.lit(False).alias("done"))).when(kept, F.struct(F.concat(in_district, after(in_district)).alias("name"), s["city"].alias("city"), F.lit(True).alias("done")))
        new = new.when(small, F.struct(after(in_district).alias("name"), s["city"].alias("city"), F.lit(False).alias("done"))).otherwise(F.struct(s["name"].alias("name"), s["city"].alias("city"), F.lit(True).alias("done")))
        return F.when(s["done"], s).otherwise(new)

    return F.aggregate(F.sequence(F.lit(0), F.length(name)), start, step)


def _one(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


#: Full-width forms of ASCII, and ASCII.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def clean_school(name: Column, context: Column | None = None) -> Column:
    """A school's name in one spelling; empty for what is no school, or nothing.

    Provinces, cities and districts go, but a city that the name itself says; schools of the known list get their city where
    ``context``, a paper's title or region, says it; numbers are written one way; full-width forms are folded; branches and
    attached schools stay schools of their own.
    """
    context = F.coalesce(context, F.lit("")) if context is not None else F.lit("")
    name = F.translate(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", ""), WIDE, NARROW)
    name = F.regexp_replace(name, r"\(([^()中学]{1,8}(?:分校|校区))\)", "$1")
    known = "^(?:" + "|".join(KNOWN) + f")(?:{BRANCH})?$"
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])

    def spelled(n: Column) -> Column:
        n = F.regexp_replace(F.when(F.contains(n, F.lit("厦门")), F.regexp_replace(n, "^(?:福建(?:省)?)+", "")).otherwise(n), PROVINCE, "")
        return _one(n, lambda x: _one(_places_off(F.regexp_replace(x, "^(?:厦门(?:市)?)+", ""), F.when(F.startswith(x, F.lit("厦门")), "厦门").otherwise("")), placed))

    def placed(p: Column) -> Column:
        whole = F.regexp_replace(F.concat(p["city"], p["name"]), "^(?:厦门)+", "厦门")
        prefix = F.when(p["city"] != "", p["city"]).otherwise("厦门")
        return _one(whole, lambda w: F.when(F.when(F.startswith(w, prefix), F.substr(w, F.length(prefix) + 1)).otherwise(w).isin(*NON_SCHOOLS), "").otherwise(named(w)))

    def named(w: Column) -> Column:
        local = F.when(~F.startswith(w, F.lit("厦门")) & context.rlike(CONTEXT) & w.rlike(known), F.concat(F.lit("厦门"), w)).otherwise(w)
        return _one(F.regexp_replace(local, NUMBERED, "$1第$2中学"), lambda n: F.coalesce(aliases[n], n))

    return _one(name, lambda n: F.when(n.isin(*NON_SCHOOLS) | (n == ""), "").otherwise(spelled(n)))


def school_of(title: Column) -> Column:
    """The school that a title names first, or the empty string: a run of characters up to a school's ending, with its branch, without years, terms and grades before it."""
    title = F.coalesce(title, F.lit(""))
    pattern = F.lit(f"([一-龥]+)(?=(?:{BRACKETED})?)")
    runs = F.arrays_zip(F.regexp_extract_all(title, pattern, 1).alias("run"), F.regexp_extract_all(title, pattern, 2).alias("bracket"))

    def name(r: Column) -> Column:
        def whole(core: Column) -> Column:
            branch = F.regexp_extract(F.substr(r["run"], F.length(core) + 1), f"^({BRANCH})", 1)
            more = F.when(branch != "", branch).when(core == r["run"], r["bracket"]).otherwise("")
            return F.regexp_replace(F.concat(core, more), f"^(?:(?:{PREFIX})(?=.))++", "")

        return _one(F.regexp_extract(r["run"], f"^(.*?(?:{SCHOOL_END}))", 1), lambda core: F.when(core == "", "").otherwise(whole(core)))

    names = F.filter(F.transform(runs, name), lambda n: (F.length(n) >= 3) & ~n.isin("初中", "高中"))
    schools = F.filter(F.transform(names, lambda n: clean_school(n, title)), lambda s: s != "")
    return F.coalesce(F.try_element_at(schools, F.lit(1)), F.lit(""))
