"""Reading materials of an exam paper: passages that several questions share.

A passage has no number of its own.  It stands after a heading, a label or an instruction and before the next
question, or, as English prose, right after a question that is over.  Whether a unit belongs to one depends on
what came before, so a paper is one fold over its units in the JVM; what a unit looks like by itself is
computed before, and whether a body is a passage is decided after, on all bodies at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions.text import CJK, strip
from itemloom.operators.segment import NOTICE, QUESTION, SECTION

# Patterns and sizes that tell passages from other text in exam papers.
ROMAN_HEAD = r"^\s*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+|(?:I{1,3}|IV|VI{0,3}|IX|X))\s*[.．、]"
PART_HEAD = r"^\s*(?:第\s*[一二三四五六七八九十\d]+\s*(?:节|部分)|(?:Part|Section)\s+[IVX\d]+\b)"
LABEL = r"^\s*(?:(?:[Pp]assage|[Tt]ext)\s*[A-H\d]|[(（]?[A-H][)）]?)\s*$"
INSTRUCTION = r"阅读(?:下面|下列|以下|下文|短文|材料|文章|理解)|完形填空|根据(?:短文|文章|材料|对话)|填入空白处|[Rr]ead the (?:following|passage)"
SCORE_LINE = r"^\s*[（(][^（）()]*分[^（）()]*[)）]\s*$"
PAGE_NOISE = r"^\s*(?:第\s*\d+\s*页|\d+\s*/\s*\d+\s*$)"
ANSWER_BLOCK = r"^\s*(?:【[^】]{1,12}】|故选|故答案为)"
SPEAKER = r"^\s*(?:[—―–-]|[A-Z][a-z]{0,10}\s?[:：]|[a-h1-9]\s*[.．、)）])"
OPTION_IN_TEXT = r"(?m)^\s*[A-D]\s*[.．、]"
OPTION_LINE = r"^[A-H]\s*[.．、]"
HAS_OPTIONS = r"(?<![A-Za-z])[A-D]\s*[.．、]\s*\S"
TWO_OPTIONS = r"(?<![A-Za-z])A\s*[.．、]\s*\S.*?(?<![A-Za-z])B\s*[.．、]\s*\S"
SUB_MARK = r"^(?:（\d+）|\(\d+\)|[⑴-⒇])"
LEAST_CHARS, LEAST_CHARS_WITH_IMAGE, MOST_QUESTIONS = 150, 30, 15
REFUND = 0.3


def is_heading(t: Column) -> Column:
    """Section and part headings; Roman numerals only where they don't begin a sentence or a formula."""
    plain = ~t.rlike(r"[。.]$|\$")
    return (F.length(t) <= 80) & (t.rlike(SECTION) | t.rlike(PART_HEAD) | (t.rlike(ROMAN_HEAD) & plain))


def is_prose(t: Column) -> Column:
    """A longer paragraph of mostly English words, neither options nor dialogue nor derivation."""
    plain = F.regexp_replace(t, r"\$[^$]*\$", "")
    size = F.length(plain)
    letters = size - F.length(F.regexp_replace(plain, "[A-Za-z]", ""))
    words = F.size(F.regexp_extract_all(plain, F.lit("([A-Za-z]{2,})"), 1))
    cjk = size - F.length(F.regexp_replace(plain, CJK, ""))
    fine = (F.length(t) >= 60) & ~t.rlike(OPTION_LINE) & ~t.rlike(SPEAKER) & ~F.contains(t, F.lit("\\"))
    return fine & (size >= 0.9 * F.length(t)) & (words >= 10) & (letters >= 0.6 * size) & (cjk <= 0.08 * size)


def strip_images(t: Column) -> Column:
    """Text without the marks of its pictures, with one line feed for each break."""
    return strip(F.regexp_replace(F.replace(t, F.lit("[图]"), F.lit("")), r"[ \t]*\n[ \t\n]*", "\n"))


def _looks(units: DataFrame, paper: str, seq: str, text: str, kind: str) -> DataFrame:
    """Each unit with what it looks like by itself."""
    t = strip(F.coalesce(text, F.lit("")))
    rows = units.select(F.col(paper).alias("paper"), F.col(seq).cast("long").alias("seq"), F.coalesce(kind, F.lit("text")).alias("type"), F.coalesce(text, F.lit("")).alias("whole"), t.alias("t"))
    t = F.col("t")
    look = F.struct(
        "seq", (F.col("type") == "image").alias("image"), (F.col("type") == "text").alias("plain"), F.regexp_extract(t, QUESTION, 1).try_cast("int").alias("no"),
        F.regexp_extract(t, r"^\s*(\d{1,9})\s*[.．、]", 1).try_cast("int").alias("item"), is_heading(t).alias("heading"), t.rlike(LABEL).alias("label"), t.rlike(SCORE_LINE).alias("scores"),
        ((F.length(t) <= 150) & t.rlike(INSTRUCTION) & ~t.rlike(OPTION_IN_TEXT)).alias("instruction"), t.rlike(INSTRUCTION).alias("instructs"), t.rlike(PAGE_NOISE).alias("noise"), t.rlike(ANSWER_BLOCK).alias("answer"),
        F.contains(F.substring(t, 1, 8), F.lit("原文")).alias("transcript"), t.rlike(OPTION_IN_TEXT).alias("option"), t.rlike(TWO_OPTIONS).alias("two"), t.rlike(HAS_OPTIONS).alias("options"), is_prose(t).alias("prose"),
        t.rlike(SUB_MARK).alias("part"), F.length("whole").alias("size"),
    )
    return rows.select("paper", "whole", look.alias("u"))


def _act(state: Column, u: Column) -> Column:
    """What a unit is, given what came before it."""
    is_open, pending, mode, last, chars = (state[c] for c in ("open", "pending", "mode", "last", "chars"))
    listed = is_open & (u["no"] <= last) & ~u["two"] & (chars >= LEAST_CHARS) & ((u["no"] == 1) | F.array_contains(state["items"], u["no"] - 1))
    question = u["no"].isNotNull() & ~F.coalesce(listed, F.lit(False))
    hint = u["label"] | (pending & u["scores"]) | u["instruction"]
    after = is_open & ~u["label"] & (chars >= LEAST_CHARS)
    return (
        F.when(u["image"], F.when(is_open | pending, "body").otherwise("lead")).when(question, "question").when(u["heading"], "heading")
        .when(hint, F.when(after, "noise").otherwise("anchor")).when(u["noise"], F.when(is_open, "noise").when(pending, "anchor").otherwise("none"))
        .when(u["answer"], "answer").when(is_open & (u["option"] | u["two"]), "given up").when(is_open | pending, "body")
        .when((last > 0) & ~F.coalesce(mode == "transcript", F.lit(False)) & (state["over"] | F.coalesce(mode == "analysis", F.lit(False))) & u["plain"] & u["prose"], "opens").otherwise("none")
    )


def find_materials(units: DataFrame, paper: str = "paper", seq: str = "seq", text: str = "text", kind: str = "type") -> tuple[DataFrame, DataFrame]:
    """(passages, marks): paper, material, text, begin, start, units and removed (seqs); and paper, seq, heading of each unit that is one.

    A passage's text is that of its units but pictures; ``removed`` are the units that don't belong to any question: its
    own, the labels, instructions and page marks around it.  Instructions right after a heading stay, for its scores.
    """
    looks = _looks(units, paper, seq, text, kind)
    rows = looks.groupBy("paper").agg(F.array_sort(F.collect_list("u")).alias("us"))  # bounded by the paper
    none, no = F.lit(None).cast("string"), F.lit(False)
    empty = F.array().cast("array<int>")
    start = F.struct(
        F.lit(0).alias("cand"), no.alias("open"), no.alias("pending"), no.alias("headed"), none.alias("mode"), no.alias("over"), F.lit(0).alias("last"), F.lit(0).alias("chars"), empty.alias("items"),
        F.array().cast("array<struct<cand:int,role:string,headed:boolean,closed:int>>").alias("out"),
    )

    def decided(state: Column, u: Column, act: Column) -> Column:
        is_open, cand = state["open"], state["cand"]
        resets = act.isin("question", "heading", "answer", "given up") | ((act == "anchor") & is_open)
        now = cand + resets.cast("int")
        body = act.isin("body", "opens")
        added = body & ~u["image"]
        chars = F.when(resets, 0).otherwise(state["chars"]) + F.when(added, u["size"]).otherwise(0)
        items = F.when(resets, empty).otherwise(state["items"])
        items = F.when(added & u["item"].isNotNull(), F.array_append(items, u["item"])).otherwise(items)
        headed = F.when(resets, act == "heading").otherwise(state["headed"])
        mode = F.when(act == "answer", F.when(u["transcript"], "transcript").otherwise("analysis")).when(act.isin("question", "heading", "opens") | (act == "anchor") & ~u["noise"], none).otherwise(state["mode"])
        over = F.when(act == "question", u["options"]).when((act == "given up") | ((act == "none") & ~u["noise"] & u["options"]), True).otherwise(state["over"])
        row = F.struct(now.alias("cand"), act.alias("role"), headed.alias("headed"), F.when((act == "question") & is_open, cand).alias("closed"))
        return F.struct(
            now.alias("cand"), F.when(body, True).when(resets, False).otherwise(is_open).alias("open"), F.when(act.isin("heading", "anchor"), True).when(resets, False).otherwise(state["pending"]).alias("pending"), headed.alias("headed"),
            mode.alias("mode"), over.alias("over"), F.when(act == "question", u["no"]).otherwise(state["last"]).alias("last"), chars.alias("chars"), items.alias("items"), F.array_append(state["out"], row).alias("out"),
        )

    # The action is computed once for a step, as the only element of an array.
    step = lambda state, u: F.transform(F.array(_act(state, u)), lambda act: decided(state, u, act))[0]
    folded = rows.select("paper", F.transform("us", lambda u: u["seq"]).alias("seq"), F.aggregate("us", start, step, lambda state: state["out"]).alias("m"))
    marks = folded.select("paper", F.inline(F.arrays_zip("seq", "m"))).select("paper", "seq", "m.*")
    # Pictures right before prose that opens a passage belong to it.
    order = Window.partitionBy("paper").orderBy("seq")
    following = F.first(F.when(F.col("role") != "lead", F.struct("role", "cand")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    marks = marks.withColumn("next", following).withColumn("taken", (F.col("role") == "lead") & F.coalesce(F.col("next.role") == "opens", F.lit(False)))
    marks = marks.withColumn("cand", F.when(F.col("taken"), F.col("next.cand")).otherwise(F.col("cand"))).withColumn("role", F.when(F.col("taken") | (F.col("role") == "opens"), "body").otherwise(F.col("role")))
    closed = marks.where("closed is not null").select("paper", F.col("closed").alias("cand")).distinct()
    each = marks.where("role in ('body', 'anchor', 'noise')").join(looks.select("paper", F.col("u.seq").alias("seq"), "whole", "u"), ["paper", "seq"]).join(closed, ["paper", "cand"])
    is_body, words = F.col("role") == "body", ~F.col("u.image")
    listed = lambda keep, value: F.array_sort(F.collect_list(F.when(keep, value)))
    goes = is_body | (F.col("role") == "noise") | ~(F.col("headed") & F.col("u.instructs"))
    bodies = each.groupBy("paper", "cand").agg(
        F.array_join(F.transform(listed(is_body & words, F.struct("seq", "whole")), lambda x: x["whole"]), "\n").alias("text"), F.max((F.col("role") == "anchor") & F.col("u.label")).alias("label"),
        F.max(is_body & F.col("u.image")).alias("picture"), F.max(is_body & F.col("u.part")).alias("parts"), F.min(F.when(F.col("role") != "noise", F.col("seq"))).alias("begin"), F.max(F.when(is_body, F.col("seq"))).alias("start"),
        listed(is_body, F.col("seq")).alias("units"), listed(goes, F.col("seq")).alias("removed"),
    ).withColumn("text", strip_images(F.col("text")))
    least = F.when(F.col("label") & F.col("picture"), LEAST_CHARS_WITH_IMAGE).otherwise(LEAST_CHARS)
    real = (F.length("text") >= least) & ~F.col("text").rlike(OPTION_IN_TEXT) & ~F.col("text").rlike(NOTICE) & ~F.startswith("text", F.lit("温馨提示")) & ~F.col("parts")
    number = F.row_number().over(Window.partitionBy("paper").orderBy("start")).alias("material")
    passages = bodies.where(real).select(F.col("paper").alias(paper), number, "text", "begin", "start", "units", "removed")
    heads = marks.where("role = 'heading'").select(F.col("paper").alias(paper), "seq")
    return passages, heads


def without_materials(units: DataFrame, passages: DataFrame, paper: str = "paper", seq: str = "seq") -> DataFrame:
    """Units but those that passages have removed."""
    gone = passages.select(F.col(paper), F.explode("removed").alias("__gone"))
    return units.join(gone, (units[paper] == gone[paper]) & (units[seq] == gone["__gone"]), "left_anti")


def attach_materials(found: DataFrame, passages: DataFrame, heads: DataFrame, paper: str = "paper", most: int = MOST_QUESTIONS) -> DataFrame:
    """Questions with material and material_units: of the last passage before them, up to the next heading or passage, at most ``most`` each.

    ``found`` has paper, question, first (its first unit's seq), flags and confidence.  A question without a stem of its
    own, as in a cloze, isn't short any more: the flag goes, and what it cost is given back.
    """
    at = passages.select(paper, F.col("start").alias("at"), F.struct("material", "start").alias("p")).unionByName(heads.select(paper, F.col("seq").alias("at"), F.struct(F.lit(None).cast("int").alias("material"), F.col("seq").alias("start")).alias("p")))
    both = found.select(paper, "question", F.col("first").alias("at"), F.lit(None).cast(at.schema["p"].dataType).alias("p")).unionByName(at.select(paper, F.lit(None).cast(found.schema["question"].dataType).alias("question"), "at", "p"))
    w = Window.partitionBy(paper).orderBy("at", F.col("question").isNotNull())
    met = both.withColumn("p", F.last("p", ignorenulls=True).over(w)).where("question IS NOT NULL AND p.material IS NOT NULL").select(paper, "question", "at", F.col("p.material").alias("material"))
    rank = F.row_number().over(Window.partitionBy(paper, "material").orderBy("at"))
    kept = met.withColumn("r", rank).where(F.col("r") <= most).join(passages.select(paper, "material", F.col("text").alias("passage"), F.col("units").alias("material_units")), [paper, "material"]).select(paper, "question", F.col("passage").alias("material"), "material_units")
    out = found.join(kept, [paper, "question"], "left")
    short = F.col("material").isNotNull() & F.array_contains("flags", "题干过短")
    confidence = F.when(short, F.round(F.least(F.lit(0.99), F.col("confidence") + REFUND), 2)).otherwise(F.col("confidence"))
    return out.withColumn("confidence", confidence).withColumn("flags", F.when(short, F.array_remove("flags", "题干过短")).otherwise(F.col("flags")))
