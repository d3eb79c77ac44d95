"""Text functions as Column expressions; only Unicode compatibility folding needs Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The marks and words that exam papers use.
OPTION_LETTERS = "ABCDEFGH"
TERM_PATTERN = r"\d{4}\s*(上|下)|(上|下)(?:学期|册)"
YEAR_PATTERN = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
MATH_SPAN = r"(\$\$[\s\S]+?\$\$|\$[^$\n]+?\$)"
MARKDOWN_ESCAPE = r"\\([_*#`~|<>\[\]])"
ANSWER_BLANK = r"_{3,}|＿{2,}|—{3,}"
BLANKS = r"_{2,}|＿+|—{2,}|（\s*）|\(\s*\)"
TEX_COMMAND = r"\\[a-zA-Z]+"
INLINE_MARK = r"【\s*(答案|解析|详解|分析|点睛|点评)\s*】"
COMPACT_ANSWERS = r"(\d{1,3})\s*[-~—–至]\s*(\d{1,3})\s*[:：.．]?\s*([A-H](?:[\s,，、]*[A-H])+)"
TABLE_ANSWERS = r"题号\s+((?:\d{1,3}\s+)+)(?:选项|答案)\s+((?:[A-H]{1,4}(?:\s+|$))+)"
NUMBERED_ANSWER = r"[【\[]\s*第?\s*(\d{1,3})\s*题\s*(?:答案|解析|详解)?\s*[】\]]"
CHOICE_ANSWER = r"^\s*([A-H](?:\s*[,，、]?\s*[A-H]){0,7})(?![A-Za-z])\s*+[.．。;；,，]?+\s*+(?![A-Za-z])"
CHOSEN = r"故选\s*[:：]?\s*([A-H](?:\s*[,，、]?\s*[A-H]){0,7})(?![A-Za-z])"
FINAL_ANSWER = r"故答案为\s*[:：]\s*(.+?)\s*(?:[.。](?=\s|$|【)|\n|$)"
NEW_LINE = r"^(?:（\d+）|\(\d+\)|[⑴-⒇]|[A-H]\s*[.．、]|\$\$|\[图\])"
CJK = r"[\u3000-\u303f\u4e00-\u9fff\uff00-\uffef]"
SUPERSCRIPTS = ("0123456789+-−=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁻⁼⁽⁾ⁿⁱ")
SUBSCRIPTS = ("0123456789+-−=()aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉₊₋₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ")
LINEAR_SUP = r"(?<=[A-Za-z0-9)\]}])\^(?:\{([^{}$]+)\}|\(([^()$]+)\)|(-?\d+)|([A-Za-z]))"
LINEAR_SUB = r"(?<=[A-Za-z])_(?:\{([^{}$]+)\}|(\d+)|([a-z]))(?![A-Za-z0-9_])"
LINEAR_ROOT = r"√\(\s*([A-Za-z0-9 +\-*/.,]+?)\s*\)"


def blank_to_null(c: Column) -> Column:
    """Empty strings count as missing."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends, line feeds and wide spaces included."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2002\u2003\u2009\u3000"))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, or else the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition; ASCII text, which it never changes, isn't sent to Python."""

    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)

    ascii_ = c.rlike(r"^\p{ASCII}*$")
    return F.when(ascii_, c).otherwise(F.pandas_udf(fold, StringType())(F.when(~ascii_, c)))


def normalize(c: Column, fold_width: bool = True) -> Column:
    """What two wordings of one question have in common.

    Folds full-width and other compatibility forms (``fold_width``), drops answer blanks, empty brackets, TeX
    commands, white space, math delimiters and punctuation, and folds case.
    """
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(nfkc(c) if fold_width else c, BLANKS, "")
    c = F.regexp_replace(c, TEX_COMMAND, "")
    c = F.regexp_replace(c, r"(?U)[\s$\\{}]", "")
    return F.regexp_replace(F.lower(c), r"\p{P}", "")


def normal_text(text: str) -> str:
    """``normalize`` of one text, for parameters of a query."""
    text = re.sub(r"[\s$\\{}]", "", re.sub(TEX_COMMAND, "", re.sub(BLANKS, "", unicodedata.normalize("NFKC", text or "")))).lower()
    return "".join(x for x in text if unicodedata.category(x)[0] != "P")


def once(c: Column) -> Column:
    """A barrier for use in select(): one row per row, with ``c`` computed before anything that reads it.

    Without it the optimiser may inline an expensive text expression into every element of a later
    higher-order function.
    """
    return F.explode(F.array(c))


def grams(c: Column) -> Column:
    """All bigrams and trigrams with repetition; a single character is its own gram, no text has none."""
    n = F.length(c)
    windows = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.when(n == 1, F.array(c)).otherwise(F.concat(windows(2), windows(3)))


def province(region: Column) -> Column:
    """First level of a region such as ``A · B``."""
    return F.element_at(F.split(F.trim(F.coalesce(region, F.lit(""))), r"\s*[·•/]\s*"), 1)


def years(*texts: Column) -> Column:
    """All four-digit years, each not part of a longer number."""
    return F.concat(*[F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(YEAR_PATTERN), 1), lambda y: y.cast("int")) for t in texts])


def year_matches(found: Column, condition: str) -> Column:
    """``2025``: that year is among those found; ``<2025``: the least is before it.  No years: false."""
    if condition.startswith("<"):
        return F.coalesce(F.array_min(found) < int(condition[1:]), F.lit(False))
    return F.array_contains(found, int(condition))


def term(school_year: Column, title: Column) -> Column:
    """Term mark in the school year or title, or the empty string."""
    text = F.concat_ws(" ", F.coalesce(school_year, F.lit("")), F.coalesce(title, F.lit("")))
    return first_filled(F.regexp_extract(text, TERM_PATTERN, 1), F.regexp_extract(text, TERM_PATTERN, 2))


def estimate_tokens(c: Column) -> Column:
    """One token for a CJK character, one for every four others begun."""
    cjk = F.length(F.regexp_replace(c, r"[^一-鿿]", ""))
    return (cjk + F.ceil((F.length(c) - cjk) / 4)).cast("long")


def answer_letters(c: Column) -> Column:
    """Sorted distinct option letters of an answer."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit("([A-H])"), 1))), "")


def stable_id(*parts: Column, size: int = 10) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, size)


def loose_json(c: Column, schema: str) -> Column:
    """A JSON object out of prose or a fenced block; null if there is none."""
    return F.from_json(blank_to_null(F.regexp_extract(c, r"(?s)(\{.*\})", 1)), schema)


def _option_pattern() -> str:
    mark = r"(?<![A-Za-z0-9]){}\s*[.．、:：]"
    tail = ""
    for letter in reversed(OPTION_LETTERS[1:]):
        tail = f"(?:{mark.format(letter)}(.*?){tail})?"
    return f"(?s)^(.*?){mark.format('A')}(.*?){tail}$"


def split_options(c: Column) -> Column:
    """struct(stem, options): options A to H in sequence; fewer than two are none and leave the text whole."""
    pattern = _option_pattern()
    marks = [F.regexp_extract(c, pattern, k + 2) for k in range(len(OPTION_LETTERS))]
    has = lambda k: F.regexp_like(c, F.lit(_option_pattern_for(k)))
    tidy = lambda x: strip(F.regexp_replace(x, r"\s+", " "))
    options = F.filter(F.array(*[F.when(has(k), tidy(m)) for k, m in enumerate(marks)]), lambda x: x.isNotNull())
    two = has(1)
    return F.struct(F.when(two, strip(F.regexp_extract(c, pattern, 1))).otherwise(c).alias("stem"), F.when(two, options).otherwise(F.array().cast("array<string>")).alias("options"))


def _option_pattern_for(last: int) -> str:
    """Matches if the marks up to number ``last`` stand in sequence."""
    return "(?s)" + ".*?".join(rf"(?<![A-Za-z0-9]){x}\s*[.．、:：]" for x in OPTION_LETTERS[: last + 1])


def inline_answer(c: Column) -> Column:
    """struct(stem, answer, analysis) from 【答案】 and 【解析】-like marks; parts that aren't there are null."""
    mark = INLINE_MARK
    kinds = F.regexp_extract_all(c, F.lit(mark), 1)
    parts = F.transform(F.slice(F.split(c, mark), 2, 1000), strip)
    pairs = F.arrays_zip(kinds.alias("kind"), parts.alias("part"))
    joined = lambda keep: blank_to_null(F.array_join(F.filter(F.transform(F.filter(pairs, keep), lambda p: p["part"]), lambda x: x != ""), "\n"))
    return F.struct(F.element_at(F.split(c, mark), 1).alias("stem"), joined(lambda p: p["kind"] == "答案").alias("answer"), joined(lambda p: p["kind"] != "答案").alias("analysis"))


def compact_answers(c: Column) -> Column:
    """array<struct(no, answer)> from keys such as ``1-5 ACBDA``; ranges whose length differs are dropped."""
    columns = [F.regexp_extract_all(c, F.lit(COMPACT_ANSWERS), k) for k in (1, 2, 3)]
    ranges = F.transform(F.arrays_zip(columns[0].alias("a"), columns[1].alias("b"), columns[2].alias("s")), lambda r: F.struct(r["a"].cast("int").alias("a"), r["b"].cast("int").alias("b"), F.regexp_replace(r["s"], "[^A-H]", "").alias("s")))
    fits = F.filter(ranges, lambda r: (r["b"] >= r["a"]) & (F.length(r["s"]) == r["b"] - r["a"] + 1))
    return F.flatten(F.transform(fits, lambda r: F.transform(F.sequence(r["a"], r["b"]), lambda n: F.struct(n.alias("no"), F.substring(r["s"], n - r["a"] + 1, F.lit(1)).alias("answer")))))


def sub_questions(c: Column) -> Column:
    """Parts at the marks （1）, (2), ⑴ ...; text before the first mark is its own part."""
    return F.filter(F.transform(F.split(c, r"(?=（\d+）|\(\d+\)|[⑴-⒇])"), strip), lambda x: x != "")


def unescape_markdown(c: Column) -> Column:
    """Drops the backslashes by which Markdown keeps its own marks plain; what stands in formulas stays."""
    plain = F.transform(F.split(c, MATH_SPAN, -1), lambda x: F.regexp_replace(x, MARKDOWN_ESCAPE, "$1"))
    parts = F.zip_with(plain, F.regexp_extract_all(c, F.lit(MATH_SPAN), 1), lambda x, m: F.concat(F.coalesce(x, F.lit("")), F.coalesce(m, F.lit(""))))
    return F.array_join(parts, "")


def school_bucket(school: Column, labels: dict[str, str], other: str, unclassified: str) -> Column:
    """Display name of a listed school, its campuses included; else ``other``, or ``unclassified`` if empty."""
    base = F.regexp_replace(school, r"(中学|学校)[一-龥]{1,4}校区$", "$1")
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.lit(None).cast("map<string,string>")
    return F.when(F.coalesce(school, F.lit("")) == "", unclassified).otherwise(F.coalesce(known[base], F.lit(other)))


def table_answers(c: Column) -> Column:
    """array<struct(no, answer)> from answer tables read as text; rows whose lengths differ are dropped."""
    nos, letters = (F.transform(F.regexp_extract_all(c, F.lit(TABLE_ANSWERS), k), lambda x: F.split(F.trim(x), r"\s+")) for k in (1, 2))
    rows = F.filter(F.arrays_zip(nos.alias("n"), letters.alias("a")), lambda r: F.size(r["n"]) == F.size(r["a"]))
    return F.flatten(F.transform(rows, lambda r: F.zip_with(r["n"], r["a"], lambda n, a: F.struct(n.cast("int").alias("no"), a.alias("answer")))))


def numbered_parts(c: Column) -> Column:
    """array<struct(no, text)>: what follows each mark such as 【3 题答案】, if there are two marks or more; empty parts go."""
    nos = F.regexp_extract_all(c, F.lit(NUMBERED_ANSWER), 1)
    parts = F.transform(F.slice(F.split(c, NUMBERED_ANSWER), 2, 1000), strip)
    rows = F.filter(F.zip_with(nos, parts, lambda n, t: F.struct(n.cast("int").alias("no"), t.alias("text"))), lambda r: r["text"] != "")
    return F.when(F.size(nos) > 1, rows).otherwise(F.filter(rows, lambda _: F.lit(False)))


def answer_parts(c: Column) -> Column:
    """struct(answer, analysis) of one question's answer text: marked parts, leading option letters, or all of it."""
    marked = inline_answer(c)
    letters = F.regexp_replace(F.regexp_extract(c, CHOICE_ANSWER, 1), "[^A-H]", "")
    rest = blank_to_null(strip(F.regexp_replace(c, CHOICE_ANSWER, "")))
    has = marked["answer"].isNotNull() | marked["analysis"].isNotNull()
    return F.struct(F.when(has, marked["answer"]).when(letters != "", letters).otherwise(blank_to_null(strip(c))).alias("answer"), F.when(has, marked["analysis"]).when(letters != "", rest).alias("analysis"))


def concluded(analysis: Column) -> Column:
    """The answer that an analysis ends with: the option it chooses, or else what it states; null if neither."""
    chosen = F.regexp_replace(F.regexp_extract(analysis, CHOSEN, 1), "[^A-H]", "")
    return F.coalesce(blank_to_null(chosen), blank_to_null(strip(F.regexp_extract(analysis, FINAL_ANSWER, 1))))


def join_lines(lines: Column) -> Column:
    """Lines as one text: marks of parts and options begin a new line, CJK neighbours touch, others get a space."""

    def add(text: Column, line: Column) -> Column:
        breaks = line.rlike(NEW_LINE) | F.endswith(text, F.lit("$$"))
        touch = F.substring(text, -1, 1).rlike(CJK) | F.substring(line, 1, 1).rlike(CJK)
        return F.when(text == "", line).otherwise(F.concat(text, F.when(breaks, "\n").when(touch, "").otherwise(" "), line))

    kept = F.filter(F.transform(lines, strip), lambda x: x != "")
    return F.aggregate(kept, F.lit(""), add)


def _scripts(c: Column, pattern: str, groups: int, table: tuple[str, str], mark: str) -> Column:
    """``c`` with what the pattern's groups capture as raised or lowered characters, or else as TeX with its base."""
    bodies = F.transform(F.arrays_zip(*[F.regexp_extract_all(c, F.lit(pattern), k + 1).alias(f"g{k}") for k in range(groups)]), lambda z: F.replace(F.concat(*[z[f"g{k}"] for k in range(groups)]), F.lit(" "), F.lit("")))
    parts = F.split(c, pattern, -1)
    pairs = F.zip_with(bodies, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda b, t: F.struct(b.alias("b"), t.alias("t")))
    simple = "^[" + re.escape(table[0]) + "]*$"

    def add(text: Column, x: Column) -> Column:
        base = F.regexp_extract(text, r"([A-Za-z0-9)\]])$", 1)
        tex = F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(base)), F.lit("$"), base, F.lit(mark + "{"), F.replace(x["b"], F.lit("−"), F.lit("-")), F.lit("}$"))
        return F.concat(F.when(x["b"].rlike(simple), F.concat(text, F.translate(x["b"], *table))).otherwise(tex), x["t"])

    return F.aggregate(pairs, F.element_at(parts, 1), add)


def linear_math(c: Column) -> Column:
    """Powers, indices and roots that are written on the line; text with TeX in it stays."""
    roots = F.regexp_replace(c, LINEAR_ROOT, r"\$\\sqrt{$1}\$")
    return F.when(F.contains(c, F.lit("$")), c).otherwise(_scripts(_scripts(roots, LINEAR_SUP, 4, SUPERSCRIPTS, "^"), LINEAR_SUB, 3, SUBSCRIPTS, "_"))


def answers_equal(choice: Column, gold: Column, pred: Column, lexical: Column, normal_gold: Column, normal_pred: Column) -> Column:
    """Choice answers by their letters; others equal when normalised, or nine tenths similar; an empty one never is."""
    letters = lambda c: F.regexp_replace(F.upper(c), "[^A-H]", "")
    same = F.when(choice, letters(gold) == letters(pred)).otherwise((normal_gold == normal_pred) | (F.coalesce(lexical, F.lit(0.0)) >= 0.9))
    return F.coalesce(same, F.lit(False)) & (F.coalesce(pred, F.lit("")) != "")
