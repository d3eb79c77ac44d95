"""Answers of an exam paper: where they stand, and to which question each belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions.text import COMPACT_ANSWERS, NUMBERED_ANSWER, answer_parts, blank_to_null, compact_answers, concluded, join_lines, numbered_parts, once, strip, table_answers
from itemloom.operators.segment import QUESTION
from itemloom.sources.tables import cut


def answer_area(units: DataFrame, marks: DataFrame, paper: str = "paper", seq: str = "seq", text: str = "text") -> DataFrame:
    """(paper, printed, answer, analysis) of the units after an answer heading.

    A unit with ranges of letters answers those numbers and ends what was open; a unit with a number opens
    that number's answer, which the units after it continue.  The last answer given for a number counts.
    """
    order = Window.partitionBy(paper).orderBy("seq")
    area = units.select(F.col(paper), F.col(seq).cast("long").alias("seq"), F.col(text).alias("line")).join(marks.where("role = 'answers'").select(paper, "seq"), [paper, "seq"])
    area = area.withColumn("place", F.row_number().over(order)).where("place > 1")  # the first is the heading
    keys = F.col("line").rlike(COMPACT_ANSWERS)
    number = F.regexp_extract("line", QUESTION, 1).try_cast("int")
    event = F.when(keys, F.struct(F.lit(None).cast("int").alias("no"), F.col("seq").alias("at"))).when(number.isNotNull(), F.struct(number.alias("no"), F.col("seq").alias("at")))
    led = area.withColumn("e", F.last(event, ignorenulls=True).over(order)).withColumn("keys", keys)
    line = F.when(F.col("seq") == F.col("e.at"), F.regexp_replace("line", QUESTION, "")).otherwise(F.col("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    written = led.where("NOT keys AND e.no IS NOT NULL").groupBy(paper, F.col("e.no").alias("printed"), F.col("e.at").alias("at")).agg(join_lines(lines).alias("text"))
    written = written.select(paper, "printed", "at", F.lit(0).alias("nth"), answer_parts(F.col("text")).alias("a"))
    ranges = led.where("keys").select(paper, F.col("seq").alias("at"), F.posexplode(compact_answers(F.col("line"))).alias("nth", "k"))
    ranges = ranges.select(paper, F.col("k.no").alias("printed"), "at", "nth", F.struct(F.col("k.answer").alias("answer"), F.lit(None).cast("string").alias("analysis")).alias("a"))
    last = F.max_by("a", F.struct("at", "nth")).alias("a")
    return written.unionByName(ranges).groupBy(paper, "printed").agg(last).select(paper, "printed", "a.answer", "a.analysis")


def answer_keys(units: DataFrame, paper: str = "paper", seq: str = "seq", text: str = "text", kind: str = "type") -> DataFrame:
    """(paper, printed, in_table, table_answer, numbered): answers out of tables, the last for a number, and out of units that hold several numbered answers, the first."""
    rows = units.select(F.col(paper), F.col(seq).cast("long").alias("seq"), F.col(text).alias("line"), F.coalesce(kind, F.lit("text")).alias("type"))
    table = rows.where("type = 'table'").select(paper, "seq", F.posexplode(table_answers(F.col("line"))).alias("nth", "k"))
    table = table.groupBy(paper, F.col("k.no").alias("printed")).agg(F.max_by("k.answer", F.struct("seq", "nth")).alias("table_answer")).withColumn("in_table", F.lit(True))
    listed = rows.where(F.col("line").rlike(NUMBERED_ANSWER)).select(paper, "seq", F.posexplode(numbered_parts(F.col("line"))).alias("nth", "k"))
    listed = listed.groupBy(paper, F.col("k.no").alias("printed")).agg(F.min_by("k.text", F.struct("seq", "nth")).alias("t")).select(paper, "printed", answer_parts(F.col("t")).alias("numbered"))
    return table.join(listed, [paper, "printed"], "full")


_EVENTS = "array<struct<kind:string,q:int,field:int,no:int,text:string>>"


def _foreign(field: Column, printed: Column, q: Column, which: int) -> Column:
    """The steps by which one text gives away its parts for other numbers; none if it has none."""
    nos = F.transform(F.regexp_extract_all(field, F.lit(NUMBERED_ANSWER), 1), lambda x: x.cast("int"))
    texts = F.split(field, NUMBERED_ANSWER)
    event = lambda kind, no, text: F.struct(F.lit(kind).alias("kind"), q.alias("q"), F.lit(which).alias("field"), no.alias("no"), text.alias("text"))
    none, nothing = F.lit(None).cast("int"), F.lit(None).cast("string")
    parts = F.transform(F.arrays_zip(nos.alias("n"), F.slice(texts, 2, 10_000).alias("t")), lambda x: event("part", x["n"], x["t"]))
    steps = F.concat(F.array(event("open", none, texts[0])), parts, F.array(event("close", none, nothing)))
    return F.when(F.exists(nos, lambda n: ~n.eqNullSafe(printed)), steps).otherwise(F.array().cast(_EVENTS))


def distribute(found: DataFrame, paper: str = "paper") -> DataFrame:
    """Hands parts of answers and analyses that are marked with another question's number to that question, if its own is still empty.

    What has no taker stays.  One text after the other, the answer before the analysis, in the questions' order: a
    fold over the steps of the papers that have any.
    """
    q = F.row_number().over(Window.partitionBy(paper).orderBy("question")) - 1
    rows = cut(found.withColumn("__q", q))  # read three times
    marked = F.coalesce(F.col("answer").rlike(NUMBERED_ANSWER), F.lit(False)) | F.coalesce(F.col("analysis").rlike(NUMBERED_ANSWER), F.lit(False))
    papers = rows.where(marked).select(paper).distinct()
    steps = F.concat(_foreign(F.coalesce("answer", F.lit("")), F.col("printed"), F.col("__q"), 0), _foreign(F.coalesce("analysis", F.lit("")), F.col("printed"), F.col("__q"), 1))
    state = F.struct(F.col("__q").alias("q"), F.col("printed").alias("printed"), blank_to_null(F.col("answer")).alias("answer"), blank_to_null(F.col("analysis")).alias("analysis"))
    each = rows.join(papers, paper, "left_semi").withColumn("__steps", once(steps))
    grouped = each.groupBy(paper).agg(F.array_sort(F.collect_list(F.struct("__q", state.alias("s"), "__steps"))).alias("qs"))  # bounded by the paper
    grouped = grouped.select(paper, F.transform("qs", lambda x: x["s"]).alias("s"), F.flatten(F.transform("qs", lambda x: x["__steps"])).alias("steps"))
    start = F.struct(F.col("s").alias("qs"), F.array().cast("array<string>").alias("own"))

    def step(now: Column, e: Column) -> Column:
        takers = F.filter(now["qs"], lambda x: x["printed"] == e["no"])
        taker = F.try_element_at(takers, F.lit(-1))
        has = F.when(e["field"] == 0, taker["answer"]).otherwise(taker["analysis"])
        given = (e["kind"] == "part") & taker.isNotNull() & (taker["q"] != e["q"]) & has.isNull()
        kept = F.filter(F.transform(now["own"], strip), lambda t: t != "")
        parts = answer_parts(strip(e["text"]))

        def changed(x: Column) -> Column:
            takes, closes = given & (x["q"] == taker["q"]), (e["kind"] == "close") & (x["q"] == e["q"])
            rest = blank_to_null(F.array_join(kept, "\n"))
            answer = F.when(takes & (e["field"] == 0), parts["answer"]).when(closes & (e["field"] == 0), rest).otherwise(x["answer"])
            analysis = F.when(takes & (e["field"] == 0), F.coalesce(x["analysis"], parts["analysis"])).when(takes, blank_to_null(strip(e["text"]))).when(closes & (e["field"] == 1), rest).otherwise(x["analysis"])
            return F.struct(x["q"].alias("q"), x["printed"].alias("printed"), answer.alias("answer"), analysis.alias("analysis"))

        own = F.when(e["kind"] == "open", F.array(e["text"])).when((e["kind"] == "part") & ~F.coalesce(given, F.lit(False)), F.array_append(now["own"], e["text"])).otherwise(now["own"])
        return F.struct(F.transform(now["qs"], changed).alias("qs"), own.alias("own"))

    done = grouped.select(paper, F.explode(F.aggregate("steps", start, step, lambda now: now["qs"])).alias("x")).select(paper, F.col("x.q").alias("__q"), F.col("x.answer").alias("__answer"), F.col("x.analysis").alias("__analysis"), F.lit(True).alias("__done"))
    met = rows.join(done, [paper, "__q"], "left")
    pick = lambda c: F.when(F.col("__done"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return met.select(*[pick(c) if c in ("answer", "analysis") else F.col(c) for c in found.columns])


def finalize(found: DataFrame, units: DataFrame, paper: str = "paper", **names: str) -> DataFrame:
    """Questions with answers handed over by number, then, only where one is still missing, from tables, numbered units and what the analysis concludes."""
    met = distribute(found, paper).join(answer_keys(units, paper, **names), [paper, "printed"], "left")
    empty = blank_to_null(F.col("answer")).isNull()
    numbered = empty & F.col("in_table").isNull() & F.col("numbered").isNotNull()
    answer = F.when(empty & F.col("in_table"), F.col("table_answer")).when(numbered, F.col("numbered.answer")).otherwise(F.col("answer"))
    analysis = F.when(numbered, F.coalesce(blank_to_null(F.col("analysis")), F.col("numbered.analysis"))).otherwise(F.col("analysis"))
    met = met.withColumns({"answer": answer, "analysis": analysis})
    met = met.withColumn("answer", F.coalesce(blank_to_null(F.col("answer")), concluded(F.col("analysis"))))
    return met.select(*found.columns)
