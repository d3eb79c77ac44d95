"""Ordered blocks of text on pages, out of parser output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions.text import strip, unescape_markdown

# What counts as a page number, and block types that are page furniture.
PAGE_NUMBER = r"^\s*(?:(?:试卷|答案|数学|第)?\S{0,4}第\s*\d+\s*页.{0,8}|[-—]\s*\d+\s*[-—]|\d{1,3})\s*$"
FURNITURE = ("header", "footer", "page_number", "aside_text", "page_footnote", "discarded")


def drop_furniture(blocks: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", order: str = "seq") -> DataFrame:
    """Blocks without page numbers and running heads, renumbered.

    A short text (30 characters) on at least two pages, and at least half of its document's, is a running head.
    """
    pages = blocks.groupBy(doc).agg(F.count_distinct(page).alias("__pages"))
    spread = blocks.where(F.length(F.trim(text)) <= 30).groupBy(doc, F.trim(text).alias("__t")).agg(F.count_distinct(page).alias("__n"))
    heads = spread.join(pages, doc).where(F.col("__n") >= F.greatest(F.lit(2), F.col("__pages") / 2)).select(doc, "__t")
    kept = blocks.where(~F.col(text).rlike(PAGE_NUMBER)).withColumn("__t", F.trim(text)).join(heads, [doc, "__t"], "left_anti").drop("__t")
    return kept.withColumn(order, F.row_number().over(Window.partitionBy(doc).orderBy(order)))


def _joined(c: Column) -> Column:
    """A text, or a JSON list's filled items, one to a line."""
    items = F.filter(F.from_json(c, "array<string>"), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.when(F.startswith(F.ltrim(c), F.lit("[")), F.array_join(items, "\n")), c, F.lit(""))


def from_content_list(rows: DataFrame, doc: str, content: str) -> DataFrame:
    """(doc, seq, page, bbox, type, text, image) from a recogniser's JSON list of blocks, furniture dropped.

    Each kind of block keeps its content elsewhere: a title is a text with a level; pictures and charts have captions, tables
    a body or else a caption, lists items, code its own body; anything else has text or content.  Boxes are in
    thousandths; one that is missing or isn't four numbers is the whole page.  A block without text stays only with an image.
    """
    each = rows.select(doc, F.posexplode(F.from_json(content, "array<map<string,string>>")).alias("pos", "b"))
    has = lambda k: F.coalesce(F.col("b")[k], F.lit(""))
    kind = F.coalesce(F.col("b")["type"], F.lit("text"))
    either = lambda a, b: F.when(a != "", a).otherwise(b)
    text = (
        F.when(kind == "text", unescape_markdown(has("text"))).when(kind == "equation", has("text"))
        .when(kind.isin("image", "chart"), either(_joined(has("image_caption")), _joined(has("chart_caption"))))
        .when(kind == "table", either(has("table_body"), _joined(has("table_caption")))).when(kind == "list", unescape_markdown(_joined(has("list_items"))))
        .when(kind == "code", has("code_body")).otherwise(either(has("text"), has("content")))
    )
    level = ~has("text_level").isin("", "0", "false", "null")
    shown = F.when((kind == "text") & level, "title").when(kind == "chart", "image").when(kind.isin("text", "equation", "image", "table"), kind).otherwise("text")
    box = F.from_json(F.col("b")["bbox"], "array<double>")
    unit = F.transform(box, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / 1000)))
    whole = F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    bbox = F.when((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()), unit).otherwise(whole)
    page = F.coalesce(F.col("b")["page_idx"].try_cast("int"), F.lit(0)) + 1
    out = each.where(~kind.isin(*FURNITURE)).select(doc, "pos", page.alias("page"), bbox.alias("bbox"), shown.alias("type"), text.alias("text"), F.nullif(has("img_path"), F.lit("")).alias("image"))
    out = out.where((strip(F.col("text")) != "") | F.col("image").isNotNull())
    return out.select(doc, F.row_number().over(Window.partitionBy(doc).orderBy("pos")).alias("seq"), "page", "bbox", "type", "text", "image")


def as_units(blocks: DataFrame, text: str = "text", kind: str = "type") -> DataFrame:
    """Blocks as lines of a paper: pictures and tables marked, a table's tags as spaces; blocks without any text go."""
    picture = F.concat(F.lit("[图]"), F.when(F.col(text) != "", F.concat(F.lit(" "), F.col(text))).otherwise(""))
    table = strip(F.concat(F.lit("[表] "), F.regexp_replace(text, "<[^>]+>", " ")))
    line = F.when(F.col(kind) == "image", picture).when(F.col(kind) == "table", table).otherwise(F.col(text))
    return blocks.withColumn(text, line).where(F.col(text) != "")


def first_success(rows: DataFrame, outputs: list[str], reasons: list[str]) -> DataFrame:
    """``chosen``: the first parser output that isn't null; ``failed``: the reasons of those before it."""
    before = [F.when(F.coalesce(*[F.col(o) for o in outputs[: k + 1]]).isNull(), F.col(r)) for k, r in enumerate(reasons)]
    return rows.withColumn("chosen", F.coalesce(*map(F.col, outputs))).withColumn("failed", F.array_compact(F.array(*before)))


def fingerprint(files: DataFrame, group: str, order: str, content: str) -> DataFrame:
    """(group, file_hash): SHA-256 of the files' SHA-256 digests (as bytes), in order."""
    each = files.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, F.sha2(F.col(content).cast("binary"), 256).alias("h")))).alias("a"))
    return each.select(group, F.sha2(F.unhex(F.array_join(F.transform("a", lambda x: x["h"]), "")), 256).alias("file_hash"))
