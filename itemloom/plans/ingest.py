"""Blocks, tables, segmentation and fingerprints out of raw documents."""

from pyspark.sql import functions as F

from itemloom.functions.maths import clamp_or
from itemloom.functions.text import inline_answer, join_lines, linear_math, loose_json, once, school_bucket, split_options, sub_questions, unescape_markdown
from itemloom.operators import layout, pricing
from itemloom.operators.classify import classify_paper, consistent
from itemloom.operators.schools import school_of
from itemloom.plans.registry import query
from itemloom.sources import blocks
from itemloom.sources.html_tables import read_tables
from itemloom.sources.tables import table


@query()
def page_tables(spark, d):
    """Rows of the tables in raw pages, spans expanded."""
    return read_tables(table(spark, d, "pages", "page_id", "html"), "page_id", "html")


def _lines(spark, d):
    """Lines of documents as blocks, three to a page."""
    each = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return each.withColumn("page", (F.floor(F.col("seq") / 3) + 1).cast("int"))


@query(
    """WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents), b AS (SELECT *, seq // 3 + 1 AS page, trim(text) AS t FROM l),
    h AS (SELECT doc, t FROM b WHERE length(t) <= 30 GROUP BY doc, t HAVING count(DISTINCT page) >= greatest(2, (SELECT max(page) FROM b c WHERE c.doc = b.doc) / 2))
    SELECT doc, count(*) AS kept FROM b WHERE NOT regexp_matches(text, '^\\s*((试卷|答案|数学|第)?[^\\s]{0,4}第\\s*[0-9]+\\s*页.{0,8}|[-—]\\s*[0-9]+\\s*[-—]|[0-9]{1,3})\\s*$') AND NOT EXISTS (SELECT 1 FROM h WHERE h.doc = b.doc AND h.t = b.t) GROUP BY doc"""
)
def page_furniture(spark, d):
    return blocks.drop_furniture(_lines(spark, d)).groupBy("doc").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT conv_id, sha256(unhex(string_agg(sha256(text), '' ORDER BY turn))) AS file_hash FROM conversations GROUP BY 1")
def content_fingerprints(spark, d):
    turns = table(spark, d, "conversations", "conv_id", "turn", "text")
    return blocks.fingerprint(turns, "conv_id", "turn", "text")


_BOX = "SELECT l_orderkey, l_linenumber, (l_partkey % 100) / 100.0::DOUBLE AS x, (l_suppkey % 50) / 50.0::DOUBLE AS y FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber AS page, min(x) AS x0, min(y) AS y0, max(x) + 0.1 AS x1, max(y) + 0.1 AS y1 FROM ({_BOX}) GROUP BY 1, 2")
def page_regions(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    x, y = F.col("l_partkey") % 100 / F.lit(100.0), F.col("l_suppkey") % 50 / F.lit(50.0)
    boxed = rows.select("l_orderkey", F.col("l_linenumber").alias("page"), F.array(x, y, x + 0.1, y + 0.1).alias("bbox"))
    return layout.boxes(boxed, ["l_orderkey"]).select("l_orderkey", "page", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'stem ' || p_name || ' A．only' WHEN 3 THEN 'stem ' || p_name || ' AB．no' ELSE 'stem ' || p_name END AS stem, CASE p_partkey % 4 WHEN 0 THEN 'one|two' WHEN 1 THEN 'one|two|three' WHEN 2 THEN '' ELSE 'x|y|z|w' END AS options, p_brand AS answer, CASE WHEN p_size > 25 THEN p_type END AS analysis FROM part")
def split_texts(spark, d):
    """Options (two to four, or a lone mark that is none) and marked answers cut out of a question's text."""
    k = F.col("p_partkey") % 4
    marks = F.when(k == 0, " A．one  B．two").when(k == 1, " A．one B.two C、three").when(k == 2, " A．only").otherwise(" AB．no A．x B：y C. z D．w")
    text = F.concat(F.lit("stem "), F.col("p_name"), marks, F.lit("【答案】"), F.col("p_brand"), F.when(F.col("p_size") > 25, F.concat(F.lit("【解析】"), F.col("p_type"))).otherwise(""))
    rows = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_type").select("p_partkey", inline_answer(text).alias("a"))
    rows = rows.select("p_partkey", split_options(F.col("a.stem")).alias("s"), "a.answer", "a.analysis")
    return rows.select("p_partkey", "s.stem", F.array_join("s.options", "|").alias("options"), "answer", "analysis")


@query("SELECT p_partkey, (i + 1)::INT AS no, '（' || (i + 1) || '）' || p_name AS part, ((p_size + 5) // n + CASE WHEN i + 1 = n THEN (p_size + 5) % n ELSE 0 END)::BIGINT AS score FROM (SELECT *, 1 + p_partkey % 4 AS n, unnest(range(1 + p_partkey % 4)) AS i FROM part)")
def sub_question_parts(spark, d):
    """One to four parts of a question, its score in equal whole shares with the remainder on the last part."""
    n = 1 + F.col("p_partkey") % 4
    text = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("（"), i.cast("string"), F.lit("）"), F.col("p_name"))), "")
    rows = table(spark, d, "part", "p_partkey", "p_name", "p_size").select("p_partkey", (F.col("p_size") + 5).alias("total"), sub_questions(text).alias("parts"))
    each = rows.select("p_partkey", "total", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "part"))
    share = F.floor(F.col("total") / F.col("n")) + F.when(F.col("i") + 1 == F.col("n"), F.col("total") % F.col("n")).otherwise(0)
    return each.select("p_partkey", (F.col("i") + 1).alias("no"), "part", share.cast("long").alias("score"))


@query(
    """WITH t AS (SELECT *, CASE turn % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'title' WHEN 2 THEN 'discarded' WHEN 3 THEN 'table' WHEN 4 THEN 'list' WHEN 5 THEN 'image' ELSE 'code' END AS k FROM conversations)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, (turn // 2 + 1)::INT AS page, CASE WHEN turn % 5 = 0 THEN 0.0 ELSE greatest(0, least(1, (turn * 40 - 10) / 1000.0::DOUBLE)) END::DOUBLE AS x0, CASE k WHEN 'list' THEN 'text' WHEN 'code' THEN 'text' ELSE k END AS type,
    md5(CASE k WHEN 'table' THEN '<td>' || text || '</td>' WHEN 'list' THEN '(1) _' || chr(10) || text WHEN 'image' THEN 'picture ' || turn ELSE text END) AS content FROM t WHERE k <> 'discarded' AND (trim(text) <> '' OR k IN ('table', 'list', 'image'))"""
)
def content_lists(spark, d):
    """A recogniser's JSON with a kind of block for each of seven turns: one is furniture, boxes reach beyond the page, every fifth has none."""
    turns, turn = table(spark, d, "conversations"), F.col("turn")
    box = F.when(turn % 5 > 0, F.array((turn * 40 - 10).cast("double"), F.lit(20.0), F.lit(900.0), F.lit(1100.0)))
    k = turn % 7
    kind = F.when(k < 2, "text").when(k == 2, "discarded").when(k == 3, "table").when(k == 4, "list").when(k == 5, "image").otherwise("code")
    block = F.struct(
        "turn", kind.alias("type"), F.when(k < 3, F.col("text")).alias("text"), F.when(k == 1, 1).alias("text_level"), F.when(k == 3, F.concat(F.lit("<td>"), "text", F.lit("</td>"))).alias("table_body"), F.when(k == 4, F.array(F.lit("(1) \\_"), F.lit(""), F.col("text"))).alias("list_items"),
        F.when(k == 5, F.array(F.concat(F.lit("picture "), turn.cast("string")))).alias("image_caption"), F.when(k == 6, F.col("text")).alias("code_body"), box.alias("bbox"), F.floor(turn / 2).cast("int").alias("page_idx"),
    )
    lists = turns.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(block))).alias("content"))
    out = blocks.from_content_list(lists, "conv_id", "content")
    return out.select("conv_id", F.col("seq").cast("long").alias("seq"), "page", F.col("bbox")[0].alias("x0"), "type", F.md5("text").alias("content"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'first' WHEN o_orderkey % 3 = 0 THEN 'second' END AS chosen, CASE WHEN o_orderkey % 2 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'no first' ELSE 'no first,no second' END AS failed FROM orders")
def parser_fallback(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders", "o_orderkey").select("o_orderkey", F.when(k % 2 == 0, "first").alias("a"), F.when(k % 3 == 0, "second").alias("b"), F.lit("no first").alias("ra"), F.lit("no second").alias("rb"))
    return blocks.first_success(rows, ["a", "b"], ["ra", "rb"]).select("o_orderkey", "chosen", F.array_join("failed", ",").alias("failed"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x² + ' || p_size || '³ 和 a₁₂' WHEN 1 THEN '$a^{m+k}$ - $\\sqrt{x - ' || p_size || '}$' ELSE '$x^2$ ' || p_name END AS text FROM part")
def linear_formulas(spark, d):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("x^2 + "), size, F.lit("^{3} 和 a_12"))).when(k == 1, F.concat(F.lit("a^(m+k) - √( x - "), size, F.lit(")"))).otherwise(F.concat(F.lit("$x^2$ "), F.col("p_name")))
    return table(spark, d, "part", "p_partkey", "p_size", "p_name").select("p_partkey", linear_math(text).alias("text"))


@query("SELECT p_partkey, '设 ' || p_name || ' is' || chr(10) || 'A．' || p_brand || chr(10) || '（1）' || p_type || '是' || p_size AS text FROM part")
def joined_lines(spark, d):
    lines = F.array(F.concat(F.lit("设 "), F.col("p_name")), F.lit(""), F.lit(" is "), F.concat(F.lit("A．"), F.col("p_brand")), F.concat(F.lit("（1）"), F.col("p_type"), F.lit("是")), F.col("p_size").cast("string"))
    return table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").select("p_partkey", join_lines(lines).alias("text"))


@query(r"SELECT p_partkey, '_' || p_name || '*$a\_b$\.' AS text FROM part")
def unescaped_markdown(spark, d):
    text = F.concat(F.lit("\\_"), F.col("p_name"), F.lit("\\*$a\\_b$\\."))
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", unescape_markdown(text).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS n, least(0.9, greatest(0.1, CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE p_size / 50.0::DOUBLE END)) AS difficulty FROM part")
def tolerant_json(spark, d):
    """Objects in prose or fences, or none at all; numbers out of text, clamped, with a default."""
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.concat(F.lit('Sure: ```json\n{"n": '), F.col("p_size").cast("string"), F.lit("}\n``` done"))).otherwise("nothing here")
    number = F.when(k % 3 == 0, "about half").otherwise((F.col("p_size") / 50).cast("string"))
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", loose_json(text, "n int")["n"].alias("n"), clamp_or(number, 0.1, 0.9, 0.5).alias("difficulty"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '一中' WHEN 1 THEN '一中' WHEN 2 THEN 'other' ELSE 'none' END AS school FROM part")
def school_buckets(spark, d):
    k = F.col("p_partkey") % 4
    school = F.when(k == 0, "厦门第一中学").when(k == 1, "厦门第一中学思明校区").when(k == 2, "厦门第一中学集美分校").otherwise("")
    return table(spark, d, "part", "p_partkey").select("p_partkey", school_bucket(school, {"厦门第一中学": "一中"}, "other", "none").alias("school"))


@query(
    """SELECT o_orderkey, '2023—2024' || CASE WHEN o_orderkey % 2 = 0 THEN ' 上' ELSE ' 下' END AS school_year, CASE o_orderkey % 3 WHEN 0 THEN '高中' WHEN 1 THEN '初中' ELSE '小学' END AS stage, CASE o_orderkey % 3 WHEN 0 THEN '高一' WHEN 1 THEN '初二' ELSE '三年级' END AS grade,
    CASE WHEN o_orderkey % 5 = 0 THEN '物理' ELSE '数学' END AS subject, CASE WHEN o_orderkey % 2 = 0 THEN '期中考试' ELSE '期末考试' END AS paper_type, CASE WHEN o_orderkey % 7 = 0 THEN '福建 · 思明' ELSE '' END AS region, CASE WHEN o_orderkey % 4 = 0 THEN '人教A版' ELSE '' END AS textbook, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 5 = 0 THEN '' ELSE CASE o_orderkey % 3 WHEN 0 THEN '高中' WHEN 1 THEN '初中' ELSE '小学' END END AS checked_stage FROM orders"""
)
def classified_papers(spark, d):
    k = F.col("o_orderkey")
    grade = F.when(k % 3 == 0, "高一").when(k % 3 == 1, "八年级").otherwise("三年级")
    name = F.concat(F.when(k % 7 == 0, "福建省思明区 ").otherwise(""), F.lit("2023-2024学年"), grade, F.when(k % 2 == 0, "第一学期期中").otherwise("下学期期末"), F.when(k % 5 == 0, "物 理").otherwise("数学"), F.lit("试卷"))
    text = F.concat(F.lit("绝密★\n"), name, F.when(k % 4 == 0, "\n人教A版").otherwise(""), F.lit("\n1．题目"))
    rows = table(spark, d, "orders", "o_orderkey").select("o_orderkey", once(classify_paper(text)).alias("m"))
    out = rows.select("o_orderkey", "m.school_year", "m.stage", "m.grade", "m.subject", "m.paper_type", "m.region", "m.textbook")
    return out.withColumn("checked_stage", consistent(F.col("stage"), F.col("grade"), F.col("subject"), F.col("paper_type"))["stage"])


@query("SELECT p_partkey, 'Model-' || p_partkey AS name, (p_size * 1000)::INT AS max_input, p_size / 4.0::DOUBLE AS input, p_size::DOUBLE AS output FROM part UNION ALL SELECT p_partkey, 'Model-' || p_partkey, NULL, p_size / 2.0::DOUBLE, 2.0::DOUBLE * p_size FROM part")
def html_price_tables(spark, d):
    """Two rows of a model, whose name spans both, with a bound in the first; another table names no price."""
    size = F.col("p_size").cast("string")
    cells = lambda *c: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in c], F.lit("</tr>"))
    name = F.concat(F.lit("Model-"), F.col("p_partkey").cast("string"))
    first = F.concat(F.lit("<tr><td rowspan=2>"), name, F.lit("</td><td>0-"), size, F.lit("K</td><td>"), (F.col("p_size") / 4).cast("string"), F.lit(" yuan</td><td>"), size, F.lit("</td></tr>"))
    html = F.concat(F.lit("<h2>Prices</h2><table><tr><th>Model</th><th>Range</th><th>Input price</th><th>Output price</th></tr>"), first, cells(F.lit("more"), (F.col("p_size") / 2).cast("string"), (F.col("p_size") * 2).cast("string")), F.lit("</table><table><tr><td>x</td></tr><tr><td>1</td></tr></table>"))
    pages = table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", html.alias("html"))
    return pricing.table_prices(read_tables(pages, "p_partkey", "html"), "p_partkey")


@query(
    """WITH p AS (SELECT p_partkey, p_size / 4.0::DOUBLE AS a, p_size::DOUBLE AS b, 'model-' || p_partkey AS name FROM part)
    SELECT p_partkey, name, 32000::BIGINT AS max_input, NULL AS mode, a AS input, b AS output, NULL::DOUBLE AS input_offpeak, NULL::DOUBLE AS output_offpeak FROM p UNION ALL SELECT p_partkey, name, 1000000, NULL, a * 2, b * 2, a / 2, b / 2 FROM p
    UNION ALL SELECT p_partkey, 'plus-' || p_partkey, NULL, 'thinking', a, b * 4, NULL, NULL FROM p UNION ALL SELECT p_partkey, 'plus-' || p_partkey, NULL, 'non_thinking', a, b, NULL, NULL FROM p"""
)
def scoped_price_pages(spark, d):
    """A page for each part: tiers by input length, one with busy and idle hours, modes in another table, rows of another scope, and the same model under another region's heading."""
    s = lambda c: c.cast("string")
    row = lambda *c: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x if not isinstance(x, str) else F.lit(x), F.lit("</td>")) for x in c], F.lit("</tr>"))
    a, b, name = F.col("p_size") / 4, F.col("p_size"), F.concat(F.lit("Model-"), s(F.col("p_partkey")))
    dollar = lambda c: F.concat(F.lit("$"), s(c))
    hours = lambda c: F.concat(F.lit("Busy hours: $"), s(c * 2), F.lit("<br>Idle hours: $"), s(c / 2))
    tiers = F.concat(F.lit("<h2>Singapore</h2><table>"), row("Model ID", "Deployment scope", "Input tokens per request", "Input price", "Output price"), row(name, "International", "0&lt;Token≤32K", dollar(a), dollar(b)), row(name, "Global", "0&lt;Token≤64K", "$9", "$9"), row(name, "International", "32K&lt;Token≤1M", hours(a), hours(b)), F.lit("</table>"))
    plus = F.concat(F.lit("plus-"), s(F.col("p_partkey")))
    modes = F.concat(F.lit("<table>"), row("Model ID", "Mode", "Input price", "Output price"), row(plus, "Non-thinking mode", dollar(a), dollar(b)), row(plus, "Thinking mode", dollar(a), dollar(b * 4)), row(plus, "Thinking mode", "$99", "$99"), F.lit("</table>"))
    other = F.concat(F.lit("<h2>Beijing</h2><table>"), row("Model", "Input price", "Output price"), row(name, "$7", "$7"), F.lit("</table>"))
    pages = table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", F.concat(tiers, modes, other).alias("html"))
    return pricing.scoped_prices(read_tables(pages, "p_partkey", "html"), "p_partkey", "Singapore", "International")


@query(
    "SELECT p_partkey, '模型' || p_partkey AS name, 128000::BIGINT AS max_input, p_size * 2.0::DOUBLE AS input, p_size * 4.0::DOUBLE AS output, 1.0::DOUBLE AS cached_input, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS input_offpeak, CASE WHEN p_partkey % 2 = 0 THEN p_size * 2.0::DOUBLE END AS output_offpeak, CASE WHEN p_partkey % 2 = 0 THEN 0.5 END::DOUBLE AS cached_input_offpeak FROM part"
)
def tab_price_pages(spark, d):
    """A page for each part: tables as tabs of regions, of which the second is read; peak and, for even parts, idle hours; batches don't count."""
    s = lambda c: c.cast("string")
    row = lambda *c: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), x if not isinstance(x, str) else F.lit(x), F.lit("</td>")) for x in c], F.lit("</tr>"))
    size, name = F.col("p_size"), F.concat(F.lit("模型"), s(F.col("p_partkey")))
    head = row("模型名称", "条件", "峰谷时段", "推理 输入", "推理输出", "缓存命中")
    idle = F.when(F.col("p_partkey") % 2 == 0, row(name, "输入长度（0, 128k]", "空闲", s(size), s(size * 2), "0.5")).otherwise("")
    second = F.concat(F.lit("<table>"), head, row(name, "输入长度（0, 128k]", "高峰", s(size * 2), s(size * 4), "1"), idle, F.lit("</table>"))
    html = F.concat(F.lit("<h3>按 Token 计费</h3><ul><li>广州</li><li>新加坡</li></ul><table>"), head, row(name, "-", "高峰", "1", "1", "1"), F.lit("</table>"), second, F.lit("<h3>批量推理</h3><table>"), head, row(name, "-", "高峰", "8", "8", "8"), F.lit("</table>"))
    pages = table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", html.alias("html"))
    return pricing.tab_prices(pages, read_tables(pages, "p_partkey", "html"), "p_partkey", "html", "新加坡")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '厦门第一中学' WHEN 1 THEN '厦门湖里实验中学' WHEN 2 THEN '厦门双十中学' || CASE WHEN o_custkey % 2 = 0 THEN '思明' ELSE '海沧' END || '分校' WHEN 3 THEN '厦门莲花中学' ELSE '' END AS school FROM orders")
def schools_of_titles(spark, d):
    """Schools named in the orders' titles as papers name them: by number, with districts, branches and places said twice, or not at all."""
    k = F.col("o_orderkey") % 5
    year = F.concat((F.col("o_orderkey") % 20 + 2005).cast("string"), F.lit("学年高一上学期"))
    name = (
        F.when(k == 0, F.concat(year, F.lit("厦门一中"))).when(k == 1, "厦门市湖里区实验中学2024年").when(k == 2, F.concat(F.lit("福建福建省厦门双十中学"), F.when(F.col("o_custkey") % 2 == 0, "思明").otherwise("海沧"), F.lit("分校")))
        .when(k == 3, "厦门思明区厦门市莲花中学").otherwise(F.concat(year, F.lit("联考")))
    )
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", school_of(F.concat(name, F.lit("期中考试"))).alias("school"))
