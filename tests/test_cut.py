"""Tables between steps join by the size of their rows, not by that of their files."""

from pyspark.sql import functions as F

from itemloom.operators import evaluate
from itemloom.plans import catalog
from itemloom.sources.tables import cut

FOLDER = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_tables_in_short_files_are_not_broadcast(spark):
    rows = cut(spark.range(400_000).select("id", F.lit("the same words in every row").alias("text"), (F.col("id") % 3).alias("k")))
    met = rows.join(rows.where("k = 0").groupBy(F.col("id")).agg(F.max("text").alias("other")), "id")
    assert "Broadcast" not in plan(met)
    assert met.count() == 133_334


def test_short_tables_still_are(spark):
    rows = cut(spark.range(100).select("id", F.lit("x").alias("text")))
    assert "BroadcastHashJoin" in plan(spark.range(1_000_000).join(rows, "id"))
    assert cut(spark.range(0)).count() == 0


def test_grams_of_answers_are_not_broadcast(spark):
    answer = F.struct(F.concat(F.lit("a longer answer "), F.col("id").cast("string")).alias("answer"))
    pairs = cut(spark.range(50).select(F.col("id").alias("pair"), answer.alias("g"), answer.alias("p")))
    alike = evaluate._answers_alike(pairs)
    assert "Broadcast" not in plan(alike)
    assert {round(r["alike"], 9) for r in alike.collect()} == {1.0}


def test_inferred_scores_reads_its_lines_once(spark):
    out = catalog.queries()["inferred_scores"](spark, FOLDER)
    assert "lineitem.parquet" not in " ".join(out.inputFiles())
