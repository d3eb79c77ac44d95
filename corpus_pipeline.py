"""The corpus pipeline: drop toxic texts and near-duplicates, cut repeats, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.hashfold import fold
from itemloom.llm.mixing import label_domain, mix, resample
from itemloom.llm.packing import pack
from itemloom.llm.simhash import drop_near_duplicates
from itemloom.llm.suffix_dedup import remove_repeats
from itemloom.llm.toxicity import toxicity
from itemloom.llm.workspace import Workspace

#: A document is rejected from this score on.
TOXIC = 0.3
#: Shares of the kept tokens by domain; other domains keep their natural share.
TARGETS = {"poor": 0.05, "toxic": 0.0}
#: Bytes of a repeat: 51 words have more, unless a word with its space has under 4 bytes (it has 6 or 7 on average).
REPEAT = 200


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is under the threshold; the columns ride along, so nothing is joined back."""
    coded = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    labels = _labels(spark, sf_dir).select(F.col("doc_id").alias(key), "toxic")
    scored = toxicity(coded, labels, fold(key, 4) != 2, key, text, keep=coded.columns)
    return scored.where(F.col("score") < TOXIC).select(*coded.columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates, linked by fingerprints (op9's) and by exact similarity."""
    return drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of ``REPEAT`` bytes that stand elsewhere too; a text of which nothing is left goes."""
    more = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = remove_repeats(docs, length=REPEAT, keep=more).where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    back = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    back |= {c: F.col(f"c{i}") for i, c in enumerate(more)} | {"doc_id": F.col("doc_id")}
    return cut.select(*[back[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents by rates that bring poor text down to its target; good text has rate 1."""
    return resample(docs, mix(docs, _labels(spark, sf_dir), label_domain(), TARGETS, budget=None))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all kept documents in windows of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: No stage can be expressed in SQL; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written and read again."""
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
