"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.hashfold import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.suffix_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.toxicity import toxicity

    out = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.quality import measure

    return measure(_table(spark, sf_dir, "documents"), ["doc_id"])


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.lm import score

    # The deleted part is an eighth of the training documents, by another hash of the id.
    out = score(_table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1, F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0)
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.mixing import Mixing, label_domain, mix

    p = Mixing(max_rate=8.0)
    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), label_domain(), {"good": 0.90, "poor": 0.08, "toxic": 0.02}, p=p)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.ivfpq import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.simhash import hex_fingerprint, near_classes

    out = near_classes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.langid import identify

    out = identify(_table(spark, sf_dir, "documents"), fold("doc_id", 5) != 0)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def _planted(key: object, n: int):
    """The contract's rewriting: of a tenth of the documents, words from a on are repetitions of p words."""
    import zlib

    import numpy as np

    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.periodic import most_repeated, periodic_runs

    out = periodic_runs(_table(spark, sf_dir, "documents"), rewrite=_planted).withColumn("best", most_repeated("runs"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.debruijn import remove_passages

    return remove_passages(_table(spark, sf_dir, "documents"), k=50).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemloom.llm.lexical import ranked_search

    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_packing, op4_license_scan, op5_quality_rules, op6_language_model, op7_mixing, op8_nearest, op9_simhash, op10_language_id, op11_periodic_runs, op12_passage_dedup, op13_ranked_search)}
ORACLE_SQL: dict[str, str] = {
    "op12_passage_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM d WHERE len(ws) >= 50),
        keyed AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM w),
        least AS (SELECT k, min(doc_id) AS m FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS places FROM keyed JOIN least USING (k) WHERE m < doc_id GROUP BY doc_id),
        kept AS (SELECT doc_id, ws, places, unnest(CASE WHEN len(ws) > 0 THEN range(1, len(ws) + 1) ELSE [0] END) AS i FROM d LEFT JOIN gone USING (doc_id)),
        stays AS (SELECT doc_id, i, ws[i] AS word FROM kept WHERE i > 0 AND (places IS NULL OR NOT list_contains(places, i))),
        joined AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM stays GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN joined USING (doc_id)
    """,
    "op13_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        long AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
        total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM long),
        found AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY doc_id, term),
        weighed AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, total GROUP BY term, docs),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
            FROM asked JOIN weighed USING (term) JOIN found USING (term) JOIN long USING (doc_id), total GROUP BY item_id, doc_id
        ),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
}
