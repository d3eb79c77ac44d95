"""The bank's life and its views: orders are jobs, their lines drafts, every other one saved."""

from pyspark.sql import functions as F

from itemloom.operators import lifecycle
from itemloom.plans.registry import query
from itemloom.sources.tables import table


def _tables(spark, d):
    """(bank, drafts, jobs): questions whose order's part in the classification has changed since for every fourth order, reviewed where the part number is odd."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    drafts = lines.select((k * 10 + n).alias("draft"), k.alias("job"), F.when(n % 2 == 1, "saved").otherwise("draft").alias("status"), F.concat(F.lit("question "), F.col("p").cast("string")).alias("stem"), "p", "s")
    jobs = table(spark, d, "orders", "o_orderkey", "o_orderpriority").select(F.col("o_orderkey").alias("job"), F.struct(F.when(F.col("o_orderkey") % 6 == 1, "").otherwise(F.col("o_orderpriority")).alias("subject")).alias("meta"), F.col("o_orderpriority").alias("scope"))
    old = drafts.where("status = 'saved'").join(jobs.select("job", F.col("meta.subject").alias("now")), "job")
    odd = F.col("p") % 2 == 1
    bank = old.select(
        F.concat(F.lit("b"), F.col("draft").cast("string")).alias("id"), "job", "draft", F.struct(F.when(F.col("job") % 4 == 0, "before").otherwise(F.col("now")).alias("subject")).alias("meta"), F.when(F.col("p") % 3 == 0, F.col("s") % 5).alias("owner"),
        F.when(odd, F.lit("2024-01-01").cast("date")).alias("reviewed_at"), F.when(odd, F.lit(1)).alias("reviewed_by"), F.concat(F.lit("old "), F.col("stem")).alias("stem"),
    )
    return bank, drafts, jobs


_LINES = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), j AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 1 THEN '' ELSE o_orderpriority END AS subject, o_orderpriority AS scope FROM orders)"


@query(
    f"""WITH {_LINES}, w AS (SELECT k * 10 + n AS draft, k, n, p, s, subject, k % 3 = 0 AND (k % 9 > 0 OR n = 1) AND NOT (n = 2 AND k % 2 = 1) AS saves, k % 3 = 0 AND (k % 9 > 0 OR n = 1) AS touched, n % 2 = 1 AS old FROM l JOIN j USING (k)),
    t AS (SELECT *, max(touched) OVER (PARTITION BY k) AS synced FROM w),
    b AS (SELECT *, CASE WHEN saves OR synced OR k % 4 > 0 THEN subject ELSE 'before' END AS now, p % 2 = 1 AND NOT saves AND NOT (synced AND k % 4 = 0 AND subject <> 'before') AS kept FROM t WHERE (old OR saves) AND k % 5 > 0)
    SELECT draft, coalesce(b.now, '') AS subject, CASE WHEN saves THEN 'question ' || p ELSE 'old question ' || p END AS stem,
    CASE WHEN p % 7 = 0 THEN 77 WHEN old AND p % 3 = 0 THEN s % 5 WHEN saves THEN 42 END AS owner, CASE WHEN p % 7 = 0 THEN CASE WHEN p % 14 = 0 THEN 5 END WHEN kept AND old THEN 1 END AS reviewed_by, CASE WHEN saves OR old THEN 'saved' ELSE 'draft' END AS status FROM b
    UNION ALL SELECT draft, NULL, NULL, NULL, NULL, 'draft' FROM t WHERE NOT ((old OR saves) AND k % 5 > 0)"""
)
def bank_lifecycle(spark, d):
    """Drafts of every third order saved, of a ninth of the orders, whose papers are known, one by force only; reclassified, some papers removed again, some questions reviewed."""
    bank, drafts, jobs = _tables(spark, d)
    k, n = F.col("job"), F.col("draft") % 10
    wanted = drafts.where(k % 3 == 0).select("draft", F.lit(42).cast("long").alias("owner"), ((k % 9 == 0) & (n == 1)).alias("force"))
    twice, known = drafts.where((n == 2) & (k % 2 == 1)).select("draft"), jobs.where(k % 9 == 0).select("job")
    bank, drafts, _ = lifecycle.commit(bank, drafts, jobs, wanted, ["stem"], twice, known)
    bank, drafts = lifecycle.remove_papers(bank, drafts, jobs.where(k % 5 == 0))
    part = F.regexp_extract("stem", r"(\d+)$", 1).cast("long")
    change = bank.withColumn("p", part).where("p % 7 = 0").select("id", F.lit(77).cast("long").alias("to"), (F.col("p") % 14 == 0).alias("approved"), F.lit(5).alias("actor"), F.lit("2024-06-01").cast("date").alias("at"))
    bank = lifecycle.review(bank, change)
    return drafts.select("draft", "status").join(bank.select("draft", "meta.subject", "stem", "owner", "reviewed_by"), "draft", "left").select("draft", "subject", "stem", "owner", "reviewed_by", "status")


@query(
    f"""WITH {_LINES}, q AS (SELECT k, n, CASE WHEN k % 4 = 0 THEN 'before' ELSE subject END AS subject, CASE WHEN p % 3 = 0 THEN s % 5 END AS owner, p % 2 = 1 AS reviewed FROM l JOIN j USING (k) WHERE n % 2 = 1), t AS (SELECT DISTINCT scope AS subject FROM j),
    m AS (SELECT * FROM q WHERE owner = 2 AND reviewed AND subject IN ('1-URGENT', '2-HIGH')), v AS (SELECT k FROM j WHERE coalesce(nullif(subject, ''), scope) IN ('1-URGENT', '2-HIGH'))
    SELECT 'admin' AS role, (SELECT count(*) FROM q) AS bank, (SELECT count(*) FROM j) AS jobs, (SELECT count(*) FROM l) AS drafts, (SELECT count(*) FROM t) AS trees
    UNION ALL SELECT 'leader', (SELECT count(*) FROM q WHERE subject IN ('1-URGENT', '2-HIGH')), (SELECT count(*) FROM v), (SELECT count(*) FROM l WHERE k IN (SELECT k FROM v)), (SELECT count(*) FROM t WHERE subject IN ('1-URGENT', '2-HIGH'))
    UNION ALL SELECT 'member', (SELECT count(*) FROM m), (SELECT count(DISTINCT k) FROM m), (SELECT count(*) FROM m), (SELECT count(DISTINCT subject) FROM m)"""
)
def scoped_view_counts(spark, d):
    """How much of each table an administrator, a leader of two subjects and a member of them see."""
    bank, drafts, jobs = _tables(spark, d)
    trees = jobs.select(F.col("scope").alias("subject")).distinct()
    out = None
    for role, user in (("admin", None), ("leader", 1), ("member", 2)):
        seen = lifecycle.scoped_views(bank, jobs, drafts, trees, role, user, ["1-URGENT", "2-HIGH"])
        counts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in (("bank", seen.bank), ("jobs", seen.jobs), ("drafts", seen.drafts), ("trees", seen.trees))]
        row = counts[0].select(F.lit(role).alias("role"), "bank")
        for c in counts[1:]:
            row = row.crossJoin(F.broadcast(c))  # one row each
        out = row if out is None else out.unionByName(row)
    return out
