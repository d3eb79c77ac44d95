"""Knowledge points named by a model, held against a subject's tree: only nodes that exist stay, names find theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.operators.similarity import node_matches

# Points a question, candidates a name, the score from which a name is its node, the longest name.
MOST, CANDIDATES, DIRECT, LONGEST = 3, 6, 0.85, 30
NUMBERING = r"^\s*[\d一二三四五六七八九十]+[.、．)）]\s*"
EDGES = "[ ，,；;。]"
REF = "struct<id: string, name: string, path: string, in_tree: boolean>"


def clean_name(name: Column) -> Column:
    """A point's name without its number and outer punctuation."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, NUMBERING, ""), f"^{EDGES}+|{EDGES}+$", ""), 1, LONGEST)


def clean_names(names: Column) -> Column:
    """Distinct cleaned names in their order, without empty ones; null is none."""
    cleaned = F.transform(F.coalesce(names, F.array().cast("array<string>")), clean_name)
    return F.array_distinct(F.filter(cleaned, lambda x: F.coalesce(x, F.lit("")) != ""))


def difficulty(said: Column) -> Column:
    """A number from 0 to 1, to two digits; anything else is null."""
    number = said.try_cast("double")
    return F.when(number.between(0, 1), F.round(number, 2))


def free_ref(subject: Column, name: Column) -> Column:
    """The reference of a point that no tree has; equal names of a subject have one id."""
    key = F.concat(F.lit("kp_"), F.substring(F.md5(F.concat(subject, F.lit(":"), name)), 1, 10))
    return F.struct(key.alias("id"), name.alias("name"), F.lit(None).cast("string").alias("path"), F.lit(False).alias("in_tree")).cast(REF)


def _node_ref() -> Column:
    return F.struct(F.col("node_id").cast("string").alias("id"), F.col("node_name").alias("name"), F.col("path").alias("path"), F.lit(True).alias("in_tree")).cast(REF)


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.col("name").alias("node_name"), "path")


def resolved(named: DataFrame, nodes: DataFrame, subject: Column) -> DataFrame:
    """(key, pos, ref) of (key, pos, name): the node that a name nearly is, or a point outside the tree."""
    best = node_matches(named.select("name").distinct(), nodes, 1, DIRECT).select("name", "node_id")
    met = named.join(best, "name", "left").join(_named(nodes), "node_id", "left")
    return met.select("key", "pos", F.when(F.col("node_id").isNotNull(), _node_ref()).otherwise(free_ref(subject, F.col("name"))).alias("ref"))


def _in_order(refs: DataFrame) -> DataFrame:
    """(key, refs): a key's references by pos, each id at its first place within a kind, at most ``MOST``."""
    first = refs.groupBy("key", "kind", "ref.id").agg(F.min_by("ref", "pos").alias("ref"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("kind", "pos"))
    kept = first.withColumn("r", rank).where(F.col("r") <= MOST)
    return kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ref"))), lambda x: x["ref"]).alias("refs"))


def tag_listed(answers: DataFrame, nodes: DataFrame, subject: Column) -> DataFrame:
    """(key, refs, difficulty): points chosen by number from a whole list of nodes.

    ``answers`` are (key, ids, other, difficulty) as a model gave them; ``nodes`` (node_id, name, aliases, path, at),
    ``at`` being a node's number.  An id must read k and a node's number, and counts once; of ``other`` the first name
    counts and comes last, even if it is a node that was listed.  Null arrays say nothing; a question without any point has none (null), and each key is expected once.
    """
    said = answers.select("key", F.posexplode("ids").alias("pos", "said"))
    number = F.regexp_extract(F.trim("said"), r"^k(\d{1,9})$", 1)
    listed = said.where(number != "").withColumn("at", number.cast("int")).join(nodes.select("node_id", F.col("name").alias("node_name"), "path", F.col("at").cast("int").alias("at")), "at")
    other = answers.select("key", F.lit(0).alias("pos"), F.try_element_at(clean_names(F.col("other")), F.lit(1)).alias("name")).where("name IS NOT NULL")
    refs = listed.select("key", "pos", _node_ref().alias("ref"), F.lit(0).alias("kind")).unionByName(resolved(other, nodes, subject).withColumn("kind", F.lit(1)))
    return answers.select("key", difficulty(F.col("difficulty")).alias("difficulty")).join(_in_order(refs), "key", "left").select("key", "refs", "difficulty")


def candidates(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node_id, pos): nodes near each question's names, ``CANDIDATES`` a name, in the names' order, each once."""
    named = _free(answers)
    near = node_matches(named.select("name").distinct(), nodes, CANDIDATES).select("name", "node_id", "rank")
    met = named.join(near, "name").groupBy("key", "node_id").agg(F.min(F.col("pos") * 100 + F.col("rank")).alias("place"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("place"))
    return met.select("key", "node_id", rank.alias("pos")).where(F.col("pos") <= CANDIDATES * MOST)


def _free(answers: DataFrame) -> DataFrame:
    return answers.select("key", F.posexplode(F.slice(clean_names(F.col("names")), 1, MOST)).alias("pos", "name"))


def tag_retrieved(answers: DataFrame, nodes: DataFrame, subject: Column) -> DataFrame:
    """(key, refs, difficulty): points of a tree too large to list.

    ``answers`` are (key, names, chosen, difficulty): freely given names, and the nodes that the model chose among their
    ``candidates``.  A choice must be a candidate of its own question; without a valid one the names are
    resolved themselves.  A question without names has no points (null).
    """
    allowed = candidates(answers, nodes).select("key", "node_id")
    said = answers.select("key", F.posexplode("chosen").alias("pos", "node_id")).join(allowed, ["key", "node_id"], "left_semi")
    picked = said.join(_named(nodes), "node_id").select("key", "pos", _node_ref().alias("ref"))
    rest = resolved(_free(answers).join(said.select("key").distinct(), "key", "left_anti"), nodes, subject)
    return answers.select("key", difficulty(F.col("difficulty")).alias("difficulty")).join(_in_order(picked.unionByName(rest).withColumn("kind", F.lit(0))), "key", "left").select("key", "refs", "difficulty")
