"""Nearest vectors of a stated set of queries: all rows in blocks, and recall by sign bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions.maths import sign_bits, usable_vector

#: Rows and queries that meet in one task.
ROWS, QUERIES = 20_000, 4_000
_STEP = 128


def _share(rows: DataFrame, groups: list[str], most: int, name: str) -> DataFrame:
    """(groups, name): into how many parts of about ``most`` rows a group is cut; only groups that need more than one."""
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*groups, F.ceil(F.col("n") / most).alias(name))


def in_blocks(asked: DataFrame, have: DataFrame, value: Column, same: list[str], rows: int = ROWS, queries: int = QUERIES) -> tuple[DataFrame, DataFrame, list[str]]:
    """Queries (kq, v) and rows (kr, v) with the columns by which they meet, ``value`` as "x" instead of "v".

    Each row comes once for each part of its group's queries, each query once for each part of its group's rows, so that every pair meets once.
    """
    a, b = (df.withColumns({"size": F.size("v"), "x": value}).drop("v") for df in (asked, have))
    groups = [*same, "size"]
    blocks, parts = _share(b, groups, rows, "blocks"), _share(a, groups, queries, "parts")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        counted = df.join(blocks, groups, "left").join(parts, groups, "left")
        mine, theirs = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        each = counted.withColumn(f"{own}_at", F.pmod(F.xxhash64(key), mine)).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0).cast("long"), theirs.cast("long") - 1)))
        return each.drop("blocks", "parts")

    return dealt(a, "kq", "parts", "blocks"), dealt(b, "kr", "blocks", "parts"), [*groups, "blocks_at", "parts_at"]


def _met(asked: DataFrame, have: DataFrame, value: Column, same: list[str], rows: int = ROWS, queries: int = QUERIES) -> tuple[DataFrame, list[str]]:
    """Queries and rows side by side in one table, a query without "kr" and a row without "kq"."""
    a, b, by = in_blocks(asked, have, value, same, rows, queries)
    a, b = a.withColumn("kr", F.lit(None).cast(have.schema["kr"].dataType)), b.withColumn("kq", F.lit(None).cast(asked.schema["kq"].dataType))
    return a.unionByName(b), by


def _usable(rows: DataFrame, key: str, name: str, vector: str, same: list[str]) -> DataFrame:
    return rows.where(usable_vector(F.col(vector))).select(F.col(key).alias(name), F.col(vector).alias("v"), *same)


def _kept(values: np.ndarray, k: int, slack: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of values: the places of those at most ``slack`` under its k-th largest."""
    for i, row in enumerate(values):
        least = -np.inf if len(row) <= k else np.partition(row, len(row) - k)[len(row) - k]
        yield i, np.flatnonzero((row >= least - slack) & (row > -np.inf))


def nearest(asked: DataFrame, have: DataFrame, key_a: str, key_b: str, vector: str, same: list[str], k: int) -> DataFrame:
    """(kq, kr, cos): each query's ``k`` nearest rows of equal ``same`` columns, and those within a rounding of the last.

    Vectors of other sizes don't meet; those that aren't finite or have no length take no part, nor does a query's own key.
    """
    met, by = _met(_usable(asked, key_a, "kq", vector, same), _usable(have, key_b, "kr", vector, same), F.col("v").cast("array<double>"), same)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        q, r = group[group["kr"].isna()], group[group["kr"].notna()]
        found = []
        if len(q) and len(r):
            theirs, keys, own = np.stack(r["x"].to_numpy()), r["kr"].to_numpy(), q["kq"].to_numpy()
            theirs = theirs / np.sqrt((theirs * theirs).sum(axis=1))[:, None]
            for at in range(0, len(q), _STEP):
                mine = np.stack(q["x"].to_numpy()[at : at + _STEP])
                cos = mine @ theirs.T / np.sqrt((mine * mine).sum(axis=1))[:, None]
                cos[own[at : at + _STEP, None] == keys[None, :]] = -np.inf
                found += [(own[at + i], key, value) for i, place in _kept(cos, k, 1e-4) for key, value in zip(keys[place], cos[i, place])]
        return pd.DataFrame(found, columns=["kq", "kr", "cos"])

    kinds = f"kq {met.schema['kq'].dataType.simpleString()}, kr {met.schema['kr'].dataType.simpleString()}"
    return met.groupBy(*by).applyInPandas(run, f"{kinds}, cos double")


def sign_neighbours(asked: DataFrame, have: DataFrame, key_a: str, key_b: str, vector: str, same: list[str], pool: int = 200) -> DataFrame:
    """(kq, kr): each query's ``pool`` rows of fewest differing sign bits, ties to the smaller key.

    Only the signs are shuffled and compared, a bit for each component; the exact comparison is the caller's.  A row behind the
    ``pool`` first can be nearer than all of them, so that no query that wants all rows goes by it.
    """
    met, by = _met(_usable(asked, key_a, "kq", vector, same), _usable(have, key_b, "kr", vector, same), sign_bits(F.col("v")), same)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        q, r = group[group["kr"].isna()], group[group["kr"].notna()].sort_values("kr")
        found = []
        if len(q) and len(r):
            theirs, keys, own = np.stack(r["x"].to_numpy()), r["kr"].to_numpy(), q["kq"].to_numpy()
            for at in range(0, len(q), _STEP):
                mine = np.stack(q["x"].to_numpy()[at : at + _STEP])
                bits = np.zeros((len(mine), len(theirs)), np.int64)
                for word in range(mine.shape[1]):
                    bits += np.bitwise_count(mine[:, word, None] ^ theirs[None, :, word])
                # Of equal distances the smaller key comes first.
                order = -(bits * len(keys) + np.arange(len(keys))).astype(float)
                order[own[at : at + _STEP, None] == keys[None, :]] = -np.inf
                found += [(own[at + i], key, value) for i, place in _kept(order, pool, 0.0) for key, value in zip(keys[place], bits[i, place])]
        return pd.DataFrame(found, columns=["kq", "kr", "bits"])

    kinds = f"kq {met.schema['kq'].dataType.simpleString()}, kr {met.schema['kr'].dataType.simpleString()}"
    near = met.groupBy(*by).applyInPandas(run, f"{kinds}, bits int")
    rank = F.row_number().over(Window.partitionBy("kq").orderBy("bits", "kr"))
    return near.withColumn("r", rank).where(F.col("r") <= pool).select("kq", "kr")


def compared(asked: DataFrame, have: DataFrame, key_a: str, key_b: str, vector: str, same: list[str]) -> DataFrame:
    """(kq, kr, bits, cos): differing sign bits and cosine of every query and every usable row of equal ``same`` columns and size, its own included.

    As many rows as pairs come out of any plan; a task holds a block of rows and one of queries, 2 million pairs at most.
    """
    met, by = _met(_usable(asked, key_a, "kq", vector, same), _usable(have, key_b, "kr", vector, same), F.col("v").cast("array<double>"), same, 4_000, 500)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        q, r = group[group["kr"].isna()], group[group["kr"].notna()]
        if not len(q) or not len(r):
            return pd.DataFrame({"kq": [], "kr": [], "bits": [], "cos": []})
        mine, theirs = np.stack(q["x"].to_numpy()), np.stack(r["x"].to_numpy())
        length = lambda v: np.sqrt((v * v).sum(axis=1))
        a, b = (mine > 0).astype(float), (theirs > 0).astype(float)
        bits = a.sum(axis=1)[:, None] + b.sum(axis=1) - 2 * (a @ b.T)  # whole numbers, so exact
        cos = mine @ theirs.T / (length(mine)[:, None] * length(theirs))
        return pd.DataFrame({"kq": np.repeat(q["kq"].to_numpy(), len(r)), "kr": np.tile(r["kr"].to_numpy(), len(q)), "bits": bits.ravel().astype(np.int32), "cos": cos.ravel()})

    kinds = f"kq {met.schema['kq'].dataType.simpleString()}, kr {met.schema['kr'].dataType.simpleString()}"
    return met.groupBy(*by).applyInPandas(run, f"{kinds}, bits int, cos double")
