"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Vectors are scaled to unit length, so that the order by cosine is the order by Euclidean distance.
k-means on a bounded sample gives coarse centroids and, on residuals, one codebook per subspace;
every row is then indexed by its nearest centroid, its residual's codes and what the codes leave of
it.  A query looks into its nearest cells; asymmetric distance tables (query residual against
codebooks) rank a cell's rows, and the best ``rerank`` are measured exactly.

What the codes leave bounds the error of a tabled distance, and a cell's radius that of its centroid.
So every other row that could still be among the nearest is measured too, and then every other cell
that could hold one is looked into: the result is that of brute force on any rows, and codes and
cells decide only how much of the table is left out.

A cell is split into blocks of about ``block`` rows by a hash of the id, with as many blocks as its
count asks for, so that one common vector doesn't make one large task; queries go to each block of
the cells they look into.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.workspace import Workspace


@dataclass(frozen=True)
class IvfPq:
    """``sample`` bounds the rows that centroids and codebooks are fitted on."""

    cells: int = 64
    probes: int = 8
    subspaces: int = 16
    codes: int = 256
    sample: int = 12_000
    rounds: int = 8
    rerank: int = 192
    block: int = 4096
    seed: int = 7


#: More than the rounding of a distance between unit vectors, whose square is known to some 1e-15.
SLACK = 1e-6


@dataclass
class Index:
    centroids: np.ndarray  # cells x dimensions
    books: np.ndarray  # subspaces x codes x dimensions / subspaces

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        gap = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return np.argsort(gap, axis=1, kind="stable")[:, :n]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        out = np.empty((len(residuals), len(self.books)), np.uint8)
        for s, part in enumerate(np.split(residuals, len(self.books), axis=1)):
            out[:, s] = ((self.books[s] ** 2).sum(1) - 2 * part @ self.books[s].T).argmin(1)
        return out

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of one residual's parts to every codeword."""
        parts = residual.reshape(len(self.books), 1, -1)
        return ((self.books - parts) ** 2).sum(2)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        count = np.bincount(near, minlength=len(c))
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], minlength=len(c))
            c[:, d] = np.where(count > 0, total / np.maximum(count, 1), c[:, d])
    return c


def _usable(vector: str):
    """A vector that isn't null, empty or zero and has only finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = np.asarray(raw, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times powers of two: the same cosines, bit for bit, and no overflow."""
    _, exponent = np.frexp(np.abs(raw).max(axis=1))
    return np.ldexp(raw, -exponent[:, None])


def _distance(cosine: float) -> float:
    """Between unit vectors of that cosine; without bound where there is none."""
    return np.inf if cosine == -np.inf else np.sqrt(max(0.0, 2 - 2 * cosine))


def fit(rows: DataFrame, p: IvfPq) -> Index | None:
    """Centroids and codebooks from at most ``p.sample`` rows, those of the smallest hash of the id."""
    sample = rows.orderBy(F.xxhash64("id", F.lit(p.seed)), "id").limit(p.sample).toArrow().to_pandas().sort_values("id")
    if not len(sample):
        return None
    x = _unit(np.stack(sample["vector"].to_numpy()))
    rng = np.random.default_rng(p.seed)
    centroids = _kmeans(x, p.cells, p.rounds, rng)
    residual = x - centroids[((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)]
    subspaces = max(s for s in range(1, p.subspaces + 1) if x.shape[1] % s == 0)
    return Index(centroids, _pad([_kmeans(part, p.codes, p.rounds, rng) for part in np.split(residual, subspaces, axis=1)]))


def _pad(books: list[np.ndarray]) -> np.ndarray:
    most = max(map(len, books))
    return np.stack([np.concatenate((b, np.repeat(b[:1], most - len(b), axis=0))) for b in books])


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", p: IvfPq = IvfPq()) -> DataFrame:
    """The ``k`` rows of largest cosine for each query, every other id's row a candidate.

    ``is_query`` is a condition on ``vectors``.  Vectors that are null, empty, zero, or hold a null
    or non-finite component take no part, nor do null ids and vectors whose length isn't the most
    frequent one.  Ties go to the smaller id; equal rows are one.  Fewer candidates than ``k``, or
    an empty table, give fewer rows.  Scores are cosines in double precision of the vectors as given.

    Columns: query_id, rank (from 1), id_col, score.
    """
    space = Workspace(vectors.sparkSession)
    rows = vectors.where(_usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind = vectors.schema[id_col].dataType.simpleString()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    rows = rows.where(F.size("vector") == usual["n"])
    index = fit(rows.select("id", "vector"), p)
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # cells x dimensions and codebooks: a fixed size

    def assign(batches):
        for frame in batches:
            if len(frame):
                x = _unit(np.stack(frame["vector"].to_numpy()))
                cell = shared.value.nearest_cells(x, 1)[:, 0]
                residual = x - shared.value.centroids[cell]
                codes = shared.value.encode(residual)
                left = np.sqrt(((residual - shared.value.decode(codes)) ** 2).sum(1))
                reach = np.sqrt((residual**2).sum(1))
                yield frame[["id", "vector", "asks"]].assign(cell=cell.astype(np.int32), codes=[c.tobytes() for c in codes], left=left, reach=reach)

    indexed = space.save(rows.mapInPandas(assign, f"id {kind}, vector array<double>, asks boolean, cell int, codes binary, left double, reach double"), "index")
    cells = indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("blocks"), F.max("reach").alias("reach"))  # a row for each cell: bounded
    reach = np.full(len(index.centroids), -np.inf)  # a cell without rows is never looked into
    for r in cells.select("cell", "reach").collect():
        reach[r["cell"]] = r["reach"]
    sizes = cells.select("cell", "blocks")
    members = indexed.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "vector", "codes", "left")

    def look(later: bool):
        def run(batches):
            for frame in batches:
                if len(frame):
                    x = _unit(np.stack(frame["vector"].to_numpy()))
                    centres = shared.value.centroids
                    away = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0))
                    first = np.zeros(away.shape, bool)
                    np.put_along_axis(first, shared.value.nearest_cells(x, p.probes), True, axis=1)
                    which = ~first & (away - reach <= frame["worst"].to_numpy()[:, None] + SLACK) if later else first & np.isfinite(reach)
                    row, cell = np.nonzero(which)
                    yield frame.iloc[row].assign(cell=cell.astype(np.int32))

        return run

    def measure(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "score": []})
        if not len(queries) or not len(block):
            return empty
        model = shared.value
        ids, raw, left = block["id"].to_numpy(), _scaled(np.stack(block["vector"].to_numpy())), block["left"].to_numpy()
        codes = np.frombuffer(b"".join(block["codes"]), np.uint8).reshape(len(block), -1).T.astype(np.intp)
        norms = np.sqrt((raw * raw).sum(1))
        again = np.ones(len(ids), bool)  # rows whose id stands before: equal rows are one, so they don't count as found
        again[np.unique(ids, return_index=True)[1]] = False
        out = []
        for query, v, worst in zip(queries["id"], queries["vector"], queries["worst"]):
            v = _scaled(np.asarray(v, np.float64)[None])[0]
            length = np.sqrt((v * v).sum())
            tables = model.tables(_unit(v[None])[0] - model.centroids[key[0]])
            gap = np.zeros(len(ids))
            for s in range(len(tables)):
                gap += tables[s][codes[s]]
            score = np.full(len(ids), -np.inf)

            def exact(at: np.ndarray) -> None:
                score[at] = (raw[at] * v).sum(1) / (norms[at] * length)

            exact(np.argpartition(gap, p.rerank)[: p.rerank] if len(ids) > p.rerank else np.arange(len(ids)))
            score[ids == query] = -np.inf
            held = np.where(again, -np.inf, score)
            if len(ids) > k:
                worst = min(worst, _distance(np.partition(held, len(ids) - k)[len(ids) - k]))
            exact(np.flatnonzero((score == -np.inf) & (np.sqrt(gap) - left <= worst + SLACK)))
            score[ids == query] = -np.inf
            near = np.flatnonzero(score > -np.inf)
            best = near[np.lexsort((ids[near], -score[near]))][: k + again.sum()]
            out.append(pd.DataFrame({"query_id": query, "id": ids[best], "score": score[best]}))
        return pd.concat(out, ignore_index=True) if out else empty

    def found(asked: DataFrame, later: bool) -> DataFrame:
        met = asked.mapInPandas(look(later), f"id {kind}, vector array<double>, worst double, cell int").join(F.broadcast(sizes), "cell")
        met = met.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vector", "worst")
        return met.groupBy("cell", "block").cogroup(members.groupBy("cell", "block")).applyInPandas(measure, f"query_id {kind}, id {kind}, score double").distinct()

    def ranked(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = indexed.where("asks").select("id", "vector")
    near = space.save(ranked(found(asked.withColumn("worst", F.lit(float("inf"))), False)), "near")
    # The distance of the k-th found bounds what else can be nearer; without k there is no bound.
    last = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("worst"))
    open_ = asked.join(last, "id", "left").select("id", "vector", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    both = near.select("query_id", "id", "score").unionByName(found(open_, True))
    return ranked(both).select("query_id", "rank", F.col("id").alias(id_col), "score")
