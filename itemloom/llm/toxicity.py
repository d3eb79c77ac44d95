"""Toxicity scores from FTRL-proximal logistic regression.

Features are presence of hashed words, their stems (leading bytes, so that compounds and inflections
share one), word pairs and pairs with one word between them (skip-grams).  The stem's length is chosen by
log loss on a quarter of the rows that may be learnt from, before the model is fitted on all of them.  FTRL-proximal keeps a learning rate per coordinate and an L1 penalty that leaves
most weights at exactly zero, so the model that goes to the executors is a short list of
(index, weight) pairs whose length can't exceed ``2**bits``.

Labels are read from at most ``max_examples`` labelled rows, chosen by a hash of their id, which
bounds what the driver holds whatever the corpus' size; scoring is one narrow pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.textops import NOT_SPACE, Rolling, blocks, mix, trim, unique_per_doc
from itemloom.llm.workspace import small_batches

#: Letters and digits; everything else separates words, so that punctuation doesn't hide one.
MEMBER = NOT_SPACE.copy()
MEMBER[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


@dataclass(frozen=True)
class Ftrl:
    """Hyperparameters; ``max_examples`` bounds the labelled rows that are learnt from."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    bits: int = 20
    epochs: int = 3
    max_examples: int = 12_000
    #: Lengths of stems in bytes that compete, on ``choose_on`` of the labelled rows; 0 is none.
    stems: tuple[int, ...] = (0, 4, 6)
    choose_on: int = 3_000


@dataclass(frozen=True)
class Model:
    """The weights that aren't zero, by index, the bias and the stem's length."""

    index: np.ndarray
    value: np.ndarray
    bias: float
    stem: int = 0


def grams(block, bits: int, stem: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all grams of a block, with repetitions."""
    words = block.words(MEMBER)
    rolling, shift = Rolling(block.buf), np.uint64(64 - bits)
    h = words.hashes(rolling)
    docs, ids = [words.doc], [h >> shift]
    if stem:
        docs.append(words.doc)
        ids.append(mix(rolling(words.start, np.minimum(words.end, words.start + stem)) * np.uint64(0x2545F4914F6CDD1D)) >> shift)
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        if len(h) > gap:
            near = words.doc[gap:] == words.doc[:-gap]
            docs.append(words.doc[gap:][near])
            ids.append(mix(h[:-gap][near] * np.uint64(salt) + h[gap:][near]) >> shift)
    return np.concatenate(docs), np.concatenate(ids)


def featurise(docs: DataFrame, text: str, keep: list[str], bits: int, stems: tuple[int, ...]) -> DataFrame:
    """``keep`` columns and, for each stem's length, ``features_N``: little-endian uint32 of the distinct features."""
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + [f"features_{n} binary" for n in stems])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(batches, text, fold=str.lower):
            out = block.frame[keep]
            for n in stems:
                doc, ids, _ = unique_per_doc(*grams(block, bits, n))
                cut = np.searchsorted(doc, np.arange(len(block.start) + 1))
                ids = ids.astype("<u4")
                out = out.assign(**{f"features_{n}": [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]})
            yield out

    return docs.select(*keep, text).mapInPandas(run, schema)


def fit(features: list[bytes], labels: list[int], p: Ftrl, epochs: int | None = None) -> Model:
    """Learns from rows of features.

    Without examples, or with one class only, there are no weights and the bias is the logit of
    the share of positives after adding one of each kind.
    """
    y = np.asarray(labels, float)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), prior)
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    bias, bias_n = prior, 0.0
    rng = np.random.default_rng(5)

    def weight(i: np.ndarray) -> np.ndarray:
        v = z[i]
        return np.where(np.abs(v) <= p.l1, 0.0, -(v - np.sign(v) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    rows = [np.frombuffer(f, "<u4").astype(np.int64) for f in features]
    for _ in range(p.epochs if epochs is None else epochs):
        for k in rng.permutation(len(rows)):
            i = rows[k]
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y[k]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g * g
            bias_n += g * g
            bias -= p.alpha / 3 / (p.beta + np.sqrt(bias_n)) * g
    used = np.flatnonzero(np.abs(z) > p.l1)
    return Model(used, weight(used), float(bias))


def log_loss(model: Model, features: list[bytes], labels: np.ndarray, bits: int) -> float:
    dense = np.zeros(1 << bits)
    dense[model.index] = model.value
    z = np.array([dense[np.frombuffer(f, "<u4")].sum() for f in features]) + model.bias
    return float(np.mean(np.logaddexp(0, np.where(labels > 0, -z, z))))


def choose_stem(rows: pd.DataFrame, y: np.ndarray, p: Ftrl) -> int:
    """The stem's length of the least log loss on every fourth row, after one pass over the others; ties to the shorter."""
    apart = np.arange(len(rows)) % 4 == 3
    if not apart.any() or not (~apart).any() or y[~apart].min() == y[~apart].max():
        return p.stems[0]
    losses = []
    for n in p.stems:
        column = rows[f"features_{n}"].to_numpy()
        losses.append((round(log_loss(fit(list(column[~apart]), list(y[~apart]), p, 1), list(column[apart]), y[apart], p.bits), 12), n))
    return min(losses)[1]


def train(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, p: Ftrl) -> Model:
    """Fits on at most ``p.max_examples`` labelled documents, chosen by a hash of the id."""
    wanted = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("__y"))
    chosen = wanted.orderBy(F.xxhash64(id_col), id_col).limit(p.max_examples)
    texts = docs.select(id_col, text)

    def learnable(few: DataFrame, stems: tuple[int, ...]) -> tuple[pd.DataFrame, np.ndarray]:
        rows = featurise(texts.join(F.broadcast(few), id_col), text, [id_col, "__y"], p.bits, stems).toArrow().to_pandas()
        rows = rows.sort_values(id_col, kind="stable").reset_index(drop=True)
        return rows, (rows["__y"].to_numpy() > 0).astype(int)

    stem = p.stems[0]
    if len(p.stems) > 1:
        stem = choose_stem(*learnable(chosen.limit(p.choose_on), p.stems), p)
        trim()
    rows, y = learnable(chosen, (stem,))
    features = rows.pop(f"features_{stem}").tolist()
    model = replace(fit(features, list(y), p), stem=stem)
    del rows, features
    trim()  # what was learnt from would stay with the driver
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", p: Ftrl = Ftrl()) -> DataFrame:
    """``keep`` columns and ``score``, the probability of the positive class."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, value=model.value.astype(np.float32)))
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + ["score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        dense = np.zeros(1 << p.bits, np.float32)
        dense[known.index] = known.value
        for block in blocks(batches, text, fold=str.lower):
            doc, ids = grams(block, p.bits, known.stem)
            hit = dense[ids] != 0
            doc, ids, _ = unique_per_doc(doc[hit], ids[hit])
            total = known.bias + block.per_doc(doc, dense[ids].astype(float))
            yield block.frame[keep].assign(score=1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return docs.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[str] | None = None, p: Ftrl = Ftrl()) -> DataFrame:
    """Scores every document for ``label``, learning only from rows where ``learn`` holds.

    ``learn`` is a condition on the id, and is applied to ``labels``.  Null text counts as empty:
    its score is the bias alone.  Rows are returned as they come, repeated ids included; null ids
    are scored but not learnt from.  An empty table gives no rows; columns that aren't named
    here are ignored.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels.select(id_col, label).where(learn), id_col, text, label, p)
    return score(docs, model, keep or [id_col], text, p)
