"""Mixing to target weights with soft membership.

A classifier learnt from the labelled table gives each document a posterior over domains: a logistic
regression a domain over hashed words, stems, pairs and skip-grams, and above them a softmax over their
logits and the text's shape.  The softmax is fitted on logits of rows that the regression below hasn't
seen (folds), so that posteriors are calibrated and don't shrink to the domains' shares.
Nonnegative rates r_d then make the expected domain token totals, sum over d of r_d * t_d * p_dk,
match the targets in the least-squares sense while staying near 1:

    minimise over 0 <= r_d <= max_rate:
        sum over k of ((sum over d of r_d t_d p_dk) / T - target_k)^2 / share_k  +  ridge * sum over d of t_d / T * (r_d - 1)^2

with T all tokens and share_k the domain's natural share.  A rate depends on the document's posterior
alone, so documents are first added up by their posterior, rounded to ``1 / grid``; the totals of such a
bin are exact sums of its own documents' tokens times posteriors.  Accelerated projected-gradient steps,
scaled by t_d / T, then run over the bins: a step's gap is one aggregate (a number a domain), and rates are
recomputed from the short list of gaps so far, so nothing per document is collected or carried between steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.textops import LOWER, NOT_SPACE, Block, blocks, trim, unique_per_doc
from itemloom.llm.toxicity import Ftrl, grams
from itemloom.llm.toxicity import fit as fit_ftrl
from itemloom.llm.workspace import Workspace, free_name


@dataclass(frozen=True)
class Mixing:
    """``max_examples`` bounds the labelled rows that the classifier is fitted on; ``within`` is the relative gap of a target that ends the steps."""

    ftrl: Ftrl = Ftrl()
    stem: int = 4
    max_examples: int = 6_000
    folds: int = 3
    decay: float = 1e-3
    grid: int = 256
    ridge: float = 1e-3
    max_rate: float = 1.0
    steps: int = 120
    step: float = 0.9
    within: float = 0.01
    #: Steps also end when no total has moved by more than this share of all tokens, twice in a row.
    still: float = 1e-4


SIGNALS = 6


def _signals(block: Block, words) -> np.ndarray:
    """Shape of the text: log words, bytes a word, shares of distinct words, symbols, digits, capitals (not folded)."""
    n = words.counts()
    size = np.maximum(block.end - block.start, 1)
    doc, _, _ = unique_per_doc(words.doc, words.hashes())
    share = lambda member: np.diff(np.concatenate(([0], np.cumsum(member[block.buf])))[np.stack((block.start, block.end), 1)], axis=1)[:, 0] / size
    mark, digit, capital = (np.zeros(256, bool) for _ in range(3))
    mark[list(b"#*$%&|<>!")] = digit[0x30:0x3A] = capital[0x41:0x5B] = True
    return np.stack((np.log1p(n), np.minimum(size / np.maximum(n, 1), 20) / 5, block.per_doc(doc) / np.maximum(n, 1), 5 * share(mark), 5 * share(digit), 5 * share(capital)), axis=1)


def _features(block: Block, p: Mixing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, distinct feature) and signals."""
    folded = replace(block, buf=LOWER[block.buf])
    doc, ids, _ = unique_per_doc(*grams(folded, p.ftrl.bits, p.stem))
    return doc, ids.astype(np.int64), _signals(block, block.words(NOT_SPACE))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@dataclass
class Classifier:
    """Regressions' weights (used feature by domain) and biases; the softmax over logits and signals."""

    domains: list[str]
    index: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray

    def place(self, bits: int) -> np.ndarray:
        """Each feature's row in ``weights``; -1 for features without a weight."""
        at = np.full(1 << bits, -1, np.int32)
        at[self.index] = np.arange(len(self.index))
        return at

    def posteriors(self, block: Block, place: np.ndarray, p: Mixing) -> np.ndarray:
        k = len(self.domains)
        if k < 2:
            return np.ones((len(block.start), k))
        doc, ids, signals = _features(block, p)
        at = place[ids]
        doc, at = doc[at >= 0], at[at >= 0]
        logits = np.stack([block.per_doc(doc, self.weights[at, j].astype(float)) for j in range(k)], axis=1) + self.bias
        x = (np.concatenate((signals, np.clip(logits, -CLIP, CLIP)), axis=1) - self.mean) / self.spread
        return _softmax(x @ self.top + self.top_bias)


#: Logits beyond this are all the same to the softmax.
CLIP = 12.0


def _fit_softmax(x: np.ndarray, y: np.ndarray, k: int, decay: float, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression over few standardised columns, by accelerated gradient steps."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    step = 2 / np.linalg.eigvalsh(x.T @ x / len(x)).max()
    w = before = np.zeros((x.shape[1], k))
    for t in range(steps):
        ahead = w + t / (t + 3) * (w - before)
        gap = _softmax(x @ ahead)
        gap[np.arange(len(y)), y] -= 1
        before, w = w, ahead - step * (x.T @ gap / len(y) + decay * ahead)
    return w[:-1], w[-1]


def fit(sample: pd.DataFrame, p: Mixing, spark: SparkSession) -> Classifier:
    """From rows of features, signals and domain; one domain, or no rows, give a constant.

    Each regression, of a domain and all rows but one fold's or all rows, is one task.
    """
    domains = sorted(sample["domain"].unique()) or ["all"]
    k, none = len(domains), np.zeros(0)
    if k < 2:
        return Classifier(domains, none.astype(np.int64), none, none, none, none, none, none)
    y = sample["domain"].map({v: i for i, v in enumerate(domains)}).to_numpy()
    fold = np.arange(len(y)) % p.folds
    shared = spark.sparkContext.broadcast((sample["features"].tolist(), y, fold))  # at most max_examples rows

    def regress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, y, fold = shared.value
        for frame in batches:
            for j, f in zip(frame["domain"], frame["fold"]):
                learn = np.flatnonzero(fold != f)
                model = fit_ftrl([rows[i] for i in learn], [int(y[i] == j) for i in learn], p.ftrl)
                dense = np.zeros(1 << p.ftrl.bits)
                dense[model.index] = model.value
                apart = [float(dense[np.frombuffer(rows[i], "<u4")].sum() + model.bias) for i in np.flatnonzero(fold == f)]
                yield pd.DataFrame({"domain": [j], "fold": [f], "index": [model.index], "value": [model.value], "bias": [model.bias], "apart": [apart]})

    asked = spark.createDataFrame([(j, f) for j in range(k) for f in range(-1, p.folds)], "domain int, fold int").repartition(k * (p.folds + 1), "domain", "fold")
    got = asked.mapInPandas(regress, "domain int, fold int, index array<long>, value array<double>, bias double, apart array<double>").collect()
    shared.unpersist()
    logits, whole = np.zeros((len(y), k)), {}
    for row in got:
        if row["fold"] < 0:
            whole[row["domain"]] = row
        else:
            logits[fold == row["fold"], row["domain"]] = row["apart"]
    index = np.unique(np.concatenate([np.asarray(m["index"], np.int64) for m in whole.values()]))
    weights = np.zeros((len(index), k), np.float32)
    for j, m in whole.items():
        weights[np.searchsorted(index, np.asarray(m["index"], np.int64)), j] = m["value"]
    x = np.concatenate((np.stack(sample["signals"].to_numpy()), np.clip(logits, -CLIP, CLIP)), axis=1)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    top, top_bias = _fit_softmax((x - mean) / spread, y, k, p.decay)
    return Classifier(domains, index, weights, np.array([whole[j]["bias"] for j in range(k)]), mean, spread, top, top_bias)


def posteriors(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str, text: str, p: Mixing) -> tuple[DataFrame, list[str]]:
    """(uid, tokens, posterior) of every row of docs, and the domains' names in the posterior's order."""
    known = labels.select(F.col(id_col).alias("id"), domain.alias("domain")).where("domain is not null and id is not null")
    chosen = known.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(p.max_examples)
    # of rows that repeat an id the least text is learnt from
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "domain").agg(F.min("text").alias("text"))

    def learnable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(batches, "text", lower=False):
            doc, ids, signals = _features(block, p)
            cut = np.searchsorted(doc, np.arange(len(block.start) + 1))
            ids = ids.astype("<u4")
            yield block.frame[["id", "domain"]].assign(features=[ids[a:b].tobytes() for a, b in zip(cut, cut[1:])], signals=list(signals))

    kind = texts.schema["id"].dataType.simpleString()
    sample = texts.mapInPandas(learnable, f"id {kind}, domain string, features binary, signals array<double>").toArrow().to_pandas()  # at most max_examples
    model = fit(sample.sort_values("id", kind="stable").reset_index(drop=True), p, docs.sparkSession)
    del sample
    trim()  # what was learnt from would stay with the driver
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x domains: a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, place = shared.value, shared.value.place(p.ftrl.bits)
        for block in blocks(batches, "text", lower=False):
            yield pd.DataFrame({"uid": block.frame["uid"], "tokens": block.words(NOT_SPACE).counts(), "posterior": list(known.posteriors(block, place, p))})

    keyed = docs.select(F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit(""))).alias("uid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return keyed.mapInPandas(run, "uid long, tokens long, posterior array<double>"), model.domains


def _rates(posterior: np.ndarray, gaps: list[np.ndarray], p: Mixing) -> np.ndarray:
    """Rates at which the next gap is measured, after the accelerated steps whose gaps (total less target, by domain, over its share) are given."""
    r = ahead = np.ones(len(posterior))
    for t, gap in enumerate(gaps):
        before, r = r, np.clip(ahead - p.step * (posterior @ gap + p.ridge * (ahead - 1)), 0.0, p.max_rate)
        ahead = np.clip(r + t / (t + 3) * (r - before), 0.0, p.max_rate)
    return ahead


def binned(rows: DataFrame, width: int, p: Mixing) -> DataFrame:
    """(posterior rounded to the grid, mass: exact sums of tokens times posterior); one row a posterior that occurs."""
    level = F.transform("posterior", lambda v: F.round(v * p.grid) / p.grid)
    sums = [F.sum(F.col("tokens") * F.col("posterior")[k]) for k in range(width)]
    return rows.groupBy(level.alias("posterior")).agg(F.array(*sums).alias("mass"))


def solve(bins: DataFrame, targets: np.ndarray, share: np.ndarray, tokens: float, p: Mixing) -> tuple[list[np.ndarray], np.ndarray]:
    """The gaps of each step, until every total is within ``p.within`` of its target or stands still, and the totals reached."""
    width = len(targets)
    gaps: list[np.ndarray] = []
    last, rest = np.full(width, np.inf), 0
    while True:

        def total(batches: Iterator[pd.DataFrame], now: list = list(gaps)) -> Iterator[pd.DataFrame]:
            sums = np.zeros(width)
            for frame in batches:
                if len(frame):
                    sums += _rates(np.stack(frame["posterior"].to_numpy()), now, p) @ np.stack(frame["mass"].to_numpy())
            yield pd.DataFrame({"k": np.arange(width), "s": sums})

        got = bins.mapInPandas(total, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()  # a row for each domain
        sums = np.zeros(width)
        for row in got:
            sums[row["k"]] = row["s"]
        sums = sums / max(tokens, 1.0)
        rest, last = rest + 1 if np.abs(sums - last).max() < p.still else 0, sums
        if len(gaps) == p.steps or rest == 2 or (np.abs(sums - targets) <= p.within * targets).all():
            return gaps, sums
        gaps.append((sums - targets) / np.maximum(share, 1e-3))


def label_domain() -> Column:
    """Domains of the labelled table: toxic, else good or poor by quality; null without a quality."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], budget: float | None = 1.0, id_col: str = "doc_id", text: str = "text", p: Mixing = Mixing()) -> DataFrame:
    """A rate for every row of docs such that expected domain totals match the targets.

    ``domain`` names, from columns of ``labels``, each labelled row's domain.  Domains that ``targets``
    leaves out keep their natural share; shares are scaled to ``budget`` times the corpus' tokens, or,
    without a budget, to the most tokens for which no domain needs over ``p.max_rate`` times its own.
    Null and empty texts have no tokens and keep what their posterior's rate is.  Rows that
    repeat have one rate each; null ids are kept; an empty table gives no rows; without labelled
    rows there is one domain, "all".

    Columns: id_col, n_tokens, domain (likeliest), posterior (of it), rate, and the same for every
    row: reached (by domain, the share of expected tokens that the rates give) and met (whether
    each is within ``p.within`` of its target; no rates may exist that do).
    """
    space = Workspace(docs.sparkSession)
    soft, domains = posteriors(docs, labels, domain, id_col, text, p)
    soft = space.save(soft, "posteriors")
    width = len(domains)
    natural = soft.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("posterior")[k]) for k in range(width)]).first()
    tokens = float(natural[0] or 0)
    share = np.array([float(natural[k + 1] or 0) for k in range(width)]) / max(tokens, 1.0)
    want = np.array([targets.get(d, s) for d, s in zip(domains, share)])
    want = want / max(want.sum(), 1e-12)
    if budget is None:
        budget = min((p.max_rate * s / w for s, w in zip(share, want) if w > 0), default=1.0)
    want = budget * want
    gaps, reached = solve(space.save(binned(soft, width, p), "bins"), want, share, tokens, p)
    met = bool((np.abs(reached - want) <= p.within * want).all())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                post = np.stack(frame["posterior"].to_numpy())
                best = post.argmax(1)
                level = np.floor(post * p.grid + 0.5) / p.grid
                yield pd.DataFrame({"uid": frame["uid"], "n_tokens": frame["tokens"], "domain": np.array(domains, object)[best], "posterior": post.max(1), "rate": _rates(level, gaps, p)})

    rated = soft.mapInPandas(run, "uid long, n_tokens long, domain string, posterior double, rate double").dropDuplicates(["uid"])
    uid = F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit("")))
    shares = F.create_map(*[F.lit(v) for d, s in zip(domains, reached) for v in (d, float(s))])
    out = docs.select(F.col(id_col).alias("id"), uid.alias("uid")).join(rated, "uid").drop("uid")
    return out.select(F.col("id").alias(id_col), "n_tokens", "domain", "posterior", "rate", shares.alias("reached"), F.lit(met).alias("met"))


def resample(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", salt: int = 17) -> DataFrame:
    """Each row as often as its rate says: the whole part, and once more with the fraction's probability.

    Chance comes from a hash of the id, so that a rerun decides alike.  All columns stay.
    """
    chance = F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    n, one, key = (free_name(docs, v) for v in ("times", "one", "key"))
    times = rates.select(F.col(id_col).alias(key), F.floor(F.col("rate") + chance).cast("int").alias(n)).groupBy(key).agg(F.max(n).alias(n))
    met = docs.join(times, docs[id_col].eqNullSafe(times[key])).where(F.col(n) > 0)
    return met.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns])
