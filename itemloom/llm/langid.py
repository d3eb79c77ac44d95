"""Language identification: a linear-chain conditional random field over words.

Every word gets a label.  Emissions add weights of hashed byte n-grams of the word between its
boundaries, of its affixes, and a lexicon feature (log relative frequencies of the word by language,
counted over all training documents).  Transitions between neighbouring labels are learnt; marginals come
from forward-backward over the whole text as one chain.  A document's language is the label with the
largest sum of marginals, so that code-switched texts are labelled word by word first.

Labelled texts are in one language each, which would only teach that labels never change.  So the fit
also sees texts put together from runs of words of labelled texts in different languages, each word with its own
text's label.

Forward-backward is exact and yet vectorised: chains are cut into segments of ``SEGMENT`` words, the product of
each segment's transfer matrices is taken for all segments at once, messages at the segments' ends follow
from these products, and then all segments are filled in at once.

Weights are fitted on at most ``sample`` labelled documents, chosen by a hash of their id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.textops import Block, Rolling, blocks, mix
from itemloom.llm.workspace import small_batches

SEGMENT = 64
GRAMS = (2, 3, 4)
AFFIXES = (2, 4, 6)
LEXICON_BITS = 16
#: Bytes of words: letters a-z and everything beyond ASCII.
MEMBER = np.zeros(256, bool)
MEMBER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WORD = re.compile(rb"[a-z\x80-\xff]+")


@dataclass(frozen=True)
class CrfParams:
    """``sample`` bounds the documents that weights are fitted on, ``most_labels`` the languages, the most frequent ones."""

    bits: int = 17
    sample: int = 600
    most_labels: int = 64
    epochs: int = 2
    rate: float = 0.25
    #: Words of one gradient step, or one text's if it has more.
    batch: int = 4096
    #: Texts of mixed language for each labelled one, and the longest run of words in them.
    mixed: float = 0.25
    run: int = 24
    seed: int = 3


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # features x labels
    lexicon: np.ndarray  # buckets x labels, log relative frequencies less their mean
    lexicon_weights: np.ndarray  # labels x labels
    bias: np.ndarray
    transitions: np.ndarray  # from x to
    first: np.ndarray


class Features:
    """A block's distinct words: (word, feature) pairs of n-grams and affixes, and lexicon buckets; ``word`` maps places to them."""

    def __init__(self, block: Block, bits: int):
        words = block.words(MEMBER)
        rolling = Rolling(block.buf)
        h = words.hashes(rolling)
        self.doc = words.doc
        distinct, pick, self.word = np.unique(h, return_index=True, return_inverse=True)
        start, end = words.start[pick], words.end[pick]
        self.lexicon = (distinct >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
        shift, size, place = np.uint64(64 - bits), end - start, np.arange(len(pick))
        rows, ids = [], []
        for k in AFFIXES:
            n = np.minimum(size, k)
            rows += [place, place]
            ids += [mix(rolling(start, start + n) + np.uint64(2 * k + 1)) >> shift, mix(rolling(end - n, end) + np.uint64(2 * k + 2)) >> shift]
        padded = np.full(len(block.buf) + 2, 0x20, np.uint64)
        padded[1:-1] = np.where(MEMBER[block.buf], block.buf, 0x20)
        for n in GRAMS:  # windows over boundary, word, boundary; the byte before a word stands at its start in ``padded``
            count = np.maximum(size + 3 - n, 0)
            row = np.repeat(place, count)
            at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            code = np.full(len(at), n, np.uint64)
            for k in range(n):
                code = code << np.uint64(8) | padded[at + k]
            rows.append(row)
            ids.append(mix(code) >> shift)
        self.rows, self.ids = np.concatenate(rows), np.concatenate(ids).astype(np.int64)

    def emissions(self, model: Crf) -> np.ndarray:
        """Of each distinct word."""
        out = model.lexicon[self.lexicon] @ model.lexicon_weights + model.bias
        for j in range(out.shape[1]):
            out[:, j] += np.bincount(self.rows, model.weights[self.ids, j], minlength=len(out))
        return out


def _segments(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words in their texts' order: the segment and the place in it; of segments: the length, and whether a text begins."""
    i = np.arange(len(doc))
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    place = i - np.maximum.accumulate(np.where(new, i, 0))
    head = place % SEGMENT == 0
    segment = np.cumsum(head) - 1
    return segment, place % SEGMENT, np.bincount(segment), new[head]


def forward_backward(emit: np.ndarray, doc: np.ndarray, model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (word x label) and summed pair marginals (from x to); words of one ``doc`` stand together, as a chain."""
    n, labels = emit.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((labels, labels))
    segment, place, size, first = _segments(doc)
    order = np.argsort(-size, kind="stable")  # longest first, so that at each place the live ones come first
    row = np.empty(len(size), np.int64)
    row[order] = np.arange(len(size))
    where, longest = row[segment], int(size.max())
    e = np.ones((len(size), longest, labels))
    e[where, place] = np.exp(emit - emit.max(axis=1, keepdims=True))
    live = np.searchsorted(-size[order], -np.arange(1, longest + 1), "right")
    move, begin = np.exp(model.transitions - model.transitions.max()), np.exp(model.first - model.first.max())
    head = first[order]
    # What a segment makes of the message before it, message by message; a text's first one is deaf to it.
    through = np.where(head[:, None, None], begin * e[:, :1], move * e[:, :1])
    for t in range(1, longest):
        k = live[t]
        through[:k] = (through[:k] @ move) * e[:k, t, None, :]
        through[:k] /= through[:k].sum((1, 2), keepdims=True)
    by_segment = through[row]
    # Messages at the segments' ends, one segment of every text at a time.
    heads = np.flatnonzero(first)
    parts = np.diff(np.append(heads, len(size)))
    before, after = np.full((len(size), labels), 1.0 / labels), np.full((len(size), labels), 1.0 / labels)
    by_parts = np.argsort(-parts, kind="stable")
    heads, parts = heads[by_parts], parts[by_parts]
    many = int(parts[0])
    running = np.searchsorted(-parts, -np.arange(1, many + 1), "right")
    for t in range(1, many):
        s = heads[: running[t]] + t
        m = (before[s - 1][:, None, :] @ by_segment[s - 1])[:, 0]
        before[s] = m / m.sum(1, keepdims=True)
    for t in range(many - 1, 0, -1):
        s = heads[: running[t]] + t
        m = (by_segment[s] @ after[s][:, :, None])[:, :, 0]
        after[s - 1] = m / m.sum(1, keepdims=True)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = np.where(head[:, None], begin, before[order] @ move) * e[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for t in range(1, longest):
        k = live[t]
        a = (alpha[:k, t - 1] @ move) * e[:k, t]
        alpha[:k, t] = a / a.sum(1, keepdims=True)
    beta[np.arange(len(size)), size[order] - 1] = after[order]
    for t in range(longest - 2, -1, -1):
        k = live[t + 1]
        b = (beta[:k, t + 1] * e[:k, t + 1]) @ move.T
        beta[:k, t] = b / b.sum(1, keepdims=True)
    alpha, beta, e = alpha[where, place], beta[where, place], e[where, place]
    both = alpha * beta
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    joint = alpha[inner, :, None] * move * (e * beta)[inner + 1, None, :]
    return both / np.maximum(both.sum(1, keepdims=True), 1e-300), (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def lexicon(rows: DataFrame, labels: list[str]) -> np.ndarray:
    """Words of all training documents by hash bucket and label: at most 2**LEXICON_BITS rows of counts."""
    number, width = {v: i for i, v in enumerate(labels)}, len(labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 << LEXICON_BITS) * width, np.int64)
        for block in blocks(batches, "text", fold=str.lower):
            words = block.words(MEMBER)
            label = block.frame["lang"].map(number).to_numpy()
            total += np.bincount((words.hashes() >> np.uint64(64 - LEXICON_BITS)).astype(np.int64) * width + label[words.doc], minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    counts = rows.mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    dense = np.zeros((1 << LEXICON_BITS) * width)
    dense[counts["cell"].to_numpy(np.int64)] = counts["n"]
    dense = dense.reshape(-1, width)
    log = np.log((dense + 0.5) / (dense.sum(0) + 0.5 * len(dense)))
    return log - log.mean(1, keepdims=True)


def code_switched(texts: list[str], labels: list[int], p: CrfParams) -> list[tuple[str, np.ndarray]]:
    """Texts of runs of words out of two texts of different labels by turns, with each word's label."""
    rng = np.random.default_rng(p.seed + 1)
    made = []
    for _ in range(int(p.mixed * len(texts))):
        i = int(rng.integers(len(texts)))
        others = np.flatnonzero(np.asarray(labels) != labels[i])
        if not len(others):
            break
        pair = (i, int(rng.choice(others)))
        words, at, out, truth, turn = [texts[k].split() for k in pair], [0, 0], [], [], 0
        while at[turn] < len(words[turn]):
            some = words[turn][at[turn] : at[turn] + int(rng.integers(2, p.run + 1))]
            at[turn] += len(some)
            out += some
            truth.append(np.full(len(_WORD.findall(" ".join(some).lower().encode("utf-8", "surrogatepass"))), labels[pair[turn]]))
            turn = 1 - turn
        made.append((" ".join(out), np.concatenate(truth) if truth else np.zeros(0, np.int64)))
    return made


def fit(sample: pd.DataFrame, labels: list[str], lexicon_: np.ndarray, p: CrfParams) -> Crf:
    """Stochastic gradient ascent on the chains' conditional likelihood, with per-coordinate rates."""
    width, rng = len(labels), np.random.default_rng(p.seed)
    model = Crf(labels, np.zeros((1 << p.bits, width), np.float32), lexicon_, np.eye(width), np.zeros(width), np.zeros((width, width)), np.zeros(width))
    number = {v: i for i, v in enumerate(labels)}
    own = [number[v] for v in sample["lang"]]
    mixed = code_switched(list(sample["text"]), own, p)
    spent = [np.full(x.shape, 1.0) for x in (model.weights, model.lexicon_weights, model.bias, model.transitions, model.first)]
    parts = []
    frame = pd.DataFrame({"text": [*sample["text"], *(t for t, _ in mixed)], "of": range(len(own) + len(mixed))})
    for block in blocks([frame], "text", fold=str.lower):
        f = Features(block, p.bits)
        size = np.bincount(f.doc, minlength=len(block.start))
        truth = [np.full(size[k], own[i]) if i < len(own) else mixed[i - len(own)][1] for k, i in enumerate(block.frame["of"])]
        parts.append((f, np.concatenate(truth), size, np.argsort(f.rows, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(f.rows, minlength=len(f.lexicon)))))))
    for _ in range(p.epochs):
        for k in rng.permutation(len(parts)):
            f, truth, size, by_word, cut = parts[k]
            ends, order = np.cumsum(size), rng.permutation(np.flatnonzero(size))
            groups = np.split(order, np.flatnonzero(np.diff(np.cumsum(size[order]) // p.batch)) + 1) if len(order) else []
            for some in groups:
                pick = np.concatenate([np.arange(ends[c] - size[c], ends[c]) for c in some])
                chain, y = np.repeat(np.arange(len(some)), size[some]), truth[pick]
                used, word = np.unique(f.word[pick], return_inverse=True)
                n = cut[used + 1] - cut[used]
                pairs_of = by_word[np.repeat(cut[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                rows, ids = np.repeat(np.arange(len(used)), n), f.ids[pairs_of]
                lex = model.lexicon[f.lexicon[used]]
                emit = lex @ model.lexicon_weights + model.bias
                for j in range(width):
                    emit[:, j] += np.bincount(rows, model.weights[ids, j], minlength=len(used))
                gap, pairs = forward_backward(emit[word], chain, model)
                gap[np.arange(len(pick)), y] -= 1
                inner = np.flatnonzero(chain[1:] == chain[:-1])
                np.subtract.at(pairs, (y[inner], y[inner + 1]), 1)
                heads = np.flatnonzero(np.diff(chain, prepend=-1))
                by = np.stack([np.bincount(word, gap[:, j], minlength=len(used)) for j in range(width)], axis=1)
                scatter = np.stack([np.bincount(ids, by[rows, j], minlength=1 << p.bits) for j in range(width)], axis=1)
                values = (model.weights, model.lexicon_weights, model.bias, model.transitions, model.first)
                for value, g, used_up in zip(values, (scatter, lex.T @ by, gap.sum(0), pairs, gap[heads].sum(0)), spent):
                    g = g / max(len(pick) / SEGMENT, 1)
                    used_up += g * g
                    value -= (p.rate * g / np.sqrt(used_up)).astype(value.dtype)
    return model


def word_marginals(block: Block, model: Crf, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The document of each word of a block, and the word's marginals over the labels."""
    f = Features(block, bits)
    return f.doc, forward_backward(f.emissions(model)[f.word], f.doc, model)[0]


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", p: CrfParams = CrfParams()) -> Crf | None:
    """The model learnt from rows where ``learn`` holds and neither ``lang`` nor the text is null; None without any."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.most_labels)
    labels = sorted(r["lang"] for r in common.collect())
    if not labels:
        return None
    rows = rows.where(F.col("lang").isin(labels))
    chosen = rows.select("id", "lang").distinct().orderBy(F.xxhash64("id", "lang"), "id", "lang").limit(p.sample)
    sample = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))
    sample = sample.toArrow().to_pandas().sort_values(["id", "lang"], kind="stable").reset_index(drop=True)
    return fit(sample, labels, lexicon(rows.select("text", "lang"), labels), p)


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", p: CrfParams = CrfParams()) -> DataFrame:
    """Predicts the language of every whole text, learning from rows where ``learn`` holds and ``lang`` isn't null.

    ``und``, with score 0.0, is what null texts and texts without a letter get, and all texts if there
    is nothing to learn from.  Rows are predicted each by itself: repeated rows repeat, null ids are
    kept (but not learnt from), an empty table gives no rows; other columns are ignored.  Labels of equal mass: the
    first by name.

    Columns: id_col, lang_pred, score (the predicted label's share of all words' marginals),
    n_languages (labels of which a word in ten, and three words, are likeliest).
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, learn, id_col, text, lang, p))  # a fixed number of features x labels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for block in blocks(batches, "text", fold=str.lower):
            letters = np.array([isinstance(x, str) and any(map(str.isalpha, x)) for x in block.frame["text"]], bool)
            out = block.frame[["id"]].rename(columns={"id": id_col}).assign(lang_pred="und", score=0.0, n_languages=0)
            if crf is not None and letters.any():
                doc, marginal = word_marginals(block, crf, p.bits)
                mass = np.stack([block.per_doc(doc, marginal[:, j]) for j in range(len(crf.labels))], axis=1)
                best, total = mass.argmax(1), mass.sum(1)
                likeliest = np.stack([block.per_doc(doc, (marginal.argmax(1) == j).astype(float)) for j in range(len(crf.labels))], axis=1)
                ok = letters & (total > 0)
                out["lang_pred"] = np.where(ok, np.array(crf.labels, object)[best], "und")
                out["score"] = np.where(ok, np.minimum(mass.max(1) / np.maximum(total, 1e-12), 1.0), 0.0)
                out["n_languages"] = np.where(ok, np.maximum(((likeliest >= 3) & (10 * likeliest >= total[:, None])).sum(1), 1), 0)
            yield out

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"`{id_col}` {kind}, lang_pred string, score double, n_languages int")
