"""Quality rules built on repetition coverage.

Rolling hashes of several n-gram lengths find, in numpy, the word windows that occur twice or
more within a document; what is measured is the share of the document's word characters that such
windows, or repeated lines, cover.  One narrow pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from itemloom.llm.textops import NOT_SPACE, Block, Words, blocks, mix, powers
from itemloom.llm.workspace import small_batches

_BASE = 0xA0761D6478BD642F | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Largest allowed shares of word characters, by n-gram length, and of other signals."""

    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.30, 8: 0.25, 12: 0.20})
    line_coverage: float = 0.30
    symbols_per_word: float = 0.30
    min_words: int = 50
    repeat_percent: int = 50


def window_hashes(words: Words, h: np.ndarray, n: int, by_doc: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """First word's index and hash of each n-word window inside a document; ``by_doc`` salts it by document."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_BASE, len(h)), out=sums[1:])
    first = np.flatnonzero(words.doc[n - 1 :] == words.doc[: len(h) - n + 1])
    value = (sums[first + n] - sums[first]) * powers(_INVERSE, len(h))[first]
    return first, mix(value + words.doc[first].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) if by_doc else value)


def repeated(h: np.ndarray) -> np.ndarray:
    """For each value, whether it occurs again in the array."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered_words(words: Words, h: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its document holds twice or more."""
    first, value = window_hashes(words, h, n)
    first = first[repeated(value)]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _lines(block: Block, text: str, chars_of) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of the document: how many, and their word characters."""
    count, chars = np.zeros(len(block.start), np.int64), np.zeros(len(block.start), np.int64)
    ends = np.flatnonzero(block.buf == 10)  # one stands after each document
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    filled = chars_of(starts, ends)
    keep = filled > 0
    starts, ends, filled = starts[keep], ends[keep], filled[keep]
    raw, doc = block.buf.tobytes(), np.searchsorted(block.start, starts, "right") - 1
    seen: set[bytes] = set()
    last = -1
    for d, a, b, c in zip(doc.tolist(), starts.tolist(), ends.tolist(), filled.tolist()):
        if d != last:
            seen, last = set(), d
        line = raw[a:b]
        if line in seen:
            count[d] += 1
            chars[d] += c
        else:
            seen.add(line)
    return count, chars


def measure(docs: DataFrame, keep: list[str], text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``keep`` columns, the measurements and the verdict of each document.

    Words are runs of anything but ASCII white space; case matters.  Null and empty texts have no
    words: every count is zero, every share 0.0, and ``base_failed`` holds.  Each row is judged by
    itself, so ties, repeated rows and an empty table need no care.

    Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words inside 3-word
    windows found twice or more), base_failed, kept, line_share and share_N for each n-gram length,
    reasons (sorted names of the rules that failed).
    """
    small_batches(docs.sparkSession)
    sizes = sorted(rules.coverage)
    schema = ", ".join(
        [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
        + [f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + ["base_failed boolean", "kept boolean", "line_share double", *(f"share_{n} double" for n in sizes), "reasons string"]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(batches, text, lower=False):
            words = block.words(NOT_SPACE)
            points = np.concatenate(([0], np.cumsum(NOT_SPACE[block.buf] & ((block.buf & 0xC0) != 0x80))))
            chars_of = lambda a, b: points[b] - points[a]
            each, h, n_words = chars_of(words.start, words.end), words.hashes(), words.counts()
            word_chars = block.per_doc(words.doc, each).astype(np.int64)
            total = np.maximum(word_chars, 1)
            dup_lines, line_chars = _lines(block, text, chars_of)
            marks = np.concatenate(([0], np.cumsum(SYMBOLS[block.buf])))
            out = block.frame[keep].assign(n_words=n_words, word_chars=word_chars, n_symbols=marks[block.end] - marks[block.start], n_dup_lines=dup_lines)
            out["n_repeat_words"] = block.per_doc(words.doc[covered_words(words, h, 3)])
            out["line_share"] = line_chars / total
            failed = {"lines": out["line_share"] > rules.line_coverage, "symbols": out["n_symbols"] > rules.symbols_per_word * n_words}
            for n in sizes:
                inside = covered_words(words, h, n)
                out[f"share_{n}"] = block.per_doc(words.doc[inside], each[inside]) / total
                failed[f"repeats_{n}"] = out[f"share_{n}"] > rules.coverage[n]
            failed["words"] = n_words < rules.min_words
            failed["windows"] = 100 * out["n_repeat_words"] > rules.repeat_percent * n_words
            names = sorted(failed)
            flags = np.column_stack([np.asarray(failed[k], bool) for k in names])
            out["reasons"] = [",".join(k for k, v in zip(names, row) if v) for row in flags]
            out["base_failed"] = np.asarray(failed["words"] | failed["windows"], bool)
            out["kept"] = ~flags.any(axis=1)
            yield out

    return docs.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)
