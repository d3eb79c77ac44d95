"""Vectorised text primitives that run inside Spark tasks.

A *block* is a run of documents whose UTF-8 bytes stand in one array, each document followed by
one line feed, so that no word, line or n-gram crosses a document.  Everything per byte or per
word is a numpy operation over the block; memory is bounded by the block's size (about a quarter of a MB, or
one document if that is longer), not by the partition's.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_values(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


VALUES = (_byte_values(11), _byte_values(12))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words when only ASCII white space separates them.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words when lower-cased letters, digits and everything beyond ASCII count.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**k mod 2**64 for k < n, kept for the largest n asked for up to some MB."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        have = np.full(size, base & _MASK, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 2 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Rolling:
    """Hashes of any substring of a byte array, from prefix sums of a polynomial mod 2**64."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(VALUES[which][buf] * powers(_BASE, len(buf)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(buf) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, end = np.asarray(start), np.asarray(end)
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


@dataclass
class Block:
    frame: pd.DataFrame
    buf: np.ndarray
    start: np.ndarray  # of each document in buf
    end: np.ndarray

    def words(self, member: np.ndarray) -> Words:
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = member[self.buf]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return Words(self, start, end, np.searchsorted(self.start, start, "right") - 1)

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, minlength=len(self.start))


@dataclass
class Words:
    block: Block
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def hashes(self, rolling: Rolling | None = None) -> np.ndarray:
        return (rolling or Rolling(self.block.buf))(self.start, self.end)

    def counts(self) -> np.ndarray:
        return self.block.per_doc(self.doc)


def utf8(texts: pd.Series) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in texts]


def trim() -> None:
    """Gives free memory back to the system, because Spark keeps Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    if (release := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        release(0)


def frames(batches: Iterator[pd.DataFrame], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about ``limit`` characters, or of one longer document."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = batch[text].str.len().fillna(0).to_numpy(np.int64)
        part = np.cumsum(sizes) // limit
        for cut in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
            yield batch.iloc[cut].reset_index(drop=True)
    trim()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in Arrow batches of about ``limit`` bytes of text, or of one longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def blocks(batches: Iterator[pd.DataFrame], text: str = "text", lower: bool = True, limit: int = BLOCK_BYTES, fold=None) -> Iterator[Block]:
    """Blocks of documents; ``lower`` folds A-Z, ``fold`` maps each text first (str.lower, say)."""
    for frame in frames(batches, text, limit):
        texts = frame[text] if fold is None else frame[text].map(lambda x: fold(x) if isinstance(x, str) else x)
        parts = utf8(texts)
        buf = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        start = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        yield Block(frame, LOWER[buf] if lower else buf, start, start + sizes)


def unique_per_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, h) in doc's order, and how often each occurs."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))
