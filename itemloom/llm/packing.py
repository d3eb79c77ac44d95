"""Order-preserving packing of tokenised documents into windows, by dynamic programming.

Documents of a partition stand one after another.  Windows are cut from that sequence at document
ends, sentence ends or clause ends (and, where a stretch without either is longer than a window, at forced
places).  With s_j the tokens before place j, and p_j the penalty of cutting there,

    f_j = p_j + min over i with s_j - s_i <= window of f_i + window - (s_j - s_i)

is the least sum of padding and truncation penalties of a packing that cuts at j.  The minimum runs
over a sliding range of f_i + s_i, so a monotone queue finds each in constant time.

Memory is bounded by a block of documents: windows but the last two of a block are final, and
their tokens are carried into the next block.  Only a partition's last window can stay short.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.textops import frames, trim
from itemloom.llm.workspace import small_batches


@dataclass(frozen=True)
class Packing:
    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    window: int = 2048
    end_id: int = 1
    #: Tokens of padding that avoiding one cut is worth: inside a document at a sentence's or clause's end, and elsewhere.
    sentence_penalty: float = 1.0
    clause_penalty: float = 3.0
    forced_penalty: float = 64.0
    block_chars: int = 1 << 19
    cache: int = 120_000


#: Composed letters that lower-casing leaves as they are.
_SMALL_LATIN1 = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Marks that the tokenizer keeps together behind a word: all of ASCII but the apostrophe, which may begin an ending.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder(dict):
    """Ids of texts as little-endian uint32 bytes; encodings of strings between white space are kept.

    The tokenizer drops white space and never joins what stands on its two sides, so the ids of
    a text are those of its pieces; at most ``cache`` pieces are kept, those of the last misses, in two halves:
    a full half takes the older one's place, and what is found there moves to the new one.  A piece of Latin
    letters, with or without closing marks, is one or two units for the tokenizer's BPE model, which is
    asked directly; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, cache: int):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.half = Tokenizer.from_file(path), cache // 2
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        ending = lambda marks: [i for t, i in vocabulary.items() if (w := t.removesuffix("</w>")) and t != w and set(w) <= set(marks)]
        #: By id: 1 for a token that ends a sentence, 2 for one that ends a clause.
        self.ends = np.zeros(max(vocabulary.values()) + 1, np.int8)
        self.ends[ending(".!?")], self.ends[ending(",;:")] = 1, 2
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.ends))]
        # How the tokenizer's byte level writes each byte: printable Latin-1 as itself, the rest from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.written = {b: 256 + k for k, b in enumerate(rest)}
        self.marks: dict[bytes, bytes] = {}

    def _letters(self, word: bytes) -> str | None:
        """A word of composed Latin letters beyond ASCII, as the byte level writes it; None for any other."""
        try:
            text = word.decode()
        except UnicodeDecodeError:
            return None
        if not _SMALL_LATIN1.fullmatch(text):
            if not text.isalpha() or max(text) >= "\u0250" or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
                return None
            text = text.lower()
        return text.encode().decode("latin-1").translate(self.written)

    def _whole(self, piece: bytes) -> bytes:
        return np.array(self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        base = piece.rstrip(_MARKS)
        if (text := base.decode("ascii").lower() if base.isalpha() else self._letters(base) if base else None) is None:
            return self._whole(piece)
        packed = self.packed
        ids = b"".join([packed[t.id] for t in self.tokenize(text)])
        if len(base) == len(piece):
            return ids
        marks = piece[len(base) :]
        if (more := self.marks.get(marks)) is None:
            more = self._whole(marks)
            if len(self.marks) < 1000:
                self.marks[marks] = more
        return ids + more

    def __missing__(self, piece: bytes) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = self._piece(piece)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older, self.marks = {}, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, ids = [], self.__getitem__
        for text in texts:
            raw = text.encode("utf-8", "replace")
            # Folding A-Z first might spell a special token, whose marks are the only ones that matter.
            out.append(b"".join(map(ids, (raw if b"<|" in raw else raw.lower()).split())))
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, cache: int) -> Encoder:
    return Encoder(path, cache)


def cut_places(ids: np.ndarray, document_ends: np.ndarray, encode: Encoder, p: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Places (tokens before them) where a cut may be, first 0 and last the end, and their penalties."""
    ends = encode.ends[ids]
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[np.flatnonzero(ends == 1) + 1] = p.sentence_penalty
    penalty[np.flatnonzero(ends == 2) + 1] = p.clause_penalty
    penalty[0] = penalty[document_ends] = 0.0
    places = np.flatnonzero(penalty < np.inf)
    for i in np.flatnonzero(np.diff(places) > p.window):
        penalty[places[i] + p.window // 8 : places[i + 1] : p.window // 8] = p.forced_penalty
    every = np.flatnonzero(penalty < np.inf)
    return every, penalty[every]


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Places of the cuts of the cheapest packing, first and last place included."""
    s, pen = places.tolist(), penalty.tolist()
    cost, back = [0.0] * len(s), [0] * len(s)
    queue: deque[tuple[float, int]] = deque([(float(s[0]), 0)])  # cost_i + s_i, rising from the left
    for j in range(1, len(s)):
        here = s[j]
        while here - s[queue[0][1]] > window:
            queue.popleft()
        least, back[j] = queue[0]
        cost[j] = c = pen[j] + least + window - here
        c += here
        while queue and queue[-1][0] >= c:
            queue.pop()
        queue.append((c, j))
    cuts, j = [], len(s) - 1
    while True:
        cuts.append(s[j])
        if j == 0:
            return cuts[::-1]
        j = back[j]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: Packing = Packing()) -> DataFrame:
    """Pieces of all documents in windows of at most ``p.window`` tokens; every token lies in one piece.

    A document's tokens are those of its text (null: none) and then ``p.end_id``, so an empty text is
    one token.  Documents keep the order that they have in their partition; repeated rows are
    packed each.  An empty table gives no rows; other columns are ignored.

    Columns: id_col, start (the document's tokens before the piece), length, ids_crc32 (of the ids as
    little-endian uint32), doc_tokens, sequence_id (unique: partition and number), offset (from 0, gapless).
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(p.tokenizer, p.cache)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([p.end_id], "<u4").tobytes()
        held: list[tuple] = []  # (id, bytes left, tokens before them, document's tokens)

        def windows(last: bool) -> pd.DataFrame:
            nonlocal sequence, held
            size = np.array([len(h[1]) // 4 for h in held], np.int64)
            ends = np.cumsum(size)
            raw = b"".join(h[1] for h in held)
            cuts = best_cuts(*cut_places(np.frombuffer(raw, "<u4"), ends, encode, p), p.window)
            final = len(cuts) - 1 if last else max(len(cuts) - 3, 0)
            begins, rows, k = ends - size, [], 0
            for a, b in zip(cuts[:final], cuts[1 : final + 1]):
                while k < len(held) and begins[k] < b:
                    low, high = max(a, int(begins[k])), min(b, int(ends[k]))
                    key, _, before, total = held[k]
                    rows.append((key, before + low - int(begins[k]), high - low, zlib.crc32(raw[4 * low : 4 * high]), total, sequence, low - a))
                    if ends[k] > b:
                        break
                    k += 1
                sequence += 1
            done = cuts[final]
            k = int(np.searchsorted(ends, done, "right"))
            rest = [(h[0], h[1][4 * max(done - int(x), 0) :], h[2] + max(done - int(x), 0), h[3]) for h, x in zip(held[k:], begins[k:])]
            held = rest
            return pd.DataFrame(rows, columns=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for frame in frames(batches, text, p.block_chars):
            texts = [x if isinstance(x, str) else "" for x in frame[text]]
            for key, ids in zip(frame[id_col].tolist(), encode(texts)):
                held.append((None if key != key else key, ids + end, 0, len(ids) // 4 + 1))
            yield windows(False)
        if held:
            yield windows(True)
        encode.forget()  # the worker stays for other stages
        trim()

    return docs.select(F.col(id_col), F.col(text)).mapInPandas(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
