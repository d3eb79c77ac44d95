"""License scans by template-markup matching.

A template is words with markup: ``[[ ... ]]`` encloses an optional region and ``{a-b}`` a
replaceable region of a to b words of any wording.  Each template is compiled into a token automaton: states are
positions between tokens, optional regions add empty moves around them, replaceable ones a bounded
chain of any-word moves.  A text is accepted only where every mandatory word matches exactly.

Words of the templates form a small vocabulary whose 64-bit hashes are looked for in numpy over
all words of a block; the automata run only near a template's rarest word and compare the bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from itemloom.llm.textops import ALNUM, LOWER, Rolling, blocks
from itemloom.llm.workspace import small_batches

#: Plain phrases, and the label that each stands for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates by label; the word in the second place is the rarest, near which the automaton runs.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license [[version]] 2 0 [[the license]]", "apache"),
    "mit": ("[[this {1-3}]] [[is]] [[released]] [[licensed]] [[distributed]] under the mit license", "mit"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this {1-8} to deal in the {1-8} without restriction", "hereby"),
    "gpl-3.0": ("licensed under the [[terms of the]] [[gnu]] general public license [[as published by the free software foundation]] [[either]] version 3", "license"),
    "gpl-2.0": ("licensed under the [[terms of the]] [[gnu]] general public license [[as published by the free software foundation]] [[either]] version 2", "license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    "cc-by-4.0": ("licensed under [[a]] [[the]] cc by 4 0", "cc"),
    "cc-by-sa-4.0": ("licensed under [[a]] [[the]] cc by sa 4 0", "cc"),
    "cc-by-nc-4.0": ("licensed under [[a]] [[the]] cc by nc 4 0", "cc"),
    "copyright": ("copyright [[c]] {1-2} {1-8} all rights reserved", "reserved"),
}


@dataclass
class Automaton:
    """Moves from each state: by a word, by any word, and without one."""

    template: str
    by_word: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any_word: list[int | None] = field(default_factory=lambda: [None])
    empty: list[set[int]] = field(default_factory=lambda: [set()])
    words: int = 0

    def __post_init__(self) -> None:
        opened: list[int] = []
        for token in re.findall(r"\[\[|\]\]|\{\d+-\d+\}|[^\s\[\]{}]+", self.template):
            if token == "[[":
                opened.append(self._last)
            elif token == "]]":
                self.empty[opened.pop()].add(self._last)
            elif m := re.fullmatch(r"\{(\d+)-(\d+)\}", token):
                exits = []
                for k in range(int(m[2])):
                    if k >= int(m[1]):
                        exits.append(self._last)
                    state = self._last
                    self.any_word[state] = self._new()
                for state in exits:
                    self.empty[state].add(self._last)
            else:
                self.words += not opened
                state = self._last
                self.by_word[state][token.encode()] = self._new()
        if opened:
            raise ValueError(f"an optional region isn't closed: {self.template}")

    @property
    def _last(self) -> int:
        return len(self.empty) - 1

    def _new(self) -> int:
        self.by_word.append({})
        self.any_word.append(None)
        self.empty.append(set())
        return self._last

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.empty[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    @cached_property
    def first(self) -> set[bytes] | None:
        """Words that can begin a match; None if any word can."""
        states = self._close({0})
        if any(self.any_word[s] is not None for s in states):
            return None
        return set().union(*(self.by_word[s] for s in states))

    @property
    def longest(self) -> int:
        return len(self.empty) - 1

    def accepts(self, tokens: list[bytes]) -> bool:
        """Whether a match begins at the first token."""
        states = self._close({0})
        for token in tokens:
            states = {t for s in states for t in (self.by_word[s].get(token), self.any_word[s]) if t is not None}
            if not states:
                return False
            if self._last in self._close(states):
                return True
        return False


def _hash(word: str) -> np.uint64:
    buf = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return Rolling(buf)(np.array([0]), np.array([len(buf)]))[0]


def scan(docs: DataFrame, keep: list[str], text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``keep`` columns and what each whole text holds.

    Words are runs of a-z (A-Z folded), digits and non-ASCII characters.  Null and empty texts
    give zero counts, null places, empty labels and score 0.0.  Rows are scanned one by one:
    repeated rows repeat, an empty table gives no rows, other columns are ignored.

    Columns: n_words, n_base (all places of plain phrases, overlapping ones included),
    first_word, last_word, base_labels, labels, score (1.0 if a template is accepted, else 0.5
    if a phrase is found, else 0.0).
    """
    small_batches(docs.sparkSession)
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + ["n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
        automata = [(Automaton(t), anchor.encode(), label) for label, (t, anchor) in templates.items()]
        rare = [words[-1] for words, _ in plain] + [anchor for _, anchor, _ in automata]
        rare_hash = {w: _hash(w.decode()) for w in rare}
        wanted = np.unique(np.array(list(rare_hash.values()), np.uint64))
        for block in blocks(batches, text):
            words = block.words(ALNUM)
            h, counts = words.hashes(), words.counts()
            places: list[list[int]] = [[] for _ in counts]
            base: list[set[str]] = [set() for _ in counts]
            found: list[set[str]] = [set() for _ in counts]
            first_of = np.concatenate(([0], np.cumsum(counts)))
            raw = block.buf.tobytes()
            word = lambda k: raw[words.start[k] : words.end[k]]  # noqa: E731, B023
            at = np.flatnonzero(np.isin(h, wanted))
            for k, value in zip(at.tolist(), h[at].tolist()):
                d = int(words.doc[k])
                low, high = int(first_of[d]), int(first_of[d + 1])
                for seq, label in plain:
                    if rare_hash[seq[-1]] == value and k - len(seq) + 1 >= low and all(word(k - len(seq) + 1 + i) == w for i, w in enumerate(seq)):
                        places[d].append(k - len(seq) + 1 - low)
                        base[d].add(label)
                for automaton, anchor, label in automata:
                    if rare_hash[anchor] == value and label not in found[d]:
                        begin = max(low, k - automaton.longest + 1)
                        tokens = [word(i) for i in range(begin, min(high, k + automaton.longest))]
                        if any((automaton.first is None or tokens[i] in automaton.first) and automaton.accepts(tokens[i : i + automaton.longest]) for i in range(k - begin + 1)):
                            found[d].add(label)
            yield block.frame[keep].assign(
                n_words=counts, n_base=[len(p) for p in places],
                first_word=pd.array([min(p) if p else None for p in places], "Int64"), last_word=pd.array([max(p) if p else None for p in places], "Int64"),
                base_labels=[",".join(sorted(b)) for b in base], labels=[",".join(sorted(b | f)) for b, f in zip(base, found)],
                score=[1.0 if f else 0.5 if b else 0.0 for b, f in zip(base, found)],
            )

    return docs.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)
