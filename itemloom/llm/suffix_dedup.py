"""Exact removal of long repeated byte strings, by prefix-free parsing.

1. *Parse.*  A rolling hash over ``TRIGGER`` bytes puts a trigger into every window of ``length``
   bytes: the leftmost position of the smallest hash in it.  Equal windows have equal triggers, at
   equal offsets, so triggers cut all texts into phrases consistently without reading any other
   text.  A *context* is the text of all windows that share one trigger (a phrase and what follows
   it): at most ``2 * length`` bytes.
2. *Dictionary.*  Contexts are counted by (trigger hash, context hash), 128 bits, before anything is
   joined.  A trigger found once can't begin a repeat; a context found twice is repeated as a whole.
   Only distinct contexts that share a trigger with a different one are left, and only their text is
   shuffled.  Triggers and contexts that hold more than one in 10,000 of all rows are fewer than
   10,000, so they are broadcast and their rows stay where they are.
3. *Corpus order.*  Contexts of one trigger are put into the order of what follows the trigger
   (the parse's suffix array, with common-prefix lengths between neighbours), and refined, byte by
   byte to the left, by what precedes it (the suffixes of dictionary phrases).  Two windows are
   equal just if they agree in both ranks; no window is ever spelled out.

A trigger with more than ``hot`` different contexts isn't gathered into one task: its windows are
spread by their own hashes and counted with a partial aggregate, which gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.textops import Rolling, blocks, mix, trim, utf8
from itemloom.llm.workspace import Workspace

TRIGGER = 24
_POSITION_BITS = np.uint64(24)
_CHUNK = 1 << 22


def _triggers(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the smallest hash (leftmost if tied) among h[i : i + window], for each i."""
    out = np.empty(len(h) - window + 1, np.int64)
    for at in range(0, len(out), _CHUNK):
        n = min(_CHUNK, len(out) - at)
        part = h[at : at + n + window - 1]
        rows = -(-len(part) // window)
        packed = np.full(rows * window, np.iinfo(np.uint64).max, np.uint64)
        packed[: len(part)] = (part >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(part), dtype=np.uint64)
        packed = packed.reshape(rows, window)
        before = np.minimum.accumulate(packed, axis=1).ravel()
        after = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(after[:n], before[window - 1 : window - 1 + n])
        out[at : at + n] = (low & np.uint64((1 << 24) - 1)).astype(np.int64) + at
    return out


def _row_key(docs: DataFrame, id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit("")))


def parse(rows: DataFrame, length: int) -> DataFrame:
    """Contexts of (uid, text): hashes of the trigger and the context, first and last window, trigger's offset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(batches, "text", lower=False):
            n = len(block.buf)
            if n < length:
                continue
            rolling = Rolling(block.buf)
            at = np.arange(n - TRIGGER + 1)
            h = rolling(at, at + TRIGGER)
            trigger = _triggers(h, length - TRIGGER + 1)
            starts = np.arange(len(trigger))
            doc = np.searchsorted(block.start, starts, "right") - 1
            starts = starts[starts + length <= block.end[doc]]
            if not len(starts):
                continue
            trigger, doc = trigger[starts], doc[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
            first = np.flatnonzero(new)
            a, b = starts[first], starts[np.append(first[1:], len(starts)) - 1]
            j, d = trigger[first], doc[first]
            context = mix(rolling(a, b + length) ^ (j - a).astype(np.uint64))
            low = block.start[d]
            yield pd.DataFrame({"uid": block.frame["uid"].to_numpy()[d], "trigger": h[j].view(np.int64), "context": context.view(np.int64), "first": a - low, "last": b - low, "at": (j - a).astype(np.int32)})

    return rows.mapInPandas(run, "uid long, trigger long, context long, first long, last long, at int")


def _equal_windows(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """Starts of windows of found-once contexts that another context of the same trigger holds too.

    ``group`` has whole triggers, one row for each distinct context.
    """
    at, size = group["at"].to_numpy(np.int64), (group["last"] - group["first"]).to_numpy(np.int64)
    left = [t[:k] for t, k in zip(group["piece"], at)]
    right = [t[k : k + length] for t, k in zip(group["piece"], at)]
    _, key = np.unique(group["trigger"].to_numpy(), return_inverse=True)
    order = np.array(sorted(range(len(right)), key=lambda i: (key[i], right[i])), np.int64)
    # The parse's suffix array, and how many bytes neighbours share.
    wide = np.zeros((len(right), length + 1), np.int16)
    for row, i in enumerate(order):
        wide[row, : len(right[i])] = np.frombuffer(right[i], np.uint8).astype(np.int16) + 1
    differ = wide[1:] != wide[:-1]
    differ[:, length] = True
    shared = np.where(key[order[1:]] == key[order[:-1]], differ.argmax(axis=1), -1)
    # Padding equals padding, but no window reaches beyond its own text, so that never counts.
    back = np.zeros((int(at.max(initial=0)) + 1, len(left)), np.int16)
    for col, i in enumerate(order):
        text = left[i]
        if text:
            back[1 : len(text) + 1, col] = np.frombuffer(text, np.uint8)[::-1].astype(np.int16) + 1
    at, size, single, group_id = at[order], size[order], group["single"].to_numpy()[order], key[order].astype(np.int64)
    found = []
    for d in range(len(back)):  # windows that begin d bytes before their trigger
        live = np.flatnonzero((at >= d) & (at - size <= d))
        if d:
            _, group_id = np.unique(group_id * 512 + back[d], return_inverse=True)
        if len(live) < 2:
            continue
        rank = np.concatenate(([0], np.cumsum(shared < length - d)))[live]
        pair = group_id[live] * np.int64(len(at)) + rank
        _, place, count = np.unique(pair, return_inverse=True, return_counts=True)
        hit = live[(count[place] > 1) & single[live]]
        if len(hit):
            found.append((hit, at[hit] - d))
    if not found:
        return pd.DataFrame({"uid": np.zeros(0, np.int64), "first": np.zeros(0, np.int64), "last": np.zeros(0, np.int64)})
    who, offset = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    by = np.lexsort((offset, who))
    who, offset = who[by], offset[by]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(who)) - 1
    rows = order[who[begin]]
    base = group["first"].to_numpy(np.int64)[rows]
    return pd.DataFrame({"uid": group["uid"].to_numpy()[rows], "first": base + offset[begin], "last": base + offset[end]})


_STARTS = "uid long, first long, last long"


def _by_order(contexts: DataFrame, length: int, batch: int = 1500) -> DataFrame:
    """Equal windows among contexts of the same trigger, whole triggers at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in batches:
            kept = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            while len(kept) > batch:
                keys = kept["trigger"].to_numpy()
                # A repeated row of the input has its context twice; one is enough.
                cut = int(np.searchsorted(keys, keys[batch]))
                if cut == 0:
                    cut = int(np.searchsorted(keys, keys[0], "right"))
                    if cut == len(kept):
                        break
                yield _equal_windows(kept[:cut].drop_duplicates(["trigger", "context"]).reset_index(drop=True), length)
                kept = kept[cut:].reset_index(drop=True)
        if kept is not None and len(kept):
            yield _equal_windows(kept.drop_duplicates(["trigger", "context"]).reset_index(drop=True), length)
        del kept
        trim()

    return contexts.repartition("trigger").sortWithinPartitions("trigger").mapInPandas(run, _STARTS)


def _by_hash(contexts: DataFrame, length: int) -> DataFrame:
    """The same for triggers with very many contexts: each window goes where its own hash says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for uid, trigger, context, first, last, single, piece in zip(*(frame[c] for c in ("uid", "trigger", "context", "first", "last", "single", "piece"))):
                buf, starts = np.frombuffer(piece, np.uint8), np.arange(last - first + 1)
                one, two = (Rolling(buf, k)(starts, starts + length).view(np.int64) for k in (0, 1))
                yield pd.DataFrame({"uid": uid, "context": context, "trigger": trigger, "single": single, "first": first + starts, "one": one, "two": two})

    windows = contexts.mapInPandas(run, "uid long, context long, trigger long, single boolean, first long, one long, two long").dropDuplicates(["trigger", "context", "one", "two"])
    many = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return windows.where("single").join(many, ["one", "two"], "left_semi").select("uid", "first", F.col("first").alias("last"))


def _common(counts: DataFrame, count: str, total: int, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``counts`` in two: keys that hold more than one in ``most`` of all ``total``, so fewer than ``most`` keys, and the rest."""
    least = max(total // most, 1)
    return counts.where(F.col(count) > least), counts.where(F.col(count) <= least)


def _keyed(rows: DataFrame, keys: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys``; what belongs to a common key meets it where it is, and only the rest is shuffled.

    ``keys`` has each key once, with how many of the ``total`` rows are its own in ``count``.
    """
    common, rest = _common(keys, count, total)
    common, rest = (x.drop(count) if how == "left_semi" else x for x in (common, rest))
    here = rows.join(F.broadcast(common), on, how)  # fewer than 10,000 keys
    there = rows.join(F.broadcast(common.select(*on)), on, "left_anti").join(rest, on, how)
    return here.unionByName(there)


def repeated_starts(rows: DataFrame, length: int, hot: int, space: Workspace) -> DataFrame:
    """Runs (uid, first, last) of starts of windows that start anywhere else too; rows has uid and text."""
    contexts = space.save(parse(rows, length), "contexts")
    one = F.min(F.struct("uid", "first", "last", "at"))
    kinds = contexts.groupBy("trigger", "context").agg(F.count(F.lit(1)).alias("times"), one.alias("one"))
    by_trigger = F.sum("times").alias("rows"), F.count(F.lit(1)).alias("contexts")
    # A trigger found once can't begin a repeat; most are, so that only few kinds are kept.
    kinds = space.save(kinds, "kinds")
    triggers = space.save(kinds.groupBy("trigger").agg(*by_trigger).where("rows > 1"), "triggers")
    sizes = triggers.agg(F.max("contexts").alias("most"), F.count(F.lit(1)).alias("n")).first()
    counted = kinds.agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("rows")).first()
    total, n_kinds = int(counted["rows"] or 0), int(counted["kinds"] or 0)
    repeated = kinds.where("times > 1").select("trigger", "context", "times")
    whole = _keyed(contexts, repeated, ["trigger", "context"], "times", total, "left_semi").select("uid", "first", "last")
    differing = triggers.where("contexts > 1").select("trigger", "contexts")
    wanted = _keyed(kinds, differing, ["trigger"], "contexts", n_kinds).select("one.uid", F.struct("trigger", "context", (F.col("times") == 1).alias("single"), "contexts", "one.first", "one.last", "one.at").alias("piece"))
    wanted = wanted.groupBy("uid").agg(F.collect_list("piece").alias("pieces"))  # bounded by the text's length

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor().decompress
        for frame in batches:
            out = []
            for uid, packed, pieces in zip(frame["uid"], frame["packed"], frame["pieces"]):
                raw = open_(packed)
                out += [(uid, p["trigger"], p["context"], p["single"], p["contexts"], p["first"], p["last"], p["at"], raw[p["first"] : p["last"] + length]) for p in pieces]
            yield pd.DataFrame(out, columns=["uid", "trigger", "context", "single", "contexts", "first", "last", "at", "piece"])

    pieces = pack(rows).join(wanted, "uid").mapInPandas(cut, "uid long, trigger long, context long, single boolean, contexts long, first long, last long, at int, piece binary")
    out = whole.unionByName(_by_order(pieces.where(F.col("contexts") <= hot), length))
    if int(sizes["most"] or 0) > hot:
        out = out.unionByName(_by_hash(pieces.where(F.col("contexts") > hot), length))
    return out


def pack(rows: DataFrame) -> DataFrame:
    """uid and the text's UTF-8, compressed for the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3).compress
        for frame in batches:
            yield frame[["uid"]].assign(packed=[press(x) for x in utf8(frame["text"])])

    return rows.select("uid", "text").mapInPandas(run, "uid long, packed binary")


def _merge(spans: list, length: int, size: int) -> list[tuple[int, int]]:
    """Byte ranges covered by windows that start in the given runs, merged."""
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, min(b, size)) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 400, hot: int = 20_000, keep: list[str] | None = None) -> DataFrame:
    """Removes each byte of a text covered by a ``length``-byte string that starts anywhere else too.

    Elsewhere includes the same text, overlapping or not; strings never cross texts, and all are
    judged on the input.  Null text counts as empty.  Of rows that repeat, each is elsewhere for
    the other, so both go; a table with one short text, or none, is returned unchanged.

    Columns: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end).  With
    ``keep``, a list of further columns of docs, also kept (the bytes that stay, as text; a character
    of which only a part stays goes) and ``keep``'s columns as c0, c1, ...
    """
    space = Workspace(docs.sparkSession)
    rows = docs.select(_row_key(docs, id_col, text).alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep or [])])
    starts = repeated_starts(rows.select("uid", "text"), length, hot, space)
    spans = starts.groupBy("uid").agg(F.collect_set(F.struct("first", "last")).alias("runs"))  # bounded by the text's length
    spans = space.save(spans, "runs")
    space.drop("contexts", "kinds", "triggers")
    space.tidy()
    kind = docs.schema[id_col].dataType.simpleString()
    more = [f"c{i}" for i in range(len(keep or []))]
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    if keep is not None:
        schema = ", ".join([schema, "kept string", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in more)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for key, raw, runs in zip(frame["id"], utf8(frame["text"]), frame["runs"]):
                gone = [] if runs is None else _merge(list(runs), length, len(raw))
                edges = [0, *(e for span in gone for e in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((key, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in gone], kept.decode("utf-8", "ignore") if keep is not None else ""))
            result = pd.DataFrame(out, columns=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
            if result[id_col].isna().any():
                result[id_col] = result[id_col].astype("Int64") if kind in ("bigint", "int") else result[id_col]
            yield result.drop(columns="kept") if keep is None else result.assign(**{c: frame[c] for c in more})
        trim()

    return rows.join(spans, "uid", "left").select("id", "text", "runs", *more).mapInPandas(run, schema)
