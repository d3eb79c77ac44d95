"""Removal of long passages that an earlier document holds too, by compaction of a De Bruijn graph of words.

Edges of the graph are windows of ``k`` words.  Written one by one they would be as many rows as the
corpus has words, so they travel as *stretches*: the consecutive windows whose smallest hash of
``PROBE`` words is the same one.  Equal windows have it at equal places, so a window can only meet
its equal in stretches that share this hash.

1. *Edges.*  Stretches are counted by the 128-bit hash of their words and offset, with the
   coordinates of the first document that holds them (the source) and the stretch that follows.
2. *Compaction.*  A stretch all of whose places are followed by one and the same stretch, as often
   as that one is found at all, doesn't branch.  A join of each stretch with the one that follows
   finds these links, and the sources' coordinates verify them: both must stand one after the other in the same
   source.  Linked stretches are one path, so that only the path's head meets its places again.
3. *Branches.*  Where different stretches share a hash, a path may fork inside them.  Their windows'
   own 128-bit hashes meet by the shared hash, and the smallest document of each window is found.  A hash
   that more than ``hot`` different stretches share isn't gathered into one task: its windows are spread by
   their own hashes, which gives the same result.

All keys are aggregated before they are joined; keys with more than one in 10,000 of all rows are
fewer than 10,000, so they are broadcast and their rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.periodic import WORD
from itemloom.llm.suffix_dedup import _keyed, _triggers
from itemloom.llm.textops import _BASE, _INVERSE, NOT_SPACE, Block, Rolling, blocks, mix, powers, slices, trim
from itemloom.llm.workspace import Workspace

#: Words whose hash chooses the stretch of a window.
PROBE = 10


class _Grams:
    """Hashes of stretches of consecutive words, from prefix sums of a polynomial over the words' hashes."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(_BASE, len(words)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(words) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def _word_grams(block: Block) -> tuple[_Grams, _Grams, np.ndarray, np.ndarray]:
    """Two independent hashes of word stretches, the words' documents, and each document's first word."""
    words = block.words(NOT_SPACE)
    one, two = (_Grams(words.hashes(Rolling(block.buf, which))) for which in (0, 1))
    return one, two, words.doc, np.searchsorted(words.doc, np.arange(len(block.start) + 1))


def stretches(rows: DataFrame, k: int) -> DataFrame:
    """Stretches of (uid, id, text): probe, c1 and c2 of the words with the probe's offset, the first hash of what follows (0: nothing), first and last window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(batches, lower=False):
            one, two, doc, low = _word_grams(block)
            n = len(doc)
            if n < k:
                continue
            at = np.arange(n - PROBE + 1)
            h = one(at, at + PROBE)
            probe = _triggers(h, k - PROBE + 1)
            starts = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (probe[starts[1:]] != probe[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
            head = np.flatnonzero(new)
            a, b = starts[head], starts[np.append(head[1:], len(starts)) - 1]
            j, d = probe[a], doc[a]
            offset = (j - a).astype(np.uint64)
            c1, c2 = (mix(g(a, b + k) ^ offset).view(np.int64) for g in (one, two))
            follows = np.zeros(len(a), np.int64)
            follows[:-1] = np.where(d[1:] == d[:-1], c1[1:], 0)
            yield pd.DataFrame({"uid": block.frame["uid"].to_numpy()[d], "id": block.frame["id"].to_numpy()[d], "probe": h[j].view(np.int64), "c1": c1, "c2": c2, "follows": follows, "first": a - low[d], "last": b - low[d]})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("uid", "id", "text").mapInPandas(run, f"uid long, id {kind}, probe long, c1 long, c2 long, follows long, first long, last long")


def pack(rows: DataFrame, keep: list[str]) -> DataFrame:
    """uid, the text's UTF-8 compressed for the shuffle, and further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for part in batches:
            packed = pa.array([press(x) for x in part.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("uid"), packed, *(part.column(c) for c in keep)], ["uid", "packed", *keep])

    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("uid", "text", *keep).mapInArrow(run, f"uid long, packed binary{kinds}")


def paths(kinds: DataFrame) -> DataFrame:
    """Non-branching paths of stretches that several documents hold: c1 and c2 of the head, times, its source, windows.

    ``kinds`` has one row a stretch: c1, c2, times, source (id, uid, first, last), top (largest id),
    lo and hi (least and greatest of what follows).
    """
    shared = kinds.where("source.id < top").select("c1", "c2", "times", "source", "lo", "hi")
    before = shared.where("lo = hi and lo <> 0").select(F.col("lo").alias("c1"), "times", F.col("source.uid").alias("uid"), (F.col("source.last") + 1).alias("at"))
    inner = before.join(shared.select("c1", "c2", "times", F.col("source.uid").alias("uid"), F.col("source.first").alias("at")), ["c1", "times", "uid", "at"]).select("c1", "c2").withColumn("inner", F.lit(1))
    marked = shared.join(inner, ["c1", "c2"], "left")
    # A path's stretches stand one after the other in its source: each head opens a new one.
    order = Window.partitionBy("source.uid").orderBy("source.first")
    numbered = marked.withColumn("path", F.count(F.when(F.col("inner").isNull(), 1)).over(order))
    head = F.min_by(F.struct("c1", "c2", "times", "source"), "source.first").alias("head")
    return numbered.groupBy("source.uid", "path").agg(head, F.max("source.last").alias("last")).select("head.c1", "head.c2", "head.times", F.col("head.source.id").alias("source"), (F.col("last") - F.col("head.source.first")).alias("windows"))


def _pieces(rows: DataFrame, forks: DataFrame, k: int) -> DataFrame:
    """``forks`` with the hashes of their windows, two numbers each, as bytes."""
    piece = F.struct("probe", "many", "c1", "c2", "times", "source.first", "source.last").alias("piece")
    wanted = forks.select("source.uid", "source.id", piece).groupBy("uid").agg(F.first("id").alias("id"), F.collect_list("piece").alias("pieces"))  # bounded by the text's length
    fields = ["probe", "many", "c1", "c2", "times", "first"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor().decompress
        for frame in batches:
            out = []
            for uid, key, packed, pieces in zip(frame["uid"], frame["id"], frame["packed"], frame["pieces"]):
                buf = np.frombuffer(open_(packed) + b"\n", np.uint8)
                one, two, _, _ = _word_grams(Block(None, buf, np.zeros(1, np.int64), np.array([len(buf) - 1])))
                for p in pieces:
                    at = np.arange(p["first"], p["last"] + 1)
                    out.append((uid, key, *(p[c] for c in fields), np.stack([one(at, at + k), two(at, at + k)], 1).tobytes()))
            yield pd.DataFrame(out, columns=["uid", "id", *fields, "windows"])
        trim()

    kind = rows.schema["id"].dataType.simpleString()
    return pack(rows, []).join(wanted, "uid").mapInPandas(run, f"uid long, id {kind}, probe long, many long, c1 long, c2 long, times long, first long, windows binary")


def _opened(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some pieces: their hashes, their pieces' numbers and their offsets."""
    size = frame["windows"].str.len().to_numpy(np.int64) // 16
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.frombuffer(b"".join(frame["windows"]), np.int64).reshape(-1, 2), np.repeat(np.arange(len(size)), size), offset


_HIT = ["c1", "c2", "times", "id", "uid"]


def _hit_schema(kind: str) -> str:
    return f"c1 long, c2 long, times long, id {kind}, uid long, at long, offset short"


def _by_probe(pieces: DataFrame, kind: str, batch: int = 4000) -> DataFrame:
    """Windows that a piece of a smaller id has too, found among the pieces of one probe, whole probes at a time."""

    def find(group: pd.DataFrame) -> pd.DataFrame:
        w, piece, offset = _opened(group)
        order = np.unique(group["id"].to_numpy(), return_inverse=True)[1][piece]
        by = np.lexsort((order, w[:, 1], w[:, 0]))
        first = np.flatnonzero(np.concatenate(([True], (w[by[1:]] != w[by[:-1]]).any(axis=1))))
        least = np.repeat(order[by[first]], np.diff(np.append(first, len(by))))
        hit = by[order[by] > least]
        return group.iloc[piece[hit]][[*_HIT, "first"]].assign(at=lambda x: x["first"] + offset[hit], offset=offset[hit].astype(np.int16)).drop(columns="first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in batches:
            kept = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            while len(kept) > batch:
                keys = kept["probe"].to_numpy()
                cut = int(np.searchsorted(keys, keys[batch])) or int(np.searchsorted(keys, keys[0], "right"))
                if cut == len(kept):
                    break
                yield find(kept[:cut].reset_index(drop=True))
                kept = kept[cut:].reset_index(drop=True)
        if kept is not None and len(kept):
            yield find(kept)
        del kept
        trim()

    return pieces.repartition("probe").sortWithinPartitions("probe").mapInPandas(run, _hit_schema(kind))


def _by_window(pieces: DataFrame, kind: str, space: Workspace) -> DataFrame:
    """The same for probes with very many pieces: each window is a row that goes where its own hash says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            w, piece, offset = _opened(frame)
            yield frame.iloc[piece][[*_HIT, "first"]].assign(at=lambda x: x["first"] + offset, offset=offset.astype(np.int16), w1=w[:, 0], w2=w[:, 1]).drop(columns="first")

    windows = space.save(pieces.mapInPandas(run, f"{_hit_schema(kind)}, w1 long, w2 long"), "windows")
    least = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("w1", "w2", "rows", "least")
    least = space.save(least, "least")
    return _keyed(windows, least, ["w1", "w2"], "rows", windows.count()).where("id > least").select(*_HIT, "at", "offset")


def repeated_windows(rows: DataFrame, k: int, hot: int, space: Workspace) -> DataFrame:
    """Runs (uid, first, last) of starts of windows that start in a row of smaller id too; rows has uid, id (never null) and text."""
    kind = rows.schema["id"].dataType.simpleString()
    every = space.save(stretches(rows, k), "stretches")
    # A hash that only one id has can't begin a repeat; most are, so that only few stretches are kept.
    hashes = every.groupBy("probe").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"), F.max("id").alias("most"))
    hashes = space.save(hashes.where("least < most").select("probe", "rows"), "hashes")
    found = space.save(_keyed(every, hashes, ["probe"], "rows", every.count(), "left_semi"), "found")
    space.drop("stretches", "hashes")
    space.tidy()
    source = F.min(F.struct("id", "uid", "first", "last")).alias("source")
    kinds = found.groupBy("c1", "c2").agg(F.min("probe").alias("probe"), F.count(F.lit(1)).alias("times"), source, F.max("id").alias("top"), F.min("follows").alias("lo"), F.max("follows").alias("hi"))
    kinds = space.save(kinds, "kinds")
    counted = kinds.agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("rows")).first()
    n_kinds, total = int(counted["kinds"]), int(counted["rows"] or 0)
    space.tidy()
    probes = space.save(kinds.groupBy("probe").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "probes")
    most = probes.agg(F.max("many")).first()[0] or 0
    pieces = _pieces(rows, _keyed(kinds, probes.withColumn("rows", F.col("many")), ["probe"], "rows", n_kinds), k)
    if most > hot:
        pieces = space.save(pieces, "pieces")
        hits = _by_probe(pieces.where(F.col("many") <= hot), kind).unionByName(_by_window(pieces.where(F.col("many") > hot), kind, space))
    else:
        hits = _by_probe(pieces, kind)
    hits = space.save(hits, "hits")
    space.drop("pieces", "windows", "least", "probes")
    space.tidy()
    once = hits.where("times = 1").select("uid", F.col("at").alias("first"), F.col("at").alias("last"))
    # A stretch found more than once may stand in its source again: its places are looked up, together with those of the paths.
    again = hits.where("times > 1").groupBy("c1", "c2").agg(F.first("times").alias("times"), F.first("id").alias("source"), F.collect_set("offset").alias("offsets"))  # at most k
    again = again.select("c1", "c2", "times", "source", "offsets", F.lit(None).cast("long").alias("windows"))
    heads = paths(kinds).select("c1", "c2", "times", "source", F.lit(None).cast("array<short>").alias("offsets"), "windows")
    keys = again.unionByName(heads).groupBy("c1", "c2").agg(F.max("times").alias("times"), F.min("source").alias("source"), F.max("offsets").alias("offsets"), F.max("windows").alias("windows"))
    keys = space.save(keys, "keys")
    met = _keyed(found.select("c1", "c2", "uid", "id", "first"), keys, ["c1", "c2"], "times", total)
    later = met.where("id > source and windows is not null").select("uid", "first", (F.col("first") + F.col("windows")).alias("last"))
    inside = met.where("id = source and offsets is not null").select("uid", F.explode("offsets").alias("offset"), "first").select("uid", (F.col("first") + F.col("offset")).alias("first"), (F.col("first") + F.col("offset")).alias("last"))
    return later.unionByName(inside).unionByName(once)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 50, hot: int = 20_000) -> DataFrame:
    """Removes each word covered by ``k`` consecutive words that also start in a row of smaller id.

    Words are stretches without ASCII white space; passages never cross texts, and all are judged on
    the input.  Null text has no words.  Rows of the same id don't remove each other's words, and a
    row of null id neither loses words nor takes any from others.

    Columns: id_col, n_words, n_removed, spans (array of start and end, word numbers), kept (the
    words that stay, joined by one space).
    """
    space = Workspace(docs.sparkSession)
    rows = docs.select(F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit(""))).alias("uid"), F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    starts = repeated_windows(rows.where("id is not null"), k, hot, space)
    spans = space.save(starts.groupBy("uid").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "runs")  # bounded by the text's length
    space.drop("found", "kinds", "hits", "keys")
    space.tidy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for part in slices(batches, "packed"):
            n_words, n_removed, spans, kept = [], [], [], []
            for packed, runs in zip(part.column("packed").to_pylist(), part.column("runs").to_pylist()):
                words = WORD.findall(open_(packed).decode())
                gone: list[list[int]] = []
                for first, last in sorted((r["first"], r["last"]) for r in runs or []):
                    if gone and first <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], last + k)
                    else:
                        gone.append([first, last + k])
                edges = [0, *(e for span in gone for e in span), len(words)]
                stay = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(" ".join(stay))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "spans", "kept"])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    out = pack(rows, ["id"]).join(spans, "uid", "left").select("id", "packed", "runs").mapInArrow(run, f"id {kind}, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
    return out.withColumnRenamed("id", id_col)
