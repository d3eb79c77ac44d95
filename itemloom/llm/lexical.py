"""Ranked lexical search over an inverted index in shards.

*Index.*  A shard is what one task reads until it holds ``SHARD`` postings: its documents are put
into the order of their ids and numbered, and each of its terms gets one row with its postings by
document, as gaps and frequencies in variable-length bytes.  Building it shuffles nothing; the index
is a table that any number of searches may read.

*Search.*  Items come in blocks, and each (shard, block of items) meets in one task, which needs the
shard's postings of the block's terms only.  An item's lists are merged document at a time: a heap
holds the next document of each list, and a bounded heap the best results by (score, id).  Lists
whose largest contributions together can't lift a document over the worst kept result are left out
of the merge and looked up only for candidates, which changes no result.  A global merge keeps the
best of all shards.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.textops import ALNUM, LOWER, Block, slices, trim, unique_per_doc
from itemloom.llm.workspace import Workspace, small_batches

#: Postings of a shard, and items of a block.
SHARD, ITEMS = 2_000_000, 256
#: Digits, letters and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on as bytes of seven bits, lowest first; and where each begins, with the end."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[:-1][has] + k] = (values[has] >> np.uint64(7 * k)) & np.uint64(127) | np.where(size[has] > k + 1, 128, 0).astype(np.uint64)
    return out, at


def decode(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


class _Shard:
    """Postings of the documents seen so far."""

    def __init__(self):
        self.ids, self.lengths, self.doc, self.term, self.tf, self.names = [], [], [], [], [], {}
        self.docs = self.postings = 0

    def add(self, part: pa.RecordBatch) -> None:
        texts = part.column("text").cast(pa.binary()).to_pylist()
        buf = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        words = Block(None, buf, np.concatenate(([0], ends[:-1])), ends - 1).words(ALNUM)
        lengths = words.counts()
        some = np.flatnonzero(lengths)
        if not len(some):
            return
        h = words.hashes()
        distinct, at = np.unique(h, return_index=True)
        for key, a, b in zip(distinct.tolist(), words.start[at].tolist(), words.end[at].tolist()):
            if key not in self.names:
                self.names[key] = buf[a:b].tobytes()
        doc, term, tf = unique_per_doc(words.doc, h)
        self.doc.append(np.searchsorted(some, doc) + self.docs)
        self.term.append(term)
        self.tf.append(tf)
        self.ids.append(part.column("id").take(pa.array(some)))
        self.lengths.append(lengths[some])
        self.docs += len(some)
        self.postings += len(doc)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """One row for the documents, with their ids in order and their lengths, then one for each term."""
        ids, lengths = pa.concat_arrays(self.ids), np.concatenate(self.lengths)
        order = pc.sort_indices(ids).to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        doc, term, tf = number[np.concatenate(self.doc)], np.concatenate(self.term), np.concatenate(self.tf)
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        gaps = np.concatenate(([0], np.diff(doc)))
        gaps[first] = doc[first]
        data, at = encode(np.stack([gaps, tf], 1).ravel())
        coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(at[2 * first], at[-1]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        names = pa.array([self.names[k] for k in term[first].tolist()], pa.binary()).cast(pa.string())
        df = np.diff(np.append(first, len(term)))
        ids = ids.take(pa.array(order))
        one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        fields = ["shard", "term", "df", "words", "postings", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([None], pa.string()), pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([encode(lengths[order])[0].tobytes()], pa.binary()), one], fields)
        for a in range(0, len(first), 20_000):
            n = min(20_000, len(first) - a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), names.slice(a, n), pa.array(df[a : a + n]), pa.nulls(n, pa.int64()), coded.slice(a, n), pa.nulls(n, one.type)], fields)


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """Rows of the index: shard, term, df, words, postings, ids.

    The row without a term holds a shard's documents that have terms: how many (df), all their words,
    their lengths (postings) and their ids in order.  Only A-Z are lower-cased.  Null texts have no
    terms, rows of null id aren't indexed, rows that repeat are documents of their own.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, number = _Shard(), 0, 0
        for batch in slices(batches):
            part = batch.column("part")[0].as_py()
            now.add(batch)
            if now.postings >= shard:
                yield from now.rows(part << 32 | number)
                now, number = _Shard(), number + 1
        if now.docs:
            yield from now.rows(part << 32 | number)
        del now
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"shard long, term string, df long, words long, postings binary, ids array<{kind}>")


def merge(lists: list[tuple[list[int], list[int], int]], top: int) -> list[tuple[int, int]]:
    """The ``top`` documents of largest summed contributions above 0, as (score, document), best first, ties to the smaller number.

    A list has ascending documents, a contribution each, and the largest of these.
    """
    lists = sorted(lists, key=lambda x: x[2])
    bound = [0]  # of all lists up to each
    for x in lists:
        bound.append(bound[-1] + x[2])
    places = [0] * len(lists)
    best: list[tuple[int, int]] = []
    least = 0  # a result must have more
    optional = 0
    while optional < len(lists) and bound[optional + 1] <= least:
        optional += 1
    heap = [(x[0][0], k) for k, x in enumerate(lists) if k >= optional]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            k = heap[0][1]
            if k < optional:  # since it was put there, the list has become one to be looked up
                heapq.heappop(heap)
                continue
            docs, parts, _ = lists[k]
            at = places[k]
            score += parts[at]
            places[k] = at = at + 1
            if at < len(docs):
                heapq.heapreplace(heap, (docs[at], k))
            else:
                heapq.heappop(heap)
        k = optional - 1
        while k >= 0 and score + bound[k + 1] > least:
            docs, parts, _ = lists[k]
            places[k] = at = bisect_left(docs, doc, places[k])
            if at < len(docs) and docs[at] == doc:
                score += parts[at]
            k -= 1
        if k < 0 and score > least:
            if len(best) == top:
                heapq.heapreplace(best, (score, -doc))
            else:
                heapq.heappush(best, (score, -doc))
            if len(best) == top:
                least = best[0][0]
                while optional < len(lists) and bound[optional + 1] <= least:
                    optional += 1
    return [(score, -doc) for score, doc in sorted(best, reverse=True)]


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text: str = "text", id_col: str = "doc_id", top: int = 50, block: int = ITEMS) -> DataFrame:
    """The ``top`` documents of each item by BM25 in whole numbers: item_col, rank from 1, id_col, score.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score sums, over the item's
    distinct terms, weight * (10**9 tf div (1000 tf + 20 m)) with m = 50 + (50 n N div L).  Documents of
    score 0 aren't found; ties go to the smaller id.  Items of one id are one item, items of null id or
    without a known term find nothing.  ``index`` is a table that ``build_index`` made.
    """
    lower = F.translate(F.col(text), _UPPER, _LOWER)
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(f"({TERM})")))).alias("term")).distinct()
    count = asked.agg(F.count_distinct("item").alias("n")).first()["n"]
    blocks = max(1, -(-count // block))
    total = index.where("term is null").agg(F.sum("df").alias("n"), F.sum("words").alias("l")).first()
    n, words = int(total["n"] or 0), int(total["l"] or 1)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    found = index.where("term is not null").join(asked.select("term").distinct(), "term").select("shard", "term", "df", "postings")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2) / (2 * F.sum("df") + 1).cast("double"))).cast("long").alias("weight")
    wanted = asked.groupBy("block", "term").agg(F.collect_list("item").alias("items"))  # at most a block's items
    wanted = wanted.join(found.groupBy("term").agg(weight), "term")
    kind, key = index.schema["ids"].dataType.elementType.simpleString(), items.schema[item_col].dataType.simpleString()
    lists = found.join(wanted, "term").select("shard", "block", "term", "weight", "items", "postings", F.lit(None).cast(f"array<{kind}>").alias("ids"))
    empty = F.lit(None).cast("long").alias("weight"), F.lit(None).cast(f"array<{key}>").alias("items")
    heads = index.where("term is null").select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", *empty, "postings", "ids")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["term"].isna()].iloc[0]
        m = 50 + 50 * decode(head["postings"]) * n // words
        own: dict[object, list] = {}
        for weight, who, raw in group.loc[group["term"].notna(), ["weight", "items", "postings"]].itertuples(index=False):
            coded = decode(raw)
            docs, tf = np.cumsum(coded[::2]), coded[1::2]
            parts = int(weight) * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
            entry = docs.tolist(), parts.tolist(), int(parts.max())
            for item in who:
                own.setdefault(item, []).append(entry)
        out = [(item, doc, score) for item, lists in own.items() for score, doc in merge(lists, top)]
        frame = pd.DataFrame(out, columns=["item", "id", "score"])
        frame["id"] = np.asarray(head["ids"])[frame["id"].to_numpy(np.int64)]
        return frame

    best = lists.unionByName(heads).groupBy("shard", "block").applyInPandas(run, f"item {key}, id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = 50, shard: int = SHARD, block: int = ITEMS) -> DataFrame:
    """``search`` over an index of ``docs`` that is written to the shared folder."""
    space = Workspace(docs.sparkSession)
    index = space.save(build_index(docs, id_col, text, shard), "index")
    return search(index, items, item_col, item_text, id_col, top, block)
