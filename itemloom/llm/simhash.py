"""SimHash near-duplicates: a self-join of the binary trie of fingerprints.

Fingerprints are leaves of a binary trie.  The join walks pairs of trie nodes together from the
root: both nodes' children are paired, a pair of unlike children spends one error, and a pair is
pruned when its errors exceed the Hamming budget.  Budgets 1, 2, ... are walked in turn and a pair of
nodes whose leaves are all in one component already is pruned too, so a walk yields a spanning
forest (nearest links first) and never all pairs of a dense group.

The trie is dealt out by its topmost bits: each pair of subtrees within the budget is one task's
work.  The number of bits follows the number of distinct fingerprints, so that a subtree stays small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.components import components
from itemloom.llm.quality import window_hashes
from itemloom.llm.textops import ALNUM, Block, blocks, mix, unique_per_doc, utf8
from itemloom.llm.workspace import Workspace, free_name

_BITS8 = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SPACES = b"\t\n\x0b\x0c\r"


def _text_fingerprint(raw: bytes, shingle: int, seed: int, part: int = 1 << 17) -> int:
    """Fingerprint of a text's word shingles; words are runs of anything but ASCII white space."""
    words = raw.lower().translate(bytes.maketrans(_SPACES, b" " * len(_SPACES))).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, last = (end - size)[:n], np.append(end, end[-1])[min(shingle, len(words)) - 1 :][:n]
    seen, digest = np.zeros((8, 256), np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, part):  # whole text, in bounded parts
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[k : k + part].tolist(), last[k : k + part].tolist())), np.uint64, min(part, n - k))
        octets = h.view(np.uint8).reshape(-1, 8)
        for i in range(8):
            seen[i] += np.bincount(octets[:, i], minlength=256)
    bits = (2 * (seen @ _BITS8).ravel() > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp): 64-bit SimHash of XXH64 of the lower-cased (A-Z) word shingles, repeats included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            fps = [_text_fingerprint(raw, shingle, seed) for raw in utf8(frame[text])]
            yield frame[[id_col]].assign(fp=np.array(fps, np.uint64).view(np.int64))

    return docs.select(id_col, text).mapInPandas(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


class _Forest:
    """Union-find over sorted fingerprints, with a quick test of whether a range is one component."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []
        self.refresh()

    def refresh(self) -> None:
        p = np.array(self.parent)
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
        self.parent, self.root = p.tolist(), p
        self.changes = np.concatenate(([0], np.cumsum(p[1:] != p[:-1])))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        before = len(self.links)
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((i, j))
        if len(self.links) > before:
            self.refresh()

    def joined(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Whether all leaves of both nodes are in one component."""
        ch = self.changes
        return (ch[ahi - 1] == ch[alo]) & (ch[bhi - 1] == ch[blo]) & (self.root[alo] == self.root[blo])


def trie_forest(f: np.ndarray, budget: int, across: int | None = None, leaf_pairs: int = 64, chunk: int = 1 << 17) -> list[tuple[int, int]]:
    """Links (indices) of a spanning forest of distinct sorted fingerprints at most ``budget`` bits apart.

    With ``across``, only pairs of one fingerprint below and one from that index on are linked.
    """
    forest = _Forest(len(f))
    if len(f) < 2:
        return []
    for most in range(1, budget + 1):
        one = np.array([0])
        if across is None:
            stack = [(0, one, one + len(f), one, one + len(f), one * 0)]
        else:
            stack = [(0, one, one + across, one + across, one + len(f), one * 0)]
            # Subtrees' own leading bits count as the trie's first levels.
            lead = 0
            while lead < 64 and not (int(f[0]) ^ int(f[across - 1])) >> (63 - lead) and not (int(f[across]) ^ int(f[-1])) >> (63 - lead):
                lead += 1
            spent = (int(f[0]) ^ int(f[across])) >> (64 - lead) if lead else 0
            if spent.bit_count() > most:
                continue
            stack = [(lead, *stack[0][1:5], one * 0 + spent.bit_count())]
        while stack:
            depth, alo, ahi, blo, bhi, errors = stack.pop()
            if len(alo) > chunk:
                stack.append((depth, *(x[chunk:] for x in (alo, ahi, blo, bhi, errors))))
                alo, ahi, blo, bhi, errors = (x[:chunk] for x in (alo, ahi, blo, bhi, errors))
            live = ~forest.joined(alo, ahi, blo, bhi)
            alo, ahi, blo, bhi, errors = (x[live] for x in (alo, ahi, blo, bhi, errors))
            small = ((ahi - alo) * (bhi - blo) <= leaf_pairs) | (depth >= 64)
            if small.any():
                a, n, b, m = alo[small], (ahi - alo)[small], blo[small], (bhi - blo)[small]
                which = np.repeat(np.arange(len(a)), n * m)
                k = np.arange(len(which)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
                i, j = a[which] + k // m[which], b[which] + k % m[which]
                near = (i < j) & (np.bitwise_count(f[i] ^ f[j]) <= most)
                if near.any():
                    forest.add(i[near], j[near])
            alo, ahi, blo, bhi, errors = (x[~small] for x in (alo, ahi, blo, bhi, errors))
            if not len(alo):
                continue
            bit = np.uint64(63 - depth)
            amid, bmid = (np.searchsorted(f, ((f[lo] >> bit) | np.uint64(1)) << bit) for lo in (alo, blo))
            amid, bmid = np.minimum(amid, ahi), np.minimum(bmid, bhi)
            own = alo == blo
            parts = [
                (alo, amid, blo, bmid, errors), (amid, ahi, bmid, bhi, errors), (alo, amid, bmid, bhi, errors + 1),
                *(((amid[~own], ahi[~own], blo[~own], bmid[~own], errors[~own] + 1),) if not own.all() else ()),
            ]
            nxt = [np.concatenate(x) for x in zip(*parts)]
            ok = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= most)
            if ok.any():
                stack.append((depth + 1, *(x[ok] for x in nxt)))
    return forest.links


def trie_links(fps: DataFrame, budget: int, leaf: int = 1 << 15) -> DataFrame:
    """Links (table, a, b) between distinct fingerprints of a table: per pair of subtrees, a spanning forest.

    ``fps`` has table and fp, each pair once.
    """
    most = fps.groupBy("table").count().agg(F.max("count")).first()[0] or 0
    bits = min(16, max(3, math.ceil(math.log2(max(most, 1) / leaf)))) if most else 3
    masks = [m for m in range(1 << bits) if m.bit_count() <= budget]
    top = F.shiftrightunsigned("fp", 64 - bits).cast("int")
    dealt = fps.withColumn("u", top).withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).select("table", "fp", F.least("u", F.col("u").bitwiseXOR(F.col("mask"))).alias("low"), F.greatest("u", F.col("u").bitwiseXOR(F.col("mask"))).alias("high"))

    def walk(key, group: pd.DataFrame) -> pd.DataFrame:
        table, low, high = key
        f = np.sort(group["fp"].to_numpy().view(np.uint64))
        across = None if low == high else int(np.searchsorted(f, np.uint64(int(high) << (64 - bits))))
        links = [] if across is not None and across in (0, len(f)) else trie_forest(f, budget, across)
        signed = f.view(np.int64)
        return pd.DataFrame({"table": np.full(len(links), table, np.int32), "a": signed[[i for i, _ in links]], "b": signed[[j for _, j in links]]})

    return dealt.groupBy("table", "low", "high").applyInPandas(walk, "table int, a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """(id_col, fp, component): component is the smallest id reachable over links of fingerprints.

    Null and wordless texts have fingerprint 0, linked like any other.  Equal fingerprints are
    one trie leaf, so copies and repeated rows cost nothing; rows repeat in the result.  A null id
    stays null and is never a component's name unless all ids of the component are null.
    """
    space = Workspace(docs.sparkSession)
    own = space.save(fingerprints(docs, id_col, text, shingle), "fingerprints")
    leaves = space.save(own.groupBy("fp").agg(F.min(id_col).alias("least")), "leaves")
    links = trie_links(leaves.select(F.lit(0).alias("table"), "fp"), budget).select("a", "b")
    roots = components(links, space, "roots").withColumnRenamed("node", "fp")
    classes = leaves.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = classes.groupBy("root").agg(F.min("least").alias("component"))
    return own.join(classes.join(named, "root").select("fp", "component"), "fp").select(id_col, "fp", "component")


def hex_fingerprint(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _shingles(block: Block, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, by document.

    Words are runs of letters and digits.  A text with fewer words than a shingle has one shingle,
    the whole sequence; one without words has none.
    """
    found, docs = block.words(ALNUM), len(block.start)
    h, counts = found.hashes(), found.counts()
    first, value = window_hashes(found, h, shingle, by_doc=False)
    whole = np.zeros(docs, np.uint64)
    place = np.arange(len(h)) - (np.cumsum(counts) - counts)[found.doc]
    np.add.at(whole, found.doc, mix(h + place.astype(np.uint64)))
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    doc, value, _ = unique_per_doc(np.concatenate((found.doc[first], short)), np.concatenate((value, whole[short])))
    return doc, value


def signatures(rows: DataFrame, shingle: int, bands: int, per_band: int) -> DataFrame:
    """(uid, node, size, keys): hash and size of the set of lower-cased shingles, and a key a band of ``per_band`` minima.

    A set without shingles has node 0 and no keys.
    """
    factors = np.random.default_rng(13).integers(1, 1 << 63, bands * per_band, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(batches, "text", fold=str.lower):
            doc, h = _shingles(block, shingle)
            docs = len(block.start)
            node, size, keys = np.zeros(docs, np.uint64), block.per_doc(doc), [[]] * docs
            if len(doc):
                at = np.flatnonzero(np.diff(doc, prepend=-1))
                node[doc[at]] = mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at) + size[doc[at]].astype(np.uint64))
                band = mix(np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(at), 1)))
                for k, factor in enumerate(factors):
                    band[:, k // per_band] = mix(band[:, k // per_band] ^ np.minimum.reduceat(h * factor, at))
                for i, row in zip(doc[at].tolist(), band.view(np.int64)):
                    keys[i] = row
            yield pd.DataFrame({"uid": block.frame["uid"], "node": node.view(np.int64), "size": size, "keys": keys})

    return rows.mapInPandas(run, "uid long, node long, size long, keys array<long>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, set): the distinct shingles' hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(batches, "text", fold=str.lower):
            doc, h = _shingles(block, shingle)
            cut = np.searchsorted(doc, np.arange(1, len(block.start)))
            yield pd.DataFrame({"node": block.frame["node"], "set": np.split(h.view(np.int64), cut)})

    return rows.mapInPandas(run, "node long, set array<long>")


#: Groups of shingles, by their hash, of which a sketch says for each whether the set has any.
_GROUPS = 512
_WORDS = [f"w{i}" for i in range(_GROUPS // 64)]


def sketches(sets: DataFrame) -> DataFrame:
    """(node, w0, w1, ...): a bit for each group of shingles that the set has any of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                size = frame["set"].map(len).to_numpy()
                h = np.concatenate(frame["set"].to_numpy()).astype(np.int64).view(np.uint64)
                has = np.zeros((len(frame), _GROUPS), np.uint8)
                has[np.repeat(np.arange(len(frame)), size), (mix(h) % np.uint64(_GROUPS)).astype(np.int64)] = 1
                words = np.packbits(has, axis=1).view(np.int64)
                yield pd.DataFrame({"node": frame["node"]} | {w: words[:, i] for i, w in enumerate(_WORDS)})

    return sets.mapInPandas(run, ", ".join(["node long", *(f"{w} long" for w in _WORDS)]))


def _sketches_near(similarity: float) -> Column:
    """Whether the sketches w0 .. of a set of ``size`` and v0 .. of one of ``size2`` leave the similarity possible.

    A group that only one of two sets has holds a shingle that only one has, and at a Jaccard similarity of
    s or more at most (size + size2) * (1 - s) / (1 + s) shingles are in one set only: no similar pair is ruled out.
    """
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"v{w[1:]}"))) for w in _WORDS[1:]), F.bit_count(F.col("w0").bitwiseXOR(F.col("v0"))))
    return apart <= (F.col("size") + F.col("size2")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``similarity`` or more, counted exactly."""
    left, right = (sets.select(F.col("node").alias(n), F.col("set").alias(s)) for n, s in (("a", "s1"), ("b", "s2")))
    both = F.size(F.array_intersect("s1", "s2"))
    return pairs.join(right, "b").join(left, "a").where(both / (F.size("s1") + F.size("s2") - both) >= similarity).select("a", "b")


def near_roots(leaves: DataFrame, sets: DataFrame, similarity: float, space: Workspace, most: int = 16, stars: int = 8, given: DataFrame | None = None) -> DataFrame:
    """(node, root) of the components of similar nodes among those (key, node, size, weight) that share a key.

    Links (a, b) that are ``given`` count without a comparison, whether their nodes share a key or not.

    Only pairs whose nodes are in one component already are left out, which changes no component.
    The first round compares each key's node of the largest weight with the key's other nodes: with weights
    that count what a node shares, that is the text that the others are copies of.  Keys of more than one
    component stay for the next round, with another node.  As soon as the pairs left after a round are at most
    ``most`` for each row, or a round links under a hundredth of the nodes (unlike texts share the keys, and further
    rounds would leave nearly as many pairs), and after ``stars`` rounds anyhow, all of them are compared, sketches first.
    Without a column weight, all weigh the same.
    """
    leaves = leaves if "weight" in leaves.columns else leaves.withColumn("weight", F.lit(0))
    links, roots = given, None if given is None else components(given, space, "roots--1")
    short = space.save(sketches(sets), "sketches")
    short2 = short.select(F.col("node").alias("node2"), *(F.col(w).alias(f"v{w[1:]}") for w in _WORDS))
    near = _sketches_near(similarity) & _alike("size", "size2", similarity)
    few, named = False, -1
    for turn in range(stars + 1):
        every = few
        rooted = lambda: leaves.withColumn("root", F.col("node")) if roots is None else leaves.join(roots, "node", "left").select("key", "node", "size", "weight", F.coalesce("root", "node").alias("root"))
        if turn == 0:
            if not leaves.limit(1).count():
                break
        elif not few:
            parts = rooted().groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
            parts = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("own")).where("parts > 1")
            open_keys = space.save(parts.select("key", "n", ((F.col("n").cast("double") * F.col("n") - F.col("own")) / 2).alias("pairs")), f"open-{turn}")
            count = open_keys.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
            if not count.n:
                break
            # A key without unlike roots never gets any again, so its rows are left behind for good.
            leaves = space.save(leaves.join(open_keys.select("key"), "key", "left_semi"), f"rows-{turn}")
            space.drop(f"open-{turn}", f"rows-{turn - 1}")
            every = turn == stars or count.pairs <= most * count.n
        now = rooted()
        if every:
            # Sketches are compared where the pairs meet, so that unlike pairs never leave the join.
            other = now.select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "size", "root"))).join(short2, "node2")
            pairs = now.join(short, "node").join(other, "key").where(near & F.expr("root <> root2 and node < node2"))
        else:
            order = F.xxhash64("node", F.lit(turn)).alias("h")
            first = F.max(F.struct(*(["weight"] if turn == 0 else []), order, *(F.col(c).alias(f"{c}2") for c in ("node", "size", "root")))).alias("x")
            pairs = now.join(now.groupBy("key").agg(first).select("key", "x.node2", "x.size2", "x.root2"), "key").where("root <> root2")
            pairs = pairs.groupBy("node", "node2").agg(F.first("size").alias("size"), F.first("size2").alias("size2")).join(short2, "node2").join(short, "node").where(near)
        pairs = pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        close = space.save(_verified(pairs, sets, similarity), f"close-{turn}")
        found = close.count()
        if found:
            links = close if links is None else links.unionByName(close)
            roots = components(links, space, f"roots-{turn}")
            space.drop(f"roots-{named}")
            named = turn
        space.tidy()
        if every:
            break
        few = turn > 0 and 100 * found < leaves.agg(F.approx_count_distinct("node").alias("n")).first().n
    return leaves.select("node", F.col("node").alias("root")).limit(0) if roots is None else roots


def _alike(n: str, m: str, similarity: float) -> Column:
    """False if the sizes alone rule the similarity out."""
    return F.least(n, m) / F.greatest(n, m) >= similarity


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 40, per_band: int = 6) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near-duplicates.

    Documents are linked if their SimHash fingerprints are (``near_classes``).  What fingerprints
    don't link is linked too if the Jaccard similarity of the sets of ``shingle``-word shingles is
    ``similarity`` or more.  Candidates for that share all minima of any of ``bands`` bands of ``per_band`` MinHashes of
    these sets, so a pair of similarity s is one with probability 1 - (1 - s**per_band)**bands, wherever the
    texts differ: 0.999995 at 0.8 for ideal hashes, more above.  Candidates are then compared exactly.

    Copies count as one node throughout; wordless and null texts are copies of each other.  Of
    rows that repeat, id included, one stays.  All columns of ``docs`` are returned unchanged.
    """
    space = Workspace(docs.sparkSession)
    uid = F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(uid.alias("uid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = space.save(signatures(rows, shingle, bands, per_band), "signatures")
    nodes = seen.groupBy("node").agg(F.min("uid").alias("uid"), F.min("size").alias("size"), F.min("keys").alias("keys"))
    leaves = space.save(nodes.select("uid", "node", "size", F.explode("keys").alias("key")), "leaves")
    shared = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    leaves = leaves.join(shared, "key").withColumn("weight", F.sum("n").over(Window.partitionBy("node")))  # a node has a row a band
    leaves = space.save(leaves.drop("n"), "shared")
    space.drop("leaves")
    sets = space.save(shingle_sets(rows.join(leaves.select("uid", "node").distinct(), "uid").dropDuplicates(["node"]), shingle), "sets")
    classes = near_classes(rows, "uid", "text").select("uid", "component")
    placed = space.save(seen.select("uid", "node").join(classes, "uid").select("node", "component").distinct(), "placed")
    linked = placed.join(placed.groupBy("component").agg(F.min("node").alias("b")), "component").select(F.col("node").alias("a"), "b").where("a <> b")
    roots = near_roots(leaves.select("key", "node", "size", "weight"), sets, similarity, space, given=linked)
    ids = docs.select(uid.alias("uid"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("id"))
    member = seen.select("uid", "node").join(roots, "node", "left").select("uid", F.coalesce("root", "node").alias("root"))
    chosen = ids.join(member, "uid").groupBy("root").agg(F.min(F.struct("id", "uid")).alias("best")).select("best.uid")
    chosen = space.save(chosen, "chosen")
    space.drop("signatures", "shared", "sets", "sketches", "placed", *(f"{kind}-{turn}" for kind in ("close", "roots", "rows") for turn in range(-1, 9)))
    space.tidy()
    key = free_name(docs, "uid")
    kept = docs.withColumn(key, uid).join(chosen.withColumnRenamed("uid", key), key, "left_semi")
    return kept.dropDuplicates([key]).select(*docs.columns)
