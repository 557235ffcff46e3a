"""Near-duplicates by a forest of sorted MinHash signatures.

A document's set holds the hashes of its distinct word shingles; with fewer
words than a shingle, of the whole sequence; without words it is empty and
linked with nothing. Equal sets are one node, so copies cost nothing below.

A signature has ``TREES * BASE`` minima. Tree t orders all nodes by the
signature rotated to start at its own ``BASE`` minima; the orders are dealt by
range, so a dense region is cut wherever it is large and no key can fill a
task. Neighbours in an order have the longest common prefixes. A region is the nodes
that agree on the ``BASE`` first minima; where more than ``FAR + 1`` do, the depth
grows, minimum by minimum, until as few agree, and these are each other's
candidates. Nodes that still are more at full depth meet the next ``NEAR`` ones.
Two sets of similarity 0.8 share a region in 13 of 32 trees.
Signatures then sort out candidates whose estimate lies ``SLACK`` (over four
standard deviations) below the limit, and every remaining pair is
confirmed on the full sets: 100 * intersection >= percent * union.

In a crowded region the one partner of a node may stand further off. So every node
of a region that the first round does not compare whole (more than ``FAR + 1``
nodes, or cut by the end of a range) goes to an exact join; what is found does not
depend on how rows come in batches or ranges. Shingles are put in one
order, rare ones first; two sets that are similar enough have a first common
shingle, and from its place in both follows the most that they can share. The
smaller set meets the larger on those of its shingles from which a set no smaller
than itself can still be reached, only nodes of *different* components meet, and a
shingle of many nodes is dealt out by ``SHARE`` of them. Every pair that passes is
confirmed on the full sets; no window and no estimate stands before that.

Null texts have no words. Texts of any length are taken whole. Rows that repeat a
doc_id are judged by their own text. A null doc_id forms no group of its own. Of
equal sets the smallest doc_id is the node, and of a component the smallest is kept.
An empty table gives no rows. Extra columns are ignored, whatever their names.
Shingles are known by 64-bit hashes: two documents of a thousand shingles each have
two different ones of equal hash with a probability below 1e-13, and that moves their
similarity by a thousandth.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .components import components
from .runtime import attach, ship, stored

TREES, BASE, DEEPER = 32, 4, 8
FAR, NEAR = 6, 2
SLACK = 0.18
#: Cells of the counts that order shingles (a shared cell costs time, not links), and nodes of a shingle that meet in one key.
CELLS, SHARE = 1 << 20, 4096
#: Ids of candidates are broadcast up to this number (8 bytes each), else joined by shuffle.
MOST_BROADCAST = 2_000_000

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 1 << 63, TREES * BASE, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, TREES * BASE, dtype=np.uint64)


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for a, b in K.batches(texts):
        w = K.Words(texts[a:b], K.BY_SPACE)
        h = w.hashes()
        g = K.grams(h, k)
        for i in range(b - a):
            f, n = int(w.first[i]), int(w.n[i])
            if n >= k:
                out.append(np.unique(g[f : f + n - k + 1]))
            else:  # the whole sequence; its length keeps it apart from shingles
                out.append(K.mix(K.grams(h[f : f + n], n) ^ np.uint64(n)) if n else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    """Minima of each set (none may be empty) under every hash function."""
    out = np.empty((len(sets), len(mul)), np.uint32)
    step, first = 0, 0
    for i, s in enumerate(sets):
        step += len(s)
        if step > 1 << 16 or i == len(sets) - 1:
            part = sets[first : i + 1]
            flat = np.concatenate(part)
            at = np.concatenate([[0], np.cumsum([len(p) for p in part])[:-1]]).astype(np.int64)
            for j in range(len(mul)):
                out[first : i + 1, j] = np.minimum.reduceat(flat * mul[j] + add[j] >> np.uint64(32), at)
            step, first = 0, i + 1
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def fn(cols):
        sets = shingles(K.utf8(cols[text_col]), k)
        full = [s for s in sets if len(s)]
        sig = iter(signatures(full)) if full else iter(())
        return {
            "n": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            "sig": [next(sig).tobytes() if len(s) else None for s in sets],
        }

    return attach(docs, [text_col], [id_col], fn, "n long, digest binary, sig binary").select(F.col(f"c.`{id_col}`").cast("long").alias("id"), "r.*")


def _trees(nodes: DataFrame) -> DataFrame:
    """A row for each node and tree: the region, the deeper order, the node."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(ids), -1)
            for t in range(TREES):
                turned = np.roll(sig, -t * BASE, axis=1)
                base = turned[:, :BASE].astype(np.uint64)
                key = np.full(len(ids), t, np.uint64)
                for c in range(BASE):
                    key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + base[:, c])
                # big-endian, so that bytes sort as the numbers do
                order = (turned[:, BASE : BASE + DEEPER] >> 16).astype(">u2")
                order = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((np.arange(len(ids) + 1) * 2 * DEEPER).astype(np.int32)), pa.py_buffer(order.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), order, pa.array(ids)], ["key", "deeper", "node"])

    order = ["key", "deeper", "node"]
    return nodes.select("node", "sig").mapInArrow(run, "key long, deeper binary, node long").repartitionByRange(*order).sortWithinPartitions(*order)


def _regions(keys: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each sorted row at the least depth at which it has at most ``FAR + 1`` rows, and whether there is one."""
    same = keys[1:] == keys[:-1]
    # minima behind the first ones that a row has in common with the row before
    prefix = np.where(same, np.cumprod(deeper[1:] == deeper[:-1], axis=1).sum(1), -1)
    group, settled = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for depth in range(DEEPER + 1):
        own = np.cumsum(np.concatenate([[True], prefix < depth])) - 1
        fits = (np.bincount(own)[own] <= FAR + 1) & ~settled
        group[fits] = own[fits] * (DEEPER + 1) + depth
        settled |= fits
        if settled.all():
            break
    return group, settled


def _neighbours(batches):
    """Pairs of neighbours in a sorted run of trees' rows; a node of a region not compared whole also with itself."""
    keys, nodes, deeper = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, DEEPER), np.uint16)
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = len(keys)
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        nodes = np.concatenate([nodes, batch.column(1).to_numpy()])
        deeper = np.concatenate([deeper, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, DEEPER)])
        group, settled = _regions(keys, deeper)
        for k in range(1, FAR + 1):
            if len(keys) <= k:
                break
            near = k <= NEAR
            ok = (keys[k:] == keys[:-k]) & (near | settled[k:] & settled[:-k] & (group[k:] == group[:-k])) & (nodes[k:] != nodes[:-k])
            ok[: max(fresh - k, 0)] = False  # both were in the last batch
            a, b = nodes[:-k][ok], nodes[k:][ok]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        first = keys[0] if first is None else first  # this region and the last may go on in another run
        part = keys == first
        full = np.flatnonzero(keys[FAR + 1 :] == keys[: -FAR - 1])
        for k in range(FAR + 2):
            part[full + k] = True
        if part.any():
            own = pa.array(np.unique(nodes[part]))
            yield pa.RecordBatch.from_arrays([own, own], ["a", "b"])
        keys, nodes, deeper = keys[-FAR - 1 :], nodes[-FAR - 1 :], deeper[-FAR - 1 :]
    own = pa.array(nodes[keys == keys[-1]] if len(keys) else nodes)
    yield pa.RecordBatch.from_arrays([own, own], ["a", "b"])


def _low(nodes: DataFrame) -> DataFrame:
    """node, and the low byte of each minimum: what two signatures are compared by."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], ["node", "low"])

    return nodes.select("node", "sig").mapInArrow(run, "node long, low binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _sketch_filter(least: float):
    def run(batches):
        for batch in batches:
            x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array((x == y).mean(1) >= least)) for c in batch.columns[:2]], ["a", "b"])

    return run


def _counts(sets: DataFrame) -> np.ndarray:
    """Nodes of each cell of shingles."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(_cell(np.frombuffer(x.as_py(), np.uint64)), minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in sets.select("set").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.cell] = r.n
    return out


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (K.mix(shingles) % np.uint64(CELLS)).astype(np.int64)


def _postings(sets: DataFrame, counts, percent: int, larger: bool) -> DataFrame:
    """A row for each shingle of a node on which it may meet a partner: one no larger (``larger``), or one no smaller.

    rest: shingles of the node from this one on, in the common order.
    """

    def run(batches):
        n_of = counts.value
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(6)]
            for node, own, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = np.frombuffer(x, np.uint64)
                n = len(s)
                many = n_of[_cell(s)]
                order = np.lexsort((s, many))
                s, many, rest = s[order], many[order], n - np.arange(n)
                ok = (100 * rest >= percent * n) if larger else ((100 + percent) * rest >= 2 * percent * n)
                ok &= many > 1  # else no other node has the shingle
                s, many, rest = s[ok].view(np.int64), many[ok], rest[ok]
                parts = -(-many // SHARE)
                if larger:  # a copy for each part of the other side
                    s, rest = np.repeat(s, parts), np.repeat(rest, parts)
                    part = np.arange(len(s)) - np.repeat(np.cumsum(parts) - parts, parts)
                else:
                    part = (K.mix(np.array([node], np.int64).view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                for k, v in enumerate((s, part, np.full(len(s), node), np.full(len(s), own), np.full(len(s), n), rest)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["shingle", "part", "node", "own", "n", "rest"])

    return sets.select("id", "own", "set").mapInArrow(run, "shingle long, part long, node long, own long, n long, rest long")


def _across(sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of nodes of different components that may be similar enough."""
    counts = sets.sparkSession.sparkContext.broadcast(_counts(sets))
    x, y = (_postings(sets, counts, percent, larger).alias("xy"[larger]) for larger in (False, True))
    col = F.col
    total = (col("x.n") + col("y.n")) * percent
    meet = (col("x.shingle") == col("y.shingle")) & (col("x.part") == col("y.part")) & (col("x.own") != col("y.own"))
    meet &= (col("x.n") < col("y.n")) | (col("x.n") == col("y.n")) & (col("x.node") < col("y.node"))
    meet &= (total <= col("x.rest") * (100 + percent)) & (total <= col("y.rest") * (100 + percent))
    return x.join(y, meet).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep, counts = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
                counts.append((both, len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            cols = [batch.column(0), batch.column(1), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], ["a", "b", "both", "either"])

    return run


class NearDuplicates:
    """Nodes, confirmed links between them, and the component of each document row."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80):
        ship(docs.sparkSession)
        self.rows = stored(_signed(docs, id_col, text_col, k), "signatures", "uncompressed")
        named = self.rows.where("n > 0 and id is not null")
        self.nodes = stored(named.groupBy("digest").agg(F.min("id").alias("node"), F.first("sig").alias("sig")), "nodes", "uncompressed")
        least = percent / 100 - SLACK
        met = stored(_trees(self.nodes).select("key", "node", "deeper").mapInArrow(_neighbours, "a long, b long").distinct(), "neighbours")
        pairs, crowd = met.where("a <> b"), met.where("a = b").select(F.col("a").alias("node"))
        for side in ("a", "b"):
            pairs = pairs.join(_low(self.nodes).select(F.col("node").alias(side), F.col("low").alias(f"low_{side}")), side)
        self.close = stored(pairs.select("a", "b", "low_a", "low_b").mapInArrow(_sketch_filter(least), "a long, b long"), "candidates")
        wanted = self.close.select(F.col("a").alias("node")).union(self.close.select("b")).union(crowd).distinct()
        self.sets = stored(self._sets(docs, wanted, id_col, text_col, k), "sets", "uncompressed")
        first = stored(self._confirmed(self.close, percent), "links")
        self.found = components(first)
        few = self.sets.join(crowd.withColumnRenamed("node", "id"), "id", "left_semi").join(self.found.withColumnRenamed("node", "id"), "id", "left")
        few = stored(few.select("id", F.coalesce("component", "id").alias("own"), "set"), "crowd", "uncompressed")
        second = stored(self._confirmed(_across(few, percent), percent), "links")
        self.links = first.union(second)
        if not second.isEmpty():
            self.found = self._merged(second)

    def _merged(self, more: DataFrame) -> DataFrame:
        """Components after more links: only the components that these join are contracted."""
        edges = more
        for side in ("a", "b"):
            own = self.found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
            edges = edges.join(own, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        joined = components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("node", "old").withColumnRenamed("component", "new")
        nodes = self.found.union(joined.select("old", "old").join(self.found, F.col("old") == F.col("node"), "left_anti"))
        return nodes.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))

    def _sets(self, docs, wanted: DataFrame, id_col, text_col, k) -> DataFrame:
        """id, set: shingle hashes of the documents that have a close candidate or stand in a crowd."""
        if wanted.count() <= MOST_BROADCAST:
            wanted = F.broadcast(wanted)
        q = lambda c: F.col("`" + c.replace("`", "``") + "`")
        texts = docs.select(q(id_col).cast("long").alias("node"), q(text_col).alias("text")).join(wanted, "node", "left_semi")

        def fn(cols):
            return {"set": [s.tobytes() for s in shingles(K.utf8(cols["text"]), k)]}

        return attach(texts, ["text"], ["node"], fn, "set binary").select(F.col("c.node").alias("id"), "r.set").where("length(set) > 0")

    def _confirmed(self, pairs: DataFrame, percent: int) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(self.sets.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}")), side)
        return pairs.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long, both long, either long").distinct()

    def members(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept; one row for each document row."""
        rows = self.rows.select("id", "n", "digest")
        # nodes are few for a digest and a node; only the last join meets hot digests, and both
        # its sides are plain exchanges, which Spark can split
        known = self.nodes.select("digest", "node").join(self.found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
        out = rows.join(known, "digest", "left")
        own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    return NearDuplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4).members()
