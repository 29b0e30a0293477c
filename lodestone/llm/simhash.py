"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints within r of 64 bits agree on one of r + 1 segments whole, so each is
dealt to r + 1 cells and every link shows in one of them. In a cell fingerprints
stand in the order of their Gray rank, which puts similar bit patterns side by side. Upper
nodes hold the bits that everything below shares (a mask and a pattern); two nodes
whose shared bits already differ in more than r places are left out with all
beneath. So are two nodes of one component: only components are asked for, and
each task returns them as trees, never as all pairs.

``similar`` links texts by the similarity of their shingles: the index proposes, whole sets
decide, and what lies too far apart for it is found by shared rare shingles.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import graph, shingles
from lodestone.llm.common import bounded, in_chunks, materialize, shuffle_partitions, text_bytes


def bits(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have."""
    x = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(x), 1 << 16):
        ones += np.unpackbits(x[i : i + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(x), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's ``size``-word shingles, repeats included.

    A bit is 1 if more than half of the shingles' XXH64 have it. Fewer words are one
    shingle; no words give 0.
    """
    return bits(shingles.hashes(text, size, seed)) if text.strip() else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` holds the 64 bits as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in in_chunks(batches, "text"):
            fp = np.array([fingerprint(t, size) for t in text_bytes(b.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the Gray code's order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The index over fingerprints of one or more groups, and its join with itself."""

    def __init__(self, group: np.ndarray, x: np.ndarray):
        self.order = np.lexsort((gray_rank(x), group))
        self.x, g = x[self.order], group[self.order]
        self.g = np.cumsum(np.diff(g, prepend=g[:1]) != 0)
        self.label = np.arange(len(x))
        #: of each level: bits all set below, bits any set below, first and last group
        self.levels = [(self.x, self.x, self.g, self.g)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(tuple(self._pairs(f, a) for f, a in zip((np.bitwise_and, np.bitwise_or, np.minimum, np.maximum), self.levels[-1])))

    @staticmethod
    def _pairs(f, a: np.ndarray) -> np.ndarray:
        return f.reduceat(a, np.arange(0, len(a), 2))

    def _uniform(self) -> None:
        """Of each level: least and greatest component below."""
        self.parts = [(self.label, self.label)]
        for _ in self.levels[1:]:
            low, high = self.parts[-1]
            self.parts.append((self._pairs(np.minimum, low), self._pairs(np.maximum, high)))

    def _open(self, level: int, u: np.ndarray, v: np.ndarray, radius: int) -> np.ndarray:
        """Which pairs of nodes may still hold a link that joins two components."""
        ones, some, first, last = self.levels[level]
        shared = ~(ones[u] ^ some[u]) & ~(ones[v] ^ some[v])
        low, high = self.parts[level]
        apart = np.bitwise_count((ones[u] ^ ones[v]) & shared) > radius
        done = (low[u] == high[u]) & (low[v] == high[v]) & (low[u] == low[v])
        return ~(apart | done | (first[u] > last[v]) | (first[v] > last[u]))

    def join(self, radius: int, chunk: int = 1 << 17) -> None:
        """Merge the components of all fingerprints of a group that differ in ``radius`` bits or fewer."""
        n = len(self.x)
        if n < 2:
            return
        i = np.flatnonzero((self.g[1:] == self.g[:-1]) & (np.bitwise_count(self.x[1:] ^ self.x[:-1]) <= radius))
        graph.merge(self.label, i, i + 1)
        self._uniform()
        top = len(self.levels) - 1
        zero = np.zeros(1, np.int64)
        stack = [(top, zero, zero)]
        while stack:
            level, u, v = stack.pop()
            keep = self._open(level, u, v, radius)
            u, v = u[keep], v[keep]
            if level == 0:
                if graph.merge(self.label, u, v) * 50 > n:
                    self._uniform()
                continue
            same = u == v
            a, b = np.repeat(2 * u, 4), np.repeat(2 * v, 4)
            a[2::4] += 1
            a[3::4] += 1
            b[1::4] += 1
            b[3::4] += 1
            twice = np.repeat(same, 4)
            twice[0::4] = twice[1::4] = twice[3::4] = False  # of a node with itself, (right, left) repeats (left, right)
            size = len(self.levels[level - 1][0])
            good = ~twice & (a < size) & (b < size)
            if level == 1:
                good &= a != b
            a, b = a[good], b[good]
            stack += [(level - 1, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Trees over the components, as places in the arrays given."""
        a, b = graph.forest(self.label)
        return self.order[a], self.order[b]


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints that hold together whatever differs in at most ``radius`` bits.

    A cell that holds more than its share of rows is cut into blocks by a hash, and every
    pair of blocks is a group of its own; there are at most two such cells for each
    shuffle partition, which bounds the table of them that is broadcast.
    """
    parts = radius + 1
    edges = [64 * i // parts for i in range(parts + 1)]
    spark = fps.sparkSession
    n = shuffle_partitions(spark)
    segments = F.array(*(F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned(F.shiftleft("fp", 64 - z), 64 - (z - a)).alias("bits")) for i, (a, z) in enumerate(zip(edges, edges[1:]))))
    cells = fps.select("fp", F.explode(segments).alias("c")).select("fp", "c.seg", "c.bits")
    sizes = cells.groupBy("seg", "bits").count()
    total = fps.count() * parts
    block = max(256, total // n // 2)
    hot = sizes.where(F.col("count") > 2 * block).select("seg", "bits", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    cells = cells.join(F.broadcast(hot), ["seg", "bits"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = cells.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    group = F.xxhash64("seg", "bits", F.least("own", "other"), F.greatest("own", "other"))
    dealt = cells.select(group.alias("g"), "fp").repartition(n, "g").sortWithinPartitions("g")

    def run(batches):
        def found(g, fp):
            index = GrayIndex(g, fp.view(np.uint64))
            index.join(radius)
            a, b = index.edges()
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

        g, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            g = np.concatenate([g, np.asarray(batch.column("g"))])
            fp = np.concatenate([fp, np.asarray(batch.column("fp"))])
            if len(g) > 1 << 18:  # whole groups only; the last one may go on
                cut = np.searchsorted(g, g[-1])
                if cut:
                    yield found(g[:cut], fp[:cut])
                    g, fp = g[cut:], fp[cut:]
        if len(g):
            yield found(g, fp)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Fingerprints link at ``radius`` or fewer differing bits; the component id is the
    smallest doc_id reachable, nulls left aside (null if all ids reached are null).
    Texts without words have fingerprint 0 and link like others. Equal rows have equal
    results. Only ids and fingerprints are shuffled.
    """
    made, _ = materialize(fingerprints(bounded(docs), doc_id, text, size), "fingerprints")
    first, _ = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = graph.components(links(first.select("fp"), radius))
    known = first.join(labels, first["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = known.groupBy("label").agg(F.min("first").alias("component_id"))
    of = known.select("fp", "label").join(least, "label").select(F.col("fp").alias("f"), "component_id")
    out = made.join(of, made["fp"] == of["f"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar(docs: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component_id`` for every row: near copies by the fingerprints, whole by their shingles.

    Texts link at a Jaccard similarity of ``similarity`` or more between their sets of
    ``size``-word shingles (texts and shingles by 64-bit hashes). The Gray-order index gives
    the pairs within ``radius`` bits; at such a similarity fingerprints may differ in far
    more bits, so sets that still lie in two components and share enough of their first
    shingles are compared too. Every link is verified, and none is missed. Texts without
    words are alike. The component id is the smallest doc_id reachable, nulls left aside
    (null if all ids reached are null).
    """
    t = Fraction(similarity).limit_denominator(1000)
    content = F.coalesce(F.col(text), F.lit(""))
    picked = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.xxhash64(content).alias("k"), content.alias("text"))
    nodes, _ = materialize(picked.groupBy("k").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "nodes")
    some = shingles.survivors(picked.select("k", "text"), size, t, bits)
    top = some.groupBy("fp").agg(F.min("k").alias("top"))
    near = links(top.select("fp"), radius)
    for end in ("a", "b"):
        near = near.join(top.select(F.col("fp").alias(end), F.col("top").alias(f"{end}_top")), end)
    same = some.join(top, "fp").where("k <> top").select(F.col("top").alias("a"), F.col("k").alias("b"))
    postings = shingles.postings(some).join(nodes.select("k", "copies"), "k")
    meeting = postings.groupBy("token").count().where("count > 1").select("token")
    postings, _ = materialize(postings.join(meeting, "token"), "postings")
    beside = shingles.candidates(postings.withColumn("label", F.col("k")), t, False)
    found = shingles.verified(near.select(F.col("a_top").alias("a"), F.col("b_top").alias("b")).unionByName(same).unionByName(beside), some, t)
    labels = graph.components(found)
    known = postings.join(labels, postings["k"] == labels["node"], "left").withColumn("label", F.coalesce("label", "k")).drop("node").join(some.select("k", "parity"), "k")
    rest = shingles.verified(shingles.candidates(known, t, True), some, t)
    labels = graph.components(found.unionByName(rest))
    known = nodes.join(labels, nodes["k"] == labels["node"], "left").select("k", "first", F.coalesce("label", "k").alias("label"))
    least = known.groupBy("label").agg(F.min("first").alias("component_id"))
    of = known.select("k", "label").join(least, "label").select("k", "component_id")
    return picked.select("doc_id", "k").join(of, "k").select("doc_id", "component_id")


def _first_of_each(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")


def representatives(docs: DataFrame, radius: int = 3, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the documents that stand for their component of near fingerprints.

    Of each component the smallest id stays. Rows that repeat an id are one document and
    stay or go together; rows without an id cannot be told apart and stay.
    """
    return _first_of_each(docs, near_duplicates(docs, radius, size, doc_id, text), doc_id)


def without_near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``representatives`` of the components of ``similar`` texts."""
    return _first_of_each(docs, similar(docs, similarity, size, doc_id=doc_id, text=text), doc_id)
