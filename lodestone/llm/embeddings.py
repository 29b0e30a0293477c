"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are turned to their leading principal directions (fitted on a bounded
sample; any rotation keeps distances, so the choice only affects speed). A cosine
of at least c means a distance of at most eps = sqrt(2 - 2c), so in every direction
linked vectors lie in the same grid cell of side eps or in neighbouring ones. The
length left outside these directions is one more coordinate (by Cauchy-Schwarz the
distance is no less with it). The vectors are range-partitioned in the order of their
cells and cut into blocks, at the edges of cells where they can be. A block's contents
are written once to the shared folder; only its bounds and its place there travel.
Blocks meet if they touch neighbouring cells (an equi-join on cells) and their bounds
are no farther apart than eps; a task reads the blocks of neighbouring meetings once and
joins each pair by halving both sequences until they are apart or small.

Equal vectors are one class with a weight, so copies never meet each other in pairs.
Vectors are equal if two 64-bit hashes of theirs with different seeds are.
"""

from __future__ import annotations

import uuid
from functools import lru_cache
from itertools import product
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import graph
from lodestone.llm.common import materialize, new_path, shuffle_partitions

#: Slack on distances that only skip work; the cosine itself is compared exactly.
SLACK = 1e-9
#: Bytes of a block's vectors in double precision, and of the sample that directions are fitted on, at most.
BLOCK_BYTES, SAMPLE_BYTES = 8 << 20, 32 << 20


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows ``vec_id, k, k2``; classes ``k, k2, weight, first, v``), ``k`` null for vectors that link with nothing."""
    e = F.col(embedding)
    kind = "float" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "double"
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    # 0.0 and -0.0 are equal numbers of different bits
    v = F.when(fine, F.transform(e, lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x.cast(kind))))
    named = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    keys = [F.when(F.col("v").isNotNull(), h).alias(k) for k, h in (("k", F.xxhash64("v")), ("k2", F.xxhash64(F.lit(1), "v")))]
    found = named.where("v is not null").select("vec_id", "v", *keys).groupBy("k", "k2").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"), F.first("v").alias("v"))
    return named.select("vec_id", *keys), found


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component so that nothing over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_size(v: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each vector length: which rows have it, and these as a matrix."""
    at = np.asarray(v.offsets)
    size, flat = np.diff(at), np.asarray(v.values)
    out = {}
    for k in np.unique(size).tolist():
        rows = np.flatnonzero(size == k)
        out[k] = rows, flat[at[rows][:, None] + np.arange(k)].astype(np.float64)
    return out


def directions(found: DataFrame, sample: int, dims: int) -> dict[int, np.ndarray]:
    """For each vector length, the leading principal directions of about ``sample`` vectors in all, fewer if they are long."""
    n, widest = found.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    sample = min(sample, SAMPLE_BYTES // (8 * max(1, widest or 0)) + 1)
    some = found.select("v") if n <= sample else found.where(F.pmod(F.col("k"), F.lit(2**32)) < int(sample / n * 2**32)).select("v")
    out = {}
    for chunk in some.limit(2 * sample).toArrow().column("v").chunks:
        for size, (_, x) in _by_size(chunk).items():
            x = unit(x)
            out[size] = out.get(size, 0) + np.array([np.outer(x.sum(0), x.sum(0)) / len(x), x.T @ x])
    return {size: np.linalg.eigh(m[1] - m[0])[1][:, ::-1][:, :dims] for size, m in out.items()}


class Sequence:
    """Vectors in grid order; any stretch of them has a box."""

    def __init__(self, x: np.ndarray, p: np.ndarray):
        self.x, self.p = x, p

    def box(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        return self.p[a:z].min(0), self.p[a:z].max(0)


def join(s: Sequence, t: Sequence, cosine: float, small: int = 256):
    """Pairs (places in s, places in t) of at least the cosine, a tile at a time; of s with itself, i < j only."""
    far = (max(0.0, 2 - 2 * cosine) ** 0.5 + SLACK) ** 2
    stack = [(0, len(s.x), 0, len(t.x))]
    while stack:
        a, z, b, y = stack.pop()
        if a >= z or b >= y or (s is t and y <= a):
            continue
        (low, high), (low2, high2) = s.box(a, z), t.box(b, y)
        if float((np.maximum(0, np.maximum(low2 - high, low - high2)) ** 2).sum()) > far:
            continue
        if z - a <= small and y - b <= small:
            i, j = np.nonzero(s.x[a:z] @ t.x[b:y].T >= cosine)
            i, j = i + a, j + b
            if s is t:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        m, k = (a + z) // 2 if z - a > small else z, (b + y) // 2 if y - b > small else y
        stack += [(p, q, u, v) for p, q in ((a, m), (m, z)) for u, v in ((b, k), (k, y))]


def _turned(u: np.ndarray, w: np.ndarray | None, dims: int) -> np.ndarray:
    """Coordinates of unit vectors in their leading directions, and the length outside these."""
    q = u @ w if w is not None else u[:, :dims]
    p = np.zeros((len(u), dims + 1))
    p[:, : q.shape[1]] = q
    p[:, dims] = np.sqrt(np.maximum(0, 1 - (q * q).sum(1)))
    return p


def _grid(found: DataFrame, turn: dict[int, np.ndarray], dims: int, eps: float) -> DataFrame:
    """Each class with its vector length and cells in the turned space."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            grid, size = np.zeros((n, dims + 1), np.int32), np.zeros(n, np.int64)
            for k, (rows, x) in _by_size(b.column("v")).items():
                grid[rows], size[rows] = np.floor(_turned(unit(x), turn.get(k), dims) / eps), k
            cells = pa.ListArray.from_arrays(np.arange(0, grid.size + 1, dims + 1, dtype=np.int32), pa.array(grid.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("weight"), pa.array(size), cells, b.column("v")], names=["cid", "weight", "size", "grid", "v"])

    chosen = found.select("cid", "weight", "v")
    return chosen.mapInArrow(run, f"cid long, weight long, size long, grid array<int>, v {chosen.schema['v'].dataType.simpleString()}")


def _files(path: str) -> tuple[fs.FileSystem, str]:
    u = urlparse(path)
    return (fs.LocalFileSystem(), unquote(u.path)) if u.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _cuts(a: int, z: int, edges: np.ndarray, most: int):
    """Stretches of a..z of at most ``most`` rows that end at an edge where one lies in their last three quarters."""
    while a < z:
        end = min(a + most, z)
        if end < z:
            k = np.searchsorted(edges, end, "right") - 1
            end = int(edges[k]) if k >= 0 and edges[k] > a + most // 4 else end
        yield a, end
        a = end


def _blocks(grid: DataFrame, turn: dict[int, np.ndarray], dims: int, key_dims: int, most: int, parts: int, folder: str) -> DataFrame:
    """Stretches of the grid order, of one vector length each: their boxes, the cells they touch, and where
    their contents (ids, weights, vectors) stand. A task's blocks are one file; a task that runs again writes another."""
    schema = pa.schema({"block": pa.int64(), "size": pa.int64(), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64()), "cells": pa.list_(pa.list_(pa.int32())), "file": pa.string(), "at": pa.int64(), "n": pa.int64()})

    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        store, root = _files(folder)
        name, out = f"{part}-{uuid.uuid4().hex}", None

        def cut(t: pa.Table):
            nonlocal count, out
            size = np.asarray(t.column("size"))
            cells = np.asarray(t.column("grid").combine_chunks().flatten()).reshape(len(size), -1)[:, :key_dims]
            edges = np.flatnonzero((np.diff(cells, axis=0, prepend=cells[:1]) != 0).any(1))
            starts = np.flatnonzero(np.diff(size, prepend=-1, append=-1))
            for a0, z0 in zip(starts.tolist(), starts[1:].tolist()):
                k = int(size[a0])
                for a, z in _cuts(a0, z0, edges, max(64, min(most, BLOCK_BYTES // (8 * k)))):
                    rows = t.slice(a, z - a)
                    x = np.asarray(rows.column("v").combine_chunks().flatten()).reshape(-1, k)
                    p = _turned(unit(x.astype(np.float64)), turn.get(k), dims)
                    out = out or store.open_output_stream(f"{root}/{name}")
                    at = out.tell()
                    for column in ("cid", "weight"):
                        out.write(np.asarray(rows.column(column)).astype("<i8").tobytes())
                    out.write(x.tobytes())
                    yield pa.RecordBatch.from_pylist([{"block": (part << 32) + count, "size": k, "low": p.min(0).tolist(), "high": p.max(0).tolist(), "cells": np.unique(cells[a:z], axis=0).tolist(), "file": name, "at": at, "n": z - a}], schema=schema)
                    count += 1

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 4 * most or sum(x.nbytes for x in held) >= 4 * BLOCK_BYTES:
                yield from cut(pa.Table.from_batches(held))
                held = []
        if held:
            yield from cut(pa.Table.from_batches(held))
        if out:
            out.close()

    order = ["size", "grid", "cid"]
    return grid.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "block long, size long, low array<double>, high array<double>, cells array<array<int>>, file string, at long, n long")


def _meetings(blocks: DataFrame, key_dims: int, eps: float) -> DataFrame:
    """Pairs ``a <= b`` of blocks that touch neighbouring cells and whose boxes are near."""
    steps = [s for s in product((-1, 0, 1), repeat=key_dims) if s >= (0,) * key_dims]
    near = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    home = blocks.select("block", "size", "low", "high", F.explode("cells").alias("cell"))
    asks = home.select(F.col("block").alias("other"), "size", F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.transform(near, lambda s: F.zip_with("cell", s, lambda x, y: x + y))).alias("cell"))
    met = home.join(asks, ["size", "cell"])
    pairs = met.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "low", "high", "low2", "high2")
    gap = F.zip_with(F.zip_with("low2", "high", lambda x, y: x - y), F.zip_with("low", "high2", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    distance = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return pairs.where(distance <= (eps + SLACK) ** 2).select("a", "b").distinct()


class _Links:
    """Links of many pairs of blocks, summed by class, and trees that hold the linked classes together."""

    def __init__(self):
        self.counts, self.edges, self.held = [], [], 0

    def add(self, cid: np.ndarray, links: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        self.counts.append((cid, links))
        self.edges.append((up, down))
        self.held += len(cid) + len(up)

    def compact(self) -> None:
        if self.held:
            cid, links = (np.concatenate(x) for x in zip(*self.counts))
            once, at = np.unique(cid, return_inverse=True)
            total = np.zeros(len(once), np.int64)
            np.add.at(total, at, links)
            up, down = (np.concatenate(x) for x in zip(*self.edges))
            nodes, at = np.unique(np.concatenate([up, down]), return_inverse=True)
            label = np.arange(len(nodes))
            graph.merge(label, at[: len(up)], at[len(up) :])
            up, down = graph.forest(label)
            self.counts, self.edges, self.held = [], [], 0
            self.add(once, total, nodes[up], nodes[down])

    def take(self) -> pa.RecordBatch:
        """Rows ``cid, links, cid`` and, for an edge, ``cid, 0, other``."""
        self.compact()
        (cid, links), (up, down) = self.counts[0], self.edges[0]
        self.counts, self.edges, self.held = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([cid, up])), pa.array(np.concatenate([links, np.zeros(len(up), np.int64)])), pa.array(np.concatenate([cid, down]))], names=["cid", "links", "other"])


def _joined(met: DataFrame, turn: dict[int, np.ndarray], dims: int, cosine: float, kind: str, folder: str) -> DataFrame:
    """Links of the meetings ``a, b`` with where both blocks stand, in tasks that read a block for several meetings."""

    def run(batches):
        store, root = _files(folder)

        @lru_cache(maxsize=12)
        def load(file: str, at: int, n: int, k: int):
            with store.open_input_file(f"{root}/{file}") as f:
                raw = f.read_at(n * (16 + k * np.dtype(kind).itemsize), at)
            u = unit(np.frombuffer(raw, kind, n * k, 16 * n).reshape(n, k).astype(np.float64))
            return Sequence(u, _turned(u, turn.get(k), dims)), np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)

        found = _Links()
        for batch in batches:
            for r in batch.to_pylist():
                s, cid, w = load(r["file"], r["at"], r["n"], r["size"])
                same = r["a"] == r["b"]
                t, cid2, w2 = (s, cid, w) if same else load(r["file2"], r["at2"], r["n2"], r["size"])
                shift, ids = (0, cid) if same else (len(cid), np.concatenate([cid, cid2]))
                links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for i, j in join(s, t, cosine):
                    np.add.at(links, i, w2[j])
                    np.add.at(links, j + shift, w[i])
                    graph.merge(label, i, j + shift)
                some = np.flatnonzero(links)
                if len(some):
                    up, down = graph.forest(label)
                    found.add(ids[some], links[some], ids[up], ids[down])
                    if found.held > 1_000_000:
                        found.compact()
                    if found.held > 500_000:
                        yield found.take()
        if found.held:
            yield found.take()

    return met.mapInArrow(run, "cid long, links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, dims: int = 8, key_dims: int = 4, sample: int = 20_000, block: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors of at least ``cosine``, computed in double precision, are linked; null, zero
    and non-finite ones, and vectors of different lengths, are not. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reachable, null ids left
    aside, and ``kept`` says that it is the row's own. Equal rows have equal results; other
    columns, whatever their names, play no part. The shared folder has to be one that
    workers can open as files.
    """
    spark = vectors.sparkSession
    eps = max(1e-3, max(0.0, 2 - 2 * cosine) ** 0.5)
    rows, found = classes(vectors, vec_id, embedding)
    kind = "<f4" if found.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    found, _ = materialize(found.withColumn("cid", F.monotonically_increasing_id()), "classes")
    turn = directions(found, sample, dims)
    folder = new_path(spark, "vectors")
    store, root = _files(folder)
    store.create_dir(root, recursive=True)
    parts = max(1, min(shuffle_partitions(spark), -(-found.count() // block)))
    blocks, _ = materialize(_blocks(_grid(found, turn, dims, eps), turn, dims, key_dims, block, parts, folder), "blocks")
    met = _meetings(blocks.select("block", "size", "low", "high", "cells"), key_dims, eps)
    of = lambda end, tail: blocks.select(F.col("block").alias(end), *(F.col(c).alias(c + tail) for c in ("file", "at", "n")), *([] if tail else ["size"]))
    # a tile of about 8 x 8 blocks that stand side by side goes to one task
    side = 3 if blocks.count() >= 8 * parts else 35
    tile = [F.shiftright(c, side) for c in ("a", "b")]
    met = met.join(of("a", ""), "a").join(of("b", "2"), "b").repartition(shuffle_partitions(spark), *tile).sortWithinPartitions("a", "b")
    met, _ = materialize(_joined(met, turn, dims, cosine, kind, folder), "links")
    links = met.where("links > 0").groupBy("cid").agg(F.sum("links").alias("links"))
    labels = graph.components(met.where("links = 0").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    known = found.drop("v").join(links, "cid", "left").join(labels, F.col("cid") == labels["node"], "left")
    known = known.select("k", "k2", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "cid").alias("label"))
    least = known.groupBy("label").agg(F.min("first").alias("component_id"))
    by_class = known.join(least, "label").select(F.col("k").alias("ck"), F.col("k2").alias("ck2"), "n_links", "component_id")
    out = rows.join(by_class, (rows["k"] == by_class["ck"]) & (rows["k2"] == by_class["ck2"]), "left")
    of_row = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of_row.alias("component_id"), F.coalesce(F.col("vec_id") == of_row, F.lit(False)).alias("kept"))
