"""Packing documents into as few sequences of a fixed number of tokens as possible.

Only what the packing needs of a document moves: the lengths of its pieces. Every task
encodes its own texts and numbers its pieces of each length; how often each length occurs,
``capacity`` numbers at most however large the corpus is, decides how sequences are filled; and
a piece finds its place from its number among the pieces of its length.

Sequences are filled by bin completion: the largest length that is left is completed by
fillings that no other filling dominates, branch by branch, as long as the waste so far leaves
room for fewer sequences than the best packing known, which at first is the best-fit one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import in_chunks, materialize
from lodestone.llm.token_files import _encoder

#: A filling is ((length, how often), ...); a packing gives fillings and in how many sequences each is used.
Filling = tuple[tuple[int, int], ...]
Packing = list[tuple[Filling, int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: for each threshold, pieces above half of the capacity
    stand alone, and those from the threshold up to half fill what these leave."""
    n = np.zeros(capacity + 2, dtype=object)
    for length, c in counts.items():
        n[length] = int(c)
    size = n * np.arange(capacity + 2, dtype=object)
    above = np.cumsum(n[::-1])[::-1]  # pieces of this length or more
    weight = np.cumsum(size[::-1])[::-1]
    half = capacity // 2 + 1
    best = 0
    for k in range(half):
        alone, large = above[capacity - k + 1], above[half]
        middle = large - alone
        room = middle * capacity - (weight[half] - weight[capacity - k + 1])
        best = max(best, large + max(0, -(-(weight[k] - weight[half] - room) // capacity)))
    return int(best)


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing over counts: sequences filled alike move together, so the work goes by lengths, not by pieces."""
    groups: dict[int, list[tuple[Counter, int]]] = {0: []}  # by room left
    rooms: list[int] = []  # those that have groups, in order

    def put(room: int, filling: Counter, copies: int) -> None:
        if copies:
            if not groups.setdefault(room, []):
                insort(rooms, room)
            groups[room].append((filling, copies))

    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                filling, copies = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, filling, copies = capacity, Counter(), -(-left // (capacity // length))
            uses = room // length
            full = min(copies, left // uses)
            put(room - uses * length, filling + Counter({length: uses}), full)
            left -= full * uses
            copies -= full
            if copies and left:
                put(room - left * length, filling + Counter({length: left}), 1)
                left, copies = 0, copies - 1
            if filling:
                put(room, filling, copies)
    return [(tuple(sorted(f.items(), reverse=True)), c) for g in groups.values() for f, c in g]


def fillings(counts: list[int], lengths: list[int], room: int, waste: int, most: int = 12, steps: int = 400) -> list[Filling]:
    """Ways to fill ``room`` from what is left that waste at most ``waste`` and take no further
    piece, without those that another one dominates; least waste first, ``most`` of them at most.

    ``lengths`` fall. Exact fillings are looked for first, then ever more waste is let pass; each
    search goes from large pieces to small ones, for ``steps`` steps.
    """
    there = [x for x, c in zip(lengths, counts) if c and x <= room]
    have = {x: c for x, c in zip(lengths, counts) if c and x <= room}
    falling = [-x for x in there]
    smallest = there[-1] if there else room + 1
    found: list[Filling] = []

    def walk(i: int, room: int, taken: list[int]) -> bool:
        """Whether to go on."""
        nonlocal left
        left -= 1
        fits = False
        for j in range(max(i, bisect_left(falling, -room)), len(there)):
            x = there[j]
            if have[x]:
                fits = True
                have[x] -= 1
                on = walk(j, room - x, [*taken, x])
                have[x] += 1
                if not on:
                    return False
                if x == room:
                    break  # an exact fit dominates all else that begins like this
        if not fits and room <= allowed and (room < smallest or not any(have[x] for x in there[bisect_left(falling, -room) :])):
            found.append(tuple(Counter(taken).items()))
            return left > 0 and not (room == 0 and len(taken) <= 1) and len(found) < 2 * most
        return left > 0

    for allowed in (*(x for x in (0, 2, 8, 32, 128) if x < waste), waste):
        left = steps
        walk(0, room, [])
        if found:
            break
    found.sort(key=lambda f: -sum(x * n for x, n in f))
    kept: list[Filling] = []
    for f in found:
        if len(kept) < most and not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept


def dominates(a: Filling, b: Filling) -> bool:
    """Whether the pieces of b can be dealt into groups that each fit into one piece of a: then b's
    pieces may change places with those of a, and a is never the worse choice."""
    small = sorted((x for x, n in b for _ in range(n)), reverse=True)
    if len(small) > 6:
        return False
    rooms = [x for x, n in a for _ in range(min(n, len(small)))]

    def deal(i: int) -> bool:
        if i == len(small):
            return True
        tried = set()
        for j, r in enumerate(rooms):
            if r >= small[i] and r not in tried:
                tried.add(r)
                rooms[j] = r - small[i]
                if deal(i + 1):
                    return True
                rooms[j] = r
        return False

    return a != b and deal(0)


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 10_000) -> Packing:
    """A packing of few sequences: never more than best fit has, and fewer as far as ``nodes`` steps
    find them. It stops at the lower bound, where there can be no fewer."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    most, least = sum(c for _, c in best), lower_bound(counts, capacity)
    total = sum(k * v for k, v in counts.items())
    lengths = sorted(counts, reverse=True)
    place = {x: i for i, x in enumerate(lengths)}

    def branches(left: list[int], wasted: int) -> Iterator[tuple[Filling, int]]:
        i = next(i for i, c in enumerate(left) if c)
        largest = lengths[i]
        left[i] -= 1
        spare = (most - 1) * capacity - total - wasted
        made = fillings(left, lengths, capacity - largest, spare) if spare >= 0 else []
        left[i] += 1
        for f in made:
            whole = Counter(dict(f)) + Counter({largest: 1})
            filling = tuple(sorted(whole.items(), reverse=True))
            again = min(left[place[x]] // n for x, n in filling)
            waste = capacity - sum(x * n for x, n in filling)
            again = min(again, spare // waste) if waste else again
            yield from ((filling, n) for n in dict.fromkeys((again, 1)) if n > 0)

    left, used, wasted = [counts[x] for x in lengths], 0, 0
    path: Packing = []
    stack = [branches(left, 0)] if most > least else []
    while stack and nodes and most > least:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                filling, n = path.pop()
                for x, uses in filling:
                    left[place[x]] += uses * n
                used, wasted = used - n, wasted - n * (capacity - sum(x * k for x, k in filling))
            continue
        nodes -= 1
        filling, n = step
        waste = n * (capacity - sum(x * k for x, k in filling))
        if wasted + waste > (most - 1) * capacity - total:
            continue
        for x, uses in filling:
            left[place[x]] -= uses * n
        path.append(step)
        used, wasted = used + n, wasted + waste
        if any(left):
            stack.append(branches(left, wasted))
        else:
            if used < most:
                best, most = list(path), used
            stack.append(iter(()))
    return best


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what whole pieces leave."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces, encoded where its text is read: ``doc_id, piece, start, length,
    ids_crc32, part, nth`` and, if asked for, ``ids``; ``nth`` counts a task's pieces of one length."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]

    def run(batches):
        encoder, part = _encoder(definition)[0], TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in in_chunks(batches, "text"):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(encoder.encode([t or "" for t in b.column("text").to_pylist()])):
                raw += end
                for p, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    own = raw[4 * s : 4 * (s + n)]
                    row.append(i), piece.append(p), start.append(s), length.append(n), crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int64))
            n = np.array(length)
            order = np.argsort(n, kind="stable")
            have = np.bincount(n, minlength=capacity + 1)
            nth = np.empty(len(n), np.int64)
            nth[order] = np.arange(len(n)) - (np.cumsum(have) - have)[n[order]] + seen[n[order]]
            seen += have
            arrays = [b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(nth)]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])], names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<long>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def place(cut_up: DataFrame, capacity: int = 2048, nodes: int = 10_000) -> DataFrame:
    """Written pieces (``part, length, nth`` and more) with ``sequence_id`` and ``offset``.

    Only the counts of lengths come to the driver, ``capacity`` rows at most; the packing that goes
    out to tasks has a few entries for each length.
    """
    counts = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    entries, base = [], 0
    taken: Counter = Counter()
    for filling, copies in bin_completion(counts, capacity, nodes):
        at = 0
        for length, uses in filling:
            entries.append((length, taken[length], base, uses, at))
            taken[length] += uses * copies
            at += uses * length
        base += copies
    table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)
    # a piece's entry is the last of its length that begins at or before its number
    known = cut_up.sparkSession.sparkContext.broadcast(((table[:, 0] << 48) | table[:, 1], table))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = cut_up.groupBy("part", "length").agg(F.count("*").alias("n")).select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def run(batches):
        keys, t = known.value
        for b in batches:
            length = b.column("length").to_numpy()
            nth = b.column("nth").to_numpy() + b.column("first").to_numpy()
            e = t[np.searchsorted(keys, (length << 48) | nth, side="right") - 1]
            nth = nth - e[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(e[:, 2] + nth // e[:, 3]), pa.array(e[:, 4] + nth % e[:, 3] * length)], names=[*b.schema.names, "sequence_id", "offset"])

    met = cut_up.join(first, ["part", "length"])
    schema = met.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return met.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, nodes: int = 10_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where every piece of every document stands: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Each row is a document of its own, whatever its id; null and empty texts are the end id
    alone. Without documents there are no pieces. Other columns are not looked at.
    """
    cut_up, _ = materialize(pieces(docs, tokenizer_path, capacity, end_id, False, doc_id, text), "pieces")
    return place(cut_up, capacity, nodes).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, nodes: int = 10_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The sequences themselves: ``sequence_id, ids, doc_ids, offsets``, the pieces in the order they stand in.

    A sequence has ``capacity`` ids at most, so it is a small group whatever the corpus."""
    cut_up, _ = materialize(pieces(docs, tokenizer_path, capacity, end_id, True, doc_id, text), "pieces")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = place(cut_up, capacity, nodes).groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
