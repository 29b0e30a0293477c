"""Benchmark decontamination over a distributed positional inverted index.

Training documents are tokenised once and indexed in segments: for every term of a
segment, the sorted positions of its tokens. The index is stored in the shared folder.
A test window waits at the term that is rarest over all segments, and is looked up
only in segments that hold that term; there the terms' lists, shifted by their places in
the window, are intersected one by one, the shorter before the longer.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.collocations import MAP_BITS, bitmap, hashed
from lodestone.llm.common import LOWER, UPPER, in_chunks, materialize, text_bytes

_KEPT = bytes(range(0x30, 0x3A)) + LOWER + UPPER + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_FOLD = bytes.maketrans(UPPER, LOWER)
_FOLD = bytes(_FOLD[c] if c in _KEPT else 0x20 for c in range(256))
#: Positions left free between two documents of a segment, so that no match crosses them.
GAP = 32


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """``terms, owners`` of distinct windows: every ``size`` consecutive words of each item (``item_id, text``), and the
    items that have it; fewer words, but not none, are one window."""

    def run(batches):
        for b in in_chunks(batches, "text"):
            names, made = [], []
            for name, text in zip(b.column("item_id").to_pylist(), text_bytes(b.column("text"))):
                w = words(text)
                own = [w[i : i + size] for i in range(max(1, len(w) - size + 1))] if w else []
                names += [name] * len(own)
                made += own
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.list_(pa.binary()))], names=["item_id", "terms"])

    rows = items.select("item_id", "text").mapInArrow(run, "item_id string, terms array<binary>")
    return rows.groupBy("terms").agg(F.collect_set("item_id").alias("owners"))


def _narrow(x: np.ndarray) -> bytes:
    """Gaps between sorted positions in the least unsigned type that holds them, its width first."""
    gaps = np.diff(x, prepend=0)
    kind = np.min_scalar_type(int(gaps.max()))
    return bytes([kind.itemsize]) + gaps.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64))


def term_map(windows: DataFrame) -> bytes:
    """A bitmap of the windows' terms, of a fixed size."""
    terms = windows.select(F.explode("terms").alias("word")).distinct()

    def run(batches):
        for b in batches:
            h = hashed(b.column("word").to_pylist(), 0)
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(h.view(np.int64))], names=["word", "h"])

    return bitmap(windows.sparkSession, terms.mapInArrow(run, "word binary, h long"))


def build_index(docs: DataFrame, terms: bytes | None = None, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = 4 << 20) -> DataFrame:
    """The index: a row ``segment, term, n, positions`` for each term of a segment, of which it
    has n tokens, and one with a null term that holds the segment's ``doc_ids`` and where each document begins and ends.

    ``terms``, a ``term_map``, leaves out words that are not asked for; a few that share a bit with one stay.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["segment", "term", "n", "positions", "doc_ids", "begins", "ends"]
    wanted = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        asked = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for b in in_chunks(batches, "text", segment_bytes):
            cut = [words(t) for t in text_bytes(b.column("text"))]
            size = np.fromiter(map(len, cut), np.int64, len(cut))
            ends = np.cumsum(size + GAP) - GAP
            begins = ends - size
            every = [w for c in cut for w in c]
            entries = list(set(every))
            if asked is not None and entries:
                cell = hashed(entries, 0) >> np.uint64(64 - MAP_BITS)
                there = asked[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1
                entries = [w for w, k in zip(entries, there.tolist()) if k]
            entries.sort()
            known = {w: i for i, w in enumerate(entries)}
            ids = np.fromiter(map(known.get, every, repeat(-1)), np.int64, len(every))
            at = np.arange(len(every)) + np.repeat(np.arange(len(cut)) * GAP, size)
            at, ids = at[ids >= 0], ids[ids >= 0]
            order = np.argsort(ids, kind="stable")
            at, ids = at[order], ids[order]
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else [0]
            name = f"{part}-{count}"
            count += 1
            n = len(cuts)
            key = b.column("doc_id")
            none = pa.nulls(n - 1, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * n, pa.string()),
                    pa.array([None, *(entries[ids[a]] for a in cuts[:-1])], pa.binary()),
                    pa.array([None, *(z - a for a, z in zip(cuts, cuts[1:]))], pa.int64()),
                    pa.array([None, *(_narrow(at[a:z]) for a, z in zip(cuts, cuts[1:]))], pa.binary()),
                    pa.concat_arrays([pa.ListArray.from_arrays([0, len(key)], key), pa.nulls(n - 1, pa.list_(key.type))]),
                    pa.concat_arrays([pa.array([begins.tolist()], pa.list_(pa.int64())), none]),
                    pa.concat_arrays([pa.array([ends.tolist()], pa.list_(pa.int64())), none]),
                ],
                names=names,
            )

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"segment string, term binary, n long, positions binary, doc_ids array<{kind}>, begins array<long>, ends array<long>")


def occurrences(lists: dict[bytes, np.ndarray], window: list[bytes], slop: int = 0) -> np.ndarray:
    """Where ``window`` starts: its words in order, each within ``slop`` places of its own (0: the exact phrase)."""
    if any(t not in lists for t in window):
        return np.empty(0, np.int64)
    places = sorted(enumerate(window), key=lambda x: len(lists[x[1]]))
    starts = lists[places[0][1]] - places[0][0]
    for k, term in places[1:]:
        if not len(starts):
            break
        there = lists[term] - k
        i = np.searchsorted(there, starts - slop)
        ok = i < len(there)
        ok[ok] = there[i[ok]] <= starts[ok] + slop
        starts = starts[ok]
    return starts


def find_windows(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """Matches of each indexed document: ``segment, place, doc_id, n_words, hits, items``.

    ``hits`` are the numbers of the words inside any match; ``items`` the distinct items
    that own a matching window (``terms, owners``). Every document of the index has a row.
    """
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    count = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    asked = windows.select("terms", F.explode(F.array_distinct("terms")).alias("term"))
    held = asked.join(count, "term").groupBy("terms").agg(F.count("*").alias("known"), F.min(F.struct("n", "term")).alias("rarest"))
    held = held.where(F.col("known") == F.size(F.array_distinct("terms"))).select("terms", F.col("rarest.term").alias("term"))
    waiting = held.join(windows, "terms")
    met = index.where("term IS NOT NULL").select("segment", "term").join(waiting, "term").select(F.col("segment").alias("within"), "terms", "owners")

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        term, positions = own.column("term").to_pylist(), own.column("positions")
        head = term.index(None)
        key = own.column("doc_ids").combine_chunks().slice(head, 1).flatten()
        begins, ends = (np.array(own.column(x)[head].as_py(), dtype=np.int64) for x in ("begins", "ends"))
        row_of = {t: i for i, t in enumerate(term) if t is not None}
        lists: dict[bytes, np.ndarray] = {}
        edge = np.zeros((ends[-1] if len(ends) else 0) + GAP + 1, np.int64)
        items: list[set[str]] = [set() for _ in begins]
        for window, owners in zip(found.column("terms").to_pylist(), found.column("owners").to_pylist()):
            if all(t in row_of for t in window):
                lists |= {t: _wide(positions[row_of[t]].as_py()) for t in window if t not in lists}
                at = occurrences(lists, window, slop)
                if len(at):
                    of = np.maximum(np.searchsorted(begins, at, "right") - 1, 0)
                    at = np.clip(at, begins[of], ends[of])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + len(window), ends[of]), -1)
                    for d in set(of.tolist()):
                        items[d].update(owners)
        hit = np.flatnonzero(np.cumsum(edge) > 0)
        cut = np.searchsorted(hit, begins), np.searchsorted(hit, ends)
        hits = [(hit[a:z] - s).tolist() for a, z, s in zip(*cut, begins)]
        n = len(begins)
        return pa.table(
            [pa.array(own.column("segment").to_pylist()[:1] * n, pa.string()), pa.array(range(n), pa.int64()), key, pa.array(ends - begins), pa.array(hits, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
            names=["segment", "place", "doc_id", "n_words", "hits", "items"],
        )

    schema = f"segment string, place long, doc_id {kind}, n_words long, hits array<long>, items array<string>"
    return index.drop("n").groupBy("segment").cogroup(met.groupBy("within")).applyInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 13, slop: int = 0, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, hits, items`` of every document, by one index of the words that may be asked for."""
    asked = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    windows, _ = materialize(windows_of(asked, size), "windows")
    index, _ = materialize(build_index(docs, term_map(windows), doc_id, text), "postings")
    return find_windows(index, windows, slop).drop("segment", "place")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, **columns) -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A document is contaminated if at least one word in ``share`` lies inside a test
    window. Null and empty texts have no words and are clean; so is all if the test set
    is empty or has null texts only. A null item id counts as the empty string. Repeated
    rows are repeated in the result.
    """
    found = matches(docs, benchmark, size, **columns)
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are clean.

    Rows of one id share the verdict of the worst of them, and so do all rows without an id.
    """
    bad = contamination(docs, benchmark, size, share, doc_id=doc_id, text=text).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__bad"]), "left_anti")
