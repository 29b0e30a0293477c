"""Column expressions over text: ids, hashes, chunks, tokens, display."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace that version-5 UUIDs of URLs are made in (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Characters of a chunk where no size is given.
DEFAULT_CHUNK = 1000
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def content_hash(content: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def point_uuid(key: Column) -> Column:
    """The id itself if it is a UUID, else its version-5 UUID among URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), key.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(key.rlike(UUID_PATTERN), F.lower(key)).otherwise(made)


def fallback_id(key: Column, content: Column) -> Column:
    """A missing id is made from the content, so that a retried task makes the same."""
    return F.coalesce(F.nullif(key, F.lit("")), point_uuid(content))


def _chunks(text: str, size: int) -> list[str]:
    """One text's chunks, in time that goes with its length: where lines end is known beforehand,
    and each chunk finds the last line that it has room for."""
    if len(text) <= size:
        return [text]
    text += "\n"
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    out, at, line = [], 0, 0
    while line < len(ends):
        for _ in range(max(0, -(-(int(ends[line]) - 1 - at) // size) - 1)):
            out.append(text[at : at + size])
            at += size
        line = max(line + 1, int(np.searchsorted(ends, at + size, side="right")))
        out.append(text[at : int(ends[line - 1])])
        at = int(ends[line - 1])
    return out


def chunk_text(text: Column, size: int = 1000) -> Column:
    """Chunks of about ``size`` characters (0 or less: 1000), as an array; null for a null text.

    A short text is one chunk. Else its lines, each with its newline, are packed in
    turn; a longer line is cut at every ``size`` characters and its rest packed on. A
    line of exactly ``size`` characters makes a chunk one character longer.
    """
    size = size if size > 0 else DEFAULT_CHUNK

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _chunks(t, size) for t in texts.to_pylist()], pa.list_(pa.string()))

    return cut(text)


def chunk_doc_id(source_dir: Column, path: Column, index: Column) -> Column:
    return F.concat(source_dir, F.lit("/"), path, F.lit("#chunk"), index.cast("string"))


def content_prefix(path: Column, chunk: Column) -> Column:
    """What is stored and embedded; the hash is of the chunk alone."""
    return F.concat(F.lit("File: "), path, F.lit("\n\n"), chunk)


def doc_root(doc_id: Column) -> Column:
    """A chunk's document: its id without the last #part, unless the # comes first."""
    return F.regexp_replace(doc_id, r"(?s)^(.+)#[^#]*$", "$1")


def preview(content: Column, size: int = 200) -> Column:
    return F.substring(content, 1, size)


def sanitize_project(name: Column) -> Column:
    """ASCII letters, digits, _ and - only; if none are left, 16 hex digits of the name's hash."""
    kept = F.regexp_replace(name, "[^A-Za-z0-9_-]", "")
    return F.when(kept == "", content_hash(name)).otherwise(kept)


def collection_name(project: Column) -> Column:
    return F.concat(F.lit("project_"), sanitize_project(project))


def project_of_collection(collection: Column) -> Column:
    """Null for collections that hold no project."""
    return F.when(collection.startswith("project_"), F.substr(collection, F.lit(len("project_") + 1)))


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits in order; no stop words, no stems."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: Column) -> Column:
    return F.array_distinct(tokens(query))


def lexical_match(terms: Column, words: Column) -> Column:
    """Every term occurs; no terms match nothing."""
    return (F.size(terms) > 0) & (F.size(F.array_except(terms, words)) == 0)


def ts_rank(terms: Column, words: Column) -> Column:
    """PostgreSQL's rank of a match with weight 0.1 for every word."""
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), F.array_position(terms, w).alias("term"))), lambda h: h["term"] > 0)
    return rank_hits(hits, F.size(terms))


#: Places of different terms that lie further apart than this add nothing that a score can show.
FAR = 100


def _rank(at: np.ndarray, term: np.ndarray, n_terms: int) -> float:
    if n_terms == 1:
        return float(0.1 * (1 / np.arange(1.0, max(1, len(at)) + 1) ** 2).sum() / 1.64493406685)
    misses = 1.0
    for k in range(1, min(FAR, len(at) - 1) + 1):  # places differ, so no two within reach have more than FAR between them
        gap = at[k:] - at[:-k]
        near = (gap <= FAR) & (term[k:] != term[:-k])
        misses *= np.prod(1 - np.sqrt(0.01 / (1.005 + 0.05 * np.exp(gap[near] / 1.5 - 2))))
    return float(1 - misses)


def rank_hits(hits: Column, n_terms: Column) -> Column:
    """The rank from the places where query terms stand, (at, term) structs in order of place.

    One term: the sum of 1/j^2 over its hits, scaled by 6/pi^2. Several: each pair of
    places of different terms weighs by how near they are, and the weights combine as
    independent chances. The work goes with the number of hits, as pairs far apart weigh nothing.
    """

    @F.arrow_udf("double")
    def rank(hits: pa.Array, n: pa.Array) -> pa.Array:
        edges = np.asarray(hits.offsets)
        flat = hits.flatten()
        at, term = (np.asarray(flat.field(i)).astype(np.int64) for i in range(2))
        edges = edges - edges[0] if len(edges) else edges
        ranks = [None if k is None else _rank(at[a:b], term[a:b], k) for a, b, k in zip(edges, edges[1:], n.to_pylist())]
        return pa.array(ranks, pa.float64(), mask=np.asarray(hits.is_null()))

    return rank(hits, n_terms)


def highlight(content: Column, terms: Column) -> Column:
    """Query terms of two characters or more wrapped in <mark>, whatever their case."""
    quoted = F.transform(F.filter(terms, lambda t: F.char_length(t) > 1), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
    return F.when(F.size(quoted) > 0, F.regexp_replace(content, F.concat(F.lit("(?i)("), F.array_join(quoted, "|"), F.lit(")")), F.lit("<mark>$1</mark>"))).otherwise(content)


def score_band(score: Column, good: float = 0.75, warn: float = 0.5) -> Column:
    return F.when(score >= good, "good").when(score >= warn, "warn").otherwise("faint")
