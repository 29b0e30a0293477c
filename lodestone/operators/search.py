"""Search for a whole table of queries at once.

``queries`` has ``query_id, project_id`` and, as needed, ``query`` and ``query_vec``;
``chunks`` has ``project_id, id, content`` and, as needed, ``embedding`` and ``words``.
Ranks go by the score rounded to nine places, then by id, so equal scores never
depend on the order of arrival.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lodestone.functions import text, vectors
from lodestone.functions.batches import slices
from lodestone.sources.store import kept, shared_dir

DEFAULT_K, DEFAULT_RECALL = 5, 25
#: Query rows of this many bytes at most are broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Scores that a task holds at a time, whatever the number of queries.
CELLS = 1 << 20
#: Words that a task looks at together, whatever a batch holds.
WORDS = 1 << 19


def resolve_options(requests: DataFrame) -> DataFrame:
    """Requests with ``k`` and ``recall`` filled in: k, else limit, else 5; recall 25, never below k."""
    k = F.coalesce(*(F.when(F.col(c) > 0, F.col(c)) for c in ("k", "limit")), F.lit(DEFAULT_K))
    r = F.coalesce(F.when(F.col("recall") > 0, F.col("recall")), F.lit(DEFAULT_RECALL))
    return requests.withColumns({"k": k, "recall": F.greatest(r, k)})


def small(queries: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``queries`` marked for broadcast if their measured size allows it."""
    return F.broadcast(queries) if _size(queries) <= limit else queries


def _size(queries: DataFrame) -> int:
    """An upper bound of their bytes from counts: a fixed part for each row, the text's bytes and the vector's doubles."""
    size = F.lit(64)
    for name, kind in queries.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            size = size + F.coalesce(F.size(name), F.lit(0)) * (16 if "string" not in kind else 64)
    return queries.agg(F.sum(size)).first()[0] or 0


def query_chunk_pairs(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each query beside every chunk of its project."""
    return chunks.join(small(queries), "project_id")


def _top(scored: DataFrame, recall: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= recall)


def _matrix(vectors_: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows whose vectors are ``dim`` long and hold numbers only, those vectors as doubles)."""
    fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors_), dim), False).to_numpy(zero_copy_only=False))
    m = pc.list_flatten(vectors_.take(pa.array(fit))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(m).all(1)
    return fit[good], m[good]


def _scores(asked: np.ndarray, known: np.ndarray, metric: str) -> np.ndarray:
    """Scores of queries (rows) and chunks (columns); NaN where a cosine has no value."""
    if metric == "dot":
        return asked @ known.T
    if metric == "l2":
        return np.stack([1 - ((known - q) ** 2).sum(1) for q in asked]) if len(asked) else np.empty((0, len(known)))
    size = np.sqrt((asked**2).sum(1))[:, None] * np.sqrt((known**2).sum(1))[None]
    return np.divide(asked @ known.T, size, out=np.full(size.shape, np.nan), where=size > 0)


def _best(scores: np.ndarray, ids: list, k: int, held: np.ndarray | None = None):
    """(rows, columns) of the k best scores of each row, ties by id.

    ``held`` has each row's k best rounded scores so far, the least first: what is below that is left out, and they are brought up to date.
    """
    places = np.round(np.where(np.isnan(scores), -np.inf, scores), 9)
    rows = np.arange(len(places)) if held is None or not places.size else np.flatnonzero(places.max(1) >= held[:, 0])
    met = [np.empty(0, np.int64)]
    for r in rows.tolist():
        row = places[r]
        at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
        at = at[row[at] > -np.inf]
        at = at if held is None else at[row[at] >= held[r, 0]]
        if len(at) > k:
            at = np.array(sorted(at.tolist(), key=lambda c: (-row[c], ids[c]))[:k])
        if held is not None and len(at):
            held[r] = np.sort(np.concatenate([held[r], row[at]]))[-k:]
        met.append(at)
    return np.repeat(rows, [len(at) for at in met[1:]]), np.concatenate(met)


def _met(asked: np.ndarray, known: np.ndarray, ids: list, k: int, metric: str, held: np.ndarray | None = None):
    """(queries, chunks, scores) of each query's k best, for as many queries at a time as ``CELLS`` scores allow."""
    rows = max(1, CELLS // max(1, len(known)))
    for a in range(0, len(asked), rows):
        scores = _scores(asked[a : a + rows], known, metric)
        r, c = _best(scores, ids, k, None if held is None else held[a : a + rows])
        if len(r):
            yield r + a, c, scores[r, c]


def _dim(queries: DataFrame) -> int:
    return queries.agg(F.max(F.size("query_vec"))).first()[0] or 0


def topk_dense(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_K, metric: str = "cosine", columns: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest chunks of each query: ``query_id, id, score, rank`` and ``columns``.

    Cosine scores are similarities; with ``l2`` the score is 1 - squared distance. Vectors that are null, of another
    length than the queries' or hold what is no number are near nothing, nor, by cosine, zero vectors. Queries of checked size
    go to all chunks; more of them meet the chunks in tiles. Either way scores are matrix products of a bounded size, and
    only the best rows of each go on.
    """
    k = k if k > 0 else DEFAULT_K
    asked = queries.select("query_id", "project_id", "query_vec").where("query_vec IS NOT NULL")
    known = chunks.select("project_id", "id", "embedding").where("embedding IS NOT NULL")
    scored = _scan_scores(asked, known, k, metric) if _size(asked) <= BROADCAST_BYTES else _tile_scores(asked, known, k, metric)
    best = _top(scored, k)
    best = best.join(chunks.select("project_id", "id", *columns), ["project_id", "id"]) if columns else best
    return best.select("query_id", "id", *columns, "score", "rank")


def _scored(asked: DataFrame, known: DataFrame) -> tuple[str, pa.DataType]:
    """The schema of scored pairs, and Arrow's type of the query's id in it."""
    q, i = asked.schema["query_id"].dataType, known.schema["id"].dataType
    project = known.schema["project_id"].dataType.simpleString()
    return f"query_id {q.simpleString()}, project_id {project}, id {i.simpleString()}, score double", to_arrow_type(q)


def _scan_scores(asked: DataFrame, known: DataFrame, k: int, metric: str) -> DataFrame:
    """Each batch of chunks' k best for each query of its project."""
    rows = asked.collect()  # of checked size
    dim = max((len(r.query_vec) for r in rows), default=0)
    groups: dict = {}
    for r in rows:
        if len(r.query_vec) == dim and None not in r.query_vec and dim:
            groups.setdefault(r.project_id, []).append(r)
    schema, query_kind = _scored(asked, known)
    packed = {p: (pa.array([r.query_id for r in g], query_kind), np.array([r.query_vec for r in g], np.float64)) for p, g in groups.items()}
    sent = asked.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        # a task's best scores so far, of the projects that it meets, while there is room: a batch passes on only what may be among them
        held, room = {}, 4 * CELLS
        for b in slices(batches, "embedding", CELLS):
            fit, m = _matrix(b.column("embedding"), dim) if dim and b.num_rows else (np.empty(0, np.int64), None)
            project = b.column("project_id").dictionary_encode()
            code = project.indices.to_numpy(zero_copy_only=False)
            for n, p in enumerate(project.dictionary.to_pylist() if len(fit) else []):
                if p in sent.value:
                    own = np.flatnonzero(code[fit] == n)
                    ids, q = sent.value[p]
                    rows = pa.array(fit[own])
                    names = b.column("id").take(rows)
                    if p not in held and len(ids) * k <= room:
                        held[p], room = np.full((len(ids), k), -np.inf), room - len(ids) * k
                    for r, c, score in _met(q, m[own], names.to_pylist(), k, metric, held.get(p)):
                        at = pa.array(c)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), b.column("project_id").take(rows).take(at), names.take(at), pa.array(score)], names=["query_id", "project_id", "id", "score"])

    return known.mapInArrow(run, schema)


def _tiles(rows: DataFrame, key: str, vector: str, dim: int, size: int) -> DataFrame:
    """``project_id, tile, keys, matrix``: vectors packed where they are, at most ``size`` bytes of them to a row."""
    kind, project = rows.schema[key].dataType.simpleString(), rows.schema["project_id"].dataType.simpleString()
    most = max(1, size // (8 * dim))

    def run(batches):
        part, tile = TaskContext.get().partitionId(), 0
        for b in slices(batches, vector, CELLS):
            fit, m = _matrix(b.column(vector), dim)
            names = b.column("project_id").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)[fit] if len(fit) else np.empty(0, np.int64)
            for n in np.unique(code):
                own = np.flatnonzero(code == n)
                for a in range(0, len(own), most):
                    at = own[a : a + most]
                    keys = b.column(key).take(pa.array(fit[at]))
                    yield pa.RecordBatch.from_arrays([names.dictionary.slice(int(n), 1), pa.array([(part << 32) + tile], pa.int64()), pa.ListArray.from_arrays([0, len(at)], keys), pa.array([m[at].tobytes()], pa.binary())], names=["project_id", "tile", "keys", "matrix"])
                    tile += 1

    return rows.select("project_id", key, vector).mapInArrow(run, f"project_id {project}, tile long, keys array<{kind}>, matrix binary")


def _tile_scores(asked: DataFrame, known: DataFrame, k: int, metric: str, size: int = 4 << 20) -> DataFrame:
    """The k best of each pair of a tile of queries and a tile of chunks of one project.

    A project's chunk tiles are dealt to as many groups as there are shuffle partitions, and its query tiles go to each
    of them, so that a hot project is spread over all tasks.
    """
    dim = _dim(asked)
    spread = max(1, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = _tiles(known, "id", "embedding", dim, size).withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(spread)).cast("int"))
    right = _tiles(asked, "query_id", "query_vec", dim, size).select("project_id", F.col("keys").alias("asking"), F.col("matrix").alias("query_matrix"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    schema = _scored(asked, known)[0]

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                q, e = (np.frombuffer(b.column(c)[r].as_buffer(), np.float64).reshape(-1, dim) for c in ("query_matrix", "matrix"))
                names, asking = b.column("keys")[r].values, b.column("asking")[r].values
                for i, c, score in _met(q, e, names.to_pylist(), k, metric):
                    yield pa.RecordBatch.from_arrays([asking.take(pa.array(i)), b.column("project_id").take(pa.array(np.full(len(c), r))), names.take(pa.array(c)), pa.array(score)], names=["query_id", "project_id", "id", "score"])

    return left.join(right, ["project_id", "part"]).mapInArrow(run, schema)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre, for as many rows at a time as ``CELLS`` distances allow."""
    size, most = (centres**2).sum(1), max(1, CELLS // len(centres))
    return np.concatenate([np.empty(0, np.int64), *(np.argmin(size - 2 * rows[a : a + most] @ centres.T, axis=1) for a in range(0, len(rows), most))])


def _kmeans(rows: np.ndarray, k: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    """Centres of at most k groups of the rows of a bounded sample."""
    centres = rows[draw.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = _nearest(rows, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, rows[:, j], len(centres)) for j in range(rows.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def write_vector_index(chunks: DataFrame, path: str, cells: int | None = None, pieces: int = 16, sample: int = 20_000, seed: int = 7) -> None:
    """Store an inverted file of the chunks' vectors below ``path``: partitions by cell, and in each row a code of ``pieces`` bytes
    for what the cell's centre leaves over, beside the vector itself.

    Centres and code words are fitted on at most about ``sample`` vectors, chosen by a hash of their ids; every chunk is indexed
    whose vector is of the common length and no zero vector. ``cells`` are by default about the root of the number of chunks, 4096 at most.
    How many cells a search has to probe, and how many candidates to score anew, is measured against the exact neighbours of some of the vectors.
    """
    spark = chunks.sparkSession
    known = chunks.select("project_id", "id", "embedding").where("embedding IS NOT NULL AND size(embedding) > 0")
    about = known.agg(F.count("*").alias("n"), F.mode(F.size("embedding")).alias("dim")).first()
    n, dim = about.n, about.dim or 1
    cells = cells or int(min(4096, max(1, 2 ** round(np.log2(max(1, n)) / 2))))
    some = known if n <= sample else known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < int(sample / n * 2**32))
    taught = some.orderBy("id").select("embedding").toArrow().column("embedding").combine_chunks()
    _, rows = _matrix(taught, dim)
    length = np.sqrt((rows**2).sum(1))
    rows = rows[length > 0] / length[length > 0, None]
    draw = np.random.default_rng(seed)
    centres = _kmeans(rows, cells, 10, draw) if len(rows) else np.zeros((1, dim))
    near = _nearest(rows, centres)
    edges = np.linspace(0, dim, min(pieces, dim) + 1).astype(int).tolist()
    left = rows - centres[near]
    words = [_kmeans(left[:, a:b], 256, 8, draw) if len(rows) else np.zeros((1, b - a)) for a, b in zip(edges, edges[1:])]
    model = spark.sparkContext.broadcast((centres, words))
    kinds = dict(known.dtypes)

    def run(batches):
        centres, words = model.value
        for b in batches:
            fit, m = _matrix(b.column("embedding"), dim)
            size = np.sqrt((m**2).sum(1))
            fit, m = fit[size > 0], m[size > 0] / size[size > 0, None]
            cell = _nearest(m, centres)
            rest = m - centres[cell]
            code = np.stack([np.argmin((w**2).sum(1) - 2 * rest[:, a:e] @ w.T, axis=1) for w, a, e in zip(words, edges, edges[1:])], axis=1).astype(np.uint8)
            at = pa.array(fit)
            yield pa.RecordBatch.from_arrays([b.column("project_id").take(at), b.column("id").take(at), pa.array([x.tobytes() for x in code], pa.binary()), b.column("embedding").take(at), pa.array(cell, pa.int32())], names=["project_id", "id", "code", "embedding", "cell"])

    coded = known.mapInArrow(run, f"project_id {kinds['project_id']}, id {kinds['id']}, code binary, embedding {kinds['embedding']}, cell int")
    coded.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/cells")
    stored = spark.read.schema(coded.schema).parquet(f"{path}/cells")
    probes, refine = _measured(stored, centres, words, dim)
    about = (int(dim), edges, centres.astype(float).tolist(), [w.tolist() for w in words], coded.schema.json(), probes, refine)
    spark.createDataFrame([about], "dim int, edges array<int>, centres array<array<double>>, words array<array<array<double>>>, kinds string, probes int, refine int").write.parquet(f"{path}/model")


def _decoded(cell: np.ndarray, code: pa.Array | list, centres: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The vectors that cells and codes stand for."""
    code = np.frombuffer(b"".join(code if isinstance(code, list) else code.to_pylist()), np.uint8).reshape(len(cell), len(words))
    return centres[cell] + np.concatenate([w[code[:, j]] for j, w in enumerate(words)], axis=1)


def _measured(stored: DataFrame, centres: np.ndarray, words: list[np.ndarray], dim: int, tests: int = 200, k: int = DEFAULT_K, share: float = 0.975) -> tuple[int, int]:
    """(probes, refine) with which ``tests`` of the stored vectors find ``share`` of their exact ``k`` neighbours, themselves left out, in each of
    the two steps: those whose cell is probed, and of these the ones that their codes rank high enough. Each takes a pass over all vectors."""
    spark = stored.sparkSession
    asks = stored.select(F.col("id").alias("query_id"), "project_id", F.col("embedding").alias("query_vec")).where(F.size("query_vec") == dim)
    asks = spark.createDataFrame(asks.orderBy(F.xxhash64("query_id"), "query_id", "project_id").limit(tests).collect(), asks.schema)
    rows = [(r.query_id, r.project_id, r.query_vec) for r in asks.collect()]
    number = {r[:2]: i for i, r in enumerate(rows)}
    exact = topk_dense(asks, stored, k + 1).where("query_id <> id").join(asks.select("query_id", "project_id"), "query_id")
    near = exact.join(stored.select("project_id", "id", "cell", "code"), ["project_id", "id"]).select("query_id", "project_id", "cell", "code").collect()
    near = [r for r in near if (r.query_id, r.project_id) in number]
    if not near:
        return len(centres), 20
    q = np.array([r[2] for r in rows], np.float64)
    q = q / np.sqrt((q**2).sum(1, keepdims=True))
    place = np.argsort(np.argsort((centres**2).sum(1) - 2 * q @ centres.T, axis=1, kind="stable"), axis=1)
    of, cell = np.array([number[r.query_id, r.project_id] for r in near]), np.array([r.cell for r in near])
    probes = int(np.quantile(place[of, cell], share, method="higher")) + 1
    least = (q[of] * _decoded(cell, [bytes(r.code) for r in near], centres, words)).sum(1)
    sent = spark.sparkContext.broadcast((q, place < probes, [r[1] for r in rows], of, least, centres, words))

    def run(batches):
        q, probed, projects, of, least, centres, words = sent.value
        for b in batches:
            cell, project = b.column("cell").to_numpy(), b.column("project_id").to_pylist()
            guess = q @ _decoded(cell, b.column("code"), centres, words).T
            own = {p: np.array([x == p for x in project], bool) for p in set(projects)}
            for i, p in enumerate(projects):
                guess[i, ~(probed[i][cell] & own[p])] = -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(of))), pa.array([int((guess[i] > x).sum()) for i, x in zip(of, least)], pa.int64())], names=["number", "better"])

    better = stored.select("project_id", "cell", "code").mapInArrow(run, "number long, better long").groupBy("number").agg(F.sum("better").alias("n")).collect()
    ranks = np.array([r.n for r in better if place[of[r.number], cell[r.number]] < probes])
    return probes, max(20, -(-(int(np.quantile(ranks, share, method="higher")) + 1) // k))


def topk_approx(queries: DataFrame, chunks: DataFrame | None = None, k: int = DEFAULT_K, index: str | None = None, probes: int | None = None, refine: int | None = None) -> DataFrame:
    """Near chunks from a stored inverted file: ``query_id, id, score, rank``, with exact cosine scores.

    A query reads the ``probes`` cells whose centres are nearest, ranks what is in them by its codes, and scores the
    ``refine`` x k best anew from their vectors. Both are by default what the index has measured: about 0.95 of the exact
    neighbours are found, whatever the number of cells. Without ``index``, the path of one, the chunks' is written first.
    """
    spark = queries.sparkSession
    if index is None:
        index = f"{shared_dir(spark)}/vectors-{uuid4().hex}"
        write_vector_index(chunks, index)
    k = k if k > 0 else DEFAULT_K
    m = spark.read.parquet(f"{index}/model").first()
    model = spark.sparkContext.broadcast((np.array(m.centres), [np.array(w) for w in m.words]))
    dim = m.dim
    probes, refine = probes or m.probes, refine or m.refine
    cells = spark.read.schema(StructType.fromJson(json.loads(m.kinds))).parquet(f"{index}/cells")
    asked = queries.select("query_id", "project_id", "query_vec").where(F.size("query_vec") == dim)

    def near(batches):
        centres, _ = model.value
        for b in batches:
            fit, v = _matrix(b.column("query_vec"), dim)
            size = np.sqrt((v**2).sum(1))
            fit, v = fit[size > 0], v[size > 0] / size[size > 0, None]
            order = np.argsort((centres**2).sum(1) - 2 * v @ centres.T, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(fit, order.shape[1]))
            unit = pa.array([x.tobytes() for x in v], pa.binary()).take(pa.array(np.repeat(np.arange(len(fit)), order.shape[1])))
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("project_id").take(at), unit, pa.array(order.reshape(-1), pa.int32())], names=["query_id", "project_id", "unit", "cell"])

    kinds = dict(asked.dtypes)
    probing = asked.mapInArrow(near, f"query_id {kinds['query_id']}, project_id {kinds['project_id']}, unit binary, cell int")
    probing = kept(probing, "probes")  # it is measured and then read again, as are the first candidates
    wanted = [r.cell for r in probing.select("cell").distinct().collect()]  # cells are a bounded number
    cells = cells.where(F.col("cell").isin(wanted))
    first = (_scan_cells if _size(probing) <= BROADCAST_BYTES else _join_cells)(probing, cells, model, dim, k * refine)
    order = Window.partitionBy("query_id").orderBy(F.col("guess").desc(), "id")
    first = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k * refine).drop("n", "guess")
    first = kept(first, "candidates")
    exact = cells.select("project_id", "cell", "id", "embedding").join(small(first), ["project_id", "cell", "id"]).join(small(asked.select("query_id", "query_vec")), "query_id")
    return _top(exact.select("query_id", "id", vectors.cosine(F.col("embedding"), F.col("query_vec")).alias("score")).where("score is not null"), k)


def _scan_cells(probing: DataFrame, cells: DataFrame, model, dim: int, k: int) -> DataFrame:
    """``query_id, project_id, cell, id, guess``: each batch's k best for each query that probes the cell; queries are of checked size."""
    asking: dict = {}
    number: dict = {}
    for r in probing.collect():
        asking.setdefault((r.project_id, r.cell), []).append(number.setdefault((r.query_id, bytes(r.unit)), len(number)))
    sent = probing.sparkSession.sparkContext.broadcast(({c: np.array(n) for c, n in asking.items()}, [i for i, _ in number], np.frombuffer(b"".join(v for _, v in number), np.float64).reshape(-1, dim)))
    query_kind, kinds = to_arrow_type(probing.schema["query_id"].dataType), dict(probing.dtypes) | dict(cells.select("project_id", "id").dtypes)

    def run(batches):
        (asking, names, units), (centres, words) = sent.value, model.value
        held = np.full((len(names), k), -np.inf) if len(names) * k <= 4 * CELLS else None
        for b in batches:
            cell, project = b.column("cell").to_numpy(), b.column("project_id").dictionary_encode()
            code, whose = project.indices.to_numpy(zero_copy_only=False), project.dictionary.to_pylist()
            for p, c in np.unique(np.stack([code, cell]), axis=1).T.tolist() if b.num_rows else []:
                own, some = np.flatnonzero((code == p) & (cell == c)), asking.get((whose[p], c))
                if some is None:
                    continue
                rows = pa.array(own)
                ids, best = b.column("id").take(rows), None if held is None else held[some]
                for r, at, guess in _met(units[some], _decoded(cell[own], b.column("code").take(rows), centres, words), ids.to_pylist(), k, "dot", best):
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some[r].tolist()], query_kind), b.column("project_id").take(rows).take(at), b.column("cell").take(rows).take(at), ids.take(at), pa.array(guess)], names=["query_id", "project_id", "cell", "id", "guess"])
                if held is not None:
                    held[some] = best

    return cells.select("project_id", "cell", "id", "code").mapInArrow(run, f"query_id {kinds['query_id']}, project_id {kinds['project_id']}, cell int, id {kinds['id']}, guess double")


def _join_cells(probing: DataFrame, cells: DataFrame, model, dim: int, k: int) -> DataFrame:
    """The same by a join, in which every pair is a row, of more queries than can be sent to all tasks."""
    met = cells.select("project_id", "cell", "id", "code").join(probing, ["project_id", "cell"])

    def guess(batches):
        centres, words = model.value
        for b in batches:
            if b.num_rows:
                unit = np.frombuffer(b"".join(b.column("unit").to_pylist()), np.float64).reshape(-1, dim)
                score = (unit * _decoded(b.column("cell").to_numpy(), b.column("code"), centres, words)).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("project_id"), b.column("cell"), b.column("id"), pa.array(score)], names=["query_id", "project_id", "cell", "id", "guess"])

    kinds = dict(probing.dtypes) | dict(cells.select("project_id", "id").dtypes)
    return met.mapInArrow(guess, f"query_id {kinds['query_id']}, project_id {kinds['project_id']}, cell int, id {kinds['id']}, guess double")


def postings(chunks: DataFrame) -> DataFrame:
    """The inverted index: ``term, project_id, id, positions``, one row for each distinct word of a chunk.

    A chunk holds all of its own places, so nothing is shuffled.
    """
    kinds = dict(chunks.select("project_id", "id").dtypes)

    def run(batches):
        for b in slices(batches, "words", WORDS):
            words = b.column("words")
            size = np.diff(np.asarray(words.offsets))
            row = np.repeat(np.arange(len(size)), size)
            flat = words.flatten().dictionary_encode()
            code = np.asarray(flat.indices)
            order = np.lexsort((code, row))  # stable: places stay in order
            row, code = row[order], code[order]
            at = order - (np.cumsum(size) - size)[row]
            first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
            positions = pa.ListArray.from_arrays(np.append(first, len(row)).astype(np.int32), pa.array(at.astype(np.int32)))
            whose = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(code[first])), b.column("project_id").take(whose), b.column("id").take(whose), positions], names=["term", "project_id", "id", "positions"])

    cut = chunks.select("project_id", "id", F.coalesce(text.tokens(F.col("content")), F.array().cast("array<string>")).alias("words"))
    return cut.mapInArrow(run, f"term string, project_id {kinds['project_id']}, id {kinds['id']}, positions array<int>")


def match_postings(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, chunk) pairs in which every term of the query occurs."""
    asked = queries.select("query_id", "project_id", text.query_terms(F.col("query")).alias("terms"))
    asked = asked.select("query_id", "project_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    met = index.join(small(asked), ["project_id", "term"])
    return met.groupBy("query_id", "id").agg(F.count("*").alias("hits"), F.first("n").alias("n")).where("hits = n").select("query_id", "id")


def _asked(queries: DataFrame) -> DataFrame:
    """Queries that have any terms: ``query_id, project_id, terms``."""
    return queries.select("query_id", "project_id", text.query_terms(F.col("query")).alias("terms")).where(F.size("terms") > 0)


def _hits(queries: list, words: pa.ListArray, project: pa.Array):
    """(query number, row, places, term numbers) of rows that hold all terms of a query, intersected from the
    term that the fewest rows of this batch hold."""
    number = {t: i for i, t in enumerate(dict.fromkeys(t for q in queries for t in q.terms))}
    size = np.diff(np.asarray(words.offsets))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    flat = words.flatten().dictionary_encode()
    known = np.array([number.get(w, -1) for w in flat.dictionary.to_pylist()] or [-1])
    term = known[flat.indices.to_numpy()] if len(flat) else np.empty(0, np.int64)
    some = term >= 0
    row, at, term = row[some], at[some], term[some]
    rows_of = np.unique(term * len(size) + row) if len(size) else np.empty(0, np.int64)
    edges = np.searchsorted(rows_of, np.arange(len(number) + 1) * len(size))
    held = np.diff(edges)
    asked = np.array([number[t] for q in queries for t in q.terms])
    starts = np.cumsum([0, *(len(q.terms) for q in queries)])
    begins = np.searchsorted(row, np.arange(len(size) + 1))
    of = project.to_pylist()
    for i in np.flatnonzero(np.minimum.reduceat(held[asked], starts[:-1])):
        terms = asked[starts[i] : starts[i + 1]]
        terms = terms[np.argsort(held[terms], kind="stable")]
        found = rows_of[edges[terms[0]] : edges[terms[0] + 1]] % len(size)
        for t in terms[1:]:
            found = found[np.isin(found, rows_of[edges[t] : edges[t + 1]] % len(size), assume_unique=True)]
            if not len(found):
                break
        for r in found.tolist():
            if of[r] == queries[i].project_id:
                own = slice(begins[r], begins[r + 1])
                inside = np.isin(term[own], terms)
                yield i, r, at[own][inside], term[own][inside]


def _scan_hits(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, project_id, id, n, hits`` by one pass over the chunks' words; ``asked`` is of checked size."""
    queries = asked.sparkSession.sparkContext.broadcast(asked.collect())
    kinds = dict(asked.dtypes) | dict(chunks.select("id").dtypes)

    def run(batches):
        for b in slices(batches, "words", WORDS):
            out = list(_hits(queries.value, b.column("words"), b.column("project_id"))) if queries.value and b.num_rows else []
            if out:
                rows = pa.array([r for _, r, _, _ in out])
                places = pa.StructArray.from_arrays([pa.array(np.concatenate([x[2] for x in out]), pa.int32()), pa.array(np.concatenate([x[3] for x in out]), pa.int32())], names=["at", "term"])
                ends = pa.array(np.cumsum([0, *(len(x[2]) for x in out)]), pa.int32())
                ids = pa.array([queries.value[i].query_id for i, _, _, _ in out])
                yield pa.RecordBatch.from_arrays([ids.cast(query_kind), b.column("project_id").take(rows), b.column("id").take(rows), pa.array([len(queries.value[i].terms) for i, _, _, _ in out], pa.int32()), pa.ListArray.from_arrays(ends, places)], names=["query_id", "project_id", "id", "n", "hits"])

    query_kind = to_arrow_type(asked.schema["query_id"].dataType)
    words = chunks.select("project_id", "id", F.coalesce(text.tokens(F.col("content")), F.array().cast("array<string>")).alias("words"))
    return words.mapInArrow(run, f"query_id {kinds['query_id']}, project_id {kinds['project_id']}, id {kinds['id']}, n int, hits array<struct<at:int,term:int>>")


def write_index(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Store the chunks' postings below ``path``, by hash buckets of their terms and in the order of terms within, so
    that a search opens the buckets of its terms and skips blocks by their bounds; and how many chunks hold each term.

    A term that most chunks hold is spread over as many files as its size asks for.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    index = postings(chunks).select("*", bucket).hint("rebalance", F.col("bucket"))
    index.sortWithinPartitions("bucket", "term", "project_id", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = chunks.sparkSession.read.schema(index.schema).parquet(f"{path}/postings")
    stored.groupBy("bucket", "project_id", "term").agg(F.count("*").alias("chunks")).write.partitionBy("bucket").parquet(f"{path}/terms")
    (chunks.sparkSession.range(1).select(F.lit(buckets).alias("buckets"))).write.parquet(f"{path}/about")


def _index_hits(asked: DataFrame, path: str) -> DataFrame:
    """``query_id, project_id, id, n, hits`` from a stored index: candidates are the chunks that hold a query's
    rarest term, and places are fetched for them only."""
    spark = asked.sparkSession
    buckets = spark.read.parquet(f"{path}/about").first().buckets
    index, counts = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
    kinds = dict(asked.dtypes)
    by = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    terms = by(asked.select("query_id", F.col("project_id").cast(kinds["project_id"]).alias("project_id"), F.size("terms").alias("n"), F.posexplode("terms").alias("number", "term")))
    met = counts.join(small(terms), ["bucket", "project_id", "term"])
    rarest = met.groupBy("query_id", "project_id", "n").agg(F.count("*").alias("known"), F.min_by("term", F.struct("chunks", "term")).alias("term")).where("known = n").drop("known")
    rarest = kept(rarest, "rarest")  # each of these is measured and then read again
    found = index.select("bucket", "project_id", "term", "id").join(small(by(rarest)), ["bucket", "project_id", "term"]).select("query_id", "project_id", "id", "n")
    wanted = kept(found.join(terms.drop("project_id", "n"), "query_id"), "candidates")
    places = index.join(small(wanted), ["bucket", "project_id", "term", "id"]).groupBy("query_id", "project_id", "id", "n")
    all_hits = F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("at"), F.col("number").alias("term")))))
    return places.agg(F.count("*").alias("held"), F.array_sort(all_hits).alias("hits")).where("held = n").drop("held")


def topk_lexical(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_RECALL, columns: tuple[str, ...] = (), index: str | None = None) -> DataFrame:
    """The k best chunks that hold all of the query's words, by ts_rank. No words match nothing.

    With ``index``, the path of a stored index of the chunks, only what it has of the queries' terms is read.
    Without one, queries of checked size are looked up in the chunks' words in one pass; for more of
    them an index is stored first.
    """
    asked = _asked(queries)
    if index is None and _size(asked) > BROADCAST_BYTES:
        index = f"{shared_dir(queries.sparkSession)}/index-{uuid4().hex}"
        write_index(chunks, index)
    found = _scan_hits(asked, chunks) if index is None else _index_hits(asked, index)
    best = _top(found.select("query_id", "project_id", "id", text.rank_hits(F.col("hits"), F.col("n")).alias("score")), k)
    best = best.join(chunks.select("project_id", "id", *columns), ["project_id", "id"]) if columns else best
    return best.select("query_id", "id", *columns, "score", "rank")


def rrf(dense: DataFrame, lexical: DataFrame, limit: int, constant: int = 60) -> DataFrame:
    """Two rankings fused by reciprocal rank: ``query_id, id, score, in_dense, in_lexical, rank``."""
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"))
    w = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    met = d.join(w, ["query_id", "id"], "full")
    return _top(met.select("query_id", "id", (part("dense_rank") + part("lexical_rank")).alias("score"), F.col("dense_rank").isNotNull().alias("in_dense"), F.col("lexical_rank").isNotNull().alias("in_lexical")), limit)


def hybrid_search(queries: DataFrame, chunks: DataFrame, limit: int = DEFAULT_RECALL) -> DataFrame:
    """Dense and lexical rankings fused; a query that no words match has its dense ranking."""
    return rrf(topk_dense(queries, chunks, limit), topk_lexical(queries, chunks, limit), limit)


def retrieve_candidates(queries: DataFrame, chunks: DataFrame, recall: int = DEFAULT_RECALL, hybrid: bool = False) -> DataFrame:
    """``query_id, id, score, in_dense, in_lexical, rank`` at ``recall``."""
    if hybrid:
        return hybrid_search(queries, chunks, recall)
    flags = {"in_dense": F.lit(True), "in_lexical": F.lit(False)}
    return topk_dense(queries, chunks, recall).withColumns(flags).select("query_id", "id", "score", "in_dense", "in_lexical", "rank")


def cap_per_doc(results: DataFrame, most: int) -> DataFrame:
    """At most ``most`` chunks of a document, in rank order (0: no cap). A result without doc_id is a document of its own."""
    if most <= 0:
        return results
    root = text.doc_root(F.coalesce("doc_id", F.lit("")))
    place = F.row_number().over(Window.partitionBy("query_id", "__root").orderBy("rank"))
    rows = results.withColumn("__root", root).withColumn("__n", place)
    return rows.where((F.col("__n") <= most) | (F.col("__root") == "")).drop("__root", "__n")


def renumber(results: DataFrame) -> DataFrame:
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def truncate_k(results: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    return renumber(results).where(F.col("rank") <= k)


def compress(results: DataFrame) -> DataFrame:
    """The first of results with one non-empty content hash, then the first with one content.

    In two steps: what the hash drops does not stand in the way of other content."""

    def first_of(rows: DataFrame, key: str, always: Column) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))
        return rows.withColumn("__n", n).where((F.col("__n") == 1) | always).drop("__n")

    kept = first_of(results, "content_hash", F.coalesce("content_hash", F.lit("")) == "")
    return renumber(first_of(kept, "content", F.lit(False)))


def attach_rerank(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Candidates in the order of rerank hits ``query_id, cand_pos, relevance_score`` (0-based
    positions). Positions that no candidate has are dropped."""
    c = candidates.withColumn("cand_pos", F.col("rank") - 1)
    order = Window.partitionBy("query_id").orderBy(F.round("relevance_score", 9).desc(), "cand_pos")
    return c.join(hits, ["query_id", "cand_pos"]).withColumns({"score": F.col("relevance_score"), "rank": F.row_number().over(order)}).drop("relevance_score")


def scorer(fn: Callable[[list[str], list[str]], list[float]]) -> Callable[..., Column]:
    """A reranker from a callable over lists of queries and contents, as a function of their columns.

    Where it raises, or returns the wrong number of scores, the rows' scores are NaN, and
    their queries keep the candidate order.
    """

    @F.pandas_udf("double")
    def run(query: pd.Series, content: pd.Series) -> pd.Series:
        try:
            made = [float(x) for x in fn(query.tolist(), content.tolist())]
        except Exception:  # noqa: BLE001 - a model that fails costs the order, not the job
            made = []
        return pd.Series(made if len(made) == len(query) else [float("nan")] * len(query), dtype="float64")

    return run


def rerank(candidates: DataFrame, score: Column) -> DataFrame:
    """Candidates (with what ``score`` reads) in the order of their new score.

    A query of which no candidate has a score keeps the candidate order and scores:
    ``reranked`` is false. So does one with a NaN among its scores, which stands for a
    scorer that failed. Candidates without a score among others that have one go.
    """
    c = candidates.withColumn("cand_pos", F.col("rank") - 1).withColumn("__s", score.cast("double"))
    of_query = Window.partitionBy("query_id")
    c = c.withColumn("reranked", F.max(F.col("__s").isNotNull()).over(of_query) & ~F.max(F.coalesce(F.isnan("__s"), F.lit(False))).over(of_query))
    c = c.where(~F.col("reranked") | F.col("__s").isNotNull())
    order = Window.partitionBy("query_id").orderBy(F.round("__s", 9).desc(), "cand_pos")
    return c.withColumns({"rank": F.row_number().over(order), "score": F.when(F.col("reranked"), F.col("__s")).otherwise(F.col("score"))}).drop("__s")


def rerank_moved(final: DataFrame) -> DataFrame:
    """How many results of each query stand elsewhere than their candidate did."""
    return final.groupBy("query_id").agg(F.count_if(F.col("cand_pos") != F.col("rank") - 1).alias("rerank_moved"))


def context_string(results: DataFrame) -> DataFrame:
    """Each query's results as one text in rank order."""
    part = F.format_string("[score %.3f] %s", F.col("score"), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("context"))


def context_refs(results: DataFrame) -> DataFrame:
    """References without text: an array of (rank, id, score)."""
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.round("score", 6).alias("score")))).alias("refs"))


def query_composition(candidates: DataFrame, final: DataFrame, hybrid: bool = True) -> DataFrame:
    """Counts over the candidates, and the number of results after all trimming.

    ``hybrid_fallback``: hybrid search was asked for, but the ranking is the dense one alone.
    """
    made = candidates.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if("in_dense").alias("dense_count"), F.count_if("in_lexical").alias("lexical_count"))
    made = made.withColumn("hybrid_fallback", F.lit(hybrid) & (F.col("lexical_count") == 0))
    left = final.groupBy("query_id").agg(F.count("*").alias("results"))
    return made.join(left, "query_id", "left").withColumn("results", F.coalesce("results", F.lit(0)))
