"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its hashed terms (words and word beginnings). The score is
the logistic of a bias, a weight for each term and, for each pair of terms, the
inner product of their factors, so that two terms can say together what neither
says alone. The machine is fitted on at most ``sample`` labelled rows, whatever the
table's size; every row is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import in_chunks, text_bytes
from lodestone.llm.decontaminate import words

#: Lengths in bytes of the word beginnings that are terms too.
BEGINNINGS = (4, 5, 6, 7)


def _hashes(word: bytes) -> list[int]:
    h = xxhash.xxh32_intdigest
    return [h(word, 1), *(h(word[:k], 2) for k in BEGINNINGS if len(word) > k)]


@dataclass
class Machine:
    """``terms`` are the sorted hashes that have weights; all others weigh nothing."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows whose terms are (rows, cols), rows ascending."""
        out = np.full(n, self.bias)
        out += np.bincount(rows, self.weight[cols], n)
        for f in self.factor.T:
            out += 0.5 * (np.bincount(rows, f[cols], n) ** 2 - np.bincount(rows, f[cols] ** 2, n))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Between 0 and 1 for each text."""
        sets = [set(words(t)) for t in texts]
        every = list(set().union(*sets))
        made = [_hashes(w) for w in every]
        flat = np.array([h for m in made for h in m], dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.terms, flat), max(0, len(self.terms) - 1))
        ok = self.terms[at] == flat if len(self.terms) else np.zeros(len(flat), bool)
        ends = np.cumsum([0, *map(len, made)]).tolist()
        kept = {w: at[a:z][ok[a:z]].tolist() for w, a, z in zip(every, ends, ends[1:]) if ok[a:z].any()}
        known = kept.keys()
        cols = [sorted(set().union(*map(kept.__getitem__, s & known))) for s in sets]
        rows = np.repeat(np.arange(len(texts)), list(map(len, cols)))
        logits = self.logits(rows, np.array([c for x in cols for c in x], dtype=np.int64), len(texts))
        return 1 / (1 + np.exp(-np.clip(logits, -35, 35)))


def fit_machine(sets: list[np.ndarray], labels: np.ndarray, factors: int = 4, least: int = 4, epochs: int = 20, batch: int = 256, rate: float = 0.1, sparse: float = 2e-3, together: float = 1e-2, seed: int = 0) -> Machine:
    """Logistic loss by proximal Adagrad in small batches, first the weights, then weights and factors.

    Terms of fewer than ``least`` rows are left out. ``sparse`` draws weights, and
    ``together`` a term's factors as one, to exactly zero unless the data hold them up;
    a long text's many neutral terms then add nothing. Terms whose weight is zero after
    the first part go; then, of all terms, those come back that stand in a pair which the
    machine leaves unexplained (``_paired``), and a third part fits them with the others, so
    two terms that tell nothing by themselves are still learned as a pair. The factors of
    such terms are not drawn to zero: the data hold them up.
    """
    y = np.asarray(labels, dtype=float)
    bias = float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)))
    terms, count = np.unique(np.concatenate([np.empty(0, np.uint32), *sets]), return_counts=True)
    terms = terms[count >= least]
    found = [_places(terms, x) for x in sets]
    rows = np.repeat(np.arange(len(sets)), list(map(len, found)))
    cols = np.concatenate([np.empty(0, np.int32), *found])
    model = Machine(terms, bias, np.zeros(len(terms)), np.zeros((len(terms), 0)))
    if not 0 < y.sum() < len(y):
        return model
    rng = np.random.default_rng(seed)
    of = rows, cols
    for part in (0, factors):
        model.factor = rng.normal(0, 0.1, (len(model.terms), part))
        _descend(model, *of, y, rng, epochs, batch, rate, sparse, np.full(len(model.terms), together))
        of = _restrict(model, (model.weight != 0) | (model.factor != 0).any(1), *of)
    paired = _paired(y - 1 / (1 + np.exp(-np.clip(model.logits(*of, len(y)), -35, 35))), rows, cols, len(terms), sparse)
    if factors and paired.any():
        at = _places(terms, model.terms)
        weight, factor = np.zeros(len(terms)), np.where(paired[:, None], rng.normal(0, 0.1, (len(terms), factors)), 0)
        weight[at] = model.weight
        factor[at] = np.where((model.factor != 0).any(1, keepdims=True), model.factor, factor[at])
        kept = paired.copy()
        kept[at] = True
        model.terms, model.weight, model.factor = terms, weight, factor
        of = _restrict(model, kept, rows, cols)
        _descend(model, *of, y, rng, epochs, batch, rate, sparse, np.where(paired[kept], 0, together))
        _restrict(model, (model.weight != 0) | (model.factor != 0).any(1), *of)
    return model


def _paired(error: np.ndarray, rows: np.ndarray, cols: np.ndarray, m: int, sparse: float, block: int = 512) -> np.ndarray:
    """Which of m terms stand in a pair whose rows have errors of one sign, above ``sparse`` and above chance.

    The errors where both terms stand, less what either term's own mean error makes of those rows,
    are held against ``sparse`` as a mean over all rows, as a weight's gradient is, and as a sum
    against the largest that so many pairs reach by chance.
    A pair's errors of one sign are at most a term's, so terms below that alone are left out first.
    """
    n = len(error)
    least = sparse * n
    some = np.flatnonzero(np.maximum(np.bincount(cols, np.maximum(error, 0)[rows], m), np.bincount(cols, np.maximum(-error, 0)[rows], m)) >= least)
    out = np.zeros(m, bool)
    chance = 2 * np.log(max(2, len(some) * (len(some) - 1) / 2))
    mask = np.isin(cols, some)
    r, c = rows[mask], np.searchsorted(some, cols[mask])
    mean = (np.bincount(c, error[r], len(some)) / np.maximum(np.bincount(c, minlength=len(some)), 1)).astype(np.float32)
    starts = np.searchsorted(r, np.arange(0, n + 2048, 2048))
    for i in range(0, len(some), block):
        total, spread, both = (np.zeros((min(block, len(some) - i), len(some)), np.float32) for _ in range(3))
        for k, (a, z) in enumerate(zip(starts, starts[1:])):
            x = np.zeros((min(2048, n - 2048 * k), len(some)), np.float32)
            x[r[a:z] - 2048 * k, c[a:z]] = 1
            e = error[2048 * k : 2048 * k + len(x), None].astype(np.float32)
            own = x[:, i : i + block]
            total += (own * e).T @ x
            spread += (own * (np.abs(e) * (1 - np.abs(e)))).T @ x
            both += own.T @ x
        a, b = total - both * mean[i : i + block, None], total - both * mean
        excess = np.where((a * b > 0) & (a * total > 0), np.minimum(np.minimum(np.abs(a), np.abs(b)), np.abs(total)), 0)
        good = (excess >= least) & (excess**2 > chance * np.maximum(spread, 1))
        good[np.arange(len(good)), i + np.arange(len(good))] = False
        out[some[i : i + block][good.any(1)]] = True
    return out


def _places(terms: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where those of ``some`` stand that are among the sorted ``terms``."""
    if not len(terms):
        return np.empty(0, np.int32)
    at = np.minimum(np.searchsorted(terms, some), len(terms) - 1)
    return at[terms[at] == some].astype(np.int32)


def _restrict(model: Machine, kept: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leave out terms, and the places where they stand."""
    mask = kept[cols]
    model.terms, model.weight, model.factor = model.terms[kept], model.weight[kept], model.factor[kept]
    return rows[mask], (np.cumsum(kept) - 1)[cols[mask]]


def _descend(model: Machine, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, rng, epochs: int, batch: int, rate: float, sparse: float, together: np.ndarray) -> None:
    m, factors = model.factor.shape
    sum_w, sum_f = np.full(m, 1e-6), np.full(m, 1e-6)
    starts = np.searchsorted(rows, np.arange(len(y) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            some = np.sort(order[i : i + batch])
            size = starts[some + 1] - starts[some]
            r = np.repeat(np.arange(len(some)), size)
            at = np.arange(len(r)) + np.repeat(starts[some] - (np.cumsum(size) - size), size)
            used, c = np.unique(cols[at], return_inverse=True)
            part = Machine(used, model.bias, model.weight[used], model.factor[used])
            error = 1 / (1 + np.exp(-np.clip(part.logits(r, c, len(some)), -35, 35))) - y[some]
            model.bias -= rate * 0.1 * float(error.mean())
            n = len(used)
            g = np.bincount(c, error[r], n) / len(some)
            sum_w[used] += g**2
            step = rate / np.sqrt(sum_w[used])
            w = part.weight - step * g
            model.weight[used] = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
            if factors:
                total = [np.bincount(r, f[c], len(some)) for f in part.factor.T]
                gf = np.array([np.bincount(c, (error * t)[r], n) / len(some) for t in total]).T - g[:, None] * part.factor
                sum_f[used] += (gf**2).sum(1)
                step = rate / np.sqrt(sum_f[used])[:, None]
                f = part.factor - step * gf
                length = np.sqrt((f**2).sum(1, keepdims=True))
                model.factor[used] = f * np.maximum(0, 1 - step * together[used, None] / np.maximum(length, 1e-12))


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text is a multiple of ``folds``; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, folds: int = 5, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Fit on the labelled documents outside the held-out fold, at most about ``sample`` of them.

    The sample is chosen by a hash of the id, so it is the same on every run; it is
    counted first and bounds what is broadcast, and what the driver gets: hashed terms, no texts.
    An id labelled twice has the larger label, and one that stands in several rows teaches once, by the first of
    their sets of terms, so that the bound on ids is one on rows; null ids and labels teach nothing.
    """
    key = F.col(doc_id)
    taught = labels.where(key.isNotNull() & F.col(label).isNotNull() & ~held_out(key, folds)).groupBy(key.alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    n = taught.count()
    if n > sample:
        share = int(sample / n * 2**32)
        taught = taught.where(F.pmod(F.xxhash64("__id"), F.lit(2**32)) < share)
    rows = docs.select(key.alias("__id"), F.col(text).alias("text")).join(F.broadcast(taught), "__id").select("__id", "text", "__label")
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches):
        for b in in_chunks(batches, "text"):
            sets = [np.unique(np.array([h for w in set(words(t)) for h in _hashes(w)], dtype=np.uint32)) for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array([s.tobytes() for s in sets], pa.binary()), b.column("__label")], names=["__id", "terms", "label"])

    got = rows.mapInArrow(run, f"__id {kind}, terms binary, label int").groupBy("__id").agg(F.min("terms").alias("terms"), F.first("label").alias("label")).toArrow()
    pairs = sorted(zip(got.column("terms").to_pylist(), got.column("label").to_pylist()))  # the order of arrival must not matter
    return fit_machine([np.frombuffer(t, np.uint32) for t, _ in pairs], np.array([int(y > 0) for _, y in pairs]))


def scores(docs: DataFrame, machine: Machine, folds: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null texts count as empty.

    An empty text has the bias as its score. Equal texts have equal scores. Only the
    text is an input of the score.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), folds).alias("held_out"), F.col(text).alias("text"))

    def run(batches):
        for b in in_chunks(batches, "text"):
            s = machine.score(text_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""

    def run(batches):
        for b in in_chunks(batches, text):
            yield b.filter(pc.less(pa.array(machine.score(text_bytes(b.column(text)))), threshold))

    return docs.mapInArrow(run, docs.schema)
