"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A row descends region, rack and shard. At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's place, and the
smallest draw wins. A child's draw depends on its own place and weight alone, so
changing weights moves rows only between subtrees whose weights change: a new
subtree takes rows into itself and moves none between the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: region -> rack -> [(shard id, weight)]
Tree = list[list[list[tuple[int, float]]]]


def even_tree(shards: int, racks: int = 5, per_rack: int = 2) -> Tree:
    """Shards 0..n-1 of weight 1, ``per_rack`` to a rack and ``racks`` to a region."""
    of_rack = [[(s, 1.0) for s in range(i, min(i + per_rack, shards))] for i in range(0, shards, per_rack)]
    return [of_rack[i : i + racks] for i in range(0, len(of_rack), racks)]


def grown_tree(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own: no other subtree's weight changes."""
    last = max(s for region in tree for rack in region for s, _ in rack)
    return [*tree, [[(last + 1, weight)]]]


def _total(x) -> float:
    return sum(map(_total, x)) if isinstance(x, list) else float(x[1])


def _draw(weights: Column, *seed: Column) -> Column:
    """Index of the child with the smallest draw; ties go to the lower one, weight 0 never wins."""

    def one(w: Column, i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(*seed, i), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct(F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf"))).alias("draw"), i.alias("place"))

    return F.array_min(F.transform(weights, one))["place"]


def assign(rows: DataFrame, key: str, tree: Tree, to: str) -> DataFrame:
    """``rows`` with the shard of column ``key`` as ``to``. A null key is a key like any other."""
    values = lambda x: F.array(*map(values, x)) if isinstance(x, list) else F.lit(x)
    regions = values([_total(region) for region in tree])
    racks = values([[_total(rack) for rack in region] for region in tree])
    weights = values([[[float(w) for _, w in rack] for rack in region] for region in tree])
    ids = values([[[s for s, _ in rack] for rack in region] for region in tree])
    k = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    r, q, s = (f"__{to}_{x}" for x in ("region", "rack", "place"))
    rows = rows.withColumn(r, _draw(regions, k))
    rows = rows.withColumn(q, _draw(racks[F.col(r)], k, F.col(r)))
    rows = rows.withColumn(s, _draw(weights[F.col(r)][F.col(q)], k, F.col(r), F.col(q)))
    return rows.withColumn(to, ids[F.col(r)][F.col(q)][F.col(s)]).drop(r, q, s)


def slots(rows: DataFrame, shard: str, order: list[str], cells: int = 256) -> DataFrame:
    """Number the rows of each shard 0, 1, ... without gaps, as ``slot``.

    Each shard is cut into ``cells`` hash cells; cells are numbered inside and
    shifted by the sizes of the cells before, so no task holds a whole shard. The
    table of cell sizes has at most shards x cells rows, which bounds its broadcast.
    """
    cell = F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int")
    rows = rows.withColumn("__cell", cell)
    sizes = rows.groupBy(shard, "__cell").count()
    before = sizes.withColumn("__base", F.sum("count").over(Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col(shard).alias("__s"), F.col("__cell").alias("__c"), F.coalesce("__base", F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(shard, "__cell").orderBy(*order)) - 1
    out = rows.withColumn("__inside", inside).join(F.broadcast(before), (F.col(shard) == F.col("__s")) & (F.col("__cell") == F.col("__c")))
    return out.withColumn("slot", (F.col("__base") + F.col("__inside")).cast("long")).drop("__cell", "__base", "__inside", "__s", "__c")


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", tree: Tree | None = None) -> DataFrame:
    """Shard, slot and grown shard of every document under the law ``key``.

    The id and the tree decide; ``grown_shard`` is the shard after one more is added,
    either the same or the new one. Size is the text's UTF-8 bytes plus 16; a null
    text counts as empty (size 16, crc 0). Null ids share one key. Rows that repeat
    an id share a shard and have slots of their own. Only id, size and checksum are
    shuffled, never a text. Other columns of ``docs`` are not returned.
    """
    tree = tree or even_tree(shards)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign(assign(rows, "doc_id", tree, "shard"), "doc_id", grown_tree(tree), "grown_shard")
    return slots(rows, "shard", ["doc_id", "size", "text_crc32"])
