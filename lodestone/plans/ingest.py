"""Documents that are handed in, without a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import chunks, embed, guard, sync


def ingest_documents(docs: DataFrame, stored: DataFrame, e: embed.Embedder, contract: guard.Contract | None = None, batch: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(the collection with ``docs``, what the contract has against them).

    ``docs`` has ``project_id, id, content, meta``. Batches that break the contract are left
    out whole, the others are embedded and replace stored points of their ids; the meta
    gets the model's name and dimension unless the caller has set them.
    """
    broken = None
    if contract is not None:
        broken = guard.violations(docs, contract)
        docs = guard.guard_split(docs, contract, batch).where("accepted")
    made = embed.embed_documents(docs.select("project_id", "id", "content", "meta"), e)
    made = made.withColumn("meta", chunks.inject_embed_meta(chunks.strip_text(F.col("meta")), F.lit(e.model), F.size("embedding")))
    return sync.upsert_points(stored, made.select(*stored.columns)), broken
