"""Streaming forms of the batch jobs. Each equals its batch form over the same rows.

Jobs take a streaming DataFrame and return a query's result frame or a started query;
``trigger`` and checkpoint folder are the caller's. Back-pressure comes from the source.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestone.operators import metrics
from lodestone.sources import collection

EVENT_SCHEMA = "type string, timestamp timestamp, data string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, files: int = 100) -> DataFrame:
    """JSON events that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def activity_counts(events: DataFrame, kind: str = "type") -> DataFrame:
    """Events by type so far (complete or update mode)."""
    return metrics.activity_by_type(events, kind)


def windowed_activity(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes", kind: str = "type", at: str = "timestamp") -> DataFrame:
    """Events by type and window; a window closes once the watermark has passed it (append mode)."""
    n = events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("events"))
    return n.select(F.col("window.start").alias("start"), kind, "events")


def progress_changes(done: DataFrame, run: str = "run_id", order: str = "batch") -> DataFrame:
    """Rows ``run, batch, pct`` at which a run's whole percent changes (append mode).

    State is one number for each run, the last percent. Rows of a micro-batch are taken
    in the order of ``batch``; a percent that comes back later is a change again.
    """
    pct = F.floor(F.col("done") * 100 / F.greatest(F.col("total"), F.lit(1))).cast("int")
    kinds = dict(done.dtypes)

    def changes(key, frames, state):
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        last = state.get[0] if state.exists else -1
        before = rows["pct"].shift(fill_value=last)
        state.update((int(rows["pct"].iloc[-1]),))
        yield rows.loc[rows["pct"] != before, [run, order, "pct"]]

    rows = done.withColumn("pct", pct).select(run, order, "pct")
    return rows.groupBy(run).applyInPandasWithState(changes, f"{run} {kinds[run]}, {order} {kinds[order]}, pct int", "pct int", "append", "NoTimeout")


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _replace(rows: DataFrame, state: str, batch_id: int) -> None:
    """Write the state after a batch beside the one before; writing a batch again is harmless."""
    rows.write.mode("overwrite").parquet(f"{state}/batch={batch_id:012d}")


def _latest(spark: SparkSession, state: str, before: int) -> DataFrame | None:
    """The newest state older than batch ``before``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = sorted(n for n in names if n.startswith("batch=") and int(n[6:]) < before and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{n}/_SUCCESS")))
    return spark.read.parquet(f"{state}/{done[-1]}") if done else None


def keep_state(stream: DataFrame, merge: Callable[[DataFrame], DataFrame], state: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Fold micro-batches into a table: ``merge`` gets the old state and the batch, united.

    Each batch reads the state before it by its number, so a batch that runs again after
    a failure gives the same table."""

    def each(batch: DataFrame, batch_id: int) -> None:
        old = _latest(batch.sparkSession, state, batch_id)
        _replace(merge(batch if old is None else old.unionByName(batch)), state, batch_id)

    return _start(stream, each, checkpoint, available_now)


def state_of(spark: SparkSession, state: str) -> DataFrame:
    return _latest(spark, state, 1 << 62)


def recent_feed(events: DataFrame, state: str, checkpoint: str, keep: int = 50, order: tuple[str, ...] = ("timestamp", "type", "data")) -> StreamingQuery:
    """The newest events."""
    return keep_state(events, lambda rows: rows.orderBy(*(F.col(c).desc() for c in order)).limit(keep), state, checkpoint)


class _Ring(StatefulProcessor):
    """The newest rows of a key, in the order of two columns, in a list whose size is bounded."""

    def __init__(self, fields: list[str], schema: str, order: list[str], last: int):
        self.fields, self.schema, self.order, self.last = fields, schema, order, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        held = pd.DataFrame(list(self.kept.get()), columns=self.fields)
        new = pd.concat(list(rows))[self.fields]
        both = pd.concat([held.astype(new.dtypes.to_dict()), new] if len(held) else [new])
        both = both.sort_values(self.order, ascending=False, kind="stable").head(self.last)
        self.kept.put(list(both.itertuples(index=False, name=None)))
        yield both

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state is kept by key, in the store that can change single entries; the session's own choice stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def latency_ring(samples: DataFrame, state: str, checkpoint: str, group: list[str], last: int = 512, salts: int = 8) -> StreamingQuery:
    """Each group's newest samples ``ts, id, latency_ms``, read by ``ring_of``.

    A group's samples are dealt to ``salts`` rings by their id, so a hot group is no single task; state
    and a batch's output are bounded by ``last`` x rings that the batch has samples of.
    """
    spark = samples.sparkSession
    kinds = dict(samples.select(*group, "ts", "id", "latency_ms").dtypes)
    keys = [*group, "salt"]
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", salt int"
    rows = samples.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).select(*kinds, "salt")
    rings = rows.groupBy(*keys).transformWithStateInPandas(_Ring([*kinds, "salt"], schema, ["ts", "id"], last), schema, "update", "none")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batch={batch_id:012d}")

    return keyed_state(spark, lambda: rings.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def ring_of(spark: SparkSession, state: str, group: list[str], last: int = 512) -> DataFrame:
    """The newest samples of each group over its rings, each as its last batch left it."""
    rings = spark.read.parquet(state)
    newest = rings.withColumn("__b", F.max("batch").over(metrics.Window.partitionBy(*group, "salt"))).where("batch = __b")
    place = F.row_number().over(metrics.Window.partitionBy(*group).orderBy(F.col("ts").desc(), F.col("id").desc()))
    return newest.withColumn("__n", place).where(F.col("__n") <= last).drop("__n", "__b", "batch", "salt")


def query_log(entries: DataFrame, state: str, checkpoint: str, keep: int) -> StreamingQuery:
    """The query log without synthetic queries, pruned to its newest rows."""
    return keep_state(metrics.logged(entries), lambda rows: metrics.prune_log(rows, keep), state, checkpoint)


_FILE = ["project_id", "source_dir", "source_file"]
#: Groups that files are dealt to; a group's files of a micro-batch are one call, and its state is by file.
GROUPS = 256


class _Known(StatefulProcessor):
    """What the chunks of a group's files hashed to when they were last seen: only chunks that differ go on."""

    def __init__(self, columns: list[str], prune: bool):
        self.columns, self.prune = columns, prune

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", ", ".join(f"{c} string" for c in _FILE), "ids array<string>, hashes array<string>")

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows), ignore_index=True)
        gone, ids, hashes = rows["gone"].astype(bool).tolist(), rows["id"].tolist(), rows["content_hash"].tolist()
        files: dict = {}
        for n, file in enumerate(zip(*(rows[c].tolist() for c in _FILE))):
            files.setdefault(file, []).append(n)
        fresh, lost = [], []
        for file, at in files.items():
            had = self.known.getValue(file)
            known = {} if had is None else dict(zip(*had))
            chunks = [n for n in at if not gone[n]]
            new = [n for n in chunks if known.get(ids[n]) != hashes[n] or not hashes[n]]
            now = {ids[n] for n in chunks}
            # a file that is gone takes all of its chunks along; one that has become shorter does if it is asked for
            left = [i for i in known if i not in now] if self.prune or not chunks else []
            after = {i: h for i, h in known.items() if i not in set(left)} | {ids[n]: hashes[n] for n in new}
            if after and (new or left):
                self.known.updateValue(file, (list(after), list(after.values())))
            elif left:
                self.known.removeKey(file)
            fresh += new
            lost += [(*file, i) for i in left]
        yield rows.loc[sorted(fresh), self.columns]
        if lost:
            out = pd.DataFrame({c: [None] * len(lost) for c in self.columns})
            out[[*_FILE, "id"]], out["gone"] = lost, True
            yield out.astype({c: t for c, t in rows[self.columns].dtypes.items() if t == object})

    def close(self) -> None:
        pass


def changed_chunks(changes: DataFrame, chunk: Callable[[DataFrame], DataFrame], prune_orphan_chunks: bool = False) -> DataFrame:
    """Chunks that are new or changed, and with ``gone`` true the ids of those that went, of a stream of files.

    ``chunk`` makes points of files; rows of ``changes`` with ``deleted`` true are files that are gone. State is one
    hash for each chunk, by file, and a micro-batch reads and writes only that of its own files, each at once.
    """
    made = chunk(changes.where(~F.col("deleted"))).withColumn("gone", F.lit(False))
    gone = changes.where("deleted").select(*_FILE, F.lit(True).alias("gone"))
    rows = made.unionByName(gone, allowMissingColumns=True)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    grouped = rows.withColumn("__group", F.pmod(F.xxhash64(*_FILE), F.lit(GROUPS)).cast("int")).groupBy("__group")
    return grouped.transformWithStateInPandas(_Known(rows.columns, prune_orphan_chunks), schema, "append", "none")


def sync_stream(changes: DataFrame, base: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], prune_orphan_chunks: bool = False, rows: int = collection.ROWS) -> StreamingQuery:
    """Changed files into the collection in ``base``: each batch rewrites the buckets of the chunks that it changes.

    A batch that runs again after a failure finds its change made and leaves it. The collection has to have no other
    writer, or a batch whose version another one has taken fails and is run again.
    """
    name = f"{checkpoint}#"

    def each(batch: DataFrame, batch_id: int) -> None:
        fresh, gone = batch.where(~F.col("gone")).drop("gone"), batch.where("gone").select("project_id", "id")
        collection.upsert_chunks(fresh, base, gone=gone, rows=rows, token=f"{name}{batch_id}")

    stream = changed_chunks(changes, chunk, prune_orphan_chunks)
    return keyed_state(changes.sparkSession, lambda: stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
