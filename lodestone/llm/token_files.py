"""Token ids in bit-packed block files.

A file set is a Parquet table of blocks: ``part, block, start_in_part, n_tokens,
width, doc_ids, offsets, payload``. A block holds whole documents in ascending id
order; ``payload`` has each id in ``width`` bits, the least that the vocabulary
needs, lowest bit first, and ``offsets`` says where each document begins. Token k
of a block starts at bit k * width, so numpy unpacks any range by itself. Parquet
brings atomic commits on every store that Spark can write.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from lodestone.llm.common import in_chunks, new_path, shuffle_partitions
from lodestone.llm.pieces import Encoder


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, lowest bit first."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    bits = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, reading only the bytes that hold them."""
    first = start * width // 8
    raw = np.frombuffer(payload, np.uint8, -(-stop * width // 8) - first, first)
    bits = np.unpackbits(raw, bitorder="little")[start * width - first * 8 :][: (stop - start) * width]
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, :width] = bits.reshape(-1, width)
    return np.packbits(wide.reshape(-1), bitorder="little").view("<u4")


@lru_cache(maxsize=2)
def _encoder(definition: str) -> tuple[Encoder, int]:
    t = Tokenizer.from_str(definition)
    t.encode_special_tokens = True  # a special token's name in a text is ordinary text
    as_ids = lambda texts: [np.array(e.ids, dtype="<u4") for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    spaced = np.zeros(t.get_vocab_size(), bool)
    spaced[[i for token, i in t.get_vocab().items() if token[0] == t.pre_tokenizer.pre_tokenize_str(" ")[0][0]]] = True

    def run(words: list[str]) -> list[bytes]:
        """Many words as one text; only a word's first token begins with a space."""
        out: list[bytes] = []
        for ids in as_ids([" " + " ".join(words[i : i + 32]) for i in range(0, len(words), 32)]):
            raw = ids.tobytes()
            at = (np.flatnonzero(spaced[ids]) * 4).tolist()
            out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
        return out

    return Encoder(lambda texts: [x.tobytes() for x in as_ids(texts)], run), t.get_vocab_size()


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, block_tokens: int = 1 << 16, partitions: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, end each document with ``end_id``, and write the blocks.

    Documents are dealt out by ranges of their id, null ids first; rows that repeat an
    id stay next to each other. Null texts are empty: their only id is the end id.
    Blocks close at ``block_tokens`` ids; a longer document has a block of its own.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    width = bits_for(max(_encoder(definition)[1], end_id + 1))
    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    dealt = picked.repartitionByRange(partitions or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["part", "block", "start_in_part", "n_tokens", "width", "doc_ids", "offsets", "payload"]

    def run(batches):
        encoder, part = _encoder(definition)[0], TaskContext.get().partitionId()
        block = done = n = 0
        keys: list[pa.Array] = []
        held: list[bytes] = []

        def flush():
            nonlocal block, done, n, keys, held
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            offsets = np.cumsum([0, *(len(x) // 4 for x in held)])
            key = pa.concat_arrays(keys)
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([done], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32()), pa.ListArray.from_arrays([0, len(key)], key), pa.array([offsets], pa.list_(pa.int64())), pa.array([pack(ids, width)], pa.binary())]
            block, done, n, keys, held = block + 1, done + len(ids), 0, [], []
            return pa.RecordBatch.from_arrays(row, names=names)

        for b in in_chunks(batches, "text"):
            for i, ids in enumerate(encoder.encode([t or "" for t in b.column("text").to_pylist()])):
                keys.append(b.column("doc_id").slice(i, 1))
                held.append(ids + end)
                n += len(held[-1]) // 4
                if n >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    schema = f"part int, block long, start_in_part long, n_tokens long, width int, doc_ids array<{kind}>, offsets array<long>, payload binary"
    dealt.mapInArrow(run, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a file set: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before. Only one total for each part (as
    many as there were write tasks) is summed up and broadcast.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                get = lambda name: row.column(name)[0].as_py()  # noqa: B023,E731
                at = np.array(get("offsets"))
                ids = unpack(get("payload"), get("width"), 0, get("n_tokens"))
                raw = [ids[x:y] for x, y in zip(at, at[1:])]
                out = [row.column("doc_ids").flatten(), pa.array(get("base") + get("start_in_part") + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in raw], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.join(F.broadcast(before), blocks["part"] == before["p"]).drop("p").mapInArrow(run, schema)


def token_round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, **options)
    return read_token_files(docs.sparkSession, path)
