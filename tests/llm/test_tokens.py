import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import bpe, token_files
from tests.llm.cases import documents, texts

RANKS, BPE_JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


def noise(n):
    r = random.Random(3)
    return ["".join(r.choices(" \n\t'aébs1ß。\xa0!lredmvt\x1c", k=r.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    assert sorted(bpe.MinimalPerfectHash(keys)(keys)) == list(range(len(keys)))


def test_encoding_equals_the_library(reference):
    v = bpe.vocabulary(open(RANKS, "rb").read(), P.PATTERN)
    many = [*(t or "" for t in texts()), *noise(3000), "b" * 9000]
    for t, ids in zip(many, v.encode(many)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), repr(t)
        assert v.decode(ids) == t.encode()


def test_forgetting_pieces_changes_nothing(reference):
    v = bpe.Vocabulary(open(RANKS, "rb").read(), P.PATTERN)
    v.encoder.limit = 10
    many = noise(500)
    for i in range(0, 500, 50):
        assert [np.frombuffer(x, "<u4").tolist() for x in v.encode(many[i : i + 50])] == list(map(reference.encode_ordinary, many[i : i + 50]))


def test_round_trip_of_documents(spark, reference):
    docs = documents(spark)
    got = sorted(bpe.round_trip(docs, RANKS, P.PATTERN).collect(), key=str)
    want = []
    for d in docs.collect():
        ids = np.array(reference.encode_ordinary(d.text or ""), dtype="<u4").tobytes()
        want.append((d.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).collect() == []


def test_encode_keeps_columns_and_decodes(spark, reference):
    docs = documents(spark)
    out = bpe.decode_documents(bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    for r in out.collect():
        assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1003).astype("<u4")
    packed = token_files.pack(ids, width)
    assert len(packed) == -(-1003 * width // 8)
    assert (token_files.unpack(packed, width, 0, 1003) == ids).all()
    assert (token_files.unpack(packed, width, 501, 777) == ids[501:777]).all()
    with pytest.raises(ValueError):
        token_files.pack(np.array([2**width]), width)


def test_token_files(spark):
    t = Tokenizer.from_file(BPE_JSON)
    t.encode_special_tokens = True
    extra = [(100 + i, x) for i, x in enumerate(["<|endoftext|> x", *noise(200)])]
    docs = documents(spark, [*reversed(list(enumerate(texts()))), *extra])
    got = token_files.token_round_trip(docs, BPE_JSON, block_tokens=500, partitions=3).orderBy("doc_id").collect()
    start = 0
    for d, g in zip(docs.orderBy("doc_id").collect(), got, strict=True):
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert tuple(g) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_round_trip(docs.limit(0), BPE_JSON).collect() == []
    nulls = token_files.token_round_trip(documents(spark), BPE_JSON).collect()
    assert sum(r.doc_id is None for r in nulls) == 1 and sum(r.doc_id == 3 for r in nulls) == 2


def test_clashing_names_are_set_aside(spark):
    docs = documents(spark, [(1, "one two"), (2, None)]).selectExpr("*", "'i' AS Ids", "'j' AS ids_", "5 AS n_tokens", "false AS restored")
    got = bpe.with_tokens(docs, RANKS, P.PATTERN)
    assert got.columns == [*documents(spark, []).columns, "Ids__", "ids_", "n_tokens_", "restored_", "ids", "n_tokens", "restored"]
    rows = got.orderBy("doc_id").collect()
    assert [(r["Ids__"], r.ids_, r.n_tokens_, r.restored_, r.restored) for r in rows] == [("i", "j", 5, False, True)] * 2
    twice = bpe.decode_documents(bpe.encode_documents(docs.drop("ids_").withColumnRenamed("n_tokens", "decoded"), RANKS, P.PATTERN), RANKS)
    assert [bytes(r.decoded) for r in twice.orderBy("doc_id").collect()] == [b"one two", b""]
