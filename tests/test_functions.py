import time
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, text, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("name", ".env .env.local .env.production prod.env .npmrc .pypirc .netrc .htpasswd .pgpass credentials id_rsa id_ed25519 my-secret.json db_password.yaml aws-credentials.txt server.key cert.pem bundle.pfx store.jks sig.asc .ENV ID_RSA My-Secret.JSON passwordless-auth.md".split())
def test_sensitive(spark, name):
    assert one(spark, paths.is_sensitive(F.col("n")), n=name)


def test_harmless_and_indexable(spark):
    names = "main.go README.md config.json docker-compose.yml environment.ts keyboard.go Makefile index.html".split()
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert rows.where(paths.is_sensitive(F.col("n"))).count() == 0
    assert rows.where(paths.is_indexable(F.col("n"))).count() == len(names)
    assert spark.createDataFrame([("a.bin",), ("noext",), ("go",)], "n string").where(paths.is_indexable(F.col("n"))).count() == 0


def test_pruned_below_the_root_only(spark):
    rows = spark.createDataFrame([("/x/build", "/x/build/a.go"), ("/x/build/", "/x/build/dist/a.go"), ("/x", "/x/build")], "root string, path string")
    assert [r[0] for r in rows.select(paths.is_pruned(paths.rel_path(F.col("root"), F.col("path")))).collect()] == [False, True, False]


def test_hash_and_ids(spark):
    assert one(spark, text.content_hash(F.col("c")), c="hello") == "2cf24dba5fb0a30e"
    for key in ("memory/a#1", "日本語/é"):
        assert one(spark, text.point_uuid(F.col("k")), k=key) == str(uuid.uuid5(uuid.NAMESPACE_URL, key))
    own = str(uuid.uuid4())
    assert one(spark, text.point_uuid(F.col("k")), k=own) == own
    assert one(spark, text.fallback_id(F.col("k"), F.col("c")), k="", c="x") == str(uuid.uuid5(uuid.NAMESPACE_URL, "x"))


def packed(s, size):
    """Chunks from the words of the contract: pack lines, cut long ones."""
    if len(s) <= size:
        return [s]
    out, cur = [], ""
    for line in s.split("\n"):
        while len(line) > size:
            out, cur = out + ([cur] if cur else []), ""
            out.append(line[:size])
            line = line[size:]
        if cur and len(cur) + len(line) + 1 > size:
            out, cur = [*out, cur], ""
        cur += line + "\n"
    return out + ([cur] if cur else [])


@pytest.mark.parametrize("s", ["", "short", "a\nb\nc\nd\ne", "0123456789", "01234567890", "x" * 35, "ab\n" + "y" * 21 + "\ncd\n\n\n", "é" * 12 + "\n" + "z" * 10, "\n" * 30, "0123456789\n0123456789"])
def test_chunks(spark, s):
    assert one(spark, text.chunk_text(F.col("t"), 10), t=s) == packed(s, 10)


def test_chunks_of_no_text_and_of_no_size(spark):
    assert one(spark, text.chunk_text(F.coalesce(F.lit(None), F.when(F.col("t") == "", "x")), 10), t="a") is None
    for size in (0, -3):
        assert one(spark, text.chunk_text(F.col("t"), size), t="y" * 1500) == packed("y" * 1500, 1000)


def test_chunks_of_a_large_text_take_time_in_proportion():
    t = "\n".join("wörd " * (i % 40) for i in range(50_000))
    began = time.time()
    made = text._chunks(t, 300)
    assert time.time() - began < 1 and len(t) > 4_800_000
    assert "".join(made) == t + "\n" and made == packed(t, 300)


def test_doc_root(spark):
    for key, root in (("memory/x/doc-one#3", "memory/x/doc-one"), ("plain", "plain"), ("#1", "#1"), ("a#b#2", "a#b"), ("a\n#1", "a\n")):
        assert one(spark, text.doc_root(F.col("k")), k=key) == root


def test_projects(spark):
    assert one(spark, text.sanitize_project(F.col("p")), p="a/b c_D-9é") == "abc_D-9"
    assert len(one(spark, text.sanitize_project(F.col("p")), p="///")) == 16
    assert one(spark, text.project_of_collection(F.col("p")), p="project_demo") == "demo"
    assert one(spark, text.project_of_collection(F.col("p")), p="other_thing") is None


def test_words_and_rank(spark):
    assert one(spark, text.tokens(F.col("t")), t="Hello, wörld! x2 — Été") == ["hello", "wörld", "x2", "été"]
    rank = lambda q, t: one(spark, text.ts_rank(text.query_terms(F.col("q")), text.tokens(F.col("t"))), q=q, t=t)
    assert rank("a", "a b") == pytest.approx(0.0607927, abs=1e-6)
    assert rank("a b", "a b") == pytest.approx(0.0991032, abs=1e-4)
    assert rank("a b", "a x x x x b") < rank("a b", "a b")
    assert one(spark, text.lexical_match(text.query_terms(F.col("q")), text.tokens(F.col("t"))), q="", t="a") is False


def test_highlight_quotes_terms(spark):
    terms = F.array(F.lit("a.b"), F.lit("x"), F.lit("der"))
    assert one(spark, text.highlight(F.col("t"), terms), t="Der a.b axb x") == "<mark>Der</mark> <mark>a.b</mark> axb x"


def test_distances(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = row.select(vectors.cosine(F.col("a"), F.col("b")), vectors.l2(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z"))).first()
    assert tuple(r) == (pytest.approx(0.96), 2.0, None)
