import random

import corpus_pipeline
from lodestone.llm import simhash
from tests.llm.cases import words
from tests.llm.test_shards_lists_benchmark import brute as brute_contamination
from tests.llm.test_similar import brute_least
from tests.llm.test_substrings import brute as brute_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def folder(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(words(r.randint(30, 120), 700 + i, size=2000)) for i in range(500)]
    texts[3] = texts[4] = texts[5]
    texts[7] = " ".join(words(150, 1) + words(40, 2))
    texts[8] = " ".join(words(90, 3) + words(40, 2))
    passage = words(40, 4, size=2000)
    texts[10] = " ".join([*texts[10].split()[:20], *passage])
    texts[11] = None
    texts[12] = texts[13] = ""
    for i in range(20, 180):
        texts[i] += " scoundrel"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(20 <= i < 180)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_every_stage_against_brute_force(spark, tmp_path):
    d = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    items = [(1, spark.read.parquet(f"{d}/benchmark.parquet").first().text)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        path = f"{d}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(after)
        ids = sorted(before)
        if name == "toxicity":
            gone = before.keys() - after.keys()
            assert gone <= {i for i in before if 20 <= i < 180} and len(gone) > 150
        if name == "simhash":
            assert sorted(after) == [i for i, least in brute_least([(i, before[i]) for i in ids]) if i == least]
            assert 3 in after and 4 not in after and 5 not in after
        if name == "substrings":
            for i, (_, gone, _, kept) in zip(ids, brute_repeats([before[i] for i in ids], 35)):
                assert after[i] == (b" ".join(kept).decode() if gone else before[i])
            assert after[7] != before[7] and after[8] != before[8]
            assert all(r.n_chars == len(r.text or "") for r in rows)
        if name == "decontamination":
            assert set(after) == {i for i in ids if not brute_contamination(before[i], items)[-1]} and 10 not in after
        if name != "bpe":
            assert docs.columns == COLUMNS
        else:
            assert after == before and all(r.restored and r.n_tokens == len(r.ids) for r in rows)
        before = after
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == sorted(after)


def test_no_documents(spark, tmp_path):
    d = folder(spark, tmp_path)
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).collect() == [], name


def test_rows_without_an_id_stay(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, "a b c d"), (1, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.representatives(docs).collect()) == ["1", "1", "None", "None"]
