"""The pipeline's stages: each returns documents, and its decisions take effect."""

from collections import Counter

import pytest

import corpus_pipeline
from logstrata.llm import mixing, packing, repetition
from logstrata.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_run_in_order_on_what_the_last_one_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.dtypes, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i < 4:
            assert docs.dtypes == columns
        if i == 0:
            kept = {r["doc_id"] for r in repetition.quality_rules(before).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept
        if i == 1:
            assert docs.select("doc_id").distinct().count() == counts[-1] <= counts[-2]
        if i == 2:
            assert counts[-1] == counts[-2]
            assert not docs.where(r"text rlike '[A-Za-z0-9]@[a-z0-9]+[.]example[.]com'").count()
            assert not docs.where("n_chars <> char_length(text)").count()
        if i == 3:
            assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    tk = packing.WordTokenizer(tokenizer_path())
    tokens = sum(len(tk(r["text"])) // 4 + 1 for r in before.collect())
    rows = docs.collect()
    assert sum(r["length"] for r in rows) == tokens
    assert max(r["offset"] + r["length"] for r in rows) <= 2048


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_rows_with_repeated_or_no_ids_lose_copies_only(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [
        (1, words("a")), (1, words("b")), (1, words("b")), (2, words("b") + " more"), (3, words("c")),
        (None, words("c")), (None, words("d")), (None, words("d")), (None, words("e")), (4, None), (5, ""),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, df.repartition(5), SF).collect()]
    stay = [(1, words("a")), (1, words("b")), (3, words("c")), (None, words("d")), (None, words("e")), (4, None)]
    assert sorted(map(str, found)) == sorted(map(str, stay))


def test_mixed_documents_lie_in_shards_and_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix_documents(docs)
    ids = [r["doc_id"] for r in corpus_pipeline.mix(spark, docs, SF).collect()]
    assert ids == [r["doc_id"] for r in mixing.draw(plan).collect()]
    drawn = [(i, s) for i, shards in plan.select("doc_id", "shards").collect() for s in shards]
    assert Counter(ids) == Counter(i for i, _ in drawn)
    at = 0
    for s in range(16):
        here = [i for i, x in drawn if x == s]
        assert Counter(ids[at : at + len(here)]) == Counter(here)
        assert len(here) < 5 or ids[at : at + len(here)] != sorted(here)
        at += len(here)


def test_stages_are_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "PII", "mixing sources to target weights", "best-fit packing",
    ]
    with pytest.raises(ValueError):
        packing.plan_bins({0: 1}, 10)
