"""The corpus pipeline, stage by stage, on the smallest tables."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    text = lambda k: " ".join(f"w{(k * 7919 + i * i * 31) % 997}" for i in range(120))
    rows = [(i, text(i), "en", "src0", 0) for i in range(40)]
    rows += [(100, text(1), "en", "src0", 0), (101, text(2) + " tail", "en", "src0", 0), (102, "key password=abcdef123456 " + text(50), "en", "src1", 0), (103, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == names
        ids = {x.doc_id for x in docs.collect()}
        if name == "toxicity":
            assert len(ids) == 44
        if name == "exact_dedup":
            assert 1 not in ids and 100 in ids and len(ids) == 43
        if name == "near_dedup":
            assert 101 not in ids and 2 in ids and 103 in ids and len(ids) == 42
    secret = docs.where("doc_id = 102").first()
    assert "abcdef123456" not in secret.text and secret.n_chars == len(secret.text)


def test_run_packs_what_is_kept(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert len({x.doc_id for x in got}) == 42
    sums = collections.Counter()
    for x in got:
        sums[x.sequence_id] += x.length
    assert max(sums.values()) <= 2048


def test_one_row_of_each_text_stays(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "b"), (None, "a"), (None, "n"), (None, "n"), (4, None), (5, "")]
    docs = spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.without_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter([(1, "a", "en"), (2, "c", "en"), (3, "b", "en"), (None, "n", "en"), (5, "", "en")])


@pytest.mark.parametrize("rows", [[], [(None, None)] * 3, [(1, "a b c d e f")] * 4 + [(None, "a b c d e f"), (2, "")]])
def test_odd_tables_go_through(spark, tmp_path, rows):
    kinds = "doc_id long, text string, score double, row int, n_shingles string"
    docs = spark.createDataFrame([(*x, 0.5, 1, "s") for x in rows], kinds)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(x.doc_id for x in got) == collections.Counter({i for i, t in rows} if len(rows) < 6 else [1, 2])
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
