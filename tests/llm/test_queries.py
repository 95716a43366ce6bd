"""The registered queries on the smallest tables, and the pipeline's stages."""

import hashlib
import os

import duckdb
import pytest

import corpus_pipeline
from jisfold.llm import queries
from jisfold.llm.common import shared_dir, table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_quality": ["doc_id", "held_out", "score", "predicted"],
    "op5_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7_top_k": ["query_id", "rank", "vec_id", "score"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op11_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op12_resample": ["doc_id", "n_features", "weight", "score", "rank"],
    "op13_align": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if "doc_id" in df.columns:
        ids = [r.doc_id for r in df.select("doc_id").collect()]
        assert sorted(ids) == sorted(r.doc_id for r in table(spark, SF, "documents", "doc_id").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, sql))


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if k < 4:
            assert after.columns == columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if k == 0:
            good = table(spark, SF, "labels").where("quality = 1").join(docs, "doc_id")
            assert good.join(after, "doc_id", "left_anti").count() <= 0.02 * good.count()
        before = after
    assert before.count() > 0 and "n_tokens" in before.columns
    assert os.path.isdir(shared_dir(spark).removeprefix("file://"))


def test_pipeline_stages_of_empty_and_odd_rows(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema)
    for some in (docs.where("false"), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, some, SF).count() <= some.count()


def test_pipeline_decodes_what_it_encodes(spark):
    docs = spark.createDataFrame([(1, "One two  é 日本 😀\n", "en", "s1", 1), (2, "", "en", "s1", 0), (3, "a b c", "en", "s2", 5)], table(spark, SF, "documents").schema)
    rows = corpus_pipeline.encode(spark, docs, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
