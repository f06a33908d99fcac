import corpus_pipeline
from tests.llm.helpers import odd_documents
from tests.llm.test_groups import brute_components
from tests.llm.test_rows import base_pii, base_quality, check_mix
from tests.llm.test_tokens import check_pieces
from tracewell.llm.mixing import mix


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id", "text", "source").collect()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns
        ids = sorted(r.doc_id for r in out.collect())
        if k == 0:
            good = {r.doc_id for r in before if not base_quality(r.text)[-1]}
            assert set(ids) <= good and len(ids) > 0.9 * len(good)
        if k == 1:
            assert ids == sorted({c for _, _, c in brute_components(before, 5, 80)})
        if k == 2:
            texts = {r.doc_id: r.text for r in out.collect()}
            assert all(base_pii(texts[r.doc_id])[1] == "" for r in before)
            assert all(texts[r.doc_id] == r.text for r in before if "@" not in r.text and not any(c.isdigit() for c in r.text))
        if k == 3:
            check_mix(before, mix(docs).collect())
            taken = {r.doc_id: r.copies for r in mix(docs).collect()}
            assert all(ids.count(i) == n for i, n in taken.items())
        if k == 4:
            from pyspark.sql import functions as F

            check_pieces(before, out.withColumn("ids_crc32", F.crc32("ids")).collect())
        docs = out


def test_empty_and_odd_documents_pass_every_stage(spark, sf_dir, tmp_path):
    for k, rows in enumerate(([], None)):
        docs = odd_documents(spark, rows)
        for j, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}-{j}")
            docs = docs if j == 0 else spark.read.parquet(f"{tmp_path}/{k}-{j}")


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
