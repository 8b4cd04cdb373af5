"""The stages one after the other on awkward documents, each against its operator's own result."""

import corpus_pipeline
from evipack.llm import exact_dedup, quality, simhash
from tests.llm import cases


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame(cases.documents(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25)] + [(312, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_rules(rows, labels).collect() if r.kept}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality rules"](spark, rows, str(tmp_path))
    assert one.columns == rows.columns and {r.doc_id for r in one.collect()} == kept
    two = stages["exact dedup"](spark, one, str(tmp_path))
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in exact_dedup.exact_dedup(one).collect() if r.kept}
    three = stages["simhash near-dedup"](spark, two, str(tmp_path))
    assert {str(r.doc_id) for r in three.collect()} == ({str(r.component_id) for r in simhash.simhash_near_dedup(two).collect()})
    four = stages["mixing"](spark, three, str(tmp_path))
    assert four.columns == rows.columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    five = corpus_pipeline.run(spark, str(tmp_path))
    assert five.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(str(r.doc_id) for r in five.collect()) == sorted(str(r.doc_id) for r in four.collect())
