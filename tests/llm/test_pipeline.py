import corpus_pipeline
from evistrata.llm import exact_dedup, mixing, ngram_join, quality

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    """Each stage against a plain reading of what it should do to what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), got.collect()
        ids = sorted(r.doc_id for r in after)
        if name == "quality":
            bad = {r.doc_id for r in quality.classify(docs, labels).collect() if not r.predicted}
            assert ids == sorted(r.doc_id for r in before if r.doc_id not in bad)
        elif name == "exact_dedup":
            assert ids == sorted({r.text: r.doc_id for r in sorted(before, key=lambda r: r.doc_id)}.values())
        elif name == "near_dedup":
            assert ids == sorted(r.doc_id for r in ngram_join.join_components(docs, 5, 80).collect() if r.doc_id == r.component_id)
        elif name == "mix":
            assert ids == sorted(r.doc_id for r in mixing.mix(docs).collect() for _ in range(r.copies if r.size else 0))
        else:
            assert ids == sorted(r.doc_id for r in before) and all(len(r.pieces) > 0 for r in after if r.text)
        assert got.columns[: len(columns)] == columns and (name == "pieces" or got.columns == columns)
        docs = got
        seen.append(name)
    assert corpus_pipeline.run(spark, SF).count() == docs.count() and len(seen) == 5


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_of_kept_text_leave_one(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", "x")], "doc_id long, text string, extra string")
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == [1, 2]
