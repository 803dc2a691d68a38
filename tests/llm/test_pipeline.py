"""The corpus pipeline on the smallest tables: columns, decisions and token counts of every stage."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as p

    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        docs = p.save(stage(spark, docs, SF), name)
        assert docs.columns == first.columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
    tokens = p.STAGES[-1][1](spark, docs, SF).collect()
    assert len(tokens) == docs.count()
    ordered = sorted(tokens, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]


def test_empty_and_null_rows(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in {"none": [], "odd": [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "Some good words. " * 30, "en", None, 510)]}.items():
        d = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        assert p.run(spark, d).count() >= 0


def test_columns_that_clash_stay(spark):
    from gleaner.llm.decontamination import drop_leaks
    from gleaner.llm.near_dedup import keep_one

    item = "a passage of the benchmark that is long enough to be found in any text that holds it"
    rows = [(1, "some words of a text that nobody else has", 7, 8, 9), (2, item, 7, 8, 9), (3, item, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, _id int, _tag int")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(r) for r in drop_leaks(docs, benchmark).collect()] == rows[:1]
    assert sorted(tuple(r) for r in keep_one(docs).collect()) == rows[:2]
