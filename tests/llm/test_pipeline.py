import corpus_pipeline
from tests.llm.cases import HARD, documents
from tests.llm.test_packing import check
from tests.llm.test_toxicity import corpus

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pack_what_is_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == names, name
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert 0 < docs.count() < 200
    check(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"] and corpus()


def test_stages_stand_hard_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats and extra columns: what each stage does with them."""
    docs = documents(spark, [*HARD, (11, None, None, "s"), (3, " \t\n", None, None)])
    spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, kept = dict(corpus_pipeline.STAGES), {}
    for name in ("toxicity", "line_dedup", "near_dedup", "mixing"):
        got = stages[name](spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        kept[name] = got.select("doc_id", "text").collect()
    assert len(kept["line_dedup"]) == len(HARD) + 2
    by_id = sorted((r.doc_id for r in kept["near_dedup"]), key=str)
    # blank texts are one group, and so are the copies of one text; one row of each stays
    assert by_id == [1, 4, 5, 6, 7]
    assert {r.doc_id for r in kept["mixing"]} <= {r[0] for r in HARD} | {11}
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in pieces if r.doc_id in (1, 2, 11)) == 3
