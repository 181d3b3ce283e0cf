import corpus_pipeline
from popweave.llm import decontaminate, pii, quality_rules
from popweave.llm._store import stored

from . import fixtures as fx


def write(spark, path):
    from popweave.session import ship_package

    ship_package(spark)
    passage = fx.prose(50, 30)
    more = [(100, "see " + passage + " " + fx.prose(60, 40), "en", "s1", 1, "x", "y", "z", "w", "v"), (101, fx.prose(61, 60) + " write to me.too@example.org", "en", "s2", 1, "x", "y", "z", "w", "v")]
    spark.createDataFrame(fx.rows() + more, fx.SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    fx.labels(spark).write.parquet(f"{path}/labels.parquet")


def test_each_stage_does_its_work(spark, tmp_path):
    path = f"file://{tmp_path}"
    write(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, path), "stage")
        if name != "mixing":
            assert docs.columns == columns and dict(docs.dtypes) == dict(before.dtypes)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    kept = seen["quality_rules"]
    for i, text, *_ in fx.rows():
        c = quality_rules.measure_texts([(text or "").encode()])
        if i is not None and (c["n_words"][0] < 10 or 100 * c["n_repeat_words"][0] > 20 * c["n_words"][0]):
            assert i not in kept
    assert {5, 100, 101} <= kept.keys()
    assert 5 in seen["jaccard_join"] and not {6, 7, 8} & seen["jaccard_join"].keys()
    assert 100 not in seen["decontaminate"] and seen["jaccard_join"].keys() - {100} == seen["decontaminate"].keys()
    assert "[EMAIL]" in seen["pii"][101] and seen["pii"].keys() == seen["decontaminate"].keys()
    assert {i: t for i, t in seen["pii"].items() if i not in (16, 101)} == {i: t for i, t in seen["decontaminate"].items() if i not in (16, 101)}
    assert seen["mixing"].keys() <= seen["pii"].keys() and seen["mixing"]
    assert corpus_pipeline.run(spark, path).count() == docs.count()


def test_empty_corpus(spark, tmp_path):
    path = f"file://{tmp_path}"
    write(spark, path)
    docs = fx.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, path), "stage")
    assert docs.count() == 0


def test_stages_use_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontaminate", "pii", "mixing"]
    assert decontaminate.WIDTH == 10 and pii.KINDS == ("email", "ip", "card", "phone")
