"""After each operator only the tables that its result reads are left in the shared folder."""

import os

import pytest

from popweave.llm import chat_format, decontaminate, fill_middle, hard_negatives, imatch, jaccard_join, mixing, pii, quality_model, quality_rules, suffix_dedup, token_lengths, warc

from . import fixtures as fx

VECTORS = "vec_id long, label int, embedding array<float>"


def items(spark):
    return spark.createDataFrame([(1, fx.prose(0, 40))], "item_id long, text string")


def nodes(spark):
    return spark.createDataFrame([("a", None, 1.0), ("b", "a", 2.0), ("c", "b", 3.0)], "node string, parent string, score double")


def pages(spark):
    return spark.createDataFrame([(k, "http://a", "x" * 200) for k in range(3)], "page_id long, url string, html string")


OPERATORS = {
    "op1": lambda s: pii.find_pii(fx.documents(s)),
    "op1_masked": lambda s: pii.masked(fx.documents(s)),
    "op2": lambda s: jaccard_join.join_documents(fx.documents(s)),
    "op2_one": lambda s: jaccard_join.one_of_each(fx.documents(s)),
    "op3": lambda s: mixing.mix_sources(fx.documents(s)),
    "op4": lambda s: quality_rules.quality_verdicts(fx.documents(s), fx.labels(s)),
    "op5": lambda s: token_lengths.length_histogram(fx.documents(s)),
    "op6": lambda s: quality_model.classify(fx.documents(s)),
    "op7": lambda s: suffix_dedup.remove_repeats(fx.documents(s)),
    "op8": lambda s: decontaminate.contamination(fx.documents(s), items(s)),
    "op9": lambda s: chat_format.branches(nodes(s)),
    "op10": lambda s: warc.convert_pages(pages(s)),
    "op11": lambda s: imatch.compare_with_edits(fx.documents(s)),
    "op12": lambda s: fill_middle.fill_in_middle(fx.documents(s)),
    "op13": lambda s: hard_negatives.mine(s.createDataFrame([(k, k % 2, [float(k)]) for k in range(300)], VECTORS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_only_the_results_tables_are_left(spark, name):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    out = OPERATORS[name](spark)
    left = {f for f in set(os.listdir(root)) - before if f.startswith("popweave-")}
    read = {part for f in out.inputFiles() for part in f.split("/") if part.startswith("popweave-")}
    assert left == {f for f in read if f in left} and out.count() >= 0
