"""Every operator gives the same rows beside columns whose names clash with its own."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from popweave.llm import chat_format, decontaminate, jaccard_join, mixing, pii, quality_model, quality_rules, suffix_dedup, token_lengths, warc

from . import fixtures as fx

NAMES = (
    "cid key sig tag node task block blocks row rows b d t n k x u h size hash taken target passes found votes features score good kept kept_id kept_cid single dirty_id dirty_cid label component "
    "links bucket part place places sha sha256 meta first first_doc window doc doc_ids terms keys n_words n_tokens n_docs stratum quality rule step cutoff base_failed leaf depth parent up top "
    "conv formatted turns piece span name data value volume record_id payload head kind uri refers_page refers_id id copy run other label_counts words weight source_size plan_source threshold rest tied"
).split()


def beside(df):
    """``df`` with a string column for each of NAMES that it doesn't have."""
    for n in NAMES:
        if n not in df.columns:
            df = df.withColumn(n, F.lit("clash"))
    return df


def docs(spark):
    rows = [(i, t, lang, s) for i, t, lang, s, *_ in fx.rows() if not t or len(t) < 5000]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)


OPERATORS = {
    "op1": lambda spark, d: pii.find_pii(d),
    "op2": lambda spark, d: jaccard_join.join_documents(d),
    "op3": lambda spark, d: mixing.mix_sources(d),
    "op4": lambda spark, d: quality_rules.quality_verdicts(d, beside(fx.labels(spark).drop("quality")).drop("quality").join(fx.labels(spark).select("doc_id", "quality"), "doc_id")),
    "op5": lambda spark, d: token_lengths.length_histogram(d),
    "op6": lambda spark, d: quality_model.classify(d),
    "op7": lambda spark, d: suffix_dedup.remove_repeats(d),
    "op8": lambda spark, d: decontaminate.contamination(d, beside(spark.createDataFrame([(1, fx.prose(0, 120))], "item_id long, text string"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    plain, clashing = (Counter(map(tuple, OPERATORS[name](spark, d).collect())) for d in (docs(spark), beside(docs(spark))))
    assert plain == clashing and plain


def test_conversations(spark):
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", None)], "conv_id long, turn long, role string, text string")
    plain, clashing = (Counter((r["conv"], r.formatted) for r in chat_format.format_conversations(x).collect()) for x in (t, beside(t)))
    assert plain == clashing and plain


def test_pages(spark):
    p = spark.createDataFrame([(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, None, None)], "page_id long, url string, html string")
    of = lambda df: Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())
    assert of(warc.convert_pages(p)) == of(warc.convert_pages(beside(p)))


@pytest.mark.parametrize("keeps", [jaccard_join.one_of_each, pii.masked, lambda d: decontaminate.clean_documents(d, d.sparkSession.createDataFrame([(1, fx.prose(0, 120))], "item_id long, text string")), lambda d: quality_rules.good_documents(d, fx.labels(d.sparkSession))])
def test_filters_keep_all_columns(spark, keeps):
    d = beside(docs(spark))
    out = keeps(d)
    assert out.columns == d.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in keeps(docs(spark)).collect())
