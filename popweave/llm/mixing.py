"""Mixing sources to target weights with hash-threshold histograms (native).

Every document has a fixed 56-bit hash of its id. A source that needs ``need``
words beyond its whole passes takes the documents whose hash lies below the
threshold at which the running word count reaches ``need``. That threshold is
found without sorting documents: words are summed by (source, leading hash
bits), the bucket in which the sum crosses ``need`` is the boundary, and only
the rows of boundary buckets are summed again by the next bits. A histogram
has at most 2**15 rows for a source, whatever the number of documents.

Defined results
* null text, or one without words: size 0, taken 0; an empty table: no rows.
* null source: a source of its own, last in the order of sources.
* repeated rows share a hash; at the boundary they share what is left in
  proportion (rounded down). A null doc_id hashes like an empty string.
* the one document at the boundary is taken in part, so a source's total is
  its target rounded to words; other documents are taken whole.
* columns of the input that carry the names of results are replaced, others are
  ignored or kept whatever their names; texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popweave.llm._store import scoped, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Widths of the nested histograms' hash digits; together the 56 bits of the hash.
LEVELS = (11, 15, 15, 15)


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: str) -> Column:
    """56 bits of the id's MD5, the same in every engine and on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 14), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above
    ``max_repeats`` times its size, the excess going to the others by weight.

    ``sizes`` has one row for each source. Sources in the order of
    cap over weight fill up one after the other, so one pass over running sums
    finds which are capped.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.cast("long").alias("w"))
    w = w.withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    w = w.withColumns(
        {
            "all_words": F.sum("source_size").over(whole),
            "caps_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weights_on": F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    w = w.withColumn("capped", F.col("w") * (F.col("all_words") - F.col("caps_before")) > F.col("cap") * F.col("weights_on"))
    w = w.withColumns(
        {
            "capped_words": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0)),
            "open_weights": F.sum(F.when(~F.col("capped"), F.col("w"))).over(whole),
        }
    )
    share = (F.col("w") * (F.col("all_words") - F.col("capped_words"))).cast("double") / F.col("open_weights").cast("double")
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def thresholds(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """One row for each source: its target, whole passes, and hash threshold.

    ``sized`` has source, size, hash and is read ``1 + len(LEVELS)`` times.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, max_repeats)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long")
    plan = plan.withColumn("passes", passes)
    plan = stored(plan.withColumn("need", F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5).cast("long")), "targets")
    left = sum(LEVELS)
    edge = plan.where("need > 0").select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    inside = sized.where("size > 0")
    for width in LEVELS:
        known, left = left, left - width
        e = edge.select(F.col("source").alias("edge_source"), "need", "prefix", "before")
        rows = inside.join(e, F.col("source").eqNullSafe(F.col("edge_source")) & (F.shiftright("hash", known) == F.col("prefix")))
        hist = rows.groupBy("source", "need", "before", F.shiftright("hash", left).alias("prefix")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("prefix")) + F.col("before")
        hist = hist.withColumn("upto", running)
        edge = hist.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))
        edge = stored(edge.select("source", "need", "prefix", (F.col("upto") - F.col("words")).alias("before"), "words"), "boundary")
    e = edge.select(F.col("source").alias("edge_source"), F.col("prefix").alias("threshold"), (F.col("need") - F.col("before")).alias("rest"), F.col("words").alias("tied"))
    return stored(plan.join(e, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source"), "thresholds")


def take(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows with source, size and hash."""
    p = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "passes", "threshold", "rest", "tied")
    part = F.when(F.col("hash") < F.col("threshold"), F.col("size")).when(F.col("hash") == F.col("threshold"), F.floor(F.col("rest") * F.col("size") / F.col("tied")).cast("long")).otherwise(0)
    out = docs.join(p, F.col("source").eqNullSafe(F.col("plan_source")), "left")
    return out.withColumn("taken", (F.col("size") * F.col("passes") + part).cast("long")).drop("plan_source", "passes", "threshold", "rest", "tied", "hash")


@scoped
def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document."""
    sized = stored(docs.select("doc_id", "source", word_count("text").alias("size"), id_hash("doc_id").alias("hash")), "sizes")
    return take(sized, thresholds(sized, weights, max_repeats))


@scoped
def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """The documents that the mix takes, with every input column, and size,
    source_size, target and taken (words, repeats counted)."""
    made = ("size", "hash", "source_size", "target", "taken", "plan_source", "passes", "threshold", "rest", "tied")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    docs = docs.withColumns({"size": word_count("text"), "hash": id_hash("doc_id")})
    plan = thresholds(stored(docs.select("source", "size", "hash"), "sizes"), weights, max_repeats)
    return take(docs, plan).where("taken > 0")


def repeat_documents(mixed: DataFrame, copy: str = "copy") -> DataFrame:
    """One row for each time a document of :func:`mixed_documents` is read."""
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), times)))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 14))::BIGINT AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 3 AS cap,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM sources),
running AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps_before,
         (sum(w) OVER (ORDER BY cap / w, w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights_on
  FROM weighed),
capping AS (SELECT *, w * (total - caps_before) > cap * weights_on AS capped FROM running),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE (w * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)))::DOUBLE
                   / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target
  FROM capping),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS passes
  FROM targets),
cumulated AS (
  SELECT s.doc_id, s.size, s.h, n.source_size, n.target, n.passes,
         floor(n.target - n.passes * n.source_size + 0.5)::BIGINT AS need,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto,
         (sum(s.size) OVER (PARTITION BY s.source, s.h))::BIGINT AS tied
  FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       (size * passes + CASE WHEN upto <= need THEN size
                             WHEN upto - tied < need THEN floor((need - upto + tied) * size / tied)
                             ELSE 0 END)::BIGINT AS taken
FROM cumulated
"""
