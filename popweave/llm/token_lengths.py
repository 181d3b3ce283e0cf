"""Token counts of a corpus from an exact histogram of encoded lengths.

Documents are encoded once. Only (length, documents) rows leave the encoders,
counted before the shuffle; every later question - totals, quantiles, tokens
left under any context limit - is answered from the histogram's suffix sums,
exactly and without another look at the texts. Suffix sums are taken within
blocks of lengths and then shifted by the blocks' own sums, so that no task
holds the whole histogram.

The vocabulary is read by the driver from ``vocabulary`` (base64 token and rank
on a line) and sent to the executors; it is refused beyond ``MOST_VOCABULARY``
bytes, so what is broadcast is bounded.

Defined results
* null or empty text: a document of length 0; special tokens' strings are
  ordinary text; repeated rows count each; an empty table has no lengths.
* texts beyond ``PIECE`` characters are cut where no token can cross (before
  blanks that follow something else, and between ASCII letters and digits), so
  counts stay exact. Only a longer run without any such place is encoded at once,
  as its merges may reach over all of it.
* equal lengths are one row; limits may repeat and get a row each, null limits
  none; further columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popweave.llm._store import scoped, stored
from popweave.llm._words import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary splits text before merging (a fixed value that belongs to it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_VOCABULARY = 64 << 20
PIECE = 1 << 18
CUT = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
BLOCK = 1024


def load_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY + 1)
    if len(data) > MOST_VOCABULARY:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        m = CUT.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): documents by length, counted for each run of rows."""
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        for batch in batches:
            counts: dict[int, int] = {}
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    n = sum(len(encoding.encode_ordinary(p)) for p in pieces(text)) if text else 0
                    counts[n] = counts.get(n, 0) + 1
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(counts), pa.int64()), "n_docs": pa.array(list(counts.values()), pa.int64())})

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")


@scoped
def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row for each length that occurs, with suffix and prefix sums.

    n_tokens, n_docs, docs_at_least and tokens_at_least (of documents of that
    length or more), truncated_tokens (all tokens left when every document is
    cut to n_tokens), docs_cut (documents that such a cut shortens), and
    quantile (the share of documents of at most that length).
    """
    lengths = encoded_lengths(docs, vocabulary, pattern).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    hist = stored(lengths.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "lengths")
    own = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = own.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    h = hist.join(blocks, "block")
    h = h.withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("docs_after"))
    h = h.withColumn("tokens_at_least", F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("tokens_after"))
    cut = F.col("docs_at_least") - F.col("n_docs")
    return h.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
        cut.alias("docs_cut"),
        ((F.col("all_docs") - cut) / F.col("all_docs")).alias("quantile"),
    )


def totals_at(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """(context_limit, truncated_tokens, docs_cut) for any limits, from a stored histogram.

    ``limits`` is the stated query set, a column context_limit. A limit takes the
    suffix sums of the next longer length, which a window over the lengths and
    limits of its block finds, and where the block has none, the sums of the next
    block that has some.
    """
    lengths = hist.select("n_tokens", "docs_at_least", "tokens_at_least", F.lit(None).cast("long").alias("context_limit"))
    asked = limits.where("context_limit IS NOT NULL").select(F.col("context_limit").cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("docs_at_least"), F.lit(None).cast("long").alias("tokens_at_least"), F.col("context_limit").cast("long").alias("context_limit"))
    both = lengths.unionByName(asked).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    sums = F.struct(F.col("docs_at_least").alias("docs"), F.col("tokens_at_least").alias("tokens"))
    known = F.when(F.col("context_limit").isNull(), sums)
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rangeBetween(Window.unboundedPreceding, -1)
    here = both.withColumn("own", F.last(known, ignorenulls=True).over(longer))
    blocks = both.groupBy("block").agg(F.max(known).alias("all"))
    after = F.last("all", ignorenulls=True).over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    found = here.where("context_limit IS NOT NULL").join(blocks.select("block", after.alias("later")), "block")
    next_ = F.coalesce("own", "later")
    docs, tokens = (F.coalesce(next_[k], F.lit(0)) for k in ("docs", "tokens"))
    total = hist.agg(F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("total"))
    return found.crossJoin(F.broadcast(total)).select("context_limit", (F.col("total") - tokens + docs * F.col("context_limit")).alias("truncated_tokens"), docs.alias("docs_cut"))


def length_quantile(hist: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the documents don't exceed."""
    return hist.where(F.col("quantile") >= q).agg(F.min("n_tokens")).first()[0]
