"""I-Match fingerprints: hashes of a document's terms within a band of inverse document frequency.

Terms are lower-cased words. A first pass counts in how many documents each term
stands; the lexicon is the terms of the band, neither common words nor words of
a few documents. A document's kept terms are its distinct terms in the lexicon,
sorted. Its fingerprint has the hash of all kept terms (classic I-Match) and
hashes of those in randomised lexicon subsets, so that an edit which changes
some terms leaves many hashes alone. The lexicon is thinned SUBSETS times at a
rate of 4**-level; a document uses the levels at which about one kept term is
left (4**(level - 1) to 4**(level + 1) kept terms), so texts of like length share
levels. The likeness of two fingerprints is 1 if all kept terms are equal, else
the share of equal hashes among those subsets that hold a term of either, at the
finest common level that tells enough.

The lexicon's size is bounded for any corpus: its terms stand in LEAST of the
documents at least, and documents have T distinct terms on average, so it has
T / LEAST terms at most; LEAST is raised where that is over MOST_TERMS. So it is
sent to all tasks (8 bytes a term).

The next document (descending doc_id) is found without a window over all rows:
quantiles of doc_id cut the documents into ranges, each range is sorted in a
task, and the first document of each range is dealt to the range before it too.

Defined results
* null text: empty. A text without terms is known by its SHA-256 and has no subsets.
* a text of whose distinct terms less than a quarter is in the lexicon (copies in a
  sixteenth of all documents make their terms common) uses all its terms.
* null doc_ids come last, equal doc_ids by a hash of their texts; repeated rows
  make a row each. They share a range, so a task has all rows of one doc_id.
* one document is its own next one; an empty table gives no rows; further columns
  are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm._store import drop_stored, scoped, shuffle_parts, stored
from popweave.llm._words import byte_class, mix, powers, slices, utf8, words

TERM = ~byte_class("".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
U = np.uint64
#: A lexicon term stands in this share of the documents at least, and at most.
LEAST, MOST = 1 / 2048, 1 / 16
#: In small corpora a term may stand in so many documents anyway.
MOST_DOCS = 8
#: Terms of a lexicon.
MOST_TERMS = 1 << 20
SUBSETS = 32
#: Subsets with a term of either text from which a level is trusted alone.
TELLING = 8
SALT = np.random.default_rng(11).integers(0, 1 << 63, SUBSETS, np.int64).astype(U)
#: Bytes of text of a range of doc_ids, and ranges: beyond their product ranges have more, and Spark's sort spills.
RANGE_BYTES, MOST_RANGES = 16 << 20, 20_000


def distinct_terms(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct term hashes of each text."""
    found = words(texts, TERM, lower=True)
    return [np.unique(found.hashes[found.of(i)]) for i in range(len(texts))]


def term_counts(docs: DataFrame) -> DataFrame:
    """(kind, term, n): kind 0 in how many documents a term stands; kind 1 the documents, kind 2 their bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            kinds = np.full(len(terms), kind, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(terms.view(np.int64)), pa.array(n)], ["kind", "term", "n"])

        def summed(terms: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            unique, where = np.unique(np.concatenate(terms), return_inverse=True)
            total = np.zeros(len(unique), np.int64)
            np.add.at(total, where, np.concatenate(n))
            return unique, total

        one = np.zeros(1, U)
        terms, n, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = utf8(part.column("text"))
                yield rows(1, one, np.array([len(texts)]))
                yield rows(2, one, np.array([sum(map(len, texts))]))
                sets = distinct_terms(texts)
                terms += sets
                n += [np.ones(len(s), np.int64) for s in sets]
                held += sum(map(len, sets))
                if held > 1 << 20:
                    unique, total = summed(terms, n)
                    if len(unique) > 1 << 19:
                        yield rows(0, unique, total)
                        terms, n, held = [], [], 0
                    else:
                        terms, n, held = [unique], [total], len(unique)
        if terms:
            yield rows(0, *summed(terms, n))

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "kind int, term long, n long")
    return parts.groupBy("kind", "term").agg(F.sum("n").alias("n"))


def band(n_docs: int, n_terms: int) -> tuple[int, int]:
    """The least and the most documents of a lexicon term, given the documents and the sum of their distinct terms."""
    least = max(LEAST, n_terms / max(n_docs, 1) / MOST_TERMS)
    low = max(1, ceil(n_docs * least))
    return low, max(low, int(n_docs * MOST), MOST_DOCS)


@scoped
def lexicon(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The sorted term hashes of the band (MOST_TERMS at most), and the bytes of all texts."""
    counts = stored(term_counts(docs), "terms")
    sums = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    low, high = band(sums.get(1, 0), sums.get(0, 0))
    kept = counts.where((F.col("kind") == 0) & F.col("n").between(low, high)).select("term").toArrow()
    drop_stored(docs.sparkSession, counts)
    return np.sort(kept.column("term").to_numpy().astype(np.int64).view(U)), sums.get(2, 0)


def kept_terms(terms: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    at = np.searchsorted(lexicon, terms)
    known = terms[lexicon[np.minimum(at, len(lexicon) - 1)] == terms] if len(lexicon) else terms[:0]
    return known if 4 * len(known) >= len(terms) else terms


def levels(n: int) -> range:
    """The levels from 1 at which between a quarter and four of ``n`` kept terms are left on average."""
    top = (max(n, 1).bit_length() - 1) // 2  # the largest with 4**top <= n
    return range(max(1, top if n > 4**top else top - 1), top + 2) if n else range(0)


def subset_hashes(kept: list[np.ndarray]) -> list[dict[int, np.ndarray]]:
    """For each text, its hash of 16 bits in each subset of each of its levels (0: no term there)."""
    out = [{level: np.zeros(SUBSETS, U) for level in levels(len(k))} for k in kept]
    sizes = np.array([len(k) for k in kept], np.int64)
    terms, owner = np.concatenate([*kept, np.zeros(0, U)]), np.repeat(np.arange(len(kept)), sizes)
    spans = [levels(int(n)) for n in sizes]
    for extra in range(max(map(len, spans), default=0)):
        level = np.array([s[extra] if extra < len(s) else 32 for s in spans], np.int64)[owner]
        for j in range(SUBSETS):
            drawn = mix(terms ^ SALT[j])
            inside = np.flatnonzero((level < 32) & (drawn >> (64 - 2 * np.minimum(level, 31)).astype(U) == 0))
            who = owner[inside]
            starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
            rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
            if len(who):
                hashed = np.add.reduceat(mix(terms[inside]) * powers(int(rank.max()) + 1)[0][rank], starts)
                for text, value in zip(who[starts].tolist(), (mix(hashed) % U(65535) + U(1)).tolist(), strict=True):
                    out[text][spans[text][extra]][j] = value
    return out


def fingerprints(texts: list[bytes], lexicon: np.ndarray) -> list[str]:
    """all:level=hashes:level=hashes of each text; hashes are hexadecimal, 16 digits of all kept terms, four of each subset."""
    kept = [kept_terms(t, lexicon) for t in distinct_terms(texts)]
    out = []
    for text, terms, subsets in zip(texts, kept, subset_hashes(kept), strict=True):
        whole = hashlib.sha256(terms.tobytes() if len(terms) else b"-" + text).hexdigest()[:16]
        out.append(":".join([whole, *(f"{level}={h.astype('>u2').tobytes().hex()}" for level, h in subsets.items())]))
    return out


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1 (1: equal kept terms)."""
    (whole, *one), (other, *two) = a.split(":"), b.split(":")
    if whole == other:
        return 1.0
    left, right = (dict(x.split("=") for x in parts) for parts in (one, two))
    equal = told = 0
    for level in sorted(left.keys() & right.keys(), key=int, reverse=True):
        x, y = (np.frombuffer(bytes.fromhex(d[level]), ">u2") for d in (left, right))
        equal += int(np.count_nonzero((x == y) & (x > 0)))
        told += int(np.count_nonzero((x > 0) | (y > 0)))
        if told >= TELLING:
            break
    return equal / told if told else 0.0


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (rounded down) replaced by as much of the next document's beginning."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, doc_id, text, hashed, echo): sorted by descending doc_id within each part, and parts in
    this order too. After a part's rows comes the first one of the next part, as echo."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hashed", F.xxhash64("text"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 10 * ranges).alias("cuts")).first()["cuts"] if shares else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    def part_of(ids: pa.Array) -> np.ndarray:
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = len(bounds) - np.searchsorted(bounds, numbers)
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, part).astype(np.int32)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(batch.column("doc_id"))), *batch.columns], ["part", "doc_id", "hashed"])

    ids = rows.select("doc_id", "hashed").mapInArrow(first, "part int, doc_id long, hashed long")
    # One row for each range: its first document, the greatest doc_id and then the least hash.
    heads = ids.groupBy("part").agg(F.max(F.struct("doc_id", F.bitwise_not("hashed").alias("rest"))).alias("head")).collect()
    order = sorted(r["part"] for r in heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # before the first comes the last
    head = {r["part"]: (r["head"]["doc_id"], ~r["head"]["rest"]) for r in heads}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "doc_id", "text", "hashed", "echo"]
        for batch in batches:
            part = part_of(batch.column("doc_id"))
            keys = zip(part.tolist(), batch.column("doc_id").to_pylist(), batch.column("hashed").to_pylist(), strict=True)
            again = [i for i, (p, doc, hashed) in enumerate(keys) if head[p] == (doc, hashed)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns, pa.array(np.zeros(len(part), bool))], names)
            if again:
                to = pa.array([before[p] for p in part[again].tolist()], pa.int32())
                rest = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([to, *rest.columns, pa.array([True] * len(again))], names)

    dealt = rows.mapInArrow(deal, "part int, doc_id long, text string, hashed long, echo boolean")
    tasks = max(shuffle_parts(spark), ranges // 4)
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", "echo", F.desc_nulls_last("doc_id"), "hashed")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    spark = docs.sparkSession
    terms, total = lexicon(docs)
    sent: Broadcast[np.ndarray] = spark.sparkContext.broadcast(terms)
    ranges = min(max(4 * shuffle_parts(spark), ceil(total / RANGE_BYTES)), MOST_RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int | None, str, bool, str] | None = None
        for batch in batches:
            for piece in slices(batch, "text"):
                part, ids, texts, echo = (piece.column(c).to_pylist() for c in ("part", "doc_id", "text", "echo"))
                own = fingerprints([t.encode() for t in texts], sent.value)
                rows = [*([last] if last else []), *zip(part, ids, texts, echo, own, strict=True)]
                last = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[3]]
                if pairs:
                    made = [edited(a[2], b[2]).encode() for a, b in pairs]
                    prints = fingerprints(made, sent.value)
                    columns = [
                        pa.array([a[1] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in made]),
                        pa.array([a[4] for a, _ in pairs]),
                        pa.array(prints),
                        pa.array([likeness(a[4], p) for (a, _), p in zip(pairs, prints, strict=True)], pa.float64()),
                        pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])

    return in_ranges(docs, ranges).select("part", "doc_id", "text", "echo").mapInArrow(run, OUT)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document, without a shuffle of texts."""
    sent: Broadcast[np.ndarray] = docs.sparkSession.sparkContext.broadcast(lexicon(docs)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = fingerprints(utf8(part.column("text")), sent.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")
