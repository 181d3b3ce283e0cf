"""Benchmark decontamination with a distributed positional inverted index.

The index is split by document: each shard (a few MB of text) stores, for every
term that the phrases use, where it stands, in coordinates that run through the
shard's documents with gaps between them, so that no phrase crosses documents.
Phrases are looked up shard by shard: the postings of a phrase's rarest term in
that shard, moved by its offset, are the candidates, and the postings of its
other terms, from rare to frequent, are intersected with them.

Phrases (the benchmark) are the stated query set. They go to the executors in
blocks of ``block_bytes`` of text, so what is broadcast has a fixed bound; each
block is a pass over the documents. A shard keeps only postings that can be
part of a phrase: those in runs of at least the shortest phrase's length.

A proximity match of a phrase of n words is a shortest stretch of at most
n + slop words of one document that has all of the phrase's words, in any order
and each as often as the phrase does. Seeds are the rarest term's postings;
seeds with every other term near them are settled by one pass over the sorted
postings around them, all terms jointly.

Terms are 64-bit hashes of lower-cased words.

Defined results
* null text: no words; null item texts and items without words have no windows.
* items of fewer than ``width`` words are one window; repeated items and
  windows count for each item_id once; null item_ids are ignored.
* repeated documents get a row each; an empty benchmark contaminates nothing,
  an empty table of documents gives no rows.
* overlapping matches and ties all count; hit words are counted once.
* texts of any length are read whole; a text is never in two shards.
* further columns are ignored, and kept by :func:`clean_documents` whatever
  their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm._store import free_names, scoped, stored
from popweave.llm._words import byte_class, slices, utf8, words

#: Bytes of a word: all but these (fixed values of the word definition); A-Z are lower-cased first.
WORD = ~byte_class("".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
WIDTH = 10
BLOCK_BYTES = 8 << 20
CANDIDATES = 1 << 20
SHARD_BYTES = 4 << 20


@dataclass
class Phrases:
    """Distinct windows as rows of vocabulary numbers (grouped by length), and the items that have them."""

    vocabulary: np.ndarray
    by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # length, windows, item bounds, items
    items: list[str]

    @property
    def shortest(self) -> int:
        return min((n for n, *_ in self.by_length), default=0)

    @property
    def longest(self) -> int:
        return max((n for n, *_ in self.by_length), default=0)


def phrases(items: list[tuple[str, bytes]], width: int = WIDTH) -> Phrases:
    w = words([text for _, text in items], WORD, lower=True)
    vocabulary, numbers = np.unique(w.hashes, return_inverse=True)
    numbers = numbers.astype(np.int32)
    n = np.diff(w.first)
    by_length = []
    for length in np.unique(np.minimum(n, width)[n > 0]).tolist():
        own = np.flatnonzero(np.minimum(n, width) == length)
        count = n[own] - length + 1
        at = np.repeat(w.first[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        rows = np.ascontiguousarray(numbers[at[:, None] + np.arange(length)])
        _, first, same = np.unique(rows.view(f"V{4 * length}").ravel(), return_index=True, return_inverse=True)
        owners = np.unique(np.stack([same, np.repeat(own, count)]), axis=1)
        bounds = np.searchsorted(owners[0], np.arange(len(first) + 1))
        by_length.append((length, rows[first], bounds, owners[1]))
    return Phrases(vocabulary, by_length, [k for k, _ in items])


def numbered(hashes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the hashes that are in the sorted vocabulary, and their numbers."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(16, int(len(vocabulary)).bit_length() + 4)
    table = np.zeros(1 << bits, bool)
    shift = np.uint64(64 - bits)
    table[vocabulary >> shift] = True
    at = np.flatnonzero(table[hashes >> shift])
    k = np.minimum(np.searchsorted(vocabulary, hashes[at]), len(vocabulary) - 1)
    real = vocabulary[k] == hashes[at]
    return at[real], k[real]


def in_long_runs(at: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """Which of the sorted word numbers ``at`` stand in runs of ``least`` or more within a text."""
    if not len(at):
        return np.zeros(0, bool)
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner) != 0)])
    run = np.cumsum(new) - 1
    return np.bincount(run)[run] >= least


def index(docs: DataFrame, query: Phrases, slop: int = 0) -> DataFrame:
    """One row for each shard: its documents, and postings sorted by term and place."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((query.vocabulary, 1 if slop else query.shortest, query.longest + slop))
    schema = f"doc_ids array<{kind}>, n_words binary, keys binary, first binary, terms binary, places binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, least, gap = sent.value
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                texts = utf8(part.column("text"))
                w = words(texts, WORD, lower=True)
                n = np.diff(w.first)
                first = w.first[:-1] + np.arange(len(n)) * (gap + 1)
                at, term = numbered(w.hashes, vocabulary)
                owner = np.searchsorted(w.first, at, "right") - 1
                keep = in_long_runs(at, owner, least)
                place = at[keep] + owner[keep] * (gap + 1)
                order = np.lexsort((place, term[keep]))
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * (np.arange(len(w.hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))])
                    keys = total[w.first[1:]] - total[w.first[:-1]]
                blobs = [n.astype(np.int64), keys, first.astype(np.int64), term[keep][order].astype(np.int32), place[order].astype(np.int64)]
                ids = part.column("doc_id")
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_ids", "n_words", "keys", "first", "terms", "places"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(build, schema)


def intersect(windows: np.ndarray, terms: np.ndarray, places: np.ndarray, size: int, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of every occurrence in a shard, in runs of bounded length.

    With ``slop``, start is a place of the rarest term that has each of the
    other terms less than ``length + slop`` words away: a candidate only.
    """
    length = windows.shape[1]
    windows = windows.astype(np.int64)
    counts = np.bincount(terms, minlength=size)
    heads = np.concatenate([[0], np.cumsum(counts)])
    span = int(places.max()) + 2 * (length + slop) + 2 if len(places) else 1
    key = terms.astype(np.int64) * span + places
    some = np.flatnonzero((counts[windows] > 0).all(1))
    order = np.argsort(counts[windows[some]], axis=1, kind="stable")
    seeds = counts[windows[some, order[:, 0]]] if len(some) else np.zeros(0, np.int64)
    group = np.cumsum(seeds) // CANDIDATES
    for g in range(int(group[-1]) + 1 if len(group) else 0):
        own = np.flatnonzero(group == g)
        if not len(own):
            continue
        k = np.repeat(own, seeds[own])
        rank = np.arange(len(k)) - np.repeat(np.cumsum(seeds[own]) - seeds[own], seeds[own])
        start = places[heads[windows[some[k], order[k, 0]]] + rank]
        if not slop:
            start = start - order[k, 0]
            k, start = k[start >= 0], start[start >= 0]
        for j in range(1, length):
            term = windows[some[k], order[k, j]] * span
            if slop:
                low = np.maximum(start - length - slop + 1, 0)
                at = np.searchsorted(key, term + low)
                real = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] <= term + start + length + slop - 1)
            else:
                want = term + start + order[k, j]
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                real = key[at] == want
            k, start = k[real], start[real]
        yield some[k], start


def near_matches(windows: np.ndarray, terms: np.ndarray, places: np.ndarray, size: int, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, end) of the proximity matches of a shard."""
    reach = windows.shape[1] + slop
    heads = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=size))])
    for k, seed in intersect(windows, terms, places, size, slop):
        out = []
        by = np.lexsort((seed, k))
        k, seed = k[by], seed[by]
        # Seeds that can share a match are settled together.
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (seed[1:] - seed[:-1] >= reach)])) if len(k) else np.zeros(0, np.int64)
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(k)], strict=True):
            window, need = np.unique(windows[k[a]], return_counts=True)
            low, high = int(seed[a]) - reach + 1, int(seed[b - 1]) + reach
            found = []
            for t in window.tolist():
                own = places[heads[t] : heads[t + 1]]
                i, j = np.searchsorted(own, [low, high])
                found += [(p, t) for p in own[i:j].tolist()]
            out += [(int(k[a]), x, y) for x, y in shortest_covers(sorted(found), dict(zip(window.tolist(), need.tolist(), strict=True))) if y - x <= reach]
        yield tuple(np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def shortest_covers(found: list[tuple[int, int]], need: dict[int, int]) -> Iterator[tuple[int, int]]:
    """[start, end) of all stretches that have ``need`` of each term and no part that has."""
    have = dict.fromkeys(need, 0)
    lacking, left = len(need), 0
    for right, (place, term) in enumerate(found):
        have[term] += 1
        lacking -= have[term] == need[term]
        grown = True
        while not lacking:
            start, first = found[left]
            # Only the last stretch from a given end is shortest; its first word is needed.
            if grown and have[first] == need[first]:
                yield start, place + 1
                grown = False
            have[first] -= 1
            lacking += have[first] < need[first]
            left += 1
    return


def look_up(shards: DataFrame, query: Phrases, slop: int = 0) -> DataFrame:
    """doc_id, key, n_words, hits (merged [start, end) word spans) and items of every document."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    sent = shards.sparkSession.sparkContext.broadcast(query)
    schema = f"doc_id {kind}, key long, n_words long, hits array<array<long>>, items array<string>"

    def matches(windows: np.ndarray, terms: np.ndarray, places: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if slop:
            yield from near_matches(windows, terms, places, size, slop)
        else:
            for k, start in intersect(windows, terms, places, size):
                yield k, start, start + windows.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("doc_ids")[row].values
                blob = lambda name, as_type: np.frombuffer(batch.column(name)[row].as_py(), as_type)  # noqa: B023, E731
                n, first, terms, places = (blob(c, t) for c, t in (("n_words", np.int64), ("first", np.int64), ("terms", np.int32), ("places", np.int64)))
                hits: dict[int, list[np.ndarray]] = {}
                items: dict[int, set[int]] = {}
                for _, windows, bounds, owners in q.by_length:
                    for k, start, end in matches(windows, terms, places, len(q.vocabulary)):
                        doc = np.searchsorted(first, start, "right") - 1
                        pairs = np.unique(np.stack([doc, k]), axis=1)
                        for d, x in pairs.T.tolist():
                            items.setdefault(d, set()).update(owners[bounds[x] : bounds[x + 1]].tolist())
                        spans = np.unique(np.stack([doc, start - first[doc], end - first[doc]]), axis=1)
                        for d in np.unique(spans[0]).tolist():
                            hits.setdefault(d, []).append(spans[1:, spans[0] == d])
                merged = [merge(np.concatenate(hits[d], axis=1)) if d in hits else [] for d in range(len(n))]
                named = [sorted({q.items[i] for i in items.get(d, ())}) for d in range(len(n))]
                arrays = [ids, pa.array(blob("keys", np.int64)), pa.array(n), pa.array(merged, pa.list_(pa.list_(pa.int64()))), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n_words", "hits", "items"])

    return shards.mapInArrow(search, schema)


def merge(spans: np.ndarray) -> list[list[int]]:
    """Union of [start, end) spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans.T.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int, width: int) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of about ``block_bytes`` of text."""
    b = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        yield phrases([(r.item_id, bytes(r.text)) for r in rows], width)


@scoped
def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits and items of every document; ``slop`` > 0 asks for
    proximity matches instead of exact phrases."""
    found: DataFrame | None = None
    passes = 0
    for query in benchmark_blocks(benchmark, block_bytes, width):
        one = look_up(stored(index(docs, query, slop), "postings"), query, slop)
        found = one if found is None else found.unionByName(one)
        passes += 1
    if found is None:
        return look_up(stored(index(docs, phrases([])), "postings"), phrases([])).drop("key")
    if passes > 1:
        # The same text has the same hits in each pass; rows come back as often as they were there.
        g = found.groupBy("doc_id", "key", "n_words").agg(F.flatten(F.collect_list("hits")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("rows"))
        # Append to the last span or start a new one.
        step = lambda acc, x: F.when((F.size(acc) > 0) & (x[0] <= F.element_at(acc, -1)[1]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], x[1]))))).otherwise(F.concat(acc, F.array(x)))
        hits = F.aggregate(F.array_sort("spans"), F.array().cast("array<array<bigint>>"), step)
        found = g.withColumn("hits", hits).withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / passes).cast("int"))))
        found = found.select("doc_id", "key", "n_words", "hits", "items")
    return found.drop("key")


@scoped
def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    m = find_matches(docs, benchmark, width)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return m.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


@scoped
def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without any word of a benchmark phrase's occurrence."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("cid")).alias("doc_id"), text.alias("text"))
    dirty = find_matches(keyed, benchmark, width).where(F.size("hits") > 0).select("doc_id.id", "doc_id.cid").distinct()
    own_id, own_cid = free_names(docs, "dirty_id", "dirty_cid")
    dirty = stored(dirty.toDF(own_id, own_cid), "dirty")
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty[own_id]) & (F.xxhash64(docs["text"].cast("string")) == dirty[own_cid]), "left_anti")


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, gram)),
spans AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spans USING (r) LEFT JOIN items USING (r)
"""
