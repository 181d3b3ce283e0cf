"""Hard negatives by a vantage-point tree over norm-augmented vectors.

Components are scaled to integers and scores are integer inner products, exact.
A vector x becomes (x, sqrt(M - |x|^2)), where M is the largest squared norm, and
an anchor q becomes (q, 0). Then |q - x|^2 = |q|^2 + M - 2 * score: a window of
scores is an annulus around the anchor, and higher scores are nearer.

The tree has two storeys. The upper one (LEAVES leaves at most) is fitted on a
sample of SAMPLE rows; every row is routed to its leaf, and the rows of a leaf
are dealt by a hash of vec_id to shards of about SHARD_BYTES, so a leaf of a
third of all rows is many shards. Each shard is one row of a stored table and
holds a tree of its own, down to buckets of BUCKET rows, with the least and
greatest distance of every bucket from every vantage point.

A search has two rounds. In the first an anchor sees only the leaf that it would be
routed to. Then the k-th best score found bounds its annulus from outside, and it
sees those other leaves that the annulus meets (by the leaves' least and greatest
distances). Anchors travel in packs, by merge joins on (leaf, shard). In a shard a
pack visits buckets from the nearest, and an anchor leaves the visit when a bucket
can't hold a better row, so what it has found narrows its annulus further. The
first search has one window per anchor and finds positives, the second one has a
window per positive and finds negatives. Bounds prune with a slack for rounding;
scores decide. So results are exact, whatever the tree prunes: on vectors without
structure in many dimensions that is little, and the work is anchors times rows.

Defined results
* rows with a null vec_id or label, a null vector, or a null or non-finite component take
  no part; nor do those whose score with themselves could leave the range of a long.
* where a vec_id repeats, the row of the smallest label, then of the smallest vector counts.
* vectors may differ in length: a missing component counts as 0 (so does an empty vector).
* an anchor without a positive, and a positive without a row in its window, give no rows;
  a negative positive_score has an empty window. An empty table gives no rows.
* further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from popweave.llm._store import drop_stored, scoped, shuffle_parts, stored

#: Rows that the upper storey is fitted on, its leaves, bytes of vectors of a shard, rows of a bucket.
SAMPLE, LEAVES, SHARD_BYTES, BUCKET = 4096, 256, 2 << 20, 512
#: Anchors of a pack.
PACK = 256
SCALE = 256
LEAST, MOST = -(1 << 62), 1 << 62
#: Slack of computed distances, relative to the largest norms.
SLACK = 4e-6
#: Bytes of the upper storey's vantage points, and of its sample.
TREE_BYTES, SAMPLE_BYTES = 8 << 20, 32 << 20


# --- trees -------------------------------------------------------------------


def augmented(rows: np.ndarray, square: float) -> np.ndarray:
    """Rows with the coordinate that gives all of them the squared norm ``square``."""
    x = rows.astype(np.float64)
    rest = np.sqrt(np.maximum(0.0, square - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From each row of ``a`` to each of ``b``."""
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, square))


@dataclass
class Tree:
    """Vantage points and radii in heap order; rows within a node's radius go to its first child."""

    points: np.ndarray
    radii: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.radii) + 1

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each (augmented) row."""
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.leaves.bit_length() - 1):
            off = rows - self.points[node]
            node = 2 * node + 1 + (np.sqrt(np.einsum("ij,ij->i", off, off)) > self.radii[node])
        return node - len(self.radii)

    def path(self, leaf: int) -> list[int]:
        """The nodes above a leaf, from the root."""
        node, out = leaf + len(self.radii), []
        while node:
            node = (node - 1) // 2
            out.append(node)
        return out[::-1]


def fit(rows: np.ndarray, depth: int) -> tuple[Tree, list[np.ndarray]]:
    """A full tree of 2**depth leaves, cut at medians, and the rows of each leaf. A
    node's vantage point is the row farthest from its first one, which spreads distances."""
    nodes = 2**depth - 1
    tree = Tree(np.zeros((nodes, rows.shape[1])), np.zeros(nodes))
    members = [np.arange(len(rows))]
    for node in range(nodes):
        own = members[node]
        if len(own):
            tree.points[node] = rows[own[np.argmax(distances(rows[own[:1]], rows[own])[0])]]
            away = distances(tree.points[node : node + 1], rows[own])[0]
            tree.radii[node] = np.median(away)
            members += [own[away <= tree.radii[node]], own[away > tree.radii[node]]]
        else:
            members += [own, own]
    return tree, members[nodes:]


def depth_for(rows: float, each: int) -> int:
    return max(0, ceil(np.log2(max(1.0, rows / each))))


@dataclass
class Bounds:
    """Least and greatest distance of each group of rows (columns) from each vantage point (rows)."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (augmented) anchor and group: bounds below and above of its distances to the group's rows."""
        near = np.zeros((len(q), self.low.shape[1]))
        far = np.full(near.shape, np.inf)
        away = distances(q, self.points)
        for v in range(len(self.points)):
            d = away[:, v : v + 1]
            near = np.maximum(near, np.maximum(self.low[v] - d, d - self.high[v]))
            far = np.minimum(far, d + self.high[v])
        return near, far


# --- rows --------------------------------------------------------------------

TOP = np.uint64(1 << 63)


def encode(row: np.ndarray) -> bytes:
    """Integers as bytes that sort as they do."""
    return (row.astype(np.int64).view(np.uint64) ^ TOP).astype(">u8").tobytes()


def decode(rows: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) integers; missing ones are 0."""
    raw = rows.to_pylist()
    if all(len(r) == 8 * dims for r in raw):
        flat = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64)
        return (flat ^ TOP).view(np.int64).reshape(len(raw), dims)
    out = np.zeros((len(raw), dims), np.int64)
    for i, r in enumerate(raw):
        out[i, : len(r) // 8] = (np.frombuffer(r, ">u8").astype(np.uint64) ^ TOP).view(np.int64)
    return out


@scoped
def scaled_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, row, square, dims, peak): a stored table, one row for each vec_id that takes part."""
    spark = vectors.sparkSession

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "label", "row", "square", "dims", "peak"]
        for batch in batches:
            keep, rows, squares, dims, peaks = [], [], [], [], []
            column = batch.column(2)
            for i in range(batch.num_rows):
                values = column[i].values
                if values.null_count:
                    continue
                row = np.floor(SCALE * values.to_numpy(zero_copy_only=False).astype(np.float64))
                square = float(row @ row)
                if square <= MOST:  # false for infinite and undefined ones too
                    keep.append(i), rows.append(encode(row)), squares.append(square), dims.append(len(row))
                    peaks.append(int(np.abs(row).max(initial=0.0)))
            kept = batch.take(pa.array(keep, pa.int64()))
            columns = [kept.column(0), kept.column(1), pa.array(rows, pa.binary()), pa.array(squares, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dims, pa.int32()), pa.array(peaks, pa.int64())], names)

    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    given = given.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    rows = stored(given.mapInArrow(scale, "vec_id long, label long, row binary, square double, dims int, peak long"), "rows")
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    rest = [c for c in rows.columns if c != "vec_id"]
    one = stored(rows.groupBy("vec_id").agg(F.min(F.struct(*rest)).alias("one")).select("vec_id", "one.*"), "rows_once")
    drop_stored(spark, rows)
    return one


# --- index -------------------------------------------------------------------


@dataclass
class Index:
    shards: DataFrame  # one row for each shard
    tree: Tree
    bounds: Bounds  # of the upper storey's leaves
    counts: dict[int, int]  # shards of each leaf
    dims: int
    square: float
    exact: bool  # whether scores are exact in doubles


SHARD = "leaf int, shard int, n int, ids binary, labels binary, vectors binary, offsets binary, points binary, low binary, high binary, near array<double>, far array<double>"


def build(rows: DataFrame, shard_bytes: int = SHARD_BYTES, most_leaves: int = LEAVES) -> Index | None:
    """The index of all ``rows``; None if there are none."""
    spark = rows.sparkSession
    told = rows.agg(F.count("*").alias("n"), F.max("square").alias("square"), F.max("dims").alias("dims"), F.max("peak").alias("peak")).first()
    if not told["n"]:
        return None
    dims, square = max(told["dims"], 1), told["square"]
    kind = next(t for t in (np.int16, np.int32, np.int64) if told["peak"] < np.iinfo(t).max)
    per_shard = max(BUCKET, shard_bytes // (4 * dims))
    depth = min(depth_for(told["n"], per_shard), most_leaves.bit_length() - 1, (max(1, TREE_BYTES // (8 * (dims + 1)))).bit_length() - 1)
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    sample = rows.select("vec_id", "row").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("row").toArrow().column("row")
    tree = fit(augmented(decode(sample, dims), square), depth)[0]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.route(augmented(decode(batch.column("row"), dims), square)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", *batch.schema.names])

    sizes = rows.select("row").mapInArrow(routed, "leaf int, row binary").groupBy("leaf").count().collect()
    shards = {r["leaf"]: ceil(r["count"] / per_shard) for r in sizes}
    n_shards = F.element_at(F.create_map(*[F.lit(x) for kv in shards.items() for x in kv]), F.col("leaf"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("leaf").to_numpy().astype(np.int64) << 32 | batch.column("shard").to_numpy().astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and b > a and (held[0].column("leaf")[0], held[0].column("shard")[0]) != (batch.column("leaf")[a], batch.column("shard")[a]):
                    yield shard_of(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield shard_of(held)

    def shard_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        x = decode(table.column("row").combine_chunks(), dims)
        full = augmented(x, square)
        own, buckets = fit(full, depth_for(len(x), BUCKET))
        buckets = [b[np.argsort(ids[b], kind="stable")] for b in buckets if len(b)]
        away = distances(own.points, full)
        low, high = (np.stack([f(away[:, b], axis=1) for b in buckets], axis=1) for f in (np.min, np.max))
        order = np.concatenate(buckets)
        leaf = table.column("leaf")[0].as_py()
        above = distances(tree.points[tree.path(leaf)], full)
        values = (leaf, table.column("shard")[0].as_py(), len(x), ids[order].tobytes(), labels[order].tobytes(), x[order].astype(kind).tobytes(), np.cumsum([0, *map(len, buckets)]).tobytes(), own.points.tobytes(), low.tobytes(), high.tobytes(), above.min(axis=1).tolist(), above.max(axis=1).tolist())
        return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, values, strict=True)}, schema=schema)

    schema = to_arrow_schema(T._parse_datatype_string(SHARD))
    names = schema.names
    dealt = rows.select("vec_id", "label", "row").mapInArrow(routed, "leaf int, vec_id long, label long, row binary")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), n_shards.cast("long")).cast("int"))
    tasks = max(shuffle_parts(spark), ceil(sum(shards.values()) / 16))
    packed = stored(dealt.repartition(tasks, "leaf", "shard").sortWithinPartitions("leaf", "shard", "vec_id").mapInArrow(pack, SHARD), "shards")
    low, high = np.zeros((len(tree.radii), tree.leaves)), np.full((len(tree.radii), tree.leaves), np.inf)
    ends = [f(F.col(c)[i]).alias(f"{c}{i}") for i in range(depth) for f, c in ((F.min, "near"), (F.max, "far"))]
    for r in packed.groupBy("leaf").agg(F.count("*"), *ends).collect():
        for i, v in enumerate(tree.path(r["leaf"])):
            low[v, r["leaf"]], high[v, r["leaf"]] = r[f"near{i}"], r[f"far{i}"]
    return Index(packed, tree, Bounds(tree.points, low, high), shards, dims, square, dims * float(told["peak"]) ** 2 < 2**53)


# --- search ------------------------------------------------------------------


@dataclass
class Pack:
    """Anchors with their windows of scores, and for each window the k-th best score found so far (or its lower end)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    found: np.ndarray

    def take(self, rows: np.ndarray) -> Pack:
        return Pack(*(getattr(self, f)[rows] for f in PACKED))

    def met(self, near: np.ndarray, far: np.ndarray, square: float) -> np.ndarray:
        """(anchor, group): whether a window's annulus meets the distances between ``near`` and ``far``."""
        own = np.einsum("ij,ij->i", self.vectors.astype(np.float64), self.vectors.astype(np.float64))[:, None]
        slack = SLACK * np.sqrt(own + square)
        away = lambda score: np.sqrt(np.maximum(0.0, own + square - 2.0 * score))
        outer, inner = away(np.maximum(self.low, self.found)) + slack, away(self.high) - slack
        open_ = self.low <= self.high
        out = np.zeros(near.shape, bool)
        for w in range(open_.shape[1]):
            out |= open_[:, w : w + 1] & (near <= outer[:, w : w + 1]) & (far >= inner[:, w : w + 1])
        return out


PACKED = ("ids", "labels", "vectors", "low", "high", "found")


def best_of(score: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Of each row's valid columns at most the k that come first: higher scores, then earlier columns."""
    if score.shape[1] <= k or np.count_nonzero(valid) <= 4 * k * len(score):
        return valid
    least = np.iinfo(np.int64).min if score.dtype == np.int64 else -np.inf
    masked = np.where(valid, score, least)
    kth = np.partition(masked, -k, axis=1)[:, -k:-k + 1 or None][:, :1]
    above = valid & (masked > kth)
    ties = valid & (masked == kth)
    room = k - above.sum(axis=1, keepdims=True)
    return above | (ties & (np.cumsum(ties, axis=1) <= room))


class Found:
    """The k best (score, id) of each anchor and window: higher scores, then smaller ids."""

    def __init__(self, pack: Pack, k: int) -> None:
        shape = (*pack.low.shape, k)
        self.pack, self.k = pack, k
        self.score, self.id = np.full(shape, LEAST - 1), np.full(shape, np.iinfo(np.int64).max)

    def add(self, w: int, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        mine = np.unique(anchor)
        who = np.concatenate([np.repeat(mine, self.k), anchor])
        s = np.concatenate([self.score[mine, w].ravel(), score])
        i = np.concatenate([self.id[mine, w].ravel(), ids])
        order = np.lexsort((i, -s, who))
        who, s, i = who[order], s[order], i[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        first = rank < self.k
        self.score[who[first], w, rank[first]], self.id[who[first], w, rank[first]] = s[first], i[first]
        self.pack.found[mine, w] = np.maximum(self.pack.found[mine, w], self.score[mine, w, -1])

    def rows(self) -> tuple[np.ndarray, ...]:
        a, w, r = np.nonzero(self.score >= LEAST)
        return self.pack.ids[a], w.astype(np.int32), self.score[a, w, r], self.id[a, w, r]


def visit(pack: Pack, shard: dict, same: bool, k: int, square: float, exact: bool) -> Found:
    """What ``pack`` finds in a shard, whose buckets are visited from the nearest."""
    found = Found(pack, k)
    whole = np.concatenate([pack.vectors.astype(np.float64), np.zeros((len(pack.ids), 1))], 1)
    near, far = Bounds(shard["points"], shard["low"], shard["high"]).reach(whole)
    number = np.float64 if exact else np.int64
    q = pack.vectors.astype(number)
    for b in np.argsort(near.mean(axis=0), kind="stable"):
        who = np.flatnonzero(pack.met(near[:, b : b + 1], far[:, b : b + 1], square)[:, 0])
        if not len(who):
            continue
        part = slice(shard["offsets"][b], shard["offsets"][b + 1])
        ids = shard["ids"][part]
        score = q[who] @ shard["vectors"][part].astype(number).T
        fits = (pack.labels[who][:, None] == shard["labels"][part][None]) == same
        fits &= pack.ids[who][:, None] != ids[None]
        for w in range(pack.low.shape[1]):
            floor = np.maximum(pack.low, pack.found)[who, w][:, None]
            valid = best_of(score, fits & (score >= floor) & (score <= pack.high[who, w][:, None]), k)
            a, c = np.nonzero(valid)
            if len(a):
                found.add(w, who[a], score[a, c].astype(np.int64), ids[c])
    return found


@scoped
def search(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(vec_id, slot, score, other, rank): the first ``k`` rows in each window of each anchor, of
    equal (``same``) or different label, itself apart. ``anchors`` has vec_id, label, row, low and high."""
    tree, bounds, counts, dims, square, exact = index.tree, index.bounds, index.counts, index.dims, index.square, index.exact
    fields = [f"p_{f}" for f in PACKED]
    sent = "leaf int, shard int, " + ", ".join(f"{f} binary" for f in fields)

    def packs(first: bool):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = [np.array(batch.column(c).to_pylist(), np.int64) for c in ("low", "high", "found")]
                pack = Pack(batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), decode(batch.column("row"), dims), *lists)
                whole = np.concatenate([pack.vectors.astype(np.float64), np.zeros((len(pack.ids), 1))], 1)
                home = tree.route(whole)
                own = home[:, None] == np.arange(tree.leaves)
                wanted = own if first else pack.met(*bounds.reach(whole), square) & ~own
                for leaf, shards in counts.items():
                    rows = np.flatnonzero(wanted[:, leaf])
                    for at in range(0, len(rows), PACK):
                        part = pack.take(rows[at : at + PACK])
                        columns = [pa.array([getattr(part, f).tobytes()] * shards, pa.binary()) for f in PACKED]
                        where = [pa.array(np.full(shards, leaf, np.int32)), pa.array(np.arange(shards, dtype=np.int32))]
                        yield pa.RecordBatch.from_arrays([*where, *columns], ["leaf", "shard", *fields])

        return deal

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels, vectors, low, high, found = (np.frombuffer(r[f], np.int64) for f in fields)
                n = len(ids)
                pack = Pack(ids, labels, vectors.reshape(n, dims), low.reshape(n, -1), high.reshape(n, -1), found.reshape(n, -1).copy())
                stored_kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(r["vectors"]) // (r["n"] * dims)]
                offsets = np.frombuffer(r["offsets"], np.int64)
                shard = {
                    "ids": np.frombuffer(r["ids"], np.int64),
                    "labels": np.frombuffer(r["labels"], np.int64),
                    "vectors": np.frombuffer(r["vectors"], stored_kind).reshape(r["n"], dims),
                    "offsets": offsets,
                    "points": np.frombuffer(r["points"], np.float64).reshape(-1, dims + 1),
                    "low": np.frombuffer(r["low"], np.float64).reshape(-1, len(offsets) - 1),
                    "high": np.frombuffer(r["high"], np.float64).reshape(-1, len(offsets) - 1),
                }
                columns = visit(pack, shard, same, k, square, exact).rows()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vec_id", "slot", "score", "other"])

    rank = F.row_number().over(Window.partitionBy("vec_id", "slot").orderBy(F.desc("score"), "other"))
    best = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
    shards = index.shards.drop("near", "far")

    def look_round(asked: DataFrame, first: bool) -> DataFrame:
        met = asked.mapInArrow(packs(first), sent).hint("merge").join(shards, ["leaf", "shard"])
        return met.mapInArrow(look, "vec_id long, slot int, score long, other long")

    one = stored(best(look_round(anchors.withColumn("found", F.col("low")), True)), "first_round")
    # The k-th best of a window bounds what can still come into it.
    full = one.groupBy("vec_id", "slot").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    full = full.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("least"))
    asked = anchors.join(full, "vec_id", "left").withColumn("found", F.expr("transform(low, (x, i) -> coalesce(element_at(least, i), x))"))
    two = look_round(asked.drop("least"), False)
    out = stored(best(one.drop("rank").unionByName(two)), "both_rounds")
    drop_stored(anchors.sparkSession, one)
    return out


@scoped
def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, shard_bytes: int = SHARD_BYTES, leaves: int = LEAVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors (vec_id divisible by ``every``)."""
    spark = vectors.sparkSession
    rows = scaled_rows(vectors)
    index = build(rows, shard_bytes, leaves)
    if index is None:
        return spark.createDataFrame([], OUT)
    anchors = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "row")
    window = lambda low, high: {"low": F.array(F.lit(low)), "high": F.array(F.lit(high))}
    same = search(index, anchors.withColumns(window(LEAST, MOST)), True, positives)
    # ceil(80 * score / 100) is score - score div 5; below 0 no score fits.
    score = lambda i: F.element_at("scores", F.lit(i))
    scores = same.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    is_open = lambda i: F.coalesce(score(i) >= 0, F.lit(False))
    ends = {
        "low": F.array(*(F.when(is_open(i), score(i) - F.expr(f"element_at(scores, {i}) div 5")).otherwise(1) for i in range(1, positives + 1))),
        "high": F.array(*(F.when(is_open(i), score(i)).otherwise(0) for i in range(1, positives + 1))),
    }
    other = search(index, anchors.join(scores, "vec_id").withColumns(ends).drop("scores"), False, negatives)
    pairs = same.select("vec_id", (F.col("rank") - 1).alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = other.withColumnRenamed("score", "negative_score").withColumnRenamed("other", "negative_id").join(pairs, ["vec_id", "slot"])
    drop_stored(spark, rows, index.shards)
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

SQL = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchor AS (SELECT * FROM fit WHERE vec_id % 100 = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM anchor a JOIN fit b ON a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""
