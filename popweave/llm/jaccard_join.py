"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles. Equal sets are one text; the
join is over different texts. Each text is embedded as MinHash values, on which
the share of equal coordinates estimates the similarity.

A run starts with all texts in one node. A node picks one or two coordinates
(1/0.8 of them on average, from its own path's hash) and sends each text to
the child of its value there, so texts of similarity 0.8 or more share one
child or more on average, and others part. A child of at most ``LEAF`` texts is
a leaf and is compared by brute force; a larger one splits again, up to DEPTH
times, and what is left then is compared in blocks. Every run has coordinates of
its own, and every level of a run too, so runs miss a pair independently; they
repeat until a pair at the threshold is missed with less probability than
1 - RECALL.

In leaves, pairs whose coordinates allow the threshold are verified on their
whole shingle sets, each in the first leaf that both texts share. How many equal
coordinates that takes follows from RECALL as well: a tenth of the misses that it
allows are left to this test, the rest to the paths. A leaf gives sums of links
and a star of its connected texts, never the list of its pairs; leaves with equal
members are compared once. Labels spread along the stars until every component
has the smallest.

Defined results
* null text, or none with a word: no shingles, so a class of its own.
* texts of one to four words have one shingle of all their words.
* texts of any length are compared whole; an empty table gives no rows.
* repeated rows are copies of one text; all of them get a result row.
* class_id is the smallest doc_id of a component (null ids count only where
  there is no other), text_id the smallest with the same shingles.
* a pair at exactly 0.8 is linked; of equal doc_ids in a component the one with
  the smallest text hash stays in :func:`one_of_each`.
* further columns are ignored, and kept by :func:`one_of_each` whatever their
  names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm._store import drop_stored, free_names, release, scoped, shuffle_parts, stored
from popweave.llm._words import mix, slices, utf8, windows, words

# Joins are merge joins throughout: each side grows with the corpus, so none is
# broadcast, and the plan is the same at every size.
U = np.uint64
SHINGLE = 5
DEPTH = 3
RECALL = 0.99999
LEAF = 1000
#: Coordinates that a level of a run picks from: two at its root, three below.
PICKS = (2, 3, 3)
#: Shingles that a block of a leaf may hold, which bounds a comparison's memory.
BLOCK_SHINGLES = 4_000_000
ROWS = 2048


def run_recall(two_at_root: bool, similarity: float = 0.8) -> float:
    """The probability, at least, that a run of DEPTH levels finds a pair of ``similarity``.

    A node's second coordinate is there with probability 1/0.8 - 1 and counts
    only where the first one parts the pair, as two children may pick alike.
    """
    found = 1.0
    for level in reversed(range(DEPTH)):
        second = (1 / 0.8 - 1) if level else float(two_at_root)
        found *= similarity + second * (1 - similarity) * similarity
    return found


def root_flags(runs: int) -> list[bool]:
    """Which runs pick two coordinates at the root: every fourth."""
    return [r % 4 == 3 for r in range(runs)]


def runs_needed(recall: float, similarity: float = 0.8) -> int:
    """Runs until the paths of a pair of ``similarity`` miss it in nine tenths of the
    cases that ``recall`` allows, at most."""
    runs, miss = 0, 1.0
    while miss > 0.9 * (1 - recall):
        runs += 1
        miss = math.prod(1 - run_recall(f, similarity) for f in root_flags(runs))
    return runs


def least_equal(coordinates: int, recall: float, similarity: float = 0.8) -> int:
    """Equal coordinates that a pair of ``similarity`` has but for a tenth of the cases that ``recall`` leaves."""
    below = 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > 0.1 * (1 - recall):
            return k
    return 0


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit shingles of each of at most 4096 texts, and where each text's begin."""
    w = words(texts)
    n = np.diff(w.first)
    h, bounds = windows(w.hashes, w.first, SHINGLE)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = []
        for i in short.tolist():
            x = n[i : i + 1].astype(U)
            for v in w.hashes[w.of(i)]:
                x = mix(x ^ v)
            whole.append(x)
        h, owner = np.concatenate([h, *whole]), np.concatenate([owner, short])
    keyed = np.sort((owner.astype(U) << U(52)) | (h >> U(12)))
    keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])] if len(keyed) else keyed
    first = np.searchsorted(keyed, np.arange(len(texts) + 1).astype(U) << U(52))
    return keyed & U((1 << 52) - 1), first


def _constants(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * coordinates + 1, dtype=U))
    return seed[::2] | U(1), seed[1::2]


def sketch(values: np.ndarray, first: np.ndarray, coordinates: int) -> tuple[np.ndarray, list[bytes | None]]:
    """MinHash values (texts x coordinates, 32 bits) and a 128-bit key of each set."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    heads = first[:-1][some]
    sig = np.zeros((len(n), coordinates), np.uint32)
    keys: list[bytes | None] = [None] * len(n)
    if len(some):
        for k, (a, b) in enumerate(zip(*_constants(coordinates), strict=True)):
            sig[some, k] = np.minimum.reduceat(((values * a + b) >> U(32)).astype(np.uint32), heads)
        m = mix(values)
        both = np.stack([np.add.reduceat(m, heads) + n[some].astype(U), np.bitwise_xor.reduceat(mix(m + U(7)), heads)], 1)
        for i, row in zip(some.tolist(), both, strict=True):
            keys[i] = row.tobytes()
    return sig, keys


def sketches(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, cid (hash of the text), key, n_shingles, sig (4 bytes each) and tag (1 byte each)."""
    coordinates = runs_needed(recall) * sum(PICKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                for at in range(0, some.num_rows, ROWS):
                    part = some.slice(at, ROWS)
                    values, first = shingle_sets(utf8(part.column("text")))
                    sig, keys = sketch(values, first, coordinates)
                    tag = (mix(sig.astype(U)) & U(255)).astype(np.uint8)
                    rows = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("cid"), pa.array(keys, pa.binary()), pa.array(np.diff(first), pa.int64()), rows(sig), rows(tag)], ["doc_id", "cid", "key", "n_shingles", "sig", "tag"])

    text = F.col("text").cast("string")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(text).alias("cid"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, cid long, key binary, n_shingles long, sig binary, tag binary")


def _value(at) -> F.Column:
    return F.substring("sig", at * 4 + 1, 4) if isinstance(at, int) else F.substr("sig", at * 4 + 1, F.lit(4))


def _roots(texts: DataFrame, runs: int) -> DataFrame:
    """Every text in the nodes that it goes to from the root of each run."""
    made = [(r, r * sum(PICKS) + k) for r, two in enumerate(root_flags(runs)) for k in range(1 + two)]
    nodes = F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), F.lit(c), _value(c)).alias("node")) for r, c in made])
    return texts.select("key", "sig", "n_shingles", F.explode(nodes).alias("at")).select("key", "sig", "n_shingles", "at.run", "at.node")


def _children(rows: DataFrame, level: int) -> DataFrame:
    """Every text in the one or two children of its node (of ``level``) that it goes to."""
    one = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PICKS[level]))
    other = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(3)), F.lit(PICKS[level] - 1)), F.lit(PICKS[level]))

    def child(of: DataFrame, pick: F.Column) -> DataFrame:
        at = (F.col("run") * sum(PICKS) + sum(PICKS[:level]) + pick).cast("int")
        return of.select("key", "sig", "n_shingles", "run", F.xxhash64("node", at, _value(at)).alias("node"))

    two = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(4)) == 0
    return child(rows, one).unionByName(child(rows.where(two), other))


def leaves(texts: DataFrame, recall: float = RECALL) -> DataFrame:
    """(node, key, block, blocks): texts of every leaf with two or more, equal leaves once."""
    runs = runs_needed(recall)
    level_rows, level_nodes = [], []
    rows = _roots(texts, runs)
    for level in range(DEPTH):
        print_ = F.xxhash64("key")
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.sum(F.pmod(print_, F.lit(1 << 40))).alias("f1"), F.bit_xor(print_).alias("f2")).where("n > 1")
        nodes = stored(nodes, "nodes")
        last = level == DEPTH - 1
        level_rows.append(rows.select("key", "node"))
        level_nodes.append(nodes if last else nodes.where(F.col("n") <= LEAF))
        big = nodes.where(F.col("n") > LEAF).select("node")
        if last or big.isEmpty():
            break
        # Only members of large nodes get their coordinates again.
        inside = rows.select("key", "run", "node").join(big.hint("merge"), "node", "left_semi")
        rows = _children(stored(texts.select("key", "sig", "n_shingles").join(inside.hint("merge"), "key"), "large"), level + 1)
    every = level_nodes[0]
    for nodes in level_nodes[1:]:
        every = every.unionByName(nodes)
    blocks = F.greatest(F.ceil(F.col("n") / LEAF), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    once = stored(every.groupBy("n", "f1", "f2").agg(F.min("node").alias("node"), F.first("size").alias("size")).select("node", blocks.alias("blocks")), "leaves")
    found = None
    for rows in level_rows:
        part = rows.join(once.hint("merge"), "node")
        found = part if found is None else found.unionByName(part)
    return found.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks").cast("long")).cast("int"))


def _tasks(members: DataFrame) -> DataFrame:
    """Adds task: each leaf's blocks meet in pairs, within themselves too."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    t = members.withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    t = t.withColumn("task", F.xxhash64("node", low, high)).withColumn("within", low == high)
    return t.drop("other")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each task, of batches that are sorted by task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), batch.num_rows]
        if held and held[0].column("task")[0].as_py() != task[0]:
            yield _one(held)
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield _one(held)
                held = []
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def pairs_to_check(group: pa.RecordBatch, least: int) -> np.ndarray:
    """Upper triangle: pairs with ``least`` equal tags that don't meet in an earlier leaf."""
    n = group.num_rows
    tag = np.frombuffer(b"".join(group.column("tag").to_pylist()), np.uint8).reshape(n, -1)
    may = np.zeros((n, n), bool)
    for i in range(n - 1):
        may[i, i + 1 :] = (tag[i + 1 :] == tag[i]).sum(1) >= least
    if not group.column("within")[0].as_py():
        block = group.column("block").to_numpy()
        may &= block[:, None] != block[None, :]
    if may.any():
        node = group.column("node")[0].as_py()
        earlier: dict[int, list[int]] = {}
        for i, nodes in enumerate(group.column("nodes").to_pylist()):
            for x in nodes:
                if x < node:
                    earlier.setdefault(x, []).append(i)
        for own in earlier.values():
            if len(own) > 1:
                may[np.ix_(own, own)] = False
    return may


def overlaps(sets: list[np.ndarray], may: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, common shingles) of the pairs to check."""
    i, j = np.nonzero(may)
    if len(i) <= 2000:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        value = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        number = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]]))
        shared = np.bincount(number)[number] > 1
        number, owner = np.unique(number[shared], return_inverse=True)[1], owner[shared]
        total = np.zeros(may.shape, np.float32)
        for at in range(0, int(number.max(initial=-1)) + 1, 2048):
            a, b = np.searchsorted(number, [at, at + 2048])
            x = np.zeros((len(sets), 2048), np.float32)
            x[owner[a:b], number[a:b] - at] = 1
            total += x @ x.T
        common = total[i, j].astype(np.int64)
    yield i, j, common


def _keep_checked(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            may = pairs_to_check(group, least)
            keep = may.any(0) | may.any(1)
            if keep.any():
                yield group.filter(pa.array(keep))

    return run


def _verify(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "root", "links", "linked_docs"]
        for group in _groups(batches):
            may = pairs_to_check(group, least)
            sets = [np.frombuffer(x, U) for x in group.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            copies = group.column("n_copies").to_numpy()
            key = group.column("key").to_pylist()
            linked = np.zeros(may.shape, bool)
            for i, j, common in overlaps(sets, may):
                real = 5 * common >= 4 * (size[i] + size[j] - common)
                linked[i[real], j[real]] = linked[j[real], i[real]] = True
            own = np.flatnonzero(linked.any(0))
            if not len(own):
                continue
            linked = linked[np.ix_(own, own)]
            label = np.arange(len(own))
            while True:
                lower = np.minimum(label, np.where(linked, label, len(own)).min(1))
                if (lower == label).all():
                    break
                label = lower
            rows = [[key[k] for k in own], [key[own[x]] for x in label], linked.sum(1), linked @ copies[own]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())], names)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key of each component; edges (key, root) without self-loops.

    Labels take the smallest label around them and then that label's own, so
    paths halve each round. No component is gathered anywhere.
    """
    both = stored(edges.union(edges.select("root", "key")).toDF("key", "other").distinct(), "edges")
    labels = stored(both.groupBy("key").agg(F.min("other").alias("near")).select("key", F.least("key", "near").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("other"), F.col("label").alias("seen")), "other").groupBy("key").agg(F.min("seen").alias("seen"))
        moved = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        above = labels.select(F.col("key").alias("label"), F.col("label").alias("above"))
        jumped = moved.join(above, "label", "left").select("key", "was", F.least("label", F.coalesce("above", "label")).alias("label"))
        jumped = stored(jumped, "labels")
        drop_stored(jumped.sparkSession, labels)
        if jumped.where("label <> was").isEmpty():
            drop_stored(jumped.sparkSession, both)
            return jumped.select("key", "label")
        labels = jumped.select("key", "label")


def similar_texts(docs: DataFrame, sketched: DataFrame, recall: float = RECALL) -> DataFrame:
    """(key, text_id, n_copies, links, linked_docs, class_id) of every different shingle set."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    least = least_equal(runs_needed(recall) * sum(PICKS), recall)
    with_key = sketched.where("key IS NOT NULL")
    texts = with_key.groupBy("key").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"), F.min(F.struct("n_shingles", "sig", "tag")).alias("s"), F.min(F.struct("doc_id", "cid")).alias("source"))
    texts = stored(texts.select("key", "text_id", "n_copies", "s.n_shingles", "s.sig", "s.tag", "source"), "sets")
    members = stored(leaves(texts, recall), "members")
    release(spark)

    nodes = members.groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    tagged = members.join(nodes.hint("merge"), "key").join(texts.select("key", "tag", "n_copies").hint("merge"), "key")
    tagged = _tasks(tagged).select("task", "node", "block", "within", "key", "tag", "n_copies", "nodes")
    ddl = "task long, node long, block int, within boolean, key binary, tag binary, n_copies long, nodes array<long>"
    checked = stored(tagged.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_keep_checked(least), ddl), "checked")
    drop_stored(spark, members)
    release(spark)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                for at in range(0, some.num_rows, ROWS):
                    part = some.slice(at, ROWS)
                    values, first = shingle_sets(utf8(part.column("text")))
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["key", "shingles"])

    # One document of each text to check; equal rows of it give the same set.
    wanted = checked.select("key").distinct().hint("merge").join(texts.select("key", "source"), "key").select("key", F.col("source.doc_id").alias("source_id"), F.col("source.cid").alias("source_cid"))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("cid"), text.alias("text"))
    bodies = rows.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("source_id")) & (F.col("cid") == F.col("source_cid"))).select("key", "text")
    sets = bodies.mapInArrow(shingles, "key binary, shingles binary").dropDuplicates(["key"])
    full = checked.join(sets.hint("merge"), "key").repartition(parts, "task").sortWithinPartitions("task")
    links = stored(full.mapInArrow(_verify(least), "key binary, root binary, links long, linked_docs long"), "links")
    drop_stored(spark, checked)
    release(spark)

    labels = components(links.where("key <> root").select("key", "root"))
    sums = links.groupBy("key").agg(F.sum("links").alias("links"), F.sum("linked_docs").alias("linked_docs"))
    out = texts.select("key", "text_id", "n_copies").join(sums.hint("merge"), "key", "left").join(labels.hint("merge"), "key", "left")
    out = stored(out.withColumn("label", F.coalesce("label", "key")), "classes")
    drop_stored(spark, texts, links, labels)
    least = out.groupBy("label").agg(F.min("text_id").alias("class_id"))
    zero = F.lit(0).cast("long")
    return out.join(least.hint("merge"), "label").select("key", "label", "text_id", "n_copies", F.coalesce("links", zero).alias("links"), F.coalesce("linked_docs", zero).alias("linked_docs"), "class_id")


@scoped
def join_documents(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """For every document: doc_id, cid, component (null without a word), class_id, text_id, n_copies, n_links
    (different texts of similarity 0.8 or more) and n_linked_docs (documents
    of these texts, and other copies of its own)."""
    sketched = stored(sketches(docs, recall), "sketches")
    info = similar_texts(docs, sketched, recall)
    own = sketched.select("doc_id", "cid", "key").join(info.hint("merge"), "key", "left")
    lone = F.col("key").isNull()
    return own.select(
        "doc_id",
        "cid",
        F.col("label").alias("component"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce(F.col("linked_docs") + F.col("n_copies") - 1, F.lit(0).cast("long")).alias("n_linked_docs"),
    )


@scoped
def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Of every component the rows of its smallest doc_id (one row if repeated); rows without a word stay."""
    found = stored(join_documents(docs, recall).select("doc_id", "cid", "component"), "components")
    in_one = found.where("component IS NOT NULL")
    best = in_one.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cid")).alias("b"))
    best = best.select("b.doc_id", "b.cid", F.lit(True).alias("single"))
    lone = found.where("component IS NULL").select("doc_id", "cid", F.lit(False).alias("single")).distinct()
    own_id, own_cid, single = free_names(docs, "kept_id", "kept_cid", "single")
    keep = stored(best.unionByName(lone).toDF(own_id, own_cid, single), "kept")
    match = docs["doc_id"].eqNullSafe(keep[own_id]) & (F.xxhash64(docs["text"].cast("string")) == keep[own_cid])
    again = found.groupBy("doc_id", "cid").agg(F.count("*").alias("n"), F.max(F.col("component").isNotNull()).alias("single")).where("n > 1 AND single")
    if again.isEmpty():
        return docs.join(keep, match, "left_semi")
    rows = docs.join(keep, match)
    first = rows.where(rows[single]).dropDuplicates([own_id, own_cid])
    return first.unionByName(rows.where(~rows[single])).drop(own_id, own_cid, single)
