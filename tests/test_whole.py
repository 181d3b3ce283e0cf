"""Queries over whole tables, against small Python references."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from popweave.operators import communities as com
from popweave.operators import metrics
from popweave.plans import catalog, generation  # noqa: F401
from popweave.plans import fixtures as fx

DATA = "/root/testdata/sf0.001"


def graph(spark):
    nodes = sorted(r.node_id for r in fx.nodes(spark, DATA).collect())
    return nodes, [(r.src, r.dst) for r in fx.edges(spark, DATA).collect()]


def test_components_of_all_edges(spark):
    nodes, edges = graph(spark)
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r.node_id: r.component for r in catalog.QUERIES["m9_components"](spark, DATA).collect()}
    assert found == {n: find(n) for n in nodes}


def test_bootstrap_of_all_runs(spark):
    def uniform(k, *keys):
        return int(hashlib.md5("|".join(map(str, (42, "boot", *keys, k // 4))).encode()).hexdigest()[8 * (k % 4) : 8 * (k % 4) + 8], 16) / 16**8

    values = defaultdict(list)
    for r in fx.runs(spark, DATA).orderBy("run").collect():
        values[r.network].append(r.value)
    assert sum(map(len, values.values())) == fx.runs(spark, DATA).count()
    found = {r.network: (r.low, r.high) for r in catalog.QUERIES["r18_bootstrap"](spark, DATA).collect()}
    assert set(found) == set(values)
    for network, x in values.items():
        n, x = len(x), np.array(x)
        v = [x[[min(int(uniform(k, network, b) * n), n - 1) for k in range(n)]].var(ddof=1) for b in range(1, 1001)]
        assert found[network] == pytest.approx(np.quantile(v, [0.025, 0.975]), abs=1e-3)


def spread_labels(nodes, edges):
    near = {n: {n} for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    before, label = None, {n: n for n in nodes}
    while True:
        count = {n: Counter(label[x] for x in near[n]) for n in nodes}
        new = {n: min(c, key=lambda x: (-c[x], x)) for n, c in count.items()}
        if new in (label, before):
            return new
        before, label = label, new


def test_labels_spread_over_all_edges(spark):
    found = catalog.QUERIES["m6_label_propagation"](spark, DATA).collect()
    assert {r.node_id: r.community for r in found} == spread_labels(*graph(spark))


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(15)], [(i, i + 1) for i in range(0, 8, 2)] + [(0, 3), (3, 6), (2, 7)]])
def test_labels_spread_until_they_settle(spark, links):
    nodes = list(range(16))
    found = metrics.label_propagation(spark.createDataFrame([(n,) for n in nodes], "node_id long"), spark.createDataFrame(links, "src long, dst long"))
    assert {r.node_id: r.community for r in found.collect()} == spread_labels(nodes, links)


def test_pairs_of_all_people(spark):
    n = fx.grouped_nodes(spark, DATA)
    home = {r.node_id: r.community for r in com.assign_natural(n, n.count() // 4).collect()}
    assert set(home) == set(graph(spark)[0])
    pairs = [(r.src, r.dst) for r in catalog.QUERIES["e8_complete_communities"](spark, DATA).collect()]
    assert Counter(pairs) == Counter((a, b) for a in home for b in home if a != b and home[a] == home[b])


def test_households_hold_all_people(spark):
    held = Counter()
    for r in catalog.QUERIES["c12_households"](spark, DATA).collect():
        held[r.group_id] += r.n
    assert held == {r.group_id: r.n for r in fx.groups(spark, DATA).collect()}


def test_distances_from_all_nodes(spark):
    nodes, edges = graph(spark)
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    want = {}
    for s in nodes:
        front, want[s, s] = [s], 0
        for x in front:
            for y in out[x]:
                if (s, y) not in want:
                    want[s, y] = want[s, x] + 1
                    front.append(y)
    assert {(r.source, r.node_id): r.distance for r in catalog.QUERIES["m8_distances"](spark, DATA).collect()} == want
    far = [d for d in want.values() if d]
    mean = pytest.approx(sum(far) / len(far), abs=1e-6)
    assert catalog.QUERIES["m8_path_length"](spark, DATA).first() == (mean, len(far))
    assert catalog.QUERIES["m12_metric_bundle"](spark, DATA).first().path_length == mean
    ends = {x for e in edges for x in e}
    assert [r.node_id for r in catalog.QUERIES["m11_non_isolates"](spark, DATA).collect()] == [n for n in nodes if n in ends][:50]


def test_distances_run_to_the_end_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long")
    source = spark.createDataFrame([(0,)], "node_id long")
    assert metrics.average_path_length(edges, source).first() == (35.5, 70)


def test_a_round_keeps_sources_as_bits(spark, monkeypatch):
    """130 sources of a ring, three words: a round's table has a row a node and word, not a source."""
    rows = []
    store = metrics.stored
    monkeypatch.setattr(metrics, "stored", lambda df, tag: rows.append((tag, (out := store(df, tag)).count())) or out)
    ring = spark.createDataFrame([(i, (i + s) % 130) for i in range(130) for s in (1, 7)], "src long, dst long")
    every = spark.range(130).select(F.col("id").alias("node_id"))
    found = metrics.distances(ring, every.union(every))
    assert found.count() == 130 * 130 == found.select("source", "node_id").distinct().count()
    assert {r.distance for r in found.where("(node_id - source + 130) % 130 = 20").collect()} == {8}
    assert max(n for tag, n in rows if tag == "front") <= 3 * 130


def test_label_propagation_leaves_settled_parts_alone(spark, monkeypatch):
    """Once few labels move, only nodes beside them are asked again: a path goes on while cliques have settled."""
    cliques = [(100 + 5 * c + i, 100 + 5 * c + j) for c in range(80) for i in range(5) for j in range(i)]
    links = cliques + [(i, i + 1) for i in range(30)] + [(30, 0)]
    seen, store = [], metrics.stored

    def stored(df, tag):
        out = store(df, tag)
        if tag == "touched":
            seen.append(out.count())
        return out

    monkeypatch.setattr(metrics, "stored", stored)
    nodes = sorted({v for p in links for v in p})
    found = metrics.label_propagation(spark.createDataFrame([(n,) for n in nodes], "node_id long"), spark.createDataFrame(links, "src long, dst long"))
    got = {r.node_id: r.community for r in found.collect()}
    near = {v: [v] for v in nodes}
    for a, b in links:
        near[a].append(b), near[b].append(a)
    label, was = {v: v for v in nodes}, None
    while True:
        new = {}
        for v in nodes:
            told = [label[x] for x in near[v]]
            new[v] = min(told, key=lambda c: (-told.count(c), c))
        if new in (label, was):
            label = new
            break
        label, was = new, label
    assert got == label
    assert seen and max(seen) <= 31
