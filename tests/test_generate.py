import bisect
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from popweave.operators import communities as com
from popweave.operators import contagion, metrics, models
from popweave.operators import edges as ed
from popweave.operators.sampling import drawn, ranges, smallest_share
from popweave.operators.targets import fulfilment
from popweave.plans import api

POP = [("a", 60), ("b", 50), ("c", 40)]
LINKS = [("a", "a", 200), ("a", "b", 120), ("b", "a", 120), ("b", "c", 80), ("c", "c", 60)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(POP, "g string, n long"), spark.createDataFrame(LINKS, "g_src string, g_dst string, n long")


def check(n):
    e = n.edges
    assert e.where("src = dst").count() == 0
    assert e.select("src", "dst").distinct().count() == e.count()
    assert n.check_group_interactions().where("actual > target").count() == 0
    return fulfilment(n.check_group_interactions()).first()


@pytest.mark.parametrize("options", [{}, {"number_of_communities": 4, "preferential_attachment": 0.5, "reciprocity": 0.4, "transitivity": 0.3, "bridge_probability": 0.2}])
def test_graph_meets_its_targets(tables, options):
    n = api.generate(*tables, **options)
    f = check(n)
    assert f.requested == 580 and f.rate >= 0.95
    if options:
        assert {r.mechanism for r in n.edges.select("mechanism").distinct().collect()} >= {"primary", "reciprocal"}


def test_same_seed_same_graph(tables):
    a, b = (api.generate(*tables, seed=7, number_of_communities=3, refine_moves=50) for _ in range(2))
    assert a.edges.select("src", "dst").exceptAll(b.edges.select("src", "dst")).count() == 0


def test_reciprocity_raises_reciprocity(tables):
    low, high = (metrics.reciprocity(api.generate(*tables, reciprocity=r).edges).first().reciprocity for r in (0.0, 0.9))
    assert high > low


def test_round_trip(spark, tables, tmp_path):
    n = api.generate(*tables)
    n.write(f"file://{tmp_path}/net")
    assert api.read_network(spark, f"file://{tmp_path}/net").edges.count() == n.edges.count()


def test_refinement_keeps_totals_and_lowers_loss(tables):
    g, nodes = api.people(tables[0])
    t = api.group_targets(tables[1], g, ["g"], 1.0)
    a = com.assign_natural(nodes, 5)
    b = com.refine(a, t, moves=300)
    count = lambda x: sorted((r.group_id, r["count"]) for r in x.groupBy("group_id").count().collect())
    assert count(a) == count(b) and b.select("node_id").distinct().count() == 150

    def gap(x):
        comp = np.zeros((50, 3))
        for r in com.composition(x).collect():
            comp[r.community, r.group_id] = r.n
        budget = np.zeros((3, 3))
        for r in t.collect():
            budget[r.src_group, r.dst_group] = r.target
        return com.loss(comp, budget, 10.0)

    assert gap(b) <= gap(a)


def test_block_model_has_about_the_expected_edges(spark):
    nodes = spark.range(600).select(F.col("id").alias("node_id"), (F.col("id") % 2).alias("block"))
    p = spark.createDataFrame([(0, 0, 0.05), (0, 1, 0.01), (1, 1, 1.0)], "i long, j long, p double")
    e = models.stochastic_blocks(nodes, p).withColumn("b", F.col("u") % 2 + F.col("v") % 2).groupBy("b").count()
    n = {r.b: r["count"] for r in e.collect()}
    assert n[2] == 300 * 299 // 2
    assert abs(n[0] - 0.05 * 300 * 299 / 2) < 250 and abs(n[1] - 900) < 150


def test_contagion_is_monotone_and_closed(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 30)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 0)], "config long, node_id long")
    t = spark.createDataFrame([(0, 1.0)], "config long, threshold double")
    out = contagion.threshold_contagion(edges, seeds, t)
    assert {(r.node_id, r.step) for r in out.collect()} == {(i, i) for i in range(30)}
    assert [r.infected for r in contagion.series(out).orderBy("step").collect()] == list(range(1, 31))


def test_isolated_nodes_never_adopt_a_share(spark):
    edges = spark.createDataFrame([(1, 0)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 1)], "config long, node_id long")
    t = spark.createDataFrame([(0, 0.0)], "config long, threshold double")
    assert contagion.threshold_contagion(edges, seeds, t).count() == 1


def test_multiplex_layers(spark, tables):
    out = api.generate_multiplex(tables[0], {"home": tables[1], "family": tables[1]}, households=40, larger=3, scale=1.0)
    home, family = out["home"].edges, out["family"].edges
    kept = ed.sample_edges(home, 0.3)
    assert kept.count() == int(0.3 * home.count())
    assert kept.join(family, ["src", "dst"], "left_anti").count() == 0


def test_overlap_of_nested_layers_makes_no_pair_of_the_first(spark, tables):
    """Equal to the overlap of the layers' edges put together, also where a layer makes edges of its own."""
    more = tables[1].withColumn("n", F.col("n") * 2)
    links = {"home": tables[1], "family": tables[1], "near": more, "work": tables[1]}
    out = api.generate_multiplex(tables[0], links, households=70, larger=3, scale=1.0)
    assert out["near"].edges.where("phase <> 'given'").count() > 0
    found = api.multiplex_overlap(out)
    assert found.count() > 4
    assert sorted(found.collect()) == sorted(ed.layer_overlap(ed.combine_layers({k: v.edges for k, v in out.items()})).collect())


@pytest.mark.parametrize("total", [1, 10, 4000])
def test_smallest_share_is_the_smallest(spark, total):
    """With numbers that repeat, and where the cut lies far from its likely place."""
    rows = spark.range(total).select("id", F.pmod(F.xxhash64("id"), F.lit(500)).alias("x")).withColumns({"even": F.lpad(F.hex(F.col("x") * 2**39), 12, "0"), "low": F.lpad(F.lower(F.hex("x")), 12, "0")})
    rows = rows.withColumn("even", F.lower("even"))
    ordered = [r.id for r in rows.orderBy("x", "id").collect()]
    for n in {0, 1, total // 3, total}:
        for digits in ("even", "low"):
            assert sorted(r.id for r in smallest_share(rows, F.col(digits), n, total, ["id"]).collect()) == sorted(ordered[:n]), digits


def test_large_communities_are_paired_by_strips(spark, monkeypatch):
    monkeypatch.setattr(ed, "PAIR_STRIP", 4)
    a = spark.range(30).select(F.col("id").alias("node_id"), (F.col("id") % 2).alias("group_id"), F.when(F.col("id") < 25, 0).otherwise(1).alias("community"))
    got = [(r.src, r.dst) for r in ed.complete_communities(a).collect()]
    assert sorted(got) == [(s, d) for s in range(30) for d in range(30) if s != d and (s < 25) == (d < 25)]


def test_subgraph_errors(spark):
    nodes = spark.range(4).toDF("node_id")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    with pytest.raises(ValueError):
        metrics.extract_subgraph(nodes, edges, 9, 3)
    with pytest.raises(ValueError):
        metrics.extract_subgraph(nodes, edges, 0, 0)
    assert metrics.extract_subgraph(nodes, edges, 3, 3) is None
    assert metrics.extract_subgraph(nodes, edges, 0, 2)[1].collect() == [(0, 1)]


def test_ring_search_goes_to_the_nearest_communities_of_the_group(spark):
    """Against bisection in each group's sorted list, right and left in turn, within the window."""
    r = random.Random(3)
    theta = {c: r.random() for c in range(30)} | {30: 0.5, 31: 0.5}
    comp = sorted({(c, g) for c in theta for g in range(5) if r.random() < (0.1 if g == 4 else 0.6)})
    t = spark.createDataFrame(list(theta.items()), "community int, theta double")
    places = ed.ring_places(spark.createDataFrame(comp, "community int, group_id int"), t)
    asked = spark.createDataFrame([(c, g) for c in theta for g in range(5)], "community int, dst_group int")
    slots = ed.ring_starts(places, asked, t).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(9))))
    at = slots.withColumn("place", ed.ring_slot(F.col("slot"), F.col("center"), F.col("n")))
    found = {(x.community, x.dst_group, x.slot): x.there for x in at.join(places.select(F.col("group_id").alias("dst_group"), "place", F.col("community").alias("there")), ["dst_group", "place"]).collect()}
    want = {}
    for g in range(5):
        own = sorted((theta[c], c) for c, h in comp if h == g)
        n = len(own)
        for c in theta:
            center = bisect.bisect_left([x for x, _ in own], theta[c])
            order = [j % n for delta in range(min(ed.RING_WINDOW, n)) for j in (center + delta, center - delta - 1)]
            want |= {(c, g, k): own[order[k % len(order)]][1] for k in range(10)}
    assert found == want and all((there, g) in comp for (_, g, _), there in found.items())


def test_ring_candidates_fall_on_members(spark):
    """A group in few communities: every candidate of the ring is a member of it, near its source first."""
    people = [(k, k % 3 if k % 40 else 3, k % 25) for k in range(1000)]
    a = spark.createDataFrame(people, "node_id long, group_id int, community int")
    targets = spark.createDataFrame([(0, 3, 60), (1, 2, 500), (3, 0, 40)], "src_group int, dst_group int, target long")
    w = ed.world(a, targets)
    c = ed.propose(w, targets.select("src_group", "dst_group", F.col("target").alias("need")), "ring", 0).collect()
    group = {n: g for n, g, _ in people}
    assert all(group[x.src] == x.src_group and group[x.dst] == x.dst_group for x in c)
    assert Counter((x.src_group, x.dst_group) for x in c) == {(0, 3): 92, (1, 2): 752, (3, 0): 62}
    # Each source of a round is tried before any is tried again.
    assert max(Counter(x.src for x in c if x.src_group == 1).values()) == -(-752 // sum(g == 1 for g in group.values()))


def test_quota_ledger_is_the_sequential_rule(spark):
    r = random.Random(5)
    offers, want = [], {}
    for pair in range(40):
        need, shared = r.randint(1, 400), r.randint(1, 30)
        left = need
        for place in r.sample(range(shared), r.randint(1, shared)) if pair % 2 else range(shared):
            offers.append((pair, 0, need, shared, place, r.randint(1, 40)))
        for row in sorted(x for x in offers if x[0] == pair):
            quota = min(max(-(-left // shared), 1), left)
            want[pair, row[4]] = quota
            left -= min(quota, row[5])
    r.shuffle(offers)
    df = spark.createDataFrame(offers, "src_group int, dst_group int, need long, shared long, place long, offered long")
    assert {(x.src_group, x.place): x.quota for x in ed.quota_ledger(df).collect()} == want


@pytest.mark.parametrize("share", [1.0, 0.35])
def test_a_pass_keeps_every_quota(spark, share):
    """Communities of very different sizes: none takes more than its ceil(need / communities)."""
    people = [(k, k % 2, min(k % 37, k % 11)) for k in range(900)]
    targets = [(0, 1, 700), (1, 0, 3), (0, 0, 95)]
    w = ed.world(spark.createDataFrame(people, "node_id long, group_id int, community int"), spark.createDataFrame(targets, "src_group int, dst_group int, target long"))
    g = ed.begin(w, ed.no_edges(w))
    found = ed.propose(w, g.need, "community", 0, share=share)
    made = [(x.src, x.dst) for x in ed.accept_by_quota(found, g, share).collect()]
    home, group = {n: c for n, _, c in people}, {n: x for n, x, _ in people}
    assert len(made) == len(set(made)) and all(s != d and home[s] == home[d] for s, d in made)
    taken = Counter((group[s], group[d], home[s]) for s, d in made)
    for a, b, target in targets:
        n = sum({a, b} <= {group[k] for k in home if home[k] == c} for c in set(home.values()))
        quotas = [v for (x, y, _), v in taken.items() if (x, y) == (a, b)]
        assert 0 < sum(quotas) <= -(-target * share // 1) and max(quotas) <= max(-(-target * share // n), 1)


def test_strips_number_every_attempt_once(spark, monkeypatch):
    monkeypatch.setattr(ed, "STRIP", 7)
    need = spark.createDataFrame([(0, 1, 50), (1, 1, 7), (2, 0, 0), (2, 1, 1)], "src_group int, dst_group int, need long")
    got = Counter((x.src_group, x.dst_group) for x in ed._attempts(need, F.col("need"), 1, "s").select("src_group", "dst_group", "j").distinct().collect())
    assert got == {(0, 1): 50, (1, 1): 7, (2, 1): 1}


def test_weighted_draws_follow_their_weights(spark):
    weights = {("a", k): w for k, w in enumerate([1, 5000, 3, 0, 1000, 10, 4000])} | {("b", 0): 1}
    rows = spark.createDataFrame([(g, k, w) for (g, k), w in weights.items()], "g string, k int, w long")
    draws = spark.range(20_000).select(F.lit("a").alias("g"), ((F.col("id") + 0.5) / 20_000).alias("u"))
    draws = draws.union(spark.createDataFrame([("b", 0.0), ("b", 0.999999)], "g string, u double"))
    got = Counter((x.g, x.k) for x in drawn(draws, ranges(rows, ["g"], F.col("w"), "k"), ["g"], F.col("u")).collect())
    assert sum(got.values()) == 20_002 and got["b", 0] == 2 and got["a", 3] == 0
    assert all(abs(got["a", k] - 20_000 * w / 10_014) <= 1.5 for (g, k), w in weights.items() if g == "a")


def test_fill_counts_and_prefers_shared_communities(spark, tables):
    made = api.generate(*tables, number_of_communities=5, fill_unfulfilled=False)
    # Half of the edges go, so that there is something to fill, and one pair can't ever be.
    made.edges = made.edges.where("(src + dst) % 2 = 0")
    made.targets = made.targets.union(spark.createDataFrame([(2, 0, 40 * 60 + 7)], made.targets.schema))
    full = api.fill_unfulfilled_group_pairs(made, reciprocity=0.5)
    pairs = {(r.src_group, r.dst_group): r.target for r in made.targets.collect()}
    count = lambda e: Counter((r.src_group, r.dst_group) for r in e.collect())
    before, after = count(made.edges), count(full.edges)
    added = full.edges.where("phase = 'fill'")
    back = added.where("mechanism = 'reciprocal'")
    want = {
        "total_pairs": len(pairs),
        "fulfilled_pairs": sum(t > 0 and before[p] >= t for p, t in pairs.items()),
        "unfulfilled_pairs": sum(before[p] < t for p, t in pairs.items()),
        "edges_added": added.count() - back.where("src_group <> dst_group").count(),
        "reciprocal_edges_added": back.count(),
    }
    assert full.fill_statistics().first().asDict() == want and back.count() > 0
    assert all(after[p] == t for p, t in pairs.items() if p != (2, 0)) and 2300 < after[2, 0] <= 40 * 60
    assert full.edges.select("src", "dst").distinct().count() == full.edges.count() and full.edges.where("src = dst").count() == 0
    home = {r.node_id: r.community for r in made.nodes.collect()}
    small = added.where("src_group = 0 AND dst_group = 0 AND mechanism = 'primary'").collect()
    assert small and all(home[r.src] == home[r.dst] for r in small)


def test_segregated_communities_fill_evenly(spark):
    people = [("x", "p", 61), ("x", "q", 8), ("y", "p", 33), ("y", "q", 5), ("z", "p", 1)]
    g, nodes = api.people(spark.createDataFrame(people, "a string, b string, n long"))
    ids = {(r.a, r.b): r.group_id for r in g.collect()}
    t = spark.createDataFrame([(i, j, 50 if x[0] == y[0] else 1) for x, i in ids.items() for y, j in ids.items()], "src_group int, dst_group int, target long")
    a = com.assign_segregated(nodes, g, t, ["a"], 9).collect()
    block = {i: x[0] for x, i in ids.items()}
    sizes = Counter((block[r.group_id], r.community) for r in a)
    assert len(a) == 108 and len({c for _, c in sizes}) == len(sizes) == 9
    for b in "xyz":
        own = [n for (x, _), n in sizes.items() if x == b]
        assert max(own) - min(own) <= 1
