"""Models, samples, seeding and curves against small Python references."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from popweave.functions.rng import uniform, uniforms
from popweave.operators import communities as com
from popweave.operators import contagion, edges, metrics, models, outcomes, sampling, sensitivity
from popweave.sources import scratch, sinks, tables


def test_smallest_and_numbered_are_a_sort(spark):
    rows = spark.range(3000).select(F.col("id"), F.pmod("id", F.lit(3)).alias("g"), (F.floor(uniform(1, "x", "id") * 40) / 40).alias("u"))
    data = [(r.u, r.id, r.g) for r in rows.collect()]
    for n in (0, 1, 700, 3000, 5000):
        assert {r.id for r in sampling.smallest(rows, F.col("u"), n, ["id"]).collect()} == {i for _, i, _ in sorted(data)[:n]}
    got = {r.id: r.place for r in sampling.numbered(rows, ["g"], F.col("u"), ["id"], "place", 16).collect()}
    for g in range(3):
        assert [got[i] for _, i, k in sorted(data) if k == g] == list(range(sum(k == g for *_, k in data)))
    assert sampling.smallest(rows.limit(0), F.col("u"), 4, ["id"]).count() == 0


def test_numbered_keeps_null_groups(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, g string")
    assert sorted(r.place for r in sampling.numbered(rows, ["g"], uniform(1, "x", "id"), ["id"], "place").collect()) == [0, 0, 1]


def pairs(df):
    out = [(r.u, r.v) for r in df.collect()]
    assert len(out) == len(set(out)) and all(u < v for u, v in out)
    return set(out)


def test_edge_counts_are_met(spark):
    assert len(pairs(models.fixed_size_graph(spark, 50, 60))) == 60
    assert pairs(models.fixed_size_graph(spark, 6, 99)) == set(itertools.combinations(range(6), 2))
    ring = models.small_world(spark, 100, 4, 0.1)
    for m in (120, 400):
        fitted = pairs(models.fit_edge_count(ring, 100, m))
        assert len(fitted) == m and (m < 200 or pairs(ring) <= fitted)
    assert len(pairs(models.accept_reject_graph(spark, 80, 4, 200))) == 200


def test_gaps_are_those_of_the_twin_at_small_chances(spark):
    chances = [1.0, 0.3, 6.7e-6, 1e-9, 1e-15]
    rows = spark.createDataFrame([(i / 16, p) for p in chances for i in range(16)], "u double, p double")
    for r in rows.withColumn("gap", models.geometric(F.col("u"), F.col("p"))).collect():
        assert r.gap == (1 if r.p >= 1 else math.floor(math.log(1 - r.u) / math.log(1 - r.p)) + 1), r
    tiny = spark.createDataFrame([(0.5, 1e-18)], "u double, p double")
    assert tiny.select(models.geometric(F.col("u"), F.col("p")).alias("gap")).first().gap == pytest.approx(math.log(2) * 1e18, rel=1e-9)


def test_block_models_deal_strips_before_edges_are_made(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK", 50)
    nodes = spark.range(90).select(F.col("id").alias("node_id"), F.pmod("id", F.lit(3)).alias("block"))
    p = spark.createDataFrame([(i, j, 0.2) for i in range(3) for j in range(i, 3)], "i int, j int, p double")
    e = models.stochastic_blocks(nodes, p)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(sequence(1,") < plan.index("Exchange hashpartitioning(i#")
    assert "SortMergeJoin" not in plan
    both = models.symmetric(e)
    assert both._jdf.queryExecution().executedPlan().toString().count("explode(sequence(1,") == 1
    assert {(r.src, r.dst) for r in both.collect()} == {x for u, v in pairs(e) for x in ((u, v), (v, u))}


def test_gaps_of_a_strip_are_those_of_the_columns(spark):
    for before in ("42|gap|0|1|500000", "42|gap|" + "long" * 20):
        rows = spark.range(1, 10_834).select(uniform(42, "gap", F.lit(before.removeprefix("42|gap|")), "id").alias("u"))
        for p in (0.02, 1.0, 1e-15):
            want = [r.gap for r in rows.select(models.geometric(F.col("u"), F.lit(p)).alias("gap")).collect()]
            assert np.allclose(models.gaps(uniforms(before, 10_833), p), want, rtol=1e-12 if p < 1e-9 else 0, atol=0)


def test_block_models_neither_sort_nor_window_edges(spark):
    nodes = spark.range(900).select(F.col("id").alias("node_id"), F.pmod("id", F.lit(3)).alias("block"))
    p = spark.createDataFrame([(i, j, 0.2) for i in range(3) for j in range(i, 3)], "i int, j int, p double")
    e = models.stochastic_blocks(nodes, p)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
    directed = [tuple(r) for r in models.symmetric_blocks(nodes, p).collect()]
    assert len(directed) == len(set(directed)) and set(directed) == {x for u, v in pairs(e) for x in ((u, v), (v, u))}


def test_runs_of_strips_make_each_slot_once(spark, monkeypatch):
    nodes = spark.range(300).select(F.col("id").alias("node_id"), F.lit(0).alias("block"))
    p = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, p double")
    monkeypatch.setattr(models, "STRIP", 100.0)
    monkeypatch.setattr(models, "TASK", 1000)
    assert pairs(models.stochastic_blocks(nodes, p)) == set(itertools.combinations(range(300), 2))


def test_bootstrap_deals_resamples_before_they_are_drawn(spark, monkeypatch):
    runs = spark.range(90).select(F.pmod("id", F.lit(3)).alias("g"), F.floor(F.col("id") / 3).alias("i"), (F.col("id") * F.col("id") % 17).cast("double").alias("v"))
    monkeypatch.setattr(outcomes, "DRAWS", 100)
    make = lambda: outcomes.bootstrap_variance(runs, ["g"], "i", "v", 20)
    sent = make()
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode([0,1,2,3])") < plan.index("REPARTITION_BY_NUM") and "SortMergeJoin" not in plan
    monkeypatch.setattr(outcomes, "MOST_SENT", 0)
    found, joined = ({r.g: (r.low, r.high) for r in x.collect()} for x in (sent, make()))
    assert set(found) == {0, 1, 2} and all(found[g] == pytest.approx(joined[g]) for g in found)


def test_homophily_graph_meets_its_quotas(spark):
    nodes = spark.range(60).select(F.col("id").alias("node_id"), F.floor(F.col("id") / 20).alias("block"))
    e = pairs(models.homophily_graph(nodes, 300, 0.8))
    assert len(e) == 300 and sum(u // 20 == v // 20 for u, v in e) == 240
    # Two blocks of three have six inner pairs; random pairs fill what is left.
    few = spark.range(6).select(F.col("id").alias("node_id"), F.floor(F.col("id") / 3).alias("block"))
    assert pairs(models.homophily_graph(few, 15, 0.9)) == set(itertools.combinations(range(6), 2))


def test_core_and_periphery(spark):
    e = pairs(models.core_periphery(spark, 40))
    rim = Counter(v for u, v in e if u < 8 <= v)
    assert set(rim.values()) <= {2, 3} and set(rim) == set(range(8, 40))


def test_hybrid_thresholds_count_exactly(spark):
    t = contagion.thresholds_hybrid(spark.range(37).toDF("node_id"), 2, 1, 0.3)
    assert Counter(r.threshold for r in t.collect()) == {1.0: 11, 2.0: 26}


def reference_curve(x, y, target):
    above = [v >= target for v in y]
    critical = None
    if any(above) and not all(above):
        i = max(k for k, a in enumerate(above) if a) if y[0] > y[-1] else max(above.index(True) - 1, 0)
        if i >= len(x) - 1:
            critical = x[-1]
        elif abs(y[i + 1] - y[i]) < 1e-10:
            critical = (x[i] + x[i + 1]) / 2
        else:
            critical = x[i] + (target - y[i]) * (x[i + 1] - x[i]) / (y[i + 1] - y[i])
    return critical, np.trapezoid(y, x), np.abs(np.gradient(y, x)).max()


def test_curves_follow_the_published_rule(spark):
    r = random.Random(3)
    curves = {"up": [0.0, 0.2, 0.7, 0.4, 0.9], "down": [0.9, 0.4, 0.6, 0.1, 0.0], "low": [0.1] * 5, "high": [0.8] * 5, "flat": [0.5, 0.5, 0.2, 0.2, 0.2], "first": [0.6, 0.1, 0.2, 0.3, 0.7]}
    curves |= {f"r{i}": [r.random() for _ in range(5)] for i in range(20)}
    x = [0.0, 0.1, 0.4, 0.5, 1.0]
    rows = [(n, a, b) for n, y in curves.items() for a, b in zip(x, y, strict=True)]
    out = {c.name: c for c in contagion.curve_summary(spark.createDataFrame(rows, "name string, p double, share double"), ["name"], "p", "share").collect()}
    for name, y in curves.items():
        want = reference_curve(x, y, 0.5)
        assert (out[name].critical is None) == (want[0] is None)
        assert (out[name].critical or 0, out[name].auc, out[name].steepness) == pytest.approx((want[0] or 0, *want[1:]))


def test_differences_leave_the_ends_out(spark):
    x, y = [0.0, 1.0, 3.0, 4.0], [1.0, 2.0, 8.0, 9.0]
    s = spark.createDataFrame([("a", *p) for p in zip(x, y, strict=True)], "c string, x double, y double")
    got = sorted((r.x, r.slope, r.elasticity) for r in sensitivity.finite_differences(s, ["c"], "x", "y").collect())
    assert got == [(1.0, pytest.approx(7 / 3), pytest.approx(3 / 8 * 7 / 3)), (3.0, pytest.approx(7 / 3), pytest.approx(3 / 8 * 7 / 3))]
    ahead = sorted((r.x, r.slope) for r in sensitivity.finite_differences(s, ["c"], "x", "y", "forward", 0).collect())
    assert ahead == [(1.0, 3.0), (3.0, 1.0)]
    with pytest.raises(ValueError):
        sensitivity.finite_differences(s, ["c"], "x", "y", "sideways")


def test_one_at_a_time(spark):
    rows = sensitivity.one_at_a_time(spark, {"a": 1.0, "b": 2.0}, {"a": [0.0, 3.0], "b": [5.0]}).collect()
    assert [(r.param, r.setting, r.a, r.b) for r in rows] == [("a", 0.0, 0.0, 2.0), ("a", 3.0, 3.0, 2.0), ("b", 5.0, 1.0, 5.0)]


def test_ward_merges(spark):
    profiles = {"a": [0, 0], "b": [0, 1], "c": [10, 10], "d": [10, 13], "e": [40, 0]}
    rows = [(n, i, float(v)) for n, p in profiles.items() for i, v in enumerate(p)]
    got = [(r.left, r.right, r.distance, r["size"]) for r in outcomes.ward_linkage(spark.createDataFrame(rows, "n string, i int, y double"), ["i"], "n", "y").orderBy("step").collect()]
    clusters = {i: [np.array(p, float)] for i, p in enumerate(profiles.values())}
    want = []
    while len(clusters) > 1:
        gap = lambda x, y: math.sqrt(2 * len(x) * len(y) / (len(x) + len(y))) * np.linalg.norm(np.mean(x, 0) - np.mean(y, 0))
        d, i, j = min((gap(clusters[i], clusters[j]), i, j) for i in clusters for j in clusters if i < j)
        both = clusters.pop(i) + clusters.pop(j)
        clusters[len(profiles) + len(want)] = both
        want.append((i, j, pytest.approx(d), len(both)))
    assert got == want


def test_fewer_candidates_than_seeds_fall_back(spark):
    nodes = spark.range(20).toDF("node_id")
    few = nodes.where("node_id < 3")
    configs = spark.createDataFrame([(0,)], "config long")
    assert contagion.seed_from(configs, few, nodes, 5).count() == 5
    assert {r.node_id for r in contagion.seed_from(configs, few, nodes, 2).collect()} < {0, 1, 2}


def test_average_clustering(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    n = spark.range(5).toDF("node_id")
    assert metrics.average_clustering(n, e).first()[0] == pytest.approx((1 + 1 + 1 / 3) / 5)
    assert metrics.average_clustering(n, e, skip_small=True).first()[0] == pytest.approx((1 + 1 + 1 / 3) / 3)


def test_refinement_may_open_a_community(spark):
    # Two groups of ten that want no links within or across: everyone apart is best.
    a = spark.range(20).select(F.col("id").alias("node_id"), F.pmod("id", F.lit(2)).cast("int").alias("group_id"), F.lit(0).alias("community"))
    a = a.withColumn("community", F.when(F.col("node_id") == 19, 1).otherwise(0))
    t = spark.createDataFrame([(0, 1, 1)], "src_group int, dst_group int, target long")
    b = com.refine(a, t, moves=4000)
    assert b.select("community").distinct().count() > 2 and b.count() == 20


def test_households_follow_their_targets():
    people = np.array([300, 200, 100])
    t = np.array([[200.0, 400.0, 0.0], [400.0, 0.0, 100.0], [0.0, 100.0, 60.0]])
    comp = com.households(t, people)
    assert (comp.sum(0) == people).all() and (comp >= 0).all()

    # Groups without a target for each other meet less often, beside those with one, than by chance.
    rng = np.random.default_rng(1)
    apart = np.stack([rng.multinomial(n, np.full(len(comp), 1 / len(comp))) for n in people], 1)
    made, chance = comp.T @ comp, apart.T @ apart
    assert made[0, 2] / made[0, 1] < 0.95 * chance[0, 2] / chance[0, 1] and made[0, 1] > chance[0, 1]
    assert (com.households(t, people) == comp).all() and len(com.households(t, people, k=40)) == 40


def test_people_are_dealt_as_counts_say(spark):
    nodes = spark.range(50).select(F.col("id").alias("node_id"), F.pmod("id", F.lit(2)).cast("int").alias("group_id"))
    counts = spark.createDataFrame([(0, 0, 10), (1, 0, 5), (3, 0, 10), (1, 1, 24)], "community int, group_id int, n long")
    out = com.assign_counts(nodes, counts)
    assert {(r.community, r.group_id): r["n"] for r in com.composition(out).collect()} == {(0, 0): 10, (1, 0): 5, (3, 0): 10, (1, 1): 24}
    assert out.select("node_id").distinct().count() == 49
    t = spark.createDataFrame([(0, 1, 40), (1, 0, 40)], "src_group int, dst_group int, target long")
    homes = com.assign_households(nodes, t)
    assert homes.select("node_id").distinct().count() == homes.count() == 50
    assert com.assign_households(nodes, t, 7).agg(F.max("community")).first()[0] <= 6


def test_community_file_with_places(spark, tmp_path):
    import json

    (tmp_path / "c.json").write_text(json.dumps({"nodes_to_communities": {"0": 1, "1": 0, "99": 1}, "community_coordinates": {"0": 0.25, "1": 0.5}}))
    nodes = spark.createDataFrame([(0, 3), (1, 3), (2, 4)], "node_id long, group_id int")
    a, groups, places = tables.read_communities(spark, str(tmp_path / "c.json"), nodes)
    assert {(r.node_id, r.community) for r in a.collect()} == {(0, 1), (1, 0)}
    assert {tuple(r) for r in groups.collect()} == {(1, 3), (0, 3)} and {tuple(r) for r in places.collect()} == {(0, 0.25), (1, 0.5)}
    (tmp_path / "d.json").write_text(json.dumps({"nodes_to_communities": {"0": 1}}))
    assert tables.read_communities(spark, str(tmp_path / "d.json"), nodes)[2].count() == 0


def test_global_popularity(spark):
    a = spark.range(60).select(F.col("id").alias("node_id"), F.lit(0).alias("group_id"), F.pmod("id", F.lit(3)).cast("int").alias("community"))
    w = edges.world(a, spark.createDataFrame([(0, 0, 30)], "src_group int, dst_group int, target long"))
    e = spark.range(59).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0).alias("dst_group"))
    local, everywhere = (edges.popularity(w, e, 0.4, s).collect() for s in ("local", "global"))
    assert all(r.there == r.dst % 3 for r in local) and any(r.there != r.dst % 3 for r in everywhere)
    for rows in (local, everywhere):
        for there in range(3):
            assert sorted(r.p for r in rows if r.there == there) == list(range(sum(r.there == there for r in rows)))
    with pytest.raises(ValueError):
        edges.popularity(w, e, 0.4, "nowhere")


def test_scratch_folder_is_needed_on_a_cluster(spark):
    class Context:
        master = "yarn"

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        sparkContext = Context()

    with pytest.raises(RuntimeError):
        scratch.shared_root(Session())


def test_writers(spark, tmp_path):
    codes = spark.createDataFrame([("g", 0, "x"), ("h", 0, "y")], "attribute string, code int, value string")
    sinks.write_encodings(codes, f"{tmp_path}/codes")
    assert spark.read.option("header", True).csv(f"{tmp_path}/codes/attribute=g").collect()[0].value == "x"
    sinks.write_combinations(spark.createDataFrame([("g", 1), ("g_h", 2)], "combo string, n int"), f"{tmp_path}/combos")
    assert spark.read.parquet(f"{tmp_path}/combos/combo=g_h").first().n == 2
    spark.createDataFrame([("a", '"1,2"'), ("a", '"7"'), ("b", "")], "network string, final_values string").coalesce(1).write.option("header", True).csv(f"{tmp_path}/runs")
    got = {(r.network, tuple(r.runs or []), r.network_size_est) for r in tables.read_runs(spark, f"{tmp_path}/runs").collect()}
    assert ("a", (7,), 7) in got and ("a", (1, 2), 7) in got


def test_community_files(spark, tmp_path):
    from popweave.plans import api

    pop = spark.createDataFrame([("a", 20), ("b", 20)], "g string, n long")
    links = spark.createDataFrame([("a", "b", 30)], "g_src string, g_dst string, n long")
    nodes = api.people(pop)[1]
    a = com.assign_natural(nodes, 2)
    for name, as_json in (("c", False), ("c.json", True)):
        sinks.write_assignment(a, f"{tmp_path}/{name}", as_json)
        n = api.generate(pop, links, assignment=f"{tmp_path}/{name}", base_path=f"{tmp_path}/out", pa_scope="global", preferential_attachment=0.5)
        assert n.edges.count() >= 28
        assert api.read_network(spark, f"{tmp_path}/out").edges.count() == n.edges.count()
