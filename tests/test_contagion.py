"""Seeds by permutation, contagion against a plain loop, and what is left in the shared folder."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from popweave.functions.rng import permuted
from popweave.operators import contagion


def graph(spark, n=60, m=150, seed=1):
    r = random.Random(seed)
    links = sorted({(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b})
    return spark.range(n).withColumnRenamed("id", "node_id"), spark.createDataFrame(links, "src long, dst long"), links


def looped(links, seeds, threshold, relative=True, directed=True):
    """{(config, node): step} by a loop over all nodes."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        if not directed:
            near[b].add(a)
    out = {}
    for config, own in seeds.items():
        at = {v: 0 for v in own}
        step = 0
        while True:
            step += 1
            new = [v for v in near if v not in at and (n := sum(x in at for x in near[v])) and n / (len(near[v]) if relative else 1) >= threshold(config, v)]
            if not new:
                break
            at |= dict.fromkeys(new, step)
        out |= {(config, v): s for v, s in at.items()}
    return out


def test_permutations_are_permutations(spark):
    for bits in (1, 2, 5):
        rows = spark.range(4**bits).select("id", F.lit(bits).alias("bits"), F.explode(F.array(F.lit(1), F.lit(2))).alias("key"))
        out = rows.select("key", "id", permuted(3, "s", F.col("id"), F.col("bits"), "key").alias("p")).collect()
        images = {k: [r.p for r in sorted(out, key=lambda r: r.id) if r.key == k] for k in (1, 2)}
        assert all(sorted(x) == list(range(4**bits)) for x in images.values()) and (bits == 1 or images[1] != images[2])


@pytest.mark.parametrize("n", [1, 2, 17, 60])
def test_seeds_are_different_nodes(spark, n):
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    configs = spark.createDataFrame([(c, c) for c in (0, 1, 2, 5, 40, 100)], "config long, initial int")
    seeds = contagion.seed_sized(configs, nodes).collect()
    assert len({(s["config"], s.node_id) for s in seeds}) == len(seeds)
    assert Counter(s["config"] for s in seeds) == Counter({c: min(c, n) for c in (1, 2, 5, 40, 100)})
    assert all(0 <= s.node_id < n for s in seeds)


def test_all_nodes_are_drawn_alike(spark):
    nodes = spark.range(20).withColumnRenamed("id", "node_id")
    seeds = contagion.seed_random(spark.range(2000).withColumnRenamed("id", "config"), nodes, 3).groupBy("node_id").count().collect()
    # 300 are expected for each; the standard deviation is 16.
    assert len(seeds) == 20 and all(220 < s["count"] < 380 for s in seeds)


def test_seeds_need_no_cross_join(spark):
    nodes, edges, _ = graph(spark)
    configs = spark.range(5).withColumnRenamed("id", "config")
    for seeds in (contagion.seed_random(configs, nodes, 4), contagion.seed_focals(configs, edges, nodes)):
        plan = seeds._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("relative", [True, False])
def test_thresholds_until_nothing_changes(spark, directed, relative):
    nodes, edges, links = graph(spark)
    configs = spark.createDataFrame([(c, t if relative else 10 * t) for c, t in enumerate((0.1, 0.2, 0.34))], "config long, threshold double")
    seeds = contagion.seed_random(configs, nodes, 4)
    of = defaultdict(set)
    for s in seeds.collect():
        of[s["config"]].add(s.node_id)
    level = {r["config"]: r.threshold for r in configs.collect()}
    out = contagion.threshold_contagion(edges, seeds, configs, relative, directed)
    assert {(r["config"], r.node_id): r.step for r in out.collect()} == looped(links, of, lambda c, _: level[c], relative, directed)


def test_thresholds_of_nodes_and_of_both(spark):
    nodes, edges, links = graph(spark, seed=2)
    seeds = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4)], "config long, node_id long")
    of = {0: {1, 2}, 1: {3, 4}}
    own = nodes.withColumn("threshold", F.when(F.col("node_id") % 3 == 0, 0.1).otherwise(0.3))
    rule = lambda c, v: 0.1 if v % 3 == 0 else 0.3
    found = lambda df: {(r["config"], r.node_id): r.step for r in df.collect()}
    assert found(contagion.threshold_contagion(edges, seeds, own)) == looped(links, of, rule)
    both = own.crossJoin(spark.createDataFrame([(0,), (1,)], "config long"))
    assert found(contagion.threshold_contagion(edges, seeds, both)) == looped(links, of, rule)
    levels = spark.createDataFrame([(0, 0.2), (1, 0.5)], "config long, part double")
    split = contagion.threshold_contagion(edges, seeds, levels, of_nodes=nodes.withColumn("even", F.col("node_id") % 2 == 0), level=F.when(F.col("even"), F.col("part")).otherwise(0.25))
    assert found(split) == looped(links, of, lambda c, v: (0.2, 0.5)[c] if v % 2 == 0 else 0.25)


def test_everyone_is_infected_in_time(spark):
    nodes, edges, _ = graph(spark, n=12, m=80)
    seeds = spark.createDataFrame([(0, 1)], "config long, node_id long")
    out = contagion.simple_contagion(edges, seeds, p_transmit=1.0, max_steps=6).collect()
    assert {r.node_id for r in out} == set(range(12)) and len(out) == 12
    assert contagion.simple_contagion(edges, seeds, p_transmit=0.0, max_steps=2).count() == 1


def test_only_the_last_state_is_left(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    nodes, edges, _ = graph(spark)
    seeds = contagion.seed_random(spark.range(2).withColumnRenamed("id", "config"), nodes, 4)
    out = contagion.threshold_contagion(edges, seeds, nodes.withColumn("threshold", F.lit(0.2)))
    left = set(os.listdir(root)) - before
    read = {part for frame in (seeds, out) for f in frame.inputFiles() for part in f.split("/") if part.startswith("popweave-")}
    assert left == read & left and len(left) <= 2


def test_configurations_are_bits_of_few_rows(spark):
    """More configurations than a row keeps, each as if it were alone; state and messages have a row for 62."""
    nodes, edges, links = graph(spark, seed=3)
    n = 2 * contagion.WORD + 6
    of = {c: {c % 20, (7 * c + 1) % 20} for c in range(5, 5 + 3 * n, 3)}
    seeds = spark.createDataFrame([(c, v) for c, vs in of.items() for v in vs], "config long, node_id long")
    levels = spark.createDataFrame([(c, 0.1 + 0.3 * (c % 4)) for c in of], "config long, threshold double")
    out = contagion.threshold_contagion(edges, seeds, levels)
    assert {(r["config"], r.node_id): r.step for r in out.collect()} == looped(links, of, lambda c, _: 0.1 + 0.3 * (c % 4))
    run = contagion.Spreading.begin(seeds, contagion.looked_at(edges), [])
    run.advance(run.told(), F.lit(False), 1)
    assert run.state.count() <= 3 * nodes.count()


def test_nodes_that_have_adopted_everywhere_are_taken_out(spark, monkeypatch):
    monkeypatch.setattr(contagion, "PRUNED", 1)
    pruned, prune = [], contagion.Spreading._prune

    def counted(run):
        before = run.state.count(), run.look.count()
        prune(run)
        pruned.append((before, (run.state.count(), run.look.count())))

    monkeypatch.setattr(contagion.Spreading, "_prune", counted)
    nodes, edges, links = graph(spark, seed=4)
    of = {c: {c, 10 + c} for c in range(3)}
    seeds = spark.createDataFrame([(c, v) for c, vs in of.items() for v in vs], "config long, node_id long")
    levels = spark.createDataFrame([(c, 0.01 + 0.1 * c) for c in of], "config long, threshold double")
    out = contagion.threshold_contagion(edges, seeds, levels)
    assert {(r["config"], r.node_id): r.step for r in out.collect()} == looped(links, of, lambda c, _: 0.01 + 0.1 * c)
    assert pruned and all(b[0] < a[0] and b[1] < a[1] for a, b in pruned)
