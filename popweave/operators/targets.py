"""Interaction tables to link targets, and how well a graph meets them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popweave.operators.population import stratified_allocate


def _same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, (p.eqNullSafe(q) for p, q in zip(a, b, strict=True)))


def with_group_ids(links: DataFrame, lookup: DataFrame, names: Sequence[str], src: str = "_src", dst: str = "_dst") -> DataFrame:
    """Adds src_group and dst_group; rows with an unknown side go. Nulls match
    nulls, and attributes are compared in the population's types."""
    out = links
    for suffix, side in ((src, "src_group"), (dst, "dst_group")):
        g = lookup.select(*(F.col(c).alias(f"_{c}") for c in names), F.col("group_id").alias(side))
        types = dict(lookup.dtypes)
        out = out.join(g, _same([out[c + suffix].cast(types[c]) for c in names], [g[f"_{c}"] for c in names])).drop(*(f"_{c}" for c in names))
    return out


def pair_counts(links: DataFrame, count: str = "n") -> DataFrame:
    """n of each (src_group, dst_group); a pair may come in several rows."""
    return links.groupBy("src_group", "dst_group").agg(F.sum(F.col(count).cast("double")).alias("n"))


def link_targets(pairs: DataFrame, scale: float) -> DataFrame:
    """Adds target: pairs scaled by the stratified rule, ties by group ids."""
    return stratified_allocate(pairs, scale, "n", ["src_group", "dst_group"], "target")


def affinity(pairs: DataFrame, count: str = "target", epsilon: float = 1e-5) -> DataFrame:
    """(src_group, dst_group, p): each row's share of its source group's links."""
    total = F.sum(count).over(Window.partitionBy("src_group")) + F.lit(epsilon)
    return pairs.select("src_group", "dst_group", (F.col(count) / total).alias("p"))


def pair_achieved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """actual edges of each (src_group, dst_group). Only (node, group) rows are joined on."""
    side = lambda end, name: nodes.select(F.col("node_id").alias(end), F.col("group_id").alias(name))
    e = edges.select("src", "dst").join(side("src", "src_group"), "src").join(side("dst", "dst_group"), "dst")
    return e.groupBy("src_group", "dst_group").agg(F.count("*").alias("actual"))


def check_group_interactions(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """actual, target, diff and ratio (infinite without a target) of every pair that has either."""
    actual = pair_achieved(edges, nodes)
    both = actual.join(targets.select("src_group", "dst_group", "target"), ["src_group", "dst_group"], "full_outer")
    a, t = F.coalesce("actual", F.lit(0)), F.coalesce("target", F.lit(0))
    ratio = F.when(t > 0, a / t).when(a > 0, F.lit(float("inf"))).otherwise(0.0)
    return both.select("src_group", "dst_group", a.alias("actual"), t.alias("target"), (a - t).alias("diff"), ratio.alias("ratio"))


def fulfilment(checked: DataFrame) -> DataFrame:
    """One row: requested, created, rate, pairs over and under their target."""
    requested, created = F.sum("target"), F.sum("actual")
    return checked.agg(
        requested.alias("requested"),
        created.alias("created"),
        F.when(requested > 0, created / requested).otherwise(1.0).alias("rate"),
        F.count_if(F.col("diff") > 0).alias("pairs_over"),
        F.count_if(F.col("diff") < 0).alias("pairs_under"),
    )
