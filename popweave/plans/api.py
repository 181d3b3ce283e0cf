"""Public API: communities and graphs from aggregate tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.operators import communities as com
from popweave.operators import edges as ed
from popweave.operators import population, targets
from popweave.sources import tables
from popweave.sources.scratch import scoped, stored


@dataclass
class Network:
    """A generated graph as tables."""

    nodes: DataFrame  # node_id, group_id, community, characteristics
    edges: DataFrame  # src, dst, src_group, dst_group, mechanism, phase, round
    groups: DataFrame  # group_id, characteristics, n, n_scaled
    targets: DataFrame  # src_group, dst_group, target

    def check_group_interactions(self) -> DataFrame:
        return targets.check_group_interactions(self.edges, self.nodes, self.targets)

    def fill_statistics(self) -> DataFrame:
        return ed.fill_statistics(self.targets, self.edges)

    def write(self, path: str) -> None:
        """Parquet folders nodes, edges, groups and targets, and metadata (JSON) under ``path``."""
        for name in ("nodes", "edges", "groups", "targets"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.nodes.sparkSession
        facts = {"nodes": self.nodes.count(), "edges": self.edges.count(), "directed": True}
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_network(spark, path: str) -> Network:
    n = Network(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "groups", "targets")))
    facts = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if facts["nodes"] != n.nodes.count():
        raise ValueError(f"{path}: {n.nodes.count()} nodes, but its metadata says {facts['nodes']}")
    return n


def people(pops: DataFrame, scale: float = 1.0, pop_column: str = "n") -> tuple[DataFrame, DataFrame]:
    """(groups with n_scaled, nodes) of a population table."""
    g = stored(population.allocate_groups(population.groups(pops, pop_column), scale), "groups")
    return g, stored(population.expand_nodes(g), "nodes")


def group_targets(links: DataFrame, groups: DataFrame, names: list[str], scale: float, src_suffix: str = "_src", dst_suffix: str = "_dst", link_column: str = "n") -> DataFrame:
    known = population.lookup(groups, names)
    pairs = targets.pair_counts(targets.with_group_ids(links, known, names, src_suffix, dst_suffix), link_column)
    return stored(targets.link_targets(pairs, scale).select("src_group", "dst_group", "target"), "targets")


def create_communities(
    nodes: DataFrame,
    groups: DataFrame,
    link_targets: DataFrame,
    names: list[str],
    number_of_communities: int,
    community_size_distribution: str | list[float] = "natural",
    mode: str = "capacity",
    refine_moves: int = 300_000,
    seed: int = 42,
) -> DataFrame:
    """(node_id, group_id, community). Modes: "capacity" (people dealt out evenly
    or by size), "segregation" (blocks of isolated characteristics) and
    "household" (co-members that match the targets; their number follows from the
    targets if ``number_of_communities`` is 0)."""
    if mode == "household":
        return stored(com.assign_households(nodes, link_targets, number_of_communities or None, seed), "assignment")
    if mode == "segregation":
        a = com.assign_segregated(nodes, groups, link_targets, names, number_of_communities, seed=seed)
    else:
        sizes = com.community_sizes(nodes.sparkSession, number_of_communities, community_size_distribution, nodes.count(), seed)
        a = com.assign_natural(nodes, number_of_communities, seed) if sizes is None else com.assign_weighted(nodes, sizes, seed)
    a = stored(a, "assignment")
    if refine_moves and number_of_communities > 1:
        a = stored(com.refine(a, link_targets, refine_moves, 1.0 if mode == "segregation" else 10.0, seed), "assignment")
    return a


def community_file(nodes: DataFrame, path: str) -> DataFrame:
    """(node_id, group_id, community) of the nodes that a community file names."""
    spark = nodes.sparkSession
    a = tables.read_assignment(spark, path) if path.rstrip("/").endswith(".json") else spark.read.parquet(path).select("node_id", "community")
    return nodes.select("node_id", "group_id").join(a, "node_id")


@scoped
def generate(
    pops: DataFrame,
    links: DataFrame,
    preferential_attachment: float = 0.0,
    scale: float = 1.0,
    reciprocity: float = 0.0,
    transitivity: float = 0.0,
    number_of_communities: int = 1,
    assignment: DataFrame | str | None = None,
    pop_column: str = "n",
    src_suffix: str = "_src",
    dst_suffix: str = "_dst",
    link_column: str = "n",
    fill_unfulfilled: bool = True,
    fully_connect_communities: bool = False,
    bridge_probability: float = 0.0,
    pre_seed_edges: DataFrame | None = None,
    internal_transitivity: float | None = None,
    external_transitivity: float | None = None,
    refine_moves: int = 0,
    pa_scope: str = "local",
    base_path: str | None = None,
    seed: int = 42,
    given: DataFrame | None = None,
) -> Network:
    """A directed graph whose group-pair counts meet scaled link targets.

    Pass ``assignment`` (node_id, group_id, community) for communities made
    before, the path of a community file (Parquet, or JSON if it ends so, as
    ``sinks.write_assignment`` makes both; people whom it leaves out are left
    out), or a number to deal people out. ``pa_scope`` says whether popularity
    stays in a community. With ``base_path`` the graph is written there. ``given`` has edges
    of another layer of the same people (different ones, with their groups), which are taken over
    without being copied. Same arguments and seed, same graph.
    """
    g, nodes = people(pops, scale, pop_column)
    names = population.characteristics(pops, pop_column)
    t = group_targets(links, g, names, scale, src_suffix, dst_suffix, link_column)
    if isinstance(assignment, str):
        assignment = community_file(nodes, assignment)
    a = assignment if assignment is not None else create_communities(nodes, g, t, names, number_of_communities, refine_moves=refine_moves, seed=seed)
    w = ed.world(a, t, seed)
    start = ed.no_edges(w) if given is None else ed.given(given)
    if pre_seed_edges is not None:
        start = start.unionByName(ed.pre_seeded(w, pre_seed_edges))
    if fully_connect_communities:
        full = ed.pre_seeded(w, ed.complete_communities(a)).join(start.select("src", "dst"), ["src", "dst"], "left_anti")
        start = start.unionByName(full.withColumn("phase", F.lit("complete")))
    closure = (transitivity if internal_transitivity is None else internal_transitivity, transitivity if external_transitivity is None else external_transitivity)
    schedule = [("A", "community", 3)] + ([("B", "ring", 3)] if w.communities > 1 else [])
    if fill_unfulfilled:
        schedule += ed.FILL
    only_given = given is not None and pre_seed_edges is None and not fully_connect_communities
    edges = ed.grow(w, start if only_given else stored(start, "edges"), schedule, preferential_attachment, reciprocity, closure, bridge_probability, pa_scope)
    made = Network(nodes.join(a.select("node_id", "community"), "node_id"), edges, g, t)
    if base_path is not None:
        made.write(base_path)
    return made


@scoped
def fill_unfulfilled_group_pairs(net: Network, reciprocity: float = 0.0, seed: int = 42) -> Network:
    """The graph with pairs of groups under their target filled: from communities that both groups
    share, by their pairs of people, then from the whole groups. See ``fill_statistics`` of the result,
    whose edges of this phase are new (edges that the graph had are of the phase "before")."""
    w = ed.world(net.nodes, net.targets, seed)
    before = net.edges.select(*ed.EDGE).withColumn("phase", F.when(F.col("phase") == "fill", "before").otherwise(F.col("phase")))
    edges = ed.grow(w, stored(before, "edges"), list(ed.FILL), 0.0, reciprocity, (0.0, 0.0), 0.0)
    return Network(net.nodes, edges, net.groups, net.targets)


@scoped
def generate_multiplex(pops: DataFrame, layers: dict[str, DataFrame], households: int, larger: int, scale: float = 1.0, kept_share: float = 0.3, seed: int = 42, **options) -> dict[str, Network]:
    """Layers that build on each other, in the order of ``layers``.

    The first has every pair of a household; the second keeps a sample of its
    edges and lives in larger communities made of whole households; the third
    keeps all edges of the second; the others stand alone in these communities.
    """
    g, nodes = people(pops, scale)
    names = population.characteristics(pops)
    small = stored(com.assign_natural(nodes, households, seed), "households")
    large = stored(com.merge_communities(small, larger), "communities")
    out: dict[str, Network] = {}
    for i, (name, links) in enumerate(layers.items()):
        before = list(out.values())[-1].edges if out else None
        if i == 0:
            t = group_targets(links, g, names, scale)
            # Pairs follow from the households; they are made where they are read, and not stored.
            edges = ed.given(ed.complete_communities(small, groups=True))
            out[name] = Network(nodes.join(small.select("node_id", "community"), "node_id"), edges, g, t)
            continue
        given = ed.sample_edges(before, kept_share, seed, ("src_group", "dst_group")) if i == 1 else before if i == 2 else None
        out[name] = generate(pops, links, scale=scale, assignment=large, given=given, seed=seed + i, **options)
    return out


def multiplex_overlap(layers: dict[str, Network]) -> DataFrame:
    """(a, b, n_common): edges that each pair of layers of :func:`generate_multiplex` shares."""
    home, *later = layers
    return ed.nested_overlap(home, layers[home].nodes, {name: layers[name].edges for name in later})
