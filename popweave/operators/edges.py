"""Edges that meet link targets, by rounds of proposals and acceptance.

A round proposes about one and a half edges for each missing one, and accepts
in one set operation: no loops, no repeats, never over a pair's target. Edges are
parts that are written once; what a pair still needs is a small table that new
parts are taken off from, round by round. Picks go by counter-based numbers to
the k-th member of a group, an equi-join, never a sort, and ranks within a group
or a pair of groups are taken in buckets of their numbers.

Within a round reciprocal and closing edges see the graph of the rounds before
and follow accepted edges only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popweave.functions.rng import digits, pick, uniform
from popweave.operators.communities import coordinates
from popweave.operators.sampling import drawn, numbered, ranges, smallest_share
from popweave.sources.scratch import scoped, stored

EDGE = ("src", "dst", "src_group", "dst_group", "mechanism", "phase", "round")


@dataclass
class World:
    """People by community and group, numbered in random order, and the targets."""

    members: DataFrame  # node_id, group_id, community, idx (in community and group), gidx (in group)
    comp: DataFrame  # community, group_id, k
    sizes: DataFrame  # group_id, k
    targets: DataFrame  # src_group, dst_group, target
    shared: DataFrame  # src_group, dst_group, turn, shared, community, ks: communities of both groups, numbered
    communities: int
    seed: int
    theta: DataFrame  # community, theta: places on the ring


#: Communities on each side of a source that the ring search goes through.
RING_WINDOW = 200


def world(assignment: DataFrame, targets: DataFrame, seed: int = 42, theta: DataFrame | None = None) -> World:
    """``theta`` has each community's place on the ring, :func:`communities.coordinates` if not given."""
    u = uniform(seed, "order", "node_id")
    m = numbered(assignment.select("node_id", "group_id", "community"), ["community", "group_id"], u, ["node_id"], "idx")
    m = stored(numbered(m, ["group_id"], u, ["node_id"], "gidx"), "members")
    comp = stored(m.groupBy("community", "group_id").agg(F.count("*").alias("k")), "comp")
    sizes = stored(comp.groupBy("group_id").agg(F.sum("k").alias("k")), "sizes")
    t = stored(targets.select("src_group", "dst_group", "target"), "targets")
    src = comp.select("community", F.col("group_id").alias("src_group"), F.col("k").alias("ks"))
    dst = comp.select("community", F.col("group_id").alias("dst_group"))
    both = t.where("target > 0").select("src_group", "dst_group").join(src, "src_group").join(dst, ["community", "dst_group"])
    by = Window.partitionBy("src_group", "dst_group")
    turn = F.row_number().over(by.orderBy(uniform(seed, "turn", "src_group", "dst_group", "community"), "community")) - 1
    shared = stored(both.withColumns({"turn": turn.cast("long"), "shared": F.count("*").over(by)}), "shared")
    k = (comp.agg(F.max("community")).first()[0] or 0) + 1
    return World(m, comp, sizes, t, shared, k, seed, coordinates(assignment, seed) if theta is None else theta)


@dataclass
class Grown:
    """Edges so far, in parts, and (src_group, dst_group, need) of pairs under their target."""

    parts: list[DataFrame]
    need: DataFrame

    @property
    def edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def add(self, part: DataFrame) -> None:
        """Takes a stored part in; the need is settled by :meth:`settle`."""
        self.parts.append(part)
        have = part.groupBy("src_group", "dst_group").agg(F.count("*").alias("have"))
        left = self.need.join(have, ["src_group", "dst_group"], "left").withColumn("need", F.col("need") - F.coalesce("have", F.lit(0)))
        self.need = left.where("need > 0").select("src_group", "dst_group", "need")

    def settle(self) -> None:
        self.need = stored(self.need, "need")
        if len(self.parts) > 8:
            # The edges that were there before stay as they are: they can be most of all.
            self.parts = [self.parts[0], stored(reduce(DataFrame.unionByName, self.parts[1:]), "edges")]


def begin(w: World, edges: DataFrame) -> Grown:
    g = Grown([], w.targets.where("target > 0").select("src_group", "dst_group", F.col("target").alias("need")))
    g.add(edges)
    g.settle()
    return g


def _fresh(candidates: DataFrame, grown: Grown, *also: str) -> DataFrame:
    """Of the candidates (an edge with u and mechanism, and the columns ``also``) those that
    are no loop, new, and of a pair with a need; each edge once, with the need."""
    c = candidates.where("src <> dst").join(grown.need, ["src_group", "dst_group"])
    best = F.min(F.struct("u", "src_group", "dst_group", "need", "mechanism", *also))
    c = stored(c.groupBy("src", "dst").agg(best.alias("b")).select("src", "dst", "b.*"), "candidates")
    # Edges look for candidates, which are few, and only those found are taken off.
    known = grown.edges.select("src", "dst").join(c.select("src", "dst"), ["src", "dst"], "left_semi")
    return c.join(known, ["src", "dst"], "left_anti")


def accept(candidates: DataFrame, grown: Grown, share: float = 1.0) -> DataFrame:
    """Of the candidates those that may join: new, no loop, and within ``share`` of the pair's need (rounded up)."""
    ranked = numbered(_fresh(candidates, grown), ["src_group", "dst_group"], F.col("u"), ["src", "dst"], "r", 256)
    return ranked.where(F.col("r") < F.ceil(F.col("need") * share)).select(*CANDIDATE)


def quota(left: int, shared: int, share: float) -> int:
    """What one of ``shared`` communities may take of what is left, at least one edge."""
    return max(-int(-left * share // shared), 1)


def quota_ledger(offers: DataFrame, share: float = 1.0) -> DataFrame:
    """(src_group, dst_group, place, quota) of a pass, from (src_group, dst_group, need, shared,
    place, offered): how many edges each community offers to a pair of groups.

    Communities come in the order of their places. One may take ceil(share * left / shared),
    ``shared`` being the pair's communities and ``left`` what the pair needs after those before it,
    until the pass has ceil(share * need); what they couldn't take raises the quotas of those
    after them. The order is inherent, so a
    pair's ledger is one task's: a row for each community of the pair, never for each edge.
    """

    def settle(rows):
        rows = rows.sort_values("place")
        left, shared = int(rows["need"].iloc[0]), int(rows["shared"].iloc[0])
        budget = -int(-left * share // 1)
        quotas = []
        for offered in rows["offered"].tolist():
            quotas.append(min(quota(left, shared, share), budget))
            taken = min(quotas[-1], offered)
            left, budget = left - taken, budget - taken
        return rows[["src_group", "dst_group", "place"]].assign(quota=quotas)

    types = dict(offers.select("src_group", "dst_group").dtypes)
    schema = f"src_group {types['src_group']}, dst_group {types['dst_group']}, place long, quota long"
    columns = offers.select("src_group", "dst_group", "need", "shared", F.col("place").cast("long").alias("place"), "offered")
    return columns.groupBy("src_group", "dst_group").applyInPandas(settle, schema)


def accept_by_quota(candidates: DataFrame, grown: Grown, share: float = 1.0) -> DataFrame:
    """Like :func:`accept` for candidates with (place, shared) of their community: none
    exceeds its quota of the pass."""
    c = stored(_fresh(candidates, grown, "place", "shared"), "fresh")
    offers = c.groupBy("src_group", "dst_group", "place").agg(F.first("need").alias("need"), F.first("shared").alias("shared"), F.count("*").alias("offered"))
    ledger = quota_ledger(offers, share)
    ranked = numbered(c, ["src_group", "dst_group", "place"], F.col("u"), ["src", "dst"], "r", 16)
    return ranked.join(ledger, ["src_group", "dst_group", "place"]).where("r < quota").select(*CANDIDATE)


#: Columns of a candidate.
CANDIDATE = ("src", "dst", "src_group", "dst_group", "u", "mechanism")

#: Attempts that one row of a strip makes.
STRIP = 16_384


def _attempts(rows: DataFrame, n: Column, seed: int, stream: str, *also: str) -> DataFrame:
    """``n`` rows for each pair of groups (and of ``also``), numbered by j from 1, with their random
    numbers. Strips are dealt to all tasks, so no task makes all attempts of a pair."""
    key = ["src_group", "dst_group", *also, "j"]
    strips = rows.withColumn("_n", n.cast("long")).where("_n > 0")
    strips = strips.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / STRIP))))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strips = strips.repartition(tasks, "src_group", "dst_group", *also, "_s")
    first, last = F.col("_s") * STRIP + 1, F.least((F.col("_s") + 1) * STRIP, F.col("_n"))
    a = strips.withColumn("j", F.explode(F.sequence(first, last))).drop("_n", "_s")
    return a.withColumns({x: uniform(seed, f"{stream}/{x}", *key) for x in ("us", "ud", "ub", "u")})


def _member(rows: DataFrame, w: World, node: str, group: str, index: str, community: str | None = None) -> DataFrame:
    """Joins the member that ``index`` numbers within a group (and community)."""
    name = {"node_id": node, "group_id": group, ("idx" if community else "gidx"): index} | ({"community": community} if community else {})
    m = w.members.select(*(F.col(a).alias(b) for a, b in name.items()))
    return rows.join(m, [x for x in name.values() if x != node])


def ring_places(comp: DataFrame, theta: DataFrame) -> DataFrame:
    """(group_id, community, theta, place, n): each group's communities by their place on the ring, numbered from 0."""
    by = Window.partitionBy("group_id")
    c = comp.select("group_id", "community").join(theta, "community")
    place = F.row_number().over(by.orderBy("theta", "community")) - 1
    return c.select("group_id", "community", "theta", place.cast("long").alias("place"), F.count("*").over(by).alias("n"))


def ring_starts(places: DataFrame, asked: DataFrame, theta: DataFrame) -> DataFrame:
    """(community, dst_group, center, n): for each of ``asked`` (community, dst_group) how many of
    the destination group's n communities have a smaller theta than the community.

    An as-of join: queries and the group's communities in one run by theta, with a running count."""
    listed = places.select(F.col("group_id").alias("dst_group"), "theta", F.lit(1).alias("listed"), F.lit(None).cast(asked.schema["community"].dataType).alias("community"))
    queries = asked.join(theta, "community").select("dst_group", "theta", F.lit(0).alias("listed"), "community")
    run = Window.partitionBy("dst_group").orderBy("theta", "listed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = queries.unionByName(listed).withColumns({"center": F.sum("listed").over(run), "n": F.sum("listed").over(Window.partitionBy("dst_group"))})
    return counted.where("listed = 0 AND n > 0").select("community", "dst_group", "center", "n")


def ring_slot(slot: Column, center: Column, n: Column) -> Column:
    """The place of a source's ``slot``-th nearest community: from the center to the right and to the
    left in turn, RING_WINDOW communities each way at most, and then again."""
    k = F.pmod(slot, 2 * F.least(F.lit(RING_WINDOW), n))
    step = F.floor(k / 2)
    return F.pmod(F.when(k % 2 == 0, center + step).otherwise(center - step - 1), n).cast("long")


#: Attempts of a pair in a round that fills it, at least.
FILL_BATCH = 512


def shared_weights(w: World) -> DataFrame:
    """Ranges of the communities that a pair of groups shares, as wide as their pairs of people (see :func:`sampling.ranges`)."""
    dst = w.comp.select("community", F.col("group_id").alias("dst_group"), F.col("k").alias("kd"))
    both = w.shared.select("src_group", "dst_group", "community", "ks").join(dst, ["community", "dst_group"])
    return ranges(both, ["src_group", "dst_group"], F.col("ks") * F.col("kd"), "community")


def propose(w: World, need: DataFrame, mode: str, round_: int, attachment: float = 0.0, bridge: float = 0.0, pool: DataFrame | None = None, share: float = 1.0) -> DataFrame:
    """Candidates of the primary mechanism.

    community: source and destination in a community that has both groups, the
    destination's moved to a neighbour with probability ``bridge``, and picked
    from its popular members; ring: the communities with the destination group that
    are nearest to the source's on the ring; shared: one of the communities with both groups, by the
    number of its pairs of people; any: the whole groups. Those of "community" also have the
    (place, shared) of their community in the pass's order, which takes ``share`` of the need.
    """
    stream = f"{mode}/{round_}"
    n = F.greatest(4 * F.col("need"), F.lit(FILL_BATCH)) if mode in ("shared", "any") else F.ceil(F.col("need") * 1.5) + 2
    if mode != "community":
        a = _attempts(need, n, w.seed, stream).drop("need")
    fraction = 1.0 - attachment
    if mode == "any":
        for side, group, u in (("src", "src_group", "us"), ("dst", "dst_group", "ud")):
            a = a.join(w.sizes.select(F.col("group_id").alias(group), F.col("k").alias("k")), group).withColumn("i", pick(F.col(u), F.col("k"))).drop("k")
            a = _member(a, w, side, group, "i").drop("i")
        return a.withColumn("mechanism", F.lit("primary")).select(*CANDIDATE)
    if mode == "shared":
        a = drawn(a, shared_weights(w), ["src_group", "dst_group"], F.col("ub"))
        for side, group, u, k in (("src", "src_group", "us", "ks"), ("dst", "dst_group", "ud", "kd")):
            a = _member(a.withColumn("i", pick(F.col(u), F.col(k))), w, side, group, "i", "community").drop("i")
        return a.withColumn("mechanism", F.lit("primary")).select(*CANDIDATE)
    if mode == "community":
        # Communities in an order of the pair's own, from another one on in each round; those
        # that a small need can't reach aren't asked.
        asked = need.join(w.shared, ["src_group", "dst_group"]).withColumn("place", F.pmod(F.col("turn") - 7919 * round_, F.col("shared")))
        asked = asked.where(F.col("place") < 2 * F.col("need") + 8)
        most = F.greatest(F.ceil(F.col("need") * share / F.col("shared")), F.lit(1))
        a = _attempts(asked, F.least(3 * most, F.ceil(1.5 * most) + 2), w.seed, stream, "community")
        a = a.drop("need").withColumn("i", pick(F.col("us"), F.col("ks")))
        a = _member(a, w, "src", "src_group", "i", "community").drop("i", "ks", "turn")
        step = F.when(F.col("ub") < bridge / 2, -1).when(F.col("ub") < bridge, 1).otherwise(0)
        a = a.withColumn("there", F.pmod(F.col("community") + step, F.lit(w.communities)).cast("int"))
    else:
        sizes = w.sizes.select(F.col("group_id").alias("src_group"), "k")
        a = a.join(sizes, "src_group")
        # Sources by turns: each tries its nearest communities in the order of their slots.
        a = a.withColumns({"i": F.pmod(F.col("j") - 1 + 7919 * round_, F.col("k")), "slot": F.expr("(j - 1) div k")})
        m = w.members.select(F.col("node_id").alias("src"), F.col("group_id").alias("src_group"), F.col("gidx").alias("i"), "community")
        a = a.drop("k").join(m, ["src_group", "i"]).drop("i")
        places = ring_places(w.comp, w.theta)
        asked = w.comp.select("community", F.col("group_id").alias("src_group")).join(need.select("src_group", "dst_group"), "src_group").select("community", "dst_group").distinct()
        starts = stored(ring_starts(places, asked, w.theta), "starts")
        a = a.join(starts, ["community", "dst_group"]).withColumn("place", ring_slot(F.col("slot"), F.col("center"), F.col("n")))
        a = a.drop("community").join(places.select(F.col("group_id").alias("dst_group"), "place", F.col("community").alias("there")), ["dst_group", "place"])
    k = w.comp.select(F.col("community").alias("there"), F.col("group_id").alias("dst_group"), F.col("k").alias("kd"))
    # The pool of popular members: a share of the group, and everyone again for each edge that they drew.
    first = F.greatest(F.ceil(F.lit(fraction) * F.col("kd")), F.lit(1)).cast("long") if mode == "community" else F.col("kd")
    k = k.select("there", "dst_group", first.alias("size"))
    entries = w.members.select(F.col("community").alias("there"), F.col("group_id").alias("dst_group"), F.col("idx").alias("p"), F.col("node_id").alias("dst"))
    if pool is not None and mode == "community":
        later = pool.join(k, ["there", "dst_group"]).select("there", "dst_group", (F.col("p") + F.col("size")).alias("p"), "dst")
        entries = entries.join(k, ["there", "dst_group"]).where("p < size").drop("size").unionByName(later)
        pushed = pool.groupBy("there", "dst_group").agg(F.count("*").alias("pushed"))
        k = k.join(pushed, ["there", "dst_group"], "left").select("there", "dst_group", (F.col("size") + F.coalesce("pushed", F.lit(0))).alias("size"))
    a = a.join(k, ["there", "dst_group"]).withColumn("p", pick(F.col("ud"), F.col("size")))
    also = ("place", "shared") if mode == "community" else ()
    return a.join(entries, ["there", "dst_group", "p"]).withColumn("mechanism", F.lit("primary")).select(*CANDIDATE, *also)


def popularity(w: World, edges: DataFrame, fraction: float, scope: str = "local") -> DataFrame:
    """(there, dst_group, p, dst): numbered entries for destinations that become
    more popular.

    local: an edge's destination once in its own community, with probability
    1 - fraction, twice. global: with probability 1 - fraction, and then
    ``fraction``, once in a random community that has the group.
    """
    if scope not in ("local", "global"):
        raise ValueError(f"unknown scope: {scope}")
    u, v = uniform(w.seed, "push", "src", "dst"), uniform(w.seed, "push2", "src", "dst")
    if scope == "local":
        m = w.members.select(F.col("node_id").alias("dst"), F.col("community").alias("there"))
        e = edges.where((u > fraction) & (v > fraction)).join(m, "dst")
    else:
        by = Window.partitionBy("group_id")
        pools = w.comp.select(F.col("group_id").alias("dst_group"), F.col("community").alias("there"), (F.row_number().over(by.orderBy("community")) - 1).cast("long").alias("t"), F.count("*").over(by).alias("pools"))
        e = edges.where((u > fraction) & (v < fraction)).join(pools.where("t = 0").select("dst_group", "pools"), "dst_group")
        e = e.withColumn("t", pick(uniform(w.seed, "pool", "src", "dst"), F.col("pools"))).join(pools.drop("pools"), ["dst_group", "t"])
    return numbered(e.select("src", "dst", "there", "dst_group"), ["there", "dst_group"], u, ["src", "dst"], "p", 256).select("there", "dst_group", "p", "dst")


def reciprocal(new: DataFrame, probability: float, seed: int) -> DataFrame:
    """Candidates back along new edges."""
    u = uniform(seed, "back", "src", "dst")
    turned = new.where(u < probability)
    return turned.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_group").alias("src_group"), F.col("src_group").alias("dst_group"), u.alias("u"), F.lit("reciprocal").alias("mechanism"))


def closing(w: World, new: DataFrame, edges: DataFrame, inside: float, outside: float) -> DataFrame:
    """For each new edge s to d and neighbour n of d: s to n, with a probability
    that depends on whether d and n share a community."""
    near = edges.select(F.col("src").alias("dst"), F.col("dst").alias("n")).union(edges.select("dst", F.col("src").alias("n")))
    p = F.when(F.col("cd") == F.col("cn"), float(inside)).otherwise(float(outside))
    m = w.members
    c = new.select("src", "dst", "src_group").join(near, "dst").where("n <> src")
    u = uniform(w.seed, "close", "src", "dst", "n")
    c = c.where(u < max(inside, outside)).withColumn("u", u)
    c = c.join(m.select(F.col("node_id").alias("dst"), F.col("community").alias("cd")), "dst").join(m.select(F.col("node_id").alias("n"), F.col("community").alias("cn"), F.col("group_id").alias("dst_group")), "n")
    return c.where(F.col("u") < p).select("src", F.col("n").alias("dst"), "src_group", "dst_group", "u", F.lit("closing").alias("mechanism"))


def tagged(rows: DataFrame, phase: str, round_: int) -> DataFrame:
    return rows.select("src", "dst", "src_group", "dst_group", "mechanism", F.lit(phase).alias("phase"), F.lit(round_).alias("round"))


@scoped
def grow(
    w: World,
    edges: DataFrame,
    schedule: list[tuple[str, str, int]],
    attachment: float,
    reciprocity: float,
    closure: tuple[float, float],
    bridge: float,
    scope: str = "local",
) -> DataFrame:
    """Edges after the schedule's (phase, mode, rounds); a phase ends early when a round accepts nothing."""
    fraction = 1.0 - attachment
    derived = reciprocity > 0 or max(closure) > 0
    g = begin(w, edges)
    turning: DataFrame | None = None
    for phase, mode, rounds in schedule:
        asking = g.need
        for r in range(rounds + 3 if derived and phase == "A" else rounds):
            if asking.isEmpty():
                break
            # Where edges lead to others, a round takes part of the need, so that these find room.
            share = 0.35 if derived and phase == "A" else 1 / (1 + reciprocity) if phase == "fill" and r == 0 else 1.0
            pool = stored(popularity(w, g.edges, fraction, scope), "pool") if mode == "community" and attachment > 0 else None
            found = propose(w, asking, mode, r, attachment, bridge, pool, share)
            new = stored(accept_by_quota(found, g, share) if mode == "community" else accept(found, g, share), "accepted")
            if new.isEmpty():
                break
            before = g.edges
            g.add(tagged(new, phase, r))
            # One step for all derived edges; those back along closing edges come a round later.
            extra = [reciprocal(x, reciprocity, w.seed) for x in (new, turning) if x is not None] if reciprocity > 0 else []
            extra += [closing(w, new, before, *closure)] if max(closure) > 0 and phase != "fill" else []
            turning = None
            if extra:
                more = stored(accept(reduce(DataFrame.unionByName, extra), g), "derived")
                turning = more.where("mechanism = 'closing'")
                g.add(tagged(more, phase, r))
            g.settle()
            asking = g.need
            if phase == "fill":
                # A pair leaves the stage when a round adds nothing to it.
                asking = asking.join(new.select("src_group", "dst_group").distinct(), ["src_group", "dst_group"], "left_semi")
    return g.edges


#: Stages that fill pairs under their target: communities that both groups share, then whole groups.
FILL = (("fill", "shared", 10), ("fill", "any", 10))


def fill_statistics(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """One row on the fill: total_pairs; fulfilled_pairs and unfulfilled_pairs before it (of
    those with a target); edges_added, those back within a group included; reciprocal_edges_added."""
    pair = ["src_group", "dst_group"]
    before = edges.where("phase <> 'fill'").groupBy(*pair).agg(F.count("*").alias("have"))
    t = targets.select(*pair, "target").join(before, pair, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    t = t.agg(F.count("*").alias("total_pairs"), F.count_if(F.expr("target > 0 AND have >= target")).alias("fulfilled_pairs"), F.count_if(F.expr("have < target")).alias("unfulfilled_pairs"))
    back = F.col("mechanism") == "reciprocal"
    added = edges.where("phase = 'fill'").agg(F.count_if(~back | (F.col("src_group") == F.col("dst_group"))).alias("edges_added"), F.count_if(back).alias("reciprocal_edges_added"))
    return t.crossJoin(added)


def no_edges(like: World) -> DataFrame:
    return like.members.sparkSession.createDataFrame([], "src long, dst long, src_group int, dst_group int, mechanism string, phase string, round int")


def pre_seeded(w: World, edges: DataFrame) -> DataFrame:
    """Given edges (src, dst) with their groups, counted towards the targets."""
    side = lambda end: w.members.select(F.col("node_id").alias(end), F.col("group_id").alias(f"{end}_group"))
    e = edges.select("src", "dst").where("src <> dst").distinct().join(side("src"), "src").join(side("dst"), "dst")
    return given(e)


#: Members of a community that one row of a strip is paired with.
PAIR_STRIP = 512


def complete_communities(assignment: DataFrame, groups: bool = False) -> DataFrame:
    """Every ordered pair of different people of a community (src, dst), with their src_group and
    dst_group if ``groups`` are asked for.

    This is what a layer of households is: its rows are the result, and grow
    with the square of a community's size, so communities should be small. Large ones
    are dealt to all tasks by strips of their sources.
    """
    group = ["group_id"] if groups else []
    side = lambda end: assignment.select("community", F.col("node_id").alias(end), *(F.col(c).alias(f"{end}_group") for c in group))
    strips = assignment.groupBy("community").agg(F.ceil(F.count("*") / PAIR_STRIP).alias("_n"))
    tasks = int(assignment.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = side("src").join(strips, "community").withColumn("_s", F.pmod(F.xxhash64("src"), F.col("_n"))).drop("_n")
    b = side("dst").join(strips, "community").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    pairs = a.repartition(tasks, "community", "_s").join(b.repartition(tasks, "community", "_s"), ["community", "_s"]).where("src <> dst")
    return pairs.select("src", "dst", *(f"{end}_group" for end in ("src", "dst") if group))


def given(edges: DataFrame) -> DataFrame:
    """Edges of a layer with their groups, as what the next layer has before it grows."""
    return tagged(edges.withColumn("mechanism", F.lit("given")), "given", 0)


def diagnostics(edges: DataFrame) -> DataFrame:
    """Edges and pairs touched by phase and mechanism."""
    return edges.groupBy("phase", "mechanism").agg(F.count("*").alias("n_edges"), F.countDistinct("src_group", "dst_group").alias("n_pairs"))


def sample_edges(edges: DataFrame, fraction: float, seed: int = 42, also: Sequence[str] = ()) -> DataFrame:
    """floor(fraction * E) edges with the smallest numbers (src, dst, and the columns ``also``)."""
    e, n = edges.select("src", "dst", *also), edges.count()
    return smallest_share(e, digits(seed, "sample", "src", "dst"), int(fraction * n), n, ["src", "dst"])


def combine_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, layers): each edge once, with the sorted names of its layers."""
    rows = [e.select("src", "dst", F.lit(name).alias("layer")) for name, e in layers.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("src", "dst").agg(F.sort_array(F.collect_set("layer")).alias("layers"))


def nested_overlap(home: str, households: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """As :func:`layer_overlap` of ``home``, every pair of the ``households`` (node_id, community), and of the
    ``layers`` that build on it, in their order: the first was given a part of home's edges, the second
    all of the first's (phase "given"), the others nothing.

    So only edges that a layer has made itself, none of which it was given, are looked up, those in
    home by the households of their ends; no pair of home is made."""
    side = lambda end: households.select(F.col("node_id").alias(end), F.col("community").alias(f"_{end}"))
    names = list(layers)
    own = [layers[name].where("phase <> 'given'").select("src", "dst") for name in names]
    common: dict[tuple[str, str], list[DataFrame]] = {}
    for i, name in enumerate(names):
        inside = [own[i].join(side("src"), "src").join(side("dst"), "dst").where("_src = _dst")]
        inside += [layers[name].where("phase = 'given'")] if i == 0 else common[home, names[0]] if i == 1 else []
        common[home, name] = inside
        for j, other in enumerate(names[:i]):
            common[other, name] = [layers[other] if (j, i) == (0, 1) else own[i].join(layers[other], ["src", "dst"], "left_semi")]
    n = [e.agg(F.count("*").alias("n")).select(F.lit(min(pair)).alias("a"), F.lit(max(pair)).alias("b"), "n") for pair, parts in common.items() for e in parts]
    return reduce(DataFrame.unionByName, n).groupBy("a", "b").agg(F.sum("n").alias("n_common")).where("n_common > 0")


def layer_overlap(combined: DataFrame) -> DataFrame:
    """(a, b, n_common): edges that each pair of layers shares."""
    x = combined.where(F.size("layers") > 1)
    p = x.select(F.explode("layers").alias("a"), "layers").select("a", F.explode("layers").alias("b")).where("a < b")
    return p.groupBy("a", "b").agg(F.count("*").alias("n_common"))


