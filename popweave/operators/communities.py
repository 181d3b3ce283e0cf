"""Communities: sizes, assignment of people, refinement, and reports.

Node-level work is distributed. Only tables with a row for each community or
group pair come to the driver, for the sequential searches on them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popweave.functions.rng import normal, uniform
from popweave.operators.population import proportional_at_least_one
from popweave.operators.sampling import numbered


def community_sizes(spark: SparkSession, k: int, kind: str | list[float], people: int, seed: int = 42) -> DataFrame | None:
    """(community, weight), or None for "natural" sizes.

    A list gives weights, "powerlaw" 1/rank, "uniform" equal ones, "normal" one
    around the mean size with a deviation of 0.3 of it, 1 at least.
    """
    c = spark.range(k).select(F.col("id").cast("int").alias("community"))
    if kind == "natural":
        return None
    if kind == "powerlaw":
        return c.withColumn("weight", 1.0 / (F.col("community") + 1))
    if kind == "uniform":
        return c.withColumn("weight", F.lit(1.0))
    if kind == "normal":
        mean = people / k
        return c.withColumn("weight", F.greatest(mean + 0.3 * mean * normal(seed, "size", "community"), F.lit(1.0)))
    if isinstance(kind, str):
        raise ValueError(f"unknown size distribution: {kind}")
    weights = F.array(*[F.lit(float(w)) for w in kind])
    return c.withColumn("weight", F.get(weights, F.col("community")))


def assign_natural(nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(node_id, group_id, community): each group dealt out evenly, the communities
    that get one more in an order of the group's own."""
    spark = nodes.sparkSession
    if k == 1:
        return nodes.select("node_id", "group_id", F.lit(0).alias("community"))
    placed = numbered(nodes.select("node_id", "group_id"), ["group_id"], uniform(seed, "deal", "node_id"), ["node_id"], "place")
    dealt = placed.select("node_id", "group_id", F.pmod("place", F.lit(k)).cast("int").alias("turn"))
    all_ = nodes.select("group_id").distinct().crossJoin(F.broadcast(spark.range(k).select(F.col("id").cast("int").alias("community"))))
    turn = F.row_number().over(Window.partitionBy("group_id").orderBy(uniform(seed, "turns", "group_id", "community"), "community")) - 1
    return dealt.join(all_.withColumn("turn", turn), ["group_id", "turn"]).select("node_id", "group_id", "community")


def assign_weighted(nodes: DataFrame, sizes: DataFrame, seed: int = 42) -> DataFrame:
    """(node_id, group_id, community): each group split by the communities'
    weights (rounded, the last takes the rest), in random order."""
    ranked = numbered(nodes.select("node_id", "group_id"), ["group_id"], uniform(seed, "deal", "node_id"), ["node_id"], "place")
    n = nodes.groupBy("group_id").agg(F.count("*").alias("n"))
    by = Window.orderBy("community")
    share = sizes.withColumns({"upto": F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "all": F.sum("weight").over(Window.partitionBy()), "last": F.max("community").over(Window.partitionBy())})
    cut = n.crossJoin(F.broadcast(share))
    high = F.when(F.col("community") == F.col("last"), F.col("n")).otherwise(F.round(F.col("n") * F.col("upto") / F.col("all")).cast("long"))
    cut = cut.withColumn("high", high)
    low = F.coalesce(F.lag("high").over(Window.partitionBy("group_id").orderBy("community")), F.lit(0))
    cut = cut.withColumn("low", low).where("high > low")
    # Bounds become equi-join keys: a range of places is a run of places.
    spans = cut.select("group_id", "community", F.explode(F.sequence("low", F.col("high") - 1)).alias("place"))
    return ranked.join(spans, ["group_id", "place"]).select("node_id", "group_id", "community")


def coordinates(assignment: DataFrame, seed: int = 42, spread: bool = False) -> DataFrame:
    """(community, theta): a place on the ring [0, 1) for each community, uniform,
    or with ``spread`` evenly spaced in random order."""
    u = uniform(seed, "theta", "community")
    c = assignment.select("community").distinct()
    if not spread:
        return c.withColumn("theta", u)
    place = F.row_number().over(Window.orderBy(u, "community")) - 1
    return c.withColumn("theta", place / F.count("*").over(Window.partitionBy()))


def assign_counts(nodes: DataFrame, counts: DataFrame, seed: int = 42) -> DataFrame:
    """(node_id, group_id, community): each group's people in random order, dealt to
    communities as ``counts`` (community, group_id, n) says; people beyond the
    counts are left out."""
    by = Window.partitionBy("group_id").orderBy("community")
    high = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = counts.where("n > 0").withColumn("high", high).select("group_id", "community", F.explode(F.sequence(F.col("high") - F.col("n"), F.col("high") - 1)).alias("place"))
    placed = numbered(nodes.select("node_id", "group_id"), ["group_id"], uniform(seed, "deal", "node_id"), ["node_id"], "place")
    return placed.join(spans, ["group_id", "place"]).select("node_id", "group_id", "community")


def composition(assignment: DataFrame) -> DataFrame:
    """(community, group_id, n)."""
    return assignment.groupBy("community", "group_id").agg(F.count("*").alias("n"))


def pair_communities(comp: DataFrame, targets: DataFrame) -> DataFrame:
    """(src_group, dst_group, community) where both groups of a pair with a target live."""
    wanted = targets.where("target > 0").select("src_group", "dst_group")
    a = comp.select("community", F.col("group_id").alias("src_group"))
    b = comp.select("community", F.col("group_id").alias("dst_group"))
    return wanted.join(a, "src_group").join(b, ["community", "dst_group"]).select("src_group", "dst_group", "community")


def possible_interactions(comp: DataFrame) -> DataFrame:
    """(src_group, dst_group, possible): ordered pairs of people who share a community, none with oneself."""
    a = comp.select("community", F.col("group_id").alias("src_group"), F.col("n").alias("a"))
    b = comp.select("community", F.col("group_id").alias("dst_group"), F.col("n").alias("b"))
    own = F.when(F.col("src_group") == F.col("dst_group"), F.col("a")).otherwise(0)
    return a.join(b, "community").groupBy("src_group", "dst_group").agg(F.sum(F.col("a") * F.col("b") - own).alias("possible"))


def mean_relative_error(possible: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: mean of |possible - target| / target over pairs with a target."""
    both = targets.where("target > 0").join(possible, ["src_group", "dst_group"], "left")
    return both.agg(F.avg(F.abs(F.coalesce("possible", F.lit(0)) - F.col("target")) / F.col("target")).alias("mre"))


def diversity(comp: DataFrame) -> DataFrame:
    """community, size, n_groups, Shannon entropy, Simpson index and Pielou evenness (0 for one group)."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("community"))
    g = comp.withColumn("p", p).groupBy("community").agg(F.sum("n").alias("size"), F.count("*").alias("n_groups"), (-F.sum(F.col("p") * F.log("p"))).alias("shannon"), (1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"))
    return g.withColumn("pielou", F.when(F.col("n_groups") > 1, F.col("shannon") / F.log(F.col("n_groups").cast("double"))).otherwise(0.0))


def size_report(comp: DataFrame, k: int) -> DataFrame:
    """One row over all k communities: mean, std, min, max, median, coefficient of variation, empty ones."""
    sizes = comp.groupBy("community").agg(F.sum("n").alias("n"))
    all_ = comp.sparkSession.range(k).select(F.col("id").cast("int").alias("community")).join(sizes, "community", "left").na.fill(0)
    g = all_.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"), F.percentile("n", F.lit(0.5)).alias("median"), F.count_if(F.col("n") == 0).alias("empty"))
    return g.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")))


def isolation(groups: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """(characteristic, isolation): mean over values of the share of links that
    stay within a value, minus the value's share of people (0 for one value)."""
    long = lambda side: groups.select(F.col("group_id").alias(side), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias(f"v_{side}")) for c in names])).alias("x")).select(side, F.col("x.c").alias("characteristic"), f"x.v_{side}")
    t = targets.join(long("src_group"), "src_group").join(long("dst_group"), ["dst_group", "characteristic"]).where("v_src_group IS NOT NULL")
    links = t.groupBy("characteristic", F.col("v_src_group").alias("v")).agg(F.sum(F.when(F.col("v_src_group") == F.col("v_dst_group"), F.col("target")).otherwise(0)).alias("intra"), F.sum("target").alias("out"))
    people = groups.select(F.explode(F.array(*[F.struct(F.lit(c).alias("characteristic"), F.col(c).cast("string").alias("v")) for c in names])).alias("x"), "n").select("x.*", "n").where("v IS NOT NULL").groupBy("characteristic", "v").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.lit(0.0)
    total = groups.agg(F.sum("n").alias("total"))
    v = people.crossJoin(F.broadcast(total)).where("n > 0").join(links, ["characteristic", "v"], "left")
    share = F.col("n") / F.col("total")
    i = F.when(F.coalesce("out", F.lit(0)) > 0, F.col("intra") / F.col("out") - share).otherwise(0.0)
    g = v.groupBy("characteristic").agg(F.avg(i).alias("i"), F.count("*").alias("k"))
    return g.select("characteristic", F.when(F.col("k") > 1, F.col("i")).otherwise(0.0).alias("isolation"))


def assign_segregated(nodes: DataFrame, groups: DataFrame, targets: DataFrame, names: list[str], k: int, threshold: float = 0.1, seed: int = 42) -> DataFrame:
    """(node_id, group_id, community): blocks of the one or two most isolated
    characteristics get communities by population, and their people fill them by head-room:
    communities of a block differ by one person at most, and so do those of one group
    in them (with more blocks than communities, blocks share some). Without an isolated
    characteristic all share one block."""
    found = isolation(groups, targets, names).where(F.col("isolation") >= threshold).orderBy(F.desc("isolation"), "characteristic").limit(2).collect()
    by = [r.characteristic for r in found]
    label = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by)) if by else F.lit("all")
    blocks = groups.groupBy(label.alias("block")).agg(F.sum("n").alias("n"))
    units = proportional_at_least_one(blocks, "n", k, ["block"])
    first = F.coalesce(F.sum("units").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = units.withColumn("first", first)
    # Groups of a block are dealt one after the other, each from where the one before it ended.
    people = nodes.groupBy("group_id").agg(F.count("*").alias("k"))
    before = Window.partitionBy("block").orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1)
    of_group = groups.select("group_id", label.alias("block")).join(people, "group_id").join(placed, "block")
    of_group = of_group.select("group_id", "first", "units", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    placed = numbered(nodes.select("node_id", "group_id"), ["group_id"], uniform(seed, "deal", "node_id"), ["node_id"], "place")
    c = F.col("first") + F.pmod(F.col("place") + F.col("start"), F.col("units"))
    return placed.join(of_group, "group_id").select("node_id", "group_id", F.pmod(c, F.lit(k)).cast("int").alias("community"))


def separated_groups(pairs: DataFrame, k: int) -> list[int]:
    """k groups by greedy farthest points: the least linked first, then always
    the one with the fewest links to those chosen (smaller id if equal). For
    more than there are groups, the least linked ones come again."""
    rows = pairs.groupBy("src_group", "dst_group").agg(F.sum("target").alias("t")).collect()
    ids = sorted({r.src_group for r in rows} | {r.dst_group for r in rows})
    at = {g: i for i, g in enumerate(ids)}
    links = np.zeros((len(ids), len(ids)))
    for r in rows:
        links[at[r.src_group], at[r.dst_group]] += r.t
        links[at[r.dst_group], at[r.src_group]] += r.t
    total = links.sum(1)
    chosen = [int(np.argmin(total))] if ids else []
    near = links[chosen[0]].copy() if chosen else np.zeros(0)
    while len(chosen) < min(k, len(ids)):
        near[chosen] = np.inf
        chosen.append(int(np.argmin(near)))
        near = np.where(np.isinf(near), np.inf, near + links[chosen[-1]])
    least = np.argsort(total, kind="stable").tolist()
    return [ids[i] for i in chosen] + [ids[least[i % len(ids)]] for i in range(max(k - len(chosen), 0) if ids else 0)]


def loss(comp: np.ndarray, budget: np.ndarray, penalty: float) -> float:
    over = comp.T @ comp - budget
    return float(np.where(over > 0, penalty * over, -over).sum())


def refine(assignment: DataFrame, targets: DataFrame, moves: int = 300_000, penalty: float = 10.0, seed: int = 42) -> DataFrame:
    """Moves people between communities, or to a new one, while that lowers the
    gap between the possible interactions and the targets.

    A move picks a person (so communities and groups by their people) and one of
    the communities or the next new one. The search runs on the composition table (communities x groups), which is
    all that the gap depends on; afterwards each group's people are moved by
    rank, as few as the counts ask for. Group totals stay, and the gap never rises.
    """
    comp_rows = composition(assignment).collect()
    groups = sorted({r.group_id for r in comp_rows})
    at = {g: i for i, g in enumerate(groups)}
    k = max((r.community for r in comp_rows), default=0) + 1
    comp = np.zeros((k, len(groups)))
    for r in comp_rows:
        comp[r.community, at[r.group_id]] = r.n
    budget = np.zeros((len(groups), len(groups)))
    for r in targets.where("target > 0").collect():
        if r.src_group in at and r.dst_group in at:
            budget[at[r.src_group], at[r.dst_group]] = r.target
    start = comp.copy()
    achieved = comp.T @ comp
    rng = np.random.default_rng(seed)
    cost = lambda x: np.where(x > 0, penalty * x, -x)
    # People keep their numbers, as a move of one of a group is a move of any.
    home = np.repeat(np.arange(k), comp.sum(1).astype(int))
    kind = np.concatenate([np.repeat(np.arange(len(groups)), row.astype(int)) for row in comp]) if k else np.zeros(0, int)
    people = rng.integers(len(home), size=moves) if len(home) else np.zeros(0, int)
    where = rng.random(len(people))
    for i, u in zip(people.tolist(), where.tolist(), strict=True):
        a, g = int(home[i]), int(kind[i])
        b = int(u * (k + 1))
        if a == b:
            continue
        if b == len(comp):
            comp = np.vstack([comp, np.zeros((1, len(groups)))])
        row = comp[b] - comp[a]
        row[g] = 2 * (comp[b, g] - comp[a, g]) + 2
        new_row, new_col = achieved[g] + row, achieved[:, g] + row
        before = cost(achieved[g] - budget[g]).sum() + cost(achieved[:, g] - budget[:, g]).sum() - cost(achieved[g, g] - budget[g, g])
        after = cost(new_row - budget[g]).sum() + cost(new_col - budget[:, g]).sum() - cost(new_row[g] - budget[g, g])
        if after < before:
            achieved[g], achieved[:, g] = new_row, new_col
            comp[a, g] -= 1
            comp[b, g] += 1
            home[i] = b
            k = max(k, b + 1)
    comp = comp[:k]
    start = np.vstack([start, np.zeros((k - len(start), len(groups)))])
    spark = assignment.sparkSession
    leave, enter = [], []
    for i, g in enumerate(groups):
        change = (comp[:, i] - start[:, i]).astype(int)
        leave += [(g, c, int(-d)) for c, d in enumerate(change) if d < 0]
        to = np.repeat(np.arange(k), np.maximum(change, 0))
        enter += [(g, j, int(c)) for j, c in enumerate(to)]
    out = spark.createDataFrame(leave, "group_id int, community int, gone int")
    new = spark.createDataFrame(enter, "group_id int, turn int, moved_to int")
    ranked = assignment.withColumn("rank", F.row_number().over(Window.partitionBy("group_id", "community").orderBy(uniform(seed, "move", "node_id"), "node_id")))
    marked = ranked.join(F.broadcast(out), ["group_id", "community"], "left")
    movers = marked.where(F.col("rank") <= F.col("gone"))
    turn = F.row_number().over(Window.partitionBy("group_id").orderBy("community", "node_id")) - 1
    moved = movers.withColumn("turn", turn).join(new, ["group_id", "turn"]).select("node_id", "group_id", F.col("moved_to").alias("community"))
    stay = marked.where(F.col("gone").isNull() | (F.col("rank") > F.col("gone"))).select("node_id", "group_id", "community")
    return stay.unionByName(moved)


def merge_communities(assignment: DataFrame, k: int) -> DataFrame:
    """(node_id, group_id, community): communities dealt to k larger ones, big
    ones first and back and forth, so that sizes come out alike and members of
    one community stay together."""
    sizes = assignment.groupBy("community").agg(F.count("*").alias("n"))
    turn = F.row_number().over(Window.orderBy(F.desc("n"), "community")) - 1
    lap, place = F.floor(turn / k), F.pmod(turn, F.lit(k))
    to = sizes.select("community", F.when(lap % 2 == 0, place).otherwise(k - 1 - place).cast("int").alias("larger"))
    return assignment.join(to, "community").select("node_id", "group_id", F.col("larger").alias("community"))


def assign_households(nodes: DataFrame, targets: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """(node_id, group_id, community) of :func:`households`; only counts by group and
    targets by pair come to the driver."""
    n = {r.group_id: r.n for r in nodes.groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    ids = sorted(n)
    at = {g: i for i, g in enumerate(ids)}
    t = np.zeros((len(ids), len(ids)))
    for r in targets.select("src_group", "dst_group", "target").collect():
        if r.src_group in at and r.dst_group in at:
            t[at[r.src_group], at[r.dst_group]] = r.target
    comp = households(t, np.array([n[g] for g in ids], np.int64), seed=seed, k=k)
    rows = [(int(c), ids[i], int(comp[c, i])) for c, i in zip(*np.nonzero(comp), strict=True)]
    return assign_counts(nodes, nodes.sparkSession.createDataFrame(rows, "community int, group_id int, n long"), seed)


def households(targets: np.ndarray, people: np.ndarray, sweeps: int = 15, tolerance: float = 5e-5, seed: int = 42, k: int | None = None) -> np.ndarray:
    """Composition (households x groups) whose co-members match symmetric targets.

    Targets and link rates p (links over pairs of people) are made symmetric, the
    later direction of a pair of groups winning. Without ``k``, people over the
    mean expected size of a household is their number. Groups are seated from the
    largest on, each drawn multinomially with weights of the links to who sits
    there already; then sweeps draw each group's column anew with
    p * clip(sqrt(target / achieved), 0.1, 10) (0 without a target), until the mean
    relative error falls by less than ``tolerance``. Group totals stay.

    All of it works on tables of households and groups, on the driver.
    """
    rng = np.random.default_rng(seed)
    n = people.astype(float)
    t = np.where(np.triu(targets.T > 0, 1), targets.T, targets)
    t = np.triu(t) + np.triu(t, 1).T
    pairs = np.outer(n, n) - np.diag(n)
    p = np.divide(t, pairs, out=np.zeros_like(t), where=pairs > 0)
    total = int(n.sum())
    size = float(n @ (1 - np.diag(p) + p @ n) / total) if total else 2.0
    k = k or max(1, round(total / size))
    floor = 1 / k
    comp = np.zeros((k, len(people)), np.int64)
    order = np.argsort(-n, kind="stable").tolist()

    def drawn(group: int, weights: np.ndarray) -> np.ndarray:
        w = np.maximum(weights + floor, 0)
        return rng.multinomial(int(people[group]), w / w.sum())

    for step, g in enumerate(order):
        seated = order[:step]
        comp[:, g] = drawn(g, comp[:, seated] @ p[g, seated])

    def achieved() -> np.ndarray:
        return (comp.T @ comp - np.diag(comp.sum(0))).astype(float)

    last = np.inf
    for _ in range(sweeps):
        made = achieved()
        w = np.where(t > 0, np.clip(np.sqrt(t / np.maximum(made, 1e-9)), 0.1, 10), 0.0) * p
        for g in rng.permutation(len(people)).tolist():
            comp[:, g] = drawn(g, comp @ w[g] - w[g, g] * comp[:, g])
        some = t > 0
        error = float((np.abs(achieved() - t)[some] / t[some]).mean()) if some.any() else 0.0
        if last - error < tolerance:
            break
        last = error
    return comp
