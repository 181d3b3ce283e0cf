"""Spreading processes over many configurations at once.

Configurations are numbered and kept as bits of a long, WORD of them to a row. State is one
table: (node_id, word, done, new, waits) of the nodes that have seen an adopter or are one; done has the
configurations in which they have adopted, new those of the last step, waits the number of
adopters they see in each other one. A step sends the newest adopters along the edges, a row for an
edge and not for each configuration, and only nodes that haven't adopted are counted for a configuration.
Adopters of each step are written once. A node counts infected successors by
default (an edge leads from the node that looks to the node it looks at), or neighbours of any direction.

Random seeds are drawn, not ranked: nodes are numbered once, and a configuration
takes the numbers that a permutation of its own gives for 0, 1, 2 and so on. So
seeds are an equi-join of (configuration, number) with the numbered nodes, and no
row is made for a node and a configuration that don't belong together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from popweave.functions.rng import normal, permuted, uniform
from popweave.operators.sampling import numbered, smallest
from popweave.sources.scratch import drop, scoped, stored


#: Configurations that a row keeps as bits.
WORD = 62

#: Nodes that have adopted in all configurations from which on they are taken out.
PRUNED = 100_000


def looked_at(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(node_id, seen): whom each node looks at."""
    e = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("seen"))
    return e if directed else e.union(e.select("seen", "node_id").toDF("node_id", "seen")).distinct()


def numbers(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """(node_id, place): all nodes numbered from 0, in an order drawn by ``seed``."""
    return stored(numbered(nodes.select("node_id"), [], uniform(seed, "place", "node_id"), ["node_id"], "place"), "places")


def drawn(requests: DataFrame, keys: list[str], seed: int, stream: str = "seed") -> DataFrame:
    """(keys, place): ``initial`` different numbers below ``n`` for each request (keys, n,
    initial), all of them if there are fewer. What comes of the permutation's first outputs
    below n is taken in turn; rows made are about four times the numbers asked for, and the
    permutation's whole domain only for a request that this leaves short."""
    bits = F.greatest(F.ceil(F.log2(F.greatest("n", F.lit(2))) / 2), F.lit(1)).cast("int")
    r = requests.withColumns({"_bits": bits, "_domain": F.call_function("shiftleft", F.lit(1).cast("long"), 2 * bits)})
    want = F.least(F.col("initial").cast("long"), F.col("n"))

    def first(rows: DataFrame, tries: Column) -> DataFrame:
        each = rows.where("initial > 0 AND n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), tries - 1)))
        made = each.withColumn("place", permuted(seed, stream, F.col("_i"), F.col("_bits"), *keys)).where("place < n")
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_i"))
        return made.withColumn("_r", rank).where(F.col("_r") <= want).select(*keys, "place")

    few = F.least(F.col("_domain"), 20 + 2 * F.ceil(F.col("initial") * F.col("_domain") / F.col("n")))
    some = first(r, few)
    got = some.groupBy(*keys).agg(F.count("*").alias("_got"))
    short = r.join(got, keys, "left").where(F.coalesce("_got", F.lit(0)) < want).drop("_got")
    if short.isEmpty():
        return some
    return some.join(short.select(*keys), keys, "left_anti").unionByName(first(short, F.col("_domain")))


@scoped
def seed_random(configs: DataFrame, nodes: DataFrame, initial: int, seed: int = 42, stream: str = "seed") -> DataFrame:
    """(config, node_id): ``initial`` different nodes of each configuration, drawn for it."""
    return seed_sized(configs.select("config", F.lit(initial).alias("initial")), nodes, seed, stream)


@scoped
def seed_sized(configs: DataFrame, nodes: DataFrame, seed: int = 42, stream: str = "seed") -> DataFrame:
    """(config, node_id): as :func:`seed_random`, each configuration with its own number ``initial``."""
    placed = numbers(nodes, seed)
    asked = configs.select("config", "initial", F.lit(placed.count()).alias("n"))
    return drawn(asked, ["config"], seed, stream).join(placed, "place").select("config", "node_id")


def grid(spark, **values: list) -> DataFrame:
    """config and every combination of the given parameter values."""
    from itertools import product

    names = list(values)
    rows = [(i, *map(float, v)) for i, v in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, "config long, " + ", ".join(f"{n} double" for n in names))


def seed_focal(configs: DataFrame, edges: DataFrame, focal: int) -> DataFrame:
    """(config, node_id): the focal node and its successors, for every configuration."""
    near = edges.where(F.col("src") == focal).select(F.col("dst").alias("node_id"))
    own = configs.sparkSession.range(1).select(F.lit(focal).cast("long").alias("node_id"))
    return near.union(own).distinct().crossJoin(F.broadcast(configs.select("config"))).select("config", "node_id")


@scoped
def seed_focals(configs: DataFrame, edges: DataFrame, nodes: DataFrame, seed: int = 42) -> DataFrame:
    """(config, node_id): for each configuration a random node of its own and that node's successors."""
    focal = seed_random(configs, nodes, 1, seed, "focal")
    near = focal.join(edges.select(F.col("src").alias("node_id"), F.col("dst")), "node_id").select("config", F.col("dst").alias("node_id"))
    return stored(focal.unionByName(near).distinct(), "focals")


def seed_from(configs: DataFrame, candidates: DataFrame, nodes: DataFrame, initial: int, seed: int = 42) -> DataFrame:
    """``initial`` of the candidates, or of all nodes if there are fewer."""
    enough = candidates.limit(initial).count() >= initial
    return seed_random(configs, candidates if enough else nodes, initial, seed)


def thresholds_heterogeneous(nodes: DataFrame, kind: str, mean: float, spread: float | None = None, seed: int = 42) -> DataFrame:
    """(node_id, threshold): "normal" (std ``spread``, 0.25 of the mean if not
    given, clipped to [0, 1]), "uniform" (mean plus or minus spread) or "fixed"."""
    width = 0.25 * mean if spread is None else spread
    if kind == "normal":
        t = F.lit(mean) + F.lit(width) * normal(seed, "threshold", "node_id")
    elif kind == "uniform":
        t = F.lit(mean - width) + F.lit(2 * width) * uniform(seed, "threshold", "node_id")
    elif kind == "fixed":
        t = F.lit(float(mean))
    else:
        raise ValueError(f"unknown kind of threshold: {kind}")
    return nodes.select("node_id", F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)).alias("threshold"))


def thresholds_hybrid(nodes: DataFrame, base: float, vulnerable: float, fraction: float, seed: int = 42) -> DataFrame:
    """(node_id, threshold): ``vulnerable`` for the floor(fraction * n) nodes with the smallest numbers."""
    few = smallest(nodes.select("node_id"), uniform(seed, "vulnerable", "node_id"), int(fraction * nodes.count()), ["node_id"])
    t = F.when(F.col("_picked"), float(vulnerable)).otherwise(float(base))
    return nodes.select("node_id").join(few.withColumn("_picked", F.lit(True)), "node_id", "left").select("node_id", t.alias("threshold"))


def _bits(mask: Column) -> Column:
    """The places of a mask's bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("shiftright", mask, b).bitwiseAND(1) == 1)


def _bit(place: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(place))


@dataclass
class Spreading:
    """State and adopters of all configurations."""

    look: DataFrame  # node_id, seen, and the values of a node
    configs: DataFrame  # config, word, bit, and the values of a configuration
    values: list[str]
    state: DataFrame
    adopters: list[DataFrame]  # node_id, word, new, step
    full: int | None = None  # all configurations' bits, if one word has them

    @classmethod
    def begin(cls, seeds: DataFrame, look: DataFrame, values: list[str], of_configs: DataFrame | None = None) -> Spreading:
        """Seeds have step 0 (what a seed looks at no longer matters)."""
        place = (F.row_number().over(Window.orderBy("config")) - 1).cast("int")
        configs = seeds.select("config").distinct().withColumn("_place", place)
        configs = configs.select("config", F.floor(F.col("_place") / WORD).cast("int").alias("word"), F.pmod("_place", F.lit(WORD)).alias("bit"))
        configs = stored(configs if of_configs is None else configs.join(of_configs, "config", "left"), "configs")
        blank = [F.lit(None).cast(look.schema[c].dataType).alias(c) for c in values]
        new = seeds.select("config", "node_id").join(configs, "config").groupBy("node_id", "word").agg(F.bit_or(_bit("bit")).alias("new"))
        state = stored(new.select("node_id", "word", F.col("new").alias("done"), "new", F.lit(None).cast("map<int,bigint>").alias("waits"), *blank), "state")
        words = configs.groupBy("word").agg(F.bit_or(_bit("bit")).alias("full")).limit(2).collect()
        run = cls(look, configs, values, state, [], words[0].full if len(words) == 1 else None)
        run._take(0)
        return run

    def _take(self, step: int) -> None:
        front = self.state.where("new <> 0").select("node_id", "word", "new", F.lit(step).alias("step"))
        self.adopters.append(stored(front, "adopters"))
        if len(self.adopters) > 16:
            self.adopters = [stored(self._all(), "adopters"), self.adopters[-1]]

    def _all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.adopters[:-1])

    def told(self) -> DataFrame:
        """(node_id, word, done, bit, n, values, config and its values): the adopters that each node sees that
        hasn't adopted itself, after the newest have been added; a row without bit where it has in all."""
        front = self.adopters[-1].select(F.col("node_id").alias("seen"), "word", F.col("new").alias("told"))
        sent = self.look.join(front, "seen").select("node_id", "word", "told", *self.values)
        rows = sent.unionByName(self.state.drop("new"), allowMissingColumns=True)
        once = [F.max(c).alias(c) for c in self.values]
        g = rows.groupBy("node_id", "word").agg(F.collect_list("told").alias("told"), F.coalesce(F.max("done"), F.lit(0)).alias("done"), F.first("waits", ignorenulls=True).alias("waits"), *once)
        some = F.aggregate("told", F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)).bitwiseAND(F.bitwise_not("done"))
        asked = F.array_union(_bits(some), F.coalesce(F.map_keys("waits"), F.array().cast("array<int>")))
        e = g.withColumn("bit", F.explode_outer(asked))
        more = F.size(F.filter("told", lambda m: F.call_function("shiftright", m, F.col("bit")).bitwiseAND(1) == 1))
        n = F.coalesce(F.try_element_at("waits", F.col("bit")), F.lit(0).cast("long")) + more
        return e.withColumn("n", n).drop("told", "waits").join(self.configs, ["word", "bit"], "left")

    def advance(self, told: DataFrame, adopts: Column, step: int) -> bool:
        """Takes those as adopters of the step for whom ``adopts`` holds; whether there are any."""
        yes = F.coalesce(adopts, F.lit(False))
        once = [F.max(c).alias(c) for c in self.values]
        new = F.coalesce(F.bit_or(F.when(yes, _bit("bit"))), F.lit(0).cast("long")).alias("new")
        waits = F.collect_list(F.when(F.col("bit").isNotNull() & ~yes, F.struct("bit", "n"))).alias("waits")
        s = told.groupBy("node_id", "word").agg(F.max("done").alias("done"), new, waits, *once)
        s = s.select("node_id", "word", F.col("done").bitwiseOR(F.col("new")).alias("done"), "new", F.map_from_entries("waits").alias("waits"), *self.values)
        seen = Observation()
        s = stored(s.observe(seen, F.count("*").alias("n"), F.count_if(F.col("done") == F.lit(self.full)).alias("over")), "state")
        drop(self.state)
        self.state = s
        self._take(step)
        if seen.get["over"] >= max(PRUNED, seen.get["n"] / 2):
            self._prune()
        return not self.adopters[-1].isEmpty()

    def _prune(self) -> None:
        """Takes out nodes that have adopted in all configurations, with what they look at. It is done
        when they are half of the state, so state and links that steps read shrink at each time."""
        over = F.col("done") == F.lit(self.full)
        self.look = stored(self.look.join(self.state.where(over).select("node_id"), "node_id", "left_anti"), "look")
        rest = stored(self.state.where(~over), "state")
        drop(self.state)
        self.state = rest

    def adopted(self) -> DataFrame:
        """(config, node_id, step) of all adopters."""
        a = reduce(DataFrame.unionByName, self.adopters).select("node_id", "word", F.explode(_bits(F.col("new"))).alias("bit"), "step")
        return a.join(self.configs.select("config", "word", "bit"), ["word", "bit"]).select("config", "node_id", "step")


@scoped
def threshold_contagion(
    edges: DataFrame,
    seeds: DataFrame,
    threshold: DataFrame,
    relative: bool = True,
    directed: bool = True,
    max_steps: int = 1000,
    of_nodes: DataFrame | None = None,
    level: Column | None = None,
) -> DataFrame:
    """(config, node_id, step) of all adopters; seeds have step 0.

    ``threshold`` has node_id and threshold, config and threshold, or both
    keys. Where thresholds follow from a value of the node and one of the
    configuration, ``of_nodes`` has node_id and its values, ``threshold`` config and
    its values, and ``level`` is the threshold as an expression of them. A node
    adopts once its count of adopters seen (over its number of nodes looked at if
    ``relative``) reaches its threshold; nodes that look at none never do in relative
    mode. Ends when no configuration changes, or after ``max_steps``.
    """
    level = F.col("threshold") if level is None else level
    if of_nodes is None and "config" not in threshold.columns:
        of_nodes = threshold
    look = looked_at(edges, directed)
    look = look.join(look.groupBy("node_id").agg(F.count("*").alias("k")), "node_id")
    values = ["k"]
    if of_nodes is not None:
        look = look.join(of_nodes, "node_id")
        values += [c for c in of_nodes.columns if c != "node_id"]
    look = stored(look, "look")
    keys = [c for c in ("config", "node_id") if c in threshold.columns] if threshold is not of_nodes else []
    by_config = keys == ["config"]
    run = Spreading.begin(seeds, look, values, threshold if by_config else None)
    for step in range(1, max_steps + 1):
        told = run.told()
        if keys and not by_config:
            told = told.join(threshold, keys, "left")
        value = F.col("n") / F.col("k") if relative else F.col("n").cast("double")
        if not run.advance(told, F.col("bit").isNotNull() & (value >= level), step):
            break
    return stored(run.adopted(), "adopted")


@scoped
def simple_contagion(edges: DataFrame, seeds: DataFrame, p_transmit: float = 0.2, max_steps: int = 30, directed: bool = True, seed: int = 42) -> DataFrame:
    """(config, node_id, step): each step a node with n infected nodes seen is
    infected with probability 1 - (1 - p)^n; all ``max_steps`` steps are run."""
    look = stored(looked_at(edges, directed), "look")
    run = Spreading.begin(seeds, look, [])
    for step in range(1, max_steps + 1):
        told = run.told()
        hit = uniform(seed, "transmit", "config", F.lit(step), "node_id") < 1 - F.pow(F.lit(1.0 - p_transmit), F.col("n"))
        run.advance(told, F.col("bit").isNotNull() & hit, step)
    return stored(run.adopted(), "adopted")


def series(adopted: DataFrame, last: int | None = None) -> DataFrame:
    """(config, step, infected) for every step up to ``last`` (else the latest
    of all configurations); a configuration that ended earlier keeps its value."""
    n = adopted.groupBy("config", "step").agg(F.count("*").alias("new"))
    end = F.lit(last) if last is not None else F.max("step").over(Window.partitionBy())
    ends = n.withColumn("end", end.cast("int")).groupBy("config").agg(F.max("end").alias("end"))
    grid = ends.select("config", F.explode(F.sequence(F.lit(0), "end")).alias("step"))
    full = grid.join(n, ["config", "step"], "left").na.fill(0, ["new"])
    upto = Window.partitionBy("config").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.select("config", "step", F.sum("new").over(upto).alias("infected"))


def series_summary(series_: DataFrame, config_group: Column) -> DataFrame:
    """(grp, step, mean, std): over the configurations of each group, population std."""
    return series_.groupBy(config_group.alias("grp"), "step").agg(F.avg("infected").alias("mean"), F.stddev_pop("infected").alias("std"))


def final_adoption(adopted: DataFrame, configs: DataFrame) -> DataFrame:
    """Adds infected (0 without adopters) to the configurations."""
    return configs.join(adopted.groupBy("config").agg(F.count("*").alias("infected")), "config", "left").na.fill(0, ["infected"])


def sweep_summary(finals: DataFrame, by: list[str]) -> DataFrame:
    """mean, median, population variance, min and max of final adoption for each cell of a sweep."""
    x = F.col("infected").cast("double")
    return finals.groupBy(*by).agg(
        F.avg(x).alias("mean_final_adoption"),
        F.percentile(x, F.lit(0.5)).alias("median_final_adoption"),
        F.var_pop(x).alias("variance_final_adoption"),
        F.min("infected").alias("min_final_adoption"),
        F.max("infected").alias("max_final_adoption"),
        F.count("*").alias("n_runs"),
    )


def curve_summary(curve: DataFrame, by: list[str], x: str, y: str, target: float = 0.5) -> DataFrame:
    """Per curve: critical, the x at which y crosses ``target``; the area under
    it by trapezoids; and the largest absolute gradient.

    A curve that ends lower than it begins crosses after its last point at or
    above the target, others before their first one; null if all points are on
    one side. Gradients are second-order inside, for uneven steps too, and
    one-sided at the ends.
    """
    whole = Window.partitionBy(*by)
    c = curve.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    near = whole.orderBy("x")
    c = c.withColumn("i", F.row_number().over(near) - 1)
    c = c.withColumns({f"{k}{j}": f(k).over(near) for k in "xy" for j, f in ((0, F.lag), (1, F.lead))})
    above = F.col("y") >= target
    ends = F.min_by("y", "x").over(whole) > F.max_by("y", "x").over(whole)
    at = F.when(ends, F.max(F.when(above, F.col("i"))).over(whole)).otherwise(F.greatest(F.min(F.when(above, F.col("i"))).over(whole) - 1, F.lit(0)))
    c = c.withColumns({"at": at, "mixed": F.min(above).over(whole) != F.max(above).over(whole)})
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    crossing = F.when(F.col("x1").isNull(), F.col("x")).when(F.abs(dy) < 1e-10, (F.col("x") + F.col("x1")) / 2).otherwise(F.col("x") + (target - F.col("y")) * dx / dy)
    lower, upper = F.col("x") - F.col("x0"), dx
    inner = (lower * lower * F.col("y1") + (upper * upper - lower * lower) * F.col("y") - upper * upper * F.col("y0")) / (lower * upper * (upper + lower))
    slope = F.when(F.col("x0").isNull(), dy / dx).when(F.col("x1").isNull(), (F.col("y") - F.col("y0")) / lower).otherwise(inner)
    g = c.withColumns({"crossing": F.when(F.col("mixed") & (F.col("i") == F.col("at")), crossing), "slope": slope}).groupBy(*by)
    return g.agg(F.max("crossing").alias("critical"), F.sum(dx * (F.col("y") + F.col("y1")) / 2).alias("auc"), F.max(F.abs("slope")).alias("steepness"))


def cascade_points(runs: DataFrame, by: list[str], x: str, value: str, target: float) -> DataFrame:
    """Per curve and x: mean and population std of the runs, and cascade_prob, their share above ``target``."""
    v = F.col(value).cast("double")
    return runs.groupBy(*by, x).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg((v > target).cast("double")).alias("cascade_prob"))


def strategy_candidates(metrics: DataFrame, members: DataFrame, strategy: str, total: int, share: float = 0.01) -> DataFrame:
    """node_id of the groups that a seeding strategy picks: by descending score
    until their sizes reach ``share`` of ``total``; "random" takes everyone.

    metrics has a row for each group (group_id, size and the strategies'
    columns), members has node_id and group_id.
    """
    if strategy == "random":
        return members.select("node_id")
    upto = F.sum("size").over(Window.orderBy(F.desc(strategy), "group_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = metrics.withColumn("_upto", upto).where(F.col("_upto") - F.col("size") < share * total).select("group_id")
    return members.join(chosen, "group_id", "left_semi").select("node_id")


@scoped
def strategy_sweep(edges: DataFrame, nodes: DataFrame, members: DataFrame, metrics: DataFrame, strategies: list[str], thresholds: list[float], runs: int, share: float = 0.01, max_steps: int = 1000, seed: int = 42) -> DataFrame:
    """(strategy, threshold_idx, threshold, median_final_adoption, n_runs): every
    strategy and threshold in one contagion. A strategy with fewer candidates
    than seeds falls back to all nodes."""
    spark = edges.sparkSession
    n = nodes.count()
    initial = int(n * share)
    rows, seeds = [], None
    for s, strategy in enumerate(strategies):
        own = [(len(rows) + t * runs + r, strategy, t, float(v)) for t, v in enumerate(thresholds) for r in range(runs)]
        rows += own
        configs = spark.createDataFrame([(c,) for c, *_ in own], "config long")
        part = seed_from(configs, strategy_candidates(metrics, members, strategy, n, share), nodes, initial, seed + s)
        seeds = part if seeds is None else seeds.unionByName(part)
    configs = spark.createDataFrame(rows, "config long, strategy string, threshold_idx int, threshold double")
    adopted = threshold_contagion(edges, seeds, configs.select("config", "threshold"), max_steps=max_steps)
    finals = final_adoption(adopted, configs)
    return finals.groupBy("strategy", "threshold_idx", "threshold").agg(F.percentile(F.col("infected").cast("double"), F.lit(0.5)).alias("median_final_adoption"), F.count("*").alias("n_runs"))


def _sweep(spark: SparkSession, runs: int, **values: list) -> DataFrame:
    """Configurations of a sweep: every combination of values, ``runs`` times."""
    g = grid(spark, **values).withColumnRenamed("config", "cell")
    return g.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("config", F.col("cell") * runs + F.col("run")).drop("cell")


def _percent(adopted: DataFrame, configs: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.count()
    return final_adoption(adopted, configs).withColumn("percent", 100.0 * F.col("infected") / n).drop("config", "infected")


@scoped
def sweep_uncontested(edges: DataFrame, nodes: DataFrame, thresholds: list[float] = (1, 2, 3, 4, 5), runs: int = 20, max_steps: int = 50, seed: int = 42) -> DataFrame:
    """(threshold, run, percent) of absolute thresholds: up to 1 from one random node,
    above from a random node and its successors."""
    c = _sweep(edges.sparkSession, runs, threshold=list(thresholds))
    low, high = c.where("threshold <= 1"), c.where("threshold > 1")
    seeds = seed_random(low, nodes, 1, seed).unionByName(seed_focals(high, edges, nodes, seed))
    return _percent(threshold_contagion(edges, seeds, c.select("config", "threshold"), relative=False, max_steps=max_steps), c, nodes)


@scoped
def sweep_contested(edges: DataFrame, nodes: DataFrame, fractions: list[float], runs: int = 20, max_steps: int = 50, seed: int = 42) -> DataFrame:
    """(threshold, run, percent) of thresholds as shares, from a random node and its successors."""
    c = _sweep(edges.sparkSession, runs, threshold=list(fractions))
    return _percent(threshold_contagion(edges, seed_focals(c, edges, nodes, seed), c.select("config", "threshold"), max_steps=max_steps), c, nodes)


@scoped
def sweep_hybrid(edges: DataFrame, nodes: DataFrame, fractions: list[float], base: float = 2, vulnerable: float = 1, runs: int = 20, max_steps: int = 50, seed: int = 42) -> DataFrame:
    """(fraction, run, percent): absolute thresholds, lower for the floor(fraction * n)
    nodes with the smallest numbers, from a random node and its successors."""
    c = _sweep(edges.sparkSession, runs, fraction=list(fractions))
    n = nodes.count()
    placed = stored(numbered(nodes.select("node_id"), [], uniform(seed, "vulnerable", "node_id"), ["node_id"], "place"), "places")
    level = F.when(F.col("place") < F.floor(F.col("fraction") * n), float(vulnerable)).otherwise(float(base))
    seeds = seed_focals(c, edges, nodes, seed)
    adopted = threshold_contagion(edges, seeds, c.select("config", "fraction"), relative=False, max_steps=max_steps, of_nodes=placed, level=level)
    return _percent(adopted, c, nodes)


@scoped
def sweep_combined(edges: DataFrame, nodes: DataFrame, thresholds: list[float], seed_fractions: list[float], runs: int = 10, max_steps: int = 50, seed: int = 42) -> DataFrame:
    """(threshold, seed_fraction, mean_percent): thresholds as shares by random seeds of a share of all nodes, one at least."""
    n = nodes.count()
    c = _sweep(edges.sparkSession, runs, threshold=list(thresholds), seed_fraction=list(seed_fractions))
    sized = c.withColumn("initial", F.greatest(F.floor(F.col("seed_fraction") * n), F.lit(1)).cast("int"))
    adopted = threshold_contagion(edges, seed_sized(sized, nodes, seed), c.select("config", "threshold"), max_steps=max_steps)
    return _percent(adopted, c, nodes).groupBy("threshold", "seed_fraction").agg(F.avg("percent").alias("mean_percent"))


@scoped
def compare_topologies(edges: DataFrame, initial: int, threshold: float = 0.25, runs: int = 50, max_steps: int = 1000, seed: int = 42) -> DataFrame:
    """Complex contagion from random seeds on every network of ``edges`` (network,
    src, dst; nodes are those with an edge), all networks and runs in one
    contagion: network, run, infected and n_nodes."""
    node = F.struct("network", F.col("id").alias("id"))
    nodes = edges.select("network", F.explode(F.array("src", "dst")).alias("id")).distinct()
    placed = stored(numbered(nodes, ["network"], uniform(seed, "place", "network", "id"), ["id"], "place"), "places")
    spark = edges.sparkSession
    keyed = edges.select(F.struct("network", F.col("src").alias("id")).alias("src"), F.struct("network", F.col("dst").alias("id")).alias("dst"))
    numbers = spark.range(runs).select(F.col("id").alias("config"))
    n = placed.groupBy("network").agg(F.count("*").alias("n_nodes"))
    asked = n.crossJoin(F.broadcast(numbers)).select("network", "config", F.col("n_nodes").alias("n"), F.lit(initial).alias("initial"))
    places = drawn(stored(asked, "asked"), ["network", "config"], seed)
    seeds = places.join(placed, ["network", "place"]).select("config", node.alias("node_id"))
    adopted = threshold_contagion(keyed, seeds, numbers.withColumn("threshold", F.lit(threshold)), max_steps=max_steps)
    count = adopted.groupBy("config", F.col("node_id.network").alias("network")).agg(F.count("*").alias("infected"))
    every = n.crossJoin(F.broadcast(numbers))
    return every.join(count, ["network", "config"], "left").select("network", F.col("config").alias("run"), F.coalesce("infected", F.lit(0)).alias("infected"), "n_nodes")
