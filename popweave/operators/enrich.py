"""Enrichment: attributes drawn from conditional probability tables.

Tables are small frames (condition, category, p); a draw is the category in
whose stretch of the running sum the node's own number falls. Income and
marital status also look at neighbours that were drawn before: nodes are drawn
in waves by descending degree, and a wave sees the waves before it. With as
many waves as nodes this is the sequential rule; fewer waves see less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from popweave.functions.rng import uniform
from popweave.operators.metrics import degrees
from popweave.operators.population import five_year_bracket
from popweave.sources.scratch import drop, scoped, stored

# The published conditional probability tables of the domain.
AGE_RANGES = {"[0,20)": (0, 19), "[20,30)": (20, 29), "[30,40)": (30, 39), "[40,50)": (40, 49), "[50,60)": (50, 59), "[60,70)": (60, 69), "[70,80)": (70, 79), "[80,120]": (80, 99)}
INCOME = ["Laag (<20k)", "Modaal (20-35k)", "Midden (35-55k)", "Hoog (>55k)"]
NOT_APPLICABLE = "Niet van toepassing"
INCOME_BY_EDUCATION = {1: (0.40, 0.42, 0.15, 0.03), 2: (0.15, 0.42, 0.33, 0.10), 3: (0.05, 0.20, 0.38, 0.37)}
INCOME_BY_AGE = ((25, (2.20, 1.30, 0.35, 0.05)), (35, (1.40, 1.40, 0.75, 0.40)), (50, (0.75, 0.95, 1.25, 1.60)), (65, (0.85, 1.00, 1.15, 1.25)), (999, (1.60, 1.35, 0.65, 0.20)))
INCOME_DECAY, INCOME_STRENGTH = (1.00, 0.50, 0.15, 0.04), 0.35
WORK = {
    "[0,20)": {"Student/kind": 1.0},
    "[20,30)": {"Werkend (voltijd)": 0.45, "Werkend (deeltijd)": 0.15, "Student": 0.25, "Werkloos": 0.10, "ZZP": 0.05},
    "[30,40)": {"Werkend (voltijd)": 0.58, "Werkend (deeltijd)": 0.18, "ZZP": 0.10, "Werkloos": 0.08, "Thuiszorgend": 0.06},
    "[40,50)": {"Werkend (voltijd)": 0.60, "Werkend (deeltijd)": 0.16, "ZZP": 0.10, "Werkloos": 0.07, "Arbeidsongeschikt": 0.07},
    "[50,60)": {"Werkend (voltijd)": 0.52, "Werkend (deeltijd)": 0.15, "ZZP": 0.08, "Werkloos": 0.10, "Arbeidsongeschikt": 0.08, "Gepensioneerd": 0.07},
    "[60,70)": {"Gepensioneerd": 0.55, "Werkend (deeltijd)": 0.14, "Werkend (voltijd)": 0.09, "ZZP": 0.07, "Arbeidsongeschikt": 0.08, "Werkloos": 0.07},
    "[70,80)": {"Gepensioneerd": 0.90, "Werkend (deeltijd)": 0.05, "Arbeidsongeschikt": 0.05},
    "[80,120]": {"Gepensioneerd": 0.95, "Arbeidsongeschikt": 0.05},
}
WORK_BY_EDUCATION = {
    1: {"Werkend (voltijd)": 0.80, "ZZP": 0.70, "Werkloos": 1.60, "Arbeidsongeschikt": 1.60, "Thuiszorgend": 1.30, "Student": 0.60, "Werkend (deeltijd)": 1.10},
    3: {"Werkend (voltijd)": 1.25, "ZZP": 1.40, "Werkloos": 0.55, "Arbeidsongeschikt": 0.50, "Thuiszorgend": 0.60, "Student": 1.60, "Werkend (deeltijd)": 0.85},
}
WORK_BY_INCOME = {
    "Laag (<20k)": {"Werkend (voltijd)": 0.50, "ZZP": 0.60, "Werkloos": 2.20, "Arbeidsongeschikt": 2.00, "Thuiszorgend": 1.80, "Werkend (deeltijd)": 1.40},
    "Modaal (20-35k)": {"Werkend (voltijd)": 1.00, "ZZP": 0.90, "Werkloos": 0.80, "Arbeidsongeschikt": 0.80, "Thuiszorgend": 0.90, "Werkend (deeltijd)": 1.10},
    "Midden (35-55k)": {"Werkend (voltijd)": 1.30, "ZZP": 1.20, "Werkloos": 0.40, "Arbeidsongeschikt": 0.40, "Thuiszorgend": 0.50, "Werkend (deeltijd)": 0.80},
    "Hoog (>55k)": {"Werkend (voltijd)": 1.50, "ZZP": 1.80, "Werkloos": 0.15, "Arbeidsongeschikt": 0.15, "Thuiszorgend": 0.20, "Werkend (deeltijd)": 0.55},
}
EARLY = "Gepensioneerd (<67)"
BENEFIT = {EARLY: {"AOW": 0.40, "AIO": 0.60}, "Werkloos": {"WW": 0.55, "Bijstand": 0.45}, "Arbeidsongeschikt": {"WAO/WIA": 1.0}, "Thuiszorgend": {"Bijstand": 0.65, "WW": 0.35}, "Gepensioneerd": {"AOW": 0.85, "AIO": 0.15}}
MARITAL = ["Ongehuwd", "Samenwonend", "Gehuwd", "Gescheiden", "Weduwe/weduwnaar"]
MARITAL_BY_AGE = {
    "[0,20)": (1.0, 0.0, 0.0, 0.0, 0.0),
    "[20,30)": (0.65, 0.22, 0.10, 0.03, 0.0),
    "[30,40)": (0.28, 0.20, 0.42, 0.10, 0.0),
    "[40,50)": (0.18, 0.14, 0.48, 0.17, 0.03),
    "[50,60)": (0.13, 0.10, 0.50, 0.20, 0.07),
    "[60,70)": (0.09, 0.08, 0.52, 0.16, 0.15),
    "[70,80)": (0.07, 0.0, 0.47, 0.10, 0.36),
    "[80,120]": (0.05, 0.0, 0.33, 0.07, 0.55),
}
MARITAL_DECAY, MARITAL_STRENGTH = (1.00, 0.70, 0.45, 0.25, 0.15), 0.20


def draw(rows: DataFrame, weights: DataFrame, on: list[str], u: Column, out: str, key: str = "node_id") -> DataFrame:
    """Adds ``out``: the category (in order of ``pos``) whose part of the running weight holds ``u``.

    ``weights`` has the columns of ``on``, pos, category and p (not normalised);
    rows without weights get null.
    """
    w = Window.partitionBy(*on).orderBy("pos")
    upto = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("p").over(Window.partitionBy(*on))
    stretch = weights.where("p > 0").select(*on, "category", (upto / total).alias("high"), ((upto - F.col("p")) / total).alias("low"))
    table = stretch.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("high", "category"))).alias("_t"))
    hit = F.filter("_t", lambda x: x["high"] > F.col("_u"))
    pick = F.coalesce(F.get(hit, F.lit(0)), F.element_at("_t", -1))
    return rows.withColumn("_u", u).join(F.broadcast(table), on, "left").withColumn(out, pick["category"]).drop("_u", "_t")


def ages(nodes: DataFrame, bracket: str = "lft", seed: int = 42) -> DataFrame:
    """Adds age, uniform in the bracket, and age_bracket_5yr (null for an unknown bracket)."""
    low = F.create_map(*[x for k, (a, _) in AGE_RANGES.items() for x in (F.lit(k), F.lit(a))])
    wide = F.create_map(*[x for k, (a, b) in AGE_RANGES.items() for x in (F.lit(k), F.lit(b - a + 1))])
    age = F.try_element_at(low, F.col(bracket)) + F.floor(uniform(seed, "age", "node_id") * F.try_element_at(wide, F.col(bracket)))
    out = nodes.withColumn("age", age.cast("int"))
    return out.withColumn("age_bracket_5yr", F.when(F.col("age").isNotNull(), five_year_bracket(F.col("age"))))


def _table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _by_waves(nodes: DataFrame, edges: DataFrame, base: DataFrame, strength: float, decay: tuple[float, ...], out: str, seed: int, waves: int) -> DataFrame:
    """(node_id, code): draws from ``base`` (node_id, code, p normalised) blended
    with the decayed shares of neighbours' codes; neighbours of any direction
    that were drawn in earlier waves count.
    """
    d = degrees(nodes, edges).join(base.select("node_id").distinct(), "node_id", "left_semi")
    total = d.count()
    # A wave is a range of degrees' ranks, found from counts by degree instead of a sort of all nodes.
    hist = d.groupBy("degree").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("degree").orderBy("node_id")) - 1
    wave = F.floor((F.col("before") + rank) * waves / max(total, 1)).cast("int")
    placed = stored(d.join(F.broadcast(hist.select("degree", before.alias("before"))), "degree").select("node_id", wave.alias("wave")), "waves")
    near = stored(edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).union(edges.select("dst", "src")), "near")
    codes = base.select("code").distinct()
    kernel = codes.crossJoin(F.broadcast(codes.select(F.col("code").alias("seen")))).withColumn("k", F.get(F.array(*map(F.lit, decay)), F.abs(F.col("code") - F.col("seen"))))
    done: DataFrame | None = None
    for i in range(waves):
        own = placed.where(F.col("wave") == i).select("node_id")
        p = base.join(own, "node_id", "left_semi")
        if done is not None:
            seen = near.join(own, "node_id", "left_semi").join(done.select(F.col("node_id").alias("other"), F.col("code").alias("seen")), "other").groupBy("node_id", "seen").agg(F.count("*").alias("n"))
            hom = seen.join(F.broadcast(kernel), "seen").groupBy("node_id", "code").agg(F.sum(F.col("n") * F.col("k")).alias("h"))
            h = hom.withColumn("h", F.col("h") / F.sum("h").over(Window.partitionBy("node_id")))
            p = p.join(h, ["node_id", "code"], "left").withColumn("p", F.when(F.col("h").isNull(), F.col("p")).otherwise((1 - strength) * F.col("p") + strength * F.when(F.col("p") > 0, F.col("h")).otherwise(0.0))).drop("h")
        by = Window.partitionBy("node_id")
        upto = F.sum("p").over(by.orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        u = uniform(seed, out, "node_id") * F.sum("p").over(by)
        hit = p.withColumns({"upto": upto, "u": u}).where("p > 0").groupBy("node_id").agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("u"), F.col("code"))), F.max("code")).alias("code"))
        done = stored(hit if done is None else done.unionByName(hit), out)
    return done


@scoped
def _in_order(nodes: DataFrame, edges: DataFrame, base: DataFrame, strength: float, decay: tuple[float, ...], out: str, seed: int) -> DataFrame:
    """(node_id, code): as if nodes were drawn one by one by descending degree, then id, each from ``base``
    (node_id, code, p normalised) blended with the decayed shares of the codes that its neighbours of any
    direction have by then.

    A node waits only for its neighbours of higher rank, so all nodes whose last such neighbour
    has been drawn are drawn in the same round; rounds are as many as the longest chain of
    neighbours of falling rank has members. State is a row for each node: how many it waits
    for, how many of each code it has seen, its code and the round it was drawn in. A round joins
    only the newest drawn with those who wait for them.
    """
    size = len(decay)
    codes = F.sequence(F.lit(0), F.lit(size - 1))
    known = base.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "p"))).alias("m"))
    known = known.select("node_id", F.transform(codes, lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0))).alias("p"))
    d = stored(degrees(nodes, edges).join(known, "node_id").select("node_id", "degree", "p"), "ranked")
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).where("node_id <> other").distinct()
    other = d.select(F.col("node_id").alias("other"), F.col("degree").alias("degree_o"))
    above = (F.col("degree_o") > F.col("degree")) | ((F.col("degree_o") == F.col("degree")) & (F.col("other") < F.col("node_id")))
    high = stored(both.join(d.select("node_id", "degree"), "node_id").join(other, "other").where(above).select("node_id", "other"), "higher")
    waits = high.groupBy("node_id").agg(F.count("*").alias("left"))
    none = F.array_repeat(F.lit(0).cast("long"), size)
    state = d.join(waits, "node_id", "left").select("node_id", "p", F.coalesce("left", F.lit(0)).alias("left"), none.alias("seen"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("int").alias("turn"))

    kernel = F.array(*(F.array(*(F.lit(decay[abs(c - s)]) for s in range(size))) for c in range(size)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    near = F.transform(codes, lambda c: total(F.zip_with(kernel[c], F.col("seen"), lambda k, n: k * n)))
    blend = F.transform(codes, lambda c: F.when(F.col("_all") == 0, F.col("p")[c]).otherwise((1 - strength) * F.col("p")[c] + strength * F.when(F.col("p")[c] > 0, F.col("_near")[c] / F.col("_all")).otherwise(0.0)))
    upto = lambda c: total(F.slice("_blend", F.lit(1), c + 1))
    u = uniform(seed, out, "node_id") * total(F.col("_blend"))
    over = F.filter(codes, lambda c: (F.col("_blend")[c] > 0) & (upto(c) > F.col("_u")))
    last = F.filter(codes, lambda c: F.col("_blend")[c] > 0)
    turn = 0
    while True:
        if turn:
            fresh = state.where(F.col("turn") == turn - 1).select(F.col("node_id").alias("other"), F.col("code").alias("code_o"))
            told = high.join(fresh, "other").groupBy("node_id").agg(F.count("*").alias("dec"), F.array(*(F.count_if(F.col("code_o") == c) for c in range(size))).alias("more"))
            now = state.join(told, "node_id", "left").withColumns({"left": F.col("left") - F.coalesce("dec", F.lit(0)), "seen": F.coalesce(F.zip_with("seen", "more", lambda a, b: a + b), "seen")})
        else:
            now = state
        ready = F.col("code").isNull() & (F.col("left") == 0)
        now = now.withColumn("_near", near).withColumn("_all", total(F.col("_near"))).withColumn("_blend", blend).withColumn("_u", u)
        drawn = F.coalesce(F.get(over, F.lit(0)), F.element_at(last, -1)).cast("int")
        now = now.select("node_id", "p", "left", "seen", F.when(ready, drawn).otherwise(F.col("code")).alias("code"), F.when(ready, turn).otherwise(F.col("turn")).alias("turn"))
        rest = Observation()
        new = stored(now.observe(rest, F.count_if(F.col("turn").isNull()).alias("n")), "drawn")
        if turn:
            drop(state)
        state, turn = new, turn + 1
        if not rest.get["n"]:
            return state.where("code IS NOT NULL").select("node_id", "code")


def _drawn(nodes: DataFrame, edges: DataFrame, base: DataFrame, strength: float, decay: tuple[float, ...], out: str, seed: int, waves: int | None) -> DataFrame:
    if waves is None:
        return _in_order(nodes, edges, base, strength, decay, out, seed)
    return _by_waves(nodes, edges, base, strength, decay, out, seed, waves)


@scoped
def income(nodes: DataFrame, edges: DataFrame, seed: int = 42, waves: int | None = None) -> DataFrame:
    """Adds inkomensniveau: below 20 not applicable; else by education and age,
    blended with neighbours' bands, node by node in order of degree (in so many ``waves`` if given)."""
    spark = nodes.sparkSession
    grown = nodes.where("age >= 20")
    edu = _table(spark, [(e, i, p) for e, ps in INCOME_BY_EDUCATION.items() for i, p in enumerate(ps)], "oplniv int, code int, p double")
    age = _table(spark, [(k, i, m) for k, (_, ms) in enumerate(INCOME_BY_AGE) for i, m in enumerate(ms)], "step int, code int, m double")
    step = F.lit(len(INCOME_BY_AGE) - 1)
    for k in range(len(INCOME_BY_AGE) - 1, -1, -1):
        step = F.when(F.col("age") < INCOME_BY_AGE[k][0], k).otherwise(step)
    base = grown.select("node_id", "oplniv", step.alias("step")).join(F.broadcast(edu), "oplniv").join(F.broadcast(age), ["step", "code"])
    p = F.col("p") * F.col("m")
    base = stored(base.select("node_id", "code", (p / F.sum(p).over(Window.partitionBy("node_id"))).alias("p")), "income_base")
    drawn = _drawn(nodes, edges, base, INCOME_STRENGTH, INCOME_DECAY, "income", seed, waves)
    band = F.get(F.array(*map(F.lit, INCOME)), F.col("code"))
    return nodes.join(drawn, "node_id", "left").withColumn("inkomensniveau", F.coalesce(band, F.lit(NOT_APPLICABLE))).drop("code")


def work_weights(spark: SparkSession) -> DataFrame:
    """(lft, oplniv, inkomensniveau, pos, category, p): all products of the three tables."""
    rows = []
    for lft, base in WORK.items():
        for edu in (1, 2, 3):
            for band in (*INCOME, NOT_APPLICABLE):
                for pos, (category, p) in enumerate(base.items()):
                    rows.append((lft, edu, band, pos, category, p * WORK_BY_EDUCATION.get(edu, {}).get(category, 1.0) * WORK_BY_INCOME.get(band, {}).get(category, 1.0)))
    return _table(spark, rows, "lft string, oplniv int, inkomensniveau string, pos int, category string, p double")


def work_status(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """Adds arbeidsstatus by age, education and income."""
    return draw(nodes, work_weights(nodes.sparkSession), ["lft", "oplniv", "inkomensniveau"], uniform(seed, "work", "node_id"), "arbeidsstatus")


def benefits(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """Adds uitkeringstype by work status, for the retired also by age (below
    67 or not; a null age counts as 70); null where no benefit applies."""
    rows = [(w, pos, c, p) for w, table in BENEFIT.items() for pos, (c, p) in enumerate(table.items())]
    weights = _table(nodes.sparkSession, rows, "_status string, pos int, category string, p double")
    early = (F.col("arbeidsstatus") == "Gepensioneerd") & (F.col("age") < 67)
    keyed = nodes.withColumn("_status", F.when(early, EARLY).otherwise(F.col("arbeidsstatus")))
    return draw(keyed, weights, ["_status"], uniform(seed, "benefit", "node_id"), "uitkeringstype").drop("_status")


@scoped
def marital_status(nodes: DataFrame, edges: DataFrame, seed: int = 42, waves: int | None = None) -> DataFrame:
    """Adds burgerlijke_staat by age bracket, blended with neighbours', among what the bracket
    allows; in order as :func:`income`."""
    rows = [(lft, i, p) for lft, ps in MARITAL_BY_AGE.items() for i, p in enumerate(ps)]
    base = stored(nodes.select("node_id", "lft").join(F.broadcast(_table(nodes.sparkSession, rows, "lft string, code int, p double")), "lft").select("node_id", "code", "p"), "marital_base")
    drawn = _drawn(nodes, edges, base, MARITAL_STRENGTH, MARITAL_DECAY, "marital", seed, waves)
    return nodes.join(drawn, "node_id", "left").withColumn("burgerlijke_staat", F.get(F.array(*map(F.lit, MARITAL)), F.col("code"))).drop("code")


def income_distance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds income_distance, the difference of the ends' bands, null if either has none."""
    code = F.array_position(F.array(*map(F.lit, INCOME)), F.col("inkomensniveau"))
    c = nodes.select("node_id", F.when(code > 0, code).alias("band"))
    side = lambda end: c.select(F.col("node_id").alias(end), F.col("band").alias(f"_{end}"))
    return edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left").withColumn("income_distance", F.abs(F.col("_src") - F.col("_dst")).cast("int")).drop("_src", "_dst")


def distributions(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(attribute, value, n, share) of every attribute, nulls as a value."""
    long = nodes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*")
    n = long.groupBy("attribute", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("attribute")))


def edge_homophily(edges: DataFrame) -> DataFrame:
    """One row: edges with equal, different and unknown income bands."""
    d = F.col("income_distance")
    return edges.agg(F.count_if(d == 0).alias("same"), F.count_if(d > 0).alias("cross"), F.count_if(d.isNull()).alias("unknown"))
