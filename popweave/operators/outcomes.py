"""Statistics of simulation outcomes: decomposition, effects, ranks and tests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popweave.functions import distributions as dist
from popweave.functions.rng import digest, pick, quarter
from popweave.operators.sampling import cuts, piece, sums_before
from popweave.sources.scratch import scoped, stored


def parse_runs(text: str) -> Column:
    """'1,2,3' (perhaps in quotes) to array<bigint>; empty text to an empty array."""
    plain = F.trim(F.replace(F.col(text), F.lit('"'), F.lit("")))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, ","), lambda x: F.trim(x).cast("bigint")))


def decompose(runs: DataFrame, by: Sequence[str], value: str, size: Column, relative: float = 0.01) -> DataFrame:
    """Ignited and failed runs of each cell.

    A run is ignited at ``relative`` times the network's size (its largest run
    if ``size`` is null or not positive). Means and population deviations of
    both parts, Sarle's bimodality (null below four runs or without variance),
    the share of runs up to the first quartile, and by how much the parts fail
    to rebuild the mean.
    """
    v = F.col(value).cast("double")
    cell = Window.partitionBy(*by)
    r = runs.select(*by, v.alias("v"), size.cast("double").alias("_size"))
    net = F.max("_size").over(cell)
    r = r.withColumn("cutoff", relative * F.when(net > 0, net).otherwise(F.max("v").over(cell)))
    r = r.withColumns({"m": F.avg("v").over(cell), "q1": F.percentile("v", F.lit(0.25)).over(cell)})
    on, off = F.when(F.col("v") >= F.col("cutoff"), F.col("v")), F.when(F.col("v") < F.col("cutoff"), F.col("v"))
    power = lambda k: F.avg(F.pow(F.col("v") - F.col("m"), F.lit(k)))
    g = r.groupBy(*by).agg(
        F.count("*").alias("n_runs"),
        F.first("cutoff").alias("cutoff"),
        F.avg("v").alias("mean_raw"),
        F.var_pop("v").alias("var_raw"),
        (F.count(on) / F.count("*")).alias("p_ignite"),
        F.avg(on).alias("mean_ignited"),
        F.when(F.count(on) > 1, F.stddev_pop(on)).alias("std_ignited"),
        F.avg(off).alias("mean_failed"),
        F.when(F.count(off) > 1, F.stddev_pop(off)).alias("std_failed"),
        F.avg((F.col("v") <= F.col("q1")).cast("double")).alias("frac_at_seed"),
        power(2.0).alias("m2"),
        power(3.0).alias("m3"),
        power(4.0).alias("m4"),
    )
    n = F.col("n_runs")
    skew, kurt = F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / (F.col("m2") * F.col("m2")) - 3
    sarle = (skew * skew + 1) / (kurt + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))
    zero = F.lit(0.0)
    rebuilt = F.col("p_ignite") * F.coalesce("mean_ignited", zero) + (1 - F.col("p_ignite")) * F.coalesce("mean_failed", zero)
    return g.withColumn("bimodality", F.when((n >= 4) & (F.col("m2") > 0), sarle)).withColumn("mean_reconstruction_err", F.abs(rebuilt - F.col("mean_raw"))).drop("m2", "m3", "m4")


def variance_split(cells: DataFrame, by: Sequence[str], mean: str, variance: str, structure: str) -> DataFrame:
    """Between-structure and within-structure variance of each cell.

    between = sample variance of means, within = mean of variances; deviations,
    coefficients of variation (null at mean 0) and the share that is structural.
    """
    g = cells.groupBy(*by).agg(F.avg(mean).alias("mean_outcome"), F.coalesce(F.var_samp(mean), F.lit(0.0)).alias("b"), F.avg(variance).alias("w"), F.count("*").alias("n_networks"), F.countDistinct(structure).alias("n_structures"))
    total = F.col("b") + F.col("w")
    cv = lambda c: F.when(F.col("mean_outcome") != 0, F.sqrt(c) / F.col("mean_outcome"))
    return g.select(
        *by,
        "mean_outcome",
        F.sqrt("b").alias("between_sd"),
        F.sqrt("w").alias("within_sd"),
        F.sqrt(total).alias("total_sd"),
        cv(F.col("b")).alias("cv_between"),
        cv(F.col("w")).alias("cv_within"),
        F.when(total > 0, 100 * F.col("b") / total).alias("pct_structural"),
        "n_networks",
        "n_structures",
    )


def regression(points: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Least squares of y on x and on ln x in each cell: slope, intercept and r2 of
    both, and t of the first (null below three points)."""
    logx = F.when(F.col(x) > 0, F.log(x))
    n = F.regr_count(y, x)
    g = points.groupBy(*by).agg(
        n.alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_slope(F.col(y), logx).alias("log_slope"),
        F.regr_intercept(F.col(y), logx).alias("log_intercept"),
        F.regr_r2(F.col(y), logx).alias("log_r2"),
    )
    t = F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))
    return g.withColumn("t", F.when((F.col("n") > 2) & (F.col("r2") < 1), t))


def distance_to(rows: DataFrame, reference: dict[str, float], out: str = "distance") -> DataFrame:
    """Adds the Euclidean distance to a reference vector, each metric scaled by
    the mean and population deviation of all rows (0 counts as 1)."""
    stats = rows.agg(*(F.avg(c).alias(f"_m_{c}") for c in reference), *(F.stddev_pop(c).alias(f"_s_{c}") for c in reference))
    scaled = []
    for c, target in reference.items():
        s = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
        scaled.append(F.pow((F.col(c) - target) / s, F.lit(2.0)))
    total = scaled[0]
    for x in scaled[1:]:
        total = total + x
    return rows.crossJoin(F.broadcast(stats)).withColumn(out, F.sqrt(total)).drop(*(f"_{k}_{c}" for c in reference for k in "ms"))


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, ranked without ties."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def mid_ranks(rows: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank_mid") -> DataFrame:
    """Adds average ranks (ties share the mean of their places)."""
    w = Window.partitionBy(*by)
    r = F.rank().over(w.orderBy(value))
    same = F.count("*").over(Window.partitionBy(*by, value))
    return rows.withColumn(out, r + (same - 1) / 2)


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of x and y in each cell."""
    r = mid_ranks(mid_ranks(rows, x, by, "_rx"), y, by, "_ry")
    return r.groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman"))


def partial_correlation(rows: DataFrame, x: str, y: str, given: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of x and y after both are regressed on ``given``."""
    g = rows.groupBy(*by).agg(F.corr(x, y).alias("xy"), F.corr(x, given).alias("xz"), F.corr(y, given).alias("yz"))
    p = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return g.select(*by, F.col("xy").alias("pearson"), p.alias("partial"))


def tertile_slopes(rows: DataFrame, split: str, x: str, y: str) -> DataFrame:
    """Rows are cut at the thirds of ``split``; slope and correlation of y on x in each (null below three)."""
    cuts = rows.agg(F.percentile(split, F.lit(1 / 3)).alias("_a"), F.percentile(split, F.lit(2 / 3)).alias("_b"))
    part = F.when(F.col(split) <= F.col("_a"), 1).when(F.col(split) <= F.col("_b"), 2).otherwise(3)
    g = rows.crossJoin(F.broadcast(cuts)).groupBy(part.alias("tertile")).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s"), F.corr(y, x).alias("c"))
    return g.select("tertile", "n", F.when(F.col("n") >= 3, F.col("s")).alias("slope"), F.when(F.col("n") >= 3, F.col("c")).alias("corr"))


def equal_width_bins(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Adds bin 1..bins: right-closed intervals of equal width, the lowest value in the first."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width > 0, F.greatest(F.ceil((F.col(value) - F.col("_lo")) / width), F.lit(1))).otherwise(1)
    return rows.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(b, F.lit(bins)).cast("int")).drop("_lo", "_hi")


@scoped
def bootstrap_variance(runs: DataFrame, by: Sequence[str], index: str, value: str, samples: int = 200, seed: int = 42) -> DataFrame:
    """2.5 and 97.5 percentiles of the sample variance over resamples.

    ``index`` numbers the runs of a cell from 0. A draw is a counter-based index,
    joined back to its run. Resamples are dealt to tasks of about DRAWS draws before any
    is drawn, each whole to one; up to MOST_SENT runs are sent to all tasks, so draws aren't shuffled.
    """
    sizes = runs.groupBy(*by).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stored(sizes.withColumn("_first", before), "sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    values = runs.join(F.broadcast(sizes.select(*by, "_first")), list(by)).select((F.col("_first") + F.col(index)).alias("_at"), F.col(value).alias("_value"))
    tasks = min(max(math.ceil(total * samples / DRAWS), 1), 1 << 15)
    each = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("_b")).repartition(tasks, *by, "_b")
    blocks = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / 4))).alias("_q"))
    # One digest gives four draws of 32 bits.
    quarters = blocks.select(*by, "_n", "_first", "_b", "_q", digest(seed, "boot", *by, "_b", "_q").alias("_h")).withColumn("_j", F.explode(F.array(*map(F.lit, range(4)))))
    drawn = quarters.where(F.col("_q") * 4 + F.col("_j") < F.col("_n")).withColumn("_i", pick(quarter(F.col("_h"), F.col("_j")), F.col("_n")))
    drawn = drawn.select(*by, "_b", (F.col("_first") + F.col("_i")).alias("_at"))
    v = drawn.join(F.broadcast(values) if total <= MOST_SENT else values, "_at").groupBy(*by, "_b").agg(F.var_samp("_value").alias("_v"))
    return v.groupBy(*by).agg(F.percentile("_v", F.lit(0.025)).alias("low"), F.percentile("_v", F.lit(0.975)).alias("high"))


#: Draws of a task, and the runs (a long and a double each) that are sent to all tasks;
#: more are joined as the planner has it.
DRAWS, MOST_SENT = 1 << 22, 8_000_000


def kernel_density(rows: DataFrame, value: str, points: DataFrame, bandwidth: float) -> DataFrame:
    """(x, density) at the stated points: values are counted first, so the join is points times distinct values."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    z = (F.col("x") - F.col(value)) / bandwidth
    total = F.sum("_n")
    g = counts.crossJoin(F.broadcast(points.select("x"))).groupBy("x")
    return g.agg((F.sum(F.col("_n") * F.exp(-0.5 * z * z)) / (total * bandwidth * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def _with(df: DataFrame, columns: dict[str, tuple[Sequence[str], object]]) -> DataFrame:
    """Adds doubles computed row by row from columns; for test tables of a few rows."""
    schema = df
    for name in columns:
        schema = schema.withColumn(name, F.lit(None).cast("double"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, (inputs, fn) in columns.items():
                f[name] = [float("nan") if any(pd.isna(x) for x in row) else fn(*row) for row in zip(*(f[c] for c in inputs), strict=True)]
            yield f

    return df.mapInPandas(run, schema.schema)


def anova(runs: DataFrame, group: str, value: str) -> DataFrame:
    """One row: F, both degrees of freedom and p of equal means over groups."""
    g = runs.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    whole = Window.partitionBy()
    mean = F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole)
    s = g.withColumn("mean", mean).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), F.lit(2.0))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), (F.count("*") - 1).cast("double").alias("df1"), (F.sum("n") - F.count("*")).cast("double").alias("df2"))
    f = s.select((F.col("between") / F.col("df1") / (F.col("within") / F.col("df2"))).alias("f"), "df1", "df2")
    return _with(f, {"p": (("f", "df1", "df2"), dist.f_upper)})


def pairwise_t(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Every pair of groups: pooled t, p, Bonferroni p, and Cohen's d (over the root of the mean variance)."""
    g = runs.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    a, b = (g.select(F.col(group).alias(x), F.col("n").alias(f"n_{x}"), F.col("m").alias(f"m_{x}"), F.col("v").alias(f"v_{x}")) for x in "ab")
    p = a.join(b, F.col("a") < F.col("b"))
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / df
    gap = F.col("m_a") - F.col("m_b")
    d = gap / F.sqrt((F.col("v_a") + F.col("v_b")) / 2)
    t = gap / F.sqrt(pooled) / F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))
    out = _with(p.select("a", "b", t.alias("t"), df.cast("double").alias("df"), d.alias("cohen_d")), {"p": (("t", "df"), dist.t_two_sided)})
    return out.withColumn("p_bonferroni", F.least(F.col("p") * F.count("*").over(Window.partitionBy()), F.lit(1.0)))


def mann_whitney(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Every pair of groups: U of the first, rank-biserial correlation, z by the normal
    approximation with ties and continuity corrected, and p: exact where one group has at
    most dist.EXACT_BELOW values and none is tied, else of z.

    Ranks are running counts within pieces of the values' order, after the counts of the
    pieces before, so no task sorts all values of a pair.
    """
    counts = runs.groupBy(group, value).agg(F.count("*").alias("n")).withColumn("_piece", piece(value, cuts(runs, value)))
    names = runs.select(group).distinct()
    pairs = names.select(F.col(group).alias("a")).join(names.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    sides = pairs.select("a", "b", F.col("a").alias(group), F.lit(1).alias("_first")).unionByName(pairs.select("a", "b", F.col("b").alias(group), F.lit(0).alias("_first")))
    per = counts.join(sides, group).groupBy("a", "b", "_piece", value).agg(F.sum(F.col("n") * F.col("_first")).alias("na"), F.sum("n").alias("t"))
    ranked = sums_before(per, ["a", "b"], [value], "t", "rank").withColumn("rank", F.col("rank") + (F.col("t") + 1) / 2)
    s = ranked.groupBy("a", "b").agg(F.sum(F.col("na") * F.col("rank")).alias("ra"), F.sum("na").alias("n1"), F.sum(F.col("t") - F.col("na")).alias("n2"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("ra") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(u - n1 * n2 / 2) - 0.5) / sd
    out = s.select("a", "b", u.alias("u"), (2 * u / (n1 * n2) - 1).alias("rank_biserial"), F.greatest(z, F.lit(0.0)).alias("z"), n1.alias("_n1"), n2.alias("_n2"), F.col("ties").alias("_ties"))
    return _with(out, {"p": (("u", "z", "_n1", "_n2", "_ties"), dist.mann_whitney_two_sided)}).drop("_n1", "_n2", "_ties")


def between_map(cells: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """(by, std, rank): per point of the parameter space the sample deviation of the
    groups' means, the largest first."""
    m = cells.groupBy(*by, group).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.stddev_samp("m").alias("std"))
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("std"), *by)))


def profile_correlations(cells: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """(a, b, correlation) of every two groups' profiles over the points that both have."""
    p = cells.groupBy(*by, group).agg(F.avg(value).alias("y"))
    a, b = (p.select(*by, F.col(group).alias(x), F.col("y").alias(f"y_{x}")) for x in "ab")
    return a.join(b, list(by)).groupBy("a", "b").agg(F.corr("y_a", "y_b").alias("correlation"))


def ward_linkage(cells: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """(step, left, right, distance, size): Ward's merges of the groups' profiles.

    Groups are numbered in their order from 0, merged ones go on from there. Only
    the groups' mutual squared distances come to the driver (a row for each two).
    """
    p = cells.groupBy(*by, group).agg(F.avg(value).alias("y"))
    a, b = (p.select(*by, F.col(group).alias(x), F.col("y").alias(f"y_{x}")) for x in "ab")
    d = a.join(b, list(by)).where("a < b").groupBy("a", "b").agg(F.sum(F.pow(F.col("y_a") - F.col("y_b"), F.lit(2.0))).alias("d")).collect()
    names = sorted(r[group] for r in p.select(group).distinct().collect())
    at = {n: i for i, n in enumerate(names)}
    gap = {frozenset((at[r.a], at[r.b])): r.d for r in d}
    size = dict.fromkeys(range(len(names)), 1)
    rows = []
    while len(size) > 1:
        near, x, y = min((gap[frozenset((i, j))], i, j) for i in size for j in size if i < j)
        new, n = len(names) + len(rows), size[x] + size[y]
        for k in size:
            if k not in (x, y):
                total = n + size[k]
                gap[frozenset((new, k))] = ((size[x] + size[k]) * gap[frozenset((x, k))] + (size[y] + size[k]) * gap[frozenset((y, k))] - size[k] * near) / total
        del size[x], size[y]
        size[new] = n
        rows.append((len(rows), x, y, near**0.5, n))
    return cells.sparkSession.createDataFrame(rows, "step int, left int, right int, distance double, size int")


def kruskal(runs: DataFrame, group: str, value: str) -> DataFrame:
    """One row: H with ties corrected, its degrees of freedom and p.

    Values are counted first, so only distinct values are ranked, in pieces of their order.
    """
    per = runs.groupBy(value, group).agg(F.count("*").alias("n"))
    t = per.groupBy(value).agg(F.sum("n").alias("t"))
    rank = sums_before(t.withColumn("_piece", piece(value, cuts(runs, value))), [], [value], "t", "rank")
    rank = rank.select(value, (F.col("rank") + (F.col("t") + 1) / 2).alias("rank"))
    g = per.join(rank, value).groupBy(group).agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("n"))
    s = g.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("n").cast("double").alias("n"), (F.count("*") - 1).cast("double").alias("df"))
    ties = t.agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, F.lit(3.0)) - n))
    return _with(s.crossJoin(F.broadcast(ties)).select(h.alias("h"), "df"), {"p": (("h", "df"), dist.chi2_upper)})


def mean_interval(runs: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean and half-width of its t interval in each cell (null below two runs)."""
    g = runs.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*").cast("double"))).alias("_se"), F.count("*").alias("_n"))
    g = g.withColumn("_df", F.when(F.col("_n") > 1, F.col("_n") - 1.0))
    out = _with(g, {"half": (("_se", "_df"), lambda se, df: se * dist.t_quantile(0.5 + level / 2, df))})
    return out.withColumn("half", F.nanvl("half", F.lit(None).cast("double"))).drop("_se", "_n", "_df")
