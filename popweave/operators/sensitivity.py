"""Sensitivity of model outputs to parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popweave.functions.rng import uniform
from popweave.operators.sampling import PIECES, cuts, piece, sums_before
from popweave.sources.scratch import scoped, stored


def one_at_a_time(spark: SparkSession, baseline: dict[str, float], ranges: dict[str, Sequence[float]]) -> DataFrame:
    """(sample_id, param, setting, and every parameter): one row for each value of each parameter."""
    rows = []
    for name, values in ranges.items():
        for v in values:
            rows.append((len(rows), name, float(v), *(float(v) if p == name else float(b) for p, b in baseline.items())))
    return spark.createDataFrame(rows, "sample_id long, param string, setting double, " + ", ".join(f"{p} double" for p in baseline))


def finite_differences(samples: DataFrame, by: Sequence[str], x: str, y: str, method: str = "central", baseline: int | None = None) -> DataFrame:
    """slope and elasticity at the inner points of each curve.

    ``method`` is "central" or "forward"; slopes without a step are 0. The
    elasticity is always central, scaled by x / y of the point number
    ``baseline`` (the middle one if not given; null where its y is 0).
    """
    if method not in ("central", "forward"):
        raise ValueError(f"unknown method: {method}")
    whole = Window.partitionBy(*by)
    w = whole.orderBy(x)
    s = samples.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole), "_x0": F.lag(x).over(w), "_y0": F.lag(y).over(w), "_x1": F.lead(x).over(w), "_y1": F.lead(y).over(w)})
    middle = F.floor(F.col("_n") / 2) if baseline is None else F.lit(baseline)
    at = F.col("_i") == middle
    s = s.withColumns({"_bx": F.max(F.when(at, F.col(x))).over(whole), "_by": F.max(F.when(at, F.col(y))).over(whole)})
    ratio = lambda dy, dx: F.when(dx != 0, dy / dx).otherwise(0.0)
    central = ratio(F.col("_y1") - F.col("_y0"), F.col("_x1") - F.col("_x0"))
    slope = central if method == "central" else ratio(F.col("_y1") - F.col(y), F.col("_x1") - F.col(x))
    s = s.withColumns({"slope": slope, "elasticity": F.when(F.col("_by") != 0, F.col("_bx") / F.col("_by") * central)})
    return s.where((F.col("_i") > 0) & (F.col("_i") < F.col("_n") - 1)).drop("_i", "_n", "_x0", "_y0", "_x1", "_y1", "_bx", "_by")


def sensitivity_summary(differences: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and largest absolute elasticity."""
    e = F.abs("elasticity")
    return differences.groupBy(*by).agg(F.avg(e).alias("mean_sensitivity"), F.max(e).alias("max_sensitivity"))


def latin_hypercube(samples: DataFrame, bounds: dict[str, tuple[float, float]], n: int, seed: int = 42) -> DataFrame:
    """sample_id and one column for each parameter: each of its ``n`` strata is hit once.

    A parameter's strata are a permutation of the samples by counter-based numbers.
    """
    out = samples.select("sample_id")
    for p, (low, high) in bounds.items():
        rank = F.row_number().over(Window.orderBy(uniform(seed, f"lhs/{p}", "sample_id"), "sample_id"))
        out = out.withColumn(p, low + (rank - 1 + uniform(seed, f"within/{p}", "sample_id")) / n * (high - low))
    return out


@scoped
def pawn(samples: DataFrame, x: str, y: str, slices: int = 10) -> DataFrame:
    """One row: median, mean and largest distance between the output's
    distribution and its distribution within equal slices of ``x``."""
    at_x, at_y = cuts(samples, x), cuts(samples, y)
    # Many samples of one x make a piece that goes on in pieces of y: such an x is a cut itself.
    tied = F.get(F.array(*map(F.lit, at_x)).cast("array<double>"), piece(x, at_x)) == F.col(x)
    place = piece(x, at_x) * 2 * PIECES + F.when(tied, PIECES + piece(y, at_y)).otherwise(0)
    c = samples.groupBy(x, y).agg(F.count("*").alias("n")).withColumn("_piece", place)
    c = sums_before(c, [], [x, y], "n", "_from").crossJoin(samples.agg(F.count("*").alias("_all")))
    # The first slices have one sample more where the number doesn't divide; equal samples may be cut.
    small, large = F.expr(f"_all div {slices}"), F.col("_all") % slices
    first = lambda i: i * small + F.least(i.cast("long"), large)
    c = c.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    part = F.least(F.col("_from") + F.col("n"), first(F.col("slice") + 1)) - F.greatest(F.col("_from"), first(F.col("slice")))
    c = c.withColumn("n", part).where("n > 0")
    s = stored(c.groupBy("slice", y).agg(F.sum("n").alias("n")).withColumn("_piece", piece(y, at_y)), "slices")
    # All values in every slice, and as slice -1 those of all samples.
    every = s.groupBy(y, "_piece").agg(F.sum("n").alias("n")).withColumn("slice", F.lit(-1))
    counts = every.unionByName(s).groupBy("slice").agg(F.sum("n").alias("_all"))
    grid = every.select(y, "_piece").join(F.broadcast(counts)).join(s.unionByName(every).select("slice", y, "n"), ["slice", y], "left").na.fill(0, ["n"])
    grid = sums_before(grid, ["slice"], [y], "n", "_from").withColumn("cdf", (F.col("_from") + F.col("n")) / F.col("_all"))
    whole = grid.where("slice = -1").select(y, F.col("cdf").alias("whole"))
    grid = grid.where("slice >= 0").join(whole, y)
    ks = grid.withColumn("d", F.abs(F.col("cdf") - F.col("whole"))).groupBy("slice").agg(F.max("d").alias("ks"))
    return ks.agg(F.percentile("ks", F.lit(0.5)).alias("pawn_median"), F.avg("ks").alias("pawn_mean"), F.max("ks").alias("pawn_max"))


def running_mean(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds the mean of all rows so far."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running_mean", F.avg(value).over(w))
