"""Joins of results with the tables that describe their networks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach(rows: DataFrame, mapping: DataFrame, on: str, key: str, columns: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` with ``columns`` of the mapping whose ``key`` equals ``on``."""
    side = mapping.select(F.col(key).alias("_key"), *columns)
    return rows.join(side, F.col(on) == F.col("_key"), how).drop("_key")


def attach_concentration(statistics: DataFrame, mapping: DataFrame, name: str = "filename", suffix: str = "_stats") -> DataFrame:
    """Statistics with the concentration of their grouping (file name without its
    suffix); rows whose grouping is unknown go."""
    keyed = statistics.withColumn("aggregation_key", F.regexp_replace(name, f"{suffix}$", ""))
    found = attach(keyed, mapping, "aggregation_key", "aggregation", ["hhi", "n_groups", "effective_n"]).where("hhi IS NOT NULL")
    return found.withColumn("hhi_label", F.format_string("HHI=%.4f", "hhi"))


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def pair_drops(pairs: DataFrame, decomposition: DataFrame, homophily: DataFrame, threshold: str = "threshold_value") -> DataFrame:
    """What dropping a dimension changes: for each fine and coarse network and each
    threshold that both have, sizes, ignition and their differences.

    pairs (fine, coarse, dropped), decomposition (network, threshold, mean_ignited,
    p_ignite), homophily (dim, excess).
    """
    d = first_rows(decomposition.select("network", threshold, "mean_ignited", "p_ignite"), ["network", threshold], ["mean_ignited", "p_ignite"])
    side = lambda name: d.select(F.col("network").alias(name), F.col(threshold).alias("threshold"), F.col("mean_ignited").alias(f"{name}_size"), F.col("p_ignite").alias(f"{name}_pig"))
    both = pairs.join(side("fine"), "fine").join(side("coarse"), ["coarse", "threshold"])
    both = attach(both, homophily, "dropped", "dim", [F.col("excess").alias("homophily_dropped")])
    size = lambda name: F.log10(F.greatest(F.col(f"{name}_size"), F.lit(1.0)))
    return both.select(
        "fine",
        "coarse",
        F.col("dropped").alias("dropped_dim"),
        "homophily_dropped",
        "threshold",
        "fine_size",
        "coarse_size",
        "fine_pig",
        "coarse_pig",
        (size("fine") - size("coarse")).alias("delta_log_size"),
        (F.col("fine_pig") - F.col("coarse_pig")).alias("delta_pig"),
    )


def group_means(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and number of values of each group; rows with a null key or value don't count."""
    known = rows.where(F.col(value).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
