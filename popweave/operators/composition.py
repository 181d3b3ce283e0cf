"""Concentration, entropy, mixing and seeding measures of population and interaction tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subsets(names: Sequence[str], always: Sequence[str] = ()) -> list[tuple[str, ...]]:
    """Every non-empty subset of ``names`` (in order) that has all of ``always``."""
    return [c for r in range(1, len(names) + 1) for c in combinations(names, r) if set(always) <= set(c)]


def aggregate_combinations(pop: DataFrame, names: Sequence[str], sets: Sequence[Sequence[str]] | None = None, count: str = "n") -> DataFrame:
    """combo, the characteristics (null where not grouped by) and n, in one pass over all ``sets``.

    A grouping-sets plan: rows are expanded and pre-aggregated before one
    shuffle, instead of a job for each combination. Null values stay groups.
    """
    sets = sets or subsets(names)
    grouped = pop.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    out = grouped.agg(F.sum(count).alias("n"), *(F.grouping(c).alias(f"_{c}") for c in names))
    combo = F.concat_ws("_", *(F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in names))
    return out.select(combo.alias("combo"), *names, "n")


def concentration(aggregated: DataFrame) -> DataFrame:
    """n_groups, hhi, effective_n, biggest (share of the largest group) and n_characteristics of each combo."""
    total = F.sum("n")
    hhi = F.sum(F.col("n").cast("double") * F.col("n")) / (total.cast("double") * total)
    g = aggregated.groupBy("combo").agg(F.count("*").alias("n_groups"), hhi.alias("hhi"), (F.max("n") / total).alias("biggest"))
    return g.withColumn("effective_n", 1 / F.col("hhi")).withColumn("n_characteristics", F.size(F.split("combo", "_")))


def lorenz(pop: DataFrame, names: Sequence[str], count: str = "n") -> DataFrame:
    """rank, group_share and count_share of groups from small to large."""
    order = Window.orderBy(F.col(count), *names)
    whole = Window.partitionBy()
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.row_number().over(order)
    return pop.select(*names, rank.alias("rank"), (rank / F.count("*").over(whole)).alias("group_share"), (F.sum(count).over(upto) / F.sum(count).over(whole)).alias("count_share"))


def spread_sample(summary: DataFrame, k: int, by: str = "hhi") -> DataFrame:
    """``k`` rows evenly spaced along ``by``, both ends included (all rows if fewer)."""
    order = Window.orderBy(by, "combo")
    ranked = summary.withColumns({"_r": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy())})
    # Row r is one of the k positions floor(i * (n - 1) / (k - 1)).
    i = F.ceil(F.col("_r") * (k - 1) / (F.col("_n") - 1))
    hit = F.floor(i * (F.col("_n") - 1) / (k - 1)) == F.col("_r")
    return ranked.where((F.col("_n") <= k) | hit).drop("_r", "_n")


def shannon(counts: DataFrame, by: Sequence[str], count: str = "n", base2: bool = False) -> DataFrame:
    """Entropy, its maximum, Simpson's index and Pielou's evenness of the counts within ``by``."""
    p = F.col(count) / F.sum(count).over(Window.partitionBy(*by))
    log = F.log2("_p") if base2 else F.log("_p")
    g = counts.where(F.col(count) > 0).withColumn("_p", p).groupBy(*by)
    out = g.agg((-F.sum(F.col("_p") * log)).alias("entropy"), F.count("*").alias("kinds"), (1 - F.sum(F.col("_p") * F.col("_p"))).alias("simpson"))
    most = F.log2("kinds") if base2 else F.log(F.col("kinds").cast("double"))
    return out.withColumn("max_entropy", most).withColumn("evenness", F.when(F.col("kinds") > 1, F.col("entropy") / most).otherwise(0.0))


def _all_equal(names: Sequence[str], src: str, dst: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c + src).eqNullSafe(F.col(c + dst)) for c in names))


def spread_halves(rows: DataFrame, base: Column, n: int) -> DataFrame:
    """n rows spread over hhi: half of those where ``base`` holds, the rest of the others."""
    return spread_sample(rows.where(base), n // 2).unionByName(spread_sample(rows.where(~base), n - n // 2))


def homophily(links: DataFrame, names: Sequence[str], count: str = "n", src: str = "_src", dst: str = "_dst") -> DataFrame:
    """One row: n_blocks, total_edges, frac_within, ei_index, modularity_q,
    newman_r and ei_<characteristic>, from the mixing matrix of blocks."""
    n = F.col(count).cast("double")
    base = links.agg(
        F.sum(n).alias("total"),
        F.sum(F.when(_all_equal(names, src, dst), n).otherwise(0.0)).alias("inside"),
        *(F.sum(F.when(F.col(c + src).eqNullSafe(F.col(c + dst)), n).otherwise(0.0)).alias(f"in_{c}") for c in names),
    )
    side = lambda suffix, name: links.groupBy(*(F.col(c + suffix).alias(c) for c in names)).agg(F.sum(n).alias(name))
    a, b = side(src, "a"), side(dst, "b")
    on = reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in names))
    blocks = a.join(b, on, "full_outer").agg(F.count("*").alias("n_blocks"), F.sum(F.coalesce("a", F.lit(0.0)) * F.coalesce("b", F.lit(0.0))).alias("ab"))
    r = base.crossJoin(F.broadcast(blocks))
    total, inside = F.col("total"), F.col("inside")
    null_share = F.col("ab") / (total * total)
    q = inside / total - null_share
    return r.select(
        "n_blocks",
        total.cast("long").alias("total_edges"),
        (inside / total).alias("frac_within"),
        ((total - 2 * inside) / total).alias("ei_index"),
        q.alias("modularity_q"),
        F.when(null_share < 1, q / (1 - null_share)).alias("newman_r"),
        F.lit(len(names)).alias("n_dimensions"),
        *(((total - 2 * F.col(f"in_{c}")) / total).alias(f"ei_{c}") for c in names),
    )


def inbreeding(links: DataFrame, names: Sequence[str], count: str = "n", src: str = "_src", dst: str = "_dst") -> DataFrame:
    """Per characteristic: observed share of links within, the share expected
    from both ends' marginals (sum of p squared), excess and ratio."""
    n = F.col(count).cast("double")
    long = links.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c + src).cast("string").alias("s"), F.col(c + dst).cast("string").alias("d")) for c in names])).alias("x"), n.alias("n")).select("x.*", "n")
    within = long.groupBy("dim").agg((F.sum(F.when(F.col("s").eqNullSafe(F.col("d")), F.col("n")).otherwise(0.0)) / F.sum("n")).alias("observed"))
    ends = long.select("dim", F.explode(F.array("s", "d")).alias("v"), "n").groupBy("dim", "v").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("dim"))
    expected = ends.select("dim", p.alias("p")).groupBy("dim").agg(F.sum(F.col("p") * F.col("p")).alias("expected"))
    out = within.join(expected, "dim")
    return out.withColumn("excess", F.col("observed") - F.col("expected")).withColumn("ratio", F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")))


def partition_summary(partitions: DataFrame, per_dimension: DataFrame, value: str = "excess") -> DataFrame:
    """Mean, min and max of ``value`` over each partition's dimensions (partition = names joined by _)."""
    dims = partitions.select("partition", F.explode(F.split("partition", "_")).alias("dim"))
    g = dims.join(per_dimension.select("dim", value), "dim").groupBy("partition")
    return g.agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n_dims"))


def coarsening_pairs(partitions: DataFrame) -> DataFrame:
    """(fine, coarse, dropped): partitions that differ by one dropped dimension.

    The theta join is made an equi-join: each partition is joined on itself
    with one dimension left out, so the work is rows times dimensions.
    """
    dims = partitions.select(F.col("partition").alias("fine"), F.array_sort(F.split("partition", "_")).alias("dims"))
    out = dims.select("fine", "dims", F.explode("dims").alias("dropped"))
    key = F.concat_ws("_", F.array_remove("dims", F.col("dropped")))
    coarse = partitions.select(F.col("partition").alias("coarse"), F.concat_ws("_", F.array_sort(F.split("partition", "_"))).alias("key"))
    return out.withColumn("key", key).join(coarse, "key").select("fine", "coarse", "dropped")


def seeding_metrics(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: internal_density (links inside over n(n-1)/2), exposure (links
    out over links inside), both divided by their maximum, and combined_score
    (0.9 and 0.1 of these). Groups without links count as 0."""
    inside = F.sum(F.when(F.col("src_group") == F.col("dst_group"), F.col("n")).otherwise(0.0))
    per = pairs.groupBy(F.col("src_group").alias("group_id")).agg(inside.alias("inside"), (F.sum("n") - inside).alias("outside"))
    g = groups.select("group_id", F.col("n").alias("size")).join(per, "group_id", "left").na.fill(0.0, ["inside", "outside"])
    most = F.col("size") * (F.col("size") - 1) / 2
    g = g.withColumn("internal_density", F.when(most > 0, F.col("inside") / most).otherwise(0.0))
    g = g.withColumn("exposure", F.when(F.col("inside") > 0, F.col("outside") / F.col("inside")).otherwise(0.0))
    whole = Window.partitionBy()
    norm = lambda c: F.when(F.max(c).over(whole) > 0, F.col(c) / F.max(c).over(whole)).otherwise(0.0)
    g = g.withColumns({"density_norm": norm("internal_density"), "exposure_norm": norm("exposure")})
    return g.withColumn("combined_score", 0.9 * F.col("density_norm") + 0.1 * F.col("exposure_norm")).drop("inside", "outside")


def seed_groups(metrics: DataFrame, share: float, by: str = "combined_score") -> DataFrame:
    """Groups by descending score until their sizes reach ``share`` of all, with the one that crosses it."""
    upto = F.sum("size").over(Window.orderBy(F.desc(by), "group_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    need = F.sum("size").over(Window.partitionBy()) * share
    return metrics.withColumns({"cumulative": upto, "_need": need}).where(F.col("cumulative") - F.col("size") < F.col("_need")).select("group_id", "size", by, "cumulative")
