"""Population tables to groups and individual nodes.

A population table has one row per group: characteristic columns and a count.
Order between equal counts is by the characteristics, so ids are stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def characteristics(pop: DataFrame, count: str = "n") -> list[str]:
    """All columns but the count, in alphabetical order."""
    return sorted(c for c in pop.columns if c != count)


def groups(pop: DataFrame, count: str = "n", ids: str = "by_size") -> DataFrame:
    """group_id, characteristics and n of each population row.

    ``ids="by_size"`` numbers by descending count, ``"by_name"`` by
    characteristics. Null counts are 0. Rows with equal characteristics stay
    apart; :func:`lookup` says which one such attributes mean.
    """
    names = characteristics(pop, count)
    n = F.coalesce(F.col(count).cast("double"), F.lit(0.0))
    order = Window.orderBy(*([n.desc()] if ids == "by_size" else []), *names)
    return pop.select((F.row_number().over(order) - 1).alias("group_id"), *names, n.alias("n"))


def lookup(groups_: DataFrame, names: Sequence[str]) -> DataFrame:
    """One group_id for each combination of characteristics: the last one wins."""
    return groups_.groupBy(*names).agg(F.max("group_id").alias("group_id"))


def stratified_allocate(items: DataFrame, scale: float, count: str, order: Sequence[str | Column], out: str) -> DataFrame:
    """Adds ``out``: int(scale * count), and one more for the largest counts
    until the sum is int(scale * total). ``order`` breaks ties of the count.

    Products are doubles, as ``int(scale * n)`` is. ``items`` is an aggregate
    table, whose rows one window can rank.
    """
    n = F.col(count).cast("double")
    share = (F.lit(float(scale)) * n).cast("long")
    total = items.agg((F.lit(float(scale)) * F.sum(n)).cast("long").alias("_all"), F.sum(share).alias("_given"))
    rank = F.row_number().over(Window.orderBy(n.desc(), *order))
    ranked = items.withColumn("_rank", rank).crossJoin(F.broadcast(total))
    return ranked.withColumn(out, share + (F.col("_rank") <= F.col("_all") - F.col("_given")).cast("long")).drop("_rank", "_all", "_given")


def allocate_groups(groups_: DataFrame, scale: float) -> DataFrame:
    """Adds n_scaled, the number of nodes of each group."""
    return stratified_allocate(groups_, scale, "n", ["group_id"], "n_scaled")


def expand_nodes(allocated: DataFrame) -> DataFrame:
    """One row for each person: node_id, group_id and the characteristics.

    Ids are dense and contiguous within groups, in order of descending n. Only
    the prefix sum over groups is a global window; people are exploded in
    parallel. Groups without people give no rows.
    """
    before = Window.orderBy(F.desc("n"), "group_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n_scaled").over(before), F.lit(0))
    names = [c for c in allocated.columns if c not in ("group_id", "n", "n_scaled")]
    placed = allocated.withColumn("_first", offset).where("n_scaled > 0")
    return placed.select(F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("n_scaled") - 1)).alias("node_id"), "group_id", *names)


def find_nodes(nodes: DataFrame, **attributes: object) -> DataFrame:
    """node_id of nodes with all the given attributes (null matches null); none if unknown."""
    matches = F.lit(True)
    for name, value in attributes.items():
        matches = matches & F.col(name).eqNullSafe(F.lit(value))
    return nodes.where(matches).select("node_id")


def largest_remainder(rows: DataFrame, key: Sequence[str], category: str, probability: str, total: str, out: str = "n_split") -> DataFrame:
    """Splits ``total`` of each key over its categories: floor(p * n), then one
    more for the largest fractions (the later category first if equal).
    Categories that get nothing are left out."""
    exact = F.col(probability) * F.col(total)
    whole = F.floor(exact).cast("long")
    by_key = Window.partitionBy(*key)
    rank = F.row_number().over(by_key.orderBy((exact - whole).desc(), F.desc(category)))
    r = rows.withColumns({"_whole": whole, "_rank": rank, "_sum": F.sum(whole).over(by_key)})
    r = r.withColumn(out, F.col("_whole") + (F.col("_rank") <= F.col(total) - F.col("_sum")).cast("long"))
    return r.where(F.col(out) > 0).drop("_whole", "_rank", "_sum")


def proportional_at_least_one(rows: DataFrame, weight: str, total: int, order: Sequence[str], out: str = "units") -> DataFrame:
    """Units in proportion to weights, one at least: floors, then the rest to the
    largest fractions. Without weight all get an equal share. The sum can
    exceed ``total`` because of the ones."""
    whole = Window.partitionBy()
    w, k = F.sum(weight).over(whole), F.count("*").over(whole)
    exact = F.when(w > 0, F.col(weight) / w).otherwise(1.0 / k) * total
    units = F.greatest(F.floor(exact), F.lit(1)).cast("long")
    r = rows.withColumns({"_exact": exact, "_units": units})
    rank = F.row_number().over(Window.orderBy((F.col("_exact") - F.floor("_exact")).desc(), *order))
    r = r.withColumns({"_rank": rank, "_rest": total - F.sum("_units").over(whole)})
    return r.withColumn(out, F.col("_units") + (F.col("_rank") <= F.col("_rest")).cast("long")).drop("_exact", "_units", "_rank", "_rest")


def encodings(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """(attribute, code, value): sorted distinct values of each attribute, from 0; nulls have none."""
    long = nodes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*")
    distinct = long.where("value IS NOT NULL").distinct()
    return distinct.select("attribute", (F.row_number().over(Window.partitionBy("attribute").orderBy("value")) - 1).alias("code"), "value")


def encode(nodes: DataFrame, codes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replaces attributes by their codes (short), -1 for null or unknown values."""
    out = nodes
    for name in names:
        c = codes.where(F.col("attribute") == name).select(F.col("value").alias(f"_{name}"), F.col("code").cast("short").alias(f"_{name}_code"))
        out = out.join(c, out[name].cast("string") == c[f"_{name}"], "left").withColumn(name, F.coalesce(f"_{name}_code", F.lit(-1).cast("short"))).drop(f"_{name}", f"_{name}_code")
    return out


def five_year_bracket(age: Column) -> Column:
    """'[0,5)' to '[95,100)', and '[100,120]' from 100 on."""
    low = F.floor(age / 5) * 5
    return F.when(age >= 100, "[100,120]").otherwise(F.format_string("[%d,%d)", low, low + 5))
