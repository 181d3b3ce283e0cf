"""Exact picks and numberings by random numbers, without sorting in one task.

Numbers in [0, 1) are counted in equal-width buckets first. A numbering adds
what lies in lower buckets to a row's place in its own, so windows hold a bucket
and not a whole group; a pick of the smallest keeps whole buckets and cuts only
the one that holds the boundary.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popweave.functions.rng import SCALE, number
from popweave.sources.scratch import stored

PICK_BUCKETS = 1 << 16


def smallest(rows: DataFrame, u: Column, n: int, ties: Sequence[str]) -> DataFrame:
    """The ``n`` rows with the smallest numbers; ``ties`` orders equal ones."""
    if n <= 0:
        return rows.limit(0)
    r = rows.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * PICK_BUCKETS).cast("int"))
    upto = F.sum("k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hist = r.groupBy("_b").agg(F.count("*").alias("k")).withColumn("upto", upto)
    edge = hist.where(F.col("upto") >= n).agg(F.min(F.struct("_b", "upto", "k")).alias("e")).select("e.*").first()
    if edge is None or edge._b is None:
        return rows
    cut = r.where(F.col("_b") == edge._b).orderBy("_u", *ties).limit(n - (edge.upto - edge.k))
    return r.where(F.col("_b") < edge._b).unionByName(cut).drop("_u", "_b")


def smallest_share(rows: DataFrame, digits: Column, n: int, total: int, ties: Sequence[str]) -> DataFrame:
    """As :func:`smallest`, by the numbers of ``digits`` (see :func:`rng.digits`), of ``total`` rows that
    are dear to make: they are made once.

    The n-th number lies near n / total. Rows up to a bound above that are stored, with their digits only
    from a bound below it on, and the cut is made among these few. Where it doesn't lie
    between the bounds, as it nearly always does, all rows are looked at again."""
    if n <= 0 or n >= total:
        return rows.limit(0) if n <= 0 else rows
    share = n / total
    margin = 8 * math.sqrt(share * (1 - share) / total)
    low, high = (f"{min(max(math.ceil(x * SCALE), 0), int(SCALE)):012x}" for x in (share - margin, share + margin))
    near = rows.withColumn("_h", digits)
    if share + margin < 1:
        near = near.where(F.col("_h") < high)
    near = stored(near.withColumn("_h", F.when(F.col("_h") >= low, F.col("_h"))), "near")
    sure, unsure = near.where("_h IS NULL").drop("_h"), near.where("_h IS NOT NULL")
    left = n - sure.count()
    if not 0 <= left <= unsure.count():
        return smallest(rows, number(digits), n, ties)
    return sure.unionByName(smallest(unsure, number(F.col("_h")), left, ties).drop("_h"))


def numbered(rows: DataFrame, by: Sequence[str], u: Column, ties: Sequence[str], out: str, buckets: int = 1024) -> DataFrame:
    """Adds ``out``: a row's place in its group, from 0, by number and then ``ties``."""
    r = rows.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    n = r.groupBy(*by, "_b").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    names = {c: f"_by_{c}" for c in by}
    n = n.select(*(F.col(c).alias(names[c]) for c in by), F.col("_b").alias("__b"), "_before")
    match = F.col("_b") == F.col("__b")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(names[c]))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_u", *ties)) - 1
    placed = r.withColumn("_place", place).join(n, match)
    return placed.withColumn(out, (F.col("_place") + F.col("_before")).cast("long")).drop("_u", "_b", "__b", "_place", "_before", *names.values())


def ranges(rows: DataFrame, by: Sequence[str], weight: Column, order: str) -> DataFrame:
    """Rows with the range [low, high) that their weight (a long) takes of their group's total, once
    for each ``_bucket`` that it touches. Buckets are as many as the group's rows, and equally wide.

    The windows run over a group's rows, which should be those of a stated table (communities)."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_w", weight.cast("long")).where("_w > 0")
    r = r.withColumns({"high": F.sum("_w").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("_w").over(w), "_n": F.count("*").over(w)})
    r = r.withColumns({"low": F.col("high") - F.col("_w"), "_width": F.expr("(total + _n - 1) div _n")})
    return r.withColumn("_bucket", F.explode(F.expr("sequence(low div _width, (high - 1) div _width)"))).drop("_w", "_n")


def drawn(rows: DataFrame, ranged: DataFrame, by: Sequence[str], u: Column) -> DataFrame:
    """Each row with the one of :func:`ranges` that ``u`` in [0, 1) falls on: by its weight's share.

    The range join is an equi-join on the bucket, in which two ranges are looked at on average."""
    totals = ranged.select(*by, "total", "_width").distinct()
    r = rows.join(totals, list(by)).withColumn("_x", F.floor(u * F.col("total"))).withColumn("_bucket", F.expr("_x div _width"))
    found = r.drop("total", "_width").join(ranged, [*by, "_bucket"]).where("_x >= low AND _x < high")
    return found.drop("_x", "_bucket", "_width", "low", "high", "total")


#: Pieces of a table's order that running sums are taken in.
PIECES = 256


def cuts(rows: DataFrame, value: str) -> list[float]:
    """Numbers that cut the values' order into about equal pieces, PIECES at most."""
    return sorted(set(rows.approxQuantile(value, [i / PIECES for i in range(1, PIECES)], 0.001)))


def piece(value: str, at: Sequence[float]) -> Column:
    """How many of the cuts lie below a value: that piece reaches up to the next cut and includes it."""
    return F.size(F.filter(F.array(*map(F.lit, at)).cast("array<double>"), lambda c: c < F.col(value).cast("double")))


def sums_before(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: str, out: str, in_piece: str = "_piece") -> DataFrame:
    """Adds ``out``: the sum of ``n`` over the rows of a group that come before in ``order``.

    ``in_piece`` numbers pieces of that order, which are summed first, so that no task sorts a whole group."""
    upto = lambda by_, to: Window.partitionBy(*by_).orderBy(*to).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    whole = rows.groupBy(*by, in_piece).agg(F.sum(n).alias("_all"))
    whole = whole.select(*by, in_piece, F.coalesce(F.sum("_all").over(upto(by, [in_piece])), none).alias("_earlier"))
    inside = F.coalesce(F.sum(n).over(upto([*by, in_piece], order)), none)
    return rows.withColumn("_inside", inside).join(whole, [*by, in_piece]).withColumn(out, F.col("_earlier") + F.col("_inside")).drop("_earlier", "_inside")
