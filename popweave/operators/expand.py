"""Population and interaction tables split along further characteristics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popweave.operators.enrich import INCOME, INCOME_BY_EDUCATION, INCOME_DECAY, NOT_APPLICABLE
from popweave.operators.population import largest_remainder

# The published probability tables of the wider population.
MARITAL = {
    "[0,20)": {"Ongehuwd": 0.99, "Gehuwd": 0.01},
    "[20,30)": {"Ongehuwd": 0.65, "Gehuwd": 0.20, "Samenwonend": 0.13, "Gescheiden": 0.02},
    "[30,40)": {"Ongehuwd": 0.30, "Gehuwd": 0.42, "Samenwonend": 0.18, "Gescheiden": 0.10},
    "[40,50)": {"Ongehuwd": 0.20, "Gehuwd": 0.48, "Samenwonend": 0.14, "Gescheiden": 0.15, "Weduwe/weduwnaar": 0.03},
    "[50,60)": {"Ongehuwd": 0.15, "Gehuwd": 0.50, "Samenwonend": 0.10, "Gescheiden": 0.18, "Weduwe/weduwnaar": 0.07},
    "[60,70)": {"Ongehuwd": 0.10, "Gehuwd": 0.52, "Samenwonend": 0.08, "Gescheiden": 0.15, "Weduwe/weduwnaar": 0.15},
    "[70,80)": {"Ongehuwd": 0.08, "Gehuwd": 0.48, "Gescheiden": 0.10, "Weduwe/weduwnaar": 0.34},
    "[80,120]": {"Ongehuwd": 0.05, "Gehuwd": 0.35, "Gescheiden": 0.08, "Weduwe/weduwnaar": 0.52},
}
EMPLOYMENT = {
    "[0,20)": {"Student": 0.87, "Werkend (deeltijd)": 0.08, "Werkloos": 0.05},
    "[20,30)": {"Werkend (voltijd)": 0.50, "Werkend (deeltijd)": 0.15, "Student": 0.20, "Werkloos": 0.10, "ZZP": 0.05},
    "[30,40)": {"Werkend (voltijd)": 0.60, "Werkend (deeltijd)": 0.18, "ZZP": 0.10, "Werkloos": 0.07, "Thuiszorgend": 0.05},
    "[40,50)": {"Werkend (voltijd)": 0.62, "Werkend (deeltijd)": 0.16, "ZZP": 0.10, "Werkloos": 0.07, "Arbeidsongeschikt": 0.05},
    "[50,60)": {"Werkend (voltijd)": 0.55, "Werkend (deeltijd)": 0.15, "ZZP": 0.08, "Werkloos": 0.10, "Arbeidsongeschikt": 0.07, "Gepensioneerd": 0.05},
    "[60,70)": {"Gepensioneerd": 0.55, "Werkend (deeltijd)": 0.15, "Werkend (voltijd)": 0.10, "ZZP": 0.07, "Arbeidsongeschikt": 0.08, "Werkloos": 0.05},
    "[70,80)": {"Gepensioneerd": 0.90, "Werkend (deeltijd)": 0.05, "Arbeidsongeschikt": 0.05},
    "[80,120]": {"Gepensioneerd": 0.95, "Arbeidsongeschikt": 0.05},
}
HEALTH = {
    "[0,20)": {"Uitstekend": 0.68, "Goed": 0.29, "Matig": 0.03},
    "[20,30)": {"Uitstekend": 0.55, "Goed": 0.35, "Matig": 0.08, "Slecht": 0.02},
    "[30,40)": {"Uitstekend": 0.45, "Goed": 0.38, "Matig": 0.12, "Slecht": 0.05},
    "[40,50)": {"Uitstekend": 0.35, "Goed": 0.38, "Matig": 0.18, "Slecht": 0.09},
    "[50,60)": {"Uitstekend": 0.25, "Goed": 0.38, "Matig": 0.24, "Slecht": 0.13},
    "[60,70)": {"Uitstekend": 0.18, "Goed": 0.35, "Matig": 0.28, "Slecht": 0.19},
    "[70,80)": {"Uitstekend": 0.12, "Goed": 0.30, "Matig": 0.32, "Slecht": 0.26},
    "[80,120]": {"Uitstekend": 0.08, "Goed": 0.25, "Matig": 0.35, "Slecht": 0.32},
}
IMMIGRATION = {
    "Autochtoon": {"3e generatie+": 1.0},
    "Marokkaans": {"1e generatie": 0.35, "2e generatie": 0.30, "2e generatie (NL-geboren)": 0.35},
    "Turks": {"1e generatie": 0.35, "2e generatie": 0.30, "2e generatie (NL-geboren)": 0.35},
    "Surinaams": {"1e generatie": 0.30, "2e generatie": 0.35, "2e generatie (NL-geboren)": 0.35},
    "Overig": {"1e generatie": 0.55, "2e generatie": 0.30, "3e generatie+": 0.15},
}
VOTE = {"Ja": 0.78, "Nee": 0.22}
CHILDREN = "[0,20)"
BASE = ("etngrp", "geslacht", "lft", "oplniv")


def _table(spark: SparkSession, tables: dict, key: str, kind: str = "string") -> DataFrame:
    rows = [(k, pos, c, p / sum(t.values())) for k, t in tables.items() for pos, (c, p) in enumerate(t.items())]
    return spark.createDataFrame(rows, f"{key} {kind}, pos int, category string, p double")


def split(rows: DataFrame, table: DataFrame, on: str, out: str, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Splits each row's count over the categories of its ``on`` by largest
    remainders; the categories' order breaks ties (later ones first)."""
    wide = rows.join(F.broadcast(table), on)
    done = largest_remainder(wide, keys, "pos", "p", count, "_n")
    return done.select(*keys, F.col("category").alias(out), F.col("_n").alias(count))


def expand_population(pop: DataFrame) -> DataFrame:
    """(etngrp, geslacht, lft, oplniv, n) split by marital status, work, income,
    health, immigration generation and vote. Totals stay. Children have no
    income band and no vote."""
    spark = pop.sparkSession
    keys = list(BASE)
    r = pop.select(*BASE, F.col("n").cast("long").alias("n")).groupBy(*BASE).agg(F.sum("n").alias("n"))
    incomes = {f"{e}": dict(zip(INCOME, ps, strict=True)) for e, ps in INCOME_BY_EDUCATION.items()} | {CHILDREN: {NOT_APPLICABLE: 1.0}}
    child = F.col("lft") == CHILDREN
    steps = [
        (_table(spark, MARITAL, "lft"), "lft", "burgerlijke_staat"),
        (_table(spark, EMPLOYMENT, "lft"), "lft", "arbeidsstatus"),
        (_table(spark, incomes, "_i"), "_i", "inkomensniveau"),
        (_table(spark, HEALTH, "lft"), "lft", "gezondheid"),
        (_table(spark, IMMIGRATION, "etngrp"), "etngrp", "immigratie_gen"),
        (_table(spark, {"adult": VOTE, CHILDREN: {"Nee": 1.0}}, "_i"), "_i", "kiesrecht"),
    ]
    for table, on, out in steps:
        if on == "_i":
            other = F.col("oplniv").cast("string") if out == "inkomensniveau" else F.lit("adult")
            r = r.withColumn("_i", F.when(child, CHILDREN).otherwise(other))
        r = split(r, table, on, out, keys)
        keys.append(out)
    return r


def expand_interactions(links: DataFrame, expanded: DataFrame) -> DataFrame:
    """Interaction rows split over both ends' income bands.

    A pair of bands weighs the product of the ends' shares, times a decay with
    the bands' distance; counts follow by largest remainders. Rows with an end
    that has no bands at all in the population stay whole (not applicable);
    rows whose bands weigh nothing go.
    """
    spark = links.sparkSession
    bands = spark.createDataFrame(list(enumerate(INCOME)), "band int, inkomensniveau string")
    shares = expanded.groupBy(*BASE, "inkomensniveau").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*BASE))
    shares = shares.select(*BASE, "inkomensniveau", share.alias("share"))
    known = shares.select(*BASE).distinct()
    rows = links.withColumn("_row", F.xxhash64(*(c + s for s in ("_src", "_dst") for c in BASE)))
    rows = rows.groupBy("_row", *(c + s for s in ("_src", "_dst") for c in BASE)).agg(F.sum(F.col("n").cast("long")).alias("n"))

    def joined(df: DataFrame, side: DataFrame, suffix: str, how: str) -> DataFrame:
        on = reduce(lambda a, b: a & b, (df[c + suffix].eqNullSafe(side[c]) for c in BASE))
        return df.join(side, on, how).drop(*BASE)

    whole = rows
    for s in ("_src", "_dst"):
        whole = joined(whole, known.withColumn(f"_known{s}", F.lit(True)), s, "left")
    lone = whole.where(F.col("_known_src").isNull() | F.col("_known_dst").isNull())
    lone = lone.select(*(c + s for s in ("_src", "_dst") for c in BASE), *(F.lit(NOT_APPLICABLE).alias(f"inkomensniveau{s}") for s in ("_src", "_dst")), "n")
    split_ = rows
    for s in ("_src", "_dst"):
        own = shares.join(F.broadcast(bands), "inkomensniveau").select(*BASE, F.col("band").alias(f"band{s}"), F.col("share").alias(f"share{s}"))
        split_ = joined(split_, own, s, "inner")
    decay = F.get(F.array(*map(F.lit, INCOME_DECAY)), F.abs(F.col("band_src") - F.col("band_dst")))
    w = split_.withColumn("w", F.col("share_src") * F.col("share_dst") * decay)
    total = F.sum("w").over(Window.partitionBy("_row"))
    w = w.withColumn("p", F.col("w") / total).where(F.col("w") > 0).withColumn("pos", F.col("band_src") * len(INCOME) + F.col("band_dst"))
    done = largest_remainder(w, ["_row"], "pos", "p", "n", "_n")
    name = lambda c: F.get(F.array(*map(F.lit, INCOME)), F.col(c))
    out = done.select(*(c + s for s in ("_src", "_dst") for c in BASE), *(name(f"band{s}").alias(f"inkomensniveau{s}") for s in ("_src", "_dst")), F.col("_n").alias("n"))
    return out.unionByName(lone)
