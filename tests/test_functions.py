import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from popweave.functions import distributions as d
from popweave.functions.rng import normal, uniform
from popweave.operators import outcomes, sensitivity
from popweave.operators.sampling import cuts, piece, sums_before


def test_tails_against_known_values():
    assert abs(d.t_two_sided(2.228, 10) - 0.05) < 1e-4
    assert abs(d.f_upper(4.256, 2, 9) - 0.05) < 1e-3
    assert abs(d.chi2_upper(3.841, 1) - 0.05) < 1e-4
    assert abs(d.normal_two_sided(1.959964) - 0.05) < 1e-6
    assert abs(d.t_quantile(0.975, 10) - 2.228) < 1e-3
    assert d.incomplete_beta(2, 3, 0) == 0 and d.incomplete_beta(2, 3, 1) == 1


def test_counter_numbers(spark):
    # 42|edge|7, as another engine's MD5 gives it.
    assert spark.range(1).select(uniform(42, "edge", F.lit(7))).first()[0] == 0.011647043302946969
    r = spark.range(20000).select(uniform(1, "u", "id").alias("u"), normal(1, "n", "id").alias("z"))
    m = r.agg(F.avg("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(m[0] - 0.5) < 0.01 and abs(m[1]) < 0.03 and abs(m[2] - 1) < 0.03 and math.isfinite(m[1])


def test_exact_rank_law_against_all_samples():
    for n1, n2 in [(1, 1), (1, 6), (3, 4), (5, 2), (4, 6), (8, 5)]:
        us = [sum(x) - n1 * (n1 - 1) // 2 for x in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            far = max(u, n1 * n2 - u)
            assert abs(d.mann_whitney_exact(u, n1, n2) - min(2 * sum(x >= far for x in us) / len(us), 1)) < 1e-12
    # A large second group: near the normal law in the middle, and exact far out.
    assert abs(d.mann_whitney_exact(15_000, 8, 5000) - d.normal_two_sided((5000 - 0.5) / math.sqrt(8 * 5000 * 5009 / 12))) < 0.01
    assert math.isclose(d.mann_whitney_exact(0, 8, 5000), 2 / math.comb(5008, 8))


def test_mann_whitney_with_ties_nulls_and_small_groups(spark):
    """U against a count of pairs; the exact law only where nothing is tied."""
    rows = {"a": [1.0, 2.5, 9.0], "b": [float(i % 7) for i in range(40)], "c": [0.5, 3.25, 10.0, 11.0, 12.0, 13.0]}
    runs = spark.createDataFrame([(g, v) for g, vs in rows.items() for v in vs], "g string, v double")
    got = {(r.a, r.b): r for r in outcomes.mann_whitney(runs, "g", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), r in got.items():
        u = sum((p > q) + (p == q) / 2 for p in rows[x] for q in rows[y])
        assert r.u == u
        assert math.isclose(r.p, d.mann_whitney_exact(u, 3, 6) if (x, y) == ("a", "c") else d.normal_two_sided(r.z))
    assert outcomes.mann_whitney(runs.where("g = 'a'"), "g", "v").count() == 0
    assert outcomes.mann_whitney(runs.where("v > 99"), "g", "v").count() == 0


def test_slices_and_ranks_with_many_ties(spark):
    """Against numpy: a third of the samples have one x, and values repeat."""
    r = np.random.default_rng(4)
    x = np.where(r.random(997) < 0.34, 0.5, r.random(997)).round(2)
    y = (x + r.normal(0, 0.3, 997)).round(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    order = np.lexsort((y, x))
    grid = np.unique(y)
    cdf = lambda v: np.searchsorted(np.sort(v), grid, side="right") / len(v)
    ks = [abs(cdf(y[part]) - cdf(y)).max() for part in np.array_split(order, 7)]
    got = sensitivity.pawn(df, "x", "y", 7).first()
    assert np.allclose([got.pawn_median, got.pawn_mean, got.pawn_max], [np.median(ks), np.mean(ks), max(ks)])
    counts = df.groupBy("y").agg(F.count("*").alias("n"), F.sum("x").alias("x")).withColumn("_piece", piece("y", cuts(df, "y")))
    before = {row.y: row.before for row in sums_before(counts, [], ["y"], "n", "before").collect()}
    assert before == {float(v): int((y < v).sum()) for v in grid}
