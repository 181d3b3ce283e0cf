import hashlib
import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from popweave.operators import enrich, expand


def split(table, n):
    exact = {c: p / sum(table.values()) * n for c, p in table.items()}
    out = {c: int(x) for c, x in exact.items()}
    order = sorted(range(len(table)), key=lambda i: (exact[list(table)[i]] - out[list(table)[i]], i), reverse=True)
    for i in order[: n - sum(out.values())]:
        out[list(table)[i]] += 1
    return {c: k for c, k in out.items() if k}


def test_population_is_split_as_nested_tables_say(spark):
    pop = spark.createDataFrame([("Turks", "Man", "[30,40)", 2, 137), ("Autochtoon", "Vrouw", "[0,20)", 1, 41)], "etngrp string, geslacht string, lft string, oplniv int, n int")
    out = expand.expand_population(pop)
    n = {r.etngrp: r.n for r in out.groupBy("etngrp").agg(F.sum("n").alias("n")).collect()}
    assert n == {"Turks": 137, "Autochtoon": 41}
    got = {r.burgerlijke_staat: r.n for r in out.where("etngrp = 'Turks'").groupBy("burgerlijke_staat").agg(F.sum("n").alias("n")).collect()}
    assert got == split(expand.MARITAL["[30,40)"], 137)
    child = out.where("lft = '[0,20)'").collect()
    assert {(r.inkomensniveau, r.kiesrecht) for r in child} == {(enrich.NOT_APPLICABLE, "Nee")}


def test_interactions_keep_their_totals(spark):
    pop = spark.createDataFrame([("Turks", "Man", "[30,40)", 2, 400), ("Overig", "Vrouw", "[40,50)", 3, 300), ("Overig", "Man", "[0,20)", 1, 50)], "etngrp string, geslacht string, lft string, oplniv int, n int")
    wide = expand.expand_population(pop)
    a, b, child = (("Turks", "Man", "[30,40)", 2), ("Overig", "Vrouw", "[40,50)", 3), ("Overig", "Man", "[0,20)", 1))
    unknown = ("Surinaams", "Man", "[30,40)", 1)
    names = [f"{c} {'int' if c[:3] == 'opl' else 'string'}" for s in ("_src", "_dst") for c in (k + s for k in expand.BASE)]
    links = spark.createDataFrame([(*a, *b, 90), (*a, *a, 31), (*a, *child, 7), (*a, *unknown, 5)], ", ".join([*names, "n int"]))
    out = expand.expand_interactions(links, wide)
    n = {(r.etngrp_src, r.etngrp_dst, r.lft_dst): r.n for r in out.groupBy("etngrp_src", "etngrp_dst", "lft_dst").agg(F.sum("n").alias("n")).collect()}
    # Children's bands weigh nothing, so that row goes; an unknown end stays whole.
    assert n == {("Turks", "Overig", "[40,50)"): 90, ("Turks", "Turks", "[30,40)"): 31, ("Turks", "Surinaams", "[30,40)"): 5}
    near = out.where("etngrp_dst = 'Turks'").agg(F.sum(F.when(F.col("inkomensniveau_src") == F.col("inkomensniveau_dst"), F.col("n")))).first()[0]
    assert near > 31 / 4


def test_enrichment_is_whole_and_allowed(spark):
    nodes = spark.range(400).select(F.col("id").alias("node_id"), F.element_at(F.array(*map(F.lit, enrich.AGE_RANGES)), (F.pmod("id", F.lit(8)) + 1).cast("int")).alias("lft"), (F.pmod("id", F.lit(3)) + 1).cast("int").alias("oplniv"))
    edges = spark.range(400).select(F.col("id").alias("src"), F.pmod(F.col("id") * 7 + 3, F.lit(400)).alias("dst")).where("src <> dst")
    out = enrich.marital_status(enrich.benefits(enrich.work_status(enrich.income(enrich.ages(nodes), edges))), edges).collect()
    assert len(out) == 400
    for r in out:
        low, high = enrich.AGE_RANGES[r.lft]
        assert low <= r.age <= high
        assert (r.inkomensniveau == enrich.NOT_APPLICABLE) == (r.age < 20)
        assert r.arbeidsstatus in enrich.WORK[r.lft]
        assert enrich.MARITAL_BY_AGE[r.lft][enrich.MARITAL.index(r.burgerlijke_staat)] > 0
        assert (r.uitkeringstype is None) == (r.arbeidsstatus not in enrich.BENEFIT)


def test_marital_status_follows_the_order_of_degrees(spark):
    """Against a loop over nodes, one by one by descending degree and then id."""
    r = random.Random(6)
    people = [(i, list(enrich.AGE_RANGES)[r.randrange(8)]) for i in range(120)]
    links = sorted({(a, b) for a, b in ((r.randrange(120), int(120 * r.random() ** 2)) for _ in range(400)) if a != b})
    degree = Counter(x for link in links for x in link)
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b), near[b].add(a)
    size, own, decay = len(enrich.MARITAL), dict(people), enrich.MARITAL_DECAY
    code: dict[int, int] = {}
    for v in sorted(own, key=lambda x: (-degree[x], x)):
        p = list(enrich.MARITAL_BY_AGE[own[v]])
        seen = [code[x] for x in near[v] if x in code]
        if seen:
            h = [sum(decay[abs(c - s)] for s in seen) for c in range(size)]
            p = [(1 - enrich.MARITAL_STRENGTH) * x + enrich.MARITAL_STRENGTH * (y / sum(h) if x > 0 else 0) for x, y in zip(p, h, strict=True)]
        u = int(hashlib.md5(f"42|marital|{v}".encode()).hexdigest()[:12], 16) / 16**12 * sum(p)
        upto = list(itertools.accumulate(p))
        code[v] = next((c for c in range(size) if p[c] > 0 and upto[c] > u), max(c for c in range(size) if p[c] > 0))
    nodes = spark.createDataFrame(people, "node_id long, lft string")
    out = enrich.marital_status(nodes, spark.createDataFrame(links, "src long, dst long"))
    assert {x.node_id: x.burgerlijke_staat for x in out.collect()} == {v: enrich.MARITAL[c] for v, c in code.items()}
