"""Driver queries of the engine's own operators, each beside its DuckDB twin.

``@query(sql)`` registers a function of (spark, sf_dir). SQL runs over the
views in ``fixtures.FX``; queries without SQL are checked by tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.functions.rng import permuted_sql, uniform_sql
from popweave.operators import analysis, composition, contagion, metrics, modularity, outcomes, population, sensitivity, targets
from popweave.plans import fixtures as fx
from popweave.sources.scratch import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = fx.with_views(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places: sums of doubles differ in their last bits between engines."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- population and targets -------------------------------------------------

SCALE = 0.29
ALLOC = f"""
, alloc AS (
  SELECT group_id, seg, reg, n, trunc({SCALE}::DOUBLE * n)::BIGINT AS a,
         trunc({SCALE}::DOUBLE * sum(n) OVER ())::BIGINT AS want, row_number() OVER (ORDER BY n DESC, group_id) AS r FROM fx_groups),
scaled AS (SELECT group_id, seg, reg, n, a + CASE WHEN r <= want - sum(a) OVER () THEN 1 ELSE 0 END AS n_scaled FROM alloc)
"""
TARGETS = f"""
, palloc AS (
  SELECT src_group, dst_group, n, trunc({SCALE}::DOUBLE * n)::BIGINT AS a,
         trunc({SCALE}::DOUBLE * sum(n) OVER ())::BIGINT AS want, row_number() OVER (ORDER BY n DESC, src_group, dst_group) AS r FROM fx_pairs),
targets AS (SELECT src_group, dst_group, n, (a + CASE WHEN r <= want - sum(a) OVER () THEN 1 ELSE 0 END)::BIGINT AS target FROM palloc)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = population.lookup(fx.groups(spark, sf_dir), ["reg", "seg"])
    return targets.pair_counts(targets.with_group_ids(fx.links(spark, sf_dir), known, ["reg", "seg"]))


@query(f"{ALLOC} SELECT group_id, seg, reg, n_scaled::BIGINT AS n_scaled FROM scaled")
def n1_stratified_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.allocate_groups(fx.groups(spark, sf_dir), SCALE).select("group_id", "seg", "reg", "n_scaled")


@query(
    f"{ALLOC}, placed AS (SELECT *, coalesce(sum(n_scaled) OVER (ORDER BY n DESC, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM scaled)"
    " SELECT first + unnest(range(n_scaled::BIGINT)) AS node_id, group_id, seg, reg FROM placed"
)
def n2_expand_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.expand_nodes(population.allocate_groups(fx.groups(spark, sf_dir), SCALE)).select("node_id", "group_id", "seg", "reg")


@query("SELECT reg, seg, max(group_id) AS group_id FROM (SELECT group_id, reg, seg FROM fx_groups UNION ALL SELECT group_id + 100, reg, seg FROM fx_groups WHERE group_id % 2 = 0) GROUP BY reg, seg")
def n3_group_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.groups(spark, sf_dir)
    again = g.where("group_id % 2 = 0").withColumn("group_id", F.col("group_id") + 100)
    return population.lookup(g.unionByName(again), ["reg", "seg"])


@query(f"{TARGETS} SELECT src_group, dst_group, target FROM targets")
def n6_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.link_targets(pairs(spark, sf_dir), SCALE).select("src_group", "dst_group", "target")


@query(f"{TARGETS} SELECT src_group, dst_group, round(target / (sum(target) OVER (PARTITION BY src_group) + 1e-5), 6) AS p FROM targets")
def n7_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.affinity(targets.link_targets(pairs(spark, sf_dir), SCALE)))


@query("SELECT node_id FROM fx_nodes WHERE seg = 'BUILDING' AND reg = 'ASIA'")
def n9_find_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.find_nodes(fx.nodes(spark, sf_dir), seg="BUILDING", reg="ASIA")


@query("SELECT reg, count(*) AS n FROM fx_nodes WHERE seg IN ('BUILDING', 'MACHINERY') GROUP BY reg")
def n10_partial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.nodes(spark, sf_dir).where(F.col("seg").isin("BUILDING", "MACHINERY")).groupBy("reg").agg(F.count("*").alias("n"))


@query(
    """, e AS (SELECT group_id, n, n / sum(n) OVER () * 60 AS exact FROM fx_groups),
    u AS (SELECT group_id, exact, greatest(floor(exact), 1)::BIGINT AS k FROM e)
    SELECT group_id, k + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, group_id) <= 60 - sum(k) OVER () THEN 1 ELSE 0 END AS units FROM u"""
)
def n11_proportional_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.proportional_at_least_one(fx.groups(spark, sf_dir), "n", 60, ["group_id"]).select("group_id", "units")


@query(
    """, cat(category, p) AS (VALUES ('a', 0.5::DOUBLE), ('b', 0.3::DOUBLE), ('c', 0.2::DOUBLE)),
    s AS (SELECT group_id, category, n::BIGINT AS total, p * n AS exact, floor(p * n)::BIGINT AS k FROM fx_groups, cat),
    t AS (SELECT *, k + CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY exact - k DESC, category DESC) <= total - sum(k) OVER (PARTITION BY group_id) THEN 1 ELSE 0 END AS n_split FROM s)
    SELECT group_id, category, n_split FROM t WHERE n_split > 0"""
)
def n12_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "category string, p double")
    rows = fx.groups(spark, sf_dir).select("group_id", F.col("n").cast("long").alias("total")).crossJoin(F.broadcast(cat))
    return population.largest_remainder(rows, ["group_id"], "category", "p", "total").select("group_id", "category", "n_split")


@query(
    """ SELECT 'seg' AS attribute, row_number() OVER (ORDER BY seg) - 1 AS code, seg AS value FROM (SELECT DISTINCT seg FROM fx_nodes)
    UNION ALL SELECT 'reg', row_number() OVER (ORDER BY reg) - 1, reg FROM (SELECT DISTINCT reg FROM fx_nodes)"""
)
def n15_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.encodings(fx.nodes(spark, sf_dir), ["seg", "reg"])


@query(
    """, s AS (SELECT seg, (dense_rank() OVER (ORDER BY seg) - 1)::SMALLINT AS c FROM (SELECT DISTINCT seg FROM fx_nodes)),
    r AS (SELECT reg, (dense_rank() OVER (ORDER BY reg) - 1)::SMALLINT AS c FROM (SELECT DISTINCT reg FROM fx_nodes))
    SELECT node_id, s.c AS seg, r.c AS reg FROM fx_nodes JOIN s USING (seg) JOIN r USING (reg)"""
)
def n15_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.nodes(spark, sf_dir)
    return population.encode(n, population.encodings(n, ["seg", "reg"]), ["seg", "reg"])


CHECK = """, want AS (SELECT src_group, dst_group, trunc(n * 1.2::DOUBLE)::BIGINT AS target FROM fx_pairs WHERE src_group <> 3),
actual AS (SELECT a.group_id AS src_group, b.group_id AS dst_group, count(*) AS actual FROM fx_edges e JOIN fx_gnodes a ON e.src = a.node_id JOIN fx_gnodes b ON e.dst = b.node_id GROUP BY ALL),
checked AS (
  SELECT src_group, dst_group, coalesce(actual, 0) AS actual, coalesce(target, 0) AS target
  FROM actual FULL JOIN want USING (src_group, dst_group))
"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = pairs(spark, sf_dir).where("src_group <> 3").select("src_group", "dst_group", (F.col("n") * 1.2).cast("long").alias("target"))
    return targets.check_group_interactions(fx.edges(spark, sf_dir), fx.grouped_nodes(spark, sf_dir), want)


@query(f"{CHECK} SELECT *, actual - target AS diff, round(CASE WHEN target > 0 THEN actual / target WHEN actual > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS ratio FROM checked")
def e12_check_group_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(checked(spark, sf_dir))


@query(
    f"{CHECK} SELECT sum(target)::BIGINT AS requested, sum(actual)::BIGINT AS created, round(sum(actual) / sum(target), 6) AS rate,"
    " count(*) FILTER (actual > target) AS pairs_over, count(*) FILTER (actual < target) AS pairs_under FROM checked"
)
def e13_fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(targets.fulfilment(checked(spark, sf_dir)))


# --- composition --------------------------------------------------------------

SETS = """, sets AS (
  SELECT concat_ws('_', CASE WHEN grouping(seg) = 0 THEN 'seg' END, CASE WHEN grouping(reg) = 0 THEN 'reg' END) AS combo, seg, reg, sum(n)::BIGINT AS n
  FROM fx_pop GROUP BY GROUPING SETS ((seg), (reg), (seg, reg)))
"""


@query(f"{SETS} SELECT * FROM sets")
def r3_all_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.aggregate_combinations(fx.pop(spark, sf_dir), ["seg", "reg"])


@query(
    f"{SETS} SELECT combo, count(*) AS n_groups, round(sum(n * n) / (sum(n) * sum(n)), 6) AS hhi, round(max(n) / sum(n), 6) AS biggest,"
    " round(sum(n) * sum(n) / sum(n * n), 6) AS effective_n, len(string_split(combo, '_'))::INT AS n_characteristics FROM sets GROUP BY combo"
)
def r4_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composition.concentration(composition.aggregate_combinations(fx.pop(spark, sf_dir), ["seg", "reg"])))


@query(
    """ SELECT seg, reg, row_number() OVER (ORDER BY n, seg, reg)::INT AS rank, round(row_number() OVER (ORDER BY n, seg, reg) / count(*) OVER (), 6) AS group_share,
    round(sum(n) OVER (ORDER BY n, seg, reg ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS count_share FROM fx_pop"""
)
def r28_lorenz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composition.lorenz(fx.pop(spark, sf_dir), ["seg", "reg"]))


@query(
    """, r AS (SELECT group_id AS combo_id, 'g' || group_id AS combo, n::DOUBLE AS hhi FROM fx_groups),
    k AS (SELECT *, row_number() OVER (ORDER BY hhi, combo) - 1 AS r, count(*) OVER () AS c FROM r)
    SELECT combo, hhi FROM k WHERE r IN (SELECT floor(i * (c - 1) / 6) FROM range(7) t(i), (SELECT count(*) AS c FROM fx_groups))"""
)
def r29_spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.groups(spark, sf_dir).select(F.concat(F.lit("g"), "group_id").alias("combo"), F.col("n").alias("hhi"))
    return composition.spread_sample(g, 7)


@query(
    """, r AS (SELECT group_id, 'g' || group_id AS combo, n::DOUBLE AS hhi, group_id % 3 = 0 AS base FROM fx_groups),
    k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY hhi, combo) - 1 AS r, count(*) OVER (PARTITION BY base) AS c, CASE WHEN base THEN 3 ELSE 4 END AS want FROM r)
    SELECT combo, hhi FROM k WHERE list_contains(list_transform(range(least(want, c)), lambda i: floor(i * (c - 1) / greatest(least(want, c) - 1, 1))::BIGINT), r)"""
)
def r29_spread_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.groups(spark, sf_dir).select(F.concat(F.lit("g"), "group_id").alias("combo"), F.col("n").alias("hhi"), "group_id")
    return composition.spread_halves(g, F.col("group_id") % 3 == 0, 7).select("combo", "hhi")


@query(
    """, p AS (SELECT reg, n / sum(n) OVER (PARTITION BY reg) AS p FROM fx_pop)
    SELECT reg, round(-sum(p * ln(p)), 6) AS entropy, count(*) AS kinds, round(1 - sum(p * p), 6) AS simpson, round(ln(count(*)), 6) AS max_entropy, round(-sum(p * ln(p)) / ln(count(*)), 6) AS evenness FROM p GROUP BY reg"""
)
def r9_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composition.shannon(fx.pop(spark, sf_dir), ["reg"]))


HOMOPHILY = """, b AS (
  SELECT sum(n) AS total, sum(n) FILTER (seg_src = seg_dst AND reg_src = reg_dst) AS inside, sum(n) FILTER (seg_src = seg_dst) AS s, sum(n) FILTER (reg_src = reg_dst) AS r FROM fx_links),
a AS (SELECT seg_src AS seg, reg_src AS reg, sum(n)::DOUBLE AS a FROM fx_links GROUP BY ALL),
d AS (SELECT seg_dst AS seg, reg_dst AS reg, sum(n)::DOUBLE AS d FROM fx_links GROUP BY ALL),
k AS (SELECT count(*) AS n_blocks, sum(coalesce(a, 0) * coalesce(d, 0)) AS ab FROM a FULL JOIN d USING (seg, reg))
"""


@query(
    f"{HOMOPHILY} SELECT n_blocks, total::BIGINT AS total_edges, round(inside / total, 6) AS frac_within, round((total - 2 * inside) / total, 6) AS ei_index,"
    " round(inside / total - ab / (total * total), 6) AS modularity_q, round((inside / total - ab / (total * total)) / (1 - ab / (total * total)), 6) AS newman_r,"
    " 2 AS n_dimensions, round((total - 2 * s) / total, 6) AS ei_seg, round((total - 2 * r) / total, 6) AS ei_reg FROM b, k"
)
def r11_homophily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composition.homophily(fx.links(spark, sf_dir), ["seg", "reg"]))


INBREEDING = """, l AS (SELECT 'seg' AS dim, seg_src AS s, seg_dst AS d, n FROM fx_links UNION ALL SELECT 'reg', reg_src, reg_dst, n FROM fx_links),
o AS (SELECT dim, sum(n) FILTER (s = d) / sum(n) AS observed FROM l GROUP BY dim),
v AS (SELECT dim, v, sum(n) AS n FROM (SELECT dim, s AS v, n FROM l UNION ALL SELECT dim, d, n FROM l) GROUP BY ALL),
x AS (SELECT dim, sum(p * p) AS expected FROM (SELECT dim, n / sum(n) OVER (PARTITION BY dim) AS p FROM v) GROUP BY dim),
inb AS (SELECT dim, observed, expected, observed - expected AS excess, observed / expected AS ratio FROM o JOIN x USING (dim))
"""


@query(f"{INBREEDING} SELECT dim, round(observed, 6) AS observed, round(expected, 6) AS expected, round(excess, 6) AS excess, round(ratio, 6) AS ratio FROM inb")
def r12_inbreeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composition.inbreeding(fx.links(spark, sf_dir), ["seg", "reg"]))


def _partitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("seg",), ("reg",), ("seg_reg",)], "partition string")


@query(
    f"{INBREEDING}, parts(partition) AS (VALUES ('seg'), ('reg'), ('seg_reg')), q AS (SELECT partition, unnest(string_split(partition, '_')) AS dim FROM parts)"
    " SELECT partition, round(avg(excess), 6) AS mean, round(min(excess), 6) AS min, round(max(excess), 6) AS max, count(*) AS n_dims FROM q JOIN inb USING (dim) GROUP BY partition"
)
def r13_partition_homophily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composition.partition_summary(_partitions(spark), composition.inbreeding(fx.links(spark, sf_dir), ["seg", "reg"])))


@query(
    """, parts(p) AS (VALUES ('a'), ('b'), ('a_b'), ('a_c'), ('a_b_c'), ('b_c_d')), s AS (SELECT p, string_split(p, '_') AS d FROM parts)
    SELECT f.p AS fine, c.p AS coarse, list_filter(f.d, lambda x: NOT list_contains(c.d, x))[1] AS dropped FROM s f, s c
    WHERE len(list_filter(f.d, lambda x: NOT list_contains(c.d, x))) = 1 AND len(list_filter(c.d, lambda x: NOT list_contains(f.d, x))) = 0"""
)
def j9_coarsening_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.coarsening_pairs(spark.createDataFrame([(p,) for p in ("a", "b", "a_b", "a_c", "a_b_c", "b_c_d")], "partition string"))


SEEDING = """, per AS (SELECT src_group AS group_id, coalesce(sum(n) FILTER (src_group = dst_group), 0) AS i, sum(n) - coalesce(sum(n) FILTER (src_group = dst_group), 0) AS o FROM fx_pairs GROUP BY src_group),
m AS (SELECT g.group_id, g.n AS size, CASE WHEN g.n > 1 THEN coalesce(i, 0) / (g.n * (g.n - 1) / 2) ELSE 0 END AS internal_density, CASE WHEN i > 0 THEN o / i ELSE 0 END AS exposure FROM fx_groups g LEFT JOIN per USING (group_id)),
z AS (SELECT *, CASE WHEN max(internal_density) OVER () > 0 THEN internal_density / max(internal_density) OVER () ELSE 0 END AS density_norm, CASE WHEN max(exposure) OVER () > 0 THEN exposure / max(exposure) OVER () ELSE 0 END AS exposure_norm FROM m),
scores AS (SELECT *, 0.9::DOUBLE * density_norm + 0.1::DOUBLE * exposure_norm AS combined_score FROM z)
"""


def seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.seeding_metrics(pairs(spark, sf_dir), fx.groups(spark, sf_dir))


@query(f"{SEEDING} SELECT group_id, size::DOUBLE AS size, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("internal_density", "exposure", "density_norm", "exposure_norm", "combined_score")) + " FROM scores")
def r14_seeding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seeding(spark, sf_dir))


@query(
    f"{SEEDING}, c AS (SELECT group_id, size::DOUBLE AS size, combined_score, (sum(size) OVER (ORDER BY combined_score DESC, group_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS cumulative, sum(size) OVER () * 0.1 AS need FROM scores)"
    " SELECT group_id, size, round(combined_score, 6) AS combined_score, cumulative FROM c WHERE cumulative - size < need"
)
def r32_seed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(composition.seed_groups(seeding(spark, sf_dir), 0.1))


# --- graph metrics --------------------------------------------------------------

DEGREES = """, i AS (SELECT dst AS node_id, count(*) AS k FROM fx_edges GROUP BY dst), o AS (SELECT src AS node_id, count(*) AS k FROM fx_edges GROUP BY src),
deg AS (SELECT node_id, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree FROM fx_nodes LEFT JOIN i USING (node_id) LEFT JOIN o USING (node_id))
"""
UNDIRECTED = ", und AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM fx_edges), k AS (SELECT x, count(*) AS k FROM (SELECT u AS x FROM und UNION ALL SELECT v FROM und) GROUP BY x), tri AS (SELECT a.u, a.v, b.v AS w FROM und a JOIN und b ON a.v = b.u JOIN und c ON c.u = a.u AND c.v = b.v)"


@query(f"{DEGREES} SELECT * FROM deg")
def m1_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.degrees(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir))


@query(
    f"{DEGREES}, s AS (SELECT avg(degree) AS m, var_pop(degree) AS v FROM deg) SELECT round(avg(degree), 6) AS mean, round(stddev_pop(degree), 6) AS std, min(degree) AS min,"
    " quantile_cont(degree::DOUBLE, 0.5) AS median, quantile_cont(degree::DOUBLE, 0.9) AS q90, max(degree) AS max, round(avg(pow(degree - m, 3)) / pow(any_value(v), 1.5), 6) AS skew, count(*) FILTER (degree = 0) AS zeros FROM deg, s"
)
def m1_degree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.degree_summary(metrics.degrees(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir))))


@query(" SELECT count(*) AS n_edges, count(*) FILTER (m) AS n_mutual, round(count(*) FILTER (m) / count(*), 6) AS reciprocity FROM (SELECT EXISTS (SELECT 1 FROM fx_edges b WHERE b.src = e.dst AND b.dst = e.src) AS m FROM fx_edges e)")
def m2_reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.reciprocity(fx.edges(spark, sf_dir)))


@query(f"{UNDIRECTED} SELECT (SELECT count(*) FROM tri) AS n_triangles, sum(k * (k - 1) // 2)::BIGINT AS n_triples, round(3 * (SELECT count(*) FROM tri) / sum(k * (k - 1) // 2), 6) AS transitivity FROM k")
def m3_transitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.transitivity(fx.edges(spark, sf_dir)))


@query(
    f"{UNDIRECTED}, t AS (SELECT x, count(*) AS t FROM (SELECT u AS x FROM tri UNION ALL SELECT v FROM tri UNION ALL SELECT w FROM tri) GROUP BY x)"
    " SELECT node_id, coalesce(k, 0) AS k, round(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) END, 6) AS clustering FROM fx_nodes LEFT JOIN k ON x = node_id LEFT JOIN t USING (x)"
)
def m4_local_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.local_clustering(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir)))


@query(
    f"{UNDIRECTED}, t AS (SELECT x, count(*) AS t FROM (SELECT u AS x FROM tri UNION ALL SELECT v FROM tri UNION ALL SELECT w FROM tri) GROUP BY x)"
    " SELECT round(avg(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END), 6) AS clustering, round(avg(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) END), 6) AS of_linked FROM fx_nodes LEFT JOIN k ON x = node_id LEFT JOIN t USING (x)"
)
def m4_average_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir)
    both = metrics.average_clustering(n, e).crossJoin(metrics.average_clustering(n, e, skip_small=True).withColumnRenamed("clustering", "of_linked"))
    return rounded(both)


@query(" SELECT n AS n_nodes, e AS n_edges, round(e / (n * (n - 1)), 6) AS density, round(e / n, 6) AS mean_degree FROM (SELECT count(*) AS n FROM fx_nodes), (SELECT count(*) AS e FROM fx_edges)")
def m5_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.density(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir)))


@query(
    """, und AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM fx_edges),
    e AS (SELECT a.group_id AS cu, b.group_id AS cv FROM und JOIN fx_gnodes a ON u = a.node_id JOIN fx_gnodes b ON v = b.node_id),
    d AS (SELECT c, count(*) AS d FROM (SELECT cu AS c FROM e UNION ALL SELECT cv FROM e) GROUP BY c)
    SELECT (SELECT count(*) FROM d) AS n_communities, round(count(*) FILTER (cu = cv) / count(*) - (SELECT sum(d * d) FROM d) / (4 * count(*) * count(*)), 6) AS modularity FROM e"""
)
def m6_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.grouped_nodes(spark, sf_dir).select("node_id", F.col("group_id").alias("community"))
    return rounded(metrics.modularity(fx.edges(spark, sf_dir), c))


@query(", o AS (SELECT src, count(*) AS o FROM fx_edges GROUP BY src), i AS (SELECT dst, count(*) AS i FROM fx_edges GROUP BY dst) SELECT round(corr(o, i), 6) AS assortativity FROM fx_edges JOIN o USING (src) JOIN i USING (dst)")
def m7_assortativity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.assortativity(fx.edges(spark, sf_dir)))


COMPONENTS = """, ce AS MATERIALIZED (SELECT src AS a, dst AS b FROM fx_edges UNION SELECT dst, src FROM fx_edges)""" + "".join(
    f", l{i} AS MATERIALIZED ("
    + (" SELECT node_id, node_id AS c FROM fx_nodes" if i == 0 else f" SELECT l.node_id, least(min(l.c), min(coalesce(m.c, l.c))) AS c FROM l{i - 1} l LEFT JOIN ce ON ce.a = l.node_id LEFT JOIN l{i - 1} m ON m.node_id = ce.b GROUP BY l.node_id")
    + ")"
    for i in range(16)
)
#: All of the largest component below 1000 nodes, else 100 drawn ones.
SOURCES = f"""{COMPONENTS}, sources AS MATERIALIZED (
  SELECT node_id FROM l15 WHERE (SELECT count(*) FROM fx_nodes) < 1000 AND c = (SELECT c FROM l15 GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)
  UNION ALL (SELECT node_id FROM fx_nodes WHERE (SELECT count(*) FROM fx_nodes) >= 1000 ORDER BY {uniform_sql(42, "source", "node_id")}, node_id LIMIT 100))"""


def _bfs_sql(rounds: int, sources: str = "sources") -> str:
    parts = [f", d0 AS MATERIALIZED (SELECT node_id AS source, node_id, 0 AS distance FROM {sources})"]
    for i in range(1, rounds + 1):
        parts.append(f", d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT DISTINCT d.source, e.dst, {i} FROM d{i - 1} d JOIN fx_edges e ON e.src = d.node_id WHERE d.distance = {i - 1} AND NOT EXISTS (SELECT 1 FROM d{i - 1} x WHERE x.source = d.source AND x.node_id = e.dst))")
    return "".join(parts)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.path_sources(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir))


@query(f"{SOURCES}{_bfs_sql(12)} SELECT source, node_id, distance FROM d12")
def m8_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distances(fx.edges(spark, sf_dir), _sources(spark, sf_dir))


@query(f"{SOURCES}{_bfs_sql(12)} SELECT round(avg(distance), 6) AS path_length, count(*) AS n_pairs FROM d12 WHERE distance > 0")
def m8_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_path_length(fx.edges(spark, sf_dir), _sources(spark, sf_dir)))


@query(f"{COMPONENTS} SELECT node_id, c AS component FROM l15")
def m9_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.components(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir))


@query(f"{_bfs_sql(12, '(SELECT 7 AS node_id)')}, kept AS (SELECT node_id FROM d12 ORDER BY distance, node_id LIMIT 60) SELECT src, dst FROM fx_edges WHERE src IN (SELECT node_id FROM kept) AND dst IN (SELECT node_id FROM kept)")
def m10_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.extract_subgraph(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir), 7, 60)
    assert found is not None
    return found[1]


@query(" SELECT node_id, node_id AS position FROM fx_nodes WHERE node_id IN (SELECT src FROM fx_edges UNION SELECT dst FROM fx_edges) ORDER BY position LIMIT 50")
def m11_non_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fx.nodes(spark, sf_dir).select("node_id", F.col("node_id").alias("position"))
    return metrics.non_isolates(wanted, fx.edges(spark, sf_dir), 50)


def spread_sql(nodes: str, edges: str) -> str:
    """Label propagation of nodes (network, node_id) over edges (network, src, dst), all networks in step."""
    return f""", lp_pairs AS MATERIALIZED (SELECT network, src AS a, dst AS b FROM ({edges}) UNION SELECT network, dst, src FROM ({edges})),
lp AS (
  SELECT 0 AS r, network, node_id, node_id AS community, NULL::BIGINT AS was, NULL::BIGINT AS before, true AS moves FROM ({nodes})
  UNION ALL
  SELECT *, (count(*) FILTER (was <> community) OVER ()) > 0 AND (count(*) FILTER (before IS DISTINCT FROM community) OVER ()) > 0 FROM (
    SELECT l.r + 1, l.network, l.node_id, best.b AS community, l.community AS was, l.was AS before
    FROM lp l JOIN (
      SELECT network, node_id, min(struct_pack(n := -n, b := community)).b AS b FROM (
        SELECT network, node_id, community, count(*) AS n FROM (
          SELECT p.network, p.a AS node_id, x.community FROM lp_pairs p JOIN lp x ON x.network = p.network AND x.node_id = p.b
          UNION ALL SELECT network, node_id, community FROM lp) GROUP BY ALL) GROUP BY network, node_id) best USING (network, node_id)
    WHERE l.moves)),
spread AS MATERIALIZED (SELECT network, node_id, community FROM lp WHERE r = (SELECT max(r) FROM lp))
"""


SPREAD = spread_sql("SELECT '' AS network, node_id FROM fx_nodes", "SELECT '' AS network, src, dst FROM fx_edges")


@query(f"{SPREAD} SELECT node_id, community FROM spread")
def m6_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_propagation(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir))


@query(
    f"{SOURCES}{_bfs_sql(12)}{SPREAD}{DEGREES}{UNDIRECTED}, o2 AS (SELECT src, count(*) AS o FROM fx_edges GROUP BY src), i2 AS (SELECT dst, count(*) AS i FROM fx_edges GROUP BY dst), im AS (SELECT avg(in_degree) AS m, var_pop(in_degree) AS v FROM deg),"
    " e AS (SELECT a.community AS cu, b.community AS cv FROM und JOIN spread a ON u = a.node_id JOIN spread b ON v = b.node_id), dd AS (SELECT c, count(*) AS d FROM (SELECT cu AS c FROM e UNION ALL SELECT cv FROM e) GROUP BY c)"
    " SELECT (SELECT count(*) FROM fx_edges) AS n_edges, (SELECT round(avg(CASE WHEN b.src IS NULL THEN 0.0 ELSE 1.0 END), 6) FROM fx_edges a LEFT JOIN fx_edges b ON b.src = a.dst AND b.dst = a.src) AS reciprocity,"
    " (SELECT round(3 * (SELECT count(*) FROM tri) / sum(k * (k - 1) // 2), 6) FROM k) AS transitivity, (SELECT round(avg(distance), 6) FROM d12 WHERE distance > 0) AS path_length,"
    " (SELECT round(avg(pow(in_degree - m, 3)) / pow(any_value(v), 1.5), 6) FROM deg, im) AS in_degree_skew, (SELECT round(corr(o, i), 6) FROM fx_edges JOIN o2 USING (src) JOIN i2 USING (dst)) AS assortativity,"
    " (SELECT count(*) FROM dd) AS n_communities, (SELECT round(count(*) FILTER (cu = cv) / count(*) - (SELECT sum(d * d) FROM dd) / (4 * count(*) * count(*)), 6) FROM e) AS modularity"
)
def m12_metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.metric_bundle(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir), _sources(spark, sf_dir)))


# --- contagion ------------------------------------------------------------------


def _configs(spark: SparkSession, thresholds: list[float], runs: int = 2) -> DataFrame:
    rows = [(i * runs + r, t) for i, t in enumerate(thresholds) for r in range(runs)]
    return spark.createDataFrame(rows, "config long, threshold double")


def seeds_sql(name: str, requests: str, stream: str = "seed", seed: int = 42, nodes: str = "fx_nodes") -> str:
    """CTEs of ``name`` (config, node_id): for each of ``requests`` (config, initial) its drawn nodes."""
    return f""", {name}_p AS MATERIALIZED (SELECT node_id, row_number() OVER (ORDER BY {uniform_sql(seed, "place", "node_id")}, node_id) - 1 AS place FROM {nodes}),
{name}_b AS (SELECT count(*) AS n, greatest(ceil(log2(greatest(count(*), 2)) / 2), 1)::BIGINT AS b FROM {name}_p),
{name}_i AS (SELECT config, initial, n, b, unnest(range(1::BIGINT << (2 * b))) AS i FROM ({requests}), {name}_b),
{name} AS MATERIALIZED (
  SELECT config, node_id FROM (
    SELECT config, initial, place, row_number() OVER (PARTITION BY config ORDER BY i) AS r
    FROM (SELECT *, {permuted_sql(seed, stream, "i", "b", "config")} AS place FROM {name}_i) WHERE place < n) JOIN {name}_p USING (place) WHERE r <= initial)
"""


def spread_until(seeds: str, condition: str, joins: str = "", limit: int = 1000) -> str:
    """CTEs k and adopted (config, node_id, step): nodes of which ``condition`` holds for n of their
    k successors adopt, until no configuration changes or for ``limit`` steps. There is a table cfg."""
    return f""", k AS (SELECT src AS node_id, count(*) AS k FROM fx_edges GROUP BY src),
a AS (
  SELECT 0 AS r, config, node_id, 0 AS step, true AS moves FROM ({seeds})
  UNION ALL
  SELECT r + 1, config, node_id, step, (count(*) FILTER (step = r + 1) OVER ()) > 0 AND r + 1 < {limit} FROM (
    SELECT r, config, node_id, step FROM a WHERE moves
    UNION ALL
    SELECT n.r, n.config, n.node_id, n.r + 1 FROM (
      SELECT a.r, a.config, e.src AS node_id, count(*) AS n FROM a JOIN fx_edges e ON e.dst = a.node_id WHERE a.moves GROUP BY ALL) n
    JOIN k USING (node_id) JOIN cfg USING (config) {joins} LEFT JOIN a x ON x.config = n.config AND x.node_id = n.node_id
    WHERE x.node_id IS NULL AND {condition})),
adopted AS MATERIALIZED (SELECT config, node_id, step FROM a WHERE r = (SELECT max(r) FROM a))
"""


THRESHOLDS = [0.05, 0.1]
CONFIGS = ", ".join(f"({i * 2 + r}, {t}::DOUBLE)" for i, t in enumerate(THRESHOLDS) for r in range(2))


CFG = f", cfg(config, threshold) AS (VALUES {CONFIGS})"
SHARE = "n.n / k.k >= cfg.threshold"
THRESHOLD_RUN = f"{CFG}{seeds_sql('seeds', 'SELECT config, 60 AS initial FROM cfg')}{spread_until('FROM seeds', SHARE)}"


def _threshold_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    configs = _configs(spark, THRESHOLDS)
    seeds = contagion.seed_random(configs, fx.nodes(spark, sf_dir), 60)
    return configs, contagion.threshold_contagion(fx.edges(spark, sf_dir), seeds, configs)


@query(f"{CFG}{seeds_sql('seeds', 'SELECT config, 25 AS initial FROM cfg')} SELECT config::BIGINT AS config, node_id FROM seeds")
def x5_seed_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contagion.seed_random(_configs(spark, THRESHOLDS), fx.nodes(spark, sf_dir), 25)


@query(" SELECT 0::BIGINT AS config, dst AS node_id FROM fx_edges WHERE src = 7 UNION SELECT 0, 7")
def x5_seed_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contagion.seed_focal(_configs(spark, [0.1], 1), fx.edges(spark, sf_dir), 7)


@query(f"{THRESHOLD_RUN} SELECT config::BIGINT AS config, node_id, step FROM adopted")
def x2_threshold_contagion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threshold_run(spark, sf_dir)[1]


@query(
    f", cfg(config, threshold) AS (VALUES (0, 2::DOUBLE)){seeds_sql('seeds', 'SELECT config, 100 AS initial FROM cfg')}{spread_until('FROM seeds', 'n.n >= cfg.threshold')}"
    " SELECT config::BIGINT AS config, node_id, step FROM adopted"
)
def x2_absolute_contagion(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = _configs(spark, [2.0], 1)
    seeds = contagion.seed_random(configs, fx.nodes(spark, sf_dir), 100)
    return contagion.threshold_contagion(fx.edges(spark, sf_dir), seeds, configs, relative=False)


@query(
    f", cfg(config) AS (VALUES (0), (1)){seeds_sql('seeds', 'SELECT config, 20 AS initial FROM cfg')}"
    f""", a AS (
  SELECT 0 AS r, config, node_id, 0 AS step FROM seeds
  UNION ALL
  SELECT r + 1, config, node_id, step FROM (
    SELECT r, config, node_id, step FROM a
    UNION ALL
    SELECT n.r, n.config, n.node_id, n.r + 1 FROM (SELECT a.r, a.config, e.src AS node_id, count(*) AS n FROM a JOIN fx_edges e ON e.dst = a.node_id GROUP BY ALL) n
    LEFT JOIN a x ON x.config = n.config AND x.node_id = n.node_id
    WHERE x.node_id IS NULL AND {uniform_sql(42, "transmit", "n.config", "n.r + 1", "n.node_id")} < 1 - pow(0.8::DOUBLE, n.n)) WHERE r < 30)
SELECT config::BIGINT AS config, node_id, step FROM a WHERE r = 30"""
)
def x1_simple_contagion(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = _configs(spark, [0.0], 2)
    return contagion.simple_contagion(fx.edges(spark, sf_dir), contagion.seed_random(configs, fx.nodes(spark, sf_dir), 20))


HYBRID = f" SELECT node_id, (CASE WHEN row_number() OVER (ORDER BY {uniform_sql(42, 'vulnerable', 'node_id')}, node_id) <= floor(0.25 * count(*) OVER ()) THEN 0.02 ELSE 0.3 END)::DOUBLE AS threshold FROM fx_nodes"


@query(HYBRID)
def x4_hybrid_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contagion.thresholds_hybrid(fx.nodes(spark, sf_dir), 0.3, 0.02, 0.25)


@query(
    f", cfg(config) AS (VALUES (0), (1)){seeds_sql('seeds', 'SELECT config, 60 AS initial FROM cfg')}, hy AS MATERIALIZED ({HYBRID})"
    f"{spread_until('FROM seeds', 'n.n / k.k >= hy.threshold', 'JOIN hy USING (node_id)')} SELECT config::BIGINT AS config, node_id, step FROM adopted"
)
def x4_hybrid_contagion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.nodes(spark, sf_dir)
    seeds = contagion.seed_random(_configs(spark, [0.0], 2), n, 60)
    return contagion.threshold_contagion(fx.edges(spark, sf_dir), seeds, contagion.thresholds_hybrid(n, 0.3, 0.02, 0.25))


@query(
    f" SELECT node_id, round(least(greatest(0.2::DOUBLE + 0.05::DOUBLE * sqrt(-2.0 * ln(1.0 - {uniform_sql(42, 'threshold/r', 'node_id')})) * cos(2.0 * pi() * {uniform_sql(42, 'threshold/t', 'node_id')}), 0), 1), 6) AS threshold FROM fx_nodes"
)
def x3_normal_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contagion.thresholds_heterogeneous(fx.nodes(spark, sf_dir), "normal", 0.2))


@query(
    f"{THRESHOLD_RUN}, g AS (SELECT config, unnest(range((SELECT max(step) + 1 FROM adopted))) AS step FROM cfg)"
    " SELECT g.config::BIGINT AS config, g.step::INT AS step, (SELECT count(*) FROM adopted x WHERE x.config = g.config AND x.step <= g.step) AS infected FROM g"
)
def x14_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contagion.series(_threshold_run(spark, sf_dir)[1])


@query(
    f"{THRESHOLD_RUN}, f AS (SELECT threshold, config, count(*)::DOUBLE AS x FROM adopted JOIN cfg USING (config) GROUP BY ALL)"
    " SELECT threshold, round(avg(x), 6) AS mean_final_adoption, round(median(x), 6) AS median_final_adoption, round(var_pop(x), 6) AS variance_final_adoption,"
    " min(x)::BIGINT AS min_final_adoption, max(x)::BIGINT AS max_final_adoption, count(*) AS n_runs FROM f GROUP BY threshold"
)
def x11_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs, adopted = _threshold_run(spark, sf_dir)
    return rounded(contagion.sweep_summary(contagion.final_adoption(adopted, configs), ["threshold"]))


CURVE = """, c AS (SELECT network, threshold_idx::DOUBLE AS x, avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) + threshold_idx * 0.2 AS y FROM fx_runs GROUP BY network, threshold_idx),
w AS (SELECT network, list(x ORDER BY x) AS x, list(y ORDER BY x) AS y, count(*) AS n FROM c GROUP BY network),
placed AS (SELECT *, CASE WHEN y[1] > y[n] THEN list_max(list_filter(range(1, n + 1), lambda i: y[i] >= 0.5)) ELSE greatest(list_min(list_filter(range(1, n + 1), lambda i: y[i] >= 0.5)) - 1, 1) END AS i,
  list_min(list_transform(y, lambda v: v >= 0.5)) <> list_max(list_transform(y, lambda v: v >= 0.5)) AS mixed FROM w),
cross_ AS (SELECT network, CASE WHEN NOT mixed THEN NULL WHEN i >= n THEN x[n] WHEN abs(y[i + 1] - y[i]) < 1e-10 THEN (x[i] + x[i + 1]) / 2 ELSE x[i] + (0.5 - y[i]) * (x[i + 1] - x[i]) / (y[i + 1] - y[i]) END AS critical FROM placed),
inner_ AS (SELECT network, i, (pow(x[i] - x[i - 1], 2) * y[i + 1] + (pow(x[i + 1] - x[i], 2) - pow(x[i] - x[i - 1], 2)) * y[i] - pow(x[i + 1] - x[i], 2) * y[i - 1]) / ((x[i] - x[i - 1]) * (x[i + 1] - x[i]) * (x[i + 1] - x[i - 1])) AS g FROM (SELECT *, unnest(range(2, n)) AS i FROM w)),
grads AS (SELECT network, max(abs(g)) AS steepness FROM (SELECT network, g FROM inner_ UNION ALL SELECT network, (y[2] - y[1]) / (x[2] - x[1]) FROM w WHERE n > 1 UNION ALL SELECT network, (y[n] - y[n - 1]) / (x[n] - x[n - 1]) FROM w WHERE n > 1) GROUP BY network),
area AS (SELECT network, sum((x[i + 1] - x[i]) * (y[i + 1] + y[i]) / 2) AS auc FROM (SELECT *, unnest(range(1, n)) AS i FROM w) GROUP BY network)
"""


@query(f"{CURVE} SELECT network, round(critical, 6) AS critical, round(auc, 6) AS auc, round(steepness, 6) AS steepness FROM cross_ JOIN area USING (network) JOIN grads USING (network)")
def x7_curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.runs(spark, sf_dir).groupBy("network", "threshold_idx").agg(F.avg((F.col("value") > 30).cast("double")).alias("y"))
    curve = r.select("network", F.col("threshold_idx").cast("double").alias("x"), (F.col("y") + F.col("threshold_idx") * 0.2).alias("y"))
    return rounded(contagion.curve_summary(curve, ["network"], "x", "y"))


@query(" SELECT network, threshold_idx, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END), 6) AS cascade_prob FROM fx_runs GROUP BY ALL")
def x7_cascade_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contagion.cascade_points(fx.runs(spark, sf_dir), ["network"], "threshold_idx", "value", 30.0)
    return c.select("network", "threshold_idx", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("cascade_prob", 6).alias("cascade_prob"))


STRATEGIES = ["combined_score", "internal_density", "external_exposure_ratio", "random", "size"]


def _strategies_sql(share: float, thresholds: list[float], runs: int) -> str:
    parts = [f"{SEEDING}, sc AS (SELECT *, exposure AS external_exposure_ratio FROM scores), ini AS (SELECT trunc(count(*) * {share}::DOUBLE)::BIGINT AS k, count(*) AS n FROM fx_nodes)"]
    rows, config = [], 0
    for s, strategy in enumerate(STRATEGIES):
        if strategy == "random":
            parts.append(f", cand{s} AS MATERIALIZED (SELECT node_id FROM fx_nodes)")
        else:
            parts.append(f", cand{s} AS MATERIALIZED (SELECT node_id FROM fx_gnodes WHERE group_id IN (SELECT group_id FROM (SELECT group_id, size, sum(size) OVER (ORDER BY {strategy} DESC, group_id ROWS UNBOUNDED PRECEDING) AS upto FROM sc), ini WHERE upto - size < {share}::DOUBLE * ini.n))")
        own = []
        for t, v in enumerate(thresholds):
            for _ in range(runs):
                own.append(f"({config}, '{strategy}', {t}, {v}::DOUBLE)")
                config += 1
        rows += own
        pool = f"(SELECT node_id FROM cand{s} WHERE (SELECT count(*) FROM cand{s}) >= (SELECT k FROM ini) UNION ALL SELECT node_id FROM fx_nodes WHERE (SELECT count(*) FROM cand{s}) < (SELECT k FROM ini))"
        parts.append(f", cf{s}(config, strategy, ti, threshold) AS (VALUES {', '.join(own)}), pool{s} AS MATERIALIZED {pool}")
        parts.append(seeds_sql(f"sd{s}", f"SELECT config, (SELECT k FROM ini) AS initial FROM cf{s}", seed=42 + s, nodes=f"pool{s}"))
    parts.append(f", cfg(config, strategy, threshold_idx, threshold) AS (VALUES {', '.join(rows)})")
    parts.append(spread_until(" UNION ALL ".join(f"SELECT * FROM sd{s}" for s in range(len(STRATEGIES))), SHARE))
    return "".join(parts) + " SELECT strategy, threshold_idx, threshold, median(c)::DOUBLE AS median_final_adoption, count(*) AS n_runs FROM (SELECT cfg.*, (SELECT count(*) FROM adopted x WHERE x.config = cfg.config) AS c FROM cfg) GROUP BY ALL"


@query(_strategies_sql(0.04, [0.05, 0.1], 3))
def x11_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = seeding(spark, sf_dir).withColumn("external_exposure_ratio", F.col("exposure"))
    n = fx.grouped_nodes(spark, sf_dir)
    return contagion.strategy_sweep(fx.edges(spark, sf_dir), fx.nodes(spark, sf_dir), n, m, STRATEGIES, [0.05, 0.1], 3, 0.04)


def _runs_sql(values: list[float], runs: int, name: str) -> str:
    return f", cfg({name}, run, config) AS (VALUES " + ", ".join(f"({v}::DOUBLE, {r}, {i * runs + r})" for i, v in enumerate(values) for r in range(runs)) + ")"


FOCALS = f"{seeds_sql('fo', 'SELECT config, 1 AS initial FROM focal_cfg', 'focal')}, focals AS MATERIALIZED (SELECT * FROM fo UNION SELECT fo.config, e.dst FROM fo JOIN fx_edges e ON e.src = fo.node_id)"
FINALS = ", fin AS (SELECT cfg.*, (SELECT count(*) FROM adopted x WHERE x.config = cfg.config) * 100.0 / (SELECT count(*) FROM fx_nodes) AS percent FROM cfg)"


@query(
    f"{_runs_sql([1, 2, 3], 2, 'threshold')}, focal_cfg AS (SELECT config FROM cfg WHERE threshold > 1){FOCALS}{seeds_sql('one', 'SELECT config, 1 AS initial FROM cfg WHERE threshold <= 1')}"
    f"{spread_until('SELECT * FROM one UNION ALL SELECT * FROM focals', 'n.n >= cfg.threshold', limit=50)}{FINALS} SELECT threshold, run, round(percent, 6) AS percent FROM fin"
)
def x6_uncontested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contagion.sweep_uncontested(fx.edges(spark, sf_dir), fx.nodes(spark, sf_dir), [1, 2, 3], 2))


@query(f"{_runs_sql([0.05, 0.1], 2, 'threshold')}, focal_cfg AS (SELECT config FROM cfg){FOCALS}{spread_until('FROM focals', SHARE, limit=50)}{FINALS} SELECT threshold, run, round(percent, 6) AS percent FROM fin")
def x6_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contagion.sweep_contested(fx.edges(spark, sf_dir), fx.nodes(spark, sf_dir), [0.05, 0.1], 2))


@query(
    f"{_runs_sql([0.0, 0.2], 2, 'fraction')}, vu AS MATERIALIZED (SELECT node_id, row_number() OVER (ORDER BY {uniform_sql(42, 'vulnerable', 'node_id')}, node_id) - 1 AS place FROM fx_nodes), focal_cfg AS (SELECT config FROM cfg){FOCALS}"
    f"{spread_until('FROM focals', 'n.n >= CASE WHEN place < floor(cfg.fraction * (SELECT count(*) FROM fx_nodes)) THEN 1 ELSE 2 END', 'JOIN vu USING (node_id)', 50)}{FINALS} SELECT fraction, run, round(percent, 6) AS percent FROM fin"
)
def x6_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contagion.sweep_hybrid(fx.edges(spark, sf_dir), fx.nodes(spark, sf_dir), [0.0, 0.2], runs=2))


COMBINED = ", ".join(f"({t}::DOUBLE, {f}::DOUBLE, {r}, {(i * 2 + j) * 2 + r})" for i, t in enumerate((0.05, 0.1)) for j, f in enumerate((0.01, 0.05)) for r in range(2))
SIZED = "SELECT config, greatest(floor(seed_fraction * (SELECT count(*) FROM fx_nodes)), 1) AS initial FROM cfg"


@query(f", cfg(threshold, seed_fraction, run, config) AS (VALUES {COMBINED}){seeds_sql('seeds', SIZED)}{spread_until('FROM seeds', SHARE, limit=50)}{FINALS} SELECT threshold, seed_fraction, round(avg(percent), 6) AS mean_percent FROM fin GROUP BY ALL")
def x6_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contagion.sweep_combined(fx.edges(spark, sf_dir), fx.nodes(spark, sf_dir), [0.05, 0.1], [0.01, 0.05], 2))


LAYERED = ", le AS (SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst, a.o_orderpriority AS network FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey)"


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    first = o.select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("network"), (F.col("o_orderkey") + 1).alias("k"))
    return first.join(o.select(F.col("o_custkey").alias("dst"), F.col("o_orderkey").alias("k")), "k").where("src <> dst").select("src", "dst", "network").distinct()


@query(
    f"{LAYERED}, tn AS MATERIALIZED (SELECT network, src AS id FROM le UNION SELECT network, dst FROM le), sz AS (SELECT network, count(*) AS n_nodes FROM tn GROUP BY network), rr AS (SELECT i AS config FROM range(3) t(i)),"
    f" tp AS MATERIALIZED (SELECT network, id, row_number() OVER (PARTITION BY network ORDER BY {uniform_sql(42, 'place', 'network', 'id')}, id) - 1 AS place FROM tn),"
    " tb AS (SELECT network, config, n_nodes, greatest(ceil(log2(greatest(n_nodes, 2)) / 2), 1)::BIGINT AS b FROM sz, rr), ti AS (SELECT *, unnest(range(1::BIGINT << (2 * b))) AS i FROM tb),"
    f" ts AS MATERIALIZED (SELECT network, config, id FROM (SELECT *, row_number() OVER (PARTITION BY network, config ORDER BY i) AS r FROM (SELECT *, {permuted_sql(42, 'seed', 'i', 'b', 'network', 'config')} AS place FROM ti) WHERE place < n_nodes) JOIN tp USING (network, place) WHERE r <= 30),"
    " k AS (SELECT network, src AS id, count(*) AS k FROM le GROUP BY ALL),"
    """ a AS (
  SELECT 0 AS r, network, config, id, 0 AS step, true AS moves FROM ts
  UNION ALL
  SELECT r + 1, network, config, id, step, (count(*) FILTER (step = r + 1) OVER ()) > 0 FROM (
    SELECT r, network, config, id, step FROM a WHERE moves
    UNION ALL
    SELECT n.r, n.network, n.config, n.id, n.r + 1 FROM (
      SELECT a.r, a.network, a.config, e.src AS id, count(*) AS n FROM a JOIN le e ON e.network = a.network AND e.dst = a.id WHERE a.moves GROUP BY ALL) n
    JOIN k USING (network, id) LEFT JOIN a x ON x.network = n.network AND x.config = n.config AND x.id = n.id
    WHERE x.id IS NULL AND n.n / k.k >= 0.25)),
fin AS MATERIALIZED (SELECT network, config, count(*) AS infected FROM a WHERE r = (SELECT max(r) FROM a) GROUP BY ALL)
SELECT network, config AS run, coalesce(infected, 0) AS infected, n_nodes FROM tb LEFT JOIN fin USING (network, config)"""
)
def x15_compare_topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contagion.compare_topologies(layered(spark, sf_dir), 30, 0.25, 3)


# --- outcomes -------------------------------------------------------------------

DECOMPOSE = """, s AS (SELECT *, max(value) OVER (PARTITION BY network) AS size FROM fx_runs),
r AS (SELECT network, threshold_idx, value AS v, 0.1::DOUBLE * size AS cutoff, avg(value) OVER c AS m, quantile_cont(value, 0.25) OVER c AS q1 FROM s WINDOW c AS (PARTITION BY network, threshold_idx)),
g AS (SELECT network, threshold_idx, count(*) AS n_runs, any_value(cutoff) AS cutoff, avg(v) AS mean_raw, var_pop(v) AS var_raw, count(*) FILTER (v >= cutoff) / count(*) AS p_ignite,
  avg(v) FILTER (v >= cutoff) AS mean_ignited, stddev_pop(v) FILTER (v >= cutoff) AS std_ignited, avg(v) FILTER (v < cutoff) AS mean_failed, stddev_pop(v) FILTER (v < cutoff) AS std_failed,
  avg(CASE WHEN v <= q1 THEN 1.0 ELSE 0.0 END) AS frac_at_seed, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4 FROM r GROUP BY ALL)
"""
_DEC = ("cutoff", "mean_raw", "var_raw", "p_ignite", "mean_ignited", "std_ignited", "mean_failed", "std_failed", "frac_at_seed")


def _decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.runs(spark, sf_dir)
    size = r.groupBy("network").agg(F.max("value").alias("size"))
    return outcomes.decompose(r.join(size, "network"), ["network", "threshold_idx"], "value", F.col("size"), 0.1)


@query(
    f"{DECOMPOSE} SELECT network, threshold_idx, n_runs, {', '.join(f'round({c}, 4) AS {c}' for c in _DEC)}, round((m3 * m3 / pow(m2, 3) + 1) / (m4 / (m2 * m2) - 3 + 3 * pow(n_runs - 1, 2) / ((n_runs - 2) * (n_runs - 3))), 4) AS bimodality, 0.0::DOUBLE AS mean_reconstruction_err FROM g"
)
def r15_ignition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_decomposed(spark, sf_dir), 4)


VSPLIT = """, c AS (SELECT network, threshold_idx, run % 10 AS structure, avg(value) AS mean, var_pop(value) AS variance FROM fx_runs GROUP BY ALL)
"""


@query(
    f"{VSPLIT}, g AS (SELECT network, avg(mean) AS m, var_samp(mean) AS b, avg(variance) AS w, count(*) AS n, count(DISTINCT structure) AS k FROM c GROUP BY network) SELECT network, round(m, 4) AS mean_outcome, round(sqrt(b), 4) AS between_sd, round(sqrt(w), 4) AS within_sd, round(sqrt(b + w), 4) AS total_sd, round(sqrt(b) / m, 4) AS cv_between, round(sqrt(w) / m, 4) AS cv_within, round(100 * b / (b + w), 4) AS pct_structural, n AS n_networks, k AS n_structures FROM g"
)
def r19_variance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.runs(spark, sf_dir).groupBy("network", "threshold_idx", (F.col("run") % 10).alias("structure")).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    return rounded(outcomes.variance_split(c, ["network"], "mean", "variance", "structure"), 4)


@query(
    ", p AS (SELECT network, value AS y, (run % 50 + 1)::DOUBLE AS x FROM fx_runs), g AS (SELECT network, regr_count(y, x) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_slope(y, ln(x)) AS ls, regr_intercept(y, ln(x)) AS li, regr_r2(y, ln(x)) AS lr FROM p GROUP BY network) SELECT network, n::BIGINT AS n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(ls, 6) AS log_slope, round(li, 6) AS log_intercept, round(lr, 6) AS log_r2, round(sign(slope) * sqrt(r2 * (n - 2) / (1 - r2)), 6) AS t FROM g"
)
def r21_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.runs(spark, sf_dir).select("network", F.col("value").alias("y"), (F.col("run") % 50 + 1).cast("double").alias("x"))
    return rounded(outcomes.regression(p, ["network"], "y", "x"))


METRIC_ROWS = ", m AS (SELECT network, threshold_idx, avg(value) AS a, stddev_pop(value) AS b FROM fx_runs GROUP BY ALL), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM m), dist AS (SELECT network, threshold_idx, sqrt(pow((a - 20) / sa, 2) + pow((b - 30) / sb, 2)) AS distance FROM m, s)"


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.runs(spark, sf_dir).groupBy("network", "threshold_idx").agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("b"))
    return outcomes.distance_to(m, {"a": 20.0, "b": 30.0}).select("network", "threshold_idx", "distance")


@query(f"{METRIC_ROWS} SELECT network, threshold_idx, round(distance, 4) AS distance FROM dist")
def r22_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_distances(spark, sf_dir), 4)


@query(f"{METRIC_ROWS} SELECT network, threshold_idx, round(distance, 4) AS distance, row_number() OVER (PARTITION BY network ORDER BY distance, threshold_idx)::INT AS rank FROM dist QUALIFY row_number() OVER (PARTITION BY network ORDER BY distance, threshold_idx) <= 2")
def r23_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.top_k(_distances(spark, sf_dir), ["network"], ["distance", "threshold_idx"], 2), 4)


@query(" SELECT network, " + ", ".join(f"round(avg(value) FILTER (threshold_idx = {i}), 4) AS t{i}" for i in range(4)) + " FROM fx_runs GROUP BY network")
def r24_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.runs(spark, sf_dir).groupBy("network").pivot("threshold_idx", [0, 1, 2, 3]).agg(F.avg("value"))
    return rounded(p.select("network", *(F.col(str(i)).alias(f"t{i}") for i in range(4))), 4)


@query(
    ", r AS (SELECT run % 97 AS s, (run % 50)::DOUBLE AS x, value AS y FROM fx_runs), c AS (SELECT quantile_cont(s::DOUBLE, 1/3::DOUBLE) AS a, quantile_cont(s::DOUBLE, 2/3::DOUBLE) AS b FROM r) SELECT CASE WHEN s <= a THEN 1 WHEN s <= b THEN 2 ELSE 3 END AS tertile, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(corr(y, x), 6) AS corr FROM r, c GROUP BY 1"
)
def r25_tertile_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.runs(spark, sf_dir).select((F.col("run") % 97).alias("s"), (F.col("run") % 50).cast("double").alias("x"), F.col("value").alias("y"))
    return rounded(outcomes.tertile_slopes(r, "s", "x", "y"))


@query(
    ", e AS (SELECT min(value) AS lo, max(value) AS hi FROM fx_runs), b AS (SELECT least(greatest(ceil((value - lo) / ((hi - lo) / 8)), 1), 8)::INT AS bin, value FROM fx_runs, e) SELECT bin, count(*) AS n, round(var_samp(value), 4) AS variance FROM b GROUP BY bin"
)
def r26_equal_width_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = outcomes.equal_width_bins(fx.runs(spark, sf_dir), "value", 8)
    return rounded(b.groupBy("bin").agg(F.count("*").alias("n"), F.var_samp("value").alias("variance")), 4)


@query(
    ", r AS (SELECT network, value AS x, run % 100 AS y FROM fx_runs), k AS (SELECT network, rank() OVER (PARTITION BY network ORDER BY x) + (count(*) OVER (PARTITION BY network, x) - 1) / 2 AS a, rank() OVER (PARTITION BY network ORDER BY y) + (count(*) OVER (PARTITION BY network, y) - 1) / 2 AS b FROM r) SELECT network, round(corr(a, b), 6) AS spearman FROM k GROUP BY network"
)
def r27_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.runs(spark, sf_dir).select("network", F.col("value").alias("x"), (F.col("run") % 100).alias("y"))
    return rounded(outcomes.spearman(r, "x", "y", ["network"]))


@query(
    ", r AS (SELECT network, value AS x, (run % 100)::DOUBLE AS y, (run % 7)::DOUBLE AS z FROM fx_runs), c AS (SELECT network, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r GROUP BY network) SELECT network, round(xy, 6) AS pearson, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c"
)
def r27_partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.runs(spark, sf_dir).select("network", F.col("value").alias("x"), (F.col("run") % 100).cast("double").alias("y"), (F.col("run") % 7).cast("double").alias("z"))
    return rounded(outcomes.partial_correlation(r, "x", "y", "z", ["network"]))


RESAMPLES = 1000


@query(
    f", q AS MATERIALIZED (SELECT network, row_number() OVER (PARTITION BY network ORDER BY run) - 1 AS i, value FROM fx_runs), n AS (SELECT network, count(*) AS n FROM q GROUP BY network), d AS (SELECT network, n, b, unnest(range((n + 3) // 4)) AS k FROM (SELECT network, n, unnest(range(1, {RESAMPLES + 1})) AS b FROM n)),"
    " h AS (SELECT network, n, b, k, md5(concat_ws('|', '42', 'boot', network, b, k)) AS h FROM d), s AS (SELECT network, b, least(floor(('0x' || substr(h, 8 * j + 1, 8))::BIGINT / 4294967296.0::DOUBLE * n), n - 1)::BIGINT AS i FROM h, range(4) t(j) WHERE 4 * k + j < n),"
    " v AS (SELECT network, b, var_samp(value) AS v FROM s JOIN q USING (network, i) GROUP BY ALL) SELECT network, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high FROM v GROUP BY network"
)
def r18_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    r = fx.runs(spark, sf_dir).withColumn("i", (F.row_number().over(Window.partitionBy("network").orderBy("run")) - 1).cast("long"))
    return rounded(outcomes.bootstrap_variance(r.select("network", "i", "value"), ["network"], "i", "value", RESAMPLES), 4)


@query(" SELECT x::DOUBLE AS x, round(sum(exp(-0.5 * pow((x - value) / 5, 2))) / (count(*) * 5 * sqrt(2 * pi())), 8) AS density FROM fx_runs, range(0, 100, 10) t(x) GROUP BY x")
def r34_kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.range(0, 100, 10).select(F.col("id").cast("double").alias("x"))
    return rounded(outcomes.kernel_density(fx.runs(spark, sf_dir), "value", points, 5.0), 8)


@query(" SELECT network, threshold_idx, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max, round(median(value), 4) AS median, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.75), 4) AS q75, count(*) AS n FROM fx_runs GROUP BY ALL")
def r5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "value"
    q = lambda p: F.percentile(v, F.lit(p))
    g = fx.runs(spark, sf_dir).groupBy("network", "threshold_idx")
    return rounded(g.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.count("*").alias("n")), 4)


def simpson_sql(body: str, upto: str, steps: int = 4000) -> str:
    """A scalar: the integral of ``body`` (of x) from 0 to ``upto`` by Simpson's rule."""
    return f"(SELECT sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({body.replace('{x}', f'(i * ({upto}) / {steps})')})) * ({upto}) / {3 * steps} FROM range({steps + 1}) si(i))"


F_PDF = "CASE WHEN {x} > 0 THEN exp(lgamma((df1 + df2) / 2) - lgamma(df1 / 2) - lgamma(df2 / 2) + df1 / 2 * ln(df1 / df2) + (df1 / 2 - 1) * ln({x}) - (df1 + df2) / 2 * ln(1 + df1 / df2 * {x})) ELSE 0 END"
T_PDF = "exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) - (df + 1) / 2 * ln(1 + {x} * {x} / df))"
N_PDF = "exp(-0.5 * {x} * {x}) / sqrt(2 * pi())"


@query(
    ", g AS (SELECT network, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM fx_runs GROUP BY network), s AS (SELECT sum(n * pow(m - (SELECT avg(value) FROM fx_runs), 2)) AS b, sum(n * v) AS w, (count(*) - 1)::DOUBLE AS df1, (sum(n) - count(*))::DOUBLE AS df2 FROM g), a AS (SELECT b / df1 / (w / df2) AS f, df1, df2 FROM s)"
    f" SELECT round(f, 6) AS f, df1, df2, round(1 - {simpson_sql(F_PDF, 'least(f, 60)')}, 6) AS p FROM a"
)
def x8_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.anova(fx.runs(spark, sf_dir), "network", "value"))


@query(
    ", g AS (SELECT network, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM fx_runs GROUP BY network), p AS (SELECT x.network AS a, y.network AS b, x.n AS na, y.n AS nb, x.m - y.m AS d, sqrt((x.v + y.v) / 2) AS c, sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)) AS s FROM g x JOIN g y ON x.network < y.network),"
    f" q AS (SELECT a, b, d / s / sqrt(1 / na + 1 / nb) AS t, (na + nb - 2)::DOUBLE AS df, d / c AS cohen_d FROM p), z AS (SELECT *, 1 - 2 * {simpson_sql(T_PDF, 'least(abs(t), 40)')} AS p FROM q) SELECT a, b, round(t, 6) AS t, df, round(cohen_d, 6) AS cohen_d, round(p, 6) AS p, round(least(p * count(*) OVER (), 1), 6) AS p_bonferroni FROM z"
)
def x8_pairwise_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.pairwise_t(fx.runs(spark, sf_dir), "network", "value"))


@query(
    ", n AS (SELECT DISTINCT network FROM fx_runs), p AS (SELECT x.network AS a, y.network AS b FROM n x JOIN n y ON x.network < y.network), r AS (SELECT a, b, network, value, rank() OVER w + (count(*) OVER (PARTITION BY a, b, value) - 1) / 2 AS k FROM p JOIN fx_runs ON network IN (a, b) WINDOW w AS (PARTITION BY a, b ORDER BY value)),"
    " ti AS (SELECT a, b, sum(pow(t, 3) - t) AS ties FROM (SELECT a, b, count(*)::DOUBLE AS t FROM r GROUP BY a, b, value) GROUP BY a, b), s AS (SELECT a, b, sum(k) FILTER (network = a) - count(*) FILTER (network = a) * (count(*) FILTER (network = a) + 1) / 2 AS u, (count(*) FILTER (network = a))::DOUBLE AS n1, (count(*) FILTER (network = b))::DOUBLE AS n2 FROM r GROUP BY a, b),"
    " z AS (SELECT a, b, u, n1, n2, greatest((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z FROM s JOIN ti USING (a, b))"
    f" SELECT a, b, round(u, 4) AS u, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial, round(z, 6) AS z, round(1 - 2 * {simpson_sql(N_PDF, 'least(z, 12)')}, 6) AS p FROM z"
)
def x9_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = outcomes.mann_whitney(fx.runs(spark, sf_dir), "network", "value")
    return rounded(m.withColumn("u", F.round("u", 4)))


RANK_WAYS = """
    size AS (SELECT max(n1 + n2)::INT AS most FROM s WHERE least(n1, n2) <= 8),
    ways AS (SELECT 0 AS n, 0 AS m, 0 AS ranks, 1::DOUBLE AS c UNION ALL
      SELECT n, m, ranks, sum(c) AS c FROM (SELECT w.n + 1 AS n, w.m + t AS m, w.ranks + t * (w.n + 1) AS ranks, c FROM ways w, (VALUES (0), (1)) v(t) WHERE w.n < (SELECT most FROM size) AND w.m + t <= 8) GROUP BY n, m, ranks)"""


@query(
    ", r AS (SELECT s_nationkey AS g, s_acctbal AS v FROM supplier), n AS (SELECT DISTINCT g FROM r), p AS (SELECT x.g AS a, y.g AS b FROM n x JOIN n y ON x.g < y.g), k AS (SELECT a, b, g, v, rank() OVER w + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2 AS k FROM p JOIN r ON g IN (a, b) WINDOW w AS (PARTITION BY a, b ORDER BY v)),"
    " ti AS (SELECT a, b, sum(pow(t, 3) - t) AS ties FROM (SELECT a, b, count(*)::DOUBLE AS t FROM k GROUP BY a, b, v) GROUP BY a, b), s AS (SELECT a, b, sum(k) FILTER (g = a) - count(*) FILTER (g = a) * (count(*) FILTER (g = a) + 1) / 2 AS u, (count(*) FILTER (g = a))::DOUBLE AS n1, (count(*) FILTER (g = b))::DOUBLE AS n2 FROM k GROUP BY a, b),"
    " z AS (SELECT s.*, ties, greatest((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z FROM s JOIN ti USING (a, b)),"
    f"{RANK_WAYS}, law AS (SELECT n, m, ranks - m * (m + 1) / 2 AS u, sum(c) OVER (PARTITION BY n, m ORDER BY ranks) / sum(c) OVER (PARTITION BY n, m) AS upto FROM ways),"
    " e AS (SELECT a, b, upto FROM z JOIN law ON ties = 0 AND least(n1, n2) <= 8 AND law.n = n1 + n2 AND law.m = least(n1, n2) AND law.u = least(z.u, n1 * n2 - z.u))"
    f" SELECT a, b, round(u, 4) AS u, round(coalesce(least(2 * upto, 1), 1 - 2 * {simpson_sql(N_PDF, 'least(z, 12)', 400)}), 6) AS p FROM z LEFT JOIN e USING (a, b)"
)
def x9_exact_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small groups, whose U has an exact law: suppliers' balances by nation."""
    m = outcomes.mann_whitney(fx.table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal"), "s_nationkey", "s_acctbal")
    return rounded(m.select("a", "b", F.round("u", 4).alias("u"), "p"))


@query(
    ", r AS (SELECT network, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS k FROM fx_runs), g AS (SELECT network, sum(k) AS r, count(*) AS n FROM r GROUP BY network), t AS (SELECT sum(pow(t, 3) - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM fx_runs GROUP BY value)), s AS (SELECT sum(r * r / n) AS q, sum(n)::DOUBLE AS n, (count(*) - 1)::DOUBLE AS df FROM g),"
    " x AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h, df FROM s, t)"
    f" SELECT round(h, 4) AS h, df, round(1 - {simpson_sql('CASE WHEN {x} > 0 THEN exp((df / 2 - 1) * ln({x}) - {x} / 2 - df / 2 * ln(2) - lgamma(df / 2)) ELSE 0 END', 'least(h, 120)')}, 4) AS p FROM x"
)
def x10_kruskal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.kruskal(fx.runs(spark, sf_dir), "network", "value"), 4)


Z975 = 1.959963984540054


@query(
    f", g AS (SELECT network, threshold_idx, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS se, (count(*) - 1)::DOUBLE AS df, {Z975}::DOUBLE AS z FROM fx_runs GROUP BY network, threshold_idx)"
    " SELECT network, threshold_idx, round(mean, 4) AS mean, round(se * (z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * df * df) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(df, 3))), 4) AS half FROM g"
)
def x8_mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.mean_interval(fx.runs(spark, sf_dir), ["network", "threshold_idx"], "value"), 4)


CELLS = ", c AS (SELECT network, threshold_idx, run % 10 AS seed, avg(value) AS y FROM fx_runs GROUP BY ALL)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.runs(spark, sf_dir).groupBy("network", "threshold_idx", F.pmod("run", F.lit(10)).alias("seed")).agg(F.avg("value").alias("y"))


@query(f"{CELLS}, s AS (SELECT threshold_idx, seed, stddev_samp(y) AS std FROM c GROUP BY ALL) SELECT threshold_idx, seed, round(std, 4) AS std, row_number() OVER (ORDER BY std DESC NULLS LAST, threshold_idx, seed)::INT AS rank FROM s")
def x8_between_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.between_map(_cells(spark, sf_dir), ["threshold_idx", "seed"], "network", "y"), 4)


@query(f"{CELLS} SELECT a.network AS a, b.network AS b, round(corr(a.y, b.y), 6) AS correlation FROM c a JOIN c b USING (threshold_idx, seed) GROUP BY ALL")
def x8_profile_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.profile_correlations(_cells(spark, sf_dir), ["threshold_idx", "seed"], "network", "y"))


@query()
def x8_ward_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outcomes.ward_linkage(_cells(spark, sf_dir), ["threshold_idx", "seed"], "network", "y"))


# --- sensitivity ----------------------------------------------------------------

FD = """, c AS (SELECT network, list(x ORDER BY x) AS x, list(y ORDER BY x) AS y, count(*) AS n FROM (SELECT network, threshold_idx::DOUBLE AS x, avg(value) AS y FROM fx_runs GROUP BY ALL) GROUP BY network),
fd AS (SELECT network, x[i] AS x, y[i] AS y, (y[i + 1] - y[i - 1]) / (x[i + 1] - x[i - 1]) AS slope, (y[i + 1] - y[i]) / (x[i + 1] - x[i]) AS forward, x[n // 2 + 1] / y[n // 2 + 1] * (y[i + 1] - y[i - 1]) / (x[i + 1] - x[i - 1]) AS elasticity FROM (SELECT *, unnest(range(2, n)) AS i FROM c))"""


def _finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.runs(spark, sf_dir).groupBy("network", F.col("threshold_idx").cast("double").alias("x")).agg(F.avg("value").alias("y"))
    return sensitivity.finite_differences(c, ["network"], "x", "y")


@query(f"{FD} SELECT network, x, round(y, 4) AS y, round(slope, 4) AS slope, round(elasticity, 4) AS elasticity FROM fd")
def y2_finite_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_finite(spark, sf_dir), 4)


@query(f"{FD} SELECT network, x, round(y, 4) AS y, round(forward, 4) AS slope, round(elasticity, 4) AS elasticity FROM fd")
def y2_forward_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.runs(spark, sf_dir).groupBy("network", F.col("threshold_idx").cast("double").alias("x")).agg(F.avg("value").alias("y"))
    return rounded(sensitivity.finite_differences(c, ["network"], "x", "y", "forward"), 4)


BASE_POINT = {"pa": 0.5, "recip": 0.2}


@query(" SELECT sample_id, param, setting, CASE WHEN param = 'pa' THEN setting ELSE 0.5 END::DOUBLE AS pa, CASE WHEN param = 'recip' THEN setting ELSE 0.2 END::DOUBLE AS recip FROM (VALUES (0, 'pa', 0.0::DOUBLE), (1, 'pa', 0.45::DOUBLE), (2, 'pa', 0.9::DOUBLE), (3, 'recip', 0.0::DOUBLE), (4, 'recip', 1.0::DOUBLE)) t(sample_id, param, setting)")
def y1_one_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.one_at_a_time(spark, BASE_POINT, {"pa": [0.0, 0.45, 0.9], "recip": [0.0, 1.0]})


@query(f"{FD} SELECT network, round(avg(abs(elasticity)), 4) AS mean_sensitivity, round(max(abs(elasticity)), 4) AS max_sensitivity FROM fd GROUP BY network")
def y2_sensitivity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sensitivity.sensitivity_summary(_finite(spark, sf_dir), ["network"]), 4)


@query(
    " SELECT sample_id, "
    + ", ".join(f"round({lo} + (row_number() OVER (ORDER BY {uniform_sql(42, f'lhs/{p}', 'sample_id')}, sample_id) - 1 + {uniform_sql(42, f'within/{p}', 'sample_id')}) / 64 * {hi - lo}, 8)::DOUBLE AS {p}" for p, lo, hi in (("a", 0.0, 1.0), ("b", 2.0, 5.0)))
    + " FROM range(64) t(sample_id)"
)
def y3_latin_hypercube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sensitivity.latin_hypercube(spark.range(64).toDF("sample_id"), {"a": (0.0, 1.0), "b": (2.0, 5.0)}, 64), 8)


@query(
    ", s AS (SELECT value AS y, ntile(5) OVER (ORDER BY run % 50, value) AS slice FROM (SELECT DISTINCT run, value FROM fx_runs)), w AS (SELECT y, sum(count(*)) OVER (ORDER BY y) / sum(count(*)) OVER () AS cdf FROM s GROUP BY y), c AS (SELECT g.slice, w.y, w.cdf, coalesce(n, 0) AS n FROM w CROSS JOIN (SELECT DISTINCT slice FROM s) g LEFT JOIN (SELECT slice, y, count(*) AS n FROM s GROUP BY ALL) i ON i.slice = g.slice AND i.y = w.y), k AS (SELECT slice, max(abs(a / t - cdf)) AS ks FROM (SELECT slice, cdf, sum(n) OVER (PARTITION BY slice ORDER BY y) AS a, sum(n) OVER (PARTITION BY slice) AS t FROM c) GROUP BY slice) SELECT round(median(ks), 6) AS pawn_median, round(avg(ks), 6) AS pawn_mean, round(max(ks), 6) AS pawn_max FROM k"
)
def y4_pawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.runs(spark, sf_dir).select((F.col("run") % 50).alias("x"), F.col("value").alias("y"))
    return rounded(sensitivity.pawn(r, "x", "y", 5))


@query(" SELECT network, run, avg(round(value * 100)::BIGINT) OVER (PARTITION BY network ORDER BY run ROWS UNBOUNDED PRECEDING) AS running_mean FROM fx_runs")
def y5_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = fx.runs(spark, sf_dir).select("network", "run", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return sensitivity.running_mean(cents, ["network"], "run", "cents").select("network", "run", "running_mean")


# --- sweeps over several parameters and tables over several networks --------------

GRID = ", ".join(f"({i}, {t}::DOUBLE, {n})" for i, (t, n) in enumerate([(0.05, 20), (0.05, 80), (0.1, 20), (0.1, 80)]))


@query(
    f", cfg(config, threshold, initial) AS (VALUES {GRID}){seeds_sql('seeds', 'SELECT config, initial FROM cfg')}{spread_until('FROM seeds', SHARE)}"
    " SELECT config::BIGINT AS config, threshold, initial::DOUBLE AS initial, (SELECT count(*) FROM adopted x WHERE x.config = cfg.config) AS infected FROM cfg"
)
def x6_grid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = contagion.grid(spark, threshold=[0.05, 0.1], initial=[20, 80])
    seeds = contagion.seed_sized(configs.withColumn("initial", F.col("initial").cast("int")), fx.nodes(spark, sf_dir))
    adopted = contagion.threshold_contagion(fx.edges(spark, sf_dir), seeds, configs.select("config", "threshold"))
    return contagion.final_adoption(adopted, configs)


LAYER_SPREAD = spread_sql("SELECT network, src AS node_id FROM le UNION SELECT network, dst FROM le", "SELECT network, src, dst FROM le")


@query(
    f"{LAYERED}, d AS (SELECT network, x, count(*)::DOUBLE AS k FROM (SELECT network, src AS x FROM le UNION ALL SELECT network, dst FROM le) GROUP BY ALL), m AS (SELECT network, avg(k) AS m, var_pop(k) AS v FROM d GROUP BY network), s AS (SELECT network, count(*) AS n_nodes, avg(k) AS mean_degree, avg(pow(k - m, 3)) / pow(any_value(v), 1.5) AS skew FROM d JOIN m USING (network) GROUP BY network), r AS (SELECT a.network, count(*) AS n_edges, avg(CASE WHEN b.src IS NULL THEN 0.0 ELSE 1.0 END) AS r FROM le a LEFT JOIN le b ON b.network = a.network AND b.src = a.dst AND b.dst = a.src GROUP BY a.network),"
    " lu AS MATERIALIZED (SELECT DISTINCT network, least(src, dst) AS u, greatest(src, dst) AS v FROM le), lk AS (SELECT network, x, count(*) AS k FROM (SELECT network, u AS x FROM lu UNION ALL SELECT network, v FROM lu) GROUP BY ALL), tp AS (SELECT network, sum(k * (k - 1) // 2) AS triples FROM lk GROUP BY network), tr AS (SELECT a.network, count(*) AS n FROM lu a JOIN lu b ON b.network = a.network AND a.v = b.u JOIN lu c ON c.network = a.network AND c.u = a.u AND c.v = b.v GROUP BY a.network)"
    f"{LAYER_SPREAD}, le2 AS (SELECT lu.network, a.community AS cu, b.community AS cv FROM lu JOIN spread a ON a.network = lu.network AND u = a.node_id JOIN spread b ON b.network = lu.network AND v = b.node_id), ld AS (SELECT network, sum(d * d) AS dd FROM (SELECT network, c, count(*) AS d FROM (SELECT network, cu AS c FROM le2 UNION ALL SELECT network, cv FROM le2) GROUP BY ALL) GROUP BY network), lq AS (SELECT network, count(*) FILTER (cu = cv) / count(*) - any_value(dd) / (4.0 * count(*) * count(*)) AS q FROM le2 JOIN ld USING (network) GROUP BY network)"
    " SELECT network, n_nodes, round(mean_degree, 6) AS mean_degree, round(skew, 6) AS degree_skew, n_edges, round(r, 6) AS reciprocity, round(CASE WHEN triples > 0 THEN 3 * coalesce(tr.n, 0) / triples ELSE 0 END, 6) AS clustering, round(q, 6) AS modularity FROM s JOIN r USING (network) JOIN tp USING (network) LEFT JOIN tr USING (network) JOIN lq USING (network)"
)
def m13_network_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.network_table(layered(spark, sf_dir)))


@query()
def m6_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modularity.communities(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir), refine=False, tolerance=5e-3)


def _leiden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the order priorities' networks, and Leiden communities of all of them."""
    edges = stored(layered(spark, sf_dir), "edges")
    nodes = stored(edges.select("network", F.explode(F.array("src", "dst")).alias("node_id")).distinct(), "nodes")
    return nodes, edges, modularity.optimise(nodes, edges, tolerance=5e-3)


@query(f"""{LAYERED}, n AS (SELECT network, count(*) AS n_nodes FROM (SELECT network, src FROM le UNION SELECT network, dst FROM le) GROUP BY network),
    p AS (SELECT network, count(*) AS n_pairs FROM (SELECT DISTINCT network, least(src, dst), greatest(src, dst) FROM le) GROUP BY network)
    SELECT network, n_nodes, n_pairs, true AS connected, true AS named_by_member, true AS not_below_spread FROM n JOIN p USING (network)""")
def m13_leiden_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per network: whether communities are connected, have a member's name, and have no less modularity than spread labels."""
    nodes, edges, found = _leiden(spark, sf_dir)
    of = lambda end: F.struct("network", F.col(end).alias("id")).alias(end)
    keyed = edges.select(of("src"), of("dst"))
    spread = metrics.label_propagation(nodes.select(of("node_id")), keyed).select("node_id.network", F.col("node_id.id").alias("node_id"), "community")
    side = lambda end: found.select("network", F.col("node_id").alias(end), F.col("community").alias(f"c{end}"))
    inner = edges.join(side("src"), ["network", "src"]).join(side("dst"), ["network", "dst"]).where("csrc = cdst")
    parts = metrics.components(found.select(of("node_id")), inner.select(of("src"), of("dst")))
    parts = parts.groupBy(F.col("component.network").alias("network")).agg(F.countDistinct("component").alias("n_parts"))
    own = found.groupBy("network").agg(F.count("*").alias("n_nodes"), F.countDistinct("community").alias("n"), F.count_if(F.col("community") == F.col("node_id")).alias("named"))
    q = modularity.partition_quality(edges, found).join(modularity.partition_quality(edges, spread).select("network", F.col("modularity").alias("spread")), "network")
    joined = own.join(parts, "network").join(q.select("network", "n_pairs", "modularity", "spread"), "network")
    checks = {"connected": F.col("n_parts") == F.col("n"), "named_by_member": F.col("named") == F.col("n"), "not_below_spread": F.col("modularity") >= F.col("spread") - 1e-9}
    return joined.select("network", "n_nodes", "n_pairs", *(c.alias(name) for name, c in checks.items()))


@query(" SELECT network, run, value, max(value) OVER (PARTITION BY network) AS network_size FROM fx_runs")
def r17_network_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.runs(spark, sf_dir).select("network", "run", "value")
    return r.join(r.groupBy("network").agg(F.max("value").alias("network_size")), "network")


@query(f"{LAYERED}, a AS (SELECT src, dst FROM le WHERE network = '1-URGENT'), b AS (SELECT src, dst FROM le WHERE network = '2-HIGH') SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def r33_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = layered(spark, sf_dir)
    a, b = (e.where(F.col("network") == p).select("src", "dst") for p in ("1-URGENT", "2-HIGH"))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(a.intersect(b), "both").union(count(a.subtract(b), "first only")).union(count(a.union(b).distinct(), "either"))


@query(" SELECT count(*) AS n_runs, count(DISTINCT network) AS n_networks FROM fx_runs")
def r36_global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.runs(spark, sf_dir).agg(F.count("*").alias("n_runs"), F.countDistinct("network").alias("n_networks"))


@query(", c AS (SELECT network, run % 10 AS structure, avg(value) AS m, var_pop(value) AS v FROM fx_runs GROUP BY ALL) SELECT structure, round(avg(m), 4) AS mean, round(var_samp(m), 4) AS between_networks, round(avg(v), 4) AS within FROM c GROUP BY structure")
def r20_variance_by_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.runs(spark, sf_dir).groupBy("network", (F.col("run") % 10).alias("structure")).agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return rounded(c.groupBy("structure").agg(F.avg("m").alias("mean"), F.var_samp("m").alias("between_networks"), F.avg("v").alias("within")), 4)


@query(
    ", b AS (SELECT network, least(floor(value / 25), 12)::INT AS bin FROM fx_runs) SELECT network, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY network), 6) AS share FROM b GROUP BY network, bin"
)
def r35_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    b = fx.runs(spark, sf_dir).select("network", F.least(F.floor(F.col("value") / 25), F.lit(12)).cast("int").alias("bin"))
    n = b.groupBy("network", "bin").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("network"))))


# --- joins of results with tables about their networks -------------------------

MAPPING = f"{SETS}, mapping AS (SELECT combo AS aggregation, sum(n * n) / (sum(n) * sum(n)) AS hhi, count(*) AS n_groups, sum(n) * sum(n) / sum(n * n) AS effective_n FROM sets GROUP BY combo)"


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = composition.concentration(composition.aggregate_combinations(fx.pop(spark, sf_dir), ["seg", "reg"]))
    return c.select(F.col("combo").alias("aggregation"), "hhi", "n_groups", "effective_n")


FILES = [("seg_stats", 0.4), ("reg_stats", 0.3), ("seg_reg_stats", 0.2), ("seg_stats_old", 0.1), ("lft_stats", 0.5)]
FILES_SQL = ", files(filename, transitivity) AS (VALUES " + ", ".join(f"('{f}', {v}::DOUBLE)" for f, v in FILES) + ")"


@query(f"{MAPPING}{FILES_SQL} SELECT filename, transitivity, regexp_replace(filename, '_stats$', '') AS aggregation_key, round(hhi, 6) AS hhi, n_groups, round(effective_n, 6) AS effective_n, printf('HHI=%.4f', hhi) AS hhi_label FROM files JOIN mapping ON aggregation = regexp_replace(filename, '_stats$', '')")
def j2_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.attach_concentration(spark.createDataFrame(FILES, "filename string, transitivity double"), _mapping(spark, sf_dir)))


NETWORKS = ["seg", "reg", "seg_reg", "lft", "lft_seg"]
NETS = ", nets AS (SELECT unnest(['seg', 'reg', 'seg_reg', 'lft', 'lft_seg']) AS network, unnest(range(5)) AS i)"
#: Event types stand for networks: the i-th of them in alphabetical order for the i-th name.
NAMED = f"{DECOMPOSE}, ranked AS (SELECT network AS e, row_number() OVER (ORDER BY network) - 1 AS i FROM (SELECT DISTINCT network FROM fx_runs)), dec AS (SELECT nets.network, g.threshold_idx AS threshold_value, g.mean_ignited, g.p_ignite FROM g JOIN ranked ON g.network = e JOIN nets USING (i))"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = _decomposed(spark, sf_dir)
    names = d.select("network").distinct().withColumn("i", F.row_number().over(Window.orderBy("network")) - 1)
    name = F.get(F.array(*map(F.lit, NETWORKS)), F.col("i"))
    return d.join(names, "network").where(F.col("i") < len(NETWORKS)).select(name.alias("network"), F.col("threshold_idx").alias("threshold_value"), "mean_ignited", "p_ignite")


HOMOPHILY_OF = "parts(partition) AS (VALUES ('seg'), ('reg'), ('seg_reg')), pq AS (SELECT partition, unnest(string_split(partition, '_')) AS dim FROM parts), hom AS (SELECT partition, avg(excess) AS mean FROM pq JOIN inb USING (dim) GROUP BY partition)"


@query(f"{NETS}{NAMED}{INBREEDING.replace(', l AS', ', l AS', 1)}, {HOMOPHILY_OF} SELECT network, threshold_value, round(mean_ignited, 4) AS mean_ignited, round(p_ignite, 4) AS p_ignite, round(mean, 4) AS mean FROM dec LEFT JOIN hom ON partition = network")
def j3_homophily(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = composition.partition_summary(_partitions(spark), composition.inbreeding(fx.links(spark, sf_dir), ["seg", "reg"]))
    return rounded(analysis.attach(_named(spark, sf_dir), h, "network", "partition", ["mean"]), 4)


@query(f"{NETS}{NAMED}{MAPPING}, blocks AS (SELECT p.partition, n_groups AS n_blocks FROM (VALUES ('seg'), ('reg'), ('seg_reg'), ('x')) p(partition) LEFT JOIN mapping ON aggregation = p.partition) SELECT network, threshold_value, round(mean_ignited, 4) AS mean_ignited, round(p_ignite, 4) AS p_ignite, n_blocks FROM dec LEFT JOIN blocks ON partition = network")
def j4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.createDataFrame([("seg",), ("reg",), ("seg_reg",), ("x",)], "partition string")
    blocks = analysis.attach(parts, _mapping(spark, sf_dir), "partition", "aggregation", [F.col("n_groups").alias("n_blocks")])
    return rounded(analysis.attach(_named(spark, sf_dir), blocks, "network", "partition", ["n_blocks"]), 4)


@query(f"{NETS}{NAMED}{MAPPING} SELECT network, threshold_value, round(mean_ignited, 4) AS mean_ignited, round(p_ignite, 4) AS p_ignite, round(hhi, 4) AS hhi FROM dec LEFT JOIN mapping ON aggregation = network")
def j5_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.attach(_named(spark, sf_dir), _mapping(spark, sf_dir), "network", "aggregation", ["hhi"]), 4)


@query(f"{NETS}{NAMED}{MAPPING} SELECT network, threshold_value, round(mean_ignited, 4) AS mean_ignited, round(p_ignite, 4) AS p_ignite, round(effective_n, 4) AS effective_n FROM dec LEFT JOIN mapping ON aggregation = network")
def j6_sweep_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.attach(_named(spark, sf_dir), _mapping(spark, sf_dir), "network", "aggregation", ["effective_n"]), 4)


@query(f"{NETS}{NAMED}{MAPPING} SELECT network, threshold_value, round(mean_ignited, 4) AS mean_ignited, round(p_ignite, 4) AS p_ignite, round(hhi, 4) AS hhi, n_groups FROM dec JOIN mapping ON aggregation = network")
def j7_inner_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.attach(_named(spark, sf_dir), _mapping(spark, sf_dir), "network", "aggregation", ["hhi", "n_groups"], "inner"), 4)


@query(
    f"{NETS}{NAMED}{INBREEDING}, drops(fine, coarse, dropped) AS (VALUES ('seg_reg', 'reg', 'seg'), ('seg_reg', 'seg', 'reg'), ('lft_seg', 'seg', 'lft'), ('lft_seg', 'lft', 'seg'))"
    " SELECT fine, coarse, dropped AS dropped_dim, round(excess, 4) AS homophily_dropped, f.threshold_value AS threshold, round(f.mean_ignited, 4) AS fine_size, round(c.mean_ignited, 4) AS coarse_size, round(f.p_ignite, 4) AS fine_pig, round(c.p_ignite, 4) AS coarse_pig,"
    " round(log10(greatest(f.mean_ignited, 1)) - log10(greatest(c.mean_ignited, 1)), 4) AS delta_log_size, round(f.p_ignite - c.p_ignite, 4) AS delta_pig FROM drops JOIN dec f ON f.network = fine JOIN dec c ON c.network = coarse AND c.threshold_value = f.threshold_value LEFT JOIN inb ON dim = dropped"
)
def j10_pair_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs_ = composition.coarsening_pairs(spark.createDataFrame([(p,) for p in NETWORKS], "partition string"))
    h = composition.inbreeding(fx.links(spark, sf_dir), ["seg", "reg"])
    return rounded(analysis.pair_drops(pairs_, _named(spark, sf_dir), h), 4)


@query(" SELECT seg, count(*) AS n, round(avg(x), 6) AS mean FROM (SELECT CASE WHEN node_id % 7 <> 0 THEN seg END AS seg, CASE WHEN node_id % 5 <> 0 THEN node_id::DOUBLE END AS x FROM fx_nodes) WHERE seg IS NOT NULL AND x IS NOT NULL GROUP BY seg")
def r2_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.nodes(spark, sf_dir).select(F.when(F.col("node_id") % 7 != 0, F.col("seg")).alias("seg"), F.when(F.col("node_id") % 5 != 0, F.col("node_id").cast("double")).alias("x"))
    return rounded(analysis.group_means(n, ["seg"], "x"))
