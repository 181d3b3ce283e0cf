"""Driver queries of generation: communities, edges, models, enrichment, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.functions.rng import uniform, uniform_sql
from popweave.operators import communities as com
from popweave.operators import edges as ed
from popweave.operators import enrich, expand, metrics, models
from popweave.operators.sampling import drawn
from popweave.plans import api
from popweave.plans import fixtures as fx
from popweave.plans.catalog import DEGREES, SCALE, TARGETS, _bfs_sql, layered, pairs, query, rounded
from popweave.sources import sinks, tables
from popweave.sources.scratch import claim, stored
from popweave.streaming import resume

K = 7
DEAL = uniform_sql(42, "deal", "node_id")
ASSIGN = f""", place AS (SELECT node_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {DEAL}, node_id) - 1 AS place FROM fx_gnodes),
turns AS (SELECT group_id, community, row_number() OVER (PARTITION BY group_id ORDER BY {uniform_sql(42, "turns", "group_id", "community")}, community) - 1 AS turn FROM (SELECT group_id FROM fx_groups), range({K}) t(community)),
assignment AS (SELECT node_id, p.group_id, community::INT AS community FROM place p JOIN turns t ON p.group_id = t.group_id AND p.place % {K} = t.turn),
comp AS (SELECT community, group_id, count(*) AS n FROM assignment GROUP BY ALL)
"""


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return com.assign_natural(fx.grouped_nodes(spark, sf_dir), K)


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from popweave.operators import targets

    return targets.link_targets(pairs(spark, sf_dir), 0.29).select("src_group", "dst_group", "target")


@query(" SELECT i::INT AS community, 1.0 / (i + 1) AS weight FROM range(7) t(i)")
def c2_powerlaw_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = com.community_sizes(spark, K, "powerlaw", 1500)
    assert sizes is not None
    return sizes


@query(f"{ASSIGN} SELECT node_id, group_id, community FROM assignment")
def c6_assign_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment(spark, sf_dir)


@query(
    f""", place AS (SELECT node_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {DEAL}, node_id) - 1 AS place FROM fx_gnodes),
    w AS (SELECT i AS community, 1.0::DOUBLE / (i + 1) AS weight FROM range({K}) t(i)), s AS (SELECT community, sum(weight) OVER (ORDER BY community ROWS UNBOUNDED PRECEDING) / sum(weight) OVER () AS upto FROM w),
    h AS (SELECT group_id, community, CASE WHEN community = {K - 1} THEN n ELSE round(n * upto)::BIGINT END AS high FROM fx_groups, s),
    c AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY group_id ORDER BY community), 0) AS low FROM h)
    SELECT node_id, p.group_id, community::INT AS community FROM place p JOIN c ON p.group_id = c.group_id AND place >= low AND place < high"""
)
def c6_assign_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = com.community_sizes(spark, K, "powerlaw", 1500)
    assert sizes is not None
    return com.assign_weighted(fx.grouped_nodes(spark, sf_dir), sizes)


@query(f" SELECT i::INT AS community, {uniform_sql(42, 'theta', 'i')} AS theta FROM range({K}) t(i)")
def c10_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return com.coordinates(assignment(spark, sf_dir))


@query(f" SELECT i::INT AS community, (row_number() OVER (ORDER BY {uniform_sql(42, 'theta', 'i')}, i) - 1) / {K} AS theta FROM range({K}) t(i)")
def c10_spread_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return com.coordinates(assignment(spark, sf_dir), spread=True)


@query(f"{ASSIGN}{TARGETS} SELECT src_group, dst_group, a.community FROM targets t JOIN comp a ON a.group_id = src_group JOIN comp b ON b.group_id = dst_group AND a.community = b.community WHERE target > 0")
def c11_pair_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return com.pair_communities(com.composition(assignment(spark, sf_dir)), link_targets(spark, sf_dir))


@query(f"{ASSIGN} SELECT a.group_id AS src_group, b.group_id AS dst_group, sum(a.n * b.n - CASE WHEN a.group_id = b.group_id THEN a.n ELSE 0 END)::BIGINT AS possible FROM comp a JOIN comp b USING (community) GROUP BY ALL")
def c13_possible_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return com.possible_interactions(com.composition(assignment(spark, sf_dir)))


@query(
    f"{ASSIGN}{TARGETS}, poss AS (SELECT a.group_id AS src_group, b.group_id AS dst_group, sum(a.n * b.n - CASE WHEN a.group_id = b.group_id THEN a.n ELSE 0 END) AS possible FROM comp a JOIN comp b USING (community) GROUP BY ALL)"
    " SELECT round(avg(abs(coalesce(possible, 0) - target) / target), 6) AS mre FROM targets LEFT JOIN poss USING (src_group, dst_group) WHERE target > 0"
)
def c13_relative_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(com.mean_relative_error(com.possible_interactions(com.composition(assignment(spark, sf_dir))), link_targets(spark, sf_dir)))


@query(
    f"{ASSIGN}, p AS (SELECT community, n, n / sum(n) OVER (PARTITION BY community) AS p FROM comp) SELECT community, sum(n)::BIGINT AS size, count(*) AS n_groups, round(-sum(p * ln(p)), 6) AS shannon, round(1 - sum(p * p), 6) AS simpson, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS pielou FROM p GROUP BY community"
)
def c14_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(com.diversity(com.composition(assignment(spark, sf_dir))))


@query(
    f"{ASSIGN}, s AS (SELECT i, coalesce(sum(n), 0) AS n FROM range({K + 2}) t(i) LEFT JOIN comp ON community = i GROUP BY i) SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n)::BIGINT AS min, max(n)::BIGINT AS max, median(n)::DOUBLE AS median, count(*) FILTER (n = 0) AS empty, round(stddev_pop(n) / avg(n), 6) AS cv FROM s"
)
def c14_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(com.size_report(com.composition(assignment(spark, sf_dir)), K + 2))


@query(
    f"{TARGETS}, g AS (SELECT group_id, 'seg' AS c, seg AS v, n FROM fx_groups UNION ALL SELECT group_id, 'reg', reg, n FROM fx_groups), l AS (SELECT a.c, a.v, sum(target) FILTER (a.v = b.v) AS intra, sum(target) AS total FROM targets t JOIN g a ON a.group_id = src_group JOIN g b ON b.group_id = dst_group AND b.c = a.c GROUP BY ALL), p AS (SELECT c, v, sum(n) / (SELECT sum(n) FROM fx_groups) AS share FROM g GROUP BY ALL)"
    " SELECT c AS characteristic, round(avg(CASE WHEN total > 0 THEN intra / total - share ELSE 0 END), 6) AS isolation FROM p LEFT JOIN l USING (c, v) GROUP BY c"
)
def c9_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(com.isolation(fx.groups(spark, sf_dir), link_targets(spark, sf_dir), ["seg", "reg"]))


ISOLATION = f"{TARGETS}, g AS (SELECT group_id, 'seg' AS c, seg AS v, n FROM fx_groups UNION ALL SELECT group_id, 'reg', reg, n FROM fx_groups), l AS (SELECT a.c, a.v, sum(target) FILTER (a.v = b.v) AS intra, sum(target) AS total FROM targets t JOIN g a ON a.group_id = src_group JOIN g b ON b.group_id = dst_group AND b.c = a.c GROUP BY ALL), p AS (SELECT c, v, sum(n) / (SELECT sum(n) FROM fx_groups) AS share FROM g GROUP BY ALL), iso AS (SELECT c, avg(CASE WHEN total > 0 THEN intra / total - share ELSE 0 END) AS isolation FROM p LEFT JOIN l USING (c, v) GROUP BY c)"


@query(
    f"{ISOLATION}, lab AS (SELECT group_id, n, CASE WHEN (SELECT c FROM iso ORDER BY isolation DESC, c LIMIT 1) = 'seg' THEN seg || '|' || reg ELSE reg || '|' || seg END AS block FROM fx_groups), bl AS (SELECT block, sum(n) AS n FROM lab GROUP BY block),"
    f" ex AS (SELECT block, n / sum(n) OVER () * {K} AS exact FROM bl), un AS (SELECT block, exact, greatest(floor(exact), 1)::BIGINT AS k FROM ex), un2 AS (SELECT block, k + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, block) <= {K} - sum(k) OVER () THEN 1 ELSE 0 END AS units FROM un),"
    f" pl AS (SELECT block, units, coalesce(sum(units) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM un2), place AS (SELECT node_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {DEAL}, node_id) - 1 AS place FROM fx_gnodes),"
    " st AS (SELECT group_id, coalesce(sum(n) OVER (PARTITION BY block ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lab)"
    f" SELECT node_id, group_id, ((first + (place + start) % units) % {K})::INT AS community FROM place JOIN lab USING (group_id) JOIN st USING (group_id) JOIN pl USING (block)"
)
def c9_assign_segregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return com.assign_segregated(fx.grouped_nodes(spark, sf_dir), fx.groups(spark, sf_dir), link_targets(spark, sf_dir), ["seg", "reg"], K, threshold=-1.0)


def _separated_sql(k: int) -> str:
    parts = [f"{TARGETS}, sym AS (SELECT src_group AS a, dst_group AS b, target AS t FROM targets UNION ALL SELECT dst_group, src_group, target FROM targets), tot AS (SELECT a AS g, sum(t) AS t FROM sym GROUP BY a), s0 AS (SELECT 0 AS position, (SELECT g FROM tot ORDER BY t, g LIMIT 1) AS group_id)"]
    for i in range(1, k):
        parts.append(f", s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT {i}, (SELECT g FROM (SELECT tot.g, coalesce(sum(sym.t) FILTER (sym.b IN (SELECT group_id FROM s{i - 1})), 0) AS near FROM tot JOIN sym ON sym.a = tot.g GROUP BY tot.g) WHERE g NOT IN (SELECT group_id FROM s{i - 1}) ORDER BY near, g LIMIT 1))")
    return "".join(parts) + f" SELECT position::INT AS position, group_id::INT AS group_id FROM s{k - 1}"


@query(_separated_sql(K))
def c4_separated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = com.separated_groups(link_targets(spark, sf_dir), K)
    return spark.createDataFrame(list(enumerate(chosen)), "position int, group_id int")


@query()
def c7_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return com.refine(assignment(spark, sf_dir), link_targets(spark, sf_dir))


@query(
    f"{ASSIGN}, s AS (SELECT community, count(*) AS n FROM assignment GROUP BY 1), r AS (SELECT community, row_number() OVER (ORDER BY n DESC, community) - 1 AS t FROM s) SELECT node_id, group_id, (CASE WHEN (t // 3) % 2 = 0 THEN t % 3 ELSE 2 - t % 3 END)::INT AS community FROM assignment JOIN r USING (community)"
)
def c8_merge_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return com.merge_communities(assignment(spark, sf_dir), 3)


@query()
def c12_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by household and group, from the sampler on all groups and targets."""
    return com.composition(com.assign_households(fx.grouped_nodes(spark, sf_dir), link_targets(spark, sf_dir)))


HOMES = f""", ks AS (SELECT greatest(count(*) // 4, 1)::INT AS k FROM fx_nodes), place AS (SELECT node_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {DEAL}, node_id) - 1 AS place FROM fx_gnodes),
turns AS (SELECT group_id, community, row_number() OVER (PARTITION BY group_id ORDER BY {uniform_sql(42, "turns", "group_id", "community")}, community) - 1 AS turn FROM (SELECT group_id, unnest(range((SELECT k FROM ks))) AS community FROM fx_groups)),
home AS (SELECT node_id, community FROM place p JOIN turns t ON p.group_id = t.group_id AND p.place % (SELECT k FROM ks) = t.turn)"""


@query(f"{HOMES} SELECT a.node_id AS src, b.node_id AS dst FROM home a JOIN home b USING (community) WHERE a.node_id <> b.node_id")
def e8_complete_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All people, in communities of household size, so that pairs grow with the people."""
    n = fx.grouped_nodes(spark, sf_dir)
    return ed.complete_communities(com.assign_natural(n, max(n.count() // 4, 1)))


TURNS = f""", sh AS (SELECT src_group, dst_group, target, a.community, a.n AS ks, b.n AS kd, count(*) OVER (PARTITION BY src_group, dst_group) AS shared,
  row_number() OVER (PARTITION BY src_group, dst_group ORDER BY {uniform_sql(42, "turn", "src_group", "dst_group", "a.community")}, a.community) - 1 AS place
  FROM targets JOIN comp a ON a.group_id = src_group JOIN comp b ON b.group_id = dst_group AND a.community = b.community WHERE target > 0)"""


@query(
    f"{ASSIGN}{TARGETS}{TURNS}, o AS (SELECT a.group_id AS src_group, b.group_id AS dst_group, a.community, count(*) AS offered FROM fx_edges JOIN assignment a ON a.node_id = src JOIN assignment b ON b.node_id = dst AND a.community = b.community GROUP BY ALL),"
    " f AS (SELECT sh.*, offered, row_number() OVER (PARTITION BY src_group, dst_group ORDER BY place) AS i FROM sh JOIN o USING (src_group, dst_group, community)),"
    " led AS (SELECT src_group, dst_group, place, i, target - least((target + shared - 1) // shared, offered) AS remaining, (target + shared - 1) // shared AS quota FROM f WHERE i = 1"
    " UNION ALL SELECT f.src_group, f.dst_group, f.place, f.i, remaining - least(greatest((remaining + shared - 1) // shared, 1), remaining, offered), least(greatest((remaining + shared - 1) // shared, 1), remaining) FROM led JOIN f ON f.src_group = led.src_group AND f.dst_group = led.dst_group AND f.i = led.i + 1)"
    " SELECT src_group, dst_group, place::BIGINT AS place, quota::BIGINT AS quota FROM led"
)
def e1_quota_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass's quotas where each community offers the given edges that lie in it."""
    a = assignment(spark, sf_dir)
    w = ed.world(a, link_targets(spark, sf_dir))
    side = lambda end: a.select(F.col("node_id").alias(end), F.col("group_id").alias(f"{end}_group"), "community")
    inside = fx.edges(spark, sf_dir).join(side("src"), "src").join(side("dst"), ["dst", "community"])
    offered = inside.groupBy("src_group", "dst_group", "community").agg(F.count("*").alias("offered"))
    need = w.targets.select("src_group", "dst_group", F.col("target").alias("need"))
    offers = w.shared.join(offered, ["src_group", "dst_group", "community"]).join(need, ["src_group", "dst_group"])
    return ed.quota_ledger(offers.withColumnRenamed("turn", "place"))


@query(
    f"{ASSIGN}{TARGETS}{TURNS}, r AS (SELECT *, sum(ks * kd) OVER w AS high, sum(ks * kd) OVER (PARTITION BY src_group, dst_group) AS total FROM sh WINDOW w AS (PARTITION BY src_group, dst_group ORDER BY community ROWS UNBOUNDED PRECEDING)),"
    f" d AS (SELECT src_group, dst_group, unnest(range(1, target + 1)) AS j FROM targets WHERE target > 0), x AS (SELECT *, {uniform_sql(42, 'shared', 'src_group', 'dst_group', 'j')} AS x FROM d)"
    " SELECT src_group, dst_group, j::BIGINT AS j, community FROM x JOIN r USING (src_group, dst_group) WHERE floor(x * total) >= high - ks * kd AND floor(x * total) < high"
)
def e9_shared_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A community for each edge that a pair of groups needs, by the pairs of people in those that it shares."""
    w = ed.world(assignment(spark, sf_dir), link_targets(spark, sf_dir))
    need = w.targets.where("target > 0").select("src_group", "dst_group", F.explode(F.sequence(F.lit(1).cast("long"), "target")).alias("j"))
    u = uniform(42, "shared", "src_group", "dst_group", "j")
    return drawn(need, ed.shared_weights(w), ["src_group", "dst_group"], u).select("src_group", "dst_group", "j", "community")


@query()
def e10_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = api.generate(fx.pop(spark, sf_dir), fx.links(spark, sf_dir), scale=0.3, number_of_communities=5, preferential_attachment=0.5, reciprocity=0.3, transitivity=0.2, bridge_probability=0.1)
    return n.edges


@query(f"{TARGETS} SELECT src_group, dst_group, target, 0::BIGINT AS n_loops, 0::BIGINT AS n_repeats, 0::BIGINT AS n_over FROM targets WHERE target > 0")
def e10_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every pair of groups with edges or a target: its target, loops, repeated edges, and edges beyond the target."""
    made = api.generate(fx.pop(spark, sf_dir), fx.links(spark, sf_dir), scale=SCALE, number_of_communities=5, preferential_attachment=0.5, reciprocity=0.3, transitivity=0.2, bridge_probability=0.1)
    side = lambda end: made.nodes.select(F.col("node_id").alias(end), F.col("group_id").alias(f"{end}_group"))
    e = made.edges.select("src", "dst").join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    distinct = e.groupBy("src_group", "dst_group", "src", "dst").agg(F.count("*").alias("n"))
    have = distinct.groupBy("src_group", "dst_group").agg(F.sum("n").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.sum(F.col("n") - 1).alias("repeats"))
    both = made.targets.where("target > 0").select("src_group", "dst_group", "target").join(have, ["src_group", "dst_group"], "full_outer")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    over = F.greatest(count(F.col("n")) - count(F.col("target")), F.lit(0))
    return both.select("src_group", "dst_group", count(F.col("target")).alias("target"), count(F.col("loops")).alias("n_loops"), count(F.col("repeats")).alias("n_repeats"), over.alias("n_over"))


@query()
def e10_generate_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity beyond one's own community."""
    n = api.generate(fx.pop(spark, sf_dir), fx.links(spark, sf_dir), scale=0.2, number_of_communities=5, preferential_attachment=0.5, pa_scope="global")
    return n.edges


@query()
def e11_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.diagnostics(api.generate(fx.pop(spark, sf_dir), fx.links(spark, sf_dir), scale=0.2, number_of_communities=3, reciprocity=0.3).edges)


@query()
def e14_multiplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = fx.links(spark, sf_dir)
    layers = api.generate_multiplex(fx.pop(spark, sf_dir), {"home": links, "family": links, "near": links}, households=60, larger=4, scale=0.1)
    return api.multiplex_overlap(layers)


LAYERS = ", le AS (SELECT DISTINCT src, dst, o_orderpriority AS layer FROM (SELECT a.o_custkey AS src, b.o_custkey AS dst, a.o_orderpriority FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1) WHERE src <> dst)"


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    first = o.select(F.col("o_custkey").alias("src"), "o_orderpriority", (F.col("o_orderkey") + 1).alias("k"))
    e = first.join(o.select(F.col("o_custkey").alias("dst"), F.col("o_orderkey").alias("k")), "k").where("src <> dst").select("src", "dst", "o_orderpriority").distinct()
    return {p: e.where(F.col("o_orderpriority") == p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}


@query(f"{LAYERS} SELECT src, dst, array_to_string(list(layer ORDER BY layer), ',') AS layers FROM le GROUP BY src, dst")
def e15_combined_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.combine_layers(_layers(spark, sf_dir)).withColumn("layers", F.array_join("layers", ","))


@query(f"{LAYERS} SELECT x.layer AS a, y.layer AS b, count(*) AS n_common FROM le x JOIN le y USING (src, dst) WHERE x.layer < y.layer GROUP BY ALL")
def e15_layer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.layer_overlap(ed.combine_layers(_layers(spark, sf_dir)))


SAMPLE = uniform_sql(42, "sample", "src", "dst")


@query(f" SELECT src, dst FROM fx_edges ORDER BY {SAMPLE}, src, dst LIMIT (SELECT trunc(0.3::DOUBLE * count(*))::BIGINT FROM fx_edges)")
def e14_edge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.sample_edges(fx.edges(spark, sf_dir), 0.3)


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = fx.grouped_nodes(spark, sf_dir).select("node_id", F.pmod("group_id", F.lit(3)).alias("block"))
    p = spark.createDataFrame([(i, j, 0.02 if i == j else 0.004) for i in range(3) for j in range(i, 3)], "i int, j int, p double")
    return n, p


@query(
    ", b AS (SELECT group_id % 3 AS b, count(*) AS n FROM fx_gnodes GROUP BY 1), p AS (SELECT x.b AS i, y.b AS j, CASE WHEN x.b = y.b THEN x.n * (x.n - 1) / 2 * 0.02 ELSE x.n * y.n * 0.004 END AS e FROM b x JOIN b y ON x.b <= y.b), t AS (SELECT sum(n)::BIGINT AS n FROM b) SELECT round(sum(e), 6) AS expected_edges, any_value(n) AS n_nodes, round(sum(e) / (any_value(n) * (any_value(n) - 1) / 2), 6) AS density FROM p, t"
)
def g4_expected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = _blocks(spark, sf_dir)
    return rounded(models.expected_edges(n.groupBy("block").agg(F.count("*").alias("n")), p))


def _sbm_sql(nodes: str, probabilities: str) -> str:
    """Pairs (u, v) of a block model, as CTE sbm."""
    return f""", bm AS MATERIALIZED (SELECT node_id, block, row_number() OVER (PARTITION BY block ORDER BY {uniform_sql(42, "member", "node_id")}, node_id) - 1 AS idx FROM ({nodes})),
bs AS (SELECT block, count(*) AS n FROM bm GROUP BY block),
sl AS (SELECT i, j, p, CASE WHEN i = j THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS slots, b.n AS nj FROM ({probabilities}) JOIN bs a ON a.block = i JOIN bs b ON b.block = j WHERE p > 0),
st AS (SELECT *, greatest(ceil(10000.0::DOUBLE / p), 1)::BIGINT AS strip FROM sl WHERE slots > 0),
fr AS (SELECT i, j, p, slots, nj, strip, unnest(range(0, slots, strip)) AS frm FROM st),
sz AS (SELECT *, least(strip, slots - frm) AS size FROM fr),
ks AS (SELECT *, unnest(range(1, ceil(size * p + 8 * sqrt(size * p + 4))::BIGINT + 1)) AS k FROM sz),
gp AS (SELECT *, CASE WHEN p >= 1 THEN 1 ELSE floor(ln(1 - {uniform_sql(42, "gap", "i", "j", "frm", "k")}) / ln(1 - p)) + 1 END AS gap FROM ks),
hits AS (SELECT i, j, nj, frm + (sum(gap) OVER (PARTITION BY i, j, frm ORDER BY k) - 1)::BIGINT AS slot, (sum(gap) OVER (PARTITION BY i, j, frm ORDER BY k) - 1) < size AS inside FROM gp),
rw AS (SELECT i, j, CASE WHEN i = j THEN floor((1 + sqrt(1 + 8.0::DOUBLE * slot)) / 2)::BIGINT ELSE slot // nj END AS x0, slot, nj FROM hits WHERE inside),
rx AS (SELECT i, j, CASE WHEN i = j AND x0 * (x0 - 1) // 2 > slot THEN x0 - 1 ELSE x0 END AS x, slot, nj FROM rw),
sbm AS (SELECT least(a.node_id, b.node_id) AS u, greatest(a.node_id, b.node_id) AS v FROM rx JOIN bm a ON a.block = i AND a.idx = x JOIN bm b ON b.block = j AND b.idx = CASE WHEN i = j THEN slot - x * (x - 1) // 2 ELSE slot % nj END)"""


BLOCKS = "SELECT node_id, group_id % 3 AS block FROM fx_gnodes"
BLOCK_P = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {0.02 if i == j else 0.004}::DOUBLE)" for i in range(3) for j in range(i, 3)) + ") t(i, j, p)"


@query(f"{_sbm_sql(BLOCKS, BLOCK_P)} SELECT u, v FROM sbm")
def g1_stochastic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.stochastic_blocks(*_blocks(spark, sf_dir))


@query(f"{_sbm_sql(BLOCKS, BLOCK_P)} SELECT u AS src, v AS dst FROM sbm UNION ALL SELECT v, u FROM sbm")
def g2_symmetric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.symmetric_blocks(*_blocks(spark, sf_dir))


INDUCED = f"SELECT node_id, block FROM ({BLOCKS}) ORDER BY {uniform_sql(42, 'induce', 'node_id')}, node_id LIMIT 300"


@query(f"{_sbm_sql(INDUCED, BLOCK_P)} SELECT u, v FROM sbm")
def g3_induced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.induced_sample(*_blocks(spark, sf_dir), 300)[1]


@query(
    ", und AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM fx_edges), d AS (SELECT node_id, count(x) AS k FROM fx_nodes LEFT JOIN (SELECT u AS x FROM und UNION ALL SELECT v FROM und) ON x = node_id GROUP BY node_id), w AS (SELECT count(*) AS n_edges, avg(CASE WHEN a.group_id = b.group_id THEN 1.0 ELSE 0.0 END) AS within FROM und JOIN fx_gnodes a ON u = a.node_id JOIN fx_gnodes b ON v = b.node_id) SELECT round(avg(k), 6) AS degree_mean, round(stddev_pop(k), 6) AS degree_std, min(k) AS degree_min, max(k) AS degree_max, any_value(n_edges) AS n_edges, round(any_value(within), 6) AS within, round(any_value(n_edges) / (count(*) * (count(*) - 1) / 2), 6) AS density FROM d, w"
)
def g5_block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.grouped_nodes(spark, sf_dir).select("node_id", F.col("group_id").alias("block"))
    return rounded(models.block_statistics(n, metrics.undirected(fx.edges(spark, sf_dir))))


@query(
    ", l AS (SELECT 'seg' AS attribute, seg AS value FROM fx_nodes UNION ALL SELECT 'reg', reg FROM fx_nodes), c AS (SELECT attribute, value, count(*) AS n FROM l GROUP BY ALL) SELECT attribute, value, n, round(100 * n / sum(n) OVER (PARTITION BY attribute), 6) AS percent, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, value)::INT AS rank FROM c QUALIFY rank <= 3"
)
def g6_attribute_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.attribute_summary(fx.nodes(spark, sf_dir), ["seg", "reg"], 3))


PAIR = "CASE WHEN r0 * (r0 - 1) // 2 > slot THEN r0 - 1 ELSE r0 END"


@query(
    f", d AS (SELECT id, least(floor({uniform_sql(42, 'slot', 'id')} * 499500), 499499)::BIGINT AS slot FROM range(20000) t(id)), f AS (SELECT slot, min(id) AS id FROM d GROUP BY slot ORDER BY id LIMIT 2500), r AS (SELECT slot, floor((1 + sqrt(1 + 8.0::DOUBLE * slot)) / 2)::BIGINT AS r0 FROM f), q AS (SELECT slot, {PAIR} AS v FROM r) SELECT slot - v * (v - 1) // 2 AS u, v FROM q"
)
def g7_fixed_size_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fixed_size_graph(spark, 1000, 2500)


@query(
    f", sl AS (SELECT slot FROM range(780) t(slot) ORDER BY {uniform_sql(42, 'slot', 'slot')}, slot LIMIT 400), r AS (SELECT slot, floor((1 + sqrt(1 + 8.0::DOUBLE * slot)) / 2)::BIGINT AS r0 FROM sl), q AS (SELECT slot, {PAIR} AS v FROM r) SELECT slot - v * (v - 1) // 2 AS u, v FROM q"
)
def g7_dense_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fixed_size_graph(spark, 40, 400)


def _draw(stream: str, size: str) -> str:
    return f"least(floor({uniform_sql(42, stream, 'id')} * {size}), {size} - 1)::BIGINT"


@query(
    f", hm AS MATERIALIZED (SELECT node_id, block, row_number() OVER (PARTITION BY block ORDER BY {uniform_sql(42, 'member', 'node_id')}, node_id) - 1 AS i FROM ({BLOCKS})), hs AS (SELECT block, count(*) AS n, row_number() OVER (ORDER BY block) - 1 AS k FROM hm GROUP BY block),"
    " ha AS MATERIALIZED (SELECT node_id, block, i + first AS g FROM hm JOIN (SELECT block, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM hs) USING (block)), ht AS (SELECT count(*) AS n FROM ha),"
    f" di AS (SELECT id, block, {_draw('in/a', 'n')} AS x, {_draw('in/b', 'n')} AS y FROM (SELECT id, {_draw('block', '(SELECT count(*) FROM hs)')} AS k FROM range(20000) t(id)) JOIN hs USING (k)),"
    " ei AS (SELECT least(a.node_id, b.node_id) AS u, greatest(a.node_id, b.node_id) AS v, min(id) AS id FROM di JOIN hm a ON a.block = di.block AND a.i = x JOIN hm b ON b.block = di.block AND b.i = y WHERE a.node_id <> b.node_id GROUP BY ALL ORDER BY id LIMIT 1800),"
    f" do_ AS (SELECT id, {_draw('out/a', 'n')} AS x, {_draw('out/b', 'n')} AS y FROM range(20000) t(id), ht),"
    " eo AS (SELECT least(a.node_id, b.node_id) AS u, greatest(a.node_id, b.node_id) AS v, min(id) AS id FROM do_ JOIN ha a ON a.g = x JOIN ha b ON b.g = y WHERE a.block <> b.block GROUP BY ALL ORDER BY id LIMIT 200) SELECT u, v FROM ei UNION ALL SELECT u, v FROM eo"
)
def g8_homophily_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.homophily_graph(_blocks(spark, sf_dir)[0], 2000, 0.9)


SCALE_FREE = f""", own AS MATERIALIZED (SELECT t, t // 3 AS v, floor({uniform_sql(42, 'copy', 't')} * 2 * ((t // 3) * 3))::BIGINT AS e FROM range(9, 3000) r(t)),
st AS MATERIALIZED (SELECT t, v, CASE WHEN e // 2 < 9 THEN e % 3 WHEN e % 2 = 0 THEN (e // 2) // 3 END AS dest, CASE WHEN e // 2 >= 9 AND e % 2 = 1 THEN e // 2 END AS ask FROM own),
ch AS (SELECT t, t AS cur FROM st UNION ALL SELECT ch.t, st.ask FROM ch JOIN st ON st.t = ch.cur WHERE st.ask IS NOT NULL),
sf AS (SELECT DISTINCT least(s.v, e.dest) AS u, greatest(s.v, e.dest) AS v FROM ch JOIN st s ON s.t = ch.t JOIN st e ON e.t = ch.cur WHERE e.dest IS NOT NULL AND s.v <> e.dest UNION SELECT * FROM (VALUES (0, 1), (0, 2), (1, 2)) c(u, v))"""


@query(f"{SCALE_FREE} SELECT u::BIGINT AS u, v::BIGINT AS v FROM sf")
def g9_scale_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.scale_free(spark, 1000, 3)


@query(f"{SCALE_FREE} SELECT u::BIGINT AS u, v::BIGINT AS v FROM sf ORDER BY {uniform_sql(42, 'drop', 'u', 'v')}, u, v LIMIT 2500")
def g9_fewer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fit_edge_count(stored(models.scale_free(spark, 1000, 3), "pairs"), 1000, 2500)


SMALL_WORLD = f", sw AS (SELECT a, CASE WHEN {uniform_sql(42, 'rewire', 'a', 'step')} < 0.1 THEN floor({uniform_sql(42, 'to', 'a', 'step')} * 1000)::BIGINT ELSE (a + step) % 1000 END AS b FROM range(1000) r(a), range(1, 4) s(step)), ws AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM sw WHERE a <> b)"


@query(f"{SMALL_WORLD} SELECT u, v FROM ws")
def g10_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.small_world(spark, 1000, 6, 0.1)


@query(
    f"{SMALL_WORLD}, need AS (SELECT 3500 - count(*) AS k, 3500 + count(*) AS m FROM ws), d AS (SELECT id, least(floor({uniform_sql(42, 'slot', 'id')} * 499500), 499499)::BIGINT AS slot FROM range(40000) t(id)), f AS (SELECT slot FROM (SELECT slot, min(id) AS id FROM d GROUP BY slot) QUALIFY row_number() OVER (ORDER BY id) <= (SELECT m FROM need)), r AS (SELECT slot, floor((1 + sqrt(1 + 8.0::DOUBLE * slot)) / 2)::BIGINT AS r0 FROM f), q AS (SELECT slot, {PAIR} AS v FROM r), c AS (SELECT slot - v * (v - 1) // 2 AS u, v FROM q)"
    f" SELECT u, v FROM ws UNION ALL SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY {uniform_sql(42, 'add', 'u', 'v')}, u, v) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM ws WHERE ws.u = c.u AND ws.v = c.v)) WHERE k <= (SELECT k FROM need)"
)
def g10_more_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fit_edge_count(stored(models.small_world(spark, 1000, 6, 0.1), "pairs"), 1000, 3500)


@query(
    f", d AS (SELECT id, floor({uniform_sql(42, 'accept/a', 'id')} * 200)::BIGINT AS a, floor({uniform_sql(42, 'accept/b', 'id')} * 200)::BIGINT AS b, {uniform_sql(42, 'accept/keep', 'id')} AS k FROM range(50000) t(id))"
    " SELECT least(a, b) AS u, greatest(a, b) AS v FROM d WHERE a <> b AND k < CASE WHEN least(a // 50, 3) = least(b // 50, 3) THEN 0.8 ELSE 0.1 END GROUP BY ALL ORDER BY min(id) LIMIT 500"
)
def g11_accept_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.accept_reject_graph(spark, 200, 4, 500)


@query(
    f"{_sbm_sql('SELECT i AS node_id, CASE WHEN i < 8 THEN 0 ELSE 1 END AS block FROM range(60) t(i)', 'SELECT * FROM (VALUES (0, 0, 0.6::DOUBLE), (1, 1, 0.1::DOUBLE)) t(i, j, p)')}"
    f", rim AS (SELECT i AS v, CASE WHEN {uniform_sql(42, 'links', 'i')} < 0.5 THEN 2 ELSE 3 END AS links FROM range(8, 60) t(i)), ends AS (SELECT u, v FROM rim, range(8) c(u) QUALIFY row_number() OVER (PARTITION BY v ORDER BY {uniform_sql(42, 'core', 'v', 'u')}, u) <= links) SELECT u, v FROM sbm UNION ALL SELECT u, v FROM ends"
)
def g11_core_periphery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.core_periphery(spark, 60)


@query(f"{_sbm_sql('SELECT node_id, 0 AS block FROM fx_nodes', 'SELECT 0 AS i, 0 AS j, least(1.0, 6.0::DOUBLE / greatest(count(*) - 1, 1)) AS p FROM fx_nodes')} SELECT u, v FROM sbm")
def g12_random_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.random_graph(fx.nodes(spark, sf_dir), 6.0)


BRACKETS = list(enrich.AGE_RANGES)
DOMAIN = ", dom AS (SELECT node_id, (['" + "','".join(BRACKETS) + "'])[(node_id % 8 + 1)::INT] AS lft, (node_id % 3 + 1)::INT AS oplniv FROM fx_nodes)"
AGE = uniform_sql(42, "age", "node_id")
AGES = (
    ", lim(lft, lo, w) AS (VALUES " + ", ".join(f"('{k}', {a}, {b - a + 1})" for k, (a, b) in enrich.AGE_RANGES.items()) + f"), aged AS (SELECT node_id, lft, oplniv, (lo + floor({AGE} * w))::INT AS age FROM dom JOIN lim USING (lft))"
)


def domain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lft = F.element_at(F.array(*map(F.lit, BRACKETS)), (F.pmod("node_id", F.lit(8)) + 1).cast("int"))
    return fx.nodes(spark, sf_dir).select("node_id", lft.alias("lft"), (F.pmod("node_id", F.lit(3)) + 1).cast("int").alias("oplniv"))


@query(f"{DOMAIN}{AGES} SELECT node_id, lft, oplniv, age, '[' || (age // 5 * 5) || ',' || (age // 5 * 5 + 5) || ')' AS age_bracket_5yr FROM aged")
def a1_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.ages(domain_nodes(spark, sf_dir))


INCOMES = f"{DOMAIN}{AGES}, inc AS (SELECT *, CASE WHEN age < 20 THEN '{enrich.NOT_APPLICABLE}' ELSE (['" + "','".join(enrich.INCOME) + "'])[(node_id % 4 + 1)::INT] END AS inkomensniveau FROM aged)"
WORK_ROWS = ", ".join(
    f"('{lft}', {edu}, '{band}', {pos}, '{c}', ({p}::DOUBLE * {enrich.WORK_BY_EDUCATION.get(edu, {}).get(c, 1.0)}::DOUBLE) * {enrich.WORK_BY_INCOME.get(band, {}).get(c, 1.0)}::DOUBLE)"
    for lft, base in enrich.WORK.items()
    for edu in (1, 2, 3)
    for band in (*enrich.INCOME, enrich.NOT_APPLICABLE)
    for pos, (c, p) in enumerate(base.items())
)
WORKS = (
    f"{INCOMES}, ww(lft, oplniv, inkomensniveau, pos, category, p) AS (VALUES {WORK_ROWS}), ws AS (SELECT lft, oplniv, inkomensniveau, pos, category, sum(p) OVER (PARTITION BY lft, oplniv, inkomensniveau ORDER BY pos) / sum(p) OVER (PARTITION BY lft, oplniv, inkomensniveau) AS high FROM ww),"
    f" worked AS (SELECT i.*, (SELECT arg_min(category, pos) FROM ws WHERE ws.lft = i.lft AND ws.oplniv = i.oplniv AND ws.inkomensniveau = i.inkomensniveau AND high > {uniform_sql(42, 'work', 'i.node_id')}) AS arbeidsstatus FROM inc i)"
)


def _with_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.element_at(F.array(*map(F.lit, enrich.INCOME)), (F.pmod("node_id", F.lit(4)) + 1).cast("int"))
    return enrich.ages(domain_nodes(spark, sf_dir)).drop("age_bracket_5yr").withColumn("inkomensniveau", F.when(F.col("age") < 20, enrich.NOT_APPLICABLE).otherwise(band))


@query(f"{WORKS} SELECT node_id, lft, oplniv, age, inkomensniveau, arbeidsstatus FROM worked")
def a4_work_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.work_status(_with_income(spark, sf_dir)).select("node_id", "lft", "oplniv", "age", "inkomensniveau", "arbeidsstatus")


@query(
    WORKS
    + ", bw(s, pos, category, p) AS (VALUES "
    + ", ".join(f"('{w}', {pos}, '{c}', {p}::DOUBLE)" for w, t in enrich.BENEFIT.items() for pos, (c, p) in enumerate(t.items()))
    + "), bs AS (SELECT s, pos, category, sum(p) OVER (PARTITION BY s ORDER BY pos) / sum(p) OVER (PARTITION BY s) AS high FROM bw), k AS (SELECT node_id, CASE WHEN arbeidsstatus = 'Gepensioneerd' AND age < 67 THEN '"
    + enrich.EARLY
    + f"' ELSE arbeidsstatus END AS s FROM worked) SELECT node_id, (SELECT arg_min(category, pos) FROM bs WHERE bs.s = k.s AND high > {uniform_sql(42, 'benefit', 'k.node_id')}) AS uitkeringstype FROM k"
)
def a5_benefits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.benefits(enrich.work_status(_with_income(spark, sf_dir))).select("node_id", "uitkeringstype")


def _waves_sql(strength: float, decay: tuple[float, ...], stream: str, waves: int) -> str:
    """Codes drawn in waves by descending degree, from CTE base (node_id, code, p)."""
    parts = [
        f"{DEGREES}, wv AS MATERIALIZED (SELECT node_id, floor((row_number() OVER (ORDER BY degree DESC, node_id) - 1) * {waves} / greatest(count(*) OVER (), 1))::INT AS wave FROM deg WHERE node_id IN (SELECT node_id FROM base)),"
        " near AS MATERIALIZED (SELECT src AS node_id, dst AS other FROM fx_edges UNION ALL SELECT dst, src FROM fx_edges), codes AS (SELECT DISTINCT code FROM base), done0 AS (SELECT node_id, code FROM base WHERE false)"
    ]
    for i in range(1, waves + 1):
        parts.append(
            f", seen{i} AS (SELECT n.node_id, d.code AS seen, count(*) AS n FROM near n JOIN wv USING (node_id) JOIN done{i - 1} d ON d.node_id = n.other WHERE wave = {i - 1} GROUP BY ALL),"
            f" hom{i} AS (SELECT node_id, c.code, sum(n * ([{', '.join(f'{x!r}::DOUBLE' for x in decay)}])[abs(c.code - seen) + 1]) AS h FROM seen{i}, codes c GROUP BY ALL),"
            f" hn{i} AS (SELECT node_id, code, h / sum(h) OVER (PARTITION BY node_id) AS h FROM hom{i}),"
            f" p{i} AS (SELECT b.node_id, b.code, CASE WHEN h IS NULL THEN p ELSE (1 - {strength}::DOUBLE) * p + {strength}::DOUBLE * (CASE WHEN p > 0 THEN h ELSE 0 END) END AS p FROM base b JOIN wv USING (node_id) LEFT JOIN hn{i} USING (node_id, code) WHERE wave = {i - 1}),"
            f" c{i} AS (SELECT *, sum(p) OVER (PARTITION BY node_id ORDER BY code) AS upto, {uniform_sql(42, stream, 'node_id')} * sum(p) OVER (PARTITION BY node_id) AS u FROM p{i}),"
            f" done{i} AS MATERIALIZED (SELECT * FROM done{i - 1} UNION ALL SELECT node_id, coalesce(min(code) FILTER (upto > u AND p > 0), max(code) FILTER (p > 0)) FROM c{i} GROUP BY node_id)"
        )
    return "".join(parts)


def _order_sql(strength: float, decay: tuple[float, ...], stream: str) -> str:
    """CTE drawn (node_id, code) from base (node_id, code, p): a node is drawn once all its neighbours
    of higher rank (degree, then smaller id) are."""
    kernel = f"([{', '.join(f'{x!r}::DOUBLE' for x in decay)}])[abs(c.code - s.code) + 1]"
    return f"""{DEGREES}, rk AS MATERIALIZED (SELECT node_id, row_number() OVER (ORDER BY degree DESC, node_id) AS rank FROM deg WHERE node_id IN (SELECT node_id FROM base)),
codes AS (SELECT DISTINCT code FROM base),
high AS MATERIALIZED (
  SELECT e.node_id, e.other FROM (SELECT src AS node_id, dst AS other FROM fx_edges UNION SELECT dst, src FROM fx_edges) e
  JOIN rk a ON a.node_id = e.node_id JOIN rk b ON b.node_id = e.other WHERE b.rank < a.rank),
waits AS MATERIALIZED (SELECT rk.node_id, count(high.other) AS n FROM rk LEFT JOIN high USING (node_id) GROUP BY rk.node_id),
dr AS (
  SELECT 0 AS r, NULL::BIGINT AS node_id, NULL::INT AS code, true AS moves
  UNION ALL
  SELECT r + 1, node_id, code, bool_or(fresh) OVER () FROM (
    SELECT r, node_id, code, false AS fresh FROM dr WHERE moves
    UNION ALL
    SELECT r, node_id, coalesce(min(code) FILTER (upto > u AND p > 0), max(code) FILTER (p > 0)), true FROM (
      SELECT r, node_id, code, p, sum(p) OVER (PARTITION BY node_id ORDER BY code) AS upto, {uniform_sql(42, stream, "node_id")} * sum(p) OVER (PARTITION BY node_id) AS u FROM (
        SELECT r, node_id, code, CASE WHEN h IS NULL THEN p ELSE (1 - {strength}::DOUBLE) * p + {strength}::DOUBLE * (CASE WHEN p > 0 THEN h / hs ELSE 0 END) END AS p FROM (
          SELECT w.r, b.node_id, b.code, b.p, x.h, sum(x.h) OVER (PARTITION BY b.node_id) AS hs
          FROM (
            SELECT t.r, waits.node_id FROM (SELECT max(r) AS r FROM dr WHERE moves) t, waits
            LEFT JOIN (SELECT high.node_id, count(*) AS k FROM high JOIN dr ON dr.node_id = high.other WHERE dr.moves GROUP BY ALL) g ON g.node_id = waits.node_id
            LEFT JOIN dr own ON own.node_id = waits.node_id
            WHERE t.r IS NOT NULL AND own.node_id IS NULL AND coalesce(g.k, 0) = waits.n) w
          JOIN base b ON b.node_id = w.node_id
          LEFT JOIN (SELECT high.node_id, c.code, sum({kernel}) AS h FROM high JOIN dr s ON s.node_id = high.other, codes c WHERE s.moves GROUP BY ALL) x ON x.node_id = b.node_id AND x.code = b.code)))
    GROUP BY r, node_id)),
drawn AS MATERIALIZED (SELECT node_id, code FROM dr WHERE r = (SELECT max(r) FROM dr) AND node_id IS NOT NULL)
"""


STEP = "CASE " + " ".join(f"WHEN age < {bound} THEN {k}" for k, (bound, _) in enumerate(enrich.INCOME_BY_AGE[:-1])) + f" ELSE {len(enrich.INCOME_BY_AGE) - 1} END"
INCOME_SQL = (
    f"{DOMAIN}{AGES}, ie(oplniv, code, p) AS (VALUES "
    + ", ".join(f"({e}, {i}, {p}::DOUBLE)" for e, ps in enrich.INCOME_BY_EDUCATION.items() for i, p in enumerate(ps))
    + "), ia(step, code, m) AS (VALUES "
    + ", ".join(f"({k}, {i}, {m}::DOUBLE)" for k, (_, ms) in enumerate(enrich.INCOME_BY_AGE) for i, m in enumerate(ms))
    + f"), base AS MATERIALIZED (SELECT node_id, code, p * m / sum(p * m) OVER (PARTITION BY node_id) AS p FROM (SELECT node_id, oplniv, {STEP} AS step FROM aged WHERE age >= 20) JOIN ie USING (oplniv) JOIN ia USING (step, code))"
)


@query(
    f"{INCOME_SQL}{_waves_sql(enrich.INCOME_STRENGTH, enrich.INCOME_DECAY, 'income', 3)} SELECT a.node_id, lft, oplniv, age, '[' || (age // 5 * 5) || ',' || (age // 5 * 5 + 5) || ')' AS age_bracket_5yr,"
    + " coalesce(([" + ", ".join(f"'{b}'" for b in enrich.INCOME) + f"])[code + 1], '{enrich.NOT_APPLICABLE}') AS inkomensniveau FROM aged a LEFT JOIN done3 USING (node_id)"
)
def a3_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.income(enrich.ages(domain_nodes(spark, sf_dir)), fx.edges(spark, sf_dir), waves=3)


@query(
    f"{INCOME_SQL}{_order_sql(enrich.INCOME_STRENGTH, enrich.INCOME_DECAY, 'income')} SELECT node_id, coalesce(([" + ", ".join(f"'{b}'" for b in enrich.INCOME) + f"])[code + 1], '{enrich.NOT_APPLICABLE}') AS inkomensniveau FROM aged LEFT JOIN drawn USING (node_id)"
)
def a3_income_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.income(enrich.ages(domain_nodes(spark, sf_dir)), fx.edges(spark, sf_dir)).select("node_id", "inkomensniveau")


@query(
    f"{DOMAIN}, mb(lft, code, p) AS (VALUES "
    + ", ".join(f"('{k}', {i}, {p}::DOUBLE)" for k, ps in enrich.MARITAL_BY_AGE.items() for i, p in enumerate(ps))
    + f"), base AS MATERIALIZED (SELECT node_id, code, p FROM dom JOIN mb USING (lft)){_waves_sql(enrich.MARITAL_STRENGTH, enrich.MARITAL_DECAY, 'marital', 3)} SELECT d.node_id, lft, oplniv, (["
    + ", ".join(f"'{m}'" for m in enrich.MARITAL)
    + "])[code + 1] AS burgerlijke_staat FROM dom d LEFT JOIN done3 USING (node_id)"
)
def a6_marital_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.marital_status(domain_nodes(spark, sf_dir), fx.edges(spark, sf_dir), waves=3)


@query(
    f"{DOMAIN}, mb(lft, code, p) AS (VALUES "
    + ", ".join(f"('{k}', {i}, {p}::DOUBLE)" for k, ps in enrich.MARITAL_BY_AGE.items() for i, p in enumerate(ps))
    + f"), base AS MATERIALIZED (SELECT node_id, code, p FROM dom JOIN mb USING (lft)){_order_sql(enrich.MARITAL_STRENGTH, enrich.MARITAL_DECAY, 'marital')} SELECT node_id, (["
    + ", ".join(f"'{m}'" for m in enrich.MARITAL)
    + "])[code + 1] AS burgerlijke_staat FROM dom LEFT JOIN drawn USING (node_id)"
)
def a6_marital_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.marital_status(domain_nodes(spark, sf_dir), fx.edges(spark, sf_dir)).select("node_id", "burgerlijke_staat")


DISTANCE = INCOMES + ", code AS (SELECT node_id, list_position(['" + "','".join(enrich.INCOME) + "'], inkomensniveau) AS b FROM inc), dist AS (SELECT src, dst, abs(x.b - y.b)::INT AS income_distance FROM fx_edges LEFT JOIN code x ON x.node_id = src LEFT JOIN code y ON y.node_id = dst)"


@query(f"{DISTANCE} SELECT * FROM dist")
def a7_income_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.income_distance(fx.edges(spark, sf_dir), _with_income(spark, sf_dir)).select("src", "dst", "income_distance")


@query(f"{DISTANCE} SELECT count(*) FILTER (income_distance = 0) AS same, count(*) FILTER (income_distance > 0) AS \"cross\", count(*) FILTER (income_distance IS NULL) AS unknown FROM dist")
def a8_edge_homophily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.edge_homophily(enrich.income_distance(fx.edges(spark, sf_dir), _with_income(spark, sf_dir)))


@query(
    f"{INCOMES}, l AS (SELECT 'inkomensniveau' AS attribute, inkomensniveau AS value FROM inc UNION ALL SELECT 'oplniv', oplniv::VARCHAR FROM inc) SELECT attribute, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY attribute), 6) AS share FROM l GROUP BY attribute, value"
)
def a8_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(enrich.distributions(_with_income(spark, sf_dir), ["inkomensniveau", "oplniv"]))


# --- tables, resume -------------------------------------------------------------


@query(" SELECT seg, count(*) AS n FROM fx_nodes GROUP BY seg")
def k3_population_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.population_table(fx.nodes(spark, sf_dir), ["seg"])


@query(" SELECT seg_src, seg_dst, sum(n)::BIGINT AS n FROM fx_links GROUP BY ALL")
def k4_interaction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.interaction_table(fx.edges(spark, sf_dir), fx.nodes(spark, sf_dir), ["seg"])


FOLDERS = [("a", "scale=0.1_comms=50_recip=1_trans=0.5_pa=0.99_bridge=0.2"), ("b", "scale=12_comms=1000_trans=0_pa=0"), ("c", "nothing"), ("d", "recip=0_bridge=1.5")]
FOLDERS_SQL = ", folders(name, params) AS (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in FOLDERS) + ")"


@query(f"{FOLDERS_SQL} SELECT name, " + ", ".join(f"try_cast(nullif(regexp_extract(params, '{n}=({v})', 1), '') AS DOUBLE) AS {n}" for n, v in (("scale", r"\d+"), ("comms", r"\d+"), ("recip", r"\d+"), ("trans", r"[\d.]+"), ("pa", r"[\d.]+"), ("bridge", r"[\d.]+"))) + " FROM folders")
def p5_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(FOLDERS, "name string, params string").select("name", *tables.parameters("params"))


@query(" SELECT 'scale=' || i || '_pa=' || (i / 4)::DOUBLE AS folder, regexp_replace('x' || i || '_stats', '_stats$', '') AS key FROM range(4) t(i)")
def p18_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(4).select("id", (F.col("id") / 4).alias("pa"), F.concat(F.lit("x"), "id", F.lit("_stats")).alias("file"))
    return t.select(tables.folder_name({"scale": "id", "pa": "pa"}).alias("folder"), tables.without_suffix("file").alias("key"))


@query(" SELECT i::INT AS i, round(0.05 + i * 0.45 / 9, 8)::DOUBLE AS value, round(pow(10, i * 4.7 / 9), 6)::DOUBLE AS power FROM range(10) t(i)")
def p15_spaced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables.linspace(spark, 0.05, 0.5, 10).withColumn("value", F.round("value", 8))
    return a.join(tables.logspace(spark, 0, 4.7, 10, "power").withColumn("power", F.round("power", 6)), "i")


@query(" SELECT node_id, node_id % 10 / 10 AS x FROM fx_nodes WHERE node_id % 10 IN (3, 7)")
def p3_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.nodes(spark, sf_dir).select("node_id", (F.col("node_id") % 10 / 10).alias("x"))
    return n.where(tables.near_any("x", [0.3, 0.7000000001]))


@query(" SELECT * FROM (VALUES ('etngrp_geslacht', 'etngrp,geslacht'), ('lft', 'lft'), ('lft_oplniv', 'lft,oplniv')) t(name, dims)")
def p8_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("etngrp_geslacht",), ("lft",), ("lft_oplniv",)], "name string")
    return t.withColumns(tables.parse_dimensions("name", ["etngrp", "geslacht", "lft", "oplniv"])).withColumn("dims", F.array_join("dims", ","))


@query(" SELECT i AS id, CASE WHEN i % 3 = 0 THEN 0 ELSE i END AS total FROM range(9) t(i)")
def p9_parse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from popweave.operators.outcomes import parse_runs

    t = spark.range(9).withColumn("text", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit('"0, '), F.col("id"), F.lit('"'))))
    return t.select("id", F.aggregate(parse_runs("text"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(" SELECT user_id % 5 AS config, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s2_13_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep in batches, interrupted after the first and then resumed."""
    path = claim(spark, "sweep")
    e = fx.table(spark, sf_dir, "events").withColumn("config", F.pmod("user_id", F.lit(5)))
    configs = e.select("config").distinct()
    run = lambda c: e.join(c, "config").groupBy("config").agg(F.round(F.sum("value"), 4).alias("total"))
    resume.append_results(run(configs.where("config < 2")), path, ["config"])
    resume.run_in_batches(configs, path, ["config"], run, 2)
    return resume.read_results(spark, path)


# --- wider tables -----------------------------------------------------------------


def _domain_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.element_at(F.array(*map(F.lit, expand.IMMIGRATION)), (F.pmod(F.floor(F.col("node_id") / 8), F.lit(5)) + 1).cast("int"))
    sex = F.when(F.col("node_id") % 2 == 0, "Man").otherwise("Vrouw")
    return domain_nodes(spark, sf_dir).select("node_id", groups.alias("etngrp"), sex.alias("geslacht"), "lft", "oplniv")


def _split_sql(i: int, before: str, keys: list[str], on: str, table: dict, out: str) -> str:
    """CTE x<i>: rows of ``before`` split over a table's categories by largest remainders."""
    values = ", ".join(f"('{k}', {pos}, '{c}', {p / sum(t.values())!r}::DOUBLE)" for k, t in table.items() for pos, (c, p) in enumerate(t.items()))
    names = ", ".join(keys)
    return (
        f", t{i}(tk, pos, category, p) AS (VALUES {values}), w{i} AS (SELECT r.*, pos, category, p * n AS exact, floor(p * n)::BIGINT AS whole FROM {before} r JOIN t{i} ON tk = {on}),"
        f" k{i} AS (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY {names} ORDER BY exact - whole DESC, pos DESC) <= n - sum(whole) OVER (PARTITION BY {names}) THEN 1 ELSE 0 END AS k FROM w{i}),"
        f" x{i} AS (SELECT {names}, category AS {out}, k::BIGINT AS n FROM k{i} WHERE k > 0)"
    )


def _expanded_sql() -> str:
    groups = "(['" + "','".join(expand.IMMIGRATION) + "'])[(node_id // 8 % 5 + 1)::INT]"
    keys = list(expand.BASE)
    sql = f"{DOMAIN}, dp AS (SELECT node_id, {groups} AS etngrp, CASE WHEN node_id % 2 = 0 THEN 'Man' ELSE 'Vrouw' END AS geslacht, lft, oplniv FROM dom), x0 AS (SELECT {', '.join(keys)}, count(*) AS n FROM dp GROUP BY ALL)"
    child = f"lft = '{expand.CHILDREN}'"
    incomes = {str(e): dict(zip(enrich.INCOME, ps, strict=True)) for e, ps in enrich.INCOME_BY_EDUCATION.items()} | {expand.CHILDREN: {enrich.NOT_APPLICABLE: 1.0}}
    steps = [
        ("lft", expand.MARITAL, "burgerlijke_staat"),
        ("lft", expand.EMPLOYMENT, "arbeidsstatus"),
        (f"CASE WHEN {child} THEN lft ELSE oplniv::VARCHAR END", incomes, "inkomensniveau"),
        ("lft", expand.HEALTH, "gezondheid"),
        ("etngrp", expand.IMMIGRATION, "immigratie_gen"),
        (f"CASE WHEN {child} THEN lft ELSE 'adult' END", {"adult": expand.VOTE, expand.CHILDREN: {"Nee": 1.0}}, "kiesrecht"),
    ]
    for i, (on, table, out) in enumerate(steps, 1):
        sql += _split_sql(i, f"x{i - 1}", keys, on, table, out)
        keys.append(out)
    return sql


@query(f"{_expanded_sql()} SELECT * FROM x6")
def n13_expand_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.expand_population(sinks.population_table(_domain_population(spark, sf_dir), expand.BASE))


ENDS = [c + e for e in ("_src", "_dst") for c in expand.BASE]
BANDS = "(['" + "','".join(enrich.INCOME) + "'])"


@query(
    f"{_expanded_sql()}, sh AS (SELECT {', '.join(expand.BASE)}, inkomensniveau, sum(n) / sum(sum(n)) OVER (PARTITION BY {', '.join(expand.BASE)}) AS share FROM x6 GROUP BY {', '.join(expand.BASE)}, inkomensniveau),"
    f" bd AS (SELECT *, list_position({BANDS}, inkomensniveau) - 1 AS band FROM sh WHERE list_contains({BANDS}, inkomensniveau)),"
    f" il AS (SELECT {', '.join(f'{e}.{c} AS {c}_{n}' for e, n in (('a', 'src'), ('b', 'dst')) for c in expand.BASE)}, count(*) AS n FROM fx_edges JOIN dp a ON a.node_id = src JOIN dp b ON b.node_id = dst GROUP BY ALL),"
    f" iw AS (SELECT il.*, a.band AS ba, b.band AS bb, a.share * b.share * ([{', '.join(f'{x!r}::DOUBLE' for x in enrich.INCOME_DECAY)}])[abs(a.band - b.band) + 1] AS w FROM il JOIN bd a ON {' AND '.join(f'a.{c} = {c}_src' for c in expand.BASE)} JOIN bd b ON {' AND '.join(f'b.{c} = {c}_dst' for c in expand.BASE)}),"
    f" ip AS (SELECT *, w / sum(w) OVER (PARTITION BY {', '.join(ENDS)}) AS p FROM iw), iq AS (SELECT *, p * n AS exact, floor(p * n)::BIGINT AS whole, ba * 4 + bb AS pos FROM ip WHERE w > 0),"
    f" ik AS (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY {', '.join(ENDS)} ORDER BY exact - whole DESC, pos DESC) <= n - sum(whole) OVER (PARTITION BY {', '.join(ENDS)}) THEN 1 ELSE 0 END AS k FROM iq)"
    f" SELECT {', '.join(ENDS)}, {BANDS}[(ba + 1)::INT] AS inkomensniveau_src, {BANDS}[(bb + 1)::INT] AS inkomensniveau_dst, k::BIGINT AS n FROM ik WHERE k > 0"
)
def n14_expand_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _domain_population(spark, sf_dir)
    wide = stored(expand.expand_population(sinks.population_table(people, expand.BASE)), "wide")
    return expand.expand_interactions(sinks.interaction_table(fx.edges(spark, sf_dir), people, expand.BASE), wide)


# --- graph folders ------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return claim(spark, name)


LAYERED = ", le AS (SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst, a.o_orderpriority AS network FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey)"


@query(f"{LAYERED} SELECT network, src, dst FROM le WHERE network IN ('1-URGENT', '3-MEDIUM')")
def s8_load_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs written by network and read back by name, without the baseline."""
    path = _folder(spark, "graphs")
    layered(spark, sf_dir).write.partitionBy("network").parquet(path)
    return tables.read_networks(spark, path, ["1-URGENT", "3-MEDIUM"], baseline=False)


FIRST = "SELECT src AS node_id FROM le WHERE network = '1-URGENT' UNION SELECT dst FROM le WHERE network = '1-URGENT'"


@query(f"{LAYERED}{_sbm_sql(f'SELECT node_id, 0 AS block FROM ({FIRST})', f'SELECT 0 AS i, 0 AS j, least(1.0, (SELECT count(*) FROM le WHERE network = ' + chr(39) + '1-URGENT' + chr(39) + f') / count(*) / greatest(count(*) - 1, 1)) AS p FROM ({FIRST})')} SELECT 'Random (ER)' AS network, u AS src, v AS dst FROM sbm UNION ALL SELECT 'Random (ER)', v, u FROM sbm")
def s8_matched_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "graphs")
    layered(spark, sf_dir).write.partitionBy("network").parquet(path)
    return tables.read_networks(spark, path).where("network = 'Random (ER)'")


@query(" SELECT group_id, seg, reg, count(*) AS n FROM fx_gnodes GROUP BY ALL")
def s7_graph_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of edges and metadata, read back with the groups' attributes."""
    path = _folder(spark, "graph")
    n = fx.grouped_nodes(spark, sf_dir)
    fx.edges(spark, sf_dir).write.parquet(f"{path}/edges")
    of = F.map_from_entries(F.collect_list(F.struct(F.col("node_id").cast("string"), "group_id"))).alias("nodes_to_group")
    attrs = F.map_from_entries(F.collect_set(F.struct(F.col("group_id").cast("string"), F.struct("seg", "reg")))).alias("group_to_attrs")
    n.agg(of, attrs).coalesce(1).write.json(f"{path}/metadata")
    nodes = tables.read_edges(spark, path)[1]
    return nodes.groupBy("group_id", F.col("attrs")["seg"].alias("seg"), F.col("attrs")["reg"].alias("reg")).agg(F.count("*").alias("n"))


@query(", b AS (SELECT row_number() OVER (ORDER BY reg, seg) - 1 AS block, reg, seg FROM fx_pop), l AS (SELECT least(x.block, y.block) AS i, greatest(x.block, y.block) AS j, l.n, x.block AS s FROM fx_links l JOIN b x ON x.reg = reg_src AND x.seg = seg_src JOIN b y ON y.reg = reg_dst AND y.seg = seg_dst) SELECT i, j, round(arg_max(n, s * 1000 + j) / 1e6, 9)::DOUBLE AS p FROM l GROUP BY i, j")
def s15_block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population and connections as CSV, read back as a block model; the later row of a pair wins."""
    path = _folder(spark, "blocks")
    sinks.write_csv(fx.pop(spark, sf_dir).select("reg", "seg", "n"), f"{path}/population.csv")
    links = fx.links(spark, sf_dir).withColumn("fn", F.col("n") / 1e6).drop("n")
    # One part, in order, so that "later" is defined.
    links.coalesce(1).sortWithinPartitions("reg_src", "seg_src", "reg_dst", "seg_dst").write.option("header", True).csv(f"{path}/connections.csv")
    return rounded(tables.read_blocks(spark, f"{path}/population.csv", f"{path}/connections.csv")[1], 9)


@query(f"{_sbm_sql(BLOCKS, BLOCK_P)} SELECT u AS source, v AS target FROM sbm")
def k7_append_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block model's edges written in three batches of one file, read back."""
    path = _folder(spark, "edges")
    e = stored(models.stochastic_blocks(*_blocks(spark, sf_dir)), "pairs")
    sinks.append_edges((e.where(F.pmod(F.xxhash64("u", "v"), F.lit(3)) == b) for b in range(3)), path, compression="gzip")
    return sinks.read_edges(spark, path)


@query(f"{_bfs_sql(12, '(SELECT 7 AS node_id)')}, kept AS (SELECT node_id FROM d12 ORDER BY distance, node_id LIMIT 60) SELECT node_id, seg, reg FROM fx_nodes WHERE node_id IN (SELECT node_id FROM kept)")
def k10_subgraph_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subgraph written twice to one folder, its nodes read back."""
    path = _folder(spark, "subgraph")
    found = metrics.extract_subgraph(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir), 7, 60)
    assert found is not None
    for _ in range(2):
        sinks.write_graph(*found, path)
    return spark.read.parquet(f"{path}/nodes")


@query(f"{LAYERS} SELECT src, dst, array_to_string(list(layer ORDER BY layer), ',') AS layers FROM le GROUP BY src, dst")
def k11_multiplex_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "multiplex")
    sinks.write_layers(_layers(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/combined").withColumn("layers", F.array_join("layers", ","))


@query(
    """, s AS (SELECT seg, dense_rank() OVER (ORDER BY seg) - 1 AS c FROM (SELECT DISTINCT seg FROM fx_nodes)),
    r AS (SELECT reg, dense_rank() OVER (ORDER BY reg) - 1 AS c FROM (SELECT DISTINCT reg FROM fx_nodes))
    SELECT node_id, s.c::SMALLINT AS seg, r.c::SMALLINT AS reg FROM fx_nodes JOIN s USING (seg) JOIN r USING (reg)"""
)
def k6_encoded_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "encoded")
    sinks.write_encoded(fx.nodes(spark, sf_dir), fx.edges(spark, sf_dir), ["seg", "reg"], path)
    return spark.read.parquet(f"{path}/nodes")


@query(" SELECT DISTINCT group_id, seg, reg FROM fx_gnodes")
def k14_group_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "groups")
    sinks.write_groups(fx.grouped_nodes(spark, sf_dir), ["seg", "reg"], path)
    return spark.read.option("header", True).schema("group_id int, seg string, reg string").csv(f"{path}/attributes")


@query(
    f""", comp AS (SELECT DISTINCT node_id % 40 AS community, group_id FROM fx_gnodes),
    th AS (SELECT community, {uniform_sql(42, "theta", "community")} AS theta FROM (SELECT DISTINCT community FROM comp)),
    pl AS (SELECT group_id, community, theta, row_number() OVER (PARTITION BY group_id ORDER BY theta, community) - 1 AS place, count(*) OVER (PARTITION BY group_id) AS n FROM comp JOIN th USING (community)),
    st AS (SELECT t.community, pl.group_id AS dst_group, count(*) FILTER (pl.theta < t.theta) AS center, any_value(n) AS n FROM th t, pl GROUP BY ALL),
    sl AS (SELECT *, unnest(range(8)) AS slot FROM st),
    spot AS (SELECT *, CASE WHEN slot % (2 * least(200, n)) % 2 = 0 THEN center + (slot % (2 * least(200, n))) // 2 ELSE center - (slot % (2 * least(200, n))) // 2 - 1 END AS p FROM sl)
    SELECT spot.community, spot.dst_group, spot.slot, pl.community AS there FROM spot JOIN pl ON pl.group_id = spot.dst_group AND pl.place = ((p % spot.n) + spot.n) % spot.n"""
)
def j14_ring_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest communities of each destination group on the ring, seen from every community."""
    a = fx.grouped_nodes(spark, sf_dir).select("node_id", "group_id", F.pmod("node_id", F.lit(40)).alias("community"))
    comp, theta = com.composition(a), com.coordinates(a)
    places = ed.ring_places(comp, theta)
    asked = comp.select("community").distinct().crossJoin(F.broadcast(comp.select(F.col("group_id").alias("dst_group")).distinct()))
    slots = ed.ring_starts(places, asked, theta).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    at = slots.withColumn("place", ed.ring_slot(F.col("slot"), F.col("center"), F.col("n")))
    there = places.select(F.col("group_id").alias("dst_group"), "place", F.col("community").alias("there"))
    return at.join(there, ["dst_group", "place"]).select("community", "dst_group", "slot", "there")
