"""The domain's tables as views of the driver's TPC-H-like tables.

Customers are people with a market segment and a region; an edge leads from
the customer of an order to the customer of the order with the next key (an
equi-join, so it needs no global sort). FX holds the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.operators import population
from popweave.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("reg"))
    return c.join(places, c.c_nationkey == places.n_nationkey).select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("seg"), "reg")


def pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("seg", "reg").agg(F.count("*").alias("n"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1).alias("k"))
    second = o.select(F.col("o_custkey").alias("dst"), F.col("o_orderkey").alias("k"))
    return first.join(second, "k").where("src <> dst").select("src", "dst").distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    a = n.select(F.col("node_id").alias("src"), F.col("seg").alias("seg_src"), F.col("reg").alias("reg_src"))
    b = n.select(F.col("node_id").alias("dst"), F.col("seg").alias("seg_dst"), F.col("reg").alias("reg_dst"))
    return edges(spark, sf_dir).join(a, "src").join(b, "dst").groupBy("seg_src", "reg_src", "seg_dst", "reg_dst").agg(F.count("*").alias("n"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id by descending count; ``characteristics`` orders reg before seg."""
    return population.groups(pop(spark, sf_dir))


def grouped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir).select("group_id", "seg", "reg")
    return nodes(spark, sf_dir).join(g, ["seg", "reg"]).select("node_id", "group_id", "seg", "reg")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulation outcomes: network, threshold_idx, run, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("network"), F.pmod("user_id", F.lit(4)).alias("threshold_idx"), F.col("event_id").alias("run"), "value")


FX = """
fx_nodes AS (SELECT c.c_custkey AS node_id, c.c_mktsegment AS seg, r.r_name AS reg
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
fx_pop AS (SELECT seg, reg, count(*) AS n FROM fx_nodes GROUP BY seg, reg),
fx_edges AS (SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey),
fx_links AS (SELECT a.seg AS seg_src, a.reg AS reg_src, b.seg AS seg_dst, b.reg AS reg_dst, count(*) AS n
  FROM fx_edges e JOIN fx_nodes a ON e.src = a.node_id JOIN fx_nodes b ON e.dst = b.node_id GROUP BY ALL),
fx_groups AS (SELECT row_number() OVER (ORDER BY n DESC, reg, seg) - 1 AS group_id, seg, reg, n FROM fx_pop),
fx_gnodes AS (SELECT node_id, group_id, seg, reg FROM fx_nodes JOIN fx_groups USING (seg, reg)),
fx_pairs AS (SELECT a.group_id AS src_group, b.group_id AS dst_group, sum(l.n) AS n
  FROM fx_links l JOIN fx_groups a ON l.seg_src = a.seg AND l.reg_src = a.reg
                  JOIN fx_groups b ON l.seg_dst = b.seg AND l.reg_dst = b.reg GROUP BY ALL),
fx_runs AS (SELECT event_type AS network, user_id % 4 AS threshold_idx, event_id AS run, value FROM events)
"""


def with_views(sql: str) -> str:
    """A DuckDB query over the views."""
    return f"WITH RECURSIVE {FX}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
