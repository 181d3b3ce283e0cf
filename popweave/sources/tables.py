"""Readers of population, interaction, community, statistics and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.operators.outcomes import parse_runs


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV (with a header), Parquet, JSON or ORC by extension; Excel through
    pandas where an engine for it is installed. ValueError for others."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        r = spark.read.option("header", True)
        return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    if kind in ("parquet", "json", "orc"):
        r = spark.read.schema(schema) if schema else spark.read
        return r.format(kind).load(path)
    if kind in ("xls", "xlsx"):
        import pandas as pd

        try:
            return spark.createDataFrame(pd.read_excel(path))
        except ImportError as error:
            raise ValueError(f"reading {path} needs a pandas Excel engine, such as openpyxl") from error
    raise ValueError(f"unknown kind of table: {path}")


def read_population(spark: SparkSession, path: str, count: str = "n", schema: str | None = None) -> DataFrame:
    """Rows with people; the filter goes down to columnar files."""
    return read_table(spark, path, schema).where(F.col(count) > 0)


def read_interactions(spark: SparkSession, path: str, names: Sequence[str], src: str = "_src", dst: str = "_dst", count: str = "n", schema: str | None = None) -> DataFrame:
    """Both ends' attributes and the count, of rows with links."""
    t = read_table(spark, path, schema).where(F.col(count) > 0)
    return t.select(*(c + s for s in (src, dst) for c in names), count)


def read_layers(spark: SparkSession, folder: str, prefix: str = "interactions_") -> DataFrame:
    """All ``<prefix><partition>.csv`` under a folder, with a column partition."""
    t = spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}*.csv").csv(folder)
    return t.withColumn("partition", F.regexp_extract(F.col("_metadata.file_name"), rf"^{prefix}(.*)\.csv$", 1))


def read_tasks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Task files of one result, united by name; missing ones are left out."""
    out = None
    for path in paths:
        try:
            t = spark.read.option("header", True).option("inferSchema", True).csv(path)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise ValueError("none of the task files exists")
    return out


def read_statistics(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All JSON files under a folder, with folder, filename and file_path."""
    r = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json")
    t = (r.schema(schema) if schema else r).json(folder)
    path = F.col("_metadata.file_path")
    return t.withColumns({"file_path": path, "filename": F.col("_metadata.file_name"), "folder": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)})


#: Parameters in a network's folder name, and what their values look like (fixed values; the first three are whole numbers).
PARAMETERS = {"scale": r"\d+", "comms": r"\d+", "recip": r"\d+", "trans": r"[\d.]+", "pa": r"[\d.]+", "bridge": r"[\d.]+"}


def parameters(params: str) -> list:
    """Columns for the name=value pairs in a text, as doubles; null where a name is missing.

    Whole numbers end at the first other character, so scale=0.1 gives 0.
    """
    out = []
    for name, value in PARAMETERS.items():
        found = F.regexp_extract(params, f"{name}=({value})", 1)
        out.append(F.when(found != "", found.try_cast("double")).alias(name))
    return out


def folder_name(values: dict) -> Column:
    """The folder name of a network, as :func:`parameters` reads it, from columns by name."""
    return F.concat_ws("_", *(F.concat(F.lit(f"{name}="), F.col(column).cast("string")) for name, column in values.items()))


def linspace(spark: SparkSession, start: float, stop: float, n: int, out: str = "value") -> DataFrame:
    """(i, value): n evenly spaced values with both ends."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (F.lit(float(start)) + F.col("id") * step).alias(out))


def logspace(spark: SparkSession, start: float, stop: float, n: int, out: str = "value") -> DataFrame:
    """(i, value): powers of ten with evenly spaced exponents."""
    return linspace(spark, start, stop, n, out).withColumn(out, F.pow(F.lit(10.0), F.col(out)))


def without_suffix(column: str, suffix: str = "_stats") -> Column:
    """A file name without the ending of statistics files."""
    return F.regexp_replace(column, f"{suffix}$", "")


def near_any(column: str, values: Sequence[float], tolerance: float = 1e-6):
    """Whether a number lies within ``tolerance`` of one of ``values``."""
    return F.exists(F.array(*map(F.lit, values)), lambda v: F.abs(F.col(column) - v) < tolerance)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run-level results: adds runs (array) and network_size_est, the largest run of each network."""
    from pyspark.sql import Window

    t = spark.read.option("header", True).option("inferSchema", True).csv(path).withColumn("runs", parse_runs("final_values"))
    return t.withColumn("network_size_est", F.max(F.array_max("runs")).over(Window.partitionBy("network")))


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, community) of a community file (JSON with nodes_to_communities)."""
    t = spark.read.schema("nodes_to_communities map<string,int>").option("multiLine", True).json(path)
    return t.select(F.explode("nodes_to_communities").alias("node_id", "community")).select(F.col("node_id").cast("long").alias("node_id"), "community")


def read_communities(spark: SparkSession, path: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignment, groups, coordinates) of a community file: people who are among
    ``nodes`` (node_id, group_id), the groups of each community, and its place on the
    ring where the file has coordinates."""
    a = nodes.select("node_id", "group_id").join(read_assignment(spark, path), "node_id")
    t = spark.read.schema("community_coordinates map<string,double>").option("multiLine", True).json(path)
    places = t.select(F.explode("community_coordinates").alias("c", "theta")).select(F.col("c").cast("int").alias("community"), "theta")
    return a, a.select("community", "group_id").distinct(), places


def unassigned(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """Nodes without a community."""
    return nodes.select("node_id").join(assignment, "node_id", "left_anti")


def parse_dimensions(column: str, names: Sequence[str], out: str = "dims") -> dict:
    """{out: names found in a text}, longest first, each occurrence used once."""
    found, rest = F.array().cast("array<string>"), F.col(column)
    for n in sorted(names, key=len, reverse=True):
        hit = rest.contains(n)
        found = F.when(hit, F.array_append(found, F.lit(n))).otherwise(found)
        rest = F.when(hit, F.replace(rest, F.lit(n), F.lit("\x00"))).otherwise(rest)
    return {out: F.array_sort(found)}


def read_edges(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a graph folder: edges/ (src, dst), and metadata/ (JSON
    with nodes_to_group and group_to_attrs), whose attributes nodes get."""
    meta = spark.read.schema("nodes_to_group map<string,int>, group_to_attrs map<string,map<string,string>>").option("multiLine", True).json(f"{folder}/metadata")
    groups = meta.select(F.explode("group_to_attrs").alias("g", "attrs")).select(F.col("g").cast("int").alias("group_id"), "attrs")
    nodes = meta.select(F.explode("nodes_to_group").alias("n", "group_id")).select(F.col("n").cast("long").alias("node_id"), "group_id")
    return spark.read.parquet(f"{folder}/edges"), nodes.join(groups, "group_id", "left").select("node_id", "group_id", "attrs")


def read_networks(spark: SparkSession, folder: str, names: Sequence[str] | None = None, baseline: bool = True, seed: int = 42) -> DataFrame:
    """(network, src, dst) of all graphs under ``folder`` (network=<name>/), or of ``names`` only.

    With ``baseline``, a random graph comes along with the nodes and the mean
    degree of the first network, as "Random (ER)", both directions of each pair.
    """
    from popweave.operators import models

    e = spark.read.parquet(folder).select("network", "src", "dst")
    if names is not None:
        e = e.where(F.col("network").isin(*names))
    first = e.agg(F.min("network")).first()[0]
    if not baseline or first is None:
        return e
    own = e.where(F.col("network") == first)
    nodes = own.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    n = nodes.count()
    pairs = models.random_graph(nodes, own.count() / n, seed)
    return e.unionByName(models.symmetric(pairs).select(F.lit("Random (ER)").alias("network"), "src", "dst"))


def read_blocks(spark: SparkSession, population: str, connections: str, probability: str = "fn", count: str = "n") -> tuple[DataFrame, DataFrame]:
    """(blocks, probabilities) of a block model: blocks are numbered in the order
    of their attributes; a connection counts for both directions, the later row
    of a pair winning, and rows with an unknown end go."""
    from pyspark.sql import Window

    pop = read_table(spark, population)
    names = [c for c in pop.columns if c != count]
    blocks = pop.dropDuplicates(names).select((F.row_number().over(Window.orderBy(*names)) - 1).alias("block"), *names, F.col(count).cast("long").alias("n"))
    links = read_table(spark, connections).withColumn("_row", F.monotonically_increasing_id())
    for suffix, side in (("_src", "i"), ("_dst", "j")):
        b = blocks.select(F.col("block").alias(side), *(F.col(c).alias(f"_{c}") for c in names))
        match = F.lit(True)
        for c in names:
            match = match & F.col(c + suffix).eqNullSafe(F.col(f"_{c}"))
        links = links.join(b, match).drop(*(f"_{c}" for c in names))
    p = links.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col(probability).cast("double").alias("p"), "_row")
    return blocks, p.groupBy("i", "j").agg(F.max_by("p", "_row").alias("p"))
