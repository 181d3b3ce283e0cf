"""Structure of directed graphs: edges (src, dst) without loops or repeats, nodes (node_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from popweave.functions.rng import uniform
from popweave.operators.sampling import numbered, smallest
from popweave.sources.scratch import drop, scoped, stored


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, in_degree, out_degree and degree of every node, isolates too.

    One shuffle of edge ends, summed before it: hubs cost no more than others.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    sums = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    d = nodes.select("node_id").join(sums, "node_id", "left").na.fill(0, ["in_degree", "out_degree"])
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_summary(degrees_: DataFrame, column: str = "degree") -> DataFrame:
    """One row: mean, std (population), min, median, q90, max, skew (population) and zeros."""
    d = F.col(column).cast("double")
    return degrees_.agg(
        F.avg(d).alias("mean"),
        F.stddev_pop(d).alias("std"),
        F.min(column).alias("min"),
        F.percentile(d, F.lit(0.5)).alias("median"),
        F.percentile(d, F.lit(0.9)).alias("q90"),
        F.max(column).alias("max"),
        F.skewness(d).alias("skew"),
        F.count_if(F.col(column) == 0).alias("zeros"),
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Each linked pair once, u < v."""
    return edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u <> v").distinct()


def reciprocity(edges: DataFrame) -> DataFrame:
    """One row: n_edges, n_mutual and their ratio (0 without edges)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    mutual = edges.join(back, ["src", "dst"], "left_semi")
    n = edges.agg(F.count("*").alias("n_edges")).crossJoin(F.broadcast(mutual.agg(F.count("*").alias("n_mutual"))))
    return n.withColumn("reciprocity", F.when(F.col("n_edges") > 0, F.col("n_mutual") / F.col("n_edges")).otherwise(0.0))


def triangles(pairs: DataFrame) -> DataFrame:
    """(u, v, w) of every triangle of an undirected graph.

    Pairs are directed from lower to higher degree, so no node has more than
    the square root of twice the edges going out, and wedges stay near linear
    on skewed graphs; each wedge then looks for its closing edge.
    """
    both = pairs.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("k"))
    d = pairs.join(both.select(F.col("x").alias("u"), F.col("k").alias("ku")), "u").join(both.select(F.col("x").alias("v"), F.col("k").alias("kv")), "v")
    up = (F.col("ku") < F.col("kv")) | ((F.col("ku") == F.col("kv")) & (F.col("u") < F.col("v")))
    out = d.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = out.join(out.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = wedge.join(pairs.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"], "left_semi")
    return closed.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("c").alias("w"))


def transitivity(edges: DataFrame) -> DataFrame:
    """One row: n_triangles, n_triples and transitivity of the undirected simple graph."""
    pairs = undirected(edges)
    k = pairs.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("k"))
    triples = k.agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("n_triples"))
    t = triangles(pairs).agg(F.count("*").alias("n_triangles")).crossJoin(F.broadcast(triples))
    return t.withColumn("transitivity", F.when(F.col("n_triples") > 0, 3 * F.col("n_triangles") / F.col("n_triples")).otherwise(0.0))


def local_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, k and clustering (null below two neighbours)."""
    pairs = undirected(edges)
    k = pairs.select(F.explode(F.array("u", "v")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("k"))
    t = triangles(pairs).select(F.explode(F.array("u", "v", "w")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("t"))
    out = nodes.select("node_id").join(k, "node_id", "left").join(t, "node_id", "left").na.fill(0, ["k", "t"])
    return out.select("node_id", "k", F.when(F.col("k") > 1, 2 * F.col("t") / (F.col("k") * (F.col("k") - 1))).alias("clustering"))


def average_clustering(nodes: DataFrame, edges: DataFrame, skip_small: bool = False) -> DataFrame:
    """Mean local clustering; nodes below two neighbours are left out or count as 0."""
    c = local_clustering(nodes, edges)
    value = F.col("clustering") if skip_small else F.coalesce("clustering", F.lit(0.0))
    return c.agg(F.avg(value).alias("clustering"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density E / N(N-1) and mean_degree E / N."""
    n = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))
    most = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return n.select("*", F.when(most > 0, F.col("n_edges") / most).otherwise(0.0).alias("density"), F.when(F.col("n_nodes") > 0, F.col("n_edges") / F.col("n_nodes")).otherwise(0.0).alias("mean_degree"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the source's out-degree and the destination's in-degree over edges."""
    o = edges.groupBy("src").agg(F.count("*").cast("double").alias("o"))
    i = edges.groupBy("dst").agg(F.count("*").cast("double").alias("i"))
    return edges.join(o, "src").join(i, "dst").agg(F.corr("o", "i").alias("assortativity"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Q of an undirected partition (node_id, community): share inside minus (degree share) squared."""
    pairs = undirected(edges)
    side = lambda end: membership.select(F.col("node_id").alias(end), F.col("community").alias(f"c{end}"))
    e = pairs.join(side("u"), "u").join(side("v"), "v")
    ends = e.select(F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    total = e.agg(F.count("*").alias("m"), F.count_if(F.col("cu") == F.col("cv")).alias("inside"))
    squares = ends.agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("dd"), F.count("*").alias("n_communities"))
    q = F.col("inside") / F.col("m") - F.col("dd") / (4.0 * F.col("m") * F.col("m"))
    return total.crossJoin(F.broadcast(squares)).select("n_communities", q.alias("modularity"))


@scoped
def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest id of each weakly connected component.

    Smallest labels spread over edges, then jump to their own label, so
    distances halve; each round is a stored table.
    """
    pairs = stored(undirected(edges).select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("p")).select("p.*"), "pairs")
    labels = stored(nodes.select("node_id", F.col("node_id").alias("component")), "labels")
    while True:
        near = pairs.join(labels.select(F.col("node_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("node_id")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node_id", "left").select("node_id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        up = labels.select(F.col("node_id").alias("component"), F.col("component").alias("up"))
        moved = stored(moved.join(up, "component").select("node_id", "was", F.least("component", "up").alias("component")), "labels")
        drop(labels)
        labels = moved.select("node_id", "component")
        if moved.where("was <> component").isEmpty():
            return labels


@scoped
def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node_id, community): each round all nodes take their neighbours' most
    frequent label, the smaller if equal, their own counting once too.

    Ends when no label changes, or all labels are those of two rounds before:
    links are symmetric, so rounds run into one of the two. ``rounds`` stops earlier.

    A node whose own and whose neighbours' labels are those of two rounds before takes what it took in the
    round before. So once one node in eight moves at most, only the others' links are joined.
    """
    pairs = stored(undirected(edges).select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("p")).select("p.*"), "pairs")
    kind = nodes.schema["node_id"].dataType
    labels = stored(nodes.select("node_id", F.col("node_id").alias("community"), F.lit(None).cast(kind).alias("was"), F.lit(True).alias("moved")), "labels")
    done, few = 0, False
    while rounds is None or done < rounds:
        links, own, touched = pairs, labels, None
        if few:
            moved = labels.where("moved").select("node_id")
            touched = stored(pairs.join(moved.withColumnRenamed("node_id", "b"), "b").select(F.col("a").alias("node_id")).union(moved).distinct(), "touched")
            links = pairs.join(touched.withColumnRenamed("node_id", "a"), "a", "left_semi")
            own = labels.join(touched, "node_id", "left_semi")
        seen = links.join(labels.select(F.col("node_id").alias("b"), "community"), "b").select(F.col("a").alias("node_id"), "community")
        # By nodes at once: both sums go without another shuffle.
        n = seen.unionByName(own.select("node_id", "community")).repartition("node_id").groupBy("node_id", "community").agg(F.count("*").alias("n"))
        best = n.groupBy("node_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b")).select("node_id", F.col("b.community").alias("next"))
        now = labels.join(best, "node_id", "left" if few else "inner").withColumn("next", F.coalesce("next", "was"))
        now = now.select("node_id", F.col("next").alias("community"), F.col("community").alias("was"), (~F.col("next").eqNullSafe(F.col("was"))).alias("moved"))
        told = Observation()
        now = stored(now.observe(told, F.count("*").alias("n"), F.count_if("moved").alias("moved"), F.count_if(F.col("was") != F.col("community")).alias("changed")), "labels")
        drop(labels, *([touched] if touched else []))
        labels, done, few = now, done + 1, 8 * told.get["moved"] <= told.get["n"]
        if not told.get["moved"] or not told.get["changed"]:
            break
    return labels.select("node_id", "community")


#: Sources that one row's bits tell of.
WORD = 63


def _source_words(sources: DataFrame) -> DataFrame:
    """(source, word, bit): distinct sources by number, WORD of them to a word."""
    own = sources.select(F.col("node_id").alias("source"), F.lit(0).alias("all")).distinct()
    n = numbered(own, ["all"], uniform(42, "word", "source"), ["source"], "_n")
    return n.select("source", F.expr(f"_n div {WORD}").alias("word"), (F.col("_n") % WORD).cast("int").alias("bit"))


def _reached(edges: DataFrame, words: DataFrame, most: int | None, directed: bool) -> DataFrame:
    """(word, node_id, new, distance): the sources of a word, as bits, that reach a node at a distance.

    A round is one row for each node that something new reaches and word, not for each source.
    """
    step = edges.select("src", "dst") if directed else edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    step = stored(step, "steps")
    start = words.groupBy("word", F.col("source").alias("node_id")).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("new"))
    front = stored(start.select("word", "node_id", "new", F.lit(0).alias("distance")), "front")
    seen, found, d = front.select("word", "node_id", F.col("new").alias("seen")), front, 0
    while most is None or d < most:
        d += 1
        near = front.join(step, F.col("node_id") == F.col("src")).groupBy("word", F.col("dst").alias("node_id")).agg(F.bit_or("new").alias("near"))
        known = near.join(seen, ["word", "node_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("long")))
        fresh = known.select("word", "node_id", F.expr("near & ~seen").alias("new"), F.lit(d).alias("distance")).where("new <> 0")
        front = stored(fresh, "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if d % 16 == 0:
            found = stored(found, "found")
        seen = found.groupBy("word", "node_id").agg(F.bit_or("new").alias("seen"))
    return found


@scoped
def distances(edges: DataFrame, sources: DataFrame, most: int | None = None, directed: bool = True) -> DataFrame:
    """(source, node_id, distance) of all that ``sources`` (node_id) reach, by
    breadth-first rounds until nothing new is found, or to distance ``most``."""
    words = stored(_source_words(sources), "words")
    rows = _reached(edges, words, most, directed)
    each = rows.withColumn("bit", F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), b -> (shiftright(new, b) & 1) = 1)")))
    return each.join(words, ["word", "bit"]).select("source", "node_id", "distance")


@scoped
def path_sources(nodes: DataFrame, edges: DataFrame, exact_below: int = 1000, sample: int = 100, seed: int = 42) -> DataFrame:
    """Sources (node_id) of path lengths: below ``exact_below`` nodes all of the
    largest weak component (the smaller label if equal), else ``sample`` drawn nodes."""
    if nodes.count() >= exact_below:
        return stored(smallest(nodes.select("node_id"), uniform(seed, "source", "node_id"), sample, ["node_id"]), "sources")
    c = stored(components(nodes, edges), "components")
    largest = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(largest, "component", "left_semi").select("node_id")


@scoped
def average_path_length(edges: DataFrame, sources: DataFrame, directed: bool = True) -> DataFrame:
    """Mean distance over the pairs reached from ``sources``; unreachable pairs are skipped."""
    rows = _reached(edges, stored(_source_words(sources), "words"), None, directed).where("distance > 0")
    n = F.sum(F.bit_count("new").cast("long"))
    total = F.sum(F.bit_count("new").cast("long") * F.col("distance"))
    return rows.agg((total / n).alias("path_length"), F.coalesce(n, F.lit(0)).cast("long").alias("n_pairs"))


def extract_subgraph(nodes: DataFrame, edges: DataFrame, center: int, max_nodes: int, directed: bool = True) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and induced edges of a breadth-first ball of at most ``max_nodes``.

    The last ring is cut by node id. None if the center has no neighbours;
    ValueError for an unknown center or ``max_nodes`` below one.
    """
    if max_nodes <= 0:
        raise ValueError("max_nodes must be positive")
    if nodes.where(F.col("node_id") == center).isEmpty():
        raise ValueError(f"node {center} is not in the graph")
    reached = distances(edges, nodes.where(F.col("node_id") == center), directed=directed)
    if reached.limit(2).count() < 2:
        return None
    kept = reached.orderBy("distance", "node_id").limit(max_nodes).select("node_id")
    inside = edges.join(kept.withColumnRenamed("node_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)
    return nodes.join(kept, "node_id", "left_semi"), inside


def non_isolates(wanted: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of ``wanted`` (position, node_id) that have an edge."""
    linked = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return wanted.join(linked, "node_id", "left_semi").orderBy("position").limit(most)


@scoped
def metric_bundle(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """One row with reciprocity, transitivity, path length, degree skew, assortativity and modularity."""
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    d = degrees(nodes, edges)
    parts = [
        reciprocity(edges).select("n_edges", "reciprocity"),
        transitivity(edges).select("transitivity"),
        average_path_length(edges, sources).select("path_length"),
        degree_summary(d, "in_degree").select(F.col("skew").alias("in_degree_skew")),
        assortativity(edges),
        modularity(edges, label_propagation(nodes, edges)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


@scoped
def network_table(edges: DataFrame) -> DataFrame:
    """Per network (edges with a column network), all networks in the same jobs:
    n_nodes with an edge, n_edges, mean_degree, degree_skew (population),
    reciprocity, clustering (transitivity of the undirected graph) and modularity
    (of label propagation's communities)."""
    edges = stored(edges.select("network", "src", "dst"), "edges")
    ends = edges.select("network", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("network", "node_id").agg(F.count("*").cast("double").alias("k"))
    d = ends.groupBy("network").agg(F.count("*").alias("n_nodes"), F.avg("k").alias("mean_degree"), F.skewness("k").alias("degree_skew"))
    back = edges.select("network", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back")).distinct()
    r = edges.join(back, ["network", "src", "dst"], "left").groupBy("network").agg(F.count("*").alias("n_edges"), F.avg(F.coalesce("back", F.lit(0))).alias("reciprocity"))
    # A node of one network is another one in the next: ids carry the network's number.
    codes = stored(edges.select("network").distinct().select("network", F.row_number().over(Window.orderBy("network")).alias("code")), "codes")
    of = lambda end: F.struct("code", F.col(end).alias("id")).alias(end)
    keyed = stored(edges.join(codes, "network").select(of("src"), of("dst")), "networks")
    pairs = stored(undirected(keyed), "pairs")
    k = pairs.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("k"))
    triples = k.groupBy(F.col("x.code").alias("code")).agg(F.sum(F.expr("k * (k - 1) div 2")).alias("triples"))
    closed = triangles(pairs).groupBy(F.col("u.code").alias("code")).agg(F.count("*").alias("triangles"))
    c = triples.join(closed, "code", "left").select("code", F.when(F.col("triples") > 0, 3 * F.coalesce("triangles", F.lit(0)) / F.col("triples")).otherwise(0.0).alias("clustering"))
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    q = network_modularity(pairs, label_propagation(nodes, keyed))
    return d.join(r, "network").join(codes, "network").join(c, "code").join(q, "code").drop("code")


def network_modularity(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """(code, modularity) of undirected pairs whose ids carry their network's number."""
    side = lambda end: membership.select(F.col("node_id").alias(end), F.col("community").alias(f"c{end}"))
    e = pairs.join(side("u"), "u").join(side("v"), "v").select(F.col("u.code").alias("code"), "cu", "cv")
    ends = e.select("code", F.explode(F.array("cu", "cv")).alias("c")).groupBy("code", "c").agg(F.count("*").alias("d"))
    squares = ends.groupBy("code").agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("dd"))
    total = e.groupBy("code").agg(F.count("*").alias("m"), F.count_if(F.col("cu") == F.col("cv")).alias("inside"))
    q = F.col("inside") / F.col("m") - F.col("dd") / (4.0 * F.col("m") * F.col("m"))
    return total.join(squares, "code").select("code", q.alias("modularity"))
