import pytest
from pyspark.sql import functions as F

from popweave.operators import population, targets

POP = [("18-25", "M", 100), ("18-25", "F", 105), ("26-35", "M", 80), ("26-35", "F", 85)]
LINKS = [("18-25", "M", "18-25", "F", 50), ("18-25", "F", "26-35", "M", 30), ("26-35", "M", "26-35", "F", 40)]


@pytest.fixture
def pop(spark):
    return spark.createDataFrame(POP, "age_group string, gender string, n long")


@pytest.fixture
def links(spark):
    return spark.createDataFrame(LINKS, "age_group_src string, gender_src string, age_group_dst string, gender_dst string, n long")


def test_allocation_follows_the_published_rule(pop):
    g = population.allocate_groups(population.groups(pop), 0.5)
    assert {(r.age_group, r.gender): r.n_scaled for r in g.collect()} == {("18-25", "M"): 50, ("18-25", "F"): 53, ("26-35", "M"): 40, ("26-35", "F"): 42}


def test_nodes_are_dense_and_contiguous(pop):
    nodes = population.expand_nodes(population.allocate_groups(population.groups(pop), 0.5))
    spans = nodes.groupBy("age_group", "gender").agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in spans) == 185 and all(r.b - r.a + 1 == r.n for r in spans)
    assert {(r.age_group, r.gender): r.a for r in spans}[("18-25", "F")] == 0


def test_link_targets(spark, pop, links):
    g = population.groups(pop)
    pairs = targets.pair_counts(targets.with_group_ids(links, population.lookup(g, ["age_group", "gender"]), ["age_group", "gender"]))
    assert sorted(r.target for r in targets.link_targets(pairs, 0.5).collect()) == [15, 20, 25]


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], "a string, n long")
    assert population.expand_nodes(population.allocate_groups(population.groups(empty), 1.0)).count() == 0
    some = spark.createDataFrame([("x", None), (None, 3)], "a string, n long")
    assert population.expand_nodes(population.allocate_groups(population.groups(some), 1.0)).count() == 3
    assert population.find_nodes(population.expand_nodes(population.allocate_groups(population.groups(some), 1.0)), a=None).count() == 3


def test_doubles_not_decimals(spark):
    one = spark.createDataFrame([("x", 100)], "a string, n long")
    assert population.allocate_groups(population.groups(one), 0.29).first().n_scaled == int(0.29 * 100)


def test_unknown_groups_and_nulls_in_links(spark):
    pop = spark.createDataFrame([("x", 2), (None, 2)], "a string, n long")
    links = spark.createDataFrame([("x", None, 5), ("x", "gone", 7)], "a_src string, a_dst string, n long")
    known = population.lookup(population.groups(pop), ["a"])
    assert [r.n for r in targets.with_group_ids(links, known, ["a"]).collect()] == [5]


def test_brackets(spark):
    ages = spark.createDataFrame([(0,), (4,), (5,), (99,), (100,), (119,)], "age int")
    assert [r[0] for r in ages.select(population.five_year_bracket(F.col("age"))).collect()] == ["[0,5)", "[0,5)", "[5,10)", "[95,100)", "[100,120]", "[100,120]"]
