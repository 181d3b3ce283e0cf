import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from popweave.operators.outcomes import parse_runs
from popweave.sources import batches, sinks, tables
from popweave.streaming import resume


def test_layers_statistics_and_tasks(spark, tmp_path):
    spark.createDataFrame([("x", "y", 3), ("x", "x", 0)], "g_src string, g_dst string, n long").coalesce(1).toPandas().to_csv(tmp_path / "interactions_g.csv", index=False)
    t = tables.read_layers(spark, str(tmp_path))
    assert {r.partition for r in t.collect()} == {"g"}
    assert tables.read_interactions(spark, str(tmp_path / "interactions_g.csv"), ["g"]).count() == 1
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "a_stats.json").write_text(json.dumps({"nodes": 5, "params": "scale=0.1_reciprocity=1"}))
    s = tables.read_statistics(spark, str(tmp_path)).first()
    assert s.folder == "run1" and s.filename == "a_stats.json"
    assert tables.read_tasks(spark, [str(tmp_path / "interactions_g.csv"), str(tmp_path / "none.csv")]).count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.unknown")


def test_run_vectors(spark):
    t = spark.createDataFrame([('"1, 2,3"',), ("",)], "v string")
    assert [r[0] for r in t.select(parse_runs("v")).collect()] == [[1, 2, 3], []]


def test_assignment_json(spark, tmp_path):
    a = spark.createDataFrame([(1, 0), (2, 1)], "node_id long, community int")
    sinks.write_assignment(a, f"{tmp_path}/c", as_json=True)
    back = tables.read_assignment(spark, f"{tmp_path}/c")
    assert sorted(map(tuple, back.collect())) == [(1, 0), (2, 1)]
    assert tables.unassigned(spark.range(4).toDF("node_id"), back).count() == 2


def test_resume_skips_what_is_done(spark, tmp_path):
    path = f"file://{tmp_path}/sweep"
    configs = spark.range(8).toDF("config")
    ran = []

    def run(part):
        ran.extend(r.config for r in part.collect())
        return part.withColumn("out", F.col("config") * 2)

    resume.append_results(run(configs.where("config < 3")), path, ["config"])
    resume.run_in_batches(configs, path, ["config"], run, 3)
    resume.run_in_batches(configs, path, ["config"], run, 3)
    assert sorted(ran) == list(range(8)) and spark.read.parquet(path).count() == 8


def test_stream_replay_adds_nothing(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(5).toDF("config").write.parquet(source)
    stream = spark.readStream.schema("config long").parquet(source)
    for n in (1, 2):
        resume.append_stream(stream, path, f"file://{tmp_path}/check{n}", ["config"]).awaitTermination()
    assert spark.read.parquet(path).count() == 5


def test_exports(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    sinks.write_edge_list(edges, f"{tmp_path}/e")
    sinks.write_matrix_market(edges, 3, f"{tmp_path}/m")
    assert {r.value for r in spark.read.text(f"{tmp_path}/e").collect()} == {"0 1", "1 2"}
    assert spark.read.text(f"{tmp_path}/m/header").count() == 2


def test_two_writers_leave_each_configuration_once(spark, tmp_path, monkeypatch):
    """A second worker publishes while the first one's batch is staged; overlapping, not equal."""
    path = f"file://{tmp_path}/sweep"
    rows = lambda a, b, who: spark.range(a, b).select(F.col("id").alias("config"), F.lit(who).alias("who"), F.explode(F.array(F.lit(1), F.lit(2))).alias("part"))
    publish, once = batches.publish, iter([True])

    def beaten(*args):
        if next(once, False):
            monkeypatch.setattr(batches, "publish", publish)
            assert resume.append_results(rows(3, 9, "second"), path, ["config"]) == 1
        return publish(*args)

    monkeypatch.setattr(batches, "publish", beaten)
    assert resume.append_results(rows(0, 6, "first"), path, ["config"]) == 2
    got = resume.read_results(spark, path)
    assert sorted((r.config, r.who, r.part) for r in got.collect()) == [(c, "first" if c < 3 else "second", p) for c in range(9) for p in (1, 2)]
    assert got.columns == ["config", "who", "part"]
    # Replayed, nothing is added; nothing staged is left.
    assert resume.append_results(rows(0, 6, "again"), path, ["config"]) == 0
    assert sorted(x.name for x in (tmp_path / "sweep").iterdir()) == ["_batch=00000001", "_batch=00000002"]


def test_writers_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/sweep"
    work = lambda k: resume.append_results(spark.range(k, k + 6).toDF("config").withColumn("who", F.lit(k)), path, ["config"])
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(work, [0, 2, 4, 0]))
    assert sorted(r.config for r in resume.read_results(spark, path).collect()) == list(range(10))
    assert sorted(n for n in numbers if n) == list(range(1, len([n for n in numbers if n]) + 1))


def test_failed_batch_leaves_the_table_as_it_was(spark, tmp_path):
    path = f"file://{tmp_path}/sweep"
    resume.append_results(spark.range(3).toDF("config"), path, ["config"])
    broken = spark.range(2, 5).select(F.when(F.col("id") > 3, F.raise_error("no")).otherwise(F.col("id")).cast("long").alias("config"))
    with pytest.raises(Exception, match="no"):
        resume.append_results(broken, path, ["config"])
    assert resume.read_results(spark, path).count() == 3 and len(list((tmp_path / "sweep").iterdir())) == 1


def test_edge_batches_go_on_after_an_interruption(spark, tmp_path):
    path = f"file://{tmp_path}/edges"
    made = []

    def parts(fail=None):
        for i in range(3):
            if i == fail:
                raise RuntimeError("lost")
            made.append(i)
            yield spark.range(5).select((F.col("id") + 10 * i).alias("u"), F.lit(i).cast("long").alias("v"))

    with pytest.raises(RuntimeError):
        sinks.append_edges(parts(fail=2), path)
    for _ in range(2):
        assert sinks.append_edges(parts(), path, resume=True) == 3
        assert sorted(r.source for r in sinks.read_edges(spark, path).collect()) == [10 * i + k for i in range(3) for k in range(5)]
    assert sinks.append_edges(parts(), path) == 3 and sinks.read_edges(spark, path).count() == 15
