"""The views as a declared graph: found order, dry run without jobs, same rows as one after another."""

import pytest
from pyspark import pipelines
from pyspark.sql import functions as F

from contestlab.operators.quality import digest
from contestlab.plans import graph as G
from contestlab.plans.views import ORDER, Views, refresh
from contestlab.model import from_star

DATA = "/root/testdata/sf0.001"


def small(spark, **views):
    graph = G.ViewGraph(spark)
    with graph.defining():
        for name, query in views.items():
            pipelines.materialized_view(name=name)(query)
    return graph


def test_dry_run_finds_order_and_schema_without_a_job(spark):
    graph, tracker = G.define_views(spark, from_star(spark, DATA)), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dry", "dry run")
    plan = graph.dry_run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup("dry")
    assert set(plan) == set(ORDER) and {"wide"} < set(plan["priority"].reads) and plan["result_candidate"].reads == []
    places = {n: i for i, n in enumerate(plan)}
    assert all(places[r] < places[n] for n, node in plan.items() for r in node.reads)
    views = Views(from_star(spark, DATA))
    assert all(plan[n].schema.simpleString() == views[n].schema.simpleString() for n in ORDER)


def test_run_equals_refresh(spark, tmp_path):
    data = from_star(spark, DATA)
    took = G.define_views(spark, data).run(str(tmp_path / "graph"))
    refresh(Views(data), str(tmp_path / "one"))
    assert set(took) == set(ORDER)
    for name in ORDER:
        a, b = (digest(spark.read.parquet(f"{tmp_path}/{where}/{name}")).first() for where in ("graph", "one"))
        assert a == b, name


def test_only_what_is_needed(spark, tmp_path):
    graph = small(spark, a=lambda: spark.range(3), b=lambda: G.read("a").withColumn("x", F.col("id") * 2), c=lambda: G.read("b").join(G.read("a"), "id"), d=lambda: spark.range(9))
    assert set(graph.run(str(tmp_path), ["b"])) == {"a", "b"}
    assert set(graph.run(str(tmp_path))) == {"a", "b", "c", "d"} and spark.read.parquet(f"{tmp_path}/c").count() == 3


def test_wrong_graphs(spark, tmp_path):
    with pytest.raises(G.GraphError, match="ring: a -> b -> a"):
        small(spark, a=lambda: G.read("b"), b=lambda: G.read("a")).dry_run()
    with pytest.raises(G.GraphError, match="reads none"):
        small(spark, a=lambda: G.read("none")).dry_run()
    with pytest.raises(G.GraphError, match="outside"):
        G.read("a")
    with pytest.raises(G.GraphError, match="isn't defined"):
        small(spark, a=lambda: spark.range(1)).run(str(tmp_path), ["b"])
    graph = G.ViewGraph(spark)
    with graph.defining(), pytest.raises(G.GraphError, match="no materialized view"):
        pipelines.temporary_view(name="t")(lambda: spark.range(1))
    with graph.defining(), pytest.raises(G.GraphError, match="twice"):
        for _ in range(2):
            pipelines.materialized_view(name="t")(lambda: spark.range(1))
    with pytest.raises(Exception, match="nothing"):
        small(spark, a=lambda: spark.range(1).select("nothing")).dry_run()


def test_a_failure_stops_what_reads_it(spark, tmp_path):
    graph = small(spark, a=lambda: spark.range(3).withColumn("x", F.raise_error(F.lit("broken"))), b=lambda: G.read("a"), c=lambda: spark.range(5))
    with pytest.raises(Exception, match="broken"):
        graph.run(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/c").count() == 5 and not (tmp_path / "b").exists()
