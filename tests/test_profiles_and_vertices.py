import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.operators import estimators, profiles, vertex_sampling
from tallygraph.plans.graph import Graph
from tests.graphs import random_edges


@pytest.fixture(scope="module")
def medium(spark):
    return Graph.from_edges(spark.createDataFrame(random_edges(40, 300, 8), "src long, dst long")).persist()


def test_regression_passes_through_the_origin(spark):
    df = spark.createDataFrame([(1.0, 2.1), (2.0, 3.9), (3.0, 6.2)], "x double, y double")
    k = df.agg(profiles.regression_through_origin(F.col("x"), F.col("y"))).first()[0]
    assert abs(k - (2.1 + 7.8 + 18.6) / 14) < 1e-12


def test_moving_average_starts_high():
    got = profiles.moving_average(np.zeros(3))
    assert np.allclose(got, [96.0, 92.16, 88.4736])


def test_error_profile_and_time(medium):
    n = profiles.ErrorProfile(pattern_edges=2, rate=0.5, points=64, more=4096).num_estimators(medium, estimators.wedge, 0.1, 0.9)
    assert n > 0
    assert profiles.within_time(medium, estimators.wedge, 0.5, 3, 256).n >= 256


def test_sampling_every_vertex_gives_the_exact_count(medium):
    from tallygraph.operators import exact

    rows = vertex_sampling.estimates(medium, "triangle", 10_000, 2, 1).collect()
    assert {r.found for r in rows} == {exact.triangles(medium).first()[0]}
    assert {r.estimate for r in rows} == {float(rows[0].found)}


def test_stopping_rules():
    assert vertex_sampling.interval_stop([5.0] * 50)[0] == 10
    assert vertex_sampling.interval_stop([1.0, 100.0] * 10)[0] == 20
    t, mean = vertex_sampling.bernstein_stop([5.0] * 10_000, 1.0)
    assert t < 10_000 and abs(mean - 5) < 0.5


def test_interval_rule_agrees_with_the_loop(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in rng.normal(50, 12, 200)]
    df = spark.createDataFrame(list(enumerate(values)), "rep long, estimate double")
    first = vertex_sampling.interval_rule(df).where("stop").agg(F.min("t")).first()[0]
    assert first == vertex_sampling.interval_stop(values)[0]


def test_quantiles_of_any_alpha():
    assert [vertex_sampling.normal_quantile(a) for a in (0.2, 0.1, 0.05, 0.02, 0.01)] == [1.282, 1.645, 1.96, 2.326, 2.576]
    assert vertex_sampling.normal_quantile(0.03) == 2.17
    with pytest.raises(ValueError):
        vertex_sampling.normal_quantile(0)


def test_the_cut_keeps_the_smallest_draws(spark):
    """Against a rank of all draws, with a cut and with too few vertices for one."""
    from tallygraph.functions import rng

    g = Graph.from_edges(spark.createDataFrame([(i, i + 1) for i in range(500)], "src long, dst long")).persist()
    for m in (5, 100, 480):
        got = vertex_sampling.sampled_vertices(g, m, 4, 9, first=2).collect()
        drawn = g.vertices().crossJoin(spark.range(2, 6).withColumnRenamed("id", "rep")).select("rep", "v", rng.draw(9, "rep", "v").alias("r")).collect()
        want = {(rep, v) for rep in range(2, 6) for _, v in sorted((x.r, x.v) for x in drawn if x.rep == rep)[:m]}
        assert {(x.rep, x.v) for x in got} == want and len(got) == 4 * m


def test_batches_are_the_replicates_in_order(medium):
    whole = [r.estimate for r in vertex_sampling.estimates(medium, "wedge", 12, 13, 3).orderBy("rep").collect()]
    assert list(vertex_sampling.drawn_in_batches(medium, "wedge", 12, 3, 5, 13)) == whole
