"""Totals of large inverse probabilities, against the SQL's casts."""

import random

import duckdb
import pytest

from tallygraph.operators import estimators
from tallygraph.plans import catalogue


@pytest.mark.parametrize("size", [1e3, 1e10, 1e14, 1e16, 1e21])
def test_totals_agree_with_sql(spark, size):
    draw = random.Random(4)
    table = [(i, draw.randrange(1, int(size)) / draw.choice((1, 2, 4))) for i in range(300)]
    n = 20_000 if size < 1e20 else 3
    table = table if size < 1e20 else [(0, 7e17 / 3), (1, 1e18)]
    ours = estimators.summary(spark.createDataFrame(table, "est long, inv_p double"), n, 16.0).first()
    con = duckdb.connect()
    con.execute("create table f (est bigint, inv_p double)")
    con.executemany("insert into f values (?, ?)", table)
    assert tuple(ours) == con.execute(catalogue.summed("f", n, 16.0)).fetchone()


def test_total_of_nothing(spark):
    assert tuple(estimators.summary(spark.createDataFrame([], "est long, inv_p double"), 10).first()) == (10, 0, 0, 0.0)
