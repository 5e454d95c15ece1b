"""The contract, and queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tallygraph.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CHECKED = ["build_edges", "degree_histogram", "dense_relabel", "vertex_permutation", "sampled_graph_stats", "adjacency_export", "exact_four_clique", "weighted_any", "est_triangle", "est_generated_triangle", "est_chain_four", "vertex_sample_wedge", "ie_stop"]


def plain(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).first()[0] == 125_968


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    ours = catalogue.QUERIES[name](spark, SF)
    theirs = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert plain(ours.select(*sorted(names)).collect()) == plain(theirs.df()[sorted(names)].itertuples(index=False))
