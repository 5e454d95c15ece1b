"""Queries over all of lineitem, against brute force and their SQL on a small table."""

import itertools
import random

import duckdb
import pytest

from tallygraph.plans import catalogue, pattern
from tests.graphs import count
from tests.test_entry import plain

PATTERNS = {"exact_triangle": pattern.TRIANGLE, "exact_four_chain": pattern.FOUR_CHAIN, "exact_five_chain": pattern.FIVE_CHAIN, "exact_four_clique": pattern.FOUR_CLIQUE, "exact_five_house": pattern.HOUSE, "exact_four_cycle": pattern.cycle(4)}
CHECKED = ["build_edges", "edge_shuffle_ids", "graph_stats", "dense_relabel", "vertex_permutation", "weighted_all", "est_triangle", "est_weighted_all", "vertex_sample_triangle", "adjacency_export"]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """(folder, edges): 20 orders of 3 of 12 parts, keys 1 to 20."""
    rng, sf = random.Random(9), str(tmp_path_factory.mktemp("shop"))
    orders = [(o, rng.sample(range(1, 13), 3)) for o in range(1, 21)]
    lines = [(o, p, float(rng.randint(1, 50))) for o, parts in orders for p in parts]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").coalesce(1).write.parquet(f"{sf}/lineitem.parquet")
    return sf, {tuple(sorted(e)) for _, parts in orders for e in itertools.combinations(parts, 2)}


def by_sql(shop, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{shop[0]}/lineitem.parquet/*.parquet')")
    return con.execute(catalogue.ORACLES[name])


@pytest.mark.parametrize("name", PATTERNS)
def test_counts_of_all_orders(spark, shop, name):
    """Both engines' closed forms against enumeration."""
    sf, edges = shop
    want = count(edges, PATTERNS[name])
    assert catalogue.QUERIES[name](spark, sf).first()[0] == want > 0
    assert by_sql(shop, name).fetchall() == [(want,)]


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql_on_all_orders(spark, shop, name):
    ours, theirs = catalogue.QUERIES[name](spark, shop[0]), by_sql(shop, name)
    names = [d[0] for d in theirs.description]
    assert plain(ours.select(*sorted(names)).collect()) == plain(theirs.df()[sorted(names)].itertuples(index=False))


def test_no_query_thins_its_table():
    assert not [n for n, sql in catalogue.ORACLES.items() if "l_orderkey %" in sql]
