import struct

import pytest

from tallygraph.sources import binary, generators, text
from tallygraph.streaming import estimation

EDGES = [(0, 1, 5), (2, 1, 78), (4294967295, 7, 0)]


def test_edgelist(spark, tmp_path):
    df = spark.createDataFrame(EDGES, "src long, dst long, weight long").repartition(3)
    text.write_edgelist(df, str(tmp_path / "e"), 5, True)
    assert sorted(map(tuple, text.read_edgelist(spark, str(tmp_path / "e"), True).collect())) == sorted(EDGES)
    (tmp_path / "one").write_text("5 2\n0 1\n3 4\n")
    assert sorted(map(tuple, text.read_edgelist(spark, str(tmp_path / "one")).collect())) == [(0, 1), (3, 4)]


def test_binary(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(b"".join(struct.pack("<III", *e) for e in EDGES))
    assert sorted(map(tuple, binary.read_biedgelist(spark, str(tmp_path / "b.bin"), True).collect())) == sorted(EDGES)
    df = spark.createDataFrame(EDGES, "src long, dst long, weight long")
    binary.write_biedgelist(df, str(tmp_path / "w"))
    assert sorted(map(tuple, binary.read_biedgelist(spark, str(tmp_path / "w")).collect())) == sorted(e[:2] for e in EDGES)
    (tmp_path / "bad.bin").write_bytes(b"12345")
    with pytest.raises(ValueError):
        binary.read_biedgelist(spark, str(tmp_path / "bad.bin"))


def test_meta_snap_and_partitions(spark, tmp_path):
    text.write_meta(spark, str(tmp_path / "m"), 7115, 9)
    assert text.read_meta(spark, str(tmp_path / "m")).first()[0] == 7115
    (tmp_path / "snap").write_text("# Nodes: 3 Edges: 2\n# From To\n1\t2\n3 4\nx y\n")
    assert sorted(map(tuple, text.read_snap(spark, str(tmp_path / "snap")).collect())) == [(1, 2), (3, 4)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "0").write_text("9 2\n0 1\n0 2\n")
    (tmp_path / "p" / "1").write_text("9 1\n5 0\n")
    assert sorted(map(tuple, text.read_partitions(spark, str(tmp_path / "p")).collect())) == [(0, 1, "0"), (0, 2, "0"), (5, 0, "1")]


@pytest.mark.parametrize("slices", [1, 3])
def test_partition_files_are_read_as_written(spark, tmp_path, slices):
    edges = [(i, (i * 7 + 3) % 40) for i in range(40)]
    text.write_partitions(spark.createDataFrame(edges, "src long, dst long"), str(tmp_path / "p"), 4, 40, slices)
    want = {(a, b) for x, y in edges for a, b in ((x, y), (y, x)) if a != b}
    rows = text.read_partitions(spark, str(tmp_path / "p")).collect()
    assert sorted((r.u, r.v) for r in rows) == sorted(want)
    assert {(r.u // 10, r.file.split("/")[0]) for r in rows} == {(k, f"part={k}") for k in range(4)}
    for file in (tmp_path / "p").rglob("*.txt"):
        lines = [tuple(map(int, x.split())) for x in file.read_text().splitlines()]
        assert lines[0] == (40, len(lines) - 1) and lines[1:] == sorted(lines[1:])


def test_header_check(spark, tmp_path):
    (tmp_path / "good").write_text("5 2\n0 1\n3 4\n")
    (tmp_path / "bad").write_text("5 3\n0 1\n3 4\n")
    (tmp_path / "none").write_text("")
    assert tuple(text.check_header(spark, str(tmp_path / "good")).first()) == (5, 2, 2, True)
    assert tuple(text.check_header(spark, str(tmp_path / "bad")).first()) == (5, 3, 2, False)
    assert tuple(text.check_header(spark, str(tmp_path / "none")).first()) == (None, None, 0, False)


def test_generator(spark):
    g = generators.random_graph(spark, 10, 1000, 4)
    assert g.count() == 45 and generators.duplicates(g).count() == 0
    w = [r.weight for r in generators.with_weights(g).collect()]
    assert all(0 <= x <= 78 for x in w) and len(set(w)) > 10


def test_running_estimate_over_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 4.0), (2, 0.0)], "est long, inv_p double").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("est long, inv_p double").parquet(str(tmp_path / "in"))
    q = estimation.start(stream, str(tmp_path / "cp"), lambda df, _: seen.extend(df.collect()))
    q.processAllAvailable()
    spark.createDataFrame([(3, 8.0)], "est long, inv_p double").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert seen[-1].n == 3 and seen[-1].mean == 4.0
