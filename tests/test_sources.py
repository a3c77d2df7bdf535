"""Round trips of the file formats."""

import numpy as np
import pytest

from lattica.sources import binary as B
from lattica.sources import text as T

TRI = [(0, 0, 2.0), (1, 0, -1.0), (0, 1, -1.0), (1, 1, 2.0), (2, 1, -1.0), (1, 2, -1.0), (2, 2, 2.0), (3, 2, -1.0), (2, 3, -1.0), (3, 3, 2.0)]


@pytest.fixture(scope="module")
def tri(spark):
    return spark.createDataFrame(TRI, "i long, j long, v double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csc_by_hand(spark, tmp_path):
    f = tmp_path / "a.cus"
    with open(f, "wb") as h:
        np.array([4, 4, 10, 1, 3, 6, 9, 11, 1, 2, 1, 2, 3, 2, 3, 4, 3, 4], "<i4").tofile(h)
        np.array([2, -1, -1, 2, -1, -1, 2, -1, -1, 2], "<f4").tofile(h)
    assert rows(B.read_matrix(spark, str(f))) == sorted(TRI)
    assert rows(B.read_matrix(spark, str(f), entries=3)) == sorted(TRI)
    assert rows(B.read_matrix(spark, str(f), first_row=1, last_row=3)) == sorted(x for x in TRI if 1 <= x[0] < 3)
    assert B.read_header(str(f)) == (4, 4, 10)


@pytest.mark.parametrize("layout,base,index", [("csc", 1, "int32"), ("csr", 0, "int32"), ("csr", 1, "float64")])
def test_binary_round_trip(spark, tri, tmp_path, layout, base, index):
    f = str(tmp_path / "m.bin")
    B.write_matrix(tri, f, 4, 4, layout, base, index)
    assert rows(B.read_matrix(spark, f, layout=layout, base=base, index=index, entries=4)) == sorted(TRI)


def test_bad_index_is_refused(spark, tri, tmp_path):
    f = str(tmp_path / "m.bin")
    B.write_matrix(tri, f, 4, 4, "csr", 1)
    with pytest.raises(Exception, match="outside"):
        B.read_matrix(spark, f, layout="csr", base=2).collect()


def test_matrix_market(spark, tri, tmp_path):
    T.write_matrix_market(tri, str(tmp_path / "m.mtx"), 4, 4)
    a, r, c, s = T.read_matrix_market(spark, str(tmp_path / "m.mtx"))
    assert (r, c, s) == (4, 4, "general") and rows(a) == sorted(TRI)
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% c\n2 3 1\n2 1\n")
    a, r, c, s = T.read_matrix_market(spark, str(tmp_path / "p.mtx"))
    assert (r, c, s) == (2, 3, "lower") and rows(a) == [(1, 0, 1.0)]
    with pytest.raises(ValueError, match="square"):
        T.read_graph(spark, str(tmp_path / "p.mtx"))


def test_graph_files(spark, tmp_path):
    want = [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)]
    (tmp_path / "g.dg").write_text("3 3\n1 1 2 4\n1\n1 2\n")
    (tmp_path / "g.dot").write_text("digraph G {\n0 -> 1;\n 0 -> 2 ;\n1->2 [weight=1];\n}\n")
    (tmp_path / "g.fab").write_text("0: 1 2 # out\n1: 2\n")
    for name in ("g.dg", "g.dot", "g.fab"):
        assert rows(T.read_graph(spark, str(tmp_path / name))) == want, name
    e = T.read_graph(spark, str(tmp_path / "g.fab"))
    for name in ("h.dot", "h.bin"):
        T.write_graph(e, str(tmp_path / name))
        assert rows(T.read_graph(spark, str(tmp_path / name))) == want


def test_tasks_parts_boundaries(spark, tmp_path):
    t = spark.createDataFrame([(0, 2, [1, 2, 3], ["a"], 7, 0, 1), (1, 5, [], [], 8, 1, 0)], T.TASKS)
    T.write_tasks(t, str(tmp_path / "t"))
    assert rows(T.read_tasks(spark, str(tmp_path / "t"))) == rows(t)
    p = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "id long, part int")
    T.write_parts(p, str(tmp_path / "p"))
    assert rows(T.read_parts(spark, str(tmp_path / "p"))) == rows(p)
    T.write_boundaries(spark, [3, 9], str(tmp_path / "b"))
    assert T.read_boundaries(spark, str(tmp_path / "b")) == [3, 9]
    assert T.result_lines([2.0], [0.5, 1.5]) == ["0.5000,1.5000,1.0000", "2.0000"]
