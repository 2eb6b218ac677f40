"""Readers on awkward input, and round trips."""

import numpy as np
import pytest

from meshloom import sources
from meshloom.operators import mesh as me
from meshloom.plans import fixtures as fx
from meshloom.sources import binary


def write(path, text):
    path.write_text(text)
    return str(path)


OBJ = """# two good shapes, four bad ones
o first
v 0 0 0
v 1 0 0
v 0 1 0
f 1 2 3
o quad
v 0 0 0
v 1 0 0
v 1 1 0
v 0 1 0
f 4 5 6 7
o nofaces
v 9 9 9
o range
f 1 2 99
o second
v 0 0 1
v 1 0 1
v 0 1 1
f -3/1 -2//4 -1/2/3
f 1 2 3
"""


def test_obj(spark, tmp_path):
    rows = sources.read_obj(spark, write(tmp_path / "a.obj", OBJ)).orderBy("object_id", "tri_id").collect()
    assert [(r["object_id"], r["tri_id"], r["az"], r["bx"], r["cy"]) for r in rows] == [(0, 0, 0.0, 1.0, 1.0), (1, 0, 1.0, 1.0, 1.0), (1, 1, 0.0, 1.0, 1.0)]


def test_obj_over_splits(spark, tmp_path):
    """A file read in many small splits gives what one task would."""
    lines = []
    for k in range(60):
        lines += [f"o c{k}", f"v {k} 0 0", f"v {k} 1 0", f"v {k} 0 1", f"f {3 * k + 1} {3 * k + 2} {3 * k + 3}"]
    path = write(tmp_path / "b.obj", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        rows = sources.read_obj(spark, path).orderBy("object_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["object_id"], r["ax"]) for r in rows] == [(k, float(k)) for k in range(60)]


def test_unknown_extension(spark):
    with pytest.raises(ValueError, match="unsupported"):
        sources.load(spark, "/x/y.stl")


def test_off(spark, tmp_path):
    write(tmp_path / "a.off", "OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    write(tmp_path / "b.off", "OFF|4 2 0|0 0 0|1 0 0|0 1 0|0 0 5|3 0 1 2|3 0 1 3\n")
    rows = sources.read_off(spark, str(tmp_path)).orderBy("object_id", "tri_id").collect()
    assert [(r["object_id"], r["tri_id"], r["cz"]) for r in rows] == [(0, 0, 0.0), (1, 0, 0.0), (1, 1, 5.0)]
    lines = write(tmp_path / "many", "OFF|3 1 0|0 0 0|1 0 0|0 1 0|3 0 1 2\n\nOFF|3 1 0|0 0 7|1 0 0|0 1 0|3 0 1 2\n")
    assert sorted((r["object_id"], r["az"]) for r in sources.read_off_lines(spark, lines).collect()) == [(0, 0.0), (1, 7.0)]
    assert sources.read_off_lines(spark, lines, 1).count() == 1


def test_wkt(spark, tmp_path):
    path = write(tmp_path / "w", "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5), (5 5, 5.5 5, 5 5.5)))\nPOINT (1 1)\nPOLYGON ((0 0, 1 1, 0 0))\n")
    rows = sources.read_wkt_polygons(spark, path).orderBy("part").collect()
    assert [(r["line"], r["part"], len(r["outer"]), len(r["holes"])) for r in rows] == [(0, 0, 3, 0), (0, 1, 4, 1)]


def test_preprocessed_versions(spark, tmp_path):
    v, f, o = np.array(me.BOX_CORNERS, dtype=float), np.array(me.BOX_FACES), np.zeros(12, dtype=int)
    raw = binary.pack(v, f, o, v[:3], v[3:6], np.zeros(3, dtype=int))
    assert len(raw) == 56 + 8 * 12 + 12 * 12 + 12 * 4 + 3 * 28
    old = raw[:4] + (2).to_bytes(4, "little") + raw[8:]
    assert len(binary.unpack(old)["starts"]) == 0
    assert len(binary.unpack(old)["faces"]) == 12
    for bad in (b"", b"xxxx" + raw[4:], raw[:4] + (9).to_bytes(4, "little") + raw[8:]):
        assert len(binary.unpack(bad)["faces"]) == 0
    (tmp_path / "a.pre").write_bytes(raw)
    assert sources.require_edges(sources.read_pre(spark, str(tmp_path / "a.pre"))).edges.count() == 3
    (tmp_path / "b.pre").write_bytes(old)
    with pytest.raises(ValueError, match="no precomputed edges"):
        sources.require_edges(sources.read_pre(spark, str(tmp_path / "b.pre")))


def test_pre_round_trip(spark, sf, tmp_path):
    a = fx.cubes_a(spark, sf)
    sources.write_pre(a.triangles, a.edges, me.grid_stats(a.objects, 8.0), 8.0, str(tmp_path / "c.pre"))
    back = sources.read_pre(spark, str(tmp_path / "c.pre"))
    assert back.triangles.count() == a.triangles.count()
    assert back.grid.agg({"touch_count": "sum"}).first()[0] == 1277


def test_lists(spark, tmp_path):
    assert [r["path"] for r in sources.read_manifest(spark, write(tmp_path / "m", " a b \n\n# c\nd\n")).collect()] == ["a b", "d"]
    assert sorted(r["id"] for r in sources.read_ids(spark, write(tmp_path / "i", "3\n# 4\n5 # six\nseven\n\n")).collect()) == [3, 5]
    assert sorted(map(tuple, sources.read_pairs(spark, write(tmp_path / "p", "1 2\n 1\t2 \n3   4 x\nq r\n5\n")).collect())) == [(1, 2), (3, 4)]
    assert sources.read_nuclei(spark, write(tmp_path / "n", "1,a,b,7,1,2,3,9.5\n2,a,b,x,1,2,3,4\nshort\n")).first()["z"] == 120.0


def test_pieces_make_the_same_file(spark, tmp_path, monkeypatch):
    """A file put together from many pieces is, byte for byte, the one made of whole tables; the driver collects counts alone."""
    import numpy as np
    from pyspark.sql import DataFrame

    from meshloom.operators import mesh as me
    from meshloom.plans import fixtures as fx
    from meshloom.schema import EDGE, TRIANGLE
    from meshloom.sources import binary

    m = fx.cubes_a(spark, "/root/testdata/sf0.001")
    t, e = (x.toPandas().sort_values(["object_id", k]) for x, k in ((m.triangles, "tri_id"), (m.edges, "edge_id")))
    g = me.grid_stats(m.objects, 8.0).toPandas().sort_values(["ix", "iy", "iz"])
    points, index = np.unique(np.column_stack([np.repeat(t.object_id.to_numpy(), 3), t[list(TRIANGLE)].to_numpy().reshape(-1, 3)]), axis=0, return_inverse=True)
    cells = np.zeros(len(g), dtype=binary.CELL)
    cells["i"] = g[["ix", "iy", "iz"]]
    for c in ("center_count", "touch_count", "avg_size_mean", "vol_ratio"):
        cells[c] = g[c]
    want = binary.pack(points[:, 1:], index.reshape(-1, 3), t.object_id, e[list(EDGE[:3])], e[list(EDGE[3:])], e.object_id, 8.0, cells)
    monkeypatch.setattr(binary, "PIECE_ROWS", 100)
    monkeypatch.setattr(DataFrame, "toPandas", None)
    binary.write_pre(m.triangles, m.edges, me.grid_stats(m.objects, 8.0), 8.0, str(tmp_path / "a.pre"))
    assert (tmp_path / "a.pre").read_bytes() == want
    binary.write_pre(m.triangles.limit(0), m.edges.limit(0), None, None, str(tmp_path / "none.pre"))
    assert (tmp_path / "none.pre").read_bytes() == binary.HEADER.pack(binary.MAGIC, binary.VERSION, 0, 0, 0, 0, 0, False, False)


def test_a_preprocessed_file_is_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "RANGE_ROWS", 5)
    corners = np.arange(36, dtype=float).reshape(12, 3)
    faces, of = np.array([[n, (n + 1) % 12, (n + 2) % 12] for n in range(12)]), np.array([1, 2, 3] * 4)
    (tmp_path / "a.pre").write_bytes(binary.pack(corners, faces, of, corners, corners + 1, of))
    read = binary.read_pre(spark, str(tmp_path / "a.pre"))
    rows = {(r.object_id, r.tri_id): (r.ax, r.bx, r.cz) for r in read.triangles.collect()}
    assert rows == {(n % 3 + 1, n // 3): (3.0 * n, 3.0 * ((n + 1) % 12), 3.0 * ((n + 2) % 12) + 2) for n in range(12)}
    assert sorted((r.edge_id, r.object_id, r.px, r.qz) for r in read.edges.collect()) == [(n, n % 3 + 1, 3.0 * n, 3.0 * n + 3) for n in range(12)]
    for table in (read.triangles, read.edges):  # no row holds a file
        assert "content" not in table._jdf.queryExecution().executedPlan().toString()
