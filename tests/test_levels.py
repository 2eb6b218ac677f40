"""Levels of detail of joins: which there are, what they are made from, and bounds that hold."""

from pyspark.sql import functions as F

from meshloom import plans
from meshloom.operators import detail, distance


def test_a_join_asks_all_levels_made_from_the_mesh(spark, sf, monkeypatch):
    found, told = [], distance.progressive_within
    monkeypatch.setattr(distance, "progressive_within", lambda a, b, pairs, d: (found.append((a, b)), told(a, b, pairs.limit(0), d))[1])
    plans.QUERIES["join_lods"](spark, sf)
    for levels in found[0]:
        assert sorted(levels) == [20, 40, 60, 80, 100]
        rows = {lod: t.groupBy("object_id").agg(F.count("*").alias("n")) for lod, t in levels.items()}
        # every object has facets at each level, and the coarsest level has objects of fewer
        assert rows[20].count() == rows[100].count() > 0
        assert rows[20].where("n < 12").count() > rows[80].where("n < 12").count()
        assert rows[100].where("n <> 12").count() == 0


def test_bounds_hold_for_unequal_triangles(spark):
    names = "object_id long, tri_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
    tiny = lambda n, x, y: (1, n, float(x), float(y), 0.0, x + 1e-3, float(y), 0.0, float(x), y + 1e-3, 0.0)
    # the original is near all samples of the large facet, and far from what lies between them
    samples = [tiny(n, x, y) for n, (x, y) in enumerate([(0, 0), (5, 0), (10, 0), (0, 5), (5, 5), (0, 10)])]
    coarse = [(1, 0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0, 0.0), *[tiny(n, 0, 0) for n in range(1, 100)]]
    told = lambda sure: detail.facet_hausdorff(spark.createDataFrame(coarse, names), spark.createDataFrame(samples, names), 2, sure=sure).where("facet = 0").first().hausdorff
    far = 12.5**0.5 - 2e-3  # from (2.5, 2.5)
    assert told(True) >= far > told(False)
