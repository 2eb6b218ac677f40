"""What only shows at size: large estimates, and plans that must not send large tables through the driver."""

import os
import re

import duckdb
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from meshloom import plans, sources
from meshloom.operators import detail, distance, grid, joins
from meshloom.operators import estimate as es
from tests.compare import TABLES, assert_same


def test_slots_of_a_large_estimate(spark, sf, monkeypatch):
    monkeypatch.setattr(es, "estimate_pairs", lambda *_: spark.sql("SELECT 2566540078L AS estimated_pairs"))
    assert tuple(plans.QUERIES["estimate_only"](spark, sf).first()) == (2566540078, 5133080157)
    assert es.hash_table_size(2566540078) == (1 << 31) | 1


#: Queries over exploded tables, which the optimizer takes for small.
EXPLODED = "anti_lookup box_contains_box box_contains_point containment_join edge_check edge_hit_count edge_multi_hit hash_contention_stats hausdorff hausdorff_global intersection_join join_lods octree_query_within overlap_join pair_compact pair_dedup_hash pair_unpack sink_pairs_csv tile_join_intersect tile_self_join voxel_pair_candidates voxelize".split()


@pytest.mark.parametrize("name", EXPLODED)
def test_nothing_is_broadcast_uncounted(spark, sf, name, monkeypatch):
    monkeypatch.setattr(grid, "SENT_ROWS", -1)  # no table counts as small
    monkeypatch.setattr(joins, "SENT_BYTES", -1)
    found, write = [], DataFrameWriter.parquet
    told = lambda df: found.extend(re.findall(r"Broadcast(?:Hash|NestedLoop)Join.*", df._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *args, **options: (told(self._df), write(self, *args, **options))[1])
    told(plans.QUERIES[name](spark, sf))
    assert not found


def test_reading_obj_broadcasts_only_counts_of_splits(spark, tmp_path):
    (tmp_path / "a.obj").write_text("o a\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    rows = sources.read_obj(spark, str(tmp_path / "a.obj"))
    assert rows.count() == 1
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)#\d+, (\w+)#", rows._jdf.queryExecution().executedPlan().toString())) == {("file", "split")}


@pytest.fixture(scope="module")
def repeated(sf, tmp_path_factory):
    """The smallest tables; parts and customers are there three times, at the same places."""
    folder = tmp_path_factory.mktemp("repeated")
    for name in TABLES:
        key = {"part": "p_partkey", "customer": "c_custkey"}.get(name)
        if key:
            duckdb.sql(f"COPY (SELECT * REPLACE ({key} + 7000 * i AS {key}) FROM '{sf}/{name}.parquet', range(3) r(i)) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{sf}/{name}.parquet", folder / f"{name}.parquet")
    return str(folder)


#: Queries of objects, and the operator that sees one object of each shape.
BY_SHAPE = {"hausdorff": (detail, "facet_hausdorff"), "hausdorff_global": (detail, "facet_hausdorff"), "voxelize": (detail, "sample_points"), "join_lods": (distance, "facet_hausdorff"), "voxel_pair_candidates": (distance, "voxel_pair_candidates")}


@pytest.mark.parametrize("name", BY_SHAPE)
def test_copies_are_asked_for_once(spark, repeated, name, monkeypatch):
    module, operator = BY_SHAPE[name]
    asked, told = [], getattr(module, operator)
    tables = lambda args: [x for x in args if hasattr(x, "columns") and "object_id" in x.columns]
    monkeypatch.setattr(module, operator, lambda *args, **more: (asked.extend(x.select("object_id").distinct().count() for x in tables(args)), told(*args, **more))[1])
    assert_same(spark, repeated, plans.QUERIES[name], plans.ORACLES[name])
    assert asked and max(asked) <= 200  # of 600 parts and 450 customers


@pytest.mark.parametrize("name", ["hausdorff", "hausdorff_global"])
def test_triangles_are_made_once_for_a_plan(spark, sf, repeated, name, monkeypatch):
    found, write = [], DataFrameWriter.parquet
    told = lambda df: found.append(len(re.findall(r"FileScan parquet \[p_partkey", df._jdf.queryExecution().executedPlan().toString())))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *args, **options: (told(self._df), write(self, *args, **options))[1])
    for folder in (sf, repeated):
        told(plans.QUERIES[name](spark, folder))
    assert max(found) == 1


def test_a_self_join_asks_for_copies_once(spark, repeated, monkeypatch):
    asked, told = [], distance.cluster_pairs
    monkeypatch.setattr(distance, "cluster_pairs", lambda a, b, cell: (asked.extend(m.clusters.select("object_id").distinct().count() for m in (a, b)), told(a, b, cell))[1])
    assert_same(spark, repeated, plans.QUERIES["tile_self_join"], plans.ORACLES["tile_self_join"])
    assert asked == [150, 150]  # of 450 customers
