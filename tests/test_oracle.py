"""Registered queries against DuckDB on the driver's smallest tables."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

# one or two per family; the driver compares all of them
SAMPLE = (
    "resolve_timezone_grid_g8", "bearing_g4", "corridor_distance_g13", "enrich_w1", "detect_commutes_w2", "smooth_modes_w3",
    "merge_short_segments_w5", "segment_with_zones_w7", "segment_keep_boundaries_w7", "waypoint_boundaries_w8", "point_features_w9",
    "variance_classifier_c2", "classify_with_confidence_c6", "plugin_classifier_c8", "mode_mismatch_c10", "points_in_corridors_j4",
    "apply_corrections_j1", "migration_map_j6", "trip_detail_j8", "commutes_a1", "commute_stats_a4", "daily_overview_a5",
    "segment_variability_a6", "best_worst_hour_a11", "weekly_report_a17", "health_a19", "polyline_vertices_w13", "review_r2",
    "recent_patterns_r3", "apply_suggestions_r4", "upsert_labels_l1", "export_labels_l3", "rebuild_one_user_p2", "process_jsonl_p3",
    "segment_long_trip_zones_w7", "rebuild_typed_p2", "resolve_polygon_g8", "tree_digests_s14", "points_version_s6", "raw_next_page_s12", "raw_far_page_s12", "rebuild_migrates_labels_p2",
    "ingest_i1", "prune_synced_s10", "mark_synced_s9", "evaluate_classifier_m7", "train_model_m3", "sql_cube_q1", "sql_subquery_cte_q1",
)


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_duckdb(spark, sf_dir, duck, name):
    frame = queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(canonical(r[names.index(c)]) for c in columns) for r in result.fetchall())
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in frame.collect())
    assert got == want


def test_catalog_is_consistent(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
