"""Registered queries against their DuckDB oracles at the smallest scale factor.

Every query runs; PLOTWEAVE_SPREAD=1 takes a spread of them for a quick look.
"""

import os

import pytest

import __spark_entry__ as entry_module
import check

SF = "/root/testdata/sf0.001"
SPREAD = """j1_candidates j2_fallback m1_iou m4_hausdorff m5_attribute_similarity m10_blend a1_match_bands r2_detect_conflicts
 r4_recommend r5_contract_bridge r7_auto_approve w4_latest_review w5_numbered_conflicts a5_kpi_summary a7_match_groups
 a8_hotspot_clusters a9_hotspots t1_normalize_text t6_field_mapping t8_area_text t10_assign_ulpin t12_decode_ulpin
 g1_reproject g5_validate g6_repair g7_area_utm e1_encroachments e4_row_breaches o3_overlaps o4_gaps o5_resolve_overlaps
 r9_merge_parcels r10_split_parcels s1_read_geojson s3_read_wkt s4_read_kml s8_write_geojson x1_stream_ingest
 x2_stream_reviews""".split()
ORACLES = entry_module.oracle_sql()
NAMES = SPREAD if os.environ.get("PLOTWEAVE_SPREAD") else sorted(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    df = entry_module.queries()[name](spark, SF)
    assert check.compare(df, check.connect(SF), ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_module.queries())
