"""Row shapes of the label log and its curated table."""

from __future__ import annotations

LABEL_SCHEMA_VERSION = 2

# Top-level fields of a log record, read with a fixed schema; unknown keys stay in the raw text.
RECORD_FIELDS = {
    "id": "string",
    "schema_version": "int",
    "record_type": "string",
    "tci_path": "string",
    "scl_path": "string",
    "cx_full": "double",
    "cy_full": "double",
    "is_vessel": "boolean",
    "review_category": "string",
    "source": "string",
    "reviewed_at": "string",
    "witnessed_at": "string",
    "estimated_length_m": "double",
    "estimated_width_m": "double",
    "human_length_m": "double",
    "human_width_m": "double",
    "graphic_length_m": "double",
    "graphic_width_m": "double",
    "footprint_source": "string",
    "notes": "string",
    "heading_deg_from_north": "double",
    "heading_source": "string",
    "transhipment_side_by_side": "boolean",
    "grid_row": "int",
    "grid_col": "int",
    "grid_divisions": "int",
    "feedback_kind": "string",
    "tile_water_fraction": "double",
    "tile_detector_count": "int",
    "lon": "double",
    "lat": "double",
    "cell_key": "string",
    "dimension_markers": "array<struct<role:string,x:double,y:double,hull:int>>",
}

# Keys of the open ``extra`` map that filters and joins use; each becomes a real column, because a
# predicate on a column reaches the Parquet scan and one inside a document does not.
EXTRA_FIELDS = {
    "label_confidence": "string",
    "graphic_length_m": "double",
    "graphic_width_m": "double",
    "graphic_length_m_hull2": "double",
    "graphic_width_m_hull2": "double",
    "estimated_length_m": "double",
    "estimated_width_m": "double",
    "hull_aspect_ratio": "double",
    "wake_present": "boolean",
    "transhipment_side_by_side": "boolean",
    "partial_cloud_obscuration": "boolean",
    "manual_locator": "boolean",
    "coastal_or_land_adjacent": "boolean",
    "near_coast_proxy": "boolean",
    "heading_deg_from_north": "double",
    "heading_source": "string",
    "cx_candidate": "double",
    "cy_candidate": "double",
    "marker_origin_col": "int",
    "marker_origin_row": "int",
    "human_material_category": "string",
}
