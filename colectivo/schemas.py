"""Fixed schemas of the stored tables. Enums are strings; times of day are HH:MM:SS text."""

from __future__ import annotations

from pyspark.sql import types as T

_PATH = "array<struct<lon:double,lat:double>>"

# Columns of every table.
TABLES: dict[str, str] = {
    "lines": "line_id string, name string, description string, status string, line_type string, merged_into_id string,"
    " created_at timestamp, updated_at timestamp",
    "line_votes": "line_id string, device_id string, vote string, created_at timestamp",
    "trip_sessions": "session_id string, line_id string, direction string, device_id string, device_model string, os_version string,"
    " notes string, status string, processing_status string, started_at timestamp, ended_at timestamp, last_activity_at timestamp,"
    f" path {_PATH}",
    "trip_session_points": "session_id string, timestamp timestamp, latitude double, longitude double, altitude double, speed double,"
    " bearing double, horizontal_accuracy double, vertical_accuracy double",
    "trip_sensor_readings": "session_id string, timestamp timestamp, accel_x double, accel_y double, accel_z double, gyro_x double,"
    " gyro_y double, gyro_z double, pressure double, magnetic_heading double",
    "trips": "trip_id string, session_id string, line_id string, status string, match_score double, mean_snap_m double,"
    f" path {_PATH}, processed_at timestamp, match_attributes struct<shape_coords:{_PATH},"
    "edges:array<struct<id:bigint,forward:boolean,begin_shape_index:int,end_shape_index:int,names:array<string>,length:double>>,"
    "matched_points:array<struct<lat:double,lon:double,type:string,edge_index:bigint,distance_along_edge:double,distance_from_trace_point:double>>>",
    "trip_points": "trip_id string, point_index bigint, timestamp timestamp, latitude double, longitude double",
    "trip_matched_edges": "trip_id string, sequence bigint, edge_id bigint, forward boolean",
    "routes": "route_id string, line_id string, version int, source string, status string, trip_count bigint, strategy_key string,"
    " fragment_index int, fragment_count int, ramal_label string, last_compared_at timestamp, street_summary array<string>,"
    " endpoint_zones array<string>",
    "route_edges": f"route_edge_id string, route_id string, sequence bigint, edge_id bigint, forward boolean, path {_PATH},"
    " confidence double, status string, votes_for bigint, votes_against bigint, confirmed_at timestamp",
    "edge_votes": "route_edge_id string, device_id string, vote string, created_at timestamp",
    "fare_zones": f"zone_id bigint, name string, rings array<{_PATH}>",
    "fare_reports": "report_id string, line_id string, device_id string, session_id string, amount decimal(6,2), boarding_lat double,"
    " boarding_lon double, alighting_lat double, alighting_lon double, boarding_zone_id bigint, alighting_zone_id bigint,"
    " source string, created_at timestamp",
    "detours": f"detour_id string, line_id string, session_id string, status string, reason string, description string, path {_PATH},"
    " created_at timestamp, last_confirmed_at timestamp, confirmed_count bigint",
    "line_schedules": "line_id string, day_bucket string, service_start_at string, service_end_at string, headway_min int, inferred_at timestamp",
    "ramal_descriptors": "descriptor_id string, route_id string, text string, text_normalized string, votes_count bigint,"
    " created_by_device_id string, created_at timestamp",
    "ramal_descriptor_votes": "descriptor_id string, device_id string, created_at timestamp",
    "devices": "device_id string, push_token string, platform string, locale string, last_seen_at timestamp, created_at timestamp",
    "line_subscriptions": "device_id string, line_id string, kind string",
    "notification_dispatches": "device_id string, line_id string, detour_id string, kind string, sent_at timestamp",
    "runs": "run_id string, trigger string, status string, started_at timestamp, ended_at timestamp",
    "run_steps": "run_id string, step string, place int, status string, started_at timestamp, ended_at timestamp,"
    " stats map<string,string>, error_message string",
}

ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("lines", "status"): ("draft", "pending", "approved", "merged"),
    ("lines", "line_type"): ("micro", "trufi", "taxi_trufi"),
    ("trip_sessions", "status"): ("in_progress", "completed", "cancelled", "abandoned", "discarded"),
    ("trip_sessions", "processing_status"): ("raw", "processing", "processed", "failed"),
    ("trips", "status"): ("clean", "deviated"),
    ("routes", "status"): ("pending", "confirmed", "superseded"),
    ("routes", "source"): ("computed", "imported"),
    ("route_edges", "status"): ("pending", "confirmed"),
    ("edge_votes", "vote"): ("approve", "reject"),
    ("line_votes", "vote"): ("approve", "reject"),
    ("detours", "status"): ("active", "expired"),
    ("fare_reports", "source"): ("registration", "confirmation"),
    ("line_subscriptions", "kind"): ("commute",),
    ("notification_dispatches", "kind"): ("individual", "coalesced"),
}

KEYS: dict[str, tuple[str, ...]] = {
    "line_votes": ("line_id", "device_id"), "edge_votes": ("route_edge_id", "device_id"), "trip_matched_edges": ("trip_id", "sequence"),
    "line_schedules": ("line_id", "day_bucket"), "ramal_descriptors": ("route_id", "text_normalized"),
    "ramal_descriptor_votes": ("descriptor_id", "device_id"), "line_subscriptions": ("device_id", "line_id", "kind"), "fare_zones": ("name",),
}


def schema(table: str) -> T.StructType:
    """StructType of a stored table."""
    return T.StructType.fromDDL(TABLES[table])
