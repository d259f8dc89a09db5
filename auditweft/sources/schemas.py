"""Fixed schemas of the audit tables."""

_COMMON = (
    "server string, share string, path string, previous_path string, object_type string, action string, user string, sid string, "
    "source_host string, source_ip string, process_name string, file_size_bytes bigint, extension string"
)
RAW_EVENT = f"timestamp_utc timestamp, {_COMMON}, result string, severity string, source string"
EVENT = f"id string, {RAW_EVENT}"
COLLECTED = f"cursor_type string, record_id bigint, usn bigint, volume string, timestamp_utc timestamp, {_COMMON}, file_reference_id string, result string, severity string, source string"
ALERT = (
    "id string, rule string, severity string, status string, title string, description string, server string, user string, event_count int, first_event_utc timestamp, "
    "last_event_utc timestamp, created_utc timestamp, acknowledged_utc timestamp, sample_paths array<string>, dedup_key string"
)
RULE = (
    "rule string, title string, description string, enabled boolean, severity string, threshold int, secondary_threshold int, secondary_severity string, server_filter string, "
    "share_filter string, path_filter string, active_from_hour int, active_to_hour int, active_days string, excluded_users string, excluded_hosts string, "
    "excluded_processes string, time_zone_id string, updated_utc timestamp"
)
HEARTBEAT = (
    "agent_id string, server string, status string, last_heartbeat_utc timestamp, version string, last_record_id bigint, last_usn_by_volume map<string,bigint>, message string, "
    "pending_queue_events int, last_successful_send_utc timestamp"
)
MONITORED_PATH = "id string, server string, share string, path string, status string, priority string, owner string, notes string, created_utc timestamp, updated_utc timestamp"
ADMIN_AUDIT = "id string, timestamp_utc timestamp, action string, entity_type string, entity_id string, actor string, source_ip string, details_json string"
TABLES = {"events": EVENT, "alerts": ALERT, "rules": RULE, "heartbeats": HEARTBEAT, "monitored_paths": MONITORED_PATH, "admin_audit": ADMIN_AUDIT}
