"""Declared schemas; nothing is inferred."""

LOG_ENTRY = """logName string, resource struct<type: string, labels: map<string, string>>, timestamp string, receiveTimestamp string, severity string,
insertId string, labels map<string, string>, textPayload string, jsonPayload string, trace string, spanId string, _corrupt string"""
SCRAPE = "scrape_time string, phase string, exposition string"
TARGETS = "targets array<struct<project_id: string, location: string, cluster: string, namespace: string, job: string, instance: string, exporter: string, entity_kind: string>>"
TOPOLOGY = """entities array<struct<entity_id: string, kind: string, log_resource: struct<type: string, labels: map<string, string>>>>, edges array<array<string>>"""
CALENDAR = "changes array<struct<change_id: string, kind: string, entities: array<string>, start: string, end: string, description: string>>"
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
QUERY_RANGE = "status string, data struct<resultType: string, result: array<struct<metric: map<string, string>, values: array<array<string>>, value: array<string>>>>"
