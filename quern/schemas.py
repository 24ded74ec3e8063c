"""Explicit schemas of what the engine reads and stores. Nothing is inferred."""

from __future__ import annotations

# The states and sources of ingestion, and error codes by category.
LIFECYCLE = ["received", "dedupe_checked", "raw_stored", "registered", "parsed", "chunked", "embedded", "indexed", "published", "failed"]
SOURCES = ["github_issue", "github_issue_comment", "markdown_doc"]
RUN_STATUSES = ["received", "validated", "dedupe_checked", "raw_stored", "registered", "skipped_no_change", "failed"]
TERMINAL = ["registered", "skipped_no_change", "failed"]
SUCCESS = ["registered", "skipped_no_change"]
ERROR_CODES = {
    "validation": ["schema_mismatch", "missing_required_field", "invalid_field_type", "field_constraint", "payload_too_large", "malformed_json"],
    "transient": ["database_connection", "database_timeout", "filesystem_io", "network", "rate_limited"],
    "infra": ["database_unavailable", "storage_full", "queue_unavailable"],
    "internal": ["unexpected", "assertion_failed", "transformer_error"],
}

ISSUE = (
    "id long, html_url string, title string, body string, created_at string, updated_at string, user struct<login:string>, "
    "labels array<struct<name:string>>, repository_url string, number int, state string, pull_request string, issue_url string"
)
DOCUMENT = (
    "document_id string, external_id string, title string, source_type string, source_uri string, tenant_id string, owners array<string>, tags array<string>, labels array<string>, "
    "service string, component string, extra map<string,string>, hash_content string, created_at timestamp, updated_at timestamp, ingested_at timestamp, lifecycle_state string"
)
VERSION = (
    "document_id string, version_id string, version_index int, body_text string, source_payload_uri string, hash_payload string, valid_from timestamp, valid_to timestamp, is_active boolean"
)
RUN_EVENT = "run_id string, event_ts timestamp, status string, source_type string, external_id string, document_id string, payload_hash string, error_code string, error_message string, trace_id string"
SAMPLE = "sample_id string, question string, ground_truth string, reference_context array<string>, document_id string, metadata map<string,string>"
DATASET = f"name string, description string, version string, created_at string, source_documents array<string>, samples array<struct<{', '.join(':'.join(x.split(' ', 1)) for x in SAMPLE.split(', '))}>>"
SPAN = "trace_id string, span_id string, parent_id string, name string, start_ts timestamp, duration_ms double, status string, attributes map<string,string>, eval_scores map<string,double>"
OBSERVATION = "name string, labels map<string,string>, kind string, value double"
FAILURE = (
    "record_id string, question string, expected_answer string, actual_answer string, failure_type string, failure_metric string, failure_score double, "
    "reference_context array<string>, document_id string, metadata map<string,string>, recorded_at timestamp, promoted boolean"
)
