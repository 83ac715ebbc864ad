"""Fixed schemas of the memory tables (times are Unix milliseconds, UTC, nullable)."""

MESSAGE = "struct<role:string,content:string,timestamp:bigint>"
REQUEST = f"request_id string, user_id string, session_id string, messages array<{MESSAGE}>, received_seq bigint"
MESSAGES = "user_id string, session_id string, request_id string, source_index int, role string, content string, timestamp bigint"
BLOCK = (
    "id string, user_id string, session_id string, request_id string, local_index int, prev_memory_id string, next_memory_id string, "
    "question string, answer string, status string, event_time bigint"
)
BLOCK_MESSAGE = "parent_memory_id string, source_index int, role string, content string, timestamp bigint"
APPLIED = "request_id string, user_id string, session_id string, payload_hash string, applied_at bigint"
FACT = (
    "id string, parent_memory_id string, user_id string, subject string, subject_key string, relation string, relation_key string, "
    "object string, object_key string, qualifiers map<string,string>, source_side string, source_quote string, statement string, "
    "content string, event_time bigint, source_date string, supersedes boolean, version string"
)
COVERAGE = "parent_memory_id string, user_id string, version string"
EXTRACTED = COVERAGE
REPLY = (
    "parent_memory_id string, user_id string, request_id string, local_index int, source_index int, role string, content string, timestamp bigint, "
    "side string, reply string, version string"
)
CACHE = "coordinate string, content_hash string, dim int, vec array<float>, created_at bigint"
INDEX = "memory_id string, user_id string, session_id string, local_index int, event_time bigint, text string, dense array<float>"
OBSERVATION_COUNTERS = ("rerank_candidates", "neighbors_added", "missing_rows", "considered_segments", "fact_snippets", "rounds", "truncated_by_top_k", "truncated_by_budget")
OBSERVATION_CATEGORIES = ("fact_status", "route", "route_status", "reason", "fallback", "multi_hop_status", "stop_reason")
COMPLETE, PENDING = "complete", "pending"
