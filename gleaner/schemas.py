"""Spark schemas (DDL strings) of the tables the jobs read and write."""

FEATURES = (
    "STRUCT<length: INT, line_count: INT, bullet_line_count: INT, has_links: BOOLEAN, "
    "has_email: BOOLEAN, has_body: BOOLEAN, title_is_question: BOOLEAN>"
)
VERDICT = (
    "STRUCT<is_lead: BOOLEAN, confidence: DOUBLE, reject_reason: STRING, lead_type: STRING, "
    "summary_ru: STRING, need_ru: STRING, budget_hint: STRING, red_flags_ru: ARRAY<STRING>>"
)

SOURCES = (
    "name STRING, category STRING, circuit STRING, enabled BOOLEAN, muted_until TIMESTAMP, "
    "priority INT, added_at TIMESTAMP, last_seen_at TIMESTAMP"
)
FEED_ITEMS = (
    "item_id STRING, source STRING, title STRING, body STRING, has_body BOOLEAN, tag STRING, "
    "author_handle STRING, permalink STRING, posted_at TIMESTAMP"
)
# JSON message on the raw stream: as FEED_ITEMS, with the timestamp still as ISO text.
MESSAGE = (
    "item_id STRING, source STRING, title STRING, body STRING, has_body BOOLEAN, tag STRING, "
    "author_handle STRING, permalink STRING, posted_at STRING"
)
RAW_ITEMS = (
    "id BIGINT, source STRING, circuit STRING, item_id STRING, author_handle STRING, "
    "permalink STRING, tag STRING, title STRING, posted_at TIMESTAMP, text STRING, "
    "text_norm STRING, text_hash STRING, simhash BIGINT, has_body BOOLEAN, "
    f"struct_features {FEATURES}, reject_rule STRING, created_at TIMESTAMP"
)
MATCHES = (
    "id BIGINT, raw_item_id BIGINT, circuit STRING, score INT, signals MAP<STRING, INT>, "
    "stack_matched ARRAY<STRING>, intent_tag STRING, compensation STRING, contact STRING, "
    f"headline STRING, decided_by STRING, llm_verdict {VERDICT}, llm_summary_ru STRING, "
    "llm_prob DOUBLE, llm_status STRING, rules_version STRING, model_version STRING, "
    "duplicate_count INT, duplicate_of BIGINT, notified_at TIMESTAMP, "
    "notification_msg_id BIGINT, is_favorite BOOLEAN, status STRING, created_at TIMESTAMP"
)
LEAD_CRM = (
    "match_id BIGINT, contact_state STRING, reply_text STRING, taken_in_work BOOLEAN, "
    "earnings DECIMAL(12,2), currency STRING, contacted_at TIMESTAMP, in_work_at TIMESTAMP, "
    "deleted_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)
CRM_COMMANDS = (
    "cmd_id BIGINT, ts TIMESTAMP, match_id BIGINT, kind STRING, contact_state STRING, "
    "response_text STRING, taken_in_work STRING, earnings STRING, currency STRING"
)
FEEDBACK = "id BIGINT, match_id BIGINT, verdict STRING, reason STRING, created_at TIMESTAMP"
KEYWORDS = "dict_type STRING, term STRING, weight INT, maps_to STRING, enabled BOOLEAN"
RULE_WEIGHTS = "key STRING, weight INT"
AUTHORS = "handle STRING, good_count INT, bad_count INT"
USAGE_LOG = (
    "match_id BIGINT, mode STRING, circuit STRING, model STRING, outcome STRING, "
    "prompt_tokens BIGINT, output_tokens BIGINT, latency_ms BIGINT, error STRING, "
    "created_at TIMESTAMP"
)
