"""DuckDB texts that compute the registered queries from the same tables."""

from __future__ import annotations

from gleaner import fixed_values as fixed
from gleaner import rules as rule_tables
from gleaner.plans import corpus

ORACLE: dict[str, str] = {}


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _listed(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _choice(column: str, table: dict, other: str = "NULL") -> str:
    whens = " ".join(
        f"WHEN {_quoted(k)} THEN {_quoted(v) if isinstance(v, str) else v}" for k, v in table.items()
    )
    return f"CASE {column} {whens} ELSE {other} END"


WS = _quoted(fixed.WHITE_SPACE)
MICROS = "'%Y-%m-%d %H:%M:%S.%f'"
T0 = "TIMESTAMP '2024-01-01 00:00:00'"

_WORDS: dict[str, dict[str, int]] = {}
for _kind, _term, _weight, _ in corpus.KEYWORD_ROWS:
    _WORDS.setdefault(_kind, {})[_term] = _weight
STACK = {**_WORDS["stack_periph"], **_WORDS["stack_core"]}
HIRING, PAIN, MONEY = _WORDS["hiring_intent"], _WORDS["pain_point"], _WORDS["money"]
NOISE, ANTI, CLOSED = _WORDS["noise"], _WORDS["anti"], _WORDS["closed"]


def _pattern(words) -> str:
    return r"\b(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")\b"


def _terms(words) -> str:
    return f"list_distinct(regexp_extract_all(masked, '{_pattern(words)}'))"


def _weights(column: str, words: dict[str, int]) -> str:
    return f"coalesce(list_sum(list_transform({column}, lambda w: {_choice('w', words, '0')})), 0)"


def minutes(expression: str) -> str:
    return f"({T0} + to_minutes(CAST({expression} AS BIGINT)))"


def _added(table) -> str:
    return " || ".join(f"CASE WHEN doc_id % {m} = {r} THEN {_quoted(t)} ELSE '' END" for m, r, t in table)


# --- shared relations ----------------------------------------------------------------------

ITEMS = f"""
cut AS (SELECT *, strpos(text, chr(10)) AS nl FROM documents),
items AS (
  SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS item_id, source,
    {_added(corpus.TITLE_LABELS)}
      || CASE WHEN length(text) < {corpus.SHORT_TEXT} AND doc_id % 2 = 1 AND doc_id % 40 NOT IN (0, 13, 27)
        THEN '{corpus.SHORT_LABEL}' ELSE '' END
      || CASE WHEN nl > 0 THEN left(text, nl - 1) ELSE text END || {_added(corpus.TITLE_ENDS)} AS title,
    CASE WHEN nl > 0 THEN substr(text, nl + 1) ELSE '' END || {_added(corpus.BODY_ENDS)} AS body,
    nl > 0 OR {_added(corpus.BODY_ENDS)} <> '' AS has_body,
    'user' || (doc_id % 50) AS author_handle,
    'https://example.test/' || doc_id AS permalink,
    {minutes(f'doc_id * {corpus.MINUTES_BETWEEN_ITEMS}')} AS ts
  FROM cut),
tagged AS (
  SELECT *, CASE WHEN regexp_matches(title, '^\\s*[\\[(]\\s*([A-Za-z /]{{2,20}})\\s*[\\])]')
    THEN lower(trim(regexp_extract(title, '^\\s*[\\[(]\\s*([A-Za-z /]{{2,20}})\\s*[\\])]', 1), {WS})) END AS tag,
    trim(title || chr(10) || chr(10) || body, {WS}) AS raw
  FROM items),
cleaned AS (
  SELECT *, trim(regexp_replace(regexp_replace(
      regexp_replace(lower(regexp_replace(raw, '[*_`~]', '', 'g')), '[ \\t]+', ' ', 'g'),
      '\\n{{3,}}', chr(10) || chr(10), 'g'), '^$', ''), {WS}) AS plain_norm
  FROM tagged),
normed AS (
  SELECT *,
    regexp_replace(regexp_replace(plain_norm,
      '(^|[^\\pL\\pN\\pM_])thly($|[^\\pL\\pN\\pM_])', '\\1thing\\2', 'g'),
      '(^|[^\\pL\\pN\\pM_])thly($|[^\\pL\\pN\\pM_])', '\\1thing\\2', 'g') AS text_norm
  FROM cleaned),
masked AS (
  SELECT *, regexp_replace(text_norm, '[^\\x00-\\x7f]', '_', 'g') AS masked,
    regexp_replace(raw, '[^\\x00-\\x7f]', '_', 'g') AS masked_raw
  FROM normed)"""

FEATURES = r"""
features AS (
  SELECT id, CAST(length(raw) AS BIGINT) AS length,
    CAST(len(list_filter(string_split(raw, chr(10)), lambda line: regexp_matches(line, '\S'))) AS BIGINT) AS line_count,
    CAST(len(regexp_extract_all(raw, '(?m)^\s*([-–—•*●▪]|\d+[.)])\s+')) AS BIGINT) AS bullet_line_count,
    regexp_matches(raw, 'https?://\S+') AS has_links,
    regexp_matches(masked_raw, '[\w.+-]+@[\w-]+\.\w+') AS has_email,
    has_body,
    coalesce(regexp_matches(list_filter(string_split(raw, chr(10)), lambda line: regexp_matches(line, '\S'))[1], '\?\s*$'), false)
      AS title_is_question
  FROM masked)"""

_CATEGORY = f"{_listed(fixed.CATEGORIES)}[n % 8 + 1]"
SOURCES = f"""
sources AS (
  SELECT upper(source) AS name, {_CATEGORY} AS category,
    CASE WHEN n % 5 = 0 THEN 'browse' ELSE 'main' END AS circuit,
    n % 7 <> 6 AS enabled,
    CASE WHEN n % 6 = 1 THEN {minutes('n * 100')} END AS muted_until,
    n % 4 AS priority
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS n FROM documents))"""

TERMS = f"""
terms AS (
  SELECT m.*, s.name AS source_name, s.circuit, s.category, s.priority,
    f.length, f.bullet_line_count, f.title_is_question,
    {_terms(STACK)} AS stack, {_terms(HIRING)} AS hiring, {_terms(PAIN)} AS pain,
    {_terms(MONEY)} AS money, {_terms(NOISE)} AS noise,
    coalesce(tag IN {tuple(fixed.TAGS_HIRING)}, false) AS hiring_tag,
    coalesce(tag IN {tuple(fixed.TAGS_SERVICE_OFFER)}, false) AS offer_tag
  FROM masked m JOIN features f USING (id) JOIN sources s ON lower(s.name) = lower(m.source)),
helped AS (
  SELECT *, len(list_filter(stack, lambda w: w IN {tuple(_WORDS['stack_core'])})) AS core
  FROM terms),
asked AS (
  SELECT *, len(stack) > 0 AND len(noise) = 0 AND core > 0
      AND (regexp_matches(masked, '{corpus.HELP_WORDS}') OR title_is_question OR core >= 2) AS help_request
  FROM helped)"""


def _starts(pattern: str) -> str:
    """Start of each match, from the lengths of what lies between the matches."""
    gaps = f"string_split_regex(masked, '{pattern}')"
    found = f"regexp_extract_all(masked, '{pattern}')"
    return (
        f"list_transform(range(1, len({found}) + 1), lambda k: "
        f"coalesce(list_sum(list_transform({gaps}[1:k], lambda p: length(p))), 0) + "
        f"coalesce(list_sum(list_transform({found}[1:k - 1], lambda p: length(p))), 0))"
    )


def _token(position: str) -> str:
    return (
        f"greatest(len(regexp_extract_all(left(masked, CAST({position} AS BIGINT) + 1), '\\S+')) - 1, 0)"
    )


GATES = f"""
placed AS (
  SELECT *, {_starts(_pattern(CLOSED))} AS closed_at, {_starts(_pattern(ANTI))} AS anti_at,
    {_starts(_pattern(HIRING))} AS hiring_at
  FROM asked),
gated AS (
  SELECT *,
    CASE WHEN length(text_norm) < 40 OR length(text_norm) > 20000 THEN 'HF-1_length' END AS hf1,
    CASE WHEN circuit = 'main' AND NOT (len(hiring) > 0 OR len(pain) > 0 OR help_request OR hiring_tag)
      THEN 'HF-2_no_signal' END AS hf2,
    CASE WHEN NOT (len(hiring) > 0 OR len(pain) > 0 OR help_request OR hiring_tag)
      THEN 'HF-2_no_signal' END AS hf2_all,
    CASE WHEN coalesce(list_min(closed_at) < 200, false)
        OR (len(hiring_at) > 0 AND len(list_filter(closed_at, lambda p:
            abs({_token('p')} - {_token('hiring_at[1]')}) <= 6)) > 0)
      THEN 'HF-3_closed' END AS hf3,
    CASE WHEN circuit = 'main' AND length(text_norm) < 150
        AND NOT (len(hiring) > 0 OR len(pain) > 0 OR help_request) THEN 'HF-4_low_info' END AS hf4,
    CASE WHEN length(text_norm) < 150
        AND NOT (len(hiring) > 0 OR len(pain) > 0 OR help_request) THEN 'HF-4_low_info' END AS hf4_all,
    CASE WHEN offer_tag OR coalesce(anti_at[1] < 300, false) THEN 'HF-5_service_offer' END AS hf5,
    CASE WHEN NOT has_body AND len(hiring) = 0 AND NOT hiring_tag THEN 'HF-6_no_body' END AS hf6
  FROM placed)"""

_CONTACT = fixed.CONTACT_PATTERN
_MONEY_AMOUNT = "(?i)" + fixed.MONEY_AMOUNT_PATTERN


def score_relations(help_column: str = "help_request", help_min: int = fixed.HELP_MIN_SCORE) -> str:
    w = fixed.RULE_WEIGHTS
    return f"""
signals AS (
  SELECT id, unnest([
    struct_pack(rule := 'stack', points := least({_weights('stack', STACK)}, 9)),
    struct_pack(rule := 'intent', points := least({_weights('hiring', HIRING)} + {_weights('pain', PAIN)} + {_weights('money', MONEY)}, 8)),
    struct_pack(rule := 'has_sections', points := CASE WHEN regexp_matches(text_norm, '{fixed.SECTION_PATTERN}') THEN {w['has_sections']} ELSE 0 END),
    struct_pack(rule := 'has_contact', points := CASE WHEN regexp_matches(masked, '{_CONTACT}') THEN {w['has_contact']} ELSE 0 END),
    struct_pack(rule := 'has_money_pattern', points := CASE WHEN regexp_matches(masked, '{_MONEY_AMOUNT}') THEN {w['has_money_pattern']} ELSE 0 END),
    struct_pack(rule := 'has_bullets', points := CASE WHEN bullet_line_count >= 3 THEN {w['has_bullets']} ELSE 0 END),
    struct_pack(rule := 'long_len', points := CASE WHEN length > 500 THEN {w['long_len']} ELSE 0 END),
    struct_pack(rule := 'short_len', points := CASE WHEN length < 180 THEN {w['short_len']} ELSE 0 END),
    struct_pack(rule := 'no_body', points := CASE WHEN NOT has_body THEN {w['no_body']} ELSE 0 END),
    struct_pack(rule := 'no_stack', points := CASE WHEN len(stack) = 0 THEN {w['no_stack']} ELSE 0 END),
    struct_pack(rule := 'help_question', points := CASE WHEN {help_column} THEN {w['help_question']} ELSE 0 END),
    struct_pack(rule := 'tag_task', points := CASE WHEN tag = 'task' THEN {w['tag_task']} ELSE 0 END),
    struct_pack(rule := 'tag_hiring', points := CASE WHEN hiring_tag AND tag <> 'task' THEN {w['tag_hiring']} ELSE 0 END),
    struct_pack(rule := 'category_job_board', points := CASE WHEN category = 'job_board' THEN 3 ELSE 0 END),
    struct_pack(rule := 'category_ai_automation', points := CASE WHEN category = 'ai_automation' THEN 1 ELSE 0 END),
    struct_pack(rule := 'category_business_ops', points := CASE WHEN category = 'business_ops' THEN 1 ELSE 0 END),
    struct_pack(rule := 'source_priority', points := priority),
    struct_pack(rule := 'noise', points := greatest({_weights('noise', NOISE)}, -8))
  ]) AS s FROM gated),
fired AS (SELECT id, s.rule AS rule, CAST(s.points AS BIGINT) AS points FROM signals WHERE s.points <> 0),
totals AS (SELECT id, CAST(sum(points) AS BIGINT) AS score, count(*) AS fired FROM fired GROUP BY id),
replayed AS (
  SELECT g.*, coalesce(t.score, 0) AS score, coalesce(t.fired, 0) AS fired,
    coalesce(hf1, hf2_all, hf3, hf4_all, hf5, hf6) AS dry_rule,
    coalesce(hf1, hf2, hf3, hf4, hf5, hf6) AS live_rule,
    CASE WHEN (len(hiring) > 0 OR hiring_tag) AND len(pain) > 0 THEN 'both'
      WHEN len(hiring) > 0 OR hiring_tag THEN 'hiring_intent' WHEN len(pain) > 0 THEN 'pain_point'
      WHEN {help_column} THEN 'help_request' ELSE 'unknown' END AS intent_tag
  FROM gated g LEFT JOIN totals t USING (id)),
flagged AS (
  SELECT *, dry_rule IS NULL AS passed, dry_rule IS NULL AND score >= 10 AS would_notify,
    CASE intent_tag WHEN 'unknown' THEN false WHEN 'help_request' THEN score >= {help_min} ELSE true END AS needs
  FROM replayed)"""


BASE = f"WITH {ITEMS},{FEATURES}"
MATCHED = f"{BASE},{SOURCES},{TERMS}"
GATED = f"{MATCHED},{GATES}"
SCORED = f"{GATED},{score_relations()}"

SIMHASH = """
tokens AS (
  SELECT id, ('0x' || substr(md5(token), 1, 16))::UBIGINT AS h
  FROM (SELECT id, unnest(regexp_extract_all(text_norm, '(?i)[a-zа-я0-9_]{3,}')) AS token FROM normed)),
sizes AS (SELECT id, count(*) AS n FROM tokens GROUP BY id),
bits AS (
  SELECT id, b, sum(CAST((h >> b) & 1 AS BIGINT)) AS ones
  FROM tokens, (SELECT unnest(range(0, 64))::UBIGINT AS b) GROUP BY id, b),
majority AS (
  SELECT id, sum(CASE WHEN 2 * ones > n THEN CAST(1::UBIGINT << b AS HUGEINT) ELSE 0 END) AS u
  FROM bits JOIN sizes USING (id) GROUP BY id),
hashes AS (
  SELECT id, ts, sha256(text_norm) AS text_hash, coalesce(u, 0) AS u,
    CAST(CASE WHEN coalesce(u, 0) >= 9223372036854775808 THEN u - 18446744073709551616 ELSE coalesce(u, 0) END AS BIGINT) AS simhash
  FROM normed LEFT JOIN majority USING (id))"""
HASHED = f"WITH {ITEMS},{SIMHASH}"


def duplicate_relations(hashes: str = "hashes") -> str:
    return f"""
exact AS (
  SELECT x.id, arg_min(y.id, (y.ts, y.id)) AS original
  FROM {hashes} x JOIN {hashes} y ON x.text_hash = y.text_hash
    AND (y.ts, y.id) < (x.ts, x.id) AND y.ts >= x.ts - INTERVAL 30 DAY GROUP BY x.id),
close AS (
  SELECT x.id, y.id AS other, y.ts AS other_ts, bit_count(xor(x.simhash, y.simhash)) AS distance
  FROM {hashes} x JOIN {hashes} y ON (y.ts, y.id) < (x.ts, x.id) AND y.ts >= x.ts - INTERVAL 14 DAY
    AND bit_count(xor(x.simhash, y.simhash)) <= 3),
near AS (
  SELECT id, arg_min(other, (CASE WHEN distance = 0 THEN 0 ELSE 1 END, other_ts, other)) AS original
  FROM close GROUP BY id),
dups AS (
  SELECT coalesce(e.id, n.id) AS id, coalesce(e.original, n.original) AS duplicate_of
  FROM exact e FULL JOIN near n ON e.id = n.id)"""


MATCHES = f"""
matches AS (
  SELECT doc_id AS id, doc_id AS raw_item_id,
    CASE WHEN doc_id % 5 = 0 THEN 'browse' ELSE 'main' END AS circuit,
    n_chars % 30 AS score,
    ['hiring_intent', 'pain_point', 'both', 'help_request', 'unknown'][doc_id % 5 + 1] AS intent_tag,
    left(trim(string_split(text, chr(10))[1], {WS}), 90) AS headline,
    CASE WHEN doc_id % 3 = 0 THEN 's ' || lang END AS llm_summary_ru,
    CASE WHEN doc_id % 4 = 0 THEN (doc_id % 100) || ' usd' END AS compensation,
    CASE WHEN doc_id % 6 = 0 THEN 'rules_only' ELSE 'rules' END AS decided_by,
    CASE WHEN doc_id % 6 = 0 THEN 'failed' ELSE 'not_needed' END AS llm_status,
    doc_id % 3 AS duplicate_count, doc_id % 10 = 0 AS is_favorite,
    CASE doc_id % 8 WHEN 5 THEN 'suppressed' WHEN 6 THEN 'digest_pending' WHEN 7 THEN 'new' ELSE 'notified' END AS status,
    CASE WHEN doc_id % 8 < 5 THEN {minutes('doc_id + 5')} END AS notified_at,
    {minutes('(doc_id // 3) * 3')} AS created_at
  FROM documents)"""
RAW = f"""
raw_items AS (
  SELECT doc_id AS id, source, 'user' || (doc_id % 50) AS author_handle,
    'https://example.test/' || doc_id AS permalink, string_split(text, chr(10))[1] AS title, text,
    {minutes('doc_id')} AS posted_at, {minutes('doc_id')} AS created_at,
    CASE doc_id % 4 WHEN 1 THEN 'HF-2_no_signal' WHEN 2 THEN 'duplicate' END AS reject_rule
  FROM documents)"""
FEEDBACK = f"""
feedback AS (
  SELECT doc_id AS id, doc_id AS match_id, CASE WHEN quality = 0 OR doc_id % 10 = 7 THEN 'bad' ELSE 'good' END AS verdict,
    {minutes('doc_id')} AS created_at FROM labels WHERE doc_id % 10 <> 8)"""
USAGE = """
usage_log AS (
  SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'browse' END AS circuit,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'quota_exhausted' ELSE 'ok' END AS outcome,
    ts AS created_at FROM events)"""
STORED = f"WITH {MATCHES},{RAW},{FEEDBACK},{USAGE}"

CRM = f"""
keyed AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
commands AS (
  SELECT event_id AS cmd_id, ts, user_id AS match_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'contact' WHEN event_type = 'purchase' THEN 'response'
      WHEN event_type = 'signup' THEN 'earnings' WHEN k % 25 = 0 THEN 'delete' ELSE 'response' END AS kind,
    CASE WHEN event_type = 'view' THEN CASE WHEN k % 40 = 0 THEN 'not_contacted' ELSE 'postponed' END
      WHEN event_type = 'click' THEN 'contacted' END AS contact_state,
    CASE WHEN k % 30 = 7 THEN '' ELSE 'reply ' || k END AS reply_text,
    CASE WHEN event_type = 'purchase' THEN true WHEN k % 3 = 0 THEN false END AS taken,
    CASE WHEN k % 50 = 3 THEN NULL ELSE CAST(round(value, 2) AS DECIMAL(12,2)) END AS amount,
    CASE WHEN k % 45 = 4 THEN 'usd' WHEN k % 4 = 1 THEN 'EUR' WHEN k % 4 = 2 THEN 'USD' ELSE 'GBP' END AS currency
  FROM keyed),
parsed AS (
  SELECT c.*, m.id IS NOT NULL AS known,
    CASE kind WHEN 'contact' THEN contact_state <> 'not_contacted' WHEN 'response' THEN reply_text <> ''
      WHEN 'earnings' THEN amount IS NOT NULL AND currency <> 'usd' ELSE true END AS valid
  FROM commands c LEFT JOIN (SELECT id FROM matches WHERE status = 'notified') m ON m.id = c.match_id),
step1 AS (
  SELECT *, last_value(CASE WHEN valid AND kind = 'contact' THEN contact_state END IGNORE NULLS) OVER w AS state_before,
    coalesce(bool_or(kind = 'delete') OVER w, false) AS deleted_before
  FROM parsed WINDOW w AS (PARTITION BY match_id ORDER BY ts, cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
step2 AS (
  SELECT *, last_value(CASE WHEN valid AND known AND NOT deleted_before AND kind = 'response' AND state_before = 'contacted'
      THEN CASE WHEN taken THEN 'yes' ELSE 'other' END END IGNORE NULLS) OVER w AS answer_before
  FROM step1 WINDOW w AS (PARTITION BY match_id ORDER BY ts, cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
step3 AS (
  SELECT *, valid AND known AND NOT deleted_before AND kind = 'earnings' AND coalesce(answer_before = 'yes', false) AS books
  FROM step2),
step4 AS (
  SELECT *, coalesce(bool_or(books) OVER w, false) AS booked
  FROM step3 WINDOW w AS (PARTITION BY match_id ORDER BY ts, cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
outcomes AS (
  SELECT *, CASE WHEN NOT valid THEN 422 WHEN NOT known THEN 404 WHEN kind = 'delete' THEN 204 WHEN deleted_before THEN 404
      WHEN kind = 'response' AND (coalesce(state_before, '') <> 'contacted' OR (booked AND NOT coalesce(taken, false))) THEN 400
      WHEN kind = 'earnings' AND NOT booked AND NOT books THEN 400 ELSE 200 END AS outcome
  FROM step4),
crm AS (
  SELECT match_id,
    coalesce(arg_max(contact_state, (ts, cmd_id)) FILTER (kind = 'contact'), 'not_contacted') AS contact_state,
    arg_max(reply_text, (ts, cmd_id)) FILTER (kind = 'response') AS reply_text,
    (arg_max(struct_pack(t := taken), (ts, cmd_id)) FILTER (kind = 'response')).t AS taken_in_work,
    arg_max(amount, (ts, cmd_id)) FILTER (kind = 'earnings') AS earnings,
    arg_max(currency, (ts, cmd_id)) FILTER (kind = 'earnings') AS currency,
    min(ts) FILTER (kind = 'contact' AND contact_state = 'contacted') AS contacted_at,
    min(ts) FILTER (kind = 'response' AND taken) AS in_work_at,
    min(ts) FILTER (kind = 'delete') AS deleted_at,
    min(ts) AS created_at, max(ts) AS updated_at
  FROM outcomes WHERE outcome IN (200, 204) GROUP BY match_id),
leads AS (
  SELECT m.*, r.source, r.permalink, r.title, r.text, r.posted_at, c.match_id AS crm_id,
    coalesce(c.contact_state, 'not_contacted') AS state, c.contact_state, c.reply_text, c.taken_in_work,
    c.earnings, c.currency, c.contacted_at, c.deleted_at
  FROM matches m JOIN raw_items r ON r.id = m.raw_item_id LEFT JOIN crm c ON c.match_id = m.id
  WHERE m.status = 'notified'),
visible AS (SELECT * FROM leads WHERE deleted_at IS NULL)"""
FUNNEL = f"{STORED},{CRM}"
_LEAD = f"""id, headline, score, intent_tag, source, circuit, strftime(created_at, {MICROS}) AS created_at,
  state AS contact_state, taken_in_work, CAST(earnings AS VARCHAR) AS earnings, currency"""

# --- texts ---------------------------------------------------------------------------------

ORACLE["raw_text"] = f"WITH {ITEMS} SELECT id, raw AS text FROM tagged"
ORACLE["extract_tag"] = f"WITH {ITEMS} SELECT id, tag FROM tagged"
ORACLE["struct_features"] = f"{BASE} SELECT * FROM features"
ORACLE["normalize_text"] = f"WITH {ITEMS} SELECT id, plain_norm AS text_norm FROM cleaned"
ORACLE["apply_aliases"] = f"WITH {ITEMS} SELECT id, text_norm FROM normed"
ORACLE["headline"] = f"WITH {ITEMS} SELECT id, left(trim(title, {WS}), 90) AS headline FROM items"
ORACLE["matched_terms"] = (
    f"WITH {ITEMS} SELECT id, "
    + ", ".join(
        f"array_to_string(list_sort({_terms(words)}), ',') AS {kind}"
        for kind, words in (
            ("stack", STACK), ("hiring", HIRING), ("pain", PAIN), ("money", MONEY), ("noise", NOISE),
        )
    )
    + " FROM masked"
)
ORACLE["match_positions"] = (
    f"WITH {ITEMS} SELECT id, array_to_string({_starts(_pattern(STACK))}, ',') AS positions FROM masked"
)
ORACLE["near_positions"] = f"""WITH {ITEMS},
firsts AS (SELECT id, masked, {_starts(_pattern(CLOSED))}[1] AS closed, {_starts(_pattern(HIRING))}[1] AS hiring FROM masked),
numbers AS (SELECT id, closed, hiring, {_token('closed')} AS c, {_token('hiring')} AS h FROM firsts)
SELECT id, CASE WHEN closed IS NOT NULL THEN c END AS closed_token,
  CASE WHEN hiring IS NOT NULL THEN h END AS hiring_token,
  CASE WHEN closed IS NOT NULL AND hiring IS NOT NULL THEN abs(c - h) <= 6 END AS is_near FROM numbers"""
ORACLE["contact_extract"] = (
    f"WITH {ITEMS} SELECT id, CASE WHEN regexp_matches(masked, '{_CONTACT}') THEN "
    f"regexp_extract(masked, '{_CONTACT}') END AS contact FROM masked"
)
ORACLE["compensation_extract"] = f"""WITH {ITEMS},
turns AS (SELECT 'turn' AS kind, conv_id * 1000 + turn AS id,
  regexp_replace(lower(text), '[^\\x00-\\x7f]', '_', 'g') AS t FROM conversations),
asked AS (SELECT 'doc' AS kind, id, masked AS t FROM masked UNION ALL SELECT * FROM turns)
SELECT kind, id, CASE WHEN regexp_matches(t, '{_MONEY_AMOUNT}') THEN regexp_extract(t, '{_MONEY_AMOUNT}') END AS compensation
FROM asked"""
ORACLE["section_headers"] = (
    f"WITH {ITEMS} SELECT id, regexp_matches(text_norm, '{fixed.SECTION_PATTERN}') AS found FROM normed"
)
def _unescaped(text: str) -> str:
    """The entities that the test pages hold, the ampersand last and also without its end."""
    for entity, plain in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{entity}', '{plain}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


ORACLE["body_extract"] = f"""WITH blocks AS (
  SELECT page_id, regexp_matches(html, '(?s)<article>(.*?)</article>') AS has_body,
    regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS block FROM pages),
bare AS (SELECT *, {_unescaped(_unescaped("regexp_replace(block, '<[^>]+>', ' ', 'g')"))} AS t FROM blocks)
SELECT page_id, has_body, trim(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) AS body
FROM bare"""

# --- hashes and duplicates -----------------------------------------------------------------

ORACLE["text_hash"] = f"WITH {ITEMS} SELECT id, sha256(text_norm) AS hash FROM normed"
ORACLE["simhash_md5"] = f"{HASHED} SELECT id, simhash FROM hashes"
ORACLE["simhash_bands"] = f"""{HASHED}, indexes AS (SELECT unnest(range(0, 4)) AS band)
SELECT id, band, CAST((CAST(u AS UBIGINT) >> CAST(16 * band AS UBIGINT)) & 65535 AS BIGINT) AS value FROM hashes, indexes"""
ORACLE["simhash_unsigned"] = (
    f"{HASHED} SELECT id, CAST(u AS VARCHAR) AS unsigned, simhash AS signed FROM hashes"
)
ORACLE["exact_dups"] = f"{HASHED},{duplicate_relations()} SELECT id, original FROM exact"
ORACLE["near_dups"] = f"""{HASHED},{duplicate_relations()}
SELECT n.id, n.original, CAST(bit_count(xor(a.simhash, b.simhash)) AS BIGINT) AS distance
FROM near n JOIN hashes a ON a.id = n.id JOIN hashes b ON b.id = n.original"""
ORACLE["all_dups"] = f"{HASHED},{duplicate_relations()} SELECT id, duplicate_of FROM dups"
ORACLE["dup_counts"] = f"""{HASHED},{duplicate_relations()}
SELECT duplicate_of AS match_id, duplicate_of AS raw_item_id, count(*) AS duplicate_count FROM dups GROUP BY duplicate_of"""

# --- gates and scores ----------------------------------------------------------------------

ORACLE["help_request"] = f"{MATCHED} SELECT id, help_request FROM asked"
ORACLE["hf_each"] = f"{GATED} SELECT id, hf1, hf2, hf3, hf4, hf5, hf6 FROM gated"
ORACLE["hf_chain"] = (
    f"{GATED} SELECT id, circuit, coalesce(hf1, hf2, hf3, hf4, hf5, hf6) AS reject_rule FROM gated"
)
ORACLE["reject_counts"] = (
    f"{GATED} SELECT coalesce(hf1, hf2_all, hf3, hf4_all, hf5, hf6) AS reject_rule, count(*) AS items "
    "FROM gated WHERE coalesce(hf1, hf2_all, hf3, hf4_all, hf5, hf6) IS NOT NULL GROUP BY 1"
)
_SUMMARY = """SELECT count(*) AS items, count(*) FILTER (passed) AS passed, count(*) FILTER (would_notify) AS would_notify,
  count(*) FILTER (passed AND needs) AS would_classify, count(*) FILTER (would_notify AND NOT needs) AS would_translate,
  count(*) FILTER ((passed AND needs) OR would_notify) AS calls FROM flagged"""
ORACLE["dry_run_summary"] = f"{SCORED} {_SUMMARY}"
_NO_HELP = TERMS.replace("AS help_request", "AND false AS help_request")
ORACLE["dry_run_without_help"] = f"{BASE},{SOURCES},{_NO_HELP},{GATES},{score_relations()} {_SUMMARY}"
ORACLE["passed_by_intent"] = (
    f"{SCORED} SELECT intent_tag, count(*) AS items FROM replayed WHERE dry_rule IS NULL GROUP BY intent_tag"
)
ORACLE["top_candidates"] = (
    f"{SCORED} SELECT id, score, intent_tag, source_name AS source, left(title, 100) AS title, "
    "(SELECT string_agg(rule || '=' || points, ',' ORDER BY rule) FROM fired WHERE fired.id = replayed.id) AS signals "
    "FROM replayed WHERE dry_rule IS NULL ORDER BY score DESC, id LIMIT 10"
)
ORACLE["translate_set"] = (
    f"{GATED},{score_relations(help_min=100)} SELECT id, score FROM flagged WHERE would_notify "
    "EXCEPT SELECT id, score FROM flagged WHERE passed AND needs"
)
ORACLE["last_items"] = (
    f"{STORED} SELECT id, strftime(created_at, {MICROS}) AS created_at FROM raw_items "
    "ORDER BY raw_items.created_at DESC, id DESC LIMIT 100"
)
ORACLE["score_layers"] = f"""{MATCHED} SELECT id, CAST(least({_weights('stack', STACK)}, 9) AS BIGINT) AS stack,
  CAST(least({_weights('hiring', HIRING)} + {_weights('pain', PAIN)} + {_weights('money', MONEY)}, 8) AS BIGINT) AS intent,
  CAST(greatest({_weights('noise', NOISE)}, -8) AS BIGINT) AS noise FROM asked"""
ORACLE["score_total"] = f"{SCORED} SELECT id, score, fired FROM replayed"
ORACLE["signals_explode"] = (
    f"{SCORED} SELECT id, rule, points, CASE WHEN points >= 0 THEN '+' ELSE '' END || points AS label FROM fired"
)
ORACLE["intent_tags"] = (
    f"{SCORED} SELECT id, intent_tag, {_choice('intent_tag', fixed.INTENT_LABELS)} AS label FROM replayed"
)
_HINT_HEAD, _HINT_REST = fixed.HINT_SCORE.split("{score}")
_BROWSE_HEAD, _BROWSE_TAIL = fixed.HINT_BROWSE.split("{circuit}")
ORACLE["decision_modes"] = f"""{SCORED} SELECT id,
  CASE WHEN circuit <> 'main' OR needs THEN 'classify_and_translate' WHEN score >= 10 THEN 'translate' END AS mode,
  CASE WHEN circuit <> 'main' THEN {_quoted(_BROWSE_HEAD)} || circuit || {_quoted(_BROWSE_TAIL)}
    WHEN needs THEN {_quoted(_HINT_HEAD)} || score || {_quoted(_HINT_REST.format(threshold=10))}
      || CASE intent_tag WHEN 'pain_point' THEN {_quoted('; ' + fixed.HINT_PAIN)}
         WHEN 'help_request' THEN {_quoted('; ' + fixed.HINT_HELP)} ELSE '' END
    ELSE '' END AS rule_hint,
  score >= 10 AS rules_notify FROM flagged"""
ORACLE["classifier_worklist"] = f"""{SCORED} SELECT id, circuit,
  CASE WHEN circuit <> 'main' OR needs THEN 'classify_and_translate' ELSE 'translate' END AS mode,
  CASE circuit WHEN 'main' THEN 'strict' ELSE 'browse' END AS prompt_variant,
  md5(left('Источник: ' || source_name || chr(10) || 'Заголовок: ' || title || chr(10) || chr(10)
    || 'Текст записи:' || chr(10) || raw, 6000)) AS item_text
FROM flagged WHERE circuit <> 'main' OR needs OR score >= 10"""

_ANSWERS = """
answers AS (
  SELECT doc_id AS id, lang, source, doc_id % 7 <> 5 AS good, doc_id % 2 = 0 AS is_lead,
    CAST('0.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS confidence,
    ['hiring_intent', 'pain_point', 'not_a_lead'][doc_id % 3 + 1] AS lead_type, 's' || doc_id AS summary_ru
  FROM documents)"""
ORACLE["verdict_parse"] = f"""WITH {_ANSWERS} SELECT id, CASE WHEN good THEN 'ok' ELSE 'error' END AS outcome,
  CASE WHEN good THEN is_lead END AS is_lead, CASE WHEN good THEN confidence END AS confidence,
  CASE WHEN good THEN lead_type END AS lead_type, CASE WHEN good THEN summary_ru END AS summary_ru,
  CASE WHEN good THEN 'a|b' END AS flags FROM answers"""
ORACLE["verdict_apply"] = f"""{STORED},{_ANSWERS},
decided AS (SELECT id, score, intent_tag, created_at, score >= 10 AS rules_notify,
  CASE raw_item_id % 4 WHEN 0 THEN 'translate' WHEN 3 THEN NULL ELSE 'classify' END AS mode FROM matches),
joined AS (SELECT d.*, a.is_lead, a.confidence, a.lead_type, a.summary_ru,
  CASE WHEN a.id IS NULL THEN NULL WHEN a.source = 'src3' THEN 'quota' WHEN a.good THEN 'ok' ELSE 'error' END AS outcome
  FROM decided d LEFT JOIN (SELECT * FROM answers WHERE lang <> 'fr') a USING (id)),
final AS (SELECT *, mode IS NOT NULL AND outcome = 'ok' AS answered,
  CASE WHEN mode IS NULL THEN rules_notify
    WHEN outcome = 'ok' THEN mode = 'translate' OR (is_lead AND confidence >= 0.55)
    WHEN outcome IS NOT NULL THEN rules_notify END AS will_notify FROM joined),
routed AS (SELECT *,
  CASE WHEN mode IS NULL THEN 'not_needed' WHEN outcome IS NULL THEN 'pending' WHEN outcome = 'ok' THEN 'done'
    WHEN outcome = 'quota' THEN 'skipped_quota' ELSE 'failed' END AS llm_status FROM final),
stated AS (SELECT *, CASE WHEN llm_status = 'pending' THEN 'awaiting_llm' WHEN NOT coalesce(will_notify, false) THEN 'suppressed'
  WHEN (hour(created_at) >= 23 OR hour(created_at) < 8) AND score < 15 THEN 'digest_pending' ELSE 'new' END AS status FROM routed)
SELECT id, CASE WHEN mode IS NULL OR outcome IS NULL THEN 'rules' WHEN outcome = 'ok' THEN 'llm' ELSE 'rules_only' END AS decided_by,
  llm_status, CASE WHEN answered AND lead_type <> 'not_a_lead' THEN lead_type ELSE intent_tag END AS intent_tag,
  CASE WHEN answered THEN summary_ru END AS llm_summary_ru, CASE WHEN answered THEN confidence END AS llm_prob,
  will_notify, status, CASE status WHEN 'digest_pending' THEN 'digest' WHEN 'new' THEN 'notify' END AS queue FROM stated"""
ORACLE["quiet_route"] = """WITH timed AS (
  SELECT event_id, event_type, floor(value) AS score, hour(ts) >= 23 OR hour(ts) < 8 AS quiet FROM events),
stated AS (SELECT *, CASE WHEN event_type = 'error' THEN 'suppressed' WHEN quiet AND score < 15 THEN 'digest_pending' ELSE 'new' END AS status FROM timed)
SELECT event_id, quiet, status, CASE status WHEN 'digest_pending' THEN 'digest' WHEN 'new' THEN 'notify' END AS queue FROM stated"""

# --- sources and items ---------------------------------------------------------------------

_NOW = "TIMESTAMP '2024-01-01 09:00:00'"
ORACLE["source_gate"] = f"""WITH {ITEMS},{SOURCES} SELECT i.id, s.name AS source, s.circuit, s.category, s.priority
FROM items i JOIN sources s ON lower(s.name) = lower(i.source)
WHERE s.enabled AND NOT coalesce(s.muted_until > {_NOW}, false)"""
ORACLE["active_sources"] = f"WITH {SOURCES} SELECT name, circuit FROM sources WHERE enabled"
ORACLE["active_sources_fallback"] = f"""WITH {SOURCES},
seeds AS (SELECT unnest({_listed(name for name, _, _ in fixed.SOURCES_MAIN)}) AS name)
SELECT name FROM seeds WHERE (SELECT count(*) FROM sources WHERE false) = 0"""
ORACLE["sources_listing"] = f"""WITH {SOURCES} SELECT category, name, priority,
  concat_ws(', ', CASE WHEN NOT enabled THEN 'off' END, CASE WHEN muted_until > {_NOW} THEN 'muted' END) AS flags FROM sources"""
ORACLE["stale_filter"] = f"""WITH {ITEMS} SELECT id FROM items
WHERE id % 9 IN (4, 5) OR ts >= TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 360 MINUTE"""
ORACLE["first_seen"] = f"""WITH RECURSIVE firsts AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL
  SELECT f.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = f.user_id AND e.ts > f.ts + INTERVAL 1 DAY)
  FROM firsts f WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.user_id AND e.ts > f.ts + INTERVAL 1 DAY)
), ids AS (SELECT e.user_id, e.ts, min(event_id) AS event_id FROM events e JOIN firsts USING (user_id, ts) GROUP BY ALL)
SELECT 'item' || e.user_id AS item_id, strftime(e.ts, {MICROS}) AS ts, e.event_id AS id, i.event_id IS NOT NULL AS is_first
FROM events e LEFT JOIN ids i ON i.user_id = e.user_id AND i.event_id = e.event_id"""
ORACLE["cycle_counts"] = f"""WITH {ITEMS}, marked AS (
  SELECT id, ts < TIMESTAMP '2024-01-01 06:00:00' AS stale FROM items)
SELECT count(*) AS entries, count(*) FILTER (NOT stale AND id % 6 <> 5) AS published, count(*) FILTER (stale) AS skipped_old FROM marked"""
ORACLE["feed_profile"] = f"""WITH {ITEMS} SELECT count(*) AS entries, count(*) FILTER (has_body) AS with_body,
  count(*) FILTER (NOT has_body) AS link_only, count(DISTINCT source) AS sources FROM items"""
ORACLE["message_parse"] = f"""WITH {ITEMS}, named AS (
  SELECT *, id % 29 = 6 AS broken FROM tagged)
SELECT CASE WHEN broken THEN 'not_json' WHEN id % 17 = 3 THEN 'no_source' WHEN id % 19 = 4 THEN 'no_title'
    WHEN id % 23 = 5 THEN 'bad_posted_at' END AS problem,
  CASE WHEN NOT broken THEN item_id END AS item_id, CASE WHEN NOT broken AND id % 17 <> 3 THEN source END AS source,
  CASE WHEN NOT broken AND id % 19 <> 4 THEN title END AS title, md5(CASE WHEN broken THEN '' ELSE body END) AS body,
  NOT broken AND has_body AS has_body, CASE WHEN NOT broken AND id % 19 <> 4 THEN tag END AS tag,
  CASE WHEN NOT broken AND id % 23 <> 5 THEN strftime(ts, {MICROS}) END AS posted_at, true AS kept FROM named"""
ORACLE["atom_entries"] = f"""WITH {ITEMS} SELECT item_id, source, md5(title) AS title,
  md5(trim(regexp_replace(regexp_replace(body, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})) AS body,
  has_body, tag, author_handle, permalink, strftime(ts, {MICROS}) AS posted_at FROM tagged WHERE id % 31 <> 7"""

# --- authors, feedback, reports ------------------------------------------------------------

_SINCE = "TIMESTAMP '2024-01-01 05:00:00'"
_COUNTERS = """
counters AS (SELECT r.author_handle AS handle, count(*) FILTER (f.verdict = 'good') AS good_count,
  count(*) FILTER (f.verdict = 'bad') AS bad_count
  FROM feedback f JOIN matches m ON m.id = f.match_id JOIN raw_items r ON r.id = m.raw_item_id GROUP BY 1)"""
ORACLE["author_counters"] = f"{STORED},{_COUNTERS} SELECT * FROM counters"
ORACLE["author_bonus"] = f"""{STORED},{_COUNTERS} SELECT r.author_handle, r.id,
  CASE WHEN coalesce(good_count, 0) >= 3 THEN 2 WHEN coalesce(bad_count, 0) >= 5 AND coalesce(good_count, 0) = 0 THEN -5 ELSE 0 END AS author_bonus
FROM raw_items r LEFT JOIN counters c ON c.handle = r.author_handle"""
_VOTES = f"""votes AS (SELECT count(*) FILTER (verdict = 'good') AS good, count(*) FILTER (verdict = 'bad') AS bad
  FROM feedback WHERE created_at >= {_SINCE})"""
ORACLE["period_stats"] = f"""{STORED},{_VOTES} SELECT
  (SELECT count(*) FROM raw_items WHERE created_at >= {_SINCE}) AS seen,
  (SELECT count(*) FROM matches WHERE created_at >= {_SINCE}) AS matched,
  (SELECT count(*) FROM matches WHERE created_at >= {_SINCE} AND status = 'notified') AS notified,
  good, bad, CASE WHEN good + bad > 0 THEN good::DOUBLE / (good + bad) END AS precision FROM votes"""
_TOP_BAD = f"""top_bad AS (SELECT r.source, count(*) AS bad FROM feedback f JOIN matches m ON m.id = f.match_id
  JOIN raw_items r ON r.id = m.raw_item_id WHERE f.created_at >= {_SINCE} AND f.verdict = 'bad'
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"""
_USED = """
minutes AS (SELECT circuit, date_trunc('minute', created_at) AS minute, count(*) AS n FROM usage_log
  WHERE created_at <= TIMESTAMP '2024-01-10 12:00:00' AND created_at >= TIMESTAMP '2024-01-10' GROUP BY ALL),
used AS (SELECT circuit, sum(least(n, 1)) AS day_used,
  coalesce(sum(n) FILTER (minute = TIMESTAMP '2024-01-10 12:00:00'), 0) AS min_used FROM minutes GROUP BY circuit)"""
ORACLE["weekly_report"] = f"""{STORED},{_VOTES},{_TOP_BAD},{_USED}
SELECT 'notified' AS section, 'all' AS name, count(*)::DOUBLE AS value FROM matches WHERE notified_at >= {_SINCE}
UNION ALL SELECT 'feedback', 'good', good FROM votes UNION ALL SELECT 'feedback', 'bad', bad FROM votes
UNION ALL SELECT 'precision', 'all', CASE WHEN good + bad > 0 THEN good::DOUBLE / (good + bad) END FROM votes
UNION ALL SELECT 'calls', outcome, count(*) FROM usage_log WHERE created_at >= {_SINCE} GROUP BY outcome
UNION ALL SELECT 'bad_by_source', source, bad FROM top_bad
UNION ALL SELECT 'quota', circuit || ' day_used', day_used FROM used
UNION ALL SELECT 'quota', circuit || ' min_used', min_used FROM used"""
ORACLE["weekly_top_bad"] = f"{STORED},{_TOP_BAD} SELECT * FROM top_bad"
ORACLE["calls_by_outcome"] = (
    f"{STORED} SELECT outcome, count(*) AS calls FROM usage_log WHERE created_at >= TIMESTAMP '2024-01-10' GROUP BY 1"
)
ORACLE["circuit_outcomes"] = f"{STORED} SELECT circuit, outcome, count(*) AS calls FROM usage_log GROUP BY ALL"
ORACLE["quota_admission"] = f"""{STORED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY circuit, date_trunc('minute', created_at) ORDER BY created_at, id) AS m FROM usage_log),
admitted AS (SELECT id, row_number() OVER (PARTITION BY circuit, CAST(created_at AS DATE) ORDER BY created_at, id) AS d FROM ranked WHERE m <= 1)
SELECT r.id, circuit, strftime(created_at, {MICROS}) AS ts,
  CASE WHEN d IS NULL THEN 'minute_limit' WHEN d <= 50 THEN 'ok' ELSE 'day_limit' END AS admission
FROM ranked r LEFT JOIN admitted a ON a.id = r.id"""
ORACLE["quota_usage"] = f"""{STORED},
minutes AS (SELECT circuit, date_trunc('minute', created_at) AS minute, count(*) AS n FROM usage_log
  WHERE created_at <= TIMESTAMP '2024-01-10 12:00:00' AND created_at >= TIMESTAMP '2024-01-10' GROUP BY ALL)
SELECT circuit, CAST(sum(least(n, 1)) AS BIGINT) AS day_used, 900 AS day_limit,
  CAST(coalesce(sum(n) FILTER (minute = TIMESTAMP '2024-01-10 12:00:00'), 0) AS BIGINT) AS min_used, 1 AS min_limit
FROM minutes GROUP BY circuit"""
ORACLE["rate_cap"] = f"""WITH per_time AS (SELECT ts, count(*) AS sent FROM events GROUP BY ts),
counted AS (SELECT ts, sent, CAST(sum(sent) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM per_time)
SELECT strftime(ts, {MICROS}) AS ts, sent, in_window, in_window > 2 AS over_cap FROM counted"""
ORACLE["send_times"] = f"""WITH RECURSIVE queue AS (
  SELECT event_id AS id, ts, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
sent AS (
  SELECT id, ts, n, ts AS sent_at FROM queue WHERE n <= 3
  UNION ALL
  SELECT q.id, q.ts, q.n, greatest(q.ts, s.sent_at + INTERVAL 600 SECOND) FROM sent s JOIN queue q ON q.n = s.n + 3)
SELECT id, strftime(ts, {MICROS}) AS ts, strftime(sent_at, {MICROS}) AS sent_at FROM sent"""
ORACLE["heartbeat_gaps"] = f"""WITH linked AS (
  SELECT 'c' || user_id AS circuit, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT circuit, strftime(before, {MICROS}) AS silent_from, strftime(ts, {MICROS}) AS silent_to,
  (epoch_us(ts) - epoch_us(before)) / 1000000.0::DOUBLE AS gap_seconds FROM linked
WHERE epoch_us(ts) - epoch_us(before) > 900000000"""
ORACLE["silent_circuits"] = f"""WITH monitored AS (SELECT DISTINCT 'c' || user_id AS circuit FROM events),
beats AS (SELECT 'c' || user_id AS circuit, max(ts) AS last_beat FROM events WHERE value > 100 GROUP BY 1),
ages AS (SELECT circuit, last_beat, CAST(epoch(TIMESTAMP '2024-01-30') - floor(epoch(last_beat)) AS BIGINT) AS silent_seconds
  FROM monitored LEFT JOIN beats USING (circuit))
SELECT circuit, strftime(last_beat, {MICROS}) AS last_beat, silent_seconds FROM ages WHERE last_beat IS NULL OR silent_seconds > 900"""
ORACLE["digest_top"] = f"""{STORED} SELECT m.id, m.score, r.source, left(coalesce(nullif(m.llm_summary_ru, ''), m.headline), 200) AS summary,
  r.permalink, strftime(m.created_at, {MICROS}) AS created_at,
  (SELECT count(*) FROM matches WHERE status = 'digest_pending') AS total
FROM matches m JOIN raw_items r ON r.id = m.raw_item_id WHERE m.status = 'digest_pending' ORDER BY m.created_at, m.id LIMIT 30"""
ORACLE["card_view"] = f"""{STORED} SELECT m.id, m.headline, m.score, {_choice('m.intent_tag', fixed.INTENT_LABELS)} AS intent_label,
  r.source, r.author_handle, strftime(r.posted_at, '%d.%m %H:%M') AS posted_local,
  coalesce(m.llm_summary_ru, left(r.text, 500)) AS body, m.llm_summary_ru IS NULL AS is_original,
  CASE WHEN m.id % 5 = 2 THEN 'about ' || m.id ELSE m.compensation END AS budget,
  CASE WHEN m.id % 4 = 1 THEN 'need ' || m.id END AS need,
  CASE m.id % 3 WHEN 1 THEN 'late' WHEN 2 THEN 'late, cheap' END AS flags,
  nullif(array_to_string(['spark', 'python', 'etl', 'sql', 'dbt', 'kafka', 'flink', 'hive', 'trino'][1:least(m.id % 10, {fixed.CARD_STACK_TERMS})], ' · '), '') AS stack,
  nullif(m.duplicate_count, 0) AS more_like_this, CASE WHEN m.decided_by = 'rules_only' THEN m.llm_status END AS rules_only_note
FROM matches m JOIN raw_items r ON r.id = m.raw_item_id"""
ORACLE["retention"] = f"""{STORED} SELECT id, reject_rule FROM raw_items
WHERE reject_rule IS NULL OR created_at >= TIMESTAMP '2024-01-31 08:00:00' - INTERVAL 30 DAY"""

# --- lead funnel ---------------------------------------------------------------------------

ORACLE["crm_outcomes"] = f"{FUNNEL} SELECT cmd_id, match_id, kind, outcome FROM outcomes"
ORACLE["crm_state"] = f"""{FUNNEL} SELECT match_id, contact_state, reply_text, taken_in_work, CAST(earnings AS VARCHAR) AS earnings, currency,
  {', '.join(f'strftime({c}, {MICROS}) AS {c}' for c in ('contacted_at', 'in_work_at', 'deleted_at', 'created_at', 'updated_at'))} FROM crm"""
ORACLE["crm_violations"] = """WITH keyed AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
kinds AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'contact' END AS kind,
  CASE WHEN event_type = 'view' THEN CASE WHEN k % 40 = 0 THEN 'not_contacted' ELSE 'postponed' END WHEN event_type = 'click' THEN 'contacted' ELSE 'done' END AS state,
  CASE WHEN k % 50 = 3 THEN -1.0 ELSE value END AS money,
  CASE WHEN k % 45 = 4 THEN 'usd' WHEN k % 4 = 1 THEN 'EUR' WHEN k % 4 = 2 THEN NULL ELSE 'GBP' END AS currency,
  event_type = 'purchase' AS taken FROM keyed),
rules AS (SELECT event_id, unnest([
  CASE WHEN state = 'done' THEN 'contact_state_known' END, CASE WHEN currency = 'usd' THEN 'currency_format' END,
  CASE WHEN money < 0 THEN 'earnings_not_negative' END, CASE WHEN NOT taken THEN 'earnings_need_work' END,
  CASE WHEN state = 'contacted' AND event_id % 2 <> 0 THEN 'contacted_needs_time' END,
  CASE WHEN taken AND event_id % 3 <> 0 THEN 'work_needs_time' END]) AS rule FROM kinds)
SELECT event_id AS match_id, rule FROM rules WHERE rule IS NOT NULL"""
ORACLE["funnel_stats"] = f"""{FUNNEL} SELECT count(*) FILTER (deleted_at IS NULL) AS total_leads,
  {', '.join(f"count(*) FILTER (deleted_at IS NULL AND state = '{s}') AS {s}" for s in ('not_contacted', 'contacted', 'postponed'))},
  count(*) FILTER (deleted_at IS NULL AND taken_in_work IS TRUE) AS in_work,
  count(*) FILTER (deleted_at IS NULL AND taken_in_work IS FALSE) AS no_deal,
  count(*) FILTER (deleted_at IS NOT NULL) AS removed FROM leads"""
ORACLE["earnings_by_currency"] = (
    f"{FUNNEL} SELECT currency, CAST(CAST(sum(earnings) AS DECIMAL(22,2)) AS VARCHAR) AS amount FROM crm "
    "WHERE earnings IS NOT NULL GROUP BY currency"
)
ORACLE["lead_filters"] = (
    f"{FUNNEL} SELECT state AS slice, id FROM visible WHERE state IN ('not_contacted', 'contacted', 'postponed') "
    "UNION ALL SELECT 'in_work', id FROM visible WHERE taken_in_work IS TRUE "
    "UNION ALL SELECT 'no_deal', id FROM visible WHERE taken_in_work IS FALSE"
)
ORACLE["lead_page"] = f"""{FUNNEL} SELECT {_LEAD}, (SELECT count(*) FROM visible) AS total FROM visible
ORDER BY visible.created_at DESC, id DESC LIMIT 30 OFFSET 30"""
ORACLE["lead_page_after"] = f"""{FUNNEL} SELECT {_LEAD} FROM visible
WHERE (visible.created_at, id) < (TIMESTAMP '2024-01-01 02:00:00', 121) ORDER BY visible.created_at DESC, id DESC LIMIT 20"""
ORACLE["lead_detail"] = f"""{FUNNEL} SELECT id, score, circuit, permalink AS url, title, strftime(posted_at, {MICROS}) AS posted_at,
  md5(text) AS text, contact_state, reply_text AS response_text, taken_in_work, CAST(earnings AS VARCHAR) AS earnings,
  strftime(contacted_at, {MICROS}) AS contacted_at FROM visible"""
ORACLE["deeplink_page"] = f"""{FUNNEL},
page AS (SELECT *, 1 AS place FROM visible ORDER BY created_at DESC, id DESC LIMIT 30),
whole AS (SELECT * FROM page UNION ALL SELECT *, 0 FROM visible WHERE id = 3 AND id NOT IN (SELECT id FROM page))
SELECT {_LEAD}, place FROM whole"""
ORACLE["missing_leads"] = (
    f"{FUNNEL} SELECT match_id FROM feedback WHERE match_id NOT IN (SELECT id FROM visible)"
)
ORACLE["favorites"] = (
    f"{STORED} SELECT id, score, headline FROM matches WHERE is_favorite ORDER BY created_at DESC, id DESC LIMIT 20"
)

# --- change logs ---------------------------------------------------------------------------

_LOG = f"""
log AS (
  SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'del' ELSE 'add' END AS action,
    {_listed([*fixed.DICT_TYPES, 'slang'])}[user_id % 10 + 1] AS dict_type,
    'term ' || json_extract_string(props, '$.k') AS term,
    CASE WHEN event_type = 'view' THEN 1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) % 9 - 4 END AS weight
  FROM events),
folded AS (
  SELECT dict_type, term, arg_max(weight, (ts, id)) FILTER (action = 'add') AS weight,
    arg_max(action, (ts, id)) = 'add' AS enabled, bool_or(action = 'add') AS inserted, bool_or(action = 'del') AS removed
  FROM log WHERE dict_type <> 'slang' GROUP BY ALL)"""
ORACLE["latest_keywords"] = f"WITH {_LOG} SELECT dict_type, term, weight, enabled FROM folded WHERE inserted"
ORACLE["keywords_after_log"] = (
    f"WITH {_LOG} SELECT dict_type, term, 7 AS weight, NOT removed AS enabled, CAST(NULL AS VARCHAR) AS maps_to "
    "FROM folded WHERE inserted"
)
ORACLE["dictionary_listing"] = f"""WITH {_LOG} SELECT dict_type, count(*) OVER (PARTITION BY dict_type) AS terms, term, weight
FROM folded WHERE inserted AND enabled"""
_SEEDS = ", ".join(
    f"({_quoted(kind)}, {_quoted(term)}, {weight})" for kind, term, weight, _, _ in rule_tables.seed_keyword_rows()
)
_SEED_WEIGHTS = ", ".join(f"({_quoted(key)}, {weight})" for key, weight in fixed.RULE_WEIGHTS.items())
ORACLE["seeded_rules"] = f"""WITH {_LOG},
kept AS (SELECT dict_type, term, weight, enabled FROM folded WHERE inserted),
seeds(dict_type, term, weight) AS (VALUES {_SEEDS}), seed_weights(key, weight) AS (VALUES {_SEED_WEIGHTS}),
edited AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'has_sections' ELSE 'no_body' END AS key,
  arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS weight FROM events GROUP BY 1)
SELECT * FROM kept
UNION ALL SELECT dict_type, term, weight, true FROM seeds WHERE (dict_type, term) NOT IN (SELECT (dict_type, term) FROM kept)
UNION ALL SELECT 'weight', key, weight, true FROM edited
UNION ALL SELECT 'weight', key, weight, true FROM seed_weights WHERE key NOT IN (SELECT key FROM edited)"""
ORACLE["weight_state"] = f"""WITH log AS (
  SELECT event_id AS id, ts, CASE WHEN user_id = 0 THEN '{fixed.THRESHOLD_KEY}' ELSE 'rule' || user_id END AS key,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS weight FROM events)
SELECT key, arg_max(weight, (ts, id)) AS weight FROM log GROUP BY key"""
ORACLE["source_state"] = f"""WITH {SOURCES},
keyed AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
log AS (SELECT event_id AS id, ts, 'SRC' || (user_id % 15) AS name,
  CASE event_type WHEN 'view' THEN 'mute' WHEN 'click' THEN 'unmute' ELSE 'category' END AS action,
  CASE WHEN k % 4 <> 0 THEN k ELSE 8760 END AS hours, {_listed([*fixed.CATEGORIES, 'gossip'])}[k % 9 + 1] AS category FROM keyed),
folded AS (SELECT name,
  arg_max(CASE action WHEN 'mute' THEN 'y' ELSE 'n' END, (ts, id)) FILTER (action IN ('mute', 'unmute')) AS last_mute,
  arg_max(ts + to_hours(hours), (ts, id)) FILTER (action = 'mute') AS until,
  arg_max(category, (ts, id)) FILTER (action = 'category' AND category <> 'gossip') AS category FROM log GROUP BY name)
SELECT s.name, coalesce(f.category, s.category) AS category,
  strftime(CASE f.last_mute WHEN 'y' THEN f.until WHEN 'n' THEN NULL ELSE s.muted_until END, {MICROS}) AS muted_until, s.priority
FROM sources s LEFT JOIN folded f ON f.name = s.name"""
ORACLE["source_stubs"] = f"""WITH {SOURCES} SELECT DISTINCT source AS name, 'other' AS category, 'main' AS circuit, true AS enabled, 0 AS priority
FROM documents WHERE lower(source) NOT IN (SELECT lower(name) FROM sources WHERE priority > 0)"""
ORACLE["seed_if_absent"] = f"""WITH {SOURCES} SELECT name, CASE WHEN priority > 1 THEN 'kept' ELSE category END AS category,
  circuit, enabled, priority FROM sources"""
_CLICKS = f"""
clicks AS (SELECT event_id AS id, ts, user_id AS match_id, event_type,
  {_listed([*fixed.FEEDBACK_REASONS, 'because'])}[event_id % 9 + 1] AS reason FROM events)"""
ORACLE["feedback_events"] = f"""WITH {_CLICKS} SELECT id, match_id, CASE event_type WHEN 'purchase' THEN 'good' ELSE 'bad' END AS verdict,
  CASE WHEN event_type = 'error' THEN reason END AS reason, strftime(ts, {MICROS}) AS created_at
FROM clicks WHERE event_type = 'purchase' OR (event_type = 'error' AND reason <> 'because')"""
ORACLE["favorite_matches"] = "SELECT DISTINCT user_id AS match_id FROM events WHERE event_type = 'purchase'"
ORACLE["match_status"] = f"""{STORED},
last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, max(ts) FILTER (event_type = 'purchase') AS sent FROM events GROUP BY 1)
SELECT m.id, CASE l.kind WHEN 'purchase' THEN 'notified' WHEN 'error' THEN 'suppressed' WHEN 'view' THEN 'digest_pending'
    WHEN 'click' THEN 'new' WHEN 'signup' THEN 'new' ELSE m.status END AS status,
  strftime(coalesce(l.sent, m.notified_at), {MICROS}) AS notified_at
FROM matches m LEFT JOIN last l ON l.user_id = m.id"""

# --- the whole way of an item --------------------------------------------------------------

FLOW = f"""{SCORED},{SIMHASH},
admitted AS (SELECT id FROM items i JOIN sources s ON lower(s.name) = lower(i.source)
  WHERE s.enabled AND NOT coalesce(s.muted_until > {_NOW}, false)),
entered AS (SELECT hashes.* FROM hashes JOIN admitted USING (id)),{duplicate_relations('entered')},
stored AS (SELECT r.*, d.duplicate_of, CASE WHEN d.id IS NOT NULL THEN 'duplicate' ELSE r.live_rule END AS reject_rule
  FROM flagged r JOIN entered e ON e.id = r.id LEFT JOIN dups d ON d.id = r.id)"""
ORACLE["item_flow"] = f"{FLOW} SELECT id, source_name AS source, circuit, reject_rule, duplicate_of FROM stored"
ORACLE["item_stream"] = ORACLE["item_flow"]
_FLOW_AUTHORS = f"{MATCHES},{RAW},{FEEDBACK},{_COUNTERS}"
ORACLE["item_flow_matches"] = f"""{FLOW},{_FLOW_AUTHORS},
pointed AS (SELECT s.id, s.ts, s.intent_tag, s.score
    + CASE WHEN coalesce(good_count, 0) >= 3 THEN 2 WHEN coalesce(bad_count, 0) >= 5 AND coalesce(good_count, 0) = 0 THEN -5 ELSE 0 END AS score
  FROM stored s LEFT JOIN counters c ON c.handle = s.author_handle WHERE s.reject_rule IS NULL),
routed AS (SELECT *, CASE WHEN score < 10 THEN 'suppressed'
  WHEN score < 15 THEN 'digest_pending' ELSE 'new' END AS status FROM pointed)
SELECT id, score, intent_tag, status, CASE status WHEN 'digest_pending' THEN 'digest' WHEN 'new' THEN 'notify' END AS queue,
  'not_needed' AS llm_status FROM routed"""
# The moment of the decision, 09:00 UTC, is 01:00 in the reader's zone: quiet for all items.
_ROUTED = f"""{FLOW},{_FLOW_AUTHORS},
pointed AS (SELECT s.*, s.score
    + CASE WHEN coalesce(good_count, 0) >= 3 THEN 2 WHEN coalesce(bad_count, 0) >= 5 AND coalesce(good_count, 0) = 0 THEN -5 ELSE 0 END AS total
  FROM stored s LEFT JOIN counters c ON c.handle = s.author_handle WHERE s.reject_rule IS NULL),
routed AS (SELECT *, left(trim(title, {WS}), 90) AS headline,
  CASE WHEN total < 10 THEN 'suppressed' WHEN total < 15 THEN 'digest_pending' ELSE 'new' END AS status FROM pointed)"""
ORACLE["flow_cards"] = f"""{_ROUTED} SELECT id, headline, total AS score, {_choice('intent_tag', fixed.INTENT_LABELS)} AS intent_label,
  source_name AS source, author_handle, strftime(ts, '%d.%m %H:%M') AS posted_local, left(raw, 500) AS body, true AS is_original,
  CAST(NULL AS VARCHAR) AS need, CAST(NULL AS VARCHAR) AS flags, CAST(NULL AS BIGINT) AS more_like_this,
  CAST(NULL AS VARCHAR) AS rules_only_note FROM routed"""
ORACLE["flow_digest"] = f"""{_ROUTED} SELECT id, total AS score, source_name AS source, left(headline, 200) AS summary, permalink,
  strftime(ts, {MICROS}) AS created_at, (SELECT count(*) FROM routed WHERE status = 'digest_pending') AS total
FROM routed WHERE status = 'digest_pending' ORDER BY ts, id LIMIT 30"""
ORACLE["flow_dry_run_stored"] = f"""{FLOW} SELECT f.id, f.dry_rule AS reject_rule, CASE WHEN f.dry_rule IS NULL THEN f.score END AS score
FROM flagged f JOIN admitted USING (id)"""

# Sendings of the edge: all items, then those that come again or late.
_SENT_AGAIN = "".join(
    f"""
  UNION ALL SELECT '{prefix}' || doc_id, doc_id + {later}, {minutes(f'(doc_id + {later * anew}) * {corpus.MINUTES_BETWEEN_ITEMS}')}
  FROM documents WHERE doc_id % {modulus} = {remainder}"""
    for modulus, remainder, later, prefix, anew in (
        (10, 3, 20, "", 1), (10, 7, 120, "", 1), (14, 5, 200, "late-", 0)
    )
)
ORACLE["edge_stream"] = f"""WITH RECURSIVE ends AS (SELECT min(doc_id) AS low, (max(doc_id) - min(doc_id)) // 3 + 1 AS step FROM documents),
sendings AS (
  SELECT CAST(doc_id AS VARCHAR) AS item_id, doc_id AS place, {minutes(f'doc_id * {corpus.MINUTES_BETWEEN_ITEMS}')} AS posted
  FROM documents{_SENT_AGAIN}),
parts AS (SELECT item_id, posted, (place - low) // step AS part FROM sendings, ends WHERE (place - low) // step < 3),
clocked AS (SELECT p.*, (SELECT max(e.posted) FROM parts e WHERE e.part < p.part) AS clock FROM parts p),
timed AS (SELECT *, coalesce(posted < clock - INTERVAL 360 MINUTE, false) AS late, greatest(posted, coalesce(clock, posted)) AS ts FROM clocked),
punctual AS (SELECT * FROM timed WHERE NOT late),
firsts AS (
  SELECT item_id, min(ts) AS ts FROM punctual GROUP BY item_id
  UNION ALL
  SELECT item_id, following FROM (
    SELECT f.item_id, (SELECT min(e.ts) FROM punctual e WHERE e.item_id = f.item_id AND e.ts > f.ts + INTERVAL 7 DAY) AS following
    FROM firsts f) WHERE following IS NOT NULL)
SELECT t.item_id, strftime(t.posted, {MICROS}) AS posted_at,
  CASE WHEN t.late THEN 'late' WHEN f.ts IS NULL THEN 'repeated' ELSE 'stored' END AS outcome
FROM timed t LEFT JOIN firsts f ON f.item_id = t.item_id AND f.ts = t.ts"""

# --- rule tables, exports and running counts ------------------------------------------------

ORACLE["loaded_rules_summary"] = ORACLE["dry_run_summary"]
ORACLE["usage_rows"] = f"""{STORED} SELECT e.user_id AS match_id,
  CASE WHEN event_id % 3 = 0 THEN 'translate' ELSE 'classify_and_translate' END AS mode,
  CASE WHEN event_id % 5 = 4 THEN 'main' ELSE u.circuit END AS circuit,
  CASE WHEN event_id % 4 = 1 THEN 'model-b' ELSE 'model-a' END AS model, u.outcome,
  event_id * 3 AS prompt_tokens, event_id % 100 AS output_tokens, CAST(trunc(value) AS BIGINT) AS latency_ms,
  CASE WHEN u.outcome = 'error' THEN 'broken' END AS error, strftime(u.created_at, {MICROS}) AS created_at
FROM usage_log u JOIN events e ON e.event_id = u.id"""
ORACLE["json_export"] = f"""{STORED} SELECT '{{"id":' || id || ',"source":' || to_json(source) || ',"author_handle":' || to_json(author_handle)
  || CASE WHEN reject_rule IS NULL THEN '' ELSE ',"reject_rule":' || to_json(reject_rule) END || '}}' AS value FROM raw_items"""
ORACLE["call_minutes_stream"] = f"""SELECT CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'browse' END AS circuit,
  strftime(date_trunc('minute', ts), {MICROS}) AS minute, count(*) AS calls FROM events GROUP BY ALL"""
ORACLE["last_beats_stream"] = f"""SELECT 'c' || user_id AS circuit, strftime(max(ts), {MICROS}) AS ts FROM events GROUP BY 1"""

# --- streams with state per key -------------------------------------------------------------

ORACLE["exact_dups_stream"] = ORACLE["exact_dups"]
ORACLE["quota_admission_stream"] = ORACLE["quota_admission"]
ORACLE["silence_alerts_stream"] = f"""WITH linked AS (
  SELECT 'c' || user_id AS circuit, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following,
    max(ts) OVER () AS latest FROM events)
SELECT circuit, strftime(ts, {MICROS}) AS silent_from FROM linked
WHERE epoch_us(coalesce(following, latest)) - epoch_us(ts) > 900000000"""

# --- jobs over the store --------------------------------------------------------------------


def _digest_run(run: int, day: str, shown: str) -> str:
    return f"""
run{run} AS (SELECT {run} AS run, w.*, row_number() OVER (ORDER BY created_at, id) AS place, count(*) OVER () AS total
  FROM waiting w WHERE day <= DATE '{day}'{shown})"""


_DIGESTS = ",".join(
    _digest_run(run, day, "".join(f" AND id NOT IN (SELECT id FROM run{r} WHERE place <= 30)" for r in range(run)))
    for run, day in enumerate(["2024-01-01", "2024-01-02", "2024-01-31"])
)
ORACLE["digest_runs"] = f"""{STORED},
waiting AS (SELECT m.id, m.score, r.source, left(coalesce(nullif(m.llm_summary_ru, ''), m.headline), 200) AS summary,
    r.permalink, m.created_at, CAST(m.created_at - INTERVAL 8 HOUR AS DATE) + 1 AS day
  FROM matches m JOIN raw_items r ON r.id = m.raw_item_id WHERE status = 'digest_pending'),{_DIGESTS}
SELECT run, id, score, source, summary, permalink, strftime(created_at, {MICROS}) AS created_at, total
FROM (FROM run0 UNION ALL FROM run1 UNION ALL FROM run2) WHERE place <= 30"""
ORACLE["paused_sending"] = f"""WITH {MATCHES},
runs AS (SELECT id, CASE WHEN created_at <= TIMESTAMP '2024-01-01 01:00:00' THEN 0
    WHEN created_at <= TIMESTAMP '2024-01-01 03:00:00' THEN 2 ELSE 3 END AS run
  FROM matches WHERE status = 'new' AND created_at <= TIMESTAMP '2024-01-31'),
placed AS (SELECT id, run, row_number() OVER (PARTITION BY run ORDER BY id) - 1 AS place,
  CASE run WHEN 0 THEN TIMESTAMP '2024-01-01 01:00:00' WHEN 2 THEN TIMESTAMP '2024-01-01 03:00:00' ELSE TIMESTAMP '2024-01-31' END AS moment
  FROM runs)
SELECT id AS match_id, run, strftime(moment + to_seconds(60 * (place // 20)), {MICROS}) AS sent_at FROM placed"""
ORACLE["card_updates_stream"] = ORACLE["dup_counts"]
ORACLE["flow_verdicts"] = f"""{_ROUTED},{_ANSWERS},
work AS (SELECT id, circuit, total AS score, intent_tag, total >= 10 AS rules_notify,
  CASE WHEN circuit <> 'main' OR CASE intent_tag WHEN 'unknown' THEN false
      WHEN 'help_request' THEN total >= {fixed.HELP_MIN_SCORE} ELSE true END THEN 'classify_and_translate'
    WHEN total >= 10 THEN 'translate' END AS mode FROM pointed),
lots AS (SELECT id, row_number() OVER (PARTITION BY circuit ORDER BY id) AS lot FROM work WHERE mode IS NOT NULL AND id % 3 = 0),
joined AS (SELECT w.*, a.is_lead, a.confidence, a.lead_type, a.summary_ru,
  CASE WHEN mode IS NULL THEN NULL WHEN lot > CASE circuit WHEN 'main' THEN 20 ELSE 5 END THEN 'quota_exhausted'
    WHEN a.good THEN 'ok' ELSE 'error' END AS outcome
  FROM work w JOIN answers a USING (id) LEFT JOIN lots USING (id)),
final AS (SELECT *, coalesce(outcome = 'ok', false) AS answered, CASE WHEN mode IS NULL OR outcome <> 'ok' THEN rules_notify
  ELSE mode = 'translate' OR (is_lead AND confidence >= 0.55) END AS will_notify FROM joined),
-- The passes come at night, the rules decide at nine in the morning.
stated AS (SELECT *, CASE WHEN NOT will_notify THEN 'suppressed' WHEN mode IS NOT NULL AND score < 15 THEN 'digest_pending' ELSE 'new' END AS status FROM final)
SELECT id, score, CASE WHEN mode IS NULL THEN 'rules' WHEN answered THEN 'llm' ELSE 'rules_only' END AS decided_by,
  CASE WHEN mode IS NULL THEN 'not_needed' WHEN answered THEN 'done' WHEN outcome = 'error' THEN 'failed' ELSE 'skipped_quota' END AS llm_status,
  CASE WHEN answered AND lead_type <> 'not_a_lead' THEN lead_type ELSE intent_tag END AS intent_tag,
  CASE WHEN answered THEN summary_ru END AS llm_summary_ru, CASE WHEN answered THEN confidence END AS llm_prob,
  status, CASE status WHEN 'digest_pending' THEN 'digest' WHEN 'new' THEN 'notify' END AS queue,
  CASE WHEN mode IS NOT NULL THEN CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END END AS pass, CASE WHEN mode IS NOT NULL THEN 1 END AS calls
FROM stated"""
ORACLE["retention_store"] = f"""{STORED},
dealt AS (SELECT id, reject_rule, created_at, (id // 7) % 3 AS batch FROM raw_items)
SELECT 1 AS version, id, reject_rule FROM dealt
WHERE batch < 2 AND (batch = 1 OR reject_rule IS NULL OR created_at >= TIMESTAMP '2024-01-31 02:00:00' - INTERVAL 30 DAY)
UNION ALL SELECT 2, id, reject_rule FROM dealt
WHERE reject_rule IS NULL OR created_at >= TIMESTAMP '2024-01-31 04:00:00' - INTERVAL 30 DAY"""
ORACLE["reloaded_rules_stream"] = f"""{SCORED} SELECT r.id, r.circuit, CASE WHEN r.id % 2 = 0 THEN live_rule
  ELSE coalesce(hf1, hf2, hf4, CASE WHEN offer_tag THEN 'HF-5_service_offer' END, hf6) END AS reject_rule
FROM replayed r JOIN sources s ON s.name = r.source_name WHERE s.enabled AND NOT coalesce(s.muted_until > {_NOW}, false)"""
