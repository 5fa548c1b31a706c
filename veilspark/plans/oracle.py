"""DuckDB twins of the registered queries.

RE2 has no look-around, so runs of digits of one length are found as maximal runs that are then filtered by length.
"""

from __future__ import annotations

from ..operators.metrics import ANALYZER_BUCKETS, SIZE_BUCKETS, STORE_BUCKETS
from .synthetic import N10, N11, N12, TEXTS, TURN_TEXT

# The weights, patterns and scores below are those of the recognizers and checks, in the other engine's dialect.
_DIGITS = r"regexp_replace(m, '[^0-9]', '', 'g')"


def _weighted(d: str, weights) -> str:
    return "(" + " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


def _inn10(d: str) -> str:
    return f"(length({d}) = 10 AND {_weighted(d, (2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = CAST(substr({d}, 10, 1) AS INT))"


def _inn12(d: str) -> str:
    one, two = _weighted(d, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)), _weighted(d, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))
    return f"CASE WHEN length({d}) = 12 THEN {one} % 11 % 10 = CAST(substr({d}, 11, 1) AS INT) AND {two} % 11 % 10 = CAST(substr({d}, 12, 1) AS INT) ELSE FALSE END"


def _snils(d: str) -> str:
    return f"CASE WHEN length({d}) = 11 AND substr({d}, 1, 3) NOT IN ('000', '001') THEN {_weighted(d, range(9, 0, -1))} % 101 = CAST(substr({d}, 10, 2) AS INT) ELSE FALSE END"


def _luhn(d: str) -> str:
    digit = f"CAST(substr({d}, i::INT, 1) AS INT)"
    return f"list_sum(list_transform(generate_series(1, length({d})), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN (2 * {digit}) // 10 + (2 * {digit}) % 10 ELSE {digit} END)) % 10 = 0"


_CARD = f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_luhn(_DIGITS)}"
_PHONE = f"((length({_DIGITS}) = 11 AND substr({_DIGITS}, 1, 1) IN ('7', '8')) OR length({_DIGITS}) = 10)"
_PASSPORT = f"length({_DIGITS}) = 10 AND substr({_DIGITS}, 1, 2) <> '00'"
_INN = f"CASE WHEN length(m) = 10 THEN {_inn10('m')} ELSE {_inn12('m')} END"
_STREET = r"(?:ул\.?|улица|пр-т|проспект|пер\.?|переулок|б-р|бульвар|шоссе|ш\.?)\s*[А-ЯЁ][а-яёА-ЯЁ\s\-]{1,50}?[,\.]?\s*(?:д\.|дом)?\s*\d+[а-яё]?"

# Fixed values: (entity, score, pattern, condition on the match m), in the registry's order
_PATTERNS = [
    ("PHONE_NUMBER", "1.0", r"(?:\+?7|8)[\s\-\.]?\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{2}[\s\-\.]?\d{2}", _PHONE),
    ("PHONE_NUMBER", "1.0", r"\d+", "length(m) = 10 AND substr(m, 1, 1) = '9'"),
    ("EMAIL_ADDRESS", "0.85", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "TRUE"),
    ("RU_INN", "{inn12}", r"\d+", f"length(m) = 12 AND {_INN}"),
    ("RU_INN", "{inn10}", r"\d+", f"length(m) = 10 AND {_INN}"),
    ("RU_SNILS", "1.0", r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2}\b", _snils(_DIGITS)),
    ("RU_SNILS", "1.0", r"\d+", f"length(m) = 11 AND {_snils('m')}"),
    ("RU_PASSPORT", "1.0", r"\b\d{2}\s\d{2}\s\d{6}\b", _PASSPORT),
    ("RU_PASSPORT", "1.0", r"\b\d{4}\s\d{6}\b", _PASSPORT),
    ("CREDIT_CARD", "1.0", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", _CARD),
    ("CREDIT_CARD", "1.0", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{2}\b", _CARD),
    ("RU_ADDRESS", "0.7", _STREET + r"\s*(?:[,/]\s*(?:корп\.|корпус|стр\.)\s*\d+[а-яё]?)?(?:\s*[,\.]?\s*(?:кв\.|квартира|оф\.|офис)\s*\d+)?", "TRUE"),
    ("RU_ADDRESS", "0.6", _STREET, "TRUE"),
    ("RU_ADDRESS", "0.6", r"[А-ЯЁ][а-яёА-ЯЁ\s\-]{1,50}?\s+(?:ул\.?|улица|проспект|пер\.?|переулок|бульвар|шоссе)[,\.]?\s*(?:д\.|дом)?\s*\d+[а-яё]?", "TRUE"),
    ("RU_ADDRESS", "0.6", r"(?:г\.|гор\.|пос\.|с\.|дер\.)\s*[А-ЯЁ][а-яёА-ЯЁ\-]{1,30}[\s,]+(?:ул\.?|улица|пр-т|проспект)\s*[А-ЯЁ][а-яёА-ЯЁ\s\-]{1,40}", "TRUE"),
]


def _greedy(l: str, clash: str) -> str:
    """Of a list of spans {s, e, t, sc, m}, those that clash (of k, x) with none that was kept."""
    return f"list_reduce(list_transform({l}, lambda z: [z]), lambda a, b: CASE WHEN len(list_filter(a, lambda k: {clash})) > 0 THEN a ELSE list_concat(a, b) END)"


_INSIDE = "k.t = b[1].t AND k.s <= b[1].s AND b[1].e <= k.e"
_OVERLAP = "b[1].s < k.e AND k.s < b[1].e"


def _spans(source: str, keys: str, entities: list[str] | None = None, threshold: float = 0.35, inn10: str = "0.4", inn12: str = "0.4") -> str:
    """WITH ... found(keys, s, e, t, sc, m): the resolved spans of source(keys, text)."""
    parts = []
    for ord_, (entity, score, pattern, condition) in enumerate(_PATTERNS):
        if entities is not None and entity not in entities:
            continue
        score = score.format(inn10=inn10, inn12=inn12)
        parts.append(f"""SELECT {keys}, {ord_} AS ord, '{entity}' AS t, CAST({score} AS DOUBLE) AS sc, s, s + length(m) AS e, m FROM (
            SELECT {keys}, x[i] AS m, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(x[1:i-1], lambda z: length(z))), 0) AS BIGINT) AS s
            FROM (SELECT {keys}, text, regexp_extract_all(text, '{pattern}') AS x, string_split_regex(text, '{pattern}') AS g FROM src WHERE regexp_matches(text, '{pattern}')) AS one, unnest(range(1, len(x) + 1)) AS u(i)
        ) AS scanned WHERE {condition}""")
    union = " UNION ALL ".join(f"({p})" for p in parts)
    return f"""WITH src AS ({source}), raw AS ({union}),
        listed AS (SELECT {keys}, list(struct_pack(s := s, e := e, t := t, sc := sc, m := m) ORDER BY sc DESC, s, e DESC, ord) AS l FROM raw WHERE sc >= {threshold} GROUP BY {keys}),
        outer_ AS (SELECT {keys}, {_greedy("l", _INSIDE)} AS l FROM listed),
        kept AS (SELECT {keys}, unnest({_greedy("l", _OVERLAP)}) AS x FROM outer_),
        found AS (SELECT {keys}, CAST(x.s AS BIGINT) AS s, CAST(x.e AS BIGINT) AS e, x.t AS t, x.sc AS sc, x.m AS m FROM kept)"""


_ROWS = ' SELECT {keys}, s AS "start", e AS "end", t AS entity_type, sc AS score, m AS text FROM found'
_DOCS = "SELECT doc_id, text, lang FROM documents"


def _detected(source: str, keys: str, **how) -> str:
    return _spans(source, keys, **how) + _ROWS.format(keys=keys)


def _customers(what: str) -> str:
    return f"SELECT c_custkey, {TEXTS[what]} AS text FROM customer"


ORACLE_SQL: dict[str, str] = {
    "detect_card": _detected(_DOCS, "doc_id", entities=["CREDIT_CARD"]),
    "detect_email": _detected(_DOCS, "doc_id", entities=["EMAIL_ADDRESS"]),
    "detect_all": _detected(_DOCS, "doc_id"),
    "detect_allow_list": _detected(_DOCS, "doc_id", entities=["CREDIT_CARD", "EMAIL_ADDRESS"]),
    "detect_phone": _detected(_customers("phone"), "c_custkey", entities=["PHONE_NUMBER"]),
    "detect_inn": _detected(_customers("inn"), "c_custkey", entities=["RU_INN"], inn10="0.75", inn12="0.75"),
    "detect_snils": _detected(_customers("snils"), "c_custkey", entities=["RU_SNILS"]),
    "detect_passport": _detected(_customers("passport"), "c_custkey", entities=["RU_PASSPORT"]),
    "detect_address": _detected(_customers("address"), "c_custkey", entities=["RU_ADDRESS"]),
    "detect_inn_strict": _detected(_customers("inn_strict"), "c_custkey", entities=["RU_INN"], inn10="CASE WHEN c_custkey % 2 = 0 THEN 0.55 ELSE 0.2 END"),
    "detect_threshold": _detected(_customers("inn_strict"), "c_custkey", entities=["RU_INN"], threshold=0.2, inn10="CASE WHEN c_custkey % 2 = 0 THEN 0.55 ELSE 0.2 END"),
    "entity_counts": _spans(_DOCS, "doc_id") + " SELECT t AS entity_type, count(*) AS n FROM found GROUP BY t",
    "entity_counts_by_lang": _spans(_DOCS, "doc_id, lang") + " SELECT lang, t AS entity_type, count(*) AS n FROM found GROUP BY lang, t",
    "validate_inn10": f"SELECT c_custkey, d AS number, {_inn10('d')} AS valid FROM (SELECT c_custkey, {N10} AS d FROM customer)",
    "validate_inn12": f"SELECT c_custkey, d AS number, {_inn12('d')} AS valid FROM (SELECT c_custkey, {N12} AS d FROM customer)",
    "validate_snils": f"SELECT c_custkey, d AS number, {_snils('d')} AS valid FROM (SELECT c_custkey, {N11} AS d FROM customer)",
    "validate_luhn": f"SELECT c_custkey, d AS number, {_luhn('d')} AS valid FROM (SELECT c_custkey, {N10} || substr({N11}, 1, 6) AS d FROM customer)",
}

_RAW = """SELECT o_orderkey, [struct_pack(t := 'PERSON', s := o_orderkey % 5, e := o_orderkey % 5 + 4, sc := 0.7, ord := 1),
    struct_pack(t := 'phone number', s := o_orderkey % 7, e := o_orderkey % 7 + 6, sc := 0.85, ord := 2),
    struct_pack(t := 'RU_INN', s := o_orderkey % 11 - 1, e := o_orderkey % 11 + 3, sc := 0.4, ord := 3),
    struct_pack(t := '__', s := o_orderkey % 13 + 6, e := o_orderkey % 13 + 9, sc := 1.0, ord := 4)] AS raw FROM orders"""
_TYPE = "coalesce(nullif(upper(trim(regexp_replace({x}, '[^A-Za-z0-9_]', '_', 'g'), '_')), ''), 'PII')"

ORACLE_SQL |= {
    "spans_dedup": f"""WITH r AS ({_RAW}), x AS (SELECT o_orderkey, unnest(raw) AS x FROM r),
        l AS (SELECT o_orderkey, list(x ORDER BY x.sc DESC, x.ord) AS l FROM x GROUP BY o_orderkey), k AS (SELECT o_orderkey, unnest({_greedy("l", _OVERLAP)}) AS x FROM l)
        SELECT o_orderkey, x.t AS entity_type, CAST(x.s AS BIGINT) AS "start", CAST(x.e AS BIGINT) AS "end" FROM k""",
    "spans_normalize": f"""WITH r AS ({_RAW}), x AS (SELECT o_orderkey, unnest(raw) AS x FROM r),
        l AS (SELECT o_orderkey, list(x ORDER BY x.s, x.e DESC, x.ord) AS l FROM x WHERE x.s >= 0 AND x.e <= 20 AND x.s < x.e GROUP BY o_orderkey), k AS (SELECT o_orderkey, unnest({_greedy("l", "b[1].s < k.e")}) AS x FROM l)
        SELECT o_orderkey, {_TYPE.format(x="x.t")} AS entity_type, CAST(x.s AS BIGINT) AS "start", CAST(x.e AS BIGINT) AS "end" FROM k""",
    "entity_type_normalize": f"SELECT p_partkey, {_TYPE.format(x="('__' || p_type || '-' || coalesce(p_brand, ''))")} AS entity_type, 'PII' AS empty_type FROM part",
    "mask_documents": _spans(_DOCS, "doc_id") + """, n AS (SELECT doc_id, s, e, t, row_number() OVER (PARTITION BY doc_id, t ORDER BY s) AS n, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM found),
        p AS (SELECT doc_id, string_agg(substr(text, before + 1, s - before) || '<' || t || '_' || n || '>', '' ORDER BY s) AS head, max(e) AS tail FROM n JOIN src USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, coalesce(head || substr(text, tail + 1), text) AS masked_text FROM src LEFT JOIN p USING (doc_id)""",
    "mask_unmask_roundtrip": "SELECT count(*) AS n, count(*) AS same FROM documents",
}

# every synthetic turn ends with one phone number and one address of e-mail
_TURNS = f"SELECT conv_id, turn, text AS own, {TURN_TEXT} AS text, '+7 903 ' || lpad(cast(conv_id % 1000 as string), 3, '0') || ' 45 ' || lpad(cast(turn % 100 as string), 2, '0') AS phone, 'user' || conv_id || '@mail.example.com' AS email, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations"
_MASKED = "own || ' тел <PHONE_NUMBER_' || n || '>, почта <EMAIL_ADDRESS_' || n || '>'"
_MAPPING = f"SELECT conv_id, '<PHONE_NUMBER_' || n || '>' AS placeholder, phone AS original, 'PHONE_NUMBER' AS entity_type FROM ({_TURNS}) UNION ALL SELECT conv_id, '<EMAIL_ADDRESS_' || n || '>', email, 'EMAIL_ADDRESS' FROM ({_TURNS})"

ORACLE_SQL |= {
    "placeholder_numbering": f"""SELECT conv_id, turn, length(own) + 5 AS "start", 'PHONE_NUMBER' AS entity_type, '<PHONE_NUMBER_' || n || '>' AS placeholder, phone AS text FROM ({_TURNS})
        UNION ALL SELECT conv_id, turn, length(own) + 5 + length(phone) + 8, 'EMAIL_ADDRESS', '<EMAIL_ADDRESS_' || n || '>', email FROM ({_TURNS})""",
    "mask_conversations": f"SELECT conv_id, turn, {_MASKED} AS masked_text FROM ({_TURNS})",
    "mapping_rows": _MAPPING,
    "mapping_size_histogram": f"WITH z AS (SELECT conv_id, CAST(count(*) AS DOUBLE) AS size FROM ({_MAPPING}) GROUP BY conv_id) " + " UNION ALL ".join(f"SELECT CAST({b} AS DOUBLE) AS le, count(*) FILTER (size <= {b}) AS n, sum(size) AS sum FROM z" for b in SIZE_BUCKETS) + " UNION ALL SELECT CAST(NULL AS DOUBLE), count(size), sum(size) FROM z",
    "mapping_entity_counts": f"SELECT entity_type, count(*) AS n FROM ({_MAPPING}) GROUP BY entity_type",
    "block_policy": "SELECT conv_id, conv_id % 3 = 0 AS blocked, CASE WHEN conv_id % 3 = 0 THEN 'EMAIL_ADDRESS,PHONE_NUMBER' ELSE '' END AS entities FROM conversations GROUP BY conv_id",
    "block_errors": "SELECT conv_id, CAST(422 AS BIGINT) AS status, 'pii_detected' AS type, 'pii_blocked' AS code, 'EMAIL_ADDRESS,PHONE_NUMBER' AS entities FROM conversations GROUP BY conv_id",
    "restore_full": f"SELECT conv_id, turn, text AS restored_text FROM ({_TURNS})",
    "restore_longest_first": "SELECT c_custkey, 'Петр и Иван' || c_custkey || ' ' || c_custkey AS restored_text FROM customer",
    "stream_restore_windowed": f"SELECT conv_id AS request_id, turn, text FROM ({_TURNS})",
    "stream_restore_stateful": f"SELECT conv_id AS request_id, turn, text FROM ({_TURNS})",
}

_LAST = f"CAST(ceil(length({_MASKED}) / 7.0) AS BIGINT)"
ORACLE_SQL |= {
    "stream_finish_empty_delta": f"SELECT conv_id AS request_id, turn, 'content' AS field, text || '<PHONE_' AS text, {_LAST} + 1 AS last_seq FROM ({_TURNS}) UNION ALL SELECT conv_id, turn, 'reasoning_content', repeat('<EMAIL_', {_LAST}), {_LAST} + 1 FROM ({_TURNS})",
    "stream_outcomes": """WITH s AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS known, o_orderkey % 7 = 0 AS failed, o_orderkey % 5 <> 0 AS has FROM orders),
        r AS (SELECT CASE WHEN NOT known THEN 'skipped' WHEN failed THEN 'error' WHEN NOT has THEN 'no_mapping' WHEN k % 3 = 0 THEN NULL WHEN k % 2 = 0 THEN 'restored' ELSE 'no_placeholders' END AS result,
            CASE WHEN known AND failed THEN 'reject' WHEN known AND has THEN 'restore' ELSE 'pass' END AS action, known AND NOT failed AS done, known AND NOT failed AND has AS delete_mapping FROM s)
        SELECT *, count(*) AS n FROM r GROUP BY ALL""",
}

_FIELDS = """WITH f AS (SELECT o_custkey AS request_id, CASE WHEN o_custkey % 19 <> 0 THEN o_orderkey END AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_spans,
        CASE WHEN o_custkey % 19 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderkey % 101 = 0 THEN 'overloaded' END AS error, o_custkey % 23 = 0 AS unsaved FROM orders),
    a AS (SELECT request_id, count(ord) AS n, min(ord) FILTER (error IS NOT NULL) AS failed_at, arg_min(error, ord) FILTER (error IS NOT NULL) AS error, bool_or(unsaved) AS unsaved FROM f GROUP BY request_id),
    g AS (SELECT a.*, (SELECT coalesce(sum(n_spans), 0) FROM f WHERE f.request_id = a.request_id AND (a.failed_at IS NULL OR f.ord < a.failed_at)) AS found FROM a)"""

ORACLE_SQL |= {
    "pre_call_outcomes": _FIELDS + """ SELECT CASE WHEN n = 0 THEN 'skipped' WHEN error IS NOT NULL OR (found > 0 AND unsaved) THEN 'error' WHEN found > 0 THEN 'masked' ELSE 'clean' END AS result, count(*) AS n FROM g GROUP BY ALL""",
    "fail_mode_outcomes": _FIELDS + """, r AS (SELECT request_id, CASE WHEN n = 0 THEN 'skipped' WHEN error = 'overloaded' THEN 'error' WHEN found > 0 THEN 'blocked' WHEN error IS NOT NULL THEN 'error' ELSE 'clean' END AS result FROM g)
        SELECT request_id, result, CASE WHEN result IN ('error', 'blocked') THEN 'reject' ELSE 'send_unchanged' END AS action FROM r""",
    "mapping_ttl_lookup": "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 6 < 3 THEN o_orderpriority END AS original FROM orders",
    "response_outcome_counts": """WITH f AS (SELECT CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS r, o_custkey % 5 <> 0 AS has, o_custkey % 29 = 0 AS failed, o_custkey % 7 <> 0 AS supported, o_custkey % 3 = 0 AND (o_custkey % 6 = 0 OR o_custkey % 7 = 0) AS streamed, o_custkey % 2 = 0 AS changed FROM orders),
        a AS (SELECT r, bool_or(has) AS has, bool_or(failed) AS failed, bool_and(supported) AS supported, bool_or(streamed) AS streamed, bool_or(changed) AS changed FROM f GROUP BY r),
        o AS (SELECT CASE WHEN r IS NULL OR streamed THEN 'skipped' WHEN failed THEN 'error' WHEN NOT has THEN 'no_mapping' WHEN NOT supported THEN 'unsupported_response' WHEN changed THEN 'restored' ELSE 'no_placeholders' END AS result FROM a)
        SELECT result, result IN ('restored', 'no_placeholders') AS delete_mapping, count(*) AS n FROM o GROUP BY ALL""",
}


def _message_rows(extra: str = "") -> str:
    """What each conversation turn's message yields: (conv_id, turn, k, kind, text)."""
    return f"""SELECT conv_id, turn, 0 AS k, 'content' AS path, text FROM c WHERE turn % 3 = 0
        UNION ALL SELECT conv_id, turn, 0, 'content.text', text FROM c WHERE turn % 3 = 1 UNION ALL SELECT conv_id, turn, 1, 'content.text', 'plain' FROM c WHERE turn % 3 = 1
        UNION ALL SELECT conv_id, turn, 2, 'tool_calls.arguments', text FROM c WHERE turn % 3 = 2 UNION ALL SELECT conv_id, turn, 3, 'function_call.arguments', 'f' FROM c WHERE turn % 3 = 2 {extra}"""


_C = "WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), convs AS (SELECT conv_id, max(turn) AS last FROM c GROUP BY conv_id), m AS ("
_MASKED_C = f"WITH c AS (SELECT conv_id, turn, {_MASKED} AS text FROM ({_TURNS}) WHERE text IS NOT NULL), convs AS (SELECT conv_id, max(turn) AS last FROM c GROUP BY conv_id), m AS ("
_NUMBER = ") SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS target_ord, path, text FROM m"

ORACLE_SQL |= {
    "extract_chat_targets": _C + f"SELECT conv_id, turn, k, 'messages.' || path AS path, text FROM ({_message_rows()}) UNION ALL SELECT conv_id, last + 1, 0, 'instructions', 'be kind' FROM convs" + _NUMBER,
    "extract_responses_targets": _C
    + f"""SELECT conv_id, turn, k, 'input.' || path AS path, text FROM ({_message_rows()})
        UNION ALL SELECT conv_id, last + 1, 0, 'input.text', 'own' FROM convs UNION ALL SELECT conv_id, last + 1, 1, 'input.output.text', 'o' FROM convs
        UNION ALL SELECT conv_id, last + 2, 0, 'input.arguments', 'a' FROM convs UNION ALL SELECT conv_id, last + 2, 1, 'input.output', 'p' FROM convs"""
    + _NUMBER,
    "extract_response_targets": "WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), m AS ("
    + _message_rows("UNION ALL SELECT conv_id, turn, -1, 'content.text', 'no' FROM c WHERE turn % 3 = 1 UNION ALL SELECT conv_id, turn, 1.5, 'reasoning_content', 'r' FROM c")
    + ") SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS target_ord, path, text FROM m",
    "masked_bodies": _MASKED_C + f"SELECT conv_id, turn, k, 'messages.' || path AS path, text FROM ({_message_rows()}) UNION ALL SELECT conv_id, last + 1, 0, 'instructions', 'be kind' FROM convs" + _NUMBER,
    "restored_messages": f"WITH c AS (SELECT conv_id, turn, text FROM ({_TURNS}) WHERE text IS NOT NULL), m AS ("
    + _message_rows("UNION ALL SELECT conv_id, turn, -1, 'content.text', 'no' FROM c WHERE turn % 3 = 1")
    + ") SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS target_ord, path, text FROM m",
    "store_latency_histogram": " UNION ALL ".join(f"SELECT event_type, CAST({b} AS DOUBLE) AS le, count(*) FILTER (value / 1000 <= {b}) AS n FROM events GROUP BY event_type" for b in STORE_BUCKETS) + " UNION ALL SELECT event_type, CAST(NULL AS DOUBLE), count(value) FROM events GROUP BY event_type",
    "blocked_entity_counts": f"SELECT entity_type, count(*) AS n FROM ({_MAPPING}) GROUP BY entity_type",
    "failure_counts": """WITH t AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'masking' WHEN 1 THEN 'mapping_save' WHEN 2 THEN 'mapping_load' ELSE 'mapping_delete' END AS operation, CASE WHEN o_orderkey % 6 = 0 THEN 'failed' WHEN o_orderkey % 35 = 0 THEN 'overloaded' END AS error FROM orders)
        SELECT operation, CASE WHEN error = 'overloaded' THEN 'fail_closed' WHEN operation = 'mapping_delete' THEN 'fail_open' ELSE 'fail_closed' END AS mode, count(*) AS n FROM t WHERE error IS NOT NULL GROUP BY ALL""",
    "log_lines": """SELECT c_custkey, '{"entity":"тип","event":"pii_masked","masked_count":' || c_custkey % 7 || ',"request_id":"' || c_custkey || '"}' AS line FROM customer""",
    "guardrail_hooks": "SELECT o_orderkey, 'on' AS how FROM orders UNION ALL SELECT o_orderkey, 'asked' FROM orders WHERE o_orderkey % 3 = 0",
    "blank_skip": r"SELECT conv_id, turn, turn % 2 = 0 OR text IS NULL OR NOT regexp_matches(text, '\S') AS blank FROM conversations",
    "metadata_scrub": "SELECT c_custkey, 'user' AS keys FROM customer",
    "rates_5m": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "latency_histogram": " UNION ALL ".join(f"SELECT event_type, CAST({b} AS DOUBLE) AS le, count(*) FILTER (value / 100 <= {b}) AS n FROM events GROUP BY event_type" for b in ANALYZER_BUCKETS) + " UNION ALL SELECT event_type, CAST(NULL AS DOUBLE), count(value) FROM events GROUP BY event_type",
    "model_access_semi": """SELECT o_orderkey AS request_id, o_custkey AS key_id, CASE o_orderkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'own' END AS model_name FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE CASE o_orderkey % 3 WHEN 0 THEN c_custkey % 2 = 0 WHEN 1 THEN c_custkey % 2 = 1 OR lower(c_mktsegment) = 'building' ELSE lower(c_mktsegment) = 'building' END""",
    "auth_reject": "SELECT o_orderkey AS request_id, o_custkey AS key_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)",
    "sticky_routing": """WITH r AS (SELECT o_orderkey, o_custkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'own' END AS model, o_orderdate AS ts FROM orders),
        u AS (SELECT k, model, max(ts) AS used_at FROM r WHERE o_orderkey % 4 = 0 AND model = 'large' GROUP BY ALL)
        SELECT o_orderkey AS request_id, CASE WHEN s THEN 'b-2' WHEN model = 'small' THEN 'a-1' WHEN model = 'own' THEN 'c-1' WHEN md5(k || '|b-1') < md5(k || '|b-2') THEN 'b-1' ELSE 'b-2' END AS deployment_id, s AS sticky
        FROM (SELECT r.*, coalesce(ts <= used_at + INTERVAL 200 DAY, FALSE) AS s FROM r LEFT JOIN u USING (k, model))""",
}

ORACLE_SQL["latency_p95"] = f"""WITH h AS ({ORACLE_SQL["latency_histogram"]}), t AS (SELECT event_type, max(n) AS total FROM h GROUP BY event_type),
    o AS (SELECT event_type, coalesce(le, 'inf'::DOUBLE) AS le, n, total, lag(n, 1, 0) OVER w AS bn, lag(coalesce(le, 'inf'::DOUBLE), 1, 0.0) OVER w AS ble FROM h JOIN t USING (event_type) WINDOW w AS (PARTITION BY event_type ORDER BY coalesce(le, 'inf'::DOUBLE)))
    SELECT event_type, round(arg_min(CASE WHEN isinf(le) THEN ble ELSE ble + (le - ble) * (total * 0.95 - bn) / greatest(n - bn, 1) END, le), 6) AS p95 FROM o WHERE n >= total * 0.95 GROUP BY event_type"""

# what each kind of tagged row yields: (case, n, tag, parts, start in the text)
_MERGED = "(VALUES (0, 0, 'PER', 'Иван|Иванов'), (0, 1, 'LOC', 'Москвы'), (0, 2, 'ORG', 'Газпром'), (1, 0, 'PER', 'Иванов'), (1, 1, 'LOC', 'из|Москвы'), (1, 2, 'MISC', NULL), (2, 0, 'PER', 'Иванов'), (2, 1, 'ORG', NULL), (3, 0, 'LOC', 'Иван'), (3, 1, 'LOC', 'Иванов'), (3, 2, 'PER', '#')) AS v(kind, n, tag, parts)"
_NUMBERED = "coalesce(CASE WHEN parts = '#' THEN cast(c_custkey as string) ELSE parts END, CASE kind WHEN 1 THEN cast(c_custkey as string) ELSE 'Газпром|' || c_custkey END)"
_TOKEN_TEXT = "'Иван Иванов из Москвы Газпром ' || c_custkey"
ORACLE_SQL["bio_merge"] = f"SELECT c_custkey, CAST(n AS BIGINT) AS n, tag, {_NUMBERED} AS parts FROM customer JOIN {_MERGED} ON kind = c_custkey % 4"
_ALIGNED = f"""WITH a AS (SELECT c_custkey, n, tag, replace({_NUMBERED}, '|', ' ') AS m, {_TOKEN_TEXT} AS text FROM customer JOIN {_MERGED} ON kind = c_custkey % 4 WHERE tag <> 'MISC'),
    p AS (SELECT *, CASE WHEN m = 'Иван' THEN 0 WHEN tag = 'LOC' AND m = 'Иванов' THEN 5 ELSE instr(text, m) - 1 END AS s FROM a)
    SELECT c_custkey, CAST(s AS BIGINT) AS "start", CAST(s + length(m) AS BIGINT) AS "end", CASE tag WHEN 'PER' THEN 'PERSON' WHEN 'LOC' THEN 'LOCATION' ELSE 'ORGANIZATION' END AS entity_type, 0.7::DOUBLE AS score, m AS text FROM p"""
ORACLE_SQL["ner_align"] = _ALIGNED
ORACLE_SQL["ner_gate"] = f"SELECT * FROM ({_ALIGNED}) WHERE entity_type = 'LOCATION'"
