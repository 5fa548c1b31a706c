"""DuckDB twins of those queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
             g AS (SELECT doc_id, norm, max(doc_id) OVER own AS keep_id, count(*) OVER own AS group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS place
                   FROM t WINDOW own AS (PARTITION BY norm))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
    """,
}
