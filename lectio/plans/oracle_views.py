"""The derived views of ``fixtures.py`` as DuckDB SQL (common table expressions)."""

from __future__ import annotations

TOK = "[\\p{L}\\p{N}]+(?:[''’][\\p{L}]+)*|[^\\s\\p{L}\\p{N}]"     # TOKEN_PATTERN, quote doubled
WORD = "[\\p{L}\\p{N}]+(?:[''’][\\p{L}]+)*"                       # WORD_PATTERN
VOWELS = "[aeiouyàáâäèéêëìíîïòóôöùúûüÿ]+"
SENT_END = "[.!?]+"

VIEWS = {
    "texts": "SELECT doc_id AS survey_num, text FROM documents",
    "responses": f"""
        SELECT e.event_id AS response_id, e.survey_num, e.user_id AS person_id,
               CAST(hour(e.ts) AS BIGINT) AS hour_of_day, e.event_type AS device, e.value,
               d.num_words,
               CAST(coalesce(d.num_words, 100) AS DOUBLE) / 4.0 + e.value AS reading_time
        FROM (SELECT *, 3 + event_id % ((SELECT count(*) FROM documents) + 4) AS survey_num
              FROM events) e
        LEFT JOIN (SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS num_words
                   FROM documents) d ON d.doc_id = e.survey_num""",
    "stories": """
        SELECT item, CAST(zone AS BIGINT) AS zone, word FROM (
          SELECT doc_id AS item, generate_subscripts(w, 1) AS zone, unnest(w) AS word
          FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents))""",
    "word_rts": """
        SELECT word, zone, item, CAST(s.subject AS BIGINT) AS subject,
               CAST(250.0 + 10.0 * length(word) + zone % 7 AS DOUBLE) AS meanItemRT
        FROM stories, (VALUES (0), (1)) s(subject)""",
    "lm_tokens": f"""
        SELECT item, start + p AS tok_pos, token FROM (
          SELECT item, start, generate_subscripts(toks, 1) AS p, unnest(toks) AS token FROM (
            SELECT item, toks,
                   CAST(coalesce(sum(len(toks)) OVER (PARTITION BY item ORDER BY zone
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM (SELECT item, zone, regexp_extract_all(word, '{TOK}') AS toks FROM stories)))""",
    "pairs": """
        SELECT conv_id, turn, text_a, text_b FROM (
          SELECT conv_id, turn, role, text AS text_a,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS text_b
          FROM conversations)""",
    "binary_preds": """
        SELECT l.doc_id, CAST(l.quality AS BIGINT) AS label, CAST(d.n_chars > 500 AS BIGINT) AS pred
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "reg_preds": """
        SELECT doc_id, CAST(n_chars AS DOUBLE) AS y,
               5.0 * len(regexp_extract_all(text, '\\S+')) AS yhat FROM documents""",
    "class_scores": """
        SELECT vec_id, embedding AS scores, CAST(label AS BIGINT) AS label FROM embeddings""",
    "token_vectors": """
        SELECT CAST(label AS BIGINT) AS doc, vec_id AS pos, embedding AS vec FROM embeddings""",
    "seed_runs": """
        SELECT event_type AS name, event_id % 5 AS seed, avg(abs(value - 40)) AS mae,
               sqrt(avg(power(value - 40, 2))) AS rmse
        FROM events GROUP BY 1, 2""",
}

# dependency order for the WITH clause
_ORDER = ["texts", "responses", "stories", "word_rts", "lm_tokens", "pairs", "binary_preds",
          "reg_preds", "class_scores", "token_vectors", "seed_runs"]
_DEPS = {"word_rts": ["stories"], "lm_tokens": ["stories"]}


def with_views(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the named views (and their dependencies) plus extra
    (name, body) CTEs, in dependency order."""
    need = set(names)
    for n in list(need):
        need.update(_DEPS.get(n, []))
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _ORDER if n in need]
    for name, body in (extra or []):
        ctes.append(f"{name} AS ({body})")
    if not ctes:
        return sql
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def task_lines_sql() -> str:
    """(task, line_no, line) for all ten task files, as in fixtures.all_task_lines."""
    from .fixtures import TASK_LINES, header_line, line_expr
    parts = []
    for task, (source, keys, header, fields) in TASK_LINES.items():
        off = 1 if header else 0
        order = ", ".join(keys)
        parts.append(f"""SELECT '{task}' AS task, line_no, {line_expr(fields)} AS line FROM (
            SELECT *, CAST(row_number() OVER (ORDER BY {order}) - 1 + {off} AS BIGINT) AS line_no FROM {source})""")
        if header:
            parts.append(f"SELECT '{task}' AS task, CAST(0 AS BIGINT) AS line_no, "
                         f"'{header_line(fields)}' AS line")
    return "\nUNION ALL\n".join(parts)
