"""All queries of the core, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracequarry.functions.rules import literal
from tracequarry.operators import log_lines, schema_drift
from tracequarry.plans import objectives, readers, reference, scalars  # the others add theirs to reference's table
from tracequarry.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _training_data() -> dict[str, Query]:
    def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
        return schema_drift.schema_changes(table(spark, sf_dir, "eval_log_raw"))

    return {
        "p4_found": lambda s, d: changes(s, d).select("log_stream", "file_seq", "field", "change_kind"),
        "p4_changes": changes,
        "p4_steps": lambda s, d: schema_drift.field_steps(table(s, d, "eval_log_raw")),
        "p4_versions": lambda s, d: schema_drift.file_versions(table(s, d, "eval_log_raw")),
        "p4_table": lambda s, d: schema_drift.consistent_table(table(s, d, "eval_log_raw")),
        "p7_found": lambda s, d: log_lines.entry_spans(table(s, d, "agent_event")),
        "p7_entries": lambda s, d: log_lines.log_entries(table(s, d, "agent_event")),
        "p7_templates": lambda s, d: log_lines.log_templates(table(s, d, "agent_event")),
    }


def queries() -> dict[str, Query]:
    assert objectives.QUERIES is readers.QUERIES is scalars.QUERIES is reference.QUERIES
    return {**_training_data(), **reference.queries()}


_PROFILES = """
raw AS (SELECT DISTINCT log_stream, file_seq, CASE WHEN json_valid(record) THEN record::JSON END AS j FROM eval_log_raw WHERE log_stream IS NOT NULL AND file_seq IS NOT NULL AND line_no IS NOT NULL),
o AS (SELECT * FROM raw WHERE json_type(j) = 'OBJECT'),
top AS (SELECT log_stream, file_seq, e.key AS field, e.value AS v FROM o, json_each(o.j) e),
both_ AS (SELECT * FROM top UNION ALL SELECT log_stream, file_seq, 'task_args.' || e.key, e.value FROM (SELECT * FROM top WHERE field = 'task_args' AND json_type(v) = 'OBJECT') t, json_each(t.v) e),
kinds AS (SELECT DISTINCT log_stream, file_seq, field, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS kind FROM both_),
held AS (SELECT log_stream, file_seq, field, coalesce(string_agg(kind, '|' ORDER BY kind), '') AS k FROM kinds GROUP BY 1, 2, 3),
files AS (SELECT DISTINCT log_stream, file_seq FROM raw),
seq AS (SELECT *, lag(file_seq) OVER (PARTITION BY log_stream ORDER BY file_seq) AS prev FROM files)"""


#: The renames in SQL: content of fields by kind, likeness, support over all files; of the pairs of a file the best ones.
_RENAMES = rf"""{_PROFILES},
val AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS kind, v ->> '$' AS s FROM both_),
num AS (SELECT *, CASE WHEN kind IN ('string', 'integer', 'decimal') THEN TRY_CAST(s AS DOUBLE) END AS x FROM val WHERE kind IS NOT NULL),
lk AS (SELECT *, CASE WHEN kind IN ('array', 'object') THEN regexp_replace(json_structure(v)::VARCHAR, 'UBIGINT|BIGINT|DOUBLE', 'NUMBER', 'g') WHEN x IS NOT NULL THEN 'number' WHEN kind <> 'string' THEN 'plain' WHEN regexp_matches(s, '^\d{{4}}-\d\d-\d\d') THEN 'time' WHEN regexp_matches(s, '\s') THEN 'sentence' WHEN regexp_matches(s, '[/:]') THEN 'path' ELSE 'word' END AS look FROM num),
pf AS (SELECT log_stream, file_seq, field, kind, list(DISTINCT look) AS looks, min(x) AS lo, max(x) AS hi FROM lk GROUP BY 1, 2, 3, 4),
gone AS (SELECT s.log_stream, s.file_seq, s.prev, h.field FROM seq s JOIN held h ON h.log_stream = s.log_stream AND h.file_seq = s.prev ANTI JOIN held n ON n.log_stream = s.log_stream AND n.file_seq = s.file_seq AND n.field = h.field),
come AS (SELECT s.log_stream, s.file_seq, h.field FROM seq s JOIN held h ON h.log_stream = s.log_stream AND h.file_seq = s.file_seq ANTI JOIN held n ON n.log_stream = s.log_stream AND n.file_seq = s.prev AND n.field = h.field WHERE s.prev IS NOT NULL),
pk AS (SELECT g.log_stream, g.file_seq, g.field AS old, c.field AS new, a.looks AS la, b.looks AS lb, a.lo AS alo, a.hi AS ahi, b.lo AS blo, b.hi AS bhi FROM gone g JOIN come c ON c.log_stream = g.log_stream AND c.file_seq = g.file_seq AND starts_with(g.field, 'task_args.') = starts_with(c.field, 'task_args.')
  JOIN pf a ON a.log_stream = g.log_stream AND a.file_seq = g.prev AND a.field = g.field JOIN pf b ON b.log_stream = c.log_stream AND b.file_seq = c.file_seq AND b.field = c.field AND b.kind = a.kind),
pc AS (SELECT log_stream, file_seq, old, new, max(CASE WHEN len(list_intersect(la, lb)) > 0 AND NOT coalesce(ahi + 0.25 * abs(ahi) + 1e-9 < blo - 0.25 * abs(blo) - 1e-9 OR bhi + 0.25 * abs(bhi) + 1e-9 < alo - 0.25 * abs(alo) - 1e-9, false)
  THEN len(list_intersect(la, lb)) / len(list_distinct(list_concat(la, lb))) + coalesce(CASE WHEN greatest(ahi, bhi) - least(alo, blo) > 0 THEN greatest(least(ahi, bhi) - greatest(alo, blo), 0.0) / (greatest(ahi, bhi) - least(alo, blo)) END, 1.0) END) AS content FROM pk GROUP BY 1, 2, 3, 4),
su0 AS (SELECT least(old, new) AS a, greatest(old, new) AS b, count(content) AS n FROM pc GROUP BY 1, 2),
su AS (SELECT u.a, u.b, CASE WHEN (SELECT count(*) FROM held x JOIN held y USING (log_stream, file_seq) WHERE x.field = u.a AND y.field = u.b) > {schema_drift.TOGETHER_TIMES} * u.n THEN 0 ELSE u.n END AS n FROM su0 u),
sc AS (SELECT p.*, su.n AS k, coalesce(content, 0.0) + 1 - levenshtein(lower(old), lower(new)) / greatest(length(old), length(new), 1) + su.n / (su.n + 2) AS score FROM pc p JOIN su ON su.a = least(old, new) AND su.b = greatest(old, new)),
fit AS (SELECT *, row_number() OVER (PARTITION BY log_stream, file_seq ORDER BY score DESC, old, new) AS place FROM sc WHERE (content IS NOT NULL OR k > 0) AND score >= {schema_drift.LEAST_SCORE}),
ren AS (SELECT log_stream, file_seq, old, new FROM fit f WHERE NOT EXISTS (SELECT 1 FROM fit g WHERE g.log_stream = f.log_stream AND g.file_seq = f.file_seq AND g.place < f.place AND (g.old = f.old OR g.new = f.new))),
step AS (SELECT n.log_stream, n.file_seq, n.field, 'retyped' AS change_kind, NULL AS new_name, t.k AS old_kind, n.k AS new_kind FROM seq s JOIN held n ON n.log_stream = s.log_stream AND n.file_seq = s.file_seq JOIN held t ON t.log_stream = s.log_stream AND t.file_seq = s.prev AND t.field = n.field WHERE n.k <> '' AND t.k <> '' AND n.k <> t.k
  UNION ALL SELECT g.log_stream, g.file_seq, g.field, CASE WHEN r.new IS NULL THEN 'removed' ELSE 'renamed' END, r.new, h.k, NULL FROM gone g JOIN held h ON h.log_stream = g.log_stream AND h.file_seq = g.prev AND h.field = g.field LEFT JOIN ren r ON r.log_stream = g.log_stream AND r.file_seq = g.file_seq AND r.old = g.field
  UNION ALL SELECT c.log_stream, c.file_seq, c.field, 'added', NULL, NULL, h.k FROM come c JOIN held h ON h.log_stream = c.log_stream AND h.file_seq = c.file_seq AND h.field = c.field ANTI JOIN ren r ON r.log_stream = c.log_stream AND r.file_seq = c.file_seq AND r.new = c.field)"""


_LEVEL, _NAME = "(?i:" + "|".join(sorted(log_lines.NAMED, key=len, reverse=True)) + ")", r"[A-Za-z_][\w.\-/]*"
#: The layouts of the test tables' log lines as patterns of a whole line's beginning: plainer than the operator, for the check only.
_LAYOUTS = [
    rf"{_LEVEL}:{_NAME}:", rf"{_LEVEL} \d\d-\d\d \d\d:\d\d:\d\d \[{_NAME}:\d+\]", rf"\({_NAME} pid=\d+\) {_LEVEL} [\d/]+ [\d:]+ >>", rf"\d{{10}}\.\d+ \| {_LEVEL} +\| {_NAME} \|",
    rf"\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d,\d+ - {_NAME} - {_LEVEL} - ", rf"\[\d[^\]]*\] \[{_LEVEL} *\] \[{_NAME}\]", rf"[A-Z][a-z]{{2}} [ \d]\d \d\d:\d\d:\d\d \S+ {_NAME}\[\d+\]: {_LEVEL}: ",
    rf"[TVDIWEFC]\d{{4}} \d\d:\d\d:\d\d\.\d+ +\d+ {_NAME}:\d+\] ", rf"\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?Z? {_LEVEL} +{_NAME}: ", rf"time=\S+ level={_LEVEL} component=", rf'\{{"ts": "[^"]*", "level": "{_LEVEL}"',
]
_ENTRIES = f"""WITH v AS (SELECT DISTINCT trajectory_id, event_index, 'command_output' AS field, command_output AS t FROM agent_event UNION SELECT trajectory_id, event_index, 'text', text FROM agent_event),
l AS (SELECT trajectory_id, event_index, field, unnest(string_split(t, chr(10))) AS line, unnest(generate_series(1, len(string_split(t, chr(10))))) AS n FROM v WHERE t <> ''),
k AS (SELECT *, regexp_matches(line, {literal('^(?:' + '|'.join(_LAYOUTS) + ')')}) AS starts FROM l), e AS (SELECT *, max(n) FILTER (regexp_matches(line, '\\S')) OVER (PARTITION BY trajectory_id, event_index, field) AS last FROM k)
SELECT trajectory_id, event_index, field, CAST(n AS INTEGER) AS first_line, CAST(coalesce(lead(n) OVER (PARTITION BY trajectory_id, event_index, field ORDER BY n) - 1, last) AS INTEGER) AS last_line FROM e WHERE starts"""


def oracle_sql() -> dict[str, str]:
    return {
        **reference.oracle_sql(),
        "p7_found": _ENTRIES,
        "p4_found": f"WITH {_RENAMES} SELECT log_stream, file_seq, field, change_kind FROM step",
        "p4_changes": f"WITH {_RENAMES} SELECT * FROM step",
        "p4_steps": f"""WITH {_PROFILES}, now AS (SELECT s.log_stream, s.file_seq, h.field, h.k FROM seq s JOIN held h USING (log_stream, file_seq) WHERE prev IS NOT NULL),
then_ AS (SELECT s.log_stream, s.file_seq, h.field, h.k FROM seq s JOIN held h ON h.log_stream = s.log_stream AND h.file_seq = s.prev)
SELECT log_stream, file_seq, field, CASE WHEN n.k IS NULL THEN 'gone' WHEN t.k IS NULL THEN 'come' ELSE 'retyped' END AS step FROM now n FULL JOIN then_ t USING (log_stream, file_seq, field)
WHERE n.k IS NULL OR t.k IS NULL OR (n.k <> '' AND t.k <> '' AND n.k <> t.k)""",
        "p4_versions": f"""WITH {_PROFILES}, prints AS (SELECT f.log_stream, f.file_seq, sha256(coalesce(string_agg(h.field || ':' || h.k, ',' ORDER BY h.field), '')) AS fingerprint, count(h.field) AS n_fields FROM files f LEFT JOIN held h USING (log_stream, file_seq) GROUP BY 1, 2),
news AS (SELECT *, CASE WHEN lag(fingerprint) OVER w = fingerprint THEN 0 ELSE 1 END AS new FROM prints WINDOW w AS (PARTITION BY log_stream ORDER BY file_seq))
SELECT log_stream, file_seq, CAST(sum(new) OVER (PARTITION BY log_stream ORDER BY file_seq) AS BIGINT) AS version, fingerprint, CAST(n_fields AS INTEGER) AS n_fields FROM news""",
    }
