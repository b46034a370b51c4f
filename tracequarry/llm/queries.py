"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracequarry.llm import conversations, leakage, lookalikes, mojibake, packing, runs, tokens, truncation
from tracequarry.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def on(*names: str, f: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])

    events, items, documents, specs = "agent_event", "benchmark_item", "documents", "pack_spec"
    return {
        "p1_found": on(events, items, f=leakage.leaked_items),
        "p1_reparameterised": on(events, items, f=leakage.reparameterised_items),
        "p2_found": on(events, f=mojibake.garbled_values),
        "p2_restored": on(events, f=mojibake.restored_values),
        "p3_found": on("run_call", f=runs.repeated_runs),
        "p3_runs": on("run_call", f=runs.command_runs),
        "p5_found": on("run_message", f=conversations.dropped_conversations),
        "p5_conversations": on("run_message", f=conversations.conversations),
        "p6_found": on(events, f=truncation.cut_values),
        "p6_shares": on(events, f=truncation.cut_shares),
        "p8_ids": on(documents, f=tokens.document_ids),
        "p8_roundtrip": on(documents, f=lambda d: tokens.decoded_documents(d).select("doc_id", "restored")),
        "p9_containers": on(documents, specs, f=packing.containers),
        "p9_fill": on(documents, specs, f=lambda d, s: packing.container_fill(packing.containers(d, s), s)),
        "p9_faults": on(documents, specs, f=lambda d, s: packing.packing_faults(packing.containers(d, s), s)),
        "p10_found": on(documents, f=lookalikes.same_look_pairs),
        "p10_classes": on(documents, f=lookalikes.same_look_classes),
    }


_CALLS = r"""
one AS (
  SELECT trajectory_id, call_index, arg_min(struct_pack(command := command, monitoring_action := monitoring_action, started_at := started_at, ended_at := ended_at), ingested_at) AS r
  FROM run_call WHERE trajectory_id IS NOT NULL AND call_index IS NOT NULL GROUP BY ALL
), keyed AS (
  SELECT trajectory_id, call_index, r.command AS command, r.monitoring_action AS monitoring_action, r.started_at AS started_at, r.ended_at AS ended_at,
    trim(regexp_replace(r.command, '\s+', ' ', 'g')) AS spaced FROM one
), matched AS (
  SELECT *, CASE WHEN spaced IS NULL THEN NULL WHEN monitoring_action THEN 'm' || regexp_replace(spaced, '[0-9]+(\.[0-9]+)?', '0', 'g')
    WHEN NOT monitoring_action THEN 'c' || spaced ELSE '?' || spaced END AS key FROM keyed
), marked AS (
  SELECT *, CASE WHEN lag(call_index) OVER w = call_index - 1 AND lag(key) OVER w = key THEN 0 ELSE 1 END AS starts FROM matched WINDOW w AS (PARTITION BY trajectory_id ORDER BY call_index)
), numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY trajectory_id ORDER BY call_index) AS run FROM marked
), runs AS (
  SELECT trajectory_id, min(call_index) AS first_call_index, max(call_index) AS last_call_index, CAST(max(call_index) - min(call_index) + 1 AS INTEGER) AS n_calls,
    arg_min(struct_pack(x := command), call_index).x AS command, coalesce(arg_min(struct_pack(x := monitoring_action), call_index).x, false) AS is_polling,
    arg_min(struct_pack(x := started_at), call_index).x AS first_start, arg_max(struct_pack(x := ended_at), call_index).x AS last_end
  FROM numbered WHERE key IS NOT NULL GROUP BY trajectory_id, run
)"""


def _words(c: str) -> str:
    """Lower-case words of a text in SQL: escapes of white space and quotes undone, others taken for a blank."""
    return rf"regexp_extract_all(lower(regexp_replace(regexp_replace({c}, '\\+(?:u\{{[0-9a-fA-F]{{1,6}}\}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|x[0-9a-fA-F]{{2}}|[0-3][0-7]{{2}}|[abefnrtv0])', ' ', 'g'), '[^\x00-\x7f]', ' ', 'g')), '[a-z0-9]+')"


#: Windows of 14 words of items and events, met as texts.
_LEAKED = f"""WITH i AS (SELECT item_id, {_words('text')} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark_item WHERE item_id IS NOT NULL)), iw AS (SELECT DISTINCT item_id, hash(array_to_string(w[k : k + 13], ' ')) AS h FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 13)) AS k FROM i WHERE len(w) >= 14)),
e AS (SELECT DISTINCT trajectory_id, event_index, {_words('t')} AS w FROM (SELECT trajectory_id, event_index, file_content AS t FROM agent_event UNION ALL SELECT trajectory_id, event_index, command FROM agent_event) WHERE t IS NOT NULL),
ew AS (SELECT trajectory_id, event_index, hash(array_to_string(w[k : k + 13], ' ')) AS h FROM (SELECT trajectory_id, event_index, w, unnest(generate_series(1, len(w) - 13)) AS k FROM e WHERE len(w) >= 14))
SELECT DISTINCT trajectory_id, event_index, item_id FROM ew JOIN iw USING (h)"""
_MESSAGES = """
m AS (
  SELECT DISTINCT trajectory_id, event_index, event_type, role, tool_name, text, call_id, lifecycle_status FROM run_message WHERE trajectory_id IS NOT NULL
), r AS (
  SELECT *, CASE WHEN role IS NULL OR trim(role) = '' THEN NULL WHEN lower(trim(role)) IN ('user', 'human', 'customer', 'prompter') THEN 'user'
    WHEN lower(trim(role)) IN ('assistant', 'ai', 'model', 'bot', 'gpt', 'agent') THEN 'assistant' WHEN lower(trim(role)) IN ('system', 'developer') THEN 'system' ELSE 'other' END AS speaker,
    CASE WHEN lower(trim(role)) IN ('user', 'human', 'customer', 'prompter') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'model', 'bot', 'gpt', 'agent') THEN 'assistant' WHEN lower(trim(role)) IN ('system', 'developer') THEN 'system' WHEN lower(trim(role)) IN ('tool', 'function', 'ipython', 'environment') THEN 'tool' ELSE lower(trim(role)) END AS name FROM m
), k AS (
  SELECT *, coalesce(speaker = 'system' OR event_type = 'system', false) AS is_system, coalesce(speaker = 'user' AND event_type <> 'tool_result', false) AS is_user,
    coalesce(speaker = 'assistant' AND event_type <> 'tool_result', false) AS is_assistant FROM r
), shape AS (
  SELECT trajectory_id, count(*) AS n, count(DISTINCT event_index) AS d, min(event_index) AS low, max(event_index) AS high, bool_or(speaker IS NULL) AS no_role,
    bool_or(NOT is_system AND regexp_matches(coalesce(text, ''), '[^\\s]')) AS seen,
    coalesce(arg_min(is_user, event_index) FILTER (NOT is_system), false) AS user_first FROM k GROUP BY 1
), turns AS (
  SELECT *, sum(CASE WHEN is_user AND NOT is_system THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id ORDER BY event_index) AS turn FROM k
), silent AS (
  SELECT DISTINCT trajectory_id FROM (SELECT trajectory_id, turn, bool_or(is_assistant AND NOT is_system) AS replied FROM turns WHERE turn > 0 GROUP BY 1, 2) WHERE NOT replied
), ids AS (
  SELECT trajectory_id, nullif(trim(call_id), '') AS call_id, max(event_index) FILTER (event_type = 'tool_call') AS call_high, min(event_index) FILTER (event_type = 'tool_call') AS call_low,
    max(event_index) FILTER (event_type = 'tool_result') AS result_high, min(event_index) FILTER (event_type = 'tool_result') AS result_low
  FROM k WHERE event_type IN ('tool_call', 'tool_result') GROUP BY 1, 2
), loose AS (
  SELECT DISTINCT trajectory_id FROM ids WHERE call_id IS NULL OR (call_high IS NOT NULL AND NOT coalesce(result_high > call_high, false)) OR (result_low IS NOT NULL AND NOT coalesce(call_low < result_low, false))
), dropped AS (
  SELECT trajectory_id FROM shape WHERE n <> d OR low <> 0 OR high <> n - 1 OR no_role OR NOT coalesce(seen, false) OR NOT user_first
  UNION SELECT trajectory_id FROM silent UNION SELECT trajectory_id FROM loose
)"""
#: The forms of all texts by the operator's embedded SQL.
_FORMS = f"t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), formed AS ({lookalikes.canonical_sql()}), forms AS (SELECT * FROM formed WHERE NOT regexp_full_match(form, '[\\s\\p{{Z}}\\x{{2800}}]*'))"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_CALLS} SELECT trajectory_id, first_call_index, last_call_index FROM runs WHERE n_calls >= 2",
        "p3_runs": f"WITH {_CALLS} SELECT *, epoch_us(last_end) - epoch_us(first_start) AS duration_us FROM runs",
        "p5_found": f"WITH {_MESSAGES} SELECT trajectory_id FROM dropped",
        "p5_conversations": f"""WITH {_MESSAGES} SELECT trajectory_id, event_index, CAST(turn AS BIGINT) AS turn, name AS speaker, event_type, tool_name, call_id, text FROM turns WHERE trajectory_id NOT IN (SELECT trajectory_id FROM dropped)""",
        "p8_roundtrip": "SELECT doc_id, true AS restored FROM documents",
        "p9_faults": "SELECT s.spec_id, CAST(count(DISTINCT d.doc_id) AS BIGINT) AS n_documents, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_divided FROM documents d, (SELECT DISTINCT spec_id FROM pack_spec WHERE capacity_tokens > 0) s WHERE d.text IS NOT NULL GROUP BY 1",
        "p1_found": _LEAKED,
        "p10_found": f"WITH {_FORMS} SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form AND a.text < b.text",
        "p10_classes": f"WITH {_FORMS} SELECT doc_id, CAST(min(doc_id) OVER w AS BIGINT) AS class_id, CAST(count(*) OVER w AS BIGINT) AS n_documents, n_texts FROM forms JOIN (SELECT form, count(DISTINCT text) AS n_texts FROM forms GROUP BY 1) USING (form) WINDOW w AS (PARTITION BY form)",
    }
