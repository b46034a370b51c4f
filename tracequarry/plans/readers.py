"""Readers, sinks and small operators as queries: logs are written from the event table and read back.

The tables hold no raw logs, so each recorder's records are made from events and go
through the reader; the SQL states what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions import labels
from tracequarry.functions.rules import literal
from tracequarry.operators import first_stage, normalize, ordered
from tracequarry.plans.reference import _CALLS, _EV, _INV, QUERIES, _inventory, _results, ninth, query
from tracequarry.session import ensure_checkpoint_dir, table
from tracequarry.sources import inventory, lines
from tracequarry.streaming import queue

__all__ = ["QUERIES"]
COLUMNS = ["trajectory_id", "event_index", "source_format", "event_type", "role", "tool_name", "command", "command_output", "text", "file_path", "file_content", "exit_code", "call_id", "lifecycle_status"]


def _events(s, d) -> DataFrame:
    return table(s, d, "agent_event").select(*COLUMNS).dropDuplicates(["trajectory_id", "event_index"])


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _typed(kind: str, *fields: Column) -> Column:
    return _json(F.lit(kind).alias("type"), *fields)


# ---- first stage -----------------------------------------------------------------------------------
def _first_stage_lines(s, d) -> tuple[DataFrame, DataFrame]:
    """(log lines, trace lines) of all runs: one line of JSON behind a prefix for each event, or a marker and a body."""
    e = _events(s, d)
    t = F.col("event_type")
    said = lambda *parts: F.struct(F.array(*parts).alias("content")).alias("message")
    part = lambda kind, *fields: F.struct(F.lit(kind).alias("type"), *fields)
    claude = (
        F.when(t.isin("assistant_text", "reasoning"), _typed("assistant", said(part("text", F.col("text")))))
        .when(t.isin("user_text", "system"), _json(F.when(t == "system", "system").otherwise("user").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
        .when(t.isin("tool_call", "command_execution"), _typed("assistant", said(part("tool_use", F.col("tool_name").alias("name"), F.struct("command", "file_path").alias("input")))))
        .when(t == "tool_result", _typed("user", said(part("tool_result", F.col("command_output").alias("content"), F.col("exit_code")))))
        .when(t == "result", _typed("result", F.col("text").alias("result")))
        .otherwise(_typed("note"))
    )
    codex = (
        F.when(t == "command_execution", _typed("item.completed", part("command_execution", F.col("command"), F.col("command_output").alias("aggregated_output"), F.col("exit_code"), F.lit("completed").alias("status")).alias("item")))
        .when(t == "assistant_text", _typed("item.completed", part("agent_message", F.col("text")).alias("item")))
        .when(t == "reasoning", _typed("item.completed", part("reasoning", F.col("text")).alias("item")))
        .when(t == "error", _typed("error", F.col("text").alias("message")))
        .otherwise(_typed("turn.completed", F.col("text").alias("message")))
    )
    f = F.col("source_format")
    record = F.when(f == "claude_jsonl", claude).when(f == "codex_jsonl", codex).when(f == "opencode_jsonl", _typed("text", F.col("text")))
    at = (F.col("event_index") * 2 + 1).alias("line_no")
    logs = e.where("source_format <> 'plain_trace'").select("trajectory_id", at, F.concat(F.lit("[12:00] "), record).alias("line"))
    marker = F.when(t == "tool_call", F.concat(F.lit("Tool call: "), F.coalesce("tool_name", F.lit("none")))).otherwise(F.concat(F.lit("Assistant — turn "), F.col("event_index").cast("string")))
    body = F.concat(F.lit("x"), F.coalesce(F.md5("text"), F.lit("")))
    traces = e.where("source_format = 'plain_trace'").select("trajectory_id", F.explode(F.array(F.struct(at, marker.alias("line")), F.struct((F.col("event_index") * 2 + 2).alias("line_no"), body.alias("line")))).alias("x"))
    return logs, traces.select("trajectory_id", "x.line_no", "x.line")


_CAP = lambda c: f"CASE WHEN length({c}) > 4000 THEN left({c}, 4000) || chr(10) || '...[truncated]' ELSE {c} END"
_FIRST = f"""{_EV}, u AS (SELECT trajectory_id, event_index, source_format, event_type AS t, tool_name, command, nullif(command_output, '') AS out, text, file_path, exit_code FROM e),
x AS (
  SELECT trajectory_id, event_index, 'claude_jsonl' AS f, 'high' AS c, CASE WHEN t IN ('tool_call', 'command_execution') THEN 'tool_call' WHEN t IN ('tool_result', 'result') THEN t ELSE 'assistant_text' END AS event_type,
    CASE t WHEN 'user_text' THEN 'user' WHEN 'tool_result' THEN 'user' WHEN 'system' THEN 'system' WHEN 'result' THEN 'unknown' ELSE 'assistant' END AS role, CASE WHEN t IN ('tool_call', 'command_execution') THEN tool_name END AS tool_name,
    CASE WHEN t IN ('tool_call', 'command_execution') THEN NULL WHEN t = 'tool_result' THEN out ELSE nullif(text, '') END AS text, CASE WHEN t IN ('tool_call', 'command_execution') THEN command END AS command, CASE WHEN t = 'tool_result' THEN out END AS command_output,
    CASE WHEN t IN ('tool_call', 'command_execution') THEN file_path END AS file_path, CASE WHEN t = 'tool_result' THEN exit_code END AS exit_code, event_index * 2 + 1 AS a, event_index * 2 + 1 AS b
  FROM u WHERE source_format = 'claude_jsonl' AND (t IN ('tool_call', 'command_execution', 'tool_result', 'result') OR (t IN ('assistant_text', 'reasoning', 'user_text', 'system') AND text <> ''))
  UNION ALL
  SELECT trajectory_id, event_index, 'codex_jsonl', 'high', CASE WHEN t IN ('command_execution', 'error') THEN t ELSE 'assistant_text' END, CASE WHEN t IN ('command_execution', 'assistant_text', 'reasoning') THEN 'assistant' ELSE 'unknown' END, CASE WHEN t = 'command_execution' THEN t END,
    CASE WHEN t = 'command_execution' THEN command WHEN t = 'reasoning' THEN text WHEN t = 'error' AND text IS NULL THEN '{{"type":"error"}}' WHEN t = 'error' AND text = '' THEN '{{"message":"","type":"error"}}' ELSE nullif(text, '') END, CASE WHEN t = 'command_execution' THEN command END, CASE WHEN t = 'command_execution' THEN out END,
    NULL, CASE WHEN t = 'command_execution' THEN coalesce(exit_code, 0) END, event_index * 2 + 1, event_index * 2 + 1 FROM u WHERE source_format = 'codex_jsonl' AND (t IN ('command_execution', 'assistant_text', 'reasoning', 'error') OR text <> '')
  UNION ALL
  SELECT trajectory_id, event_index, 'jsonl_unknown', 'medium', 'assistant_text', 'unknown', NULL, text, NULL, NULL, NULL, NULL, event_index * 2 + 1, event_index * 2 + 1 FROM u WHERE source_format = 'opencode_jsonl' AND text <> ''
  UNION ALL
  SELECT trajectory_id, event_index, 'plain_trace', 'low', CASE WHEN t = 'tool_call' THEN t ELSE 'assistant_text' END, 'assistant', CASE WHEN t = 'tool_call' THEN coalesce(tool_name, 'none') END, CASE WHEN t = 'tool_call' THEN 'Tool call: ' || coalesce(tool_name, 'none') ELSE 'Assistant — turn ' || event_index END || chr(10) || 'x' || coalesce(md5(text), ''),
    NULL, NULL, NULL, NULL, event_index * 2 + 1, event_index * 2 + 2 FROM u WHERE source_format = 'plain_trace'),
n AS (SELECT trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY event_index) - 1 AS INTEGER) AS event_index, f AS source_format, event_type, role, tool_name, {_CAP('text')} AS text, {_CAP('command')} AS command, {_CAP('command_output')} AS command_output, file_path, exit_code, a AS source_line_start, b AS source_line_end, c AS parser_confidence,
  list_filter([CASE WHEN length(text) > 4000 THEN 'text' END, CASE WHEN length(command) > 4000 THEN 'command' END, CASE WHEN length(command_output) > 4000 THEN 'command_output' END], lambda q: q IS NOT NULL) AS truncated_fields FROM x)"""


def _first_stage(s, d) -> DataFrame:
    return first_stage.events(*_first_stage_lines(s, d))


@query(f"WITH {_FIRST} SELECT * REPLACE (md5(text) AS text, md5(command_output) AS command_output) FROM n")
def first_stage_events(s, d):
    """Logs of all recorders through the first-stage reader."""
    return _first_stage(s, d).withColumns({c: F.md5(c) for c in ("text", "command_output")})


@query(f"WITH {_FIRST} SELECT trajectory_id, coalesce(min(n.source_format), 'unparsed') AS source_format, coalesce(min(parser_confidence), 'low') AS parser_confidence FROM (SELECT DISTINCT trajectory_id FROM u) LEFT JOIN n USING (trajectory_id) GROUP BY 1")
def first_stage_formats(s, d):
    """The chain of formats, with the confidence of the one that applies."""
    logs, traces = _first_stage_lines(s, d)
    return first_stage.source_formats(lines.records(logs, "trajectory_id"), traces, "trajectory_id")


_FIRST_STATUS = f"{_FIRST}, i AS (SELECT DISTINCT trajectory_id FROM run_inventory), k AS (SELECT i.trajectory_id, count(n.event_index) AS c, coalesce(bool_or(event_type = 'result'), false) AS ended, coalesce(bool_or(event_type = 'error'), false) AS failed FROM i LEFT JOIN n USING (trajectory_id) GROUP BY 1)"


@query(f"WITH {_FIRST_STATUS} SELECT trajectory_id, CASE WHEN c = 0 THEN 'unavailable' WHEN ended THEN 'complete' ELSE 'partial' END AS behavior_status, CASE WHEN c = 0 THEN 'unknown' WHEN failed THEN 'failed' WHEN ended THEN 'complete' ELSE 'incomplete' END AS trajectory_status FROM k")
def first_stage_status(s, d):
    return first_stage.completeness(_first_stage(s, d), table(s, d, "run_inventory"))


_SCRIPT, _PARENT = literal(first_stage.SCRIPT), literal(first_stage.PARENT)
_CAND = f"""{_EV}, k AS (SELECT trajectory_id, event_index, event_type, CASE WHEN command <> '' THEN command WHEN event_type = 'tool_call' AND lower(coalesce(tool_name, '')) IN ('bash', 'shell', 'command') THEN nullif(text, '') END AS command, nullif(file_path, '') AS script_path, lower(coalesce(tool_name, '')) AS tool FROM e),
m AS (SELECT *, coalesce(regexp_matches(script_path, {_SCRIPT}) AND tool IN ('write', 'edit', 'notebookedit'), false) AS written, coalesce(regexp_matches(command, {literal(labels.V1_LAUNCH)}) AND (regexp_matches(command, {literal(labels.V1_TRAIN)}) OR regexp_matches(command, {literal(labels.V1_EVAL)}) OR regexp_matches(command, {literal(labels.V1_CHECKPOINT)})), false) AS launched FROM k),
q AS (SELECT *, CASE WHEN written AND command IS NULL THEN 'proposed' ELSE 'executed' END AS kind FROM m WHERE written OR launched),
f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY trajectory_id, kind, coalesce(command, ''), coalesce(script_path, '') ORDER BY event_index) = 1),
v AS (SELECT *, concat_ws(' ', coalesce(command, script_path), script_path) AS source FROM f),
w AS (SELECT * EXCLUDE (method, update, data, objective, training, evaluation, checkpoint), training AND ok AS tr, evaluation AND ok AS evl, checkpoint AND ok AS cp, method, update, data, objective FROM (SELECT v.*, kind = 'executed' AND event_type IN ('command_execution', 'tool_call') AS ok, {labels.v1_command_sql('coalesce(command, script_path)').replace("coalesce(coalesce(command, script_path), '')", 'source')} FROM v))"""


@query(f"""WITH {_CAND} SELECT trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY event_index) - 1 AS BIGINT) AS experiment_index, kind AS executed_or_proposed, command, script_path, tr AS training_launched, evl AS evaluation_launched, cp AS checkpoint_created, nullif(regexp_extract(source, {_PARENT}, 1), '') AS checkpoint_parent,
method AS method_family, update AS update_mechanism, data AS data_regime, objective AS objective_or_reward, event_index FROM w""")
def candidate_experiments(s, d):
    """First-stage candidates: launches and written scripts, the first of each (kind, command, path)."""
    e = table(s, d, "agent_event").select("trajectory_id", "event_index", "event_type", "tool_name", "command", "text", "file_path")
    return first_stage.experiments(e)


# ---- the second normalizers ------------------------------------------------------------------------
@query(f"""WITH {_EV}, u AS (SELECT *, event_type AS t FROM e WHERE source_format <> 'plain_trace'), x AS (
  SELECT trajectory_id, event_index AS o, source_format, CASE WHEN t IN ('tool_call', 'command_execution') THEN 'tool_call' ELSE t END AS event_type, CASE WHEN t IN ('user_text', 'tool_result') THEN 'user' WHEN t IN ('result', 'system') THEN 'system' ELSE 'assistant' END AS role, CASE WHEN t IN ('tool_call', 'command_execution') THEN tool_name END AS tool_name,
    CASE WHEN t IN ('tool_call', 'command_execution') THEN command END AS command, CASE WHEN t = 'tool_result' THEN coalesce(command_output, '') END AS command_output, CAST(NULL AS INTEGER) AS exit_code, CASE WHEN t IN ('tool_call', 'command_execution', 'tool_result') THEN call_id END AS call_id, CASE WHEN t IN ('tool_call', 'command_execution', 'tool_result', 'result') THEN 'completed' END AS lifecycle_status
  FROM u WHERE source_format = 'claude_jsonl' AND (t IN ('assistant_text', 'reasoning', 'tool_call', 'command_execution', 'tool_result', 'result', 'system') OR (t = 'user_text' AND text <> ''))
  UNION ALL
  SELECT trajectory_id, event_index, source_format, CASE WHEN t IN ('command_execution', 'reasoning', 'assistant_text', 'error') THEN t ELSE 'result' END, CASE WHEN t IN ('command_execution', 'reasoning', 'assistant_text') THEN 'assistant' ELSE 'system' END, NULL, CASE WHEN t = 'command_execution' THEN command END, CASE WHEN t = 'command_execution' THEN command_output END, CASE WHEN t = 'command_execution' THEN exit_code END,
    CASE WHEN t = 'command_execution' THEN call_id END, CASE WHEN t = 'error' THEN 'error' ELSE 'completed' END FROM u WHERE source_format = 'codex_jsonl'
  UNION ALL
  SELECT trajectory_id, event_index, source_format, CASE WHEN t IN ('tool_call', 'tool_result', 'command_execution') THEN 'tool_call' WHEN t = 'result' THEN 'result' ELSE 'assistant_text' END, CASE WHEN t = 'result' THEN 'system' ELSE 'assistant' END, CASE WHEN t IN ('tool_call', 'tool_result', 'command_execution') THEN tool_name END, CASE WHEN t IN ('tool_call', 'tool_result', 'command_execution') THEN command END, CASE WHEN t IN ('tool_call', 'tool_result', 'command_execution') THEN nullif(command_output, '') END,
    CASE WHEN t IN ('tool_call', 'tool_result', 'command_execution') THEN exit_code END, CASE WHEN t IN ('tool_call', 'tool_result', 'command_execution') THEN call_id END, CASE WHEN t IN ('tool_call', 'tool_result', 'command_execution', 'result') THEN 'completed' END FROM u WHERE source_format = 'opencode_jsonl')
SELECT trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY o) - 1 AS INTEGER) AS event_index, source_format, event_type, role, tool_name, md5(command) AS command, md5(command_output) AS command_output, exit_code, call_id, lifecycle_status FROM x""")
def recorder_events(s, d):
    """Records of three recorders through their normalizers."""
    e = _events(s, d).where("source_format <> 'plain_trace'")
    t, f = F.col("event_type"), F.col("source_format")
    part = lambda kind, *fields: F.struct(F.lit(kind).alias("type"), *fields)
    said = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content")).alias("message")
    claude = (
        F.when(t == "assistant_text", _typed("assistant", said("assistant", part("text", F.col("text")))))
        .when(t == "reasoning", _typed("assistant", said("assistant", part("thinking", F.col("text").alias("thinking")))))
        .when(t == "user_text", _typed("user", F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message")))
        .when(t.isin("tool_call", "command_execution"), _typed("assistant", said("assistant", part("tool_use", F.col("tool_name").alias("name"), F.col("call_id").alias("id"), F.struct("command", "file_path", F.col("file_content").alias("content")).alias("input")))))
        .when(t == "tool_result", _typed("user", said("user", part("tool_result", F.col("command_output").alias("content"), F.col("call_id").alias("tool_use_id")))))
        .when(t == "result", _typed("result", F.col("text").alias("result")))
        .when(t == "system", _typed("system", F.lit("init").alias("subtype")))
    )
    item = lambda kind, *fields: _typed("item.completed", part(kind, *fields).alias("item"))
    codex = (
        F.when(t == "command_execution", item("command_execution", F.col("call_id").alias("id"), F.col("command"), F.col("command_output").alias("aggregated_output"), F.col("exit_code")))
        .when(t == "assistant_text", item("agent_message", F.coalesce("text", F.lit("")).alias("text"))).when(t == "reasoning", item("reasoning", F.col("text")))
        .when(t == "error", _typed("error", F.col("text").alias("message"))).otherwise(_typed("turn.completed"))
    )
    state = F.struct(F.struct("command", "file_path").alias("input"), F.col("command_output").alias("output"), F.col("exit_code").alias("exit"), F.lit("completed").alias("status")).alias("state")
    opencode = (
        F.when(t.isin("tool_call", "tool_result", "command_execution"), _typed("tool_use", F.struct(F.lit("tool").alias("type"), F.col("tool_name").alias("tool"), F.col("call_id").alias("callID"), state).alias("part")))
        .when(t == "result", _typed("step_finish", F.struct(F.lit("step-finish").alias("type"), F.lit("stop").alias("reason")).alias("part")))
        .otherwise(_typed("text", F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")).alias("part")))
    )
    line = F.when(f == "claude_jsonl", claude).when(f == "codex_jsonl", codex).otherwise(opencode)
    recs = lines.records(e.select("trajectory_id", (F.col("event_index") + 1).alias("line_no"), line.alias("line")).where("line is not null"), "trajectory_id")
    made = normalize.events(recs.where("rec is not null"))
    return made.select("trajectory_id", "event_index", "source_format", "event_type", "role", "tool_name", F.md5("command").alias("command"), F.md5("command_output").alias("command_output"), "exit_code", "call_id", "lifecycle_status")


_OUT = "o AS (SELECT trajectory_id, event_index, unnest(string_split(command_output, chr(10))) AS line, generate_subscripts(string_split(command_output, chr(10)), 1) AS line_no FROM e WHERE command_output <> '' AND source_format = 'plain_trace')"


@query(rf"""WITH {_EV}, {_OUT}, k AS (SELECT trajectory_id, event_index, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS l FROM o), m AS (SELECT *, CASE WHEN regexp_matches(l, '(?i)assistant\s*(?:[-\x{{2014}}:]|turn)') THEN 'assistant' WHEN starts_with(lower(l), 'tool call') OR starts_with(lower(l), 'tool:') THEN 'tool_call' WHEN starts_with(lower(l), 'tool result') OR starts_with(lower(l), 'output:') THEN 'tool_result'
  WHEN regexp_matches(l, '(?:^|\s)(?:python|bash|sh)\s+[^ ]+') THEN 'command' ELSE 'text' END AS raw FROM k)
SELECT trajectory_id, event_index, line_no, raw AS raw_event_type, CASE raw WHEN 'tool_call' THEN 'tool_call' WHEN 'tool_result' THEN 'tool_result' WHEN 'command' THEN 'command_execution' ELSE 'assistant_text' END AS event_type, CASE WHEN raw = 'tool_result' THEN 'user' ELSE 'assistant' END AS role, md5(CASE WHEN raw = 'command' THEN l END) AS command FROM m""")
def plain_line_events(s, d):
    """Each line of a plain trace as an event, by rules in order."""
    e = table(s, d, "agent_event").where("source_format = 'plain_trace' and command_output <> ''").select("trajectory_id", "event_index", "command_output").distinct()
    each = e.select("trajectory_id", "event_index", F.posexplode(F.split("command_output", "\n")).alias("line_no", "line"))
    return each.select("trajectory_id", "event_index", (F.col("line_no") + 1).alias("line_no"), normalize.plain_event(F.col("line")).alias("e")).select("trajectory_id", "event_index", "line_no", "e.raw_event_type", "e.event_type", "e.role", F.md5("e.command").alias("command"))


@query(f"""WITH {_FIRST}, p AS (SELECT trajectory_id, event_index * 2 + 1 AS line_no, CASE WHEN t = 'tool_call' THEN t ELSE 'assistant_text' END AS kind, CASE WHEN t = 'tool_call' THEN coalesce(tool_name, 'none') END AS tool_name FROM u WHERE source_format = 'plain_trace')
SELECT trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY line_no) - 1 AS BIGINT) AS block, kind, tool_name, line_no AS line_start, line_no + 1 AS line_end FROM p""")
def plain_trace_blocks(s, d):
    """Marker lines open blocks of a plain trace, other lines join them."""
    return lines.plain_blocks(_first_stage_lines(s, d)[1], "trajectory_id").select("trajectory_id", "block", "kind", "tool_name", "line_start", "line_end")


_USED = "SELECT doc_id, source, coalesce(n_chars, 0) AS i, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE length(text) END AS o, doc_id % 7 AS k FROM documents WHERE text IS NOT NULL"


@query(f"WITH x AS ({_USED}) SELECT source, count(*) AS messages, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(k) AS BIGINT) AS cache_creation_input_tokens, CAST(0 AS BIGINT) AS cache_read_input_tokens, CAST(sum(i + o + k) AS BIGINT) AS total_tokens FROM x GROUP BY 1")
def token_usage(s, d):
    """Token counts of assistant messages, read from log lines with a time before their JSON; missing counts are 0."""
    docs = table(s, d, "documents").where("text is not null")
    used = F.struct(F.col("n_chars").alias("input_tokens"), F.when(F.col("doc_id") % 3 != 0, F.length("text")).alias("output_tokens"), (F.col("doc_id") % 7).alias("cache_creation_input_tokens"))
    record = _typed("assistant", F.struct(used.alias("usage")).alias("message"))
    return lines.token_usage(docs.select("source", F.concat(F.lit("[2026-01-01T00:00:00Z] "), record).alias("line")), "source")


# ---- sinks read back ---------------------------------------------------------------------------------
def _folder(s, name: str) -> str:
    return f"{ensure_checkpoint_dir(s)}/{name}"


_TABLE = f"WITH {_INV} SELECT trajectory_id, batch_id, benchmark, budget_hours FROM inv"


@query(_TABLE)
def csv_annotations(s, d):
    """A table written as CSV with a fixed header and read by its schema."""
    path = _folder(s, "csv_annotations")
    inventory.write_csv(_inventory(s, d), path, ["trajectory_id", "batch_id", "benchmark", "budget_hours"])
    return inventory.read_csv(s, path, "trajectory_id string, batch_id string, benchmark string, budget_hours int")


@query(_TABLE)
def jsonl_annotations(s, d):
    """A table written as JSON lines with sorted keys and read by its schema."""
    path = _folder(s, "jsonl_annotations")
    inventory.write_jsonl(_inventory(s, d).select("trajectory_id", "batch_id", "benchmark", "budget_hours"), path)
    return inventory.read_jsonl(s, path, "trajectory_id string, batch_id string, benchmark string, budget_hours int")


@query(f"WITH {_CALLS}, {_INV} SELECT scaffold_family AS log, 'accuracy' AS metric, count_if(exit_code = 0) / count(*) AS value, count(*) AS n_records FROM c JOIN inv USING (trajectory_id) WHERE exit_code IS NOT NULL AND evaluation_launched GROUP BY 1")
def evaluation_logs(s, d):
    """Evaluation logs, a head of metrics and its records, written and read back."""
    per = _results(s, d).join(_inventory(s, d).select("trajectory_id", F.col("scaffold_family").alias("log")), "trajectory_id")
    records = per.select("log", "trajectory_id", "n", "ok")
    heads = records.groupBy("log").agg((F.sum("ok") / F.sum("n")).alias("accuracy"))
    path = _folder(s, "evaluation_logs")
    inventory.write_evaluation_logs(heads, records, "log", path)
    head, body = inventory.read_evaluation_logs(s, path, "log string, accuracy double", "log string, trajectory_id string, n bigint, ok bigint", "log")
    return head.select("log", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")).join(body.groupBy("log").agg(F.sum("n").alias("n_records")), "log")


# ---- small operators -------------------------------------------------------------------------------
_ROWS = "a AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS p FROM documents), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS p FROM (SELECT DISTINCT item_id FROM benchmark_item))"


@query(f"WITH {_ROWS} SELECT item_id, doc_id, source FROM b JOIN a USING (p)")
def positional_zip(s, d):
    """Items and documents side by side, by their place in order of their ids; the longer side's rest is dropped."""
    side = lambda df, by: ordered.numbered(df.withColumn("_one", F.lit(0)), ["_one"], by, "_p").drop("_one")
    docs = side(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    items = side(table(s, d, "benchmark_item").select("item_id").distinct(), "item_id")
    return items.join(docs, "_p").select("item_id", "doc_id", "source")


@query("SELECT item_id, TRY_CAST(trim(answer) AS BIGINT) AS answer FROM benchmark_item WHERE regexp_matches(trim(answer), '^[+-]?[0-9]+$') AND TRY_CAST(trim(answer) AS BIGINT) BETWEEN 0 AND 999")
def integer_answers(s, d):
    """Items whose answer is a whole number from 0 to 999."""
    a = F.trim("answer")
    n = F.when(a.rlike("^[+-]?[0-9]+$"), a.try_cast("bigint"))
    return table(s, d, "benchmark_item").select("item_id", n.alias("answer")).where(F.col("answer").between(0, 999))


#: Names of languages that drop a sample unless it also speaks of Python (fixed values).
OTHER_LANGUAGES = ["javascript", "typescript", "java", "c++", "c#", "golang", "rust", "ruby", "php", "swift", "kotlin", "html", "css", "sql", "bash", "matlab"]


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND (len(list_filter([{', '.join(map(literal, OTHER_LANGUAGES))}], lambda w: contains(lower(text), w))) = 0 OR contains(lower(text), 'python'))")
def language_filter(s, d):
    low = F.lower("text")
    named = F.exists(F.array(*[F.lit(w) for w in OTHER_LANGUAGES]), lambda w: low.contains(w))
    return table(s, d, "documents").where(F.col("text").isNotNull() & (~named | low.contains("python"))).select("doc_id")


@query("WITH x AS (SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, source) AS INTEGER) AS place FROM x")
def source_distribution(s, d):
    """Counts by source, the commonest first; ties by name, so the order is total."""
    counts = table(s, d, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "source", "n"))).alias("xs"))  # one entry a source
    return listed.select(F.posexplode("xs").alias("p", "x")).select("x.source", "x.n", (F.col("p") + 1).alias("place")).orderBy("place")


@query("SELECT doc_id, source FROM documents WHERE source = 'solution_text' AND length(text) >= 50 ORDER BY doc_id LIMIT 100")
def early_stop_scan(s, d):
    """The first hundred kept rows in order of their id: each task keeps a hundred at most."""
    return table(s, d, "documents").where((F.col("source") == "solution_text") & (F.length("text") >= 50)).select("doc_id", "source").orderBy("doc_id").limit(100)


_SPACED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_TOUCH = f"""{_EV}, w AS (SELECT trajectory_id, event_index, file_content AS t FROM e WHERE file_content IS NOT NULL), hit AS (SELECT DISTINCT w.trajectory_id, w.event_index, i.item_id FROM w JOIN benchmark_item i ON contains({_SPACED.format('w.t')}, {_SPACED.format('i.text')}) WHERE {_SPACED.format('i.text')} <> ''),
df AS (SELECT DISTINCT trajectory_id, event_index, i.item_id FROM w JOIN (SELECT item_id, regexp_extract(text, 'def\\s+(\\w+)\\s*\\(', 1) AS f FROM benchmark_item) i ON i.f <> '' AND i.f NOT IN ('main', 'solution', 'solve', 'test', 'check') AND list_contains(regexp_extract_all(w.t, 'def\\s+(\\w+)\\s*\\(', 1), i.f))"""


def _written(s, d) -> DataFrame:
    return table(s, d, "agent_event").where("file_content is not null").select("trajectory_id", "event_index", "file_content")


def _touched(s, d) -> DataFrame:
    items = table(s, d, "benchmark_item").select("item_id", F.col("text").alias("item_text"))
    whole = ordered.containment(_written(s, d), items, "file_content", "item_text").select("trajectory_id", "event_index", "item_id", F.lit("text").alias("why"))
    defined = F.array_distinct(F.regexp_extract_all("file_content", F.lit(r"def\s+(\w+)\s*\("), F.lit(1)))
    names = items.select("item_id", F.nullif(F.regexp_extract("item_text", r"def\s+(\w+)\s*\(", 1), F.lit("")).alias("f")).where(~F.col("f").isin("main", "solution", "solve", "test", "check"))
    named = _written(s, d).select("trajectory_id", "event_index", F.explode(defined).alias("f")).join(names, "f").select("trajectory_id", "event_index", "item_id", F.lit("name").alias("why"))
    return whole.unionByName(named).distinct()


@query(f"WITH {_TOUCH} SELECT *, 'text' AS why FROM hit UNION ALL SELECT *, 'name' FROM df")
def decontaminate_containment(s, d):
    """Written files that hold an item's whole text or define its function, with the item."""
    return _touched(s, d)


@query(f"WITH {_TOUCH}, t AS (SELECT DISTINCT trajectory_id, event_index FROM (SELECT * FROM hit UNION ALL SELECT * FROM df)), k AS (SELECT DISTINCT trajectory_id, event_index FROM w) SELECT (SELECT count(*) FROM k) AS n_files, (SELECT count(*) FROM t) AS n_dropped, CAST(0 AS BIGINT) AS n_left")
def clean_after_decontamination(s, d):
    """Files before and dropped, and what the same test still finds in the files kept: it must be nothing."""
    files = _written(s, d)
    touched = _touched(s, d).select("trajectory_id", "event_index").distinct()
    kept = files.join(touched, ["trajectory_id", "event_index"], "left_anti")
    items = table(s, d, "benchmark_item").select("item_id", F.col("text").alias("item_text"))
    left = ordered.containment(kept, items, "file_content", "item_text").agg(F.count("*").alias("n_left"))
    one = files.select("trajectory_id", "event_index").distinct().agg(F.count("*").alias("n_files"), F.lit(1).alias("k"))
    two = touched.agg(F.count("*").alias("n_dropped"), F.lit(1).alias("k"))
    return one.join(two, "k").join(left.withColumn("k", F.lit(1)), "k").select("n_files", "n_dropped", "n_left")


_EXPECTED = ["claude", "codex", "other", "unlisted"]


@query(f"""WITH {_CALLS}, {_INV}, r AS (SELECT coalesce(scaffold_family, 'unknown') AS k, count(*) AS n, count_if(exit_code = 0) AS ok FROM c JOIN inv USING (trajectory_id) WHERE exit_code IS NOT NULL AND evaluation_launched GROUP BY 1)
SELECT x.k AS scaffold_family, coalesce(n, 0) AS n, coalesce(ok, 0) AS n_correct, coalesce(round(ok / n, 9), 0) AS accuracy FROM (VALUES ('claude'), ('codex'), ('other'), ('unlisted')) x(k) LEFT JOIN r ON r.k = x.k""")
def accuracy_expected_keys(s, d):
    """Accuracy of every expected key, at zero where there is nothing."""
    per = _results(s, d).join(_inventory(s, d).select("trajectory_id", F.coalesce("scaffold_family", F.lit("unknown")).alias("scaffold_family")), "trajectory_id").groupBy("scaffold_family").agg(F.sum("n").alias("n"), F.sum("ok").alias("n_correct"))
    names = s.createDataFrame([(k,) for k in _EXPECTED], "scaffold_family string")
    return names.join(per, "scaffold_family", "left").withColumn("accuracy", ninth(F.col("n_correct") / F.col("n"))).fillna(0, ["n", "n_correct", "accuracy"])


@query("""WITH j AS (SELECT row_number() OVER (ORDER BY event_id) AS line_no, CASE event_type WHEN 'signup' THEN 'prediction' WHEN 'purchase' THEN 'eval_result' WHEN 'view' THEN 'analysis' END AS type, CAST(user_id AS VARCHAR) AS checkpoint, value FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY checkpoint, type ORDER BY line_no) AS occurrence FROM j WHERE type IS NOT NULL), w AS (SELECT checkpoint, occurrence, max(value) FILTER (type = 'prediction') AS p, max(value) FILTER (type = 'eval_result') AS r, bool_or(type = 'analysis') AS a FROM o GROUP BY 1, 2)
SELECT checkpoint, occurrence, round(r - p, 6) AS gap, coalesce(a, false) AS analysed FROM w WHERE p IS NOT NULL""")
def journal_matching(s, d):
    """Predictions with the result and the analysis of the same checkpoint and occurrence, in line order."""
    kind = F.when(F.col("event_type") == "signup", "prediction").when(F.col("event_type") == "purchase", "eval_result").when(F.col("event_type") == "view", "analysis")
    e = table(s, d, "events").withColumn("_one", F.lit(0))
    journal = ordered.numbered(e, ["_one"], "event_id", "line_no").select("line_no", kind.alias("type"), F.col("user_id").cast("string").alias("checkpoint"), F.format_string("%.10f", "value").alias("payload"))
    return queue.matched_journal(journal).select("checkpoint", "occurrence", F.round("gap", 6).alias("gap"), F.col("analysis").isNotNull().alias("analysed"))
