"""JSON records of agent logs into events, for three recorders and plain traces.

Records are VARIANT values; a record gives none, one or several events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.text import capped
from tracequarry.operators import ordered
from tracequarry.session import cut_lineage

#: Record types of each recorder, in the order of their precedence (fixed values).
RECORDERS = {
    "opencode_jsonl": ["step_start", "step_finish", "tool_use", "text", "reasoning"],
    "codex_jsonl": ["thread.started", "turn.started", "turn.completed", "item.started", "item.updated", "item.completed"],
    "claude_jsonl": ["system", "assistant", "user", "result"],
}
#: Most characters of each field (fixed values).
CAPS = {"text": 12_000, "command": 20_000, "command_output": 20_000, "file_path": 2_000, "file_content": 100_000}
V1_CAP = 4_000
COMMAND_LIKE = r"(?i)(?:python|bash|sh|accelerate|torchrun|\.py|evaluate|train|eval)"
COMMAND_KEYS, PATH_KEYS = ["command", "cmd", "shell"], ["file_path", "filePath", "path", "file", "filename", "notebook_path"]
CONTENT_KEYS = ["content", "newString", "new_string", "newText", "new_text", "patch"]
FIELDS = ["raw_event_type", "event_type", "role", "tool_name", "command", "command_output", "text", "file_path", "file_content", "exit_code", "timestamp", "call_id", "item_id", "lifecycle_status", "parser_confidence"]


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _true(v: Column, path: str) -> Column:
    return F.coalesce(get(v, path, "boolean"), F.lit(False))


def first_text(v: Column, keys: list[str]) -> Column:
    """The first key with a string, in the value or in its `input`."""
    string = lambda p: F.when(_is(get(v, p, "variant"), "STRING"), get(v, p))
    return F.coalesce(*[string(f"$.{k}") for k in keys], *[string(f"$.input.{k}") for k in keys])


def command_of(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.when(get(v, "$").rlike(COMMAND_LIKE), get(v, "$"))).otherwise(first_text(v, COMMAND_KEYS))


def flat_text(v: Column) -> Column:
    """Text of a content value: a string, the texts of a list's parts, or JSON; '' for none."""
    parts = get(v, "$", "array<variant>")
    piece = lambda p: F.when(get(p, "$.type").isin("text", "thinking", "input_text"), F.coalesce(get(p, "$.text"), get(p, "$.thinking"))).when(get(p, "$.type") == "tool_result", get(p, "$.content"))
    joined = F.array_join(F.filter(F.transform(parts, piece), lambda x: x.isNotNull() & (x != "")), "\n")
    return F.when(_is(v, "ARRAY"), joined).otherwise(F.coalesce(get(v, "$"), F.lit("")))


def _event(**values) -> Column:
    out = []
    for f in FIELDS:
        x = values.get(f)
        x = F.lit(x) if x is None or isinstance(x, str) else x
        x = x.cast("int" if f == "exit_code" else "string")
        out.append((capped(x, CAPS[f], "...[truncated]") if f in CAPS else x).alias(f))
    return F.struct(*out)


def _when(test: Column, event: Column) -> Column:
    return F.when(test, event)


def claude_events(rec: Column) -> Column:
    """Array of events of a record."""
    kind = get(rec, "$.type")
    content = get(rec, "$.message.content", "variant")
    role = F.coalesce(get(rec, "$.message.role"), kind)

    def part(p: Column) -> Column:
        t, inp, ident = get(p, "$.type"), get(p, "$.input", "variant"), get(p, "$.id")
        answer = flat_text(get(p, "$.content", "variant"))
        base = {"raw_event_type": kind, "parser_confidence": "high"}
        said = _event(**base, event_type=F.when(t == "thinking", "reasoning").otherwise("assistant_text"), role=role, text=F.coalesce(get(p, "$.thinking"), get(p, "$.text")))
        call = _event(**base, event_type="tool_call", role="assistant", tool_name=get(p, "$.name"), command=command_of(inp), file_path=first_text(inp, PATH_KEYS), file_content=first_text(inp, CONTENT_KEYS), text=capped(get(inp, "$"), 12_000, "...[truncated]"), call_id=ident, item_id=ident, lifecycle_status="completed")
        result = _event(**base, event_type="tool_result", role="user", command_output=answer, text=answer, call_id=get(p, "$.tool_use_id"), item_id=get(p, "$.tool_use_id"), lifecycle_status=F.when(_true(p, "$.is_error"), "error").otherwise("completed"))
        return F.when(t.isin("text", "thinking"), said).when(t == "tool_use", call).when(t == "tool_result", result)

    base = {"raw_event_type": kind, "parser_confidence": "high"}
    plain = flat_text(content)
    stored = get(rec, "$.tool_use_result", "variant")
    out = F.coalesce(*[F.nullif(get(stored, f"$.{k}"), F.lit("")) for k in ("stdout", "output", "stderr")])
    other = F.coalesce(F.nullif(flat_text(get(rec, "$.message", "variant")), F.lit("")), F.nullif(flat_text(get(rec, "$.part", "variant")), F.lit("")))
    talk = kind.isin("assistant", "user")
    single = F.array(
        _when(kind == "system", _event(**base, event_type="system", role="system", text=get(rec, "$.subtype"))),
        _when(kind == "result", _event(**base, event_type="result", role="system", text=get(rec, "$.result"), lifecycle_status=F.when(_true(rec, "$.is_error"), "error").otherwise("completed"))),
        _when(talk & ~_is(content, "ARRAY") & (plain != ""), _event(**base, event_type=F.when(role == "assistant", "assistant_text").otherwise("user_text"), role=role, text=plain)),
    )
    tail = F.array(
        _when(talk & out.isNotNull(), _event(**base, event_type="tool_result", role="user", command_output=out, text=out, lifecycle_status=F.when(_true(stored, "$.is_error"), "error").otherwise("completed"))),
        _when(~F.coalesce(kind.isin("system", "result", "assistant", "user"), F.lit(False)) & other.isNotNull(), _event(raw_event_type=kind, event_type="unknown", role="unknown", text=other, parser_confidence="medium")),
    )
    many = F.when(talk & _is(content, "ARRAY"), F.transform(get(content, "$", "array<variant>"), part)).otherwise(F.array().cast(single_type()))
    return F.array_compact(F.concat(single, many, tail))


def single_type() -> str:
    return "array<struct<" + ",".join(f"{f}:{'int' if f == 'exit_code' else 'string'}" for f in FIELDS) + ">>"


def codex_events(rec: Column) -> Column:
    kind, item = get(rec, "$.type"), get(rec, "$.item", "variant")
    t, ident = get(item, "$.type"), get(item, "$.id")
    lifecycle = kind.isin("item.started", "item.updated", "item.completed")
    status = F.coalesce(get(item, "$.status"), F.when(kind == "item.started", "in_progress").otherwise("completed"))
    base = {"raw_event_type": kind, "parser_confidence": "high", "role": "assistant", "lifecycle_status": status, "item_id": ident}
    named = t.isin("command_execution", "agent_message", "message", "reasoning")
    rest = flat_text(item)
    events = F.array(
        _when(lifecycle & (t == "command_execution"), _event(**base, event_type="command_execution", command=get(item, "$.command"), command_output=get(item, "$.aggregated_output"), exit_code=get(item, "$.exit_code", "int"), call_id=ident)),
        _when(lifecycle & t.isin("agent_message", "message"), _event(**base, event_type="assistant_text", text=F.coalesce(get(item, "$.text"), get(item, "$.content")))),
        _when(lifecycle & (t == "reasoning"), _event(**base, event_type="reasoning", text=get(item, "$.text"))),
        _when(lifecycle & ~F.coalesce(named, F.lit(False)) & (rest != ""), _event(**{**base, "parser_confidence": "medium"}, event_type="unknown", text=rest)),
        _when(kind == "turn.completed", _event(raw_event_type=kind, parser_confidence="high", event_type="result", role="system", text="turn.completed", lifecycle_status="completed")),
        _when(kind == "error", _event(raw_event_type=kind, parser_confidence="high", event_type="error", role="system", text=flat_text(rec), lifecycle_status="error")),
        _when(kind.isin("thread.started", "turn.started"), _event(raw_event_type=kind, parser_confidence="high", event_type=F.replace(kind, F.lit("."), F.lit("_")), role="system", text=kind, lifecycle_status="started")),
    )
    return F.array_compact(events)


def opencode_events(rec: Column) -> Column:
    kind, part = get(rec, "$.type"), get(rec, "$.part", "variant")
    t, state = F.coalesce(get(part, "$.type"), F.lit("")), get(part, "$.state", "variant")
    inp = get(state, "$.input", "variant")
    base = {"raw_event_type": kind, "timestamp": get(rec, "$.timestamp"), "parser_confidence": "high"}
    tool = (kind == "tool_use") | (t == "tool")
    words = ~tool & ((kind == "text") | (t == "text"))
    reason = get(part, "$.reason")
    rest = flat_text(part)
    events = F.array(
        _when(tool, _event(**base, event_type="tool_call", role="assistant", tool_name=get(part, "$.tool"), command=command_of(inp), file_path=first_text(inp, PATH_KEYS), file_content=first_text(inp, CONTENT_KEYS), text=capped(get(inp, "$"), 12_000, "...[truncated]"), command_output=F.coalesce(F.nullif(get(state, "$.output"), F.lit("")), get(state, "$.metadata.output")), exit_code=get(state, "$.exit", "int"), call_id=get(part, "$.callID"), item_id=get(part, "$.id"), lifecycle_status=F.coalesce(get(state, "$.status"), F.lit("completed")))),
        _when(words, _event(**base, event_type="assistant_text", role="assistant", text=get(part, "$.text"))),
        _when(~tool & ~words & (kind == "step_finish"), _event(**base, event_type="result", role="system", text=reason, lifecycle_status=F.when(reason.isNull() | reason.isin("stop", "completed", "tool-calls"), "completed").otherwise(reason))),
        _when(~tool & ~words & (kind == "step_start"), _event(**base, event_type="step_start", role="system", text="step_start", lifecycle_status="started")),
        _when(~tool & ~words & ~F.coalesce(kind.isin("step_finish", "step_start"), F.lit(False)) & (rest != ""), _event(**{**base, "parser_confidence": "medium"}, event_type="unknown", role="unknown", text=rest)),
    )
    return F.array_compact(events)


#: Lines of a plain trace by their kind, in order: a pattern of the line, and the event that it is (fixed values).
PLAIN_LINES = [
    ("assistant", r"(?i)assistant\s*(?:[-\x{2014}:]|turn)", "assistant_text"),
    ("tool_call", r"(?i)^tool(?: call|:)", "tool_call"),
    ("tool_result", r"(?i)^(?:tool result|output:)", "tool_result"),
    ("command", r"(?:^|\s)(?:python|bash|sh)\s+[^ ]+", "command_execution"),
    ("text", "", "assistant_text"),
]


def plain_event(line: Column) -> Column:
    """One event a line of a plain trace, by the first kind that fits."""
    said = F.regexp_replace(line, r"^\s+|\s+$", "")
    values = {
        "assistant_text": {"role": "assistant", "text": said},
        "tool_call": {"role": "assistant", "tool_name": F.trim(F.regexp_replace(said, r"^[^:]*:", ""))},
        "tool_result": {"role": "user", "command_output": said, "text": said},
        "command_execution": {"role": "assistant", "command": said},
    }
    return F.coalesce(*[F.when(said.rlike(pattern), _event(raw_event_type=raw, parser_confidence="low", event_type=kind, **values[kind])) for raw, pattern, kind in PLAIN_LINES])


def recorder(records: DataFrame, key: str) -> DataFrame:
    """(key, source_format): by the record types that occur, in order of precedence; unparsed without any."""
    types = records.where("rec is not null").groupBy(key).agg(F.collect_set(get(F.col("rec"), "$.type")).alias("types"))
    out = F.when(F.lit(False), "")
    for name, known in RECORDERS.items():
        out = out.when(F.arrays_overlap("types", F.array(*[F.lit(t) for t in known])), name)
    return types.select(key, out.otherwise("unparsed").alias("source_format"))


def events(records: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """Events of records (key, line_no, rec), numbered from 0 in order of line and part."""
    typed = records.where("rec is not null").join(recorder(records, key), key)
    rec = F.col("rec")
    made = F.when(F.col("source_format") == "claude_jsonl", claude_events(rec)).when(F.col("source_format") == "codex_jsonl", codex_events(rec)).when(F.col("source_format") == "opencode_jsonl", opencode_events(rec))
    return _number(typed.select(key, "source_format", "line_no", made.alias("es")), key)


def plain_events(numbered: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """Events of the lines of plain traces."""
    kept = numbered.where(F.col("line").rlike(r"\S"))
    return _number(kept.select(key, F.lit("plain_trace").alias("source_format"), "line_no", F.array(plain_event(F.col("line"))).alias("es")), key)


def _number(made: DataFrame, key: str) -> DataFrame:
    # written once: numbering reads its rows twice, and records are dear to parse
    sized = ordered.running_sum(cut_lineage(made.where(F.size("es") > 0)), [key], "line_no", {"upto": F.size("es")})
    each = sized.select(key, "source_format", "line_no", "upto", F.size("es").alias("n"), F.posexplode("es").alias("k", "e"))
    return each.select(key, (F.col("upto") - F.col("n") + F.col("k")).cast("int").alias("event_index"), "source_format", "e.*", F.col("line_no").alias("source_line_start"), F.col("line_no").alias("source_line_end"))


def v1_caps(df: DataFrame) -> DataFrame:
    """The first-stage caps: 4,000 characters and a marked line; truncated_fields names what was cut."""
    fields = ["text", "command", "command_output"]
    cut = F.array_compact(F.array(*[F.when(F.length(f) > V1_CAP, f) for f in fields]))
    return df.withColumn("truncated_fields", cut).withColumns({f: capped(F.col(f), V1_CAP, "\n...[truncated]") for f in fields})
