"""The first-stage reader: records of logs into a small event vocabulary, by a chain of formats with confidence.

Records are VARIANT values of numbered lines. A run's format is the first that applies:
one recorder's, the other's, any JSON lines with text, a plain trace; else it is unparsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions import labels
from tracequarry.functions.text import capped
from tracequarry.operators import ordered
from tracequarry.operators.normalize import V1_CAP, get
from tracequarry.session import cut_lineage
from tracequarry.sources import lines

#: Record types of the two recorders, in the order they are tried, and the confidence of each format (fixed values).
TYPES = {
    "claude_jsonl": ["system", "assistant", "user", "result"],
    "codex_jsonl": ["thread.started", "turn.started", "turn.completed", "item.started", "item.updated", "item.completed", "error"],
}
CONFIDENCE = {"claude_jsonl": "high", "codex_jsonl": "high", "jsonl_unknown": "medium", "plain_trace": "low", "unparsed": "low"}
#: Names of a command and of a path among a call's arguments (fixed values).
COMMANDS, PATHS = ["command", "cmd", "script"], ["file_path", "path", "filename"]
FIELDS = ["event_type", "role", "tool_name", "text", "command", "command_output", "file_path", "exit_code"]
#: A script whose writing proposes an experiment, tools that write, tools whose text is a command, a resumed checkpoint (fixed values).
SCRIPT, WRITERS, SHELLS = r"(?i)(?:train|sft|grpo|dpo|rl|finetun|fine[-_ ]?tune|ppo)", ["write", "edit", "notebookedit"], ["bash", "shell", "command"]
PARENT = r"(?i)(?:resume[_ -]?from[_ -]?checkpoint|checkpoint[_ -]?path)\s*[= ]\s*([^\s]+)"


def _array(*events: Column) -> Column:
    return F.array_compact(F.array(*events))


def _event(**values) -> Column:
    out = []
    for f in FIELDS:
        x = values.get(f)
        x = F.lit(x) if x is None or isinstance(x, str) else x
        out.append(x.cast("int" if f == "exit_code" else "string").alias(f))
    return F.struct(*out)


def _first(v: Column, keys: list[str]) -> Column:
    return F.coalesce(*[get(v, f"$.{k}") for k in keys])


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def claude_events(rec: Column) -> Column:
    """Events of a message's parts, or of a result."""
    kind = get(rec, "$.type")
    role = F.when(kind.isin("assistant", "user", "system"), kind).otherwise("unknown")
    content = F.when(_is_object(get(rec, "$.message", "variant")), get(rec, "$.message.content", "variant")).otherwise(get(rec, "$.content", "variant"))
    is_list = F.coalesce(F.schema_of_variant(content).startswith("ARRAY"), F.lit(False))

    def part(p: Column) -> Column:
        t = get(p, "$.type")
        inp = F.coalesce(get(p, "$.input", "variant"), get(p, "$.arguments", "variant"))
        out = F.coalesce(F.nullif(get(p, "$.content"), F.lit("")), F.nullif(get(p, "$.output"), F.lit("")), get(p, "$.text"))
        return (
            F.when((t == "text") & (get(p, "$.text") != ""), _event(event_type="assistant_text", role=role, text=get(p, "$.text")))
            .when(t.isin("tool_use", "tool_call"), _event(event_type="tool_call", role=role, tool_name=F.coalesce(get(p, "$.name"), get(p, "$.tool_name")), text=get(p, "$.text"), command=_first(inp, COMMANDS), file_path=_first(inp, PATHS)))
            .when(t.isin("tool_result", "tool_response"), _event(event_type="tool_result", role="user", text=out, command_output=out, exit_code=get(p, "$.exit_code", "int")))
        )

    single = F.nullif(get(content, "$"), F.lit(""))
    talk = kind.isin("assistant", "user", "system")
    parts = F.when(talk & is_list, F.transform(get(content, "$", "array<variant>"), part)).otherwise(F.array(F.when(talk & single.isNotNull(), _event(event_type="assistant_text", role=role, text=single))))
    result = F.coalesce(F.nullif(get(rec, "$.result"), F.lit("")), get(rec, "$.content"))
    return F.array_compact(F.concat(F.array(F.when(kind == "result", _event(event_type="result", role="unknown", text=result))), parts))


def codex_events(rec: Column) -> Column:
    """The event of an item, an error or a note."""
    kind = get(rec, "$.type")
    item = F.when(_is_object(get(rec, "$.item", "variant")), get(rec, "$.item", "variant")).otherwise(rec)
    t = get(item, "$.type")
    command = get(item, "$.command")
    code = F.coalesce(get(item, "$.exit_code", "int"), F.when(get(item, "$.status") == "completed", F.lit(0)))
    note = F.coalesce(F.nullif(get(item, "$.text"), F.lit("")), F.nullif(get(rec, "$.message"), F.lit("")))
    message = F.coalesce(F.nullif(get(rec, "$.message"), F.lit("")), F.nullif(get(rec, "$.error"), F.lit("")), F.to_json(rec))
    return _array(
        F.when(kind == "error", _event(event_type="error", role="unknown", text=message))
        .when(t == "reasoning", _event(event_type="assistant_text", role="assistant", text=get(item, "$.text")))
        .when(t == "agent_message", _event(event_type="assistant_text", role="assistant", text=F.coalesce(F.nullif(get(item, "$.text"), F.lit("")), get(item, "$.message"))))
        .when(t == "command_execution", _event(event_type="command_execution", role="assistant", tool_name="command_execution", command=command, text=command, command_output=F.coalesce(F.nullif(get(item, "$.aggregated_output"), F.lit("")), get(item, "$.output")), exit_code=code))
        .when(kind.isin(TYPES["codex_jsonl"]) & note.isNotNull(), _event(event_type="assistant_text", role="unknown", text=note))
    )


def unknown_events(rec: Column) -> Column:
    """Any record with a text keeps it."""
    text = F.coalesce(*[F.nullif(get(rec, f"$.{k}"), F.lit("")) for k in ("text", "message", "content")])
    return _array(F.when(text.isNotNull(), _event(event_type="assistant_text", role="unknown", text=text)))


def _claude_tells(rec: Column) -> Column:
    """Whether claude_events gives one, without making it."""
    kind = get(rec, "$.type")
    content = F.when(_is_object(get(rec, "$.message", "variant")), get(rec, "$.message.content", "variant")).otherwise(get(rec, "$.content", "variant"))
    parts = F.coalesce(get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    tells = F.exists(parts, lambda p: get(p, "$.type").isin("tool_use", "tool_call", "tool_result", "tool_response") | ((get(p, "$.type") == "text") & (get(p, "$.text") != "")))
    is_list = F.coalesce(F.schema_of_variant(content).startswith("ARRAY"), F.lit(False))
    return (kind == "result") | (kind.isin("assistant", "user", "system") & F.when(is_list, F.coalesce(tells, F.lit(False))).otherwise(F.coalesce(get(content, "$") != "", F.lit(False))))


def _codex_tells(rec: Column) -> Column:
    """Whether codex_events gives one, without making it."""
    kind = get(rec, "$.type")
    item = F.when(_is_object(get(rec, "$.item", "variant")), get(rec, "$.item", "variant")).otherwise(rec)
    some = lambda v, path: F.coalesce(get(v, path) != "", F.lit(False))
    return F.coalesce(kind == "error", F.lit(False)) | F.coalesce(get(item, "$.type").isin("reasoning", "agent_message", "command_execution"), F.lit(False)) | (kind.isin(TYPES["codex_jsonl"]) & (some(item, "$.text") | some(rec, "$.message")))


def _unknown_tells(rec: Column) -> Column:
    return F.coalesce(*[F.nullif(get(rec, f"$.{k}"), F.lit("")) for k in ("text", "message", "content")]).isNotNull()


def source_formats(records: DataFrame, traces: DataFrame, key: str) -> DataFrame:
    """(key, source_format, parser_confidence) of each run: records have (key, rec), traces (key, line).

    The first format that yields an event, of those whose record types occur.
    """
    rec = F.col("rec")
    kind = get(rec, "$.type")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = records.where("rec is not null").groupBy(key).agg(
        has(kind.isin(TYPES["claude_jsonl"])).alias("a"), has(_claude_tells(rec)).alias("ea"),
        has(kind.isin(TYPES["codex_jsonl"])).alias("b"), has(_codex_tells(rec)).alias("eb"), has(_unknown_tells(rec)).alias("ec"),
    )
    plain = traces.groupBy(key).agg(has(F.col("line").rlike(lines.TURN) | F.col("line").rlike(lines.TOOL)).alias("ed"))
    both = seen.join(plain, key, "full")
    told = lambda c: F.coalesce(c, F.lit(False))
    name = (
        F.when(told(F.col("a") & F.col("ea")), "claude_jsonl").when(told(F.col("b") & F.col("eb")), "codex_jsonl")
        .when(told(F.col("ec")), "jsonl_unknown").when(told(F.col("ed")), "plain_trace").otherwise("unparsed")
    )
    confidence = F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p])
    return both.select(key, name.alias("source_format")).withColumn("parser_confidence", confidence[F.col("source_format")])


def events(numbered: DataFrame, traces: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """Events of runs' log lines, or of their traces where the log gives none: numbered from 0 in order of line and part, capped.

    numbered and traces: (key, line_no, line). A log's lines are parsed where they are read.
    """
    recs = lines.records(numbered, key).where("rec is not null").select(key, "line_no", "rec")
    formats = source_formats(recs, traces, key)
    rec = F.col("rec")
    made = F.when(F.col("source_format") == "claude_jsonl", claude_events(rec)).when(F.col("source_format") == "codex_jsonl", codex_events(rec)).when(F.col("source_format") == "jsonl_unknown", unknown_events(rec))
    own = recs.join(formats, key).select(key, "source_format", "parser_confidence", "line_no", F.col("line_no").alias("line_end"), made.alias("es")).where(F.size("es") > 0)
    blocks = lines.plain_blocks(traces.join(formats.where("source_format = 'plain_trace'").select(key), key, "left_semi"), key)
    block = _event(event_type=F.when(F.col("kind") == "tool_call", "tool_call").otherwise("assistant_text"), role="assistant", tool_name=F.col("tool_name"), text=F.col("text"))
    plain = blocks.select(key, F.lit("plain_trace").alias("source_format"), F.lit("low").alias("parser_confidence"), F.col("line_start").alias("line_no"), "line_end", F.array(block).alias("es"))
    # written once: numbering reads its rows twice, and records are dear to parse
    every = ordered.running_sum(cut_lineage(own.unionByName(plain)), [key], "line_no", {"upto": F.size("es")})
    each = every.select(key, "source_format", "parser_confidence", "line_no", "line_end", (F.col("upto") - F.size("es")).alias("before"), F.posexplode("es").alias("k", "e"))
    flat = each.select(key, (F.col("before") + F.col("k")).cast("int").alias("event_index"), "source_format", "e.*", F.col("line_no").alias("source_line_start"), F.col("line_end").alias("source_line_end"), "parser_confidence")
    caps = ["text", "command", "command_output"]
    cut = F.array_compact(F.array(*[F.when(F.length(f) > V1_CAP, F.lit(f)) for f in caps]))
    return flat.withColumn("truncated_fields", cut).withColumns({f: capped(F.col(f), V1_CAP, "\n...[truncated]") for f in caps})


def experiments(first_stage: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """Candidate experiments of events, the first of each (kind, command, path), numbered from 0.

    Executed: a launch of training, evaluation or a checkpoint. Proposed: a script that is
    written without a command; its flags stay false.
    """
    tool = F.lower(F.coalesce("tool_name", F.lit("")))
    command = F.when(F.coalesce(F.length("command"), F.lit(0)) > 0, F.col("command")).when((F.col("event_type") == "tool_call") & tool.isin(SHELLS) & (F.col("text") != ""), F.col("text"))
    path = F.when(F.col("file_path") != "", F.col("file_path"))
    e = first_stage.select(key, "event_index", "event_type", command.alias("command"), path.alias("script_path"), tool.alias("tool"))
    written = F.coalesce(F.col("script_path").rlike(SCRIPT) & F.col("tool").isin(WRITERS), F.lit(False))
    launched = F.coalesce(F.col("command").rlike(labels.V1_LAUNCH) & (F.col("command").rlike(labels.V1_TRAIN) | F.col("command").rlike(labels.V1_EVAL) | F.col("command").rlike(labels.V1_CHECKPOINT)), F.lit(False))
    kept = e.where(launched | written).withColumn("kind", F.when(written & F.col("command").isNull(), "proposed").otherwise("executed"))
    # keys are hashed: commands are long, and only the first of each is kept with its text
    keyed = kept.withColumn("id", F.md5(F.concat_ws("\u0000", "kind", F.coalesce("command", F.lit("")), F.coalesce("script_path", F.lit("")))))
    first = keyed.groupBy(key, "id").agg(F.min(F.struct("event_index", "event_type", "kind", "command", "script_path")).alias("r")).select(key, "r.*")
    v = labels.v1_command(F.coalesce("command", "script_path"), F.col("script_path"))
    ran = (F.col("kind") == "executed") & F.col("event_type").isin("command_execution", "tool_call")
    source = F.concat_ws(" ", F.coalesce("command", "script_path"), "script_path")
    parent = F.nullif(F.regexp_extract(source, PARENT, 1), F.lit(""))
    at = ordered.numbered(first, [key], "event_index", "experiment_index").withColumn("v", v)
    return at.select(
        key, "experiment_index", F.col("kind").alias("executed_or_proposed"), "command", "script_path", (F.col("v.training") & ran).alias("training_launched"), (F.col("v.evaluation") & ran).alias("evaluation_launched"), (F.col("v.checkpoint") & ran).alias("checkpoint_created"),
        parent.alias("checkpoint_parent"), F.col("v.method").alias("method_family"), F.col("v.update").alias("update_mechanism"), F.col("v.data").alias("data_regime"), F.col("v.objective").alias("objective_or_reward"), "event_index",
    )


def completeness(first_stage: DataFrame, runs: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """(key, behavior_status, trajectory_status): a run without events is unavailable and unknown; an error fails it, whatever else it did."""
    has = lambda t: F.coalesce(F.bool_or(F.col("event_type") == t), F.lit(False))
    seen = first_stage.groupBy(key).agg(has("result").alias("ended"), has("error").alias("failed"))
    all_ = runs.select(key).distinct().join(seen, key, "left")
    behavior = F.when(F.col("ended").isNull(), "unavailable").when(F.col("ended"), "complete").otherwise("partial")
    status = F.when(F.col("ended").isNull(), "unknown").when(F.col("failed"), "failed").when(F.col("ended"), "complete").otherwise("incomplete")
    return all_.select(key, behavior.alias("behavior_status"), status.alias("trajectory_status"))
