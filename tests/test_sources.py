"""Lines, records, events, inventory, sinks and streams on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import normalize, statistics
from tracequarry.sources import inventory, lines
from tracequarry.streaming import queue


def recs(spark, text, key="t"):
    df = spark.createDataFrame([(key, text)], "trajectory_id string, text string")
    return lines.records(lines.lines(df, "trajectory_id", "text"), "trajectory_id")


def test_line_classes(spark):
    text = 'WARNING: cuda\n[12:00:00] {"type": "result"}\n{not-json}\n\nprefix {"type": "text"}\n[1]\n'
    got = {r.line_no: r.kind for r in recs(spark, text).collect()}
    assert got == {1: "warning", 2: "json", 3: "malformed", 4: "blank", 5: "json", 6: "warning"}
    c = lines.line_counts(recs(spark, text), "trajectory_id").collect()[0]
    assert (c.lines, c.json_lines, c.malformed_json_lines, c.warnings) == (6, 2, 1, 2)
    assert recs(spark, None).count() == recs(spark, "").count() == 0


def test_claude_events(spark):
    said = {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "python train.py"}}]}}
    back = {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "ok"}]}}
    text = "\n".join(["WARNING: cuda", json.dumps(said), json.dumps(back), json.dumps({"type": "result", "result": "done"})])
    got = normalize.events(recs(spark, text)).orderBy("event_index").collect()
    assert [(r.event_index, r.event_type, r.source_line_start) for r in got] == [(0, "assistant_text", 2), (1, "tool_call", 2), (2, "tool_result", 3), (3, "result", 4)]
    assert (got[1].command, got[1].call_id, got[2].command_output, got[3].lifecycle_status) == ("python train.py", "c1", "ok", "completed")


def test_codex_and_opencode_events(spark):
    started = {"type": "item.started", "item": {"id": "i", "type": "command_execution", "command": "ls"}}
    done = {"type": "item.completed", "item": {"id": "i", "type": "command_execution", "command": "ls", "aggregated_output": "x", "exit_code": 0}}
    got = normalize.events(recs(spark, "\n".join(map(json.dumps, [started, done, {"type": "turn.completed"}])))).orderBy("event_index").collect()
    assert [(r.event_type, r.lifecycle_status, r.exit_code) for r in got] == [("command_execution", "in_progress", None), ("command_execution", "completed", 0), ("result", "completed", None)]
    use = {"type": "tool_use", "timestamp": 5, "part": {"type": "tool", "tool": "write", "callID": "c", "state": {"status": "completed", "input": {"filePath": "a.py", "content": "x = 1"}, "output": "ok", "exit": 0}}}
    e = normalize.events(recs(spark, json.dumps(use))).collect()[0]
    assert (e.source_format, e.file_path, e.file_content, e.command_output, e.exit_code, e.call_id) == ("opencode_jsonl", "a.py", "x = 1", "ok", 0, "c")


def test_plain_traces(spark):
    df = spark.createDataFrame([("t", "lost\nAssistant - turn 1\nI plan\n\nTool call: bash\npython x.py\n")], "trajectory_id string, text string")
    own = lines.lines(df, "trajectory_id", "text")
    blocks = lines.plain_blocks(own, "trajectory_id").orderBy("block").collect()
    assert [(b.kind, b.text, b.line_start, b.line_end) for b in blocks] == [("assistant_text", "Assistant - turn 1\nI plan", 2, 3), ("tool_call", "Tool call: bash\npython x.py", 5, 6)]
    assert blocks[1].tool_name == "bash"
    events = normalize.plain_events(own).orderBy("event_index").collect()
    assert [e.event_type for e in events] == ["assistant_text", "assistant_text", "assistant_text", "tool_call", "command_execution"]
    assert {e.parser_confidence for e in events} == {"low"}


def test_first_stage_caps(spark):
    df = spark.createDataFrame([("x" * 25_000, "c", None)], "text string, command string, command_output string")
    r = normalize.v1_caps(df).collect()[0]
    assert len(r.text) <= 4020 and r.truncated_fields == ["text"] and r.command == "c"


def test_inventory_and_sinks(spark, tmp_path):
    task = tmp_path / "runs" / "codex_demo_10h_run1" / "gsm8k_Qwen_Qwen3-1.7B-Base_12345"
    (task / "task").mkdir(parents=True)
    (task / "solve_out.txt").write_text('{"type": "turn.completed"}\n')
    (task / "metrics.json").write_text('{"accuracy": 50, "total_samples": 9, "b": {"c": 2}}')
    (task / "time_taken.txt").write_text(" 1:00:00 \n")
    (task / "task" / "solve_out.txt").write_text("nested")
    (task / "task" / "eval_result.json").write_text('{"score": 0.25}')
    got = inventory.inventory(spark, str(tmp_path / "runs")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.benchmark, r.base_model, r.run_replicate, r.budget_hours, r.family, r.total_duration) == ("GSM8K", "Qwen3-1.7B-Base", "12345", 10, "codex", "1:00:00")
    assert r.source_path.endswith("solve_out.txt") and len(r.duplicate_content_hash) == 64 and len(r.trajectory_id) == 20
    assert [(m.metric_name, m.metric_value) for m in inventory.workspace_metrics(spark, str(tmp_path / "runs")).collect()] == [("score", 0.25)]
    texts = spark.createDataFrame([("t", '{"accuracy": 50, "total_samples": 9, "b": {"c": 2}}')], "k string, text string")
    assert [(m.metric_name, m.metric_value) for m in inventory.metric_rows(texts, "k", "text").collect()] == [("accuracy", 0.5)]
    inv = inventory.inventory(spark, str(tmp_path / "runs"))
    assert inventory.manifest(inv, {"a": 1}, ["y", "x"]) == inventory.manifest(inv, {"a": 1}, ["x", "y"])
    out = spark.createDataFrame([(1, [1, 2], None)], "b int, a array<int>, c string")
    inventory.write_jsonl(out, str(tmp_path / "j"))
    assert "".join(p.read_text() for p in (tmp_path / "j").glob("*.json")) == '{"a":[1,2],"b":1,"c":null}\n'
    inventory.write_csv(out, str(tmp_path / "c"), ["b", "missing", "a"])
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv")).splitlines()[0] == "b,missing,a"
    inventory.write_parquet(out, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert "| 1 |" in inventory.markdown_table(out.select("b"))


def test_streams(spark, tmp_path):
    (tmp_path / "q").mkdir()
    for i, c in enumerate(["a", "b", "a"]):
        (tmp_path / "q" / f"{i}.json").write_text(json.dumps({"timestamp": str(i), "checkpoint": c}))
    once = queue.once_by_key(queue.request_stream(spark, str(tmp_path / "q"), 1).select("checkpoint"))
    assert sorted(r.checkpoint for r in queue.drained(once, str(tmp_path / "cp1"), str(tmp_path / "rows1")).collect()) == ["a", "b"]
    (tmp_path / "r").mkdir()
    for i, ok in enumerate([False, False, False, True]):
        file = tmp_path / "r" / f"{i}.json"
        file.write_text(json.dumps({"key": "k", "ok": ok}))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of time
    results = spark.readStream.schema("key string, ok boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "r"))
    got = queue.drained(queue.with_retries(results, ttl=None), str(tmp_path / "cp2"), str(tmp_path / "rows2")).collect()
    assert sorted((r.tries, r.verdict) for r in got) == [(1, "retry"), (2, "retry"), (3, "given_up"), (4, "done")]


def test_journal_in_line_order(spark):
    j = spark.createDataFrame([(1, "prediction", "a", "0.5"), (2, "eval_result", "a", "0.75"), (3, "prediction", "a", "0.6"), (4, "analysis", "a", "why"), (5, "eval_result", "b", "1")], queue.JOURNAL)
    got = {(r.checkpoint, r.occurrence): (r.eval_result, r.analysis, r.gap) for r in queue.matched_journal(j).collect()}
    assert got == {("a", 1): ("0.75", "why", 0.25), ("a", 2): (None, None, None)}
    assert [r.line_no for r in queue.last_lines(j, 2).collect()] == [4, 5]
    assert queue.budget(3600, 10)["remaining"] == 32400


def test_bootstrap_and_code(spark):
    df = spark.createDataFrame([(float(i % 7), f"c{i % 40}") for i in range(400)], "v double, c string")
    a, b = (statistics.cluster_bootstrap(df, "v", "c").collect()[0] for _ in range(2))
    assert a == b and a.low < a.mean < a.high
    empty = statistics.cluster_bootstrap(df.where("v < 0"), "v", "c").collect()[0]
    assert (empty.mean, empty.low, empty.high) == (None, None, None)
    code = spark.createDataFrame([('def f(x):\n    """doc"""\n    return x\n',), ("def broken(",), (None,), ("",)], "x string")
    got = code.select(statistics.python_functions("x").alias("f"), statistics.valid_python("x").alias("v")).collect()
    assert got[0].f[0].name == "f" and got[0].f[0].docstring == "doc" and [r.v for r in got] == [True, False, None, True]
    d = spark.createDataFrame([('{"option": "keep", "reason": "x"}',), ('{"option": "keep", "reason": " "}',), ('{"option": "other", "reason": "x"}',), ("no",), (None,)], "x string")
    assert [r.v for r in d.select(statistics.valid_decision(F.col("x")).alias("v")).collect()] == [True, False, False, False, False]


def test_usage_behind_prefixes(spark):
    said = lambda i, o: json.dumps({"type": "assistant", "message": {"usage": {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": None}}})
    df = spark.createDataFrame([("t", "\n".join(["[12:00] " + said(5, 7), said(1, 2), '{"type": "user"}', '{"type": "assistant"}']))], "t string, text string")
    r = lines.token_usage(lines.lines(df, "t", "text"), "t").collect()
    assert [(x.messages, x.input_tokens, x.output_tokens, x.total_tokens) for x in r] == [(2, 6, 9, 15)]
    assert lines.required_rows(df, "t", "t").count() == 1
    try:
        lines.required_rows(df, "t", "u")
        raise AssertionError("an empty result must be an error")
    except ValueError:
        pass


def test_evaluation_logs_and_reports(spark, tmp_path):
    heads = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "log string, accuracy double")
    records = spark.createDataFrame([("a", i, None if i % 2 else "x") for i in range(40)], "log string, i int, answer string")
    inventory.write_evaluation_logs(heads, records, "log", f"{tmp_path}/logs")
    head, body = inventory.read_evaluation_logs(spark, f"{tmp_path}/logs", "log string, accuracy double", "log string, i int, answer string", "log")
    assert {tuple(r) for r in head.collect()} == {("a", 0.5), ("b", 1.0)} and body.count() == 40 and body.where("answer is null").count() == 20
    first = [f.read_text().splitlines()[0] for f in (tmp_path / "logs" / "log=a").glob("*.txt") if '"type":"meta"' in f.read_text()]
    assert len(first) == 1 and '"type":"meta"' in first[0]
    report = inventory.markdown_report("Runs", [("All", "Two logs.", heads.orderBy("log"))])
    assert report.splitlines()[:3] == ["# Runs", "", "## All"] and "| a | 0.5 |" in report
    table = spark.createDataFrame([("a|b", None)], "x string, y string")
    assert inventory.markdown_table(table).splitlines()[2] == "| a\\|b |  |"


def test_json_is_not_cut_at_a_depth(spark):
    from tracequarry.functions import metrics

    deep = "".join('{"a":' for _ in range(6)) + "1" + "}" * 6
    df = spark.createDataFrame([(deep,)], "j string")
    assert [(r.name, r.value) for r in metrics.json_leaves(df, "j").collect()] == [("a.a.a.a.a.a", 1.0)]
    with pytest.raises(ValueError):
        metrics.json_leaves(df, "j", most_depth=5)


def test_first_stage_reader(spark):
    """One recorder before the other, then any JSON, then a trace; proposals are not executed."""
    from tracequarry.operators import first_stage

    logs = [
        ("c", 1, 'warning: x'), ("c", 2, '[t] {"type":"assistant","message":{"content":[{"type":"text","text":"hi"},{"type":"tool_use","name":"Bash","input":{"cmd":"ls"}}]}}'), ("c", 3, '{"type":"result","result":"done"}'),
        ("x", 1, '{"type":"item.completed","item":{"type":"command_execution","command":"python train.py","status":"completed"}}'), ("x", 2, '{"type":"error","message":"no"}'),
        ("u", 1, '{"type":"other","message":"kept"}'), ("n", 1, "no json"), ("p", 1, "{broken"),
    ]
    traces = [("p", 1, "lost"), ("p", 2, "Assistant — turn 1"), ("p", 3, "body"), ("p", 4, "Tool call: Write"), ("c", 1, "Tool call: unused")]
    schema = "trajectory_id string, line_no int, line string"
    got = first_stage.events(spark.createDataFrame(logs, schema), spark.createDataFrame(traces, schema)).collect()
    rows = {(r.trajectory_id, r.event_index): (r.source_format, r.parser_confidence, r.event_type, r.role, r.tool_name, r.text, r.command, r.exit_code, r.source_line_start, r.source_line_end) for r in got}
    assert rows == {
        ("c", 0): ("claude_jsonl", "high", "assistant_text", "assistant", None, "hi", None, None, 2, 2), ("c", 1): ("claude_jsonl", "high", "tool_call", "assistant", "Bash", None, "ls", None, 2, 2), ("c", 2): ("claude_jsonl", "high", "result", "unknown", None, "done", None, None, 3, 3),
        ("x", 0): ("codex_jsonl", "high", "command_execution", "assistant", "command_execution", "python train.py", "python train.py", 0, 1, 1), ("x", 1): ("codex_jsonl", "high", "error", "unknown", None, "no", None, None, 2, 2),
        ("u", 0): ("jsonl_unknown", "medium", "assistant_text", "unknown", None, "kept", None, None, 1, 1), ("p", 0): ("plain_trace", "low", "assistant_text", "assistant", None, "Assistant — turn 1\nbody", None, None, 2, 3),
        ("p", 1): ("plain_trace", "low", "tool_call", "assistant", "Write", "Tool call: Write", None, None, 4, 4),
    }
    formats = {r.trajectory_id: (r.source_format, r.parser_confidence) for r in first_stage.source_formats(lines.records(spark.createDataFrame(logs, schema), "trajectory_id"), spark.createDataFrame(traces, schema), "trajectory_id").collect()}
    assert formats["p"] == ("plain_trace", "low") and formats["u"] == ("jsonl_unknown", "medium")
    events = [("t", 0, "tool_call", "Write", None, "script", "train_rl.py"), ("t", 1, "command_execution", "command_execution", "python train_rl.py --lr 1e-5", None, None), ("t", 2, "command_execution", "command_execution", "python evaluate.py", None, None), ("t", 3, "command_execution", None, "python evaluate.py", None, None), ("t", 4, "tool_call", "bash", None, "sh train.sh --resume_from_checkpoint out/c1", None), ("t", 5, "tool_call", "Write", None, "x", "notes.md")]
    found = first_stage.experiments(spark.createDataFrame(events, "trajectory_id string, event_index int, event_type string, tool_name string, command string, text string, file_path string")).orderBy("experiment_index").collect()
    assert [(r.executed_or_proposed, r.training_launched, r.evaluation_launched, r.checkpoint_parent) for r in found] == [("proposed", False, False, None), ("executed", True, False, None), ("executed", False, True, None), ("executed", True, False, "out/c1")]


def test_reward_from_a_file(spark, tmp_path):
    from tracequarry.functions import rewards

    (tmp_path / "r.py").write_text("def compute_score(data_source, solution_str, ground_truth, extra_info=None):\n    return {'score': float(solution_str == ground_truth)}\n")
    df = spark.createDataFrame([("s", "4", "4"), ("s", "4", "5"), ("s", None, "5")], "s string, a string, t string")
    got = df.select(rewards.plugged_reward(str(tmp_path / "r.py"), F.col("s"), F.col("a"), F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [1.0, 0.0, None]


def test_unknown_settings_are_refused():
    from tracequarry.plans.config import Config

    assert Config.read(Config(benchmarks=("a",)).text()) == Config(benchmarks=("a",))
    with pytest.raises(ValueError):
        Config.read('{"budget": 3}')
