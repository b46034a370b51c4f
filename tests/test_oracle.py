"""Every query that has SQL gives the same rows in DuckDB; every other one runs."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
NAMES = sorted(entry.queries())


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(int(x)) if isinstance(x, (bool, int)) else str(x).removesuffix("+00:00")


@pytest.fixture(scope="module")
def tables(data):
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, tables, name):
    df = entry.queries()[name](spark, data)
    got = df.collect()
    if name not in SQL:
        return
    columns = sorted(df.columns)
    cursor = tables.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got), key=str) == want


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns [:2] == ["harness_family", "n"]


def test_contexts_take_the_latest_edits_before_a_launch(spark, tmp_path):
    from tracequarry.plans import objectives

    events = [("t", i, "/w/train_x.py", f"v{i} SFTTrainer", None, None) for i in range(0, 24, 2)] + [("t", 1, None, None, "cat > train_x.py <<EOF", None), ("t", 30, "/w/train_x.py", "GRPOTrainer", None, None), ("u", 0, "/w/other.py", "DPOTrainer", None, None)]
    spark.createDataFrame(events, "trajectory_id string, event_index int, file_path string, file_content string, command string, text string").write.parquet(f"{tmp_path}/agent_event.parquet")
    calls = [("t", 0, 20, "python train_x.py", True), ("t", 1, 40, "python train_x.py", True), ("u", 0, 5, "python train_y.py", True), ("t", 2, 50, "ls", False)]
    own = spark.createDataFrame([(t, i, e, c, None, 0, "training", x, False, False) for t, i, e, c, x in calls], "trajectory_id string, call_index int, event_index int, command string, tool_name string, exit_code int, action_category string, training_launched boolean, evaluation_launched boolean, monitoring_action boolean")
    own.write.parquet(f"{tmp_path}/run_call.parquet")
    ctx = {(r.trajectory_id, r.call_index): r.context for r in objectives.objective_contexts(spark, str(tmp_path)).collect()}
    assert ctx["t", 0].splitlines() == [f"v{i} SFTTrainer" for i in range(6, 22, 2)] and ctx["u", 0] is None
    got = {(r.trajectory_id, r.call_index): r.signature for r in objectives.objective_episodes(spark, str(tmp_path)).collect()}
    assert got == {("t", 0): "supervised_likelihood", ("t", 1): "reward_grpo", ("u", 0): "objective_unknown"}


CALL_COLUMNS = "trajectory_id string, call_index int, event_index int, command string, tool_name string, exit_code int, action_category string, training_launched boolean, evaluation_launched boolean, monitoring_action boolean"


def test_the_objective_pipeline_end_to_end(spark, tmp_path):
    """Scripts whose code tells of objectives, launched in turn: the same rows as the SQL, and the ones expected."""
    from tracequarry.plans import objectives

    sft = "from trl import SFTTrainer\nload_dataset('openai/gsm8k')\nmodel = from_pretrained('qwen3-4b-base')"
    own = "SFTTrainer(data='rejection_sampled.jsonl')\nmodel = from_pretrained('out/checkpoint-9')"
    code = [("train_a.py", sft), ("train_b.py", own), ("train_c.py", "GRPOTrainer(reward_funcs=f)"), ("train_d.py", "PPOTrainer()"), ("notes.txt", "see mytrain_a.pyc\nDPOTrainer()"), ("train_x.py", "pass")]
    order = [0, 1, 2, 2, 3, 5, 3, 0]
    events, calls = [], []
    for t in ("t", "u"):
        at = 0
        for name, text in code:
            events.append((t, at, f"/w/{name}", text, None, None))
            at += 1
        for k, i in enumerate(order if t == "t" else order[:3]):
            events.append((t, at, None, None, f"echo window {k} > log", None))
            calls.append((t, k, at + 1, f"python {code[i][0]}", None, 0, "training", True, False, False))
            events.append((t, at + 1, None, None, f"python {code[i][0]}", None))
            at += 2
    calls.append(("v", 0, 3, "python train_sft.py", None, 0, "training", True, False, False))
    spark.createDataFrame(events, "trajectory_id string, event_index int, file_path string, file_content string, command string, text string").write.parquet(f"{tmp_path}/agent_event.parquet")
    spark.createDataFrame(calls, CALL_COLUMNS).write.parquet(f"{tmp_path}/run_call.parquet")
    spark.createDataFrame([("t", "claude_run1", "GSM8K", "m"), ("u", "codex_run1", "GSM8K", "m"), ("v", "codex_run2", None, "m")], "trajectory_id string, batch_id string, benchmark string, base_model string").write.parquet(f"{tmp_path}/run_inventory.parquet")
    con = duckdb.connect()
    for name in ("agent_event", "run_call", "run_inventory"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    rows = {}
    for name in ("objective_episodes", "objective_transitions", "objective_change_rate", "initial_objective_entropy", "initial_objective_dominant", "launch_windows", "data_source_labels", "broad_pairs", "broad_change_rollup", "label_coverage"):
        df = objectives.QUERIES[name](spark, str(tmp_path))
        rows[name] = df.collect()
        columns = sorted(df.columns)
        cursor = con.execute(objectives.SQL[name])
        names = [c[0] for c in cursor.description]
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
        assert sorted((tuple(plain(r[c]) for c in columns) for r in rows[name]), key=str) == want, name
    signatures = {(r.trajectory_id, r.experiment_index): r.signature for r in rows["objective_episodes"]}
    assert [signatures["t", i] for i in range(8)] == ["preference_dpo"] + ["supervised_likelihood", "reward_grpo", "reward_grpo", "reward_ppo", "objective_unknown", "reward_ppo", "preference_dpo"]
    assert signatures["v", 0] == "supervised_likelihood"
    assert [(r.from_experiment, r.to_experiment, r.transition_type) for r in sorted(rows["objective_transitions"], key=str) if r.trajectory_id == "t"] == [(0, 1, "objective_change"), (1, 2, "objective_change"), (2, 3, "same_objective"), (3, 4, "objective_change"), (6, 7, "objective_change")]
    assert {r.data_source for r in rows["data_source_labels"]} >= {"self_generated", "on_policy_inherent", "not_applicable"}
