"""Rule tables: the fixtures of the rules, and both forms (Catalyst and SQL) against each other."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracequarry.functions import labels, metrics, text

ACTIONS = {
    "python -m pip install trl peft accelerate": "environment_setup",
    "python train_sft.py --epochs 1": "training",
    "python scripts/merge_lora.py --adapter a": "checkpoint",
    "sleep 5 && python train_sft.py": "monitoring",
    "python train_sft.py --output_dir checkpoints": "checkpoint",
    "pkill -f 'python train_grpo.py'": "debugging",
    "cat > train.py <<'EOF'\nimport x\nEOF\npython train.py": "inspection",
    "python evaluate.py --limit 10": "evaluation",
    "ls -la out": "inspection",
    "nvidia-smi": "monitoring",
    "python -c 'print(1)'": "other",
    "": "other",
}


def values(spark, xs, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_actions_in_both_forms(spark):
    commands = list(ACTIONS)
    got = values(spark, [*commands, None], labels.action(F.col("x")))
    assert [g.split("/")[0] for g in got] == [*ACTIONS.values(), "other"]
    con = duckdb.connect()
    for c, g in zip([*commands, None], got):
        assert con.execute(f"SELECT {labels.action_sql('x')} FROM (SELECT CAST(? AS VARCHAR) AS x)", [c]).fetchall()[0][0] == g


@pytest.mark.parametrize(("code", "signature"), [
    ("SFTTrainer(model, data='dpo_pairs.jsonl')", "supervised_likelihood"), ("GRPOTrainer(x)", "reward_grpo"), ("PPOTrainer(x)", "reward_ppo"), ("DPOTrainer(x)", "preference_dpo"),
    ("teacher logits and student with kl_div", "on_policy_distillation"), ("", "objective_unknown"), (None, "objective_unknown"),
])
def test_objective_by_code(spark, code, signature):
    df = spark.createDataFrame([(code,)], "code string")
    got = df.select(labels.objective(F.lit("python run.py"), F.col("code")).alias("o")).collect()[0].o
    assert got.signature == signature
    assert got.form == labels.FORM[signature]


def test_objective_by_name_is_weaker(spark):
    df = spark.createDataFrame([("python train_grpo.py",), ("bash x/run-dpo.sh",), ("python train.py",)], "x string")
    got = [(r.o.signature, r.o.confidence) for r in df.select(labels.objective(F.col("x"), F.lit(None).cast("string")).alias("o")).collect()]
    assert got == [("reward_grpo", "medium"), ("preference_dpo", "medium"), ("objective_unknown", "none")]


def test_judgements(spark):
    xs = ["No contamination_judgement.txt produced.", "no contamination detected", "only allowed use detected", "contamination detected", "judgement file not found", None]
    assert values(spark, xs, labels.judgement_v1(F.col("x"), "contamination"))[:2] == ["unknown", "clean"]
    assert values(spark, xs, labels.judgement_v1(F.col("x"), "disallowed"))[2] == "clean"
    assert values(spark, xs, labels.judgement_v3(F.col("x")))[3:] == ["flagged", "clean", "missing"]


def test_names(spark):
    t = values(spark, ["gsm8k_Qwen_Qwen3-1.7B-Base_12345", "odd_x", None], labels.task_name(F.col("x")))
    assert (t[0].benchmark, t[0].base_model, t[0].run_replicate, t[0].reasons) == ("GSM8K", "Qwen3-1.7B-Base", "12345", [])
    assert (t[1].benchmark, t[1].reasons) == ("odd", ["unrecognized_benchmark", "unrecognized_base_model"])
    b = values(spark, ["codex_demo_10h_run1"], labels.batch_name(F.col("x")))[0]
    assert (b.family, b.budget_hours) == ("codex", 10)
    assert values(spark, ["opencode_1h_claude-opus-4-6"], labels.harness(F.col("x"))) == ["OpenCode"]
    assert values(spark, ["codex_a_run3_x", "codex_reprompt", "codex"], labels.run_label(F.col("x"))) == ["run3", "reprompt", "single"]
    assert values(spark, ["Qwen3-4B something", "other", "", None], labels.canonical_model(F.col("x"))) == ["Qwen3-4B-Base", "other", None, None]


def test_first_stage(spark):
    got = values(spark, ["python train_rl.py --lr 1e-5", "python evaluate.py", "python train.py --lr 1e-5 --epochs 2"], labels.v1_command(F.col("x"), F.lit(None).cast("string")))
    assert [(r.training, r.evaluation) for r in got] == [(True, False), (False, True), (True, False)]
    assert got[2].method == "sft"


def test_data_and_weights(spark):
    xs = ["train --data out/rft_data.jsonl config.json abc.parquet", "python t.py --model out/checkpoint-5", "from_pretrained('Qwen/Qwen3-4B-Base')", "nothing"]
    assert values(spark, xs, labels.data_files(F.col("x")))[0] == ["abc.parquet", "out/rft_data.jsonl"]
    assert values(spark, xs, labels.init_source(F.col("x"))) == ["unknown", "checkpoint", "base", "unknown"]
    no = F.lit(False)
    form = F.lit("supervised_likelihood")
    ys = ["x/generated_data.jsonl", "load_dataset('gsm8k')", "load_dataset('gsm8k') rft_data", "plain"]
    assert values(spark, ys, labels.data_source(form, F.col("x"), no, no)) == ["self_generated", "curated", "mixed", "unknown"]
    assert values(spark, ys[:1], labels.data_source(F.lit("reward_optimization"), F.col("x"), no, no)) == ["on_policy_inherent"]


def test_metric_text(spark):
    df = spark.createDataFrame([(1, "accuracy: 50%\nscore = 0.7 accuracy: 632"), (2, "accuracy was 3/4"), (3, None), (4, "")], "i int, x string")
    got = {(r.i, r.metric_name, r.metric_value) for r in metrics.text_metrics(df, "x").collect()}
    assert got == {(1, "accuracy", 0.5), (1, "score", 0.7), (2, "accuracy", 0.75)}


def test_json_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": true, "b": {"c": 2, "d": {"accuracy": 0.5}}}'), (2, "{no"), (3, None), (4, "[1]")], "i int, x string")
    got = {(r.i, r.name, r.value) for r in metrics.json_leaves(df, "x").collect()}
    assert got == {(1, "b.c", 2.0), (1, "b.d.accuracy", 0.5)}


def test_answers(spark):
    xs = ["x #### 1,234", "#### 42.", "none", "<think>#### 9</think> #### 7", None]
    assert values(spark, xs, text.hash_answer(F.col("x"))) == ["1234", "42.", None, "7", None]
    got = values(spark, xs, text.exact_score(F.col("x"), F.lit("1234")))
    assert [(g.acc, g.pred) for g in got[:3]] == [(1, "1234"), (0, "42."), (0, "[NO_ANSWER]")]
    assert values(spark, ["ANSWER: 5", "\\boxed{\\frac{1}{2}} and", None], text.answer_line(F.col("x"))) == ["5", "\\frac{1}{2}", None]


def test_rewards(spark):
    long = "the same words over and over, "
    xs = ["Answer: 1/2", "Answer: 7", "Answer: some words", "\\boxed{3}", "nothing", long * 5, long * 5 + "\nAnswer: 0.5"]
    assert values(spark, xs, text.shaped_reward(F.col("x"), F.lit("0.5"))) == [1.0, 0.1, 0.05, -0.05, 0.0, -0.1, 1.0]
    assert values(spark, ["#### 5", "#### 6", "5"], text.numeric_reward(F.col("x"), F.lit("5.0"))) == [1.1, 0.1, 0.0]


def test_small_text_functions(spark):
    assert values(spark, ["9:16:39", "3:05", "took 41 seconds", "", None], text.duration_seconds(F.col("x"))) == [33399.0, 185.0, 41.0, None, None]
    assert values(spark, ["a" * 12], text.capped(F.col("x"), 10, "+")) == ["a" * 10 + "+"]
    assert values(spark, ["```python\nx = 1\n``` rest", "y"], text.code_of(F.col("x"), F.lit("def f():\n"))) == ["def f():\nx = 1\n", "def f():\ny"]
    df = spark.createDataFrame([([("system", "s"), ("Human", "q"), ("gpt", "a")], ["x", "y"], [False, True])], "m array<struct<role:string,content:string>>, a array<string>, v array<boolean>")
    r = df.select(text.first_message(F.col("m"), "user").alias("u"), text.first_message(F.col("m"), "assistant").alias("g"), text.first_verified(F.col("a"), F.col("v")).alias("f")).collect()[0]
    assert (r.u, r.g, r.f) == ("q", "a", "y")


def test_answers_that_agree(spark):
    pairs = [(r"\dfrac12", r"\frac{1}{2}", True), ("x = 5", "5", True), ("1/2", "0.5", True), (".5", "0.5", True), (r"\frac1{23}", r"\frac{1}{23}", True), (r"90^\circ", "90", True), (r"50\%", "50.0", True),
             ("5.0000001", "5", True), ("2.5", "2.6", False), ("03/4", r"\frac{3}{4}", False), ("a/b", "a/b", True), ("total = 5", "5", False), (None, "1", False), ("", "", True), (r"\frac", r"\frac", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r for r in df.where(text.same_answer(F.col("a"), F.col("b")) != F.col("want")).collect()] == []
