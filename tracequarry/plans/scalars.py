"""Scalar functions, small readers and timers as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions import labels, metrics, rewards, text
from tracequarry.functions.rules import literal
from tracequarry.operators import statistics
from tracequarry.plans.config import Config, total_order
from tracequarry.plans.reference import _CALLS, _INV, QUERIES, SQL, _inventory, ninth, query, rows
from tracequarry.session import ensure_checkpoint_dir, table
from tracequarry.sources import inventory, lines
from tracequarry.streaming import queue

__all__ = ["QUERIES"]


def _docs(s, d):
    return table(s, d, "documents").where("text is not null")


def _with_truth(s, d):
    docs = _docs(s, d).select("doc_id", "text", "source", (F.lit(10000) + F.col("doc_id") % 3000).alias("item_id"))
    return docs.join(table(s, d, "benchmark_item").select("item_id", "answer"), "item_id", "left")


_TRUTH = "k AS (SELECT d.doc_id, d.text, d.source, i.answer FROM documents d LEFT JOIN benchmark_item i ON i.item_id = 10000 + d.doc_id % 3000 WHERE d.text IS NOT NULL)"


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_hash FROM documents WHERE text IS NOT NULL")
def normalised_text(s, d):
    return _docs(s, d).select("doc_id", F.md5(text.one_space(F.col("text"))).alias("text_hash"))


_MODEL = "replace(lower(base_model), ' ', '')"


@query(f"SELECT DISTINCT trajectory_id, {labels._first_word_sql('lower(batch_id)', labels.V3_AGENTS, chr(39) + 'Unknown' + chr(39))} AS agent, CASE WHEN base_model <> '' THEN {labels._first_word_sql(_MODEL, labels.V3_MODELS, 'base_model')} END AS model FROM run_inventory")
def agent_and_model(s, d):
    i = rows(s, d, "run_inventory", "trajectory_id", "batch_id", "base_model")
    return i.select("trajectory_id", labels.agent(F.col("batch_id")).alias("agent"), labels.canonical_model(F.col("base_model")).alias("model")).distinct()


_LEAF = "replace(lower(regexp_replace(name, '^.*\\.', '')), ' ', '_')"


@query(f"WITH x AS ({SQL['json_flatten_numeric']}) SELECT log_stream, file_seq, line_no, name, CASE WHEN value > 1 AND value <= 100 THEN value / 100 ELSE value END AS value FROM x WHERE ({_LEAF} IN ({', '.join(map(literal, metrics.METRIC_KEYS))}) OR regexp_matches({_LEAF}, {literal(metrics.METRIC_PARTS)})) AND NOT regexp_matches({_LEAF}, {literal(metrics.COUNT_PARTS)})")
def metric_leaves(s, d):
    """Numbers of JSON records whose key is a metric's, percentages as fractions."""
    leaves = metrics.json_leaves(rows(s, d, "eval_log_raw", "log_stream", "file_seq", "line_no", "record"), "record")
    return leaves.where(metrics.is_metric(F.col("name"))).select("log_stream", "file_seq", "line_no", "name", metrics.as_fraction(F.col("value")).alias("value"))


@query("""SELECT DISTINCT log_stream, file_seq, line_no, CASE WHEN record IS NULL THEN 'missing' WHEN NOT json_valid(record) THEN 'invalid' WHEN json_type(record::JSON, '$.accuracy') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN 'valid' ELSE 'unrecognized' END AS status FROM eval_log_raw""")
def metrics_statuses(s, d):
    """missing, invalid, unrecognized or valid: whether a JSON document is there, is JSON and holds the metric."""
    r = rows(s, d, "eval_log_raw", "log_stream", "file_seq", "line_no", "record")
    n = F.when(F.try_variant_get(F.try_parse_json("record"), "$.accuracy", "double").isNotNull(), 1).otherwise(0)
    return r.select("log_stream", "file_seq", "line_no", inventory.metrics_status(F.col("record"), n).alias("status"))


@query("SELECT item_id, md5('User: ' || trim(text) || chr(10) || chr(10) || 'Assistant: ' || trim(answer)) AS prompt FROM benchmark_item WHERE answer IS NOT NULL AND text IS NOT NULL")
def chat_prompts(s, d):
    i = table(s, d, "benchmark_item").where("answer is not null and text is not null")
    return i.select("item_id", F.md5(text.chat_prompt(F.col("text"), F.col("answer"))).alias("prompt"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN benchmark WHEN item_id % 2 = 0 THEN split WHEN item_id % 5 = 0 THEN answer END AS verified FROM benchmark_item")
def first_verified_generation(s, d):
    at = lambda n: F.col("item_id") % n == 0
    chosen = text.first_verified(F.array("benchmark", "split", "answer"), F.array(at(3), at(2), at(5)))
    return table(s, d, "benchmark_item").select("item_id", chosen.alias("verified"))


@query(rf"""WITH {_TRUTH}, a AS (SELECT *, TRY_CAST(translate(trim(replace(regexp_extract_all(right(text, 8192), '#### (\-?[0-9\.\,]+)', 1)[-1], ',', '')), ',$', '') AS DOUBLE) AS p, TRY_CAST(translate(trim(answer), ',$', '') AS DOUBLE) AS t FROM k)
SELECT doc_id, coalesce(CASE WHEN p = t THEN 1.0 ELSE 0.0 END, 0.0)::DOUBLE + CASE WHEN regexp_matches(text, '#### \-?[0-9]') THEN 0.1 ELSE 0.0 END AS reward FROM a""")
def additive_rewards(s, d):
    """Numeric equality and half of the format's reward."""
    return _with_truth(s, d).select("doc_id", text.numeric_reward(F.col("text"), F.col("answer")).alias("reward"))


def _length_score(data_source, solution_str, ground_truth, extra_info):
    return {"score": 1.0 if ground_truth is not None and ground_truth in solution_str else min(len(solution_str), 100) / 1000}


@query(f"WITH {_TRUTH} SELECT doc_id, CASE WHEN coalesce(contains(text, answer), false) THEN 1.0 ELSE least(length(text), 100) / 1000 END AS reward FROM k")
def plugged_rewards(s, d):
    """A reward function handed over as a parameter."""
    r = rewards.plugged_reward(_length_score, F.col("source"), F.col("text"), F.col("answer"))
    return _with_truth(s, d).select("doc_id", r.alias("reward"))


@query(r"""SELECT item_id, regexp_matches(benchmark, '\S') AND item_id % 3 <> 0 AND item_id % 5 <> 0 AS valid FROM benchmark_item""")
def valid_decisions(s, d):
    """Decisions as JSON: exactly option (keep or revert) and a reason."""
    option = F.when(F.col("item_id") % 3 == 0, "wait").when(F.col("item_id") % 2 == 0, "keep").otherwise("revert")
    more = F.when(F.col("item_id") % 5 == 0, F.lit(1))
    made = F.to_json(F.struct(option.alias("option"), F.col("benchmark").alias("reason"), more.alias("extra")))
    return table(s, d, "benchmark_item").select("item_id", statistics.valid_decision(made).alias("valid"))


@query(r"""WITH t AS (SELECT doc_id, source, regexp_replace(text, '(?i)<think>[\s\S]*?</think>', '', 'g') AS x FROM documents WHERE text IS NOT NULL), c AS (SELECT *, coalesce(regexp_extract_all(x, '```(?:python)?\s*\n([\s\S]*?)```', 1)[1], x) AS code, 'def f' || doc_id || '():' AS p FROM t)
SELECT source, count(*) AS n, count_if(len(code) % 3 = 0) AS n_passed, count_if(len(code) % 3 = 0) / count(*) AS accuracy, CAST(sum(length(CASE WHEN contains(code, p) THEN code ELSE p || code END)) AS BIGINT) AS n_chars FROM c GROUP BY 1""")
def code_scores(s, d):
    """The code of each answer, after its prompt, and the accuracy by a given column of passes: code is never run."""
    prompt = F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("():"))
    own = _docs(s, d).select("source", text.code_of(F.col("text"), prompt).alias("code"), text.code_of(F.col("text"), F.lit("")).alias("bare"))
    scored = text.code_accuracy(own.withColumn("passed", F.length("bare") % 3 == 0), "source", "passed", F.sum(F.length("code")).cast("bigint").alias("n_chars"))
    return scored


@query(r"""SELECT doc_id, coalesce(regexp_extract_all(text, '(?im)^\s*ANSWER:\s*(.+?)\s*$', 1)[-1], regexp_extract_all(text, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1)[-1]) AS answer FROM documents WHERE text IS NOT NULL""")
def answer_lines(s, d):
    return _docs(s, d).select("doc_id", text.answer_line(F.col("text")).alias("answer"))


@query("SELECT doc_id, n_chars FROM documents WHERE source = 'chat_sample'")
def required_source(s, d):
    """Rows of one source; none is an error."""
    return lines.required_rows(table(s, d, "documents"), "source", "chat_sample").select("doc_id", "n_chars")


@query(SQL["train_val_split"])
def parquet_split(s, d):
    """Training and validation rows as Parquet files of their own, read back."""
    own = QUERIES["train_val_split"](s, d)
    root = f"{ensure_checkpoint_dir(s)}/parquet_split"
    for name in ("train", "validation"):
        inventory.write_parquet(own.where(F.col("split") == name).select("doc_id"), f"{root}/{name}")
    parts = [s.read.parquet(f"{root}/{name}").withColumn("split", F.lit(name)) for name in ("train", "validation")]
    return parts[0].unionByName(parts[1])


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def last_journal_lines(s, d):
    return queue.last_lines(table(s, d, "events").select(F.col("event_id").alias("line_no"), "event_type")).withColumnRenamed("line_no", "event_id")


@query("""WITH q AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT user_id, ts AS finished, event_id AS done_id FROM events WHERE event_type = 'purchase'),
x AS (SELECT q.user_id, q.event_id, q.ts, min(r.done_id) AS done_id FROM q LEFT JOIN r ON r.user_id = q.user_id AND r.done_id >= q.event_id GROUP BY ALL)
SELECT x.user_id, x.event_id, CASE WHEN r.finished IS NULL THEN 'open' WHEN epoch(r.finished - x.ts) <= 10800 THEN 'done' ELSE 'timed_out' END AS state FROM x LEFT JOIN r USING (user_id, done_id)""")
def cycle_timeouts(s, d):
    """Requests by what became of their next result: in time, after three hours, or none yet."""
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("line_no"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    requests = e.where("event_type = 'signup'").select(F.col("user_id").alias("key"), "line_no", F.col("ts").alias("at"))
    results = e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), "line_no", F.col("ts").alias("at"))
    return queue.cycle_states(requests, results, 10_800).select(F.col("key").alias("user_id"), F.col("line_no").alias("event_id"), "state")


@query(f"WITH {_INV}, m AS (SELECT trajectory_id, 'long' AS cohort FROM inv WHERE budget_hours >= 10 UNION ALL SELECT trajectory_id, 'measured' FROM inv WHERE metrics_path IS NOT NULL) SELECT * FROM m")
def configured_cohorts(s, d):
    """Cohorts as a configuration states them."""
    config = Config.read('{"cohorts": {"long": "budget_hours >= 10", "measured": "metrics_path is not null"}}')
    return total_order(config.membership(_inventory(s, d)), "cohort", "trajectory_id")


@query(f"""WITH {_INV}, b AS (SELECT unnest(['GSM8K', 'HumanEval', 'None']) AS benchmark), m AS (SELECT DISTINCT base_model FROM inv WHERE base_model IS NOT NULL) SELECT b.benchmark, m.base_model, (SELECT count(*) FROM inv WHERE inv.benchmark = b.benchmark AND inv.base_model = m.base_model) AS runs FROM b, m""")
def configured_cells(s, d):
    """Cells as a configuration states them, also those without runs."""
    return Config(benchmarks=("GSM8K", "HumanEval", "None")).cells(_inventory(s, d))


@query(f"""WITH {_CALLS} SELECT action_category, count(*) AS n, round(sum(CASE WHEN exit_code = 0 THEN 1 ELSE 0 END) / count(*), 9) AS ok_rate, dense_rank() OVER (ORDER BY count(*) DESC, action_category NULLS LAST) AS place FROM c GROUP BY 1""")
def ordered_actions(s, d):
    """Action categories in a total order: by how often they occur, ties by name, null last."""
    c = table(s, d, "run_call").select("trajectory_id", "call_index", "event_index", "command", "tool_name", "exit_code", "action_category", "training_launched", "evaluation_launched", "monitoring_action").distinct()
    counts = c.groupBy("action_category").agg(F.count("*").alias("n"), ninth(F.count_if(F.col("exit_code") == 0) / F.count("*")).alias("ok_rate"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("action_category").isNull().alias("last"), "action_category", "n", "ok_rate"))).alias("xs"))  # one entry a category
    return total_order(listed.select(F.posexplode("xs").alias("p", "x")).select("x.action_category", "x.n", "x.ok_rate", (F.col("p") + 1).cast("bigint").alias("place")), "place")

