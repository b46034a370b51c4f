"""Queries of the measurement pipeline, each beside the SQL it is checked against.

Repeated rows of one key count once: every table is read as its distinct rows over the
columns used (deliveries differ in ingested_at alone).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.functions import labels, metrics, text
from tracequarry.functions.rules import literal
from tracequarry.operators import ordered, statistics
from tracequarry.session import cut_lineage, ensure_checkpoint_dir, table
from tracequarry.sources import lines
from tracequarry.streaming import queue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MEANINGFUL = ["training", "evaluation", "checkpoint", "debugging", "data_preparation"]
_IN = "('training', 'evaluation', 'checkpoint', 'debugging', 'data_preparation')"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return table(spark, d, name).select(*columns).distinct()


def _events(s: SparkSession, d: str) -> DataFrame:
    """The event stream as sequences by user; event_id is in time order."""
    return table(s, d, "events").select("user_id", "event_id", "event_type", "value", (F.col("user_id") % 5).alias("harness"))


def ninth(c: Column) -> Column:
    """Sums of doubles depend on their order; nine places are stable."""
    return F.round(c, 9)


# ---- adjacent pairs, episodes, progress -------------------------------------------------
_PAIRS = """e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lag(event_id) OVER w AS before_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT * FROM e WHERE before IS NOT NULL AND before <> 'error' AND event_type <> 'error')"""


def _pairs(s, d):
    return ordered.adjacent_known_pairs(_events(s, d), ["user_id"], "event_id", "event_type", ["error"])


@query(f"WITH {_PAIRS} SELECT user_id % 5 AS harness, count(*) AS pairs, count_if(before <> event_type) AS changes, count_if(before <> event_type) / count(*) AS change_rate FROM p GROUP BY 1")
def event_change_rate(s, d):
    pairs = _pairs(s, d).groupBy((F.col("user_id") % 5).alias("harness")).agg(F.count("*").alias("pairs"), F.count_if("changed").alias("changes"))
    return pairs.withColumn("change_rate", F.try_divide("changes", "pairs"))


@query(f"WITH {_PAIRS} SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS transition_index, before AS from_value, event_type AS to_value, before_id AS from_position, event_id AS to_position, before <> event_type AS changed FROM p")
def event_transitions(s, d):
    return _pairs(s, d)


_CALLS = "c AS (SELECT DISTINCT trajectory_id, call_index, event_index, command, tool_name, exit_code, action_category, training_launched, evaluation_launched, monitoring_action FROM run_call)"
_FAMILY = labels.strategy_family_sql("command", "CAST(NULL AS VARCHAR)", "action_category")
_EPISODES = f"""{_CALLS}, m AS (SELECT *, CASE WHEN training_launched OR row_number() OVER (PARTITION BY trajectory_id ORDER BY call_index) = 1 THEN 1 ELSE 0 END AS o FROM c WHERE action_category IN {_IN}),
i AS (SELECT *, CAST(sum(o) OVER (PARTITION BY trajectory_id ORDER BY call_index) - 1 AS BIGINT) AS episode_index, {_FAMILY} AS family FROM m),
ep AS (SELECT trajectory_id, episode_index, min(call_index) AS start_call, max(call_index) AS end_call, arg_min(family, call_index) AS family, list(action_category ORDER BY call_index) AS action_categories, count(*) AS n_calls FROM i GROUP BY 1, 2)"""


def _calls(s, d):
    return rows(s, d, "run_call", "trajectory_id", "call_index", "event_index", "command", "tool_name", "exit_code", "action_category", "training_launched", "evaluation_launched", "monitoring_action")


def _meaningful(s, d):
    own = _calls(s, d).where(F.col("action_category").isin(MEANINGFUL))
    cut = ordered.islands(own, ["trajectory_id"], "call_index", F.col("training_launched"), "episode_index")
    return cut.withColumn("family", labels.strategy_family(F.col("command"), F.lit(None).cast("string"), F.col("action_category")))


def _episode_rows(s, d):
    # an episode is as long as the stretch between two launches, so its list of categories is no unbounded group
    listed = F.transform(F.array_sort(F.collect_list(F.struct("call_index", "action_category"))), lambda x: x["action_category"])
    return _meaningful(s, d).groupBy("trajectory_id", "episode_index").agg(
        F.min("call_index").alias("start_call"), F.max("call_index").alias("end_call"), F.min_by("family", "call_index").alias("family"), listed.alias("action_categories"), F.count("*").alias("n_calls")
    )


@query(f"WITH {_EPISODES} SELECT * FROM ep")
def episode_islands(s, d):
    return _episode_rows(s, d)


@query(f"""WITH {_EPISODES}, t AS (SELECT trajectory_id, episode_index, lag(family) OVER w AS from_family, family AS to_family FROM ep WINDOW w AS (PARTITION BY trajectory_id ORDER BY episode_index))
SELECT trajectory_id, episode_index AS to_episode, from_family, to_family, CASE WHEN from_family <> to_family AND from_family <> 'other_unknown' AND to_family <> 'other_unknown' THEN 'core' ELSE 'local' END AS transition_type FROM t WHERE from_family IS NOT NULL""")
def strategy_transitions_core_local(s, d):
    return _core_local(_episode_rows(s, d))


def _core_local(episodes):
    ep = episodes.select("trajectory_id", "episode_index", "family")
    lag = ordered.blocked_lag(ep, ["trajectory_id"], "episode_index", F.struct("family"), "b").where("b is not null")
    core = (F.col("b.family") != F.col("family")) & (F.col("b.family") != "other_unknown") & (F.col("family") != "other_unknown")
    return lag.select("trajectory_id", F.col("episode_index").alias("to_episode"), F.col("b.family").alias("from_family"), F.col("family").alias("to_family"), F.when(core, "core").otherwise("local").alias("transition_type"))


@query(f"""WITH {_CALLS}, t AS (SELECT trajectory_id, call_index, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY call_index) - 1 AS BIGINT) AS experiment_index, count(*) OVER (PARTITION BY trajectory_id) AS n FROM c WHERE training_launched)
SELECT trajectory_id, experiment_index, call_index, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE experiment_index / greatest(1, n - 1) END AS normalized_progress FROM t""")
def normalized_progress(s, d):
    own = _calls(s, d).where("training_launched").select("trajectory_id", "call_index")
    at = ordered.numbered(own, ["trajectory_id"], "call_index", "experiment_index")
    n = own.groupBy("trajectory_id").agg(F.count("*").alias("n"))
    progress = F.when(F.col("n") == 1, 1.0).otherwise(F.col("experiment_index") / F.greatest(F.lit(1), F.col("n") - 1))
    return at.join(n, "trajectory_id").select("trajectory_id", "experiment_index", "call_index", progress.alias("normalized_progress"))


@query(f"""WITH {_CALLS} SELECT trajectory_id, call_index, count(*) OVER w AS cumulative_activity, count_if(action_category = 'evaluation') OVER w AS cumulative_evaluations FROM c
WHERE action_category IN {_IN} OR action_category = 'monitoring' WINDOW w AS (PARTITION BY trajectory_id ORDER BY call_index)""")
def cumulative_activity(s, d):
    own = _calls(s, d).where(F.col("action_category").isin([*MEANINGFUL, "monitoring"])).select("trajectory_id", "call_index", "action_category")
    sums = {"cumulative_activity": F.lit(1), "cumulative_evaluations": (F.col("action_category") == "evaluation").cast("int")}
    return ordered.running_sum(own, ["trajectory_id"], "call_index", sums).drop("action_category")


@query(f"""WITH {_EPISODES}, t AS (SELECT trajectory_id, episode_index, family, lag(family) OVER w AS b FROM ep WINDOW w AS (PARTITION BY trajectory_id ORDER BY episode_index)),
x AS (SELECT trajectory_id, count_if(b IS NOT NULL AND b <> family AND b <> 'other_unknown' AND family <> 'other_unknown') AS core, count_if(b IS NOT NULL AND NOT (b <> family AND b <> 'other_unknown' AND family <> 'other_unknown')) AS local,
  min(episode_index) FILTER (b <> family AND b <> 'other_unknown' AND family <> 'other_unknown') AS first_core, max(episode_index) AS last FROM t GROUP BY 1)
SELECT trajectory_id, core AS core_transitions, local AS local_refinements, first_core / greatest(1, last) AS first_change_progress, local / greatest(1, local + core) AS local_development_ratio FROM x""")
def first_change_progress(s, d):
    ep = cut_lineage(_episode_rows(s, d).select("trajectory_id", "episode_index", "family"))  # read twice
    t = _core_local(ep)
    core = F.col("transition_type") == "core"
    last = ep.groupBy("trajectory_id").agg(F.max("episode_index").alias("last"))
    counts = t.groupBy("trajectory_id").agg(F.count_if(core).alias("core_transitions"), F.count_if(~core).alias("local_refinements"), F.min(F.when(core, F.col("to_episode"))).alias("first_core"))
    out = last.join(counts, "trajectory_id", "left").fillna(0, ["core_transitions", "local_refinements"])
    ratio = F.col("local_refinements") / F.greatest(F.lit(1), F.col("local_refinements") + F.col("core_transitions"))
    return out.select("trajectory_id", "core_transitions", "local_refinements", (F.col("first_core") / F.greatest(F.lit(1), F.col("last"))).alias("first_change_progress"), ratio.alias("local_development_ratio"))


_EV = "e AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM agent_event)"


@query(f"""WITH {_EV}, k AS (SELECT *, coalesce(call_id, item_id) AS id, coalesce(call_id, item_id, 'event ' || event_index) AS g FROM e WHERE event_type IN ('tool_call', 'command_execution')),
calls AS (SELECT trajectory_id, g, min(event_index) AS event_index, arg_min(command, event_index) FILTER (command <> '') AS command, arg_max(md5(command_output), event_index) FILTER (command_output <> '') AS output_hash,
  arg_max(exit_code, event_index) FILTER (exit_code IS NOT NULL) AS exit_code, arg_min(tool_name, event_index) FILTER (tool_name <> '') AS tool_name, arg_max(lifecycle_status, event_index) FILTER (lifecycle_status <> '') AS lifecycle_status, count(*) AS n_events FROM k GROUP BY 1, 2)
SELECT trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY event_index) - 1 AS BIGINT) AS call_index, event_index, command, output_hash, exit_code, tool_name, lifecycle_status, n_events FROM calls""")
def lifecycle_merge_first_last(s, d):
    e = table(s, d, "agent_event").where(F.col("event_type").isin("tool_call", "command_execution"))
    output = F.when(F.col("command_output") != "", F.md5("command_output"))  # outputs are long: their hashes travel
    e = e.select("trajectory_id", "event_index", "call_id", "item_id", "command", output.alias("output_hash"), "exit_code", "tool_name", "lifecycle_status").distinct()
    group = F.coalesce("call_id", "item_id", F.concat(F.lit("event "), F.col("event_index").cast("string")))
    filled = lambda c: F.when(F.col(c) != "", F.col("event_index"))
    merged = e.withColumn("g", group).groupBy("trajectory_id", "g").agg(
        F.min("event_index").alias("event_index"),
        F.min_by("command", filled("command")).alias("command"),
        F.max_by("output_hash", filled("output_hash")).alias("output_hash"),
        F.max_by("exit_code", F.when(F.col("exit_code").isNotNull(), F.col("event_index"))).alias("exit_code"),
        F.min_by("tool_name", filled("tool_name")).alias("tool_name"),
        F.max_by("lifecycle_status", filled("lifecycle_status")).alias("lifecycle_status"),
        F.count("*").alias("n_events"),
    )
    return ordered.numbered(merged.drop("g"), ["trajectory_id"], "event_index", "call_index")


# ---- as-of, range and context joins ---------------------------------------------------------
@query("""SELECT l.user_id, l.event_id, r.event_id AS mark_id, r.value AS mark_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON l.user_id = r.user_id AND l.event_id >= r.event_id""")
def asof_provenance(s, d):
    e = _events(s, d)
    marks = e.where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("mark_id"), F.col("value").alias("mark_value"))
    return ordered.asof_backward(e.where("event_type = 'purchase'").select("user_id", "event_id"), marks, ["user_id"], "event_id", ["mark_id", "mark_value"])


_SRC = "coalesce(nullif(file_content, ''), nullif(command, ''))"
_MARKS = f"""{_EV}, src AS (SELECT trajectory_id, event_index, {_SRC} AS source FROM e WHERE {_SRC} IS NOT NULL),
mark AS (SELECT trajectory_id, event_index, lower(regexp_replace(f, '^.*/', '')) AS file, {labels.provenance_mark_sql('source')} AS kind FROM (SELECT *, unnest({labels.data_files_sql('source')}) AS f FROM src) WHERE {labels.provenance_mark_sql('source')} IS NOT NULL)"""


def _sources(s, d):
    """Written files and commands as read; what is taken from them is made distinct, so texts are not shuffled."""
    e = table(s, d, "agent_event").select("trajectory_id", "event_index", "file_content", "command")
    source = F.coalesce(F.when(F.col("file_content") != "", F.col("file_content")), F.when(F.col("command") != "", F.col("command")))
    return e.select("trajectory_id", "event_index", source.alias("source")).where("source is not null")


def _base(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _provenance(s, d):
    own = _sources(s, d).withColumn("kind", labels.provenance_mark(F.col("source"))).where("kind is not null")
    return own.select("trajectory_id", "event_index", "kind", F.explode(labels.data_files(F.col("source"))).alias("f")).select("trajectory_id", "event_index", _base(F.col("f")).alias("file"), "kind").distinct()


@query(f"WITH {_MARKS} SELECT DISTINCT trajectory_id, event_index, file, kind FROM mark")
def provenance_marks(s, d):
    return _provenance(s, d)


@query(f"""WITH {_MARKS}, n AS (SELECT trajectory_id, event_index, lower(regexp_replace(f, '^.*/', '')) AS file FROM (SELECT *, unnest({labels.data_files_sql('source')}) AS f FROM src)),
use AS (SELECT DISTINCT * FROM n), m AS (SELECT trajectory_id, event_index, file, max(kind) AS kind FROM mark GROUP BY ALL)
SELECT u.trajectory_id, u.event_index, u.file, m.kind FROM use u ASOF LEFT JOIN m ON u.trajectory_id = m.trajectory_id AND u.file = m.file AND u.event_index >= m.event_index""")
def asof_file_provenance(s, d):
    use = _sources(s, d).select("trajectory_id", "event_index", F.explode(labels.data_files(F.col("source"))).alias("f")).select("trajectory_id", "event_index", _base(F.col("f")).alias("file")).distinct()
    return ordered.asof_backward(use, _provenance(s, d), ["trajectory_id", "file"], "event_index", ["kind"])


@query("""WITH l AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase'), x AS (SELECT e.user_id, e.event_id, e.event_type, min(l.event_id) AS launch FROM events e LEFT JOIN l ON e.user_id = l.user_id AND l.event_id >= e.event_id GROUP BY ALL)
SELECT user_id, launch, count(*) AS n_events, count_if(event_type = 'view') AS n_views, min(event_id) AS first_event FROM x WHERE launch IS NOT NULL GROUP BY 1, 2""")
def window_assign_range(s, d):
    e = ordered.next_boundary(_events(s, d), ["user_id"], "event_id", F.col("event_type") == "purchase", "launch")
    return e.where("launch is not null").groupBy("user_id", "launch").agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "view").alias("n_views"), F.min("event_id").alias("first_event"))


@query(f"""WITH {_EV}, w AS (SELECT trajectory_id, event_index, file_content AS t, row_number() OVER (PARTITION BY trajectory_id ORDER BY event_index DESC) AS r FROM e WHERE file_content <> '')
SELECT trajectory_id, md5(right(string_agg(t, chr(10) ORDER BY event_index), 400000)) AS context_hash, length(right(string_agg(t, chr(10) ORDER BY event_index), 400000)) AS n_chars FROM w WHERE r <= 8 GROUP BY 1""")
def last_k_context(s, d):
    e = rows(s, d, "agent_event", "trajectory_id", "event_index", "file_content").where("file_content <> ''")
    ctx = ordered.last_k_text(e, ["trajectory_id"], "event_index", "file_content", 8, 400_000, "context")
    return ctx.select("trajectory_id", F.md5("context").alias("context_hash"), F.length("context").alias("n_chars"))


#: Words of a plan (fixed value).
_PLANS = r"(?:plan|approach|strategy|we will|i will|try|train|fine[- ]?tun|experiment|iteration|switch|instead|next)"
_PROPOSED = f"""{_EV}, pr AS (SELECT trajectory_id, event_index, {labels.strategy_family_sql("command", "text", "split_part(" + labels.action_sql('command') + ", '/', 1)")} AS family FROM e
  WHERE event_type IN ('assistant_text', 'reasoning') AND regexp_matches(lower(coalesce(text, '') || ' ' || coalesce(command, '')), {literal(_PLANS)}) AND length(coalesce(text, '') || ' ' || coalesce(command, '')) >= 30),
proposal AS (SELECT * FROM pr WHERE family NOT IN ('other_unknown', 'no_parameter_update'))"""


def _proposals(s, d):
    """Statements of intent that name a family: assistant text or reasoning, never commands or results."""
    e = table(s, d, "agent_event").select("trajectory_id", "event_index", "event_type", "text", "command").where(F.col("event_type").isin("assistant_text", "reasoning"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("command", F.lit("")))
    own = e.where(F.lower(said).rlike(_PLANS) & (F.length(said) >= 30))
    category = F.split(labels.action(F.col("command")), "/")[0]
    family = labels.strategy_family(F.col("command"), F.col("text"), category)
    return own.select("trajectory_id", "event_index", family.alias("family")).where(~F.col("family").isin("other_unknown", "no_parameter_update"))


@query(f"""WITH {_PROPOSED}, {_CALLS}, l AS (SELECT trajectory_id, call_index, event_index, {_FAMILY} AS family FROM c WHERE action_category IN {_IN})
SELECT l.trajectory_id, l.call_index, l.family, p.event_index AS proposed_at FROM l ASOF LEFT JOIN proposal p ON l.trajectory_id = p.trajectory_id AND l.family = p.family AND l.event_index >= p.event_index""")
def asof_proposal_by_family(s, d):
    own = _calls(s, d).where(F.col("action_category").isin(MEANINGFUL))
    own = own.select("trajectory_id", "call_index", "event_index", labels.strategy_family(F.col("command"), F.lit(None).cast("string"), F.col("action_category")).alias("family"))
    marks = _proposals(s, d).withColumn("proposed_at", F.col("event_index"))
    return ordered.asof_backward(own, marks, ["trajectory_id", "family"], "event_index", ["proposed_at"]).drop("event_index")


@query(f"""WITH {_EV}, x AS (SELECT trajectory_id, coalesce(bool_or(event_type = 'result' AND lifecycle_status = 'completed'), false) AS terminal, coalesce(bool_or(event_type = 'error' OR (event_type = 'result' AND lifecycle_status = 'error')), false) AS failed, count(*) AS n_events FROM e GROUP BY 1)
SELECT trajectory_id, n_events, terminal, failed, CASE WHEN terminal THEN 'complete' ELSE 'partial' END AS behavior, CASE WHEN failed AND NOT terminal THEN 'failed' WHEN terminal THEN 'complete' ELSE 'incomplete' END AS status FROM x""")
def run_completeness(s, d):
    e = rows(s, d, "agent_event", "trajectory_id", "event_index", "event_type", "lifecycle_status")
    result = F.col("event_type") == "result"
    x = e.groupBy("trajectory_id").agg(
        F.coalesce(F.bool_or(result & (F.col("lifecycle_status") == "completed")), F.lit(False)).alias("terminal"), F.coalesce(F.bool_or((F.col("event_type") == "error") | (result & (F.col("lifecycle_status") == "error"))), F.lit(False)).alias("failed"), F.count("*").alias("n_events")
    )
    return x.withColumn("behavior", F.when(F.col("terminal"), "complete").otherwise("partial")).withColumn("status", F.when(F.col("failed") & ~F.col("terminal"), "failed").when(F.col("terminal"), "complete").otherwise("incomplete"))


# ---- labels --------------------------------------------------------------------------------
@query(f"WITH {_CALLS} SELECT trajectory_id, call_index, split_part({labels.action_sql('command')}, '/', 1) AS category, split_part({labels.action_sql('command')}, '/', 2) AS confidence FROM c")
def action_categories(s, d):
    a = F.split(labels.action(F.col("command")), "/")
    return _calls(s, d).select("trajectory_id", "call_index", a[0].alias("category"), a[1].alias("confidence"))


@query(f"WITH {_CALLS} SELECT trajectory_id, call_index, {_FAMILY} AS family, CASE {_FAMILY} WHEN 'peft_sft' THEN 'peft' WHEN 'full_sft' THEN 'parameter_update' WHEN 'rl' THEN 'parameter_update' WHEN 'preference' THEN 'parameter_update' WHEN 'distillation' THEN 'parameter_update' ELSE 'none' END AS update_mechanism FROM c")
def strategy_families(s, d):
    f = labels.strategy_family(F.col("command"), F.lit(None).cast("string"), F.col("action_category"))
    own = _calls(s, d).select("trajectory_id", "call_index", f.alias("family"))
    return own.withColumn("update_mechanism", F.when(F.col("family") == "peft_sft", "peft").when(F.col("family").isin(labels.UPDATING_FAMILIES), "parameter_update").otherwise("none"))


@query(f"WITH {_CALLS} SELECT trajectory_id, call_index, {labels.v1_command_sql('command')} FROM c")
def first_stage_commands(s, d):
    v = labels.v1_command(F.coalesce("command", F.lit("")), F.lit(None).cast("string"))
    return _calls(s, d).select("trajectory_id", "call_index", v.alias("v")).select("trajectory_id", "call_index", "v.*")


@query(f"WITH {_CALLS} SELECT trajectory_id, call_index, {labels.launched_scripts_sql('command')} AS scripts, {labels.name_signature_sql('command')} AS signature FROM c WHERE command IS NOT NULL")
def script_basenames(s, d):
    c = _calls(s, d).where("command is not null")
    return c.select("trajectory_id", "call_index", labels.launched_scripts(F.col("command")).alias("scripts"), labels.objective(F.col("command"), F.lit(None).cast("string"))["signature"].alias("signature"))


@query(f"WITH {_EV}, src AS (SELECT trajectory_id, event_index, {_SRC} AS source FROM e WHERE {_SRC} IS NOT NULL) SELECT trajectory_id, event_index, {labels.data_files_sql('source')} AS files, {labels.init_source_sql('source')} AS init_source FROM src")
def data_files_and_init(s, d):
    return _sources(s, d).select("trajectory_id", "event_index", labels.data_files(F.col("source")).alias("files"), labels.init_source(F.col("source")).alias("init_source")).distinct()


_JUDGED = ", ".join(f"{labels.judgement_v1_sql('text', k)} AS v1_{k}" for k in ("contamination", "disallowed"))


@query(f"SELECT doc_id, {labels.judgement_v3_sql('text')} AS v3, {_JUDGED} FROM documents")
def judgement_status(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", labels.judgement_v3(t).alias("v3"), *[labels.judgement_v1(t, k).alias(f"v1_{k}") for k in ("contamination", "disallowed")])


def _names_sql() -> str:
    f = labels._first_word_sql
    own = lambda ws: {w: w for w in ws}
    raw = "split_part(raw_task_name, '_', 1)"
    known = "CASE " + " ".join(f"WHEN lower({raw}) = {literal(k)} THEN {literal(v)}" for k, v in labels.BENCHMARKS.items()) + " END"
    model = f("replace(lower(raw_task_name), ' ', '')", labels.BASE_MODELS)
    return f"""SELECT DISTINCT trajectory_id, coalesce({known}, nullif({raw}, '')) AS benchmark, {model} AS base_model, nullif(regexp_extract(raw_task_name, '(?:^|_)(\\d{{5,}})(?:$|_)', 1), '') AS run_replicate,
      {f('lower(batch_id)', labels.FAMILY_WORDS, "'unknown'")} AS family, {f('lower(batch_id)', own(labels.AGENT_WORDS))} AS agent_model, {f('lower(batch_id)', own(labels.MODE_WORDS))} AS mode,
      TRY_CAST(nullif(regexp_extract(lower(batch_id), '(?:^|_)(\\d+)h(?:_|$)', 1), '') AS INTEGER) AS budget_hours, {f('lower(batch_id)', labels.HARNESSES, "'Unknown'", True)} AS harness,
      coalesce(nullif(regexp_extract(lower(batch_id), '(?:^|_)(run\\d+)(?:_|$)', 1), ''), CASE WHEN contains(lower(batch_id), 'reprompt') THEN 'reprompt' ELSE 'single' END) AS run_label FROM run_inventory"""


@query(_names_sql())
def name_parse(s, d):
    i = rows(s, d, "run_inventory", "trajectory_id", "raw_task_name", "batch_id")
    i = i.withColumn("t", labels.task_name(F.col("raw_task_name"))).withColumn("b", labels.batch_name(F.col("batch_id")))
    return i.select("trajectory_id", "t.benchmark", "t.base_model", "t.run_replicate", "b.family", "b.agent_model", "b.mode", "b.budget_hours", labels.harness(F.col("batch_id")).alias("harness"), labels.run_label(F.col("batch_id")).alias("run_label")).distinct()


@query(r"""WITH i AS (SELECT DISTINCT trajectory_id, total_duration AS t FROM run_inventory), n AS (SELECT *, list_transform(regexp_extract_all(t, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS ns FROM i)
SELECT trajectory_id, CASE WHEN contains(t, ':') AND len(ns) >= 3 THEN ns[-3] * 3600 + ns[-2] * 60 + ns[-1] WHEN contains(t, ':') AND len(ns) = 2 THEN ns[-2] * 60 + ns[-1] ELSE ns[-1] END AS seconds FROM n""")
def durations(s, d):
    return rows(s, d, "run_inventory", "trajectory_id", "total_duration").select("trajectory_id", text.duration_seconds(F.col("total_duration")).alias("seconds"))


# ---- metrics ---------------------------------------------------------------------------------
_V, _S = literal(metrics.NAMED_VALUE), literal(metrics.NAMED_SHARE)
_POINTS = f"""{_EV}, v AS (SELECT trajectory_id, event_index, unnest(regexp_extract_all(command_output, {_V})) AS x FROM e WHERE command_output IS NOT NULL),
sh AS (SELECT trajectory_id, event_index, unnest(regexp_extract_all(command_output, {_S})) AS x FROM e WHERE command_output IS NOT NULL),
pt AS (SELECT trajectory_id, event_index, regexp_extract(x, {_V}, 1) AS metric_name, CASE WHEN x LIKE '%\\%' ESCAPE '\\' THEN regexp_extract(x, {_V}, 2)::DOUBLE / 100 WHEN regexp_extract(x, {_V}, 2)::DOUBLE <= 1 THEN regexp_extract(x, {_V}, 2)::DOUBLE END AS metric_value FROM v
  UNION ALL SELECT trajectory_id, event_index, regexp_extract(x, {_S}, 1), CASE WHEN regexp_extract(x, {_S}, 3)::DOUBLE > 0 AND regexp_extract(x, {_S}, 2)::DOUBLE <= regexp_extract(x, {_S}, 3)::DOUBLE THEN regexp_extract(x, {_S}, 2)::DOUBLE / regexp_extract(x, {_S}, 3)::DOUBLE END FROM sh),
points AS (SELECT * FROM pt WHERE metric_value IS NOT NULL)"""


def _points(s, d):
    found = table(s, d, "agent_event").where("command_output is not null").select("trajectory_id", "event_index", metrics.metric_points(F.col("command_output")).alias("ps"))
    each = found.where(F.size("ps") > 0).distinct().select("trajectory_id", "event_index", F.explode("ps").alias("p"))
    return each.select("trajectory_id", "event_index", "p.metric_name", "p.metric_value")


@query(f"WITH {_POINTS} SELECT * FROM points")
def metric_regex_extract(s, d):
    return _points(s, d)


@query(f"""WITH {_POINTS}, fl AS (SELECT trajectory_id, arg_min(metric_value, (event_index, metric_name, metric_value)) AS first, arg_max(metric_value, (event_index, metric_name, metric_value)) AS last, count(*) AS n, max(metric_value) AS best FROM points GROUP BY 1)
SELECT trajectory_id, n AS n_points, first AS first_metric, last AS last_metric, best AS best_metric, CASE WHEN n < 2 THEN 'unknown' WHEN last > first + 1e-9 THEN 'positive' WHEN last < first - 1e-9 THEN 'regression' ELSE 'plateau' END AS evidence FROM fl""")
def evidence_direction(s, d):
    at = F.struct("event_index", "metric_name", "metric_value")
    fl = _points(s, d).groupBy("trajectory_id").agg(F.count("*").alias("n_points"), F.min_by("metric_value", at).alias("first_metric"), F.max_by("metric_value", at).alias("last_metric"), F.max("metric_value").alias("best_metric"))
    a, b = F.col("first_metric"), F.col("last_metric")
    return fl.withColumn("evidence", F.when(F.col("n_points") < 2, "unknown").when(b > a + 1e-9, "positive").when(b < a - 1e-9, "regression").otherwise("plateau"))


@query(f"""WITH {_POINTS}, k AS (SELECT trajectory_id, metric_name, metric_value, min(event_index) AS event_index FROM points GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY event_index, metric_name, metric_value) - 1 AS BIGINT) AS point_index FROM k""")
def evaluation_points_keep_first(s, d):
    first = ordered.keep_first(_points(s, d), ["trajectory_id", "metric_name", "metric_value"], ["event_index"])
    # points of one event are few; events are numbered in blocks by how many points came before
    one = first.groupBy("trajectory_id", "event_index").agg(F.array_sort(F.collect_list(F.struct("metric_name", "metric_value"))).alias("ps"))
    upto = ordered.running_sum(one, ["trajectory_id"], "event_index", {"upto": F.size("ps")})
    each = upto.select("trajectory_id", "event_index", (F.col("upto") - F.size("ps")).alias("before"), F.posexplode("ps").alias("k", "p"))
    return each.select("trajectory_id", "p.metric_name", "p.metric_value", "event_index", (F.col("before") + F.col("k")).alias("point_index"))


@query("""WITH r AS (SELECT DISTINCT log_stream, file_seq, line_no, record::JSON AS j FROM eval_log_raw), k AS (SELECT log_stream, file_seq, line_no, '' AS p, unnest(json_keys(j)) AS key, j FROM r WHERE json_type(j) = 'OBJECT'),
a AS (SELECT log_stream, file_seq, line_no, key AS name, json_extract(j, '$."' || key || '"') AS v FROM k), b AS (SELECT log_stream, file_seq, line_no, name, unnest(json_keys(v)) AS key, v FROM a WHERE json_type(v) = 'OBJECT'),
c AS (SELECT log_stream, file_seq, line_no, name || '.' || key AS name, json_extract(v, '$."' || key || '"') AS v FROM b), f AS (SELECT log_stream, file_seq, line_no, name, unnest(json_keys(v)) AS key, v FROM c WHERE json_type(v) = 'OBJECT'),
g AS (SELECT log_stream, file_seq, line_no, name || '.' || key AS name, json_extract(v, '$."' || key || '"') AS v FROM f)
SELECT log_stream, file_seq, line_no, name, v::VARCHAR::DOUBLE AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT * FROM g) WHERE json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE')""")
def json_flatten_numeric(s, d):
    return metrics.json_leaves(rows(s, d, "eval_log_raw", "log_stream", "file_seq", "line_no", "record"), "record").drop("record")


# ---- aggregates and tables ---------------------------------------------------------------------
_INV = "inv AS (SELECT DISTINCT trajectory_id, batch_id, scaffold_family, agent_model, budget_hours, benchmark, base_model, metrics_path, workspace_status, duplicate_content_hash FROM run_inventory)"


def _inventory(s, d):
    return rows(s, d, "run_inventory", "trajectory_id", "batch_id", "scaffold_family", "agent_model", "budget_hours", "benchmark", "base_model", "metrics_path", "workspace_status", "duplicate_content_hash")


_FIRST = f"{_CALLS}, {_INV}, first AS (SELECT trajectory_id, arg_min(action_category, call_index) AS initial FROM c WHERE action_category IN {_IN} GROUP BY 1), g AS (SELECT scaffold_family, benchmark, initial, count(*) AS n FROM first JOIN inv USING (trajectory_id) GROUP BY ALL)"


def _initial(s, d):
    first = _calls(s, d).where(F.col("action_category").isin(MEANINGFUL)).groupBy("trajectory_id").agg(F.min_by("action_category", "call_index").alias("initial"))
    return first.join(_inventory(s, d), "trajectory_id")


@query(f"""WITH {_FIRST}, t AS (SELECT scaffold_family, benchmark, sum(n) AS total, count(*) AS kinds, max(n) AS top FROM g GROUP BY 1, 2)
SELECT g.scaffold_family, g.benchmark, CAST(total AS BIGINT) AS n, kinds AS n_kinds, top / total AS top_share, round(0 - sum(g.n / total * ln(g.n / total)), 9) AS entropy, round((0 - sum(g.n / total * ln(g.n / total))) / ln(greatest(2, kinds)), 9) AS normalized_entropy
FROM g JOIN t ON g.scaffold_family = t.scaffold_family AND g.benchmark IS NOT DISTINCT FROM t.benchmark GROUP BY g.scaffold_family, g.benchmark, total, kinds, top""")
def initial_action_entropy(s, d):
    counts = _initial(s, d).groupBy("scaffold_family", "benchmark", "initial").agg(F.count("*").alias("n"))
    by = counts.groupBy("scaffold_family", "benchmark").agg(F.sum("n").alias("total"), F.count("*").alias("n_kinds"), F.max("n").alias("top"), F.collect_list("n").alias("ns"))  # one number a kind
    h = F.aggregate("ns", F.lit(0.0), lambda acc, n: acc - n / F.col("total") * F.log(n / F.col("total")))
    return by.select("scaffold_family", "benchmark", F.col("total").alias("n"), "n_kinds", (F.col("top") / F.col("total")).alias("top_share"), ninth(h).alias("entropy"), ninth(h / F.log(F.greatest(F.lit(2), F.col("n_kinds")))).alias("normalized_entropy"))


_ORDER = "['training', 'evaluation', 'checkpoint', 'debugging', 'data_preparation']"


@query(f"WITH {_FIRST} SELECT scaffold_family, benchmark, arg_max(initial, (n, -list_position({_ORDER}, initial))) AS dominant, max(n) AS dominant_n FROM g GROUP BY 1, 2")
def initial_action_dominant(s, d):
    return ordered.dominant(_initial(s, d), ["scaffold_family", "benchmark"], "initial", MEANINGFUL)


@query(f"""WITH {_POINTS}, {_CALLS}, {_INV}, f AS (SELECT trajectory_id, arg_min(action_category, call_index) AS initial FROM c WHERE action_category IN {_IN} GROUP BY 1),
l AS (SELECT trajectory_id, arg_max(metric_value, (event_index, metric_name, metric_value)) AS final_metric FROM points GROUP BY 1), j AS (SELECT inv.benchmark, f.initial, final_metric FROM f JOIN inv USING (trajectory_id) JOIN l USING (trajectory_id)),
b AS (SELECT benchmark, avg(final_metric) AS bm FROM j GROUP BY 1) SELECT j.benchmark, j.initial, count(*) AS n, round(avg(final_metric), 9) AS mean_metric, round(avg(final_metric) - any_value(bm), 9) AS centered_mean FROM j JOIN b ON j.benchmark IS NOT DISTINCT FROM b.benchmark GROUP BY 1, 2""")
def outcome_by_action(s, d):
    at = F.struct("event_index", "metric_name", "metric_value")
    final = _points(s, d).groupBy("trajectory_id").agg(F.max_by("metric_value", at).alias("m"))
    j = _initial(s, d).join(final, "trajectory_id")
    # group sums first, then the benchmark's mean over the few groups
    g = j.groupBy("benchmark", "initial").agg(F.count("*").alias("n"), F.sum("m").alias("t"))
    b = Window.partitionBy("benchmark")
    return g.select("benchmark", "initial", "n", ninth(F.col("t") / F.col("n")).alias("mean_metric"), ninth(F.col("t") / F.col("n") - F.sum("t").over(b) / F.sum("n").over(b)).alias("centered_mean"))


@query(f"""WITH {_CALLS}, {_INV}, j AS (SELECT coalesce(scaffold_family, 'Unknown') AS scaffold_family, coalesce(benchmark, 'Unknown') AS benchmark, coalesce(base_model, 'Unknown') AS base_model, trajectory_id, training_launched, evaluation_launched FROM c JOIN inv USING (trajectory_id))
SELECT scaffold_family, benchmark, base_model, count(*) AS calls, count_if(training_launched) AS trainings, count_if(evaluation_launched) AS evaluations, count_if(training_launched) / greatest(1, count(*)) AS training_rate FROM j GROUP BY GROUPING SETS ((scaffold_family), (benchmark), (base_model))""")
def group_summary_sets(s, d):
    # one row a trajectory before the join: the inventory is joined to counts, not to calls
    per = _calls(s, d).groupBy("trajectory_id").agg(F.count("*").alias("calls"), F.count_if("training_launched").alias("trainings"), F.count_if("evaluation_launched").alias("evaluations"))
    j = per.join(_inventory(s, d), "trajectory_id").select(*[F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("scaffold_family", "benchmark", "base_model")], "calls", "trainings", "evaluations")
    cols = ["scaffold_family", "benchmark", "base_model"]
    sets = j.groupingSets([["scaffold_family"], ["benchmark"], ["base_model"]], *cols).agg(F.sum("calls").alias("calls"), F.sum("trainings").alias("trainings"), F.sum("evaluations").alias("evaluations"))
    return sets.withColumn("training_rate", F.col("trainings") / F.greatest(F.lit(1), F.col("calls")))


@query(f"""WITH {_INV}, cells AS (SELECT b.benchmark, m.base_model, f.scaffold_family FROM (SELECT DISTINCT benchmark FROM inv WHERE benchmark IS NOT NULL) b, (SELECT DISTINCT base_model FROM inv WHERE base_model IS NOT NULL) m, (SELECT DISTINCT scaffold_family FROM inv WHERE scaffold_family IS NOT NULL) f),
n AS (SELECT benchmark, base_model, scaffold_family, count(*) AS runs, count_if(metrics_path IS NOT NULL) AS with_metrics FROM inv GROUP BY ALL)
SELECT cells.*, coalesce(runs, 0) AS runs, coalesce(with_metrics, 0) AS with_metrics FROM cells LEFT JOIN n USING (benchmark, base_model, scaffold_family)""")
def cell_coverage_zero_fill(s, d):
    counts = _inventory(s, d).groupBy("benchmark", "base_model", "scaffold_family").agg(F.count("*").alias("runs"), F.count_if(F.col("metrics_path").isNotNull()).alias("with_metrics"))
    # dimensions are sets of names, gathered as one row each: the cells come from exploding, not from a join of rows
    sets = counts.agg(*[F.array_compact(F.collect_set(c)).alias(c) for c in ("benchmark", "base_model", "scaffold_family")])
    cells = sets.select(F.explode("benchmark").alias("benchmark"), "base_model", "scaffold_family").select("benchmark", F.explode("base_model").alias("base_model"), "scaffold_family").select("benchmark", "base_model", F.explode("scaffold_family").alias("scaffold_family"))
    return cells.join(counts, ["benchmark", "base_model", "scaffold_family"], "left").fillna(0, ["runs", "with_metrics"])


@query(f"""WITH {_INV}, k AS (SELECT coalesce(benchmark, 'unknown') AS benchmark, scaffold_family FROM inv) SELECT benchmark, count_if(scaffold_family = 'claude') AS claude, count_if(scaffold_family = 'codex') AS codex, count_if(scaffold_family = 'other') AS other, count(*) AS total FROM k GROUP BY 1""")
def label_matrix_pivot(s, d):
    i = _inventory(s, d).select(F.coalesce("benchmark", F.lit("unknown")).alias("benchmark"), "scaffold_family")
    names = ["claude", "codex", "other"]
    wide = i.groupBy("benchmark").pivot("scaffold_family", names).count().fillna(0, names)
    return wide.join(i.groupBy("benchmark").agg(F.count("*").alias("total")), "benchmark")


_PER = f"""{_EPISODES}, {_INV}, t AS (SELECT *, lag(family) OVER (PARTITION BY trajectory_id ORDER BY episode_index) AS b FROM ep),
per AS (SELECT trajectory_id, count_if(list_contains(action_categories, 'training')) AS experiments, count_if(b IS NOT NULL AND b <> 'other_unknown' AND family <> 'other_unknown') AS pairs, count_if(b <> family AND b <> 'other_unknown' AND family <> 'other_unknown') AS switches,
  arg_min(family, episode_index) FILTER (family IN ('full_sft', 'peft_sft', 'rl', 'preference', 'distillation')) AS initial FROM t GROUP BY 1)"""


def _per_trajectory(s, d):
    ep = _episode_rows(s, d)
    lag = ordered.blocked_lag(ep, ["trajectory_id"], "episode_index", F.struct("family"), "b")
    known = F.coalesce((F.col("b.family") != "other_unknown") & (F.col("family") != "other_unknown"), F.lit(False))
    updating = F.col("family").isin(labels.UPDATING_FAMILIES)
    return lag.groupBy("trajectory_id").agg(
        F.count_if(F.array_contains("action_categories", "training")).alias("experiments"), F.count_if(known).alias("pairs"), F.count_if(known & (F.col("b.family") != F.col("family"))).alias("switches"),
        F.min_by("family", F.when(updating, F.col("episode_index"))).alias("initial"),
    )


@query(f"""WITH {_PER} SELECT scaffold_family, benchmark, count(*) AS runs, count(*) FILTER (experiments > 0) AS trained, count(*) FILTER (experiments > 0 AND initial IS NOT NULL) AS identified, count(*) FILTER (experiments > 0 AND initial IS NOT NULL) / nullif(count(*) FILTER (experiments > 0), 0) AS coverage,
  CAST(coalesce(sum(experiments), 0) AS BIGINT) AS commands, CAST(coalesce(sum(switches) FILTER (experiments > 0), 0) AS BIGINT) AS switches, CAST(coalesce(sum(pairs) FILTER (experiments > 0), 0) AS BIGINT) AS pairs, coalesce(sum(switches) FILTER (experiments > 0), 0) / nullif(coalesce(sum(pairs) FILTER (experiments > 0), 0), 0) AS switch_rate,
  CASE WHEN count(DISTINCT budget_hours) = 1 THEN min(budget_hours)::VARCHAR ELSE 'mixed' END AS budget, count(DISTINCT base_model) AS base_models FROM inv LEFT JOIN per USING (trajectory_id) GROUP BY 1, 2""")
def scaffold_summary(s, d):
    j = _inventory(s, d).join(_per_trajectory(s, d), "trajectory_id", "left")
    trained = F.col("experiments") > 0
    out = j.groupBy("scaffold_family", "benchmark").agg(
        F.count("*").alias("runs"), F.count_if(trained).alias("trained"), F.count_if(trained & F.col("initial").isNotNull()).alias("identified"),
        F.coalesce(F.sum("experiments"), F.lit(0)).alias("commands"), F.coalesce(F.sum(F.when(trained, F.col("switches"))), F.lit(0)).alias("switches"), F.coalesce(F.sum(F.when(trained, F.col("pairs"))), F.lit(0)).alias("pairs"),
        F.when(F.count_distinct("budget_hours") == 1, F.min("budget_hours").cast("string")).otherwise("mixed").alias("budget"), F.count_distinct("base_model").alias("base_models"),
    )
    return out.withColumn("coverage", F.try_divide("identified", "trained")).withColumn("switch_rate", F.try_divide("switches", "pairs"))


_SHARE = "count_if(scaffold_family = '{s}' AND category = '{m}') / nullif(count_if(scaffold_family = '{s}'), 0)"
_SH = {f"{s}_{m}": _SHARE.format(s=s, m=m) for s in ("claude", "codex") for m in ("training", "evaluation")}


@query(f"""WITH {_CALLS}, {_INV}, j AS (SELECT benchmark, base_model, scaffold_family, action_category AS category FROM c JOIN inv USING (trajectory_id) WHERE action_category IN {_IN})
SELECT benchmark, base_model, {', '.join(f'{v} AS {k}' for k, v in _SH.items())}, coalesce({_SH['claude_training']} > {_SH['codex_training']}, false) AS claude_more_training, {_SH['claude_training']} - {_SH['codex_training']} AS training_gap FROM j GROUP BY 1, 2""")
def cell_consistency(s, d):
    per = _calls(s, d).where(F.col("action_category").isin(MEANINGFUL)).groupBy("trajectory_id", "action_category").agg(F.count("*").alias("n"))
    j = per.join(_inventory(s, d), "trajectory_id")
    is_ = lambda f: F.col("scaffold_family") == f
    total = lambda f: F.sum(F.when(is_(f), F.col("n")).otherwise(0))
    some = lambda f, m: F.sum(F.when(is_(f) & (F.col("action_category") == m), F.col("n")).otherwise(0))
    shares = [F.try_divide(some(f, m), total(f)).alias(f"{f}_{m}") for f in ("claude", "codex") for m in ("training", "evaluation")]
    out = j.groupBy("benchmark", "base_model").agg(*shares)
    a, b = F.col("claude_training"), F.col("codex_training")
    return out.withColumn("claude_more_training", F.coalesce(a > b, F.lit(False))).withColumn("training_gap", a - b)


@query(f"""WITH {_PAIRS}, x AS (SELECT user_id, count(*) AS pairs, count_if(before <> event_type) AS changes FROM p GROUP BY 1)
SELECT user_id % 5 AS harness, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(changes) AS BIGINT) AS changes, count(*) AS trajectories, count_if(changes > 0) AS changed_trajectories, sum(changes) / sum(pairs) AS rate FROM x GROUP BY ROLLUP (user_id % 5)""")
def event_change_rollup(s, d):
    # one row a trajectory first, so distinct trajectories are rows
    x = _pairs(s, d).groupBy("user_id").agg(F.count("*").alias("pairs"), F.count_if("changed").alias("changes"))
    out = x.rollup((F.col("user_id") % 5).alias("harness")).agg(F.sum("pairs").alias("pairs"), F.sum("changes").alias("changes"), F.count("*").alias("trajectories"), F.count_if(F.col("changes") > 0).alias("changed_trajectories"))
    return out.withColumn("rate", F.try_divide("changes", "pairs"))


@query("SELECT source, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS stated_chars, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, CAST(sum(coalesce(n_chars, 0) + coalesce(length(text), 0)) AS BIGINT) AS total, count(*) AS n FROM documents GROUP BY 1")
def token_totals(s, d):
    t = table(s, d, "documents").groupBy("source").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("stated_chars"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"), F.count("*").alias("n"))
    return t.withColumn("total", F.col("stated_chars") + F.col("chars"))


_RES = f"{_CALLS}, {_INV}, res AS (SELECT trajectory_id, list(exit_code = 0 ORDER BY call_index) AS per_sample FROM c WHERE exit_code IS NOT NULL AND evaluation_launched GROUP BY 1)"


def _results(s, d):
    """Per run, how many evaluation calls there were and how many ended well."""
    e = _calls(s, d).where("exit_code is not null and evaluation_launched")
    return e.groupBy("trajectory_id").agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") == 0).alias("ok"))


@query(f"WITH {_RES} SELECT trajectory_id, len(list_filter(per_sample, lambda x: x)) > 0 AS any_correct, len(list_filter(per_sample, lambda x: x)) AS n_correct, len(list_filter(per_sample, lambda x: x)) / len(per_sample) AS sample_accuracy FROM res")
def pass_at_k(s, d):
    return _results(s, d).select("trajectory_id", (F.col("ok") > 0).alias("any_correct"), F.col("ok").alias("n_correct"), (F.col("ok") / F.col("n")).alias("sample_accuracy"))


@query(f"""WITH {_RES}, j AS (SELECT coalesce(scaffold_family, 'unknown') AS scaffold_family, unnest(per_sample) AS ok FROM res JOIN inv USING (trajectory_id))
SELECT scaffold_family, count(*) AS n, count_if(ok) AS n_correct, count_if(ok) / count(*) AS accuracy, CASE WHEN count(*) > 1 THEN round(sqrt((count_if(ok) / count(*)) * (1 - count_if(ok) / count(*)) / (count(*) - 1)), 9) END AS standard_error FROM j GROUP BY ROLLUP (scaffold_family)""")
def accuracy_rollup(s, d):
    j = _results(s, d).join(_inventory(s, d).select("trajectory_id", F.coalesce("scaffold_family", F.lit("unknown")).alias("scaffold_family")), "trajectory_id")
    out = j.rollup("scaffold_family").agg(F.sum("n").alias("n"), F.sum("ok").alias("n_correct"))
    p = F.col("n_correct") / F.col("n")
    return out.withColumn("accuracy", p).withColumn("standard_error", F.when(F.col("n") > 1, ninth(F.sqrt(p * (1 - p) / (F.col("n") - 1)))))


@query("""WITH x AS (SELECT source, list_sort(list(length(text)::BIGINT)) AS xs FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT source, xs[len(xs) // 10 + 1] AS p10, xs[len(xs) * 5 // 10 + 1] AS p50, xs[len(xs) * 9 // 10 + 1] AS p90 FROM x""")
def index_percentiles(s, d):
    docs = table(s, d, "documents").select("source", F.length("text").cast("bigint").alias("n_chars"))
    return ordered.index_percentiles(docs, ["source"], "n_chars", {"p10": 1, "p50": 5, "p90": 9})


@query(f"WITH {_INV} SELECT trajectory_id, unnest(list_filter(['all_inventory', CASE WHEN metrics_path IS NOT NULL THEN 'outcome' END, CASE WHEN workspace_status = 'present' THEN 'workspace' END, CASE WHEN benchmark IS NOT NULL AND base_model IS NOT NULL THEN 'matched' END], lambda x: x IS NOT NULL)) AS cohort FROM inv")
def cohort_membership(s, d):
    cohorts = F.array_compact(F.array(F.lit("all_inventory"), F.when(F.col("metrics_path").isNotNull(), "outcome"), F.when(F.col("workspace_status") == "present", "workspace"), F.when(F.col("benchmark").isNotNull() & F.col("base_model").isNotNull(), "matched")))
    return _inventory(s, d).select("trajectory_id", F.explode(cohorts).alias("cohort"))


@query(f"WITH {_INV}, m AS ({SQL['cohort_membership'].split('FROM inv)')[0].removeprefix(f'WITH {_INV} ')}) SELECT k.cohort, count(m.cohort) AS n FROM (VALUES ('all_inventory'), ('outcome'), ('workspace'), ('matched'), ('withdrawn')) k(cohort) LEFT JOIN m ON m.cohort = k.cohort GROUP BY 1")
def cohort_counts(s, d):
    names = s.createDataFrame([("all_inventory",), ("outcome",), ("workspace",), ("matched",), ("withdrawn",)], "cohort string")
    counts = cohort_membership(s, d).groupBy("cohort").agg(F.count("*").alias("n"))
    return names.join(counts, "cohort", "left").fillna(0, ["n"])


@query(f"WITH {_INV}, r AS (SELECT trajectory_id, list_sort(list_filter([CASE WHEN metrics_path IS NULL THEN 'missing_metrics' END, CASE WHEN workspace_status = 'missing' THEN 'workspace_missing' END, CASE WHEN benchmark IS NULL THEN 'unrecognized_benchmark' END, CASE WHEN base_model IS NULL THEN 'unrecognized_base_model' END], lambda x: x IS NOT NULL)) AS reasons FROM inv) SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY 1")
def filter_reasons(s, d):
    reasons = F.array_sort(F.array_compact(F.array(F.when(F.col("metrics_path").isNull(), "missing_metrics"), F.when(F.col("workspace_status") == "missing", "workspace_missing"), F.when(F.col("benchmark").isNull(), "unrecognized_benchmark"), F.when(F.col("base_model").isNull(), "unrecognized_base_model"))))
    return _inventory(s, d).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_INV}, h AS (SELECT duplicate_content_hash AS h, count(*) AS group_size FROM inv WHERE duplicate_content_hash <> '' GROUP BY 1 HAVING count(*) > 1) SELECT trajectory_id, duplicate_content_hash, group_size FROM inv JOIN h ON h.h = duplicate_content_hash")
def duplicate_groups(s, d):
    i = _inventory(s, d).where("duplicate_content_hash <> ''").select("trajectory_id", "duplicate_content_hash")
    sizes = i.groupBy("duplicate_content_hash").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return i.join(sizes, "duplicate_content_hash").select("trajectory_id", "duplicate_content_hash", "group_size")


@query(f"WITH {_INV} SELECT * FROM inv WHERE trajectory_id IN (SELECT trajectory_id FROM run_call WHERE training_launched)")
def cohort_semi_join(s, d):
    return _inventory(s, d).join(table(s, d, "run_call").where("training_launched").select("trajectory_id"), "trajectory_id", "left_semi")


@query(f"WITH {_INV} SELECT trajectory_id, batch_id FROM inv WHERE NOT EXISTS (SELECT 1 FROM run_message m WHERE m.trajectory_id = inv.trajectory_id AND m.event_type = 'tool_call')")
def unprocessed_anti_join(s, d):
    done = table(s, d, "run_message").where("event_type = 'tool_call'").select("trajectory_id")
    return _inventory(s, d).select("trajectory_id", "batch_id").join(done, "trajectory_id", "left_anti")


@query("WITH o AS (SELECT DISTINCT benchmark FROM run_inventory WHERE benchmark IS NOT NULL), x AS (SELECT DISTINCT benchmark FROM benchmark_item) SELECT benchmark, 'unexpected' AS problem FROM (SELECT * FROM o EXCEPT SELECT * FROM x) UNION ALL SELECT benchmark, 'absent' FROM (SELECT * FROM x EXCEPT SELECT * FROM o)")
def benchmark_set_guard(s, d):
    o = table(s, d, "run_inventory").where("benchmark is not null").select("benchmark").distinct()
    x = table(s, d, "benchmark_item").select("benchmark").distinct()
    return o.exceptAll(x).withColumn("problem", F.lit("unexpected")).unionByName(x.exceptAll(o).withColumn("problem", F.lit("absent")))


_DEF = r"def\s+(\w+)\s*\("


@query(f"SELECT DISTINCT regexp_extract(text, {literal(_DEF)}, 1) AS name FROM benchmark_item WHERE regexp_matches(text, {literal(_DEF)}) AND regexp_extract(text, {literal(_DEF)}, 1) NOT IN ('main', 'solution', 'solve', 'test', 'check')")
def generic_name_except(s, d):
    names = table(s, d, "benchmark_item").where(F.col("text").rlike(_DEF)).select(F.regexp_extract("text", _DEF, 1).alias("name")).distinct()
    generic = s.createDataFrame([(x,) for x in ("main", "solution", "solve", "test", "check")], "name string")
    return names.exceptAll(generic)


# ---- curation ----------------------------------------------------------------------------------
@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_hash, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def exact_dedup_keep_first(s, d):
    return table(s, d, "documents").where("text is not null").groupBy(F.md5("text").alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT min(doc_id) AS doc_id, left(text, 100) AS prefix, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 2")
def prefix_dedup(s, d):
    return table(s, d, "documents").where("text is not null").groupBy(F.left("text", F.lit(100)).alias("prefix")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(r"""WITH a AS (SELECT doc_id, regexp_extract_all(right(text, 8192), '#### (\-?[0-9\.\,]+)', 1) AS m, regexp_extract_all(text, '\\boxed\{\s*(-?\d+)\s*\}', 1) AS b, regexp_extract_all(text, '(-?\d+)', 1) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, replace(m[-1], ',', '') AS hash_answer, TRY_CAST(b[-1] AS BIGINT) AS boxed, n[-1] AS any_integer FROM a""")
def answer_extract(s, d):
    t = F.col("text")
    return table(s, d, "documents").where("text is not null").select("doc_id", text.hash_answer(t).alias("hash_answer"), text.boxed_integer(t).alias("boxed"), text.any_integer(t).alias("any_integer"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '(?i)<think>[\s\S]*?</think>', '', 'g')) AS text_hash, length(regexp_replace(text, '(?i)<think>[\s\S]*?</think>', '', 'g')) AS n_chars FROM documents WHERE text IS NOT NULL")
def think_strip(s, d):
    own = text.without_thinking(F.col("text"))
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(own).alias("text_hash"), F.length(own).alias("n_chars"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '(?i)<think>[\s\S]*?</think>', '', 'g') AS x FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, replace(regexp_extract_all(right(x, 8192), '#### (\-?[0-9\.\,]+)', 1)[-1], ',', '') AS p FROM t), k AS (SELECT a.*, i.answer FROM a LEFT JOIN benchmark_item i ON i.item_id = 10000 + a.doc_id % 3000)
SELECT doc_id, coalesce(CAST(trim(p) = translate(trim(answer), ',$', '') AS INTEGER), 0) AS acc, coalesce(p, '[NO_ANSWER]') AS pred FROM k""")
def exact_match_score(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text", (F.lit(10000) + F.col("doc_id") % 3000).alias("item_id"))
    items = table(s, d, "benchmark_item").select("item_id", "answer")
    j = docs.join(items, "item_id", "left").withColumn("r", text.exact_score(F.col("text"), F.col("answer")))
    return j.select("doc_id", "r.acc", "r.pred")


@query(None)
def repetition_reward(s, d):
    """Backreferences and LaTeX forms: tested on fixtures."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text", (F.lit(10000) + F.col("doc_id") % 3000).alias("item_id"))
    return docs.join(table(s, d, "benchmark_item").select("item_id", "answer"), "item_id", "left").select("doc_id", text.shaped_reward(F.col("text"), F.col("answer")).alias("reward"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) < 10 THEN 'too_short' WHEN NOT contains(text, 'ANSWER:') THEN 'no_answer' WHEN n_chars > 5000 THEN 'too_long' END AS reason FROM documents WHERE text IS NOT NULL")
def degenerate_reason(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", text.degenerate_reason(F.col("text"), F.col("n_chars")).alias("reason"))


@query("SELECT doc_id, source FROM documents WHERE length(text) BETWEEN 50 AND 3000 AND source IN ('solution_text', 'chat_sample', 'data_script')")
def length_window_filter(s, d):
    return table(s, d, "documents").where(F.length("text").between(50, 3000) & F.col("source").isin("solution_text", "chat_sample", "data_script")).select("doc_id", "source")


@query("""WITH m AS (SELECT DISTINCT trajectory_id, event_index, event_type, CASE WHEN lower(role) IN ('user', 'human') THEN 'user' WHEN lower(role) IN ('assistant', 'gpt', 'model') THEN 'assistant' END AS r, text FROM run_message)
SELECT trajectory_id, arg_min(text, (event_index, text)) FILTER (r = 'user' AND event_type <> 'tool_result') AS first_user, arg_min(text, (event_index, text)) FILTER (r = 'assistant') AS first_assistant FROM m GROUP BY 1""")
def chat_first_pair(s, d):
    m = rows(s, d, "run_message", "trajectory_id", "event_index", "event_type", "role", "text")
    is_ = lambda r: F.lower("role").isin(text.ROLE_ALIASES[r])
    at = F.struct("event_index", "text")
    return m.groupBy("trajectory_id").agg(F.min_by("text", F.when(is_("user") & (F.col("event_type") != "tool_result") & F.col("text").isNotNull(), at)).alias("first_user"), F.min_by("text", F.when(is_("assistant") & F.col("text").isNotNull(), at)).alias("first_assistant"))


_MD5 = "md5(doc_id::VARCHAR || ':{}')"


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_MD5.format(17)}, doc_id) AS r FROM documents) WHERE r <= 20")
def seeded_top_n_per_source(s, d):
    return ordered.seeded_top(table(s, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 17, 20)


@query("SELECT doc_id, source, copy FROM documents, unnest(generate_series(1, CASE source WHEN 'solution_text' THEN 3 WHEN 'chat_sample' THEN 2 ELSE 1 END)) t(copy)")
def oversample_mix(s, d):
    times = F.when(F.col("source") == "solution_text", 3).when(F.col("source") == "chat_sample", 2).otherwise(1)
    return table(s, d, "documents").select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("bigint"), times.cast("bigint"))).alias("copy"))


@query(f"WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY {_MD5.format(5)}, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= greatest(1, least(500, n // 20)) THEN 'validation' ELSE 'train' END AS split FROM k")
def train_val_split(s, d):
    """Exact sizes without one global sort of all rows: only the validation rows are ranked."""
    docs = table(s, d, "documents").select("doc_id")
    n = docs.count()
    size = max(1, min(500, n // 20))
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("5")))
    validation = docs.withColumn("h", order).orderBy("h", "doc_id").limit(size).select("doc_id", F.lit("validation").alias("split"))
    return docs.join(validation, "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@query("""WITH p AS (SELECT item_id AS companion, benchmark, row_number() OVER (PARTITION BY benchmark ORDER BY md5(item_id::VARCHAR || ':3'), item_id) - 1 AS k, count(*) OVER (PARTITION BY benchmark) AS n FROM benchmark_item WHERE split = 'test'),
q AS (SELECT item_id, benchmark, CAST('0x' || left(md5(item_id::VARCHAR || ':7'), 8) AS BIGINT) AS h FROM benchmark_item WHERE split = 'validation')
SELECT q.item_id, p.companion FROM q JOIN p ON q.benchmark = p.benchmark WHERE (p.k - q.h % p.n + p.n) % p.n < 4""")
def fewshot_companions(s, d):
    """Four companions of each item: the pool in a seeded order, from a seeded place on, in a ring; items meet no more of the pool than these."""
    items = table(s, d, "benchmark_item")
    pool = items.where("split = 'test'").select(F.col("item_id").alias("companion"), "benchmark", F.md5(F.concat_ws(":", "item_id", F.lit("3"))).alias("h"))
    sizes = pool.groupBy("benchmark").agg(F.count("*").alias("n"))
    ranked = ordered.ranked_by_hash(pool, ["benchmark"], "h", "companion", "k").select("benchmark", "companion", "k")
    start = F.conv(F.left(F.md5(F.concat_ws(":", "item_id", F.lit("7"))), F.lit(8)), 16, 10).cast("bigint") % F.col("n")
    q = items.where("split = 'validation'").select("item_id", "benchmark").join(sizes, "benchmark").withColumn("s", start)
    places = F.transform(F.sequence(F.lit(0), F.least(F.lit(3).cast("bigint"), F.col("n") - 1).cast("int")), lambda j: (F.col("s") + j) % F.col("n"))
    return q.select("item_id", "benchmark", F.explode(places).alias("k")).join(ranked, ["benchmark", "k"]).select("item_id", "companion")


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN left(text, 4000) || chr(10) || '...[truncated]' ELSE text END AS text, length(text) > 4000 AS truncated FROM documents WHERE text IS NOT NULL")
def truncate_fields(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", text.capped(F.col("text"), 4000, "\n...[truncated]").alias("text"), (F.length("text") > 4000).alias("truncated"))


# ---- lines, traces, resampling, streams ---------------------------------------------------------
_LINES = r"l AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '(\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]')) AS line FROM documents WHERE text <> '')"


def _doc_lines(s, d):
    return lines.lines(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line, CASE WHEN NOT regexp_matches(line, '[^\\s]') THEN 'blank' WHEN contains(line, '{{') AND json_valid(trim(substr(line, strpos(line, '{{')), ' ' || chr(9))) THEN 'json' WHEN contains(line, '{{') THEN 'malformed' ELSE 'warning' END AS kind FROM l)
SELECT doc_id, count(*) AS lines, count_if(kind = 'json') AS json_lines, count_if(kind = 'malformed') AS malformed_json_lines, count_if(kind = 'warning') AS warnings FROM k GROUP BY 1""")
def line_scan_counters(s, d):
    return lines.line_counts(lines.records(_doc_lines(s, d), "doc_id"), "doc_id")


@query(None)
def cluster_bootstrap(s, d):
    """Resampled means of event values by user; the draws are our own, so SQL has no equal."""
    return statistics.cluster_bootstrap(table(s, d, "events"), "value", "user_id")


@query(None)
def python_function_extract(s, d):
    """Top-level Python functions in written files; parsed, never run."""
    e = table(s, d, "agent_event").where("file_path like '%.py' and file_content is not null")
    f = e.select("trajectory_id", "event_index", F.explode(statistics.python_functions("file_content")).alias("f"))
    return f.select("trajectory_id", "event_index", "f.name", "f.n_lines").distinct()


def _stream(s, d):
    return s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")


def _drained(s, d, stream, name, mode="append"):
    """A new run over new folders, named by the session and the run; the query itself is repeatable."""
    folder = f"{ensure_checkpoint_dir(s)}/stream-{name}-{uuid.uuid4().hex}"
    return queue.drained(stream, f"{folder}/state", f"{folder}/rows", mode)


@query("SELECT DISTINCT user_id FROM events")
def queue_dedup_stream(s, d):
    """Users as keys of a queue: each is taken once, though it comes again and again."""
    requests = _stream(s, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # keys are forgotten when no event within 400 days can repeat them, so state does not grow for ever
    return _drained(s, d, queue.once_by_key(requests, "user_id", "ts", "400 days"), "queue_dedup_stream").select("user_id")


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS started FROM events, (VALUES (0), (1)) x(k)) SELECT event_type, started, count(*) AS n_events FROM w GROUP BY 1, 2""")
def sliding_windows(s, d):
    """Hourly counts every half hour, as a stream with a watermark: windows come out when they close, the last one through an end mark."""
    events = table(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    end = events.agg((F.max("ts") + F.expr("INTERVAL 900 DAYS")).alias("ts")).select(F.lit("end").alias("event_type"), "ts")
    source = f"{ensure_checkpoint_dir(s)}/source-sliding_windows-{uuid.uuid4().hex}"
    events.unionByName(end).repartitionByRange(4, "ts").write.parquet(source)
    stream = s.readStream.schema("event_type string, ts timestamp").option("maxFilesPerTrigger", 2).parquet(source)
    out = _drained(s, d, queue.window_counts(stream, late="400 days"), "sliding_windows")
    return out.where("event_type <> 'end'").select("event_type", F.col("started").cast("timestamp_ntz").alias("started"), "n_events")


@query("""WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS o FROM events), i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM t)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 10 MINUTE AS ended, count(*) AS n_events FROM i GROUP BY user_id, k""")
def session_windows(s, d):
    """Sessions by gaps in event time, in batch (the stream's own form is tested on a file stream)."""
    out = queue.session_counts(table(s, d, "events"))
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n_events")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
