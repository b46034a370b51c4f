"""The objective pipeline, end to end: launches, the sources of their scripts, objectives, transitions, rates.

Sources meet launches by keys (trajectory, script name); hashes and positions travel,
and only the few texts that a launch needs are fetched at the end, by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions import labels
from tracequarry.functions.rules import literal
from tracequarry.operators import ordered
from tracequarry.plans.reference import _CALLS, _INV, _POINTS, MEANINGFUL, QUERIES, SQL, _calls, _episode_rows, _inventory, _points, _provenance, cell_consistency, ninth, query
from tracequarry.session import cut_lineage, table

__all__ = ["QUERIES"]
#: Texts that write a file (fixed value).
WRITES = r"(?i)(?:cat|tee|printf|echo)\s+[^\n]*(?:>|>>)|apply_patch|filePath|newString|new_text"
#: Names of scripts in a text, with all that touches them; and each part of a name that itself ends like a script
#: (from every letter on, to the first and to the last such end). File names have no more than 255 characters.
RUNS = r"([\w.-]*\.(?:py|sh)[\w.-]*)"
SHORTEST, LONGEST = r"(?=([\w.-]{1,255}?\.(?:py|sh)))", r"(?=([\w.-]{1,255}\.(?:py|sh)))"
KNOWN = ["supervised_likelihood", "reward_optimization", "preference_optimization", "on_policy_distillation"]
_KNOWN = "(" + ", ".join(map(literal, KNOWN)) + ")"
SUPERVISED = ["supervised_likelihood", "preference_optimization"]
KEY = ["trajectory_id", "call_index"]


def _first_filled(*columns: str) -> Column:
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns])


def _base(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def mentioned(text: Column) -> Column:
    """Script names that a text contains, also within longer ones."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(RUNS), F.lit(1))
    within = F.transform(runs, lambda r: F.concat(F.regexp_extract_all(r, F.lit(SHORTEST), F.lit(1)), F.regexp_extract_all(r, F.lit(LONGEST), F.lit(1))))
    return F.array_distinct(F.flatten(within))


def launches(s, d) -> DataFrame:
    """Training calls with their launch's position and the scripts they start."""
    own = _calls(s, d).where("training_launched").select(*KEY, F.col("event_index").alias("launch"), "command")
    return own.withColumn("scripts", F.array_distinct(F.coalesce(labels.launched_scripts(F.col("command")), F.array().cast("array<string>"))))


def matched_events(s, d, columns: tuple[str, ...], writing: bool, k: int | None = None) -> DataFrame:
    """(trajectory_id, call_index, launch, event_index): events at or before a launch whose file is one of its scripts or whose text contains one.

    writing: only texts that write a file count for what they contain. k: only each launch's last k.
    """
    e = table(s, d, "agent_event").select("trajectory_id", "event_index", "file_path", *columns).withColumn("source", _first_filled(*columns)).where("source is not null")
    contains = F.col("source").rlike(r"(?i)\.(?:py|sh)")
    if writing:
        contains = contains & (F.coalesce(F.length("file_path") > 0, F.lit(False)) | F.col("source").rlike(WRITES))
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.when(contains, mentioned(F.col("source"))).otherwise(none), F.array_compact(F.array(F.when(F.col("file_path") != "", _base(F.col("file_path")))))))
    target = launches(s, d).select(*KEY, "launch", F.explode("scripts").alias("script"))
    keys = ["trajectory_id", "script"]
    named = e.select("trajectory_id", "event_index", F.explode(names).alias("script")).join(target.select(*keys).distinct(), keys, "left_semi").distinct()
    # the sources of a script are numbered; a launch takes those up to its latest one: no launch meets all sources
    sources = ordered.numbered(named, keys, "event_index", "k")
    latest = ordered.asof_backward(target.withColumn("event_index", F.col("launch")), sources, keys, "event_index", ["k"]).where("k is not null")
    first = F.lit(0).cast("bigint") if k is None else F.greatest(F.col("k") - (k - 1), F.lit(0))
    wanted = latest.select(*keys, "call_index", "launch", F.explode(F.sequence(first, F.col("k"))).alias("k"))
    met = wanted.join(sources, [*keys, "k"]).select(*KEY, "launch", "event_index").distinct()
    if k is None:
        return met
    few = met.groupBy(*KEY, "launch").agg(F.slice(F.reverse(F.array_sort(F.collect_set("event_index"))), 1, k).alias("es"))  # k times the scripts of a launch
    return few.select(*KEY, "launch", F.explode("es").alias("event_index"))


def _texts(s, d, columns: tuple[str, ...]) -> DataFrame:
    return table(s, d, "agent_event").select("trajectory_id", "event_index", _first_filled(*columns).alias("source")).where("source is not null")


def joined_texts(s, d, keys: DataFrame, columns: tuple[str, ...], by: list[str]) -> DataFrame:
    """(by, sources): the texts of some events in order, as an array; each event once."""
    found = _texts(s, d, columns).join(keys, ["trajectory_id", "event_index"]).groupBy(*by, "event_index").agg(F.min("source").alias("source"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_index", "source"))), lambda x: x["source"])
    return found.groupBy(*by).agg(listed.alias("sources"))


def objective_contexts(s, d) -> DataFrame:
    """Training calls with the last eight sources, at or before the launch, of the scripts they launch, cut to the end."""
    columns = ("file_content", "command", "text")
    met = matched_events(s, d, columns, writing=True, k=8).select(*KEY, "event_index")
    context = joined_texts(s, d, met, columns, KEY).select(*KEY, F.right(F.array_join("sources", "\n"), F.lit(400_000)).alias("context"))
    return launches(s, d).drop("scripts").join(context, KEY, "left")


_OBJECTIVES = f"""{_CALLS}, ev AS (SELECT DISTINCT trajectory_id, event_index, file_path, file_content, command, text FROM agent_event),
src AS (SELECT trajectory_id, event_index, lower(regexp_replace(file_path, '^.*/', '')) AS own, coalesce(nullif(file_content, ''), nullif(command, ''), nullif(text, '')) AS source, file_path FROM ev),
la AS (SELECT trajectory_id, call_index, event_index AS launch, command, list_distinct({labels.launched_scripts_sql('command')}) AS scripts FROM c WHERE training_launched),
met AS (SELECT DISTINCT l.trajectory_id, l.call_index, s.event_index, s.source FROM la l JOIN src s ON l.trajectory_id = s.trajectory_id AND s.event_index <= l.launch AND s.source IS NOT NULL
  AND (list_contains(l.scripts, s.own) OR ((s.file_path <> '' OR regexp_matches(s.source, {literal(WRITES)})) AND len(list_filter(l.scripts, lambda t: contains(lower(s.source), t))) > 0))),
last AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id, call_index ORDER BY event_index DESC) AS r FROM met),
ctx AS (SELECT l.trajectory_id, l.call_index, any_value(l.launch) AS launch, any_value(l.command) AS command, right(string_agg(x.source, chr(10) ORDER BY x.event_index), 400000) AS context FROM la l LEFT JOIN last x ON x.trajectory_id = l.trajectory_id AND x.call_index = l.call_index AND x.r <= 8 GROUP BY 1, 2),
ob AS (SELECT trajectory_id, call_index, launch, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY call_index) - 1 AS BIGINT) AS experiment_index, count(*) OVER (PARTITION BY trajectory_id) AS n, {labels.objective_signature_sql('command', 'context')} AS signature, {labels.objective_confidence_sql('command', 'context')} AS confidence FROM ctx),
ep AS (SELECT trajectory_id, experiment_index, call_index, launch, {labels.form_sql('signature')} AS form, signature, confidence, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE experiment_index / greatest(1, n - 1) END AS normalized_progress FROM ob),
tr AS (SELECT *, lag(signature) OVER w AS from_signature, lag(form) OVER w AS from_form, lag(experiment_index) OVER w AS from_experiment FROM ep WINDOW w AS (PARTITION BY trajectory_id ORDER BY experiment_index)),
pairs AS (SELECT * FROM tr WHERE from_signature <> 'objective_unknown' AND signature <> 'objective_unknown')"""


def _episodes(s, d) -> DataFrame:
    """One row a launch; a few words each and read by several joins, so written once."""
    o = labels.objective(F.col("command"), F.col("context"))
    labelled = objective_contexts(s, d).select(*KEY, "launch", o.alias("o")).select(*KEY, "launch", "o.form", "o.signature", "o.confidence")
    at = ordered.numbered(labelled, ["trajectory_id"], "call_index", "experiment_index")
    n = launches(s, d).groupBy("trajectory_id").agg(F.count("*").alias("n"))
    progress = F.when(F.col("n") == 1, 1.0).otherwise(F.col("experiment_index") / F.greatest(F.lit(1), F.col("n") - 1))
    return cut_lineage(at.join(n, "trajectory_id").select("trajectory_id", "experiment_index", "call_index", "launch", "form", "signature", "confidence", progress.alias("normalized_progress")))


@query(f"WITH {_OBJECTIVES} SELECT * FROM ep")
def objective_episodes(s, d):
    """Launched training calls, each with the objective that its script's code, or else its name, shows."""
    return _episodes(s, d)


def _transitions(episodes: DataFrame) -> DataFrame:
    lag = ordered.blocked_lag(episodes, ["trajectory_id"], "experiment_index", F.struct("experiment_index", "signature", "form"), "b")
    known = lag.where((F.col("b.signature") != "objective_unknown") & (F.col("signature") != "objective_unknown"))  # looked up before unknown ones go: they are not bridged
    return ordered.numbered(known, ["trajectory_id"], "experiment_index", "transition_index").select(
        "trajectory_id", "transition_index", F.col("b.form").alias("from_objective"), F.col("form").alias("to_objective"), F.col("b.signature").alias("from_signature"), F.col("signature").alias("to_signature"),
        F.when(F.col("b.signature") != F.col("signature"), "objective_change").otherwise("same_objective").alias("transition_type"), F.col("b.experiment_index").alias("from_experiment"), F.col("experiment_index").alias("to_experiment"), "normalized_progress",
    )


@query(f"""WITH {_OBJECTIVES} SELECT trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY experiment_index) - 1 AS BIGINT) AS transition_index, from_form AS from_objective, form AS to_objective, from_signature, signature AS to_signature,
  CASE WHEN from_signature <> signature THEN 'objective_change' ELSE 'same_objective' END AS transition_type, from_experiment, experiment_index AS to_experiment, normalized_progress FROM pairs""")
def objective_transitions(s, d):
    """Adjacent launches whose objectives are both known."""
    return _transitions(_episodes(s, d))


_HARNESS = f"h AS (SELECT DISTINCT trajectory_id, {labels._first_word_sql('lower(batch_id)', labels.HARNESSES, chr(39) + 'Unknown' + chr(39), True)} AS harness_family, benchmark, base_model FROM run_inventory)"
_PER_RUN = f"""{_OBJECTIVES}, {_HARNESS}, o AS (SELECT trajectory_id, count(*) AS pairs, count_if(from_signature <> signature) AS changes FROM pairs GROUP BY 1),
i AS (SELECT trajectory_id, arg_min(form, experiment_index) AS initial_objective FROM ep GROUP BY 1), r AS (SELECT h.*, initial_objective, coalesce(pairs, 0) AS pairs, coalesce(changes, 0) AS changes FROM h LEFT JOIN o USING (trajectory_id) LEFT JOIN i USING (trajectory_id))"""


def _runs(s, d) -> DataFrame:
    return table(s, d, "run_inventory").select("trajectory_id", F.coalesce(labels.harness(F.col("batch_id")), F.lit("Unknown")).alias("harness_family"), "benchmark", "base_model").distinct()


def _per_run(s, d) -> DataFrame:
    """One row a run with its initial objective and its counts of known adjacent pairs."""
    episodes = _episodes(s, d)
    pairs = _transitions(episodes).groupBy("trajectory_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("transition_type") == "objective_change").alias("changes"))
    initial = episodes.groupBy("trajectory_id").agg(F.min_by("form", "experiment_index").alias("initial_objective"))
    return _runs(s, d).join(pairs, "trajectory_id", "left").join(initial, "trajectory_id", "left").fillna(0, ["pairs", "changes"])


@query(f"""WITH {_PER_RUN} SELECT harness_family, count(*) AS n, count_if(coalesce(initial_objective IN {_KNOWN}, false)) AS n_objective_ready, count_if(pairs > 0) AS n_with_valid_pair, count_if(changes > 0) AS n_with_objective_change,
CAST(sum(pairs) AS BIGINT) AS valid_objective_pairs, CAST(sum(pairs - changes) AS BIGINT) AS same_objective_pairs, CAST(sum(changes) AS BIGINT) AS objective_change_pairs, sum(changes) / nullif(sum(pairs), 0) AS objective_change_rate, sum(pairs - changes) / nullif(sum(pairs), 0) AS within_objective_rate FROM r GROUP BY 1""")
def objective_change_rate(s, d):
    """Per harness, changes among adjacent pairs of known objectives: sums of counts, null without pairs."""
    ready = F.coalesce(F.col("initial_objective").isin(KNOWN), F.lit(False))
    out = _per_run(s, d).groupBy("harness_family").agg(
        F.count("*").alias("n"), F.count_if(ready).alias("n_objective_ready"), F.count_if(F.col("pairs") > 0).alias("n_with_valid_pair"), F.count_if(F.col("changes") > 0).alias("n_with_objective_change"),
        F.sum("pairs").alias("valid_objective_pairs"), F.sum(F.col("pairs") - F.col("changes")).alias("same_objective_pairs"), F.sum("changes").alias("objective_change_pairs"),
    )
    return out.withColumn("objective_change_rate", F.try_divide("objective_change_pairs", "valid_objective_pairs")).withColumn("within_objective_rate", F.try_divide("same_objective_pairs", "valid_objective_pairs"))


_INITIAL = f"{_PER_RUN}, g AS (SELECT harness_family, benchmark, initial_objective, count(*) AS n, min(trajectory_id) AS first FROM r WHERE initial_objective IS NOT NULL GROUP BY ALL)"


def _initial(s, d) -> DataFrame:
    """Runs per harness, benchmark and initial objective (of the launched ones, also unknown), with the first of them."""
    return _per_run(s, d).where("initial_objective is not null").groupBy("harness_family", "benchmark", "initial_objective").agg(F.count("*").alias("n"), F.min("trajectory_id").alias("first"))


@query(f"""WITH {_INITIAL}, t AS (SELECT harness_family, benchmark, sum(n) AS total, count(*) AS kinds, max(n) AS top, arg_min(initial_objective, (-n, first)) AS top_objective FROM g GROUP BY 1, 2)
SELECT g.harness_family, g.benchmark, CAST(total AS BIGINT) AS n, kinds AS n_kinds, top_objective, top / total AS top_share, round(0 - sum(g.n / total * ln(g.n / total)), 9) AS entropy, round((0 - sum(g.n / total * ln(g.n / total))) / ln(greatest(2, kinds)), 9) AS normalized_entropy
FROM g JOIN t ON g.harness_family = t.harness_family AND g.benchmark IS NOT DISTINCT FROM t.benchmark GROUP BY g.harness_family, g.benchmark, total, kinds, top, top_objective""")
def initial_objective_entropy(s, d):
    """Distribution of initial objectives; of equally frequent ones the first seen is the top."""
    by = _initial(s, d).groupBy("harness_family", "benchmark").agg(F.sum("n").alias("total"), F.count("*").alias("n_kinds"), F.max("n").alias("top"), F.min_by("initial_objective", F.struct(-F.col("n"), "first")).alias("top_objective"), F.collect_list("n").alias("ns"))  # one number a kind
    h = F.aggregate("ns", F.lit(0.0), lambda acc, n: acc - n / F.col("total") * F.log(n / F.col("total")))
    return by.select("harness_family", "benchmark", F.col("total").alias("n"), "n_kinds", "top_objective", (F.col("top") / F.col("total")).alias("top_share"), ninth(h).alias("entropy"), ninth(h / F.log(F.greatest(F.lit(2), F.col("n_kinds")))).alias("normalized_entropy"))


_FORMS = [*KNOWN, "objective_unknown"]


@query(f"WITH {_INITIAL} SELECT harness_family, benchmark, arg_max(initial_objective, (n, -list_position([{', '.join(map(literal, _FORMS))}], initial_objective))) AS dominant, max(n) AS dominant_n FROM g GROUP BY 1, 2")
def initial_objective_dominant(s, d):
    """The commonest initial objective, ties in a fixed order."""
    rank = F.array_position(F.array(*[F.lit(f) for f in _FORMS]), F.col("initial_objective"))
    best = F.max_by(F.struct("initial_objective", "n"), F.struct(F.col("n"), -rank)).alias("b")
    return _initial(s, d).groupBy("harness_family", "benchmark").agg(best).select("harness_family", "benchmark", F.col("b.initial_objective").alias("dominant"), F.col("b.n").alias("dominant_n"))


@query(f"""WITH {_POINTS}, {_PER_RUN}, l AS (SELECT trajectory_id, arg_max(metric_value, (event_index, metric_name, metric_value)) AS final_metric FROM points GROUP BY 1),
j AS (SELECT r.benchmark, r.initial_objective, final_metric FROM r JOIN l USING (trajectory_id) WHERE initial_objective IS NOT NULL), b AS (SELECT benchmark, avg(final_metric) AS bm FROM j GROUP BY 1)
SELECT j.benchmark, j.initial_objective, count(*) AS n, round(avg(final_metric), 9) AS mean_metric, round(avg(final_metric) - any_value(bm), 9) + 0 AS centered_mean FROM j JOIN b ON j.benchmark IS NOT DISTINCT FROM b.benchmark GROUP BY 1, 2""")
def outcome_by_objective(s, d):
    """Mean final metric by initial objective, as it is and against its benchmark's mean."""
    at = F.struct("event_index", "metric_name", "metric_value")
    final = _points(s, d).groupBy("trajectory_id").agg(F.max_by("metric_value", at).alias("m"))
    j = _per_run(s, d).where("initial_objective is not null").join(final, "trajectory_id")
    # sums by group first, then the benchmark's mean over the few groups
    g = j.groupBy("benchmark", "initial_objective").agg(F.count("*").alias("n"), F.sum("m").alias("t"))
    b = g.groupBy("benchmark").agg((F.sum("t") / F.sum("n")).alias("bm")).withColumnRenamed("benchmark", "b_")
    both = g.join(b, g.benchmark.eqNullSafe(b.b_))
    return both.select("benchmark", "initial_objective", "n", ninth(F.col("t") / F.col("n")).alias("mean_metric"), (ninth(F.col("t") / F.col("n") - F.col("bm")) + 0.0).alias("centered_mean"))


# ---- the broad audit: where a launch's data and weights come from -------------------------------
_SOURCES = ("file_content", "command")
_SRC = "coalesce(nullif(file_content, ''), nullif(command, ''))"


def _launch_windows(s, d) -> DataFrame:
    """Launches as positions, each once, with the launch before it (-1 for none) and the command at its event."""
    own = launches(s, d).select("trajectory_id", F.col("launch").alias("p")).distinct()
    lag = ordered.blocked_lag(own, ["trajectory_id"], "p", F.struct("p"), "b")
    at = table(s, d, "agent_event").select("trajectory_id", F.col("event_index").alias("p"), "command").where("command is not null")
    commands = at.join(own, ["trajectory_id", "p"]).groupBy("trajectory_id", "p").agg(F.min("command").alias("command"))
    return lag.join(commands, ["trajectory_id", "p"], "left").select("trajectory_id", F.col("p").alias("launch"), F.coalesce("b.p", F.lit(-1)).alias("previous_launch"), F.coalesce("command", F.lit("")).alias("launch_command"))


_WINDOWS = f"""{_OBJECTIVES}, lw0 AS (SELECT DISTINCT trajectory_id, launch FROM la), lw AS (SELECT trajectory_id, launch, coalesce(lag(launch) OVER (PARTITION BY trajectory_id ORDER BY launch), -1) AS previous_launch,
  coalesce((SELECT min(command) FROM ev WHERE ev.trajectory_id = lw0.trajectory_id AND ev.event_index = lw0.launch), '') AS launch_command FROM lw0),
so AS (SELECT trajectory_id, event_index, min({_SRC}) AS source, min(lower(regexp_replace(coalesce(file_path, ''), '^.*/', ''))) AS own FROM ev WHERE {_SRC} IS NOT NULL GROUP BY 1, 2),
tg AS (SELECT trajectory_id, launch, list_distinct(flatten(list(scripts))) AS scripts FROM la GROUP BY 1, 2),
hit AS (SELECT l.trajectory_id, l.launch, s.event_index, s.source, (s.own <> '' AND list_contains(t.scripts, s.own)) OR len(list_filter(t.scripts, lambda x: contains(lower(s.source), x))) > 0 AS is_script, s.event_index > l.previous_launch AS in_window
  FROM lw l JOIN tg t USING (trajectory_id, launch) JOIN so s ON s.trajectory_id = l.trajectory_id AND s.event_index <= l.launch),
sc AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id, launch ORDER BY event_index DESC) AS r, count(*) OVER (PARTITION BY trajectory_id, launch) AS n FROM hit WHERE is_script),
script AS (SELECT l.trajectory_id, l.launch, right(concat_ws(chr(10), CASE WHEN coalesce(max(n), 0) < 12 THEN any_value(l.launch_command) END, string_agg(source, chr(10) ORDER BY event_index)), 300000) AS script_context FROM lw l LEFT JOIN sc ON sc.trajectory_id = l.trajectory_id AND sc.launch = l.launch AND r <= 12 GROUP BY 1, 2),
wi AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id, launch ORDER BY event_index DESC) AS r FROM hit WHERE in_window AND NOT is_script)"""


def _script_contexts(s, d) -> DataFrame:
    """(trajectory_id, launch, script_context): the last twelve of the launch's command and the sources of its scripts, cut to the end."""
    met = matched_events(s, d, _SOURCES, writing=False, k=12).select("trajectory_id", "launch", "event_index").distinct()
    few = met.groupBy("trajectory_id", "launch").agg(F.slice(F.reverse(F.array_sort(F.collect_set("event_index"))), 1, 12).alias("es")).select("trajectory_id", "launch", F.explode("es").alias("event_index"))
    texts = joined_texts(s, d, few, _SOURCES, ["trajectory_id", "launch"])
    out = _launch_windows(s, d).join(texts, ["trajectory_id", "launch"], "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    chunks = F.when(F.size("sources") < 12, F.concat(F.array("launch_command"), F.col("sources"))).otherwise(F.col("sources"))
    return out.select("trajectory_id", "launch", "previous_launch", F.right(F.array_join(chunks, "\n"), F.lit(300_000)).alias("script_context"))


@query(f"""WITH {_WINDOWS} SELECT l.trajectory_id, l.launch, l.previous_launch, count(w.event_index) AS n_window_events, md5(right(string_agg(w.source, chr(10) ORDER BY w.event_index), 300000)) AS context_hash
FROM lw l LEFT JOIN wi w ON w.trajectory_id = l.trajectory_id AND w.launch = l.launch AND w.r <= 40 GROUP BY 1, 2, 3""")
def launch_windows(s, d):
    """The last forty other sources between a launch and the one before it.

    Each event goes to its next launch, so no range join is needed; sources of the
    launch's own scripts are left out.
    """
    windows = _launch_windows(s, d).drop("launch_command")
    marks = windows.select("trajectory_id", F.col("launch").alias("event_index"), F.lit(True).alias("mark"))
    positions = _texts(s, d, _SOURCES).select("trajectory_id", "event_index").distinct().withColumn("mark", F.lit(False)).unionByName(marks)
    one = positions.groupBy("trajectory_id", "event_index").agg(F.max("mark").alias("is_launch"), F.min("mark").alias("only_mark"))
    placed = ordered.next_boundary(one, ["trajectory_id"], "event_index", F.col("is_launch"), "launch").where("launch is not null and not only_mark").select("trajectory_id", "launch", "event_index")
    own = matched_events(s, d, _SOURCES, writing=False).select("trajectory_id", "launch", "event_index").distinct()
    other = placed.join(own, ["trajectory_id", "launch", "event_index"], "left_anti")
    last = ordered.last_k(other, ["trajectory_id", "launch"], "event_index", 40)
    texts = joined_texts(s, d, last, _SOURCES, ["trajectory_id", "launch"])
    out = windows.join(texts, ["trajectory_id", "launch"], "left")
    return out.select("trajectory_id", "launch", "previous_launch", F.coalesce(F.size("sources"), F.lit(0)).cast("bigint").alias("n_window_events"), F.md5(F.right(F.array_join("sources", "\n"), F.lit(300_000))).alias("context_hash"))


_LABELS = f"""{_WINDOWS}, {_HARNESS},
mk AS (SELECT trajectory_id, event_index, lower(regexp_replace(f, '^.*/', '')) AS file, {labels.provenance_mark_sql('source')} AS kind FROM (SELECT *, unnest({labels.data_files_sql('source')}) AS f FROM so) WHERE {labels.provenance_mark_sql('source')} IS NOT NULL),
us AS (SELECT DISTINCT trajectory_id, launch, lower(regexp_replace(f, '^.*/', '')) AS file FROM (SELECT *, unnest({labels.data_files_sql('script_context')}) AS f FROM script)),
pm AS (SELECT u.trajectory_id, u.launch, bool_or(kind = 'self') AS has_self, bool_or(kind = 'curated') AS has_curated FROM (SELECT u.trajectory_id, u.launch, u.file, arg_max(m.kind, (m.event_index, m.kind)) AS kind FROM us u JOIN mk m ON m.trajectory_id = u.trajectory_id AND m.file = u.file AND m.event_index <= u.launch GROUP BY ALL) u GROUP BY 1, 2),
la2 AS (SELECT e.trajectory_id, e.experiment_index, coalesce(h.harness_family, 'Unknown') AS harness_family, e.form, e.signature, {labels.data_source_sql('e.form', 's.script_context', 'coalesce(pm.has_self, false)', 'coalesce(pm.has_curated, false)')} AS data_source, {labels.init_source_sql('s.script_context')} AS init_source
  FROM ep e JOIN script s ON s.trajectory_id = e.trajectory_id AND s.launch = e.launch LEFT JOIN pm ON pm.trajectory_id = e.trajectory_id AND pm.launch = e.launch LEFT JOIN h ON h.trajectory_id = e.trajectory_id)"""


def _episode_labels(s, d, episodes: DataFrame | None = None) -> DataFrame:
    """One row a launch; read by two joins, so written once."""
    episodes = _episodes(s, d) if episodes is None else episodes
    contexts = _script_contexts(s, d)
    files = contexts.select("trajectory_id", F.col("launch").alias("event_index"), F.explode(labels.data_files(F.col("script_context"))).alias("f")).select("trajectory_id", "event_index", _base(F.col("f")).alias("file")).distinct()
    marked = ordered.asof_backward(files, _provenance(s, d), ["trajectory_id", "file"], "event_index", ["kind"]).where("kind is not null")
    flags = marked.groupBy("trajectory_id", F.col("event_index").alias("launch")).agg(F.max(F.col("kind") == "self").alias("has_self"), F.max(F.col("kind") == "curated").alias("has_curated"))
    no = F.lit(False)
    both = episodes.join(contexts, ["trajectory_id", "launch"]).join(flags, ["trajectory_id", "launch"], "left").join(_runs(s, d).select("trajectory_id", "harness_family"), "trajectory_id", "left")
    label = labels.data_source(F.col("form"), F.col("script_context"), F.coalesce("has_self", no), F.coalesce("has_curated", no))
    return cut_lineage(both.select("trajectory_id", "experiment_index", F.coalesce("harness_family", F.lit("Unknown")).alias("harness_family"), "form", "signature", label.alias("data_source"), labels.init_source(F.col("script_context")).alias("init_source")))


@query(f"WITH {_LABELS} SELECT * FROM la2")
def data_source_labels(s, d):
    """Where each launch's training data and weights come from: its scripts' text, and the latest marks of its data files."""
    return _episode_labels(s, d)


_BROAD = f"""{_LABELS}, bp AS (SELECT p.trajectory_id, a.harness_family, p.from_experiment, p.experiment_index AS to_experiment, p.from_signature <> p.signature AS paradigm_change, a.form IN ('supervised_likelihood', 'preference_optimization') AND b.form IN ('supervised_likelihood', 'preference_optimization') AS both_supervised,
  a.data_source AS from_data_source, b.data_source AS to_data_source, a.init_source AS fi, b.init_source AS ti FROM pairs p JOIN la2 a ON a.trajectory_id = p.trajectory_id AND a.experiment_index = p.from_experiment JOIN la2 b ON b.trajectory_id = p.trajectory_id AND b.experiment_index = p.experiment_index),
bq AS (SELECT *, both_supervised AND from_data_source IN ('curated', 'self_generated', 'mixed') AND to_data_source IN ('curated', 'self_generated', 'mixed') AS data_known, NOT paradigm_change AND fi <> 'unknown' AND ti <> 'unknown' AND fi <> ti AS stage_candidate FROM bp),
br AS (SELECT * EXCLUDE (fi, ti), data_known AND (from_data_source IN ('self_generated', 'mixed')) <> (to_data_source IN ('self_generated', 'mixed')) AS data_change FROM bq), bs AS (SELECT *, paradigm_change OR data_change AS broad_change FROM br)"""


def _broad_pairs(s, d) -> DataFrame:
    """Adjacent known pairs with the labels of both sides: transitions joined to labels twice; pairs that lack one are dropped."""
    episodes = _episodes(s, d)
    own = _episode_labels(s, d, episodes)
    side = lambda p: own.select("trajectory_id", F.col("experiment_index").alias(f"{p}_experiment"), F.col("harness_family").alias(f"{p}_harness"), F.col("form").alias(f"{p}_form"), F.col("data_source").alias(f"{p}_data_source"), F.col("init_source").alias(f"{p}_init"))
    both = _transitions(episodes).select("trajectory_id", "from_experiment", "to_experiment", (F.col("transition_type") == "objective_change").alias("paradigm_change")).join(side("from"), ["trajectory_id", "from_experiment"]).join(side("to"), ["trajectory_id", "to_experiment"])
    told = lambda p: F.col(f"{p}_data_source").isin("curated", "self_generated", "mixed")
    made = lambda p: F.col(f"{p}_data_source").isin("self_generated", "mixed")
    both = both.withColumn("both_supervised", F.col("from_form").isin(SUPERVISED) & F.col("to_form").isin(SUPERVISED)).withColumn("data_known", F.col("both_supervised") & told("from") & told("to"))
    stage = ~F.col("paradigm_change") & (F.col("from_init") != "unknown") & (F.col("to_init") != "unknown") & (F.col("from_init") != F.col("to_init"))
    both = both.withColumn("data_change", F.col("data_known") & (made("from") != made("to"))).withColumn("stage_candidate", stage).withColumn("broad_change", F.col("paradigm_change") | F.col("data_change"))
    return both.select("trajectory_id", F.col("from_harness").alias("harness_family"), "from_experiment", "to_experiment", "paradigm_change", "both_supervised", "data_known", "data_change", "from_data_source", "to_data_source", "stage_candidate", "broad_change")


@query(f"WITH {_BROAD} SELECT * FROM bs")
def broad_pairs(s, d):
    return _broad_pairs(s, d)


@query(f"""WITH {_BROAD}, x AS (SELECT trajectory_id, harness_family, count(*) AS pairs, count_if(paradigm_change) AS paradigm, count_if(both_supervised) AS supervised, count_if(data_known) AS known, count_if(data_change) AS data, count_if(stage_candidate) AS stage, count_if(broad_change) AS broad FROM bs GROUP BY 1, 2)
SELECT harness_family, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs, CAST(coalesce(sum(paradigm), 0) AS BIGINT) AS paradigm_changes, CAST(coalesce(sum(supervised), 0) AS BIGINT) AS supervised_pairs, CAST(coalesce(sum(known), 0) AS BIGINT) AS data_known_pairs, CAST(coalesce(sum(data), 0) AS BIGINT) AS data_changes, CAST(coalesce(sum(stage), 0) AS BIGINT) AS stage_candidates,
CAST(coalesce(sum(broad), 0) AS BIGINT) AS broad_changes, sum(broad) / sum(pairs) AS broad_change_rate, count_if(paradigm > 0) AS trajectories_with_paradigm_change, count_if(broad > 0) AS trajectories_with_broad_change FROM x GROUP BY ROLLUP (harness_family) HAVING count(*) > 0""")
def broad_change_rollup(s, d):
    """Corpus and harness summary of broad changes; one row a trajectory first, so distinct trajectories are rows."""
    names = {"paradigm_change": "paradigm_changes", "both_supervised": "supervised_pairs", "data_known": "data_known_pairs", "data_change": "data_changes", "stage_candidate": "stage_candidates", "broad_change": "broad_changes"}
    x = _broad_pairs(s, d).groupBy("trajectory_id", "harness_family").agg(F.count("*").alias("pairs"), *[F.count_if(c).alias(n) for c, n in names.items()])
    zero = F.lit(0)
    out = x.rollup("harness_family").agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("pairs", *names.values())], F.count_if(F.col("paradigm_changes") > 0).alias("trajectories_with_paradigm_change"), F.count_if(F.col("broad_changes") > 0).alias("trajectories_with_broad_change"))
    return out.withColumn("broad_change_rate", F.try_divide("broad_changes", "pairs"))


@query(f"WITH {_LABELS} SELECT count(*) AS supervised_episodes, coalesce(count_if(data_source = 'curated'), 0) AS curated, coalesce(count_if(data_source = 'self_generated'), 0) AS self_generated, coalesce(count_if(data_source = 'mixed'), 0) AS mixed, coalesce(count_if(data_source = 'unknown'), 0) AS unknown FROM la2 WHERE form IN ('supervised_likelihood', 'preference_optimization')")
def label_coverage(s, d):
    """How many supervised launches have each data-source label."""
    own = _episode_labels(s, d).where(F.col("form").isin(SUPERVISED))
    return own.agg(F.count("*").alias("supervised_episodes"), *[F.count_if(F.col("data_source") == x).alias(x) for x in ("curated", "self_generated", "mixed", "unknown")])


# ---- cumulative transitions, comparison of scaffolds ---------------------------------------------
_EP2 = SQL["episode_islands"].removeprefix("WITH ").removesuffix(" SELECT * FROM ep")


@query(f"""WITH {_EP2}, t AS (SELECT trajectory_id, episode_index, start_call, family, CASE WHEN lag(family) OVER w IS NULL THEN NULL WHEN lag(family) OVER w <> family AND lag(family) OVER w <> 'other_unknown' AND family <> 'other_unknown' THEN 'core' ELSE 'local' END AS kind FROM ep WINDOW w AS (PARTITION BY trajectory_id ORDER BY episode_index)),
u AS (SELECT trajectory_id, start_call, episode_index, family, CAST(count_if(kind = 'local') OVER w AS BIGINT) AS cl, CAST(count_if(kind = 'core') OVER w AS BIGINT) AS cc FROM t WINDOW w AS (PARTITION BY trajectory_id ORDER BY episode_index)),
a AS (SELECT trajectory_id, call_index FROM c WHERE action_category IN ('training', 'evaluation', 'checkpoint', 'debugging', 'data_preparation', 'monitoring'))
SELECT a.trajectory_id, a.call_index, coalesce(u.episode_index, 0) AS episode_index, u.family AS strategy_state, coalesce(cl, 0) AS cumulative_local_refinements, coalesce(cc, 0) AS cumulative_core_transitions FROM a ASOF LEFT JOIN u ON a.trajectory_id = u.trajectory_id AND a.call_index >= u.start_call""")
def cumulative_transitions(s, d):
    """Local and core transitions up to each action: running sums over episodes, met as of the call."""
    ep = _episode_rows(s, d).select("trajectory_id", "episode_index", "start_call", "family")
    lag = ordered.blocked_lag(ep, ["trajectory_id"], "episode_index", F.struct("family"), "b")
    core = F.coalesce((F.col("b.family") != F.col("family")) & (F.col("b.family") != "other_unknown") & (F.col("family") != "other_unknown"), F.lit(False))
    sums = ordered.running_sum(lag, ["trajectory_id"], "episode_index", {"cl": (F.col("b").isNotNull() & ~core).cast("int"), "cc": core.cast("int")})
    marks = sums.select("trajectory_id", F.col("start_call").alias("call_index"), "episode_index", F.col("family").alias("strategy_state"), "cl", "cc")
    own = _calls(s, d).where(F.col("action_category").isin([*MEANINGFUL, "monitoring"])).select("trajectory_id", "call_index")
    out = ordered.asof_backward(own, marks, ["trajectory_id"], "call_index", ["episode_index", "strategy_state", "cl", "cc"])
    zero = F.lit(0).cast("bigint")
    return out.select("trajectory_id", "call_index", F.coalesce("episode_index", zero).alias("episode_index"), "strategy_state", F.coalesce("cl", zero).alias("cumulative_local_refinements"), F.coalesce("cc", zero).alias("cumulative_core_transitions"))


METHODS = ["full_sft", "peft_sft", "rl", "preference", "distillation"]
_M = "(" + ", ".join(map(literal, METHODS)) + ")"
_POS = "[" + ", ".join(map(literal, METHODS)) + "]"
_RUN = f"""{_EP2}, {_INV}, {_POINTS}, mt AS (SELECT trajectory_id, arg_max(metric_value, (event_index, metric_name, metric_value)) AS final_metric, max(metric_value) AS best_metric FROM points GROUP BY 1),
cm AS (SELECT trajectory_id, count_if(training_launched) AS trainings, count_if(evaluation_launched) AS evaluations FROM c GROUP BY 1), md AS (SELECT trajectory_id, family, count(*) AS n FROM ep WHERE list_contains(action_categories, 'training') AND family IN {_M} GROUP BY 1, 2),
ini AS (SELECT trajectory_id, arg_min(family, episode_index) AS initial FROM ep WHERE family IN {_M} GROUP BY 1),
rn AS (SELECT coalesce(scaffold_family, 'unknown') AS scaffold, coalesce(benchmark, 'unknown') AS benchmark, base_model, budget_hours, trajectory_id, coalesce(trainings, 0) AS trainings, coalesce(evaluations, 0) AS evaluations, initial, final_metric, best_metric, coalesce(trainings, 0) > 0 AS trained FROM inv LEFT JOIN cm USING (trajectory_id) LEFT JOIN ini USING (trajectory_id) LEFT JOIN mt USING (trajectory_id)),
cmds AS (SELECT rn.scaffold, rn.benchmark, md.family, CAST(sum(n) AS BIGINT) AS n FROM rn JOIN md USING (trajectory_id) WHERE trained GROUP BY 1, 2, 3),
cd AS (SELECT scaffold, benchmark, CAST(sum(n) AS BIGINT) AS identified, max(n) AS top, arg_max(family, (n, -list_position({_POS}, family))) AS dominant, {', '.join(f"CAST(coalesce(sum(n) FILTER (family = '{m}'), 0) AS BIGINT) AS command_{m}_count" for m in METHODS)} FROM cmds GROUP BY 1, 2),
inis AS (SELECT scaffold, benchmark, initial, count(*) AS n FROM rn WHERE trained AND initial IS NOT NULL GROUP BY 1, 2, 3), id AS (SELECT scaffold, benchmark, max(n) AS top, arg_max(initial, (n, -list_position({_POS}, initial))) AS dominant, {', '.join(f"CAST(coalesce(sum(n) FILTER (initial = '{m}'), 0) AS BIGINT) AS initial_{m}_count" for m in METHODS)} FROM inis GROUP BY 1, 2),
gr AS (SELECT scaffold, benchmark, count(DISTINCT base_model) AS base_model_count, array_to_string(list_sort(list(DISTINCT base_model) FILTER (base_model <> '')), '; ') AS base_models, CASE WHEN count(DISTINCT budget_hours) = 1 THEN min(budget_hours)::VARCHAR ELSE 'mixed' END AS budget_hours, count(*) AS n_trajectories, count_if(trained) AS n_trained, count_if(trained AND initial IS NOT NULL) AS n_initial_identified,
  CAST(sum(trainings) AS BIGINT) AS verified_training_commands, count(final_metric) FILTER (trained) AS n_final_scores, round(avg(final_metric) FILTER (trained), 9) AS mean_final_score, round(avg(best_metric) FILTER (trained), 9) AS mean_best_score, CAST(coalesce(sum(evaluations) FILTER (trained), 0) AS BIGINT) AS ev FROM rn GROUP BY 1, 2)"""


@query(f"""WITH {_RUN} SELECT gr.* EXCLUDE (ev), n_initial_identified / nullif(n_trained, 0) AS initial_coverage, id.dominant AS dominant_initial, coalesce(id.top, 0) AS dominant_initial_n, id.top / nullif(n_initial_identified, 0) AS dominant_initial_share, coalesce(cd.identified, 0) AS n_commands_identified, coalesce(cd.identified, 0) / nullif(verified_training_commands, 0) AS command_coverage,
cd.dominant AS dominant_command, coalesce(cd.top, 0) AS dominant_command_n, cd.top / nullif(cd.identified, 0) AS dominant_command_share, verified_training_commands / nullif(n_trained, 0) AS mean_training_commands, ev / nullif(n_trained, 0) AS mean_evaluation_commands, {', '.join(f"coalesce(initial_{m}_count, 0) AS initial_{m}_count, coalesce(command_{m}_count, 0) AS command_{m}_count" for m in METHODS)}
FROM gr LEFT JOIN id USING (scaffold, benchmark) LEFT JOIN cd USING (scaffold, benchmark)""")
def scaffold_comparison(s, d):
    """Per scaffold and benchmark: denominators, dominant methods with their shares, coverage, scores, means, counts by method."""
    ep = _episode_rows(s, d)
    method = F.col("family").isin(METHODS)
    # one row a run: counts by method of its training episodes, and its first method
    per = ep.groupBy("trajectory_id").agg(F.min_by("family", F.when(method, F.col("episode_index"))).alias("initial"), *[F.count_if(F.array_contains("action_categories", "training") & (F.col("family") == m)).alias(f"c_{m}") for m in METHODS])
    counts = _calls(s, d).groupBy("trajectory_id").agg(F.count_if("training_launched").alias("trainings"), F.count_if("evaluation_launched").alias("evaluations"))
    at = F.struct("event_index", "metric_name", "metric_value")
    scores = _points(s, d).groupBy("trajectory_id").agg(F.max_by("metric_value", at).alias("final_metric"), F.max("metric_value").alias("best_metric"))
    unknown = F.lit("unknown")
    run = _inventory(s, d).join(counts, "trajectory_id", "left").join(per, "trajectory_id", "left").join(scores, "trajectory_id", "left").withColumn("trainings", F.coalesce("trainings", F.lit(0))).withColumn("trained", F.col("trainings") > 0)
    t = F.col("trained")
    total = lambda c: F.coalesce(F.sum(F.when(t, F.col(c))), F.lit(0))
    g = run.groupBy(F.coalesce("scaffold_family", unknown).alias("scaffold"), F.coalesce("benchmark", unknown).alias("benchmark")).agg(
        F.count_distinct("base_model").alias("base_model_count"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("base_model") != "", F.col("base_model")))), "; ").alias("base_models"),
        F.when(F.count_distinct("budget_hours") == 1, F.min("budget_hours").cast("string")).otherwise("mixed").alias("budget_hours"), F.count("*").alias("n_trajectories"), F.count_if(t).alias("n_trained"),
        F.count_if(t & F.col("initial").isNotNull()).alias("n_initial_identified"), F.sum("trainings").alias("verified_training_commands"), F.count(F.when(t, F.col("final_metric"))).alias("n_final_scores"),
        ninth(F.avg(F.when(t, F.col("final_metric")))).alias("mean_final_score"), ninth(F.avg(F.when(t, F.col("best_metric")))).alias("mean_best_score"), total("evaluations").alias("ev"),
        *[F.count_if(t & (F.col("initial") == m)).alias(f"initial_{m}_count") for m in METHODS], *[total(f"c_{m}").alias(f"command_{m}_count") for m in METHODS],
    )

    def best(kind: str) -> Column:
        """The commonest method, ties in the order of METHODS; null without any."""
        each = F.array(*[F.struct(F.col(f"{kind}_{m}_count").alias("n"), F.lit(-i).alias("o"), F.lit(m).alias("m")) for i, m in enumerate(METHODS)])
        top = F.array_max(each)
        return F.when(top["n"] > 0, top)

    g = g.withColumn("bi", best("initial")).withColumn("bc", best("command")).withColumn("n_commands_identified", sum((F.col(f"command_{m}_count") for m in METHODS[1:]), F.col(f"command_{METHODS[0]}_count")))
    zero = F.lit(0).cast("bigint")
    return g.select(
        *[c for c in g.columns if c not in ("ev", "bi", "bc")], F.try_divide("n_initial_identified", "n_trained").alias("initial_coverage"), F.col("bi.m").alias("dominant_initial"), F.coalesce("bi.n", zero).alias("dominant_initial_n"), F.try_divide(F.col("bi.n"), F.col("n_initial_identified")).alias("dominant_initial_share"),
        F.try_divide("n_commands_identified", "verified_training_commands").alias("command_coverage"), F.col("bc.m").alias("dominant_command"), F.coalesce("bc.n", zero).alias("dominant_command_n"), F.try_divide(F.col("bc.n"), F.col("n_commands_identified")).alias("dominant_command_share"),
        F.try_divide("verified_training_commands", "n_trained").alias("mean_training_commands"), F.try_divide("ev", "n_trained").alias("mean_evaluation_commands"),
    )


_CELLS = SQL["cell_consistency"]


@query(f"WITH x AS ({_CELLS}) SELECT count(*) AS n_cells, count_if(claude_more_training) AS n_claude_more_training, round(avg(training_gap), 9) AS mean_training_gap, count(training_gap) AS n_gaps FROM x")
def cell_gap_means(s, d):
    """Mean of the cells' gaps (nulls left out) and the number of cells in which the direction holds."""
    return cell_consistency(s, d).agg(F.count("*").alias("n_cells"), F.count_if("claude_more_training").alias("n_claude_more_training"), ninth(F.avg("training_gap")).alias("mean_training_gap"), F.count("training_gap").alias("n_gaps"))
