"""Rule-based labels of commands, scripts, judgements and names.

The patterns below are fixed values: results must equal those of the rule set they
stand for. v1 and v3 are two rule sets that disagree on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequarry.functions.rules import Rule, chain, chain_sql, literal

# ---- fixed values: scripts that a command launches -------------------------------
LAUNCHED = r"(?:python(?:\d(?:\.\d+)?)?|bash|sh)\s+(?:-[a-z]+\s+)*([\w./-]+\.(?:py|sh))"
TRAINING_SCRIPT = r"(?:^|[_./-])(?:train|sft|finetun|fine[-_]?tune|grpo|ppo|dpo|rft)(?:[_./-]|$)"
UTILITY_SCRIPT = r"^(?:prep|prepare|preprocess|build|assemble|combine|convert|generate|filter|sample|check|test|eval|evaluate|merge|inspect)(?:[_-]|$)"
# ---- fixed values: v3 action categories -------------------------------------------
READERS = "ls|cat|sed|grep|rg|find|head|tail|less|pwd|du|wc|stat|file"
LAUNCHER = r"(?:^|[;&|]\s*|['\"]\s*)(?:(?:python(?:\d(?:\.\d+)?)?)\s+(?:[^\n]*\s)?(?:[\w./-]+\.py|[-\w]+)|(?:accelerate\s+launch|torchrun|deepspeed)\s+(?:[^\n]*\s)?[\w./-]+)"
INSPECTS = r"(?:load_dataset|dataset\s*=|--help|help\(|--version|import\s+|from\s+\w+\s+import)"
INLINE = r"(?:python(?:\d(?:\.\d+)?)?)\s+(?:[^\n]*\s)?(?:-c\s|<<[-<]?\s*['\"]?\w+)"
UPDATES = r"(?:trainer\s*\.\s*(?:train|fit)\s*\(|\.fit\s*\(|loss\s*\.\s*backward\s*\(|optimizer\s*\.\s*step\s*\(|accelerator\s*\.\s*backward\s*\()"


def _basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def launched_scripts(command: Column) -> Column:
    """Lower-case basenames of the scripts a command launches, in order (null for null)."""
    return F.transform(F.regexp_extract_all(F.lower(command), F.lit(LAUNCHED), F.lit(1)), _basename)


def launched_scripts_sql(command: str) -> str:
    return f"list_transform(regexp_extract_all(lower({command}), {literal(LAUNCHED)}, 1), lambda s: regexp_replace(s, '^.*/', ''))"


#: Which launches train: a training script that is no utility, or code that updates weights; and no mere look at a script (fixed values).
_TRAINS = (
    lambda low: F.exists(launched_scripts(low), lambda s: s.rlike(TRAINING_SCRIPT) & ~s.rlike(UTILITY_SCRIPT)) | low.rlike(UPDATES),
    f"(len(list_filter({launched_scripts_sql('{x}')}, lambda s: regexp_matches(s, {literal(TRAINING_SCRIPT)}) AND NOT regexp_matches(s, {literal(UTILITY_SCRIPT)}))) > 0 OR regexp_matches({{x}}, {literal(UPDATES)}))",
)
_NOT_JUST_LOOKING = (lambda low: ~low.rlike(INSPECTS) | low.rlike(UPDATES), f"(NOT regexp_matches({{x}}, {literal(INSPECTS)}) OR regexp_matches({{x}}, {literal(UPDATES)}))")


def _both(a, b):
    return (lambda x: a[0](x) & b[0](x), f"({a[1]} AND {b[1]})")


#: Outcome is "category/confidence".
ACTIONS = [
    Rule("debugging/high", (r"\b(?:pkill|killall)\b|(?:^|[;&|]\s*)(?:sudo\s+)?kill\b",)),
    Rule("inspection/high", (r"(?:^|[;&|]\s*)(?:cat|tee|printf|echo)\b[^\n]*<<[-]?\s*['\"]?[a-z0-9_-]+",)),
    Rule("environment_setup/high", (r"\b(?:pip|conda|mamba|poetry)\s+(?:install|add)\b",)),
    Rule("inspection/high", (rf"^(?:/bin/)?(?:bash|sh)\s+-lc\s+['\"]?(?:{READERS})\b",)),
    Rule("inspection/high", (rf"^(?:{READERS}|tree)\b",)),
    Rule("monitoring/high", (r"nvidia-smi|timer\.sh|remaining time|ps aux|watch |tail -f|sleep ",)),
    Rule("monitoring/high", (r"(?:^|[;&|]\s*|['\"]\s*)(?:ps|pgrep|pidof)\b|grep\s+-[a-z]*e[^\n]*python\s+(?:train|eval)",)),
    Rule("debugging/high", ("py_compile|compileall",)),
    Rule("evaluation/medium", (r"(?:evaluate|evaluation|eval\.py|inspect_eval|lm_eval|benchmark|score|pass@\d|accuracy)",), (r"(?:cat|sed|grep|rg|head|tail)\s+[^\n]*(?:evaluate|eval\.py)",)),
    Rule("checkpoint/medium", (r"(?:save_pretrained|save_model|save_checkpoint|merge_adapter|merge_and_unload|merge_lora|checkpoint|final_model)",), (r"(?:ls|find|cat|grep|rg|sed|du)\s+",)),
    Rule("data_preparation/medium", (r"(?:preprocess|prepare_data|prepare-data|convert_data|generate_data|filter_data|sample_data|write.*dataset|save.*dataset)",), ("load_dataset",)),
    Rule("other/high", (INLINE,), (UPDATES,)),
    Rule("training/high", (LAUNCHER,), (), _both(_TRAINS, _NOT_JUST_LOOKING)),
    Rule("debugging/medium", (r"(?:pytest|unittest|debug|traceback|error\.log|kill|pkill)",)),
]


def action(command: Column) -> Column:
    """category/confidence of a command; other/low for none."""
    return chain(ACTIONS, F.lower(F.regexp_replace(command, r"^\s+|\s+$", "")), "other/low")


def action_sql(command: str) -> str:
    return chain_sql(ACTIONS, f"lower(regexp_replace({command}, '^\\s+|\\s+$', '', 'g'))", "other/low")


# ---- fixed values: v3 strategy families ---------------------------------------------
def _bounded(words: str) -> tuple[str, ...]:
    return (rf"(?:^|[\s_/.-])(?:{words})(?:$|[\s_/.-])",)


FAMILIES = [
    Rule("rl", _bounded("grpo|ppo|reinforce|policy[_ -]?gradient|rlhf|reward model|rl trainer")),
    Rule("preference", _bounded("dpo|ipo|kto|preference|pairwise preference")),
    Rule("distillation", _bounded("distill|knowledge distillation|teacher model")),
    Rule("peft_sft", _bounded("lora|qlora|peft|adapter|low[- ]rank")),
    Rule("full_sft", (r"\b(?:sft|supervised fine[- ]?tuning|fine[- ]?tune|finetune|trainer|train\.py)\b",)),
]
UPDATING_FAMILIES = ["full_sft", "peft_sft", "rl", "preference", "distillation"]
BY_CATEGORY = {"data_preparation": "data_prompt_only", "evaluation": "no_parameter_update", "checkpoint": "no_parameter_update", "debugging": "no_parameter_update", "monitoring": "no_parameter_update", "inspection": "no_parameter_update", "other": "no_parameter_update"}


def strategy_family(command: Column, text: Column, category: Column) -> Column:
    """Family by words of command and text, else by the action's category."""
    words = F.lower(F.concat(F.coalesce(command, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    fallback = F.lit("other_unknown")
    for c, family in BY_CATEGORY.items():
        fallback = F.when(category == c, family).otherwise(fallback)
    return F.coalesce(chain(FAMILIES, words, None), fallback)


def strategy_family_sql(command: str, text: str, category: str) -> str:
    cases = " ".join(f"WHEN {category} = '{c}' THEN '{f}'" for c, f in BY_CATEGORY.items())
    words = f"lower(coalesce({command}, '') || ' ' || coalesce({text}, ''))"
    return f"coalesce({chain_sql(FAMILIES, words, None)}, CASE {cases} ELSE 'other_unknown' END)"


# ---- fixed values: v3 objectives ------------------------------------------------------
_DISTILLS = r"(?s)(?:gkdtrainer|on[_ -]?policy.{0,30}distill|teacher.{0,160}(?:student|logits).{0,160}(?:kl[_ -]?div|js[_ -]?div|logit[_ -]?matching)|(?:kl[_ -]?div|js[_ -]?div).{0,160}(?:teacher|student))"
_PREFERS = r"(?s)(?:dpotrainer|ipotrainer|kto.?trainer|orpotrainer|cpo.?trainer|simpo|(?:chosen|rejected).{0,120}(?:log.?ratio|preference).{0,120}loss)"
_REWARDS = r"(?:grpotrainer|ppotrainer|rlootrainer|\breinforce\s*\(|policy[_ -]?gradient|reward[_ -]?funcs?\s*=|reward[_ -]?function\s*=|compute[_ -]?reward\s*\(|policy[_ -]?loss\s*=)"
_SUPERVISES = r"(?s)(?:sfttrainer|crossentropyloss|cross_entropy|data_collatorforlanguagemodeling|supervised fine|causal.?lm.{0,120}labels)"
_LABELS = (r"\btrainer\s*\(", r"\b(?:labels|datacollatorforseq2seq|datacollatorforlanguagemodeling)\b")
#: Form of each signature; a signature decides whether an objective changed.
FORM = {"on_policy_distillation": "on_policy_distillation", "preference_dpo": "preference_optimization", "preference_other": "preference_optimization", "reward_grpo": "reward_optimization", "reward_ppo": "reward_optimization", "reward_rloo": "reward_optimization", "reward_other": "reward_optimization", "supervised_likelihood": "supervised_likelihood", "objective_unknown": "objective_unknown"}
_names = lambda words: rf"(?:^|[_-])(?:{words})(?:[_-]|\.)"

CODE_OBJECTIVES = [Rule("distillation", (_DISTILLS,)), Rule("preference", (_PREFERS,)), Rule("reward", (_REWARDS,)), Rule("supervised_likelihood", (_SUPERVISES,)), Rule("supervised_likelihood", _LABELS)]
NAME_OBJECTIVES = [Rule("reward", (_names("grpo|ppo|rloo|reinforce"),)), Rule("preference", (_names("dpo|ipo|kto|orpo|cpo|simpo"),)), Rule("distillation", (_names("gkd|opd|distill"),)), Rule("supervised_likelihood", (_names("sft|finetune|fine_tune"),))]


def objective(command: Column, script: Column) -> Column:
    """struct(form, signature, confidence): by the script's code, else by its name."""
    code = F.lower(F.coalesce(script, F.lit("")))
    names = F.array_join(F.coalesce(launched_scripts(command), F.array().cast("array<string>")), " ")
    by_code, by_name = chain(CODE_OBJECTIVES, code, None), chain(NAME_OBJECTIVES, names, None)
    found = lambda word: code.contains(word) | names.contains(word)
    signature = (
        F.when(by_code == "distillation", "on_policy_distillation")
        .when(by_code == "preference", F.when(code.contains("dpotrainer") | names.contains("dpo"), "preference_dpo").otherwise("preference_other"))
        .when(by_code == "reward", F.when(found("grpo"), "reward_grpo").when(found("ppo"), "reward_ppo").when(found("rloo"), "reward_rloo").otherwise("reward_other"))
        .when(by_code.isNotNull(), by_code)
        .when(by_name == "distillation", "on_policy_distillation")
        .when(by_name == "preference", F.when(names.contains("dpo"), "preference_dpo").otherwise("preference_other"))
        .when(by_name == "reward", F.when(names.contains("grpo"), "reward_grpo").when(names.contains("ppo"), "reward_ppo").otherwise("reward_other"))
        .when(by_name.isNotNull(), by_name)
        .otherwise("objective_unknown")
    )
    confidence = F.when(by_code.isNotNull(), "high").when(by_name.isNotNull(), "medium").otherwise("none")
    form = F.create_map(*[F.lit(x) for p in FORM.items() for x in p])[signature]
    return F.struct(form.alias("form"), signature.alias("signature"), confidence.alias("confidence"))


def name_signature_sql(command: str) -> str:
    """The signature by script name alone."""
    names = f"array_to_string({launched_scripts_sql(command)}, ' ')"
    kind = chain_sql(NAME_OBJECTIVES, names, None)
    return f"""CASE {kind} WHEN 'distillation' THEN 'on_policy_distillation' WHEN 'supervised_likelihood' THEN 'supervised_likelihood'
        WHEN 'preference' THEN CASE WHEN contains({names}, 'dpo') THEN 'preference_dpo' ELSE 'preference_other' END
        WHEN 'reward' THEN CASE WHEN contains({names}, 'grpo') THEN 'reward_grpo' WHEN contains({names}, 'ppo') THEN 'reward_ppo' ELSE 'reward_other' END
        ELSE 'objective_unknown' END"""


def objective_signature_sql(command: str, script: str) -> str:
    """The signature by code, else by script name."""
    names = f"array_to_string({launched_scripts_sql(command)}, ' ')"
    code = f"lower(coalesce({script}, ''))"
    found = lambda w: f"(contains({code}, '{w}') OR coalesce(contains({names}, '{w}'), false))"
    return f"""CASE {chain_sql(CODE_OBJECTIVES, code, None)} WHEN 'distillation' THEN 'on_policy_distillation'
        WHEN 'preference' THEN CASE WHEN contains({code}, 'dpotrainer') OR coalesce(contains({names}, 'dpo'), false) THEN 'preference_dpo' ELSE 'preference_other' END
        WHEN 'reward' THEN CASE WHEN {found('grpo')} THEN 'reward_grpo' WHEN {found('ppo')} THEN 'reward_ppo' WHEN {found('rloo')} THEN 'reward_rloo' ELSE 'reward_other' END
        WHEN 'supervised_likelihood' THEN 'supervised_likelihood' ELSE {name_signature_sql(command)} END"""


def objective_confidence_sql(command: str, script: str) -> str:
    names = f"array_to_string({launched_scripts_sql(command)}, ' ')"
    code = f"lower(coalesce({script}, ''))"
    return f"CASE WHEN {chain_sql(CODE_OBJECTIVES, code, None)} IS NOT NULL THEN 'high' WHEN {chain_sql(NAME_OBJECTIVES, names, None)} IS NOT NULL THEN 'medium' ELSE 'none' END"


def form_sql(signature: str) -> str:
    return f"CASE {signature} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORM.items()) + " END"


# ---- fixed values: where data and weights come from -------------------------------------
SELF_MADE = r"(?i)(?:rejection[_\- ]?(?:sampl|filter)|best[_\- ]?of[_\- ]?n|self[_\- ]?(?:instruct|gen|generated|distill)|synthetic[_\- ]?(?:data|examples|dataset)|model[_\- ]?generated|generated[_\- ]?(?:data|dataset|solutions|responses|samples|completions)|teacher[_\- ]?(?:gen|generated|output|response|data)|distill(?:ation)?[_\- ]?(?:data|dataset)|rft[_\- ]?data|star[_\- ]?data|sampled[_\- ]?(?:solutions|responses|completions|answers)|correct[_\- ]?(?:samples|generations|solutions)\.(?:jsonl|json|parquet))"
GENERATES = r"(?i)(?:vllm|sglang|\.generate\s*\(|generate_(?:data|solutions|responses|samples)|sample_(?:solutions|responses|completions)|do_sample\s*=\s*True|best_of)"
CURATED = r"(?i)(?:load_dataset\s*\(\s*['\"](?:openai/)?(?:gsm8k|mbpp|codesearchnet|humaneval|open-?r1|openmathinstruct|metamath|math|nvidia|allenai|huggingfaceh4|tulu|ultrafeedback|codeparrot|bigcode|sahil2801|iamtarun|nickrosh|evol|alpaca|dolly|oasst)|--dataset[_\- ]?(?:name|path)?\s+\S*(?:gsm8k|mbpp|math|alpaca|codealpaca|evol|oasst)|datasets\.load_dataset|hf[_\- ]?hub[_\- ]?download|huggingface\.co/datasets|wget\s+\S+\.(?:jsonl|json|parquet|zip|tar)|snapshot_download)"
DATA_FILE = r"(?i)([\w./-]{3,120}\.(?:jsonl|parquet|json|csv)\b)"
NO_DATA_FILE = r"(?i)(?:config|tokenizer|generation_config|adapter|special_tokens|vocab|merges|metrics|results?|eval[\w-]*|manifest|package|settings)[\w.-]*\.json$"
WEIGHTS = r"(?i)(?:--model(?:_name_or_path|_path)?|--base_model|from_pretrained\s*\(|--resume_from_checkpoint|resume_from_checkpoint\s*=)\s*[\('\"=]*\s*([\w./~-]+)"
WEIGHTS_BASE = r"(?i)(?:qwen[\w./-]*(?:1\.7b|4b)[\w.-]*(?:base)?|smollm3[\w.-]*|gemma-3-4b[\w.-]*)"
WEIGHTS_SAVED = r"(?i)(?:output|checkpoint|ckpt|merged|final|save|_v\d|stage|run\d|global_step|epoch)"


def data_files(text: Column) -> Column:
    """Distinct data files that a text names, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(DATA_FILE), F.lit(1)), lambda f: ~f.rlike(NO_DATA_FILE))))


def data_files_sql(text: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({text}, {literal(DATA_FILE)}, 1), lambda f: NOT regexp_matches(f, {literal(NO_DATA_FILE)}))))"


def provenance_mark(text: Column) -> Column:
    """self, curated or null: what a text says of the data files it names."""
    return F.when(text.rlike(GENERATES) | text.rlike(SELF_MADE), "self").when(text.rlike(CURATED), "curated")


def provenance_mark_sql(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, {literal(GENERATES)}) OR regexp_matches({text}, {literal(SELF_MADE)}) THEN 'self' WHEN regexp_matches({text}, {literal(CURATED)}) THEN 'curated' END"


def init_source(text: Column) -> Column:
    """base, checkpoint or unknown, by the first path that tells."""
    paths = F.filter(F.regexp_extract_all(text, F.lit(WEIGHTS), F.lit(1)), lambda p: (p != "") & ~p.startswith("--") & (p.rlike(WEIGHTS_BASE) | p.rlike(WEIGHTS_SAVED)))
    first = F.try_element_at(paths, F.lit(1))
    return F.when(first.rlike(WEIGHTS_SAVED), "checkpoint").when(first.isNotNull(), "base").otherwise("unknown")


def init_source_sql(text: str) -> str:
    first = f"list_filter(regexp_extract_all({text}, {literal(WEIGHTS)}, 1), lambda p: p <> '' AND NOT starts_with(p, '--') AND (regexp_matches(p, {literal(WEIGHTS_BASE)}) OR regexp_matches(p, {literal(WEIGHTS_SAVED)})))[1]"
    return f"CASE WHEN regexp_matches({first}, {literal(WEIGHTS_SAVED)}) THEN 'checkpoint' WHEN {first} IS NOT NULL THEN 'base' ELSE 'unknown' END"


def data_source(form: Column, script: Column, has_self: Column, has_curated: Column) -> Column:
    """on_policy_inherent, not_applicable, mixed, self_generated, curated or unknown.

    has_self, has_curated: what the marks of the script's data files say.
    """
    text = F.coalesce(script, F.lit(""))
    own = F.exists(data_files(text), lambda f: f.rlike(SELF_MADE)) | text.rlike(SELF_MADE) | has_self
    curated = text.rlike(CURATED) | has_curated
    return (
        F.when(form.isin("reward_optimization", "on_policy_distillation"), "on_policy_inherent")
        .when(~form.isin("supervised_likelihood", "preference_optimization"), "not_applicable")
        .when(own & curated, "mixed").when(own, "self_generated").when(curated, "curated").otherwise("unknown")
    )


def data_source_sql(form: str, script: str, has_self: str, has_curated: str) -> str:
    text = f"coalesce({script}, '')"
    own = f"(len(list_filter({data_files_sql(text)}, lambda f: regexp_matches(f, {literal(SELF_MADE)}))) > 0 OR regexp_matches({text}, {literal(SELF_MADE)}) OR {has_self})"
    curated = f"(regexp_matches({text}, {literal(CURATED)}) OR {has_curated})"
    return f"""CASE WHEN {form} IN ('reward_optimization', 'on_policy_distillation') THEN 'on_policy_inherent' WHEN {form} NOT IN ('supervised_likelihood', 'preference_optimization') THEN 'not_applicable'
        WHEN {own} AND {curated} THEN 'mixed' WHEN {own} THEN 'self_generated' WHEN {curated} THEN 'curated' ELSE 'unknown' END"""


# ---- fixed values: v1 commands ---------------------------------------------------------
V1_TRAIN = r"(?i)(?:train|finetun|fine[-_ ]?tune|sft|grpo|ppo|dpo|rlhf|preference|accelerate\s+launch|torchrun|deepspeed)"
V1_EVAL = r"(?i)(?:evaluate|evaluation|eval\.py|run_eval|score|lm_eval)"
V1_CHECKPOINT = r"(?i)(?:checkpoint|save_pretrained|save_model|merge_model|model_path|final_model)"
V1_LAUNCH = r"(?i)\b(?:python(?:\d*(?:\.\d+)?)?|accelerate|torchrun|deepspeed|bash|sh)\b|(?:^|\s)\./"
V1_METHODS = [
    Rule("rl", (r"\b(grpo|ppo|rlhf|reinforce|reward|rl)\b",)),
    Rule("preference_optimization", (r"\b(dpo|preference|orpo)\b",)),
    Rule("distillation", (r"\b(distill|distillation)\b",)),
    Rule("sft", (r"\b(sft|supervised|fine[-_ ]?tune|finetune)\b|(?:^|[ /_-])train(?:\.py)?(?:$|[ /_-])",)),
]
V1_PEFT = r"\b(lora|qlora|peft|adapter)\b"
V1_DATA = [Rule("synthetic_or_self_generated", (r"synthetic|self[-_ ]?generated|generate.*data",)), Rule("preference_pairs", ("preference|chosen|rejected",)), Rule("benchmark_or_task", ("benchmark|gsm8k|humaneval|aime|gpqa|bfcl",))]
V1_OBJECTIVES = [Rule("reward_or_verifier", (r"reward|grpo|ppo|rlhf|exact[_ -]?match|verifier",)), Rule("preference_objective", ("dpo|preference|chosen|rejected",))]


def v1_command(command: Column, script: Column) -> Column:
    """struct(training, evaluation, checkpoint, method, update, data, objective) of the first-stage rules."""
    source = F.concat_ws(" ", F.when(command != "", command), script)
    low = F.lower(source)
    launch = F.coalesce(command == "", F.lit(True)) | command.rlike(V1_LAUNCH)
    training = source.rlike(V1_TRAIN) & launch
    evaluation = source.rlike(V1_EVAL) & launch & ~training
    method = F.coalesce(chain(V1_METHODS, low, None), F.when(evaluation, "evaluation").when(training, "other_training").otherwise("other"))
    return F.struct(
        training.alias("training"), evaluation.alias("evaluation"), (source.rlike(V1_CHECKPOINT) & launch).alias("checkpoint"), method.alias("method"),
        F.when(low.rlike(V1_PEFT), "LoRA/PEFT").when(training, "full_or_unspecified").alias("update"),
        F.coalesce(chain(V1_DATA, low, None), F.when(training, "unspecified")).alias("data"),
        F.coalesce(chain(V1_OBJECTIVES, low, None), F.when(training, "language_modeling_or_unspecified")).alias("objective"),
    )


def v1_command_sql(command: str) -> str:
    """SELECT items for a command without a script."""
    src = f"coalesce({command}, '')"
    low = f"lower({src})"
    m = lambda x, p: f"regexp_matches({x}, {literal(p)})"
    launch = f"({src} = '' OR {m(src, V1_LAUNCH)})"
    training = f"({m(src, V1_TRAIN)} AND {launch})"
    evaluation = f"({m(src, V1_EVAL)} AND {launch} AND NOT {training})"
    return f"""{training} AS training, {evaluation} AS evaluation, ({m(src, V1_CHECKPOINT)} AND {launch}) AS checkpoint,
      coalesce({chain_sql(V1_METHODS, low, None)}, CASE WHEN {evaluation} THEN 'evaluation' WHEN {training} THEN 'other_training' ELSE 'other' END) AS method,
      CASE WHEN {m(low, V1_PEFT)} THEN 'LoRA/PEFT' WHEN {training} THEN 'full_or_unspecified' END AS update,
      coalesce({chain_sql(V1_DATA, low, None)}, CASE WHEN {training} THEN 'unspecified' END) AS data,
      coalesce({chain_sql(V1_OBJECTIVES, low, None)}, CASE WHEN {training} THEN 'language_modeling_or_unspecified' END) AS objective"""


# ---- fixed values: judgements ------------------------------------------------------------
V3_CLEAN = ["no contamination detected", "no contamination", "only allowed use detected", "no disallowed model detected", "no disallowed use detected", "clean", "not detected", "not found", "false", "pass"]
V3_FLAGGED = ["contamination detected", "disallowed model detected", "disallowed use detected", "violation detected", "unsafe", "flagged", "true", "yes", "fail"]
V1_CLEAN = {"contamination": ["no contamination", "not contaminated", "contamination not detected", '"contamination": false', "clean"], "disallowed": ["only allowed", "no disallowed", "no prohibited", "not used", '"disallowed": false', "clean"]}
V1_FLAGGED = ["flagged", "contamination detected", "contaminated", "disallowed model detected", "prohibited model", '"contamination": true', '"disallowed": true']


def _any(low: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def _any_sql(low: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {literal(p)})" for p in phrases) + ")"


def judgement_v3(text: Column) -> Column:
    """clean wins over flagged; null is missing."""
    low = F.lower(text)
    return F.when(text.isNull(), "missing").when(_any(low, V3_CLEAN), "clean").when(_any(low, V3_FLAGGED), "flagged").otherwise("unknown")


def judgement_v1(text: Column, kind: str) -> Column:
    """Placeholders are unknown; then clean, then flagged; null or empty is missing."""
    low = F.lower(text)
    absent = low.contains("not produced") | (low.contains("judgement.txt") & low.contains("produced") & low.contains("no "))
    return F.when(text.isNull() | (text == ""), "missing").when(absent, "unknown").when(_any(low, V1_CLEAN[kind]), "clean").when(_any(low, V1_FLAGGED), "flagged").otherwise("unknown")


def judgement_v3_sql(text: str) -> str:
    low = f"lower({text})"
    return f"CASE WHEN {text} IS NULL THEN 'missing' WHEN {_any_sql(low, V3_CLEAN)} THEN 'clean' WHEN {_any_sql(low, V3_FLAGGED)} THEN 'flagged' ELSE 'unknown' END"


def judgement_v1_sql(text: str, kind: str) -> str:
    low = f"lower({text})"
    absent = f"(contains({low}, 'not produced') OR (contains({low}, 'judgement.txt') AND contains({low}, 'produced') AND contains({low}, 'no ')))"
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN 'missing' WHEN {absent} THEN 'unknown' WHEN {_any_sql(low, V1_CLEAN[kind])} THEN 'clean' WHEN {_any_sql(low, V1_FLAGGED)} THEN 'flagged' ELSE 'unknown' END"


# ---- fixed values: names of tasks and batches -------------------------------------------
BENCHMARKS = {"aime2025": "AIME 2025", "aime": "AIME 2025", "arenahardwriting": "ArenaHardWriting", "bfcl": "BFCL", "gpqamain": "GPQA Main", "gpqa": "GPQA Main", "gsm8k": "GSM8K", "healthbench": "HealthBench", "humaneval": "HumanEval"}
BASE_MODELS = {"qwen3-1.7b-base": "Qwen3-1.7B-Base", "qwen3-4b-base": "Qwen3-4B-Base", "smollm3-3b-base": "SmolLM3-3B-Base", "gemma-3-4b-pt": "Gemma-3-4B-PT"}
FAMILY_WORDS = {"claude": "claude", "codex": "codex", "opencode": "other", "glmx": "other"}
AGENT_WORDS = ["claude-opus-4-8", "claude-opus-4-7", "claude-opus-4-6", "claude-sonnet-4-6", "gpt-5.5", "gpt-5.4", "gpt-5.3-codex", "gemini-3.1-pro", "glm-5.2-preview"]
MODE_WORDS = ["xhigh", "high", "medium", "low", "1m"]
HARNESSES = {"claude_": "Claude", "codex_": "Codex", "opencode_": "OpenCode", "glmx_": "GLM-X", "qwen3max_": "Qwen3Max"}
V3_AGENTS = {
    "claude-opus-4-8": "Claude Opus 4.8", "claude-opus-4-7": "Claude Opus 4.7", "claude-opus-4-6": "Claude Opus 4.6", "claude-opus-4-5": "Claude Opus 4.5",
    "claude-sonnet-4-6": "Claude Sonnet 4.6", "fable-5": "Claude Fable 5", "gpt-5.5": "GPT-5.5 Codex", "gpt-5.4": "GPT-5.4 Codex", "gpt-5.3-codex": "GPT-5.3 Codex",
    "gemini-3.1-pro": "Gemini 3.1 Pro", "gemini-3-pro": "Gemini 3 Pro", "glm-5.2-preview": "GLM-5.2 Preview", "zai_glm-5": "GLM-5", "gpt-5.1-codex-max": "GPT-5.1 Codex Max",
    "kimi-k2.5": "Kimi K2.5", "kimi-k2-thinking": "Kimi K2 Thinking", "minimax-m2.5": "MiniMax M2.5", "minimax-m2.1": "MiniMax M2.1", "glm-4.7": "GLM-4.7", "qwen3-max": "Qwen3 Max",
}
V3_MODELS = {"qwen3-1.7b": "Qwen3-1.7B-Base", "qwen3-4b": "Qwen3-4B-Base", "smollm3": "SmolLM3-3B-Base", "gemma-3-4b": "Gemma-3-4B-PT"}


def _first_word(low: Column, words: dict[str, str], default: Column | None = None, prefix: bool = False) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for w, label in words.items():
        out = out.when(low.startswith(w) if prefix else low.contains(w), label)
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def _first_word_sql(low: str, words: dict[str, str], default: str = "NULL", prefix: bool = False) -> str:
    test = "starts_with" if prefix else "contains"
    return "CASE " + " ".join(f"WHEN {test}({low}, {literal(w)}) THEN {literal(v)}" for w, v in words.items()) + f" ELSE {default} END"


def task_name(name: Column) -> Column:
    """struct(benchmark, base_model, run_replicate, reasons); an unknown benchmark keeps its raw name."""
    raw = F.split_part(name, F.lit("_"), F.lit(1))
    known = F.create_map(*[F.lit(x) for p in BENCHMARKS.items() for x in p])[F.lower(raw)]
    model = _first_word(F.replace(F.lower(name), F.lit(" "), F.lit("")), BASE_MODELS)
    job = F.nullif(F.regexp_extract(name, r"(?:^|_)(\d{5,})(?:$|_)", 1), F.lit(""))
    reasons = F.array_compact(F.array(F.when(known.isNull(), "unrecognized_benchmark"), F.when(model.isNull(), "unrecognized_base_model")))
    return F.struct(F.coalesce(known, F.nullif(raw, F.lit(""))).alias("benchmark"), model.alias("base_model"), job.alias("run_replicate"), reasons.alias("reasons"))


def batch_name(name: Column) -> Column:
    """struct(family, agent_model, mode, budget_hours), by words in a fixed order."""
    low = F.lower(name)
    own = lambda words: {w: w for w in words}
    budget = F.nullif(F.regexp_extract(low, r"(?:^|_)(\d+)h(?:_|$)", 1), F.lit("")).cast("int")
    return F.struct(_first_word(low, FAMILY_WORDS, F.lit("unknown")).alias("family"), _first_word(low, own(AGENT_WORDS)).alias("agent_model"), _first_word(low, own(MODE_WORDS)).alias("mode"), budget.alias("budget_hours"))


def harness(batch: Column) -> Column:
    return _first_word(F.lower(batch), HARNESSES, F.lit("Unknown"), prefix=True)


def agent(batch: Column) -> Column:
    return _first_word(F.lower(batch), V3_AGENTS, F.lit("Unknown"))


def run_label(batch: Column) -> Column:
    run = F.nullif(F.regexp_extract(F.lower(batch), r"(?:^|_)(run\d+)(?:_|$)", 1), F.lit(""))
    return F.coalesce(run, F.when(F.lower(batch).contains("reprompt"), "reprompt").otherwise("single"))


def canonical_model(name: Column) -> Column:
    return F.when(name != "", _first_word(F.replace(F.lower(name), F.lit(" "), F.lit("")), V3_MODELS, name))
