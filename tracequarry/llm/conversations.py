"""Problem 5: conversations out of message rows, checked by a finite-state automaton.

Rows are merged, roles made uniform, and the automaton is run in ``event_index``
order. A conversation may hold a third of all rows, so it is never collected: the
automaton's transition functions form a monoid under composition. Each block of
``BLOCK`` consecutive positions is folded to one function (four small numbers), the
functions of ``BLOCK`` blocks are folded again, and so on up to the conversation.

Defined results
* rows with a null trajectory_id belong to no conversation and are left out;
* a null or repeated event_index, or a gap, drops the conversation;
* unknown role names are kept, lower-cased, and are neither user nor assistant;
* a call or result without call_id matches nothing, so the conversation is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.ordered import running_sum

BLOCK = 4096
COLUMNS = ["trajectory_id", "event_index", "event_type", "role", "tool_name", "text", "call_id", "lifecycle_status"]
#: Role names of the recorders, by uniform role (fixed values).
ROLES = {
    "user": ["user", "human", "customer", "prompter"],
    "assistant": ["assistant", "ai", "model", "bot", "gpt", "agent"],
    "system": ["system", "developer"],
    "tool": ["tool", "function", "ipython", "environment"],
}
#: Start states: nothing spoken yet, user waiting, answered, broken.
START, WAIT, DONE, BAD = 0, 1, 2, 3
#: Next state from START, WAIT, DONE, BAD for each kind of row.
MOVES = {
    "s": (START, WAIT, DONE, BAD),
    "u": (WAIT, BAD, WAIT, BAD),
    "a": (BAD, DONE, DONE, BAD),
    "o": (BAD, WAIT, DONE, BAD),
}
INVISIBLE = r"[\s\p{Z}\p{C}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{034F}]+"


def visible(text: Column) -> Column:
    """True where a text holds a character a reader sees."""
    return F.coalesce(F.length(F.regexp_replace(text, INVISIBLE, "")) > 0, F.lit(False))


def uniform_role(role: Column) -> Column:
    """user, assistant, system, tool, another lower-case name, or null for a blank role."""
    plain = F.lower(F.regexp_replace(role, INVISIBLE, ""))
    out = F.when(F.length(plain) == 0, F.lit(None).cast("string"))
    for name, names in ROLES.items():
        out = out.when(plain.isin(names), F.lit(name))
    return out.otherwise(plain)


def merged_messages(messages: DataFrame, texts: bool = True) -> DataFrame:
    """Rows equal in all but ingested_at are one row; roles get their uniform name.

    Without texts their hashes stand for them; either way `seen` tells whether a text shows something.
    """
    kept = messages.select(*COLUMNS, visible(F.col("text")).alias("seen")).where("trajectory_id is not null")
    kept = (kept if texts else kept.withColumn("text", F.unhex(F.md5("text")))).distinct()
    return kept.withColumn("speaker", uniform_role(F.col("role")))


def _fold(functions: Column) -> Column:
    """Composition, in order, of an array of transition functions (arrays of four states)."""
    identity = F.array(*[F.lit(i) for i in range(4)])
    return F.aggregate(functions, identity, lambda acc, f: F.transform(acc, lambda state: F.element_at(f, state + 1)))


def _steps(rows: DataFrame) -> Column:
    """The transition function of a row."""
    is_system = _system_row()
    is_result = F.coalesce(F.col("event_type") == "tool_result", F.lit(False))
    kind = (
        F.when(is_system, "s")
        .when(~is_result & (F.col("speaker") == "user"), "u")
        .when(~is_result & (F.col("speaker") == "assistant"), "a")
        .otherwise("o")
    )
    step = F.lit(None)
    for name, moves in MOVES.items():
        step = F.when(kind == name, F.array(*[F.lit(m) for m in moves])).otherwise(step)
    return step


def automaton(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(trajectory_id, f): the whole conversation's function, of rows (trajectory_id, p, f) with unique p."""
    level = steps
    for _ in range(3):  # block ** 3 positions, then one more fold over what is left
        level = (
            level.groupBy("trajectory_id", F.floor(F.col("p") / block).alias("b"))
            .agg(F.array_sort(F.collect_list(F.struct("p", "f"))).alias("xs"))
            .select("trajectory_id", F.col("b").alias("p"), _fold(F.col("xs.f")).alias("f"))
        )
    return level.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("p", "f"))).alias("xs")).select("trajectory_id", _fold(F.col("xs.f")).alias("f"))


def _system_row() -> Column:
    return F.coalesce((F.col("speaker") == "system") | (F.col("event_type") == "system"), F.lit(False))


def _verdicts(rows: DataFrame, block: int) -> DataFrame:
    """One row a conversation with its reasons to drop it (empty: keep)."""
    per_index = rows.groupBy("trajectory_id", "event_index").agg(
        F.count("*").alias("n"),
        F.max(F.col("speaker").isNull()).alias("no_role"),
        F.max(F.col("seen") & ~_system_row()).alias("seen"),
        F.min(_steps(rows)).alias("f"),  # rows that share an index drop the conversation in any case
    )
    shape = per_index.groupBy("trajectory_id").agg(
        F.count("*").alias("n"),
        F.max("n").alias("most"),
        F.min("event_index").alias("low"),
        F.max("event_index").alias("high"),
        F.max(F.col("event_index").isNull()).alias("no_index"),
        F.max("no_role").alias("no_role"),
        F.max("seen").alias("seen"),
    )
    is_call, is_result = F.col("event_type") == "tool_call", F.col("event_type") == "tool_result"
    at = F.col("event_index")
    ids = rows.where(is_call | is_result).withColumn("call_id", F.when(visible(F.col("call_id")), F.col("call_id")))
    matched = ids.groupBy("trajectory_id", "call_id").agg(
        F.min(F.when(is_call, at)).alias("call_low"), F.max(F.when(is_call, at)).alias("call_high"), F.min(F.when(is_result, at)).alias("result_low"), F.max(F.when(is_result, at)).alias("result_high")
    )
    no_id = F.col("call_id").isNull()
    open_call = F.col("call_high").isNotNull() & (no_id | ~F.coalesce(F.col("result_high") > F.col("call_high"), F.lit(False)))
    loose_result = F.col("result_low").isNotNull() & (no_id | ~F.coalesce(F.col("call_low") < F.col("result_low"), F.lit(False)))
    pairs = matched.groupBy("trajectory_id").agg(F.max(open_call).alias("open_call"), F.max(loose_result).alias("loose_result"))
    steps = per_index.where("event_index is not null").select("trajectory_id", F.col("event_index").cast("long").alias("p"), "f")
    all_ = shape.join(automaton(steps, block), "trajectory_id", "left").join(pairs, "trajectory_id", "left")
    end = F.element_at("f", START + 1)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("no_index") | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1), "index_gap"),
            F.when(F.col("most") > 1, "index_clash"),
            F.when(F.col("no_role"), "no_role"),
            F.when(~F.col("seen"), "empty"),
            F.when(~F.coalesce(end == DONE, F.lit(False)), "missing_reply_or_no_user_first"),
            F.when(F.coalesce("open_call", F.lit(False)), "call_without_result"),
            F.when(F.coalesce("loose_result", F.lit(False)), "result_without_call"),
        )
    )
    return all_.select("trajectory_id", F.col("n").alias("n_rows"), reasons.alias("reasons"))


def conversation_verdicts(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(trajectory_id, n_rows, reasons): why each conversation is dropped, if it is."""
    return _verdicts(merged_messages(messages, texts=False), block)


def dropped_conversations(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """p5_found."""
    return conversation_verdicts(messages, block).where(F.size("reasons") > 0).select("trajectory_id")


def conversations(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """The kept conversations as rows in order, with uniform speakers and the number of their turn.

    Rows are range-partitioned and sorted by (trajectory_id, event_index), so files hold
    conversations in order; rows stay rows, as one conversation may be too long for one
    value. Turns are counted by user messages; what comes before the first is turn 0.
    """
    rows = merged_messages(messages)
    kept = conversation_verdicts(messages, block).where(F.size("reasons") == 0).select("trajectory_id")
    own = rows.join(kept, "trajectory_id", "left_semi")
    is_user = ~_system_row() & F.coalesce((F.col("speaker") == "user") & (F.col("event_type") != "tool_result"), F.lit(False))
    turns = running_sum(own.select("trajectory_id", "event_index", is_user.cast("int").alias("u")), ["trajectory_id"], "event_index", {"turn": F.col("u")}, block).drop("u")  # texts stay behind
    out = own.join(turns, ["trajectory_id", "event_index"]).select("trajectory_id", "event_index", "turn", "speaker", "event_type", "tool_name", "call_id", "text")
    return out.repartitionByRange("trajectory_id", "event_index").sortWithinPartitions("trajectory_id", "event_index")
