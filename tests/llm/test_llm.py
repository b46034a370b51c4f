"""Operators for training text: brute force, exact round trips, held-out accuracy, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.llm import conversations, leakage, lookalikes, mojibake, packing, runs, tokens, truncation

EVENT = "trajectory_id string, event_index int, source_format string, command string, command_output string, text string, file_content string, row int, item_id int, field string, score double"


def events(spark, rows):
    """Rows as dicts; columns of clashing names are always there."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVENT)


# ---- 1 -----------------------------------------------------------------------------------
ITEM = "In Mafenmawick a gardener keeps 503 baskets in 19 equal carts. Every fortnight Dorsel adds 5 ribbons to the 7 drawers at Jopellinholm. Find the number of sacks."
OTHER = "There are 616 pale bricks on the pier at Samerlawick and Botazu counts 17 of them per season. How many ribbons does Hagri hold after 3 mornings in all?"


def items(spark):
    return spark.createDataFrame([(1, ITEM), (1, ITEM), (2, OTHER), (3, "short one"), (4, None), (None, OTHER), (5, "")], "item_id long, text string")


def test_leaks_in_any_dress(spark):
    part = " ".join(ITEM.split()[3:18])
    dressed = '# ' + ITEM.upper().replace(". ", ".\n# ")
    nested = "echo '" + ITEM.replace(" ", "\\\\n", 3).replace(" ", "\\u0020", 2) + "'"
    rows = [
        {"trajectory_id": "t", "event_index": 0, "file_content": ITEM}, {"trajectory_id": "t", "event_index": 0, "file_content": ITEM},
        {"trajectory_id": "t", "event_index": 1, "command": f'{{"q": "{part}"}}'}, {"trajectory_id": "t", "event_index": 2, "file_content": dressed}, {"trajectory_id": "t", "event_index": 3, "command": nested},
        {"trajectory_id": "t", "event_index": 4, "file_content": ITEM.replace("503", "504").replace("ribbons", "ropes")}, {"trajectory_id": "t", "event_index": 5}, {"trajectory_id": "t", "event_index": 6, "command": ""},
        {"trajectory_id": "t", "event_index": 7, "file_content": "pad " * 50_000 + OTHER + ITEM}, {"trajectory_id": "t", "event_index": 8, "file_content": " ".join(ITEM.split()[3:16])},
    ]
    df = events(spark, rows)
    want = {("t", 0, 1), ("t", 1, 1), ("t", 2, 1), ("t", 3, 1), ("t", 7, 1), ("t", 7, 2)}
    assert {tuple(r) for r in leakage.leaked_items(df, items(spark)).collect()} == want
    each = [leakage.leaked_items(df, items(spark).where(f"item_id = {i}")).collect() for i in (1, 2)]
    assert {tuple(r) for rows in each for r in rows} == want  # it does not matter which items come together
    assert leakage.leaked_items(df, items(spark).where("item_id > 9")).count() == 0
    assert leakage.leaked_items(df.where("event_index > 99"), items(spark)).count() == 0


def test_leaks_meet_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(6)] + ["7", "12"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(30))) for i in range(5)]
    rows = []
    for e in range(40):
        body = [rnd.choice(words) for _ in range(60)]
        if e % 2:
            own = texts[e % 5][1].split()
            n, at = rnd.randint(10, 20), rnd.randint(0, 8)
            body[20 : 20 + n] = own[at : at + n]
        rows.append({"trajectory_id": "t", "event_index": e, "file_content": " ".join(body)})
    want = set()
    for r in rows:
        w = r["file_content"].split()
        for i, t in texts:
            own = t.split()
            if {tuple(w[k : k + 14]) for k in range(len(w) - 13)} & {tuple(own[k : k + 14]) for k in range(len(own) - 13)}:
                want.add(("t", r["event_index"], i))
    got = leakage.leaked_items(events(spark, rows), spark.createDataFrame(texts, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want and want


def test_reparameterised_questions(spark):
    other = ITEM.replace("503", "77").replace("19", "4").replace("Mafenmawick", "Zelltown").replace("Dorsel", "Anke")
    broken = ITEM.replace("503", "5")  # two slots of the item would share one value: no one-to-one map
    twice = other + " And now " + other.replace("77", "78").replace("Anke", "Lou")
    df = events(spark, [{"trajectory_id": "t", "event_index": 0, "file_content": "x " + other}, {"trajectory_id": "t", "event_index": 1, "command": broken}, {"trajectory_id": "t", "event_index": 2, "command": ITEM}, {"trajectory_id": "t", "event_index": 3, "command": twice}])
    got = leakage.reparameterised_items(df, items(spark)).orderBy("event_index").collect()
    assert [(r.event_index, r.item_id, r.field, r.first_token, r.n_changed) for r in got] == [(0, 1, "file_content", 1, 4), (3, 1, "command", 0, 4)]
    assert leakage.reparameterised_items(df, items(spark).where("item_id > 9")).count() == 0 and leakage.reparameterised_items(df.where("event_index > 9"), items(spark)).count() == 0


def questions(n):
    """Items of words of their own, and each with other names, numbers and units: whole, in part, with a word more or less."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3))
    out = []
    for i in range(n):
        w = [word() for _ in range(30)]
        shape = f"{{A}} {' '.join(w[:6])} {{x}} {w[6]} for {{y}} {{u}} in {{B}}. {{C}} {' '.join(w[7:12])} the {w[12]} with {{z}} {' '.join(w[13:19])}. How many {' '.join(w[19:25])} does {{A}} keep {w[25]} {{x}} {w[26]}?"
        fill = lambda k: dict(zip("ABCxyzu", [word().title(), word().title(), word().title(), *rnd.sample(range(3, 999), 2), f"{k}.5" if k else "4", ("dollars", "euros")[k]]))
        item, other = shape.format(**fill(0)), shape.format(**fill(1))
        ws = other.split()
        out.append((item, [other, " ".join(ws[9:]), " ".join(ws[:-8]), " ".join(ws[:20] + ws[21:]), " ".join(ws[:16] + ["well"] + ws[16:])][i % 5]))
    return out


def test_reparameterised_questions_are_recalled(spark):
    own = questions(60) + [("On friday Mark and rose will mark the rows that sam, or nora, left behind in the old red barn.", "Nothing of that kind stands here at all, on no friday, and nobody ever wrote it down.")]
    df = events(spark, [{"trajectory_id": "t", "event_index": i, "file_content": f"# {i}\nprompt = '{other}'"} for i, (_, other) in enumerate(own)])
    all_items = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(own)], "item_id long, text string")
    got = {(r.event_index, r.item_id) for r in leakage.reparameterised_items(df, all_items).collect()}
    assert all(a == b for a, b in got) and len(got) >= 0.9 * 60
    for part in (all_items.where("item_id = 7"), all_items.where("item_id in (7, 60)")):
        assert {(r.event_index, r.item_id) for r in leakage.reparameterised_items(df, part).collect()} == got & {(7, 7)}
    copies = events(spark, [{"trajectory_id": "t", "event_index": i, "command": " ".join(item.split()[i % 9 : 30 + i % 9])} for i, (item, _) in enumerate(own[:60])])
    found = {(r.event_index, r.item_id) for r in leakage.leaked_items(copies, all_items).collect()}
    assert found == {(i, i) for i in range(60)}
    assert leakage.reparameterised_items(copies, all_items).count() == 0


def test_types_do_not_depend_on_how_many_words_the_items_have(spark):
    """A word's type stays what it is beside 210,000 more openers of sentences."""
    lower = (6, "first in line we find every one.")
    own = items(spark).union(spark.createDataFrame([lower], "item_id long, text string"))
    n = 210_000
    word = F.concat(F.lit("pad"), F.col("id"))
    pads = spark.range(n).select((F.col("id") / 10).cast("long").alias("p"), F.concat(F.initcap(word), F.lit(" "), word, F.lit(". ")).alias("t"))
    many = own.union(pads.groupBy((F.col("p") + 100).alias("item_id")).agg(F.concat_ws("", F.collect_list("t")).alias("text")))
    other = ITEM.replace("503", "77").replace("Dorsel", "Anke").replace("Every", "every").replace("Find", "find")
    openers = ITEM.replace("Every", "Each").replace("Find", "Write")  # other words, no other values
    df = events(spark, [{"trajectory_id": "t", "event_index": 0, "file_content": other}, {"trajectory_id": "t", "event_index": 1, "file_content": openers}, {"trajectory_id": "t", "event_index": 2, "command": ITEM}])
    few, all_ = ({tuple(r) for r in leakage.reparameterised_items(df, i).collect()} for i in (own, many))
    assert few == all_ and {r[1] for r in few} == {0}
    assert {tuple(r) for r in leakage.leaked_items(df, many).collect()} == {tuple(r) for r in leakage.leaked_items(df, own).collect()} >= {("t", 2, 1)}
    types = leakage.lexicon(many)
    assert all(f"pad{i}" in types.openers for i in range(0, n, 1000)) and "find" in types.openers and "mafenmawick" in types.names
    assert not any(w in types.openers or w in types.names for w in ("baskets", "pad", "pad-1", "")) and "mafenmawick" not in types.openers
    none = leakage.lexicon(own.where("item_id > 99"))
    assert "find" not in none.openers and "find" not in none.names


def test_escapes_before_hexadecimal_letters():
    assert leakage.words(r"he\u0027d \u201cBut, \u2014and \u003cbr \\u00e9cole") == "he d but and br cole".split()
    assert leakage.words(r"\u{41}b \u{1F600}deed \U0001F600face \U00000041b \u00415 \x41b \101b") == "ab deed face ab a5 ab ab".split()


# ---- 2 -----------------------------------------------------------------------------------
CLEAN = ["Größe: {} · Länge: {} · Prüfung läuft", "La série {} a dépassé le modèle après {} étapes, c'était déjà prévu.", "Запуск {} дошёл до шага {}, точность составила.", "运行 {} 在第 {} 步达到准确率。", "学習率を {} に下げても損失は {} 変わらなかった。", "• {} – “clean” … costs €{}", "Não há memória suficiente para {} com {} avaliação."]


def garbled_corpus(spark):
    rnd = random.Random(5)
    rows, want = [], set()
    chains = [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp437"),), (("utf-8", "cp1252"),) * 2, (("cp1251", "latin-1"),), (("koi8_r", "cp1251"),), (("cp1252", "mac_roman"),)]
    for i in range(420):
        line = CLEAN[i % len(CLEAN)].format(f"run{rnd.randint(1, 99)}", rnd.randint(1, 999))
        bad = mojibake.garble(line, chains[i % 13]) if i % 13 < len(chains) else None
        rows.append({"trajectory_id": "t", "event_index": i, "command_output": f"step {i}\n{bad or line}\nok", "text": line})
        if bad and bad != line:
            want.add(("t", i, "command_output"))
    return rows, want


def test_wrong_encodings(spark):
    rows, want = garbled_corpus(spark)
    extra = [{"trajectory_id": "t", "event_index": 900, "file_content": "cut in a letter �"}, {"trajectory_id": "t", "event_index": 901, "file_content": ""}, {"trajectory_id": "t", "event_index": 902}, rows[0]]
    df = events(spark, rows + extra)
    model = mojibake.train(df)
    got = {tuple(r) for r in mojibake.garbled_values(df, model).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    clean = {r["event_index"]: f"step {r['event_index']}\n{r['text']}\nok" for r in rows}
    back = [r for r in mojibake.restored_values(df, model).collect() if r.lines_lost == 0]
    assert np.mean([r.restored == clean[r.event_index] for r in back]) >= 0.95
    assert mojibake.garbled_values(df.where("event_index < 0")).count() == 0


@pytest.mark.parametrize("chain", [(("utf-8", "cp1252"),), (("utf-8", "mac_roman"),), (("utf-8", "latin-1"),) * 3, (("cp932", "latin-1"),)])
def test_inversion_is_exact(chain):
    for line in CLEAN:
        bad = mojibake.garble(line, chain, "keep")
        if bad and mojibake.LOST not in bad:
            assert mojibake.invert(bad, chain) == line


def test_every_likely_chain_is_tried():
    model = mojibake.Model.train([(line, 9) for line in CLEAN])
    bad = mojibake.garble(CLEAN[0], (("utf-8", "cp1252"),))
    model.classes = [None, *[(("utf-8", "ascii"),)] * 40, (("utf-8", "cp1252"),)]
    model.weights = np.zeros((mojibake.SLOTS, 42))
    model.weights[:, 0], model.weights[:, 41] = -9, -1  # the right chain comes last of those that beat clean text
    assert model.restore(bad) == ((("utf-8", "cp1252"),), CLEAN[0])


def test_only_a_cut_is_no_loss():
    lost = mojibake.LOST
    assert mojibake.whole("ok\nword " + lost) == "ok\nword " and mojibake.whole("слово" + lost * 3) == "слово"
    for value in ("ok\n" + lost * 69, "word " + lost * 4, lost, "ok\n" + lost, "a " + lost * 2 + " " + lost):
        assert mojibake.whole(value) == value
    model = mojibake.Model.train([(line, 9) for line in CLEAN])
    repairer = mojibake.Repairer(model)
    gone = "ok\n" + mojibake.garble("Запуск дошёл до шага", (("utf-8", "ascii"),)).replace(" ", "")
    assert repairer.garbled(gone) and repairer.mend(gone)[1:] == (gone, 1)
    bad = mojibake.garble(CLEAN[0], (("utf-8", "cp1252"),))
    assert repairer.mend(bad + lost)[1:] == (CLEAN[0] + lost, 0)


def test_stretches_of_a_line():
    model = mojibake.Model.train([(line, 9) for line in CLEAN] + [("✓ → café déjà", 9)])
    repairer = mojibake.Repairer(model)
    bad = lambda text, *wrong: mojibake.garble(text, tuple(("utf-8", w) for w in wrong))
    for value, want in (
        ("✓ déjà → " + bad("Prüfung läuft", "cp1252"), "✓ déjà → Prüfung läuft"),
        ("✓" + bad("Prüfung", "cp1252") + " 5", "✓Prüfung 5"),
        (bad("modèle dépassé", "cp1252") + " x " + bad("Запуск дошёл", "cp437"), "modèle dépassé x Запуск дошёл"),
    ):
        assert repairer.judge(value) == (None, False)
        assert repairer.garbled(value) and repairer.mend(value)[1:] == (want, 0)
    assert not any(repairer.garbled(line) for line in [*CLEAN, "✓ déjà → Prüfung läuft", "Größe: точность 学習"])


# ---- 3 -----------------------------------------------------------------------------------
CALL = "trajectory_id string, call_index int, command string, monitoring_action boolean, started_at timestamp, ended_at timestamp, ingested_at timestamp, key string, prev string"


def calls(spark, rows):
    base = [(t, i, c, m) for t, i, c, m in rows]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in base], "trajectory_id string, call_index int, command string, monitoring_action boolean, key string, prev string")
    at = lambda s: (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce("call_index", F.lit(0)), F.lit(s)))
    return df.withColumns({"started_at": at(0), "ended_at": at(30), "ingested_at": F.lit("2026-02-01").cast("timestamp")})


@pytest.mark.parametrize("block", [2, 4096])
def test_runs(spark, block):
    rows = [
        ("t", 0, "ls", False), ("t", 1, " ls\n", False), ("t", 2, "ls", None), ("t", 3, "ls", None), ("t", 4, None, False), ("t", 5, None, False), ("t", 6, "sleep 5", True), ("t", 7, "sleep  6.5", True),
        ("t", 8, "sleep 7", False), ("t", 10, "sleep 7", False), ("t", 11, "", False), ("t", 12, " ", False), ("t", 0, "ls", False), (None, 1, "ls", False), ("u", None, "ls", False), ("u", 0, "x", False),
    ]
    df = calls(spark, rows)
    assert {tuple(r) for r in runs.repeated_runs(df, block).collect()} == {("t", 0, 1), ("t", 2, 3), ("t", 6, 7), ("t", 11, 12)}
    full = {(r.trajectory_id, r.first_call_index): r for r in runs.command_runs(df, block).collect()}
    assert full["t", 6].is_polling and full["t", 6].n_calls == 2 and full["t", 6].duration_us == 90_000_000
    assert full["u", 0].n_calls == 1 and ("t", 4) not in full
    assert runs.repeated_runs(df.where("call_index > 99"), block).count() == 0


# ---- 5 -----------------------------------------------------------------------------------
def messages(spark, rows):
    full = [(t, i, e, r, None, x, c, "completed", n) for n, (t, i, e, r, x, c) in enumerate(rows)]
    return spark.createDataFrame(full, "trajectory_id string, event_index int, event_type string, role string, tool_name string, text string, call_id string, lifecycle_status string, ingested_at int")


def talk(t, *turns):
    return [(t, i, *turn) for i, turn in enumerate(turns)]


U, A = ("user_text", "Human", "q", None), ("assistant_text", "AI", "a", None)
CALL_, RESULT, SYSTEM = ("tool_call", "model", "x", "c1"), ("tool_result", "user", "y", "c1"), ("system", "developer", "s", None)
CASES = {
    "ok": ([SYSTEM, U, CALL_, RESULT, A, U, A], False), "no_reply": ([U, A, U], True), "two_users": ([U, U, A], True), "system_only": ([SYSTEM], True), "assistant_first": ([A, U, A], True),
    "open_call": ([U, CALL_, A], True), "loose_result": ([U, RESULT, A], True), "late_call": ([U, RESULT, CALL_, A], True), "blank_role": ([U, ("assistant_text", " ", "a", None), A], True), "null_role": ([U, ("assistant_text", None, "a", None), A], True),
    "blank_texts": ([("user_text", "user", " ​", None), ("assistant_text", "assistant", None, None)], True), "no_id": ([U, ("tool_call", "model", "x", None), ("tool_result", "tool", "y", None), A], True), "short": ([U, A], False),
}


@pytest.mark.parametrize("block", [2, 4096])
def test_conversations(spark, block):
    rows = [r for name, (turns, _) in CASES.items() for r in talk(name, *turns)]
    rows += [("gap", 0, *U), ("gap", 2, *A), ("clash", 0, *U), ("clash", 1, *A), ("clash", 1, "assistant_text", "AI", "b", None), ("null", None, *U), ("null", 0, *U), ("null", 1, *A), ("late", 1, *U), ("late", 2, *A), (None, 0, *U), rows[0]]
    df = messages(spark, rows)
    want = {name for name, (_, bad) in CASES.items() if bad} | {"gap", "clash", "null", "late"}
    assert {r.trajectory_id for r in conversations.dropped_conversations(df, block).collect()} == want
    kept = conversations.conversations(df, block)
    assert [r.speaker for r in kept.where("trajectory_id = 'ok'").orderBy("event_index").collect()] == ["system", "user", "assistant", "user", "assistant", "user", "assistant"]
    assert conversations.dropped_conversations(df.where("event_index > 99"), block).count() == 0


# ---- 6 -----------------------------------------------------------------------------------
def cut_corpus():
    rnd = random.Random(9)
    whole = lambda i: rnd.choice([
        f"step {i} | loss {rnd.random():.3f} | lr 1e-{i % 6}", f"accuracy: {rnd.random():.4f} ({i % 50} of 50)", f"GPU {i % 8}: {rnd.randint(1000, 9999)} MiB used, {i % 99} % busy.",
        f"The evaluator queued checkpoint-{i} after the restart and answered with {rnd.random():.3f}.", "All checks passed.", "OK", f'{{\n  "accuracy": {rnd.random():.2f},\n  "n": {i}\n}}',
    ])
    rows, want = [], set()
    for i in range(2400):
        value = "\n".join(whole(i) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "\n"])
        if i % 25 == 0:
            value = "\n".join(whole(i + k) for k in range(30))[: 500]
            want.add(("t", i))
        elif i % 75 == 1:
            body = f"The evaluator queued checkpoint-{i} after the restart and answered with {rnd.random():.3f}."
            value = body[: rnd.randint(20, len(body) - 12)]
            want.add(("t", i))
        elif i % 75 == 2:
            value = value.rstrip()[:200] + "...[truncated]"
            want.add(("t", i))
        rows.append({"trajectory_id": "t", "event_index": i, "source_format": "src", "command_output": value})
    return rows, want


def test_cut_values(spark):
    rows, want = cut_corpus()
    odd = [{"trajectory_id": "t", "event_index": 9000, "text": ""}, {"trajectory_id": "t", "event_index": 9001, "text": "init", "source_format": None}, {"trajectory_id": "t", "event_index": 9002}, rows[1]]
    df = events(spark, rows + odd)
    limits, totals = truncation.field_limits(df)
    assert limits["src", "command_output"][0] == {500} and totals["src", "command_output"] == 2401
    model = truncation.train(df)
    got = {(r.trajectory_id, r.event_index) for r in truncation.cut_values(df, model).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)
    shares = {(r.source_format, r.field): (r.n_values, r.n_cut) for r in truncation.cut_shares(df, model).collect()}
    assert shares["src", "command_output"] == (2400, len({x for x in got if x[1] < 9000}))
    assert shares["unknown", "text"][1] == 0
    assert truncation.cut_values(df.where("event_index < 0")).count() == 0


def test_endings():
    assert truncation.whole_json('{"a": [1]}\n') and not truncation.whole_json('{"a": [1}') and not truncation.whole_json("x")
    assert truncation.open_marks('f(x, ["a') == '(["'
    assert truncation.fills_limit("é" * 10, frozenset(), frozenset({21})) and not truncation.fills_limit("abc", frozenset({4}), frozenset({9}))


# ---- 8, 9 --------------------------------------------------------------------------------
def test_tree_equals_direct_encoding():
    own = tokens.Tokenizer(tokens.vocabulary())
    rnd = random.Random(1)
    alphabet = "aab'stl lre  \n\t12é中。!'-　\x1c🚀"
    for _ in range(400):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400)))
        own.leaf = rnd.choice([3, 7, 40])
        ids = own.encode(text)
        assert ids == own.encoding.encode_ordinary(text) and own.decode(ids) == text
    own.leaf = 64
    for text in ("x" * 5000, " " * 5000, "<|endoftext|>" * 50, "中" * 1000):
        assert own.encode(text) == own.encoding.encode_ordinary(text)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")


def test_ids_of_odd_texts(spark):
    got = {r.doc_id: r.ids for r in tokens.document_ids(documents(spark, [None, "", "hello world", "x" * 100_000])).collect()}
    assert got[0] == got[1] == [] and len(got[2]) == 2 and sum(map(len, got.values())) > 10_000
    assert all(r.restored for r in tokens.decoded_documents(documents(spark, [None, "", "héllo", "a\x00b"])).collect())
    assert tokens.document_ids(documents(spark, ["x"]).where("doc_id < 0")).count() == 0


def test_packing(spark):
    rnd = random.Random(2)
    texts = [" word" * rnd.randint(1, 90) for _ in range(600)] + [" same" * 40] * 300 + [None, "", " long" * 1000]
    docs = documents(spark, texts)
    specs = spark.createDataFrame([(1, "a", 100), (1, "a", 100), (2, "b", 256), (3, "c", None), (4, "d", 0)], "spec_id int, spec_name string, capacity_tokens int")
    rows = packing.containers(docs, specs, window=128).collect()
    sizes = {r.doc_id: r.n_tokens for r in tokens.decoded_documents(docs).collect()}
    for spec, capacity in ((1, 100), (2, 256)):
        own = [r for r in rows if r.spec_id == spec]
        fill, pieces = {}, {}
        for r in own:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        assert max(fill.values()) <= capacity and sum(fill.values()) / (len(fill) * capacity) > 0.9
        for d, n in sizes.items():
            got = sorted(pieces.get(d, []))
            assert (texts[d] is None) == (not got)
            assert sum(k for _, k in got) == n and all(a + k == b for (a, k), (b, _) in zip(got, got[1:])) and (len(got) <= 1 or n > capacity)
    assert {r.spec_id for r in rows} == {1, 2}
    assert packing.containers(docs.where("doc_id < 0"), specs).count() == 0


def test_hilbert_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# ---- 10 ----------------------------------------------------------------------------------
def test_same_look(spark):
    texts = ["Café no 5", "Café no 5", "Ｃａｆé no ５", "Cаfé no​ 5", "Cafe no 5", "café no 5", "Café no 5", "", "​", None, " ", "x²", "x2", "ﬁn", "fin", "ﬃx", "ffix", "a‑b", "a-b", "a–b", "プ", "プ", "K", "K"]
    same = [{0, 1, 2, 3, 6}, {13, 14}, {15, 16}, {17, 18}, {20, 21}, {22, 23}]
    want = {(a, b) for g in same for a in g for b in g if a < b and texts[a] != texts[b]}
    df = documents(spark, texts)
    assert {tuple(r) for r in lookalikes.same_look_pairs(df).collect()} == want
    classes = {r.doc_id: r.class_id for r in lookalikes.same_look_classes(df).collect()}
    assert all(classes[x] == min(g) for g in same for x in g) and 7 not in classes and 9 not in classes
    long = "word " * 20_000
    assert lookalikes.same_look_pairs(documents(spark, [long, long.replace(" ", " "), long + "."])).count() == 1
    assert lookalikes.same_look_pairs(df.where("doc_id < 0")).count() == 0


def test_form_is_stable(spark):
    df = documents(spark, ["Ｃａｆé ﬁ а", "плохо ё", "ᾳ Ǆ ㎏ ½"])
    once = lookalikes.canonical_texts(df).select("doc_id", F.col("form").alias("text"))
    twice = {r.doc_id: r.form for r in lookalikes.canonical_texts(once).collect()}
    assert twice == {r.doc_id: r.text for r in once.collect()}


def test_chains_of_held_out_lines():
    rnd = random.Random(8)
    texts = [line.format(f"run{i}", i) for i in range(12) for line in CLEAN]
    model = mojibake.Model.train([(t, 3) for t in texts[: 6 * len(CLEAN)]])
    made = []
    for text in texts[6 * len(CLEAN) :] * 20:
        chain = rnd.choice(mojibake.chains())
        bad = mojibake.garble(text, chain, "keep")
        if bad not in (None, text) and mojibake.invert(bad, chain) == text:
            made.append((text, chain, model.restore(bad)))
    assert len(made) > 200
    assert np.mean([got[1] == text for text, _, got in made]) >= 0.95  # the text comes back
    assert np.mean([got[0] == chain for _, chain, got in made]) >= 0.7  # by the very chain: some chains give the same bytes


def test_long_lines_are_counted_in_pieces():
    text = " ".join(f"é{i}" for i in range(500))
    got = list(mojibake.pieces(text))
    assert " ".join(got) == text and all(400 <= len(p) < 420 for p in got[:-1]) and list(mojibake.pieces("")) == []
    assert list(mojibake.pieces("x" * 900)) == ["x" * 900]


def test_every_limit_counts(spark):
    rnd = random.Random(4)
    rows = []
    for k, limit in enumerate((400, 470, 540, 610)):  # four limits of one source: none is dropped
        for i in range(12):
            body = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(1, 99)) for _ in range(200))
            rows.append({"trajectory_id": f"l{k}", "event_index": i, "source_format": "src", "text": body[:limit]})
    rows += [{"trajectory_id": "w", "event_index": i, "source_format": "src", "text": "w" * rnd.randint(1, 300) + " end."} for i in range(2000)]
    limits, totals = truncation.field_limits(events(spark, rows))
    assert limits["src", "text"][0] == {400, 470, 540, 610} and totals["src", "text"] == len(rows)


def test_the_score_decides(spark):
    rows, _ = cut_corpus()
    df = events(spark, rows)
    model = truncation.train(df)
    full = ("The evaluator queued checkpoint-7 after the restart and answered with 0.123.\n" * 9)[:500]
    whole = "\n".join(["All checks passed."] * 40)
    whole = whole[-500:] if len(whole) > 500 else whole
    for value in (full, whole, "step 5 | loss 0.5\nOK...[truncated]"):
        assert model.score(value, "src", "command_output") > truncation.THRESHOLD
    again = truncation.train(df.repartition(7))
    assert np.array_equal(model.weights, again.weights)  # however the rows lie
