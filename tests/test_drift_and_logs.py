"""Schema drift and log lines: planted cases, and nulls, repeats, empty tables, clashing columns."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import log_lines, schema_drift

RAW = "log_stream string, file_seq int, line_no int, record string, ingested_at timestamp, field string, kind string"


def raw(spark, files, extra=()):
    rows = [(s, f, i + 1, r) for (s, f), rs in files.items() for i, r in enumerate(rs)]
    df = spark.createDataFrame([(*r, None, "clash", "clash") for r in [*rows, *extra]], RAW.replace("timestamp", "string"))
    return df.withColumn("ingested_at", F.lit("2026-01-01").cast("timestamp"))


def found(df):
    return {tuple(r) for r in schema_drift.schema_changes(df).select("log_stream", "file_seq", "field", "change_kind").collect()}


def test_changes(spark):
    files = {
        ("s", 0): ['{"n": 20, "err": "it went wrong", "task_args": {"few": "8", "shot": 1}}', '{"n": 30}'],
        ("s", 2): ['{"n_samples": 25, "err": {"code": 5}, "task_args": {"few": "5", "shot": 2}}'],
        ("s", 3): ['{"n_samples": null, "err": {"code": 5, "x": 1}, "task_args": {"Few": "words", "shot": 2.5}, "extra": [1]}'],
        ("s", 4): ['{"n_samples": 25, "err": {"code": 5}, "task_args": {"Few": "more", "shot": 2.5}, "extra": ["a"]}'],
    }
    want = {
        ("s", 2, "n", "renamed"), ("s", 2, "err", "retyped"),
        ("s", 3, "task_args.few", "removed"), ("s", 3, "task_args.Few", "added"), ("s", 3, "task_args.shot", "retyped"), ("s", 3, "extra", "added"),
    }
    assert found(raw(spark, files)) == want
    twice = [("s", 0, 1, files["s", 0][0]), ("s", None, 1, "{}"), (None, 0, 1, "{}")]
    assert found(raw(spark, files, twice)) == want


def test_unreadable_and_empty(spark):
    files = {("s", 0): ['{"a": 1}'], ("s", 1): ["no json"], ("s", 2): [None], ("s", 3): ['{"a": 1}'], ("t", 0): ["[1]"]}
    assert found(raw(spark, files)) == {("s", 1, "a", "removed"), ("s", 3, "a", "added")}
    none = raw(spark, files).where("file_seq < 0")
    assert schema_drift.schema_changes(none).count() == 0 and schema_drift.file_versions(none).count() == 0
    prints = {(r.log_stream, r.file_seq): r.fingerprint for r in schema_drift.file_versions(raw(spark, files)).collect()}
    assert prints["s", 0] == prints["s", 3] != prints["s", 1]


def test_a_known_pair_needs_only_the_type(spark):
    files = {(t, f): [f'{{"{n}": "{v}"}}'] for t in "ab" for f, n, v in ((0, "shots", 4), (1, "shotCount", 5))}
    files |= {("c", 0): ['{"shots": "4"}'], ("c", 1): ['{"shotCount": "none"}']}
    assert found(raw(spark, files)) == {(t, 1, "shots", "renamed") for t in "abc"}
    beside = {("d", f): ['{"shots": "4", "shotCount": "4"}'] for f in range(9)}
    assert found(raw(spark, files | beside)) == {("a", 1, "shots", "renamed"), ("b", 1, "shots", "renamed"), ("c", 1, "shots", "removed"), ("c", 1, "shotCount", "added")}


def test_one_table(spark):
    files = {("s", 0): ['{"stderr": 0.25, "n": 1}', '{"stderr": 0.5, "n": 2}', '{"stderr": 0.75}'], ("s", 1): ['{"stderr": "0.3", "n": 3}'], ("s", 2): ['{"std_error": "0.375", "n": "many"}'], ("s", 3): ["no"]}
    got = {(r.file_seq, r.line_no): r for r in schema_drift.consistent_table(raw(spark, files)).collect()}
    assert (got[0, 1].stderr, got[1, 1].stderr, got[2, 1].stderr, got[3, 1].stderr) == (0.25, 0.3, 0.375, None)
    assert got[0, 1].rules == [] and got[0, 3].rules == ["default n"] and got[1, 1].rules == ["cast stderr from string to decimal"] and got[3, 1].rules == ["unreadable"]
    assert got[2, 1].rules == ["cast stderr from string to decimal", "cast_failed n from string to integer", "rename std_error to stderr"]
    assert got[2, 1].n is None and got[2, 1].rejected == {"n": '"many"'} and got[0, 2].n == 2


def test_two_names_of_a_family_stay_apart(spark):
    files = {("a", 0): ['{"lr": 0.5}'], ("a", 1): ['{"learning": 0.5}'], ("b", 0): ['{"lr": 0.5, "learning": 0.9}'], ("b", 1): ['{"lr": 0.4, "learning": 0.8}'], ("c", 0): ['{"learning": 0.7}']}
    got = {(r.log_stream, r.file_seq): (r.lr, r.learning) for r in schema_drift.consistent_table(raw(spark, files)).collect()}
    assert got == {("a", 0): (0.5, None), ("a", 1): (0.5, None), ("b", 0): (0.5, 0.9), ("b", 1): (0.4, 0.8), ("c", 0): (0.7, None)}


def test_chains_of_renames(spark):
    names = ["n", "n_rows", "rows_n", "row_count", "rows"]
    files = {("s", i): [f'{{"{n}": {20 + i}}}'] for i, n in enumerate(names)} | {("s", 9): ['{"rows": 25, "n": "a word of its own"}']}
    rows = schema_drift.consistent_table(raw(spark, files)).collect()
    # the last file holds two names of the family, so the stream's chain decides: all old names lead to rows
    assert {r.file_seq: r.rows for r in rows} == {0: 20, 1: 21, 2: 22, 3: 23, 4: 24, 9: 25}
    assert [r.n for r in rows if r.file_seq == 9] == ["a word of its own"] and all(r.n is None for r in rows if r.file_seq < 9)
    versions = {r.file_seq: r.version for r in schema_drift.file_versions(raw(spark, files | {("s", 10): files["s", 9]})).collect()}
    assert versions == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 9: 6, 10: 6}


def test_odd_names_and_nested_fields(spark):
    files = {("s", 0): ['{"a.b": 1, "it\'s": true, "task_args": {"x": [1]}, "task_args.y": 2}', '{"a.b": null, "task_args": {"x": "word"}}']}
    got = {r.line_no: r for r in schema_drift.consistent_table(raw(spark, files)).collect()}
    assert got[1]["a.b"] == 1 and got[1]["it's"] is True and got[1]["task_args.x"] == "[1]" and got[2]["task_args.x"] == '["word"]'


LOG = """lead in
2026-02-02 03:23:54,679 - engine.core - INFO - first
    weight: 1

  File "x.py"
ERROR 02-02 02:56:48 [loader.py:320] second
Traceback (most recent call last):
WARNING:trainer:third
Warning: prompt was truncated...[truncated] see log
  INFO 02-02 02:56:48 [loader.py:320] indented
{"ts": "2026-02-02T02:42:26.052Z", "level": "info", "logger": "a.b", "msg": "say \\"x\\""}
time=2026-02-02T02:57:43Z level=error component=io msg="worker 3"
I0202 04:01:55.055854  3927 core.cc:404] glog
Feb  2 03:14:00 gpu-12 dist.launch[82]: info: sys
(q pid=47) DEBUG 02/02/26 03:39:00 >> ray
1770005564.045 | INFO     | pool | loguru

"""


def entries(spark, rows):
    df = spark.createDataFrame(rows, "trajectory_id string, event_index int, command_output string, text string, field string, level int")
    return df


def test_entries(spark):
    df = entries(spark, [("t", 1, LOG, None, "x", 1), ("t", 1, LOG, None, "x", 1), ("t", 2, None, "", "x", 1), (None, None, "INFO:a.b:m", None, "x", 1)])
    got = log_lines.log_entries(df).where("trajectory_id is not null").orderBy("first_line").collect()
    assert [(r.first_line, r.last_line) for r in got] == [(2, 5), (6, 7), (8, 10), (11, 11), (12, 12), (13, 13), (14, 14), (15, 15), (16, 16)]
    assert [(r.level, r.component) for r in got] == [
        ("INFO", "engine.core"), ("ERROR", "loader.py"), ("WARNING", "trainer"), ("INFO", "a.b"), ("ERROR", "io"), ("INFO", "core.cc"), ("INFO", "dist.launch"), ("DEBUG", "q"), ("INFO", "pool"),
    ]
    assert got[0].timestamp == "2026-02-02 03:23:54,679" and got[2].timestamp is None
    assert got[0].message.splitlines()[0] == "first" and got[3].message == 'say "x"' and got[4].message == "worker 3" and got[8].message == "loguru"
    spans = {(r.trajectory_id, r.first_line, r.last_line) for r in log_lines.entry_spans(df).collect()}
    assert spans == {("t", r.first_line, r.last_line) for r in got} | {(None, 1, 1)}
    assert log_lines.entry_spans(df.where("event_index > 9")).count() == 0


def test_long_values_and_words_of_severity(spark):
    prose = "The error rate rose. No warning was given: info is scarce.\n" * 3000
    df = entries(spark, [("t", 1, prose + "INFO:a:last", prose, "x", 1), ("t", 2, "0 errors\nERROR\nFatal\nerror: pathspec", None, "x", 1)])
    assert [(r.event_index, r.first_line) for r in log_lines.entry_spans(df).collect()] == [(1, 3001)]


LATE = """{"ts": "2026-02-02T02:42:26.052Z", "logger": "engine.core.io", "host": "gpu-12", "level": "INFO", "msg": "first"}
{"msg": "a long message, with level=debug in it and {\\"level\\": \\"debug\\"} too, in many words", "ctx": {"level": "trace"}, "logger": "b", "ts": "2026-02-02T02:42:27Z", "level": "error"}
{"message": "cut off in the tail, so that it is no JSON", "a": [1, 2], "time": "2026-02-02T02:42:28Z", "severity": "WARNING", "name": "c", "x": "y
time=2026-02-02T02:57:43Z msg="set level=debug in this long message of many, many words" component=io level=warn
2026-02-02T02:57:44Z msg=worker 3 of 4 has started up and is now ready for work logger=pool level=info
[2026-02-02 03:00:00,123] [pid 123] [thread main] [rank 0 of 8] [local 3] [engine] [ERROR] plain
"""


def test_fields_far_into_the_line(spark):
    df = entries(spark, [("t", 1, LATE, None, "x", 1), ("t", 2, '{"ts": "2026-02-02T02:42:26Z", "msg": "level: error", "n": 1}', None, "x", 1)])
    got = log_lines.log_entries(df).orderBy("first_line").collect()
    assert [(r.first_line, r.last_line, r.level, r.component) for r in got] == [
        (1, 1, "INFO", "engine.core.io"), (2, 2, "ERROR", "b"), (3, 3, "WARNING", "c"), (4, 4, "WARNING", "io"), (5, 5, "INFO", "pool"), (6, 6, "ERROR", "engine"),
    ]
    assert [r.timestamp for r in got] == ["2026-02-02T02:42:26.052Z", "2026-02-02T02:42:27Z", "2026-02-02T02:42:28Z", "2026-02-02T02:57:43Z", "2026-02-02T02:57:44Z", "2026-02-02 03:00:00,123"]
    assert got[3].message == "set level=debug in this long message of many, many words" and got[4].message == "worker 3 of 4 has started up and is now ready for work" and got[5].message == "plain"
    assert got[2].message == "cut off in the tail, so that it is no JSON"
    assert got[1].template == '{"msg": "<*>", "<NAME>": {"level": "<*>"}, "logger": "<NAME>", "ts": "<TIME>", "level": "<level>'
    assert log_lines.entry_spans(df).count() == 6


def test_templates_decide_where_lines_differ(spark):
    lines = [f"2026-02-02 03:23:{i:02d} | INFO | pool | worker {i} is up and well" for i in range(20)] + ["2026-02-02 03:24:00 | info | pool | worker is slow and late"]
    lines += [f"2026-02-02 03:25:{i:02d},679 - engine - WARNING - step {i} of the run" for i in range(9)] + ["2026-02-02 03:26:00,679 - 42 - WARNING - no name was given"]
    df = entries(spark, [("t", i, line, None, "x", 1) for i, line in enumerate(lines)])
    got = {r.event_index: (r.level, r.component) for r in log_lines.log_entries(df).collect()}
    assert got == {i: ("INFO", "pool") for i in range(21)} | {21 + i: ("WARNING", "engine") for i in range(9)} | {30: ("WARNING", "42")}
    # alone, the odd lines give no entry, or none with a component: the tree decides
    alone = {r.event_index: r.component for r in log_lines.log_entries(df.where("event_index in (20, 30)")).collect()}
    assert alone == {30: None}
    # and a line of the same leaf that has no severity in its place is no entry of that template
    assert log_lines.TemplateTree(log_lines.templates(df)).route(tuple(map(log_lines._mask, log_lines.TOKEN.finditer("2026-02-02 03:24:00 | up | pool | worker is slow and late")))) is None


@pytest.mark.parametrize("n", range(24))
def test_keys_in_every_order(n):
    record = {"ts": "2026-02-02T02:42:26.052Z", "logger": "a.b", "level": "ERROR", "msg": "a long text, of many words: level=debug and so on"}
    keys = list(itertools.permutations(record))[n]
    tree = log_lines.TemplateTree()
    for line in (json.dumps({k: record[k] for k in keys}), json.dumps({"pid": 12, "host": "h", **{k: record[k] for k in keys}}), " ".join(f'{k}="{record[k]}"' for k in keys)):
        [(first, last, template, places, _)] = log_lines.entries(tree, line)
        assert log_lines._fields(template, *places, line) == (record["ts"], "ERROR", "a.b", record["msg"])


def test_headers_of_many_tokens():
    ranks = "".join(f"[rank {i}]" for i in range(30))
    tree = log_lines.TemplateTree()
    for line in (f"[2026-02-02 03:00:00]{ranks}[trainer] ERROR: broke", f"2026-02-02 03:00:00 app[12]: [request-id=a user=b tenant=c {ranks}] ERROR store: lost"):
        [(_, _, template, places, _)] = log_lines.entries(tree, line)
        assert template.end > 40 and log_lines._fields(template, *places, line)[:2] == ("2026-02-02 03:00:00", "ERROR")
