"""Block-wise neighbours and running values against plain Python, at several block sizes."""

import random

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import blocks, ordered


def sequence(n=300, keys=3, seed=1):
    rnd = random.Random(seed)
    out = []
    for k in range(keys):
        for p in sorted(rnd.sample(range(-50, 2000), n if k == 0 else 20)):
            out.append((f"k{k}", p, rnd.choice("abx"), rnd.randint(0, 5)))
    return out


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_lag_and_lead(spark, block):
    rows = sequence()
    df = spark.createDataFrame(rows, "k string, p int, v string, n int")
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        for i, r in enumerate(own):
            want[k, r[1]] = (own[i - 1][2] if i else None, own[i + 1][2] if i + 1 < len(own) else None)
    got = blocks.blocked_lead(blocks.blocked_lag(df, ["k"], "p", F.struct("v"), "a", block), ["k"], "p", F.struct("v"), "b", block)
    assert {(r.k, r.p): (r.a and r.a.v, r.b and r.b.v) for r in got.collect()} == want


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_running_sum_last_value_islands(spark, block):
    rows = sequence(seed=2)
    df = spark.createDataFrame(rows, "k string, p int, v string, n int")
    got = {(r.k, r.p): r.s for r in ordered.running_sum(df, ["k"], "p", {"s": F.col("n")}, block).collect()}
    last = {(r.k, r.p): r.l and r.l.p for r in ordered.last_value_so_far(df, ["k"], "p", F.when(F.col("v") == "a", F.struct("p")), "l", block).collect()}
    island = {(r.k, r.p): r.i for r in ordered.islands(df, ["k"], "p", F.col("v") == "x", "i", block).collect()}
    for k in {r[0] for r in rows}:
        s, l, i = 0, None, -1
        for j, r in enumerate(x for x in rows if x[0] == k):
            s += r[3]
            l = r[1] if r[2] == "a" else l
            i += 1 if r[2] == "x" or j == 0 else 0
            assert (got[k, r[1]], last[k, r[1]], island[k, r[1]]) == (s, l, i)


@pytest.mark.parametrize("block", [2, 4096])
def test_asof_takes_marks_at_the_same_position(spark, block):
    left = spark.createDataFrame([("f", 5), ("f", 7), ("f", 1), ("g", 9)], "k string, p int")
    right = spark.createDataFrame([("f", 3, "self"), ("f", 7, "curated")], "k string, p int, kind string")
    got = {(r.k, r.p): r.kind for r in ordered.asof_backward(left, right, ["k"], "p", ["kind"], block).collect()}
    assert got == {("f", 5): "self", ("f", 7): "curated", ("f", 1): None, ("g", 9): None}


def test_unknown_rows_are_not_bridged(spark):
    df = spark.createDataFrame([("t", 0, "sft"), ("t", 1, "error"), ("t", 2, "grpo"), ("t", 3, "grpo"), ("t", 4, None), ("t", 5, "sft")], "k string, p int, v string")
    got = ordered.adjacent_known_pairs(df, ["k"], "p", "v", ["error"], 2).collect()
    assert [(r.from_value, r.to_value, r.changed, r.transition_index) for r in got] == [("grpo", "grpo", False, 0)]


def test_next_boundary_and_empty_tables(spark):
    df = spark.createDataFrame([("t", i, i % 4 == 3) for i in range(10)], "k string, p int, b boolean")
    got = {r.p: r.n for r in ordered.next_boundary(df, ["k"], "p", F.col("b"), "n", 3).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 4: 7, 5: 7, 6: 7, 7: 7, 8: None, 9: None}
    none = df.where("p < 0")
    assert blocks.blocked_lag(none, ["k"], "p", F.struct("p"), "x").count() == 0
    assert ordered.running_sum(none, ["k"], "p", {"s": F.lit(1)}).count() == 0


def test_keep_first_dominant_percentiles_seeded(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 5, None)], "k string, o int, v string")
    assert {(r.k, r.o, r.v) for r in ordered.keep_first(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 5, None)}
    tie = spark.createDataFrame([("g", m) for m in ["peft", "peft", "full", "full", "odd", "odd", "odd"]], "k string, v string")
    assert [tuple(r) for r in ordered.dominant(tie, ["k"], "v", ["full", "peft"]).collect()] == [("g", "full", 2)]
    nums = spark.createDataFrame([("g", x) for x in (1, 2, 3, 4)] + [("g", None)], "k string, v int")
    assert [tuple(r) for r in ordered.index_percentiles(nums, ["k"], "v", {"p50": 5, "p90": 9}).collect()] == [("g", 3, 4)]
    many = spark.range(500).select(F.lit("s").alias("k"), "id")
    once = {r.id for r in ordered.seeded_top(many, ["k"], "id", 3, 20).collect()}
    by_rank = {r.id for r in ordered.seeded_rank(many, ["k"], "id", 3).where("rank <= 20").collect()}
    assert len(once) == 20 and once == by_rank


def test_last_k_text(spark):
    df = spark.createDataFrame([("t", i, f"s{i}") for i in range(20)], "k string, p int, x string")
    assert ordered.last_k_text(df, ["k"], "p", "x", 3, 7, "c").collect()[0].c == "s18\ns19"


def test_containment_meets_brute_force(spark):
    docs = [(1, "so  we ask: how many red kites does Nera hold after 9 months? yes"), (2, "how many red kites does Nera"), (3, None), (4, ""), (5, 'x("how many red kites does Nera hold after 9 months?")')]
    items = [(10, "how many red kites does Nera hold after 9 months?"), (11, "   "), (12, "red kites does"), (13, None), (14, "yes"), (15, "kites does")]
    got = ordered.containment(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, item_text string"), "text", "item_text")
    assert {(r.doc_id, r.item_id) for r in got.select("doc_id", "item_id").collect()} == {(1, 10), (1, 12), (2, 12), (5, 10), (5, 12), (1, 14), (1, 15), (2, 15), (5, 15)}
