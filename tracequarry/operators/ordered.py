"""Operators over ordered event sequences, none of which puts a whole sequence into one task.

Positions are integers, unique within the keys. See blocks.py for the block scheme.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators.blocks import BLOCK, blocked_lag, with_block


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by a total order (dropDuplicates would keep any).

    A grouped minimum, so it combines before the shuffle and a hot key is no problem.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    tail = [c for c in rest if c not in lead]
    first = df.groupBy(*keys).agg(F.min(F.struct(*lead, *tail)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}") for c in [*lead, *tail]]).select(*df.columns)


def running_sum(df: DataFrame, keys: Sequence[str], position: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds inclusive running sums, in blocks: sums within a block plus the sums of the blocks before."""
    cut = with_block(df, position, block)
    for name, value in sums.items():
        cut = cut.withColumn(f"_v_{name}", value.cast("long"))
    per_block = cut.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(*keys, "_block", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(carried, [*keys, "_block"])
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.sum(f"_v_{name}").over(inside), F.lit(0)) + F.col(f"_c_{name}"))
    return out.select(*df.columns, *sums)


def last_value_so_far(df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the last non-null value at or before each row (value: a struct, or null)."""
    cut = with_block(df, position, block).withColumn("_v", value)
    held = cut.where("_v is not null").groupBy(*keys, "_block").agg(F.max(F.struct(F.col(position).alias("p"), F.col("_v").alias("v"))).alias("_l"))
    blocks = cut.select(*keys, "_block").distinct().join(held, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_l", ignorenulls=True).over(before).alias("_c"))
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(carried, [*keys, "_block"])
    return out.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_c.v"))).select(*df.columns, name)


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], position: str, payload: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Left rows with the payload of the latest right row at or before their position (nulls: none).

    Both sides are put into one sequence, right rows before left ones of the same
    position, and the last payload is carried forward: O(n log n), no range join.
    Right rows of equal keys and position: the greatest payload counts.
    """
    mark = right.groupBy(*keys, position).agg(F.max(F.struct(*payload)).alias("_p"))
    both = left.withColumn("_side", F.lit(1)).withColumn("_p", F.lit(None).cast(mark.schema["_p"].dataType)).unionByName(mark.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_at", F.col(position).cast("long") * 2 + F.col("_side"))
    out = last_value_so_far_any(both, keys, "_at", F.col("_p"), "_f", block).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_f.{c}").alias(c) for c in payload])


def last_value_so_far_any(df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Like last_value_so_far where several rows may share a position and at most one of them has a value."""
    cut = with_block(df, position, block).withColumn("_v", value)
    held = cut.where("_v is not null").groupBy(*keys, "_block").agg(F.max(F.struct(F.col(position).alias("p"), F.col("_v").alias("v"))).alias("_l"))
    blocks = cut.select(*keys, "_block").distinct().join(held, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_l", ignorenulls=True).over(before).alias("_c"))
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rangeBetween(Window.unboundedPreceding, 0)
    out = cut.join(carried, [*keys, "_block"])
    return out.withColumn(name, F.coalesce(F.max(F.when(F.col("_v").isNotNull(), F.struct(F.col(position).alias("p"), F.col("_v").alias("v")))).over(inside)["v"], F.col("_c.v"))).select(*df.columns, name)


def next_boundary(df: DataFrame, keys: Sequence[str], position: str, is_boundary: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the position of the first boundary at or after each row: a bounded range join becomes an equi-join on it."""
    flipped = df.withColumn("_neg", -F.col(position).cast("long"))
    out = last_value_so_far(flipped, keys, "_neg", F.when(is_boundary, F.struct(F.col(position).alias("b"))), "_n", block)
    return out.withColumn(name, F.col("_n.b")).select(*df.columns, name)


def islands(df: DataFrame, keys: Sequence[str], position: str, starts: Column, name: str, block: int = BLOCK, joins: Callable[[Column], Column] | None = None, carry: Column | None = None) -> DataFrame:
    """Adds the island number (from 0): every row where `starts` holds, and the first of each key, opens one.

    joins: a test of the row before, by its `carry` (a struct); where it fails a row also opens an island.
    """
    lag = blocked_lag(df, keys, position, F.struct(position) if carry is None else carry, "_b", block)
    apart = F.lit(False) if joins is None else ~F.coalesce(joins(F.col("_b")), F.lit(False))
    opened = lag.withColumn("_o", F.when(F.coalesce(starts, F.lit(False)) | F.col("_b").isNull() | apart, 1).otherwise(0)).drop("_b")
    return running_sum(opened, keys, position, {name: F.col("_o")}, block).withColumn(name, F.col(name) - 1).drop("_o")


def adjacent_known_pairs(df: DataFrame, keys: Sequence[str], position: str, value: str, unknown: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Adjacent rows that are both known, numbered from 0: keys, transition_index, from/to value and position, changed.

    The predecessor is looked up before unknown rows are dropped, so an unknown row
    separates its neighbours instead of being bridged.
    """
    known = lambda c: c.isNotNull() & ~c.isin(list(unknown))
    lag = blocked_lag(df.select(*keys, position, value), keys, position, F.struct(F.col(position).alias("p"), F.col(value).alias("v")), "_b", block)
    pairs = lag.where(known(F.col("_b.v")) & known(F.col(value)))
    pairs = running_sum(pairs, keys, position, {"transition_index": F.lit(1)}, block)
    return pairs.select(
        *keys,
        (F.col("transition_index") - 1).alias("transition_index"),
        F.col("_b.v").alias("from_value"),
        F.col(value).alias("to_value"),
        F.col("_b.p").alias("from_position"),
        F.col(position).alias("to_position"),
        (F.col("_b.v") != F.col(value)).alias("changed"),
    )


def numbered(df: DataFrame, keys: Sequence[str], position: str, name: str, block: int = BLOCK) -> DataFrame:
    """row_number (from 0) over a unique position, in blocks."""
    return running_sum(df, keys, position, {name: F.lit(1)}, block).withColumn(name, F.col(name) - 1)


def seeded_rank(df: DataFrame, keys: Sequence[str], identity: str, seed: int, name: str = "rank") -> DataFrame:
    """A reproducible random order within each key: md5 of identity and seed (equal in every engine), ties by identity.

    Only for keys whose rows one task can sort; use seeded_top for hot ones.
    """
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.col(identity).cast("string"), F.lit(str(seed)))), identity)
    return df.withColumn(name, F.row_number().over(order))


def ranked_by_hash(df: DataFrame, keys: Sequence[str], digest: str, identity: str, name: str) -> DataFrame:
    """Adds the rank (from 0) of each row in order of a hexadecimal digest, ties by identity, in parts by the digest's first three digits.

    Digests spread evenly, so a part holds 1 / 4096 of a key's rows; ranks are those within a part plus the sizes of the parts before.
    """
    cut = df.withColumn("_part", F.conv(F.left(digest, F.lit(3)), 16, 10).cast("int"))
    sizes = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(digest, identity))
    return cut.withColumn("_r", inside).join(carried, [*keys, "_part"]).withColumn(name, F.col("_r") - 1 + F.col("_before")).select(*df.columns, name)


def seeded_top(df: DataFrame, keys: Sequence[str], identity: str, seed: int, n: int, salts: int = 64) -> DataFrame:
    """n rows of each key in seeded order, in two steps: the n first of each salted part, then of those."""
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(identity).cast("string"), F.lit(str(seed))))).withColumn("_salt", F.pmod(F.xxhash64(identity), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy("_h", identity)
    whole = Window.partitionBy(*keys).orderBy("_h", identity)
    few = hashed.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
    return few.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= n).select(*df.columns)


def last_k(df: DataFrame, keys: Sequence[str], position: str, k: int) -> DataFrame:
    """The last k rows of each key by a unique position: k of each salted part first, so a long key never meets in one place."""
    part = Window.partitionBy(*keys, "_salt").orderBy(F.desc(position))
    whole = Window.partitionBy(*keys).orderBy(F.desc(position))
    few = df.withColumn("_salt", F.pmod(F.xxhash64(position), F.lit(64))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    return few.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k).select(*df.columns)


def last_k_text(df: DataFrame, keys: Sequence[str], position: str, text: str, k: int, most: int, name: str) -> DataFrame:
    """The last k texts of each key in order, joined by line breaks, cut to the last `most` characters.

    Positions are ranked first; only the texts of the last k are fetched by their key.
    """
    few = last_k(df.select(*keys, position), keys, position, k).join(df.select(*keys, position, text), [*keys, position])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text]), "\n")
    return few.groupBy(*keys).agg(F.right(joined, F.lit(most)).alias(name))


def dominant(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(keys, dominant, dominant_n): the commonest of the listed values; ties go to the one listed first."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(value))
    counts = df.where(F.col(value).isin(list(order))).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col("n").alias("n")), F.struct(F.col("n"), -rank)).alias("b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("b.v").alias("dominant"), F.col("b.n").alias("dominant_n"))


def index_percentiles(df: DataFrame, keys: Sequence[str], value: str, tenths: dict[str, int]) -> DataFrame:
    """The values at index n * tenths // 10 of each key's sorted values (not percentile_disc: of 1 2 3 4 the median is 3).

    Counts of distinct values are ranked by running sums, so values are not collected.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("c", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda t: F.min(F.when(F.col("c") > F.floor(F.col("all") * t / 10), F.col(value)))
    return cum.groupBy(*keys).agg(*[at(t).alias(name) for name, t in tenths.items()])


#: Items of one or two words have no inner words to hash; more of them than this are refused.
MAX_SHORT_ITEMS = 1000


def containment(documents: DataFrame, items: DataFrame, text: str, item_text: str, words: int = 8) -> DataFrame:
    """Pairs of documents and items whose normalised text the document contains.

    An item's inner words (all but the first and last, which may touch other characters
    in a document) must stand in the document as whole words: hashes of the first `words`
    of them meet hashes of every word position (an equi-join), and `contains` confirms.
    Items of one or two words are looked for directly; their number is bounded.
    """
    spaced = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    items = items.withColumn("_item", spaced(F.col(item_text))).where("_item <> ''").withColumn("_w", F.split("_item", " "))
    docs = documents.where(F.col(text).isNotNull()).withColumn("_doc", spaced(F.col(text)))
    keyed = items.where(F.size("_w") > 2).withColumn("_n", F.least(F.size("_w") - 2, F.lit(words)))
    keyed = keyed.withColumn("_key", F.xxhash64(F.array_join(F.slice("_w", F.lit(2), F.col("_n")), " ")))
    lengths = [r._n for r in keyed.select("_n").distinct().orderBy("_n").limit(words).collect()]
    split = F.split("_doc", " ")

    def at_every_word(n: int) -> Column:
        last = F.size(split) - n + 1
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(split, i, F.lit(n)), " ")))
        return F.when(last >= 1, hashes).otherwise(F.array().cast("array<bigint>"))

    keys = F.array_distinct(F.flatten(F.array(*map(at_every_word, lengths)))) if lengths else F.array().cast("array<bigint>")
    # only ids and hashes are exploded and joined; the text of the few documents that meet an item is fetched by id
    ids = [c for c in documents.columns if c != text]
    met = docs.select(*ids, F.explode(keys).alias("_key")).join(keyed.select(*items.columns[:-2], "_item", "_key"), "_key").drop("_key").distinct()
    own = docs.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], F.col(text), "_doc")
    same = [F.col(c).eqNullSafe(F.col(f"_id{i}")) for i, c in enumerate(ids)]
    found = own.join(met, same).where(F.col("_doc").contains(F.col("_item"))).select(*documents.columns, *items.columns[:-2])
    short = items.where(F.size("_w") <= 2).drop("_w")
    few = [r._item for r in short.select("_item").distinct().limit(MAX_SHORT_ITEMS + 1).collect()]
    if len(few) > MAX_SHORT_ITEMS:
        raise ValueError(f"more than {MAX_SHORT_ITEMS} items of one or two words")
    if not few:
        return found
    held = F.filter(F.array(*[F.lit(x) for x in sorted(few)]), lambda x: F.col("_doc").contains(x))
    direct = docs.withColumn("_item", F.explode(held)).drop("_doc").join(short, "_item").select(*found.columns)
    return found.unionByName(direct)
