"""Problem 1: held-out items inside training data and scripts.

Template canonicalisation. Escapes are undone and words become a template: numbers,
names and units turn into typed placeholders, other words stay. Windows of ``WINDOW``
words carry two hashes, one of the template and one of the slots' values. Windows of
events are hash-joined with windows of items on the template; slot consistency then
tells a copy (all slots equal) from a re-parameterised question: adjacent windows of one
item are chained, and over the stretch the slots' values must map one to one.

A word's type depends on the word alone: numbers by their digits, units by a list, names
by their capital, but for words that open sentences of the items and are, in all items
together, also written in lower case. Hashes are of the words themselves. What the items
together tell of words goes to workers as files of hashes, however many words there are, so
types do not depend on the items' number.

The corpus is read once, however many items there are: bitmaps of bounded size
(``MOST_BITS``) of the items' hashes pass hardly any other window on to the join, which
decides exactly.

Defined results
* null, empty and wordless values leak nothing; neither do items of fewer than WINDOW words;
* items with a null item_id or text are left out; an item that comes twice counts once;
* an event that comes twice counts once; a window may begin anywhere in a value of any length.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import tempfile
from collections.abc import Container, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.session import cut_lineage

WINDOW = 14
FIELDS = ("file_content", "command")
#: Bits for each window of the items, and the most bits of a bitmap (2 ** 29: 64 MB); beyond, more windows pass on to the join.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 29
#: Words that a template window needs beside its slots, so that bare lists of numbers and names are no question.
LEAST_WORDS = 5
#: Share of an item's tokens that its stretches in one value must cover: many items share single sentences.
LEAST_SHARE = 0.5
#: Units (fixed values).
UNITS = """second seconds minute minutes hour hours day days night nights morning mornings week weeks fortnight fortnights month months
quarter quarters season seasons year years decade decades century centuries coin coins cent cents dollar dollars euro euros pound pounds
mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters g kg gram grams kilogram kilograms ton tons tonne tonnes
ml l litre litres liter liters gallon gallons percent degree degrees mph kmh""".split()
_WORD = re.compile("[a-z0-9]+")
#: Escapes of JSON, Python and the shell, however often they were escaped themselves.
_ESCAPE = re.compile(r"\\+(?:(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2}))|([0-3][0-7]{2})|[abefnrtv0])")
#: Numbers, words and ends of sentences of a text whose letter case counts.
_CASED = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z][A-Za-z0-9]*|[.!?:\n]")
_ENDS = ".!?:\n"
NUMBER, NAME, UNIT = 1, 2, 3


def _unescape(m: re.Match) -> str:
    digits, base = (hexed, 16) if (hexed := m[1] or m[2] or m[3] or m[4]) else (m[5], 8)
    if not digits:
        return " "
    code = int(digits, base)
    return chr(code) if code < 128 else " "


def plain(text: str) -> str:
    """ASCII text with escapes undone."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if not text.isascii():
        text = re.sub(r"[^\x00-\x7f]", " ", text)  # before lower(): it turns some signs into ASCII letters
    return text


def words(text: str | None) -> list[str]:
    """The words of a text: lower-case runs of ASCII letters and digits, escapes undone."""
    return _WORD.findall(plain(text).lower()) if text else []


def cased_tokens(text: str | None) -> tuple[list[str], list[bool]]:
    """Numbers (with their decimals) and words in their case, and whether each opens a sentence."""
    found = _CASED.findall(plain(text)) if text else []
    kept = [(t, b[0] in _ENDS) for b, t in zip([".", *found], found) if t[0] not in _ENDS]
    return [t for t, _ in kept], [o for _, o in kept]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of small integers."""
    z = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** k and _BASE ** -k modulo 2 ** 64 for k below n."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of windows of any length over codes, from one prefix sum."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _power(len(codes) + 1)
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.prefix[1:])

    def windows(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self.prefix[starts + length] - self.prefix[starts]) * self.down[starts]


def _hash(word: str, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8, salt=salt).digest(), "little")


class Codes(dict):
    """word -> index of its template and slot codes; words are hashed once a worker."""

    def __init__(self, kind, most: int = 2_000_000):
        super().__init__()
        self.kind, self.most = kind, most
        self.template, self.slot, self.kinds = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, np.int8)

    def __missing__(self, word: str) -> int:
        i, kind = len(self), self.kind(word)
        if i == len(self.template):
            self.template, self.slot, self.kinds = (np.resize(x, 2 * i) for x in (self.template, self.slot, self.kinds))
        self.template[i] = _hash(f"<{kind}>", b"type") if kind else _hash(word.lower(), b"word")
        self.slot[i] = _hash(word.lower(), b"slot") if kind else 0
        self.kinds[i] = kind
        self[word] = i
        return i

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.int64, len(words))

    def trim(self) -> None:
        """Forgets all words when there are too many (between batches only)."""
        if len(self) > self.most:
            self.clear()


@functools.lru_cache(4)
def _shipped(name: str) -> np.ndarray:
    """The hashes of a shipped file, mapped into memory: a process reads only the pages it asks for."""
    path = SparkFiles.get(name)
    return np.asarray(np.memmap(path, np.int64, "r")) if os.path.getsize(path) else np.zeros(0, np.int64)


class Words:
    """A set of any number of words: their sorted hashes in a file that every executor has."""

    def __init__(self, name: str):
        self.name = name

    @staticmethod
    def hash(word: str) -> int:
        return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8, salt=b"word").digest(), "little", signed=True)

    def __contains__(self, word: str) -> bool:
        hashes, h = _shipped(self.name), np.int64(self.hash(word))
        at = hashes.searchsorted(h)
        return bool(at < len(hashes) and hashes[at] == h)


class Lexicon:
    """What the items together tell of words: names (only ever capitalised) and openers of sentences that are also words."""

    def __init__(self, names: Container[str] = frozenset(), openers: Container[str] = frozenset()):
        self.names, self.openers = names, openers

    def caseless(self, word: str) -> int:
        """The type of a lower-case word."""
        return NUMBER if word.isdigit() else UNIT if word in UNITS else NAME if word in self.names else 0

    def cased(self, word: str) -> int:
        """The type of a word by its case: a capital makes a name, but for words that open sentences."""
        low = word.lower()
        return NUMBER if word[0].isdigit() else UNIT if low in UNITS else NAME if len(word) > 1 and word[0].isupper() and low not in self.openers else 0


def kept_items(items: DataFrame) -> DataFrame:
    return items.select("item_id", "text").where("item_id is not null and text is not null").distinct()


def _ship(spark: SparkSession, path: str, digest: str) -> str:
    """Gives a file to the executors under a name that tells its content, so that equal ones are kept once a session."""
    os.replace(path, named := os.path.join(os.path.dirname(path), f"lexicon-{digest}"))
    spark.sparkContext.addFile(named)
    return os.path.basename(named)


def lexicon(items: DataFrame) -> Lexicon:
    """Of all items, whatever their number: the driver writes the words' hashes to files as they come, a partition at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[bool]] = {}
            for text in batch.column(1).to_pylist():
                for word, opens in zip(*cased_tokens(text)):
                    if word[0].isalpha() and len(word) > 1:
                        flags = seen.setdefault(word.lower(), [False, False, False])
                        flags[0 if word[0].islower() else 1 if opens else 2] = True
            yield pa.RecordBatch.from_arrays([pa.array([Words.hash(w) for w in seen], pa.int64()), *[pa.array([f[i] for f in seen.values()], pa.bool_()) for i in range(3)]], ["word", "low", "first", "inner"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, low = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([word[kept].tobytes()], pa.binary()) for kept in (~low, low)], ["names", "openers"])

    flags = kept_items(items).mapInArrow(count, "word bigint, low boolean, first boolean, inner boolean").groupBy("word").agg(*[F.bool_or(c).alias(c) for c in ("low", "first", "inner")])
    telling = flags.where("first and low or inner and not low").select("word", "low").orderBy("word").mapInArrow(pack, "names binary, openers binary")
    folder = os.path.join(SparkFiles.getRootDirectory(), "lexicons")  # in Spark's own folder of the driver
    os.makedirs(folder, exist_ok=True)
    digests = [hashlib.blake2b(digest_size=16) for _ in telling.columns]
    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as names, tempfile.NamedTemporaryFile(dir=folder, delete=False) as openers:
        for row in telling.toLocalIterator():
            for file, digest, part in zip((names, openers), digests, row):
                file.write(part)
                digest.update(part)
    return Lexicon(*[Words(_ship(items.sparkSession, file.name, digest.hexdigest())) for file, digest in zip((names, openers), digests)])


class Bits:
    """A bitmap over the leading bits of hashes: what it lacks is in none of them."""

    def __init__(self, size: int, at: np.ndarray, values: np.ndarray):
        self.size = size
        self.words = np.zeros(max(1, 1 << (size - 6)), np.int64)
        self.words[at] = values

    def has(self, hashes: np.ndarray) -> np.ndarray:
        top = hashes.view(np.uint64) >> np.uint64(64 - self.size)
        word = self.words[(top >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        return (word >> (top & np.uint64(63))) & np.uint64(1) != 0


def bitmaps(windows: DataFrame, *hashes: str) -> list[Bits]:
    """A bitmap of each column of hashes of a written table; their size follows its length, up to MOST_BITS."""
    size = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(1, windows.count()) - 1).bit_length()))
    top = lambda c: F.shiftrightunsigned(c, 64 - size)
    each = windows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), top(c).alias("t")) for i, c in enumerate(hashes)])).alias("x")).select("x.i", "x.t")
    bits = each.groupBy("i", F.shiftright("t", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("t").bitwiseAND(F.lit(63)).cast("int"))).alias("w")).toPandas()
    return [Bits(size, *(bits.loc[bits["i"] == i, c].to_numpy(np.int64) for c in ("at", "w"))) for i in range(len(hashes))]


class _Batch:
    """The words of the long enough values of an Arrow batch in one row of codes, with their borders."""

    def __init__(self, values: list[tuple[int, str, np.ndarray]], template: np.ndarray, slot: np.ndarray):
        self.rows, self.fields = [v[0] for v in values], [v[1] for v in values]
        self.begins = np.concatenate([[0], np.cumsum([len(v[2]) for v in values])]).astype(np.int64)
        self.codes = np.concatenate([v[2] for v in values]) if values else np.zeros(0, np.int64)
        self.template, self.slots = Rolling(template[self.codes]), Rolling(slot[self.codes])

    def starts(self, length: int) -> np.ndarray:
        """Every place where a window of the length fits into one value."""
        ends = np.repeat(self.begins[1:], np.diff(self.begins))
        at = np.arange(len(self.codes))
        return at[at + length <= ends]

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, side="right") - 1


def _key(template: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return template * np.int64(31) + (slots ^ (slots >> np.int64(29)))


def _events(events: DataFrame) -> DataFrame:
    return events.select("trajectory_id", "event_index", *FIELDS).where(" or ".join(f"{c} is not null" for c in FIELDS))


def _word_windows(codes: Codes, values: list[tuple[int, str, list[str]]], window: int) -> tuple[_Batch, np.ndarray, np.ndarray, np.ndarray]:
    """(batch, starts, template hashes, slot hashes) of all windows of some values."""
    codes.trim()
    batch = _Batch([(row, field, codes.of(ws)) for row, field, ws in values if len(ws) >= window], codes.template, codes.slot)
    at = batch.starts(window)
    return batch, at, batch.template.windows(at, window).view(np.int64), batch.slots.windows(at, window).view(np.int64)


def _values(batch: pa.RecordBatch) -> Iterator[tuple[int, str, str]]:
    for k, field in enumerate(FIELDS):
        for row, value in enumerate(batch.column(2 + k).to_pylist()):
            if value:
                yield row, field, value


def item_windows(items: DataFrame, types: Lexicon, window: int = WINDOW) -> DataFrame:
    """(template, slots, item_id, key): every window of every item, written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(types.caseless)
        for batch in batches:
            own, at, template, slots = _word_windows(codes, [(i, "", words(t)) for i, t in enumerate(batch.column(1).to_pylist())], window)
            ids = batch.column(0).take(pa.array(np.array(own.rows, np.int64)[own.owner(at)] if len(at) else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(template), pa.array(slots), ids.cast(pa.int64()), pa.array(_key(template, slots))], ["template", "slots", "item_id", "key"])

    return cut_lineage(kept_items(items).mapInArrow(cut, "template bigint, slots bigint, item_id bigint, key bigint").distinct())


def leaked_items(events: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """p1_found: (trajectory_id, event_index, item_id) where an event holds `window` consecutive words of an item."""
    types = lexicon(items)
    own = item_windows(items, types, window)
    templates, keys = bitmaps(own, "template", "key")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(types.caseless)
        for batch in batches:
            found, at, template, slots = _word_windows(codes, [(row, field, words(v)) for row, field, v in _values(batch)], window)
            hit = templates.has(template)  # the template is one of an item's ...
            at, template, slots = at[hit], template[hit], slots[hit]
            hit = keys.has(_key(template, slots))  # ... and its slots hold the item's values; the join makes sure
            rows = np.array(found.rows, np.int64)[found.owner(at[hit])] if hit.any() else np.zeros(0, np.int64)
            hits = pd.DataFrame({"row": rows, "template": template[hit], "slots": slots[hit]}).drop_duplicates()
            take = pa.array(hits["row"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(hits["template"].to_numpy()), pa.array(hits["slots"].to_numpy())], ["trajectory_id", "event_index", "template", "slots"]
            )

    hits = _events(events).mapInArrow(match, "trajectory_id string, event_index int, template bigint, slots bigint")
    return hits.join(own.drop("key"), ["template", "slots"]).select("trajectory_id", "event_index", "item_id").distinct()


def _typed(codes: Codes, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tokens, template codes, kinds) of a text by its letter case; words match in any case."""
    tokens, _ = cased_tokens(text)
    codes.trim()
    at = codes.of(tokens)
    return tokens, codes.template[at], codes.kinds[at]


def _slots(tokens: list[str], kinds: np.ndarray) -> list[str | None]:
    return [t.lower() if k else None for t, k in zip(tokens, kinds.tolist())]


def item_templates(items: DataFrame, types: Lexicon, window: int = WINDOW) -> DataFrame:
    """(item_id, template, at, slots): the windows of items that have a slot and LEAST_WORDS words, with the item's slots; written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(types.cased)
        for batch in batches:
            rows, templates, places, slots = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens, template, kinds = _typed(codes, text)
                if len(tokens) < window:
                    continue
                at = np.arange(len(tokens) - window + 1)
                filled = np.concatenate([[0], np.cumsum(kinds > 0)])
                n = filled[at + window] - filled[at]
                at = at[(n > 0) & (window - n >= LEAST_WORDS)]
                rows += [row] * len(at)
                templates.append(Rolling(template).windows(at, window).view(np.int64))
                places.append(at)
                slots += [_slots(tokens, kinds)] * len(at)
            take = pa.array(rows, pa.int64())
            join = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take).cast(pa.int64()), join(templates), join(places).cast(pa.int32()), pa.array(slots, pa.list_(pa.string()))], ["item_id", "template", "at", "slots"])

    return cut_lineage(kept_items(items).mapInArrow(cut, "item_id bigint, template bigint, at int, slots array<string>").dropDuplicates(["item_id", "template", "at"]))


def reparameterised_items(events: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(trajectory_id, event_index, field, item_id, first_token, n_tokens, n_slots, n_changed): items with other values in their slots.

    Windows of templates that follow each other in the event and in the item make one
    stretch; a word too many or too few begins another. Over all stretches of an item in
    a value the slots' values must map one to one, at least one must differ, and they must
    cover LEAST_SHARE of the item. Numbers with their decimals are one token; first_token
    counts tokens of the value from 0.
    """
    types = lexicon(items)
    own = item_templates(items, types, window)
    (templates,) = bitmaps(own, "template")
    schema = "trajectory_id string, event_index int, field string, first int, slots array<string>, templates array<bigint>"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(types.cased)
        for batch in batches:
            rows, fields, firsts, slots, hashes = [], [], [], [], []
            for row, field, value in _values(batch):
                tokens, template, kinds = _typed(codes, value)
                if len(tokens) < window:
                    continue
                found = Rolling(template).windows(np.arange(len(tokens) - window + 1), window).view(np.int64)
                at = np.flatnonzero(templates.has(found))
                for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
                    a, b = int(run[0]), int(run[-1])
                    rows.append(row)
                    fields.append(field)
                    firsts.append(a)
                    slots.append(_slots(tokens[a : b + window], kinds[a : b + window]))
                    hashes.append(found[a : b + 1].tolist())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(fields, pa.string()), pa.array(firsts, pa.int32()), pa.array(slots, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))],
                ["trajectory_id", "event_index", "field", "first", "slots", "templates"],
            )

    runs = _events(events).mapInArrow(match, schema)
    key = ["trajectory_id", "event_index", "field", "first"]
    each = runs.select(*key, F.col("slots").alias("event_slots"), F.posexplode("templates").alias("k", "template"))
    met = each.join(own, "template").withColumn("shift", F.col("k") - F.col("at"))
    # windows of one shift that follow each other: all of a run, but where the item lacks one
    stretch = met.groupBy(*key, "item_id", "shift").agg(F.array_sort(F.collect_set("k")).alias("ks"), F.any_value("event_slots").alias("event_slots"), F.any_value("slots").alias("item_slots"))
    breaks = lambda i: (i == 0) | (F.element_at("ks", i + 1) - F.element_at("ks", F.greatest(i, F.lit(1))) > 1)
    begins = F.filter(F.transform("ks", lambda x, i: F.when(breaks(i), x)), lambda x: x.isNotNull())
    ends = F.filter(F.transform("ks", lambda x, i: F.when((i == F.size("ks") - 1) | F.coalesce(breaks(i + 1), F.lit(True)), x)), lambda x: x.isNotNull())
    cut = stretch.withColumn("s", F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))))
    n = F.col("s.b") - F.col("s.a") + window
    part = lambda c, at: F.slice(c, at + 1, n)
    pairs = F.filter(F.arrays_zip(part("item_slots", F.col("s.a") - F.col("shift")).alias("a"), part("event_slots", F.col("s.a")).alias("b")), lambda p: p["a"].isNotNull())
    cut = cut.select(*key[:3], "item_id", (F.col("first") + F.col("s.a")).alias("at"), n.alias("n"), pairs.alias("p"), F.size("item_slots").alias("size"))
    # stretches of an item in a value are no more than its windows, times its copies there: equal ones count once
    cut = cut.groupBy(*key[:3], "item_id", "size", "p").agg(F.min("at").alias("at"), F.max("n").alias("n"))
    distinct = lambda f: F.size(F.array_distinct(F.transform("p", f)))
    one_to_one = (distinct(lambda p: p) == distinct(lambda p: p["a"])) & (distinct(lambda p: p) == distinct(lambda p: p["b"]))
    fits = cut.where(one_to_one)
    whole = fits.groupBy(*key[:3], "item_id", "size").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.array_distinct(F.flatten(F.collect_set("p"))).alias("p"), F.max(F.struct("n", (-F.col("at")).alias("at"), "p")).alias("best"))
    # a value with the question twice, each time with other values, has no one map: then its longest stretch counts
    one = F.when(one_to_one, F.struct(F.col("at"), F.col("n"), F.col("p"))).otherwise(F.struct((-F.col("best.at")).alias("at"), F.col("best.n").alias("n"), F.col("best.p").alias("p")))
    whole = whole.select(*key[:3], "item_id", "size", one.alias("o")).select(*key[:3], "item_id", "size", "o.*")
    changed = F.size(F.filter("p", lambda p: p["a"] != p["b"]))
    return whole.where((changed > 0) & (F.col("n") >= LEAST_SHARE * F.col("size"))).select(*key[:3], "item_id", F.col("at").alias("first_token"), F.col("n").alias("n_tokens"), F.size("p").alias("n_slots"), changed.alias("n_changed"))
