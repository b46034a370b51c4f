"""Problem 6: values that were cut off by a field limit or in transfer.

A hashed logistic regression scores every value, and its score decides; a value that ends
with a whole line or sentence with nothing left open is then taken for whole. Its
positives are made here: intact values are cut at random places, and at every limit of
their source, with or without a mark. The features are the closing characters, the shape
of the last line and of its last tokens, open brackets and quotes, marks, and the length
against the limits.

Limits are found in the data: per source_format and field, the lengths (in characters
and in bytes) that far more values have than lengths nearby, with hardly any value
beyond. All values are counted for this, and all such lengths are limits.

Training: at most ``SAMPLE`` values per source_format and field, those of least hash of
their key. Values with a mark at the end or that fill a limit are no intact ones, nor are
those that a model trained on the other half of the sample has doubts about. Workers turn the sample into
hashed features; the driver sees integers and known words only.

Defined results
* null and blank values are complete; so are status words, whole lines and whole JSON;
* a null source_format is a source of its own (named ``unknown`` in the report);
* an event that comes twice counts once, also in the report.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.session import cut_lineage

FIELDS = ("command_output", "text")
#: Training values per source and field; hashed features.
SAMPLE = 2500
#: Of many sources each has fewer, so that about so many values are sampled in all.
MOST_SAMPLED = 100_000
SLOTS = 1 << 18
#: Log-odds (at even odds in training) from which a value counts as cut: cut values are rare.
THRESHOLD = 2.25
#: Values that a model of other values scores as much as this are not taken for intact.
DOUBT = 0.0
#: Share of the sampled values that are also made into a marked one, and into one for each limit.
TOLD = 0.3
#: Known words: those of three or more sampled values, at most so many, the most frequent ones.
MAX_WORDS = 50_000
#: Limits are few; beyond this many of all sources together they are refused.
MAX_LIMITS = 10_000
#: A limit: so many values of exactly this length, so many times the mean of lengths nearby, and at most this share of values longer.
LIMIT_COUNT, LIMIT_TIMES, LIMIT_BEYOND, LIMIT_LEAST = 4, 8.0, 0.002, 64
#: Marks that recorders add to a cut value (fixed values).
MARK = re.compile(r"(?:\n?\.\.\.\s?\[?(?:truncated|output truncated|cut|\d+ (?:more )?(?:chars|characters|bytes)[^\]\n]{0,20})\]?|\[(?:output )?truncated\]|<truncated>|…)\s*\Z", re.I)
#: Of these, marks that nothing else ends with.
#: The mark itself may be cut: "...[tru" is a mark too.
_PART = "|".join("truncated"[:k] for k in range(9, 0, -1))
SURE_MARK = re.compile(rf"(?:\.\.\.\s?\[(?:output )?(?:{_PART})?\]?|\[(?:output )?truncated\]|<truncated>)\s*\Z", re.I)
_MARKS = ["...[truncated]", "\n...[truncated]", "…", "... [truncated]", "[truncated]"]
#: A line break, or the end of a sentence that is no decimal point.
WHOLE = re.compile(r"\n\Z|[^\W\d_][.!?]\Z|[。！？]\Z")
#: Signs of several alphabets in a row, as wrong encodings leave them, are one token of their own kind.
_TOKEN = re.compile(r"[^\x00-\x7f]+|[A-Za-z]+|\d+|_+|\s+|[^\w\s]")
_SCRIPTS = [(0xC0, 0x250, "latin"), (0x370, 0x400, "greek"), (0x400, 0x530, "cyrillic"), (0x2E80, 0xD7B0, "asian"), (0xF900, 0xFB00, "asian"), (0xFF00, 0xFFF0, "asian")]
_STOPS = "。！？…”’»）」"
_TAIL = 240


#: What tells most counts so many times, so that it can outweigh all the rest.
TELLING, TIMES = ("fills", "sure mark"), 16.0


def mask(text: str) -> str:
    """Letters in runs: a (lower), A (capitalised or upper); every digit 0; the rest as it is."""
    return _TOKEN.sub(lambda m: _kind(m.group()), text)


def _kind(t: str) -> str:
    c = t[0]
    if c > "\x7f" and not c.isspace():
        return _foreign(t)
    if c.isdigit():
        return "0" * min(len(t), 5)
    if c.isalpha():
        return "a" if t.islower() else "A" if c.isupper() else "b"
    return " " if c.isspace() else t


def _foreign(t: str) -> str:
    """c for letters of one script, u for a mixture; a last stop or mark stays."""
    end = t[-1] if t[-1] in _STOPS else ""
    scripts = {next((name for a, b, name in _SCRIPTS if a <= ord(x) < b), "signs") for x in t if x not in _STOPS}
    return ("" if not scripts else "s" if scripts == {"signs"} else "c" if len(scripts) == 1 else "u") + end


def open_marks(line: str) -> str:
    """Brackets and quotes of a line that are open at its end."""
    out = ""
    for a, b in (("(", ")"), ("[", "]"), ("{", "}"), ("“", "”")):
        if line.count(a) > line.count(b):
            out += a
    return out + ('"' if line.count('"') % 2 else "")


def whole_json(value: str) -> bool:
    v = value.strip()
    if v[:1] not in "{[" or v[-1:] not in "}]":
        return False
    try:
        json.loads(v)
    except ValueError:
        return False
    return True


class Words(frozenset):
    """Known words; part() tells whether a text is only the beginning of one."""

    def __new__(cls, words):
        own = super().__new__(cls, words)
        own.parts = frozenset(w[:k] for w in own for k in range(1, len(w))) - own
        return own

    def part(self, text: str) -> bool:
        return text in self.parts

    def __reduce__(self):
        return Words, (sorted(self),)


def fills_limit(value: str, chars: frozenset[int], bytes_: frozenset[int]) -> bool:
    """Whether the value has just the length of a limit; a limit in bytes may fall within a character."""
    n = len(value)
    if n in chars:
        return True
    if n in bytes_ and value.isascii():
        return True
    near = [b for b in bytes_ if n < b <= 4 * n]
    if not near or value.isascii():
        return False
    size = len(value.encode())
    return any(b - 3 <= size <= b for b in near)


def strings(value: str, source: str, field: str, chars: frozenset[int], bytes_: frozenset[int], known: Words | None) -> list[str]:
    """The features of a value, before hashing."""
    where = f"{source}/{field}"
    n = len(value)
    out = ["bias", where]
    if fills_limit(value, chars, bytes_):
        out.append("fills")
    marked = MARK.search(value, max(0, n - 60))
    if SURE_MARK.search(value, max(0, n - 60)):
        out.append("sure mark")
    if marked:
        out += ["marked", f"marked {mask(marked.group())}"]
        value = value[: marked.start()]
    body = value.rstrip()
    broken = value[len(body) :]
    out.append(f"newline {chr(10) in broken} {field}")
    if not body:
        return out
    at = body.rfind("\n") + 1
    line = body[at:]
    if body[0] in "{[":
        out.append(f"json {whole_json(body)}")
    start = line[:60]
    tail = line[-_TAIL:]
    tokens = [_kind(t) for t in _TOKEN.findall(tail)]
    shape = "".join(tokens)
    words = line.split()
    last = words[-1]
    end = "".join(tokens[-3:])
    prose = len(words) > 4 and sum(w.isalpha() for w in words) > len(words) / 2
    kind = ("p" if prose else "l") + ("i" if line[0].isspace() else "")
    head = "".join(_kind(t) for t in _TOKEN.findall(start)[:3])
    first = re.match(r"\W*([^\W\d]*)", start).group(1)[:12]
    out += [
        f"end {body[-1] if not body[-1].isalnum() else tokens[-1][-1:]} {kind}",
        f"end {body[-1] if not body[-1].isalnum() else tokens[-1][-1:]} {field} {kind} {broken != ''}",
        f"end3 {end}", f"end3 {head} {end}", f"end5 {''.join(tokens[-5:])}", f"end5 {first} {''.join(tokens[-5:])}",
        f"end8 {''.join(tokens[-8:])}",
        f"count {head} {len(tokens)}", f"first {first} {len(words) if len(words) < 12 else 12} {end}",
        f"open {open_marks(line)} {kind}",
        f"single {at == 0} {min(len(words), 3)} {kind}", f"after {words[-2][-12:].lower() if len(words) > 1 else ''} {mask(last[-12:])}",
    ]
    out += [f"line {len(line) <= 40} {re.sub('[0-9]+', '0', line[-40:])}", f"shape {len(shape) <= 100} {shape[-100:]}"]
    pure = last.strip(".,;:!?()[]{}'\"`“”…")
    if pure.isalpha():
        out.append(f"word {pure.lower()}")
        if known is not None:
            low = pure.lower()
            out += [f"known {low in known} {kind} {body[-1].isalpha()}", f"part {known.part(low)} {kind} {body[-1].isalpha()}", f"lone part {known.part(low)} {len(words) == 1}"]
    if line[0].isspace() or at and body[:at].rstrip()[-1:] in "{[(,":
        out.append("inside a structure")
    return out


def hashed(features: list[str]) -> list[int]:
    return [crc32(f.encode()) % SLOTS for f in features]


class Model:
    """Weights by hashed feature; 0 fills up rows of unequal length."""

    def __init__(self, weights: np.ndarray, limits: dict, known: Words):
        self.weights, self.limits, self.known = weights, limits, known

    def features(self, value: str, source: str, field: str) -> list[str]:
        chars, bytes_ = self.limits.get((source, field), (frozenset(), frozenset()))
        return strings(value, source, field, chars, bytes_, self.known)

    def score(self, value: str, source: str, field: str) -> float:
        return float(sum(self.weights[hashed(self.features(value, source, field))]))

    def is_cut(self, score: float, value: str, plain: bool) -> bool:
        """By score; but a whole line, sentence or status word, nothing left open, is none where it is plain: no mark, no limit filled."""
        return score >= THRESHOLD and not (plain and (self.status_word(value) or WHOLE.search(value[-3:]) and not open_marks(value)))

    def status_word(self, value: str) -> bool:
        """Whether a value is one word, and not only the beginning of a known one."""
        word = value.strip().lower()
        return word.isalpha() and not self.known.part(word)

    def fit(self, at: np.ndarray, of: np.ndarray, labels: np.ndarray, taken: np.ndarray, rounds: int = 40, rate: float = 0.3, decay: float = 2e-5) -> None:
        """Full-batch gradient steps with per-weight rates: features `at` of examples `of`, of the examples taken."""
        use = taken[of]
        at, of = at[use], of[use]
        y = labels.astype(np.float64)
        n, cut = taken.sum(), (y * taken).sum()
        share = np.where(y > 0, 0.5 / max(1, cut), 0.5 / max(1, n - cut)) * taken
        times = np.ones(SLOTS)
        times[hashed(list(TELLING))] = TIMES
        w, square = np.zeros(SLOTS), np.full(SLOTS, 1e-10)
        for _ in range(rounds):
            z = np.bincount(of, (w * times)[at], len(y))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
            gradient = np.bincount(at, error[of], SLOTS) * times + decay * 1e-3 * w
            square += gradient**2
            w -= rate * gradient / np.sqrt(square)
        self.weights = w * times


def field_limits(events: DataFrame) -> tuple[dict[tuple[str, str], tuple[frozenset[int], frozenset[int]]], dict[tuple[str, str], int]]:
    """Limits and number of values by (source, field), from the lengths of all values: limits are (in characters, in bytes)."""
    one = _unpivoted(events).where("value is not null")
    lengths = one.select("source", "field", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.length("value").alias("n")), F.struct(F.lit("b").alias("unit"), F.octet_length("value").alias("n")))).alias("l"))
    counts = lengths.groupBy("source", "field", "l.unit", "l.n").count()
    by = ["source", "field", "unit"]
    whole = Window.partitionBy(*by)
    near = whole.orderBy("n").rangeBetween(-40, 40)
    upto = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    spikes = counts.withColumn("near", (F.sum("count").over(near) - F.col("count")) / 80).withColumn("all", F.sum("count").over(whole))
    spikes = spikes.withColumn("spike", (F.col("n") >= LIMIT_LEAST) & (F.col("count") >= LIMIT_COUNT) & (F.col("count") >= LIMIT_TIMES * F.col("near")))
    plain = F.when(F.col("spike"), 0).otherwise(F.col("count"))  # values at another limit are not beyond this one
    spikes = spikes.withColumn("longer", F.sum(plain).over(whole) - F.sum(plain).over(upto))
    is_limit = F.col("spike") & (F.col("longer") <= F.greatest(LIMIT_BEYOND * F.col("all"), F.col("count")))
    found = spikes.groupBy(*by).agg(F.max("all").alias("all"), F.array_sort(F.collect_list(F.when(is_limit, F.col("n")))).alias("lengths"))  # limits are a handful of all lengths
    limits: dict[tuple[str, str], tuple[frozenset[int], frozenset[int]]] = {}
    totals: dict[tuple[str, str], int] = {}
    for r in found.orderBy(*by).limit(MAX_LIMITS + 1).collect():
        key = r.source, r.field
        chars, bytes_ = limits.get(key, (frozenset(), frozenset()))
        limits[key] = (frozenset(r.lengths), bytes_) if r.unit == "c" else (chars, frozenset(r.lengths))
        totals[key] = r["all"]
    if len(totals) > MAX_LIMITS or sum(len(a) + len(b) for a, b in limits.values()) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} sources or limits")
    return limits, totals


def _unpivoted(events: DataFrame) -> DataFrame:
    values = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in FIELDS])
    return events.select("trajectory_id", "event_index", F.coalesce("source_format", F.lit("unknown")).alias("source"), F.explode(values).alias("x")).select("trajectory_id", "event_index", "source", "x.field", "x.value")


def _examples(value: str, source: str, field: str, model: Model, random: np.random.Generator) -> list[tuple[int, list[str]]]:
    """An intact value as it is (0, first of the list) and cut (1), as features."""
    own = lambda v: model.features(v, source, field)
    out = [(0, own(value))]
    body = value.rstrip()
    if len(body) < 12:
        return out
    chars, bytes_ = model.limits.get((source, field), (frozenset(), frozenset()))
    for _ in range(2):
        cut = int(random.integers(6, len(body)))
        if "\n" not in body[cut - 1 : cut + 1] and not MARK.search(body[:cut]):
            out.append((1, own(body[:cut])))
    for limit in sorted(chars or bytes_):  # values that just fill a limit, wherever that ends
        if random.random() < TOLD:
            grown = (body + "\n") * (limit // (len(body) + 1) + 2)
            out.append((1, own(grown[:limit] if random.random() < 0.5 else grown.rstrip()[-limit:])))
    if random.random() < TOLD:
        cut = int(random.integers(len(body) // 2, len(body)))
        out.append((1, own(body[:cut] + _MARKS[int(random.integers(len(_MARKS)))])))
    lines = body.split("\n")
    if field == "command_output" and len(lines) > 2:  # whole lines are complete
        k = int(random.integers(1, len(lines)))
        shown = "\n".join(lines[:k])
        if not open_marks(shown) and lines[k - 1].strip() and not lines[k].startswith((" ", "\t")):
            out.append((0, own(shown + ("\n" if random.random() < 0.3 else ""))))
    return out


def _known(picked: DataFrame) -> Words:
    """Words of three or more values of the sample."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for value in batch.column(0).to_pylist():
                for w in {w.lower() for w in re.findall(r"[^\W\d_]+(?=[\s.,;:!?)])", value)}:
                    counts[w] = counts.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    words = picked.select("value").mapInArrow(found, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 3")
    return Words(r.word for r in words.orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect())


def train(events: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a corpus; None if it has no values."""
    limits, total = field_limits(events)
    keyed = _unpivoted(events).where("value is not null and value rlike '\\\\S'").withColumn("h", F.xxhash64("trajectory_id", "event_index", "field"))
    # of each source and field the share of keys, by hash, that gives about `sample` values
    if not total:
        return None
    share = F.lit(1.0)
    for (source, field), n in sorted(total.items()):
        share = F.when((F.col("source") == source) & (F.col("field") == field), F.lit(min(1.0, min(sample, MOST_SAMPLED / len(total)) / n))).otherwise(share)
    # written once: bounded, and read for the words and for the examples; it lies in as many tasks as there are
    picked = cut_lineage(keyed.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).select("value", "source", "field", "h").distinct())
    model = Model(np.zeros(SLOTS), limits, _known(picked))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, intact, labels, hashes = [], [], [], []
            for value, source, field, h in zip(*(c.to_pylist() for c in batch.columns)):
                known_cut = bool(MARK.search(value, max(0, len(value) - 60)) or fills_limit(value, *model.limits.get((source, field), (frozenset(), frozenset()))))
                for label, strings_ in _examples(value, source, field, model, np.random.default_rng(h & (1 << 63) - 1)):
                    keys.append(h)
                    intact.append(not known_cut)
                    labels.append(label)
                    hashes.append(hashed(strings_))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(intact, pa.bool_()), pa.array(labels, pa.int32()), pa.array(hashes, pa.list_(pa.int32()))], ["h", "intact", "label", "hashes"])

    rows = picked.repartition("h").sortWithinPartitions("h", "value").mapInArrow(make, "h bigint, intact boolean, label int, hashes array<int>").toArrow()
    order = np.argsort(rows["h"].to_numpy(), kind="stable")  # the same order however the sample was split
    keys, intact, labels = (rows[c].to_numpy()[order] for c in ("h", "intact", "label"))
    features = rows["hashes"].combine_chunks().take(pa.array(order))
    at, sizes = features.flatten().to_numpy(), np.diff(features.offsets.to_numpy())
    if intact.any():
        keep = intact
    else:
        keep = np.ones(len(keys), bool)
    # an example's value, and the place of the value as it is: the first of its examples
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    of = np.repeat(np.arange(len(keys)), sizes)
    # values that were really cut are among those taken for intact: each half of the sample is judged by the other's model
    half = keys % 2 == 0
    sure = np.ones(len(keys), bool)
    for own in (half, ~half):
        if (keep & own).any():
            model.fit(at, of, labels, keep & own)
            doubtful = np.bincount(of, model.weights[at], len(keys))[first] >= DOUBT
            sure &= own | ~doubtful[group]
    model.fit(at, of, labels, keep & sure if (keep & sure).any() else keep)
    return model


FOUND = "trajectory_id string, event_index int, field string"
SCORED = "trajectory_id string, event_index int, source string, field string, score double, cut boolean"


def scores(events: DataFrame, model: Model, cut_only: bool = False) -> DataFrame:
    """(trajectory_id, event_index, source, field, score, cut) of every value that is not null; blank values score -inf."""
    kept = events.select("trajectory_id", "event_index", F.coalesce("source_format", F.lit("unknown")).alias("source"), *FIELDS).where(" or ".join(f"{c} is not null" for c in FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights.tolist()
        for batch in batches:
            sources = batch.column(2).to_pylist()
            at, fields, found, cut = [], [], [], []
            for k, field in enumerate(FIELDS):
                for row, value in enumerate(batch.column(3 + k).to_pylist()):
                    if value is None:
                        continue
                    strings_ = model.features(value, sources[row], field) if value.strip() else []
                    score = sum([weights[crc32(f.encode()) % SLOTS] for f in strings_]) if strings_ else -np.inf
                    is_cut = model.is_cut(score, value, not set(TELLING) & set(strings_))
                    if not cut_only or is_cut:
                        at.append(row)
                        fields.append(field)
                        found.append(score)
                        cut.append(is_cut)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(fields, pa.string()), pa.array(found, pa.float64()), pa.array(cut, pa.bool_())], ["trajectory_id", "event_index", "source", "field", "score", "cut"])

    return kept.mapInArrow(run, SCORED)


def cut_values(events: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """p6_found: (trajectory_id, event_index, field) of every value that was cut."""
    model = model or train(events, sample)
    if model is None:
        return events.sparkSession.createDataFrame([], FOUND)
    return scores(events, model, cut_only=True).select("trajectory_id", "event_index", "field").distinct()


def cut_shares(events: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """(source_format, field, n_values, n_cut, cut_share): how often each source truncates."""
    model = model or train(events, sample)
    if model is None:
        return events.sparkSession.createDataFrame([], "source_format string, field string, n_values bigint, n_cut bigint, cut_share double")
    one = scores(events, model).groupBy("trajectory_id", "event_index", "field").agg(F.min("source").alias("source"), F.max("cut").alias("cut"))
    out = one.groupBy(F.col("source").alias("source_format"), "field").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"))
    return out.withColumn("cut_share", F.col("n_cut") / F.col("n_values"))
