"""Problem 2: text that was decoded with the wrong encoding.

A multinomial classifier on hashed byte bigrams predicts the exact chain of encodings by
which a line was garbled. It is trained here: clean lines of the corpus are garbled by
every chain of ``chains()``. Every chain that the classifier prefers to clean text is
inverted; of those whose every step encodes and decodes strictly, and whose result is
likelier clean text than the line, the one with the greatest likelihood is predicted: the
classifier's, of the line given the chain, times that of the result as clean text. What
was garbled with loss (replacement characters) can only be reported.

The unit is the line, as often only a stretch of a value was garbled; of a line only the
words with non-ASCII letters count. Where no chain inverts a whole line, its runs of words
are judged one by one with the same model: those that score best under a chain, and what
of a word the chain's encoding can hold. This is done for chains of UTF-8 only: of a
single-byte encoding a few letters invert into likely text by chance (at sf0.1, 363 more
values were found with them, and all 14 looked at were clean), so its stretches are only
found where they are all of the line's words with non-ASCII letters.

Training: at most ``SAMPLE`` distinct lines (in that sense), the most frequent ones,
counted over all data. Lines that hold replacement characters or that decode strictly as UTF-8
under some chain are no clean seeds; a second round also drops the seeds that the first
model takes for garbled.

Defined results
* null, empty and ASCII-only values are no case (nothing in them tells of an encoding);
* up to three replacement characters at the very end of a value, with a readable word
  before them on their line, are a cut and not a wrong encoding; they stay in the restored text;
* an event that comes twice counts once.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("command_output", "file_content")
#: Bound of the training sample, in lines.
SAMPLE = 6000
#: Hashed features.
SLOTS = 1 << 15
#: A chain must beat clean text by so many nats, and its inversion must be likelier clean text by as many.
MARGIN = 3.0
#: Marks that stand beside any letter in clean text (fixed values), and their weight as seeds.
TYPOGRAPHY = "…–—‘’“”„•·°€£§©®™±×÷≈≤≥→←↑↓✓✗«»¿¡№"
TYPOGRAPHY_WEIGHT = 20
#: Longer lines are several pieces, of whole words and about so many characters, when training lines are counted.
PIECE = 400
LOST = "�"
#: Encodings by script (fixed values): text of the script is written in the first, read in the second.
READ_UTF8 = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "gbk", "big5", "cp932", "euc_kr", "cp1250", "iso8859_15", "ascii")
SINGLE_BYTE = {
    "latin": (("cp1252", "cp850", "cp437", "mac_roman"), ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "gbk", "utf-8")),
    "cyrillic": (("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5"), ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "cp1252", "latin-1", "cp437", "cp850", "mac_roman", "gbk", "utf-8")),
    "asian": (("cp932", "euc_jp", "gbk", "big5", "euc_kr"), ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "gbk", "cp932", "euc_jp", "big5", "euc_kr", "utf-8")),
}
Chain = tuple[tuple[str, str], ...]


@functools.lru_cache(maxsize=1)
def chains() -> list[Chain]:
    """All chains of (written in, read in): one step, and two or three for UTF-8 read wrongly again and again."""
    out: dict[Chain, None] = {}
    for wrong in READ_UTF8:
        out[(("utf-8", wrong),)] = None
    for first in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"):
        for second in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"):
            out[(("utf-8", first), ("utf-8", second))] = None
    for wrong in ("cp1252", "latin-1"):
        out[(("utf-8", wrong),) * 3] = None
    for own, read in SINGLE_BYTE.values():
        for a in own:
            for b in read:
                if a != b and {a, b} != {"cp1252", "latin-1"}:
                    out[((a, b),)] = None
    return list(out)


def _encode(text: str, encoding: str) -> bytes | None:
    """Strictly, but for bytes that an encoding leaves undefined, which readers keep as control characters."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1251", "cp1250"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) < 0xA0:
                return None
            out.append(ord(c))
    return bytes(out)


def _decode(data: bytes, encoding: str, errors: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        pass
    if encoding in ("cp1252", "cp1251", "cp1250") and errors == "keep":
        return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data)
    return data.decode(encoding, "replace") if errors == "replace" else None


def garble(text: str, chain: Chain, errors: str = "replace") -> str | None:
    """The text after the chain; undefined bytes are replaced, or kept as control characters."""
    for own, read in chain:
        data = _encode(text, own)
        if data is None:
            return None
        text = _decode(data, read, errors)
        if text is None:
            return None
    return text


def invert(text: str, chain: Chain) -> str | None:
    """The text before the chain, if every step encodes and decodes strictly."""
    for own, read in reversed(chain):
        data = _encode(text, read)
        if data is None:
            return None
        try:
            text = data.decode(own)
        except UnicodeDecodeError:
            return None
    return text


def bigrams(text: str) -> np.ndarray:
    """Bigrams of the UTF-8 bytes that touch a non-ASCII byte, first * 256 + second; letters and digits count as one each."""
    data = _PLAIN[np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8)]
    a, b = data[:-1], data[1:]
    keep = (a >= 128) | (b >= 128)
    return a[keep] * 256 + b[keep]


_PLAIN = np.arange(256)
_PLAIN[65:91], _PLAIN[97:123], _PLAIN[48:58] = 65, 97, 48


def features(text: str) -> np.ndarray:
    """The hashed bigrams."""
    return bigrams(text) * 2654435761 % (1 << 31) % SLOTS


class Model:
    """Log-probabilities of the features in each class (class 0 is clean text), and of each byte after another in clean text."""

    def __init__(self, classes: list[Chain | None], weights: np.ndarray, follows: np.ndarray):
        self.classes, self.weights, self.follows = classes, weights, follows

    def likelihood(self, text: str) -> float:
        """Of the bytes of clean text, each given the one before."""
        return float(self.follows[bigrams(text)].sum())

    @classmethod
    def train(cls, clean: list[tuple[str, int]]) -> Model:
        """From clean texts and how often each occurs."""
        classes: list[Chain | None] = [None, *chains()]
        counts = np.zeros((len(classes), SLOTS), np.float32)
        for k, chain in enumerate(classes):
            at, weights = [], []
            for text, n in clean:
                forms = {text} if chain is None else {garble(text, chain), garble(text, chain, "keep")} - {None, text}
                for form in forms:
                    f = features(form)
                    at.append(f)
                    weights.append(np.full(len(f), n / len(forms), np.float32))
            if at:
                counts[k] = np.bincount(np.concatenate(at), np.concatenate(weights), SLOTS)
        used = counts.sum(1) > 0
        share = counts[used] / counts[used].sum(1, keepdims=True) + 1e-6
        pairs = np.zeros(1 << 16, np.float64)
        for text, n in clean:
            pairs += np.bincount(bigrams(text), minlength=1 << 16) * float(n)
        pairs = pairs.reshape(256, 256) + 0.01
        follows = np.log(pairs / pairs.sum(1, keepdims=True)).ravel()
        return cls([c for c, u in zip(classes, used) if u], np.log(share / share.sum(1, keepdims=True)).T.copy(), follows)

    def restore(self, text: str) -> tuple[Chain | None, str | None]:
        """(chain, original): no chain for clean text, no original where it can't be had.

        Of the chains that explain the text better than clean text does, and whose strict
        inversion is likelier clean text than the text as it stands, the one is taken that
        explains it best: by the classifier and by how likely a clean text its inversion is.
        A text with replacement characters can't be inverted.
        """
        if text.isascii():
            return None, None
        s = self.weights[features(text)].sum(0)
        better = [k for k in np.argsort(-s, kind="stable") if k and s[k] > s[0] + MARGIN]
        if LOST in text:
            return (self.classes[better[0]], None) if better else (None, None)
        least, best, found = self.likelihood(text) + MARGIN, -np.inf, (None, None)
        for k in better:
            original = invert(text, self.classes[k])
            if original is not None and LOST in original and found[0] is None:
                found = self.classes[k], None  # a replacement character was garbled again: the loss lies further back
            elif original is not None and original != text and LOST not in original:
                clean = self.likelihood(original)
                if clean > least and clean + s[k] > best:
                    best, found = clean + s[k], (self.classes[k], original)
        return found

    def telling(self) -> np.ndarray:
        """Classes whose inversion proves something of few letters: text that happens to be UTF-8 is rare."""
        return np.array([c is not None and all(own == "utf-8" for own, _ in c) for c in self.classes])

    def stretches(self, line: str) -> list[tuple[int, int, Chain]]:
        """(start, end, chain) of the garbled stretches of a line that can be restored, where no chain inverts it whole.

        Per chain, the run of words that beats clean text by most is a candidate (found
        in one pass), and so is each word, or what the chain's last encoding can hold of
        it. The stretch that gains most is taken, then what lies beside it is judged.
        """
        words = [(m.start(), m.end()) for m in re.finditer("[^ \\t\\r]+", line) if not m.group().isascii()]
        if not words:
            return []
        scores = np.stack([self.weights[features(core(line[a:b]))].sum(0) for a, b in words])
        ahead = np.where(self.telling(), scores - scores[:, :1], -np.inf)
        tried: set[tuple[int, int, int]] = set()
        found: list[tuple[float, int, int, Chain]] = []
        total, begin, width = np.zeros(ahead.shape[1]), np.zeros(ahead.shape[1], np.int64), len(words)
        best, spans = np.full(ahead.shape[1], MARGIN), np.full((ahead.shape[1], 2), -1)
        for i in range(width):
            begin = np.where(total > 0, begin, i)
            total = np.maximum(total, 0) + ahead[i]
            more = total > best
            best[more], spans[more, 0], spans[more, 1] = total[more], begin[more], i
        for k in np.flatnonzero(spans[:, 0] >= 0):
            if k:
                tried.add((words[spans[k, 0]][0], words[spans[k, 1]][1], int(k)))
        for i, k in zip(*np.nonzero(ahead > MARGIN)):
            a, b = words[i]
            tried.add((a, b, int(k)))
        for i, (a, b) in enumerate(words):  # parts of words
            for part in _parts(line[a:b]) if LOST not in line[a:b] else ():
                s = self.weights[features(line[a + part[0] : a + part[1]])].sum(0)
                tried.update((a + part[0], a + part[1], int(k)) for k in np.flatnonzero((s > s[0] + MARGIN) & self.telling()))
        for a, b, k in tried:
            text = line[a:b]
            if LOST in text:
                continue
            original = invert(text, self.classes[k])
            if original is not None and original != text and LOST not in original:
                gain = self.likelihood(core(original)) - self.likelihood(core(text))
                if gain > MARGIN:
                    found.append((gain, a, b, self.classes[k]))
        out: list[tuple[int, int, Chain]] = []
        for _, a, b, chain in sorted(found, key=lambda x: (-x[0], x[1], x[2], x[3])):
            if all(b <= c or d <= a for c, d, _ in out):
                out.append((a, b, chain))
        return sorted(out)


def _parts(word: str) -> list[tuple[int, int]]:
    """Parts of a word, split where a sign begins or ends that one of the usual wrong encodings lacks."""
    out = []
    for wrong in ("cp1252", "cp437", "mac_roman", "cp1251"):
        held = [_encode(c, wrong) is not None for c in word]
        if not all(held):
            at = 0
            for own, run in itertools.groupby(held):
                n = len(list(run))
                if own and not word[at : at + n].isascii():
                    out.append((at, at + n))
                at += n
    return out


def _looks_utf8(text: str) -> bool:
    return any((o := invert(text, (("utf-8", w),))) is not None and o != text for w in READ_UTF8[:-1])


def core(line: str) -> str:
    """The words of a line that hold a non-ASCII letter: all that tells of its encoding."""
    return " ".join(re.sub("[0-9]+", "0", w) for w in re.split("[ \\t\\r]+", line) if not w.isascii())


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A core in pieces of whole words, each of `size` characters or a little more."""
    at = 0
    while at < len(text):
        stop = text.find(" ", at + size)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop]
        at = stop + 1


def _other(c: str) -> str:
    return f"{c} rlike '[^\\\\x00-\\\\x7F]'"


def _candidates(events: DataFrame) -> DataFrame:
    """Values with non-ASCII letters only; the other field of such a row is left out."""
    kept = events.where(" or ".join(map(_other, FIELDS)))
    return kept.select("trajectory_id", "event_index", *[F.when(F.expr(_other(c)), F.col(c)).alias(c) for c in FIELDS])


def train(events: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a corpus; None if it has no non-ASCII text."""

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, int] = {}
            for k in range(len(FIELDS)):
                for value in batch.column(k).to_pylist():
                    for line in (value or "").split("\n"):
                        if not line.isascii():
                            for c in pieces(core(line)):
                                found[c] = found.get(c, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["core", "n"])

    counted = _candidates(events).select(*FIELDS).mapInArrow(cores, "core string, n bigint").groupBy("core").agg(F.sum("n").alias("n"))
    rows = [(r.core, r.n) for r in counted.orderBy(F.desc("n"), F.xxhash64("core"), "core").limit(sample).collect()]
    seeds = [(t, n) for t, n in rows if LOST not in t and not t.isascii() and not _looks_utf8(t)] or [(t, n) for t, n in rows if not t.isascii()]
    if not seeds:
        return None
    marks = [(form.replace("*", c), TYPOGRAPHY_WEIGHT) for c in TYPOGRAPHY for form in ("a*", "*a", "0*", "*0", "* *", ")*", "-*", "'*", '"*', "|*", ".*", ",*", "/*", "_*", "=*", "(*", ":*")]
    model = Model.train(seeds + marks)
    again = [(t, n) for t, n in seeds if model.restore(t)[0] is None]
    return Model.train((again or seeds) + marks)


class Repairer:
    """Judges and mends values with one model; remembers the lines it saw."""

    def __init__(self, model: Model, most_known: int = 100_000):
        self.model, self.most_known = model, most_known
        self.known: dict[str, tuple[Chain | None, bool]] = {}
        self.pieces: dict[str, bool] = {}

    def judge(self, line: str) -> tuple[Chain | None, bool]:
        """(chain, whether the line can be restored whole)."""
        c = core(line)
        if c not in self.known:
            if len(self.known) >= self.most_known:
                self.known.clear()
            chain, original = self.model.restore(c)
            self.known[c] = chain, original is not None
        return self.known[c]

    def stretches(self, line: str) -> list[tuple[int, int, Chain]]:
        """The stretches of a line that can be restored only by themselves."""
        c = core(line)
        if c not in self.pieces:
            if len(self.pieces) >= self.most_known:
                self.pieces.clear()
            self.pieces[c] = bool(self.model.stretches(c))
        return self.model.stretches(line) if self.pieces[c] else []

    def garbled(self, value: str) -> bool:
        return any(self.judge(line)[0] is not None or bool(self.stretches(line)) for line in whole(value).split("\n") if not line.isascii())

    def mend(self, value: str) -> tuple[list[str], str | None, int]:
        """(chains, value with every restorable line and stretch restored, lines that stay garbled)."""
        used, out, lost = set(), [], 0
        name = lambda chain: " > ".join(f"{a} read as {b}" for a, b in chain)
        for line in whole(value).split("\n"):
            chain, can = (None, False) if line.isascii() else self.judge(line)
            original = invert(line, chain) if can else None
            if chain is not None:
                used.add(name(chain))
            if original is None and not line.isascii():
                lost += chain is not None
                for a, b, own in reversed(self.stretches(line)):
                    back = invert(line[a:b], own)
                    if back is not None:
                        used.add(name(own))
                        line = line[:a] + back + line[b:]
            out.append(line if original is None else original)
        return sorted(used), "\n".join(out) + value[len(whole(value)) :], lost


#: The replacement characters that a cut within a letter leaves, behind a readable word.
_CUT = re.compile(f"(?<![{LOST}])[{LOST}]{{1,3}}$")
_READABLE = re.compile(f"[^{LOST}]*[^\\W_][^{LOST}]*$")


def whole(value: str) -> str:
    """Without the mark of a cut at the end."""
    cut = _CUT.search(value) if value.endswith(LOST) else None
    if cut is None:
        return value
    before = value[value.rfind("\n", 0, cut.start()) + 1 : cut.start()].split()
    return value[: cut.start()] if before and _READABLE.match(before[-1]) else value


FOUND = "trajectory_id string, event_index int, field string"
MENDED = FOUND + ", chains array<string>, restored string, lines_lost int"


def _rows(events: DataFrame, model: Model, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(model)
        for batch in batches:
            at, fields, mended = [], [], []
            for k, field in enumerate(FIELDS):
                for row, value in enumerate(batch.column(2 + k).to_pylist()):
                    if value is not None and repairer.garbled(value):
                        at.append(row)
                        fields.append(field)
                        if with_text:
                            mended.append(repairer.mend(value))
            take = pa.array(at, pa.int64())
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(fields, pa.string())]
            names = ["trajectory_id", "event_index", "field"]
            if with_text:
                columns += [pa.array([m[0] for m in mended], pa.list_(pa.string())), pa.array([m[1] for m in mended], pa.string()), pa.array([m[2] for m in mended], pa.int32())]
                names += ["chains", "restored", "lines_lost"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return _candidates(events).mapInArrow(run, MENDED if with_text else FOUND)


def garbled_values(events: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """p2_found: (trajectory_id, event_index, field) of every garbled value."""
    model = model or train(events, sample)
    if model is None:
        return events.sparkSession.createDataFrame([], FOUND)
    return _rows(events, model, False).distinct()


def restored_values(events: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """Every garbled value with its chains, the text as far as it can be restored, and the lines that can't be."""
    model = model or train(events, sample)
    if model is None:
        return events.sparkSession.createDataFrame([], MENDED)
    return _rows(events, model, True).dropDuplicates(["trajectory_id", "event_index", "field"])
