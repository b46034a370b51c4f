"""Problem 7: semi-structured log lines into timestamp, level, component and message.

A line's tokens are masked (times, levels, numbers and names become placeholders). A
fixed-depth tree over the whole corpus routes each header by its number of tokens and its
leading tokens to a leaf of headers with the same delimiters, which are merged into one
template: at each position the kind of token that most lines have, or a wildcard. The
fields are looked for in the template, once, and its positions give those of its lines:
a lower-case severity or a component that is a number is found where other lines of the
layout tell what stands there. A line that the template does not fit (no severity in the
level's place) is a template of its own.

Templates are counted in Spark: workers emit (leaf, header, lines), votes are sums by leaf
and position. Only leaves whose template moves a field of some header go to the workers;
their number is checked. So every worker finds the same entries whatever it saw.

Of JSON and key=value lines every key counts, wherever it stands; what stands within a
quoted value is no key, and keys of inner objects count only where the outer has none.
Of a plain line, a time and a severity in capitals count anywhere; other severities
where the line begins with a time or a severity, or else before prose begins (three words
in a row, outside of brackets); the component before the prose that follows the severity.

Defined results
* null and blank values, and values without an entry, give no rows;
* an entry's message is what follows the header on its first line, and its further lines;
* a time or component that the layout lacks is null;
* rows of one event that come twice give their entries once; rows with a null
  trajectory_id or event_index give entries with that null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import cut_lineage

FIELDS = ("command_output", "text")
#: Severities by their uniform name (fixed values).
LEVELS = {
    "TRACE": ["trace", "verbose"],
    "DEBUG": ["debug"],
    "INFO": ["info", "information", "notice"],
    "WARNING": ["warn", "warning"],
    "ERROR": ["error", "err", "severe"],
    "CRITICAL": ["critical", "crit", "fatal", "alert", "emerg", "panic"],
}
LETTERS = {"T": "TRACE", "V": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARNING", "E": "ERROR", "F": "CRITICAL", "C": "CRITICAL"}
NAMED = {word: level for level, words in LEVELS.items() for word in words}
#: Names of the keys in key=value and JSON layouts (fixed values).
LEVEL_KEYS = {"level", "lvl", "severity", "levelname", "loglevel"}
TIME_KEYS = {"ts", "time", "timestamp", "@timestamp", "datetime", "asctime", "date", "t"}
COMPONENT_KEYS = {"component", "logger", "module", "source", "service", "name", "caller", "subsystem"}
MESSAGE_KEYS = {"msg", "message", "event"}

_WORDS = "|".join(sorted(NAMED, key=len, reverse=True))
#: Anything that may be a severity; its line is looked at closely.
CANDIDATE = re.compile(rf"(?<![A-Za-z])(?:{_WORDS})(?![A-Za-z])|^[A-Z]\d{{4}} \d|(?<=[\[|<( ])[TVDIWEFC](?=[\]|>)/ ])", re.I | re.M)
_CLOCK = r"\d{1,2}:\d\d:\d\d(?:[.,]\d+)?"
_TIME = rf"\d{{4}}[-/.]\d\d[-/.]\d\d[T ]{_CLOCK}(?: ?(?:Z|UTC|[+-]\d\d:?\d\d))?|\d\d[-/.]\d\d(?:[-/.]\d{{2,4}})?[T ]{_CLOCK}|(?:[A-Z][a-z]{{2}} )?[A-Z][a-z]{{2}} [ \d]\d {_CLOCK}(?: \d{{4}})?|{_CLOCK}|\d{{10}}(?:\.\d+|\d{{3}})?(?![\d.])"
TOKEN = re.compile(rf"(?P<G>(?<![^\n])[TVDIWEFC](?=\d{{4}} {_CLOCK}))|(?P<T>(?:(?<![^A-Z\n])\d{{4}} {_CLOCK})|{_TIME})|(?P<N>[A-Za-z_@][\w.\-/]*)|(?P<D>\d[\w.]*)|(?P<S>[ \t]+)|(?P<P>.)")
#: Keys, strings, other values and marks of a JSON line; pairs of a key=value line.
JSON_TOKEN = re.compile(r'"(?P<K>(?:[^"\\]|\\.)*)"(?=\s*:)|"(?P<V>(?:[^"\\]|\\.)*)"?|(?P<W>[^\s",:{}\[\]]+)|(?P<P>.)')
PAIR = re.compile(r'(?<![^\s,;|(\[{])(?P<K>[A-Za-z_@][\w.\-/@]*)=(?:"(?P<V>(?:[^"\\]|\\.)*)"?|(?P<W>[^\s,;")\]}]*))|"(?:[^"\\]|\\.)*"')
_CLOCKED = re.compile(_TIME)
_NUMBER = re.compile(r"\d[\w.]*")
#: JSON, or key=value, the latter also behind a time.
_STRUCTURED = re.compile(rf'\{{|"[^"]*"|(?P<lead>[\[(]?(?:{_TIME})[\])]?[ \t|-]+)?[A-Za-z_@][\w.\-/@]*=')


class Template:
    """A header: its masked tokens, and the positions of the fields."""

    __slots__ = ("component", "end", "level", "time", "tokens")

    def __init__(self, tokens, level, time, component, end):
        self.tokens, self.level, self.time, self.component, self.end = list(tokens), level, time, component, end


def _mask(match: re.Match) -> str:
    kind, text = match.lastgroup, match.group()
    if kind == "T":
        return "<TIME>"
    if kind == "G":
        return "<LETTER>"
    if kind == "D":
        return "<NUM>"
    if kind == "S":
        return " "
    if kind == "N":
        low = text.lower()
        if low in NAMED:
            return "<LEVEL>" if text.isupper() else "<level>"
        if low in LEVEL_KEYS | TIME_KEYS | COMPONENT_KEYS | MESSAGE_KEYS | {"pid"}:
            return low
        return text if len(text) == 1 and text in LETTERS else "<NAME>"
    return text


def _pairs(line: str) -> list[tuple[int, str, int, int]]:
    """(depth, key, start and end of the value without quotes) of a JSON or key=value line; inner objects as they come."""
    out = []
    if line[0] not in '{"':
        for m in PAIR.finditer(line):
            if m["K"]:
                out.append((0, m["K"].lower(), *m.span("V" if m["V"] is not None else "W")))
        return out
    depth, key = 0, None
    for m in JSON_TOKEN.finditer(line):
        kind = m.lastgroup
        if kind == "K":
            key = m["K"].lower()
        elif kind in "VW":
            if key is not None and m.group() != "null":
                out.append((depth, key, *m.span(kind)))
            key = None
        elif m["P"] in "{[":
            depth, key = depth + 1, None
        elif m["P"] in "}]":
            depth, key = depth - 1, None
    return out


def _structured(line: str) -> tuple[Template, list[tuple[int, int]], tuple[int, int] | None] | None:
    """(template, spans of its tokens, span of the message) of a JSON or key=value line; None if it starts no entry."""
    pairs = _pairs(line)

    def first(keys: set[str], good) -> tuple[int, int] | None:
        own = [(depth, a, b) for depth, key, a, b in pairs if key in keys and b > a and good(line[a:b])]
        return min(own)[1:] if own else None

    level = first(LEVEL_KEYS, lambda v: v.lower() in NAMED or v in LETTERS)
    if level is None:
        return None
    time = first(TIME_KEYS, lambda v: _CLOCKED.match(v) or _NUMBER.match(v))
    component = first(COMPONENT_KEYS, lambda v: v.strip())
    message = first(MESSAGE_KEYS, lambda v: v.strip())
    keyed = {"level": level, "time": time, "component": component, "message": message}
    if time is not None:
        a, b = time
        keyed["time"] = a, a + len((_CLOCKED.match(line[a:b]) or _NUMBER.match(line[a:b])).group())
    else:
        found = next((m for m in _CLOCKED.finditer(line) if message is None or not message[0] <= m.start() < message[1]), None) or _CLOCKED.search(line)
        keyed["time"] = found and found.span()
    if component is not None and line[0] not in '{"':  # the line number goes with the component
        a, b = component
        keyed["component"] = a, a + len(re.sub(r":\d+$", "", line[a:b]))
    if keyed["time"] is None and component is None:
        return None
    # fields and keys keep their place in the template, all other values are one token each
    spots = {span: name for name, span in keyed.items() if span and name != "message"}
    values = {(a, b) for _, _, a, b in pairs if b > a and (a, b) not in (level, time, component)}
    if keyed["time"] and any(a <= keyed["time"][0] < b for a, b in values):
        values = {(a, b) for a, b in values if not a <= keyed["time"][0] < b}
    tokens, spans, at, places = [], [], 0, {}

    def plain(stop: int) -> None:
        for m in TOKEN.finditer(line, at, stop):
            tokens.append(_mask(m))
            spans.append(m.span())

    for (a, b), name in sorted([*spots.items(), *((v, "") for v in values)]):
        if a < at:
            continue
        plain(a)
        word = line[a:b]
        places[name] = len(tokens)
        tokens.append({"level": ("<LEVEL>" if word.isupper() else "<level>") if word.lower() in NAMED else word, "time": "<TIME>" if _CLOCKED.match(word) else "<NUM>", "component": "<NAME>", "": "<*>"}[name])
        spans.append((a, b))
        at = b
    plain(len(line))
    level, time, component = (places.get(x) for x in ("level", "time", "component"))
    end = max(x for x in (level, time, component) if x is not None) + 1
    if component == end - 1 and tokens[end : end + 2] == [":", "<NUM>"]:
        end += 2
    while end < len(tokens) and tokens[end] in (" ", ":", "]", ")", "|", ">", "-"):
        end += 1
    if message is not None and line[0] not in '{"' and line[message[0] - 1] != '"':  # unquoted: up to the next field
        known = LEVEL_KEYS | TIME_KEYS | COMPONENT_KEYS | MESSAGE_KEYS
        later = [m.start() for m in PAIR.finditer(line, message[1]) if m["K"] and m["K"].lower() in known]
        message = message[0], message[0] + len(line[message[0] : min([*later, len(line)])].rstrip())
    return Template(tokens[:end], level, time, component, end), [*spans, (len(line), len(line))][: end + 1], message


def _keyed(tokens: tuple[str, ...], keys: set[str]) -> int | None:
    """Position of the value of the first key=value or "key": "value" with one of the keys."""
    for i, t in enumerate(tokens):
        if t not in keys:
            continue
        j = i + 1
        if j < len(tokens) and tokens[j] == '"':
            j += 1
        if j < len(tokens) and tokens[j] in "=:":
            j += 1
            while j < len(tokens) and tokens[j] in (" ", '"'):
                j += 1
            if j < len(tokens) and j > i + 1:
                return j
    return None


def _prose(tokens: tuple[str, ...], begin: int = 0) -> int:
    """Where the first three words in a row, outside of brackets, begin; the number of tokens if nowhere."""
    depth, words = 0, []
    for i in range(begin, len(tokens)):
        t = tokens[i]
        if t in "([<" or t in ")]>":
            depth, words = max(depth + (1 if t in "([<" else -1), 0), []
        elif t == " " or depth:
            continue
        elif t[0].isalpha() or t == "<NAME>":
            words.append(i)
            if len(words) == 3:
                return words[0]
        else:
            words = []
    return len(tokens)


def locate(tokens: tuple[str, ...]) -> Template | None:
    """Where the fields are in a masked plain line; None if it starts no entry.

    A severity counts where it is in capitals, a lone delimited letter, a keyed value,
    in brackets or before a colon; it must come with a time or a component. A component
    stands before the prose that follows the severity.
    """
    at = lambda i: tokens[i] if 0 <= i < len(tokens) else ""
    beside = lambda i: time is not None or all(x in " []():|-/>" for x in tokens[level + 1 : i])
    opening = next((t for t in tokens[:3] if t not in ("[", "(", "<", " ")), "")
    stop = len(tokens) if opening in ("<TIME>", "<LEVEL>", "<level>", "<LETTER>") else _prose(tokens)
    time = next((i for i, t in enumerate(tokens) if t == "<TIME>"), None)
    keyed = _keyed(tokens[:stop], LEVEL_KEYS)
    if keyed is not None and at(keyed) not in ("<LEVEL>", "<level>", *LETTERS):
        keyed = None
    level = None
    for i, t in enumerate(tokens):
        if i >= stop and t != "<LEVEL>":
            continue
        before, after = at(i - 1), at(i + 1)
        if i == keyed or t == "<LETTER>" or t == "<LEVEL>" and after in ("", " ", ":", "]", ")", "|", ">", "-", "/") or t == "<level>" and (after in (":", "]", ">") or before in ("[", "<")) or t in LETTERS and (before, after) in (("[", "]"), ("<", ">"), ("(", ")")):
            level = i
            break
        if t in LETTERS and before == " " and after in (" ", "/") and time is not None and time < i:
            level = i
            break
    if level is None:
        return None
    stop = _prose(tokens, level + 1)
    names = ("<NAME>", *COMPONENT_KEYS, *MESSAGE_KEYS, *TIME_KEYS, *LEVEL_KEYS)
    component = _keyed(tokens[:stop], COMPONENT_KEYS)
    if component is None:
        for i, t in enumerate(tokens[:stop]):
            if t not in names or i == level or not beside(i):
                continue
            before, after = at(i - 1), at(i + 1)
            if before == "[" and at(i - 2) in ("", " ", "]", ")", ":") and (after == "]" or after == ":" and at(i + 3) == "]"):  # [name] [file:12]
                component = i
            elif before == "(" and after == " " and at(i + 2) == "pid":  # (name pid=1)
                component = i
            elif after == "[" and at(i + 2) == "<NUM>" and at(i + 3) == "]":  # name[12]:
                component = i
            elif after == ":" and at(i + 2) == "<NUM>" and at(i + 3) == "]":  # file:12]
                component = i
            elif before == ":" and i - 2 == level and after == ":":  # LEVEL:name:
                component = i
            elif before in (" ", "/") and i - 2 == level and after == ":" and (time is not None or before == "/" or at(level) == "<LEVEL>"):  # time LEVEL name:
                component = i
            elif before == " " and after == " " and at(i - 2) == at(i + 2) and at(i - 2) in ("-", "|") and time is not None:  # - name -
                component = i
            if component is not None:
                break
    if time is None and component is None:
        return None
    end = max(x for x in (level, time, component) if x is not None and (x != time or x < stop)) + 1  # a later time is the message's
    if component == end - 1 and (at(end), at(end + 1)) in ((":", "<NUM>"), ("[", "<NUM>")):
        end += 2  # the line number or process id goes with the component
    while end < len(tokens) and tokens[end] in (" ", ":", "]", ")", "|", ">", "-"):
        end += 1
    return Template(tokens[:end], level, time, component, end)


#: Leading tokens that the tree routes by; share of a leaf's lines that decides a position.
DEPTH, VOTE = 4, 0.6
#: Headers of more tokens are templates of their own (no lines are left out for that).
LONGEST = 256
#: Leaves whose template moves a field: layouts are few; beyond this many they are refused.
MAX_LEAVES = 100_000
_CLOSERS, _OPENERS = (":", "[", "]", ")", "|", ">", "/"), ("-", "|", ">", "[", "(", "<", ":")
SEVERITY = {"<LEVEL>", "<level>", "<LETTER>", *LETTERS}


def _variable(token: str) -> bool:
    return token[0] == "<" and len(token) > 1 or token[0].isalpha()


def header(tokens: tuple[str, ...]) -> int:
    """How many tokens of a masked plain line are its header: up to the message behind its first severity; 0 without one.

    The message begins with the first word or number, outside of brackets, that no delimiter follows.
    """
    for kinds in (("<LEVEL>", "<LETTER>"), ("<level>",), tuple(LETTERS)):
        level = next((i for i, t in enumerate(tokens) if t in kinds), None)
        if level is not None:
            break
    else:
        return 0
    depth = 0
    at = lambda i: tokens[i] if i < len(tokens) else ""
    for i in range(level + 1, len(tokens)):
        t = tokens[i]
        if t in "([<" or t in ")]>":
            depth = max(depth + (1 if t in "([<" else -1), 0)
        elif not depth and t != "<TIME>" and _variable(t) and at(i + 1) not in _CLOSERS and not (at(i + 1) == " " and at(i + 2) in _OPENERS):
            return i
    return len(tokens)


def leaf_of(head: tuple[str, ...]) -> str:
    """The leaf of a header: number of tokens, leading tokens, delimiters."""
    lead = ["<LEVEL>" if t == "<level>" else "<LETTER>" if t in LETTERS else t for t in head[:DEPTH]]
    return "\t".join((str(len(head)), *lead, "".join("*" if _variable(t) else t for t in head[DEPTH:])))


class TemplateTree:
    """Routes masked lines to the templates of the corpus, and these to fields.

    templates: by leaf, the kind of token at each position, None for a wildcard.
    """

    def __init__(self, templates: dict[str, list[str | None]] | None = None, most_cached: int = 200_000, longest_cached: int = 100):
        self.templates, self.most_cached, self.longest_cached = templates or {}, most_cached, longest_cached
        self.known: dict[tuple, Template | None] = {}

    def route(self, tokens: tuple[str, ...]) -> Template | None:
        if tokens in self.known:
            return self.known[tokens]
        found = self.by_template(tokens) or locate(tokens)
        if len(tokens) <= self.longest_cached:
            if len(self.known) >= self.most_cached:
                self.known.clear()
            self.known[tokens] = found
        return found

    def by_template(self, tokens: tuple[str, ...]) -> Template | None:
        """The fields by the template of the line's leaf, if there is one and the line fits it."""
        n = header(tokens) if self.templates else 0
        merged = self.templates.get(leaf_of(tokens[:n])) if n else None
        if merged is None:
            return None
        return fields_by(tuple(m or t for m, t in zip(merged, tokens)) + tokens[n:], tokens)


def fields_by(template: tuple[str, ...], tokens: tuple[str, ...]) -> Template | None:
    """The fields of a template, if the line has a severity and a time in their places."""
    found = locate(template)
    if found is None or tokens[found.level] not in SEVERITY or found.time is not None and tokens[found.time] != "<TIME>":
        return None
    return found


def _plain_lines(value: str) -> Iterator[str]:
    """The unindented candidate lines of a value that are neither JSON nor key=value."""
    for begin, stop in _candidates(value):
        line = value[begin:stop]
        structured = _STRUCTURED.match(line)
        if structured is None or structured["lead"] is not None and _structured(line) is None:
            yield line


def mined(kept: DataFrame) -> DataFrame:
    """(leaf, header, n): every masked header of the corpus with its number of lines."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            for k in range(len(FIELDS)):
                for value in batch.column(k).to_pylist():
                    for line in _plain_lines(value) if value else ():
                        tokens = tuple(_mask(m) for m in TOKEN.finditer(line))
                        n = header(tokens)
                        if 0 < n <= LONGEST:
                            counts[tokens[:n]] = counts.get(tokens[:n], 0) + 1
            heads = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([leaf_of(h) for h in heads], pa.string()), pa.array([list(h) for h in heads], pa.list_(pa.string())), pa.array([counts[h] for h in heads], pa.int64())], ["leaf", "header", "n"])

    return kept.select(*FIELDS).mapInArrow(mine, "leaf string, header array<string>, n bigint").groupBy("leaf", "header").agg(F.sum("n").alias("n"))


def templates(kept: DataFrame) -> dict[str, list[str | None]]:
    """The merged templates by leaf, of leaves where a template moves a field of some header."""
    heads = cut_lineage(mined(kept))  # as many rows as there are headers; read twice
    votes = heads.select("leaf", "n", F.posexplode("header").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.sum("n").alias("n"))
    most = votes.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("m"), F.sum("n").alias("all"))
    decided = F.when(F.col("m.n") >= VOTE * F.col("all"), F.col("m.token"))
    merged = most.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", decided.alias("token")))).alias("t"))  # as long as a header
    merged = merged.select("leaf", F.col("t.token").alias("template"))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = lambda x: x and (x.level, x.time, x.component)
        for batch in batches:
            keep = []
            for i, (head, template) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = tuple(head)
                found = fields_by(tuple(m or t for m, t in zip(template, own)), own)
                if found is not None and places(found) != places(locate(own)):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    differ = heads.join(merged, "leaf").where("header <> template").select("leaf", "header", "template")
    found = differ.mapInArrow(moved, differ.schema).select("leaf", "template").distinct().limit(MAX_LEAVES + 1).collect()
    if len(found) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} layouts of log lines")
    return {r.leaf: list(r.template) for r in found}


def _line_start(tree: TemplateTree, line: str):
    """(template, spans of the line's tokens, span of a keyed message) of a line that starts an entry, or None."""
    structured = _STRUCTURED.match(line)
    if structured:
        found = _structured(line)
        if found or structured["lead"] is None:
            return found
    matches = list(TOKEN.finditer(line))
    template = tree.route(tuple(map(_mask, matches)))
    return None if template is None else (template, [m.span() for m in matches], None)


def _candidates(value: str) -> Iterator[tuple[int, int]]:
    """(begin, stop) of the unindented lines that may hold a severity."""
    seen = -1
    for m in CANDIDATE.finditer(value):
        if m.start() < seen:
            continue
        begin = value.rfind("\n", 0, m.start()) + 1
        stop = value.find("\n", begin)
        stop = len(value) if stop < 0 else stop
        seen = stop
        if not value[begin].isspace():
            yield begin, stop


def entries(tree: TemplateTree, value: str) -> list[tuple[int, int, Template, tuple, tuple[int, int]]]:
    """(first_line, last_line, template, (spans, message), (begin, stop)) of each entry of a value; lines count from 1."""
    starts = []
    for begin, stop in _candidates(value):
        found = _line_start(tree, value[begin:stop])
        if found:
            starts.append((begin, found))
    if not starts:
        return []
    out, line, at = [], 1, 0
    numbered = []
    for begin, found in starts:
        line += value.count("\n", at, begin)
        at = begin
        numbered.append(line)
    last = value.rstrip().count("\n") + 1
    for k, (begin, (template, spans, message)) in enumerate(starts):
        to = numbered[k + 1] - 1 if k + 1 < len(starts) else last
        stop = starts[k + 1][0] - 1 if k + 1 < len(starts) else len(value)
        out.append((numbered[k], to, template, (spans[: max(template.end, template.time or 0) + 1], message), (begin, stop)))
    return out


def _fields(template: Template, spans: list[tuple[int, int]], told: tuple[int, int] | None, text: str) -> tuple[str | None, str, str | None, str]:
    """(timestamp, level, component, message) of an entry's text."""
    first, _, more = text.partition("\n")
    group = lambda i: None if i is None else first[slice(*spans[i])]
    word = group(template.level)
    level = LETTERS.get(word) or NAMED[word.lower()]
    time, component, message = group(template.time), group(template.component), None
    if first.startswith("{"):
        try:
            record = json.loads(first)
            low = {str(k).lower(): v for k, v in record.items()}
            pick = lambda keys: next((str(low[k]) for k in sorted(keys) if low.get(k) is not None), None)
            time, component, message = pick(TIME_KEYS) or time, pick(COMPONENT_KEYS) or component, pick(MESSAGE_KEYS)
        except ValueError:
            pass
    if message is None and told is not None:
        message = first[slice(*told)]
    if message is None:
        message = first[spans[template.end][0] :] if template.end < len(spans) else first[spans[template.end - 1][1] :]
    message = message.rstrip("\r")
    return time, level, component, message + ("\n" + more.rstrip() if more.strip() else "")


SPANS = "trajectory_id string, event_index int, field string, first_line int, last_line int"
ENTRIES = SPANS + ", timestamp string, level string, component string, message string, template string"


def _rows(events: DataFrame, with_fields: bool) -> DataFrame:
    kept = events.select("trajectory_id", "event_index", *FIELDS).where(" or ".join(f"{c} is not null" for c in FIELDS))
    learned = templates(kept)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree(learned)
        for batch in batches:
            trajectories, indexes = batch.column(0), batch.column(1)
            at, fields, firsts, lasts, rest = [], [], [], [], [[] for _ in range(5)]
            for k, field in enumerate(FIELDS):
                for row, value in enumerate(batch.column(2 + k).to_pylist()):
                    if not value:
                        continue
                    for first, last, template, places, (begin, stop) in entries(tree, value):
                        at.append(row)
                        fields.append(field)
                        firsts.append(first)
                        lasts.append(last)
                        if with_fields:
                            for column, x in zip(rest, (*_fields(template, *places, value[begin:stop]), "".join(template.tokens[: template.end]))):
                                column.append(x)
            take = pa.array(at, pa.int64())
            columns = [trajectories.take(take), indexes.take(take), pa.array(fields, pa.string()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())]
            names = ["trajectory_id", "event_index", "field", "first_line", "last_line"]
            if with_fields:
                columns += [pa.array(x, pa.string()) for x in rest]
                names += ["timestamp", "level", "component", "message", "template"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.mapInArrow(parse, ENTRIES if with_fields else SPANS)


def entry_spans(events: DataFrame) -> DataFrame:
    """p7_found: (trajectory_id, event_index, field, first_line, last_line)."""
    return _rows(events, False).distinct()


def log_entries(events: DataFrame) -> DataFrame:
    """Every entry with its lines, timestamp, level, component, message and template."""
    return _rows(events, True).dropDuplicates(["trajectory_id", "event_index", "field", "first_line", "last_line"])


def log_templates(events: DataFrame) -> DataFrame:
    """(template, n_entries, n_levels): the layouts found, by their header as merged."""
    return log_entries(events).groupBy("template").agg(F.count("*").alias("n_entries"), F.count_distinct("level").alias("n_levels"))
