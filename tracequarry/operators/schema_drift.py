"""Problem 4: schemas that drift between the files of a stream.

Each file gets a profile (its fields, the kinds of their values, what these look like)
and a fingerprint of it. Where a stream's fingerprint changes a new version begins, and
the explicit migration steps from the file before lead to it (renamed, removed, added,
retyped). Every file is then routed through the steps of its own stream that come after
it: the chain of renames gives each field its latest name, families of names unite the
streams, defaults and casts do the rest, and every rule a record goes through is recorded.

A rename pairs a vanished field with one that appears in the same file and holds the
same kind of content. How often two names are paired so is counted over the whole
corpus: a pair known from other files need only share a type, as a file shows little of
a field; but not if the names mostly stand side by side.

Defined results
* rows of one (log_stream, file_seq, line_no) count once; rows with a null among these
  three are left out;
* a record that is null, blank, no JSON or no object has no fields; it still makes its
  file exist, and comes out as a row of nulls with the rule ``unreadable``;
* a field whose values are all null exists but has no type, so it is never retyped;
* of several possible partners a vanished field is renamed to the most alike one;
* two fields of one file never meet in one column: a stream that holds two names of a
  family in one file keeps them apart, in all its files;
* a value that can't be cast is null in its column, has the rule ``cast_failed`` and
  stands in ``rejected``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.blocks import blocked_lag
from tracequarry.operators.ordered import asof_backward, running_sum
from tracequarry.session import cut_lineage

FILE = ["log_stream", "file_seq"]
#: Distinct field names (and pairs of them) are schema, not data; beyond this many they are refused.
MAX_FIELD_NAMES = 20_000
#: The key whose direct children count as fields of their own.
NESTED = "task_args"
#: A pair needs so much of shared looks, overlap of numbers, likeness of names and support (each from 0 to 1).
LEAST_SCORE = 0.75
#: Names that stand side by side in so many times more files than they are paired in have no support.
TOGETHER_TIMES = 2
#: A text that is a number; others are not cast, as a failing cast is dear.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: Looks of scalars are bits of their own; schemas of arrays and objects share the others by hash.
LOOKS = ["number", "time", "sentence", "path", "word", "plain"]
_HASHED = 63 - len(LOOKS)
_PROFILE = "array<struct<field:string,kinds:array<struct<kind:string,looks:bigint,low:double,high:double,n:bigint>>>>"


def _placed(raw: DataFrame) -> DataFrame:
    return raw.where("log_stream is not null and file_seq is not null and line_no is not null")


def unique_records(raw: DataFrame) -> DataFrame:
    """One row per (log_stream, file_seq, line_no), with the record as VARIANT."""
    one = _placed(raw).groupBy(*FILE, "line_no").agg(F.min(F.struct("ingested_at", "record")).alias("r"))
    return one.select(*FILE, "line_no", F.try_parse_json(F.col("r.record")).alias("v"))


def _kind(schema: Column) -> Column:
    """string, integer, decimal, boolean, array, object of a VARIANT's schema; null for a JSON null."""
    return (
        F.when(schema.isNull() | (schema == "VOID"), None).when(schema == "STRING", "string").when(schema == "BIGINT", "integer").when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("DECIMAL") & schema.endswith(",0)"), "integer").otherwise("decimal")
    )


def record_fields(records: DataFrame) -> DataFrame:
    """(log_stream, file_seq, field, value, kind, schema): top-level keys and those in task_args; a null field for a record without any.

    Records are parsed and opened in one pass.
    """
    spark = records.sparkSession
    objects = records.select(*FILE, F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")).alias("v"))
    top = spark.sql("SELECT d.log_stream, d.file_seq, t.key AS field, t.value AS value FROM {d} AS d, LATERAL variant_explode_outer(d.v) AS t", d=objects)
    opened = spark.sql(
        f"SELECT d.log_stream, d.file_seq, d.field, d.value, t.pos AS pos, t.key AS inner_key, t.value AS inner_value FROM {{d}} AS d, "
        f"LATERAL variant_explode_outer(CASE WHEN d.field = '{NESTED}' AND schema_of_variant(d.value) LIKE 'OBJECT%' THEN d.value END) AS t",
        d=top,
    )
    own = F.struct("field", "value")
    inner = F.struct(F.concat(F.lit(f"{NESTED}."), "inner_key").alias("field"), F.col("inner_value").alias("value"))
    each = F.when(F.col("pos").isNull(), F.array(own)).when(F.col("pos") == 0, F.array(own, inner)).otherwise(F.array(inner))
    found = opened.select(*FILE, F.explode(each).alias("x")).select(*FILE, "x.field", "x.value")
    return found.withColumn("schema", F.schema_of_variant("value")).withColumn("kind", _kind(F.col("schema")))


def _with_looks(fields: DataFrame) -> DataFrame:
    """Adds number, a value's number if it has one, and looks, the bit of the class of its content."""
    fields = fields.withColumn("text", F.when(F.col("kind") == "string", F.try_variant_get("value", "$", "string")))
    number = F.when(F.col("kind").isin("integer", "decimal"), F.try_variant_get("value", "$", "double")).when(F.col("text").rlike(NUMBER), F.col("text").try_cast("double"))
    fields = fields.withColumn("number", number)
    shape = F.regexp_replace("schema", r"BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)", "NUMBER")
    look = (
        F.when(F.col("kind").isin("array", "object"), F.lit(len(LOOKS)) + F.pmod(F.xxhash64(shape), F.lit(_HASHED)))
        .when(F.col("number").isNotNull(), LOOKS.index("number"))
        .when(F.col("text").isNull(), LOOKS.index("plain"))
        .when(F.col("text").rlike(r"^\d{4}-\d\d-\d\d"), LOOKS.index("time"))
        .when(F.col("text").rlike(r"\s"), LOOKS.index("sentence"))
        .when(F.col("text").rlike(r"[/:]"), LOOKS.index("path"))
        .otherwise(LOOKS.index("word"))
    )
    return fields.withColumn("looks", F.when(F.col("kind").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), look.cast("int"))))


def file_profiles(raw: DataFrame) -> DataFrame:
    """(log_stream, file_seq, fields, fingerprint): one row a file, fields sorted by name, each with its kinds.

    Sets and ranges are the same whether a record comes once or twice, so records are
    not merged first: texts are parsed where they are read and never shuffled. A hot
    file combines before the shuffle; what remains of a file is as long as its schema.
    The profiles are small (a row a file) and read several times: written once.
    """
    parsed = _placed(raw).select(*FILE, F.try_parse_json("record").alias("v"))
    stats = _with_looks(record_fields(parsed)).groupBy(*FILE, "field", "kind").agg(F.bit_or("looks").alias("looks"), F.min("number").alias("low"), F.max("number").alias("high"), F.count("*").alias("n"))
    one = F.struct("kind", "looks", "low", "high", "n")
    files = stats.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", one.alias("k"))))).alias("ks"))
    names = F.array_distinct(F.col("ks.field"))
    fields = F.transform(names, lambda f: F.struct(f.alias("field"), F.filter(F.transform(F.filter("ks", lambda x: x["field"] == f), lambda x: x["k"]), lambda k: k["kind"].isNotNull()).alias("kinds")))
    files = files.select(*FILE, fields.cast(_PROFILE).alias("fields"))
    told = F.transform("fields", lambda f: F.concat_ws(":", f["field"], F.array_join(_names(f["kinds"]), "|")))
    return cut_lineage(files.withColumn("fingerprint", F.sha2(F.array_join(told, ","), 256)))


def _names(kinds: Column) -> Column:
    return F.transform(kinds, lambda k: k["kind"])


def _steps(profiles: DataFrame) -> DataFrame:
    """Files that follow one of their stream with another fingerprint: gone, come (fields) and retyped (field, old and new kinds)."""
    both = blocked_lag(profiles, ["log_stream"], "file_seq", F.struct("fields", "fingerprint"), "b").where("b.fingerprint <> fingerprint")
    lacks = lambda a, b: F.filter(a, lambda f: ~F.array_contains(F.transform(b, lambda g: g["field"]), f["field"]))
    at = lambda fields, name: F.element_at(F.filter(fields, lambda g: g["field"] == name), 1)["kinds"]
    pairs = F.transform(F.filter("b.fields", lambda f: F.array_contains(F.col("fields.field"), f["field"])), lambda f: F.struct(f["field"].alias("field"), _names(f["kinds"]).alias("old"), _names(at(F.col("fields"), f["field"])).alias("new")))
    retyped = F.filter(pairs, lambda p: (F.size(p["old"]) > 0) & (F.size(p["new"]) > 0) & (p["old"] != p["new"]))
    return both.select(*FILE, lacks(F.col("b.fields"), F.col("fields")).alias("gone"), lacks(F.col("fields"), F.col("b.fields")).alias("come"), retyped.alias("retyped"))


def _likeness(a: Column, b: Column) -> Column:
    """struct(kind, name, content) of two fields: whether they share a type, how alike names and content are (null where content is not)."""
    shared = F.filter(F.transform(a["kinds"], lambda k: F.struct(k.alias("k"), F.element_at(F.filter(b["kinds"], lambda o: o["kind"] == k["kind"]), 1).alias("o"))), lambda x: x["o"].isNotNull())

    def score(x: Column) -> Column:
        k, o = x["k"], x["o"]
        looks = F.bit_count(k["looks"].bitwiseAND(o["looks"])) / F.bit_count(k["looks"].bitwiseOR(o["looks"]))
        wide = lambda c, up: c + (1 if up else -1) * (0.25 * F.abs(c) + 1e-9)
        apart = F.coalesce((wide(k["high"], True) < wide(o["low"], False)) | (wide(o["high"], True) < wide(k["low"], False)), F.lit(False))
        span = F.greatest(k["high"], o["high"]) - F.least(k["low"], o["low"])
        common = F.least(k["high"], o["high"]) - F.greatest(k["low"], o["low"])
        overlap = F.coalesce(F.when(span > 0, F.greatest(common, F.lit(0.0)) / span), F.lit(1.0))
        return F.when((looks > 0) & ~apart, looks + overlap)

    name = 1 - F.levenshtein(F.lower(a["field"]), F.lower(b["field"])) / F.greatest(F.length(a["field"]), F.length(b["field"]), F.lit(1))
    return F.struct((F.size(shared) > 0).alias("kind"), name.alias("name"), F.array_max(F.transform(shared, score)).alias("content"))


def _pairs(steps: DataFrame) -> DataFrame:
    """Adds pairs: each vanished field with each new one of its level that shares a type (as many as the schema has)."""
    level = lambda f: f["field"].startswith(NESTED + ".")
    both = F.flatten(F.transform("gone", lambda a: F.transform(F.filter("come", lambda b: level(a) == level(b)), lambda b: F.struct(a["field"].alias("old"), b["field"].alias("new"), _likeness(a, b).alias("l")))))
    return steps.withColumn("pairs", F.filter(both, lambda p: p["l"]["kind"]))


def _few(df: DataFrame, what: str) -> list:
    """Rows of a table that is as long as the schema; its size is checked."""
    rows = df.limit(MAX_FIELD_NAMES + 1).collect()
    if len(rows) > MAX_FIELD_NAMES:
        raise ValueError(f"more than {MAX_FIELD_NAMES} {what}: field names look like data")
    return rows


def _support(profiles: DataFrame, paired: DataFrame) -> dict[tuple[str, str], int]:
    """In how many files two names are paired by content, in either direction; 0 if they stand side by side in many more."""
    each = paired.select(F.explode("pairs").alias("p")).groupBy(F.least("p.old", "p.new").alias("a"), F.greatest("p.old", "p.new").alias("b")).agg(F.count_if(F.col("p.l.content").isNotNull()).alias("n"))
    support = {(r.a, r.b): r.n for r in _few(each, "pairs of names")}
    if not support:
        return {}
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(support)])
    beside = F.filter(known, lambda p: F.array_contains(F.col("fields.field"), p["a"]) & F.array_contains(F.col("fields.field"), p["b"]))
    for r in profiles.select(F.explode(beside).alias("p")).groupBy("p.a", "p.b").count().collect():  # of the pairs above
        if r["count"] > TOGETHER_TIMES * support[r.a, r.b]:
            support[r.a, r.b] = 0
    return support


def _greedy(pairs: Column) -> Column:
    """From scored pairs, best first, those whose names are still free."""
    zero = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<old:string,new:string>>").alias("picked"))
    ordered = F.array_sort(pairs)

    def step(acc, x):
        taken = F.array_contains(acc["used"], F.concat(F.lit("-"), x["old"])) | F.array_contains(acc["used"], F.concat(F.lit("+"), x["new"]))
        more = F.struct(
            F.concat(acc["used"], F.array(F.concat(F.lit("-"), x["old"]), F.concat(F.lit("+"), x["new"]))).alias("used"),
            F.concat(acc["picked"], F.array(F.struct(x["old"].alias("old"), x["new"].alias("new")))).alias("picked"),
        )
        return F.when(taken, acc).otherwise(more)

    return F.aggregate(ordered, zero, step, lambda acc: acc["picked"])


def _changes(profiles: DataFrame) -> DataFrame:
    paired = _pairs(_steps(profiles))
    support = {k: n for k, n in _support(profiles, paired).items() if n}
    table = F.create_map(*[F.lit(x) for (a, b), k in sorted(support.items()) for x in (f"{a}\n{b}", k)]) if support else None

    def scored(p):
        k = F.lit(0) if table is None else F.coalesce(table[F.concat_ws("\n", F.least(p["old"], p["new"]), F.greatest(p["old"], p["new"]))], F.lit(0))
        score = F.coalesce(p["l"]["content"], F.lit(0.0)) + p["l"]["name"] + k / (k + 2)
        return F.struct((-score).alias("s"), p["old"].alias("old"), p["new"].alias("new"), k.alias("k"), p["l"]["content"].isNotNull().alias("alike"))

    fit = F.filter(F.transform("pairs", scored), lambda x: (x["alike"] | (x["k"] > 0)) & (x["s"] <= -LEAST_SCORE))
    done = paired.withColumn("renames", _greedy(fit))
    text = lambda kinds: F.array_join(kinds, "|")
    none = F.lit(None).cast("string")
    row = lambda field, kind, new, a, b: F.struct(field.alias("field"), F.lit(kind).alias("change_kind"), new.alias("new_name"), a.alias("old_kind"), b.alias("new_kind"))
    new_of = lambda f: F.element_at(F.filter("renames", lambda r: r["old"] == f["field"]), 1)["new"]
    renamed_from = F.transform("renames", lambda r: r["old"])
    renamed_to = F.transform("renames", lambda r: r["new"])
    rows = F.concat(
        F.transform("retyped", lambda f: row(f["field"], "retyped", none, text(f["old"]), text(f["new"]))),
        F.transform(F.filter("gone", lambda f: F.array_contains(renamed_from, f["field"])), lambda f: row(f["field"], "renamed", new_of(f), text(_names(f["kinds"])), none)),
        F.transform(F.filter("gone", lambda f: ~F.array_contains(renamed_from, f["field"])), lambda f: row(f["field"], "removed", none, text(_names(f["kinds"])), none)),
        F.transform(F.filter("come", lambda f: ~F.array_contains(renamed_to, f["field"])), lambda f: row(f["field"], "added", none, none, text(_names(f["kinds"])))),
    )
    return done.select(*FILE, F.explode(rows).alias("r")).select(*FILE, "r.*")


def schema_changes(raw: DataFrame) -> DataFrame:
    """(log_stream, file_seq, field, change_kind, new_name, old_kind, new_kind): the migration steps.

    file_seq is the file that changed; new_name is set for renames only.
    """
    return _changes(file_profiles(raw))


def field_steps(raw: DataFrame) -> DataFrame:
    """(log_stream, file_seq, field, step): fields gone, come and retyped against the file before, names unpaired."""
    steps = _steps(file_profiles(raw))
    named = lambda c, step: F.transform(c, lambda f: F.struct(f["field"].alias("field"), F.lit(step).alias("step")))
    return steps.select(*FILE, F.explode(F.concat(named("gone", "gone"), named("come", "come"), named("retyped", "retyped"))).alias("r")).select(*FILE, "r.*")


def file_versions(raw: DataFrame) -> DataFrame:
    """(log_stream, file_seq, version, fingerprint, n_fields): a stream's version grows where its fingerprint changes."""
    lag = blocked_lag(file_profiles(raw), ["log_stream"], "file_seq", F.struct("fingerprint"), "b")
    news = F.coalesce(F.col("b.fingerprint") != F.col("fingerprint"), F.lit(True)).cast("int")
    return running_sum(lag.withColumn("_new", news), ["log_stream"], "file_seq", {"version": F.col("_new")}).select(*FILE, "version", "fingerprint", F.size("fields").alias("n_fields"))


def _chained(changes: DataFrame) -> DataFrame:
    """(log_stream, field, file_seq, last_name): each rename with the name that its chain of later ones ends in.

    Chains are followed by doubling: each round a step's end becomes the end of the step it led to.
    """
    renames = changes.where("change_kind = 'renamed'").select("log_stream", F.col("file_seq").alias("k"), "field", "new_name")
    # the next rename of the new name: the latest of the negated positions
    left = renames.select("log_stream", F.col("new_name").alias("name"), (-F.col("k") - 1).alias("p"), "k", "field")
    right = renames.select("log_stream", F.col("field").alias("name"), (-F.col("k")).alias("p"), F.struct(F.col("k").alias("k"), F.col("field").alias("field")).alias("to"))
    steps = cut_lineage(asof_backward(left, right, ["log_stream", "name"], "p", ["to"]).select("log_stream", "k", "field", F.col("name").alias("last_name"), "to"))
    while not steps.where("to is not null").isEmpty():
        then = steps.select("log_stream", F.struct(F.col("k").alias("k"), F.col("field").alias("field")).alias("to"), F.col("last_name").alias("later"), F.col("to").alias("on"))
        joined = steps.join(then, ["log_stream", "to"], "left")
        steps = cut_lineage(joined.select("log_stream", "k", "field", F.coalesce("later", "last_name").alias("last_name"), F.col("on").alias("to")))
    return steps.select("log_stream", "field", F.col("k").alias("file_seq"), "last_name")


def rename_families(changes: DataFrame) -> dict[str, str]:
    """Every name that was renamed, with its family's one name: the one renamed away from most often.

    Distinct pairs of names are few (they are schema); their number is checked.
    """
    pairs = _few(changes.where("change_kind = 'renamed'").groupBy("field", "new_name").count(), "distinct renames")
    head: dict[str, str] = {}
    balance: dict[str, int] = {}

    def find(name: str) -> str:
        while head.setdefault(name, name) != name:
            name = head[name]
        return name

    for r in pairs:
        head[find(r.new_name)] = find(r.field)
        balance[r.field] = balance.get(r.field, 0) + r["count"]
        balance[r.new_name] = balance.get(r.new_name, 0) - r["count"]
    families: dict[str, list[str]] = {}
    for name in list(head):
        families.setdefault(find(name), []).append(name)
    return {n: min(names, key=lambda x: (-balance[x], x)) for names in families.values() for n in names}


def file_routes(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """(log_stream, file_seq, route): a file's fields with the columns they belong to, array<struct<field, name, kinds>>.

    A field takes the name its chain of renames ends in, then its family's, unless its
    stream holds two fields of that family in one file.
    """
    families = rename_families(changes)
    each = profiles.select(*FILE, F.posexplode("fields").alias("pos", "f")).select(*FILE, F.col("f.field").alias("field"), F.col("f.kinds").alias("kinds")).where(F.col("field") != NESTED)
    if not families:
        return each.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("field", F.col("field").alias("name"), "kinds"))).alias("route"))
    in_family = F.col("field").isin(sorted(families))
    steps = _chained(changes)
    # a rename in a later file: the latest of the negated positions before this one
    left = each.where(in_family).withColumn("p", -F.col("file_seq") - 1)
    right = steps.select("log_stream", "field", (-F.col("file_seq")).alias("p"), "last_name")
    moved = asof_backward(left, right, ["log_stream", "field"], "p", ["last_name"]).drop("p").withColumn("name", F.coalesce("last_name", "field")).drop("last_name")
    heads = F.create_map(*[F.lit(x) for pair in sorted(families.items()) for x in pair])
    moved = moved.withColumn("family", heads[F.col("name")])
    apart = moved.groupBy(*FILE, "family").count().where("count > 1").select("log_stream", "family").distinct().withColumn("apart", F.lit(True))
    named = moved.join(apart, ["log_stream", "family"], "left").withColumn("name", F.when(F.col("apart"), F.col("name")).otherwise(F.col("family"))).select(*FILE, "field", "kinds", "name")
    every = named.unionByName(each.where(~in_family).withColumn("name", F.col("field")))
    route = every.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("field", "name", "kinds"))).alias("route"))
    # should two fields of a file still have one name, each keeps its own
    clash = lambda x: F.size(F.filter("route", lambda y: y["name"] == x["name"])) > 1
    return route.select(*FILE, F.transform("route", lambda x: F.struct(x["field"].alias("field"), F.when(clash(x), x["field"]).otherwise(x["name"]).alias("name"), x["kinds"].alias("kinds"))).alias("route"))


_TYPES = {"integer": "bigint", "decimal": "double", "boolean": "boolean"}


def _path(field: str) -> str | None:
    """The VARIANT path of a field, or null where its name holds both kinds of quotes."""
    own = [NESTED, field.removeprefix(NESTED + ".")] if field.startswith(NESTED + ".") else [field]
    if any('"' in x and "'" in x for x in own):
        return None
    return "$" + "".join(f"['{x}']" if '"' in x else f'["{x}"]' for x in own)


def consistent_table(raw: DataFrame) -> DataFrame:
    """One row a record, in one schema: chained renames, null defaults, casts to each field's commonest type.

    Columns: the three keys; one column a field (bigint, double, boolean or string; JSON
    text for arrays and objects, and a scalar where arrays are commonest becomes an array
    of one); rules, the sorted migration rules that the record went through; rejected,
    values that could not be cast, as JSON text. A record meets its file's route in one
    join; all else happens within its row.
    """
    profiles = file_profiles(raw)
    routes = cut_lineage(file_routes(profiles, schema_changes_of(profiles)))
    told = routes.select(F.explode("route").alias("r")).select("r.field", "r.name", "r.kinds")
    counts = _few(told.select("field", "name", F.explode_outer("kinds").alias("k")).groupBy("field", "name", "k.kind").agg(F.sum("k.n").alias("n")), "fields")
    sources: dict[str, set[str]] = {}
    kinds: dict[str, dict[str, int]] = {}
    for r in counts:
        sources.setdefault(r.name, set()).add(r.field)
        if r.kind:
            kinds.setdefault(r.name, {})[r.kind] = kinds.get(r.name, {}).get(r.kind, 0) + r.n
    out = unique_records(raw).join(routes.select(*FILE, F.map_from_entries(F.transform("route", lambda x: F.struct(x["field"], x["name"]))).alias("_route")), FILE, "left")
    out = out.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    cells, rules, rejected = [], [], []
    for i, name in enumerate(sorted(sources)):
        own = [f for f in sorted(sources[name]) if _path(f)]
        if not own:
            continue
        target = max(sorted(kinds.get(name, {"string": 1}).items()), key=lambda x: x[1])[0]
        found = F.coalesce(*[F.when(F.col("_route")[f] == name, F.try_variant_get("v", _path(f), "variant")) for f in own])
        used = F.coalesce(*[F.when((F.col("_route")[f] == name) & F.try_variant_get("v", _path(f), "variant").isNotNull(), F.lit(f)) for f in own])
        out = out.withColumn(f"_v{i}", found).withColumn(f"_f{i}", used).withColumn(f"_k{i}", _kind(F.schema_of_variant(f"_v{i}")))
        value, kind, source = F.col(f"_v{i}"), F.col(f"_k{i}"), F.col(f"_f{i}")
        json = F.to_json(value)
        text = F.when(kind.isin("array", "object"), json).otherwise(F.try_variant_get(value, "$", "string"))
        if target == "array":
            cell = F.when(kind == "array", json).when(kind != "object", F.concat(F.lit("["), json, F.lit("]")))
        elif target == "object":
            cell = F.when(kind == "object", json)
        elif target == "string":
            cell = text
        else:
            cell = F.when(~kind.isin("array", "object"), text).try_cast(_TYPES[target])
        cells.append(cell.alias(name))
        cast = F.when(kind != target, F.concat(F.when(cell.isNull(), F.lit("cast_failed ")).otherwise(F.lit("cast ")), F.lit(f"{name} from "), kind, F.lit(f" to {target}")))
        rules += [F.when(source != name, F.concat(F.lit("rename "), source, F.lit(f" to {name}"))), cast, F.when(value.isNull() & F.col("v").isNotNull(), F.lit(f"default {name}"))]
        rejected.append(F.struct(F.lit(name).alias("key"), F.when(kind.isNotNull() & cell.isNull(), json).alias("value")))
    unreadable = F.when(F.col("v").isNull(), F.array(F.lit("unreadable")))
    listed = F.array_sort(F.array_compact(F.array(*rules))) if rules else F.array().cast("array<string>")
    kept = F.map_from_entries(F.filter(F.array(*rejected), lambda x: x["value"].isNotNull())) if rejected else F.create_map().cast("map<string,string>")
    return out.select(*FILE, "line_no", *cells, F.coalesce(unreadable, listed).alias("rules"), kept.alias("rejected"))


def schema_changes_of(profiles: DataFrame) -> DataFrame:
    """The migration steps of profiled files, written once."""
    return cut_lineage(_changes(profiles))
