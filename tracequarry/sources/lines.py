"""Logs as numbered lines, and lines as JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import ordered

#: Everything that ends a line for the recorders, not the line feed alone.
LINE_ENDS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\x{2028}\x{2029}]"


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, content): small files as rows; filters on path and length reach the scan."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "content")


def decoded(content: Column) -> Column:
    """UTF-8 with invalid bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): lines from 1; a final line end opens no line."""
    body = F.regexp_replace(F.col(text), rf"(?:{LINE_ENDS})\z", "")
    kept = texts.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return kept.select(key, F.posexplode(F.split(body, LINE_ENDS)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def json_object(line: Column) -> Column:
    """The JSON object of a line, from its start or from its first brace, as VARIANT; else null."""
    stripped = F.regexp_replace(line, r"^\s+|\s+$", "")
    parsed = F.try_parse_json(F.regexp_extract(stripped, r"(?s)(\{.*)", 1))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def records(numbered: DataFrame, key: str) -> DataFrame:
    """(key, line_no, rec, kind) of lines; kind is json, malformed, warning or blank."""
    rec = json_object(F.col("line"))
    kind = F.when(~F.col("line").rlike(r"\S"), "blank").when(rec.isNotNull(), "json").when(F.col("line").contains("{"), "malformed").otherwise("warning")
    return numbered.select(key, "line_no", rec.alias("rec"), kind.alias("kind"))


def line_counts(recs: DataFrame, key: str) -> DataFrame:
    """(key, lines, json_lines, malformed_json_lines, warnings)."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return recs.groupBy(key).agg(F.count("*").alias("lines"), of("json").alias("json_lines"), of("malformed").alias("malformed_json_lines"), of("warning").alias("warnings"))


#: Lines that open a block of a plain trace (fixed values).
TURN = r"(?i)(?:Assistant\s*[\x{2014}-]\s*turn\s*|turn\s+)(\d+)"
TOOL = r"(?i)Tool call\s*[\x{2014}:-]?\s*([^\n]+)"


def plain_blocks(numbered: DataFrame, key: str) -> DataFrame:
    """(key, block, kind, tool_name, text, line_start, line_end): turn and tool markers open blocks, other lines join them.

    Lines before the first marker belong to none; blank lines are left out.
    """
    marked = numbered.withColumn("kind", F.when(F.col("line").rlike(TURN), "assistant_text").when(F.col("line").rlike(TOOL), "tool_call"))
    counted = ordered.running_sum(marked, [key], "line_no", {"block": F.col("kind").isNotNull().cast("int")})
    own = counted.where((F.col("block") > 0) & F.col("line").rlike(r"\S"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.rtrim(x["line"])), "\n")
    grouped = own.groupBy(key, "block").agg(F.min_by("kind", "line_no").alias("kind"), F.min_by("line", "line_no").alias("head"), F.trim(body).alias("text"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))
    tool = F.when(F.col("kind") == "tool_call", F.trim(F.regexp_extract("head", TOOL, 1)))
    return grouped.select(key, (F.col("block") - 1).alias("block"), "kind", tool.alias("tool_name"), "text", "line_start", "line_end")


#: Token counts of an assistant message (fixed values).
USAGE = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]


def token_usage(numbered: DataFrame, key: str) -> DataFrame:
    """(key, messages, the four token sums, total_tokens) of the assistant messages in a log, whatever stands before their JSON.

    Lines are looked through for the type's text before any JSON is parsed.
    """
    likely = numbered.where(F.col("line").rlike(r'"type"\s*:\s*"assistant"'))
    rec = likely.select(key, json_object(F.col("line")).alias("rec")).where(F.try_variant_get("rec", "$.type", "string") == "assistant")
    used = rec.where(F.try_variant_get("rec", "$.message.usage", "variant").isNotNull())
    count = lambda c: F.sum(F.coalesce(F.try_variant_get("rec", f"$.message.usage.{c}", "bigint"), F.lit(0))).alias(c)
    out = used.groupBy(key).agg(F.count("*").alias("messages"), *[count(c) for c in USAGE])
    return out.withColumn("total_tokens", sum((F.col(c) for c in USAGE[1:]), F.col(USAGE[0])))


def required_rows(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows where a column has a value; none is an error."""
    kept = df.where(F.col(column) == value)
    if kept.isEmpty():
        raise ValueError(f"no rows with {column} = {value}")
    return kept
