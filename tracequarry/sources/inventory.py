"""Run directories, their artifacts, and the sinks and manifests of results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import labels
from tracequarry.functions.metrics import as_fraction, is_metric, json_leaves
from tracequarry.sources.lines import decoded, files

#: Artifacts by the column that tells of their presence (fixed values).
ARTIFACTS = {"solve_out": "solve_out.txt", "trace": "trace.txt", "metrics": "metrics.json", "contamination": "contamination_judgement.txt", "disallowed": "disallowed_model_judgement.txt", "judge_output": "judge_output.json", "judgement_log": "judgement.log", "time_taken": "time_taken.txt"}
SKIPPED_FOLDERS = [".cache", "checkpoints", "final_model", "model", "wandb", "__pycache__"]
METRIC_FILE = "(?i)eval|metric|result|score|accuracy"
WORKSPACE_MOST = 2 * 1024 * 1024


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, task, trajectory_id, name, path, length, content) of the files right inside <root>/<batch>/<task>.

    Hidden folders are left out; deeper files are no artifacts.
    """
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    found = files(spark, root).withColumn("_rel", F.regexp_replace("path", rf"^\w+:/+{base}/", "")).withColumn("_p", F.split("_rel", "/"))
    own = found.where((F.size("_p") == 3) & ~F.col("_rel").rlike(r"(?:^|/)\."))
    name = F.concat_ws("/", F.col("_p")[0], F.col("_p")[1])
    return own.select(F.col("_p")[0].alias("batch_id"), F.col("_p")[1].alias("task"), F.left(F.sha2(name, 256), F.lit(20)).alias("trajectory_id"), F.col("_p")[2].alias("name"), "path", "length", "content")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row a run: presence of each artifact, the source to read, hashes, and what the names tell."""
    a = artifacts(spark, root)
    path = lambda n: F.max(F.when(F.col("name") == n, F.col("path")))
    digest = lambda n: F.max(F.when(F.col("name") == n, F.sha2("content", 256)))
    one = a.groupBy("batch_id", "task", "trajectory_id").agg(*[path(n).alias(f"{k}_path") for k, n in ARTIFACTS.items()], digest("solve_out.txt").alias("_h1"), digest("trace.txt").alias("_h2"), F.max(F.when(F.col("name") == "time_taken.txt", F.nullif(F.regexp_replace(decoded(F.col("content")), r"^\s+|\s+$", ""), F.lit("")))).alias("total_duration"))
    t, b = labels.task_name(F.col("task")), labels.batch_name(F.col("batch_id"))
    return one.select("trajectory_id", "batch_id", "task", F.coalesce("solve_out_path", "trace_path").alias("source_path"), F.coalesce("_h1", "_h2").alias("duplicate_content_hash"), "total_duration", "metrics_path", "contamination_path", "disallowed_path", t.alias("t"), b.alias("b")).select("*", "t.*", "b.*").drop("t", "b")


def file_counts(inv: DataFrame) -> DataFrame:
    """How many runs have each artifact."""
    return inv.agg(F.count("*").alias("runs"), *[F.count(c).alias(c) for c in ("source_path", "metrics_path", "contamination_path", "disallowed_path", "total_duration")])


def metric_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, metric_name, metric_value): recognised leaves of JSON documents, as fractions."""
    leaves = json_leaves(texts.select(key, text), text)
    return leaves.where(is_metric(F.col("name"))).select(key, F.col("name").alias("metric_name"), as_fraction(F.col("value")).alias("metric_value"))


def metrics_status(text: Column, n_metrics: Column) -> Column:
    """missing, invalid, unrecognized or valid."""
    return F.when(text.isNull(), "missing").when(F.try_parse_json(text).isNull(), "invalid").when(F.coalesce(n_metrics, F.lit(0)) == 0, "unrecognized").otherwise("valid")


def workspace_metrics(spark: SparkSession, root: str) -> DataFrame:
    """(path, metric_name, metric_value) of small JSON files anywhere below root whose name speaks of results."""
    skipped = "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS)
    found = files(spark, root).where(F.col("length") <= WORKSPACE_MOST)
    name = F.element_at(F.split("path", "/"), -1)
    own = found.where(name.rlike(METRIC_FILE) & (name != "metrics.json") & ~F.col("path").rlike(rf"/(?:{skipped})/"))
    return metric_rows(own.select("path", decoded(F.col("content")).alias("text")), "path", "text")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with a fixed header; missing fields are null, nested ones JSON, others are dropped."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    columns = [F.lit(None).cast("string").alias(f) if f not in df.columns else F.to_json(f).alias(f) if f in nested else F.col(f) for f in fields]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a given schema; nothing is inferred, missing keys are null."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header by a given schema; empty and None cells are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_evaluation_logs(heads: DataFrame, records: DataFrame, log: str, path: str, salts: int = 16) -> None:
    """Logs as JSON lines in a folder each: a line of type meta with the head, then lines of type record.

    A log's records may be many, so they go to up to `salts` files; the first holds the head before its records.
    """
    line = lambda df, kind: F.to_json(F.struct(F.lit(kind).alias("type"), *[F.col(c) for c in sorted(df.columns)]))
    first = heads.select(log, F.lit(0).alias("_salt"), F.lit(0).alias("_order"), line(heads, "meta").alias("value"))
    rest = records.select(log, line(records, "record").alias("value")).select(log, F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int").alias("_salt"), F.lit(1).alias("_order"), "value")
    placed = first.unionByName(rest).repartition(F.col(log), F.col("_salt")).sortWithinPartitions(log, "_salt", "_order", "value")
    placed.select(log, "value").write.mode("overwrite").partitionBy(log).text(path)


def read_evaluation_logs(spark: SparkSession, path: str, head: str, record: str, log: str) -> tuple[DataFrame, DataFrame]:
    """(heads, records) of written logs, by their schemas."""
    lines_ = spark.read.text(path)
    kind = F.get_json_object("value", "$.type")
    part = lambda name, schema: lines_.where(kind == name).select(F.from_json("value", schema).alias("r")).select("r.*")
    return part("meta", head), part("record", record)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def manifest(inv: DataFrame, config: dict, outputs: list[str], scripts: dict[str, str] | None = None) -> dict:
    """Hash of the configuration, of the sorted input hashes (folded in Spark by part) and of each script's text, and the outputs.

    Input hashes are folded in 256 parts by their first byte, so no task and not the driver holds all of them.
    """
    parts = inv.where("duplicate_content_hash is not null").groupBy(F.left("duplicate_content_hash", F.lit(2)).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("duplicate_content_hash")), ""), 256).alias("h"))
    folded = hashlib.sha256("".join(r.h for r in parts.orderBy("part").collect()).encode()).hexdigest()
    return {"config_hash": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(), "inputs_hash": folded, "script_hashes": {k: hashlib.sha256(v.encode()).hexdigest() for k, v in sorted((scripts or {}).items())}, "outputs": sorted(outputs)}


def markdown_report(title: str, sections: list[tuple[str, str, DataFrame]]) -> str:
    """A report of small tables: a title, and for each section a heading, a sentence and its table."""
    parts = [f"# {title}"]
    for heading, text, df in sections:
        parts += ["", f"## {heading}", "", *([text, ""] if text else []), markdown_table(df)]
    return "\n".join(parts) + "\n"


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; refused beyond `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has more than {most} rows")
    show = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join(show(x) for x in r)} |" for r in rows])
