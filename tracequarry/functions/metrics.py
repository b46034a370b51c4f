"""Metric values out of JSON and log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metric names (fixed values).
METRIC_KEYS = ["accuracy", "acc", "score", "exact_match", "pass@1", "pass@8", "reward", "success_rate", "win_rate", "mean"]
METRIC_PARTS = "accuracy|pass@|score|reward|exact"
COUNT_PARTS = "sample|count|grader_calls|n_examples|num_examples|total_"
NAMED_VALUE = r"(?i)\b(accuracy|acc|score|pass@\d+|exact[_ -]?match|reward)\b\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)\s*%?"
NAMED_SHARE = r"(?i)\b(accuracy|score)\b[^\d]{0,20}([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+)"
NAMED_VALUE_MATCH, NAMED_SHARE_MATCH = NAMED_VALUE.replace("(?i)", "(?i)(", 1) + ")", NAMED_SHARE.replace("(?i)", "(?i)(", 1) + ")"


def as_fraction(value: Column) -> Column:
    """Percentages, in (1, 100], become fractions."""
    return F.when((value > 1) & (value <= 100), value / 100).otherwise(value)


def is_metric(name: Column) -> Column:
    """Whether a dotted name's last key is a metric's."""
    leaf = F.replace(F.lower(F.element_at(F.split(name, r"\."), -1)), F.lit(" "), F.lit("_"))
    return (leaf.isin(METRIC_KEYS) | leaf.rlike(METRIC_PARTS)) & ~leaf.rlike(COUNT_PARTS)


def metric_points(text: Column) -> Column:
    """The values named in a text, as array<struct<metric_name, metric_value>>.

    'name: 50 %' is a fraction, a bare value above 1 is no score, 'name a/b' is a share.
    """
    found = F.regexp_extract_all(text, F.lit(NAMED_VALUE_MATCH), F.lit(1))
    shares = F.regexp_extract_all(text, F.lit(NAMED_SHARE_MATCH), F.lit(1))
    number = lambda x, p, g: F.regexp_extract(x, p, g).cast("double")
    one = F.transform(found, lambda x: F.struct(F.regexp_extract(x, NAMED_VALUE, 1).alias("metric_name"), F.when(x.endswith("%"), number(x, NAMED_VALUE, 2) / 100).when(number(x, NAMED_VALUE, 2) <= 1, number(x, NAMED_VALUE, 2)).alias("metric_value")))
    a, b = (lambda x: number(x, NAMED_SHARE, 2)), (lambda x: number(x, NAMED_SHARE, 3))
    two = F.transform(shares, lambda x: F.struct(F.regexp_extract(x, NAMED_SHARE, 1).alias("metric_name"), F.when((b(x) > 0) & (a(x) <= b(x)), a(x) / b(x)).alias("metric_value")))
    return F.filter(F.concat(one, two), lambda p: p["metric_value"].isNotNull())


def text_metrics(df: DataFrame, text: str) -> DataFrame:
    """Adds metric_name, metric_value: one row a value named in the text."""
    points = df.where(F.col(text).isNotNull()).withColumn("_m", F.explode(metric_points(F.col(text))))
    return points.select(*df.columns, "_m.metric_name", "_m.metric_value")


def json_leaves(df: DataFrame, text: str, most_depth: int = 32) -> DataFrame:
    """Adds name, value: one row a number in a JSON object, by dotted path (booleans are none; arrays are not entered).

    Level by level: each round explodes the objects that are left, until none is. Deeper
    objects than most_depth are refused, so no leaf is lost.
    """
    spark = df.sparkSession
    keep = ", ".join(f"d.`{c}`" for c in df.columns)
    level = df.withColumn("_v", F.try_parse_json(F.col(text))).where("_v is not null").withColumn("name", F.lit(""))
    out = []
    for _ in range(most_depth):
        objects = level.where(F.schema_of_variant("_v").startswith("OBJECT"))
        level = spark.sql(f"SELECT {keep}, t.value AS _v, if(d.name = '', t.key, d.name || '.' || t.key) AS name FROM {{d}} AS d, LATERAL variant_explode(d._v) AS t", d=objects)
        kind = F.schema_of_variant("_v")
        out.append(level.where(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")).select(*df.columns, "name", F.try_variant_get("_v", "$", "double").alias("value")))
        level = level.where(kind.startswith("OBJECT"))
        if len(out) >= 4:  # deeper levels are rare: look whether there is one
            if level.isEmpty():
                break
    else:
        if not level.isEmpty():
            raise ValueError(f"JSON objects are nested more than {most_depth} deep")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
