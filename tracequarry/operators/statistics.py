"""Resampling and code extraction: what neither SQL nor built-in functions express."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cluster_bootstrap(df: DataFrame, value: str, cluster: str, seed: int = 1, reps: int = 200) -> DataFrame:
    """(mean, low, high): the mean, and the 2.5 and 97.5 index percentiles of means over resampled clusters.

    Clusters become (sum, count) first. A resample draws as many clusters as there are;
    each cluster's number of draws is Poisson(1), which is what drawing with replacement
    comes to, and needs no gathering of clusters: every partition adds its share to each
    of the `reps` sums. Draws depend on cluster, rep and seed only.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(F.col(cluster).cast("string").alias("c")).agg(F.sum(value).alias("s"), F.count("*").alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n, plain_s, plain_n = np.zeros(reps), np.zeros(reps), 0.0, 0
        for b in batches:
            for c, x, k in zip(b["c"], b["s"], b["n"]):
                rng = np.random.default_rng([seed, *str(c).encode()])
                times = rng.poisson(1.0, reps)
                s += times * x
                n += times * k
                plain_s += x
                plain_n += k
        yield pd.DataFrame({"rep": np.arange(-1, reps), "s": np.concatenate([[plain_s], s]), "n": np.concatenate([[plain_n], n])})

    means = sums.mapInPandas(draw, "rep int, s double, n double").groupBy("rep").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m")).where("m is not null")
    sorted_ = F.array_sort(F.collect_list(F.when(F.col("rep") >= 0, F.col("m"))))  # `reps` numbers
    out = means.agg(F.max(F.when(F.col("rep") == -1, F.col("m"))).alias("mean"), sorted_.alias("ms"))
    at = lambda p: F.try_element_at("ms", F.floor(F.size("ms") * p).cast("int") + 1)
    return out.select("mean", at(0.025).alias("low"), at(0.975).alias("high"))


@F.pandas_udf(T.BooleanType())
def valid_python(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a text parses as Python (it is never run); null for null."""
    for b in batches:
        yield pd.Series([None if t is None else _parsed(t) is not None for t in b], index=b.index, dtype=object)


def _parsed(code: str) -> ast.Module | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


FUNCTIONS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("docstring", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_lines", T.IntegerType())]))


@F.pandas_udf(FUNCTIONS)
def python_functions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Top-level functions of Python code: name, docstring, source, lines; none for what doesn't parse."""
    for b in batches:
        yield pd.Series([_functions(t) for t in b], index=b.index, dtype=object)


def _functions(code: str | None) -> list[dict]:
    tree = _parsed(code) if code else None
    found = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] if tree else []
    return [{"name": n.name, "docstring": ast.get_docstring(n), "source": ast.get_source_segment(code, n), "n_lines": n.end_lineno - n.lineno + 1} for n in found]


def valid_decision(text: Column) -> Column:
    """Whether a JSON text is an object with exactly option (keep or revert) and a reason that is not blank."""
    keys = F.array_sort(F.json_object_keys(text))
    option, reason = F.get_json_object(text, "$.option"), F.get_json_object(text, "$.reason")
    return F.coalesce((keys == F.array(F.lit("option"), F.lit("reason"))) & option.isin("keep", "revert") & reason.rlike(r"\S"), F.lit(False))
