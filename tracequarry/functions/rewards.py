"""Rewards given by the user: a function compute_score(data_source, solution_str, ground_truth, extra_info)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import Column
from pyspark.sql import functions as F


def plugged_reward(score: Callable | str, data_source: Column, solution: Column, truth: Column, extra: Column | None = None) -> Column:
    """The score of each row, a number or the key "score" of a dictionary, by Arrow batches; null solutions have none.

    A path is read here, on the driver, so executors need not share the file.
    """
    text = Path(score).read_text() if isinstance(score, str) else None

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        f = score
        if text is not None:
            space: dict = {}
            exec(compile(text, "reward", "exec"), space)  # noqa: S102 - the user's own function
            f = space["compute_score"]

        def one(source, answer, right, more) -> float | None:
            if answer is None:
                return None
            got = f(source, answer, right, more)
            return float(got["score"] if isinstance(got, dict) else got)

        for columns in batches:
            yield pd.Series([one(*row) for row in zip(*columns)], dtype="float64")

    return run(data_source, solution, truth, F.lit(None).cast("string") if extra is None else extra)
