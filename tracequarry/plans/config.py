"""What a run of the pipeline may set: benchmarks, base models and cohorts of its tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Cells are benchmarks by base models (those found, if not given); cohorts are SQL conditions on a run's row by name."""

    benchmarks: tuple[str, ...] = ()
    base_models: tuple[str, ...] = ()
    cohorts: dict[str, str] = field(default_factory=lambda: {"all_inventory": "true", "outcome": "metrics_path is not null", "workspace": "workspace_status = 'present'", "matched": "benchmark is not null and base_model is not null"})

    @classmethod
    def read(cls, text: str) -> Config:
        """Of a JSON text; unknown keys are refused."""
        values = json.loads(text)
        unknown = set(values) - {"benchmarks", "base_models", "cohorts"}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if k != "cohorts" else v for k, v in values.items()})

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def membership(self, runs: DataFrame, key: str = "trajectory_id") -> DataFrame:
        """(key, cohort), one row for each cohort a run is in."""
        names = [F.when(F.coalesce(F.expr(test), F.lit(False)), F.lit(name)) for name, test in self.cohorts.items()]
        return runs.select(key, F.explode(F.array_compact(F.array(*names))).alias("cohort"))

    def cells(self, runs: DataFrame) -> DataFrame:
        """(benchmark, base_model, runs): every cell, also those without runs."""
        found = runs.agg(*[F.array_compact(F.collect_set(c)).alias(c) for c in ("benchmark", "base_model")])
        named = lambda c, own: F.array(*[F.lit(x) for x in own]) if own else F.col(c)
        each = found.select(F.explode(named("benchmark", self.benchmarks)).alias("benchmark"), "base_model").select("benchmark", F.explode(named("base_model", self.base_models)).alias("base_model"))
        counts = runs.groupBy("benchmark", "base_model").agg(F.count("*").alias("runs"))
        return each.join(counts, ["benchmark", "base_model"], "left").fillna(0, ["runs"])


def total_order(df: DataFrame, *lead: str | Column) -> DataFrame:
    """By the leading columns, then by all others in order of their names: no two different rows tie."""
    return df.orderBy(*lead, *sorted(df.columns))
