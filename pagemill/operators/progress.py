"""Counts of what passes through the stages of a job, gathered while it runs: no stage is run for its count."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Progress:
    """Observed stages by name. ``rows`` is counted for each; other measures are aggregates given by name.

    A stage's counts are there when an action over all its rows has ended, be it a write, a count or a checkpoint. Of one
    that runs twice the first counts.
    """

    def __init__(self) -> None:
        self._stages: dict[str, Observation] = {}

    def watch(self, rows: DataFrame, stage: str, **measures: Column) -> DataFrame:
        """``rows``, counted as they pass."""
        if stage in self._stages:
            raise ValueError(f"stage {stage} is watched already")
        self._stages[stage] = Observation(f"{stage}-{uuid.uuid4().hex}")
        return rows.observe(self._stages[stage], F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in measures.items()])

    def counts(self) -> dict[str, dict]:
        """What each stage has counted; waits for stages whose action has not ended."""
        return {name: dict(o.get) for name, o in self._stages.items()}
