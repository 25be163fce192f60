"""Counts of a run, observed while its tables are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.schemas import SOURCE_KINDS


class RunReport:
    """How many articles each stage of a run had, by source kind.

    A watched frame passes its rows on unchanged; the counts are taken in the job that writes what follows,
    so a stage costs no scan and no job of its own. ``rows`` may be asked for once that job has ended.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[Observation, dict[str, tuple[str, str]]]] = []

    def _observe(self, frame: DataFrame, counts: dict[tuple[str, str], Column]) -> DataFrame:
        observation = Observation()
        names = {f"count_{i}": stage_and_source for i, stage_and_source in enumerate(counts)}
        self._seen.append((observation, names))
        columns = [F.count_if(test).alias(name) for name, test in zip(names, counts.values(), strict=True)]
        return frame.observe(observation, *columns)

    def watch(self, articles: DataFrame, stage: str) -> DataFrame:
        """Articles of all kinds at a stage."""
        return self._observe(articles, {(stage, kind): F.col("source") == kind for kind in SOURCE_KINDS})

    def watch_kind(self, rows: DataFrame, kind: str, **stages: Column) -> DataFrame:
        """Rows of one kind; each stage counts those that meet its condition."""
        return self._observe(rows, {(stage, kind): test for stage, test in stages.items()})

    def rows(self) -> list[tuple[str, str, int]]:
        """Stage, source kind and number, in the order in which they were watched."""
        return [
            (*stage_and_source, observation.get[name])
            for observation, names in self._seen
            for name, stage_and_source in names.items()
        ]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "stage string, source string, articles bigint")
