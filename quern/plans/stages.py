"""Stages: functions from table to table, with a gate and an error column, run in order.

A stage's gate decides which rows it works on; others pass by unchanged. Rows whose work failed get a message in
``error_message`` and are kept, so nothing is lost between stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.jobs import add_error
from quern.session import cut

Work = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    """``work`` adds or replaces columns of the rows for which ``gate`` holds (all rows, if there is none)."""

    name: str
    work: Work
    gate: Callable[[], Column] | None = None
    failed: Callable[[], Column] | None = None

    def __call__(self, rows: DataFrame) -> DataFrame:
        gate = F.coalesce(self.gate(), F.lit(False)) if self.gate else F.lit(True)
        marked = rows.withColumn("_quern_gate", gate)
        done = self.work(marked.where("_quern_gate"))
        if self.failed and "error_message" in done.columns:
            done = done.withColumn(
                "error_message",
                F.when(self.failed(), add_error(F.col("error_message"), F.lit(f"{self.name} failed"))).otherwise(F.col("error_message")),
            )
        return done.unionByName(marked.where(~F.col("_quern_gate")), allowMissingColumns=True).drop("_quern_gate")


def keep(test: Callable[[], Column]) -> Work:
    """A stage that keeps the rows for which ``test`` holds."""
    return lambda rows: rows.where(F.coalesce(test(), F.lit(False)))


def run(rows: DataFrame, stages: list[Work], cut_every: int = 0) -> DataFrame:
    """``rows`` through all stages; with ``cut_every`` the result is written after that many stages, so a failure repeats few."""
    for n, stage in enumerate(stages, 1):
        rows = stage(rows)
        if cut_every and n % cut_every == 0:
            rows = cut(rows, "stage")
    return rows
