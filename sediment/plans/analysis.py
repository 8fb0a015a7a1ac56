"""The two-pass analysis: a blind pass, what it teaches, and a second pass under those controls."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff, volatility
from ..sources.shared import written


class Analysis(NamedTuple):
    changes: DataFrame
    volatility: DataFrame
    stability: DataFrame
    dependency: DataFrame
    stages: DataFrame


def analyse(snapshots: DataFrame, observations: DataFrame, blobs: DataFrame, verdicts: DataFrame | None = None, drift: DataFrame | None = None, modes: DataFrame | None = None, tables: DataFrame | None = None) -> Analysis:
    """All sources at once. The raw deltas are written once and read by both passes and by the measurement."""
    pairs = diff.pairs(snapshots)
    status = diff.record_status(pairs, observations)
    moved = written(status.where("status <> 'same'"), "moved")
    deltas = written(diff.record_deltas(moved, blobs), "deltas")
    seen = diff.last_seen(snapshots, observations)
    blind = diff.record_changes(moved, deltas, seen, diff.Controls(verdicts=verdicts), drift, modes, tables)
    moves = written(volatility.field_moves(deltas), "moves")
    learned = written(volatility.field_volatility(moves), "volatility")
    stability = written(volatility.source_stability(moves, learned, snapshots), "stability")
    dependency = written(volatility.field_dependency(deltas, learned), "dependency")
    controls = diff.Controls(learned.where("verdict = 'recomputed'").select("source_key", "field"), dependency.select("source_key", "field", "driver"), stability.where("verdict = 'key_unstable'").select("source_key", "reason"), verdicts)
    changes = written(diff.record_changes(moved, deltas, seen, controls, drift, modes, tables), "changes")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("change_count")).select(F.lit(name).alias("stage"), "change_count")
    return Analysis(changes, learned, stability, dependency, count(blind, "probe").unionByName(count(changes, "controlled")))
