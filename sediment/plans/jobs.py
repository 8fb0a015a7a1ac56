"""Whole jobs over an archive: sweep, analyse, confirm, prune, report, publish."""

from __future__ import annotations

import contextlib
import datetime as dt
import functools
import json
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import canonical_json
from ..operators import confirm, diff, discovery, publishers, report
from ..operators.archive import Archive, pending_pairs, prune
from ..sources.shared import written
from ..sources.tables import stratum, tallies, window_counts
from .analysis import Analysis, analyse

#: Tables that the analysis makes and may make again; verdicts are observations and stay.
DERIVED = ("changes", "diff_runs", "field_volatility", "source_stability", "field_dependency")
DEADLINE_S = 900.0  #: no source may hold up a sweep for longer
TALLIED = 3  #: dimensions of a source that are counted, and the categories of each
CATEGORIES = 200


@contextlib.contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancels the jobs that are started inside once the time is over."""
    sc, group, late, over = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            while not over.wait(0.5):  # also jobs that start after the first was cancelled
                sc.cancelJobGroup(group)

    watcher = threading.Thread(target=watch, daemon=True)
    before = sc.getLocalProperty("spark.jobGroup.id")
    sc.setJobGroup(group, "a source with a deadline", interruptOnCancel=True)
    watcher.start()
    try:
        yield
    except Exception as e:
        raise TimeoutError(f"exceeded the deadline of {seconds:.0f} s") if late.is_set() else e
    finally:
        over.set()
        watcher.join()
        sc.setLocalProperty("spark.jobGroup.id", before)


def observe(archive: Archive, source: str, snapshot_id: int, captured_at: str, rows: DataFrame, key: list[str], window: Mapping[str, Any] | None = None) -> dict:
    """Commit a source's rows; of a source with a ``window`` (date_field, stratum_start, stratum_end, agg_dimensions) the
    rows of its closed window, with the counts of its past and the tallies of its dimensions."""
    if window is None:
        return archive.commit(source, snapshot_id, captured_at, rows, key)
    span = (window["date_field"], window["stratum_start"], window["stratum_end"])
    inside = stratum(rows, *span)
    counts = window_counts(rows, *span).first()
    dims = [c for c in (window.get("agg_dimensions") or ())[:TALLIED] if c in rows.columns]
    by = tallies(inside, dims, CATEGORIES) if dims else None
    return archive.commit(source, snapshot_id, captured_at, inside, key, tuple(window.get("extra_volatile") or ()), frozen_past_count=counts["frozen_past_count"], stratum_count=counts["stratum_count"], tallies=by, least_rows=1)


def sweep(archive: Archive, read: Mapping[str, Callable[[], DataFrame]], keys: Mapping[str, list[str]], captured_at: str, first_id: int, windows: Mapping[str, Mapping[str, Any]] | None = None, seconds: float = DEADLINE_S) -> dict[str, str]:
    """Observe every source once; one that fails or takes too long is on record as failed and doesn't hold up the others."""
    said = {}
    for k, source in enumerate(sorted(read)):
        try:
            with deadline(archive.spark, seconds):
                got = observe(archive, source, first_id + k, captured_at, read[source](), keys[source], (windows or {}).get(source))
            said[source] = "same" if got["deduplicated"] else "ok"
        except Exception as e:  # whatever a source does, also only when Spark reads it
            archive.fail(source, first_id + k, captured_at, f"{type(e).__name__}: {e}")
            said[source] = "error"
    return said


def reset_analysis(archive: Archive) -> None:
    """Clear what an analysis derived; observations and verdicts stay."""
    archive.clear(*DERIVED)


def store_analysis(archive: Archive, found: Analysis) -> None:
    """Keep what an analysis learned, and how many changes each of its passes gave, in place of what was there."""
    for name, rows in (("field_volatility", found.volatility), ("source_stability", found.stability), ("field_dependency", found.dependency), ("analysis_stages", found.stages)):
        archive.append(name, rows, "overwrite")


def discover(tables: Iterable[tuple[Mapping[str, Any], Callable[[], DataFrame]]], now: dt.datetime) -> tuple[list[dict], dict[str, str]]:
    """Watchlist rows of the tables that qualify, and why the others don't."""
    accepted, rejected = [], {}
    for source, read in tables:
        got = discovery.evaluate(read(), dict(source), now)
        if isinstance(got, str):
            rejected[str(source.get("source_key"))] = got
        else:
            accepted.append(got)
    return accepted, rejected


def run_analysis(archive: Archive, verdicts: DataFrame | None = None) -> Analysis:
    """Both passes over all pairs of the archive."""
    snapshots = archive.table("snapshots")
    modes = diff.pairs(snapshots).join(snapshots.select(F.col("snapshot_id").alias("to_snapshot"), "identity_mode"), "to_snapshot").select(*diff.PAIR, "identity_mode")
    return analyse(snapshots, archive.table("observations"), archive.table("blobs"), archive.table("verdicts") if verdicts is None else verdicts, diff.schema_drift(snapshots), modes, diff.table_changes(snapshots, archive.table("tallies")))


def record_pending(archive: Archive, changes: DataFrame) -> int:
    """Append the changes of pairs that aren't on record, then mark those pairs; running it again adds nothing."""
    pairs = written(pending_pairs(diff.pairs(archive.table("snapshots")), archive.table("diff_runs")).select(*diff.PAIR), "pending")
    new = changes.join(pairs, [*diff.PAIR], "left_semi")
    new = written(new.withColumn("change_id", F.xxhash64(*diff.PAIR, "kind", "row_uid", "detail")), "new-changes")
    per = pairs.join(new.groupBy(*diff.PAIR).agg(F.count(F.lit(1)).alias("change_count")), [*diff.PAIR], "left").fillna(0, ["change_count"])
    archive.append("changes", new)
    archive.append("diff_runs", per)
    return new.count()


def run_confirmation(archive: Archive, published: DataFrame) -> DataFrame:
    """Ask for every claim without a verdict, keep the verdicts, and give the changes as they then stand."""
    changes, sources = archive.table("changes"), archive.sources()
    got = written(confirm.confirm(confirm.claims(changes, archive.table("verdicts")), published, sources), "verdicts")
    archive.append("verdicts", got)
    return confirm.apply_verdicts(changes, archive.table("verdicts"))


def prune_archive(archive: Archive, least: int = discovery.LEAST_STRATUM, apply: bool = False) -> tuple[DataFrame, dict[str, DataFrame] | None]:
    """Sources that are too small, and the tables without them unless it is a dry run."""
    doomed = discovery.curate_plan(archive.sources(), archive.table("snapshots"), least)
    if not apply:
        return doomed, None
    names = ("snapshots", "observations", "changes", "diff_runs", "blobs")
    return doomed, prune({n: archive.table(n) for n in names} | {"sources": archive.sources()}, doomed)


def publisher_table(archive: Archive, rows: DataFrame) -> DataFrame:
    """The sources with the class that ``rows`` show."""
    return publishers.set_class(archive.sources(), publishers.publisher_class(rows))


def characterise(archive: Archive, read: Mapping[str, Callable[[], DataFrame]], cutoff: str) -> DataFrame:
    """The sources with the class that their published tables show, all counts of a table in one pass over it."""
    by = {r["source_key"]: r for r in archive.sources().where(F.col("source_key").isin(*read)).collect()}
    parts = [publishers.publishing_rows(read[k](), k, by[k]["date_field"], by[k]["stratum_end"], cutoff) for k in sorted(by)]
    return publisher_table(archive, functools.reduce(DataFrame.unionByName, parts)) if parts else archive.sources()


class Assertions(NamedTuple):
    sources: DataFrame
    totals: DataFrame
    ages: DataFrame
    deepest: DataFrame


def assertions(sources: DataFrame, rows: DataFrame, now: dt.datetime) -> Assertions:
    """What sources whose timestamps mean something say of writes to their closed past."""
    told = rows.join(sources.where(F.col("pipeline_class").isin(*publishers.INFORMATIVE)).select("source_key"), "source_key", "left_semi")
    found = written(publishers.assertions(told), "assertions")
    return Assertions(found.orderBy(F.desc("asserted_modified"), "source_key"), publishers.assertion_totals(found, sources), publishers.age_distribution(told.where("closed AND touched"), F.lit(now)), publishers.deepest_reach(found))


def summary(document: Mapping[str, Any]) -> list[str]:
    """The document's main figures, a line each."""
    o, c = document["overview"], document["churn"]
    lines = [f"{o['sources_watched']} sources in {o['city_count']} cities, {o['sweeps']} sweeps, {o['snapshots_ok']} observations, {o['snapshots_failed']} failed"]
    if document.get("integrity"):
        lines.append(f"{sum(bool(x['ok']) for x in document['integrity'])} of {len(document['integrity'])} chains hold")
    share = next((x["share_uninterpretable"] for x in document["census"]), None)
    if share is not None:
        lines.append(f"{share:.0%} of the characterised sources write too much to be read")
    lines.append(f"{c['material_changes']} material changes: {c['isolated_revisions']} revisions by themselves, {c['coordinated_revisions']} together, {c['deletions']} deletions; {c['discarded_as_mechanism']} were mechanism")
    if document.get("assertions"):
        lines.append(f"{document['assertions']['totals'][0]['asserted_modified']} records of closed periods written again, by the sources' own account")
    return lines


def bundle(sources: DataFrame, snapshots: DataFrame, changes: DataFrame, blobs: DataFrame, probe: int | None = None, assertions: Assertions | None = None) -> dict[str, Any]:
    """The evidence as one document. Every part is bounded: totals, one row a source, and at most ``report.LIMIT`` findings."""
    part = lambda df: [json.loads(x) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
    return {
        "overview": part(report.overview(sources, snapshots))[0],
        "integrity": part(report.verify_chains(snapshots.where("status = 'ok'"))) if "meta_json" in snapshots.columns else None,
        "census": part(publishers.census(sources)),
        "census_by_city": part(publishers.census_by_city(sources)),
        "churn": part(report.churn_summary(changes, probe))[0],
        "kinds": part(report.by_kind(changes)),
        "findings": part(report.findings(changes, sources, snapshots, blobs)),
        "assertions": None if assertions is None else {k: part(v) for k, v in assertions._asdict().items()},
        "sources": part(report.sources_table(sources, snapshots)),
    }


def verify(archive: Archive) -> DataFrame:
    """Every check of an archive."""
    snapshots = archive.table("snapshots")
    text = canonical_json(F.map_from_entries(F.array_sort(F.map_entries("payload"))))
    return report.verify(snapshots, archive.table("observations"), archive.table("blobs").select("content_hash", text.alias("payload_json")))


def publish(checks: DataFrame, document: Mapping[str, Any], path: str) -> None:
    """Write the document, but only if every check of the archive passed."""
    bad = [r["check"] for r in checks.where("NOT ok").collect()]
    if bad:
        raise ValueError(f"not published: {', '.join(bad)} failed")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, sort_keys=True)
