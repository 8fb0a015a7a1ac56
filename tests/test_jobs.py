import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sediment.operators import archive as A
from sediment.operators import discovery, publishers, report
from sediment.plans import jobs, observed
from sediment.sources.tables import json_or_none, metadata


def test_sweep_analyse_confirm(spark, tmp_path):
    arc = A.Archive(spark, str(tmp_path / "a"))
    arc.append("sources", spark.createDataFrame([("s", "d", ["case"], "2020-01-01", "2021-01-01")], "source_key string, domain string, business_key array<string>, stratum_start string, stratum_end string"))
    rows = lambda ids: spark.createDataFrame([(f"{i}", "T") for i in ids], "case string, type string")

    def broken():
        raise ValueError("unreachable")

    for n, ids in ((1, range(10)), (2, range(8)), (3, range(8))):
        said = jobs.sweep(arc, {"s": lambda ids=ids: rows(ids), "x": broken}, {"s": ["case"], "x": ["case"]}, f"2024-01-0{n}", n * 10)
    assert said == {"s": "same", "x": "error"}
    changes = jobs.run_analysis(arc).changes
    assert jobs.record_pending(arc, changes) == 2 and jobs.record_pending(arc, changes) == 0
    published = spark.createDataFrame([("s", "8", "2022-01-01")], "source_key string, key string, date_value string")
    after = {r.row_uid: r.kind for r in jobs.run_confirmation(arc, published).collect()}
    assert after == {"8": "left_observation_window", "9": "deletion"}
    assert jobs.run_confirmation(arc, published).count() == 2 and arc.table("verdicts").count() == 2
    doomed, tables = jobs.prune_archive(arc, apply=True)
    assert doomed.count() == 1 and tables["snapshots"].where("source_key = 's'").count() == 0


def test_a_source_that_fails_or_hangs_when_it_is_read(spark, tmp_path):
    import time

    arc = A.Archive(spark, str(tmp_path / "a"))
    slow = F.udf(lambda i: time.sleep(60) or i, "long")
    read = {
        "fails": lambda: spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("gone"))).otherwise(F.lit("x")).alias("case")),
        "hangs": lambda: spark.range(5).select(slow("id").cast("string").alias("case")),
        "works": lambda: spark.range(5).select(F.col("id").cast("string").alias("case")),
    }
    began = time.monotonic()
    said = jobs.sweep(arc, {k: read[k] for k in ("fails", "works")}, dict.fromkeys(read, ["case"]), "2024-01-01", 1)
    assert said == {"fails": "error", "works": "ok"}
    assert jobs.sweep(arc, {"hangs": read["hangs"]}, {"hangs": ["case"]}, "2024-01-01", 9, seconds=3) == {"hangs": "error"} and time.monotonic() - began < 100
    errors = {r.source_key: r.error for r in arc.table("snapshots").where("status = 'error'").collect()}
    assert "gone" in errors["fails"] and "deadline of 3 s" in errors["hangs"]
    assert spark.range(3).count() == 3


def test_changes_of_whole_tables_are_recorded(spark, tmp_path):
    arc = A.Archive(spark, str(tmp_path / "a"))
    window = {"date_field": "day", "stratum_start": "2020-01-01", "stratum_end": "2021-01-01", "agg_dimensions": ["type", "none"]}
    base = [(f"A{i}", "THEFT" if i % 2 else "ARSON", "2020-05-01") for i in range(10)] + [("B", "THEFT", "2019-05-01"), ("C", "THEFT", "2022-05-01")]
    frame = lambda data: spark.createDataFrame(data, "case string, type string, day string")
    states = [frame(base), frame(base).withColumn("last_updated", F.lit("2")), frame(base).withColumn("last_updated", F.lit("3")), frame([(c, "FRAUD" if c == "A1" else t, d) for c, t, d in base if c != "B"]).withColumn("last_updated", F.lit("3"))]
    for n, rows in enumerate(states, 1):
        assert jobs.sweep(arc, {"s": lambda rows=rows: rows}, {"s": ["case"]}, f"2024-01-0{n}", n, {"s": window}) == {"s": "same" if n in (2, 3) else "ok"}
    assert jobs.sweep(arc, {"s": lambda: states[0].limit(0)}, {"s": ["case"]}, "2024-01-05", 5, {"s": window}) == {"s": "error"}
    snaps = {r.snapshot_id: (r.frozen_past_count, r.stratum_count, r.row_count) for r in arc.table("snapshots").where("status = 'ok'").collect()}
    assert snaps == {1: (11, 10, 10), 2: (11, 10, 10), 3: (11, 10, 10), 4: (10, 10, 10)}
    found = jobs.run_analysis(arc)
    jobs.store_analysis(arc, found)
    jobs.store_analysis(arc, found)
    assert jobs.record_pending(arc, found.changes) == 6
    kinds = {(r.from_snapshot, r.kind): (r.row_uid, r.significance) for r in arc.table("changes").collect()}
    assert kinds == {(1, "schema_drift"): (None, 0.5), (1, "provenance_churn"): (None, 0.0), (2, "provenance_churn"): (None, 0.0), (3, "frozen_past_shift"): (None, 0.95), (3, "tally_shift"): (None, 0.8), (3, "semantic_revision"): ("A1", 1.0)}
    assert {r.stage: r.change_count for r in arc.table("analysis_stages").collect()} == {"probe": 6, "controlled": 6}
    jobs.reset_analysis(arc)
    assert arc.table("changes").count() == arc.table("diff_runs").count() == 0 and arc.table("observations").count() == 20
    assert jobs.record_pending(arc, found.changes) == 6


def test_bundle_and_gate(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    doc = jobs.bundle(observed.watched(spark, d), observed.watched_snapshots(spark, d), observed.recorded_changes(spark, d), spark.createDataFrame([], "content_hash string, payload map<string,string>"), 5000)
    checks = spark.createDataFrame([("chains", 3, 0, True)], "check string, checked long, failed long, ok boolean")
    out = str(tmp_path / "b.json")
    jobs.publish(checks, doc, out)
    with open(out, encoding="utf-8") as f:
        got = json.load(f)
    assert len(jobs.summary(got)) == 3 and "25 sources" in jobs.summary(got)[0]
    assert got["overview"]["sources_watched"] == 25 and 0 < len(got["findings"]) <= report.LIMIT and len(got["sources"]) == 25
    with pytest.raises(ValueError):
        jobs.publish(checks.withColumn("ok", F.lit(False)), doc, out)


def test_discovery(spark):
    now = dt.datetime(2025, 3, 1)
    rows = spark.range(300).select(F.col("id").alias("case_number"), (F.to_timestamp(F.lit("2024-01-06")) + F.make_dt_interval((F.col("id") % 20).cast("int"))).alias("incident_date"), F.current_timestamp().alias("updated_at"), (F.col("id") % 4).cast("string").alias("offense_type"), F.lit("x").alias("note"))
    got, why = jobs.discover([({"source_key": "a", "title": "Police incidents"}, lambda: rows), ({"source_key": "b", "title": "Trees"}, lambda: rows), ({"source_key": "c", "title": "Arrests"}, lambda: rows.limit(9)), ({"source_key": "d", "title": "Arrests"}, lambda: rows.drop("incident_date")), ({"source_key": "e", "title": "Arrests"}, lambda: rows.withColumn("case_number", F.lit(1)))], now)
    assert [(g["source_key"], g["date_field"], g["business_key"], g["agg_dimensions"]) for g in got] == [("a", "incident_date", ["case_number"], ["offense_type"])]
    assert why == {"b": "no civic weight", "c": "too few rows", "d": "no event date", "e": "no natural key"}
    assert "stratum_rows_at_discovery=" in got[0]["notes"]
    dense = discovery.choose_stratum(rows, "incident_date", now, target=100, most=200)
    assert dense and dense[2] <= 200


def test_commands_and_assertions(spark, tmp_path, capsys):
    from sediment.__main__ import main

    path, out = str(tmp_path / "a"), str(tmp_path / "b.json")
    arc = A.Archive(spark, path)
    arc.append("sources", spark.createDataFrame([("s", "day", "2021-01-01", "t", "c")], "source_key string, date_field string, stratum_end string, title string, city string"))
    day = lambda n: spark.createDataFrame([(f"A{i}", f"v{n if i == 3 else 0}", "2020-05-01", "2024-01-01", "2025-01-01" if i == 3 else "2020-06-01") for i in range(8)], "case string, type string, day string, `:created_at` string, `:updated_at` string")
    for n in (1, 2):
        jobs.sweep(arc, {"s": lambda n=n: day(n)}, {"s": ["case"]}, f"2024-01-0{n}", n)
    assert main(["verify", path]) == 0 and main(["analyse", path]) == 0 and main(["bundle", path, "--to", out]) == 0
    assert "1 changes are new" in capsys.readouterr().out
    classes = {r.source_key: r.pipeline_class for r in jobs.characterise(arc, {"s": lambda: day(1)}, "2024-12-01").collect()}
    assert classes == {"s": "incremental"}
    sources = arc.sources().withColumn("pipeline_class", F.lit("incremental"))
    told = jobs.assertions(sources, publishers.publishing_rows(day(1), "s", "day", "2021-01-01", "2024-12-01"), dt.datetime(2025, 3, 1))
    assert (told.totals.first().asserted_modified, told.ages.first().age_bucket, told.deepest.first().oldest_event_touched) == (1, "4-7 years", "2020-05-01")
    doc = jobs.bundle(sources, arc.table("snapshots"), arc.table("changes"), arc.table("blobs"), assertions=told)
    assert doc["assertions"]["sources"][0]["asserted_modified"] == 1 and "1 records of closed periods" in jobs.summary(doc)[-1]
    arc.append("snapshots", arc.table("snapshots").where("snapshot_id = 1").withColumn("snapshot_id", F.lit(9)).withColumn("merkle_root", F.lit("0")))
    assert main(["verify", path]) == 1 and main(["bundle", path, "--to", out]) == 1
    assert main(["reset", path]) == 0 and arc.table("changes").count() == 0


def test_small_sources(spark, tmp_path):
    assert json_or_none(spark, str(tmp_path / "none.json"), "a int") is None
    (tmp_path / "x.json").write_text('{"a": ')
    assert json_or_none(spark, str(tmp_path / "x.json"), "a int") is None
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert json_or_none(spark, str(tmp_path / "x.json"), "a int").first().a == 1
    assert metadata(spark.range(1)) == [("id", "bigint")]
