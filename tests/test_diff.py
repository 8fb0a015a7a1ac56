import re

import pytest
from pyspark.sql import functions as F

from sediment.functions.deltas import DELTAS
from sediment.operators import diff, volatility
from sediment.plans.analysis import analyse
from sediment.sources import shared

CHANGE = f"source_key string, from_snapshot long, to_snapshot long, kind string, row_uid string, before_hash string, after_hash string, field_deltas {DELTAS}, significance double, detail string"


def change(kind, uid, sig, deltas=None, source="s"):
    return (source, 1, 2, kind, uid, None, None, {k: {"before": b, "after": a} for k, (b, a) in deltas.items()} if deltas else None, sig, "d")


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGE)


def presence(gone, come):
    return [change("deletion", f"g{i}", 1.0) for i in range(gone)] + [change("retroactive_append", f"c{i}", 0.6) for i in range(come)]


@pytest.mark.parametrize("gone,come,mode,want", [(1417, 1417, "business_key", {("identity_churn", 0.15)}), (1, 0, "content", {("identity_churn", 0.1)}), (50, 0, "business_key", {("deletion", 1.0)}), (100, 10, "business_key", {("deletion", 0.9), ("retroactive_append", 0.54)}), (10, 9, "business_key", {("identity_churn", 0.15)})])
def test_identity_churn(spark, gone, come, mode, want):
    volumes = spark.createDataFrame([("s", 1, 2, gone, come)], "source_key string, from_snapshot long, to_snapshot long, gone long, arrived long")
    modes = spark.createDataFrame([("s", 1, 2, mode)], "source_key string, from_snapshot long, to_snapshot long, identity_mode string")
    got = diff.identity_churn(changes(spark, presence(gone, come)), volumes, modes)
    assert {(r.kind, r.significance) for r in got.select("kind", "significance").distinct().collect()} == want and got.count() == gone + come


def test_coordination_and_isolation(spark):
    rows = [change("semantic_revision", f"u{i}", 0.8, {"code": ("A", "B")}) for i in range(60)] + [change("semantic_revision", "x", 0.8, {"price": ("1", "2")}), change("semantic_revision", "y", 0.95, {"size": ("1", "3")})]
    got = {r.row_uid: (r.kind, r.significance) for r in diff.mark_coordinated(changes(spark, rows)).collect()}
    assert got["u7"] == ("coordinated_revision", 0.2) and got["x"] == ("semantic_revision", 1.0) and got["y"] == ("semantic_revision", 1.0)
    alone = diff.mark_coordinated(changes(spark, [change("semantic_revision", "x", 0.8, {"price": ("1", "2")})])).first()
    assert (alone.kind, alone.significance) == ("semantic_revision", 0.8)  # nothing to stand out from


def test_withdrawal_folds_claims_about_records(spark):
    rows = [change("semantic_revision", "a", 0.8, {"x": ("1", "2")}), change("deletion", "b", 1.0), change("ordering_change", "c", 0.15), change("deletion", "b", 1.0, source="t")]
    unstable = spark.createDataFrame([("s", "keys move")], "source_key string, reason string")
    got = {(r.source_key, r.kind): r.detail for r in diff.withdraw_unstable(changes(spark, rows), unstable).collect()}
    assert set(got) == {("s", "withdrawn_unstable_key"), ("s", "ordering_change"), ("t", "deletion")} and got["s", "withdrawn_unstable_key"].startswith("2 ")


def archive(spark, versions, columns=("a", "b")):
    """Snapshots, observations and blobs of one source from dicts of uid -> payload."""
    import hashlib
    import json

    snaps, obs, blobs = [], [], {}
    for n, v in enumerate(versions, 1):
        snaps.append((n, "s", "ok", list(columns), len(v)))
        for uid, payload in v.items():
            h = hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()
            obs.append((n, uid, h))
            blobs[h] = payload
    return (
        spark.createDataFrame(snaps, "snapshot_id long, source_key string, status string, columns array<string>, row_count long"),
        spark.createDataFrame(obs, "snapshot_id long, row_uid string, content_hash string"),
        spark.createDataFrame(list(blobs.items()), "content_hash string, payload map<string,string>"),
    )


def test_kinds_end_to_end(spark):
    base = {f"u{i}": {"status": "Open", "price": "5", "paid": "0", "due": "9", "list": "a,b", "closed": None} for i in range(12)}
    after = {k: dict(v) for k, v in base.items()}
    after["u0"]["status"] = "Done"
    after["u1"]["closed"] = "2024"
    after["u2"] |= {"paid": "4", "due": "5"}
    after["u3"]["list"] = "b,a"
    after["u4"]["price"] = "6"
    after["u5"] |= {"price": "7", "status": "Done"}
    del after["u6"], after["u7"], after["u8"]
    after["new"] = dict(base["u0"])
    third = dict(after, u7=base["u7"])
    snaps, obs, blobs = archive(spark, [base, after, third])
    verdicts = spark.createDataFrame([("s", "u8", "key_reformatted", "8", "there")], "source_key string, row_uid string, verdict string, found_as string, reason string")
    status = diff.record_status(diff.pairs(snaps), obs)
    got = diff.record_changes(status, diff.record_deltas(status, blobs), diff.last_seen(snaps, obs), diff.Controls(verdicts=verdicts)).where("from_snapshot = 1")
    kinds = {r.row_uid: (r.kind, r.significance) for r in got.collect()}
    assert kinds == {
        "u0": ("lifecycle_progression", 0.2),
        "u1": ("lifecycle_progression", 0.2),
        "u2": ("balance_transfer", 0.2),
        "u3": ("ordering_change", 0.15),
        "u4": ("semantic_revision", 0.6),  # weight .4, and nothing comparable in the pair
        "u5": ("semantic_revision", pytest.approx(0.592)),
        "u6": ("deletion", pytest.approx(0.667)),
        "u7": ("transient_absence", 0.1),
        "u8": ("left_observation_window", 0.1),
        "new": ("retroactive_append", pytest.approx(0.4)),
    }


def test_controls(spark):
    base = {f"u{i}": {"age": "1", "closed_on": "a", "open_days": "1", "dropped": "z"} for i in range(3)}
    after = {"u0": dict(base["u0"], age="2"), "u1": dict(base["u1"], age="2", closed_on="b", open_days="2"), "u2": dict(base["u2"], dropped="y", age="2")}
    snaps, obs, blobs = archive(spark, [base, after])
    controls = diff.Controls(spark.createDataFrame([("s", "age")], "source_key string, field string"), spark.createDataFrame([("s", "open_days", "closed_on")], "source_key string, field string, driver string"))
    drift = spark.createDataFrame([("s", 1, 2, [], ["dropped"])], "source_key string, from_snapshot long, to_snapshot long, added array<string>, removed array<string>")
    status = diff.record_status(diff.pairs(snaps), obs)
    got = {r.row_uid: r for r in diff.classify_revisions(diff.record_deltas(status, blobs), controls, drift).collect()}
    assert got["u0"].kind == got["u2"].kind == "provenance_churn" and got["u0"].field_deltas is None
    assert got["u1"].kind == "semantic_revision" and set(got["u1"].field_deltas) == {"closed_on", "open_days"} and got["u1"].significance == 0.4


def test_pairs_that_share_rows_have_no_changes(spark):
    snaps, obs, _ = archive(spark, [{"a": {"x": "1"}}])
    two = snaps.withColumn("observations_ref", F.lit(None).cast("long")).unionByName(snaps.withColumn("snapshot_id", F.lit(2).cast("long")).withColumn("observations_ref", F.lit(1).cast("long")))
    assert [r.status for r in diff.record_status(diff.pairs(two), obs).collect()] == ["same"]


def test_two_passes_learn_a_clock(spark):
    versions = [{f"u{i}": {"age_days": str(n), "price": "5" if i or n < 3 else "6"} for i in range(30)} for n in range(5)]
    snaps, obs, blobs = archive(spark, versions)
    a = analyse(snaps, obs, blobs)
    assert {r.field: r.verdict for r in a.volatility.collect()} == {"age_days": "recomputed", "price": "ordinary"}
    assert [r.verdict for r in a.stability.collect()] == ["stable"]
    stages = {r.stage: r.change_count for r in a.stages.collect()}
    assert stages == {"probe": 120, "controlled": 120}
    kinds = {r.kind: r.n for r in a.changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"provenance_churn": 119, "semantic_revision": 1}


def test_dependency_keeps_one_direction(spark):
    rows = [("s", 1, 2, {"closed_on": {"before": "a", "after": "b"}, "open_days": {"before": "1", "after": "2"}}) for _ in range(9)]
    d = spark.createDataFrame(rows, f"source_key string, from_snapshot long, to_snapshot long, deltas {DELTAS}")
    none = spark.createDataFrame([], "source_key string, field string, verdict string")
    assert [(r.field, r.driver, r.observations) for r in volatility.field_dependency(d, none).collect()] == [("open_days", "closed_on", 9)]
    assert volatility.field_dependency(d.limit(7), none).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_no_task_gets_all_records_of_an_observation(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
    pairs = spark.createDataFrame([("s", 1, 2, 1, 2), ("s", 2, 3, 2, 2)], "source_key string, from_snapshot long, to_snapshot long, from_owner long, to_owner long")
    obs = spark.range(6000).selectExpr("1 + id % 2 AS snapshot_id", "cast(id div 2 AS string) AS row_uid", "cast(if(id = 7, 0, id div 2) AS string) AS content_hash")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        status = diff.record_status(pairs, obs)
        plan = status._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert not re.search(r"SortMergeJoin \[snapshot_id#\d+L?\], \[snapshot_id", plan) and ("BroadcastHashJoin" in plan) is (most > 0)
    assert {(r.from_snapshot, r.status): r.n for r in status.groupBy("from_snapshot", "status").agg(F.count("*").alias("n")).collect()} == {(1, "same"): 2999, (1, "revised"): 1, (2, "same"): 3000}
    seen = diff.last_seen(spark.createDataFrame([(1, "s"), (2, "s")], "snapshot_id long, source_key string"), obs)
    assert seen.where("last_snapshot = 2 AND source_key = 's'").count() == seen.count() == 3000


def test_field_moves_read_the_deltas_once(spark):
    data = [("s", 1, 2, {k: ("1", "2") for k in fields}) for fields in ("ab", "ba", "a", "", "bc")] + [("t", 1, 2, {"a": ("1", "2")})]
    moves = volatility.field_moves(spark.createDataFrame(data, f"source_key string, from_snapshot long, to_snapshot long, deltas {DELTAS}"))
    assert {(r.source_key, r.field, r.n, r.total) for r in moves.collect()} == {("s", "a", 3, 4), ("s", "b", 3, 4), ("s", "c", 1, 4), ("t", "a", 1, 1)}
    assert "Join" not in moves._jdf.queryExecution().optimizedPlan().toString()


def test_deltas_need_no_payload_of_what_stayed_and_sort_none_before_the_shuffle(spark):
    status = spark.createDataFrame([("s", 1, 2, "u", "a", "b", "revised"), ("s", 1, 2, "v", "c", "c", "same"), ("s", 1, 2, "w", "a", "z", "revised")], "source_key string, from_snapshot long, to_snapshot long, row_uid string, before_hash string, after_hash string, status string")
    blobs = spark.createDataFrame([("a", {"x": "1", "y": "0"}), ("b", {"x": "2", "y": "0"}), ("a", {"x": "1", "y": "0"}), ("c", {"x": "9"})], "content_hash string, payload map<string,string>")
    deltas = diff.record_deltas(status, blobs)
    got = {r.row_uid: {k: (v.before, v.after) for k, v in r.deltas.items()} for r in deltas.collect()}
    assert got == {"u": {"x": ("1", "2")}, "w": {"x": ("1", None), "y": ("0", None)}} and deltas.count() == 2
    plan = diff.record_deltas(status, blobs)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "RepartitionByExpression [content_hash" in plan
