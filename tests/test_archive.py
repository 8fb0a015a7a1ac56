import json

import pytest
from pyspark.sql import functions as F

from sediment.operators import archive as A
from sediment.operators import merkle, report
from sediment.sources import portal
from sediment.streaming import collector

ROWS = "case string, type string, date string"


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


@pytest.fixture
def arc(spark, tmp_path):
    return A.Archive(spark, str(tmp_path / "archive"))


def twenty(change=None):
    return [(f"A{i}", "BURGLARY" if i == change else "THEFT", "2020-01-01") for i in range(20)]


def test_pointer_chain_and_blobs(spark, arc):
    for n, data in ((1, twenty()), (2, twenty()), (3, twenty(5)), (4, twenty())):
        got = arc.commit("s", n, f"2024-01-0{n}", rows(spark, data), ["case"])
        assert got["row_count"] == 20 and got["deduplicated"] is (n == 2)
    assert arc.commit("s", 4, "2024-01-04", rows(spark, twenty(7)), ["case"])["merkle_root"] == arc.commit("s", 1, "x", rows(spark, []), ["case"])["merkle_root"]
    arc.fail("s", 5, "2024-01-05", "x" * 3000)
    assert arc.stats() == {"sources": 0, "snapshots_ok": 4, "snapshots_error": 1, "observations": 60, "blobs": 21, "changes": 0}
    snaps = arc.table("snapshots")
    assert {r.snapshot_id: r.observations_ref for r in snaps.where("status = 'ok'").collect()} == {1: None, 2: 1, 3: None, 4: None}
    assert len(snaps.where("status = 'error'").first().error) == 2000
    ok = snaps.where("status = 'ok'")
    assert merkle.verify_chains(ok).first().ok
    blobs = arc.table("blobs").select("content_hash", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload")))).alias("payload_json"))
    checks = {r.check: (r.checked, r.failed) for r in report.verify(snaps, arc.table("observations"), blobs).collect()}
    assert checks == {"chains": (1, 0), "merkle_roots": (4, 0), "blobs": (21, 0), "inclusion_proofs": (3, 0), "dedup_pointers": (1, 0)}
    bent = blobs.withColumn("payload_json", F.when(F.col("payload_json").contains("BURGLARY"), "{}").otherwise(F.col("payload_json")))
    moved = arc.table("observations").withColumn("content_hash", F.when((F.col("snapshot_id") == 3) & (F.col("row_uid") == "A0"), F.lit("0")).otherwise(F.col("content_hash")))
    checks = {r.check: r.failed for r in report.verify(snaps, moved, bent).collect()}
    assert checks["blobs"] == 1 and checks["merkle_roots"] == 1 and checks["chains"] == 0


def test_a_source_that_answers_each_reading_anew(spark, arc):
    import uuid

    anew = F.udf(lambda: uuid.uuid4().hex, "string").asNondeterministic()
    for n, data in ((1, [(f"A{i}",) for i in range(20)]), (2, [("A1",), ("A1",), ("A2",)])):
        got = arc.commit("s", n, "2024", spark.createDataFrame(data, "case string").withColumn("type", anew()), ["case"])
        stored = arc.table("observations").where(F.col("snapshot_id") == n)
        assert merkle.merkle_roots(merkle.ranked_leaves(stored)).first().merkle_root == got["merkle_root"]
        assert stored.join(arc.table("blobs"), "content_hash").count() == stored.count() == got["row_count"] == len(data)


def test_colliding_keys_fall_back_to_content(spark, arc):
    data = [("A1", "THEFT", "d"), ("A1", "ARSON", "d"), ("A2", "THEFT", "d"), ("A2", "THEFT", "d")]
    got = arc.commit("s", 1, "2024", rows(spark, data), ["case"])
    s = arc.table("snapshots").first()
    assert (s.identity_mode, s.key_collisions, got["row_count"]) == ("content", 2, 3)
    stored = merkle.merkle_roots(merkle.ranked_leaves(arc.table("observations"))).first().merkle_root
    assert stored == got["merkle_root"]  # the root commits to what is stored


def test_write_bookkeeping_moves_only_the_digest(spark, arc):
    for n in (1, 2):
        arc.commit("s", n, "2024", rows(spark, twenty()).withColumn("last_updated", F.lit(str(n))), ["case"])
    a, b = arc.table("snapshots").orderBy("snapshot_id").collect()
    assert a.merkle_root == b.merkle_root and a.volatile_digest != b.volatile_digest and b.observations_ref == 1


def test_empty_observation(spark, arc):
    assert arc.commit("s", 1, "2024", rows(spark, []), ["case"])["merkle_root"] == merkle.EMPTY_ROOT


def test_prune_drops_payloads_that_nothing_refers_to(spark):
    t = {
        "sources": spark.createDataFrame([("a",), ("b",)], "source_key string"),
        "snapshots": spark.createDataFrame([(1, "a"), (2, "b")], "snapshot_id long, source_key string"),
        "observations": spark.createDataFrame([(1, "x"), (1, "y"), (2, "y")], "snapshot_id long, content_hash string"),
        "changes": spark.createDataFrame([("a",), ("b",)], "source_key string"),
        "diff_runs": spark.createDataFrame([(1, 1), (2, 2)], "from_snapshot long, to_snapshot long"),
        "blobs": spark.createDataFrame([("x",), ("y",), ("z",)], "content_hash string"),
    }
    got = A.prune(t, spark.createDataFrame([("a",)], "source_key string"))
    assert {k: v.count() for k, v in got.items()} == {"sources": 1, "snapshots": 1, "observations": 1, "changes": 1, "diff_runs": 1, "blobs": 1}


def test_stream_of_drops(spark, arc, tmp_path):
    drops = str(tmp_path / "drops")
    schema = ROWS + ", source_key string, captured_at string"
    for n, change in ((1, None), (2, None), (3, 5)):
        both = rows(spark, twenty(change)).withColumn("captured_at", F.lit(f"2024-01-0{n}"))
        both.withColumn("source_key", F.lit("s")).unionByName(both.limit(3).withColumn("source_key", F.lit("t"))).coalesce(1).write.mode("append").parquet(drops)
    for _ in range(2):  # a second run finds nothing new
        q = collector.collect(collector.drops(spark, drops, schema), arc, {"s": ["case"], "t": ["case"]}, str(tmp_path / "ck"))
        q.awaitTermination()
    snaps = arc.table("snapshots").where("status = 'ok'")
    assert {(r.source_key, r.n) for r in snaps.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).collect()} == {("s", 3), ("t", 3)}
    assert all(r.ok for r in merkle.verify_chains(snaps).collect())


def test_late_rows_after_a_window_closed(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    event = lambda *t: spark.createDataFrame([(x,) for x in t], "t string").select(F.to_timestamp("t").alias("ts"))
    event("2024-01-01 00:01", "2024-01-01 00:02", "2024-01-02 00:00").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema("ts timestamp").parquet(src)
        q = collector.closed_windows(stream, "ts", "1 hour", "10 minutes").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        event("2024-01-01 00:03", "2024-01-03 00:00").coalesce(1).write.mode("append").parquet(src)
    late = collector.late_rows(spark.read.parquet(src), spark.read.parquet(out), "ts", "1 hour").where("then IS NOT NULL").collect()
    assert [(r.then, r.late) for r in late] == [(2, 2)]


class Fake:
    """A portal of ``n`` rows that fails as told."""

    def __init__(self, n, fail=()):
        self.n, self.fail, self.urls = n, list(fail), []

    def __call__(self, url):
        import urllib.error
        import urllib.parse

        self.urls.append(url)
        if self.fail and (code := self.fail.pop(0)):
            raise urllib.error.HTTPError(url, code, "no", {"Retry-After": "7"} if code == 429 else {}, None)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(url).query).items()}
        if "count" in q.get("$select", ""):
            return portal.Response([{"n": str(self.n)}], {})
        a = int(q.get("$offset", 0))
        return portal.Response([{"id": i} for i in range(a, min(self.n, a + int(q.get("$limit", 1000))))], {"ETag": "e", "X-Other": "o"})


def test_portal_client():
    slept = []
    c = portal.Client(Fake(5000, [503, 429, 0]), sleep=slept.append, clock=lambda: 0.0)
    assert len(list(c.pages("d", "x", size=2000))) == 5000 and c.count("d", "x") == 5000
    assert 2.0 in slept and 7.0 in slept and slept.count(portal.PAUSE_S) >= 4
    assert len(list(c.pages("d", "x", size=2000, most=3000))) == 3000
    with pytest.raises(portal.PortalError):
        portal.Client(Fake(1, [404]), sleep=slept.append).rows("d", "x")
    with pytest.raises(portal.PortalError):
        portal.Client(Fake(1, [500] * 9), sleep=slept.append).rows("d", "x")
    assert portal.provenance({"ETag": "e", "X-Other": "o", "X-SODA2-Truth-Last-Modified": "t"}) == {"etag": "e", "x-soda2-truth-last-modified": "t"}


def test_portal_reader_covers_every_row_once():
    fake = Fake(4321)
    r = portal.PortalReader({"domain": "d", "dataset": "x", "page": "500", "readers": "3"}, lambda: portal.Client(fake, pause=0))
    got = [json.loads(t[0])["id"] for p in r.partitions() for t in r.read(p)]
    assert sorted(got) == list(range(4321)) and len(r.partitions()) == 3


def test_a_blob_that_is_there_twice_counts_once(spark, arc):
    arc.commit("s", 1, "2024-01-01", rows(spark, twenty()), ["case"])
    blobs = arc.table("blobs").select("content_hash", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload")))).alias("payload_json"))
    for again, failed in ((blobs, 0), (blobs.limit(1).withColumn("payload_json", F.lit("{}")), 1)):
        checks = {r.check: (r.checked, r.failed) for r in report.verify(arc.table("snapshots"), arc.table("observations"), blobs.unionByName(again)).collect()}
        assert checks["blobs"] == (20, failed) and checks["inclusion_proofs"] == (1, 0) and checks["merkle_roots"] == (1, 0)


def test_first_arrivals_shuffle_what_is_wanted_once(spark):
    from sediment.functions.records import fingerprint

    data = spark.createDataFrame([(k % 50, k % 7, k) for k in range(300)], "case long, ward long, at long")
    prints = fingerprint(data, ["case"], keep=["at"])
    want = {str(c): str(min(k for k in range(300) if k % 50 == c) % 7) for c in range(50)}
    whole, part = A.first_arrival(prints, "at"), A.first_arrival(prints, "at", F.col("content")["ward"])
    assert {r.row_uid: r.payload["ward"] for r in whole.collect()} == {r.row_uid: r.payload for r in part.collect()} == want
    stored = {(r.row_uid, r.content_hash, r.volatile_hash) for r in prints.collect()}
    assert all((r.row_uid, r.content_hash, r.volatile_hash) in stored for r in whole.collect())
    plan = A.first_arrival(prints, "at", F.col("content")["ward"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("partial_min_by") < plan.index("Exchange")


def test_blobs_are_joined_by_bytes_and_an_attempt_that_ended_early_adds_the_rest(spark, arc):
    one = spark.createDataFrame([("ab" * 32, {"x": "1"}), ("ab" * 32, {"x": "1"}), ("cd" * 32, {"x": "2"})], "content_hash string, payload map<string,string>")
    new = A.new_blobs(one, one.where("payload['x'] = '2'"))
    assert [(r.content_hash, r.payload) for r in new.collect()] == [("ab" * 32, {"x": "1"})]
    assert "unhex" in new._jdf.queryExecution().optimizedPlan().toString()
    arc.commit("s", 1, "2024-01-01", rows(spark, twenty()), ["case"])
    arc.clear("snapshots")
    part = arc.table("observations").where("row_uid < 'A5'").cache()
    n = part.count()
    arc.clear("observations")
    arc.append("observations", part)
    arc.commit("s", 1, "2024-01-01", rows(spark, twenty()), ["case"])
    assert 0 < n < 20 and arc.table("observations").count() == arc.table("observations").select("row_uid").distinct().count() == arc.table("blobs").count() == 20
