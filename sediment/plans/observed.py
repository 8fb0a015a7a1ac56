"""Observations derived from the driver's tables by arithmetic on their keys, in Spark and in SQL alike.

``orders`` is observed three times as the source ``orders``: amounts of three orders doubled, a priority renamed, a
status advanced, records dropped, added and back again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import fingerprint

FIELDS = ("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice", "status")
ADDED = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three observations under each other, with ``snapshot_id``."""
    base = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderstatus").alias("status"))
    k = F.col("o_orderkey")
    changed = base.select(
        "o_custkey",
        "o_orderdate",
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "LOW").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k.isin(1, 2, 4), F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when((F.col("status") == "O") & (k % 50 == 2), "F").otherwise(F.col("status")).alias("status"),
    )
    added = changed.where(k % 500 == 7).withColumn("o_orderkey", k + ADDED)
    second = changed.where(k % 200 != 3).unionByName(added)
    third = changed.where(k % 400 != 3).unionByName(added)
    out = None
    for n, v in ((1, base), (2, second), (3, third)):
        v = v.withColumn("snapshot_id", F.lit(n).cast("long"))
        out = v if out is None else out.unionByName(v)
    return out


VERSIONS_SQL = f"""
base AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_totalprice, o_orderstatus AS status FROM orders),
changed AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey IN (1, 2, 4) THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN status = 'O' AND o_orderkey % 50 = 2 THEN 'F' ELSE status END AS status FROM base),
added AS (SELECT * REPLACE (o_orderkey + {ADDED} AS o_orderkey) FROM changed WHERE o_orderkey % 500 = 7),
v AS (SELECT 1::BIGINT AS snapshot_id, * FROM base
  UNION ALL SELECT 2, * FROM changed WHERE o_orderkey % 200 <> 3 UNION ALL SELECT 2, * FROM added
  UNION ALL SELECT 3, * FROM changed WHERE o_orderkey % 400 <> 3 UNION ALL SELECT 3, * FROM added),
t AS (SELECT snapshot_id, o_orderkey::VARCHAR AS row_uid, o_custkey::VARCHAR AS o_custkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') AS o_orderdate,
  o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, regexp_replace(o_totalprice::VARCHAR, '^(-?[0-9]+)\\.0+$', '\\1') AS o_totalprice, status FROM v),
obs AS (SELECT *, sha256('{{"o_custkey":"' || o_custkey || '","o_orderdate":"' || o_orderdate || '","o_orderkey":"' || o_orderkey || '","o_orderpriority":"' || o_orderpriority
  || '","o_totalprice":"' || o_totalprice || '","status":"' || status || '"}}') AS content_hash FROM t)"""

#: Both sides of the two pairs, record by record.
STATUS_SQL = f"""{VERSIONS_SQL},
sides AS (SELECT p AS from_snapshot, obs.*, obs.snapshot_id = p AS is_before FROM obs, (VALUES (1::BIGINT), (2::BIGINT)) q(p) WHERE obs.snapshot_id IN (p, p + 1)),
st AS (SELECT from_snapshot, from_snapshot + 1 AS to_snapshot, coalesce(a.row_uid, b.row_uid) AS row_uid, a.content_hash AS before_hash, b.content_hash AS after_hash,
    CASE WHEN a.row_uid IS NULL THEN 'arrived' WHEN b.row_uid IS NULL THEN 'departed' WHEN a.content_hash = b.content_hash THEN 'same' ELSE 'revised' END AS status
  FROM (SELECT * FROM sides WHERE is_before) a FULL JOIN (SELECT * FROM sides WHERE NOT is_before) b USING (from_snapshot, row_uid)),
moved AS (SELECT s.from_snapshot, s.to_snapshot, s.row_uid, u.field, u.before, u.after FROM st s JOIN obs a ON a.snapshot_id = s.from_snapshot AND a.row_uid = s.row_uid
    JOIN obs b ON b.snapshot_id = s.to_snapshot AND b.row_uid = s.row_uid,
  LATERAL (SELECT unnest(['o_custkey', 'o_orderdate', 'o_orderpriority', 'o_totalprice', 'status']) AS field, unnest([a.o_custkey, a.o_orderdate, a.o_orderpriority, a.o_totalprice, a.status]) AS before,
    unnest([b.o_custkey, b.o_orderdate, b.o_orderpriority, b.o_totalprice, b.status]) AS after) u WHERE s.status = 'revised' AND u.before IS DISTINCT FROM u.after),
shapes AS (SELECT from_snapshot, to_snapshot, row_uid, count(*) AS n, bool_and(field = 'status') AS only_status, bool_or(field = 'status') AS any_status,
    max(CASE field WHEN 'status' THEN 0.95 WHEN 'o_orderdate' THEN 0.9 WHEN 'o_totalprice' THEN 0.85 ELSE 0.4 END) AS top, string_agg(field || '=' || before || '>' || after, '|' ORDER BY field) AS signature,
    string_agg(field, '|' ORDER BY field) AS shape FROM moved GROUP BY 1, 2, 3),
rev AS (SELECT *, CASE WHEN only_status THEN 'lifecycle_progression' ELSE 'semantic_revision' END AS kind0,
    CASE WHEN only_status THEN 0.2 WHEN any_status AND n > 1 THEN round(round(least(1.0, top + least(0.15, 0.03 * (n - 1))), 3) * 0.4, 3) ELSE round(least(1.0, top + least(0.15, 0.03 * (n - 1))), 3) END AS sig0 FROM shapes),
counted AS (SELECT *, count(*) OVER (PARTITION BY from_snapshot, kind0, signature) AS alike, count(*) OVER (PARTITION BY from_snapshot, kind0, shape) AS shaped,
    count(*) OVER (PARTITION BY from_snapshot, kind0) AS revisions FROM rev),
vol AS (SELECT from_snapshot, count(*) FILTER (status = 'departed') AS gone, count(*) FILTER (status = 'arrived') AS come FROM st GROUP BY 1),
seen AS (SELECT row_uid, max(snapshot_id) AS last_snapshot FROM obs GROUP BY 1),
pres AS (SELECT s.from_snapshot, s.to_snapshot, s.row_uid, CASE WHEN s.status = 'arrived' THEN 'retroactive_append' WHEN last_snapshot > s.to_snapshot THEN 'transient_absence' ELSE 'deletion' END AS kind0,
    CASE WHEN least(gone, come) > 0 THEN least(gone, come)::DOUBLE / greatest(gone, come) ELSE 0 END AS balance FROM st s JOIN vol USING (from_snapshot) JOIN seen USING (row_uid) WHERE s.status IN ('arrived', 'departed')),
changes AS (SELECT from_snapshot, to_snapshot, row_uid, CASE WHEN kind0 = 'semantic_revision' AND alike >= 25 THEN 'coordinated_revision' ELSE kind0 END AS kind,
    round(CASE WHEN kind0 <> 'semantic_revision' THEN sig0 WHEN alike >= 25 THEN round(sig0 * 0.25, 3) WHEN shaped <= 3 AND revisions >= 2 THEN least(1.0, sig0 + 0.2) ELSE sig0 END, 3) AS significance FROM counted
  UNION ALL SELECT from_snapshot, to_snapshot, row_uid, CASE WHEN kind0 IN ('deletion', 'retroactive_append') AND balance >= 0.9 THEN 'identity_churn' ELSE kind0 END,
    round(CASE WHEN kind0 = 'transient_absence' THEN 0.1 WHEN balance >= 0.9 THEN 0.15 ELSE (CASE kind0 WHEN 'deletion' THEN 1.0 ELSE 0.6 END) * (1 - balance) END, 3) FROM pres)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snapshot_id``, ``row_uid``, ``payload`` and hashes of the three observations of ``orders``."""
    return fingerprint(versions(spark, sf_dir), ["o_orderkey"], keep=["snapshot_id"]).withColumnRenamed("content", "payload")


def snapshots(spark: SparkSession) -> DataFrame:
    """The snapshot rows of the three observations."""
    rows = [(n, "orders", f"2024-01-0{n}T00:00:00", "ok", list(FIELDS)) for n in (1, 2, 3)]
    return spark.createDataFrame(rows, "snapshot_id long, source_key string, captured_at string, status string, columns array<string>")


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watchlist over ``nation``: 25 sources in five cities."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    cls = F.when(k % 5 == 0, "republish").when(k % 5 == 1, "bulk_touch").when(k % 5 == 2, "incremental").when(k % 5 == 3, "static")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("n"), k.cast("string")).alias("source_key"), F.lit("data.example.org").alias("domain"), F.format_string("%04d-aaaa", k).alias("dataset"), F.col("n_name").alias("title"), F.col("r_name").alias("city"), cls.alias("pipeline_class"),
        F.array(F.lit("id")).alias("business_key"), F.concat(F.lit("civic_weight=60; stratum_rows_at_discovery="), (k * 10).cast("string")).alias("notes"),
    )


WATCHED_SQL = """
src AS (SELECT 'n' || n_nationkey AS source_key, n_name AS title, r_name AS city, n_nationkey,
  CASE n_nationkey % 5 WHEN 0 THEN 'republish' WHEN 1 THEN 'bulk_touch' WHEN 2 THEN 'incremental' WHEN 3 THEN 'static' END AS pipeline_class
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def watched_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of the watchlist over ``customer``: good ones with roots that repeat, and failures."""
    k = F.col("c_custkey")
    ok = k % 10 != 0
    return table(spark, sf_dir, "customer").where("c_nationkey < 24").select(
        k.alias("snapshot_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source_key"), F.concat(F.lit("2024-01-01T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00")).alias("captured_at"),
        F.when(ok, "ok").otherwise("error").alias("status"), F.when(ok, (k * 7) % 300).alias("row_count"), F.when(ok, F.concat(F.lit("root"), F.floor(k / 100).cast("string"))).alias("merkle_root"),
        F.when(k % 7 == 0, "content").otherwise("business_key").alias("identity_mode"), (k % 3).alias("key_collisions"), (F.floor(k / 40) * 5).alias("frozen_past_count"), F.concat(F.lit("v"), (k % 2).cast("string")).alias("volatile_digest"),
        F.when(F.floor(k / 500) % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("c"))).alias("columns"),
    )


SNAPSHOTS_SQL = """
snap AS (SELECT c_custkey AS snapshot_id, 'n' || c_nationkey AS source_key, '2024-01-01T' || lpad((c_custkey % 24)::VARCHAR, 2, '0') || ':00:00' AS captured_at,
  CASE WHEN c_custkey % 10 <> 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey * 7) % 300 END AS row_count,
  CASE WHEN c_custkey % 10 <> 0 THEN 'root' || (c_custkey // 100) END AS merkle_root, CASE WHEN c_custkey % 7 = 0 THEN 'content' ELSE 'business_key' END AS identity_mode,
  c_custkey % 3 AS key_collisions, (c_custkey // 40) * 5 AS frozen_past_count, 'v' || (c_custkey % 2) AS volatile_digest,
  CASE WHEN (c_custkey // 500) % 2 = 0 THEN ['a', 'b'] ELSE ['b', 'c'] END AS columns FROM customer WHERE c_nationkey < 24)"""


def recorded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes over ``orders``: all kinds, many equal weights."""
    from ..operators.diff import KINDS

    kinds = F.array(*[F.lit(x) for x in (*KINDS["material"], *KINDS["artifact"])])
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("change_id"), F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string")).alias("source_key"), (k % 7).alias("from_snapshot"), (k % 7 + 1).alias("to_snapshot"), F.element_at(kinds, (k % 15 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("u"), (k % 4000).cast("string")).alias("row_uid"), F.lit(None).cast("string").alias("before_hash"), F.lit(None).cast("string").alias("after_hash"), F.round((k % 97) / 97, 3).alias("significance"), F.lit("-").alias("detail"),
    )


def changes_sql() -> str:
    from ..operators.diff import KINDS

    kinds = ", ".join(f"'{x}'" for x in (*KINDS["material"], *KINDS["artifact"]))
    return f"""
chg AS (SELECT o_orderkey AS change_id, 'n' || (o_custkey % 25) AS source_key, o_orderkey % 7 AS from_snapshot, o_orderkey % 7 + 1 AS to_snapshot, ([{kinds}])[o_orderkey % 15 + 1] AS kind,
  'u' || (o_orderkey % 4000) AS row_uid, round((o_orderkey % 97) / 97, 3) AS significance FROM orders)"""
