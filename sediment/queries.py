"""Every core operator as a query over the driver's tables, with its SQL."""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import deltas as D
from .functions import records as R
from .operators import archive as A
from .operators import confirm as C
from .operators import diff, discovery, merkle, publishers, report, volatility
from .plans import observed as O
from .plans.analysis import analyse
from .plans.observed import table
from .sources.shared import checkpoint_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = dt.datetime(2000, 1, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- records ----------------------------------------------------------------------------------------------------------


@query(f"WITH {O.VERSIONS_SQL} SELECT row_uid, content_hash FROM obs WHERE snapshot_id = 1")
def fingerprint_orders(spark, d):
    return O.observations(spark, d).where("snapshot_id = 1").select("row_uid", "content_hash")


@query("""SELECT c_custkey::VARCHAR AS row_uid, sha256('{"c_acctbal":"' || regexp_replace(c_acctbal::VARCHAR, '^(-?[0-9]+)\\.0+$', '\\1') || '","c_custkey":"' || c_custkey || '","c_mktsegment":"' || c_mktsegment
  || '","c_name":"' || c_name || '","c_nationkey":"' || c_nationkey || '"}') AS content_hash, sha256('{}') AS volatile_hash FROM customer""")
def content_hash_customer(spark, d):
    return R.fingerprint(table(spark, d, "customer"), ["c_custkey"]).select("row_uid", "content_hash", "volatile_hash")


@query("""SELECT count(*) AS rows_fetched, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_row_uids, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS key_collisions, 'content' AS identity_mode FROM lineitem""")
def key_collision_lineitem(spark, d):
    return R.collisions(R.fingerprint(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("SELECT count(*) AS n, count(DISTINCT (SELECT l)) AS identities FROM lineitem l")
def content_identity_lineitem(spark, d):
    return R.fingerprint(table(spark, d, "lineitem"), []).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_uid").alias("identities"))


@query("""SELECT row_uid, l_partkey FROM (SELECT l_orderkey || '|' || l_linenumber AS row_uid, l_partkey::VARCHAR AS l_partkey,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey * 100000 + l_suppkey) AS k FROM lineitem) WHERE k = 1""")
def dedup_first_arrival(spark, d):
    rows = table(spark, d, "lineitem").withColumn("arrival", F.col("l_partkey") * 100000 + F.col("l_suppkey"))
    one = A.first_arrival(R.fingerprint(rows, ["l_orderkey", "l_linenumber"], keep=["arrival"]), "arrival", F.col("content")["l_partkey"])
    return one.select("row_uid", F.col("payload").alias("l_partkey"))


NAMES = ("last_updated", "status_date", "refresh_time", "modified_by", "load_capacity", ":created_at", "computed_region_x", "row_id", "last_name", "data_as_of", "l_shipdate")


@query("SELECT unnest(['last_updated', 'status_date', 'refresh_time', 'modified_by', 'load_capacity', ':created_at', 'computed_region_x', 'row_id', 'last_name', 'data_as_of', 'l_shipdate']) AS name, unnest(['volatile', 'semantic', 'volatile', 'volatile', 'semantic', 'system', 'system', 'volatile', 'semantic', 'volatile', 'semantic']) AS role")
def field_roles(spark, d):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return names.select("name", F.when(R.is_system(F.col("name")), "system").when(R.is_volatile(F.col("name")), "volatile").otherwise("semantic").alias("role"))


WEIGHED = {"crime_type": 1.0, "case_status": 0.95, "report_date": 0.9, "arrest_date": 0.9, "fee_amount": 0.85, "comments": 0.7, "weapon_used": 1.0, "ward": 0.5, "street": 0.45, "longitude": 0.2, "permit_number": 0.3, "shade": 0.4}


@query(f"SELECT name, weight, count(*) AS n FROM (SELECT ({list(WEIGHED)})[p_partkey % 12 + 1] AS name, ({list(WEIGHED.values())})[p_partkey % 12 + 1]::DOUBLE AS weight FROM part) GROUP BY ALL")
def field_weights(spark, d):
    names = table(spark, d, "part").select(F.element_at(F.array(*map(F.lit, WEIGHED)), (F.col("p_partkey") % 12 + 1).cast("int")).alias("name"))
    return names.groupBy("name", D.field_weight(F.col("name")).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


# -- scans and counts -------------------------------------------------------------------------------------------------

STRATUM = ("1996-01-01", "1997-01-01")


@query(f"SELECT count(*) FILTER (o_orderdate < '{STRATUM[1]}') AS frozen_past_count, count(*) FILTER (o_orderdate >= '{STRATUM[0]}' AND o_orderdate < '{STRATUM[1]}') AS stratum_count FROM orders")
def window_counts(spark, d):
    from .sources.tables import window_counts as counts

    return counts(table(spark, d, "orders"), "o_orderdate", *STRATUM)


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '{STRATUM[0]}' AND o_orderdate < '{STRATUM[1]}'")
def stratum_scan(spark, d):
    from .sources.tables import stratum

    return stratum(table(spark, d, "orders"), "o_orderdate", *STRATUM).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def page_scan(spark, d):
    from .sources.tables import page

    return page(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 500, 1000)


@query("""SELECT 'o_orderpriority' AS dim, o_orderpriority AS category, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY ALL""")
def category_tallies(spark, d):
    from .sources.tables import tallies

    return tallies(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


# -- comparison -------------------------------------------------------------------------------------------------------


def _compared(spark, d):
    obs = O.observations(spark, d)
    status = diff.record_status(diff.pairs(O.snapshots(spark)), obs)
    return obs, status


@query(f"WITH {O.STATUS_SQL} SELECT from_snapshot, to_snapshot, status, count(*) AS n FROM st GROUP BY ALL")
def snapshot_diff_status(spark, d):
    return _compared(spark, d)[1].groupBy("from_snapshot", "to_snapshot", "status").agg(F.count(F.lit(1)).alias("n"))


def _deltas(spark, d):
    obs, status = _compared(spark, d)
    return diff.record_deltas(status, obs.select("content_hash", "payload"))


@query(f"WITH {O.STATUS_SQL} SELECT from_snapshot, to_snapshot, row_uid, field, before, after FROM moved")
def field_deltas(spark, d):
    return _deltas(spark, d).select("from_snapshot", "to_snapshot", "row_uid", F.explode("deltas").alias("field", "v")).select("from_snapshot", "to_snapshot", "row_uid", "field", "v.before", "v.after")


@query(f"WITH {O.VERSIONS_SQL} SELECT a.snapshot_id AS from_snapshot, a.row_uid, a.content_hash AS before_hash FROM obs a ANTI JOIN obs b ON b.snapshot_id = a.snapshot_id + 1 AND b.row_uid = a.row_uid WHERE a.snapshot_id < 3")
def departures_anti(spark, d):
    return _compared(spark, d)[1].where("status = 'departed'").select("from_snapshot", "row_uid", "before_hash")


@query(f"WITH {O.VERSIONS_SQL} SELECT b.snapshot_id - 1 AS from_snapshot, b.row_uid, b.content_hash AS after_hash FROM obs b ANTI JOIN obs a ON a.snapshot_id = b.snapshot_id - 1 AND a.row_uid = b.row_uid WHERE b.snapshot_id > 1")
def arrivals_anti(spark, d):
    return _compared(spark, d)[1].where("status = 'arrived'").select("from_snapshot", "row_uid", "after_hash")


@query(f"WITH {O.STATUS_SQL} SELECT row_uid, last_snapshot FROM st JOIN seen USING (row_uid) WHERE status = 'departed' AND last_snapshot > to_snapshot")
def seen_again_semi(spark, d):
    obs, status = _compared(spark, d)
    seen = diff.last_seen(O.snapshots(spark), obs)
    return status.where("status = 'departed'").join(seen, ["source_key", "row_uid"]).where("last_snapshot > to_snapshot").select("row_uid", "last_snapshot")


def _changes(spark, d):
    # what several parts of the plan read is written once: the observations, the records that moved, their deltas
    obs = written(O.observations(spark, d).select("snapshot_id", "row_uid", "payload", "content_hash"), "observations")
    moved = written(diff.record_status(diff.pairs(O.snapshots(spark)), obs).where("status <> 'same'"), "moved")
    deltas = written(diff.record_deltas(moved, obs.select("content_hash", "payload")), "deltas")
    return diff.record_changes(moved, deltas, diff.last_seen(O.snapshots(spark), obs))


@query(f"WITH {O.STATUS_SQL} SELECT from_snapshot, to_snapshot, kind, count(*) AS n FROM changes GROUP BY ALL")
def classify_changes(spark, d):
    return _changes(spark, d).groupBy("from_snapshot", "to_snapshot", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O.STATUS_SQL} SELECT from_snapshot, row_uid, kind, significance FROM changes")
def significance(spark, d):
    return _changes(spark, d).select("from_snapshot", "row_uid", "kind", "significance")


@query(f"WITH {O.STATUS_SQL} SELECT row_uid, significance FROM changes WHERE kind = 'coordinated_revision'")
def coordinated_changes(spark, d):
    return _changes(spark, d).where("kind = 'coordinated_revision'").select("row_uid", "significance")


@query("""WITH k AS (SELECT p_partkey::VARCHAR AS row_uid, p_partkey % 3 AS s FROM part WHERE p_partkey % 10 < 4),
c AS (SELECT 's' || s AS source_key, row_uid, CASE WHEN p % 2 = 0 THEN 'deletion' ELSE 'retroactive_append' END AS kind FROM (SELECT *, row_uid::BIGINT AS p FROM k) WHERE s <> 1 OR p % 20 < 12),
v AS (SELECT source_key, count(*) FILTER (kind = 'deletion') AS gone, count(*) FILTER (kind <> 'deletion') AS come FROM c GROUP BY 1)
SELECT source_key, row_uid, CASE WHEN source_key = 's2' OR least(gone, come)::DOUBLE / greatest(gone, come) >= 0.9 THEN 'identity_churn' ELSE kind END AS kind,
  CASE WHEN source_key = 's2' THEN 0.1 WHEN least(gone, come)::DOUBLE / greatest(gone, come) >= 0.9 THEN 0.15
    ELSE round((CASE kind WHEN 'deletion' THEN 1.0 ELSE 0.6 END) * (1 - least(gone, come)::DOUBLE / greatest(gone, come)), 3) END AS significance FROM c JOIN v USING (source_key)""")
def identity_churn(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").where((k % 10 < 4) & ((k % 3 != 1) | (k % 20 < 12))).select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("source_key"), k.cast("string").alias("row_uid"), F.when(k % 2 == 0, "deletion").otherwise("retroactive_append").alias("kind"))
    none = {"before_hash": "string", "after_hash": "string", "field_deltas": D.DELTAS, "detail": "string"}
    c = rows.select("*", F.lit(1).cast("long").alias("from_snapshot"), F.lit(2).cast("long").alias("to_snapshot"), F.when(F.col("kind") == "deletion", 1.0).otherwise(0.6).alias("significance"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    v = c.groupBy(*diff.PAIR).agg(F.count(F.when(F.col("kind") == "deletion", 1)).alias("gone"), F.count(F.when(F.col("kind") != "deletion", 1)).alias("arrived"))
    modes = v.select(*diff.PAIR, F.when(F.col("source_key") == "s2", "content").otherwise("business_key").alias("identity_mode"))
    return diff.identity_churn(c, v, modes).select("source_key", "row_uid", "kind", "significance")


_LEAD = "lead({0}) OVER (PARTITION BY source_key ORDER BY snapshot_id)"


@query(f"""WITH {O.SNAPSHOTS_SQL}, p AS (SELECT source_key, snapshot_id AS from_snapshot, {_LEAD.format('snapshot_id')} AS to_snapshot, columns AS b, {_LEAD.format('columns')} AS a FROM snap WHERE status = 'ok')
SELECT source_key, from_snapshot, to_snapshot, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS added, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS removed, 0.9::DOUBLE AS significance
FROM p WHERE to_snapshot IS NOT NULL AND a <> b""")
def schema_drift(spark, d):
    return diff.schema_drift(O.watched_snapshots(spark, d)).select(*diff.PAIR, F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "significance")


@query(f"""WITH {O.SNAPSHOTS_SQL}, p AS (SELECT source_key, snapshot_id AS from_snapshot, {_LEAD.format('snapshot_id')} AS to_snapshot, frozen_past_count AS before, {_LEAD.format('frozen_past_count')} AS after FROM snap)
SELECT *, CASE WHEN after < before THEN 0.95 ELSE 0.55 END::DOUBLE AS significance FROM p WHERE before <> after""")
def frozen_past_shift(spark, d):
    return diff.frozen_past_shift(O.watched_snapshots(spark, d).select("source_key", "snapshot_id", "frozen_past_count"))


def _tallies(spark, d):
    v = O.versions(spark, d)
    return v.groupBy("snapshot_id", F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("source_key"), "snapshot_id", F.lit("o_orderpriority").alias("dim"), "category", "n")


_MOVES = """m AS (SELECT p AS from_snapshot, category, coalesce(sum(n) FILTER (snapshot_id = p), 0)::BIGINT AS before, coalesce(sum(n) FILTER (snapshot_id = p + 1), 0)::BIGINT AS after
  FROM (SELECT snapshot_id, o_orderpriority AS category, count(*) AS n FROM v GROUP BY ALL), (VALUES (1::BIGINT), (2::BIGINT)) q(p) WHERE snapshot_id IN (p, p + 1) GROUP BY 1, 2)"""


@query(f"WITH {O.VERSIONS_SQL}, {_MOVES} SELECT from_snapshot, category, before, after FROM m WHERE before <> after")
def tally_moves(spark, d):
    return diff.tally_moves(_tallies(spark, d), diff.pairs(O.snapshots(spark))).select("from_snapshot", "category", "before", "after")


@query(f"WITH {O.VERSIONS_SQL}, {_MOVES} SELECT from_snapshot, 'o_orderpriority' AS dim, sum(abs(after - before))::BIGINT AS magnitude, count(*) AS categories, 0.56::DOUBLE AS significance FROM m WHERE before <> after GROUP BY 1")
def tally_shift(spark, d):
    return diff.tally_shift(_tallies(spark, d), diff.pairs(O.snapshots(spark))).select("from_snapshot", "dim", "magnitude", "categories", "significance")


@query(f"""WITH {O.SNAPSHOTS_SQL}, p AS (SELECT *, {_LEAD.format('snapshot_id')} AS to_snapshot, {_LEAD.format('merkle_root')} AS root, {_LEAD.format('volatile_digest')} AS digest, {_LEAD.format('row_count')} AS rows FROM snap WHERE status = 'ok')
SELECT source_key, snapshot_id AS from_snapshot, to_snapshot, rows FROM p WHERE merkle_root = root AND volatile_digest <> digest""")
def volatile_digest_churn(spark, d):
    return diff.volatile_churn(O.watched_snapshots(spark, d))


@query(f"""WITH {O.SNAPSHOTS_SQL}, p AS (SELECT source_key, snapshot_id AS from_snapshot, {_LEAD.format('snapshot_id')} AS to_snapshot, columns AS b, {_LEAD.format('columns')} AS a, frozen_past_count AS past, {_LEAD.format('frozen_past_count')} AS now,
  merkle_root, {_LEAD.format('merkle_root')} AS root, volatile_digest, {_LEAD.format('volatile_digest')} AS digest FROM snap WHERE status = 'ok'),
q AS (SELECT *, from_snapshot // 60 AS x, to_snapshot // 60 AS y FROM p WHERE to_snapshot IS NOT NULL)
SELECT source_key, from_snapshot, to_snapshot, 'schema_drift' AS kind, 0.9::DOUBLE AS significance, 2 AS parts FROM q WHERE a <> b
UNION ALL SELECT source_key, from_snapshot, to_snapshot, 'frozen_past_shift', CASE WHEN now < past THEN 0.95 ELSE 0.55 END, 1 FROM q WHERE now <> past
UNION ALL SELECT source_key, from_snapshot, to_snapshot, 'provenance_churn', 0, 0 FROM q WHERE merkle_root = root AND volatile_digest <> digest
UNION ALL SELECT source_key, from_snapshot, to_snapshot, 'tally_shift', 0.6, 1 FROM q WHERE x <> y""")
def table_changes(spark, d):
    s = O.watched_snapshots(spark, d)
    counted = F.array(F.struct(F.lit("north").alias("category"), F.floor(F.col("snapshot_id") / 60).alias("n")), F.struct(F.lit("south").alias("category"), F.lit(7).cast("long").alias("n")))
    tallied = s.select("source_key", "snapshot_id", F.lit("ward").alias("dim"), F.explode(counted).alias("c")).select("source_key", "snapshot_id", "dim", "c.category", "c.n")
    return diff.table_changes(s, tallied).select(*diff.PAIR, "kind", "significance", F.coalesce(F.size("field_deltas"), F.lit(0)).alias("parts"))


#: By the key's remainder: the deltas of a record, the kind that they make, and its weight.
REVISED = (
    ({"names": ("a,b", "b,a")}, "ordering_change", 0.15),
    ({"paid": ("0", "4"), "due": ("9", "5")}, "balance_transfer", 0.2),
    ({"closed": (None, "2024")}, "lifecycle_progression", 0.2),
    ({"current_step": ("1", "2")}, "lifecycle_progression", 0.2),
    ({"age": ("1", "2")}, "provenance_churn", 0.0),
    ({"closed_on": ("a", "b"), "open_days": ("1", "2")}, "semantic_revision", 0.4),
    ({"crime_type": ("a", "b"), "case_status": ("c", "d")}, "semantic_revision", 0.4),
    ({"price": ("5", "6")}, "semantic_revision", 0.4),
    ({"names": ("a,b", "b,a"), "crime_type": ("a", "b")}, "semantic_revision", 0.3),
)


@query(f"SELECT p_partkey::VARCHAR AS row_uid, ({[k for _, k, _ in REVISED]})[p_partkey % {len(REVISED)} + 1] AS kind, ({[w for *_, w in REVISED]})[p_partkey % {len(REVISED)} + 1]::DOUBLE AS significance FROM part")
def revision_kinds(spark, d):
    value = lambda b, a: F.struct(F.lit(b).cast("string").alias("before"), F.lit(a).cast("string").alias("after"))
    each = F.array(*[F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), value(*v).alias("value")) for k, v in x.items()])) for x, *_ in REVISED])
    rows = table(spark, d, "part").select(F.lit("s").alias("source_key"), F.lit(1).cast("long").alias("from_snapshot"), F.lit(2).cast("long").alias("to_snapshot"), F.col("p_partkey").cast("string").alias("row_uid"), F.element_at(each, (F.col("p_partkey") % len(REVISED) + 1).cast("int")).alias("deltas"))
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("before_hash", "after_hash")])
    controls = diff.Controls(spark.createDataFrame([("s", "age")], "source_key string, field string"), spark.createDataFrame([("s", "open_days", "closed_on")], "source_key string, field string, driver string"))
    return diff.classify_revisions(rows, controls).select("row_uid", "kind", "significance")


@query(f"""WITH {O.changes_sql()} SELECT source_key, from_snapshot, kind, count(*) AS n FROM chg WHERE NOT (source_key IN ('n3', 'n4') AND kind IN ('semantic_revision', 'coordinated_revision', 'deletion', 'retroactive_append', 'identity_churn', 'provenance_churn')) AND kind <> 'withdrawn_unstable_key' GROUP BY ALL
UNION ALL SELECT source_key, from_snapshot, 'withdrawn_unstable_key', count(DISTINCT from_snapshot) FROM chg WHERE source_key IN ('n3', 'n4') AND kind IN ('semantic_revision', 'coordinated_revision', 'deletion', 'retroactive_append', 'identity_churn', 'provenance_churn') GROUP BY ALL""")
def withdrawn_unstable(spark, d):
    c = O.recorded_changes(spark, d).where("kind <> 'withdrawn_unstable_key'").withColumn("field_deltas", F.lit(None).cast(D.DELTAS)).select(*diff.COLUMNS)
    unstable = spark.createDataFrame([("n3", "r"), ("n4", "r")], "source_key string, reason string")
    return diff.withdraw_unstable(c, unstable).groupBy("source_key", "from_snapshot", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O.changes_sql()}, {O.WATCHED_SQL} SELECT change_id, title, significance FROM chg JOIN src USING (source_key) WHERE significance >= 0.5 ORDER BY significance DESC, change_id DESC LIMIT 50")
def summarise_changes(spark, d):
    return diff.summarise(O.recorded_changes(spark, d), O.watched(spark, d)).select("change_id", "title", "significance")


# -- learning ---------------------------------------------------------------------------------------------------------


def _learned(spark, d):
    """Raw deltas of five pairs over ``orders``: a clock, a driver with its follower, and an ordinary field."""
    k = F.col("o_orderkey")
    e = F.struct(F.lit("b").alias("before"), F.lit("a").alias("after"))
    field = lambda name, when: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "orders").select(k, F.concat(F.lit("s"), (F.col("o_custkey") % 4).cast("string")).alias("source_key"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("from_snapshot"))
    names = F.concat(field("age_days", F.col("source_key") != "s3"), field("closed_on", k % 3 == 0), field("open_days", k % 3 == 0), field("price", k % 5 == F.col("from_snapshot") % 5), *[field(f"w{i}", F.col("source_key") == "s2") for i in range(4)])
    rows = rows.select("source_key", "from_snapshot", (F.col("from_snapshot") + 1).alias("to_snapshot"), names.alias("names")).where(F.size("names") > 0)
    return rows.select(*diff.PAIR, F.map_from_arrays("names", F.transform("names", lambda _: e)).alias("deltas"))


_LEARNED_SQL = """
raw AS (SELECT o_orderkey AS k, 's' || (o_custkey % 4) AS source_key, p AS from_snapshot FROM orders, range(1, 6) r(p)),
f AS (SELECT *, list_concat(CASE WHEN source_key <> 's3' THEN ['age_days'] ELSE [] END, CASE WHEN k % 3 = 0 THEN ['closed_on', 'open_days'] ELSE [] END,
  CASE WHEN k % 5 = from_snapshot % 5 THEN ['price'] ELSE [] END, CASE WHEN source_key = 's2' THEN ['w0', 'w1', 'w2', 'w3'] ELSE [] END) AS fields FROM raw),
x AS (SELECT source_key, from_snapshot, fields FROM f WHERE len(fields) > 0),
mv AS (SELECT source_key, from_snapshot, field, count(*) AS n FROM (SELECT source_key, from_snapshot, unnest(fields) AS field FROM x) GROUP BY ALL),
tot AS (SELECT source_key, from_snapshot, count(*) AS total FROM x GROUP BY ALL),
vo AS (SELECT source_key, field, count(*) AS pairs_seen, round(avg(n / total), 4) AS mean_share, CASE WHEN avg(n / total) >= 0.9 AND count(*) >= 3 THEN 'recomputed' ELSE 'ordinary' END AS verdict
  FROM mv JOIN tot USING (source_key, from_snapshot) WHERE total >= 20 GROUP BY ALL)"""


@query(f"WITH {_LEARNED_SQL} SELECT * FROM vo")
def field_volatility(spark, d):
    return volatility.field_volatility(volatility.field_moves(_learned(spark, d)))


@query(f"""WITH {_LEARNED_SQL}, m AS (SELECT source_key, field, sum(n)::BIGINT AS n FROM mv GROUP BY ALL), rc AS (SELECT source_key, field FROM vo WHERE verdict = 'recomputed'),
two AS (SELECT source_key, field, driver, count(*) AS together FROM (SELECT source_key, field, unnest(fields) AS driver FROM (SELECT source_key, fields, unnest(fields) AS field FROM x)) WHERE field <> driver GROUP BY ALL),
c AS (SELECT t.source_key, t.field, t.driver, together, a.n, row_number() OVER (PARTITION BY t.source_key, t.field ORDER BY together DESC, t.driver) AS k FROM two t
  JOIN m a ON a.source_key = t.source_key AND a.field = t.field JOIN m b ON b.source_key = t.source_key AND b.field = t.driver
  WHERE a.n >= 8 AND b.n >= a.n AND (t.source_key, t.field) NOT IN (SELECT (source_key, field) FROM rc) AND (t.source_key, t.driver) NOT IN (SELECT (source_key, field) FROM rc)),
d AS (SELECT * FROM c WHERE k = 1 AND together / n >= 0.97)
SELECT source_key, field, driver, n AS observations, round(together / n, 4) AS conditional FROM d
WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.source_key = d.source_key AND e.field = d.driver AND e.driver = d.field
  AND CASE WHEN regexp_matches(d.field, '_to_|days?$|_days') <> regexp_matches(d.driver, '_to_|days?$|_days') THEN NOT regexp_matches(d.field, '_to_|days?$|_days') ELSE d.field > d.driver END)""")
def field_dependency(spark, d):
    deltas = _learned(spark, d)
    return volatility.field_dependency(deltas, volatility.field_volatility(volatility.field_moves(deltas)))


@query(f"""WITH {_LEARNED_SQL}, rc AS (SELECT source_key, field FROM vo WHERE verdict = 'recomputed'), w AS (SELECT source_key, count(*) AS wide FROM rc GROUP BY 1),
b AS (SELECT mv.source_key, mv.from_snapshot, coalesce(max(n) FILTER (rc.field IS NULL), 0) AS s FROM mv LEFT JOIN rc ON rc.source_key = mv.source_key AND rc.field = mv.field GROUP BY 1, 2),
y AS (SELECT source_key, count(*) AS pairs_seen, avg(least(1.0, s / 100000)) AS mean FROM b GROUP BY 1 HAVING count(*) >= 3)
SELECT source_key, pairs_seen, round(mean, 4) AS mean_revised, CASE WHEN coalesce(wide, 0) >= 4 OR mean >= 0.5 THEN 'key_unstable' ELSE 'stable' END AS verdict FROM y LEFT JOIN w USING (source_key)""")
def key_stability(spark, d):
    moves = written(volatility.field_moves(_learned(spark, d)), "moves")
    sizes = spark.range(1, 7).select(F.col("id").alias("snapshot_id"), F.lit("ok").alias("status"), F.lit(100000).cast("long").alias("row_count"))
    return volatility.source_stability(moves, volatility.field_volatility(moves), sizes).select("source_key", "pairs_seen", "mean_revised", "verdict")


# two pairs teach nothing, as three are the least, so both passes give the same changes
@query(f"WITH {O.STATUS_SQL} SELECT unnest(['probe', 'controlled']) AS stage, (SELECT count(*) FROM changes) AS change_count")
def two_pass_analysis(spark, d):
    obs = written(O.observations(spark, d).select("snapshot_id", "row_uid", "payload", "content_hash"), "observations")
    return analyse(O.snapshots(spark).withColumn("row_count", F.lit(1000).cast("long")), obs, obs.select("content_hash", "payload")).stages


# -- archive ----------------------------------------------------------------------------------------------------------


def _leaves(spark, d):
    return merkle.ranked_leaves(O.observations(spark, d).select("snapshot_id", "row_uid", "content_hash"))


_LEAVES_SQL = f"""{O.VERSIONS_SQL},
leaf AS (SELECT snapshot_id, row_uid, row_number() OVER (PARTITION BY snapshot_id ORDER BY row_uid) - 1 AS pos, sha256(unhex('00') || encode('["' || row_uid || '","' || content_hash || '"]')) AS leaf FROM obs)"""
_TREE_SQL = f"""RECURSIVE {_LEAVES_SQL},
tree AS (SELECT snapshot_id, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY snapshot_id) AS size FROM leaf
  UNION ALL SELECT snapshot_id, level + 1, pos // 2, CASE WHEN count(*) = 1 THEN max(node) ELSE sha256(unhex('01') || unhex(max(node) FILTER (pos % 2 = 0)) || unhex(max(node) FILTER (pos % 2 = 1))) END, (max(size) + 1) // 2
  FROM tree WHERE size > 1 GROUP BY snapshot_id, level, pos // 2)"""


@query(f"WITH {_LEAVES_SQL} SELECT snapshot_id, pos, row_uid, leaf FROM leaf")
def ranked_leaves(spark, d):
    return _leaves(spark, d)


@query(f"WITH {_TREE_SQL} SELECT snapshot_id, node AS merkle_root FROM tree WHERE size = 1")
def merkle_root(spark, d):
    return merkle.merkle_roots(_leaves(spark, d))


@query(f"WITH {_TREE_SQL} SELECT t.snapshot_id, t.node AS merkle_root, s.n AS row_count, s.n AS stored FROM tree t JOIN (SELECT snapshot_id, count(*) AS n FROM obs GROUP BY 1) s USING (snapshot_id) WHERE t.size = 1")
def committed_archive(spark, d):
    """Three commits to an archive, and of what it stores then: each snapshot's root, and how many records have their payload."""
    arc = A.Archive(spark, f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}")
    rows = O.versions(spark, d)
    for n in (1, 2, 3):
        arc.commit("orders", n, f"2024-01-0{n}", rows.where(F.col("snapshot_id") == n).drop("snapshot_id"), ["o_orderkey"])
    digest = F.unhex("content_hash").alias("digest")
    stored = arc.table("observations").select("snapshot_id", digest).join(arc.table("blobs").select(digest), "digest").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("stored"))
    return arc.table("snapshots").join(stored, "snapshot_id").select("snapshot_id", "merkle_root", "row_count", "stored")


@query(f"""WITH {_TREE_SQL}, w AS (SELECT snapshot_id, pos AS leaf_index, leaf FROM leaf WHERE pos % 1000 = 7)
SELECT w.snapshot_id, w.leaf_index, w.leaf, string_agg((CASE WHEN t.pos % 2 = 1 THEN 'right:' ELSE 'left:' END) || t.node, ',' ORDER BY t.level) AS proof, max(r.node) AS merkle_root
FROM w JOIN tree t ON t.snapshot_id = w.snapshot_id AND t.size > 1 AND t.pos = xor(w.leaf_index >> t.level, 1) JOIN tree r ON r.snapshot_id = w.snapshot_id AND r.size = 1 GROUP BY 1, 2, 3""")
def merkle_proof(spark, d):
    leaves = _leaves(spark, d)
    proofs = merkle.merkle_proofs(leaves, leaves.where("pos % 1000 = 7").select("snapshot_id", "pos"))
    return proofs.withColumn("proof", F.array_join(F.transform("proof", lambda s: F.concat(s["side"], F.lit(":"), s["hash"])), ","))


@query(f"WITH {_LEAVES_SQL} SELECT snapshot_id, pos AS leaf_index, true AS valid, true AS forgery_rejected FROM leaf WHERE pos % 1000 = 7")
def verify_proofs(spark, d):
    leaves = _leaves(spark, d)
    p = merkle.merkle_proofs(leaves, leaves.where("pos % 1000 = 7").select("snapshot_id", "pos"))
    return p.select("snapshot_id", "leaf_index", merkle.proof_leads_to(F.col("leaf"), F.col("proof"), F.col("merkle_root")).alias("valid"), (~merkle.proof_leads_to(F.sha2("leaf", 256), F.col("proof"), F.col("merkle_root"))).alias("forgery_rejected"))


def _links(spark, d):
    ok = O.watched_snapshots(spark, d).where("status = 'ok'")
    return ok.withColumn("meta_json", F.concat(F.lit('{"row_count":'), F.col("row_count").cast("string"), F.lit("}")))


_CHAIN_SQL = f"""RECURSIVE {O.SNAPSHOTS_SQL}, o AS (SELECT source_key, snapshot_id, merkle_root, row_count, row_number() OVER (PARTITION BY source_key ORDER BY snapshot_id) AS k FROM snap WHERE status = 'ok'),
ch AS (SELECT source_key, 0::BIGINT AS k, 0::BIGINT AS snapshot_id, '{merkle.GENESIS}' AS chain_hash
  UNION ALL SELECT o.source_key, o.k, o.snapshot_id, sha256('["' || ch.chain_hash || '","' || o.merkle_root || '",{{"row_count":' || o.row_count || '}}]') FROM ch JOIN o ON o.source_key = ch.source_key AND o.k = ch.k + 1)"""
_CHAIN_SQL = _CHAIN_SQL.replace("ch AS (SELECT source_key, 0::BIGINT AS k", "ch AS (SELECT DISTINCT source_key, 0::BIGINT AS k").replace(f"'{merkle.GENESIS}' AS chain_hash\n", f"'{merkle.GENESIS}' AS chain_hash FROM o\n")


@query(f"WITH {_CHAIN_SQL} SELECT source_key, snapshot_id, chain_hash FROM ch WHERE k > 0")
def build_chain(spark, d):
    return merkle.build_chain(_links(spark, d))


@query(f"""WITH {_CHAIN_SQL}, s AS (SELECT * FROM ch WHERE k > 0), b AS (SELECT source_key, min(snapshot_id) AS broken_at FROM s WHERE snapshot_id % 1000 = 501 GROUP BY 1)
SELECT source_key, count(*) AS snapshots, coalesce(max(broken_at), -1) AS broken_at, max(broken_at) IS NULL AS ok FROM s LEFT JOIN b USING (source_key) GROUP BY 1""")
def verify_chain(spark, d):
    links = _links(spark, d).join(merkle.build_chain(_links(spark, d)), ["source_key", "snapshot_id"])
    bent = links.withColumn("chain_hash", F.when(F.col("snapshot_id") % 1000 == 501, F.sha2("chain_hash", 256)).otherwise(F.col("chain_hash")))
    return merkle.verify_chains(bent).select("source_key", "snapshots", F.coalesce("broken_at", F.lit(-1)).alias("broken_at"), "ok")


@query(f"WITH {O.VERSIONS_SQL} SELECT count(DISTINCT content_hash) AS checked, count(DISTINCT content_hash) FILTER (o_orderkey::BIGINT % 1000 = 9) AS failed FROM obs")
def verify_blobs(spark, d):
    obs = O.observations(spark, d).dropDuplicates(["content_hash"])
    text = R.canonical_json(F.map_from_entries(F.array_sort(F.map_entries("payload"))))
    tampered = obs.withColumn("json", F.when(F.col("payload")["o_orderkey"].cast("long") % 1000 == 9, F.replace(text, F.lit("status"), F.lit("statue"))).otherwise(text))
    return tampered.agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(R.sha256(F.col("json")) != F.col("content_hash"), 1)).alias("failed"))


@query(f"""WITH {O.SNAPSHOTS_SQL}, o AS (SELECT *, lag(merkle_root) OVER w AS before FROM snap WHERE status = 'ok' WINDOW w AS (PARTITION BY source_key ORDER BY snapshot_id))
SELECT source_key, snapshot_id, max(CASE WHEN before IS DISTINCT FROM merkle_root THEN snapshot_id END) OVER (PARTITION BY source_key ORDER BY snapshot_id) AS owner FROM o""")
def pointer_owner(spark, d):
    return A.pointer_owner(O.watched_snapshots(spark, d).where("status = 'ok'")).select("source_key", "snapshot_id", "owner")


@query(f"WITH {O.SNAPSHOTS_SQL}, r AS (SELECT *, CASE WHEN snapshot_id % 4 = 1 THEN snapshot_id - 1 END AS ref FROM snap) SELECT r.snapshot_id, r.ref AS observations_ref FROM r LEFT JOIN snap o ON o.snapshot_id = r.ref WHERE r.status = 'ok' AND r.ref IS NOT NULL AND (o.status IS NULL OR o.status <> 'ok' OR o.merkle_root <> r.merkle_root)")
def dedup_pointers(spark, d):
    s = O.watched_snapshots(spark, d).withColumn("observations_ref", F.when(F.col("snapshot_id") % 4 == 1, F.col("snapshot_id") - 1))
    return A.dangling_pointers(s).where("status = 'ok'").select("snapshot_id", "observations_ref")


@query(f"WITH {O.VERSIONS_SQL} SELECT DISTINCT content_hash FROM obs WHERE snapshot_id = 2 AND content_hash NOT IN (SELECT content_hash FROM obs WHERE snapshot_id = 1)")
def new_blobs(spark, d):
    obs = O.observations(spark, d)
    return A.new_blobs(obs.where("snapshot_id = 2"), obs.where("snapshot_id = 1")).select("content_hash")


@query(f"WITH {O.VERSIONS_SQL} SELECT DISTINCT content_hash FROM obs a WHERE NOT EXISTS (SELECT 1 FROM obs b WHERE b.snapshot_id > 1 AND b.content_hash = a.content_hash)")
def orphan_blobs(spark, d):
    obs = O.observations(spark, d)
    return A.orphan_blobs(obs.select("content_hash").distinct(), obs.where("snapshot_id > 1"))


@query(f"WITH {O.SNAPSHOTS_SQL}, p AS (SELECT source_key, snapshot_id AS from_snapshot, {_LEAD.format('snapshot_id')} AS to_snapshot FROM snap WHERE status = 'ok') SELECT * FROM p WHERE to_snapshot IS NOT NULL AND from_snapshot % 3 <> 0")
def pending_pairs(spark, d):
    p = diff.pairs(O.watched_snapshots(spark, d))
    return A.pending_pairs(p, p.where("from_snapshot % 3 = 0")).select(*diff.PAIR)


@query(f"WITH {O.SNAPSHOTS_SQL} SELECT source_key, snapshot_id, merkle_root FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY snapshot_id DESC) AS k FROM snap WHERE status = 'ok') WHERE k = 1")
def latest_snapshot(spark, d):
    return A.latest(O.watched_snapshots(spark, d).where("status = 'ok'"), ["source_key"], "snapshot_id").select("source_key", "snapshot_id", "merkle_root")


# -- publishers, discovery, confirmation ------------------------------------------------------------------------------

_CUT = dt.datetime(1998, 1, 1)


def _published(spark, d):
    k = F.col("o_orderkey")
    source = F.concat(F.lit("p"), (F.col("o_custkey") % 4).cast("string"))
    created = ((source == "p0") & (k % 10 < 7)) | ((source == "p1") & (k % 100 == 1))
    updated = ((source == "p1") & (k % 10 < 8)) | ((source == "p2") & (k % 50 == 1))
    return table(spark, d, "orders").select(source.alias("source_key"), (F.col("o_orderdate") < F.lit(_CUT)).alias("in_frozen_past"), created.alias("created_recently"), updated.alias("updated_recently"), F.col("o_orderdate"), k.cast("string").alias("row_uid"), F.col("o_totalprice").alias("updated_at"))


_PUBLISHED_SQL = """pub AS (SELECT source_key, o_orderdate < '1998-01-01' AS past, (source_key = 'p0' AND k % 10 < 7) OR (source_key = 'p1' AND k % 100 = 1) AS created, (source_key = 'p1' AND k % 10 < 8) OR (source_key = 'p2' AND k % 50 = 1) AS updated, o_orderdate
  FROM (SELECT 'p' || (o_custkey % 4) AS source_key, o_orderkey AS k, o_orderdate FROM orders))"""


@query(f"""WITH {_PUBLISHED_SQL}, c AS (SELECT source_key, count(*) FILTER (past) AS frozen_past_count, count(*) FILTER (past AND created) AS created_recent, count(*) FILTER (past AND updated) AS updated_recent FROM pub GROUP BY 1),
r AS (SELECT *, round(created_recent / frozen_past_count, 6) AS created_ratio, round(updated_recent / frozen_past_count, 6) AS updated_ratio FROM c)
SELECT *, CASE WHEN created_ratio > 0.5 THEN 'republish' WHEN updated_ratio > 0.5 THEN 'bulk_touch' WHEN updated_ratio > 0.0005 THEN 'incremental' ELSE 'static' END AS pipeline_class, NOT (created_ratio > 0.5 OR updated_ratio > 0.5) AS timestamps_informative FROM r""")
def publisher_class(spark, d):
    return publishers.publisher_class(_published(spark, d))


@query("SELECT count(DISTINCT ts) AS distinct_stamps FROM (SELECT date_trunc('hour', ts) AS ts FROM events ORDER BY 1 DESC LIMIT 1000)")
def recent_stamps(spark, d):
    return publishers.distinct_recent_stamps(table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("ts")), "ts")


@query(f"""WITH {O.WATCHED_SQL}, c AS (SELECT coalesce(pipeline_class, 'unknown') AS pipeline_class, count(*) AS n FROM src GROUP BY 1)
SELECT pipeline_class, n, (SELECT sum(n) FROM c WHERE pipeline_class <> 'unknown')::BIGINT AS characterised, (SELECT sum(n) FROM c WHERE pipeline_class IN ('incremental', 'static'))::BIGINT AS informative,
  round(1 - (SELECT sum(n) FROM c WHERE pipeline_class IN ('incremental', 'static')) / (SELECT sum(n) FROM c WHERE pipeline_class <> 'unknown'), 3) AS share_uninterpretable FROM c""")
def publishing_census(spark, d):
    return publishers.census(O.watched(spark, d))


@query(f"WITH {O.WATCHED_SQL} SELECT city, coalesce(pipeline_class, 'unknown') AS pipeline_class, count(*) AS n FROM src GROUP BY ALL")
def census_by_city(spark, d):
    return publishers.census_by_city(O.watched(spark, d))


def _asserted(spark, d):
    return _published(spark, d).select("source_key", F.col("in_frozen_past").alias("closed"), F.col("updated_recently").alias("touched"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("event_date"), "row_uid", "updated_at")


@query(f"""WITH {_PUBLISHED_SQL}, a AS (SELECT source_key, count(*) FILTER (past) AS closed_period_records, count(*) FILTER (past AND updated) AS asserted_modified, strftime(min(o_orderdate) FILTER (past AND updated), '%Y-%m-%dT%H:%M:%S') AS oldest_event_touched FROM pub GROUP BY 1)
SELECT *, round(asserted_modified / closed_period_records, 6) AS share, asserted_modified / closed_period_records > 0.2 AS near_saturated FROM a WHERE asserted_modified > 0""")
def publisher_assertions(spark, d):
    return publishers.assertions(_asserted(spark, d))


@query(f"""WITH {_PUBLISHED_SQL}, y AS (SELECT source_key, (date_diff('second', o_orderdate, TIMESTAMP '2000-01-01') // 86400) / 365.25 AS years FROM pub WHERE past AND updated)
SELECT source_key, CASE WHEN years < 2 THEN '1-2 years' WHEN years < 4 THEN '2-4 years' WHEN years < 7 THEN '4-7 years' WHEN years < 12 THEN '7-12 years' ELSE '12+ years' END AS age_bucket, count(*) AS n FROM y GROUP BY ALL""")
def retro_age_buckets(spark, d):
    return publishers.age_distribution(_asserted(spark, d).where("closed AND touched"), F.lit(NOW))


@query(f"""WITH {_PUBLISHED_SQL}, a AS (SELECT source_key, count(*) FILTER (past) AS c, count(*) FILTER (past AND updated) AS m FROM pub GROUP BY 1)
SELECT count(*) AS sources, sum(m)::BIGINT AS asserted_modified, sum(c)::BIGINT AS closed_period_records FROM a WHERE m > 0 AND source_key IN ('p1', 'p2')""")
def assertion_totals(spark, d):
    sources = spark.createDataFrame([("p0", "republish"), ("p1", "incremental"), ("p2", "static"), ("p3", "static")], "source_key string, pipeline_class string")
    return publishers.assertion_totals(publishers.assertions(_asserted(spark, d)), sources)


@query(f"""WITH {_PUBLISHED_SQL} SELECT source_key, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS oldest_event_touched FROM pub WHERE past AND updated GROUP BY 1 ORDER BY 2, 1 LIMIT 1""")
def deepest_reach(spark, d):
    return publishers.deepest_reach(publishers.assertions(_asserted(spark, d)), 1).select("source_key", "oldest_event_touched")


@query("""SELECT source_key, row_uid, rank FROM (SELECT 'p' || (o_custkey % 4) AS source_key, o_orderkey::VARCHAR AS row_uid, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_totalprice DESC, o_orderkey::VARCHAR) AS rank FROM orders
WHERE o_orderdate < '1998-01-01' AND ((o_custkey % 4 = 1 AND o_orderkey % 10 < 8) OR (o_custkey % 4 = 2 AND o_orderkey % 50 = 1))) WHERE rank <= 40""")
def latest_touched(spark, d):
    return publishers.latest_touched(_asserted(spark, d)).select("source_key", "row_uid", "rank")


@query("SELECT 'p' || (o_custkey % 3) AS source_key, count(*) AS frozen_past_count, count(*) FILTER (o_totalprice > 200000) AS created_recent, count(*) FILTER (o_totalprice > 350000) AS updated_recent FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1")
def characterised_counts(spark, d):
    rows = table(spark, d, "orders").select("o_orderdate", F.col("o_custkey"), F.date_add(F.lit("2000-01-01").cast("date"), F.when(F.col("o_totalprice") > 200000, 1).otherwise(-1)).alias(":created_at"), F.date_add(F.lit("2000-01-01").cast("date"), F.when(F.col("o_totalprice") > 350000, 1).otherwise(-1)).alias(":updated_at"))
    parts = [publishers.publishing_rows(rows.where(F.col("o_custkey") % 3 == k), f"p{k}", "o_orderdate", "1998-01-01", "2000-01-01") for k in range(3)]
    return publishers.publisher_class(functools.reduce(DataFrame.unionByName, parts)).select("source_key", "frozen_past_count", "created_recent", "updated_recent")


@query("SELECT r_name AS city, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def accepted_by_city(spark, d):
    return discovery.accepted_by_city(O.watched(spark, d))


@query("""SELECT domain, dataset, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY weight DESC, dataset) AS rank FROM (SELECT 'd' || (p_partkey % 5) AS domain, p_partkey::VARCHAR AS dataset,
CASE p_partkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 70 END AS weight FROM part WHERE p_partkey % 3 < 2)) WHERE rank <= 20""")
def catalog_candidates(spark, d):
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, "Police stops").when(k % 3 == 1, "Lead in Water").otherwise("Trees")
    catalog = table(spark, d, "part").select(F.concat(F.lit("d"), (k % 5).cast("string")).alias("domain"), k.cast("string").alias("dataset"), title.alias("title"), F.lit(None).cast("string").alias("category"), F.lit("").alias("description"))
    return discovery.candidates(catalog, 20).select("domain", "dataset", "weight", "rank")


@query("SELECT CASE o_orderkey % 3 WHEN 0 THEN 'confirmed_absent' WHEN 1 THEN 'still_present' ELSE 'unverifiable' END AS verdict, count(*) AS n FROM orders GROUP BY 1")
def verdict_tally(spark, d):
    k = F.col("o_orderkey") % 3
    return C.verdict_tally(table(spark, d, "orders").select(F.when(k == 0, "confirmed_absent").when(k == 1, "still_present").otherwise("unverifiable").alias("verdict")))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'name=' || n_name ELSE 'name=' || n_name || ',note=x' END AS record FROM nation")
def sample_projection(spark, d):
    k = F.col("n_nationkey")
    record = F.create_map(F.lit(":id"), k.cast("string"), F.lit("blank"), F.lit(""), F.lit("name"), F.col("n_name"), F.lit("none"), F.lit(None).cast("string"), F.lit("note"), F.when(k % 2 == 1, "x"))
    return table(spark, d, "nation").select(k.alias("k"), F.array_join(F.transform(F.map_entries(R.published(record)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("record"))


@query("SELECT n_name AS title, greatest(CASE WHEN regexp_matches(lower(n_name), 'arrest|crime|police|stop') THEN 100 ELSE 0 END, CASE WHEN regexp_matches(lower(n_name), 'food|health|lead|restaurant|water|environment|air.quality') THEN 70 ELSE 0 END) AS weight FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'Police stops' WHEN n_nationkey % 3 = 1 THEN 'Lead in Water' ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 3 < 2)")
def civic_weights(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").where(k % 3 < 2).select(F.when(k % 3 == 0, "Police stops").otherwise("Lead in Water").alias("title"))
    return n.select("title", discovery.civic_weight(F.col("title"), F.lit(None).cast("string"), F.lit("")).alias("weight"))


@query("""SELECT 'case_id' AS field, 100 AS hint, count(*) AS n, count(o_orderkey) AS present, count(DISTINCT o_orderkey) AS distinct FROM orders
UNION ALL SELECT 'permit_no', 100, count(*), count(o_custkey), count(DISTINCT o_custkey) FROM orders""")
def pick_business_key(spark, d):
    return discovery.key_profile(table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("permit_no"), "o_totalprice"))


@query("SELECT 'order_status' AS field, count(DISTINCT o_orderstatus) AS distinct FROM orders UNION ALL SELECT 'order_type', count(DISTINCT o_orderpriority) FROM orders")
def pick_dimensions(spark, d):
    return discovery.dimension_profile(table(spark, d, "orders").select(F.col("o_orderstatus").alias("order_status"), F.col("o_orderpriority").alias("order_type"), F.col("o_orderkey").cast("string").alias("ward")))


@query("""SELECT k AS place, s AS span_days, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-11-07' AND o_orderdate < TIMESTAMP '1998-11-07' + to_days(s::INTEGER)) AS n
FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([31, 92, 183, 365, 7]) AS s)""")
def choose_stratum(spark, d):
    return discovery.stratum_counts(table(spark, d, "orders"), "o_orderdate", NOW)


@query(f"""WITH {O.WATCHED_SQL}, {O.SNAPSHOTS_SQL}, l AS (SELECT source_key, arg_max(row_count, snapshot_id) AS seen FROM snap WHERE status = 'ok' GROUP BY 1)
SELECT source_key, title, city, coalesce(seen, n_nationkey * 10)::BIGINT AS stratum_rows FROM src LEFT JOIN l USING (source_key) WHERE coalesce(seen, n_nationkey * 10) < 120""")
def curate_plan(spark, d):
    return discovery.curate_plan(O.watched(spark, d), O.watched_snapshots(spark, d))


@query(f"""WITH {O.changes_sql()}, {O.WATCHED_SQL}, {O.SNAPSHOTS_SQL}, kept AS (SELECT * FROM snap WHERE source_key NOT IN ('n1', 'n2'))
SELECT 'changes' AS "table", count(*) AS n FROM chg WHERE source_key NOT IN ('n1', 'n2') UNION ALL SELECT 'sources', count(*) FROM src WHERE source_key NOT IN ('n1', 'n2')
UNION ALL SELECT unnest(['snapshots', 'observations', 'diff_runs']), (SELECT count(*) FROM kept) UNION ALL SELECT 'blobs', count(DISTINCT merkle_root) FROM kept""")
def prune_cascade(spark, d):
    doomed = spark.createDataFrame([("n1",), ("n2",)], "source_key string")
    s = O.watched_snapshots(spark, d)
    obs = s.select("snapshot_id", F.col("merkle_root").alias("content_hash"))
    tables = {"sources": O.watched(spark, d), "snapshots": s, "observations": obs, "changes": O.recorded_changes(spark, d), "diff_runs": s.select(F.col("snapshot_id").alias("to_snapshot")), "blobs": obs.select("content_hash").distinct()}
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, t in A.prune(tables, doomed).items()]
    return functools.reduce(DataFrame.unionByName, counts)


@query("""WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 1 THEN '"' || o_orderkey ELSE o_orderkey::VARCHAR END AS row_uid FROM orders WHERE o_orderkey % 20 < 6)
SELECT row_uid, CASE WHEN k % 3 = 1 AND k % 20 < 5 THEN 'key_reformatted' WHEN k % 3 <> 1 AND k % 20 < 5 THEN 'still_present' ELSE 'confirmed_absent' END AS verdict, CASE WHEN k % 20 < 5 THEN k::VARCHAR END AS found_as,
  CASE WHEN k % 20 < 5 THEN (o_orderdate < '1998-01-01')::VARCHAR ELSE 'unknown' END AS inside_window FROM c JOIN orders ON o_orderkey = k""")
def confirm_deletions(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    claims = o.where(k % 20 < 6).select(F.lit("o").alias("source_key"), F.concat(F.when(k % 3 == 1, '"').otherwise(""), k.cast("string")).alias("row_uid"))
    there = o.where(k % 20 < 5).select(F.lit("o").alias("source_key"), k.cast("string").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_value"))
    src = spark.createDataFrame([("o", ["k"], "1990-01-01", "1998-01-01")], "source_key string, business_key array<string>, stratum_start string, stratum_end string")
    return C.confirm(claims, there, src).select("row_uid", "verdict", "found_as", F.coalesce(F.col("inside_window").cast("string"), F.lit("unknown")).alias("inside_window"))


@query(f"WITH {O.changes_sql()} SELECT DISTINCT source_key, row_uid FROM chg WHERE kind = 'deletion' AND source_key NOT IN ('n0', 'n5')")
def unconfirmed_claims(spark, d):
    c = O.recorded_changes(spark, d)
    return C.claims(c, c.where("source_key IN ('n0', 'n5')"))


# -- report -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {O.changes_sql()} SELECT change_id, kind, significance FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY significance DESC, change_id DESC) AS k FROM chg) WHERE k <= 30 ORDER BY significance DESC, change_id DESC LIMIT 420""")
def findings_top_per_kind(spark, d):
    return report.top_per_kind(O.recorded_changes(spark, d)).select("change_id", "kind", "significance")


@query(f"""WITH {O.changes_sql()}, {O.WATCHED_SQL}, {O.SNAPSHOTS_SQL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY significance DESC, change_id DESC) AS k FROM chg) WHERE k <= 30 ORDER BY significance DESC, change_id DESC LIMIT 420)
SELECT change_id, title, a.captured_at AS observed_before, b.merkle_root AS root_after, 'https://data.example.org/d/' || lpad(n_nationkey::VARCHAR, 4, '0') || '-aaaa' AS portal_url,
CASE WHEN change_id % 50 < 40 THEN 'v' || change_id % 50 ELSE 'none' END AS record_before, CASE WHEN change_id % 45 < 40 THEN 'v' || change_id % 45 ELSE 'none' END AS record_after FROM t JOIN src USING (source_key) LEFT JOIN snap a ON a.snapshot_id = from_snapshot LEFT JOIN snap b ON b.snapshot_id = to_snapshot""")
def findings(spark, d):
    named = lambda c: F.concat(F.lit("h"), c.cast("string"))
    blobs = spark.range(40).select(named(F.col("id")).alias("content_hash"), F.create_map(F.lit("x"), F.concat(F.lit("v"), F.col("id").cast("string"))).alias("payload"))
    changes = O.recorded_changes(spark, d).withColumn("before_hash", named(F.col("change_id") % 50)).withColumn("after_hash", named(F.col("change_id") % 45))
    text = lambda c: F.coalesce(F.col(c)["x"], F.lit("none")).alias(c)
    return report.findings(changes, O.watched(spark, d), O.watched_snapshots(spark, d), blobs).select("change_id", "title", "observed_before", "root_after", "portal_url", text("record_before"), text("record_after"))


@query(f"""WITH {O.changes_sql()} SELECT count(*) AS total_changes, count(*) FILTER (kind = 'deletion') AS deletions, count(*) FILTER (kind = 'semantic_revision') AS isolated_revisions,
count(*) FILTER (kind IN ('provenance_churn', 'identity_churn', 'withdrawn_unstable_key', 'ordering_change', 'transient_absence')) AS discarded_as_mechanism, count(*) FILTER (kind IN ('semantic_revision', 'coordinated_revision', 'deletion')) AS rewriting_of_stated_facts,
round(1 - count(*) FILTER (kind IN ('semantic_revision', 'coordinated_revision', 'deletion')) / 1000000, 4) AS share_mechanism FROM chg""")
def churn_summary(spark, d):
    return report.churn_summary(O.recorded_changes(spark, d), 1_000_000).select("total_changes", "deletions", "isolated_revisions", "discarded_as_mechanism", "rewriting_of_stated_facts", "share_mechanism")


@query(f"WITH {O.changes_sql()} SELECT kind, count(*) AS n, max(significance) AS most FROM chg GROUP BY 1")
def changes_by_kind(spark, d):
    return report.by_kind(O.recorded_changes(spark, d))


@query(f"""WITH {O.WATCHED_SQL}, {O.SNAPSHOTS_SQL} SELECT (SELECT count(*) FROM src) AS sources_watched, (SELECT count(DISTINCT city) FROM src) AS city_count, count(*) FILTER (status = 'ok') AS snapshots_ok, count(*) FILTER (status = 'error') AS snapshots_failed,
(SELECT max(n) FROM (SELECT count(*) FILTER (status = 'ok') AS n FROM snap GROUP BY source_key)) AS sweeps, min(captured_at) FILTER (status = 'ok') AS first_observation, max(captured_at) FILTER (status = 'ok') AS last_observation FROM snap""")
def overview(spark, d):
    return report.overview(O.watched(spark, d), O.watched_snapshots(spark, d))


@query(f"""WITH {O.WATCHED_SQL}, {O.SNAPSHOTS_SQL}, p AS (SELECT source_key, count(*) FILTER (status = 'ok') AS snapshots, count(*) FILTER (status = 'error') AS failures, max(captured_at) FILTER (status = 'ok') AS last_seen,
  count(DISTINCT merkle_root) FILTER (status = 'ok') AS distinct_states, arg_max(identity_mode, snapshot_id) FILTER (status = 'ok') AS im, arg_max(frozen_past_count, snapshot_id) FILTER (status = 'ok') AS frozen_past_count FROM snap GROUP BY 1)
SELECT source_key, coalesce(snapshots, 0) AS snapshots, coalesce(failures, 0) AS failures, last_seen, coalesce(distinct_states, 0) AS distinct_states, coalesce(im, 'business_key') AS identity_mode, coalesce(im, 'business_key') = 'business_key' AS can_attribute_revision, coalesce(frozen_past_count, -1) AS frozen_past_count FROM src LEFT JOIN p USING (source_key)""")
def sources_table(spark, d):
    return report.sources_table(O.watched(spark, d), O.watched_snapshots(spark, d)).select("source_key", "snapshots", "failures", "last_seen", "distinct_states", "identity_mode", "can_attribute_revision", F.coalesce("frozen_past_count", F.lit(-1)).alias("frozen_past_count"))


@query(f"""WITH {O.VERSIONS_SQL} SELECT 'chains' AS "check", 1::BIGINT AS checked, 0::BIGINT AS failed, true AS ok UNION ALL SELECT 'merkle_roots', count(DISTINCT snapshot_id), 0, true FROM obs
UNION ALL SELECT 'blobs', count(DISTINCT content_hash), 0, true FROM obs UNION ALL SELECT 'inclusion_proofs', least(3, count(*)), 0, true FROM (SELECT snapshot_id FROM obs GROUP BY 1 HAVING count(*) > 4) UNION ALL SELECT 'dedup_pointers', 0, 0, true""")
def verify_archive(spark, d):
    obs = O.observations(spark, d)
    o = obs.select("snapshot_id", "row_uid", "content_hash")
    roots = merkle.merkle_roots(merkle.ranked_leaves(o)).join(o.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("row_count")), "snapshot_id")
    rows = O.snapshots(spark).join(roots, "snapshot_id").withColumn("meta_json", F.lit("{}")).withColumn("observations_ref", F.lit(None).cast("long"))
    rows = rows.join(merkle.build_chain(rows), ["source_key", "snapshot_id"])
    blobs = obs.select("content_hash", R.canonical_json(F.map_from_entries(F.array_sort(F.map_entries("payload")))).alias("payload_json"))
    return report.verify(rows, o, blobs)
