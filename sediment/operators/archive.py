"""The archive: content-addressed, rooted and chained observations as Parquet tables.

Tables under one folder: ``sources``, ``snapshots``, ``tallies``, ``observations`` by snapshot, ``blobs`` by the first two
digits of their hash, ``changes``, ``diff_runs``, ``verdicts``, and what an analysis learned. Facts are appended; what the
reference semantics update in place is a derived view here, and derived tables are made anew. Appends are keyed, so a
repeated commit of the same observation adds nothing.

A commit reads its source once: root, blobs and records all come from the fingerprints that were written then. It reads
of the archive its own snapshot's records, the hashes of the observation before, and, for what that one lacks, the hashes
of blobs with the same first digits.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.records import fingerprint, roles, sha256
from ..sources.shared import discard, written
from .merkle import EMPTY_ROOT, GENESIS, chain_hash, merkle_roots, ranked

SCHEMAS = {
    "sources": "source_key string, domain string, dataset string, title string, city string, category string, date_field string, business_key array<string>, stratum_start string, stratum_end string, extra_volatile array<string>, agg_dimensions array<string>, pipeline_class string, notes string, added_at string",
    "snapshots": "snapshot_id long, source_key string, captured_at string, status string, row_count long, merkle_root string, chain_hash string, schema_hash string, columns array<string>, volatile_digest string, frozen_past_count long, stratum_count long, identity_mode string, key_collisions long, meta_json string, error string, observations_ref long",
    "observations": "snapshot_id long, row_uid string, content_hash string, volatile_hash string",
    "blobs": "content_hash string, payload map<string,string>, prefix string",
    "tallies": "snapshot_id long, source_key string, dim string, category string, n long",
    "changes": "change_id long, source_key string, from_snapshot long, to_snapshot long, kind string, row_uid string, before_hash string, after_hash string, field_deltas map<string,struct<before:string,after:string>>, significance double, detail string",
    "diff_runs": "from_snapshot long, to_snapshot long, change_count long",
    "field_volatility": "source_key string, field string, pairs_seen long, mean_share double, verdict string",
    "source_stability": "source_key string, pairs_seen long, mean_revised double, verdict string, reason string",
    "field_dependency": "source_key string, field string, driver string, observations long, conditional double",
    "analysis_stages": "stage string, change_count long",
    "verdicts": "source_key string, row_uid string, verdict string, found_as string, reason string",
}
PARTITIONS = {"observations": ["snapshot_id"], "blobs": ["prefix"]}


class Archive:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        """A table's rows; none before its first write. Columns added since an older write are null there."""
        at = os.path.join(self.path, name)
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(at)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(at)

    def append(self, name: str, rows: DataFrame, mode: str = "append") -> None:
        kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
        have = set(rows.columns)
        cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields]
        rows.select(*cols).write.mode(mode).option("compression", "zstd").parquet(os.path.join(self.path, name), partitionBy=PARTITIONS.get(name))

    def clear(self, *names: str) -> None:
        for name in names:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, name))
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def sources(self) -> DataFrame:
        return latest(self.table("sources"), ["source_key"], "added_at")

    def commit(self, source_key: str, snapshot_id: int, captured_at: str, rows: DataFrame, key: list[str], extra_volatile: tuple[str, ...] = (), arrival: str | None = None, frozen_past_count: int | None = None, stratum_count: int | None = None, tallies: DataFrame | None = None, least_rows: int = 0) -> dict:
        """Commit one observation of a source; a repeated ``snapshot_id`` changes nothing.

        ``tallies`` has dim, category and n. Fewer rows than ``least_rows`` are an error.
        """
        snapshots = self.table("snapshots")
        done = snapshots.where((F.col("snapshot_id") == snapshot_id) & (F.col("status") == "ok")).first()
        if done:
            return {"snapshot_id": snapshot_id, "merkle_root": done["merkle_root"], "chain_hash": done["chain_hash"], "row_count": done["row_count"], "deduplicated": done["observations_ref"] is not None}
        columns = sorted(c for c in rows.columns if c != arrival)
        # a source may answer each reading anew, so it is read once
        prints = written(fingerprint(rows, key, extra_volatile, keep=[arrival] if arrival else []), "prints")
        total, distinct = prints.agg(F.count(F.lit(1)), F.countDistinct("row_uid")).first()
        if total < least_rows:
            raise ValueError(f"{total} rows in the window")
        mode = "business_key"
        own = prints
        if total > distinct:
            own, mode = prints.withColumn("row_uid", F.concat(F.lit("sha256:"), "content_hash")), "content"
        # where every identity stands once there is nothing to choose from
        one = written(first_arrival(own, arrival), "one-of-each") if total > distinct else own.select("row_uid", F.col("content").alias("payload"), "content_hash", "volatile_hash")
        root, n, digest = roots(one)
        schema_hash = self.spark.range(1).select(sha256(F.to_json(F.array(*[F.lit(c) for c in columns])))).first()[0]
        before = snapshots.where((F.col("source_key") == source_key) & (F.col("status") == "ok")).orderBy(F.desc("snapshot_id")).first()
        owner = (before["observations_ref"] or before["snapshot_id"]) if before else None
        ref = owner if before and before["merkle_root"] == root else None
        meta = F.to_json(F.struct(F.lit(captured_at).alias("captured_at"), F.lit(digest).alias("volatile_digest"), F.lit(n).alias("row_count"), F.lit(schema_hash).alias("schema_hash"), F.lit(source_key).alias("source_key")))
        row = self.spark.range(1).select(
            F.lit(snapshot_id).alias("snapshot_id"), F.lit(source_key).alias("source_key"), F.lit(captured_at).alias("captured_at"), F.lit("ok").alias("status"), F.lit(n).alias("row_count"), F.lit(root).alias("merkle_root"),
            chain_hash(F.lit(before["chain_hash"] if before else GENESIS), F.lit(root), meta).alias("chain_hash"), F.lit(schema_hash).alias("schema_hash"), F.array(*[F.lit(c) for c in columns]).alias("columns"), F.lit(digest).alias("volatile_digest"),
            F.lit(frozen_past_count).alias("frozen_past_count"), F.lit(stratum_count).alias("stratum_count"), F.lit(mode).alias("identity_mode"), F.lit(total - distinct).alias("key_collisions"), meta.alias("meta_json"), F.lit(ref).alias("observations_ref"),
        )
        if ref is None:
            self._append_blobs(one, owner)
            stored = self.table("observations").where(F.col("snapshot_id") == snapshot_id)
            records = one.select("row_uid", "content_hash", "volatile_hash", F.lit(snapshot_id).alias("snapshot_id"))
            # there are some only if an attempt ended before its snapshot's row
            self.append("observations", records.join(stored, "row_uid", "left_anti") if stored.limit(1).count() else records)
        if tallies is not None and not self.table("tallies").where(F.col("snapshot_id") == snapshot_id).limit(1).count():
            self.append("tallies", tallies.withColumn("snapshot_id", F.lit(snapshot_id)).withColumn("source_key", F.lit(source_key)))
        link = row.first()["chain_hash"]
        self.append("snapshots", row)  # last: an observation exists once its snapshot row does
        discard(prints, *([one] if total > distinct else []))
        return {"snapshot_id": snapshot_id, "merkle_root": root, "chain_hash": link, "row_count": n, "deduplicated": ref is not None}

    def _append_blobs(self, one: DataFrame, owner: int | None) -> None:
        """Append the payloads that the archive lacks. Most of an observation is in the one before, whose hashes are few
        to read; of the blobs, only those partitions are read that the rest could be in."""
        fresh = one.select("content_hash", "payload", F.substring("content_hash", 1, 2).alias("prefix"))
        if owner is not None:
            fresh = written(without_hashes(fresh, self.table("observations").where(F.col("snapshot_id") == owner)), "fresh")
        prefixes = [r[0] for r in fresh.select("prefix").distinct().collect()]  # 256 at most
        known = self.table("blobs").where(F.col("prefix").isin(*prefixes)) if prefixes else self.table("blobs").limit(0)
        self.append("blobs", new_blobs(fresh, known).withColumn("prefix", F.substring("content_hash", 1, 2)))
        if owner is not None:
            discard(fresh)

    def fail(self, source_key: str, snapshot_id: int, captured_at: str, error: str) -> None:
        """An attempt that failed is on record too."""
        self.append("snapshots", self.spark.range(1).select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(source_key).alias("source_key"), F.lit(captured_at).alias("captured_at"), F.lit("error").alias("status"), F.lit(error[:2000]).alias("error")))

    def stats(self) -> dict[str, int]:
        by = {r["status"]: r["n"] for r in self.table("snapshots").groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {"sources": self.sources().count(), "snapshots_ok": by.get("ok", 0), "snapshots_error": by.get("error", 0)} | {t: self.table(t).count() for t in ("observations", "blobs", "changes")}


def latest(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(by))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_arrival(prints: DataFrame, arrival: str | None = None, content: Column | None = None) -> DataFrame:
    """One row of each identity: the first to arrive, or the one with the least hash where arrival isn't known.

    ``content`` is the part of the content that is wanted, all by default: what isn't wanted isn't shuffled. Identities are
    brought together before rows are compared, as the few copies of one are seldom in one task, and to sort rows on both
    sides of the shuffle for them costs more. Hashes go as bytes, whose order is that of their text.
    """
    text = lambda h: F.lower(F.hex(h))
    rows = prints.select("row_uid", *([F.col(arrival).alias("arrival")] if arrival else []), F.unhex("content_hash").alias("content_hash"), F.unhex("volatile_hash").alias("volatile_hash"), (F.col("content") if content is None else content).alias("payload"))
    best = F.struct(*(["arrival"] if arrival else []), "content_hash", "volatile_hash")
    one = rows.repartition("row_uid").groupBy("row_uid").agg(F.min_by(F.struct("payload", "content_hash", "volatile_hash"), best).alias("r"))
    return one.select("row_uid", F.col("r.payload").alias("payload"), text(F.col("r.content_hash")).alias("content_hash"), text(F.col("r.volatile_hash")).alias("volatile_hash"))


def roots(one: DataFrame) -> tuple[str, int, str]:
    """Content root, number of records, and a digest of all write bookkeeping: the root over its hashes."""
    leaves = ranked(one.withColumn("snapshot_id", F.lit(0)), leaves={"content": "content_hash", "bookkeeping": "volatile_hash"}, keep_uid=False, digests=True)
    found = merkle_roots(leaves, columns=("content", "bookkeeping")).first()
    return (found["content"], leaves.count(), found["bookkeeping"]) if found else (EMPTY_ROOT, 0, EMPTY_ROOT)


def without_hashes(blobs: DataFrame, known: DataFrame, once: bool = False) -> DataFrame:
    """The blobs whose ``content_hash`` isn't known, each ``once`` if so asked.

    Hashes are 64 digits and are joined as 32 bytes; both steps take one shuffle of the payloads, before rows are sorted.
    """
    digest = F.unhex("content_hash").alias("content_hash")
    rest = blobs.select(digest, *[c for c in blobs.columns if c != "content_hash"])
    if once:
        rest = rest.repartition("content_hash").dropDuplicates(["content_hash"])
    return rest.join(known.select(digest), "content_hash", "left_anti").withColumn("content_hash", F.lower(F.hex("content_hash")))


def new_blobs(one: DataFrame, blobs: DataFrame) -> DataFrame:
    """Payloads that the archive doesn't have yet, each once."""
    return without_hashes(one.select("content_hash", "payload"), blobs, once=True)


def pointer_owner(snapshots: DataFrame) -> DataFrame:
    """Each snapshot's owner of rows: the first of the run of equal roots that it stands in."""
    w = Window.partitionBy("source_key").orderBy("snapshot_id")
    changed = ~F.col("merkle_root").eqNullSafe(F.lag("merkle_root").over(w)) | F.lag("snapshot_id").over(w).isNull()
    return snapshots.withColumn("_new", F.when(changed, F.col("snapshot_id"))).withColumn("owner", F.last("_new", ignorenulls=True).over(w)).drop("_new")


def pending_pairs(pairs: DataFrame, diff_runs: DataFrame) -> DataFrame:
    return pairs.join(diff_runs.select("from_snapshot", "to_snapshot"), ["from_snapshot", "to_snapshot"], "left_anti")


def orphan_blobs(blobs: DataFrame, observations: DataFrame) -> DataFrame:
    return blobs.join(observations.select("content_hash"), "content_hash", "left_anti")


def dangling_pointers(snapshots: DataFrame) -> DataFrame:
    """Snapshots that point to one that isn't there, or isn't good, or has another root."""
    owner = snapshots.select(F.col("snapshot_id").alias("observations_ref"), F.col("status").alias("owner_status"), F.col("merkle_root").alias("owner_root"))
    return snapshots.where("observations_ref IS NOT NULL").join(owner, "observations_ref", "left").where("owner_status IS NULL OR owner_status <> 'ok' OR owner_root <> merkle_root")


def prune(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """The tables without the doomed sources and without payloads that nothing refers to any more."""
    by_source = lambda t: t.join(doomed.select("source_key"), "source_key", "left_anti")
    snapshots = by_source(tables["snapshots"])
    ids = snapshots.select("snapshot_id")
    observations = tables["observations"].join(ids, "snapshot_id", "left_semi")
    runs = tables["diff_runs"].join(ids.withColumnRenamed("snapshot_id", "to_snapshot"), "to_snapshot", "left_semi")
    return {"sources": by_source(tables["sources"]), "snapshots": snapshots, "observations": observations, "changes": by_source(tables["changes"]), "diff_runs": runs, "blobs": tables["blobs"].join(observations.select("content_hash"), "content_hash", "left_semi")}


__all__ = ["SCHEMAS", "Archive", "dangling_pointers", "first_arrival", "latest", "new_blobs", "orphan_blobs", "pending_pairs", "pointer_owner", "prune", "roles", "roots"]
