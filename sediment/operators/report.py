"""Evidence tables: findings, churn, overview, sources, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import join_few
from .archive import dangling_pointers
from .diff import KINDS
from .merkle import merkle_proofs, merkle_roots, proof_leads_to, ranked, verify_chains

PER_KIND = 30
LIMIT = 420
MECHANISM = ("provenance_churn", "identity_churn", "withdrawn_unstable_key", "ordering_change", "transient_absence")
REWRITING = ("semantic_revision", "coordinated_revision", "deletion")


def top_per_kind(changes: DataFrame, per_kind: int = PER_KIND, limit: int = LIMIT) -> DataFrame:
    """The weightiest changes of each kind, then of all, so that no kind crowds out the others."""
    w = Window.partitionBy("kind").orderBy(F.desc("significance"), F.desc("change_id"))
    ranked = changes.withColumn("rank_in_kind", F.row_number().over(w)).where(F.col("rank_in_kind") <= per_kind)
    return ranked.orderBy(F.desc("significance"), F.desc("change_id")).limit(limit)


def findings(changes: DataFrame, sources: DataFrame, snapshots: DataFrame, blobs: DataFrame, per_kind: int = PER_KIND, limit: int = LIMIT) -> DataFrame:
    """The top changes with their source, both observations and both whole records."""
    top = top_per_kind(changes.where(F.col("kind").isin(*KINDS["material"], *KINDS["artifact"])).join(sources.select("source_key"), "source_key", "left_semi"), per_kind, limit)
    s = sources.select("source_key", "title", "city", "pipeline_class", F.concat(F.lit("https://"), "domain", F.lit("/d/"), "dataset").alias("portal_url"), F.concat(F.lit("https://"), "domain", F.lit("/resource/"), "dataset", F.lit(".json")).alias("source_url"))
    at = lambda side, name: snapshots.select(F.col("snapshot_id").alias(f"{side}_snapshot"), F.col("captured_at").alias(f"observed_{name}"), F.col("merkle_root").alias(f"root_{name}"))
    record = lambda name: blobs.select(F.col("content_hash").alias(f"{name}_hash"), F.col("payload").alias(f"record_{name}"))
    out = top.join(s, "source_key").join(at("from", "before"), "from_snapshot", "left").join(at("to", "after"), "to_snapshot", "left")
    return out.join(record("before"), "before_hash", "left").join(record("after"), "after_hash", "left").drop("rank_in_kind")


def churn_summary(changes: DataFrame, probe: int | None = None) -> DataFrame:
    """All conditional counts in one pass, and the share of a blind pass that was mechanism."""
    n = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    out = changes.agg(
        F.count(F.lit(1)).alias("total_changes"), n("provenance_churn").alias("provenance_churn"), n("identity_churn").alias("identity_churn"), n("withdrawn_unstable_key").alias("withdrawn_unstable_key"), n("ordering_change").alias("ordering_changes"),
        n("transient_absence").alias("transient_absence"), n("lifecycle_progression").alias("lifecycle_progression"), n("coordinated_revision").alias("coordinated_revisions"), n("semantic_revision").alias("isolated_revisions"), n("deletion").alias("deletions"),
        n(*KINDS["material"]).alias("material_changes"), n(*MECHANISM).alias("discarded_as_mechanism"), n(*REWRITING).alias("rewriting_of_stated_facts"),
    )
    p = F.lit(probe).cast("long")
    return out.withColumn("apparent_changes", p).withColumn("dissolved", p - F.col("total_changes")).withColumn("share_mechanism", F.when(p > 0, F.round(1 - F.col("rewriting_of_stated_facts") / p, 4)))


def by_kind(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("significance").alias("most"))


def overview(sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Sources, cities, observations and sweeps: the most good observations of any source."""
    ok = F.col("status") == "ok"
    per = snapshots.groupBy("source_key").agg(F.count(F.when(ok, 1)).alias("ok"), F.count(F.when(F.col("status") == "error", 1)).alias("failed"), F.min(F.when(ok, F.col("captured_at"))).alias("first"), F.max(F.when(ok, F.col("captured_at"))).alias("last"))
    a = per.agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("snapshots_ok"), F.coalesce(F.sum("failed"), F.lit(0)).alias("snapshots_failed"), F.coalesce(F.max("ok"), F.lit(0)).alias("sweeps"), F.min("first").alias("first_observation"), F.max("last").alias("last_observation"))
    b = sources.agg(F.count(F.lit(1)).alias("sources_watched"), F.countDistinct("city").alias("city_count"))
    return a.crossJoin(b)  # one row each


def sources_table(sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each source with what its observations add up to; one grouping in place of a subquery for each figure."""
    ok = F.col("status") == "ok"
    per = snapshots.groupBy("source_key").agg(
        F.count(F.when(ok, 1)).alias("snapshots"), F.count(F.when(F.col("status") == "error", 1)).alias("failures"), F.max(F.when(ok, F.col("captured_at"))).alias("last_seen"), F.countDistinct(F.when(ok, F.col("merkle_root"))).alias("distinct_states"),
        F.max_by(F.when(ok, F.struct("identity_mode", "key_collisions", "frozen_past_count")), F.when(ok, F.col("snapshot_id"))).alias("last"),
    )
    out = sources.join(per, "source_key", "left").fillna(0, ["snapshots", "failures", "distinct_states"])
    mode = F.coalesce(F.col("last.identity_mode"), F.lit("business_key"))
    return out.select(*sources.columns, "snapshots", "failures", "last_seen", "distinct_states", mode.alias("identity_mode"), F.coalesce(F.col("last.key_collisions"), F.lit(0)).alias("key_collisions"), (mode == "business_key").alias("can_attribute_revision"), F.col("last.frozen_past_count").alias("frozen_past_count"))


def owned(snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """The records of every good snapshot, those of a pointer from their owner."""
    ok = snapshots.where("status = 'ok'").select("snapshot_id", F.coalesce("observations_ref", "snapshot_id").alias("owner"))
    return join_few(observations.withColumnRenamed("snapshot_id", "owner"), ok, "owner", "row_uid").drop("owner")


def inclusion_proofs(snapshots: DataFrame, observations: DataFrame, count: int = 3, leaves: DataFrame | None = None) -> DataFrame:
    """Worked proofs of the middle record of the largest snapshots, and whether one with another leaf fails as it must.

    ``leaves`` are all snapshots' ranked leaves, where there are some already.
    """
    big = snapshots.where("status = 'ok' AND row_count > 4").orderBy(F.desc("row_count"), "snapshot_id").limit(count).select("snapshot_id", "merkle_root", "row_count")
    if leaves is None:
        leaves = ranked(owned(snapshots.join(big.select("snapshot_id"), "snapshot_id", "left_semi"), observations), keep_uid=False)
    else:
        leaves = leaves.join(F.broadcast(big.select("snapshot_id")), "snapshot_id", "left_semi")  # ``count`` rows
    middle = big.select("snapshot_id", F.floor(F.col("row_count") / 2).cast("long").alias("pos"))
    proofs = merkle_proofs(leaves, middle).withColumnRenamed("merkle_root", "recomputed_root").join(big, "snapshot_id")
    good = proof_leads_to(F.col("leaf"), F.col("proof"), F.col("merkle_root"))
    forged = proof_leads_to(F.sha2(F.col("leaf"), 256), F.col("proof"), F.col("merkle_root"))
    return proofs.select("snapshot_id", "leaf_index", F.col("row_count").alias("leaf_count"), "leaf", "proof", "merkle_root", good.alias("valid"), (~forged).alias("forgery_rejected"))


def verify(snapshots: DataFrame, observations: DataFrame, blobs_json: DataFrame) -> DataFrame:
    """One row for each check: what was checked, and how much of it failed.

    ``blobs_json`` is content_hash and the canonical JSON that it should be the hash of; all of it is hashed again. A blob
    that is there more than once counts once, and fails if any copy does.
    """
    ok = snapshots.where("status = 'ok'")
    row = lambda df, name: df.agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(~F.col("fine"), 1)).alias("failed")).select(F.lit(name).alias("check"), "checked", "failed", (F.col("failed") == 0).alias("ok"))
    leaves = ranked(owned(snapshots, observations), keep_uid=False)
    again = merkle_roots(leaves).withColumnRenamed("merkle_root", "again")
    roots = ok.join(again, "snapshot_id", "left").select(F.coalesce(F.col("again") == F.col("merkle_root"), F.col("row_count") == 0).alias("fine"))
    # hashed where they are, so that only hashes are shuffled; what can't be hashed isn't fine
    each = blobs_json.select(F.coalesce(F.unhex("content_hash"), F.col("content_hash").cast("binary")).alias("hash"), F.coalesce(F.sha2(F.col("payload_json").cast("binary"), 256) == F.col("content_hash"), F.lit(False)).alias("fine"))
    blobs = each.groupBy("hash").agg(F.min("fine").alias("fine"))
    proofs = inclusion_proofs(snapshots, observations, leaves=leaves).select((F.col("valid") & F.col("forgery_rejected")).alias("fine"))
    pointers = ok.where("observations_ref IS NOT NULL").join(dangling_pointers(ok).select("snapshot_id", F.lit(False).alias("_fine")), "snapshot_id", "left").select(F.coalesce("_fine", F.lit(True)).alias("fine"))
    out = row(verify_chains(ok).select(F.col("ok").alias("fine")), "chains")
    for name, df in (("merkle_roots", roots), ("blobs", blobs), ("inclusion_proofs", proofs), ("dedup_pointers", pointers)):
        out = out.unionByName(row(df, name))
    return out
