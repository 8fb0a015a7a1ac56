"""What changed between consecutive observations, and what kind of change it is.

All pairs of all sources are compared in one job. Only hashes are shuffled by record; payloads are joined for the records
whose hash moved. Per-pair totals are window counts over what was found.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import deltas as D
from ..sources.shared import is_few, join_few, written

PAIR = ("source_key", "from_snapshot", "to_snapshot")
KINDS = {
    "material": ("semantic_revision", "coordinated_revision", "lifecycle_progression", "deletion", "retroactive_append", "schema_drift", "frozen_past_shift", "tally_shift"),
    "artifact": ("provenance_churn", "identity_churn", "withdrawn_unstable_key", "ordering_change", "transient_absence", "left_observation_window", "balance_transfer"),
}
#: Claims about single records that a source with an unstable key can't support.
WITHDRAWN = ("semantic_revision", "coordinated_revision", "deletion", "retroactive_append", "identity_churn", "provenance_churn")
COORDINATED = 25
ISOLATED = 3
BALANCED = 0.9
COLUMNS = (*PAIR, "kind", "row_uid", "before_hash", "after_hash", "field_deltas", "significance", "detail")


class Controls(NamedTuple):
    """What was learned about the sources; any table may be missing.

    recomputed: source_key, field. dependencies: source_key, field, driver. unstable: source_key, reason.
    verdicts: source_key, row_uid, verdict, found_as, reason.
    """

    recomputed: DataFrame | None = None
    dependencies: DataFrame | None = None
    unstable: DataFrame | None = None
    verdicts: DataFrame | None = None


def pairs(snapshots: DataFrame) -> DataFrame:
    """Each good observation and the next one of its source."""
    w = Window.partitionBy("source_key").orderBy("snapshot_id")
    owner = F.coalesce("observations_ref", "snapshot_id") if "observations_ref" in snapshots.columns else F.col("snapshot_id")
    ok = snapshots.where("status = 'ok'").select("source_key", "snapshot_id", owner.alias("owner"))
    ahead = ok.select("source_key", F.col("snapshot_id").alias("from_snapshot"), F.lead("snapshot_id").over(w).alias("to_snapshot"), F.col("owner").alias("from_owner"), F.lead("owner").over(w).alias("to_owner"))
    return ahead.where("to_snapshot IS NOT NULL")


def record_status(pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """Each record of each pair: ``same``, ``revised``, ``departed`` or ``arrived``, with both hashes."""
    # a pair that shares one stored observation has no record that differs, and is read once
    differ, fits = pairs.where("from_owner <> to_owner"), is_few(pairs)

    def side(which: DataFrame, owner: str, name: str) -> DataFrame:
        rows = observations.select("snapshot_id", "row_uid", F.col("content_hash").alias(name))
        return join_few(rows, which.select(*PAIR, F.col(owner).alias("snapshot_id")), "snapshot_id", "row_uid", fits).select(*PAIR, "row_uid", name)

    both = side(differ, "from_owner", "before_hash").join(side(differ, "to_owner", "after_hash"), [*PAIR, "row_uid"], "full_outer")
    status = F.when(F.col("before_hash").isNull(), "arrived").when(F.col("after_hash").isNull(), "departed").when(F.col("before_hash") == F.col("after_hash"), "same").otherwise("revised")
    found = both.withColumn("status", status)
    alike = side(pairs.where("from_owner = to_owner"), "from_owner", "before_hash")
    return found.unionByName(alike.withColumn("after_hash", F.col("before_hash")).withColumn("status", F.lit("same")))


def record_deltas(status: DataFrame, blobs: DataFrame) -> DataFrame:
    """The revised records with their field deltas; ``blobs`` is content_hash, payload, and may have a blob more than once.

    Blobs of records that didn't move are left out before copies are sought, and no payloads are sorted before a shuffle.
    """
    moved = status.where("status = 'revised'").drop("status")
    wanted = moved.select(F.explode(F.array("before_hash", "after_hash")).alias("content_hash")).distinct()
    blobs = blobs.select("content_hash", "payload").join(wanted, "content_hash", "left_semi").repartition("content_hash").dropDuplicates(["content_hash"])
    side = lambda name: blobs.select(F.col("content_hash").alias(f"{name}_hash"), F.col("payload").alias(f"{name}_payload"))
    empty = F.create_map().cast("map<string,string>")
    with_both = moved.join(side("before"), "before_hash", "left").join(side("after"), "after_hash", "left")
    d = D.between(F.coalesce("before_payload", empty), F.coalesce("after_payload", empty))
    return with_both.select(*PAIR, "row_uid", "before_hash", "after_hash", d.alias("deltas"))


def schema_drift(snapshots: DataFrame) -> DataFrame:
    """One row for each pair whose columns differ, with those added and removed."""
    w = Window.partitionBy("source_key").orderBy("snapshot_id")
    ok = snapshots.where("status = 'ok'").select("source_key", "snapshot_id", "columns")
    both = ok.select("source_key", F.col("snapshot_id").alias("from_snapshot"), F.lead("snapshot_id").over(w).alias("to_snapshot"), F.col("columns").alias("b"), F.lead("columns").over(w).alias("a")).where("to_snapshot IS NOT NULL")
    out = both.select(*PAIR, F.array_sort(F.array_except("a", "b")).alias("added"), F.array_sort(F.array_except("b", "a")).alias("removed"))
    return out.where((F.size("added") > 0) | (F.size("removed") > 0)).withColumn("significance", F.when(F.size("removed") > 0, 0.9).otherwise(0.5))


def frozen_past_shift(aggregates: DataFrame) -> DataFrame:
    """Pairs whose closed past changed its count; ``aggregates`` has source_key, snapshot_id, frozen_past_count."""
    w = Window.partitionBy("source_key").orderBy("snapshot_id")
    both = aggregates.select("source_key", F.col("snapshot_id").alias("from_snapshot"), F.lead("snapshot_id").over(w).alias("to_snapshot"), F.col("frozen_past_count").alias("before"), F.lead("frozen_past_count").over(w).alias("after"))
    return both.where("before <> after").withColumn("significance", F.when(F.col("after") < F.col("before"), 0.95).otherwise(0.55))


def tally_moves(tallies: DataFrame, pairs: DataFrame) -> DataFrame:
    """Categories whose count moved; ``tallies`` has source_key, snapshot_id, dim, category, n."""
    side = lambda at, name: pairs.select(*PAIR, F.col(at).alias("snapshot_id")).join(tallies, ["source_key", "snapshot_id"]).select(*PAIR, "dim", "category", F.col("n").alias(name))
    both = side("from_snapshot", "before").join(side("to_snapshot", "after"), [*PAIR, "dim", "category"], "full_outer").fillna(0, ["before", "after"])
    return both.where("before <> after")


def tally_shift(tallies: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each dimension of a pair whose tallies moved, with how many records that took."""
    by = tally_moves(tallies, pairs).groupBy(*PAIR, "dim").agg(F.sum(F.abs(F.col("after") - F.col("before"))).alias("magnitude"), F.count(F.lit(1)).alias("categories"))
    return by.withColumn("significance", D.rounded(F.least(F.lit(1.0), F.lit(0.4) + D.field_weight(F.col("dim")) * 0.4)))


def volatile_churn(snapshots: DataFrame) -> DataFrame:
    """Pairs with the same content root but another digest of the write bookkeeping."""
    w = Window.partitionBy("source_key").orderBy("snapshot_id")
    ok = snapshots.where("status = 'ok'")
    both = ok.select("source_key", F.col("snapshot_id").alias("from_snapshot"), F.lead("snapshot_id").over(w).alias("to_snapshot"), "merkle_root", "volatile_digest", F.lead("merkle_root").over(w).alias("root"), F.lead("volatile_digest").over(w).alias("digest"), F.lead("row_count").over(w).alias("rows"))
    return both.where("merkle_root = root AND volatile_digest <> digest").select(*PAIR, "rows")


def table_changes(snapshots: DataFrame, tallies: DataFrame | None = None) -> DataFrame:
    """What changed about whole tables: columns, closed-window counts, category tallies, and write bookkeeping alone."""
    ok = snapshots.where("status = 'ok'")
    delta = lambda b, a: F.struct(b.cast("string").alias("before"), a.cast("string").alias("after"))
    none = F.lit(None).cast("string")

    def row(df: DataFrame, kind: str, deltas: Column, significance: Column, detail: Column) -> DataFrame:
        return df.select(*PAIR, F.lit(kind).alias("kind"), none.alias("row_uid"), none.alias("before_hash"), none.alias("after_hash"), deltas.cast(D.DELTAS).alias("field_deltas"), significance.alias("significance"), detail.alias("detail"))

    drift = schema_drift(ok)
    out = row(drift, "schema_drift", F.create_map(F.lit("added"), delta(none, F.to_json("added")), F.lit("removed"), delta(F.to_json("removed"), none)), F.col("significance"), F.concat(F.lit("columns added: "), F.array_join("added", ", "), F.lit("; removed: "), F.array_join("removed", ", ")))
    past = frozen_past_shift(ok.select("source_key", "snapshot_id", "frozen_past_count"))
    moved = F.when(F.col("after") < F.col("before"), "records left").otherwise("records came into")
    parts = [
        row(past, "frozen_past_shift", F.create_map(F.lit("frozen_past_count"), delta(F.col("before"), F.col("after"))), F.col("significance"), F.concat_ws(" ", moved, F.lit("the closed past:"), "before", F.lit("to"), "after")),
        row(volatile_churn(ok), "provenance_churn", F.lit(None), F.lit(0.0), F.concat_ws(" ", F.lit("all"), "rows", F.lit("records were written again, none of their published values changed"))),
    ]
    if tallies is not None:
        between = pairs(snapshots)
        by = tally_moves(tallies, between).groupBy(*PAIR, "dim").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", delta(F.col("before"), F.col("after")))))).alias("moved"))
        shift = tally_shift(tallies, between).join(by, [*PAIR, "dim"])
        parts.append(row(shift, "tally_shift", F.col("moved"), F.col("significance"), F.concat_ws(" ", F.lit("tallies by"), "dim", F.lit("moved:"), "magnitude", F.lit("records in"), "categories", F.lit("categories"))))
    for p in parts:
        out = out.unionByName(p)
    return out


def _per_source(frame: DataFrame | None, value: Column, name: str, base: DataFrame, empty: Column) -> DataFrame:
    if frame is None:
        return base.withColumn(name, empty)
    return base.join(frame.groupBy("source_key").agg(value.alias(name)), "source_key", "left").withColumn(name, F.coalesce(name, empty))


def classify_revisions(deltas: DataFrame, controls: Controls = Controls(), drift: DataFrame | None = None) -> DataFrame:
    """The kind and significance of each revised record; the first rule that holds decides."""
    none = F.array().cast("array<string>")
    d = _per_source(controls.recomputed, F.collect_set("field"), "ignored", deltas, none)
    d = _per_source(controls.dependencies, F.map_from_entries(F.collect_list(F.struct("field", "driver"))), "drivers", d, F.create_map().cast("map<string,string>"))
    if drift is not None:
        d = d.join(drift.select(*PAIR, F.concat("added", "removed").alias("drifted")), [*PAIR], "left").withColumn("ignored", F.concat("ignored", F.coalesce("drifted", none))).drop("drifted")
    d = d.withColumn("surviving", F.map_filter("deltas", lambda k, _: ~F.array_contains("ignored", k)))
    follows = lambda k: F.coalesce(F.map_contains_key("surviving", F.col("drivers")[k]), F.lit(False))
    d = d.withColumn("alone", F.map_filter("surviving", lambda k, _: ~follows(k)))
    d = d.withColumn("independent", F.when(F.size("alone") > 0, F.col("alone")).otherwise(F.col("surviving")))
    i, s = F.col("independent"), F.col("surviving")
    kind = F.when(F.size(s) == 0, "provenance_churn").when(D.is_ordering_only(i), "ordering_change").when(D.is_balance_transfer(s), "balance_transfer").when(D.is_lifecycle(i), "lifecycle_progression").otherwise("semantic_revision")
    d = d.withColumn("kind", kind)
    fixed = F.create_map(*[F.lit(x) for kv in {"provenance_churn": 0.0, "ordering_change": 0.15, "balance_transfer": 0.2, "lifecycle_progression": 0.2}.items() for x in kv])
    weight = F.when(F.col("kind") == "semantic_revision", D.revision_significance(i)).otherwise(fixed[F.col("kind")])
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ", ")
    said = F.when(F.col("kind") == "provenance_churn", F.concat(F.lit("only recomputed fields moved: "), names("deltas"))).otherwise(F.concat_ws(" ", F.col("kind"), F.lit("in"), names(F.when(F.col("kind") == "balance_transfer", s).otherwise(i))))
    return d.select(*PAIR, "kind", "row_uid", "before_hash", "after_hash", F.when(F.size(s) > 0, s).alias("field_deltas"), weight.alias("significance"), said.alias("detail"))


def classify_presence(status: DataFrame, last_seen: DataFrame, controls: Controls = Controls()) -> DataFrame:
    """The kind of each departure and arrival; ``last_seen`` is source_key, row_uid, last_snapshot."""
    gone = status.where("status = 'departed'").join(last_seen, ["source_key", "row_uid"], "left")
    if controls.verdicts is not None:
        gone = gone.join(controls.verdicts.select("source_key", "row_uid", "verdict", "reason"), ["source_key", "row_uid"], "left")
    else:
        gone = gone.withColumn("verdict", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    kind = F.when(F.col("last_snapshot") > F.col("to_snapshot"), "transient_absence").when(F.col("verdict").isNotNull() & (F.col("verdict") != "confirmed_absent"), "left_observation_window").otherwise("deletion")
    detail = F.when(F.col("kind") == "transient_absence", "absent here and present again later").when(F.col("kind") == "left_observation_window", F.concat(F.lit("withdrawn: "), F.coalesce("reason", F.lit("")))).when(F.col("verdict").isNotNull(), "absent since, and at the source").otherwise("absent since, not asked for at the source")
    left = gone.withColumn("kind", kind).withColumn("detail", detail).withColumn("significance", F.when(F.col("kind") == "deletion", 1.0).otherwise(0.1))
    come = status.where("status = 'arrived'").withColumn("kind", F.lit("retroactive_append")).withColumn("significance", F.lit(0.6)).withColumn("detail", F.lit("came into a window that had closed"))
    out = [x.withColumn("field_deltas", F.lit(None).cast(D.DELTAS)).select(*COLUMNS) for x in (left, come)]
    return out[0].unionByName(out[1])


def identity_churn(changes: DataFrame, volumes: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Departures that arrivals balance are identities that moved.

    ``volumes`` is the pair with ``gone`` and ``arrived``, all of them; ``modes`` the pair with its ``identity_mode``.
    """
    c = changes.join(volumes, [*PAIR], "left").fillna(0, ["gone", "arrived"])
    c = c.join(modes, [*PAIR], "left") if modes is not None else c.withColumn("identity_mode", F.lit("business_key"))
    both = F.least("gone", "arrived")
    balance = F.when(F.greatest("gone", "arrived") > 0, both / F.greatest("gone", "arrived")).otherwise(0.0)
    mine = F.col("kind").isin("deletion", "retroactive_append")
    by_content = mine & (F.coalesce("identity_mode", F.lit("business_key")) == "content")
    by_balance = mine & ~by_content & (both > 0) & (balance >= BALANCED)
    partly = mine & ~by_content & (both > 0) & (balance < BALANCED)
    c = c.select(
        *PAIR,
        F.when(by_content | by_balance, "identity_churn").otherwise(F.col("kind")).alias("kind"),
        "row_uid",
        "before_hash",
        "after_hash",
        "field_deltas",
        F.when(by_content, 0.1).when(by_balance, 0.15).when(partly, D.rounded(F.col("significance") * (1 - balance))).otherwise(F.col("significance")).alias("significance"),
        F.when(by_content | by_balance, F.concat_ws(" ", "gone", F.lit("left and"), "arrived", F.lit("came: identities moved"))).otherwise(F.col("detail")).alias("detail"),
    )
    return c


def withdraw_unstable(changes: DataFrame, unstable: DataFrame | None) -> DataFrame:
    """For sources with an unstable key, one row in place of the claims about single records."""
    if unstable is None:
        return changes
    marked = changes.join(unstable.select("source_key", F.lit(True).alias("unstable"), "reason"), "source_key", "left")
    drop = F.coalesce("unstable", F.lit(False)) & F.col("kind").isin(*WITHDRAWN)
    kept = marked.where(~drop).select(*COLUMNS)
    folded = marked.where(drop).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.first("reason").alias("reason"))
    none = {"row_uid": "string", "before_hash": "string", "after_hash": "string", "field_deltas": D.DELTAS}
    row = folded.select(*PAIR, F.lit("withdrawn_unstable_key").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(0.0).alias("significance"), F.concat_ws(" ", "n", F.lit("claims withdrawn."), "reason").alias("detail"))
    return kept.unionByName(row.select(*COLUMNS))


def mark_coordinated(changes: DataFrame) -> DataFrame:
    """Revisions that many records share are one operation; those of a rare shape stand out."""
    revision = F.col("kind") == "semantic_revision"
    c = changes.withColumn("signature", F.when(revision, F.sha2(F.to_json(F.array_sort(F.map_entries("field_deltas")), {"ignoreNullFields": "false"}), 256)))
    c = c.withColumn("shape", F.when(revision, F.array_join(F.array_sort(F.map_keys("field_deltas")), "|")))
    # written, as four parts of the plan read it; partial counts are joined back, so that no task holds a whole pair
    c = written(c, "classified")
    same = c.where(revision).groupBy(*PAIR, "signature").agg(F.count(F.lit(1)).alias("alike"))
    shape = c.where(revision).groupBy(*PAIR, "shape").agg(F.count(F.lit(1)).alias("shaped"))
    every = c.where(revision).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("revisions"))
    c = c.join(same, [*PAIR, "signature"], "left").join(shape, [*PAIR, "shape"], "left").join(every, [*PAIR], "left")
    many = revision & (F.col("alike") >= COORDINATED)
    rare = revision & ~many & (F.col("shaped") <= ISOLATED) & (F.col("revisions") >= 2)
    return c.select(
        *PAIR,
        F.when(many, "coordinated_revision").otherwise(F.col("kind")).alias("kind"),
        "row_uid",
        "before_hash",
        "after_hash",
        "field_deltas",
        F.when(many, D.rounded(F.col("significance") * 0.25)).when(rare, D.rounded(F.least(F.lit(1.0), F.col("significance") + 0.2))).otherwise(F.col("significance")).alias("significance"),
        F.when(many, F.concat_ws(" ", F.lit("one of"), "alike", F.lit("records changed alike"))).when(rare, F.concat(F.col("detail"), F.lit("; nothing comparable in this pair"))).otherwise(F.col("detail")).alias("detail"),
    )


def last_seen(snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """The last stored observation that holds each record."""
    return join_few(observations.select("snapshot_id", "row_uid"), snapshots.select("snapshot_id", "source_key"), "snapshot_id", "row_uid").groupBy("source_key", "row_uid").agg(F.max("snapshot_id").alias("last_snapshot"))


def volumes(status: DataFrame) -> DataFrame:
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    return status.where("status IN ('departed', 'arrived')").groupBy(*PAIR).agg(count("departed").alias("gone"), count("arrived").alias("arrived"))


def record_changes(status: DataFrame, deltas: DataFrame, seen: DataFrame, controls: Controls = Controls(), drift: DataFrame | None = None, modes: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """All classified changes of records, and of ``tables``, after identity churn, withdrawal and coordination, in that order."""
    found = classify_revisions(deltas, controls, drift).select(*COLUMNS).unionByName(classify_presence(status, seen, controls))
    if tables is not None:
        found = found.unionByName(tables.select(*COLUMNS))
    return mark_coordinated(withdraw_unstable(identity_churn(found, volumes(status), modes), controls.unstable))


def summarise(changes: DataFrame, sources: DataFrame, least: float = 0.5, limit: int = 50) -> DataFrame:
    """The weightiest changes with their source's title and city."""
    return changes.where(F.col("significance") >= least).join(sources.select("source_key", "title", "city"), "source_key").orderBy(F.desc("significance"), F.desc("change_id")).limit(limit)
