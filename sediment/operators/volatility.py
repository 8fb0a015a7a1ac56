"""What the archive teaches about its sources: recomputed fields, dependent fields, unstable keys.

Everything is measured from raw field deltas, before any classification, so that measuring twice gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.deltas import DERIVED
from .diff import PAIR

LEAST_REVISIONS = 20  #: pairs with fewer revised records say nothing about a field
RECOMPUTED_SHARE = 0.9
LEAST_PAIRS = 3
UNSTABLE_SHARE = 0.5
MANY_RECOMPUTED = 4
CONFIDENCE = 0.97
LEAST_MOVES = 8


def field_moves(deltas: DataFrame) -> DataFrame:
    """Per pair and field: records in which the field moved, and the pair's records."""
    # one pass: records with the same fields are counted first, and a null among the fields stands for all of them
    shapes = deltas.where(F.size("deltas") > 0).groupBy(*PAIR, F.map_keys("deltas").alias("fields")).agg(F.count(F.lit(1)).alias("times"))
    n = shapes.select(*PAIR, "times", F.explode(F.concat("fields", F.array(F.lit(None).cast("string")))).alias("field")).groupBy(*PAIR, "field").agg(F.sum("times").alias("n"))
    by = n.groupBy(*PAIR).agg(F.max(F.when(F.col("field").isNull(), F.col("n"))).alias("total"), F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "n"))).alias("moved"))
    return by.select(*PAIR, "total", F.explode("moved").alias("m")).select(*PAIR, "m.field", "m.n", "total")


def field_volatility(moves: DataFrame) -> DataFrame:
    """Per source and field: the mean share of records over the pairs in which it moved, and a verdict."""
    by = moves.where(F.col("total") >= LEAST_REVISIONS).groupBy("source_key", "field").agg(F.count(F.lit(1)).alias("pairs_seen"), F.avg(F.col("n") / F.col("total")).alias("mean"))
    verdict = F.when((F.col("mean") >= RECOMPUTED_SHARE) & (F.col("pairs_seen") >= LEAST_PAIRS), "recomputed").otherwise("ordinary")
    return by.select("source_key", "field", "pairs_seen", F.round("mean", 4).alias("mean_share"), verdict.alias("verdict"))


def source_stability(moves: DataFrame, volatility: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per source: how much of it still differs once recomputed fields are set aside."""
    recomputed = volatility.where("verdict = 'recomputed'").select("source_key", "field")
    wide = recomputed.groupBy("source_key").agg(F.count(F.lit(1)).alias("wide"))
    size = snapshots.where("status = 'ok'").select("snapshot_id", "row_count")
    believed = moves.join(recomputed.withColumn("drop", F.lit(True)), ["source_key", "field"], "left")
    most = believed.groupBy(*PAIR).agg(F.coalesce(F.max(F.when(F.col("drop").isNull(), F.col("n"))), F.lit(0)).alias("substantive"))
    a, b = (size.select(F.col("snapshot_id").alias(f"{s}_snapshot"), F.nullif("row_count", F.lit(0)).alias(f"{s}_rows")) for s in ("from", "to"))
    sized = most.join(b, "to_snapshot", "left").join(a, "from_snapshot", "left").withColumn("rows", F.coalesce("to_rows", "from_rows")).where("rows IS NOT NULL")
    by = sized.groupBy("source_key").agg(F.count(F.lit(1)).alias("pairs_seen"), F.avg(F.least(F.lit(1.0), F.col("substantive") / F.col("rows"))).alias("mean")).where(F.col("pairs_seen") >= LEAST_PAIRS)
    out = by.join(wide, "source_key", "left").fillna(0, ["wide"])
    many, far = F.col("wide") >= MANY_RECOMPUTED, F.col("mean") >= UNSTABLE_SHARE
    reason = F.when(many, F.concat(F.col("wide").cast("string"), F.lit(" fields move in nearly every record"))).when(far, F.lit("most records differ in every pair")).otherwise(F.lit("most records stay"))
    return out.select("source_key", "pairs_seen", F.round("mean", 4).alias("mean_revised"), F.when(many | far, "key_unstable").otherwise("stable").alias("verdict"), reason.alias("reason"))


def field_dependency(deltas: DataFrame, volatility: DataFrame) -> DataFrame:
    """Fields that hardly ever move without another one, and that one; of equal drivers the first by name."""
    recomputed = volatility.where("verdict = 'recomputed'").select("source_key", "field")
    records = deltas.where(F.size("deltas") > 0).select("source_key", F.map_keys("deltas").alias("fields"))
    moves = records.select("source_key", F.explode("fields").alias("field")).groupBy("source_key", "field").agg(F.count(F.lit(1)).alias("n"))
    # records with the same fields are counted once, with their number
    shapes = records.groupBy("source_key", F.array_sort("fields").alias("fields")).agg(F.count(F.lit(1)).alias("times"))
    two = shapes.select("source_key", "times", "fields", F.explode("fields").alias("field")).select("source_key", "times", "field", F.explode("fields").alias("driver")).where("field <> driver")
    together = two.groupBy("source_key", "field", "driver").agg(F.sum("times").alias("together"))
    drop = recomputed.withColumnRenamed("field", "driver")
    c = together.join(recomputed, ["source_key", "field"], "left_anti").join(drop, ["source_key", "driver"], "left_anti")
    c = c.join(moves, ["source_key", "field"]).join(moves.select("source_key", F.col("field").alias("driver"), F.col("n").alias("driver_n")), ["source_key", "driver"])
    c = c.where((F.col("n") >= LEAST_MOVES) & (F.col("driver_n") >= F.col("n")))
    top = Window.partitionBy("source_key", "field").orderBy(F.desc("together"), "driver")
    c = c.withColumn("rank", F.row_number().over(top)).where("rank = 1").withColumn("conditional", F.round(F.col("together") / F.col("n"), 4))
    c = c.where(F.col("together") / F.col("n") >= CONFIDENCE).select("source_key", "field", "driver", "n", "conditional")
    # of two fields that follow each other, one direction stays
    back = c.select("source_key", F.col("field").alias("driver"), F.col("driver").alias("field"), F.lit(True).alias("mutual"))
    c = c.join(back, ["source_key", "field", "driver"], "left")
    mine, theirs = F.col("field").rlike(DERIVED), F.col("driver").rlike(DERIVED)
    loses = F.coalesce("mutual", F.lit(False)) & F.when(mine != theirs, ~mine).otherwise(F.col("field") > F.col("driver"))
    return c.where(~loses).select("source_key", "field", "driver", F.col("n").alias("observations"), "conditional")
