"""How publishers write: their class, what they say of their own retroactive writes, and totals over sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INFORMATIVE = ("incremental", "static")
MOSTLY = 0.5
SELECTIVE = 0.0005
NEAR_SATURATED = 0.2
STAMPS = 1000


def publisher_class(rows: DataFrame) -> DataFrame:
    """Per source the class of its publishing, in one pass.

    ``rows`` has source_key, in_frozen_past (boolean), created_recently, updated_recently (booleans).
    """
    count = lambda c: F.count(F.when(F.col("in_frozen_past") & c, 1))
    by = rows.groupBy("source_key").agg(count(F.lit(True)).alias("frozen_past_count"), count(F.col("created_recently")).alias("created_recent"), count(F.col("updated_recently")).alias("updated_recent"))
    ratio = lambda c: F.when(F.col("frozen_past_count") > 0, F.round(F.col(c) / F.col("frozen_past_count"), 6))
    by = by.withColumn("created_ratio", ratio("created_recent")).withColumn("updated_ratio", ratio("updated_recent"))
    cls = F.when(F.col("frozen_past_count") == 0, "unknown").when(F.col("created_ratio") > MOSTLY, "republish").when(F.col("updated_ratio") > MOSTLY, "bulk_touch").when(F.col("updated_ratio") > SELECTIVE, "incremental").otherwise("static")
    return by.withColumn("pipeline_class", cls).withColumn("timestamps_informative", F.col("pipeline_class").isin(*INFORMATIVE))


def publishing_rows(rows: DataFrame, source_key: str, date_field: str, stratum_end: str, cutoff: str, created: str = ":created_at", updated: str = ":updated_at") -> DataFrame:
    """A published table's rows as ``publisher_class`` and ``assertions`` take them: which are in the closed past, and
    which the platform says were created or written after ``cutoff``."""
    before = lambda c, at: F.col(f"`{c}`") < F.lit(at).cast(rows.schema[c].dataType)
    after = lambda c: F.coalesce(F.col(f"`{c}`") > F.lit(cutoff).cast(rows.schema[c].dataType), F.lit(False))
    closed = F.coalesce(before(date_field, stratum_end), F.lit(False))
    return rows.select(F.lit(source_key).alias("source_key"), closed.alias("in_frozen_past"), after(created).alias("created_recently"), after(updated).alias("updated_recently"), closed.alias("closed"), after(updated).alias("touched"), F.col(f"`{date_field}`").cast("string").alias("event_date"), F.col(f"`{updated}`").cast("string").alias("updated_at"))


def distinct_recent_stamps(rows: DataFrame, stamp: str, limit: int = STAMPS) -> DataFrame:
    """Distinct instants among the rows written last; a reload stamps one instant on a whole table."""
    return rows.orderBy(F.desc_nulls_last(stamp)).limit(limit).agg(F.countDistinct(stamp).alias("distinct_stamps"))


def set_class(sources: DataFrame, classes: DataFrame) -> DataFrame:
    """The sources with their measured class; what was noted at discovery stays."""
    got = classes.select("source_key", F.col("pipeline_class").alias("_class"))
    return sources.join(got, "source_key", "left").withColumn("pipeline_class", F.coalesce("_class", "pipeline_class")).drop("_class")


def census(sources: DataFrame) -> DataFrame:
    """Sources by class, with the totals that they are read against in every row."""
    named = sources.select(F.coalesce("pipeline_class", F.lit("unknown")).alias("pipeline_class"))
    by = named.groupBy("pipeline_class").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # as many rows as there are classes
    known = F.sum(F.when(F.col("pipeline_class") != "unknown", F.col("n")).otherwise(0)).over(every)
    clear = F.sum(F.when(F.col("pipeline_class").isin(*INFORMATIVE), F.col("n")).otherwise(0)).over(every)
    return by.select("pipeline_class", "n", known.alias("characterised"), clear.alias("informative"), F.when(known > 0, F.round(1 - clear / known, 3)).alias("share_uninterpretable"))


def census_by_city(sources: DataFrame) -> DataFrame:
    return sources.groupBy("city", F.coalesce("pipeline_class", F.lit("unknown")).alias("pipeline_class")).agg(F.count(F.lit(1)).alias("n"))


def age_bucket(event: Column, now: Column) -> Column:
    """How many years before ``now`` an event lies, in whole days over 365.25."""
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(event.cast("string"), "Z", ""), r"\..*$", ""))
    years = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400) / 365.25
    return F.when(at.isNull(), "unknown").when(years < 2, "1-2 years").when(years < 4, "2-4 years").when(years < 7, "4-7 years").when(years < 12, "7-12 years").otherwise("12+ years")


def assertions(rows: DataFrame) -> DataFrame:
    """Per source, what it says of writes to its closed past; only sources that it says some of.

    ``rows`` has source_key, closed, touched (booleans) and event_date (text).
    """
    touched = F.col("closed") & F.col("touched")
    by = rows.groupBy("source_key").agg(F.count(F.when(F.col("closed"), 1)).alias("closed_period_records"), F.count(F.when(touched, 1)).alias("asserted_modified"), F.min(F.when(touched, F.col("event_date"))).alias("oldest_event_touched"))
    share = F.col("asserted_modified") / F.col("closed_period_records")
    return by.where("asserted_modified > 0").select("*", F.round(share, 6).alias("share"), (share > NEAR_SATURATED).alias("near_saturated"))


def latest_touched(rows: DataFrame, stamp: str = "updated_at", sample: int = 40) -> DataFrame:
    """Per source the closed records written last, with their place."""
    w = Window.partitionBy("source_key").orderBy(F.desc(stamp), "row_uid")
    return rows.where("closed AND touched").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= sample)


def age_distribution(sample: DataFrame, now: Column) -> DataFrame:
    return sample.groupBy("source_key", age_bucket(F.col("event_date"), now).alias("age_bucket")).agg(F.count(F.lit(1)).alias("n"))


def assertion_totals(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Totals over the sources whose timestamps mean something."""
    known = sources.where(F.col("pipeline_class").isin(*INFORMATIVE)).select("source_key")
    return found.join(known, "source_key", "left_semi").agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("asserted_modified"), F.lit(0)).alias("asserted_modified"), F.coalesce(F.sum("closed_period_records"), F.lit(0)).alias("closed_period_records"))


def deepest_reach(found: DataFrame, limit: int = 10) -> DataFrame:
    return found.where("oldest_event_touched IS NOT NULL").orderBy("oldest_event_touched", "source_key").limit(limit)
