"""Asking the source whether a record called deleted is really gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_key(v: Column) -> Column:
    """A key without the quotes and blanks that its making left around it, inner blanks single."""
    return F.trim(F.regexp_replace(F.regexp_replace(v, "^[\"'\\s]+|[\"'\\s]+$", ""), r"\s+", " "))


def claims(changes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Deletions without a verdict yet."""
    return changes.where("kind = 'deletion'").select("source_key", "row_uid").distinct().join(verdicts.select("source_key", "row_uid"), ["source_key", "row_uid"], "left_anti")


def confirm(claims: DataFrame, published: DataFrame, sources: DataFrame) -> DataFrame:
    """A verdict for each claim.

    ``published`` is what the sources hold now: source_key, key, date_value (text). The key as it was recorded counts
    before its cleaned form. Sources without a single key field, and unknown ones, can't be asked.
    """
    s = sources.select("source_key", (F.coalesce(F.size("business_key"), F.lit(0)) == 1).alias("single"), "stratum_start", "stratum_end")
    here = published.where("key IS NOT NULL").groupBy("source_key", "key").agg(F.min("date_value").alias("date_value"))
    c = claims.join(s, "source_key", "left").withColumn("single", F.coalesce("single", F.lit(False))).withColumn("clean", normal_key(F.col("row_uid")))
    exact = here.select("source_key", F.col("key").alias("row_uid"), F.lit(True).alias("exact"), F.col("date_value").alias("exact_date"))
    near = here.select("source_key", F.col("key").alias("clean"), F.lit(True).alias("near"), F.col("date_value").alias("near_date"))
    c = c.join(exact, ["source_key", "row_uid"], "left").join(near, ["source_key", "clean"], "left")
    is_exact, is_near = F.coalesce("exact", F.lit(False)), F.coalesce("near", F.lit(False)) & (F.col("clean") != F.col("row_uid"))
    verdict = F.when(~F.col("single"), "unverifiable").when(is_exact, "still_present").when(is_near, "key_reformatted").otherwise("confirmed_absent")
    date = F.when(F.col("verdict") == "still_present", F.col("exact_date")).when(F.col("verdict") == "key_reformatted", F.col("near_date"))
    c = c.withColumn("verdict", verdict).withColumn("date_value", date)
    c = c.withColumn("inside_window", F.when(F.col("date_value").isNotNull(), (F.col("date_value") >= F.col("stratum_start")) & (F.col("date_value") < F.col("stratum_end"))))
    reason = F.when(F.col("verdict") == "unverifiable", "no single key field").when(F.col("verdict") == "key_reformatted", "published under another form of its key").when(F.col("verdict") == "confirmed_absent", "under neither form of its key").when(F.col("inside_window") == F.lit(False), "published, outside the window").otherwise("published")
    found = F.when(F.col("verdict") == "still_present", F.col("row_uid")).when(F.col("verdict") == "key_reformatted", F.col("clean"))
    return c.select("source_key", "row_uid", "verdict", found.alias("found_as"), "inside_window", reason.alias("reason"))


def apply_verdicts(changes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The changes as the verdicts leave them; claims that can't be verified stay as they are."""
    v = verdicts.select("source_key", "row_uid", "verdict", F.col("reason").alias("_reason"))
    c = changes.join(v, ["source_key", "row_uid"], "left")
    back = (F.col("kind") == "deletion") & F.col("verdict").isin("still_present", "key_reformatted")
    sure = (F.col("kind") == "deletion") & (F.col("verdict") == "confirmed_absent")
    detail = F.when(back, F.concat(F.lit("withdrawn: "), "_reason")).when(sure, F.concat_ws("; ", "detail", F.lit("absent at the source too"))).otherwise(F.col("detail"))
    out = c.withColumn("kind", F.when(back, "left_observation_window").otherwise(F.col("kind"))).withColumn("significance", F.when(back, 0.1).otherwise(F.col("significance"))).withColumn("detail", detail)
    return out.select(*changes.columns)


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
