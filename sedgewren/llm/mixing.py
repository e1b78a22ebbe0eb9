"""Mixing sources to target weights (problem 9) with hash-threshold histograms.

A record's place in the draw is a hash of its key; a source's budget is a threshold on that hash. Token sums by source and
hash bucket give the bucket in which a budget runs out, only that bucket is summed again in finer buckets, and the records
are then chosen with a filter: nothing is sorted, and what is broadcast has one row for each wanted source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def draw(key: Column, seed: int) -> Column:
    """A record's place in the draw, uniform over [0, BUCKETS * BUCKETS)."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BUCKETS * BUCKETS))


def _plain(sized: DataFrame) -> DataFrame:
    """The columns that count; NULL tokens are 0."""
    return sized.select("key", "source", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


def _running(sums: DataFrame, by: list[str], at: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumn("upto", F.sum("tokens").over(w))


def mixing_plan(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """One row for each source of ``targets``: what it has, its budget, whole repeats and the thresholds of the last part.

    ``sized`` has (key, source, tokens). ``total`` is the size of the mix in tokens; by default the largest at which every
    source that has records can reach its share with its repeats. A source without records gets budget 0 and its
    share is spread over the others in proportion. Records of a NULL or unwanted source take no part; other columns are ignored.
    """
    sized = _plain(sized)
    targets = targets.select("source", "target_share", "max_repeat")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"))
    t = targets.where((F.col("target_share") > 0) & (F.col("max_repeat") > 0)).join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    alive = F.col("have") > 0
    everything = Window.partitionBy(F.lit(1))  # a row for each wanted source
    t = t.withColumn("share", F.when(alive, F.col("target_share") / F.sum(F.when(alive, F.col("target_share"))).over(everything)).otherwise(0.0))
    reach = F.min(F.when(alive, F.col("have") * F.col("max_repeat") / F.col("share"))).over(everything)
    t = t.withColumn("total", reach if total is None else F.lit(float(total)))
    t = t.withColumn("budget", F.least(F.col("share") * F.col("total"), (F.col("have") * F.col("max_repeat")).cast("double")))
    t = t.withColumn("whole", F.when(alive, F.least(F.floor(F.col("budget") / F.col("have")), F.col("max_repeat"))).otherwise(F.lit(0)))
    t = t.withColumn("rest", F.greatest(F.col("budget") - F.col("whole") * F.col("have"), F.lit(0.0)))
    wanted = sized.withColumn("h", draw(F.col("key"), seed)).join(F.broadcast(t.where("have > 0").select("source", "rest")), "source")
    coarse = _running(wanted.groupBy("source", "rest", F.floor(F.col("h") / BUCKETS).alias("bucket")).agg(F.sum("tokens").alias("tokens")), ["source"], "bucket")
    edge = coarse.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min("bucket").alias("edge"), F.min_by(F.col("upto") - F.col("tokens"), "bucket").alias("below"))
    fine = wanted.join(F.broadcast(edge), "source").where(F.floor(F.col("h") / BUCKETS) == F.col("edge"))
    fine = _running(fine.groupBy("source", "rest", "edge", "below", "h").agg(F.sum("tokens").alias("tokens")), ["source"], "h")
    fits = F.col("below") + F.col("upto") - F.col("tokens") / 2 <= F.col("rest")  # nearest to the budget
    cut = fine.groupBy("source", "edge").agg(F.max(F.when(fits, F.col("h"))).alias("last"))
    limit = F.coalesce(F.col("last") + 1, F.col("edge") * BUCKETS, F.lit(BUCKETS * BUCKETS))
    return t.join(F.broadcast(cut), "source", "left").withColumn("threshold", F.when(F.col("rest") > 0, limit).otherwise(F.lit(0)))


def mixed(sized: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(key, source, tokens, copies) of each chosen record."""
    sized = _plain(sized)
    p = plan.select("source", "whole", "threshold", "max_repeat")
    copies = F.least(F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0), F.col("max_repeat"))
    return (
        sized.withColumn("h", draw(F.col("key"), seed))
        .join(F.broadcast(p), "source")
        .withColumn("copies", copies.cast("int"))
        .where("copies > 0")
        .select("key", "source", "tokens", "copies")
    )


def mix_report(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and reached share of each wanted source; a source without records is reported with 0."""
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("used_records"), F.max("copies").alias("most_repeats"))
    out = plan.select("source", "target_share", "max_repeat", "have", "budget").join(used, "source", "left")
    everything = Window.partitionBy(F.lit(1))
    tokens = F.coalesce("used_tokens", F.lit(0))
    return out.select(
        "source",
        "target_share",
        "max_repeat",
        F.col("have").alias("available_tokens"),
        tokens.alias("used_tokens"),
        F.coalesce("used_records", F.lit(0)).alias("used_records"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.try_divide(tokens, F.sum(tokens).over(everything)), 6).alias("actual_share"),
    )
