"""Metric aggregation; every mean comes with the number of values it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, share) of each value; NULL counts as unknown."""
    n = rows.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias(by)).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def clean_mean(c: Column, digits: int = 4) -> Column:
    """Mean without NULL and NaN, rounded half to even; NULL if nothing is left."""
    return F.bround(F.avg(F.when(~F.isnan(c), c)), digits)


def metric_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, n) over all rows."""
    wide = rows.agg(*[F.struct(clean_mean(F.col(m)).alias("mean"), F.count(F.when(~F.isnan(m), F.col(m))).alias("n")).alias(m) for m in metrics])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.mean").alias("mean"), F.col(f"{m}.n").alias("n")) for m in metrics])).alias("x")).select("x.*")


def group_means(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Per group: rows, and of each metric the mean of its values rounded to four decimals."""
    aggs = [clean_mean(F.bround(F.col(m), 4)).alias(m) for m in metrics]
    return rows.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias(by)).agg(F.count(F.lit(1)).alias("n"), *aggs)


def classification_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, precision, recall, f1, support, accuracy, macro_f1) for labels 0 and 1; a division by zero gives 0."""
    cells = rows.agg(*[F.count_if((F.col(truth) == a) & (F.col(guess) == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    out = []
    for k in (0, 1):
        hit, guessed, real = c(f"c{k}{k}"), c(f"c0{k}") + c(f"c1{k}"), c(f"c{k}0") + c(f"c{k}1")
        p, r = ratio(hit, guessed), ratio(hit, real)
        out.append((k, p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), real))
    total = c("c00") + c("c01") + c("c10") + c("c11")
    macro = (out[0][3] + out[1][3]) / 2
    rows_ = [F.struct(F.lit(k).alias("label"), *[F.round(x, 6).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f, "f1"))], s.alias("support"), F.round(ratio(c("c00") + c("c11"), total), 6).alias("accuracy"), F.round(macro, 6).alias("macro_f1")) for k, p, r, f, s in out]
    return cells.select(F.explode(F.array(*rows_)).alias("x")).select("x.*")


def confusion(rows: DataFrame, truth: str, guess: str, labels: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(truth, guess, n) of every cell, empty ones too; other labels take no part."""
    known = rows.where(F.col(truth).isin(*labels) & F.col(guess).isin(*labels)).groupBy(F.col(truth).cast("int").alias("truth"), F.col(guess).cast("int").alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    cells = rows.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth int, guess int")
    return cells.join(known, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).alias("n"))


def stage_distribution(rows: DataFrame, stages: list[str], by: str = "hit_stage") -> DataFrame:
    """(stage, n, share) of every stated stage, those without rows too; other values count as unknown."""
    known = F.when(F.col(by).isin(*stages), F.col(by)).otherwise("unknown")
    n = rows.groupBy(known.alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(s,) for s in stages], "stage string").join(n, "stage", "full").select("stage", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return every.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("n").cast("double"), total.cast("double")), F.lit(0.0)), 6))


def covered_share(verdicts: DataFrame, by: str, covered: str, name: str) -> DataFrame:
    """(by, name): share of a sample's statements that a judge found covered; NULL verdicts don't count, none gives NULL.

    Statements of the reference answer held against the contexts give context recall, those of the answer faithfulness.
    """
    return verdicts.groupBy(by).agg(F.round(F.avg(F.col(covered).cast("int")), 6).alias(name))


def answer_correctness(verdicts: DataFrame, by: str = "qa_id", verdict: str = "verdict", similarity: str = "similarity", weight: float = 0.75) -> DataFrame:
    """(by, answer_correctness): F1 over statements judged TP, FP or FN, and similarity of answer and reference, weighted."""
    n = lambda v: F.count_if(F.col(verdict) == v)
    f1 = F.coalesce(F.try_divide(n("TP").cast("double"), n("TP") + 0.5 * (n("FP") + n("FN"))), F.lit(0.0))
    return verdicts.groupBy(by).agg(F.round(weight * f1 + (1 - weight) * F.coalesce(F.first(similarity, ignorenulls=True), F.lit(0.0)), 6).alias("answer_correctness"))


def answer_relevancy(generated: DataFrame, by: str = "qa_id", similarity: str = "similarity", evasive: str = "evasive") -> DataFrame:
    """(by, answer_relevancy): mean similarity of questions made from the answer to the asked one; 0 if all are evasive."""
    return generated.groupBy(by).agg(F.round(F.when(F.min(F.col(evasive).cast("int")) == 1, F.lit(0.0)).otherwise(F.avg(similarity)), 6).alias("answer_relevancy"))


def dataset_summary(samples: DataFrame) -> DataFrame:
    """(scene, n, mean_answer_chars, retried) of each scene and, as scene NULL, of all; a NULL scene counts as unknown."""
    aggs = [F.count(F.lit(1)).alias("n"), F.round(F.avg("answer_chars"), 4).alias("mean_answer_chars"), F.count_if(F.col("rewrite_attempts") > 1).alias("retried")]
    return samples.withColumn("scene", F.coalesce("scene", F.lit("unknown"))).rollup("scene").agg(*aggs)


def verdict_metrics(verdicts: DataFrame, by: str = "query_id", rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """(by, context_precision, hit_rate): rank-weighted precision over given relevance verdicts, and their mean."""
    w = Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col(relevant).cast("int")
    at = verdicts.withColumn("p", F.sum(hit).over(w) / F.count(F.lit(1)).over(w))
    return at.groupBy(by).agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("p") * hit), F.sum(hit)), F.lit(0.0)), 6).alias("context_precision"), F.round(F.avg(hit), 6).alias("hit_rate"))
