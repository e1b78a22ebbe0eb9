"""Sinks: JSON lines, keyed upserts, expiring caches and the Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.functions.text import compact_line


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_if_empty(rows: DataFrame, path: str) -> bool:
    """Write a table only if nothing stands at ``path``; returns whether it was written."""
    spark = rows.sparkSession
    try:
        if not spark.read.parquet(path).isEmpty():
            return False
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows.write.mode("overwrite").parquet(path)
    return True


def cache_rows(answers: DataFrame, question: str = "question", answer: str = "answer", at: str = "written_at") -> DataFrame:
    """(key, value, written_at) of answers to be cached; blank answers are not cached, and of equal keys the last is."""
    rows = answers.where(F.length(F.trim(answer)) > 0).select(compact_line(F.col(question)).alias("key"), F.to_json(F.struct(F.col(answer).alias("answer"))).alias("value"), F.col(at).alias("written_at"))
    return rows.groupBy("key").agg(F.max_by("value", "written_at").alias("value"), F.max("written_at").alias("written_at"))


def cached_answers(cache: DataFrame) -> DataFrame:
    """(key, answer, written_at) of cache rows; a value that is no such object gives a NULL answer."""
    return cache.select("key", F.from_json("value", "answer string")["answer"].alias("answer"), "written_at")


def live_cache(cache: DataFrame, now, ttl_seconds: int = 3600) -> DataFrame:
    """Entries that have not expired at ``now``; reading does not renew them."""
    return cache.where(F.col("written_at").cast("timestamp").cast("double") > F.lit(now).cast("timestamp").cast("double") - ttl_seconds)


def bucketed_postings(postings: DataFrame, name: str, buckets: int = 64) -> None:
    """Postings as a table bucketed by term, so that later joins on the term don't shuffle them."""
    postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(name)


def markdown_report(title: str, sections: list[tuple[str, DataFrame]], most: int = 200) -> str:
    """Small aggregates as Markdown tables; a section over ``most`` rows is refused, as a report is for reading."""
    out = [f"# {title}", ""]
    for name, df in sections:
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"section {name!r} has more than {most} rows")
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("N/A" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]
        out.append("")
    return "\n".join(out)
