"""Queries of the training-data operators, by name; each takes the session and a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.site_lines import repeated_lines

    return repeated_lines(table(spark, folder, "law_chunk")).select(F.col("id").cast("int").alias("chunk_id"), F.col("line_no").cast("int").alias("line_no"))


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.site_lines import strip_repeated_lines

    return strip_repeated_lines(table(spark, folder, "law_chunk"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.packing import packed_all
    from sedgewren.llm.tokens import token_count

    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), token_count(F.col("text")).alias("tokens"))
    return packed_all(docs, table(spark, folder, "container_size")).withColumnRenamed("key", "doc_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.packing import packing_report

    return packing_report(p8_containers(spark, folder))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.tokens import token_count

    wanted = table(spark, folder, "mix_target").select("source").distinct()
    docs = table(spark, folder, "documents").select("doc_id", "source", "text").join(F.broadcast(wanted), "source", "left_semi")
    return docs.select(F.col("doc_id").alias("key"), "source", token_count(F.col("text")).alias("tokens"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.mixing import mixed, mixing_plan
    from sedgewren.session import written

    sized = written(_sized(spark, folder))
    return mixed(sized, mixing_plan(sized, table(spark, folder, "mix_target"))).select(F.col("key").alias("doc_id"), "source", "tokens", "copies")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.mixing import mix_report, mixed, mixing_plan
    from sedgewren.session import written

    sized = written(_sized(spark, folder))
    plan = written(mixing_plan(sized, table(spark, folder, "mix_target")))
    return mix_report(mixed(sized, plan), plan)


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.page_noise import page_model, repaired

    chunks = table(spark, folder, "law_chunk")
    return repaired(chunks, page_model(chunks))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_repaired(spark, folder).select(F.col("id").cast("int").alias("chunk_id"), F.explode("noise_kinds").alias("noise_kind"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.near_pairs import near_pairs

    return near_pairs(table(spark, folder, "law_qa"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.near_pairs import near_groups

    return near_groups(table(spark, folder, "law_qa"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.pair_defects import pair_defects

    return pair_defects(table(spark, folder, "law_qa"))


def _personal_model(spark: SparkSession, folder: str):
    from sedgewren.llm.personal import personal_model

    qa, chunk = table(spark, folder, "law_qa"), table(spark, folder, "law_chunk")
    return personal_model([qa.select("question"), qa.select("answer"), chunk.select("text_content")])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.personal import personal_spans

    model, out = _personal_model(spark, folder), None
    for name, field in (("law_qa", "question"), ("law_qa", "answer"), ("law_chunk", "text_content")):
        found = personal_spans(table(spark, folder, name), model, field)
        found = found.select(F.lit(name).alias("table_name"), F.col("row_id").cast("int").alias("row_id"), F.lit(field).alias("field_name"), "pii_type", "start_pos")
        out = found if out is None else out.unionByName(found)
    return out


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.personal import redacted

    model = _personal_model(spark, folder)
    qa, chunk = redacted(table(spark, folder, "law_qa"), model, ["question", "answer"]), redacted(table(spark, folder, "law_chunk"), model, ["text_content"])
    return qa.selectExpr("'law_qa' AS table_name", "id", "question", "answer", "CAST(NULL AS STRING) AS text_content").unionByName(
        chunk.selectExpr("'law_chunk' AS table_name", "id", "CAST(NULL AS STRING) AS question", "CAST(NULL AS STRING) AS answer", "text_content")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.split_overlap import cross_split_overlaps

    return cross_split_overlaps(table(spark, folder, "raw")).select("row_a", "row_b")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.split_overlap import overlap_report

    return overlap_report(table(spark, folder, "raw"))


def p6_members(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.split_overlap import overlap_members

    return overlap_members(table(spark, folder, "raw"))


def p7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.neighbours import nearest

    both = [nearest(table(spark, folder, t)).select(F.lit(t).alias("collection"), "id", "neighbour", F.round("similarity", 5).alias("similarity"), "rank") for t in ("law_cases", "law_clause")]
    return both[0].unionByName(both[1])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.neighbours import nearest

    both = [nearest(table(spark, folder, t)).select(F.lit(t).alias("collection"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")) for t in ("law_cases", "law_clause")]
    return both[0].unionByName(both[1]).distinct()


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.language import fit_language_model, languages

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    codes = sorted(r["lang_code"] for r in table(spark, folder, "lang_code").collect())
    return languages(docs, fit_language_model(docs, codes))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    from sedgewren.llm.language import label_errors

    return label_errors(_languages(spark, folder))


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    return _languages(spark, folder).select("doc_id", "segment_no", "lang_code", F.round("confidence", 6).alias("confidence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_groups, p3_found, p4_found, p4_redacted, p5_found, p5_clean, p6_found, p6_report, p6_members, p7_found, p7_neighbours, p8_containers, p8_report, p9_mix, p9_shares, p10_found, p10_languages)}
