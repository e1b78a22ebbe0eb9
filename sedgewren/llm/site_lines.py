"""Lines repeated across one source's documents (problem 5).

Each line's documents are kept as a compressed bitmap per source: only the non-zero 64-bit words are stored, one row each, so
a line that stands in one document costs one word and a line that stands in all of them costs a bit for each. Raw lines which
differ in white space or zero-width characters are variants of one content; the union of their bitmaps is a bitwise OR, which
Spark combines before the shuffle. Exact cardinalities are sums of bit counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.session import small, written

# Section headings of a case, which are never furniture.
HEADINGS = ["【案件基本信息】", "【基本案情】", "【案件焦点】", "【法院裁判要旨】", "【法官后语】"]

BLANKS = r"(?U)[\s\x{200B}-\x{200F}\x{2060}\x{FEFF}]+"


def line_content(line: Column) -> Column:
    """What is compared of a line: all but white space and zero-width characters."""
    return F.regexp_replace(line, BLANKS, "")


def lines_of(docs: DataFrame, id_col: str, text_col: str, source_col: str, min_chars: int) -> DataFrame:
    """Rows (id, source, line_no from 1, k1, k2) of each line that can count; k1 and k2 identify its content."""
    content = line_content(F.col("l"))
    return (
        docs.where(F.col(text_col).isNotNull() & F.col(source_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.posexplode(F.split(F.col(text_col), "\n")).alias("p", "l"))
        .select("id", "source", (F.col("p") + 1).alias("line_no"), content.alias("c"))
        .where((F.length("c") >= min_chars) & ~F.col("c").isin(HEADINGS))
        .select("id", "source", "line_no", F.xxhash64("c").alias("k1"), F.hash("c").alias("k2"))
    )


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """Compressed bitmaps: (source, k1, k2, word, bits), the union over all variants of a line's content."""
    word, bit = F.shiftright("id", 6), F.expr("shiftleft(1L, cast(id & 63 AS INT))")
    return lines.select("source", "k1", "k2", word.alias("word"), bit.alias("b")).groupBy("source", "k1", "k2", "word").agg(F.bit_or("b").alias("bits"))


def repeated_lines(
    docs: DataFrame,
    id_col: str = "id",
    text_col: str = "text_content",
    source_col: str = "source",
    min_share: float = 0.2,
    min_docs: int = 5,
    min_chars: int = 4,
) -> DataFrame:
    """(id, line_no) of each line whose content stands in at least ``min_share`` of its source's documents and in ``min_docs``.

    ``id_col`` must be a unique non-negative integer. All documents of a source count for the share, those without text too.
    Documents with NULL source or text have no repeated line. Empty input gives no rows; other columns are ignored.
    """
    docs = docs.select(id_col, text_col, source_col)
    lines = written(lines_of(docs, id_col, text_col, source_col, min_chars))  # texts are split and hashed once
    bitmaps = line_bitmaps(lines)
    sizes = docs.where(F.col(source_col).isNotNull()).groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("docs"))
    counted = bitmaps.groupBy("source", "k1", "k2").agg(F.sum(F.bit_count("bits")).alias("n")).where(F.col("n") >= min_docs)
    # a source has at most as many such lines as a document has on average over ``min_share``; they are counted before they are sent
    # to all tasks, so that the occurrences of one line are not brought together
    kept = small(written(counted.join(sizes, "source").where(F.col("n") >= F.col("docs") * F.lit(min_share)).select("source", "k1", "k2")))
    lookup = bitmaps.join(kept, ["source", "k1", "k2"], "left_semi")
    return (
        lines.join(kept, ["source", "k1", "k2"], "left_semi")
        .withColumn("word", F.shiftright("id", 6))
        .join(lookup, ["source", "k1", "k2", "word"])
        .where(F.expr("(shiftrightunsigned(bits, cast(id & 63 AS INT)) & 1L) = 1L"))
        .select("id", "line_no")
    )


def strip_repeated_lines(docs: DataFrame, id_col: str = "id", text_col: str = "text_content", source_col: str = "source", **limits) -> DataFrame:
    """(id_col, text_col, removed_lines): every document, with its repeated lines taken out and the rest left as it is.

    NULL text stays NULL with 0 lines removed; a text made only of repeated lines becomes ''.
    """
    found = repeated_lines(docs, id_col, text_col, source_col, **limits).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(found, "id", "left")
    kept = F.expr("array_join(filter(split(t, '\n'), (l, i) -> gone IS NULL OR NOT array_contains(gone, i + 1)), '\n')")
    return left.select(F.col("id").alias(id_col), kept.alias(text_col), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))
