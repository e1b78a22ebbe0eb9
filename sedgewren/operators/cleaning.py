"""Line-based cleaning of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.functions.text import HEADER_LINES, PAGE_NUMBER, bound, compact_line, is_noise_line, normalize_text, strip


def document_lines(docs: DataFrame, id_col: str, text_col: str, normalize: bool = True) -> DataFrame:
    """(id, pos from 0, line) of every line; NULL texts have none."""
    text = normalize_text(F.col(text_col)) if normalize else F.col(text_col)
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def repeated_head_lines(lines: DataFrame, min_repeat: int = 6, max_len: int = 30) -> DataFrame:
    """(id, key): short lines without sentence marks that recur in a document and stand beside a page number."""
    key = compact_line(F.col("line"))
    near = Window.partitionBy("id").orderBy("pos")
    number = strip(F.col("line")).rlike(PAGE_NUMBER)
    marked = lines.select("id", "pos", key.alias("key"), number.alias("n"))
    marked = marked.withColumn("beside", F.col("n") | F.coalesce(F.lag("n").over(near), F.lit(False)) | F.coalesce(F.lead("n").over(near), F.lit(False)))
    fits = (F.length("key") > 0) & (F.length("key") <= max_len) & ~F.col("key").rlike(r"(?U)^\d") & ~F.col("key").rlike("[。，；：！？]")
    return marked.where(fits).groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"), F.max("beside").alias("beside")).where((F.col("n") >= min_repeat) & F.col("beside")).select("id", "key")


def clean_text(docs: DataFrame, id_col: str, text_col: str, min_repeat: int = 6, max_len: int = 30, patterns: tuple[str, ...] = (), self_repeat: int = 0) -> DataFrame:
    """(id, text): normalised text without noise lines, lines that match ``patterns``, and recurring heads.

    Runs of blank lines become one. With ``self_repeat`` the result is searched once more for heads that recur so often. A
    document stays in its row, so nothing is shuffled. NULL texts are left out.
    """
    lines = F.transform(F.split(normalize_text(F.col(text_col)), "\n"), lambda x: _marked(x, max_len, patterns))
    text = bound(lines, lambda x: _without(x, bound(x, lambda y: _heads(y, min_repeat)), True))
    if self_repeat:
        again = F.transform(F.split(text, "\n"), lambda x: _marked(x, 40, ()))
        text = bound(again, lambda x: _without(x, bound(x, lambda y: _heads(y, self_repeat)), False))
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), strip(F.regexp_replace(text, r"\n{2,}", "\n\n")).alias("text"))


def _marked(line: Column, max_len: int, patterns: tuple[str, ...]) -> Column:
    """A line with what decides on it: whether it is noise, a page number, may be a head."""
    s, key = strip(line), compact_line(line)
    noise = is_noise_line(line)
    for p in patterns:
        noise = noise | s.rlike(p)
    fits = (F.length(key) > 0) & (F.length(key) <= max_len) & ~key.rlike(r"(?U)^\d") & ~key.rlike("[。，；：！？]")
    return F.struct(s.alias("s"), key.alias("key"), ((s != "") & noise).alias("noise"), s.rlike(PAGE_NUMBER).alias("n"), fits.alias("fits"))


def _heads(lines: Column, min_repeat: int) -> Column:
    """Keys of fitting lines that recur ``min_repeat`` times, at least once beside a page number; linear after a sort."""
    number = lambda i: F.coalesce(F.get(lines, i)["n"], F.lit(False))
    fit = F.filter(F.transform(lines, lambda x, i: F.when(x["fits"], F.struct(x["key"].alias("key"), (x["n"] | number(i - 1) | number(i + 1)).alias("beside")))), lambda x: x.isNotNull())

    def runs(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda x, i: F.when(~x["key"].eqNullSafe(F.get(s, i + 1)["key"]), i)), lambda i: i.isNotNull())
        # the last of a run tells whether any of it stands beside a number
        often = lambda e: bound(e, lambda at: F.filter(F.transform(at, lambda p, k: F.when((p - F.coalesce(F.get(at, k - 1), F.lit(-1)) >= min_repeat) & F.get(s, p)["beside"], F.get(s, p)["key"])), lambda x: x.isNotNull()))
        return often(ends)

    return bound(F.array_sort(fit), runs)


def _without(lines: Column, heads: Column, noise: bool) -> Column:
    gone = lambda x, h: F.array_contains(h, x["key"]) if not noise else x["noise"] | F.array_contains(h, x["key"])
    return bound(heads, lambda h: F.array_join(F.transform(F.filter(lines, lambda x: ~gone(x, h)), lambda x: x["s"]), "\n"))


def law_names(lines: DataFrame, first: int = 30, pattern: str = r"^.{2,40}(?:法|条例|办法|规定|细则)$") -> DataFrame:
    """(id, law_name): the first of the first lines that reads like a title; documents without one are left out."""
    s = strip(F.col("line"))
    return lines.where((F.col("pos") < first) & s.rlike(pattern)).groupBy("id").agg(F.min_by(s, F.col("pos")).alias("law_name"))


def named_laws(docs: DataFrame, id_col: str, text_col: str, source_col: str, first: int = 30) -> DataFrame:
    """(id, law_name) of every document: its title, else the stem of its file name; NULL if it has neither."""
    found = law_names(document_lines(docs, id_col, text_col, normalize=False), first)
    stem = F.regexp_replace(F.regexp_replace(F.col(source_col), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return docs.select(F.col(id_col).alias("id"), stem.alias("_stem")).join(found, "id", "left").select("id", F.coalesce("law_name", "_stem").alias("law_name"))


__all__ = ["HEADER_LINES", "clean_text", "document_lines", "law_names", "named_laws", "repeated_head_lines"]
