"""Text functions as native columns; lengths and classes are by Unicode code point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters without width, line patterns that mark page furniture, labels before a rewrite.
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
PAGE_MARKER = r"(?iU)^[\s=\-*_#.]*(?:page\s*\(?\d+\)?|第\s*\d+\s*页)[\s=\-*_#.]*$"
PAGE_NUMBER = r"(?U)^\d{1,4}$"
FOOTNOTE = r"(?U)^[①-⑳]\s*$"
HEADER_LINES = [r"^中国法院[0-9]{4}年度案例", r"(?U)^\d{4}\s*年\s*\d{1,2}\s*月$", r"(?U)^目\s*录$", r"^图书在版编目"]
ANSWER_LABELS = ["改写后", "改写结果", "答案"]
CN_NUMERALS = "零〇一二三四五六七八九十百千两"
LEVEL_HEADING = rf"(?U)^第[{CN_NUMERALS}]+([编章节])(?:\s*(.*))?$"
ARTICLE_START = rf"(?U)^(第[{CN_NUMERALS}]+条)(?:\s*(.*))?$"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Unix line ends, no zero-width characters, single spaces, stripped lines, at most one blank line; NULL stays NULL."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), ZERO_WIDTH, "")
    c = F.regexp_replace(F.translate(c, "　\t", "  "), " {2,}", " ")
    c = F.regexp_replace(c, r"(?mU)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    return strip(F.regexp_replace(c, r"\n{2,}", "\n\n"))


def compact_line(c: Column) -> Column:
    """Without any white space; also the key under which answers are cached."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def is_block_noise_line(c: Column) -> Column:
    """Blank line, page marker, lone footnote sign or fixed header."""
    s = strip(c)
    out = (s == "") | s.rlike(PAGE_MARKER) | s.rlike(FOOTNOTE)
    for p in HEADER_LINES:
        out = out | s.rlike(p)
    return out


def is_noise_line(c: Column) -> Column:
    """As ``is_block_noise_line``, and lines of one to four digits."""
    return is_block_noise_line(c) | strip(c).rlike(PAGE_NUMBER)


def heading_level(c: Column, max_len: int = 40) -> Column:
    """编, 章 or 节 of a heading line, '' for any other line."""
    s = strip(c)
    return F.when(F.length(s) <= max_len, F.regexp_extract(s, LEVEL_HEADING, 1)).otherwise("")


def classifier_text(c: Column) -> Column:
    """Stripped, without question marks at the end."""
    return strip(F.regexp_replace(strip(c), r"[?？]+$", ""))


def truncated(c: Column, n: int, mark: str = "…（已截断）") -> Column:
    """The text, or its first ``n`` characters and a mark."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def split_queries(c: Column) -> Column:
    """Non-empty stripped lines."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def sentences(c: Column, min_chars: int = 2) -> Column:
    """Stripped sentences; each keeps its final mark."""
    parts = F.transform(F.split(c, "(?<=[。！？；!?;\n])"), strip)
    return F.filter(parts, lambda x: F.length(x) >= min_chars)


def bound(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a column named twice in a higher-order function is computed each time."""
    return F.transform(F.array(c), body)[0]


def char_ngrams(c: Column, n: int) -> Column:
    """All sequences of ``n`` characters; a shorter text is its own only one. Linear in the length of the text."""

    def grams(ch: Column) -> Column:
        count = F.greatest(F.size(ch) - (n - 1), F.lit(1))
        out = F.slice(ch, 1, count)
        for k in range(1, n):
            out = F.zip_with(out, F.slice(ch, k + 1, count), lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
        return out

    return F.when(F.length(c) == 0, F.array(F.lit(""))).otherwise(bound(F.split(c, ""), grams))


def tokens(c: Column, mode: str = "char_bigram") -> Column:
    """Tokens of a text: ``word`` (runs of letters and digits) or ``char_bigram`` (over compact lower-case text)."""
    if mode == "word":
        return F.filter(F.split(F.lower(c), r"(?U)[^\p{L}\p{Nd}]+"), lambda x: x != "")
    if mode != "char_bigram":
        raise ValueError(f"unknown tokenizer mode {mode!r}")
    return bound(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{Nd}]+", ""), lambda f: F.filter(char_ngrams(f, 2), lambda x: x != ""))


def rewrite_cleaned(c: Column) -> Column:
    """A model's rewrite without answer label and outer double quotes."""
    s = F.regexp_replace(strip(c), rf"(?U)^(?:{'|'.join(ANSWER_LABELS)})[:：]\s*", "")
    return F.regexp_replace(strip(s), r'^["“”]+|["“”]+$', "")


def rewrite_limit(c: Column, least: int = 60, factor: float = 1.2, extra: int = 15) -> Column:
    """Longest allowed rewrite of a text."""
    return F.greatest(F.lit(least), F.floor(F.length(c) * factor).cast("int") + extra)


def longest_common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring, by dynamic programming over characters."""
    left, right = F.split(a, ""), F.split(b, "")

    def row(acc: Column, ch: Column) -> Column:
        line = F.transform(right, lambda x, i: F.when(x == ch, F.when(i == 0, F.lit(1)).otherwise(F.element_at(acc["line"], i.cast("int")) + 1)).otherwise(F.lit(0)))
        return F.struct(line.alias("line"), F.greatest(acc["best"], F.coalesce(F.array_max(line), F.lit(0))).alias("best"))

    start = F.struct(F.transform(right, lambda x: F.lit(0)).alias("line"), F.lit(0).alias("best"))
    out = F.aggregate(left, start, row, lambda acc: acc["best"])
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(out)


def resolved_question(original: Column, resolved: Column, factor: int = 5, extra: int = 30) -> Column:
    """The resolved question if it is one non-empty line of sensible length, else the original."""
    s = strip(resolved)
    good = (s != "") & (F.length(s) <= F.length(original) * factor + extra) & ~s.contains("\n")
    return F.when(F.coalesce(good, F.lit(False)), s).otherwise(original)


def route_label(c: Column) -> Column:
    """One of the four retrieval routes; anything else is direct."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("direct", "hyde", "subquery", "recall"), s).otherwise("direct")


def score_text(c: Column) -> Column:
    """Score with four decimals, N/A for NULL or NaN."""
    return F.when(c.isNull() | F.isnan(c), "N/A").otherwise(F.format_string("%.4f", c))


def score_hint(c: Column) -> Column:
    """low below 0.5, high from 0.7, else middle; NULL stays NULL."""
    return F.when(c < 0.5, "low").when(c >= 0.7, "high").when(c.isNotNull(), "middle")


def vector_id(id_: Column, number: Column) -> Column:
    """Deterministic id of a chunk in the vector tables."""
    return F.md5(F.concat(id_.cast("string"), F.lit("_"), F.coalesce(number, F.lit(""))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; negatives and zero norms give 0."""
    d = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(d(a, a)) * F.sqrt(d(b, b))
    return F.greatest(F.lit(0.0), d(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm))
