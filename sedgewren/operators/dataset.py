"""Selection, sampling, splitting and checks of question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewren.functions.text import longest_common_substring, rewrite_limit, strip
from sedgewren.session import small

# Patterns of personal data that keep a pair out of a question set, and greetings.
PERSONAL = [r"1[3-9][0-9]{9}", r"[0-9]{17}[0-9Xx]", r"[\x{4E00}-\x{9FA5}]{2,4}(?:先生|女士|同志)"]
GREETINGS = ["你好", "您好", "请问", "麻烦", "咨询", "想问", "请教", "打扰", "谢谢", "多谢", "辛苦", "嗨", "哈喽", "在吗"]


def length_between(c: Column, low: int, high: int | None = None) -> Column:
    ok = F.length(c) >= low
    return ok if high is None else ok & (F.length(c) <= high)


def has_personal_data(*columns: Column) -> Column:
    """Whether the texts, joined by line breaks, match a pattern of personal data."""
    text = F.concat_ws("\n", *columns)
    out = F.lit(False)
    for p in PERSONAL:
        out = out | text.rlike(p)
    return out


def contains_any(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def count_of(c: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)))


def scene_filter(question: Column, wanted: list[str], unwanted: list[str]) -> Column:
    """Why a question is left out: ``procedure`` words come first, then missing ``scene`` words; '' keeps it."""
    return F.when(contains_any(question, unwanted), "procedure").when(~contains_any(question, wanted), "scene").otherwise("")


def scene_of(question: Column, everyday: list[str], professional: list[str]) -> Column:
    """everyday if more of its hints occur, else professional."""
    return F.when(count_of(question, everyday) > count_of(question, professional), "everyday").otherwise("professional")


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement in the order of a seeded hash; all rows if there are fewer."""
    return rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}_"), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def feature_key(text: Column, label: Column) -> Column:
    """Stratum of a labelled text: label, length band, greeting, first person."""
    band = F.when(F.length(text) <= 6, "xs").when(F.length(text) <= 15, "s").when(F.length(text) > 40, "l").otherwise("m")
    greets = F.when(contains_any(text, GREETINGS), "G").otherwise("g")
    person = F.when(F.contains(F.left(text, F.lit(10)), F.lit("我")), "P").otherwise("p")
    return F.concat_ws("_", label.cast("string"), band, greets, person)


def stratified_split(rows: DataFrame, text: str = "text", label: str = "label", seed: int = 42, least: int = 10) -> DataFrame:
    """Rows with ``part`` train, dev or test, 8:1:1 within each stratum; strata below ``least`` are pooled by label.

    Dev and test get max(1, a tenth rounded half to even) each; with one row it goes to test. Order is a seeded hash of the
    text; texts are expected to be distinct. No stratum is sorted: the hash's first digits are counted, and only the rows of the
    buckets in which a part ends are ranked.
    """
    keyed = rows.withColumn("_k", feature_key(F.col(text), F.col(label)))
    size = keyed.groupBy("_k", F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each stratum, at most 32 and their pools
    name = F.when(F.col("_n") < least, F.concat(F.lit("pool_"), F.col("_l").cast("string"))).otherwise(F.col("_k"))
    pooled = keyed.join(F.broadcast(size.select("_k", name.alias("stratum"))), "_k").drop("_k")
    order = F.md5(F.concat(F.lit(f"{seed}_"), F.col(text)))
    pooled = pooled.withColumn("_h", order).withColumn("_b", F.conv(F.left("_h", F.lit(3)), 16, 10).cast("int"))
    bucket = pooled.groupBy("stratum", "_b").agg(F.count(F.lit(1)).alias("_c"))
    up = Window.partitionBy("stratum").orderBy("_b")
    bucket = bucket.withColumn("_upto", F.sum("_c").over(up)).withColumn("_n", F.sum("_c").over(Window.partitionBy("stratum")))
    tenth = F.greatest(F.lit(1), F.bround(F.col("_n") * 0.1).cast("int"))
    part = lambda r: F.when(r > F.col("_n") - tenth, "test").when(r > F.col("_n") - 2 * tenth, "dev").otherwise("train")
    first, last = part(F.col("_upto") - F.col("_c") + 1), part(F.col("_upto"))
    bucket = bucket.select("stratum", "_b", (F.col("_upto") - F.col("_c")).alias("_before"), "_n", F.when(first == last, last).alias("part"))
    # at most 4,096 buckets for each stratum
    placed = pooled.join(F.broadcast(bucket), ["stratum", "_b"])
    rank = F.row_number().over(Window.partitionBy("stratum", "_b").orderBy("_h", text)) + F.col("_before")
    edge = placed.where("part IS NULL").withColumn("part", part(rank))
    return placed.where("part IS NOT NULL").unionByName(edge).drop("_b", "_h", "_before", "_n")


def rewrite_problem(original: Column, rewrite: Column, least: int = 8, longest_copy: int = 14, copy_share: float = 0.7) -> Column:
    """The first reason why a rewrite is refused, '' if it is good."""
    s = F.regexp_replace(F.coalesce(rewrite, F.lit("")), r"^[\"'“”‘’「」\s]+|[\"'“”‘’「」\s]+$", "")
    same = longest_common_substring(original, s)
    return (
        F.when(F.length(s) < least, "too_short")
        .when(F.length(s) > rewrite_limit(original), "too_long")
        .when(same > longest_copy, "copied")
        .when(F.coalesce(F.try_divide(same, F.length(original)), F.lit(0.0)) > copy_share, "copied_share")
        .otherwise("")
    )


def evaluable(runs: DataFrame, stage: str = "hybrid") -> DataFrame:
    """Runs that can be judged: answered by retrieval, with contexts and an answer that is not blank."""
    return runs.where((F.col("hit_stage") == stage) & (F.size("contexts") > 0) & (strip(F.coalesce("answer", F.lit(""))) != ""))


def metric_columns(runs: DataFrame) -> DataFrame:
    """Judge input under its present and its former column names, side by side."""
    names = {"user_input": "eval_question", "response": "answer", "retrieved_contexts": "contexts", "reference": "ground_truth", "question": "eval_question"}
    return runs.withColumns({new: F.col(old) for new, old in names.items()})


def chosen(runs: DataFrame, key: str, wanted: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The runs of the wanted keys, if any are named, and of these the first ``most`` by key."""
    out = runs if wanted is None else runs.join(small(wanted.select(key).distinct()), key, "left_semi")
    return out if most is None else out.orderBy(key).limit(most)


def count_guard(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(table_name, before, after, same): whether a run left the number of rows of each table as it was."""
    parts = [before.agg(F.count(F.lit(1)).alias("before")).join(after.agg(F.count(F.lit(1)).alias("after"))).select(F.lit(n).alias("table_name"), "before", "after") for n, (before, after) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("same", F.col("before") == F.col("after"))
