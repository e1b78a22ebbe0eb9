"""All queries of the core over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewren.functions import text as T
from sedgewren.operators import chunking, cleaning, dataset, dedup, dialog, metrics, models, prompts, retrieval
from sedgewren.plans.cascade import cascade
from sedgewren.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# white space as the native functions understand it, for the SQL side
_S = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_STRIP = f"regexp_replace(%s, '^[{_S}]+|[{_S}]+$', '', 'g')"
_COMPACT = f"regexp_replace(%s, '[{_S}]+', '', 'g')"
_TOKENS = r"regexp_replace(lower(%s), '[^\p{L}\p{Nd}]+', '', 'g')"
_BIGRAMS = "list_transform(range(1, greatest(length(%s) - 1, 1) + 1), lambda i: substr(%s, i, 2))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def strip_sql(x: str) -> str:
    return _STRIP % x


def normalize_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g')"
    x = f"regexp_replace(translate({x}, chr(12288) || chr(9), '  '), ' {{2,}}', ' ', 'g')"
    within = _S.replace(r"\t-\r ", r"\t\x{0B}-\r ")
    x = f"regexp_replace({x}, '(?m)^[{within}]+|[{within}]+$', '', 'g')"
    return strip_sql(rf"regexp_replace({x}, '\n{{2,}}', chr(10) || chr(10), 'g')")


# --- text functions -------------------------------------------------------------------------------------------------


@query(f"SELECT id, {normalize_sql('text_content')} AS text FROM law_chunk")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_chunk").select("id", T.normalize_text(F.col("text_content")).alias("text"))


_LINES = "SELECT id, unnest(range(0, len(string_split(text_content, chr(10))))) AS pos, unnest(string_split(text_content, chr(10))) AS line FROM law_chunk WHERE text_content IS NOT NULL"
_NOISE = rf"""(s = '' OR regexp_matches(s, '(?i)^[{_S}=\-*_#.]*(page[{_S}]*\(?\p{{Nd}}+\)?|第[{_S}]*\p{{Nd}}+[{_S}]*页)[{_S}=\-*_#.]*$') OR regexp_matches(s, '^[①-⑳][{_S}]*$')
  OR regexp_matches(s, '^中国法院[0-9]{{4}}年度案例') OR regexp_matches(s, '^\p{{Nd}}{{4}}[{_S}]*年[{_S}]*\p{{Nd}}{{1,2}}[{_S}]*月$') OR regexp_matches(s, '^目[{_S}]*录$') OR regexp_matches(s, '^图书在版编目'))"""


@query(
    f"""WITH l AS ({_LINES}), t AS (SELECT id, pos, {strip_sql('line')} AS s, line FROM l)
SELECT id, CAST(pos AS INTEGER) AS pos, {_NOISE} AS block_noise, {_NOISE} OR regexp_matches(s, '^\\p{{Nd}}{{1,4}}$') AS noise, {_COMPACT % 'line'} AS compact FROM t"""
)
def text_noise_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = cleaning.document_lines(table(spark, d, "law_chunk"), "id", "text_content", normalize=False)
    line = F.col("line")
    return lines.select("id", "pos", T.is_block_noise_line(line).alias("block_noise"), T.is_noise_line(line).alias("noise"), T.compact_line(line).alias("compact"))


@query(
    f"""WITH l AS ({_LINES}), t AS (SELECT *, {_COMPACT % 'line'} AS key, regexp_matches({strip_sql('line')}, '^\\p{{Nd}}{{1,4}}$') AS n FROM l),
x AS (SELECT *, n OR coalesce(lag(n) OVER w, false) OR coalesce(lead(n) OVER w, false) AS beside FROM t WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, key FROM x WHERE length(key) BETWEEN 1 AND 30 AND NOT regexp_matches(key, '^\\p{{Nd}}') AND NOT regexp_matches(key, '[。，；：！？]')
GROUP BY id, key HAVING count(*) >= 1 AND bool_or(beside)"""
)
def text_repeated_heads(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.repeated_head_lines(cleaning.document_lines(table(spark, d, "law_chunk"), "id", "text_content", normalize=False), min_repeat=1)


@query(
    f"""WITH n AS (SELECT id, {normalize_sql('text_content')} AS t FROM law_chunk WHERE text_content IS NOT NULL),
l AS (SELECT id, unnest(range(0, len(string_split(t, chr(10))))) AS pos, unnest(string_split(t, chr(10))) AS line FROM n),
t AS (SELECT *, {strip_sql('line')} AS s, {_COMPACT % 'line'} AS key, regexp_matches({strip_sql('line')}, '^\\p{{Nd}}{{1,4}}$') AS n FROM l),
x AS (SELECT *, n OR coalesce(lag(n) OVER w, false) OR coalesce(lead(n) OVER w, false) AS beside FROM t WINDOW w AS (PARTITION BY id ORDER BY pos)),
h AS (SELECT id, key FROM x WHERE length(key) BETWEEN 1 AND 30 AND NOT regexp_matches(key, '^\\p{{Nd}}') AND NOT regexp_matches(key, '[。，；：！？]') GROUP BY id, key HAVING count(*) >= 2 AND bool_or(beside)),
k AS (SELECT id, string_agg(s, chr(10) ORDER BY pos) AS t FROM x WHERE (s = '' OR NOT ({_NOISE} OR n)) AND NOT EXISTS (SELECT 1 FROM h WHERE h.id = x.id AND h.key = x.key) GROUP BY id)
SELECT n.id, coalesce({strip_sql("regexp_replace(k.t, '[\n]{2,}', chr(10) || chr(10), 'g')")}, '') AS text FROM n LEFT JOIN k ON n.id = k.id"""
)
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_text(table(spark, d, "law_chunk"), "id", "text_content", min_repeat=2)


@query(
    f"""WITH l AS ({_LINES}), t AS (SELECT id, pos, {strip_sql('line')} AS s FROM l)
SELECT id, arg_min(s, pos) AS law_name FROM t WHERE pos < 30 AND regexp_matches(s, '^.{{2,40}}(法|条例|办法|规定|细则)$') GROUP BY id"""
)
def text_law_names(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.law_names(cleaning.document_lines(table(spark, d, "law_chunk"), "id", "text_content", normalize=False))


@query(
    f"""WITH l AS ({_LINES}), t AS (SELECT id, pos, {strip_sql('line')} AS s FROM l)
SELECT id, CAST(pos AS INTEGER) AS pos, CASE WHEN length(s) <= 40 THEN regexp_extract(s, '^第[零〇一二三四五六七八九十百千两]+([编章节])([{_S}]*(.*))?$', 1) ELSE '' END AS level,
       regexp_extract(s, '^(第[零〇一二三四五六七八九十百千两]+条)', 1) AS article_no FROM t"""
)
def text_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = cleaning.document_lines(table(spark, d, "law_chunk"), "id", "text_content", normalize=False)
    return lines.select("id", "pos", T.heading_level(F.col("line")).alias("level"), F.regexp_extract(T.strip(F.col("line")), T.ARTICLE_START, 1).alias("article_no"))


@query(f"SELECT row_id, {strip_sql('regexp_replace(' + strip_sql('text') + chr(44) + chr(39) + '[?？]+$' + chr(39) + chr(44) + chr(39) * 2 + ')')} AS text FROM raw")
def text_classifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw").select("row_id", T.classifier_text(F.col("text")).alias("text"))


@query("SELECT id, CASE WHEN length(answer) > 60 THEN left(answer, 60) || '…' ELSE answer END AS answer, CASE WHEN length(question) > 26 THEN left(question, 26) || '…' ELSE question END AS preview FROM law_qa")
def text_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_qa").select("id", T.truncated(F.col("answer"), 60, "…").alias("answer"), T.truncated(F.col("question"), 26, "…").alias("preview"))


@query(
    f"""WITH t AS (SELECT id, {_TOKENS % 'question'} AS q FROM law_qa), g AS (SELECT id, unnest({_BIGRAMS % ('q', 'q')}) AS g FROM t)
SELECT g, count(*) AS n, count(DISTINCT id) AS docs FROM g WHERE g <> '' GROUP BY g"""
)
def text_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_qa").select("id", F.explode(T.tokens(F.col("question"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("docs"))


@query(
    f"""WITH s AS (SELECT id, unnest(regexp_extract_all(answer, '[^。！？；!?;\n]*[。！？；!?;\n]|[^。！？；!?;\n]+$')) AS s FROM law_qa)
SELECT id, count(*) AS n, max(length({strip_sql('s')})) AS longest FROM s WHERE length({strip_sql('s')}) >= 2 GROUP BY id"""
)
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "law_qa").select("id", F.explode(T.sentences(F.col("answer"))).alias("s"))
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s")).alias("longest"))


@query(
    f"""SELECT id, unnest(list_filter(list_transform(string_split(text_content, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')) AS query FROM law_chunk"""
)
def text_split_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_chunk").select("id", F.explode(T.split_queries(F.col("text_content"))).alias("query"))


@query("SELECT id, CAST(greatest(60, floor(length(question) * 1.2) + 15) AS INTEGER) AS most, length(answer) BETWEEN 80 AND 400 AS fits FROM law_qa")
def text_rewrite_limits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_qa").select("id", T.rewrite_limit(F.col("question")).alias("most"), dataset.length_between(F.col("answer"), 80, 400).alias("fits"))


@query(
    """WITH p AS (SELECT id, coalesce(text_content, '') AS a, coalesce(title, '') AS b FROM law_cases), s AS (SELECT id, a, b, unnest(range(1, length(b) + 1)) AS i FROM p),
n AS (SELECT *, unnest(range(1, length(b) - i + 2)) AS n FROM s), m AS (SELECT id, max(n) AS lcs FROM n WHERE contains(a, substr(b, i, n)) GROUP BY id)
SELECT p.id, CAST(coalesce(lcs, 0) AS INTEGER) AS lcs FROM p LEFT JOIN m ON p.id = m.id"""
)
def text_common_substring(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "law_cases")
    return c.select("id", T.longest_common_substring(F.coalesce("title", F.lit("")), F.coalesce("text_content", F.lit(""))).alias("lcs"))


@query(
    """SELECT c.id AS chunk_id, v.id AS vector_id FROM law_chunk c JOIN law_clause v ON v.id = md5(c.id || '_' || coalesce(c.article_no, ''))"""
)
def text_vector_ids(spark: SparkSession, d: str) -> DataFrame:
    c, v = table(spark, d, "law_chunk"), table(spark, d, "law_clause")
    return c.select(F.col("id").alias("chunk_id"), T.vector_id(F.col("id"), F.col("article_no")).alias("vector_id")).join(v.select(F.col("id").alias("vector_id")), "vector_id").select("chunk_id", "vector_id")


@query(
    """WITH p AS (SELECT id, question, answer AS r FROM law_qa), s AS (SELECT id, question, regexp_replace(r, '^[\\t-\\r \\x{85}\\x{A0}\\x{3000}]+|[\\t-\\r \\x{85}\\x{A0}\\x{3000}]+$', '', 'g') AS s FROM p)
SELECT id, CASE WHEN s IS NOT NULL AND s <> '' AND length(s) <= length(question) * 5 + 30 AND NOT contains(s, chr(10)) THEN s ELSE question END AS resolved FROM s"""
)
def text_resolved(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_qa").select("id", T.resolved_question(F.col("question"), F.col("answer")).alias("resolved"))


@query("SELECT frame_id, CASE WHEN lower(trim(frame_type)) IN ('direct','hyde','subquery','recall') THEN lower(trim(frame_type)) ELSE 'direct' END AS route, frame_type FROM client_frame")
def text_routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "client_frame").select("frame_id", T.route_label(F.col("frame_type")).alias("route"), "frame_type")


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'N/A' ELSE printf('%.4f', value / 100) END AS score, CASE WHEN value / 100 < 0.5 THEN 'low' WHEN value / 100 >= 0.7 THEN 'high' WHEN value IS NOT NULL THEN 'middle' END AS hint FROM events")
def text_scores(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") / 100
    return table(spark, d, "events").select("event_id", T.score_text(v).alias("score"), T.score_hint(v).alias("hint"))


@query(
    """WITH c AS (SELECT id, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS i, coalesce(title, '') AS title, coalesce(source, '') AS source, coalesce(text_content, '') AS body, source AS s FROM law_clause)
SELECT s AS source, string_agg('[' || i || '] ' || title || ' ' || source || chr(10) || body, chr(10) || chr(10) ORDER BY i) AS context FROM c WHERE i < 12 GROUP BY s"""
)
def text_contexts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "law_clause").select(F.col("source").alias("query_id"), "id", "title", "source", F.col("text_content").alias("body"))
    top = retrieval.top_k(c.withColumn("score", F.lit(0)), 12, tie="id", name="n")
    return retrieval.context_text(top, "query_id", "n").select(F.col("query_id").alias("source"), "context")


@query("SELECT id, CASE WHEN question IS NULL THEN NULL ELSE trim(question) END AS rewrite FROM law_qa")
def text_rewrites(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.element_at(F.array(*map(F.lit, ("答案：", "改写后: ", "改写结果："))), F.length("question") % 3 + 1), F.lit(' "'), F.trim("question"), F.lit('" '))
    return table(spark, d, "law_qa").select("id", T.rewrite_cleaned(made).alias("rewrite"))


@query(
    """WITH p AS (SELECT id, coalesce(title, '') AS a, left(coalesce(text_content, ''), 40) AS b FROM law_clause), s AS (SELECT id, a, b, unnest(range(1, length(a) + 1)) AS i FROM p),
n AS (SELECT *, unnest(range(1, length(a) - i + 2)) AS n FROM s), m AS (SELECT id, max(n) AS lcs FROM n WHERE contains(b, substr(a, i, n)) GROUP BY id),
x AS (SELECT p.id, a, regexp_replace(b, '^["''“”‘’「」\\t-\\r \\x{85}\\x{A0}\\x{3000}]+|["''“”‘’「」\\t-\\r \\x{85}\\x{A0}\\x{3000}]+$', '', 'g') AS b, coalesce(lcs, 0) AS lcs FROM p LEFT JOIN m ON p.id = m.id)
SELECT id, CASE WHEN length(b) < 8 THEN 'too_short' WHEN length(b) > greatest(60, floor(length(a) * 1.2) + 15) THEN 'too_long' WHEN lcs > 14 THEN 'copied' WHEN length(a) > 0 AND lcs / length(a) > 0.7 THEN 'copied_share' ELSE '' END AS problem FROM x"""
)
def text_rewrite_problems(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "law_clause")
    return c.select("id", dataset.rewrite_problem(F.coalesce("title", F.lit("")), F.left(F.coalesce("text_content", F.lit("")), F.lit(40))).alias("problem"))


@query(
    """SELECT a.vec_id, round(greatest(0.0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def text_cosines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query(
    """WITH l AS (SELECT vec_id, embedding[1]::DOUBLE * 5 AS a, embedding[2]::DOUBLE * 5 AS b FROM embeddings), p AS (SELECT vec_id, a, b, 1 / (1 + exp(a - b)) AS p FROM l)
SELECT vec_id, CAST(b > a AS INTEGER) AS label, round(greatest(p, 1 - p), 6) AS probability, greatest(p, 1 - p) < 0.7 AS low_confidence FROM p"""
)
def text_softmax(spark: SparkSession, d: str) -> DataFrame:
    x = lambda i: F.get("embedding", F.lit(i)).cast("double") * 5
    return table(spark, d, "embeddings").select("vec_id", models.binary_softmax(x(0), x(1)).alias("s")).select("vec_id", "s.label", F.round("s.probability", 6).alias("probability"), "s.low_confidence")


@query("SELECT id, answer || chr(10) || chr(10) || '以上内容仅供参考，如需帮助请拨打人工服务电话 12348。' AS answer, '对话：无' || chr(10) || '问题：' || coalesce(question, '无') AS tail FROM law_qa")
def text_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompt = prompts.general_prompt(F.col("question"), F.lit(None).cast("string"))
    return table(spark, d, "law_qa").select("id", prompts.with_disclaimer(F.col("answer"), "12348").alias("answer"), F.substring_index(prompt, "不提供法律意见。\n", -1).alias("tail"))


# --- deduplication and joins ----------------------------------------------------------------------------------------


@query("SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source, left(text_content, 255) ORDER BY id) AS r FROM law_chunk) WHERE r = 1")
def dedup_chunks(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_wins(table(spark, d, "law_chunk"), [F.col("source"), F.left("text_content", F.lit(255))], [F.col("id")]).select("id", "source")


@query("SELECT row_id, label FROM (SELECT row_id, label, text, row_number() OVER (PARTITION BY text ORDER BY row_id) AS r FROM raw WHERE text IS NOT NULL) WHERE r = 1")
def dedup_raw(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_wins(table(spark, d, "raw").where("text IS NOT NULL"), [F.col("text")], [F.col("row_id")]).select("row_id", "label")


@query(
    """WITH o AS (SELECT * FROM law_qa WHERE source = '同澜问答'), n AS (SELECT id, question, row_number() OVER (PARTITION BY left(question, 255) ORDER BY id) AS r FROM law_qa WHERE source <> '同澜问答')
SELECT id, question FROM n WHERE r = 1 AND left(question, 255) NOT IN (SELECT left(question, 255) FROM o)"""
)
def insert_ignore_qa(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "law_qa")
    return dedup.insert_ignore(q.where("source = '同澜问答'"), q.where("source <> '同澜问答'"), F.left("question", F.lit(255)), [F.col("id")]).select("id", "question")


@query(
    """WITH o AS (SELECT *, 0 AS new FROM client_frame WHERE received_at < TIMESTAMP '2025-06-01 01:30:00'), n AS (SELECT *, 1 AS new FROM client_frame WHERE received_at >= TIMESTAMP '2025-06-01 00:30:00'),
e AS (SELECT frame_id, received_at, frame_type, new, row_number() OVER (PARTITION BY frame_id ORDER BY new DESC, received_at DESC) AS r FROM (FROM n UNION ALL SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY received_at) = 1))
SELECT frame_id, received_at, frame_type, new FROM e WHERE r = 1"""
)
def upsert_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames held so far, one for each id, replaced by what came in later; both sides overlap."""
    f = table(spark, d, "client_frame").select("frame_id", "received_at", "frame_type")
    held = dedup.first_wins(f.where("received_at < TIMESTAMP_NTZ '2025-06-01 01:30:00'"), [F.col("frame_id")], [F.col("received_at")]).withColumn("new", F.lit(0))
    return dedup.upsert(held, f.where("received_at >= TIMESTAMP_NTZ '2025-06-01 00:30:00'").withColumn("new", F.lit(1)), "frame_id", [F.desc("received_at")])


@query(
    """SELECT 'law_chunk' AS table_name, id, text_content AS text, to_json(path) AS path FROM law_chunk WHERE section = '案件焦点' UNION ALL SELECT 'law_qa', id, question, NULL FROM law_qa WHERE source IS NULL"""
)
def lookup_rows(spark: SparkSession, d: str) -> DataFrame:
    chunk, qa = table(spark, d, "law_chunk"), table(spark, d, "law_qa")
    keys = chunk.where("section = '案件焦点'").select(F.lit("law_chunk").alias("table_name"), "id").unionByName(qa.where("source IS NULL").select(F.lit("law_qa").alias("table_name"), "id"))
    stored = {"law_chunk": chunk.select("id", F.col("text_content").alias("text"), F.to_json("path").alias("path")), "law_qa": qa.select("id", F.col("question").alias("text"))}
    return dedup.lookup(keys, stored).withColumn("path", F.to_json(F.from_json("path", "array<string>")))


@query("SELECT id, source, title, parent_content FROM law_cases UNION ALL SELECT id, source, title, NULL FROM law_clause")
def union_collections(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "law_cases").select("id", "source", "title", "parent_content"), table(spark, d, "law_clause").select("id", "source", "title")
    return dedup.union_all([a, b])


@query("SELECT count(*) AS n FROM (SELECT DISTINCT text FROM raw WHERE split = 'train' AND text IS NOT NULL) a JOIN (SELECT DISTINCT text FROM raw WHERE split <> 'train') b ON a.text = b.text")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw").where("text IS NOT NULL")
    return dedup.overlap_count(r.where("split = 'train'"), r.where("split <> 'train'"), "text")


_PARENT = """SELECT source, case_no, string_agg(text_content, chr(10) ORDER BY id) AS parent FROM law_chunk
WHERE doc_type = 'case' AND section IN ('基本案情', '法院裁判要旨', '法官后语') AND case_no <> '' GROUP BY source, case_no"""


def _parents(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "law_chunk").where(F.col("doc_type") == "case").where(F.col("section").isin("基本案情", "法院裁判要旨", "法官后语") & (F.col("case_no") != ""))
    parts = c.groupBy("source", "case_no").agg(F.array_sort(F.collect_list(F.struct("id", "text_content"))).alias("l"))
    return parts.select("source", "case_no", F.array_join("l.text_content", "\n").alias("parent"))


@query(_PARENT)
def parent_texts(spark: SparkSession, d: str) -> DataFrame:
    return _parents(spark, d)


@query(f"WITH p AS ({_PARENT}) SELECT c.id, coalesce(p.parent, '') AS parent FROM law_chunk c LEFT JOIN p ON c.source = p.source AND c.case_no = p.case_no WHERE c.doc_type = 'case' AND c.section IN ('案件焦点', '法院裁判要旨')")
def parent_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "law_chunk").where((F.col("doc_type") == "case") & F.col("section").isin("案件焦点", "法院裁判要旨"))
    return c.join(_parents(spark, d), ["source", "case_no"], "left").select("id", F.coalesce("parent", F.lit("")).alias("parent"))


@query("SELECT id, law_name, article_no, array_to_string(path, '/') AS path FROM law_chunk WHERE doc_type = 'law' AND article_no <> ''")
def scan_law_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_chunk").where("doc_type = 'law' AND article_no <> ''").select("id", "law_name", "article_no", F.array_join("path", "/").alias("path"))


@query(
    f"""WITH f AS (SELECT frame_id, {_COMPACT % 'text'} AS k FROM client_frame WHERE frame_type = 'question'), c AS (SELECT DISTINCT {_COMPACT % 'question'} AS k FROM law_qa)
SELECT frame_id, k IN (SELECT k FROM c) AS hit FROM f WHERE k IS NOT NULL"""
)
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "client_frame").where("frame_type = 'question' AND text IS NOT NULL").select("frame_id", T.compact_line(F.col("text")).alias("k"))
    c = table(spark, d, "law_qa").where("question IS NOT NULL").select(T.compact_line(F.col("question")).alias("k")).distinct().withColumn("hit", F.lit(True))
    return f.join(c, "k", "left").select("frame_id", F.coalesce("hit", F.lit(False)).alias("hit"))


# --- retrieval ------------------------------------------------------------------------------------------------------

_BM25_OF = f"""t AS (SELECT id, {_TOKENS % 'question'} AS q FROM law_qa WHERE question IS NOT NULL AND %s),
g AS (SELECT id, list_filter({_BIGRAMS % ('q', 'q')}, lambda x: x <> '') AS g FROM t), l AS (SELECT id, len(g) AS dl, unnest(g) AS term FROM g),
p AS (SELECT id AS doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM l GROUP BY id, term),
h AS (SELECT count(*) AS n, avg(len(g)) AS avgdl FROM g), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df, h), s AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r)"""
_BM25_RANKED = """x AS (SELECT query_id, doc_id, CAST(sum(CAST(round(idf * qf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * 1000000000) AS BIGINT)) AS DOUBLE) / 1e9 AS score FROM p JOIN s USING (term) JOIN a USING (term), h GROUP BY query_id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x)
"""
_BM25 = f"""WITH {_BM25_OF % "true"}, a AS (SELECT id AS query_id, term, count(*) AS qf FROM l WHERE id % 50 = 0 GROUP BY id, term),
{_BM25_RANKED}"""


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    q = table(spark, d, "law_qa")
    return retrieval.bm25_top(q.where("id % 50 = 0"), q, "id", "question", "id", "question", k)


@query(_BM25 + "SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM k WHERE rank <= 5")
def bm25_top5(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 5).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query(
    _BM25 + """, t2 AS (SELECT query_id, max(score) AS top1, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS top2, arg_min(doc_id, rank) AS doc_id FROM k WHERE rank <= 2 GROUP BY query_id)
SELECT query_id, doc_id, round(top1, 4) AS top1, round(top2, 4) AS top2 FROM t2 WHERE top1 >= 22 AND top1 - top2 >= 5"""
)
def bm25_gate(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.gated_top1(_bm25(spark, d, 2)).select("query_id", "doc_id", F.round("top1", 4).alias("top1"), F.round("top2", 4).alias("top2"))


@query(
    f"""WITH t AS (SELECT id, {_TOKENS % 'question'} AS q FROM law_qa WHERE question IS NOT NULL), g AS (SELECT id, unnest({_BIGRAMS % ('q', 'q')}) AS term FROM t), p AS (SELECT DISTINCT id, term FROM g WHERE term <> ''),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), r AS (SELECT term, df, ln(((SELECT count(*) FROM t) - df + 0.5) / (df + 0.5)) AS raw FROM df)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END, 6) AS idf FROM r"""
)
def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "law_qa").where("question IS NOT NULL")
    return retrieval.term_statistics(retrieval.postings(q, "id", "question"), q.count()).select("term", "df", F.round("idf", 6).alias("idf"))


_DENSE = """WITH x AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x)
"""


@query(_DENSE + "SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM k WHERE rank <= 5")
def dense_top5(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    top = retrieval.dense_top(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", 5)
    return top.select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


# string ids are chosen by their first digits read as a number
_PICK = "('0x' || left(id, 8))::BIGINT % 50 = 0"
_PICKED = "conv(left(id, 8), 16, 10) % 50 = 0"
_SPARSE = f"""WITH m AS (SELECT id, unnest(map_keys(sparse_vector)) AS term, unnest(map_values(sparse_vector))::DOUBLE AS w FROM law_cases WHERE sparse_vector IS NOT NULL),
s AS (SELECT a.id AS query_id, b.id AS doc_id, CAST(sum(CAST(round(a.w * b.w * 1000000000) AS BIGINT)) AS DOUBLE) / 1e9 AS score FROM m a JOIN m b USING (term) WHERE {_PICK.replace('id', 'a.id')} GROUP BY a.id, b.id)
"""


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "law_cases")
    return retrieval.sparse_top(c.where(_PICKED), c, "id", "sparse_vector", "id", "sparse_vector", 5)


@query(_SPARSE + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM k WHERE rank <= 5")
def sparse_top5(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(spark, d).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


_USABLE = "dense_vector IS NOT NULL AND list_sum(list_transform(dense_vector, lambda x: x * x)) > 0"
_FUSED = (
    _SPARSE
    + f""", d AS (SELECT q.id AS query_id, e.id AS doc_id, round(list_cosine_similarity(q.dense_vector::DOUBLE[], e.dense_vector::DOUBLE[]), 12) AS score
  FROM (SELECT * FROM law_cases WHERE {_USABLE} AND {_PICK}) q, (SELECT * FROM law_cases WHERE {_USABLE}) e),
dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM d) WHERE r <= 5),
sk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 5),
f AS (SELECT coalesce(dk.query_id, sk.query_id) AS query_id, coalesce(dk.doc_id, sk.doc_id) AS doc_id, 1.0 * coalesce(dk.score, 0) + 0.7 * coalesce(sk.score, 0) AS score FROM dk FULL JOIN sk ON dk.query_id = sk.query_id AND dk.doc_id = sk.doc_id),
fk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 5)
"""
)


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "law_cases")
    return retrieval.fused(retrieval.dense_top(c.where(_PICKED), c, "id", "dense_vector", "id", "dense_vector", 5), _sparse(spark, d), 5)


@query(_FUSED + "SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM fk")
def hybrid_top5(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


@query(
    _FUSED + """, h AS (SELECT f.query_id, f.doc_id, f.rank, c.text_content, row_number() OVER (PARTITION BY f.query_id, coalesce(c.text_content, '') ORDER BY f.rank, f.doc_id) AS u FROM fk f JOIN law_cases c ON c.id = f.doc_id),
n AS (SELECT query_id, doc_id, rank, length(text_content) AS chars, count(*) OVER (PARTITION BY query_id) AS n FROM h WHERE u = 1),
r AS (SELECT query_id, doc_id, CASE WHEN n > 3 THEN chars / 1000.0 END AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 3 THEN chars END DESC NULLS LAST, rank, doc_id) AS final_rank FROM n)
SELECT query_id, doc_id, CAST(final_rank AS INTEGER) AS final_rank, CAST(rerank_score AS DOUBLE) AS rerank_score FROM r WHERE final_rank <= 3"""
)
def hybrid_reranked(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "law_cases").select(F.col("id").alias("doc_id"), F.coalesce("text_content", F.lit("")).alias("content"))
    hits = _hybrid(spark, d).join(c, "doc_id").withColumn("query_no", F.lit(0))
    hits = retrieval.content_dedup(hits.withColumnRenamed("query_id", "plan_id"))
    return retrieval.reranked(hits, F.length("content") / F.lit(1000.0), 3).select(F.col("plan_id").alias("query_id"), "doc_id", "final_rank", "rerank_score")


@query(
    _FUSED
    + """, q AS (SELECT id AS query_id, left(id, 1) AS plan_id, row_number() OVER (PARTITION BY left(id, 1) ORDER BY id) AS query_no FROM law_cases WHERE """
    + _PICK
    + """), h AS (SELECT q.plan_id, q.query_no, f.doc_id, f.rank, coalesce(c.text_content, '') AS content FROM fk f JOIN q USING (query_id) JOIN law_cases c ON c.id = f.doc_id),
u AS (SELECT *, row_number() OVER (PARTITION BY plan_id, content ORDER BY query_no, rank, doc_id) AS u FROM h), n AS (SELECT *, count(*) OVER (PARTITION BY plan_id) AS n FROM u WHERE u = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY CASE WHEN n > 3 THEN length(content) END DESC NULLS LAST, query_no, rank, doc_id) AS final_rank FROM n)
SELECT plan_id, doc_id, CAST(query_no AS INTEGER) AS query_no, CAST(rank AS INTEGER) AS rank, CAST(final_rank AS INTEGER) AS final_rank FROM r WHERE final_rank <= 3"""
)
def plan_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Plans of several sub-queries each, retrieved, put together, deduplicated and re-ranked."""
    c = table(spark, d, "law_cases").select("id", F.col("id").alias("doc_id"), F.col("dense_vector").alias("dense"), F.col("sparse_vector").alias("sparse"), F.col("text_content").alias("content"))
    number = F.row_number().over(Window.partitionBy("plan_id").orderBy("id"))
    asked = c.where(_PICKED).withColumn("plan_id", F.left("id", F.lit(1))).withColumn("query_no", number).select("plan_id", "query_no", "dense", "sparse")
    plans = asked.select("plan_id", F.lit("").alias("rerank_query")).distinct()
    return retrieval.plan_contexts(retrieval.plan_hits(asked, c, 5), c, plans, F.length("content").cast("double"), 3).select("plan_id", "doc_id", "query_no", "rank", "final_rank")


@query(
    """WITH c AS (SELECT 'case' AS kind, id AS doc_id, source, parent_content AS body FROM law_cases UNION ALL SELECT 'clause', id, source, text_content FROM law_clause),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE kind WHEN 'case' THEN 0 ELSE 1 END, doc_id) AS n FROM c WHERE body IS NOT NULL AND NOT regexp_matches(body, '^[\\t-\\r \\x{85}\\x{A0}\\x{3000}]*$'))
SELECT source AS query_id, kind, doc_id, CAST(n AS INTEGER) AS n FROM k WHERE n <= 12"""
)
def context_cap(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "law_cases").select(F.lit("case").alias("kind"), F.col("id").alias("doc_id"), F.col("source").alias("query_id"), F.col("parent_content").alias("body"))
    b = table(spark, d, "law_clause").select(F.lit("clause").alias("kind"), F.col("id").alias("doc_id"), F.col("source").alias("query_id"), F.col("text_content").alias("body"))
    return retrieval.capped_contexts(a.unionByName(b).withColumn("rank", F.lit(1))).select("query_id", "kind", "doc_id", "n")


# --- conversations --------------------------------------------------------------------------------------------------

_MESSAGES = """WITH f AS (SELECT frame_id, any_value(session_id) AS session_id, any_value(text) AS content, min(ts) AS ts FROM client_frame WHERE frame_type = 'question' AND text IS NOT NULL GROUP BY frame_id),
m AS (SELECT session_id, content, CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) AS pos FROM f)
"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """A session's question frames as messages of alternating roles."""
    f = table(spark, d, "client_frame").where("frame_type = 'question' AND text IS NOT NULL")
    f = f.groupBy("frame_id").agg(F.first("session_id").alias("session_id"), F.first("text").alias("content"), F.min("ts").alias("ts"))
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "frame_id"))
    return f.withColumn("pos", pos).withColumn("role", F.when(F.col("pos") % 2 == 1, "user").otherwise("assistant")).select("session_id", "pos", "role", "content")


@query(
    _MESSAGES + """, k AS (SELECT * FROM m WHERE regexp_replace(content, '[\\t-\\r \\x{85}\\x{A0}\\x{3000}]+', '', 'g') <> ''), t AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM k),
s AS (SELECT session_id, turn, sum(length(content)) AS chars FROM t GROUP BY ALL), a AS (SELECT *, row_number() OVER w AS age, sum(chars) OVER w AS upto FROM s WINDOW w AS (PARTITION BY session_id ORDER BY turn DESC))
SELECT t.session_id, CAST(t.pos AS INTEGER) AS pos, CAST(t.turn AS BIGINT) AS turn, t.role FROM t JOIN a ON t.session_id = a.session_id AND t.turn = a.turn WHERE age <= 4 AND (age = 1 OR upto <= 1500)"""
)
def history_trimmed(spark: SparkSession, d: str) -> DataFrame:
    return dialog.trimmed_history(_messages(spark, d)).select("session_id", "pos", "turn", "role")


@query(
    _MESSAGES + """, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM m), k AS (SELECT session_id, string_agg(CASE role WHEN 'user' THEN '用户：' ELSE '助手：' END || CASE WHEN length(trim(content)) > 12 THEN left(trim(content), 12) || '…' ELSE trim(content) END, chr(10) ORDER BY pos) AS history FROM n WHERE pos > n - 40 GROUP BY session_id)
SELECT session_id, history FROM k"""
)
def history_formatted(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("h"))
    return m.select("session_id", dialog.history_text(dialog.last_messages(F.col("h")), 12).alias("history"))


@query(
    """WITH f AS (SELECT session_id, received_at AS ts, lag(received_at) OVER (PARTITION BY session_id ORDER BY received_at, frame_id) AS prev FROM client_frame)
SELECT session_id, count(*) AS frames, count(*) FILTER (prev IS NOT NULL AND epoch(ts) - epoch(prev) > 120) AS closings, count(*) FILTER (prev IS NOT NULL AND epoch(ts) - epoch(prev) > 1800) AS expiries FROM f GROUP BY session_id"""
)
def session_liveness(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("received_at", "frame_id")
    t = F.col("received_at").cast("timestamp").cast("double")
    f = table(spark, d, "client_frame").select("session_id", (t - F.lag(t).over(w)).alias("gap"))
    return f.groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("gap") > 120).alias("closings"), F.count_if(F.col("gap") > 1800).alias("expiries"))


@query(
    """WITH f AS (SELECT frame_id, text AS k, received_at AS t FROM client_frame WHERE frame_type = 'question' AND text IS NOT NULL),
x AS (SELECT frame_id, t, lag(t) OVER (PARTITION BY k ORDER BY t, frame_id) AS b FROM f)
SELECT frame_id, t AS received_at, coalesce(epoch(t) - epoch(b) < 3600, false) AS fresh FROM x"""
)
def cache_freshness(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("text").orderBy("received_at", "frame_id")
    t = F.col("received_at").cast("timestamp").cast("double")
    f = table(spark, d, "client_frame").where("frame_type = 'question' AND text IS NOT NULL")
    return f.select("frame_id", "received_at", F.coalesce(t - F.lag(t).over(w) < 3600, F.lit(False)).alias("fresh"))


# --- data sets and metrics ------------------------------------------------------------------------------------------

SCENES = ["租", "借", "押金", "合伙", "离婚"]
PROCEDURES = ["仲裁委员会", "起诉还是先去调解"]
_HAS = lambda words, c="question": "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(
    f"""SELECT id, CASE WHEN {_HAS(PROCEDURES)} THEN 'procedure' WHEN NOT {_HAS(SCENES)} THEN 'scene' ELSE '' END AS reason,
regexp_matches(question || chr(10) || coalesce(answer, ''), '1[3-9][0-9]{{9}}|[0-9]{{17}}[0-9Xx]|[\\x{{4E00}}-\\x{{9FA5}}]{{2,4}}(先生|女士|同志)') AS personal FROM law_qa WHERE length(answer) >= 80 AND length(question) BETWEEN 6 AND 80"""
)
def question_filters(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "law_qa").where(dataset.length_between(F.col("answer"), 80) & dataset.length_between(F.col("question"), 6, 80))
    return q.select("id", dataset.scene_filter(F.col("question"), SCENES, PROCEDURES).alias("reason"), dataset.has_personal_data(F.col("question"), F.coalesce("answer", F.lit(""))).alias("personal"))


_SUM = lambda words: " + ".join(f"CAST(contains(question, '{w}') AS INTEGER)" for w in words)


@query(f"SELECT id, CASE WHEN {_SUM(['我', '怎么', '吗'])} > {_SUM(SCENES)} THEN 'everyday' ELSE 'professional' END AS scene FROM law_qa")
def question_scenes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_qa").select("id", dataset.scene_of(F.col("question"), ["我", "怎么", "吗"], SCENES).alias("scene"))


@query("SELECT id FROM law_qa ORDER BY md5('42_' || id), id LIMIT 20")
def question_sample(spark: SparkSession, d: str) -> DataFrame:
    return dataset.hash_sample(table(spark, d, "law_qa"), "id", 20, 42).select("id")


_GREET = "regexp_matches(text, '你好|您好|请问|麻烦|咨询|想问|请教|打扰|谢谢|多谢|辛苦|嗨|哈喽|在吗')"
_SPLIT = f"""WITH u AS (SELECT row_id, label, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY row_id) AS r FROM raw WHERE text IS NOT NULL AND text <> '' AND label IN (0, 1)) WHERE r = 1),
f AS (SELECT *, label || '_' || CASE WHEN length(text) <= 6 THEN 'xs' WHEN length(text) <= 15 THEN 's' WHEN length(text) > 40 THEN 'l' ELSE 'm' END || '_' || CASE WHEN {_GREET} THEN 'G' ELSE 'g' END || '_' || CASE WHEN contains(left(text, 10), '我') THEN 'P' ELSE 'p' END AS k0 FROM u),
p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k0) < 10 THEN 'pool_' || label ELSE k0 END AS k FROM f),
r AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY md5('42_' || text), text) AS r FROM p),
t AS (SELECT *, greatest(1, CAST(round_even(n * 0.1, 0) AS INTEGER)) AS t FROM r),
s AS (SELECT row_id, label, text, k AS stratum, CASE WHEN r > n - t THEN 'test' WHEN r > n - 2 * t THEN 'dev' ELSE 'train' END AS part FROM t)
"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw").where("text IS NOT NULL AND text <> '' AND label IN (0, 1)")
    return dataset.stratified_split(dedup.first_wins(r, [F.col("text")], [F.col("row_id")]))


@query(_SPLIT + "SELECT row_id, stratum, part FROM s")
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("row_id", "stratum", "part")


@query(
    _SPLIT + """SELECT part, count(*) AS n, count(*) FILTER (label = 1) AS legal, count(*) FILTER (label = 0) AS daily, count(*) FILTER (length(text) <= 6) AS very_short, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY part"""
)
def split_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = _split(spark, d)
    g = s.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("legal"), F.count_if(F.col("label") == 0).alias("daily"), F.count_if(F.length("text") <= 6).alias("very_short"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n, round(count(*) / (SELECT count(*) FROM law_qa), 6) AS share FROM law_qa GROUP BY 1")
def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    return metrics.distribution(table(spark, d, "law_qa"), "source")


@query(
    """SELECT * FROM (SELECT 'value' AS metric, round_even(avg(value), 4) AS mean, count(value) AS n FROM events UNION ALL SELECT 'big', round_even(avg(CASE WHEN value > 10 THEN value END), 4), count(CASE WHEN value > 10 THEN value END) FROM events)"""
)
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("value", F.when(F.col("value") > 10, F.col("value")).alias("big"))
    return metrics.metric_summary(e, ["value", "big"])


@query("SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS n, round_even(avg(round_even(value, 4)), 4) AS value FROM events GROUP BY 1")
def metric_groups(spark: SparkSession, d: str) -> DataFrame:
    return metrics.group_means(table(spark, d, "events"), "event_type", ["value"])


_LEGAL = ["起诉", "仲裁", "赔", "权", "合同", "欠", "押金", "离婚", "借", "侵", "补偿", "被骗", "抵债"]
_CELLS = f"""WITH g AS (SELECT label AS y, CAST({_HAS(_LEGAL, 'text')} AS INTEGER) AS p FROM raw WHERE label IN (0, 1) AND text IS NOT NULL),
c AS (SELECT count(*) FILTER (y = 0 AND p = 0) AS c00, count(*) FILTER (y = 0 AND p = 1) AS c01, count(*) FILTER (y = 1 AND p = 0) AS c10, count(*) FILTER (y = 1 AND p = 1) AS c11 FROM g),
m AS (SELECT 0 AS label, coalesce(c00 / nullif(c00 + c10, 0), 0) AS precision, coalesce(c00 / nullif(c00 + c01, 0), 0) AS recall, c00 + c01 AS support, (c00 + c11) / (c00 + c01 + c10 + c11) AS accuracy FROM c
UNION ALL SELECT 1, coalesce(c11 / nullif(c01 + c11, 0), 0), coalesce(c11 / nullif(c10 + c11, 0), 0), c10 + c11, (c00 + c11) / (c00 + c01 + c10 + c11) FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
"""


@query(_CELLS + "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, round(accuracy, 6) AS accuracy, round((SELECT avg(f1) FROM f), 6) AS macro_f1 FROM f")
def classifier_report(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw").where("label IN (0, 1) AND text IS NOT NULL").withColumn("guess", models.keyword_classifier(_LEGAL)(F.col("text")))
    return metrics.classification_report(r, "label", "guess")


@query(
    _DENSE + """, v AS (SELECT k.query_id, k.rank, CAST(a.label = b.label AS INTEGER) AS hit FROM k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.doc_id WHERE rank <= 6 AND query_id <> doc_id),
p AS (SELECT *, sum(hit) OVER w / count(*) OVER w AS p FROM v WINDOW w AS (PARTITION BY query_id ORDER BY rank))
SELECT query_id, round(coalesce(sum(p * hit) / nullif(sum(hit), 0), 0), 6) AS context_precision, round(avg(hit), 6) AS hit_rate FROM p GROUP BY query_id"""
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    top = retrieval.dense_top(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", 6).where("query_id <> doc_id")
    label = e.select("vec_id", "label")
    v = top.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(label.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b")), "doc_id")
    return metrics.verdict_metrics(v.withColumn("relevant", F.col("a") == F.col("b")))


@query(_CELLS.split(",\nc AS")[0] + """, w AS (SELECT a.v AS truth, b.v AS guess FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v))
SELECT truth, guess, (SELECT count(*) FROM g WHERE y = truth AND p = guess) AS n FROM w""")
def classifier_confusion(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw").where("label IN (0, 1) AND text IS NOT NULL").withColumn("guess", models.keyword_classifier(_LEGAL)(F.col("text")))
    return metrics.confusion(r, "label", "guess")


_STAGES = ["cache", "general", "bm25", "hybrid", "error"]
_RUNS = """WITH s AS (SELECT CAST(id AS VARCHAR) AS qa_id, question AS eval_question, answer, list_filter(string_split(coalesce(answer, ''), '。'), lambda x: x <> '') AS contexts,
CASE length(question) % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'bm25' WHEN 2 THEN 'hybrid' ELSE 'other' END AS hit_stage, length(answer) AS answer_chars, length(question) % 3 + 1 AS rewrite_attempts, CASE WHEN length(question) % 5 > 0 THEN source END AS scene FROM law_qa)
"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Run results made of the question table: stages, attempts and scenes follow from lengths."""
    n = F.length("question")
    stage = F.when(n % 4 == 0, "cache").when(n % 4 == 1, "bm25").when(n % 4 == 2, "hybrid").otherwise("other")
    return table(spark, d, "law_qa").select(
        F.col("id").cast("string").alias("qa_id"), F.col("question").alias("eval_question"), "answer", F.filter(F.split(F.coalesce("answer", F.lit("")), "。"), lambda x: x != "").alias("contexts"),
        stage.alias("hit_stage"), F.length("answer").alias("answer_chars"), (n % 3 + 1).alias("rewrite_attempts"), F.when(n % 5 > 0, F.col("source")).alias("scene"), F.col("answer").alias("ground_truth"),
    )


@query(_RUNS + f"SELECT qa_id, eval_question AS user_input, eval_question AS question, answer AS response, answer AS reference, len(contexts) AS n FROM s WHERE hit_stage = 'hybrid' AND len(contexts) > 0 AND {_STRIP % 'answer'} <> ''")
def evaluable_samples(spark: SparkSession, d: str) -> DataFrame:
    s = dataset.metric_columns(dataset.evaluable(_runs(spark, d)))
    return s.select("qa_id", "user_input", "question", "response", "reference", F.size("retrieved_contexts").cast("bigint").alias("n"))


@query(
    _RUNS + """, n AS (SELECT CASE WHEN hit_stage IN ('cache', 'bm25', 'hybrid') THEN hit_stage ELSE 'unknown' END AS stage, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT unnest(['cache', 'general', 'bm25', 'hybrid', 'error']) AS stage) SELECT coalesce(e.stage, n.stage) AS stage, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM s), 6) AS share FROM e FULL JOIN n ON e.stage = n.stage"""
)
def stage_distribution(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stage_distribution(_runs(spark, d), _STAGES)


@query(
    _RUNS + """, x AS (SELECT *, coalesce(scene, 'unknown') AS g FROM s) SELECT g AS scene, count(*) AS n, round(avg(answer_chars), 4) AS mean_answer_chars, count(*) FILTER (rewrite_attempts > 1) AS retried FROM x GROUP BY g
UNION ALL SELECT NULL, count(*), round(avg(answer_chars), 4), count(*) FILTER (rewrite_attempts > 1) FROM x"""
)
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dataset_summary(_runs(spark, d))


@query(_RUNS + "SELECT qa_id, hit_stage FROM s WHERE qa_id IN (SELECT CAST(id AS VARCHAR) FROM law_qa WHERE source IS NULL) ORDER BY qa_id LIMIT 25")
def run_selection(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "law_qa").where("source IS NULL").select(F.col("id").cast("string").alias("qa_id"))
    return dataset.chosen(_runs(spark, d), "qa_id", wanted, 25).select("qa_id", "hit_stage")


@query("SELECT table_name, before, after_, before = after_ AS same FROM (SELECT 'law_qa' AS table_name, count(*) AS before, count(*) AS after_ FROM law_qa UNION ALL SELECT 'raw', count(*), count(*) FILTER (text IS NOT NULL) FROM raw)")
def side_effects(spark: SparkSession, d: str) -> DataFrame:
    qa, raw = table(spark, d, "law_qa"), table(spark, d, "raw")
    return dataset.count_guard({"law_qa": (qa, qa), "raw": (raw, raw.where("text IS NOT NULL"))}).withColumnRenamed("after", "after_")


@query(
    f"""WITH s AS (SELECT id, question, {strip_sql('unnest(regexp_extract_all(answer, ' + chr(39) + '[^。！？；!?;' + chr(10) + ']*[。！？；!?;' + chr(10) + ']|[^。！？；!?;' + chr(10) + ']+$' + chr(39) + '))')} AS s FROM law_qa WHERE question IS NOT NULL),
t AS (SELECT id, {_TOKENS % 's'} AS a, {_TOKENS % 'question'} AS b FROM s WHERE length(s) >= 2), g AS (SELECT id, list_distinct(list_filter({_BIGRAMS % ('a', 'a')}, lambda x: x <> '')) AS a, list_distinct(list_filter({_BIGRAMS % ('b', 'b')}, lambda x: x <> '')) AS b FROM t),
v AS (SELECT id, coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0) >= 0.2 AS v FROM g) SELECT id, round(avg(CAST(v AS INTEGER)), 6) AS faithfulness FROM v GROUP BY id"""
)
def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "law_qa").where("question IS NOT NULL").select("id", "question", F.explode(T.sentences(F.col("answer"))).alias("s"))
    return metrics.covered_share(s.withColumn("v", models.overlap_judge(0.2)(F.col("s"), F.col("question"))), "id", "v", "faithfulness")


@query("SELECT chunk_type, count(*) AS n, arg_min(left(text_content, 40), id) AS preview FROM law_chunk WHERE text_content IS NOT NULL GROUP BY chunk_type")
def chunk_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "law_chunk").where("text_content IS NOT NULL")
    return chunking.chunk_summary(c.select("chunk_type", F.lit("").alias("source"), F.col("id").alias("chunk_no"), F.col("text_content").alias("text"), F.lit(None).cast("string").alias("error")))


@query(
    """WITH h AS (SELECT id, source, case_no, row_number() OVER (PARTITION BY source, id // 4096 ORDER BY id) AS n FROM law_chunk WHERE section = '案件基本信息')
SELECT id, CAST(n AS VARCHAR) AS case_no, CASE WHEN case_no <> '' AND case_no <> CAST(n AS VARCHAR) THEN case_no END AS printed_case_no FROM h"""
)
def case_numbers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "law_chunk").where("section = '案件基本信息'").select("id", F.col("case_no").alias("printed"), "source", F.floor(F.col("id") / 4096).alias("volume"))
    return chunking.verified_numbers(c, ["source", "volume"], "id", "printed").select("id", "case_no", "printed_case_no")


@query(
    f"""WITH l AS ({_LINES.replace("WHERE", "WHERE doc_type = 'case' AND")}), t AS (SELECT id, pos, {strip_sql('line')} AS s FROM l), m AS (SELECT *, regexp_extract(s, '^【(案件基本信息|基本案情|案件焦点|法院裁判要旨|法官后语)】[{_S}]*[①-⑳]?$', 1) AS name FROM t),
i AS (SELECT *, count(*) FILTER (name <> '') OVER (PARTITION BY id ORDER BY pos) AS no FROM m)
SELECT id, CAST(no AS INTEGER) AS section_no, max(name) AS section, string_agg(s, chr(10) ORDER BY pos) AS text FROM i WHERE no > 0 GROUP BY id, no"""
)
def case_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.section_islands(cleaning.document_lines(table(spark, d, "law_chunk").where("doc_type = 'case'"), "id", "text_content", normalize=False))


# --- whole documents and plans ----------------------------------------------------------------------------------------


def _volumes(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return chunking.volumes(table(spark, d, "law_chunk").where(F.col("doc_type") == kind))


@query()
def chunk_laws(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_volumes(spark, d, "law")).drop("extra")


@query()
def chunk_cases(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_volumes(spark, d, "case")).drop("extra")


@query()
def chunk_merged(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_volumes(spark, d, "law").withColumn("doc_type", F.lit("law_merged"))).drop("extra")


@query()
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit("semantic").alias("doc_type"), "text")
    return chunking.chunk_documents(docs).drop("extra")


_PLANS = f"""SELECT %s AS id, %s AS question, list_filter(string_split_regex(%s, '[，。；？！?]+'), lambda x: length(trim(x)) >= 6) AS parts, length(trim(%s)) AS n"""
_ROUTED = f"""CASE WHEN len(parts) > 1 THEN 'subquery' WHEN n < 8 THEN 'recall' WHEN n > 60 THEN 'hyde' ELSE 'direct' END AS route,
list_filter(list_transform(string_split(CASE WHEN len(parts) > 1 THEN array_to_string(parts, chr(10)) WHEN n < 8 THEN question || chr(10) || question || '的规定' WHEN n > 60 THEN question || chr(10) || '根据规定，' || question ELSE question END, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l"""


@query(
    f"""WITH p AS ({_PLANS % ('id', 'question', 'question', 'question')} FROM law_qa WHERE question IS NOT NULL), r AS (SELECT id, {_ROUTED} FROM p)
SELECT id, route, CAST(unnest(range(0, len(l))) AS INTEGER) AS query_no, unnest(l) AS query FROM r"""
)
def query_plans(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "law_qa").select("id", models.clause_rewriter()(F.col("question")).alias("p"))
    return q.select("id", "p.route", F.posexplode(T.split_queries(F.col("p.retrieval_queries"))).alias("query_no", "query"))


def _embedded_sql(name: str, source: str) -> str:
    """Counts of hashed character pairs of (id, text), as 64 places and as unit weights of 32,768 terms."""
    return f"""{name}_g AS (SELECT id, {_COMPACT % 'text'} AS c FROM ({source})), {name}_k AS (SELECT id, unnest(list_transform({_BIGRAMS % ('c', 'c')}, lambda g: unicode(left(g, 1)) * 31 + CASE WHEN length(g) > 1 THEN unicode(substr(g, 2, 1)) ELSE 0 END)) AS h FROM {name}_g WHERE c <> ''),
{name}_c AS (SELECT id, h % 64 AS h, count(*)::DOUBLE AS n FROM {name}_k GROUP BY ALL), {name}_d AS (SELECT id, list_transform(range(0, 64), lambda i: coalesce(m[i], 0.0)) AS v FROM (SELECT id, map(list(h), list(n)) AS m FROM {name}_c GROUP BY id)),
{name}_t AS (SELECT id, h % 32768 AS term, count(*)::DOUBLE AS n FROM {name}_k GROUP BY ALL), {name}_s AS (SELECT id, term, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {name}_t)"""


def _collection_sql(name: str, k: int, m: int) -> str:
    """The ``m`` contexts of each plan in one collection, from sub-queries sq of plans pl."""
    return f"""{name}_dk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT q.id AS query_id, e.id AS doc_id, round(list_cosine_similarity(q.v, e.v), 12) AS score FROM sq_d q, {name}_d e) QUALIFY r <= {k}),
{name}_sk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT q.id AS query_id, e.id AS doc_id, CAST(sum(CAST(round(q.w * e.w * 1000000000) AS BIGINT)) AS DOUBLE) / 1e9 AS score FROM sq_s q JOIN {name}_s e USING (term) GROUP BY ALL) QUALIFY r <= {k}),
{name}_f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id, 1.0 * coalesce(d.score, 0) + 0.7 * coalesce(s.score, 0) AS score FROM {name}_dk d FULL JOIN {name}_sk s ON d.query_id = s.query_id AND d.doc_id = s.doc_id),
{name}_fk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_f QUALIFY rank <= {k}),
{name}_u AS (SELECT pl.plan_id, pl.query_no, f.doc_id, f.rank, coalesce(c.text_content, '') AS content, pl.question, c.body FROM {name}_fk f JOIN sq pl ON pl.id = f.query_id JOIN {name}_docs c ON c.id = f.doc_id QUALIFY row_number() OVER (PARTITION BY plan_id, content ORDER BY query_no, rank, doc_id) = 1),
{name}_n AS (SELECT *, count(*) OVER (PARTITION BY plan_id) AS n, list_distinct(list_filter({_BIGRAMS % ('a', 'a')}, lambda x: x <> '')) AS qa, list_filter({_BIGRAMS % ('b', 'b')}, lambda x: x <> '') AS qb FROM (SELECT *, {_TOKENS % 'question'} AS a, {_TOKENS % 'content'} AS b FROM {name}_u)),
{name}_r AS (SELECT plan_id, doc_id, body, row_number() OVER (PARTITION BY plan_id ORDER BY CASE WHEN n > {m} THEN coalesce(len(list_intersect(qa, qb)) / nullif(len(qa), 0), 0) END DESC NULLS LAST, query_no, rank, doc_id) AS place FROM {name}_n QUALIFY place <= {m})"""


@query(
    f"""WITH f AS (SELECT text AS question, min(frame_id) AS question_id FROM client_frame WHERE frame_type = 'question' AND text IS NOT NULL GROUP BY text),
o AS (SELECT min(frame_id) AS first FROM client_frame WHERE frame_type = 'question' AND text IS NOT NULL GROUP BY session_id),
known AS (SELECT {_COMPACT % 'question'} AS k, arg_min(answer, id) AS answer FROM law_qa WHERE question IS NOT NULL AND answer IS NOT NULL GROUP BY 1),
c AS (SELECT question_id, 'cache' AS hit_stage, known.answer FROM f JOIN known ON k = {_COMPACT % 'f.question'} WHERE question_id IN (SELECT first FROM o)),
f2 AS (SELECT * FROM f WHERE question_id NOT IN (SELECT question_id FROM c)),
ge AS (SELECT question_id, 'general' AS hit_stage, '（闲聊）' AS answer FROM f2 WHERE NOT {_HAS([*_LEGAL, *SCENES])}), f3 AS (SELECT * FROM f2 WHERE question_id NOT IN (SELECT question_id FROM ge)),
{_BM25_OF % "answer IS NOT NULL"}, ql AS (SELECT question_id AS query_id, {_TOKENS % 'question'} AS q FROM f3), qg AS (SELECT query_id, unnest({_BIGRAMS % ('q', 'q')}) AS term FROM ql), a AS (SELECT query_id, term, count(*) AS qf FROM qg WHERE term <> '' GROUP BY ALL),
{_BM25_RANKED}, t2 AS (SELECT query_id, max(score) AS top1, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS top2, arg_min(doc_id, rank) AS doc_id FROM k WHERE rank <= 2 GROUP BY query_id),
b AS (SELECT query_id AS question_id, 'bm25' AS hit_stage, answer FROM t2 JOIN law_qa ON law_qa.id = doc_id WHERE top1 >= 22 AND top1 - top2 >= 5), f4 AS (SELECT * FROM f3 WHERE question_id NOT IN (SELECT question_id FROM b)),
pp AS ({_PLANS % ('question_id', 'question', 'question', 'question')} FROM f4), pr AS (SELECT id, question, {_ROUTED} FROM pp), sq AS (SELECT id AS plan_id, question, unnest(range(0, len(l))) AS query_no, unnest(l) AS text, id || '#' || unnest(range(0, len(l))) AS id FROM pr),
{_embedded_sql('sq', 'SELECT id, text FROM sq')}, ca_docs AS (SELECT id, text_content, coalesce(nullif(parent_content, ''), text_content) AS body FROM law_cases), cl_docs AS (SELECT id, text_content, text_content AS body FROM law_clause),
{_embedded_sql('ca', 'SELECT id, text_content AS text FROM ca_docs WHERE text_content IS NOT NULL')}, {_embedded_sql('cl', 'SELECT id, text_content AS text FROM cl_docs WHERE text_content IS NOT NULL')},
{_collection_sql('ca', 5, 3)}, {_collection_sql('cl', 6, 4)}, cx AS (SELECT plan_id, 0 AS kind, doc_id, body, place AS rank FROM ca_r UNION ALL SELECT plan_id, 1, doc_id, body, place FROM cl_r),
hy AS (SELECT plan_id AS question_id, 'hybrid' AS hit_stage, body AS answer FROM cx WHERE body IS NOT NULL AND {_STRIP % 'body'} <> '' QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY kind, rank, doc_id) = 1)
FROM c UNION ALL FROM ge UNION ALL FROM b UNION ALL FROM hy UNION ALL SELECT question_id, 'error', NULL FROM f4 WHERE question_id NOT IN (SELECT question_id FROM hy)"""
)
def cascade_answers(spark: SparkSession, d: str) -> DataFrame:
    """The whole cascade over the client's distinct questions: cache, classifier, gated BM25, then hybrid retrieval by plan.

    The cache answers only questions that open a session. The hybrid tier embeds questions and documents with the stand-in embedder.
    """
    f = table(spark, d, "client_frame").where("frame_type = 'question' AND text IS NOT NULL")
    opens = f.groupBy("session_id").agg(F.min("frame_id").alias("question_id")).select("question_id", F.lit(True).alias("opens"))
    asked = f.groupBy("text").agg(F.min("frame_id").alias("question_id")).select("question_id", F.col("text").alias("question"))
    asked = written(asked.join(opens, "question_id", "left"))
    qa = table(spark, d, "law_qa").where("question IS NOT NULL AND answer IS NOT NULL")
    known = qa.groupBy(T.compact_line(F.col("question")).alias("k")).agg(F.min_by("answer", "id").alias("answer"))

    def cache(q: DataFrame) -> DataFrame:
        return q.where("opens").withColumn("k", T.compact_line(F.col("question"))).join(known, "k")

    def general(q: DataFrame) -> DataFrame:
        return q.where(models.keyword_classifier([*_LEGAL, *SCENES])(F.col("question")) == 0).withColumn("answer", F.lit("（闲聊）"))

    def bm25(q: DataFrame) -> DataFrame:
        hits = retrieval.gated_top1(retrieval.bm25_top(q, qa, "question_id", "question", "id", "question", 2))
        return hits.withColumnRenamed("query_id", "question_id").join(qa.select(F.col("id").alias("doc_id"), "answer"), "doc_id")

    def hybrid(q: DataFrame) -> DataFrame:
        embed = models.hashed_embedder()
        plan = q.select(F.col("question_id").alias("plan_id"), models.clause_rewriter()(F.col("question")).alias("p"))
        subs = plan.select("plan_id", F.posexplode(T.split_queries(F.col("p.retrieval_queries"))).alias("query_no", "query")).withColumn("sub", F.concat_ws("#", "plan_id", "query_no"))
        asks = written(embed(subs, "sub", "query").join(subs.select(F.col("sub").alias("id"), "plan_id", "query_no"), "id").drop("id"))
        plans = plan.select("plan_id", F.col("p.rerank_query").alias("rerank_query"))
        found = None
        for kind, name, body, k, m in (("case", "law_cases", F.coalesce(F.nullif("parent_content", F.lit("")), "text_content"), 5, 3), ("clause", "law_clause", F.col("text_content"), 6, 4)):
            docs = table(spark, d, name)
            vectors = written(embed(docs.where("text_content IS NOT NULL"), "id", "text_content").withColumnRenamed("id", "doc_id"))
            content = docs.select(F.col("id").alias("doc_id"), F.col("text_content").alias("content"))
            best = retrieval.plan_contexts(retrieval.plan_hits(asks, vectors, k), content, plans, models.overlap_score()(F.col("rerank_query"), F.col("content")), m)
            part = best.join(docs.select(F.col("id").alias("doc_id"), body.alias("body")), "doc_id").select(F.col("plan_id").alias("query_id"), F.lit(kind).alias("kind"), "doc_id", F.col("final_rank").alias("rank"), "body")
            found = part if found is None else found.unionByName(part)
        return retrieval.capped_contexts(found).where("n = 1").select(F.col("query_id").alias("question_id"), F.col("body").alias("answer"))

    return cascade(asked, [("cache", cache), ("general", general), ("bm25", bm25), ("hybrid", hybrid)])
