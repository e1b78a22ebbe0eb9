from pyspark.sql import functions as F

from sedgewren.operators import chunking, cleaning, dataset, dedup, dialog, metrics, models, retrieval
from sedgewren.plans.cascade import cascade


def test_repeated_heads_need_a_page_number(spark):
    page = "一、婚姻纠纷\n12\n正文。\n"
    text = page * 6 + "孤立标题\n正文。\n" * 6 + "少见\n1\n" * 5 + "像句子。\n3\n" * 6
    lines = cleaning.document_lines(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t")
    assert {r["key"] for r in cleaning.repeated_head_lines(lines).collect()} == {"一、婚姻纠纷"}


def test_clean_text(spark):
    text = "标题甲\n1\n正文一。\n" * 6 + "\n\n第 3 页\n末行"
    got = {r["id"]: r["text"] for r in cleaning.clean_text(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").collect()}
    assert got == {1: "\n".join(["正文一。"] * 6) + "\n\n末行", 3: ""}


def test_dedup(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, k string")
    assert sorted(r["id"] for r in dedup.first_wins(rows, [F.col("k")], [F.col("id")]).collect()) == [1, 3, 5]
    old = spark.createDataFrame([(9, "b")], "id int, k string")
    assert sorted(r["id"] for r in dedup.insert_ignore(old, rows.where("k IS NOT NULL"), F.col("k"), [F.col("id")]).collect()) == [1]


def test_gate(spark):
    rows = [("one", 1, 30.0, 1), ("tie", 1, 30.0, 1), ("tie", 2, 30.0, 2), ("edge", 1, 22.0, 1), ("edge", 2, 17.0, 2), ("low", 1, 21.9, 1), ("near", 1, 30.0, 1), ("near", 2, 25.1, 2)]
    got = retrieval.gated_top1(spark.createDataFrame(rows, "query_id string, doc_id int, score double, rank int")).collect()
    assert {(r["query_id"], r["doc_id"]) for r in got} == {("one", 1), ("edge", 1)}


def test_bm25_handles_empty_and_unknown(spark):
    docs = spark.createDataFrame([(1, "房东不退押金"), (2, None), (3, ""), (4, "押")], "id int, t string").withColumn("term", F.lit(1)).withColumn("dl", F.lit(2))
    asked = spark.createDataFrame([(1, "押金"), (2, "xyz"), (3, None), (4, "押")], "id int, t string")
    got = retrieval.bm25_top(asked, docs, "id", "t", "id", "t", 3).collect()
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got} == {(1, 1, 1), (4, 4, 1)}
    assert retrieval.bm25_top(asked, docs.limit(0), "id", "t", "id", "t", 3).count() == 0 == retrieval.bm25_top(asked.limit(0), docs, "id", "t", "id", "t", 3).count()


def brute_bm25(texts, k1=1.5, b=0.75):
    import math
    from collections import Counter

    grams = {i: Counter([t[j : j + 2] for j in range(len(t) - 1)] or [t]) for i, t in texts.items()}
    mean = sum(sum(g.values()) for g in grams.values()) / len(grams)
    df = Counter(x for g in grams.values() for x in g)
    idf = {x: math.log((len(grams) - n + 0.5) / (n + 0.5)) for x, n in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {x: v if v >= 0 else low for x, v in idf.items()}
    share = lambda g, x: idf[x] * g[x] * (k1 + 1) / (g[x] + k1 * (1 - b + b * sum(g.values()) / mean))
    return {(q, d): sum(share(g, x) * n for x, n in grams[q].items() if x in g) for q in grams for d, g in grams.items() if grams[q].keys() & g.keys()}


def test_bm25_in_blocks_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    texts = {i: "".join(rng.choice("甲乙丙丁戊己") for _ in range(rng.randint(1, 12))) for i in range(120)}
    texts[120] = texts[121] = texts[3]
    want = brute_bm25(texts)
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    index = retrieval.written(retrieval.term_vectors(df, "id", "t"))
    one = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25_top(df, df, "id", "t", "id", "t", 200).collect()}
    assert one.keys() == want.keys() and all(abs(one[p] - want[p]) < 1e-6 for p in want)
    best = retrieval.bm25_top(df, df, "id", "t", "id", "t", 4).collect()
    for q in texts:
        order = sorted((-round(one[p], 9), p[1]) for p in one if p[0] == q)[:4]
        assert [(r["doc_id"], r["rank"]) for r in sorted(best, key=lambda r: r["rank"]) if r["query_id"] == q] == [(d, i + 1) for i, (_, d) in enumerate(order)]
    asked = index.select(F.col("doc_id").alias("query_id"), F.explode("term").alias("term"), F.lit(1.0).alias("w"))
    rows = [{tuple(r) for r in retrieval.sparse_search(index, asked, 3, block_queries=n).collect()} for n in (7, 1000)]
    assert rows[0] == rows[1]


def test_dense_top_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((300, 8))
    x[10] = x[20]
    rows = [(f"{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("null", None), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("short", [1.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>").withColumn("query_id", F.lit("x"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    for block in (64, 10_000):
        got = retrieval.dense_top(df, df, "id", "v", "id", "v", 3, block=block).where("query_id <> 'short'").collect()
        near = {}
        for r in got:
            near.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
        assert len(near) == 300
        for i in range(300):
            assert near[f"{i:03d}"] == {k + 1: f"{j:03d}" for k, j in enumerate(sorted(range(300), key=lambda j: (-s[i, j], j))[:3])}
    assert retrieval.dense_top(df.limit(0), df, "id", "v", "id", "v", 3).count() == 0


def test_plan_with_short_and_repeated_lists(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0], {1: 1.0}, "甲"), ("b", [0.9, 0.1], {2: 1.0}, "甲"), ("c", [0.0, 1.0], {1: 0.5}, "乙"), ("d", None, None, None)], "doc_id string, dense array<double>, sparse map<int,double>, content string")
    asks = spark.createDataFrame([(1, 0, [1.0, 0.0], {1: 1.0}), (1, 1, [0.0, 1.0], {2: 1.0}), (2, 0, None, None)], "plan_id int, query_no int, dense array<double>, sparse map<int,double>")
    plans = spark.createDataFrame([(1, "q"), (2, "q")], "plan_id int, rerank_query string")
    got = retrieval.plan_contexts(retrieval.plan_hits(asks, docs, 2), docs, plans, F.length("content"), 3).collect()
    assert {(r["plan_id"], r["doc_id"], r["rerank_score"]) for r in got} == {(1, "a", None), (1, "c", None)}
    assert retrieval.at_least(2, 5) == 5 == retrieval.at_least(None, 5) and retrieval.at_least(9, 5) == 9


def test_fusion_and_rerank(spark):
    d = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8)], "query_id int, doc_id string, score double")
    s = spark.createDataFrame([(1, "b", 1.0), (1, "c", 0.5)], "query_id int, doc_id string, score double")
    got = [(r["doc_id"], round(r["score"], 6)) for r in retrieval.fused(d, s, 3).orderBy("rank").collect()]
    assert got == [("b", 1.5), ("a", 0.9), ("c", 0.35)]
    hits = spark.createDataFrame([(1, 0, 1, "a", 1.0), (1, 0, 2, "b", 3.0), (1, 0, 3, "c", 2.0), (2, 0, 1, "x", 1.0)], "plan_id int, query_no int, rank int, doc_id string, w double")
    got = [(r["plan_id"], r["doc_id"], r["rerank_score"]) for r in retrieval.reranked(hits, F.col("w"), 2).orderBy("plan_id", "final_rank").collect()]
    assert got == [(1, "b", 3.0), (1, "c", 2.0), (2, "x", None)]


def test_history(spark):
    rows = [("s", i, "user" if i % 2 else "assistant", "字" * 400) for i in range(1, 11)] + [("s", 11, "user", "新" * 1600), ("s", 12, "system", "x"), ("s", 13, "user", "  "), ("t", 1, "user", "甲")]
    got = dialog.trimmed_history(spark.createDataFrame(rows, "session_id string, pos int, role string, content string")).orderBy("session_id", "pos").collect()
    assert [(r["session_id"], r["pos"]) for r in got] == [("s", 11), ("t", 1)]
    h = spark.createDataFrame([([("user", "问"), ("tool", "x"), ("assistant", " "), ("assistant", "长" * 500)],), ([],)], "h array<struct<role string, content string>>")
    a, b = (r[0] for r in h.select(dialog.history_text(F.col("h"))).collect())
    assert a == "用户：问\n助手：" + "长" * 400 + "…" and b == "无"


def test_stratified_split_is_complete_and_disjoint(spark):
    rows = [(f"{'长' * n}{i}", i % 2) for n in (3, 10, 20, 45) for i in range(25)] + [("独", 1)]
    got = dataset.stratified_split(spark.createDataFrame(rows, "text string, label int")).collect()
    assert len(got) == len(rows) == len({r["text"] for r in got})
    assert {r["part"] for r in got} == {"train", "dev", "test"}
    assert [r["part"] for r in got if r["text"] == "独"] in (["test"], ["train"], ["dev"])


def test_rewrite_problems(spark):
    rows = [("我的押金被房东扣了怎么办", "短", "too_short"), ("问" * 20, "改" * 61, "too_long"), ("押金被房东扣留不退我应该怎么办才好呢", "押金被房东扣留不退我应该怎么办才好", "copied"), ("押金被扣怎么办呢", "请问押金被扣怎么办", "copied_share"), ("我的押金被房东扣了怎么办", "租房保证金遭拒退如何处理", "")]
    df = spark.createDataFrame(rows, "a string, b string, want string").select(dataset.rewrite_problem(F.col("a"), F.col("b")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_metrics_skip_null_and_nan(spark):
    rows = spark.createDataFrame([(None, 0.5, None), ("a", float("nan"), None), ("a", 0.25, None)], "g string, m double, n double")
    got = {r["metric"]: (r["mean"], r["n"]) for r in metrics.metric_summary(rows, ["m", "n"]).collect()}
    assert got == {"m": (0.375, 2), "n": (None, 0)}
    assert {(r["g"], r["n"], r["m"]) for r in metrics.group_means(rows, "g", ["m"]).collect()} == {("unknown", 1, 0.5), ("a", 2, 0.25)}
    one_class = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    assert [(r["label"], r["precision"], r["recall"]) for r in metrics.classification_report(one_class, "y", "p").collect()] == [(0, 0.5, 1.0), (1, 0.0, 0.0)]


LAW = "测试法\n目 录\n第一章 总则……1\n第一条 ……2\n第一编 总 则\n第一章 一般规定\n第一条　为了测试，制定本法。\n第二款内容。\n第二条 " + "很长的条文。" * 200 + "\n第二章 附则\n第三条 自公布之日起施行。"


def test_law_chunks(spark):
    docs = spark.createDataFrame([("a.docx", "law", LAW), ("b", "law", None), ("c", "poem", "x"), ("d", "law", "")], "source string, doc_type string, text string")
    got = chunking.chunk_documents(docs).orderBy("source", "chunk_no").collect()
    a = [r for r in got if r["source"] == "a.docx"]
    assert [r["article_no"] for r in a] == ["第一条", "第二条", "第二条", "第三条"]
    assert a[0]["path"] == ["第一编 总 则", "第一章 一般规定"] and a[0]["text"].endswith("第二款内容。")
    assert a[2]["text"].startswith("第二条（续）") and a[1]["extra"]["part"] == "1/2" and a[3]["path"] == ["第一编 总 则", "第二章 附则"]
    assert [r["error"] for r in got if r["source"] == "c"] == ["KeyError: 'poem'"] and not [r for r in got if r["source"] in "bd"]


def test_case_chunks():
    text = "一、婚姻家庭纠纷\n（一）离婚纠纷\n1\n第一个\n标题\n——甲诉乙案\n【案件基本信息】\n1. 案由：离婚\n【基本案情】①\n事实。\n① 脚注\n7\n第二个标题\n【案件基本信息】\n信息\n【法官后语】\n" + "评论。" * 500
    got = chunking.case_chunks(text)
    assert [(c["case_no"], c["section"]) for c in got[:4]] == [("1", "案件基本信息"), ("1", "基本案情"), ("2", "案件基本信息"), ("2", "法官后语")]
    assert got[0]["case_title"] == "第一个标题" and got[0]["case_subtitle"] == "——甲诉乙案" and got[0]["path"] == ["一、婚姻家庭纠纷", "（一）离婚纠纷"]
    assert got[2]["extra"]["printed_case_no"] == "7" and "脚注" not in got[1]["text"] and got[4]["text"].startswith("【法官后语】（续）")
    assert chunking.case_chunks("没有锚点") == []


def test_recursive_split_keeps_everything():
    text = "甲乙丙。" * 100
    parts = chunking.recursive_split(text, 50, ["。"])
    assert "".join(parts) == text and max(map(len, parts)) <= 50
    assert chunking.recursive_split("x" * 120, 50, ["。"]) == ["x" * 50, "x" * 50, "x" * 20]


def test_cascade_answers_each_question_once(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "question_id int, question string")
    tiers = [("cache", lambda x: x.where("question = 'a'").withColumn("answer", F.lit("A"))), ("bm25", lambda x: x.where("question <> 'c'").withColumn("answer", F.lit("B")))]
    assert {(r[0], r[1], r[2]) for r in cascade(q, tiers).collect()} == {(1, "cache", "A"), (2, "bm25", "B"), (3, "error", None)}


def test_model_stand_ins(spark):
    df = spark.createDataFrame([("押金不退怎么办", "押金")], "a string, b string")
    r = df.select(models.overlap_score()(F.col("b"), F.col("a")).alias("s"), models.binary_softmax(F.lit(0.0), F.lit(0.5)).alias("p")).first()
    assert r["s"] == 1.0 and r["p"]["label"] == 1 and r["p"]["low_confidence"]


def test_embedder(spark):
    df = spark.createDataFrame([(1, "押金不退怎么办"), (2, None), (3, " "), (4, "押"), (5, "押 金不退怎么办")], "id int, t string")
    got = {r["id"]: r for r in models.hashed_embedder(8)(df, "id", "t").collect()}
    assert len(got[1]["dense"]) == 8 and sum(got[1]["dense"]) == 6 and got[1]["dense"] == got[5]["dense"]
    assert abs(sum(v * v for v in got[1]["sparse"].values()) - 1) < 1e-9 and got[2]["sparse"] == {} and sum(got[3]["dense"]) == 0 and sum(got[4]["dense"]) == 1


def test_routes_of_the_rewriter(spark):
    rows = [("押金能退吗",), ("房东不退我的押金，我应该向谁投诉呢？",), ("很" * 61,), ("房东不退我的押金怎么办",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string").select(models.clause_rewriter()(F.col("q"))["route"]).collect()]
    assert got == ["recall", "subquery", "hyde", "direct", None]


def test_generated_answers(spark):
    def model(prompt):
        if "坏" in prompt:
            raise ValueError("no")
        return "" if "空" in prompt else "第一句。第二句？尾"

    rows = [(1, "好"), (2, "坏"), (3, "空"), (4, None)]
    pieces = models.generated(spark.createDataFrame(rows, "id int, prompt string"), model, "id", "prompt")
    got = {r["id"]: (r["answer"], r["status"]) for r in models.whole_answers(pieces).collect()}
    assert got == {1: ("第一句。第二句？尾", "ok"), 2: ("", "error"), 3: ("", "error"), 4: ("", "error")}
    errors = {r["id"]: r["error"] for r in pieces.where("status = 'error'").collect()}
    assert errors == {2: "ValueError: no", 3: "empty answer", 4: "no prompt"}
    cut = models.whole_answers(pieces.where("id = 1 AND seq < 2")).first()
    assert cut["status"] == "open" and models.quoting_generator()("资料： 甲\n乙") == "甲" and models.quoting_generator()("x") == ""


def test_trained_classifier(spark):
    rows = [(f"押金合同纠纷怎么起诉{i}", 1) for i in range(40)] + [(f"今天天气真好啊{i}", 0) for i in range(40)] + [(None, 1), ("x", 7)]
    model = models.trained_classifier(spark.createDataFrame(rows, "text string, label int"), features=1 << 10, regularisation=(0.01,), folds=2)
    got = model.transform(models.with_pairs(spark.createDataFrame([("合同纠纷起诉",), ("天气好",)], "text string"))).select("prediction").collect()
    assert [r[0] for r in got] == [1.0, 0.0]


def test_judge_aggregations(spark):
    v = spark.createDataFrame([("a", True), ("a", False), ("b", None)], "qa_id string, ok boolean")
    assert {(r[0], r[1]) for r in metrics.covered_share(v, "qa_id", "ok", "context_recall").collect()} == {("a", 0.5), ("b", None)}
    c = spark.createDataFrame([("a", "TP", 0.8), ("a", "FN", None), ("b", "FP", None)], "qa_id string, verdict string, similarity double")
    assert {(r[0], r[1]) for r in metrics.answer_correctness(c).collect()} == {("a", 0.7), ("b", 0.0)}
    g = spark.createDataFrame([("a", 0.5, False), ("a", 0.7, True), ("b", 0.9, True)], "qa_id string, similarity double, evasive boolean")
    assert {(r[0], r[1]) for r in metrics.answer_relevancy(g).collect()} == {("a", 0.6), ("b", 0.0)}


def test_lookup_refuses_unknown_tables(spark):
    import pytest

    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    keys = spark.createDataFrame([("t", 1), ("t", 1), ("t", 9)], "table_name string, id int")
    assert [tuple(r) for r in dedup.lookup(keys, {"t": rows}).select("table_name", "id", "text").collect()] == [("t", 1, "x")]
    with pytest.raises(ValueError):
        dedup.lookup(keys, {"u": rows})


def test_cleaning_with_patterns_and_self_repeat(spark):
    text = "甲乙\n5\n正文\n" * 2 + "附：表\n末"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert cleaning.clean_text(df, "id", "t", patterns=("^附：",)).first()["text"] == "甲乙\n正文\n甲乙\n正文\n末"
    assert cleaning.clean_text(df, "id", "t", min_repeat=2).first()["text"] == "附：表\n末"
    names = cleaning.named_laws(spark.createDataFrame([(1, "测试条例\nx", "a.docx"), (2, "x", "d/某法.pdf"), (3, None, None)], "id int, t string, s string"), "id", "t", "s")
    assert {r["id"]: r["law_name"] for r in names.collect()} == {1: "测试条例", 2: "某法", 3: None}


def test_line_kinds():
    from sedgewren.operators.lines import is_dotted, is_noise, kind_of, running_heads

    kinds = {"第一编 总则": "heading", "第十条 内容": "article", "第条": "plain", "【基本案情】①": "section", "【其他】": "plain", "12": "number", "12345": "plain", "——甲诉乙": "subtitle", "———": "plain", "（一）离婚": "cause", "一、婚姻家庭纠纷": "chapter", "一、婚姻": "plain", "3. 标题": "numbered", "": "plain"}
    assert {k: kind_of(k).name for k in kinds} == kinds
    assert is_dotted("总则……1") and is_dotted("x..") and not is_dotted("总则.1")
    assert [is_noise(x) for x in ("第 3 页", "-- Page (2) --", "①", "2020 年 5 月", "中国法院2020年度案例·x", "中国法院", "正文")] == [True, True, True, True, True, False, False]
    assert running_heads(["书名", "1", "第一条 x", "1"] * 6) == {"书名"}


def test_case_book_furniture_is_removed():
    text = "书名\n3\n题目\n【案件基本信息】\n甲\n" + "书名\n4\n内容。\n" * 6
    got = chunking.case_chunks(text)
    assert len(got) == 1 and "书名" not in got[0]["text"] and got[0]["text"].count("内容。") == 6


def test_volumes_are_bounded(spark):
    rows = [(i, "s", "law", f"第{'一' * 1}条 内容{i}") for i in range(10)] + [(11, "s", "law", None), (12, None, "law", "x")]
    got = chunking.volumes(spark.createDataFrame(rows, "id int, source string, doc_type string, text_content string"), span=4).collect()
    assert sorted((r["source"] or "", r["volume"], len(r["text"].split("\n"))) for r in got) == [("", 3, 1), ("s", 0, 4), ("s", 1, 4), ("s", 2, 2)]


def test_stratified_split_equals_ranking(spark):
    import hashlib

    rows = [(f"问题{i}", 1) for i in range(3000)]
    got = {r["text"]: r["part"] for r in dataset.stratified_split(spark.createDataFrame(rows, "text string, label int")).collect()}
    order = sorted(got, key=lambda t: hashlib.md5(f"42_{t}".encode()).hexdigest())
    # strata by length: 3..6 characters all are the shortest band
    assert [got[t] for t in order] == ["train"] * 2400 + ["dev"] * 300 + ["test"] * 300


def test_chunk_format(spark):
    import pytest

    docs = spark.createDataFrame([("a", "law", "第一条 内容。"), ("b", "x", "y")], "source string, doc_type string, text string")
    made = chunking.chunk_documents(docs)
    chunking.assert_chunk_format(made)
    assert {(r["chunk_type"], r["n"]) for r in chunking.chunk_summary(made).collect()} == {("article", 1), ("error", 1)}
    with pytest.raises(ValueError):
        chunking.assert_chunk_format(made.drop("path"))


def test_close_pairs_equal_all_totals():
    import numpy as np

    rng = np.random.default_rng(4)
    key = np.unique(rng.integers(0, 40, 700) * 300 + np.minimum(rng.geometric(0.02, 700), 299))
    number, term, weight = key // 300, key % 300 * 7, rng.standard_normal(len(key)) * 5
    block = retrieval._Block(40, term, number, weight, dense=20)
    doc, held = np.repeat(np.arange(90), 30), rng.random(2700)
    entries = block.known(np.concatenate([rng.choice(310, 30, replace=False) * 7 for _ in range(90)]), doc, held)
    total, seen = block.totals(np.arange(40), 90, *entries)
    for place in (1, 30):
        least = np.sort(total, axis=1)[:, -place]  # ties with the least score count
        q, c, units = block.close(least, np.ones(40, bool), 90, *entries)
        assert set(zip(q, c, units)) == {(i, j, total[i, j]) for i, j in zip(*np.nonzero(seen & (total >= least[:, None])))}
