"""Every operator on nulls, empty and very long texts, repeats, empty tables and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from sedgewren.llm import language, mixing, near_pairs, neighbours, packing, page_noise, pair_defects, personal, site_lines, split_overlap

LONG = "很长的文本，包含数字12345和标点。" * 3_000


def clash(df):
    """Extra columns under names that the operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("h", "class_id", "folded", "copies", "size", "side", "tokens_", "n", "bits", "word", "opening", "template", "v", "cell", "place", "t", "l", "i", "have") if c not in df.columns})


def test_site_lines(spark):
    rows = [(i, f"分享到 微信\n正文{i}的内容\n​分享到微信 ", "s") for i in range(6)] + [(10, None, "s"), (11, "", "s"), (12, LONG, "s"), (13, "分享到微信", None), (14, "【基本案情】\n短", "s"), (15, "x" * 10, "u")]
    df = clash(spark.createDataFrame(rows, "id int, text_content string, source string"))
    assert {(r[0], r[1]) for r in site_lines.repeated_lines(df).collect()} == {(i, k) for i in range(6) for k in (1, 3)}
    got = {r["id"]: r["text_content"] for r in site_lines.strip_repeated_lines(df).collect()}
    assert got[0] == "正文0的内容" and got[10] is None and got[11] == "" and got[12] == LONG and got[13] == "分享到微信" and len(got) == len(rows)
    assert site_lines.strip_repeated_lines(df.limit(0)).count() == 0


def test_near_pairs(spark):
    q = "我在某市租了一套房押金一直不退该怎么办"
    rows = [(1, q), (2, q), (3, q + "呢"), (4, None), (5, ""), (6, "短"), (7, LONG), (8, LONG + "尾"), (9, "完全不同的另外一个问题没有重叠"), (10, "😀😁😂🤣" + q), (11, "😀😁😂🤣" + q)]
    df = clash(spark.createDataFrame(rows, "id int, question string"))
    want = {(1, 2), (1, 3), (2, 3), (7, 8), (10, 11)} | {(a, b) for a in (1, 2, 3) for b in (10, 11)}
    sets = {i: {f[k : k + 3] for k in range(len(f) - 2)} for i, f in ((i, near_pairs.fold(t)) for i, t in rows)}
    want = {(a, b) for a, b in want if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in near_pairs.near_pairs(df).collect()} == want
    groups = {r["id"]: r for r in near_pairs.near_groups(df).collect()}
    assert len(groups) == len(rows) and groups[2]["class_id"] == 1 and groups[2]["copies"] == 4 and groups[4]["links"] == 0
    assert {tuple(r) for r in near_pairs.near_pairs(df, most_copies=1).collect()} >= {(1, 2), (1, 3)}
    assert near_pairs.near_pairs(df.limit(0)).count() == 0


def test_near_pairs_cuts_frequent_tiles(spark):
    rows = [(i, f"公共开头的一段文字{chr(0x4E00 + i)}{chr(0x5E00 + i)}") for i in range(60)] + [(100 + i, f"公共开头的一段文字{chr(0x4E00 + i)}{chr(0x5E00 + i)}吧") for i in range(60)]
    df = spark.createDataFrame(rows, "class_id int, folded string")
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in rows}
    want = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b])}
    order = near_pairs.sequence_counts(df.select("folded"))
    for block in (50_000, 7):
        assert {tuple(r) for r in near_pairs.near_classes(df, order, block=block).collect()} == want


def test_pair_defects(spark):
    q = "房东一直不退押金，我已经搬走三个月了，应该怎么办？"
    rows = [
        (1, q, None, "empty_answer"), (2, q, " ", "empty_answer"), (3, q, "……", "empty_answer"), (4, q, "N/A", "empty_answer"),
        (5, q, q, "copied_question"), (6, q, "抱歉，我无法回答这个问题。", "refusal"), (7, q, "I'm sorry, but I can't help with that.", "refusal"),
        (8, q, "The tenant may request the deposit back within thirty days.", "other_language"), (9, q, "敷金は返還されるべきものであると考えます。", "other_language"),
        (10, q, "可以起诉，但是，如果", "truncated_answer"), (11, q, "依照《住宅租赁管理", "truncated_answer"), (12, q, "应当返还。可以先协商，协商不成再起诉。", None),
        (13, None, "应当返还押金，建议先协商。", None), (14, q, q + "可以要求返还押金，并要求支付利息，建议先发送书面通知，协商不成的再向法院起诉。", None), (15, q, LONG, None), (16, q, "抱歉，久等了。押金应当在交还房屋后返还，可以要求对方支付利息。", None),
    ]
    # templates have to recur over questions that have nothing in common
    asked = ["公司拖欠工资能不能仲裁？", "邻居装修漏水由谁赔偿？", "网购的手机是翻新机怎么维权？", "五年前的借款诉讼时效还在吗？", "合伙分红一直不给怎么办？"]
    for i, other in enumerate(asked):
        rows += [(100 + i, other, "抱歉，我无法回答这个问题。", "refusal"), (110 + i, other, "I'm sorry, but I can't help with that.", "refusal")]
        rows += [(120 + 10 * k + i, other, t, None) for k, t in enumerate(("由出租人承担。", "应当先申请调解。", "可以主张，建议尽快起诉。", "需要看合同中是否约定了期限。"))]
    df = clash(spark.createDataFrame([r[:3] for r in rows], "id int, question string, answer string"))
    got = {r["id"]: r["defect_type"] for r in pair_defects.pair_defects(df).collect()}
    assert {i: got.get(i) for i, *_ in rows} == {r[0]: r[3] for r in rows}
    assert pair_defects.pair_defects(df.limit(0)).count() == 0


REFUSED = ["房东不退押金怎么办？", "公司拖欠工资能不能仲裁？", "邻居装修漏水由谁赔偿？", "网购的手机是翻新机怎么维权？", "五年前的借款还能要吗？", "合伙分红一直不给怎么办？"]


def template_rows():
    """Refusals of several wordings and sound short answers, each over questions that have nothing in common."""
    refusals = ["抱歉，这件事只能由您自己拿主意。", "对不起，出于合规要求，这件事只能由您自己拿主意。", "很遗憾，出于合规要求，本栏目给不了您说法。", "出于合规要求，这件事只能由您自己拿主意。"]
    sound = ["由出租人承担。", "应当先申请调解。", "可以主张，建议尽快起诉。", "需要看合同中是否约定了期限。", "应当返还，并支付利息。", "不能，应先申请调解。", "押金应当在交还房屋后三十日内返还，可以要求对方支付利息。", "违约金明显过高的，可以请求适当减少。", "调解不成的，可以凭合同直接起诉。"]
    sound += ["一方未按约支付的，另一方有权请求继续履行。", "时效从知道权利受损之日起算，书面催告会引起中断。", "举证责任由主张权利的一方承担，交付记录尤为重要。", "应核对印章备案情况与经办人的授权范围。", "之后发生的费用，应由实际使用的一方负担。"]
    out = [(10 * k + i, q, t, "refusal") for k, t in enumerate(refusals) for i, q in enumerate(REFUSED)]
    out += [(1000 + 10 * k + i, q, t, None) for k, t in enumerate(sound) for i, q in enumerate(REFUSED)]
    substance = "押金应当在交还房屋后三十日内返还，可以要求对方支付利息。"
    return out + [(2000 + i, q, f"抱歉，这件事只能由您自己拿主意。{substance}", None) for i, q in enumerate(REFUSED)]


def test_refusals_need_neither_list_nor_apology(spark, monkeypatch):
    import re

    monkeypatch.setattr(pair_defects, "DECLINE", re.compile(r"$^"))
    rows = template_rows()
    df = spark.createDataFrame([r[:3] for r in rows], "id int, question string, answer string")
    got = {r["id"]: r["defect_type"] for r in pair_defects.pair_defects(df).collect()}
    assert {i: got.get(i) for i, *_ in rows} == {r[0]: r[3] for r in rows}


def test_clause_clusters_in_blocks(spark):
    texts = [f"我不便就{a}事项发表任何看法和意见以及任何其他建议" for a in "甲乙丙丁戊己庚辛"] + ["完全不同的一句话", "另外一句毫不相干的话"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "clause string, prompts long")
    for block in (1000, 3):
        got = {r["clause"]: r["leader"] for r in pair_defects.clause_clusters(df, 0.6, block).collect()}
        assert set(got) | set(got.values()) == set(texts[:8])


def test_clause_clusters_meet_over_all_blocks(spark, monkeypatch):
    import numpy as np

    # one band of all clauses
    monkeypatch.setattr(pair_defects, "BANDS", 1)
    monkeypatch.setattr(pair_defects, "_signatures", lambda texts, hashes=3: np.zeros((len(texts), hashes), np.uint64))
    base = "关于您所反映的这一具体情况本栏目经过研究后依照有关规定不便发表任何看法和意见以及其他任何形式的建议"
    signs = "松柏桐楠江河湖海琴棋书画梅兰竹菊东南西北金银铜铁春夏秋冬红黄蓝绿鱼虾蟹贝风雨雷电"
    marks = [signs[i : i + 2] + signs[-1 - i] + signs[(7 * i) % len(signs)] for i in range(len(signs) - 1)]
    texts = [f"{m[:2]}{base[:12]}{m}{base[12:24]}{m[::-1]}{base[24:36]}{m[2:]}{base[36:]}" for m in marks]
    pairs = [(t, t + "啊") for t in texts[::12]]
    df = spark.createDataFrame([(t, 5) for t in [*texts, *(b for _, b in pairs)]], "clause string, prompts long")
    for block in (1000, 2):
        got = {r["clause"]: r["leader"] for r in pair_defects.clause_clusters(df, 0.9, block).collect()}
        assert got == {b: a for a, b in pairs}, block


def test_templates_are_learnt_from_all(spark):
    refusing = [f"本栏目{a}给不了您{b}" for a in ("今日", "一向", "现在", "确实", "目前") for b in ("说法", "结论", "主意", "准信")]
    sound = [f"应当{a}{b}" for a in "依法 按时 先行 及时 主动 书面 如实 足额 全部 逐月".split() for b in "起诉 返还 催告 举证 履行 赔偿 登记 公示 协商 调解".split()]
    marked = spark.createDataFrame([(t, 1, 3) for t in refusing] + [(t, 0, 9) for t in sound], "leader string, y int, rows long")
    sharded = pair_defects.template_shards(marked, {0: len(sound), 1: len(refusing)}, 25).collect()
    assert {(r["leader"], r["y"]) for r in sharded} == {(r["leader"], r["y"]) for r in marked.collect()}
    assert {r["shard"] for r in sharded if r["y"] == 1} == {r["shard"] for r in sharded if r["y"] == 0} == {0, 1, 2, 3}
    model = pair_defects.fit_templates(marked, 25)
    assert (model.probabilities(refusing)[:, 1] >= 0.5).all() and (model.probabilities(sound)[:, 1] < 0.5).all()
    one = pair_defects.fit_templates(marked, 1000)
    assert (one.probabilities(refusing)[:, 1] >= 0.5).all() and pair_defects.fit_templates(marked.where("y = 1")) is None


def test_clauses_of_longer_answers_are_clustered(spark):
    # each wording stands once, in an answer of three sentences; only together do they recur
    said = [f"关于{a}的事项出于合规要求本栏目无法向您提供更多说明此事只能由您自己拿主意" for a in "甲乙丙丁戊己"]
    df = spark.createDataFrame([(i, q, f"{t}。请按程序办理。之后会有通知。") for i, (q, t) in enumerate(zip(REFUSED, said))], "id int, question string, answer string")
    _, templates = pair_defects.refusing_templates(pair_defects.opening_clauses(df), pair_defects.clause_company(df))
    assert {r["clause"] for r in templates.collect()} == {*said, "请按程序办理"}


def test_sentences_mask_only_what_can_match(monkeypatch):
    text = "但是，依照《住宅租赁管理条例》第十二条， So  what，应于2020年3月退还。。\n ，！But 请协商；房东应当先行告知"
    want = [["是", "依照《》第#条", "what", "应于#年#月退还"], ["请协商"], ["房东应当先行告知"]]
    assert pair_defects.sentences(text.replace("十二", "12")) == want
    assert [pair_defects._brief(text, k) for k in (2, 3)] == [False, True] and pair_defects._brief("，。\n", 0)
    # no expression for numbers, titles or connectives walks through a clause that can't hold them
    for name in ("NUMBERS", "TITLES", "_CONNECTIVE"):
        monkeypatch.setattr(pair_defects, name, None)
    assert pair_defects.sentences("押金应当退还，请先协商。可以起诉。", 1) == [["押金应当退还", "请先协商"]]


def test_few_and_many_leaders_lead_alike(monkeypatch):
    block = [f"{a}方要求我们赔偿{b}元损失并且支付利息" for a in "甲乙丙丁戊" for b in "天地玄黄宇宙洪荒"] + [chr(0x4E00 + i) * 3 + "不同的事项" for i in range(20)]
    few = list(pair_defects._led(block, 0.7))
    for most in (0, 1000):
        monkeypatch.setattr(pair_defects, "_FEW", most)
        assert list(pair_defects._led(block, 0.7)) == few


def texts_with_names():
    names = ["阮栎蘅", "欧阳若", "裴珩屿", "陆沅", "温聆晚", "司徒澜", "孟清岚", "秦若棣", "赵岚玥", "乔霁"]
    out = []
    for k in range(40):
        n, m = names[k % 10], names[(k + 3) % 10]
        out.append(f"委托代理人{n}，联系电话：138{k:04d}5678。被告{m}，公民身份号码110101199{k % 10}0307{k:03d}X。合同编号2016{k:04d}3639866168。")
        out.append(f"我叫{n}，邮箱ab.c{k}@mail.example，住在江川市南山区长宁路{k + 1}号。发票代码3701854310{k:02d}。我应该向清川市南山县人民法院起诉。")
    return out


def test_personal(spark):
    sample = texts_with_names()
    model = personal.fit_personal_model(sample)
    text = "委托代理人裴珩屿，联系电话：13812345678，邮箱ab@c.example，住在江川市南山区长宁路7号。合同编号201603723639866168。李某甲未到庭。"
    rows = [(1, text), (2, None), (3, ""), (4, LONG), (5, text)]
    df = clash(spark.createDataFrame(rows, "id int, text string"))
    got = {(r["row_id"], r["pii_type"], r["start_pos"]) for r in personal.personal_spans(df, model, "text").collect()}
    want = {("name", text.index("裴") + 1), ("phone", text.index("138") + 1), ("email", text.index("ab@") + 1), ("address", text.index("江川") + 1)}
    assert {g for g in got if g[0] in (1, 5)} == {(i, k, p) for i in (1, 5) for k, p in want} and not [g for g in got if g[0] in (2, 3, 4)]
    red = {r["id"]: r["text"] for r in personal.redacted(df, model, ["text"]).collect()}
    assert red[1] == "委托代理人<name>，联系电话：<phone>，邮箱<email>，住在<address>。合同编号201603723639866168。李某甲未到庭。"
    assert red[2] is None and red[3] == "" and red[4] == LONG
    empty = spark.createDataFrame([], "id int, text string")
    assert personal.personal_spans(empty, personal.personal_model([empty.select("text")]), "text").count() == 0


def test_personal_thresholds_follow_the_precision():
    import numpy as np

    from sedgewren.llm.boosting import BoostedTrees

    rng = np.random.default_rng(0)
    x = rng.random((4000, 1))
    y = (rng.random(4000) < x[:, 0]).astype(int)
    low, high = (BoostedTrees().fit(x, y, p).threshold for p in (0.6, 0.9))
    assert 0.3 <= low < high <= 0.9
    model = personal.fit_personal_model(texts_with_names() * 2)
    assert set(model.trees) == set(personal.TYPES) == set(model.threshold)


def test_personal_model_rests_on_all_rows(spark):
    texts = [f"{t}事项{k}。" for t in texts_with_names() for k in range(100)]
    whole = personal.fit_personal_model(texts)
    model = personal.personal_model([spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")])
    assert model.places["江川市"] == sum("江川市" in t for t in texts) and {k: whole.places[k] for k in model.places} == model.places
    assert (model.surname, model.given, model.left, model.right) == (whole.surname, whole.given, whole.left, whole.right)
    assert set(model.trees) == set(personal.TYPES) and model.threshold == pytest.approx(whole.threshold)


def test_personal_bounds_of_addresses_and_mail():
    model = personal.fit_personal_model(texts_with_names())
    texts = ["我住在江川市南山区长宁路88号，门口有树。", "邮箱ab.c77@mail.example。谢谢。", "长宁路88号没有写明。"]
    got = {(k, texts[r][a:b]) for r, k, a, b in personal._judge(texts, model) if k in ("address", "email")}
    assert got == {("address", "江川市南山区长宁路88号"), ("email", "ab.c77@mail.example")}


def test_personal_names_of_common_and_new_characters():
    names = ["陈以若", "赵以朔", "岑栎", "晏霁以", "裴珩屿", "陆沅", "温聆晚", "孟清岚", "秦若棣", "乔霁"]
    sample = texts_with_names() + [f"委托代理人{n}，联系电话：139{k:04d}5678。" for k in range(12) for n in names]
    sample += [f"当事人可以协商，也可以起诉，以书面形式提出，{k}日以内付款，以合同为准，予以支持，所以任何一方可以解除。" * 6 for k in range(400)]
    model = personal.fit_personal_model(sample)
    texts = ["我叫裴以汀，电话不便提供。", "委托代理人岑以珩，其余不详。", "被告郭婧雯，住所不详。", "当事人可以付款，任何一方以书面形式提出，张贴以上公告。"]
    got = {(r, texts[r][a:b]) for r, kind, a, b in personal._judge(texts, model) if kind == "name"}
    assert got == {(0, "裴以汀"), (1, "岑以珩"), (2, "郭婧雯")}


def test_personal_names_without_given_name_and_around_breaks():
    # family names of two characters that begin with another family name
    assert not personal.observed(["告知夏侯，钟离。"])
    seen = personal.observed(["夏\n侯明。", "被告王小\n\n\n\n公司", "我叫欧阳\n明\n华，", "李\0王明\0公司", "原告张某某"])
    assert {(k[1] + k[2], k[6], k[7]): n for k, n in seen.items() if k[0] == "name"} == {
        ("夏侯明", "0", "0"): 1, ("侯明", "0", "0"): 1, ("王小", "1", "1"): 1, ("欧阳明", "1", "0"): 1, ("欧阳明华", "1", "0"): 1, ("王明", "0", "1"): 1, ("张某", "1", "1"): 1, ("张某某", "1", "1"): 1,
    }


def test_personal_names_are_searched_in_arrays():
    import cProfile
    import pstats

    def calls(f):
        profile = cProfile.Profile()
        profile.runcall(f)
        return pstats.Stats(profile).total_calls

    model = personal.fit_personal_model(texts_with_names())
    few, many = (["会上，王小明与李小刚先后发言。" * k] * 50 for k in (1, 40))
    # 3,900 names more in the same texts must not cost a call each
    assert calls(lambda: personal.observed(many)) - calls(lambda: personal.observed(few)) < 2_000
    assert calls(lambda: list(personal._judge(many, model))) - calls(lambda: list(personal._judge(few, model))) < 2_000


def test_cross_split(spark):
    a = "邻居在市里私搭棚子物业不管合法吗"
    rows = [(1, a + "？", "train", 1, "x"), (2, a, "dev", 0, None), (3, a + "呀", "test", 1, "y"), (4, None, "dev", 1, "x"), (5, "谢谢", "dev", 1, "x"), (6, "谢谢", "train", 1, "x"), (7, LONG, "train", 1, "x"), (8, LONG[:-3], "test", 1, "x"), (9, a, None, 1, "x"), (10, a, "dev", None, "x"), (11, "毫无关系的另外一段话在这里", "test", 1, "x")]
    df = clash(spark.createDataFrame(rows, "row_id bigint, text string, split string, label int, source string"))
    got = {(r["row_a"], r["row_b"]) for r in split_overlap.cross_split_overlaps(df).collect()}
    assert got == {(1, 2), (1, 3), (1, 10), (7, 8)}
    rep = {(r["split"], r["source"]): (r["rows"], r["overlapping"], r["other_label"]) for r in split_overlap.overlap_report(df).collect()}
    assert rep[("dev", None)] == (1, 1, 1) and rep[("dev", "x")] == (3, 1, 1) and rep[("test", "y")] == (1, 1, 0)
    assert split_overlap.cross_split_overlaps(df.limit(0)).count() == 0
    assert {(r["row_a"], r["row_b"]) for r in split_overlap.cross_split_overlaps(df, shard_texts=1, train_part=1).collect()} == got


def test_cross_split_gives_every_copy(spark):
    a, b = "邻居在市里私搭棚子物业不管合法吗", "邻居在市里私搭棚子物业不管合法吗呀"
    rows = [(i, a, "train") for i in range(1100)] + [(2000, a, "dev"), (2001, b, "test"), (2002, a, "test")] + [(3000 + i, b, "dev") for i in range(1050)] + [(5000, b, "train")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, split string")
    kept = df.where("row_id < 2500 OR row_id = 5000")
    want = {(i, j) for i in range(1100) for j in (2000, 2001, 2002)} | {(2000, 5000), (2001, 5000), (2002, 5000)}
    got = [(r["row_a"], r["row_b"]) for r in split_overlap.cross_split_overlaps(kept).collect()]
    assert len(got) == len(want) and set(got) == want
    # both sides large
    n = split_overlap.cross_split_overlaps(df).select("row_a", "row_b")
    assert n.count() == n.distinct().count() == 1101 * 1053


def test_text_index_counts_and_spans():
    import numpy as np

    texts = ["abracadabra", "abra", "", "cadab"]
    index = split_overlap.TextIndex(texts)
    again = split_overlap.TextIndex(packed=index.pack())
    for pattern in ("ab", "ra", "cad", "zz"):
        low, high = np.zeros(1, np.int64), np.full(1, again.n)
        for c in reversed(pattern):
            low, high = again.back(np.array([ord(c)], np.uint32), low, high)
        assert max(0, int(high[0] - low[0])) == sum(t.startswith(pattern, i) for t in texts for i in range(len(t)))
    longest, covered = split_overlap.overlap_spans(["xabcyabcd", "", "ab", "zz", "aaaa"], ["abcd--abcy", "x", "", "yy", "aab"])
    assert longest.tolist() == [4, 0, 0, 0, 2] and covered.tolist() == [8, 0, 0, 0, 4]


def test_maximal_matches_equal_brute_force():
    import random

    rng = random.Random(5)
    left, right = (["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(300)] for _ in range(2))
    got: dict = {}
    for p, b, e in zip(*(x.tolist() for x in split_overlap.maximal_matches(left, right))):
        got.setdefault(p, set()).add((b, e))
    for p, (x, y) in enumerate(zip(left, right)):
        inside = {(b, e) for b in range(len(x)) for e in range(b + 2, len(x) + 1) if x[b:e] in y}
        assert got.get(p, set()) == {(b, e) for b, e in inside if not any((c, f) != (b, e) and c <= b and e <= f for c, f in inside)}


def test_cross_split_over_many_shards(spark):
    import random

    rng = random.Random(2)
    base = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉") for _ in range(rng.randint(10, 24))) for _ in range(60)]
    texts = [b if k == 0 else b[:3] + "新" + b[3:] if k == 1 else b[:-1] for b in base for k in range(3)]
    rows = [(i, t, ("train", "dev", "test", "train")[rng.randrange(4)]) for i, t in enumerate(texts)] + [(1000 + i, base[0], "train") for i in range(30)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, split string")
    grams = {i: {t[k : k + 2] for k in range(len(t) - 1)} for i, t, _ in rows}
    side = {i: s == "train" for i, _, s in rows}
    want = {(a, b) for a in grams for b in grams if a < b and side[a] != side[b] and len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b])}
    for shard, part in ((20000, 50000), (7, 5)):
        got = [(r["row_a"], r["row_b"]) for r in split_overlap.cross_split_overlaps(df, shard_texts=shard, train_part=part).collect()]
        assert set(got) == want and len(got) == len(want)
    members = {r["row_id"]: r for r in split_overlap.overlap_members(df).collect()}
    assert members.keys() == side.keys() and members[1005]["copies"] >= 30
    assert all(bool(members[i]["links"]) == any(i in p for p in want) for i in side)


def test_neighbours(spark):
    e = lambda *x: [float(v) for v in x] + [0.0] * (64 - len(x))
    rows = [("a", e(1, 0)), ("b", e(1, 0.1)), ("c", e(1, 0.2)), ("d", e(0, 1)), ("n", None), ("z", e(0)), ("s", [1.0, 2.0]), ("q", [float("nan")] * 64)] + [(f"copy{i:02d}", e(0, 0, 3)) for i in range(9)]
    df = clash(spark.createDataFrame(rows, "id string, dense_vector array<float>"))
    got = neighbours.nearest(df, k=2).collect()
    near = {}
    for r in got:
        near.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    assert near["a"] == {1: "b", 2: "c"} and near["copy05"] == {1: "copy00", 2: "copy01"} and near["copy00"] == {1: "copy01", 2: "copy02"}
    assert not {"n", "z", "s", "q"} & ({r["id"] for r in got} | {r["neighbour"] for r in got})
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("id = 'a'")).count() == 0


def test_neighbours_recall_over_cells(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 64))[rng.integers(0, 40, 1200)] + 0.5 * rng.standard_normal((1200, 64))).astype(np.float32)
    df = spark.createDataFrame([(f"{i:04d}", row.tolist()) for i, row in enumerate(x)], "id string, dense_vector array<float>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(f"{i:04d}", f"{j:04d}") for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    for rows in (300, 40):  # 4 cells, and 32 cells with several parts of queries each
        got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(df, cell_rows=rows).collect()}
        assert len(got) == 6000 and len(got & want) / len(want) >= 0.9


def test_cells_near_equals_boxes():
    import numpy as np

    rng = np.random.default_rng(1)
    cells = neighbours.Cells(rng.standard_normal((2000, 6)).astype(np.float32), 6)
    z, reach = rng.standard_normal((300, 6)).astype(np.float32), (rng.random(300) * 4).astype(np.float32)
    want = neighbours.box_distances(z, cells.low, cells.high) <= reach[:, None]
    q, c = cells.near(z, reach)
    got = np.zeros(want.shape, bool)
    got[q, c] = True
    assert (got == want).mean() > 0.9999 and np.bincount(cells.of(rng.standard_normal((20000, 6)).astype(np.float32)), minlength=64).max() < 2000


def test_neighbours_of_many_equal_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(3000)] + [(9000 + i, [0.9, 0.1 * i, 0.0, 0.1]) for i in range(6)]
    got = neighbours.nearest(spark.createDataFrame(rows, "id int, dense_vector array<float>"), k=3, dim=4, m=4).collect()
    near = {}
    for r in got:
        near.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    assert len(near) == 3006 and near[2500] == {1: 0, 2: 1, 3: 2} and near[1] == {1: 0, 2: 2, 3: 3}
    assert near[9000][1] == 9001 and all(len(v) == 3 for v in near.values())


@pytest.mark.parametrize("capacity", [10, 100])
def test_packing(spark, capacity):
    sizes = [3, 3, 7, 5, 5, 9, 1, 25, 100, 0, None] + [k % 11 + 1 for k in range(300)]
    df = clash(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "key int, tokens int"))
    got = packing.packed(df, capacity, "x").collect()
    assert {r["key"]: 0 for r in got}.keys() == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        mine = [r for r in got if r["key"] == i]
        assert sum(r["tokens"] for r in mine) == (s or 0) and len(mine) == max(1, -(-(s or 0) // capacity)) == mine[0]["pieces"]
    load = {}
    for r in got:
        if r["container"] >= 0:
            load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
    assert max(load.values()) <= capacity and sum(load.values()) / (len(load) * capacity) > 0.9
    assert packing.packed(df.limit(0), capacity, "x").count() == 0


def test_mixing(spark):
    sized = clash(spark.createDataFrame([(i, "big", 10) for i in range(2000)] + [(5000 + i, "small", 7) for i in range(100)] + [(9000, "unwanted", 5), (9001, None, 5), (9002, "big", 0), (9003, "big", None)], "key bigint, source string, tokens int"))
    targets = clash(spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeat int"))
    plan = mixing.mixing_plan(sized, targets)
    chosen = mixing.mixed(sized, plan)
    rep = {r["source"]: r for r in mixing.mix_report(chosen, plan).collect()}
    assert abs(rep["big"]["actual_share"] - 7 / 9) < 0.01 and abs(rep["small"]["actual_share"] - 2 / 9) < 0.01 and rep["none"]["used_tokens"] == 0
    assert rep["small"]["most_repeats"] == 3 and rep["big"]["most_repeats"] == 1
    rows = chosen.collect()
    assert len({r["key"] for r in rows}) == len(rows) and not {9000, 9001} & {r["key"] for r in rows}
    less = mixing.mixed(sized, mixing.mixing_plan(sized, targets, total=900)).collect()
    assert {(r["key"], r["copies"]) for r in less} <= {(r["key"], r["copies"]) for r in less} and sum(r["tokens"] * r["copies"] for r in less) <= 1000
    assert {r["key"] for r in less if r["source"] == "big"} <= {r["key"] for r in rows if r["source"] == "big"}
    none = sized.limit(0)
    assert mixing.mixed(none, mixing.mixing_plan(none, targets)).count() == 0


def test_language(spark):
    en, zh, de = "The tenant shall return the keys within ten days. ", "承租人应当在十日内返还房屋钥匙。", "Der Mieter muss die Schlüssel innerhalb von zehn Tagen zurückgeben. "
    rows = [(i, (en, zh, de)[i % 3] * (1 + i % 4), ("en", "zh-CN", "de")[i % 3]) for i in range(240)]
    rows += [(1000, zh * 5 + "\n" + en, "zh"), (1007, en * 6 + "\n房屋租赁合同", "en"), (1001, en * 3, None), (1002, de * 3, "EN"), (1003, None, "en"), (1004, " \n ", "en"), (1005, zh * 2000, "und"), (1006, zh, "zh_cn")]
    df = clash(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    model = language.fit_language_model(df, ["de", "en", "zh"])
    found = language.languages(df, model)
    got = {tuple(r) for r in language.label_errors(found).collect() if r["doc_id"] >= 1000}
    assert got == {(1000, 2, "en"), (1007, 2, "zh"), (1001, 0, "en"), (1002, 0, "de"), (1005, 0, "zh")}
    blank = {r["doc_id"]: (r["lang_code"], r["confidence"]) for r in found.where("doc_id IN (1003, 1004)").collect()}
    assert blank == {1003: (None, 0.0), 1004: (None, 0.0)}
    assert all(0 <= r["confidence"] <= 1 for r in found.collect())
    empty = df.limit(0)
    assert language.languages(empty, language.fit_language_model(empty, ["de", "en"])).count() == 0


def test_page_noise(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    said = ["法院经审理认为，合同系双方真实意思表示，应认定有效。", "被告未在期限内提出异议，视为认可数量与质量。", "上诉理由不能成立，一审认定事实清楚。", "原告主张的可得利益缺乏依据，不予支持。"]
    clean = [(i, "".join(said[k] for k in rng.integers(0, 4, 6)), "a.docx") for i in range(300)]
    english = "The limitation period begins when the creditor obtains knowledge of the infringement and the agreement is terminated. "
    pages = []
    for i in range(300, 500):
        t = "".join(said[k] for k in rng.integers(0, 4, 5))
        lines = [t[k : k + 24] for k in range(0, len(t), 24)]
        pages.append((i, "\n".join([f"第{'一二三'[i % 3]}章 合同的订立", *lines, f"— {i} —"]), "书.pdf"))
        pages.append((i + 1000, english * 3, "en.pdf"))
    bad = "第二章 合同的订立｜31\n法院经审理认为，合同系又方真实意思表示，应认走有\n效。被告未在期限内提出异议。\n- 32 -"
    broken = "The limitation period begins when the cre-\nditor obtains knowledge of tlie infringement."
    edge = [(5000, bad, "书.pdf"), (5001, broken, "en.pdf"), (5002, None, "书.pdf"), (5003, "", "书.pdf"), (5004, bad, "a.docx"), (5005, bad, None), (5006, LONG, "书.pdf"), (5007, said[0], "书.pdf")]
    df = clash(spark.createDataFrame(clean + pages + edge, "id int, text_content string, source string"))
    model = page_noise.page_model(df)
    got = {r["id"]: r for r in page_noise.repaired(df, model).where("id >= 5000").collect()}
    assert set(got) == {5000, 5001, 5003, 5006, 5007}
    assert set(got[5000]["noise_kinds"]) == {"running_head", "page_number", "wrong_char"} and got[5000]["text"].startswith("法院经审理认为，合同系双方真实意思表示，应认定有效。")
    assert {"hyphen_break"} <= set(got[5001]["noise_kinds"]) and "creditor obtains knowledge of the" in got[5001]["text"]
    assert got[5003]["text"] == "" and got[5003]["noise_kinds"] == [] and got[5007]["noise_kinds"] == []
    empty = df.limit(0)
    assert page_noise.repaired(empty, page_noise.page_model(empty)).count() == 0


def test_regions_send_few_queries_to_other_cells():
    import numpy as np

    rng, unit = np.random.default_rng(2), lambda a: a / np.linalg.norm(a, axis=1)[:, None]
    x = 0.12 * rng.standard_normal((24000, 64)) + unit(rng.standard_normal((200, 64)))[rng.integers(0, 200, 24000)]
    x = unit(x).astype(np.float32)
    project = neighbours.directions(64, 16, 7)
    regions = neighbours.Regions(x[:4096], 4, project)
    cell = regions.of(x)
    asked = np.arange(0, 24000, 80)
    s = x[asked] @ x.T
    s[np.arange(300), asked] = -3
    best = np.argsort(-s, axis=1)[:, :5]
    reach = np.sqrt(2 - 2 * np.take_along_axis(s, best, 1)[:, -1])
    q, c = regions.near(x[asked], reach, 2.25)
    visited = np.zeros((300, 16), bool)
    visited[q, c] = True
    assert not visited[np.arange(300), cell[asked]].any()
    visited[np.arange(300), cell[asked]] = True
    # cells cut by planes through all rows were sent over 10 times as many
    assert np.take_along_axis(visited, cell[best], 1).mean() > 0.99 and len(q) < 4 * 300 and np.bincount(cell).max() < 4000
