"""Defects of question-answer pairs (problem 3).

Refusals are revealed by templates. The first sentences of all answers are cut into clauses, the masked clauses are clustered by
MinHash with verified similarity, and a cluster that recurs over unrelated questions (counted by a sketch of the question) is a
template. Which templates refuse is learnt from the collection: those which mostly stand in answers that apologise, or whose
words decline, are the first examples, those which never stand beside such are the others, and a sparse logistic regression
on character sequences judges all of them, twice, the second time with the company that templates keep. An answer is a
refusal if one of its clauses belongs to a refusing template and nothing of substance is left beside refusing and courteous
clauses. Copies, languages and endings are checked on the whole texts; whether an unmarked ending is complete is read from
corpus counts of what follows the same characters elsewhere.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm import language
from sedgewren.llm.common import bounded, code_points, fold, gram_sets, histogram, mixed_hash, strings
from sedgewren.session import small, written

# Words that stand for an absent answer, folded.
PLACEHOLDERS = {"null", "none", "nil", "na", "nan", "tbd", "todo", "无", "空", "暂无", "没有", "略", "待补充", "待定", "待回复", "待答复", "暂无答复", "暂无回答", "无答案", "暂缺", "同上", "未填写"}

NUMBERS = re.compile(r"[0-9０-９][0-9０-９,，.]*[0-9０-９]|[0-9０-９]|[零〇一二三四五六七八九十百千两]+万?[零一二三四五六七八九十百千两]*(?=[万元年月日条%])")
TITLES = re.compile(r"《[^》]*》")
SENTENCE = re.compile(r"[^。！？!?；;\n]*(?:[。！？!?；;\n]+|$)")

_NO = r"(?:无法|(?<!能)不能|不便|不会|不宜|不可|没有能力|没有办法|没办法|难以|暂不|不予|不再|不对|恕不|拒绝|不太方便|无权)"
_SAY = r"(?:回答|作答|答复|回复|解答|答覆|评价|评论|发表|看法|意见|建议|受理|判断这类|判断此类|提供|协助|帮助|处理|讨论|咨询|效劳)"
# first examples for the learner, no decision by themselves
DECLINE = re.compile(
    rf"{_NO}.{{0,18}}{_SAY}|帮不[了上到]|恕难|恕不|不受理|爱莫能助|无可奉告|超出.{{0,10}}(?:范围|能力)|只能闲聊|仅能闲聊"
    r"|\b(?:can(?:no|')?t|can not|unable to|not able to|won't|will not|must decline|not permitted to|not allowed to)\b.{0,40}\b(?:help|assist|answer|advi[cs]e|provide|comment|respond|discuss|that|this)"
    r"|ne (?:peux|pouvons|suis|sommes) pas.{0,40}(?:aider|répondre|fournir|mesure|conseil)|kann.{0,40}nicht.{0,30}(?:helfen|beantworten|geben|beraten)|(?:leider|bedauere).{0,40}(?:nicht|keine)"
    r"|no (?:puedo|podemos|me es posible).{0,40}(?:ayudar|responder|ofrecer|proporcionar|asesor)|(?:お答え|回答|対応|お手伝い|お力).{0,10}(?:できません|できかね|いたしかね|差し控え)",
    re.I | re.S,
)
_COURTESY = re.compile(
    r"抱歉|对不起|不好意思|遗憾|谅解|理解|感谢|谢谢|您好|你好|请(?:您)?(?:自行)?(?:咨询|查阅|查询|向|联系|另)|建议.{0,6}(?:换|咨询|联系|询问)|已收到|我们已经看到|敬请|\bsorry\b|\bplease\b.{0,30}(?:consult|contact)|désolé|entschuldig|lo siento|申し訳|ご了承",
    re.I,
)
APOLOGY = re.compile(r"抱歉|对不起|不好意思|很遗憾|见谅|谅解|\bsorry\b|\bregret\b|\bapologi[sz]e|désolé|regrett|entschuldig|leider|lo siento|lament|申し訳|ご了承", re.I)
CLOSING = re.compile(r"^(?:以上|祝|希望|详见|谢谢|感谢|此复|特此|如有|供您?参考|仅供参考|敬请).{0,20}$|(?:供参考|答复|谢谢|此复|有所帮助|附件说明)$")
DANGLING = re.compile(
    r"(?:[，,、：:（(《“\"‘—\-–/；;]|[（(][一二三四五六七八九十0-9]{1,2}[）)]|(?:^|[\s。；，])(?:第?[一二三四五六七八九十0-9]{1,2}[、.．]?)"
    r"|如果|除非|因此|所以|但是|而且|并且|或者|以及|由于|因为|虽然|首先|其次|再次|最后|另外|综上(?:所述)?|第[一二三四五六七八九十](?:点|步|项)?|[的该与和及或在从向对由被把将于是为]|包括|例如|比如|如下|以下)\s*$"
)
FINAL = "。！？!?.…”\"』」)）】’"
TAIL, BITS = 6, 20
_STOPS = np.array([ord(c) for c in FINAL + "；;\n"], np.uint32)


# with these alone a number begins; and what is left of a sentence that isn't blank
_NUMERAL, _FILLED = re.compile("[0-9０-９零〇一二三四五六七八九十百千两]"), re.compile(r"[^，,。！？!?；;：:\s]")


def _masked(text: str) -> str:
    """A sentence with titles emptied and numbers as '#'."""
    if "《" in text:
        text = TITLES.sub("《》", text)
    return NUMBERS.sub("#", text) if _NUMERAL.search(text) else text


_CLAUSE = re.compile(r"[，,。！？!?；;：:\n]+")
# Connectives that don't belong to a template.
_CONNECTIVE = re.compile(r"^(?:不过|但是|但|因此|所以|而且|(?:but|so|and|therefore)\b)\s*(?=\S)", re.I)
_CONNECTS = frozenset("不但因所而bsatBSATſ")


def sentences(text: str, most: int | None = None) -> list[list[str]]:
    """Masked clauses of each sentence of a text, or of its first ones; blank sentences and clauses don't count."""
    out = []
    for m in SENTENCE.finditer(text):
        parts = (" ".join(x.split()) for x in _CLAUSE.split(_masked(m.group(0))))
        parts = [_CONNECTIVE.sub("", x) if x[0] in _CONNECTS else x for x in parts if x]
        if parts:
            out.append(parts)
            if len(out) == most:
                break
    return out


def _brief(text: str, most: int) -> bool:
    """Whether a text has ``most`` sentences that aren't blank at most."""
    left = most
    for m in SENTENCE.finditer(text):
        if _FILLED.search(m.group(0)):
            left -= 1
            if left < 0:
                return False
    return True


def clauses(text: str, most: int | None = None) -> list[str]:
    """Masked clauses of a text, or of its first sentences."""
    return [c for s in sentences(text, most) for c in s]


def _tail_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of stripped texts, each run of digits as one '#', and the text of each."""
    points, offsets = code_points([t.strip() for t in texts])
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    number = (points >= 48) & (points <= 57)
    again = np.zeros(len(points), bool)
    again[1:] = number[1:] & number[:-1] & (of[1:] == of[:-1])
    points = np.where(number, ord("#"), points).astype(np.uint32)
    return points[~again], of[~again]


def _tail_counts(batch: pa.RecordBatch) -> np.ndarray:
    """By hash of each ``TAIL`` masked characters of every answer: how often text goes on after them, and how often not."""
    on, off = [], []
    for part in bounded(strings(batch.column("answer")), 100_000):  # arrays that fit in a core's cache
        points, of = _tail_points(part)
        if len(points) < TAIL:
            continue
        value, inside = _tails(points), of[: len(points) - TAIL + 1] == of[TAIL - 1 :]
        end = np.arange(TAIL, len(points) + 1)
        last = np.zeros(len(end), bool)
        last[-1], last[:-1] = True, of[end[:-1]] != of[end[:-1] - 1]
        stops = last.copy()
        stops[:-1] |= np.isin(points[end[:-1]], _STOPS)
        on.append(value[inside & ~stops])
        off.append(value[inside & stops & ~last])
    count = lambda values: np.bincount(np.concatenate(values), minlength=1 << BITS) if values else np.zeros(1 << BITS, np.int64)
    return np.stack([count(on), count(off)])


def _tails(points: np.ndarray) -> np.ndarray:
    h = np.zeros(len(points) - TAIL + 1, np.uint64)
    for k in range(TAIL):
        h = mixed_hash(h ^ points[k : len(points) - TAIL + 1 + k].astype(np.uint64), k + 1)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _foreign(texts: list[str]) -> np.ndarray:
    """Which texts are not Chinese: kana beside the ideographs, or far more other letters than ideographs."""
    points, offsets = code_points(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    count = lambda ok: np.bincount(of[ok], minlength=len(texts))
    han = count((points >= 0x3400) & (points <= 0x9FFF))
    kana = count((points >= 0x3040) & (points <= 0x30FF))
    low = points | 0x20
    other = count((low >= 97) & (low <= 122) | (points >= 0xC0) & (points <= 0x58F) | (points >= 0x5D0) & (points <= 0x1FFF) | (points >= 0xAC00) & (points <= 0xD7A3))
    return (kana >= 3) & (kana >= 0.15 * (han + kana)) | (other > 4 * han) & (other >= np.where(han > 0, 6, 2))


_WORDS = re.compile(r"[^\W_]+")


def _copies(question: str, answer: str) -> bool:
    """Whether nearly all of the answer is the question's own text, in one run of order or repeated."""
    q = question.replace("我", "您").replace("你", "您")
    clauses = _WORDS.findall(answer.replace("我", "您").replace("你", "您"))
    total = sum(map(len, clauses))
    if total < 6 or sum([len(c) for c in clauses if c in q]) < 0.3 * total:
        return False
    q, a = fold(q), fold("".join(clauses))
    if len(a) < 6 or len(q) < 6:
        return False
    if a in q:
        return len(a) >= 0.3 * len(q) or len(a) >= 12
    qg = {q[i : i + 4] for i in range(len(q) - 3)}
    covered = np.zeros(len(a), bool)
    for i in range(len(a) - 3):
        if a[i : i + 4] in qg:
            covered[i : i + 4] = True
    return int((~covered).sum()) <= max(8, 0.06 * len(a)) and covered.sum() >= min(12, 0.5 * len(q))


def _truncated(answer: str, going: np.ndarray, stopping: np.ndarray) -> bool:
    """Whether the text breaks off. A final mark ends a text unless a bare list number comes after the last sentence."""
    text = answer.strip().strip("\u200b\ufeff")
    # expressions for the end are only tried where they can match: from the start they would walk through the whole text
    cut = re.sub(r"(?:…|\.{2,}|—|--)+$", "", text).rstrip() if text.rstrip("\n").endswith(("…", ".", "—", "-")) else text.rstrip()
    if not cut:
        return False
    if cut[-1] in FINAL and not re.search(r"[。！？；;，,：:\n](?:[（(][一二三四五六七八九十0-9]{1,2}[）)]|[一二三四五六七八九十0-9]{1,2}[.．、])$", cut[-5:]):
        return len(cut) > 8 and bool(re.search(r"[，,、：:][.]$", cut[-2:]))
    text = cut
    if any(text.count(x) > text.count(y) for x, y in ("《》", "（）", "(" + ")", "“”")):
        return True
    last = re.split(r"[。！？!?\n]", text)[-1].strip()
    if CLOSING.search(last):
        return False
    if DANGLING.search(last) or not last:
        return True
    points, _ = _tail_points([text])
    if len(points) < TAIL:
        return True
    h = int(_tails(points[-TAIL:])[0])
    return going[h] >= stopping[h]


#: Sentences of an answer whose clauses are its opening.
OPENING = 2
#: An answer that goes on for more folded characters than this beside refusing and courteous clauses has substance.
SUBSTANCE = 7


def opening_clauses(pairs: DataFrame) -> DataFrame:
    """(clause, prompts, rows, sorry, brief): clauses of the openings of all answers, over how many unrelated questions and in how many
    rows each stands, in how many of these rows the opening is the whole answer, and in how many of those it apologises or declines.

    For answers that are no longer than their opening unrelated questions are counted by one MinHash value of each question, which
    questions alike mostly share; for other answers by the whole question.
    """

    def cut(batches):
        for b in batches:
            out = ([], [], [], [])
            answers = strings(b.column(0))
            opened, short = [clauses(t, OPENING) for t in answers], [_brief(t, OPENING) for t in answers]
            whole = [i for i, x in enumerate(opened) if x and short[i]]
            asked, q_ = b.column(2).to_pylist(), strings(b.column(1))
            for i, sketch in zip(whole, _signatures([q_[i] for i in whole], 1)[:, 0].astype(np.int64).tolist()):
                asked[i] = sketch
            for q, t, mine, brief in zip(asked, answers, opened, short):
                sorry = brief and bool(APOLOGY.search(t) or DECLINE.search(t))
                once = set(mine)
                for column, x in zip(out, (once, *([x] * len(once) for x in (q, sorry, brief)))):
                    column.extend(x)
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.bool_())], names=["clause", "prompt", "sorry", "brief"])

    found = pairs.select("answer", "question", F.xxhash64("question")).mapInArrow(cut, "clause string, prompt long, sorry boolean, brief boolean")
    return found.groupBy("clause").agg(F.approx_count_distinct("prompt", 0.02).alias("prompts"), F.count(F.lit(1)).alias("rows"), F.count_if("sorry").alias("sorry"), F.count_if("brief").alias("brief"))


ROWS, BANDS = 3, 10


def _signatures(texts: list[str], hashes: int = ROWS * BANDS) -> np.ndarray:
    """MinHash signatures over 3-character shingles of folded texts; texts below 3 characters get their own value."""
    folded = [fold(t).ljust(3) for t in texts]
    value, of, sizes = gram_sets(folded, 3)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return np.stack([np.minimum.reduceat(mixed_hash(value, k + 1), starts) for k in range(hashes)], 1) if len(texts) else np.zeros((0, hashes), np.uint64)


def _shingles(text: str) -> set[str]:
    t = fold(text)
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))}


_FEW = 8


def _led(block: list[str], similarity: float):
    """(clause, leader, similarity) of a block in order: the first clause alike to no leader is one itself.

    A leader alike to a clause lacks at most ``spare`` of its shingles, so it is found under one of any ``spare + 1`` of them; the
    seldomest are looked up. A few leaders are all compared, which costs less.
    """
    leaders: list[tuple[set[str], str]] = []
    held: dict[str, list[int]] = {}
    for c in block:
        mine = _shingles(c)
        best = (0.0, "")
        if len(leaders) > _FEW:
            spare = len(mine) - math.ceil(similarity * len(mine) - 1e-9)
            near = [leaders[i] for i in set().union(*sorted((held.get(g, ()) for g in mine), key=len)[: spare + 1])]
        else:
            near = leaders
        for s, name in near:
            if min(len(s), len(mine)) < similarity * max(len(s), len(mine)):
                continue
            both = len(s & mine)
            best = max(best, (both / (len(s) + len(mine) - both), name))
        if best[0] >= similarity:
            yield c, best[1], best[0]
        else:
            leaders.append((mine, c))
            for i in range(len(leaders)) if len(leaders) == _FEW + 1 else (len(leaders) - 1,) if len(leaders) > _FEW else ():
                for g in leaders[i][0]:
                    held.setdefault(g, []).append(i)


def clause_clusters(found: DataFrame, similarity: float = 0.8, block: int = 1000) -> DataFrame:
    """(clause, leader): the leader of each clause's verified cluster; a clause alike to no other is left out.

    In every MinHash band the clauses are taken by their number of questions, and each joins the leader it is most alike to, or leads.
    Bands of more than ``block`` clauses are cut into blocks by hash. The leaders of the blocks are cut into blocks again, and every
    pair of these is compared, so that any two leaders of a band meet. Members go with their leader to the greatest one.
    """

    def band(batches):
        for b in batches:
            texts = strings(b.column("clause"))
            sig = _signatures(texts)
            for k in range(BANDS):
                key = sig[:, ROWS * k]
                for r in range(1, ROWS):
                    key = mixed_hash(key, 77 + r) ^ sig[:, ROWS * k + r]
                yield pa.record_batch({"band": pa.array(key.astype(np.int64)), "clause": pa.array(texts, pa.string()), "prompts": b.column("prompts")})

    def lead(batches):
        key, held = None, []
        for b in batches:
            rows = ([], [], [])
            for x, y, c in zip(b.column("band").to_pylist(), b.column("block").to_pylist(), b.column("clause").to_pylist()):
                if (x, y) != key:
                    for found_ in _led(held, similarity):
                        for column, v in zip(rows, found_):
                            column.append(v)
                    key, held = (x, y), []
                held.append(c)
            yield _edges(rows)
        rows = tuple(map(list, zip(*_led(held, similarity)))) or ([], [], [])
        yield _edges(rows)

    left = written(found.select("clause", "prompts").mapInArrow(band, "band long, clause string, prompts long"))
    edges = None
    for turn in (1, 2):
        size = written(left.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("long")))
        cut = left.join(small(size), "band").withColumn("block", F.pmod(F.xxhash64("clause", F.lit(turn)), "blocks"))
        if turn == 2:  # a block goes to its pairs with all other ones
            cut = cut.withColumn("other", F.explode(F.expr("IF(blocks > 1, sequence(0L, blocks - 1), array(block))"))).where("blocks = 1 OR other <> block")
            cut = cut.withColumn("block", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
        ordered = cut.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band", "block").sortWithinPartitions("band", "block", F.desc("prompts"), "clause").select("band", "block", "clause")
        near = written(ordered.mapInArrow(lead, "clause string, leader string, s double"))
        edges = near if edges is None else edges.unionByName(near)
        hot = size.where("blocks > 1").select("band")
        if turn == 2 or hot.isEmpty():
            break
        left = written(left.join(small(hot), "band", "left_semi").join(near.select("clause").distinct(), "clause", "left_anti"))
    # leaders that join a greater one pass their members on; a leader stands before its members in the order, so this ends
    best = written(edges.groupBy("clause").agg(F.max(F.struct("s", "leader")).alias("m")).select("clause", F.col("m.leader").alias("leader")))
    while True:
        up = best.select(F.col("clause").alias("leader"), F.col("leader").alias("above"))
        passed = written(best.join(up, "leader", "left").select("clause", F.coalesce("above", "leader").alias("leader"), F.col("above").isNotNull().alias("on")))
        best = passed.drop("on")
        if passed.where("on").isEmpty():
            return best


def _edges(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.float64())], names=["clause", "leader", "s"])


def template_shards(marked: DataFrame, sizes: dict[int, int], most: int, seed: int = 0) -> DataFrame:
    """(shard, leader, y, rows): every template of ``marked`` in shards of about ``most`` of either kind, by hash.

    ``sizes`` counts the templates of each kind. There are as many shards as the larger kind fills; a part of the smaller kind stands in
    several of them.
    """
    parts = {y: -(-n // most) for y, n in sizes.items()}
    shards = max(parts.values())
    step = F.lit(shards)
    for y, n in parts.items():
        step = F.when(F.col("y") == y, F.lit(n)).otherwise(step)
    part = F.pmod(F.xxhash64("leader", F.lit(seed)), step).cast("int")
    return marked.select(F.explode(F.sequence(part, F.lit(shards - 1), step.cast("int"))).alias("shard"), "leader", "y", "rows")


def _fit(found: list[tuple[str, int, int]], seed: int) -> language.LanguageModel:
    """The model of (template, kind, rows). A template counts by the logarithm of its rows, so that a set wording that recurs is learnt."""
    rows = sorted((t, y) for t, y, n in found for _ in range(1 + int(np.log2(n))))
    return language.fit_ftrl([x for x, _ in rows], np.array([y for _, y in rows]), ["other", "refusing"], np.ones(1 << language.BITS), epochs=6, batch=32, seed=seed)


def fit_templates(marked: DataFrame, most: int = 20_000, seed: int = 0) -> language.LanguageModel | None:
    """The model of all templates (leader, y, rows) of the kinds 0 and 1; None without both kinds.

    Of more than ``most`` of a kind, each shard of ``template_shards`` is fitted in a task, and weights and bias are averaged over them
    (parameter mixing, Zinkevich 2010). So every template counts, and a fit has a fixed size.
    """
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    if max(sizes.values()) <= most:
        return _fit([(r["leader"], r["y"], r["rows"]) for r in marked.select("leader", "y", "rows").collect()], seed)

    def shard(t: pa.Table) -> pa.Table:
        m = _fit(list(zip(t["leader"].to_pylist(), t["y"].to_pylist(), t["rows"].to_pylist())), seed)
        return pa.table({"weights": pa.array([zstandard.compress(m.weights.astype(np.float32).tobytes(), 1)], pa.binary()), "bias": pa.array([m.bias.tolist()], pa.list_(pa.float64())), "temperature": pa.array([m.temperature], pa.float64())})

    shape, fits = (1 << language.BITS, 2), 0
    weights, bias, temperature = np.zeros(shape), np.zeros(2), 0.0
    for r in written(template_shards(marked, sizes, most, seed).groupBy("shard").applyInArrow(shard, "weights binary, bias array<double>, temperature double")).toLocalIterator():
        weights += np.frombuffer(zstandard.decompress(r["weights"]), np.float32).reshape(shape)
        bias, temperature, fits = bias + np.array(r["bias"]), temperature + r["temperature"], fits + 1
    return language.LanguageModel(["other", "refusing"], (weights / fits).astype(np.float32), bias / fits, np.ones(1 << language.BITS), temperature / fits)


def refusing_templates(found: DataFrame, company: DataFrame, similarity: float = 0.8, least_prompts: int = 3, least_sound: int = 10, sample: int = 20_000, seed: int = 0):
    """(model, templates): what tells refusing clauses from others, and (clause) of every recurring template that may refuse: one that
    stands in ``least_sound`` rows and beside nothing that apologises or declines may not.

    ``found`` is ``opening_clauses``, ``company`` gives (clause, other) of clauses that stand in one brief opening. The model is
    fitted on all templates, in shards of about ``sample`` of either kind. None are refusing without examples of both kinds.
    """
    found = written(found)
    clusters = clause_clusters(found, similarity)
    led = found.join(clusters, "clause", "left").withColumn("leader", F.coalesce("leader", "clause"))
    led = written(led)
    total = led.groupBy("leader").agg(*[F.sum(c).alias(c) for c in ("prompts", "rows", "sorry", "brief")]).where(F.col("prompts") >= least_prompts)
    total = written(total)
    templates = led.join(small(total.select("leader")), "leader", "left_semi").select("clause")
    share = F.col("sorry") / F.col("rows")

    first = total.withColumn("y", F.when(share > 0.5, 1).when(share < 0.05, 0)).where("y IS NOT NULL")
    model = fit_templates(first, sample, seed)
    if model is None:
        return None, templates
    # what mostly stands beside refusing clauses is an example too, and what never does is none
    shared = found.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            p = shared.value.probabilities(strings(b.column(0)))[:, 1]
            yield pa.record_batch([b.column(0), pa.array(p)], names=["clause", "p"])

    scored = written(templates.mapInArrow(score, "clause string, p double"))
    beside = company.join(scored.select(F.col("clause").alias("other"), "p"), "other").groupBy("clause").agg(F.avg((F.col("p") >= 0.5).cast("double")).alias("beside"))
    again = total.join(beside.withColumnRenamed("clause", "leader"), "leader", "left").join(scored.withColumnRenamed("clause", "leader"), "leader", "left")
    near, own = F.coalesce("beside", F.lit(0.0)), F.coalesce("p", F.lit(0.0))
    # a template that recurs often and never stands beside such is sound, whatever the first model says
    sound = (share < 0.05) & (near < 0.05) & ((own < 0.5) | (F.col("rows") >= least_sound))
    second = written(again.withColumn("y", F.when((share > 0.5) | (near >= 0.5) & (own >= 0.5), 1).when(sound, 0)).select("leader", "y", "rows"))
    open_ = small(second.where("y IS NULL OR y = 1").select("leader"))
    return fit_templates(second.where("y IS NOT NULL"), sample, seed) or model, led.join(open_, "leader", "left_semi").select("clause")


def clause_company(pairs: DataFrame) -> DataFrame:
    """(clause, other) of different clauses of one brief answer; answers with more than ``OPENING`` sentences give none."""

    def cut(batches):
        for b in batches:
            out = []
            for t in strings(b.column(0)):
                if _brief(t, OPENING):
                    mine = set(clauses(t))
                    out += [(x, y) for x in mine for y in mine if x != y]
            yield pa.record_batch([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], names=["clause", "other"])

    return pairs.select("answer").mapInArrow(cut, "clause string, other string")


class _Judge:
    """Refusing clauses by the model, each clause judged once for each worker."""

    def __init__(self, model):
        self.model, self.known = model, {}

    def refusing(self, parts: list[str]) -> dict[str, bool]:
        new = [c for c in set(parts) if c not in self.known]
        if new:
            if len(self.known) > 200_000:
                self.known.clear()
                new = list(set(parts))
            self.known.update(zip(new, (self.model.probabilities(new)[:, 1] >= 0.5).tolist()))
        return self.known

    def candidates(self, answers: list[str]) -> list[list[str] | None]:
        """The refusing clauses of each answer that has nothing of substance beside them; None for others."""
        out: list[list[str] | None] = [None] * len(answers)
        begin = [sentences(t, OPENING) for t in answers]
        known = self.refusing([c for x in begin for c in _judged(x)])
        open_ = [i for i, x in enumerate(begin) if any(known[c] for s in x for c in s) and _substance(x, known) <= SUBSTANCE]
        whole = {i: sentences(answers[i]) for i in open_}
        known = self.refusing([c for x in whole.values() for c in _judged(x)])
        for i, x in whole.items():
            if _substance(x, known) <= SUBSTANCE:
                out[i] = [c for c in {c for s in x for c in s} if known[c]]
        return out


def _judged(parts: list[list[str]]) -> list[str]:
    """What is judged of sentences: every clause, and every sentence of several as a whole."""
    return [c for s in parts for c in s] + ["，".join(s) for s in parts if len(s) > 1]


def _substance(parts: list[list[str]], known: dict[str, bool]) -> int:
    """Folded characters of clauses that neither refuse, nor are courteous, nor stand in a sentence that refuses as a whole."""
    left = 0
    for s in parts:
        if len(s) > 1 and known["，".join(s)] and any(known[c] for c in s):
            continue
        left += sum(len(fold(c)) for c in s if not known[c] and not _COURTESY.search(c) and not CLOSING.search(c))
    return left


def pair_defects(pairs: DataFrame, id_col: str = "id", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """(id_col, defect_type) of each defective pair; a sound pair gives no row, a defective one exactly one.

    Types in order of precedence: empty_answer, copied_question, refusal, other_language, truncated_answer. NULL or blank
    answers are empty; a NULL question can't be copied. ``id_col`` must be unique. Empty input gives no rows; other columns are
    ignored.
    """
    spark = pairs.sparkSession
    p = pairs.select(F.col(id_col).alias("id"), F.col(question_col).alias("question"), F.col(answer_col).alias("answer"))
    going, stopping = histogram(p.select("answer"), _tail_counts, BITS, 2)
    model, templates = refusing_templates(opening_clauses(p), clause_company(p))
    shared = spark.sparkContext.broadcast((going.astype(np.int32), stopping.astype(np.int32), model))

    def label(batches):
        go, stop, model = shared.value
        judge = _Judge(model) if model is not None else None
        for b in batches:
            ids, first, last, refusing = [], [], [], []
            answers = strings(b.column("answer"))
            may = judge.candidates(answers) if judge else [None] * len(answers)
            for i, q, a, f, r in zip(b.column("id").to_pylist(), strings(b.column("question")), answers, _foreign(answers).tolist(), may):
                before = _blank_or_copied(q, a)
                after = None if before else "other_language" if f else "truncated_answer" if _truncated(a, go, stop) else None
                if before or after or r:
                    for column, x in zip((ids, first, last, refusing), (i, before, after, None if before else r)):
                        column.append(x)
            yield pa.record_batch({"id": pa.array(ids, b.schema.field("id").type), "first": pa.array(first, pa.string()), "last": pa.array(last, pa.string()), "refusing": pa.array(refusing, pa.list_(pa.string()))})

    kind = p.schema["id"].dataType.simpleString()
    marked = written(p.mapInArrow(label, f"id {kind}, first string, last string, refusing array<string>"))
    # of the clauses that refuse, one at least must belong to a template that recurs
    said = marked.where("refusing IS NOT NULL").select("id", F.explode("refusing").alias("clause"))
    refused = said.join(small(written(templates.select("clause").distinct())), "clause", "left_semi").select("id").distinct()
    final = marked.join(refused.withColumn("no", F.lit("refusal")), "id", "left").select("id", F.coalesce("first", "no", "last").alias("defect_type"))
    return final.where("defect_type IS NOT NULL").withColumnRenamed("id", id_col)


def _blank_or_copied(question: str, answer: str) -> str | None:
    if len(answer) < 40 or not answer[:1].isalnum():
        folded = fold(answer)
        if not folded or folded in PLACEHOLDERS:
            return "empty_answer"
    return "copied_question" if _copies(question, answer) else None
