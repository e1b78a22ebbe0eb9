"""Personal information in free text (problem 4): found, and replaced with typed placeholders.

Generators of high recall propose overlapping spans of each type; boosted trees judge every span by format and context
features; each type's threshold on the calibrated probability is the one that has the stated precision on examples kept apart, and
the larger probability settles what overlaps. There are no labels, so the trees learn from the texts themselves, in
which clear cues beside a span, clear signs against it, and better bounded spans in its place give the labels; for half of the
spans the cue features are hidden while learning, so that format and characters have to carry the decision too. Counts, labels,
trees and thresholds rest on all rows: spans are counted by what can be seen of them, and equal examples are learnt as one that weighs more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.boosting import BoostedTrees
from sedgewren.llm.common import bounded, code_points, histogram, strings
from sedgewren.session import written

# Frequent family names of one and of two characters.
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余杜叶程魏苏吕丁任沈姚卢姜崔钟谭陆汪范廖石贾韦夏付邹熊孟秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵严覃武钱戴莫孔"
    "汤康易乔赖牛洪倪樊殷柯阮岑褚骆晏裴傅尚简童温邢翟安颜柳伍鲁葛施纪舒屈项祝蓝焦霍纽左凌万向"
)
DOUBLE_SURNAMES = ["欧阳", "上官", "司徒", "慕容", "诸葛", "司马", "皇甫", "尉迟", "令狐", "东方", "公孙", "宇文", "长孙", "端木", "夏侯", "轩辕", "钟离", "闻人", "太史", "申屠"]
TYPES = ["name", "phone", "id_number", "email", "address"]

HAN = "一-鿿"
D = "[0-9０-９OoIl]"
PLAIN = str.maketrans("０１２３４５６７８９OoIlＸｘx＠．", "01234567890011XXX@.")
_SEP = r"[ \-－—\n]{0,2}"

EMAIL = re.compile(
    r"(?:[A-Za-z0-9._+\-]\n?){2,64}?[ ]?(?:@|＠|[\[(（]\n?a\n?t\n?[\])）])\s?(?:[A-Za-z0-9\-]\n?){1,40}(?:[ ]?[.．。]\s?(?:[A-Za-z0-9\-]\n?){1,24}){1,4}"
)
ID18 = re.compile(rf"(?<![0-9０-９A-Za-z]){D}(?:[ \n]?{D}){{16}}[ \n]?[0-9０-９OoIlXxＸｘ](?![0-9０-９A-Za-z])")
ID15 = re.compile(rf"(?<![0-9０-９A-Za-z]){D}(?:\n?{D}){{14}}(?![0-9０-９A-Za-z])")
PHONE = re.compile(
    rf"(?<![0-9０-９A-Za-z.．,，¥￥])(?:[+＋]\s?[8８]\n?[6６]{_SEP})?[1１]\n?[3-9３-９](?:{_SEP}{D}){{9}}(?![0-9０-９A-Za-z])"
    rf"|(?<![0-9０-９A-Za-z.．,，¥￥])(?:[（(]\n?[0０O](?:\n?{D}){{2,3}}\n?[)）]\s?|[0０O](?:\n?{D}){{2,3}}{_SEP}){D}(?:\n?{D}){{6,7}}(?![0-9０-９A-Za-z])"
)
LOOSE = re.compile(r"(?<![0-9０-９A-Za-z.．,，¥￥\-])[0-9０-９](?:[ \-\n]?[0-9０-９]){9,12}(?![0-9０-９A-Za-z.．])")
# the end of an address, and the largest unit that may begin it with a name of two to four ideographs
HOUSE = re.compile(rf"((?:[{HAN}]\n?){{5,40}})(?:[0-9０-９]\n?){{1,5}}号")
UNITS = "省市州区县"

_ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
CUES = {
    "name": (re.compile(r"(?:代理人|收件人为?|联系人|承办人|我叫|本人|姓名|名叫|我是|被告|原告|被[吿告]|原[吿告]|表[姐妹哥弟]|申请人|证人|户主)[：:\s]*$"), re.compile(r"$^")),
    "phone": (re.compile(r"(?:电话|手机|手机号|号码|联系|拨|加我|致电|微信|来电|传真)[^\d]{0,8}$"), re.compile(r"(?:编号|[冋同]号|订单|发票|代码|单号|案号|账号|卡号|流水)[^\d]{0,4}$")),
    "id_number": (re.compile(r"(?:身份|证件|公民)[^\d]{0,8}$"), re.compile(r"(?:编号|订单|发票|代码|单号|案号|账号|卡号|流水|合[同冋])[^\d]{0,4}$")),
    "email": (re.compile(r"(?:邮箱|邮件|发送至|发到|曾用|mail)[^A-Za-z0-9]{0,4}$", re.I), re.compile(r"$^")),
    "address": (re.compile(r"(?:坐落于|住在|住|寄到|寄至|法院向|地址[为：:]?|家在|位于|送至|住址[为：:]?)\s*$"), re.compile(r"$^")),
}
_ORGANISATION = re.compile(r"^[^，。；：\s]{0,9}(?:公司|厂|工作室|中心|小区|家园|广场|公寓|新村|花园|条例|办法|规定|细则)")
_UNIT = re.compile(r"^[省市区县镇乡村路街巷里道号]")
_HAN = re.compile(f"[{HAN}]")
_TITLE = re.compile(r"^(?:先生|女士|小姐|某|律师|法官|总|老师)")


@dataclass
class PersonalModel:
    """Trees, threshold and character tables of each type; ``places`` counts what stands before a unit."""

    given: dict[str, float] = field(default_factory=dict)
    surname: dict[str, float] = field(default_factory=dict)
    left: dict[str, float] = field(default_factory=dict)
    right: dict[str, float] = field(default_factory=dict)
    places: dict[str, int] = field(default_factory=dict)
    trees: dict[str, BoostedTrees] = field(default_factory=dict)
    threshold: dict[str, float] = field(default_factory=dict)


# every family name followed by one or two ideographs, at every position
NAME = re.compile(rf"(?=((?:{'|'.join(DOUBLE_SURNAMES)}|[{SURNAMES}])\n?[{HAN}])(\n?[{HAN}])?)")
CUED_NAME = re.compile(rf"(?:代理人|收件人为|承办人|联系人[：:]|我叫|本人|被告|原告)\s*((?:{'|'.join(DOUBLE_SURNAMES)}|[{SURNAMES}])[{HAN}]{{1,2}})(?=[，,。、\s])")


def _among(chars) -> np.ndarray:
    """By code point up to ``_Batch.END``: whether it is one of ``chars``."""
    out = np.zeros(_Batch.END + 1, bool)
    out[[ord(c) for c in chars]] = True
    return out


def _pairs(words) -> np.ndarray:
    return np.array([ord(w[0]) << 21 | ord(w[1]) for w in words], np.int64)


# of about so many characters arrays are made at once
_CHARS = 1_000_000


class _Batch:
    """Texts joined by NUL, which no generator matches; ``points`` has ``END`` between them."""

    END = 0x110000

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.joined = "\0" + "\0".join(texts) + "\0\0\0\0"
        self.starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        self.points[self.starts - 1] = self.points[-4:] = self.END

    def row(self, at):
        """The text of each position."""
        return np.searchsorted(self.starts, at, side="right") - 1

    def others(self):
        """(row, type, start, end) of every proposed span but names; spans may overlap, also those of one type.

        Searched are texts with what a type can't do without: ten digits, or letters like them, at most three characters apart; a sign of
        e-mail addresses; a digit before 号.
        """
        p = self.points
        beside = lambda at, step, table: table[p[at + step]] | (p[at + step] == 10) & table[p[at + 2 * step]]
        digits = np.flatnonzero(_IS_DIGIT[p])
        of = self.row(digits)
        runs = np.cumsum(np.append(0, (np.diff(digits) > 4) | (np.diff(of) > 0)))[: len(digits)]
        many = of[np.bincount(runs)[runs] >= 10] if len(digits) else digits
        t = np.flatnonzero(p == ord("t"))
        at = np.concatenate([np.flatnonzero((p == ord("@")) | (p == ord("＠"))), t[beside(t, -1, _IS_A) & beside(t, 1, _IS_CLOSING)]])
        door = np.flatnonzero(p == ord("号"))
        door = door[beside(door, -1, _IS_DIGIT)]
        many, at, door = (set(x.tolist()) for x in (many, self.row(at), self.row(door)))
        for r in sorted(many | at | door):
            yield from ((r, *f) for f in _candidates(self.texts[r], r in many, r in at, r in door))


def _candidates(text: str, digits: bool, at: bool, door: bool):
    """(type, start, end) of every proposed span but names; the flags say what is found in the text at all."""
    end = 0
    for m in PHONE.finditer(text) if digits else ():
        end = m.end()
        yield "phone", m.start(), end
    for m in LOOSE.finditer(text) if digits else ():
        if m.start() >= end or not PHONE.match(text, m.start()):
            yield "phone", m.start(), m.end()
    for rx in (ID18, ID15) if digits else ():
        for m in rx.finditer(text):
            yield "id_number", m.start(), m.end()
    for m in EMAIL.finditer(text) if at else ():
        yield from (("email", a, b) for a, b in _email_spans(text, m.start(), m.end()))
    for m in HOUSE.finditer(text) if door else ():
        yield from (("address", a, m.end()) for a in _address_starts(text, m.start(1), m.end(1)))


# what the expressions for names look for, as tables
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_IS_SURNAME, _IS_FIRST, _IS_STOP = _among(SURNAMES), _among({w[0] for w in DOUBLE_SURNAMES}), _among(["，", "。", "；", "：", *_SPACES])
_IS_UNIT, _IS_LARGE, _IS_END, _IS_OPEN = _among("省市区县镇乡村路街巷里道号"), _among(UNITS), _among("，。、：；）,. "), _among(["：", ":", *_SPACES])
_IS_STOP[_Batch.END] = _IS_END[_Batch.END] = True
_IS_DIGIT, _IS_A, _IS_CLOSING = _among("0123456789０１２３４５６７８９OoIl"), _among("a"), _among("])）")
_DOUBLE, _TITLES = _pairs(DOUBLE_SURNAMES), _pairs(["先生", "女士", "小姐", "律师", "法官", "老师"])
_CUE_ENDS = _pairs("理人 件人 人为 系人 办人 我叫 本人 姓名 名叫 我是 被告 原告 被吿 原吿 表姐 表妹 表哥 表弟 请人 证人 户主".split())
_KINDS = re.compile("公司|厂|工作室|中心|小区|家园|广场|公寓|新村|花园|条例|办法|规定|细则")


class _Names:
    """Every proposed name of a batch of texts, in arrays: each family name followed by one or two ideographs, at every position.

    ``begin`` and ``end`` count in the joined texts. ``chars`` has the characters of a name without breaks, of which ``k`` are the family name;
    ``left`` and ``right`` the characters beside it, ``END`` where there is none; ``pro`` and ``con`` the cues.
    """

    def __init__(self, b: _Batch):
        p, every = b.points, np.arange(len(b.points), dtype=np.int32)
        han, line = (p >= 0x4E00) & (p <= 0x9FFF), p == 10
        on = np.where(han, every, np.int32(-1))
        on[:-1] = np.where(line[:-1] & han[1:], every[1:], on[:-1])  # the ideograph here or after one break, else -1
        two = np.flatnonzero(_IS_FIRST[p])
        two = two[np.isin(p[two].astype(np.int64) << 21 | p[two + 1], _DOUBLE)]
        two = two[on[two + 2] >= 0]
        one = np.setdiff1d(np.flatnonzero(_IS_SURNAME[p]), two, assume_unique=True)
        one = one[on[one + 1] >= 0]
        start, family = np.concatenate([one, two]), np.repeat([1, 2], [len(one), len(two)])
        order = np.argsort(start, kind="stable")
        start, family = start[order], family[order]
        first = on[start + family]
        second = on[first + 1]
        chars = np.zeros((len(start), 4), np.int64)  # wide enough for pairs
        chars[:, 0], chars[:, 1] = p[start], np.where(family == 2, p[start + 1], p[first])
        chars[:, 2] = np.where(family == 2, p[first], 0)
        longer, size = np.flatnonzero(second >= 0), family + 1
        more = chars[longer]
        more[np.arange(len(longer)), size[longer]] = p[second[longer]]
        begin, end = np.concatenate([start, start[longer]]), np.concatenate([first, second[longer]]) + 1
        chars, size = np.concatenate([chars, more]), np.concatenate([size, size[longer] + 1])
        double = np.isin(chars[:, 0] << 21 | chars[:, 1], _DOUBLE)
        kept = np.flatnonzero(~double | (size > 2))  # a double family name alone is no name
        kept = kept[np.lexsort((end[kept], begin[kept]))]
        self.begin, self.end, self.chars, self.size = begin, end, chars, size = begin[kept], end[kept], chars[kept], size[kept]
        self.double = double[kept]
        self.k = k = 1 + self.double
        self.row, self.breaks = b.row(begin), end - begin != size
        self.bounded = ~(han[end] | line[end] & han[end + 1])
        at = np.arange(len(begin))
        self.given, self.last = chars[at, k], chars[at, size - 1]  # first and last character of the given name
        before = np.maximum.accumulate(np.where(line, np.int32(-1), every))
        after = np.minimum.accumulate(np.where(line, np.int32(len(p)), every)[::-1])[::-1]
        held, follows = before[begin - 1], after[end]
        self.left, self.right = np.where(begin - held <= 14, p[held], b.END).astype(np.int64), np.where(follows - end < 14, p[follows], b.END).astype(np.int64)
        self.ends = _IS_END[self.right]
        self.pro = _IS_OPEN[self.left] | np.isin(p[before[np.maximum(held - 1, 0)]].astype(np.int64) << 21 | self.left, _CUE_ENDS)
        cue = CUES["name"][0]
        for i in np.flatnonzero(self.pro).tolist():
            self.pro[i] = bool(cue.search(b.joined[max(b.starts[self.row[i]], begin[i] - 14) : begin[i]].replace("\n", "")))
        stop = np.minimum.accumulate(np.where(_IS_STOP[p], every, len(p)).astype(np.int32)[::-1])[::-1]
        kinds = np.array([m.start() for m in _KINDS.finditer(b.joined)] + [2 * len(p)])
        kind = kinds[np.searchsorted(kinds, follows)]  # the next one
        against = _IS_UNIT[self.right] | (kind - follows <= 9) & (kind < stop[follows])
        for i in np.flatnonzero(follows - end > 2).tolist():
            rest = b.joined[end[i] : min(end[i] + 14, b.starts[self.row[i] + 1] - 1)].lstrip("\n")
            against[i] = bool(_UNIT.match(rest) or _ORGANISATION.match(rest))
        next_ = np.where(size - k > 1, self.last, self.right)
        some, chief = ord("某"), ord("总")
        self.con = against | (self.given == some) | (self.given == chief) | (self.last == some) | np.isin(self.given << 21 | next_, _TITLES)

    def features(self, m: PersonalModel) -> np.ndarray:
        """Features of every name, of which the first two are the cues."""
        given, left, right = np.zeros(_Batch.END + 1), np.zeros(_Batch.END + 1), np.zeros(_Batch.END + 1)
        surname = np.full(_Batch.END + 1, -3.0)
        for table, values in ((given, m.given), (left, m.left), (right, m.right)):
            table[[ord(c) if c else _Batch.END for c in values]] = list(values.values())
        alone = {c: v for c, v in m.surname.items() if len(c) == 1}
        surname[[ord(c) for c in alone]] = list(alone.values())
        family = surname[self.chars[:, 0]]
        family[self.double] = -3.0
        for c, v in m.surname.items():
            if len(c) == 2:
                family[self.double & (self.chars[:, 0] == ord(c[0])) & (self.chars[:, 1] == ord(c[1]))] = v
        number = self.size - self.k
        first, last = given[self.given], given[self.last]
        mean = np.where(number > 1, (first + last) / 2, first)
        han = (self.right >= 0x4E00) & (self.right <= 0x9FFF)
        return np.stack([self.pro, self.con, family, np.minimum(first, last), mean, number, left[self.left], right[self.right], self.double, self.breaks, self.ends, last, np.where(han, given[self.right], -9.0)], 1).astype(float)


def _tallied(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each equal keys, and their number."""
    order = np.lexsort(keys)
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def _email_spans(text: str, start: int, end: int):
    """A whole address, without its last part, and without what stands before a break or sign in its local part."""
    yield start, end
    dots = [m.start() for m in re.finditer("[.．。]", text[start:end])]
    if len(dots) > 1:
        yield start, start + dots[-1]
    at = re.search(r"[@＠\[(（]", text[start:end])
    for m in re.finditer(r"[\n._\-]", text[start : start + (at.start() if at else 0)]):
        if at.start() - m.end() >= 2:
            yield start + m.end(), end


def _address_starts(text: str, start: int, end: int):
    """Every place from which two to four ideographs and a unit follow, with two ideographs more before the house number."""
    han = [i for i in range(start, end) if text[i] != "\n"]
    for j in range(2, len(han) - 2):
        if text[han[j]] in UNITS:
            for k in (2, 3, 4):
                if j >= k:
                    yield han[j - k]


def _features(kind: str, text: str, start: int, end: int, m: PersonalModel) -> tuple[list[float], float, float]:
    """Features of a span that is no name, of which the first two are the cues; and the cues for and against."""
    span, before = text[start:end], text[max(0, start - 14) : start].replace("\n", "")
    yes, no = CUES[kind]
    pro, con = float(bool(yes.search(before))), float(bool(no.search(before)))
    breaks = float("\n" in span)
    flat = re.sub(r"[^0-9X]", "", span.translate(PLAIN))
    touching = float(bool(re.search(r"[0-9０-９][\n ]?$", text[max(0, start - 3) : start])) or bool(re.match(r"\n?[0-9０-９]", text[end : end + 2])))
    if kind == "phone":
        x = [pro, con, float(len(flat)), float(flat.startswith("86") or "+" in span or "＋" in span), float(flat[-11:-10] == "1"), float(flat[:1] == "0"), float(span[:1] in "（("), float(len(re.findall(r"[ \-－—]", span))), touching, breaks, float(len(re.findall("[OoIl]", span)))]
        return x, pro, max(con, touching)
    if kind == "id_number":
        date = flat[6:14] if len(flat) == 18 else "19" + flat[6:12]
        valid = float(len(date) == 8 and date.isdigit() and 1900 <= int(date[:4]) <= 2030 and 1 <= int(date[4:6]) <= 12 and 1 <= int(date[6:8]) <= 31)
        check = float(len(flat) == 18 and flat[:17].isdigit() and "10X98765432"[sum(int(a) * w for a, w in zip(flat[:17], _ID_WEIGHTS)) % 11] == flat[17])
        x = [pro, con, float(len(flat)), valid, check, float(flat[-1:] == "X"), float(flat[:1] in "123456789"), float(span.count(" ")), touching, breaks, float(len(re.findall("[OoIl]", span)))]
        return x, pro, max(con, touching, float(not valid))
    if kind == "email":
        local = re.split(r"[@＠\[(（]", span)[0]
        tail = re.split("[.．。]", span)[-1].strip()
        beyond = float(bool(re.match(r"[ ]?[.．]\s?[A-Za-z0-9]|[A-Za-z0-9]", text[end : end + 3])))
        inside = float(bool(re.search(r"[A-Za-z0-9._+\-][\n]?$", text[max(0, start - 2) : start])))
        x = [pro, con, float(min(len(local.strip()), 2)), float("\n" in local), breaks, float(bool(re.search(r"[@＠]", span))), inside, touching, beyond, float(min(len(tail), 3)), float(tail.isalpha())]
        return x, pro, float(len(local.strip()) < 2)
    flat = span.replace("\n", "")
    first = next(i for i, c in enumerate(flat) if c in UNITS and i >= 2)
    held = text[max(0, start - 8) : start].replace("\n", "")
    own = m.places.get(flat[: first + 1], 0)
    shorter, longer = m.places.get(flat[1 : first + 1], 0), m.places.get(held[-1:] + flat[: first + 1], 0)
    larger = float(bool(re.search(rf"[{HAN}]{{2}}[{UNITS}]$", held)))
    x = [pro, con, float(len(flat)), float(sum(flat.count(c) for c in UNITS)), float(sum(flat.count(c) for c in ("路", "街", "巷", "道", "里", "村", "镇", "园", "场", "寓", "苑", "小区", "组"))), float(flat[:1] in "在于至到向寄住是为由和与对被家"), float(bool(re.search("[在于至到向寄住为：，。]$", before))), float("法院" in flat or "民初" in flat or "民终" in flat or "条例" in flat), breaks, float(bool(re.search("(?:路|街|巷|道|里|村|组|园|场|镇|弄|寓|苑|区)[0-9０-９]+号$", flat))), touching, float(first), own / (shorter + 1.0) if first > 2 else 1.0, longer / (own + 1.0), larger, float(flat[0] in UNITS or flat[1] in UNITS)]
    return x, pro, max(x[7], float(x[4] == 0), x[15])


def _runs_on(text: str, start: int, end: int) -> str:
    """The name that ends one character later, of which a span may be only the beginning; '' if none does."""
    longer = NAME.match(text, start)
    on = longer and longer.end(1) == end and longer.group(2) and not _HAN.match(text[longer.end(2) : longer.end(2) + 2].lstrip("\n")[:1])
    return text[start : longer.end(2)].replace("\n", "") if on else ""


_BITS = [tuple("01"[f >> k & 1] for k in range(5)) for f in range(32)]


def _character(c: int) -> str:
    return chr(c) if c < _Batch.END else ""


def observed(texts: list[str]) -> Counter:
    """How often each thing that the model is learnt from occurs in texts, by (what, *parts).

    ``name``: what the label and the features of a name rest on: family name, given name, characters beside it, a longer name of which it
    may be the beginning, and the flags; ``span``: labelled spans of the other types with their features, and for addresses the three
    beginnings whose counts are features; ``held``: texts with a name, and whether after a cue; ``cued``: names in ``CUED_NAME``;
    ``place``: two to five ideographs before a unit, with the unit.
    """
    out: Counter = Counter()
    for part in bounded(texts, _CHARS):
        _observe(part, out)
    return out


def _observe(texts: list[str], out: Counter) -> None:
    b = _Batch(texts)
    names = _Names(b)
    n = len(names.begin)
    name = names.chars[:, 0] << 16 | names.chars[:, 1]
    name = name.astype(np.uint64) << np.uint64(32) | (names.chars[:, 2] << 16 | names.chars[:, 3]).astype(np.uint64)
    flags = np.stack([names.pro, names.con, names.breaks, names.ends, names.bounded], 1) @ (1 << np.arange(5))
    longer: dict[int, str] = {}
    for i in np.flatnonzero(names.pro & ~names.con & ~names.bounded).tolist():
        t, first = texts[names.row[i]], b.starts[names.row[i]]
        if on := _runs_on(t, int(names.begin[i] - first), int(names.end[i] - first)):
            longer[i] = on
    # what runs on is seldom, and stays by itself
    apart = np.zeros(n, np.int64)
    apart[list(longer)] = np.arange(1, len(longer) + 1)
    begin, end = names.begin.tolist(), names.end.tolist()
    flat = lambda i: b.joined[begin[i] : end[i]].replace("\n", "")
    at, number = _tallied(name, names.left << 21 | names.right, flags, apart)
    for i, c, k, left, right, f in zip(at.tolist(), number.tolist(), names.k[at].tolist(), names.left[at].tolist(), names.right[at].tolist(), flags[at].tolist()):
        own = flat(i)
        out["name", own[:k], own[k:], _character(left), _character(right), longer.get(i, ""), *_BITS[f]] += c
    # each name of a text once, with a cue if any of its places has one
    order = np.lexsort((~names.pro, name, names.row))
    new = np.ones(n, bool)
    new[1:] = (name[order[1:]] != name[order[:-1]]) | (names.row[order[1:]] != names.row[order[:-1]])
    once = order[new]
    at, number = _tallied(name[once], names.pro[once])
    for i, c in zip(once[at].tolist(), number.tolist()):
        out["held", flat(i), str(int(names.pro[i]))] += c
    out.update(("cued", x.group(1)) for x in CUED_NAME.finditer(b.joined))
    none = PersonalModel()
    others: dict[tuple[int, str], list] = {}
    for r, k, start, stop in b.others():
        others.setdefault((r, k), []).append((start, stop, *_features(k, texts[r], start, stop, none)))
    for (r, k), mine in others.items():
        t = texts[r]
        key = lambda a, b: b if k == "address" else t.find("@", a)  # noqa: B023, E731
        # ends (of addresses) or places (of e-mail addresses) at which a span is marked by a cue
        sure = {key(x, y): (x, y) for x, y, _, pro, con in reversed(mine) if pro and not con}
        for start, stop, x, pro, con in mine:
            if k in ("email", "address"):
                best = sure.get(key(start, stop))
                label = 0 if con or best and best != (start, stop) else 1 if best else -1
            else:
                label = 1 if pro and not con else 0 if con else 1 if k != "phone" or PHONE.fullmatch(t, start, stop) else -1
            if label >= 0 or k == "address":
                out[("span", k, str(label), " ".join(map(repr, x)), *(_beginnings(t, start, stop) if k == "address" else ()))] += 1
    text, p = b.joined.replace("\n", ""), b.points[b.points != 10]
    run = np.arange(len(p)) - np.maximum.accumulate(np.where((p >= 0x4E00) & (p <= 0x9FFF), 0, np.arange(len(p))))
    units = np.flatnonzero(_IS_LARGE[p])
    ends = [units[run[units] >= k] for k in range(3, 7)]
    at, lengths = np.concatenate(ends), np.repeat(range(3, 7), list(map(len, ends)))
    back = [np.where(lengths > j, p[np.maximum(at - j, 0)], 0).astype(np.uint64) for j in range(6)]
    one, number = _tallied(back[0] | back[1] << np.uint64(16) | back[2] << np.uint64(32) | back[3] << np.uint64(48), back[4] | back[5] << np.uint64(16))
    for e, k, c in zip(at[one].tolist(), lengths[one].tolist(), number.tolist()):
        out["place", text[e - k + 1 : e + 1]] += c


def _beginnings(text: str, start: int, end: int) -> tuple[str, str, str]:
    """An address down to its first unit; the same without its first character, and with the one before it."""
    flat, held = text[start:end].replace("\n", ""), text[max(0, start - 8) : start].replace("\n", "")
    first = next(i for i, c in enumerate(flat) if c in UNITS and i >= 2)
    return flat[: first + 1], flat[1 : first + 1], held[-1:] + flat[: first + 1]


class _Seen:
    """Observations of a list of texts."""

    def __init__(self, texts: list[str]):
        self.counts = observed(texts)

    def total(self, what: str, sums) -> dict[tuple, float]:
        """``sums`` of all observations ((parts), n) of a kind."""
        return sums([(k[1:], n) for k, n in self.counts.items() if k[0] == what])

    def genuine(self, share: float) -> set[str]:
        held, cued = Counter(), Counter()
        for k, n in self.counts.items():
            if k[0] == "held":
                held[k[1]] += n
                cued[k[1]] += n * int(k[2])
        return {x for x, c in cued.items() if c and c >= share * held[x]}

    def places(self) -> dict[str, int]:
        return {k[1]: n for k, n in self.counts.items() if k[0] == "place" and n >= 2}


class _SeenRows(_Seen):
    """Observations of all rows of one-column frames: counted in batches and summed in a written table."""

    def __init__(self, fields: list[DataFrame]):
        def count(batches):
            for b in batches:
                seen = observed(strings(b.column(0)))
                offsets = np.cumsum([0, *(len(k) - 1 for k in seen)], dtype=np.int32)
                parts = pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for k in seen for x in k[1:]], pa.string()))
                yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), parts, pa.array(list(seen.values()), pa.int64())], names=["what", "parts", "n"])

        every = None
        for f in fields:
            part = f.mapInArrow(count, "what string, parts array<string>, n long")
            every = part if every is None else every.unionByName(part)
        self.rows = written(every.groupBy("what", "parts").agg(F.sum("n").alias("n")))

    def total(self, what: str, sums) -> dict[tuple, float]:
        def part(batches):
            for b in batches:
                out = sums(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
                yield pa.record_batch([pa.array([list(map(str, k)) for k in out], pa.list_(pa.string())), pa.array(list(out.values()), pa.float64())], names=["key", "w"])

        found = self.rows.where(F.col("what") == what).select("parts", "n").mapInArrow(part, "key array<string>, w double")
        return {tuple(r["key"]): r["w"] for r in found.groupBy("key").agg(F.sum("w").alias("w")).collect()}

    def genuine(self, share: float) -> set[str]:
        held = self.rows.where("what = 'held'").groupBy(F.col("parts")[0].alias("name"))
        cued = held.agg(F.sum("n").alias("held"), F.sum(F.col("n") * F.col("parts")[1].cast("long")).alias("cued"))
        return {r["name"] for r in cued.where((F.col("cued") > 0) & (F.col("cued") >= share * F.col("held"))).collect()}

    def places(self) -> dict[str, int]:
        # only those that are looked up: beginnings of addresses
        asked = self.rows.where("what = 'span' AND parts[0] = 'address'").select(F.explode(F.expr("slice(parts, 4, 3)")).alias("name")).distinct()
        counted = self.rows.where("what = 'place' AND n >= 2").select(F.col("parts")[0].alias("name"), "n")
        return {r["name"]: r["n"] for r in counted.join(asked, "name", "left_semi").collect()}


def _added(pairs) -> dict[tuple, float]:
    out: dict[tuple, float] = {}
    for k, w in pairs:
        out[k] = out.get(k, 0) + w
    return out


def _fitted(seen: _Seen, every: Counter, precision: float, seed: int, share: float = 0.2, draws: int = 8) -> PersonalModel:
    """The model of all observations; ``every`` counts characters. A name is genuine if it stands after a cue in ``share`` of its texts.

    Examples that are equal in all features, rounded, are learnt as one that counts by a power (0.75) of their number, so that rare forms
    of names are learnt; those kept apart count by their number. Half of each number is learnt with the cues hidden; a true name is
    learnt in ``draws`` variants that share its number.
    """
    m = PersonalModel(places=seen.places())
    genuine = seen.genuine(share)

    def whole_names(rows):
        for (n,), w in rows:
            k = 2 if n[:2] in DOUBLE_SURNAMES else 1
            if "某" not in n and len(n) > k and not _TITLE.match(n[k:]) and n in genuine:
                yield from [(("family", n[:k]), w), *((("given", c), w) for c in n[k:])]

    family, given = Counter(), Counter()
    for (which, c), w in seen.total("cued", lambda rows: _added(whole_names(rows))).items():
        (family if which == "family" else given)[c] = w
    total, cued = sum(every.values()) or 1, sum(given.values()) or 1
    # how much more often a character stands in names than elsewhere; without a name seen with it, never more
    odds = lambda c, v: round(float(np.log((v + 0.5) / cued) - np.log((every[c] + 0.5) / total)), 1)
    m.given = {c: odds(c, given[c]) if given[c] else min(0.0, odds(c, 0)) for c in every if _HAN.match(c)}
    most = sum(family.values()) or 1
    m.surname = {c: round(float(np.log((v + 0.5) / most) - np.log((every[c[-1]] + 0.5) / total)), 1) for c, v in family.items()}

    def beside(rows):
        for (fam, own, left, right, _, _, con, *_), w in rows:
            if fam in family and all(given[c] for c in own):
                yield from [(("l", left, con), w), (("r", right, con), w)]

    sides: dict[str, tuple[Counter, Counter]] = {"l": (Counter(), Counter()), "r": (Counter(), Counter())}
    for (side, c, con), w in seen.total("name", lambda rows: _added(beside(rows))).items():
        sides[side][0][c] += w
        sides[side][1][c] += w * int(con)
    for side, table in (("l", m.left), ("r", m.right)):
        both, sure = sides[side]
        bad = sum(sure.values()) or 1
        table.update({c: round(-float(np.log((sure[c] + 1) / bad) - np.log((v + 1) / sum(both.values()))), 1) for c, v in both.items() if v >= 3})
    plain = [c for c in every if _HAN.match(c) and not given[c]] or ["一"]
    weight = np.cumsum([every[c] + 1.0 for c in plain])

    def names(rows):
        for parts, w in rows:
            fam, own, left, right, longer = parts[:5]
            pro, con, breaks, ends, bounded = map(int, parts[5:])
            if con:
                label = 0
            elif pro and bounded:
                label = int(fam + own in genuine)
            elif pro:
                # only the beginning of a longer name, or a name and the first character after it; else undecided
                label = 0 if longer in genuine or len(own) == 2 and given[own[0]] and not given[own[1]] else -1
            else:
                label = -1 if fam in family and all(given[c] for c in own) else 0
            if label < 0:
                continue
            rng = np.random.default_rng([seed, zlib.crc32("\x1f".join(parts).encode("utf-8", "surrogatepass"))])
            g = [m.given.get(c, 0.0) for c in own]
            x = [float(pro), float(con), m.surname.get(fam, -3.0), min(g), sum(g) / len(g), float(len(own)), m.left.get(left, 0.0), m.right.get(right, 0.0), float(len(fam) > 1), float(breaks), float(ends), g[-1], m.given.get(right, 0.0) if _HAN.match(right) else -9.0]
            for apart, n in _parted(rng, w):
                if not label:
                    values = " ".join(f"{v:.2f}" for v in x[1:])
                    yield ("name", str(apart), "0", f"{x[0]:.2f} {values}"), n / 2
                    yield ("name", str(apart), "0", f"0.00 {values}"), n / 2
                    continue
                around = iter(np.searchsorted(weight, rng.random(2 * draws) * weight[-1], side="right"))
                for d in range(draws):
                    y, other = list(x), rng.random()
                    if 2 * d < draws:
                        y[0], y[6] = 0.0, m.left.get(plain[next(around)], 0.0)
                    elif rng.random() < 0.4:
                        # as if characters of the name, or the family name, had been in no other: a clear cue has to carry it
                        h = [m.given.get(c, 0.0) if rng.random() < 0.4 else min(0.0, odds(c, 0)) for c in own]
                        y[3], y[4], y[11] = min(h), sum(h) / len(h), h[-1]
                        if rng.random() < 0.5:
                            y[2] = -3.0
                    if other < 0.5:
                        # as if the sentence went on after the name
                        c = plain[next(around)]
                        y[7], y[10], y[12] = m.right.get(c, 0.0), 0.0, m.given.get(c, 0.0)
                    yield _example("name", apart, label, y), n / draws

    def others(rows):
        for (kind, label, values, *asked), w in rows:
            if label == "-1":
                continue
            x = list(map(float, values.split()))
            if kind == "address":
                own, shorter, longer = (m.places.get(c, 0) for c in asked)
                x[12], x[13] = own / (shorter + 1.0) if x[11] > 2 else 1.0, longer / (own + 1.0)
            rng = np.random.default_rng([seed, zlib.crc32(" ".join([values, *asked]).encode("utf-8", "surrogatepass"))])
            for apart, n in _parted(rng, w):
                yield _example(kind, apart, label, x), n / 2
                yield _example(kind, apart, label, [0.0, 0.0, *x[2:]]), n / 2

    examples = seen.total("name", lambda rows: _added(names(rows))) | seen.total("span", lambda rows: _added(others(rows)))
    for kind in TYPES:
        mine = sorted((k, w) for k, w in examples.items() if k[0] == kind)
        y = np.array([int(k[2]) for k, _ in mine])
        w, apart = np.array([w for _, w in mine]), np.array([k[1] == "1" for k, _ in mine], bool)
        if len(mine) and w.sum() >= 40 and 0 < y[~apart].sum() < (~apart).sum():
            m.trees[kind] = BoostedTrees(seed=seed).fit(np.array([list(map(float, k[3].split())) for k, _ in mine]), y, precision, np.where(apart, w, w**0.75), apart)
        m.threshold[kind] = m.trees[kind].threshold if kind in m.trees else 0.5
    return m


def _parted(rng: np.random.Generator, n: int) -> list[tuple[int, int]]:
    """(apart, number) of ``n`` equal examples, about a fifth of which are kept apart."""
    held = int(rng.binomial(n, 0.2))
    return [(apart, k) for apart, k in ((0, n - held), (1, held)) if k]


def _example(kind: str, apart: int, label, x: list[float]) -> tuple[str, str, str, str]:
    return kind, str(apart), str(label), " ".join(f"{v:.2f}" for v in x)


def fit_personal_model(texts: list[str], background: Counter | None = None, precision: float = 0.97, seed: int = 0) -> PersonalModel:
    """Fit on a list of texts; see the module's docstring for where labels come from.

    ``background`` counts characters (default: over the texts). ``precision`` is what each type's threshold must have on the
    examples kept apart.
    """
    return _fitted(_Seen(texts), background or Counter(c for t in texts for c in t), precision, seed)


def _judge(texts: list[str], m: PersonalModel):
    """(row, type, start, end) of every accepted span of the texts, none overlapping another of its row."""
    first = 0
    for part in bounded(texts, _CHARS):
        yield from ((first + r, kind, a, b) for r, kind, a, b in _judged(part, m))
        first += len(part)


def _judged(texts: list[str], m: PersonalModel):
    batch = _Batch(texts)
    names, others = _Names(batch), list(batch.others())
    by_kind: dict[str, list] = {}
    for f in others:
        by_kind.setdefault(f[1], []).append(f)
    found = []
    for kind in TYPES:
        mine = by_kind.get(kind, [])
        x = names.features(m) if kind == "name" else np.array([_features(kind, texts[r], a, b, m)[0] for r, _, a, b in mine])
        if not len(x):
            continue
        p = m.trees[kind].probability(x) if kind in m.trees else 1.0 - 0.9 * (x[:, 1] > 0)
        for i in np.flatnonzero((p >= m.threshold[kind]) & (p > 0)).tolist():
            r = int(names.row[i]) if kind == "name" else mine[i][0]
            a, b = (int(names.begin[i] - batch.starts[r]), int(names.end[i] - batch.starts[r])) if kind == "name" else mine[i][2:]
            found.append((r, -np.round(p[i], 1 if kind in ("name", "phone", "id_number") else 6), a - b, a, TYPES.index(kind), kind, b))
    row, taken = -1, []
    for r, _, _, a, _, kind, b in sorted(found):
        if r != row:
            row, taken = r, []
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            yield r, kind, a, b


def character_counts(fields: list[DataFrame], bits: int = 18) -> Counter:
    """Occurrences of every character below 2**18 over all rows of the one-column frames."""
    every = Counter()
    for f in fields:

        def count(batch):
            points, _ = code_points(strings(batch.column(0)))
            return np.bincount(points[points < 1 << bits], minlength=1 << bits)[None]

        total = histogram(f, count, bits)[0]
        every.update({chr(int(c)): int(total[c]) for c in np.flatnonzero(total)})
    return every


def personal_model(fields: list[DataFrame], precision: float = 0.97, seed: int = 0) -> PersonalModel:
    """Fit on all rows of the one-column frames: counts, labels, trees and thresholds take in every text."""
    fields = [f.where(F.col(f.columns[0]).isNotNull()) for f in fields]
    return _fitted(_SeenRows(fields), character_counts(fields), precision, seed)


def personal_spans(rows: DataFrame, model: PersonalModel, text_col: str, id_col: str = "id") -> DataFrame:
    """(row_id, pii_type, start_pos, end_pos): 1-based code-point positions of every span; end_pos is its last character.

    NULL and '' have none. Whole texts are searched. Empty input gives no rows; other columns are ignored.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def search(batches):
        m = shared.value
        for b in batches:
            spans = list(_judge(strings(b.column(1)), m))
            at = pa.array([s[0] for s in spans], pa.int64())
            yield pa.record_batch([b.column(0).take(at), pa.array([s[1] for s in spans], pa.string()), pa.array([s[2] + 1 for s in spans], pa.int32()), pa.array([s[3] for s in spans], pa.int32())], names=["row_id", "pii_type", "start_pos", "end_pos"])

    return rows.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(search, f"row_id {kind}, pii_type string, start_pos int, end_pos int")


def redacted(rows: DataFrame, model: PersonalModel, text_cols: list[str], id_col: str = "id") -> DataFrame:
    """(id_col, *text_cols): every row, each personal span replaced by its type in angle brackets, the rest left as it is."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[id_col].dataType.simpleString()

    def replace(batches):
        m = shared.value
        for b in batches:
            out = [b.column(0)]
            for c in range(1, b.num_columns):
                values = b.column(c).to_pylist()
                texts = [v or "" for v in values]
                spans: dict[int, list] = {}
                for r, k, a, e in _judge(texts, m):
                    spans.setdefault(r, []).append((a, e, k))
                for r, s in spans.items():
                    t = texts[r]
                    for a, e, k in sorted(s, reverse=True):
                        t = f"{t[:a]}<{k}>{t[e:]}"
                    values[r] = t
                out.append(pa.array(values, pa.string()))
            yield pa.record_batch(out, names=b.schema.names)

    return rows.select(id_col, *text_cols).mapInArrow(replace, f"{id_col} {kind}, " + ", ".join(f"{c} string" for c in text_cols))
