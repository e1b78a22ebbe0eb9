"""Noise of scanned pages in text, and its repair into continuous paragraphs (problem 1).

Two averaged perceptrons are trained. One judges lines: page numbers and running heads, by page position, form, neighbours and how
often the same masked line recurs in the whole collection. The other edits characters: keep, replace (a misread character or letter
group), delete (a break sign at a line end), join (a line break inside a paragraph) and insert (a space in place of a break between
Latin words). It learns from pages made of the collection's own clean text by misreading, breaking and wrapping it; its strongest
features compare how often the characters around a place occur in all documents with and without the edit. Sequences, words and line
forms are counted in tables of their own, of fixed sizes, and what a bucket holds in the median is taken off again.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import bounded, code_points, histogram, mixed_hash, strings

# Characters often misread for another, as misread then right.
MISREAD = (
    "阪限 吿告 入人 人入 走定 阮院 旳的 仪议 仟任 冃月 冋同 屦履 午年 又双 钓约 兰当 曰日 鉴签 捐损 末未 未末 兀元 莒营 汜记 椐据 亊事 货赁 埋理 朝期 土上 全金 士土 千干 太大 大太 天夭 戌戊 王玉 问间 "
    "侯候 己已 巳已 卜上 囗口 曰目 白自 臼白 干千 刀力 贝见 儿几 九丸 办为 末来 束束 侍待 侍持 折拆 析折 沒没 洁法 泫法 法泫 戶户 青责 贵责 责贵 查杳 杳查 巿市 申甲 由田 甴由 厂广 広广 夫失 失夫 牛生 止正"
).split()
# Letter groups often misread in Latin words, as misread then right.
LETTERS = "li h,d cl,rn m,u n,n u,c e,e c,0 o,O 0,1 l,l 1,I l,l I,vv w,ii n,b h,h b,f t,5 s,8 B,tl th,m rn,cl d,h li"

WRONG: dict[str, list[str]] = {}
RIGHT: dict[str, list[str]] = {}
for _p in MISREAD:
    if _p[0] != _p[1]:
        WRONG.setdefault(_p[0], []).append(_p[1])
        RIGHT.setdefault(_p[1], []).append(_p[0])
GROUPS = [tuple(x.split()) for x in LETTERS.split(",")]

BITS = 22
#: The table holds three-character sequences in its first half, Latin words and line forms in a quarter each.
SEQUENCES, WORDS, FORMS = (0, 21), (1 << 21, 20), ((1 << 21) + (1 << 20), 20)
#: Share of all Latin words from which on a word may stand in another's place; 20 occurrences are needed in any case.
LEAST_WORD = 2e-5
WRONG_CHAR = re.compile("[" + "".join(sorted(WRONG)) + "]")
WORD = re.compile(r"[A-Za-zÀ-ÿ0-9]*[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9]*")
IN_NUMBER = re.compile(r"(?<=[0-9])[OoIl](?=[0-9年月日元号%.,])|(?<=[0-9,.])[OoIl](?=[0-9])")
BREAK = re.compile(r"([A-Za-zÀ-ÿ]+)([-‐‑¬­–])[ \t]*\r?\n[ \t]*([a-zà-ÿ]+)")
AMOUNT = re.compile(r"^[0-9,，]+[.．][0-9]{2}$|^合计$")
NUMBER_LINE = re.compile(r"^(?:第\s*[0-9０-９]{1,4}\s*页|[Pp]age\s*[0-9]{1,4}|[\[(（【·\-—–~\s]*[0-9０-９]{1,4}[\])）】·\-—–~\s]*|[0-9]{1,4}\s*/\s*[0-9]{1,4})$")
HEAD_NUMBER = re.compile(r"^(?P<a>\S.*?)(?:[ 　\t]{2,}|\s*[｜|]\s*|\s*(?:…|·{2,}|\.{3,})+\s*)(?P<n>[0-9０-９]{1,4})$|^(?P<m>[0-9０-９]{1,4})(?:[ 　\t]{2,}|\s*[｜|]\s*)(?P<b>\S.*)$")
UPPER = re.compile(r"^[A-Z][A-Z0-9 ()&'.\-]{5,}$")
ENDED = re.compile(r"[。！？!?；;：:.】》）)”]\s*$")
STARTS = re.compile(r"^\s*(?:【|第[一二三四五六七八九十百零0-9]+[条章编节]|Article\s|[0-9]{1,2}[.．、]\s?\D|（[一二三四五六七八九十]）|[一二三四五六七八九十]、|被告[：:])")


def _h(text: str, salt: int, part: tuple[int, int]) -> int:
    return part[0] + ((zlib.crc32(text.encode("utf-8", "surrogatepass"), salt * 0x9E3779B1 & 0xFFFFFFFF) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - part[1]))


def _three(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    v = (a.astype(np.uint64) << np.uint64(42)) | (b.astype(np.uint64) << np.uint64(21)) | c.astype(np.uint64)
    return (mixed_hash(v, 1) >> np.uint64(64 - SEQUENCES[1])).astype(np.int64)


_ALL = (1 << 64) - 1


def _three_of(s: str) -> int:
    """``_three`` of one string of three characters."""
    x = ((ord(s[0]) << 42 | ord(s[1]) << 21 | ord(s[2])) ^ 0x2545F4914F6CDD1D) * 0x9E3779B97F4A7C15 & _ALL
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & _ALL
    return (x ^ x >> 32) >> (64 - SEQUENCES[1])


_LINE_FORM = re.compile(r"[0-9０-９]+|[ 　\t｜|…·.]+")


def line_form(line: str) -> str:
    """A line without digits, white space and leaders: what recurs of a head."""
    return _LINE_FORM.sub("", line)


def corpus_counts(texts: DataFrame) -> np.ndarray:
    """Counts over all rows: three-character sequences without line breaks, Latin words, and short lines' forms."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((1, 1 << BITS), np.int64)
        for part in bounded(strings(batch.column(0))):
            flat = [re.sub(r"\s*\n\s*", "", t) for t in part]
            points, offsets = code_points(flat)
            if len(points) >= 3:
                of = np.repeat(np.arange(len(flat)), np.diff(offsets))
                inside = of[:-2] == of[2:]
                out[0] += np.bincount(_three(points[:-2], points[1:-1], points[2:])[inside], minlength=1 << BITS)
            extra: dict[str, int] = {}
            forms: dict[str, int] = {}
            for t in part:
                for w in WORD.findall(t):
                    extra[w] = extra.get(w, 0) + 1
                for line in t.split("\n"):
                    if 2 <= len(line) <= 44:
                        f = line_form(line)
                        forms[f] = forms.get(f, 0) + 1
            for w, k in extra.items():
                out[0, _h(w, 2, WORDS)] += k
                out[0, _h(w, 5, WORDS)] += k
            for f, k in forms.items():
                out[0, _h(f, 3, FORMS)] += k
        return out

    return np.minimum(histogram(texts, count, BITS)[0], (1 << 31) - 1).astype(np.int32)


class Perceptron:
    """Averaged perceptron over named features; the weights are the mean of those of all steps."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = {}

    def fit(self, examples: list[tuple[list[str], str]], labels: list[str], epochs: int = 5, seed: int = 0) -> Perceptron:
        w, total, last = {}, {}, {}
        rng, step = np.random.default_rng(seed), 0
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                f, y = examples[i]
                step += 1
                scores = [sum(w.get((x, k), 0.0) for x in f) for k in labels]
                guess = labels[int(np.argmax(scores))]
                if guess != y:
                    for x in f:
                        for key, d in (((x, y), 1.0), ((x, guess), -1.0)):
                            total[key] = total.get(key, 0.0) + w.get(key, 0.0) * (step - last.get(key, 0))
                            last[key] = step
                            w[key] = w.get(key, 0.0) + d
        self.labels = labels
        self.w = {k: (total.get(k, 0.0) + v * (step - last.get(k, 0))) / max(step, 1) for k, v in w.items()}
        return self

    def best(self, features: list[str]) -> str:
        return max(self.labels, key=lambda k: sum(self.w.get((x, k), 0.0) for x in features))


@dataclass
class PageModel:
    counts: np.ndarray
    lines: Perceptron
    edits: Perceptron

    def __post_init__(self):
        self._words: dict[str, int] = {}
        # what half of the buckets hold without any entry of note, to be taken off each count
        tables = [self.counts[a : a + (1 << bits)] for a, bits in (SEQUENCES, WORDS, FORMS)]
        self.load = [int(np.median(x)) for x in tables]
        self.least_word = max(20.0, LEAST_WORD * tables[1].sum(dtype=np.int64) / 2)

    def form(self, line: str) -> int:
        return max(0, self.counts.item(_h(line_form(line), 3, FORMS)) - self.load[2])

    def word(self, w: str) -> int:
        n = self._words.get(w)
        if n is None:
            if len(self._words) > 200_000:
                self._words.clear()
            n = self._words[w] = max(0, min(self.counts.item(_h(w, 2, WORDS)), self.counts.item(_h(w, 5, WORDS))) - self.load[1])
        return n

    def ratios(self, text: str, i: int, c: str) -> list[float]:
        """Log of how much likelier the three sequences around place i are with ``c`` than with what stands there."""
        a, b = text[max(0, i - 2) : i], text[i + 1 : i + 3]
        out = []
        for left, right in ((a[-2:], ""), (a[-1:], b[:1]), ("", b[:2])):
            if len(left) + len(right) < 2:
                out.append(0.0)
                continue
            edit, stay = (max(0, self.counts.item(_three_of(left + y + right)) - self.load[0]) for y in (c, text[i]))
            out.append(math.log((edit + 0.5) / (stay + 0.5)))
        return out


def _bucket(x: float) -> int:
    return max(-4, min(6, math.floor(x)))


def _char_features(m: PageModel, text: str, i: int, c: str) -> list[str]:
    r = m.ratios(text, i, c)
    s = sorted(_bucket(x) for x in r)
    return ["char", f"pair{text[i]}{c}", f"max{s[-1]}", f"mid{s[1]}", f"min{s[0]}", f"sum{_bucket(sum(r) / 2)}", f"mid{s[1]}max{s[-1]}"]


def _word_features(m: PageModel, w: str, c: str, group: tuple[str, str]) -> list[str]:
    a, b = m.word(w), m.word(c)
    r = _bucket(math.log((b + 0.5) / (a + 0.5)))
    return ["word", f"group{group[0]}>{group[1]}", f"wr{r}", f"wb{_bucket(math.log(b + 1) / 2)}", f"wr{r}b{min(4, int(math.log(b + 1)))}", f"digit{any(map(str.isdigit, w))}{r > 0}", f"len{min(len(w), 6)}"]


def word_variants(w: str):
    """Words that ``w`` could be a misreading of."""
    for g in GROUPS:
        at = w.find(g[0])
        while at >= 0:
            yield w[:at] + g[1] + w[at + len(g[0]) :], g
            at = w.find(g[0], at + 1)


def _break_features(m: PageModel, left: str, sign: str, right: str, seen: int = 0) -> list[str]:
    """``seen``: how often the whole word is to be counted less, as it stands here itself."""
    joined, kept = max(0, m.word(left + right) - seen), m.word(left) + m.word(right)
    return ["hyphen", f"sign{sign}", f"joined{_bucket(math.log(joined + 1))}", f"halves{_bucket(math.log(min(m.word(left), m.word(right)) + 1))}", f"more{joined > kept}", f"short{min(len(right), 4)}", f"left{min(len(left), 4)}"]


def _join_features(prev: str, nxt: str, width: int) -> list[str]:
    a, b = prev.rstrip()[-1:], nxt.lstrip()[:1]
    kind = lambda x: "han" if "㐀" <= x <= "鿿" else "low" if x.islower() else "up" if x.isupper() else "dig" if x.isdigit() else x
    full = min(10, int(10 * len(prev.strip()) / max(width, 1)))
    ended, starts = bool(ENDED.search(prev)), bool(STARTS.match(nxt))
    return ["line", f"a{kind(a)}", f"b{kind(b)}", f"full{full}", f"ended{ended}{full >= 8}", f"starts{starts}", f"ab{kind(a)}{kind(b)}", f"e{ended}{starts}{kind(a) in ('low', 'up')}"]


HEAD_START = re.compile(r"^(?:第[一二三四五六七八九十百0-9]+[编章节篇部]|Chapter\s+[0-9IVX]+|CHAPTER|Part\s+[0-9IVX]+|[一二三四五六七八九十]+、)")


def _line_features(m: PageModel, lines: list[str], k: int, stem: str) -> list[str] | None:
    """Features of a line that may be furniture; None if its form rules that out."""
    line = lines[k].strip()
    if not line or len(line) > 48 or "【" in line:
        return None
    number = bool(NUMBER_LINE.match(line))
    attached = None if number else HEAD_NUMBER.match(line)
    core = (attached["a"] or attached["b"]) if attached else line
    if not number and (re.search(r"[。，；：！？,;:?!]|\.$", core) or len(core) < 2 or AMOUNT.match(line)):
        return None
    before, after = next((x for x in reversed(lines[:k]) if x.strip()), ""), next((x for x in lines[k + 1 :] if x.strip()), "")
    table = bool(AMOUNT.match(before.strip()) or AMOUNT.match(after.strip()))
    n = m.form(line)
    seen = _bucket(math.log(n + 1))
    title = bool(HEAD_START.match(core))
    book = core[:3] == stem[:3] or bool(re.search(r"(?:选编|汇编|文集|读本|手册|教程|案例|ORDINANCE|ordinance)", core))
    upper = bool(UPPER.match(core))
    place = "only" if len(lines) == 1 else "first" if k == 0 else "second" if k == 1 else "last" if k == len(lines) - 1 else "inner"
    shape = ("bare" if line.isdigit() else "decorated") if number else "attached" if attached else "plain"
    open_ = not ENDED.search(before) if before else False
    low = core[:1].islower()
    return [
        f"shape{shape}", f"place{place}", f"place{place}{shape}", f"title{title}{shape}", f"book{book}{shape}", f"upper{upper}", f"table{table}{shape}", f"seen{seen}{shape}", f"open{open_}{shape}", f"len{min(6, len(core) // 4)}{shape}",
        f"low{low}", f"digits{sum(map(str.isdigit, line))}{shape}", f"start{core[:2]}", f"end{core[-2:]}", f"t{title}{book}{upper}",
    ]


def page_furniture(m: PageModel, text: str, stem: str) -> list[tuple[int, bool, bool]]:
    """(line index, is head, has page number) of each line that belongs to the page."""
    lines, out = text.replace("\r", "").split("\n"), []
    for k, line in enumerate(lines):
        f = _line_features(m, lines, k, stem)
        if f and m.lines.best(f) == "page":
            s = line.strip()
            number = bool(NUMBER_LINE.match(s))
            out.append((k, not number, number or bool(HEAD_NUMBER.match(s))))
    return out


def edited(m: PageModel, text: str, stem: str) -> tuple[str, set[str]]:
    """The repaired text and the kinds of noise that were in it."""
    kinds: set[str] = set()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    gone = set()
    for k, head, number in page_furniture(m, text, stem):
        gone.add(k)
        kinds |= {"running_head"} if head else set()
        kinds |= {"page_number"} if number else set()
    kept = [x for k, x in enumerate(lines) if k not in gone]
    text = "\n".join(kept)

    def mend(x: re.Match) -> str:
        if m.edits.best(_break_features(m, x[1], x[2], x[3])) == "delete":
            kinds.add("hyphen_break")
            return x[1] + x[3]
        return x[1] + x[2] + x[3]

    text = BREAK.sub(mend, text)
    kept = [x for x in text.split("\n") if x.strip()]
    width = max((len(x.strip()) for x in kept), default=0)
    out = kept[0].strip() if kept else ""
    for prev, nxt in zip(kept, kept[1:]):
        op = m.edits.best(_join_features(prev, nxt, width))
        out += {"join": "", "insert": " "}.get(op, "\n") + nxt.strip()
    done, at = [], 0
    for i in [x.start() for x in WRONG_CHAR.finditer(out)]:
        options = [(sum(m.ratios(out, i, c)), c) for c in WRONG[out[i]]]
        c = max(options)[1]
        if m.edits.best(_char_features(m, out, i, c)) == "replace":
            kinds.add("wrong_char")
            done.append((i, i + 1, c))
    for x in IN_NUMBER.finditer(out):
        kinds.add("wrong_char")
        done.append((x.start(), x.end(), "0" if x[0] in "Oo" else "1"))
    for x in WORD.finditer(out):
        c = best_word(m, x[0])
        if c and not any(a < x.end() and b > x.start() for a, b, _ in done):
            kinds.add("wrong_char")
            done.append((x.start(), x.end(), c))
    parts = []
    for a, b, c in sorted(done):
        parts += [out[at:a], c]
        at = b
    return "".join([*parts, out[at:]]), kinds


_best: dict = {}


def best_word(m: PageModel, w: str) -> str | None:
    """The word that ``w`` was most likely misread from, if the editor replaces it."""
    key = (id(m), w)
    if key not in _best:
        if len(_best) > 200_000:
            _best.clear()
        options = [(m.word(c), c, g) for c, g in word_variants(w)] if len(w) >= 2 else []
        top = max(options, default=None)
        _best[key] = top[1] if top and top[0] >= max(m.least_word, 5 * m.word(w)) and m.edits.best(_word_features(m, w, top[1], top[2])) == "replace" else None
    return _best[key]


def fit_page_model(counts: np.ndarray, clean: list[str], pages: list[tuple[str, str]], seed: int = 0) -> PageModel:
    """Fit on clean texts and on (text, source) pages, both bounded samples.

    Lines are labelled by what can't be otherwise: decorated numbers, numbered or clearly titled heads are of the page; lines
    beside amounts, cut sentences and short lines of clean texts are not; the rest is left out of the fit.
    """
    rng = np.random.default_rng(seed)
    m = PageModel(counts, Perceptron(), Perceptron())
    ex: list[tuple[list[str], str]] = []
    for t in clean:
        flat = re.sub(r"\s*\n\s*", "", t)
        for i, c in enumerate(flat):
            if c in RIGHT and rng.random() < 0.15:
                f = RIGHT[c][int(rng.integers(len(RIGHT[c])))]
                ex.append((_char_features(m, flat[:i] + f + flat[i + 1 :], i, c), "replace"))
            if c in WRONG:
                ex.append((_char_features(m, flat, i, max((sum(m.ratios(flat, i, r)), r) for r in WRONG[c])[1]), "keep"))
        paragraphs = [p for p in t.replace("\r", "").split("\n") if p.strip()]
        wrapped = []
        width = int(rng.integers(18, 40))
        for p in paragraphs:
            cut = [p[i : i + width] for i in range(0, len(p), width)]
            wrapped += [(x, k + 1 == len(cut)) for k, x in enumerate(cut)]
        for (a, end), (b, _) in zip(wrapped, wrapped[1:]):
            ex.append((_join_features(a, b, width), "keep" if end else "join"))
    for t, _ in pages:
        body = [x for x in t.replace("\r", "").split("\n") if x.strip()]
        flat = " ".join(body)
        for w in WORD.findall(flat):
            if w.isalpha() and m.word(w) >= 2.5 * m.least_word and rng.random() < 0.1:
                options = [w.replace(g[1], g[0], 1) for g in GROUPS if g[1] in w]
                if options:
                    bad = options[int(rng.integers(len(options)))]
                    back = [(m.word(c), c, g) for c, g in word_variants(bad)]
                    top = max(back)
                    if top[1] == w and m.word(bad) < 0.2 * m.word(w):
                        ex.append((_word_features(m, bad, w, top[2]), "replace"))
            elif rng.random() < 0.1:
                back = [(m.word(c), c, g) for c, g in word_variants(w)]
                top = max(back, default=None)
                if top and m.word(w) > 0.2 * top[0]:
                    ex.append((_word_features(m, w, top[1], top[2]), "keep"))
            if w.isalpha() and len(w) >= 6 and rng.random() < (0.1 if m.word(w) >= m.least_word else 0.5):
                k = int(rng.integers(2, len(w) - 1))
                ex.append((_break_features(m, w[:k], "-‐¬\u00ad"[int(rng.integers(4))], w[k:], 1), "delete"))
        for x in re.finditer(r"\b([A-Za-z]{2,})-([a-z]{2,})\b", flat):
            ex.append((_break_features(m, x[1], "-", x[2]), "keep"))
        # Latin paragraphs wrapped again at words
        words = flat.split(" ")
        if len(words) > 12 and sum(c.isascii() for c in flat) > 0.8 * len(flat):
            line, made = "", []
            for w in words:
                if len(line) + len(w) > 60:
                    made.append(line)
                    line = w
                else:
                    line = f"{line} {w}".strip()
            made.append(line)
            ex += [(_join_features(a, b, 60), "insert") for a, b in zip(made, made[1:])]
    m.edits.fit(ex, ["keep", "replace", "delete", "join", "insert"], seed=seed)
    rows: list[tuple[list[str], str]] = []
    for t, source in pages:
        lines = t.replace("\r", "").split("\n")
        for k, line in enumerate(lines):
            f = _line_features(m, lines, k, source)
            if not f:
                continue
            s, table = line.strip(), any(x.startswith("tableTrue") for x in f)
            attached = HEAD_NUMBER.match(s)
            if NUMBER_LINE.match(s):
                sure = not s.isdigit() or k in (0, len(lines) - 1)
                y = "page" if sure and not table else "text" if table and s.isdigit() else None
            elif attached or HEAD_START.match(s) and len(s) <= 40 or UPPER.match(s):
                y = "page"
            else:
                y = "page" if any(x.startswith("bookTrue") for x in f) and m.form(s) >= 3 else "text"
            if y:
                rows.append((f, y))
    for t in clean:
        lines = t.split("\n")
        rows += [(f, "text") for k in range(len(lines)) if not HEAD_START.match(lines[k].strip()) and (f := _line_features(m, lines, k, "")) and not NUMBER_LINE.match(lines[k].strip())]
    m.lines.fit(rows, ["text", "page"], seed=seed)
    return m


def scanned(source: Column) -> Column:
    """Whether a source is a scanned book: a pdf file."""
    return F.lower(source).endswith(".pdf")


def page_model(chunks: DataFrame, text_col: str = "text_content", source_col: str = "source", sample_clean: int = 1500, sample_pages: int = 2500, seed: int = 0) -> PageModel:
    """Count over all rows, and fit on at most about ``sample_clean`` clean texts and ``sample_pages`` pages."""
    c = chunks.select(F.col(text_col).alias("t"), F.col(source_col).alias("s")).where("t IS NOT NULL")
    counts = corpus_counts(c.select("t"))
    part = F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1_000_000))
    total = {r["p"]: r["count"] for r in c.groupBy(F.coalesce(scanned(F.col("s")), F.lit(False)).alias("p")).count().collect()}

    def some(which: Column, n: int, of: int):
        rows = c.where(which).where(part < F.lit(int(1_000_000 * min(1.0, n / max(of, 1))))).limit(2 * n).collect()
        return sorted((r["t"], r["s"] or "") for r in rows)

    is_page = F.coalesce(scanned(F.col("s")), F.lit(False))
    clean = [t for t, _ in some(~is_page, sample_clean, total.get(False, 0))]
    return fit_page_model(counts, clean, some(is_page, sample_pages, total.get(True, 0)), seed)


def repaired(chunks: DataFrame, model: PageModel, id_col: str = "id", text_col: str = "text_content", source_col: str = "source") -> DataFrame:
    """(id_col, text, noise_kinds): each scanned chunk's repaired text and the kinds of noise found; other chunks are left out.

    NULL texts and sources are left out, '' stays ''. Empty input gives no rows; other columns are ignored.
    """
    kind = chunks.schema[id_col].dataType.simpleString()
    shared = chunks.sparkSession.sparkContext.broadcast((model.counts, model.lines, model.edits))

    def run(batches):
        m = PageModel(*shared.value)
        for b in batches:
            done = [edited(m, t, s) for t, s in zip(strings(b.column(1)), strings(b.column(2)))]
            yield pa.record_batch([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([sorted(k) for _, k in done], pa.list_(pa.string()))], names=["id", "text", "noise_kinds"])

    pages = chunks.select(F.col(id_col), F.col(text_col), F.col(source_col)).where(scanned(F.col(source_col)) & F.col(text_col).isNotNull())
    return pages.mapInArrow(run, f"id {kind}, text string, noise_kinds array<string>").withColumnRenamed("id", id_col)
