"""What a line of a law or case book is, read by a cursor over its characters.

Fixed values: the forms that must be told apart are headings and articles (第…编, 章, 节 or 条), a contents line, dotted
contents entries, the five bracketed sections, page numbers, subtitles (a dash), causes (a bracketed Chinese number), chapters (a
Chinese number, a pause mark, a kind of dispute) and numbered titles.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

from sedgewren.functions.text import CN_NUMERALS

SECTIONS = ["案件基本信息", "基本案情", "案件焦点", "法院裁判要旨", "法官后语"]
DISPUTES = ("纠纷", "争议", "其他")
COUNTING = "一二三四五六七八九十"
DASHES = "—-－"
CIRCLED = "".join(map(chr, range(0x2460, 0x2474)))
DECORATION = " \t=-_*#."


class Kind(NamedTuple):
    """A line's kind; ``unit`` is a heading's level or a section's name, ``label`` its number, ``rest`` what follows."""

    name: str
    unit: str = ""
    label: str = ""
    rest: str = ""


PLAIN = Kind("plain")


def run(line: str, allowed: str, at: int = 0) -> int:
    """End of the run of allowed characters from ``at`` on."""
    while at < len(line) and line[at] in allowed:
        at += 1
    return at


def is_number(line: str) -> bool:
    return 1 <= len(line) <= 4 and line.isdecimal()


def is_contents(line: str) -> bool:
    return "".join(line.split()) in ("目录", "目次")


def is_dotted(text: str) -> bool:
    """Whether a contents entry's leader, and perhaps a page number, ends the text."""
    body = text.rstrip().rstrip("0123456789").rstrip()
    return len(body) - len(body.rstrip(".…")) >= 2


def kind_of(line: str, heading_chars: int = 40) -> Kind:
    """The kind of a stripped line."""
    if not line:
        return PLAIN
    first = line[0]
    if first == "第":
        at = run(line, CN_NUMERALS, 1)
        unit = line[at : at + 1]
        if at > 1 and unit == "条":
            return Kind("article", unit, line[: at + 1], line[at + 1 :].strip())
        if at > 1 and unit and unit in "编章节" and len(line) <= heading_chars:
            return Kind("heading", unit, line[: at + 1], line[at + 1 :].strip())
    elif first == "【":
        name, closed, rest = line[1:].partition("】")
        if closed and name in SECTIONS and rest.strip().strip(CIRCLED) == "" and len(rest.strip()) <= 1:
            return Kind("section", name)
    elif is_number(line):
        return Kind("number", label=line)
    elif first in DASHES:
        at = run(line, DASHES)
        if at <= 2 and line[at:].strip():
            return Kind("subtitle", rest=line)
    elif first in "（(":
        at = run(line.replace(" ", ""), COUNTING, 1)
        flat = line.replace(" ", "")
        if at > 1 and flat[at : at + 1] in ("）", ")") and flat[at + 1 :]:
            return Kind("cause", rest=line)
    elif first in COUNTING:
        at = run(line, COUNTING)
        rest = line[at:].lstrip()
        name = rest[1:].strip()
        if rest[:1] == "、" and name.endswith(DISPUTES) and 4 <= len(name) <= 14 and all(c == "、" or c.isspace() or "一" <= c <= "龥" for c in name):
            return Kind("chapter", rest=line)
    elif first.isdecimal():
        at = run(line, "0123456789")
        rest = line[at:].lstrip()
        if 1 <= at <= 4 and rest[:1] in (".", "、") and rest[1:].strip():
            return Kind("numbered", label=line[:at], rest=rest[1:].strip())
    return PLAIN


def is_marker(line: str) -> bool:
    """Whether a line carries structure, so that it is never taken for a running head."""
    return kind_of(line).name in ("section", "chapter", "cause", "heading", "article")


def is_noise(line: str) -> bool:
    """A page marker, a page number, a lone footnote sign or a fixed header of a case book."""
    if is_number(line) or len(line) == 1 and line in CIRCLED:
        return True
    core = "".join(line.strip(DECORATION).split()).lower()
    if core.startswith("page") and core[4:].strip("()").isdecimal() or core.startswith("第") and core.endswith("页") and core[1:-1].isdecimal():
        return True
    year, _, month = core.partition("年")
    return core == "目录" or core.startswith(("中国法院", "图书在版编目")) and (not core.startswith("中国法院") or core[4:8].isdecimal() and core[8:12] == "年度案例") or year.isdecimal() and len(year) == 4 and month.endswith("月") and month[:-1].isdecimal() and len(month) <= 3


def running_heads(lines: list[str], min_repeat: int = 6, max_len: int = 30) -> set[str]:
    """Compact short lines that recur and stand beside a page number at least once, structure markers excepted."""
    count: Counter = Counter()
    beside = set()
    for i, line in enumerate(lines):
        key = "".join(line.split())
        if not 0 < len(key) <= max_len or key[0].isdecimal() or any(c in "。，；：！？" for c in key) or is_marker(line.strip()):
            continue
        count[key] += 1
        if any(is_number(lines[j].strip()) for j in (i - 1, i + 1) if 0 <= j < len(lines)):
            beside.add(key)
    return {k for k in beside if count[k] >= min_repeat}
