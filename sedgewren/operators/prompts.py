"""Prompts and closing texts as columns; wordings are this package's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUTES = {
    "direct": "把问题改写成一句便于检索的话，只输出这句话。",
    "hyde": "写一段可能出现在法规或判例中的文字来回答问题，只输出这段文字。",
    "subquery": "把问题拆成互不重复的小问题，每行一个，不要编号。",
    "recall": "写出这个问题背后的一般性法律问题，只输出一句。",
}


def _filled(rule: str, **parts: Column) -> Column:
    """A rule followed by labelled parts; a NULL part is written as 无."""
    lines = [F.lit(rule)]
    for label, c in parts.items():
        lines.append(F.concat(F.lit(f"{label}："), F.coalesce(c, F.lit("无"))))
    return F.concat_ws("\n", *lines)


def answer_prompt(question: Column, contexts: Column, history: Column) -> Column:
    """Answer from the given material only."""
    return _filled("只依据资料回答问题，资料不足时说明不足。", 对话=history, 问题=question, 资料=contexts)


def general_prompt(question: Column, history: Column) -> Column:
    """Small talk without material."""
    return _filled("简短、友好地回应，不提供法律意见。", 对话=history, 问题=question)


def route_prompt(question: Column) -> Column:
    """Choose one of the four retrieval routes."""
    return _filled("从 direct、hyde、subquery、recall 中选一种检索方式，只输出该词。", 问题=question)


def rewrite_prompt(question: Column, route: Column) -> Column:
    """The rewriting prompt of a route; an unknown route is direct."""
    rule = F.lit(ROUTES["direct"])
    for name, text in ROUTES.items():
        rule = F.when(route == name, text).otherwise(rule)
    return F.concat_ws("\n", rule, F.concat(F.lit("问题："), F.coalesce(question, F.lit("无"))))


def resolve_prompt(question: Column, history: Column) -> Column:
    """Make a follow-up question understandable by itself."""
    return _filled("把问题改写成不依赖对话也能看懂的一句话。", 对话=history, 问题=question)


def judge_prompt(statement: Column, text: Column) -> Column:
    """Whether a statement follows from a text."""
    return _filled("判断陈述能否由资料得出，只输出 yes 或 no。", 陈述=statement, 资料=text)


def paraphrase_prompt(question: Column) -> Column:
    """Another wording of a question for evaluation."""
    return _filled("换一种说法提出同一个问题，不要照抄原句。", 问题=question)


def sample_prompt(label: Column, n: int) -> Column:
    """New training texts of a class; 1 is legal, 0 is everyday."""
    kind = F.when(label == 1, "需要法律解答的提问").otherwise("与法律无关的日常用语")
    return F.concat(F.lit(f"写出 {n} 条"), kind, F.lit("，以 JSON 数组输出。"))


def insufficient_answer(phone: str) -> Column:
    """Given in place of an answer where nothing was found."""
    return F.lit(f"现有资料不足，暂不能回答。可拨打人工服务电话 {phone}。")


def failed_answer(phone: str) -> Column:
    """Given in place of an answer after an error."""
    return F.lit(f"服务出现故障，请稍后再试，或拨打人工服务电话 {phone}。")


def with_disclaimer(answer: Column, phone: str) -> Column:
    """An answer with its closing notice; NULL stays NULL."""
    return F.concat(answer, F.lit(f"\n\n以上内容仅供参考，如需帮助请拨打人工服务电话 {phone}。"))
