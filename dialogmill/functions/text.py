"""Text normalisation and keyword tests, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that give away a copied exercise.
COPY_KEYWORDS = (
    "如下", "如上", "这道题", "怎么做", "做法", "A.", "B.", "C.", "D.", "我对这一页不懂", "做一下", "怎么写",
    "选什么", "解一下", "咋做", "答案", "结果", "求解", "完成", "解答", "回答", "解题", "解决", "第", "题", "单选题",
    "多选题", "描述错误的是", "描述正确的是", "回答下列问题", "a.", "b.", "c.", "d.", "有什么作用",
)
# Patterns counted once per match (points of an exercise).
COPY_PATTERNS = (r"\d+分",)
# Phrases of a question for reasons.
WHY_KEYWORDS = (
    "为什么", "为啥", "为何", "因为什么", "怎么会", "怎么还", "是因为", "原因是什么", "原因是啥", "导致了什么",
    "造成了什么", "怎么造成", "怎么出现", "为什么会", "怎么变成", "为什么这样",
)
# Fixed value: how an uploaded picture stands in a question.
IMAGE_MARKER = "![用户上传图片]("

_FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + " "


def normalize_text(text: Column) -> Column:
    """Null to "", full width to half width, all white space removed."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _FULL_WIDTH, _HALF_WIDTH), r"(?U)[\s\x1c-\x1f]+", "")


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases])


def copy_keyword_count(normal: Column, keywords: Sequence[str] = COPY_KEYWORDS, patterns: Sequence[str] = COPY_PATTERNS) -> Column:
    """Distinct keywords in a normalised text plus all matches of the patterns."""
    found = [F.contains(normal, F.lit(k)).cast("int") for k in keywords] + [F.regexp_count(normal, F.lit(p)) for p in patterns]
    return reduce(add, found)


def contains_copy_keyword(normal: Column, keywords: Sequence[str] = COPY_KEYWORDS, patterns: Sequence[str] = COPY_PATTERNS) -> Column:
    return copy_keyword_count(normal, keywords, patterns) > 0


def has_image(text: Column) -> Column:
    return F.contains(F.coalesce(text, F.lit("")), F.lit(IMAGE_MARKER))


def preview(text: Column, size: int = 80) -> Column:
    return F.substring(text, 1, size)
