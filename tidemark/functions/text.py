"""Text functions. Lengths and slices count code points."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as scripts of web pages see it: no U+0085, but U+00A0, U+3000 and U+FEFF.
SPACE_CLASS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"

#: Expressions of advice, guesswork and judgement that may not go out.
BANNED = (
    "すべき", "おすすめ", "お勧め", "お薦め", "しましょう", "推奨(し|さ)", "望ましい", "必要があります", "必要です", "注意が必要",
    "備えて(おく|くださ)", "と考えられ", "と思われ", "でしょう", "だろう", "とみられ", "と見られ", "見込みです", "見込まれ",
    "可能性が(あ|高)", "おそれがあ", "恐れがあ", "有利です", "不利です", "間違いありません", "実質的には",
)


def one_line(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, SPACE_CLASS, "") == "", F.lit(True))


def or_null(text: Column) -> Column:
    return F.when(~is_blank(text), text)


def content_hash(text: Column, title: Column) -> Column:
    """SHA-256 of the text, or of the title where the text is empty."""
    return F.sha2(F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.coalesce(title, F.lit(""))).cast("binary"), 256)


def first_banned(fields: Sequence[tuple[str, Column]], patterns: Sequence[str] = BANNED) -> Column:
    """struct(field, matched) of the first field, and in it the first pattern, that matches; null if none does."""
    one = lambda c: F.coalesce(*(F.when(F.regexp_extract(c, f"({p})", 1) != "", F.regexp_extract(c, f"({p})", 1)) for p in patterns))
    anything = "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(*(F.when(c.rlike(anything), F.struct(F.lit(name).alias("field"), one(c).alias("matched"))) for name, c in fields))


def truncate(text: Column, n: int) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(n))


def prefecture(region: Column) -> Column:
    """The part of a region's name before a bracket."""
    return F.trim(F.regexp_extract(region, r"^([^(（]*)", 1))


#: Tags whose content is no part of a page's text.
NOISE = ("script", "style", "nav", "footer", "header", "aside", "noscript", "form", "iframe")


def without_noise(page: Column) -> Column:
    """A page's text by expressions alone, inside code generation: noise and tags go, white space is collapsed."""
    for tag in NOISE:
        page = F.regexp_replace(page, rf"(?s)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(page, r"(?s)<[^>]*>", " "), r"[ \t\n\r]+", " "))


def annotate_region(headline: Column, summary: Column, affected: Column, region: Column, limit: int = 40) -> Column:
    """`affected` with the region's prefecture put in front, where none of the three names it; at most `limit` long."""
    pref = prefecture(region)
    named = F.contains(headline, pref) | F.contains(summary, pref) | F.contains(affected, pref)
    joined = F.when(is_blank(affected), pref).otherwise(F.concat(pref, F.lit("・"), affected))
    return F.when(region.isNull() | (pref == "") | named, affected).otherwise(F.left(joined, F.lit(limit)))


#: Keys whose values are secrets, and shapes of secrets in text.
_SECRET_KEYS = r"(?i)(token|secret|password|authorization|api[_-]?key|webhook)"
_SECRET_SHAPES = r"(Bearer\s+[A-Za-z0-9._~+/=-]+|sk-[A-Za-z0-9_-]{8,}|xox[a-z]-[A-Za-z0-9-]+|https://hooks\.[^\s\"']+)"


def redact_map(values: Column) -> Column:
    """A map of strings with secret keys' values, and secrets inside others, masked."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(_SECRET_KEYS), F.lit("***")).otherwise(F.regexp_replace(v, _SECRET_SHAPES, "***")))


def redacted(text: str) -> str:
    """A message for logs and notifications, with secrets inside masked."""
    return re.sub(_SECRET_SHAPES, "***", text)


_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def decode_entities(text: str) -> str:
    """Named and numeric character references, each once; unknown and impossible ones stay."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] == "#":
            code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
            return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]
        return html.entities.html5.get(f"{body};") or html.entities.html5.get(f"{body.lower()};") or m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else decode_entities(t))
