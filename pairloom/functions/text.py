"""Column expressions over text: tagging, cleaning, extraction; and the few that need Python."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.registry import AGE_GROUP_TERMS, AGE_PATTERN, ANSWER_BLOCK, CHILD_HOUSING


def tags(text: Column, patterns: dict[str, str], lowered: bool = False) -> Column:
    """STR1: labels whose pattern occurs in the lower-cased text, in the order of the patterns.
    Patterns stay case-sensitive, so upper-case alternatives in them never match; that is the
    documented behaviour. :func:`tags_any_case` is the variant without this trap. For many patterns
    over long texts pass a column that holds the lower-cased text already (``lowered``)."""
    low = text if lowered else F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in patterns.items()]), lambda x: x.isNotNull())


HEAD = re.compile(r"[A-Za-z0-9]{2}(?![?*+{])[^|]+", re.DOTALL)  # two plain characters, then more, all one alternative


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern that begins at a word boundary, without it; none of others."""
    if not pattern.startswith(r"\b"):
        return []
    inner = re.fullmatch(r"\\b\((?:\?:)?([^()]*)\)(\\b)?", pattern)
    if inner and re.search(r"\[[^\]]*\||\\\||\\Q", inner[1]):  # a bar that parts no alternatives
        inner = None
    return [p + (inner[2] or "") for p in inner[1].split("|")] if inner else [pattern[2:]]


def any_of(patterns: list[str]) -> str:
    """One pattern that occurs where any of them does. Those that begin at a word boundary share the
    check for it, and of a word only the alternatives with its first two letters are tried: a look ahead tells
    whether there are any, so most words of a text are passed over at once."""
    bounded = sorted({b for p in patterns for b in _branches(p)})
    others = [p for p in patterns if not _branches(p)]
    heads: dict[str, list[str]] = {}
    rest = []
    for b in bounded:
        heads.setdefault(b[:2], []).append(b[2:]) if HEAD.fullmatch(b) else rest.append(b)
    firsts: dict[str, list[str]] = {}
    for head, tails in heads.items():
        firsts.setdefault(head[0], []).append(head[1] + "(?:" + "|".join(tails) + ")")
    seconds = [f"{c}(?:" + "|".join(tails) + ")" for c, tails in firsts.items()]
    ahead = "" if rest else "(?=[" + "".join(firsts) + "][" + "".join(sorted({h[1] for h in heads})) + "])"
    return "|".join(([r"\b" + ahead + "(?:" + "|".join(seconds + rest) + ")"] if bounded else []) + others)


def tags_any_case(text: Column, patterns: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(name)) for name, p in patterns.items()]), lambda x: x.isNotNull())


def hit_count(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur in the lower-cased text. They are counted one by one only where any does."""
    low, out = F.lower(text), F.lit(0)
    for p in patterns:
        out = out + F.coalesce(low.rlike(p).cast("int"), F.lit(0))
    return F.when(low.rlike(any_of(patterns)), out).otherwise(0) if patterns else out


def nonclinical(text: Column, statistics: list[str], clinical: list[str]) -> Column:
    """FLT9: two hits of methodology words and none of clinical ones."""
    return (hit_count(text, statistics) >= 2) & (hit_count(text, clinical) == 0)


def ages(text: Column) -> Column:
    """STR2: ages in years; units that hold "mo" count as months."""
    low = F.lower(text)
    numbers = F.regexp_extract_all(low, F.lit(AGE_PATTERN), F.lit(1))
    units = F.regexp_extract_all(low, F.lit(AGE_PATTERN), F.lit(2))
    return F.zip_with(numbers, units, lambda n, u: F.when(u.contains("mo"), n.cast("double") / 12.0).otherwise(n.cast("double")))


def age_group(text: Column) -> Column:
    """STR2: band of the first age, else the first age-group term."""
    first = F.get(ages(text), F.lit(0))
    band = (
        F.when(first < 1, "infant")
        .when(first < 13, "child")
        .when(first < 18, "adolescent")
        .when(first < 30, "young_adult")
        .when(first < 50, "middle_aged")
        .when(first < 65, "older_adult")
        .when(first.isNotNull(), "elderly")
    )
    return F.coalesce(band, F.get(tags(text, AGE_GROUP_TERMS), F.lit(0)))


def slug(value: Column) -> Column:
    """STR4: none for NULL, unknown when nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(value)), "[/ ]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_]+", ""), "_+", "_")
    s = F.trim(s, F.lit("_"))
    return F.when(value.isNull(), "none").when(s == "", "unknown").otherwise(s)


def folded_label(value: Column) -> Column:
    """STR5: quotes, hyphens and underscores as blanks, collapsed, lower-cased."""
    s = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "['\"\\-_]", " ")
    return F.trim(F.regexp_replace(s, "\\s+", " "))


def strip_choices(value: Column) -> Column:
    """STR6: without a trailing block of answer choices and white space."""
    return F.regexp_replace(F.regexp_replace(value, ANSWER_BLOCK, ""), "\\s+$", "")


def first_rewrite(value: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """STR7: the first rule that changes the text is applied, the others aren't."""
    out = value
    for pattern, new in reversed(rules if rules is not None else CHILD_HOUSING):
        changed = F.regexp_replace(value, pattern, new)
        out = F.when(changed != value, changed).otherwise(out)
    return out


def joined(values: Column, sep: str = "|") -> Column:
    """STR8"""
    return F.array_join(values, sep)


def suffix_number(value: Column) -> Column:
    """STR9: the integer behind the last underscore, else NULL."""
    return F.expr(f"try_cast(substring_index({_name(value)}, '_', -1) as bigint)")


def _name(column: Column) -> str:
    return column._jc.toString()


def preview(value: Column, n: int = 200) -> Column:
    """STR10"""
    return F.substring(value, 1, n)


def without_fences(value: Column) -> Column:
    """STR14: without Markdown code fences around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(value), "^```(?:json)?\\s*", ""), "\\s*```$", ""))


def hash_group(*parts: Column, modulus: int = 2**31) -> Column:
    """STR15: MD5 of the joined parts, modulo a power of two up to 2^31."""
    digest = F.md5(F.concat_ws("_", *parts))
    return F.pmod(F.conv(F.right(digest, F.lit(8)), 16, 10).cast("bigint"), F.lit(modulus))


def contains_any_case(value: Column, part: Column) -> Column:
    """STR16"""
    return F.lower(value).contains(F.lower(part))


def anatomy_sensitive(features: Column, text: Column, keywords: list[str]) -> Column:
    """STR17: a keyword in one of the features, or else in the text."""
    keyword = any_of(keywords)
    inside = F.exists(features, lambda f: F.lower(f).rlike(keyword))
    return F.coalesce(inside, F.lit(False)) | F.coalesce(F.lower(text).rlike(keyword), F.lit(False))


def blank_to_null(value: Column) -> Column:
    """FLT14 / T3: an empty or blank string is no value."""
    return F.when(F.trim(value) != "", value)


def first_truthy(*values: Column) -> Column:
    """PRJ10: the first value that is neither NULL nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


# ------------------------------------------------------------ Python


@F.pandas_udf(T.DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR11: 1 minus the similarity of matching blocks; NULL if either is NULL."""
    return pd.Series([None if x is None or y is None else 1.0 - difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


REGION = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("a_start", "a_end", "b_start", "b_end")]]))


@F.pandas_udf(REGION)
def edit_regions(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR12: the opcodes other than equal, as character ranges of both texts."""

    def one(x, y):
        if x is None or y is None:
            return None
        codes = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        return [dict(zip(("tag", "a_start", "a_end", "b_start", "b_end"), c, strict=True)) for c in codes if c[0] != "equal"]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR13: a unified diff by lines."""
    return pd.Series([None if x is None or y is None else "\n".join(difflib.unified_diff(x.splitlines(), y.splitlines(), "original", "edited", lineterm="")) for x, y in zip(a, b, strict=True)])
