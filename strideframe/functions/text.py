"""Text helpers: clean-up, keyword tagging, reps text, untrusted model fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Spellings that mean "not recognised", and characters that are never valid.
UNKNOWN_NAMES = ("unknown_action", "unknown", "unknown_equipment", "未知动作", "未知", "不确定", "无法识别")
UNKNOWN_PREFIX = "unknown"
DIRTY_NAME = r"[?\x00-\x1f]"
DIRTY_ID = r"[?\n\r\t\x00-\x1f]"


def is_empty(df: DataFrame, name: str) -> Column:
    """NULL, blank text, or an empty array or map."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, T.StringType):
        return c.isNull() | (F.trim(c) == "")
    return c.isNull()


def normalize_header(c: Column) -> Column:
    """Lower case, no blanks, underscores or dashes, ASCII brackets."""
    return F.translate(F.translate(F.lower(F.trim(c)), " _-", ""), "（）", "()")


def drop_brackets(c: Column) -> Column:
    """Remove bracketed remarks, ASCII or full-width."""
    return F.trim(F.regexp_replace(c, r"[（(].*?[）)]", ""))


def strip_dirty(c: Column, pattern: str = DIRTY_ID) -> Column:
    return F.trim(F.regexp_replace(c, pattern, ""))


def is_unknown(c: Column) -> Column:
    """Blank, a known 'not recognised' spelling, or anything that starts with it."""
    t = F.lower(F.trim(c))
    return c.isNull() | (t == "") | t.isin(*UNKNOWN_NAMES) | t.startswith(UNKNOWN_PREFIX)


def slug(c: Column, size: int = 60) -> Column:
    """Lower-case words joined by underscores."""
    joined = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(joined, r"^_+|_+$", ""), 1, size)


def keyword_tags(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Tags of the keywords found in a text, in rule order, each once."""
    low = F.lower(c)
    hits = F.array_compact(F.array(*[F.when(low.contains(k), F.lit(tag)) for k, tag in rules]))
    return F.array_distinct(hits)


def any_keyword(c: Column, words: Sequence[str]) -> Column:
    low, found = F.lower(c), F.lit(False)
    for w in words:
        found = found | low.contains(w)
    return found


def strip_back_prefix(c: Column) -> Column:
    """Muscle id without its back-side prefix ``b-``."""
    return F.regexp_replace(c, "^b-", "")


def strip_prefixes(c: Column, prefixes: Sequence[str]) -> Column:
    return F.trim(F.regexp_replace(c, "^(" + "|".join(prefixes) + ")", ""))


def reps_list(c: Column) -> Column:
    """Whole numbers of a blank-separated reps text; other words are skipped."""
    words = F.split(F.trim(c), r"\s+")
    return F.array_compact(F.transform(words, lambda w: F.when(w.rlike(r"^[+-]?\d+$"), w.try_cast("int"))))


def reps_sets(c: Column) -> Column:
    n = reps_list(c)
    return F.when(F.size(n) > 0, F.size(n))


def reps_sum(c: Column) -> Column:
    n = reps_list(c)
    return F.when(F.size(n) > 0, F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x))


def split_ids(ids: Column, valid: Column) -> Column:
    """Clean ids; an unknown id joined by underscores is split and its valid parts kept."""
    clean = F.filter(F.transform(ids, strip_dirty), lambda s: s != "")
    parts = F.transform(
        clean,
        lambda s: F.when(F.array_contains(valid, s), F.array(s)).otherwise(
            F.filter(F.transform(F.split(s, "_"), F.trim), lambda p: F.array_contains(valid, p))
        ),
    )
    return F.array_distinct(F.flatten(parts))


def keep_members(ids: Column, valid: Column) -> Column:
    return F.filter(ids, lambda x: F.array_contains(valid, x))


def fenced_json(c: Column) -> Column:
    """The JSON part of a model answer: code fences dropped, else the outermost braces
    or brackets.  NULL when there is none; parse it with ``from_json``."""
    body = F.trim(F.regexp_replace(F.trim(c), r"(?m)^```.*$\n?", ""))
    whole = F.when(body.rlike(r"(?s)^[\[{].*[\]}]$"), body)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(body, r"(?s)\[.*\]", 0)
    return F.coalesce(whole, F.nullif(braces, F.lit("")), F.nullif(brackets, F.lit("")))
