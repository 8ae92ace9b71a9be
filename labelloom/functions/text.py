"""Text and number normalisation as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ENDS = r"^\s+|\s+$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f) -> Column:
    """f of value, which is worked out once for each row, however often f names it."""
    return F.transform(F.array(value), f)[0]


def rounded(c: str | Column, digits: int) -> Column:
    """c scaled up, rounded with halves away from 0, and scaled down, as SQL engines round doubles. F.round goes by the
    shortest decimal form of c instead: 69 / 800 prints as 0.08625, but scaled it is less than 862.5."""
    unit = 10.0**digits
    return F.round(col(c) * unit) / unit


def stripped(c: str | Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), ENDS, "")


def text_or_null(c: str | Column) -> Column:
    """Stripped, inner white space single blanks; empty is null."""
    return F.nullif(F.regexp_replace(stripped(col(c).cast("string")), r"\s+", " "), F.lit(""))


def label_text(c: str | Column) -> Column:
    """text_or_null in lower case."""
    return F.lower(text_or_null(c))


#: Plural labels and what they stand for.
PLURALS = {"t cells": "t cell", "b cells": "b cell", "nk cells": "nk cell", "monocytes": "monocyte"}


def canonical_label(c: str | Column, remap: dict[str, str] = PLURALS) -> Column:
    """label_text, with labels in remap replaced."""
    table = F.create_map(*(F.lit(x) for kv in remap.items() for x in kv))
    label = label_text(c)
    return F.coalesce(F.try_element_at(table, label), label)


def plain_label(c: str | Column) -> Column:
    """Lower case; _ - / and , as blanks; without the word human; single blanks; null as empty."""
    s = F.regexp_replace(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), r"[_\-/,]", " ")
    return stripped(F.regexp_replace(F.regexp_replace(s, r"\bhuman\b", " "), r"\s+", " "))


def folded(c: str | Column) -> Column:
    """Stripped and lower case; null as empty."""
    return F.lower(stripped(F.coalesce(col(c).cast("string"), F.lit(""))))


#: Abbreviations and their long forms, applied in this order.
LONG_FORMS = (
    ("nk", "natural killer"),
    ("cd4 t cell", "cd4 positive alpha beta t cell"),
    ("cd8 t cell", "cd8 positive alpha beta t cell"),
    ("treg", "regulatory t cell"),
    ("b cell precursor", "precursor b cell"),
    ("erythroid cell", "erythrocyte"),
)


def long_label(c: str | Column, forms=LONG_FORMS) -> Column:
    """plain_label with abbreviations written out."""
    s = plain_label(c)
    for short, long in forms:
        s = F.regexp_replace(s, rf"\b{re.escape(short)}\b", long)
    return stripped(F.regexp_replace(s, r"\s+", " "))


def tokens(c: str | Column) -> Column:
    """Words of plain_label; none for an empty label."""
    return F.filter(F.split(plain_label(c), r"\s+"), lambda x: x != "")


def token_count(c: str | Column, sep: str = ";") -> Column:
    """Number of non-blank parts between separators; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(col(c), sep), lambda x: F.trim(x) != "")), F.lit(0))


def has_any(c: str | Column, words) -> Column:
    """Whether any of words occurs in c, whatever the case; false for null and for no words."""
    if not words:
        return F.lit(False)
    return F.coalesce(F.lower(col(c)).rlike("|".join(re.escape(w.lower()) for w in words)), F.lit(False))


def finite(c: str | Column) -> Column:
    """Numbers as they are; NaN and infinities null."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def whole_number(c: str | Column) -> Column:
    """c as a long, or null where it is none."""
    return F.expr(f"try_cast(trim(cast(`{c}` AS string)) AS bigint)") if isinstance(c, str) else c.try_cast("bigint")


def number(c: str | Column, digits: int = 6) -> Column:
    """c as a finite double, rounded; null where it is none."""
    return F.round(finite(col(c).cast("string").try_cast("double")), digits)


def truth(c: str | Column) -> Column:
    """true/yes/1 and false/no/0 in any case as booleans; the rest null."""
    s = folded(c)
    return F.when(s.isin("true", "yes", "1"), True).when(s.isin("false", "no", "0"), False)


def short_id(*parts: str | Column) -> Column:
    """The first 16 hex digits of the md5 of parts joined by |; null parts count as empty."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts))), 1, 16)


def or_default(c: str | Column, default: str = "unknown") -> Column:
    """text_or_null, or default."""
    return F.coalesce(text_or_null(c), F.lit(default))


def first_filled(*columns: str | Column) -> Column:
    """The first of columns that isn't blank, stripped."""
    return F.coalesce(*(F.nullif(stripped(c), F.lit("")) for c in columns))


#: What stands for a missing group.
MISSING = ("", "none", "nan", "unknown")


def group_key(*columns: str | Column, last: str | Column) -> Column:
    """The first of columns that names a group, else last."""
    valid = lambda c: F.when(~folded(c).isin(*MISSING), stripped(c))
    return F.coalesce(*(valid(c) for c in columns), col(last))


def percent(c: str | Column) -> Column:
    """A rate as text, one digit; null: n/a."""
    return F.coalesce(F.format_string("%.1f%%", col(c) * 100), F.lit("n/a"))


def one_line(c: str | Column, most: int = 80) -> Column:
    """Single line, cut to most characters with an ellipsis."""
    s = text_or_null(c)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).otherwise(s)


def partial_match(pred: str | Column, gold: str | Column) -> Column:
    """Whether one folded text is part of the other; false if either is empty."""
    p, g = folded(pred), folded(gold)
    return (p != "") & (g != "") & (p.contains(g) | g.contains(p))
