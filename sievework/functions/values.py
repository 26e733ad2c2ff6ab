"""Columns for identifiers and categories that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

#: Fill-in words that stand for a missing value (fixed values, compared after trimming and lower-casing).
MISSING = ("", "-", "--", "?", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "unk", "unknown", "undefined", "missing", "tbd", "未知", "无", "不详", "暂无", "缺失", "空")


def strip(c: Column) -> Column:
    """The value without surrounding white space of any kind (Unicode); null stays null."""
    return F.regexp_replace(c, r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", "")


def narrow(c: Column) -> Column:
    """Full-width ASCII forms to plain ones; other characters stay."""
    return F.translate(c, _WIDE, _NARROW)


def category(c: Column) -> Column:
    """A category's one spelling: narrow, stripped, upper case; blank or a fill-in word gives null."""
    v = strip(narrow(c))
    return F.when(~F.lower(v).isin(*MISSING), F.upper(v))


def reference(c: Column) -> Column:
    """An identifier's one spelling: stripped, lower case; null for blanks, fill-in words and all-zero ids."""
    v = F.lower(strip(c))
    return F.when(~v.isin(*MISSING) & ~v.rlike(r"^([a-z]+[_/:-])?0+$"), v)


def letter_set(c: Column) -> Column:
    """Answer letters in order without repetition, joined by commas; null for none."""
    flat = F.transform(c, lambda x: F.upper(strip(narrow(x))))
    s = F.array_join(F.array_sort(F.array_distinct(F.filter(flat, lambda x: x.rlike("^[A-Z]$")))), ",")
    return F.when(s != "", s)
