"""Versions of deb, rpm and apk packages as texts whose plain order is the ecosystem's order.

A key is a chain of marked pieces.  Marks are control characters, so the order of pieces of different kinds is that of their marks, and
numbers are written with their length before their digits, so longer ones are greater.  Keys of different
ecosystems are not comparable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERED_TYPES = ("deb", "rpm", "apk")

# What a tilde, the end of a part and a caret rank like, and what letters and digits rank like in rpm names.
_TILDE, _END, _CARET, _ALPHA, _DIGITS = "\x01", "\x02", "\x03", "\x04", "\x05"
# Apk suffixes before and after the plain release, in their order.
_APK_BEFORE, _APK_AFTER = ("alpha", "beta", "pre", "rc"), ("cvs", "svn", "git", "hg", "p")


def number_key(digits: Column) -> Column:
    """Digits of any length, with their length first; leading zeros do not count and none is zero."""
    plain = F.regexp_replace(F.coalesce(digits, F.lit("")), "^0+", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 4, "0"), plain)


def _epoch(version: Column) -> tuple[Column, Column]:
    epoch = F.regexp_extract(version, "^([0-9]+):", 1)
    return number_key(epoch), F.regexp_replace(version, "^[0-9]+:", "")


def _deb_part(part: Column) -> Column:
    """Runs of other signs and runs of digits by turns; letters come before other signs, and a tilde before the end."""
    pairs = F.regexp_extract_all(part, F.lit("[^0-9]+[0-9]*|[0-9]+"), F.lit(0))

    def one(pair: Column) -> Column:
        signs = F.translate(F.regexp_extract(pair, "^([^0-9]*)", 1), "~+-.:", f"{_TILDE}{{|}}\x7f")
        return F.concat(signs, F.lit(_END), number_key(F.regexp_extract(pair, "([0-9]*)$", 1)))

    return F.concat(F.array_join(F.transform(pairs, one), ""), F.lit(_END))


def deb_key(version: Column) -> Column:
    epoch, rest = _epoch(version)
    upstream = F.when(rest.contains("-"), F.regexp_extract(rest, "^(.*)-[^-]*$", 1)).otherwise(rest)
    revision = F.when(rest.contains("-"), F.regexp_extract(rest, "-([^-]*)$", 1)).otherwise("0")
    return F.concat(epoch, _deb_part(upstream), _deb_part(revision))


def _rpm_part(part: Column) -> Column:
    """Runs of digits and of letters; other signs only part them.  The longer chain is greater, unless a tilde follows."""
    pieces = F.regexp_extract_all(part, F.lit("[0-9]+|[A-Za-z]+|~|\\^"), F.lit(0))

    def one(p: Column) -> Column:
        return (
            F.when(p == "~", _TILDE).when(p == "^", _CARET)
            .when(p.rlike("^[0-9]"), F.concat(F.lit(_DIGITS), number_key(p)))
            .otherwise(F.concat(F.lit(_ALPHA), p, F.lit(_TILDE))))

    return F.concat(F.array_join(F.transform(pieces, one), ""), F.lit(_END))


def rpm_key(version: Column) -> Column:
    epoch, rest = _epoch(version)
    name = F.regexp_extract(rest, "^([^-]*)", 1)
    release = F.regexp_extract(rest, "^[^-]*-(.*)$", 1)
    return F.concat(epoch, _rpm_part(name), _rpm_part(release))


def apk_key(version: Column) -> Column:
    """Numbers, a letter, suffixes and a revision; a number with leading zeros counts as that number."""
    pieces = F.regexp_extract_all(version, F.lit("^[0-9.]+|[a-z](?![a-z])|_[a-z]+[0-9]*|-r[0-9]+"), F.lit(0))

    def suffix(p: Column) -> Column:
        name, number = F.regexp_extract(p, "^_([a-z]+)", 1), number_key(F.regexp_extract(p, "([0-9]*)$", 1))
        before = F.array_position(F.array(*map(F.lit, _APK_BEFORE)), name)
        after = F.array_position(F.array(*map(F.lit, _APK_AFTER)), name)
        return F.when(before > 0, F.concat(F.lit(_TILDE), before.cast("string"), number)).otherwise(F.concat(F.lit(_ALPHA), after.cast("string"), number))

    def one(p: Column) -> Column:
        numbers = F.array_join(F.transform(F.filter(F.split(p, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("\x07"), number_key(x))), "")
        return (
            F.when(p.rlike("^[0-9]"), numbers).when(p.startswith("_"), suffix(p))
            .when(p.startswith("-r"), F.concat(F.lit(_CARET), number_key(F.substring(p, 3, 12)))).otherwise(F.concat(F.lit("\x06"), p)))

    return F.concat(F.array_join(F.transform(pieces, one), ""), F.lit(_END))


def version_key(ecosystem: Column, version: Column) -> Column:
    """The sort key of a version; null for other ecosystems and for no version."""
    present = F.when(version != "", version)
    return F.when(ecosystem == "deb", deb_key(present)).when(ecosystem == "rpm", rpm_key(present)).when(ecosystem == "apk", apk_key(present))


def in_range(key: Column, introduced: Column, fixed: Column) -> Column:
    """introduced <= key < fixed; an open end is null."""
    return F.coalesce(key >= introduced, F.lit(True)) & F.coalesce(key < fixed, F.lit(True))
