"""Text helpers: blanks, validators, sanitising, versions and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record shapes.
CVE_SHAPE = r"^CVE-[0-9]{4}-[0-9]{4,}$"
DATE_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
SHA256_SHAPE = r"^[0-9a-f]{64}$"
URL_SHAPE = r"^https?://"
C_FAMILY_SHAPE = r"(?i)\.(c|cc|cpp|cxx|h|hh|hpp|hxx|ipp|tcc)$"

_SPACE = " \t\n\r\u000b\f\u0085 "


def strip_space(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACE))


def blank_to_null(x: Column) -> Column:
    """Empty text and NULL are the same thing throughout."""
    return F.nullif(x, F.lit(""))


def is_blank(x: Column) -> Column:
    return F.coalesce(strip_space(x), F.lit("")) == ""


def is_cve(x: Column) -> Column:
    return F.coalesce(x.rlike(CVE_SHAPE), F.lit(False))


def is_date_shape(x: Column) -> Column:
    return F.coalesce(x.rlike(DATE_SHAPE), F.lit(False))


def is_real_date(x: Column) -> Column:
    """ISO shape and a date that exists."""
    return is_date_shape(x) & F.try_to_date(x, "yyyy-MM-dd").isNotNull()


def is_sha256(x: Column) -> Column:
    return F.coalesce(F.lower(strip_space(x)).rlike(SHA256_SHAPE), F.lit(False))


def is_http_url(x: Column) -> Column:
    return F.coalesce(x.rlike(URL_SHAPE), F.lit(False))


def is_rfc3339(x: Column) -> Column:
    shaped = x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.coalesce(shaped & F.try_to_timestamp(x).isNotNull(), F.lit(False))


def is_c_family(path: Column) -> Column:
    return F.coalesce(path.rlike(C_FAMILY_SHAPE), F.lit(False))


def printable(x: Column) -> Column:
    """Drop terminal escapes, bidi overrides and control characters; mask non-ASCII."""
    out = F.regexp_replace(x, "\u001b\\[[0-9;]*[a-zA-Z]|\u001b\\].*?(\u0007|\u001b\\\\)", "")
    out = F.regexp_replace(out, "[‪-‮⁦-⁩]", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b-\x1f]", "")
    return F.regexp_replace(out, r"[^\x20-\x7e\n\t]", "?")


def safe_label(x: Column, limit: int) -> Column:
    """`printable` cut to `limit` characters with a trailing ellipsis."""
    clean = printable(strip_space(x))
    if limit <= 0:
        return clean
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.left(clean, F.lit(limit)), F.lit("...")))


def commit_url(repo: Column, sha: Column) -> Column:
    """Browsable commit link from a clone URL."""
    u = F.regexp_replace(strip_space(repo), r"\.git$", "")
    u = F.regexp_replace(u, r"/$", "")
    ssh = F.concat(F.lit("https://"), F.regexp_replace(F.regexp_replace(u, r"^git@", ""), r"^([^:]*):", "$1/"))
    u = F.when(u.startswith("git@"), ssh).otherwise(u)
    return F.concat(u, F.lit("/commit/"), sha)


def manifest_version_parts(v: Column) -> Column:
    """`semver+hash` as a struct; no plus means the hash is `slice`."""
    v = strip_space(v)
    return F.struct(
        F.substring_index(v, "+", 1).alias("semver"),
        F.when(v.contains("+"), F.regexp_replace(v, r"^[^+]*\+", "")).otherwise(F.lit("slice")).alias("hash"),
    )


def statement_id(cve: Column) -> Column:
    return F.replace(F.lower(strip_space(cve)), F.lit(":"), F.lit("-"))
