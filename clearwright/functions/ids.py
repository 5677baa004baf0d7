"""Deterministic document ids and timestamps derived from content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Start of the year that generated timestamps fall into: 2026-01-01T00:00:00Z.
TIMESTAMP_BASE = 1767225600
SECONDS_PER_YEAR = 31536000


def joined_digest(*parts: Column) -> Column:
    """SHA-256 over the parts joined by NUL characters."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def document_id(fmt: str, seed: Column) -> Column:
    return F.concat(F.lit(f"urn:clearwright:{fmt}:"), F.left(seed, F.lit(32)))


def uuid_from(seed: Column) -> Column:
    """`urn:uuid:` text with version 5 and RFC variant bits set over a digest of the seed."""
    h = joined_digest(F.lit("clearwright-uuid"), seed)
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    return F.concat(
        F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4),
        F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        F.substr(variant, nibble % 4 + 1, F.lit(1)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def component_ref(pinned: Column) -> Column:
    return F.concat(F.lit("cw:"), F.left(joined_digest(F.lit("component-ref"), pinned), F.lit(16)))


def product_id(pinned: Column) -> Column:
    return F.concat(F.lit("CWPID-"), F.upper(F.left(joined_digest(F.lit("product-id"), pinned), F.lit(16))))


def tracking_id(seed: Column) -> Column:
    return F.concat(F.lit("CW-VEX-"), F.upper(F.left(seed, F.lit(16))))


def timestamp_from(bundle_id: Column) -> Column:
    """RFC 3339 UTC time inside one year, fixed by the bundle id."""
    h = joined_digest(F.lit("vex-time"), F.lower(F.trim(bundle_id)))
    offset = F.conv(F.left(h, F.lit(6)), 16, 10).cast("bigint") % SECONDS_PER_YEAR
    return F.date_format(F.timestamp_seconds(F.lit(TIMESTAMP_BASE) + offset), "yyyy-MM-dd'T'HH:mm:ss'Z'")
