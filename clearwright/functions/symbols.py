"""Symbol names, binary magic and printable strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearwright.functions.text import blank_to_null, strip_space

MIN_STRING_LENGTH = 6


def split_version(raw: Column, hint: Column | None = None) -> Column:
    """`name@@V` or `name@V` as (name, version); otherwise the version hint."""
    version = blank_to_null(F.regexp_extract(raw, r"^[^@]*@@?(.*)$", 1))
    if hint is not None:
        version = F.coalesce(version, blank_to_null(hint))
    return F.struct(F.substring_index(raw, "@", 1).alias("name"), version.alias("version"))


def normalize(name: Column) -> Column:
    """Comparison key: linker wrap prefixes and a single leading underscore removed."""
    return F.regexp_replace(strip_space(name), r"^(__wrap_|__real_|_(?!_))+", "")


def printable_runs(content: Column, minimum: int = MIN_STRING_LENGTH) -> Column:
    """Printable ASCII runs of at least `minimum` bytes that end at a NUL byte."""
    text = F.decode(content, "ISO-8859-1")
    return F.regexp_extract_all(text, F.lit(rf"([\x20-\x7e]{{{minimum},}})(?=\x00)"), F.lit(1))


def magic_format(content: Column) -> Column:
    """Binary family by the first bytes: ELF, PE, MachO or unknown."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head == "7F454C46", "ELF")
        .when(F.left(head, F.lit(4)) == "4D5A", "PE")
        .when(
            head.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "BEBAFECA"),
            "MachO",
        )
        .otherwise("unknown")
    )


def usable_symbol_table(fmt: Column, stripped: Column, static: Column,
                        has_dynamic: Column, has_table: Column) -> Column:
    known = F.lower(F.coalesce(fmt, F.lit("unknown"))) != "unknown"
    return known & ~(stripped & static) & (has_dynamic | (~stripped & has_table))


def dynamic_only(stripped: Column, has_dynamic: Column) -> Column:
    return stripped & has_dynamic


def inventory_id(path: Column, sha256: Column) -> Column:
    return F.coalesce(blank_to_null(path), sha256, F.lit(""))


def little_endian_uint(content: Column, offset: int) -> Column:
    """Unsigned 32-bit little-endian value at a fixed byte offset."""
    h = F.hex(F.substring(content, offset + 1, 4))
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("bigint")


def gnu_build_id(note: Column) -> Column:
    """Build id hex from a `.note.gnu.build-id` section body, NULL when malformed."""
    name_size, desc_size = little_endian_uint(note, 0), little_endian_uint(note, 4)
    end_of_name = 12 + F.floor((name_size + 3) / 4) * 4
    ok = (
        (F.length(note) >= 12)
        & (little_endian_uint(note, 8) == 3)
        & (desc_size > 0)
        & (end_of_name + desc_size <= F.length(note))
    )
    body = F.substring(note, (end_of_name + 1).cast("int"), desc_size.cast("int"))
    return F.when(ok, F.lower(F.hex(body)))
