"""Strictly typed reads from a VARIANT value.

A cast would turn the text "5" into the number 5. RPC parsing must not do that, so every
reader checks the stored type first and gives NULL for any other type.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = Decimal("18446744073709551615")
I64_MAX = Decimal("9223372036854775807")


def parse(text: str | Column) -> Column:
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def node(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str = "$") -> Column:
    """Stored type name; NULL when the path is absent, ``VOID`` for a JSON null."""
    return F.schema_of_variant(v if path == "$" else node(v, path))


def present(v: Column, path: str) -> Column:
    """Whether the path is there, be it a JSON null; nothing below it is looked at."""
    return node(v, path).isNotNull()


def is_null(v: Column, path: str) -> Column:
    """Whether a JSON null stands there; NULL when the path is absent."""
    return F.when(node(v, path).isNotNull(), F.is_variant_null(node(v, path)))


def text(v: Column, path: str = "$") -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def boolean(v: Column, path: str = "$") -> Column:
    return F.when(kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def i64(v: Column, path: str = "$") -> Column:
    return F.when(kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def u64(v: Column, path: str = "$") -> Column:
    """Whole number in 0 .. 2^64-1 as DECIMAL(20,0). Fractions, texts and negatives give NULL."""
    t, d = kind(v, path), F.try_variant_get(v, path, "decimal(20,0)")
    small = (t == "BIGINT") & (d >= 0)
    large = t.startswith("DECIMAL") & (d > F.lit(I64_MAX)) & (d <= F.lit(U64_MAX))
    return F.when(small | large, d)


def u64_as_long(v: Column, path: str = "$") -> Column:
    """For slots and heights, whose real values fit a signed long."""
    return u64(v, path).try_cast("bigint")


def items(v: Column, path: str) -> Column:
    """JSON array as ARRAY<VARIANT>; NULL for anything that is not an array."""
    return F.try_variant_get(v, path, "array<variant>")


def length(v: Column, path: str) -> Column:
    """Number of elements of a JSON array; NULL for anything that is not an array.

    The elements are read as booleans, most of them as NULL, so none of them is copied, however large it is.
    """
    return F.array_size(F.try_variant_get(v, path, "array<boolean>"))


def records(v: Column, path: str, fields: list[str]) -> Column:
    """JSON array of objects as ARRAY<STRUCT<field: VARIANT, ...>>; NULL if it is not an array.

    One typed read for the whole array; fields that are absent are NULL, and so is an element that
    is no object.
    """
    typ = f"array<struct<{', '.join(f'{f}: variant' for f in fields)}>>"
    return F.try_variant_get(v, path, typ)
