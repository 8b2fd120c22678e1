"""Codes of stored columns: enumerations, lists of paths, hash lengths, presence of metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stored codes and what they stand for.
ALGORITHMS = {"average": "Average", "difference": "Difference", "perceptual": "Perceptual", "fusion": "Fusion"}
MODULES = {"duplicates": "Duplicates", "screenshots": "Screenshots", "similar": "Similar Photos", "large_files": "Large Files", "unorganized": "Unorganized"}
STATUSES = {"completed": "Completed", "cancelled": "Cancelled", "error": "Error"}


def decode(code: Column, names: dict[str, str], unknown: str | None = None) -> Column:
    """What a stored code stands for; an unknown or null code gives ``unknown``, or an error where that is None."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(code))
    other = F.raise_error(F.concat(F.lit("unknown code: "), F.coalesce(code, F.lit("null")))) if unknown is None else F.lit(unknown)
    return F.coalesce(found, other)


def encode(name: Column, names: dict[str, str]) -> Column:
    """The stored code of a name, null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for code, shown in names.items() for x in (shown, code)]), name)


def paths_to_json(paths: Column) -> Column:
    return F.to_json(paths)


def paths_from_json(text: Column) -> Column:
    """The stored paths; null or unreadable text gives an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def hash_bits(signature: Column) -> Column:
    """Number of bits of a binary hash."""
    return F.octet_length(signature) * 8


def has_data(*fields: Column) -> Column:
    """Is any of the metadata fields known?"""
    return F.coalesce(*[F.when(f.isNotNull(), F.lit(True)) for f in fields], F.lit(False))
