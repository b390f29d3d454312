"""Stable identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(parts) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """prefix:digest of the parts, a null among them being 'None'."""
    return F.concat(F.lit(prefix + ":"), F.left(F.sha2(_joined(parts), 256), F.lit(length)))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def seeded_rank(seed: int, *parts: Column) -> Column:
    """A key whose order is a fixed shuffle."""
    return F.sha2(_joined([F.lit(seed), *parts]), 256)


def json_list(value: Column) -> Column:
    """A JSON list as strings; anything else is an empty list."""
    return F.coalesce(F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def ordered_distinct(values: Column) -> Column:
    """First occurrences, without nulls and empty strings."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))
