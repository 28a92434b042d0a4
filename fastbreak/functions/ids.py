"""Ids in parameters and in columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_csv_ids(text: str | None) -> list[int] | None:
    """Distinct sorted ids of a comma-separated parameter; nothing in it means no filter."""
    if text is None:
        return None
    ids = sorted({int(x) for x in "".join(text.split()).split(",") if x})
    return ids or None


def csv_ids_column(text: Column) -> Column:
    """The same for a column: an array, null without ids."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s+", ""), ","), lambda x: x != "")
    ids = F.array_sort(F.array_distinct(F.transform(parts, lambda x: x.cast("int"))))
    return F.when(F.size(ids) > 0, ids)


def contains_all(array: Column, ids: Iterable[int]) -> Column:
    return F.forall(F.array(*(F.lit(i) for i in ids)), lambda x: F.array_contains(array, x))


def same_set(array: Column, ids: Iterable[int]) -> Column:
    wanted = F.array(*(F.lit(i) for i in ids))
    return (F.size(F.array_except(array, wanted)) == 0) & (F.size(F.array_except(wanted, array)) == 0)


def settle_choice(on: list[int], off: list[int], changed: str) -> tuple[list[int], list[int]]:
    """Players chosen on and off court; one who is in both stays in the list that was changed last ("on" or "off")."""
    both = set(on) & set(off)
    return ([x for x in on if changed == "on" or x not in both], [x for x in off if changed == "off" or x not in both])


def overlaps(array: Column, ids: Iterable[int]) -> Column:
    return F.arrays_overlap(array, F.array(*(F.lit(i) for i in ids)))
