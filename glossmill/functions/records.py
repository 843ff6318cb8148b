"""Small records inside strings: paths, and settings kept as one encoded value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks between settings, and between a name and its value; the longest value.
ITEM, PAIR = "___", "###"
LONGEST_VALUE = 4096


def folder_of(path: Column) -> Column:
    """All of a path up to its last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def name_of(path: Column) -> Column:
    """What follows a path's last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def clean_path(path: Column) -> Column:
    """A path without empty and ``.`` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def settings(text: Column) -> Column:
    """All settings of an encoded value as a map<string,string>; of a repeated name the first counts."""
    pairs = F.filter(F.transform(F.split(text, ITEM), lambda p: F.split(p, PAIR, 2)), lambda p: (F.size(p) == 2) & (p[0] != ""))
    firsts = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q[0]), p[0]) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda p: F.struct(p[0], p[1])))


def encoded_settings(values: Column) -> Column:
    """The reverse of ``settings``, by name."""
    entries = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(PAIR), e["value"])), ITEM)


def with_settings(text: Column, changes: dict[str, str]) -> Column:
    """An encoded value with settings changed or added; values are cut at ``LONGEST_VALUE``."""
    new = F.create_map(*(F.lit(x) for k, v in changes.items() for x in (k, v[:LONGEST_VALUE])))
    kept = F.map_filter(settings(text), lambda k, _: ~F.map_contains_key(new, k))
    return encoded_settings(F.map_concat(kept, new))


def without_settings(text: Column, names: list[str]) -> Column:
    """An encoded value less the named settings."""
    return encoded_settings(F.map_filter(settings(text), lambda k, _: ~k.isin(names)))


def only_settings(text: Column, names: list[str]) -> Column:
    """array<string>: the values of the named settings, empty where there is none."""
    known = settings(text)
    return F.array(*(F.coalesce(F.try_element_at(known, F.lit(n)), F.lit("")) for n in names))
