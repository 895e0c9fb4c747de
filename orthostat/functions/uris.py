"""Stored URIs are not uniform: they are compared by their normalised last path segment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space that counts as outer blanks.
_OUTER = r"^\s+|[\s/]+$"


def uri_key(uri: Column) -> Column:
    """Last path segment, lower-cased, without outer blanks and trailing slashes; blank gives null."""
    last = F.lower(F.trim(F.substring_index(F.regexp_replace(uri, _OUTER, ""), "/", -1)))
    return F.when(F.length(last) > 0, last)


def uri_set(uris: Column) -> Column:
    """The set of things that an array of URIs denotes, sorted; nulls, order and repetition don't count."""
    keys = F.filter(F.transform(uris, uri_key), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))))
