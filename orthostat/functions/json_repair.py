"""Closing what a cut-off JSON text left open, as a vectorised function."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F, types as T


# Ends of the names of fields that a whole object fills.
TELLING = ("_confidence", "_score", "description", "reasoning")


def repair_json(text: str | None) -> str | None:
    """Close open strings' rests, arrays and objects of a cut-off text; balanced texts stay as they are.

    An incomplete last object, key or comma is dropped first. Brackets are closed in the order
    in which they were opened; brackets within strings don't count. Of an array the last object
    is dropped if a confidence, score, description or reasoning in it is null or empty: it was cut
    off before its value came.
    """
    if text is None:
        return None
    if not _open(text):
        return text
    text = text.rstrip()
    for rest in (r",\s*\{[^{}\[\]]*$", r',\s*"[^"]*$', r',\s*"[^"]*"\s*:\s*$', r",\s*$"):
        text = re.sub(rest, "", text)
    closed = text + "".join("]" if c == "[" else "}" for c in reversed(_open(text)))
    try:
        read = json.loads(closed)
    except ValueError:
        return closed
    last = read[-1] if isinstance(read, list) and read else None
    if isinstance(last, dict) and any(v in (None, "") and k.endswith(TELLING) for k, v in last.items()):
        return json.dumps(read[:-1])
    return closed


def _open(text: str) -> list[str]:
    """The brackets that are still open at the end."""
    stack: list[str] = []
    quoted = skip = False
    for c in text:
        if skip:
            skip = False
        elif c == "\\" and quoted:
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "[{":
            stack.append(c)
        elif not quoted and c in "]}" and stack:
            stack.pop()
    return stack


@F.pandas_udf(T.StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """Vectorised :func:`repair_json`."""
    return texts.map(repair_json, na_action="ignore")
