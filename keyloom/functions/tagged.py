"""Tagged JSON items read in Python workers: one-key objects ``{tag: value}`` under attribute names."""

from __future__ import annotations

import json

import pyarrow as pa

#: The tags of the value model.
TAGS = frozenset({"S", "N", "B", "BOOL", "NULL", "SS", "NS", "BS", "L", "M"})


def parse_object(text: str | None) -> dict | None:
    """The JSON object in ``text``; None for null, cut-off or damaged text, other JSON values, and nesting beyond the parser's depth."""
    if not text:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def tagged(value: object) -> tuple[str, object] | None:
    """Tag and content of a tagged value, or None if it isn't one."""
    if isinstance(value, dict) and len(value) == 1:
        (tag, content), = value.items()
        if tag in TAGS:
            return tag, content
    return None


def strings(values: list) -> pa.Array:
    """A string array; halves of surrogate pairs, which UTF-8 cannot hold, become replacement characters."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], pa.string())


def dumps(value: object) -> str:
    """One spelling per JSON value: no blanks, keys in order."""
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
