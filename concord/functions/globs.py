"""Globs as patterns."""

from __future__ import annotations

import re

# What each wildcard stands for.
WILDCARDS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def glob_regex(glob: str) -> str:
    """The pattern of a glob, for ``rlike``: ``**/`` any directories, ``**`` anything, ``*`` and
    ``?`` within one directory."""
    pieces = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^(?:" + "".join(WILDCARDS.get(p, re.escape(p)) for p in pieces) + r")\z"


def is_concrete(glob: str) -> bool:
    """Whether a glob names one file."""
    return not re.search(r"[*?]", glob)
