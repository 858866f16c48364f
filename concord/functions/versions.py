"""Version spellings and their order, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The short tags of the public version scheme in their order, a final release between candidates and posts.
TAGS = ("dev", "a", "b", "rc", "", "post")
LONG_TAGS = {"alpha": "a", "beta": "b"}
TAG = "|".join([*LONG_TAGS, *filter(None, TAGS)])
# Fixed pattern: how a version may be written.
VERSION = rf"v?\d+(?:\.\d+)*(?:[.\-]?(?:{TAG})[.\-]?\d*)*(?:\+[0-9A-Za-z.]+)?"


def normalize_version(text: Column) -> Column:
    """One spelling per version: trimmed, lower case, no leading v, short tags without separators.

    A text that is no version only loses its case, its blanks and a leading v.
    """
    low = F.lower(F.trim(text))
    release = F.regexp_extract(low, r"^v?([0-9]+(?:\.[0-9]+)*)", 1)
    local = F.regexp_extract(low, r"(\+.*)$", 1)
    pieces = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(low, r"\+.*$", ""), r"^v?[0-9.]*", ""), F.lit("([a-z]+|[0-9]+)"), 1)
    tags = F.create_map(*[F.lit(x) for pair in LONG_TAGS.items() for x in pair])
    short = F.transform(pieces, lambda p: F.coalesce(F.try_element_at(tags, p), p))
    return F.when(low.rlike(f"^(?:{VERSION})$"), F.concat(release, F.array_join(short, ""), local)).otherwise(F.regexp_replace(low, "^v", ""))


def version_numbers(version: Column, n: int = 3) -> Column:
    """The first ``n`` numbers of a version; what is not written is zero."""
    written = F.split(F.regexp_extract(F.trim(version), "^[vV]?([0-9.]*)", 1), "[.]")
    padded = F.slice(F.concat(written, F.array_repeat(F.lit("0"), n)), 1, n)
    return F.transform(padded, lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long")))


def version_key(version: Column) -> Column:
    """Sorts versions: (numbers, rank, number of the tag). Zeros at the end are left out, so 30.3 equals 30.3.0 and
    versions of any length compare whole. Numbers may have 38 digits.

    Ranks go dev, a, b, rc, final, post by the first tag; a tag without a number counts as number 0.
    """
    text = normalize_version(version)
    tag = F.regexp_extract(text, r"^[0-9.]+([a-z]+)[0-9]*", 1)
    rank = F.array_position(F.array(*[F.lit(t) for t in TAGS]), tag)
    number = F.coalesce(F.regexp_extract(text, r"^[0-9.]+[a-z]+([0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))
    written = F.split(F.regexp_replace(F.regexp_extract(text, "^[0-9.]*", 0), r"([.]0*)+$", ""), "[.]")
    numbers = F.transform(written, lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))
    return F.struct(numbers.alias("numbers"), rank.alias("rank"), number.alias("number"))


def level_of(raw: Column, package: Column) -> Column:
    """The version a requirement pins: bare, ``name==v`` or ``name@v``, with an optional extra.

    A range or a bare name pins nothing.
    """
    text = F.trim(raw)
    named = F.coalesce(F.startswith(F.lower(text), F.lower(package)) & (package != ""), F.lit(False))
    rest = F.trim(F.regexp_replace(F.substring(text, F.length(package) + 1, F.length(text)), r"^\[[^\]]*\]", ""))
    pinned = F.trim(F.regexp_extract(rest, r"^(?:==|@)(.*)$", 1))
    return F.when(named, F.when(pinned.rlike(f"^(?:{VERSION})$"), pinned)).when(text.rlike(f"^(?:{VERSION})$"), text)
