"""Files of a corpus: listing, size guard, decoding, and a folder for written results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import shared_folder

# Fixed value: a file with more characters than this is data and is not searched.
MAX_CHARACTERS = 2_000_000


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)


def scan_corpus(spark: SparkSession, root: str, glob: str = "*", limit: int | None = None) -> DataFrame:
    """Files under ``root`` whose name fits ``glob``: path and size, sorted by path. No content is read."""
    files = _files(spark, root, glob).select("path", F.col("length").alias("size")).orderBy("path")
    return files if limit is None else files.limit(limit)


def with_contents(spark: SparkSession, listing: DataFrame, root: str, glob: str = "*") -> DataFrame:
    """The files of a ``scan_corpus`` listing with their content, in no order. Contents are not sorted; AQE broadcasts a short
    listing, and only a long one moves them once by path."""
    return _files(spark, root, glob).select("path", F.col("length").alias("size"), "content").join(listing.select("path"), "path", "left_semi")


def drop_oversize(files: DataFrame, text: str = "content", limit: int = MAX_CHARACTERS) -> DataFrame:
    """Only files small enough to be searched; apply before any pattern or explode."""
    return files.where(F.length(text) <= limit)


def decode_audit(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """How bytes read as latin-1 (never fails) and as UTF-8 (bad bytes become U+FFFD)."""
    latin = F.decode(content, "ISO-8859-1")
    utf8 = F.make_valid_utf8(F.col(content).cast("string"))
    return files.select(
        *keys,
        F.is_valid_utf8(F.col(content).cast("string")).alias("valid_utf8"),
        F.length(latin).alias("latin1_chars"),
        F.length(utf8).alias("utf8_chars"),
        (latin != utf8).alias("differ"),
    )


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written results, below the session's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
