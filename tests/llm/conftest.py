"""Small tables for the operators of ``concord.llm``."""

import pytest

from concord.llm import common


@pytest.fixture(scope="session", autouse=True)
def shared_checkpoints(spark, tmp_path_factory):
    """A local session has no shared folder of its own."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    return common.shared_folder(spark)


@pytest.fixture
def docs(spark):
    """A function from (doc_id, text) pairs to a documents table with clashing extra columns."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", score string, size string, n string, place string, value string" if extra else "")
        more = ("s", "s", "s", "s", "s") if extra else ()
        return spark.createDataFrame([(i, t, "en", None if i is None else f"src{i % 2}", None if t is None else len(t), *more) for i, t in rows], schema)

    return make


@pytest.fixture
def hard():
    """Rows that every operator must survive: nulls, empty, blank, long, repeated."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [(None, "a text without id"), (1, None), (2, ""), (3, " \t\n"), (4, long), (5, "one"), (5, "one"), (5, "another text of that id"), (6, "été 漢字 \U0001f600 x" * 3), (7, long)]
