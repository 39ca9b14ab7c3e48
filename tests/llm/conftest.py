import pytest
from pyspark.sql import types as T

from skyledger.llm.common import prepared, written

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def documents(llm):
    """A table of documents from (doc_id, text[, lang[, source]]) tuples, in several files."""
    def make(rows, partitions=3):
        full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return written(llm.createDataFrame(full, DOCUMENTS).repartition(partitions), "documents")

    return make


@pytest.fixture(scope="session")
def clashing():
    """The same rows with further columns whose names the operators use for themselves."""
    from pyspark.sql import functions as F

    names = ["rid", "x_rid", "x_text", "key", "id", "n", "occ", "owner", "repo", "hash", "piece", "x_live", "group", "component", "size", "part"]
    return lambda df: written(df.select("*", *(F.lit(f"own {name}").alias(name) for name in names)), "clashing")
