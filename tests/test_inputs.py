"""How the queries read their tables: work on texts is spread, and done once."""

from siftwork.catalog import load
from siftwork.catalog.core import QUERIES, Inputs
from siftwork.operators import chunking
from tests.conftest import DATA


def test_profiles_of_customers_are_spread(spark):
    """One file with one row group is one task; deriving a profile's texts takes far longer than reading it."""
    load()
    t = Inputs(spark, DATA)
    cores = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{DATA}/customer.parquet").rdd.getNumPartitions() < cores
    assert QUERIES["match_query"](t).rdd.getNumPartitions() >= cores
    assert t.customer.count() == spark.read.parquet(f"{DATA}/customer.parquet").count()


def test_postings_are_encoded_once(spark):
    load()
    rows = QUERIES["semantic_match_encoded"](Inputs(spark, DATA))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "/chunks-" in plan
    assert rows.count() == 75
