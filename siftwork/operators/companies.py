"""Company lists per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["profile", "source", "slug"]


def newest_companies(companies: DataFrame) -> DataFrame:
    return companies.orderBy("profile", "source", F.desc("discovered_at"), "slug")


def merged_companies(priority: DataFrame, cached: DataFrame) -> DataFrame:
    """Configured companies in their order, then the cached ones that are not configured.

    Equal entries of the configured list stay; ``position`` orders the two parts.
    """
    first = priority.select(*KEY, F.lit(0).alias("part"), F.col("position").cast("bigint").alias("position"))
    newest = -F.unix_micros("discovered_at")
    rest = cached.join(priority.select(*KEY), KEY, "left_anti")
    second = rest.select(*KEY, F.lit(1).alias("part"), newest.alias("position"))
    return first.unionByName(second)


def new_companies(listed: DataFrame, existing: DataFrame) -> DataFrame:
    """Listed companies not known yet; repeats within the list stay."""
    return listed.join(existing.select(*KEY).distinct(), KEY, "left_anti")


def with_new_companies(listed: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.select(*KEY).unionByName(new_companies(listed, existing).select(*KEY))


def stale_ids(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``source`` that ``target`` does not have."""
    return source.select(*keys).distinct().join(target.select(*keys), keys, "left_anti")
