"""Vector distance, similarity and section weights as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions.strings import contains_any, first_of, lookup

METRICS = ("cosine", "l2sq")
# Distances are compared at this many decimals: stored vectors are single precision, and
# equal vectors must tie whatever the summation order.
DISTANCE_DECIMALS = 9


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return F.lit(1.0) - _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    if metric == "l2sq":
        return _dot(a, a) + _dot(b, b) - F.lit(2.0) * _dot(a, b)
    raise ValueError(f"metric must be one of {METRICS}")


def similarity(dist: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - dist))


def retrieval_weight(chunk_key: Column, query_text: Column) -> Column:
    """Section weight in retrieval; pay words in the query lift compensation and benefits."""
    about_pay = contains_any(F.lower(F.coalesce(query_text, F.lit(""))), vocab.PAY_QUERY_TERMS)
    lifted = F.when(about_pay, lookup({"compensation": 1.05, "benefits": 1.00}, chunk_key))
    return F.coalesce(lifted, lookup(vocab.RETRIEVAL_WEIGHTS, chunk_key), F.lit(1.0))


def retrieval_reason(sections: Column) -> Column:
    first, second = first_of(sections), F.get(sections, F.lit(1))
    return (
        F.when(F.size(sections) == 0, F.lit("No semantic evidence matched this query."))
        .when(F.size(sections) == 1, F.concat(F.lit("Best semantic match came from the "), first, F.lit(" section.")))
        .otherwise(
            F.concat(
                F.lit("Best semantic match came from the "), first,
                F.lit(" section, with supporting evidence in "), second, F.lit("."),
            )
        )
    )


def clamp_k(value: int | None, default: int, upper: int) -> int:
    """How many rows a caller wants; more than ``upper`` is refused, not cut in silence."""
    wanted = default if value is None else int(value)
    if wanted > upper:
        raise ValueError(f"at most {upper} rows can be asked for, not {wanted}")
    return max(1, wanted)
