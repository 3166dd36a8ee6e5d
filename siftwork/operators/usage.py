"""Request and token use in trailing windows, per provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE, DAY = 60, 86_400


def rolling_usage(
    log: DataFrame, max_rpm: int, max_tpm: int, max_rpd: int, *, bucket_seconds: int = 3600
) -> DataFrame:
    """Each request with the requests and tokens of the trailing minute and the requests of the trailing day.

    ``log`` has (provider, request_id, ts timestamp, tokens). A provider may hold most of the
    log, so no window runs over a whole provider: every request adds itself at its time and
    takes itself back after a minute and after a day, those steps are summed per time bucket,
    and only the bucket sums are accumulated per provider. Within a bucket a window then adds
    the rest. Both ends of a window count.
    """
    micros = F.unix_micros("ts")

    def step(kind: str, after: int, minute: int, day: int) -> Column:
        # Odd keys follow the even key of the same instant: a request leaves after its window.
        at = (micros + F.lit(after * 1_000_000)) * 2 + (1 if after else 0)
        return F.struct(
            F.lit(kind).alias("kind"), at.alias("at"),
            F.lit(minute).alias("d_minute"), (F.col("tokens") * minute).alias("d_tokens"), F.lit(day).alias("d_day"),
        )

    steps = F.array(step("request", 0, 1, 1), step("minute", MINUTE, -1, 0), step("day", DAY, 0, -1))
    deltas = (
        log.select("provider", "request_id", "ts", "tokens", F.explode(steps).alias("s"))
        .select("provider", "request_id", "ts", "tokens", "s.*")
        .withColumn("bucket", F.floor(F.col("at") / F.lit(2_000_000 * bucket_seconds)))
    )
    sums = [F.sum(c).alias(f"p_{c}") for c in ("d_minute", "d_tokens", "d_day")]
    before = Window.partitionBy("provider").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = deltas.groupBy("provider", "bucket").agg(*sums).select(
        "provider", "bucket",
        *[F.coalesce(F.sum(f"p_{c}").over(before), F.lit(0)).alias(f"c_{c}") for c in ("d_minute", "d_tokens", "d_day")],
    )
    within = Window.partitionBy("provider", "bucket").orderBy("at").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = deltas.select(
        "provider", "bucket", "kind", "request_id", "ts", "tokens",
        *[F.sum(c).over(within).alias(f"w_{c}") for c in ("d_minute", "d_tokens", "d_day")],
    ).where("kind = 'request'")
    used = running.join(carried, ["provider", "bucket"]).select(
        "provider", "request_id", "ts", "tokens",
        (F.col("c_d_minute") + F.col("w_d_minute")).alias("requests_60s"),
        (F.col("c_d_tokens") + F.col("w_d_tokens")).alias("tokens_60s"),
        (F.col("c_d_day") + F.col("w_d_day")).alias("requests_24h"),
    )
    return (
        used.withColumn("rpm_reached", F.col("requests_60s") >= max_rpm)
        .withColumn("tpm_reached", F.col("tokens_60s") >= max_tpm)
        .withColumn("rpd_reached", F.col("requests_24h") >= max_rpd)
    )
