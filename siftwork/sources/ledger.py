"""Scoring attempts as a ledger: a batch that is repeated after a failure counts once.

Every batch has a number, and its attempts, one row per posting, are one partition of the ledger, which a repeated batch
writes over. Totals are sums over batches, never added onto a stored number. ``fold`` sums up older batches
into one table of totals; a row in the table of folds says up to which batch, and is written last, so a fold that fails half
way changes nothing. Batches come in rising numbers, as a stream gives them; one at or below the last fold has been
counted and is ignored.

Tables: ``<path>`` (by batch), ``<path>-totals`` (by fold), ``<path>-folds`` (fold, upto).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.sources.tables import KEY, drop_partition, read_table, rewrite_partitions, staged

LEDGER = "profile string, id string, tries long, error string, error_at timestamp, reset boolean, batch long"
TOTALS = "profile string, id string, tries long, error string, error_at timestamp, fold long"
FOLDS = "fold long, upto long"


def last_fold(spark: SparkSession, path: str) -> tuple[int, int]:
    """The last finished fold and the batch it goes up to; (0, -1) before the first."""
    row = read_table(spark, f"{path}-folds", FOLDS).agg(F.max(F.struct("fold", "upto")).alias("last")).first()
    return (row["last"]["fold"], row["last"]["upto"]) if row["last"] is not None else (0, -1)


def _write_batch(rows: DataFrame, path: str, batch: int) -> None:
    if batch <= last_fold(rows.sparkSession, path)[1]:
        return
    rows = rows.withColumn("batch", F.lit(batch).cast("long")).select(*[f.split()[0] for f in LEDGER.split(", ")])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def append_attempts(attempts: DataFrame, path: str, batch: int) -> None:
    """The tries of one batch: ``attempts`` is (profile, id, tried_at, error), one row per try.

    Tries of a posting are summed up and its last error kept before anything moves.
    """
    failed = F.when(F.col("error").isNotNull(), F.struct("tried_at", "error"))
    summed = attempts.groupBy(*KEY).agg(F.count("*").alias("tries"), F.max(failed).alias("last"))
    _write_batch(summed.select(*KEY, "tries", F.substring("last.error", 1, vocab.MAX_ERROR_CHARS).alias("error"), F.col("last.tried_at").alias("error_at"), F.lit(False).alias("reset")), path, batch)


def append_resets(postings: DataFrame, path: str, batch: int) -> None:
    """Postings (profile, id) whose earlier tries and errors no longer count; the batch holds nothing else."""
    gone = postings.select(*KEY).distinct()
    _write_batch(gone.select(*KEY, F.lit(0).cast("long").alias("tries"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("error_at"), F.lit(True).alias("reset")), path, batch)


def _summed(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Totals of the last fold and the batches after it, up to batch ``upto``."""
    number, folded_upto = last_fold(spark, path)
    folded = read_table(spark, f"{path}-totals", TOTALS).where(F.col("fold") == number).drop("fold")
    folded = folded.withColumn("reset", F.lit(False)).withColumn("batch", F.lit(folded_upto).cast("long"))
    later = read_table(spark, path, LEDGER).where(F.col("batch") > folded_upto)
    rows = folded.unionByName(later if upto is None else later.where(F.col("batch") <= upto))
    # Resets are rare: what they end is left out by a join with them alone.
    resets = rows.where("reset").groupBy(*KEY).agg(F.max("batch").alias("_reset"))
    counted = rows.join(resets, KEY, "left").where(F.col("_reset").isNull() | (F.col("batch") > F.col("_reset")))
    last = F.max_by(F.struct("error", "error_at"), F.when(F.col("error").isNotNull(), F.struct("error_at", "batch", "error")))
    return counted.groupBy(*KEY).agg(F.sum("tries").alias("tries"), last.alias("l")).select(*KEY, "tries", "l.error", "l.error_at")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(profile, id, tries, error, error_at) of every posting that was tried since its last reset."""
    return _summed(spark, path)


def fold(spark: SparkSession, path: str) -> None:
    """Sums up all batches but the newest, which a stream may still repeat."""
    number, upto = last_fold(spark, path)
    newest = read_table(spark, path, LEDGER).agg(F.max("batch")).first()[0]
    if newest is None or newest - 1 <= upto:
        return
    below = newest - 1
    content = _summed(spark, path, below).withColumn("fold", F.lit(number + 1).cast("long"))
    content.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(f"{path}-totals")
    spark.createDataFrame([(number + 1, below)], FOLDS).coalesce(1).write.mode("append").parquet(f"{path}-folds")
    # From here on the old rows count no more; removing them only saves space.
    old = read_table(spark, path, LEDGER).where(F.col("batch") <= below).select("batch").distinct()
    for row in old.collect():  # partition values
        drop_partition(spark, path, {"batch": row["batch"]})
    drop_partition(spark, f"{path}-totals", {"fold": number})


def with_attempts(postings: DataFrame, counted: DataFrame) -> DataFrame:
    """Postings with the ledger's numbers: tries of all batches, the last error; 0 and none without a row."""
    joined = postings.join(counted.select(*KEY, "tries", F.col("error").alias("_error")), KEY, "left")
    return joined.withColumns({"score_attempts": F.coalesce("tries", F.lit(0)).cast("int"), "score_error": F.col("_error")}).select(*postings.columns)


def attempts_into_table(spark: SparkSession, ledger: str, path: str, schema: str, partition_by: list[str]) -> None:
    """Brings the posting table up to the ledger; only partitions with a posting whose numbers differ are rewritten.

    Numbers are set, not added, so this may be repeated at any time.
    """
    with staged(totals(spark, ledger)) as counted:
        table = read_table(spark, path, schema)
        now = with_attempts(table, counted).select(*KEY, F.col("score_attempts").alias("_tries"), F.col("score_error").alias("_error"))
        differs = ~(F.col("score_attempts").eqNullSafe(F.col("_tries")) & F.col("score_error").eqNullSafe(F.col("_error")))
        hit = table.join(now, KEY).where(differs).select(*partition_by).distinct()
        with staged(hit) as touched:
            if not touched.isEmpty():
                rewrite_partitions(with_attempts(table.join(touched, partition_by, "left_semi"), counted), path, partition_by)
