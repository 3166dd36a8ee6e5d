"""Postings to section chunks, chunks to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork import vocab
from siftwork.functions import sections as S
from siftwork.functions import text as X
from siftwork.functions.strings import strip, text_of
from siftwork.operators.calls import answered

DEFAULT_MODEL = "hashing-tf-256"
CHUNK_FIELDS = "profile string, job_id string, model_name string, chunk_key string, chunk_order int, chunk_text string"

Encoder = Callable[[list[str]], "list[list[float]]"]


def section_chunks(postings: DataFrame, max_chars: int = vocab.SECTION_CHARS) -> DataFrame:
    """One chunk per section a posting has, with its header lines in front.

    All of it happens inside the row (an array per posting, exploded at the end), so nothing
    is shuffled and a hot company or profile makes no difference. A posting without any
    block text yields one summary chunk.
    """
    raw = text_of(F.col("raw_text"))

    def header(label: str, column: str):
        value = F.coalesce(X.metadata_field(raw, label), text_of(F.col(column)))
        return F.concat(F.lit(f"{label}: "), value)

    prefix = F.concat_ws("\n", header("Title", "title"), header("Company", "company"), header("Location", "location"))
    body = X.description_body(raw)
    named = F.transform(
        S.split_blocks(body),
        lambda b, i: F.struct(S.assign_section(b, i == 0).alias("section"), S.normalize_block(b).alias("body")),
    )
    blocks = postings.select(
        "profile", F.col("id").alias("job_id"), prefix.alias("prefix"), body.alias("body"), named.alias("blocks")
    )

    def section(order: int, key: str):
        mine = F.filter("blocks", lambda b: (b["section"] == key) & (b["body"] != ""))
        joined = F.array_join(F.transform(mine, lambda b: b["body"]), "\n\n")
        return F.struct(
            F.lit(key).alias("chunk_key"),
            F.lit(order).alias("chunk_order"),
            strip(F.substring(joined, 1, max_chars)).alias("text"),
        )

    candidates = F.array(*[section(i, s) for i, s in enumerate(vocab.SECTIONS)])
    filled_sections = F.filter(candidates, lambda c: c["text"] != "")
    fallback = F.array(
        F.struct(
            F.lit(vocab.SECTIONS[0]).alias("chunk_key"),
            F.lit(0).alias("chunk_order"),
            F.substring(S.normalize_block(F.col("body")), 1, max_chars).alias("text"),
        )
    )
    chosen = F.when(F.size(filled_sections) > 0, filled_sections).otherwise(fallback)
    rows = blocks.select("profile", "job_id", "prefix", F.explode(chosen).alias("c"))
    return rows.select(
        "profile", "job_id", "c.chunk_key", "c.chunk_order",
        strip(
            F.concat(F.col("prefix"), F.lit("\nSection: "), F.col("c.chunk_key"), F.lit("\n"), F.col("c.text"))
        ).alias("chunk_text"),
    )


def hashing_encoder(df: DataFrame, text: str = "chunk_text", out: str = "embedding", dimensions: int = 256) -> DataFrame:
    """A deterministic encoder without a model: hashed term counts at unit length, JVM only."""
    tokens = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}+#]+", minTokenLength=2)
    counts = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dimensions)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    encoded = df
    for stage in (tokens, counts, unit):
        encoded = stage.transform(encoded)
    return encoded.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_counts", "_unit")


def _unit_vectors(make_encoder: Callable[[], Encoder]) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """The encoder with its vectors at unit length, in single precision."""

    def make() -> Callable[[list[str]], list[list[float]]]:
        import numpy as np

        encode = make_encoder()

        def unit(texts: list[str]) -> list[list[float]]:
            vectors = np.asarray(encode(texts), dtype="float64").reshape(len(texts), -1)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            return (vectors / np.where(norms == 0, 1.0, norms)).astype("float32").tolist()

        return unit

    return make


def embed_chunks(
    chunks: DataFrame, model_name: str = DEFAULT_MODEL, make_encoder: Callable[[], Encoder] | None = None,
    cache: str | None = None, batch_size: int = vocab.ENCODER_BATCH,
) -> DataFrame:
    """Chunks with unit-length vectors and their dimension.

    ``make_encoder`` runs once per task and returns ``encode(texts) -> vectors``; without it
    the hashing encoder is used. With ``cache``, the path of a table of answers, it sees every distinct
    text once, ``batch_size`` at a time, and none that an earlier run has stored; without, texts reach it in Arrow batches.
    """
    named = chunks.withColumn("model_name", F.lit(model_name))
    if make_encoder is not None and cache is not None:
        known = answered(named, cache, model_name, ["chunk_text"], _unit_vectors(make_encoder), "array<float>", batch_size, "embedding")
        return known.withColumn("dimensions", F.size("embedding"))
    if make_encoder is None:
        encoded = hashing_encoder(named)
        return encoded.withColumn("dimensions", F.size("embedding"))

    columns = [f.split()[0] for f in CHUNK_FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encode = make_encoder()
        for batch in batches:
            vectors = np.asarray(encode(batch["chunk_text"].tolist()), dtype="float64")
            vectors = vectors.reshape(len(batch), -1)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = (vectors / np.where(norms == 0, 1.0, norms)).astype("float32")
            yield batch.assign(embedding=list(unit), dimensions=unit.shape[1])

    schema = CHUNK_FIELDS + ", embedding array<float>, dimensions int"
    return named.select(*columns).mapInPandas(run, schema)


def chunk_and_embed(
    due: DataFrame, model_name: str = DEFAULT_MODEL, make_encoder: Callable[[], Encoder] | None = None, cache: str | None = None
) -> DataFrame:
    """Due postings to embedded chunks; write the result with ``replace_group``."""
    return embed_chunks(section_chunks(due), model_name, make_encoder, cache)


def decode_vector(c):
    """A vector stored as JSON text; unreadable text is an empty vector."""
    return F.coalesce(F.from_json(c, "array<float>"), F.array().cast("array<float>"))


def build_index_rows(rows: DataFrame) -> DataFrame:
    """Index rows as a vector index wants them: no blank text, no nulls, one id per chunk."""
    blank = F.lit("")
    present = rows.where(strip(text_of(F.col("chunk_text"))) != "")
    return present.select(
        X.chunk_uid(F.col("job_id"), F.col("chunk_key"), F.col("model_name")).alias("uid"),
        *[
            F.coalesce(F.col(c).cast("string"), blank).alias(c)
            for c in ("profile", "job_id", "chunk_key", "title", "company", "source", "url", "model_name", "scored_at",
                      "status", "created_at")
        ],
        strip(F.col("chunk_text")).alias("chunk_text"),
        F.coalesce("chunk_order", F.lit(0)).alias("chunk_order"),
        F.col("embedding"),
        F.size("embedding").alias("dimensions"),
        F.coalesce(F.col("fit_score").cast("double"), F.lit(0.0)).alias("fit_score"),
        F.coalesce(F.col("ats_score").cast("double"), F.lit(0.0)).alias("ats_score"),
    )


def dimension_conflicts(index: DataFrame) -> DataFrame:
    """(profile, model) pairs with more than one vector length: those need a full rebuild."""
    spread = index.groupBy("profile", "model_name").agg(
        F.min("dimensions").alias("least"), F.max("dimensions").alias("most")
    )
    return spread.where("least <> most")


