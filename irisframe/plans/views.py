"""Views that give the sample tables the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import cross_entropy, score_predictions
from ..operators.ordered import global_index
from ..operators.splits import batched

NUM_CLASSES = 10
VECTOR_WIDTH = 64
IMAGE_SIDE = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def logits(vector: str) -> Column:
    """Ten class logits from a whole 64-vector: logit k adds every 10th component from k.

    Written as vector additions of slices. Unrolled, the 64 terms would make the
    compiled stage too large for the JVM to optimise.
    """
    total = f"transform(slice({vector}, 1, {NUM_CLASSES}), x -> cast(x as double))"
    for start in range(NUM_CLASSES + 1, VECTOR_WIDTH + 1, NUM_CLASSES):
        part = f"slice({vector}, {start}, {NUM_CLASSES})"
        # The last slice is shorter than the others.
        term = "cast(x as double)" if start + NUM_CLASSES <= VECTOR_WIDTH + 1 else "coalesce(cast(x as double), 0D)"
        total = f"zip_with({total}, {part}, (a, x) -> a + {term})"
    return F.expr(total)


def logit_table(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vectors.select("vec_id", "label", logits("embedding").alias("logits"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    scored, _ = score_predictions(logit_table(spark, folder), num_classes=NUM_CLASSES)
    return scored


def batched_losses(spark: SparkSession, folder: str, batch_size: int, smoothing: float) -> DataFrame:
    """(vec_id, loss, batch_id): only the loss takes part in the ordering."""
    loss = cross_entropy("logits", "label", smoothing, NUM_CLASSES).alias("loss")
    losses = logit_table(spark, folder).select("vec_id", loss)
    return batched(global_index(losses, ["vec_id"]), batch_size)


def document_paths(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select("doc_id", "lang", "source", path.alias("path"))


def synthetic_files(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    name = F.format_string("synthetic_OCT_%d.png", F.col("vec_id") + 1)
    return vectors.select("vec_id", name.alias("synthetic_path"))


def small_images(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as an 8 x 8 image of one channel."""
    side = F.lit(IMAGE_SIDE)
    return table(spark, folder, "embeddings").select(
        "vec_id",
        side.alias("height"),
        side.alias("width"),
        F.lit(1).alias("channels"),
        F.col("embedding").cast("array<double>").alias("px"),
    )


def neighbour_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, next_id) in id order; the last wraps to the first."""
    vectors = table(spark, folder, "embeddings").select("vec_id")
    n = vectors.count()
    ids = global_index(vectors, ["vec_id"])
    after = ids.select(F.col("vec_id").alias("next_id"), F.pmod(F.col("idx") - 1, F.lit(n)).alias("idx"))
    return ids.join(after, "idx").select("vec_id", "next_id")


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector (a) with the next one in id order (b)."""
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )
    pairs = neighbour_ids(spark, folder)
    left = vectors.withColumnRenamed("v", "a").join(pairs, "vec_id")
    return left.join(vectors.select(F.col("vec_id").alias("next_id"), F.col("v").alias("b")), "next_id").select("vec_id", "label", "a", "b")


def pixels_long(df: DataFrame, px: str = "px") -> DataFrame:
    """(vec_id, pos, value): one row per output pixel."""
    return df.select("vec_id", F.posexplode_outer(px).alias("pos", "v")).select(
        "vec_id", "pos", r6("v").alias("value")
    )


def colour_images(spark: SparkSession, folder: str) -> DataFrame:
    """8 x 8 images of three channels with values in 0..255 from whole embeddings."""
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    level = lambda v: F.least(F.greatest(F.floor(v * 48 + 128), F.lit(0)), F.lit(255)).cast("double")
    pixel = lambda i: F.array(level(F.get("e", i)), level(F.get("e", 63 - i)), level(-F.get("e", i)))
    px = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), pixel))
    dims = {"height": 8, "width": 8, "channels": 3}
    return e.select("vec_id", *[F.lit(n).alias(c) for c, n in dims.items()], px.alias("px"))
