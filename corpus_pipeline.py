"""A corpus pipeline from raw documents to packed training sequences.

Each stage works on all that its predecessor kept; between stages the rows are
written as Parquet in the shared scratch folder and read again. A stage begins by
removing what the stages before it stored for themselves, unless its documents are
still to be read from there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from irisframe.llm import host_rules, line_dedup, minhash, packing, substring
from irisframe.session import drop_scratch, owned_scratch, scratch_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders of earlier stages that may be in use.
_held: list[str] = []


def stage(run: Stage) -> Stage:
    @wraps(run)
    def owning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        used = docs.inputFiles() if _held else []
        done = [path for path in _held if not any(path.rpartition("/")[2] in file for file in used)]
        drop_scratch(spark, done)
        _held[:] = [path for path in _held if path not in done]
        with owned_scratch() as owned:
            kept = run(spark, docs, sf_dir)
        _held.extend(owned)
        return kept

    return owning


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and come from an acceptable host."""
    return host_rules.keep_good(docs)


@stage
def line_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites."""
    return line_dedup.drop_boilerplate(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.drop_near_duplicates(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that an earlier document has."""
    return substring.drop_passages(docs)


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's tokens lies in the training sequences."""
    return packing.pack(docs, VOCABULARY)


#: Readable on every executor.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_boilerplate),
    ("near dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: Packing needs tokenizer ids, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = scratch_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
