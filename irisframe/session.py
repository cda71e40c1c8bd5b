"""Session construction and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "irisframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned for.

    ``master`` stays unset on a cluster, where spark-submit provides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # One image can be hundreds of kilobytes, so Python batches are bounded
        # by bytes as well as by rows.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for tables and stream checkpoints.

    Lives under ``spark.checkpoint.dir``, which every executor can reach, and
    under the warehouse folder in sessions without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    for owned in _owners:
        owned.append(path)
    return path


_owners: list[list[str]] = []


@contextmanager
def owned_scratch() -> Iterator[list[str]]:
    """The scratch folders that are handed out inside the block, for their owner to
    remove once nothing reads them."""
    owned: list[str] = []
    _owners.append(owned)
    try:
        yield owned
    finally:
        _owners[:] = [o for o in _owners if o is not owned]


def drop_scratch(spark: SparkSession, paths: Sequence[str]) -> None:
    """Remove scratch folders, wherever they lie."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
