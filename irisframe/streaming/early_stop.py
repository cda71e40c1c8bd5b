"""Early stopping on a live stream of epoch values.

A keyed state would hand all new rows of a run to one task. Instead every micro-batch
goes through the batch rule, which cuts long runs into parts, and goes on from the
table of runs that the batch before it left: five numbers a run. The table of batch n
is written from that of batch n - 1 alone, so a batch that is repeated after a failure
writes the same table again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EARLY_STOP_PATIENCE
from ..operators.runlog import early_stop_state
from ..session import drop_scratch, owned_scratch


def _written_batches(spark: SparkSession, output: str) -> dict[int, str]:
    """Finished tables of runs by batch number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(output)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    names = [status.getPath().getName() for status in files.listStatus(root)]
    done = [n for n in names if n.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{output}/{n}/_SUCCESS"))]
    return {int(n.removeprefix("batch=")): f"{output}/{n}" for n in done}


def run_early_stop(
    stream: DataFrame,
    run: str,
    epoch: str,
    value: str,
    output: str,
    checkpoint: str,
    *,
    mode: str = "max",
    delta: float = 0.0,
    patience: int = EARLY_STOP_PATIENCE,
    rows_per_bucket: int | None = None,
) -> None:
    """Take everything new from ``stream``, bring the table of runs below ``output`` up
    to date, then stop. Run again after new arrivals or a failure.

    Inside a micro-batch rows are taken in epoch order; epochs at or below a run's last
    one are dropped. Values that are NaN or missing never improve, as in the batch rule.
    """
    rows = stream.select(F.col(run).alias(run), F.col(epoch).cast("long").alias(epoch), F.col(value).cast("double").alias(value))
    settings = {"mode": mode, "delta": delta, "patience": patience}
    if rows_per_bucket:
        settings["rows_per_bucket"] = rows_per_bucket

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables = _written_batches(spark, output)
        last = max((n for n in tables if n < number), default=None)
        earlier = None if last is None else spark.read.parquet(tables[last])
        with owned_scratch() as owned:
            state = early_stop_state(batch, run, epoch, value, earlier=earlier, **settings)
            state.write.mode("overwrite").parquet(f"{output}/batch={number}")
        # The table this one was made from stays, for a batch that is repeated.
        drop_scratch(spark, [*owned, *(path for n, path in tables.items() if last is not None and n < last)])

    query = (
        rows.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_runs(spark: SparkSession, output: str) -> DataFrame:
    """The state of every run after the last batch: best, counter, stop epoch (null while
    it goes on) and last epoch."""
    tables = _written_batches(spark, output)
    return spark.read.parquet(tables[max(tables)])
