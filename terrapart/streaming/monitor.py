"""Monitoring of a growing run table with Structured Streaming."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as NotYet

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terrapart.functions.landcover import is_finite


def run_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New files of the run table as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def by_algorithm(runs: DataFrame, value: str = "best_fitness") -> DataFrame:
    """Runs, bad values, and mean, least and largest value of each algorithm so far."""
    x = F.col(value).cast("double")
    return runs.groupBy("algorithm").agg(
        F.count("*").alias("n"), F.count_if(~is_finite(x)).alias("n_bad"), F.round(F.avg(x), 6).alias("mean"), F.round(F.min(x), 6).alias("min"), F.round(F.max(x), 6).alias("max")
    )


def watch(runs: DataFrame, name: str, checkpoint: str, value: str = "best_fitness", every: str | None = None) -> StreamingQuery:
    """Keeps a table in memory named ``name`` with by_algorithm(); processes what is there and then ends, or goes on at intervals (``every``, as "60 seconds")."""
    writer = by_algorithm(runs, value).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def supervise(spark: SparkSession, stages: Sequence[tuple[str, Callable[[], object]]], gate: Callable[[str], DataFrame], every: float = 60.0, rows_each: int = 50) -> list[tuple[str, int]]:
    """Run the stages one after the other and watch their tables: (stage, rows) of each checkpoint.

    ``gate(stage)`` gives one row (n_rows, n_bad, n_failures), as quality_gate does. It is asked every ``every``
    seconds while the stage runs and once at its end; each further ``rows_each`` rows are logged as a checkpoint. Bad
    values, failure rows or an error of the stage end the run: the stage's Spark jobs are cancelled and RuntimeError
    is raised, and no later stage starts.
    """
    seen, context = [], spark.sparkContext

    def look(name: str, last: int, end: bool) -> int:
        row = gate(name).first()
        if row.n_bad or row.n_failures:
            raise RuntimeError(f"{name}: {row.n_bad} rows with bad values, {row.n_failures} failures")
        if end or row.n_rows // rows_each > last:
            logging.info("%s: %d rows", name, row.n_rows)
            seen.append((name, row.n_rows))
        return row.n_rows // rows_each

    for name, stage in stages:

        def job(name: str = name, stage: Callable[[], object] = stage) -> object:
            context.setJobGroup(f"supervised-{name}", name, True)
            return stage()

        last = 0
        with ThreadPoolExecutor(1) as pool:
            running = pool.submit(inheritable_thread_target(spark)(job))
            try:
                while True:
                    try:
                        running.result(timeout=every)
                        break
                    except NotYet:
                        if running.done():
                            raise
                        last = look(name, last, False)
            except RuntimeError:
                context.cancelJobGroup(f"supervised-{name}")
                raise
            except Exception as error:
                raise RuntimeError(f"{name} failed") from error
        look(name, last, True)
    return seen
