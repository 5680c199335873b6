"""Scoring of files as they arrive, with the same columns as in batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.persist import shared_dir


def score_new_files(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], target: str | None = None, checkpoint: str | None = None, files_at_once: int = 100) -> DataFrame:
    """Score every file not seen before, once, and stop; the result so far as a table.

    Progress is kept in ``checkpoint``, so a later call goes on where this one ended and a lost one is repeated
    exactly. ``score`` must work row by row.
    """
    own = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    target, checkpoint = target or f"{own}/out", checkpoint or f"{own}/progress"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    run = score(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(target)
